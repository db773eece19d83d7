"""Order-preserving packing of tokenised documents into sequences by dynamic programming.

The documents of a partition form one token stream, each ended by the end id. A sequence is a window of that
stream of at most `length` tokens; cuts are wanted at document ends (free) or sentence ends (a small penalty),
and inside a sentence only where no such place lies within reach (a large penalty). With f(j) the least cost
of a stream cut at candidate j,

    f(j) = penalty(j) + length - pos(j) + min over pos(i) >= pos(j) - length of f(i) + pos(i)

whose sliding minimum a monotone queue keeps, so each candidate enters and leaves once. The stream is worked
off in chapters of CHAPTER tokens; the last window of a chapter opens the next one. What is left at the end of a
partition is cut into windows whose sizes are powers of two, which need no padding.

Defined results: null text = empty text = the end id alone; null ids stay null; documents keep the order of
their partition (file order); repeated rows repeat; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, claim, ids_and_texts, read_table, real_id

LENGTH, END_ID = 4096, 2
#: Penalties in tokens of padding, and the longest stretch without a place to cut, for windows of LENGTH; others in proportion.
SENTENCE_PENALTY, INSIDE_PENALTY, STRETCH, CHAPTER = 4, 64, 256, 1 << 19

#: Fixed value: the word pattern of the tokenizer file. It holds for texts in the scripts below EXOTIC.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
EXOTIC = "ɐ"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids as little-endian 32-bit bytes. A chunk between spaces is encoded on its own and remembered, and so
    is each word; unseen words go to the tokenizer's model, unusual chunks to the whole tokenizer."""

    CHUNKS, PIECES = 250_000, 200_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        from .bpe import Memo, byte_alphabet

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_alphabet()
        self.pieces = Memo(self._piece, self.PIECES)
        self.chunks = Memo(self._chunk, self.CHUNKS)
        vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
        self.ends_sentence = np.zeros(max(vocab.values()) + 3, bool)
        for token, i in vocab.items():
            self.ends_sentence[i] = token[0] in ".!?" and token.removesuffix("</w>")[-1:] in ".!?"

    def _piece(self, word: str) -> bytes:
        mapped = word if word.isascii() and word.isalpha() else "".join([self.letters[b] for b in word.encode()])
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii():
            low = chunk.lower()
            if low.isalpha():
                return self.pieces[low]
            if low[-1:] in (".", ",") and low[:-1].isalpha():
                return self.pieces[low[:-1]] + self.pieces[low[-1]]
        if "<|" in chunk or not chunk or max(chunk) >= EXOTIC:
            return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join([self.pieces[w] for w in WORDS.findall(unicodedata.normalize("NFC", chunk).lower())])

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, text.split(" ")))


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def choose_cuts(places: np.ndarray, penalties: np.ndarray, length: int) -> list[int]:
    """Indexes into places (ascending, the last is the stream's end, gaps of at most `length`) of least total cost."""
    pos, cost = places.tolist(), penalties.tolist()
    best_from = [0] * len(pos)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, -1)])  # (f + pos, pos, index), ascending
    for j, at in enumerate(pos):
        low = at - length
        while queue[0][1] < low:
            queue.popleft()
        value, _, i = queue[0]
        best_from[j] = i
        value += cost[j] + length  # f(j) + pos(j)
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, at, j))
    cuts, j = [], len(pos) - 1
    while j >= 0:
        cuts.append(j)
        j = best_from[j]
    return cuts[::-1]


def candidates(ids: np.ndarray, ends: np.ndarray, ends_sentence: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a stream may be cut (token counts) and their penalties; `ends` are document ends."""
    n = len(ids)
    cost = np.full(n + 1, INSIDE_PENALTY * length / LENGTH)
    sentence = np.flatnonzero(ends_sentence[np.minimum(ids, len(ends_sentence) - 1)]) + 1
    cost[sentence] = SENTENCE_PENALTY * length / LENGTH
    cost[ends] = 0
    cost[n] = 0
    good = np.unique(np.concatenate([sentence, ends, [n]]))
    gaps = np.diff(np.concatenate([[0], good]))
    step = max(1, STRETCH * length // LENGTH)
    wide = np.flatnonzero(gaps > step)
    extra = [np.arange(good[g] - gaps[g] + step, good[g], step) for g in wide]
    places = np.unique(np.concatenate([good, *extra])) if extra else good
    places = places[places > 0]
    return places, cost[places]


class Packer:
    """The token stream of one partition: documents in, pieces out."""

    def __init__(self, partition: int, length: int, ends_sentence: np.ndarray):
        self.length, self.ends_sentence = length, ends_sentence
        self.sequence = partition << 32
        self.docs: list[tuple] = []  # (doc_id, ids, tokens of it already given out)
        self.waiting = 0

    def add(self, doc_id: int, ids: np.ndarray) -> bool:
        self.docs.append((doc_id, ids, 0))
        self.waiting += len(ids)
        return self.waiting >= CHAPTER

    def close(self, last: bool):
        """Rows (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of all windows that are settled."""
        if not self.docs:
            return []
        parts = [ids[done:] for _, ids, done in self.docs]
        sizes = np.array([len(p) for p in parts])
        stream, ends = np.concatenate(parts), np.cumsum(sizes)
        places, costs = candidates(stream, ends, self.ends_sentence, self.length)
        cuts = places[choose_cuts(places, costs, self.length)].tolist()
        tail = cuts.pop()
        begin = cuts[-1] if cuts else 0
        if last:
            left = tail - begin
            while left:  # the largest powers of two first
                size = 1 << (left.bit_length() - 1)
                begin += size
                cuts.append(begin)
                left -= size
        rows, doc, at = [], 0, 0
        starts = ends - sizes
        for cut in cuts:
            offset = 0
            while at < cut:
                to = min(cut, int(ends[doc]))
                doc_id, ids, done = self.docs[doc]
                start = done + at - int(starts[doc])
                rows.append((doc_id, start, to - at, ids[start : start + to - at].tobytes(), len(ids), self.sequence, offset))
                offset += to - at
                at = to
                doc += at == ends[doc]
            self.sequence += 1
        if doc < len(self.docs):
            doc_id, ids, done = self.docs[doc]
            self.docs = [(doc_id, ids, done + at - int(starts[doc])), *self.docs[doc + 1 :]]
        else:
            self.docs = []
        self.waiting = sum(len(ids) - done for _, ids, done in self.docs)
        return rows


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document in a sequence; ids are little-endian unsigned 32-bit."""
    path = path or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in PIECES.split(", ")]

    def batches_of(rows):
        for at in range(0, len(rows), 2000):
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 2000]), kinds)], names=names)

    def run(batches):
        claim("packing", _encoder.cache_clear)
        encoder = _encoder(path)
        packer = Packer(TaskContext.get().partitionId(), length, encoder.ends_sentence)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if packer.add(doc_id, np.frombuffer(encoder.encode(text) + end, "<u4")):
                    yield from batches_of(packer.close(last=False))
        yield from batches_of(packer.close(last=True))

    return arrow_map(ids_and_texts(docs, id_col, text_col), run, PIECES).withColumn("doc_id", real_id())


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(read_table(spark, sf_dir, "documents"))


def packed_digests(docs: DataFrame) -> DataFrame:
    return pack_documents(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


SQL: dict = {}
QUERIES = {"op4_packing": op4_packing}
