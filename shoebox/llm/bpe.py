"""Byte-level BPE encoding and decoding over a minimal acyclic transducer lexicon.

Frequent words (counted over the whole corpus by a mergeable bounded summary) are compiled, with the ids of
their encoding, into a shared-suffix automaton: a word's path numbers it, the number finds its ids. The
automaton is one flat byte string that workers memory-map. Words outside it are merged exactly, lowest rank
first. The split into words, the byte alphabet and the merges are those of the tokenizer file.

A text is cut at single spaces: a word with its leading space never depends on what lies before, so
each chunk is split and encoded on its own and remembered in bounded memos. Texts in which white space meets
a space are split as a whole.

Defined results: null text = empty text = no ids; special tokens written in a text become their id, as the
tokenizer does; null ids stay null; repeated rows repeat; other columns are ignored. The choice of lexicon
words never changes a result.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import re
import struct
import tempfile
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, claim, ids_and_texts, read_table, real_id

#: White space as Unicode defines it, and the word pattern of the tokenizer file.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
IS_SPACE = frozenset(chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))

LEXICON_WORDS, SUMMARY_WORDS = 1 << 15, 1 << 15
CHUNK_MEMO, WORD_MEMO = 300_000, 250_000
#: A letter word that one of these ends is the commonest kind of chunk and needs no pattern.
STOPS = frozenset(".,!?;:")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return [out[b] for b in range(256)]


class ByteBpe:
    """Vocabulary and merges of a byte-level BPE file: exact merging and decoding."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, letters = spec["model"]["vocab"], byte_alphabet()
        self.byte_ids = [vocab[c] for c in letters]
        back = {c: b for b, c in enumerate(letters)}
        self.token_bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes |= {i: t.encode() for t, i in self.specials.items()}
        self.rank_of: dict[tuple[int, int], int] = {}
        self.made_by: list[int] = []
        for merge in spec["model"]["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.rank_of[vocab[a], vocab[b]] = len(self.made_by)
            self.made_by.append(vocab[a + b])
        self.vocabulary = {b: i for i, b in self.token_bytes.items() if i not in self.specials.values()}
        self.longest_from: dict[bytes, int] = {}  # first four bytes -> the longest token that starts so
        for token in self.vocabulary:
            if len(token) > 3:
                self.longest_from[token[:4]] = max(len(token), self.longest_from.get(token[:4], 0))
        self.pair_holds: dict[int, bool] = {}
        n = max(self.token_bytes) + 1
        pieces = [self.token_bytes.get(i, b"") for i in range(n)]
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.lengths = np.array([len(x) for x in pieces], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def merge(self, word: bytes) -> list[int]:
        """Apply the lowest-ranked merge, leftmost first, until none applies."""
        ids = [self.byte_ids[b] for b in word]
        rank, none = self.rank_of.get, len(self.made_by)
        ranks = [rank(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [self.made_by[best]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), none)
        return ids

    def encode(self, word: bytes) -> list[int]:
        """The same ids as merge(), found from left to right.

        A sequence of tokens is what merging gives exactly when each adjacent pair is what merging gives for
        the pair's bytes. So take the longest token that goes with the one before, else a shorter one, else
        step back; places from which no way leads on are marked dead."""
        vocabulary, longest, holds, n = self.vocabulary.get, self.longest_from.get, self.pair_holds, len(word)
        tokens: list[int] = []
        places = [0]
        dead = set()
        while places[-1] < n:
            at = places[-1]
            before = tokens[-1] if tokens else -1
            for end in range(min(n, at + longest(word[at : at + 4], 3)), at, -1):
                token = vocabulary(word[at:end])
                if token is None or end in dead:
                    continue
                if before >= 0:
                    key = before << 20 | token
                    fits = holds.get(key)
                    if fits is None:
                        if len(holds) >= 500_000:
                            holds.clear()
                        fits = holds[key] = self.merge(self.token_bytes[before] + self.token_bytes[token]) == [before, token]
                    if not fits:
                        continue
                tokens.append(token)
                places.append(end)
                break
            else:
                if not tokens:
                    return self.merge(word)
                dead.add(at)
                tokens.pop()
                places.pop()
        return tokens

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        return self.flat[np.arange(ends[-1]) + np.repeat(self.offsets[ids] - ends + lengths, lengths)].tobytes()


class Memo(dict):
    """A bounded memo of two generations: when the young one is full it becomes the old one."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


# --- the transducer -------------------------------------------------------------------------------------


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic automaton over sorted words, one path number for each, and the ids by number.

    Layout: header of six counts, then state starts, transition targets and skips (32 bit), ids and their
    starts (32 bit), final flags and labels (8 bit)."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []

    def settle(node: list) -> int:
        key = (node[0], tuple((c, t) for c, t in node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # the open nodes of the last word: [final, [(label, state)]]
    last = b""
    words = sorted(entries)
    for word in words:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        while len(path) > shared + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(node)))
        path += [[False, []] for _ in range(len(word) - shared)]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((last[len(path) - 1], settle(node)))
    root = settle(path[0])
    below: list[int] = []  # words that can be completed from a state; children settle before their parents
    for final, moves in states:
        below.append(final + sum(below[t] for _, t in moves))
    starts, targets, skips, labels = [0], [], [], bytearray()
    for final, moves in states:
        number = int(final)
        for label, target in moves:
            labels.append(label)
            targets.append(target)
            skips.append(number)
            number += below[target]
        starts.append(len(labels))
    ids = [i for w in words for i in entries[w]]
    id_starts = np.cumsum([0, *(len(entries[w]) for w in words)])
    ints = np.concatenate([np.array(x, np.uint32) for x in (starts, targets, skips, ids, id_starts)])
    head = struct.pack("<6I", len(states), len(targets), len(words), len(ids), root, 0)
    return head + ints.astype("<u4").tobytes() + bytes(f for f, _ in states) + bytes(labels)


class Lexicon:
    """A compiled lexicon, read through a memory map (the file is unlinked at once)."""

    def __init__(self, compiled: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(compiled)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n, moves, self.words, n_ids, self.root, _ = struct.unpack_from("<6I", self.map)
        view = memoryview(self.map)
        cuts = np.cumsum([24, 4 * (n + 1), 4 * moves, 4 * moves, 4 * n_ids, 4 * (self.words + 1)]).tolist()
        self.starts, self.targets, self.skips, self.ids, self.id_starts = (view[a:b].cast("I") for a, b in zip(cuts, cuts[1:]))
        self.finals, self.labels = cuts[-1], cuts[-1] + n
        self.heads = Memo(lambda head: self._walk(head, 0, self.root, 0), 50_000)

    def _walk(self, word: bytes, at: int, state: int, number: int) -> tuple[int, int]:
        """(state, words before) after the bytes from `at` on; state -1 where no way leads on."""
        starts, labels, find = self.starts, self.labels, self.map.find
        for i in range(at, len(word)):
            move = find(word[i : i + 1], labels + starts[state], labels + starts[state + 1])
            if move < 0:
                return -1, 0
            move -= labels
            number += self.skips[move]
            state = self.targets[move]
        return state, number

    def find(self, word: bytes) -> list[int] | None:
        state, number = self.heads[word[:5]]
        if state >= 0 and len(word) > 5:
            state, number = self._walk(word, 5, state, number)
        if state < 0 or not self.map[self.finals + state]:
            return None
        return self.ids[self.id_starts[number] : self.id_starts[number + 1]].tolist()


# --- encoding -------------------------------------------------------------------------------------------


def split_chunk(chunk: str) -> list[str]:
    """The words of a chunk that stands after a single space."""
    if chunk.isascii():
        if chunk.isalpha():
            return [" " + chunk]
        if chunk[-1:] in STOPS and chunk[:-1].isalpha():
            return [" " + chunk[:-1], chunk[-1]]
    return WORDS.findall(" " + chunk)


class Encoder:
    """Texts to decimal ids joined by commas, and back."""

    def __init__(self, path: str, compiled: bytes | None = None):
        self.bpe = ByteBpe(path)
        self.lexicon = Lexicon(compiled) if compiled else None
        self.words = Memo(self._word, WORD_MEMO)
        self.chunks = Memo(self._chunk, CHUNK_MEMO)
        self.unspaced = Memo(lambda c: self._pieces(c), CHUNK_MEMO // 10)

    def _word(self, word: str) -> str:
        raw = word.encode()
        ids = self.lexicon.find(raw) if self.lexicon else None
        return ",".join(map(str, self.bpe.encode(raw) if ids is None else ids))

    def _pieces(self, text: str) -> str:
        return ",".join([self.words[w] for w in WORDS.findall(text)])

    def _chunk(self, chunk: str) -> str | None:
        if not chunk or chunk[0] in IS_SPACE or chunk[-1] in IS_SPACE:
            return None
        return ",".join([self.words[w] for w in split_chunk(chunk)])

    def _segment(self, text: str) -> list[str]:
        first, *rest = text.split(" ")
        if first and first[-1] not in IS_SPACE:
            parts = [self.unspaced[first], *map(self.chunks.__getitem__, rest)]
            if None not in parts:
                return parts
        return [self.words[w] for w in WORDS.findall(text)]

    def encode(self, text: str) -> list[str]:
        """The text's ids as strings of decimal ids joined by commas."""
        split = self.bpe.special_split
        if split is None or not any(s in text for s in self.bpe.specials):
            return self._segment(text) if text else []
        parts = []
        for part in split.split(text):
            if part in self.bpe.specials:
                parts.append(str(self.bpe.specials[part]))
            elif part:
                parts += self._segment(part)
        return parts

    def decode(self, ids: np.ndarray) -> str:
        return self.bpe.decode(ids).decode("utf-8", "replace")


def parse_ids(joined: str) -> np.ndarray:
    return np.fromstring(joined, np.int64, sep=",") if joined else np.zeros(0, np.int64)


@lru_cache(maxsize=2)
def _encoder(path: str, compiled: bytes | None) -> Encoder:
    return Encoder(path, compiled)


def count_words(docs: DataFrame, text_col: str = "text", top: int = LEXICON_WORDS, summary: int = SUMMARY_WORDS) -> list[str]:
    """The corpus's most frequent words: each task keeps a Misra-Gries summary (any word above 1 in `summary`
    of its words is kept), the summaries add up by a grouped sum, and the `top` words reach the driver."""

    def fold(counts: Counter, chunks: Counter) -> None:
        for chunk, n in chunks.items():
            for word in split_chunk(chunk):
                counts[word] += n
        chunks.clear()
        if len(counts) > summary:
            cut = sorted(counts.values(), reverse=True)[summary]
            for word in [w for w, n in counts.items() if n <= cut]:
                del counts[word]
            for word in counts:
                counts[word] -= cut

    def run(batches):
        counts, chunks = Counter(), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                chunks.update(text.split(" "))
                if len(chunks) > CHUNK_MEMO:
                    fold(counts, chunks)
        fold(counts, chunks)
        words = list(counts)
        if words:
            yield pa.record_batch([pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64())], names=["word", "n"])

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = arrow_map(texts, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in counted.orderBy(F.desc("n"), "word").limit(top).collect()]


def build_lexicon(docs: DataFrame, path: str, text_col: str = "text", top: int = LEXICON_WORDS) -> bytes:
    bpe = ByteBpe(path)
    return compile_lexicon({w.encode(): bpe.merge(w.encode()) for w in count_words(docs, text_col, top)})


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", lexicon: bytes | None = None, outputs: tuple[str, ...] = ("ids", "decoded", "digests")) -> DataFrame:
    """doc_id, n_tokens and, as asked: ids array<int>, decoded string, ids_sha256 and decoded_sha256.

    lexicon: from :func:`build_lexicon` (a few MB at most: `top` words); without it all words are merged."""
    path = path or default_tokenizer()
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    schema = "doc_id long, n_tokens long" + (", ids array<int>" if "ids" in outputs else "") + (", decoded string" if "decoded" in outputs else "") + (", ids_sha256 string, decoded_sha256 string" if "digests" in outputs else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        claim("bpe", _encoder.cache_clear)
        encoder = _encoder(path, shared.value)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = encoder.encode(text)
                joined = ",".join(parts)
                ids = parse_ids(joined)
                row = [doc_id, len(ids)]
                decoded = encoder.decode(ids) if len(outputs) > ("ids" in outputs) else ""
                if "ids" in outputs:
                    row.append(ids.tolist())
                if "decoded" in outputs:
                    row.append(decoded)
                if "digests" in outputs:
                    row += [hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                rows.append(row)
            if rows:
                kinds = {"ids": pa.list_(pa.int32()), "doc_id": pa.int64(), "n_tokens": pa.int64()}
                yield pa.record_batch([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows))], names=names)

    return arrow_map(ids_and_texts(docs, id_col, text_col), run, schema).withColumn("doc_id", real_id())


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = read_table(spark, sf_dir, "documents"), default_tokenizer()
    return encode_documents(docs, path, lexicon=build_lexicon(docs, path), outputs=("digests",))


SQL: dict = {}
QUERIES = {"op3_bpe": op3_bpe}
