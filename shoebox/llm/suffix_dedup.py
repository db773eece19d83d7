"""Repeated-substring removal by a distributed merge of front-coded, sorted suffix runs.

A byte goes when some string of `length` (100) bytes covers it that also starts earlier: in a smaller doc_id or
before in the same document. All suffixes of a corpus can't be exchanged, so a content rule picks those that decide:

1. *Anchors.* Each window of 100 bytes owns the anchor whose 32-byte gram has the least hash in it (leftmost on
   ties). Equal windows own equal anchors at equal offsets, and an anchor serves a stretch of windows, about 35.
2. *Repeated grams.* Anchors are dealt by gram hash; those met once can't belong to a repeated string and end. A gram that a
   task meets twice is known to repeat: its anchors go straight on, and one mark tells the gram's bucket.
3. *Sorted runs.* For the others a task cuts the suffix that starts at the anchor, as far as the anchor's
   windows reach, an end mark, and the bytes to its left, nearest first. It sorts them, settles equal ones on the spot (all but
   the earliest are repeats) and sends one front-coded run to each bucket: shared prefixes are not sent again.
4. *Merge.* A bucket merges its runs with a loser tree that carries the known common prefix of every
   candidate with the last winner: different prefix lengths decide without looking at a byte, equal ones
   compare from there on. Neighbours in the merged order share the longest right parts, which bounds the windows that
   can match at all; those are looked up by their bytes, so results are exact.
5. Window starts that repeat are gathered by document and removed.

Hot passages: a gram with more anchors than a HEAVY-th of a partition's mean share (counted beforehand, at most HEAVY x
partitions of them) doesn't deal its contexts by gram but window by window, by the window's bytes: what the copies have in common
folds in each task, and what differs spreads over all buckets. Where a gram goes doesn't change a result.

Memory: a bucket's runs are read block by block; one gram's contexts are met as a stream, equal ones kept once.

Defined results: null text = empty text = nothing removed; texts under 100 bytes stay whole; null ids come before
all others and stay null; rows with one id (or none) and different texts are documents of their own, in the order of a
digest of id and text; rows that repeat id and text are judged as one position, so repeated rows don't remove each other;
an empty table gives an empty result; other columns are passed over, or carried along where `carry` names them.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, claim, ids_and_texts, materialise, read_table, real_id, spark_partitions
from ._shingles import mix

U = np.uint64
LENGTH, GRAM = 100, 32
SPREAD = LENGTH - GRAM  # an anchor lies 0 to 68 bytes behind its window's start
CHUNK = 1 << 20  # bytes that are hashed together
FLUSH_ANCHORS, FLUSH_CONTEXTS = 1 << 18, 1 << 16
RUN_BLOCK = 1024  # entries of a run that are compressed, and read, together
HEAVY, COUNT_ANCHORS, COUNT_LEAST = 16, 1 << 20, 4
END = b"\xff"  # ends a context's right part; no UTF-8 text holds it
_rng = np.random.default_rng(811)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_FACTOR = 0x9E3779B97F4A7C15
_POSITION = U((1 << 24) - 1)


def anchors_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """(text number, gram hash, anchor, first window, last window) of texts laid out in `data`, all positions
    relative to data. Texts under LENGTH bytes have none."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    if len(data) < LENGTH:
        return none
    h = _BYTE[data]
    step = 1
    while step < GRAM:
        h = h[:-step] * U(pow(_FACTOR, step, 1 << 64)) + h[step:]
        step *= 2
    h = mix(h)
    least = h & ~_POSITION | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= SPREAD + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = SPREAD + 1 - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    windows = np.maximum(sizes - LENGTH + 1, 0)
    total = int(windows.sum())
    if not total:
        return none
    text = np.repeat(np.arange(len(sizes)), windows)
    at = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(starts, windows)
    anchor = (least[at] & _POSITION).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[first[1:], total] - 1
    return text[first], h[anchor[first]], anchor[first], at[first], at[last]


def _chunks(batches, chunk: int):
    """Texts laid out in chunks of about `chunk` bytes: (uids, offset of each piece in its text, data, starts, sizes). Long texts are cut
    into pieces that overlap, so that each window lies in one piece."""
    held, total = [], 0
    for batch in batches:
        for uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = text.encode()
            for at in range(0, max(1, len(raw) - LENGTH + 1), chunk):
                piece = raw[at : at + chunk + LENGTH - 1]
                if len(piece) >= LENGTH:
                    held.append((uid, at, piece))
                    total += len(piece)
                if total >= chunk:
                    yield _lay_out(held)
                    held, total = [], 0
    if held:
        yield _lay_out(held)


def _lay_out(held):
    sizes = np.array([len(p) for _, _, p in held], np.int64)
    return np.array([d for d, _, _ in held], np.int64), np.array([a for _, a, _ in held], np.int64), np.frombuffer(b"".join(p for _, _, p in held), np.uint8), np.cumsum(sizes) - sizes, sizes


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes.view(np.uint64) >> U(44)).astype(np.int64) * buckets) >> 20


def _gram_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """An anchor's hash is the least of its windows, so it is mixed again before it deals anything."""
    return _bucket(mix(h), buckets)


def _split(bucket: np.ndarray, columns: list[np.ndarray], kind: int):
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)]
    return [(int(bucket[a]), kind, b"".join(c[a:b].tobytes() for c in columns)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if b > a]


def _rows(rows):
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "kind", "blob"])


def _frequent_grams(batches, chunk: int):
    """(gram, n) of grams met COUNT_LEAST times or more among COUNT_ANCHORS anchors, and (null, all anchors)."""
    held, total = [], 0

    def counted():
        grams, n = np.unique(np.concatenate(held), return_counts=True)
        many = n >= COUNT_LEAST
        return pa.record_batch([pa.array([None, *grams[many].view(np.int64).tolist()], pa.int64()), pa.array([total, *n[many].tolist()], pa.int64())], names=["gram", "n"])

    for _, _, data, starts, sizes in _chunks(batches, chunk):
        held.append(anchors_of(data, starts, sizes)[1])
        total += len(held[-1])
        if total >= COUNT_ANCHORS:
            yield counted()
            held, total = [], 0
    if total:
        yield counted()


def heavy_grams(source: DataFrame, least_share: float, chunk: int = CHUNK) -> np.ndarray:
    """Sorted hashes of the grams that hold more than so great a share of all anchors. A gram that is
    not counted has under COUNT_LEAST of any COUNT_ANCHORS anchors, so 3 in a million of them all."""
    counts = arrow_map(source.select("uid", "text"), partial(_frequent_grams, chunk=chunk), "gram long, n long")
    counts = materialise(counts.groupBy("gram").agg(F.sum("n").alias("n")), "suffix-grams")
    total = counts.where("gram IS NULL").first()
    if total is None:
        return np.zeros(0, np.uint64)
    found = counts.where(F.col("gram").isNotNull() & (F.col("n") > int(total["n"] * least_share))).collect()  # under 1 / least_share rows
    return np.sort(np.array([r["gram"] for r in found], np.int64).view(np.uint64))


def _find_anchors(batches, buckets: int, chunk: int):
    """Kind 0, by gram: anchors whose gram the gathering met once (h, uid, packed), and one mark (h, 0, -1) for each gram that
    it met oftener. Kind 1, by document: the anchors of the latter (uid, h, packed)."""
    claim("suffix_dedup", lambda: None)
    held, total = [], 0

    def deal():
        h, uid, packed = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(h, kind="stable")
        first = np.r_[True, h[order][1:] != h[order][:-1]]
        again = ~first | ~np.r_[first[1:], True]
        marks = h[order][first & again]
        many = np.zeros(len(h), bool)  # anchors stay in the order of their texts, which packs better
        many[order] = again
        asked = [np.concatenate([h[~many], marks]), np.concatenate([uid[~many], np.zeros(len(marks), np.int64)]), np.concatenate([packed[~many], np.full(len(marks), -1)])]
        rows = _split(_gram_bucket(asked[0], buckets), asked, 0)
        if many.any():
            rows += _split(_bucket(uid[many], buckets), [uid[many], h[many].view(np.int64), packed[many]], 1)
        return _rows(rows)

    for uids, offsets, data, starts, sizes in _chunks(batches, chunk):
        text, h, anchor, first, last = anchors_of(data, starts, sizes)
        place = anchor - starts[text] + offsets[text]
        held.append((h, uids[text], place << 14 | (anchor - first) << 7 | (anchor - last)))
        total += len(h)
        if total >= FLUSH_ANCHORS:
            yield deal()
            held, total = [], 0
    if total:
        yield deal()


def _same_bucket(batches):
    bucket, rows = None, []
    for batch in batches:
        for b, kind, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if b != bucket and rows:
                yield rows
                rows = []
            bucket = b
            rows.append((kind, blob))
    if rows:
        yield rows


def _columns(blob: bytes, n: int) -> list[np.ndarray]:
    whole = np.frombuffer(blob, np.int64)
    return list(whole.reshape(n, -1))


def _repeated_grams(batches, buckets: int):
    """The anchors whose gram occurs again (uid, h, packed), dealt by document."""
    for rows in _same_bucket(batches):
        known = [(kind, blob) for kind, blob in rows if kind == 1]
        if known:
            yield _rows([(int(_bucket(np.frombuffer(blob[:8], np.int64), buckets)[0]), 0, blob) for _, blob in known])
        parts = [_columns(blob, 3) for kind, blob in rows if kind == 0]
        if not parts:
            continue
        h, uid, packed = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(h, kind="stable")
        h, uid, packed = h[order], uid[order], packed[order]
        same = h[1:] == h[:-1]
        keep = (np.r_[False, same] | np.r_[same, False]) & (packed >= 0)
        h, uid, packed = h[keep], uid[keep], packed[keep]
        if len(h):
            order = np.lexsort((packed, uid))
            uid, h, packed = uid[order], h[order], packed[order]
            yield _rows(_split(_bucket(uid, buckets), [uid, h.view(np.int64), packed], 0))


def _gather(batches, width: int, keys: int):
    """What was dealt by document, as one row for each: the key columns (uid, or uid and doc_id) and a blob."""
    for rows in _same_bucket(batches):
        columns = [np.concatenate(c) for c in zip(*(_columns(blob, width) for _, blob in rows))]
        order = np.lexsort(columns[:keys][::-1])
        columns = [c[order] for c in columns]
        fresh = np.any([c[1:] != c[:-1] for c in columns[:keys]], axis=0)
        cuts = np.r_[0, np.flatnonzero(fresh) + 1, len(order)].tolist()
        table = np.stack(columns[keys:], axis=1)
        for at in range(0, len(cuts) - 1, 5000):
            part = cuts[at : at + 5001]
            pairs = list(zip(part, part[1:]))
            if pairs:
                heads = [pa.array(c[part[:-1]], pa.int64()) for c in columns[:keys]]
                yield pa.record_batch([*heads, pa.array([table[a:b].tobytes() for a, b in pairs], pa.binary())], names=["of_uid", "of_doc"][:keys] + ["blob"])


# --- runs -----------------------------------------------------------------------------------------------


def front_code(entries: list[tuple]) -> bytes:
    """Sorted (key, right length, doc, uid, packed) as one blob; a key's bytes shared with the key before are left out.
    A blob is a row of blocks, each a length and so many compressed bytes."""
    blocks, before = [], b""
    for at in range(0, len(entries), RUN_BLOCK):
        part = entries[at : at + RUN_BLOCK]
        shared, tails = np.zeros(len(part), np.uint8), []
        for i, entry in enumerate(part):
            key = entry[0]
            shared[i] = s = common_prefix(before, key, 0)
            tails.append(key[s:])
            before = key
        columns = [np.array([e[k] for e in part], np.int64) for k in (2, 3, 4)] + [np.array([len(e[0]) for e in part], np.uint8), np.array([e[1] for e in part], np.uint8), shared]
        packed = zstandard.compress(b"".join(c.tobytes() for c in columns) + b"".join(tails), 3)
        blocks += [np.array([len(part), len(packed)], np.int32).tobytes(), packed]
    return b"".join(blocks)


def read_run(blob: bytes):
    """Yield (key, prefix shared with the key before, right length, doc, uid, packed) of a front-coded run."""
    begin, key = 0, b""
    while begin < len(blob):
        n, size = np.frombuffer(blob[begin : begin + 8], np.int32).tolist()
        block = zstandard.decompress(blob[begin + 8 : begin + 8 + size])
        begin += 8 + size
        doc, uid, packed = (memoryview(block)[a : a + 8 * n].cast("q") for a in (0, 8 * n, 16 * n))
        at = 24 * n
        sizes, right, shared = block[at : at + n], block[at + n : at + 2 * n], block[at + 2 * n : at + 3 * n]
        at += 3 * n
        for i in range(n):
            s = shared[i]
            to = at + sizes[i] - s
            key = key[:s] + block[at:to]
            at = to
            yield key, s, right[i], doc[i], uid[i], packed[i]


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which `known` bytes are known."""
    m = min(len(a), len(b))
    x, y = a[known:m], b[known:m]
    if x == y:
        return m
    return m - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7 >> 3)


class LoserTree:
    """Merge of sorted runs. Each run's head keeps its common prefix with the last winner; of two heads the one
    with the longer prefix is smaller, and only equal prefixes are compared, from their end on."""

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        k = 1
        while k < len(runs):
            k *= 2
        self.k = k
        self.head: list = [next(r, None) for r in self.runs] + [None] * (k - len(runs))
        self.known = [0] * k
        self.loser = [0] * k
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        a, b = self._play(a, b)
        self.loser[node] = b
        return a

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes the one with the winner."""
        x, y = self.head[a], self.head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        m, n = self.known[a], self.known[b]
        if m != n:
            return (a, b) if m > n else (b, a)
        x, y = x[0], y[0]
        s = common_prefix(x, y, m)
        if x[s:] <= y[s:] if s < len(x) and s < len(y) else len(x) <= len(y):
            self.known[b] = s
            return a, b
        self.known[a] = s
        return b, a

    def __iter__(self):
        """Yield (key, prefix shared with the key before in the merged order, right length, doc, uid, packed)."""
        head, loser, known, k, runs = self.head, self.loser, self.known, self.k, self.runs
        w = self.winner
        while (top := head[w]) is not None:
            yield top[0], known[w], top[2], top[3], top[4], top[5]
            head[w] = new = next(runs[w], None)
            # the run's own front code is the prefix with the last winner
            known[w] = new[1] if new is not None else 0
            node = (w + k) >> 1
            while node:
                w, loser[node] = self._play(w, loser[node])
                node >>= 1


def _contexts(raw: bytes, q: int, left: int, behind: int, by_window: bool):
    """(key, left, behind) of an anchor at q: one context for all its windows, or one for each."""
    for last, first in [(o, o) for o in range(behind, left + 1)] if by_window else [(behind, left)]:
        yield raw[q : q + LENGTH - last] + END + raw[q - first : q][::-1], first, last


def _cut_contexts(batches, buckets: int, heavy):
    """Front-coded runs of repeated anchors' contexts (kind 1: whole, by gram; kind 3: window by window, by its bytes) and
    windows settled here (kind 2: uid, doc, windows)."""
    held: dict[bytes, list] = {}
    settled: list[tuple[int, int, int]] = []
    hot = heavy.value

    def deal():
        rows, runs = [], {}
        for key, (right, doc, uid, packed, run) in held.items():
            runs.setdefault(run, []).append((key, right, doc, uid, packed))
        for (bucket, kind), entries in runs.items():
            entries.sort()
            rows.append((bucket, kind, front_code(entries)))
        if settled:
            columns = [np.array(c, np.int64) for c in zip(*settled)]
            rows += _split(_bucket(columns[0], buckets), columns, 2)
        held.clear()
        settled.clear()
        return [_rows(rows[at : at + 64]) for at in range(0, len(rows), 64)]

    for batch in batches:
        for doc, uid, text, blob in zip(*(c.to_pylist() for c in batch.columns)):
            raw = text.encode()
            table = np.frombuffer(blob, np.int64).reshape(-1, 2)
            grams = table[:, 0].view(np.uint64)
            of = _gram_bucket(grams, buckets).tolist()
            by_window = np.isin(grams, hot).tolist()
            for packed, of_gram, split in zip(table[:, 1].tolist(), of, by_window):
                q, left, behind = packed >> 14, packed >> 7 & 127, packed & 127
                if q - left < 0 or q + LENGTH - behind > len(raw):
                    continue  # an anchor of another row whose uid is the same
                for key, first, last in _contexts(raw, q, left, behind, split):
                    found = held.get(key)
                    own = (doc, uid, q)
                    if found is None:
                        held[key] = [LENGTH - last, doc, uid, q << 14 | first << 7 | last, (zlib.crc32(key) * buckets >> 32, 3) if split else (of_gram, 1)]
                        continue
                    other = (found[1], found[2], found[3] >> 14)
                    if own > other:
                        settled.append((uid, doc, stretch(q - first, q - last)))
                    elif own < other:
                        settled.append((found[2], found[1], stretch(other[2] - first, other[2] - last)))
                        found[1:4] = doc, uid, q << 14 | first << 7 | last
            if len(held) + len(settled) >= FLUSH_CONTEXTS:
                yield from deal()
    if held or settled:
        yield from deal()


def _group_windows(group: list[list], out: list[tuple[int, int, int]]) -> None:
    """Windows of one gram's different contexts: [key, right length, place (doc, uid, at), left, behind, longest right prefix
    shared with any other context]."""
    repeats: dict[int, list[int]] = {}
    for offset in range(min(c[4] for c in group), max(c[3] for c in group) + 1):
        need = LENGTH - offset
        seen: dict[bytes, int] = {}
        for i, (key, right, place, left, behind, near) in enumerate(group):
            if near < need or not behind <= offset <= left:
                continue
            window = key[:need] + key[right + 1 : right + 1 + offset]
            j = seen.setdefault(window, i)
            if j == i:
                continue
            other = group[j][2]
            if place > other:
                repeats.setdefault(i, []).append(offset)
            elif place < other:
                repeats.setdefault(j, []).append(offset)
                seen[window] = i
    for i, offsets in repeats.items():
        doc, uid, at = group[i][2]
        run = last = offsets[0]
        for o in [*offsets[1:], None]:
            if o is None or o != last + 1:
                out.append((uid, doc, stretch(at - last, at - run)))
                run = o
            last = o


def merge_runs(runs: list, out: list[tuple[int, int, int]], by_window: bool = False):
    """Merge front-coded runs; put (uid, doc, stretch of repeated window starts) into out, yielding now and then. Runs
    of single windows are settled by equal keys alone."""
    group: list[list] = []
    for key, shared, right, doc, uid, packed in LoserTree([read_run(r) for r in runs]):
        place, left, behind = (doc, uid, packed >> 14), packed >> 7 & 127, packed & 127
        if group and shared >= GRAM and (not by_window or shared == len(key) == len(group[-1][0])):
            before = group[-1]
            if shared == len(key) == len(before[0]):
                later, at = (place, place[2]) if place > before[2] else (before[2], before[2][2])
                if place != before[2]:
                    out.append((later[1], later[0], stretch(at - left, at - behind)))
                    before[2] = min(place, before[2])
                continue
            # the end mark keeps contexts in the order of their right parts: neighbours share the longest
            near = min(shared, right, before[1])
            before[5] = max(before[5], near)
            group.append([key, right, place, left, behind, near])
        else:
            if len(group) > 1:
                _group_windows(group, out)
            group = [[key, right, place, left, behind, 0]]
        if len(out) >= 1 << 16:
            yield
    if len(group) > 1:
        _group_windows(group, out)
    yield


def _merge(batches, buckets: int):
    out: list[tuple[int, int, int]] = []

    def deal():
        columns = [np.array(c, np.int64) for c in zip(*out)]
        out.clear()
        return [_rows(_split(_bucket(columns[0], buckets), columns, 2))]

    for rows in _same_bucket(batches):
        settled = [(int(_bucket(np.frombuffer(blob[:8], np.int64), buckets)[0]), 2, blob) for kind, blob in rows if kind == 2]
        if settled:
            yield _rows(settled)
        for which in (1, 3):
            for _ in merge_runs([blob for kind, blob in rows if kind == which], out, which == 3):
                if len(out) >= 1 << 16:
                    yield from deal()
    if out:
        yield from deal()


def stretch(first: int, last: int) -> int:
    """Window starts first..last of one anchor, so at most SPREAD apart, as one number."""
    return first << 7 | last - first


def spans_of(stretches: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the windows of the stretches cover, within a text of size bytes."""
    spans: list[tuple[int, int]] = []
    for packed in np.sort(stretches).tolist():
        first = packed >> 7
        end = min(first + (packed & 127) + LENGTH, size)
        if spans and first <= spans[-1][1]:
            if end > spans[-1][1]:
                spans[-1] = (spans[-1][0], end)
        elif first < end:
            spans.append((first, end))
    return spans


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _remove(batches, as_text: bool):
    """Rows of (doc_id, carried columns, text, blob): text and blob become what RESULT names."""
    for batch in batches:
        found = []
        for text, blob in zip(batch.column("text").to_pylist(), batch.column("blob").to_pylist()):
            raw = text.encode()
            spans = spans_of(np.frombuffer(blob, np.int64), len(raw)) if blob else []
            kept, at = [], 0
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            kept = b"".join([*kept, raw[at:]])
            # as text: a character that a cut has halved goes
            found.append((len(raw), sum(b - a for a, b in spans), len(spans), [{"start": a, "end": b} for a, b in spans], kept.decode("utf-8", "ignore") if as_text else kept))
        if found:
            kinds = [pa.int64()] * 3 + [SPAN, pa.string() if as_text else pa.binary()]
            rest = batch.drop_columns(["text", "blob"])
            yield pa.record_batch([*rest.columns, *(pa.array(c, k) for c, k in zip(zip(*found), kinds))], names=[*rest.schema.names, "n_bytes", "n_removed", "n_spans", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False, carry: tuple = (), heavy: float = HEAVY, chunk: int = CHUNK) -> DataFrame:
    """doc_id, the columns that `carry` names, n_bytes, n_removed, n_spans, spans and kept (the remaining bytes, or the remaining
    text) for each row. `heavy` and `chunk` choose routes and sizes, not results."""
    spark = docs.sparkSession
    n = spark_partitions(spark)
    bare = ids_and_texts(docs, id_col, text_col, *(F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)))
    source = bare.withColumn("uid", F.xxhash64("doc_id", "text"))
    rows = "bucket int, kind int, blob binary"
    hot = spark.sparkContext.broadcast(heavy_grams(source, 1 / (heavy * n), chunk))  # under heavy * n numbers

    def by_bucket(df: DataFrame) -> DataFrame:
        return df.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket")

    anchors = by_bucket(arrow_map(source.select("uid", "text"), partial(_find_anchors, buckets=n, chunk=chunk), rows))
    repeated = arrow_map(by_bucket(arrow_map(anchors, partial(_repeated_grams, buckets=n), rows)), partial(_gather, width=3, keys=1), "of_uid long, blob binary")
    repeated = materialise(repeated, "suffix-repeated")  # the anchors' shuffle files go before the texts' are written
    # both joins read the texts by uid: one exchange serves both
    contexts = source.join(repeated.hint("merge"), F.col("uid") == F.col("of_uid")).select("doc_id", "uid", "text", "blob")
    merged = arrow_map(by_bucket(arrow_map(contexts, lambda b: _cut_contexts(b, n, hot), rows)), partial(_merge, buckets=n), rows)
    windows = arrow_map(by_bucket(merged), partial(_gather, width=3, keys=2), "of_uid long, of_doc long, blob binary")
    # uids alone are the join's key, as above; different rows of one uid are told apart by their ids
    same = (F.col("uid") == F.col("of_uid")) & (F.col("doc_id").bitwiseXOR(F.col("of_doc")) == 0)
    carried = [f"carried_{i}" for i in range(len(carry))]
    joined = source.join(windows.hint("merge"), same, "left").select("doc_id", *carried, "text", "blob")
    kinds = dict(joined.dtypes)
    result = ", ".join(["doc_id long", *(f"{c} {kinds[c]}" for c in carried), "n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>", f"kept {'string' if as_text else 'binary'}"])
    out = arrow_map(joined, partial(_remove, as_text=as_text), result).withColumn("doc_id", real_id())
    return out.select("doc_id", *(F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)), "n_bytes", "n_removed", "n_spans", "spans", "kept")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL: dict = {}
QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
