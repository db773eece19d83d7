"""Exact dedup, n-gram join and suffix dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoebox.llm import exact_dedup, ngram_join, suffix_dedup
from shoebox.llm._shingles import shingle_sets

from .conftest import prose

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(i):
    return -(1 << 63) if i is None else i


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_dedup(odd, odd_rows, keep, digest_bytes):
    got = [tuple(r) for r in exact_dedup.exact_dedup(odd, keep=keep, digest_bytes=digest_bytes).collect()]
    groups = {}
    for i, t in odd_rows:
        groups.setdefault((t or "").translate(LOW), []).append(i)
    want = []
    for t, ids in groups.items():
        best = (max if keep == "largest" else min)(ids, key=key)
        kept = False
        for i in sorted(ids, key=key):
            want.append((i, best, len(ids), i == best and not kept, hashlib.sha256(t.encode()).hexdigest()))
            kept |= i == best
    order = lambda r: (key(r[0]), r[4], not r[3])
    assert sorted(got, key=order) == sorted(want, key=order)


def test_lsm_index_compacts_in_tiers():
    rnd = np.random.default_rng(1)
    index = exact_dedup.LsmIndex(largest=False, memtable=64, fan=3)
    seen = {}
    for _ in range(40):
        words = rnd.integers(0, 200, (50, 1), dtype=np.uint64).repeat(4, axis=1)
        ids = rnd.integers(0, 10_000, 50)
        for w, i in zip(words[:, 0].tolist(), ids.tolist()):
            best, n = seen.get(w, (i, 0))
            seen[w] = (min(best, i), n + 1)
        index.put(words, [ids, np.zeros(50, np.int64), np.ones(50, np.int64), np.ones(50, np.int64), np.zeros(50, bool)])
    run = index.compact()
    assert {w: (i, n) for w, i, n in zip(run.words[:, 0].tolist(), run.columns[0].tolist(), run.columns[2].tolist())} == seen
    assert run.filter.admits(run.words).all()


def sets_of(rows):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        out.append((i, {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()))
    return out


def linked(rows):
    sets = sets_of(rows)
    label = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for a, (_, x) in enumerate(sets):
            for b, (_, y) in enumerate(sets):
                if x and y and label[a] > label[b] and 100 * len(x & y) >= 85 * len(x | y):
                    label[a], changed = label[b], True
    least = {c: min(key(rows[i][0]) for i in range(len(rows)) if label[i] == c) for c in set(label)}
    return sorted((key(i), len(s), least[c]) for (i, s), c in zip(sets, label))


def components(df, **kw):
    return sorted((key(r.doc_id), r.n_shingles, key(r.component_id)) for r in ngram_join.jaccard_components(df, **kw).collect())


def test_ngram_join_odd_rows(odd, odd_rows):
    assert components(odd) == linked(odd_rows)


@pytest.mark.parametrize("route", [{}, {"block_tokens": 600}, {"pivot_sets": 4}, {"pivot_sets": 2, "block_tokens": 600}])
def test_ngram_join_chains_of_edits(spark, route):
    """Chains in which neighbours link and ends don't, and a group far larger than a short list."""
    rnd = random.Random(2)
    rows, n = [], 0
    for size in (3, 12, 90):
        words = prose(rnd, 80).split()
        for _ in range(size):
            words = words.copy()
            words[rnd.randrange(len(words))] = prose(rnd, 1)
            rows.append((n, " ".join(words)))
            n += 1
    rnd.shuffle(rows)
    assert components(spark.createDataFrame(rows, "doc_id long, text string"), **route) == linked(rows)


def test_ngram_join_ids_that_repeat(spark):
    """Unrelated texts without an id, or under one id, don't tie what is near each of them."""
    rnd = random.Random(14)
    x, y = prose(rnd, 60).split(), prose(rnd, 60).split()
    near = lambda w: " ".join([*w[:-1], "changed"])
    for i in (None, 5):
        rows = [(i, " ".join(x)), (i, " ".join(y)), (10, near(x)), (20, near(y)), (i, " ".join(x))]
        got = components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
        assert got == linked(rows) and len({c for _, _, c in got}) == 1  # both components hold the id
        out = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).where("first").collect()
        assert len({r.row for r in out}) == 2 and {r.doc_id for r in out} == {i}
    rows = [(5, " ".join(x)), (5, " ".join(y)), (3, near(x)), (20, near(y))]
    got = components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == linked(rows) and {i: c for i, _, c in got if i != 5} == {3: 3, 20: 5}


def test_cluster_components_equal_brute_force():
    rnd = random.Random(3)
    for _ in range(60):
        pool = [list(range(k * 40, k * 40 + 40)) for k in range(2)]
        sets = []
        for _ in range(rnd.randint(2, 14)):
            s = set(rnd.choice(pool))
            for _ in range(rnd.randint(0, 6)):
                s.discard(rnd.choice(sorted(s)))
                s.add(rnd.randrange(1000))
            sets.append(np.array(sorted(s), np.uint64))
        label = list(range(len(sets)))
        for _ in sets:
            for a, x in enumerate(sets):
                for b, y in enumerate(sets):
                    common = len(np.intersect1d(x, y))
                    if ngram_join.links(common, len(x), len(y)):
                        label[a] = label[b] = min(label[a], label[b])
        assert ngram_join.cluster_components(sets) == label


def test_shingles_see_words_not_bytes():
    a, b, c, d = shingle_sets([b"a b  c\td e", b"A B C D E", b"ab c d e", b""])
    assert (a == b).all() and len(a) == 2 and len(c) == 1 and len(d) == 0


def brute_repeats(rows, order=None):
    """Rows are judged in the order of `order` (the id by default); rows of equal id and text as one position."""
    seen, out = {}, []
    order = order or (lambda i, t: (key(i), 0))
    for i, t in rows:
        raw, rank = (t or "").encode(), order(i, t or "")
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            seen[w] = min(seen.get(w, ((1 << 62, 0), 0)), (rank, p))
    for i, t in rows:
        raw, rank = (t or "").encode(), order(i, t or "")
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if seen[raw[p : p + 100]] < (rank, p):
                gone[p : p + 100] = True
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(int)))
        out.append((key(i), len(raw), int(gone.sum()), len(edges) // 2, bytes(b for b, g in zip(raw, gone) if not g)))
    return sorted(out)


def digest_order(spark, rows):
    """The order that the operator states for rows of one id: that of a digest of id and text."""
    import pyspark.sql.functions as F

    df = spark.createDataFrame([(key(i), t or "") for i, t in rows], "doc_id long, text string").withColumn("d", F.xxhash64("doc_id", "text"))
    known = {(r.doc_id, r.text): (r.doc_id, r.d) for r in df.collect()}
    return lambda i, t: known[key(i), t]


def removed(df, **kw):
    return sorted((key(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, **kw).collect())


ROUTES = [{}, {"heavy": 1e9}, {"chunk": 700}]


@pytest.mark.parametrize("route", ROUTES)
def test_suffix_dedup_odd_rows(spark, odd, odd_rows, route):
    assert removed(odd, **route) == brute_repeats(odd_rows, digest_order(spark, odd_rows))


@pytest.mark.parametrize("route", ROUTES)
def test_suffix_dedup_small_alphabet(spark, route):
    """Texts in which nearly everything repeats, at all offsets, and pieces of a long text."""
    rnd = random.Random(4)
    bits = ["".join(rnd.choice("ab") for _ in range(rnd.choice([5, 60, 101, 130]))) for _ in range(9)]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 12)))) for i in range(60)] + [(99, "z" * 1500), (100, "z\0" * 300)]
    assert removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), **route) == brute_repeats(rows)


def test_suffix_dedup_ids_that_repeat(spark):
    """Several null ids, and one id with several texts: each text is a document of its own."""
    rnd = random.Random(12)
    a, b, c = (prose(rnd, 60) for _ in range(3))
    rows = [(None, a + a), (None, b), (None, prose(rnd, 150)), (5, c + b), (5, prose(rnd, 90)), (5, prose(rnd, 20) + c), (7, c), (7, c), (None, b)]
    assert removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute_repeats(rows, digest_order(spark, rows))


def test_suffix_dedup_mirrored_neighbours(spark):
    """Contexts whose left parts look like other contexts' right parts, so that they sort between equal ones."""
    rnd = random.Random(13)
    rows, n = [], 0
    for _ in range(40):
        passage = "".join(rnd.choice("abcdefghij") for _ in range(100))
        for _ in range(2):
            rows.append((n, "".join(rnd.choice("xyz") for _ in range(rnd.randint(0, 90))) + passage + "".join(rnd.choice("uvw") for _ in range(rnd.randint(0, 90)))))
            n += 1
        data = np.frombuffer(passage.encode(), np.uint8)
        _, _, anchor, _, _ = suffix_dedup.anchors_of(data, np.zeros(1, np.int64), np.array([100]))
        q = int(anchor[0])
        for right in range(32, 100 - q, 9):  # the passage from the anchor, a shorter right part, then its mirror image to the left
            mirrored = passage[q + right :][::-1]
            rows.append((n, mirrored + passage[q : q + right]))
            rows.append((n + 1, ("k" * 100 + mirrored)[-100 + right :] + passage[q : q + right]))
            n += 2
    assert removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute_repeats(rows)


def test_loser_tree_and_front_code():
    rnd = random.Random(6)
    runs, everything = [], []
    for r in range(5):
        entries = sorted(("".join(rnd.choice("ab") for _ in range(rnd.randint(33, 60))).encode(), 33, r, 0, i) for i in range(rnd.randint(0, 30)))
        everything += entries
        runs.append(suffix_dedup.front_code(entries))
    merged = list(suffix_dedup.LoserTree([suffix_dedup.read_run(b) for b in runs]))
    assert [m[0] for m in merged] == [e[0] for e in sorted(everything)]
    for a, b in zip(merged, merged[1:]):
        assert b[1] == suffix_dedup.common_prefix(a[0], b[0], 0)


def test_empty_tables(none):
    assert exact_dedup.exact_dedup(none).count() == 0
    assert ngram_join.jaccard_components(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_ngram_join_shuffles_texts_of_clusters_only(spark, monkeypatch):
    """A sieve loses no wanted row, and texts that nothing is like never reach the join that deals them out."""
    rows = spark.range(20000).withColumn("row", F.xxhash64("id"))
    wanted = rows.where("id % 7 = 0").select("row")
    kept = {r.id for r in ngram_join.sieved(rows, wanted).collect()}
    assert kept >= set(range(0, 20000, 7)) and len(kept) < 1.05 * 20000 / 7
    assert ngram_join.sieved(rows, wanted.where("false")).count() == 0
    passed, plain = [], ngram_join.sieved

    def counted(rows, wanted):
        passed.append(plain(rows, wanted).count())
        return plain(rows, wanted)

    monkeypatch.setattr(ngram_join, "sieved", counted)
    docs = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(300)] + [(300, " ".join(f"w7x{k}" for k in range(30)) + " more")]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(300)} | {300: 7} and sum(passed) < 10
