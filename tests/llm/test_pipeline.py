"""The pipeline's stages against brute force, each on its own input."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from shoebox.operators.scratch import materialise, noted

from .conftest import prose
from .test_dedup import LOW, brute_repeats, key, linked

DATA = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def rows_of(df):
    assert df.columns == p.COLUMNS
    return [(r.doc_id, r.text) for r in df.collect()]


def low(text):
    return (text or "").translate(LOW)


def test_exact_copies(spark, odd_rows):
    rows = [*odd_rows, (None, "only here"), (5, "another text of an id"), (5, "another text of an id")]
    best = {}
    for i, t in rows:
        best[low(t)] = max(key(i), best.get(low(t), key(None)))
    got = [(key(i), low(t)) for i, t in rows_of(p.exact_copies(spark, docs_of(spark, rows), None))]
    assert sorted(got) == sorted((i, t) for t, i in best.items())


def test_near_copies(spark, odd_rows):
    rows = list(dict([r for r in odd_rows if r[0] is not None]).items())
    got = rows_of(p.near_copies(spark, docs_of(spark, rows), None))
    assert sorted(i for i, _ in got) == [i for i, _, c in linked(rows) if i == c]


def test_ids_that_repeat(spark):
    """Three rows, two with one id and different texts: a stage that changes nothing returns three."""
    rnd = random.Random(3)
    rows = [(5, prose(rnd, 40)), (5, prose(rnd, 50)), (None, prose(rnd, 40)), (None, prose(rnd, 30)), (6, prose(rnd, 40))]
    for stage in (p.exact_copies, p.near_copies, p.repeated_passages):
        assert sorted(rows_of(stage(spark, docs_of(spark, rows), None)), key=str) == sorted(rows, key=str)


def test_repeated_passages(spark):
    rnd = random.Random(8)
    passage = prose(rnd, 60)
    rows = [(1, prose(rnd, 30) + passage), (2, passage + prose(rnd, 30)), (3, passage), (4, None), (5, ""), (6, "é" * 49 + "short"), (7, "é" * 300)]
    want = {i: kept.decode("utf-8", "ignore") for i, n, gone, _, kept in brute_repeats(rows) if n == 0 or gone < n}
    got = dict(rows_of(p.repeated_passages(spark, docs_of(spark, rows), None)))
    assert got.pop(4) is None and want.pop(4) == "" and got == want and 3 not in got and got[6] == rows[5][1]


def test_toxic_documents_go(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(i, prose(rnd, 30) + (" you moron " if i % 4 == 0 else " ") + prose(rnd, 5)) for i in range(400)]
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {i for i, _ in rows_of(p.toxicity(spark, docs_of(spark, rows), str(tmp_path)))}
    assert sum(i % 4 == 0 for i in kept) <= 2 and sum(i % 4 > 0 for i in kept) >= 290


@pytest.mark.skipif(not os.path.isdir(DATA), reason="fixture tables are not here")
def test_run_and_empty_table(spark, none, tmp_path):
    rows = p.run(spark, DATA).collect()
    assert rows and {r.length > 0 for r in rows} == {True}
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for top in folders for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}


def test_shuffle_files_go_with_their_query(spark):
    """A table that is written needs no shuffle files any more, whether or not the driver collects its garbage."""
    before = shuffle_files(spark)
    counted = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    assert materialise(counted, "no-files").count() == 10
    names = {f.split("_")[1] for f in shuffle_files(spark) - before}
    assert len(names) <= 1  # that of the count above, which isn't written


def test_near_copies_shuffles_few_texts(spark, monkeypatch):
    """Documents that stay aren't dealt out; null ids, ids of several texts and repeated rows are judged as before."""
    rnd = random.Random(12)
    base = [f"w{k}" for k in range(60)]
    rows = [(i, prose(rnd, 40)) for i in range(300)] + [(300, " ".join(base)), (7, " ".join([*base[:59], "x"])), (7, prose(rnd, 30)), (None, " ".join(["y", *base[1:]])), (301, " ".join(base)), (301, "")]
    seen, plain = [], p.sieve

    def counted(gone):
        suspect = plain(gone)
        keyed = docs_of(spark, rows).withColumn("row", F.xxhash64(F.coalesce("doc_id", F.lit(p.NULL_ID)), F.coalesce("text", F.lit(""))))
        seen.append(keyed.where(suspect).count())
        return suspect

    monkeypatch.setattr(p, "sieve", counted)
    got = rows_of(p.near_copies(spark, docs_of(spark, rows), None))
    # the null id ranks first and stands for its component
    assert sorted(got, key=str) == sorted([*rows[:300], rows[302], rows[303], rows[305]], key=str) and 3 <= seen[0] < 10


@pytest.mark.skipif(not os.path.isdir(DATA), reason="fixture tables are not here")
def test_run_leaves_one_table(spark):
    with noted() as made:
        p.run(spark, DATA)
    assert len(made) == 1 and "pipeline-suffix_dedup" in made[0]
