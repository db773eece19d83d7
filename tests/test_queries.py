"""Every registered query of the library against its SQL twin."""

import os

import numpy as np
import pytest

from shoebox.plans import registry

from .conftest import DATA, plain

QUERIES, SQL = registry.load()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="fixture tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, f"{DATA}/sf0.001")
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    found = duck.execute(SQL[name])
    order = [[x[0] for x in found.description].index(c) for c in names]
    want = sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
    assert got == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="fixture tables are not here")
def test_nfc_reads_whole_texts(spark):
    rows = QUERIES["nfc_text"](spark, f"{DATA}/sf0.001").collect()
    assert max(len(r.composed) for r in rows if r.composed) > 40


@pytest.mark.skipif(not os.path.isdir(DATA), reason="fixture tables are not here")
def test_hamming_hex_compares_all_bits(spark):
    """Some pairs differ in the last 16 of the 64 bits, and some signatures have the top bit set."""
    whole, short = ({(r.a, r.b): r.distance for r in QUERIES[q](spark, f"{DATA}/sf0.001").collect()} for q in ("hamming_hex64", "hamming_hex"))
    assert whole.keys() == short.keys() and any(whole[k] > short[k] for k in whole) and all(whole[k] >= short[k] for k in whole)


NEARLY_WHOLE = ["pixel_analysis", "pixel_grey", "pixel_quality"]


@pytest.mark.parametrize("name", NEARLY_WHOLE)
def test_pixels_of_nearly_whole_products(spark, tmp_path, name):
    """Floats whose product with 2000 is whole in their own type and just below that as doubles."""
    import duckdb

    near = [float(x) for k in range(1, 2000) if np.floor(float(x := np.float32(k / 2000)) * 2000) < np.floor(x * np.float32(2000))]
    rows = [(i, near[i * 7 : i * 7 + 64]) for i in range(20)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})").fetchall()
    assert len(want) == 20 and sorted(tuple(r) for r in got.collect()) == sorted(want)
