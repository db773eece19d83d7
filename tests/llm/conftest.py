import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, shard int, score double, ids string, bucket int, label int"


def prose(rnd, words):
    return " ".join("".join(rnd.choice("aeioutnrsd") for _ in range(rnd.randint(1, 9))) + rnd.choice(["", "", "", ".", ",", "\n"]) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Texts with nulls, blanks, copies in another case, near copies, shared passages, a long one, and a repeated row."""
    rnd = random.Random(5)
    base, passage = prose(rnd, 120), prose(rnd, 60)
    words = base.split(" ")
    near = words.copy()
    near[60] = "changed"
    texts = [
        None, "", " \n\t ", "one two three", "ONE two Three", "stupid", base, base.upper(), base, " ".join(near), prose(rnd, 40) + passage + prose(rnd, 30), passage, prose(rnd, 20) + passage,
        "x" * 400, prose(rnd, 20_000), "Ünïcode ñandú 日本語 🙂 a  b\n\n c <|endoftext|> d", "é" * 130, "a b c d", "A B C D", "i'm we'll don't 12345 ½ ²", "aa<|startoftext|>bb " + "word." * 30,
    ]
    rows = [(i, t) for i, t in enumerate(texts, 3)]
    return [*rows, rows[6], (None, base), (None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), False, 1, 0.5, "x", 2, 3) for i, t in odd_rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
