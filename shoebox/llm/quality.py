"""Quality by ordinal cumulative-link regression on graded ratings over hashed text.

P(grade <= k | text) = sigmoid(theta_k - w . x), theta_0 < theta_1 < ...: one weight vector shared by all
grades, ordered thresholds. x are hashed features of the text's words: the lower-cased word, its shape
(runs of capitals, small letters, digits, marks), each averaged over the words, and how much of the text
repeats itself. The result is the expected grade and the tail probability P(grade >= threshold), by which
documents are kept.

Bounds: the fit uses at most SAMPLE rated rows of each grade, those of the smallest hash. Scoring reads every text whole;
a word's weight is looked up once and remembered.

Defined results: null or empty text has no words and gets the lowest grade; null ids stay null and never train; without
ratings of two grades every result is null and the row is kept; repeated rows repeat; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, bound_batches, claim, ids_and_texts, read_table, real_id

SLOTS, SAMPLE, MEMO = 1 << 14, 3000, 400_000
REPEAT_BINS, WORD_SHARE = 8, 0.5


def _kind(c: str) -> str:
    return "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c


def shape(word: str) -> str:
    return "".join(k for k, _ in groupby(map(_kind, word)))


def word_slots(word: str) -> tuple[int, int]:
    return zlib.crc32(b"w" + word.lower().encode()) % SLOTS, zlib.crc32(b"s" + shape(word).encode()) % SLOTS


def repeat_slot(words: int, distinct: int) -> int:
    """Share of words met before, in bins that also tell short texts from long ones."""
    if not words:
        return SLOTS
    return SLOTS + 1 + min(REPEAT_BINS - 1, int(REPEAT_BINS * (1 - distinct / words))) * 2 + (words >= 40)


WIDTH = SLOTS + 1 + 2 * REPEAT_BINS + 1


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sparse x of a text: (slots, values)."""
    counts = Counter(text.split())
    n = sum(counts.values())
    x: Counter = Counter()
    for word, k in counts.items():
        w, s = word_slots(word)
        x[w] += WORD_SHARE * k / n
        x[s] += k / n
    x[repeat_slot(n, len(counts))] += 1.0
    return np.fromiter(x.keys(), np.int64, len(x)), np.fromiter(x.values(), float, len(x))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    values: np.ndarray  # the rating that each grade stands for, in order

    def grades(self, score: float) -> np.ndarray:
        """Probability of each grade at w . x = score."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds - score, -40, 40)))
        return np.diff(np.r_[0.0, below, 1.0])


def train(slots: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, rounds: int = 400, penalty: float = 1e-4) -> Model | None:
    """Maximum penalised likelihood with grades weighted equally, by Adam steps; thresholds stay ordered because
    their gaps are exponentials. The grades are the different ratings met, in order."""
    kinds, grade = np.unique(grades, return_inverse=True)
    k = len(kinds)
    if k < 2:
        return None
    cost = 1.0 / np.bincount(grade, minlength=k).clip(1)[grade]
    cost /= cost.sum()
    rows = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    cols, vals = np.concatenate(slots), np.concatenate(values)
    w, base, gaps = np.zeros(WIDTH), -1.0, np.zeros(k - 2)
    state = [[np.zeros(WIDTH + k - 1), np.zeros(WIDTH + k - 1)]]
    for t in range(1, rounds + 1):
        theta = base + np.r_[0.0, np.cumsum(np.exp(gaps))]
        score = np.bincount(rows, vals * w[cols], len(slots))
        edges = np.c_[np.full(len(score), -np.inf), theta[None, :] - score[:, None], np.full(len(score), np.inf)]
        cdf = 1 / (1 + np.exp(-np.clip(edges, -40, 40)))
        slope = cdf * (1 - cdf)
        slope[:, [0, -1]] = 0
        at = np.arange(len(score))
        p = np.maximum(cdf[at, grade + 1] - cdf[at, grade], 1e-9)
        up, low = cost * slope[at, grade + 1] / p, cost * slope[at, grade] / p
        d_score = up - low  # derivative of -log p by the score
        g_w = np.bincount(cols, vals * d_score[rows], WIDTH) + penalty * w
        d_theta = np.array([low[grade == j + 1].sum() - up[grade == j].sum() for j in range(k - 1)])
        g_gaps = np.array([d_theta[j + 1 :].sum() for j in range(k - 2)]) * np.exp(gaps)
        g = np.r_[g_w, d_theta.sum(), g_gaps]
        m, v = state[0]
        m[:] = 0.9 * m + 0.1 * g
        v[:] = 0.999 * v + 0.001 * g * g
        step = 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) / np.sqrt(1 + t / 50)
        w, base, gaps = w - step[:WIDTH], base - step[WIDTH], gaps - step[WIDTH + 1 :]
    return Model(w, base + np.r_[0.0, np.cumsum(np.exp(gaps))], kinds)


def training_sample(docs: DataFrame, ratings: DataFrame, per_grade: int = SAMPLE):
    """Sparse vectors and grades of at most per_grade rows of each grade (ratings: doc_id, grade)."""
    usable = ratings.where("doc_id IS NOT NULL AND grade IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade"))
    grades = [r["grade"] for r in usable.select("grade").distinct().orderBy("grade").collect()]
    if not grades:
        return [], [], np.zeros(0, int)
    chosen = None
    for g in grades:
        some = usable.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_grade)
        chosen = some if chosen is None else chosen.unionByName(some)

    def run(batches):
        for batch in batches:
            rows = [(g, *vector(t)) for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            if rows:
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["grade", "slots", "values"])

    found = ids_and_texts(docs).join(F.broadcast(chosen), "doc_id").select("grade", "text")  # at most grades * per_grade rows
    rows = arrow_map(found, run, "grade int, slots array<long>, values array<double>").toPandas()
    return [np.array(s, np.int64) for s in rows["slots"]], [np.array(v, float) for v in rows["values"]], rows["grade"].to_numpy(int)


_memo: dict[str, float] = {}
_memo_of: list = [None]


def _scores(model: Model, texts: list[str]) -> list[float]:
    claim("quality", _memo.clear)
    if _memo_of[0] is not model:
        _memo.clear()
        _memo_of[0] = model
    weights, out = model.weights, []
    for text in texts:
        words = text.split()
        distinct = set(words)
        fresh = [w for w in distinct if w not in _memo]
        if fresh:
            if len(_memo) > MEMO:
                _memo.clear()
                fresh = distinct
            for w in fresh:
                a, b = word_slots(w)
                _memo[w] = float(WORD_SHARE * weights[a] + weights[b])
        n = len(words)
        total = sum(map(_memo.__getitem__, words))
        out.append((total / n if n else 0.0) + float(weights[repeat_slot(n, len(distinct))]))
    return out


def grade_documents(docs: DataFrame, model: Model | None, at_least: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, tail_probability (of at_least or better) and keep for each row."""
    source = ids_and_texts(docs, id_col, text_col)
    if model is None:
        return source.select(real_id().alias("doc_id"), F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"), F.lit(True).alias("keep"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bound_batches(docs.sparkSession)

    @F.pandas_udf("expected double, tail double")
    def grade(texts: pd.Series) -> pd.DataFrame:
        found = texts.tolist()
        p = np.array([shared.value.grades(s) for s in _scores(shared.value, found)]).reshape(len(found), -1)
        p[[not t.split() for t in found]] = np.eye(p.shape[1])[0] if p.shape[1] else 0
        values = shared.value.values
        return pd.DataFrame({"expected": (p @ values).round(6), "tail": p[:, values >= at_least].sum(axis=1).round(6)})

    out = source.withColumn("g", grade("text"))
    return out.select(real_id().alias("doc_id"), F.col("g.expected").alias("expected_grade"), F.col("g.tail").alias("tail_probability"), (F.col("g.tail") >= 0.5).alias("keep"))


def label_ratings(labels: DataFrame) -> DataFrame:
    """Grades of `labels`: 0 junk, 1 good writing that is toxic, 2 good and clean."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2).alias("grade"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return grade_documents(docs, train(*training_sample(docs, label_ratings(labels))))


SQL: dict = {}
QUERIES = {"op6_quality": op6_quality}
