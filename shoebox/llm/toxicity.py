"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two words counts the character triples that both hold in order, gaps allowed, each weighted by
DECAY to its span (spans up to SPAN); so `stu-pid`, `stuxpid` and `stupid` stay close. A word is read as its
letters between two edge marks; punctuation inside it falls out, and letters written apart with spaces are joined.

Training: labelled sentences are bags of words. Landmarks are words that tell the labels apart and common
clean words; rare ones count by the beginning that they share. Words are mapped to Nystroem features K(w, L) K(L, L)^-1/2 and a linear SVM (hinge loss) is
fitted in rounds: toxic texts are represented by words that they hold far oftener than clean ones, clean texts
by their common words and, from round to round, by those that score highest. As the triples are countable, the fitted machine collapses to one weight
for each triple, so scoring a word is a sum of table look-ups. A sentence scores as its worst word, a text as its worst
sentence; Platt's sigmoid makes it a probability.

Bounds: the fit uses at most SAMPLE rows of each label, those of the smallest hash, of at most SAMPLE_CHARS
characters. Scoring reads every text whole.

Defined results: null or empty text, or one without letters, gets the score of no evidence; null ids stay
null and never train; without any toxic or clean training row every score is 0; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bound_batches, claim, ids_and_texts, read_table, real_id

SPAN, DECAY, CLASSES = 6, 0.6, 64
SAMPLE, SAMPLE_CHARS = 3000, 20_000
LANDMARKS, ROUNDS, CALIBRATION, ODDS, HEAD = 320, 4, 4, 3.0, 4
WINDOW, STEP = 24, 8  # longer letter runs are scored by windows that share 16 letters: an insult and its inserted letters lie whole in one
MEMO = 500_000
APART = re.compile(r"(?<!\S)(?:\w[.\-_*]* ){3,}\w(?!\w)")
NOT_LETTERS = re.compile(r"[\W\d_]+")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")


def units(chunk: str) -> list[str]:
    """The letter runs of a chunk that the kernel reads."""
    word = chunk.lower()
    if not word.isalpha():
        word = NOT_LETTERS.sub("", word)
    if len(word) <= WINDOW:
        return [word] if word else []
    return [word[a : a + WINDOW] for a in range(0, len(word) - WINDOW + STEP, STEP)]


def chunks_of(text: str) -> set[str]:
    found = set(text.split())
    for run in APART.findall(text):
        found.add(run.replace(" ", ""))
    return found


def _classes(word: str) -> list[int]:
    return [0, *((c - 96) if 97 <= (c := ord(x)) <= 122 else 27 + c % 37 for x in word), 0]


_PAIRS = [(a, b) for b in range(2, SPAN + 1) for a in range(1, b)]


def triples(words: list[str]):
    """Yield (rows, codes, weight): for each gap pattern the words that have it, and their triples."""
    size = np.array([len(w) + 2 for w in words])
    grid = np.zeros((len(words), int(size.max()) + SPAN), np.int32)
    for i, w in enumerate(words):
        grid[i, : size[i]] = _classes(w)
    at = np.arange(grid.shape[1] - SPAN)
    for a, b in _PAIRS:
        rows, cols = np.nonzero(at[None, :] + b < size[:, None])
        yield rows, (grid[rows, cols] * CLASSES + grid[rows, cols + a]) * CLASSES + grid[rows, cols + b], DECAY**b


def norms(words: list[str]) -> np.ndarray:
    """The kernel's length normalisation: the root of the summed squared weights of a word's triples."""
    size = np.array([len(w) + 2 for w in words])
    total = np.zeros(len(words))
    for _, b in _PAIRS:
        total += np.maximum(size - b, 0) * DECAY ** (2 * b)
    return np.sqrt(np.maximum(total, 1e-12))


@dataclass
class Model:
    """The collapsed machine: a weight for each triple, the bias, and the sigmoid's slope and centre."""

    table: np.ndarray
    bias: float
    slope: float
    centre: float

    def words(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            total = np.zeros(len(part))
            for rows, codes, weight in triples(part):
                total += weight * np.bincount(rows, self.table[codes], len(part))
            out[at : at + len(part)] = total / norms(part)
        return out + self.bias

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * (margin - self.centre), -50, 50))))


NO_EVIDENCE = -2.0


def _kernel(words: list[str], table: dict[int, int], columns: np.ndarray) -> np.ndarray:
    """Kernel of words against landmarks whose triple weights are the columns' rows."""
    out = np.zeros((len(words), columns.shape[1]))
    known = np.full(CLASSES**3, len(columns) - 1, np.int64)
    for code, row in table.items():
        known[code] = row
    for at in range(0, len(words), 2048):
        part = words[at : at + 2048]
        for rows, codes, weight in triples(part):
            hit = known[codes]
            seen = hit < len(columns) - 1
            rows, hit = rows[seen], hit[seen]
            if len(rows):
                first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                out[at + rows[first]] += weight * np.add.reduceat(columns[hit], first, axis=0)
    return out / norms(words)[:, None]


def _landmark_table(landmarks: list[str]) -> tuple[dict[int, int], np.ndarray]:
    weights: dict[int, dict[int, float]] = {}
    for rows, codes, weight in triples(landmarks):
        for r, c in zip(rows.tolist(), codes.tolist()):
            weights.setdefault(c, {})[r] = weights.setdefault(c, {}).get(r, 0.0) + weight
    columns = np.zeros((len(weights) + 1, len(landmarks)))
    for i, row in enumerate(weights.values()):
        for r, v in row.items():
            columns[i, r] = v
    return {c: i for i, c in enumerate(weights)}, columns / norms(landmarks)


def _fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-5) -> tuple[np.ndarray, float]:
    """Squared hinge loss with 0.3 of the weight on toxic rows, by Newton steps on the active rows."""
    cost = np.where(y > 0, 0.3 * weight / max(1, weight[y > 0].sum()), 0.7 * weight / max(1, weight[y < 0].sum()))
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-9
    w, active = np.zeros(x.shape[1]), np.ones(len(x), bool)
    for _ in range(30):
        part, c = x[active], cost[active]
        w = np.linalg.solve(ridge + part.T @ (c[:, None] * part), part.T @ (c * y[active]))
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def _families(toxic: list[list[str]], clean: list[list[str]], known: set[str], in_clean: Counter) -> list[str]:
    """Words of toxic texts that hold no known one, too rare by themselves but with a beginning that such texts share."""
    heads = lambda bag: {w[:HEAD] for w in bag if len(w) > HEAD}
    left = [bag for bag in toxic if not known.intersection(bag)]
    in_left, in_rest = Counter(h for bag in left for h in heads(bag)), Counter(h for bag in clean for h in heads(bag))
    good = set()
    for h, n in in_left.items():
        rare = np.log((n - np.sqrt(n) + 0.5) / (len(left) + 1)) - np.log((in_rest[h] + 0.5) / (len(clean) + 1))
        if n >= 3 and rare > ODDS:
            good.add(h)
    return sorted({w for bag in left for w in bag if w[:HEAD] in good and len(w) > HEAD and not in_clean[w]})


def train(toxic: list[list[str]], clean: list[list[str]]) -> Model | None:
    """Fit on bags of words: toxic and clean texts as lists of their distinct units. One text in CALIBRATION
    is kept back from the machine and sets the sigmoid, so that words never seen before count."""
    if not toxic or not clean:
        return None
    kept_back = [x[::CALIBRATION] if len(x) >= 12 else x for x in (toxic, clean)]
    toxic, clean = ([b for i, b in enumerate(x) if i % CALIBRATION] if len(x) >= 12 else x for x in (toxic, clean))
    in_toxic, in_clean = Counter(w for bag in toxic for w in bag), Counter(w for bag in clean for w in bag)
    odds = {w: np.log((n - np.sqrt(n) + 0.5) / (len(toxic) + 1)) - np.log((in_clean[w] + 0.5) / (len(clean) + 1)) for w, n in in_toxic.items()}
    least = min(max(3, 0.004 * len(toxic)), len(toxic))
    telling = sorted((w for w in odds if odds[w] > ODDS and in_toxic[w] >= least), key=lambda w: (-in_toxic[w], w))
    telling += _families(toxic, clean, set(telling), in_clean)
    telling = telling or sorted(odds, key=lambda w: (-odds[w], w))[:5]
    landmarks = telling[: LANDMARKS // 2]
    common = [w for w, _ in sorted(in_clean.items(), key=lambda x: (-x[1], x[0])) if w not in set(landmarks)]
    landmarks += common[: LANDMARKS - len(landmarks)]
    table, columns = _landmark_table(landmarks)
    gram = _kernel(landmarks, table, columns)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    positives = telling[:2000]
    negatives = common[:3000]
    known = sorted(in_clean)
    model = None
    for _ in range(ROUNDS):
        words = positives + [w for w in negatives if w not in set(positives)]
        y = np.array([1.0] * len(positives) + [-1.0] * (len(words) - len(positives)))
        w, b = _fit_svm(_kernel(words, table, columns) @ root, y, weight=np.array([float(in_toxic[w]) if v > 0 else 1.0 for w, v in zip(words, y)]))
        weights = np.zeros(CLASSES**3)
        weights[list(table)] = columns[:-1] @ (root @ w)
        model = Model(weights, float(b), 1.0, 0.0)
        hardest = np.argsort(-model.words(known), kind="stable")[:3000]
        negatives = list(dict.fromkeys([*negatives, *(known[i] for i in hardest)]))
    back_toxic, back_clean = kept_back
    margins = model.words([w for bag in (*back_toxic, *back_clean) for w in bag])
    sizes = [len(bag) for bag in (*back_toxic, *back_clean)]
    ends = np.cumsum(sizes)
    best = np.array([margins[e - n : e].max() if n else NO_EVIDENCE for e, n in zip(ends, sizes)])
    model.slope, model.centre = _platt(best, np.array([1.0] * len(back_toxic) + [0.0] * len(back_clean)))
    return model


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope of a damped logistic fit; the centre is the margin with the best balanced accuracy."""
    order = np.argsort(x)
    xs, ys = x[order], y[order]
    pos, neg = max(1.0, ys.sum()), max(1.0, (1 - ys).sum())
    right = np.concatenate([[1.0], 1 - np.cumsum(ys) / pos]) + np.concatenate([[0.0], np.cumsum(1 - ys) / neg])
    right[1:-1][xs[1:] == xs[:-1]] = -1  # no cut between equal margins
    cut = int(np.argmax(right))
    low, high = xs[max(cut - 1, 0)], xs[min(cut, len(xs) - 1)]
    centre = float((low + high) / 2)
    slope = 4.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(slope * (x - centre), -50, 50)))
        gradient = ((y - p) * (x - centre)).sum() - 0.01 * slope
        curve = (p * (1 - p) * (x - centre) ** 2).sum() + 0.01
        slope = float(np.clip(slope + gradient / curve, 0.5, 20))
    return slope, centre


def held_out(col: str = "doc_id"):
    return F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> tuple[list, list]:
    """Bags of distinct units of the labelled, not held out rows: at most per_label of each label."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out())
    order = F.xxhash64("doc_id")
    chosen = [usable.where(F.col("toxic") == t).orderBy(order, "doc_id").limit(per_label) for t in (1, 0)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * per_label rows
    rows = ids_and_texts(docs).where(F.length("text") <= SAMPLE_CHARS).join(few, "doc_id").select("toxic", "text").distinct().collect()
    bags = {1: [], 0: []}
    for r in sorted(rows, key=lambda r: (r["toxic"], r["text"])):
        # the bag of a text is the union of the bags of its sentences
        bags[r["toxic"]].append(sorted({u for s in SENTENCE_END.split(r["text"]) for c in chunks_of(s) for u in units(c)}))
    return bags[1], bags[0]


_memo: dict[str, float] = {}
_memo_of: list = [None]


def _forget() -> None:
    _memo.clear()
    _memo_of[0] = None


def _score_texts(model: Model | None, texts: list[str]) -> list[float]:
    if model is None:
        return [0.0] * len(texts)
    claim("toxicity", _forget)
    if _memo_of[0] is not model:
        _memo.clear()
        _memo_of[0] = model
    scores = []
    for text in texts:
        found = chunks_of(text)
        fresh = [c for c in found if c not in _memo]
        if fresh:
            if len(_memo) > MEMO:
                _memo.clear()
                fresh = list(found)
            _remember(model, fresh)
        best = max(map(_memo.__getitem__, found), default=NO_EVIDENCE)
        scores.append(round(model.probability(best), 9))
    return scores


def score_column(spark: SparkSession, model: Model | None, text_col: str = "text"):
    """The score as a column, so that a filter needs no join."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(_score_texts(shared.value, texts.tolist()), dtype="float64")

    return score(F.coalesce(F.col(text_col), F.lit("")))


def _remember(model: Model, chunks: list[str]) -> None:
    words, owner = [], []
    for i, c in enumerate(chunks):
        for u in units(c):
            words.append(u)
            owner.append(i)
    best = np.full(len(chunks), NO_EVIDENCE)
    if words:
        np.maximum.at(best, owner, model.words(words))
    _memo.update(zip(chunks, best.tolist()))


def score_toxicity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    out = ids_and_texts(docs, id_col, text_col)
    bound_batches(docs.sparkSession)
    out = out.select("doc_id", score_column(docs.sparkSession, model).alias("score"))
    return out.select(real_id().alias("doc_id"), F.coalesce(held_out() & real_id().isNotNull(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    return train(*training_sample(docs, labels))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, read_table(spark, sf_dir, "labels")))


SQL: dict = {}
QUERIES = {"op10_toxicity": op10_toxicity}
