"""Language identification by Bayesian evidence fusion.

For a record with text, markup language, address and host the posterior of language l is

    log P(l) is the host prior, plus  text likelihood (temper * sum of log P(feature | l))
             + log P(declared | l) + log P(address code | l)

- *Text:* words and character trigrams at word edges, hashed to SLOTS slots for each language, add-one smoothed counts of all
  labelled texts by grouped aggregation; the sum is tempered, as neighbouring features aren't independent.
- *Declared language* (`<html lang>`), *address code* (a country ending of the host or a language code as a
  path part): their reliabilities are learned as confusion counts against the text-only decisions.
- *Host prior:* a grouped count of text-only decisions by host, smoothed towards its domain, that towards
  its ending, that towards the whole corpus (each level adds STRENGTH pseudo-counts of the level above).

All counts cover all rows and all features and are exact, however rows are dealt; features that share a slot share its count. The table of
weights is languages x SLOTS numbers of four bytes whatever the input (2 MB a language): it is collected and broadcast. Host counts stay
distributed and are joined. A slot that no labelled text fills is no evidence. Texts are read whole; a page's text is its
html without markup, scripts and styles.

Defined results: null or empty text gives no text evidence, so the priors decide; a null address gives no host and
the corpus prior; null ids stay null; labels outside the label table's languages can't arise; without any labelled text
every language is null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, bound_batches, claim, materialise, read_table

SLOTS, RANGES = 1 << 19, 256  # slots of the feature table, and the ranges of slots by which counts are dealt
TEMPER, STRENGTH, RELIABILITY = 0.2, 4.0, 2.0
MEMO = 300_000
WORD = re.compile(r"[^\W\d_]+")
MARKUP = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
ENTITY = re.compile(r"&#?\w+;")


def features(word: str) -> list[str]:
    """A word, and its first and last three characters."""
    return [word, "^" + word[:3], word[-3:] + "$"] if len(word) > 3 else [word]


def slots_of(word: str) -> list[int]:
    return [zlib.crc32(f.encode()) % SLOTS for f in features(word)]


def page_text(html: str) -> str:
    return ENTITY.sub(" ", MARKUP.sub(" ", html))


@dataclass
class TextModel:
    languages: list[str]
    weights: np.ndarray  # slots x languages: log P(slot | language), centred over languages; zeros where no text fills the slot


def _feature_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, part, blob): exact counts of the slots of one range, once for each language and range that has any."""

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}

        def fold():
            words_clean(words)
            for lang, seen in words.items():
                own = counts.setdefault(lang, np.zeros(SLOTS, np.int64))
                pairs = [(slot, n) for w, n in seen.items() for slot in slots_of(w)]
                if pairs:
                    slots, n = np.array(pairs, np.int64).T
                    np.add.at(own, slots, n)
            words.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.setdefault(lang, Counter()).update(text.lower().split())
            if sum(map(len, words.values())) > MEMO:
                fold()
        fold()
        yield from _ranges(counts)

    def add(batches):
        key, total = None, None
        for batch in batches:
            for lang, part, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if (lang, part) != key:
                    if key is not None:
                        yield _blob_rows([(*key, total)])
                    key, total = (lang, part), np.zeros(SLOTS // RANGES, np.int64)
                slots, n = np.frombuffer(zlib.decompress(blob), np.int64).reshape(2, -1)
                total[slots] += n
        if key is not None:
            yield _blob_rows([(*key, total)])

    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    rows = "lang string, part int, blob binary"
    return arrow_map(arrow_map(labelled, count, rows).repartition("lang", "part").sortWithinPartitions("lang", "part"), add, rows)


def _blob_rows(rows):
    """(lang, part, counts of a range) as rows that hold the filled slots."""
    packed = [zlib.compress(np.stack([at := np.flatnonzero(n), n[at]]).tobytes(), 1) for _, _, n in rows]
    return pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array(packed, pa.binary())], names=["lang", "part", "blob"])


def _ranges(counts: dict[str, np.ndarray]):
    for lang, own in counts.items():
        # a language whose texts hold no feature still sends its first range, so that it is known
        filled = [(lang, part, n) for part, n in enumerate(own.reshape(RANGES, -1)) if n.any() or not part]
        yield _blob_rows(filled)


def words_clean(words: dict[str, Counter]) -> None:
    """Chunks to the letter words in them."""
    for lang, seen in words.items():
        clean: Counter = Counter()
        for chunk, n in seen.items():
            for w in [chunk] if chunk.isalpha() else WORD.findall(chunk):
                clean[w] += n
        words[lang] = clean


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> TextModel:
    """Add-one smoothed likelihoods of all slots, from all labelled texts."""
    found = _feature_counts(docs, text_col, lang_col).collect()  # at most languages x RANGES rows, see the module's bound
    languages = sorted({r["lang"] for r in found})
    counts = np.zeros((len(languages), SLOTS), np.int64)
    width = SLOTS // RANGES
    for r in found:
        slots, n = np.frombuffer(zlib.decompress(r["blob"]), np.int64).reshape(2, -1)
        counts[languages.index(r["lang"]), r["part"] * width + slots] = n
    return TextModel(languages, weights_of(counts))


def weights_of(counts: np.ndarray) -> np.ndarray:
    """Languages x slots counts to slots x languages weights."""
    if not len(counts):
        return np.zeros((SLOTS, 0), np.float32)
    filled = counts.any(axis=0)
    logs = np.log((counts + 1) / (counts.sum(axis=1, keepdims=True) + filled.sum()))
    return np.where(filled, logs - logs.mean(axis=0), 0.0).T.astype(np.float32)


_memo: dict[str, np.ndarray] = {}
_memo_of: list = [None]


def _forget() -> None:
    _memo.clear()
    _memo_of[0] = None


def text_logs(model: TextModel, texts: list[str]) -> np.ndarray:
    """Texts x languages: the tempered sums of the weights of their features."""
    claim("language_id", _forget)
    if _memo_of[0] is not model:
        _memo.clear()
        _memo_of[0] = model
    out = np.zeros((len(texts), len(model.languages)))
    for i, text in enumerate(texts):
        counts = Counter(text.lower().split())
        if not counts:
            continue
        fresh = [c for c in counts if c not in _memo]
        if fresh:
            if len(_memo) > MEMO:
                _memo.clear()
                fresh = list(counts)
            _remember(model, fresh)
        out[i] = np.fromiter(counts.values(), float, len(counts)) @ np.array([_memo[c] for c in counts])
    return out * TEMPER


def _remember(model: TextModel, chunks: list[str]) -> None:
    slots, owner = [], []
    for i, chunk in enumerate(chunks):
        for word in [chunk] if chunk.isalpha() else WORD.findall(chunk):
            own = slots_of(word)
            slots += own
            owner += [i] * len(own)
    sums = np.zeros((len(chunks), len(model.languages)))
    np.add.at(sums, owner, model.weights[slots].astype(float))
    _memo.update(zip(chunks, sums))


def evidence(records: DataFrame, model: TextModel) -> DataFrame:
    """records (key, text, is_html, declared, address, host) with `text_logs`, the text's log likelihoods, in place of the text."""
    shared = records.sparkSession.sparkContext.broadcast(model)  # 4 * SLOTS bytes for each language
    bound_batches(records.sparkSession)

    @F.pandas_udf("array<double>")
    def read(texts: pd.Series, html: pd.Series) -> pd.Series:
        found = text_logs(shared.value, [page_text(t) if h else t for t, h in zip(texts.tolist(), html.tolist())])
        return pd.Series(list(found), dtype=object)

    return records.withColumn("text_logs", read(F.coalesce("text", F.lit("")), "is_html")).drop("text", "is_html")


#: Two-letter codes of countries whose common language has another code.
COUNTRY_LANGUAGE = {"uk": "en", "us": "en", "at": "de", "mx": "es", "ar": "es"}


def address_code(url, languages: list[str]):
    """A language told by the address: a path part or else the host's ending."""
    codes = F.array(*[F.lit(c) for c in languages])
    parts = F.split(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)), "/")
    in_path = F.get(F.filter(parts, lambda p: F.array_contains(codes, p)), 0)
    ending = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#:]*\.([a-zA-Z]{2})(?:[:/?#]|$)", 1))
    pairs = [x for k, v in COUNTRY_LANGUAGE.items() for x in (F.lit(k), F.lit(v))]
    mapped = F.coalesce(F.element_at(F.create_map(*pairs), ending), ending)
    return F.coalesce(in_path, F.when(F.array_contains(codes, mapped), mapped))


def host_of(url):
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]+)", 1))
    return F.when(host != "", host)


def _argmax(logs, languages: list[str]):
    codes = F.array(*[F.lit(c) for c in languages])
    return F.element_at(codes, F.array_position(logs, F.array_max(logs)).cast("int"))


def _table(counts: dict, rows: list[str], columns: list[str]):
    """log P(row value | language) for each row value: a map column of arrays over languages."""
    pairs = []
    for r in rows:
        logs = []
        for c in columns:
            total = sum(counts.get((x, c), 0) for x in rows)
            # one agreeing pseudo-count more: a code means its language until the counts say otherwise
            n = counts.get((r, c), 0) + (RELIABILITY if r == c else 0) + 0.5
            logs.append(float(np.log(n / (total + RELIABILITY + 0.5 * len(rows)))))
        pairs += [F.lit(r), F.array(*[F.lit(x) for x in logs])]
    return F.create_map(*pairs)


def identify(records: DataFrame, model: TextModel) -> DataFrame:
    """records: key columns plus text, is_html, declared, url, host. Result: the keys, lang, probability,
    text_lang, declared, address_lang, host."""
    languages = model.languages
    keys = [c for c in records.columns if c not in ("text", "is_html", "declared", "url", "host")]
    if not languages:
        return records.select(*keys, F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), "declared", F.lit(None).cast("string").alias("address_lang"), "host")
    codes = F.array(*[F.lit(c) for c in languages])
    seen = evidence(records.withColumn("address_lang", address_code(F.col("url"), languages)).drop("url"), model)
    seen = seen.withColumn("has_text", F.array_max("text_logs") > F.array_min("text_logs"))
    seen = seen.withColumn("text_lang", F.when(F.col("has_text"), _argmax(F.col("text_logs"), languages))).withColumn("declared", F.when(F.array_contains(codes, F.col("declared")), F.col("declared")))
    seen = materialise(seen, "lang-evidence")

    def confusion(column: str) -> dict:
        rows = seen.where(f"{column} IS NOT NULL AND text_lang IS NOT NULL").groupBy(column, "text_lang").agg(F.count("*").alias("n")).collect()
        return {(r[0], r[1]): r[2] for r in rows}  # languages x languages

    declared, address = (_table(confusion(c), languages, languages) for c in ("declared", "address_lang"))
    whole = {r[0]: r[1] for r in seen.where("text_lang IS NOT NULL").groupBy("text_lang").agg(F.count("*").alias("n")).collect()}
    total = sum(whole.values())
    corpus = [(whole.get(c, 0) + 1) / (total + len(languages)) for c in languages]
    host = F.coalesce("host", F.lit(""))
    by_language = [F.sum(F.when(F.col("text_lang") == c, 1).otherwise(0)) for c in languages]
    hosts = seen.groupBy(host.alias("h")).agg(F.array(*by_language).alias("n_host"))
    hosts = materialise(hosts.withColumn("d", F.regexp_extract("h", r"([^.]+\.[^.]+)$", 1)).withColumn("e", F.regexp_extract("h", r"([^.]+)$", 1)), "lang-hosts")

    def added(level: str, name: str) -> DataFrame:
        return hosts.groupBy(level).agg(F.array(*[F.sum(F.get("n_host", i)) for i in range(len(languages))]).alias(name))

    def smoothed(counts, above):
        n = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
        return F.zip_with(counts, above, lambda x, p: (x + STRENGTH * p) / (n + STRENGTH))

    prior = hosts.join(added("d", "n_domain"), "d").join(added("e", "n_ending"), "e")
    prior = prior.withColumn("p", smoothed(F.col("n_ending"), F.array(*[F.lit(float(x)) for x in corpus])))
    prior = prior.withColumn("p", smoothed(F.col("n_domain"), F.col("p"))).withColumn("p", smoothed(F.col("n_host"), F.col("p"))).select("h", "p")
    nothing = F.array(*[F.lit(0.0)] * len(languages))
    out = seen.withColumn("h", host).join(prior, "h", "left")
    out = out.withColumn("logs", F.zip_with(F.coalesce("text_logs", nothing), F.coalesce(F.transform("p", lambda x: F.log(x)), nothing), lambda a, b: a + b))
    for column, table in (("declared", declared), ("address_lang", address)):
        out = out.withColumn("logs", F.zip_with("logs", F.coalesce(F.element_at(table, F.col(column)), nothing), lambda a, b: a + b))
    top = F.array_max("logs")
    share = 1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return out.select(*keys, _argmax(F.col("logs"), languages).alias("lang"), F.round(share, 6).alias("probability"), "text_lang", "declared", "address_lang", "host")


def page_records(pages: DataFrame) -> DataFrame:
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-zA-Z]{2})", 1))
    return pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), F.col("html").alias("text"), F.lit(True).alias("is_html"), declared.alias("declared"), F.col("url").alias("url"), host_of(F.col("url")).alias("host"))


def document_records(docs: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.col("text").alias("text"), F.lit(False).alias("is_html"), nothing.alias("declared"), nothing.alias("url"), F.col("source").cast("string").alias("host"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document (its source is its host) and every page."""
    docs, pages = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "pages")
    return identify(document_records(docs).unionByName(page_records(pages)), train(docs))


SQL: dict = {}
QUERIES = {"op2_language_id": op2_language_id}
