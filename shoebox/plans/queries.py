"""The library's operators over the driver's fixture tables, with their SQL twins.

Documents stand for files (path from source, language and id; bytes are the text; removed where labelled toxic), embeddings
for signatures, events for capture times and the action log, line items for quality metrics, orders for dates and snapshots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import dates, paths, signature
from ..operators import bestshot, classify, dedup, graph, merge, organize, protect, reports, similarity
from ..schema import active
from .registry import query

AS_OF = "2030-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id", "left")
    return rows.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("removed"),
        F.lit(False).alias("missing"),
        F.when(F.col("quality").isNotNull(), F.substring(F.sha2("text", 256), 1, 16)).alias("phash"),
        F.col("lang").alias("category"),
        F.lit(0.5).alias("category_confidence"),
        F.when(F.col("quality") == 0, "error").otherwise("discovered").alias("scan_status"),
        F.lit(None).cast("string").alias("thumb_path"),
        F.lit(None).cast("double").alias("exif_dt"),
        "text",
    )


FILES = """files AS (SELECT d.doc_id AS id, '/lib/' || d.source || '/' || d.lang || '/' || d.doc_id || '.txt' AS path,
    CAST(strlen(d.text) AS BIGINT) AS size, coalesce(l.toxic = 1, false) AS removed, false AS missing,
    CASE WHEN l.quality IS NOT NULL THEN sha256(d.text)[1:16] END AS phash, d.lang AS category,
    CASE WHEN l.quality = 0 THEN 'error' ELSE 'discovered' END AS scan_status, d.text
    FROM documents d LEFT JOIN labels l USING (doc_id)), active AS (SELECT * FROM files WHERE NOT removed AND NOT missing)"""
DUPLICATES = FILES + """, hashed AS (SELECT id, path, size, sha256(text) AS content_hash FROM active WHERE size > 0),
    keys AS (SELECT content_hash, min(id) AS first, arg_min(id, (length(path), path)) AS best FROM hashed GROUP BY 1 HAVING count(*) > 1),
    numbered AS (SELECT *, row_number() OVER (ORDER BY first) AS group_id FROM keys),
    dups AS (SELECT group_id, id AS file_id, id = best AS is_representative, content_hash, path, size FROM hashed JOIN numbered USING (content_hash))"""


# --- byte-identical files -------------------------------------------------------------------------------


@query("dup_size_candidates", f"WITH {FILES} SELECT id, path, size FROM active WHERE size > 0 AND size IN (SELECT size FROM active WHERE size > 0 GROUP BY size HAVING count(*) > 1)")
def dup_size_candidates(spark, sf_dir):
    return dedup.size_candidates(active(files(spark, sf_dir))).select("id", "path", "size")


def _duplicates(spark, sf_dir, prefilter=True):
    quick = F.sha2(F.substring(F.encode("text", "UTF-8"), 1, 256), 256)
    found = dedup.find_duplicates(active(files(spark, sf_dir)), quick, F.sha2("text", 256), prefilter)
    return dedup.group_duplicates(found)


@query("dup_exact_groups", f"WITH {DUPLICATES} SELECT * FROM dups")
def dup_exact_groups(spark, sf_dir):
    return _duplicates(spark, sf_dir)


@query("dup_prefilter_off", f"WITH {DUPLICATES} SELECT * FROM dups")
def dup_prefilter_off(spark, sf_dir):
    return _duplicates(spark, sf_dir, prefilter=False)


@query("dup_quick_hash", "SELECT doc_id AS id, sha256(array_slice(encode(text), 1, 256)) AS quick_hash FROM documents")
def dup_quick_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.substring(F.encode("text", "UTF-8"), 1, 256), 256).alias("quick_hash"))


@query("dup_redundant_total", f"WITH {DUPLICATES} SELECT count(DISTINCT group_id) AS groups, count(*) - count(DISTINCT group_id) AS redundant FROM dups")
def dup_redundant_total(spark, sf_dir):
    return dedup.redundant(_duplicates(spark, sf_dir))


@query("dup_report", f"WITH {DUPLICATES} SELECT group_id, CASE WHEN is_representative THEN '대표' ELSE '' END AS is_representative, size, content_hash, path FROM dups")
def dup_report(spark, sf_dir):
    groups = _duplicates(spark, sf_dir)
    rows = files(spark, sf_dir).withColumn("content_hash", F.sha2("text", 256))
    return reports.duplicate_report(groups.select("group_id", "file_id", "is_representative"), rows)


@query("dup_group_heads", f"WITH {DUPLICATES} SELECT group_id, file_id, row_number() OVER (PARTITION BY group_id ORDER BY is_representative DESC, path) = 1 AS is_head FROM dups")
def dup_group_heads(spark, sf_dir):
    return reports.group_heads(_duplicates(spark, sf_dir), F.desc("is_representative"), "path").select("group_id", "file_id", "is_head")


@query("dup_view_extras", f"WITH {DUPLICATES} SELECT file_id FROM dups WHERE NOT is_representative")
def dup_view_extras(spark, sf_dir):
    return reports.extras(reports.duplicate_view(_duplicates(spark, sf_dir).select("group_id", "file_id", "is_representative"), files(spark, sf_dir)))


# --- filters and counts ---------------------------------------------------------------------------------


@query("active_count", f"WITH {FILES} SELECT count(*) AS n FROM active")
def active_count(spark, sf_dir):
    return reports.count_active(files(spark, sf_dir))


@query("needs_analysis", f"WITH {FILES} SELECT id, path FROM active WHERE phash IS NULL AND scan_status <> 'error'")
def needs_analysis(spark, sf_dir):
    return reports.needs_analysis(files(spark, sf_dir)).select("id", "path")


@query("subtree_paths", f"WITH {FILES} SELECT id, path FROM files WHERE path = '/lib/src1' OR starts_with(path, '/lib/src1/')")
def subtree_paths(spark, sf_dir):
    return files(spark, sf_dir).where(paths.under_root(F.col("path"), "/lib/src1/")).select("id", "path")


@query("category_counts", f"WITH {FILES} SELECT category, count(*) AS n FROM active GROUP BY category")
def category_counts(spark, sf_dir):
    return reports.category_counts(files(spark, sf_dir))


@query("by_category", f"WITH {FILES} SELECT id, path FROM active WHERE category = 'fr'")
def by_category(spark, sf_dir):
    return reports.by_category(files(spark, sf_dir), "fr").select("id", "path")


@query("with_signature", f"WITH {FILES} SELECT id, phash, CAST(NULL AS DOUBLE) AS exif_dt FROM active WHERE phash IS NOT NULL")
def with_signature(spark, sf_dir):
    return reports.with_signature(files(spark, sf_dir))


@query("id_semi_join", f"WITH {FILES} SELECT id, path FROM files WHERE id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def id_semi_join(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("id"))
    return reports.paths_for(files(spark, sf_dir), ids)


@query("deletion_anti_join", f"WITH {FILES} SELECT id, path FROM active WHERE starts_with(path, '/lib/src1/') AND id NOT IN (SELECT doc_id FROM labels)")
def deletion_anti_join(spark, sf_dir):
    rows = files(spark, sf_dir)
    return merge.vanished(rows, rows.where("phash IS NOT NULL"), "/lib/src1")


@query("human_size", "SELECT doc_id, CASE WHEN strlen(text) < 1024 THEN strlen(text) || ' B' ELSE printf('%.1f KB', strlen(text) / 1024.0) END AS label FROM documents WHERE strlen(text) > 0")
def human_size(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("octet_length(text) > 0").select("doc_id", paths.human_size(F.octet_length("text")).alias("label"))


@query("nfc_paths", "SELECT doc_id, nfc_normalize(left(text, 40)) AS composed FROM documents")
def nfc_paths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", paths.nfc(F.substring("text", 1, 40)).alias("composed"))


@query("nfc_text", "SELECT doc_id, nfc_normalize(text) AS composed FROM documents")
def nfc_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", paths.nfc("text").alias("composed"))


@query("path_parts", f"WITH {FILES} SELECT id, split_part(path, '/', -1) AS name, '.txt' AS ext, 'txt' AS format, regexp_replace(path, '/[^/]*$', '') AS folder, CAST(id AS VARCHAR) AS stem FROM files")
def path_parts(spark, sf_dir):
    p = F.col("path")
    return files(spark, sf_dir).select("id", paths.basename(p).alias("name"), paths.extension(p).alias("ext"), paths.format_of(p).alias("format"), paths.dirname(p).alias("folder"), paths.stem(paths.basename(p)).alias("stem"))


# --- signatures -----------------------------------------------------------------------------------------

BITS = "aggregate(transform(embedding, (x, i) -> IF(x > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)"
SIGNS = "s AS (SELECT vec_id AS id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS b FROM embeddings)"


def signatures(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.expr(BITS).alias("h"))


@query("hamming_pairs", f"WITH {SIGNS} SELECT x.id AS a, y.id AS b, CAST(hamming(x.b, y.b) AS BIGINT) AS distance FROM s x JOIN s y ON x.id < y.id WHERE hamming(x.b, y.b) <= 18")
def hamming_pairs(spark, sf_dir):
    return similarity.hamming_pairs(signatures(spark, sf_dir), 18).withColumn("distance", F.col("distance").cast("bigint"))


COMPONENTS = f"""WITH RECURSIVE {SIGNS}, e AS (SELECT x.id AS a, y.id AS b FROM s x JOIN s y ON x.id <> y.id WHERE hamming(x.b, y.b) <= 18),
    reach AS (SELECT DISTINCT a AS id, a AS r FROM e UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.r),
    comp AS (SELECT id, min(r) AS component FROM reach GROUP BY id)"""


@query("similar_components", COMPONENTS + " SELECT comp.component, comp.id AS file_id, round(1 - hamming(s.b, t.b) / 64.0, 4) AS similarity_score FROM comp JOIN s ON s.id = comp.id JOIN s t ON t.id = comp.component")
def similar_components(spark, sf_dir):
    entries = signatures(spark, sf_dir)
    found = graph.connected_components(similarity.similar_edges(entries, 18))
    return similarity.component_scores(found, entries)


@query("similar_totals", COMPONENTS + " SELECT count(DISTINCT component) AS groups, count(*) AS members FROM comp")
def similar_totals(spark, sf_dir):
    found = graph.connected_components(similarity.similar_edges(signatures(spark, sf_dir), 18))
    return reports.members_total(found.withColumnRenamed("component", "group_id"))


@query("hamming_hex", f"WITH {FILES} SELECT x.id AS a, y.id AS b, CAST(bit_count(xor(CAST('0x' || x.phash[1:12] AS BIGINT), CAST('0x' || y.phash[1:12] AS BIGINT))) AS BIGINT) AS distance FROM files x JOIN files y ON y.id = x.id + 1 WHERE x.phash IS NOT NULL AND y.phash IS NOT NULL")
def hamming_hex(spark, sf_dir):
    rows = files(spark, sf_dir).where("phash IS NOT NULL").select("id", F.substring("phash", 1, 12).alias("x"))
    other = rows.select((F.col("id") - 1).alias("id"), F.col("id").alias("b"), F.col("x").alias("y"))
    return rows.join(other, "id").select(F.col("id").alias("a"), "b", signature.hamming_hex(F.col("x"), F.col("y")).cast("bigint").alias("distance"))


@query("hamming_hex64", f"WITH {FILES} SELECT x.id AS a, y.id AS b, CAST(bit_count(xor(CAST('0x' || x.phash AS UBIGINT), CAST('0x' || y.phash AS UBIGINT))) AS BIGINT) AS distance FROM files x JOIN files y ON y.id = x.id + 1 WHERE x.phash IS NOT NULL AND y.phash IS NOT NULL")
def hamming_hex64(spark, sf_dir):
    rows = files(spark, sf_dir).where("phash IS NOT NULL").select("id", F.col("phash").alias("x"))
    other = rows.select((F.col("id") - 1).alias("id"), F.col("id").alias("b"), F.col("x").alias("y"))
    return rows.join(other, "id").select(F.col("id").alias("a"), "b", signature.hamming_hex(F.col("x"), F.col("y")).cast("bigint").alias("distance"))


@query("burst_pairs", """WITH e AS (SELECT event_id AS id, epoch_us(ts) / 1e6 AS dt, (event_id * 2654435761) & 4294967295 AS h, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events)
    SELECT x.id AS a, y.id AS b, CAST(bit_count(xor(x.h, y.h)) AS BIGINT) AS distance FROM e x JOIN e y ON y.rn - x.rn BETWEEN 1 AND 3
    WHERE y.dt - x.dt <= 600 AND bit_count(xor(x.h, y.h)) <= 14""")
def burst_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("dt"), F.expr("(event_id * 2654435761) & 4294967295L").alias("h"))
    return similarity.burst_pairs(rows, 600.0, 14, 3).withColumn("distance", F.col("distance").cast("bigint"))


# --- best shot ------------------------------------------------------------------------------------------


def metrics(spark, sf_dir):
    eyes = F.max(F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "R", 0.0))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("group_id"), F.col("l_linenumber").cast("bigint").alias("file_id")).agg(
        F.max("l_extendedprice").alias("sharpness"), (1 - F.min("l_discount")).alias("exposure"), F.least(F.lit(1.0), 10 * F.max("l_tax")).alias("contrast"),
        eyes.alias("eyes_open"), F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40)).alias("has_face"),
    )


SCORED = """m AS (SELECT l_orderkey AS group_id, CAST(l_linenumber AS BIGINT) AS file_id, max(l_extendedprice) AS sharpness, 1 - min(l_discount) AS exposure,
    least(1.0, 10 * max(l_tax)) AS contrast, max(CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'R' THEN 0.0 END)::DOUBLE AS eyes_open,
    bool_or(l_returnflag = 'R' AND l_quantity > 40) AS has_face FROM lineitem GROUP BY 1, 2),
    p AS (SELECT *, max(sharpness) OVER w AS mx, bool_or(has_face) OVER w AS person FROM m WINDOW w AS (PARTITION BY group_id)),
    n AS (SELECT *, CASE WHEN mx > 0 THEN sharpness / mx ELSE 0.0 END AS sn FROM p),
    q AS (SELECT *, CASE WHEN person THEN 'person' ELSE 'landscape' END AS preset, round(CASE WHEN person
        THEN (0.3::DOUBLE * sn + 0.2::DOUBLE * exposure + 0.1::DOUBLE * contrast + 0.4::DOUBLE * coalesce(eyes_open, 0)) / (0.3::DOUBLE + 0.2::DOUBLE + 0.1::DOUBLE + CASE WHEN eyes_open IS NULL THEN 0 ELSE 0.4::DOUBLE END)
        ELSE (0.4::DOUBLE * sn + 0.3::DOUBLE * exposure + 0.3::DOUBLE * contrast) / (0.4::DOUBLE + 0.3::DOUBLE + 0.3::DOUBLE) END, 3) AS quality_score FROM n),
    b AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY quality_score DESC, file_id) = 1 AS is_best_shot FROM q),
    r AS (SELECT *, concat_ws(' · ', CASE WHEN is_best_shot THEN '종합 1위' END, CASE WHEN sn >= 0.999 AND mx > 0 THEN '선명도 1위' END,
        CASE WHEN eyes_open >= 0.5 THEN '눈 뜸' WHEN eyes_open IS NOT NULL THEN '눈 감음 주의' END, CASE WHEN exposure >= 0.85 THEN '노출 양호' END,
        CASE WHEN contrast >= 0.6 THEN '대비 좋음' END) AS why FROM b)"""


def _scored(spark, sf_dir):
    return bestshot.score_groups(metrics(spark, sf_dir), rounded=3)


@query("bestshot_scores", f"WITH {SCORED} SELECT group_id, file_id, preset, quality_score, is_best_shot FROM b")
def bestshot_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("group_id", "file_id", "preset", "quality_score", "is_best_shot")


@query("bestshot_reason", f"WITH {SCORED} SELECT group_id, file_id, CASE WHEN why = '' THEN '—' ELSE why END AS reason FROM r")
def bestshot_reason(spark, sf_dir):
    return _scored(spark, sf_dir).select("group_id", "file_id", "reason")


@query("bestshot_detail_json", f"WITH {SCORED} SELECT group_id, file_id, preset, quality_score AS score, CASE WHEN why = '' THEN '—' ELSE why END AS reason, eyes_open IS NULL AS no_eyes FROM r")
def bestshot_detail_json(spark, sf_dir):
    rows = bestshot.detail_json(_scored(spark, sf_dir))
    get = lambda k: F.get_json_object("quality_detail", f"$.{k}")
    return rows.select("group_id", "file_id", get("preset").alias("preset"), get("score").cast("double").alias("score"), bestshot.reason_of(F.col("quality_detail")).alias("reason"), F.contains("quality_detail", F.lit('"eyes_open":null')).alias("no_eyes"))


@query("similar_report", f"WITH {SCORED}, {FILES} SELECT b.group_id, CASE WHEN is_best_shot THEN '베스트샷' ELSE '' END AS is_best_shot, quality_score, 1.0::DOUBLE AS similarity_score, category, path FROM b JOIN active ON active.id = b.file_id")
def similar_report(spark, sf_dir):
    groups = _scored(spark, sf_dir).select("group_id", "file_id", "quality_score", "is_best_shot", F.lit(1.0).alias("similarity_score"))
    return reports.similar_report(groups, files(spark, sf_dir))


# --- protection -----------------------------------------------------------------------------------------

SIMILAR = "sims AS (SELECT id // 10 AS group_id, id AS file_id, id % 10 = 3 AS is_best_shot FROM files)"


def _similar(rows: DataFrame) -> DataFrame:
    return rows.select(F.floor(F.col("id") / 10).alias("group_id"), F.col("id").alias("file_id"), (F.col("id") % 10 == 3).alias("is_best_shot"))


@query("protected_survivors", f"""WITH {DUPLICATES}, {SIMILAR}, req AS (SELECT id FROM files WHERE id % 100 < 60),
    g AS (SELECT 'd' || group_id AS g, file_id, is_representative AS flag FROM dups UNION ALL SELECT 's' || group_id, file_id, is_best_shot FROM sims),
    a AS (SELECT g.* FROM g JOIN active ON active.id = g.file_id),
    s AS (SELECT coalesce(min(file_id) FILTER (WHERE flag), min(file_id)) AS id FROM a GROUP BY g HAVING bool_and(file_id IN (SELECT id FROM req)))
    SELECT DISTINCT id FROM s""")
def protected_survivors(spark, sf_dir):
    rows = files(spark, sf_dir)
    return protect.protected_survivors(_duplicates(spark, sf_dir), _similar(rows), rows, rows.where("id % 100 < 60").select("id"))


@query("unprotected_targets", f"""WITH {FILES}, {SIMILAR}, req AS (SELECT id FROM files WHERE id % 100 < 60),
    a AS (SELECT sims.* FROM sims JOIN active ON active.id = sims.file_id),
    s AS (SELECT coalesce(min(file_id) FILTER (WHERE is_best_shot), min(file_id)) AS id FROM a GROUP BY group_id HAVING bool_and(file_id IN (SELECT id FROM req)))
    SELECT id FROM req WHERE id NOT IN (SELECT id FROM s)""")
def unprotected_targets(spark, sf_dir):
    rows = files(spark, sf_dir)
    request = rows.where("id % 100 < 60").select("id")
    return protect.targets(request, protect.protected_in(_similar(rows), rows, request, "is_best_shot"))


@query("collapse_duplicates", f"""WITH {DUPLICATES}, {SIMILAR}, l AS (SELECT * FROM sims WHERE file_id NOT IN (SELECT file_id FROM dups WHERE NOT is_representative))
    SELECT CAST(group_id AS BIGINT) AS group_id, file_id, is_best_shot FROM l WHERE group_id IN (SELECT group_id FROM l GROUP BY 1 HAVING count(*) >= 2)""")
def collapse_duplicates(spark, sf_dir):
    return protect.collapse_duplicates(_similar(files(spark, sf_dir)), _duplicates(spark, sf_dir)).select("group_id", "file_id", "is_best_shot")


# --- rules ----------------------------------------------------------------------------------------------


@query("classify_rules", """WITH f AS (SELECT p_partkey AS id, CASE WHEN p_size % 7 = 0 THEN 'Screenshot ' || p_partkey ELSE p_name END AS name, CASE WHEN p_size % 2 = 0 THEN p_brand END AS make,
    CASE WHEN p_size % 5 = 0 THEN 1080 ELSE p_size END AS width, CASE WHEN p_size % 5 = 0 THEN 1920 ELSE 10 END AS height, (p_partkey % 100) / 100.0::DOUBLE AS white,
    (p_partkey % 13) / 200.0::DOUBLE AS edges, p_retailprice / 10 AS lap, (p_partkey % 80)::DOUBLE AS bright FROM part)
    SELECT id, CASE WHEN contains(lower(name), 'screenshot') OR (make IS NULL AND width = 1080 AND height = 1920) THEN 'screenshot' WHEN white >= 0.55 AND edges >= 0.02 THEN 'document' WHEN lap < 100 THEN 'blurry' ELSE 'normal' END AS category,
    CASE WHEN contains(lower(name), 'screenshot') THEN CASE WHEN make IS NULL THEN 0.95 ELSE 0.75 END WHEN make IS NULL AND width = 1080 AND height = 1920 THEN 0.7 WHEN white >= 0.55 AND edges >= 0.02 THEN CASE WHEN white > 0.7 THEN 0.8 ELSE 0.6 END
    WHEN lap < 100 THEN CASE WHEN bright < 40 THEN 0.4 ELSE 0.85 END WHEN make IS NULL THEN 0.6 ELSE 0.9 END::DOUBLE AS category_confidence FROM f""")
def classify_rules(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("Screenshot "), F.col("p_partkey").cast("string"))).otherwise(F.col("p_name")).alias("name"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("make"), F.lit(None).cast("string").alias("model"),
        F.when(F.col("p_size") % 5 == 0, 1080).otherwise(F.col("p_size")).alias("width"), F.when(F.col("p_size") % 5 == 0, 1920).otherwise(10).alias("height"),
        ((F.col("p_partkey") % 100) / 100.0).alias("white_ratio"), ((F.col("p_partkey") % 13) / 200.0).alias("edge_density"),
        (F.col("p_retailprice") / 10).alias("laplacian"), (F.col("p_partkey") % 80).cast("double").alias("brightness"),
    )
    return classify.classify(rows, Config()).select("id", "category", "category_confidence")


# --- dates and plans ------------------------------------------------------------------------------------

NAMED = """o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d FROM orders),
    named AS (SELECT id, d, CASE id % 6 WHEN 0 THEN strftime(d, 'IMG_%Y%m%d_120000.jpg') WHEN 1 THEN strftime(d, 'photo %Y-%m-%d.png') WHEN 2 THEN '20231345_' || strftime(d, '%Y.%m.%d') || '.jpg'
        WHEN 3 THEN 'DSC_0001.jpg' WHEN 4 THEN strftime(d, 'x1%Y%m%d.jpg') ELSE '20230230_1200.jpg' END AS name,
        CASE WHEN id % 12 = 3 THEN epoch(d::TIMESTAMP) + 3600 WHEN id % 12 = 9 THEN 4102444800.0 WHEN id % 12 = 5 THEN 0.0 END::DOUBLE AS exif FROM o),
    dated AS (SELECT *, CASE WHEN id % 12 = 3 THEN d WHEN id % 6 IN (0, 1, 2) THEN d END AS day,
        CASE WHEN id % 12 = 3 THEN 'exif' WHEN id % 6 IN (0, 1, 2) THEN 'filename' ELSE 'unknown' END AS source FROM named)"""


def named(spark, sf_dir):
    d, i = F.col("d"), F.col("id") % 6
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"))
    compact = F.date_format(d, "yyyyMMdd")
    name = (
        F.when(i == 0, F.concat(F.lit("IMG_"), compact, F.lit("_120000.jpg")))
        .when(i == 1, F.concat(F.lit("photo "), F.date_format(d, "yyyy-MM-dd"), F.lit(".png")))
        .when(i == 2, F.concat(F.lit("20231345_"), F.date_format(d, "yyyy.MM.dd"), F.lit(".jpg")))
        .when(i == 3, "DSC_0001.jpg")
        .when(i == 4, F.concat(F.lit("x1"), compact, F.lit(".jpg")))
        .otherwise("20230230_1200.jpg")
    )
    k = F.col("id") % 12
    seconds = (F.unix_micros(d.cast("timestamp")) / 1e6) + 3600
    return rows.withColumn("name", name).withColumn("exif", F.when(k == 3, seconds).when(k == 9, 4102444800.0).when(k == 5, 0.0))


@query("resolve_date", f"WITH {NAMED} SELECT id, name, day, source FROM dated")
def resolve_date(spark, sf_dir):
    day, source = dates.resolve_date(F.col("exif"), F.col("name"), F.to_date(F.lit(AS_OF)))
    return named(spark, sf_dir).select("id", "name", day.alias("day"), source.alias("source"))


PLANNED = NAMED + """, plan AS (SELECT id AS file_id, CASE WHEN id % 4 = 0 AND day IS NOT NULL THEN strftime(day, '/sorted/%Y/%Y-%m/') ELSE '/photos/' END || name AS src,
    CASE WHEN day IS NULL THEN '/sorted/_날짜미상' ELSE strftime(day, '/sorted/%Y/%Y-%m') END AS dest_dir, source, id % 4 = 0 AND day IS NOT NULL AS skip FROM dated)"""


def _plan(spark, sf_dir):
    rows = named(spark, sf_dir)
    day, _ = dates.resolve_date(F.col("exif"), F.col("name"), F.to_date(F.lit(AS_OF)))
    placed = F.concat(F.lit("/sorted/"), dates.month_folder(day), F.lit("/"), "name")
    path = F.when((F.col("id") % 4 == 0) & day.isNotNull(), placed).otherwise(F.concat(F.lit("/photos/"), "name"))
    rows = rows.select("id", path.alias("path"), F.col("exif").alias("exif_dt"), F.lit(False).alias("removed"), F.lit(False).alias("missing"))
    return organize.plan(rows, "/sorted/", as_of=AS_OF, compose=False)


@query("organize_plan", f"WITH {PLANNED} SELECT * FROM plan")
def organize_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


@query("organize_sources", f"WITH {PLANNED} SELECT source, count(*) AS n FROM plan GROUP BY 1")
def organize_sources(spark, sf_dir):
    return organize.by_source(_plan(spark, sf_dir))


@query("organize_preview", f"WITH {PLANNED} SELECT count(*) FILTER (WHERE NOT skip) AS to_move, count(*) FILTER (WHERE skip) AS in_place FROM plan")
def organize_preview(spark, sf_dir):
    return organize.totals(_plan(spark, sf_dir))


@query("organize_top_months", f"WITH {PLANNED}, m AS (SELECT split_part(dest_dir, '/', -1) AS month, count(*) AS n FROM plan WHERE NOT skip GROUP BY 1) SELECT *, (SELECT count(*) - 12 FROM m) AS more FROM m ORDER BY month LIMIT 12")
def organize_top_months(spark, sf_dir):
    return organize.months(_plan(spark, sf_dir))


@query("organize_samples", f"WITH {PLANNED} SELECT file_id, split_part(src, '/', -1) AS name, dest_dir FROM plan WHERE NOT skip ORDER BY file_id LIMIT 10")
def organize_samples(spark, sf_dir):
    return organize.samples(_plan(spark, sf_dir))


@query("planned_names", """WITH i AS (SELECT o_orderkey AS file_id, '/d/' || o_orderstatus AS dest_dir, o_orderpriority || '.jpg' AS name FROM orders),
    n AS (SELECT *, row_number() OVER (PARTITION BY dest_dir, name ORDER BY file_id) - 1 + CASE WHEN dest_dir = '/d/F' THEN 1 ELSE 0 END AS k FROM i)
    SELECT file_id, dest_dir, name, CASE WHEN k = 0 THEN name ELSE replace(name, '.jpg', ' (' || k || ').jpg') END AS planned_name FROM n""")
def planned_names(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), F.concat(F.lit("/d/"), "o_orderstatus").alias("dest_dir"), F.concat("o_orderpriority", F.lit(".jpg")).alias("name"))
    return organize.planned_names(rows, rows.where("dest_dir = '/d/F'").select("dest_dir", "name").distinct())


# --- snapshots ------------------------------------------------------------------------------------------

SNAPSHOTS = """old AS (SELECT o_orderkey AS id, '/o/' || o_orderkey AS path, o_custkey AS size, o_totalprice AS mtime, o_orderkey % 7 = 0 AS missing, o_orderkey % 11 = 0 AS removed, 'h' || o_orderkey AS content_hash FROM orders WHERE o_orderkey % 5 <> 0),
    seen AS (SELECT o_orderkey AS id, '/o/' || o_orderkey AS path, CASE WHEN o_orderkey % 9 = 0 THEN o_custkey + 1 ELSE o_custkey END AS size, CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS mtime FROM orders WHERE o_orderkey % 3 <> 0),
    judged AS (SELECT seen.*, CASE WHEN old.path IS NULL THEN 'new' WHEN old.size = seen.size AND old.mtime = seen.mtime THEN 'unchanged' ELSE 'updated' END AS status FROM seen LEFT JOIN old USING (path))"""


def snapshots(spark, sf_dir):
    k, orders = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    path = F.concat(F.lit("/o/"), k.cast("string")).alias("path")
    old = orders.where("o_orderkey % 5 <> 0").select(
        k.alias("id"), path, F.col("o_custkey").alias("size"), F.col("o_totalprice").alias("mtime"), F.lit("jpg").alias("format"), F.concat(F.lit("h"), k.cast("string")).alias("content_hash"),
        F.lit("analyzed").alias("scan_status"), (k % 7 == 0).alias("missing"), (k % 11 == 0).alias("removed"),
    )
    seen = orders.where("o_orderkey % 3 <> 0").select(path, F.when(k % 9 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("size"), F.when(k % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("mtime"), F.lit("jpg").alias("format"))
    return old, seen


@query("snapshot_diff", f"WITH {SNAPSHOTS} SELECT path, status FROM judged")
def snapshot_diff(spark, sf_dir):
    return merge.diff(*snapshots(spark, sf_dir)).select("path", "status")


@query("snapshot_summary", f"WITH {SNAPSHOTS} SELECT count(*) FILTER (WHERE status = 'new') AS new, count(*) FILTER (WHERE status = 'updated') AS updated, count(*) FILTER (WHERE status = 'unchanged') AS unchanged, CAST(NULL AS BIGINT) AS deleted FROM judged")
def snapshot_summary(spark, sf_dir):
    return merge.summary(merge.diff(*snapshots(spark, sf_dir)))


@query("snapshot_merge", f"""WITH {SNAPSHOTS}, kept AS (SELECT old.id, old.path, coalesce(j.size, old.size) AS size, coalesce(j.mtime, old.mtime) AS mtime,
        CASE WHEN j.status = 'updated' THEN NULL ELSE old.content_hash END AS content_hash, CASE WHEN j.status = 'updated' THEN 'discovered' ELSE 'analyzed' END AS scan_status,
        CASE WHEN j.status IS NULL THEN old.missing ELSE false END AS missing, old.removed FROM old LEFT JOIN judged j USING (path))
    SELECT * FROM kept UNION ALL SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY path), path, size, mtime, NULL, 'discovered', false, false FROM judged WHERE status = 'new'""")
def snapshot_merge(spark, sf_dir):
    return merge.upsert(*snapshots(spark, sf_dir)).select("id", "path", "size", "mtime", "content_hash", "scan_status", "missing", "removed")


@query("mark_missing", f"WITH {SNAPSHOTS} SELECT id, missing OR (NOT removed AND path NOT IN (SELECT path FROM seen)) AS missing FROM old")
def mark_missing(spark, sf_dir):
    old, seen = snapshots(spark, sf_dir)
    return merge.set_flag(old, merge.vanished(old, seen, "/o"), "missing").select("id", "missing")


@query("path_conflicts", f"""WITH {SNAPSHOTS}, moves AS (SELECT id, '/o/' || (id + 1) AS new_path FROM old WHERE id % 4 = 1)
    SELECT moves.id, new_path, CASE WHEN h.id IS NOT NULL AND h.id <> moves.id AND NOT (h.removed OR h.missing) THEN 'conflict' WHEN h.id IS NOT NULL AND h.id <> moves.id THEN 'replaces' ELSE 'moved' END AS outcome,
    CASE WHEN h.id IS NOT NULL AND h.id <> moves.id AND (h.removed OR h.missing) THEN h.id END AS dropped FROM moves LEFT JOIN old h ON h.path = new_path""")
def path_conflicts(spark, sf_dir):
    old, _ = snapshots(spark, sf_dir)
    moves = old.where("id % 4 = 1").select("id", F.concat(F.lit("/o/"), (F.col("id") + 1).cast("string")).alias("new_path"), F.col("id").alias("seq"))
    return merge.path_updates(old, moves)


# --- action log -----------------------------------------------------------------------------------------

LOG = """log AS (SELECT event_id AS id, user_id AS file_id, CASE event_id % 4 WHEN 0 THEN 'trash' WHEN 1 THEN 'quarantine' WHEN 2 THEN 'move' ELSE 'other' END AS action, '/f/' || event_id AS from_path,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE '/t/' || event_id END AS to_path, epoch_us(ts) / 1e6 AS timestamp, CAST(dayofyear(ts) AS BIGINT) AS batch, dayofyear(ts) > 25 AS undone FROM events)"""


def log(spark, sf_dir):
    k = F.col("event_id")
    action = F.when(k % 4 == 0, "trash").when(k % 4 == 1, "quarantine").when(k % 4 == 2, "move").otherwise("other")
    rows = table(spark, sf_dir, "events")
    return rows.select(k.alias("id"), F.col("user_id").alias("file_id"), action.alias("action"), F.concat(F.lit("/f/"), k.cast("string")).alias("from_path"), F.when(k % 4 != 0, F.concat(F.lit("/t/"), k.cast("string"))).alias("to_path"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"), F.dayofyear("ts").cast("bigint").alias("batch"), (F.dayofyear("ts") > 25).alias("undone"))


@query("action_log_report", f"WITH {LOG} SELECT strftime(make_timestamp(CAST(timestamp * 1e6 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS timestamp, CASE action WHEN 'trash' THEN '휴지통' WHEN 'quarantine' THEN '격리' WHEN 'move' THEN '이동' ELSE action END AS action, batch, CASE WHEN undone THEN '취소됨' ELSE '' END AS undone, from_path, coalesce(to_path, '') AS to_path FROM log")
def action_log_report(spark, sf_dir):
    return reports.action_report(log(spark, sf_dir))


@query("next_batch", f"WITH {LOG} SELECT coalesce(max(batch), 0) + 1 AS batch FROM log")
def next_batch(spark, sf_dir):
    return log(spark, sf_dir).agg((F.coalesce(F.max("batch"), F.lit(0)) + 1).alias("batch"))


@query("last_undoable", f"WITH {LOG} SELECT max(batch) AS batch FROM log WHERE NOT undone AND action IN ('quarantine', 'move')")
def last_undoable(spark, sf_dir):
    return reports.last_undoable(log(spark, sf_dir))


@query("undoable_actions", f"WITH {LOG} SELECT id, action FROM log WHERE NOT undone AND action IN ('quarantine', 'move')")
def undoable_actions(spark, sf_dir):
    return reports.undoable(log(spark, sf_dir)).select("id", "action")


@query("batch_actions", f"WITH {LOG} SELECT id, from_path, to_path FROM log WHERE batch = 20 AND NOT undone")
def batch_actions(spark, sf_dir):
    return reports.in_batch(log(spark, sf_dir), 20).select("id", "from_path", "to_path")


@query("mark_batch_undone", f"WITH {LOG} SELECT id, undone OR batch = 20 AS undone FROM log")
def mark_batch_undone(spark, sf_dir):
    return merge.mark_undone(log(spark, sf_dir), 20).select("id", "undone")
