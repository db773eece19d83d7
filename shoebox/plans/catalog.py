"""More of the library's operators over the fixture tables, with their SQL twins: file names, batch updates of a snapshot, chained
moves, views, labels, pixel kernels on small generated grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Config
from ..functions import dates, paths
from ..operators import bestshot, features, merge, reports, similarity
from ..schema import FILES as FILE_COLUMNS
from ..schema import conform
from .queries import DUPLICATES, FILES, SIGNS, SIMILAR, SNAPSHOTS, _duplicates, _similar, files, signatures, snapshots, table
from .registry import query

# --- names ----------------------------------------------------------------------------------------------

NAMES = ["a.jpg", "B.JPEG", "c.Heic", "d.txt", ".hidden", "e.CR2", "f.webp", "g.mov", "no extension", "h.tar.nef"]
FOLDERS = ["2020/.Trashes", "$RECYCLE.BIN/x", "photos", ".Spotlight-V100", "System Volume Information"]


def _named(spark, sf_dir):
    i = F.col("doc_id")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(i.alias("id"), F.concat(F.lit("/v/"), pick(FOLDERS), F.lit("/"), pick(NAMES)).alias("path"))


_sql_list = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
NAMED = f"n AS (SELECT doc_id AS id, '/v/' || {_sql_list(FOLDERS)}[doc_id % {len(FOLDERS)} + 1] || '/' || {_sql_list(NAMES)}[doc_id % {len(NAMES)} + 1] AS path FROM documents)"


@query("supported_files", f"WITH {NAMED} SELECT id, path, id % 10 IN (0, 1, 2, 5, 6, 9) AS supported, CASE id % 10 WHEN 4 THEN '' WHEN 8 THEN '' ELSE lower(split_part(path, '.', -1)) END AS format FROM n")
def supported_files(spark, sf_dir):
    return _named(spark, sf_dir).select("id", "path", paths.is_supported(F.col("path")).alias("supported"), paths.format_of(F.col("path")).alias("format"))


@query("system_folders", f"WITH {NAMED} SELECT id, id % 5 IN (0, 3) AS on_mac, id % 5 IN (1, 4) AS on_windows, false AS on_linux FROM n")
def system_folders(spark, sf_dir):
    return _named(spark, sf_dir).select("id", *[paths.in_system_folder(F.col("path"), p).alias(c) for p, c in (("darwin", "on_mac"), ("win32", "on_windows"), ("linux", "on_linux"))])


@query("confidence_labels", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN lang ELSE printf('%s (신뢰도 %.2f)', lang, (doc_id % 100) / 100.0) END AS label FROM documents")
def confidence_labels(spark, sf_dir):
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(i, paths.with_confidence(F.when(i % 3 != 0, F.col("lang")), F.when(i % 4 != 0, (i % 100) / 100.0)).alias("label"))


@query("short_texts", "SELECT doc_id, left(text, 200) AS error, sha256(text)[1:12] AS hash FROM documents")
def short_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", paths.error_text(F.col("text")).alias("error"), paths.short_hash(F.sha2("text", 256)).alias("hash"))


@query("size_labels", """WITH s AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN o_custkey % 1024 WHEN 2 THEN o_custkey * 1031 % 1048576 WHEN 3 THEN o_custkey * 1000003 % 1073741824 ELSE o_custkey * 1000000007 END AS n FROM orders)
    SELECT id, CASE WHEN n = 0 THEN '-' WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) ELSE printf('%.1f GB', n / 1073741824.0::DOUBLE) END AS label FROM s
    UNION ALL SELECT NULL, '-'""")
def size_labels(spark, sf_dir):
    k, i = F.col("o_custkey").cast("bigint"), F.col("o_orderkey") % 5
    n = F.when(i == 0, 0).when(i == 1, k % 1024).when(i == 2, k * 1031 % 1048576).when(i == 3, k * 1000003 % 1073741824).otherwise(k * 1000000007)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), n.alias("n"))
    rows = rows.unionByName(spark.range(1).select(F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("n")))
    return rows.select("id", paths.human_size(F.col("n")).alias("label"))


@query("exif_epochs", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE floor(epoch_us(ts) / 1e6) END::DOUBLE AS epoch FROM events""")
def exif_epochs(spark, sf_dir):
    i, text = F.col("event_id") % 5, F.date_format("ts", "yyyy:MM:dd HH:mm:ss")
    raw = F.when(i == 0, "2020:13:45 00:00:00").when(i == 1, "not a date").when(i == 2, F.concat(F.lit("  "), text, F.lit(" "))).otherwise(text)
    return table(spark, sf_dir, "events").select("event_id", dates.exif_epoch(raw).alias("epoch"))


# --- snapshot updates -----------------------------------------------------------------------------------


def _values(old, **columns):
    return old.where("id % 3 = 0").select("id", *[F.expr(v).alias(k) for k, v in columns.items()])


@query("set_content_hashes", f"WITH {SNAPSHOTS} SELECT id, CASE WHEN id % 3 = 0 THEN 'x' || id ELSE content_hash END AS content_hash, CASE WHEN id % 3 = 0 THEN 'hashed' ELSE 'analyzed' END AS scan_status FROM old")
def set_content_hashes(spark, sf_dir):
    old = conform(snapshots(spark, sf_dir)[0], FILE_COLUMNS)
    return merge.set_columns(old, _values(old, content_hash="concat('x', id)"), "hashed").select("id", "content_hash", "scan_status")


@query("set_analysis_results", f"""WITH {SNAPSHOTS} SELECT id, CASE WHEN id % 3 = 0 THEN 'p' || id END AS phash, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'normal' END AS category,
    CASE WHEN id % 3 = 0 THEN (id % 100) / 100.0::DOUBLE END AS category_confidence, CASE WHEN id % 3 = 0 THEN 'done' ELSE 'analyzed' END AS scan_status FROM old""")
def set_analysis_results(spark, sf_dir):
    old = conform(snapshots(spark, sf_dir)[0], FILE_COLUMNS)
    values = _values(old, phash="concat('p', id)", category="IF(id % 2 = 0, 'normal', NULL)", category_confidence="(id % 100) / 100.0D")
    return merge.set_columns(old, values, "done").select("id", "phash", "category", "category_confidence", "scan_status")


@query("set_exif_dates", f"WITH {SNAPSHOTS} SELECT id, CASE WHEN id % 3 = 0 THEN id * 60.0::DOUBLE END AS exif_dt, 'analyzed' AS scan_status FROM old")
def set_exif_dates(spark, sf_dir):
    old = conform(snapshots(spark, sf_dir)[0], FILE_COLUMNS)
    return merge.set_columns(old, _values(old, exif_dt="id * 60.0D")).select("id", "exif_dt", "scan_status")


@query("mark_errors", f"WITH {SNAPSHOTS} SELECT id, CASE WHEN id % 3 = 0 THEN left(repeat('broken ' || id || ' ', 40), 200) END AS error_msg, CASE WHEN id % 3 = 0 THEN 'error' ELSE 'analyzed' END AS scan_status FROM old")
def mark_errors(spark, sf_dir):
    old = conform(snapshots(spark, sf_dir)[0], FILE_COLUMNS)
    values = _values(old, error_msg="repeat(concat('broken ', id, ' '), 40)").withColumn("error_msg", paths.error_text(F.col("error_msg")))
    return merge.set_columns(old, values, "error").select("id", "error_msg", "scan_status")


@query("conform_old_tables", f"WITH {SNAPSHOTS} SELECT id, path, CAST(NULL AS VARCHAR) AS dhash, CASE WHEN id % 2 = 0 THEN 'hashed' ELSE 'discovered' END AS scan_status, false AS missing, false AS removed, CAST(NULL AS DOUBLE) AS exif_dt FROM old")
def conform_old_tables(spark, sf_dir):
    old = snapshots(spark, sf_dir)[0].select("id", "path", F.expr("IF(id % 2 = 0, 'hashed', NULL)").alias("scan_status"))
    return conform(old, FILE_COLUMNS).select("id", "path", "dhash", "scan_status", "missing", "removed", "exif_dt")


MIXED = """mixed AS (SELECT doc_id AS id, '/n/' || CASE doc_id % 4 WHEN 0 THEN chr(233) || doc_id // 4 WHEN 1 THEN 'e' || chr(769) || doc_id // 4 WHEN 2 THEN 'o' || chr(776) || doc_id // 8 ELSE 'plain' || doc_id END AS path FROM documents),
    ranked AS (SELECT id, nfc_normalize(path) AS path, row_number() OVER (PARTITION BY nfc_normalize(path) ORDER BY path = nfc_normalize(path) DESC, id DESC) AS k FROM mixed)"""


def _mixed(spark, sf_dir):
    i = F.col("doc_id")
    number = lambda n: F.floor(i / n).cast("string")
    name = F.when(i % 4 == 0, F.concat(F.lit("é"), number(4))).when(i % 4 == 1, F.concat(F.lit("é"), number(4))).when(i % 4 == 2, F.concat(F.lit("ö"), number(8))).otherwise(F.concat(F.lit("plain"), i.cast("string")))
    return table(spark, sf_dir, "documents").select(i.alias("id"), F.concat(F.lit("/n/"), name).alias("path"))


@query("migrate_nfc", f"WITH {MIXED} SELECT id, path FROM ranked WHERE k = 1")
def migrate_nfc(spark, sf_dir):
    return merge.migrate_nfc(_mixed(spark, sf_dir))[0]


@query("migrate_nfc_groups", f"WITH {MIXED} SELECT id // 3 AS group_id, id AS file_id FROM ranked WHERE k = 1")
def migrate_nfc_groups(spark, sf_dir):
    rows = _mixed(spark, sf_dir)
    groups = rows.select(F.floor(F.col("id") / 3).alias("group_id"), F.col("id").alias("file_id"))
    return merge.migrate_nfc(rows, {"duplicate_groups": groups})[1]["duplicate_groups"].select("group_id", "file_id")


CHAINS = f"""{SNAPSHOTS}, moves AS (SELECT id, CASE WHEN id % 10 = 9 THEN '/free/' || id ELSE '/o/' || (id + 1) END AS new_path, CASE WHEN id % 20 < 10 THEN -id ELSE id END AS seq FROM old),
    holders AS (SELECT m.id, m.new_path, m.seq, h.id AS holder, coalesce(h.removed OR h.missing, false) AS dead, hm.seq AS holder_seq FROM moves m LEFT JOIN old h ON h.path = m.new_path LEFT JOIN moves hm ON hm.id = h.id),
    walk AS (SELECT id, new_path, holder, dead, holder IS NULL OR dead AS ok, CASE WHEN holder IS NOT NULL AND holder_seq < seq THEN holder END AS waits, 0 AS turn FROM holders WHERE holder IS NULL OR holder_seq > seq OR dead
        UNION ALL SELECT h.id, h.new_path, h.holder, h.dead, w.ok, NULL, turn + 1 FROM holders h JOIN walk w ON h.holder = w.id WHERE h.holder_seq < h.seq AND NOT h.dead)"""


@query("path_chains", f"""WITH RECURSIVE {CHAINS} SELECT id, new_path, CASE WHEN NOT ok THEN 'conflict' WHEN dead AND waits IS NULL THEN 'replaces' WHEN dead AND (SELECT ok FROM walk w WHERE w.id = walk.holder) THEN 'moved' WHEN dead THEN 'replaces' ELSE 'moved' END AS outcome FROM walk""")
def path_chains(spark, sf_dir):
    """Files that move to where the next one was, in an order in which that one has gone before, or hasn't."""
    old, _ = snapshots(spark, sf_dir)
    i = F.col("id")
    moves = old.select("id", F.when(i % 10 == 9, F.concat(F.lit("/free/"), i.cast("string"))).otherwise(F.concat(F.lit("/o/"), (i + 1).cast("string"))).alias("new_path"), F.when(i % 20 < 10, -i).otherwise(i).alias("seq"))
    return merge.path_updates(old, moves).select("id", "new_path", "outcome")


# --- groups and views -----------------------------------------------------------------------------------


@query("category_total", f"WITH {FILES} SELECT count(*) AS total FROM active WHERE category IS NOT NULL")
def category_total(spark, sf_dir):
    return reports.category_total(files(spark, sf_dir))


GROUPS = f"{SIMILAR}, grouped AS (SELECT *, file_id % 7 / 7.0::DOUBLE AS quality_score, 0.5::DOUBLE AS similarity_score, '{{\"reason\":\"r' || file_id % 3 || '\"}}' AS quality_detail FROM sims)"


def _grouped(rows):
    detail = F.concat(F.lit('{"reason":"r'), (F.col("file_id") % 3).cast("string"), F.lit('"}'))
    return _similar(rows).withColumns({"quality_score": F.col("file_id") % 7 / F.lit(7.0), "similarity_score": F.lit(0.5), "quality_detail": detail})


@query("similar_thumbs", f"WITH {FILES}, {SIMILAR} SELECT row_number() OVER (ORDER BY group_id, file_id) AS place, CAST(group_id AS BIGINT) AS group_id, file_id, CAST(NULL AS VARCHAR) AS thumb_path FROM sims")
def similar_thumbs(spark, sf_dir):
    rows = files(spark, sf_dir)
    return _placed(reports.similar_thumbs(_similar(rows), rows), "group_id", "file_id", "thumb_path")


def _placed(ordered, *columns):
    """The rows of an ordered frame with their place in it, from 1, as they come out."""
    schema = ordered.select(F.lit(1).cast("bigint").alias("place"), *columns).schema
    return ordered.select(*columns).rdd.zipWithIndex().map(lambda x: (x[1] + 1, *x[0])).toDF(schema)


@query("size_candidates_in_order", f"WITH {FILES}, c AS (SELECT id, size FROM active WHERE size > 0 AND size IN (SELECT size FROM active WHERE size > 0 GROUP BY size HAVING count(*) > 1)) SELECT row_number() OVER (ORDER BY size, id) AS place, id, size FROM c")
def size_candidates_in_order(spark, sf_dir):
    return _placed(reports.size_candidates(files(spark, sf_dir)), "id", "size")


@query("dup_report_in_order", f"WITH {DUPLICATES} SELECT row_number() OVER (ORDER BY group_id, is_representative DESC, path) AS place, group_id, path FROM dups")
def dup_report_in_order(spark, sf_dir):
    rows = files(spark, sf_dir).withColumn("content_hash", F.sha2("text", 256))
    return _placed(reports.duplicate_report(_duplicates(spark, sf_dir).select("group_id", "file_id", "is_representative"), rows), "group_id", "path")


@query("category_counts_in_order", f"WITH {FILES} SELECT row_number() OVER (ORDER BY count(*) DESC, category) AS place, category, count(*) AS n FROM active GROUP BY category")
def category_counts_in_order(spark, sf_dir):
    return _placed(reports.category_counts(files(spark, sf_dir)), "category", "n")


def _items(view, *columns):
    return view.select("group_id", "title", F.posexplode("items").alias("place", "i")).select("group_id", "title", "place", *[F.col(f"i.{c}").alias(c) for c in columns])


@query("duplicate_view", f"""WITH {DUPLICATES} SELECT group_id, printf('완전 중복 그룹 %d · %d장', group_id, count(*) OVER g) AS title, row_number() OVER (g ORDER BY is_representative DESC, dups.path) - 1 AS place,
    CASE WHEN is_representative THEN '★ 대표' ELSE '' END || chr(10) || file_id || '.txt' AS label, dups.path || chr(10) || '(더블클릭: 원본 열기)' AS tooltip, dups.path, file_id, is_representative AS keep, dups.size, category, 0.5::DOUBLE AS confidence
    FROM dups JOIN active ON active.id = file_id WINDOW g AS (PARTITION BY group_id)""")
def duplicate_view(spark, sf_dir):
    view = reports.duplicate_view(_duplicates(spark, sf_dir).select("group_id", "file_id", "is_representative"), files(spark, sf_dir))
    return _items(view, "label", "tooltip", "path", "file_id", "keep", "size", "category", "confidence")


@query("similar_view", f"""WITH {DUPLICATES}, {GROUPS}, l AS (SELECT * FROM grouped WHERE file_id NOT IN (SELECT file_id FROM dups WHERE NOT is_representative)),
    k AS (SELECT * FROM l WHERE group_id IN (SELECT group_id FROM l GROUP BY 1 HAVING count(*) >= 2)), a AS (SELECT k.*, path, category FROM k JOIN active ON active.id = k.file_id),
    b AS (SELECT * FROM a WHERE group_id IN (SELECT group_id FROM a GROUP BY 1 HAVING count(*) >= 2))
    SELECT CAST(group_id AS BIGINT) AS group_id, printf('유사 그룹 %d · %d장', group_id, count(*) OVER g) AS title, row_number() OVER (g ORDER BY is_best_shot DESC, quality_score DESC, path) - 1 AS place,
    CASE WHEN is_best_shot THEN '⭐' ELSE '' END || ' ' || file_id || '.txt' AS label, path || chr(10) || '유사도 0.500' || chr(10) || 'r' || file_id % 3 || chr(10) || '(더블클릭: 원본 열기)' AS tooltip, file_id, is_best_shot AS is_best, 'r' || file_id % 3 AS reason
    FROM b WINDOW g AS (PARTITION BY group_id)""")
def similar_view(spark, sf_dir):
    rows = files(spark, sf_dir)
    return _items(reports.similar_view(_grouped(rows), _duplicates(spark, sf_dir), rows), "label", "tooltip", "file_id", "is_best", "reason")


@query("best_shots", """WITH members AS (SELECT DISTINCT l_orderkey AS group_id, l_orderkey * 10 + l_linenumber AS file_id, l_linenumber FROM lineitem),
    m AS (SELECT l_orderkey * 10 + l_linenumber AS file_id, max(l_extendedprice) AS sharpness, 1 - min(l_discount) AS exposure, least(1.0, 10 * max(l_tax)) AS contrast FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1),
    r AS (SELECT group_id, file_id, coalesce(sharpness, 0) AS sharpness, coalesce(exposure, 0) AS exposure, coalesce(contrast, 0) AS contrast FROM members LEFT JOIN m USING (file_id)),
    s AS (SELECT *, max(sharpness) OVER (PARTITION BY group_id) AS mx FROM r),
    q AS (SELECT *, round((0.4::DOUBLE * CASE WHEN mx > 0 THEN sharpness / mx ELSE 0 END + 0.3::DOUBLE * exposure + 0.3::DOUBLE * contrast) / (0.4::DOUBLE + 0.3::DOUBLE + 0.3::DOUBLE), 4) AS quality_score FROM s)
    SELECT group_id, file_id, quality_score, row_number() OVER (PARTITION BY group_id ORDER BY quality_score DESC, file_id) = 1 AS is_best_shot FROM q""")
def best_shots(spark, sf_dir):
    """Members beyond the third have no metrics."""
    lines, file_id = table(spark, sf_dir, "lineitem"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file_id")
    members = lines.select(F.col("l_orderkey").alias("group_id"), file_id).distinct()
    found = lines.where("l_linenumber <= 3").groupBy(file_id).agg(F.max("l_extendedprice").alias("sharpness"), (1 - F.min("l_discount")).alias("exposure"), F.least(F.lit(1.0), 10 * F.max("l_tax")).alias("contrast"))
    found = found.withColumns({"eyes_open": F.lit(None).cast("double"), "has_face": F.lit(False)})
    return bestshot.best_shots(members, found).select("group_id", "file_id", "quality_score", "is_best_shot")


@query("similar_clusters", f"""WITH RECURSIVE {SIGNS}, t AS (SELECT *, row_number() OVER (ORDER BY id // 3, id) AS rn, id // 3 * 20.0 AS dt FROM s),
    p AS (SELECT x.id AS a, y.id AS b FROM s x JOIN s y ON x.id < y.id WHERE hamming(x.b, y.b) <= 5 UNION SELECT x.id, y.id FROM t x JOIN t y ON y.rn - x.rn BETWEEN 1 AND 4 AND y.dt - x.dt <= 30 WHERE hamming(x.b, y.b) <= 26),
    e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), reach AS (SELECT DISTINCT a AS id, a AS r FROM e UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.r),
    comp AS (SELECT id, min(r) AS component FROM reach GROUP BY id)
    SELECT comp.component, comp.id AS file_id, round(1 - hamming(s.b, r.b) / 64.0, 4) AS similarity_score FROM comp JOIN s ON s.id = comp.id JOIN s r ON r.id = comp.component""")
def similar_clusters(spark, sf_dir):
    """Both sources of edges: near signatures, and bursts."""
    rows = signatures(spark, sf_dir).withColumn("exif_dt", F.floor(F.col("id") / 3) * F.lit(20.0))
    return similarity.cluster_similar(rows, Config(burst_seconds=30.0, burst_hamming_threshold=26, burst_max_window=4))


# --- pixels ---------------------------------------------------------------------------------------------

GRID = "g AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(abs(x) * 2000) AS BIGINT) % 256) AS v FROM embeddings)"


def _grid(spark, sf_dir, channels):
    """Images of 8 x 8 pixels, one for each embedding: grey, or blue, green and red from one value."""
    # the product keeps the type of the values, as in SQL: a float that is nearly whole may round up to it
    value = F.transform("embedding", lambda x: F.floor(F.abs(x) * F.lit(2000).cast("float")).cast("bigint") % 256)
    of = lambda x: F.concat(*[F.lpad(F.hex(x * k % 256), 2, "0") for k in channels])
    data = F.unhex(F.array_join(F.transform(value, of), ""))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("file_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(len(channels)).alias("nChannels"), data.alias("data"), F.lit(None).cast("int").alias("orientation"))


_AROUND = "g.v[({y}) * 8 + ({x}) + 1]"
_UP, _DOWN = "CASE WHEN i < 8 THEN 1 ELSE i // 8 - 1 END", "CASE WHEN i >= 56 THEN 6 ELSE i // 8 + 1 END"
_LEFT, _RIGHT = "CASE WHEN i % 8 = 0 THEN 1 ELSE i % 8 - 1 END", "CASE WHEN i % 8 = 7 THEN 6 ELSE i % 8 + 1 END"
LAPLACE = " + ".join([_AROUND.format(y=_UP, x="i % 8"), _AROUND.format(y=_DOWN, x="i % 8"), _AROUND.format(y="i // 8", x=_LEFT), _AROUND.format(y="i // 8", x=_RIGHT)]) + " - 4 * g.v[i + 1]"
CELLS = f"c AS (SELECT g.id, g.v[i + 1] AS v, {LAPLACE} AS l FROM g, range(64) r(i))"


@query("pixel_quality", f"""WITH {GRID}, {CELLS} SELECT id AS file_id, round(var_pop(l), 6) AS sharpness, round(greatest(0, 1 - avg(CASE WHEN v < 5 OR v > 250 THEN 1 ELSE 0 END)), 6) AS exposure,
    round(least(1, stddev_pop(v) / 64), 6) AS contrast, CAST(NULL AS DOUBLE) AS eyes_open, false AS has_face FROM c GROUP BY id""")
def pixel_quality(spark, sf_dir):
    found = features.analysis_quality(_grid(spark, sf_dir, [1]))
    return found.select("file_id", *[F.round(c, 6).alias(c) for c in ("sharpness", "exposure", "contrast")], "eyes_open", "has_face")


@query("pixel_analysis", f"""WITH {GRID}, {CELLS} SELECT id AS file_id, 8 AS width, 8 AS height, round(avg(CASE WHEN v > 200 THEN 1 ELSE 0 END), 6) AS white_ratio, round(var_pop(l), 6) AS laplacian, round(avg(v), 6) AS brightness, CAST(NULL AS VARCHAR) AS error FROM c GROUP BY id""")
def pixel_analysis(spark, sf_dir):
    found = features.analyse_images(_grid(spark, sf_dir, [1]))
    return found.select("file_id", "width", "height", *[F.round(c, 6).alias(c) for c in ("white_ratio", "laplacian", "brightness")], "error")


@query("pixel_grey", f"""WITH {GRID}, c AS (SELECT id, unnest(v) AS v FROM g) SELECT id AS file_id, round(avg(round_even((v * 13 % 256) * 0.299::DOUBLE + (v * 7 % 256) * 0.587::DOUBLE + v * 0.114::DOUBLE, 0)), 6) AS brightness FROM c GROUP BY id""")
def pixel_grey(spark, sf_dir):
    return features.analyse_images(_grid(spark, sf_dir, [1, 7, 13])).select("file_id", F.round("brightness", 6).alias("brightness"))
