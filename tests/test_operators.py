"""Operators on small hand-made tables."""

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from shoebox.config import Config
from shoebox.functions import dates, paths, signature
from shoebox.operators import bestshot, classify, dedup, graph, merge, organize, protect, reports, similarity
from shoebox.schema import FILES, conform


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("threshold", [0, 3, 8, 12])
def test_hamming_pairs_are_complete(spark, threshold):
    rows = [(i, (i * 2654435761) & 0xFFFFFFFF) for i in range(80)]
    got = {(r.a, r.b): r.distance for r in similarity.hamming_pairs(frame(spark, rows, "id long, h long"), threshold, 32).collect()}
    want = {(a, b): (x ^ y).bit_count() for (a, x), (b, y) in itertools.combinations(rows, 2) if (x ^ y).bit_count() <= threshold}
    assert got == want


def test_hamming_pairs_of_short_signatures(spark):
    df = frame(spark, [(1, 0), (2, 1), (3, 0xFFFF)], "id long, h long")
    assert [(r.a, r.b) for r in similarity.hamming_pairs(df, 2, 16).collect()] == [(1, 2)]
    assert similarity.hamming_pairs(df, -1, 16).count() == 0


def test_negative_signatures_and_hex(spark):
    df = frame(spark, [("ffffffffffffffff", "0000000000000000", 64), ("0f", "00", 4), ("00", "01", 1), ("zz", "00", None)], "a string, b string, n int")
    assert all(r.n == r.d for r in df.withColumn("d", signature.hamming_hex(F.col("a"), F.col("b"))).collect())
    back = frame(spark, [("ff00000000000001",)], "h string").select(signature.bigint_to_hex(signature.hex_to_bigint(F.col("h"))).alias("h"))
    assert back.first().h == "ff00000000000001"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def cluster(spark, rows, **cfg):
    df = frame(spark, [(i, signed(h), t) for i, h, t in rows], "id long, h long, exif_dt double")
    return similarity.cluster_similar(df, Config(**cfg)).collect()


def test_burst_joins_near_moments(spark):
    assert {r.file_id for r in cluster(spark, [(1, 0, 1000.0), (2, 0xFF, 1001.0)])} == {1, 2}
    assert cluster(spark, [(1, 0, 1000.0), (2, 0xFF, 9999.0)]) == []
    assert cluster(spark, [(1, 0, 1000.0), (2, (1 << 64) - 1, 1001.0)]) == []


def test_dense_burst_is_one_component(spark):
    h, rows = 0, []
    for i in range(250):
        rows.append((i, h, 1000.0))
        h ^= 0xFF << ((i * 8) % 56)
    got = cluster(spark, rows)
    assert len(got) == 250 and {r.component for r in got} == {0}


def test_burst_window_counts_every_row(spark):
    rows = [(i, 0 if i in (0, 4) else 1 << i, 5.0) for i in range(5)]
    pairs = similarity.burst_pairs(frame(spark, rows, "id long, h long, dt double"), 3.0, 0, 3)
    assert (0, 4) not in {(r.a, r.b) for r in pairs.collect()}


def test_components_of_a_long_chain_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 500), (700, 600), (600, 700), (None, 3)]
    got = {r.id: r.component for r in graph.connected_components(frame(spark, edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 600: 600, 700: 600}
    assert graph.connected_components(frame(spark, [], "src long, dst long")).count() == 0


def test_a_star_settles_in_one_round(spark, monkeypatch):
    written = []
    real = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: written.append(name) or real(df, name))
    star = spark.range(1, 500).selectExpr("0L AS src", "id AS dst")
    assert {r.component for r in graph.connected_components(star).collect()} == {0} and written.count("cc-step") == 1


def duplicates(spark, rows, prefilter=True):
    df = frame(spark, [(i, p, len(b), b) for i, (p, b) in enumerate(rows)], "id long, path string, size long, content binary")
    found = dedup.find_duplicates(df, F.sha2(F.substring("content", 1, 4), 256), F.sha2("content", 256), prefilter)
    return {(r.path, r.group_id, r.is_representative) for r in dedup.group_duplicates(found).collect()}


@pytest.mark.parametrize("prefilter", [True, False])
def test_staged_duplicates(spark, prefilter):
    rows = [("a", b"same"), ("b", b"same"), ("deep/er/c", b"same"), ("d", b"samf"), ("e", b"longer text"), ("f", b"longer texT"), ("g", b""), ("h", b""), ("deep/x", b"twotwo"), ("top", b"twotwo")]
    assert duplicates(spark, rows, prefilter) == {("a", 1, True), ("b", 1, False), ("deep/er/c", 1, False), ("top", 2, True), ("deep/x", 2, False)}


def test_unreadable_files_drop_out(spark):
    df = frame(spark, [(1, "a", 3), (2, "b", 3)], "id long, path string, size long")
    assert dedup.find_duplicates(df, F.lit(None).cast("string"), F.lit("x")).count() == 0


METRICS = "group_id long, file_id long, sharpness double, exposure double, contrast double, eyes_open double, has_face boolean"


def test_scores_renormalise_missing_metrics(spark):
    rows = [(1, 1, 500.0, 0.9, 0.5, None, False), (1, 2, 50.0, 0.9, 0.5, None, False), (2, 3, 100.0, 0.8, 0.7, None, True), (3, 4, 0.0, 0.2, 0.1, 1.0, True)]
    got = {r.file_id: r for r in bestshot.score_groups(frame(spark, rows, METRICS)).collect()}
    assert got[1].is_best_shot and not got[2].is_best_shot and "선명도 1위" in got[1].reason and got[2].reason == "노출 양호"
    assert got[3].preset == "person" and 0 <= got[3].quality_score <= 1 and got[3].quality_score == round((0.3 + 0.16 + 0.07) / 0.6, 4)
    assert got[4].quality_score == 0.45


def test_scores_without_weights_and_ties(spark):
    cfg = Config(quality_presets={"person": {}, "landscape": {}})
    rows = [(1, 7, 1.0, 0.5, 0.3, None, False), (1, 5, 1.0, 0.5, 0.3, None, False)]
    got = {r.file_id: r for r in bestshot.detail_json(bestshot.score_groups(frame(spark, rows, METRICS), cfg)).collect()}
    assert got[5].is_best_shot and got[5].quality_score == 0.6 and '"eyes_open":null' in got[5].quality_detail


def test_classification_order(spark):
    schema = "id int, name string, make string, model string, width int, height int, white_ratio double, edge_density double, laplacian double, brightness double"
    rows = [
        (1, "Screenshot 1.png", None, None, 1, 1, 0.0, 0.0, 500.0, 100.0), (2, "scr_1.png", "C", None, 1, 1, 0.0, 0.0, 500.0, 100.0), (3, "a.png", None, None, 1080, 1920, 0.0, 0.0, 5.0, 100.0),
        (4, "a.png", "C", None, 1080, 1920, 0.9, 0.1, 5.0, 100.0), (5, "a.png", None, "M", 5, 5, 0.0, 0.0, 5.0, 10.0), (6, "a.png", None, "", 5, 5, 0.6, 0.0, 500.0, 10.0),
    ]
    got = {r.id: (r.category, r.category_confidence) for r in classify.classify(frame(spark, rows, schema)).collect()}
    assert got == {1: ("screenshot", 0.95), 2: ("screenshot", 0.75), 3: ("screenshot", 0.7), 4: ("document", 0.8), 5: ("blurry", 0.4), 6: ("normal", 0.6)}


def test_dates_from_names(spark):
    good = ["IMG_20230412_183000.jpg", "VID_20230412_183000.mp4", "PXL_20230412_183000123.jpg", "KakaoTalk_20230412_183000.jpg", "IMG-20230412-WA0001.jpg", "Screenshot 2023-04-12 at 18.30.00.png", "2023-04-12 18.30.00.jpg", "20230412_183000.jpg", "2023_04_12.jpg", "2023.04.12.jpg", "20231345_20230412.jpg"]
    bad = ["12345678901234.jpg", "20231345_1200.jpg", "20230230_1200.jpg", "18990101_1200.jpg", "DSC_0001.jpg", "2023-0412.jpg"]
    df = frame(spark, [(n,) for n in good + bad], "name string")
    got = {r.name: r.d and r.d.isoformat() for r in df.withColumn("d", dates.date_from_name(F.col("name"), F.to_date(F.lit("2024-01-01")))).collect()}
    assert all(got[n] == "2023-04-12" for n in good) and all(got[n] is None for n in bad)


def test_wrong_exif_gives_way_to_the_name(spark):
    rows = [(0.0,), (4102444800.0,), (-2208988800.0,), (1e300,), (None,)]
    day, source = dates.resolve_date(F.col("x"), F.lit("IMG_20230412_1.jpg"), F.to_date(F.lit("2024-01-01")))
    assert {(r.d.isoformat(), r.s) for r in frame(spark, rows, "x double").select(day.alias("d"), source.alias("s")).collect()} == {("2023-04-12", "filename")}
    labels = frame(spark, [(" 2023:04:12 10:00:00 ",), ("nonsense",), (None,)], "t string").select(dates.time_label(dates.exif_epoch(F.col("t"))).alias("l"))
    assert [r.l for r in labels.collect()] == ["2023-04-12 10:00:00", "", ""]


def test_path_functions(spark):
    names = {"a/B.JPG": (".jpg", "B"), "a/.hidden": ("", ".hidden"), "a/x.tar.gz": (".gz", "x.tar"), "a/none": ("", "none")}
    p = F.col("p")
    got = {r.p: (r.e, r.s) for r in frame(spark, [(n,) for n in names], "p string").select("p", paths.extension(p).alias("e"), paths.stem(paths.basename(p)).alias("s")).collect()}
    assert got == names
    sizes = frame(spark, [(0, "-"), (None, "-"), (512, "512 B"), (2048, "2.0 KB"), (5 << 20, "5.0 MB"), (3 << 40, "3072.0 GB")], "n long, want string")
    assert all(r.want == r.got for r in sizes.withColumn("got", paths.human_size(F.col("n"))).collect())
    assert paths.long_path("C:\\" + "a" * 300, "win32").startswith("\\\\?\\C:") and paths.long_path("\\\\srv\\" + "a" * 300, "win32").startswith("\\\\?\\UNC\\srv") and paths.long_path("/" + "a" * 300, "linux") == "/" + "a" * 300
    skip = frame(spark, [("/v/.Trashes/a.jpg", True), ("/v/a.jpg", False)], "p string, want boolean")
    assert all(r.want == r.got for r in skip.withColumn("got", paths.in_system_folder(p, "darwin")).collect())


def library(spark, rows):
    return conform(frame(spark, rows, "id long, path string, size long, mtime double, missing boolean, removed boolean, phash string"), FILES)


def test_upsert_states(spark):
    old = library(spark, [(1, "/r/same", 10, 1.0, True, False, "aa"), (2, "/r/size", 10, 1.0, False, True, "bb"), (3, "/r/time", 10, 1.0, False, False, "cc"), (4, "/r/left", 10, 1.0, False, False, "dd")])
    seen = frame(spark, [("/r/same", 10, 1.0, "jpg"), ("/r/size", 11, 1.0, "jpg"), ("/r/time", 10, 2.0, "jpg"), ("/r/z", 1, 1.0, "jpg"), ("/r/y", 1, 1.0, "jpg")], "path string, size long, mtime double, format string")
    got = {r.path: r for r in merge.upsert(old, seen).collect()}
    assert got["/r/same"].phash == "aa" and not got["/r/same"].missing
    assert got["/r/size"].phash is None and got["/r/size"].size == 11 and got["/r/size"].removed and got["/r/size"].scan_status == "discovered"
    assert got["/r/time"].phash is None and got["/r/left"].phash == "dd"
    assert (got["/r/y"].id, got["/r/z"].id) == (5, 6)
    assert merge.summary(merge.diff(old, seen)).first().asDict() == {"new": 2, "updated": 2, "unchanged": 1, "deleted": None}
    assert [r.path for r in merge.vanished(old, seen, "/r").collect()] == ["/r/left"]
    assert merge.detect_deletions(old, seen.where("false"), "/r") is None


def test_deletions_stay_below_the_root(spark):
    old = library(spark, [(1, "/rootA/x", 1, 1.0, False, False, None), (2, "/rootA/sub/y", 1, 1.0, False, False, None), (3, "/rootB/z", 1, 1.0, False, False, None)])
    seen = frame(spark, [("/rootA/x", 1, 1.0, "jpg")], "path string, size long, mtime double, format string")
    assert [r.id for r in merge.vanished(old, seen, "/rootA/").collect()] == [2]


def test_path_conflicts(spark):
    old = library(spark, [(1, "/p/a", 1, 1.0, False, False, None), (2, "/s/a", 1, 1.0, False, False, None), (3, "/s/b", 1, 1.0, True, False, None), (4, "/p/b", 1, 1.0, False, False, None), (5, "/p/c", 1, 1.0, False, False, None)])
    judged = merge.path_updates(old, frame(spark, [(1, "/s/a", 0), (4, "/s/b", 1), (5, "/s/c", 2)], "id long, new_path string, seq long"))
    assert {(r.id, r.outcome) for r in judged.collect()} == {(1, "conflict"), (4, "replaces"), (5, "moved")}
    groups = frame(spark, [(1, 3), (1, 4)], "group_id long, file_id long")
    files, left = merge.apply_path_updates(old, judged, {"g": groups})
    assert {(r.id, r.path) for r in files.collect()} == {(1, "/p/a"), (2, "/s/a"), (4, "/s/b"), (5, "/s/c")}
    assert [r.file_id for r in left["g"].collect()] == [4]


def test_nfc_migration(spark):
    import unicodedata

    name = "/root/한글.jpg"
    old = library(spark, [(1, unicodedata.normalize("NFD", name), 1, 1.0, False, False, None), (2, name, 1, 1.0, False, False, None), (3, "/root/a", 1, 1.0, False, False, None)])
    files, left = merge.migrate_nfc(old, {"g": frame(spark, [(1, 1), (1, 2)], "group_id long, file_id long")})
    assert {(r.id, r.path) for r in files.collect()} == {(2, name), (3, "/root/a")} and [r.file_id for r in left["g"].collect()] == [2]


def test_protection(spark):
    files = library(spark, [(1, "a", 1, 1.0, False, False, None), (2, "b", 1, 1.0, False, False, None), (3, "c", 1, 1.0, False, True, None)])
    dups = frame(spark, [(1, 1, True), (1, 2, False), (1, 3, False)], "group_id long, file_id long, is_representative boolean")
    sims = frame(spark, [(1, 1, False), (1, 2, True)], "group_id long, file_id long, is_best_shot boolean")
    ids = lambda *x: frame(spark, [(i,) for i in x], "id long")
    both = protect.protected_survivors(dups, sims, files, ids(1, 2))
    assert {r.id for r in both.collect()} == {1, 2}
    assert protect.protected_survivors(dups, sims, files, ids(2)).count() == 0
    assert {r.id for r in protect.targets(ids(1, 2), protect.protected_in(dups, files, ids(1, 2), "is_representative")).collect()} == {2}
    assert protect.collapse_duplicates(sims, dups).count() == 0


def test_organize_plan(spark):
    rows = [(1, "/photos/exif.jpg", 1681293600.0, False, False), (2, "/photos/IMG_20220105_090000.jpg", None, False, False), (3, "/photos/DSC_0001.jpg", None, False, False), (4, "/s/2022/2022-01/IMG_20220105_1.jpg", None, False, False), (5, "/photos/gone.jpg", None, True, False)]
    plan = organize.plan(frame(spark, rows, "id long, path string, exif_dt double, missing boolean, removed boolean"), "/s", as_of="2024-01-01")
    got = {r.file_id: (r.dest_dir, r.source, r.skip) for r in plan.collect()}
    assert got == {1: ("/s/2023/2023-04", "exif", False), 2: ("/s/2022/2022-01", "filename", False), 3: ("/s/_날짜미상", "unknown", False), 4: ("/s/2022/2022-01", "filename", True)}
    assert organize.months(plan, 1).first().asDict() == {"month": "2022-01", "n": 1, "more": 2}


def test_views(spark):
    files = library(spark, [(1, "/a/one.jpg", 1, 1.0, False, False, None), (2, "/a/two.jpg", 1, 1.0, False, False, None), (3, "/a/three.jpg", 1, 1.0, False, False, None)])
    dups = frame(spark, [(1, 2, False), (1, 1, True)], "group_id long, file_id long, is_representative boolean")
    view = reports.duplicate_view(dups, files).first()
    assert view.title == "완전 중복 그룹 1 · 2장" and [i.file_id for i in view["items"]] == [1, 2] and view["items"][0].label == "★ 대표\none.jpg"
    sims = frame(spark, [(9, 1, 1.0, 0.5, False, "{}"), (9, 2, 0.9, 0.8, True, "{}"), (9, 3, 0.9, 0.7, True, '{"reason":"r"}')], "group_id long, file_id long, similarity_score double, quality_score double, is_best_shot boolean, quality_detail string")
    view = reports.similar_view(sims, dups, files).first()
    assert [i.file_id for i in view["items"]] == [3, 1] and view["items"][0].reason == "r"


def test_config(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text("[thresholds]\nhamming_threshold = 7\nblur_laplacian_threshold = 80.0\nunknown = 1\nscreenshot_resolutions = [[1, 2]]\n")
    c = Config.load(f)
    assert (c.hamming_threshold, c.blur_laplacian_threshold, c.screenshot_resolutions) == (7, 80.0, ((1, 2),))
    assert Config.load(tmp_path / "none") == Config() == Config.from_dict(Config().to_dict())


def test_path_updates_equal_row_by_row(spark):
    """Chains of moves in all orders, dead holders and contested paths, against one move after the other."""
    import random

    rnd = random.Random(21)
    for _ in range(6):
        n = 24
        rows = [(i, f"/p/{i}", rnd.random() < 0.2) for i in range(n)]
        movers = rnd.sample(range(n), 16)
        moves = [(i, f"/p/{rnd.choice([rnd.randrange(n), (i + 1) % n, 100 + rnd.randrange(4)])}", seq) for seq, i in enumerate(movers)]
        where, dead, want = {p: i for i, p, _ in rows}, {i for i, _, gone in rows if gone}, {}
        for i, to, _ in moves:
            holder = where.get(to)
            if holder is not None and holder != i and holder not in dead:
                want[i] = "conflict"
                continue
            want[i] = "moved" if holder is None or holder == i else "replaces"
            old = next((p for p, h in where.items() if h == i), None)
            if old is not None:
                del where[old]
            where[to] = i
        files = frame(spark, [(i, p, False, gone) for i, p, gone in rows], "id long, path string, missing boolean, removed boolean")
        live = [m for m in moves if m[0] not in {i for i, _, gone in rows if gone}]
        if len(live) < len(moves):  # a removed file doesn't move: judge the live ones alone
            where, want = {p: i for i, p, _ in rows}, {}
            for i, to, _ in live:
                holder = where.get(to)
                if holder is not None and holder != i and holder not in dead:
                    want[i] = "conflict"
                    continue
                want[i] = "moved" if holder is None or holder == i else "replaces"
                where = {p: h for p, h in where.items() if h != i} | {to: i}
        got = {r.id: r.outcome for r in merge.path_updates(files, frame(spark, live, "id long, new_path string, seq long")).collect()}
        assert got == want


def test_hamming_pairs_at_all_thresholds(spark):
    import random

    rnd = random.Random(22)
    base = [rnd.getrandbits(64) for _ in range(6)]
    values = [b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 9))) for b in base for _ in range(12)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = frame(spark, list(enumerate(signed)), "id long, h long")
    for threshold in (0, 1, 2, 5, 9, 18):
        want = sorted((a, b, (values[a] ^ values[b]).bit_count()) for a in range(len(values)) for b in range(a + 1, len(values)) if (values[a] ^ values[b]).bit_count() <= threshold)
        for near in (0, 1):
            assert sorted((r.a, r.b, r.distance) for r in similarity.hamming_pairs(df, threshold, near=near).collect()) == want
    assert similarity.cheaper_near(1000, 5) == 0 and similarity.cheaper_near(10_000_000, 5) == 1


def test_scratch_needs_a_shared_folder_on_a_cluster():
    import types

    from shoebox.operators.scratch import checkpoint_root

    nothing = types.SimpleNamespace(get=lambda *a: None)
    for master, fails in (("spark://host:7077", True), ("local-cluster[2,1,512]", True), ("local[2]", False)):
        context = types.SimpleNamespace(master=master, getConf=lambda: nothing)
        session = types.SimpleNamespace(conf=nothing, sparkContext=context)
        if fails:
            with pytest.raises(RuntimeError):
                checkpoint_root(session)
        else:
            assert checkpoint_root(session)


@pytest.mark.parametrize("block", [40, 1000])
@pytest.mark.parametrize("threshold", [9, 18, 24])
def test_dense_edges_connect_what_pairs_connect(spark, threshold, block):
    """Many small components, one large one with some outside, and one of all; in one block and in several."""
    rows = [(i, int.from_bytes(hashlib.sha256(b"%d" % (i // 2 if i % 3 else i)).digest()[:8], "big", signed=True) ^ i % 7) for i in range(260)]
    df = frame(spark, rows, "id long, h long").dropDuplicates(["h"])
    firsts = [(r.id, r.h) for r in df.collect()]
    edges = [(a, b) for (a, x), (b, y) in itertools.combinations(firsts, 2) if ((x ^ y) & (1 << 64) - 1).bit_count() <= threshold]
    want = {r.id: r.component for r in graph.connected_components(frame(spark, edges, "src long, dst long")).collect()}
    found = similarity.dense_edges(frame(spark, firsts, "id long, h long"), threshold, block)
    assert {r.id: r.component for r in graph.connected_components(found).collect()} == want


def test_edges_of_wide_thresholds_take_no_pair_join(spark, monkeypatch):
    """At 18 of 64 bits the bands would join nearly all pairs; at 5 they are used."""
    used = []
    plain = similarity.hamming_pairs
    monkeypatch.setattr(similarity, "hamming_pairs", lambda *a: used.append(a[1]) or plain(*a))
    df = frame(spark, [(1, 0), (2, 1), (3, -1), (4, 0)], "id long, h long")
    for threshold in (18, 5):
        assert {(r.src, r.dst) for r in similarity.similar_edges(df, threshold).collect()} == {(1, 2), (1, 4)}
    assert used == [5]


def test_blocks_give_stars_that_settle_in_few_rounds(spark, monkeypatch):
    """Signatures in a chain, each a bit from the next, with repeats: a block's edges are stars, whose repeats hang one step further."""
    rows = [(i, (1 << i) - 1) for i in range(60)] + [(100 + i, (1 << i) - 1) for i in range(0, 60, 7)]
    df = frame(spark, rows, "id long, h long")
    assert {r.src for r in similarity.dense_edges(df.where("id < 100"), 18).collect()} == {0}
    rounds, plain = [], graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: rounds.append(name) or plain(df, name))
    got = {r.id: r.component for r in graph.connected_components(similarity.similar_edges(df, 18)).collect()}
    assert got == {i: 0 for i, _ in rows} and rounds.count("cc-step") == 2
