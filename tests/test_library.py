"""Stages, actions and commands over a small tree of real image files."""

import json
import os
import shutil

import numpy as np
import pytest

from shoebox import cli
from shoebox.operators import features
from shoebox.plans import actions, library
from shoebox.sources.exif import read_exif
from shoebox.sources.sinks import png
from shoebox.sources.store import Store
from shoebox.sources.tree import walk


def noise(seed, h=60, w=80):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3), dtype=np.uint8)


def gradient(h=60, w=80):
    return np.tile(np.linspace(0, 255, w).astype(np.uint8)[None, :, None], (h, 1, 3))


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("photos")
    (root / "sub").mkdir()
    (root / "_날짜미상").mkdir()
    files = {"a.png": png(noise(1)), "sub/copy of a.png": png(noise(1)), "IMG_20220105_090000.png": png(gradient()), "_날짜미상/.hidden.png": png(noise(2)), "broken.jpg": b"\xff\xd8junk", "empty.png": b"", "notes.txt": b"x"}
    for name, data in files.items():
        (root / name).write_bytes(data)
    os.symlink(root / "a.png", root / "link.png")
    return root


def test_walk_lists_hidden_and_empty_but_no_links(spark, tree):
    got = {os.path.relpath(r.path, tree): (r.size, r.format) for r in walk(spark, str(tree)).collect()}
    assert set(got) == {"a.png", "sub/copy of a.png", "IMG_20220105_090000.png", "_날짜미상/.hidden.png", "broken.jpg", "empty.png"}
    assert got["empty.png"] == (0, "png") and got["broken.jpg"][1] == "jpg"
    assert walk(spark, str(tree / "nowhere")).count() == 0


@pytest.fixture(scope="module")
def run(spark, tree, tmp_path_factory):
    home = tmp_path_factory.mktemp("library")
    root = home / "photos"
    shutil.copytree(tree, root, symlinks=True)
    store = Store(spark, str(home / "store"))
    done = library.LibraryRun(store, str(root), str(home / "thumbs")).run()
    return home, root, store, done


def test_library_run(run):
    home, root, store, done = run
    assert done == {"scanned_new": 6, "scanned_updated": 0, "scanned_deleted": 0, "analyzed_ok": 4, "analyzed_err": 2, "duplicate_groups": 1, "similar_groups": 1, "bestshot_groups": 1}
    files = {os.path.relpath(r.path, root): r for r in store.read("files").collect()}
    assert files["a.png"].phash == files["sub/copy of a.png"].phash and files["a.png"].content_hash == files["sub/copy of a.png"].content_hash
    assert files["broken.jpg"].scan_status == "error" and files["broken.jpg"].error_msg and files["_날짜미상/.hidden.png"].scan_status == "analyzed"
    assert os.path.isfile(files["a.png"].thumb_path)
    best = store.read("similar_groups").collect()
    assert sum(r.is_best_shot for r in best) == 1 and json.loads(best[0].quality_detail)["preset"] == "landscape"
    assert store.read("scan_sessions").first().status == "done"


def test_rescan_quarantine_organise_undo(run):
    home, root, store, _ = run
    assert library.scan(store, str(root), deletions=True) == {"new": 0, "updated": 0, "unchanged": 6, "deleted": 0}
    assert library.scan(store, str(home / "photos" / "nothing"), deletions=True)["deleted"] is None
    ids = {os.path.relpath(r.path, root): r.id for r in store.read("files").collect()}
    pair = [ids["a.png"], ids["sub/copy of a.png"]]
    ok, failed, kept = actions.quarantine(store, pair, str(home / "q"))
    assert ok + kept == 2 and failed == 0 and kept >= 1
    if ok == 0:  # representative and best shot differ: both are protected
        ok, failed, kept = actions.quarantine(store, [ids["empty.png"]], str(home / "q"))
    assert ok == 1 and len(os.listdir(home / "q")) == 1
    assert actions.undo_last(store) == 1 and os.listdir(home / "q") == [] and not any(r.removed for r in store.read("files").collect())
    plan = actions.organize_plan(store, str(home / "sorted"))
    moved, skipped, failed, stale = actions.apply_plan(store, plan)
    assert (moved, skipped, failed, stale) == (6, 0, 0, 0)
    assert os.path.isfile(home / "sorted/2022/2022-01/IMG_20220105_090000.png") and os.path.isfile(home / "sorted/_날짜미상/a.png")
    again = actions.apply_plan(store, actions.organize_plan(store, str(home / "sorted")))
    assert again == (0, 6, 0, 0)
    assert actions.undo_last(store) == 6 and os.path.isfile(root / "a.png")
    assert actions.undo_last(store) == 0


def test_commands(spark, tree, tmp_path, capsys):
    at = ["--store", str(tmp_path / "s")]
    assert cli.main([*at, "scan", str(tree / "no")], spark) == 2
    assert cli.main([*at, "scan", str(tree)], spark) == 0 and cli.main([*at, "dedup"], spark) == 0
    assert "redundant files 1" in capsys.readouterr().out
    assert cli.main([*at, "report", "--kind", "all", "--csv", "x"], spark) == 2
    assert cli.main([*at, "report", "--kind", "dup", "--csv", str(tmp_path / "d.csv")], spark) == 0
    text = (tmp_path / "d.csv").read_bytes()
    assert text.startswith(b"\xef\xbb\xbfgroup_id,is_representative,size") and len(text.splitlines()) == 3
    assert cli.main([*at, "report", "--kind", "dup", "--json", str(tmp_path / "d.json")], spark) == 0
    assert len(json.loads((tmp_path / "d.json").read_text())) == 2
    assert cli.main([*at, "organize", "--dest", str(tmp_path / "o")], spark) == 0 and "unknown" in capsys.readouterr().out


def test_report_has_heads_and_totals(run, capsys):
    home = run[0]
    assert cli.main(["--store", str(home / "store"), "report", "--kind", "all"], run[2].spark) == 0
    out = capsys.readouterr().out
    assert "[중복 1] size=" in out and out.count("★ 대표") == 1 and "완전중복: 1 groups, 2 rows" in out
    assert "[유사 1]" in out and out.count("⭐ 베스트") == 1 and "유사도 " in out and "유사그룹: 1 groups" in out and "작업 이력: " in out


def test_run_reports_its_failure(spark, tmp_path):
    heard = []
    store = Store(spark, str(tmp_path / "s"))
    (tmp_path / "file").write_text("x")
    broken = library.LibraryRun(store, str(tmp_path), str(tmp_path / "file" / "thumbs"), progress=lambda stage: 1 / 0, failed=heard.append)
    assert broken.run() is None and heard == ["division by zero"]
    broken.failed = None
    with pytest.raises(ZeroDivisionError):
        broken.run()


def test_default_folders():
    from shoebox import places

    assert places.data_dir("win32", {"APPDATA": "/r"}, "/h") == "/r/shoebox" and places.data_dir("win32", {}, "/h") == "/h/shoebox"
    assert places.data_dir("darwin", {}, "/h") == "/h/Library/Application Support/shoebox"
    assert places.data_dir("linux", {"XDG_DATA_HOME": "/x"}, "/h") == "/x/shoebox" and places.data_dir("linux", {}, "/h") == "/h/.local/share/shoebox"


def test_decoders_run_on_executors(spark, tmp_path):
    """A plug-in reads its own formats; what it refuses or breaks on has no pixels, and other files go to the image source."""
    from shoebox.sources.images import exif_summary, load_images

    image = noise(7, 4, 6)
    for name in ("a.heic", "b.nef", "_c.png", "d.heic"):
        (tmp_path / name).write_bytes(png(image) if name.endswith("png") else name.encode())

    def decode(path):
        if path.endswith("d.heic"):
            raise ValueError("broken")
        return (4, 6, image.tobytes()) if path.endswith(".heic") else None

    files = spark.createDataFrame([(i, str(tmp_path / n)) for i, n in ((1, "a.heic"), (2, "b.nef"), (5000, "_c.png"), (4, "d.heic"), (6, "none.heif"))], "id long, path string")
    decoders = {".heic": decode, ".nef": decode}
    got = {r.file_id: r for r in load_images(spark, files, decoders).collect()}
    assert set(got) == {1, 2, 4, 5000, 6} and got[1].data == got[5000].data and got[2].make == "RAW"
    assert all(got[i].data is None for i in (2, 4, 6))
    assert (features.pixels(4, 6, 3, bytes(got[1].data)) == image).all()
    assert {r.file_id: r.width for r in exif_summary(spark, files, decoders).collect()} == {1: 6, 2: None, 4: None, 5000: 6, 6: None}
    assert load_images(spark, files.where("id IN (1, 4)")).where("data IS NULL").count() == 2


def test_kernels():
    flat, sharp = np.full((200, 200), 180, np.uint8), features.to_gray(noise(3, 200, 200))
    assert features.laplacian_variance(flat) == 0 < 100 < features.laplacian_variance(sharp)
    assert features.white_ratio(np.full((9, 9), 255, np.uint8)) == 1 and features.exposure(np.full((9, 9), 255, np.uint8)) == 0 and features.exposure(flat) == 1
    assert features.contrast(flat) == 0 and features.contrast(np.repeat(np.array([[0, 255]], np.uint8), 9, axis=0)) == 1
    page = np.full((200, 200), 255, np.uint8)
    page[20:180, 20:24] = page[20:24, 20:180] = page[60:64, 40:160] = page[100:104, 40:160] = 0
    assert features.edge_density(page) > 0.02 > features.edge_density(flat) == 0
    big = features.to_gray(gradient(300, 400))
    near = features.to_gray(gradient(150, 200))
    far = features.to_gray(gradient(400, 300).transpose(1, 0, 2))
    bits = lambda a, b: (int(features.phash(a), 16) ^ int(features.phash(b), 16)).bit_count()
    assert bits(big, near) <= 5 < bits(big, far) and len(features.dhash(big)) == 16
    assert features.oriented(noise(1, 40, 20), 6).shape == (20, 40, 3) and features.thumbnail(noise(1, 300, 600), 256).shape == (128, 256, 3)


def exif_jpeg(order="<"):
    import struct

    text = b"2023:04:12 10:00:00\0"
    entries = [(0x010F, 2, 4, b"Cam\0"), (0x0112, 3, 1, struct.pack(order + "HH", 6, 0)), (0x0132, 2, len(text), struct.pack(order + "I", 8 + 2 + 36 + 4))]
    body = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + struct.pack(order + "H", 3)
    body += b"".join(struct.pack(order + "HHI", t, k, n) + v for t, k, n, v in entries) + struct.pack(order + "I", 0) + text
    app1 = b"Exif\0\0" + body
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xd9"


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif(order):
    assert read_exif(exif_jpeg(order)) == {"make": "Cam", "model": None, "dt_raw": "2023:04:12 10:00:00", "orientation": 6}
    for bad in (None, b"", b"\xff\xd8\xff\xe1", exif_jpeg(order)[:30], b"II*\0\xff\xff\xff\xff"):
        assert set(read_exif(bad).values()) <= {None, "Cam", 6}


def test_streaming_upsert(spark, tmp_path):
    from shoebox.streaming.watch import follow

    source = tmp_path / "in"
    spark.createDataFrame([("/r/a", 1, 1.0, "jpg"), ("/r/b", 1, 1.0, "jpg")], "path string, size long, mtime double, format string").write.parquet(str(source))
    stream = spark.readStream.schema("path string, size long, mtime double, format string").parquet(str(source))
    store = Store(spark, str(tmp_path / "store"))
    follow(stream, store, str(tmp_path / "ck")).awaitTermination()
    assert {r.path for r in store.read("files").collect()} == {"/r/a", "/r/b"}


def test_exif_far_into_a_file(spark, tmp_path):
    """A TIFF directory behind the pixels, and a JPEG's APP1 behind other segments, both beyond 256 KiB."""
    import struct

    from pyspark.sql import functions as F

    from shoebox.sources.exif import exif

    far = 8 + 400_000
    entries = struct.pack("<HHII", 0x010F, 2, 4, int.from_bytes(b"Cam\0", "little")) + struct.pack("<HHII", 0x0112, 3, 1, 6) + struct.pack("<HHII", 0x0132, 2, 20, far + 2 + 36 + 4)
    tiff = b"II*\0" + struct.pack("<I", far) + bytes(400_000) + struct.pack("<H", 3) + entries + bytes(4) + b"2023:04:12 10:00:00\0"
    jpeg = exif_jpeg("<")
    jpeg = jpeg[:2] + (b"\xff\xe2" + struct.pack(">H", 60_000) + bytes(59_998)) * 6 + jpeg[2:]
    for name, content in (("a.tif", tiff), ("b.jpg", jpeg)):
        (tmp_path / name).write_bytes(content)
    paths = [(1, str(tmp_path / "a.tif")), (2, str(tmp_path / "b.jpg")), (3, str(tmp_path / "none.jpg")), (4, None)]
    got = {r.id: tuple(r.e) for r in spark.createDataFrame(paths, "id int, path string").select("id", exif(F.col("path")).alias("e")).collect()}
    assert got[1] == got[2] == ("Cam", None, "2023:04:12 10:00:00", 6)
    assert got[3] == got[4] == (None, None, None, None)


def test_store_commits_are_whole(spark, tmp_path):
    """A commit that doesn't get its name changes nothing; appends add parts; tables change together."""
    store = Store(spark, str(tmp_path / "store"))
    assert store.read("files").count() == 0
    store.write("files", spark.createDataFrame([(1, "/a")], "id long, path string"))
    for batch in (1, 2, 3):
        store.record_actions(batch, [(1, "move", "/a", f"/b{batch}")])
    assert len(store.current("action_log")) == 3 and [r.id for r in store.read("action_log").orderBy("id").collect()] == [1, 2, 3]
    before = store._state()
    taken = before[0] + 1
    (tmp_path / "store" / "_commits" / f"{taken:012d}.tmp").write_text("a writer that died")
    store._part("files", spark.createDataFrame([(9, "/never")], "id long, path string"))
    assert store._state() == before and [r.path for r in store.read("files").collect()] == ["/a"]
    with pytest.raises(RuntimeError):
        store._commit(before[0], {})
    store.reset()
    assert store.read("files").count() == 0 and store.read("action_log").count() == 0
    store.vacuum()
    assert len(store._commits()) == 1 and store.read("files").count() == 0


def test_recover_brings_files_up_to_the_log(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.write("files", spark.createDataFrame([(1, "/a"), (2, "/b"), (3, "/c")], "id long, path string"))
    store.record_actions(1, [(1, "move", "/a", "/d/a"), (2, "move", "/b", "/a")])
    assert actions.recover(store) == 2 and actions.recover(store) == 0
    assert {r.id: r.path for r in store.read("files").collect()} == {1: "/d/a", 2: "/a", 3: "/c"}
    store.record_actions(2, [(3, "trash", "/c", None)])
    assert actions.recover(store) == 1 and {r.id for r in store.read("files").where("removed").collect()} == {3}


def test_face_detector_runs_on_executors(spark):
    image = noise(5, 8, 8)
    df = spark.createDataFrame([(1, 8, 8, 3, bytearray(image.tobytes()))], "file_id long, height int, width int, nChannels int, data binary")
    row = features.analysis_quality(df, lambda gray: (True, 0.5)).first()
    assert row.has_face is True and row.eyes_open == 0.5 and features.analysis_quality(df).first().has_face is False
