"""GIF media and sharding."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from shoebox.llm import gif_media as g
from shoebox.llm import sharding


def test_lzw_round_trips():
    rnd = random.Random(1)
    for n in (1, 2, 255, 5000, 80_000):
        for data in (bytes(rnd.choices(range(256), k=n)), bytes(n), (b"abc" * n)[:n]):
            assert g.lzw_decode(g.lzw_encode(data), 8, n) == data
    four = bytes(rnd.choices(range(4), k=3000))
    assert g.lzw_decode(g.lzw_encode(four, 2), 2, 3000) == four


def test_deferred_clear_code():
    """A stream that never clears its full table."""
    rnd = random.Random(2)
    data = bytes(rnd.choices(range(256), k=9000))
    codes, table, prefix = [256], {bytes([i]): i for i in range(256)}, b""
    for b in data:
        if prefix + bytes([b]) in table:
            prefix += bytes([b])
            continue
        codes.append(table[prefix])
        if len(table) + 2 < 4096:
            table[prefix + bytes([b])] = len(table) + 2
        prefix = bytes([b])
    codes += [table[prefix], 257]
    schedule, _ = g._width_schedule(8)
    widths = np.r_[9, schedule, np.full(len(codes), 12)][: len(codes)]
    assert g.lzw_decode(g.pack_codes(np.array(codes, np.uint16), widths), 8, len(data)) == data


PALETTE = np.array([[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]], np.uint8)


def test_disposal_transparency_and_time():
    a, b = np.full((2, 2), 1, np.uint8), np.array([[2, 3]], np.uint8)
    media = g.encode_gif([a, b, b, b], PALETTE, [5, 10, 20, 40], disposals=[1, 2, 3, 1], transparents=[None, 3, 3, None], offsets=[(0, 0), (0, 0), (1, 0), (1, 0)], size=(2, 2))
    f = list(g.decode_gif(media))
    assert [(x.start_ms, x.duration_ms) for x in f] == [(0, 50), (50, 100), (150, 200), (350, 400)]
    red, green, blue, black = ([255, 0, 0], [0, 255, 0], [0, 0, 255], [0, 0, 0])
    assert f[0].pixels.tolist() == [[red, red], [red, red]]
    assert f[1].pixels.tolist() == [[green, red], [red, red]]  # the transparent pixel shows what was there
    assert f[2].pixels.tolist() == [[black, black], [green, red]]  # the frame before was restored to background
    assert f[3].pixels.tolist() == [[black, black], [green, blue]]  # and this one to what was there before it


def test_interlaced_and_broken():
    rows = np.arange(11, dtype=np.uint8)[:, None].repeat(3, axis=1)
    media = bytearray(g.encode_gif([rows[g._rows_of_interlaced(11)]], g.GREYS, [0]))
    at = media.index(b"\x2c", 13 + 768)
    media[at + 9] |= 0x40
    assert (next(g.decode_gif(bytes(media))).samples == rows).all()
    for bad in (b"", b"GIF89a", bytes(media[: at + 20]), b"PNG" + bytes(media)):
        with pytest.raises((g.GifError, IndexError)):
            if not list(g.decode_gif(bad)):
                raise g.GifError("nothing")


def test_frames_table(spark):
    good = g.store_bytes(g.pad_payload(b"hello"))
    df = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"junk")), (4, bytearray(b"GIF89a" + b"\xff" * 4 + bytes(20))), (5, bytearray(good[:-9]))], "media_id long, media binary")
    got = {r.media_id: r for r in g.gif_frames(df).collect()}
    assert got[1].error is None and (got[1].width, got[1].height, sum(got[1].histogram)) == (64, 1, 64) and got[2].error and got[3].error and "over" in got[4].error and got[5].error


def test_media_columns(odd, odd_rows):
    rows = g.media_columns(odd).collect()
    texts = collections.Counter((i, g.pad_payload((t or "").encode())) for i, t in odd_rows)
    assert collections.Counter((r.doc_id, r.payload_sha256, r.tail_crc32, r.payload_bytes) for r in rows) == {(i, hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(p)): n for (i, p), n in texts.items()}
    assert all(r.n_bytes <= r.payload_bytes and r.payload_bytes % 64 == 0 and r.payload_bytes > 0 for r in rows)


def test_shards(odd, odd_rows):
    rows = sharding.shard_rows(odd, shards=4).collect()
    assert len(rows) == len(odd_rows)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    texts = {i: t or "" for i, t in odd_rows if i is not None}
    for r in rows:
        if r.doc_id is not None:
            raw = texts[r.doc_id].encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    by_text = collections.defaultdict(set)
    for r in rows:
        by_text[(r.size, r.text_crc32)].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())


def test_shards_number_groups_of_one_size(spark):
    """Many groups of equal size, dealt over many partitions: whole groups, gapless slots, near equal bytes."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', lpad(cast(id % 1500 AS string), 4, '0')) AS text").repartition(7)
    rows = sharding.shard_rows(docs, shards=5).collect()
    home, slots = {}, collections.defaultdict(list)
    for r in rows:
        assert home.setdefault(r.doc_id % 1500, r.shard) == r.shard
        slots[r.shard].append(r.slot)
    assert len(rows) == 3000 and all(sorted(s) == list(range(len(s))) for s in slots.values()) and {len(s) for s in slots.values()} == {600}


def test_size_classes(spark):
    sizes = [1, 2, 8191, 8192, 8193, 8195, 16384, 16387, 1 << 40, (1 << 40) + 1]
    got = [r.c for r in spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i long, bytes long").select("i", sharding.size_class("bytes").alias("c")).orderBy("i").collect()]
    step = lambda s: 1 << max(0, s.bit_length() - 13)
    assert got == [-(-s // step(s)) * step(s) for s in sizes] and got[:4] == sizes[:4] and got[-1] == (1 << 40) + (1 << 28)


def test_packing_is_tight():
    rnd = random.Random(4)
    classes = sorted({rnd.randint(1, 9000): rnd.randint(1, 5) for _ in range(2000)}.items())
    load = [0] * 16
    placed = sharding.pack(classes, 16)
    for i, b, n in placed:
        load[b] += classes[i][0] * n
    assert sum(load) == sum(s * n for s, n in classes) and max(load) - min(load) < 100
    assert collections.Counter(i for i, _, n in placed for _ in range(n)) == {i: n for i, (_, n) in enumerate(classes)}
    assert sharding.pack([], 3) == [] and len(sharding.pack([(10, 1)], 3)) == 1


def test_capacity_tree():
    rnd, tree, keys = random.Random(5), sharding.CapacityTree(), []
    for _ in range(2000):
        if keys and rnd.random() < 0.4:
            keys.remove(k := rnd.choice(keys))
            tree.remove(k)
        else:
            keys.append(k := (rnd.randint(0, 500), rnd.randint(0, 1 << 30)))
            tree.insert(k)
        size = rnd.randint(0, 500)
        assert tree.tightest(size) == min((k for k in keys if k[0] >= size), default=None)


def test_empty_tables(none):
    assert g.media_columns(none).count() == 0 and sharding.shard_rows(none).count() == 0
