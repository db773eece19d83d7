"""EXIF from JPEG and TIFF files: make, model, time and orientation (S-07, S-10), wherever they lie in the file. Pure Python, no image library."""

from __future__ import annotations

import struct
from io import BytesIO
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tag numbers of the EXIF standard.
MAKE, MODEL, ORIENTATION, DATE_TIME, EXIF_IFD, DATE_TIME_ORIGINAL = 0x010F, 0x0110, 0x0112, 0x0132, 0x8769, 0x9003
TAGS = {MAKE, MODEL, ORIENTATION, DATE_TIME, EXIF_IFD, DATE_TIME_ORIGINAL}
SCHEMA = "make string, model string, dt_raw string, orientation int"


def _read(f: BinaryIO, at: int, n: int) -> bytes:
    f.seek(at)
    return f.read(n)


def _tiff(f: BinaryIO) -> tuple[int, int | None] | None:
    """Where the TIFF block begins and ends: the file itself (no end), or a JPEG's APP1 segment."""
    head = _read(f, 0, 4)
    if head in (b"II*\0", b"MM\0*"):
        return 0, None
    if head[:2] != b"\xff\xd8":
        return None
    at = 2
    while len(head := _read(f, at, 10)) >= 4 and head[0] == 0xFF:
        marker, size = head[1], struct.unpack_from(">H", head, 2)[0]
        if marker == 0xE1 and head[4:10] == b"Exif\0\0":
            return at + 10, at + 2 + size
        if marker == 0xDA:
            return None
        at += 2 + size
    return None


class _Block:
    """Bytes of a TIFF block, read where they are asked for."""

    def __init__(self, f: BinaryIO, begin: int, end: int | None):
        self.f, self.begin, self.end = f, begin, end

    def read(self, at: int, n: int) -> bytes:
        left = n if self.end is None else min(n, self.end - self.begin - at)
        return _read(self.f, self.begin + at, left) if left > 0 else b""

    def text(self, at: int, n: int) -> str:
        out = b""
        while len(out) < n and b"\0" not in out:
            part = self.read(at + len(out), min(n - len(out), 4096))
            if not part:
                break
            out += part
        return out.split(b"\0")[0].decode("utf-8", "replace").strip()


def _directory(block: _Block, order: str, at: int, into: dict) -> None:
    head = block.read(at, 2) if at > 0 else b""
    if len(head) < 2:
        return
    entries = block.read(at + 2, 12 * struct.unpack(order + "H", head)[0])
    for i in range(len(entries) // 12):
        tag, kind, n = struct.unpack_from(order + "HHI", entries, 12 * i)
        if tag not in TAGS:
            continue
        if kind == 2:  # text
            start = at + 10 + 12 * i if n <= 4 else struct.unpack_from(order + "I", entries, 12 * i + 8)[0]
            into.setdefault(tag, block.text(start, n))
        elif kind == 3:
            into.setdefault(tag, struct.unpack_from(order + "H", entries, 12 * i + 8)[0])
        elif kind == 4:
            into.setdefault(tag, struct.unpack_from(order + "I", entries, 12 * i + 8)[0])


def read_exif_file(f: BinaryIO) -> dict:
    """make, model, dt_raw (DateTime before DateTimeOriginal) and orientation; what isn't there or can't be read is None."""
    out = dict.fromkeys(("make", "model", "dt_raw", "orientation"))
    try:
        place = _tiff(f)
        if place is None:
            return out
        block, tags = _Block(f, *place), {}
        head = block.read(0, 8)
        order = "<" if head[:2] == b"II" else ">"
        _directory(block, order, struct.unpack_from(order + "I", head, 4)[0], tags)
        if isinstance(tags.get(EXIF_IFD), int):
            _directory(block, order, tags[EXIF_IFD], tags)
        out |= {"make": tags.get(MAKE), "model": tags.get(MODEL), "dt_raw": tags.get(DATE_TIME) or tags.get(DATE_TIME_ORIGINAL), "orientation": tags.get(ORIENTATION)}
    except (struct.error, IndexError, OSError):
        pass
    return {k: v if v != "" else None for k, v in out.items()}


def read_exif(data: bytes | None) -> dict:
    """The same from the bytes of a whole file."""
    return read_exif_file(BytesIO(data or b""))


def _read_path(path: str | None) -> dict:
    try:
        with open(path, "rb") as f:
            return read_exif_file(f)
    except (OSError, TypeError):
        return read_exif(None)


def exif(path: Column) -> Column:
    """The struct of SCHEMA from a file; all null where there is no path or it can't be read."""

    @F.pandas_udf(SCHEMA)
    def run(paths: pd.Series) -> pd.DataFrame:
        rows = [_read_path(p) for p in paths]
        return pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype=object) for n in ("make", "model", "dt_raw", "orientation")})

    return run(path)
