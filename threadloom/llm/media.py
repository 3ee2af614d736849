"""Timed clips of motion-JPEG videos in AVI files, held in a binary column.

*Container.* The RIFF chunks are walked for the stream headers; the first video stream with
motion-JPEG counts. Its frames come from the OpenDML index (``indx`` and its ``ix##`` parts) if
there is one, else from ``idx1``, else from a walk through ``movi``. A frame of no bytes shows
the one before it again.

*Shots.* Each frame is decoded and gives a histogram of luma (32 bins) and, in colour, of both
chroma planes (16 bins each). The difference of neighbours is half the summed absolute
difference of the plane that differs most, 0 to 1, so that like chroma hides no cut in luma.
A frame opens a shot if its difference reaches ``factor`` times the median of the ``radius``
differences on either side, which adapts to motion and to still footage, and at least
``noise`` (``floor`` if it has no neighbours), and if neither it nor its predecessor is a
flash: a single frame whose neighbours look alike.

A media row is decoded by one task, frame by frame, so what is held is one file and one
histogram a frame; rows are spread by the scan.

Defined results: null or empty content: no clip. A file that is no AVI, has no motion-JPEG
stream or whose frame can't be decoded: one row with the reason in ``error`` and no times. A
video of no frames: no clip. Null id: carried. Rows that repeat: each gives its clips.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .runtime import id_as_long

CLIPS = "media_id bigint, clip int, start_frame int, end_frame int, start_us bigint, end_us bigint, width int, height int, error string"


@dataclass
class Video:
    width: int
    height: int
    rate: int
    scale: int
    frames: list[tuple[int, int]]  # place and size of each


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, place, size) of each chunk; that of a list has its kind's name and content."""
    while at + 8 <= end:
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        size = min(size, end - at - 8)
        if name in (b"RIFF", b"LIST"):
            yield name + data[at + 8 : at + 12], at + 12, max(0, size - 4)
        else:
            yield name, at + 8, size
        at += 8 + size + size % 2


def parse_avi(data: bytes) -> Video:
    riffs = [(name, at, size) for name, at, size in _chunks(data, 0, len(data)) if name in (b"RIFFAVI ", b"RIFFAVIX")]
    if not riffs or riffs[0][0] != b"RIFFAVI ":
        raise ValueError("not an AVI file")
    lists = [x for _, at, size in riffs for x in _chunks(data, at, at + size)]
    number = 0
    for name, at, size in (x for n, a, s in lists if n == b"LISThdrl" for x in _chunks(data, a, a + s)):
        if name != b"LISTstrl":
            continue
        parts = {n: (a, s) for n, a, s in _chunks(data, at, at + size)}
        if b"strh" in parts and b"strf" in parts and data[parts[b"strh"][0] : parts[b"strh"][0] + 4] == b"vids":
            head, form = parts[b"strh"][0], parts[b"strf"][0]
            if parts[b"strh"][1] < 28 or parts[b"strf"][1] < 20:
                raise ValueError("short stream header")
            if data[form + 16 : form + 20].upper() in (b"MJPG", b"JPEG"):
                break
        number += 1
    else:
        raise ValueError("no motion-JPEG stream")
    scale, rate = struct.unpack("<II", data[head + 20 : head + 28])
    width, height = struct.unpack("<ii", data[form + 4 : form + 12])
    tag = b"%02d" % number
    ours = (tag + b"dc", tag + b"db")
    movi = [(at, size) for name, at, size in lists if name == b"LISTmovi"]
    frames: list[tuple[int, int]] = []
    if b"indx" in parts:
        at, size = parts[b"indx"]
        _, kind, n = struct.unpack("<HxBI", data[at : at + 8])
        if kind == 0:
            for k in range(n):
                place = struct.unpack("<Q", data[at + 24 + 16 * k : at + 32 + 16 * k])[0] + 8
                count, = struct.unpack("<I", data[place + 4 : place + 8])
                base, = struct.unpack("<Q", data[place + 12 : place + 20])
                words = np.frombuffer(data, "<u4", 2 * count, place + 24).reshape(-1, 2)
                frames += [(base + int(o), int(s) & 0x7FFFFFFF) for o, s in words]
    if not frames:
        for name, at, size in lists:
            if name == b"idx1" and movi:
                entries = [struct.unpack("<4sIII", data[x : x + 16]) for x in range(at, at + size - 15, 16)]
                entries = [e for e in entries if e[0] in ours]
                # places count from the list's kind, or in some files from the file's start
                base = movi[0][0] - 4 if entries and data[movi[0][0] - 4 + entries[0][2] :][:4] == entries[0][0] else 0
                frames = [(base + e[2] + 8, e[3]) for e in entries]
    if not frames:
        for at, size in movi:
            for name, a, s in _chunks(data, at, at + size):
                frames += [(x[1], x[2]) for x in (_chunks(data, a, a + s) if name == b"LISTrec " else [(name, a, s)]) if x[0] in ours]
    if any(a + s > len(data) for a, s in frames):
        raise ValueError("a frame lies beyond the end")
    return Video(width, abs(height), rate or 1, scale or 1, frames)


def histogram(planes: list[np.ndarray]) -> np.ndarray:
    parts = [np.bincount(planes[0].ravel() >> 3, minlength=32)] + [np.bincount(p.ravel() >> 4, minlength=16) for p in planes[1:3]]
    return np.concatenate([x / x.sum() for x in parts])


def shot_starts(h: np.ndarray, floor: float = 0.3, factor: float = 3.0, radius: int = 8, noise: float = 0.2) -> list[int]:
    """Frames that open a shot, from one histogram a frame."""
    n = len(h)
    if not n:
        return []
    planes = [slice(0, 32), *(slice(x, x + 16) for x in range(32, h.shape[1], 16))]
    d, two = [0.0], []
    for lag, out in ((1, d), (2, two)):
        x = np.abs(h[lag:] - h[:-lag])
        out += np.max([x[:, p].sum(1) / 2 for p in planes], axis=0).tolist()
    starts = [0]
    for i in range(1, n):
        near = d[max(1, i - radius) : i] + d[i + 1 : i + 1 + radius]
        if near and d[i] < noise:
            continue
        if d[i] < (max(noise, factor * float(np.median(near))) if near else floor):
            continue
        alike = min(floor, d[i] / 2)
        if (i + 1 < n and two[i - 1] < alike) or (i >= 2 and two[i - 2] < alike):
            continue
        starts.append(i)
    return starts


def clips_of(data: bytes) -> tuple[Video, list[int]]:
    video = parse_avi(data)
    shapes: list[np.ndarray] = []
    for at, size in video.frames:
        if size:
            shapes.append(histogram(jpeg.decode(data[at : at + size])))
        elif shapes:
            shapes.append(shapes[-1])
        else:
            raise ValueError("the first frame is empty")
    if len({len(s) for s in shapes}) > 1:
        raise ValueError("grey and colour frames are mixed")
    return video, shot_starts(np.array(shapes))


def media_clips(media: DataFrame, id_col: str = "media_id", content_col: str = "content") -> DataFrame:
    """One row for each shot: frames ``start_frame`` to before ``end_frame``, and their times."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_py()
                if not data:
                    continue
                try:
                    v, starts = clips_of(data)
                except (ValueError, struct.error, IndexError, KeyError) as e:  # what a broken file leads to
                    rows.append((key, None, None, None, None, None, None, None, str(e)))
                    continue
                time = lambda f, v=v: f * 1_000_000 * v.scale // v.rate
                rows += [(key, c, a, b, time(a), time(b), v.width, v.height, None) for c, (a, b) in enumerate(zip(starts, [*starts[1:], len(v.frames)]))]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 9, kinds)], names=[x.split()[0] for x in CLIPS.split(", ")])

    return media.select(id_as_long(media, id_col).alias("media_id"), F.col(content_col).cast("binary").alias("content")).mapInArrow(run, CLIPS)


def write_avi(frames: list[bytes], width: int, height: int, rate: int, scale: int = 1, index: str | None = "idx1") -> bytes:
    """An AVI file of coded frames; ``index``: ``idx1``, ``opendml`` or None."""
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    group = lambda kind, body, name=b"LIST": chunk(name, kind + body)
    coded = [chunk(b"00dc", f) for f in frames]
    place = np.cumsum([4, *map(len, coded)])
    avih = struct.pack("<14I", 1_000_000 * scale // rate, 0, 0, 0x10, len(frames), 0, 1, 0, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, scale, rate, 0, len(frames), 0, 0, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    stream = chunk(b"strh", strh) + chunk(b"strf", strf)
    if index != "opendml":
        head = group(b"hdrl", chunk(b"avih", avih) + group(b"strl", stream))
        body = head + group(b"movi", b"".join(coded))
        if index == "idx1":
            body += chunk(b"idx1", b"".join(struct.pack("<4sIII", b"00dc", 0x10, p, len(f)) for p, f in zip(place.tolist(), frames)))
        return group(b"AVI ", body, b"RIFF")
    size = len(group(b"hdrl", chunk(b"avih", avih) + group(b"strl", stream + chunk(b"indx", bytes(40)))))
    movi = 12 + size + 8  # where the list's kind stands
    ix = chunk(b"ix00", struct.pack("<HBBI4sQI", 2, 0, 1, len(frames), b"00dc", movi, 0) + b"".join(struct.pack("<II", p + 8, len(f)) for p, f in zip(place.tolist(), frames)))
    indx = chunk(b"indx", struct.pack("<HBBI4s12x", 4, 0, 0, 1, b"00dc") + struct.pack("<QII", movi + int(place[-1]), len(ix), len(frames)))
    return group(b"AVI ", group(b"hdrl", chunk(b"avih", avih) + group(b"strl", stream + indx)) + group(b"movi", b"".join(coded) + ix), b"RIFF")


def render(embeddings: DataFrame, size: int = 16) -> DataFrame:
    """(media_id, content): a video of each vector, for want of a table of media. Vector v has
    1 + v % 4 shots of 3 + (v + 2 k) % 4 frames; shot k has the vector as a texture on the
    brightness 48 + 48 ((v + k) % 4), with noise; every fifth has a flash in its first shot;
    even ones have 10 frames a second, others 25. Where v % 7 = 3 the shots are in weak colour, on a
    ramp of brightness that steps by 24 only, so that neighbours overlap. A null vector has no texture, a null id no row."""

    ramp = np.tile(np.linspace(0, 100, size), (size, 1))

    def run(batches):
        for batch in batches:
            made = []
            for v, e in zip(batch.column(0).to_pylist(), batch.column(1)):
                e = np.nan_to_num(np.array([x or 0.0 for x in e.as_py() or [0.0]] or [0.0], float))
                texture = 8 * np.tanh(np.resize(e, (size, size)))
                rng, frames = np.random.default_rng(v % (1 << 32)), []
                for k in range(1 + v % 4):
                    for f in range(3 + (v + 2 * k) % 4):
                        flash = v % 5 == 0 and k == 0 and f == 1
                        faint = v % 7 == 3
                        level = 250 if flash else 60 + ramp + 24 * (k % 2) if faint else 48 + 48 * ((v + k) % 4)
                        planes = [np.clip(level + texture + rng.normal(0, 1, (size, size)), 0, 255)] + [np.full((size, size), c) for c in (124.0, 132.0) if faint]
                        frames.append(jpeg.encode(planes, 16, tables=v % 3 > 0))
                made.append(write_avi(frames, size, size, 25 if v % 2 else 10, 1, ("idx1", "opendml", None)[v % 3]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["media_id", "content"])

    return embeddings.select(id_as_long(embeddings, "vec_id").alias("media_id"), "embedding").filter("media_id IS NOT NULL").mapInArrow(run, "media_id bigint, content binary")


CLIPS_SQL = """
WITH k AS (SELECT vec_id AS v, unnest(range(0, 1 + vec_id % 4)) AS k, CASE WHEN vec_id % 2 = 0 THEN 100000 ELSE 40000 END AS us FROM embeddings WHERE vec_id IS NOT NULL),
f AS (SELECT v, k, us, 3 + (v + 2 * k) % 4 AS n FROM k),
s AS (SELECT v, k, us, n, coalesce(sum(n) OVER (PARTITION BY v ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM f)
SELECT v AS media_id, CAST(k AS INT) AS clip, CAST(a AS INT) AS start_frame, CAST(a + n AS INT) AS end_frame, CAST(a * us AS BIGINT) AS start_us,
       CAST((a + n) * us AS BIGINT) AS end_us, 16 AS width, 16 AS height, CAST(NULL AS VARCHAR) AS error FROM s
"""
