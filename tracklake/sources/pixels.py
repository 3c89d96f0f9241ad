"""Pixels of camera frames: decoding by Spark's image source, small measures of them, crops and models.

A decoded frame is never shuffled: it is cut down to a small thumbnail, or to its crops, in the task that decoded it.
Means over areas take the place of the resampling filters of image libraries, so grids and hashes differ from theirs by
a few grey levels.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.config import SETTINGS

THUMBNAIL = 128
GRID, BAND = 16, 0.08
NIGHT_BELOW = 12
BLUR_RADIUS = 25
FLANK_WIDTH, FLANK_HEIGHT = 256, 128
AXIS = ("sx", "sy", "hx", "hy", "depth", "margin")
#: Bytes of a file that are searched for camera data.
HEAD = 1 << 17

# Numbers of the camera data that are read.
EXIF_TAGS = {0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x9003: "taken", 0xA431: "serial", 0xA435: "serial"}
EXIF_POINTER = 0x8769


def _plain_path(origin: Column) -> Column:
    """A path as the other file sources give it: the image source gives a URL."""
    return F.url_decode(F.replace(F.regexp_replace(origin, "^file:///", "file:/"), F.lit("+"), F.lit("%2B")))


def decoded(spark: SparkSession, root: str) -> DataFrame:
    """path, width, height, channels, data (rows of BGR pixels) and error of every file below ``root``; those that cannot be decoded have an error and no pixels."""
    i = F.col("image")
    good = i["height"] > 0
    files = spark.read.format("image").option("recursiveFileLookup", "true").load(root)
    return files.select(
        _plain_path(i["origin"]).alias("path"),
        F.when(good, i["width"]).alias("width"),
        F.when(good, i["height"]).alias("height"),
        F.when(good, i["nChannels"]).alias("channels"),
        F.when(good, i["data"]).alias("data"),
        F.when(~good, "cannot decode").alias("error"),
    )


def pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Pixels as (height, width, 3), red first."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, 2::-1]


def resized(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """``a`` in other dimensions: each new pixel is the mean of the area that it covers."""
    for axis, size in ((0, height), (1, width)):
        a = np.moveaxis(a.astype(float), axis, 0)
        sums = np.concatenate((np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0)))
        edges = np.linspace(0, len(a), size + 1)
        low = np.minimum(edges.astype(int), len(a) - 1)
        at = sums[low] + (edges - low).reshape(-1, *[1] * (a.ndim - 1)) * a[low]
        a = np.moveaxis(np.diff(at, axis=0) * size / len(a), 0, axis)
    return a


def grey(a: np.ndarray) -> np.ndarray:
    return a.astype(float) @ np.array([0.299, 0.587, 0.114])


def upright(a: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels turned as the camera's orientation (1 to 8) says."""
    if orientation in (5, 6, 7, 8):
        a = np.swapaxes(a, 0, 1)
    if orientation in (2, 3, 6, 7):
        a = a[:, ::-1]
    if orientation in (3, 4, 7, 8):
        a = a[::-1]
    return a


def grid_of(a: np.ndarray, n: int = GRID, band: float = BAND) -> list[int]:
    """n x n grey means, row by row, without the band at the bottom where cameras print their data."""
    cut = int(a.shape[0] * band)
    kept = a[: a.shape[0] - cut] if 0 < cut < a.shape[0] else a
    return np.clip(np.rint(resized(grey(kept), n, n)), 0, 255).astype(int).ravel().tolist()


def difference_hash(a: np.ndarray) -> str:
    """64 bits, as hex: whether each cell of an 8 x 9 grid is darker than the next in its row."""
    g = np.rint(resized(grey(a), 8, 9))
    return np.packbits(g[:, 1:] > g[:, :-1]).tobytes().hex()


def night(a: np.ndarray) -> bool:
    """Infrared frames have no colour: the mean spread of the channels is small."""
    small = np.rint(resized(a, 32, 32))
    return bool((small.max(axis=2) - small.min(axis=2)).mean() < NIGHT_BELOW)


def camera_data(head: bytes) -> dict:
    """make, model, orientation, taken and serial of a JPEG's camera data; what is missing or malformed is left out."""
    out: dict = {}
    at = head.find(b"Exif\0\0")
    if head[:2] != b"\xff\xd8" or at < 0:
        return out
    tiff = head[at + 6 :]
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    try:
        todo = [struct.unpack_from(f"{order}I", tiff, 4)[0]] if order else []
        seen = set()
        while todo:
            base = todo.pop()
            if base in seen:
                continue
            seen.add(base)
            for i in range(struct.unpack_from(f"{order}H", tiff, base)[0]):
                tag, kind, count = struct.unpack_from(f"{order}HHI", tiff, base + 2 + 12 * i)
                field = base + 10 + 12 * i
                if tag == EXIF_POINTER:
                    todo.append(struct.unpack_from(f"{order}I", tiff, field)[0])
                elif tag in EXIF_TAGS and kind == 3:
                    out[EXIF_TAGS[tag]] = struct.unpack_from(f"{order}H", tiff, field)[0]
                elif tag in EXIF_TAGS and kind == 2:
                    start = field if count <= 4 else struct.unpack_from(f"{order}I", tiff, field)[0]
                    said = tiff[start : start + count].split(b"\0")[0].decode("ascii", "replace").strip()
                    if said:
                        out.setdefault(EXIF_TAGS[tag], said)
    except struct.error:
        pass
    return out


CAMERA = "struct<make:string,model:string,orientation:int,taken:string,serial:string>"


def camera_fields(head: Column) -> Column:
    """Camera data of a file's first bytes."""

    def read(heads: pd.Series) -> pd.DataFrame:
        rows = [camera_data(h or b"") for h in heads]
        text = lambda name: [str(r[name]) if name in r else None for r in rows]
        turn = [r["orientation"] if r.get("orientation") in range(1, 9) else 1 for r in rows]
        return pd.DataFrame({"make": text("make"), "model": text("model"), "orientation": turn, "taken": text("taken"), "serial": text("serial")})

    read.__annotations__ = {"heads": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(read, CAMERA)(head)


SMALL = "path string, width int, height int, error string, small_width int, small_height int, small binary"


def thumbnails(frames: DataFrame, side: int = THUMBNAIL) -> DataFrame:
    """path, width, height, error and a thumbnail (rows of RGB pixels, ``side`` at the longer edge at most) of decoded frames."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if r.error is not None or r.data is None:
                    rows.append((r.path, None, None, r.error or "cannot decode", None, None, None))
                    continue
                a = pixels(r.data, int(r.height), int(r.width), int(r.channels))
                scale = min(1.0, side / max(a.shape[:2]))
                h, w = (max(1, int(n * scale)) for n in a.shape[:2])
                rows.append((r.path, r.width, r.height, None, w, h, np.clip(np.rint(resized(a, h, w)), 0, 255).astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SMALL.split(", ")])

    return frames.select("path", "width", "height", "channels", "data", "error").mapInPandas(run, SMALL)


MEASURES = "struct<grid:array<int>,dhash:string,is_night:boolean>"


def measures(small: Column, width: Column, height: Column, orientation: Column, n: int = GRID, band: float = BAND) -> Column:
    """grid, dhash and is_night of a thumbnail; null without one."""

    def run(small: pd.Series, width: pd.Series, height: pd.Series, orientation: pd.Series) -> pd.DataFrame:
        rows = []
        for data, w, h, o in zip(small, width, height, orientation, strict=True):
            if data is None:
                rows.append((None, None, None))
            else:
                a = upright(np.frombuffer(data, np.uint8).reshape(int(h), int(w), 3), int(o))
                rows.append((grid_of(a, n, band), difference_hash(a), night(a)))
        return pd.DataFrame(rows, columns=["grid", "dhash", "is_night"])

    run.__annotations__ = {"small": pd.Series, "width": pd.Series, "height": pd.Series, "orientation": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, MEASURES)(small, width, height, orientation)


def probed(spark: SparkSession, root: str) -> DataFrame:
    """One row for every file below ``root``: the scan's columns, then width, height, camera data, taken_at, grid, dhash, is_night and error.

    Of the files that could be read only thumbnails and first bytes are joined, by path.
    """
    from tracklake.functions.text import exif_timestamp
    from tracklake.sources.files import scan_folder

    heads = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", camera_fields(F.substring("content", 1, HEAD)).alias("camera"))
    files = scan_folder(spark, root).join(heads, "path", "left").join(thumbnails(decoded(spark, root)), "path", "left")
    turn = F.coalesce(F.col("camera.orientation"), F.lit(1))
    df = files.withColumn("_m", measures(F.col("small"), F.col("small_width"), F.col("small_height"), turn))
    error = F.when(F.col("corrupt"), F.element_at("flags", 1)).when(F.col("small").isNull(), F.coalesce("error", F.lit("cannot decode")))
    return df.select(*[c for c in ("path", "folder", "name", "bytes", "modified_at", "format", "sha256")], "width", "height", F.col("camera.make").alias("make"), F.col("camera.model").alias("model"), F.col("camera.serial").alias("serial"), turn.alias("orientation"), exif_timestamp(F.col("camera.taken")).alias("taken_at"), "_m.grid", "_m.dhash", "_m.is_night", error.alias("error"))


def pixel_box(width: int, height: int, x: float, y: float, w: float, h: float) -> tuple[int, int, int, int] | None:
    """Whole pixels that a box in shares of the frame touches, cut to the frame; None if there are none."""
    if not np.isfinite([x, y, w, h]).all() or w <= 0 or h <= 0:
        return None
    x0, y0 = max(0, int(np.floor(x * width))), max(0, int(np.floor(y * height)))
    x1, y1 = min(width, int(np.ceil((x + w) * width))), min(height, int(np.ceil((y + h) * height)))
    return (x0, y0, x1, y1) if x1 > x0 and y1 > y0 else None


CROPS = "path string, det_id long, width int, height int, data binary"


def crops(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """path, det_id, width, height and pixels (rows of RGB) of every box (path, det_id, x, y, w, h in shares of the frame); boxes without pixels have none.

    The boxes of a frame are gathered, a handful each, and brought to the frames.
    """
    own = boxes.groupBy("path").agg(F.collect_list(F.struct("det_id", "x", "y", "w", "h")).alias("boxes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                a = pixels(r.data, int(r.height), int(r.width), int(r.channels))
                for b in r.boxes:
                    at = pixel_box(int(r.width), int(r.height), b["x"], b["y"], b["w"], b["h"])
                    part = a[at[1] : at[3], at[0] : at[2]] if at else None
                    rows.append((r.path, b["det_id"], part.shape[1], part.shape[0], part.tobytes()) if at else (r.path, b["det_id"], None, None, None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CROPS.split(", ")])

    return frames.filter("data is not null").join(own, "path").select("path", "width", "height", "channels", "data", "boxes").mapInPandas(run, CROPS)


def _blur(a: np.ndarray, radius: int) -> np.ndarray:
    """Three running means on each axis, close to a Gaussian of this radius."""
    out = a.astype(float)
    for axis in (0, 1):
        reach = min(radius, out.shape[axis] - 1)
        for _ in range(3):
            padded = np.pad(out, [(reach + 1, reach) if i == axis else (0, 0) for i in range(out.ndim)], mode="edge")
            sums = np.moveaxis(np.cumsum(padded, axis=axis), axis, 0)
            out = np.moveaxis((sums[2 * reach + 1 :] - sums[: -2 * reach - 1]) / (2 * reach + 1), 0, axis)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def blurred(frames: DataFrame, boxes: DataFrame, radius: int = BLUR_RADIUS) -> DataFrame:
    """Decoded frames that have boxes (path, x, y, w, h), with what lies in them blurred."""
    own = boxes.groupBy("path").agg(F.collect_list(F.struct("x", "y", "w", "h")).alias("boxes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                a = np.frombuffer(r.data, np.uint8).reshape(int(r.height), int(r.width), int(r.channels)).copy()
                for b in r.boxes:
                    at = pixel_box(int(r.width), int(r.height), b["x"], b["y"], b["w"], b["h"])
                    if at:
                        x0, y0, x1, y1 = at
                        a[y0:y1, x0:x1] = _blur(a[y0:y1, x0:x1], radius)
                out.append(a.tobytes())
            yield batch.assign(data=out)[["path", "width", "height", "channels", "data"]]

    return frames.filter("data is not null").join(own, "path").select("path", "width", "height", "channels", "data", "boxes").mapInPandas(run, "path string, width int, height int, channels int, data binary")


def predicted(parts: DataFrame, model: Callable[[list[np.ndarray]], list], returns: str, column: str = "prediction") -> DataFrame:
    """``parts`` (width, height, data as rows of RGB) with what a model says of each batch of pixel arrays; null without pixels.

    The model is any function that can be pickled with what it holds; Spark ships it once for each job.
    """

    def run(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        known = [i for i, d in enumerate(data) if d is not None]
        said = model([np.frombuffer(data[i], np.uint8).reshape(int(height[i]), int(width[i]), 3) for i in known]) if known else []
        out: list = [None] * len(data)
        for i, s in zip(known, said, strict=True):
            out[i] = s
        return pd.Series(out, dtype=object)

    run.__annotations__ = {"data": pd.Series, "width": pd.Series, "height": pd.Series, "return": pd.Series}
    return parts.withColumn(column, F.pandas_udf(run, returns)("data", "width", "height"))


# Flanks ------------------------------------------------------------------------------------------------------------


def flank_axis(points: Column, side: Column, box: Column | None = None, width: Column | None = None, height: Column | None = None, s=SETTINGS) -> Column:
    """Struct of sx, sy, hx, hy (shoulder and hip in pixels), depth and margin of the side's flank; null where there is none to speak of.

    ``points`` maps names to (x, y, v).  Both points of the side must be visible, and at least a pixel apart.  Where they
    span too little of the longer edge of the detection's ``box`` (x, y, w, h in shares of the frame of ``width`` and
    ``height``), the axis is the box's own middle line.
    """
    point = lambda part: F.when(side == "R", points[f"right_{part}"]).when(side == "L", points[f"left_{part}"])
    shoulder, hip = point("shoulder"), point("hip")
    seen = (F.coalesce(shoulder["v"], F.lit(0)) > 0) & (F.coalesce(hip["v"], F.lit(0)) > 0)
    axis = lambda sx, sy, hx, hy, depth: F.struct(
        *[c.cast("double").alias(n) for n, c in (("sx", sx), ("sy", sy), ("hx", hx), ("hy", hy), ("depth", depth), ("margin", s.flank_margin * F.hypot(hx - sx, hy - sy)))]
    )
    length = F.hypot(hip["x"] - shoulder["x"], hip["y"] - shoulder["y"])
    posed = axis(shoulder["x"], shoulder["y"], hip["x"], hip["y"], s.flank_depth * length)
    if box is None:
        return F.when(seen & (length >= 1), posed)
    bw, bh = box["w"] * width, box["h"] * height
    left, middle = box["x"] * width, box["y"] * height + bh / 2
    whole = axis(left + s.box_inset * bw, middle, left + (1 - s.box_inset) * bw, middle, s.box_depth * bh)
    collapsed = F.coalesce(length < s.least_body_span * F.greatest(bw, bh), F.lit(False))
    return F.when(seen & (length >= 1), F.when(~collapsed, posed).when((1 - 2 * s.box_inset) * bw >= 1, whole))


def _sampled(flat: np.ndarray, start: np.ndarray, shape: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear samples of many frames at once: frame i's pixels (shape[i] rows and columns) begin at start[i] of ``flat`` (pixels, 3); outside is black.

    x and y have a row of places for each frame.
    """
    x0, y0 = np.floor(x), np.floor(y)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    rows, columns = shape[:, 0, None], shape[:, 1, None]

    def at(px: np.ndarray, py: np.ndarray) -> np.ndarray:
        inside = (px >= 0) & (px < columns) & (py >= 0) & (py < rows)
        index = np.where(inside, start[:, None] + py * columns + px, 0).astype(np.int64)
        return flat[index] * inside[..., None]

    top = at(x0, y0) * (1 - fx) + at(x0 + 1, y0) * fx
    bottom = at(x0, y0 + 1) * (1 - fx) + at(x0 + 1, y0 + 1) * fx
    return top * (1 - fy) + bottom * fy


def flank_places(axes: np.ndarray, width: int = FLANK_WIDTH, height: int = FLANK_HEIGHT) -> tuple[np.ndarray, np.ndarray]:
    """Where in its frame every pixel of a flank's rectangle lies: x and y, a row for each axis (sx, sy, hx, hy, depth, margin).

    The rectangle's long edge runs from ``margin`` before the shoulder to ``margin`` behind the hip, its short one over ``depth`` across.
    """
    sx, sy, hx, hy, depth, margin = (axes[:, i, None] for i in range(6))
    length = np.hypot(hx - sx, hy - sy)
    ux, uy = (hx - sx) / length, (hy - sy) / length
    v, u = (g.ravel()[None] for g in np.mgrid[0:height, 0:width])
    along, across = u / (width - 1) * (length + 2 * margin) - margin, (v / (height - 1) - 0.5) * depth
    return sx + ux * along - uy * across, sy + uy * along + ux * across


#: Flanks that are sampled at a time.
FLANKS_AT_ONCE = 16


def rectified(frames: DataFrame, axes: DataFrame) -> DataFrame:
    """path, det_id, width, height and pixels (rows of RGB) of every flank of ``axes`` (path, det_id, axis as of ``flank_axis``) in decoded ``frames``.

    The axis lies along the rectangle's long edge.  An axis that is null has no pixels.  The axes of a frame are
    gathered, a handful each, and brought to the frames; all flanks of a batch are sampled together.
    """
    own = axes.groupBy("path").agg(F.collect_list(F.struct("det_id", "axis")).alias("flanks"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            images = [pixels(r.data, int(r.height), int(r.width), int(r.channels)) for r in batch.itertuples(index=False)]
            starts = np.cumsum([0, *(a.shape[0] * a.shape[1] for a in images)])
            flat = np.concatenate([a.reshape(-1, 3) for a in images]) if images else np.zeros((0, 3))
            todo = [(i, path, f["det_id"], f["axis"]) for i, (path, flanks) in enumerate(zip(batch["path"], batch["flanks"], strict=True)) for f in flanks]
            good = [t for t in todo if t[3] is not None]
            rows = [(path, det, None, None, None) for _, path, det, axis in todo if axis is None]
            for at in range(0, len(good), FLANKS_AT_ONCE):
                some = good[at : at + FLANKS_AT_ONCE]
                which = np.array([t[0] for t in some])
                x, y = flank_places(np.array([[t[3][n] for n in AXIS] for t in some], float))
                found = _sampled(flat, starts[which], np.array([images[i].shape[:2] for i in which]), x, y)
                found = np.clip(np.rint(found), 0, 255).astype(np.uint8)
                rows += [(path, det, FLANK_WIDTH, FLANK_HEIGHT, a.tobytes()) for (_, path, det, _), a in zip(some, found, strict=True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CROPS.split(", ")])

    return frames.filter("data is not null").join(own, "path").select("path", "width", "height", "channels", "data", "flanks").mapInPandas(run, CROPS)


def crop_measures(parts: DataFrame) -> DataFrame:
    """``parts`` (width, height, data as rows of RGB) with blur (variance of the Laplacian), exposure (mean grey) and saturated (share of grey from 250 on); null without pixels."""

    def run(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
        rows = []
        for d, w, h in zip(data, width, height, strict=True):
            if d is None:
                rows.append((None, None, None))
                continue
            g = np.rint(grey(np.frombuffer(d, np.uint8).reshape(int(h), int(w), 3)))
            # Edges are mirrored without repeating the outermost pixels; a single row or column has no neighbour but itself.
            p = np.pad(g, [(1, 1) if n > 1 else (0, 0) for n in g.shape], mode="reflect")
            p = np.pad(p, [(0, 0) if n > 1 else (1, 1) for n in g.shape], mode="edge")
            laplacian = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
            rows.append((float(laplacian.var()), float(g.mean()), float((g >= 250).mean())))
        return pd.DataFrame(rows, columns=["blur", "exposure", "saturated"])

    run.__annotations__ = {"data": pd.Series, "width": pd.Series, "height": pd.Series, "return": pd.DataFrame}
    measured = F.pandas_udf(run, "struct<blur:double,exposure:double,saturated:double>")
    return parts.withColumn("_m", measured("data", "width", "height")).select(*parts.columns, "_m.blur", "_m.exposure", "_m.saturated")
