import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from tracklake.sources import pixels


def png(a):
    h, w = a.shape[:2]
    raw = b"".join(b"\0" + row.tobytes() for row in a)
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def exif(order, fields, inner):
    """A JPEG's beginning with camera data: fields of the first list and of the inner one."""
    e = {"<": b"II", ">": b"MM"}[order]
    pack = lambda f, *v: struct.pack(order + f, *v)
    extra, base = b"", 8 + 2 + 12 * (len(fields) + 1) + 4
    base2 = base + 2 + 12 * len(inner) + 4

    def entry(tag, value):
        nonlocal extra
        if isinstance(value, int):
            return pack("HHI", tag, 3, 1) + pack("H", value) + b"\0\0"
        raw = value.encode() + b"\0"
        if len(raw) <= 4:
            return pack("HHI", tag, 2, len(raw)) + raw.ljust(4, b"\0")
        extra += raw
        return pack("HHII", tag, 2, len(raw), base2 + len(extra) - len(raw))

    one = b"".join(entry(*f) for f in fields) + pack("HHII", 0x8769, 4, 1, base)
    two = b"".join(entry(*f) for f in inner)
    tiff = e + pack("H", 42) + pack("I", 8) + pack("H", len(fields) + 1) + one + pack("I", 0) + pack("H", len(inner)) + two + pack("I", 0) + extra
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff


def test_camera_data():
    for order in "<>":
        head = exif(order, [(0x010F, "Maker"), (0x0112, 6)], [(0x9003, "2026:01:02 03:04:05"), (0xA431, "S9")])
        assert pixels.camera_data(head) == {"make": "Maker", "orientation": 6, "taken": "2026:01:02 03:04:05", "serial": "S9"}
        assert pixels.camera_data(head[:60]).get("serial") is None  # cut off
    assert pixels.camera_data(b"") == {} and pixels.camera_data(b"\x89PNG") == {}


def test_resizing_keeps_means_and_exact_blocks():
    a = np.arange(7 * 5, dtype=float).reshape(7, 5)
    assert np.allclose(pixels.resized(a, 3, 2).mean(), a.mean())
    assert np.allclose(pixels.resized(np.kron(a, np.ones((2, 3))), 7, 5), a)
    assert np.allclose(pixels.resized(a, 14, 10), np.kron(a, np.ones((2, 2))))


def test_turning():
    a = np.arange(6).reshape(2, 3)
    want = {1: a, 2: a[:, ::-1], 3: a[::-1, ::-1], 4: a[::-1], 5: a.T, 6: np.rot90(a, -1), 7: a[::-1, ::-1].T, 8: np.rot90(a)}
    assert all((pixels.upright(a, o) == w).all() for o, w in want.items())


def test_probe_of_a_folder(spark, tmp_path):
    rng = np.random.default_rng(1)
    day = rng.integers(0, 255, (40, 60, 3), dtype=np.uint8)
    infrared = np.repeat(np.linspace(0, 255, 200).astype(np.uint8)[None, :, None], 150, axis=0).repeat(3, axis=2)
    (tmp_path / "CAM 1+é%41").mkdir()
    (tmp_path / "CAM 1+é%41" / "day.png").write_bytes(png(day))
    (tmp_path / "CAM 1+é%41" / "night.png").write_bytes(png(infrared))
    (tmp_path / "CAM 1+é%41" / "broken.png").write_bytes(png(day)[:40])
    (tmp_path / "CAM 1+é%41" / "empty.jpg").write_bytes(b"")
    (tmp_path / "CAM 1+é%41" / "note.txt").write_bytes(b"hello")
    got = {r["name"]: r for r in pixels.probed(spark, str(tmp_path)).collect()}
    assert {n: r["error"] for n, r in got.items()} == {"day.png": None, "night.png": None, "broken.png": "cannot decode", "empty.jpg": "empty", "note.txt": "unknown_format"}
    assert (got["day.png"]["width"], got["day.png"]["height"], got["day.png"]["is_night"]) == (60, 40, False)
    assert got["night.png"]["is_night"] and got["night.png"]["dhash"] == "f" * 16
    assert got["day.png"]["grid"] == pixels.grid_of(day) and len(got["day.png"]["grid"]) == 256
    assert got["broken.png"]["grid"] is None and got["day.png"]["orientation"] == 1


def test_crops_blur_and_models(spark, tmp_path):
    a = np.random.default_rng(2).integers(0, 255, (40, 60, 3), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(png(a))
    frames = pixels.decoded(spark, str(tmp_path))
    path = frames.first()["path"]
    boxes = spark.createDataFrame([(path, 1, 0.1, 0.1, 0.5, 0.5), (path, 2, -0.5, 0.9, 2.0, 2.0), (path, 3, 0.2, 0.2, 0.0, 0.1), (path, 4, 1.2, 0.2, 0.1, 0.1)], "path string, det_id long, x double, y double, w double, h double")
    parts = pixels.crops(frames, boxes)
    got = {r["det_id"]: r for r in parts.collect()}
    assert got[1]["data"] == a[4:24, 6:36].tobytes() and (got[1]["width"], got[1]["height"]) == (30, 20)
    assert got[2]["data"] == a[36:40].tobytes() and got[3]["data"] is None and got[4]["data"] is None
    said = {r["det_id"]: r["prediction"] for r in pixels.predicted(parts, lambda images: [float(i.mean()) for i in images], "double").collect()}
    assert abs(said[1] - a[4:24, 6:36].mean()) < 1e-9 and said[3] is None
    (soft,) = pixels.blurred(frames, boxes.filter("det_id = 1")).collect()
    b = pixels.pixels(soft["data"], 40, 60, 3)
    outside = np.ones((40, 60), bool)
    outside[4:24, 6:36] = False
    assert (b[outside] == a[outside]).all() and b[4:24, 6:36].std() < 0.2 * a[4:24, 6:36].std()
    assert frames.select(F.sum("width")).first()[0] == 60


def sampled_by_hand(a, axis, x, y):
    """Bilinear sample of the rectangle's pixel (x, y), one at a time."""
    sx, sy, hx, hy, depth, margin = axis
    n = float(np.hypot(hx - sx, hy - sy))
    along, across = -margin + (n + 2 * margin) * x / 255, -depth / 2 + depth * y / 127
    px, py = sx + (hx - sx) / n * along - (hy - sy) / n * across, sy + (hy - sy) / n * along + (hx - sx) / n * across
    out = np.zeros(3)
    for i, wx in ((int(np.floor(px)), 1 - (px - np.floor(px))), (int(np.floor(px)) + 1, px - np.floor(px))):
        for j, wy in ((int(np.floor(py)), 1 - (py - np.floor(py))), (int(np.floor(py)) + 1, py - np.floor(py))):
            if 0 <= i < a.shape[1] and 0 <= j < a.shape[0]:
                out += wx * wy * a[j, i]
    return np.rint(out)


def test_flanks_of_frames(spark, tmp_path):
    rng = np.random.default_rng(3)
    frames = {"a.png": rng.integers(0, 255, (300, 320, 3), dtype=np.uint8), "b.png": rng.integers(0, 255, (90, 400, 3), dtype=np.uint8)}
    for name, a in frames.items():
        (tmp_path / name).write_bytes(png(a))
    decoded = pixels.decoded(spark, str(tmp_path))
    paths = {p["path"].rsplit("/", 1)[1]: p["path"] for p in decoded.select("path").collect()}
    right = lambda *ps: dict(zip(("right_shoulder", "right_hip"), ps, strict=False))
    p = lambda x, y, v=2: {"x": float(x), "y": float(y), "v": v}
    cases = [
        ("a.png", 1, right(p(50, 50), p(150, 60)), "R", None),
        ("a.png", 2, right(p(50, 50), p(50, 50)), "R", None),  # no length
        ("a.png", 3, right(p(50, 50)), "R", None),  # no hip
        ("a.png", 4, {"left_shoulder": p(50, 50), "left_hip": p(150, 60)}, "R", None),  # the other side
        ("a.png", 5, {"left_shoulder": p(250, 200), "left_hip": p(60, 90)}, "L", None),  # looks the other way, reaches outside
        ("b.png", 6, right(p(50, 40), p(60, 42)), "R", (0.1, 0.2, 0.8, 0.7)),  # collapsed: the box's own axis
        ("b.png", 7, right(p(50, 40), p(300, 42)), "R", (0.1, 0.2, 0.8, 0.7)),
        ("b.png", 8, right(p(50, 40), p(300, 42, 0)), "R", None),  # not visible
        ("b.png", 9, None, "R", None),
    ]
    rows = [(paths[f], d, k, s, b, frames[f].shape[1], frames[f].shape[0]) for f, d, k, s, b in cases]
    kind = "path string, det_id long, points map<string,struct<x:double,y:double,v:int>>, side string, box struct<x:double,y:double,w:double,h:double>, fw int, fh int"
    axes = spark.createDataFrame(rows, kind).withColumn("axis", pixels.flank_axis(F.col("points"), F.col("side"), F.col("box"), F.col("fw"), F.col("fh")))
    want = {1: (50, 50, 150, 60, 0.6 * np.hypot(100, 10), 0.15 * np.hypot(100, 10)), 5: (250, 200, 60, 90, 0.6 * np.hypot(190, 110), 0.15 * np.hypot(190, 110)),
            6: (40 + 0.08 * 320, 18 + 31.5, 40 + 0.92 * 320, 18 + 31.5, 0.92 * 63, 0.15 * 0.84 * 320), 7: (50, 40, 300, 42, 0.6 * np.hypot(250, 2), 0.15 * np.hypot(250, 2))}
    got_axes = {r["det_id"]: r["axis"] for r in axes.collect()}
    assert {d for d, a in got_axes.items() if a is not None} == set(want)
    assert all(np.allclose(got_axes[d], w) for d, w in want.items())
    got = {r["det_id"]: r for r in pixels.rectified(decoded, axes.select("path", "det_id", "axis")).collect()}
    assert set(got) == set(range(1, 10)) and {d for d, r in got.items() if r["data"] is None} == {2, 3, 4, 8, 9}
    for d, axis in want.items():
        a = frames["a.png" if d < 6 else "b.png"]
        flank = np.frombuffer(got[d]["data"], np.uint8).reshape(got[d]["height"], got[d]["width"], 3)
        assert flank.shape == (128, 256, 3)
        for x, y in [(0, 0), (255, 0), (0, 127), (255, 127), *rng.integers(0, 128, (60, 2))]:
            assert np.abs(flank[y, x] - sampled_by_hand(a, axis, x, y)).max() <= 1
    flat = pixels.rectified(decoded, axes.filter("det_id = 1").select("path", "det_id", "axis"))
    (m,) = pixels.crop_measures(flat.unionByName(flat.limit(0))).collect()
    assert m["blur"] > 20 and 18 < m["exposure"] < 242 and m["saturated"] < 0.3


def test_crop_measures_by_hand(spark):
    a = np.zeros((3, 4, 3), np.uint8)
    a[1, 2] = 255
    rows = [(1, 4, 3, bytearray(a.tobytes())), (2, None, None, None), (3, 1, 1, bytearray(b"\xff\xff\xff"))]
    got = {r["det_id"]: r for r in pixels.crop_measures(spark.createDataFrame(rows, "det_id long, width int, height int, data binary")).collect()}
    laplacian = np.zeros((3, 4))
    laplacian[1, 2] = -4 * 255
    laplacian[1, 1] = 255
    laplacian[1, 3] = 510  # mirrored without its own pixel
    laplacian[0, 2] = laplacian[2, 2] = 510
    assert abs(got[1]["blur"] - laplacian.var()) < 1e-6 and abs(got[1]["exposure"] - 255 / 12) < 1e-9 and abs(got[1]["saturated"] - 1 / 12) < 1e-9
    assert got[2]["blur"] is None and (got[3]["blur"], got[3]["exposure"], got[3]["saturated"]) == (0.0, 255.0, 1.0)
