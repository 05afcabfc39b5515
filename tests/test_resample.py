"""Cubic resampling against numpy, and models in containers."""

import json
import math
import struct

import numpy as np

from atelier.operators import features, resample
from atelier.sources import media

SIZES = [(1, 1), (5, 3), (9, 8), (17, 23), (40, 9), (3, 64), (30, 31)]


def matrix(old, new):
    """``new`` rows of weights over ``old`` pixels."""
    out, scale = np.zeros((new, old)), old / new
    wide = max(1.0, scale)
    for cell in range(new):
        mid = (cell + 0.5) * scale - 0.5
        for at in range(max(0, math.floor(mid - 2 * wide)), min(old, math.ceil(mid + 2 * wide))):
            t = abs(mid - at) / wide
            out[cell, at] = (1.5 * t - 2.5) * t * t + 1 if t < 1 else ((-0.5 * t + 2.5) * t - 4) * t + 2 if t < 2 else 0
        out[cell] /= out[cell].sum()
    return out


def images():
    rng = np.random.default_rng(2)
    for k, (w, h) in enumerate(SIZES):
        y, x = np.mgrid[0:h, 0:w]
        base = (127 + 120 * np.sin(x / 3 + k) * np.cos(y / 4))[..., None] + rng.normal(0, 20, (h, w, 3))
        alpha = np.full((h, w, 1), 255) if k % 2 else rng.choice([0, 90, 255], (h, w, 1))
        yield k, np.concatenate([np.clip(base, 0, 255), alpha], 2).astype(int)


def small(cells, width, height):
    deep = np.concatenate([cells[..., :3] * 257 * cells[..., 3:] // 255, cells[..., 3:] * 257], 2) / 65535
    out = np.einsum("yj,xi,jic->yxc", matrix(cells.shape[0], height), matrix(cells.shape[1], width), deep)
    out = np.minimum(out, out[..., 3:])
    return np.floor(np.clip(np.floor(65535 * out + 0.5), 0, 65535) / 256).astype(int)


def test_images_of_odd_sizes(spark):
    rows = [(k, x, y, *map(int, cells[y, x])) for k, cells in images() for y in range(cells.shape[0]) for x in range(cells.shape[1])]
    pixels = spark.createDataFrame(rows, "img int, x int, y int, r int, g int, b int, a int").repartition(3)
    got = {(r["img"], r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"]) for r in resample.resized(pixels, 7, 5).collect()}
    assert len(got) == 35 * len(SIZES)
    hashes = {r["img"]: r["phash"] % (1 << 64) for r in resample.difference_hash(pixels).collect()}
    for k, cells in images():
        want = small(cells, 7, 5)
        assert all(np.abs(np.subtract(got[k, x, y], want[y, x])).max() <= 0 for y in range(5) for x in range(7)), SIZES[k]
        lit = small(cells, 9, 8)[..., :3] * 257 @ np.array([299, 587, 114]) // 1000
        bits = (lit[:, :-1] > lit[:, 1:]).ravel()
        assert hashes[k] == int("".join("01"[int(b)] for b in bits), 2), SIZES[k]
    assert resample.difference_hash(pixels.limit(0)).count() == 0


def test_weights_add_up(spark):
    rows = resample.weights(spark.createDataFrame([(n,) for n in (1, 2, 8, 9, 100, 1001)], "size int"), 9).collect()
    total = {}
    for r in rows:
        assert 0 <= r["at"] < r["size"]
        total[r["size"], r["cell"]] = total.get((r["size"], r["cell"]), 0) + r["w"]
    assert len(total) == 54 and all(abs(t - 1) < 1e-12 for t in total.values())


def test_models_in_containers(spark, tmp_path):
    text = json.dumps({"accessors": [{"count": 8, "min": [0, 0, 0], "max": [1, 2, 3]}, {"count": 36}], "materials": [{"name": "é"}], "animations": [{"name": "walk"}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}]})
    raw = text.encode() + b" " * (-len(text.encode()) % 4)
    chunk = lambda kind, data: struct.pack("<I4s", len(data), kind) + data
    body = chunk(b"JSON", raw) + chunk(b"BIN\0", b"\1" * 400)
    good = struct.pack("<4sII", b"glTF", 2, 12 + len(body)) + body
    files = {"a.gltf": text.encode(), "b.glb": good, "c.GLB": good, "cut.glb": good[:-9], "old.glb": good[:4] + struct.pack("<I", 1) + good[8:], "no.glb": b"x" * 40, "short.glb": b"glTF", "bin.glb": good[:16] + b"BIN\0" + good[20:], "large.glb": good[:12] + struct.pack("<I", 2**31 + 5) + good[16:]}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    found = media.gltf_texts(spark, f"file://{tmp_path}")
    errors = {r["id"].rsplit("/", 1)[1]: r["error"] for r in found.collect()}
    assert errors == {"a.gltf": None, "b.glb": None, "cut.glb": "cut short", "old.glb": "another version", "no.glb": "no glTF container", "short.glb": "cut short", "bin.glb": "no JSON chunk", "large.glb": "cut short"}
    rows = [tuple(r)[1:] for r in features.models(found.filter("error is null")).collect()]
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0][:3] == (8, 12, 1)
