"""Sprite files written by hand: layers, linked cels, three depths, damage."""

import struct
import zlib

import numpy as np
import pytest

from atelier.sources import sprites

text = lambda s: struct.pack("<H", len(s.encode())) + s.encode()
chunk = lambda kind, body: struct.pack("<IH", len(body) + 6, kind) + body
layer = lambda name, shown=1, kind=0, opacity=255, mode=0: chunk(0x2004, struct.pack("<6HB3x", shown, kind, 0, 0, 0, mode, opacity) + text(name))
head = lambda at, x, y, opacity, kind: struct.pack("<HhhBHh5x", at, x, y, opacity, kind, 0)
linked = lambda at, frame, x=0, y=0, opacity=255: chunk(0x2005, head(at, x, y, opacity, 1) + struct.pack("<H", frame))


def cel(at, cells, x=0, y=0, opacity=255, packed=True):
    raw = np.asarray(cells, np.uint8)
    body = zlib.compress(raw.tobytes()) if packed else raw.tobytes()
    return chunk(0x2005, head(at, x, y, opacity, 2 if packed else 0) + struct.pack("<HH", raw.shape[1], raw.shape[0]) + body)


def frame(*chunks, duration=120):
    body = b"".join(chunks)
    return struct.pack("<IHHHHI", len(body) + 16, 0xF1FA, len(chunks), duration, 0, len(chunks)) + body


def sprite(width, height, depth, *frames, clear=0, count=None):
    return struct.pack("<IHHHHHI10xB99x", 0, 0xA5E0, len(frames) if count is None else count, width, height, depth, 1, clear) + b"".join(frames)


def blend(under, over, opacity):
    """One pixel over another, in plain integers."""
    mul = lambda a, b: ((a * b + 128 >> 8) + a * b + 128) >> 8
    a = mul(over[3], opacity)
    if a == 0:
        return under
    if under[3] == 0:
        return (*over[:3], a)
    ra = under[3] + a - mul(under[3], a)
    return (*(u + int((o - u) * a / ra) for u, o in zip(under[:3], over[:3])), ra)


def test_two_layers_and_a_linked_cel():
    rng = np.random.default_rng(1)
    low, high = rng.integers(0, 256, (4, 5, 4)), rng.integers(0, 256, (3, 3, 4))
    data = sprite(5, 4, 32, frame(layer("base"), layer("glow", opacity=130), layer("off", shown=0), layer("set", kind=1), cel(0, low, packed=False), cel(1, high, x=3, y=-1, opacity=200), cel(2, low)), frame(linked(0, 0), linked(1, 0, x=-1, y=2, opacity=90)), frame(linked(1, 1), duration=0))
    s = sprites.parse(data)
    assert s.durations == [120, 120, 100] and [name for name, *_ in s.layers] == ["base", "glow", "off", "set"]
    mul = lambda a, b: ((a * b + 128 >> 8) + a * b + 128) >> 8
    for number, (dx, dy, opacity) in enumerate([(3, -1, mul(130, 200)), (-1, 2, mul(130, 90))]):
        want = {(x, y): blend((0, 0, 0, 0), tuple(low[y, x].tolist()), 255) for y in range(4) for x in range(5)}
        for y in range(3):
            for x in range(3):
                if (x + dx, y + dy) in want:
                    want[x + dx, y + dy] = blend(want[x + dx, y + dy], tuple(high[y, x].tolist()), opacity)
        got = s.frame(number)
        assert {(x, y): tuple(got[y, x].tolist()) for y in range(4) for x in range(5)} == want
    assert not s.frame(2).any()  # frame 1 has a link for that layer, and no pixels of its own


def test_depths_palettes_and_tags():
    entries = b"".join(struct.pack("<H4B", k == 1, k * 10, k, 255 - k, 255 if k != 3 else 100) + (text("red") if k == 1 else b"") for k in range(4))
    tags = chunk(0x2018, struct.pack("<H8x", 2) + b"".join(struct.pack("<HHBH6x3Bx", a, b, 0, 0, 1, 2, 3) + text(n) for a, b, n in ((0, 1, "walk"), (1, 1, ""))))
    palette = chunk(0x2019, struct.pack("<III8x", 4, 0, 3) + entries)
    s = sprites.parse(sprite(2, 2, 8, frame(palette, chunk(0x0004, struct.pack("<H2B3B", 1, 1, 1, 9, 9, 9)), tags, layer("l", mode=3), cel(0, [[[0], [1]], [[2], [3]]])), clear=2))
    assert s.frame(0).reshape(-1, 4).tolist() == [[0, 0, 255, 255], [10, 1, 254, 255], [0, 0, 0, 0], [30, 3, 252, 100]]
    assert s.tags == [{"name": "walk", "first": 0, "last": 1}, {"name": "", "first": 1, "last": 1}] and s.notes == ["blend mode 3 is taken as normal"]
    old = sprites.parse(sprite(2, 1, 8, frame(chunk(0x0011, struct.pack("<H2B3B", 1, 1, 1, 63, 0, 32)), layer("l"), cel(0, [[[1], [7]]])), clear=9))
    assert old.frame(0).reshape(-1, 4).tolist() == [[255, 0, 129, 255], [0, 0, 0, 255]]
    grey = sprites.parse(sprite(1, 1, 16, frame(layer("l"), cel(0, [[[77, 200]]]), chunk(0x2023, b""))))
    assert grey.frame(0).tolist() == [[[77, 77, 77, 200]]] and grey.notes == ["1 tile maps are left out"]


GOOD = sprite(2, 1, 32, frame(layer("l"), cel(0, [[[1, 2, 3, 255], [4, 5, 6, 0]]])))
BAD = {
    "none": b"x" * 200, "short": GOOD[:60], "canvas": sprite(0, 1, 32, frame()), "depth": sprite(1, 1, 24, frame()), "no layer": sprite(1, 1, 32, frame(cel(3, [[[1, 2, 3, 4]]]))), "cut cel": sprite(2, 2, 32, frame(layer("l"), cel(0, [[[1, 2, 3, 4]]])[:-8])),
    "forward": sprite(1, 1, 32, frame(layer("l"), linked(0, 5))), "zlib": sprite(1, 1, 32, frame(layer("l"), chunk(0x2005, head(0, 0, 0, 255, 2) + struct.pack("<HH", 1, 1) + b"junk"))), "chunk": sprite(1, 1, 32, frame(struct.pack("<IH", 2, 0x2004))),
    "no frame": sprite(1, 1, 32, count=1), "magic": sprite(1, 1, 32, b"\0" * 16), "huge cel": sprite(1, 1, 32, frame(layer("l"), chunk(0x2005, head(0, 0, 0, 255, 2) + struct.pack("<HH", 65535, 65535)))),
}


@pytest.mark.parametrize("name", BAD)
def test_damage_is_told(name):
    with pytest.raises((sprites.Damaged, struct.error, zlib.error)):
        sprites.parse(BAD[name]).frame(0)


def test_tables(spark, tmp_path):
    early = sprite(1, 1, 32, frame(layer("l"), cel(0, [[[9, 9, 9, 9]]])), count=3)
    for name, data in {"a.ase": GOOD, "b.aseprite": early, "bad.ase": BAD["no layer"], "skip.png": GOOD}.items():
        (tmp_path / name).write_bytes(data)
    name = lambda r: r["img"].rsplit("/", 1)[1]
    frames = {name(r): r for r in sprites.sprite_frames(spark, f"file://{tmp_path}").collect()}
    assert frames["a.ase"]["layers"] == ["l"] and frames["b.aseprite"]["notes"] == ["ends after 1 of 3 frames"] and frames["a.ase"]["error"] is None and len(frames) == 3
    pixels = {(name(r), r["x"]): (r["r"], r["g"], r["b"], r["a"], r["error"]) for r in sprites.sprite_pixels(spark, f"file://{tmp_path}").collect()}
    assert pixels == {("a.ase", 0): (1, 2, 3, 255, None), ("a.ase", 1): (0, 0, 0, 0, None), ("b.aseprite", 0): (9, 9, 9, 9, None), ("bad.ase", None): (None, None, None, None, "a cel is of layer 3 of 0")}
