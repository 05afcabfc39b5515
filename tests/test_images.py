"""Image files written by hand and read back: depths, filters, interlacing, run-length and string codes, damage."""

import struct
import zlib

import numpy as np
import pytest

from atelier.sources import images

RNG = np.random.default_rng(6)


def some(height, width, n, most=256):
    """Stretches of equal values among others."""
    cells = RNG.integers(0, most, (height, width, n))
    cells[:, width // 3 : width // 2] = cells[:, :1]
    return cells


def png_file(cells, kind, bits, laced=False, palette=None, clear=None):
    """Every filter in turn, by the definition, byte after byte."""
    height, width, n = cells.shape
    step, raw, turn = max(1, n * bits // 8), bytearray(), 0
    for x, y, dx, dy in images.PNG_PASSES if laced else ((0, 0, 1, 1),):
        part = cells[y::dy, x::dx]
        if not part.size:
            continue
        above = None
        for row in part:
            if bits == 16:
                line = row.astype(">u2").tobytes()
            else:
                text = "".join(format(int(v), f"0{bits}b") for v in row.ravel())
                line = int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")
            above = above or bytes(len(line))
            how, turn = turn % 5, turn + 1
            out = bytearray([how])
            for i, v in enumerate(line):
                a, b, c = line[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
                p = a + b - c
                paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                out.append((v - (0, a, b, (a + b) // 2, paeth)[how]) & 255)
            raw += out
            above = line
    chunk = lambda k, body: struct.pack(">I4s", len(body), k) + body + b"crc!"
    packed = zlib.compress(bytes(raw))
    middle = (chunk(b"PLTE", palette) if palette else b"") + (chunk(b"tRNS", clear) if clear else b"")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, kind, 0, 0, laced)) + middle + chunk(b"IDAT", packed[:7]) + chunk(b"IDAT", packed[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("laced", [False, True])
@pytest.mark.parametrize(("kind", "bits"), [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (4, 8), (4, 16), (6, 8), (6, 16)])
def test_png(kind, bits, laced):
    for height, width in ((1, 1), (7, 13), (20, 9)):
        n = images.PNG_SAMPLES[kind]
        cells = some(height, width, n, 1 << bits)
        eight = cells >> 8 if bits == 16 else cells * 255 // ((1 << bits) - 1)
        rgb = np.repeat(eight[..., :1], 3, 2) if n < 3 else eight[..., :3]
        got = images.png(png_file(cells, kind, bits, laced))
        assert (got[..., :3] == rgb).all() and (got[..., 3:] == (eight[..., -1:] if n in (2, 4) else 255)).all()


def test_png_palettes_and_clear_colours():
    palette = RNG.integers(0, 256, (4, 3)).astype(np.uint8)
    cells = some(6, 11, 1, 4)
    got = images.png(png_file(cells, 3, 2, palette=palette.tobytes(), clear=bytes([0, 90])))
    assert (got[..., :3] == palette[cells[..., 0]]).all() and (got[..., 3] == np.array([0, 90, 255, 255])[cells[..., 0]]).all()
    deep = some(5, 5, 3, 1 << 16)
    got = images.png(png_file(deep, 2, 16, clear=deep[2, 3].astype(">u2").tobytes()))
    assert got[2, 3, 3] == 0 and got[0, 0, 3] == (0 if (deep[0, 0] == deep[2, 3]).all() else 255)


def gif_file(values, width, height, palette, laced=False, clear=None, place=(0, 0), canvas=None):
    """Codes of the string table, with a table that fills up and starts anew."""
    order = np.concatenate([np.arange(a, height, s) for a, s in images.GIF_PASSES]) if laced else np.arange(height)
    least = max(2, (len(palette) - 1).bit_length())
    table, size, bits, out, word = {bytes([k]): k for k in range(1 << least)}, least + 1, [], bytearray(), b""
    n = (1 << least) + 2
    put = lambda code: bits.extend(code >> k & 1 for k in range(size))
    put(1 << least)
    for v in np.asarray(values).reshape(height, width)[order].ravel().tolist():
        if word + bytes([v]) in table:
            word += bytes([v])
            continue
        put(table[word])
        if n < 4096:
            table[word + bytes([v])] = n
            n += 1
            if n > 1 << size and size < 12:
                size += 1
        else:
            put(1 << least)
            table, n, size = {bytes([k]): k for k in range(1 << least)}, (1 << least) + 2, least + 1
        word = bytes([v])
    put(table[word])
    put((1 << least) + 1)
    for k in range(0, len(bits), 8):
        out.append(sum(b << i for i, b in enumerate(bits[k : k + 8])))
    blocks = b"".join(bytes([len(out[k : k + 255])]) + bytes(out[k : k + 255]) for k in range(0, len(out), 255)) + b"\0"
    w, h = canvas or (width, height)
    depth = (len(palette) - 1).bit_length() - 1
    extra = b"\x21\xf9\x04" + bytes([1, 0, 0, clear]) + b"\0" if clear is not None else b""
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 128 | depth, 0, 0) + palette.tobytes() + b"\x21\xfe\x02hi\0" + extra + b"\x2c" + struct.pack("<4HB", *place, width, height, 64 * laced) + bytes([least]) + blocks + b";"


@pytest.mark.parametrize("colours", [2, 16, 256])
@pytest.mark.parametrize("laced", [False, True])
def test_gif(colours, laced):
    palette = RNG.integers(0, 256, (colours, 3)).astype(np.uint8)
    for height, width in ((1, 1), (9, 14), (130, 90)):
        values = some(height, width, 1, colours)[..., 0]
        got = images.gif(gif_file(values, width, height, palette, laced, clear=1))
        assert (got[..., 3] == np.where(values == 1, 0, 255)).all() and (got[..., :3] == np.where(values[..., None] == 1, 0, palette[values])).all()
    small = images.gif(gif_file([[0, 1], [1, 0]], 2, 2, palette, place=(3, 1), canvas=(6, 4)))
    assert small.shape == (4, 6, 4) and (small[..., 3] > 0).sum() == 4 and (small[1, 3, :3] == palette[0]).all()


def runs(cells):
    """Packets of equal and of unequal pixels."""
    out, k, rows = b"", 0, [bytes(c) for c in cells]
    while k < len(rows):
        n = 1
        while k + n < len(rows) and n < 128 and rows[k + n] == rows[k]:
            n += 1
        out += bytes([127 + n]) + rows[k] if n > 1 else bytes([0]) + rows[k]
        k += n
    return out


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("how", [0, 16, 32, 48])
def test_tga(packed, how):
    height, width = 7, 12
    turned = lambda c: (c if how & 32 else c[::-1])[:, :: -1 if how & 16 else 1]
    head = lambda kind, bits, alpha=0, mapped=0, count=0, deep=0: struct.pack("<BBBHHBHHHHBB", 2, mapped, kind | 8 * packed, 0, count, deep, 0, 0, width, height, bits, how | alpha) + b"id"
    body = lambda c: runs(c.reshape(-1, c.shape[2]).astype(np.uint8)) if packed else c.astype(np.uint8).tobytes()
    cells = some(height, width, 4)
    got = images.tga(head(2, 32, 8) + body(turned(cells)[..., [2, 1, 0, 3]]))
    assert (got == cells).all()
    assert (images.tga(head(2, 24) + body(turned(cells)[..., 2::-1]))[..., :3] == cells[..., :3]).all()
    assert (images.tga(head(3, 8) + body(turned(cells[..., :1]))) == np.concatenate([np.repeat(cells[..., :1], 3, 2), np.full((height, width, 1), 255)], 2)).all()
    five = cells[..., :3] // 8
    word = five[..., 0] << 10 | five[..., 1] << 5 | five[..., 2]
    assert (images.tga(head(2, 16) + body(turned(np.stack([word & 255, word >> 8], 2))))[..., :3] == five * 255 // 31).all()
    palette = RNG.integers(0, 256, (10, 3)).astype(np.uint8)
    values = some(height, width, 1, 10)
    assert (images.tga(head(1, 8, mapped=1, count=10, deep=24) + palette[:, ::-1].tobytes() + body(turned(values)))[..., :3] == palette[values[..., 0]]).all()


@pytest.mark.parametrize(("mode", "planes"), [(1, 1), (1, 2), (3, 3), (3, 4), (3, 5)])
@pytest.mark.parametrize("packed", [0, 1])
def test_psd(mode, planes, packed):
    cells = some(6, 20, planes)
    head = b"8BPS" + struct.pack(">H6xHIIHH", 1, planes, 6, 20, 8, mode) + struct.pack(">I", 0) + struct.pack(">I", 3) + b"abc" + struct.pack(">I", 5) + b"layer" + struct.pack(">H", packed)
    lines = cells.transpose(2, 0, 1).reshape(-1, 20).astype(np.uint8)

    def pack(line):
        out, k, row = b"\x80", 0, line.tolist()
        while k < len(row):
            n = 1
            while k + n < len(row) and row[k + n] == row[k]:
                n += 1
            out += bytes([257 - n, row[k]]) if n > 1 else bytes([0, row[k]])
            k += n
        return out

    rows = [pack(x) for x in lines] if packed else [x.tobytes() for x in lines]
    got = images.psd(head + (struct.pack(f">{len(rows)}H", *map(len, rows)) if packed else b"") + b"".join(rows))
    need = 1 if mode == 1 else 3
    assert (got[..., :3] == (np.repeat(cells[..., :1], 3, 2) if need == 1 else cells[..., :3])).all() and (got[..., 3] == (cells[..., need] if planes > need else 255)).all()


def test_files_of_a_folder(spark, tmp_path):
    palette = np.array([[0, 0, 0], [200, 100, 50]], np.uint8)
    good = png_file(np.array([[[7, 8, 9]]]), 2, 8)
    files = {
        "a/x.png": good, "a/y.GIF": gif_file([[1]], 1, 1, palette), "z.tga": struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, 1, 1, 24, 32) + b"\3\2\1",
        "cut.png": good[:45], "cut.tga": struct.pack("<BBBHHBHHHHBB", 0, 0, 10, 0, 0, 0, 0, 0, 9, 9, 24, 32) + b"\3", "what.png": b"no image", "cmyk.psd": b"8BPS" + struct.pack(">H6xHIIHH", 1, 4, 1, 1, 8, 4), "void.png": b"", "no.txt": good,
    }
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["img"].rsplit("/", 1)[1]: (r["r"], r["g"], r["b"], r["a"], r["error"]) for r in images.image_pixels(spark, f"file://{tmp_path}").collect()}
    # Spark passes over the empty file
    assert got["x.png"] == (7, 8, 9, 255, None) and got["y.GIF"] == (200, 100, 50, 255, None) and got["z.tga"] == (1, 2, 3, 255, None) and len(got) == 7
    assert got["what.png"][4].startswith("unsupported") and got["cmyk.psd"][4].startswith("unsupported") and all(got[n][4] and not got[n][4].startswith("unsupported") for n in ("cut.png", "cut.tga"))
