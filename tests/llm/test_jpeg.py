"""The JPEG reader against a plain encoder and the transform as the standard writes it, on images of other makes than the writer's."""

import struct

import numpy as np
import pytest

from tessella.llm import media

#: One code of eight bits for each of these symbols, for all tables.
SYMBOLS = [run << 4 | size for run in range(16) for size in range(11) if size or run in (0, 15)]


def segment(marker, body):
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def zigzag():
    """The cells in the order of the stream, walked step by step."""
    r = c = 0
    for _ in range(64):
        yield r, c
        if (r + c) % 2 == 0:
            r, c = (r + 1, c) if c == 7 else (r, c + 1) if r == 0 else (r - 1, c + 1)
        else:
            r, c = (r, c + 1) if r == 7 else (r + 1, c) if c == 0 else (r + 1, c - 1)


def code(symbol):
    return format(SYMBOLS.index(symbol), "08b")


def extra(value):
    size = abs(value).bit_length()
    return format(value if value > 0 else value + (1 << size) - 1, f"0{size}b") if size else ""


def block_bits(cells, before):
    order = [int(cells[p]) for p in zigzag()]
    d = order[0] - before
    out, run = code(abs(d).bit_length()) + extra(d), 0
    last = max([k for k in range(1, 64) if order[k]], default=0)
    for v in order[1 : last + 1]:
        if not v:
            run += 1
            continue
        while run > 15:
            out, run = out + code(0xF0), run - 16
        out, run = out + code(run << 4 | abs(v).bit_length()) + extra(v), 0
    return out + (code(0) if last < 63 else "")


def packed(bits):
    bits += "1" * (-len(bits) % 8)
    return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")


def made(high, wide, factors, every=0, apart=False, seed=0):
    """An image of random coefficients and its planes by the definition of the transform."""
    rng = np.random.default_rng(seed)
    most_h, most_w = max(h for h, _ in factors), max(w for _, w in factors)
    down, across = -(-high // (8 * most_h)), -(-wide // (8 * most_w))
    quant = [rng.integers(1, 4, (8, 8)) for _ in factors]
    coefficients, planes, sizes = [], [], []
    for (h, w), q in zip(factors, quant):
        cells = np.where(rng.random((down * h, across * w, 8, 8)) < 0.1, rng.integers(-30, 31, (down * h, across * w, 8, 8)), 0)
        cells[..., 0, 0] = rng.integers(-200, 200, cells.shape[:2])
        cells[0, 0, 7, 7] = 5
        plane = np.zeros((down * h * 8, across * w * 8))
        for a, b in np.ndindex(*cells.shape[:2]):
            for y in range(8):
                for x in range(8):
                    u = np.array([(0.5**0.5 if k == 0 else 1) * np.cos((2 * x + 1) * k * np.pi / 16) for k in range(8)])
                    v = np.array([(0.5**0.5 if k == 0 else 1) * np.cos((2 * y + 1) * k * np.pi / 16) for k in range(8)])
                    plane[a * 8 + y, b * 8 + x] = v @ (cells[a, b] * q) @ u / 4 + 128
        sizes.append((-(-high * h // most_h), -(-wide * w // most_w)))
        coefficients.append(cells)
        planes.append(np.clip(np.rint(plane), 0, 255)[: sizes[-1][0], : sizes[-1][1]])
    out = b"\xff\xd8" + segment(0xFE, b"a comment")
    out += b"".join(segment(0xDB, bytes([k]) + bytes(int(q[p]) for p in zigzag())) for k, q in enumerate(quant))
    out += segment(0xC0, struct.pack(">BHHB", 8, high, wide, len(factors)) + b"".join(bytes([k + 1, w << 4 | h, k]) for k, (h, w) in enumerate(factors)))
    table = bytes([0] * 7 + [len(SYMBOLS)] + [0] * 8) + bytes(SYMBOLS)
    out += segment(0xC4, b"\0" + table + b"\x10" + table) + (segment(0xDD, struct.pack(">H", every)) if every else b"")
    for group in [[k] for k in range(len(factors))] if apart else [list(range(len(factors)))]:
        out += segment(0xDA, bytes([len(group)]) + b"".join(bytes([k + 1, 0]) for k in group) + b"\0\x3f\0")
        if len(group) == 1:
            k = group[0]
            units = [[(k, a, b)] for a in range(-(-sizes[k][0] // 8)) for b in range(-(-sizes[k][1] // 8))]
        else:
            units = [[(k, a * factors[k][0] + i, b * factors[k][1] + j) for k in group for i in range(factors[k][0]) for j in range(factors[k][1])] for a in range(down) for b in range(across)]
        step = every or len(units)
        for n, at in enumerate(range(0, len(units), step)):
            before, bits = dict.fromkeys(group, 0), ""
            for k, a, b in [x for u in units[at : at + step] for x in u]:
                bits += block_bits(coefficients[k][a, b], before[k])
                before[k] = int(coefficients[k][a, b, 0, 0])
            out += (bytes([0xFF, 0xD0 + (n - 1) % 8]) if n else b"") + packed(bits)
    return out + b"\xff\xd9", planes


@pytest.mark.parametrize(
    ("high", "wide", "factors", "every", "apart"),
    [(16, 24, [(1, 1)], 0, False), (19, 37, [(2, 2), (1, 1), (1, 1)], 0, False), (33, 40, [(1, 2), (1, 1), (1, 1)], 2, False), (16, 16, [(1, 1)] * 3, 1, True), (8, 8, [(1, 1)], 0, False)],
)
def test_any_baseline_image_is_decoded(high, wide, factors, every, apart):
    image, planes = made(high, wide, factors, every, apart)
    got = media.decode_image(image)
    assert [p.shape for p in got] == [p.shape for p in planes]
    assert all(np.abs(a.astype(int) - b).max() <= 1 for a, b in zip(got, planes))
    levels = [planes[0][a : a + 8, b : b + 8].mean() for a in range(0, planes[0].shape[0], 8) for b in range(0, planes[0].shape[1], 8)]
    assert np.abs(media.decode_frame(image).astype(int) - levels).max() <= 1.5


def test_frames_of_the_writer_are_ordinary_jpeg():
    payload = bytes(range(256)) * 4
    frame = media.encode_frames(payload)[0][0]
    (plane,) = media.decode_image(frame)
    assert plane.shape == (128, 512) and (plane == np.kron(np.frombuffer(payload, np.uint8).reshape(16, 64), np.ones((8, 8), int))).all()
    assert media.decode_frame(frame).tobytes() == payload


def test_damage_is_a_value_error():
    image, _ = made(19, 37, [(2, 2), (1, 1), (1, 1)], 2)
    for cut in range(0, len(image) - 3, 5):
        with pytest.raises((ValueError, struct.error, IndexError)):
            media.decode_image(image[:cut])
    with pytest.raises(ValueError, match="not a baseline"):
        media.decode_image(image.replace(b"\xff\xc0", b"\xff\xc2"))
    rng = np.random.default_rng(3)
    for _ in range(60):
        hurt = bytearray(image)
        hurt[int(rng.integers(2, len(hurt)))] = int(rng.integers(0, 256))
        try:
            media.decode_image(bytes(hurt))
        except (ValueError, struct.error, IndexError):
            pass


def test_clips_of_a_file_of_another_make(spark):
    """Two still scenes of colour images, in rec lists, with an index that counts from the start of the file."""
    scenes = [made(48, 64, [(2, 2), (1, 1), (1, 1)], seed=k)[0] for k in (1, 2)]
    frames = [scenes[0]] * 12 + [scenes[1]] * 12
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    strh = b"vidsMJPG" + struct.pack("<IHHIIII", 0, 0, 0, 0, 1, 12, 0) + bytes(24)
    head = chunk(b"LIST", b"hdrl" + chunk(b"LIST", b"strl" + chunk(b"strh", strh)))
    movi, index = b"movi", b""
    base = 12 + len(head) + 8
    for f in frames:
        index += struct.pack("<4sIII", b"00dc", 16, base + len(movi) + 12, len(f))
        movi += chunk(b"LIST", b"rec " + chunk(b"00dc", f))
    files = []
    for tail in (chunk(b"idx1", index), b""):  # without an index the lists are walked
        body = b"AVI " + head + chunk(b"LIST", movi) + tail
        files.append((len(files), 0, b"RIFF" + struct.pack("<I", len(body)) + body))
    df = spark.createDataFrame(files, "doc_id bigint, n_bytes bigint, media binary")
    assert sorted((r.doc_id, r.clip, r.start_s, r.end_s, r.frames) for r in media.clips(df).collect()) == [(d, k, k * 1.0, k + 1.0, 12) for d in (0, 1) for k in (0, 1)]
