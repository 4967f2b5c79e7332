"""AVI motion-JPEG columns: lossless byte frames, RIFF index parsing, intra decoding, shot detection.

A payload byte is the grey level of one 8x8 block, so a frame is a baseline JPEG image of flat
blocks: only DC coefficients differ from zero, and with DC quantiser 8 a level decodes exactly.
The DC table gives category s a code of 9 - s bits (s = 0..8, Kraft sum 511/512), so code and
extra bits together take 9 bits for each of the 511 differences, and the AC table's only code
(end of block) takes 1. A block is thus 10 bits wide and coding is one table lookup per byte,
in numpy for a whole payload. The images are ordinary baseline JPEG.

The reader decodes frames of that make by the same table and all other baseline frames (any Huffman and quantiser
tables in the frame, AC coefficients, colour, subsampling, restart intervals, several scans) by decode_image().
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .common import arrow_map, ids_and_text

ACROSS = 64  # blocks in a row of a frame; a payload is a whole number of rows
DOWN = 16  # rows of blocks in a frame, at most
FPS = 25
BINS = 32


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """10-bit word of each difference -255..255 (code, extra bits, end of block) and the way back."""
    encode, decode = np.zeros(511, np.uint64), np.zeros(1024, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code = (1 << (9 - s)) - 2  # 8 - s ones, then a zero: '0' is category 8, '111111110' is category 0
        extra = d if d > 0 else d + (1 << s) - 1
        word = (code << s | extra if s else code) << 1
        encode[d + 255], decode[word] = word, d
    return encode, decode


ENCODE, DECODE = _tables()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def jpeg_head(rows: int, across: int = ACROSS) -> bytes:
    quant = _segment(0xDB, b"\0" + bytes([8, *[1] * 63]))
    frame = _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, across * 8, 1) + b"\1\x11\0")
    lengths = [1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
    dc = _segment(0xC4, b"\0" + bytes(lengths) + bytes(range(8, -1, -1)))
    ac = _segment(0xC4, b"\x10" + bytes([1, *[0] * 15]) + b"\0")
    return b"\xff\xd8" + quant + frame + dc + ac + _segment(0xDA, b"\1\1\0\0\x3f\0")


def encode_frames(payload: bytes) -> tuple[list[bytes], int]:
    """The payload as JPEG images of equal size, and their rows; the last is filled with zero bytes."""
    rows = min(DOWN, len(payload) // ACROSS)
    size = rows * ACROSS
    samples = np.frombuffer(payload + bytes(-len(payload) % size), np.uint8).reshape(-1, size).astype(np.int16)
    before = np.full_like(samples, 128)
    before[:, 1:] = samples[:, :-1]
    words = ENCODE[samples - before + 255].reshape(-1, 4)
    packed = (words[:, 0] << np.uint64(30)) | (words[:, 1] << np.uint64(20)) | (words[:, 2] << np.uint64(10)) | words[:, 3]
    data = packed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()
    head, step = jpeg_head(rows), size * 10 // 8
    return [head + data[at : at + step].replace(b"\xff", b"\xff\0") + b"\xff\xd9" for at in range(0, len(data), step)], rows


#: The head of the writer's images, and where the size stands in it.
OWN = jpeg_head(0)
SIZE_AT = OWN.index(b"\xff\xc0") + 5


def decode_own(image: bytes) -> np.ndarray | None:
    """Grey levels of the blocks of an image of encode_frames(), in raster order; None for any other image."""
    if image[:SIZE_AT] != OWN[:SIZE_AT] or image[SIZE_AT + 4 : len(OWN)] != OWN[SIZE_AT + 4 :] or image[-2:] != b"\xff\xd9":
        return None
    high, wide = struct.unpack_from(">HH", image, SIZE_AT)
    n = high // 8 * (wide // 8)
    data = np.frombuffer(image[len(OWN) : -2].replace(b"\xff\0", b"\xff"), np.uint8)
    if n % 4 or len(data) != n * 10 // 8:
        return None
    five = data.reshape(-1, 5).astype(np.uint64)
    packed = (five[:, 0] << np.uint64(32)) | (five[:, 1] << np.uint64(24)) | (five[:, 2] << np.uint64(16)) | (five[:, 3] << np.uint64(8)) | five[:, 4]
    words = np.stack([packed >> np.uint64(s) & np.uint64(1023) for s in (30, 20, 10, 0)], axis=1).ravel()
    return (np.cumsum(DECODE[words], dtype=np.int32) + 128).astype(np.uint8)


#: Places of the 64 coefficients in the order of the stream: diagonals, in turns downwards and upwards.
ZIGZAG = np.array([8 * r + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])
#: Rows are frequencies, columns are places: the orthonormal cosine basis.
BASIS = np.array([[(0.5 if u else 0.125**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


class _Bits:
    """Bits of one restart interval."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data.replace(b"\xff\0", b"\xff"), 0, 0, 0

    def fill(self, n: int) -> None:
        while self.n < n:
            # ones follow the data, and take() finds out whether they are used
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at, self.n = self.at + 1, self.n + 8

    def take(self, n: int) -> int:
        self.fill(n)
        self.n -= n
        value, self.held = self.held >> self.n, self.held & (1 << self.n) - 1
        if self.at - self.n // 8 > len(self.data):
            raise ValueError("entropy-coded data ends early")
        return value

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such Huffman code")

    def signed(self, size: int) -> int:
        if size > 15:
            raise ValueError("a value of more than 15 bits")
        value = self.take(size) if size else 0
        return value if not size or value >> size - 1 else value - (1 << size) + 1


def _huffman(body: bytes):
    """(class and number, {(length, code): symbol}) of each table of a segment."""
    at = 0
    while at + 17 <= len(body):
        codes, code, place = {}, 0, at + 17
        for length, count in enumerate(body[at + 1 : at + 17], 1):
            for _ in range(count):
                codes[length, code] = body[place]
                code, place = code + 1, place + 1
            code <<= 1
        yield body[at], codes
        at = place


def _scan(bits: _Bits, parts: list[tuple], across: int, first: int, last: int) -> None:
    """Reads the units first ... last - 1 of a scan; parts: (coefficients by row and column of blocks, high, wide, DC table, AC table)."""
    before = [0] * len(parts)
    for unit in range(first, last):
        row, column = divmod(unit, across)
        for k, (blocks, high, wide, dc, ac) in enumerate(parts):
            for place in range(high * wide):
                block = blocks[row * high + place // wide, column * wide + place % wide]
                before[k] += bits.signed(bits.symbol(dc))
                block[0], at = before[k], 1
                while at < 64:
                    run, size = divmod(bits.symbol(ac), 16)
                    if not size and run < 15:
                        break
                    at += run
                    if at > 63:
                        raise ValueError("a block has more than 64 coefficients")
                    block[at] = bits.signed(size)
                    at += 1


def decode_image(image: bytes) -> list[np.ndarray]:
    """The planes (uint8, rows by columns, at their own resolution) of a baseline JPEG image; the first is the luminance.

    Raises ValueError for images that are cut, damaged or not baseline, or that leave their Huffman tables out.
    """
    if image[:2] != b"\xff\xd8":
        raise ValueError("no JPEG image")
    at, every, quantisers, tables, parts, size = 2, 0, {}, {}, {}, None
    while True:
        while image[at : at + 2] == b"\xff\xff":
            at += 1
        if image[at : at + 2] == b"\xff\xd9":
            break
        if at + 4 > len(image) or image[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, length = image[at + 1], struct.unpack_from(">H", image, at + 2)[0]
        body, at = image[at + 4 : at + 2 + length], at + 2 + length
        if marker in (0xC0, 0xC1):
            depth, tall, broad, count = struct.unpack_from(">BHHB", body)
            kinds = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(count)]
            if depth != 8 or not tall or not broad or not count or any(not 1 <= f <= 4 for _, w, h, _ in kinds for f in (w, h)):
                raise ValueError("not an image of 8-bit samples")
            most_wide, most_high = max(w for _, w, _, _ in kinds), max(h for _, _, h, _ in kinds)
            size = -(-tall // (8 * most_high)), -(-broad // (8 * most_wide))
            if size[0] * size[1] > 64 * len(image):  # a block takes two bits at least
                raise ValueError("entropy-coded data ends early")
            for name, w, h, q in kinds:
                parts[name] = np.zeros((size[0] * h, size[1] * w, 64), np.int64), h, w, -(-tall * h // most_high), -(-broad * w // most_wide), q
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline image")
        elif marker == 0xDB:
            place = 0
            while place < len(body):
                wide, name = divmod(body[place], 16)
                quantisers[name] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, place + 1).astype(np.int32)
                place += 129 if wide else 65
        elif marker == 0xC4:
            tables.update(_huffman(body))
        elif marker == 0xDD:
            every = struct.unpack_from(">H", body)[0]
        elif marker == 0xDA:
            names = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
            if size is None or any(n not in parts or t >> 4 not in tables or 16 + (t & 15) not in tables for n, t in names):
                raise ValueError("a scan without a frame or a Huffman table")
            chosen = [(*parts[n][:3], tables[t >> 4], tables[16 + (t & 15)]) for n, t in names]
            down, across = size
            if len(names) == 1:  # alone, a component's units are its blocks
                _, _, _, tall_n, broad_n, _ = parts[names[0][0]]
                down, across, chosen = -(-tall_n // 8), -(-broad_n // 8), [(chosen[0][0], 1, 1, *chosen[0][3:])]
            stop = re.compile(rb"\xff[\x01-\xcf\xd8-\xfe]").search(image, at)
            end = stop.start() if stop else len(image)
            units, step = down * across, every or down * across
            intervals = re.split(rb"\xff[\xd0-\xd7]", image[at:end])
            if len(intervals) < -(-units // step):
                raise ValueError("entropy-coded data ends early")
            for k in range(0, units, step):
                _scan(_Bits(intervals[k // step]), chosen, across, k, min(units, k + step))
            at = end
            if not stop:
                break
    if size is None:
        raise ValueError("no frame")
    planes = []
    for blocks, _, _, tall_n, broad_n, q in parts.values():
        if q not in quantisers:
            raise ValueError("no quantiser")
        square = np.zeros(blocks.shape, float)
        square[..., ZIGZAG] = blocks * quantisers[q]
        pixels = np.einsum("ux,abuv,vy->axby", BASIS, square.reshape(*blocks.shape[:2], 8, 8), BASIS, optimize=True)
        planes.append(np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8).reshape(blocks.shape[0] * 8, -1)[:tall_n, :broad_n])
    return planes


def decode_frame(image: bytes) -> np.ndarray:
    """Grey levels of a frame's 8x8 blocks, in raster order; of frames that others wrote the rounded mean luminances.

    Blocks at the right and lower edge may be smaller. Raises ValueError where decode_image() does.
    """
    own = decode_own(image)
    if own is not None:
        return own
    plane = decode_image(image)[0].astype(np.int64)
    rows, columns = np.arange(0, plane.shape[0], 8), np.arange(0, plane.shape[1], 8)
    total = np.add.reduceat(np.add.reduceat(plane, rows, axis=0), columns, axis=1)
    cells = np.outer(np.minimum(8, plane.shape[0] - rows), np.minimum(8, plane.shape[1] - columns))
    return np.rint(total / cells).astype(np.uint8).ravel()


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    """One video stream of intra frames, with an idx1 index; the payload's length is the stream's codec data (strd)."""
    frames, rows = encode_frames(payload)
    wide, high, largest = ACROSS * 8, rows * 8, max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, wide, high, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, wide, high)
    strf = struct.pack("<IiiHH4sIiiII", 40, wide, high, 1, 24, b"MJPG", wide * high * 3, 0, 0, 0, 0)
    stream = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf) + _chunk(b"strd", struct.pack("<Q", len(payload))))
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + stream)
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(_chunk(b"00dc", f))
        at += len(movi[-1])
    body = b"AVI " + head + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def chunks(data: bytes, at: int, end: int):
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, min(size, end - at - 8)
        at += 8 + size + size % 2


#: Ends of the names of chunks that hold a frame.
VIDEO = (b"dc", b"db")


def _frames(media: bytes, at: int, end: int):
    for name, a, size in chunks(media, at, end):
        if name == b"LIST" and media[a : a + 4] == b"rec ":
            yield from _frames(media, a + 4, a + size)
        elif name[2:] in VIDEO and size:
            yield a, size


def parse_avi(media: bytes) -> tuple[list[tuple[int, int]], float, int | None]:
    """Places of the frames as the index (else the movi list) has them, frames a second, and the payload's length."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    frames: list[tuple[int, int]] = []
    listed: list[tuple[int, int]] = []
    fps, length, movi = float(FPS), None, 0
    for name, at, size in chunks(media, 12, len(media)):
        kind = media[at : at + 4]
        if name == b"LIST" and kind == b"hdrl":
            for n, a, s in chunks(media, at + 4, at + size):
                if n == b"LIST" and media[a : a + 4] == b"strl":
                    for m, b, _ in chunks(media, a + 4, a + s):
                        if m == b"strh":
                            scale, rate = struct.unpack_from("<II", media, b + 20)
                            fps = rate / scale if scale else fps
                        elif m == b"strd":
                            length = struct.unpack_from("<Q", media, b)[0]
        elif name == b"LIST" and kind == b"movi":
            movi = at
            listed = list(_frames(media, at + 4, at + size))
        elif name == b"idx1":
            for a in range(at, at + size - 15, 16):
                n, _, offset, s = struct.unpack_from("<4sIII", media, a)
                # offsets count from the list's type or from the start of the file
                start = next((o for o in (movi + offset, offset) if media[o : o + 4] == n), None)
                if n[2:] in VIDEO and start is not None:
                    frames.append((start + 8, s))
    return frames or listed, fps, length


def shots(samples: np.ndarray, *, reach: int = 8, k: float = 3.0, floor: float = 0.15) -> list[tuple[int, int]]:
    """First and last-exclusive frames of each shot.

    A cut stands before frame i if the histogram difference to frame i - 1 exceeds the mean plus k deviations
    of the `reach` differences before it, and the floor.
    """
    n = len(samples)
    hist = np.bincount((np.arange(n)[:, None] * BINS + samples // (256 // BINS)).ravel(), minlength=n * BINS).reshape(n, BINS) / samples.shape[1]
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    total, squares = np.concatenate([[0], np.cumsum(diff)]), np.concatenate([[0], np.cumsum(diff * diff)])
    i = np.arange(len(diff))
    start = np.maximum(0, i - reach)
    count = np.maximum(1, i - start)
    mean = (total[i] - total[start]) / count
    deviation = np.sqrt(np.maximum(0, (squares[i] - squares[start]) / count - mean * mean))
    cuts = [0, *(np.flatnonzero((diff > mean + k * deviation + 1e-9) & (diff > floor) & (i > 0)) + 1).tolist(), n]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def read_avi(media: bytes) -> tuple[bytes, np.ndarray, float]:
    """The payload, the frames' samples and frames a second. The payload of a file that others wrote is all its samples."""
    places, fps, length = parse_avi(media)
    if not places:
        raise ValueError("no frames")
    samples = np.stack([decode_frame(media[a : a + s]) for a, s in places])  # frames of different sizes are an error
    payload = samples.tobytes()
    return payload if length is None else payload[:length], samples, fps


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % ACROSS or (0 if text else ACROSS))


MEDIA = StructType([StructField("doc_id", LongType()), StructField("n_bytes", LongType()), StructField("media", BinaryType())])
CLIPS = StructType([StructField("doc_id", LongType()), StructField("clip", IntegerType()), StructField("start_s", DoubleType()), StructField("end_s", DoubleType()), StructField("frames", IntegerType()), StructField("mean_level", DoubleType())])
READ = StructType(
    [StructField("doc_id", LongType()), StructField("n_bytes", LongType()), StructField("payload_bytes", LongType()), StructField("payload_sha256", StringType()), StructField("tail_crc32", LongType()), StructField("media_bytes", LongType()), StructField("media_sha256", StringType()), StructField("feature", StringType()), StructField("clips", ArrayType(StructType(CLIPS.fields[1:])))]
)


def to_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text as an AVI file in a binary column.

    Null texts are empty and give one row of blocks; repeated rows and null ids give a row each; an empty table
    gives none; other columns are not read.
    """

    def run(rows):
        for doc_id, text in rows:
            yield doc_id, len(text), write_avi(padded(text))

    return arrow_map(ids_and_text(docs, id_col, text_col), run, MEDIA)


def clip_rows(samples: np.ndarray, fps: float) -> list[tuple]:
    return [(n, a / fps, b / fps, b - a, round(float(samples[a:b].mean()), 6)) for n, (a, b) in enumerate(shots(samples))]


def read_media(media: DataFrame) -> DataFrame:
    """Reads the files of to_media() back: digests of payload and file, a feature string and the clips.

    A file that is null, cut, empty, damaged or no AVI of baseline JPEG frames of one size has null payload columns, the reason as feature ("error=...") and no clips; null
    files have null media columns as well. Repeated rows give a row each; an empty table gives none; other columns are not read.
    """

    def run(rows):
        for doc_id, n_bytes, file in rows:
            try:
                if file is None:
                    raise ValueError("no file")
                payload, samples, fps = read_avi(file)
            except (ValueError, struct.error, IndexError) as e:
                yield doc_id, n_bytes, None, None, None, None if file is None else len(file), None if file is None else hashlib.sha256(file).hexdigest(), f"error={e}", []
                continue
            clips = clip_rows(samples, fps)
            feature = f"frames={len(samples)};shots={len(clips)};clips=" + ",".join(f"{a:.2f}-{b:.2f}:{m:.3f}" for _, a, b, _, m in clips)
            yield doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature, [dict(zip(CLIPS.names[1:], c, strict=True)) for c in clips]

    return arrow_map(media.select("doc_id", "n_bytes", "media"), run, READ)


def clips(media: DataFrame) -> DataFrame:
    """One row per detected clip: doc_id, clip, start_s, end_s, frames, mean_level."""
    return read_media(media).select("doc_id", F.inline("clips"))
