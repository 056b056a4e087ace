"""Motion-JPEG in AVI: lossless storing of payloads, RIFF index parsing, intra-frame decoding, shots.

A payload byte is stored as one quantised DCT coefficient, the unit of a JPEG scan. Coefficients of size
category 8 carry eight appended bits, and these are the payload byte itself: +b for b >= 128, b - 255 below.
With eight-bit Huffman codes every symbol is a byte, so that scans are coded and decoded by numpy reshapes.
Frames are baseline JPEG, each with its own tables, all intra.

Reading takes any baseline frame: Huffman and quantisation tables as the frame has them (or the standard's, which
motion-JPEG leaves out), several components, subsampling, restart markers. Luma is dequantised and brought
back by the inverse cosine transform; shots are found by the histograms of its pixels.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALIGN = 64
#: Payload bytes of a block, blocks of a frame, frame side in pixels, frames a second.
PER_BLOCK, BLOCKS, SIDE, FPS = 32, 64, 64, 25
PER_FRAME = PER_BLOCK * BLOCKS
#: One-byte Huffman codes: DC difference 0; AC run 0 size 8; end of block.
DC_ZERO, AC_EIGHT, END = 0x00, 0x00, 0x01
BLOCK_BYTES = 1 + 2 * PER_BLOCK + 1
BINS = 16
#: Blocks that are transformed at a time.
TRANSFORMED = 1 << 15
#: Documents that a task holds as media at a time.
DOCS = 64
#: A cut needs a histogram difference over mean + this many deviations of the last WINDOW differences, and over a share of the frame.
DEVIATIONS, WINDOW, LEAST_SHARE = 3.0, 8, 0.25


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, symbols: bytes) -> bytes:
    """A Huffman table whose codes all have eight bits, in the order of symbols."""
    return _segment(0xC4, bytes([kind]) + bytes([0] * 7 + [len(symbols)] + [0] * 8) + symbols)


HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, b"\x00" + b"\x01" * 64)
    + _segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + b"\x01\x11\x00")
    + _table(0x00, b"\x00")
    + _table(0x10, b"\x08\x00")
    + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
)
TAIL = b"\xff\xd9"


def padded(data: bytes) -> bytes:
    return data + b"\x00" * (-len(data) % ALIGN or (0 if data else ALIGN))


def encode_frames(payload: bytes) -> list[bytes]:
    raw = np.frombuffer(payload + b"\x00" * (-len(payload) % PER_FRAME), dtype=np.uint8).reshape(-1, BLOCKS, PER_BLOCK)
    scan = np.empty((len(raw), BLOCKS, BLOCK_BYTES), dtype=np.uint8)
    scan[:, :, 0], scan[:, :, -1] = DC_ZERO, END
    scan[:, :, 1:-1:2] = AC_EIGHT
    scan[:, :, 2:-1:2] = raw
    stuff = b"\xff" in payload
    scans = [s.tobytes() for s in scan]
    return [HEAD + (s.replace(b"\xff", b"\xff\x00") if stuff else s) + TAIL for s in scans]


#: Place in the 8 x 8 block of each coefficient, along the diagonals in turns.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (sum(divmod(i, 8)), i % 8 if sum(divmod(i, 8)) % 2 == 0 else i // 8)))
#: The inverse transform of a dequantised block in natural order, as one matrix.
_COSINE = np.array([[(np.sqrt(1 / 8) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
INVERSE = np.einsum("vy,ux->vuyx", _COSINE, _COSINE).reshape(64, 64).astype(np.float32)


def _rest(first: bytes) -> bytes:
    """first and then, ascending, all other AC symbols of baseline JPEG: runs of 0 to 15 before sizes of 1 to 10, end of block, 16 zeros."""
    every = {r << 4 | s for r in range(16) for s in range(1, 11)} | {0x00, 0xF0}
    return first + bytes(sorted(every - set(first)))


#: The standard's Huffman tables (codes of each length, symbols), by class (0 DC, 1 AC) and number (0 luma, 1 chroma).
STANDARD = {
    (0, 0): (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))),
    (0, 1): (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12))),
    (1, 0): (bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]), _rest(bytes.fromhex("01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82"))),
    (1, 1): (bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]), _rest(bytes.fromhex("00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"))),
}


@dataclass(frozen=True)
class Luma:
    """The first component of a frame: quantised coefficients in zigzag order, block by block along the rows, and what makes pixels of them."""

    coefficients: np.ndarray
    quantiser: np.ndarray
    width: int
    height: int

    def pixels(self) -> np.ndarray:
        """Rows of pixels, 0 to 255."""
        across = -(-self.width // 8)
        out = transformed(self.coefficients, self.quantiser).reshape(-1, across, 8, 8).swapaxes(1, 2)
        return out.reshape(-1, across * 8)[: self.height, : self.width]


def transformed(coefficients: np.ndarray, quantiser: np.ndarray) -> np.ndarray:
    """Pixels of blocks in natural order, 64 a row."""
    out = np.empty((len(coefficients), 64), dtype=np.uint8)
    matrix = INVERSE[ZIGZAG] * quantiser[:, None].astype(np.float32)
    for lo in range(0, len(out), TRANSFORMED):
        y = coefficients[lo : lo + TRANSFORMED].astype(np.float32) @ matrix
        y += 128.5
        out[lo : lo + TRANSFORMED] = np.clip(y, 0, 255, out=y)
    return out


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol of a Huffman table."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


class Bits:
    """Bits of an entropy-coded stretch without its stuffing; ones follow its end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.size = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.size < n:
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            if self.at > len(self.data) + 8:
                raise ValueError("the scan ends too early")
            self.at, self.size = self.at + 1, self.size + 8
        self.size -= n
        out = self.held >> self.size
        self.held &= (1 << self.size) - 1
        return out

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (found := codes.get((length, code))) is not None:
                return found
        raise ValueError("unknown Huffman code")

    def number(self, size: int) -> int:
        """A coefficient of `size` appended bits."""
        v = self.take(size) if size else 0
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def decode_frame(frame: bytes) -> Luma:
    """The luma of a baseline JPEG frame. Anything else (progressive, arithmetic, 12 bits) raises ValueError."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, quantisers, huffman, shape, restart = 2, {}, dict(STANDARD), None, 0
    while True:
        if frame[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        while frame[at + 1] == 0xFF:  # fill bytes
            at += 1
        marker, n = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body, at = frame[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quantisers[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int32)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                total = sum(body[1:17])
                huffman[body[0] >> 4, body[0] & 15] = (body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif marker in (0xC0, 0xC1):
            bits, height, width, count = struct.unpack_from(">BHHB", body)
            if bits != 8 or not height or not width:
                raise ValueError("not a baseline frame")
            shape = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(count)]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            scan = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
            break
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline frame")
    if shape is None or any(c[0] not in scan for c in shape):
        raise ValueError("no frame header, or a scan of some components only")
    end = frame.rfind(TAIL)
    data = frame[at : end if end >= at else len(frame)]
    quantiser = quantisers[shape[0][3]]
    if len(shape) == 1 and not restart:
        down, across = -(-height // 8), -(-width // 8)
        tables = huffman[0, scan[shape[0][0]][0]], huffman[1, scan[shape[0][0]][1]]
        found = _whole_bytes(data, *tables, down * across)
        if found is None:
            found = _scan(data, [(1, 1, *[_codes(*t) for t in tables])], down * across, 0)
        return Luma(found, quantiser, width, height)
    most_h, most_v = max(c[1] for c in shape), max(c[2] for c in shape)
    h, v = shape[0][1], shape[0][2]
    if (h, v) != (most_h, most_v):
        raise ValueError("luma is not the finest component")
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    parts = [(c[1], c[2], _codes(*huffman[0, scan[c[0]][0]]), _codes(*huffman[1, scan[c[0]][1]])) for c in shape]
    found = _scan(data, parts, across * down, restart)
    grid = found.reshape(down, across, v, h, 64).swapaxes(1, 2).reshape(down * v, across * h, 64)
    return Luma(grid[: -(-height // 8), : -(-width // 8)].reshape(-1, 64), quantiser, width, height)


def _whole_bytes(data: bytes, dc: tuple[bytes, bytes], ac: tuple[bytes, bytes], blocks: int) -> np.ndarray | None:
    """The coefficients of a scan whose every code and appended number is a byte, in blocks of one layout; None if this scan isn't such."""
    eight = bytes([0] * 7)
    if not (dc[0][:7] == ac[0][:7] == eight and dc[1] == b"\x00" and ac[1] == b"\x08\x00" and dc[0][7] == 1 and ac[0][7] == 2):
        return None
    scan = data.replace(b"\xff\x00", b"\xff") if b"\xff" in data else data
    if len(scan) != blocks * BLOCK_BYTES:
        return None
    codes = np.frombuffer(scan, dtype=np.uint8).reshape(-1, BLOCK_BYTES)
    if (codes[:, 0] != DC_ZERO).any() or (codes[:, 1:-1:2] != AC_EIGHT).any() or (codes[:, -1] != END).any():
        return None
    bits = codes[:, 2:-1:2].astype(np.int16)
    out = np.zeros((blocks, 64), dtype=np.int16)
    out[:, 1 : 1 + PER_BLOCK] = np.where(bits >= 128, bits, bits - 255)
    return out


def _scan(data: bytes, parts: list[tuple], units: int, restart: int) -> np.ndarray:
    """Coefficients of the first component's blocks in the order of the scan. parts: for each component blocks across and down in a unit, DC and AC codes."""
    stretches = re.split(rb"\xff+[\xd0-\xd7]", data) if restart else [data]
    out, done = [], 0
    for stretch in stretches:
        bits = Bits(stretch.replace(b"\xff\x00", b"\xff"))
        before = [0] * len(parts)
        for _ in range(min(restart or units, units - done)):
            done += 1
            for k, (h, v, dc, ac) in enumerate(parts):
                for _ in range(h * v):
                    block = [0] * 64
                    before[k] += bits.number(bits.symbol(dc))
                    block[0] = before[k]
                    at = 1
                    while at < 64:
                        symbol = bits.symbol(ac)
                        if symbol == 0:
                            break
                        at += symbol >> 4
                        if symbol & 15:
                            if at > 63:
                                raise ValueError("a block has too many coefficients")
                            block[at] = bits.number(symbol & 15)
                        at += 1
                    if k == 0:
                        out.append(block)
    if done < units:
        raise ValueError("the scan ends too early")
    return np.array(out, dtype=np.int16)


def to_bytes(luma: Luma) -> bytes:
    """The payload bytes that write_avi() stored in the coefficients after DC."""
    c = luma.coefficients[:, 1 : 1 + PER_BLOCK]
    return np.where(c > 0, c, c + 255).astype(np.uint8).tobytes()


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def write_avi(payload: bytes) -> bytes:
    """An AVI file with the payload (any bytes, at least one); its length is kept in the INFO list."""
    frames = encode_frames(payload)
    n, largest = len(frames), max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, n, 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    hdrl = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _list(b"INFO", _chunk(b"ISRC", str(len(payload)).encode()))
    chunks = [_chunk(b"00dc", f) for f in frames]
    size = np.array([len(c) for c in chunks], dtype=np.uint32)
    index = np.zeros((n, 4), dtype="<u4")
    index[:, 0] = struct.unpack("<I", b"00dc")[0]
    index[:, 1] = 0x10
    index[:, 2] = 4 + np.cumsum(size) - size
    index[:, 3] = [len(f) for f in frames]
    body = hdrl + info + _list(b"movi", b"".join(chunks)) + _chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"AVI " + body


def chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(tag or list type, start, end) of the chunks in a stretch of a RIFF file; a list's start is after its type."""
    while at + 8 <= end:
        tag, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        start, stop = at + 8, min(at + 8 + n, end)
        yield (data[start : start + 4], start + 4, stop) if tag == b"LIST" else (tag, start, stop)
        at += 8 + n + n % 2


def read_avi(data: bytes) -> tuple[int | None, list[Luma], int]:
    """(length in the INFO list, luma of each video frame, microseconds a frame), by the RIFF tree and its index; without an index by the frames in turn."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, length, usec = None, None, None, 0
    for kind, start, end in chunks(data, 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])):
        if kind == b"movi":
            movi = start, end
        elif kind == b"idx1":
            index = np.frombuffer(data, dtype="<u4", count=(end - start) // 16 * 4, offset=start).reshape(-1, 4)
        elif kind == b"hdrl":
            usec = next((struct.unpack_from("<I", data, a)[0] for tag, a, _ in chunks(data, start, end) if tag == b"avih"), 0)
        elif kind == b"INFO":
            length = next((int(data[a:z].rstrip(b"\x00")) for tag, a, z in chunks(data, start, end) if tag == b"ISRC"), None)
    if movi is None:
        raise ValueError("no frames")
    if index is not None:
        video = [(o, n) for tag, o, n in zip(index[:, 0].tolist(), index[:, 2].tolist(), index[:, 3].tolist()) if struct.pack("<I", tag)[2:] in (b"dc", b"db") and n]
        # offsets count from the list's type or from the file's beginning
        base = movi[0] - 4 if video and data[movi[0] - 4 + video[0][0] :][2:4] in (b"dc", b"db") else 0
        places = [(base + o + 8, base + o + 8 + n) for o, n in video]
    else:
        places = [(a, z) for tag, a, z in chunks(data, *movi) if tag[2:] in (b"dc", b"db") and z > a]
    return length, [decode_frame(data[a:z]) for a, z in places], usec


def payload_of(length: int | None, frames: list[Luma]) -> bytes:
    """What write_avi() stored."""
    return b"".join(map(to_bytes, frames))[:length]


def histograms(frames: list[Luma]) -> np.ndarray:
    """Pixels of each frame in BINS steps of luma. Frames of the usual form are transformed together."""
    out = np.zeros((len(frames), BINS), dtype=np.int64)
    whole = [k for k, f in enumerate(frames) if f.width % 8 == f.height % 8 == 0 and np.array_equal(f.quantiser, frames[0].quantiser)]
    for k in set(range(len(frames))) - set(whole):
        out[k] = np.bincount(frames[k].pixels().ravel() >> 4, minlength=BINS)
    group, size = [], 0
    for k in whole:
        group.append(k)
        size += len(frames[k].coefficients)
        if size >= TRANSFORMED or k == whole[-1]:
            bins = transformed(np.concatenate([frames[j].coefficients for j in group]), frames[0].quantiser) >> 4
            owner = np.repeat(np.arange(len(group)), [len(frames[j].coefficients) for j in group])
            # 64 pixels of a block fall in BINS steps: counted by block, then summed by frame
            out[group] = np.bincount((owner[:, None] * BINS + bins).ravel(), minlength=len(group) * BINS).reshape(-1, BINS)
            group, size = [], 0
    return out


def shots(hist: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, end frame) of each shot. A cut stands where the histogram differs from the last frame's by more than recent differences suggest."""
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1)
    cuts = [0]
    for t in range(len(diff)):
        past = diff[max(cuts[-1], t - WINDOW) : t]  # within the shot
        n, total, square = len(past), int(past.sum()), int((past.astype(np.int64) ** 2).sum())
        d = int(diff[t])
        # d > mean + DEVIATIONS * deviation, in whole numbers
        over = n >= 2 and d * n > total and (d * n - total) ** 2 > DEVIATIONS**2 * (n * square - total**2)
        if over and d >= LEAST_SHARE * 2 * int(hist[t].sum()):
            cuts.append(t + 1)
    return list(zip(cuts, [*cuts[1:], len(hist)])) if len(hist) else []


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_shots long"


def media_digest(docs: DataFrame) -> DataFrame:
    """One row for each document, from the media as read back.

    Null and empty texts are 64 zero bytes. The feature names frames and shots in milliseconds, `f2;0-40,40-80`;
    it depends on the text alone. Repeated rows stay repeated, a null doc_id keeps its row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        for b in (x.slice(i, DOCS) for x in batches for i in range(0, len(x), DOCS)):
            rows, every, at = [], [], [0]
            for text in b.column(1).to_pylist():
                data = encoded(text)
                media = write_avi(padded(data))
                length, frames, usec = read_avi(media)
                payload = payload_of(length, frames)
                every += frames
                at.append(len(every))
                rows.append((len(data), payload, len(media), hashlib.sha256(media).hexdigest(), usec))
            hist, out = histograms(every), []
            for (n, payload, size, digest, usec), lo, hi in zip(rows, at, at[1:]):
                cut = shots(hist[lo:hi])
                feature = f"f{hi - lo};" + ",".join(f"{s * usec // 1000}-{e * usec // 1000}" for s, e in cut)
                out.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), size, digest, feature, hi - lo, len(cut)))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]], [x.split()[0] for x in DIGEST.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DIGEST)


CLIPS = "id long, shot int, start_ms long, end_ms long, first_frame int, end_frame int"


def clips(media: DataFrame) -> DataFrame:
    """Timed clip rows of media (id long, data binary): AVI files with baseline motion-JPEG, one at a time. Null data: no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        for b in batches:
            for i, data in zip(b.column(0), b.column(1)):
                if data.is_valid:
                    _, frames, usec = read_avi(data.as_py())
                    rows = [(i.as_py(), k, s * usec // 1000, e * usec // 1000, s, e) for k, (s, e) in enumerate(shots(histograms(frames)))]
                    columns = list(zip(*rows)) or [()] * len(kinds)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in CLIPS.split(", ")])

    return media.select(F.col("id").cast("long").alias("id"), "data").mapInArrow(run, CLIPS)


def to_media(docs: DataFrame) -> DataFrame:
    """(id, data): each text of docs (doc_id, text) stored as an AVI file; null and empty texts as 64 zero bytes. Rows stay as many as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, DOCS) for x in batches for i in range(0, len(x), DOCS)):
            data = [write_avi(padded(encoded(t))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["id", "data"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "id long, data binary")
