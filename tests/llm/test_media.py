import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestore.llm import media


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=9000))
def test_round_trip(data):
    length, frames, usec = media.read_avi(media.write_avi(data))
    assert media.payload_of(length, frames) == data and usec == 40_000 and len(frames) == -(-len(data) // media.PER_FRAME)


def test_coefficients_are_of_category_eight():
    c = media.decode_frame(media.encode_frames(bytes(range(256)) * 8)[0]).coefficients
    assert set(np.abs(c[:, 1 : 1 + media.PER_BLOCK]).ravel().tolist()) == set(range(128, 256)) and not c[:, 0].any() and not c[:, 1 + media.PER_BLOCK :].any()


class Coder:
    """Baseline JPEG by the letter of the standard, for tests: bit by bit."""

    def __init__(self):
        self.bits = ""
        self.codes = {key: {s: format(c, f"0{n}b") for (n, c), s in media._codes(*table).items()} for key, table in media.STANDARD.items()}

    def number(self, v):
        n = abs(v).bit_length()
        return n, format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    def block(self, table, zz, before):
        n, more = self.number(int(zz[0]) - before)
        self.bits += self.codes[0, table][n] + more
        run = 0
        for k in range(1, 64):
            if not any(zz[k:]):
                self.bits += self.codes[1, table][0x00]
                return
            if zz[k] == 0:
                run += 1
                continue
            while run > 15:
                self.bits, run = self.bits + self.codes[1, table][0xF0], run - 16
            n, more = self.number(int(zz[k]))
            self.bits, run = self.bits + self.codes[1, table][run << 4 | n] + more, 0

    def bytes(self):
        bits = self.bits + "1" * (-len(self.bits) % 8)
        self.bits = ""
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")


def jpeg(blocks, width, height, quant, sampling=((1, 1),), restart=0, tables=False):
    """blocks: for each component its blocks by unit of the scan, in zigzag order."""
    seg, n = media._segment, len(sampling)
    head = b"\xff\xd8" + seg(0xE0, b"x\xff\xd9") + seg(0xDB, b"\x00" + bytes(map(int, quant)))
    head += seg(0xC0, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(sampling)))
    if tables:
        head += b"".join(seg(0xC4, bytes([c << 4 | t]) + counts + symbols) for (c, t), (counts, symbols) in media.STANDARD.items())
    head += seg(0xDD, struct.pack(">H", restart)) if restart else b""
    head += seg(0xDA, bytes([n]) + b"".join(bytes([k + 1, 0x11 if k else 0]) for k in range(n)) + b"\x00\x3f\x00")
    coder, out, before, at = Coder(), b"", [0] * n, [0] * n
    units = len(blocks[0]) // (sampling[0][0] * sampling[0][1])
    for u in range(units):
        if restart and u and u % restart == 0:
            out += coder.bytes() + bytes([0xFF, 0xD0 + (u // restart - 1) % 8])
            before = [0] * n
        for k, (h, v) in enumerate(sampling):
            for _ in range(h * v):
                coder.block(min(k, 1), blocks[k][at[k]], before[k])
                before[k] = int(blocks[k][at[k]][0])
                at[k] += 1
    return head + out + coder.bytes() + b"\xff\xd9"


def some_blocks(rng, n):
    out = np.where(rng.random((n, 64)) < 0.15, rng.integers(-40, 41, (n, 64)), 0)
    out[:, 0] = rng.integers(-60, 61, n)
    return out


def naive_pixels(zz, quant):
    """The inverse cosine transform by its formula."""
    f = np.zeros(64)
    f[media.ZIGZAG] = zz * quant
    f = f.reshape(8, 8)
    c = lambda u: np.sqrt(0.5) if u == 0 else 1
    return np.array([[sum(c(u) * c(v) / 4 * f[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) + 128 for x in range(8)] for y in range(8)])


@pytest.mark.parametrize("tables", [False, True])
def test_any_baseline_frame(tables):
    """The standard's tables, written or left out; odd sizes, colour with subsampling, restarts; pixels by the formula."""
    assert media.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and len(media.STANDARD[1, 0][1]) == len(media.STANDARD[1, 1][1]) == 162
    rng = np.random.default_rng(5)
    quant = rng.integers(1, 20, 64)
    grey = some_blocks(rng, 6)
    luma = media.decode_frame(jpeg([grey], 21, 13, quant, tables=tables))
    assert np.array_equal(luma.coefficients, grey) and luma.pixels().shape == (13, 21)
    want = np.hstack([naive_pixels(b, quant) for b in grey[:3]])[:, :21]
    assert np.abs(luma.pixels()[:8] - np.clip(want, 0, 255)).max() <= 1
    colour = [some_blocks(rng, 4 * 6), some_blocks(rng, 6), some_blocks(rng, 6)]
    got = media.decode_frame(jpeg(colour, 48, 32, quant, ((2, 2), (1, 1), (1, 1)), restart=4, tables=tables))
    order = colour[0].reshape(2, 3, 2, 2, 64).swapaxes(1, 2).reshape(-1, 64)
    assert np.array_equal(got.coefficients, order)


def test_fast_and_general_decoding_agree():
    frame = media.encode_frames(bytes(range(256)) * 5)[0]
    at = frame.index(b"\xff\xda") + 10
    tables = (bytes([0] * 7 + [1] + [0] * 8), b"\x00"), (bytes([0] * 7 + [2] + [0] * 8), b"\x08\x00")
    fast = media._whole_bytes(frame[at:-2], *tables, media.BLOCKS)
    slow = media._scan(frame[at:-2], [(1, 1, media._codes(*tables[0]), media._codes(*tables[1]))], media.BLOCKS, 0)
    assert np.array_equal(fast, slow)


def test_bad_frames():
    good = media.encode_frames(b"x")[0]
    for bad in (b"", b"GIF89a", good.replace(b"\xff\xc0", b"\xff\xc2"), good[:200] + b"\xff\xd9"):
        with pytest.raises((ValueError, IndexError)):
            media.decode_frame(bad)


def test_shots_by_brute_force(prose):
    """Histograms of pixels, one by one, and a film of three scenes as an AVI without index."""
    data = prose(1, 2000).encode()
    _, frames, _ = media.read_avi(media.write_avi(data))
    hist = media.histograms(frames)
    for f, h in zip(frames, hist):
        want = np.zeros(media.BINS, dtype=int)
        for c in f.coefficients[:4]:
            want += np.bincount((np.clip(naive_pixels(c, f.quantiser) + 0.5, 0, 255)).astype(np.uint8).ravel() >> 4, minlength=media.BINS)
        got = np.bincount(media.transformed(f.coefficients[:4], f.quantiser).ravel() >> 4, minlength=media.BINS)
        assert np.abs(got - want).sum() <= 4 and h.sum() == 64 * 64  # a pixel on a step's edge may fall on either side
        assert np.array_equal(h, np.bincount(f.pixels().ravel() >> 4, minlength=media.BINS))
    scene = lambda dc: jpeg([np.array([[dc] + [0] * 63] * 4)], 16, 16, [8] * 64)
    film = [scene(dc) for dc, n in ((-60, 10), (60, 5), (0, 5)) for _ in range(n)]
    movi = media._list(b"movi", b"".join(media._chunk(b"00dc", f) for f in film))
    avih = media._chunk(b"avih", struct.pack("<14I", 40_000, *[0] * 13))
    body = b"AVI " + media._list(b"hdrl", avih) + movi
    length, read, usec = media.read_avi(b"RIFF" + struct.pack("<I", len(body)) + body)
    assert length is None and usec == 40_000 and media.shots(media.histograms(read)) == [(0, 10), (10, 15), (15, 20)]


def test_digest_equals_brute_force(spark, prose):
    """Every column from the media itself, document by document."""
    texts = {1: prose(3, 3000), 2: "é", 3: prose(4, 30)}
    for r in media.media_digest(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        data = texts[r.doc_id].encode()
        stored = media.write_avi(data + bytes(-len(data) % 64))
        length, frames, usec = media.read_avi(stored)
        cut = media.shots(np.array([np.bincount(f.pixels().ravel() >> 4, minlength=media.BINS) for f in frames]))
        payload = media.payload_of(length, frames)
        assert payload[: len(data)] == data and len(payload) % 64 == 0 and not any(payload[len(data) :])
        want = (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert tuple(r)[1:7] == want
        assert r.feature == f"f{len(frames)};" + ",".join(f"{s * 40}-{e * 40}" for s, e in cut) and r.n_shots == len(cut)


def test_digest(spark, edge, empty):
    out = media.media_digest(edge).collect()
    texts = sorted((t or "") for t in [r.text for r in edge.collect()])
    assert sorted(r.n_bytes for r in out) == sorted(len(t.encode()) for t in texts)
    for r in out:
        assert r.payload_bytes % 64 == 0 and r.payload_bytes >= max(64, r.n_bytes)
    none = next(r for r in out if r.doc_id == 2)
    assert none.payload_sha256 == hashlib.sha256(bytes(64)).hexdigest() and none.tail_crc32 == zlib.crc32(bytes(64))
    a, b = [r for r in out if r.doc_id == 7]
    assert a == b
    assert media.media_digest(empty).count() == 0


def test_clips(edge, empty):
    rows = media.clips(media.to_media(edge)).collect()
    assert {r.id for r in rows} == {r.doc_id for r in edge.collect()}
    assert all(r.end_ms - r.start_ms == 40 * (r.end_frame - r.first_frame) for r in rows)
    assert media.clips(media.to_media(empty)).count() == 0
