"""Frames and films of any size, against an encoder written from the standard for these tests alone."""

import struct

import numpy as np
import pytest

from tallyloom.llm import frames as J
from tallyloom.llm import media


def segment(kind, body):
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def flat_table(symbols):
    """All codes have eight bits."""
    return bytes([0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols), {s: f"{i:08b}" for i, s in enumerate(symbols)}


def signed(v):
    n = abs(v).bit_length()
    return n, f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else ""


def packed(bits):
    bits += "1" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")


DC, DC_CODE = flat_table(range(12))
AC, AC_CODE = flat_table([0, 0xF0, *[r * 16 + s for r in range(16) for s in range(1, 12) if r < 12 or s < 3]])


def baseline(planes, factors, quant=1, every=0):
    """Planes (padded here) with sampling factors; every plane is at its own resolution."""
    cos = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for u in range(8)] for x in range(8)])
    order = sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8))
    height, width = planes[0].shape
    mh, mv = max(h for h, _ in factors), max(v for _, v in factors)
    across, down = -(-width // (8 * mh)), -(-height // (8 * mv))
    padded = [np.pad(p, ((0, down * v * 8 - p.shape[0]), (0, across * h * 8 - p.shape[1])), "edge") for p, (h, v) in zip(planes, factors)]
    scans, bits, last = [], "", [0] * len(planes)
    for unit in range(across * down):
        if every and unit and unit % every == 0:
            scans.append(packed(bits))
            bits, last = "", [0] * len(planes)
        for k, (h, v) in enumerate(factors):
            for y in range(v):
                for x in range(h):
                    r, c = (unit // across * v + y) * 8, (unit % across * h + x) * 8
                    block = np.rint(cos.T @ (padded[k][r : r + 8, c : c + 8].astype(float) - 128) @ cos / quant).astype(int).ravel()[order]
                    n, extra = signed(int(block[0]) - last[k])
                    bits, last[k], run = bits + DC_CODE[n] + extra, int(block[0]), 0
                    end = max(np.flatnonzero(block[1:]), default=-1) + 1
                    for value in block[1 : end + 1].tolist():
                        if not value:
                            run += 1
                            continue
                        while run > 15:
                            bits, run = bits + AC_CODE[0xF0], run - 16
                        n, extra = signed(value)
                        bits, run = bits + AC_CODE[run * 16 + n] + extra, 0
                    if end < 63:
                        bits += AC_CODE[0]
    scans.append(packed(bits))
    scan = b"".join(s + (bytes([0xFF, 0xD0 + i % 8]) if i < len(scans) - 1 else b"") for i, s in enumerate(scans))
    head = struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([k + 1, h * 16 + v, 0]) for k, (h, v) in enumerate(factors))
    start = bytes([len(planes)]) + b"".join(bytes([k + 1, 0]) for k in range(len(planes))) + b"\0\x3f\0"
    restart = segment(0xDD, struct.pack(">H", every)) if every else b""
    return b"\xff\xd8" + segment(0xE0, b"AVI1") + segment(0xDB, b"\0" + bytes([quant] * 64)) + segment(0xC4, b"\0" + DC) + segment(0xC4, b"\x10" + AC) + segment(0xC0, head) + restart + segment(0xDA, start) + scan + b"\xff\xd9"


def lossless(samples, predictor):
    guess, bits = {}, ""
    for y in range(samples.shape[0]):
        for x in range(samples.shape[1]):
            a, b = int(samples[y, x - 1]), int(samples[y - 1, x])
            c = int(samples[y - 1, x - 1])
            by = [a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1][predictor - 1]
            guess[y, x] = 128 if not x and not y else a if not y else b if not x else by
            n, extra = signed(int(samples[y, x]) - guess[y, x])
            bits += DC_CODE[n] + extra
    head = struct.pack(">BHHB", 8, *samples.shape, 1) + bytes([1, 0x11, 0])
    return b"\xff\xd8" + segment(0xC4, b"\0" + DC) + segment(0xC3, head) + segment(0xDA, bytes([1, 1, 0, predictor, 0, 0])) + packed(bits) + b"\xff\xd9"


def picture(height, width, phase=0.0):
    y, x = np.mgrid[:height, :width]
    return np.clip(128 + 60 * np.sin(x / 7 + phase) + 50 * np.cos(y / 5), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("height,width,every", [(8, 8, 0), (17, 30, 0), (40, 25, 2), (1, 1, 0)])
def test_grey_frames_of_any_size(height, width, every):
    image = picture(height, width)
    got = J.Frame(baseline([image], [(1, 1)], every=every)).grey()
    assert got.shape == image.shape and np.abs(got.astype(int) - image).max() <= 1


@pytest.mark.parametrize("factors", [[(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
def test_colour_frames_give_their_brightness(factors):
    image = picture(21, 35)
    small = [np.full((21 * v // factors[0][1] or 1, 35 * h // factors[0][0] or 1), 90 + 50 * k, np.uint8) for k, (h, v) in enumerate(factors[1:])]
    got = J.Frame(baseline([image, *small], factors, quant=2)).grey()
    assert got.shape == image.shape and np.abs(got.astype(int) - image).max() <= 8


@pytest.mark.parametrize("predictor", range(1, 8))
def test_lossless_frames_with_every_predictor(predictor):
    rng = np.random.default_rng(predictor)
    image = rng.integers(0, 256, (9, 13)).astype(np.uint8)
    assert np.array_equal(J.Frame(lossless(image, predictor)).grey(), image)


def film(frames, index=True, absolute=False):
    data = media.write_avi(frames)
    at = data.rindex(b"idx1")
    if not index:
        return data[:at]
    if absolute:
        rows = np.frombuffer(data[at + 8 :], "<u4").reshape(-1, 4).copy()
        rows[:, 2] += data.index(b"movi")
        return data[: at + 8] + rows.tobytes()
    return data


def test_films_of_baseline_frames_give_clips(spark):
    shots = [baseline([picture(20, 30) // 4], [(1, 1)])] * 6 + [baseline([255 - picture(20, 30) // 4], [(1, 1)])] * 5
    own = media.encode_payloads([media.payload_of("some text " * 400)[1]])[0]
    rows = [(1, film(shots)), (2, film(shots, index=False)), (3, film(shots, absolute=True)), (4, b"no film"), (5, film(shots)[:900]), (6, None), (7, own), (None, film([b"junk"])), (8, film([])), (1, film(shots))]
    got = J.film_clips(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    by = lambda i: sorted((r["clip"], r["start_ms"], r["end_ms"]) for r in got if r["id"] == i and r["fault"] is None)
    ms = media.FRAME_MS
    assert by(2) == by(3) == [(0, 0, 6 * ms), (1, 6 * ms, 11 * ms)] and by(1) == sorted(by(2) * 2) and by(8) == by(6) == []
    (_, frames), = media.decode_media([own])
    assert by(7) == [(k, a, b) for k, a, b, _ in media.clip_rows(ms, frames)]
    assert sorted((r["id"] or 0, r["clip"]) for r in got if r["fault"]) == [(0, None), (4, None), (5, None)]
    assert J.film_clips(spark.createDataFrame([], "doc_id long, media binary")).count() == 0


def test_what_is_damaged_or_unknown_is_refused():
    good = baseline([picture(16, 16)], [(1, 1)])
    for bad in (b"", b"\xff\xd8", good[:60], good.replace(b"\xff\xc0", b"\xff\xc2"), good[: good.index(b"\xff\xc4")] + good[good.index(b"\xff\xc0") :], good.replace(b"\xff\xdb", b"\xff\xe5")):
        with pytest.raises(J.UnreadableFrame):
            J.Frame(bad).grey()


def test_media_of_an_empty_table_and_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "lang é " * 300_000), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in media.media_digests(docs).collect()}
    assert got[1]["n_bytes"] == len(("lang é " * 300_000).encode()) and got[2]["n_bytes"] == 0 and got[1]["payload_bytes"] % 576 == 0
    assert media.media_digests(docs.limit(0)).count() == 0 and media.clips(media.media_column(docs.limit(0))).count() == 0
