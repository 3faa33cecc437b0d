"""Media columns: lossless motion-JPEG in AVI containers, read back, cut into shots.

A text's bytes become grey frames of 24 by 24 samples. Each frame is a lossless JPEG (process SOF3, left
predictor) whose Huffman table gives every difference nine bits in all, so whole batches of frames are coded and
decoded as arrays; tables of other encoders are decoded sample by sample. The container is read through its RIFF
chunks and its index. Shots end where the histograms of successive frames differ by more than the differences
just before lead one to expect.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import text_of

SIDE = 24
FRAME = SIDE * SIDE
FRAME_MS = 40
#: Bits of a coded sample, code and difference together, with the table written here.
WORD = 9
SCAN = FRAME * WORD // 8
#: Frames that are coded or decoded as one array.
BLOCK = 4096
#: Grey levels of a histogram, differences looked back on, deviations above their mean, and least difference of a cut.
LEVELS, LOOK_BACK, DEVIATIONS, LEAST_CUT = 16, 12, 2.5, 120


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: Start of every frame: table with one code of each length 1 to 9 for categories 8 to 0, size, scan with predictor 1.
HEAD = (
    b"\xff\xd8"
    + _segment(0xC4, bytes([0]) + bytes([1] * WORD + [0] * (16 - WORD)) + bytes(range(WORD - 1, -1, -1)))
    + _segment(0xC3, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + bytes([1, 0x11, 0]))
    + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
)
TAIL = b"\xff\xd9"


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Difference + 255 to its nine bits, and back; 511 is no code."""
    encode = np.zeros(511, np.uint16)
    decode = np.full(512, 9999, np.int16)
    for diff in range(-255, 256):
        k = abs(diff).bit_length()
        word = (((1 << (WORD - k)) - 2) << k) | (diff if diff > 0 else diff + (1 << k) - 1)
        encode[diff + 255] = word
        decode[word] = diff
    return encode, decode


def code_scans(frames: np.ndarray) -> np.ndarray:
    """Samples (n, 576) to scan bytes (n, 648), before stuffing."""
    samples = frames.reshape(-1, SIDE, SIDE).astype(np.int16)
    diff = samples.copy()
    diff[:, :, 1:] -= samples[:, :, :-1]
    diff[:, 1:, 0] -= samples[:, :-1, 0]
    diff[:, 0, 0] -= 128
    words = _tables()[0][diff.reshape(-1, 8) + 255]
    out = np.empty((len(words), WORD), np.uint8)
    out[:, 0] = words[:, 0] >> 1
    for j in range(1, 8):
        out[:, j] = (words[:, j - 1] << (8 - j)) | (words[:, j] >> (j + 1))
    out[:, 8] = words[:, 7] & 255
    return out.reshape(-1, SCAN)


def read_scans(scans: np.ndarray) -> np.ndarray:
    """Scan bytes (n, 648) to samples (n, 576)."""
    packed = scans.reshape(-1, WORD).astype(np.uint16)
    words = np.empty((len(packed), 8), np.uint16)
    for j in range(8):
        words[:, j] = ((packed[:, j] << (j + 1)) | (packed[:, j + 1] >> (7 - j))) & 511
    diff = _tables()[1][words].reshape(-1, SIDE, SIDE)
    if diff.max(initial=0) > 255:
        raise ValueError("a scan holds no valid code")
    first = 128 + np.cumsum(diff[:, :, 0], axis=1, dtype=np.int16)
    rows = np.cumsum(diff[:, :, 1:], axis=2, dtype=np.int16)
    out = np.empty(diff.shape, np.uint8)
    out[:, :, 0] = first
    out[:, :, 1:] = first[:, :, None] + rows
    return out.reshape(-1, FRAME)


def write_avi(frames: list[bytes]) -> bytes:
    """An AVI file of one video stream of JPEG frames, with an index."""
    movi, index, at = [b"movi"], [], 4
    for data in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(data)))
        movi.append(struct.pack("<4sI", b"00dc", len(data)) + data + b"\0" * (len(data) & 1))
        at += 8 + len(data) + (len(data) & 1)
    n, most = len(frames), max(map(len, frames), default=0)
    main = struct.pack("<14I", FRAME_MS * 1000, 0, 0, 0x10, n, 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, FRAME_MS, 1000, 0, n, most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    picture = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 256, 0)

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack("<4sI", name, len(body)) + body

    streams = chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", picture))
    body = b"AVI " + chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + streams) + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index))
    return chunk(b"RIFF", body)


def avi_frames(media: bytes) -> tuple[int, list[memoryview]]:
    """Milliseconds of a frame, and the frames' data, found through the index of an AVI file."""
    view = memoryview(media)
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"AVI ":
        raise ValueError("not an AVI file")
    chunks: dict[bytes, int] = {}
    sizes: dict[bytes, int] = {}

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, length = struct.unpack_from("<4sI", view, at)
            if name == b"LIST":
                kind = bytes(view[at + 8 : at + 12])
                chunks[kind], sizes[kind] = at + 8, length
                if kind != b"movi":
                    walk(at + 12, at + 8 + length)
            else:
                chunks.setdefault(name, at + 8)
                sizes.setdefault(name, length)
            at += 8 + length + (length & 1)

    walk(12, 8 + struct.unpack_from("<I", view, 4)[0])
    frame_us = struct.unpack_from("<I", view, chunks[b"avih"])[0]
    movi = chunks[b"movi"]
    index = np.frombuffer(view[chunks[b"idx1"] : chunks[b"idx1"] + sizes[b"idx1"]], "<u4").reshape(-1, 4)
    return frame_us // 1000, [view[movi + at + 8 : movi + at + 8 + n] for at, n in index[:, 2:].tolist()]


def _head(data: bytes) -> tuple[int, bool, dict]:
    """Where a frame's scan begins, whether it is coded like ours, and its Huffman table."""
    at, table, size = 2, {}, None
    while True:
        marker, length = struct.unpack_from(">HH", data, at)
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xFFC4:
            counts, values, code, i = body[1:17], body[17:], 0, 0
            for bits, many in enumerate(counts, 1):
                for _ in range(many):
                    table[bits, code] = values[i]
                    code, i = code + 1, i + 1
                code <<= 1
        elif marker == 0xFFC3:
            size = struct.unpack(">BHH", body[:5])
        elif marker == 0xFFDA:
            if size != (8, SIDE, SIDE) or body[-3] != 1:
                raise ValueError(f"only lossless frames of {SIDE} by {SIDE} 8-bit samples with the left predictor are read")
            ours = {(WORD - k, (1 << (WORD - k)) - 2): k for k in range(WORD)}
            return at, table == ours, table
        elif marker >> 8 != 0xFF or 0xFFC0 <= marker <= 0xFFCF:
            raise ValueError("not a lossless JPEG frame")


def _any_scan(scan: bytes, table: dict) -> np.ndarray:
    """One frame's scan with any table, as the bytes that our own table would give."""
    bits = "".join(f"{b:08b}" for b in scan)
    at, diffs = 0, np.empty(FRAME, np.int64)
    for i in range(FRAME):
        n = 1
        while (k := table.get((n, int(bits[at : at + n], 2)))) is None:
            n += 1
            if n > 16:
                raise ValueError("a scan holds no valid code")
        at += n
        raw = int(bits[at : at + k], 2) if k else 0
        diffs[i] = raw if k and raw >> (k - 1) else raw - (1 << k) + 1 if k else 0
        at += k
    words = _tables()[0][diffs + 255]
    return np.packbits(((words[:, None] >> np.arange(WORD - 1, -1, -1)) & 1).astype(np.uint8).reshape(-1))


def payload_of(text: str) -> tuple[int, bytes]:
    """The text's length in UTF-8, and its bytes with 255 appended up to a positive multiple of a frame."""
    raw = text.encode("utf-8")
    return len(raw), raw + b"\xff" * (FRAME - len(raw) if len(raw) < FRAME else -len(raw) % FRAME)


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """An AVI file of each payload."""
    counts = [len(p) // FRAME for p in payloads]
    frames = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, FRAME)
    jpegs: list[bytes] = []
    for at in range(0, len(frames), BLOCK):
        raw = code_scans(frames[at : at + BLOCK]).tobytes()
        jpegs += [HEAD + raw[i : i + SCAN].replace(b"\xff", b"\xff\0") + TAIL for i in range(0, len(raw), SCAN)]
    out, at = [], 0
    for n in counts:
        out.append(write_avi(jpegs[at : at + n]))
        at += n
    return out


def decode_media(files: list[bytes]) -> list[tuple[int, np.ndarray]]:
    """Milliseconds of a frame and samples (frames, 576) of each AVI file."""
    scans: list[bytes] = []
    counts = []
    seen, start, ours, table = b"", 0, True, {}
    for media in files:
        ms, frames = avi_frames(media)
        counts.append((ms, len(frames)))
        for frame in frames:
            data = bytes(frame)
            if not seen or not data.startswith(seen):
                start, ours, table = _head(data)
                seen = data[:start]
            scan = data[start : data.rindex(TAIL)].replace(b"\xff\0", b"\xff")
            scans.append(scan if ours else _any_scan(scan, table).tobytes())
    if any(len(s) != SCAN for s in scans):
        raise ValueError("a scan does not hold a frame")
    samples = [read_scans(np.frombuffer(b"".join(scans[at : at + BLOCK]), np.uint8)) for at in range(0, len(scans), BLOCK)]
    joined = np.concatenate(samples) if samples else np.empty((0, FRAME), np.uint8)
    ends = np.cumsum([n for _, n in counts])
    return [(ms, joined[e - n : e]) for (ms, n), e in zip(counts, ends)]


def histograms(frames: list[np.ndarray]) -> np.ndarray:
    """Counts (frames, LEVELS) of grey levels of frames of any sizes, each brought to ``FRAME`` samples in all."""
    counts = np.stack([np.bincount((f >> 4).ravel().astype(np.int64), minlength=LEVELS) for f in frames])
    return counts * FRAME // np.maximum(1, counts.sum(axis=1, keepdims=True))


def shots(frames: np.ndarray) -> list[int]:
    """The first frame of every shot."""
    n = len(frames)
    if n < 2:
        return [0] * n
    bins = (frames >> 4).astype(np.int64) + np.arange(n)[:, None] * LEVELS
    return cuts_of(np.bincount(bins.ravel(), minlength=n * LEVELS).reshape(n, LEVELS))


def cuts_of(counts: np.ndarray) -> list[int]:
    """Where histograms move further than those shortly before did: the first frame of every shot."""
    n = len(counts)
    diff = np.abs(np.diff(counts, axis=0)).sum(axis=1)
    total = np.concatenate([[0], np.cumsum(diff)])
    squares = np.concatenate([[0], np.cumsum(diff * diff)])
    here = np.arange(n - 1)
    since = np.maximum(0, here - LOOK_BACK)
    many = np.maximum(1, here - since)
    mean = (total[here] - total[since]) / many
    spread = np.sqrt(np.maximum(0.0, (squares[here] - squares[since]) / many - mean * mean))
    return [0, *(np.flatnonzero((diff >= LEAST_CUT) & (diff > mean + DEVIATIONS * spread)) + 1).tolist()]


def clip_rows(ms: int, frames: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(clip, start ms, end ms, mean level in thousandths) of every shot."""
    cuts = shots(frames)
    levels = frames.sum(axis=1, dtype=np.int64)
    return [(k, a * ms, b * ms, int(levels[a:b].sum() * 1000 // ((b - a) * FRAME))) for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(frames)]))]


def _groups(payloads: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows together until they have a block of frames; the last item of a row is its payload or file."""
    group, size = [], 0
    for row in payloads:
        group.append(row)
        size += len(row[-1])
        if size >= BLOCK * FRAME:
            yield group
            group, size = [], 0
    if group:
        yield group


def media_column(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: every text, a null one being empty, as an AVI file."""

    def of(batches):
        for batch in batches:
            for group in _groups((d, *payload_of(t)) for d, t in zip(batch["doc_id"].tolist(), batch["text"])):
                ids, sizes, payloads = zip(*group)
                out = pd.DataFrame({"doc_id": ids, "n_bytes": sizes, "media": encode_payloads(list(payloads))})
                yield out.astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInPandas(of, "doc_id long, n_bytes long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """``doc_id, clip, start_ms, end_ms, level`` of every shot of every file of ``media_column``."""

    def of(batches):
        for batch in batches:
            for group in _groups(zip(batch["doc_id"].tolist(), batch["media"])):
                decoded = decode_media([m for _, m in group])
                rows = [(d, *c) for (d, _), (ms, frames) in zip(group, decoded) for c in clip_rows(ms, frames)]
                yield pd.DataFrame(rows, columns=["doc_id", "clip", "start_ms", "end_ms", "level"]).astype({"doc_id": "Int64"})

    return media.select("doc_id", "media").mapInPandas(of, "doc_id long, clip int, start_ms long, end_ms long, level long")


def media_digests(docs: DataFrame) -> DataFrame:
    """What is stored for every text, read back: sizes, checksums and clips.

    ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``: the payload is what the
    decoder returns. ``feature`` lists the clips as start-end/level in milliseconds and thousandths. Files are built and
    read in the same task, so the media need not cross to another. A null text is empty, and so one frame of padding;
    equal texts have equal values, repeated rows each give a row, a null ``doc_id`` is kept, an empty table stays empty.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def of(batches):
        for batch in batches:
            for group in _groups((d, *payload_of(t)) for d, t in zip(batch["doc_id"].tolist(), batch["text"])):
                files = encode_payloads([p for _, _, p in group])
                rows = []
                for (doc, size, _), media, (ms, frames) in zip(group, files, decode_media(files)):
                    back = frames.tobytes()
                    feature = ",".join(f"{a}-{b}/{level}" for _, a, b, level in clip_rows(ms, frames))
                    rows.append((doc, size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInPandas(of, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
