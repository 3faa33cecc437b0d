"""Intra frames of motion-JPEG films: baseline and lossless JPEG of any size, as grey levels.

Decoded from the standard's description: segments, Huffman codes, the zigzag order, dequantisation and the inverse cosine transform as two
matrix products. Progressive and arithmetic frames, samples of other than 8 bits, and frames that leave their Huffman tables out are refused.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASELINE, LOSSLESS = (0xC0, 0xC1), (0xC3,)


class UnreadableFrame(ValueError):
    """A frame or film that this module does not read, or that is damaged."""


def zigzag() -> np.ndarray:
    """Places of an 8 by 8 block in the order in which coefficients are coded: along diagonals, in turning directions."""
    return np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))


def cosines() -> np.ndarray:
    """The matrix of the 8-point inverse transform."""
    x, u = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    return np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)


_ZIGZAG, _COSINES = zigzag(), cosines()


class _Bits:
    """Bits of a scan segment; stuffed zeros are gone already. Beyond its end there are ones, as the standard fills up."""

    def __init__(self, data: bytes) -> None:
        self.value, self.left = int.from_bytes(data + b"\xff" * 8, "big"), 8 * (len(data) + 8)

    def take(self, n: int) -> int:
        if self.left < n:
            raise UnreadableFrame("a scan ends too early")
        self.left -= n
        out = self.value >> self.left
        self.value &= (1 << self.left) - 1
        return out

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise UnreadableFrame("a scan holds no valid code")

    def signed(self, n: int) -> int:
        raw = self.take(n) if n else 0
        return raw if not n or raw >> (n - 1) else raw - (1 << n) + 1


def _tables(body: bytes, into: dict[int, dict[tuple[int, int], int]]) -> None:
    at = 0
    while at + 17 <= len(body):
        counts, table, code, i = body[at + 1 : at + 17], {}, 0, at + 17
        for bits, many in enumerate(counts, 1):
            for _ in range(many):
                table[bits, code] = body[i]
                code, i = code + 1, i + 1
            code <<= 1
        into[body[at]], at = table, i


class Frame:
    """The segments of one frame, and its first component's samples."""

    def __init__(self, data: bytes) -> None:
        if data[:2] != b"\xff\xd8":
            raise UnreadableFrame("no JPEG frame")
        self.quant: dict[int, np.ndarray] = {}
        self.codes: dict[int, dict[tuple[int, int], int]] = {}
        self.kind, self.every, at = 0, 0, 2
        try:
            while True:
                while data[at + 1] == 0xFF:
                    at += 1
                kind, length = struct.unpack_from(">xBH", data, at)
                if data[at] != 0xFF:
                    raise UnreadableFrame("a segment does not begin where the last one ends")
                body = data[at + 4 : at + 2 + length]
                at += 2 + length
                if kind == 0xDB:
                    self._quantisers(body)
                elif kind == 0xC4:
                    _tables(body, self.codes)
                elif kind == 0xDD:
                    (self.every,) = struct.unpack(">H", body[:2])
                elif kind in BASELINE + LOSSLESS:
                    self.kind = kind
                    bits, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
                    self.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
                    if bits != 8 or not self.height or not self.width or not n or any(not h or not v for _, h, v, _ in self.parts):
                        raise UnreadableFrame("only frames of 8-bit samples are read")
                elif 0xC0 <= kind <= 0xCF:
                    raise UnreadableFrame(f"frames of kind {kind:02x} are not read")
                elif kind == 0xDA:
                    break
        except (struct.error, IndexError) as e:
            raise UnreadableFrame("the frame is cut off") from e
        if not self.kind:
            raise UnreadableFrame("a scan without a frame header")
        n = body[0]
        self.scan = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(n)}
        self.predictor = body[1 + 2 * n]
        if set(self.scan) != {p[0] for p in self.parts}:
            raise UnreadableFrame("only frames of one scan are read")
        end = data.rfind(b"\xff\xd9")
        self.segments = self._segments(data[at : end if end >= at else len(data)])

    def _quantisers(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, number = body[at] >> 4, body[at] & 15
            size = 64 << wide
            self.quant[number] = np.frombuffer(body[at + 1 : at + 1 + size], ">u2" if wide else "u1").astype(np.float64)
            at += 1 + size

    @staticmethod
    def _segments(scan: bytes) -> list[bytes]:
        """The scan between its restart markers, without stuffed zeros."""
        out, start, at = [], 0, scan.find(b"\xff")
        while at >= 0:
            if scan[at + 1 : at + 2] and 0xD0 <= scan[at + 1] <= 0xD7:
                out.append(scan[start:at])
                start = at + 2
            at = scan.find(b"\xff", at + 2)
        return [s.replace(b"\xff\0", b"\xff") for s in [*out, scan[start:]]]

    def grey(self) -> np.ndarray:
        """Samples (height, width) of the first component, which is the brightness where there are several."""
        try:
            return self._lossless() if self.kind in LOSSLESS else self._baseline()
        except (KeyError, IndexError) as e:
            raise UnreadableFrame("the frame lacks a table or a part of its scan") from e

    def _baseline(self) -> np.ndarray:
        most_h, most_v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        first = self.parts[0]
        if len(self.parts) == 1:
            most_h = most_v = 1
            self.parts = [(first[0], 1, 1, first[3])]
        across, down = -(-self.width // (8 * most_h)), -(-self.height // (8 * most_v))
        h, v = self.parts[0][1:3]
        blocks = np.zeros((down * v, across * h, 64))
        segments = iter(self.segments)
        bits, last = _Bits(next(segments)), dict.fromkeys(self.scan, 0)
        for unit in range(across * down):
            if self.every and unit and unit % self.every == 0:
                bits, last = _Bits(next(segments, b"")), dict.fromkeys(self.scan, 0)
            for k, (name, ph, pv, _) in enumerate(self.parts):
                for y in range(pv):
                    for x in range(ph):
                        block = self._block(bits, name, last)
                        if k == 0:
                            blocks[unit // across * pv + y, unit % across * ph + x, _ZIGZAG] = block
        table = np.empty(64)
        table[_ZIGZAG] = self.quant[first[3]]
        values = (blocks * table).reshape(*blocks.shape[:2], 8, 8)
        samples = np.clip(np.rint(_COSINES @ values @ _COSINES.T) + 128, 0, 255).astype(np.uint8)
        whole = samples.transpose(0, 2, 1, 3).reshape(down * v * 8, across * h * 8)
        scale_h, scale_v = most_h // h, most_v // v
        return np.repeat(np.repeat(whole, scale_v, axis=0), scale_h, axis=1)[: self.height, : self.width]

    def _block(self, bits: _Bits, name: int, last: dict[int, int]) -> list[int]:
        dc, ac = self.codes[self.scan[name][0]], self.codes[16 + self.scan[name][1]]
        out = [0] * 64
        last[name] += bits.signed(bits.symbol(dc))
        out[0], k = last[name], 1
        while k < 64:
            run, size = divmod(bits.symbol(ac), 16)
            if not size:
                if run != 15:
                    break
                k += 16
                continue
            k += run
            out[k] = bits.signed(size)
            k += 1
        return out

    def _lossless(self) -> np.ndarray:
        if len(self.parts) != 1 or not 1 <= self.predictor <= 7 or self.every:
            raise UnreadableFrame("only lossless frames of one component without restarts are read")
        table, bits = self.codes[self.scan[self.parts[0][0]][0]], _Bits(self.segments[0])
        out = np.zeros((self.height, self.width), np.int64)
        for y in range(self.height):
            for x in range(self.width):
                a, b = int(out[y, x - 1]) if x else 0, int(out[y - 1, x]) if y else 0
                c = int(out[y - 1, x - 1]) if x and y else 0
                guess = (128 if not x else a) if not y else b if not x else (a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1)[self.predictor - 1]
                out[y, x] = (guess + bits.signed(bits.symbol(table))) & 0xFFFF
        return out.astype(np.uint8)


def film_frames(media: bytes) -> tuple[int, list[bytes]]:
    """Microseconds of a frame, and the data of the video frames of an AVI file, by its index; without one, in the order of the file."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise UnreadableFrame("not an AVI file")
    found: list[tuple[bytes, int, int]] = []

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, size = struct.unpack_from("<4sI", media, at)
            if name == b"LIST" and at + 12 <= end:
                found.append((media[at + 8 : at + 12], at + 12, max(0, min(size, end - at - 8) - 4)))
                walk(at + 12, min(at + 8 + size, end))
            else:
                found.append((name, at + 8, min(size, end - at - 8)))
            at += 8 + size + (size & 1)

    walk(12, len(media))
    first = {name: (at, size) for name, at, size in reversed(found)}
    if b"avih" not in first or b"movi" not in first:
        raise UnreadableFrame("the film has no header or no frames")
    (micros,) = struct.unpack_from("<I", media, first[b"avih"][0])
    is_video = lambda name: name[2:] in (b"dc", b"db")
    if b"idx1" in first:
        at, size = first[b"idx1"]
        rows = [struct.unpack_from("<4sIII", media, at + k) for k in range(0, size - 15, 16)]
        base = first[b"movi"][0] - 4
        # Places count from the list's name in most files, and from the file's beginning in some.
        if rows and media[base + rows[0][2] : base + rows[0][2] + 4] != rows[0][0]:
            base = 0
        places = [(base + o + 8, n) for name, _, o, n in rows if is_video(name)]
    else:
        places = [(at, n) for name, at, n in found if is_video(name)]
    if any(at + n > len(media) for at, n in places):
        raise UnreadableFrame("the film is cut off")
    return micros, [media[at : at + n] for at, n in places if n]


def film_clips(films: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """``id, clip, start_ms, end_ms, level, fault`` of the shots of motion-JPEG films whose frames may have any size.

    Shots are where the histogram of a frame moves away from those before it, as in ``media.shots``. A film that cannot be read gives one
    row with a null clip and its fault; a null film and one without frames give none. Repeated rows each give theirs.
    """
    from tallyloom.llm.media import cuts_of, histograms

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, media in zip(batch["id"].tolist(), batch["media"]):
                try:
                    micros, frames = film_frames(bytes(media))
                    greys = [Frame(f).grey() for f in frames]
                except UnreadableFrame as e:
                    rows.append((name, None, None, None, None, str(e)))
                    continue
                cuts = cuts_of(histograms(greys)) if greys else []
                for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(greys)])):
                    level = int(sum(int(g.sum()) for g in greys[a:b]) * 1000 // sum(g.size for g in greys[a:b]))
                    rows.append((name, k, a * micros // 1000, b * micros // 1000, level, None))
            out = pd.DataFrame(rows, columns=["id", "clip", "start_ms", "end_ms", "level", "fault"])
            yield out.astype({"id": "Int64", "clip": "Int32", "start_ms": "Int64", "end_ms": "Int64", "level": "Int64"})

    rows = films.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).where("media IS NOT NULL")
    return rows.mapInPandas(of, "id long, clip int, start_ms long, end_ms long, level long, fault string")
