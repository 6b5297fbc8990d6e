"""Binary payloads in baseline JPEG files, and features of such files from their DC coefficients.

``encode`` keeps a payload without loss in the format's own unit, the quantised coefficient: 192
bytes become one minimum coded unit of three 8x8 blocks. Byte b is stored as the coefficient whose
size category is 8 and whose eight extra bits are b, so all bytes keep their value through the entropy
coding. ``decode`` is a decoder for baseline JPEG in general: it parses the markers, and undoes the Huffman
coding of all restart intervals of all given files in step, as numpy arrays. ``thumbnail``
uses the DC coefficients of the luminance component alone.

Defined results: null and empty texts give one unit of 192 spaces; equal texts give equal values;
a file that is not baseline JPEG raises ValueError; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import map_arrow
from ._words import blocks

UNIT = 192
#: Units whose entropy coding is done at once: bounds memory for texts of any length.
STEP = 8192
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, thumb_sha256 string"


def zigzag() -> np.ndarray:
    """Raster position of each coefficient in zigzag order."""
    order = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * y + x for y, x in order])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _shape(units: int) -> tuple[int, int]:
    """Units across and down."""
    across = max(1, min(8191, int(np.ceil(np.sqrt(units)))))
    return across, -(-units // across)


def encode(payload: np.ndarray) -> bytes:
    """A baseline JPEG that holds ``payload``, bytes whose number is a positive multiple of 192."""
    units = len(payload) // UNIT
    across, down = _shape(units)
    if down > 8191:
        raise ValueError("a payload of this length does not fit in one picture")
    components = bytes(x for c in (1, 2, 3) for x in (c, 0x11, 0))
    head = b"".join((
        b"\xff\xd8",
        _segment(0xFE, b"payload=%d" % len(payload)),
        _segment(0xDB, bytes([0]) + bytes([1]) * 64),
        _segment(0xC0, struct.pack(">BHHB", 8, down * 8, across * 8, 3) + components),
        _segment(0xC4, bytes([0x00, 1]) + bytes(15) + bytes([8])),
        _segment(0xC4, bytes([0x10, 1]) + bytes(15) + bytes([8])),
        _segment(0xDD, struct.pack(">H", 1)),
        _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])),
    ))
    parts, total = [head], across * down
    for at in range(0, total, STEP):
        n = min(STEP, total - at)
        part = np.zeros(n * UNIT, np.uint8)
        have = payload[at * UNIT : (at + n) * UNIT]
        part[: len(have)] = have
        bits = np.zeros((n * UNIT, 9), np.uint8)  # the only code, 0, and then the byte
        bits[:, 1:] = np.unpackbits(part).reshape(-1, 8)
        coded = np.empty((n, UNIT * 9 // 8 + 2), np.uint8)
        coded[:, :-2] = np.packbits(bits.reshape(-1)).reshape(n, -1)
        coded[:, -2], coded[:, -1] = 0xFF, 0xD0 + (at + np.arange(n)) % 8
        stuffed = coded == 0xFF
        stuffed[:, -2] = False
        counts = 1 + stuffed.reshape(-1)
        flat = np.repeat(coded.reshape(-1), counts)
        flat[np.cumsum(counts)[stuffed.reshape(-1)] - 1] = 0
        parts.append(flat.tobytes())
    return b"".join(parts)[:-2] + b"\xff\xd9"


@dataclass
class Picture:
    """What the markers of one file say."""

    width: int = 0
    height: int = 0
    components: list = field(default_factory=list)  # (id, across, down, quantisation table)
    quantisers: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)  # (class, id): the segment's bytes
    scan: list = field(default_factory=list)  # (component number, DC table, AC table)
    restart: int = 0
    comment: bytes = b""
    data: tuple = (0, 0)

    def schedule(self) -> tuple:
        """The component of each block of a unit, with its tables: pictures of one schedule are decoded in step."""
        return tuple((c, self.tables[0, dc], self.tables[1, ac]) for c, dc, ac in self.scan for _ in range(self.components[c][1] * self.components[c][2] if len(self.scan) > 1 else 1))

    def units(self) -> tuple[int, int]:
        wide, high = (max(x[i] for x in self.components) if len(self.components) > 1 else 1 for i in (1, 2))
        return -(-self.width // (8 * wide)), -(-self.height // (8 * high))


def parse(media: bytes) -> Picture:
    """Read the markers up to the scan of a baseline JPEG."""
    if media[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    found, at = Picture(), 2
    while True:
        while media[at : at + 1] == b"\xff" and media[at + 1 : at + 2] == b"\xff":
            at += 1
        if at + 4 > len(media) or media[at] != 0xFF:
            raise ValueError("a marker was expected")
        marker, length = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
        body = media[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xC0:
            _, found.height, found.width, n = struct.unpack(">BHHB", body[:6])
            found.components = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                n = sum(body[i + 1 : i + 17])
                found.tables[body[i] >> 4, body[i] & 15] = body[i + 1 : i + 17 + n]
                i += 17 + n
        elif marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                found.quantisers[body[i] & 15] = np.frombuffer(body[i + 1 : i + 65 + 64 * wide], ">u2" if wide else np.uint8)
                i += 65 + 64 * wide
        elif marker == 0xDD:
            found.restart = int.from_bytes(body, "big")
        elif marker == 0xFE:
            found.comment = body
        elif marker == 0xDA:
            ids = [c[0] for c in found.components]
            found.scan = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            found.data = (at, len(media))
            return found


def lookup(table: bytes) -> np.ndarray:
    """For each 16 bits that come next: code length * 256 + symbol; 0 if no code fits."""
    out, code, at = np.zeros(1 << 16, np.int32), 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _peek(data: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The 16 bits from each bit position."""
    at = bit >> 3
    three = data[at].astype(np.int64) << 16 | data[at + 1].astype(np.int64) << 8 | data[at + 2]
    return (three >> (8 - (bit & 7))) & 0xFFFF


def intervals(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scan without stuffing and markers, padded, and where each restart interval begins and the last ends."""
    if not len(scan):
        return np.zeros(4, np.uint8), np.zeros(2, np.int64)
    full = np.flatnonzero(scan[:-1] == 0xFF)
    after = scan[full + 1]
    marks = full[(after >= 0xD0) & (after <= 0xD7)]
    stop = full[(after != 0) & (after != 0xFF) & ((after < 0xD0) | (after > 0xD7))]
    end = int(stop[0]) if len(stop) else len(scan)
    keep = np.ones(len(scan), bool)
    keep[full[after == 0] + 1] = False
    keep[marks] = keep[marks + 1] = False
    keep[end:] = False
    kept = np.concatenate([[0], np.cumsum(keep)])
    begins = np.concatenate([[0], kept[marks[marks < end] + 2], [kept[end]]])
    return np.concatenate([scan[keep], np.full(4, 0xFF, np.uint8)]), begins


def decode_intervals(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, schedule: tuple) -> np.ndarray:
    """Quantised coefficients in zigzag order, (block, 64), of restart intervals of ``sizes`` units each."""
    per = len(schedule)
    tables = np.stack([lookup(t) for _, dc, ac in schedule for t in (dc, ac)])
    component = np.array([c for c, _, _ in schedule])
    n_blocks = sizes.astype(np.int64) * per
    first = np.concatenate([[0], np.cumsum(n_blocks)])
    out = np.zeros((int(first[-1]), 64), np.int16)
    stream = np.flatnonzero(n_blocks)
    bit, block, k = begins[stream].astype(np.int64) * 8, np.zeros(len(stream), np.int64), np.zeros(len(stream), np.int64)
    last = np.zeros((len(stream), component.max() + 1), np.int64)
    while len(stream):
        slot = block % per
        found = tables[2 * slot + (k > 0), _peek(data, bit)]
        if not found.all():
            raise ValueError("no Huffman code fits")
        bit += found >> 8
        symbol = found & 255
        size, run = symbol & 15, symbol >> 4
        raw = _peek(data, bit) >> (16 - size)
        bit += size
        value = np.where((size > 0) & (raw < (1 << np.maximum(size - 1, 0))), raw - (1 << size) + 1, raw)
        is_dc = k == 0
        over = ~is_dc & (size == 0) & (run < 15)
        at = np.where(is_dc, 0, k + run)
        if (at[~over] > 63).any():
            raise ValueError("too many coefficients in a block")
        if is_dc.any():
            rows = np.flatnonzero(is_dc)
            value[rows] += last[rows, component[slot[rows]]]
            last[rows, component[slot[rows]]] = value[rows]
        put = ~over & (is_dc | (size > 0))
        out[(first[stream] + block)[put], at[put]] = value[put]
        k = np.where(over, 64, at + 1)
        done = k > 63
        block += done
        k[done] = 0
        live = block < n_blocks[stream]
        if not live.all():
            stream, bit, block, k, last = stream[live], bit[live], block[live], k[live], last[live]
    return out


def decode(media: list[bytes]) -> Iterator[tuple[Picture, np.ndarray]]:
    """Each file's picture and its coefficients, (unit, block, 64), in zigzag order; files of one kind in step."""
    found = [parse(m) for m in media]
    todo = {}
    for i, p in enumerate(found):
        todo.setdefault(p.schedule(), []).append(i)
    results: list = [None] * len(media)
    for schedule, members in todo.items():
        data, begins, sizes, at = [], [], [], 0
        for i in members:
            p = found[i]
            part, starts = intervals(np.frombuffer(media[i], np.uint8)[p.data[0] : p.data[1]])
            total = int(np.prod(p.units()))
            each = p.restart or total
            n = -(-total // each)
            if len(starts) - 1 != n:
                raise ValueError("restart markers are missing")
            data.append(part)
            begins.append(starts[:-1] + at)
            size = np.full(n, each)
            size[-1] = total - each * (n - 1)
            sizes.append(size)
            at += len(part)
        data, begins, sizes = np.concatenate(data), np.concatenate(begins), np.concatenate(sizes)
        parts = [decode_intervals(data, begins[a : a + STEP], sizes[a : a + STEP], schedule) for a in range(0, len(begins), STEP)]
        blocks_of = np.concatenate(parts).reshape(-1, len(schedule), 64)
        a = 0
        for i in members:
            n = int(np.prod(found[i].units()))
            results[i] = blocks_of[a : a + n]
            a += n
    yield from zip(found, results)


def payload(picture: Picture, coefficients: np.ndarray) -> np.ndarray:
    """The bytes that ``encode`` has stored."""
    values = coefficients.reshape(-1)
    return np.where(values < 0, values + 255, values).astype(np.uint8)[: int(picture.comment.partition(b"=")[2])]


def thumbnail(picture: Picture, coefficients: np.ndarray) -> np.ndarray:
    """The mean luminance of each block, from DC coefficients alone; the picture's first component."""
    _, wide, high, table = picture.components[0]
    if len(picture.components) == 1:
        wide = high = 1
    dc = coefficients[:, : wide * high, 0].astype(np.int64) * int(picture.quantisers[table][0])
    across, down = picture.units()
    grid = dc.reshape(down, across, high, wide).transpose(0, 2, 1, 3).reshape(down * high, across * wide)
    grid = grid[: -(-picture.height // 8), : -(-picture.width // 8)]
    return np.clip((grid + 1028) // 8, 0, 255).astype(np.uint8)


def average_hash(thumb: np.ndarray) -> int:
    """64 bits: which cells of an 8x8 reduction are brighter than their mean."""
    rows, columns = (np.minimum(np.arange(9) * n // 8, n) for n in thumb.shape)
    total = np.pad(thumb.astype(np.int64), ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    r1, c1 = np.maximum(rows[1:], rows[:-1] + 1), np.maximum(columns[1:], columns[:-1] + 1)
    area = (r1 - rows[:-1])[:, None] * (c1 - columns[:-1])
    cells = total[np.ix_(r1, c1)] - total[np.ix_(rows[:-1], c1)] - total[np.ix_(r1, columns[:-1])] + total[np.ix_(rows[:-1], columns[:-1])]
    mean = cells / area
    return int.from_bytes(np.packbits(mean > mean.mean()).tobytes(), "big")


def media_columns(docs: DataFrame) -> DataFrame:
    """Store each text in a JPEG, read the file back, and describe it by its dimensions and thumbnail hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches, most=1 << 20):
            media, lengths = [], np.diff(offsets)
            for a, n in zip(offsets[:-1], lengths):
                padded = np.full(max(UNIT, -(-n // UNIT) * UNIT), 32, np.uint8)
                padded[:n] = data[a : a + n]
                media.append(encode(padded))
            out = []
            for doc, n, stored, (picture, coefficients) in zip(rows.column(0).to_pylist(), lengths.tolist(), media, decode(media)):
                back, thumb = payload(picture, coefficients).tobytes(), thumbnail(picture, coefficients)
                sha = hashlib.sha256(thumb.tobytes()).hexdigest()
                feature = f"{picture.width}x{picture.height}:{average_hash(thumb):016x}:{sha[:16]}"
                out.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, picture.width, picture.height, sha))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
