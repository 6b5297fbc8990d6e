"""Vectorised splitting and hashing of words in Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
#: Base of the polynomial word hash: any odd 64-bit number with mixed bits.
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse, modulo 2^64."""
    if len(_POWERS["up"]) < n:
        with np.errstate(over="ignore"):
            for key, base in (("up", _BASE), ("down", _INVERSE)):
                table = np.full(n, base, np.uint64)
                table[0] = 1
                _POWERS[key] = np.multiply.accumulate(table)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last one ends; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64, len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows with at most ``most`` bytes of text, or one longer row: (rows, bytes, offsets)."""
    for batch in batches:
        data, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as maximal runs without white space inside one text: (begin, end, text number)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:-1]
    begin = np.flatnonzero(begins)
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(offsets, begin, "right") - 1


def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each lower-cased word, the same wherever the word stands."""
    out = np.empty(len(begin), np.uint64)
    with np.errstate(over="ignore"):
        at = 0
        while at < len(begin):
            to = max(at + 1, int(np.searchsorted(end, begin[at] + BLOCK, "right")))
            first, last = int(begin[at]), int(end[to - 1])
            if last - first <= BLOCK:
                up, down = powers(BLOCK)
                total = np.zeros(last - first + 1, np.uint64)
                np.cumsum((_LOWER[data[first:last]].astype(np.uint64) + np.uint64(1)) * up[: last - first], out=total[1:])
                b, e = begin[at:to] - first, end[at:to] - first
                out[at:to] = (total[e] - total[b]) * down[b]
            else:  # one word longer than a block
                value, scale = 0, 1
                for part in range(first, last, BLOCK):
                    piece = _LOWER[data[part : min(part + BLOCK, last)]].astype(np.uint64) + np.uint64(1)
                    value += int((piece * powers(BLOCK)[0][: len(piece)]).sum(dtype=np.uint64)) * scale
                    scale = scale * pow(int(_BASE), BLOCK, 1 << 64) % (1 << 64)
                out[at] = value % (1 << 64)
            at = to
        return mix(out ^ ((end - begin).astype(np.uint64) << np.uint64(48)))


def sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``size`` words; of all its words if they are fewer."""
    begin, end, text = spans(data, offsets)
    word = hashes(data, begin, end)
    bounds = np.searchsorted(text, np.arange(len(offsets)))
    with np.errstate(over="ignore"):
        run = np.zeros(max(0, len(word) - size + 1), np.uint64)
        for k in range(size):
            run = run * _BASE + word[k : k + len(run)]
        run = mix(run)
        for i in range(len(offsets) - 1):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a >= size:
                yield np.unique(run[a : b - size + 1])
            elif b > a:
                value = np.uint64(b - a)
                for x in word[a:b]:
                    value = value * _BASE + x
                yield mix(np.array([value ^ np.uint64(1)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
