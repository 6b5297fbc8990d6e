"""Removal of long strings that an earlier document holds, by suffix order in independent shards.

Every string of ``length`` bytes has one anchor: the 16 bytes in it with the least hash. Equal strings
have equal anchors, so all strings of one anchor can be compared in one shard, and strings whose anchor
stands in a single document need no comparison at all.

1. Map tasks find the anchors and, for each, the segment that its strings cover. Anchors are
   packed by shard; anchors that one task meets in several documents are sent only once.
2. Shards answer which anchors stand in several documents; segments of those alone are cut from the texts,
   equal segments of a task once.
3. A shard sorts the suffixes of the segments of anchors with several different segments and takes the
   Burrows-Wheeler transform. Threshold-bounded interval expansion extends intervals backwards, breadth
   first: the round for strings of t bytes yields the places whose common prefix has t - 1 bytes, and
   the rounds end at ``length``. Places that are left join suffixes with ``length`` equal bytes; the
   least doc_id of each such run of suffixes tells which strings an earlier document holds.
4. Each document gathers its covered stretches and drops them.

Defined results: null and empty texts have nothing to remove; a string that only repeats inside its document
stays; rows with a null doc_id keep their text and serve as no source; rows of one doc_id are copies of one document, none earlier
than the other; texts of any length are read in stretches; empty tables give no rows; other columns
of other names are kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import apply_arrow, map_arrow, packed, packed_sorted, packed_wide, unpacked, unpacked_sorted, unpacked_wide
from ._store import shards
from ._words import mix, utf8

LENGTH, GRAM = 50, 16
#: Stored bytes of input for each shard; window starts read at once; anchors and segment bytes a task packs at once.
PER_SHARD, STEP, PACKED, CUT = 4 << 20, 1 << 19, 1 << 19, 16 << 20
#: Bytes whose suffixes are sorted at once, in whole anchors.
SORTED = 1 << 19
REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: Bits for a place in a stretch; the other bits of a hash choose the anchor.
PLACE = 21
_C1, _C2 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9FB21C651E98DF25)


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from each place."""
    n = len(data) - GRAM + 1
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.empty(n + 8, np.uint64)
    for r in range(8):
        part = padded[r : r + (n + 7 - r) // 8 * 8 + 8].view(np.uint64)
        eight[r::8] = part[: len(eight[r::8])]
    with np.errstate(over="ignore"):
        h = eight[:n] * _C1 + eight[8:] * _C2
        h ^= h >> np.uint64(32)
        h *= _C1
        h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(hash, text number, segment's begin in the bytes, segment's length), for all texts with ``length`` bytes or more."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none
    h = grams(data)
    bits = np.uint64(PLACE)
    least = h >> bits << bits | np.arange(len(h), dtype=np.uint64)
    wide, width = length - GRAM + 1, 1
    while width * 2 <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if wide > width:
        least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # for each window, where its anchor is
    inside = np.ones(len(at), bool)
    for cut in offsets[1:-1]:
        inside[max(0, int(cut) - length + 1) : int(cut)] = False
    change = np.ones(len(at), bool)
    change[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])
    begin = np.flatnonzero(change)
    end = np.append(begin[1:], len(at))
    keep = inside[begin]
    begin, end = begin[keep], end[keep]
    # The least hashes are small numbers: mixed again, they spread over the shards.
    return mix(h[at[begin]]), np.searchsorted(offsets, begin, "right") - 1, begin, end - begin + length - 1


def stretches(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """Like ``blocks``, with long texts in overlapping parts: (rows, bytes, offsets, where in its text the only row's part begins)."""
    for batch in batches:
        data, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STEP, "right")) - 1)
            a, b = int(offsets[i]), int(offsets[j])
            if b - a <= STEP:
                yield batch.slice(i, j - i), data[a:b], offsets[i : j + 1] - a, 0
            else:
                for at in range(a, max(a + 1, b - length + 1), STEP):
                    part = data[at : min(b, at + STEP + length - 1)]
                    yield batch.slice(i, 1), part, np.array([0, len(part)]), at - a
            i = j


def _groups(*columns: np.ndarray) -> np.ndarray:
    """Where each run of equal rows begins."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _asked(docs: DataFrame, n: int, length: int, unique: bool) -> DataFrame:
    """Anchors packed by shard. known 0: in one document of the task; 1: in several, to be passed on; 2: a sign that it is in several."""
    schema = "shard int, known int, hashes binary, keys binary, docs binary, places binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush() -> pa.RecordBatch:
            h, key, doc, begin, size = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((doc, h))
            h, key, doc, begin, size = h[order], key[order], doc[order], begin[order], size[order]
            first = _groups(h)
            many = np.add.reduceat(np.concatenate([[0], (h[1:] == h[:-1]) & (doc[1:] != doc[:-1])]).astype(np.int64), first) > 0
            several = np.repeat(many, np.diff(np.append(first, len(h))))
            shard = ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
            rows = []

            def add(known: int, at: np.ndarray) -> None:
                for a, b in zip(e := _groups(shard[at]) if len(at) else [], [*e[1:], len(at)] if len(at) else []):
                    x = at[a:b]
                    extra = (packed_wide(key[x]), b"" if unique else packed_wide(doc[x]), packed_wide(begin[x] << 8 | size[x])) if known < 2 else (b"",) * 3
                    rows.append((int(shard[x[0]]), known, packed_sorted(h[x]), *extra))

            add(0, np.flatnonzero(~several))
            add(1, np.flatnonzero(several))
            add(2, first[many])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), *[pa.binary()] * 4))], [x.split()[0] for x in schema.split(", ")])

        for rows, data, offsets, at in stretches(batches, length):
            h, text, begin, size = anchors(data, offsets, length)
            held.append((h, rows.column("key").to_numpy()[text], rows.column("doc_id").to_numpy()[text], begin - offsets[text] + at, size))
            count += len(h)
            if count >= PACKED:
                yield flush()
                held, count = [], 0
        if count:
            yield flush()

    return map_arrow(docs, run, schema)


def _ids(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(keys, docs); where doc_id is unique it is the key."""
    keys = unpacked_wide(row["keys"])
    return keys, unpacked_wide(row["docs"]) if row["docs"] else keys


def _several(table: pa.Table) -> pa.Table:
    """Rows (key, place) of the anchors that stand in several documents; a place is a begin and a length."""
    parts, signs = [], []
    for row in table.to_pylist():
        h = unpacked_sorted(row["hashes"])
        if row["known"] == 2:
            signs.append(h)
        else:
            parts.append((h, *_ids(row), unpacked_wide(row["places"]), np.full(len(h), row["known"], np.int8)))
    h, key, doc, place, known = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((doc, h))
    first = _groups(h[order])
    hs, ds, ks = h[order], doc[order], known[order]
    many = np.add.reduceat(np.concatenate([[0], (hs[1:] == hs[:-1]) & (ds[1:] != ds[:-1])]).astype(np.int64), first) > 0
    many |= np.maximum.reduceat(ks, first) > 0
    if signs:
        many |= np.isin(hs[first], np.concatenate(signs))
    keep = order[np.repeat(many, np.diff(np.append(first, len(h))))]
    return pa.table({"key": key[keep], "place": place[keep]})


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ..., begin[1], ..."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def _content(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        weight = np.multiply.accumulate(np.full(int(size.max()) + 1, _C2, np.uint64))
        first = np.cumsum(size) - size
        at = _ragged(begin, size)
        return mix(np.add.reduceat((data[at].astype(np.uint64) + np.uint64(1)) * weight[_ragged(np.zeros_like(begin), size)], first) + size.astype(np.uint64))


def alike(body: np.ndarray, place: np.ndarray, size: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each stretch has the bytes of the stretch whose number ``other`` gives."""
    out = size == size[other]
    asked = np.flatnonzero(out & (other != np.arange(len(other))))
    for part in _slices(np.concatenate([[0], np.cumsum(size[asked])]), 1 << 19):
        x = asked[part]
        same = body[_ragged(place[x], size[x])] == body[_ragged(place[other[x]], size[x])]
        out[x] = np.logical_and.reduceat(same, np.cumsum(size[x]) - size[x])
    return out


def distinct(content: np.ndarray, body: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one stretch of each different content, which of these each stretch is): by hash, confirmed by bytes.

    Stretches with the hash of another content, nearly none, are each a content of their own.
    """
    _, one, same = np.unique(content, return_index=True, return_inverse=True)
    odd = np.flatnonzero(~alike(body, place, size, one[same]))
    same[odd] = len(one) + np.arange(len(odd))
    return np.concatenate([one, odd]), same


def anchor_of(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The hash of each segment's anchor: the least of all its 16 bytes in a row."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    inside = size - GRAM + 1
    return mix(np.minimum.reduceat(grams(data)[_ragged(begin, inside)], np.cumsum(inside) - inside))


def _cut(docs: DataFrame, n: int, unique: bool) -> DataFrame:
    """Segments packed by shard: different ones once, and all their occurrences."""
    schema = "shard int, lengths binary, counts binary, bytes binary, keys binary, docs binary, begins binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush() -> pa.RecordBatch:
            content, h, size, key, doc, begin = (np.concatenate([x[i] for x in held]) for i in range(6))
            body = np.concatenate([x[6] for x in held])
            where = np.cumsum(size) - size
            shard = ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
            same = distinct(content, body, where, size)[1]
            order = np.lexsort((same, shard))
            edges = _groups(shard[order])
            rows = []
            for a, b in zip(edges, np.append(edges[1:], len(order))):
                x = order[a:b]
                first = _groups(same[x])
                u, counts = x[first], np.diff(np.append(first, len(x)))
                body_ = packed(body[_ragged(where[u], size[u])], level=3)
                rows.append((int(shard[x[0]]), packed(size[u], np.uint8), packed(counts, np.int32), body_, packed_wide(key[x]), b"" if unique else packed_wide(doc[x]), packed_wide(begin[x])))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 6))], [x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            lists = batch.column("found")
            places, per = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            begin, size = places >> 8, places & 255
            text = np.repeat(np.arange(batch.num_rows), per)
            key, doc = batch.column("key").to_numpy()[text], batch.column("doc_id").cast(pa.int64()).to_numpy()[text]
            at = np.append(np.arange(0, len(places), 1 << 14), len(places))
            for a, b in zip(at, at[1:]):
                x = slice(a, b)
                body = data[_ragged(offsets[text[x]] + begin[x], size[x])]
                where = np.cumsum(size[x]) - size[x]
                held.append((_content(body, where, size[x]), anchor_of(body, where, size[x]), size[x], key[x], doc[x], begin[x], body))
                count += int(size[x].sum())
                if count >= CUT:
                    yield flush()
                    held, count = [], 0
        if count:
            yield flush()

    return map_arrow(docs, run, schema)


def suffix_order(text: np.ndarray, length: int = 64) -> np.ndarray:
    """Rotations of ``text`` in the order of their first 64 bytes; of their first 128 where ``length`` is larger than 64."""
    n = len(text)
    around = np.concatenate([text, np.resize(text, 8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | around[k : k + n].astype(np.uint64)
    last = 64 if length <= 64 else 128
    for reach in (8, 16, 32, 64, 128):
        order = np.argsort(key)
        if reach == last:
            return order
        ranked = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[False], ranked[1:] != ranked[:-1]])).astype(np.uint64)
        key = rank << np.uint64(32) | np.roll(rank, -(reach % n if n else 0))


def expand_intervals(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix shares fewer than ``length`` bytes with the one before it in ``order``.

    Breadth-first backward extension on the Burrows-Wheeler transform: from the interval of a string,
    the interval of each string that is one byte longer at its front. The end of an interval that is found in round t
    first there has a common prefix of t - 1 bytes with what follows.
    """
    n = len(text)
    bwt = text[order - 1]
    by_byte = np.argsort(bwt, kind="stable")  # place in the transform of each row of the first column
    last_to_first = np.empty(n, np.int64)
    last_to_first[by_byte] = np.arange(n)
    same = np.flatnonzero(bwt[by_byte][1:] == bwt[by_byte][:-1])
    after, before = np.full(n, n, np.int64), np.full(n, -1, np.int64)  # next and last place of the same byte
    after[by_byte[same]] = by_byte[same + 1]
    before[by_byte[same + 1]] = by_byte[same]
    short = np.zeros(n + 1, bool)
    short[0] = True
    low, high = np.array([0]), np.array([n - 1])
    for _ in range(length):
        size = high - low + 1
        lows, highs = [], []
        edges = np.concatenate([[0], np.cumsum(size)])
        for a in _slices(edges, 1 << 19):
            x = _ragged(low[a], size[a])
            l, r = np.repeat(low[a], size[a]), np.repeat(high[a], size[a])
            lows.append(last_to_first[x[before[x] < l]])
            highs.append(last_to_first[x[after[x] > r]])
        f, g = np.sort(np.concatenate(lows)), np.sort(np.concatenate(highs))
        new = ~short[g + 1]
        short[g[new] + 1] = True
        low, high = f[new], g[new]
        if not len(low):
            break
    return short[:n]


def _slices(edges: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of intervals with about ``most`` places."""
    at, n = 0, len(edges) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + most, "right")) - 1)
        yield slice(at, to)
        at = to


def earliest(body: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` bytes of each segment, the least doc of all segments that hold its bytes."""
    n = len(begin)
    where = np.cumsum(size + 1) - size - 1
    text = np.full(int(size.sum()) + n, 0xFF, np.uint8)  # a byte that UTF-8 never has parts the segments
    text[_ragged(where, size)] = body[_ragged(begin, size)]
    order = suffix_order(text, length)
    first = np.flatnonzero(expand_intervals(text, order, length))
    owner = np.repeat(np.arange(n), size + 1)
    least = np.empty(len(text), doc.dtype)
    least[order] = np.repeat(np.minimum.reduceat(doc[owner[order]], first), np.diff(np.append(first, len(order))))
    return least[_ragged(where, size - length + 1)]


def covered(table: pa.Table, length: int = LENGTH) -> pa.Table:
    """Rows (key, place): stretches of the texts that strings of an earlier document cover; a place is a begin and a length."""
    rows, parts = table.to_pylist(), []
    for r in rows:
        size, body = unpacked(r["lengths"], np.uint8).astype(np.int64), unpacked(r["bytes"], np.uint8)
        where = np.cumsum(size) - size
        parts.append((_content(body, where, size), anchor_of(body, where, size), size, body, unpacked(r["counts"], np.int32)))
    content, h, size, body, counts = (np.concatenate(c) for c in zip(*parts))
    which = np.repeat(np.arange(len(counts)), counts)
    key, doc = (np.concatenate(c) for c in zip(*map(_ids, rows)))
    start = np.concatenate([unpacked_wide(r["begins"]) for r in rows])
    place = np.cumsum(size) - size
    one, same = distinct(content, body, place, size)  # equal segments of different tasks
    which, h, size, place = same[which], h[one], size[one], place[one]
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, which, doc)
    windows = size - length + 1
    at = np.cumsum(windows) - windows
    source = np.repeat(least, windows)  # for each window of each segment
    order = np.argsort(h, kind="stable")
    first = _groups(h[order])
    per = np.diff(np.append(first, len(order)))
    several = order[np.repeat(per > 1, per)]
    bounds = _groups(h[several]) if len(several) else np.zeros(0, int)
    weight = np.add.reduceat(size[several] + 1, bounds) if len(bounds) else np.zeros(0, int)
    for part in _slices(np.concatenate([[0], np.cumsum(weight)]), SORTED):
        x = several[bounds[part.start] : (bounds[part.stop] if part.stop < len(bounds) else len(several))]
        source[_ragged(at[x], windows[x])] = earliest(body, place[x], size[x], least[x], length)
    out = ([], [])
    for part in _slices(np.concatenate([[0], np.cumsum(windows[which])]), 1 << 19):
        w = windows[which[part]]
        hit = source[_ragged(at[which[part]], w)] < np.repeat(doc[part], w)
        owner = np.repeat(np.arange(len(w)), w)
        edge = np.concatenate([[True], (hit[1:] != hit[:-1]) | (owner[1:] != owner[:-1])])
        a = np.flatnonzero(edge)
        b = np.append(a[1:], len(hit))
        keep = hit[a]
        a, b = a[keep], b[keep]
        o = owner[a]
        shift = start[part][o] - (np.cumsum(w) - w)[o]
        for c, x in zip(out, (key[part][o], a + shift << 8 | b - 1 + length - a)):
            c.append(x)
    return pa.table({n: np.concatenate(c) for n, c in zip(("key", "place"), out)})


def repeats(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(docs with a key for equal rows, stretches to remove by key)."""
    if not GRAM <= length <= 128:
        raise ValueError("length must be from 16 to 128 bytes")
    n = shards(docs, PER_SHARD)
    counted = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows"))
    unique = counted.where("rows > 1").isEmpty()
    # Rows that share a doc_id are told apart by their texts; else the doc_id is the smaller key. A key is never null.
    text_key = F.xxhash64("doc_id", "text")
    keyed = docs.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), text_key) if unique else text_key)
    sound = keyed.where(f"doc_id IS NOT NULL AND octet_length(text) >= {length}").select("key", F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = apply_arrow(_asked(sound, n, length, unique).groupBy("shard"), _several, "key long, place long")
    lists = shared.groupBy("key").agg(F.collect_set("place").alias("found"))
    # All columns go on: this join and the last one then share one shuffle of the texts.
    segments = _cut(keyed.join(lists, "key"), n, unique)
    covers = apply_arrow(segments.groupBy("shard"), lambda t: covered(t, length), "key long, place long")
    return keyed, covers.groupBy("key").agg(F.collect_set("place").alias("cuts"))


def _kept(size: int, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, int]:
    """(begins and ends of what stays, number of runs removed)."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    a, b = begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
    return np.stack([np.append(0, b), np.append(a, size)], 1), len(a)


def _kept_rows(batch: pa.RecordBatch) -> Iterator[tuple[bytes, int, int]]:
    """(bytes that stay, bytes in all, runs removed) of each row with its text and cuts."""
    data, offsets = utf8(batch.column("text"))
    raw, cuts = data.tobytes(), batch.column("cuts")
    for i in range(batch.num_rows):
        text = raw[offsets[i] : offsets[i + 1]]
        if cuts[i].is_valid and len(cuts[i].values):
            place = cuts[i].values.to_numpy()
            stay, n = _kept(len(text), place >> 8, (place >> 8) + (place & 255))
            yield b"".join([text[a:b] for a, b in stay.tolist()]), len(text), n
        else:
            yield text, len(text), 0


def removal(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """What is removed from each document, and the digest of what stays."""
    keyed, cuts = repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(n, n - len(kept), runs, hashlib.sha256(kept).hexdigest()) for kept, n, runs in _kept_rows(batch)]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], [x.split()[0] for x in REMOVED.split(", ")])

    return map_arrow(keyed.join(cuts, "key", "left").select("doc_id", "text", "cuts"), run, REMOVED)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of ``docs``, all columns, with repeated bytes out of their texts; a character that loses a byte goes as a whole."""
    names, schema = docs.columns, docs.schema
    inner = {c: f"column_{i}" for i, c in enumerate(names) if c not in ("doc_id", "text")}  # no clash with our own names
    keyed, cuts = repeats(docs.withColumnsRenamed(inner), length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid = batch.column("text").is_valid().to_pylist()
            texts = [kept.decode("utf-8", "ignore") if v else None for v, (kept, _, _) in zip(valid, _kept_rows(batch))]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(inner.get(c, c)) for c in names], names)

    return map_arrow(keyed.join(cuts, "key", "left").select(*(inner.get(c, c) for c in names), "cuts"), run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return removal(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
