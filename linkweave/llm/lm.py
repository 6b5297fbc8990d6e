"""An interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark and memory-mapped by the workers that score.

1. Words of the training texts are counted, in shards of the range of their 64-bit hashes. Each
   shard is a sorted array of hashes and an array of counts; a word's number is its place among all shards.
2. Triples of neighbours are counted in shards of the middle word: a shard has all triples that begin with its contexts (the
   first two words), and all that end with its pairs (the last two). So it writes its triples, and gets from them how many different
   words stand before a pair, which is the pair's count in the lower order. Frequent middle words are spread over shards
   of their own, by context, and their pairs' counts are summed in a second step, by pair. What no word
   stands before, a text's first word after the start sign, counts as often as it is seen; for order 2 all pairs do.
3. Each range of word numbers sums in how many different pairs a word comes second, and the counts of the pairs
   in which it comes first.
4. Scoring maps these arrays and looks up distinct keys, block by block.

Contexts and pairs are tries of sorted arrays: the words that all entries of a shard begin with, where the entries of each
begin, and the next words, four bytes each; counts have one byte, and those of 255 or more stand in a list of their own.
Every 64th entry stands once more, whole, in a short array that finds where to look in a long range.

Map tasks merge equal words, pairs and triples before they are shuffled, packed by shard in one cell. The arrays lie
in the shared folder; the driver only sees some numbers for each shard.

Defined results: null and empty texts are one end token; words that training lacks have the probability
of an unknown word; without training texts every token is unknown and its probability 1; the words
before a text's first is a start sign, which is no token; repeated texts score alike and count each; empty tables give
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrays import apply_arrow, map_arrow, map_large, mapped, packed, packed_sorted, parts, save, save_parts, unpacked, unpacked_sorted
from ._store import Scratch, shards
from ._words import blocks, hashes, mix, spans

#: Stored bytes of input for each shard, tokens that a map task merges at once.
PER_SHARD, MERGED = 4 << 20, 1 << 21
SCHEMA = "doc_id long, n_tokens long, n_known long, base_score double, score double"
#: Words of an n-gram: the query's; bytes of text that are scored at once, so that a visit of a shard looks up many keys.
ORDER, SCORED = 3, 4 << 20
#: Kinds of packed rows: words that come second, words that come first, counts of pairs to be summed, and how many n-grams were seen how often.
_SECOND, _FIRST, _PAIRS, _PAIR_TIMES, _TRIPLE_TIMES = range(5)
_LOW = np.uint64(0xFFFFFFFF)
#: Entries of a trie for each of its marks.
_STEP = 64
_END = mix(np.array([1], np.uint64))[0]


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text with an end token; where each text begins and the last ends."""
    begin, end, text = spans(data, offsets)
    n = len(offsets) - 1
    per = np.bincount(text, minlength=n)
    first = np.concatenate([[0], np.cumsum(per + 1)])
    out = np.empty(int(first[-1]), np.uint64)
    out[np.arange(len(begin)) + text] = hashes(data, begin, end)
    out[first[1:] - 1] = _END
    return out, first


def merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts summed."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first, dtype=np.int64)


def dealt(shard: np.ndarray) -> np.ndarray:
    """The order by shard in which entries of one shard stay as they are; 16 bits are sorted in linear time."""
    return np.argsort(shard.astype(np.uint16) if len(shard) and shard.max() < 1 << 16 else shard, kind="stable")


def by_shard(shard: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of one shard in an array ordered by shard."""
    edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, int)
    for a, b in zip(edges, np.append(edges[1:], len(shard))):
        yield int(shard[a]), slice(int(a), int(b))


def discounts(n: list[float]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many n-grams were seen once to four times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    out = []
    for i in (1, 2, 3):
        out.append(min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.0), float(i)) if n[i - 1] else 0.5)
    return tuple(out)


def short(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts in one byte each; places and values of those that do not fit."""
    large = np.flatnonzero(counts >= 255)
    return np.minimum(counts, 255).astype(np.uint8), large.astype(np.uint32), counts[large].astype(np.uint64)


def counted(small: np.ndarray, place: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The counts at ``at``, from the arrays of ``short``."""
    out = small[at].astype(np.int64)
    large = out == 255
    if large.any():
        out[large] = value[np.searchsorted(place, at[large])]
    return out


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values of an ascending array, and where the run of each begins and the last ends."""
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[edge], np.append(edge, len(keys))


def within(values: np.ndarray, low: np.ndarray, high: np.ndarray, asked: np.ndarray, marks: np.ndarray | None = None, keys: np.ndarray | None = None) -> np.ndarray:
    """Where each asked value stands in its own ascending range of ``values``; -1 if it does not.

    ``marks`` has the key of every ``_STEP``th entry, and ``keys`` those that are asked: they narrow the long ranges.
    """
    begin = low.astype(np.int64)
    size = high.astype(np.int64) - begin
    if marks is not None and len(wide := np.flatnonzero(size > _STEP)):
        mark = (np.searchsorted(marks, keys[wide], "right") - 1) * _STEP
        end = np.minimum(begin[wide] + size[wide], mark + _STEP)
        begin[wide] = np.maximum(begin[wide], mark)
        size[wide] = end - begin[wide]
    some = np.flatnonzero(size > 0)
    at, left, want = begin[some], size[some], asked[some]
    for _ in range(int(left.max(initial=1) - 1).bit_length()):  # to the last entry that is not larger
        half = left >> 1
        at += half * (values[at + half] <= want)
        left -= half
    out = np.full(len(low), -1, np.int64)
    same = values[at] == want
    out[some[same]] = at[same]
    return out


def among(first: np.ndarray, bounds: np.ndarray, then: np.ndarray, marks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where the second half of each key stands in the range of its first half; -1 if the trie lacks it."""
    out = np.full(len(keys), -1, np.int64)
    head, next_ = (keys >> np.uint64(32)).astype(np.uint32), (keys & _LOW).astype(np.uint32)
    at = np.minimum(np.searchsorted(first, head), len(first) - 1)
    known = np.flatnonzero(first[at] == head)
    out[known] = within(then, bounds[at[known]], bounds[at[known] + 1], next_[known], marks, keys[known])
    return out


def joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Two numbers in one 64-bit key."""
    return high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)


@dataclass
class Model:
    """Where the arrays lie, and the totals; small enough for a closure."""

    root: str
    order: int
    n_words: int  # distinct words of training, the end token too
    n_tokens: int
    starts: list[int]  # number of the first word of each shard, and of all words
    hot: list[int]  # frequent first words
    n_shards: int
    triple_discounts: tuple = (0.5, 0.5, 0.5)
    pair_discounts: tuple = (0.5, 0.5, 0.5)
    word_discounts: tuple = (0.5, 0.5, 0.5)
    n_pairs: int = 0
    word_rest: float = 1.0

    def shard_of_hash(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(self.n_shards) >> np.uint64(32)).astype(np.int64)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Numbers of sorted hashes; -1 for words that training lacks."""
        out = np.full(len(h), -1, np.int64)
        for s, part in by_shard(self.shard_of_hash(h)):
            known = mapped(f"{self.root}/words/{s}", "u8")
            if len(known):
                at = np.minimum(np.searchsorted(known, h[part]), len(known) - 1)
                out[part] = np.where(known[at] == h[part], at + self.starts[s], -1)
        return out

    def shard_of_key(self, keys: np.ndarray) -> np.ndarray:
        """Shard of pairs by their first word, or of contexts by their second; the word that decides stands in the high half of a key."""
        word = (keys >> np.uint64(32)).astype(np.int64)
        shard = word * self.n_shards // (self.n_words + 1)
        if self.hot:
            at = np.isin(word, np.array(self.hot, np.int64))
            shard[at] = self.n_shards + (mix(keys[at]) % np.uint64(self.n_shards)).astype(np.int64)
        return shard

    def values(self, name: str, dtype: str, numbers: np.ndarray, width: int = 1) -> np.ndarray:
        """Entries of an array by word number, for sorted numbers."""
        out = np.zeros((len(numbers), width) if width > 1 else len(numbers), dtype)
        for s, part in by_shard(np.searchsorted(self.starts, numbers, "right") - 1):
            if 0 <= s < self.n_shards:
                array = mapped(f"{self.root}/{name}/{s}", dtype)
                out[part] = (array.reshape(-1, width) if width > 1 else array)[numbers[part] - self.starts[s]]
        return out

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        shard = self.shard_of_key(keys)
        order = dealt(shard)
        for s, part in by_shard(shard[order]):
            if found := parts(f"{self.root}/pairs/{s}"):
                first, bounds, second, marks, *counts = found
                at = among(first, bounds, second, marks, keys[order[part]])
                out[order[part][at >= 0]] = counted(*counts, at[at >= 0])
        return out

    def triple_counts(self, contexts: np.ndarray, triple: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count of each triple, count of each context, the share that each context leaves to the lower order).

        A triple has its context's place in the high half and its third word in the low one; both arrays ascend, and each context has a triple.
        """
        seen, total, rest, place = np.zeros(len(triple), np.int64), np.zeros(len(contexts), np.int64), np.zeros(len(contexts)), np.full(len(contexts), -1, np.int64)
        d1, d2, d3 = self.triple_discounts
        shard, which = self.shard_of_key(contexts), (triple >> np.uint64(32)).astype(np.int64)
        order, order3 = dealt(shard), dealt(shard[which])
        for (s, part), (_, part3) in zip(by_shard(shard[order]), by_shard(shard[which[order3]])):
            found = parts(f"{self.root}/triples/{s}")
            if not found:
                continue
            middle, bounds, first, marks, begin, then, marks3, many_at, sums, ones, twos, *counts = found
            at = among(middle, bounds, first, marks, contexts[order[part]])
            place[order[part]] = at
            of, at = order[part][at >= 0], at[at >= 0]
            low = begin[at].astype(np.int64)
            n = begin[at + 1] - low
            one = n == 1
            own = counted(*counts, low[one])
            total[of[one]], rest[of[one]] = own, np.array([0.0, d1, d2, d3])[np.minimum(own, 3)]
            many = np.searchsorted(many_at, at[~one])
            n1, n2 = ones[many].astype(np.int64), twos[many].astype(np.int64)
            total[of[~one]], rest[of[~one]] = sums[many], n1 * d1 + n2 * d2 + (n[~one] - n1 - n2) * d3
            of = order3[part3]
            at = place[which[of]]
            of, at = of[at >= 0], at[at >= 0]
            third = triple[of] & _LOW
            at = within(then, begin[at], begin[at + 1], third.astype(np.uint32), marks3, joined(at, third))
            seen[of[at >= 0]] = counted(*counts, at[at >= 0])
        return seen, total, rest / np.maximum(total, 1)

    def word_chances(self, second: np.ndarray) -> np.ndarray:
        """Lower order: how many different words a word follows, discounted, and the rest for all words alike."""
        k = second.astype(np.float64)
        total = max(self.n_pairs, 1)
        return np.maximum(k - np.array([0.0, *self.word_discounts])[np.minimum(second, 3)], 0) / total + self.word_rest / (self.n_words + 1)

    def before(self, number: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Numbers of the words before, with the start sign before each text's first."""
        out = np.empty_like(number)
        out[1:] = number[:-1]
        out[first[:-1]] = self.n_words
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) of each text."""
        h, first = tokens(data, offsets)
        if not len(h):
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, float, float))
        word, place = np.unique(h, return_inverse=True)
        number = self.numbers(word)
        known = number >= 0
        count, second = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
        count[known] = self.values("counts", "i8", number[known])
        second[known] = self.values("second", "i8", number[known])
        chance = self.word_chances(second)
        context = np.zeros((len(word) + 1, 2))
        context[:-1][known] = self.values("first", "f8", number[known], 2)
        context[-1] = mapped(f"{self.root}/start", "f8") if self.n_tokens else 0
        own = number[place]
        before = self.before(own, first)
        seen, real = np.zeros(len(own), np.int64), (own >= 0) & (before >= 0)
        pair, pair_place = np.unique(joined(before[real], own[real]), return_inverse=True)
        seen[real] = self.pair_counts(pair)[pair_place]
        at = np.empty_like(place)
        at[1:] = place[:-1]
        at[first[:-1]] = len(word)
        total, rest = context[at, 0], context[at, 1]
        lower = chance[place]
        found = np.maximum(seen - np.array([0.0, *self.pair_discounts])[np.minimum(seen, 3)], 0)
        p = np.where(total > 0, found / np.maximum(total, 1) + rest * lower, lower)
        del h, at, seen, pair, pair_place, total, rest, lower, found
        if self.order > 2:
            earlier = np.empty_like(before)
            earlier[1:] = before[:-1]
            earlier[first[:-1]] = -1  # a first word has no context of two
            real = np.flatnonzero((before >= 0) & (earlier >= 0))
            contexts, which = np.unique(joined(before[real], earlier[real]), return_inverse=True)
            triple, triple_place = np.unique(joined(which, own[real] & int(_LOW)), return_inverse=True)  # unknown words are the largest number
            seen, total, rest = self.triple_counts(contexts, triple)
            seen, total, rest = seen[triple_place], total[which], rest[which]
            found = np.maximum(seen - np.array([0.0, *self.triple_discounts])[np.minimum(seen, 3)], 0)
            p[real] = np.where(total > 0, found / np.maximum(total, 1) + rest * p[real], p[real])
        base = np.log10((count + 1) / (self.n_tokens + self.n_words + 1))[place]
        return np.diff(first), np.add.reduceat(known[place].astype(np.int64), first[:-1]), np.add.reduceat(base, first[:-1]), np.add.reduceat(np.log10(p), first[:-1])


def _counted(train: DataFrame, keys_of: Callable, shard_of: Callable) -> DataFrame:
    """(shard, keys, counts) of merged keys, packed by map tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        map_large()
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            shard = shard_of(keys)
            order = dealt(shard)
            keys, counts = keys[order], counts[order]
            rows = [(s, packed_sorted(keys[part]), packed(counts[part], np.uint32)) for s, part in by_shard(shard[order])]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["shard", "keys", "counts"])

        for _, data, offsets in blocks(batches):
            keys = keys_of(data, offsets)
            held.append(keys)
            n += len(keys)
            if n >= MERGED:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return map_arrow(train.select("text"), run, "shard int, keys binary, counts binary")


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([unpacked_sorted(c.as_py()) for c in table.column("keys")])
    counts = np.concatenate([unpacked(c.as_py(), np.uint32) for c in table.column("counts")]).astype(np.int64)
    return merge(keys, counts)


def _grams(train: DataFrame, model: Model) -> DataFrame:
    """(kind, shard, keys, sizes, then, counts) merged and packed by map tasks: pairs in rows without sizes, else contexts with their next words."""
    schema = "kind int, shard int, keys binary, sizes binary, then binary, counts binary"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        map_large()
        pairs, contexts, thirds, n = [], [], [], 0

        def flush() -> pa.RecordBatch:
            rows = []
            keys, counts = np.unique(np.concatenate(pairs), return_counts=True)
            pairs.clear()
            shard = model.shard_of_key(keys)
            order = dealt(shard)
            for s, part in by_shard(shard[order]):
                rows.append((1, s, packed_sorted(keys[order[part]]), None, None, packed(counts[order[part]], np.uint32)))
            context, which = np.unique(np.concatenate(contexts), return_inverse=True)
            contexts.clear()
            triple, counts = np.unique(joined(which, np.concatenate(thirds)), return_counts=True)
            thirds.clear()
            which, then = triple >> np.uint64(32), (triple & _LOW).astype(np.uint32)
            shard = model.shard_of_key(context)[which]
            order = dealt(shard)
            which, then, counts = which[order], then[order], counts[order]
            for s, part in by_shard(shard[order]):
                at, begin = runs(which[part])
                rows.append((0, s, packed_sorted(context[at]), packed(np.diff(begin), np.uint32), packed(then[part].view(np.uint8).reshape(-1, 4).T), packed(counts[part], np.uint32)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        for _, data, offsets in blocks(batches):
            h, first = tokens(data, offsets)
            if not len(h):
                continue
            word, place = np.unique(h, return_inverse=True)
            own = model.numbers(word)[place]
            before = model.before(own, first)
            begins = np.zeros(len(own), bool)
            begins[first[:-1]] = True
            raw = begins if model.order > 2 else np.ones(len(own), bool)
            pairs.append(joined(before[raw], own[raw]))
            later = np.flatnonzero(~raw)
            contexts.append(joined(before[later], before[later - 1]))
            thirds.append(own[later].astype(np.uint32))
            n += len(own)
            if n >= MERGED:
                yield flush()
                n = 0
        if n:
            yield flush()

    return map_arrow(train.select("text"), run, schema)


def _times(kind: int, counts: np.ndarray) -> tuple:
    """A row of how many entries were seen once to four times, and of how many there are."""
    return 0, kind, packed(np.array([(counts == i).sum() for i in (1, 2, 3, 4)] + [len(counts)], np.int64)), b""


def fit(train: DataFrame, order: int = ORDER) -> Model:
    """Count the texts of ``train`` and write the model's arrays; ``order`` is 2 or 3."""
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = train.sparkSession
    scratch = Scratch(spark, "lm")
    root, n = scratch.root, shards(train, PER_SHARD)
    model = Model(root, order, 0, 0, [0] * (n + 1), [], n)

    def words(table: pa.Table) -> pa.Table:
        keys, counts = _merged(table)
        shard = table.column("shard")[0].as_py()
        save(f"{root}/words/{shard}", keys)
        save(f"{root}/counts/{shard}", counts)
        often = np.argsort(-counts, kind="stable")[:64]
        return pa.table({"shard": pa.array([shard], pa.int32()), "types": [len(keys)], "total": [int(counts.sum())], "often": [often.tolist()], "often_n": [counts[often].tolist()]})

    of_words = _counted(train, lambda d, o: tokens(d, o)[0], model.shard_of_hash)
    found = apply_arrow(of_words.groupBy("shard"), words, "shard int, types long, total long, often array<long>, often_n array<long>").collect()  # a row for each shard
    types = np.zeros(n, np.int64)
    for r in found:
        types[r["shard"]] = r["types"]
    model.starts = np.concatenate([[0], np.cumsum(types)]).tolist()
    model.n_words, model.n_tokens = int(types.sum()), sum(r["total"] for r in found)
    if model.n_words >= (1 << 32) - 1:
        raise ValueError("more distinct words than half a key can hold")
    if not model.n_tokens:
        return model
    model.hot = sorted(model.starts[r["shard"]] + w for r in found for w, c in zip(r["often"], r["often_n"]) if c * 4 * n > model.n_tokens)
    model.hot.append(model.n_words)  # the start sign

    schema = "shard int, kind int, keys binary, counts binary"

    def rows_of(rows: list[tuple]) -> pa.Table:
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["shard", "kind", "keys", "counts"])

    def pairs(shard: int, keys: np.ndarray, counts: np.ndarray) -> list[tuple]:
        """Write the pairs of a shard; rows for the ranges of their words."""
        word, bounds = runs((keys >> np.uint64(32)).astype(np.uint32))
        save_parts(f"{root}/pairs/{shard}", [word, bounds.astype(np.uint32), (keys & _LOW).astype(np.uint32), keys[::_STEP], *short(counts)])
        rows = [_times(_PAIR_TIMES, counts)]
        second = keys & _LOW
        second.sort()
        second, edges = runs(second)
        second, times = second.astype(np.int64), np.diff(edges)
        for s, part in by_shard(np.searchsorted(model.starts, second, "right") - 1):
            rows.append((s, _SECOND, packed_sorted(second[part]), packed(times[part], np.int64)))
        sums = np.stack([np.add.reduceat(x, bounds[:-1], dtype=np.int64) for x in (counts, counts == 1, counts == 2, counts > 2)], 1)
        for s, part in by_shard(np.searchsorted(model.starts, word.astype(np.int64), "right") - 1):
            rows.append((s, _FIRST, packed_sorted(word[part]), packed(sums[part], np.int64)))
        return rows

    def triples(shard: int, table: pa.Table) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        """Write the triples of a shard; (rows, keys of their last two words, how many words stand before each)."""
        cells = lambda *names: zip(*(table.column(x) for x in names))
        keys = np.concatenate([np.repeat(unpacked_sorted(k.as_py()), unpacked(size.as_py(), np.uint32)) for k, size in cells("keys", "sizes")])
        third = np.concatenate([np.ascontiguousarray(unpacked(c.as_py(), np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1) for (c,) in cells("then")])
        counts = np.concatenate([unpacked(c.as_py(), np.uint32) for (c,) in cells("counts")])
        context, which = np.unique(keys, return_inverse=True)
        triple = joined(which, third)
        del keys, third, which
        triple, counts = merge(triple, counts)
        which, begin = runs(triple >> np.uint64(32))
        middle, bounds = runs((context >> np.uint64(32)).astype(np.uint32))
        third = (triple & _LOW).astype(np.uint32)
        many = np.flatnonzero(np.diff(begin) > 1)  # what a context with one next word sums to is that word's count
        sums, ones, twos = (np.add.reduceat(x, begin[:-1], dtype=np.int64)[many] for x in (counts, counts == 1, counts == 2))
        save_parts(f"{root}/triples/{shard}", [
            middle, bounds.astype(np.uint32), (context & _LOW).astype(np.uint32), context[::_STEP], begin.astype(np.uint32), third, triple[::_STEP],
            many.astype(np.uint32), sums.astype(np.uint64), ones.astype(np.uint32), twos.astype(np.uint32), *short(counts),
        ])
        rows = [_times(_TRIPLE_TIMES, counts)]
        del triple, middle, bounds, many, sums, ones, twos, counts
        context &= ~_LOW
        keys = np.repeat(context, np.diff(begin))
        del context, begin
        keys |= third
        keys.sort()
        last, edges = runs(keys)
        return rows, last, np.diff(edges)

    def grams(table: pa.Table) -> pa.Table:
        map_large()
        kind, shard = (table.column(c)[0].as_py() for c in ("kind", "shard"))
        rows, (keys, counts) = [], (None, None) if kind == 0 else _merged(table)
        if kind == 0:
            rows, keys, counts = triples(shard, table)
        if shard < n:
            return rows_of(rows + pairs(shard, keys, counts))
        to = model.shard_of_key(keys)
        at = dealt(to)
        return rows_of(rows + [(s, _PAIRS, packed_sorted(keys[at[part]]), packed(counts[at[part]], np.uint32)) for s, part in by_shard(to[at])])

    def summed(table: pa.Table) -> pa.Table:
        return rows_of(pairs(table.column("shard")[0].as_py(), *_merged(table)))

    stats = scratch.table(apply_arrow(_grams(train, model).groupBy("kind", "shard"), grams, schema), "stats")
    stats = stats.unionByName(scratch.table(apply_arrow(stats.where(F.col("kind") == _PAIRS).groupBy("shard"), summed, schema), "summed"))
    sums = {_PAIR_TIMES: np.zeros(5, np.int64), _TRIPLE_TIMES: np.zeros(5, np.int64)}
    for r in stats.where(F.col("kind").isin(list(sums))).select("kind", "keys").collect():  # a row or two for each shard
        sums[r["kind"]] = sums[r["kind"]] + unpacked(r["keys"], np.int64)
    model.triple_discounts = discounts(sums[_TRIPLE_TIMES][:4].tolist())
    model.pair_discounts, model.n_pairs = discounts(sums[_PAIR_TIMES][:4].tolist()), int(sums[_PAIR_TIMES][4])

    def ranges(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        last = s >= n  # the start sign stands behind all words
        size, begin = (1, model.n_words) if last else (model.starts[s + 1] - model.starts[s], model.starts[s])
        second, sums = np.zeros(size, np.int64), np.zeros((size, 4), np.int64)
        for kind, keys, counts in zip(*(table.column(c).to_pylist() for c in ("kind", "keys", "counts"))):
            at = unpacked_sorted(keys).astype(np.int64) - begin
            if kind == _SECOND:
                second[at] += unpacked(counts, np.int64)
            else:
                sums[at] += unpacked(counts, np.int64).reshape(-1, 4)
        rest = sums[:, 1:] @ np.array(model.pair_discounts) / np.maximum(sums[:, 0], 1)
        first = np.stack([sums[:, 0].astype(float), rest], 1)
        if last:
            save(f"{root}/start", first)
        else:
            save(f"{root}/second/{s}", second)
            save(f"{root}/first/{s}", first)
        return pa.table({"times": [[int((second == i).sum()) for i in (1, 2, 3, 4)] + [int((second > 2).sum())]]})

    found = apply_arrow(stats.where(F.col("kind").isin(_SECOND, _FIRST)).groupBy("shard"), ranges, "times array<long>").collect()  # a row for each shard
    times = np.sum([r["times"] for r in found], axis=0)
    model.word_discounts = discounts(times[:4].tolist())
    model.word_rest = float(np.dot(model.word_discounts, [times[0], times[1], times[4]]) / max(model.n_pairs, 1))
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        map_large()
        for rows, data, offsets in blocks(batches, most=SCORED):
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(x) for x in model.scores(data, offsets))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo 7, is 2."""
    return F.crc32(F.col(doc_id).cast("string")) % 7 == 2


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs.where(~held_out()).select(F.col("text").cast("string")))
    found = scored(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
