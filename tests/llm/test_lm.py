import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from linkweave.llm import lm

SF = "/root/testdata/sf0.001"


def words(text):
    lower = re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode())
    return [*re.findall(rb"[^\x20\x09-\x0D]+", lower), None]


class Plain:
    """The model by dictionaries, of order 2 or 3."""

    def __init__(self, texts, order=lm.ORDER):
        self.order, self.c, self.triples, self.pairs, self.second = order, Counter(), Counter(), Counter(), Counter()
        for t in texts:
            w = words(t)
            self.c.update(w)
            s = ["start", *w]
            if order == 2:
                self.pairs.update(zip(s, w))
            else:
                self.pairs[s[0], w[0]] += 1
                self.triples.update(zip(s, w, w[1:]))
        self.pairs.update((b, c) for _, b, c in self.triples)
        self.second.update(b for _, b in self.pairs)
        self.first, self.d, self.e = self.summed(self.pairs), self.cut(self.pairs), self.cut(self.second)
        self.context, self.f = self.summed(self.triples), self.cut(self.triples)
        self.total = max(len(self.pairs), 1)
        self.rest = sum(self.e[min(n, 3)] for n in self.second.values()) / self.total if self.pairs else 1.0

    def cut(self, counts):
        return (0, *lm.discounts([sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)]))

    def summed(self, grams):
        out = defaultdict(lambda: [0, 0, 0, 0])
        for g, n in grams.items():
            out[g[:-1]][0] += n
            out[g[:-1]][min(n, 3)] += 1
        return out

    def word(self, w):
        n = self.second[w]
        return max(n - self.e[min(n, 3)], 0) / self.total + self.rest / (len(self.c) + 1)

    def mixed(self, total, d, n, lower):
        return max(n - d[min(n, 3)], 0) / total[0] + sum(d[k] * total[k] for k in (1, 2, 3)) / total[0] * lower

    def chance(self, a, b, w):
        p = self.word(w)
        if (b,) in self.first:
            p = self.mixed(self.first[b,], self.d, self.pairs.get((b, w), 0), p)
        if (a, b) in self.context:
            p = self.mixed(self.context[a, b], self.f, self.triples.get((a, b, w), 0), p)
        return p

    def scores(self, text):
        w, n, v = words(text), sum(self.c.values()), len(self.c)
        base = sum(math.log10((self.c[x] + 1) / (n + v + 1)) for x in w)
        s = ["none", "start", *w]
        return len(w), sum(x in self.c for x in w), base, sum(math.log10(self.chance(*x)) for x in zip(s, s[1:], w))


def close(got, want):
    assert got[:2] == want[:2] and got[2:] == pytest.approx(want[2:], abs=1e-8)


def test_query_against_dictionaries(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    plain = Plain([t for d, t in docs.items() if not held[d]])
    rows = lm.query(spark, SF).collect()
    for r in rows:
        close((r["n_tokens"], r["n_known"], r["base_score"], r["score"]), plain.scores(docs[r["doc_id"]]))
        assert r["train_tokens"] == sum(plain.c.values()) and r["held_out"] == held[r["doc_id"]]
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_chances_sum_to_one():
    for order in (2, 3):
        plain = Plain(["a b c a b", "b c d", "a", None], order)
        for before in (("none", "start"), ("start", b"a"), (b"a", b"b"), (b"b", b"b"), (b"a", b"unseen")):
            assert sum(plain.chance(*before, w) for w in [*plain.c, b"never"]) == pytest.approx(1)


def test_odd_documents(spark, odd, odd_rows, none):
    plain = Plain([t for _, t in odd_rows])
    want = sorted(((d, plain.scores(t)) for d, t in odd_rows), key=repr)
    got = sorted(((r["doc_id"], tuple(r)[1:]) for r in lm.scored(odd, lm.fit(odd.select("text"))).collect()), key=repr)
    assert [d for d, _ in got] == [d for d, _ in want]
    for (_, a), (_, b) in zip(sorted(got, key=lambda x: (repr(x[0]), x[1])), sorted(want, key=lambda x: (repr(x[0]), x[1]))):
        close(a, b)
    model = lm.fit(none.select("text"))
    assert model.n_tokens == 0
    for r in lm.scored(odd, model).collect():
        assert r["n_known"] == 0 and r["base_score"] == 0 and r["score"] == 0
    assert lm.scored(none, model).count() == 0


def test_small_merges_and_hot_words(spark, monkeypatch):
    texts = ["the " * 50 + "end", "the cat the dog the end", "x the y"] * 20
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    new = ["the cat the end", "end the cat unseen the dog", "unseen", ""]
    asked = df.unionByName(spark.createDataFrame([(len(texts) + i, t) for i, t in enumerate(new)], df.schema))
    for order in (2, 3):
        model = lm.fit(df.select("text"), order)
        assert len(model.hot) >= 2
        plain = Plain(texts, order)
        for r in lm.scored(asked, model).collect():
            close(tuple(r)[1:], plain.scores((texts + new)[r["doc_id"]]))
    with pytest.raises(ValueError):
        lm.fit(df.select("text"), 4)


def test_tries():
    counts = np.array([1, 254, 255, 1 << 40, 2])
    small = lm.short(counts)
    assert small[0].dtype == np.uint8 and lm.counted(*small, np.array([3, 0, 2, 1, 4])).tolist() == [1 << 40, 1, 255, 254, 2]
    values = np.array([1, 5, 9, 2, 3, 7], np.uint32)
    asked = np.array([5, 9, 2, 7, 8, 1, 1], np.uint32)
    low, high = np.array([0, 0, 3, 3, 3, 3, 2]), np.array([3, 2, 6, 6, 6, 6, 2])
    assert lm.within(values, low, high, asked).tolist() == [1, -1, 3, 5, -1, -1, -1]


def test_marks_of_long_ranges(spark):
    """Ranges of more entries than lie between two marks, at every place of them, and words that the trie lacks."""
    rng = np.random.default_rng(3)
    head, then = np.repeat(np.arange(5, 9, dtype=np.uint64), (1, 300, 64, 129)), np.concatenate([np.sort(rng.choice(900, n, replace=False)) for n in (1, 300, 64, 129)])
    keys = lm.joined(head, then)
    first, bounds = lm.runs(head.astype(np.uint32))
    asked = lm.joined(*(x.ravel() for x in np.meshgrid(np.arange(4, 11), np.arange(901), indexing="ij")))
    place = {k: i for i, k in enumerate(keys.tolist())}
    assert lm.among(first, bounds, then.astype(np.uint32), keys[:: lm._STEP], asked).tolist() == [place.get(k, -1) for k in asked.tolist()]
    texts = [f"the w{i} x{i % 7}" for i in range(400)] + [f"a the w{i}" for i in range(0, 400, 3)]
    model, plain = lm.fit(spark.createDataFrame([(t,) for t in texts], "text string")), Plain(texts)
    new = [*texts, "the w401 x1", "a the w1 x0", "the the w0", "the a"]
    for r in lm.scored(spark.createDataFrame(list(enumerate(new)), "doc_id long, text string"), model).collect():
        close(tuple(r)[1:], plain.scores(new[r["doc_id"]]))


def test_discounts():
    assert lm.discounts([0, 0, 0, 0]) == (0.5, 0.5, 0.5)
    assert all(0 <= d <= i for i, d in zip((1, 2, 3), lm.discounts([10, 5, 3, 2])))
    keys, counts = lm.merge(np.array([3, 1, 3], np.uint64), np.array([1, 2, 4]))
    assert keys.tolist() == [1, 3] and counts.tolist() == [2, 5]
