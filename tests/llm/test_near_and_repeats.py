import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkweave.llm import jaccard, packing, pii, quality, repeats
from linkweave.llm._store import Scratch

SF = "/root/testdata/sf0.001"


def shingles(text, size):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def plain_components(rows, size, percent):
    """(doc_id, set size, component) of each row by comparing all pairs that share a shingle."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    at = defaultdict(list)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in at[x]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
        for x in s:
            at[x].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(s), least.get(root(i), d) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def near_copies(seed, n):
    """Groups of documents with a growing share of changed words, and passages that many documents hold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(40)]
    rows, i = [], 0
    while len(rows) < n:
        base = [word() for _ in range(rng.choice([6, 30, 120, 300]))]
        if rng.random() < 0.4:
            base = passage + base
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((i * 7 % 100_003, " ".join(copy)))
            i += 1
    return rows


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80)])
def test_components(spark, size, percent):
    rows = near_copies(size, 500)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jaccard.linked(df, size, percent).collect())) == sorted(plain_components(rows, size, percent))


def test_unfinished_components_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r["component"] for r in jaccard.components(Scratch(spark, "test"), chain, "whole").collect()} == {0}
    with pytest.raises(RuntimeError):
        jaccard.components(Scratch(spark, "test"), chain, "few", turns=3)


def plain_links(rows, size, percent):
    """With how many other rows each row is linked, by comparing all pairs."""
    sets = [shingles(t, size) for _, t in rows]
    fits = lambda a, b: a and b and 100 * len(a & b) >= percent * len(a | b)
    return [sum(1 for j, b in enumerate(sets) if j != i and fits(a, b)) for i, a in enumerate(sets)]


@pytest.mark.parametrize("block, tokens", [(jaccard.BLOCK, jaccard.TOKENS), (5, 1 << 19), (1024, 400)])
def test_links_of_documents(spark, monkeypatch, block, tokens):
    """Groups as units of their own, and in blocks by number or by tokens."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "TOKENS", tokens)
    rng = random.Random(8)
    base = [str(i) for i in range(100)]
    group = [(1000 + i, " ".join(base[: rng.randint(80, 100)] if i % 2 else base[:i] + ["x"] + base[i + 1 :])) for i in range(40)]
    rows = near_copies(3, 150) + group + [(2000, group[0][1]), (2001, None), (2002, ""), (2003, None)]
    want = [(*c, n) for c, n in zip(plain_components(rows, 4, 85), plain_links(rows, 4, 85))]
    assert max(w[3] for w in want) > 20 and len({w[3] for w in want}) > 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jaccard.counted(df, 4, 85).collect())) == sorted(want)


def test_near_copy_without_id(spark):
    """A row with a null doc_id between two documents that only it links, alone and in a group."""
    base = [f"w{i}" for i in range(120)]
    changed = lambda *at: " ".join("other" if i in at else w for i, w in enumerate(base))
    rows = [(5, changed(20)), (None, changed(20, 60)), (9, changed(20, 60, 100)), (11, "something else stands here"), (None, "and nothing is like this one")]
    rows += [(20 + i, " ".join(f"v{j}" if j != i else "x" for j in range(150))) for i in range(12)] + [(None, " ".join(f"v{j}" if j != 70 else "x" for j in range(150)))]
    size, percent = 4, 93
    want = [(*c, n) for c, n in zip(plain_components(rows, size, percent), plain_links(rows, size, percent))]
    assert [w[2:] for w in want[:3]] == [(5, 1), (5, 2), (5, 1)] and want[-1][2] == 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted(map(tuple, jaccard.counted(df, size, percent).collect()), key=repr) == sorted(want, key=repr)


def test_rows_that_share_a_doc_id(spark):
    """A near copy goes and a clean text of the same doc_id stays; of near copies under one doc_id one stays."""
    text = lambda name, *at: " ".join("other" if i in at else f"{name}{i}" for i in range(100))
    rows = [(1, text("a")), (2, text("a", 50)), (2, text("b")), (3, text("c")), (3, text("c", 40)), (4, text("b", 9)), (5, ""), (5, " "), (5, text("d")), (5, text("d")), (None, text("a"))]
    kept = sorted(map(tuple, jaccard.representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 85).collect()), key=repr)
    one = [r for r in kept if r[0] == 3]
    assert len(one) == 1 and one[0] in rows
    assert [r for r in kept if r[0] != 3] == sorted([rows[0], rows[2], rows[6], rows[7], rows[8], rows[10]], key=repr)


def test_overlaps_of_lists(monkeypatch):
    monkeypatch.setattr(jaccard, "COLUMNS", 7)
    rng = np.random.default_rng(4)
    left, right = ([np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(n)] for n in (13, 9))
    left.append(np.array([1 << 60], np.uint64))
    plain = lambda x, y: [[len(np.intersect1d(a, b)) for b in y] for a in x]
    assert jaccard.overlaps(left, right).tolist() == plain(left, right)
    own = jaccard.overlaps(left)
    np.fill_diagonal(own, 0)
    want = np.array(plain(left, left))
    np.fill_diagonal(want, 0)
    assert own.tolist() == want.tolist()


def test_odd_documents_near(odd, odd_rows, none):
    got = sorted(map(tuple, jaccard.linked(odd, 4, 85).collect()), key=repr)
    assert got == sorted(plain_components(odd_rows, 4, 85), key=repr)
    kept = jaccard.representatives(odd, 4, 85)
    assert kept.columns == odd.columns
    want = {d for d, _, c in plain_components(odd_rows, 4, 85) if d == c}
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([*want - {None}, None, None], key=repr)
    assert jaccard.linked(none, 4, 85).count() == 0


def test_bitmaps_bound_overlaps():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 1 << 63, rng.integers(1, 300)).astype(np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([b, rng.choice(a, rng.integers(0, len(a) + 1), replace=False)]))
        assert jaccard.most_shared(len(a), jaccard.bitmap(a), jaccard.bitmap(b)) >= jaccard._overlap(a, b) == len(np.intersect1d(a, b))


def test_prefixes_meet():
    rng = np.random.default_rng(2)
    levels = rng.integers(0, 4, 64).astype(np.uint8)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 62, 60).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 1 << 62, rng.integers(0, 5)).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            assert len(np.intersect1d(jaccard.prefix(a, levels, 85), jaccard.prefix(b, levels, 85)))


def test_chains_become_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (5, 5)]
    found = jaccard.components(Scratch(spark, "chain"), spark.createDataFrame(links, "a long, b long"), "chain")
    assert sorted(map(tuple, found.collect())) == [(i, 0) for i in range(61)] + [(i, 100) for i in (100, 101, 102)]


# --- repeats ----------------------------------------------------------------------------------------


def plain_removal(rows, length=50):
    first = {}
    for d, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1) if d is not None else ():
            s = raw[p : p + length]
            first[s] = min(d, first.get(s, d))
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        hit = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - length + 1) if d is not None else ():
            if first[raw[p : p + length]] < d:
                hit[p : p + length] = True
        out.append((d, len(raw), int(hit.sum()), int((hit[:-1] & ~hit[1:]).sum()), hashlib.sha256(bytes(b for b, h in zip(raw, hit) if not h)).hexdigest()))
    return sorted(out, key=repr)


def shuffled_pieces(seed):
    rng = random.Random(seed)
    letters = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    base = [letters(400, "abcdefgh") for _ in range(6)]
    rows = []
    for i in range(200):
        text = ""
        for _ in range(rng.randint(0, 4)):
            b, a = rng.choice(base), rng.randint(0, 330)
            text += b[a : a + rng.randint(30, 120)] + letters(rng.randint(0, 40), "abcdefghijklmnopq")
        rows.append((i * 3 % 211, text))
    return rows + [(400, "a" * 5000), (401, "a" * 300), (402, "ab" * 900), (404, "é漢🙂" * 60), (405, "x" + "é漢🙂" * 60)]


def test_removal(spark):
    rows = shuffled_pieces(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, repeats.removal(df).collect()), key=repr) == plain_removal(rows)


def test_small_stretches_and_flushes(spark, monkeypatch):
    rows = shuffled_pieces(6)[-60:]
    pages = [repeats.anchors(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for _, t in rows]
    monkeypatch.setattr(repeats, "STEP", 97)
    import pyarrow as pa

    batch = pa.record_batch({"text": [t for _, t in rows], "row": list(range(len(rows)))})
    windows = defaultdict(dict)
    for part, data, offsets, at in repeats.stretches(iter([batch]), 50):
        for h, text, begin, size in zip(*repeats.anchors(data, offsets)):
            row = part.column("row")[int(text)].as_py()
            for p in range(begin - offsets[text] + at, begin - offsets[text] + at + size - 49):
                windows[row][p] = h
    for row, (h, _, begin, size) in enumerate(pages):
        assert windows[row] == {p: x for x, b, n in zip(h, begin, size) for p in range(b, b + n - 49)}


@pytest.mark.parametrize("seed", range(6))
def test_interval_expansion(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(97, 99 + seed, 1500).astype(np.uint8)
    text[700:860] = text[100:260]
    text[-1] = 255
    order, twice = repeats.suffix_order(text), text.tobytes() * 2
    assert [twice[i : i + 64] for i in order] == sorted(twice[i : i + 64] for i in range(len(text)))
    short = repeats.expand_intervals(text, order, 50)
    assert short.tolist() == [k == 0 or twice[order[k] : order[k] + 50] != twice[order[k - 1] : order[k - 1] + 50] for k in range(len(order))]


@pytest.mark.parametrize("length", [50, 64, 65, 100, 128])
def test_windows_of_any_length(length):
    """Segments that agree in their first 64 bytes and part after them."""
    rng = np.random.default_rng(length)
    head, tails = rng.integers(97, 123, 70), [rng.integers(97, 123, 90) for _ in range(4)]
    texts = [np.concatenate([rng.integers(97, 123, rng.integers(0, 9)), head, tails[rng.integers(4)]]).astype(np.uint8) for _ in range(60)]
    size, doc = np.array([len(t) for t in texts]), rng.permutation(60)
    first, want = {}, []
    for d, t in zip(doc, texts):
        for p in range(len(t) - length + 1):
            w = t[p : p + length].tobytes()
            first[w] = min(d, first.get(w, d))
    for t in texts:
        want += [first[t[p : p + length].tobytes()] for p in range(len(t) - length + 1)]
    assert repeats.earliest(np.concatenate(texts), np.cumsum(size) - size, size, doc, length).tolist() == want


def test_equal_hashes_are_confirmed():
    """Stretches whose hashes are equal and whose bytes are not stay apart."""
    body = np.frombuffer(b"abcdabceabcdabcxab", np.uint8)
    place, size = np.array([0, 4, 8, 12, 16]), np.array([4, 4, 4, 4, 2])
    one, same = repeats.distinct(np.zeros(5, np.uint64), body, place, size)
    text = lambda i: body[place[i] : place[i] + size[i]].tobytes()
    assert [text(one[s]) for s in same] == [text(i) for i in range(5)] and same[0] == same[2] and len(set(same)) == 4


def test_odd_documents_repeats(odd, odd_rows, none):
    distinct = repeats.removal(odd).collect()
    assert sorted(map(tuple, distinct), key=repr) == plain_removal(odd_rows)
    kept = repeats.without_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows)
    by_id = {r["doc_id"]: r["text"] for r in kept.collect() if r["doc_id"] is not None}
    assert by_id[1] == odd_rows[0][1] and by_id[2] == "" and by_id[6] is None
    assert repeats.removal(none).count() == 0 and repeats.without_repeats(none).count() == 0


# --- pipeline -----------------------------------------------------------------------------------------


def test_stages_one_by_one(spark):
    """Each stage against a plain version on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch = Scratch(spark, "test-pipeline")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "PII", "best-fit packing"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = scratch.table(stage(spark, docs, SF), str(i))
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        if i < 4:
            assert out.columns == docs.columns and out.schema == docs.schema
            got = {r["doc_id"]: r["text"] for r in out.select("doc_id", "text").collect()}
        if i == 0:
            net = quality.trained(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(got) == {r["doc_id"] for r in quality.scored(docs, net).where("predicted = 1").collect()} and 0 < len(got) < len(rows)
        elif i == 1:
            assert set(got) == {d for d, _, c in plain_components(rows, 5, 80) if d == c} and len(got) < len(rows)
        elif i == 2:
            want = {r[0]: r[4] for r in plain_removal(rows)}
            assert set(got) == set(want) and sum(got[d] != t for d, t in rows) > 0
            for d, t in rows:
                if t.isascii():
                    assert hashlib.sha256(got[d].encode()).hexdigest() == want[d]
        elif i == 3:
            weights = pii.fitted()
            assert got == {d: pii.masked(t, weights) for d, t in rows}
        else:
            assert out.agg(F.sum("length")).first()[0] == sum(len(packing.encode(t or "")) + 1 for _, t in rows)
        docs = out


def test_odd_documents_pipeline(spark, odd, none, tmp_path):
    spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
        out = Scratch(spark, "odd-pipeline").table(stage(spark, odd, str(tmp_path)), str(k))
        assert stage(spark, none, str(tmp_path)).count() == 0, name
        if k == 4:
            assert out.groupBy("doc_id").agg(F.sum("length").alias("n")).count() == len({d for d, _ in rows})
            assert out.agg(F.sum("length")).first()[0] == sum(len(packing.encode(t or "")) + 1 for _, t in rows)
            continue
        assert out.columns == odd.columns, name
        got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
        if k == 0:
            net = quality.trained(odd, spark.read.parquet(str(tmp_path / "labels.parquet")))
            assert len(got) == quality.scored(odd, net).where("predicted = 1").count()
        elif k == 1:
            want, seen = [r for r in rows if r[0] is None], set()
            for r, (d, n, component) in sorted(zip(rows, plain_components(rows, 5, 80)), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
                place = component if n else r
                if d is not None and place not in seen and (not n or d == component):
                    seen.add(place)
                    want.append(r)
            assert got == sorted(want, key=repr)
        elif k == 2:
            cut = {(d, s) for d, _, _, _, s in plain_removal(rows)}
            assert len(got) == len(rows) and all((d, hashlib.sha256((t or "").encode()).hexdigest()) in cut for d, t in got if (t or "").isascii())
        else:
            assert got == sorted(((d, pii.masked(t, pii.fitted())) for d, t in rows), key=repr)
