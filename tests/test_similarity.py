"""Fuzzy ratios against plain definitions, and the number and acronym features."""

import random

import pytest
from pyspark.sql import functions as F

from linkweave.functions import similarity as sim


def plain_common(a, b):
    rows = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, rows[j] = rows[j], before + 1 if x == y else max(rows[j], rows[j - 1])
    return rows[-1]


def test_common_length():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert sim.common_length(a, b) == plain_common(a, b)


def test_ratios():
    assert sim.ratio("", "") == 100 and sim.ratio("ab", "") == 0
    assert sim.ratio("this is a test", "this is a test!") == pytest.approx(96.551724, abs=1e-5)
    assert sim.token_sort("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 100
    assert sim.token_set("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert sim.token_set("", "a") == 0
    assert sim.partial("this is a test", "this is a test!") == 100
    assert sim.partial("abcd", "xxabcdxx") == 100


def test_jaro_winkler():
    assert sim.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert sim.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.813333, abs=1e-6)
    assert sim.jaro_winkler("", "") == 1 and sim.jaro_winkler("a", "") == 0


def random_texts(rng, n):
    word = lambda: "".join(rng.choice("abcdé7") for _ in range(rng.randint(1, 9)))
    return [" ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 5, 14]))) for _ in range(n)]


@pytest.mark.parametrize("one, many", [(sim.ratio, sim.ratios), (sim.token_sort, sim.token_sorts), (sim.token_set, sim.token_sets), (sim.partial, sim.partials), (sim.jaro_winkler, sim.jaro_winklers)])
def test_many_pairs_like_one(one, many):
    rng = random.Random(6)
    texts = random_texts(rng, 400) + ["", "a", "a b", "x" * 64, "x" * 65, "y" * 200]
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(600)]
    pairs += [(a, a[: len(a) // 2] + "z" + a[len(a) // 2 + 1 :]) for a in texts[:200]]
    assert many(pairs).tolist() == pytest.approx([one(a, b) for a, b in pairs], abs=1e-9)
    assert len(many([])) == 0


def test_fuzzy_columns_of_records():
    """Names with several values, empty sides, and repeated pairs, against the functions of one pair."""
    rng, n = random.Random(2), 120
    texts = random_texts(rng, 30)
    side = lambda: {c: ["|".join(rng.choice(texts) for _ in range(rng.randint(1, 3))) if c in ("n_alias", "n_nospace") else rng.choice(texts) for _ in range(n)] for c in sim._INPUTS}
    q, s = side(), side()
    found = sim.fuzzy_columns(q, s)
    best = lambda f, a, b: max(f(x, y) for x in a.split("|") for y in b.split("|"))
    for i in range(n):
        a, b = ({c: v[i] for c, v in x.items()} for x in (q, s))
        want = [sim.ratio(a["n_core"], b["n_core"]), sim.token_set(a["n_core"], b["n_core"]), sim.token_sort(a["n_core"], b["n_core"]), sim.partial(a["n_core"], b["n_core"]) if a["n_core"] and b["n_core"] else 0.0]
        want += [sim.ratio(a["n_full"], b["n_full"]), sim.token_set(a["n_full"], b["n_full"]), best(sim.token_set, a["n_alias"], b["n_alias"]), best(sim.jaro_winkler, a["n_nospace"], b["n_nospace"]), sim.ratio(a["n_skel"], b["n_skel"])]
        both = a["a_norm"] and b["a_norm"]
        words = both and a["a_words"] and b["a_words"]
        want += [f(a["a_norm"], b["a_norm"]) if both else -1.0 for f in (sim.ratio, sim.token_set, sim.token_sort)] + [sim.token_set(a["a_words"], b["a_words"]) if words else -1.0, sim.partial(a["a_norm"], b["a_norm"]) if both else -1.0]
        assert [found[f][i] for f in sim.FUZZY] == pytest.approx(want, abs=1e-9)


def test_numbers(spark):
    df = spark.createDataFrame([(["287"], ["87"]), (["287"], ["2870"]), ([], ["1"]), (["5", "6"], ["6", "5"])], "q_a_nums array<string>, s_a_nums array<string>")
    found = df.select(*(v.alias(k) for k, v in sim.number_features().items())).collect()
    assert [r["num_first_suffix"] for r in found] == [1, 0, -1, 0]
    assert [r["num_first_in"] for r in found] == [0, 0, -1, 1]
    assert [r["num_jacc"] for r in found] == [0, 0, -1, 1]


def test_edit_kinds(spark):
    rows = [("", "1", "missing-num"), ("12", "12", "equal"), ("12", "14", "same-len d<=2"), ("12", "62", "same-len d3-50"), ("12", "99", "same-len d>50"), ("12", "123", "prefix"), ("23", "123", "suffix"), ("2", "123", "substring"), ("12", "345", "other")]
    df = spark.createDataFrame(rows, "a string, b string, kind string")
    assert [r[0] for r in df.select(sim.edit_kind(F.col("a"), F.col("b")) == F.col("kind")).collect()] == [True] * len(rows)
