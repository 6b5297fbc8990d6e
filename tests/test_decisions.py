"""Assignment, expected F, metrics, validation and drop-out on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from linkweave.operators import decide, diagnostics, groups, metrics, validate
from linkweave.sources import tables


def expected_f(ps, miss):
    best, take = 1.0, 0
    for p in ps:
        best *= 1 - p
    best *= 2.718281828459045 ** -miss
    for m in range(1, len(ps) + 1):
        f = 1.25 * sum(ps[:m]) / (0.25 * (sum(ps) + miss) + m)
        if f > best + 1e-12:
            best, take = f, m
    return take


def test_expected_f_by_hand(spark):
    rng = random.Random(3)
    claims = {s: sorted((round(rng.random(), 3) for _ in range(rng.randint(1, 6))), reverse=True) for s in range(40)}
    claims[100], claims[101], claims[102] = [0.6], [0.3], [1.0, 1.0]
    rows = [(s * 100 + i, s, p) for s, ps in claims.items() for i, p in enumerate(ps) if p > 0.05]
    found = decide.assign_expected_f(spark.createDataFrame(rows, "q_id long, s1_id long, p double"), miss_rate=0.1)
    taken = {r["s1_id"]: r["n"] for r in found.groupBy("s1_id").agg(F.count("*").alias("n")).collect()}
    assert taken.get(100) == 1 and 101 not in taken and taken.get(102) == 2
    for s, ps in claims.items():
        assert taken.get(s, 0) == expected_f([p for p in ps if p > 0.05], 0.1)


def test_assign_is_strict_and_breaks_ties(spark):
    df = spark.createDataFrame([(1, 5, 0.8), (1, 4, 0.8), (2, 4, 0.5), (3, 4, 0.9)], "q_id long, s1_id long, p double")
    assert sorted(tuple(r)[:2] for r in decide.assign(df, 0.5).collect()) == [(1, 4), (3, 4)]


def test_f_score(spark):
    df = spark.createDataFrame([(2, 1, 1), (0, 0, 0), (1, 0, 0), (0, 2, 0)], "p int, t int, h int")
    got = [r[0] for r in df.select(metrics.f_score(F.col("p"), F.col("t"), F.col("h"))).collect()]
    assert got == pytest.approx([0.5555556, 1, 0, 0], abs=1e-6)


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 3.0), (0, 1.0), (1, 2.0), (0, 2.0), (0, 0.5)], "label int, score double")
    assert metrics.roc_auc(df).first()["auc"] == pytest.approx((3 + 2 + 0.5) / 6)


def test_auc_over_many_buckets(spark):
    rows = spark.range(3000).selectExpr("int(pmod(hash(id), 2)) AS label", "double(pmod(hash(id, 3), 500)) AS score")
    found = [metrics.roc_auc(rows, buckets=n).first()["auc"] for n in (1, 7, 256)]
    table = [(r["label"], r["score"]) for r in rows.collect()]
    pos, neg = ([s for y, s in table if y == k] for k in (1, 0))
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert found == pytest.approx([want] * 3)


def test_folds_by_parity(spark):
    rows = spark.range(1000).select("id", decide.fold_of(F.col("id")).alias("fold"))
    assert rows.where("fold <> id % 2").count() == 0


def test_validation(spark):
    s1 = spark.createDataFrame([("A",), ("B",)], "id string")
    q = spark.createDataFrame([("S2-1",), ("S3-2",)], "id string")
    lists = lambda rows, c: spark.createDataFrame(rows, f"source1_entity_id string, {c} string")
    good = validate.validate(lists([("A", "S2-1"), ("B", "")], "matched_entity_ids"), lists([("A", "S2-1,S3-2"), ("B", "")], "candidate_entity_ids"), s1, q)
    assert good.count() == 0
    bad = validate.validate(lists([("A", "S2-1,S2-1"), ("A", "S3-2"), ("C", "S2-1")], "matched_entity_ids"), lists([("A", "S2-1"), ("B", "X-9")], "candidate_entity_ids"), s1, q)
    assert {r["check"] for r in bad.collect()} == {"matching duplicate row", "matching missing record", "matching unknown record", "matching duplicate id", "candidates id prefix", "candidates unknown id", "candidates missing record", "match not a candidate", "id in several records"} - {"candidates missing record"}
    wrong = validate.validate(lists([("A", "")], "ids"), lists([("A", "")], "candidate_entity_ids"), s1, q)
    assert "matching header" in {r["check"] for r in wrong.collect()}


def test_robust_keeps_twelve(spark):
    s1 = spark.createDataFrame([(1, ["5"], "a")], "id long, a_nums array<string>, n_core string")
    q = spark.createDataFrame([(7, ["5"], "a"), (8, [], "")], "id long, a_nums array<string>, n_core string")
    out = groups.group_features(spark.createDataFrame([(7, 1, 0.9), (8, 1, 0.4)], "q_id long, s1_id long, p double"), s1, q)
    assert len(out.columns) == 2 + 18 and len(groups.robust(out).columns) == 2 + 12
    assert out.where("q_id = 8").first()["g_num_eq"] == 0


def test_drop_entities(spark):
    cand = spark.createDataFrame([(1, 1, 0.9, 0), (1, 2, 0.5, 1), (2, 1, 0.4, 0)], "q_id long, s1_id long, score double, rank int")
    truth = spark.createDataFrame([(1, 2), (2, 1)], "q_id long, true_s1_id long")
    left, after = diagnostics.drop_entities(cand, truth, spark.createDataFrame([(1,)], "s1_id long"))
    assert [(r["q_id"], r["s1_id"], r["rank"]) for r in left.collect()] == [(1, 2, 0)]
    assert {r["q_id"]: r["true_s1_id"] for r in after.collect()} == {1: 2, 2: None}


def test_files(spark, tmp_path):
    raw = tmp_path / "in.tsv"
    raw.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-1\t"Quoted" & Co\t\tUS\nS2-2\tNA\t1 Main St\tFR\n', encoding="utf-8")
    rows = tables.read_tsv(spark, str(raw))
    assert [tuple(r) for r in rows.collect()] == [("S2-1", '"Quoted" & Co', "", "US"), ("S2-2", "NA", "1 Main St", "FR")]
    s1 = spark.createDataFrame([("A",), ("B",)], "id string")
    out = tables.lists(spark.createDataFrame([("S3-2", "A"), ("S2-1", "A")], "q_id string, s1_id string"), s1)
    tables.write_tsv(out, str(tmp_path / "out"))
    back = tables.read_tsv(spark, str(tmp_path / "out"), tables.TRUTH)
    assert sorted(map(tuple, back.collect())) == [("A", "S2-1,S3-2"), ("B", "")]
    assert sorted(map(tuple, tables.explode_lists(back).collect())) == [("A", "S2-1"), ("A", "S3-2")]
    built = []
    build = lambda: built.append(1) or out
    for _ in range(2):
        assert tables.cached(spark, str(tmp_path), "lists", {"k": 3}, build).count() == 2
    tables.cached(spark, str(tmp_path), "lists", {"k": 4}, build)
    assert len(built) == 2
    for text in ("one", "three"):
        (tmp_path / "input").write_text(text)
        for _ in range(2):
            tables.cached(spark, str(tmp_path), "lists", {"k": 3}, build, inputs=[str(tmp_path / "input")])
    assert len(built) == 4
    tables.write_metadata(spark, str(tmp_path / "meta"), {"threshold": 0.5})
    assert tables.read_metadata(spark, str(tmp_path / "meta")) == {"threshold": 0.5}
