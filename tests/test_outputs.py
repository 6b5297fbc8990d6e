"""Checks of faulty outputs, and one pass over all ways of a query."""

import duckdb
from compare import oracle_rows, rows_of

from linkweave import catalog
from linkweave.operators import diagnostics


def test_a_record_left_out_keeps_its_foreign_ids(spark, tmp_path):
    """Record 100 is left out of one table and holds a foreign id in the other."""
    parts = [(i, "red bolt" if i // 2 % 2 else "blue ring", f"Brand#{i // 4}", "SMALL", i // 4) for i in (96, 97, 100, 101, 200, 201, 204, 205)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    found = rows_of(catalog.QUERIES["validate_outputs"](spark, str(tmp_path)))
    assert found == oracle_rows(con, catalog.ORACLES["validate_outputs"])
    assert {("matching id prefix", "X-101", "100"), ("matching missing record", "", "100")} <= set(found[1])


def test_loss_oracles_take_one_pass(spark):
    """Missed, wrong, rejected and right queries; the pairs are planned once, not once for each oracle."""
    pairs = lambda rows, columns: spark.createDataFrame(rows, columns)
    truth = pairs([(1, 10), (2, 10), (3, 20), (4, None)], "q_id long, true_s1_id long")
    assigned, reach = pairs([(1, 10), (3, 10), (4, 20)], "q_id long, s1_id long"), pairs([(1, 10), (2, 10), (3, 10), (4, 20)], "q_id long, s1_id long")
    out = diagnostics.loss_oracles(assigned, reach, truth, pairs([(10,), (20,)], "id long"))
    one = lambda n, t, h: 1.0 if n == t == 0 else 0.0 if h == 0 else 1.25 * (h / n) * (h / t) / (0.25 * h / n + h / t)
    want = {"as it is": (one(2, 2, 1), one(1, 1, 0)), "no false merges": (one(1, 2, 1), one(0, 1, 0)), "accept candidates": (one(3, 2, 2), one(1, 1, 0)), "perfect matcher": (one(2, 2, 2), one(0, 1, 0)), "perfect": (1.0, 1.0)}
    assert {r.oracle: round(r.f, 9) for r in out.collect()} == {k: round(sum(v) / 2, 9) for k, v in want.items()}
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
