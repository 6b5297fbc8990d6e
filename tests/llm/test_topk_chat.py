import numpy as np
import pytest
from compare import connect, oracle_rows, rows_of
from pyspark.sql import functions as F

from linkweave.llm import chat, queries, topk

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_duckdb(spark, name):
    assert rows_of(queries.QUERIES[name](spark, SF)) == oracle_rows(connect(SF), queries.ORACLES[name])


@pytest.mark.parametrize("seed", range(30))
def test_bounds_lose_nothing(seed):
    rng = np.random.default_rng(seed)
    n, dims, k = int(rng.integers(1, 120)), int(rng.integers(1, 6)), int(rng.integers(1, 25))
    rows, ids = rng.integers(-5, 6, (n, dims)), rng.permutation(300)[:n]
    queries_ = rng.integers(-5, 6, (4, dims))
    own = rng.choice(ids, 4) if n > 4 else rng.integers(0, 300, 4)
    a, b, s = topk.top_k(queries_, own, rows, ids, k, rounds=(0.1, 0.3, 0.6))
    for i in range(4):
        want = sorted((-int(queries_[i] @ rows[j]), int(ids[j])) for j in range(n) if ids[j] != own[i])[:k]
        assert [(-int(x), int(ids[j])) for q, j, x in zip(a, b, s) if q == i] == want


@pytest.mark.parametrize("size", ["0.01", "0.1"])
def test_fewer_entries_are_read(spark, size):
    """With the query's own settings: every query stops before its lists end, and the results are those of the full product."""
    table = topk.quantised(spark.read.parquet(f"/root/testdata/sf{size}/embeddings.parquet")).collect()
    ids, rows = np.array([r["vec_id"] for r in table]), np.array([r["v"] for r in table])
    asked, read = np.flatnonzero(ids % 20 == 0), []
    a, b, s = topk.top_k(rows[asked], ids[asked], rows, ids, 20, read=read)
    assert len(read) == len(asked) and max(read) < 0.95 * rows.size and np.mean(read) < 0.9 * rows.size
    for i, q in enumerate(asked):
        scores = rows @ rows[q]
        want = sorted((-int(x), int(v)) for x, v in zip(scores, ids) if v != ids[q])[:20]
        assert [(-int(x), int(ids[j])) for n, j, x in zip(a, b, s) if n == i] == want


def test_blocks_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 7)
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = np.random.default_rng(3)
    vectors = {i: rng.normal(size=3).round(2).tolist() for i in range(60)}
    vectors[20] = [float("nan"), 0.0, 1.0]
    vectors[21] = None
    vectors[22] = [None, 1.0, 2.0]
    vectors[23] = [float("inf"), 1.0, 2.0]
    vectors[24] = vectors[25] = vectors[26]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors.items()], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in topk.search(topk.quantised(df), F.col("vec_id") % 20 == 0, k=9).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    sound = {i: [int(np.floor(64 * x)) for x in v] for i, v in vectors.items() if i not in (20, 21, 22, 23)}
    assert sorted(got) == [0, 40]
    for q, found in got.items():
        want = sorted((-int(np.dot(sound[q], v)), i) for i, v in sound.items() if i != q)[:9]
        assert sorted(found) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
    assert topk.search(topk.quantised(df.limit(0)), F.col("vec_id") % 20 == 0).count() == 0


def test_escapes_come_back(spark):
    texts = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>", "<\\|end|>", "<\\\\s>", "a < b [x]", "<<SYS>>", "[INST", "\\", "$1 \\$2", "<s<s>", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t")))
    for r in df.withColumn("back", chat.unescape(F.col("e"))).collect():
        assert r["back"] == r["t"] and not any(c in r["e"] for c in (chat.TURN, chat.TEXT, chat.END, "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_examples(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "user", None), (1, 4, "assistant", "<|end|>"), (1, 5, "user", "bye"), (2, 0, "user", "alone"), (None, None, None, None), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, example string")
    found = {}
    for r in chat.examples(df).orderBy("conv_id", "example").collect():
        found.setdefault(r["conv_id"], []).append((r["text"], r["text"][r["loss_start"] : r["loss_end"]]))
    assert [loss for _, loss in found[1]] == ["hello", "<\\|end|>", ""]
    assert found[1][0][0] == "<|turn|>system<|text|>be kind<|end|><|turn|>user<|text|>hi<|end|><|turn|>assistant<|text|>hello<|end|>"
    assert all(b[0].startswith(a[0]) for a, b in zip(found[1], found[1][1:]))
    assert found[2] == [("<|turn|>user<|text|>alone<|end|>", "")]
    assert [loss for _, loss in found[3]] == ["a", "a", "b"]
    assert found[None] == [("<|turn|><|text|><|end|>", "")]
    assert {r["conv_id"]: r["n_turns"] for r in chat.digests(chat.examples(df)).collect()} == {1: 6, 2: 1, 3: 3, None: 1}
    assert chat.digests(chat.examples(df.limit(0))).count() == 0


def test_long_conversations_and_texts(spark):
    """A conversation of many turns, and one of texts of a million characters, read back whole."""
    import hashlib

    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i} </s>") for i in range(600)] + [(2, i, ("user", "assistant")[i % 2], "[INST] é🙂 " * 100_000) for i in range(4)]
    found = {r["conv_id"]: r for r in chat.digests(chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for conv in (1, 2):
        turns = [(role, text) for c, _, role, text in rows if c == conv]
        said = "".join(text for role, text in turns if role == "assistant")
        assert found[conv]["n_turns"] == len(turns) and found[conv]["loss_chars"] == len(said)
        assert found[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert found[conv]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_formatting_is_native(spark):
    plan = queries.QUERIES["op2_chat_formatting"](spark, SF)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
