"""Exact top-k inner products by aggregation of sorted lists without random access.

Each dimension has the candidates in a list sorted by their component. A query reads all lists
from the end that its own component favours, to the same depth, in rounds. For a candidate, the components read give
its known part; what is not read lies between bounds of two kinds: in a list, no unread component is better than the value where
reading stands; and the unread parts of two vectors have an inner product of at most the product of their lengths, where a
candidate's length comes with its id and the components read are taken off. So every candidate has an upper and a
lower bound. A query stops when no more than k + ``SLACK`` candidates can still reach its k-th lower bound; for
those alone the lists are read on, which resolves their scores. Queries that have not stopped after the last round read all.

For a block of queries, known parts, list bounds and unread lengths of all candidates are matrix products over the
components that are read up to a depth (the others clamped or masked). A few queries of a block go first through all rounds; the
others begin where the first of these stopped.

Candidates and queries are dealt into blocks of bounded size; each pair of blocks is one group, its
best k rows are merged by rank. Vectors that are null, or hold null, NaN or infinite components, take
no part; ties go to the smaller id; equal vectors all count; fewer candidates than k give all; an empty
table gives no rows; other columns are ignored; vectors of other lengths than the queries' are
compared over no list and raise ValueError.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._arrays import apply_arrow
from ._store import Scratch

SCHEMA = "query_id long, vec_id long, score long"
#: Rows of a block of candidates and of a block of queries: a group holds one of each.
CANDIDATES, QUERIES = 16384, 1024
#: Shares of the lists read up to each round, before the rest is resolved.
ROUNDS = (0.1, 0.25, 0.4, 0.55, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
#: A query stops when so many candidates more than k, or fewer, can still qualify. Queries of a block that go first.
SLACK, FIRST = 100, 8


class Lists:
    """The sorted lists of one block of candidates."""

    def __init__(self, rows: np.ndarray, kind: type):
        self.rows, self.n = rows, len(rows)
        self.x = rows.astype(kind).T.copy()
        self.sorted = np.sort(rows, axis=0).astype(kind)
        self.squares = (rows.astype(np.float64) ** 2).sum(1)

    def bounds(self, q: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(upper, lower) bound of the score of each query with each candidate, after reading to ``depth``."""
        x = self.x
        if depth >= self.n:
            exact = q @ x
            return exact, exact
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        # Where reading stands, from either end: an entry is read if it is better.
        top, bottom = self.sorted[self.n - 1 - depth][:, None], self.sorted[depth][:, None]
        high, low = x > top, x < bottom
        known = up @ np.where(high, x, 0) + down @ np.where(low, x, 0)
        upper = up @ np.maximum(x, top) + down @ np.minimum(x, bottom)
        # Unread lengths, in floating point: a little more than they are.
        single, f = np.float32, q.astype(np.float32)
        x2 = x.astype(single) ** 2
        mine = (f * f * (f > 0)) @ (~high).astype(single) + (f * f * (f < 0)) @ (~low).astype(single)
        theirs = self.squares[None, :].astype(single) - (f > 0).astype(single) @ np.where(high, x2, 0) - (f < 0).astype(single) @ np.where(low, x2, 0)
        theirs += 1e-5 * self.squares[None, :].astype(single)
        unread = np.sqrt(np.maximum(mine, 0) * np.maximum(theirs, 0)) * 1.0001 + 0.01
        if x.dtype.kind == "i":
            unread = np.ceil(unread.astype(np.float64)).astype(x.dtype)
        return np.minimum(upper, known + unread), known - unread


def top_k(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, rounds: tuple = ROUNDS, slack: int = SLACK, read: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, score) of the best k rows for each query; a row with the query's own id is left out.

    ``read`` gets, for each query, how many entries of the lists it has read, with those of the resolved candidates.
    """
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    n, dims = rows.shape
    big = int(max(np.abs(queries).max(initial=0), 1)) * int(max(np.abs(rows).max(initial=0), 1)) * max(dims, 1)
    if big >= 1 << 62:
        raise ValueError("components are too large for exact scores")
    kind = np.float32 if big < 1 << 24 else np.float64 if big < 1 << 53 else np.int64
    lists, found = Lists(rows, kind), []
    depths = sorted({d for d in (int(share * n) for share in rounds) if 0 < d < n}) + [n]

    def resolve(at: np.ndarray, keep: np.ndarray, depth: int) -> None:
        """Scores of the candidates that can still qualify, and each query's best k of them."""
        if read is not None:
            read.extend((depth * dims + keep.sum(1) * (n - depth) * dims // max(n, 1)).tolist())
        qn, rn = np.nonzero(keep)
        score = np.empty(len(qn), np.int64)
        for b in range(0, len(qn), 1 << 17):
            part = slice(b, b + (1 << 17))
            score[part] = np.einsum("ij,ij->i", queries[at[qn[part]]], rows[rn[part]])
        ranked = np.lexsort((rn, -score, qn))
        qn, rn, score = qn[ranked], rn[ranked], score[ranked]
        place = np.arange(len(qn)) - np.searchsorted(qn, qn)
        take = place < k
        found.append((at[qn[take]], order[rn[take]], score[take]))

    def search(at: np.ndarray, begin: int) -> int:
        """Read for the queries ``at`` from round ``begin`` on; the round in which the first stopped."""
        first = len(depths) - 1
        for i in range(begin, len(depths)):
            upper, lower = lists.bounds(queries[at].astype(kind), depths[i])
            own = query_ids[at, None] == ids[None, :]
            lower = np.where(own, np.iinfo(kind).min if kind == np.int64 else -np.inf, lower)
            keep = upper >= np.partition(lower, n - k, axis=1)[:, n - k, None] if n > k else np.ones(upper.shape, bool)
            keep &= ~own
            done = keep.sum(1) <= k + slack if i < len(depths) - 1 else np.ones(len(at), bool)
            if done.any():
                first = min(first, i)
                resolve(at[done], keep[done], depths[i])
                at = at[~done]
            if not len(at):
                break
        return first

    step = max(1, (2 << 20) // max(n, 1))
    begin = search(np.arange(min(FIRST, len(queries))), 0) if len(queries) else 0
    for a in range(FIRST, len(queries), step):
        search(np.arange(a, min(a + step, len(queries))), begin)
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.list_(pa.int64()))
    lengths = np.diff(column.offsets.to_numpy())
    if len(set(lengths.tolist())) > 1:
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def search(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """For each row where ``is_query`` holds, its k best other rows; ``vectors`` has vec_id and an integer array v."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    kept = scratch.table(vectors.select(F.col("vec_id").cast("long"), "v"), "vectors")
    queries = kept.where(is_query)
    n_candidates = max(1, -(-kept.count() // CANDIDATES))
    n_queries = max(1, -(-queries.count() // QUERIES))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    rows = kept.withColumn("c", deal(n_candidates)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1)))).withColumn("kind", F.lit(0))
    asked = queries.withColumn("q", deal(n_queries)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_candidates - 1)))).withColumn("kind", F.lit(1))

    def one(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        ids, v = table.column("vec_id").to_numpy(), _matrix(table.column("v"))
        q, c = np.flatnonzero(kind == 1), np.flatnonzero(kind == 0)
        if not len(q) or not len(c):
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
        a, b, score = top_k(v[q], ids[q], v[c], ids[c], k)
        return pa.table({"query_id": ids[q][a], "vec_id": ids[c][b], "score": score})

    both = rows.select("c", "q", "kind", "vec_id", "v").unionByName(asked.select("c", "q", "kind", "vec_id", "v"))
    best = apply_arrow(both.groupBy("c", "q"), one, SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame, factor: int = 64) -> DataFrame:
    """(vec_id, v): floor(factor * x) of each component; vectors with a component that is no finite number are dropped."""
    sound = F.expr("embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    return embeddings.where(sound).select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(F.lit(factor) * x.cast("double")).cast("long")).alias("v"))


def query(spark, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return search(vectors, F.col("vec_id") % 20 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
