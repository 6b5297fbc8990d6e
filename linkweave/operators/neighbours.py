"""Nearest canonical vectors of each query, and candidates added from them.

``exact_knn`` deals both sides into blocks whose size is bounded, and compares block with block as matrices, so
no side is broadcast and no pair of rows is ever shuffled; each pair of blocks keeps its best k. ``lsh_knn`` is
the approximate way for very large canonical sides: it compares inside buckets of projections, block by block too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.similarity import address_rerank
from .blocking import top_k

#: Rows of one block of either side.
BLOCK = 8192
#: Sizes of so many buckets at most are broadcast.
MOST_BUCKETS = 20_000


def encode(records: DataFrame, encoder: Callable[[pd.Series], np.ndarray], text: str = "text") -> DataFrame:
    """Add ``vec`` by a pluggable encoder of a series of texts."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(vec=list(np.asarray(encoder(part[text]), dtype=float)))

    return records.mapInPandas(run, StructType([*records.schema.fields, StructField("vec", ArrayType(DoubleType()))]))


def unit(vectors: DataFrame) -> DataFrame:
    """(id, group, vec) with unit length; null and zero vectors are dropped."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    sized = vectors.where("vec IS NOT NULL").withColumn("vec", F.transform("vec", lambda x: x.cast("double"))).withColumn("_norm", norm).where("_norm > 0")
    # The norm as an array beside the components: named inside their lambda, it would be summed anew for each of them.
    return sized.withColumn("vec", F.zip_with("vec", F.array_repeat("_norm", F.size("vec")), lambda x, norm: x / norm)).drop("_norm")


def exact_knn(s1: DataFrame, q: DataFrame, k: int = 20, block: int = BLOCK) -> DataFrame:
    """(q_id, s1_id, cos, erank): inside each group, the k nearest by cosine, rounded to 9 places before ranking."""
    sizes = {side: max(1, -(-df.count() // block)) for side, df in (("s", s1), ("q", q))}
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = unit(q).select("id", "group", "vec", deal(sizes["q"]).alias("qb"), every(sizes["s"]).alias("sb"), F.lit(1).alias("side"))
    right = unit(s1).select("id", "group", "vec", every(sizes["q"]).alias("qb"), deal(sizes["s"]).alias("sb"), F.lit(0).alias("side"))

    def best(part: pd.DataFrame) -> pd.DataFrame:
        qs, ss = part[part.side == 1], part[part.side == 0].sort_values("id")
        if qs.empty or ss.empty:
            return pd.DataFrame({"q_id": pd.Series(dtype="int64"), "s1_id": pd.Series(dtype="int64"), "cos": pd.Series(dtype=float)})
        vectors, ids = np.stack(ss.vec.to_numpy()), ss.id.to_numpy()
        out = []
        for a in range(0, len(qs), 512):
            cos = np.round(np.stack(qs.vec.to_numpy()[a : a + 512]) @ vectors.T, 9)
            order = np.argsort(-cos, axis=1, kind="stable")[:, :k]  # equal ones by id
            out.append(pd.DataFrame({"q_id": np.repeat(qs.id.to_numpy()[a : a + 512], order.shape[1]), "s1_id": ids[order.ravel()], "cos": np.take_along_axis(cos, order, 1).ravel()}))
        return pd.concat(out)

    kind = q.schema["id"].dataType.simpleString()
    pairs = left.unionByName(right).groupBy("group", "qb", "sb").applyInPandas(best, f"q_id {kind}, s1_id {kind}, cos double")
    return top_k(pairs, k, "cos").withColumnRenamed("rank", "erank")


def lsh_knn(s1: DataFrame, q: DataFrame, k: int = 20, bucket: float = 0.5, tables: int = 4, reach: float = 1.0, block: int = BLOCK) -> DataFrame:
    """Approximate neighbours: random projections propose pairs within ``reach``, exact cosines rank them.

    The rows of a bucket are dealt into blocks of bounded size, and each pair of blocks keeps its best k: no pair that a
    bucket proposes is shuffled with its vectors.
    """
    left, right = (unit(df).withColumn("features", array_to_vector("vec")) for df in (q, s1))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=7).fit(right)

    def dealt(df: DataFrame, side: int) -> DataFrame:
        each = model.transform(df).select("id", "group", "vec", F.posexplode("hashes").alias("table", "hash"))
        return each.select("id", "vec", F.struct("group", "table", vector_to_array("hash")[0].alias("hash")).alias("bucket"), F.lit(side).alias("side"))

    rows = dealt(left, 1).unionByName(dealt(right, 0))
    sizes = rows.groupBy("bucket").agg(F.sum("side").alias("nq"), F.sum(1 - F.col("side")).alias("ns")).where("nq > 0 AND ns > 0")
    few = sizes.limit(MOST_BUCKETS + 1).collect()
    if len(few) <= MOST_BUCKETS:
        sizes = F.broadcast(q.sparkSession.createDataFrame(few, sizes.schema))
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    own = lambda n: F.array(F.pmod(F.xxhash64("id"), blocks(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), blocks(n) - 1)
    is_query = F.col("side") == 1
    rows = rows.join(sizes, "bucket").withColumns({"qb": F.when(is_query, own("nq")).otherwise(every("nq")), "sb": F.when(is_query, every("ns")).otherwise(own("ns"))})
    rows = rows.withColumn("qb", F.explode("qb")).withColumn("sb", F.explode("sb"))

    def best(part: pd.DataFrame) -> pd.DataFrame:
        qs, ss = part[part.side == 1], part[part.side == 0].sort_values("id")
        out = [pd.DataFrame({"q_id": qs.id[:0], "s1_id": ss.id[:0], "cos": pd.Series(dtype=float)})]
        if len(qs) and len(ss):
            vectors, ids = np.stack(ss.vec.to_numpy()), ss.id.to_numpy()
            for a in range(0, len(qs), 512):
                cos = np.stack(qs.vec.to_numpy()[a : a + 512]) @ vectors.T
                cos = np.where(2 - 2 * cos < reach * reach, np.round(cos, 9), -np.inf)
                least = -np.partition(-cos, min(k, len(ids)) - 1, axis=1)[:, [min(k, len(ids)) - 1]]
                row, column = np.nonzero((cos >= least) & (cos > -np.inf))
                order = np.lexsort((column, -cos[row, column], row))  # equal ones by id
                row, column = row[order], column[order]
                first = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, column = row[first], column[first]
                out.append(pd.DataFrame({"q_id": qs.id.to_numpy()[a : a + 512][row], "s1_id": ids[column], "cos": cos[row, column]}))
        return pd.concat(out)

    kind = q.schema["id"].dataType.simpleString()
    pairs = rows.groupBy("bucket", "qb", "sb").applyInPandas(best, f"q_id {kind}, s1_id {kind}, cos double")
    # A pair may meet in several buckets; blocks of other shapes may sum in another order, which rounding may show.
    pairs = pairs.groupBy("q_id", "s1_id").agg(F.max("cos").alias("cos"))
    return top_k(pairs, k, "cos").withColumnRenamed("rank", "erank")


def add_candidates(candidates: DataFrame, knn: DataFrame, s1: DataFrame, q: DataFrame, extra: int = 2) -> DataFrame:
    """Candidates with up to ``extra`` new neighbours of each query, ranked by cosine and address overlap.

    New pairs have score 0 and the ranks after the query's last. emb_cos is null where the query has no neighbours at all,
    and 0 where it has some but not this one.
    """
    records = lambda df, key, p: df.select(F.col("id").alias(key), F.col("a_nums").alias(f"{p}a_nums"), F.col("a_words").alias(f"{p}a_words"))
    joined = knn.join(records(q, "q_id", "q_"), "q_id").join(records(s1, "s1_id", "s_"), "s1_id")
    new = joined.join(candidates.select("q_id", "s1_id"), ["q_id", "s1_id"], "left_anti").withColumn("rr", F.round(address_rerank(F.col("cos")), 9))
    new = top_k(new.select("q_id", "s1_id", "rr"), extra, "rr")
    last = candidates.groupBy("q_id").agg(F.max("rank").alias("last"))
    added = new.join(last, "q_id", "left").select("q_id", "s1_id", F.lit(0.0).alias("score"), (F.coalesce("last", F.lit(-1)) + 1 + F.col("rank")).cast("int").alias("rank"), F.lit(1).alias("is_emb"))
    both = candidates.select("q_id", "s1_id", F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("rank"), F.lit(0).alias("is_emb")).unionByName(added)
    cosines = joined.groupBy("q_id", "s1_id").agg(F.max("cos").alias("emb_cos"))
    native = joined.select("q_id", F.lit(True).alias("_near")).distinct()
    both = both.join(cosines, ["q_id", "s1_id"], "left").join(native, "q_id", "left")
    return both.withColumn("emb_cos", F.when(F.col("emb_cos").isNull() & F.col("_near"), 0.0).otherwise(F.col("emb_cos"))).drop("_near")


def hit_rate(knn: DataFrame, truth: DataFrame, depths: tuple[int, ...] = (1, 2, 5, 10, 20)) -> DataFrame:
    """(k, hits, recall): matched queries whose canonical record is among their first k neighbours."""
    true = truth.where("true_s1_id IS NOT NULL").select("q_id", F.col("true_s1_id").alias("s1_id"))
    found = true.join(knn.select("q_id", "s1_id", "erank"), ["q_id", "s1_id"], "left")
    each = found.select("erank", F.explode(F.array(*map(F.lit, depths))).alias("k"))
    hit = (F.col("erank") < F.col("k")).cast("int")
    return each.groupBy("k").agg(F.coalesce(F.sum(hit), F.lit(0)).alias("hits"), F.avg(F.coalesce(hit, F.lit(0))).alias("recall"))
