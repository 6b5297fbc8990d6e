"""Best-fit decreasing packing of token sequences into fixed-length training sequences.

Documents are cut into pieces of at most ``capacity`` tokens. Pieces of one length are
interchangeable, and so are bins of one remaining capacity, so best-fit decreasing over all
pieces needs only how many pieces there are of each length: a table of ``capacity`` numbers,
whatever the size of the corpus. ``plan`` runs the algorithm over those counts with a segment
tree over remaining capacities; each row of the plan places a run of equal pieces. Pieces then
find their place in the plan by their rank among pieces of their length, in Spark.

Defined results: a null text is empty; an empty text is one piece holding the end token; texts of any length, of white space
too, are encoded whole; repeated texts are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import map_arrow
from ._store import Scratch, shards

CAPACITY = 2048
END = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """A segment tree over remaining capacities that finds the tightest open bin in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = np.zeros(2 * self.leaves, bool)

    def mark(self, remaining: int, is_open: bool) -> None:
        i = remaining + self.leaves
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of an open bin that is at least ``need``."""
        i = need + self.leaves
        if self.open[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, pieces, first bin, pieces a bin, offset) that place ``counts`` pieces of each length.

    The same bins as best-fit decreasing piece by piece: a bin that takes one piece of a length and has
    room for another is the tightest for the next one, so equal pieces fill up bins of one remaining
    capacity in turn.
    """
    tree, runs, rows, bins = OpenBins(capacity), {}, [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]

        def place(first: int, n_bins: int, room: int) -> None:
            nonlocal rank, left
            each = room // length
            full = min(n_bins, left // each)
            for n, per, at in ((full, each, first), (int(full < n_bins and 0 < left - full * each), left - full * each, first + full)):
                if n:
                    rows.append((length, rank, n * per, at, per, capacity - room))
                    rank, left = rank + n * per, left - n * per
                    if rest := room - per * length:
                        runs.setdefault(rest, []).append((at, n))
                        tree.mark(rest, True)

        while left:
            room = tree.tightest(length)
            if room is None:
                n = -(-left // (capacity // length))
                bins += n
                place(bins - n, n, capacity)
                continue
            first, n = runs[room].pop()
            if not runs[room]:
                del runs[room]
                tree.mark(room, False)
            used = min(n, -(-left // (room // length)))
            if used < n:
                runs.setdefault(room, []).append((first + used, n - used))
                tree.mark(room, True)
            place(first, used, room)
    return rows


@lru_cache(maxsize=2)
def _fast(name: str):
    import tiktoken

    with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        special = [t["content"] for t in json.load(file)["added_tokens"]]
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), special


@lru_cache(maxsize=2)
def _exact(name: str):
    """Loaded only where a text holds a special string."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


#: White space in a row, at least, that is taken out of a text before the pattern engine sees it: its stack overflows at some 10^5 more.
BLANKS = 4096
_BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % BLANKS)


def encode(text: str, name: str = "byte_bpe_50k.json") -> np.ndarray:
    """Ids as the tokenizers library gives them; texts without special strings take the same vocabulary's faster encoder.

    The pattern makes one piece of a run of white space, but for its last character if the text goes on; so long runs
    are encoded as pieces, and what stands between them by itself.
    """
    fast, special = _fast(name)
    if any(s in text for s in special):
        return np.array(_exact(name).encode(text, add_special_tokens=False).ids, "<u4")
    ids, at = [], 0
    for m in _BLANKS.finditer(text):
        end = m.end() - (m.end() < len(text))
        ids += fast.encode_ordinary(text[at : m.start()])
        ids += fast._encode_single_piece(text[m.start() : end].encode())
        at = end
    return np.array(ids + fast.encode_ordinary(text[at:]), "<u4")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: all are full but the first, which may be shorter."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Tokenize every whole text, end it with token 0 and cut it; (doc_id, piece, start, length, ids_crc32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), pc.fill_null(batch.column(1), "").to_pylist()):
                ids = np.append(encode(text, tokenizer), np.uint32(END)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    for column, value in zip(rows, (doc, k, start, length, zlib.crc32(ids[start : start + length]))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, PIECES)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Pack all documents; one row for each piece with its sequence_id and the offset in it."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    salts = shards(docs, 8 << 20)
    # A rank inside (length, salt) keeps a length that most pieces have spread over many tasks.
    cut_up = scratch.table(pieces(docs, capacity, tokenizer).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")), "pieces")
    groups = cut_up.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    rows = plan(counts, capacity)
    schema = "length long, first_rank long, n long, first_bin long, per long, offset0 long"
    table = pa.table([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 6)], ["length", "first_rank", "n", "first_bin", "per", "offset0"])
    placed = spark.createDataFrame(table) if rows else spark.createDataFrame([], schema)
    before = groups.selectExpr("length", "salt", "sum(n) over (partition by length order by salt) - n AS before")
    in_group = "row_number() over (partition by length, salt order by doc_id, piece, start, ids_crc32) - 1"
    ranked = cut_up.selectExpr("*", f"{in_group} AS nth").join(before, ["length", "salt"]).withColumn("rank", F.col("nth") + F.col("before"))
    # The plan has at most some rows for each pair of lengths: bounded by the capacity, not by the corpus.
    runs = placed.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first_rank", "first_bin", "per", "offset0"))).alias("runs"))
    found = ranked.join(F.broadcast(runs), "length").withColumn("run", F.expr("element_at(filter(runs, r -> r.first_rank <= rank), -1)"))
    return found.selectExpr(
        "doc_id", "piece", "start", "length", "ids_crc32",
        "run.first_bin + (rank - run.first_rank) div run.per AS sequence_id",
        "run.offset0 + pmod(rank - run.first_rank, run.per) * length AS offset",
    )


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
