"""Similarity join of documents on sets of word n-grams, exact, with a token-group matrix.

Equal sets are one node. Two sets that reach the threshold share a token of their prefixes, the first tokens
in an order that all sets keep; the order puts tokens that many documents hold last, after a count of tokens in a table
of fixed size, so what many documents share rarely brings them together.

1. Map tasks send the prefixes, packed by shard; shards return the tokens that several sets hold.
2. Each set is compared with the one that leads most of its tokens. Links found so give first components. Sets
   whose bitmaps are near the same one are similar: they form, in parts of bounded size, the groups of the matrix.
3. For each group the union of its members' tokens is stored, as a column of the matrix: a bitmap of hashed tokens, about two
   bits for each. A set that shares a prefix token with members of another component in a group is compared with that
   union: its bits outside bound from above what it can share with any member. Groups whose bound reaches the
   threshold are opened, and members of fitting size in components that have not met are compared.
4. Links of both steps give the components.

5. Every link lies inside a component, so each document's number of links is counted there: the sets of a component, or
   blocks of a large one by size and hash, are compared all with all in a task, which returns a count for each set.

Steps 1 to 4 leave out pairs inside a component, as they are linked already; every other pair above the
threshold is met in step 3. No row is ever built for a pair inside a group.

Defined results: null and empty texts, and texts without words, have no set and are their own component;
texts with fewer words than an n-gram have one token; repeated texts and rows are linked; rows with a null doc_id
can be linked, but name no component; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import apply_arrow, map_arrow, packed, packed_sorted, unpacked, unpacked_sorted
from ._store import Scratch, plan_bytes, shards
from ._words import blocks, sets

PER_SHARD, PACKED = 8 << 20, 1 << 19
#: Members of a group of the matrix, about; parts in which the counts of tokens are summed.
GROUP, PARTS = 128, 16
#: Sets that are compared with one group in one task, about.
ASKED = 256
#: Sets and tokens of a block whose links are counted in one task, at most but for single larger sets and uneven hashes; tokens that so few
#: sets hold are counted pair by pair, others by products of matrices with so many columns.
BLOCK, TOKENS, RARE, COLUMNS = 1024, 1 << 19, 8, 4096
#: Rows of ids that are broadcast at most, after they have been counted: some MB.
BROADCAST = 200_000


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of ``n`` tokens with a set of any size."""
    return -(-n * percent // 100)


def signature(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def bitmap(tokens: np.ndarray, size: int | None = None) -> bytes:
    """Which of about two slots a token are taken; a power of two of 64 bits at least."""
    size = size or max(64, 2 << max(0, len(tokens) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(tokens >> np.uint64(24) & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same tokens in fewer slots."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def most_shared(n: int, own: bytes, other: bytes) -> int:
    """An upper bound of the overlap of a set of ``n`` tokens with another: bits it has alone are tokens it has alone."""
    a, b = np.frombuffer(own, np.uint64), np.frombuffer(other, np.uint64)
    words = min(len(a), len(b))
    return n - int(np.bitwise_count(folded(a, words) & ~folded(b, words)).sum())


def _summaries(docs: DataFrame, words: int, slots: int) -> DataFrame:
    """(doc_id, key, n, sig, bitmap as cell) of each document, and counts of tokens by slot in rows with a part."""
    schema = "doc_id long, key long, n long, sig long, part int, cell binary"
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, waiting = np.zeros(slots, np.uint32), 0
        names = [x.split()[0] for x in schema.split(", ")]

        def flush() -> pa.RecordBatch:
            rows = [(None, None, None, None, p, packed(c)) for p, c in enumerate(np.split(count, PARTS)) if c.any()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for rows, data, offsets in blocks(batches):
            found = list(sets(data, offsets, words))
            every = np.concatenate(found)
            count += np.bincount((every & np.uint64(slots - 1)).astype(np.int64), minlength=slots).astype(np.uint32)
            waiting += len(every)
            columns = [rows.column("doc_id"), rows.column("key"), pa.array([len(x) for x in found], pa.int64()), pa.array([signature(x) for x in found], pa.int64()), pa.nulls(len(found), pa.int32()), pa.array([bitmap(x) if len(x) else None for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)
            if waiting > 8 * slots:
                yield flush()
                count[:], waiting = 0, 0
        if waiting:
            yield flush()

    return map_arrow(docs, run, schema)


def _levels(summaries: DataFrame, slots: int) -> np.ndarray:
    """For each slot how far its count exceeds the mean, as a small number; a table of fixed size."""
    total = summaries.where("part is null").agg(F.sum("n")).first()[0] or 0
    mean = max(total / slots, 0.5)

    def level(table: pa.Table) -> pa.Table:
        count = sum(unpacked(c.as_py(), np.uint32).astype(np.int64) for c in table.column("cell"))
        high = np.where(count < 2 * mean, 0, np.log2(np.maximum(count / mean, 1)) * 2).astype(np.uint8)
        return pa.table({"part": table.column("part")[:1], "cell": pa.array([packed(high)], pa.binary())})

    out = np.zeros((PARTS, slots // PARTS), np.uint8)
    for r in apply_arrow(summaries.where("part is not null").select("part", "cell").groupBy("part"), level, "part int, cell binary").collect():  # PARTS rows
        out[r["part"]] = unpacked(r["cell"], np.uint8)
    return out.reshape(-1)


def prefix(tokens: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The tokens of which any set above the threshold shares one."""
    order = np.argsort(levels[(tokens & np.uint64(len(levels) - 1)).astype(np.int64)], kind="stable")
    return tokens[order[: len(tokens) - needed(len(tokens), percent) + 1]]


def _postings(docs: DataFrame, words: int, percent: int, levels, n: int) -> DataFrame:
    """(token, sig, n) of prefix tokens that several sets hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known, count = [], {}, 0

        def flush() -> pa.RecordBatch:
            sig, size = np.array(list(known), np.int64), np.array(list(known.values()), np.int64)
            token, which = np.concatenate(held), np.repeat(np.arange(len(held)), [len(x) for x in held])
            order = np.argsort(token)
            token, which = token[order], which[order]
            shard = ((token >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
            edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            rows = []
            for a, b in zip(edges, np.append(edges[1:], len(token))):
                own, at = np.unique(which[a:b], return_inverse=True)
                rows.append((int(shard[a]), packed_sorted(token[a:b]), packed(at, np.int32), packed(sig[own]), packed(size[own])))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], ["shard", "tokens", "at", "sigs", "sizes"])

        for _, data, offsets in blocks(batches):
            for x in sets(data, offsets, words):
                if len(x) and (s := signature(x)) not in known:
                    known[s] = len(x)
                    held.append(prefix(x, levels.value, percent))
                    count += len(held[-1])
            if count >= PACKED:
                yield flush()
                held, known, count = [], {}, 0
        if count:
            yield flush()

    def several(table: pa.Table) -> pa.Table:
        parts = []
        for r in table.to_pylist():
            at = unpacked(r["at"], np.int32)
            parts.append((unpacked_sorted(r["tokens"]), unpacked(r["sigs"], np.int64)[at], unpacked(r["sizes"], np.int64)[at]))
        token, sig, size = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((sig, token))
        token, sig, size = token[order], sig[order], size[order]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])])
        token, sig, size = token[new], sig[new], size[new]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        per = np.diff(np.append(first, len(token)))
        keep = np.repeat(per > 1, per)
        return pa.table({"token": token[keep].view(np.int64), "sig": sig[keep], "n": size[keep]})

    packed_ = map_arrow(docs.select("text"), run, "shard int, tokens binary, at binary, sigs binary, sizes binary")
    return apply_arrow(packed_.groupBy("shard"), several, "token long, sig long, n long")


def _few(ids: DataFrame) -> DataFrame:
    """A written table of ids, broadcast if it is small; beyond that both sides are shuffled."""
    return F.broadcast(ids) if ids.count() <= BROADCAST else ids


#: What a row is found by: its doc_id; the hash of its text if that is null.
_ROW = "coalesce(doc_id, key)"


def _sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(sig, n, cell): the tokens of the wanted sets, from one document (row, sig) each; ``wanted`` is a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches):
            out, asked = [], rows.column("sig").to_pylist()
            for x, s in zip(sets(data, offsets, words), asked):
                if signature(x) == s:  # not another text of the same row number
                    out.append((s, len(x), x.tobytes()))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], ["sig", "n", "cell"])

    return map_arrow(docs.withColumn("row", F.expr(_ROW)).join(_few(wanted), "row").select("text", "sig"), run, "sig long, n long, cell binary").dropDuplicates(["sig"])


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _joined(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (a, b) with the size and cell of a, and the size and cell of b."""
    joined = pairs.join(left.select(F.col("sig").alias("a"), F.col("n").alias("left_n"), F.col("cell").alias("left_cell")), "a")
    joined = joined.join(right.select(F.col("sig").alias("b"), F.col("n").alias("right_n"), F.col("cell").alias("right_cell")), "b")
    return joined.select("a", "b", "left_n", "left_cell", "right_n", "right_cell")


def _possible(pairs: DataFrame, left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps allow the overlap that the threshold needs; right_n is the least size on that side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [most_shared(n, x, y) >= needed(max(n, m), percent) for n, x, m, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(_joined(pairs, left, right), run, "a long, b long")


def _similar(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("left_cell"), batch.column("right_cell")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = _overlap(x, y)
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(_joined(pairs, tokens, tokens), run, "a long, b long")


def _opened(asks: DataFrame, parts: DataFrame, members: DataFrame, component: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of sets that ask for a group with its members, as many as join components that were apart.

    ``parts`` has the groups that many sets ask for: in how many tasks. A pair whose components have met in the
    task is not compared, so a task gives fewer links than it has sets.
    """
    n = F.coalesce("parts", F.lit(1))
    asked = asks.join(parts, "group", "left").select("group", F.pmod(F.xxhash64("a"), n).cast("int").alias("part"), F.lit(1).alias("asks"), F.col("a").alias("sig"))
    held = members.join(parts, "group", "left").select("group", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"), F.lit(0).alias("asks"), "sig")

    def one(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("asks", "sig", "component", "cell"))), key=lambda r: r[:2])
        joined: dict[int, int] = {}

        def root(c: int) -> int:
            while joined.get(c, c) != c:
                c = joined[c]
            return c

        inside = [(s, c, np.frombuffer(x, np.uint64)) for k, s, c, x in rows if not k]
        found = ([], [])
        for k, s, c, x in rows:
            x = np.frombuffer(x, np.uint64)
            for t, d, y in inside if k else ():
                least, most = sorted((len(x), len(y)))
                if 100 * least < percent * most or root(c) == root(d):
                    continue
                both = _overlap(x, y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    found[0].append(s)
                    found[1].append(t)
                    joined[root(c)] = root(d)
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    rows = asked.unionByName(held).join(tokens.select("sig", "cell"), "sig").join(component, "sig")
    return apply_arrow(rows.groupBy("group", "part"), one, "a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()


def components(scratch: Scratch, links: DataFrame, name: str, turns: int = 64) -> DataFrame:
    """(node, component) of linked nodes, the component being its least node: alternating large and small stars.

    A component of n nodes settles in about log(n) turns; RuntimeError if ``turns`` do not suffice.
    """
    edges = scratch.table(links.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), f"{name}-0")
    digest = lambda: edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    state = digest()
    for turn in range(1, turns):
        if not state[0]:
            break
        # Each half of a turn is written, for it is read several times: as a plan, it would be planned and compiled each time.
        both = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) AS m")
        large = scratch.table(both.join(least, "a").where("b > a").selectExpr("b AS a", "m AS b").where("a <> b").distinct(), f"{name}-{turn}-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").selectExpr("IF(b = m, a, b) AS a", "m AS b").distinct()
        edges = scratch.table(small, f"{name}-{turn}")
        now = digest()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    stars = edges.selectExpr("a AS node", "b AS component")
    return stars.unionByName(stars.selectExpr("component AS node", "component").distinct())


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """How many tokens each set shares with each set of the other list; of its own list if there is no other."""
    every, l = left + (right or []), len(left)
    r = len(left if right is None else right)
    token, owner = np.concatenate(every), np.repeat(np.arange(len(every)), [len(x) for x in every])
    order = np.argsort(token, kind="stable")  # equal tokens stay in the order of their sets
    token, owner = token[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    per = np.diff(np.append(first, len(token)))
    few = np.repeat(per <= RARE, per)
    out = np.zeros(l * r, np.int64)
    rare, of = token[few], owner[few]
    for k in range(1, RARE):
        same = np.flatnonzero(rare[k:] == rare[:-k])
        a, b = of[same], of[same + k]
        if right is None:
            out += np.bincount(np.concatenate([a * r + b, b * r + a]), minlength=l * r)
        else:
            cross = (a < l) & (b >= l)
            out += np.bincount(a[cross] * r + b[cross] - l, minlength=l * r)
    out = out.reshape(l, r)
    owner, per = owner[~few], per[per > RARE]
    edges = np.concatenate([[0], np.cumsum(per)])
    for at in range(0, len(per), COLUMNS):
        to = min(at + COLUMNS, len(per))
        cells = np.zeros((len(every), to - at), np.float32)
        cells[owner[edges[at] : edges[to]], np.repeat(np.arange(to - at), per[at:to])] = 1
        out += (cells[:l] @ cells[-r:].T).astype(np.int64)
    return out


def _counts(scratch: Scratch, sets_: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """(sig, links): for each set of ``sets_`` (sig, component, n, copies) the documents with other sets that reach the threshold with it.

    A component is one unit. A large one is split by size into bands, so that sets that can be linked lie in the same or in adjacent
    bands, and bands are split by hash into blocks; each pair of blocks is a unit.
    """
    width = max(math.log(100 / percent), 0.01) * 1.001  # wider than needed, for the sake of rounding
    sets_ = scratch.table(sets_.withColumn("band", F.floor(F.log("n") / width)), "counted-sets")
    sizes = scratch.table(sets_.groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("tokens")), "counted-sizes")
    large = _few(scratch.table(sizes.where(f"size > {BLOCK} OR tokens > {TOKENS}").select("component"), "large"))
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    bundles = max(8, int(scratch.spark.conf.get("spark.sql.shuffle.partitions", "8")), total // TOKENS)
    whole = sets_.join(large, "component", "left_anti")
    whole = whole.select("sig", "n", "copies", F.pmod(F.xxhash64("component"), F.lit(bundles)).alias("task"), F.col("component").alias("unit"), F.lit(2).alias("side"))

    split = sets_.join(large, "component", "left_semi")
    bands = scratch.table(split.groupBy("component", "band").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / TOKENS)).alias("blocks")), "bands")
    around = bands.join(bands.selectExpr("component", "band - 1 AS band", "blocks AS up"), ["component", "band"], "left")
    around = around.join(bands.selectExpr("component", "band + 1 AS band", "blocks AS down"), ["component", "band"], "left").na.fill(0)
    split = split.join(_few(scratch.table(around, "around")), ["component", "band"]).withColumn("own", F.expr("pmod(xxhash64(sig), blocks)"))
    units = """concat(
        transform(sequence(0L, blocks - 1), j -> struct(xxhash64(component, band, 0, least(own, j), greatest(own, j)) AS unit, IF(own = j, 2, IF(own < j, 0, 1)) AS side)),
        transform(filter(sequence(0L, up), j -> j < up), j -> struct(xxhash64(component, band, 1, own, j) AS unit, 0 AS side)),
        transform(filter(sequence(0L, down), j -> j < down), j -> struct(xxhash64(component, band - 1, 1, j, own) AS unit, 1 AS side)))"""
    split = split.select("sig", "n", "copies", F.explode(F.expr(units)).alias("x")).select("sig", "n", "copies", F.col("x.unit").alias("task"), "x.unit", "x.side")

    def one(table: pa.Table) -> pa.Table:
        sig, n, copies, unit, side = (table.column(c).to_numpy() for c in ("sig", "n", "copies", "unit", "side"))
        cells = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("cell")]
        links = np.zeros(len(sig), np.int64)
        order = np.lexsort((side, unit))
        edges = np.flatnonzero(np.concatenate([[True], unit[order][1:] != unit[order][:-1]]))
        for x in np.split(order, edges[1:]):
            a, b = x[side[x] != 1], x[side[x] != 0]
            if not len(a) or not len(b):
                continue
            alike = side[x[0]] == 2
            both = overlaps([cells[i] for i in a], None if alike else [cells[i] for i in b])
            fit = 100 * both >= percent * (n[a][:, None] + n[b] - both)
            if alike:
                np.fill_diagonal(fit, False)
            else:
                links[b] += copies[a] @ fit
            links[a] += fit @ copies[b]
        return pa.table({"sig": sig, "links": links})

    rows = whole.unionByName(split).join(tokens.select("sig", "cell"), "sig")
    found = apply_arrow(rows.groupBy("task"), one, "sig long, links long")
    return found.groupBy("sig").agg(F.sum("links").alias("links"))


def linked(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    return _found(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def counted(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every document; n_links is how many other rows it is linked with, exact copies included."""
    return _found(docs, words, percent, count=True).select("doc_id", "n_shingles", "component_id", "n_links")


def _found(docs: DataFrame, words: int, percent: int, count: bool = False) -> DataFrame:
    """Columns of ``counted``, n_links if asked for, with the hash of the text as key and the component, null where there is no set."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    slots = 1 << min(24, max(16, (plan_bytes(docs) // 128).bit_length()))
    summaries = scratch.table(_summaries(texts, words, slots), "summaries")
    nodes = summaries.where("part is null").select("doc_id", "key", "n", "sig")
    one = summaries.where("part is null and n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.coalesce(F.min("doc_id"), F.min("key")).alias("row"), F.any_value("n").alias("n"), F.any_value("cell").alias("cell"), F.count("*").alias("copies"))
    reps = scratch.table(one, "reps")
    levels = spark.sparkContext.broadcast(_levels(summaries, slots))  # one byte for each slot: 16 MB at most
    postings = scratch.table(_postings(texts, words, percent, levels, shards(docs, PER_SHARD)), "postings")
    levels.destroy()  # read only by the plan that has just been written
    # What several plans read is written: as a part of each plan, it would be planned, compiled and run in each.
    met = scratch.table(postings.groupBy("sig").agg(F.any_value("n").alias("n"), F.count("*").alias("degree")), "met")

    # Each set votes for the set it meets most often among those that lead its tokens: the ones with most shared tokens.
    lead = postings.join(met.select("sig", "degree"), "sig").groupBy("token").agg(F.max(F.struct("degree", "sig", "n")).alias("lead")).select("token", F.col("lead.sig").alias("pivot"), F.col("lead.n").alias("pivot_n"))
    votes = postings.join(lead, "token").where(f"sig <> pivot AND 100 * least(n, pivot_n) >= {percent} * greatest(n, pivot_n)").groupBy("sig", "pivot").count()
    first = votes.groupBy("sig").agg(F.max(F.struct("count", "pivot")).alias("best")).selectExpr("sig AS a", "best.pivot AS b")
    first = scratch.table(_possible(first, reps, reps, percent), "first")
    wanted = scratch.table(reps.join(_ends(first), "sig", "left_semi").select("row", "sig"), "wanted")
    tokens = scratch.table(_sets_of(texts, wanted, words), "tokens")
    links = scratch.table(_similar(first, tokens, percent), "links")
    similar = scratch.table(components(scratch, links, "similar"), "components")

    member = met.select("sig", "n").join(similar.withColumnRenamed("node", "sig"), "sig", "left").join(first.selectExpr("a AS sig", "b AS pivot"), "sig", "left")
    member = scratch.table(member.select("sig", "n", F.coalesce("component", "sig").alias("component"), F.coalesce("pivot", "sig").alias("cluster")), "clustered")
    # Only large components and clusters need their sizes; the others count as 1. There are few, so no member is dealt by a hot one.
    large = lambda key, size: _few(scratch.table(member.groupBy(key).agg(F.count("*").alias(size)).where(F.col(size) > GROUP), f"large-{key}"))
    group = F.xxhash64("cluster", F.pmod(F.xxhash64("sig"), F.ceil(F.coalesce("cluster_size", F.lit(1)) / GROUP)))
    member = member.join(large("component", "size"), "component", "left").join(large("cluster", "cluster_size"), "cluster", "left")
    member = scratch.table(member.select("sig", "n", "component", F.coalesce("size", F.lit(1)).alias("size"), group.alias("group")), "grouped")
    members_of = scratch.table(member.groupBy("group").agg(F.count("*").alias("members")), "groups")
    member = scratch.table(member.join(members_of, "group"), "members")

    held = postings.select("token", "sig").join(member, "sig")
    mixed = held.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    held = scratch.table(held.join(mixed, "token", "left_semi"), "mixed")
    # Of two sets, the one in the smaller component asks for the group of the other.
    groups = held.groupBy("token", "group").agg(F.max(F.struct("size", "component")).alias("top"), F.min("n").alias("least"), F.max("n").alias("most"))
    asked = held.select("token", F.col("sig").alias("a"), F.col("n").alias("own"), F.struct("size", "component").alias("from"))
    fits = f"100 * own >= {percent} * least AND 100 * most >= {percent} * own"
    pairs = asked.join(groups, "token").where(f"from < top AND {fits}")
    pairs = scratch.table(pairs.select("a", F.col("group").alias("b")).distinct(), "asked")

    def union(table: pa.Table) -> pa.Table:
        maps = [np.frombuffer(v, np.uint64) for v in table.column("cell").to_pylist()]
        least = min(map(len, maps))
        every = np.bitwise_or.reduce([folded(m, least) for m in maps])
        return pa.table({"sig": table.column("group")[:1], "n": pa.array([min(table.column("n").to_pylist())], pa.int64()), "cell": pa.array([every.tobytes()], pa.binary())})

    asked_for = member.join(pairs.select(F.col("b").alias("group")).distinct(), "group", "left_semi").select("group", "sig", "members")
    columns = asked_for.join(reps.select("sig", "n", "cell"), "sig")
    alone = columns.where("members = 1").select(F.col("group").alias("sig"), "n", "cell")  # its own union
    matrix = apply_arrow(columns.where("members > 1").select("group", "n", "cell").groupBy("group"), union, "sig long, n long, cell binary").unionByName(alone)
    matrix = scratch.table(matrix, "matrix")
    whole = scratch.table(_possible(pairs, reps, matrix, percent).withColumnRenamed("b", "group").join(members_of, "group"), "opened")
    # A group of one is compared directly; a larger one is opened in one task for some of the sets that ask for it.
    single = scratch.table(whole.where("members = 1").join(member.select("group", F.col("sig").alias("b")), "group").select("a", "b"), "single")
    asks = whole.where("members > 1").select("group", "a")
    parts = _few(scratch.table(asks.groupBy("group").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts")).where("parts > 1"), "parts"))
    members = scratch.table(member.join(asks.select("group").distinct(), "group", "left_semi").select("group", "sig"), "asked-members")
    ends = _ends(single).unionByName(asks.select(F.col("a").alias("sig"))).unionByName(members.select("sig")).distinct()
    rest = ends.join(tokens.select("sig"), "sig", "left_anti")
    wanted = scratch.table(reps.join(rest, "sig", "left_semi").select("row", "sig"), "also-wanted")
    tokens = scratch.table(tokens.unionByName(_sets_of(texts, wanted, words)), "all-tokens")
    more = scratch.table(_similar(single, tokens, percent).unionByName(_opened(asks, parts, members, member.select("sig", "component"), tokens, percent)), "more")

    # The new links join whole components: theirs is a small graph of its own.
    label = lambda c: similar.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    between = more.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("a_component", "a").alias("a"), F.coalesce("b_component", "b").alias("b"))
    joined = scratch.table(components(scratch, between, "linked").withColumnRenamed("component", "joined"), "joined")
    apart = joined.join(similar, "node", "left_anti").select("node", F.col("joined").alias("component"))
    again = similar.join(joined.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("joined", "component").alias("component"))
    all_ = scratch.table(again.unionByName(apart).withColumnRenamed("node", "sig"), "all-components")
    named = reps.select("sig", "doc_id", "copies").join(all_, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "component").select("sig", "component", "component_id", "copies")
    component_id = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    columns = ["doc_id", F.col("n").alias("n_shingles"), component_id, "key", "component"]
    if count:
        counts = _counts(scratch, all_.join(reps.select("sig", "n", "copies"), "sig"), tokens, percent)
        named = named.join(scratch.table(counts, "counts"), "sig", "left")
        columns.append(F.when(F.col("n") > 0, F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(0).alias("n_links"))
    return nodes.join(named, "sig", "left").select(*columns)


def representatives(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that are the least doc_id of their component; of repeated rows one stays.

    Where a doc_id has several texts, one row for each component stays, and each text without words. Rows with a null doc_id stay.
    """
    found = _found(docs, words, percent).where("doc_id IS NOT NULL")
    found = Scratch(docs.sparkSession, "near-duplicates").table(found, "components")
    inner = {c: f"column_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    rows = docs.withColumnsRenamed(inner)
    kept = rows.where("doc_id IS NOT NULL")
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        others = Scratch(docs.sparkSession, "others").table(found.where("doc_id <> component_id").select(F.col("doc_id").alias("other_id")), "ids")
        kept = kept.join(_few(others), F.col("doc_id") == F.col("other_id"), "left_anti")
    else:  # a row is known by its doc_id and text
        first = found.where("component IS NOT NULL AND doc_id = component_id").groupBy("component").agg(F.min("doc_id").alias("own_id"), F.min("key").alias("own_key"))
        stay = first.select("own_id", "own_key").unionByName(found.where("component IS NULL").selectExpr("doc_id AS own_id", "key AS own_key"))
        kept = kept.withColumn("same", F.xxhash64(F.col("text").cast("string")))
        kept = kept.join(stay, (F.col("doc_id") == F.col("own_id")) & (F.col("same") == F.col("own_key")), "left_semi")
        kept = kept.dropDuplicates(["doc_id", "same"]).drop("same")
    kept = kept.unionByName(rows.where("doc_id IS NULL"))
    return kept.withColumnsRenamed({v: k for k, v in inner.items()}).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return counted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), words=4, percent=85)
