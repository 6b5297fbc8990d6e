import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from linkweave.llm import packing


def bins_piece_by_piece(counts, capacity):
    """Best-fit decreasing, one piece at a time, with the same tree over every open bin's remaining capacity."""
    tree, open_, bins = packing.OpenBins(capacity), {}, 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            room = tree.tightest(length)
            assert room == min((r for r, n in open_.items() if n and r >= length), default=None)
            if room is None:
                bins, room = bins + 1, capacity
            else:
                open_[room] -= 1
                tree.mark(room, open_[room] > 0)
            rest = room - length
            if rest:
                open_[rest] = open_.get(rest, 0) + 1
                tree.mark(rest, True)
    return bins


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 50, 100])
    counts = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(1, 30))}
    rows = packing.plan(counts, capacity)
    assert max(first + -(-n // per) for _, _, n, first, per, _ in rows) == bins_piece_by_piece(counts, capacity)
    held, ranks = {}, {}
    for length, rank, n, first, per, offset in rows:
        assert ranks.get(length, 0) == rank
        ranks[length] = rank + n
        for i in range(n):
            held.setdefault(first + i // per, []).append((offset + i % per * length, length))
    assert ranks == counts
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def check(df, rows, capacity):
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc, text in rows:
        ids = np.array(exact.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        n = len(ids)
        starts = [0, *range(n % capacity or capacity, n, capacity)]
        want += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(starts, [*starts[1:], n]))]
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    at = {}
    for r in sorted(df, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= capacity
    counts = {}
    for r in df:
        counts[r["length"]] = counts.get(r["length"], 0) + 1
    assert len(at) == bins_piece_by_piece(counts, capacity)


def test_odd_documents(odd, odd_rows):
    check(packing.pack(odd, capacity=256).collect(), odd_rows, 256)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(packing.query(spark, sf).collect(), docs, 2048)


@pytest.mark.parametrize("text", [" " * 1_000_000 + "x", "\n" * 1_000_000, "a" + " \n\t\r" * 250_000 + " b", "a" + "\u3000\x85 " * 5000 + "\x1c", "x " + " " * 5000 + "'s" + "\n" * 5000, "  a   b \n" * 500 + " " * 4097])
def test_long_white_space(text):
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids


def test_special_strings_and_empty_table(none):
    assert packing.encode("a<|endoftext|>b").tolist() == [64, 50256, 65]
    assert packing.pack(none).count() == 0
