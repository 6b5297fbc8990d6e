"""SentencePiece BPE encoding and decoding through a table of each prefix's unique last token.

Every prefix of a string has exactly one last token in its byte-pair encoding: the token t that ends
there and whose pair with the last token of the prefix before t is compatible, which means that the
two, joined, are encoded as these two again. ``PrefixTable.encode`` finds the tokens that end at
each position with an automaton over the vocabulary, tests the pairs, keeps the one last token for
each prefix, and recovers the ids backwards from the end.

No piece of the vocabulary goes on past a space, so runs of spaces with the word after them are
encoded apart from each other and kept in a bounded table for each worker.

Defined results: null and empty texts have no tokens and decode to the empty text; repeated texts
repeat their rows; characters outside the vocabulary become byte tokens, whatever their number;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import map_arrow

SPACE = "▁"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Words with their tokens in each of a worker's two generations; others are encoded anew.
KEPT_WORDS = 300_000
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+$")


class PrefixTable:
    """Encoder and decoder for one SentencePiece BPE model with byte fallback."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {self.pieces[i]: model.get_score(i) for i in plain}
        self.id = {self.pieces[i]: i for i in plain}
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.value = {i: b for b, i in self.byte.items()}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id):
            raise ValueError("a piece goes on past a space: words can't be encoded apart")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id.items():
            if self.merged(piece) == [piece]:  # others never come out of the encoder
                self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.length = [len(p) for p in self.pieces]
        self.plain_from = 1 + max(self.value, default=-1) if all(i > max(self.value, default=-1) for i in plain) else n
        self.letters = {p for p in self.id if len(p) == 1}
        self.compatible: list[dict[int, bool]] = [{} for _ in self.pieces]
        self.n_pairs = 0
        self.words: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces by merging the best neighbours first, the leftmost among equals: for single tokens and pairs only."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Pair compatibility: the two tokens joined are encoded as these two."""
        a, b = self.pieces[left], self.pieces[right]
        found = self.merged(a + b) == [a, b]
        if self.n_pairs < 1_000_000:
            self.n_pairs += 1
            self.compatible[left][right] = found
        return found

    def encode(self, text: str) -> list[int]:
        """Ids of a string in which spaces are already marked."""
        n, pairs, length = len(text), self.compatible, self.length
        last = [-1] * (n + 1)  # -2: the prefix is empty or ends in a character outside the vocabulary
        last[0] = -2
        if not self.letters.issuperset(text):
            for i, ch in enumerate(text, 1):
                if ch not in self.letters:
                    last[i] = -2
        for end, token in self.automaton.iter(text):
            end += 1
            if last[end] == -1:
                before = last[end - length[token]]
                if before == -2:
                    last[end] = token
                elif before >= 0:
                    known = pairs[before].get(token)
                    if self.fits(before, token) if known is None else known:
                        last[end] = token
        ids, i = [], n
        while i > 0:  # backwards: each prefix names its own last token
            token = last[i]
            if token >= 0:
                ids.append(token)
                i -= length[token]
            else:
                i -= 1
                ids += [self.byte[b] for b in reversed(text[i].encode())]
        ids.reverse()
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``, with spaces still marked only by their first sign; bytes are joined to characters."""
        if ids and min(ids) >= self.plain_from:
            return "".join([self.pieces[i] for i in ids]).replace(SPACE, " ")
        out, held = [], bytearray()
        for i in ids:
            if i in self.value:
                held.append(self.value[i])
                continue
            if held:
                out.append(_characters(held))
                held = bytearray()
            out.append(self.pieces[i])
        if held:
            out.append(_characters(held))
        return "".join(out).replace(SPACE, " ")

    def word(self, chunk: str) -> tuple[str, str]:
        """(ids as text, decoded text) of a run of spaces and a word."""
        found = self.older.get(chunk)
        if found is None:
            ids = self.encode(chunk)
            found = (",".join(map(str, ids)), self.decode(ids))
        if len(chunk) <= 48:
            if len(self.words) >= KEPT_WORDS:  # words not met again since the last turn go
                self.older, self.words = self.words, {}
            self.words[chunk] = found
        return found

    def both(self, text: str) -> tuple[str, int, str]:
        """(ids as text, number of ids, decoded text) of a whole text."""
        if not text:
            return "", 0, ""
        chunks = _CHUNK.findall(SPACE + text.replace(" ", SPACE))
        found = list(map(self.words.get, chunks))
        found = [f or self.word(c) for f, c in zip(found, chunks)]
        ids = ",".join([f[0] for f in found])
        return ids, ids.count(",") + 1, "".join([f[1] for f in found])[1:]


def _characters(held: bytearray) -> str:
    return held.decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def table(model_file: str) -> PrefixTable:
    return PrefixTable(model_file)


def encode_decode(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """Encode every whole text, decode its ids, and return the digests of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = table(public_tokenizers.path(model))
        for batch in batches:
            n_tokens, ids_sha, text_sha = [], [], []
            for text in pc.fill_null(batch.column(1), ""):
                ids, n, back = coder.both(text.as_py())
                n_tokens.append(n)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
