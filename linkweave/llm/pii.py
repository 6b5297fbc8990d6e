"""Personal data by fixed patterns and by a semi-Markov conditional random field over whole spans.

The patterns find emails, addresses of the internet protocol, payment cards and phone numbers; what they
find stays. Around digits and at-signs the random field then segments the tokens: every candidate
segment of bounded length is scored as a whole, by features of its full text and of what stands beside it, and a
semi-Markov dynamic program chooses boundaries and types jointly. Its segments are added where they touch
no span of a pattern: phone numbers without a plus sign, and secrets, which the patterns lack. The weights are
fitted here, by gradient ascent on the conditional likelihood of generated sentences.

Defined results: null and empty texts have no spans; positions are code points, ends exclusive; texts of
any length are read whole, in time linear in their length; an entity that the field adds has at most 16 tokens and 4 runs of blanks; repeated texts give the same spans; empty tables give
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import map_arrow

BASE = ("email", "ip", "card", "phone")
TYPES = (*BASE, "secret")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"
#: Tokens in an entity, and code points read on either side of a digit or an at-sign.
LONGEST, AROUND = 16, 40
#: Runs of blanks in an entity: a grouped card number has three or four.
SPACES = 4

_TRIGGER = re.compile("[0-9@]")
_AT = re.compile(r"(?<=[\[(])at(?=[\])])")
#: Where the random field reads: also 'at' in brackets, and 20 letters that are set to a keyword.
_NEAR = re.compile(r"[0-9@]|(?<=[\[(])at(?=[\])])|(?i:(?:token|secret|passw(?:or)?d|key)[ \t]{0,4}[=:\"'][ \t=:\"']{0,12})(?=[A-Za-z]{20})")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]|[^\S\n]+|\n")
_LETTER, _REST = re.compile("[A-Za-z0-9]").match, re.compile("[A-Za-z0-9]*")
_KEYWORD = re.compile(r"(?:token|secret|passw(?:or)?d|api[_ -]?key|key)$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each pattern that pass its test; by kind, then start."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL_END.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _CHAIN.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                found.append(("ip", at, end))
            at = end + 1
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


FEATURES = [
    *(f"{t}:{f}" for t in TYPES for f in ("bias", "well formed", "ill formed", "open left", "open right", "keyword")),
    *(f"{t}:digits {b}" for t in TYPES for b in ("0", "1-3", "4-8", "9-12", "13-19", "20+")),
    *(f"{t}:{f}" for t in TYPES for f in ("has space", "has letters", "one token")),
    "outside:bias", "outside:digit", "outside:at",
]
INDEX = {f: i for i, f in enumerate(FEATURES)}


def _well_formed(span: str) -> tuple[bool, ...]:
    """For each type, whether the whole span has its form."""
    digits = _digits(span)
    return (
        bool(re.fullmatch(r"[\w.%+-]+(?:@|\s?[\[(]at[\])]\s?)[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", span)),
        bool(re.fullmatch(r"(\d{1,3})(\.\d{1,3}){3}", span)) and all(int(x) < 256 for x in span.split(".")),
        13 <= len(digits) <= 19 and bool(re.fullmatch(r"[0-9]+([ -][0-9]+)*", span)) and luhn(digits),
        bool(re.fullmatch(r"(\+\d{1,3}[ .-]?)?(\(\d{2,4}\) ?|\d{2,4}[ -])\d{3,4}[ -]\d{3,4}|\+\d[\d ().-]{7,}\d", span)),
        bool(re.fullmatch(r"[A-Za-z0-9]{20,}", span)) and not span.isdigit(),
    )


@lru_cache(maxsize=50_000)
def span_features(span: str, left: bool, right: bool, keyword: bool) -> tuple[tuple[int, ...], ...]:
    """For each type the features that hold; left and right: whether a letter or digit goes on there."""
    n = len(_digits(span))
    bucket = "0" if n == 0 else "1-3" if n < 4 else "4-8" if n < 9 else "9-12" if n < 13 else "13-19" if n < 20 else "20+"
    forms = _well_formed(span)
    shared = [f"digits {bucket}", *(["open left"] * left), *(["open right"] * right), *(["keyword"] * keyword)]
    shared += ["has space"] * bool(re.search(r"\s", span)) + ["has letters"] * bool(re.search("[A-Za-z]", span)) + ["one token"] * span.isalnum()
    return tuple(tuple(INDEX[f"{t}:{f}"] for f in ("bias", "well formed" if ok else "ill formed", *shared)) for t, ok in zip(TYPES, forms))


def candidates(text: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[int, int, tuple]]:
    """Segments (first token, end, features) that may be an entity: of at most ``LONGEST`` tokens and ``SPACES`` runs of blanks in one line, with a digit or an at-sign, or one long word after a keyword."""
    for i, (start, _) in enumerate(tokens):
        head = text[start]
        if not (head.isalnum() or head in "+("):
            continue
        spaces, useful = 0, False
        for j in range(i, min(len(tokens), i + LONGEST)):
            a, b = tokens[j]
            piece = text[a:b]
            if piece == "\n":
                break
            if piece.isspace():
                spaces += 1
                if spaces > SPACES:
                    break
                continue
            useful = useful or bool(_TRIGGER.search(piece)) or bool(piece == "at" and _AT.match(text, a))
            long = j == i and b - a >= 20 and piece.isalpha()
            if (useful or long) and piece.isalnum():
                before = text[max(0, start - 24) : start]
                keyword = bool(_KEYWORD.search(before.rstrip(" \t=:\"'")))
                if not useful and not (keyword and before[len(before.rstrip(" \t=:\"'")) :].strip()):
                    continue
                yield i, j + 1, span_features(text[start:b], start > 0 and text[start - 1].isalnum(), b < len(text) and text[b].isalnum(), keyword)


def _outside(text: str, token: tuple[int, int]) -> tuple[int, ...]:
    piece = text[token[0] : token[1]]
    return (INDEX["outside:bias"], *([INDEX["outside:digit"]] * bool(re.search("[0-9]", piece))), *([INDEX["outside:at"]] * (piece == "@")))


def segment(text: str, tokens: list[tuple[int, int]], weights: list[float]) -> list[tuple[str, int, int]]:
    """The best segmentation (semi-Markov Viterbi): entities as (type, start, end)."""
    n, by_end = len(tokens), {}
    for i, j, features in candidates(text, tokens):
        best, kind = max((sum([weights[f] for f in fs]), t) for t, fs in zip(TYPES, features))
        by_end.setdefault(j, []).append((i, best, kind))
    score, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        score[j] = score[j - 1] + sum([weights[f] for f in _outside(text, tokens[j - 1])])
        for i, s, kind in by_end.get(j, ()):
            if score[i] + s > score[j]:
                score[j], back[j] = score[i] + s, (i, kind)
    out, j = [], n
    while j > 0:
        if back[j]:
            i, kind = back[j]
            out.append((kind, tokens[i][0], tokens[j - 1][1]))
            j = i
        else:
            j -= 1
    return out[::-1]


def windows(text: str) -> Iterator[list[tuple[int, int]]]:
    """Tokens of each stretch around digits, at-signs, 'at' in brackets and long words after a keyword; whole tokens at its edges."""
    start, stop = None, -1
    for m in _NEAR.finditer(text):
        if start is not None and m.start() - AROUND <= stop:
            stop = max(stop, _word_end(text, m.end() + AROUND))
            continue
        if start is not None:
            yield [t.span() for t in _TOKEN.finditer(text, start, stop)]
        start, stop = _word_begin(text, m.start() - AROUND, stop), _word_end(text, m.end() + AROUND)
    if start is not None:
        yield [t.span() for t in _TOKEN.finditer(text, start, stop)]


def _word_begin(text: str, at: int, least: int) -> int:
    """Where the token around ``at`` begins; ``least`` is the end of a token, so each token is walked over once."""
    at = max(0, at)
    while at > max(0, least) and _LETTER(text, at) and _LETTER(text, at - 1):
        at -= 1
    return at


def _word_end(text: str, at: int) -> int:
    if 0 < at < len(text) and _LETTER(text, at - 1):
        return _REST.match(text, at).end()
    return min(at, len(text))


def generated(n: int, seed: int) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences with entities at known places, and with numbers that are none."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(("th", "er", "an", "on", "le", "es", "in", "ou", "tion", "de", "re", "st")) for _ in range(rng.randint(1, 4)))

    def card():
        body = digits(rng.choice((12, 14, 15)))
        body += next(str(c) for c in range(10) if luhn(body + str(c)))
        return " ".join(body[i : i + 4] for i in range(0, len(body), 4)) if rng.random() < 0.3 else body

    make = {
        "email": lambda: f"{word()}{rng.choice(('.', '_', ''))}{rng.choice((digits(2), word()))}@{word()}{rng.choice(('', digits(1)))}.{word()}.{rng.choice(('com', 'org', 'net'))}",
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: rng.choice((f"+{rng.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(11)}")),
        "secret": lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((32, 40)))),
    }
    plain = (lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 9)}", lambda: str(rng.randint(0, 2100)), lambda: f"{rng.randint(1990, 2030)}-{digits(2)}-{digits(2)}", lambda: f"{rng.randint(1, 900)},{digits(3)}.{digits(2)}", lambda: digits(rng.randint(5, 18)), lambda: f"{word()}{digits(2)}", lambda: f"@{word()}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", lambda: ".".join(str(rng.randint(256, 999)) for _ in range(4)), lambda: f"{word()} {digits(3)} {word()} {digits(4)}")
    for _ in range(n):
        text, spans = word(), []
        for _ in range(2):
            text += rng.choice((" ", ". ", ", ", "\n")) + word() + " "
            if rng.random() < 0.6:
                kind = rng.choice(TYPES)
                body = make[kind]()
                if kind == "secret":
                    text += rng.choice(('token = "', "api_key: ", "secret="))
                spans.append((kind, len(text), len(text) + len(body)))
                text += body + (rng.choice(('"', "")) if kind == "secret" else rng.choice(("", "!!", "%%%", ".", ",")))
            else:
                text += rng.choice(plain)()
            text += " " + word()
        yield text, spans


def spelled(n: int, seed: int) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences with addresses whose at-sign is a word in brackets, secrets of letters alone, and places that are neither."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("th", "er", "an", "on", "le", "es", "in", "ou", "tion", "de", "re", "st")) for _ in range(rng.randint(1, 4)))
    sign = lambda: rng.choice((" [at] ", "[at]", " (at) ", "(at)"))
    for _ in range(n):
        text = f"{word()} {word()} "
        kind = rng.choice(("email", "email", "secret", ""))
        if kind == "secret":
            text += rng.choice(('token = "', "api_key: ", "secret=", "password: "))
        start = len(text)
        if kind == "email":
            text += f"{word()}{rng.choice(('.', '_', ''))}{word()}{sign()}{word()}.{rng.choice(('', word() + '.'))}{rng.choice(('com', 'org', 'net'))}"
        elif kind == "secret":
            text += "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(rng.randint(20, 40)))
        else:
            text += f"{word()}{sign()}{word()}"
        yield text + rng.choice((" ", ", ", ". ")) + word(), [(kind, start, len(text))] if kind else []


@lru_cache(maxsize=1)
def fitted(sentences: int = 240, rounds: int = 60, seed: int = 11) -> tuple[float, ...]:
    """Weights that maximise the conditional likelihood of generated sentences, less a quadratic penalty."""
    data = []
    for text, spans in (*generated(sentences, seed), *spelled(sentences // 4, seed)):
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        at = {a: i for i, (a, _) in enumerate(tokens)}
        ends = {b: i + 1 for i, (_, b) in enumerate(tokens)}
        gold = {(at[a], ends[b]): TYPES.index(k) for k, a, b in spans if a in at and b in ends}
        arcs = [(j, j + 1, _outside(text, t), not any(a <= j < b for a, b in gold)) for j, t in enumerate(tokens)]
        for i, j, features in candidates(text, tokens):
            arcs += [(i, j, fs, gold.get((i, j)) == k) for k, fs in enumerate(features)]
        arcs.sort(key=lambda a: a[1])
        rows = np.zeros((len(arcs), len(FEATURES)), np.float32)
        for r, a in enumerate(arcs):
            rows[r, list(a[2])] = 1
        data.append((len(tokens), [a[0] for a in arcs], [a[1] for a in arcs], rows, rows[[a[3] for a in arcs]].sum(0)))
    w = np.zeros(len(FEATURES))
    seen = np.zeros(len(FEATURES)) + 1e-6
    for _ in range(rounds):
        gradient = -0.02 * w * sentences / 100
        for n, start, end, rows, gold in data:
            score = (rows @ w).tolist()
            ahead, behind = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
            for i, j, s in zip(start, end, score):
                ahead[j] = _add(ahead[j], ahead[i] + s)
            for i, j, s in zip(reversed(start), reversed(end), reversed(score)):
                behind[i] = _add(behind[i], behind[j] + s)
            total = ahead[n]
            chance = np.array([math.exp(ahead[i] + s + behind[j] - total) for i, j, s in zip(start, end, score)])
            gradient += gold - chance @ rows
        seen += gradient**2
        w += 0.5 * gradient / np.sqrt(seen)
        w[INDEX["outside:bias"]] = min(0, w[INDEX["outside:bias"]])
    return tuple(w.tolist())


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def find(text: str, weights: tuple[float, ...]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(spans of the patterns, all spans), by kind as listed and then by start."""
    if not text or not _NEAR.search(text):
        return [], []
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    added = []
    for tokens in windows(text):
        for kind, a, b in segment(text, tokens, weights):
            if all(b <= x or y <= a for x, y in _near(taken, a, b)):
                added.append((kind, a, b))
    return base, sorted(base + added, key=lambda s: (TYPES.index(s[0]), s[1], s[2]))


def _near(taken: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
    """Those of the sorted spans that can touch [a, b)."""
    import bisect

    to = bisect.bisect_left(taken, (b, 0))
    at = to
    while at > 0 and (taken[at - 1][1] > a or to - at < 4):
        at -= 1
    return taken[at:to]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, redact: bool = False) -> DataFrame:
    """Find spans in every whole text; with ``redact``, return the rows of ``docs`` with ``[KIND]`` in their place."""
    weights = fitted()
    if redact:
        names, schema = docs.columns, docs.schema
        cleaned = F.col("text").cast("string")

        def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index("text")
                texts = [masked(t, weights) for t in batch.column(at).to_pylist()]
                columns = [pa.array(texts, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        return map_arrow(docs.withColumn("text", cleaned).select(*names), rewrite, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in pc.fill_null(batch.column(1), ""):
                base, spans = find(text.as_py(), weights)
                n = [sum(s[0] == k for s in base) for k in BASE]
                out.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base), len(spans)))
            columns = list(zip(*out)) or [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], [x.split()[0] for x in SCHEMA.split(", ")])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)


def masked(text: str | None, weights: tuple[float, ...]) -> str | None:
    """The text with every span, or run of touching spans, as ``[KIND]`` of its first."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in find(text, weights)[1]):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def query(spark, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
