"""Pair similarities: set and number features as column expressions, fuzzy ratios in one Arrow function.

The functions of one pair state what is computed; those of many pairs compute it, a batch in each numpy operation.

Fuzzy ratios are on a scale of 0 to 100. ``ratio`` is the share of characters in a longest common subsequence; two empty
texts have 100. ``token_set`` compares common and differing words, an empty side has 0; ``token_sort`` compares sorted
words; ``partial`` takes the best window of the shorter text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .text import first_number, words


def common_length(a: str, b: str) -> int:
    """Length of a longest common subsequence, by one machine word or more of bits for each character of ``b``."""
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    mask = (1 << len(a)) - 1
    open_ = mask
    for ch in b:
        hit = open_ & places.get(ch, 0)
        open_ = (open_ + hit | open_ - hit) & mask
    return len(a) - open_.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * common_length(a, b) / total if total else 100.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    left, right = (" ".join(filter(None, (both, " ".join(sorted(z))))) for z in (x - y, y - x))
    best = ratio(left, right)
    return max(best, ratio(both, left), ratio(both, right)) if both else best


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of the longer one; windows at the edges may be shorter."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    if len(a) > len(b):
        a, b = b, a
    n, letters = len(a), set(a)
    best = max(_best_window(a, b, n, letters), _best_window(b, a, n, set(b)) if len(a) == len(b) else 0.0)
    return best


def _best_window(a: str, b: str, n: int, letters: set[str]) -> float:
    best = 0.0
    for end in range(1, len(b) + n):
        window = b[max(0, end - n) : end]
        edge = window[-1] if end <= len(b) else window[0]
        if edge in letters:
            best = max(best, ratio(a, window))
            if best == 100:
                break
    return best


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity with a bonus for up to four equal first characters; two empty texts have 1."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, matched = [True] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == ch:
                free[j] = False
                matched.append(ch)
                break
    m = len(matched)
    if not m:
        return 0.0
    other = [ch for ch, unused in zip(b, free) if not unused]
    swapped = sum(x != y for x, y in zip(matched, other)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(len(a), len(b), 4))
    return jaro + same * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


#: Pairs that are compared at once, and the longest shorter text of a batch: one machine word of bits.
BATCH, WORD = 4096, 64


def _codes(texts: list[str], wide: int, pad: int) -> np.ndarray:
    """Code points of texts, a row each, padded to ``wide``."""
    out = np.full((len(texts), wide), pad, np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.arange(wide) < lengths[:, None]] = flat
    return out


def common_lengths(pairs: list[tuple[str, str]]) -> np.ndarray:
    """``common_length`` of many pairs: the same steps, for a batch of pairs in each numpy operation."""
    out = np.zeros(len(pairs), np.int64)
    ordered = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    short = [i for i, (a, _) in enumerate(ordered) if 0 < len(a) <= WORD]
    for i, (a, b) in enumerate(ordered):
        if len(a) > WORD:
            out[i] = common_length(a, b)
    short.sort(key=lambda i: (len(ordered[i][1]), len(ordered[i][0])))
    for at in range(0, len(short), BATCH):
        part = short[at : at + BATCH]
        left, right = [ordered[i][0] for i in part], [ordered[i][1] for i in part]
        x, y = _codes(left, WORD, 0xFFFFFFFF), _codes(right, max(map(len, right)), 0xFFFFFFFE)
        size = np.fromiter(map(len, left), np.uint64, len(left))
        mask = ~np.uint64(0) >> (np.uint64(64) - size)
        open_ = mask.copy()
        for j in range(y.shape[1]):
            hit = open_ & np.packbits(x == y[:, j, None], axis=1, bitorder="little").view("<u8")[:, 0]
            open_ = (open_ + hit | open_ - hit) & mask
        out[part] = size.astype(np.int64) - np.bitwise_count(open_)
    return out


def ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    total = np.array([len(a) + len(b) for a, b in pairs], float)
    return np.where(total > 0, 200.0 * common_lengths(pairs) / np.maximum(total, 1), 100.0)


def token_sorts(pairs: list[tuple[str, str]]) -> np.ndarray:
    return ratios([(" ".join(sorted(a.split())), " ".join(sorted(b.split()))) for a, b in pairs])


def token_sets(pairs: list[tuple[str, str]]) -> np.ndarray:
    out, asked, owner = np.zeros(len(pairs)), [], []
    for i, (a, b) in enumerate(pairs):
        x, y = set(a.split()), set(b.split())
        if not x or not y:
            continue
        both = " ".join(sorted(x & y))
        if both and (x <= y or y <= x):
            out[i] = 100.0
            continue
        left, right = (" ".join(filter(None, (both, " ".join(sorted(z))))) for z in (x - y, y - x))
        more = [(left, right), (both, left), (both, right)] if both else [(left, right)]
        asked += more
        owner += [i] * len(more)
    np.maximum.at(out, np.array(owner, np.int64), ratios(asked))
    return out


def partials(pairs: list[tuple[str, str]]) -> np.ndarray:
    """``partial`` of many pairs, their windows as pairs of their own."""
    out, asked, owner = np.zeros(len(pairs)), [], []
    for i, (a, b) in enumerate(pairs):
        if not a or not b or a == b:
            out[i] = 100.0 if a == b else 0.0
            continue
        for x, y in ((a, b), (b, a))[len(a) > len(b) : 2 if len(a) == len(b) else 1 + (len(a) > len(b))]:
            if x in y:
                out[i] = 100.0
                break
            n, letters = len(x), set(x)
            windows = [y[max(0, end - n) : end] for end in range(1, len(y) + n)]
            some = [w for end, w in enumerate(windows, 1) if (w[-1] if end <= len(y) else w[0]) in letters]
            asked += [(x, w) for w in some]
            owner += [i] * len(some)
    for at in range(0, len(asked), 16 * BATCH):
        np.maximum.at(out, np.array(owner[at : at + 16 * BATCH], np.int64), ratios(asked[at : at + 16 * BATCH]))
    return out


def jaro_winklers(pairs: list[tuple[str, str]]) -> np.ndarray:
    """``jaro_winkler`` of many pairs, letter by letter of the first texts."""
    out = np.array([float(a == b) for a, b in pairs])
    some = sorted((i for i, (a, b) in enumerate(pairs) if a and b and a != b), key=lambda i: max(map(len, pairs[i])))
    for at in range(0, len(some), BATCH):
        part = some[at : at + BATCH]
        left, right = [pairs[i][0] for i in part], [pairs[i][1] for i in part]
        la, lb = (np.fromiter(map(len, t), np.int64, len(t)) for t in (left, right))
        x, y = _codes(left, int(la.max()), 0xFFFFFFFF), _codes(right, int(lb.max()), 0xFFFFFFFE)
        reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
        free, hits, place = np.ones(y.shape, bool), np.zeros(x.shape, bool), np.arange(y.shape[1])
        row = np.arange(len(part))
        for i in range(x.shape[1]):
            fit = free & (y == x[:, i, None]) & (np.abs(place - i) <= reach[:, None])
            first = fit.argmax(1)
            hits[:, i] = fit[row, first]
            free[row, first] &= ~hits[:, i]
        m = hits.sum(1)
        order = lambda codes, taken: np.take_along_axis(codes, np.argsort(~taken, axis=1, kind="stable"), 1)[:, : max(1, int(m.max()))]
        swapped = ((order(x, hits) != order(y, ~free)) & (np.arange(max(1, int(m.max()))) < m[:, None])).sum(1) // 2
        jaro = (m / la + m / lb + (m - swapped) / np.maximum(m, 1)) / 3
        head = min(4, x.shape[1], y.shape[1])
        same = np.cumprod(x[:, :head] == y[:, :head], axis=1).sum(1)
        out[part] = np.where(m == 0, 0.0, np.where(jaro > 0.7, jaro + same * 0.1 * (1 - jaro), jaro))
    return out


FUZZY = ("n_ratio", "n_tset", "n_tsort", "n_partial", "n_full_ratio", "n_full_tset", "n_alias_best", "n_nospace_jw", "n_skel_ratio", "a_ratio", "a_tset", "a_tsort", "a_words_tset", "a_partial")
_INPUTS = ("n_core", "n_full", "n_alias", "n_nospace", "n_skel", "a_norm", "a_words")
#: Of each feature: the record column, the function of many pairs, and its value where a side is empty (None: as the function has it).
_KINDS = {
    "n_ratio": ("n_core", ratios, None), "n_tset": ("n_core", token_sets, None), "n_tsort": ("n_core", token_sorts, None), "n_partial": ("n_core", partials, 0.0),
    "n_full_ratio": ("n_full", ratios, None), "n_full_tset": ("n_full", token_sets, None), "n_alias_best": ("n_alias", token_sets, None), "n_nospace_jw": ("n_nospace", jaro_winklers, None),
    "n_skel_ratio": ("n_skel", ratios, None), "a_ratio": ("a_norm", ratios, -1.0), "a_tset": ("a_norm", token_sets, -1.0), "a_tsort": ("a_norm", token_sorts, -1.0),
    "a_words_tset": ("a_words", token_sets, -1.0), "a_partial": ("a_norm", partials, -1.0),
}


def fuzzy_columns(q: dict[str, list[str]], s: dict[str, list[str]], features: tuple[str, ...] = FUZZY) -> dict[str, np.ndarray]:
    """The fuzzy features of rows of pairs; aliases and space-less names by ``|``. Each different pair of texts is compared once."""
    out, coded = {}, {}
    for feature in features:
        column, compare, empty = _KINDS[feature]
        if column not in coded:
            number: dict[tuple[str, str], int] = {}
            coded[column] = np.fromiter((number.setdefault(p, len(number)) for p in zip(q[column], s[column])), np.int64, len(q[column])), list(number)
        codes, pairs = coded[column]
        if column in ("n_alias", "n_nospace"):  # the best of all values of either side
            each = [(i, (x, y)) for i, (a, b) in enumerate(pairs) for x in a.split("|") for y in b.split("|")]
            found = np.full(len(pairs), -np.inf)
            np.maximum.at(found, np.array([i for i, _ in each], np.int64), compare([p for _, p in each]))
        else:
            found = compare(pairs)
            if empty is not None:
                found = np.where([not (a and b) for a, b in pairs], empty, found)
        out[feature] = found[codes] if len(codes) else np.zeros(0)
    if "a_words_tset" in out and "a_norm" in q:  # an empty address has no words to compare
        out["a_words_tset"] = np.where([not (a and b) for a, b in zip(q["a_norm"], s["a_norm"])], -1.0, out["a_words_tset"])
    return out


def _fuzzy(features: tuple[str, ...]):
    columns = _columns_of(features)

    @F.pandas_udf(StructType([StructField(f, DoubleType()) for f in features]))
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        n = len(columns)
        for batch in parts:
            texts = [c.tolist() for c in batch]
            yield pd.DataFrame(fuzzy_columns(dict(zip(columns, texts[:n])), dict(zip(columns, texts[n:])), features), columns=features, dtype=float)

    return run


def _columns_of(features: tuple[str, ...]) -> list[str]:
    used = {_KINDS[f][0] for f in features} | ({"a_norm"} if "a_words_tset" in features else set())
    return [c for c in _INPUTS if c in used]


def fuzzy(q: str = "q_", s: str = "s_", features: tuple[str, ...] = FUZZY) -> Column:
    """A struct of fuzzy features of a pair whose record columns have these prefixes; only the columns they need go to Python."""
    text = lambda c: F.concat_ws("|" if c.rpartition("_")[2] in ("alias", "nospace") else " ", F.col(c))
    return _fuzzy(tuple(features))(*(text(p + c) for p in (q, s) for c in _columns_of(features)))


def jaccard(a: Column, b: Column, empty: float = -1.0) -> Column:
    """Of two arrays as sets; ``empty`` if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(empty)).otherwise(both / F.size(F.array_union(a, b)))


def cover(a: Column, b: Column) -> Column:
    """Share of the set ``a`` that is in ``b``; -1 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(-1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(a)))


def _flag(condition: Column) -> Column:
    return F.coalesce(condition.cast("double"), F.lit(0.0))


def initials(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.left(t, F.lit(1))), "")


def name_features(q: str = "q_", s: str = "s_") -> dict[str, Column]:
    a, b = words(F.col(f"{q}n_core")), words(F.col(f"{s}n_core"))
    one = lambda x, y: (F.size(x) == 1) & (F.size(y) >= 2) & (F.get(x, F.lit(0)) == initials(y))
    return {
        "n_jacc": jaccard(a, b),
        "n_first_eq": _flag(F.get(a, F.lit(0)) == F.get(b, F.lit(0))),
        "n_len_q": F.length(f"{q}n_core").cast("double"),
        "n_len_s": F.length(f"{s}n_core").cast("double"),
        "acro": _flag(one(a, b) | one(b, a)),
    }


def number_features(q: str = "q_", s: str = "s_") -> dict[str, Column]:
    a, b = F.col(f"{q}a_nums"), F.col(f"{s}a_nums")
    x, y = first_number(a), first_number(b)
    both = (F.size(a) > 0) & (F.size(b) > 0)
    known = lambda c: F.when(both, c.cast("double")).otherwise(F.lit(-1.0))
    return {
        "num_first_eq": known(x == y),
        "num_first_suffix": known((x != y) & (x.endswith(y) | y.endswith(x))),
        "num_jacc": jaccard(a, b),
        "num_any": known(F.arrays_overlap(a, b)),
        "num_first_in": known(F.array_contains(b, x)),
        "num_q_n": F.size(a).cast("double"),
        "num_s_n": F.size(b).cast("double"),
    }


def address_features(q: str = "q_", s: str = "s_") -> dict[str, Column]:
    a, b = F.col(f"{q}a_words"), F.col(f"{s}a_words")
    empty = (F.col(f"{q}a_norm") == "") | (F.col(f"{s}a_norm") == "")
    return {
        "a_words_jacc": F.when(empty, F.lit(-1.0)).otherwise(jaccard(a, b)),
        "a_words_cover_q": cover(a, b),
        "a_words_cover_s": cover(b, a),
        "a_empty_q": _flag(F.col(f"{q}a_norm") == ""),
        "a_empty_s": _flag(F.col(f"{s}a_norm") == ""),
    }


def flag_features(q: str = "q_", s: str = "s_") -> dict[str, Column]:
    return {"q_web": F.col(f"{q}is_web"), "s_web": F.col(f"{s}is_web"), "q_alias": F.col(f"{q}has_alias"), "s_alias": F.col(f"{s}has_alias")}


def address_rerank(cosine: Column, q: str = "q_", s: str = "s_") -> Column:
    """Cosine plus half the overlap of numbers and of words; empty sides count 0."""
    return cosine + 0.5 * jaccard(F.col(f"{q}a_nums"), F.col(f"{s}a_nums"), 0.0) + 0.5 * jaccard(F.col(f"{q}a_words"), F.col(f"{s}a_words"), 0.0)


def edit_kind(a: Column, b: Column, substrings: bool = True) -> Column:
    """How two house numbers differ; numbers of one length are compared by their first 15 digits."""
    gap = F.abs(F.left(a, F.lit(15)).cast("bigint") - F.left(b, F.lit(15)).cast("bigint"))
    same_length = F.length(a) == F.length(b)
    kind = (
        F.when((a == "") | (b == ""), "missing-num").when(a == b, "equal")
        .when(same_length & (gap <= 2), "same-len d<=2").when(same_length & (gap <= 50), "same-len d3-50").when(same_length, "same-len d>50")
        .when(a.startswith(b) | b.startswith(a), "prefix").when(a.endswith(b) | b.endswith(a), "suffix")
    )
    if substrings:
        kind = kind.when(a.contains(b) | b.contains(a), "substring")
    return kind.otherwise("other")


def miss_category(name: Column, address: Column) -> Column:
    """Why a true pair was missed, by its name and address similarity."""
    near = address >= 70
    return F.when((name >= 80) & near, "both near").when(name >= 80, "address differs").when(near, "name differs").otherwise("both differ")
