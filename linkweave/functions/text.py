"""Normalisation of names and addresses as column expressions.

Everything stays in the JVM for Latin scripts; ``exotic`` adds the Arrow functions for other scripts.
Views of several values are arrays; ``delimited`` renders them as text.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed, translit


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """Letters up to U+024F and U+1E00 to U+1EFF whose decomposition is one letter with marks, and those letters."""
    pairs = []
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = translit.strip_accents_text(chr(c))
        if len(plain) == 1 and plain != chr(c):
            pairs.append((chr(c), plain))
    marks = [chr(c) for c in range(0x300, 0x370) if unicodedata.combining(chr(c))]
    return "".join(a for a, _ in pairs) + "".join(marks), "".join(b for _, b in pairs)


def strip_accents(text: Column) -> Column:
    """Letters without their accents; characters without a replacement in ``translate`` are combining marks, and go."""
    return F.translate(text, *accent_table())


def base_clean(text: Column, exotic: bool = False) -> Column:
    """Lower-case Latin text with signs for "and" spelled out; null is empty."""
    text = F.coalesce(text, F.lit(""))
    text = translit.to_latin(text) if exotic else strip_accents(text)
    return F.regexp_replace(F.lower(text), r"[&+]", " and ")


def _split(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern), lambda t: t != "")


def words(text: Column) -> Column:
    """Words of a text that one space joins; an empty text has none."""
    return _split(text, " +")


def fix_leet(token: Column) -> Column:
    """Digits read as letters in tokens that hold a letter."""
    return F.when(token.rlike("[a-z]"), F.translate(token, fixed.LEET_FROM, fixed.LEET_TO)).otherwise(token)


def name_tokens(text: Column) -> Column:
    return F.transform(_split(text, "[^a-z0-9]+"), fix_leet)


def skeleton_word(word: Column) -> Column:
    """Consonants by sound: vowels go, repeats collapse; numbers stay."""
    sound = word
    for old, new in fixed.SKELETON:
        sound = F.replace(sound, F.lit(old), F.lit(new))
    sound = F.regexp_replace(F.regexp_replace(sound, "[aeiouy]", ""), r"(.)\1+", "$1")
    return F.when(word.rlike("^[0-9]+$"), word).otherwise(sound)


def skeletons(tokens: Column) -> Column:
    return F.filter(F.transform(tokens, skeleton_word), lambda k: k != "")


def _among(values) -> Column:
    return F.array(*[F.lit(v) for v in sorted(set(values))])


def core_tokens(tokens: Column) -> Column:
    """Tokens but for legal forms and fillers, repeats kept; all, if none is left."""
    drop, drop_skeletons = _among([*fixed.LEGAL, *fixed.FILLER]), _among(fixed.LEGAL_SKELETONS)
    core = F.filter(tokens, lambda t: ~F.array_contains(drop, t) & ~F.array_contains(drop_skeletons, skeleton_word(t)))
    return F.when(F.size(core) > 0, core).otherwise(tokens)


def web_rewrite(text: Column) -> tuple[Column, Column]:
    """(the text with web names as plain words, whether there was one)."""
    return F.regexp_replace(text, fixed.WEB, " $1 "), text.rlike(fixed.WEB)


def with_name_views(df: DataFrame, column: str, exotic: bool = False) -> DataFrame:
    """Add n_full, n_core, n_alias, n_nospace, n_skel, is_web and has_alias for the raw name in ``column``."""
    rewritten, web = web_rewrite(F.col("_clean"))
    df = df.withColumn("_clean", base_clean(F.col(column), exotic)).withColumn("_text", rewritten).withColumn("is_web", web.cast("byte"))
    df = df.withColumn("_parts", F.split("_text", fixed.ALIAS)).withColumn("has_alias", (F.size("_parts") > 1).cast("byte"))
    df = df.withColumn("_tokens", F.filter(F.transform("_parts", name_tokens), lambda t: F.size(t) > 0))
    df = df.withColumn("_tokens", F.when(F.size("_tokens") > 0, F.col("_tokens")).otherwise(F.array(F.array().cast("array<string>"))))
    df = df.withColumn("_cores", F.transform("_tokens", core_tokens))
    df = df.withColumn("n_full", F.array_join(F.flatten("_tokens"), " "))
    df = df.withColumn("_core", F.when(F.col("has_alias") == 1, F.element_at("_cores", -1)).otherwise(F.element_at("_cores", 1)))
    first = F.slice("_cores", 1, 1)
    seen = F.when(F.col("has_alias") == 1, F.col("_cores")).otherwise(first)
    return df.withColumns({
        "n_core": F.array_join("_core", " "),
        "n_alias": F.transform("_cores", lambda c: F.array_join(c, " ")),
        "n_nospace": F.transform(seen, lambda c: F.array_join(c, "")),
        "n_skel": F.array_join(skeletons(F.col("_core")), " "),
    }).drop("_clean", "_text", "_parts", "_tokens", "_cores", "_core")


@lru_cache(maxsize=1)
def state_skeletons() -> list[str]:
    """Skeletons, without spaces, of state names whose skeleton has three characters or more."""

    def sound(word: str) -> str:
        for old, new in fixed.SKELETON:
            word = word.replace(old, new)
        return re.sub(r"(.)\1+", r"\1", re.sub("[aeiouy]", "", word))

    found = {" ".join(filter(None, map(sound, name.split()))) for name in (*fixed.US_STATES, *fixed.IN_STATES)}
    return sorted(f.replace(" ", "") for f in found if len(f) >= 3)


def _is_state(component: Column) -> Column:
    names = _among([*fixed.US_STATES, *fixed.IN_STATES, *fixed.US_STATES.values(), *fixed.IN_STATES.values(), *fixed.FR_AREAS])
    spaceless = F.replace(component, F.lit(" "), F.lit(""))
    sound = F.array_join(skeletons(words(component)), "")
    return F.array_contains(names, component) | F.array_contains(_among(fixed.IN_STATES), spaceless) | F.array_contains(_among(state_skeletons()), sound)


def _lookup(token: Column, table: dict[str, str]) -> Column:
    keys = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*keys)[token], token)


def address_token(token: Column) -> Column:
    token = F.when(token.rlike("^[0-9]"), token).otherwise(fix_leet(token))
    return _lookup(_lookup(token, fixed.ordinals()), fixed.address_canon())


def with_address_views(df: DataFrame, column: str, exotic: bool = False) -> DataFrame:
    """Add a_norm, a_nums and a_words for the raw address in ``column``."""
    text = F.regexp_replace(base_clean(F.col(column), exotic), "#|n°|no°", " ")
    df = df.withColumn("_parts", F.transform(F.split(text, ","), lambda c: F.array_join(_split(c, "[^a-z0-9]+"), " ")))
    df = df.withColumn("_parts", F.filter("_parts", lambda c: (c != "") & ~_is_state(c)))
    stop = _among(fixed.ADDRESS_STOP)
    tokens = F.filter(F.transform(F.flatten(F.transform("_parts", words)), address_token), lambda t: ~F.array_contains(stop, t))
    df = df.withColumn("_tokens", tokens).withColumn("a_norm", F.array_join("_tokens", " "))
    numbers = F.transform(F.regexp_extract_all("a_norm", F.lit("([0-9]+)"), F.lit(1)), lambda n: F.regexp_replace(n, "^0+(?=[0-9])", ""))
    plain = F.filter("_tokens", lambda t: ~t.rlike("[0-9]") & (F.length(t) > 1))
    return df.withColumns({"a_nums": F.array_distinct(numbers), "a_words": plain}).drop("_parts", "_tokens")


def normalize_records(df: DataFrame, name: str = "business_name", address: str = "business_address", exotic: bool = True) -> DataFrame:
    """All views of raw records."""
    return with_address_views(with_name_views(df, name, exotic), address, exotic)


def delimited(df: DataFrame) -> DataFrame:
    """Views of several values as text: aliases by ``|``, numbers and words by a space."""
    return df.withColumns({c: F.array_join(c, "|" if c.startswith("n_") else " ") for c in ("n_alias", "n_nospace", "a_nums", "a_words") if c in df.columns})


def first_number(numbers: Column) -> Column:
    """The first of an array of numbers, or the empty text."""
    return F.coalesce(F.get(numbers, F.lit(0)), F.lit(""))
