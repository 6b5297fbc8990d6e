"""Blocking keys of a record as one array expression; each key starts with the letter of its family."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import skeleton_word, words


def key_skeleton(token: Column) -> Column:
    """A skeleton less one final s or j, if something remains."""
    sound = skeleton_word(token)
    short = F.regexp_replace(sound, "[sj]$", "")
    return F.when(short != "", short).otherwise(sound)


def _prefixed(prefix: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(prefix), v))


def _crossed(prefix: str, left: Column, right: Column) -> Column:
    return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.concat(F.lit(prefix), a, F.lit("_"), b))))


def _adjacent(values: Column) -> Column:
    return F.zip_with(F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 2, F.greatest(F.size(values), F.lit(1))), lambda a, b: F.concat(a, F.lit("_"), b))


def _name_keys(name: Column) -> Column:
    tokens = words(name)
    sounds = F.filter(F.transform(tokens, key_skeleton), lambda s: s != "")
    some = F.slice(F.array_sort(F.array_distinct(sounds)), 1, 6)
    pairs = F.flatten(F.transform(some, lambda a, i: F.transform(F.filter(some, lambda b: b > a), lambda b: F.concat(F.lit("b:"), a, F.lit("_"), b))))
    initials = F.array_join(F.transform(tokens, lambda t: F.left(t, F.lit(1))), "")
    first = F.get(tokens, F.lit(0))
    short = (F.size(tokens) == 1) & F.length(first).between(2, 4)
    initial = F.when(F.size(tokens) >= 2, F.array(F.concat(F.lit("i:"), initials))).when(short, F.array(F.concat(F.lit("i:"), first))).otherwise(F.array().cast("array<string>"))
    whole = F.array(F.concat(F.lit("N:"), F.array_join(F.array_sort(sounds), " ")))
    return F.when(F.size(sounds) > 0, F.concat(whole, _prefixed("k:", sounds), pairs, initial)).otherwise(F.array().cast("array<string>"))


def record_keys(n_core: Column, n_nospace: Column, a_words: Column, a_nums: Column, has_alias: Column, n_alias: Column) -> Column:
    """The set of keys, as an array; the views of several values are arrays."""
    names = F.when(has_alias.cast("int") == 1, n_alias).otherwise(F.array(n_core))
    sounds = F.filter(F.transform(names, lambda n: F.filter(F.transform(words(n), key_skeleton), lambda s: s != "")), lambda s: F.size(s) > 0)
    first = F.coalesce(F.get(sounds, F.lit(0)), F.array().cast("array<string>"))
    prefixes = F.transform(F.filter(n_nospace, lambda v: F.length(v) >= 4), lambda v: F.concat(F.lit("p:"), F.left(v, F.lit(5))))
    return F.array_distinct(F.concat(
        F.flatten(F.transform(names, _name_keys)),
        prefixes,
        _prefixed("a:", a_words),
        _prefixed("w:", _adjacent(a_words)),
        _prefixed("#:", a_nums),
        _crossed("h:", F.slice(a_nums, 1, 2), F.slice(a_words, 1, 6)),
        _crossed("x:", F.slice(first, 1, 3), F.slice(a_words, 1, 5)),
    ))
