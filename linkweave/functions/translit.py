"""Transliteration of nine Indic scripts, and accent stripping over all of Unicode, as Arrow functions.

A consonant has an inherent "a" unless a vowel sign or a virama follows. The classes come from the characters' Unicode names.
Both functions only change strings that need it, and run once for each different string of a batch.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import fixed

_NATIVE = re.compile(fixed.NATIVE)
#: Prefix of a character's name after its script, the class it gets, and what it adds.
_SIGNS = (
    ("SIGN VIRAMA", "mute", ""), ("SIGN ANUSVARA", "plain", "n"), ("SIGN CANDRABINDU", "plain", "n"), ("TIPPI", "plain", "n"),
    ("SIGN BINDI", "plain", "n"), ("SIGN VISARGA", "plain", "h"), ("AU LENGTH MARK", "skip", ""), ("SIGN NUKTA", "skip", ""), ("ADDAK", "skip", ""),
)


def classify(ch: str) -> tuple[str, str] | None:
    """(class, sound) of one character: vowel or digit "plain", "consonant", "sign", "mute", "skip"; None passes through."""
    script, _, rest = unicodedata.name(ch, "").partition(" ")
    if script not in fixed.SCRIPTS:
        return None
    kind, _, letter = rest.partition(" ")
    if kind == "LETTER" and letter in fixed.VOWELS:
        return "plain", fixed.VOWELS[letter]
    if kind == "LETTER" and letter.endswith("A"):
        sound = letter[:-1].lower()
        return "consonant", fixed.CONSONANTS.get(sound, sound)
    if rest.startswith("VOWEL SIGN "):
        return "sign", fixed.VOWELS.get(rest.removeprefix("VOWEL SIGN "), "")
    if kind == "DIGIT":
        return "plain", str(unicodedata.digit(ch))
    return next(((c, sound) for prefix, c, sound in _SIGNS if rest.startswith(prefix)), None)


@lru_cache(maxsize=1)
def table() -> dict[str, tuple[str, str]]:
    return {chr(c): k for c in range(0x0900, 0x0D80) if (k := classify(chr(c)))}


def transliterate(text: str) -> str:
    """Latin text of a string; strings without a character of these scripts stay as they are."""
    if not _NATIVE.search(text):
        return text
    known, out = table(), []
    for i, ch in enumerate(text):
        kind, sound = known.get(ch, ("other", ch))
        out.append(sound)
        if kind == "consonant" and not _silenced(text, i + 1, known):
            out.append("a")
    joined = "".join(out).replace("rr", "t")
    return re.sub(r"(?<=[b-df-hj-np-tv-z])a\b", "", joined)


def _silenced(text: str, at: int, known: dict) -> bool:
    """Whether a vowel sign or virama comes next, beyond characters without a sound."""
    while at < len(text) and known.get(text[at], ("", ""))[0] == "skip":
        at += 1
    return at < len(text) and known.get(text[at], ("", ""))[0] in ("sign", "mute")


def strip_accents_text(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _by_value(values: pd.Series, change) -> pd.Series:
    known = {v: change(v) for v in set(values.dropna())}
    return pd.Series([known.get(v) if isinstance(v, str) else None for v in values], dtype=object)


@F.pandas_udf(StringType())
def _latin(values: pd.Series) -> pd.Series:
    return _by_value(values, lambda v: strip_accents_text(transliterate(v)))


@F.pandas_udf(StringType())
def _translit(values: pd.Series) -> pd.Series:
    return _by_value(values, transliterate)


def translit_indic(text: Column) -> Column:
    """Only strings in these scripts reach Python."""
    return F.coalesce(_translit(F.when(text.rlike(fixed.NATIVE), text)), text)


def to_latin(text: Column) -> Column:
    """Transliteration and accent stripping of any string; plain ASCII does not reach Python."""
    return F.coalesce(_latin(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)
