"""Keys of names: accents, compatibility forms, case and punctuation folded away, inside Catalyst."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _decompositions() -> tuple[dict[str, str], dict[str, str]]:
    """What NFKD without combining marks makes of Latin, Greek and Cyrillic letters and of punctuation: one character, or several."""
    one, several = {}, {}
    for code in (*range(0xA0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2070), *range(0xFB00, 0xFB07)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if plain != chr(code):
            (one if len(plain) == 1 else several)[chr(code)] = plain
    return one, several


_ONE, _SEVERAL = _decompositions()


def fold(name: Column) -> Column:
    """Compatibility decomposition without combining marks."""
    plain = F.translate(name, "".join(_ONE), "".join(_ONE.values()))
    spelled = plain
    for letter, letters in _SEVERAL.items():
        spelled = F.replace(spelled, F.lit(letter), F.lit(letters))
    return F.regexp_replace(F.when(plain.rlike(f"[{''.join(_SEVERAL)}]"), spelled).otherwise(plain), r"\p{M}+", "")


def name_key(name: Column) -> Column:
    """Accent-, case- and punctuation-insensitive key; null gives an empty key."""
    plain = F.regexp_replace(F.lower(fold(F.coalesce(name, F.lit("")))), r"[-.'`]", " ")
    return F.trim(F.regexp_replace(plain, r"[\s\p{Z}]+", " "))


def city_norm(name: Column) -> Column:
    """Lower-case letters and digits with single spaces, without trailing numbers such as " 2" or " 40k"."""
    plain = F.regexp_replace(F.lower(fold(name)), "[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(plain, " +", " ")), r"( \d+k?)+$", ""))


def phrases(text: Column, most: int) -> Column:
    """All runs of one to ``most`` words of a text with single spaces."""
    words = F.split(text, " ")
    runs = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " ")))
    return F.array_distinct(F.flatten(runs))
