"""Text keys. Each key variant has its own rule; they are not interchangeable."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def accent_table() -> tuple[str, str]:
    """Precomposed letters whose compatibility form is one ASCII letter plus marks."""
    source, target = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        letter = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
        if base != letter and len(base) == 1 and base.isascii():
            source.append(letter)
            target.append(base)
    return "".join(source), "".join(target)


def strip_accents(value: Column) -> Column:
    source, target = accent_table()
    return F.regexp_replace(F.translate(value, source, target), r"\p{M}", "")


def collapse(value: Column) -> Column:
    # single blanks, the usual case, are no match and need no replacing
    return F.trim(F.regexp_replace(value, r"[\s ]{2,}|[\t\n\x0B\f\r ]", " "))


def upper_key(value: Column) -> Column:
    """Upper case, no accents, single spaces, punctuation kept."""
    return collapse(strip_accents(F.upper(F.coalesce(value, F.lit("")))))


def parser_key(value: Column) -> Column:
    """As ``upper_key`` but only letters, digits and ``% . / : -`` survive."""
    kept = F.regexp_replace(strip_accents(F.upper(fix_mojibake(F.coalesce(value, F.lit(""))))), r"[^A-Z0-9%./:\-\s]+", " ")
    return collapse(kept)


def alnum_key(value: Column) -> Column:
    """Letters and digits only, other runs become one space."""
    return collapse(F.regexp_replace(strip_accents(F.upper(F.coalesce(value, F.lit("")))), r"[^\p{L}\p{N}]+", " "))


def seed_key(value: Column) -> Column:
    """As ``alnum_key`` but only A to Z and 0 to 9 survive: a letter without an ASCII form is a blank."""
    return collapse(F.regexp_replace(strip_accents(F.upper(F.coalesce(value, F.lit("")))), "[^A-Z0-9]+", " "))


def institution_key(value: Column) -> Column:
    return collapse(F.regexp_replace(strip_accents(F.upper(F.coalesce(value, F.lit("")))), r":", " "))


def identity_name_key(value: Column) -> Column:
    return alnum_key(value)


def target_key(value: Column) -> Column:
    """Case-folded, only letters, marks and digits; null when nothing is left."""
    folded = F.lower(F.coalesce(value, F.lit("")))
    return F.nullif(collapse(F.regexp_replace(folded, r"[^\p{L}\p{M}\p{N}]+", " ")), F.lit(""))


def career_key(value: Column) -> Column:
    """``upper_key`` without the degree prefix."""
    text = strip_accents(F.upper(F.coalesce(value, F.lit(""))))
    text = F.replace(F.replace(text, F.lit("LICENCIATURA EN "), F.lit("")), F.lit("LICENCIATURA "), F.lit(""))
    return collapse(text)


def folded_key(value: Column) -> Column:
    return collapse(F.lower(F.coalesce(value, F.lit(""))))


# Byte pairs of UTF-8 read as Latin-1, with what they stand for.
MOJIBAKE = {
    "Ã¡": "á", "Ã©": "é", "Ã­": "í", "Ã³": "ó", "Ãº": "ú", "Ã±": "ñ",
    "Ã\u0081": "Á", "Ã‰": "É", "Ã\u008d": "Í", "Ã“": "Ó", "Ãš": "Ú", "Ã‘": "Ñ", "Â": "",
}


def fix_mojibake(value: Column) -> Column:
    for wrong, right in MOJIBAKE.items():
        value = F.replace(value, F.lit(wrong), F.lit(right))
    return value


# Particles left out of name keys.
NAME_PARTICLES = ("DE", "DEL", "LA", "LAS", "LOS", "Y")


def name_tokens(value: Column) -> Column:
    """Tokens of a person name without particles."""
    tokens = F.split(alnum_key(value), " ")
    return F.filter(tokens, lambda t: (t != "") & ~t.isin(*NAME_PARTICLES))


def name_key(value: Column) -> Column:
    return F.array_join(name_tokens(value), " ")


def seed_name_key(value: Column) -> Column:
    """``seed_key`` without particles."""
    return F.array_join(F.filter(F.split(seed_key(value), " "), lambda t: (t != "") & ~t.isin(*NAME_PARTICLES)), " ")


def like_literal(text: str) -> str:
    """A LIKE pattern that matches the text anywhere, wildcards taken literally."""
    escaped = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return f"%{escaped}%"


def contains_literal(value: Column, text: str) -> Column:
    return value.ilike(like_literal(text))
