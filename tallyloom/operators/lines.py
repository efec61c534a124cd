"""Report text as lines and sections.

All of it happens inside the row of a document: the text becomes an array of lines, headings and page
marks are positions in that array, and sections are slices of it. No shuffle is needed, and a document
is never cut short.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tallyloom.functions import wordlists as W
from tallyloom.functions.stage import put
from tallyloom.functions.fuzzy import set_ratio
from tallyloom.functions.people import has_piece
from tallyloom.functions.text import accent_table, fix_mojibake
from tallyloom.session import spread

PAGE_MARK = r"(?i)^\[\[PAGE_BREAK(?::\d+)?\]\]$"
ACCEPT, REVIEW = 90.0, 75.0  # scores from which a heading is taken, and is taken without review


def clean_text(value: Column) -> Column:
    text = fix_mojibake(F.coalesce(value, F.lit("")))
    text = F.replace(text, F.lit("\ufffd"), F.lit(""))
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0e-\\x1f]", ""), "[ \\t]+", " "))


def split_lines(value: Column) -> Column:
    """Non-empty lines with single spaces; the text is cleaned as a whole before it is split."""
    marked = F.replace(clean_text(value), F.lit("\f"), F.lit("\n[[PAGE_BREAK]]\n"))
    # a lone blank, which most matches would be, stays as it is
    blank, other = "[ \\t\\x0b\\f\u00a0]", "[\\t\\x0b\\f\u00a0]"
    spaced = F.regexp_replace(marked, f"{other}{blank}*| {blank}+", " ")
    return F.filter(F.transform(F.split(spaced, "\r\n|[\n\r\u0085\u2028\u2029]"), lambda x: F.trim(x)), lambda x: x != "")


@cache
def _key_letters() -> dict[int, str | None]:
    """Accented letters to plain ones, marks to nothing, as ``strip_accents``."""
    marks = dict.fromkeys(c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)).startswith("M"))
    return marks | str.maketrans(*accent_table())


_NO_KEY = re.compile(r"[^A-Z0-9%./:\- \n]+[^A-Z0-9%./:\-\n]*| [^A-Z0-9%./:\-\n]+")


@pandas_udf(T.ArrayType(T.StringType()))
def _keys_of(joined: pd.Series) -> pd.Series:
    def keys(text: str) -> list[str]:
        upper = text.upper()
        plain = _NO_KEY.sub(" ", upper if upper.isascii() else upper.translate(_key_letters()))
        return [line.strip(" ") for line in plain.split("\n")]

    return joined.map(keys)


def line_keys(lines: Column) -> Column:
    """``parser_key`` of every line, worked out over the joined lines at once."""
    return F.when(F.size(lines) > 0, _keys_of(F.array_join(lines, "\n"))).otherwise(F.array().cast("array<string>"))


def lines_holding(keys: Column, pieces: tuple[str, ...]) -> Column:
    """Positions of the keys that hold any of the pieces; all keys are looked through at once, those of texts with a piece one by one."""
    @pandas_udf(T.ArrayType(T.IntegerType()))
    def at(joined: pd.Series) -> pd.Series:
        def found(text: str) -> list[int]:
            held = [piece for piece in pieces if piece in text]
            return [i for i, key in enumerate(text.split("\n")) if any(piece in key for piece in held)] if held else []

        return joined.map(found)

    return at(F.array_join(keys, "\n"))


def with_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``lines``, their ``keys`` and the page marks of each document."""
    df = spread(docs).transform(put, "lines", split_lines(F.col(text))).transform(put, "keys", line_keys(F.col("lines")))
    number = lambda line, key: F.coalesce(
        F.nullif(F.regexp_extract(line, r"(?i)^\[\[PAGE_BREAK:(\d+)\]\]$", 1), F.lit("")),
        F.nullif(F.regexp_extract(key, r"^(\d+)(?:\s+DE\s+|/)\d+$", 1), F.lit("")),
    )
    maybe = F.filter(
        F.transform("lines", lambda x, i: F.struct(i.alias("at"), x.alias("line"), F.get(F.col("keys"), i).alias("key"))),
        lambda r: r["line"].startswith("[[") | r["key"].rlike(r"^\d+(?:\s+DE\s+|/)\d+$"))
    marks = F.transform(maybe, lambda r: F.struct(
        r["at"].alias("at"), number(r["line"], r["key"]).try_cast("int").alias("page"), r["line"].rlike(r"(?i)^\[\[PAGE_BREAK\]\]$").alias("implied")))
    return df.transform(put, "marks", F.filter(marks, lambda m: m["page"].isNotNull() | m["implied"]))


def page_at(marks: Column, at: Column) -> Column:
    """The last numbered page before a line plus the unnumbered breaks since; null before any mark."""
    seen = F.filter(marks, lambda m: m["at"] <= at)
    numbered = F.get(
        F.filter(F.reverse(seen), lambda m: m["page"].isNotNull()), F.lit(0))
    since = F.size(F.filter(seen, lambda m: m["implied"] & (m["at"] > F.coalesce(numbered["at"], F.lit(-1)))))
    return F.when(F.size(seen) > 0, F.coalesce(numbered["page"], F.lit(1)) + since)


def line_table(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, page, line, line_key): one row per line of each document."""
    df = with_lines(docs.select(key, text), text)
    exploded = df.select(key, "marks", "keys", F.posexplode("lines").alias("line_no", "line"))
    return exploded.select(
        key, "line_no", page_at(F.col("marks"), F.col("line_no")).alias("page"), "line", F.get("keys", F.col("line_no")).alias("line_key"))


def is_skipped(line: Column, key: Column) -> Column:
    """Page marks, form headers and column headers inside tables."""
    return (
        line.rlike(PAGE_MARK) | key.rlike(r"^\d+\s+DE\s+\d+$") | key.rlike(r"^\d+/\d+$") | key.startswith("FORMULARIO DE INFORME")
        | has_piece(key, ("FORM.JOTFORM", "AGREGAR NUEVO REGISTRO")) | key.rlike(r"^\d{1,2}/\d{1,2}/\d{4}") | key.isin(*W.SKIPPED_HEADERS)
    )


def _alias_keys() -> list[tuple[str, str]]:
    return [(kind, alias.upper()) for kind, aliases in W.SECTION_ALIASES.items() for alias in aliases]


def _best_heading(key: str) -> tuple[str, float]:
    best = ("", 0.0, 0)
    for kind, aliases in W.SECTION_ALIASES.items():
        scored = [(set_ratio(key, alias.upper()), alias) for alias in aliases]
        score, alias = max(scored, key=lambda pair: pair[0])
        if score > best[1] or (score == best[1] and len(alias) > best[2]):
            best = (kind, score, len(alias))
    return best[0], best[1]


HEADING = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("score", T.DoubleType())]))


@pandas_udf(HEADING)
def _headings(keys: pd.Series) -> pd.Series:
    known: dict[str, tuple[str, float]] = {}
    result = []
    for group in keys:
        rows = []
        for key in group:
            if key not in known:
                known[key] = _best_heading(key)
            rows.append({"kind": known[key][0], "score": known[key][1]})
        result.append(rows)
    return pd.Series(result)


def with_sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``sections``: kind, title, score, page and the lines up to the next heading or end marker.

    A heading holds a known title of twelve characters or more, is no column header and no end marker.
    """
    df = with_lines(docs, text)
    long_aliases = tuple(a for _k, a in _alias_keys() if len(a) >= 12)
    found = F.transform(lines_holding(F.col("keys"), long_aliases), lambda i: F.struct(i.alias("at"), F.get("keys", i).alias("key")))
    near = F.filter(found, lambda s: F.length(s["key"]) >= 12)
    df = df.transform(put, "_near", near)
    numbered = F.transform("_near", lambda s: F.struct(s["at"].alias("at"), F.when(
        F.get("lines", s["at"]).rlike(r"^\d{1,2}\."), F.regexp_replace(s["key"], r"^\d{1,2}\.\s*", "")).otherwise(s["key"]).alias("key")))
    df = df.transform(put, "_spots", F.filter(numbered, lambda s: (
        (F.length(s["key"]) >= 12) & ~s["key"].isin(*W.TABLE_HEADERS) & ~has_piece(s["key"], W.NEGATIVE_MARKERS))))
    df = df.transform(put, "_found", F.when(F.size("_spots") > 0, _headings(F.transform("_spots", lambda s: s["key"]))))
    starts = F.filter(F.transform("_spots", lambda s, i: F.struct(
        s["at"].alias("at"), F.get("_found", i)["kind"].alias("kind"), F.get("_found", i)["score"].alias("score"))), lambda s: s["score"] >= REVIEW)
    ends = lines_holding(F.col("keys"), W.NEGATIVE_MARKERS)
    df = df.transform(put, "_starts", starts).transform(put, "_ends", ends)

    def section(s: Column, i: Column) -> Column:
        stop = F.least(F.coalesce(F.get("_starts", i + 1)["at"], F.size("lines")), F.coalesce(
            F.array_min(F.filter("_ends", lambda e: e > s["at"])), F.size("lines")))
        size = stop - s["at"] - 1
        return F.struct(
            i.alias("section_no"), s["kind"].alias("kind"), F.get("lines", s["at"]).alias("title"), s["score"].alias("score"),
            page_at(F.col("marks"), s["at"]).alias("page"), (s["score"] < ACCEPT).alias("requires_review"),
            F.slice("lines", s["at"] + 2, size).alias("lines"), F.slice("keys", s["at"] + 2, size).alias("keys"))

    return df.transform(put, "sections", F.transform("_starts", section)).drop("_near", "_spots", "_found", "_starts", "_ends")


def section_rows(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per section with its lines and keys as arrays."""
    df = with_sections(docs.select(key, text), text)
    return df.select(key, F.explode("sections").alias("s")).select(key, "s.*")


def section_lines(sections: DataFrame, key: str) -> DataFrame:
    return sections.select(key, "section_no", "kind", "page", "keys", F.posexplode("lines").alias("line_no", "line")).transform(put, 
        "line_key", F.get("keys", F.col("line_no"))).drop("keys")
