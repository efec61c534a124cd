"""Product titles: quality and cleaning."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import wordlists as W
from tallyloom.functions.stage import put
from tallyloom.functions.people import has_piece
from tallyloom.functions.text import collapse, strip_accents, upper_key

TITLE_LENGTH = 240  # stored titles end here


def clean_name(value: Column) -> Column:
    text = F.regexp_replace(collapse(F.coalesce(value, F.lit(""))), r"^[ \-]+|[ \-]+$", "")
    return F.nullif(F.substring(text, 1, TITLE_LENGTH), F.lit(""))


def _hits(tokens: Column, words: tuple[str, ...]) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(*words)))


def _holds(key: Column, pieces: tuple[str, ...]) -> Column:
    """``has_piece`` for a few pieces, which are sought faster one by one."""
    return reduce(or_, [key.contains(piece) for piece in pieces])


def _identifier(text: Column, key: Column) -> Column:
    return (
        key.contains("/") | _holds(key, W.IDENTIFIER_WORDS) | (text.rlike(r"\.|/") & key.rlike(r"\b[A-Z]*\d[A-Z0-9]*\b"))
        | (key.contains(".") & key.rlike(r"\.[A-Z]{1,3}\s+[A-Z]{1,3}\b"))
    )


def _quality(text: Column, key: Column, tokens: Column, identifier: Column) -> Column:
    """Cheap conditions stand before dear ones, which few titles then reach."""
    n = F.size(tokens)
    last = F.element_at(tokens, -1)
    roles = (n <= 6) & (_hits(tokens, W.TITLE_ROLE_WORDS) > 0) | key.isin(*W.TITLE_ROLE_ROWS)
    unfinished = key.contains("LIBRO") & has_piece(key, ("NO HA SIDO FINALIZADO", "PLANIFICADO"))
    embedded = _hits(tokens, W.TITLE_TERMS) >= 2
    noise = key.isin(*W.TITLE_FIELD_WORDS) | _holds(key, W.TITLE_NOISE)
    glued = (n >= 10) & (_hits(F.slice(tokens, F.greatest(F.lit(1), n - 11), F.lit(12)), W.GLUED_NAMES) >= 3)
    cut = last.isin(*W.CUT_LAST_WORDS) | last.isin(*W.CUT_PIECES) | ((n <= 3) & (_hits(tokens, W.CUT_PIECES) > 0))
    rule = lambda quality, name: F.struct(F.lit(quality).alias("quality"), F.lit(W.TITLE_REASONS[name]).alias("reason"))
    return (
        F.when(text.isNull() | (key == ""), rule("invalid", "no_title"))
        .when(roles, rule("invalid", "role_or_header"))
        .when(n == 1, rule("invalid", "single_word"))
        .when(unfinished, rule("truncated", "unfinished_product"))
        .when(identifier & embedded, rule("truncated", "mixed_identifier"))
        .when(identifier, rule("invalid", "identifier"))
        .when(noise, rule("invalid", "field_noise"))
        .when(glued, rule("truncated", "glued_authors"))
        .when(cut, rule("truncated", "cut_title"))
        .when((F.length(key) < 18) | (n < 4), rule("truncated", "short_title"))
        .otherwise(rule("valid", "valid"))
    )


def with_title_quality(df: DataFrame, title: str, quality: str = "quality", reason: str = "quality_reason") -> DataFrame:
    """Adds quality (valid, truncated, invalid) and the reason of the first rule that decides."""
    staged = df.transform(put, "_text", clean_name(F.col(title))).transform(put, "_key", upper_key(F.col("_text"))).transform(put, 
        "_tokens", F.split("_key", " "))
    staged = staged.transform(put, "_ident", _identifier(F.col("_text"), F.col("_key")))
    judged = staged.transform(put, "_q", _quality(F.col("_text"), F.col("_key"), F.col("_tokens"), F.col("_ident")))
    return judged.drop(quality, reason).withColumns({quality: F.col("_q.quality"), reason: F.col("_q.reason")}).drop("_text", "_key", "_tokens", "_ident", "_q")


def _trim_marks(value: Column) -> Column:
    return F.regexp_replace(value, r"^[ \-.,;]+|[ \-.,;]+$", "")


def cut_at_key_index(text: Column, index: Column) -> Column:
    """Text up to where ``index`` non-blank characters of its key are reached.

    The index counts key positions with spaces while the walk counts non-blank characters, as the
    stored titles were cut.
    """
    plain = strip_accents(F.upper(text))
    solid = F.transform(
        F.sequence(F.lit(1), F.length(text)), lambda i: F.length(F.regexp_replace(F.substring(plain, F.lit(1), i), r"\s", "")))
    stop = F.array_position(F.transform(solid, lambda n: n >= index), F.lit(True))
    return F.when(F.length(text) == 0, text).otherwise(
        _trim_marks(F.when(stop > 0, F.substring(text, F.lit(1), (stop - 1).cast("int"))).otherwise(text)))


def _first_tail(key: Column) -> Column:
    """Zero-based index of the first tail marker at 18 or later; null when there is none.

    Only the first place of each marker counts, wherever it is.
    """
    places = [F.instr(key, marker) - 1 for marker in W.TITLE_TAILS]
    return F.least(*[F.when(p >= 18, p) for p in places])


def with_clean_title(df: DataFrame, title: str, authors: str | None = None, name: str = "clean_title") -> DataFrame:
    """Cut a title at a status marker, at its first author, and at a probable author tail."""
    staged = df.transform(put, "_t", clean_name(F.col(title))).transform(put, "_k", upper_key(F.col("_t")))
    staged = staged.transform(put, "_i", _first_tail(F.col("_k")))
    staged = staged.transform(put, "_t", F.when(F.col("_i").isNull(), F.col("_t")).otherwise(cut_at_key_index(F.col("_t"), F.col("_i"))))
    if authors is not None:
        staged = staged.transform(put, "_k", F.when(F.col("_i").isNull(), F.col("_k")).otherwise(upper_key(F.col("_t"))))
        keys = F.filter(
            F.transform(F.coalesce(F.col(authors), F.array().cast("array<string>")), lambda a: upper_key(clean_name(a))), lambda k: k != "")
        places = F.transform(keys, lambda k: F.position(k, F.col("_k")) - 1)
        staged = staged.transform(put, "_i", F.get(F.filter(places, lambda p: p > 0), F.lit(0)))
        staged = staged.transform(put, "_t", F.when(F.col("_i").isNull(), F.col("_t")).otherwise(cut_at_key_index(F.col("_t"), F.col("_i"))))
    # a title of one sentence has no sentence tail
    staged = staged.transform(put, "_t", F.when(F.col("_t").rlike(r"\.\s"), _without_sentence_tail(F.col("_t"))).otherwise(F.col("_t")))
    return _without_token_tail(staged, name).drop("_t", "_i", "_k")


def _without_sentence_tail(text: Column) -> Column:
    parts = F.filter(
        F.transform(F.split(text, r"\.\s+"), lambda p: F.regexp_replace(p, r"^[ \-]+|[ \-]+$", "")), lambda p: p != "")
    first = F.split(upper_key(F.get(parts, F.lit(0))), " ")
    rest = F.split(upper_key(F.array_join(F.slice(parts, F.lit(2), F.size(parts)), " ")), " ")
    tail = (F.size(parts) > 1) & (F.size(first) >= 4) & (_hits(rest, W.COMMON_NAMES) >= 2)
    return F.when(tail, _trim_marks(F.get(parts, F.lit(0)))).otherwise(text)


def _without_token_tail(df: DataFrame, name: str) -> DataFrame:
    staged = df.transform(put, "_words", F.split("_t", " ")).transform(put, 
        "_plain", F.when(F.size("_words") >= 12, F.transform("_words", lambda w: F.regexp_replace(upper_key(w), r"^[.,;:]+|[.,;:]+$", ""))))
    n = F.size("_words")
    # a tail from index i counts when three common names are left at i or later
    cuts = F.filter(
        F.when(n >= 12, F.sequence(F.lit(5), n - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: _hits(F.slice(F.col("_plain"), i + 1, n), W.COMMON_NAMES) >= 3)
    head = lambda i: _trim_marks(F.array_join(F.slice(F.col("_words"), F.lit(1), i), " "))
    heads = F.filter(F.transform(cuts, head), lambda h: F.size(F.split(upper_key(h), " ")) >= 4)
    return staged.transform(put, name, F.nullif(clean_name(F.coalesce(F.get(heads, F.lit(0)), F.col("_t"))), F.lit(""))).drop("_words", "_plain")


def product_key(kind: Column, *identity: Column) -> Column:
    """Type and the first of doi, link, title that is set; empty when none is."""
    ident = upper_key(F.coalesce(*[F.nullif(c, F.lit("")) for c in identity]))
    return F.coalesce(F.concat(upper_key(F.coalesce(F.nullif(kind, F.lit("")), F.lit("UNCLASSIFIED"))), F.lit("|"), F.nullif(ident, F.lit(""))), F.lit(""))


def join_wrapped(parts: Column) -> Column:
    """Lines of one title joined; a known word ending continues the word before it."""
    letters = r"[^A-Za-zÁÉÍÓÚÜÑáéíóúüñ]"

    def step(text: Column, part: Column) -> Column:
        first = F.substring_index(part, " ", 1)
        rest = F.trim(F.regexp_replace(part, r"^\S+", ""))
        suffix = F.lower(F.regexp_replace(first, letters, ""))
        before = F.length(F.regexp_replace(F.regexp_replace(F.substring_index(text, " ", -1), r"[-–—]+$", ""), letters, ""))
        joins = text.endswith("-") | (suffix.isin(*W.WRAPPED_SUFFIXES) & (before >= 4))
        glued = F.concat(text, first, F.when(rest != "", F.concat(F.lit(" "), rest)).otherwise(""))
        return F.when(part == "", text).when(text == "", part).when(joins, glued).otherwise(F.concat(text, F.lit(" "), part))

    return F.trim(F.aggregate(F.transform(parts, lambda p: F.trim(F.coalesce(p, F.lit("")))), F.lit(""), step))
