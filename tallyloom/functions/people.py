"""Person names, institutions, careers and mail addresses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions import wordlists as W
from tallyloom.functions.text import collapse, institution_key, parser_key, upper_key


def _without_dots(value: Column) -> Column:
    return F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("..."), F.lit(" ")), F.lit("…"), F.lit(" "))


def person_tokens(value: Column) -> Column:
    return F.split(parser_key(_without_dots(value)), " ")


def share(tokens: Column, words: tuple[str, ...]) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(*words))) / F.size(tokens)


def has_piece(text: Column, pieces: tuple[str, ...]) -> Column:
    """Whether any of the literal pieces occurs."""
    return text.rlike("|".join(re.sub(r"([.*+?^${}()|\[\]\\/])", r"\\\1", piece) for piece in pieces))


def tokens_make_name(tokens: Column) -> Column:
    """Two to seven plain words, at least two of them no function words, none from the word list."""
    key = F.array_join(tokens, " ")
    meaningful = F.size(F.filter(tokens, lambda t: ~t.isin(*W.FUNCTION_WORDS)))
    phrase = (F.size(tokens) >= 4) & (share(tokens, W.FUNCTION_WORDS) >= 0.4)
    bad = F.exists(tokens, lambda t: (F.length(t) <= 1) | t.isin(*W.NON_PERSON_WORDS) | ~t.rlike("^[A-Z]+$"))
    return (
        F.size(tokens).between(2, 7) & (meaningful >= 2) & ~phrase & ~key.rlike(r"\d|/|\\|_|PDF|SIGNED|INFSEM|GI\d")
        & ~bad & ~has_piece(F.array_join(tokens, ""), W.NON_PERSON_PIECES)
    )


def looks_like_person(value: Column) -> Column:
    return tokens_make_name(person_tokens(value))


def is_member_text(value: Column) -> Column:
    tokens = F.split(parser_key(value), " ")
    return (F.size(tokens) >= 2) & ~F.exists(tokens, lambda t: t.isin(*W.MEMBER_BLOCKED))


def title_case(key: Column) -> Column:
    return F.initcap(F.lower(key))


def person_display(value: Column) -> Column:
    return title_case(parser_key(value))


def remove_short_prefix(value: Column) -> Column:
    """(text, flagged): a first token of one or two letters is scanner noise, unless it is an article."""
    text = F.regexp_replace(collapse(F.translate(F.coalesce(value, F.lit("")), ".:", "  ")), r"^[ \-]+|[ \-]+$", "")
    tokens = F.split(upper_key(text), " ")
    noisy = (F.size(tokens) >= 2) & (F.length(tokens[0]) <= 2) & ~tokens[0].isin("DE", "LA", "EL")
    return F.struct(
        F.when(noisy, F.array_join(F.slice(tokens, F.lit(2), F.size(tokens)), " ")).otherwise(text).alias("text"), noisy.alias("flagged"))


def is_incomplete_name(value: Column) -> Column:
    """A token of at most two letters, an ellipsis, or fewer than three tokens."""
    tokens = F.split(upper_key(value), " ")
    return F.exists(tokens, lambda t: F.length(t) <= 2) | value.rlike(r"\.\.\.|…") | (F.size(tokens) < 3)


def institution_display(value: Column) -> Column:
    """Display form of an external institution; null for the own one, people and anything unmarked."""
    key = institution_key(value)
    text_key = F.regexp_replace(key, r"^[ \-]+|[ \-]+$", "")
    known = F.create_map(*[F.lit(x) for pair in W.INSTITUTION_SPELLINGS.items() for x in pair])
    words = F.transform(
        F.split(text_key, " "),
        lambda t: F.when(t.isin("DE", "DEL", "LA", "LAS", "LOS", "Y"), F.lower(t)).when(F.length(t) <= 3, t).otherwise(title_case(t)),
    )
    pretty = F.substring(F.array_join(words, " "), 1, 180)
    refused = (
        (F.length(text_key) < 6) | has_piece(text_key, ("GRADUADO", "EGRESADO")) | text_key.isin(*W.OWN_INSTITUTION)
        | text_key.contains(W.OWN_INSTITUTION_PIECE) | ~has_piece(text_key, W.INSTITUTION_WORDS)
    )
    return F.when(~refused, F.coalesce(F.element_at(known, text_key), pretty))


def external_type(value: Column, default: str | None = None) -> Column:
    key = upper_key(value)
    kind = F.when(has_piece(key, ("ESTUDIANTE", "ALUMNO")), "estudiante").when(has_piece(key, ("GRADUADO", "EGRESADO")), "graduado")
    if default is not None:
        return kind.otherwise(default)
    return kind.when(
        has_piece(key, ("UNIVERSIDAD", "INSTITUTO", "ESCUELA", "CENTRO", "POLITECNICA")), "investigador_externo"
    ).otherwise("no_clasificado")


def career_by_words(value: Column) -> Column:
    key = upper_key(value)
    result = None
    for words, career in W.CAREER_WORDS:
        test = F.lit(True)
        for word in words:
            test = test & key.contains(word)
        result = F.when(test, career) if result is None else result.when(test, career)
    return result


def is_real_email(value: Column) -> Column:
    key = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    fake = key.startswith("imported-") | key.endswith("@local.import") | has_piece(key, ("\\", "/", "dropbox", "source_key"))
    return ~fake & key.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")


def synthetic_email(name: Column, career_id: Column) -> Column:
    digest = F.sha1(F.concat(name, F.lit("|"), career_id.cast("string")))
    return F.concat(F.lit("imported-"), F.substring(digest, 1, 12), F.lit("@local.import"))


def production_type_of(value: Column) -> Column:
    key = upper_key(value)
    return (
        F.when(has_piece(key, ("BOOK_CHAPTER", "CAPITULO")), "BOOK_CHAPTER").when(has_piece(key, ("BOOK", "LIBRO")), "BOOK")
        .when(has_piece(key, ("PRESENTATION", "PONENCIA", "INTERCAMBIO")), "PRESENTATION").otherwise("ARTICLE")
    )


def production_status_of(value: Column) -> Column:
    return F.when(has_piece(upper_key(value), ("REVISION", "ENVIADO", "SUBMITTED")), "en_revision").otherwise("published")


def product_status(key: Column) -> Column:
    """Status a short table cell stands for; null when it is none."""
    return status_of(F.replace(parser_key(key), F.lit(" "), F.lit("")))


def status_of(compact: Column) -> Column:
    """Status of a key without spaces; null when it is none."""
    short = F.length(compact) <= 10
    return (
        F.when(compact.startswith("PUBLIC") & short, "PUBLICADO").when(compact.startswith("ACEPT") & short, "ACEPTADO")
        .when(compact.startswith("ENVIADOAREV"), "ENVIADO A REVISION").when(compact.startswith("ENREV"), "EN REVISION")
    )


def impact_of(value: Column) -> Column:
    key = parser_key(value)
    return F.when(key.contains("MUND"), "IMPACTO MUNDIAL").when(key.contains("REGION"), "IMPACTO REGIONAL").otherwise(F.nullif(value, F.lit("")))


def is_url(value: Column) -> Column:
    text = F.lower(F.trim(value))
    return text.startswith("http") | text.startswith("www.") | has_piece(text, ("doi.org", ".com", ".org"))
