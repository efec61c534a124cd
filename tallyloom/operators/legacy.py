"""Sections of older forms, found by marker lines, and their use where the layout parser found nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.stage import put
from tallyloom.operators.lines import PAGE_MARK, with_lines

# The markers that begin and end the sections of products and of exchange of knowledge.
PRODUCTS = (("PRODUCCION CIENTIFICA IMPACTO",), ("INTERCAMBIO DE CONOCIMIENTO", "EVIDENCIAS DE LO REPORTADO", "PONENCIAS", "CAPITULOS", "LIBROS"))
EXCHANGE = (("INTERCAMBIO DE CONOCIMIENTO",), ("EVIDENCIAS DE LO REPORTADO", "ANEXOS", "OBSERVACIONES"))
HEADING = r"^\d{1,2}\.\s+"
NOISE = r"FORMULARIO DE INFORME|JOTFORM|^\d+\s+DE\s+\d+$"


def _places(keys: Column, test) -> Column:
    """Positions of the keys that pass a test."""
    return F.filter(F.transform(keys, lambda k, i: F.when(test(k), i)), lambda i: i.isNotNull())


def _first_after(places: Column, start: Column) -> Column:
    return F.array_min(F.filter(places, lambda i: i > start))


def marked_lines(docs: DataFrame, key: str, sections: dict[str, tuple[tuple[str, ...], tuple[str, ...]]], text: str = "text") -> DataFrame:
    """(key, section, line_no, line) of each section: the lines after the first one with a start marker.

    ``sections`` names the start and the stop markers, which are pieces of a line's key. A section ends at a stop marker, or at a
    numbered heading once it has a line; form titles, page counts and page marks are left out. Documents without the
    marker, empty ones and null texts have no rows. Each document is worked on inside its row.
    """
    df = with_lines(docs.select(key, F.col(text).alias("text")))
    holds = lambda words: lambda k: F.reduce(F.array(*map(F.lit, words)), F.lit(False), lambda found, w: found | k.contains(w))
    skipped = lambda k: k.rlike(NOISE)
    # a page mark has no key of its own kind, so it is known by its line
    df = df.transform(put, "keys", F.zip_with("keys", "lines", lambda k, x: F.when(x.rlike(PAGE_MARK), "JOTFORM").otherwise(k)))
    df = df.transform(put, "_heads", _places(F.col("keys"), lambda k: k.rlike(HEADING))).transform(put, "_content", _places(F.col("keys"), lambda k: ~skipped(k)))
    numbered = F.transform("lines", lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    parts = []
    for name, (starts, stops) in sections.items():
        found = df.withColumn("_start", F.array_min(_places(F.col("keys"), holds(starts)))).filter("_start IS NOT NULL")
        found = found.withColumn("_stop", _first_after(_places(F.col("keys"), holds(stops)), F.col("_start"))).withColumn("_one", _first_after(F.col("_content"), F.col("_start")))
        found = found.transform(put, "_end", F.least(F.coalesce("_stop", F.size("lines")), F.coalesce(_first_after(F.col("_heads"), F.col("_one")), F.size("lines"))))
        held = F.filter(numbered, lambda r: (r["at"] > F.col("_start")) & (r["at"] < F.col("_end")) & F.array_contains("_content", r["at"]))
        parts.append(found.select(key, F.lit(name).alias("section"), F.posexplode(held).alias("line_no", "_r")).select(key, "section", "line_no", "_r.line"))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows


def fallback(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the first parser, and those of the second for keys the first has no row of; ``parser`` tells which."""
    rest = second.join(first.select(*keys).distinct(), keys, "left_anti")
    return first.withColumn("parser", F.lit("layout")).unionByName(rest.withColumn("parser", F.lit("legacy")), allowMissingColumns=True)
