"""Report layouts whose rows carry no marks: stacked products, labelled members, and what several layouts found together.

A row of a stacked table is a run of lines: title, authors, status, then impact and link. Statuses are found first; what
stands between the end of one row and the next status is the title and the authors, the authors being the longest names
that fit from the back. Lines in small letters that open a page belong to the title of the row before. A labelled table
names each value; the value is what stands between its label and the next one.

Everything works on the arrays of a section, inside its row. The impact and link lines after a status always belong to
the row of that status, also where that row makes no product.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallyloom.functions import people as P
from tallyloom.functions import titles
from tallyloom.functions import wordlists as W
from tallyloom.functions.fuzzy import set_ratio
from tallyloom.functions.people import has_piece
from tallyloom.functions.stage import put
from tallyloom.functions.text import parser_key
from tallyloom.operators import extract
from tallyloom.operators.lines import PAGE_MARK, is_skipped
from tallyloom.session import cut_lineage

NAME_LINES = 4  # lines a wrapped name may take, and status words
LOOK_AHEAD = 5  # lines of a page in which its own first row has to begin
RUN_ON = r"^\p{Ll}"
OPENING = r"^\p{Lu}"
DATE_LIKE = r"\d{1,4}[-/]\d{1,2}[-/]\d{1,4}"


def is_page(line: Column, key: Column) -> Column:
    return line.rlike(PAGE_MARK) | key.rlike(r"^\d+(?:\s+DE\s+|/)\d+$")


def _pairs(sections: DataFrame) -> DataFrame:
    return sections.transform(put, "_all", F.zip_with("lines", "keys", lambda a, b: F.struct(a.alias("line"), b.alias("key"))))


def _texts(rows: Column) -> Column:
    return F.transform(rows, lambda r: r["line"])


def _part(rows: Column, start: Column, end: Column) -> Column:
    """Elements from ``start`` up to, not including, ``end``."""
    return F.slice(rows, start + 1, F.greatest(end - start, F.lit(0)))


def _first(flags: Column, after: Column, total: Column) -> Column:
    """The first position not before ``after`` that is set, else ``total``."""
    spots = F.filter(F.transform(flags, lambda f, i: F.when(f & (i >= after), i)), lambda i: i.isNotNull())
    return F.coalesce(F.array_min(spots), total)


# ---- stacked products


def _useful(sections: DataFrame) -> DataFrame:
    """Adds ``u``: the lines of the table, each with the number of page marks before it."""
    df = _pairs(sections).transform(put, "_marks", F.filter(F.transform("_all", lambda r, i: F.when(is_page(r["line"], r["key"]), i)), lambda i: i.isNotNull()))
    seen = F.transform("_all", lambda r, i: F.struct(
        r["line"].alias("line"), r["key"].alias("key"), F.size(F.filter("_marks", lambda m: m < i)).alias("pages"),
        # a stray piece of a wrapped word stays, unless it is the end of a wrapped column header
        (~is_page(r["line"], r["key"]) & (~is_skipped(r["line"], r["key"]) | (r["key"] == "ABOUT") | (
            (r["key"] == "O") & (F.coalesce(F.get("_all", i - 1)["key"], F.lit("")) != "IMPACT")))).alias("kept")))
    return df.transform(put, "u", F.filter(seen, lambda r: r["kept"])).drop("_all", "_marks")


def _with_statuses(df: DataFrame) -> DataFrame:
    """Adds ``statuses``: struct(size, status) of the shortest run of lines from each on that is a status, null if none is."""
    sizes = F.sequence(F.lit(1), F.lit(NAME_LINES))
    runs = F.transform("u", lambda _r, i: F.transform(F.filter(sizes, lambda n: i + n <= F.size("u")), lambda n: F.replace(
        F.array_join(F.transform(F.slice("u", i + 1, n), lambda r: r["key"]), ""), F.lit(" "), F.lit(""))))
    df = df.transform(put, "_runs", runs)
    known = F.transform("_runs", lambda run: F.transform(run, lambda compact, n: F.struct((n + 1).alias("size"), P.status_of(compact).alias("status"))))
    return df.transform(put, "statuses", F.transform(known, lambda run: F.get(F.filter(run, lambda s: s["status"].isNotNull()), F.lit(0)))).drop("_runs")


def _is_author(last: Column, n: Column) -> Column:
    """Whether the ``n`` lines up to ``last`` are one author."""
    first = last - (n - 1)
    rows = F.slice("names", F.greatest(first + 1, F.lit(1)), n)
    tokens = F.flatten(F.transform(rows, lambda r: r["tokens"]))
    plain = F.size(tokens).between(2, 5) & F.forall(tokens, lambda t: (F.length(t) >= 3) & ~t.isin(*W.NO_AUTHOR_WORDS))
    fits = F.get("names", first)["opens"] & ~F.exists(rows, lambda r: r["title_word"]) & (P.tokens_make_name(tokens) | plain)
    # whole names one under the other are several authors
    whole = (n > 1) & F.forall(rows, lambda r: r["whole"])
    # the last line of a title above a name
    head, second = F.get("names", first)["tokens"], F.get(F.get("names", first + 1)["tokens"], F.lit(0))
    above = (n == NAME_LINES) & (F.size(head) == 1) & ~F.get(head, F.lit(0)).isin(*W.GIVEN_NAMES) & second.isin(*W.GIVEN_NAMES)
    return F.coalesce((first >= 0) & fits & ~whole & ~above, F.lit(False))


def _with_names(df: DataFrame) -> DataFrame:
    """Adds ``names``, what each line is as part of a name, and ``authors``: whether the one to four lines up to each are an author."""
    split = F.transform("u", lambda r: F.struct(F.split(F.trim(F.replace(r["key"], F.lit("..."), F.lit(" "))), " +").alias("tokens"), r["line"].rlike(OPENING).alias("opens")))
    df = df.transform(put, "_split", split)
    df = df.transform(put, "names", F.transform("_split", lambda r: F.struct(
        r["tokens"].alias("tokens"), r["opens"].alias("opens"), F.exists(r["tokens"], lambda t: t.isin(*W.PRODUCT_TITLE_WORDS)).alias("title_word"),
        ((F.size(r["tokens"]) >= 2) & P.tokens_make_name(r["tokens"])).alias("whole"))))
    flags = F.transform("u", lambda _r, i: F.transform(F.sequence(F.lit(1), F.lit(NAME_LINES)), lambda n: _is_author(i, n)))
    return df.transform(put, "authors", flags).drop("_split", "names")


def _source_case(name: Column) -> Column:
    words = F.split(F.lower(name), " +")
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin("de", "del", "la", "las", "los", "y"), w).otherwise(F.initcap(w))), " ")


def _run_on_lines(start: Column, end: Column) -> Column:
    """Lines that open a page in small letters before the first one that opens a title; none without such a one."""
    rows = _part(F.col("u"), start, end)
    opening = F.array_position(F.transform(F.slice(rows, 2, LOOK_AHEAD - 1), lambda r: r["line"].rlike(OPENING)), F.lit(True)).cast("int")
    goes_on = F.get("facts", start)["fresh"] & F.get("u", start)["line"].rlike(RUN_ON) & (opening > 0) & (start < end)
    return F.when(goes_on, F.slice(rows, F.lit(1), opening)).otherwise(F.slice(rows, 1, 0))


def stacked_products(sections: DataFrame, key: str) -> DataFrame:
    """Products of a table without labels, one per status line, with titles carried over page breaks."""
    df = _useful(sections.filter("kind = 'produccion_cientifica'")).filter(F.size("u") > 0)

    def facts(r: Column, i: Column) -> Column:
        line = r["line"]
        link = P.is_url(line) | line.contains("/") | line.contains(".")
        above, below = F.coalesce(F.get("u", i - 1)["line"], F.lit("")), F.coalesce(F.get("u", i + 1)["line"], F.lit(""))
        piece = line.rlike("^[a-z0-9_-]+$") & (P.is_url(above) | above.contains("/") | above.contains(".")) & (above.endswith("/") | below.startswith(".") | below.contains("/"))
        return F.struct(
            (r["pages"] > F.coalesce(F.get("u", i - 1)["pages"], F.lit(0))).alias("fresh"), F.get("statuses", i).alias("status"), r["key"].isin(*W.IMPACT_LINES).alias("impact"),
            (link | piece).alias("link"), F.get("authors", i).alias("authors"))

    df = _with_names(_with_statuses(df)).transform(put, "facts", F.transform("u", facts)).drop("statuses", "authors")
    starts = F.transform("facts", lambda f: f["status"].isNotNull())
    sizes = F.transform("facts", lambda f: F.coalesce(f["status"]["size"], F.lit(1)))
    stops = F.filter(F.transform("facts", lambda f, i: F.when(~(f["impact"] | (f["link"] & ~f["fresh"])), i)), lambda i: i.isNotNull())
    df = df.transform(put, "_starts", starts).transform(put, "_sizes", sizes).transform(put, "_stops", stops)
    df = df.transform(put, "taken", extract.row_walk(F.col("_starts"), F.col("_sizes"), F.col("_stops"), F.size("u"))).drop("_starts", "_sizes", "_stops")
    df = df.select(key, "section_no", "u", "facts", "taken", F.posexplode("taken").alias("product_no", "t"))
    df = df.transform(put, "_from", F.coalesce(F.get("taken", F.col("product_no") - 1)["end"], F.lit(0)))
    own = F.when(F.col("product_no") > 0, F.size(_run_on_lines(F.col("_from"), F.col("t.at")))).otherwise(0)
    following = F.get("taken", F.col("product_no") + 1)["at"]
    df = df.transform(put, "_from", F.col("_from") + own).transform(put, "_more", F.when(following.isNotNull(), _texts(_run_on_lines(F.col("t.end"), following))))

    # authors from the back, the longest name first
    def back(state: Column, _i: Column) -> Column:
        flags = F.get("facts", state["at"] - 1)["authors"]
        size = F.coalesce(*[F.when((state["at"] - n >= F.col("_from")) & F.get(flags, F.lit(n - 1)), n) for n in range(NAME_LINES, 0, -1)], F.lit(0))
        name = _source_case(F.array_join(_texts(F.slice("u", state["at"] - size + 1, size)), " "))
        go = ~state["done"] & (size > 0)
        return F.struct(F.when(go, state["at"] - size).otherwise(state["at"]).alias("at"), (~go).alias("done"), F.when(go, F.concat(F.array(name), state["names"])).otherwise(state["names"]).alias("names"))

    begin = F.struct(F.col("t.at").alias("at"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("names"))
    steps = F.when(F.col("t.at") > F.col("_from"), F.sequence(F.col("_from"), F.col("t.at") - 1)).otherwise(F.array().cast("array<int>"))
    df = df.transform(put, "_a", F.aggregate(steps, begin, back))
    tail = _part(F.zip_with("u", "facts", lambda a, b: F.struct(a["line"].alias("line"), b["impact"].alias("impact"))), F.col("t.at") + F.col("t.size"), F.col("t.end"))
    df = df.transform(put, "_parts", _texts(_part(F.col("u"), F.col("_from"), F.col("_a.at")))).transform(put, "_tail", tail).transform(put, "authors", F.col("_a.names"))
    df = df.transform(put, "status", F.get("facts", F.col("t.at"))["status"]["status"]).select(key, "section_no", "product_no", "_parts", "_more", "_tail", "authors", "status")
    return _judged(df, key)


def _judged(df: DataFrame, key: str) -> DataFrame:
    """Titles with their quality, before and after what later pages add, and the status that follows from it."""
    df = df.transform(put, "_head", F.coalesce(F.get("_parts", F.lit(0)), F.lit(""))).transform(put, "title", titles.join_wrapped(F.col("_parts")))
    for name, q in (("_head", "_hq"), ("title", "quality")):
        df = titles.with_title_quality(df, name, q, f"{q}_reason")
    invalid, has_authors = F.col("quality") == "invalid", F.size("authors") > 0
    df = df.filter(F.when(invalid, F.col("title") != "").otherwise(has_authors))
    recovered = (F.size("_parts") > 1) & (F.col("_hq") == "truncated") & (F.col("quality") == "valid")
    review = (F.col("quality") != "valid") | ~F.col("_head").rlike(OPENING)
    df = df.transform(put, "_first_title", F.col("title")).transform(put, "_invalid", invalid).transform(put, "_recovered", recovered).transform(put, "_review", review)
    longer = F.size(F.coalesce("_more", F.array().cast("array<string>"))) > 0
    df = df.transform(put, "_longer", longer).transform(put, "title", F.when(F.col("_longer"), titles.join_wrapped(F.concat(F.array("title"), F.coalesce("_more", F.array().cast("array<string>"))))).otherwise(F.col("title")))
    df = titles.with_title_quality(df, "title", "quality", "quality_reason")
    authors = F.when(F.col("_invalid"), F.array().cast("array<string>")).otherwise(F.col("authors"))
    df = df.transform(put, "authors", authors)
    whole = (F.col("quality") == "valid") & (F.size("authors") > 0) & F.col("status").isNotNull()
    state = (
        F.when(F.col("_longer"), F.when(whole, "validado").otherwise("pending_review"))
        .when(F.col("_invalid"), "discarded_invalid").when(F.col("_review"), "pending_review").otherwise("validado"))
    lines = lambda impact: _texts(F.filter("_tail", lambda r: r["impact"] == F.lit(impact)))
    shown = lambda c: F.when(~F.col("_invalid"), F.nullif(c, F.lit("")))
    return df.select(
        key, "section_no", "product_no", "title", "authors", "status", shown(F.array_join(lines(True), " ")).alias("impact"), shown(extract.rebuilt_link(lines(False))).alias("link"),
        state.alias("validation_status"), (state == "validado").alias("kpi_eligible"), "quality", "quality_reason",
        F.when(F.col("_recovered"), F.col("_head")).when(F.col("_longer"), F.col("_first_title")).alias("original_title"),
        F.when(F.col("_longer"), "recovered_across_page_break").when(F.col("_recovered"), "recovered_from_pdf_context").alias("title_recovery"))


# ---- labelled values


def _is_label(key: Column, names: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for name in names:
        test = test | key.startswith(name)
    return test


def _value(rows: Column, at: Column, stops: tuple[str, ...]) -> Column:
    """The text after the label at ``at``, up to the next of ``stops``, a bare number, a section or a date."""
    ends = F.transform(rows, lambda r: _is_label(r["key"], (*stops, "SECCION")) | r["key"].rlike(r"^\d{1,2}\.?$") | (
        ~is_skipped(r["line"], r["key"]) & ~r["key"].isin(*W.FIELD_LABELS) & r["key"].rlike(DATE_LIKE)))
    own = _part(rows, at + 1, _first(ends, at + 1, F.size(rows)))
    return F.trim(F.array_join(_texts(F.filter(own, lambda r: ~is_skipped(r["line"], r["key"]) & ~r["key"].isin(*W.FIELD_LABELS))), " "))


def _labelled_rows(sections: DataFrame, key: str, kind: str, stops: tuple[str, ...]) -> DataFrame:
    """One row per name label: ``row`` holds its lines up to the next name label or section."""
    df = _pairs(sections.filter(F.col("kind") == kind))
    at = F.array_position(F.transform("keys", lambda k: has_piece(k, stops)), F.lit(True)).cast("int")
    df = df.transform(put, "_all", F.when(at > 0, F.slice("_all", F.lit(1), at - 1)).otherwise(F.col("_all")))
    df = df.transform(put, "_at", F.filter(F.transform("_all", lambda r, i: F.when(_is_label(r["key"], ("NOMBRE COMPLE",)), i)), lambda i: i.isNotNull()))
    df = df.select(key, "section_no", "keys", "_all", "_at", F.posexplode("_at").alias("member_no", "_from"))
    ends = F.transform("_all", lambda r: _is_label(r["key"], ("NOMBRE COMPLE", "RESUMEN", "SECCION")))
    df = df.transform(put, "row", _part(F.col("_all"), F.col("_from"), _first(ends, F.col("_from") + 1, F.size("_all"))))
    return df.drop("_all", "_at", "_from")


def _last_label(test) -> Column:
    """Position of the last line of ``row`` after the name label whose key passes."""
    return F.array_max(F.filter(F.transform("row", lambda r, i: F.when((i > 0) & test(r["key"]), i)), lambda i: i.isNotNull()))


def _field(test, stops: tuple[str, ...]) -> Column:
    at = _last_label(test)
    return F.when(at.isNotNull(), _value(F.col("row"), at, stops)).otherwise("")


def clean_wrapped_name(value: Column) -> Column:
    text = F.regexp_replace(value, r"(?i)\b(SELECCIONAR|LIMPIAR|FECHA|FACULTAD|CARRERA)\b", " ")
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"(?i)^(TO|O)\s+", ""))


def clean_career(value: Column) -> Column:
    """Without the own faculty in front."""
    key = parser_key(value)
    words = F.split(value, " +")
    drop = F.when(key.startswith("FACULTAD CIENCIAS ADMINISTRATIVAS"), 3).when(key.startswith("CIENCIAS ADMINISTRATIVAS"), 2).otherwise(0)
    return F.array_join(F.slice(words, drop + 1, F.greatest(F.size(words) - drop, F.lit(0))), " ")


def labelled_internal(sections: DataFrame, key: str) -> DataFrame:
    """Internal members of a table that names each value."""
    df = _labelled_rows(sections, key, "integrantes_internos", extract.INTERNAL_STOPS)
    name = _value(F.col("row"), F.lit(0), ("FACULTAD", "CARRERA", "FECHA DE INGRESO", "RESUMEN"))
    df = df.transform(put, "_name", clean_wrapped_name(name)).filter(P.is_member_text(F.col("_name")))
    df = df.transform(put, "_faculty", _field(lambda k: k == "FACULTAD", ("CARRERA", "FECHA DE INGRESO", "NOMBRE COMPLETO", "RESUMEN")))
    df = df.transform(put, "_career", clean_career(_field(lambda k: k == "CARRERA", ("FECHA DE INGRESO", "NOMBRE COMPLETO", "RESUMEN"))))
    df = extract.catalog_columns(extract.catalog_columns(df, "_faculty", W.FACULTY_CATALOG, "faculty"), "_career", W.CAREER_CATALOG, "career")
    return df.select(key, "section_no", "member_no", P.person_display(F.col("_name")).alias("name"), "faculty", "career", F.col("career").isNull().alias("requires_review"))


def labelled_external(sections: DataFrame, key: str) -> DataFrame:
    """External members and students of a table that names each value."""
    df = _labelled_rows(sections, key, "integrantes_externos", ("RESUMEN DEL PROYECTO", "SECCION 2"))
    name = _value(F.col("row"), F.lit(0), ("INSTITUCION EXTERNA", "FACULTAD", "CARRERA", "NOMBRE COMPLETO", "RESUMEN"))
    df = df.transform(put, "_name", clean_wrapped_name(name)).filter(P.is_member_text(F.col("_name")))
    df = df.transform(put, "_inst", _field(lambda k: k.contains("INSTITUCION EXTERNA"), ("NOMBRE COMPLETO", "RESUMEN")))
    df = df.transform(put, "_faculty", _field(lambda k: k == "FACULTAD", ("CARRERA", "NOMBRE COMPLETO", "RESUMEN"))).transform(put, "_career", _field(lambda k: k == "CARRERA", ("NOMBRE COMPLETO", "RESUMEN")))
    head = F.array_join(F.slice("keys", 1, 8), " ")
    usual = F.when(head.contains("ESTUDIANTE"), "estudiante").when(has_piece(head, ("GRADUADO", "EGRESADO")), "graduado").otherwise("investigador_externo")
    known = P.external_type(F.concat_ws(" ", "_name", "_inst", "_faculty", "_career"))
    unit = (F.col("_faculty") != "") | (F.col("_career") != "")
    kind = F.when((F.col("_inst") == "") & unit, "estudiante").when(known == "no_clasificado", usual).otherwise(known)
    df = df.transform(put, "participant_type", kind).transform(put, "_valid", P.institution_display(F.col("_inst")))
    own = F.col("participant_type").isin("estudiante", "graduado")
    return df.select(
        key, "section_no", "member_no", P.person_display(F.col("_name")).alias("name"), F.when(own, "Universidad de Guayaquil").otherwise(F.col("_valid")).alias("institution"),
        "participant_type", (own | F.col("_valid").isNull()).alias("requires_review"))


def catalog_scores(keys: Column, catalog: tuple[str, ...]) -> Column:
    """The best score of each key of an array against a catalog."""
    aliases = [" ".join(alias.upper().split()) for alias in catalog]

    @pandas_udf("array<double>")
    def scores(groups: pd.Series) -> pd.Series:
        known: dict[str, float] = {}
        for group in groups:
            for value in group:
                if value not in known:
                    known[value] = max(set_ratio(value, alias) for alias in aliases)
        return groups.map(lambda group: [known[value] for value in group])

    return scores(keys)


def career_start(parts: str) -> tuple[Column, Column, Column]:
    """Career scores of unlabelled lines, faculty scores of what stands before each, and where the career begins."""
    keys = F.transform(parts, lambda r: r["key"])
    before = F.transform(parts, lambda r, i: F.array_join(F.transform(F.slice(parts, F.lit(1), i), lambda p: p["key"]), " "))
    starts = F.transform(parts, lambda r, i: r["key"].contains("LICENCIATURA") | (F.get("_career_scores", i) >= 82) | (
        (i > 0) & (F.get("_before", i).contains("ADMINISTRATIVA") | (F.get("_faculty_scores", i) >= 90))))
    return catalog_scores(keys, W.CAREER_CATALOG), before, F.array_position(starts, F.lit(True)).cast("int")


# ---- several layouts together


def _written(sections: DataFrame, key: str, kind: str) -> DataFrame:
    """The sections of a kind, found once for all layouts that read them."""
    return cut_lineage(sections.filter(F.col("kind") == kind).select(key, "section_no", "kind", "lines", "keys"))


def merge_by_name(found: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """One row per name from several extractions: the first of them in order, or the first that has ``value`` if it has not."""
    rows = None
    for rank, part in enumerate(found):
        part = part.withColumn("_rank", F.lit(rank))
        rows = part if rows is None else rows.unionByName(part)
    kept = [c for c in rows.columns if c not in (*keys, "_rank")]
    named = rows.withColumn("_name", parser_key(F.col("name"))).filter("_name <> ''")
    order = F.struct(F.col(value).isNull(), F.col("_rank"), F.col("member_no"))
    best = named.groupBy(*keys, "_name").agg(F.min_by(F.struct(*kept, (F.col("_rank") + 1).alias("layout")), order).alias("_row"), F.count(F.lit(1)).alias("candidates"))
    return best.select(*keys, "_row.*", "candidates")


def internal_members(sections: DataFrame, key: str) -> DataFrame:
    """Internal members of both layouts, one row per name; ``layout`` 1 is the labelled one."""
    sections = _written(sections, key, "integrantes_internos")
    return merge_by_name([labelled_internal(sections, key), extract.internal_members(sections, key)], [key, "section_no"], "career")


def external_members(sections: DataFrame, key: str) -> DataFrame:
    """External members of both layouts, one row per name."""
    sections = _written(sections, key, "integrantes_externos")
    return merge_by_name([labelled_external(sections, key), extract.external_members(sections, key)], [key, "section_no"], "institution")


def scientific_products(sections: DataFrame, key: str) -> DataFrame:
    """Products of the labelled and stacked layouts, and of plain blocks in sections where neither finds one.

    Of equal titles the best candidate stays, the first on ties; discarded ones without authors and status go where a
    section has others.
    """
    sections = _written(sections, key, "produccion_cientifica")
    shared = [key, "section_no", "title", "authors", "status", "impact", "link", "validation_status", "kpi_eligible", "quality", "quality_reason"]
    by = lambda df, at, rank: df.select(*shared, F.struct(F.lit(rank).alias("layout"), F.col(at).cast("int").alias("at")).alias("place"))
    marked = by(extract.label_products(sections, key), "product_no", 0).unionByName(by(stacked_products(sections, key), "product_no", 1))
    plain = by(extract.product_records(extract.product_blocks(sections, key)), "block_no", 2)
    rows = cut_lineage(marked.unionByName(plain))
    ranked = rows.join(rows.groupBy(key, "section_no").agg(F.min(F.col("place.layout")).alias("_least")), [key, "section_no"])
    rows = ranked.filter((F.col("place.layout") < 2) | (F.col("_least") == 2)).drop("_least")
    low = (F.col("validation_status") == "discarded_invalid") & (F.size("authors") == 0) & F.col("status").isNull()
    marks = rows.withColumns({"_low": low, "_title": F.coalesce(F.nullif(parser_key(F.col("title")), F.lit("")), F.concat(F.lit("LINK:"), parser_key(F.col("link"))), F.lit(""))})
    solid = marks.groupBy(key, "section_no").agg(F.max(~F.col("_low")).alias("_solid"))
    kept = marks.join(solid, [key, "section_no"]).filter(~(F.col("_solid") & F.col("_low")))
    order = F.struct(-extract.candidate_score(), F.col("place"))
    own = [c for c in shared if c not in (key, "section_no")]
    best = kept.groupBy(key, "section_no", "_title").agg(F.min_by(F.struct(*own), order).alias("_row"), F.min("place").alias("_place"))
    folded = with_variant_keys(best.select(key, "section_no", "_place", "_row.*"), ["_place"], own)
    lists = folded.groupBy(key, "section_no").agg(F.array_sort(F.collect_list("_variant")).alias("_all"))  # the products of one section
    return lists.select(key, "section_no", F.posexplode(collapse_in_order(F.col("_all"))).alias("position", "_v")).select(key, "section_no", "position", "_v.row.*")


def with_variant_keys(products: DataFrame, order: list[str], kept: list[str]) -> DataFrame:
    """Adds ``_variant``: struct(order, title, authors, status, score, row) of each product, as ``collapse_in_order`` takes them."""
    authors = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform("authors", parser_key), lambda a: a != ""))), "|")
    return products.withColumn("_variant", F.struct(
        F.struct(*order).alias("order"), parser_key(F.col("title")).alias("title"), authors.alias("authors"), parser_key(F.coalesce("status", F.lit(""))).alias("status"),
        extract.candidate_score().alias("score"), F.struct(*kept).alias("row")))


def same_variant(a: Column, b: Column) -> Column:
    """One title begins or ends the other and has at most four words less, with the same authors and status."""
    short = F.when(F.length(a["title"]) <= F.length(b["title"]), a["title"]).otherwise(b["title"])
    long = F.when(F.length(a["title"]) <= F.length(b["title"]), b["title"]).otherwise(a["title"])
    words = lambda x: F.size(F.split(x, " +"))
    return (
        (short != "") & (short != long) & (long.startswith(short) | long.endswith(short)) & (words(long) - words(short) <= 4)
        & (a["authors"] != "") & (a["authors"] == b["authors"]) & (a["status"] == b["status"]))


def collapse_in_order(variants: Column) -> Column:
    """Products in order, each against those kept so far: a variant of a kept one takes its place if it scores better, else it goes."""
    def fold(kept: Column, product: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda k: same_variant(k, product)), F.lit(True)).cast("int")
        replaced = F.transform(kept, lambda k, i: F.when((i == at - 1) & (product["score"] > k["score"]), product).otherwise(k))
        return F.when(at > 0, replaced).otherwise(F.concat(kept, F.array(product)))

    return F.aggregate(variants, F.slice(variants, 1, 0), fold)


def assemble(docs: DataFrame, key: str, parts: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """``docs`` with an array of rows for each extraction (rows by key, and their order), and ``log``: (extraction, rows) of those that found any.

    The extractions become one table tagged by part, so one shuffle by key puts all rows of a document together.
    """
    tagged = None
    for name, (rows, order) in parts.items():
        row = F.struct(F.struct(*order).alias("order"), F.struct(*[c for c in rows.columns if c != key]).alias("row")).alias(name)
        own = rows.select(key, row)
        tagged = own if tagged is None else tagged.unionByName(own, allowMissingColumns=True)
    held = tagged.groupBy(key).agg(*[F.array_sort(F.collect_list(name)).alias(name) for name in parts])
    joined = docs.join(held, key, "left")
    lists = {name: F.coalesce(F.transform(name, lambda r: r["row"]), F.transform(F.slice(F.col(name), 1, 0), lambda r: r["row"]), F.from_json(F.lit("[]"), _type_of(rows, key))) for name, (rows, _) in parts.items()}
    whole = joined.withColumns(lists)
    return whole.withColumn("log", F.filter(F.array(*[F.struct(F.lit(name).alias("part"), F.size(name).alias("rows")) for name in parts]), lambda x: x["rows"] > 0))


def _type_of(rows: DataFrame, key: str):
    from pyspark.sql import types as T

    return T.ArrayType(T.StructType([f for f in rows.schema.fields if f.name != key]))


def compare_extractions(now: DataFrame, stored: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """Rows now and stored by ``kind``, and how many were gained and lost, as a difference of multisets."""
    both = now.select(kind, *columns, F.lit(1).alias("_now"), F.lit(0).alias("_then")).unionByName(stored.select(kind, *columns, F.lit(0).alias("_now"), F.lit(1).alias("_then")))
    counted = both.groupBy(kind, *columns).agg(F.sum("_now").alias("n"), F.sum("_then").alias("t"))
    return counted.groupBy(kind).agg(
        F.sum("n").alias("current"), F.sum("t").alias("stored"), F.sum(F.greatest(F.col("n") - F.col("t"), F.lit(0))).alias("gained"), F.sum(F.greatest(F.col("t") - F.col("n"), F.lit(0))).alias("lost"))
