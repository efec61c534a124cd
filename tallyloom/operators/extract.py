"""Tables inside report sections: members, projects, products, labelled values, counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallyloom.functions import people as P
from tallyloom.functions import titles
from tallyloom.functions import wordlists as W
from tallyloom.functions.stage import put
from tallyloom.functions.fuzzy import set_ratio
from tallyloom.functions.people import has_piece
from tallyloom.functions.text import collapse, parser_key, upper_key
from tallyloom.operators.lines import is_skipped

DATE = r"\d{1,4}[-/]\d{1,2}[-/]\d{1,4}"
NOISE = r"^\d+\s*/\s*\d+$|^\d+\s+DE\s+\d+$"


def best_alias(value: Column, catalog: tuple[str, ...]) -> Column:
    """struct(alias, score): the catalog entry with the highest token set ratio, the first on ties."""
    keys = [(alias, " ".join(alias.upper().split())) for alias in catalog]

    @pandas_udf("alias string, score double")
    def best(values: pd.Series) -> pd.DataFrame:
        known: dict[str, tuple[str, float]] = {}
        for value in values.unique():
            scored = [(set_ratio(value or "", key), alias) for alias, key in keys]
            score, alias = max(scored, key=lambda pair: pair[0])
            known[value] = (alias, score)
        rows = [known[v] for v in values]
        return pd.DataFrame({"alias": [r[0] for r in rows], "score": [r[1] for r in rows]})

    return best(parser_key(value))


def catalog_columns(df: DataFrame, value: str, catalog: tuple[str, ...], name: str) -> DataFrame:
    """Adds the validated value, its score and whether it needs review; a poor match keeps the text."""
    found = df.transform(put, "_b", best_alias(F.col(value), catalog))
    blank = F.coalesce(F.trim(F.col(value)), F.lit("")) == ""
    good = F.col("_b.score") >= 75
    return found.transform(put, name, F.when(~blank, F.when(good, F.col("_b.alias")).otherwise(collapse(F.col(value))))).transform(put, 
        f"{name}_score", F.when(blank, F.lit(0.0)).otherwise(F.col("_b.score"))).transform(put, 
        f"{name}_review", blank | ~good | (F.col("_b.score") < 90)).drop("_b")


def token_scores(lines: DataFrame) -> DataFrame:
    """Adds ``scores``: how well each header token of the table signatures fits the line key."""
    tokens = tuple(dict.fromkeys(t for _k, sig in W.TABLE_SIGNATURES for t in sig))

    @pandas_udf("array<double>")
    def score(keys: pd.Series) -> pd.Series:
        known = {key: [set_ratio(token, key or "") for token in tokens] for key in keys.unique()}
        return pd.Series([known[key] for key in keys])

    return lines.transform(put, "scores", score(F.col("line_key")))


def classify_tables(section_lines: DataFrame, keys: list[str]) -> DataFrame:
    """Table kind of a section by the mean best score of a signature over its first 12 lines."""
    tokens = list(dict.fromkeys(t for _k, sig in W.TABLE_SIGNATURES for t in sig))
    scored = token_scores(section_lines.filter("line_no < 12"))
    best = scored.groupBy(*keys).agg(*[F.max(F.get("scores", F.lit(i))).alias(f"t{i}") for i in range(len(tokens))])
    means = F.array(*[
        F.struct((sum((F.col(f"t{tokens.index(t)}") for t in sig), F.lit(0.0)) / len(sig)).alias("score"), F.lit(-i).alias("rank"), F.lit(kind).alias("kind"))
        for i, (kind, sig) in enumerate(W.TABLE_SIGNATURES)])
    top = best.transform(put, "_t", F.array_max(means))
    return top.select(*keys, F.when(F.col("_t.score") >= 75, F.col("_t.kind")).alias("table_kind"), F.round("_t.score", 4).alias("score"))


def classify_documents(docs: DataFrame, text: str = "text", filename: str = "filename") -> DataFrame:
    """Adds document type, status, score and the number of signals of each kind."""
    df = docs.transform(put, "_file", parser_key(F.col(filename))).transform(put, "_all", F.trim(F.concat_ws(" ", "_file", parser_key(F.col(text)))))
    hits = lambda signals: sum((F.col("_all").contains(s).cast("int") for s in signals), F.lit(0))
    df = df.transform(put, "mail_signals", hits(W.MAIL_SIGNALS)).transform(put, "form_signals", hits(W.FORM_SIGNALS)).transform(put, 
        "report_signals", hits(W.REPORT_SIGNALS) + F.col("_file").rlike(r"\bGI\d{3,}").cast("int")).transform(put, 
        "paperwork_signals", hits(W.PAPERWORK_SIGNALS))
    score = F.round(F.least(F.lit(100.0), F.col("report_signals") * 100.0 / len(W.REPORT_SIGNALS)), 4)
    accepted = (F.col("report_signals") >= 3) & (F.col("form_signals") >= 2)
    paperwork = (F.col("paperwork_signals") > 0) & (F.col("report_signals") <= 1)
    rows = lambda *v: F.struct(*[x.alias(n) for x, n in zip(v, ("document_type", "document_status", "score", "requires_review"))])
    result = (
        F.when(F.col("_all") == "", rows(F.lit("empty_pdf"), F.lit("ignored"), F.lit(0.0), F.lit(True)))
        .when(F.col("mail_signals") >= 4, rows(F.lit("email_capture"), F.lit("ignored"), F.lit(100.0), F.lit(False)))
        .when(accepted, rows(F.lit("progress_report"), F.lit("accepted"), score, F.lit(False)))
        .when(paperwork, rows(F.lit("administrative_document"), F.lit("ignored"), F.greatest(score, F.lit(40.0)), F.lit(False)))
        .otherwise(rows(F.lit("unknown"), F.lit("requires_review"), score, F.lit(True)))
    )
    return df.transform(put, "_r", result).select(*docs.columns, "_r.*", "mail_signals", "form_signals", "report_signals", "paperwork_signals")


def labelled_value(lines: Column, keys: Column, labels: tuple[str, ...], most: int) -> Column:
    """Lines after the first label that has any, up to a stop label; at most ``most`` lines are looked at."""
    def is_label(key: Column) -> Column:
        text = F.regexp_replace(F.regexp_replace(key, r"^\d+\s*[.)-]?\s*", ""), r"^[*: ]+|[*: ]+$", "")
        test = F.lit(False)
        for label in labels:
            test = test | (text == label) | text.startswith(label + " ")
        return test

    def is_stop(key: Column) -> Column:
        text = F.regexp_replace(key, r"^\d+\s*[.)-]?\s*", "")
        test = F.lit(False)
        for label in W.STOP_LABELS:
            test = test | text.startswith(label)
        return test

    noise = lambda k: (k == "") | k.rlike(NOISE) | has_piece(k, ("FORMULARIO DE INFORME", "JOTFORM")) | k.isin("FECHA", "SELECCIONAR", "LIMPIAR")

    def value_at(at: Column) -> Column:
        window = F.slice(F.zip_with(lines, keys, lambda a, b: F.struct(a.alias("line"), b.alias("key"))), at + 2, F.lit(most))
        judged = F.transform(window, lambda r: F.struct(r["line"].alias("line"), r["key"].alias("key"), (~noise(r["key"]) & is_stop(r["key"])).alias("stop")))
        stop = F.array_position(F.transform(judged, lambda r: r["stop"]), F.lit(True))
        open_rows = F.when(stop > 0, F.slice(judged, F.lit(1), (stop - 1).cast("int"))).otherwise(judged)
        kept = F.filter(open_rows, lambda r: ~noise(r["key"]) & ~is_label(r["key"]))
        return collapse(F.array_join(F.transform(kept, lambda r: r["line"]), " "))

    spots = F.filter(F.transform(keys, lambda k, i: F.when(is_label(k), i)), lambda i: i.isNotNull())
    return F.get(F.filter(F.transform(spots, value_at), lambda v: v != ""), F.lit(0))


def general_data(docs: DataFrame) -> DataFrame:
    """Adds one column per general label; needs ``lines`` and ``keys``."""
    return docs.select("*", *[
        labelled_value(F.col("lines"), F.col("keys"), labels, most).alias(f"label_{name}") for name, (labels, most) in W.GENERAL_LABELS.items()])


def digits(value: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(value, pattern, group), F.lit(""))


def entity_code(value: Column, kind: Column) -> Column:
    key = parser_key(value)
    seed = digits(key, r"(?:S\.?\s*I\.?\s*-?\s*)?(\d{2,4})")
    group = digits(key, r"(\bGI\d{3,}(?:-\d{4})?\b)")
    number, year = digits(key, r"(?:FCI-?)?(\d{2,4})(?:-(\d{4}))?"), digits(key, r"(?:FCI-?)?(\d{2,4})(?:-(\d{4}))?", 2)
    pad = lambda n: F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n)
    project = F.concat(F.lit("FCI-"), pad(number), F.coalesce(F.concat(F.lit("-"), year), F.lit("")))
    return (
        F.when(kind == "semillero", F.concat(F.lit("S.I-"), pad(seed))).when(kind == "grupo_investigacion", group)
        .when(key.contains("FCI") | (kind == "proyecto_fci"), project)
    )


def entity_kind(key: Column) -> Column:
    return (
        F.when(key.contains("SEMILLERO"), "semillero")
        .when(key.contains("GRUPO DE INVESTIGACION") | key.rlike(r"\bGI\d{3,}"), "grupo_investigacion")
        .when(has_piece(key, ("PROYECTO", "FCI")), "proyecto_fci")
        .when(key.contains("INFORME") & key.contains("INVESTIGACION"), "informe_seguimiento").otherwise("pendiente_clasificacion")
    )


def extract_entities(docs: DataFrame, key: str) -> DataFrame:
    """The research entity a report is about; needs ``lines`` and ``keys`` (the first 120 lines set its type)."""
    head = parser_key(F.array_join(F.slice("lines", 1, 120), " "))
    df = general_data(docs).transform(put, "_head", head)
    mail = has_piece(F.col("_head"), ("OUTLOOK", "BANDEJA DE ENTRADA", "RE:", "FW:", "CAPTURA DE PANTALLA"))
    df = df.transform(put, "_mail", mail & ~has_piece(F.col("_head"), ("PROYECTO", "INVESTIGACION"))).transform(put, "entity_type", entity_kind(F.col("_head")))
    fallback = (
        F.when(F.col("entity_type") == "grupo_investigacion", digits(F.col("_head"), r"(\bGI\d{3,}(?:-\d{4})?\b)"))
        .when(F.col("entity_type") == "semillero", digits(F.col("_head"), r"(\bS\.?\s*I\.?\s*-?\s*\d{2,4}\b)"))
        .otherwise(digits(F.col("_head"), r"(\bFCI-?\d{2,4}(?:-\d{4})?\b)")))
    df = df.transform(put, "code", F.coalesce(entity_code(F.col("label_code"), F.col("entity_type")), entity_code(fallback, F.col("entity_type"))))
    progress_at = F.filter(F.transform("keys", lambda k, i: F.when(has_piece(k, ("AVANCE", "PROGRESO")), i)), lambda i: i.isNotNull())
    progress = F.get(F.filter(F.transform(progress_at, lambda i: digits(F.array_join(F.slice("lines", i + 1, F.lit(8)), " "), r"(\d{1,3})\s*%")), lambda v: v.isNotNull()), F.lit(0))
    state = F.get(F.filter(F.transform("keys", lambda k: F.when(k.contains("APROBADO"), "aprobado").when(
        has_piece(k, ("VIGENTE", "EJECUCION")), "vigente").when(k.contains("EN PROCESO"), "en_proceso")), lambda s: s.isNotNull()), F.lit(0))
    cycle_key = parser_key(F.col("label_cycle"))
    title, director = F.nullif(F.col("label_title"), F.lit("")), F.nullif(F.col("label_director"), F.lit(""))
    found = F.col("code").isNotNull().cast("int") + title.isNotNull().cast("int") + director.isNotNull().cast("int")
    known = F.col("entity_type").isin("proyecto_fci", "grupo_investigacion", "semillero") & (F.col("code").isNotNull() | title.isNotNull())
    kept = F.col("_mail") | (found > 0) | (F.col("entity_type") != "pendiente_clasificacion")
    mailed = lambda c: F.when(~F.col("_mail"), c)
    return df.filter(kept).select(
        key, F.when(F.col("_mail"), "documento_no_relevante").otherwise(F.col("entity_type")).alias("entity_type"),
        mailed(F.col("code")).alias("code"), mailed(title).alias("title"), mailed(director).alias("director"),
        mailed(digits(F.col("label_year"), r"(20\d{2})").cast("int")).alias("year"),
        mailed(F.when(cycle_key.contains("II") | cycle_key.endswith("2"), 2).when(cycle_key.contains("I") | cycle_key.endswith("1"), 1)).alias("cycle"),
        mailed(F.least(F.lit(100.0), progress.cast("double"))).alias("progress_percentage"), mailed(state).alias("status"),
        F.when(F.col("_mail"), "discarded_invalid").when(known & title.isNotNull() & director.isNotNull(), "validated").otherwise("pending_review").alias("validation_status"),
        F.when(F.col("_mail"), F.lit(0.9)).otherwise(F.round(F.least(F.lit(0.95), F.lit(0.35) + found * F.lit(0.2)), 4)).alias("confidence_score"))


def path_entities(files: DataFrame, key: str, name: str, path: str, review: str | None = None) -> DataFrame:
    """Groups and seedbeds named by the file, and a pending entity for a file that names none."""
    source = upper_key(F.concat_ws(" ", name, path))
    df = files.transform(put, "_k", source)
    group_code, seed_code = r"(\bGI\s*[-.]?\s*\d{1,4}(?:\s*[-.]?\s*\d{2,4})?\b)", r"(\bS\s*\.?\s*I\s*[-.]?\s*\d{1,4}\b)"
    is_group = F.col("_k").contains("GRUPO DE INVESTIGACION") | F.col("_k").rlike(r"\bGI\s*[-.]?\s*\d{1,4}")
    is_seed = F.col("_k").contains("SEMILLERO") | F.col("_k").rlike(r"\bS\s*\.?\s*I\s*[-.]?\s*\d{1,4}\b")
    code = lambda p: F.regexp_replace(F.replace(digits(F.col("_k"), p), F.lit("."), F.lit("-")), r"\s+", "")
    pending = F.col(review) == "PENDIENTE_REVISION" if review else F.lit(False)
    rows = F.array_compact(F.array(
        F.when(is_group, F.struct(F.lit("grupo_investigacion").alias("entity_type"), code(group_code).alias("code"), F.lit("validado").alias("validation_status"))),
        F.when(is_seed, F.struct(F.lit("semillero").alias("entity_type"), code(seed_code).alias("code"), F.lit("validado").alias("validation_status"))),
        F.when(~is_group & ~is_seed & pending, F.struct(F.lit("pendiente_ocr").alias("entity_type"), F.lit(None).cast("string").alias("code"), F.lit("pendiente_ocr").alias("validation_status"))),
    ))
    return df.select(key, F.explode(rows).alias("e")).select(key, "e.*")


def _rows(sections: DataFrame, kind: str, stops: tuple[str, ...] = ()) -> DataFrame:
    """Sections of a kind with ``rows``: useful lines with their key, cut at a stop marker."""
    df = sections.filter(F.col("kind") == kind)
    pairs = F.zip_with("lines", "keys", lambda a, b: F.struct(a.alias("line"), b.alias("key")))
    if stops:
        at = F.array_position(F.transform("keys", lambda k: has_piece(k, stops)), F.lit(True))
        pairs = F.when(at > 0, F.slice(pairs, F.lit(1), (at - 1).cast("int"))).otherwise(pairs)
    df = df.transform(put, "_pairs", pairs)
    return df.transform(put, "rows", F.filter("_pairs", lambda r: ~is_skipped(r["line"], r["key"]))).drop("_pairs")


def _line(rows: Column, at: Column) -> Column:
    return F.get(rows, at)["line"]


def _join(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: r["line"]), " ")


def project_rows(sections: DataFrame, key: str) -> DataFrame:
    """Project table rows: code line, name, director in up to four lines before the progress line, status after it."""
    pairs = F.zip_with("lines", "keys", lambda a, b: F.struct(a.alias("line"), b.alias("key")))
    df = sections.filter("kind = 'proyectos_fci'").transform(put, "_all", pairs)
    df = df.transform(put, "_codes", F.filter(F.transform("keys", lambda k, i: F.when(k.rlike(r"^FCI\d{3,}-?\d{4}$"), i)), lambda i: i.isNotNull()))
    df = df.select(key, "section_no", "_all", "_codes", F.posexplode("_codes").alias("_n", "_at"))
    end = F.coalesce(F.get("_codes", F.col("_n") + 1), F.size("_all"))
    df = df.transform(put, "code", F.get("_all", F.col("_at"))["line"]).transform(put, 
        "_block", F.filter(F.slice("_all", F.col("_at") + 2, end - F.col("_at") - 1), lambda r: ~is_skipped(r["line"], r["key"])))
    df = df.transform(put, "_p", F.array_position(F.transform("_block", lambda r: r["line"].rlike(r"^\d+%$")), F.lit(True)).cast("int")).filter("_p > 0")
    df = df.transform(put, "_before", F.slice("_block", F.lit(1), F.col("_p") - 1))
    size = F.lit(0)
    for n in (1, 2, 3, 4):  # the longest run that makes a name wins
        fits = (F.size("_before") >= n) & P.looks_like_person(_join(F.slice("_before", F.size("_before") - (n - 1), F.lit(n))))
        size = F.when(F.coalesce(fits, F.lit(False)), n).otherwise(size)
    df = df.transform(put, "_size", F.when(F.size("_before") > 0, size).otherwise(0))
    director = F.when(F.col("_size") > 0, P.person_display(_join(F.slice("_before", F.size("_before") - F.col("_size") + 1, F.col("_size")))))
    df = df.transform(put, "director", F.coalesce(director, F.lit("Director no detectado"))).transform(put, 
        "name", F.trim(_join(F.slice("_before", F.lit(1), F.size("_before") - F.col("_size"))))).transform(put, 
        "progress", _line(F.col("_block"), F.col("_p") - 1)).transform(put, "_status", _line(F.col("_block"), F.col("_p")))
    df = catalog_columns(df, "_status", W.STATUS_CATALOG, "status")
    return df.select(key, "section_no", F.col("_n").alias("project_no"), "code", "name", "director", "progress", F.coalesce("status", F.lit("")).alias("status"), "status_review")


def row_walk(starts: Column, sizes: Column, stops: Column, total: Column, whole: Column | None = None) -> Column:
    """Positions taken as record starts when each record swallows the lines up to the next stop.

    Where ``whole`` is set, a record is its own lines alone.
    """
    step = F.sequence(F.lit(0), F.greatest(total - 1, F.lit(0)))

    def merge(state: Column, i: Column) -> Column:
        take = (i >= state["free"]) & F.coalesce(F.get(starts, i), F.lit(False))
        after = i + F.get(sizes, i)
        following = F.coalesce(F.array_min(F.filter(stops, lambda s: s >= after)), total)
        if whole is not None:
            following = F.when(F.get(whole, i), after).otherwise(following)
        return F.struct(
            F.when(take, following).otherwise(state["free"]).alias("free"),
            F.when(take, F.concat(state["taken"], F.array(F.struct(i.alias("at"), F.get(sizes, i).alias("size"), following.alias("end"))))).otherwise(state["taken"]).alias("taken"))

    initial = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<at:int,size:int,end:int>>").alias("taken"))
    return F.aggregate(step, initial, merge, lambda s: s["taken"])


INTERNAL_STOPS = ("INVESTIGADORES QUE SE DESVINCULAN", "INVESTIGADORES EXTERNOS", "ESTUDIANTES QUE PARTICIPAN", "RESUMEN DEL PROYECTO", "SECCION 2")


def internal_members(sections: DataFrame, key: str) -> DataFrame:
    """Internal member rows: name (one or two lines), then faculty and career lines up to the next name or date."""
    df = _rows(sections, "integrantes_internos", INTERNAL_STOPS).transform(put, "_n", F.size("rows"))
    one = F.transform("rows", lambda r: P.looks_like_person(r["line"]))
    two = F.transform("rows", lambda r, i: F.coalesce(P.looks_like_person(F.concat_ws(" ", r["line"], _line(F.col("rows"), i + 1))) & (i + 1 < F.col("_n")), F.lit(False)))
    df = df.transform(put, "_one", one).transform(put, "_two", two)
    sizes = F.transform("_two", lambda t: F.when(t, 2).otherwise(1))
    starts = F.transform("rows", lambda r, i: (F.get("_one", i) | F.get("_two", i)) & P.is_member_text(
        F.when(F.get("_two", i), F.concat_ws(" ", r["line"], _line(F.col("rows"), i + 1))).otherwise(r["line"])))
    stops = F.filter(F.transform("rows", lambda r, i: F.when(has_piece(r["key"], W.MONTHS) | F.get("_one", i) | r["key"].rlike(DATE), i)), lambda i: i.isNotNull())
    df = df.transform(put, "_starts", starts).transform(put, "_sizes", sizes).transform(put, "_stops", stops)
    df = df.filter("_n > 0").transform(put, "_taken", row_walk(F.col("_starts"), F.col("_sizes"), F.col("_stops"), F.col("_n")))
    df = df.select(key, "section_no", "rows", F.posexplode("_taken").alias("member_no", "_t"))
    df = df.transform(put, "name", P.person_display(_join(F.slice("rows", F.col("_t.at") + 1, F.col("_t.size"))))).transform(put, 
        "_parts", F.slice("rows", F.col("_t.at") + F.col("_t.size") + 1, F.col("_t.end") - F.col("_t.at") - F.col("_t.size")))
    from tallyloom.operators.layouts import career_start, catalog_scores, clean_career

    careers, before, first = career_start("_parts")
    df = df.transform(put, "_career_scores", careers).transform(put, "_before", before).transform(put, "_faculty_scores", catalog_scores(F.col("_before"), W.FACULTY_CATALOG))
    df = df.transform(put, "_c", F.when(first > 0, first - 1).otherwise(F.size("_parts")))
    df = df.transform(put, "_faculty", _join(F.slice("_parts", F.lit(1), F.col("_c")))).transform(put, 
        "_career", clean_career(_join(F.slice("_parts", F.col("_c") + 1, F.size("_parts") - F.col("_c")))))
    df = catalog_columns(catalog_columns(df, "_faculty", W.FACULTY_CATALOG, "faculty"), "_career", W.CAREER_CATALOG, "career")
    return df.select(key, "section_no", "member_no", "name", "faculty", "career", F.col("career").isNull().alias("requires_review"))


def external_members(sections: DataFrame, key: str) -> DataFrame:
    """External member rows: an institution line before the name, or institution lines after it."""
    df = _rows(sections, "integrantes_externos", ("RESUMEN DEL PROYECTO", "SECCION 2")).transform(put, "_n", F.size("rows")).filter("_n > 0")
    df = df.transform(put, "_one", F.transform("rows", lambda r: P.looks_like_person(r["line"]))).transform(put, 
        "_inst", F.transform("rows", lambda r: P.institution_display(r["line"])))
    before = F.transform("rows", lambda r, i: F.coalesce(~F.get("_one", i) & F.get("_one", i + 1) & F.get("_inst", i).isNotNull(), F.lit(False)))
    df = df.transform(put, "_before", before)
    starts = F.transform("rows", lambda r, i: F.get("_before", i) | F.get("_one", i))
    sizes = F.transform("_before", lambda b: F.when(b, 2).otherwise(1))
    stops = F.filter(F.transform("rows", lambda r, i: F.when(F.get("_one", i) | r["key"].rlike("^1[78]"), i)), lambda i: i.isNotNull())
    df = df.transform(put, "_starts", starts).transform(put, "_sizes", sizes).transform(put, "_stops", stops)
    df = df.transform(put, "_taken", row_walk(F.col("_starts"), F.col("_sizes"), F.col("_stops"), F.col("_n"), F.col("_before")))
    df = df.select(key, "section_no", "rows", "_inst", F.posexplode("_taken").alias("member_no", "_t"))
    pair = F.col("_t.size") == 2
    df = df.transform(put, "_name", _line(F.col("rows"), F.col("_t.at") + F.col("_t.size") - 1)).transform(put, 
        "_parts", F.filter(F.slice("rows", F.col("_t.at") + 2, F.col("_t.end") - F.col("_t.at") - 1), lambda r: ~r["key"].contains("JOTFORM") & ~P.is_url(r["line"])))
    df = df.transform(put, "_context", F.when(pair, _join(F.slice("rows", F.col("_t.at") + 1, F.lit(2)))).otherwise(F.concat_ws(" ", "_name", _join(F.col("_parts")))))
    df = df.transform(put, "institution", F.when(pair, F.get("_inst", F.col("_t.at"))).otherwise(P.institution_display(_join(F.col("_parts"))))).transform(put, 
        "participant_type", P.external_type(F.col("_context")))
    student = F.col("participant_type").isin("estudiante", "graduado")
    return df.filter(F.col("institution").isNotNull() | student).select(
        key, "section_no", "member_no", P.person_display(F.col("_name")).alias("name"),
        F.coalesce("institution", F.lit("Universidad de Guayaquil")).alias("institution"), "participant_type", F.col("institution").isNull().alias("requires_review"))


def directors(sections: DataFrame, key: str) -> DataFrame:
    """The first name in the first twelve useful lines of a director section."""
    df = _rows(sections, "director_responsable")
    first = F.get(F.filter(F.slice("rows", 1, 12), lambda r: P.looks_like_person(r["line"])), F.lit(0))["line"]
    role = F.when(has_piece(parser_key(F.col("title")), ("DIRECTOR", "COORDINADOR")), "director").otherwise("responsable_informe")
    return df.transform(put, "_f", first).filter("_f IS NOT NULL").select(key, "section_no", P.person_display(F.col("_f")).alias("name"), role.alias("role_type"))


def _is_tail(line: Column, key: Column) -> Column:
    return F.coalesce(key.isin("IMPACTO", "MUNDIAL", "REGIONAL", "IMPACTO MUNDIAL", "IMPACTO REGIONAL") | P.is_url(line), F.lit(False))


def product_blocks(sections: DataFrame, key: str) -> DataFrame:
    """Blocks of lines that each hold one product: closed by a link, or by a status or impact line that no other follows."""
    df = _rows(sections, "produccion_cientifica").transform(put, "_n", F.size("rows")).filter("_n > 0")
    df = df.transform(put, "_facts", F.transform("rows", lambda r, i: F.struct(
        P.is_url(r["line"]).alias("url"), P.product_status(r["key"]).isNotNull().alias("status"), _is_tail(r["line"], r["key"]).alias("tail"),
        _is_tail(_line(F.col("rows"), i + 1), F.get("rows", i + 1)["key"]).alias("next_tail"))))

    def merge(state: Column, i: Column) -> Column:
        f = F.get("_facts", i)
        status = state["status"] | f["status"]
        close = f["url"] | (status & (f["status"] | f["tail"]) & ~f["next_tail"])
        return F.struct(
            F.when(close, i + 1).otherwise(state["start"]).alias("start"), (status & ~close).alias("status"),
            F.when(close, F.concat(state["blocks"], F.array(F.struct(state["start"].alias("at"), (i + 1).alias("end"))))).otherwise(state["blocks"]).alias("blocks"))

    initial = F.struct(F.lit(0).alias("start"), F.lit(False).alias("status"), F.array().cast("array<struct<at:int,end:int>>").alias("blocks"))
    finish = lambda s: F.when(s["start"] < F.col("_n"), F.concat(s["blocks"], F.array(F.struct(s["start"].alias("at"), F.col("_n").alias("end"))))).otherwise(s["blocks"])
    df = df.transform(put, "_blocks", F.aggregate(F.sequence(F.lit(0), F.col("_n") - 1), initial, merge, finish))
    df = df.select(key, "section_no", "rows", F.posexplode("_blocks").alias("block_no", "_b"))
    return df.select(key, "section_no", "block_no", F.slice("rows", F.col("_b.at") + 1, F.col("_b.end") - F.col("_b.at")).alias("block"))


def rebuilt_link(parts: Column) -> Column:
    """The pieces of a wrapped link as one, its scheme mended."""
    joined = F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit(" "), F.lit(""))), "")
    return F.replace(F.replace(joined, F.lit("https//"), F.lit("https://")), F.lit("http//"), F.lit("http://"))


def product_records(blocks: DataFrame) -> DataFrame:
    """Title, authors, status, impact and link of each block, with its validation status."""
    df = blocks.transform(put, "_person", F.transform("block", lambda r, i: (i > 0) & P.looks_like_person(r["line"])))
    df = df.transform(put, "_authors", F.filter(F.transform("block", lambda r, i: F.when(F.get("_person", i), r["line"])), lambda a: a.isNotNull())).transform(put, 
        "_first", F.array_position("_person", F.lit(True)).cast("int"))
    exact = ("PUBLICADO", "ENVIADO A REVISION", "ACEPTADO", "EN REVISION")
    df = df.transform(put, "status", F.get(F.filter("block", lambda r: r["key"].isin(*exact)), F.lit(0))["line"]).transform(put, 
        "impact", F.get(F.filter("block", lambda r: r["key"].contains("IMPACTO")), F.lit(0))["line"])
    link = rebuilt_link(F.transform(F.filter("block", lambda r: P.is_url(r["line"])), lambda r: r["line"]))
    df = df.transform(put, "link", F.nullif(link, F.lit("")))
    loose = F.filter("block", lambda r: ~F.coalesce(r["line"] == F.col("status"), F.lit(False)) & ~F.coalesce(r["line"] == F.col("impact"), F.lit(False)) & ~P.is_url(r["line"]))
    parts = F.when(F.col("_first") > 0, F.slice("block", F.lit(1), F.col("_first") - 1)).otherwise(loose)
    df = df.transform(put, "title", F.nullif(titles.join_wrapped(F.transform(parts, lambda r: r["line"])), F.lit("")))
    df = df.transform(put, "title", F.coalesce("title", "link")).filter("title IS NOT NULL")
    df = titles.with_title_quality(df, "title")
    invalid, has_authors = F.col("quality") == "invalid", F.size("_authors") > 0
    status = F.when(invalid, "discarded_invalid").when(has_authors & (F.col("quality") == "valid"), "validado").otherwise("pending_review")
    authors = F.when(invalid, F.array().cast("array<string>")).otherwise(F.transform(F.slice("_authors", 1, 5), P.person_display))
    missing = F.array_compact(F.array(F.when(~has_authors, F.lit("authors")), F.when(F.col("status").isNull(), F.lit("status")), F.when(F.col("impact").isNull(), F.lit("impact")), F.when(F.col("link").isNull(), F.lit("link"))))
    kept = [c for c in blocks.columns if c != "block"]
    return df.select(*kept, "title", authors.alias("authors"), "status", "impact", "link", status.alias("validation_status"),
                     (status == "validado").alias("kpi_eligible"), "quality", "quality_reason", missing.alias("fields_missing"))


PRODUCT_LABELS = {"title": ("TITULO",), "authors": ("AUTOR", "AUTOR 1", "AUTOR 2", "AUTOR 3", "AUTOR 4", "AUTOR 5"), "status": ("ESTADO",), "impact": ("IMPACTO", "IMPACT"), "editorial": ("EDITORIAL",), "link": ("LINK",)}


def label_products(sections: DataFrame, key: str) -> DataFrame:
    """Products laid out as label and value lines, one block per title label.

    A title label that a new page repeats, before the row has had any other label, continues the title.
    """
    labels = tuple(x for group in PRODUCT_LABELS.values() for x in group)
    pairs = F.zip_with("lines", "keys", lambda a, b: F.struct(a.alias("line"), b.alias("key")))
    is_title = lambda k: k.isin(*PRODUCT_LABELS["title"]) | k.startswith("TITULO ")
    is_label = lambda k: is_title(k) | k.isin(*labels) | k.startswith("AUTOR")
    df = sections.filter("kind = 'produccion_cientifica'").transform(put, "rows", pairs)
    spots = lambda test: F.filter(F.transform("rows", lambda r, i: F.when(test(r), i)), lambda i: i.isNotNull())
    page = lambda r: r["line"].rlike(r"(?i)^\[\[PAGE_BREAK(?::\d+)?\]\]$") | r["key"].rlike(r"^\d+(?:\s+DE\s+|/)\d+$")
    df = df.transform(put, "_titles", spots(lambda r: is_title(r["key"]))).transform(put, "_pages", spots(page)).transform(put, "_others", spots(lambda r: is_label(r["key"]) & ~is_title(r["key"])))
    between = lambda found, at, n: F.exists(found, lambda p: (p > F.get("_titles", n - 1)) & (p < at))
    df = df.transform(put, "_again", F.filter("_titles", lambda at, n: (n > 0) & between("_pages", at, n) & ~between("_others", at, n)))
    df = df.transform(put, "_useful", F.filter("rows", lambda r, i: ~F.array_contains("_again", i) & (is_label(r["key"]) | ~is_skipped(r["line"], r["key"]))))
    df = df.drop("rows", "_titles", "_pages", "_others", "_again").withColumnRenamed("_useful", "rows")
    df = df.transform(put, "_at", F.filter(F.transform("rows", lambda r, i: F.when(is_title(r["key"]), i)), lambda i: i.isNotNull()))
    df = df.select(key, "section_no", "rows", "_at", F.posexplode("_at").alias("product_no", "_from"))
    end = F.coalesce(F.get("_at", F.col("product_no") + 1), F.size("rows"))
    df = df.transform(put, "_block", F.slice("rows", F.col("_from") + 1, end - F.col("_from")))
    name = lambda k: F.when(is_title(k), "TITULO").when(k.startswith("AUTOR"), "AUTOR").when(k == "IMPACT", "IMPACTO").otherwise(k)
    df = df.transform(put, "_labels", F.filter(F.transform("_block", lambda r, i: F.when(is_label(r["key"]), F.struct(i.alias("at"), name(r["key"]).alias("key")))), lambda x: x.isNotNull()))

    def values(label: str) -> Column:
        stop = lambda n: F.coalesce(F.get("_labels", n + 1)["at"], F.size("_block"))
        ends = lambda r: r["key"].rlike(r"^\d{1,2}\.?$") | r["key"].startswith("SECCION") | r["key"].rlike(DATE)

        def text(x: Column, n: Column) -> Column:
            own = F.slice("_block", x["at"] + 2, stop(n) - x["at"] - 1)
            cut = F.array_position(F.transform(own, ends), F.lit(True)).cast("int")
            kept = F.when(cut > 0, F.slice(own, F.lit(1), cut - 1)).otherwise(own)
            return titles.join_wrapped(F.transform(kept, lambda r: r["line"]))

        return F.filter(F.transform("_labels", lambda x, n: F.when(x["key"] == label, text(x, n))), lambda v: v.isNotNull() & (v != ""))

    first = lambda label: F.get(values(label), F.lit(0))
    df = df.transform(put, "title", F.coalesce(first("TITULO"), F.lit(""))).filter("title <> ''")
    df = df.transform(put, "_authors", F.filter(values("AUTOR"), P.looks_like_person)).transform(put, "_state", first("ESTADO"))
    df = df.transform(put, "status", F.coalesce(P.product_status(F.col("_state")), F.col("_state"))).transform(put, "impact", P.impact_of(first("IMPACTO"))).transform(put, "link", rebuilt_link(F.split(first("LINK"), " ")))
    df = titles.with_title_quality(df, "title")
    invalid, valid, has_authors, has_status = F.col("quality") == "invalid", F.col("quality") == "valid", F.size("_authors") > 0, F.col("status").isNotNull()
    df = df.filter(F.when(invalid, has_authors | has_status).otherwise(has_authors | has_status | valid))
    state = F.when(invalid, "discarded_invalid").when(valid & has_authors & has_status, "validado").otherwise("pending_review")
    authors = F.when(invalid, F.array().cast("array<string>")).otherwise(F.transform("_authors", P.person_display))
    return df.select(key, "section_no", "product_no", "title", authors.alias("authors"), "status", "impact", "link", state.alias("validation_status"), (state == "validado").alias("kpi_eligible"), "quality", "quality_reason")


def interchange_rows(sections: DataFrame, key: str) -> DataFrame:
    """Faculty, type and title triples; a taken triple is not read again."""
    df = _rows(sections, "intercambios").transform(put, "_n", F.size("rows")).filter("_n >= 3")
    starts = F.transform("rows", lambda r, i: F.coalesce(F.get("rows", i + 1)["key"].isin(*W.INTERCHANGE_TYPES) & (i + 2 < F.col("_n")), F.lit(False)))
    df = df.transform(put, "_starts", starts)

    def merge(state: Column, i: Column) -> Column:
        take = (i >= state["free"]) & F.get("_starts", i)
        return F.struct(F.when(take, i + 3).otherwise(state["free"]).alias("free"), F.when(take, F.concat(state["taken"], F.array(i))).otherwise(state["taken"]).alias("taken"))

    initial = F.struct(F.lit(0).alias("free"), F.array().cast("array<int>").alias("taken"))
    df = df.transform(put, "_at", F.aggregate(F.sequence(F.lit(0), F.col("_n") - 1), initial, merge, lambda s: s["taken"]))
    df = df.select(key, "section_no", "rows", F.posexplode("_at").alias("item_no", "_i"))
    return df.select(key, "section_no", "item_no", *[_line(F.col("rows"), F.col("_i") + n).alias(c) for n, c in enumerate(("faculty", "exchange_type", "title"))])


def collapse_variants(products: DataFrame, group: list[str], position: str) -> DataFrame:
    """Products without those whose title is a beginning or end of another's (or the reverse) by at most four
    words, same authors and status, where the other scores better, or as well and comes first.

    The shorter title is one of the few beginnings or ends of the longer one that drop at most four
    words, so titles meet on those; no pairs of a group are built.
    """
    df = products.transform(put, "_t", parser_key(F.col("title"))).transform(put, "_a", F.array_join(F.array_sort(F.array_distinct(F.transform("authors", parser_key))), "|")).transform(put, 
        "_s", parser_key(F.coalesce("status", F.lit("")))).transform(put, "_score", candidate_score())
    keyed = df.filter("_t <> '' AND _a <> ''")
    lens = F.length("_t")
    words = lambda x: F.size(F.split(F.trim(x), r" +"))
    cuts = F.sequence(F.lit(1), F.greatest(lens - 1, F.lit(1)))
    heads = F.transform(cuts, lambda n: F.substring(F.col("_t"), F.lit(1), n))
    tails = F.transform(cuts, lambda n: F.substring(F.col("_t"), lens - n + 1, n))
    near = F.array_distinct(F.filter(F.concat(heads, tails), lambda x: (x != F.col("_t")) & (F.length(F.trim(x)) > 0) & (words(F.col("_t")) - words(x) <= 4)))
    me = ["_a", "_s", *group]
    long = keyed.select(*me, F.col(position).alias("_lp"), F.col("_score").alias("_ls"), F.explode(near).alias("_t"))
    pairs = keyed.select(*me, "_t", F.col(position).alias("_sp"), F.col("_score").alias("_ss")).join(long, [*me, "_t"])
    short_loses = (F.col("_ls") > F.col("_ss")) | ((F.col("_ls") == F.col("_ss")) & (F.col("_lp") < F.col("_sp")))
    losers = pairs.select(*group, F.when(short_loses, F.col("_sp")).otherwise(F.col("_lp")).alias(position)).distinct()
    return df.join(losers, [*group, position], "left_anti").drop("_t", "_a", "_s", "_score")


def candidate_score() -> Column:
    quality = F.when(F.col("quality") == "valid", 60).when(F.col("quality") == "truncated", 25).otherwise(-40)
    given = lambda c, n: F.when(F.coalesce(F.col(c), F.lit("")) != "", n).otherwise(0)
    state = F.when(F.col("validation_status") == "validado", 12).when(F.col("validation_status") == "discarded_invalid", -80).otherwise(0)
    return quality + F.least(F.size("authors"), F.lit(5)) * 8 + given("status", 8) + given("impact", 4) + given("link", 4) + state


def text_counts(docs: DataFrame, text: str) -> DataFrame:
    """Counts named in the text (a number before a keyword, capped), its cycle and its year label.

    Digits inside a longer number or code, as of a card, are no year label.
    """
    df = docs.transform(put, "_k", upper_key(F.col(text)))

    def before(words: tuple[str, ...], most: int) -> Column:
        numbers = [digits(F.col("_k"), rf"(\d+)\s+{w}") for w in words]
        # a number too long for a bigint is above any cap
        found = F.coalesce(*[F.when(n.isNotNull(), F.coalesce(n.try_cast("bigint"), F.lit(most))) for n in numbers], F.lit(0))
        return F.least(found, F.lit(most)).cast("int")

    def year_label(a: int, b: int) -> str:
        return rf"(?i)(?<!\d)20{a}\s*[-/]\s*20{b}(?!\d)|CI\s*{a}\s*{b}(?!\d)|C[I1]\s*{a}{b}(?!\d)|(?<![\p{{L}}\d])\p{{L}}*{a}{b}(?![\p{{L}}\d])"

    chapters = before(("CAPITULOS", "CAPITULO"), 3)
    cycle = digits(F.col("_k"), r"CICLO\s+(I{1,2}|1|2|\|)")
    now, past = year_label(25, 26), year_label(24, 25)
    return df.select(
        *docs.columns, before(("ARTICULOS", "ARTICULO"), 5).alias("articles"), before(("LIBROS", "LIBRO"), 3).alias("books"),
        F.when(chapters > 0, chapters).when(has_piece(F.col("_k"), ("CAP DE LIBROS", "CAPITULO DE LIBRO")), 1).otherwise(0).alias("book_chapters"),
        before(("PONENCIAS", "PONENCIA", "CONGRESOS", "CONGRESO"), 3).alias("presentations"),
        F.when(cycle.isin("2", "II"), 2).otherwise(1).alias("cycle"),
        F.when(F.col(text).rlike(now), "2025-2026").when(F.col(text).rlike(past), "2024-2025").otherwise("2025-2026").alias("year_label"))


def reconcile_products(products: DataFrame, key: list[str], order: list[Column], slice_of: Column | None = None) -> DataFrame:
    """Reconciliation status of each product: duplicate, no title, invalid, truncated, pending, counted."""
    from tallyloom.operators import skew

    df = products.transform(put, "_key", titles.product_key(F.col("product_type"), F.col("link"), F.col("title")))
    df = skew.positions(df, ["_key"], order, slice_of, "_pos").transform(put, "duplicate", (F.col("_key") != "") & (F.col("_pos") > 1))
    df = titles.with_clean_title(df.drop("quality", "quality_reason"), "title", "authors")
    df = df.transform(put, "_shown", F.coalesce("clean_title", titles.clean_name(F.col("title"))))
    df = titles.with_title_quality(df, "_shown")
    state = F.when(F.col("quality") == "truncated", "pending_review").when(F.col("quality") == "invalid", "discarded_invalid").otherwise(F.col("validation_status"))
    df = df.transform(put, "validation_status", state)
    counted = ~F.col("duplicate") & F.col("clean_title").isNotNull() & (F.col("quality") == "valid") & ~F.upper("validation_status").isin(
        "PENDING_REVIEW", "PENDIENTE_VALIDACION", "DISCARDED_INVALID", "DESCARTADO")
    status = (
        F.when(F.col("duplicate"), "duplicate_evidence").when(F.col("_shown").isNull() | (F.col("quality") == "invalid"), "discarded_invalid")
        .when(F.col("quality") == "truncated", "pending_review_text_fragment")
        .when(F.col("validation_status").isin("pending_review", "pendiente_validacion"), "pending_review")
        .when(counted, "counted").otherwise("detected_not_counted"))
    return df.transform(put, "dashboard_counted", counted).transform(put, "reconciliation_status", status).drop("_key", "_pos", "_shown")
