"""Report layouts without marks: stacked products, labels, pages, members of two layouts, variants."""

import random

from pyspark.sql import functions as F

from tallyloom.operators import extract, layouts, lines


def sections(spark, *texts):
    return lines.section_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id")


HEAD = "21. PRODUCCION CIENTIFICA IMPACTO MUNDIAL Y REGIONAL"


def test_stacked_rows_with_wrapped_names_links_and_pages(spark):
    text = "\n".join([
        HEAD, "Modelo estructural de Innovación y gestión del conocimi", "ento en las empresas", "Fernando Zambrano", "Farías", "PUBLICADO", "IMPACTO", "MUNDIAL", "https://epsir.net/index.php/", "epsir", "/about",
        "Incidencia del capital de trabajo en la rentabilidad", "María Estefanía Sánchez Pacheco", "Fernando Zambrano Farías", "ENVIADO A", "REVISION", "[[PAGE_BREAK:3]]", "en las regiones costeras",
        "Eficiencia técnica de las cooperativas de crédito", "Carlos Parrales Choez", "EN", "REVISION",
    ])
    rows = {r["product_no"]: r for r in layouts.stacked_products(sections(spark, text), "doc_id").collect()}
    assert [rows[k]["title"] for k in sorted(rows)] == [
        "Modelo estructural de Innovación y gestión del conocimiento en las empresas",
        "Incidencia del capital de trabajo en la rentabilidad en las regiones costeras",
        "Eficiencia técnica de las cooperativas de crédito",
    ]
    assert rows[0]["authors"] == ["Fernando Zambrano Farías"] and rows[0]["link"] == "https://epsir.net/index.php/epsir/about" and rows[0]["impact"] == "MUNDIAL"
    assert rows[1]["authors"] == ["María Estefanía Sánchez Pacheco", "Fernando Zambrano Farías"] and rows[1]["status"] == "ENVIADO A REVISION"
    assert rows[1]["title_recovery"] == "recovered_across_page_break" and rows[1]["original_title"] == "Incidencia del capital de trabajo en la rentabilidad"
    assert rows[2]["status"] == "EN REVISION" and rows[2]["authors"] == ["Carlos Parrales Choez"]


def test_label_title_goes_on_over_a_page(spark):
    texts = ["\n".join([
        HEAD, "TITULO", "Analisis de la competitividad empresarial y su incidencia", mark, "TITULO", "en la sostenibilidad de las pymes ecuatorianas", "AUTOR 1", "Fernando Zambrano Farias", "ESTADO", "PUBLICADO", "IMPACTO", "REGIONAL",
    ]) for mark in ("8 DE 8", "\f", "[[PAGE_BREAK:4]]", "8/8")]
    rows = layouts.scientific_products(sections(spark, *texts), "doc_id").collect()
    assert [(r["title"], r["authors"], r["validation_status"]) for r in rows] == 4 * [
        ("Analisis de la competitividad empresarial y su incidencia en la sostenibilidad de las pymes ecuatorianas", ["Fernando Zambrano Farias"], "validado")]


def test_a_title_fragment_is_no_author(spark):
    text = "\n".join([HEAD, "TITULO", "Modelo de competitividad para cooperativas ecuatorianas", "AUTOR 1", "Rentabilidad 2 Empresarial", "ESTADO", "PUBLICADO"])
    rows = extract.label_products(sections(spark, text), "doc_id").collect()
    assert [(r["authors"], r["status"], r["validation_status"]) for r in rows] == [([], "PUBLICADO", "pending_review")]


def test_plain_block_where_no_layout_fits(spark):
    text = "\n".join([HEAD, "TITULO", "AUTOR 1", "ESTADO", "IMPACTO", "LINK", "Determinants of profitability of credit unions in Ecuador", "Carlos Parrales Choez", "PUBLICADO", "IMPACTO MUNDIAL", "https://doi.org/10.123/example"])
    rows = layouts.scientific_products(sections(spark, text), "doc_id").collect()
    assert len(rows) == 1 and rows[0]["authors"] == ["Carlos Parrales Choez"] and rows[0]["link"] == "https://doi.org/10.123/example"


def test_internal_members_wrapped_name_and_catalog_lines(spark):
    text = "\n".join([
        "14. INVESTIGADORES QUE PARTICIPAN EN EL PROYECTO*", "NOMBRE COMPLETO", "FACULTAD", "CARRERA", "María Estefanía Sánchez", "Pacheco", "CIENCIAS", "ADMINISTRATIVAS", "Licenciatura en", "Contabilidad y Auditoría", "Septiembre 2023",
        "15. INVESTIGADORES QUE SE DESVINCULAN DEL PROYECTO", "Jeniffer Marcillo Chasy", "CIENCIAS ADMINISTRATIVAS", "Licenciatura en Finanzas",
    ])
    rows = layouts.internal_members(sections(spark, text), "doc_id").collect()
    assert [(r["name"], r["faculty"], r["career"], r["layout"]) for r in rows] == [("Maria Estefania Sanchez Pacheco", None, "Licenciatura en Contabilidad y Auditoria", 2)]


def test_labelled_members_and_the_first_with_a_career(spark):
    text = "\n".join([
        "14. INVESTIGADORES QUE PARTICIPAN EN EL PROYECTO", "NOMBRE COMPLETO", "Rosa Elena", "Mena Vera", "FACULTAD", "Ciencias Administrativas", "CARRERA", "Licenciatura en Turismo", "FECHA DE INGRESO", "2023-04-01",
        "NOMBRE COMPLETO", "Luis Jose Rojas", "CARRERA", "SECCION 2",
    ])
    rows = {r["name"]: r for r in layouts.labelled_internal(sections(spark, text), "doc_id").collect()}
    assert rows["Rosa Elena Mena Vera"]["career"] == "Licenciatura en Turismo" and rows["Rosa Elena Mena Vera"]["faculty"] == "CIENCIAS ADMINISTRATIVAS"
    assert rows["Luis Jose Rojas"]["career"] is None and rows["Luis Jose Rojas"]["requires_review"]
    one = spark.createDataFrame([(1, 0, 0, "Ana Paz", None), (1, 0, 1, "Leo Rios", "A"), (1, 0, 2, "Eva Sol", None)], "doc_id long, section_no int, member_no int, name string, career string")
    two = spark.createDataFrame([(1, 0, 0, "ANA PAZ", "B"), (1, 0, 1, "leo rios", "C"), (1, 0, 2, "Eva Sol", None)], one.schema)
    merged = {r["name"].upper(): (r["career"], r["layout"], r["candidates"]) for r in layouts.merge_by_name([one, two], ["doc_id", "section_no"], "career").collect()}
    assert merged == {"ANA PAZ": ("B", 2, 2), "LEO RIOS": ("A", 1, 2), "EVA SOL": (None, 1, 2)}


def test_external_members_of_both_layouts(spark):
    plain = "\n".join(["16. INVESTIGADORES EXTERNOS QUE PARTICIPAN DEL PROYECTO", "NOMBRE COMPLETO", "INSTITUCIÓN EXTERNA", "María del Carmen Valls Martínez", "Universidad de Almería", "José Manuel Santos Jaén", "Universidad de Murcia"])
    labelled = "\n".join(["16. INVESTIGADORES EXTERNOS QUE PARTICIPAN DEL PROYECTO", "NOMBRE COMPLETO", "Pedro Maria Cruz", "INSTITUCION EXTERNA", "Universidad de Murcia", "NOMBRE COMPLETO", "Nora Lucia Paz", "FACULTAD", "Ciencias"])
    rows = layouts.external_members(sections(spark, plain, labelled), "doc_id").collect()
    got = {(r["doc_id"], r["name"]): (r["institution"], r["participant_type"]) for r in rows}
    assert got[0, "Maria Del Carmen Valls Martinez"] == ("Universidad de Almería", "investigador_externo")
    assert got[1, "Pedro Maria Cruz"] == ("Universidad de Murcia", "investigador_externo") and got[1, "Nora Lucia Paz"] == ("Universidad de Guayaquil", "estudiante")


def plain_fold(products):
    kept = []
    for p in products:
        def alike(k):
            short, long = sorted((k["title"], p["title"]), key=len)
            return short != long and (long.startswith(short) or long.endswith(short)) and len(long.split()) - len(short.split()) <= 4 and k["authors"] == p["authors"]
        at = next((i for i, k in enumerate(kept) if alike(k)), None)
        if at is None:
            kept.append(p)
        elif p["score"] > kept[at]["score"]:
            kept[at] = p
    return kept


def test_collapse_in_order_on_random_chains(spark):
    rng = random.Random(5)
    rows = []
    for doc in range(60):
        for at in range(rng.randint(1, 9)):
            words = ["A", "B", "C", "D", "E", "F", "G"][rng.randint(0, 2) : rng.randint(3, 7)]
            rows.append((doc, at, " ".join(words), rng.choice(["X", "Y"]), rng.randint(0, 3)))
    df = spark.createDataFrame(rows, "doc int, at int, title string, authors string, score int")
    variant = F.struct(F.struct("at").alias("order"), "title", "authors", F.lit("S").alias("status"), "score", F.struct("at").alias("row"))
    got = df.groupBy("doc").agg(F.array_sort(F.collect_list(variant)).alias("v")).select("doc", F.transform(layouts.collapse_in_order(F.col("v")), lambda x: x["row"]["at"]).alias("kept")).collect()
    for r in got:
        products = [dict(at=a, title=t, authors=w, score=s) for d, a, t, w, s in rows if d == r["doc"]]
        assert r["kept"] == [p["at"] for p in plain_fold(products)]


def test_assembled_rows_come_back(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, kind string")
    one = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, None)], "doc_id long, at int, name string")
    two = spark.createDataFrame([(2, 5, 1.5)], "doc_id long, at int, share double")
    whole = layouts.assemble(docs, "doc_id", {"one": (one, ["at"]), "two": (two, ["at"])})
    rows = {r["doc_id"]: r for r in whole.collect()}
    assert [x["name"] for x in rows[1]["one"]] == ["x", "y"] and rows[1]["two"] == [] and rows[3]["one"] == []
    assert [tuple(x) for x in rows[2]["log"]] == [("one", 1), ("two", 1)] and rows[3]["log"] == []
    back = whole.select("doc_id", F.explode("one").alias("r")).select("doc_id", "r.*")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, one.collect()), key=str)
