"""Keys and marked lines of whole texts, and layouts that do not look for the sections again."""

from pyspark.sql import functions as F

from tallyloom.functions.text import parser_key
from tallyloom.operators import layouts, lines

ODD = ["13. Investigadores que participan\ná  b ßx ﬁn\ty", "", None, "\n \n", "Ñandú Índice\x0cΣς İı\nq\u0085w - a", "x ⃝ y  z\r\nPRODUCCIÓN científica"]


def test_keys_of_lines_are_parser_keys(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    rows = lines.line_table(docs, "doc_id").withColumn("own", parser_key(F.col("line"))).collect()
    assert len(rows) > 8
    assert [r["line_key"] for r in rows] == [r["own"] for r in rows]


def test_lines_holding_a_piece(spark):
    keys = spark.createDataFrame([(["A B", "XAB C", "", "D"],), ([],), (["Q"],)], "keys array<string>")
    got = [r[0] for r in keys.select(lines.lines_holding(F.col("keys"), ("AB", "D", "C.C"))).collect()]
    assert got == [[1, 3], [], []]


def test_layouts_find_sections_once(spark):
    text = "Investigadores que participan en el proyecto\nNOMBRE COMPLETO\nRosa Elena Mena Vera\nFACULTAD\nCiencias Administrativas\nProduccion cientifica\nModelo de gestion\nEvidencias"
    sections = lines.section_rows(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id")
    assert "_headings" in sections._jdf.queryExecution().toString()
    for layout in (layouts.internal_members, layouts.external_members, layouts.scientific_products):
        assert "_headings" not in layout(sections, "doc_id")._jdf.queryExecution().toString()
