"""Marked sections against a plain loop over the lines, and the fallback to them."""

import random
import re

from tallyloom.operators import legacy

SECTIONS = {"work": (("OBRA",), ("FIN", "ANEXOS")), "people": (("GENTE", "EQUIPO"), ("OBRA",))}
KINDS = ["obra nueva", "Gente", "equipo", "fin", "Anexos 2", "3. Otro", "12. Mas", "4 de 9", "Jotform x", "[[PAGE_BREAK:2]]", "una línea", "otra  línea", ""]


def loop(text, starts, stops):
    lines = [" ".join(x.split()) for x in (text or "").split("\n")]
    lines = [(x, x.upper().replace("Í", "I")) for x in lines if x]
    begin = next((i for i, (_, k) in enumerate(lines) if any(s in k for s in starts)), None)
    out = []
    for x, k in lines[begin + 1:] if begin is not None else []:
        if any(s in k for s in stops) or out and re.match(r"\d{1,2}\.\s", k):
            break
        if "JOTFORM" not in k and "PAGE_BREAK" not in k and not re.fullmatch(r"\d+ DE \d+", k):
            out.append(x)
    return out


def test_sections_equal_a_plain_loop(spark):
    pick = random.Random(2)
    texts = ["\n".join(pick.choice(KINDS) for _ in range(pick.randint(0, 14))) for _ in range(150)] + [None, "", "obra"]
    got = legacy.marked_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, body string"), "doc_id", SECTIONS, "body").collect()
    want = {(i, name, n, line) for i, t in enumerate(texts) for name, marks in SECTIONS.items() for n, line in enumerate(loop(t, *marks))}
    assert len(got) == len(want)
    assert {tuple(r) for r in got} == want


def test_the_second_parser_fills_keys_without_rows(spark):
    one = spark.createDataFrame([(1, "a"), (1, "b")], "k int, name string")
    two = spark.createDataFrame([(1, "c"), (2, "d"), (2, "d")], "k int, name string")
    assert sorted(map(tuple, legacy.fallback(one, two, ["k"]).collect())) == [(1, "a", "layout"), (1, "b", "layout"), (2, "d", "legacy"), (2, "d", "legacy")]
