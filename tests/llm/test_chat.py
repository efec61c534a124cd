"""Reply trees: chosen paths against a walk in Python, reversible templates, defined cases."""

import random

import pytest

from tallyloom.llm import chat

MESSAGES = "tree long, node long, parent long, role string, text string, score double"


def direct(rows, best):
    """(tree, leaf): nodes of the path, for the best leaves of each tree."""
    nodes = {(t, n): (p, s or 0.0) for t, n, p, _, _, s in rows}
    parents = {(t, p) for (t, n), (p, _) in nodes.items()}
    out = {}
    for tree in {t for t, _ in nodes}:
        ranked = []
        for t, n in nodes:
            if t != tree or (t, n) in parents:
                continue
            path, at = [], n
            while (t, at) in nodes and at not in path:
                path.append(at)
                at = nodes[t, at][0]
            if (t, at) not in nodes:
                ranked.append((-sum(nodes[t, x][1] for x in path), n, path[::-1]))
        for _, n, path in sorted(ranked)[:best]:
            out[tree, n] = path
    return out


def taken(spark, rows, best):
    found = {}
    for r in sorted(chat.paths(spark.createDataFrame(rows, MESSAGES), best).collect(), key=lambda r: (str(r["tree"]), r["leaf"], r["depth"])):
        found.setdefault((r["tree"], r["leaf"]), []).append((r["depth"], r["text"]))
    return {k: [t for _, t in v] if [d for d, _ in v] == list(range(len(v))) else v for k, v in found.items()}


@pytest.mark.parametrize("best", [1, 3])
def test_paths_of_random_trees(spark, best):
    rng = random.Random(best)
    rows = []
    for tree in [0, 1, 2, None]:
        for n in range(25):
            parent = rng.randrange(n) if n and rng.random() < 0.95 else None
            rows.append((tree, n, parent, "user", f"{n}", rng.choice([None, 0.0, 1.0, -0.5])))
    rows += [(1, 100, 999, "user", "100", 9.0), (1, 101, 100, "user", "101", 0.0)]  # an unknown parent makes a root
    rows += [(2, 200, 201, "user", "200", 99.0), (2, 201, 200, "user", "201", 99.0), (2, 202, 201, "user", "202", 99.0)]  # a cycle gives no path
    want = {k: [str(n) for n in v] for k, v in direct(rows, best).items()}
    assert taken(spark, rows, best) == want


def test_deep_chains_take_few_rounds(spark):
    rows = [(1, n, n - 1 if n else None, "user", f"{n}", 0.0) for n in range(300)]
    assert taken(spark, rows, 1) == {(1, 299): [str(n) for n in range(300)]}


def test_templates_are_reversible(spark):
    texts = ["", "</s>", "[SEP]", "<s>[INST] ok [/INST]</s>\n", "\\", "\\\\<", "<\\", "[\\[", "\n</s>\n", "<|im_end|>", "😀é́", "a\x00b", None]
    rng = random.Random(2)
    texts += ["".join(rng.choice("\\<[/s>]SEP\n") for _ in range(rng.randint(1, 30))) for _ in range(200)]
    rows = [(i, turn, role, t) for i, t in enumerate(texts) for turn, role in enumerate(["</s>sys", "user", "assistant", None, "assistant"])]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r["tree"]: r for r in chat.read_back(chat.format_paths(chat.paths(chat.chains(frame)))).collect()}
    for i, t in enumerate(texts):
        r = back[i]
        assert r["texts"] == [t or ""] * 5 and r["roles"] == ["</s>sys", "user", "assistant", "", "assistant"]
        assert r["loss_text"] == (t or "") * 2 and len(r["loss"]) == 2
        for control in (chat.TURN, chat.SPLIT, chat.END):
            assert r["formatted"].count(control) == 5
        for control in ("[INST]", "[/INST]", "<|"):
            assert control not in r["formatted"]


def test_ties_repeats_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string, score string, node string"
    rows = [(1, 0, "user", "b", "", ""), (1, 0, "user", "a", "", ""), (1, 0, "user", "a", "", ""), (1, None, "system", "first", "", ""), (None, 3, "assistant", "lone", "", ""), (None, 5, None, None, "", "")]
    back = {r["tree"]: r for r in chat.read_back(chat.format_paths(chat.paths(chat.chains(spark.createDataFrame(rows, schema))))).collect()}
    assert back[1]["texts"] == ["first", "a", "a", "b"]
    assert back[None]["texts"] == ["lone", ""] and back[None]["loss_text"] == "lone"
    assert chat.format_paths(chat.paths(chat.chains(spark.createDataFrame([], schema)))).count() == 0
