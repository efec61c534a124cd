"""The registered queries: SQL twins, columns, and the pipeline against plain Python."""

import hashlib
import os
import sys
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from frames import awkward_docs, empty_docs, write_tables
from test_decontaminate import direct as contaminated
from test_simhash import direct as fingerprint
from test_simhash import roots
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from tallyloom.llm import language_id, queries, quality_rules  # noqa: E402
from tools.check import compare  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op2": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op3": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op4": {"doc_id": "bigint", "n_pretokens": "bigint", "n_tokens": "bigint"},
    "op5": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op6": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op7": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op8": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op9": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op11": {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"},
    "op12": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op13": {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"},
    "op10": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_columns_and_rows(spark, name):
    result = queries.queries()[name](spark, FOLDER)
    assert dict(result.dtypes) == COLUMNS[name.split("_")[0]]
    if name.startswith("op11_"):
        assert result.count() == 32 * spark.read.parquet(f"{FOLDER}/embeddings.parquet").count()
    elif name not in queries.oracles():
        assert result.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    assert compare(con, queries.queries()[name](spark, FOLDER).toArrow(), queries.oracles()[name]).startswith("ok")


def test_registered():
    assert set(queries.queries()) | {"pipeline"} <= set(entry.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "near duplicates", "decontamination", "BPE"]


def plain_pipeline(spark, docs, sf_dir):
    """The stages in Python. The two learned stages take their verdicts from the operators' own row-wise results."""
    labels, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    passed = quality_rules.assess(docs, labels).filter("kept").select("doc_id")
    docs = docs.join(passed, "doc_id", "left_semi")
    spoken = language_id.identify(docs, language_id.fit(language_id.learning_rows(docs)))
    rows = [(r["doc_id"], r["text"]) for r in spoken.filter(f"lang_pred <> 'und' AND score >= {corpus_pipeline.LEAST_SCORE}").collect()]
    prints = {d: fingerprint(t) for d, t in rows}
    root = roots(set(prints.values()))
    least = {}
    for d, f in prints.items():
        least[root[f]] = min(d, least.get(root[f], d))
    rows = [(d, t) for d, t in rows if least[root[prints[d]]] == d]
    bad = {d for d, _, _, _, c in contaminated(rows, [(r["item_id"], r["text"]) for r in benchmark.collect()]) if c}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for d, t in rows:
        if d not in bad:
            ids = library.encode(t, add_special_tokens=False).ids
            out.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return out


def test_pipeline_matches_plain_python(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    result = corpus_pipeline.run(spark, FOLDER)
    assert result.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = Counter(map(tuple, result.collect()))
    assert got == Counter(plain_pipeline(spark, docs, FOLDER)) and 0 < sum(got.values()) < docs.count()


@pytest.mark.parametrize("make", [awkward_docs, empty_docs])
def test_stages_take_awkward_and_empty_tables(spark, tmp_path, make):
    docs = make(spark)
    folder = write_tables(
        spark, tmp_path, documents=docs, labels=spark.createDataFrame([(1, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int"),
        benchmark=spark.createDataFrame([(1, "one"), (2, None)], "item_id long, text string"),
    )
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()
    assert corpus_pipeline.run(spark, folder).count() <= docs.count()
