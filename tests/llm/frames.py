"""Small awkward tables for the operators' tests."""

import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string"

LONG = " ".join(f"word{i % 977} and" for i in range(30_000))
AWKWARD = [
    None, "", " \t\n\x0b\x0c\r ", "one", "Hello World", "hello world", "<|endoftext|> A<|startoftext|>b", "</s>[INST] x [/INST] \\ <\\ [", "é́ Σς ß 中文 😀 \x00 \x1c x",
    "a b c d e a b c d e a b c d e", "same line\nsame line\n\n same line\nother", "#*$%&|<> " * 12, LONG, "12345 67890 !!!", "the quick brown fox jumps over the lazy dog and runs far away from it",
]


def awkward_docs(spark):
    """Awkward texts under repeated, null and ordinary ids, with extra columns that clash with results."""
    rows = [(i, t, "en" if i % 2 else None, "src", 0, "x", "y") for i, t in enumerate(AWKWARD)]
    rows += [(3, "one", "en", None, None, "x", "y"), (3, "one", "en", None, None, "x", "y"), (None, "no id", None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def rest(doc_id, by):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % by


def write_tables(spark, folder, **frames):
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
