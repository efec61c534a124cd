"""Rows applied in order although files arrive in another, against a plain loop over the sorted log."""

import random

from tallyloom.streaming.ordered import ChainCheck, DecisionFold, apply_in_order, shuffled_arrivals


def arriving(spark, tmp_path, schema, files):
    for at, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))


LOG = "case_id long, seq int, expected_version int"


def folded(log):
    out = set()
    for case in {c for c, _, _ in log}:
        version = 1
        for seq, expected in sorted((s, e) for c, s, e in log if c == case):
            out.add((case, seq, "applied" if expected == version else "conflict"))
            version += expected == version
    return out


def test_shuffled_files_and_a_repeated_one(spark, tmp_path):
    pick = random.Random(4)
    log = [(c, s, pick.choice([1, s, (s + 1) // 2, 99])) for c in range(8) for s in range(1, 10)]
    scattered = pick.sample(log, len(log))
    files = [scattered[0::4], scattered[1::4], scattered[0::4], scattered[2::4], scattered[3::4]]
    got = [tuple(r) for r in apply_in_order(arriving(spark, tmp_path, LOG, files), DecisionFold(first=1)).collect()]
    assert len(got) == len(log)
    assert set(got) == folded(log)


def test_rows_wait_for_a_missing_predecessor(spark, tmp_path):
    files = [[(1, 3, 3), (1, 1, 1), (2, None, 1)], [(1, 4, 4)], [(2, 1, None)]]
    got = {tuple(r) for r in apply_in_order(arriving(spark, tmp_path, LOG, files), DecisionFold(first=1)).collect()}
    assert got == {(1, 1, "applied"), (2, None, None), (2, 1, "conflict")}


def test_patience_lets_waiting_rows_go_in_order(spark, tmp_path):
    files = [[(1, 3, 2), (1, 1, 1), (1, 5, 9)], [(3, 1, 1)], [(1, 2, 1), (1, 6, 3)]]
    got = {tuple(r) for r in apply_in_order(arriving(spark, tmp_path, LOG, files), DecisionFold(first=1, patience_ms=1)).collect()}
    assert got == {(1, 1, "applied"), (1, 3, "applied"), (1, 5, "conflict"), (3, 1, "applied"), (1, 6, "applied")}


def test_chains_over_scattered_arrivals(spark):
    events = [(a, s, None if s == 0 else "broken" if (a, s) == (2, 3) else f"h{a}-{s - 1}", f"h{a}-{s}") for a in range(4) for s in range(7)]
    rows = spark.createDataFrame(events, "aggregate_key long, seq int, previous_hash string, event_hash string")
    got = [tuple(r) for r in apply_in_order(shuffled_arrivals(rows), ChainCheck(first=0)).collect()]
    assert sorted(got) == sorted((a, s, (a, s) != (2, 3)) for a, s, _, _ in events)
