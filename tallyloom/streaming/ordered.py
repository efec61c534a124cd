"""Keyed streams whose rows are applied in the order of their numbers, whatever order they arrive in.

Files of one source may overtake each other. The state of a key is the next number, what the last applied row left
behind, and the rows that wait for a predecessor, each an entry of its own in the state store. A row is applied once:
a number that was applied or is waiting already is a repetition and dropped. With a patience, rows that waited
that long are let go over the gap, in order, by the next micro-batch that has data.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyloom.session import work_folder
from tallyloom.streaming import jobs

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Applies ``step`` to the rows of a key in the order of ``seq``.

    Subclasses name the key column, the columns of a row's content and of what a step leaves, and the outcome column.
    Rows without a number have no place: they come out at once with a null outcome.
    """

    key = ""
    content: dict[str, str] = {}
    left: dict[str, str] = {}
    outcome = ("outcome", "string")

    def __init__(self, first: int, patience_ms: int | None = None):
        self.first, self.patience_ms = first, patience_ms

    @classmethod
    def output(cls) -> str:
        return f"{cls.key} bigint, seq int, {cls.outcome[0]} {cls.outcome[1]}"

    def begin(self) -> tuple:
        """What stands before the first row."""
        raise TypeError("a subclass says what stands before the first row")

    def step(self, left: tuple, content: tuple) -> tuple[object, tuple]:
        """(outcome, what is left) of one row."""
        raise TypeError("a subclass says what a row does")

    def init(self, handle: StatefulProcessorHandle) -> None:
        columns = lambda c: ", ".join(f"{name} {kind}" for name, kind in c.items())
        self.handle = handle
        self.head = handle.getValueState("head", "next int, waiting int, timer bigint, " + columns(self.left))
        self.waiting = handle.getMapState("waiting", "seq int", columns(self.content))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.head.get()) if self.head.exists() else (self.first, 0, 0, *self.begin())
        upcoming, held, timer, left = state[0], state[1], state[2], state[3:]
        for batch in rows:
            done = [(None, None)] * int(batch["seq"].isna().sum())
            batch = batch[batch["seq"].notna()].sort_values("seq", kind="stable")
            contents = batch[list(self.content)].astype(object)
            contents = contents.where(contents.notna(), None).itertuples(index=False, name=None)
            for seq, content in zip(batch["seq"].astype(int), contents):
                if seq < upcoming:
                    continue
                if seq > upcoming:
                    if not self.waiting.containsKey((seq,)):
                        self.waiting.updateValue((seq,), content)
                        held += 1
                    continue
                if held and self.waiting.containsKey((seq,)):
                    self.waiting.removeKey((seq,))
                    held -= 1
                outcome, left = self.step(left, content)
                done.append((seq, outcome))
                upcoming += 1
                while held and self.waiting.containsKey((upcoming,)):
                    outcome, left = self.step(left, self.waiting.getValue((upcoming,)))
                    self.waiting.removeKey((upcoming,))
                    done.append((upcoming, outcome))
                    upcoming, held = upcoming + 1, held - 1
            yield self._frame(key, done)
        if self.patience_ms is not None:
            if not held and timer:
                self.handle.deleteTimer(timer)
                timer = 0
            elif held and not timer:
                timer = timerValues.getCurrentProcessingTimeInMs() + self.patience_ms
                self.handle.registerTimer(timer)
        self.head.update((upcoming, held, timer, *left))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = tuple(self.head.get())
        upcoming, left, done = state[0], state[3:], []
        for seq in sorted(k[0] for k in self.waiting.keys()):
            outcome, left = self.step(left, self.waiting.getValue((seq,)))
            self.waiting.removeKey((seq,))
            done.append((seq, outcome))
            upcoming = seq + 1
        self.head.update((upcoming, 0, 0, *left))
        yield self._frame(key, done)

    def close(self) -> None:
        pass

    def _frame(self, key: tuple, done: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({
            self.key: pd.Series([key[0]] * len(done), dtype="int64"), "seq": pd.Series([s for s, _ in done], dtype="Int32"),
            self.outcome[0]: pd.Series([o for _, o in done], dtype=object)})


class DecisionFold(InOrder):
    """A decision applies if it expects the version its case has; an applied one raises the version."""

    key, content, left = "case_id", {"expected_version": "int"}, {"version": "int"}

    def begin(self) -> tuple:
        return (1,)

    def step(self, left: tuple, content: tuple) -> tuple[object, tuple]:
        applied = content[0] == left[0]
        return "applied" if applied else "conflict", (left[0] + int(applied),)


class ChainCheck(InOrder):
    """Whether an event names the hash of the event before, the first one naming none."""

    key, outcome = "aggregate_key", ("linked", "boolean")
    content, left = {"previous_hash": "string", "event_hash": "string"}, {"hash": "string"}

    def begin(self) -> tuple:
        return (None,)

    def step(self, left: tuple, content: tuple) -> tuple[object, tuple]:
        return content[0] == left[0], (content[1],)


@contextmanager
def _settings(spark: SparkSession):
    """State by key and entry, and no batches without data, which timers would ask for without end once all has arrived."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def apply_in_order(arriving: DataFrame, processor: InOrder) -> DataFrame:
    """The outcome of every row of a stream, once it could be applied; drained, as a table of all micro-batches."""
    rows = arriving.select(F.col(processor.key).cast("long").alias(processor.key), F.col("seq").cast("int").alias("seq"), *processor.content)
    applied = rows.groupBy(processor.key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.output(), outputMode="append",
        timeMode="none" if processor.patience_ms is None else "ProcessingTime")
    with _settings(arriving.sparkSession):
        return jobs.drain(applied, "append").drop("epoch")


def shuffled_arrivals(rows: DataFrame, batches: int = 3) -> DataFrame:
    """A table as files in which the rows of a key lie scattered, a third of them twice, streamed in about ``batches`` micro-batches."""
    spark = rows.sparkSession
    folder = work_folder(spark, "arrivals")
    files = max(2 * batches, int(spark.conf.get("spark.sql.shuffle.partitions")))
    again = rows.filter(F.col("seq") % 3 == 0).withColumn("_copy", F.lit(1))
    rows.withColumn("_copy", F.lit(0)).unionByName(again).repartition(files, F.xxhash64(*rows.columns), "_copy").drop("_copy").write.parquet(folder)
    written = spark.read.parquet(folder)
    return spark.readStream.schema(written.schema).option("maxFilesPerTrigger", max(1, len(written.inputFiles()) // batches)).parquet(folder)
