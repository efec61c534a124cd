"""Whitening of embeddings with Spark MLlib's BlockMatrix.

Rows are gathered into blocks where they are read, each block written once with the ids of its rows, so that a block keeps
its number whoever reads it again. A row's vector becomes whole numbers x = floor(SCALE * c) + SHIFT. The blocks, less the
exact means, are a BlockMatrix A; the scatter matrix is A' A, its product cut along the rows into many tasks. Its
eigenvectors over the square roots of its eigenvalues are found locally (dimensions x dimensions) and are the second
BlockMatrix W; A W is the projection. Blocks are padded with rows of zeros, which are the mean and change no sum.

The driver holds the means, the scatter matrix, W, and a small entry a block (what the multiplication plans with), so
blocks grow with the table from BLOCK_ROWS on, up to BLOCK_CELLS numbers each.

Defined cases: vectors that are null, or hold null or non-finite entries or some too large for SCALE (2^46 and more), are
left out; so are those whose length is not that of most vectors (on ties the greater length). Components whose eigenvalue
is less than LEAST_SHARE of the trace have no direction to speak of and are left out; a table of equal vectors, or none,
gives no rows. ``deviation`` is null where it exceeds a long. Repeated rows and null ids are rows like all others; other
columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.session import work_folder

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
BLOCK_ROWS = 1024
BLOCK_CELLS = 1 << 21
BLOCK_COLUMNS = 1024
#: Blocks up to which they keep BLOCK_ROWS rows; block pairs multiplied in one task.
BLOCKS = 50_000
PAIRS = 8
LEAST_SHARE = 1e-12
_LIMIT = 2.0**46

_PACKED = "part int, seq int, ids array<long>, x array<long>"
_INDICES = T.StructType([T.StructField("_1", T.LongType()), T.StructField("_2", T.LongType())])
_BLOCK = T.StructType([T.StructField("_1", _INDICES), T.StructField("_2", MatrixUDT())])


def dimensions(vectors: DataFrame) -> tuple[int, int]:
    """The length of most vectors and how many have it."""
    sizes = vectors.filter(F.col("vector").isNotNull()).groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    found = sizes.filter("d > 0").agg(F.max(F.struct("n", "d")).alias("top")).first()["top"]
    return (found["d"], found["n"]) if found else (0, 0)


def block_rows(dims: int, rows: int) -> int:
    return min(max(BLOCK_ROWS, -(-rows // BLOCKS)), max(1, BLOCK_CELLS // dims))


def _whole(ids: pa.Array, vectors: pa.Array, dims: int) -> tuple[list, np.ndarray]:
    """Ids and whole numbers of the rows that count."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False)
    ids, vectors = ids.filter(fits), vectors.filter(fits)
    values = pc.fill_null(pc.list_flatten(vectors).cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False).reshape(-1, dims)
    good = (np.abs(values) < _LIMIT).all(axis=1)  # false for what is not finite
    return ids.filter(pa.array(good)).to_pylist(), np.floor(SCALE * values[good]).astype(np.int64) + SHIFT


def _row(part: int, seq: int, ids: list, x: np.ndarray) -> pa.RecordBatch:
    flat = np.ascontiguousarray(x).ravel()
    held = pa.ListArray.from_arrays(np.array([0, len(flat)], dtype=np.int32), pa.array(flat))
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([ids], pa.list_(pa.int64())), held], ["part", "seq", "ids", "x"])


def pack(vectors: DataFrame, dims: int, rows: int) -> DataFrame:
    """Blocks (part, seq, ids, x) of at most ``rows`` rows (vec_id, vector), written to the shared folder."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids: list = []
        parts: list[np.ndarray] = []
        for batch in batches:
            own, x = _whole(batch.column("vec_id"), batch.column("vector"), dims)
            ids += own
            parts.append(x)
            while len(ids) >= rows:
                x = np.concatenate(parts)
                yield _row(part, seq, ids[:rows], x[:rows])
                ids, parts, seq = ids[rows:], [x[rows:]], seq + 1
        if ids:
            yield _row(part, seq, ids, np.concatenate(parts))

    spark = vectors.sparkSession
    folder = work_folder(spark, "vectors")
    # small row groups, as a reader decodes one of them at a time
    vectors.mapInArrow(packed, _PACKED).write.option("parquet.block.size", 4 << 20).parquet(folder)
    return spark.read.schema(_PACKED).parquet(folder)


@dataclass
class Moments:
    """Rows, and the exact sum of each dimension."""

    n: int
    sums: list[int]

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n / self.n for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum over dimensions of (n * x - S)^2, exact; null beyond a long."""
        d = x - self.whole
        rest = np.array([s % self.n for s in self.sums], dtype=np.int64)
        if float(np.abs(d).max(initial=0) + 1) * self.n < (1 << 62) ** 0.5 / max(1, len(self.sums)):
            return ((self.n * d - rest) ** 2).sum(axis=1).tolist()
        exact = ((self.n * d.astype(object) - rest.astype(object)) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def moments(blocks: DataFrame, dims: int) -> Moments:
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims + 1, dtype=np.int64)  # the rows last
        for batch in batches:
            for x in batch.column("x"):
                own = x.values.to_numpy().reshape(-1, dims)
                total[:dims] += own.sum(axis=0)
                total[dims] += len(own)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1, dtype=np.int32)), pa.array(total)], ["dim", "total"])

    found = blocks.select("x").mapInArrow(summed, "dim int, total long").groupBy("dim").agg(F.sum("total").alias("total")).collect()
    total = [0] * (dims + 1)
    for r in found:
        total[r["dim"]] = r["total"]
    return Moments(total[dims], total[:dims])


def _starts(blocks: DataFrame) -> tuple[dict[int, int], int]:
    """The number of the first block of each part, and of blocks in all."""
    sizes = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = {}, 0
    for part, n in sizes:
        starts[part] = total
        total += n
    return starts, total


def _matrices(rows: int, columns: int, flats: list[np.ndarray]) -> pa.Array:
    """Dense matrices by column, as the struct that stands for them."""
    k = len(flats)
    values = pa.ListArray.from_arrays(np.arange(k + 1, dtype=np.int32) * rows * columns, pa.array(np.concatenate(flats)))
    none = pa.nulls(k, pa.list_(pa.int32()))
    arrays = [pa.array([1] * k, pa.int8()), pa.array([rows] * k, pa.int32()), pa.array([columns] * k, pa.int32()), none, none, values, pa.array([False] * k)]
    return pa.StructArray.from_arrays(arrays, ["type", "numRows", "numCols", "colPtrs", "rowIndices", "values", "isTransposed"])


def centred_matrix(blocks: DataFrame, stats: Moments, rows: int) -> BlockMatrix:
    """The centred rows as a BlockMatrix."""
    starts, total = _starts(blocks)
    dims = len(stats.sums)

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, x in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist(), batch.column("x"), strict=True):
                values = stats.centred(x.values.to_numpy().reshape(-1, dims))
                values = np.pad(values, ((0, rows - len(values)), (0, 0)))
                for at, first in enumerate(range(0, dims, BLOCK_COLUMNS)):
                    own = values[:, first : first + BLOCK_COLUMNS]
                    indices = pa.StructArray.from_arrays([pa.array([starts[part] + seq]), pa.array([at])], ["_1", "_2"])
                    yield pa.RecordBatch.from_arrays([indices, _matrices(rows, own.shape[1], [own.ravel(order="F")])], ["_1", "_2"])

    frame = blocks.select("part", "seq", "x").mapInArrow(centred, _BLOCK)
    java = callMLlibFunc("createBlockMatrix", frame, rows, BLOCK_COLUMNS, total * rows, dims)
    return BlockMatrix(java, rows, BLOCK_COLUMNS)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """A' A: block pairs are multiplied in tasks of PAIRS and their products added up."""
    turned = matrix.transpose()
    splits = max(1, matrix.numRowBlocks // PAIRS)
    java = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, turned.rowsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


@dataclass
class Whitening:
    """``weights`` (dimensions x components) whitens centred rows; ``explained`` is each component's share of the trace."""

    weights: np.ndarray
    explained: np.ndarray


def whitening(scattered: np.ndarray, n: int, components: int) -> Whitening:
    values, vectors = np.linalg.eigh(scattered / n)
    trace = values.sum()
    order = [i for i in np.argsort(-values, kind="stable")[:components] if values[i] > max(LEAST_SHARE * trace, 0.0)]
    chosen = vectors[:, order]
    signs = np.sign(chosen[np.abs(chosen).argmax(axis=0), np.arange(len(order))]) if order else np.ones(0)
    return Whitening(chosen * signs / np.sqrt(values[order]), values[order] / trace if order else np.zeros(0))


def project(spark: SparkSession, matrix: BlockMatrix, weights: np.ndarray) -> DataFrame:
    """(block, flat): A W by blocks of rows, each by column."""
    dims, width = weights.shape
    blocks = [
        ((at, 0), Matrices.dense(len(own), width, own.ravel(order="F").tolist()))
        for at, own in enumerate(weights[first : first + BLOCK_COLUMNS] for first in range(0, dims, BLOCK_COLUMNS))
    ]
    right = BlockMatrix(spark.sparkContext.parallelize(blocks, len(blocks)), BLOCK_COLUMNS, width, dims, width)
    product = matrix.multiply(right)
    frame = callMLlibFunc("getMatrixBlocks", product._java_matrix_wrapper._java_model)

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, held = batch.column("_1").field("_1").cast(pa.int64()), batch.column("_2")
            matrices = held.storage if isinstance(held, pa.ExtensionArray) else held
            for k in range(len(block)):
                one = matrices[k]
                values = np.asarray(one["values"].values)
                if one["isTransposed"].as_py():
                    values = values.reshape(one["numRows"].as_py(), -1).ravel(order="F")
                yield pa.RecordBatch.from_arrays([block.slice(k, 1), pa.array([values], pa.list_(pa.float64()))], ["block", "flat"])

    return frame.mapInArrow(flat, "block long, flat array<double>")


def _rows_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, list, list, np.ndarray]]:
    for k in range(batch.num_rows):
        ids = batch.column("ids")[k].as_py()
        values = batch.column("flat")[k].values.to_numpy().reshape(width, -1).T[: len(ids)]
        yield k, ids, batch.column("deviations")[k].as_py(), values


def identity_error(projected: DataFrame, width: int, n: int) -> float:
    """The largest absolute entry of the covariance of the projected rows, centred, minus the identity."""

    def summed(batches: Iterator[pa.RecordBatch], means: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width if means is None else width * width)
        for batch in batches:
            for _, _, _, values in _rows_of(batch, width):
                total += values.sum(axis=0) if means is None else ((values - means).T @ (values - means)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "total"])

    def sums(means: np.ndarray | None) -> np.ndarray:
        rows = projected.mapInArrow(lambda batches: summed(batches, means), "at int, total double").groupBy("at").agg(F.sum("total").alias("total"))
        out = np.zeros(width if means is None else width * width)
        for r in rows.collect():
            out[r["at"]] = r["total"]
        return out

    means = sums(None) / n
    return float(np.abs(sums(means).reshape(width, width) / n - np.eye(width)).max(initial=0.0))


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """RESULT rows for each row (vec_id long, vector array) that counts and each component."""
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "vector")
    dims, about = dimensions(vectors)
    empty = spark.createDataFrame([], RESULT)
    if not dims:
        return empty
    rows = block_rows(dims, about)
    blocks = pack(vectors, dims, rows)
    stats = moments(blocks, dims)
    if not stats.n:
        return empty
    matrix = centred_matrix(blocks, stats, rows)
    found = whitening(scatter(matrix), stats.n, components)
    width = found.weights.shape[1]
    if not width:
        return empty
    starts, _ = _starts(blocks)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = [starts[p] + s for p, s in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist(), strict=True)]
            own = [stats.deviations(x.values.to_numpy().reshape(-1, dims)) for x in batch.column("x")]
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), batch.column("ids"), pa.array(own, pa.list_(pa.int64()))], ["block", "ids", "deviations"])

    keys = blocks.mapInArrow(keyed, "block long, ids array<long>, deviations array<long>")
    folder = work_folder(spark, "projected")
    project(spark, matrix, found.weights).join(keys, "block").write.option("parquet.block.size", 16 << 20).parquet(folder)
    projected = spark.read.parquet(folder)
    error = identity_error(projected, width, stats.n)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids, deviations, values in _rows_of(batch, width):
                k = len(ids)
                at = np.repeat(np.arange(k), width)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()).take(at), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), k)), pa.array(np.full(k * width, stats.n)),
                        pa.array(deviations, pa.int64()).take(at), pa.array(values.ravel()), pa.array(np.tile(found.explained, k)), pa.array(np.full(k * width, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return projected.select("flat", "ids", "deviations").mapInArrow(results, RESULT)
