"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

A vector's direction is turned by fast pseudo-rotations (random signs and Walsh-Hadamard transforms, three times) and
falls in the bucket of its largest coordinate with its sign; each table has rotations of its own. The index is cut in
blocks of rows: a block holds its vectors once, and for every table the row numbers in order of their buckets. A query
probes the buckets of its nearest axes in every table of a block. Rows that enough of the probed tables name are the
candidates; the union is reranked once, exactly, in double precision, and a block gives back its nearest.

The queries are a stated set, written once; the task of a block reads them in batches, so neither vectors nor candidates
are shuffled to meet, no bucket is a key, and a task's memory is one block and one batch. Where fewer than k + 1 rows
have the votes, those with the most are candidates. The votes that are asked for are chosen on a bounded sample, where
the tables are held against brute force (a sample's neighbours are farther than the corpus's, so recall there is lower).

Identical vectors beyond the k + 1 of smallest id cannot be among the k nearest of anything and do not enter the
index, and identical queries are searched once, so a vector that a third of the rows share is no burden.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part; of rows that repeat an id the least vector (component by component) counts, once; with fewer candidates than k
all are given; an empty table gives no rows; columns other than vec_id, the vector and those that ``queries`` names are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import filesystem_of, new_folder, save

SAMPLE_ROWS = 6000
SAMPLE_QUERIES = 100
TARGET_RECALL = 0.97
TABLES = 32
#: Buckets that a query probes in each table; never more than a sixth of them.
PROBES = 20
#: Bytes of vectors in a block, and queries in a batch.
BLOCK_BYTES = 32_000_000
QUERY_ROWS = 4096


@cache
def _kernel(n: int) -> np.ndarray:
    return np.array([[1.0]]) if n == 1 else np.kron(np.array([[1.0, 1.0], [1.0, -1.0]]), _kernel(n // 2))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows (their length is a power of two), orthonormal, in stages of up to 64 points."""
    n, h, out = x.shape[1], 1, x
    while h < n:
        radix = min(64, n // h)
        part = out.reshape(len(x), -1, radix, h)
        stage = _kernel(radix).astype(x.dtype)
        out = part.reshape(-1, radix) @ stage if h == 1 else np.einsum("arbh,bc->arch", part, stage, optimize=True)
        out, h = out.reshape(len(x), n), h * radix
    return out / np.asarray(math.sqrt(n), x.dtype)


@dataclass(frozen=True)
class CrossPolytope:
    """The tables' hashes, drawn from a seed."""

    dim: int
    tables: int = TABLES
    hashes: int = 1
    seed: int = 11

    @property
    def width(self) -> int:
        return 1 << max(1, (self.dim - 1).bit_length())

    def rotated(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        """For each hash of a table, the rotated directions with their negatives: 2 * width signed axes."""
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        unit = np.pad(unit, ((0, 0), (0, self.width - self.dim)))
        out = []
        for k in range(self.hashes):
            signs = np.random.default_rng([self.seed, table, k]).choice([-1.0, 1.0], (3, self.width))
            y = unit
            for s in signs:
                y = hadamard(y * s)
            out.append(np.concatenate([y, -y], axis=1))
        return out

    def codes(self, x: np.ndarray, table: int) -> np.ndarray:
        """Bucket of each row."""
        code = np.zeros(len(x), np.int64)
        for y in self.rotated(x, table):
            code = code * (2 * self.width) + y.argmax(axis=1)
        return code

    def probes(self, x: np.ndarray, table: int, count: int) -> np.ndarray:
        """The ``count`` buckets whose axes are nearest to each row, nearest first."""
        axes = 2 * self.width
        gap, code = None, None
        for y in self.rotated(x, table):
            order = np.argsort(-y, axis=1, kind="stable")[:, : min(count, axes)]
            own = y.max(axis=1, keepdims=True) - np.take_along_axis(y, order, 1)
            if gap is None:
                gap, code = own, order.astype(np.int64)
            else:
                total = (gap[:, :, None] + own[:, None, :]).reshape(len(x), -1)
                codes = (code[:, :, None] * axes + order[:, None, :]).reshape(len(x), -1)
                best = np.argsort(total, axis=1, kind="stable")[:, :count]
                gap, code = np.take_along_axis(total, best, 1), np.take_along_axis(codes, best, 1)
        return code[:, :count]


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - query) ** 2).sum(axis=1))


class Block:
    """The tables of some rows: for each, the row numbers in order of their buckets."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, index: CrossPolytope):
        self.ids, self.x, self.buckets = ids, x, 2 * index.width
        self.order, self.starts = [], []
        for t in range(index.tables):
            codes = index.codes(x, t)
            self.order.append(np.argsort(codes, kind="stable").astype(np.int32))
            self.starts.append(np.searchsorted(codes[self.order[t]], np.arange(self.buckets + 1)) + t * len(x))
        self.order, self.starts = np.concatenate(self.order), np.array(self.starts)

    def votes(self, probes: np.ndarray) -> np.ndarray:
        """How many tables name each row; ``probes`` has a row of buckets for each table."""
        table = np.arange(len(probes))[:, None]
        begin = self.starts[table, probes].reshape(-1)
        size = self.starts[table, probes + 1].reshape(-1) - begin
        ends = np.cumsum(size)
        named = self.order[np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]))]
        return np.bincount(named, minlength=len(self.x))

    def candidates(self, probes: np.ndarray, least: int, k: int) -> np.ndarray:
        """Rows with the least number of votes; the k + 1 with the most (and their ties) where fewer have it."""
        votes = self.votes(probes)
        found = np.flatnonzero(votes >= least)
        if len(found) > k or len(found) == len(votes):
            return found
        return np.flatnonzero(votes >= (np.partition(votes, -k - 1)[-k - 1] if len(votes) > k else 0))

    def nearest(self, query: np.ndarray, probes: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k + 1 nearest candidates."""
        rows = self.candidates(probes, least, k)
        d, ids = distances(self.x[rows], query), self.ids[rows]
        if len(d) > k + 1:  # all that tie with the last stay until ids decide
            near = np.flatnonzero(d <= np.partition(d, k)[k])
            near = near[np.lexsort((ids[near], d[near]))[: k + 1]]
            d, ids = d[near], ids[near]
        return ids, d


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - query) ** 2).sum(axis=1))


def probes_of(x: np.ndarray, index: CrossPolytope) -> np.ndarray:
    """Buckets to probe: a row of them for each query and table."""
    count = max(1, min(PROBES, 2 * index.width // 6))
    return np.stack([index.probes(x, t, count) for t in range(index.tables)], axis=1)


def choose_votes(x: np.ndarray, index: CrossPolytope, k: int, target: float) -> tuple[int, float]:
    """Most votes with which the sample's queries find the target share of their nearest, and the share of the rows
    that are candidates then."""
    if len(x) <= k + 1:
        return 1, 1.0
    block, queries = Block(np.arange(len(x)), x, index), x[:SAMPLE_QUERIES]
    probes = probes_of(queries, index)
    votes = np.array([block.votes(p) for p in probes])
    near = np.array([votes[i][np.argsort(distances(x, q), kind="stable")[1 : k + 1]] for i, q in enumerate(queries)])
    least = max([0, *(m for m in range(1, index.tables + 1) if (near >= m).mean() >= target)])
    return least, float((votes >= least).mean())


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _usable(vector: Column) -> Column:
    """Neither null nor zero, and every component finite."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def _query_batches(folder: str) -> Iterator[pa.RecordBatch]:
    """The stored queries (q, v), some at a time."""
    filesystem, inner = filesystem_of(folder)
    for info in sorted(filesystem.get_file_info(pafs.FileSelector(inner)), key=lambda f: f.path):
        if info.path.endswith(".parquet"):
            with filesystem.open_input_file(info.path) as source:
                yield from pq.ParquetFile(source).iter_batches(QUERY_ROWS)


def search(vectors: DataFrame, queries: Column, k: int = 10, tables: int = TABLES, block_rows: int | None = None, target: float = TARGET_RECALL) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the k nearest found to every row that ``queries`` selects."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), queries.alias("_query"))
    if rows.schema["v"].dataType.simpleString() != "array<float>":
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    rows = rows.filter(F.col("vec_id").isNotNull()).filter(_usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim, total = lengths["d"], lengths["count"]
    rows = rows.filter(F.size("v") == dim)
    if rows.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("_query").alias("_query"))
    block_rows = block_rows or max(1, BLOCK_BYTES // (8 * dim))
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-total // block_rows))
    same = Window.partitionBy("v").orderBy("vec_id")
    kept = rows.select("vec_id", "v").withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= k + 1).drop("_n")
    kept = save(kept.repartition(parts, "vec_id"), "vectors")
    asked = rows.filter("_query").select("vec_id", "v")
    searched = asked.groupBy("v").agg(F.min("vec_id").alias("q")).select("q", "v")
    folder = new_folder(spark, "queries")
    searched.write.option("compression", "zstd").parquet(folder)
    searched = spark.read.schema(searched.schema).parquet(folder)

    index = CrossPolytope(dim, tables)
    sample = kept.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").toPandas()["v"].tolist()
    least, _ = choose_votes(np.array(sample, float).reshape(-1, dim), index, k, target)

    def answers(ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        block = Block(ids, x, index)
        for batch in _query_batches(folder):
            y = _matrix(batch.column("v"), dim)
            found = [block.nearest(q, p, least, k) for q, p in zip(y, probes_of(y, index), strict=True)]
            times = [len(i) for i, _ in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("q").to_numpy(), times)), *(pa.array(np.concatenate(c)) for c in zip(*found, strict=True))], names=["q", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0
        for batch in batches:
            ids, x = batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), dim)
            while len(ids):
                take = block_rows - count
                held.append((ids[:take], x[:take]))
                count += len(held[-1][0])
                ids, x = ids[take:], x[take:]
                if count == block_rows:
                    yield from answers(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    held, count = [], 0
        if count:
            yield from answers(*(np.concatenate(c) for c in zip(*held, strict=True)))

    found = kept.mapInArrow(run, "q long, vec_id long, score double")
    first = found.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).filter(F.col("_n") <= k + 1).drop("_n")
    named = asked.select(F.col("vec_id").alias("query_id"), "v").join(searched, "v").select("query_id", "q")
    ranked = named.join(first, "q").filter(F.col("query_id") != F.col("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return ranked.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
