"""Best-fit packing of token sequences by linear grouping.

The plan is made from the histogram of piece lengths alone, so its size depends on the capacity and not on the corpus:
large lengths are rounded up within groups of equal cardinality, the configurations of those few sizes are optimised by
column generation and hold every large piece, actual pieces take the places of the rounded ones, and the small ones are
placed best-fit, longest first, together with those for which a configuration's last place is kept.
A plan is a list of runs: so many pieces of one length, from a rank on, go to consecutive sequences at one offset. Each
piece finds its place from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shingles
from .scratch import arrow_rows, save
from .tokens import CACHE_CHUNKS, arrow_texts, encoder, slices

#: Lengths over this share of the capacity are grouped; the others are small.
LARGE = 1 / 3
GROUPS = 48
#: Ranks within a length are counted in so many buckets, and in one more for every BUCKET_ROWS pieces.
BUCKETS = 256
BUCKET_ROWS = 50_000
#: Texts that Python workers are sent at once.
ARROW_ROWS = 2000


def groups_of(counts: np.ndarray, large: int, groups: int) -> list[list[tuple[int, int]]]:
    """Runs (length, pieces) of the large lengths, longest first, cut into groups of equal cardinality."""
    total = int(counts[large + 1 :].sum())
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length in range(len(counts) - 1, large, -1):
        n = int(counts[length])
        while n:
            if not room:
                out.append([])
                room = -(-total // groups)
            take = min(n, room)
            out[-1].append((length, take))
            n, room = n - take, room - take
    return out


def best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size fill the capacity with the greatest value (unbounded knapsack, one item more a step)."""
    room = np.arange(capacity + 1)[:, None] - sizes
    fits, room = room >= 0, np.maximum(room, 0)
    best, picks = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        found = np.where(fits, best[room] + values, 0.0)
        pick = found.argmax(axis=1)
        more = found[np.arange(capacity + 1), pick]
        better = more > best + 1e-12
        if not better.any():
            break
        picks.append(np.where(better, pick, -1))
        best = np.where(better, more, best)
    out, c = np.zeros(len(sizes), np.int64), capacity
    for pick in reversed(picks):
        if pick[c] >= 0:
            out[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return out


def relaxed(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often to use each, fractions allowed, by column generation; the most used first.

    A column that comes a second time ends the search (a degenerate cycle), so it ends without a limit on columns.
    """
    m = len(sizes)
    fill = capacity // sizes
    basis = np.diag(fill).astype(float)
    use = demand / fill
    seen: set[tuple] = set()
    while True:
        prices = np.linalg.solve(basis.T, np.ones(m))
        column = best_configuration(sizes, np.maximum(prices, 0), capacity)
        if column @ prices <= 1 + 1e-7 or tuple(column) in seen:
            break
        seen.add(tuple(column))
        step = np.linalg.solve(basis, column.astype(float))
        leaves = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(leaves.argmin())
        if not np.isfinite(leaves[out]):
            break
        use = np.maximum(use - leaves[out] * step, 0)
        use[out] = leaves[out]
        basis[:, out] = column
    return [(basis[:, k].astype(np.int64), float(use[k])) for k in np.argsort(-use, kind="stable")]


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations of a few sizes and how often to use each; together they hold the whole demand.

    Whole parts of the relaxed solution are taken and the rest of the demand is solved again; where no whole part is
    left, the configurations used half or more (the most used one at least) are taken once, as far as the demand goes.
    """
    left, found = demand.astype(np.int64).copy(), []
    while left.any():
        open_ = np.flatnonzero(left)
        solved = relaxed(sizes[open_], left[open_], capacity)
        whole = any(use >= 1 - 1e-6 for _, use in solved)
        taken = False
        for part, use in solved:
            column = np.zeros(len(sizes), np.int64)
            column[open_] = part
            if not whole and (not taken or use >= 0.5):
                column = np.minimum(column, left)
            needed = column > 0
            if not needed.any():
                continue
            fit = int((left[needed] // column[needed]).min())
            times = min(int(use + 1e-6), fit) if whole else min(1, fit) if not taken or use >= 0.5 else 0
            if times > 0:
                found.append((column, times))
                left -= column * times
                taken = True
        if not taken:  # whole parts overlap by rounding: one of the most used, cut to the demand
            column = np.zeros(len(sizes), np.int64)
            column[open_] = solved[0][0]
            column = np.minimum(column, left)
            found.append((column, 1))
            left -= column
    return found


class _Plan:
    """Runs of equally filled sequences, and the placements made so far."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.rank: dict[int, int] = defaultdict(int)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: runs (first sequence, sequences)
        self.rooms: list[int] = []

    def place(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.rows.append((length, self.rank[length], n, sequence, offset))
        self.rank[length] += n

    def keep(self, room: int, sequence: int, n: int) -> None:
        if room > 0 and n > 0:
            if not self.open[room]:
                bisect.insort(self.rooms, room)
            self.open[room].append((sequence, n))

    def new(self, n: int) -> int:
        first, self.sequences = self.sequences, self.sequences + n
        return first

    def best_fit(self, length: int, n: int) -> None:
        """Each piece goes where the least room is left that holds it, to a new sequence if none does."""
        while n:
            at = bisect.bisect_left(self.rooms, length)
            if at < len(self.rooms):
                room = self.rooms[at]
                sequence, have = self.open[room].pop()
                if not self.open[room]:
                    self.rooms.pop(at)
            else:
                room, have = self.capacity, -(-n // (self.capacity // length))
                sequence = self.new(have)
            each = room // length
            whole = min(have, n // each)
            for i in range(each if whole else 0):
                self.place(length, whole, sequence, self.capacity - room + i * length)
            self.keep(room - each * length, sequence, whole)
            n -= whole * each
            sequence, have = sequence + whole, have - whole
            if have and n:
                rest = min(n, each)
                for i in range(rest):
                    self.place(length, 1, sequence, self.capacity - room + i * length)
                self.keep(room - rest * length, sequence, 1)
                n, sequence, have = n - rest, sequence + 1, have - 1
            self.keep(room, sequence, have)


def make_plan(counts: np.ndarray, capacity: int, groups: int = GROUPS, share: float = LARGE) -> tuple[np.ndarray, int]:
    """Placements (length, first rank, pieces, first sequence, offset) and the number of sequences.

    ``counts[n]`` is the number of pieces of length n; lengths over that share of the capacity are large. The configurations open the sequences of all large pieces and
    place the pieces that lead them; the last place of a configuration of several goes to whichever piece fits the
    actual room best (rounding leaves gaps there that no small piece is small enough for). Best-fit, longest first,
    places those and the small ones. Without groups the plan is best-fit alone, for comparison in tests.
    """
    plan = _Plan(capacity)
    left = counts.astype(np.int64).copy()
    large = int(capacity * share)
    runs = groups_of(counts, large, groups) if groups else []
    if runs:
        sizes = np.array([r[0][0] for r in runs])
        demand = np.array([sum(n for _, n in r) for r in runs])
        distinct, where = np.unique(sizes, return_inverse=True)
        wanted = np.bincount(where, weights=demand).astype(np.int64)
        stock: list[list[tuple[int, int]]] = [[] for _ in distinct]
        for r, k in zip(runs, where, strict=True):
            stock[k].extend(r)
        for column, times in configurations(distinct, wanted, capacity):
            parts = [(plan.new(times), times, 0)]  # (first sequence, sequences, filled)
            slots = np.repeat(np.arange(len(column)), column)[::-1]
            for k in slots[: max(1, len(slots) - 1)]:  # the last place stays open for the piece that fits it best
                nxt = []
                for sequence, n, filled in parts:
                    while n:
                        length, have = stock[k].pop(0)
                        take = min(n, have)
                        if have > take:
                            stock[k].insert(0, (length, have - take))
                        plan.place(length, take, sequence, filled)
                        nxt.append((sequence, take, filled + length))
                        left[length] -= take
                        sequence, n = sequence + take, n - take
                parts = nxt
            for sequence, n, filled in parts:
                plan.keep(capacity - filled, sequence, n)
    for length in range(capacity, 0, -1):
        if left[length]:
            plan.best_fit(length, int(left[length]))
    return np.array(plan.rows, np.int64).reshape(-1, 5), plan.sequences


def pieces(docs: DataFrame, tokenizer_path: str, separator_id: int, capacity: int, cache_chunks: int = CACHE_CHUNKS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the separator, cut at the capacity only."""
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles.forget()  # if a near-copy task did not end in this worker
        enc = encoder(tokenizer_path, cache_chunks)
        for batch in batches:
            texts = arrow_texts(batch.column(1))
            names = batch.column(0).to_pylist()
            for a, b in slices(texts):
                rows = []
                for name, ids in zip(names[a:b], enc.encode_batch(texts[a:b]), strict=True):
                    ids = np.append(ids, np.uint32(separator_id)).astype("<u4")
                    rows += [(name, k, s, min(capacity, len(ids) - s), zlib.crc32(ids[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, t) for c, (_, t) in zip(columns[1:], fields, strict=True))], names=["doc_id", *(n for n, _ in fields)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(cut: DataFrame, capacity: int, groups: int = GROUPS) -> DataFrame:
    """Add sequence_id and offset to a table of pieces with a column length (1 to the capacity).

    Ranks within a length are counted in buckets of the doc_id's hash, so a length that a third of all pieces share is
    spread over many tasks; the table of first ranks has one row a length and bucket. A stored column ``_salt``, if
    there is one, spreads rows that are alike, too.
    """
    spark = cut.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").count().collect():  # a row for each length up to the capacity
        counts[row["length"]] = row["count"]
    buckets = BUCKETS + int(counts.sum()) // BUCKET_ROWS
    salt = [c for c in ("_salt",) if c in cut.columns]
    keyed = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", *salt), F.lit(buckets)))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n")).select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    ranked = keyed.withColumn("_row", F.row_number().over(within) - 1).join(first, ["length", "_bucket"]).withColumn("_rank", F.col("_first") + F.col("_row"))

    rows, _ = make_plan(counts, capacity, groups)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    shared = spark.sparkContext.broadcast(rows)  # its rows depend on the capacity, not on the number of pieces
    kept = [c for c in cut.columns if c not in salt]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        key = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])], names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.select(*kept).schema) + ", sequence_id long, offset long"
    return ranked.select(*kept, "_rank").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, separator_id: int = 0, capacity: int = 2048, cache_chunks: int = CACHE_CHUNKS) -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are a piece of the separator alone. A null doc_id is kept. Rows that repeat a doc_id are packed
    each for itself. An empty table gives no rows. Columns other than doc_id and text are not read. Long texts are many
    pieces; workers hold one slice of texts at a time, and the ids of ``cache_chunks`` chunks (about 250 bytes each).
    """
    cut = pieces(docs, tokenizer_path, separator_id, capacity, cache_chunks).withColumn("_salt", (F.rand() * BUCKETS).cast("int"))
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        stored = save(cut, "pieces")
    return place(stored, capacity)
