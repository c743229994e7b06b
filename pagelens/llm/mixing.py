"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source is cut into blocks by a seeded hash of the document, in proportion to its size. What the mix takes of a source
is whole passes over all its blocks, then blocks of a seeded permutation up to the target; one block is cut between two
documents and one document between two words, so the target is met. Output shards get exact block quotas of every
source: the root holds all blocks, each node draws its left half's share without replacement (multivariate
hypergeometric), and leaves take the next blocks of each source's permutation, so shards are disjoint. Documents are
then shuffled within a shard by a seeded key.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, save, small_table, unused

#: Blocks of all sources together, and one more for each source at most.
BLOCKS = 16_384
SHARDS = 64
#: The plan is broadcast up to so many rows (under 100 bytes each) and joined by shuffle beyond.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Number of runs of bytes other than space and the control characters 9 to 13; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], budget: float, most: float) -> list[float]:
    """Shares of the budget by weight; a source stops at ``most`` times its size, its excess is shared by weight."""
    out = [0.0] * len(sizes)
    open_, left = [i for i, s in enumerate(sizes) if s > 0], budget
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total >= most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = most * float(sizes[i])
        left -= sum(most * sizes[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def shard_quotas(blocks: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """How many blocks of each source every shard gets: a row a shard, exact column sums, row sums equal up to one."""
    out = np.zeros((shards, len(blocks)), np.int64)

    def split(have: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        total = int(have.sum())
        ends = [total * k // (hi - lo) for k in (0, mid - lo)]
        left = rng.multivariate_hypergeometric(have, ends[1] - ends[0], method="marginals") if total else have * 0
        split(left, lo, mid)
        split(have - left, mid, hi)

    split(blocks, 0, shards)
    return out


def _source_key(source: Column) -> list[Column]:
    return [source.isNull().alias("_none"), F.coalesce(source.cast("string"), F.lit("")).alias("_source")]


#: What the mix says of a document.
ADDED = ("size", "source_size", "target", "copies", "part", "taken", "shards", "shuffle_key")


def added_names(columns: list[str]) -> dict[str, str]:
    """The names of what is added to documents with these columns: one that they have gets ``mix_`` before it."""
    return {c: unused(c, columns, "mix_") for c in ADDED}


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = 7) -> DataFrame:
    """Add size, source_size, target, copies, part, taken and shards to every document.

    The mix takes ``copies`` whole copies of a document and the first ``part`` words once more (part is 0 but for the
    one document a source is cut at; rows equal in doc_id and size share that place); ``shards`` lists the output shard
    of each of them, ``shuffle_key`` the order within a shard. Sources go by code point, null last, and weigh
    ``weights`` in turn. Null text and text without words have size 0 and take nothing. All columns of the documents
    stay as they are; see :func:`added_names` for the names of what is added. Texts are only counted, never moved or
    cut; rows that repeat are taken each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    names_out = added_names(docs.columns)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    sized = docs.select(row, words(F.col("text")).alias("size"), F.col("doc_id").alias("_doc"), *_source_key(F.col("source")))
    order = F.xxhash64(F.lit(seed), F.col("_doc"), F.col("size")).alias("_order")
    narrow = save(sized.select("_none", "_source", order, "size"), "sizes")
    totals = sorted((r["_none"], r["_source"].encode(), r["n"], r["docs"]) for r in narrow.groupBy("_none", "_source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).collect())
    if not totals:
        kinds = dict(zip(ADDED, ("long", "long", "double", "int", "long", "long", "array<int>", "long"), strict=True))
        return docs.select(*(F.col(f"`{c}`") for c in docs.columns), *(F.lit(None).cast(t).alias(names_out[c]) for c, t in kinds.items()))
    sizes = [t[2] for t in totals]
    whole = sum(sizes)
    goals = targets(sizes, [weights[i % len(weights)] for i in range(len(totals))], share * whole, most)
    cuts = [max(1, min(docs_, -(-n * blocks // whole))) if whole else 1 for _, _, n, docs_ in totals]
    names = [(none, source.decode()) for none, source, _, _ in totals]
    per_source = small_table(spark, [(*k, c) for k, c in zip(names, cuts, strict=True)], "_none boolean, _source string, _cuts int")
    per_source = F.broadcast(per_source) if len(names) <= BROADCAST_ROWS else per_source
    block = F.pmod(F.shiftright("_order", 8), F.col("_cuts")).cast("int")
    held = {(r["_none"], r["_source"], r["_block"]): r["n"] for r in narrow.join(per_source, ["_none", "_source"]).groupBy("_none", "_source", block.alias("_block")).agg(F.sum("size").alias("n")).collect()}

    rng = np.random.default_rng(seed)
    passes, permuted, partial = [], [], []
    for k, cut, goal, size in zip(names, cuts, goals, sizes, strict=True):
        whole_passes = int(goal // size) if size else 0
        need = round(goal - whole_passes * size) if size else 0
        drawn = rng.permutation(cut)
        ends = np.cumsum([held.get((*k, int(b)), 0) for b in drawn])
        at = int(np.searchsorted(ends, need, side="right"))  # blocks before this one are taken whole
        passes.append(whole_passes)
        permuted.append(drawn[:at])
        rest = need - (int(ends[at - 1]) if at else 0)
        partial.append((int(drawn[at]), rest) if at < cut and rest > 0 else (-1, 0))
    # the document at which a source's last block is cut: one row a source
    last = small_table(spark, [(*k, c, b, rest) for k, c, (b, rest) in zip(names, cuts, partial, strict=True) if b >= 0] or [(False, "", 1, -1, 0)], "_none boolean, _source string, _cuts int, _block int, _rest long")
    last = F.broadcast(last) if len(names) <= BROADCAST_ROWS else last
    edge = narrow.join(last, ["_none", "_source"]).filter(block == F.col("_block")).groupBy("_none", "_source", "_rest", "_order").agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
    running = Window.partitionBy("_none", "_source").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("end", F.sum("n").over(running)).filter("end >= _rest").groupBy("_none", "_source").agg(F.min(F.struct("_order", "n", "end", "rows", "_rest")).alias("e"))
    edges = {(r["_none"], r["_source"]): r["e"] for r in edge.collect()}
    drop(spark, narrow)

    # whole passes and the drawn part are dealt out to shards separately for each pass
    plan: dict[tuple, list[int]] = {}
    for p in range(max([0, *passes]) + 1):
        lists = [rng.permutation(c) if p < n else drawn if p == n else np.zeros(0, np.int64) for c, n, drawn in zip(cuts, passes, permuted, strict=True)]
        quotas = shard_quotas(np.array([len(x) for x in lists], np.int64), shards, rng) if lists else np.zeros((shards, 0), np.int64)
        for i, (k, x) in enumerate(zip(names, lists, strict=True)):
            for b, shard in zip(x.tolist(), np.repeat(np.arange(shards), quotas[:, i]).tolist(), strict=True):
                plan.setdefault((*k, b), []).append(shard)
    rows = []
    for k, cut, size, goal, (cut_block, rest) in zip(names, cuts, sizes, goals, partial, strict=True):
        for b in range(cut):
            got = plan.get((*k, b), [])
            e = edges[k] if b == cut_block else None
            edge_at, edge_part = (None, None) if e is None else (e["_order"], (rest - (e["end"] - e["n"])) // e["rows"])
            rows.append((*k, b, goal, size, got, edge_at, edge_part, int(rng.integers(shards))))
    table = small_table(spark, rows, "_none boolean, _source string, _block int, target double, source_size long, _shards array<int>, _edge long, _part long, _extra int")
    table = F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table
    joined = sized.withColumn("_order", order).join(per_source, ["_none", "_source"]).withColumn("_block", block).join(table, ["_none", "_source", "_block"])
    some, none = F.col("size") > 0, F.array().cast("array<int>")
    more = F.coalesce(some & (F.col("_order") < F.col("_edge")), F.lit(False))
    out = joined.withColumns({
        "part": F.coalesce(F.when(some & (F.col("_order") == F.col("_edge")), F.col("_part")), F.lit(0)).cast("long"),
        "copies": F.when(some, F.size("_shards") + more.cast("int")).otherwise(0).cast("int"),
        "shuffle_key": F.xxhash64(F.lit(seed + 1), F.col("_doc"), F.col("size")),
    })
    extra = F.when(more | (F.col("part") > 0), F.array("_extra")).otherwise(none)
    out = out.withColumns({"shards": F.when(some, F.concat("_shards", extra)).otherwise(none), "taken": F.col("copies") * F.col("size") + F.col("part")})
    return out.select("_row.*", *(F.col(c).alias(names_out[c]) for c in ADDED))


def materialise(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix of documents with these columns, as documents: a row for each copy; the first words of a cut document,
    one space between, are a row too. Columns other than text (and n_chars, its length) stay as they are."""
    none = F.array().cast("array<int>")
    names = added_names(columns)
    copies, part = F.col(names["copies"]), F.col(names["part"])
    each = F.concat(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(none), F.when(part > 0, F.array(F.lit(0))).otherwise(none))
    row = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row")
    rows = mixed.select(row, part.cast("int").alias("_part"), F.explode(each).alias("_copy"))
    word = F.filter(F.split("_row.text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.col("_copy") == 0
    rows = rows.withColumn("_text", F.when(cut, F.array_join(F.slice(word, F.lit(1), F.col("_part")), " ")).otherwise(F.col("_row.text")))
    own = {"text": F.col("_text"), "n_chars": F.when(cut, F.length("_text").cast("long")).otherwise(F.col("_row.n_chars") if "n_chars" in columns else F.lit(None))}
    return rows.select(*((own[c] if c in own else F.col(f"_row.`{c}`")).alias(c) for c in columns))
