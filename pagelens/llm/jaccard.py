"""Exact n-gram Jaccard join by prefix filtering under several global orders.

Texts with equal shingle sets are one class. A class can link with another only if at least the threshold's share of
its shingles occurs elsewhere, and only if the two share a shingle within their prefixes under *every* global order of
the shingles. Orders: rarest first (document frequency over all classes, then hash), ascending hash, descending hash.

1. Signatures: every document's set size and a 128-bit fingerprint of its set; equal fingerprints make a class.
2. Shared shingles: 32-bit remainders of all shingles, cut in ranges of the hash, tell which occur in two documents.
   A batch of documents sends each distinct remainder once, so a shingle of a million documents costs no more than
   the number of batches. Classes with too few shared shingles can have no link and leave.
3. The first order's prefixes of the others are the index. Every class is checked first against one leader, that of the
   postings with which it shares most; that connects most groups with one candidate a class. Postings whose classes
   are not yet known to be connected then give the remaining pairs, so no link between two components is lost.
4. The candidates are intersected with those of the other orders: of each pair the prefixes under these orders meet
   first, and only pairs that share a token under both go on. For these the sets move and are held against each other.

A class that is in many pairs (a leader) has its set sent to several tasks, each with some of its pairs.

Frequencies, prefixes and candidates cover all documents, with no cap. Defined results: null and empty texts and texts
without words have no shingles, and are their own component; rows that repeat a doc_id are one node of the link graph;
a row without a doc_id is kept and linked with nothing; an empty table gives no rows; columns other than doc_id and
text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import arrow_rows, drop, give_back, save, tidy
from .shingles import shingle_sets
from .tokens import arrow_texts, slices

#: Bytes of text whose shingles are sent together.
BATCH_BYTES = 6_000_000
#: Shingles in a range of the hash, about: a task gathers one range at a time.
RANGE_SHINGLES = 1_500_000
#: Rounds in which the classes of a posting are checked against one of them, before all remaining pairs.
LEADER_ROUNDS = 2
#: Rows that Python workers are sent at once: whole texts, or the sets of two classes.
ARROW_ROWS = 1000
BROADCAST_IDS = 2_000_000
#: Rows of one token that a task joins with one copy of what they meet.
POSTING_ROWS = 1000
#: Pairs of one class that a task takes with one copy of its set.
CLASS_PAIRS = 256
MANY = 0xFFFF


def needed(n: int | np.ndarray, percent: int):
    """Shingles of a set of n that must be common with any set it links with."""
    return -(-n * percent // 100)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (set size), h1, h2 (fingerprint of the set)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = arrow_texts(batch.column(1))
            for a, b in slices(texts, 2_000_000):
                sets = shingle_sets(texts[a:b], width)
                prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                halves = np.frombuffer(b"".join(prints), ">i8").astype(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["doc_id", "n", "h1", "h2"])

    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long")


def shared_counts(docs: DataFrame, width: int, ranges: int) -> DataFrame:
    """doc_id, shared: how many of a document's shingles occur in another document too (rarely a few more, where the
    remainders of two shingles are equal; never fewer)."""

    @tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = arrow_texts(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in slices(texts, BATCH_BYTES):
                for c in range(a, b, MANY):  # a place in a batch takes 16 bits
                    part = slice(c, min(b, c + MANY))
                    yield from emit(ids[part], texts[part])

    def emit(ids: np.ndarray, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        sets = []
        for a, b in slices(texts, 2_000_000):
            sets += shingle_sets(texts[a:b], width)
        where = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(tokens, kind="stable")
        tokens, where = tokens[order], where[order]
        first = np.flatnonzero(np.diff(tokens, prepend=tokens[:1] + np.uint64(1))) if len(tokens) else np.zeros(0, np.int64)
        times = np.diff(first, append=len(tokens))
        again = np.repeat(times > 1, times)
        home = np.bincount(where[again], minlength=len(sets))
        single = np.where(times > 1, MANY, where[first]).astype("<u2")
        tokens = tokens[first]
        place = ((tokens >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(place, np.arange(ranges + 1))
        low = (tokens & np.uint64(0xFFFFFFFF)).astype("<u4")
        rows = {"range": [], "ids": [], "places": [], "tokens": [], "home": []}
        for r in np.flatnonzero(np.diff(cuts)):
            own = single[cuts[r] : cuts[r + 1]]
            some = np.unique(own[own != MANY])
            rows["range"].append(int(r))
            rows["ids"].append(ids[some].astype("<i8").tobytes())
            rows["places"].append(np.where(own == MANY, MANY, np.searchsorted(some, own)).astype("<u2").tobytes())
            rows["tokens"].append(low[cuts[r] : cuts[r + 1]].tobytes())
            rows["home"].append(None)
        found = np.flatnonzero(home)
        rows["range"].append(int(ids[0]) % ranges)
        rows["ids"].append(ids[found].astype("<i8").tobytes())
        rows["places"].append(b"")
        rows["tokens"].append(b"")
        rows["home"].append(home[found].astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict(rows, schema=sent)

    sent = pa.schema([("range", pa.int32()), ("ids", pa.binary()), ("places", pa.binary()), ("tokens", pa.binary()), ("home", pa.binary())])

    def count(group: pa.Table) -> pa.Table:
        ids, n, parts = [], [], []
        columns = [group.column(c).to_pylist() for c in ("ids", "places", "tokens", "home")]
        for doc, places, tokens, home in zip(*columns, strict=True):
            if home is not None:
                ids.append(np.frombuffer(doc, "<i8"))
                n.append(np.frombuffer(home, "<i8"))
            else:
                parts.append((np.frombuffer(doc, "<i8"), np.frombuffer(places, "<u2"), np.frombuffer(tokens, "<u4")))
        if parts:
            flat = np.concatenate([t for _, _, t in parts])
            flat.sort()
            twice = np.unique(flat[1:][flat[1:] == flat[:-1]])
            for doc, places, tokens in parts:
                if len(twice):
                    at = np.searchsorted(twice, tokens)
                    hit = (twice[np.minimum(at, len(twice) - 1)] == tokens) & (places != MANY)
                    total = np.bincount(places[hit], minlength=len(doc))
                    some = np.flatnonzero(total)
                    ids.append(doc[some])
                    n.append(total[some])
        give_back()
        return pa.table({"doc_id": pa.array(np.concatenate([np.zeros(0, np.int64), *ids]), pa.int64()), "shared": pa.array(np.concatenate([np.zeros(0, np.int64), *n]), pa.int64())})

    blobs = docs.mapInArrow(send, "range int, ids binary, places binary, tokens binary, home binary")
    return blobs.groupBy("range").applyInArrow(count, "doc_id long, shared long").groupBy("doc_id").agg(F.sum("shared").alias("shared"))


def class_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, h1, h2, tokens (the sorted set as little-endian bytes)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = arrow_texts(batch.column(1))
            for a, b in slices(texts, 2_000_000):
                sets = [s.astype("<u8").tobytes() for s in shingle_sets(texts[a:b], width)]
                halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s) for s in sets), ">i8").astype(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(s) // 8 for s in sets], pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(sets, pa.binary())], names=["doc_id", "n", "h1", "h2", "tokens"])

    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, tokens binary")


def explode_tokens(sets: DataFrame) -> DataFrame:
    """node, n, token: a row for each token of each set."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
            data = batch.column(2).to_pylist()
            for a, b in slices(data, 4_000_000):
                tokens = np.frombuffer(b"".join(data[a:b]), "<i8")
                times = np.array([len(x) // 8 for x in data[a:b]])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node[a:b], times)), pa.array(np.repeat(n[a:b], times).astype(np.int32)), pa.array(tokens)], names=["node", "n", "token"])

    return sets.select("node", "n", "tokens").mapInArrow(run, "node long, n int, token long")


def heavy_tokens(counts: DataFrame) -> tuple[DataFrame, bool]:
    """Tokens (of a table token, df) with more than POSTING_ROWS rows, in how many parts their rows are dealt, and
    whether there are few enough of them to broadcast."""
    heavy = counts.filter(F.col("df") > POSTING_ROWS).select("token", F.ceil(F.col("df") / POSTING_ROWS).cast("int").alias("_parts"))
    # never empty (a token in one part changes nothing), so plans are the same at every size
    heavy = save(heavy.union(counts.sparkSession.range(1).select(F.lit(0).cast("long"), F.lit(1))).groupBy("token").agg(F.max("_parts").alias("_parts")), "heavy")
    return heavy, heavy.count() <= BROADCAST_IDS


def by_token(rows: DataFrame, other: DataFrame, heavy: tuple[DataFrame, bool]) -> DataFrame:
    """The join of rows (token, node, ...) and others of the same tokens; rows of a heavy token are dealt to several
    tasks by their node, and the others go to each of these."""
    table, few = heavy
    parts = F.broadcast(table) if few else table
    left = rows.join(parts, "token", "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("node"), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    right = other.join(parts, "token", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return _join_parts(left, right, "token")


def _join_parts(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """The join of two tables by a long column and _part, as one long key: small tables of that kind are broadcast
    compactly, while a key of two columns takes a whole memory page of every executor."""
    key = F.col(name).bitwiseXOR(F.when(F.col("_part") > 0, F.xxhash64("_part")).otherwise(F.lit(0).cast("long")))
    left = left.withColumn("_key", key).drop("_part")
    right = right.withColumn("_other_key", key).drop("_part").withColumnRenamed(name, "_same")
    # different values with one key: told apart by a condition beside the key
    same = F.col(name).bitwiseXOR(F.col("_same")) == 0
    return left.join(right, (F.col("_key") == F.col("_other_key")) & same).drop("_key", "_other_key", "_same")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """The index of the first order: token, node, n, shared, position (from 0, rarest first), weight of every prefix token.

    A set's weight is the mean document frequency of its tokens: of a group of near copies, the text that the others
    come from weighs most.

    Tokens of one class alone cannot be common; without them a set keeps ``shared`` tokens, of which a partner must
    have ``needed(n)``, so one of the first shared - needed + 1 is common to both.
    """
    entries = explode_tokens(sets)
    often = save(entries.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "often")
    heavy = heavy_tokens(often)
    known = by_token(entries, often, heavy)
    per = Window.partitionBy("node")
    known = known.withColumns({"shared": F.count("*").over(per), "weight": F.sum("df").over(per) / F.col("n")})
    known = known.filter(F.col("shared") >= F.ceil(F.col("n") * percent / 100))
    known = known.withColumn("position", F.row_number().over(per.orderBy("df", "token")) - 1)
    known = known.filter(F.col("position") <= F.col("shared") - F.floor((F.col("n") * percent + 99) / 100))
    index = save(known.select("token", "node", "n", "shared", "position", "weight"), "index")
    for done in (often, heavy[0]):
        drop(sets.sparkSession, done)
    return index


def _beside(pairs: DataFrame, sets: DataFrame, columns: list[Column], once: bool = False) -> DataFrame:
    """Pairs a, b with the columns of both sets, as _x0, _x1, ... and _y0, _y1, ...; pairs is a saved table.

    A class of many pairs is cut in parts of CLASS_PAIRS pairs, each with a copy of its columns, so it fills no task.
    With ``once`` a class is the first of one pair at most.
    """
    few = pairs.count() // CLASS_PAIRS <= BROADCAST_IDS  # there are so many classes of several parts at most
    named = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = sets.join(named, "node", "left_semi")
    out = pairs
    for side, other, names in (("a", "b", "_x"), ("b", "a", "_y")):
        if once and side == "a":
            out = out.join(wanted.select(F.col("node").alias("a"), *(c.alias(f"{names}{i}") for i, c in enumerate(columns))), "a")
            continue
        parts = pairs.groupBy(side).agg(F.ceil(F.count("*") / CLASS_PAIRS).cast("int").alias("_parts")).filter("_parts > 1")
        parts = F.broadcast(parts) if few else parts
        own = wanted.select(F.col("node").alias(side), *(c.alias(f"{names}{i}") for i, c in enumerate(columns)))
        own = own.join(parts, side, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
        out = out.join(parts, side, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(other), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
        out = _join_parts(out, own, side)
    return out


@tidy
def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose prefixes share a token under each of two orders."""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("_x0", "_y0", "_x1", "_y1")]
        keep = [meet(x, y) and meet(v, w) for x, y, v, w in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def meet(x: bytes, y: bytes) -> bool:
    """Whether two sorted runs of tokens share one."""
    return len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True)) > 0


def verify(pairs: DataFrame, sets: DataFrame, percent: int, once: bool = False) -> DataFrame:
    """Pairs a, b whose sets link: the prefixes under ascending and descending hash must meet, then the exact test.
    ``once``: no class is the first of two pairs."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [links(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), percent) for x, y in zip(batch.column("_x0").to_pylist(), batch.column("_y0").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    spark = pairs.sparkSession
    pairs = save(pairs, "pairs")
    bytes_ = 8 * (F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1).cast("int")
    prefix = [F.substring("tokens", F.lit(1), bytes_), F.substring("tokens", -bytes_, bytes_)]
    near = save(_beside(pairs, sets, prefix, once).mapInArrow(_meeting, "a long, b long"), "near")
    found = save(_beside(near, sets, [F.col("tokens")], once).mapInArrow(run, "a long, b long"), "links")
    for done in (pairs, near):
        drop(spark, done)
    return found


def links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _close(percent: int):
    """Sizes of two sets that may link."""
    return (F.col("n") * 100 >= F.col("_n") * percent) & (F.col("_n") * 100 >= F.col("n") * percent)


def _mixed(rows: DataFrame, heavy: tuple[DataFrame, bool]) -> DataFrame:
    """The postings that hold classes of two labels or more."""
    spread = rows.groupBy("token").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).filter("_lo < _hi").select("token")
    return by_token(rows, spread, heavy)


def posting_pairs(rows: DataFrame, percent: int, heavy: tuple[DataFrame, bool] | None = None) -> DataFrame:
    """The distinct pairs a < b of classes that meet in a posting and may link.

    A pair is taken at any token that could be its first common one: the overlap that is left must suffice. Where rows
    have labels, pairs of one label are not made: the classes of a posting that are not of its commonest label are held
    against all others, so a label that fills a posting costs no more than its classes.
    """
    heavy = heavy or heavy_tokens(rows.groupBy("token").agg(F.count("*").alias("df")))
    left = rows
    apart = F.col("node") < F.col("_node")
    if "label" in rows.columns:
        sizes = rows.groupBy("token", "label").agg(F.count("*").alias("_n"))
        common = sizes.groupBy("token").agg(F.max(F.struct("_n", "label")).alias("_m")).select("token", F.col("_m.label").alias("_common"))
        rows = by_token(rows, common, heavy).withColumn("_few", F.col("label") != F.col("_common")).drop("_common")
        left = rows.filter("_few")
        apart = (F.col("label") != F.col("_label")) & (~F.col("__few") | apart)
    other = rows.select("token", *(F.col(c).alias("_" + c) for c in rows.columns if c not in ("token", "weight")))
    reach = F.least(F.col("shared") - F.col("position"), F.col("_shared") - F.col("_position"))
    overlap = reach * (100 + percent) >= (F.col("n") + F.col("_n")) * percent
    # the longer side is dealt, the shorter goes to every part
    dealt = by_token(other.withColumn("node", F.col("_node")), left.withColumnRenamed("node", "_left"), heavy)
    pairs = dealt.drop("node").withColumnRenamed("_left", "node").filter(apart).filter(_close(percent)).filter(overlap)
    return pairs.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()


def link_edges(index: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges a, b that connect exactly the classes that links connect (not all links: a spanning part of them).

    Classes of one label are known to be connected. In a leader round every class is held against one other class, the
    leader with which it shares the most postings; a posting's leader is its weightiest class, later a random one. A
    set that links with any of a group's sets keeps most tokens of the text they come from, so it mostly links with
    that too. Labels then follow the links found. What postings of several labels
    are left after that give all their pairs of different labels.
    """
    spark = sets.sparkSession
    labels = save(sets.select("node", F.col("node").alias("label")), "labels")
    heavy = heavy_tokens(index.groupBy("token").agg(F.count("*").alias("df")))
    found = None
    for turn in range(LEADER_ROUNDS):
        rows = _mixed(index.join(labels, "node"), heavy)
        first = F.col("weight") if turn == 0 else F.xxhash64(F.lit(turn), "label")
        key = F.struct(first.alias("h"), "node", "n", "label")
        leader = rows.groupBy("token").agg(F.max(key).alias("l")).select("token", F.col("l.node").alias("_node"), F.col("l.n").alias("_n"), F.col("l.label").alias("_label"))
        meets = by_token(rows, leader, heavy).filter(F.col("label") != F.col("_label")).filter(_close(percent)).groupBy("node", "_node").agg(F.count("*").alias("times"))
        chosen = meets.groupBy("node").agg(F.max(F.struct("times", "_node")).alias("c")).select(F.col("node").alias("a"), F.col("c._node").alias("b"))
        new = verify(chosen, sets, percent, once=True)
        found = new if found is None else found.union(new)
        here, there = (labels.select(F.col("node").alias(c), F.col("label").alias(f"_{c}")) for c in "ab")
        hooks = new.join(here, "a").join(there, "b").select(F.greatest("_a", "_b").alias("label"), F.least("_a", "_b").alias("_to")).filter("label <> _to").groupBy("label").agg(F.min("_to").alias("_to"))
        moved = save(labels.join(hooks, "label", "left").select("node", F.coalesce("_to", "label").alias("label")), "labels")
        drop(spark, labels)
        labels = moved
    rows = save(_mixed(index.join(labels, "node"), heavy), "open")
    rest = verify(posting_pairs(rows, percent, heavy), sets, percent)
    for done in (labels, rows, heavy[0]):
        drop(spark, done)
    return found.union(rest)


def _classes(docs: DataFrame, width: int, percent: int, apart: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Signatures of the documents, classes (node, first, h1, h2, n), and the sets and the index of classes that may link.

    first is a class's smallest doc_id and its node. Where rows repeat a doc_id, classes may have one node in common,
    which is enough for what is connected; with ``apart`` each has a node of its own, and its size.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = save(signatures(texts, width), "signatures")
    total = signed.agg(F.sum("n")).first()[0] or 0
    same = signed.filter("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2", "n")
    if apart:
        classes = save(same.agg(F.min("doc_id").alias("first"), F.count("*").alias("size")).withColumn("node", F.monotonically_increasing_id()), "classes")
    else:
        classes = save(same.agg(F.min("doc_id").alias("node")), "classes").withColumn("first", F.col("node"))
    ranges = max(64, 2 * spark.sparkContext.defaultParallelism, int(total) // RANGE_SHINGLES)
    shared = shared_counts(texts.filter("doc_id IS NOT NULL"), width, ranges)
    busy = classes.join(shared, classes["first"] == shared.doc_id).filter(F.col("shared") * 100 >= F.col("n") * percent).select("node", "first", "h1", "h2")
    busy = save(busy, "busy")
    wanted = busy.select(F.col("first").alias("doc_id")).distinct()
    # ids of 8 bytes: broadcast up to a checked number of them, so whole texts are not shuffled; joined by shuffle beyond
    wanted = F.broadcast(wanted) if busy.count() <= BROADCAST_IDS else wanted
    whole = class_sets(texts.join(wanted, "doc_id", "left_semi"), width)
    kept = whole.join(busy, (whole.doc_id == busy["first"]) & (whole.h1 == busy.h1) & (whole.h2 == busy.h2)).select("node", "n", "tokens")
    sets = save(kept.dropDuplicates(["node", "tokens"]), "sets")
    index = prefixes(sets, percent)
    drop(spark, busy)
    return signed, classes, sets, index


def _labelled(signed: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """classes with _component; edges are between their first doc_ids."""
    # a doc_id that stands before different texts connects their classes
    named = signed.filter("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("lo"), F.max(F.struct("h1", "h2")).alias("hi"))
    again = save(named.filter("lo <> hi").select("doc_id"), "again")
    if again.limit(1).count():
        edges = edges.union(signed.join(again, "doc_id", "left_semi").join(classes, ["h1", "h2", "n"]).select(F.col("doc_id").alias("a"), F.col("first").alias("b")))
    labels = components(edges)
    drop(signed.sparkSession, again)
    return classes.join(labels.withColumnRenamed("node", "first"), "first", "left").withColumn("_component", F.coalesce("component", "first"))


def _component_id() -> Column:
    return F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("_component")), F.col("doc_id")).alias("component_id")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links of Jaccard similarity percent/100)."""
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        signed, classes, sets, index = _classes(docs, width, percent)
        edges = link_edges(index, sets, percent)
        named = _labelled(signed, classes, edges)
        for done in (sets, index, edges):
            drop(docs.sparkSession, done)
    return signed.join(named.select("h1", "h2", "n", "_component"), ["h1", "h2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), _component_id())


def class_links(docs: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All links of the join: signatures of the documents (doc_id, n, h1, h2), classes (node, first, size, h1, h2, n)
    and every pair a < b of classes that link, each pair once. Every candidate pair of classes is verified, those of
    connected groups too, so the pairs of a large group of near copies grow with the square of its different texts."""
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        signed, classes, sets, index = _classes(docs, width, percent, apart=True)
        heavy = heavy_tokens(index.groupBy("token").agg(F.count("*").alias("df")))
        found = verify(posting_pairs(index, percent, heavy), sets, percent)
        for done in (sets, index, heavy[0]):
            drop(docs.sparkSession, done)
    return signed, classes, found


def jaccard_links(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, n_links, component_id; n_links: other rows whose texts link with the row's, equal texts
    among them. Components follow from all links."""
    signed, classes, found = class_links(docs, width, percent)
    both = found.union(found.select("b", "a"))
    beside = both.join(classes.select(F.col("node").alias("b"), "size"), "b").groupBy("a").agg(F.sum("size").alias("beside"))
    here, there = (classes.select(F.col("node").alias(c), F.col("first").alias(f"_{c}")) for c in "ab")
    edges = found.join(here, "a").join(there, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    counted = _labelled(signed, classes, edges).join(beside.withColumnRenamed("a", "node"), "node", "left")
    counted = counted.select("h1", "h2", "n", "_component", (F.col("size") - 1 + F.coalesce("beside", F.lit(0))).alias("_links"))
    links_of = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("_links")), F.lit(0)).alias("n_links")
    return signed.join(counted, ["h1", "h2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), links_of, _component_id())


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without the near copies: of each component, the row of its smallest doc_id stays.

    A row without a doc_id stays. Of rows that repeat the doc_id that stays, all stay.
    """
    found = jaccard_components(docs, width, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(found, docs["doc_id"] == found["_gone"], "left_anti")
