"""Token-ID output: frequency-ranked ids in byte-aligned variable-length coding, control bytes apart from data bytes.

Each id is replaced by its rank (0: the most frequent id of the whole corpus), so that frequent ids take one byte. A
block of ranks is stored as control bytes (two bits an id: its length in bytes less one, four ids a byte) followed by
the data bytes; numpy decodes a block by looking the control bytes up in a table of lengths.

File: magic, blocks, a table of the documents (doc_id, ids; the complement of ids for a null doc_id), and a trailer that
says where that table starts.
``ranks.bin`` beside the files holds the id of every rank as unsigned 32-bit integers.

Defined results: null text is empty and has the end id alone; null doc_ids come first in the files with
``null_ids`` and are refused without; rows that repeat a doc_id each get their own entry, in order of a hash of their
ids; an empty table makes no files; columns other than doc_id and text are not read, whatever their names; a writer and
a reader hold one block and one document.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import commit_file, drop, filesystem_of, new_folder, save
from .tokens import arrow_texts, encoder, slices

MAGIC = b"IDR1"
_BLOCK = "<IIq"
_TRAILER = "<qq4s"
#: Ids in a block: a reader holds one block at a time.
BLOCK_IDS = 1 << 17
#: Ids in a file, about.
SHARD_IDS = 8_000_000

#: Lengths in bytes of the four ids that a control byte describes.
LENGTHS = 1 + ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3)


def encode_block(ranks: np.ndarray) -> bytes:
    """A block of ranks with its header."""
    ranks = ranks.astype(np.uint32)
    lengths = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = lengths - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    ends = np.cumsum(lengths)
    data = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(4):
        has = lengths > k
        data[(ends - lengths)[has] + k] = (ranks[has] >> np.uint32(8 * k)) & np.uint32(0xFF)
    return struct.pack(_BLOCK, len(ranks), len(control), len(data)) + control.tobytes() + data.tobytes()


def decode_block(count: int, control: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Ranks of a block, by table lookup of its control bytes."""
    lengths = LENGTHS[control].reshape(-1)[:count]
    starts = np.cumsum(lengths) - lengths
    ranks = np.zeros(count, np.uint32)
    for k in range(4):
        has = lengths > k
        ranks[has] |= data[starts[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens, width, ids (little-endian bytes, two an id where the vocabulary allows), counts: the end id
    closes each document.

    Each task's last row has neither n_tokens nor ids but counts: how often its documents have each id (the ids, then
    the numbers, as 64-bit integers).
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        size = max(enc.vocab_size, end_id + 1)
        kind = "<u2" if size <= 1 << 16 else "<u4"
        total, end = np.zeros(size, np.int64), np.array([end_id], kind)
        for batch in batches:
            texts = arrow_texts(batch.column(1))
            for a, b in slices(texts):
                ids = [np.concatenate([x.astype(kind), end]) for x in enc.encode_batch(texts[a:b])]
                total += np.bincount(np.concatenate(ids), minlength=size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.itemsize for x in ids], pa.int32()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.nulls(b - a, pa.binary())],
                    schema=schema,
                )
        used = np.flatnonzero(total)
        if len(used):
            yield pa.RecordBatch.from_pydict({"doc_id": [None], "n_tokens": [None], "width": [None], "ids": [None], "counts": [np.array([used, total[used]], "<i8").tobytes()]}, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, width int, ids binary, counts binary")


def id_counts(encoded: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in the corpus, from the tasks' own counts."""

    def run(batches):
        for batch in batches:
            for counts in batch.column(0).to_pylist():
                used, total = np.frombuffer(counts, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total, pa.int64())], names=["id", "n"])

    counts = np.zeros(size, np.int64)
    for row in encoded.filter("counts IS NOT NULL").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row.id] = row.n
    return counts


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int, shard_ids: int = SHARD_IDS, *, null_ids: bool = False) -> tuple[str, list[dict]]:
    """Write the files in ascending doc_id order (null first, if ``null_ids`` allows it); returns their folder's URI and one entry a file, in order.

    Entries: path, ids, documents, bytes, start (ids in all files before it). There is one entry for about
    ``shard_ids`` ids, so the list stays small at any size.
    """
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1)
    # rows that repeat a doc_id are spread by a hash of their ids, and those alike by a stored number
    stored = encode_documents(docs, tokenizer_path, end_id).withColumns({"h": F.xxhash64("ids"), "salt": (F.rand() * 1024).cast("int")})
    stored = save(stored, "ids")
    counts = id_counts(stored, size)
    encoded = stored.filter("counts IS NULL")
    if not null_ids and encoded.filter("doc_id IS NULL").limit(1).count():
        raise ValueError("write_ids: doc_id is null")
    by_rank = np.argsort(-counts, kind="stable").astype(np.uint32)
    rank_of = np.empty(size, np.uint32)
    rank_of[by_rank] = np.arange(size, dtype=np.uint32)
    folder = new_folder(spark, "idfiles")
    filesystem, inner = filesystem_of(folder)
    filesystem.create_dir(inner, recursive=True)
    with filesystem.open_output_stream(f"{inner}/ranks.bin") as out:
        out.write(by_rank.astype("<u4").tobytes())
    shards = max(1, -(-int(counts.sum()) // shard_ids), spark.sparkContext.defaultParallelism)
    ranks = spark.sparkContext.broadcast(rank_of)  # one entry an id of the vocabulary

    def run(batches):
        shard = TaskContext.get().partitionId()
        filesystem, inner = filesystem_of(folder)
        name, temporary = f"{inner}/{shard:06d}.idr", f"{inner}/.{shard:06d}.{TaskContext.get().taskAttemptId()}"
        names, lengths, held, n_held, at, total = [], [], [], 0, len(MAGIC), 0
        out = None

        def flush(all_of_it: bool) -> None:
            nonlocal held, n_held, at
            if n_held >= BLOCK_IDS or (all_of_it and n_held):
                flat = np.concatenate(held)
                cut = len(flat) if all_of_it else len(flat) // BLOCK_IDS * BLOCK_IDS
                for i in range(0, cut, BLOCK_IDS):
                    block = encode_block(flat[i : min(cut, i + BLOCK_IDS)])
                    out.write(block)
                    at += len(block)
                held, n_held = [flat[cut:]], len(flat) - cut

        for batch in batches:
            for doc, width, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = filesystem.open_output_stream(temporary)
                    out.write(MAGIC)
                part = ranks.value[np.frombuffer(ids, f"<u{width}")]
                names.append(0 if doc is None else doc)
                lengths.append(~len(part) if doc is None else len(part))
                held.append(part)
                n_held += len(part)
                total += len(part)
                flush(False)
        if out is not None:
            flush(True)
            table = np.array([names, lengths], "<i8").tobytes()
            out.write(table + struct.pack(_TRAILER, at, len(names), MAGIC))
            out.close()
            commit_file(filesystem, temporary, name)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{folder}/{shard:06d}.idr"], "ids": [total], "documents": [len(names)], "bytes": [at + len(table) + struct.calcsize(_TRAILER)]}, schema=schema)

    schema = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("ids", pa.int64()), ("documents", pa.int64()), ("bytes", pa.int64())])
    order = ["doc_id", "h", "salt"]
    ordered = encoded.select("doc_id", "width", "ids", "h", "salt").repartitionByRange(shards, *order).sortWithinPartitions(*order)
    made = save(ordered.select("doc_id", "width", "ids").mapInArrow(run, "shard int, path string, ids long, documents long, bytes long"), "idfiles-made")
    written = made.orderBy("shard").collect()  # a row a file
    for done in (stored, made):
        drop(spark, done)
    entries, start = [], 0
    for row in written:
        entries.append({**row.asDict(), "start": start})
        start += row.ids
    return folder, entries


def read_file(path: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """doc_id, ids before it in the file, and ids of each document of one file; one block is held at a time."""
    filesystem, inner = filesystem_of(path)
    with filesystem.open_input_file(f"{inner.rsplit('/', 1)[0]}/ranks.bin") as source:
        by_rank = np.frombuffer(source.read(), "<u4")
    with filesystem.open_input_file(inner) as source:
        source.seek(source.size() - struct.calcsize(_TRAILER))
        table, documents, magic = struct.unpack(_TRAILER, source.read(struct.calcsize(_TRAILER)))
        source.seek(0)
        if magic != MAGIC or source.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is not an id file")
        source.seek(table)
        names, lengths = np.frombuffer(source.read(16 * documents), "<i8").reshape(2, documents)
        source.seek(len(MAGIC))
        held, start = np.zeros(0, np.uint32), 0
        for doc, length in zip(names.tolist(), lengths.tolist(), strict=True):
            doc, length = (None, ~length) if length < 0 else (doc, length)
            parts, have = [held], len(held)
            while have < length:
                count, n_control, n_data = struct.unpack(_BLOCK, source.read(struct.calcsize(_BLOCK)))
                control, data = np.frombuffer(source.read(n_control), np.uint8), np.frombuffer(source.read(n_data), np.uint8)
                parts.append(by_rank[decode_block(count, control, data)])
                have += count
            flat = np.concatenate(parts) if len(parts) > 1 else held
            held = flat[length:]
            yield doc, start, flat[:length]
            start += length


def read_ids(spark, entries: list[dict], *, digest: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, and their ids — or, with ``digest``, the ids' crc32."""
    last = "ids_crc32 long" if digest else "ids array<long>"
    schema = f"doc_id long, start long, n_tokens long, {last}"
    if not entries:
        return spark.createDataFrame([], schema)

    def made(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", last.split()[0]]).assign(doc_id=pd.array([r[0] for r in rows], "Int64"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, base in zip(frame["path"], frame["start"], strict=True):
                rows = []
                for doc, start, ids in read_file(path):
                    rows.append((doc, int(base) + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.astype(np.int64)))
                    if len(rows) == 4096:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    files = spark.createDataFrame([(e["path"], e["start"]) for e in entries], "path string, start long")
    return files.repartition(len(entries)).mapInPandas(run, schema)
