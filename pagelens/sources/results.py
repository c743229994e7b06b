"""Result files: safe names, no two alike, written by the tasks that hold the rows."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.urls import path_expr

from .shared import save


def safe_name(name: Column) -> Column:
    """A name without folders and control characters; null if nothing usable is left or it starts with a dot."""
    last = F.regexp_extract(F.regexp_replace(name, r"/+$", ""), r"([^/]*)$", 1)
    clean = F.trim(F.regexp_replace(last, r"[\x00-\x1F\x7F]", ""))
    return F.when((clean != "") & ~clean.startswith("."), clean)


def result_name(suggested: Column, url: Column) -> Column:
    """The suggested name, else the URL's last segment, else ``result``."""
    return F.coalesce(safe_name(suggested), safe_name(F.regexp_extract(path_expr(url), r"([^/]*)$", 1)), F.lit("result"))


def _numbered(name: Column, n: Column) -> Column:
    stem, suffix = F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(?s)^.+?(\.[^.]+)?$", 1)
    return F.concat(stem, F.format_string(" (%d)", n), suffix)


def distinct_names(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add file_name to rows with name: the second of a name is ``stem (2).ext``, and so on, in the order given.

    A number whose name another row has by itself is passed over. Ranks are counted in ranges of name and order and
    summed up over the ranges, so a name that a third of the rows have fills no task.
    """
    spark = rows.sparkSession
    keys = [F.col("name"), *map(F.col, order)]
    ranges = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # stored, as ranges must not be cut anew between the two reads
    ranged = save(rows.repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id()), "named")
    before = Window.partitionBy("name").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = ranged.groupBy("name", "_range").agg(F.count("*").alias("_c")).select("name", "_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy("name", "_range").orderBy(*order))
    ranked = ranged.withColumn("_row", within).join(first, ["name", "_range"]).withColumn("_k", (F.col("_first") + F.col("_row")).cast("int"))
    # numbers of a name that other names spell out: of each, how many free numbers come before it
    spelled = first.select("name").distinct().withColumns({"_n": F.regexp_extract("name", r"(?s) \((\d{1,9})\)(\.[^.]+)?$", 1).try_cast("int"), "_base": F.regexp_replace("name", r"(?s) \(\d{1,9}\)((?:\.[^.]+)?)$", "$1")})
    spelled = spelled.filter((F.col("_n") >= 2) & (F.col("name") == _numbered(F.col("_base"), F.col("_n")))).select(F.col("_base").alias("name"), "_n")
    taken = spelled.withColumn("_before", F.col("_n") - F.row_number().over(Window.partitionBy("name").orderBy("_n")) + 1)
    # row k takes number k and one more for each spelled number with fewer than k numbers before it
    above = taken.groupBy("name").agg(F.sort_array(F.collect_list("_before")).alias("_taken"))
    more = F.coalesce(F.size(F.filter("_taken", lambda b: b <= F.col("_k"))), F.lit(0))
    named = ranked.join(above, "name", "left")
    file_name = F.when(F.col("_k") == 1, F.col("name")).otherwise(_numbered(F.col("name"), F.col("_k") + F.greatest(more, F.lit(0))))
    return named.withColumn("file_name", file_name).select(*rows.columns, "file_name")


def candidate_names(name: str) -> Iterator[str]:
    """The name, then ``stem (2).ext``, ``stem (3).ext`` and so on."""
    yield name
    dot = name.rfind(".")
    stem, suffix = (name[:dot], name[dot:]) if 0 < dot < len(name) - 1 else (name, "")
    for n in count(2):
        yield f"{stem} ({n}){suffix}"


def _claim(filesystem: pafs.FileSystem, part: str, folder: str, name: str, content: bytes) -> str:
    """Give a finished file the first of its names that no other file has; returns that name.

    Nothing is overwritten. A file with the same bytes under a name is taken for this one: the task ran before.
    """
    local = isinstance(filesystem, pafs.LocalFileSystem)
    for candidate in candidate_names(name):
        final = f"{folder}/{candidate}"
        try:
            if local:
                os.link(part, final)  # fails where the name is taken, in one step
            elif filesystem.get_file_info(final).type == pafs.FileType.NotFound:
                filesystem.move(part, final)
                return candidate
            else:
                raise FileExistsError(final)
        except FileExistsError:
            with filesystem.open_input_file(final) as there:
                if there.size() != len(content) or there.read() != content:
                    continue
        filesystem.delete_file(part)
        return candidate


def write_results(rows: DataFrame, folder: str) -> DataFrame:
    """Write the bytes of rows (file_name, content) to a shared folder (a path or URI); returns file_name, path, bytes.

    A file is written beside its name and given it in one step, so no half file is ever seen. A name that another file
    has already, from this job or before, stays with that file: the new one takes the next number, and the row says
    which. A task that is run again finds its files by their bytes. On local and mounted file systems a name is claimed
    in one step; on object stores it is looked up before the move, so two jobs should not write one folder at a time.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, inner = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        filesystem.create_dir(inner, recursive=True)
        for frame in frames:
            out = []
            for name, content in zip(frame["file_name"], frame["content"], strict=True):
                part = f"{inner}/.{uuid.uuid4().hex}.part"
                with filesystem.open_output_stream(part, compression=None) as file:
                    file.write(content)
                own = _claim(filesystem, part, inner, name, content)
                out.append((own, f"{folder.rstrip('/')}/{own}", len(content)))
            yield pd.DataFrame(out, columns=["file_name", "path", "bytes"])

    return rows.select("file_name", "content").mapInPandas(run, "file_name string, path string, bytes long")
