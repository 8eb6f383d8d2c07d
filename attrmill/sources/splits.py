"""Records of quoted text files, cut from many file splits at once.

Spark's text source cuts a file into byte ranges and its lines at a separator; a separator
inside quotes must not cut. Whether a piece starts inside quotes is a matter of parity: the
number of pieces before it with an odd number of quotes. Every split counts its own, a running
sum over the splits of a file (one row per split) carries the count on, and the task that reads a
split goes on counting and joins the records cut inside it. No piece is shuffled but the ends of
records that lie across splits.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, start, at, value): start names the split, at grows with the place inside it."""
    return spark.read.text(path, lineSep=separator).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )


def carried(per_split: DataFrame, value: str) -> Column:
    """Sum of `value` over the earlier splits of the file."""
    w = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


_STITCHED = "file string, start long, at long, cut long, value string"


def _stitched(batches, separator: str, whole: bool):
    """Of pieces in the order of their splits, the records that lie in one split (``whole``) or the
    parts, joined inside their split, of those that lie in several; ``cut`` numbers the latter."""
    split, seen, held = None, 0, None  # quotes before the next piece; the open record: (at, cut, starts here, texts)

    def rest():
        # what a split leaves open goes on in the next one
        nonlocal held
        if held and not whole:
            out.append((*split, held[0], held[1], separator.join(held[3])))
        held = None

    for b in batches:
        files, starts, at = b.column(0).dictionary_encode(), b.column(1).to_numpy(), b.column(2).to_numpy()
        name = files.indices.to_numpy()
        edges = np.flatnonzero((starts[1:] != starts[:-1]) | (name[1:] != name[:-1])) + 1
        out, ready = [], []
        for lo, hi in zip([0, *edges], [*edges, b.num_rows] if b.num_rows else []):
            here = (files.dictionary[int(name[lo])].as_py(), int(starts[lo]))
            if here != split:
                rest()
                split, seen = here, b.column(5)[int(lo)].as_py()
            odd = b.column(4).slice(lo, hi - lo).to_numpy()
            after = seen + np.cumsum(odd)
            before, seen = after - odd, int(after[-1])
            ends = np.flatnonzero(after % 2 == 0) + 1  # records end with these pieces
            first, last = (int(ends[0]), int(ends[-1])) if len(ends) else (0, 0)
            texts = b.column(3).slice(lo, hi - lo)
            done = 0  # pieces that are dealt with
            if held or before[0] % 2:
                held = held or (int(at[lo]), int(before[0]) // 2, False, [])
                done = first or len(odd)
                held[3].extend(texts.slice(0, done).to_pylist())
                if first:
                    if held[2] == whole:
                        out.append((*split, held[0], None if whole else held[1], separator.join(held[3])))
                    held = None
            if whole and last > done:
                cells, places = texts.slice(0, last).to_pylist(), [done, *ends[ends > done].tolist()]
                record = [separator.join(cells[i:j]) for i, j in zip(places, places[1:])]
                n, begin = len(record), at[lo + np.array(places[:-1])]
                ready.append(([split[0]] * n, [split[1]] * n, begin, [None] * n, record))
            done = max(done, last)
            if done < len(odd):
                held = (int(at[lo + done]), int(before[done]) // 2, True, texts.slice(done).to_pylist())
        if out:
            ready.append(tuple(zip(*out)))
        yield from map(_parts, ready)
    out = []
    if split is not None:
        rest()
    if out:
        yield _parts(zip(*out))


def _parts(columns) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "start", "at", "cut", "value"])


def quoted_records(spark: SparkSession, path: str, separator: str, bare: Column | None = None) -> DataFrame:
    """(file, start, at, record): the text between separators that are outside double quotes.

    `bare` is the piece (column ``value``) without quotes that do not count, such as escaped
    ones. A record's place is that of its first piece. A file whose last quote is not closed is
    an error, since no cut in it can be trusted.
    """
    counted = F.col("value") if bare is None else bare
    odd = F.length(F.regexp_replace(counted, '[^"]', "")) % 2
    pieces = _pieces(spark, path, separator).withColumn("odd", odd)
    splits = pieces.groupBy("file", "start").agg(F.sum("odd").alias("odds"))
    entered = splits.select("file", "start", carried(splits, "odds").alias("entered"), F.sum("odds").over(Window.partitionBy("file")).alias("all_odds"))
    closed = F.when(F.col("all_odds") % 2 == 0, F.col("value")).otherwise(
        F.raise_error(F.concat(F.lit("a quote is not closed in "), F.col("file"))).cast("string")
    )
    # one row a split is sent to all tasks, so the pieces stay in the order in which they are read
    placed = pieces.join(F.broadcast(entered), ["file", "start"]).select("file", "start", "at", closed.alias("value"), "odd", "entered")
    stitch = lambda whole: placed.mapInArrow(functools.partial(_stitched, separator=separator, whole=whole), _STITCHED)
    singles = stitch(True).select("file", "start", "at", F.col("value").alias("record"))
    parts = stitch(False).groupBy("file", "cut").agg(F.array_sort(F.collect_list(F.struct("start", "at", "value"))).alias("parts"))
    joined = parts.select(
        "file", F.get("parts", F.lit(0)).getField("start").alias("start"), F.get("parts", F.lit(0)).getField("at").alias("at"),
        F.array_join(F.transform("parts", lambda p: p["value"]), separator).alias("record"),
    )
    return singles.unionByName(joined)
