"""Line deduplication across documents, in DataFrame functions alone.

Lines are compared by their key: white space stripped at both ends, A-Z in lower case. Keys of
at least LEAST_CHARS code points that LEAST_DOCS documents hold lose their lines everywhere but
in the document with the largest id; all other lines stay.

Hashes of the keys are range-partitioned, sorted by document (largest first) and position;
windows stream over each key's run: the first row's document keeps its lines, the changes of
document give the number of documents. What comes back is no text but a compressed bitmap per
document that loses lines: the runs of dropped lines. ``apply_bitmaps`` cuts the texts.

Hot keys: a key on more than 1 of HOT_SHARE rows (so there are at most HOT_SHARE of them, which
bounds the broadcast) is dealt to slices by document; its slices' counts are added up afterwards.
The keys are found exactly, from counts of hash ranges and then of the keys in full ranges.

Rows: a null text is one empty line. Rows with one doc_id are one document; each row gets the
bitmap of its own text, so repeated rows are cut alike. A row without doc_id is no document: it
does not count, never keeps a line for others, and loses the lines of any key that is dropped.
Keys are told apart by 128 bits of hash. Empty tables give empty results. Only doc_id and text
are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrmill.llm.common import Workspace

#: The rule: code points of a key, documents that hold it.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: The stated white space at the ends of a line (a line has no \n inside).
BLANKS = " \t\n\x0b\x0c\r"
#: A key is hot above a share of 1 in HOT_SHARE rows and above HOT_ROWS (plan only: results are the same).
HOT_SHARE, HOT_ROWS = 65_536, 10_000
_RANGE_BITS = 18
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """``lower`` lower-cases exactly A-Z where all bytes are ASCII, and is faster than ``translate``."""
    inner = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(inner) == F.char_length(inner), F.lower(inner)).otherwise(F.translate(inner, _UPPER, _LOWER))


def line_hashes(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(h1, h2, doc_id, text_id, at): every line whose key is long enough, as a hash with its place."""
    text_id = F.xxhash64(F.lit(0), "text").alias("text_id")
    # only white space and letters of one byte change, so a key has no more bytes than its line
    lines = docs.select("doc_id", text_id, F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    keys = lines.filter(F.octet_length("line") >= least_chars).select("doc_id", "text_id", "at", line_key(F.col("line")).alias("key"))
    keys = keys.filter(F.char_length("key") >= least_chars)
    return keys.select(F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"), "doc_id", "text_id", "at")


def _hot_keys(rows: DataFrame, share: int, least: int) -> DataFrame:
    """(h1, h2, slices) of the keys on more than 1 in ``share`` rows, found exactly: counts of
    ranges of h1, then of the keys inside the ranges that are full enough to hold one."""
    limit = max(rows.count() // share, least)
    coarse = F.shiftright("h1", 64 - _RANGE_BITS).alias("range")
    full = rows.groupBy(coarse).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > limit).select("range")
    inside = rows.select("h1", "h2", coarse).join(F.broadcast(full), "range")  # at most `share` ranges
    counts = inside.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > limit)
    return counts.select("h1", "h2", F.ceil(F.col("rows") / limit).alias("slices"))


def keep_bitmaps(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, hot_share: int = HOT_SHARE, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(doc_id, text_id, dropped): per document that loses lines the runs of dropped lines, as
    structs (first, last) counted from 0; every other line of the document stays."""
    work = Workspace(docs.sparkSession)
    rows = work.save(line_hashes(docs, least_chars), "lines")
    hot = work.save(_hot_keys(rows, hot_share, hot_rows), "hot")
    dealt = rows.join(F.broadcast(hot), ["h1", "h2"], "left")
    part = F.coalesce(F.pmod(F.xxhash64("doc_id", "text_id"), F.col("slices")), F.lit(0)).alias("slice")
    dealt = dealt.select("h1", "h2", part, "doc_id", "text_id", "at", F.col("slices").isNotNull().alias("hot"))

    # sorted stream of each key (or slice of a hot key): largest document first, then position
    key = ["h1", "h2", "slice"]
    stream = Window.partitionBy(*key).orderBy(F.desc_nulls_last("doc_id"), "text_id", "at")
    ranged = dealt.repartitionByRange(*key)
    changes = F.col("doc_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(stream))
    whole = Window.partitionBy(*key)
    marked = ranged.withColumn("_new", changes.cast("long")).withColumns(
        {"_docs": F.sum("_new").over(whole), "_keeper": F.first("doc_id").over(stream.rowsBetween(Window.unboundedPreceding, Window.currentRow))}
    )
    marked = work.save(marked.filter(F.col("hot") | (F.col("_docs") >= least_docs)).drop("_new"), "marked")
    lost = ~F.col("doc_id").eqNullSafe(F.col("_keeper"))
    places = marked.filter(~F.col("hot") & lost).select("doc_id", "text_id", "at")

    # slices of hot keys: a document is in one slice, so counts add up; one row a slice is summed
    slices = marked.filter("hot").groupBy(*key).agg(F.max("_docs").alias("docs"), F.max("doc_id").alias("top"))
    all_slices = slices.groupBy("h1", "h2").agg(F.sum("docs").alias("_all"), F.max("top").alias("_top"))
    from_hot = marked.filter("hot").join(F.broadcast(all_slices), ["h1", "h2"])
    from_hot = from_hot.filter((F.col("_all") >= least_docs) & ~F.col("doc_id").eqNullSafe(F.col("_top")))
    places = places.unionByName(from_hot.select("doc_id", "text_id", "at"))

    at = F.array_sort(F.collect_set("at"))
    grouped = places.groupBy("doc_id", "text_id").agg(at.alias("at"))
    first = F.filter("at", lambda x, i: (i == 0) | (F.get("at", i - 1) != x - 1))
    last = F.filter("at", lambda x, i: (i == F.size("at") - 1) | (F.get("at", i + 1) != x + 1))
    runs = F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), b.alias("last")))
    return grouped.select("doc_id", "text_id", runs.alias("dropped"))


def n_dropped(dropped: Column) -> Column:
    return F.aggregate(dropped, F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)


def kept_text(text: Column, dropped: Column) -> Column:
    """The lines between the dropped runs, joined by line ends; linear in the text."""
    lines = lines_of(text)
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda r: r["last"] + 1))
    ends = F.concat(F.transform(dropped, lambda r: r["first"]), F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))
    return F.when(dropped.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """All rows with ``_dropped``, the dropped runs of their text (null where every line stays)."""
    found = bitmaps.select(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text_id"), F.col("dropped").alias("_dropped"))
    own = F.xxhash64(F.lit(0), "text")
    joined = docs.withColumn("_own", own).join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_text_id")), "left")
    return joined.select(*docs.columns, "_dropped")


def drop_repeated_lines(docs: DataFrame, **rule) -> DataFrame:
    """All documents, their texts without the dropped lines (texts that lose none are unchanged)."""
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    cut = apply_bitmaps(rows, keep_bitmaps(docs, **rule))
    text = F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(kept_text(F.col("text"), F.col("_dropped")))
    return cut.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def line_report(docs: DataFrame, **rule) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    own = docs.select("doc_id", "text")
    cut = apply_bitmaps(own, keep_bitmaps(own, **rule))
    dropped = F.col("_dropped")
    return cut.select(
        "doc_id",
        F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(n_dropped(dropped), F.lit(0).cast("long")).alias("n_dropped"),
        F.sha2(kept_text(F.col("text"), dropped), 256).alias("kept_sha256"),
    )
