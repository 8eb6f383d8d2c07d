"""Merkle manifest of a dataset: lag / lead windows over ordered nodes.

A leaf is the SHA-256 of a row's fields (length-prefixed, so no two rows share an input).
Leaves of one group (source) ascend by id; every FAN consecutive nodes hash to their parent
until one is left, and the groups' roots, in order, are hashed the same way to one root.

Per level, ``lag`` and ``lead`` at fixed offsets (1 and 2 nodes of that level) supply the
siblings, masked by the node's slot in its run and by the run's length; rows that are a first
child hash their parent. Nodes of LEVELS levels lie in one block of FAN**LEVELS neighbours, so
one exchange by (group, block) serves all these levels and no window is longer than a block,
however many rows a group has. The roots of the blocks are the next round's nodes.

Positions come from a range partitioning by (group, id, leaf) and the counts of each group in
each partition (one row a partition and group): no window runs over a whole group.

Rows: null fields count as ``-``; a null id comes before all others of its group; a null source
is a group of its own, before all others. Equal rows are leaves of their own, in any order
(their leaves are equal); rows with one id but other fields ascend by leaf. An empty table has no
rows. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrmill.llm.common import Workspace

#: Children of a node, and levels that one round of windows climbs.
FAN, LEVELS = 3, 6
BLOCK = FAN**LEVELS
#: Fields of a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(fields: list[Column]) -> Column:
    """SHA-256 (lowercase hex) of the fields: ``-`` if null, else byte count, ``:``, value."""
    parts = []
    for f in fields:
        value = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _place(nodes: DataFrame, work: Workspace, order: list[str]) -> DataFrame:
    """nodes (group, h, ...) with pos, the place inside the group, and n, the group's size."""
    ranged = nodes.repartitionByRange("group", *order).sortWithinPartitions("group", *order)
    stored = work.save(ranged.withColumn("at", F.monotonically_increasing_id()), "ordered")
    stored = stored.withColumn("part", F.shiftright("at", 33))
    counts = stored.groupBy("group", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("group").orderBy("part")
    counts = counts.select(
        "group", "part", "first",
        F.coalesce(F.sum("rows").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        F.sum("rows").over(Window.partitionBy("group")).alias("n"),
    )
    counts = work.save(counts, "counts")
    pos = (F.col("at") - F.col("first") + F.col("offset")).alias("pos")
    return stored.join(counts, ["group", "part"]).select(*nodes.columns, pos, "n")


def _climb(nodes: DataFrame) -> DataFrame:
    """LEVELS levels at once: adds block, steps (siblings before and after, level by level) and
    top, the root of the block. ``h`` holds a node's hash on the row of its first leaf."""
    out = nodes.withColumn("block", F.expr(f"pos div {BLOCK}")).withColumn("_h", F.col("h"))
    ordered = Window.partitionBy("group", "block").orderBy("pos")
    none = F.lit("")
    for level in range(LEVELS):
        width = FAN**level
        at, more = F.expr(f"pos div {width}"), F.expr(f"(n + {width - 1}) div {width}")
        out = out.withColumns(
            {
                "_slot": at % FAN,
                "_run": F.least(F.lit(FAN), more - (at - at % FAN)),
                "_live": (more > 1) & (F.col("pos") % width == 0),
                **{f"_lag{k}": F.lag("_h", k * width).over(ordered) for k in range(1, FAN)},
                **{f"_lead{k}": F.lead("_h", k * width).over(ordered) for k in range(1, FAN)},
            }
        )
        before = F.concat(*[F.when(F.col("_slot") >= k, F.col(f"_lag{k}")).otherwise(none) for k in range(FAN - 1, 0, -1)])
        after = F.concat(*[F.when(F.col("_slot") + k < F.col("_run"), F.col(f"_lead{k}")).otherwise(none) for k in range(1, FAN)])
        step = F.when(F.col("_live"), F.struct(before.alias("before"), after.alias("after")))
        parent = F.when(F.col("_live"), F.when(F.col("_slot") == 0, F.sha2(F.concat("_h", after), 256))).otherwise(F.col("_h"))
        out = out.withColumns({f"_step{level}": step, "_h": parent})
    seen = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = [F.last(f"_step{level}", ignorenulls=True).over(seen) for level in range(LEVELS)]
    out = out.withColumns({f"_step{level}": s for level, s in enumerate(steps)} | {"top": F.first("_h").over(seen)})
    found = F.filter(F.array(*[F.col(f"_step{level}") for level in range(LEVELS)]), lambda s: s.isNotNull())
    return out.select(*nodes.columns, "block", found.alias("steps"), "top")


def _levels(placed: DataFrame, work: Workspace) -> list[DataFrame]:
    """Node tables (group, pos, n, h): the leaves, then the roots of blocks, until a block holds a group."""
    tables = [placed]
    most = placed.agg(F.max("n")).first()[0] or 0
    while most > BLOCK:
        roots = _climb(tables[-1]).filter(F.col("pos") % BLOCK == 0)
        size = F.expr(f"(n + {BLOCK - 1}) div {BLOCK}")
        tables.append(work.save(roots.select("group", F.col("block").alias("pos"), size.alias("n"), F.col("top").alias("h")), "blocks"))
        most = -(-most // BLOCK)
    return tables


def _join_steps(lower: DataFrame, upper: DataFrame) -> DataFrame:
    """The steps of each row's block behind its own, with the roots above."""
    up = upper.select("group", F.col("pos").alias("block"), F.col("steps").alias("_more"), "subroot", "root")
    joined = lower.drop("top").join(up, ["group", "block"])
    return joined.withColumn("steps", F.concat("steps", "_more")).drop("_more")


def manifest(docs: DataFrame, group: str = "source", order: str = "doc_id", leaf: Column | None = None, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: its id, ``leaf``, ``subroot`` of its group, ``root`` of all, and
    ``steps``, the siblings of its path from the leaf to the root, level by level, each as the
    hex digests before and after the path's node. ``carry`` names further columns to keep."""
    carry = carry or {}
    work = Workspace(docs.sparkSession)
    leaf = leaf_hash([F.col(f) for f in FIELDS]) if leaf is None else leaf
    key = F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.lit(""))
    hashed = docs.select(F.col(order).alias("id"), key.alias("group"), leaf.alias("h"), *[c.alias(k) for k, c in carry.items()])
    hashed = work.save(hashed.withColumn("row", F.monotonically_increasing_id()), "leaves")
    placed = _place(hashed, work, ["id", "h", "row"]).drop("row")
    tables = _levels(placed, work)

    subroots = work.save(_climb(tables[-1]).filter("pos = 0").select("group", "top"), "subroots")
    named = subroots.select(F.lit("").alias("group"), F.col("group").alias("member"), F.col("top").alias("h"))
    above = _levels(_place(named, work, ["member"]), work)
    path = _climb(above[-1]).withColumns({"subroot": F.lit(None).cast("string"), "root": F.col("top")})
    for lower in reversed(above[:-1]):
        path = _join_steps(_climb(lower), path)
    path = path.select(F.col("member").alias("group"), F.col("steps").alias("_more"), F.col("h").alias("subroot"), "root")

    top = _climb(tables[-1]).join(path, "group").withColumn("steps", F.concat("steps", "_more")).drop("_more")
    for lower in reversed(tables[:-1]):
        top = _join_steps(_climb(lower), top)
    return top.select(F.col("id").alias(order), F.col("h").alias("leaf"), "subroot", "root", "steps", *carry)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def proof_digest(steps: Column) -> Column:
    """SHA-256 of all siblings of a path, in order."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def tamper_report(docs: DataFrame) -> DataFrame:
    """Every document checked against the manifest after a change that drops the line ends of the
    texts whose id has an even CRC-32: doc_id, leaf, subroot, root, proof_sha256 (all of the
    unchanged table), folded_root (from the changed leaf and the stored siblings), verified."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    cut = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    hit = (crc % 2 == 0) & F.contains(F.col("text"), F.lit("\n"))
    changed = F.when(hit, leaf_hash([cut if f == "text" else F.col(f) for f in FIELDS]))
    rows = manifest(docs, carry={"changed": changed})
    folded = fold(F.coalesce("changed", "leaf"), F.col("steps"))
    out = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
