"""N-gram Jaccard self-join of documents (exact), as a size-aware heavy-light join.

A document's set is its distinct 5-word shingles (ASCII lower case); with fewer
words the whole sequence is its one element. Two sets A, B link when
100*|A n B| >= 80*|A u B|; then |A n B| >= c(s) = ceil(0.8 s) for either size s.

1. Documents with equal sets are one *node* (a 64-bit hash of the set; at N
   distinct sets two different ones share a hash with odds of about N^2/2^65).
2. Elements have one global order: rare ones by hash, then the frequent ones by
   their count. The frequent list is a lossy count over all documents; its bound
   (`HOT_LIMIT`) touches speed only, since any common order gives the same links.
3. *Heavy* (large) sets put the first s-c+1 elements into inverted lists; linked
   sets meet in at least one list. *Light* (small) sets instead emit all
   2-subsets of their first s-c+2 elements; two linked light sets share one. The
   boundary between them is the size at which the measured cost of enumerating
   subsets exceeds that of scanning lists. Light sets within reach of a heavy
   one (size >= 0.8 x boundary) are in the inverted lists too.
4. Lists are not expanded into all pairs. Rounds of stars check every member of
   a list against one pivot and contract what links; lists whose members are one
   component are done. When the remaining pairs are few enough (or stop getting
   fewer), all pairs of different components within a list are checked. So no
   link between different components is missed, and pairs within one component,
   which cannot change the answer, are never formed.
5. Checks: size ratio, an exact upper bound from folded bitmaps, then the
   intersection of the two full sets.

Rows: repeated rows and equal texts share a node. Null and word-less texts have
an empty set, link with nothing and are their own component. A null doc_id keeps
its row; it is linked with nothing (component_id null). Columns other than the id
and the text are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrmill.llm.common import Workspace, arrow_stage, mix64, signed, window_hashes

SHINGLE = 5
#: Frequent shingles that are moved to the end of the order. Not a limit on results.
HOT_LIMIT = 100_000
#: Largest set size for which 2-subsets are prepared; the boundary is at most this.
LIGHT_MAX = 64
#: A list of node ids of at most this many is broadcast; beyond it a shuffle join serves.
BROADCAST_IDS = 1_000_000
#: So few pairs are checked in one go; the links are the same either way.
FEW_PAIRS = 5_000
#: Shingles gathered before a task reports the repeated ones.
_CHUNK = 1_500_000


def need(s: int) -> int:
    """Least overlap of a set of s elements with any set that it links to."""
    return -(-4 * s // 5)


def shingle_set(text: bytes | None) -> np.ndarray:
    return np.unique(window_hashes(text.lower().split(), SHINGLE)) if text else np.empty(0, np.uint64)


def _node(u: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(u.tobytes(), seed=len(u)) - (1 << 63)


# ---- 1, 2: order and profiles -----------------------------------------------------------


def _frequent(batches):
    held, size = [], 0

    def report():
        v, c = np.unique(np.concatenate(held), return_counts=True)
        keep = c >= 3
        return pa.RecordBatch.from_arrays([pa.array(signed(v[keep])), pa.array(c[keep])], ["h", "c"])

    for b in batches:
        for t in b.column(0).to_pylist():
            u = shingle_set(t)
            held.append(u)
            size += len(u)
            if size >= _CHUNK:
                yield report()
                held, size = [], 0
    if held:
        yield report()


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """The most frequent shingles over all documents, most frequent last."""
    rows = (
        arrow_stage(docs.select(F.col("text").cast("binary")), _frequent, "h long, c long")
        .groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(HOT_LIMIT).collect()
    )
    return np.array([r.h for r in rows][::-1], dtype=np.int64).view(np.uint64)


def _subset_keys(first: np.ndarray) -> np.ndarray:
    i, j = np.triu_indices(len(first), 1)
    return mix64(np.minimum(first[i], first[j]) * np.uint64(3) + mix64(np.maximum(first[i], first[j])))


def _bitmap(u: np.ndarray) -> bytes:
    m = 1 << max(6, (2 * len(u) - 1).bit_length())  # 2 to 4 bits an element
    bits = np.zeros(m, np.uint8)
    bits[(u >> np.uint64(20)) & np.uint64(m - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _profile(batches, hot):
    order = np.argsort(hot)
    ranked = hot[order]
    none = np.empty(0, np.int64)
    for b in batches:
        n, node, bits, tokens, subsets = [], [], [], [], []
        for t in b.column(1).to_pylist():
            u = shingle_set(t)
            s = len(u)
            n.append(s)
            if not s:
                node.append(None), bits.append(None), tokens.append(none), subsets.append(none)
                continue
            node.append(_node(u))
            bits.append(_bitmap(u))
            at = np.minimum(np.searchsorted(ranked, u), max(len(ranked) - 1, 0))
            frequent = ranked[at] == u if len(ranked) else np.zeros(s, bool)
            size = s - need(s) + 2
            first = u[~frequent][:size]
            if len(first) < size:
                late = u[frequent]
                first = np.concatenate([first, late[np.argsort(order[at[frequent]], kind="stable")][: size - len(first)]])
            tokens.append(signed(first[: size - 1]))
            subsets.append(signed(_subset_keys(first)) if 1 < s <= LIGHT_MAX else none)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bits, pa.binary()),
             pa.array(tokens, pa.list_(pa.int64())), pa.array(subsets, pa.list_(pa.int64()))],
            ["doc_id", "n", "node", "bits", "tokens", "subsets"],
        )


# ---- 3: keys ----------------------------------------------------------------------------


def light_boundary(profiles: DataFrame) -> int:
    """Largest size up to which enumerating subsets costs no more than scanning lists.
    Costs per class of sizes, in rows: 2-subsets emitted against the pairs that the
    class's inverted lists hold."""
    small = profiles.filter(F.col("n").between(2, LIGHT_MAX)).withColumn("class", F.ceil(F.col("n") / 8))
    subsets = small.groupBy("class").agg(F.sum(F.size("subsets")).alias("subsets"))
    lists = (
        small.select("class", F.explode("tokens").alias("key")).groupBy("class", "key").agg(F.count(F.lit(1)).alias("m"))
        .groupBy("class").agg(F.sum(F.col("m") * (F.col("m") + 1) / 2).alias("scans"))
    )
    boundary = 0
    for r in sorted(subsets.join(lists, "class").collect(), key=lambda r: r["class"]):
        if r.subsets > r.scans:
            break
        boundary = int(r["class"]) * 8
    return boundary


def keys(profiles: DataFrame, boundary: int) -> DataFrame:
    """(key, node): 2-subsets of light sets, and inverted lists for all that a heavy set can reach."""
    used = F.concat(
        F.when(F.col("n") <= boundary, F.col("subsets")).otherwise(F.array().cast("array<bigint>")),
        F.when(F.col("n") * 5 >= boundary * 4, F.col("tokens")).otherwise(F.array().cast("array<bigint>")),
    )
    return profiles.filter(F.col("n") > 1).select(F.explode(used).alias("key"), "node")


# ---- 5: checks --------------------------------------------------------------------------


def _bound(batches):
    for b in batches:
        keep = []
        for sa, sb, x, y in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5))):
            p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            m = min(len(p), len(q))
            if len(p) > m:
                p = np.bitwise_or.reduce(p.reshape(-1, m), axis=0)
            if len(q) > m:
                q = np.bitwise_or.reduce(q.reshape(-1, m), axis=0)
            least = -(-4 * (sa + sb) // 9)
            keep.append(sa - int(np.bitwise_count(p & ~q).sum()) >= least and sb - int(np.bitwise_count(q & ~p).sum()) >= least)
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _overlap(batches):
    last, u = None, None
    for b in batches:
        a_out, b_out = [], []
        for a, o, ta, tb in zip(*(b.column(i).to_pylist() for i in range(4))):
            if a != last:
                first = shingle_set(ta)
                if _node(first) != a:  # the text of another row with this doc_id
                    continue
                last, u = a, first
            v = shingle_set(tb)
            if _node(v) != o:
                continue
            both = len(np.intersect1d(u, v, assume_unique=True))
            if 100 * both >= 80 * (len(u) + len(v) - both):
                a_out.append(a), b_out.append(o)
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])


class _Links:
    """Checks candidate pairs of nodes and keeps the true links."""

    def __init__(self, work: Workspace, docs: DataFrame, profiles: DataFrame) -> None:
        self.work, self.docs = work, docs
        self.nodes = work.save(
            profiles.filter(F.col("node").isNotNull() & F.col("doc_id").isNotNull()).groupBy("node")
            .agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("bits").alias("bits")),
            "nodes",
        )

    def near(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that pass the size ratio and the bitmap bound."""
        side = self.nodes.select("node", "n", "bits")
        sized = (
            pairs.join(side.toDF("a", "na", "xa"), "a").join(side.toDF("b", "nb", "xb"), "b")
            .filter("5 * na >= 4 * nb and 5 * nb >= 4 * na")
        )
        return self.work.save(arrow_stage(sized.select("a", "b", "na", "nb", "xa", "xb"), _bound, "a long, b long"), "near")

    def check(self, near: DataFrame) -> DataFrame:
        """The pairs whose full sets link."""
        used = self.work.save(
            near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(self.nodes.select("node", "doc_id"), "node"), "used"
        )
        small = used.count() <= BROADCAST_IDS
        texts = self.docs.select("doc_id", F.col("text").cast("binary").alias("text"))
        texts = self.work.save(texts.join(F.broadcast(used) if small else used, "doc_id").select("node", "text").distinct(), "texts")
        links = self.work.save(
            arrow_stage(
                near.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
                .select("a", "b", "ta", "tb").sortWithinPartitions("a"),
                _overlap, "a long, b long",
            ).distinct(),
            "links",
        )
        self.work.drop(used, texts, near)
        return links


# ---- components -------------------------------------------------------------------------


def components(work: Workspace, links: DataFrame) -> DataFrame:
    """(node, comp) of every node that has a link: alternating large-star and
    small-star steps, each a grouped minimum, until nothing changes."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        linked = both.join(least, "a")
        if large:
            out = linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.filter("a != b").distinct()

    def mark(edges: DataFrame):
        r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r.n, r.h

    edges = work.save(links.select("a", "b").filter("a != b").distinct(), "edges")
    before = mark(edges)
    while True:
        last, edges = edges, work.save(star(star(edges, True), False), "edges")
        work.drop(last)
        after = mark(edges)
        if after == before:
            break
        before = after
    comps = work.save(
        edges.groupBy("a").agg(F.min("b").alias("comp")).withColumnRenamed("a", "node")
        .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()), "comps",
    )
    work.drop(edges)
    return comps


def join_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    work = Workspace(spark)
    docs = docs.select("doc_id", "text")
    hot = frequent_shingles(docs)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, node long, bits binary, tokens array<long>, subsets array<long>"
    profiles = work.save(
        arrow_stage(docs.select("doc_id", F.col("text").cast("binary")), functools.partial(_profile, hot=hot), schema), "profiles"
    )
    check = _Links(work, docs, profiles)
    named = profiles.filter(F.col("doc_id").isNotNull())
    listed = keys(named, light_boundary(named))
    # lists with a single node are dropped before their rows are kept
    shared = work.save(listed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo != hi").select("key"), "shared")
    listed = work.save(listed.join(shared, "key").distinct(), "listed")
    total = listed.count()
    wide, profiles = profiles, work.save(profiles.select("doc_id", "n", "node"), "sizes")
    work.drop(shared, wide)

    links = comps = last = live = None

    def add(found: DataFrame) -> None:
        nonlocal links, comps
        parts, old = (links, found), comps
        if links is None:
            links = found
        else:
            links = work.save(links.unionByName(found), "links")
            work.drop(*parts)
        comps = components(work, links)
        work.drop(old)

    round_no = 0
    while True:
        if comps is None:
            now = listed.withColumn("comp", F.col("node"))
        else:
            now = listed.join(comps, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
        open_keys = now.groupBy("key").agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi"),
            F.min(F.struct(F.xxhash64("comp", F.lit(round_no)).alias("r"), "comp", "node")).alias("pivot"),
        ).filter("lo != hi")
        work.drop(live)
        live = work.save(now.join(open_keys.select("key", F.col("pivot.node").alias("pivot"), F.col("pivot.comp").alias("pivot_comp")), "key"), "live")
        # pairs of different components that share a list
        ahead = (
            live.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("key")
            .agg(((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))) / 2).alias("p")).agg(F.sum("p")).first()[0] or 0
        )
        if ahead <= total // 4 + 1000 or (last is not None and ahead > 0.8 * last):
            break
        last = ahead
        # each member against the pivot that it shares most lists with; later rounds and the last step see the rest
        star = (
            live.filter("comp != pivot_comp").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("m"))
            .groupBy("node").agg(F.max(F.struct("m", "pivot"))["pivot"].alias("pivot"))
            .select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        )
        add(check.check(check.near(star)))
        round_no += 1
    if ahead:
        entry = work.save(live.select("key", "node", "comp").join(check.nodes.select("node", "n"), "node").select("key", "node", "comp", "n"), "entry")
        work.drop(live, listed)
        rest = (
            entry.toDF("key", "a", "ca", "na").join(entry.toDF("key", "b", "cb", "nb"), "key")
            .filter("a < b and ca != cb and 5 * na >= 4 * nb and 5 * nb >= 4 * na").select("a", "b").distinct()
        )
        near = check.near(rest)
        work.drop(entry)
        for _ in range(2):  # one partner of each member first: what that contracts needs no further check
            if near.count() <= FEW_PAIRS:
                break
            first = near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
            add(check.check(work.save(first, "first")))
            side, old = comps.select("node", "comp"), near
            near = work.save(
                near.join(first, ["a", "b"], "left_anti").join(side.toDF("a", "ca"), "a", "left").join(side.toDF("b", "cb"), "b", "left")
                .filter("coalesce(ca, a) != coalesce(cb, b)").select("a", "b"), "near",
            )
            work.drop(old)
        add(check.check(near))
    ids = check.nodes.select("node", "doc_id")
    if comps is not None:
        ids = ids.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = ids.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
        ids = ids.join(least, "comp").select("node", "component_id")
    else:
        ids = ids.withColumnRenamed("doc_id", "component_id")
    return profiles.select("doc_id", "n", "node").join(ids, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
