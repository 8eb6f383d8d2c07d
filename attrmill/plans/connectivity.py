"""Break number (C5): local node connectivity between the two attributes of a pair,
i.e. the largest number of internally node-disjoint paths, a direct edge counting as one.

Plan:
(a) bounds from joins: lower = adjacent + |common neighbours| (those paths are part of some
    largest set), upper = min(degree); equal bounds are exact;
(b) all other pairs grow augmenting paths together, as joins. Without the direct edge and the
    common neighbours, a pair's flow is a table of arcs (pair, u, v). A phase is a breadth-first
    search of all open pairs at once over rows (pair, node, side): a node that no path uses is
    entered and left freely; a used one, entered, can only be left backwards along its path
    (side ``in``), and from there (side ``out``) anywhere, or further back. Every state belongs
    to the first root (neighbour of the start) that claims it, so the paths that reach the end
    from different roots share no state and are all taken at once. A pair is finished when its
    flow meets the upper bound or a phase finds no path: its flow is largest.

Every round is one equi-join on the node and one anti-join on (pair, node, side); its result is
checkpointed in the shared folder. No graph is collected or broadcast on the driver, no size switches it off.
A graph of at most GRAPH_ARCS arcs is dealt to tasks that share out the pairs, and each task searches the same
residual states on its copy, path by path (`task_paths`); both give the largest number.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrmill.session import cut_lineage

#: A state of the search: the path's steps so far are arcs (u, v), put on the flow or taken off.
_STATE = ["name", "s", "t", "node", "side", "root", "path"]


def _arc(u: Column, v: Column, add: bool) -> Column:
    return F.struct(u.cast("string").alias("u"), v.cast("string").alias("v"), F.lit(add).alias("add"))


def _enter(moves: DataFrame, used: DataFrame) -> DataFrame:
    """Moves along edges into ``node``: free for nodes off all paths, else ``in``."""
    hit = used.select("name", F.col("v").alias("node"), F.lit(True).alias("_used"))
    side = F.when(F.col("_used"), "in").otherwise("free")
    return moves.join(hit, ["name", "node"], "left").withColumn("side", side).select(_STATE)


def _next_states(frontier: DataFrame, edges: DataFrame, flow: DataFrame, used: DataFrame) -> DataFrame:
    at = frontier.withColumnRenamed("node", "at")
    leave = at.where(F.col("side") != "in").join(edges.select(F.col("src").alias("at"), F.col("dst").alias("node")), "at")
    leave = leave.where((F.col("node") != F.col("s")) & (F.col("node") != F.col("t")))
    leave = leave.join(flow.select("name", F.col("u").alias("at"), F.col("v").alias("node")), ["name", "at", "node"], "left_anti")
    forward = _enter(leave.withColumn("path", F.concat("path", F.array(_arc(F.col("at"), F.col("node"), True)))), used)
    inside = frontier.where(F.col("side") == "out").withColumn("side", F.lit("in"))  # back through the node itself
    back = at.where(F.col("side") == "in").join(used.select("name", F.col("v").alias("at"), F.col("u").alias("node")), ["name", "at"])
    back = back.where(F.col("node") != F.col("s")).withColumn("path", F.concat("path", F.array(_arc(F.col("node"), F.col("at"), False))))
    return forward.unionByName(inside.select(_STATE)).unionByName(back.withColumn("side", F.lit("out")).select(_STATE))


def _claim(states: DataFrame, seen: DataFrame) -> DataFrame:
    """New states, each for one root."""
    fresh = states.join(seen.select("name", "node", "side"), ["name", "node", "side"], "left_anti")
    first = F.min(F.struct("root", "path"))
    return fresh.groupBy("name", "s", "t", "node", "side").agg(first.alias("f")).select("name", "s", "t", "node", "side", "f.root", "f.path")


def _mark_arrived(states: DataFrame, edges: DataFrame, flow: DataFrame) -> DataFrame:
    """States with ``arrived``: whether the end is the next step."""
    ends = edges.select(F.col("src").alias("node"), F.col("dst").alias("t"), F.lit(True).alias("_near"))
    taken = flow.select("name", F.col("u").alias("node"), F.col("v").alias("t"), F.lit(True).alias("_taken"))
    near = states.join(ends, ["node", "t"], "left").join(taken, ["name", "node", "t"], "left")
    arrived = (F.col("side") != "in") & F.col("_near").isNotNull() & F.col("_taken").isNull()
    return near.select(*_STATE, arrived.alias("arrived"))


def _whole_paths(states: DataFrame) -> DataFrame:
    """(name, root, path) of the states that arrived, one a root, the last arc included."""
    full = F.concat("path", F.array(_arc(F.col("node"), F.col("t"), True)))
    return states.where("arrived").withColumn("path", full).groupBy("name", "root").agg(F.min("path").alias("path"))


#: Arcs of a graph that one task holds; on larger graphs the paths grow as joins.
GRAPH_ARCS = 2_000_000


def task_paths(near: dict, s, t, most: int) -> int:
    """The same number for one pair on a graph in memory: ``near`` has the set of neighbours of each node.

    The roots are taken one after another. A root without a path leaves states that never reach the end, as later
    paths cannot pass through them: they stay out. The other states are free again for the next root."""
    ends, starts = near.get(t, set()), near.get(s, set())
    common = starts & ends
    free = near.keys() - common - {s, t}  # off all paths, not seen
    behind: set = set()  # on a path, not seen on the side ``in``
    out: set = set()  # on a path, not seen on the side ``out``
    after, before, paths = {}, {}, 0
    for root in starts - common - {t}:
        if paths >= most:
            break
        if before.get(root) == s or not (root in free or root in behind):
            continue
        first = (root, root not in free)
        (behind if first[1] else free).discard(root)
        came, queue, last = {first: None}, deque([first]), None
        while queue:
            at = node, inside = queue.popleft()
            if inside:
                step = before[node]
                if step in out:
                    out.discard(step)
                    came[step, False] = at
                    queue.append((step, False))
                continue
            if node in ends and after.get(node) != t:
                last = at
                break
            here = near[node]
            if node in behind:
                behind.discard(node)
                came[node, True] = at
                queue.append((node, True))
            hit = next(iter(here & ends & free), None)  # one step before the end
            if hit is not None:
                free.discard(hit)
                came[hit, False] = at
                last = (hit, False)
                break
            for step in here & free:
                free.discard(step)
                came[step, False] = at
                queue.append((step, False))
            for step in here & behind:
                if after.get(node) != step:
                    behind.discard(step)
                    came[step, True] = at
                    queue.append((step, True))
        if last is None:
            continue
        paths += 1
        seen, steps, at = came.keys(), [], last
        while at is not None:
            steps.append(at)
            at = came[at]
        steps.reverse()
        drop, add = [], []
        for (u, inside), (v, entered) in zip([(s, False), *steps], [*steps, (t, False)]):
            if inside and u != v:  # back along the path of u
                drop.append((v, u))
            elif u != v:
                add.append((u, v))
        for u, v in drop:
            after.pop(u, None)
            before.pop(v, None)
        for u, v in add:
            if u != s:
                after[u] = v
            if v != t:
                before[v] = u
        for node in {x for x, _ in seen} | {x for arc in drop for x in arc} - {s, t}:
            (free if node not in after else behind).add(node)
            (behind if node not in after else free).discard(node)
            (out.add if node in after else out.discard)(node)
    return paths


def _in_tasks(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, paths) with the graph in every task."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    graph = edges.select("src", "dst", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(parts)).cast("int"))

    def solve(some: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for u, v in zip(graph["src"], graph["dst"]) if len(some) else ():
            near.setdefault(u, set()).add(v)
        found = [task_paths(near, s, t, int(most)) for s, t, most in zip(some["s"], some["t"], some["most"])]
        return pd.DataFrame({"name": some["name"], "paths": pd.Series(found, dtype="int32", index=some.index)})

    return dealt.groupBy("part").cogroup(graph.groupBy("part")).applyInPandas(solve, "name string, paths int")


def disjoint_paths(pairs: DataFrame, edges: DataFrame, graph_arcs: int | None = None) -> DataFrame:
    """(name, paths): the largest number of node-disjoint paths from ``s`` to ``t`` of each row of
    pairs (name, s, t, most) that use neither the direct edge nor common neighbours; ``most`` is
    an upper bound of it. ``edges`` is symmetric: (src, dst). A graph of more than ``graph_arcs`` stays in tables."""
    edges = cut_lineage(edges.select("src", "dst").where(F.col("src") != F.col("dst")).distinct())
    pairs = cut_lineage(pairs.select("name", "s", "t", "most"))
    if edges.count() <= (GRAPH_ARCS if graph_arcs is None else graph_arcs):
        return cut_lineage(_in_tasks(pairs, edges))
    near_s = pairs.join(edges.withColumnRenamed("src", "s"), "s").select("name", "s", "t", F.col("dst").alias("node"))
    near_t = pairs.join(edges.withColumnRenamed("src", "t"), "t").select("name", F.col("dst").alias("node"))
    common = near_s.join(near_t, ["name", "node"], "left_semi").select("name", "node")
    sides = F.explode(F.array(F.lit("free"), F.lit("in"), F.lit("out"))).alias("side")
    blocked = cut_lineage(common.select("name", "node", sides))
    starts = cut_lineage(near_s.where(F.col("node") != F.col("t")).join(common, ["name", "node"], "left_anti"))

    flow = cut_lineage(pairs.limit(0).select("name", F.col("s").cast("string").alias("u"), F.col("t").cast("string").alias("v")))
    missing = pairs.select("name", F.col("most").alias("left"))
    open_ = starts
    while not open_.isEmpty():
        used = flow.join(pairs.select("name", "t"), "name").where(F.col("v") != F.col("t")).select("name", "u", "v")
        roots = open_.join(flow.select("name", F.col("u").alias("s"), F.col("v").alias("node")), ["name", "s", "node"], "left_anti")
        roots = roots.select("*", F.col("node").alias("root"), F.array(_arc(F.col("s"), F.col("node"), True)).alias("path"))
        frontier = cut_lineage(_enter(roots, used))
        seen, found = blocked.unionByName(frontier.select("name", "node", "side")), None
        while not frontier.isEmpty():
            states = cut_lineage(_mark_arrived(_claim(_next_states(frontier, edges, flow, used), seen), edges, flow))
            here = _whole_paths(states)
            found = here if found is None else found.unionByName(here)
            # a root has one path, a pair no more than it lacks; its other roots go on while they arrive
            counts = found.groupBy("name").agg(F.count(F.lit(1)).alias("n")).join(here.select("name", F.lit(True).alias("new")).distinct(), "name", "left")
            enough = counts.join(missing, "name").where("new is null or n >= left").select("name")
            frontier = states.drop("arrived").join(found.select("name", "root"), ["name", "root"], "left_anti").join(enough, "name", "left_anti")
            seen = seen.unionByName(states.select("name", "node", "side"))
        if found is None:
            break
        found = cut_lineage(found)
        arcs = found.select("name", F.explode("path").alias("a")).select("name", "a.*")
        kept = flow.join(arcs.where("not add").select("name", "u", "v"), ["name", "u", "v"], "left_anti")
        flow = cut_lineage(kept.unionByName(arcs.where("add").select("name", "u", "v")))
        gain = found.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
        missing = cut_lineage(missing.join(gain, "name").select("name", (F.col("left") - F.col("n")).alias("left")).where("left > 0"))
        open_ = cut_lineage(open_.join(missing, "name", "left_semi"))
    out = flow.join(pairs.select("name", "s"), "name").where(F.col("u") == F.col("s")).groupBy("name").agg(F.count(F.lit(1)).cast("int").alias("paths"))
    return pairs.select("name").join(out, "name", "left").select("name", F.coalesce("paths", F.lit(0)).alias("paths"))


def break_numbers(features: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds break_no to a frame with name, bad_attribute, good_attribute, degree_bad, degree_good,
    break_no_lower and break_no_upper."""
    features = cut_lineage(features)
    tight = F.col("break_no_lower") == F.col("break_no_upper")
    done = features.where(tight).withColumn("break_no", F.col("break_no_lower").cast("int"))
    rest = features.where(~tight)
    first = F.col("degree_bad") <= F.col("degree_good")  # the search starts at the end with fewer edges
    ends = rest.select(
        "name",
        F.when(first, F.col("bad_attribute")).otherwise(F.col("good_attribute")).alias("s"),
        F.when(first, F.col("good_attribute")).otherwise(F.col("bad_attribute")).alias("t"),
        (F.col("break_no_upper") - F.col("break_no_lower")).alias("most"),
    )
    solved = rest.join(disjoint_paths(ends, edges), "name").withColumn("break_no", (F.col("break_no_lower") + F.col("paths")).cast("int"))
    return done.unionByName(solved.select(done.columns))


def brute_force_connectivity(adj: dict, s, t) -> int:
    """Reference for tests: max node-disjoint paths by trying removals (tiny graphs only)."""
    import itertools

    nodes = [v for v in adj if v not in (s, t)]
    direct = 1 if t in adj.get(s, ()) else 0

    def connected(removed):
        seen, q = {s}, deque([s])
        while q:
            v = q.popleft()
            for w in adj.get(v, ()):
                if w in removed or w in seen:
                    continue
                if v == s and w == t:
                    continue  # the direct edge is counted separately
                if w == t:
                    return True
                seen.add(w)
                q.append(w)
        return False

    for k in range(len(nodes) + 1):
        for removed in itertools.combinations(nodes, k):
            if not connected(set(removed)):
                return direct + k
    return direct + len(nodes)
