import itertools
import random

from pyspark.sql import functions as F

from attrmill.operators import coexist as C
from attrmill.plans import connectivity
from attrmill.plans.connectivity import brute_force_connectivity


def _random_graph(rnd, n, p):
    adj = {i: set() for i in range(n)}
    for a, b in itertools.combinations(range(n), 2):
        if rnd.random() < p:
            adj[a].add(b)
            adj[b].add(a)
    return adj


def _solve(spark, graphs):
    """Break numbers between nodes 0 and 1 of all graphs in one run, with their features."""
    edges = [(f"{k}:{a}", f"{k}:{b}", 1.0) for k, adj in enumerate(graphs) for a in adj for b in adj[a]]
    pairs = [(str(k), f"{k}:0", f"{k}:1") for k in range(len(graphs))]
    e = spark.createDataFrame(edges, "src string, dst string, weight double")
    p = spark.createDataFrame(pairs, "name string, bad_attribute string, good_attribute string")
    return {int(r.name): r for r in C.graph_features(p, e).collect()}


def test_break_numbers_equal_brute_force_on_random_graphs(spark):
    rnd = random.Random(1)
    graphs = [_random_graph(rnd, rnd.randint(3, 9), rnd.random()) for _ in range(120)]
    graphs += [_random_graph(rnd, 13, p) for p in (0.15, 0.2, 0.25, 0.3) for _ in range(25)]
    graphs = [g for g in graphs if g[0] and g[1]]
    got = _solve(spark, graphs)
    assert len(got) == len(graphs)
    ran = 0
    for k, adj in enumerate(graphs):
        r = got[k]
        assert r.break_no == brute_force_connectivity(adj, 0, 1), (k, adj)
        assert r.break_no_lower <= r.break_no <= r.break_no_upper and r.break_no_exact
        ran += r.break_no_lower < r.break_no_upper
    assert ran > 30


def test_paths_that_must_be_rerouted(spark):
    """The first shortest path blocks two others until it is taken back, once and over a long way."""
    once = {0: {2, 3}, 2: {0, 4, 5}, 3: {0, 4}, 4: {2, 3, 1}, 5: {2, 6}, 6: {5, 1}, 1: {4, 6}}
    ladder = {0: set(), 1: set()}

    def link(a, b):
        ladder.setdefault(a, set()).add(b)
        ladder.setdefault(b, set()).add(a)

    for a, b in [(0, "a1"), ("a1", "a2"), ("a2", "a3"), ("a3", 1), (0, "b1"), ("b1", "b2"), ("b2", "b3"), ("b3", "a3"), ("a1", "c1"), ("c1", "c2"), ("c2", "c3"), ("c3", 1)]:
        link(a, b)
    four_cycle = {0: {2, 3, 1}, 1: {0, 2, 3}, 2: {0, 1}, 3: {0, 1}}
    apart = {0: {2}, 2: {0}, 1: {3}, 3: {1}}
    graphs = [once, ladder, four_cycle, apart]
    got = _solve(spark, graphs)
    assert [got[k].break_no for k in range(4)] == [brute_force_connectivity(g, 0, 1) for g in graphs] == [2, 2, 3, 0]


def test_pairs_outside_the_graph_have_no_row(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, weight double")
    p = spark.createDataFrame([("ab", "a", "b"), ("ax", "a", "x")], "name string, bad_attribute string, good_attribute string")
    got = C.graph_features(p, e).collect()
    assert [(r.name, r.break_no) for r in got] == [("ab", 1)]
    assert C.graph_features(p.limit(0), e).count() == 0
    assert C.graph_features(p, e.limit(0)).select(F.max("break_no")).first()[0] is None


def _flow_rows(graphs):
    edges = [(f"{k}:{a}", f"{k}:{b}") for k, adj in enumerate(graphs) for a in adj for b in adj[a]]
    return edges, [(str(k), f"{k}:0", f"{k}:1", 99) for k in range(len(graphs))]


def test_paths_in_tasks_and_in_tables_equal_brute_force(spark):
    rnd = random.Random(6)
    graphs = [_random_graph(rnd, rnd.randint(4, 10), rnd.choice([0.2, 0.3, 0.5])) for _ in range(60)]
    edges, pairs = _flow_rows(graphs)
    e, p = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(pairs, "name string, s string, t string, most int")
    want = {str(k): brute_force_connectivity(g, 0, 1) - len(g[0] & g[1]) - (1 in g[0]) for k, g in enumerate(graphs)}
    for arcs in (None, 0):
        assert {r.name: r.paths for r in connectivity.disjoint_paths(p, e, arcs).collect()} == want


def test_task_paths_equal_brute_force_on_many_graphs():
    rnd = random.Random(7)
    for _ in range(1500):
        adj = _random_graph(rnd, rnd.randint(3, 10), rnd.choice([rnd.random(), 0.25]))
        want = brute_force_connectivity(adj, 0, 1) - len(adj[0] & adj[1]) - (1 in adj[0])
        assert connectivity.task_paths({k: v for k, v in adj.items() if v}, 0, 1, 99) == want, adj
        assert connectivity.task_paths(adj, 0, 1, max(want - 1, 0)) == max(want - 1, 0)


def test_a_small_graph_takes_no_rounds_of_jobs(spark):
    """50 pairs whose paths are found by one job: rounds in tables would cut the lineage once and more a step."""
    graphs = [{0: {2, 3}, 1: {4, 5}, 2: {0, 4, 6}, 3: {0, 5}, 4: {2, 1}, 5: {3, 1}, 6: {2}} for _ in range(50)]
    edges, pairs = _flow_rows(graphs)
    e, p = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(pairs, "name string, s string, t string, most int")
    cuts = []
    before, connectivity.cut_lineage = connectivity.cut_lineage, lambda df: (cuts.append(1), before(df))[1]
    try:
        assert {r.paths for r in connectivity.disjoint_paths(p, e).collect()} == {2}
    finally:
        connectivity.cut_lineage = before
    assert len(cuts) <= 3
