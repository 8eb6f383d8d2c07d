import random

import pytest
from pyspark.sql import functions as F

from attrmill.operators import values as V
from plan_metrics import shuffled_rows

# (value, type) by hand
CASES = [
    ("12", "numeric"), ("-1.5e3", "numeric"), ("1,5", "numeric"), (" 7 ", "numeric"), ("inf", "numeric"), ("1.2.3", "string"),
    ("2018-01-15", "date"), ("2018-1-5", "date"), ("2018/01/15", "date"), ("2018-01", "date"), ("2018-13", "string"),
    ("2018-01-15T10:00:00Z", "date"), ("2018-01-15 10:00", "date"), ("2018-01-15T10:00:00.123+01:00", "date"),
    ("2018-01-15T25:00:00Z", "string"), ("15-Jan-2018", "date"), ("15 January 2018", "date"), ("15 JAN, 2018", "date"),
    ("January 15, 2018", "date"), ("Sept 3 2019", "date"), ("Sep. 3, 2019", "date"), ("May 2020", "date"), ("march 2020", "date"),
    ("Marble 2020", "string"), ("Octopus 12, 2019", "string"), ("2024-99-99", "string"), ("99/99/2020", "string"),
    ("12/31/2020", "date"), ("31/12/2020", "date"), ("31.12.2020", "date"), ("2023-02-29", "string"), ("2024-02-29", "date"),
    ("1900-02-29", "string"), ("31 April 2020", "string"), ("0000-01-01", "string"), ("May 2020 10:00", "string"), ("", "string"),
    ("10:30", "string"), ("gut", "string"), ("2018-01-15x", "string"),
]


def test_value_types_by_hand(spark):
    rows = spark.createDataFrame(CASES, "value string, want string").withColumn("got", V.value_type(F.col("value"))).collect()
    assert [(r.value, r.got) for r in rows if r.got != r.want] == []


def test_a_null_value_is_a_string(spark):
    assert spark.range(1).select(V.value_type(F.lit(None).cast("string")).alias("t")).first().t == "string"


@pytest.mark.parametrize("sep", ["/", ".", "-"])
def test_day_and_month_in_either_order(spark, sep):
    values = [(f"13{sep}01{sep}2020",), (f"01{sep}13{sep}2020",), (f"13{sep}13{sep}2020",)]
    got = [r.t for r in spark.createDataFrame(values, "value string").select(V.value_type(F.col("value")).alias("t")).collect()]
    assert got == ["date", "date", "string"]


def _exact(spark, lists, pairs):
    values = spark.createDataFrame([(a, v, n) for a, vs in lists.items() for v, n in vs], "attribute string, value string, n long").localCheckpoint()
    pairs = spark.createDataFrame(pairs, "name string, good_attribute string, bad_attribute string")
    return V.exact_score(pairs, values, None)


@pytest.mark.parametrize("all_pairs", [True, False])
def test_exact_score_equals_sets(spark, all_pairs):
    """Values held by few and by many attributes, repeated pairs, a pair of one attribute, an attribute without values, nulls."""
    rnd = random.Random(4)
    lists = {f"a{i}": [(f"v{j}", rnd.randint(1, 9)) for j in rnd.sample(range(60), rnd.choice([1, 5, 40]))] + [("all", i + 1), (None, 3)] for i in range(12)}
    pairs = [(f"{x}-{y}", x, y) for x in lists for y in lists if x < y or x == y == "a3"] if all_pairs else [("p", "a1", "a0"), ("p", "a1", "a0"), ("q", "a0", "a2"), ("r", "a2", "none"), ("p", "a4", "a5")]
    want = {}
    for name, g, b in pairs:
        x, y = dict(lists[g]), dict(lists.get(b, []))
        for v in x.keys() & y.keys() - {None}:
            n, f = want.get(name, (0, 0))
            want[name] = (n + 1, f + x[v] + y[v])
    assert {r.name: (r.n_shared, r.shared_freq) for r in _exact(spark, lists, pairs).collect()} == want


def test_exact_score_shuffles_no_value_per_pair(spark):
    """All pairs of 30 attributes: values meet their holders, and are not repeated for every partner."""
    lists = {f"a{i}": [(f"{i}-{j}", 1) for j in range(100)] + [("x", 1)] for i in range(30)}
    pairs = [(f"{x}-{y}", x, y) for x in lists for y in lists if x < y]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = shuffled_rows(_exact(spark, lists, pairs))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows < 10 * 30 * 101  # one row a value and partner would be 44,000 rows


def test_value_features_hold_the_fuzzy_score(spark):
    """The registered query runs every step of V14, with its SQL twin: a fuzzy score where neither numbers nor dates match."""
    from attrmill import catalog

    found = catalog.queries()["value_features"](spark, "/root/testdata/sf0.001").collect()
    assert "AS jaro_score" in catalog.oracle_sql()["value_features"]
    assert any(r.jaro_score for r in found)
    assert all((r.jaro_score is None) == (r.type_match in ("numeric match", "date match")) for r in found)


def test_a_value_is_searched_once_for_all_pairs_with_a_list(spark):
    lists = {"a": ["cat", "dog"], "b": ["cat", "dog", "cow"], "long": ["cart", "cows", "dig", "fog"]}
    values = spark.createDataFrame([(k, v, 1) for k, vs in lists.items() for v in [*vs, None]], "attribute string, value string, n long")
    pairs = spark.createDataFrame([("a-long", "a", "long"), ("b-long", "b", "long"), ("b-long", "b", "long")], "name string, good_attribute string, bad_attribute string")
    got = {(r.name, r.value): r.match for r in V.best_value_matches(pairs, values).collect()}
    assert got == {(f"{k}-long", v): m for k in "ab" for v, m in (("cat", "cart"), ("dog", "dig"), ("cow", "cows")) if v in lists[k]}
