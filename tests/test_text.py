import random

from pyspark.sql import functions as F

from attrmill.functions import text as X


def _lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b):
            cur.append(prev[j] + 1 if ca == cb else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


def test_bit_parallel_lcs_matches_dp():
    rnd = random.Random(7)
    for _ in range(2000):
        a = "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 12)))
        b = "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 12)))
        assert X.lcs_length(a, b) == _lcs_dp(a, b)


def test_ratio_udf_native_and_hand_cases(spark):
    rows = [
        ("frozenDessertFrequency", "frozenDesertFrequency", 98),
        ("serovar", "sex", 40),
        ("abc", "", 0),
        ("cold widget", "old widget", 95),
        ("a bc", "ab c", 75),
    ]
    df = spark.createDataFrame(rows, "a string, b string, expect int")
    out = df.select(
        "expect",
        X.fuzzy_ratio(F.col("a"), F.col("b")).alias("udf"),
        X.fuzzy_ratio(F.col("a"), F.col("b"), native=True).alias("native"),
    ).collect()
    for r in out:
        assert r.udf == r.expect == r.native


def test_threshold_is_exact_at_the_boundary(spark):
    # 400*LCS == 161*(la+lb) is excluded (score rounds to 80), one more LCS unit is included.
    df = spark.createDataFrame([(161, 200, 200), (162, 200, 200), (4, 5, 5)], "lcs int, la int, lb int")
    got = [r[0] for r in df.select(X.above_threshold(F.col("lcs"), F.col("la"), F.col("lb"))).collect()]
    assert got == [False, True, False]


def test_camel_split_and_tokens(spark):
    df = spark.createDataFrame([("sampleSourceDNAName",)], "a string")
    r = df.select(X.camel_tokens_cased(F.col("a")).alias("t"), X.possible_camel_case(F.col("a")).alias("c")).first()
    assert r.t == ["sample", "Source", "DNA", "Name"]
    assert r.c is True
