"""Value comparison per pair.

Input is the long form attr_values(attribute, value, n). Value typing and the
per-attribute profile are computed once per attribute (not per pair) with
conditional aggregation; exact overlap is a join of the two value sets on the
value. Fuzzy matching takes every value of both sides: blocks of the values that ask for
their best match in a list meet blocks of that list, spread over all tasks, and each value's
best match of a block is found in a tree of its letters behind an upper bound of Jaro-Winkler;
the blocks' winners meet in an aggregation per (pair, value).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attrmill.functions.distances import ValueTree, damerau_levenshtein_rows, hamming
from attrmill.session import cut_lineage

# A number as Python's float() reads it (sign, digits with optional underscores between
# digits, fraction, exponent, inf/nan words), surrounding whitespace allowed.
_DIGITS = r"\d+(?:_\d+)*"
NUMBER_RE = (
    rf"^\s*[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
    r"|(?i:inf|infinity|nan))\s*$"
)
# Dates: year first, year last (day and month in either order) or with a month's name, in the
# calendar; a time of day with an optional zone may follow. One pattern, built by rule.
_MONTHS = "January February March April May June July August September October November December".split()
_YEAR = r"(?!0000)\d{4}"
_LEAP = r"(?!0000)(?:\d\d(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)"


def _month(numbers: list[int]) -> tuple[str, str]:
    """Patterns of some months, as numbers and by name (whole or its first letters)."""
    names = [_MONTHS[i - 1] for i in numbers]
    short = [n[:3] + (f"(?:{'t|' if n[:3] == 'Sep' else ''}{n[3:]})?" if n[3:] else "") for n in names]
    return "(?:" + "|".join(f"0?{i}" if i < 10 else str(i) for i in numbers) + ")", "(?:" + "|".join(short) + r")\.?"


def _date_pattern() -> str:
    full = []
    for months, day, year in (
        ([1, 3, 5, 7, 8, 10, 12], r"(?:0?[1-9]|[12]\d|3[01])", _YEAR),
        ([4, 6, 9, 11], r"(?:0?[1-9]|[12]\d|30)", _YEAR),
        ([2], r"(?:0?[1-9]|1\d|2[0-8])", _YEAR),
        ([2], "29", _LEAP),
    ):
        m, name = _month(months)
        full += [f"{year}-{m}-{day}", f"{year}/{m}/{day}", f"{m}[/.-]{day}[/.-]{year}", f"{day}[/.-]{m}[/.-]{year}"]
        full += [f"{day}[ -]{name}(?:,? |-){year}", f"{name} {day},? {year}"]
    time = r"[ T](?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d+)?)?(?: ?(?:Z|UTC|GMT|[+-]\d{2}:?\d{2}))?"
    m, name = _month(list(range(1, 13)))
    return f"^(?i)(?:(?:{'|'.join(full)})(?:{time})?|{_YEAR}-{m}|{name},? {_YEAR})$"


DATE_RE = _date_pattern()


def numeric_value(v: Column) -> Column:
    """V1 (numeric part): the float value, trying the text as is, then with ',' -> '.'."""
    direct = F.when(v.rlike(NUMBER_RE), F.regexp_replace(F.trim(v), "_", "").cast("double"))
    swapped = F.regexp_replace(v, ",", ".")
    second = F.when(swapped.rlike(NUMBER_RE), F.regexp_replace(F.trim(swapped), "_", "").cast("double"))
    return F.coalesce(direct, second)


def is_numeric(v: Column) -> Column:
    return v.rlike(NUMBER_RE) | F.regexp_replace(v, ",", ".").rlike(NUMBER_RE)


def is_date(v: Column) -> Column:
    """V1 (date part): a date of one of the shapes that is in the calendar."""
    return F.coalesce(v.rlike(DATE_RE), F.lit(False))


def value_type(v: Column) -> Column:
    """V1: 'numeric', else 'date', else 'string'."""
    return F.when(is_numeric(v), "numeric").when(is_date(v), "date").otherwise("string")


def value_type_profile(attr_values: DataFrame) -> DataFrame:
    """V2 + V12 per attribute over unique values: counts and ratios per type, unique count,
    numeric mean (+1e-9), top value (most frequent; ties -> smallest), total frequency."""
    t = attr_values.withColumn("vt", value_type(F.col("value"))).withColumn("num", numeric_value(F.col("value")))
    finite = F.when(F.col("vt") == "numeric", F.col("num"))
    prof = t.groupBy("attribute").agg(
        F.count_if(F.col("vt") == "numeric").alias("n_numeric"),
        F.count_if(F.col("vt") == "string").alias("n_string"),
        F.count_if(F.col("vt") == "date").alias("n_date"),
        F.count(F.lit(1)).alias("no_unique_values"),
        F.sum("n").cast("bigint").alias("total_freq"),
        F.avg(F.when(~F.isnan(finite), finite)).alias("numeric_mean"),
        F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("value").alias("v"))).getField("v").alias("top_value"),
    )
    u = F.col("no_unique_values")
    return prof.select(
        "*",
        (F.col("n_numeric") / u).alias("ratio_numeric"),
        (F.col("n_string") / u).alias("ratio_string"),
        (F.col("n_date") / u).alias("ratio_date"),
    )


def _mixed(t: str) -> Column:
    r1, r2 = F.col(f"ratio_{t}_good"), F.col(f"ratio_{t}_bad")
    return (r1 > 0.25) & (r2 > 0.25) & (r2 > r1 * 0.95) & (r2 < r1 * 1.05)


# The labels of a type match, as users see them.
def type_match() -> Column:
    """V3 over the good (list 1) and bad (list 2) profiles, with the documented mixed labels."""
    g = lambda c: F.col(f"{c}_good")
    b = lambda c: F.col(f"{c}_bad")
    ms, mn, md = _mixed("string"), _mixed("numeric"), _mixed("date")
    return (
        F.when((g("ratio_numeric") > 0.9) & (b("ratio_numeric") > 0.9), "numeric match")
        .when((g("ratio_string") > 0.9) & (b("ratio_string") > 0.9), "strings match")
        .when((g("ratio_date") > 0.9) & (b("ratio_date") > 0.9), "date match")
        .when(ms & mn & md, "mixed string, numeric and date match")
        .when(ms & mn, "mixed string and numeric match")
        .when(ms & md, "mixed string and date match")
        .when(mn & md, "mixed numeric and date match")
        .when(ms, "mixed match string")
        .when(mn, "mixed match numeric")
        .when(md, "mixed match date")
        .otherwise("no match")
    )


def magnitude() -> tuple[Column, Column]:
    """V5: (roughly_equivalent, magnitude_difference) from the two numeric means."""
    m1, m2 = F.col("numeric_mean_good") + F.lit(1e-9), F.col("numeric_mean_bad") + F.lit(1e-9)
    ok = (m1 != 0) & (m2 != 0) & ~F.isnan(m1) & ~F.isnan(m2) & (F.abs(m1) < float("inf")) & (F.abs(m2) < float("inf"))
    g1 = F.floor(F.log10(F.abs(m1))).cast("int")
    g2 = F.floor(F.log10(F.abs(m2))).cast("int")
    same_sign = (m1 >= 0) == (m2 >= 0)
    diff = F.when(same_sign, F.abs(g1 - g2)).otherwise(F.abs(g1 + g2))
    is_num = F.col("type_match") == "numeric match"
    rough = F.when(is_num & ok, g1 == g2)
    mag = F.when(is_num & ok & (g1 != g2), diff)
    return rough, mag


def top_values_cap(attr_values: DataFrame, cap: int = 1000) -> DataFrame:
    """V6: keep an attribute's `cap` most frequent values (ties -> smaller value)."""
    w = Window.partitionBy("attribute").orderBy(F.col("n").desc(), F.col("value"))
    return attr_values.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")


def exact_score(pairs: DataFrame, attr_values: DataFrame, profile: DataFrame) -> DataFrame:
    """V4: (2|A∩B|/(|A|+|B|)) * (shared frequency on both sides / all frequency).

    A value meets either its own holders (held by few attributes) or the partners of each holder
    (held by many), whichever makes fewer rows.
    """
    pairs = pairs.select("name", "good_attribute", "bad_attribute")
    asked = pairs.groupBy(F.col("good_attribute").alias("attribute")).agg(F.count(F.lit(1)).alias("partners"))
    values = attr_values.select("attribute", "value", "n")
    holders = values.join(asked, "attribute", "left").groupBy("value").agg(
        F.count(F.lit(1)).alias("holders"), F.coalesce(F.sum("partners"), F.lit(0)).alias("rows")
    )
    few = F.col("holders") * F.col("holders") <= F.col("rows")
    held = values.join(holders.where("rows > 0"), "value").withColumn("few", few)
    vg = held.select(F.col("attribute").alias("good_attribute"), "value", F.col("n").alias("n_good"), "few")
    vb = held.select(F.col("attribute").alias("bad_attribute"), "value", F.col("n").alias("n_bad"), "few")
    own = vg.where("few").drop("few").join(vb.where("few").drop("few"), "value")
    own = own.select("good_attribute", "bad_attribute", "n_good", "n_bad")
    asked_for = pairs.select("good_attribute", "bad_attribute").distinct()
    partners = vg.where("not few").drop("few").join(asked_for, "good_attribute").join(vb.where("not few").drop("few"), ["bad_attribute", "value"])
    shared = own.unionByName(partners.select(own.columns)).groupBy("good_attribute", "bad_attribute").agg(
        F.count(F.lit(1)).alias("n_shared"), F.sum(F.col("n_good") + F.col("n_bad")).alias("shared_freq")
    )
    return (
        pairs.join(shared, ["good_attribute", "bad_attribute"])
        .groupBy("name")
        .agg(F.sum("n_shared").alias("n_shared"), F.sum("shared_freq").alias("shared_freq"))
    )


#: Values of a block of the shorter lists that ask and of the longer list.
SHORT_BLOCK, LONG_BLOCK = 65_536, 1_048_576
#: A short long list is sent to more tasks, with at least so many values that ask, and at most so many copies of its values.
LEAST_ASKED, SPREAD = 128, 1_000_000


def _blocks(values: DataFrame, by: str, count: Column, block: str, column: str) -> DataFrame:
    """(<by>, <block>, <column>): the values of an attribute in ``count`` lists."""
    dealt = values.groupBy(by, F.pmod(F.xxhash64("value"), count).alias(block))
    return dealt.agg(F.collect_list("value").alias(column)).where(F.size(column) > 0)


def best_value_matches(pairs: DataFrame, attr_values: DataFrame, short_block: int = SHORT_BLOCK, long_block: int = LONG_BLOCK) -> DataFrame:
    """(name, value, match, jaro): for every value of the shorter list (the good attribute's on
    equal sizes) the value of the other list with the highest Jaro-Winkler (ties: smaller value).

    All values count, none is capped. Equal values are found by a join first; the others, once for
    all pairs that compare them with the same list, are searched in the whole longer list block by block.
    """
    sizes = attr_values.groupBy("attribute").agg(F.count(F.lit(1)).alias("n_values"))
    side = lambda s: sizes.select(F.col("attribute").alias(f"{s}_attribute"), F.col("n_values").alias(f"n_{s}"))
    p = pairs.select("name", "good_attribute", "bad_attribute").join(side("good"), "good_attribute").join(side("bad"), "bad_attribute")
    good_short = F.col("n_good") <= F.col("n_bad")
    roles = p.select(
        "name",
        F.when(good_short, F.col("good_attribute")).otherwise(F.col("bad_attribute")).alias("short"),
        F.when(good_short, F.col("bad_attribute")).otherwise(F.col("good_attribute")).alias("long"),
    )
    values = attr_values.select("attribute", "value")
    shorts = roles.join(values.withColumnRenamed("attribute", "short"), "short")
    equal = values.select(F.col("attribute").alias("long"), "value")
    same = shorts.join(equal, ["long", "value"]).select("name", "value", F.col("value").alias("match"), F.lit(1.0).alias("jaro"))
    rest = cut_lineage(shorts.join(equal, ["long", "value"], "left_anti").select("name", "long", "value"))

    asked = rest.select("long", "value").distinct()
    cuts = asked.groupBy("long").agg(F.count(F.lit(1)).alias("n_asked")).join(sizes.withColumnRenamed("attribute", "long"), "long")
    more = F.least(F.ceil(F.col("n_asked") / LEAST_ASKED), F.floor(SPREAD / F.col("n_values")))
    cuts = cuts.select("long", F.greatest(F.ceil(F.col("n_asked") / short_block), more).alias("parts"), F.ceil(F.col("n_values") / long_block).alias("blocks"))
    left = _blocks(asked.join(cuts, "long"), "long", F.col("parts"), "part", "values")
    right = _blocks(equal.join(cuts, "long"), "long", F.col("blocks"), "block", "others")
    # one row is one piece of work: a block against a block; few rows, so they are dealt out finely
    dealt = 8 * int(attr_values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = left.join(right, "long").repartition(dealt, "long", "part", "block")

    def match(batches):
        last = (None, None)
        for pdf in batches:
            for long_, block, vs, ws in zip(pdf["long"], pdf["block"], pdf["values"], pdf["others"]):
                if last[0] != (long_, block):
                    last = ((long_, block), ValueTree(list(ws)))
                found = pd.DataFrame(last[1].best(list(vs)), columns=["jaro", "match"])
                yield found.assign(long=long_, value=list(vs))[["long", "value", "jaro", "match"]]

    found = work.mapInPandas(match, "long string, value string, jaro double, match string")
    top = F.min(F.struct((-F.col("jaro")).alias("worst"), F.col("match").alias("match")))
    best = rest.join(found, ["long", "value"]).groupBy("name", "value").agg(top.alias("m"))
    return same.unionByName(best.select("name", "value", "m.match", (-F.col("m.worst")).alias("jaro")))


@F.pandas_udf(T.StructType([T.StructField("damerau_levenshtein", T.IntegerType()), T.StructField("hamming", T.IntegerType())]))
def _distances(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"damerau_levenshtein": damerau_levenshtein_rows(list(a), list(b)), "hamming": [hamming(x, y) for x, y in zip(a, b)]}, dtype="int32")


def best_value_matches_stats(pairs: DataFrame, attr_values: DataFrame, **blocks) -> DataFrame:
    """Mean, sample std and 0.9 quantile (linear) of Jaro-Winkler, Damerau-Levenshtein and
    Hamming over the best matches (V10) of each pair."""
    best = best_value_matches(pairs, attr_values, **blocks).withColumn("d", _distances("value", "match"))
    best = best.select("name", "jaro", F.col("d.damerau_levenshtein").cast("double").alias("damerau_levenshtein"), F.col("d.hamming").cast("double").alias("hamming"))
    aggs = []
    for c in ("jaro", "damerau_levenshtein", "hamming"):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.percentile(c, 0.9).alias(f"{c}_q90")]
    return best.groupBy("name").agg(*aggs)


def pairs_missing_values(pairs: DataFrame, attr_values: DataFrame) -> DataFrame:
    """Pairs skipped because an attribute has no values, with the reason."""
    have = attr_values.select("attribute").distinct()
    hg = have.select(F.col("attribute").alias("good_attribute"), F.lit(True).alias("hg"))
    hb = have.select(F.col("attribute").alias("bad_attribute"), F.lit(True).alias("hb"))
    p = pairs.join(hg, "good_attribute", "left").join(hb, "bad_attribute", "left")
    reason = (
        F.when(F.col("hg").isNull() & F.col("hb").isNull(), "both have no values")
        .when(F.col("hg").isNull(), "good attribute has no values")
        .otherwise("bad attribute has no values")
    )
    return p.where(F.col("hg").isNull() | F.col("hb").isNull()).select(*pairs.columns, reason.alias("reason"))


def value_features(pairs: DataFrame, attr_values: DataFrame, fuzzy: bool = True) -> DataFrame:
    """The per-pair value feature row (pairs need name, good_attribute, bad_attribute).

    Pairs with an attribute without values are left out (see V13). Fuzzy scores are
    computed only for pairs whose type match is neither numeric nor date.
    """
    prof = cut_lineage(value_type_profile(attr_values))  # one row an attribute, read several times
    pairs = cut_lineage(pairs.select("name", "good_attribute", "bad_attribute"))
    pg = prof.select(*[F.col(c).alias(f"{c}_good" if c != "attribute" else "good_attribute") for c in prof.columns])
    pb = prof.select(*[F.col(c).alias(f"{c}_bad" if c != "attribute" else "bad_attribute") for c in prof.columns])
    p = pairs.join(pg, "good_attribute").join(pb, "bad_attribute")
    p = p.withColumn("type_match", type_match())
    rough, mag = magnitude()
    p = p.withColumn("roughly_equivalent", rough).withColumn("magnitude_difference", mag)
    if fuzzy:
        need = cut_lineage(p.where(~F.col("type_match").isin("numeric match", "date match")).select("name", "good_attribute", "bad_attribute"))
    ex = exact_score(pairs, attr_values, prof)
    p = p.join(ex, "name", "left")
    shared_n = F.coalesce(F.col("n_shared"), F.lit(0))
    shared_f = F.coalesce(F.col("shared_freq"), F.lit(0))
    p = p.withColumn(
        "exact_score",
        (shared_n * 2.0 / (F.col("no_unique_values_good") + F.col("no_unique_values_bad")))
        * (shared_f / (F.col("total_freq_good") + F.col("total_freq_bad"))),
    )
    if fuzzy:
        fz = best_value_matches_stats(need, attr_values)
        p = p.join(fz, "name", "left").withColumn("jaro_score", F.col("jaro_q90"))
    return p
