from attrmill.operators import lexical as L

NAMES = [
    ("organism part", "organismpart"),
    ("a bc", "ab c"),
    ("visit 1", "visit 2"),
    ("sample_type", "sampleType"),
    ("Sex", "sex"),
    ("cell types", "cell type"),
]


def _diag(spark):
    from attrmill.functions import text as X
    from pyspark.sql import functions as F

    pairs = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in NAMES], "attribute1 string, attribute2 string")
    pairs = pairs.withColumn("levenshtein", X.fuzzy_ratio(F.col("attribute1"), F.col("attribute2")))
    attrs = spark.createDataFrame([(x, 5) for p in NAMES for x in p], "attribute string, frequency long")
    dic = spark.createDataFrame([(w,) for w in ["cell", "type", "organism", "part", "visit", "sex", "sample"]], "word string")
    return {r.name: r for r in L.diagnose(pairs, attrs, dic).withColumn("msg", L.issue_message()).collect()}


def test_hand_cases(spark):
    d = _diag(spark)
    r = d["organism part § organismpart"]
    assert r.only_space_discrepancy and r.space_discrepancy and r.pseudo_confidence == 0.9
    r = d["a bc § ab c"]
    assert r.only_space_discrepancy and not r.space_discrepancy
    r = d["visit 1 § visit 2"]
    assert r.number_discrepancy and r.pseudo_confidence == 0.1
    r = d["Sex § sex"]
    assert r.case_discrepancy and r.msg == "case discrepancy detected"
    r = d["cell type § cell types"]
    assert r.lemma_discrepancy and r.s_discrepancy and r.msg == "Pluralisation discrepancy detected"
    # ties in frequency make attribute2 the good one
    assert r.good_attribute == "cell types"


def test_flag_implications(spark):
    for r in _diag(spark).values():
        assert not r.s_lower_discrepancy or r.s_discrepancy
        assert not r.s_discrepancy or r.lemma_discrepancy
        assert not r.just_specials_discrepancy or r.specials_discrepancy
