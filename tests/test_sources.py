"""Readers over files of many splits, against the csv and json modules."""

import csv
import json
import random

import pytest

from attrmill.sources import readers as RD
from plan_metrics import shuffled_rows

CELLS = ["plain", "", "a,b", 'say "x"', '"', '""', "two\nlines", "cr\r\nlf", "\n", "ü,\n\"é\"", " lead", "x" * 300, "NA", "\\"]


@pytest.fixture
def small_splits(spark):
    """Splits of 64 bytes, so that records and strings lie across them."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_incidence_equals_csv_module(spark, tmp_path, small_splits):
    rng = random.Random(5)
    rows = [[f"S{i}"] + [rng.choice(CELLS) for _ in range(rng.randrange(6))] for i in range(200)]
    for k in range(2):
        with open(tmp_path / f"samples{k}.csv", "w", newline="", encoding="utf-8") as f:
            csv.writer(f, lineterminator="\r\n" if k else "\n").writerows(rows[k::2])
    got = RD.read_incidence(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 1
    assert sorted((r.sample_id, list(r.attributes)) for r in got.collect()) == sorted((r[0], r[1:]) for r in rows)


def test_incidence_cell_without_stack(spark, tmp_path):
    long = 'a""b' * 200_000 + "," * 1000
    (tmp_path / "s.csv").write_text('S1,"' + long + '",x\n\nS2\n')
    got = {r.sample_id: list(r.attributes) for r in RD.read_incidence(spark, str(tmp_path / "s.csv")).collect()}
    assert got == {"S1": [long.replace('""', '"'), "x"], "S2": []}


def test_incidence_open_quote_is_an_error(spark, tmp_path):
    (tmp_path / "s.csv").write_text('S1,"open\nS2,x\n')
    with pytest.raises(Exception, match="quote is not closed"):
        RD.read_incidence(spark, str(tmp_path / "s.csv")).collect()


def test_incidence_empty_file(spark, tmp_path):
    (tmp_path / "s.csv").write_text("")
    assert RD.read_incidence(spark, str(tmp_path / "s.csv")).collect() == []


@pytest.mark.parametrize("indent", [None, 1])
def test_value_counts_equal_json_module(spark, tmp_path, small_splits, indent):
    rng = random.Random(7)
    texts = ["a", 'q"uote', "com,ma", "{", "}", "}}, {", "back\\", '\\"', "line\nbreak", "ü€😀", "", '": {', '": 3', "n" * 200]
    nested = {f"{t}{i}": {f"{rng.choice(texts)}{j}": rng.randrange(1000) for j in range(rng.choice([0, 1, 2, 40]))} for i, t in enumerate(texts)}
    nested[""] = {"": 5}
    (tmp_path / "values.json").write_text(json.dumps(nested, indent=indent, ensure_ascii=indent is None), encoding="utf-8")
    got = RD.read_value_counts(spark, str(tmp_path / "values.json"))
    want = sorted((a, v, n) for a, vals in nested.items() for v, n in vals.items())
    assert sorted(map(tuple, got.collect())) == want


def test_value_counts_of_an_empty_object(spark, tmp_path):
    (tmp_path / "values.json").write_text("{}")
    assert RD.read_value_counts(spark, str(tmp_path / "values.json")).collect() == []


def test_pieces_are_not_shuffled(spark, tmp_path):
    """Only the ends of records that lie across splits travel: few rows a split, whatever its length."""
    rows = [[f"S{i}", "two\nlines", "x" * 20] for i in range(3000)]
    with open(tmp_path / "s.csv", "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator="\n").writerows(rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = RD.read_incidence(spark, str(tmp_path / "s.csv"))
        assert shuffled_rows(got) < 1000
        assert sorted([r.sample_id, *r.attributes] for r in got.collect()) == sorted(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_record_over_many_splits_and_batches(spark, tmp_path, small_splits):
    """A cell longer than several splits, and Arrow batches of a few pieces."""
    rows = [["A", "a\n" * 150], ["B", "b"], ["C", '"\n' * 90 + "c"], ["D", "d\nd"]] * 3
    with open(tmp_path / "s.csv", "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator="\n").writerows(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = RD.read_incidence(spark, str(tmp_path / "s.csv")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted([r.sample_id, *r.attributes] for r in got) == sorted(rows)
