"""Pages with copies, deep nesting and text around articles; edge cases of other operators."""

from __future__ import annotations

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from attrmill.llm import html_text, language_id, ngram_jaccard, secrets, warc

PAGES = "page_id long, url string, html string"
STORY = "One sentence of the story that all copies share. " * 12


def texts(spark, rows):
    return {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}


def copy(i, host="h", title="Title", story=STORY):
    return (i, f"https://{host}/{i}", f"<body><div class=top>Welcome to the site</div><article><h1>{title}</h1><p>{story}</p></article><div class=t>tracker {i}</div>")


def test_copies_with_other_trackers_keep_their_article(spark):
    want = f"Title\n\n{STORY.strip()}"
    assert set(texts(spark, [copy(i) for i in range(4)]).values()) == {want}
    got = texts(spark, [copy(i) for i in range(10)] + [copy(20 + i, title=f"Other {i}", story=f"Another story, number {i}. " * 20) for i in range(6)])
    assert all(got[i] == want for i in range(10))  # an article on ten pages of a host that has others as well
    loose = [(i, f"https://g/{i}", f"<body><div class=y><p>{STORY}</div><div class=t>tracker {i}</div>") for i in range(4)]
    assert all(STORY.strip() in t for t in texts(spark, loose).values())


def test_template_outside_articles_goes_by_pages_that_differ(spark):
    rows = [(i, f"https://h/{i}", f"<body><div class=top>Welcome to the site</div><div class=y><p>{f'Story {i} goes on. ' * 5}</div>") for i in range(3)]
    assert set(texts(spark, rows).values()) == {(f"Story {i} goes on. " * 5).strip() for i in range(3)}
    assert all("Welcome" in t for t in texts(spark, rows[:2]).values())  # two pages are too few


@pytest.mark.parametrize("tag", ["div", "font", "article", "li", "p", "nope"])
def test_deep_nesting(spark, tag):
    n = 20_000
    began = time.time()
    deep = "".join(f"<{tag}>w" for _ in range(n))
    assert html_text.main_text(deep).replace("\n\n", "") == "w" * n
    got = texts(spark, [(i, f"https://h/{i}", f"{deep} end {i}") for i in range(3)])
    assert all(t.endswith(f"end {i}") for i, t in got.items())
    assert time.time() - began < 60


def test_text_around_a_short_article_stays():
    article, outside = "a" * 199, "b" * 376
    assert html_text.main_text(f"<body><article><p>{article}</article><p>{outside}") == f"{article}\n\n{outside}"


def test_pages_of_empty_table_repeats_and_clashing_columns(spark):
    assert html_text.extract(spark.createDataFrame([], PAGES)).collect() == []
    rows = [copy(1), copy(1), (None, None, None), (2, "", "<p>x")]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as host", "2 as n_chars", "3 as reference", "4 as text")
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(((r.page_id or 0), r.n_chars) for r in got.collect()) == sorted([(1, len(f"Title\n\n{STORY.strip()}"))] * 2 + [(0, 0), (2, 1)])


def tree_rows(tree, parent=-1, out=None):
    out = [] if out is None else out
    at = len(out)
    out.append([parent, tree[0], 1, 1])
    for k in tree[1]:
        tree_rows(k, at, out)
    return out


def most_pairs(a, b):
    """Simple tree matching by enumeration of the children's alignments."""
    if a[0] != b[0]:
        return 0
    best = 0
    for k in range(min(len(a[1]), len(b[1])) + 1):
        for x in itertools.combinations(a[1], k):
            for y in itertools.combinations(b[1], k):
                w = [most_pairs(p, q) for p, q in zip(x, y)]
                best = max(best, sum(w) if all(w) else 0)
    return 1 + best


def test_alignment_equals_enumeration():
    rng = random.Random(3)

    def tree(depth):
        return (rng.choice("ab") if depth < 3 else "r", [tree(depth - 1) for _ in range(rng.randrange(4))] if depth else [])

    for _ in range(150):
        a, b = tree(3), tree(3)
        x, y = tree_rows(a), tree_rows(b)
        pairs = html_text.aligned(x, y)
        assert 1 + len(pairs) == most_pairs(a, b)
        known = dict([(0, 0), *pairs])
        assert len(known) == len(set(known.values())) == 1 + len(pairs)
        assert all(known[x[i][0]] == y[j][0] and x[i][1] == y[j][1] for i, j in pairs)
        # numbers rise in page order here, so order within a parent is kept if places rise together
        assert all(j < l for (i, j), (k, l) in itertools.combinations(pairs, 2) if x[i][0] == x[k][0])


def test_many_base_spans_are_swept_in_linear_time():
    rng = random.Random(5)
    line = lambda: "".join(rng.choices("0123456789abcdef", k=64))
    text = "\n".join(f"{line()}  file{i}" for i in range(40_000))
    began = time.time()
    base, spans = secrets.scan(text)
    assert len(base) == 40_000 and spans == base
    assert time.time() - began < 60
    inside = "token=" + "q7Zx9LmP2vRt8KsW4nBd6HfJ" + " q7Zx9LmP2vRt8KsW4nBd6HfJ"
    base, spans = secrets.scan(inside)
    assert [k for _, k, _ in base] == [0] and [k for _, k, _ in spans] == [0, 3]


def test_numbers_that_look_like_letters_are_undetermined(spark):
    assert language_id.words_of("½ ² ① Ⅷ 12 _") == []
    assert language_id.words_of("m² Straße été ①b") == ["m", "straße", "été", "b"]


@pytest.mark.parametrize("order", [0, 1])
def test_an_id_with_two_texts_keeps_its_links(spark, order):
    words = [f"w{i}" for i in range(60)]
    one, other = " ".join(words), "nothing like it " * 9
    twice = [(1, one), (1, other)]
    near = [(2, " ".join([*words[:-1], "x"])), (3, " ".join(["y", *words[1:]]))]
    docs = spark.createDataFrame((twice[::-1] if order else twice) + near, "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.component_id) for r in ngram_jaccard.join_components(docs).collect()}
    assert {(2, 1), (3, 1)} <= got


def test_bundles_are_read_by_many_tasks(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = warc.write_archives(spark.range(64).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("p"), "id").alias("html")).repartition(16))
    bundles = places.select("bundle").distinct().limit(n).collect()
    some = places.join(spark.createDataFrame(bundles).distinct(), "bundle")
    got = warc.read_archives(spark, some)
    assert got.count() == some.count()
    assert got.rdd.getNumPartitions() == len(bundles)
