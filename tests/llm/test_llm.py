"""Corpus operators against brute force, exact round trips and planted cases, with
null, empty, repeated, tied and clashing rows."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrmill.llm import bpe, decontaminate, html_text, language_id, ngram_jaccard, quality, secrets, token_files, toxicity, warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    """Whole small table, plus null, empty, blank, very long and repeated rows, and a clashing column."""
    own = spark.read.parquet(f"{SF}/documents.parquet")
    first = own.orderBy("doc_id").first()
    more = spark.createDataFrame(
        [(900001, None, None, "x", 0), (900002, "", "en", "x", 0), (900003, " \n\t ", "en", "x", 4), (900004, "one two", "en", "x", 7),
         (900005, "one  TWO", "en", "x", 8), (900006, "wörd " * 30_000, None, "x", 150_000), (None, first.text, "en", "x", 9), tuple(first), tuple(first)],
        own.schema,
    )
    return own.unionByName(more).withColumn("score", F.lit("clash")).withColumn("node", F.lit(1)).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def empty(docs):
    return docs.limit(0)


# ---- 2 ----------------------------------------------------------------------------------


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(sets):
    """sets: list of (id, set); id -> smallest linked id."""
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if both and 100 * both >= 80 * (len(a) + len(b) - both):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def test_join_equals_brute_force(docs, rows):
    want = brute_components([(i, shingles(t)) for i, t in dict((i, t) for i, t in rows if i is not None).items()])
    got = ngram_jaccard.join_components(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
    size = {i: len(shingles(t)) for i, t in rows}
    assert all(r.n_shingles == size[r.doc_id] for r in got)
    assert ngram_jaccard.join_components(empty(docs)).count() == 0


def test_join_of_many_near_copies(spark):
    """Groups of near copies that are not all linked pairwise, light and heavy sizes, and a line that all share."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    line = [word() for _ in range(12)]
    out = []
    for size in (7, 12, 30, 90, 200):
        base = [word() for _ in range(size)]
        for _ in range(25):
            w = list(base)
            for at in rng.integers(0, size, max(1, size // 25)):
                w[at] = word()
            out.append((len(out), " ".join([*line, *w] if rng.random() < 0.5 else w)))
    got = {r.doc_id: r.component_id for r in ngram_jaccard.join_components(spark.createDataFrame(out, "doc_id long, text string")).collect()}
    assert got == brute_components([(i, shingles(t)) for i, t in out])


# ---- 3 ----------------------------------------------------------------------------------


def brute_hits(text, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = lambda t: re.findall(pattern, (t or "").translate({c: c + 32 for c in range(65, 91)}))
    w = words(text)
    hit, found = set(), set()
    for i, t in items:
        x = words(t)
        for at in range(max(1, len(x) - 9) if x else 0):
            p = x[at : at + 10]
            for s in range(len(w) - len(p) + 1):
                if w[s] == p[0] and w[s : s + len(p)] == p:
                    hit.update(range(s, s + len(p)))
                    found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("limit", [1_000_000, 300])
def test_decontamination_equals_brute_force(spark, docs, limit):
    some = docs.filter("doc_id < 60 or doc_id > 900000 and doc_id != 900006")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(50, "ONE two"), (51, ""), (52, None), (50, "one two"), (53, "one")]
    got = decontaminate.contamination(some, spark.createDataFrame(items, "item_id long, text string"), limit).collect()
    texts = {r.doc_id: r.text for r in some.collect()}
    assert len(got) == some.count()
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == brute_hits(texts[r.doc_id], items)
        assert r.contaminated == (r.n_hit > 0)
    assert any(r.contaminated for r in got)


def test_decontamination_of_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, none).filter("contaminated").count() == 0
    assert decontaminate.contamination(empty(docs), none).count() == 0


# ---- 4, 5 -------------------------------------------------------------------------------


def test_base_secrets_equal_plain_patterns(docs, rows):
    got = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    for i, t in rows:
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        spans.sort()
        assert got[i].base_sha256 == hashlib.sha256(secrets.joined(spans).encode()).hexdigest()
        assert got[i].n_hex == sum(k == 2 for _, k, _ in spans)
        assert set(secrets.joined(spans).split(",")) <= set(got[i].spans.split(","))


def test_entropy_spans_and_allow_list():
    key = "q7Zx9LmP2vRt8KsW4nBd6HfJ1cYg"
    text = f"key {key} and the-very-long-hyphenated-name-of-it 123e4567-e89b-12d3-a456-426614174000 zyzyzyzyzyzyzyzyzyzyzyzyzyz1"
    base, spans = secrets.scan(text)
    assert base == [] and spans == [(4, 3, 4 + len(key))]
    assert secrets.redact(text).startswith("key [SECRET] and")
    assert secrets.redact("") == ""


def test_keys_without_digits():
    rng = np.random.default_rng(11)
    alphabets = {"letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/"}
    for kind, signs in alphabets.items():
        for n in (24, 32, 40):
            keys = ["".join(rng.choice(list(signs), n)) for _ in range(300)]
            assert sum("[SECRET]" in secrets.redact(f"key {k} and") for k in keys) >= 290, (kind, n)
    for word in (
        "schverlicheinpfauung", "DONAUDAMPFSCHIFFFAHRTSGESELLSCHAFT", "Donaudampfschifffahrtsgesellschaft", "AbstractSingletonProxyFactoryBean",
        "getUserNameFromRequestContext", "XMLHttpRequestUploadHandler", "the-very-long-hyphenated-name", "=-=-=-=-=-=-=-=-=-=-=-=", "www.Example.com/Path/To/Something",
    ):
        assert secrets.scan(word) == ([], []), word


@pytest.mark.parametrize("s", ["abababababab", "q7Zx9LmP2vRt8KsW4nBd6HfJ", "q7Zx9-LmP2v.Rt8KsW4nBd6HfJ1cYgaaaaaaaaaaaaaaaa"])
def test_incremental_entropy_equals_recount(s):
    members, size, least = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 8, 2.4
    marked = set()
    for i in range(len(s) - size + 1):
        w = s[i : i + size]
        if set(w) <= members and -sum(c / size * np.log2(c / size) for c in Counter(w).values()) >= least:
            marked.update(range(i, i + size))
    got = {k for a, b in secrets.entropy_windows(s, members, size, least) for k in range(a, b)}
    assert got == marked


def test_quality_counts_equal_plain_counts(docs, rows):
    got = {r.doc_id: r for r in quality.measure_quality(docs).collect()}
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {k + d for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for d in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(again))
        assert (r.n_symbols, r.n_dup_lines) == (len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w)) and not (r.base_failed and r.kept)


def test_bands_reject_repetition_and_noise():
    compress = __import__("zstandard").ZstdCompressor(level=3).compress
    rng = np.random.default_rng(1)
    prose = " ".join("".join(rng.choice(list("etaoinshr"), rng.integers(2, 9))) for _ in range(600)).encode()
    assert quality.compression_ok(prose, compress)[0]
    assert not quality.compression_ok(b"the same words again. " * 300, compress)[0]
    assert not quality.compression_ok(rng.integers(0, 256, 5000, np.uint8).tobytes(), compress)[0]
    assert quality.compression_ok(b"", compress)[0]


def test_bands_see_every_byte_and_noise_of_valid_text(rows):
    import zstandard

    compress = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    rng = np.random.default_rng(5)
    texts = [t.encode() for i, t in rows if t and i and i < 900_000 and len(t) > 4_000 and quality.compression_ok(t.encode(), compress)[0]][:20]
    assert len(texts) == 20
    noise = {
        "printable": lambda n: rng.integers(33, 127, n, np.uint8).tobytes(),
        "base64": lambda n: base64.b64encode(rng.bytes(n))[:n],
        "letters and digits": lambda n: bytes(rng.choice(np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", np.uint8), n)),
    }
    for kind, make in noise.items():
        for n in (200, 500, 1_000, 2_000, 3_000, 30_000):
            assert not quality.compression_ok(make(n), compress)[0], (kind, n)
        for t in texts:
            for n in (500, 1_989):  # in the rest after the last full chunk
                assert not quality.compression_ok(t[:2_000] + make(n), compress)[0], (kind, n)
            assert not quality.compression_ok(t[:4_000] + make(2_000), compress)[0], kind  # one full chunk of three
    for t in texts:
        for n in (120, 400, 1_999, 2_100, 3_000, len(t)):
            assert quality.compression_ok(t[:n], compress)[0], n
    for n in (1, 1_999, 2_000, 2_199, 2_200, 6_100):
        assert b"".join(quality.chunks_of(bytes(n))) == bytes(n)


# ---- 1, 9 -------------------------------------------------------------------------------


def test_language_of_held_out_documents(docs):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language_id.fit(docs.filter(~held | F.col("doc_id").isNull()))
    got = language_id.predict(docs, model).join(docs.select("doc_id", "lang", "text"), "doc_id")
    sure = got.filter("lang is not null and doc_id < 900000 and length(text) > 20 ").filter(held)
    assert sure.filter("lang = lang_pred").count() >= 0.95 * sure.count() > 0
    blank = {r.doc_id: (r.lang_pred, r.score) for r in got.collect()}
    assert blank[900001] == blank[900002] == blank[900003] == ("und", 0.0)
    assert {r.lang_pred for r in language_id.predict(docs, language_id.fit(empty(docs))).collect()} == {"und"}


def test_toxicity_catches_disguised_words(spark):
    clean = ["the river runs to the sea", "a quiet morning by the lake", "they read a long book", "rain fell on the hills"]
    texts = [(i, f"{clean[i % 4]} number {'abcdefghij'[i % 10]}" + (" you blorgit" if i % 5 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame([*texts, (1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(1000, 1), (1001, None)], "doc_id long, toxic int")
    model = toxicity.character_model(docs)
    rules = toxicity.fit(toxicity.training_rows(docs, labels), model)
    score = toxicity._scorer(rules, model)
    for t in ("a blorgit", "BLORGIT!", "bl0rg1t", "bloooorgit", "b l o r g i t", "b.l.o.r.g.i.t"):
        assert score(t) >= toxicity.THRESHOLD, t
    assert all(score(t) < toxicity.THRESHOLD for t in (*clean, "", None, "B2B 100% $$$ 12:30"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, rules, model).collect()}
    assert got[1000] == got[1001] == toxicity.LEAST_SCORE and len(got) == 402
    assert toxicity.fit(toxicity.training_rows(docs, labels.limit(0)), model) == {}


def test_toxicity_finds_words_behind_breaks(spark):
    clean = ["the river runs to the sea", "a quiet morning by the lake", "they read a long book", "rain fell on the hills"]
    texts = [(i, f"{clean[i % 4]} number {'abcdefghij'[i % 10]}" + (" you blorgit" if i % 5 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.character_model(docs)
    # the word alone, so that 'you' beside it cannot answer for it
    score = toxicity._scorer({"=blorgit": 0.9}, model)
    for t in (
        "they read a b l o r g i t", "a.b.l.o.r.g.i.t", "y o u b l o r g i t", "t h e b l 0 r g i t", "y o u  b l o r g i t", "y o u / b l o r g i t",
        "you/bl0rg1t", "you,bl0rg1t", "read,bl0rg!t.", "the-bl0rg1t/sea", "bblloorrggiitt", "BBlloorrggiitt!", "b l o o o r g i t",
    ):
        assert score(t) >= toxicity.THRESHOLD, t
    assert all(score(t) < toxicity.THRESHOLD for t in (*clean, "t h e r i v e r", "book/hills", "the committee's address", "a b c d", "% y.%", "*** a", "a a a a a"))
    rules = toxicity.fit(toxicity.training_rows(docs, labels), model)
    assert toxicity._scorer(rules, model)("a b l o r g i t") >= toxicity.THRESHOLD


# ---- 6, 10 ------------------------------------------------------------------------------


def page(i, host="h", nav="menu", extra=""):
    return (i, f"https://{host}/p{i}", f"<html><body><div class=x>{nav}</div><div class=y><p>Text {i} &amp; more<br>here{extra}<p>Second <b>par{i}</b></div><footer>f</footer>")


def test_template_is_left_out_and_slots_stay(spark):
    rows = [page(i) for i in range(6)] + [page(9, "single"), (10, None, "<p>a</p>"), (11, "https://h/n", None), (12, "https://h/e", "")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Text 3 & more here\n\nSecond par3"
    assert got[9] == "menu\n\nText 9 & more here\n\nSecond par9"  # one page: nothing to compare with
    assert (got[10], got[11], got[12]) == ("a", "", "")


def test_main_text_is_not_lost_to_attributes_and_names():
    long = "One sentence of the text. " * 8
    for tag in (
        'p style="overflow:hidden"', 'p><a href="/hidden-gems"', "p title='hidden'", "p data-role=menu", 'p id="x" width=3', "div class=no-sidebar", 'div class="x with-sidebar"',
        "div class=comments-open", "div id=related-work", "div data-class=ad", 'div title="class=ad"',
    ):
        assert html_text.main_text(f"<body><div><{tag}>{long}</div>") == long.strip(), tag
    for tag in ("div class=ad", "div class='x sidebar'", "div id=site-footer", "p hidden", "p hidden=''", "p aria-hidden=true", "p role=menu", "div class=ad-3"):
        assert html_text.main_text(f"<body><div><p>kept</p><{tag}>{long}") == "kept", tag
    assert html_text.main_text(f"<body class=sidebar><div class=social><article class=related><p>{long}</article></div>") == long.strip()
    teaser = "<article><p>Teaser</article>"
    assert long.strip() in html_text.main_text(f"<body>{teaser}<main><p>{long}</main>")
    assert long.strip() in html_text.main_text(f"<body><p>{long}</p>{teaser}")
    assert html_text.main_text(f"<body><main><article><p>{long}</article><p>after</main><div class=sidebar>{teaser}</div><p>rest") == long.strip()


def test_article_of_the_pages_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html_text.extract(pages).join(pages, ["page_id", "url"]).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", __import__("html").unescape(re.sub(r"<[^>]*>?", " " if "br" in b[:4] else "", b.replace("<br>", "\n")))).strip() for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_archives_round_trip(spark):
    rows = [(1, "u", "<p>a</p>"), (2, None, "<p>a</p>"), (3, "w\r\nx", ""), (4, "v", None), (5, "v", "ä" * 700_000), (5, "v", "ä" * 700_000), (None, "z", "<p>a</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1))
    places = warc.write_archives(pages)
    got = warc.read_archives(spark, places).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got) == sorted(
        [(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (5, "response", None), (0, "revisit", 2)], key=str
    ) or {(r.page_id, r.record_type, r.refers_to) for r in got} == {(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (None, "revisit", 2)}
    for r in got:
        payload = (dict((i, h) for i, _, h in rows)[r.page_id] or "").encode()
        assert r.payload_bytes == len(payload) and r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
    place = places.filter("page_id = 2").first()
    assert warc.read_record(place.bundle, place.frame, place.offset, place.length)[1] == b"<p>a</p>"
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0))).count() == 0
    assert {r.record_type for r in warc.read_archives(spark, warc.write_archives(pages, least=100)).filter("page_id = 1").collect()} == {"response"}


# ---- 7, 8 -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    def load(name):
        t = Tokenizer.from_file(P.path(name))
        t.no_truncation()
        t.no_padding()
        return P.path(name), t

    return load


ODD_TEXTS = ["", " ", "a  b", " lead", "tail ", "\n x\n", "ΑΣ ΣΑΣ. İ", "<|endoftext|>x <|startoftext|> y", "aaaaaaaaaaa", "I'LL don't 's", "日本語 😀a", "\x1c \x85\xa0b", "x́ é K Å"]


def test_bpe_equals_the_library(tokenizer, docs, rows):
    path, lib = tokenizer("word_bpe_49k.json")
    encoder = bpe.Encoder(bpe.Vocabulary(path))
    for t in ODD_TEXTS:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert (encoder.encode(t) if t else []) == ids and encoder.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    got = {r.doc_id: r for r in bpe.encode_digests(docs, path).collect()}
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(empty(docs), path).count() == 0


def test_token_files_round_trip(tokenizer, spark, docs, rows):
    path, lib = tokenizer("byte_bpe_50k.json")
    named = docs.filter("doc_id is not null")
    got = token_files.read_tokens(spark, token_files.write_tokens(named, path)).orderBy("start").collect()
    start, seen = 0, []
    texts = dict(rows)
    for r in got:
        ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        seen.append(r.doc_id)
    assert seen == sorted(i for i, _ in rows if i is not None)
    encoder = token_files.ChunkEncoder(open(path).read())
    for t in ODD_TEXTS[1:]:
        assert np.frombuffer(encoder.encode(t), "<u2").tolist() == lib.encode(t, add_special_tokens=False).ids
    assert token_files.read_tokens(spark, token_files.write_tokens(empty(named), path)).count() == 0
    with pytest.raises(ValueError):
        token_files.write_tokens(docs, path)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1001])
def test_packing(n):
    a = np.random.default_rng(n).choice(np.array([0, 255, 256, 65_535, 65_536, 2**24, 2**32 - 1], np.uint32), n)
    assert (token_files.unpack(token_files.pack(a), n) == a).all()
    small = (a & 255).astype(np.uint32)
    assert (token_files.unpack(token_files.pack(small), n) == small).all()


# ---- pipeline ---------------------------------------------------------------------------


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as cp

    d = docs
    kept = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        before = d
        d = stage(spark, d, SF).cache()
        kept[name] = d
        if k < len(cp.STAGES) - 1:
            assert d.columns == docs.columns
    near = {r.doc_id: r.component_id for r in ngram_jaccard.join_components(kept["toxicity"]).collect()}
    ids = [r.doc_id for r in kept["ngram_jaccard_join"].collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, c in near.items() if i is not None and i == c)
    clean = decontaminate.contamination(kept["ngram_jaccard_join"], spark.read.parquet(f"{SF}/benchmark.parquet")).filter("not contaminated")
    assert kept["benchmark_decontamination"].count() == clean.count() < len(ids)
    assert kept["secret_scans"].count() == clean.count()
    assert not any(secrets.scan(r.text)[0] for r in kept["secret_scans"].filter("text is not null").collect() if "[SECRET]" not in r.text)
    assert d.count() == clean.count() and d.columns == ["doc_id", "n_tokens", "ids"]
