"""Merkle manifest, whitening and line dedup against brute force, with null, empty, repeated,
tied and clashing rows, and sizes that need several rounds of windows."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrmill.llm import line_dedup, merkle, whitening
from attrmill.llm.catalog import op11_merkle_manifest, op12_embedding_whitening, op13_line_dedup

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# ---- 11 ---------------------------------------------------------------------------------


def leaf(r, text):
    parts = [r.doc_id, r.source, r.lang, r.n_chars, text]
    return sha("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))


def tree(leaves):
    """Root and, per leaf, its path as (before, after) lists of digests."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for k, p in enumerate(at):
            run, slot = runs[p // 3], p % 3
            paths[k].append((run[:slot], run[slot + 1 :]))
            at[k] = p // 3
        nodes = [sha("".join(r)) for r in runs]
    return nodes[0], paths


def brute_manifest(rows):
    """Rows with distinct ids; returns id -> the contract's columns."""
    groups = {}
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        groups.setdefault(r.source, []).append(r)
    keys = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: tree([leaf(r, r.text) for r in groups[s]]) for s in keys}
    root, above = tree([built[s][0] for s in keys])
    out = {}
    for k, s in enumerate(keys):
        sub, paths = built[s]
        for r, path in zip(groups[s], paths):
            path = path + above[k]
            own = leaf(r, r.text)
            even = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            node = leaf(r, r.text.replace("\n", "")) if even and r.text is not None else own
            for before, after in path:
                node = sha("".join([*before, node, *after]))
            proof = sha("".join(h for b, a in path for h in (*b, *a)))
            out[r.doc_id] = (own, sub, root, proof, node, node == root)
    return out


def as_dict(df):
    return {r.doc_id: (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()}


@pytest.fixture(scope="module")
def odd_docs(spark):
    own = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame(
        [(900001, None, None, "x", None), (900002, "", "en", None, 0), (900003, "a\nb", None, None, 3), (900004, "ä\n\n", "de", "", 3),
         (900005, "wörd\n" * 20_000, "de", "é", 1), (None, "no id\n", "en", "x", 5)],
        DOCS,
    )
    return own.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more)


def test_manifest_equals_brute_force(odd_docs):
    clash = odd_docs.withColumns({c: F.lit("clash") for c in ("root", "leaf", "pos", "group", "h", "n", "id", "steps")})
    got = as_dict(merkle.tamper_report(clash))
    assert got == brute_manifest(odd_docs.collect())
    verdicts = {k: v[-1] for k, v in got.items()}
    assert not all(verdicts.values()) and any(verdicts.values())
    assert merkle.tamper_report(odd_docs.limit(0)).count() == 0


def test_manifest_of_one_row_is_its_leaf(spark):
    (r,) = merkle.tamper_report(spark.createDataFrame([(7, "x", "en", "s", 1)], DOCS)).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == sha("") and r.verified


def test_manifest_over_several_rounds(spark, monkeypatch):
    """A group of three times a block squared (blocks made small), and more groups than a block."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    rows = [(i, f"t{i}\n", "en", "hot" if i % 3 else f"s{i % 90}", i) for i in range(450)]
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    assert as_dict(merkle.tamper_report(df)) == brute_manifest(df.collect())


def test_manifest_counts_repeated_rows(spark):
    rows = [(1, "a\n", "en", "s", 2)] * 3 + [(2, "b", "en", "s", 1), (2, "c", "en", "s", 1)]
    got = merkle.manifest(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 5 and len({r.root for r in got}) == 1
    assert all(merkle_root(r) == r.root for r in got)


def merkle_root(r):
    node = r.leaf
    for s in r.steps:
        node = sha(s.before + node + s.after)
    return node


# ---- 12 ---------------------------------------------------------------------------------


def brute_whitening(rows, components=4):
    ok = [(i, v) for i, v in rows if v is not None and all(e is not None and np.isfinite(e) for e in v)]
    x = np.array([[int(np.floor(256 * float(np.float32(e)))) for e in v] for _, v in ok])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    y = (x - s / n) @ q[:, :components] / np.sqrt(e[:components])
    dev = ((n * x.astype(object) - s.astype(object)) ** 2).sum(1)
    return [i for i, _ in ok], n, dev, y, e / e.sum()


def check_whitening(got, rows, components=4):
    ids, n, dev, y, share = brute_whitening(rows, components)
    assert len(got) == len(ids) * components
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    flip = {}
    for k, i in enumerate(ids):
        for c in range(components):
            r = by[i, c + 1].pop()
            assert r.n == n and r.deviation == dev[k] and r.identity_error < 1e-9
            assert abs(r.explained / share[c] - 1) < 1e-9
            flip.setdefault(c, np.sign(r.whitened * y[k, c]))
            assert abs(r.whitened - flip[c] * y[k, c]) < 1e-7 * max(1, abs(y[k, c]))


@pytest.mark.parametrize("a_task", [20_000, 60])
def test_whitening_equals_numpy(spark, a_task):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    inf, nan = float("inf"), float("nan")
    d = len(rows[0][1])
    rows += [(9001, None), (9002, [None] * d), (9003, [inf] * d), (9004, [nan] + [0.0] * (d - 1)), (9005, rows[0][1]), (9005, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("x", "n", "component", "part")})
    check_whitening(whitening.whiten(df, rows_a_task=a_task).collect(), rows)


def test_whitening_of_few_dimensions_and_no_variance(spark):
    kind = "vec_id long, embedding array<double>"
    rows = [(i, [float(i % 7), float(i % 3)]) for i in range(21)]
    got = whitening.whiten(spark.createDataFrame(rows, kind)).collect()
    check_whitening(got, rows, components=2)
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [])], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)]  # rank one: a single component
    assert {r.component for r in whitening.whiten(spark.createDataFrame(line, kind)).collect()} == {1}
    short = whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0]), (3, [5.0, 3.0])], kind)).collect()
    check_whitening(short, [(1, [1.0, 0.0]), (2, [1.0, 2.0]), (3, [5.0, 3.0])], components=2)


def test_deviation_beyond_64_bits_is_null(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.deviation for r in whitening.whiten(df).collect()}
    assert got[1] is None


def test_rank_one_updates_equal_eigh():
    rng = np.random.default_rng(3)
    for dims in (1, 2, 5, 40):
        for _ in range(8):
            kind = rng.integers(3)
            rows = [rng.normal(size=(60, dims)) * 900, rng.integers(0, 2, (60, dims)), np.eye(dims)[rng.integers(0, dims, 60)] * 50][kind]
            rows = np.floor(rows).astype(np.int64)
            a, b = whitening.Spectrum(dims), whitening.Spectrum(dims)
            a.add(rows[:40])
            b.add(rows[40:])
            a.merge(b)
            c = rows - rows.mean(0)
            v = c.T @ c
            scale = max(1.0, np.abs(v).max())
            assert np.abs(a.vectors @ np.diag(a.values) @ a.vectors.T - v).max() < 1e-9 * scale
            assert np.abs(a.vectors.T @ a.vectors - np.eye(dims)).max() < 1e-12
            assert a.n == 60 and a.sums == rows.sum(0).tolist()


def test_secular_roots_lie_between_the_poles():
    rng = np.random.default_rng(4)
    for k in (1, 2, 3, 30):
        for gap in (1.0, 1e-6):
            d = np.cumsum(rng.random(k) * gap + gap / 100)
            z2 = 10.0 ** rng.uniform(-12, 3, k)
            origin, offset = whitening.secular_roots(d, z2)
            roots = d[origin] + offset
            want = np.linalg.eigvalsh(np.diag(d) + np.outer(np.sqrt(z2), np.sqrt(z2)))
            assert np.abs(roots - want).max() <= 1e-9 * max(1, want.max())
            assert (roots >= d).all() and (roots[:-1] <= d[1:]).all()


# ---- 13 ---------------------------------------------------------------------------------


def brute_lines(rows, least_docs=5, least_chars=40):
    """rows: (doc_id, text); the contract's columns per row, in order."""
    fold = {c: c + 32 for c in range(65, 91)}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(fold)
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(i)
    keeper = {k: max(v) for k, v in holders.items() if len(v) >= least_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


def line_rows():
    rng = np.random.default_rng(6)
    shared = [f"A shared line number {i} with enough words in it to count" for i in range(12)]
    out = []
    for i in range(120):
        lines = []
        for _ in range(rng.integers(0, 30)):
            pick = rng.random()
            text = shared[rng.integers(12)] if pick < 0.4 else f"line {rng.integers(1e9)} " * 4 if pick < 0.8 else "short"
            text = text.upper() if rng.random() < 0.2 else text
            lines.append(" \t" * rng.integers(2) + text + "\r" * rng.integers(2))
        out.append((i, "\n".join(lines)))
    hot = "Every document has this line, in all its sections, for ever"
    out += [(200 + i, f"{hot}\nown text {i}\n\n{hot}\n") for i in range(150)]
    forty = "x" * 39
    out += [(400 + i, f"{forty}\n{forty}y\n ÄÖ{forty}\näö{forty}") for i in range(6)]
    out += [(500, None), (501, ""), (502, "\n\n"), (None, f"{hot}\nlost"), (None, None), (503, "wörd " * 20_000), (504, f"{hot}\n" * 3000)]
    out += [out[3], out[3], (3, "another text of document three\n" + shared[0])]
    return out


@pytest.mark.parametrize("hot_rows", [10_000, 20])
def test_line_report_equals_brute_force(spark, hot_rows):
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    clash = df.withColumns({c: F.lit("clash") for c in ("line", "key", "h1", "at", "_dropped2", "slice", "dropped")})
    got = line_dedup.line_report(clash, hot_rows=hot_rows, hot_share=16 if hot_rows == 20 else 65_536)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got.collect()), key=str) == brute_lines(rows)
    assert line_dedup.line_report(df.limit(0)).count() == 0


def test_texts_are_cut_by_bitmaps(spark):
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_dropped", F.col("doc_id") * 2)
    cut = line_dedup.drop_repeated_lines(df)
    assert cut.columns == df.columns
    got = sorted(((r.doc_id, sha(r.text or "")) for r in cut.collect()), key=str)
    assert got == sorted(((i, h) for i, _, _, h in brute_lines(rows)), key=str)
    maps = line_dedup.keep_bitmaps(df).collect()
    assert all(a.last + 1 < b.first for m in maps for a, b in zip(m.dropped, m.dropped[1:]))  # runs are joined


def test_line_dedup_has_no_python_on_its_path(spark):
    df = op13_line_dedup(spark, SF)
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "MapIn"))


# ---- registered queries -----------------------------------------------------------------


def test_registered_queries(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert as_dict(op11_merkle_manifest(spark, SF)) == brute_manifest(docs)
    lines = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in op13_line_dedup(spark, SF).collect()]
    assert sorted(lines, key=str) == brute_lines([(r.doc_id, r.text) for r in docs])
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(op12_embedding_whitening(spark, SF).collect(), vectors)
