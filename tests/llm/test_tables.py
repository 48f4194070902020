"""Embeddings, urls and the pipeline against brute force."""

import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import cases as C  # noqa: E402

from panelspark.llm import embeddings, urlrules  # noqa: E402


# --- 2: embeddings

def vectors(seed=0):
    pick = np.random.default_rng(seed)
    rows = [(i, pick.normal(size=16)) for i in range(120)]
    for i in range(120, 200):  # near the threshold, above and below
        base = rows[int(pick.integers(0, 40))][1]
        rows.append((i, base + pick.normal(size=16) * pick.choice([0.05, 0.1, 0.12, 0.15])))
    rows += [(300 + i, rows[5][1]) for i in range(40)]
    rows += [(400, rows[5][1] * 3.0), (401, rows[7][1] * 1e-200), (402, rows[8][1] * 1e200), (None, rows[9][1]),
             (None, rows[5][1]), (11, rows[11][1]), (11, rows[3][1])]
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    return rows + [(500, None), (501, []), (502, [0.0] * 16), (503, [None] + [1.0] * 15), (504, [float("nan")] * 16),
                   (505, [float("inf")] + [0.0] * 15), (506, [1.0, 2.0]), (507, [1.0, 2.0]), (None, None),
                   (508, [-0.0] + [1.0] * 15), (509, [0.0] + [1.0] * 15)]


def brute(rows):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    near = np.zeros((len(rows), len(rows)), bool)
    unit = [np.array(v) / max(map(abs, v)) if o else None for (_, v), o in zip(rows, ok)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j and ok[i] and ok[j] and len(unit[i]) == len(unit[j]):
                near[i, j] = unit[i] @ unit[j] >= embeddings.THRESHOLD
    found = C.components(near, [i for i, _ in rows])
    return sorted(((i, int(n), c if o else i) for (i, _), n, c, o in zip(rows, near.sum(axis=1), found, ok)), key=repr)


@pytest.mark.parametrize("block", [2048, 7])
def test_embedding_links_equal_brute_force(spark, block):
    rows = vectors()
    df = spark.createDataFrame([(i, v, "x") for i, v in rows],
                               "vec_id long, embedding array<double>, digest string").repartition(6)
    out = embeddings.near_duplicates(df, block=block)
    got, want = C.rows_of(out, "vec_id", "n_links", "component_id"), brute(rows)
    links = sum(w[1] for w in want)
    assert sum(g[1] for g in got) >= 0.99 * links and all(g[1] <= w[1] for g, w in zip(got, want))
    assert np.mean([g == w for g, w in zip(got, want)]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.collect() if r.vec_id is not None)


def test_embedding_recall_at_the_threshold():
    pick = np.random.default_rng(1)
    for n, d in ((50_000, 64), (10_000_000, 64), (1_000_000, 128)):
        tables, depth = embeddings.shape(n, d)
        x = pick.normal(size=(800, d))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z = pick.normal(size=(800, d))
        z -= (z * x).sum(1, keepdims=True) * x
        y = 0.9 * x + np.sqrt(0.19) * z / np.linalg.norm(z, axis=1, keepdims=True)
        a, b = (embeddings.bucket_keys(v, tables, depth) for v in (x, y))
        assert (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3)).mean() > 0.98


def test_embedding_recall_holds_for_deep_hashes_and_many_dimensions():
    pick = np.random.default_rng(3)
    for n, d, pairs in ((10_000_000, 128, 1600), (1_000_000, 512, 800), (10, 1, 8)):
        tables, depth = embeddings.shape(n, d)
        x, z = pick.normal(size=(2, pairs, d))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(1, keepdims=True) * x
        y = 0.9 * x + np.sqrt(0.19) * z / np.linalg.norm(z, axis=1, keepdims=True) if d > 1 else x
        a, b = (embeddings.bucket_keys(v, tables, depth) for v in (x, y))
        met = (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3)).mean()
        print(n, d, tables, depth, met)
        assert met >= 0.99


def test_embedding_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    unit = np.array([v for _, v in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df).collect()}
    found = np.array([got[i] for i, _ in rows])
    assert (found <= near.sum(axis=1)).all() and found.sum() >= 0.99 * near.sum()


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(empty).collect() == []


# --- 10: urls

URLS = ["https://www.example.com/en/1", "http://Example.COM/en/2?x#y", "https://a.b.example.com/de/3", "example.com/en/",
        "https://example.com", "https://com/x", "ftp://x.net/es/1", "http://net/fr/", "http://x.net/frx", None, "", "://",
        "https://www.example.com/e", "http://notexample.com/en/", "http://example.com./en/", "http://a..com/en",
        "http://ex-ample.com/en/", "http://exa.mple.com:80/en/", "//www.example.com/en/", "x://y?://com/", "h://com?a/",
        "http://WWW.EXAMPLE.COM/EN/", "http://x.org/", "http://é.net/es/ü", "a://com/x\ny://net/fr/"]
MORE = [("org", "/", "block"), ("x.org", "/a/", "allow"), ("a.x.org", "/", "block"), ("org", "/a/b/", "block"),
        ("ex-ample.org", "/", "allow"), ("x.org", "/", "allow"), (None, "/", "block"), ("x.org", None, "block")]


def judge(url, rules, default="allow"):
    url = url or ""
    at = url.find("://")
    rest = url[at + 3:] if at >= 0 else ""
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = C.lower(rest[:end]), rest[end:]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h), len(p), v == "block", h + p, v) for h, p, v in rules
            if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else default


@pytest.mark.parametrize("per_range", [200_000, 20])
def test_urls_equal_brute_force(spark, per_range):
    pick = np.random.default_rng(0)
    hosts = ["x.org", "a.x.org", "b.a.x.org", "org", "ex-ample.org", "x.net", "www.example.com", "hot.example.com"]
    made = [f"http://{pick.choice(hosts)}/{pick.choice(['a/', 'a/b/', 'en/', 'es/', ''])}{pick.integers(0, 30)}"
            for _ in range(900)] + ["https://hot.example.com/en/7"] * 500
    rules = [*urlrules.RULES, *MORE]
    rows = [(None if i == 7 else i, u, "allow") for i, u in enumerate([*URLS, *made])]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string").repartition(6)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = C.rows_of(urlrules.judge_urls(pages, table, rows_per_range=per_range),
                    "page_id", "host", "path", "rule", "verdict")
    assert got == sorted(((i, *judge(u, rules)) for i, u, _ in rows), key=repr)


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, URLS[0])], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [r.verdict for r in urlrules.judge_urls(pages, none).collect()] == ["allow"]
    assert urlrules.judge_urls(pages.limit(0), none).collect() == []


# --- pipeline

def test_pipeline_stages_on_edge_cases(spark, tmp_path):
    import corpus_pipeline as P

    labels = spark.createDataFrame([(16, 1, 0), (22, 1, 0), (23, 0, 0), (None, 1, 0), (24, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (None, []):
        docs = C.documents(spark, rows, extra=True)
        docs = docs.selectExpr("*", "cast(length(text) as bigint) as n_chars")
        for k, (name, stage) in enumerate(P.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if k < len(P.STAGES) - 1:
                assert out.columns == docs.columns, name
            path = str(tmp_path / f"{name}{rows is None}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        assert {"doc_id", "sequence_id", "offset"} <= set(docs.columns)
        assert (docs.count() > 20) == (rows is None)


def test_pipeline_runs_and_matches_its_parts(spark):
    """The rows of run() against brute-force versions of the later stages on what the first kept."""
    import corpus_pipeline as P
    from test_texts import brute_units

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    first = P.quality_rules(spark, docs, d).select("doc_id", "text").collect()
    prints = np.array([C.fingerprint(r.text) for r in first], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= 3
    root = C.components(near, [r.doc_id for r in first])
    kept = brute_units([(r.doc_id, r.text) for r, c in zip(first, root) if r.doc_id == c])
    from tokenizers import Tokenizer
    from panelspark.llm.tokens import vocabulary_path

    library = Tokenizer.from_file(vocabulary_path())
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept}
    got: dict = {}
    for r in P.run(spark, d).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
