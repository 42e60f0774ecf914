"""URL filter and top-k search against brute force, with edge cases."""

import fnmatch
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from incidentry.llm import topk_search, url_filter

URLS = [
    "http://www.Example.com/en/1?q#f", "https://a.www.example.com/en/", "http://example.com/en/x", "http://EXAMPLE.com/fr/", "http://notexample.com/en/", "http://x.net/es/1", "net://net/fr/", "http://my.net/es", "http://com/", "http://com?x=/", "no scheme", "", None, "://",
    "http://spam-farm.example.org/en/", "http://ads.x.org/a", "http://x.org/ads/1", "http://a.invalid/", "http://a://b/ads/", "http://ü.com/ä", "http://x.org/" + "a/" * 5000 + "ads/", "http://x.org/en/\n/ads/",
]


def judge(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = re.match(r"[^/?#]*", rest)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in cut)
        path = re.match(r"[^?#]*", rest[len(cut) :])[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[2], max(fits)[3]
    globs = [v for g, v in url_filter.GLOBS if re.fullmatch("".join(".*" if c == "*" else re.escape(c) for c in g), host + path, re.S)]
    return host, path, None, "block" if "block" in globs else globs[0] if globs else "allow"


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(None, URLS[0]), (0, URLS[0])], "page_id long, url string").withColumn("rule", F.lit(7))
    got = url_filter.judge_urls(pages).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judge(r["url"]), r
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_url_filter_keeps_rules_to_the_host(spark):
    """A host name inside a path is no host; subdomains still fit."""
    want = {"http://foo.org/mirror.net/es/x": (None, "allow"), "http://a.com/b.net/es/x": ("com/", "allow"), "http://foo.org/a.com/x": (None, "allow"), "http://a.b.net/es/x": ("net/es/", "block")}
    got = url_filter.judge_urls(spark.createDataFrame([(u,) for u in want], "url string")).collect()
    assert {r["url"]: (r["rule"], r["verdict"]) for r in got} == want
    assert all((r["host"], r["path"], r["rule"], r["verdict"]) == judge(r["url"]) for r in got)


def test_automaton_matches_globs():
    rng = np.random.default_rng(2)
    globs = ["a*b", "*", "ab", "*ab*ba*", "b*", "", "a" * 70 + "*b", "**a"]
    found = [url_filter.Pattern(g, (i,), g, "block") for i, g in enumerate(globs)]
    masks = url_filter.pack(found)
    urls = ["".join(rng.choice(list("ab"), rng.integers(0, 9))) for _ in range(300)] + ["a" * 70 + "xb", ""]
    for u, k in zip(urls, url_filter.run(masks, urls), strict=True):
        assert k == next((i for i, g in enumerate(globs) if fnmatch.fnmatchcase(u, g)), -1)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.3, (300, 8))
    data = [(i, [float(v) for v in x[i % 250]]) for i in range(300)] + [(400, None), (420, [1.0, float("nan")] * 4), (440, [None] * 8), (460, [float("inf")] * 8), (None, [0.1] * 8), (480, []), (500, [0.5, -0.5])]
    return spark.createDataFrame(data, "vec_id long, embedding array<double>")


@pytest.mark.parametrize("block", [16, 8192])
def test_top_k(spark, vectors, monkeypatch, block):
    monkeypatch.setattr(topk_search, "CANDIDATE_CELLS", block * 8)
    monkeypatch.setattr(topk_search, "QUERY_CELLS", block * 8)
    monkeypatch.setattr(topk_search, "QUERY_BATCH", 3)
    got = topk_search.top_k(vectors.withColumn("score", F.lit("x")), F.col("vec_id") % 20 == 0, 7).toPandas()
    good = {r["vec_id"]: np.pad(np.floor(64 * np.array(r["embedding"])), (0, 8 - len(r["embedding"]))).astype(int) for r in vectors.collect() if r["vec_id"] is not None and r["embedding"] is not None and all(v is not None and np.isfinite(v) for v in r["embedding"])}
    want = []
    for q, v in good.items():
        if q % 20 == 0:
            best = sorted((-int(v @ w), i) for i, w in good.items() if i != q)[:7]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got[["query_id", "rank", "vec_id", "score"]].astype(int).values.tolist())) == sorted(want)


def test_top_k_edges(spark, vectors):
    few = vectors.where("vec_id < 3")
    got = topk_search.top_k(few.union(few.where("vec_id = 0")), F.col("vec_id") == 0)
    # Row 0 twice: each of them meets its twin, 1 and 2.
    assert got.count() == 6 and sorted(r["vec_id"] for r in got.collect()) == [0, 0, 1, 1, 2, 2]
    assert topk_search.top_k(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert topk_search.top_k(vectors, F.lit(None).cast("boolean")).count() == 0


def test_repeated_query_rows(spark, duck):
    """Rows that share an id are queries each, with their own vectors; the SQL agrees."""
    data = spark.createDataFrame([(20, [1.0, 2.0]), (20, [-3.0, 0.5]), (20, [-3.0, 0.5]), (7, [2.0, 2.0]), (40, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = topk_search.top_k(data, F.col("vec_id") % 20 == 0)
    assert got.count() == 16 and rows(got.toPandas()) == rows(duck(topk_search.OP8_SQL, embeddings=data.toArrow()))
    two = data.where("vec_id <> 40 and embedding[0] > -3 or vec_id = 7").union(data.where("vec_id = 40").selectExpr("20L", "embedding"))
    assert topk_search.top_k(two, F.col("vec_id") % 20 == 0).count() == 4


def test_long_vector(spark):
    """A vector of another length is a block of its own and counts as filled up with zeros."""
    data = [(i, [float(i), 1.0]) for i in range(1, 9)] + [(20, [0.0] * 5000 + [3.0]), (40, [2.0] * 300), (60, [])]
    got = topk_search.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 3).toPandas()
    assert got[got.query_id == 40].vec_id.tolist() == [8, 7, 6] and got[got.query_id == 40].score.tolist() == [18 * 64**2, 16 * 64**2, 14 * 64**2]
    assert got[got.query_id == 20].score.tolist() == [0, 0, 0] and got[got.query_id == 60].vec_id.tolist() == [1, 2, 3]


def test_bounds_hold():
    rng = np.random.default_rng(1)
    q, x = rng.integers(-30, 30, (5, 6)).astype(float), rng.integers(-30, 30, (40, 6)).astype(float)
    reader, exact = topk_search.Reader(q, x, topk_search.sorted_lists(x)), q @ x.T
    for depth in (1, 7, 25, 40):
        reader.read(depth)
        assert (reader.lower() <= exact).all() and (exact <= reader.upper()).all()
    assert (reader.lower() == exact).all() and (reader.upper() == exact).all() and (reader.sums == exact).all()


def test_search_large_numbers():
    """Products beyond 24 and 53 bits stay exact; a score to beat keeps its ties."""
    for scale in (10**4, 10**8):
        q, x = np.array([[scale, -scale, 1]]), np.array([[scale, scale - 1, 0], [scale, scale, 0], [0, -1, 3]])
        search = lambda beat: topk_search.search_block(np.array([9]), q, np.array([beat]), np.array([1, 2, 3]), np.array([1, 2, 3]), x, topk_search.sorted_lists(x), 3)[1:]  # noqa: E731, B023
        want = sorted((-int(v), i) for i, v in enumerate((q @ x.T)[0]))
        j, s = search(topk_search.LEAST)
        assert list(zip(-s, j, strict=True)) == want
        j, s = search(-want[1][0])
        assert set(want[:2]) <= set(zip(-s, j, strict=True))


def test_reading_stops_early(monkeypatch):
    """With a score to beat, outsiders fall before the lists are read to their ends."""
    depths = []
    read = topk_search.Reader.read
    monkeypatch.setattr(topk_search.Reader, "read", lambda self, depth: (depths.append(depth), read(self, depth))[1])
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (800, 4))
    q = np.array([[60, 1, -1, 1]])
    best = int(np.sort((x @ q[0]))[-5])
    topk_search.search_block(np.array([-1]), q, np.array([best]), np.arange(800), np.arange(800), x, topk_search.sorted_lists(x), 5)
    assert max(depths) < 800


def test_rows_helper():
    import pandas as pd

    assert rows(pd.DataFrame({"a": [1, None]})) == ["(1,)", "(None,)"]
