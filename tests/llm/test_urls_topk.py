import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from meadowlark.llm import queries, topk, urls
from pyspark.sql import functions as F


def brute_url(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    if not fits:
        return host, path, None, default
    h, p, v = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2]))
    return host, path, h + p, v


def test_urls_against_plain_rules(spark):
    rng = random.Random(7)
    rules = [*queries.RULES, ("a.example.net", "/en/x", "block"), ("example.net", "/en/x/y/", "allow"), ("example.org", "/deep", "block"), ("co.uk", "", "block"), ("net", "/en", "allow")]
    made = [
        "".join([rng.choice(["http", "https", ""]), rng.choice(["://", "://", ":/"]), rng.choice(["a.", "A.B.", "", "www."]), rng.choice(["example.net", "Example.ORG", "x.co.uk", "net", "xnet", "example.com"]),
                 rng.choice(["", ":80", ""]), rng.choice(["", "/", "/en/", "/en/x/y/z", "/EN/", "/de/1", "/fr/?q=/en/", "/deeper/1", "//en/", "/en"]), rng.choice(["", "?a=b", "#x/y"])])
        for _ in range(600)
    ] + [None, "", "://", "http://", "http://É.net/en/", "http://" + "a." * 300 + "net/" + "b/" * 400]
    df = spark.createDataFrame(list(enumerate(made)) + [(0, made[0])], "page_id long, url string").withColumn("verdict", F.lit(1)).withColumn("prefix", F.lit(2))
    got = urls.judge_urls(df, spark.createDataFrame([*rules, (None, "/", "block"), ("net", "/", "maybe")], "host string, path string, verdict string"))
    rows = got.collect()
    assert len(rows) == len(made) + 1 and all((r.host, r.path, r.rule, r.verdict) == brute_url(made[r.page_id], rules) for r in rows)
    clash = df.drop("verdict")
    for name in "best __host __path key_0 suffix full rule_host a.b".split():
        clash = clash.withColumn(name, F.lit("own"))
    again = urls.judge_urls(clash, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert again.columns == [*clash.columns, "host", "path", "rule", "verdict"] and again.where("best = 'own' AND __host = 'own' AND `a.b` = 'own'").count() == len(rows)
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert urls.judge_urls(df, none, "block").where("verdict = 'block' AND rule IS NULL").count() == len(rows)
    assert urls.judge_urls(df.limit(0), none).count() == 0


def brute_top(rows, asks, k):
    out = set()
    for q, v in rows:
        if q is None or v is None or not asks(q):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i is not None and w is not None and i != q and len(w) == len(v))
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)}
    return out


@given(st.integers(0, 10_000))
@settings(max_examples=6, deadline=None)
def test_top_k_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(k, [rng.choice([rng.randrange(-300, 300), rng.randrange(-3, 3)]) for _ in range(8)]) for k in range(rng.choice([3, 60, 300]))]
    rows += [(1000 + k, list(rows[0][1])) for k in range(30)] + [(None, [1] * 8), (2001, None), (2002, [5] * 3), (2003, [7] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").withColumn("dim", F.lit("x"))
    topk_block, topk_chunk = topk.BLOCK, topk.CHUNK
    try:
        topk.BLOCK, topk.CHUNK = 40, 7
        got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 3 == 0, 4).collect()}
    finally:
        topk.BLOCK, topk.CHUNK = topk_block, topk_chunk
    assert got == brute_top(rows, lambda q: q % 3 == 0, 4)


def test_top_k_edges(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, vector array<long>"), F.lit(True)).count() == 0
    df = spark.createDataFrame([(0, [0.5, -0.001]), (50, [float("nan"), 1.0]), (100, [None, 1.0]), (150, None), (200, []), (7, [1.0, 1.0]), (7, [1.0, 1.0])], "vec_id long, e array<float>")
    got = topk.top_k(df.select("vec_id", topk.scaled(F.col("e")).alias("vector")), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(0, 7, 128 * 256 - 256), (0, 7, 128 * 256 - 256)]


def test_index_stops_only_on_proof():
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.integers(-90, 90, (4000, 64))
    index = topk.Index(np.arange(4000), v)
    for q in range(0, 4000, 400):
        s = v @ v[q]
        want = sorted((-int(x), i) for i, x in enumerate(s) if i != q)[:5]
        assert index.search(v[q], q, 5) == [(i, -x) for x, i in want]
