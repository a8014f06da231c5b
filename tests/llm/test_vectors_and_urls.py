import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.llm import queries, topk, url_filters


def brute_top(rows, k, every):
    out = []
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for q, a in good:
        if q % every == 0:
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True)))), i) for i, b in good if i != q and len(a) == len(b))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_whole_table_is_the_brute_force(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op2_topk(spark, small).collect())) == brute_top(rows, 5, 50)


@pytest.mark.parametrize("big", [False, True])
def test_odd_vectors(spark, big):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) * (1e30 if big else 1) for _ in range(6)]) for i in range(40)]
    rows += [(40, None), (41, []), (42, [None, 1.0, 0.0, 0.0, 0.0, 0.0]), (43, [float("nan")] * 6), (44, [float("inf")] * 6), (45, [1.0, 2.0]), (50, [3.0, 1.0]), (None, [1.0] * 6), (60, [0.5] * 6)]
    frame = spark.createDataFrame([(i, v, "s", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int")
    cut = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for block in (3, 8192):
        got = topk.top_k(frame, F.col("vec_id") % 10 == 0, k=3, block=block, query_block=2)
        assert sorted(map(tuple, got.collect())) == brute_top(cut, 3, 10)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_scores_carry_over_blocks_and_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rng.normal(size=(400, 20)).round(1))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute_top(rows, 4, 20)
    for block, group, query_block in ((16, 2, 3), (64, 64, 2048), (7, 1, 5)):
        assert sorted(map(tuple, topk.top_k(frame, F.col("vec_id") % 20 == 0, k=4, block=block, group=group, query_block=query_block).collect())) == want


def test_repeated_rows(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (1, [1.0]), (0, [2.0])], "vec_id long, embedding array<float>")
    got = topk.top_k(frame, F.col("vec_id") == 0, k=5).collect()
    assert all(r["vec_id"] == 1 for r in got) and len(got) == 4 or len(got) == 5


URLS = [None, "", "no scheme/x", "http://A.Example.NET/en/1?x#y", "https://example.net", "http://b.net?q=/en/", "http://x.org/fr/2", "http://x.org/FR/2", "http://notexample.com/de/1", "http://s.example.com/de/1", "ftp://u@net/x", "http://net/", "http://h.com//a//b", "http://h.com/" + "a/" * 40, "http://x/y://z.net/", "http://É.net/é"]


def brute_host(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = next((rest[:i] for i, c in enumerate(rest) if c in "/?#"), rest)
    tail = rest[len(host) :]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), next((tail[:i] for i, c in enumerate(tail) if c in "?#"), tail)


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_hosts_and_rules(spark):
    frame = spark.createDataFrame([(i, u, "v") for i, u in enumerate(URLS)], "page_id long, url string, verdict string")
    for r in url_filters.filter_urls(frame, queries.URL_RULES).collect():
        host, path = brute_host(URLS[r["page_id"]])
        rule, verdict = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or "allow")
    assert url_filters.filter_urls(frame.limit(0), queries.URL_RULES).count() == 0


def brute_tree(rows, depth, least, z):
    """(host, form) -> template, level by level."""
    names = {(h, tuple(f)): () for h, f, *_ in rows}
    for level in range(max(len(f) for _, f, *_ in rows)):
        sums = {}
        for h, f, n, l, b in rows:
            if level < len(f):
                own = sums.setdefault((h, names[h, tuple(f)]), {}).setdefault(f[level], [0, 0, 0])
                for k, v in enumerate((n, l, b)):
                    own[k] += v
        called = {}
        for key, branches in sums.items():
            side = {}
            for s, (_, l, b) in branches.items():
                rest = [v for t, v in branches.items() if t != s]
                ol, ob = sum(v[1] for v in rest), sum(v[2] for v in rest)
                share = (b + ob + 1) / (l + ol + 2)
                gap = b / l - ob / ol if l and ol else 0
                side[s] = 0 if not l or not ol or abs(gap) <= z * np.sqrt(share * (1 - share) * (1 / l + 1 / ol)) else 1 if gap > 0 else -1
            literal = {s for s, (n, *_) in branches.items() if n >= least and side[s]}
            own = lambda s: "%2A" + s[1:] if s.startswith("*") else s
            for s in branches:
                alike = [t for t in branches if t not in literal and side[t] == side[s]]
                called[(*key, s)] = own(s) if s in literal or len(alike) == 1 else {0: "*", 1: "*+", -1: "*-"}[side[s]]
        names |= {(h, tuple(f)): (*names[h, tuple(f)], called[h, names[h, tuple(f)], f[level]]) for h, f, *_ in rows if level < len(f)}
    return {k: "/" + "/".join(v) for k, v in names.items()}


def test_tree_is_the_brute_force(spark):
    rng = random.Random(4)
    rows = {}
    for _ in range(400):
        host = rng.choice(["a.com", "b.org"])
        form = (rng.choice(["en", "de", "spam", "x"]), *(rng.choice(["#", "list", "item", "t%"]) for _ in range(rng.randrange(0, 3))))
        n = rng.randrange(1, 9)
        labelled = rng.randrange(0, n + 1)
        old = rows.get((host, form), (0, 0, 0))
        rows[host, form] = tuple(a + b for a, b in zip(old, (n, labelled, labelled if form[0] == "spam" else rng.randrange(0, 1 + labelled // 3)), strict=True))
    listed = [(h, list(f), *v) for (h, f), v in rows.items()]
    frame = spark.createDataFrame(listed, "host string, form array<string>, n long, labelled long, bad long")
    got = {(r["host"], tuple(r["form"])): r["template"] for r in url_filters.template_tree(frame, depth=6, least=20, z=2.6).collect()}
    assert got == brute_tree(listed, 6, 20, 2.6) and any("spam" in t for t in got.values()) and any("*" in t for t in got.values())


def test_bad_templates_are_rejected(spark):
    rows = [(i, f"http://h.com/spam/{i}", 1 if i % 2 else None) for i in range(60)] + [(100 + i, f"http://h.com/news/{i}.html", 0) for i in range(60)] + [(300, "http://h.com/spam/999", None), (301, "http://h.com/news/1?x", None), (302, "http://new.com/", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, label int")
    got = {r["page_id"]: r["verdict"] for r in url_filters.filter_urls(frame, [], label_col="label").collect()}
    assert got[300] == "block" and got[301] == "allow" and got[302] == "allow" and len(got) == len(rows)


def test_pages_query(spark, small):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = queries.op1_url_filters(spark, small).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path = brute_host(pages[r["page_id"]])
        rule, verdict = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)


def templates(spark, branches):
    """The template of each branch (segment, n, labelled, bad) of one host, and of a second level for rare ones."""
    frame = spark.createDataFrame([("h", [s], n, l, b) for s, n, l, b in branches], "host string, form array<string>, n long, labelled long, bad long")
    return {r["form"][0]: r["template"] for r in url_filters.template_tree(frame, least=20, z=2.6).collect()}


def test_a_dominant_branch_is_compared_with_the_others_only(spark):
    got = templates(spark, [("big", 1000, 1000, 150), ("x", 100, 100, 0), ("y", 100, 100, 0)])
    assert got["big"] == "/big"


def test_rare_branches_merge_with_their_like(spark):
    got = templates(spark, [("bad1", 19, 19, 19), ("bad2", 10, 10, 10), *((f"g{i}", 19, 19, 0) for i in range(30)), ("*", 5, 0, 0), ("**", 5, 0, 0)])
    assert {got["bad1"], got["bad2"]} == {"/*+"} and {got[f"g{i}"] for i in range(30)} == {"/*"} and got["*"] == got["**"] == "/*"
    assert templates(spark, [("*", 5, 0, 0)]) == {"*": "/%2A"}
