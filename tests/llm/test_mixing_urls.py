import math

import pytest

from tallyloom.llm import mixing, urlfilter


def test_mix_reaches_target_shares_and_repeats_whole_rows(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('x', 50) AS text", "CASE WHEN id % 3 = 0 THEN 'src0' WHEN id % 3 = 1 THEN 'src1' ELSE 'other' END AS source", "id AS u")
    mixed = mixing.mix(docs, {"src0": 0.6, "src1": 0.1, "*": 0.3}).cache()
    counts = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    total = sum(counts.values())
    for source, share in (("src0", 0.6), ("src1", 0.1), ("other", 0.3)):
        assert abs(counts[source] / total - share) < 0.03
    assert mixed.where("copy > copies").count() == 0
    assert mixed.groupBy("doc_id").agg({"copies": "max", "copy": "count"}).where("`max(copies)` <> `count(copy)`").count() == 0
    keys = [r["mix_key"] for r in mixed.select("mix_key").collect()]
    assert keys == sorted(keys) and "u" in mixed.columns


def test_mix_edges(spark):
    docs = spark.createDataFrame([(1, None, None, 5), (None, "a", "src0", 6), (1, None, None, 5)], "doc_id long, text string, source string, copies long")
    assert mixing.mix(docs).columns == ["doc_id", "text", "source", "copy", "copies", "mix_key"]
    assert mixing.mix(docs.limit(0)).count() == 0
    ties = spark.range(300).selectExpr("CAST(NULL AS LONG) AS doc_id", "'same' AS text", "'src0' AS source", "id AS cdf", "id AS draws")
    mixed = mixing.mix(ties, {"src0": 1.0}, epochs=3.0)
    each = mixed.groupBy("cdf").count().agg({"count": "min"}).first()[0]
    assert mixed.count() in (0, 300 * each) and mixed.columns == ["doc_id", "text", "source", "cdf", "draws", "copy", "copies", "mix_key"]


def test_large_rates_are_drawn_in_parts(spark):
    """A small source gets a huge rate: a Poisson count still, as many draws of small means."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "IF(id < 40, 'x', repeat('y', 50)) AS text", "IF(id < 40, 'src0', 'other') AS source")
    mean = mixing.rates(docs, {"src0": 0.2, "*": 0.8})
    assert mean["src0"] > 700
    copies = [r["copies"] for r in mixing.mix(docs, {"src0": 0.2, "*": 0.8}).where("source = 'src0' AND copy = 1").collect()]
    assert len(copies) == 40 and len(set(copies)) > 20
    assert abs(sum(copies) / 40 - mean["src0"]) < 5 * math.sqrt(mean["src0"] / 40)
    assert 0.3 < sum((c - mean["src0"]) ** 2 for c in copies) / 40 / mean["src0"] < 3


def test_weight_of_an_absent_source_is_shared_out(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "repeat('x', 50) AS text", "'other' AS source")
    assert mixing.rates(docs, mixing.TARGETS) == {**{s: 0.0 for s in mixing.TARGETS}, "*": 1.0}
    assert abs(mixing.mix(docs).count() / 2000 - 1) < 0.1


@pytest.mark.parametrize("mean", [0, 0.01, 1.0, 7.3, 16.0])
def test_poisson_cdf(mean):
    cdf = mixing.poisson_cdf(mean)
    assert cdf == sorted(cdf) and cdf[-1] > 1 - 1e-12 and math.isclose(cdf[0], math.exp(-mean), rel_tol=1e-9)
    assert math.isclose(sum(1 - c for c in cdf), mean, rel_tol=1e-6, abs_tol=1e-9)


def test_urls_equal_brute_force(spark):
    hosts = ["example.com", "www.example.com", "a.www.example.com", "notexample.com", "com", "x.net", "net", "xnet", "org.net.", "", "example.com:80", "EXAMPLE.com", "exämple.net"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/", "/en", "/es/a?x=/fr/", "/fr/#y", "?q", "/EN/")] + [None, "", "no scheme", "a://b://example.com/en/", "://net/es/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r["page_id"]: r for r in urlfilter.judge(pages).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fits = [(len(h), len(p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        r = got[i]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best[2] if best else None, best[3] if best else urlfilter.DEFAULT), u
    assert urlfilter.judge(pages.limit(0)).count() == 0


def test_nested_rules_of_any_number(spark):
    rules = [("block", "a.b", "/"), ("allow", "x.a.b", "/"), ("block", "y.x.a.b", "/p"), ("allow", "b", "/"), ("block", "zb", "/")]
    pages = spark.createDataFrame([(i, f"s://{h}/p") for i, h in enumerate(["b", "a.b", "x.a.b", "y.x.a.b", "q.y.x.a.b", "zb", "q.zb", "c"])], "page_id long, url string")
    got = [r["rule"] for r in urlfilter.judge(pages, rules).orderBy("page_id").collect()]
    assert got == ["b/", "a.b/", "x.a.b/", "y.x.a.b/p", "y.x.a.b/p", "zb/", "zb/", None]
