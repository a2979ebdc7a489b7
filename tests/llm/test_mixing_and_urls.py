from __future__ import annotations

import re

import duckdb
from compare import duck, rows

from stratascope.llm import mixing, queries, url_filter

SF = "/root/testdata/sf0.001"


def test_sql_agrees(spark):
    db = duck(SF)
    for name in ("op1_mix_sources", "op3_exact_top_k", "op6_url_filter"):
        assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(db.sql(queries.oracle_sql()[name]).df()), name


def test_mix_comes_near_its_targets(spark, make_docs):
    docs = make_docs([(i, "w " * (i % 7 + 1), f"s{i % 5}") for i in range(1500)])
    got = mixing.mix_plan(docs).toPandas()
    total = got["size"].sum()
    assert abs(got["taken"].sum() - total) < 0.01 * total and (got["taken"] <= 3 * got["size"]).all()
    for _, g in got.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= g["size"].max()
    again = mixing.mix_plan(docs).toPandas()
    assert rows(got) == rows(again)


def test_rows_alike_are_split(spark, make_docs):
    docs = make_docs([(1, "a b c d", "hot")] * 1000 + [(i, "a b " * (i % 3 + 1), f"s{i % 4}") for i in range(2, 300)])
    got = mixing.mix_plan(docs).toPandas()
    for _, g in got.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= g["size"].max()
    db = duckdb.connect()
    frame = docs.select("doc_id", "text", "source").toPandas()
    want = db.sql(f"WITH {mixing.MIX_SQL.format(docs='frame')} SELECT doc_id, source, size_ AS size, source_size, target, n_::BIGINT AS copies, (size_ * n_)::BIGINT AS taken FROM mixed_").df()
    assert len(frame) == len(got) and rows(got) == rows(want)
    assert sorted(r["doc_id"] for r in mixing.mixed(docs).collect()) == sorted(i for i, n in zip(got["doc_id"], got["copies"]) for _ in range(n))


def test_larger_shares_hold_smaller_ones(spark, make_docs):
    docs = make_docs([(i, "w " * 5, "one") for i in range(300)])
    small, large = ({r["doc_id"] for r in mixing.mix_plan(docs, share=s).where("taken > 0").collect()} for s in (0.3, 0.6))
    assert small < large and len(small) == 90


def test_mix_of_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    assert mixing.mixed(docs).columns == docs.columns
    got = mixing.mix_plan(docs).toPandas()
    assert len(got) == len(odd_rows) and (got["taken"] <= 3 * got["size"]).all()
    assert mixing.mix_plan(make_docs(odd_rows[:2])).where("taken > 0").count() == 0
    assert mixing.mix_plan(docs.limit(0)).count() == 0


def test_urls(spark):
    urls = [
        "http://WWW.Example.com/en/x?y", "http://example.com/en/", "http://a.example.com/de", "http://x.net/es/1", "http://x.net/de/casino/1", "http://x.org/cheap-pills", "http://x.org/cheapest-pills", "http://x.org/casinos",
        "http://com", None, "", "no scheme casino", "http://example.com:80/en/", "http://x.org/" + "a" * 200_000 + "/casino",
    ]
    got = url_filter.url_verdicts(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), queries.URL_POLICY).orderBy("page_id").collect()
    assert [r["rule"] for r in got] == ["www.example.com/en/", "example.com/en/", "com/", "net/es/"] + [None] * 10
    assert [r["verdict"] for r in got] == ["allow", "block", "allow", "block", "block", "block", "allow", "allow", "allow", "allow", "allow", "block", "allow", "block"]
    assert got[0]["host"] == "www.example.com" and got[0]["path"] == "/en/x" and got[9]["host"] == got[10]["path"] == ""


def test_vocabulary_against_regex(spark):
    import random

    rnd = random.Random(5)
    policy = url_filter.UrlPolicy(strict=("ab", "ca"), soft={"b": 1.0, "cc": 1.0, "a-b": 1.0})
    urls = ["".join(rnd.choice("abc-/.") for _ in range(rnd.randrange(12))) for _ in range(300)]
    got = url_filter.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), policy).collect()
    bounded = lambda t, u: re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", u) is not None
    for r in got:
        u = urls[r["page_id"]]
        assert r["strict_terms"] == [t for t in ("ab", "ca") if bounded(t, u)] and r["soft_terms"] == [t for t in ("a-b", "b", "cc") if bounded(t, u)]


def test_vocabulary_from_a_table_and_odd_pages(spark):
    terms = spark.createDataFrame([("Bad", "strict", None), ("meh", "soft", 0.5), ("MEH", "soft", 1.0), ("so", "soft", None), (None, "soft", 1.0), ("x", None, 1.0)], "term string, kind string, weight double")
    policy = url_filter.policy_from(terms)
    assert policy.strict == ("bad",) and policy.soft == {"meh": 1.0, "so": 1.0}
    pages = spark.createDataFrame([(1, "http://a.org/meh/so", "v", "r"), (2, "http://a.org/meh/meh", None, "r"), (3, None, "v", "r"), (1, "http://bad.org", "v", "r")], "page_id long, url string, verdict string, rule string")
    assert [r["verdict"] for r in url_filter.url_verdicts(pages, policy).orderBy("page_id", "host").collect()] == ["block", "block", "allow", "allow"]
    assert url_filter.allowed_pages(pages, policy).columns == pages.columns and url_filter.allowed_pages(pages, policy).count() == 2
    assert url_filter.url_verdicts(pages.limit(0), policy).count() == 0
