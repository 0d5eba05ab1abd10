"""URL filters, and the pipeline as a whole."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lettermill.llm import urlfilter
from lettermill.llm.queries import QUERIES, SQL
from tests.llm.helpers import AWKWARD, awkward

URLS = {
    "http://a.com/x": ("a.com", "/x", "com/", "allow"),
    "http://a.com": ("a.com", "", None, "allow"),
    "HTTPS://WWW.Example.com/en/1?q#f": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
    "x://b.example.com/en/?x": ("b.example.com", "/en/", "example.com/en/", "block"),
    "x://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"),
    "http://a.net/es/casino#x": ("a.net", "/es/casino", "net/es/", "block"),
    "http://net/fr/": ("net", "/fr/", "net/fr/", "block"),
    "http://casino.org/": ("casino.org", "/", None, "block"),
    "http://casinos.org/": ("casinos.org", "/", None, "allow"),
    "http://a.org/free/free-free": ("a.org", "/free/free-free", None, "allow"),
    "http://a.org/free?win=1": ("a.org", "/free", None, "block"),
    "http://cheap-pills.org": ("cheap-pills.org", "", None, "block"),
    "casino/free": ("", "", None, "block"),
    "http://É.org/Ñ?a#b": ("É.org", "/Ñ", None, "allow"),
    "a://b://c/d": ("b:", "//c/d", None, "allow"),
    "http://a.org\n/x y": ("a.org\n", "/x y", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
}


def test_urls(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)] + [(None, "http://xxx.org/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "rule": F.lit(2), "_lower": F.lit(3)})
    found = urlfilter.judge_urls(df).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.page_id is not None:
            assert (r.host, r.path, r.rule, r.verdict) == list(URLS.values())[r.page_id], list(URLS)[r.page_id]
    assert [r.verdict for r in found if r.page_id is None] == ["block"]
    assert urlfilter.judge_urls(df.limit(0)).count() == 0


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_take_awkward_rows_and_empty_tables(spark, tmp_path, name, stage):
    spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = awkward(spark)
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert out.count() <= 3 * len(AWKWARD)
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_over_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    encoded = corpus_pipeline.run(spark, SF).collect()
    ids = {r.doc_id for r in encoded}
    assert 0.5 * docs.count() < len(ids) < docs.count()
    assert all(r.n_tokens == len(r.ids) for r in encoded)
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = [texts[i] for i in ids]
    assert len(set(kept)) == len(kept)
