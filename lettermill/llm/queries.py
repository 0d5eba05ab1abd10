"""Registered queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm import (
    ann, bpe, fingerprint, langid, mixing, periodic, quality, resample, secrets, setjoin, simhash, tokencount, urlfilter,
)
from lettermill.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_neighbours(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op2_language(spark, sf_dir):
    return langid.languages(table(spark, sf_dir, "documents"))


@query
def op3_fingerprint(spark, sf_dir):
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


@query
def op4_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@query
def op5_token_counts(spark, sf_dir):
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


@query
def op6_mixing(spark, sf_dir):
    found = mixing.mixed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


SQL["op6_mixing"] = mixing.mix_sql()


@query
def op7_secrets(spark, sf_dir):
    # A source is an owner; its texts in one language are a repository.
    docs = table(spark, sf_dir, "documents")
    return secrets.secret_spans(docs, F.col("source"), F.struct("source", "lang"))


@query
def op8_bpe(spark, sf_dir):
    return bpe.encoded(table(spark, sf_dir, "documents"), with_ids=False)


@query
def op9_quality(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_url_filter(spark, sf_dir):
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


def _url_sql() -> str:
    """The rules and the vocabulary in DuckDB's dialect."""
    vocabulary, quoted = urlfilter.Vocabulary(), lambda text: "'" + text.replace("'", "''") + "'"
    rules = sorted(urlfilter.RULES, key=lambda r: (-len(r.text), r.text))
    fits = " ".join(
        f"when (host = {quoted(r.host)} or ends_with(host, {quoted('.' + r.host)})) and starts_with(path, {quoted(r.path)}) then {quoted(r.text)}"
        for r in rules
    )
    # A term is looked for between two characters that are no letters or digits.
    seen = lambda term: f"regexp_matches(u, '(^|[^a-z0-9]){term}($|[^a-z0-9])')::int"
    terms = [(t, vocabulary.strict_weight) for t in vocabulary.strict] + [(t, vocabulary.soft_weight) for t in vocabulary.soft]
    blocked = ", ".join(quoted(r.text) for r in rules if not r.allow)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with parts as (
  select page_id, {lower.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path, {lower.format("coalesce(url, '')")} as u
  from pages),
ruled as (select *, case {fits} end as rule,
         {" + ".join(seen(t) for t, _ in terms)} as n_terms,
         {" + ".join(f"{w} * {seen(t)}" for t, w in terms)} as term_weight
  from parts)
select page_id, host, path, rule,
       case when rule is null then (case when term_weight >= {vocabulary.threshold} then 'block' else 'allow' end)
            when rule in ({blocked}) then 'block' else 'allow' end as verdict,
       n_terms::int as n_terms, term_weight::double as term_weight
from ruled"""


SQL["op10_url_filter"] = _url_sql()


@query
def op11_runs(spark, sf_dir):
    return periodic.run_digests(periodic.periodic_runs(table(spark, sf_dir, "documents"), periodic.planted))


@query
def op12_set_join(spark, sf_dir):
    return setjoin.near_duplicates(table(spark, sf_dir, "documents"))


SQL["op12_set_join"] = setjoin.join_sql()


@query
def op13_resample(spark, sf_dir):
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op13_resample"] = resample.resample_sql()
