"""URL filters: host and path rules first, then a weighted vocabulary counted by Aho-Corasick.

Contract of `judge_urls`
------------------------
* null, or no "://": host and path are empty, no rule fits, and the vocabulary decides on the url itself (null: allow).
* A term counts if no ASCII letter or digit stands directly before or after it, in either case of A-Z.
* A repeated term counts once; a page is blocked when the weights of its distinct terms reach the threshold.
* Repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Vocabulary:
    """Terms of one hit (strict) and terms that only count together (soft)."""

    strict: tuple[str, ...] = (
        "casino",
        "cheap-pills",
        "escort",
        "hardcore",
        "malware",
        "nude",
        "phishing",
        "porn",
        "pornhub",
        "spam-farm",
        "spamfarm",
        "viagra",
        "warez",
        "xxx",
    )
    soft: tuple[str, ...] = (
        "adult",
        "bet",
        "bonus",
        "cheap",
        "click",
        "crack",
        "deal",
        "farm",
        "free",
        "gambling",
        "hot",
        "jackpot",
        "loan",
        "pills",
        "poker",
        "promo",
        "sex",
        "slots",
        "spam",
        "torrent",
        "win",
    )
    strict_weight: float = 1.0
    soft_weight: float = 0.5
    threshold: float = 1.0


#: The rules of the registered query.
RULES = (
    Rule("com", "/", True),
    Rule("example.com", "/en/", False),
    Rule("www.example.com", "/en/", True),
    Rule("net", "/es/", False),
    Rule("net", "/fr/", False),
)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first "://", up to "/", "?", "#" or the end."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host, up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Text of the longest rule that fits, or null; of equally long ones the first in code-point order."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    out = F.lit(None).cast("string")
    for rule in reversed(ordered):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(rule.text)).otherwise(out)
    return out


def automaton(vocabulary: Vocabulary) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for weight, terms in ((vocabulary.soft_weight, vocabulary.soft), (vocabulary.strict_weight, vocabulary.strict)):
        for term in terms:
            found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def weighted_hits(url: str, words: ahocorasick.Automaton) -> dict[str, float]:
    """Distinct terms with boundaries on both sides, and their weights."""
    hits = {}
    for end, (term, weight) in words.iter(url):
        start = end - len(term)
        before, after = url[start : start + 1] if start >= 0 else "", url[end + 1 : end + 2]
        if not (before.isascii() and before.isalnum()) and not (after.isascii() and after.isalnum()):
            hits[term] = weight
    return hits


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """page_id, host, path, rule, verdict, n_terms and term_weight of every page; html is not read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton(vocabulary)
        for batch in batches:
            found = [weighted_hits(url, words) if url else {} for url in batch.column("_lower").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("page_id", "host", "path", "rule")],
                    pa.array([len(x) for x in found], pa.int32()),
                    pa.array([float(sum(x.values())) for x in found], pa.float64()),
                ],
                names=["page_id", "host", "path", "rule", "n_terms", "term_weight"],
            )

    url = F.col("url")
    split = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"), ascii_lower(url).alias("_lower"))
    ruled = split.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    kind = dict(pages.dtypes)["page_id"]
    counted = ruled.mapInArrow(count, f"page_id {kind}, host string, path string, rule string, n_terms int, term_weight double")
    blocked = F.col("rule").isin([r.text for r in rules if not r.allow])
    own = F.when(F.col("term_weight") >= vocabulary.threshold, "block").otherwise("allow")
    verdict = F.when(F.col("rule").isNull(), own).when(blocked, "block").otherwise("allow")
    return counted.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "n_terms", "term_weight")
