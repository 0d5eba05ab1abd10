"""Importance resampling towards a target distribution of hashed word features.

A feature is a run of one or two words; its bucket is its CRC-32 modulo `buckets`. Feature totals of the documents and of
the target texts give each bucket a gain, a document's weight is the mean gain of its features, and a document is drawn
by its weight plus Gumbel noise from its id.

Buckets come from a vocabulary of two parts. Its head is sent to every task: the CRC states of the frequent words, from
which a longer feature's CRC goes on, and the buckets of frequent pairs of them. All other features take their CRC
directly, so totals are exact whatever the head holds: it only saves time. Tasks go through all documents, keep the
counts of the most frequent words and pairs of each slice and report the most frequent of those, so the head is bounded (HEAD_WORDS words of at most HEAD_BYTES bytes,
HEAD_PAIRS pairs of numbers), and so are the totals that reach the driver (one for each bucket).
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lettermill.llm.common import checkpointed, text_batches

HEAD_WORDS, HEAD_BYTES, HEAD_PAIRS = 16_384, 64, 65_536
#: Most frequent words, and pairs, that a task reports, and keeps count of meanwhile.
REPORTED, COUNTED = 8_192, 65_536
#: Neighbouring scores that are ranked together: their totals are one row.
SCORE_STEP = 256
#: A-Z lower-cased; what is no ASCII letter or digit, nor beyond ASCII, is a blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Draw:
    """buckets of features; percent of the documents of at least min_words words that are drawn; seed of the noise."""

    buckets: int = 10_000
    min_words: int = 20
    percent: int = 25
    seed: str = "7"


def split_words(text: str) -> list[bytes]:
    return text.encode().translate(LETTERS).split()


# --- vocabulary ----------------------------------------------------------------------


class Head:
    """Numbers and CRC states of frequent words, and buckets of frequent pairs."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]], buckets: int) -> None:
        self.buckets = buckets
        self.number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        self.states = np.array([*map(zlib.crc32, self.number), 0], np.int64)  # the last is for no word
        known = {p: zlib.crc32(b" ".join(p)) % buckets for p in pairs if p[0] in self.number and p[1] in self.number}
        codes = np.array([self.number[a] * len(self.number) + self.number[b] for a, b in known], np.int64)
        order = np.argsort(codes)
        self.codes, self.pair_buckets = codes[order], np.array(list(known.values()), np.int64)[order]

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words of each text, bucket of each word, bucket of each word with the next; -1 at a text's last word)."""
        split = [split_words(t) for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        words = list(itertools.chain.from_iterable(split))
        n = len(words)
        if not n:
            return counts, np.empty(0, np.int64), np.empty(0, np.int64)
        ids = np.fromiter(map(self.number.get, words, itertools.repeat(-1)), np.int64, n)
        states = self.states[ids]
        tail = np.flatnonzero(ids < 0)
        states[tail] = np.fromiter((zlib.crc32(words[k]) for k in tail.tolist()), np.int64, len(tail))
        pairs = np.full(n, -1, np.int64)
        inside = np.ones(n, bool)
        inside[np.cumsum(counts)[counts > 0] - 1] = False
        first = np.flatnonzero(inside)
        if len(self.codes):
            code = np.where((ids[first] >= 0) & (ids[first + 1] >= 0), ids[first] * len(self.number) + ids[first + 1], -1)
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            found = self.codes[at] == code
            pairs[first[found]] = self.pair_buckets[at[found]]
            first = first[~found]
        going_on = zip(states[first].tolist(), (first + 1).tolist(), strict=True)
        pairs[first] = np.fromiter((zlib.crc32(b" " + words[k], s) for s, k in going_on), np.int64, len(first)) % self.buckets
        return counts, states % self.buckets, pairs


def _most(counts: Counter, n: int) -> Counter:
    return Counter(dict(counts.most_common(n))) if len(counts) > n else counts


def _slice_counts(texts: list[str]) -> tuple[Counter, Counter]:
    """The REPORTED most frequent words, and pairs of words, of some texts."""
    numbers: dict[bytes, int] = {}
    split = [split_words(t) for t in texts]
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for own in split for w in own), np.int64)
    inside = np.ones(len(ids), bool)
    ends = np.cumsum([len(own) for own in split if own], dtype=np.int64)
    inside[ends - 1] = False  # the last word of a text begins no pair
    words, first = list(numbers), np.flatnonzero(inside)
    counts = np.bincount(ids, minlength=len(words))
    codes, pair_counts = np.unique(ids[first] * len(words) + ids[first + 1], return_counts=True)
    most = lambda n: np.argsort(-n, kind="stable")[:REPORTED]
    found = Counter({words[k]: int(counts[k]) for k in most(counts).tolist()})
    top = most(pair_counts)
    pairs = zip((codes[top] // len(words)).tolist(), (codes[top] % len(words)).tolist(), pair_counts[top].tolist(), strict=True)
    return found, Counter({(words[a], words[b]): n for a, b, n in pairs})


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (first, second, n) of a task's most frequent words (second is null) and pairs."""
    words, pairs = Counter(), Counter()
    for batch in batches:
        for _, texts in text_batches(batch):
            more_words, more_pairs = _slice_counts(texts)
            words.update(more_words)
            pairs.update(more_pairs)
            words, pairs = (_most(c, COUNTED) if len(c) > 4 * COUNTED else c for c in (words, pairs))
    rows = [(w, None, n) for w, n in _most(words, REPORTED).items() if len(w) <= HEAD_BYTES]
    rows += [(*p, n) for p, n in _most(pairs, REPORTED).items() if max(map(len, p)) <= HEAD_BYTES]
    if rows:
        columns = zip(*rows, strict=True)
        types = (pa.binary(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["first", "second", "n"])


def vocabulary(texts: DataFrame, buckets: int) -> Head:
    """The head for these texts."""
    found = texts.select("text").mapInArrow(_frequent, "first binary, second binary, n long")
    found = checkpointed(found.groupBy("first", "second").agg(F.sum("n").alias("n")))
    words = found.where(F.col("second").isNull()).orderBy(F.desc("n"), "first").limit(HEAD_WORDS).collect()
    pairs = found.where(F.col("second").isNotNull()).orderBy(F.desc("n"), "first", "second").limit(HEAD_PAIRS).collect()
    return Head([bytes(r["first"]) for r in words], [(bytes(r["first"]), bytes(r["second"])) for r in pairs], buckets)


# --- totals and weights --------------------------------------------------------------


def bucket_totals(texts: DataFrame, head: Head) -> list[int]:
    """Features of all texts in each bucket."""
    sent = texts.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, totals = sent.value, np.zeros(sent.value.buckets, np.int64)
        for batch in batches:
            for _, some in text_batches(batch):
                _, words, pairs = own.features(some)
                totals += np.bincount(words, minlength=own.buckets) + np.bincount(pairs[pairs >= 0], minlength=own.buckets)
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(totals[used], pa.int64())], names=["bucket", "n"])

    found = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    totals = [0] * head.buckets
    for row in found.collect():
        totals[row["bucket"]] = row["n"]
    return totals


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Of each bucket: 1000 times the logarithm of how much likelier it is in the target, smoothed by one, floored."""
    all_corpus, all_target, buckets = sum(corpus), sum(target), len(corpus)
    likelier = lambda s, t: float(t + 1) * float(all_corpus + buckets) / (float(s + 1) * float(all_target + buckets))
    return [math.floor(1000 * math.log(likelier(s, t))) for s, t in zip(corpus, target, strict=True)]


def weighed(docs: DataFrame, head: Head, gain: list[int]) -> DataFrame:
    """doc_id, n_words, n_features and weight (floored mean gain, 0 without features) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast((head, np.array(gain, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, by_bucket = sent.value
        for batch in batches:
            for start, texts in text_batches(batch):
                counts, words, pairs = own.features(texts)
                each = by_bucket[words] + np.where(pairs >= 0, by_bucket[pairs], 0)
                ends = np.cumsum(counts)
                upto = np.concatenate([[0], np.cumsum(each)])
                features = np.maximum(2 * counts - 1, 0)
                weight = (upto[ends] - upto[ends - counts]) // np.maximum(features, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, len(texts)), *(pa.array(x, pa.int64()) for x in (counts, features, weight))],
                    names=["doc_id", "n_words", "n_features", "weight"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def drawn(rows: DataFrame, draw: Draw) -> DataFrame:
    """Adds rank: the place of the highest scores among rows of enough words, null beyond the share that is drawn.

    rows: doc_id, n_words, score. Scores are whole numbers within some ten thousand of zero, whatever the rows are;
    they are counted first, and only documents of one score are sorted together.
    """
    enough = F.col("n_words") >= draw.min_words
    counts = rows.where(enough).groupBy("score").agg(F.count(F.lit(1)).alias("_n"))
    counts = checkpointed(counts.withColumn("_step", F.floor(F.col("score") / SCORE_STEP)))
    above = Window.orderBy(F.desc("_step")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    steps = counts.groupBy("_step").agg(F.sum("_n").alias("_sum")).select(
        "_step", F.coalesce(F.sum("_sum").over(above), F.lit(0)).alias("_above"), F.sum("_sum").over(everything).alias("_all")
    )
    inside = Window.partitionBy("_step").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(steps, "_step").select(
        F.col("score").alias("_score"), (F.col("_above") + F.col("_inside")).alias("_before"), F.expr(f"{draw.percent} * _all div 100").alias("_last")
    )
    placed = rows.join(before, enough & (F.col("score") == F.col("_score")), "left")
    near = F.coalesce(F.col("_before") < F.col("_last"), F.lit(False))
    ties = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight")
    rank = F.col("_before") + F.row_number().over(ties)
    high = placed.where(near).withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= F.col("_last"), F.col("rank")))
    low = placed.where(~near).withColumn("rank", F.lit(None).cast("long"))
    return high.unionByName(low).drop("_score", "_before", "_last")


def resampled(docs: DataFrame, target: DataFrame, draw: Draw = Draw()) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; target: texts of the distribution to draw towards.

    Null and empty texts, and texts without a letter or digit, have no features and weight 0, and are too short to be
    drawn. Without target texts the gains only even out the buckets. Repeated rows are weighed each and tie; a null id
    has the noise of an empty one and comes last among ties. Very long texts are counted whole. An empty table gives no
    rows; other columns are ignored, whatever their names.
    """
    head = vocabulary(docs, draw.buckets)
    gain = gains(bucket_totals(docs, head), bucket_totals(target, head))
    digest = F.sha2(F.concat(F.lit(f"{draw.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = checkpointed(weighed(docs, head, gain).withColumn("score", F.col("weight") + noise.cast("long")))
    return drawn(rows, draw).select("doc_id", "n_features", "weight", "score", "rank")


def resample_sql(draw: Draw = Draw(), docs: str = "documents", target: str = "benchmark") -> str:
    """The same in DuckDB's SQL, which has no CRC-32: each distinct feature's is folded over its bytes."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
with texts as (
  select 0 as side, row_number() over () as row, doc_id, coalesce({words}, []) as w from {docs}
  union all select 1, row_number() over (), null, coalesce({words}, []) from {target}),
features as (
  select side, row, unnest(w) as f from texts
  union all
  select side, row, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from texts where len(w) > 1),
counted as (select side, row, f, count(*) as n from features group by all),
crc as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
           lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
named as (select f, hex(encode(f)) as x from (select distinct f from counted)),
hashed as (
  select f, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 1 + 2 * i, 2))::bigint)),
           lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)])), 4294967295) % {draw.buckets} as bucket
  from named, crc),
placed as (select side, row, bucket, sum(n)::bigint as n from counted join hashed using (f) group by all),
totals as (
  select b as bucket, coalesce(sum(n) filter (side = 0), 0)::bigint as s, coalesce(sum(n) filter (side = 1), 0)::bigint as t
  from range({draw.buckets}) g(b) left join placed on placed.bucket = b group by b),
gains as (
  select bucket, floor(1000 * ln((t + 1)::double * (sum(s) over () + {draw.buckets})::double
           / ((s + 1)::double * (sum(t) over () + {draw.buckets})::double)))::bigint as gain
  from totals),
weights as (
  select row, floor(sum(n * gain)::double / sum(n))::bigint as weight from placed join gains using (bucket) where side = 0 group by row),
scored as (
  select doc_id, len(w) as n_words, greatest(2 * len(w) - 1, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{draw.seed}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint::double + 0.5)
           / 4294967296.0::double))))::bigint as score
  from texts left join weights using (row) where side = 0),
ranked as (
  select *, row_number() over (partition by n_words >= {draw.min_words} order by score desc, doc_id nulls last, n_features, weight) as place,
         count(*) filter (n_words >= {draw.min_words}) over () as enough
  from scored)
select doc_id, n_features, weight, score,
       case when n_words >= {draw.min_words} and place <= {draw.percent} * enough // 100 then place end::bigint as rank
from ranked"""
