"""Keyword counts for thousands of phrases in one pass over the letters.

`profile.keyword_counts` adds an expression and three aggregates for each phrase, which suits a few dozen. Here a task goes
through a text once with an Aho-Corasick automaton of all phrases, whatever their number, and gives one row for each
phrase that its letters hold, so the shuffle has at most a row for each phrase and task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.functions import text

# The functions run in tasks travel with the query: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters of all phrases together that are sent to every task.
MOST_CHARS = 1 << 25


def _automaton(phrases: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for i, phrase in enumerate(phrases):
        found.add_word(phrase, i)
    found.make_automaton()
    return found


def _counts(shared):
    """A mapInArrow function over (class, folded): letters that hold each phrase, in all and of each class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        automaton, totals = _automaton(phrases), np.zeros((3, len(phrases)), np.int64)
        for batch in batches:
            for label, letter in zip(batch.column("class").to_pylist(), batch.column("folded"), strict=True):
                held = list({i for _, i in automaton.iter(letter.as_py())})
                totals[0, held] += 1
                if label in (0, 1):
                    totals[1 + label, held] += 1
        seen = np.flatnonzero(totals[0])
        columns = [pa.array([phrases[i] for i in seen.tolist()], pa.string()), *(pa.array(t[seen], pa.int64()) for t in totals)]
        yield pa.RecordBatch.from_arrays(columns, names=["folded", "n", "zero", "one"])

    return count


def keyword_counts(letters: DataFrame, phrases: DataFrame) -> DataFrame:
    """Letters per phrase: keyword, list_class, count, class_0_count and class_1_count, as `profile.keyword_counts` gives.

    phrases: keyword and list_class. Phrases that differ in case only count alike; a repeated row is given once; null
    phrases are left out, and an empty one is in every text. The phrases are sent to all tasks, MOST_CHARS characters of
    them at most; a longer list must be counted in parts.
    """
    listed = phrases.where(F.col("keyword").isNotNull()).select("keyword", "list_class", text.fold_case(F.col("keyword")).alias("_folded")).distinct()
    size = listed.agg(F.sum(F.char_length("_folded"))).first()[0] or 0
    if size > MOST_CHARS:
        raise ValueError(f"the phrases have {size} characters, over {MOST_CHARS}")
    wanted = [r["_folded"] for r in listed.where("_folded <> ''").select("_folded").distinct().collect()]
    label = F.col("class").cast("int") if "class" in letters.columns else F.lit(None).cast("int")
    folded = letters.select(label.alias("class"), text.fold_case(F.col("text_cleaned")).alias("folded")).where(F.col("folded").isNotNull())
    every = folded.agg(*[F.count_if(c).alias(n) for n, c in (("n", F.lit(True)), ("zero", F.col("class") == 0), ("one", F.col("class") == 1))])
    counts = every.select(F.lit("").alias("folded"), "n", "zero", "one")
    if wanted:
        shared = letters.sparkSession.sparkContext.broadcast(sorted(wanted))
        found = folded.mapInArrow(_counts(shared), "folded string, n bigint, zero bigint, one bigint")
        found = found.groupBy("folded").agg(*[F.sum(c).alias(c) for c in ("n", "zero", "one")])
        counts = found if len(wanted) == listed.select("_folded").distinct().count() else counts.unionByName(found)
    joined = listed.join(counts, F.col("_folded") == F.col("folded"), "left")
    number = lambda c, name: F.coalesce(F.col(c), F.lit(0)).alias(name)
    return joined.select("keyword", "list_class", number("n", "count"), number("zero", "class_0_count"), number("one", "class_1_count"))
