"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

Each source has a target in words. A document's expected copies are its weight times its source's rate, at most
`max_copies`. The whole part is taken for certain; the fraction is its inclusion probability p in a sample of fixed
size (in words) that Pareto order sampling draws: documents are ranked by (u / (1 - u)) / (p / (1 - p)), where u is a
random number from the document's id, and the ranking is cut where the words come nearest to what the target lacks.

A source may hold any share of the rows: ranks are counted in `RANK_RANGES` ranges of the order first, so only the
documents of the one range that holds the cut are sorted. The per-source table has a row for each source; only it is
gathered in one place.

Null and empty texts have size 0 and are never taken; a null source is a source of its own, the last in order; repeated
rows are drawn each and tie harmlessly; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.llm.common import WORD, checkpointed

RANK_RANGES = 4_096
#: Rows of a per-source table that are sent to every task.
SENT_SOURCES = 20_000


@dataclass(frozen=True)
class Mix:
    """weights: of the sources in code-point order, repeating; share: of all words that the mix takes."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.0
    max_copies: int = 3
    seed: str = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str) -> Column:
    """A number between 0 and 1 from the id: 52 bits of its md5 with the seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """_source, source_size, target of every source.

    A target is min(max_copies * size, level * weight) with the one level at which all targets together have the
    share of the words: what resharing the excess until no source is above its bound comes to. In the order of
    bound / weight, the sources before the first that the level leaves free are those at their bound.
    """
    every = Window.partitionBy()
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())))
    weights = F.array(*[F.lit(w) for w in mix.weights])
    weighed = ranked.withColumn("_weight", F.element_at(weights, ((F.col("_rank") - 1) % len(mix.weights) + 1).cast("int")))
    bound = F.col("source_size") * mix.max_copies
    order = Window.orderBy("_ratio", "_rank")
    before, onwards = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    levels = weighed.withColumn("_ratio", bound / F.col("_weight")).withColumns(
        {
            "_total": F.sum("source_size").over(every) * mix.share,
            "_bounded": F.coalesce(F.sum(bound).over(before), F.lit(0)),
            "_weights": F.sum("_weight").over(onwards),
        }
    )
    levels = levels.withColumn("_level", (F.col("_total") - F.col("_bounded")) / F.col("_weights"))
    level = F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_rank", "_level"))).over(every)
    target = F.least(bound.cast("double"), F.col("_weight") * F.coalesce(level["_level"], F.lit(float("inf"))))
    return levels.select("_source", "source_size", target.alias("target"))


def mixed(docs: DataFrame, mix: Mix = Mix(), weight: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every document.

    weight: a positive number that a document's chance is in proportion to within its source (default: all alike).
    Where a weighted document would need more than max_copies, its source falls short by the rest.
    """
    own = F.lit(1.0) if weight is None else weight.cast("double")
    sized = docs.select("doc_id", F.col("source").alias("_source"), word_count(F.col("text")).alias("size"), own.alias("_w"))
    sized = checkpointed(sized)
    chosen = _cut(_ranked(sized, _rates(sized, mix), mix))
    copies = (F.col("_whole") + F.col("_chosen")).cast("int")
    return chosen.select("doc_id", F.col("_source").alias("source"), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixture(docs: DataFrame, mix: Mix = Mix(), weight: Column | None = None) -> DataFrame:
    """The documents with all their columns, each as often as the mix takes it.

    What the mix has decided is a row for each source (its rate, and the last of its order that is in), so the texts
    are not shuffled. Rows that tie with that last one are in too.
    """
    own = F.lit(1.0) if weight is None else weight.cast("double")
    narrow = [F.col("source").alias("_source"), word_count(F.col("text")).alias("size"), own.alias("_w")]
    sized = checkpointed(docs.select("doc_id", *narrow))
    rates = _rates(sized, mix)
    chosen = _cut(_ranked(sized, rates, mix)).where((F.col("_chosen") == 1) & F.col("_order").isNotNull())
    last = chosen.groupBy("_source").agg(F.max(F.struct("_order", "doc_id", "size")).alias("_last"))
    decided = checkpointed(_by_source(rates, last))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["doc_id"].alias("doc_id"), *narrow)
    ranked = _ranked(whole, decided, mix)
    taken = F.col("_whole") + F.coalesce((F.struct("_order", "doc_id", "size") <= F.col("_last")) & F.col("_order").isNotNull(), F.lit(False)).cast("int")
    times = ranked.select("_row", taken.cast("int").alias("_times")).where(F.col("_times") > 0)
    copies = times.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return copies.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def _rates(sized: DataFrame, mix: Mix) -> DataFrame:
    """_source, source_size, target and _rate: expected copies of a document of weight 1 (null without words)."""
    sums = sized.groupBy("_source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("_w")).alias("_weighted"))
    sums = checkpointed(sums)
    targets = source_targets(sums.select("_source", "source_size"), mix)
    return checkpointed(_by_source(sums.drop("source_size"), targets).withColumn("_rate", F.try_divide(F.col("target"), F.col("_weighted"))).drop("_weighted"))


def _ranked(rows: DataFrame, rates: DataFrame, mix: Mix) -> DataFrame:
    """Adds the columns of rates, _whole (certain copies), _order (0 to 1; null without a fraction) and _range."""
    expected = F.when(F.col("size") > 0, F.least(F.col("_w") * F.col("_rate"), F.lit(float(mix.max_copies)))).otherwise(0.0)
    rated = _by_source(rows.withColumn("_u", uniform(F.col("doc_id"), mix.seed)), rates).withColumn("_expected", expected)
    rated = rated.withColumn("_whole", F.floor("_expected")).withColumn("_p", F.col("_expected") - F.col("_whole"))
    odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
    # Odds are mapped to 0..1 in the same order.
    rated = rated.withColumn("_order", F.when(F.col("_p") > 0, odds / (1 + odds)))
    rated = rated.withColumn("_range", F.least(F.floor(F.col("_order") * RANK_RANGES), F.lit(RANK_RANGES - 1)))
    return rated.drop("_u", "_w", "_p", "_expected", "_rate")


def _by_source(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join on the source, null included; right has one row for a source.

    Up to SENT_SOURCES of them are sent to every task; more are joined by a shuffle, in which a hot source's rows can
    be split, as the other side has one row for it.
    """
    if right.limit(SENT_SOURCES + 1).count() <= SENT_SOURCES:
        right = F.broadcast(right)
    return left.join(right.withColumnRenamed("_source", "_other"), F.col("_source").eqNullSafe(F.col("_other")), "left").drop("_other")


def _cut(rated: DataFrame) -> DataFrame:
    """Adds _chosen: 1 up to the place in each source's order where the words are nearest to what the target lacks.

    A document is in if the middle of its words, in the running sum, is not beyond the lack.
    """
    rated = checkpointed(rated)
    lack = rated.groupBy("_source").agg(F.first("target").alias("_t"), F.sum(F.col("_whole") * F.col("size")).alias("_certain"))
    ranges = rated.where(F.col("_order").isNotNull()).groupBy("_source", "_range").agg(F.sum("size").alias("_words"))
    running = Window.partitionBy("_source").orderBy("_range")
    ends = ranges.withColumn("_end", F.sum("_words").over(running))
    found = _by_source(ends, checkpointed(lack)).withColumn("_lack", F.col("_t") - F.col("_certain"))
    # The range of the cut: the first whose end is beyond the lack.
    cut = found.groupBy("_source").agg(
        F.min(F.when(F.col("_end") > F.col("_lack"), F.struct("_range", (F.col("_end") - F.col("_words")).alias("_start")))).alias("_cut"),
        F.first("_lack").alias("_lack"),
    )
    placed = _by_source(rated, checkpointed(cut))
    at = F.col("_cut")["_range"]
    state = F.when(F.col("_order").isNull(), 0).when(at.isNull() | (F.col("_range") < at), 1).when(F.col("_range") > at, 0)
    placed = placed.withColumn("_chosen", state)
    inside = placed.where(F.col("_chosen").isNull())
    order = Window.partitionBy("_source", "_range").orderBy("_order", "doc_id", "size")
    middle = 2 * (F.col("_cut")["_start"] + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))) - F.col("size")
    inside = inside.withColumn("_chosen", (middle <= 2 * F.col("_lack")).cast("int"))
    return placed.where(F.col("_chosen").isNotNull()).unionByName(inside)


def mix_sql(mix: Mix = Mix(), rows: str = "documents", out: str = "doc_id, size, source_size, round(target, 6) as target, taken") -> str:
    """The same in DuckDB's SQL, over a table or subquery of doc_id, text and source."""
    weights = ", ".join(map(str, mix.weights))
    return f"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size,
         (('0x' || substr(md5('{mix.seed}:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / {float(1 << 52)!r} as u
  from {rows}),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select *, ([{weights}])[1 + (row_number() over (order by source nulls last) - 1) % {len(mix.weights)}] as weight,
         row_number() over (order by source nulls last) as rank
  from sources),
levels as (
  select *, {mix.max_copies} * source_size / weight as ratio,
         (sum(source_size) over () * {mix.share!r}::double - coalesce(sum({mix.max_copies} * source_size) over (
            order by {mix.max_copies} * source_size / weight, rank rows between unbounded preceding and 1 preceding), 0))
         / sum(weight) over (order by {mix.max_copies} * source_size / weight, rank rows between current row and unbounded following) as level
  from weighed),
targets as (
  select source, source_size, least(({mix.max_copies} * source_size)::double,
         weight * (select level from levels where ratio >= level order by ratio, rank limit 1)) as target
  from levels),
rated as (
  select doc_id, s.source, size, source_size, target, u,
         case when size > 0 then least(target / source_size, {mix.max_copies}.0::double) else 0 end as expected
  from sized s join targets t on s.source is not distinct from t.source),
ordered as (
  select *, floor(expected) as whole, expected - floor(expected) as p,
         target - sum(floor(expected) * size) over (partition by source) as lack
  from rated),
placed as (select *, (u / (1 - u)) / (p / (1 - p)) as odds from ordered where p > 0
           union all select *, null from ordered where p = 0),
summed as (
  select *, sum(case when odds is null then 0 else size end) over (
           partition by source order by odds / (1 + odds) nulls last, doc_id, size rows between unbounded preceding and current row) as upto
  from placed),
mixed as (
  select doc_id, source, size, source_size, target,
         ((whole + case when odds is not null and 2 * upto - size <= 2 * lack then 1 else 0 end) * size)::bigint as taken,
         (whole + case when odds is not null and 2 * upto - size <= 2 * lack then 1 else 0 end)::int as copies
  from summed)
select {out} from mixed"""
