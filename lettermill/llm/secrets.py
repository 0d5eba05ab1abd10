"""Secret scans: patterns, and how widely each candidate is owned over the whole corpus; DataFrame operations only.

Base spans are those of three patterns. Beyond them every long token of letters and digits is a candidate. A
candidate's SHA-256 is counted by distinct repositories and distinct owners over all documents: what many owners hold
is a copied example, what one owner holds looks like a live credential. Base spans stay whatever their count; a live
token that no base span contains is added as kind `owned`, also where it sticks out of one.

Positions come from a text's pieces between matches (the same pattern splits and extracts). Null texts are empty and
have no spans; a null owner or repository is one like any other; repeated rows give the same spans each; an empty table
gives no rows; other columns are ignored, whatever their names. Very long texts are scanned and masked whole, in time in proportion
to their length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.llm.common import checkpointed

#: The three patterns of the base, in the order of kinds; hex and access ask for their lengths, as a run is one match.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_CHARS = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "owned")
#: A token of the method: at least so many characters, with a digit and a letter.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
MASK = "[SECRET]"
#: Lengths summed one by one; sums of such blocks are taken whole.
RUN = 256


@dataclass(frozen=True)
class Ownership:
    """From so many owners on, or repositories of two owners or more, a candidate is a copied example; up to `live_owners` it looks live."""

    example_owners: int = 3
    example_repositories: int = 4
    live_owners: int = 1


def _pieces(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _scan(text: Column, guard: Column, pattern: str, value: int = 0) -> Column:
    """{gaps: lengths of what stands before each match, texts: matches, values}, or null without a match."""
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    return F.when(guard, F.struct(gaps.alias("gaps"), _pieces(text, pattern).alias("texts"), _pieces(text, pattern, value).alias("values")))


def _spans(scan: str, kind: int) -> Column:
    """array of {start, kind, end, value, text} in order of place; scan: a materialised column of _scan."""
    gaps, texts = F.col(f"{scan}.gaps"), F.col(f"{scan}.texts")
    steps = F.col(f"{scan}_steps")
    blocks = F.col(f"{scan}_blocks")
    total = lambda numbers: F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)

    def span(found: Column, i: Column) -> Column:
        block = F.floor(i / RUN).cast("int")
        before = total(F.slice(blocks, F.lit(1), block)) + total(F.slice(steps, block * RUN + 1, i - block * RUN))
        start = before + F.element_at(gaps, i + 1)
        return F.struct(
            start.alias("start"),
            F.lit(kind).alias("kind"),
            (start + F.char_length(found)).alias("end"),
            F.element_at(F.col(f"{scan}.values"), i + 1).alias("value"),
        )

    return F.coalesce(F.transform(texts, span), F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>"))


def _with_steps(df: DataFrame, scan: str) -> DataFrame:
    """Adds the lengths of each gap with its match, and their sums by block, so that a start is a short sum."""
    gaps, texts = F.col(f"{scan}.gaps"), F.col(f"{scan}.texts")
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(texts)), texts, lambda g, t: g.cast("long") + F.char_length(t))
    return df.withColumn(f"{scan}_steps", steps)


def _with_blocks(df: DataFrame, scan: str) -> DataFrame:
    steps = F.col(f"{scan}_steps")
    firsts = F.sequence(F.lit(0), F.greatest(F.size(steps) - 1, F.lit(0)), F.lit(RUN))
    sums = F.transform(firsts, lambda i: F.aggregate(F.slice(steps, i + 1, F.lit(RUN)), F.lit(0).cast("long"), lambda a, x: a + x))
    return df.withColumn(f"{scan}_blocks", F.when(steps.isNotNull(), sums))


def scanned(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """doc_id, _print (of the text), _owner, _repository, base and tokens (arrays of spans) of each distinct row.

    Written once: the texts are read in one pass, and only matches and lengths leave it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = docs.select(F.col("doc_id"), F.xxhash64("text").alias("_print"), owner.alias("_owner"), repository.alias("_repository"), text.alias("_t"))
    t = F.col("_t")
    found = raw.select(
        "doc_id",
        "_print",
        "_owner",
        "_repository",
        _scan(t, t.rlike(ASSIGN), ASSIGN, 2).alias("assign"),
        _scan(t, t.contains("AKIA"), ACCESS).alias("access"),
        _scan(t, t.rlike(HEX), HEX).alias("hex"),
        _scan(t, t.rlike(TOKEN), TOKEN).alias("token"),
    )
    found = checkpointed(found)
    scans = ("assign", "access", "hex", "token")
    for scan in scans:
        found = _with_steps(found, scan)
    for scan in scans:
        found = _with_blocks(found, scan)
    found = found.select("doc_id", "_print", "_owner", "_repository", *[_spans(scan, i).alias(scan) for i, scan in enumerate(scans)])
    long_enough = F.filter("assign", lambda s: F.char_length(s["value"]) >= ASSIGN_CHARS)
    mixed_token = F.filter("token", lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    base = F.array_sort(F.concat(long_enough, F.col("access"), F.col("hex")))
    return checkpointed(found.select("doc_id", "_print", "_owner", "_repository", base.alias("base"), mixed_token.alias("tokens")))


def ownership(found: DataFrame, limits: Ownership) -> DataFrame:
    """_hash and verdict (`example`, `live` or `shared`) of every candidate value.

    Distinct owners and repositories are counted in two steps with partial sums, so a value that a third of all
    documents hold costs no task more than others.
    """
    value = F.explode(F.array_distinct(F.transform(F.concat("base", "tokens"), lambda s: F.sha2(s["value"], 256)))).alias("_hash")
    seen = found.select("_owner", "_repository", value).groupBy("_hash", "_owner", "_repository").agg(F.count(F.lit(1)).alias("_n"))
    owners = seen.groupBy("_hash", "_owner").agg(F.count(F.lit(1)).alias("_repositories"))
    counts = owners.groupBy("_hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("_repositories").alias("repositories"))
    widely = (F.col("repositories") >= limits.example_repositories) & (F.col("owners") > 1)  # one owner's own are no copies
    example = (F.col("owners") >= limits.example_owners) | widely
    verdict = F.when(example, "example").when(F.col("owners") <= limits.live_owners, "live").otherwise("shared")
    return counts.select("_hash", "owners", "repositories", verdict.alias("verdict"))


def judged(docs: DataFrame, owner: Column, repository: Column, limits: Ownership = Ownership()) -> DataFrame:
    """doc_id, _print, and spans: an array of {start, kind, end, value, verdict} of each document that has any.

    Base spans all stay; tokens that no base span contains are there if live. Repeated rows are one row here.
    """
    one = F.struct("span.start", "span.kind", "span.end", "span.value", "verdict")
    return _placed(docs, owner, repository, limits).groupBy("doc_id", "_print").agg(F.array_sort(F.collect_set(one)).alias("spans"))


def _placed(docs: DataFrame, owner: Column, repository: Column, limits: Ownership) -> DataFrame:
    """doc_id, _print, span and verdict: a row for each span of each row of docs."""
    found = scanned(docs, owner, repository)
    found = found.where((F.size("base") > 0) | (F.size("tokens") > 0))
    verdicts = ownership(found, limits).select("_hash", "verdict")
    apart = F.filter("tokens", lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    spans = found.select("doc_id", "_print", F.explode(F.array_union(F.col("base"), apart)).alias("span"))
    # A value may be in a third of all documents; verdicts have one row for it, so its rows can be split.
    placed = spans.withColumn("_hash", F.sha2(F.col("span.value"), 256)).join(verdicts, "_hash")
    return placed.where((F.col("span.kind") < 3) | (F.col("verdict") == "live")).drop("_hash")


def _joined(docs: DataFrame, spans: DataFrame) -> DataFrame:
    right = spans.select(F.col("doc_id").alias("_id"), F.col("_print").alias("_p"), F.col("spans").alias("_spans"))
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_p"))
    return docs.join(right, on, "left").drop("_id", "_p")


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def secret_spans(docs: DataFrame, owner: Column, repository: Column, limits: Ownership = Ownership()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live and n_example of every document."""
    ids = docs.select("doc_id", F.xxhash64("text").alias("_print"))
    spans = _joined(ids, judged(docs, owner, repository, limits))
    every = F.coalesce("_spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string,verdict:string>>"))

    def count(field: str, value: int | str) -> Column:
        return F.size(F.filter(F.col("_all"), lambda s: s[field] == value)).cast("long")

    return spans.select("doc_id", every.alias("_all")).select(
        "doc_id",
        *[count("kind", k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(_written(F.filter("_all", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        _written(F.col("_all")).alias("spans"),
        count("verdict", "live").alias("n_live"),
        count("verdict", "example").alias("n_example"),
    )


def masked(docs: DataFrame, owner: Column, repository: Column, limits: Ownership = Ownership()) -> DataFrame:
    """The documents with all their columns; secrets in their text that are no copied examples are replaced by MASK.

    Secrets are masked where they stand, those that overlap or touch together; the same letters elsewhere are left. An
    assigned secret loses its value and keeps its name.
    """
    spans = _placed(docs, owner, repository, limits).where(F.col("verdict") != "example")
    start = F.when(F.col("span.kind") == 0, F.col("span.end") - F.char_length("span.value")).otherwise(F.col("span.start"))
    spans = spans.select("doc_id", "_print", start.alias("start"), F.col("span.end").alias("end")).distinct()
    before = Window.partitionBy("doc_id", "_print").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_before", F.coalesce(F.max("end").over(before), F.lit(0)))
    # What stays: a piece before each group of spans, the first of which may be empty, and the rest of the text.
    piece = F.when((F.col("start") > F.col("_before")) | (F.col("_before") == 0), F.struct(F.col("_before").alias("from"), F.col("start").alias("to")))
    kept = spans.groupBy("doc_id", "_print").agg(F.array_sort(F.collect_list(piece)).alias("pieces"), F.max("end").alias("rest"))
    kept = kept.select("doc_id", "_print", F.struct("pieces", "rest").alias("spans"))
    columns = docs.columns
    keyed = docs.select(F.struct(*[docs[c] for c in columns]).alias("_row"), docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("_print"))
    joined = _joined(keyed, kept)
    text = F.col("_row")["text"]
    # Four bytes a character: a piece is found without counting the characters before it.
    wide = joined.withColumn("_wide", F.when(F.col("_spans").isNotNull(), F.encode(text, "UTF-32")))
    mark = F.unhex(F.lit("0000FEFF"))  # the byte order that the decoder takes off, so that one in the text stays
    cut = lambda at, n: F.decode(F.concat(mark, F.substring(F.col("_wide"), 4 * at + 1, n)), "UTF-32")
    own = F.col("_spans.pieces"), F.col("_spans.rest")
    pieces = F.transform(own[0], lambda p: cut(p["from"].cast("int"), (4 * (p["to"] - p["from"])).cast("int")))
    clean = F.array_join(F.concat(pieces, F.array(cut(own[1].cast("int"), F.octet_length("_wide")))), MASK)
    clean = F.when(F.col("_spans").isNull(), text).otherwise(clean)
    return wide.select(*[clean.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in columns])
