"""Document fingerprints by locally consistent parsing.

A text's code points are cut into phrases of two or three symbols, phrases into phrases of phrases, and so on to one
symbol. Where to cut follows from the symbols nearby alone: runs of one symbol become one symbol; deterministic coin
tossing then turns a symbol into the place and value of the lowest bit in which it differs from the one before it, again
and again, until six labels are left, which are recoloured to three; phrases start at local maxima of the labels and at
minima away from them. A phrase's name is a hash of its symbols' names. So equal substrings have equal names except
near their ends, wherever they stand.

The fingerprint is the `SKETCH` smallest of the hashed names from `FIRST_LEVEL` on (all levels of texts that end
before it), with the name of the whole, eight hex digits each. Likeness estimates the share of names that two texts
have in common; it is exact where both have fewer than `SKETCH`.

Null and empty texts have an empty fingerprint, like each other (1) and unlike all else (0). Order: ascending doc_id
(null first), then text; repeated rows follow each other, and a single document is its own next. An empty table gives no
rows; other columns are ignored. Memory in a task follows its longest text (about 60 bytes a character).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKETCH = 64
FIRST_LEVEL = 2
#: Characters parsed together.
BATCH = 1 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: Added to a symbol's name by its place in a phrase; an end and a start may leave phrases of up to five symbols.
PLACES = mix(np.arange(1, 9, dtype=U) * U(0x9E3779B97F4A7C15))


def _toss_table(labels: int) -> np.ndarray:
    """New label of (label before, label) for labels below the given power of two."""
    before, own = np.divmod(np.arange(labels * labels), labels)
    differ = before ^ own
    lowest = np.bitwise_count((differ & -differ) - 1)
    lowest[differ == 0] = 0
    return (2 * lowest + (own >> lowest & 1)).astype(np.uint8)


TOSSES = tuple((labels, _toss_table(labels)) for labels in (128, 16, 8))
#: The smallest of three colours that neither neighbour has, by (left, right); 7 stands for no neighbour.
FREE = np.array([next(c for c in range(3) if c not in divmod(i, 8)) for i in range(64)], np.uint8)


def colours(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 0 to 2, different for neighbours; first: starts of texts. Neighbouring symbols must differ."""
    n = len(symbols)
    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    before[first] = ~symbols[first]
    differ = symbols ^ before
    one = symbols.dtype.type(1)
    lowest = np.bitwise_count((differ & (~differ + one)) - one)
    label = (2 * lowest + ((symbols >> lowest.astype(symbols.dtype)) & one).astype(np.uint8)).astype(np.uint8)
    for labels, toss in TOSSES:
        pair = np.empty(n, np.uint16)
        pair[1:] = label[:-1]
        pair[first] = label[first] ^ 1
        pair *= np.uint16(labels)
        pair += label
        label = toss[pair]
    padded = np.full(n + 2, 7, np.uint8)
    padded[1:-1] = label
    ends = np.append(first[1:] - 1, n - 1)
    at_start, at_end = np.zeros(n, bool), np.zeros(n, bool)
    at_start[first], at_end[ends] = True, True
    for colour in (5, 4, 3):
        at = np.flatnonzero(padded[1:-1] == colour)
        left, right = padded[at], padded[at + 2]
        left[at_start[at]], right[at_end[at]] = 7, 7
        padded[at + 1] = FREE[left * np.uint8(8) + right]
    return padded[1:-1]


def phrase_starts(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    n = len(label)
    rises = np.zeros(n + 1, bool)  # label i is above label i - 1
    rises[1:n] = label[1:] > label[:-1]
    inner = np.ones(n + 1, bool)  # i - 1 and i are of one text
    inner[first], inner[n] = False, False
    maximum = rises[:n] & ~rises[1:] & inner[:n] & inner[1:]
    minimum = ~rises[:n] & rises[1:] & inner[:n] & inner[1:]
    beside = np.zeros(n, bool)
    beside[1:] |= maximum[:-1]
    beside[:-1] |= maximum[1:]
    start = maximum | (minimum & ~beside)
    # A single symbol before the first cut joins the phrase after it, so phrases have two symbols at least.
    start[first] = True
    lonely = first[first + 1 < n] + 1
    start[lonely[inner[lonely]]] = False
    return np.flatnonzero(start)


def summed(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else values[:0]


def parse(symbols: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(level, names, texts, whole) of the phrases of each level; whole: whether the phrase is all of its text."""
    level = 0
    while len(symbols):
        level += 1
        same = np.zeros(len(symbols), bool)
        same[1:] = (symbols[1:] == symbols[:-1]) & (owner[1:] == owner[:-1])
        if same.any():
            starts = np.flatnonzero(~same)
            length = np.diff(np.append(starts, len(symbols)))
            symbols, owner = symbols[starts], owner[starts]
            long = length > 1
            symbols = symbols.astype(U)
            symbols[long] = mix(symbols[long] ^ mix(length[long].astype(U) + U(1 << 40)))
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        starts = phrase_starts(colours(symbols, first), first)
        place = np.arange(len(symbols)) - np.repeat(starts, np.diff(np.append(starts, len(symbols))))
        names = mix(summed(mix(symbols.astype(U) + PLACES[place]), starts) + U(level))
        owner = owner[starts]
        alone = np.ones(len(owner), bool)
        alone[1:] &= owner[1:] != owner[:-1]
        alone[:-1] &= owner[:-1] != owner[1:]
        yield level, names, owner, alone
        symbols, owner = names[~alone], owner[~alone]


def sketches(texts: list[str]) -> list[np.ndarray]:
    """Of each text the smallest hashed names, ascending, as 32-bit numbers."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    found: list[np.ndarray] = []
    height = np.zeros(len(texts), np.int64)
    low: list[tuple[int, np.ndarray, np.ndarray]] = []
    for level, names, owner, whole in parse(codes, np.repeat(np.arange(len(texts)), lengths)):
        height[owner] = level
        keys = (owner.astype(U) << U(32)) | (names >> U(32))
        if level >= FIRST_LEVEL:
            found.append(keys)
        else:
            low.append((level, keys, owner))
            found.append(keys[whole])
    # Texts that end before the first level have all their names.
    found += [keys[height[owner] < FIRST_LEVEL] for _, keys, owner in low]
    keys = np.unique(np.concatenate(found)) if found else np.empty(0, U)
    bounds = np.searchsorted(keys >> U(32), np.arange(len(texts) + 1, dtype=U))
    small = (keys & U(0xFFFFFFFF)).astype(np.uint32)
    return [small[a : min(b, a + SKETCH)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common names: among the smallest of both, those that both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    x, y = set(a.tolist()), set(b.tolist())
    smallest = sorted(x | y)[:SKETCH]
    return sum(1 for z in smallest if z in x and z in y) / len(smallest)


def written(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the start of the next one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def neighbours(docs: DataFrame, buckets: int) -> DataFrame:
    """_bucket, _tail, doc_id, text: contiguous ranges of doc_id, each with the first row of the next range as its tail.

    Ranges are cut at quantiles of the ids; a range's first id is all that reaches the driver. Texts move once.
    """
    points = [i / buckets for i in range(1, buckets)] or [0.5]
    row = docs.agg(F.percentile_approx(F.col("doc_id").cast("double"), points, 10 * buckets).alias("cuts")).first()
    cuts = sorted(set(row["cuts"] or []))
    ranged = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))).alias("_x"), "text")
    edges = [float("-inf"), *cuts, float("inf")]
    if len(edges) > 2:
        ranged = Bucketizer(splits=edges, inputCol="_x", outputCol="_b").transform(ranged).withColumn("_bucket", F.col("_b").cast("int"))
    else:
        ranged = ranged.withColumn("_bucket", F.lit(0))
    firsts = ranged.groupBy("_bucket").agg(F.min(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).alias("_first")).orderBy("_bucket").collect()
    spark = docs.sparkSession
    # The first id of a range is also the tail of the range before it, of the first range that of the last.
    tails = [(r["_first"], firsts[i - 1]["_bucket"]) for i, r in enumerate(firsts)]
    tail = F.broadcast(spark.createDataFrame(tails, "_first long, _to int"))  # one row for a range
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    joined = ranged.join(tail, key == F.col("_first"), "left")
    main = F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("t"))
    copy = F.when(F.col("_to").isNotNull(), F.struct(F.col("_to").alias("b"), F.lit(1).alias("t")))
    spread = joined.select(F.explode(F.array_compact(F.array(main, copy))).alias("_at"), "doc_id", "text")
    dealt = spread.select(F.col("_at.b").alias("_bucket"), F.col("_at.t").alias("_tail"), "doc_id", "text")
    return dealt.repartition("_bucket").sortWithinPartitions("_bucket", "_tail", F.col("doc_id").asc_nulls_first(), "text")


def fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document.

    buckets: ranges of ids that texts are dealt by; four for each shuffle partition by default.
    """
    buckets = buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def rows_of(ids: list, texts: list[str], main: list[bool]) -> pa.RecordBatch:
        """All but the last row, which is only the next one of the row before; of these those that are no tails."""
        at = [i for i in range(len(ids) - 1) if main[i]]
        changed = [edited(texts[i], texts[i + 1]) for i in at]
        own, other = sketches(texts), sketches(changed)
        columns = [
            [ids[i] for i in at],
            [len(texts[i]) for i in at],
            [sha256(text.encode()).hexdigest() for text in changed],
            [written(own[i]) for i in at],
            [written(x) for x in other],
            [likeness(own[i], x) for i, x in zip(at, other, strict=True)],
            [likeness(own[i], own[i + 1]) for i in at],
        ]
        return pa.RecordBatch.from_pydict(dict(zip(out_schema.names, columns, strict=True)), out_schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out_schema = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, main, size = [], [], [], 0
        for batch in batches:
            tails = batch.column("_tail").to_pylist()
            for doc_id, text, tail in zip(batch.column("doc_id").to_pylist(), batch.column("text"), tails, strict=True):
                text = text.as_py() or ""
                # After a tail, the rows of a range with the same first id are tails too: the first is the next one.
                if main and not main[-1] and tail:
                    continue
                ids.append(doc_id)
                texts.append(text)
                main.append(not tail)
                size += len(text)
                if size > BATCH and len(ids) > 1:
                    yield rows_of(ids, texts, main)
                    ids, texts, main, size = ids[-1:], texts[-1:], main[-1:], len(text)
        if len(ids) > 1:
            yield rows_of(ids, texts, main)

    return neighbours(docs, buckets).mapInArrow(run, schema)
