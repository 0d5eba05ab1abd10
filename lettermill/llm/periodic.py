"""Periodic runs of words, found through string synchronising sets.

A run is a stretch of words with smallest period q, at least max(MIN_WORDS, 3 * q) long, that no neighbouring word
extends. At scale t (a power of two) a position is in the synchronising set if, among the windows of t words that start
there and at the next t positions, the one with the smallest hash starts first or last; windows of a period of at most
t / 3 do not count. Whether a position is chosen depends on 2 * t words alone, and of any t consecutive positions one is
chosen unless the words from there on are highly periodic. A run of a period q with 3 * t / 2 <= q < 3 * t therefore
holds two chosen positions q apart with equal contexts of 2 * t words; and equal contexts are over t / 3 apart, so at
most NEIGHBOURS of them are nearer than 3 * t. Each such pair proposes its distance as a period; the stretch round it
is then compared word by word. Periods up to SMALL_PERIOD, which the sets leave out, come from the highly periodic
regions: the stretches in which words that far apart are equal. Those of a period of at most t / 3 are known when
scale t is reached. So all runs are found, whatever the hashes are; work is n * log(n) for n words.

Texts of an Arrow batch are one array of word numbers, with a number of its own after each text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import text_batches

#: A run has at least so many words, and at least three periods.
MIN_WORDS, MIN_PERIODS = 24, 3
#: Periods found by direct comparison, and the first scale, whose sets find periods from 6.
SMALL_PERIOD, FIRST_SCALE = 8, 4
#: Equal contexts at a scale that are nearer than three times it, at most.
NEIGHBOURS = 9
NONE = np.uint64(2**64 - 1)
MIX = np.uint64(0x9E3779B97F4A7C15)

RUNS = "array<struct<start: long, length: long, period: long>>"


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits from 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def direct_stretches(words: np.ndarray, period: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of the longest stretches of at least `least` words in which words `period` apart are equal."""
    same = np.zeros(max(len(words) - period, 0) + 2, np.int8)
    same[1:-1] = words[period:] == words[: len(same) - 2]
    edges = np.diff(same)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) + period
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of `width` values from each position on, for every whole window."""
    done, least = 1, values
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    return least


def synchronising_set(names: np.ndarray, periodic: np.ndarray, scale: int) -> np.ndarray:
    """Chosen positions. names: hashes of the windows of `scale` words; periodic: of those that do not count."""
    values = np.where(periodic, NONE, names)
    if len(values) <= scale:
        return np.empty(0, np.int64)
    least = window_minimum(values, scale + 1)
    first, last = values[: len(least)], values[scale:]
    return np.flatnonzero((least != NONE) & ((first == least) | (last == least)))


def equal_pairs(chosen: np.ndarray, contexts: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(first position, distance) of chosen positions with equal contexts whose distance this scale answers for."""
    order = np.argsort(contexts[chosen], kind="stable")
    at, names = chosen[order], contexts[chosen][order]
    firsts, distances = [], []
    for step in range(1, NEIGHBOURS + 1):
        if len(at) <= step:
            break
        far = at[step:] - at[:-step]
        good = (names[step:] == names[:-step]) & (2 * far >= 3 * scale) & (far < 3 * scale)
        firsts.append(at[:-step][good])
        distances.append(far[good])
    if not firsts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(firsts), np.concatenate(distances)


def stretch(words: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """(start, end) of the longest stretch round `at` in which words `period` apart are equal."""
    end, step = at, 64
    while end + period < len(words):
        right = words[end + period : end + period + step]
        differ = right != words[end : end + len(right)]
        if differ.any():
            end += int(differ.argmax())
            break
        end, step = end + len(right), 2 * step
    start, step = at, 64
    while start > 0:
        low = max(0, start - step)
        differ = (words[low:start] != words[low + period : start + period])[::-1]
        if differ.any():
            start -= int(differ.argmax())
            break
        start, step = low, 2 * step
    return start, end + period


def find_runs(words: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs, by start and period.

    words: numbers of the words of all texts, each text followed by a number of its own; lengths: words of each text.
    """
    known: dict[tuple[int, int], int] = {}  # smallest period of a stretch of three periods at least
    for period in range(1, SMALL_PERIOD + 1):
        for found in direct_stretches(words, period, max(MIN_PERIODS * period, FIRST_SCALE)):
            known.setdefault(found, period)
    own = np.repeat(lengths, lengths + 1)  # each word's text length
    place, names, scale = np.arange(len(words)), _mixed(words.astype(np.uint64) * MIX), 1
    longest = int(lengths.max()) if len(lengths) else 0
    while 9 * scale <= 2 * longest:
        # A text shorter than 4.5 scales holds no run that this one or a larger one answers for.
        alive = 2 * own >= 9 * scale
        if not alive.all():
            words, own, place, names = words[alive], own[alive], place[alive], names[alive]
        n = len(words)
        if scale >= FIRST_SCALE:
            _runs_at(words, place, names, scale, known)
        ahead = np.full(n, NONE)
        ahead[: max(n - scale, 0)] = names[scale:]
        names, scale = _mixed(names * MIX + ahead), 2 * scale
    return sorted((s, e, q) for (s, e), q in known.items() if e - s >= max(MIN_WORDS, MIN_PERIODS * q))


def _runs_at(words: np.ndarray, place: np.ndarray, names: np.ndarray, scale: int, known: dict[tuple[int, int], int]) -> None:
    """Adds what the scale's synchronising set finds. place: of these words among those of all texts."""
    n = len(words)
    small = [(s, e) for (s, e), q in known.items() if MIN_PERIODS * q <= scale <= e - s]
    edges = np.zeros(n + 1, np.int32)
    if small:
        starts, ends = np.array(small).T
        at = np.searchsorted(place, starts)
        here = (at < n) & (place[np.minimum(at, n - 1)] == starts)  # texts that are still looked at
        np.add.at(edges, at[here], 1)
        np.add.at(edges, (at + ends - starts - scale + 1)[here], -1)
    whole = max(n - scale + 1, 0)
    periodic = np.cumsum(edges)[:whole] > 0
    chosen = synchronising_set(names[:whole], periodic, scale)
    contexts = np.zeros(n, np.uint64)
    contexts[: max(n - scale, 0)] = _mixed(names[: max(n - scale, 0)] * MIX + names[scale:])
    firsts, distances = equal_pairs(chosen, contexts, scale)
    order = np.lexsort((firsts, distances))
    period, covered = 0, -1
    for at, distance in zip(firsts[order].tolist(), distances[order].tolist(), strict=True):
        if distance != period:
            period, covered = distance, -1
        if at + period < covered:
            continue  # the pair is in the last stretch of this period
        start, end = stretch(words, at, period)
        covered = end
        if end - start >= MIN_PERIODS * period:
            found = (int(place[start]), int(place[start]) + end - start)
            known[found] = min(period, known.get(found, period))


# --- texts ---------------------------------------------------------------------------


def planted(doc_id: Column) -> Column:
    """(from, parts) of the tenth of the documents that the query repeats words in; null for the others.

    From word a = from % n on, the words of the first 1 + (n - a) // parts repeat to the end.
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    return F.when(h % 10 == 0, F.struct(g.cast("long").alias("from"), (3 + g % 8).cast("long").alias("parts")))


def repeated(n: int, start: int, parts: int) -> np.ndarray:
    """Which of n words stands at each place once words repeat."""
    a = start % n
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % (1 + (n - a) // parts)
    return at


def collapse(texts: list[str], plants: list[dict | None]) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
    """(words, runs as (start, length, period), text without each run's words after its first period) of each text."""
    numbers: dict[bytes, int] = {}
    split, parts, lengths = [], [], []
    for i, (text, plant) in enumerate(zip(texts, plants, strict=True)):
        found = text.encode().split()  # bytes: ASCII white space only
        own = np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int64, len(found))
        if plant and found:
            order = repeated(len(found), plant["from"], plant["parts"])
            own, found = own[order], [found[k] for k in order.tolist()]
        split.append(found)
        lengths.append(len(found))
        parts += [own, np.array([-1 - i])]
    starts = np.cumsum([0, *(n + 1 for n in lengths)]).tolist()
    by_text: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, end, period in find_runs(np.concatenate(parts), np.array(lengths)):
        k = int(np.searchsorted(starts, start, "right")) - 1
        by_text[k].append((start - starts[k], end - start, period))
    for found, runs in zip(split, by_text, strict=True):
        kept = found
        if runs:
            edges = np.zeros(len(found) + 1, np.int64)
            for start, length, period in runs:
                edges[start + period] += 1
                edges[start + length] -= 1
            kept = [found[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
        yield len(found), runs, b" ".join(kept).decode()


def periodic_runs(docs: DataFrame, plant: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length and period, by start and period) and collapsed text of every whole text.

    plant: from the doc_id a struct (from, parts), or null, by which words of the text are repeated first; see `planted`.
    A row-local pass without a shuffle. Null and empty texts have no words, no runs and an empty collapsed text; a null
    id plants nothing; repeated rows are done each; a very long text is one array of numbers; an empty table gives no
    rows; other columns are ignored, whatever their names.
    """
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "n_words", "runs", "collapsed"]
    struct = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plants = batch.column("plant").to_pylist()
            for start, texts in text_batches(batch):
                found = list(collapse(texts, plants[start : start + len(texts)]))
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in r] for _, r, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, len(texts)), pa.array([n for n, _, _ in found], pa.int64()),
                        pa.array(runs, struct), pa.array([t for _, _, t in found], pa.string()),
                    ],
                    names=names,
                )

    none = F.lit(None).cast("struct<from: long, parts: long>")
    narrow = docs.select("doc_id", "text", (plant(docs["doc_id"]) if plant else none).alias("plant"))
    return narrow.mapInArrow(run, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """n_runs, the run of the greatest exponent (ties: the first by start and period) and digests of each row."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda b, r: F.when(better(b, r), r).otherwise(b))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    lines = F.array_join(F.transform("runs", line), "")
    best_of = found.withColumn("_best", best)
    return best_of.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("_best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
