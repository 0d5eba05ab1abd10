"""Similarity join of shingle sets by chosen paths.

Sets of a similarity s agree in a minwise hash with probability s. Trees branch the sets by them: a node's sets are
dealt to children by the values of BRANCH hash functions, which the node's path selects, and two sets of a similarity of
0.85 stay together somewhere in a tree with a probability of 0.97 at any depth, so all but one in 10**6 such pairs meet in
one of TREES independent trees. A node is branched while it is larger than LEAF_ROWS sets or LEAF_SHINGLES shingles, to a
depth of DEPTH; smaller ones, and those that are left at that depth, are compared exhaustively. Whole sets confirm every
link.

What keeps the work in proportion: equal sets are one; sets that are in one component already are not compared again,
so a node of one component is done; where nodes stay large at the last depth, all sets of a large node first meet one of
them, chosen by hash, which makes most of a large group of near copies one component; then only what is outside a node's
commonest component meets the others, in tiles of bounded size; and the first hash function's nodes are compared before
all others. A link is given only if it joins two components of its tile. Work that stays quadratic: large groups of sets
that share most of their shingles, but less than the similarity that links.

Sets are compared by signatures first: of SKETCH minwise hashes two sets of 0.85 agree in 54 on average, and in fewer than
LEAST_AGREED one pair in 10**7.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import checkpointed, text_batches
from lettermill.llm.components import connected

#: Similarity, in hundredths of the union, from which on sets are linked; LEAST_AGREED, BRANCH and TREES are for it.
SIMILARITY = 85
SHINGLE_WORDS = 5
TREES, BRANCH, DEPTH = 4, 2, 3
#: Sets of a node, and their shingles, that are compared without branching.
LEAF_ROWS, LEAF_SHINGLES = 4_096, 1 << 21
#: Minwise hashes of a set, and how many two sets must agree in to be compared.
SKETCH, LEAST_AGREED = 64, 38
#: Sets that are compared with a set one by one; more are compared at once.
FEW = 8
#: Rows of a block of signatures that are compared at once.
BLOCK = 64

WORD_MIX, SHINGLE_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits from 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(32))) * SHINGLE_MIX
    x = (x ^ (x >> np.uint64(32))) * SHINGLE_MIX
    return x ^ (x >> np.uint64(32))


MULTIPLIERS = _mixed(np.arange(1, SKETCH + 1, dtype=np.uint64) * WORD_MIX) | np.uint64(1)


# --- sets ----------------------------------------------------------------------------


def shingle_set(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted 64-bit names of the distinct runs of `words` words, A-Z lower-cased; of the whole if it has fewer.

    A name comes from the XXH64 of the words in order; two of a trillion shingles share one with odds of one in 10**7.
    """
    found = text.encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not found:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    own = np.fromiter(map(digest, found), np.uint64, len(found))
    width = min(words, len(found))
    names = np.zeros(len(own) - width + 1, np.uint64)
    for k in range(width):
        names = _mixed(names * WORD_MIX + own[k : k + len(names)])
    return np.unique(names + np.uint64(width))  # a short text equals no run of more words


def minwise(names: np.ndarray) -> np.ndarray:
    """The least of each of SKETCH hash functions over a set."""
    out = np.empty(SKETCH, np.uint64)
    for low in range(0, SKETCH, 16):  # long sets in parts of bounded memory
        many = MULTIPLIERS[low : low + 16, None]
        least = [_mixed(names[None, i : i + 65_536] * many).min(axis=1) for i in range(0, len(names), 65_536)]
        out[low : low + 16] = np.min(least, axis=0)
    return out


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, n, sid (16 bytes of the set; null without words), keys of the first nodes, minima and sketch."""
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "text_hash", "n", "sid", "keys", "minima", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, texts in text_batches(batch):
                for text in texts:
                    one = shingle_set(text, words)
                    if len(one):
                        least = minwise(one)
                        parts = (least >> np.uint64(32)).astype("<u4").tobytes(), (least >> np.uint64(24)).astype(np.uint8).tobytes()
                        rows.append((len(one), xxhash.xxh128_digest(one.tobytes()), least[: TREES * BRANCH].view(np.int64).tolist(), *parts))
                    else:
                        rows.append((0, None, None, None, None))
            sizes, sids, keys, minima, sketches = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(sids, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())), pa.array(minima, pa.binary()), pa.array(sketches, pa.binary()),
                ],
                names=names,
            )

    narrow = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return narrow.mapInArrow(run, f"doc_id {kind}, text_hash long, n long, sid binary, keys array<long>, minima binary, sketch binary")


# --- trees ---------------------------------------------------------------------------


def _sized(rows: DataFrame) -> DataFrame:
    """Rows (node, sid, n, ...) of nodes of two sets or more, with rows_here and shingles_here of the node."""
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("rows_here"), F.sum("n").alias("shingles_here")).where(F.col("rows_here") > 1)
    return rows.join(sizes, "node")


def _large() -> Column:
    return (F.col("rows_here") > LEAF_ROWS) | (F.col("shingles_here") > LEAF_SHINGLES)


def _node(first: Column, *path: Column) -> Column:
    """A node's number, even for nodes of the first hash function."""
    return F.xxhash64(*path).bitwiseAND(F.lit(-2)) + F.when(first, 0).otherwise(1)


def trees(sets: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """(leaves, large nodes of each depth): rows node, sid, n. The last of the large ones are not branched.

    sets: sid, n, keys, minima.
    """
    rows = sets.select("sid", "n", F.posexplode("keys").alias("k", "value"))
    rows = rows.select(_node(F.col("k") == 0, F.col("k"), F.col("value")).alias("node"), "sid", "n")
    leaves, large = [], []
    for depth in range(1, DEPTH + 1):
        rows = checkpointed(_sized(rows))
        leaves.append(rows.where(~_large()).select("node", "sid", "n"))
        many = rows.where(_large()).select("node", "sid", "n")
        if many.isEmpty():
            break
        large.append(many)
        if depth < DEPTH:
            # The path selects hash functions; a set goes on with its values of them.
            picks = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(BRANCH - 1)), lambda j: F.pmod(F.xxhash64("node", j), F.lit(SKETCH)).cast("int")))
            value = F.substring("minima", F.col("pick") * 4 + 1, F.lit(4))
            split = many.join(sets.select("sid", "minima"), "sid").select("node", "sid", "n", "minima", F.explode(picks).alias("pick"))
            rows = split.select(_node(F.lit(False), F.col("node"), F.col("pick"), value).alias("node"), "sid", "n")
    return leaves, large


# --- comparison ----------------------------------------------------------------------


def agreed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """In how many of the signatures' places each left row equals each right row."""
    return (left[:, None, :] == right[None, :, :]).sum(axis=2, dtype=np.int16)


class Rows:
    """One side of a tile, by size: sets' ids, sizes, component labels and signatures; whole sets too where they are there."""

    def __init__(self, rows: list[tuple[bytes, int, bytes, bytes, np.ndarray | None]]) -> None:
        rows = sorted(rows, key=lambda r: r[1])
        self.sids, sizes, self.labels, sketches, self.sets = (list(c) for c in zip(*rows, strict=True))
        self.sizes = np.array(sizes, np.int64)
        self.sketches = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, SKETCH)

    def __len__(self) -> int:
        return len(self.sids)


def plausible(left: Rows, right: Rows, similarity: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row of a block of right rows, first of some left rows, whether each of the former may be similar to each
    of the latter); no other left row has a size that allows it."""
    for low in range(0, len(right), BLOCK):
        part = slice(low, low + BLOCK)
        sizes = right.sizes[part]
        start = int(np.searchsorted(100 * left.sizes, similarity * sizes[0], "left"))
        end = int(np.searchsorted(similarity * left.sizes, 100 * sizes[-1], "right"))
        if start < end:
            window = left.sizes[start:end]
            least = np.minimum(window[None, :], sizes[:, None])
            most = np.maximum(window[None, :], sizes[:, None])
            yield low, start, (100 * least >= similarity * most) & (agreed(right.sketches[part], left.sketches[start:end]) >= LEAST_AGREED)


def hopeful(left: Rows, right: Rows | None, similarity: int) -> list[tuple[int, bytes, int]]:
    """(side, id, size) of a tile's sets that may be similar to one of another component. Without right, left meets itself."""
    other, names = right or left, {}
    mine = np.array([names.setdefault(x, len(names)) for x in left.labels])
    theirs = np.array([names.setdefault(x, len(names)) for x in other.labels])
    from_left, from_other = np.zeros(len(left), bool), np.zeros(len(other), bool)
    for low, start, near in plausible(left, other, similarity):
        rows, columns = slice(low, low + near.shape[0]), slice(start, start + near.shape[1])
        near &= theirs[rows, None] != mine[None, columns]
        from_left[columns] |= near.any(axis=0)
        from_other[rows] = near.any(axis=1)
    out = [(0, left.sids[k], int(left.sizes[k])) for k in np.flatnonzero(from_left).tolist()]
    return out + [(1, right.sids[k], int(right.sizes[k])) for k in np.flatnonzero(from_other).tolist()] if right else out


class Join:
    """Links of a tile that join two components, confirmed on whole sets."""

    def __init__(self, left: Rows, right: Rows | None, similarity: int) -> None:
        self.left, self.other, self.alone, self.similarity = left, right or left, right is None, similarity
        names: dict[bytes, int] = {}
        self.group = np.array([names.setdefault(x, len(names)) for x in [*left.labels, *self.other.labels]])
        self.names, self.numbered, self.starts = None, None, None

    def _common(self, one: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Shingles that a set has in common with each of these left sets."""
        sets = self.left.sets
        if len(columns) <= FEW:
            return np.array([len(np.intersect1d(one, sets[c], assume_unique=True)) for c in columns.tolist()], np.int64)
        if self.names is None:
            self.names, self.numbered = np.unique(np.concatenate(sets), return_inverse=True)
            self.starts = np.cumsum([0, *map(len, sets[:-1])])
        mark = np.zeros(len(self.names), np.int32)
        at = np.minimum(np.searchsorted(self.names, one), len(self.names) - 1)
        mark[at[self.names[at] == one]] = 1
        return np.add.reduceat(mark[self.numbered], self.starts)[columns]

    def _similar(self, one: np.ndarray, columns: np.ndarray) -> np.ndarray:
        common = self._common(one, columns)
        return 100 * common >= self.similarity * (self.left.sizes[columns] + len(one) - common)

    def links(self) -> list[tuple[bytes, bytes]]:
        """For each component that joins others, one of its sets with one of the first of these."""
        before = self.group.copy()
        self._merge()
        sids = [*self.left.sids, *self.other.sids]
        names, rows = np.unique(before, return_index=True)  # names are 0, 1, 2 ...
        return [(sids[rows[g]], sids[rows[to]]) for g, to in zip(names.tolist(), self.group[rows].tolist(), strict=True) if g != to]

    def _merge(self) -> None:
        n = len(self.left)
        for low, start, block in plausible(self.left, self.other, self.similarity):
            for k in range(len(block)):
                i = low + k
                near = block[k] & (self.group[start : start + block.shape[1]] != self.group[n + i])
                if self.alone:
                    near[max(i - start, 0) :] = False  # later ones meet this one in their turn
                columns = np.flatnonzero(near) + start
                if not len(columns):
                    continue
                one = self.other.sets[i]
                # One of each component first: where that is similar, the others need no look.
                _, first = np.unique(self.group[columns], return_index=True)
                found = columns[first][self._similar(one, columns[first])]
                rest = np.delete(columns, first)
                rest = rest[~np.isin(self.group[rest], self.group[found])]
                if len(rest):
                    more = rest[self._similar(one, rest)]
                    found = np.concatenate([found, more[np.unique(self.group[more], return_index=True)[1]]])
                if len(found):
                    groups = np.append(self.group[found], self.group[n + i])
                    self.group[np.isin(self.group, groups)] = groups.min()


def _tiles(similarity: int, words: int | None):
    """Function of mapInArrow over rows (node, a, b, side, sid, n, label, sketch[, text]) sorted so.

    With words it gives confirmed links (a, b); without, the rows (node, a, b, side, sid, n) that may have some.
    """
    names = ["a", "b"] if words else ["node", "a", "b", "side", "sid", "n"]
    types = [pa.binary(), pa.binary()] if words else [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]

    def done(key: tuple, sides: tuple[list, list]) -> list[tuple]:
        if not sides[0] or len(sides[0]) + len(sides[1]) < 2:
            return []
        left, right = (Rows(side) if side else None for side in sides)
        return Join(left, right, similarity).links() if words else [(*key, *x) for x in hopeful(left, right, similarity)]

    def give(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("node", "a", "b")), strict=True)
            rows = zip(*(batch.column(c).to_pylist() for c in ("sid", "n", "label", "sketch")), strict=True)
            texts = (t for _, some in text_batches(batch) for t in some) if words else itertools.repeat("")
            out = []
            for now, side, row, text in zip(keys, batch.column("side").to_pylist(), rows, texts, strict=False):
                if now != key:
                    out += done(key, sides)
                    key, sides = now, ([], [])
                sides[side].append((*row, shingle_set(text, words) if words else None))
            if out:
                yield give(out)
        if out := done(key, sides):
            yield give(out)

    return run


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition("node", "a", "b").sortWithinPartitions("node", "a", "b", "side")


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Adds label: the component that a set is known to be in, or the set itself."""
    if labels is None:
        return rows.withColumn("label", F.col("sid"))
    found = rows.join(labels.withColumnRenamed("node", "sid"), "sid", "left")
    return found.withColumn("label", F.coalesce("root", "sid")).drop("root")


def _dealt(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows (node, sid, n) dealt into tiles (node, a, b, side, sid, n, label) without nodes of one component alone.

    A node that is small enough is one tile. Of a larger one, what is not of its commonest component meets all, block
    by block; sets of that component do not meet each other.
    """
    rows = _labelled(rows.select("node", "sid", "n"), labels)
    counts = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    nodes = counts.groupBy("node").agg(F.max(F.struct("c", "s", "label")).alias("most"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    nodes = nodes.where(F.col("most.c") < F.col("c"))
    blocks = lambda c, s: F.ceil(F.greatest(c / LEAF_ROWS, s / LEAF_SHINGLES, F.lit(1))).cast("int")
    nodes = nodes.select(
        "node",
        F.col("most.label").alias("commonest"),
        blocks(F.col("c") - F.col("most.c"), F.col("s") - F.col("most.s")).alias("n_a"),
        blocks(F.col("c"), F.col("s")).alias("n_b"),
    )
    placed = rows.join(nodes, "node")
    spot = lambda n: F.pmod(F.xxhash64("sid", F.lit(5)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = ["sid", "n", "label"]
    one = placed.where(F.col("n_b") == 1).select("node", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"), *own)
    many = placed.where(F.col("n_b") > 1)
    lefts = many.where(F.col("label") != F.col("commonest")).select("node", spot("n_a").alias("a"), each("n_b").alias("b"), F.lit(0).alias("side"), *own)
    rights = many.select("node", each("n_a").alias("a"), spot("n_b").alias("b"), F.lit(1).alias("side"), *own)
    return one.unionByName(lefts).unionByName(rights)


def _stars(rows: DataFrame) -> DataFrame:
    """Tiles in which each set of a large node meets one of the node's, chosen by hash."""
    centres = rows.groupBy("node").agg(F.min(F.struct(F.xxhash64("sid", "node").alias("h"), "sid", "n")).alias("c"))
    pairs = rows.join(centres, "node").select(F.col("c.sid").alias("centre"), F.col("c.n").alias("centre_n"), "sid", "n")
    pairs = pairs.where(F.col("sid") != F.col("centre")).distinct()
    counts = pairs.groupBy("centre").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"), F.first("centre_n").alias("centre_n"))
    parts = counts.select("centre", "centre_n", F.ceil(F.greatest(F.col("c") / LEAF_ROWS, F.col("s") / LEAF_SHINGLES, F.lit(1))).cast("int").alias("parts"))
    tile = [F.xxhash64("centre").alias("node"), F.lit(0).alias("a")]
    middle = parts.select(*tile, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("b"), F.lit(0).alias("side"), F.col("centre").alias("sid"), F.col("centre_n").alias("n"))
    placed = pairs.select("centre", "sid", "n").join(parts, "centre")
    around = placed.select(*tile, F.pmod(F.xxhash64("sid", F.lit(5)), F.col("parts")).cast("int").alias("b"), F.lit(1).alias("side"), "sid", "n")
    return _labelled(middle.unionByName(around), None)


def _hopes(tiles: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The rows of tiles that may have a link, by signatures."""
    found = _grouped(tiles.join(sets.select("sid", "sketch"), "sid")).mapInArrow(
        _tiles(similarity, None), "node long, a int, b int, side int, sid binary, n long"
    )
    return checkpointed(found)


def _links(hopes: DataFrame, labels: DataFrame | None, texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """(a, b): confirmed links that join components of a tile."""
    rows = _grouped(_labelled(hopes.drop("n"), labels).join(texts, "sid"))
    return checkpointed(rows.mapInArrow(_tiles(similarity, words), "a binary, b binary"))


def _texts(docs: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """sid, n, sketch and text of the wanted sets: the text of each set's first document."""
    wanted = sets.join(wanted.select("sid").distinct(), "sid").select(
        "sid", "n", "sketch", F.col("sample.doc_id").alias("_id"), F.col("sample.text_hash").alias("_hash")
    )
    own = docs.select(docs["doc_id"].alias("_own_id"), docs["text"].alias("text"), F.xxhash64(docs["text"]).alias("_own"))
    found = own.join(wanted, F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")))
    # Rows that repeat an id and a text are one.
    return found.groupBy("sid", "n", "sketch").agg(F.first("text").alias("text"))


# --- documents -----------------------------------------------------------------------


def similar_sets(docs: DataFrame, sets: DataFrame, words: int, similarity: int) -> DataFrame:
    """(node, root) of every linked set; root: the least set that it reaches. sets: sid, sample, n, keys, minima, sketch."""
    leaves, large = trees(sets)
    rows = leaves[0]
    for more in leaves[1:]:
        rows = rows.unionByName(more)
    near = _hopes(_dealt(rows, None), sets, similarity)
    first, others = near.where(F.col("node") % 2 == 0), near.where(F.col("node") % 2 != 0)
    wanted, links, labels = near.select("sid"), None, None
    if len(large) == DEPTH:  # large at the last depth, and perhaps of several components
        stars = _hopes(_stars(large[0]), sets, similarity)
        texts = checkpointed(_texts(docs, sets, wanted.unionByName(stars.select("sid")).unionByName(large[-1].select("sid"))))
        links = _links(stars, None, texts, words, similarity)
        labels = connected(links)
        first = _hopes(_dealt(first.select("node", "sid", "n").unionByName(large[-1]), labels), sets, similarity)
    else:
        texts = checkpointed(_texts(docs, sets, wanted))
    more = _links(first, labels, texts, words, similarity)
    if links:
        links = links.unionByName(more)
        labels = connected(links)
    else:
        # Of the first hash a set is in one node, whose links all lead to the first set of their component.
        links, labels = more, more.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    # What is not one component yet: the other nodes, by the components that are known now.
    more = _links(_hopes(_dealt(others, labels), sets, similarity), labels, texts, words, similarity)
    return connected(links.unionByName(more))


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    component_id: the smallest doc_id that is reached over links, itself included; similarity: hundredths of the union
    that a link needs, 85 or more (the trees' number is for that). Texts of fewer words than a shingle are compared as
    a whole. Null, empty and blank texts have no shingles and no links. Repeated rows fall together and are each given;
    a null id is a component_id only where the component has no other. Very long texts are sets of 8 bytes for each
    distinct shingle. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    if similarity < SIMILARITY:
        raise ValueError(f"the trees find pairs of a similarity of {SIMILARITY} or more")
    prints = checkpointed(signatures(docs, words))
    sets = prints.where(F.col("sid").isNotNull()).groupBy("sid").agg(
        F.min("doc_id").alias("first_id"),
        F.min(F.struct("doc_id", "text_hash")).alias("sample"),
        *[F.first(c).alias(c) for c in ("n", "keys", "minima", "sketch")],
    )
    sets = checkpointed(sets)
    placed = sets.select("sid", "first_id").join(similar_sets(docs, sets, words, similarity).withColumnRenamed("node", "sid"), "sid", "left")
    placed = placed.select("sid", "first_id", F.coalesce("root", "sid").alias("root"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = placed.join(least, "root").select("sid", "component_id")
    # A set may hold a third of the rows: the planner may split that side, as the other has one row for it.
    linked = prints.where(F.col("sid").isNotNull()).select("doc_id", "n", "sid").join(classes, "sid").select("doc_id", "n", "component_id")
    alone = prints.where(F.col("sid").isNull()).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def join_sql(words: int = SHINGLE_WORDS, similarity: int = SIMILARITY, docs: str = "documents") -> str:
    """The same in DuckDB's SQL: all pairs of sets that share a shingle, and the least id reached over links."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
with recursive texts as (
  select row_number() over () as row, doc_id, coalesce(regexp_extract_all({lower}, '[^\x20\x09-\x0D]+'), []) as w from {docs}),
shingles as (
  select distinct row, doc_id, unnest(list_transform(range(1, 2 + greatest(len(w) - {words}, 0)), lambda i: array_to_string(w[i : i + {words - 1}], ' '))) as s
  from texts where len(w) > 0),
sizes as (select row, doc_id, count(*) as n from shingles group by all),
common as (select a.row as a, b.row as b, count(*) as c from shingles a join shingles b on a.s = b.s and a.row < b.row group by all),
links as (
  select a, b from common join sizes x on x.row = a join sizes y on y.row = b where 100 * c >= {similarity} * (x.n + y.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reached(a, b) as (select row, row from sizes union select r.a, l.b from reached r join both_ways l on l.a = r.b),
least as (select r.a as row, min(t.doc_id) as component_id from reached r join texts t on t.row = r.b group by r.a)
select t.doc_id, coalesce(n, 0)::bigint as n_shingles, case when n is null then t.doc_id else component_id end as component_id,
       t.doc_id is not distinct from case when n is null then t.doc_id else component_id end as kept
from texts t left join sizes using (row) left join least using (row)"""
