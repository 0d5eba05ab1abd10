"""SimHash near duplicates: fingerprints, and exact comparison of tiles of them.

Equal fingerprints are one node. Nodes are dealt into cells by the population counts of the parts of a fingerprint: two
nodes within the radius are in the same cell or in neighbouring ones, as the counts differ by the radius at most in sum.
A cell's nodes meet those of its neighbours in tiles of bounded size. In a tile numpy takes the exclusive or of whole
blocks and counts bits; blocks are ordered by population count, and block pairs whose counts differ by more than the
radius are skipped. No pair within the radius is lost.

A tile gives a link only if it joins two components of the tile, over all its blocks and visitors, so a group of near
copies costs fewer links in a tile than it has nodes there. The comparisons grow with the square of the number of
different fingerprints, a few thousandths of all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.llm.common import checkpointed, text_batches
from lettermill.llm.components import connected

SEED = 42
#: Nodes of a cell, and nodes that visit it, in one tile.
LEFT_ROWS, RIGHT_ROWS = 4_096, 32_768
#: Rows compared at once.
BLOCK = 512
#: Parts of a 64-bit fingerprint whose population counts are a cell.
PARTS, PART_BITS = 4, 16

# --- fingerprints --------------------------------------------------------------------


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each run of `words` words, A-Z lower-cased, joined by spaces; of the whole if it has fewer."""
    found = text.encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        joined: Iterator[bytes] = iter([b" ".join(found)])
    else:
        joined = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, SEED) for x in joined), np.uint64)


def majority(hashes: np.ndarray) -> bytes:
    """Eight bytes, most significant first: a bit is 1 if it is set in over half of the hashes."""
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for start in range(0, n, 255 * 256):
        bits = np.unpackbits(hashes[start : start + 255 * 256].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        whole = len(bits) // 255 * 255
        # 255 ones fit a byte, and bytes are added fastest.
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n).tobytes()


def simhash(text: str, words: int) -> bytes:
    """Fingerprint of a text: eight bytes, zero without a word."""
    hashes = shingle_hashes(text, words)
    return majority(hashes) if len(hashes) else bytes(8)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (binary) and text_hash of every whole text (null: empty)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(text, words) for _, texts in text_batches(batch) for text in texts]
            columns = [batch.column("doc_id"), pa.array(found, pa.binary()), batch.column("text_hash")]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "text_hash"])

    narrow = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return narrow.mapInArrow(run, f"doc_id {kind}, fp binary, text_hash long")


# --- cells ---------------------------------------------------------------------------


def popcount_cells(nodes: DataFrame, radius: int) -> DataFrame:
    """fp, cells and visits of 64-bit nodes; at most (PART_BITS + 1) ** PARTS cells at any size of the data."""
    base = PART_BITS + 1
    word = F.conv(F.hex("fp"), 16, -10).cast("long")
    counts = [F.bit_count(F.shiftrightunsigned(word, PART_BITS * i).bitwiseAND(2**PART_BITS - 1)) for i in range(PARTS)]
    nodes = nodes.withColumns({f"_p{i}": c for i, c in enumerate(counts)})
    cell = sum((F.col(f"_p{i}") * base**i for i in range(PARTS)), F.lit(0))
    steps = [s for s in itertools.product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, s)) <= radius and s >= (0,) * PARTS]

    def there(step: tuple[int, ...]) -> Column:
        inside = [F.col(f"_p{i}").__sub__(s).between(0, PART_BITS) for i, s in enumerate(step) if s]
        to = cell - sum(s * base**i for i, s in enumerate(step))
        return F.when(_all(inside), to) if inside else to

    visits = F.array_compact(F.array(*[there(s) for s in steps]))
    return nodes.select("fp", F.array(cell.cast("long")).alias("cells"), visits.cast("array<long>").alias("visits"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out &= condition
    return out


# --- tiles ---------------------------------------------------------------------------


class Tile:
    """The nodes of one cell's block, and the links by which visiting nodes join them."""

    def __init__(self, left: np.ndarray, radius: int) -> None:
        counts = np.bitwise_count(left)
        order = np.argsort(counts, kind="stable")
        self.left, self.counts, self.radius = left[order], counts[order].astype(np.int64), radius
        self.group = np.arange(len(left))  # of each node the least of those it is joined with, by way of others
        self.sorted = np.sort(left)
        self.place = order.argsort()[np.argsort(left, kind="stable")]  # of each of the sorted

    def _root(self, nodes: np.ndarray) -> np.ndarray:
        """The group of each node; groups on the way are shortened."""
        found = self.group[nodes]
        while True:
            up = self.group[found]
            if (up == found).all():
                self.group[nodes] = found
                return found
            found = up

    def meet(self, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links (visitors, nodes): of each visitor one to every group that it is the first to join."""
        counts = np.bitwise_count(right).astype(np.int64)
        order = np.argsort(counts, kind="stable")
        right, counts = right[order], counts[order]
        at = np.minimum(np.searchsorted(self.sorted, right), len(self.sorted) - 1)
        own = np.where(self.sorted[at] == right, self.place[at], -1)  # a visitor may be a node of the block
        visitors, nodes = [], []
        for i in range(0, len(right), BLOCK):
            # Population counts further apart than the radius cannot be within it.
            last = min(i + BLOCK, len(right)) - 1
            low = int(np.searchsorted(self.counts, counts[i] - self.radius, "left"))
            high = int(np.searchsorted(self.counts, counts[last] + self.radius, "right"))
            hits = [self._near(right[i : i + BLOCK], j, min(j + BLOCK, high)) for j in range(low, high, BLOCK)]
            rows = np.concatenate([r for r, _ in hits]) if hits else np.empty(0, np.int64)
            columns = np.concatenate([c for _, c in hits]) if hits else np.empty(0, np.int64)
            for row, column in self._joined(rows, columns, own[i : i + BLOCK]):
                visitors.append(i + row)
                nodes.append(column)
        return right[visitors], self.left[nodes]

    def _near(self, right: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, places) of pairs within the radius of these visitors and the nodes from low to high.

        Of a visitor's nodes one of each group is enough: where there are many pairs, only those are given.
        """
        far = np.bitwise_count(right[:, None] ^ self.left[None, low:high])
        hit = (far <= self.radius) & (far > 0)  # at 0 it is the node itself
        if np.count_nonzero(hit) <= 4 * sum(hit.shape):
            rows, columns = np.nonzero(hit)
            return rows, columns + low
        columns = np.flatnonzero(hit.any(axis=0))
        roots, all_rows, all_columns = self._root(columns + low), [], []
        for root in np.unique(roots).tolist():
            mine = columns[roots == root]
            part = hit[:, mine]
            rows = np.flatnonzero(part.any(axis=1))
            all_rows.append(rows)
            all_columns.append(mine[part[rows].argmax(axis=1)] + low)
        return np.concatenate(all_rows), np.concatenate(all_columns)

    def _joined(self, rows: np.ndarray, columns: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, int]]:
        """(row, place) of the pairs that join groups. A visitor joins its group and those of all nodes it is near to."""
        if not len(rows):
            return
        # Of a visitor's nodes one of each group is enough.
        roots = self._root(columns)
        _, first = np.unique(rows * len(self.group) + roots, return_index=True)
        rows, columns = rows[first], columns[first]
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
            row = int(rows[low])
            roots = self._root(columns[low:high])
            new, each = np.unique(roots, return_index=True)
            inside = own[row] >= 0
            home = int(self._root(own[row : row + 1])[0]) if inside else int(new[0])
            self.group[np.append(new, home)] = min(int(new[0]), home)
            for root, k in zip(new.tolist(), each.tolist(), strict=True):
                if not (inside and root == home):
                    yield row, int(columns[low + k])


def _links(radius: int):
    """Function of mapInArrow over rows (cell, a, b, side, fp) sorted so; gives links (a, b)."""

    def words(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64)

    def binary(nodes: np.ndarray) -> pa.Array:
        data = nodes.astype(">u8").tobytes()
        return pa.array([data[i : i + 8] for i in range(0, len(data), 8)], pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, tile = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("cell", "a", "b", "side")])
            nodes = words(batch.column("fp"))
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for low, high in itertools.pairwise(starts):
                *now, side = keys[low].tolist()
                if now != key:
                    key, waiting, tile = now, [], None
                if side == 0:
                    waiting.append(nodes[low:high])
                elif waiting:
                    tile = tile or Tile(np.concatenate(waiting), radius)
                    visitors, found = tile.meet(nodes[low:high])
                    if len(found):
                        yield pa.RecordBatch.from_arrays([binary(visitors), binary(found)], names=["a", "b"])

    return run


def links(celled: DataFrame, radius: int) -> DataFrame:
    """(a, b) of a graph with the same components as that of all pairs of nodes within the radius.

    celled: fp (distinct), cells and visits. The number of cells is bounded whatever the number of nodes, so that their
    sizes may be broadcast.
    """
    homes, visitors = celled.select("fp", F.explode("cells").alias("cell")), celled.select("fp", F.explode("visits").alias("cell"))
    left = homes.groupBy("cell").agg(F.count(F.lit(1)).alias("n_left"))
    right = visitors.groupBy("cell").agg(F.count(F.lit(1)).alias("n_right"))
    # A lone node that only itself visits has no one to meet.
    tiles = left.join(right, "cell").where((F.col("n_left") > 1) | (F.col("n_right") > 1)).select(
        "cell",
        F.ceil(F.col("n_left") / LEFT_ROWS).cast("int").alias("n_a"),
        F.ceil(F.col("n_right") / RIGHT_ROWS).cast("int").alias("n_b"),
    )
    tiles = F.broadcast(checkpointed(tiles))
    spot = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lefts = homes.join(tiles, "cell").select("cell", spot("n_a").alias("a"), each("n_b").alias("b"), F.lit(0).alias("side"), "fp")
    rights = visitors.join(tiles, "cell").select("cell", each("n_a").alias("a"), spot("n_b").alias("b"), F.lit(1).alias("side"), "fp")
    dealt = lefts.unionByName(rights).repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b", "side")
    return dealt.mapInArrow(_links(radius), "a binary, b binary")


# --- groups --------------------------------------------------------------------------


def classes(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, root, first_id) of every fingerprint; root: the least fingerprint that it reaches; first_id: its least id."""
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected(links(popcount_cells(nodes, radius), radius))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return placed.select("fp", F.coalesce("root", "fp").alias("root"), "first_id")


def grouped(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id) of every fingerprint; component_id: the smallest doc_id that is reached, or null.

    prints: doc_id, fp.
    """
    placed = classes(prints, radius)
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return placed.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp and component_id of every document.

    Null and empty texts have a zero fingerprint and are linked like others; repeated rows fall together; a null id is
    never a component_id unless the whole group has no other; very long texts are hashed whole, in parts of bounded
    memory; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    prints = checkpointed(fingerprints(docs, words).drop("text_hash"))
    # A fingerprint may hold a third of the rows: the planner may split that side, as the other has one row for it.
    return prints.join(grouped(prints, radius), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """Documents with all their columns, of each group of linked fingerprints the one with the smallest doc_id.

    Of rows with that id, the group's first text (by hash) stays, once. An id that stands for texts of several groups
    keeps a text of each; rows without an id all stay.
    """
    known = docs.where(F.col("doc_id").isNotNull())
    prints = checkpointed(fingerprints(known, words))
    placed = prints.join(classes(prints, radius).select("fp", "root"), "fp")
    kept = placed.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("_kept")).select("_kept.*").distinct()
    kept = kept.select(F.col("doc_id").alias("_kept_id"), F.col("text_hash").alias("_kept_hash"))
    row, rank = F.struct(*[known[c] for c in docs.columns]).alias("_row"), F.row_number()
    plain = [known[c] for c, kind in docs.dtypes if "map<" not in kind]
    whole = known.select(row, known["doc_id"].alias("_id"), F.xxhash64(known["text"]).alias("_hash"), F.xxhash64(*plain).alias("_order"))
    found = whole.join(kept, (F.col("_id") == F.col("_kept_id")) & (F.col("_hash") == F.col("_kept_hash")), "left_semi")
    first = found.withColumn("_rank", rank.over(Window.partitionBy("_id", "_hash").orderBy("_order"))).where(F.col("_rank") == 1)
    return first.select(*[F.col("_row")[c].alias(c) for c in docs.columns]).unionByName(docs.where(F.col("doc_id").isNull()))
