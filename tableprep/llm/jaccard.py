"""Similarity join on word shingles with count vectors and R-trees.

The shingle hashes of a text are dealt into groups by their value. Two sets whose Jaccard similarity reaches the threshold
differ in at most ``d`` elements, where d follows from their sizes, so of d + 1 groups at least one has the same content in both
(pigeonhole). That content is the root of a tree: texts meet only under a common root, which Spark
deals out by a shuffle. Below a root, a text is a point whose coordinates are the counts of its shingles in
more groups for larger sets. The overlap of two sets is at most the sum of the smaller coordinates, and that of two
boxes of points at most the sum of the smaller upper corners; an R-tree prunes pairs of boxes and points with it, first on sums of
coordinates, then on all. Pairs that survive are verified on the sets.

So that groups of many alike texts take few steps, equal sets are joined beforehand, each text is first compared (by
points, then by sets) with the first one under its root, and trees are only built where a root still has texts of several components.
Roots with one first text are one tree, made of blocks of bounded size. A tree of points tells which texts have a partner at all;
the sets of those are brought together and verified inside the block, and only links between texts that were still
apart are put out: fewer than the block has texts.

Cases: null, empty and blank texts have an empty set and link with nothing, not with each other; a text with fewer words than
a shingle has its whole sequence as its only one; texts are read whole; repeated rows are linked as equal texts
are, rows with the same id are one document whose sets must be equal else each links for it; a row without id is left out;
an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableprep.llm.arrow import bounded_batches, packed, release, rows_of, text_bytes, tidy
from tableprep.llm.meeting import parts_for, shared_names
from tableprep.llm.words import LOWER, chained_hashes, distinct, mix, shingles, word_places
from tableprep.operators.fuzzy import connected
from tableprep.scratch import written

#: Coordinates of a point at least (the tree is built on so many, each the sum of some) and at most.
LEAST_GROUPS, MOST_GROUPS = 32, 1 << 14
#: What a count too large to be stored is taken for.
MANY = 1 << 40
#: Points in a leaf, in a block of points that one tree is built of, and in the trees of one task's call, about.
LEAF, BLOCK, BUNDLE = 32, 2048, 4096
#: Shingles of the sets in a block, and in the blocks of one task's call, about (8 bytes each).
BLOCK_SHINGLES, BUNDLE_SHINGLES = 1 << 20, 1 << 21
#: So many ids (8 bytes each) are sent to all tasks; more are joined by a shuffle of the texts.
BROADCAST_IDS = 1_000_000


class Threshold:
    """Jaccard similarity of at least ``least / 100``, in whole numbers."""

    def __init__(self, least: int):
        if not 0 < least <= 100:
            raise ValueError("the threshold is a percentage above 0")
        self.least = least

    def overlap(self, total):
        """The smallest overlap of two linked sets with ``total`` elements together."""
        return -(-self.least * total // (100 + self.least))

    @cached_property
    def schemes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The least size of each size class, the groups that sets of that class and the one below are dealt into, and spare groups.

        Linked sets are in the same class or in adjacent ones, and differ in fewer elements than there are groups but the spare ones.
        """
        lows, groups, spare, low = [0], [1], [0], 1
        while low < 1 << 40:
            high = max(low, 100 * low // self.least)
            needed = 2 * high * (100 - self.least) // (100 + self.least) + 1
            more = 0
            for _ in range(3):  # about as many as the smallest of these sets leave empty
                empty = (needed + more) * math.exp(-max(lows[-1], 1) / (needed + more))
                more = min(math.ceil(empty + 2 * math.sqrt(empty)), needed // 4) if needed > 1 else 0
            lows.append(low)
            groups.append(needed + more)
            spare.append(more)
            low = high + 1
        return np.array(lows), np.array(groups), np.array(spare)


def roots(hashes: np.ndarray, offsets: np.ndarray, threshold: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """The root keys of each set and their offsets.

    ``hashes`` are sorted within each set, so a group is a run of neighbours. A set takes part as a member of its
    class and of the lower class of the next one. Equal sets, whose groups are all equal, are left to an own step: where a
    scheme allows no difference it has no keys. Linked sets have one group more in common than there are spare ones,
    so where no more than that are empty, they have one in common that is not.
    """
    sizes = np.diff(offsets)
    lows, groups, spare = threshold.schemes
    number = np.searchsorted(lows, sizes, "right") - 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    keys, owners = [], []
    for step in (0, 1):
        scheme = number + step
        n = np.where((sizes > 0) & (groups[scheme] > 1), groups[scheme], 0)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        taking = n[owner] > 0
        member = ((hashes[taking] >> np.uint64(32)) * n[owner[taking]].astype(np.uint64)) >> np.uint64(32)
        cell = (ends - n)[owner[taking]] + member.astype(np.int64)
        # Contents: the sum of mixed hashes of each run; empty groups keep 0 and are a content too.
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes[taking] + np.uint64(17)), dtype=np.uint64)])
        held = np.bincount(cell, minlength=total)
        counts = np.concatenate([[0], np.cumsum(held)]).astype(np.int64)
        content = sums[counts[1:]] - sums[counts[:-1]]
        of = np.repeat(np.arange(len(sizes)), n)
        place = np.arange(total) - np.repeat(ends - n, n)
        name = (scheme[of].astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64)
        empty = np.bincount(of[held == 0], minlength=len(sizes))
        goes = (held > 0) | (empty > spare[scheme])[of]
        keys.append(mix(content + mix(name + np.uint64(1)))[goes])
        owners.append(of[goes])
    of = np.concatenate(owners)
    order = np.argsort(of, kind="stable")
    return np.concatenate(keys)[order], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(sizes)))])


def points(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each set's shingles in the groups that the low bits of the hash name, and where each set's begin.

    A set of n has a power of two of groups, about n / 6; a count of 255 stands for any that is larger.
    """
    sizes = np.diff(offsets)
    groups = np.minimum(1 << np.ceil(np.log2(np.maximum(sizes / 8, 1))).astype(np.int64), MOST_GROUPS)
    groups = np.maximum(groups, LEAST_GROUPS)
    ends = np.concatenate([[0], np.cumsum(groups)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    cell = ends[owner] + (hashes & (groups[owner] - 1).astype(np.uint64)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=ends[-1]), 255).astype(np.uint8), ends


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    """Counts in fewer groups: those of the lower bits."""
    counts = np.where(point == 255, MANY, point.astype(np.int64))
    return counts.reshape(-1, groups).sum(axis=0)


def may_link(x: bytes, y: bytes, n_x: int, n_y: int, threshold: Threshold) -> bool:
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    groups = min(len(x), len(y))
    return bool(np.minimum(folded(x, groups), folded(y, groups)).sum() >= threshold.overlap(n_x + n_y))


def sets_of(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(texts)
    starts, ends, owner = word_places(data, offsets)
    found, owner = shingles(chained_hashes(LOWER[data], starts, ends), owner, len(texts), size)
    return distinct(found, owner, len(texts))


def _set_names(hashes: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums that name a set."""
    names = []
    for salt in (5, 11):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ mix(np.full(1, salt, np.uint64))), dtype=np.uint64)])
        names.append((sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64))
    return names


class RTree:
    """Points packed into boxes: sorted by size, then cut by coordinates; a box keeps its upper corner and least size."""

    def __init__(self, at: np.ndarray, sizes: np.ndarray):
        self.at, self.sizes = at, sizes
        self.leaves: list[np.ndarray] = []
        self._pack(np.argsort(sizes, kind="stable"), 0)
        self.corner = np.array([at[leaf].max(axis=0) for leaf in self.leaves])
        self.least = np.array([sizes[leaf].min() for leaf in self.leaves])

    def _pack(self, rows: np.ndarray, depth: int) -> None:
        if len(rows) <= LEAF:
            self.leaves.append(rows)
            return
        if depth:  # the coordinate that spreads most
            rows = rows[np.argsort(self.at[rows, np.ptp(self.at[rows], axis=0).argmax()], kind="stable")]
        half = len(rows) // 2
        self._pack(rows[:half], depth + 1)
        self._pack(rows[half:], depth + 1)

    def pairs(self, other: "RTree", threshold: Threshold) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of points of both trees whose possible overlap suffices."""
        for i, leaf in enumerate(self.leaves):
            most = np.minimum(self.corner[i], other.corner).sum(axis=1)
            for j in np.flatnonzero(most >= threshold.overlap(self.least[i] + other.least)):
                across = other.leaves[j]
                bound = np.minimum(self.at[leaf][:, None], other.at[across][None]).sum(axis=2)
                a, b = np.nonzero(bound >= threshold.overlap(self.sizes[leaf][:, None] + other.sizes[across][None]))
                yield leaf[a], across[b]


def _verify(pairs: DataFrame, sets: DataFrame, threshold: Threshold) -> DataFrame:
    """Pairs (a, b) with ``linked``, whether the sets link; ``sets`` has node and hashes."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                linked.append(int((both[1:] == both[:-1]).sum()) >= threshold.overlap(len(both)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked)], ["a", "b", "linked"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    bounded_batches(joined.sparkSession)
    return joined.mapInArrow(tidy(run), "a bigint, b bigint, linked boolean")


def _small(ids: DataFrame) -> DataFrame:
    """Ids, marked to be sent to all tasks if they are few enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """The hashed sets of some documents: node (a document's id) and hashes, read from the texts again."""

    def start():
        def work(part: pa.RecordBatch):
            hashes, offsets = sets_of(part.column(0), size)
            return pa.RecordBatch.from_arrays([part.column(1), packed(hashes, offsets * 8)], ["node", "hashes"])

        return work

    ids = _small(nodes.select(F.col("node").alias("id")))
    return rows_of(docs.join(ids, "id", "left_semi"), "text", ["id"], "node bigint, hashes binary", start)


def _cells(members: DataFrame) -> DataFrame:
    """``members`` (key, node, component, major, n) dealt to the pairs of blocks, called cells, in which they meet.

    Texts of the component ``major`` need no pairs with one another; the others meet them and each other.
    """
    members = members.withColumn("is_major", F.col("component") == F.coalesce("major", F.lit(-1)))

    def blocks(which):
        rows, shingles_of = F.count(F.when(which, 1)), F.sum(F.when(which, F.col("n")))
        return F.greatest(F.ceil(rows / BLOCK), F.ceil(F.coalesce(shingles_of, F.lit(0)) / BLOCK_SHINGLES), F.lit(1)).cast("int")

    counted = members.groupBy("key").agg(blocks(F.col("is_major")).alias("majors"), blocks(~F.col("is_major")).alias("minors"))
    cut = members.join(counted, "key")
    cut = cut.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("is_major"), F.col("majors")).otherwise(F.col("minors"))).cast("int"))
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pair = lambda kind, low, high: F.struct(F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"))
    with_minors = F.transform(up_to("minors"), lambda j: pair(0, F.col("block"), j))
    with_majors = F.transform(up_to("majors"), lambda i: pair(0, i, F.col("block")))
    among_minors = F.transform(up_to("minors"), lambda j: pair(1, F.least(F.col("block"), j), F.greatest(F.col("block"), j)))
    cells = F.when(F.col("is_major"), with_minors).otherwise(F.concat(with_majors, among_minors))
    dealt = cut.select("key", "node", "component", "n", "is_major", "block", F.explode(cells).alias("cell"))
    return dealt.select("key", "cell.*", "node", "component", "n", "is_major", "block")


def _by_cell(dealt: DataFrame, bundles: int, work: Callable[[pa.Table], pa.Table | None], out: pa.Schema, made: str) -> DataFrame:
    """``work`` on each cell; several cells share a call."""
    cell = F.xxhash64("key", "kind", "low", "high")
    bundled = dealt.withColumn("cell", cell).withColumn("bundle", F.pmod("cell", F.lit(max(1, bundles))))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("cell", "ascending")])
        key, cell = table["key"].to_numpy(), table["cell"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]))
        found = [t for a, b in zip(starts, [*starts[1:], len(key)]) if (t := work(table.slice(a, b - a))) is not None]
        release()
        return pa.concat_tables(found) if found else out.empty_table()

    return bundled.groupBy("bundle").applyInArrow(run, made)


def _tree_pairs(table: pa.Table, at: np.ndarray, threshold: Threshold) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of pairs in a cell that trees on their points ``at`` leave."""
    sizes, block, is_major = (table[c].to_numpy() for c in ("n", "block", "is_major"))
    kind, low, high = (table[c][0].as_py() for c in ("kind", "low", "high"))
    first = np.flatnonzero(is_major if kind == 0 else block == low)
    second = np.flatnonzero(~is_major if kind == 0 else block == high)
    if not len(first) or not len(second):
        return
    coarse = at.reshape(len(at), -1, LEAST_GROUPS).sum(axis=1)
    one = RTree(coarse[first], sizes[first])
    two = one if kind == 1 and low == high else RTree(coarse[second], sizes[second])
    for a, b in one.pairs(two, threshold):
        yield first[a], second[b]


def _points_of(stored: list[np.ndarray]) -> np.ndarray:
    groups = min(map(len, stored))
    return np.stack([folded(p, groups) for p in stored])


def _with_partners(dealt: DataFrame, vectors: DataFrame, n_rows: int, threshold: Threshold) -> DataFrame:
    """The rows of ``dealt`` whose points allow a link with a text of another component in their cell."""
    kept = ["key", "kind", "low", "high", "node", "component", "n", "is_major", "block"]
    out = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("node", pa.int64()),
                     ("component", pa.int64()), ("n", pa.int64()), ("is_major", pa.bool_()), ("block", pa.int32())])
    made = "key bigint, kind int, low int, high int, node bigint, component bigint, n bigint, is_major boolean, block int"

    def work(table: pa.Table) -> pa.Table | None:
        component, sizes = table["component"].to_numpy(), table["n"].to_numpy()
        if (component == component[0]).all():
            return None
        at = _points_of([np.frombuffer(v.as_buffer(), np.uint8) for v in table["point"]])
        met = np.zeros(len(at), bool)
        for a, b in _tree_pairs(table, at, threshold):
            open_ = (component[a] != component[b]) & ~(met[a] & met[b])
            a, b = a[open_], b[open_]
            fits = np.minimum(at[a], at[b]).sum(axis=1) >= threshold.overlap(sizes[a] + sizes[b])
            met[a[fits]] = met[b[fits]] = True
        return table.select(kept).filter(pa.array(met)).cast(out) if met.any() else None

    points_too = dealt.join(vectors.select("node", "point"), "node").select(*kept, "point")
    return _by_cell(points_too, n_rows // BUNDLE, work, out, made)


def _cell_links(table: pa.Table, threshold: Threshold) -> pa.Table | None:
    """Links (v1, v2) between texts of a cell that join components, each verified on the sets: fewer than texts."""
    node, label, sizes = table["node"].to_numpy(), table["component"].to_numpy().copy(), table["n"].to_numpy()
    sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in table["hashes"]]
    flat, ends = points(np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)]))
    at = _points_of([flat[a:b] for a, b in zip(ends[:-1], ends[1:])])
    found = []
    for a, b in _tree_pairs(table, at, threshold):
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        fits = np.minimum(at[a], at[b]).sum(axis=1) >= threshold.overlap(sizes[a] + sizes[b])
        a, b = a[fits], b[fits]
        while len(a):
            both = np.concatenate([sets[a[0]], sets[b[0]]])
            both.sort(kind="stable")
            if int((both[1:] == both[:-1]).sum()) >= threshold.overlap(len(both)):
                found.append((node[a[0]], node[b[0]]))
                label[label == label[b[0]]] = label[a[0]]
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
            else:
                a, b = a[1:], b[1:]
    return pa.table({"v1": pa.array([x for x, _ in found], pa.int64()), "v2": pa.array([y for _, y in found], pa.int64())}) if found else None


def _links_below(members: DataFrame, vectors: DataFrame, docs: DataFrame, shingle: int, threshold: Threshold) -> DataFrame:
    """Links (v1, v2) that join texts of different components below one ``key``; ``members``: key, node, component, major, n."""
    dealt = written(_cells(members), "dealt")
    near = written(_with_partners(dealt, vectors, dealt.count(), threshold), "near")
    sets = _sets(docs, near.select("node").distinct(), shingle)
    held = near.agg(F.count("*"), F.sum("n")).first()
    bundles = max(held[0] // BUNDLE, (held[1] or 0) // BUNDLE_SHINGLES)
    out = pa.schema([("v1", pa.int64()), ("v2", pa.int64())])
    return _by_cell(near.join(sets, "node"), bundles, lambda table: _cell_links(table, threshold), out, "v1 bigint, v2 bigint")


def _bounded(pairs: DataFrame, vectors: DataFrame, threshold: Threshold) -> DataFrame:
    """Pairs (a, b) that their count vectors allow."""
    left = vectors.select(F.col("node").alias("a"), F.col("n").alias("n_x"), F.col("point").alias("x"))
    right = vectors.select(F.col("node").alias("b"), F.col("n").alias("n_y"), F.col("point").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(4), batch.column(5), batch.column(2).to_numpy(), batch.column(3).to_numpy())
            fits = [may_link(x.as_buffer(), y.as_buffer(), n_x, n_y, threshold) for x, y, n_x, n_y in rows]
            yield batch.select([0, 1]).filter(pa.array(fits, pa.bool_()))

    # Sizes first: most pairs that only share a common passage end here, without their points.
    sizes = pairs.join(left.drop("x"), "a").join(right.drop("y"), "b")
    least = F.ceil(F.lit(threshold.least) * (F.col("n_x") + F.col("n_y")) / (100 + threshold.least))
    near = sizes.where(F.least("n_x", "n_y") >= least - 1).select("a", "b")
    joined = near.join(left, "a").join(right, "b").select("a", "b", "n_x", "n_y", "x", "y")
    bounded_batches(joined.sparkSession)
    return joined.mapInArrow(tidy(run), "a bigint, b bigint")


def link_components(
    docs: DataFrame, least: int = 80, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Each document with ``n_shingles``, ``class_id`` (smallest id with an equal set) and ``component_id``.

    ``component_id`` is the smallest id that links reach; two documents link when the Jaccard similarity of
    their sets of ``shingle`` words (A-Z in lower case) is at least ``least`` percent.
    """
    threshold = Threshold(least)
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")

    def start():
        def work(part: pa.RecordBatch):
            hashes, offsets = sets_of(part.column(0), shingle)
            name1, name2 = _set_names(hashes, offsets)
            counts, ends = points(hashes, offsets)
            return pa.RecordBatch.from_arrays(
                [part.column(1), pa.array(np.diff(offsets)), pa.array(name1), pa.array(name2),
                 packed(counts, ends)],
                ["id", "n", "name1", "name2", "point"],
            )

        return work

    made = "id bigint, n bigint, name1 bigint, name2 bigint, point binary"
    texts = written(rows_of(docs, "text", ["id"], made, start), "sets")
    classes = written(texts.where("n > 0").groupBy("n", "name1", "name2").agg(F.min("id").alias("node")), "classes")
    nodes = texts.where("n > 0").join(classes.select("node").withColumnRenamed("node", "id"), "id", "left_semi")

    def make(part: pa.RecordBatch):
        hashes, offsets = sets_of(part.column(0), shingle)
        keys, ends = roots(hashes, offsets, threshold)
        return keys, np.repeat(np.arange(part.num_rows), np.diff(ends)), _set_names(hashes, offsets)[0]

    # Texts below a common root, each with the first one there. Equal sets have one name, and so are one owner.
    total = texts.agg(F.sum("n")).first()[0] or 0
    met = shared_names(docs.select("text"), make, parts_for(total * 5 * (100 - least) / (100 + least)))
    named = classes.select(F.col("name1").alias("owner"), "node")
    # Each text once below a root: runs that hold copies of one text send its name and owner several times. The window needs
    # the rows by key too, so that is the one shuffle.
    rooted = written(met, "roots").join(named, "owner").select(F.col("name").alias("key"), "node").repartition("key").distinct()
    root = Window.partitionBy("key")
    shared = rooted.withColumn("first", F.min("node").over(root)).withColumn("last", F.max("node").over(root))
    shared = written(shared.where("first < last").select("key", "node", "first"), "roots")
    tried = written(shared.where("first < node").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "tried")
    vectors = written(nodes.select(F.col("id").alias("node"), "n", "point"), "points")
    allowed = written(_bounded(tried, vectors, threshold), "allowed")
    checked = written(_verify(allowed, _sets(docs, _ends(allowed), shingle), threshold), "checked")
    links = checked.where("linked").select(F.col("a").alias("v1"), F.col("b").alias("v2"))
    groups = _components(links)

    # Texts that still are of several components, but for the first one that they share a root with.
    placed = shared.select("first", "node").distinct().join(groups, "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    rest = written(placed.where("first < node").select(F.col("first").alias("key"), "node", "component"), "rest")
    several = rest.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2")
    majors = groups.select(F.col("node").alias("key"), F.col("component").alias("major"))
    members = rest.join(several.select("key").join(majors, "key", "left"), "key").join(vectors.select("node", "n"), "node")
    more = written(_links_below(members, vectors, docs, shingle, threshold), "more")
    if not more.isEmpty():
        links = links.unionAll(more)
        groups = _components(links)

    component = classes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return (
        texts.select("id", "n", "name1", "name2").join(component, ["n", "name1", "name2"], "left")
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("node", "id").alias("class_id"),
                F.coalesce("component", "id").alias("component_id"))
    )


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()


def _components(links: DataFrame) -> DataFrame:
    found = connected(links).select(F.col("value").alias("node"), F.col("canonical").alias("component"))
    return written(found, "components")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component, that of its smallest id. Rows without id stay.

    Rows of one id and one text count as one, the first by its columns. Different texts under one id are documents
    of their own, told apart by 64 bits of id and text. Only the keys of rows that go are sent around.
    """
    one, own_columns = F.col(f"`{id_col}`"), [F.col(f"`{n}`") for n in docs.columns]
    counts = docs.groupBy(one.alias("id")).count().where("count > 1 and id is not null")
    several = written(counts.select(F.col("id").alias("__id"), F.lit(True).alias("__several")), "several")
    keyed = docs.withColumn("__key", one.cast("bigint"))
    if not several.isEmpty():
        own = F.xxhash64(F.col("__key"), F.col(f"`{text_col}`").cast("string"))
        keyed = docs.join(_small(several), one == F.col("__id"), "left").withColumn("__key", one.cast("bigint"))
        keyed = keyed.withColumn("__key", F.when(F.col("__several"), own).otherwise(F.col("__key"))).drop("__id")
    placed = written(link_components(keyed, id_col="__key", text_col=text_col, **options), "placed").select("__key", "component_id")
    if several.isEmpty():
        going = placed.where("__key <> component_id").select("__key")
        return keyed.join(_small(written(going, "going")), "__key", "left_anti").select(*own_columns)
    named = written(placed.distinct().join(keyed.select("__key", one.alias("id")).distinct(), "__key"), "named")
    stays = named.groupBy("component_id").agg(F.min(F.struct("id", "__key")).getField("__key").alias("stays"))
    going = written(named.join(stays, "component_id").where("__key <> stays").select("__key"), "going")
    kept = keyed.join(_small(going), "__key", "left_anti")
    # An aggregation, so that one row repeated very often is combined before the shuffle.
    whole = F.struct(*own_columns)
    repeated = kept.where("__several").groupBy("__key").agg(F.min(whole).alias("row")).select("row.*")
    return kept.where("__several is null").select(*own_columns).unionAll(repeated)
