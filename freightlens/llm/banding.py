"""Links between nodes that share a band, each decided by a comparison of their bodies.

A node is one distinct text or fingerprint. Nodes that share a band key are
candidates. Every node is first compared with the leader of each of its bands,
the least node there: so many pairs as there are nodes in bands, not all pairs. The links
found make classes. Only bands whose nodes are still in different classes go on:
there the largest class needs no comparison inside, so its nodes meet those of
the other classes only, and those meet one another. Bands are dealt into parts,
and each two parts that must meet do so in a cell of their own; a task holds two
parts at a time, however crowded a band is.

Inside a cell a BK-tree over the nodes' 64-bit marks (SimHashes) picks who is compared:
only edges within the radius are followed. A radius of 64 compares all.

No link between two nodes that share a band is lost but those whose marks are
further apart than the radius.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, gathered, shuffle_width
from .components import components

#: Bands are joined by a broadcast if so few of them have two nodes (24 bytes each), by a shuffle otherwise.
BROADCAST_BANDS = 300_000
#: Sum of the nodes' sizes in one part of a crowded band.
PART_SIZE = 2_000_000


class BKTree:
    """A BK-tree of integers under Hamming distance: children are keyed by their distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Position of the value, which is inserted unless it's there."""
        at = 0
        while self.values:
            d = (self.values[at] ^ value).bit_count()
            if not d:
                return at
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = len(self.values)
                break
            at = below
        self.values.append(value)
        self.children.append({})
        return len(self.values) - 1

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of all values at most ``radius`` bits from ``value``."""
        found, open_ = [], [0] if self.values else []
        while open_:
            at = open_.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            children = self.children[at]
            if children:
                open_.extend(children[k] for k in range(d - radius, d + radius + 1) if k in children)
        return found


class Forest:
    """Disjoint sets of the numbers from 0; the least of a set is its root."""

    def __init__(self) -> None:
        self.parent: list[int] = []

    def add(self) -> int:
        """A new set of one."""
        self.parent.append(len(self.parent))
        return len(self.parent) - 1

    def root(self, i: int) -> int:
        """The least of the set."""
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> None:
        """Make one set of two."""
        a, b = self.root(i), self.root(j)
        self.parent[max(a, b)] = min(a, b)


def cell_links(rows: list[tuple], alike: Callable[[object, object], bool], radius: int) -> list[tuple[int, int]]:
    """Links of one cell that join all alike: rows are (part, label, own, mark, body), bodies prepared for ``alike``.

    Nodes of one label are linked already. In a cell of two parts only nodes of different parts are
    compared: the tree holds the first part's marks and is searched for the second part's.
    """
    rows = sorted(rows, key=lambda r: r[0])
    first_part = rows[0][0] if rows else 0
    two = bool(rows) and rows[-1][0] != first_part
    tree, holders, forest = BKTree(), [], Forest()
    label_of: dict[int, int] = {}
    for _, label, *_ in rows:
        new = forest.add()
        forest.join(label_of.setdefault(label, new), new)
    out = []
    for new, (part, _, own, mark, body) in enumerate(rows):
        if not two or part != first_part:
            for at in tree.within(mark, radius):
                for i in holders[at]:
                    if forest.root(i) != forest.root(new) and alike(rows[i][4], body):
                        forest.join(i, new)
                        out.append((own, rows[i][2]))
        if not two or part == first_part:
            at = tree.add(mark)
            if at == len(holders):
                holders.append([])
            holders[at].append(new)
    return out


def _table(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["a", "b"])


def banded_classes(nodes: DataFrame, bodies: DataFrame, prepare: Callable[[str], object], alike: Callable[[object, object], bool], radius: int = 64, ratio: float = 0.0, part_size: int | None = None) -> DataFrame:
    """``own`` and ``label`` (least own of the class) of every node that is linked to another.

    ``nodes`` has ``own`` (long) with its band ``keys`` (array of long), ``size`` and ``mark`` (long); it's read
    several times, so its lineage should be short. ``bodies`` has ``own`` and ``body``. Rows of both may repeat. Nodes whose
    sizes are further apart than ``ratio`` can't be alike. ``part_size`` bounds the sizes in one part of a crowded band.
    """
    width, part_size = shuffle_width(nodes.sparkSession), part_size or PART_SIZE
    banded = nodes.select(F.explode("keys").alias("key"), "own", "mark", "size")
    # at most one row a band, and only bands with two nodes
    leads = cut_lineage(
        banded.groupBy("key").agg(F.min(F.struct("own", "mark", "size")).alias("lead"), F.max("own").alias("last"))
        .where("lead.own < last").select("key", F.col("lead.own").alias("lead"), F.col("lead.mark").alias("lead_mark"), F.col("lead.size").alias("lead_size"), "last")
    )
    n_leads = leads.count()
    some = F.broadcast(leads) if n_leads <= BROADCAST_BANDS else leads
    near = (F.bit_count(F.col("mark").bitwiseXOR(F.col("lead_mark"))) <= radius) & (F.least("size", "lead_size") >= ratio * F.greatest("size", "lead_size") - 1e-6)
    pairs = cut_lineage(banded.join(some, "key").where(F.col("own") != F.col("lead")).where(near).select(F.col("own").alias("a"), F.col("lead").alias("b")).distinct())
    n_pairs = pairs.count()
    if not n_pairs:
        return pairs.select(F.col("a").alias("own"), F.col("b").alias("label"))
    pairs = gathered(pairs, n_pairs)
    wanted = gathered(pairs.select(F.col("a").alias("own")).unionByName(pairs.select(F.col("b").alias("own"))).distinct(), 2 * n_pairs)
    wanted = F.broadcast(wanted) if 2 * n_pairs <= BROADCAST_BANDS else wanted
    texts = bodies.join(wanted, "own", "left_semi").groupBy("own").agg(F.first("body").alias("body"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, kept = None, None
        for batch in batches:
            found = []
            for a, b, own, other in zip(*(batch.column(i) for i in range(4)), strict=True):
                a, b = a.as_py(), b.as_py()
                if b != lead:
                    lead, kept = b, prepare(other.as_py())
                if alike(kept, prepare(own.as_py())):
                    found.append((a, b))
            yield _table(found)

    met = (
        pairs.join(texts.withColumnsRenamed({"own": "a", "body": "own_body"}), "a")
        .join(texts.withColumnsRenamed({"own": "b", "body": "lead_body"}), "b").select("a", "b", "own_body", "lead_body")
    )
    first = cut_lineage(gathered(components(met.mapInArrow(compare, "a long, b long")).withColumnRenamed("node", "own"), 2 * n_pairs))

    # bands of three nodes that are not one class yet; a band of two is settled
    ends = F.broadcast(leads.select("key", "lead", "last")) if n_leads <= BROADCAST_BANDS else leads.select("key", "lead", "last")
    crowded = banded.join(ends, "key").where("own <> lead AND own <> last").select("key").distinct()
    n_crowded = crowded.count()
    if not n_crowded:
        return first
    crowded = F.broadcast(crowded) if n_crowded <= BROADCAST_BANDS else crowded
    held = banded.join(crowded, "key").distinct().join(first, "own", "left").withColumn("label", F.coalesce("label", "own"))
    held = cut_lineage(held)
    of_class = held.groupBy("key", "label").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("own")).alias("name"))
    of_band = of_class.groupBy("key").agg(
        F.count(F.lit(1)).alias("classes"), F.max_by("label", F.struct("weight", "label")).alias("big"), F.max("weight").alias("big_weight"),
        F.sum("weight").alias("all_weight"), F.bit_xor("name").alias("name"), F.sum("members").alias("members"),
    ).where("classes > 1")
    # bands of the same nodes are compared once
    mixed = cut_lineage(of_band.groupBy("name", "members").agg(F.min_by(F.struct("key", "big", "big_weight", "all_weight"), "key").alias("band")).select("band.*"))
    n_mixed = mixed.count()
    if not n_mixed:
        return first
    parts = mixed.select(
        "key", "big", F.greatest(F.lit(1), F.ceil((F.col("all_weight") - F.col("big_weight")) / part_size)).cast("int").alias("rest_parts"),
        F.greatest(F.lit(1), F.ceil(F.col("big_weight") / part_size)).cast("int").alias("big_parts"),
    )
    parts = F.broadcast(parts) if n_mixed <= BROADCAST_BANDS else parts
    is_big = F.col("label") == F.col("big")
    count = F.when(is_big, F.col("big_parts")).otherwise(F.col("rest_parts"))
    part = F.pmod(F.xxhash64("own"), count).cast("int") + F.when(is_big, F.col("rest_parts")).otherwise(0)
    last = F.when(is_big, F.col("rest_parts")).otherwise(F.col("rest_parts") + F.col("big_parts")) - 1
    meets = F.transform(F.sequence(F.lit(0), "last"), lambda other: F.struct(F.least("part", other).alias("low"), F.greatest("part", other).alias("high")))
    dealt = (
        held.join(parts, "key").withColumns({"part": part, "last": last}).select("key", F.explode(meets).alias("cell"), "part", "label", "own", "mark")
        .select("key", "cell.low", "cell.high", "part", "label", "own", "mark")
    )
    wanted = cut_lineage(held.join(parts.select("key"), "key").select("own").distinct())
    n_wanted = wanted.count()
    wanted = F.broadcast(wanted) if n_wanted <= BROADCAST_BANDS else wanted
    texts = bodies.join(wanted, "own", "left_semi").groupBy("own").agg(F.first("body").alias("body"))
    cells = dealt.join(texts, "own").select("key", "low", "high", "part", "label", "own", "mark", "body")
    cells = cells.repartition(width, "key", "low", "high").sortWithinPartitions("key", "low", "high", "own")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []
        for batch in batches:
            found = []
            fixed = [batch.column(i).to_pylist() for i in range(7)]
            for *key, part, label, own, mark, body in zip(*fixed, batch.column(7), strict=True):
                if key != cell:
                    found += cell_links(rows, alike, radius)
                    cell, rows = key, []
                rows.append((part, label, own, mark & (1 << 64) - 1, prepare(body.as_py())))
            yield _table(found)
        yield _table(cell_links(rows, alike, radius))

    second = cut_lineage(cells.mapInArrow(settle, "a long, b long").distinct())
    of = first.withColumnRenamed("label", "to")
    linked = (
        second.join(of.withColumnsRenamed({"own": "a", "to": "u"}), "a", "left").join(of.withColumnsRenamed({"own": "b", "to": "v"}), "b", "left")
        .select(F.coalesce("u", "a").alias("a"), F.coalesce("v", "b").alias("b"))
    )
    joined = components(linked).select(F.col("node").alias("label"), F.col("label").alias("whole"))
    # classes that grew, and single nodes that the second comparison linked
    labels = first.unionByName(second.select(F.explode(F.array("a", "b")).alias("own")).distinct().join(first, "own", "left_anti").select("own", F.col("own").alias("label")))
    return labels.join(joined, "label", "left").select("own", F.coalesce("whole", "label").alias("label"))
