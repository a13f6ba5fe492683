"""Shards of nearly equal size from a contiguous partition of atomic groups.

Rows with equal text form one atomic group. Groups are ordered by a 64-bit hash of the text
and cut into contiguous runs; the largest run is as small as any such cut allows. The
capacity is found by binary search, each candidate checked by filling shards greedily.

The search never holds all groups. It works on *atoms*: hash ranges with the number and the
bytes of their groups, a bounded table. Treating an atom of several groups as one block gives
an upper bound of the capacity, treating it as divisible a lower one; only atoms in which some
cut may fall for a capacity between the two are split into finer ranges by another
aggregation, until every such atom is a single group and both bounds agree.

A group with at least the mean size of what is left gets a shard of its own before that, so
that a text that is copied through a third of the table neither raises the capacity of
the other shards nor leaves some of them empty.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import bucketed_row_number
from ..session import materialize
from .common import text_bytes

#: Atoms of the first pass, and the most that one refinement may ask for, as powers of two.
FIRST_BITS, REFINE_BITS = 12, 17

#: Rows that share a numbering task on average.
SLOT_ROWS = 50_000


@dataclass
class ShardPlan:
    """Where to cut: ``alone`` lists the keys with shards of their own, from shard 0 on; a
    key of another group is in the first shard after them plus the number of ``cuts`` up to
    it. ``capacity`` is the size of the largest shard that is not a single group."""

    n_shards: int
    alone: list[int] = field(default_factory=list)
    cuts: list[int] = field(default_factory=list)
    capacity: int = 0

    def shard(self, key: Column) -> Column:
        """Shard number of a group key."""
        found = F.lit(len(self.alone)).cast("int")
        for cut in self.cuts:
            found = found + (key >= F.lit(cut)).cast("int")
        for number, alone in enumerate(self.alone):
            found = F.when(key == F.lit(alone), F.lit(number)).otherwise(found)
        return found.cast("int")


def group_key(text: Column) -> Column:
    """Hash of the text; NULL and the empty text share a group."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def document_size(text: Column) -> Column:
    """Bytes of a document in a shard: its UTF-8 text and one end mark."""
    return text_bytes(text) + 1


class _Atoms:
    """Ordered atoms: first key, width of the key range in bits, groups and bytes."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        rows.sort()
        self.rows = rows
        self.sizes = np.array([r[3] for r in rows], dtype=np.int64)
        self.single = np.array([r[2] == 1 for r in rows], dtype=bool)
        self.ends = np.concatenate([[0], np.cumsum(self.sizes)])
        self.total = int(self.ends[-1])

    def block_fill(self, capacity: int, shards: int) -> list[int]:
        """Greedy cut positions with whole atoms."""
        cuts, at = [], 0
        for _ in range(shards):
            at = int(self.ends[np.searchsorted(self.ends, at + capacity, side="right") - 1])
            cuts.append(at)
        return cuts

    def fluid_fill(self, capacity: int, shards: int) -> list[int]:
        """Greedy cut positions where atoms of several groups can be cut anywhere."""
        cuts, at = [], 0
        for _ in range(shards):
            at = min(at + capacity, self.total)
            inside = int(np.searchsorted(self.ends, at, side="right") - 1)
            if inside < len(self.single) and self.single[inside]:
                at = int(self.ends[inside])
            cuts.append(at)
        return cuts

    def smallest(self, fill, shards: int) -> int:
        """Binary search for the smallest capacity with which ``fill`` gets to the end."""
        low, high = math.ceil(self.total / shards), max(self.total, 1)
        while low < high:
            middle = (low + high) // 2
            if fill(middle, shards)[-1] == self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def open_atoms(self, low: int, high: int, shards: int) -> list[int]:
        """Atoms of several groups in which a greedy cut may fall for some capacity."""
        found: set[int] = set()
        first, last = self.block_fill(low, shards), self.fluid_fill(high, shards)
        for a, b in zip(first[:-1], last[:-1], strict=True):
            start = int(np.searchsorted(self.ends, a, side="right") - 1)
            stop = int(np.searchsorted(self.ends, b, side="left"))
            found.update(i for i in range(start, min(stop, len(self.rows))) if not self.single[i])
        return sorted(found)

    def even_cuts(self, capacity: int, shards: int) -> list[int]:
        """Cut positions near equal sizes, no shard above the capacity.

        Filling from the end gives the earliest place each cut may have; between it and the
        place where the shard is full, the boundary next to the mean of the rest is taken.
        """
        earliest, at = [], self.total
        for _ in range(shards):
            at = int(self.ends[np.searchsorted(self.ends, at - capacity, side="left")])
            earliest.append(at)
        earliest = earliest[::-1][1:]  # where the shards after each cut can start
        cuts, at = [], 0
        for done, least in enumerate(earliest):
            wish = at + (self.total - at) / (shards - done)
            place = int(np.searchsorted(self.ends, wish))
            near = [self.ends[i] for i in (place - 1, place) if 0 <= i < len(self.ends)]
            cut = int(min(near, key=lambda x: abs(x - wish)))
            full = int(self.ends[np.searchsorted(self.ends, at + capacity, side="right") - 1])
            at = min(max(cut, least, at), full)
            cuts.append(at)
        return cuts


def _atom_rows(groups: DataFrame, bits: int) -> list[tuple[int, int, int, int]]:
    """One row per range of ``2 ** bits`` keys; at most as many as its caller asks for."""
    rows = (
        groups.groupBy(F.shiftright("key", bits).alias("atom"))
        .agg(F.count("*").alias("groups"), F.sum("bytes").alias("bytes"))
        .collect()
    )
    return [(r.atom << bits, bits, r.groups, r.bytes) for r in rows]


def plan_shards(groups: DataFrame, n_shards: int) -> ShardPlan:
    """Minimax contiguous partition of ``groups`` (``key`` long and unique, ``bytes`` long).

    Ties need no rule: cuts lie between keys. An empty table gives empty shards, and so does
    a table with fewer groups than shards.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    heavy = groups.orderBy(F.desc("bytes"), "key").limit(max(n_shards - 1, 1)).collect()
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).head()[0]
    plan, left = ShardPlan(n_shards), n_shards
    for row in heavy:
        if left == 1 or row.bytes * left < total:
            break
        plan.alone.append(row.key)
        total, left = total - row.bytes, left - 1
    rest = groups.filter(~F.col("key").isin(plan.alone)) if plan.alone else groups
    first_bits = max(FIRST_BITS, math.ceil(math.log2(64 * n_shards)))
    atoms = _Atoms(_atom_rows(rest, 64 - first_bits))
    while True:
        low = atoms.smallest(atoms.fluid_fill, left)
        high = atoms.smallest(atoms.block_fill, left)
        opened = atoms.open_atoms(low, high, left)
        if not opened:
            break
        finer: list[tuple[int, int, int, int]] = []
        for bits in {atoms.rows[i][1] for i in opened}:
            parents = [atoms.rows[i][0] >> bits for i in opened if atoms.rows[i][1] == bits]
            step = max(1, REFINE_BITS - math.ceil(math.log2(len(parents) + 1)))
            inside = rest.filter(F.shiftright("key", bits).isin(parents))
            finer += _atom_rows(inside, max(bits - step, 0))
        drop = set(opened)
        atoms = _Atoms([r for i, r in enumerate(atoms.rows) if i not in drop] + finer)
    plan.capacity = high
    starts = [r[0] for r in atoms.rows]
    for place in atoms.even_cuts(high, left):
        at = int(np.searchsorted(atoms.ends, place))
        plan.cuts.append(starts[at] if at < len(starts) else 2**63 - 1)
    return plan


def text_groups(docs: DataFrame) -> DataFrame:
    """``key`` and ``bytes`` of every group of equal texts; partial sums come first."""
    rows = docs.select(group_key(F.col("text")).alias("key"), document_size(F.col("text")).alias("n"))
    return rows.groupBy("key").agg(F.sum("n").alias("bytes"))


def shard_documents(docs: DataFrame, n_shards: int) -> DataFrame:
    """``docs`` with ``shard`` (int): shards of nearly equal bytes, equal texts together.

    Needs ``text``. NULL and empty texts count one byte each and stay together. Columns
    beyond that pass through; one called ``shard`` is replaced. An empty table stays empty.
    """
    plan = plan_shards(materialize(text_groups(docs), "shard-groups"), n_shards)
    return docs.withColumn("shard", plan.shard(group_key(F.col("text"))))


def shard_slots(docs: DataFrame, n_shards: int) -> DataFrame:
    """Where every document goes: ``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot``.

    Slots count from 0 without gaps in each shard. The order is by a hash of ``doc_id``, then
    ``doc_id`` and ``text_crc32``; it splits a shard over as many tasks as it needs. Equal
    rows get neighbouring slots. One row out per row in, NULL ``doc_id`` included.
    """
    text = F.col("text")
    rows = materialize(
        docs.select(
            "doc_id",
            document_size(text).alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            group_key(text).alias("key"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    plan = plan_shards(materialize(groups, "shard-groups"), n_shards)
    buckets = 64 + rows.count() // (n_shards * SLOT_ROWS)
    numbered = bucketed_row_number(
        rows.withColumn("shard", plan.shard(F.col("key"))),
        ["shard"],
        F.pmod(F.xxhash64("doc_id"), F.lit(buckets)),
        [F.col("doc_id"), F.col("text_crc32")],
        "_slot",
    )
    slot = (F.col("_slot") - 1).cast("long").alias("slot")
    return numbered.select("doc_id", "size", "text_crc32", "shard", slot)
