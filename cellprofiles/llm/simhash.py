"""Near-duplicate documents: SimHash fingerprints linked within a Hamming radius by BK-trees.

Fingerprints that differ in at most ``radius`` bits are linked; documents connected by links
form a group. Equal fingerprints are one node, so exact copies cost nothing.

Trees are built per shard, and a shard is made so that links cannot leave all shards at once:
of ``radius + 1`` bands of bits, two linked fingerprints agree in one band at least, so each
fingerprint goes to one shard per band, by the value of the band. A shard with more than
``SHARD_NODES`` fingerprints is dealt out again by bands of the bits that are not yet equal in
it; the argument holds again, so this is exact and no shard stays large unless its
fingerprints differ in a few bits only. Inside a shard each fingerprint walks the BK-tree of
those before it: the children of a node are keyed by their distance to it, and only edges
within the radius of the own distance are followed. Only links that join two parts of a shard
are passed on, fewer than the shard has fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Bits of a fingerprint, and bits in which linked ones may differ.
BITS, RADIUS = 64, 4

#: Words of a shingle.
SHINGLE = 4

#: Seed of the shingle hash.
SEED = 42

#: Fingerprints of a shard from which on it is dealt out again, and how often at most; after
#: three times no more than some 30 bits can differ within a shard.
SHARD_NODES, MOST_LEVELS = 1024, 3

#: Hashes whose bits are counted at once.
_COUNT_AT_ONCE = 1 << 16


def _fingerprint(text: bytes | None, size: int, digest) -> int:
    words = text.lower().split() if text else []
    if not words:
        return 0
    size = min(size, len(words))
    line = b" ".join(words)
    stops = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], stops[:-1] + 1])
    cuts = zip(starts[: len(words) - size + 1].tolist(), stops[size - 1 :].tolist(), strict=True)
    hashes = np.array([digest(line[a:b], SEED) for a, b in cuts], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), _COUNT_AT_ONCE):
        part = hashes[at : at + _COUNT_AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprint(text: Column) -> Column:
    """SimHash of a text as a signed 64-bit number.

    Words are stretches without ASCII white space after lower-casing A-Z; a bit is set if more
    than half of the shingles' hashes (XXH64 of their UTF-8 bytes) have it, repeats counted. A
    text of fewer words than a shingle is one shingle; NULL and a text without words give 0.
    """

    @F.pandas_udf("long")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            found = [_fingerprint(text, SHINGLE, xxh64_intdigest) for text in batch]
            yield pd.Series(found, dtype="int64")

    return scan(text.cast("binary"))


class BKTree:
    """Metric tree of fingerprints; ``children`` of a node map a distance to a node."""

    def __init__(self, radius: int):
        self.radius, self.values, self.children = radius, [], []

    def find(self, value: int) -> list[int]:
        """Nodes within the radius."""
        found, radius, values, children = [], self.radius, self.values, self.children
        todo = [0] if values else []
        while todo:
            node = todo.pop()
            distance = (values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            below = children[node]
            if len(below) > 2 * radius + 1:
                span = range(distance - radius, distance + radius + 1)
                todo += [below[edge] for edge in span if edge in below]
            else:
                todo += [n for edge, n in below.items() if abs(edge - distance) <= radius]
        return found

    def add(self, value: int) -> int:
        new, node = len(self.values), 0
        self.values.append(value)
        self.children.append({})
        while new:
            distance = (self.values[node] ^ value).bit_count()
            after = self.children[node].setdefault(distance, new)
            if after == new:
                break
            node = after
        return new


def link_shard(fingerprints: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect what the radius connects within one shard."""
    tree, parent, links = BKTree(radius), [], []

    def top(node: int) -> int:
        while parent[node] != node:
            parent[node] = parent[parent[node]]
            node = parent[node]
        return node

    mask = (1 << BITS) - 1
    for value in fingerprints:
        near = tree.find(value & mask)
        parent.append(tree.add(value & mask))
        for node in near:
            root, own = top(node), top(len(parent) - 1)
            if root != own:
                parent[max(root, own)] = min(root, own)
                links.append((fingerprints[max(root, own)], fingerprints[min(root, own)]))
    return links


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _masks(radius: int, levels: int) -> list[list[int]]:
    """Bits that a shard has in common, for each level and path of bands.

    Path p of one level goes on as the paths p * (radius + 1) + band of the next: the bits that
    p leaves free are dealt out to the bands in turn.
    """
    masks = [[0]]
    for _ in range(levels):
        level = []
        for mask in masks[-1]:
            free = [bit for bit in range(BITS) if not mask >> bit & 1]
            bands = [free[band :: radius + 1] for band in range(radius + 1)]
            level += [mask | sum(1 << bit for bit in band) for band in bands]
        masks.append(level)
    return masks[1:]


def _link_sorted(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Links of the shards of one partition, which comes sorted by shard."""
    shard, own, links = None, [], []
    for batch in batches:
        keys = zip(batch.level.tolist(), batch.path.tolist(), batch.key.tolist(), strict=True)
        for key, value in zip(keys, batch.fp.tolist(), strict=True):
            if key != shard:
                if len(own) > 1:
                    links += link_shard(own, radius)
                shard, own = key, []
            own.append(value)
        yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")
        links = []
    if len(own) > 1:
        links = link_shard(own, radius)
    yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def similar_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a``, ``b`` that connect all fingerprints (``fp``, unique) within the radius.

    Two fingerprints are connected by the links if and only if a chain of fingerprints joins
    them in which neighbours differ in at most ``radius`` bits.
    """
    left = nodes.select("fp", F.lit(0).alias("path"))
    shards = []
    masks = _masks(radius, MOST_LEVELS)
    for level, of_level in enumerate(masks):
        mask = F.array(*[F.lit(_signed(m)).cast("long") for m in of_level])
        bands = F.array(*[F.col("path") * (radius + 1) + band for band in range(radius + 1)])
        rows = left.select("fp", F.explode(bands).alias("path"))
        key = F.col("fp").bitwiseAND(F.element_at(mask, F.col("path") + 1)).alias("key")
        rows = rows.select("fp", "path", key, F.lit(level).alias("level"))
        if level + 1 < len(masks):
            rows = materialize(rows, "simhash-bands")
            hot = rows.groupBy("path", "key").count().filter(F.col("count") > SHARD_NODES)
            hot = materialize(hot.select("path", "key"), "simhash-hot")
            if hot.isEmpty():
                shards.append(rows)
                break
            shards.append(rows.join(hot, ["path", "key"], "left_anti"))
            left = rows.join(hot, ["path", "key"], "left_semi")
        else:
            shards.append(rows)
    everything = shards[0].select("level", "path", "key", "fp")
    for more in shards[1:]:
        everything = everything.union(more.select("level", "path", "key", "fp"))
    together = everything.repartition("level", "path", "key")
    together = together.sortWithinPartitions("level", "path", "key")
    found = together.mapInPandas(lambda b: _link_sorted(b, radius), "a long, b long")
    return found.distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is connected with, for all ends of ``links``.

    Every round gives a node the smallest root among its neighbours and then that root's own
    root, so distances halve. Rounds are written to the shared folder.
    """
    ends = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    ends = materialize(ends.distinct(), "links")
    roots = ends.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    while True:
        near = ends.join(roots, ends.b == roots.node).groupBy("a").agg(F.min("root").alias("near"))
        least = roots.join(near, roots.node == near.a).select(
            "node", F.col("root").alias("before"), F.least("root", "near").alias("root")
        )
        least = materialize(least, "roots")
        above = least.select(F.col("node").alias("up"), F.col("root").alias("top"))
        jumped = least.join(above, least.root == above.up).select(
            "node", "before", F.col("top").alias("root")
        )
        jumped = materialize(jumped, "roots")
        roots = jumped.select("node", "root")
        if jumped.filter("before != root").isEmpty():
            return roots


def fingerprint_groups(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp`` and ``component_id``, the smallest ``doc_id`` of its group, for all of ``rows``."""
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "simhash-nodes")
    links = materialize(similar_links(nodes, radius), "simhash-links")
    roots = connected_components(links)
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "doc_id", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return materialize(rooted.join(least, "root").select("fp", "component_id"), "simhash-groups")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``fp`` (signed long) and ``component_id`` of every row of ``docs``.

    Needs ``doc_id`` and ``text``. NULL texts and texts without words have fingerprint 0, which
    is linked like any other. Repeated rows share a fingerprint. NULL ids are never the
    smallest; a group without any id has a NULL ``component_id``. Empty in, empty out.
    """
    rows = materialize(docs.select("doc_id", fingerprint(F.col("text")).alias("fp")), "simhash-rows")
    return rows.join(fingerprint_groups(rows, radius), "fp")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each group of ``docs``: that with the smallest ``doc_id``, columns as before.

    Rows that share this id are ordered by a hash of all their columns, and of rows that are
    equal in both one is kept. Rows with a NULL id come last. Other columns pass through,
    whatever their names.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    parts = [
        F.to_json(F.col(f"_row.`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"_row.`{f.name}`")
        for f in docs.schema
    ]
    packed = packed.withColumn("_hash", F.xxhash64(*parts)).withColumn("_id", F.col("_row.doc_id"))
    rows = packed.select(
        F.col("_id").alias("doc_id"), "_hash", fingerprint(F.col("_row.text")).alias("fp")
    )
    rows = materialize(rows, "simhash-rows")
    grouped = rows.join(fingerprint_groups(rows, radius), "fp")
    grouped = grouped.groupBy("component_id", F.when(F.isnull("component_id"), F.col("fp")), "doc_id", "_hash")
    grouped = grouped.agg(F.count("*").alias("copies"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_hash", "copies")
    kept = grouped.groupBy(*grouped.columns[:2]).agg(F.min(order).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("id"), F.col("k._hash").alias("hash"), "k.copies")
    kept = materialize(kept, "simhash-kept")

    def chosen(which: DataFrame) -> DataFrame:
        # the ids are the small side; hashing them spares sorting whole documents
        right = which.hint("shuffle_hash").alias("k")
        return packed.alias("f").join(right, F.expr("f._id <=> k.id AND f._hash = k.hash"), "left_semi")

    found = chosen(kept.filter("copies = 1"))
    repeated = kept.filter("copies > 1")
    if not repeated.isEmpty():
        found = found.unionByName(chosen(repeated).dropDuplicates(["_id", "_hash"]))
    return found.select("_row.*")
