"""Merkle manifest of a dataset, with multiproofs per partition of leaves.

Every row is a leaf: the SHA-256 digest of its fields. The leaves of a group (a language) form a tree
in the order of their ids, in which every 8 neighbours (fewer at the end) become the digest of
their digests, until one is left, the subroot. The subroots form a tree of the same kind in the
order of their groups; its root stands for the dataset. Digests are lowercase hexadecimal text
when they are hashed, and 32 bytes in tables.

The tree is built in rounds of four levels: a task folds one run of 8^4 neighbours, so a dataset of n rows
takes log(n) / log(4096) rounds, each on a 4096th of the nodes of the round before.

Proofs are made for whole partitions of leaves at once, as an octopus multiproof: level by level, the
partition knows which nodes it can derive from its own leaves, and the siblings it lacks are the
coordinates it asks for. That minimal union is fetched once, by one join; then the partition
derives the shared interior nodes and expands the proof of each of its leaves by itself.

Rows with the same id are ordered by their digests; rows that are alike in all fields are
interchangeable. NULL ids and NULL groups come first, each NULL field is a dash. Texts of any length
are hashed whole. An empty table has no root and no proofs. All columns that a caller wants back
travel in one struct, so their names cannot clash with others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranking import global_row_index
from ..session import materialize

#: Children of a node, as a power of two.
FAN_BITS = 3

#: Levels that a task folds at once; 8^4 leaves are a partition.
ROUND_LEVELS = 4
_ROUND_BITS = FAN_BITS * ROUND_LEVELS

#: Number of the tree of subroots; the groups' trees are numbered from 0.
TOP = -1

_FAN = 1 << FAN_BITS
_NODE = "tree bigint, level int, index bigint, size bigint, digest binary"


@dataclass(frozen=True)
class Manifest:
    """``leaves``: struct ``row``, ``tree``, ``index`` and ``size`` of the tree, ``leaf``, ``shown``.
    ``nodes``: the nodes of all trees by (``tree``, ``level``, ``index``), level 0 included."""

    leaves: DataFrame
    nodes: DataFrame
    n_trees: int
    root: str | None


def digest_of(fields: Sequence[Column]) -> Column:
    """Digest of a row: each field as UTF-8 byte count, colon and value, or a dash if NULL."""

    def framed(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(framed, fields)), 256)


def build_manifest(
    rows: DataFrame,
    group: Column,
    order: Column,
    fields: Sequence[Column],
    keep: Sequence[str],
    shown: Column | None = None,
) -> Manifest:
    """Hash all rows and build their trees. ``shown`` is the digest that a holder shows for a row
    when its proof is checked, the leaf where it is NULL (default: everywhere)."""
    leaf = F.unhex(digest_of(fields))
    other = F.lit(None).cast("binary") if shown is None else F.unhex(shown)
    hashed = rows.select(
        F.struct(*keep).alias("row"),
        group.alias("group"),
        order.alias("order"),
        leaf.alias("leaf"),
        other.alias("shown"),
    )
    # The last sort key parts rows that are alike, so that any number of them can be dealt out.
    hashed = materialize(hashed, "leaves").withColumn("copy", F.monotonically_increasing_id())
    placed = global_row_index(hashed, ["group", "order", "leaf", "copy"], "place")
    groups = placed.groupBy("group").agg(F.min("place").alias("start"), F.count("*").alias("size"))
    groups = materialize(global_row_index(groups, ["group"], "tree"), "groups")
    n_trees, largest = groups.agg(F.count("*"), F.max("size")).first()
    leaves = placed.join(groups.withColumnRenamed("group", "_group"), F.col("group").eqNullSafe(F.col("_group")))
    index = (F.col("place") - F.col("start")).alias("index")
    leaves = materialize(leaves.select("row", "tree", index, "size", "leaf", "shown"), "placed-leaves")

    first = leaves.select("tree", F.lit(0).alias("level"), "index", "size", F.col("leaf").alias("digest"))
    lower = _climb(first, largest or 0)
    subroots = lower.where(F.col("level") == _height(F.col("size")))
    top = subroots.select(
        F.lit(TOP).cast("bigint").alias("tree"),
        F.lit(0).alias("level"),
        F.col("tree").alias("index"),
        F.lit(n_trees).cast("bigint").alias("size"),
        "digest",
    )
    upper = _climb(materialize(top, "subroots"), n_trees)
    last = upper.where(F.col("level") == _height(F.col("size"))).select(F.lower(F.hex("digest"))).first()
    return Manifest(leaves, lower.unionByName(upper), n_trees, last[0] if last else None)


def _height(size: Column) -> Column:
    """Levels above the leaves: how many powers of 8 from 8^0 on are below the size."""
    steps = [(size > 8**k).cast("int") for k in range(21)]
    return sum(steps[1:], steps[0])


def height(size: int) -> int:
    return next(k for k in range(22) if _FAN**k >= size)


def _climb(nodes: DataFrame, largest: int) -> DataFrame:
    """``nodes`` of level 0 with all nodes above them, four levels a round."""
    found, level = nodes, 0
    while level < height(max(largest, 1)):
        above = nodes.where(_height(F.col("size")) > level)
        above = above.groupBy("tree", F.shiftright("index", _ROUND_BITS).alias("run"))
        above = materialize(above.applyInArrow(_fold_run, _NODE), "nodes")
        found, level = found.unionByName(above), level + ROUND_LEVELS
        nodes = above.where(F.col("level") == level)
    return found


def _parents(level: dict[int, str]) -> dict[int, str]:
    """The nodes above a level of which all children are there."""
    runs: dict[int, list[str]] = {}
    for index in sorted(level):
        runs.setdefault(index >> FAN_BITS, []).append(level[index])
    return {run: hashlib.sha256("".join(digests).encode()).hexdigest() for run, digests in runs.items()}


def _fold_run(run: pa.Table) -> pa.Table:
    tree, base, size = (run.column(c)[0].as_py() for c in ("tree", "level", "size"))
    digests = (d.hex() for d in run.column("digest").to_pylist())
    nodes = dict(zip(run.column("index").to_pylist(), digests))
    out: list[tuple[int, int, bytes]] = []
    for level in range(base + 1, min(base + ROUND_LEVELS, height(size)) + 1):
        nodes = _parents(nodes)
        out += [(level, index, bytes.fromhex(digest)) for index, digest in nodes.items()]
    levels, indices, found = zip(*out)
    return pa.table(
        {
            "tree": pa.array([tree] * len(out), pa.int64()),
            "level": pa.array(levels, pa.int32()),
            "index": pa.array(indices, pa.int64()),
            "size": pa.array([size] * len(out), pa.int64()),
            "digest": pa.array(found, pa.binary()),
        }
    )


# --- proofs -------------------------------------------------------------------------


def missing_coordinates(indices: Iterable[int], size: int) -> list[tuple[int, int]]:
    """The least set of (level, index) that, with the given leaves of a tree, gives its root: on every
    level the siblings of what is known that are not known themselves."""
    known, found = np.unique(np.fromiter(indices, dtype=np.int64)), []
    for level in range(height(size)):
        runs = np.unique(known >> FAN_BITS)
        family = (runs[:, None] << FAN_BITS | np.arange(_FAN)).ravel()
        family = family[family < size]
        found += [(level, int(i)) for i in np.setdiff1d(family, known, assume_unique=True)]
        known, size = runs, -(-size // _FAN)
    return found


def prove(manifest: Manifest, leaves: DataFrame | None = None, *, siblings: bool = False) -> DataFrame:
    """Proofs of ``leaves`` (default: all of the manifest's; else some of its rows).

    Struct ``row``, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (digest of the siblings' digests,
    from the leaf's level up to the root, left to right in each), ``folded_root`` (what the shown
    digest and the siblings lead to), ``verified`` (whether that is the root), and with
    ``siblings`` the digests of the proof as an array.
    """
    rows = manifest.leaves if leaves is None else leaves
    rows = rows.withColumn("part", F.shiftright("index", _ROUND_BITS))
    n_trees = manifest.n_trees
    asked = rows.select("tree", "part", "index", "size").groupBy("tree", "part")
    coordinates = "tree bigint, part bigint, of bigint, level int, index bigint"
    asked = materialize(asked.applyInArrow(_ask(n_trees), coordinates), "coordinates")
    # Only levels that some partition asks for are read; there are 22 at most.
    levels = [r[0] for r in asked.where(F.col("of") != TOP).select("level").distinct().collect()]
    nodes = manifest.nodes.where((F.col("tree") == TOP) | F.col("level").isin(levels))
    nodes = nodes.select(F.col("tree").alias("of"), "level", "index", "digest")
    fetched = asked.join(nodes, ["of", "level", "index"])

    row_type = rows.schema["row"]
    texts = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    schema = T.StructType([row_type, *T.StructType.fromDDL(texts + ", siblings array<string>" * siblings)])
    proofs = rows.groupBy("tree", "part").cogroup(fetched.groupBy("tree", "part"))
    return proofs.applyInArrow(_expand(n_trees, manifest.root, siblings), schema)


def _ask(n_trees: int) -> Callable[[pa.Table], pa.Table]:
    def run(part: pa.Table) -> pa.Table:
        tree, number, size = (part.column(c)[0].as_py() for c in ("tree", "part", "size"))
        own = [(tree, *at) for at in missing_coordinates(part.column("index").to_pylist(), size)]
        own += [(TOP, *at) for at in missing_coordinates([tree], n_trees)]
        return pa.table(
            {
                "tree": pa.array([tree] * len(own), pa.int64()),
                "part": pa.array([number] * len(own), pa.int64()),
                "of": pa.array([o[0] for o in own], pa.int64()),
                "level": pa.array([o[1] for o in own], pa.int32()),
                "index": pa.array([o[2] for o in own], pa.int64()),
            }
        )

    return run


def _derive(
    known: dict[int, str], fetched: dict[int, dict[int, str]], levels: int
) -> tuple[list[dict[int, str]], str]:
    """All nodes that the partition has, level by level, and the root over them."""
    found = []
    for level in range(levels):
        nodes = known | fetched.get(level, {})
        found.append(nodes)
        known = _parents(nodes)
    return found, next(iter(known.values()))


def _neighbours(nodes: dict[int, str], index: int) -> tuple[list[str], list[str]]:
    start = index >> FAN_BITS << FAN_BITS
    run = [(i, nodes[i]) for i in range(start, start + _FAN) if i in nodes]
    return [d for i, d in run if i < index], [d for i, d in run if i > index]


def _expand(n_trees: int, root: str | None, siblings: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
        tree, size = (leaves.column(c)[0].as_py() for c in ("tree", "size"))
        there: dict[int, dict[int, dict[int, str]]] = {tree: {}, TOP: {}}
        for node in fetched.select(["of", "level", "index", "digest"]).to_pylist():
            there[node["of"]].setdefault(node["level"], {})[node["index"]] = node["digest"].hex()
        indices = leaves.column("index").to_pylist()
        own = [d.hex() for d in leaves.column("leaf").to_pylist()]
        shown = [d.hex() if d else None for d in leaves.column("shown").to_pylist()]
        lower, subroot = _derive(dict(zip(indices, own)), there[tree], height(size))
        upper, _ = _derive({tree: subroot}, there[TOP], height(n_trees))

        # Left and right siblings on the way up from a node, shared by all leaves below it.
        ways: dict[tuple[int, int], list[tuple[list[str], list[str]]]] = {}

        def way(level: int, index: int) -> list[tuple[list[str], list[str]]]:
            if level == len(lower) + len(upper):
                return []
            if (level, index) not in ways:
                if level < len(lower):
                    nodes, at = lower[level], index
                else:
                    at = tree >> FAN_BITS * (level - len(lower))
                    nodes = upper[level - len(lower)]
                ways[level, index] = [_neighbours(nodes, at), *way(level + 1, index >> FAN_BITS)]
            return ways[level, index]

        digests, folded, listed = [], [], []
        for index, leaf, other in zip(indices, own, shown):
            path = way(0, index)
            proof = [d for left, right in path for d in (*left, *right)]
            digest = other or leaf
            for left, right in path:
                digest = hashlib.sha256("".join((*left, digest, *right)).encode()).hexdigest()
            digests.append(hashlib.sha256("".join(proof).encode()).hexdigest())
            folded.append(digest)
            if siblings:
                listed.append(proof)
        columns = {
            "row": leaves.column("row"),
            "leaf": pa.array(own),
            "subroot": pa.array([subroot] * len(own)),
            "root": pa.array([root] * len(own), pa.string()),
            "proof_sha256": pa.array(digests),
            "folded_root": pa.array(folded),
            "verified": pa.array([f == root for f in folded]),
        }
        if siblings:
            columns["siblings"] = pa.array(listed, pa.list_(pa.string()))
        return pa.table(columns)

    return run
