"""Profile quality metrics. Each returns a one-row DataFrame with the column ``value``,
which is NaN where the data is too small for the metric.

``profiles`` is a profile table, or the result of :func:`.pairs.prepare_profiles`, so that
several metrics share one cleaned and written table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import hash_draw, one_row, quoted
from ..functions.ranking import bucketed_row_number
from ..session import materialize, materialize_in_turn
from .pairs import (
    Block,
    Profiles,
    Squares,
    label_codes,
    label_column,
    prepare_profiles,
    slices,
    tiles,
    unit_vectors,
)

# Neighbourhood sizes, folds, and the smallest inputs that can be scored.
DEFAULT_K = 15
DEFAULT_CV_SPLITS = 5
CLASSIFIER_K = 5
MIN_CLASSES = 2
MIN_FOLDS = 2
MIN_SAMPLES = 2
MIN_SAMPLES_FOR_MAP = 3
# End of fixed values.

#: Cosine similarities equal to this many decimals count as one threshold. This is the accuracy
#: of the products, so that copies tie and nothing else does.
SIMILARITY_DECIMALS = 12

#: Values of all candidates up to which a task holds them to rank queries of large replicate groups
#: (512 MB), and similarities that it has of them at a time (128 MB).
WHOLE_VALUES = 1 << 26
RANKED_PAIRS = 1 << 24

#: Similarities that a task merges at a time where it does not hold all candidates, 32 MB; a tile
#: of such queries has as many.
STRIPE_PAIRS = 4_000_000
_MIN_SIDE = 16

#: Similarities that the tiles of large replicate groups hand on at a time, some 2.5 GB of shuffle
#: files, which are removed before the next queries' turn.
WAVE_PAIRS = 1 << 28

#: Similarities of large replicate groups that tiles hand on (32 MB) rather than send all candidates to
#: the queries of each core.
TILED_PAIRS = 1 << 22

#: Sorts a query itself below all others, as one that is no replicate.
_NOT_RANKED = np.iinfo(np.int64).min + 1

#: Bits of a level inside a bin of the histogram that cuts long rankings.
_BIN_BITS = 26

#: Labels with more rows, or with more than a candidate block, are cut into chunks.
SPLIT_LABEL_ROWS = 16_384

#: Labels of less than this part of a candidate block go to blocks by a hash.
_SMALL_LABELS = 16

#: Replicate groups with up to this many others are scored from listed similarities.
LISTED_REPLICATES = 1024

_FOLD_BUCKET_DIGITS = 3  # hex digits of the draw, i.e. 4096 buckets per class


def _prepared(
    profiles: DataFrame | Profiles,
    label: str,
    features: Sequence[str] | None,
    row_id: str | None,
) -> Profiles:
    if isinstance(profiles, Profiles):
        return profiles
    return prepare_profiles(profiles, [label], features, row_id)


def _nan(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(float("nan")).alias("value"))


def _or_nan(value: Column) -> Column:
    return F.coalesce(value, F.lit(float("nan"))).alias("value")


def _class_sizes(profiles: Profiles, label: str) -> DataFrame:
    return profiles.table.groupBy(label).agg(F.count("*").alias("_size"))


# --- replicate retrieval ------------------------------------------------------------


def replicate_reproducibility(
    profiles: DataFrame | Profiles,
    replicate_col: str = "Metadata_PatientID",
    features: Sequence[str] | None = None,
    *,
    row_id: str | None = None,
    decimals: int = SIMILARITY_DECIMALS,
    max_listed: int = LISTED_REPLICATES,
) -> DataFrame:
    """Mean average precision of finding same-replicate profiles by cosine similarity.

    Every profile ranks all others; profiles with none, or with only such others, are left
    out. Similarities count in steps of ``decimals`` digits; equal ones share a threshold.

    Precision is needed at a profile's own replicates only. So for replicate groups of up
    to ``max_listed`` others, the similarities to those are listed first (one task holds
    one such group) and a tile then just counts its candidates per listed threshold: one row
    per (query, tile). Larger groups need the whole ranking of each query. Where one block holds
    all candidates, and these rankings are long together, a tile makes them; else tiles pass them on as
    one packed row per (query, tile), and a task merges ``STRIPE_PAIRS`` similarities at a time.
    Vectors are sent once per block of the other side, as for the other metrics.
    """
    data = _prepared(profiles, replicate_col, features, row_id)
    replicate_col = label_column(replicate_col)
    spark = data.table.sparkSession
    if data.n_rows < MIN_SAMPLES_FOR_MAP or data.n_features == 0:
        return _nan(spark)
    key = F.struct(F.col(replicate_col).alias("l"))
    sizes = data.table.groupBy(key.alias("_key")).agg(F.count("*").alias("_size"))
    scorable = (F.col("_size") > 1) & (F.col("_size") < data.n_rows)
    few = scorable & (F.col("_size") <= max_listed + 1)
    many = scorable & ~few
    n_few, n_many = sizes.agg(F.count_if(few), F.sum(F.when(many, F.col("_size")))).first()
    sized = data.table.withColumn("_key", key).join(sizes, "_key", "left").drop("_key")
    scores = []
    if n_few:
        scores.append(_listed_precision(data, sized, few, replicate_col, decimals))
    if n_many:
        held = data.n_rows * max(data.n_features, 1) <= WHOLE_VALUES
        if held and n_many * data.n_rows > TILED_PAIRS:
            scores.append(_whole_precision(data, sized, many, replicate_col, decimals))
        else:
            scores.append(_ranked_precision(data, sized, many, n_many, replicate_col, decimals))
    if not scores:
        return _nan(spark)
    precision = scores[0] if len(scores) == 1 else scores[0].unionByName(scores[1])
    return precision.agg(_or_nan(F.avg("_precision")))


def _listed_precision(
    data: Profiles, sized: DataFrame, few: Column, label: str, decimals: int
) -> DataFrame:
    """Average precision per profile from listed thresholds."""
    listed = (
        sized.where(few)
        .select("_row", "_tie", label, "_vec")
        .groupBy(label)
        .applyInArrow(
            _replicate_levels(10**decimals),
            "_row bigint, _levels array<bigint>, _ranks array<bigint>",
        )
    )
    listed = materialize(listed, "replicate-levels")
    asking = Profiles(
        data.table.join(listed.drop("_ranks"), "_row", "left"), data.n_rows, data.n_features, data.labels
    )
    counted = tiles(
        asking,
        [],
        _counts_above(10**decimals),
        "_row bigint, _above array<bigint>",
        query_columns=["_levels"],
        queries=F.col("_levels").isNotNull(),
    )
    # One list of counts per tile of the query, added up place by place.
    lists = counted.groupBy("_row").agg(F.collect_list("_above").alias("_lists"))
    lists = lists.join(listed.select("_row", "_ranks"), "_row")
    nothing = F.transform("_ranks", lambda _: F.lit(0).cast("bigint"))
    above = F.aggregate(
        "_lists", nothing, lambda total, one: F.zip_with(total, one, lambda x, y: x + y)
    )
    precision = F.aggregate(
        F.zip_with("_ranks", above, lambda rank, count: rank / count),
        F.lit(0.0),
        lambda total, one: total + one,
    )
    return lists.select((precision / F.size("_ranks")).alias("_precision"))


def _levels(left: np.ndarray, right: np.ndarray, scale: int) -> np.ndarray:
    return _scaled(unit_vectors(left) @ unit_vectors(right).T, scale)


def _scaled(cosines: np.ndarray, scale: int) -> np.ndarray:
    """Similarities as whole levels; ``cosines`` is overwritten."""
    cosines *= scale
    return np.rint(cosines, out=cosines).astype(np.int64)


def _replicate_levels(scale: int) -> Callable[[pa.Table], pa.Table]:
    """For one label: each row's similarities to the others, ascending, and how many of
    the others are at least as similar."""

    def per_label(group: pa.Table) -> pa.Table:
        block = Block(group)
        n = len(block.rows)
        level = _levels(block.vectors, block.vectors, scale)
        level = np.sort(level[~np.eye(n, dtype=bool)].reshape(n, n - 1), axis=1)
        place = np.arange(n - 1)
        fresh = np.ones_like(level, dtype=bool)
        fresh[:, 1:] = level[:, 1:] != level[:, :-1]
        first = np.maximum.accumulate(np.where(fresh, place, 0), axis=1)
        return pa.table(
            {
                "_row": block.rows,
                "_levels": pa.array(list(level), pa.list_(pa.int64())),
                "_ranks": pa.array(list(n - 1 - first), pa.list_(pa.int64())),
            }
        )

    return per_label


def _counts_above(scale: int) -> Callable[[Block, Block], pa.Table]:
    def reduce_tile(left: Block, right: Block) -> pa.Table:
        listed = left.column("_levels").to_numpy(zero_copy_only=False)
        counts = []
        for s in slices(len(left.rows)):
            level = _levels(left.vectors[s], right.vectors, scale)
            level[left.rows[s][:, None] == right.rows[None, :]] = -2 * scale  # not itself
            for thresholds, row in zip(listed[s], level):
                reached = np.searchsorted(thresholds, row, side="right")
                exactly = np.bincount(reached, minlength=len(thresholds) + 1)
                counts.append(exactly[::-1].cumsum()[-2::-1])
        return pa.table(
            {
                "_row": left.rows,
                "_above": pa.array(counts, pa.list_(pa.int64())),
            }
        )

    return reduce_tile


def _whole_precision(
    data: Profiles, sized: DataFrame, many: Column, label: str, decimals: int
) -> DataFrame:
    """Average precision per profile of large groups: a task per core holds all candidates, and has
    the whole rankings of its queries one after the other, so no similarity leaves it."""
    asking = Profiles(sized.withColumn("_asks", many), data.n_rows, data.n_features, data.labels)
    cores = sized.sparkSession.sparkContext.defaultParallelism
    parts = tiles(
        asking,
        [label],
        _whole_rankings(label, 10**decimals, data.n_rows),
        "_row bigint, _part double, _hits bigint",
        queries=F.col("_asks"),
        candidate_block=(F.lit(0), 1),
        block_rows=-(-data.n_rows // cores),
        streamed=True,
    )
    return parts.select((F.col("_part") / F.col("_hits")).alias("_precision"))


class _Ranked:
    """Queries or candidates of whole rankings, gathered from batches: identities, codes of labels
    (``numbers`` has those so far) and unit vectors."""

    def __init__(self, most: int, numbers: dict[str | None, int]):
        self.most, self.numbers, self.n = most, numbers, 0
        self.rows, self.codes = np.empty(most, dtype=np.int64), np.empty(most, dtype=np.int32)
        self.units = np.empty((most, 0))

    def add(self, block: Block, label: str) -> None:
        n, width = block.vectors.shape
        if not self.n:
            self.units = np.empty((self.most, width))  # in place: this is the bulk of the task
        coded = block.column(label).dictionary_encode(null_encoding="encode")
        names = [self.numbers.setdefault(x, len(self.numbers)) for x in coded.dictionary.to_pylist()]
        here = slice(self.n, self.n + n)
        self.rows[here] = block.rows
        self.codes[here] = np.array(names, dtype=np.int32)[coded.indices.to_numpy(zero_copy_only=False)]
        self.units[here] = unit_vectors(block.vectors)
        self.n += n

    def ended(self) -> _Ranked:
        self.rows, self.codes, self.units = (x[: self.n] for x in (self.rows, self.codes, self.units))
        return self


def _whole_rankings(
    label: str, scale: int, n_rows: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.Table]]:
    """Sum of the precisions at the replicates of each query, and their number. Rows of one identity
    are one query with the rankings of all."""

    def rankings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        numbers: dict[str | None, int] = {}
        queries, candidates = _Ranked(n_rows, numbers), _Ranked(n_rows, numbers)
        for batch in batches:
            asks = batch.column("_query")
            for side, mine in ((queries, asks), (candidates, pc.invert(asks))):
                part = pa.Table.from_batches([batch.filter(mine)])
                if len(part):
                    side.add(Block(part), label)
        if queries.n and candidates.n:
            yield from _rank_whole(queries.ended(), candidates.ended(), scale)

    return rankings


def _rank_whole(queries: _Ranked, candidates: _Ranked, scale: int) -> Iterator[pa.Table]:
    order = np.argsort(queries.rows, kind="stable")
    names, starts = np.unique(queries.rows[order], return_index=True)
    stops = np.append(starts[1:], len(order))
    at_a_time = max(1, RANKED_PAIRS // candidates.n)
    # Where each query is among the candidates.
    placed = np.argsort(candidates.rows, kind="stable")
    ids = candidates.rows[placed]
    lo, hi = np.searchsorted(ids, names), np.searchsorted(ids, names, side="right")
    finite = bool(np.isfinite(queries.units).all() and np.isfinite(candidates.units).all())
    held = np.empty((0, candidates.n))  # large arrays are used again, new ones cost more than the products
    keys, strange = np.empty(candidates.n, dtype=np.int64), np.empty(candidates.n, dtype=bool)
    q = 0
    while q < len(names):
        last = max(q + 1, int(np.searchsorted(stops, starts[q] + at_a_time, side="right")))
        mine = order[starts[q] : stops[last - 1]]
        if len(held) < len(mine):
            held = np.empty((len(mine), candidates.n))
        cosines, out = held[: len(mine)], []
        with np.errstate(invalid="ignore"):
            np.matmul(queries.units[mine], candidates.units.T, out=cosines)
        for i in range(q, last):
            ranked = []
            for j in range(starts[i] - starts[q], stops[i] - starts[q]):
                _ranking_keys(cosines[j], scale, finite, keys)
                np.not_equal(candidates.codes, queries.codes[mine[j]], out=strange)
                np.bitwise_or(keys, strange, out=keys)
                keys[placed[lo[i] : hi[i]]] = _NOT_RANKED
                ranked.append(keys if stops[i] - starts[i] == 1 else keys.copy())
            part, hits = _whole_part(ranked[0] if len(ranked) == 1 else np.concatenate(ranked))
            if hits:
                out.append((names[i], part, hits))
        q = last
        kinds = (pa.int64(), pa.float64(), pa.int64())
        columns = zip(*out) if out else [[]] * len(kinds)
        named = zip(("_row", "_part", "_hits"), columns, kinds)
        yield pa.table({n: pa.array(list(c), k) for n, c, k in named})


def _ranking_keys(cosines: np.ndarray, scale: int, finite: bool, keys: np.ndarray) -> None:
    """Twice the level of each similarity; ``cosines`` is overwritten."""
    cosines *= scale
    if not finite:
        cosines[np.isnan(cosines)] = -2 * scale
    np.rint(cosines, out=keys, casting="unsafe")
    np.left_shift(keys, 1, out=keys)


def _whole_part(keys: np.ndarray) -> tuple[float, int]:
    """Sum of the precisions at the replicates of a ranking, and their number. Keys are twice the level,
    one more for others than replicates, so replicates come first where levels tie. ``keys`` is sorted."""
    keys.sort()
    place = np.flatnonzero((keys.view(np.uint8)[:: keys.itemsize] & 1) == 0)
    if not len(place):
        return 0.0, 0
    level = keys[place]
    first = np.arange(len(place))
    tied = level[1:] == level[:-1]
    if tied.any():
        first[1:][tied] = 0
        np.maximum.accumulate(first, out=first)
        place = place[first]
    # Replicates and candidates that are at least as similar.
    return float(((len(level) - first) / (len(keys) - place)).sum()), len(level)


def _ranked_precision(
    data: Profiles, sized: DataFrame, many: Column, n_queries: int, label: str, decimals: int
) -> DataFrame:
    """Average precision per profile of large groups, from its whole ranking.

    A tile passes on what it knows of a query's ranking as one packed row: the levels of all
    candidates, and those of the replicates. A stripe of queries merges its rows. Where
    a ranking is longer than a stripe, histograms over the tiles cut it into ranges first, and
    a range knows from them what ranks above it.

    All rankings together have n * n levels, so the queries take turns: the blocks of a turn pass on
    ``WAVE_PAIRS`` levels, or one block's, and only its precisions are kept.
    """
    side = max(_MIN_SIDE, math.isqrt(STRIPE_PAIRS))
    asking = Profiles(sized.withColumn("_asks", many), data.n_rows, data.n_features, data.labels)
    if data.n_rows > STRIPE_PAIRS:
        cuts = _ranking_cuts(asking, side, label, decimals)
        cut = asking.table.join(cuts, "_row", "left")
    else:
        # One range with nothing above it.
        nothing = F.array(F.lit(0).cast("bigint"))
        cut = asking.table.withColumns(
            {"_cuts": F.array().cast("array<bigint>"), "_own_above": nothing, "_all_above": nothing}
        )
    table = Profiles(cut, data.n_rows, data.n_features, data.labels)
    n_blocks = table.blocks(side)
    at_a_time = max(1, min(n_blocks, WAVE_PAIRS * n_blocks // (n_queries * data.n_rows)))
    n_stripes = -(-n_queries * at_a_time * data.n_rows // (STRIPE_PAIRS * n_blocks))
    n_stripes = max(n_stripes, sized.sparkSession.sparkContext.defaultParallelism)

    def wave(first: int, last: int) -> DataFrame:
        runs = tiles(
            table,
            [label],
            _level_runs(label, 10**decimals),
            "_row bigint, _range int, _own_above bigint, _all_above bigint, _own binary, _all binary",
            query_columns=["_cuts", "_own_above", "_all_above"],
            queries=F.col("_asks"),
            block_rows=side,
            query_blocks=(first, last) if at_a_time < n_blocks else None,
        )
        stripe = F.pmod(F.xxhash64("_row", F.lit(0)), F.lit(n_stripes)).alias("_stripe")
        parts = runs.groupBy(stripe, "_range").applyInArrow(
            _merge_runs, "_row bigint, _part double, _hits bigint"
        )
        whole = parts.groupBy("_row").agg(F.sum("_part").alias("_part"), F.sum("_hits").alias("_hits"))
        return whole.select((F.col("_part") / F.col("_hits")).alias("_precision"))

    if at_a_time == n_blocks:
        return wave(0, n_blocks)
    waves = (wave(i, min(i + at_a_time, n_blocks)) for i in range(0, n_blocks, at_a_time))
    return materialize_in_turn(sized.sparkSession, waves, "precision")


def _ranking_cuts(asking: Profiles, side: int, label: str, decimals: int) -> DataFrame:
    """Per query: levels at which its ranking is cut, ascending, and how many replicates and
    candidates rank above each of the resulting ranges. A range holds ``STRIPE_PAIRS`` candidates and
    one bin of the histogram at most."""
    counted = tiles(
        asking,
        [label],
        _level_bins(label, 10**decimals),
        "_row bigint, _bins array<bigint>, _own array<bigint>, _all array<bigint>",
        queries=F.col("_asks"),
        block_rows=side,
    )
    bins = (
        counted.select("_row", F.explode(F.arrays_zip("_bins", "_own", "_all")).alias("b"))
        .groupBy("_row", F.col("b._bins").alias("_bin"))
        .agg(F.sum("b._own").alias("_own"), F.sum("b._all").alias("_all"))
    )
    above = Window.partitionBy("_row").orderBy(F.desc("_bin"))
    bins = bins.withColumns({c: F.sum(c).over(above) - F.col(c) for c in ("_own", "_all")})
    ranges = bins.groupBy("_row", F.floor(F.col("_all") / STRIPE_PAIRS).alias("_r")).agg(
        F.struct(
            F.shiftleft(F.min("_bin"), _BIN_BITS).alias("start"),
            F.min("_own").alias("own"),
            F.min("_all").alias("all"),
        ).alias("r")
    )
    rows = ranges.groupBy("_row").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return rows.select(
        "_row",
        F.slice("r.start", F.lit(2), F.size("r")).alias("_cuts"),
        F.col("r.own").alias("_own_above"),
        F.col("r.all").alias("_all_above"),
    )


def _tile_levels(
    left: Block, right: Block, label: str, scale: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice of queries: levels of the candidates, which of these are replicates, and which are
    others than the query itself."""
    own, other, _ = label_codes(left, right, label)
    for s in slices(len(left.rows)):
        level = _levels(left.vectors[s], right.vectors, scale)
        others = left.rows[s][:, None] != right.rows[None, :]
        yield level, others & (own[s][:, None] == other[None, :]), others


def _level_bins(label: str, scale: int) -> Callable[[Block, Block], pa.Table]:
    def reduce_tile(left: Block, right: Block) -> pa.Table:
        found = []
        for level, same, others in _tile_levels(left, right, label, scale):
            for row, mine, there in zip(level >> _BIN_BITS, same, others):
                bins, place = np.unique(row, return_inverse=True)
                counts = (np.bincount(place[m], minlength=len(bins)) for m in (mine, there))
                found.append((bins, *counts))
        lists = [pa.array(list(x), pa.list_(pa.int64())) for x in zip(*found)]
        return pa.table(dict(zip(("_row", "_bins", "_own", "_all"), (left.rows, *lists))))

    return reduce_tile


def _level_runs(label: str, scale: int) -> Callable[[Block, Block], pa.Table]:
    """Per query and range the levels of replicates and of all candidates in the tile."""

    def reduce_tile(left: Block, right: Block) -> pa.Table:
        cuts, own_above, all_above = (
            left.column(c).to_pylist() for c in ("_cuts", "_own_above", "_all_above")
        )
        out, at = [], 0
        for level, same, others in _tile_levels(left, right, label, scale):
            for row, mine, there in zip(level, same, others):
                place = np.searchsorted(cuts[at], row, side="right") if cuts[at] else None
                for r, above in enumerate(zip(own_above[at], all_above[at])):
                    here = there if place is None else there & (place == r)
                    if here.any():
                        pieces = (row[mine & here].tobytes(), row[here].tobytes())
                        out.append((left.rows[at], r, *above, *pieces))
                at += 1
        names = ("_row", "_range", "_own_above", "_all_above", "_own", "_all")
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        columns = zip(*out) if out else [[]] * len(names)
        return pa.table({n: pa.array(list(c), k) for n, c, k in zip(names, columns, kinds)})

    return reduce_tile


def _merge_runs(runs: pa.Table) -> pa.Table:
    """Sum of the precisions at the replicates of each query in this range, and their number."""
    parts: dict[int, list[tuple[int, int, bytes, bytes]]] = {}
    columns = (runs.column(c).to_pylist() for c in ("_row", "_own_above", "_all_above", "_own", "_all"))
    for row, *part in zip(*columns):
        parts.setdefault(row, []).append(part)
    out = []
    for row, some in parts.items():
        own_above, all_above = some[0][:2]
        mine, whole = (np.frombuffer(b"".join(p[i] for p in some), dtype=np.int64) for i in (2, 3))
        out.append((row, *_precision_part(mine, whole, own_above, all_above)))
    return pa.table(dict(zip(("_row", "_part", "_hits"), map(list, zip(*out)))))


def _precision_part(
    mine: np.ndarray, whole: np.ndarray, own_above: int, all_above: int
) -> tuple[float, int]:
    """Sum of the precisions at the levels of replicates, below those counted above, and their number."""
    levels, hits = np.unique(mine, return_counts=True)
    # Replicates and candidates that are at least as similar as each level.
    found = own_above + hits[::-1].cumsum()[::-1]
    reached = all_above + len(whole) - np.searchsorted(np.sort(whole), levels)
    return float((hits * (found / reached)).sum()), len(mine)


# --- group separation ---------------------------------------------------------------


def silhouette(
    profiles: DataFrame | Profiles,
    label_col: str = "Metadata_DiseaseGroup",
    features: Sequence[str] | None = None,
    *,
    row_id: str | None = None,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Mean silhouette (Euclidean). Labels of more than ``chunk_rows`` rows (default:
    ``SPLIT_LABEL_ROWS``) are cut even if a block could hold them.

    Candidates are packed into chunks by label and these into blocks, so a tile knows all rows of most
    of its labels and is done with them: per query it returns the sum over the own label, if that is
    in the tile, and the least mean over another. Only a label larger than a chunk is cut, into as
    few chunks as hold it, which lie in consecutive blocks; a tile adds up what it has of
    each. So there is one row per (query, tile) whatever the sizes of the labels, and the size of
    the chunks has no part in the number of tiles.
    """
    data = _prepared(profiles, label_col, features, row_id)
    label_col = label_column(label_col)
    spark = data.table.sparkSession
    sizes = _class_sizes(data, label_col)
    n_labels = sizes.count()
    if data.n_features == 0 or n_labels < MIN_CLASSES or data.n_rows <= n_labels:
        return _nan(spark)
    key = F.struct(F.col(label_col).alias("l"))
    sizes = sizes.select(key.alias("_key"), F.col("_size").alias("_label_size"))
    block_rows = -(-data.n_rows // data.blocks())
    capacity = max(1, min(block_rows, chunk_rows or SPLIT_LABEL_ROWS))
    packed, n_packed, n_hashed = _pack_labels(sizes, capacity)
    # The packed labels are 16 per chunk at most.
    sizes = sizes.join(F.broadcast(packed), "_key", "left")
    table = data.table.withColumn("_key", key).join(sizes, "_key").drop("_key")
    table = table.withColumn("_split", F.coalesce(F.col("_chunks") > 1, F.lit(False)))
    hashed = n_packed + F.pmod(F.xxhash64(key), F.lit(max(n_hashed, 1)))
    chunk = F.col("_first") + F.pmod(F.xxhash64("_row"), F.col("_chunks"))
    per_block = max(1, block_rows // capacity)
    block = F.floor(F.coalesce(chunk, hashed) / per_block)
    sums = tiles(
        Profiles(table, data.n_rows, data.n_features, data.labels),
        [label_col, "_split", "_label_size", "_first"],
        _label_distances(label_col),
        "_row bigint, _own_size bigint, _own_place int, _sum double, _least double, "
        "_places array<int>, _means array<double>",
        candidate_block=(block, -(-(n_packed + n_hashed) // per_block)),
    )
    # What tiles have of one cut label is added up; the place -1 has what needs no adding up.
    whole = F.arrays_zip(F.array(F.lit(-1)).alias("p"), F.array(F.lit(0.0)).alias("m"))
    cut = F.arrays_zip(F.col("_places").alias("p"), F.col("_means").alias("m"))
    parts = sums.select("*", F.explode(F.concat(whole, cut)).alias("e"))
    totals = parts.groupBy("_row", F.col("e.p").alias("_place")).agg(
        F.sum("e.m").alias("_mean"),
        F.sum("_sum").alias("_sum"),
        F.max("_own_size").alias("_size"),
        F.max("_own_place").alias("_own_place"),
        F.min("_least").alias("_least"),
    )
    at_whole, at_own = F.col("_place") < 0, F.col("_place") == F.col("_own_place")
    own_sum = F.when(at_whole & (F.col("_own_place") < 0), F.col("_sum")).when(
        ~at_whole & at_own, F.col("_mean") * F.col("_size")
    )
    rows = totals.groupBy("_row").agg(
        F.max("_size").alias("_size"),
        F.sum(own_sum).alias("_own_sum"),
        F.least(F.min("_least"), F.min(F.when(~at_whole & ~at_own, F.col("_mean")))).alias("b"),
    )
    rows = rows.withColumn("a", F.try_divide("_own_sum", F.col("_size") - 1))
    score = F.coalesce(
        F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)
    )
    return rows.agg(_or_nan(F.avg(F.when(F.col("_size") > 1, score).otherwise(0.0))))


def _pack_labels(sizes: DataFrame, capacity: int) -> tuple[DataFrame, int, int]:
    """First-fit packing of labels into blocks of ``capacity`` rows: table ``_key, _first, _chunks``
    of the labels that are packed, number of their blocks, and number of blocks for the small
    labels, which a hash deals out. The packed labels, 16 per block at most, come to the driver.
    """
    large = F.col("_label_size") * _SMALL_LABELS > capacity
    rest = sizes.where(~large).agg(F.coalesce(F.sum("_label_size"), F.lit(0))).first()[0]
    placed, free, n_blocks = [], [], 0
    for row in sorted(sizes.where(large).collect(), key=lambda r: (-r["_label_size"], str(r["_key"]))):
        size, chunks = row["_label_size"], 1
        first = next((i for i, (_, left) in enumerate(free) if left >= size), None)
        if size > capacity:
            chunks, block = -(-size // capacity), n_blocks
            n_blocks += chunks
        elif first is None:
            block = n_blocks
            free.append((block, capacity - size))
            n_blocks += 1
        else:
            block, left = free[first]
            free[first] = block, left - size
        placed.append((row["_key"], block, chunks))
    schema = T.StructType([sizes.schema["_key"], *T.StructType.fromDDL("_first int, _chunks int")])
    return sizes.sparkSession.createDataFrame(placed, schema), n_blocks, -(-rest // capacity)


def _label_distances(label: str) -> Callable[[Block, Block], pa.Table]:
    """One row per query: size of the own label, and its first chunk if it is cut (else -1); of the whole
    labels in the tile, the sum of the distances to the own one and the least mean over another;
    and of each cut label its first chunk and the part of the mean that lies in the tile."""

    def reduce_tile(left: Block, right: Block) -> pa.Table:
        own, other, _ = label_codes(left, right, label)
        order = np.argsort(other, kind="stable")
        present, starts = np.unique(other[order], return_index=True)
        first = order[starts]
        label_size = right.column("_label_size").to_numpy()[first]
        cut = right.column("_split").to_numpy(zero_copy_only=False)[first]
        places = np.empty(0, dtype=np.int32)
        if cut.any():
            places = right.column("_first").take(pa.array(first[cut])).to_numpy(zero_copy_only=False)
        own_place = np.full(len(left.rows), -1, dtype=np.int32)
        own_cut = left.column("_split").to_numpy(zero_copy_only=False)
        if own_cut.any():
            own_place[own_cut] = left.column("_first").filter(pa.array(own_cut)).to_numpy(zero_copy_only=False)
        squares, kept = Squares(right.vectors[order]), present[~cut]
        least, total, means = [], [], []
        for s in slices(len(left.rows)):
            queries = squares.queries(left.vectors[s])
            sums = np.zeros((len(left.rows[s]), len(present)))
            for c in squares.chunks():
                distances = squares.of(left.vectors[s], queries, c)
                np.sqrt(distances, out=distances)
                lo = np.searchsorted(starts, c.start, side="right") - 1
                hi = np.searchsorted(starts, c.stop, side="left")
                at = np.maximum(starts[lo:hi] - c.start, 0)
                sums[:, lo:hi] += np.add.reduceat(distances, at, axis=1)
            whole = sums[:, ~cut]
            mine = own[s][:, None] == kept[None, :]
            total.append(np.where(mine, whole, 0.0).sum(axis=1))
            least.append(np.where(mine, np.inf, whole / label_size[~cut]).min(axis=1, initial=np.inf))
            means.append(sums[:, cut] / label_size[cut])
        n, width = len(left.rows), len(places)
        at = pa.array(np.arange(n + 1, dtype=np.int32) * width)
        return pa.table(
            {
                "_row": left.rows,
                "_own_size": left.column("_label_size"),
                "_own_place": own_place,
                "_sum": np.concatenate(total),
                "_least": np.concatenate(least),
                "_places": pa.ListArray.from_arrays(at, pa.array(np.tile(places, n), pa.int32())),
                "_means": pa.ListArray.from_arrays(at, pa.array(np.concatenate(means).ravel())),
            }
        )

    return reduce_tile


# --- nearest neighbours -------------------------------------------------------------


def _nearest(
    data: Profiles, label: str, k: int, fold: str | None = None, skip: int = 0
) -> DataFrame:
    """The ``k`` nearest others of every row: ``_row, _fold, _label, _near_label``.

    With ``fold`` only rows of other folds are candidates; with ``skip`` that many of the
    nearest ones are passed over. A tile keeps its ``k`` best per query, and the best of
    those over all tiles are the best of all.
    """
    columns = [label] if fold is None else [label, fold]
    found = tiles(
        data,
        columns,
        _nearest_in_tile(label, k + skip, fold),
        "_row bigint, _fold int, _label string, _square double, _tie bigint, _near bigint, "
        "_near_label string",
    )
    order = Window.partitionBy("_row").orderBy("_square", "_tie", "_near")
    place = F.row_number().over(order)
    ranked = found.withColumn("_place", place).where(F.col("_place") <= k + skip)
    return ranked.where(F.col("_place") > skip).select("_row", "_fold", "_label", "_near_label")


def _nearest_in_tile(
    label: str, k: int, fold: str | None
) -> Callable[[Block, Block], pa.Table]:
    """Products bound the distances from below; what may be among the ``k`` nearest by its bound is
    measured by differences."""

    def reduce_tile(left: Block, right: Block) -> pa.Table:
        own, other, names = label_codes(left, right, label)
        if fold is None:
            own_fold, other_fold = np.zeros(len(left.rows), dtype=np.int32), None
        else:
            own_fold, other_fold = (
                np.asarray(side.column(fold)).astype(np.int32) for side in (left, right)
            )
        squares = Squares(right.vectors)
        parts = []
        for s in slices(len(left.rows)):
            found = _nearest_in_slice(
                left.vectors[s], left.rows[s], own_fold[s], right, other_fold, squares, k
            )
            q, c, square = found
            parts.append(
                (
                    left.rows[s][q],
                    own_fold[s][q],
                    own[s][q],
                    square,
                    right.ties[c],
                    right.rows[c],
                    other[c],
                )
            )
        row, part, mine, square, tie, near, theirs = (np.concatenate(p) for p in zip(*parts))
        return pa.table(
            {
                "_row": row,
                "_fold": part,
                "_label": names.take(pa.array(mine)),
                "_square": square,
                "_tie": tie,
                "_near": near,
                "_near_label": names.take(pa.array(theirs)),
            }
        )

    return reduce_tile


def _nearest_in_slice(
    vectors: np.ndarray,
    rows: np.ndarray,
    folds: np.ndarray,
    right: Block,
    other_fold: np.ndarray | None,
    squares: Squares,
    k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and of their ``k`` nearest candidates in the block, and squared distances."""
    queries = squares.queries(vectors)
    limit = np.full(len(rows), np.inf)
    best = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
    held, n_held = [best], 0

    def allowed(q: np.ndarray, c: np.ndarray) -> np.ndarray:
        there = rows[q] != right.rows[c]
        return there if other_fold is None else there & (folds[q] != other_fold[c])

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, c, square = (np.concatenate(p) for p in zip(*held))
        order = np.lexsort((right.rows[c], right.ties[c], square, q))
        q, c, square = q[order], c[order], square[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        full = place == k - 1
        limit[q[full]] = square[full]
        return q[place < k], c[place < k], square[place < k]

    for chunk in squares.chunks():
        bound = squares.at_least(queries, chunk)
        unknown = np.isinf(limit)
        if unknown.any() and bound.shape[1] > k:
            # The k that look nearest give a first limit.
            some = np.flatnonzero(unknown)
            barred = rows[some][:, None] == right.rows[None, chunk]
            if other_fold is not None:
                barred |= folds[some][:, None] == other_fold[None, chunk]
            seen = np.where(barred, np.inf, bound[some])
            near = np.argpartition(seen, k - 1, axis=1)[:, :k]
            q = np.repeat(some, k)
            c = near.ravel() + chunk.start
            with np.errstate(invalid="ignore", over="ignore"):
                square = squares.exact(vectors, q, c).reshape(-1, k)
            square[np.take_along_axis(barred, near, axis=1) | np.isnan(square)] = np.inf
            limit[some] = square.max(axis=1)
        near = bound > squares.limits(limit)[:, None]
        np.logical_not(near, out=near)
        q, c = np.divmod(np.flatnonzero(near), bound.shape[1])
        c += chunk.start
        there = allowed(q, c)
        q, c = q[there], c[there]
        with np.errstate(invalid="ignore", over="ignore"):
            square = squares.exact(vectors, q, c)
        there = square <= limit[q]
        held.append((q[there], c[there], square[there]))
        n_held += int(there.sum())
        if n_held > len(rows) * k:
            held, n_held = [merged()], 0
    return merged()


def label_classifiability(
    profiles: DataFrame | Profiles,
    label_col: str,
    features: Sequence[str] | None = None,
    *,
    n_splits: int = DEFAULT_CV_SPLITS,
    seed: int = 0,
    row_id: str | None = None,
) -> DataFrame:
    """Cross-validated balanced accuracy of a nearest-neighbour vote for the label.

    Stratified folds, as many as ``n_splits`` or the smallest class allows, dealt out in a
    hashed order (repeatable when ``row_id`` is given); up to 5 neighbours from the other
    folds; on equal votes the smallest label. Recall is averaged over labels, then folds.
    """
    data = _prepared(profiles, label_col, features, row_id)
    label_col = label_column(label_col)
    spark = data.table.sparkSession
    n_classes, smallest = _class_sizes(data, label_col).agg(F.count("*"), F.min("_size")).first()
    folds = min(n_splits, smallest or 0)
    if data.n_features == 0 or n_classes < MIN_CLASSES or folds < MIN_FOLDS:
        return _nan(spark)

    draw = hash_draw(seed, "_tie", "_row")
    dealt = bucketed_row_number(
        data.table,
        [label_col],
        F.substring(draw, 1, _FOLD_BUCKET_DIGITS),
        [draw.asc(), F.col("_row").asc()],
        "_turn",
    ).withColumn("_fold", F.pmod(F.col("_turn") - 1, F.lit(folds)).cast("int"))
    split = Profiles(dealt, data.n_rows, data.n_features, (*data.labels, "_fold"))

    near = _nearest(split, label_col, min(CLASSIFIER_K, smallest), "_fold")
    votes = near.groupBy("_row", "_fold", "_label", "_near_label").agg(
        F.count("*").alias("_votes")
    )
    best = F.min(F.struct((-F.col("_votes")).alias("v"), F.col("_near_label").alias("l")))
    guesses = votes.groupBy("_row", "_fold", "_label").agg(best["l"].alias("_guess"))
    hit = F.col("_guess").eqNullSafe(F.col("_label")).cast("double")
    recall = guesses.groupBy("_fold", "_label").agg(F.avg(hit).alias("_recall"))
    balanced = recall.groupBy("_fold").agg(F.avg("_recall").alias("_balanced"))
    return balanced.agg(_or_nan(F.avg("_balanced")))


def chance_level(profiles: DataFrame | Profiles, label_col: str) -> DataFrame:
    """``1 / number of classes`` (NULL is none), NaN without classes."""
    prepared = isinstance(profiles, Profiles)
    table, name = (profiles.table, label_column(label_col)) if prepared else (profiles, label_col)
    return table.agg(_or_nan(F.try_divide(F.lit(1.0), F.count_distinct(quoted(name)))))


def batch_mixing(
    profiles: DataFrame | Profiles,
    batch_col: str = "Metadata_Batch",
    features: Sequence[str] | None = None,
    *,
    k: int = DEFAULT_K,
    skip: int = 0,
    row_id: str | None = None,
) -> DataFrame:
    """Share of the ``k`` nearest others that are of another batch, over the share expected
    if batches were mixed. ``skip=1`` leaves out the very nearest one."""
    data = _prepared(profiles, batch_col, features, row_id)
    batch_col = label_column(batch_col)
    spark = data.table.sparkSession
    sizes = _class_sizes(data, batch_col)
    if data.n_features == 0 or data.n_rows <= MIN_SAMPLES or sizes.count() < MIN_CLASSES:
        return _nan(spark)
    share = F.col("_size") / F.lit(data.n_rows)
    expected = sizes.agg((1.0 - F.sum(share * share)).alias("e"))
    crossing = (~F.col("_label").eqNullSafe(F.col("_near_label"))).cast("double")
    observed = _nearest(data, batch_col, min(k, data.n_rows - 1), skip=skip)
    observed = observed.agg(F.avg(crossing).alias("o"))
    ratio = F.try_divide("o", one_row(expected)["e"])
    return observed.select(_or_nan(ratio))


# --- scorecard ----------------------------------------------------------------------


def benchmark(
    profiles: DataFrame,
    *,
    disease_col: str = "Metadata_DiseaseGroup",
    batch_col: str = "Metadata_Batch",
    replicate_col: str = "Metadata_PatientID",
    features: Sequence[str] | None = None,
    row_id: str | None = None,
    k: int = DEFAULT_K,
    skip: int = 0,
    n_splits: int = DEFAULT_CV_SPLITS,
    seed: int = 0,
) -> DataFrame:
    """Scorecard ``metric, value, interpretation``, five rows over one prepared table.

    ``k`` and ``skip`` are those of :func:`batch_mixing`, ``n_splits`` and ``seed`` those of
    :func:`label_classifiability`.
    """
    data = prepare_profiles(profiles, [disease_col, batch_col, replicate_col], features, row_id)

    def row(metric: str, value: DataFrame, text: str, chance_of: str | None = None) -> DataFrame:
        meaning = F.lit(text)
        if chance_of is not None:
            chance = one_row(chance_level(data, chance_of))["value"]
            meaning = F.format_string(f"{text}; chance=%.3f", chance)
        return value.select(
            F.lit(metric).alias("metric"), "value", meaning.alias("interpretation")
        )

    # Metric names and interpretations.
    scores = [
        row(
            "replicate_reproducibility_map",
            replicate_reproducibility(data, replicate_col),
            "higher is better (same-replicate profiles look alike)",
        ),
        row(
            "disease_silhouette",
            silhouette(data, disease_col),
            "higher is better (disease groups separate)",
        ),
        row(
            "disease_classifier_balacc",
            label_classifiability(data, disease_col, n_splits=n_splits, seed=seed),
            "higher is better",
            disease_col,
        ),
        row(
            "batch_classifier_balacc",
            label_classifiability(data, batch_col, n_splits=n_splits, seed=seed),
            "lower is better (batch leakage)",
            batch_col,
        ),
        row(
            "batch_mixing_ratio",
            batch_mixing(data, batch_col, k=k, skip=skip),
            "1.0 = mixed, toward 0 = batch-separated",
        ),
    ]
    result = scores[0]
    for score in scores[1:]:
        result = result.unionByName(score)
    return result


def benchmark_from_path(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """:func:`benchmark` of a stored profile table, usually the well profiles."""
    return benchmark(spark.read.parquet(path), **options)
