"""Language-model scores: n-gram estimates mixed by deleted interpolation.

A text is lower-cased (A-Z), cut into words at white space and closed by an end token. The
probability of a token mixes maximum-likelihood estimates of rising order, from one over the number of
outcomes (order 0) up:

    P_n = w_n(context frequency) * count(context, token) / count(context) + (1 - w_n) * P_{n-1}

Each order has a weight for every bucket of context frequencies (powers of two). The weights are
learned by expectation-maximisation on held-out counts: a tenth of the training texts, chosen by
a hash of the text so that copies stay together, is deleted from the counts and predicted from
the others. Afterwards all training texts count.

Counting is distributed by n-gram, scoring by document, and neither sends a row per token:

1. A task cuts its documents into blocks of a bounded size and stores their tokens.
2. Per block, order and range of n-gram hashes, the different n-grams go out as one packed row with
   their counts in the block. The task of a range adds the blocks up and answers each block with
   totals in the order in which it asked. Ranges get more as the corpus grows, so a task
   holds a bounded number of n-grams; a frequent n-gram comes once per block, not per token.
3. Blocks meet their answers. What is left of a token is its counts; equal ones are kept once per block.
4. Every step of expectation-maximisation is one aggregate over the deleted tokens of all blocks,
   which gives two sums per order and bucket. Then every block scores its documents.

N-grams are known by 64-bit hashes. All n-grams of all training texts count; none is pruned.

NULL texts are empty, an empty text is its end token alone. Texts of any length are whole in one
block. Repeated rows, NULL and repeated ids are rows like any other, as a row is never looked up
by an id. An empty table gives no rows. Without any training text every token has probability one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

#: Highest order of n-grams.
ORDER = 2

#: One in so many training texts is deleted from the counts and predicted from the rest.
DELETED = 10

#: Bytes of text in a block, about, and tokens per range of hashes.
BLOCK_BYTES = 6 << 20
RANGE_TOKENS = 2_000_000

#: Steps of expectation-maximisation at most, and change of the weights that ends them.
STEPS, TOLERANCE = 40, 1e-3

#: Buckets of context frequencies: none, 1, 2-3, 4-7 and so on.
BUCKETS = 64

#: Added to every count of the base distribution (fixed value).
BASE_COUNT = 0.1

_END = b"\n"  # no word has white space in it
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BATCH_ROWS = 256

_SUMS = ("n_tokens", "n_rest", "n_deleted", "d_rest", "d_deleted")
_BLOCK = "block bigint, tokens binary, learn binary, codes binary, words binary, " + ", ".join(
    f"{c} bigint" for c in _SUMS
)


def trained_on(doc_id: Column) -> Column:
    """False for the tenth of documents that the model must not see: crc32 of the id, modulo 10,
    is 0. Documents without id are trained on."""
    return ~F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def score_documents(
    docs: DataFrame,
    learn: Column,
    keep: Sequence[str],
    *,
    text: str = "text",
    order: int = ORDER,
) -> DataFrame:
    """One row per row of ``docs``: struct ``row`` with the columns ``keep``, ``n_tokens``, ``n_known``
    (tokens that training has), ``train_tokens``, ``base_score`` and ``score``.

    ``learn`` marks the rows to learn from; NULL is false. ``base_score`` is the log10 probability
    under unigram counts plus 0.1, ``score`` under the model.
    """
    spark = docs.sparkSession
    content = F.coalesce(F.col(text), F.lit(""))
    part = F.pmod(F.xxhash64(content), F.lit(DELETED)) == 0
    role = F.when(~F.coalesce(learn, F.lit(False)), 0).when(part, 2).otherwise(1)
    rows = docs.select(
        F.struct(*keep).alias("row"), content.alias("text"), role.cast("byte").alias("role")
    )
    # What comes out of a block may be NULL as far as Arrow knows.
    fields = [T.StructField(f.name, f.dataType) for f in rows.schema["row"].dataType]
    row_type = T.StructField("rows", T.ArrayType(T.StructType(fields)))
    block_type = T.StructType([row_type, *T.StructType.fromDDL(_BLOCK)])
    blocks = materialize(rows.mapInArrow(_blocks, block_type), "lm-blocks")
    totals = blocks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS]).first()

    n_ranges = max(1, -(-totals["n_tokens"] // RANGE_TOKENS))
    asked = blocks.select("block", "tokens", "learn", "codes", "words").mapInArrow(
        _requests(order, n_ranges),
        "ngrams int, part int, block bigint, hashes binary, rest binary, deleted binary",
    )
    answers = materialize(
        asked.groupBy("ngrams", "part").applyInArrow(
            _answers, "ngrams int, part int, block bigint, rest binary, deleted binary, types bigint"
        ),
        "lm-counts",
    )
    n_types = answers.agg(F.coalesce(F.sum("types"), F.lit(0))).first()[0]

    found_type = T.StructType(
        [row_type, *T.StructType.fromDDL("tokens binary, codes binary, counts binary, events binary")]
    )
    counted = materialize(
        blocks.groupBy("block")
        .cogroup(answers.drop("types").groupBy("block"))
        .applyInArrow(_counted(order, totals["d_rest"], totals["d_deleted"]), found_type),
        "lm-counted",
    )
    weights = _learned(counted, order, totals["n_rest"], n_types)
    n_train = totals["n_rest"] + totals["n_deleted"]
    score_type = T.StructType(
        [
            T.StructField("row", row_type.dataType.elementType),
            *T.StructType.fromDDL(
                "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
            ),
        ]
    )
    scored = counted.select("rows", "tokens", "codes", "counts")
    return scored.mapInArrow(_scores(weights, n_train, n_types), score_type)


def _pack(values: np.ndarray) -> bytes:
    """Compressed bytes, sorted by their place in the value."""
    import zstandard

    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpack(packed: bytes, kind: type) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(packed), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


# --- blocks -------------------------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole documents: tokens as codes into the list of the block's words."""
    from pyspark import TaskContext
    from xxhash import xxh64_intdigest

    name = TaskContext.get().partitionId() << 33

    def fresh() -> tuple[dict, list, list, list]:
        codes: dict[bytes, int] = defaultdict()
        codes.default_factory = codes.__len__
        codes[_END]
        return codes, [], [], []

    def finish() -> pa.RecordBatch:
        lengths = np.array([len(x) for x in found], dtype=np.int32)
        learn = np.array(roles, dtype=np.uint8)
        rows = pa.concat_arrays(kept)
        ends = pa.array([0, len(rows)], pa.int32())
        hashes = np.array([xxh64_intdigest(w) for w in codes], dtype=np.uint64)
        by_role = [int(lengths[learn == r].sum()) for r in (1, 2)]
        columns = {
            "rows": pa.ListArray.from_arrays(ends, rows),
            "block": pa.array([name], pa.int64()),
            "tokens": pa.array([_pack(lengths)], pa.binary()),
            "learn": pa.array([_pack(learn)], pa.binary()),
            "codes": pa.array([_pack(np.concatenate(found))], pa.binary()),
            "words": pa.array([_pack(hashes)], pa.binary()),
        }
        counts = [int(lengths.sum()), *by_role, *[int((learn == r).sum()) for r in (1, 2)]]
        for column, value in zip(_SUMS, counts):
            columns[column] = pa.array([value], pa.int64())
        return pa.record_batch(columns)

    (codes, found, roles, kept), size = fresh(), 0
    for batch in batches:
        rows = batch.column("row")
        for start in range(0, len(batch), _BATCH_ROWS):
            part = batch.slice(start, _BATCH_ROWS)
            first = 0
            for i, text in enumerate(part.column("text").to_pylist()):
                words = text.encode("utf-8", "surrogatepass").lower().split()
                words.append(_END)
                found.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)))
                roles.append(part.column("role")[i].as_py())
                size += len(text) + 1
                if size >= BLOCK_BYTES:
                    kept.append(rows.slice(start + first, i + 1 - first))
                    yield finish()
                    name += 1
                    (codes, found, roles, kept), size, first = fresh(), 0, i + 1
            if first < len(part):
                kept.append(rows.slice(start + first, len(part) - first))
    if found:
        yield finish()


def _ngrams(words: np.ndarray, codes: np.ndarray, lengths: np.ndarray, order: int) -> Iterator[
    tuple[np.ndarray, np.ndarray]
]:
    """Per order: the block's different n-grams as ascending hashes, and which one ends at each
    token. Before the first token of a document stand as many start marks as needed."""
    first = np.cumsum(lengths) - lengths
    hashes = words[codes]
    keys, places = np.unique(words, return_inverse=True)
    yield keys, places[codes]
    grams, mark = hashes, np.uint64(1)
    with np.errstate(over="ignore"):
        for _ in range(1, order):
            before = np.empty_like(grams)
            before[1:] = grams[:-1]
            before[first] = mark
            mixed = (before ^ (before >> np.uint64(29))) * _MIX + hashes
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            grams, mark = mixed ^ (mixed >> np.uint64(32)), mark + np.uint64(1)
            yield np.unique(grams, return_inverse=True)


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, codes, lengths and the role of each token's document."""
    lengths = _unpack(row["tokens"], np.int32)
    learn = np.repeat(_unpack(row["learn"], np.uint8), lengths)
    return _unpack(row["words"], np.uint64), _unpack(row["codes"], np.int32), lengths, learn


# --- counts -------------------------------------------------------------------------


def _requests(order: int, n_ranges: int) -> Callable:
    edges = np.array([(i << 64) // n_ranges for i in range(1, n_ranges)], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, codes, lengths, learn = _opened(row)
                for n, (keys, places) in enumerate(_ngrams(words, codes, lengths, order), 1):
                    rest, deleted = (
                        np.bincount(places[learn == r], minlength=len(keys)) for r in (1, 2)
                    )
                    cuts = [0, *np.searchsorted(keys, edges), len(keys)]
                    spans = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
                    steps = [np.diff(keys[a:b], prepend=np.uint64(0)) for _, a, b in spans]
                    yield pa.record_batch(
                        {
                            "ngrams": pa.array([n] * len(spans), pa.int32()),
                            "part": pa.array([i for i, _, _ in spans], pa.int32()),
                            "block": pa.array([row["block"]] * len(spans), pa.int64()),
                            "hashes": pa.array([_pack(s) for s in steps], pa.binary()),
                            "rest": pa.array([_pack(rest[a:b]) for _, a, b in spans], pa.binary()),
                            "deleted": pa.array([_pack(deleted[a:b]) for _, a, b in spans], pa.binary()),
                        }
                    )

    return run


def _answers(asked: pa.Table) -> pa.Table:
    """Totals of one range of hashes, for each block in the order in which it asked. ``types``
    has the number of different training words, once."""
    rows = asked.to_pylist()
    with np.errstate(over="ignore"):
        hashes = [np.cumsum(_unpack(r["hashes"], np.uint64), dtype=np.uint64) for r in rows]
    keys, places = np.unique(np.concatenate(hashes), return_inverse=True)
    cuts = np.cumsum([len(h) for h in hashes])[:-1]
    totals = []
    for column in ("rest", "deleted"):
        counts = np.concatenate([_unpack(r[column], np.int64) for r in rows])
        total = np.zeros(len(keys), dtype=np.int64)
        np.add.at(total, places, counts)
        totals.append(total)
    types = int((totals[0] + totals[1] > 0).sum()) if rows[0]["ngrams"] == 1 else 0
    packed = [[_pack(total[p]) for p in np.split(places, cuts)] for total in totals]
    return pa.table(
        {
            "ngrams": asked.column("ngrams"),
            "part": asked.column("part"),
            "block": asked.column("block"),
            "rest": pa.array(packed[0], pa.binary()),
            "deleted": pa.array(packed[1], pa.binary()),
            "types": pa.array([types] + [0] * (len(rows) - 1), pa.int64()),
        }
    )


def _counted(order: int, d_rest: int, d_deleted: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Block and answers to what probabilities depend on: per token the count of every n-gram that
    ends there, and of its context from order 2 on. ``counts`` has the different ones, ``codes`` one
    per token, ``events`` those of deleted tokens without the deleted counts, and how often."""

    def contexts(counts: list[np.ndarray], first: np.ndarray, starts: int) -> np.ndarray:
        columns = [counts[0]]
        for n in range(1, order):
            before = np.empty_like(counts[n - 1])
            before[1:] = counts[n - 1][:-1]
            before[first] = starts
            columns += [counts[n], before]
        return np.stack(columns)

    def different(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = np.zeros(columns.shape[1], dtype=np.uint64)
        with np.errstate(over="ignore"):
            for column in columns:
                mixed = (mixed ^ (mixed >> np.uint64(31))) * _MIX + column.view(np.uint64)
        _, where, places = np.unique(mixed, return_index=True, return_inverse=True)
        return columns[:, where], places

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = block.select(["tokens", "learn", "codes", "words"]).to_pylist()[0]
        words, codes, lengths, learn = _opened(row)
        first = np.cumsum(lengths) - lengths
        parts = sorted(answers.to_pylist(), key=lambda r: (r["ngrams"], r["part"]))
        rest, everything = [], []
        for n, (_, places) in enumerate(_ngrams(words, codes, lengths, order), 1):
            mine = [r for r in parts if r["ngrams"] == n]
            kept, deleted = (
                np.concatenate([_unpack(r[c], np.int64) for r in mine]) for c in ("rest", "deleted")
            )
            rest.append(kept[places])
            everything.append((kept + deleted)[places])
        counts, at = different(contexts(everything, first, d_rest + d_deleted))
        columns = contexts(rest, first, d_rest)[:, learn == 2]
        held, places = different(columns) if columns.size else (columns, np.empty(0, np.int64))
        often = np.bincount(places, minlength=held.shape[1])
        events = np.concatenate([held, often[None, :]])
        return pa.table(
            {
                "rows": block.column("rows"),
                "tokens": block.column("tokens"),
                "codes": pa.array([_pack(at.astype(np.int32))], pa.binary()),
                "counts": pa.array([_pack(counts.ravel())], pa.binary()),
                "events": pa.array([_pack(events.ravel())], pa.binary()),
            }
        )

    return run


# --- interpolation ------------------------------------------------------------------


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.frexp(context.astype(float))[1]


def _mixed(
    counts: np.ndarray, weights: np.ndarray, n_tokens: int, n_types: int
) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Probabilities, and per order the bucket and what the two sides of its mixture give."""
    size = counts.shape[1]
    probability, sides = np.full(size, 1.0 / (n_types + 1)), []
    for n in range(1, len(weights) + 1):
        count = counts[0] if n == 1 else counts[2 * n - 3]
        context = np.full(size, n_tokens) if n == 1 else counts[2 * n - 2]
        bucket = _bucket(context)
        weight = weights[n - 1][bucket]
        seen = weight * count / np.maximum(context, 1)
        left = (1.0 - weight) * probability
        probability = seen + left
        sides.append((bucket, seen, left))
    return probability, sides


def _learned(counted: DataFrame, order: int, n_rest: int, n_types: int) -> np.ndarray:
    """Weight per order and bucket, by expectation-maximisation on the deleted tokens.

    Each step adds up, per order and bucket, how often the mixture gets as far down as this order and
    how often it ends there. One token in two is added to these sums, so a bucket without
    deleted tokens keeps one half and no weight becomes 0 or 1. A context that was not seen has
    weight 0.
    """
    weights = np.full((order, BUCKETS), 0.5)
    weights[:, 0] = 0.0
    events = counted.select("events")
    for _ in range(STEPS):
        found = events.mapInArrow(_expected(weights, n_rest, n_types), "i int, reached double, ended double")
        sums = found.groupBy("i").agg(F.sum("reached"), F.sum("ended")).collect()
        reached, ended = np.full((2, order * BUCKETS), [[1.0], [0.5]])
        for i, r, e in sums:
            reached[i] += r
            ended[i] += e
        better = (ended / reached).reshape(order, BUCKETS)
        better[:, 0] = 0.0
        change = np.abs(better - weights).max()
        weights = better
        if change < TOLERANCE:
            break
    return weights


def _expected(weights: np.ndarray, n_rest: int, n_types: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = len(weights)
        reached, ended = np.zeros((2, order, BUCKETS))
        for batch in batches:
            for packed in batch.column("events").to_pylist():
                columns = _unpack(packed, np.int64).reshape(2 * order, -1)
                counts, often = columns[:-1], columns[-1].astype(float)
                _, sides = _mixed(counts, weights, n_rest, n_types)
                for n in reversed(range(order)):
                    bucket, seen, left = sides[n]
                    here = often * seen / (seen + left)
                    reached[n] += np.bincount(bucket, often, BUCKETS)
                    ended[n] += np.bincount(bucket, here, BUCKETS)
                    often = often - here
        some = np.flatnonzero(reached.ravel())
        yield pa.record_batch(
            {
                "i": pa.array(some.astype(np.int32)),
                "reached": pa.array(reached.ravel()[some]),
                "ended": pa.array(ended.ravel()[some]),
            }
        )

    return run


def _scores(weights: np.ndarray, n_train: int, n_types: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                lengths = _unpack(batch.column("tokens")[i].as_py(), np.int32)
                codes = _unpack(batch.column("codes")[i].as_py(), np.int32)
                counts = _unpack(batch.column("counts")[i].as_py(), np.int64)
                counts = counts.reshape(2 * len(weights) - 1, -1)
                probability, _ = _mixed(counts, weights, n_train, n_types)
                base = (counts[0] + BASE_COUNT) / (n_train + BASE_COUNT * (n_types + 1))
                first = np.cumsum(lengths) - lengths
                known, by_base, by_model = (
                    np.add.reduceat(values[codes], first)
                    for values in ((counts[0] > 0).astype(np.int64), np.log10(base), np.log10(probability))
                )
                yield pa.record_batch(
                    {
                        "row": batch.column("rows").slice(i, 1).flatten(),
                        "n_tokens": pa.array(lengths.astype(np.int64)),
                        "n_known": pa.array(known),
                        "train_tokens": pa.array(np.full(len(lengths), n_train), pa.int64()),
                        "base_score": pa.array(by_base),
                        "score": pa.array(by_model),
                    }
                )

    return run
