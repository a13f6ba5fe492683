from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import cellprofiles as cp
from cellprofiles.operators import evaluate, pairs

GROUPS, PER_GROUP, WIDTH = 4, 12, 5


def profile_rows(group=0.0, batch=0.0, patient=0.0, seed=0, width=WIDTH):
    """Profiles with planted offsets per disease group, batch and patient."""
    rng = np.random.default_rng(seed)
    offsets = {kind: rng.normal(size=(8, width)) for kind in ("g", "b", "p")}
    rows = []
    for i in range(GROUPS * PER_GROUP):
        g, b, p = i % GROUPS, (i // GROUPS) % 2, i % 8
        x = rng.normal(size=width)
        x += group * offsets["g"][g] + batch * offsets["b"][b] + patient * offsets["p"][p]
        rows.append((i, f"G{g}", f"B{b}", f"P{p}", *map(float, x)))
    return rows


def frame(spark, rows):
    width = len(rows[0]) - 4
    ddl = (
        "Metadata_Row int, Metadata_DiseaseGroup string, Metadata_Batch string, "
        "Metadata_PatientID string, "
    ) + ", ".join(f"Cells_F{i} double" for i in range(width))
    return spark.createDataFrame(rows, ddl)


def value(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].value


def arrays(rows, label):
    place = {"group": 1, "batch": 2, "patient": 3}[label]
    return np.array([r[4:] for r in rows], dtype=float), np.array([r[place] for r in rows])


def distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))


def brute_map(x, labels, decimals=12):
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    unit = x / np.where(norm > 0, norm, 1)
    similarity = np.round(unit @ unit.T, decimals)
    scores = []
    for i in range(len(x)):
        others = np.arange(len(x)) != i
        same, s = labels[others] == labels[i], similarity[i, others]
        if 0 < same.sum() < len(same):
            scores.append(np.mean([same[s >= t].mean() for t in s[same]]))
    return np.mean(scores)


def brute_silhouette(x, labels):
    d, scores = distances(x), []
    for i in range(len(x)):
        means = {
            g: d[i, labels == g].sum() / (np.sum(labels == g) - (g == labels[i]))
            for g in set(labels)
            if np.sum(labels == g) > (g == labels[i])
        }
        if labels[i] not in means:
            scores.append(0.0)
            continue
        a = means.pop(labels[i])
        b = min(means.values())
        scores.append((b - a) / max(a, b))
    return np.mean(scores)


def brute_mixing(x, labels, k=15, skip=0):
    d = distances(x)
    crossing = []
    for i in range(len(x)):
        order = sorted((d[i, j], j) for j in range(len(x)) if j != i)
        near = [j for _, j in order[skip : min(k, len(x) - 1) + skip]]
        crossing += [labels[j] != labels[i] for j in near]
    share = np.array([np.mean(labels == b) for b in set(labels)])
    return np.mean(crossing) / (1 - np.sum(share**2))


@pytest.fixture
def tiny_blocks(monkeypatch):
    """Several tiles and several slices per tile even for small data."""
    monkeypatch.setattr(pairs, "_MIN_BLOCK_ROWS", 10)
    monkeypatch.setattr(pairs, "_SLICE", 4)


@pytest.fixture(scope="module")
def rows():
    planted = profile_rows(group=1.0, batch=0.5, patient=0.5)
    # A third of the rows are copies of one profile, and one profile is all zero.
    copies = [(100 + i, "G1", f"B{i % 2}", "P1", *planted[0][4:]) for i in range(25)]
    return planted + copies + [(200, "G2", "B0", "P2", *[0.0] * WIDTH)]


@pytest.mark.parametrize("max_listed", [1024, 8, 0])
def test_retrieval_equals_brute_force(spark, rows, tiny_blocks, max_listed):
    expected = brute_map(*arrays(rows, "patient"))
    found = cp.replicate_reproducibility(
        frame(spark, rows), row_id="Metadata_Row", max_listed=max_listed
    )
    assert value(found) == pytest.approx(expected, abs=1e-9)


def test_retrieval_skips_profiles_without_replicates(spark, tiny_blocks):
    rows = profile_rows(patient=1.0)
    rows = [(*r[:3], f"P{i}" if i < 5 else r[3], *r[4:]) for i, r in enumerate(rows)]
    found = cp.replicate_reproducibility(frame(spark, rows))
    assert value(found) == pytest.approx(brute_map(*arrays(rows, "patient")), abs=1e-9)
    alone = [(*r[:3], f"P{i}", *r[4:]) for i, r in enumerate(rows)]
    assert math.isnan(value(cp.replicate_reproducibility(frame(spark, alone))))
    one = [(*r[:3], "P", *r[4:]) for r in rows]
    assert math.isnan(value(cp.replicate_reproducibility(frame(spark, one))))


def test_silhouette_equals_brute_force(spark, rows, tiny_blocks):
    single = rows + [(300, "alone", "B0", "P0", *map(float, range(WIDTH)))]
    found = cp.silhouette(frame(spark, single))
    assert value(found) == pytest.approx(brute_silhouette(*arrays(single, "group")), abs=1e-9)


@pytest.mark.parametrize("split", [1, 5, 11])
def test_split_labels_give_the_same_silhouette(spark, rows, tiny_blocks, monkeypatch, split):
    monkeypatch.setattr(evaluate, "SPLIT_LABEL_ROWS", split)
    for label, column in (("group", "Metadata_DiseaseGroup"), ("patient", "Metadata_PatientID")):
        found = value(cp.silhouette(frame(spark, rows), column, row_id="Metadata_Row"))
        assert found == pytest.approx(brute_silhouette(*arrays(rows, label)), abs=1e-9)


def test_stripes_give_the_same_retrieval(spark, rows, monkeypatch):
    want = brute_map(*arrays(rows, "patient"))
    for stripe in (1, 100, 10**6):
        monkeypatch.setattr(evaluate, "STRIPE_PAIRS", stripe)
        df = frame(spark, rows)
        found = cp.replicate_reproducibility(df, row_id="Metadata_Row", max_listed=0)
        assert value(found) == pytest.approx(want, abs=1e-9)


def test_tiles_return_few_rows_per_query(rows):
    import pyarrow as pa

    def block(labels):
        n = len(labels)
        return pairs.Block(
            pa.table(
                {
                    "_row": np.arange(n),
                    "_tie": np.arange(n),
                    "_vec": list(np.random.default_rng(1).normal(size=(n, 3))),
                    "l": labels,
                    "_split": np.zeros(n, dtype=bool),
                    "_label_size": np.full(n, 4),
                }
            )
        )

    many = block([str(i // 4) for i in range(400)])
    assert len(evaluate._label_distances("l")(many, many)) == 400


@pytest.mark.parametrize("k,skip", [(15, 0), (3, 1), (500, 0)])
def test_mixing_equals_brute_force(spark, rows, tiny_blocks, k, skip):
    found = cp.batch_mixing(frame(spark, rows), k=k, skip=skip, row_id="Metadata_Row")
    expected = brute_mixing(*arrays(rows, "batch"), k=k, skip=skip)
    assert value(found) == pytest.approx(expected, abs=1e-9)


def test_classifier_finds_planted_groups_and_not_noise(spark, tiny_blocks):
    clear = value(cp.label_classifiability(frame(spark, profile_rows(group=8.0)), "Metadata_DiseaseGroup"))
    noise = value(cp.label_classifiability(frame(spark, profile_rows()), "Metadata_DiseaseGroup"))
    assert clear == pytest.approx(1.0)
    assert 0.0 <= noise < 0.6
    with_id = [
        value(
            cp.label_classifiability(
                frame(spark, profile_rows(group=0.7)).repartition(n),
                "Metadata_DiseaseGroup",
                row_id="Metadata_Row",
            )
        )
        for n in (1, 5)
    ]
    assert with_id[0] == with_id[1]


def test_chance_level(spark):
    df = frame(spark, profile_rows())
    assert value(cp.chance_level(df, "Metadata_DiseaseGroup")) == pytest.approx(0.25)
    assert math.isnan(value(cp.chance_level(df.limit(0), "Metadata_DiseaseGroup")))


@pytest.mark.parametrize(
    "metric,knob,direction",
    [
        (cp.replicate_reproducibility, "patient", 1),
        (cp.silhouette, "group", 1),
        (cp.batch_mixing, "batch", -1),
    ],
)
def test_a_stronger_effect_moves_the_metric(spark, metric, knob, direction):
    weak, strong = (value(metric(frame(spark, profile_rows(**{knob: s})))) for s in (0.0, 4.0))
    assert direction * (strong - weak) > 0.1


def test_gaps_are_imputed_and_empty_features_ignored(spark, rows):
    df = frame(spark, rows)
    gappy = df.withColumns(
        {
            "Cells_F0": F.when(F.col("Metadata_Row") % 5 != 0, F.col("Cells_F0")),
            "Cells_Empty": F.lit(None).cast("double"),
        }
    )
    x, labels = arrays(rows, "group")
    missing = np.array([r[0] % 5 == 0 for r in rows])
    x[missing, 0] = np.median(x[~missing, 0])
    assert value(cp.silhouette(gappy)) == pytest.approx(brute_silhouette(x, labels), abs=1e-9)


def test_tiny_input_gives_nan(spark):
    two = frame(spark, profile_rows()[:2])
    for metric in (cp.replicate_reproducibility, cp.silhouette, cp.batch_mixing):
        assert math.isnan(value(metric(two)))
    assert math.isnan(value(cp.label_classifiability(two, "Metadata_DiseaseGroup")))
    no_features = frame(spark, profile_rows()).drop(*[f"Cells_F{i}" for i in range(WIDTH)])
    assert math.isnan(value(cp.silhouette(no_features)))


def test_scorecard_reacts_to_batch_strength(spark, tmp_path):
    mild, hard = (frame(spark, profile_rows(group=1.0, batch=b, patient=0.5)) for b in (0.0, 6.0))
    path = cp.write_parquet(mild, str(tmp_path / "profiles"))
    a = {r.metric: r for r in cp.benchmark_from_path(spark, path).collect()}
    b = {r.metric: r for r in cp.benchmark(hard, row_id="Metadata_Row").collect()}
    assert list(a) == [
        "replicate_reproducibility_map",
        "disease_silhouette",
        "disease_classifier_balacc",
        "batch_classifier_balacc",
        "batch_mixing_ratio",
    ]
    assert b["batch_classifier_balacc"].value > a["batch_classifier_balacc"].value
    assert b["batch_mixing_ratio"].value < a["batch_mixing_ratio"].value
    assert a["disease_classifier_balacc"].interpretation == "higher is better; chance=0.250"


def test_long_rankings_are_cut_into_ranges(spark, rows, monkeypatch):
    """Rankings longer than a stripe, with bins so wide that ranges hold many copies, and so narrow
    that most hold one."""
    want = brute_map(*arrays(rows, "patient"))
    monkeypatch.setattr(evaluate, "STRIPE_PAIRS", 20)
    for bits in (41, 36, 10):
        monkeypatch.setattr(evaluate, "_BIN_BITS", bits)
        found = cp.replicate_reproducibility(frame(spark, rows), row_id="Metadata_Row", max_listed=0)
        assert value(found) == pytest.approx(want, abs=1e-9)


def test_hot_retrieval_sends_rows_once_per_block(spark, monkeypatch):
    """Rows of the tiles: every profile once per block of the other side; and one row comes out per
    query and tile, one per query in the end."""
    n, side, seen = 300, 64, {}
    rng = np.random.default_rng(0)
    rows = [(i, "G", "B", f"P{i % 2}", *map(float, rng.normal(size=WIDTH))) for i in range(n)]
    monkeypatch.setattr(evaluate, "STRIPE_PAIRS", side * side)
    monkeypatch.setattr(evaluate, "_MIN_SIDE", 1)
    original = evaluate.tiles

    def counting(data, *args, **options):
        seen["blocks"] = data.blocks(options["block_rows"])
        seen["runs"] = original(data, *args, **options)
        return seen["runs"]

    monkeypatch.setattr(evaluate, "tiles", counting)
    data = pairs.prepare_profiles(frame(spark, rows), ["Metadata_PatientID"], row_id="Metadata_Row")
    found = value(cp.replicate_reproducibility(data, "Metadata_PatientID", max_listed=0))
    assert found == pytest.approx(brute_map(*arrays(rows, "patient")), abs=1e-9)
    assert seen["blocks"] == max(-(-n // side), data.blocks())
    assert seen["runs"].count() == n * seen["blocks"]
    sent = seen["runs"]._jdf.queryExecution().executedPlan().toString()
    assert sent.count("Generate explode") <= 2  # tiles and sides, no copy per stripe


@pytest.mark.parametrize("sizes", [[1025, 1025, 1025], [3000, 40, 7], [1] * 50 + [2] * 30 + [300, 299, 150, 20]])
def test_labels_are_packed_into_blocks(spark, sizes):
    labels = [(str(i), n) for i, n in enumerate(sizes)]
    table = spark.createDataFrame(labels, "l string, _label_size long")
    table = table.select(F.struct("l").alias("_key"), "_label_size")
    capacity = 512
    packed, n_packed, n_hashed = evaluate._pack_labels(table, capacity)
    load, size_of = {}, dict(labels)
    for row in packed.collect():
        size = size_of[row["_key"]["l"]]
        assert row["_chunks"] == max(1, -(-size // capacity))
        for block in range(row["_first"], row["_first"] + row["_chunks"]):
            load.setdefault(block, []).append(size / row["_chunks"])
    assert sorted(load) == list(range(n_packed))
    for parts in load.values():
        assert sum(parts) <= capacity
    small = sum(n for n in sizes if n * 16 <= capacity)
    assert n_hashed == -(-small // capacity)
    # No more than twice the blocks that the rows need, and one for what is left.
    assert n_packed + n_hashed <= 2 * -(-sum(sizes) // capacity) + 1


def test_silhouette_returns_one_row_per_query_and_tile(spark, monkeypatch):
    """Labels of 1,025 rows: whole, and cut."""
    rng = np.random.default_rng(1)
    rows = [(i, f"G{i // 1025}", "B", "P", *map(float, rng.normal(size=2))) for i in range(2 * 1025 + 30)]
    expected, seen, original = brute_silhouette(*arrays(rows, "group")), {}, evaluate.tiles

    def counting(data, *args, **options):
        seen["out"] = original(data, *args, **options)
        seen["tiles"] = options["candidate_block"][1]
        return seen["out"]

    monkeypatch.setattr(evaluate, "tiles", counting)
    for limit in (16_384, 200):
        monkeypatch.setattr(evaluate, "SPLIT_LABEL_ROWS", limit)
        found = value(cp.silhouette(frame(spark, rows), row_id="Metadata_Row"))
        assert found == pytest.approx(expected, abs=1e-9)
        assert seen["out"].count() <= len(rows) * seen["tiles"]


def test_any_column_name(spark):
    """Dots, spaces and backticks in features, labels and the row's own number change nothing."""
    import random

    draw = random.Random(5)
    rows = [(i, "ab"[i % 2], "xyz"[i % 3], *(draw.gauss(i % 2, 1) for _ in range(3))) for i in range(60)]
    rows = [(*r[:4], None if r[0] % 7 == 0 else r[4], r[5]) for r in rows]
    plain = ["row", "Metadata_Label", "Metadata_Batch", "Cells_A", "Cells_B", "Cells_C"]
    odd = ["row no.", "Metadata_Label.x", "Metadata Batch`s", "Cells_A.b", "Cells `B`", "Cells_C.b c"]
    types = ["long", "string", "string", "double", "double", "double"]
    scores = []
    for names in (plain, odd):
        ddl = ", ".join(f"`{n.replace('`', '``')}` {t}" for n, t in zip(names, types))
        out = cp.benchmark(
            spark.createDataFrame(rows, ddl),
            disease_col=names[1],
            batch_col=names[2],
            replicate_col=names[1],
            features=names[3:],
            row_id=names[0],
            n_splits=3,
        )
        scores.append({r.metric: r.value for r in out.collect()})
    assert scores[0] == pytest.approx(scores[1], abs=1e-9) and len(scores[0]) == 5


def test_products_give_the_squares_of_differences():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 7)) + 1e6
    x[40:50] = x[:10]
    x[50:55] = x[:5] + 1e-7
    x[59, 2] = np.nan
    squares, want = pairs.Squares(x), ((x[:, None] - x[None]) ** 2).sum(axis=2)
    part = slice(20, 60)
    found = squares.of(x, squares.queries(x), part)
    np.testing.assert_allclose(found, want[:, part], rtol=1e-9, equal_nan=True)
    assert (found[range(10), range(20, 30)] == 0).all()
    bound = squares.at_least(squares.queries(x), part)
    assert not (bound > want[:, part]).any()


def test_large_tables_have_few_blocks(spark):
    """Rows are sent once per block, so 600,000 rows of 64 values go to no more blocks than cores need."""
    large = pairs.Profiles(spark.range(1), 600_000, 64, ())
    cores = spark.sparkContext.defaultParallelism
    assert large.blocks() <= max(5, math.ceil(math.sqrt(4 * cores)))


def test_short_chunks_make_no_more_tiles(spark, rows, tiny_blocks, monkeypatch):
    """Labels cut into chunks of two rows: as few blocks as the rows need, and the same silhouette."""
    seen, original = {}, evaluate.tiles

    def counting(data, *args, **options):
        seen["blocks"], seen["candidate"] = data.blocks(), options["candidate_block"][1]
        return original(data, *args, **options)

    monkeypatch.setattr(evaluate, "tiles", counting)
    found = value(cp.silhouette(frame(spark, rows), row_id="Metadata_Row", chunk_rows=2))
    assert found == pytest.approx(brute_silhouette(*arrays(rows, "group")), abs=1e-9)
    assert seen["candidate"] <= 2 * seen["blocks"] + 1


def test_queries_of_large_groups_take_turns(spark, rows, tiny_blocks, monkeypatch):
    """One block of queries at a time, every block once, and the same retrieval."""
    seen, original = [], evaluate.tiles

    def counting(data, *args, **options):
        seen.append((*options["query_blocks"], data.blocks(options["block_rows"])))
        return original(data, *args, **options)

    monkeypatch.setattr(evaluate, "tiles", counting)
    monkeypatch.setattr(evaluate, "WAVE_PAIRS", 1)
    found = cp.replicate_reproducibility(frame(spark, rows), row_id="Metadata_Row", max_listed=0)
    assert value(found) == pytest.approx(brute_map(*arrays(rows, "patient")), abs=1e-9)
    n_blocks = seen[0][2]
    assert n_blocks > 1 and [s[:2] for s in seen] == [(i, i + 1) for i in range(n_blocks)]


@pytest.mark.parametrize("at_a_time", [1, 200, 10**6])
def test_rankings_that_one_block_holds_leave_no_tile(spark, rows, tiny_blocks, monkeypatch, at_a_time):
    """One block of candidates, one number per query from its tile, and the same retrieval, also of
    rows that share an identity."""
    seen, original = [], evaluate.tiles

    def counting(data, *args, **options):
        seen.append((options["candidate_block"][1], original(data, *args, **options)))
        return seen[-1][1]

    want = brute_map(*arrays(rows, "patient"))
    again = frame(spark, rows + rows[:7])
    twice = evaluate.prepare_profiles(again, ["Metadata_PatientID"], row_id="Metadata_Row")
    tiled = value(cp.replicate_reproducibility(twice, "Metadata_PatientID", max_listed=0))
    monkeypatch.setattr(evaluate, "tiles", counting)
    monkeypatch.setattr(evaluate, "TILED_PAIRS", 0)
    monkeypatch.setattr(evaluate, "STRIPE_PAIRS", at_a_time)
    found = cp.replicate_reproducibility(frame(spark, rows), row_id="Metadata_Row", max_listed=0)
    assert value(found) == pytest.approx(want, abs=1e-9)
    assert [n for n, _ in seen] == [1] and set(seen[0][1].columns) == {"_row", "_part", "_hits"}
    found = cp.replicate_reproducibility(twice, "Metadata_PatientID", max_listed=0)
    assert value(found) == pytest.approx(tiled, abs=1e-12)


def test_rankings_over_several_blocks_leave_no_tile(spark, rows, tiny_blocks, monkeypatch):
    """Candidates of more than one block, in many batches: one number per query comes out, and the same
    retrieval, also of missing labels and of vectors with infinite entries."""
    seen, original = [], evaluate.tiles

    def counting(data, *args, **options):
        seen.append(original(data, *args, **options))
        return seen[-1]

    labels = [None if r[3] == "P3" else r[3] for r in rows]
    vectors = [(i, l, [*map(float, r[4:])]) for i, (l, r) in enumerate(zip(labels, rows))]
    vectors[7][2][1], vectors[30][2][0] = float("inf"), float("-inf")
    table = spark.createDataFrame(vectors, "id long, l string, v array<double>")
    odd = pairs.prepare_vectors(table, "v", ["l"], "id")
    ranked = value(cp.replicate_reproducibility(odd, "l", max_listed=0))
    monkeypatch.setattr(evaluate, "tiles", counting)
    monkeypatch.setattr(evaluate, "TILED_PAIRS", 0)
    monkeypatch.setattr(evaluate, "BLOCK_ROWS", 20, raising=False)
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 20)
    monkeypatch.setattr(evaluate, "RANKED_PAIRS", 1000, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = value(cp.replicate_reproducibility(frame(spark, rows), row_id="Metadata_Row", max_listed=0))
        whole = value(cp.replicate_reproducibility(odd, "l", max_listed=0))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == pytest.approx(brute_map(*arrays(rows, "patient")), abs=1e-9)
    assert whole == pytest.approx(ranked, abs=1e-12)
    assert [set(s.columns) for s in seen] == [{"_row", "_part", "_hits"}] * 2


@pytest.mark.parametrize("size", [1.0, 1e-30, 1e-9, 1e10, 1e25, 1e160])
def test_bounds_are_below_the_squares_and_near_them(size):
    """Small, large and very different vectors: no bound is above, and a limit passes over no such pair."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 12)) * size
    x[100:120] *= 1e-6
    x[120:125] = x[:5]
    queries = np.concatenate([x, x[:20] * 1e12])
    with np.errstate(over="ignore", invalid="ignore"):
        want = ((queries[:, None] - x[None]) ** 2).sum(axis=2)
        squares = pairs.Squares(x)
        bound = squares.at_least(squares.queries(queries), slice(0, 300))
        for column in (0, 110, 122):
            limit = want[:, column]
            assert not (bound[:, column] > squares.limits(limit)).any()
        there = np.isfinite(bound)
        assert not (bound[there] > want[there] * (1 + 1e-6)).any()
    if size == 1.0:
        plain = bound[:300][want[:300] > 1]
        assert (plain > 0.999 * want[:300][want[:300] > 1]).all() and bound.dtype == np.float32


def test_few_queries_are_compared_pair_by_pair():
    """Squares of far pairs come from one product, without a second table of their sums of lengths."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16))
    x[399] = x[0]
    squares, asked = pairs.Squares(x), []
    original = squares.exact
    squares.exact = lambda v, q, c: asked.append(len(q)) or original(v, q, c)
    found = squares.of(x[:50], squares.queries(x[:50]), slice(50, 400))
    np.testing.assert_allclose(found, ((x[:50, None] - x[None, 50:]) ** 2).sum(axis=2), rtol=1e-10)
    assert asked == [1] and found[0, -1] == 0 and squares.wide.shape == (18, 400)


@pytest.mark.parametrize("width", [1, 9, 64, 300])
def test_a_pair_has_one_distance(width, monkeypatch):
    """Whatever else is measured with it, whichever side asks, and with few values held at a time."""
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(40, width)), rng.normal(size=(40, width))
    whole = pairs.paired_squares(a, b)
    assert (pairs.paired_squares(b, a) == whole).all() and not pairs.paired_squares(a, a).any()
    assert [pairs.paired_squares(a[i : i + 1], b[i : i + 1])[0] for i in range(40)] == whole.tolist()
    monkeypatch.setattr(pairs, "_CLOSE_VALUES", 3 * width)
    seen, original = [], pairs.paired_squares
    monkeypatch.setattr(pairs, "paired_squares", lambda q, c: seen.append(q.size) or original(q, c))
    assert (pairs.Squares(b).exact(a, np.arange(40), np.arange(40)) == whole).all()
    assert max(seen) <= 3 * width
