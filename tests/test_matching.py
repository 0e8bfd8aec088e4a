"""The three plans of the nearest-neighbour match against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hitgauge.operators.encoding import batch_encoder, encode_distinct, encode_rows, hashed_token_encoder
from hitgauge.operators.matching import (
    MAX_TILE_PARTITIONS, _tile_grid, match_self, match_top_1, match_top_k, match_with_text,
)
from hitgauge.plans.jobs import load_data, run_matching

DIM = 8
PLANS = {
    "few queries": {},
    "small cache": {"broadcast_bytes": "cache"},
    "tiles": {"broadcast_bytes": 0, "tile_bytes": 20 * DIM * 4},
}


def vectors(spark, values, ids=None, extra=None):
    ids = range(len(values)) if ids is None else ids
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, values)]
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def brute(q, c, k=1, mask=None, order=None):
    """Best k cache rows per query by (rounded score, position)."""
    qn, cn = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    norms = np.outer(qn, cn)
    s = np.divide(q @ c.T, norms, out=np.zeros_like(norms), where=norms > 0)
    out = {}
    position = np.arange(len(c)) if order is None else order
    for i in range(len(q)):
        cols = [j for j in range(len(c)) if mask is None or not mask(i, j)]
        cols.sort(key=lambda j: (-round(s[i, j], 9), position[j]))
        out[i] = [(j, s[i, j]) for j in cols[:k]]
    return out


def as_dict(found, k=1):
    out = {}
    rows = found.collect() if k == 1 else found.orderBy("id", "rank").collect()
    for r in rows:
        out.setdefault(r.id, []).append((r.match_id, r.score))
    return out


def assert_same(got, expected):
    assert set(got) == {i for i, best in expected.items() if best}
    for i, best in got.items():
        assert [m for m, _ in best] == [m for m, _ in expected[i]]
        assert [s for _, s in best] == pytest.approx([s for _, s in expected[i]], abs=1e-9)


def sample_sets(seed=1, n_q=60, n_c=130, copies=True):
    rng = np.random.default_rng(seed)
    c = rng.integers(-3, 4, (n_c, DIM)).astype(float)
    q = rng.integers(-3, 4, (n_q, DIM)).astype(float)
    if copies:  # a third of the cache is one vector, a third of the queries ask for it
        c[: n_c // 3] = c[0]
        q[: n_q // 3] = c[0]
        q[-1] = 0
        c[-1] = 0
    return q, c


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("k", [1, 3, 200])
def test_plans_equal_brute_force(spark, plan, k):
    q, c = sample_sets()
    options = dict(PLANS[plan])
    if options.get("broadcast_bytes") == "cache":
        q, c = np.vstack([q, q, q]), c[:100]
        options["broadcast_bytes"] = 100 * DIM * 4
    found = match_top_k(vectors(spark, q), vectors(spark, c), query_id="id", cache_id="id", k=k, **options)
    assert_same(as_dict(found, k), brute(q, c, k))


@pytest.mark.parametrize("plan", ["few queries", "tiles"])
def test_ties_go_to_the_lowest_position(spark, plan):
    q, c = sample_sets()
    order = np.random.default_rng(3).permutation(len(c))
    cache = vectors(spark, c).join(
        spark.createDataFrame([(i, int(p)) for i, p in enumerate(order)], "id long, pos long"), "id"
    )
    found = match_top_1(vectors(spark, q), cache, query_id="id", cache_id="id", order="pos", **PLANS[plan])
    assert_same(as_dict(found), brute(q, c, order=order))


@pytest.mark.parametrize("plan", PLANS)
def test_self_match_excludes_the_row_not_its_copies(spark, plan):
    _, c = sample_sets()
    options = dict(PLANS[plan])
    if options.get("broadcast_bytes") == "cache":
        options["broadcast_bytes"] = 0
        options["tile_bytes"] = 1 << 20  # one tile
    found = as_dict(match_self(vectors(spark, c), id_col="id", **options))
    assert_same(found, brute(c, c, mask=lambda i, j: i == j))
    assert found[0][0][0] == 1 and found[0][0][1] == pytest.approx(1.0)
    assert found[5][0][0] == 0


@pytest.mark.parametrize("plan", ["few queries", "tiles"])
def test_offset_self_mask(spark, plan):
    _, c = sample_sets(copies=False)
    part = vectors(spark, c[40:90])
    found = match_top_1(part, vectors(spark, c), query_id="id", cache_id="id", exclude_self=True,
                        self_offset=40, **PLANS[plan])
    assert_same(as_dict(found), brute(c[40:90], c, mask=lambda i, j: i + 40 == j))


@pytest.mark.parametrize("plan", ["few queries", "tiles"])
def test_groups_match_inside_themselves(spark, plan):
    q, c = sample_sets(copies=False)
    queries = vectors(spark, q).withColumn("run", (F.col("id") % 3).cast("int"))
    cache = vectors(spark, c).withColumn("run", (F.col("id") % 2).cast("int"))
    found = as_dict(match_top_1(queries, cache, query_id="id", cache_id="id", by="run", **PLANS[plan]))
    expected = brute(q, c, mask=lambda i, j: i % 3 != j % 2)
    assert_same(found, expected)
    assert 2 not in found  # run 2 has no cache


def test_empty_sides_and_null_vectors(spark):
    q, c = sample_sets()
    none = vectors(spark, [])
    for a, b in ((vectors(spark, q), none), (none, vectors(spark, c)), (none, none)):
        for options in (PLANS["few queries"], PLANS["tiles"]):
            assert match_top_1(a, b, query_id="id", cache_id="id", **options).count() == 0
    nulls = vectors(spark, c).withColumn("embedding", F.when(F.col("id") > 0, F.col("embedding")))
    found = match_top_1(vectors(spark, q), nulls, query_id="id", cache_id="id")
    assert found.filter("match_id = 0").count() == 0


def test_single_row_self_match_finds_nothing(spark):
    assert match_self(vectors(spark, [[1.0] * DIM]), id_col="id").count() == 0


def test_vectors_of_different_size_are_refused(spark):
    mixed = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, embedding array<float>")
    with pytest.raises(ValueError, match="dimensions"):
        match_top_1(mixed, mixed, query_id="id", cache_id="id")


QUERIES = ["how do I reset my password?", "store hours on sunday", "Halloween movies", "Horror movies",
           "Scary movies", "mama ms rachel", "ms rachel"]
CACHE = ["reset your password", "our store hours", *QUERIES[2:]]


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values, 1)), "id long, text string")


def test_sample_log_against_sample_cache(spark):
    queries, cache = load_data(texts(spark, QUERIES), "id", texts(spark, CACHE))
    rows = {r.text: r for r in run_matching(queries, cache, id_col="id").collect()}
    assert len(rows) == 7
    for text in QUERIES[2:]:
        assert rows[text].matches == text and rows[text].best_scores == pytest.approx(1.0)
    assert rows[QUERIES[0]].matches == CACHE[0]
    assert rows[QUERIES[1]].matches == CACHE[1]


def test_empty_cache_gives_no_hits(spark):
    queries, cache = load_data(texts(spark, QUERIES), "id")
    rows = run_matching(queries, cache, id_col="id").collect()
    assert len(rows) == 7 and all(r.matches == "" and r.best_scores == 0.0 and r.match_id is None for r in rows)


def test_hashed_tokens(spark):
    rows = texts(spark, ["a b a", "B,A;a", "", None, "ÄÖ ü"])
    out = [list(r.embedding) for r in encode_rows(rows, "text", hashed_token_encoder()).orderBy("id").collect()]
    assert out[0] == out[1] and sum(out[0]) == 3 and sum(out[2]) == sum(out[3]) == sum(out[4]) == 0
    assert len(out[0]) == 256


def test_distinct_encoding_calls_the_model_once_per_text(spark):
    def load():
        return lambda chunk: np.array([[len(t), 1.0] for t in chunk])

    copies = texts(spark, ["x"] * 50 + ["yy"] * 3)
    out = encode_distinct(copies, "text", batch_encoder(load, batch_size=2, normalize=True), normalize=False)
    rows = {r.text: list(r.embedding) for r in out.collect()}
    assert set(rows) == {"x", "yy"}
    assert rows["yy"] == pytest.approx([2 / 5**0.5, 1 / 5**0.5], abs=1e-6)


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("k", [1, 3])
def test_texts_come_with_every_plan(spark, k, plan):
    q, c = sample_sets()
    options = dict(PLANS[plan])
    if options.get("broadcast_bytes") == "cache":
        q, c, options = np.vstack([q, q, q]), c[:100], {}
    cache = vectors(spark, c).withColumn("text", F.concat(F.lit("text of "), "id")).repartition(5)
    found = match_with_text(vectors(spark, q), cache, "text", query_id="id", cache_id="id", k=k, **options)
    assert set(found.columns) == {"id", "match_id", "score", "rank", "matches"}
    rows = found.collect()
    assert len(rows) == k * len(q)
    assert all(r.matches == f"text of {r.match_id}" for r in rows)


@pytest.mark.parametrize("sizes", [(0, 5), (5, 0), (10**6, 10), (10**6, 10**6), (10**9, 10**9), (10**9, 10**5)])
def test_tiles_are_bounded_and_few(sizes):
    most, cores = 262_144, 4000
    n_rows, n_cols = _tile_grid(*sizes, most, cores)
    assert n_rows >= 1 and n_cols >= 1 and sizes[0] / n_rows <= most
    assert n_rows * n_cols <= MAX_TILE_PARTITIONS + n_rows
    if sizes == (10**9, 10**9):  # a vector goes to a row or column of tiles, not to all bounded products
        assert n_rows + n_cols < 4000


def test_equal_texts_are_encoded_once(spark, tmp_path):
    from hitgauge.plans.jobs import bootstrap_matches

    folder = str(tmp_path)

    def load():
        import os
        import uuid

        def model(texts):
            for _ in texts:
                open(os.path.join(folder, uuid.uuid4().hex), "w").close()
            return [[float(len(t)), 1.0] for t in texts]

        return model

    encoder = batch_encoder(load)
    log = spark.range(40).select("id", F.repeat(F.lit("x"), (F.col("id") % 5 + 1).cast("int")).alias("text"))
    queries, cache = load_data(log, "id", n_samples=10)
    plain = run_matching(queries, cache, id_col="id", encoder=encoder).orderBy("id").collect()
    before = len(list(tmp_path.iterdir()))
    assert before >= 40
    assert run_matching(queries, cache, id_col="id", encoder=encoder, encode_once=True).orderBy("id").collect() == plain
    assert len(list(tmp_path.iterdir())) == before + 5
    runs = bootstrap_matches(log, {"m": encoder}, id_col="id", n_runs=2, n_samples=5, encode_once=True)
    assert runs.count() == 10 and len(list(tmp_path.iterdir())) == before + 10


def test_matcher_can_be_replaced(spark):
    queries = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    cache = spark.createDataFrame([(7, "x")], "id long, text string")

    def matcher(q, c, text, *, query_id, cache_id, **_):
        one = c.select(F.col(cache_id).alias("match_id"), F.col(text).alias("matches"))
        return q.filter("id = 1").select(query_id).join(one, F.lit(True)).withColumn("score", F.lit(0.25))

    found = run_matching(queries, cache, id_col="id", order=None, matcher=matcher).orderBy("id").collect()
    assert [(r.id, r.match_id, r.matches, r.best_scores) for r in found] == [(1, 7, "x", 0.25), (2, None, "", 0.0)]


def test_unusable_vectors_touch_no_other_row(spark):
    """NaN, infinite and partly missing vectors match nothing, in all plans and for any k."""
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(size=4).tolist()) for i in range(12)]
    bad = [(100, [float("nan")] * 4), (101, [1.0, float("inf"), 0.0, 0.0]), (102, [1.0, None, 0.0, 0.0]), (103, None)]
    schema = "id long, embedding array<float>"
    queries = spark.createDataFrame(good[:4] + bad, schema)
    few, many = spark.createDataFrame(good + bad, schema), spark.createDataFrame(good, schema)
    for k in (1, 3):
        for options in ({}, {"broadcast_bytes": 0, "tile_bytes": 64}, {"broadcast_bytes": 128}):
            found, wanted = (
                {(r.id, r["rank"]): r.match_id for r in match_top_k(
                    queries, cache, query_id="id", cache_id="id", vector="embedding", k=k, **options).collect()}
                for cache in (few, many)
            )
            assert found == wanted and len(found) == 4 * k


@pytest.mark.parametrize("k", [1, 3])
def test_tiles_of_many_parts_and_blocks_equal_brute_force(spark, monkeypatch, k):
    from hitgauge.operators import matching

    monkeypatch.setattr(matching, "HELD_BYTES", 50 * DIM * 4)
    monkeypatch.setattr(matching, "BLOCK_BYTES", 7 * DIM * 4)
    monkeypatch.setattr(matching, "MIN_TILE_ROWS", 20)
    _, c = sample_sets()
    seen, inner = [], matching._blocks
    monkeypatch.setattr(matching, "_blocks", lambda *a: seen.append(inner(*a)) or seen[-1])
    rows = vectors(spark, c)
    found = match_top_k(rows, rows, query_id="id", cache_id="id", k=k, exclude_self=True, broadcast_bytes=0, tile_bytes=64)
    assert_same(as_dict(found, k), brute(c, c, k, mask=lambda i, j: i == j))
    for side, name in zip(seen, "qc"):
        assert side.count() > 10 and side.select(F.sum(F.size(name))).first()[0] == len(c)


def test_tiles_copy_no_vector(spark):
    """However small the tiles, a vector is dealt out once; tiles read the parts again."""
    from oracle_check import plan

    rows = vectors(spark, sample_sets()[1])
    text = plan(match_self(rows, id_col="id", broadcast_bytes=0, tile_bytes=DIM * 4))
    assert "CartesianProduct" in text and "Generate" not in text


def test_texts_are_cut_in_pieces_of_bounded_bytes(monkeypatch):
    from hitgauge.operators import encoding

    monkeypatch.setattr(encoding, "TOKEN_BYTES", 100)
    made = pa.array(["x" * n for n in (10, 0, 60, 40, 300, 1, 99, 2)]).slice(1)
    pieces = list(encoding._pieces(made))
    assert pa.concat_arrays(pieces).to_pylist() == made.to_pylist()
    assert [[len(t) for t in p.to_pylist()] for p in pieces] == [[0, 60, 40], [300], [1, 99], [2]]
    assert not list(encoding._pieces(made.slice(7)))


def test_held_vectors_are_not_kept_in_double():
    """A task's memory is that of the vectors as they came, whatever was scored with them."""
    from hitgauge.operators import matching

    n = 20_000
    values = np.random.default_rng(1).normal(size=(n, 64)).astype(np.float32)
    held = matching.Vectors(np.arange(n), np.arange(n), np.zeros(n, np.int64), values).sorted()
    asked = held.take(np.arange(50))
    best = matching._best(asked, held, matching.MatchSpec())
    assert best["match_id"].tolist() == list(range(50))
    kept = sum(x.nbytes for x in vars(held).values() if isinstance(x, np.ndarray))
    assert kept < 1.3 * values.nbytes


def test_cells_below_what_was_found_are_not_scored(monkeypatch):
    """Once a block has shown a good match, blocks of worse ones are only screened."""
    from hitgauge.operators import matching

    rng = np.random.default_rng(5)
    near = rng.normal(size=(40, 16))
    far = rng.normal(size=(4000, 16))
    values = np.vstack([near, near + 1e-3 * rng.normal(size=near.shape), far]).astype(np.float32)
    held = matching.Vectors(np.arange(len(values)), np.arange(len(values)), np.zeros(len(values), np.int64), values)
    monkeypatch.setattr(matching, "SIMILARITY_BYTES", 8 * 40 * 100)  # 41 blocks of 100 vectors
    scored, inner = [], matching._cell_scores
    monkeypatch.setattr(matching, "_cell_scores", lambda q, c, rows, cols: scored.append(len(rows)) or inner(q, c, rows, cols))
    best = matching._best(held.take(np.arange(40)), held, matching.MatchSpec(exclude_self=True))
    assert best["match_id"].tolist() == list(range(40, 80))
    assert sum(scored) < 3 * 40


@pytest.mark.parametrize("by", [None, "run"])
@pytest.mark.parametrize("k", [1, 3])
def test_self_match_multiplies_a_pair_of_blocks_once(spark, monkeypatch, by, k):
    from hitgauge.operators import matching

    monkeypatch.setattr(matching, "HELD_BYTES", 50 * DIM * 4)
    monkeypatch.setattr(matching, "BLOCK_BYTES", 7 * DIM * 4)
    monkeypatch.setattr(matching, "MIN_TILE_ROWS", 20)
    _, c = sample_sets()
    rows = vectors(spark, c).withColumn("run", (F.col("id") % 2).cast("int"))
    pairs, inner = [], type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda df, *a: pairs.append(df) or inner(df, *a))
    found = match_top_k(rows, rows, query_id="id", cache_id="id", k=k, by=by, exclude_self=True, broadcast_bytes=0)
    assert_same(as_dict(found, k), brute(c, c, k, mask=lambda i, j: i == j or (by and i % 2 != j % 2)))
    blocks = pairs[0].select("block").distinct().count()
    assert blocks > 10 and pairs[0].count() == blocks * (blocks + 1) // 2


def packed_vectors(values, ids=None, groups=None):
    from hitgauge.operators import matching

    n = len(values)
    ids = np.arange(n) if ids is None else ids
    values = np.asarray(values, dtype=np.float32)
    return matching.Vectors(ids, ids, np.zeros(n, np.int64) if groups is None else groups, values).sorted()


@pytest.mark.parametrize("k", [1, 3])
def test_blocks_are_packed_with_what_they_find_inside(monkeypatch, k):
    """A packed block comes back as it was; its floors are scores that k other rows of the group reach."""
    from hitgauge.operators import matching

    monkeypatch.setattr(matching, "FLOOR_ROWS", 40)
    _, c = sample_sets()
    rows = [(i, i, i % 2, v.tolist()) for i, v in enumerate(c)] + [(900, 900, 0, [float("nan")] * DIM), (901, 901, 0, None)]
    schema = pa.schema([("id", pa.int64()), ("ord", pa.int64()), ("grp", pa.int64()), ("vec", pa.list_(pa.float32()))])
    table = pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
    for name, value in (("block", pa.array([7] * len(rows), pa.int64())), ("part", pa.array([3] * len(rows), pa.int32()))):
        table = table.append_column(name, value)
    row = matching._pack(table, matching.MatchSpec(k, exclude_self=True)).to_batches()[0]
    assert (row.column("block")[0].as_py(), row.column("part")[0].as_py()) == (7, 3)
    made = matching.Vectors.from_packed(row.column("ids")[0].values, row.column("data")[0].as_buffer())
    wanted = packed_vectors(c, groups=np.arange(len(c)) % 2)
    for name in ("ids", "order", "group", "values", "norms"):
        assert np.array_equal(getattr(made, name), getattr(wanted, name))
    best = brute(c, c, k, mask=lambda i, j: i == j or i % 2 != j % 2)
    kth = np.array([best[i][k - 1][1] for i in made.ids])
    assert np.all(made.floor <= kth + 1e-9) and np.isfinite(made.floor).all()
    plain = matching._pack(table, None).to_batches()[0]
    loose = matching.Vectors.from_packed(plain.column("ids")[0].values, plain.column("data")[0].as_buffer())
    assert np.isneginf(loose.floor).all() and np.array_equal(loose.values, made.values)


def test_block_without_usable_vectors_is_packed():
    from hitgauge.operators import matching

    none = pa.table({"id": [1], "ord": [1], "grp": [0], "vec": pa.array([None], pa.list_(pa.float32())), "block": [0], "part": [0]})
    row = matching._pack(none, matching.MatchSpec(exclude_self=True)).to_batches()[0]
    assert len(matching.Vectors.from_packed(row.column("ids")[0].values, row.column("data")[0].as_buffer()).ids) == 0


def test_tiles_get_vectors_as_bytes_that_are_dealt_once(spark, monkeypatch):
    """A block is packed before tiles read it, and both sides of a self match read the same packed blocks."""
    from oracle_check import plan

    rows = vectors(spark, sample_sets()[1])
    pairs, inner = [], type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda df, *a: pairs.append(df) or inner(df, *a))
    match_self(rows, id_col="id", broadcast_bytes=0)
    types = dict(pairs[0].dtypes)
    assert types["q_data"] == types["c_data"] == "binary" and "float" not in str(types)
    pairs[0].collect()
    assert "ReusedExchange" in plan(pairs[0])


def test_cells_below_the_floor_of_a_block_are_not_scored(monkeypatch):
    from hitgauge.operators import matching

    rng = np.random.default_rng(5)
    near = rng.normal(size=(40, 16))
    asked = packed_vectors(near)
    far = packed_vectors(rng.normal(size=(4000, 16)), np.arange(100, 4100))
    scored, inner = [], matching._cell_scores
    monkeypatch.setattr(matching, "_cell_scores", lambda q, c, rows, cols: scored.append(len(rows)) or inner(q, c, rows, cols))
    known = matching.Best(40, 1, np.full(40, 0.999))
    matching._add_best(asked, far, matching.MatchSpec(), known)
    assert not sum(scored) and not len(known.kept()["q"])
    matching._add_best(asked, far, matching.MatchSpec(), matching.Best(40, 1))
    assert sum(scored) >= 40


def test_vectors_of_any_length_are_screened_right():
    """Lengths that single precision cannot invert are brought to unit length in double."""
    from hitgauge.operators import matching

    rng = np.random.default_rng(7)
    values = rng.normal(size=(60, DIM))
    values[50:] = values[:10] + 1e-4 * rng.normal(size=(10, DIM))
    wanted = [best[0][0] for best in brute(values, values, mask=lambda i, j: i == j).values()]
    for lengths in (np.ones(60), 10.0 ** rng.integers(-37, 37, 60), np.full(60, 1e-37)):
        made = packed_vectors(values * lengths[:, None])
        assert matching._best(made, made, matching.MatchSpec(exclude_self=True))["match_id"].tolist() == wanted
        assert np.allclose(np.linalg.norm(made.rough(slice(None)), axis=1), 1, atol=1e-5)
