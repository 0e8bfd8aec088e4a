"""Named queries over the given tables, one per operator or job.

Stand-ins: ``embeddings`` are pre-computed vectors whose ``label`` is the judge (equal labels mean
yes); ``documents``, ``benchmark`` and the user turns of ``conversations`` are query logs that the
hashed-token encoder turns into vectors; ``lineitem`` gives judged pairs in volume, with price as
score, return flag as label, ship year as dataset, line status as model and line number as run.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitgauge.functions import names as N
from hitgauge.functions import vectors as V
from hitgauge.functions.metrics import f_beta
from hitgauge.operators import checks, curves, density, judging, leaderboard, matching, sampling, sweep, verdicts
from hitgauge.operators.encoding import (
    batch_encoder, dimension_check, encode_distinct, encode_rows, hashed_token_encoder, with_embeddings,
)
from hitgauge.operators.summary import score_summary
from hitgauge.plans import charts, jobs
from hitgauge.sources import csv_files, result_tables, vector_index
from hitgauge.staging import stage, stage_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RUN_KEYS = ["dataset", "model", "run"]
THRESHOLDS = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Judged pairs in volume."""
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("ships_"), F.year("l_shipdate").cast("string"), F.lit("_test.csv")).alias("dataset"),
        F.when(F.col("l_linestatus") == "F", F.lit("lab/gte-modernbert-base"))
        .otherwise(F.lit("lab/cache-embed-v3.1")).alias("model"),
        F.col("l_linenumber").alias("run"),
        (F.col("l_extendedprice") / 120000).alias("similarity_score"),
        (F.col("l_returnflag") == "R").cast("int").alias("actual_label"),
    )


def run_sweeps(spark: SparkSession, sf: str) -> DataFrame:
    return sweep.sweep_thresholds(scored(spark, sf), RUN_KEYS)


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors with a text column; the text of a vector is its key and label."""
    return table(spark, sf, "embeddings").withColumn(
        "text", F.concat_ws("#", F.col("vec_id").cast("string"), F.col("label").cast("string"))
    )


# ---- sampling and splitting -------------------------------------------------------------------


@query
def split_sample_n(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return sampling.sample_n(docs, "doc_id", 100)


@query
def split_sample_half(spark, sf):
    """A sample of half the table, and how the two halves compare."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    marked = sampling.mark_sample(orders, "o_orderkey", orders.count() // 2, seed=7, flag="in_sample")
    return marked.groupBy("o_orderstatus", F.col("in_sample").cast("int").alias("in_sample")).agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.sum("o_orderkey").alias("sum_keys")
    )


@query
def split_pass_through(spark, sf):
    """As many samples as rows or more: the whole table."""
    bench = table(spark, sf, "benchmark")
    return sampling.sample_n(bench, "item_id", 1_000_000_000).select("item_id", "text")


@query
def split_complement(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    queries, cache = sampling.split_queries_cache(docs, "doc_id", 100)
    return queries.select("doc_id", F.lit(1).alias("is_query"), F.lit(None).cast("long").alias("cache_pos")).unionByName(
        cache.select("doc_id", F.lit(0).alias("is_query"), "cache_pos")
    )


@query
def split_explicit_cache(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    cache = table(spark, sf, "benchmark").select("item_id")
    queries, cache = sampling.split_queries_cache(docs, "doc_id", 100, cache, cache_id="item_id")
    return queries.select(F.lit("query").alias("side"), "doc_id").unionByName(
        cache.select(F.lit("cache").alias("side"), F.col("item_id").alias("doc_id"))
    )


@query
def split_overlap_audit(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    queries, cache = sampling.split_queries_cache(docs, "doc_id", 100)
    by_id = sampling.split_overlap(queries, cache, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    by_text = sampling.split_overlap(queries, cache, "text").agg(F.count(F.lit(1)).alias("n"))
    return by_id.select(F.lit("doc_id").alias("column_name"), "n").unionByName(
        by_text.select(F.lit("text").alias("column_name"), "n")
    )


@query
def bootstrap_split(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    runs = sampling.bootstrap_runs(docs, "doc_id")
    return runs.select("run", "doc_id", F.col("is_query").cast("int").alias("is_query"), "cache_pos")


@query
def bootstrap_sizes(spark, sf):
    convs = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id")
    )
    runs = sampling.bootstrap_runs(convs, "turn_id", n_runs=3, sample_ratio=0.5, n_samples=50)
    return runs.groupBy("run").agg(
        F.count_if("is_query").alias("n_queries"), F.count_if(~F.col("is_query")).alias("n_cache")
    )


@query
def first_rows(spark, sf):
    """Row limit on matching: the first 50 queries by position, all candidates kept."""
    vecs = table(spark, sf, "embeddings")
    head = sampling.first_rows(vecs, "vec_id", 50)
    found = matching.match_self(head, id_col="vec_id", candidates=vecs)
    return found.select("vec_id", "match_id", F.round("score", 6).alias("best_scores"))


# ---- vectors and encoding ---------------------------------------------------------------------


@query
def vector_norms(spark, sf):
    e = F.col("embedding")
    unit = V.normalize(e)
    return table(spark, sf, "embeddings").select(
        "vec_id",
        V.dims(e).alias("n_dims"),
        F.round(V.l2_norm(e), 5).alias("norm"),
        F.round(V.l2_norm(unit), 5).alias("unit_norm"),
    )


@query
def vector_dims(spark, sf):
    return dimension_check(table(spark, sf, "embeddings")).withColumn(
        "same_dim", F.col("same_dim").cast("int")
    )


@query
def vector_pairs(spark, sf):
    """Dot product, similarity and distance of neighbouring vectors."""
    left = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    right = left.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    a, b = F.col("a"), F.col("b")
    return left.join(right, "vec_id").select(
        "vec_id",
        F.round(V.dot(a, b), 6).alias("dot"),
        F.round(V.cosine_similarity(a, b), 6).alias("similarity"),
        F.round(V.cosine_distance(a, b), 6).alias("distance"),
        F.round(V.distance_to_similarity(V.cosine_distance(a, b)), 6).alias("from_distance"),
    )


@query
def index_search(spark, sf):
    """A fresh index of the cache, searched for three documents per query, with an extra field."""
    queries, cache = sampling.split_queries_cache(embeddings(spark, sf), "vec_id", 100)
    index = jobs.build_index(cache, id_col="vec_id", extras=["label"])
    hits = jobs.search_index(queries, index, id_col="vec_id", k=3)
    return hits.withColumn("vector_distance", F.round("vector_distance", 6))


@query
def index_updated(spark, sf):
    """An index that is loaded, added to, partly replaced and partly removed, then searched and compacted.

    The first load lacks label 0, which comes later with new texts for label 1; label 2 is removed and a part of its
    vectors comes back. ``n_rows`` counts the compacted table.
    """
    queries, cache = sampling.split_queries_cache(embeddings(spark, sf), "vec_id", 100)
    path = stage_path(spark, "vector-index")
    made = {"id_col": "vec_id", "extras": ["label"], "path": path}
    jobs.build_index(cache.filter("label <> 0"), **made)
    jobs.build_index(cache.filter("label IN (0, 1)").withColumn("text", F.concat(F.lit("new "), "text")), **made)
    gone = cache.filter("label = 2")
    vector_index.remove(gone.select(F.col("vec_id").alias("key")), path)
    index = jobs.build_index(gone.filter("md5(concat('42|', vec_id)) < 'a'"), **made)
    hits = stage(jobs.search_index(queries, index, id_col="vec_id", k=3), "hits")
    vector_index.compact(spark, path)
    vector_index.prune(spark, path)
    n_rows = vector_index.read(spark, path).select(F.count("*")).scalar()
    return hits.withColumns({"vector_distance": F.round("vector_distance", 6), "n_rows": n_rows})


@query
def index_match(spark, sf):
    queries, cache = sampling.split_queries_cache(embeddings(spark, sf), "vec_id", 100)
    matched = jobs.run_index_matching(queries, cache, id_col="vec_id", score_digits=6)
    return matched.select("vec_id", "text", "matches", "best_scores")


@query
def index_match_text(spark, sf):
    """All documents against an index that is built from the texts of the benchmark passages."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    passages = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    matched = jobs.run_index_matching(
        docs, passages, id_col="doc_id", encoder=hashed_token_encoder(), score_digits=6
    )
    return matched.select("doc_id", "matches", "best_scores")


@query
def encode_distinct_texts(spark, sf):
    """One vector per distinct text, and how many rows share it."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    vecs = encode_distinct(docs, "text", hashed_token_encoder())
    rows = with_embeddings(docs, "text", vecs)
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return (
        rows.groupBy(F.md5("text").alias("text_md5"), "embedding").agg(F.count(F.lit(1)).alias("n_rows"))
        .select("text_md5", "n_rows", total.cast("long").alias("n_tokens"),
                F.round(V.l2_norm(F.col("embedding")), 6).alias("norm"))
    )


def _length_model():
    """A toy model: length of the text, number of spaces, and 1."""
    import numpy as np

    return lambda texts: np.array([[len(t), t.count(" "), 1.0] for t in texts])


@query
def encode_with_model(spark, sf):
    """A Python model behind the encoder hook, raw and normalised."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    raw = encode_rows(docs, "text", batch_encoder(_length_model, batch_size=64))
    unit = V.normalize(F.col("embedding"))
    return raw.select(
        "doc_id",
        F.col("embedding")[0].cast("long").alias("n_chars"),
        F.col("embedding")[1].cast("long").alias("n_spaces"),
        F.round(unit[1].cast("double"), 5).alias("unit_spaces"),
    )


# ---- matching ---------------------------------------------------------------------------------


def _scores(found: DataFrame, key: str, *more: str) -> DataFrame:
    return found.select(key, *more, "match_id", F.round("score", 6).alias("best_scores"))


def _vector_split(spark, sf):
    return sampling.split_queries_cache(table(spark, sf, "embeddings"), "vec_id", 100)


@query
def match_top1(spark, sf):
    queries, cache = _vector_split(spark, sf)
    found = matching.match_top_1(queries, cache, query_id="vec_id", cache_id="vec_id", order="cache_pos")
    return _scores(found, "vec_id").withColumn("decision_method", N.decision_method())


@query
def match_top1_small_cache(spark, sf):
    """Many queries against a small cache: the sides of the split swapped."""
    few, many = _vector_split(spark, sf)
    found = matching.match_top_1(
        many, few, query_id="vec_id", cache_id="vec_id", broadcast_bytes=100 * 64 * 4
    )
    return _scores(found, "vec_id")


@query
def match_top1_block(spark, sf):
    """Both sides too large to broadcast: tiles."""
    queries, cache = _vector_split(spark, sf)
    found = matching.match_top_1(
        queries, cache, query_id="vec_id", cache_id="vec_id", order="cache_pos",
        broadcast_bytes=0, tile_bytes=64 * 64 * 4,
    )
    return _scores(found, "vec_id")


@query
def match_topk(spark, sf):
    queries, cache = _vector_split(spark, sf)
    found = matching.match_top_k(
        queries, cache, query_id="vec_id", cache_id="vec_id", order="cache_pos", k=5
    )
    return _scores(found, "vec_id", "rank")


@query
def match_topk_block(spark, sf):
    vecs = table(spark, sf, "embeddings")
    found = matching.match_top_k(
        vecs, vecs, query_id="vec_id", cache_id="vec_id", k=3, exclude_self=True,
        broadcast_bytes=0, tile_bytes=150 * 64 * 4,
    )
    return _scores(found, "vec_id", "rank")


@query
def match_self(spark, sf):
    return _scores(matching.match_self(table(spark, sf, "embeddings"), id_col="vec_id"), "vec_id")


@query
def match_self_block(spark, sf):
    found = matching.match_self(
        table(spark, sf, "embeddings"), id_col="vec_id", broadcast_bytes=0, tile_bytes=200 * 64 * 4
    )
    return _scores(found, "vec_id")


@query
def match_offset_self(spark, sf):
    """A slice whose row i is row i + 1 of the corpus."""
    corpus = table(spark, sf, "embeddings")
    part = corpus.withColumn("vec_id", F.col("vec_id") - 1)
    found = matching.match_top_1(
        part, corpus, query_id="vec_id", cache_id="vec_id", exclude_self=True, self_offset=1
    )
    return _scores(found, "vec_id")


@query
def match_no_hit(spark, sf):
    """User turns against the system turns of their own conversation; many have none."""
    turns = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "conv_id", "role", "text"
    )
    matched = jobs.run_matching(
        turns.filter("role = 'user'"), turns.filter("role = 'system'"),
        id_col="turn_id", order="turn_id", by="conv_id", score_digits=6
    )
    return matched.select("turn_id", "conv_id", "matches", "best_scores")


@query
def text_match(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    queries, cache = jobs.load_data(docs, "doc_id")
    matched = jobs.run_matching(queries, cache, id_col="doc_id", score_digits=6)
    return matched.select("doc_id", "match_id", F.md5("matches").alias("match_md5"), "best_scores")


@query
def text_match_explicit_cache(spark, sf):
    """All documents against the benchmark passages as an explicit cache."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cache = table(spark, sf, "benchmark")
    matched = jobs.run_matching(docs, cache, id_col="doc_id", cache_id="item_id", order="item_id", score_digits=6)
    return matched.select("doc_id", "match_id", "best_scores")


def document_vectors(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return stage(encode_rows(docs, "text", hashed_token_encoder()).drop("text"), "vectors")


@query
def text_self_match(spark, sf):
    found = matching.match_self(document_vectors(spark, sf), id_col="doc_id")
    return _scores(found, "doc_id")


@query
def text_self_match_block(spark, sf):
    found = matching.match_self(
        document_vectors(spark, sf), id_col="doc_id", broadcast_bytes=0, tile_bytes=1 << 20
    )
    return _scores(found, "doc_id")


@query
def conversation_match(spark, sf):
    """All turns as the query log, answered from the other turns."""
    turns = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text"
    )
    queries, cache = jobs.load_data(turns, "turn_id")
    return jobs.run_matching(queries, cache, id_col="turn_id", score_digits=6).select(
        "turn_id", "text", "matches", "best_scores"
    )


# ---- judging ----------------------------------------------------------------------------------


def _verdicts_by_source(spark, sf):
    """Several verdicts per (source, lang): each labelled document gives one, others none."""
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    answer = F.when(F.col("quality") == 1, F.lit("yes")).when(F.col("quality") == 0, F.lit("no"))
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    return docs.join(labels, "doc_id", "left").withColumn("response", answer)


@query
def judge_dedup(spark, sf):
    return judging.first_verdicts(_verdicts_by_source(spark, sf), ["source", "lang"], "doc_id")


@query
def judge_failures(spark, sf):
    return judging.failure_count(_verdicts_by_source(spark, sf))


@query
def judge_join(spark, sf):
    """Every document labelled by the first verdict of its (source, lang)."""
    docs = table(spark, sf, "documents").select(
        "doc_id", "source", "lang", (F.col("n_chars") / 200000).alias("best_scores")
    )
    verdicts = _verdicts_by_source(spark, sf)
    return judging.label_pairs(docs, verdicts, ["source", "lang"], "doc_id", keep=["doc_id"])


@query
def judge_join_usable_only(spark, sf):
    """Queries without a verdict dropped instead of labelled 0."""
    docs = table(spark, sf, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("text"), "lang", F.lit(0.5).alias("best_scores")
    )
    verdicts = _verdicts_by_source(spark, sf).withColumn("text", F.col("doc_id").cast("string"))
    judged = judging.label_pairs(docs, verdicts, ["text", "lang"], "doc_id", drop_failed=True)
    return judged


def _shared_words_judge():
    """A toy judge: yes if the query has a fifth of the match's different words; no answer without any."""
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def judge(pairs, prompt):
        answers = []
        for a, b in pairs:
            wanted = set(word.findall(b))
            shared = len(wanted & set(word.findall(a)))
            answers.append(None if not shared else ("yes" if 5 * shared >= len(wanted) else "no"))
        return answers

    return judge


@query
def judge_udf(spark, sf):
    """The judge hook on all pairs of a document and its nearest passage."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cache = table(spark, sf, "benchmark")
    matched = jobs.run_matching(docs, cache, id_col="doc_id", cache_id="item_id", order="item_id", score_digits=6)
    judged = judging.judge_pairs(matched, _shared_words_judge, batch_size=16, preprocess=F.lower)
    return judged.select("doc_id", "match_id", "response", "error")


@query
def judge_remembered(spark, sf):
    """Pairs of a document and its nearest passage, judged in two jobs with one table of verdicts.

    The first job judges the English documents. ``asked`` tells which pairs the second one, over all documents, had
    to ask for: those without a verdict yet, failed ones included.
    """
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    cache = table(spark, sf, "benchmark")
    matched = jobs.run_matching(docs, cache, id_col="doc_id", cache_id="item_id", order="item_id", score_digits=6)
    path, questions = stage_path(spark, "verdict-table"), []

    def ask(pairs):
        said = judging.judge_pairs(pairs, _shared_words_judge, batch_size=16, preprocess=F.lower)
        questions.append(stage(said.select("text", "matches", "response"), "asked"))
        return questions[-1]

    judge = verdicts.remembered(ask, path, "shared words")
    matched = stage(matched.select("doc_id", "lang", "match_id", "text", "matches"), "pairs")
    judge(matched.filter("lang = 'en'").select("text", "matches"))
    answers = judge(matched.select("text", "matches").distinct())
    again = questions[1].select(verdicts.pair_key(verdicts.PAIR).alias("k"), F.lit(True).alias("asked"))
    keyed = matched.select("doc_id", "match_id", verdicts.pair_key(verdicts.PAIR).alias("k"))
    said = answers.select(verdicts.pair_key(verdicts.PAIR).alias("k"), "response")
    return keyed.join(said, "k").join(again, "k", "left").select(
        "doc_id", "match_id", "response", F.coalesce("asked", F.lit(False)).alias("asked")
    )


# ---- metrics and sweeps -----------------------------------------------------------------------


@query
def metrics_at_thresholds(spark, sf):
    return sweep.metrics_at(scored(spark, sf), THRESHOLDS, ["model"])


@query
def hit_ratio_at_thresholds(spark, sf):
    return sweep.metrics_at(scored(spark, sf), THRESHOLDS, label=None).select("threshold", "cache_hit_ratio")


@query
def sweep_unlabelled(spark, sf):
    return sweep.sweep_thresholds(scored(spark, sf), label=None)


@query
def sweep_labelled(spark, sf):
    return sweep.sweep_thresholds(scored(spark, sf))


@query
def sweep_grouped(spark, sf):
    return run_sweeps(spark, sf)


@query
def sweep_discrete_scores(spark, sf):
    """Fifty distinct scores, many of them exactly on a threshold; 101 steps."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("run"),
        (F.col("l_quantity") / 50).alias("similarity_score"),
        (F.col("l_returnflag") == "R").cast("int").alias("actual_label"),
    )
    return sweep.sweep_thresholds(rows, ["run"], steps=101)


@query
def sweep_custom_metric(spark, sf):
    """A caller's own metric beside the built-in ones."""
    f2 = f_beta(F.col("precision"), F.col("recall"), 2.0)
    return sweep.sweep_thresholds(scored(spark, sf), ["model"], extra_metrics={"f2_score": f2}).select(
        "model", "threshold_idx", "threshold", "f2_score"
    )


@query
def summary_of_scores(spark, sf):
    return score_summary(scored(spark, sf)).withColumn("mean_score", F.round("mean_score", 9))


@query
def summary_of_scores_grouped(spark, sf):
    return score_summary(scored(spark, sf), ["dataset", "model"]).withColumn(
        "mean_score", F.round("mean_score", 9)
    )


# ---- curves -----------------------------------------------------------------------------------


@query
def auc_raw(spark, sf):
    return curves.area_under(run_sweeps(spark, sf), RUN_KEYS).withColumn("auc", F.round("auc", 9))


@query
def auc_all_thresholds(spark, sf):
    areas = charts.run_areas(run_sweeps(spark, sf), RUN_KEYS)
    return areas.select(
        *RUN_KEYS, F.round("auc_hit_ratio", 9).alias("auc_hit_ratio"), F.round("auc_recall", 9).alias("auc_recall")
    )


@query
def curve_resampled(spark, sf):
    sweeps = sweep.sweep_thresholds(scored(spark, sf), ["model"])
    return curves.resampled_curves(sweeps, ["model"]).select(
        "model", "grid_i", "grid_x", F.round("precision", 9).alias("precision")
    )


@query
def auc_resampled(spark, sf):
    resampled = curves.resampled_curves(run_sweeps(spark, sf), RUN_KEYS)
    return curves.area_resampled(resampled, RUN_KEYS).withColumn("auc", F.round("auc", 9))


@query
def curve_mean_band(spark, sf):
    bands = charts.mean_precision_curves(run_sweeps(spark, sf), ["dataset", "model"])
    rounded = [F.round(c, 7).alias(c) for c in ("mean_precision", "std_precision", "band_low", "band_high")]
    return bands.select("dataset", "model", "grid_i", "grid_x", "n_runs", *rounded)


@query
def base_rate(spark, sf):
    rates = curves.base_rate(run_sweeps(spark, sf), ["dataset"], ["model", "run"])
    return curves.ideal_areas(rates).select(
        "dataset", "base_rate",
        F.round("auc_uniform_negatives", 9).alias("auc_uniform_negatives"),
        F.round("auc_zero_negatives", 9).alias("auc_zero_negatives"),
    )


@query
def ideal_curves(spark, sf):
    points = charts.ideal_precision_curves(run_sweeps(spark, sf), ["dataset"], ["model", "run"])
    return points.select(
        "dataset", "curve", "point_i", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"),
        F.round("auc", 9).alias("auc"),
    )


# ---- densities --------------------------------------------------------------------------------


def _bins(bins: DataFrame, by: list[str]) -> DataFrame:
    return bins.select(
        *by, "bin", F.round("center", 9).alias("center"), "n_pos", "n_neg",
        F.round("pos_density", 7).alias("pos_density"), F.round("neg_density", 7).alias("neg_density"),
    )


@query
def density_fixed(spark, sf):
    return _bins(density.densities(scored(spark, sf), ["model"]), ["model"])


@query
def density_on_edges(spark, sf):
    """Scores that lie on bin edges, some above 1."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("model"),
        (F.col("l_quantity") * 0.03).alias("similarity_score"),
        (F.col("l_returnflag") == "R").cast("int").alias("actual_label"),
    )
    return _bins(density.densities(rows, ["model"]), ["model"])


@query
def density_range(spark, sf):
    return _bins(density.densities(scored(spark, sf), ["model"], data_range=True), ["model"])


@query
def overlap_per_run(spark, sf):
    bins = density.densities(scored(spark, sf), RUN_KEYS)
    return density.overlap(bins, RUN_KEYS).select(*RUN_KEYS, F.round("overlap", 9).alias("overlap"))


@query
def total_variation(spark, sf):
    bins = density.densities(scored(spark, sf), ["dataset"], data_range=True)
    out = density.overlap(bins, ["dataset"])
    return out.select(
        "dataset",
        *[F.round(c, 9).alias(c) for c in ("overlap", "total_variation", "pos_mass", "neg_mass")],
        F.col("identity_holds").cast("int").alias("identity_holds"),
    )


@query
def density_mean(spark, sf):
    means = charts.mean_density_curves(scored(spark, sf), ["dataset", "model"])
    return means.select(
        "dataset", "model", "bin", "n_runs",
        F.round("mean_pos_density", 7).alias("mean_pos_density"),
        F.round("mean_neg_density", 7).alias("mean_neg_density"),
        "overlap_label",
    )


@query
def label_split(spark, sf):
    return density.positive_share(scored(spark, sf), RUN_KEYS)


# ---- leaderboard ------------------------------------------------------------------------------


def _stats(spark, sf):
    pairs = scored(spark, sf)
    return jobs.leaderboard(sweep.sweep_thresholds(pairs, RUN_KEYS), pairs)


def _round_stats(stats: DataFrame) -> list:
    return [F.round(c, 7).alias(c) for c in ("auc_mean", "auc_std", "overlap_mean", "overlap_std")]


@query
def run_statistics(spark, sf):
    stats = _stats(spark, sf)
    return stats.select("dataset", "model", "n_runs", *_round_stats(stats))


@query
def leaderboard_long(spark, sf):
    cells = leaderboard.leaderboard_cells(_stats(spark, sf), "auc")
    return cells.withColumn("is_best", F.col("is_best").cast("int"))


@query
def leaderboard_pivot(spark, sf):
    stats = _stats(spark, sf)
    models = ["lab/cache-embed-v3.1", "lab/gte-modernbert-base"]
    table_ = leaderboard.leaderboard_table(stats, "overlap", models, minimize=True)
    return table_.toDF("dataset", "cache_embed", "modernbert")


@query
def best_model(spark, sf):
    best = leaderboard.mark_best(_stats(spark, sf), "overlap", minimize=True).filter("is_best")
    return best.select("dataset", "model", F.round("overlap_mean", 7).alias("overlap_mean"))


# ---- names ------------------------------------------------------------------------------------


@query
def model_names(spark, sf):
    """Folder names of every order's status, priority and date, in all the spellings."""
    orders = table(spark, sf, "orders")
    stamp = N.run_stamp(F.col("o_orderdate"))
    version = F.substring("o_orderpriority", 1, 1)
    folder = F.when(
        F.col("o_orderstatus") == "F", F.concat(F.lit("neural_Alibaba-NLP_gte-modernbert-v"), version)
    ).when(
        F.col("o_orderstatus") == "O", F.concat(F.lit("Alibaba-NLP_cache-v"), version, F.lit("_"), stamp)
    ).otherwise(F.concat(F.lit("neural_own_cache-v"), version, F.lit("_"), stamp))
    named = orders.select("o_orderkey", folder.alias("folder"))
    model = N.model_from_folder(F.col("folder"))
    return named.select(
        "o_orderkey", "folder", model.alias("model"),
        N.model_from_folder(F.col("folder"), strip_stamp_first=True).alias("bare_model"),
        N.short_model_name(model).alias("short_name"),
        N.folder_name(model).alias("safe_name"),
    )


@query
def dataset_names(spark, sf):
    """Dataset names of the page addresses, without query and fragment, taken as paths."""
    pages = table(spark, sf, "pages")
    address = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/+$", "")
    path = F.concat(address, F.lit("_test.csv"))
    name = F.concat(N.dataset_from_path(path), F.lit(".csv"))
    return pages.select(
        "page_id",
        N.dataset_from_path(path).alias("dataset"),
        N.display_dataset(name).alias("display"),
        N.dataset_title(name).alias("title"),
    )


# ---- sources and sinks ------------------------------------------------------------------------


def _csv_round_trip(spark, sf, compression, split=False):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    path = csv_files.write_csv(docs, stage_path(spark, "csv"), "documents.csv", compression)
    return csv_files.read_csv(spark, path, docs.schema, split=split).select(
        "doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"), "lang"
    )


@query
def csv_round_trip(spark, sf):
    return _csv_round_trip(spark, sf, None)


@query
def csv_round_trip_gzip(spark, sf):
    return _csv_round_trip(spark, sf, "gzip")


@query
def csv_round_trip_split(spark, sf):
    """Files with line breaks in quotes, read in byte ranges."""
    return _csv_round_trip(spark, sf, None, split=True)


@query
def csv_missing_values(spark, sf):
    """Texts that stand for a missing value become NULL after the read."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", F.lit("n/a")).otherwise(F.col("o_orderstatus")).alias("status")
    )
    path = csv_files.write_csv(orders, stage_path(spark, "csv"), "orders.csv")
    return csv_files.read_csv(spark, path, orders.schema, csv_files.NULL_TOKENS)


@query
def runs_partitioned(spark, sf):
    """All runs written as one table with a folder per run; one dataset read back."""
    path = stage_path(spark, "runs")
    result_tables.write_runs(run_sweeps(spark, sf), path)
    back = result_tables.read_runs(spark, path)
    return back.groupBy("dataset", "model", "run").agg(
        F.count(F.lit(1)).alias("n_thresholds"), F.sum("tp").cast("long").alias("sum_tp")
    )


def _written_tree(spark, sf) -> str:
    """A results tree of all runs: one model in each layout, and a stale attempt that must not count."""
    base = stage_path(spark, "tree")
    modern = F.col("model") == "lab/gte-modernbert-base"
    pairs = scored(spark, sf).select(
        F.lit("ships_test").alias("dataset"),
        F.when(modern, F.lit("neural_Alibaba-NLP_gte-modernbert-base"))
        .otherwise(F.lit("own-cache-v3.1")).alias("model"),
        F.col("run"), F.lit("q").alias("text"), F.lit("m").alias("matches"),
        "similarity_score", "actual_label",
    )
    old = F.col("model") == "own-cache-v3.1"
    new_runs = pairs.filter(~old)
    stale = new_runs.withColumn("similarity_score", F.col("similarity_score") / 2)
    for stamp, rows in (("2024_01_01_00_00_00", stale), ("2024_01_02_00_00_00", new_runs)):
        result_tables.write_run_tree(sweep.sweep_thresholds(rows, RUN_KEYS), rows, base, stamp)
    old_runs = sweep.sweep_thresholds(pairs.filter(old), RUN_KEYS).withColumn(
        "model", F.concat_ws("_", "model", F.lit("2024_01_01_00_00"), F.format_string("%02d", "run"))
    )
    result_tables.write_run_tree(old_runs, None, base, None)
    return base


@query
def results_tree_scan(spark, sf):
    """Crawl a written tree and summarise its runs; old-layout runs have no judged pairs."""
    runs = result_tables.crawl_runs(spark, _written_tree(spark, sf))
    keys = ["dataset", "model", "run"]
    stats = jobs.leaderboard(result_tables.read_run_sweeps(runs), result_tables.read_run_judgements(runs), keys)
    return stats.select("dataset", "model", "n_runs", *_round_stats(stats))


@query
def results_tree_runs(spark, sf):
    """Which attempts of a written tree count."""
    runs = result_tables.crawl_runs(spark, _written_tree(spark, sf))
    rows = result_tables.read_run_judgements(runs).groupBy("run").agg(F.count(F.lit(1)).alias("n_judged"))
    return runs.join(rows, "run", "left").select("dataset", "model", "run", "ts", "n_judged")


# ---- chart tables -----------------------------------------------------------------------------


@query
def chart_precision_vs_hit_ratio(spark, sf):
    return charts.precision_vs_hit_ratio(sweep.sweep_thresholds(scored(spark, sf), ["model"]), ["model"])


@query
def chart_metrics_over_threshold(spark, sf):
    return charts.metrics_over_threshold(sweep.sweep_thresholds(scored(spark, sf), ["model"]), ["model"])


@query
def chart_hit_ratio(spark, sf):
    swept = sweep.sweep_thresholds(scored(spark, sf), ["model"], label=None)
    return charts.hit_ratio_over_threshold(swept, ["model"])


@query
def chart_class_densities(spark, sf):
    bins = charts.class_densities(scored(spark, sf), ["model"])
    return bins.select(
        "model", "bin", F.round("pos_density", 7).alias("pos_density"),
        F.round("neg_density", 7).alias("neg_density"),
        F.round("overlap", 9).alias("overlap"), F.round("total_variation", 9).alias("total_variation"),
    )


# ---- data quality -----------------------------------------------------------------------------


@query
def check_matches(spark, sf):
    queries, cache = sampling.split_queries_cache(embeddings(spark, sf), "vec_id", 100)
    matched = jobs.run_matching(queries, cache, id_col="vec_id", vector="embedding", score_digits=6)
    return checks.check_matches(matched)


@query
def check_hit_ratio(spark, sf):
    return checks.check_hit_ratio(run_sweeps(spark, sf), RUN_KEYS)


@query
def check_label_metrics(spark, sf):
    return checks.check_label_metrics(run_sweeps(spark, sf), RUN_KEYS)


@query
def check_expectations(spark, sf):
    """Documents whose best passage contains their first word but scores below the floor."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    bench = table(spark, sf, "benchmark")
    matched = jobs.run_matching(docs, bench, id_col="doc_id", cache_id="item_id", order="item_id", score_digits=6)
    wanted = docs.select(
        F.col("text").alias("query"), F.split("text", " ")[0].alias("expected"), F.lit(0.9).alias("min_score")
    ).distinct()
    low = checks.check_expectations(matched, wanted, "doc_id")
    return low.select(F.md5("query").alias("query_md5"), "expected", "score")


# ---- jobs -------------------------------------------------------------------------------------


def _label_judge(pairs: DataFrame) -> DataFrame:
    """Yes if both texts carry the same label; a text is ``key#label``."""
    label = lambda c: F.element_at(F.split(c, "#"), -1)
    same = label(F.col("text")) == label(F.col("matches"))
    return pairs.withColumns(
        {"response": F.when(same, F.lit("yes")).otherwise(F.lit("no")), "seq": F.lit(0)}
    )


def _evaluated(spark, sf):
    queries, cache = jobs.load_data(embeddings(spark, sf), "vec_id")
    matched = jobs.run_matching(queries, cache, id_col="vec_id", vector="embedding", score_digits=6)
    return jobs.full_evaluation(matched, _label_judge)


@query
def full_eval(spark, sf):
    """Split, match, judge and sweep: the flagship."""
    return _evaluated(spark, sf).sweep


@query
def full_eval_judged(spark, sf):
    return _evaluated(spark, sf).judged


@query
def chr_eval(spark, sf):
    queries, cache = jobs.load_data(embeddings(spark, sf), "vec_id")
    matched = jobs.run_matching(queries, cache, id_col="vec_id", vector="embedding", score_digits=6)
    return jobs.chr_evaluation(matched).sweep


@query
def chr_eval_summary(spark, sf):
    queries, cache = jobs.load_data(embeddings(spark, sf), "vec_id")
    matched = jobs.run_matching(queries, cache, id_col="vec_id", vector="embedding", score_digits=6)
    return jobs.chr_evaluation(matched).summary.withColumn("mean_score", F.round("mean_score", 9))


@query
def chr_eval_text(spark, sf):
    """Hit-ratio evaluation of the documents as a query log."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    queries, cache = jobs.load_data(docs, "doc_id")
    return jobs.chr_evaluation(jobs.run_matching(queries, cache, id_col="doc_id", score_digits=6)).sweep


TWO_MODELS = {"signed": "embedding", "absolute": "magnitudes"}


def _two_models(spark, sf):
    return embeddings(spark, sf).withColumn("magnitudes", F.transform("embedding", lambda x: F.abs(x)))


def _bootstrap(spark, sf):
    """Five runs of the vectors as they are and of their absolute values."""
    return jobs.bootstrap_matches(_two_models(spark, sf), TWO_MODELS, id_col="vec_id", score_digits=6)


@query
def bootstrap_matches(spark, sf):
    return _bootstrap(spark, sf).select("model", "run", "vec_id", "match_id", "best_scores")


@query
def bootstrap_benchmark(spark, sf):
    """Runs, verdicts, sweeps and leaderboard of both models in one job."""
    done, _ = jobs.bootstrap_benchmark(
        {"vectors": _two_models(spark, sf)}, TWO_MODELS, _label_judge, id_col="vec_id", score_digits=6
    )
    stats = jobs.leaderboard(done.sweep, done.judged)
    return stats.select("dataset", "model", "n_runs", *_round_stats(stats))


@query
def bootstrap_benchmark_text(spark, sf):
    """Two datasets without a judge: score summaries of every run."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    turns = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"
    )
    done, _ = jobs.bootstrap_benchmark(
        {"documents": docs, "turns": turns}, {"tokens": hashed_token_encoder()}, id_col="id",
        n_runs=2, n_samples=50, score_digits=6,
    )
    return done.summary.withColumn("mean_score", F.round("mean_score", 9))


@query
def evaluation_files(spark, sf):
    """The named CSV tables of a full evaluation, written and read back."""
    out = stage_path(spark, "evaluation")
    paths = jobs.write_evaluation(_evaluated(spark, sf), out)
    judged = csv_files.read_csv(
        spark, paths[result_tables.JUDGED],
        "text STRING, matches STRING, similarity_score DOUBLE, actual_label INT",
    )
    matches = csv_files.read_csv(
        spark, paths[result_tables.MATCHES], "text STRING, matches STRING, best_scores DOUBLE"
    )
    return judged.join(matches, ["text", "matches"])
