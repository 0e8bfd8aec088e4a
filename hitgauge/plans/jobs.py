"""End-to-end jobs. Every job takes and returns DataFrames and handles any number of runs at once."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from hitgauge.functions.names import folder_name, run_stamp
from hitgauge.functions.vectors import distance_to_similarity
from hitgauge.operators.curves import area_under
from hitgauge.operators.density import densities, overlap
from hitgauge.operators.encoding import (
    Encoder, encode_distinct, encode_rows, hashed_token_encoder, vector_table, with_embeddings,
)
from hitgauge.operators.judging import label_pairs
from hitgauge.operators.leaderboard import run_metrics, run_stats
from hitgauge.operators.matching import attach_match, match_top_k, match_with_text, with_no_hit_default
from hitgauge.operators.sampling import RunMarks, bootstrap_cuts, bootstrap_marker, split_queries_cache
from hitgauge.operators.summary import score_summary
from hitgauge.operators.sweep import MAX_STEPS, sweep_thresholds
from hitgauge.sources import vector_index
from hitgauge.sources.csv_files import read_csv, write_csv
from hitgauge.sources.result_tables import (
    CHR_MATCHES, CHR_SWEEP, JUDGED, MATCHES, RUN_KEYS, SWEEP, judged_table, matches_table, write_runs,
    write_sweep,
)
from hitgauge.staging import stage

JudgePairs = Callable[[DataFrame], DataFrame]
Matcher = Callable[..., DataFrame]


@dataclass(frozen=True)
class Evaluation:
    """The tables of one evaluation; ``judged`` only exists with a judge."""

    matches: DataFrame
    sweep: DataFrame
    summary: DataFrame | None = None
    judged: DataFrame | None = None


def load_data(
    query_log: DataFrame,
    id_col: str,
    cache: DataFrame | None = None,
    n_samples: int = 100,
    seed: int = 42,
    cache_id: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Queries and shuffled cache of an evaluation."""
    return split_queries_cache(query_log, id_col, n_samples, cache, seed, cache_id)


def load_csv_data(
    spark: SparkSession,
    query_log_path: str,
    cache_path: str | None = None,
    n_samples: int = 100,
    schema: str | None = None,
    id_col: str | None = None,
    seed: int = 42,
    null_tokens: list[str] | None = None,
    multi_line: bool = True,
    split: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Queries and cache from CSV paths (local or object store).

    Without ``id_col`` the rows are numbered in ``row_id`` once and staged. ``null_tokens``, ``multi_line`` and
    ``split`` are those of :func:`read_csv`.
    """
    def read(path: str) -> DataFrame:
        rows = read_csv(spark, path, schema, null_tokens, multi_line, split)
        return rows if id_col else with_row_ids(rows)

    cache = read(cache_path) if cache_path else None
    return load_data(read(query_log_path), id_col or "row_id", cache, n_samples, seed)


def with_row_ids(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Number the rows of a table without a key. Staged, because a second read may number differently."""
    return stage(df.withColumn(name, F.monotonically_increasing_id()), "row-ids")


def run_matching(
    queries: DataFrame,
    cache: DataFrame,
    *,
    id_col: str,
    text: str = "text",
    vector: str | None = None,
    encoder: Encoder | None = None,
    cache_id: str | None = None,
    order: str | None = "cache_pos",
    by: str | None = None,
    exclude_self: bool = False,
    texts: DataFrame | None = None,
    score_digits: int | None = None,
    matcher: Matcher = match_with_text,
    encode_once: bool = False,
) -> DataFrame:
    """Queries with ``match_id``, ``matches`` and ``best_scores`` of their nearest cached row.

    Vectors come from the ``vector`` column, or from ``encoder`` applied to the texts: queries are
    encoded once and staged, cached texts are encoded as they are scanned, without a shuffle. For a
    costly model and many equal texts, ``encode_once`` encodes each different text of both sides
    once and joins the staged vectors to the rows.
    A query without a candidate has score 0 and the empty text. ``texts`` holds the text of every
    ``cache_id`` once, where the cache repeats its rows per run. Scores are in double; with
    ``score_digits`` they are rounded before anything is taken from them. ``matcher`` takes the
    arguments of :func:`match_with_text` and returns its columns, for instance from another index.
    """
    cache_id = cache_id or id_col
    if vector is None:
        encoder = encoder or hashed_token_encoder()
        vector = "embedding"
        keys = [c for c in (id_col, by) if c]
        asked = queries.select(*keys, text)
        if encode_once:
            vectors = encode_distinct(asked.select(text).union(cache.select(text)), text, encoder)
            q, c = with_embeddings(asked, text, vectors), with_embeddings(cache, text, vectors)
        else:
            q, c = encode_rows(asked, text, encoder), encode_rows(cache, text, encoder)
        q = stage(q.select(*keys, vector), "query-vectors")
    else:
        q, c = queries, cache
    found = matcher(
        q, c, text, query_id=id_col, cache_id=cache_id, vector=vector, order=order, by=by,
        exclude_self=exclude_self, texts=texts,
    ).drop("rank")
    found = found.withColumn("best_scores", _rounded(F.col("score"), score_digits)).drop("score")
    return stage(with_no_hit_default(queries, found, [c for c in (id_col, by) if c]), "matched")


def build_index(
    cache: DataFrame,
    *,
    id_col: str,
    text: str = "text",
    vector: str = "embedding",
    prefix: str = "cache:",
    extras: Sequence[str] = (),
    path: str | None = None,
) -> DataFrame:
    """A vector table with the vectors as they are (not normalised).

    Without a path it is fresh and staged. With one, the documents are added to the table kept there, which is made if there
    is none; they replace those of the same key (see :mod:`hitgauge.sources.vector_index`)."""
    rows = vector_table(cache, id_col, text, vector, prefix, extras)
    if path is None:
        return stage(rows, "index")
    spark = cache.sparkSession
    (vector_index.create if vector_index.latest(spark, path) is None else vector_index.add)(rows, path)
    return vector_index.read(spark, path)


def search_index(
    queries: DataFrame, index: DataFrame, *, id_col: str, vector: str = "embedding", k: int = 1
) -> DataFrame:
    """The k nearest documents per query: the query's key, ``rank``, ``vector_distance`` and the
    document's ``id``, text and extra fields. Never masks a query's own document."""
    found = match_top_k(queries, index, query_id=id_col, cache_id="key", vector=vector, k=k)
    hits = found.withColumn("vector_distance", 1 - F.col("score")).drop("score")
    fields = {c: c for c in index.columns if c not in ("key", "embedding")}
    return attach_match(hits, index, "key", fields).drop("match_id")


def _rounded(score: Column, digits: int | None) -> Column:
    return score if digits is None else F.round(score, digits)


def run_index_matching(
    queries: DataFrame,
    cache: DataFrame,
    *,
    id_col: str,
    text: str = "text",
    vector: str = "embedding",
    encoder: Encoder | None = None,
    score_digits: int | None = None,
) -> DataFrame:
    """Queries with the text and similarity of their nearest indexed document.

    With ``encoder`` the vectors are made from the texts of both sides, queries once and staged.
    """
    if encoder is not None:
        plain = queries.drop("embedding")
        queries = stage(encode_rows(plain, text, encoder), "query-vectors")
        cache, vector = encode_rows(cache.drop("embedding"), text, encoder), "embedding"
    index = build_index(cache, id_col=id_col, text=text, vector=vector)
    hits = search_index(queries, index, id_col=id_col, vector=vector)
    best = hits.select(
        id_col, F.col(text).alias("matches"),
        _rounded(distance_to_similarity(F.col("vector_distance")), score_digits).alias("best_scores"),
    )
    return with_no_hit_default(queries, best, [id_col])


def chr_evaluation(
    matched: DataFrame, by: list[str] | None = None, text: str = "text", steps: int = MAX_STEPS
) -> Evaluation:
    """Hit-ratio evaluation without labels: matches, sweep and score summary."""
    by = by or []
    scored = matched.select(*by, F.col("best_scores").alias("similarity_score"))
    return Evaluation(
        matches=matched.select(*by, text, "matches", "best_scores") if by else matches_table(matched, text),
        sweep=sweep_thresholds(scored, by, label=None, steps=steps),
        summary=score_summary(scored, by),
    )


def full_evaluation(
    matched: DataFrame,
    judge: JudgePairs,
    by: list[str] | None = None,
    text: str = "text",
    seq: str = "seq",
    steps: int = MAX_STEPS,
    extra_metrics: dict[str, Column] | None = None,
    drop_failed: bool = False,
) -> Evaluation:
    """Evaluation with verdicts. ``judge`` maps the pairs (text, matches), each of them once, to the same
    rows with ``response``; with a column ``seq`` the lowest one wins where a pair was judged twice.

    Verdicts are staged as they come, so that no later filter runs the judge again."""
    by = by or []
    verdicts = stage(judge(matched.select(text, "matches").distinct()), "verdicts")
    seq = seq if seq in verdicts.columns else None
    judged = label_pairs(matched, verdicts, [text, "matches"], seq, drop_failed=drop_failed, keep=by)
    judged = stage(judged, "judged")
    return Evaluation(
        matches=matched.select(*by, text, "matches", "best_scores") if by else matches_table(matched, text),
        judged=judged if by else judged_table(judged, text),
        sweep=sweep_thresholds(judged, by, steps=steps, extra_metrics=extra_metrics),
    )


def _at_once_or_alone(
    at_once: Callable[[], DataFrame], alone: dict[str, Callable[[], DataFrame]], failures: dict[str, str] | None
) -> DataFrame:
    """The result of ``at_once``; if it fails, those of the parts that do not, the others noted by name."""
    try:
        return at_once()
    except Exception:
        if failures is None:
            raise
        done, failed = [], {}
        for name, part in alone.items():
            try:
                done.append(part())
            except Exception as problem:
                failed[name] = str(problem)
        if not done:
            raise
        failures |= failed
        return functools.reduce(DataFrame.unionByName, done)


def bootstrap_matches(
    log: DataFrame,
    models: dict[str, Encoder | str],
    *,
    id_col: str,
    text: str = "text",
    n_runs: int = 5,
    sample_ratio: float = 0.8,
    n_samples: int = 100,
    failures: dict[str, str] | None = None,
    score_digits: int | None = None,
    encode_once: bool = False,
) -> DataFrame:
    """``model, run`` and the matched queries of all bootstrap runs.

    A model is an encoder, or the name of a vector column of the log. The splits are drawn once and mark
    the rows with bitmaps of runs, so vectors are read once for all runs (see :class:`RunMarks`);
    each model encodes the log once, not once per run, and with ``encode_once`` each different text
    once. With ``failures`` given, what fails is noted
    there and left out instead of stopping the others: all runs are matched at once, and one by one
    (``model/run_n``) only if that fails; a model without a run left is noted by its name.
    """
    marked = bootstrap_marker(bootstrap_cuts(log, id_col, n_runs, sample_ratio, n_samples))
    parts = []
    for name, model in models.items():

        def matched_slab(vectors: DataFrame, marks: RunMarks) -> DataFrame:
            found = match_with_text(
                vectors, vectors, text, query_id=id_col, cache_id=id_col, vector="_vec", marks=marks,
            ).drop("rank")
            found = found.withColumn("best_scores", _rounded(F.col("score"), score_digits)).drop("score")
            asked = vectors.filter(F.col(marks.asked) != 0).select(id_col, text, F.explode(marks.runs_of(marks.asked)).alias("run"))
            return stage(with_no_hit_default(asked, found, [id_col, "run"]), "matched")

        def matched_runs(vectors: DataFrame, run: int | None = None) -> DataFrame:
            slabs = []
            for marks, mark in marked:
                if run is None or run in marks.runs:
                    rows = mark(vectors)
                    slabs.append(matched_slab(rows if run is None else marks.only(rows, run), marks))
            if slabs:
                return functools.reduce(DataFrame.unionByName, slabs)
            none = vectors.limit(0).select(id_col, text, F.lit(0).alias("run"), F.col(id_col).cast("long").alias("match_id"))
            return none.withColumns({"matches": F.lit(""), "best_scores": F.lit(0.0)})

        def matched_model() -> DataFrame:
            if isinstance(model, str):
                vectors = log.select(id_col, text, F.col(model).alias("_vec"))
            else:
                rows = log.select(id_col, text)
                if encode_once:
                    encoded = with_embeddings(rows, text, encode_distinct(rows, text, model))
                else:
                    encoded = encode_rows(rows, text, model)
                vectors = stage(encoded.withColumnRenamed("embedding", "_vec"), "model-vectors")
            one_by_one = {f"{name}/run_{i}": functools.partial(matched_runs, vectors, i) for i in range(1, n_runs + 1)}
            return _at_once_or_alone(lambda: matched_runs(vectors), one_by_one, failures)

        try:
            matched = matched_model()
        except Exception as problem:
            if failures is None:
                raise
            failures[name] = str(problem)
            continue
        columns = ["run", id_col, text, "match_id", "matches", "best_scores"]
        parts.append(matched.select(F.lit(name).alias("model"), *columns))
    if not parts:
        raise ValueError(f"no model could be evaluated: {failures}")
    return functools.reduce(DataFrame.unionByName, parts)


def leaderboard(
    sweeps: DataFrame, judged: DataFrame, run_keys: list[str] | None = None
) -> DataFrame:
    """Mean and deviation of curve area and density overlap per dataset and model."""
    run_keys = run_keys or RUN_KEYS
    aucs = area_under(sweeps, run_keys)
    overlaps = overlap(densities(judged, run_keys), run_keys)
    return run_stats(run_metrics(aucs, overlaps, run_keys))


def bootstrap_benchmark(
    datasets: dict[str, DataFrame],
    models: dict[str, Encoder | str],
    judge: JudgePairs | None = None,
    *,
    id_col: str,
    text: str = "text",
    n_runs: int = 5,
    sample_ratio: float = 0.8,
    n_samples: int = 100,
    steps: int = MAX_STEPS,
    score_digits: int | None = None,
    encode_once: bool = False,
) -> tuple[Evaluation, dict[str, str]]:
    """Every dataset with every model and run, evaluated in one job over all runs.

    Returns the evaluation, keyed by ``dataset, model, run``, and the failures by
    ``dataset/model`` or ``dataset/model/run_n``; a failing combination does not stop the others. If the
    judge fails, each dataset and model is judged alone, so that only the failing ones are left out.
    """
    failures: dict[str, str] = {}
    parts = []
    for dataset, log in datasets.items():
        failed: dict[str, str] = {}
        try:
            matched = bootstrap_matches(
                log, models, id_col=id_col, text=text, n_runs=n_runs,
                sample_ratio=sample_ratio, n_samples=n_samples, failures=failed, score_digits=score_digits,
                encode_once=encode_once,
            )
            parts.append(matched.withColumn("dataset", F.lit(dataset)))
        except Exception as problem:
            failed.setdefault("*", str(problem))
        failures |= {f"{dataset}/{model}": why for model, why in failed.items()}
    if not parts:
        raise ValueError(f"no dataset could be evaluated: {failures}")
    matched = functools.reduce(DataFrame.unionByName, parts)
    if judge is None:
        return chr_evaluation(matched, RUN_KEYS, text, steps), failures

    def judged(key: Row | None = None) -> Evaluation:
        mine = matched if key is None else matched.filter(
            (F.col("dataset") == key.dataset) & (F.col("model") == key.model)
        )
        return full_evaluation(mine, judge, RUN_KEYS, text, steps=steps)

    try:
        return judged(), failures
    except Exception:
        done = []
        for key in matched.select("dataset", "model").distinct().collect():
            try:
                done.append(judged(key))
            except Exception as problem:
                failures[f"{key.dataset}/{key.model}"] = str(problem)
        if not done:
            raise
        tables = {
            name: functools.reduce(DataFrame.unionByName, [getattr(d, name) for d in done])
            for name in ("matches", "sweep", "judged")
        }
        return Evaluation(**tables), failures


def write_evaluation(done: Evaluation, output_dir: str) -> dict[str, str]:
    """Write the tables of a one-run evaluation under their fixed names; returns their paths."""
    full = done.judged is not None
    matches = MATCHES if full else CHR_MATCHES
    paths = {matches: write_csv(done.matches, output_dir, matches)}
    if full:
        paths[JUDGED] = write_csv(done.judged, output_dir, JUDGED)
    sweep = SWEEP if full else CHR_SWEEP
    paths[sweep] = write_sweep(done.sweep, output_dir, sweep)
    return paths


def write_benchmark(done: Evaluation, output_dir: str) -> None:
    """Write all runs of a benchmark, a folder per dataset, model and run in each table.

    ``ts`` holds the time of the write, in the form of the results tree.
    """
    for name, df in (("matches", done.matches), ("sweep", done.sweep), ("judged", done.judged)):
        if df is not None:
            safe = df.withColumns({"model": folder_name(F.col("model")), "ts": run_stamp()})
            write_runs(safe, f"{output_dir.rstrip('/')}/{name}")
