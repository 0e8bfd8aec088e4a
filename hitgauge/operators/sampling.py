"""Seeded samples and query/cache splits.

A row's place in a seeded order is ``md5(seed|id)``, ties by id, so a sample is the same on every
cluster. A sample of n rows is "all rows up to the n-th key of that order": once this cutoff key
is known, sample and remainder are two filters on the same scan. No row is moved, and neither a
global sort nor an anti join is needed. ``id`` must be unique.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitgauge.staging import attach, stage

# Standard deviations around the expected cutoff key inside which the true one is looked for.
BRACKET_SIGMAS = 10
_HEX_DIGITS = 13  # 52 bits, exact in a float
_ABOVE_HEX = "g"


def seeded_key(seed: int | Column, id_col: str | Column) -> Column:
    """Text key that orders rows pseudo-randomly for this seed."""
    ident = F.col(id_col) if isinstance(id_col, str) else id_col
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws("|", seed.cast("string"), ident.cast("string")))


def seeded_position(seed: int | Column, id_col: str | Column) -> Column:
    """The leading 60 bits of the seeded key as a BIGINT: a row's position after a shuffle."""
    return F.conv(F.substring(seeded_key(seed, id_col), 1, 15), 16, 10).cast("long")


def seeded_positions(seed: int, ids: np.ndarray) -> np.ndarray:
    """:func:`seeded_position` of whole-number ids inside a task."""
    digests = (hashlib.md5(f"{seed}|{i}".encode()).hexdigest() for i in ids.tolist())
    return np.fromiter((int(d[:15], 16) for d in digests), np.int64, len(ids))


def _key_at(share: float) -> str:
    return _ABOVE_HEX if share >= 1 else f"{int(max(share, 0.0) * 16**_HEX_DIGITS):0{_HEX_DIGITS}x}"


def order_cutoffs(
    keyed: DataFrame,
    by: list[str],
    total: int,
    wanted: int,
    restrict: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Per group, the last key of its first ``wanted`` rows in (_key, _id) order.

    ``keyed`` has the group columns, ``_key`` (md5 text) and ``_id``; every group has ``total``
    rows. md5 keys are evenly spread, so the wanted one lies close to ``wanted / total`` of the key
    range: rows below that bracket are only counted and rows above it ignored. What is left to rank
    are about ``20 * sqrt(total)`` rows per group. ``restrict`` narrows the rows to those that count;
    it is applied after the rows above the bracket are gone.
    """
    share = wanted / total
    margin = (BRACKET_SIGMAS * math.sqrt(total * share * (1 - share)) + BRACKET_SIGMAS) / total
    low, high = _key_at(share - margin), _key_at(share + margin)
    if restrict is not None:
        keyed = restrict(keyed.filter(F.col("_key") < high))
    # One projection and no filter, so that the md5 of a row is computed once.
    key = F.col("_key")
    zoned = keyed.select(
        *by,
        F.when((key >= low) & (key < high), F.struct("_key", "_id")).alias("_row"),
        (key < high).cast("long").alias("_one"),
    )
    counted = zoned.groupBy(*by, "_row").agg(F.sum("_one").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy(F.col("_row").asc_nulls_first()))
    last = counted.withColumn("_upto", upto).filter(
        F.col("_row").isNotNull()
        & (F.col("_upto") - F.col("_n") < wanted)
        & (F.col("_upto") >= wanted)
    )
    exact = F.when(F.col("_upto") == wanted, F.col("_row._key")).otherwise(
        F.raise_error(F.lit("the id column of a sample must be unique"))
    )
    return last.select(*by, exact.alias("_cut_key"), F.col("_row._id").alias("_cut_id"))


def _within(key: Column, ident: Column, cut_key: Column, cut_id: Column) -> Column:
    """(key, id) <= (cut_key, cut_id); false without a cutoff. The key is computed once."""
    return F.struct(key, ident) <= F.struct(cut_key, cut_id)


def mark_sample(
    df: DataFrame, id_col: str, n: int, seed: int = 42, flag: str = "is_query"
) -> DataFrame:
    """Flag exactly ``min(n, count)`` rows, without replacement."""
    total = df.count()
    if n <= 0 or n >= total:
        return df.withColumn(flag, F.lit(n > 0))
    keyed = df.select(seeded_key(seed, id_col).alias("_key"), F.col(id_col).alias("_id"))
    cut = order_cutoffs(keyed, [], total, n).first()
    if cut is None:
        raise ValueError("the id column of a sample must be unique")
    key, ident = seeded_key(seed, id_col), F.col(id_col)
    cut_id = F.lit(cut["_cut_id"]).cast(df.schema[id_col].dataType)
    return df.withColumn(flag, _within(key, ident, F.lit(cut["_cut_key"]), cut_id))


def sample_n(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all rows if there are fewer)."""
    return mark_sample(df, id_col, n, seed, "_in").filter("_in").drop("_in")


def split_queries_cache(
    log: DataFrame,
    id_col: str,
    n_samples: int = 100,
    cache: DataFrame | None = None,
    seed: int = 42,
    cache_id: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Queries and cache with a shuffled ``cache_pos``.

    With an explicit cache its rows are all kept, also those equal to a query; otherwise the cache
    is the log without the sampled rows.
    """
    marked = mark_sample(log, id_col, n_samples, seed)
    queries = marked.filter("is_query").drop("is_query")
    rest = marked.filter(~F.col("is_query")).drop("is_query") if cache is None else cache
    return queries, rest.withColumn("cache_pos", seeded_position(seed, cache_id or id_col))


def _one_per_run(cuts: DataFrame, n_runs: int) -> DataFrame:
    """The staged cutoffs; a run whose cutoff repeated ids hide must not vanish unseen."""
    staged = stage(cuts, "run-cuts")
    if staged.count() != n_runs:
        raise ValueError("the id column of a sample must be unique")
    return staged


#: Added to a run's number: the seeds of its queries and of the order of its cache.
QUERY_SEED, ORDER_SEED = 1000, 2000
#: Runs in one bitmap.
MARK_RUNS = 62


@dataclass(frozen=True)
class RunMarks:
    """Columns of bitmaps that say in which runs a row is a query (``asked``) or a cached row (``held``).

    Bit i stands for run ``runs[i]``; ``order_seed`` plus the run seeds the order of its cache.
    """

    asked: str
    held: str
    runs: tuple[int, ...]
    order_seed: int = ORDER_SEED

    def runs_of(self, bits: str) -> Column:
        """Array of the runs whose bits are set."""
        pairs = F.array(*[F.struct(F.lit(1 << i).cast("long").alias("bit"), F.lit(r).alias("run")) for i, r in enumerate(self.runs)])
        return F.filter(pairs, lambda p: F.col(bits).bitwiseAND(p["bit"]) != 0)["run"]

    def only(self, df: DataFrame, run: int) -> DataFrame:
        """The same rows, marked for one run."""
        bit = F.lit(1 << self.runs.index(run)).cast("long")
        return df.withColumns({c: F.col(c).bitwiseAND(bit) for c in (self.asked, self.held)})


@dataclass(frozen=True)
class RunCuts:
    """Last keys of the universes and of the queries of all runs (None: every row is in)."""

    id_col: str
    n_runs: int
    universe: DataFrame | None
    queries: DataFrame | None  # None: no run is large enough


def bootstrap_cuts(
    log: DataFrame, id_col: str, n_runs: int = 5, sample_ratio: float = 0.8, n_samples: int = 100
) -> RunCuts:
    """Draw all runs of a log: two cutoff keys per run, from the ids alone.

    Run i takes ``round(sample_ratio * count)`` rows as its universe (seed i), ``n_samples`` of
    them as queries (seed i + 1000) and shuffles the rest as cache (seed i + 2000). A universe that
    is not larger than ``n_samples`` gives no run.
    """
    run, total = F.col("run"), log.count()
    size = round(sample_ratio * total)  # half to even
    if size <= n_samples:
        return RunCuts(id_col, n_runs, None, None)

    def keyed(df: DataFrame, seed: Column) -> DataFrame:
        return df.select("run", seeded_key(seed, id_col).alias("_key"), F.col(id_col).alias("_id"))

    ids = _fan_out(log.select(id_col), n_runs)
    universe = None
    if size < total:
        universe = _one_per_run(order_cutoffs(keyed(ids, run), ["run"], total, size), n_runs)
    queries = order_cutoffs(
        keyed(ids, run + QUERY_SEED), ["run"], size, n_samples, lambda rows: _in_universe(rows, "_id", universe)
    )
    return RunCuts(id_col, n_runs, universe, _one_per_run(queries, n_runs))


def _fan_out(df: DataFrame, n_runs: int) -> DataFrame:
    return df.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(n_runs))))


def _in_universe(df: DataFrame, ident: str, cuts: DataFrame | None) -> DataFrame:
    if cuts is None:
        return df
    inside = _within(seeded_key(F.col("run"), ident), F.col(ident), F.col("_cut_key"), F.col("_cut_id"))
    return attach(df, cuts, ["run"]).filter(inside).drop("_cut_key", "_cut_id")


def bootstrap_splitter(
    log: DataFrame, id_col: str, n_runs: int = 5, sample_ratio: float = 0.8, n_samples: int = 100
) -> Callable[[DataFrame], DataFrame]:
    """Draw all runs of a log once; the result adds the runs to any table with the log's ids.

    The runs are those of :func:`bootstrap_cuts`. The splitter repeats each row per run and adds ``run``,
    ``is_query`` and ``cache_pos``; :func:`bootstrap_marker` marks the rows instead and repeats none.
    """
    cuts = bootstrap_cuts(log, id_col, n_runs, sample_ratio, n_samples)
    run = F.col("run")
    if cuts.queries is None:
        return lambda df: _fan_out(df.limit(0), n_runs).withColumns(
            {"is_query": F.lit(False), "cache_pos": F.lit(None).cast("long")}
        )

    def split(df: DataFrame) -> DataFrame:
        # The query cutoff comes first: few rows are below it, so the queries need one md5 per row.
        rows = attach(_fan_out(df, n_runs), cuts.queries, ["run"])
        asked = _within(seeded_key(run + QUERY_SEED, id_col), F.col(id_col), F.col("_cut_key"), F.col("_cut_id"))
        rows = rows.withColumn("is_query", asked).drop("_cut_key", "_cut_id")
        position = F.when(~F.col("is_query"), seeded_position(run + ORDER_SEED, id_col))
        return _in_universe(rows, id_col, cuts.universe).withColumn("cache_pos", position)

    return split


def bootstrap_marker(cuts: RunCuts, asked: str = "_asked", held: str = "_held") -> list[tuple[RunMarks, Callable[[DataFrame], DataFrame]]]:
    """Marks of all runs and how to add them to a table with the log's ids: no row is repeated.

    The cutoffs (two per run) are read once and are literals of the projection that computes the bitmaps.
    There is one pair for each ``MARK_RUNS`` runs.
    """
    if cuts.queries is None:
        return []
    keys = {r.run: r for r in cuts.queries.collect()}
    limits = {r.run: r for r in cuts.universe.collect()} if cuts.universe is not None else {}
    out = []
    for first in range(1, cuts.n_runs + 1, MARK_RUNS):
        runs = tuple(range(first, min(cuts.n_runs, first + MARK_RUNS - 1) + 1))
        marks = RunMarks(asked, held, runs)

        def mark(df: DataFrame, runs: tuple[int, ...] = runs) -> DataFrame:
            kind = df.schema[cuts.id_col].dataType

            def cut(row) -> Column:
                if row is None:
                    return F.lit(None).cast(f"struct<key:string,id:{kind.simpleString()}>")
                return F.struct(F.lit(row["_cut_key"]).alias("key"), F.lit(row["_cut_id"]).cast(kind).alias("id"))

            table = F.array(*[
                F.struct(F.lit(r).alias("run"), F.lit(1 << i).cast("long").alias("bit"),
                         cut(keys[r]).alias("queries"), cut(limits.get(r)).alias("universe"))
                for i, r in enumerate(runs)
            ])
            ident = F.col(cuts.id_col)

            def below(seed: Column, last: Column) -> Column:
                return F.struct(seeded_key(seed, cuts.id_col).alias("key"), ident.alias("id")) <= last

            # one pass over the runs: bits of the queries, then those of the other rows of the universe
            bits = F.transform(table, lambda t: F.when(
                t["universe"].isNull() | below(t["run"], t["universe"]),
                F.when(below(t["run"] + QUERY_SEED, t["queries"]), t["bit"]).otherwise(-t["bit"]),
            ).otherwise(F.lit(0).cast("long")))

            def together(sign: int) -> Column:
                chosen = F.filter("_bits", lambda b: b * sign > 0)
                return F.aggregate(chosen, F.lit(0).cast("long"), lambda a, b: a + b * sign)

            return df.withColumn("_bits", bits).withColumns({asked: together(1), held: together(-1)}).drop("_bits")

        out.append((marks, mark))
    return out


def bootstrap_runs(log: DataFrame, id_col: str, **options) -> DataFrame:
    """The log's rows in all runs; options as for :func:`bootstrap_splitter`."""
    return bootstrap_splitter(log, id_col, **options)(log)


def split_overlap(queries: DataFrame, cache: DataFrame, column: str) -> DataFrame:
    """Distinct values that are in both sides of a split (none, by id, in a complement split)."""
    return queries.select(column).intersect(cache.select(column))


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows by position; 0 means all."""
    return df.orderBy(order).limit(n) if n > 0 else df
