"""Verdicts on (query, match) pairs and the labels made from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitgauge.operators.models import once_per_worker

# Fixed value: the answer that makes a pair a positive.
POSITIVE_ANSWER = "yes"

Pair = tuple[str, str]
Judge = Callable[[Sequence[Pair], str], "Sequence[str | None]"]


def judge_pairs(
    pairs: DataFrame,
    load_judge: Callable[[], Judge],
    *,
    text_col: str = "text",
    match_col: str = "matches",
    prompt: str = "",
    preprocess: Callable[[Column], Column] | None = None,
    postprocess: Callable[[Column], Column] | None = None,
    batch_size: int = 1,
) -> DataFrame:
    """Add ``response`` and ``error`` to every pair.

    ``load_judge`` runs once per Python worker and returns ``judge(pairs, prompt) -> answers``. A batch
    that raises, or an answer of None, leaves ``response`` NULL and never stops the other pairs.
    ``preprocess`` is applied to both texts before, ``postprocess`` to the response after.
    """
    before = preprocess or (lambda c: c)
    after = postprocess or (lambda c: c)
    get_judge = once_per_worker(load_judge)

    @F.pandas_udf("response string, error string")
    def verdicts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        judge = get_judge()
        for queries, matches in batches:
            answers: list[str | None] = []
            errors: list[str | None] = []
            todo = list(zip(queries, matches))
            for start in range(0, len(todo), batch_size):
                chunk = todo[start : start + batch_size]
                try:
                    got = list(judge(chunk, prompt))
                    answers += got
                    errors += [None if a is not None else "no answer" for a in got]
                except Exception as problem:  # one unusable batch must not stop the job
                    answers += [None] * len(chunk)
                    errors += [str(problem)] * len(chunk)
            yield pd.DataFrame({"response": answers, "error": errors}, dtype=object)

    judged = pairs.withColumn("_v", verdicts(before(F.col(text_col)), before(F.col(match_col))))
    return judged.withColumns(
        {"response": after(F.col("_v.response")), "error": F.col("_v.error")}
    ).drop("_v")


def failure_count(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(F.col("response").isNull()).alias("n_failed"),
    )


def first_verdicts(verdicts: DataFrame, keys: list[str], seq: str | None) -> DataFrame:
    """One usable verdict per pair: the one with the lowest ``seq``, or the least one without it."""
    usable = verdicts.filter(F.col("response").isNotNull())
    return usable.groupBy(*keys).agg(F.min_by("response", seq or "response").alias("response"))


def verdict_label(response: Column) -> Column:
    """1 for the exact answer, 0 for anything else and for a missing verdict."""
    return F.coalesce((response == POSITIVE_ANSWER).cast("int"), F.lit(0))


def label_pairs(
    matched: DataFrame,
    verdicts: DataFrame,
    keys: list[str],
    seq: str | None,
    score: str = "best_scores",
    drop_failed: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``keep``, the pair, ``similarity_score`` and ``actual_label`` of every matched query.

    Verdicts are joined null-safe on the pair. Each pair has one verdict, so a pair that many
    queries share stays a many-to-one join, which AQE splits when its partition is too large.
    """
    known = first_verdicts(verdicts, keys, seq).select(
        *[F.col(k).alias(f"_v_{k}") for k in keys], "response"
    )
    same = F.lit(True)
    for k in keys:
        same = same & matched[k].eqNullSafe(known[f"_v_{k}"])
    joined = matched.join(known, same, "left")
    if drop_failed:
        joined = joined.filter(known["response"].isNotNull())
    return joined.select(
        *[matched[c] for c in keep],
        *[matched[k] for k in keys],
        matched[score].cast("double").alias("similarity_score"),
        verdict_label(known["response"]).alias("actual_label"),
    )
