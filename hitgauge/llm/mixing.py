"""Mixing sources to target weights by Pareto order sampling (native).

Each source has a target in words. All its documents get the whole copies that the target holds
(``target`` div ``source_size``); the rest is a fixed-size sample with unequal inclusion odds, drawn by
Pareto order sampling: a document's rank is the odds of its random number divided by its inclusion
odds, and the lowest ranks are taken until their words meet the rest of the target, to within half a
document. Longer documents get somewhat higher odds; the odds sum to the rest of the target.

Random numbers are a hash of seed and id, so reruns agree and no order of rows matters.

Cases: a NULL or empty text has size 0 and takes 0 words; a NULL source is a source of its own, the
last; rows that repeat an id share its random number and are taken together; an empty table gives an
empty table. Input columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitgauge.staging import attach, stage

WORDS = r"[^\x20\x09-\x0D]+"
#: Ranks are first counted in so many classes per source; only one class is then sorted.
CLASSES = 4096
#: Length at which a document's preference for length is half of its greatest, in words.
HALF_LENGTH = 500
OWN = ["size", "source_size", "target", "copies", "taken"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def _preference(size: Column) -> Column:
    """0 to 1000, growing with length; an integer, so that sums are exact."""
    return F.floor(size * 1000 / (size + HALF_LENGTH)).cast("bigint")


def source_targets(
    sized: DataFrame, source: str, weights: tuple[int, ...] = (5, 2, 1), ceiling: int = 3
) -> DataFrame:
    """(source, source_size, target, ...) with one row per source.

    Sources in code-point order, NULL last, weigh ``weights`` in turn and share the sum of all sizes.
    No target is above ``ceiling`` times its source; what is cut off goes to the others by weight.
    With sources ordered by ceiling over weight, those that are cut come first, so that running sums
    over the table of sources give the final level at once.
    """
    per = sized.groupBy(source).agg(
        F.sum("size").alias("source_size"), F.sum(_preference(F.col("size")) * F.col("size")).alias("_liked")
    )
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    per = per.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), place + 1))
    per = per.withColumn("_most", F.col("source_size") * ceiling)
    order = Window.orderBy(F.col("_most") / F.col("_weight"), F.col(source).asc_nulls_last())
    past, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.select(
        "*",
        F.row_number().over(order).alias("_place"),
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("_most").over(past), F.lit(0))).alias("_left"),
        (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(past), F.lit(0))).alias("_weights"),
    ).withColumn("_level", F.col("_left") / F.col("_weights"))
    free = F.col("_level") * F.col("_weight") <= F.col("_most")
    per = per.withColumn("_first", F.min(F.when(free, F.col("_place"))).over(everything))
    level = F.max(F.when(F.col("_place") == F.col("_first"), F.col("_level"))).over(everything)
    target = F.when(F.col("_place") < F.col("_first"), F.col("_most").cast("double")).otherwise(
        level * F.col("_weight")
    )
    return per.select(source, "source_size", target.alias("target"), "_liked")


def _draws(rows: DataFrame, key: str, seed: str) -> DataFrame:
    """Add the rank ``_q`` and its class to rows that carry their source's ``_part`` and ``_mean``."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    number = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")
    u = (number.cast("double") + 0.5) / float(2**52)
    part, room = F.col("_part"), F.least(F.col("_part"), 1 - F.col("_part"))
    chance = part + room * 0.5 * (_preference(F.col("size")) - F.col("_mean")) / 1000
    q = (u / (1 - u)) / (chance / (1 - chance))
    flat = q * (part / (1 - part))
    cls = F.least(F.floor(flat / (1 + flat) * CLASSES), F.lit(CLASSES - 1)).cast("int")
    drawn = (part > 0) & (part < 1)
    return rows.withColumn("_q", F.when(drawn, q)).withColumn(
        "_class", F.when(drawn, F.when(F.col("_q") < 1e300, cls).otherwise(CLASSES - 1))
    )


def _cutoffs(sized: DataFrame, per: DataFrame, source: str, key: str, seed: str) -> DataFrame:
    """Per source the class in which the rest of the target is met, and the last rank taken there."""
    drawn = _draws(attach(sized, per, [source]), key, seed).filter(F.col("_class").isNotNull())
    classes = drawn.groupBy(source, "_class").agg(F.sum("size").alias("_words"), F.max("_rest").alias("_rest"))
    upto = Window.partitionBy(source).orderBy("_class").rowsBetween(Window.unboundedPreceding, 0)
    classes = classes.withColumn("_upto", F.sum("_words").over(upto))
    meets = classes.filter(F.col("_upto") > F.col("_rest")).groupBy(source).agg(
        F.min(F.struct(F.col("_class"), (F.col("_upto") - F.col("_words")).alias("_before"))).alias("_m")
    )
    meets = stage(meets.select(source, F.col("_m._class").alias("_meet"), F.col("_m._before").alias("_before")), "mix-classes")
    order = Window.partitionBy(source).orderBy("_q", key).rowsBetween(Window.unboundedPreceding, -1)
    inside = attach(drawn, meets, [source]).filter(F.col("_class") == F.col("_meet")).select(
        source, "_q", "size", "_rest",
        (F.col("_before") + F.coalesce(F.sum("size").over(order), F.lit(0))).alias("_sum"),
    )
    last = inside.filter(F.col("_sum") + F.col("size") / 2 <= F.col("_rest")).groupBy(source).agg(
        F.max("_q").alias("_last")
    )
    return attach(meets, last, [source]).drop("_before")


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    ceiling: int = 3,
    seed: str = "mix",
    keep: list[str] | None = None,
) -> DataFrame:
    """All rows of ``docs`` (columns ``keep``, by default all) with size, source_size, target, copies, taken.

    Texts are read once for their sizes, which are staged with id and source only; targets, ranks and
    cutoffs come from that narrow table, and the decision on a row is a function of the row and of its
    source's cutoff, so no document is shuffled.
    """
    sized = stage(
        docs.select(F.col(key), F.col(source), word_count(F.col(text)).alias("size")), "mix-sizes"
    )
    per = source_targets(sized, source, weights, ceiling)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per = per.withColumn("_whole", F.floor(rate).cast("bigint")).select(
        "*",
        (rate - F.col("_whole")).alias("_part"),
        (F.col("target") - F.col("_whole") * F.col("source_size")).alias("_rest"),
        F.when(F.col("source_size") > 0, F.col("_liked") / F.col("source_size")).otherwise(0.0).alias("_mean"),
    )
    per = stage(per.drop("_liked"), "mix-sources")
    cut = stage(attach(per, _cutoffs(sized, per, source, key, seed), [source]), "mix-cutoffs")
    keep = [c for c in (keep or docs.columns) if c not in OWN]
    if set(keep) <= {key, source}:
        rows = sized
    else:
        rows = docs.drop(*OWN).withColumn("size", word_count(F.col(text)))
    rows = _draws(attach(rows, cut, [source]), key, seed)
    below = (F.col("_meet").isNull()) | (F.col("_class") < F.col("_meet"))
    at = (F.col("_class") == F.col("_meet")) & (F.col("_q") <= F.col("_last"))
    extra = F.when(F.col("_class").isNull(), 0).when(below | F.coalesce(at, F.lit(False)), 1).otherwise(0)
    copies = (F.col("_whole") + extra).cast("bigint")
    return rows.select(
        *keep, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, key="doc_id", text="text", source="source", **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all columns of ``docs`` and no others."""
    packed = docs.select(
        F.struct(*docs.columns).alias("_doc"), *dict.fromkeys([key, text, source])
    )
    mixed = mix(packed, key, text, source, keep=["_doc"], **options).filter("copies > 0")
    copied = mixed.select("_doc", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return copied.select("_doc.*")
