"""Shards by jump consistent hashing (native).

The published algorithm: a 64-bit linear congruential generator, seeded by the key, draws the next
shard count at which the key would jump; the last jump below the wanted number of shards is the
shard. There is no ring table, and one more shard takes 1/(n+1) of the keys, all into itself.

Cases: a NULL key counts as key 0; keys that are not integers go through ``xxhash64``. Rows of equal
key share a shard (that is the law). An empty table gives an empty table. Input columns that are
named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: The generator's multiplier, the parts of a 64-bit state.
MULTIPLIER = 2862933555777941757
WORD, HALF, SHIFT = 2**64, 2**31, 2**33

#: Steps that every key takes. About ln(shards) are needed, so hardly any key takes more; those that do go on.
STEPS = 32

#: Slots are counted per shard and bucket; 16**3 buckets, whatever the number of rows.
BUCKET_DIGITS = 3


def integer_key(df: DataFrame, key: str) -> Column:
    """The key as a long: integers as they are, NULL as 0, everything else hashed."""
    if isinstance(df.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.coalesce(df[key].cast("bigint"), F.lit(0).cast("bigint"))
    return F.when(df[key].isNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64(df[key]))


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a long key, 0 to ``shards`` - 1.

    Every jump goes at least one shard on, so ``shards`` steps always end the loop; steps after the
    last jump change nothing. Only keys that are not done after ``STEPS`` take the others. The state
    is an unsigned 64-bit number kept as a decimal.
    """
    if shards < 1:
        raise ValueError("there must be at least one shard")

    def whole(value: int) -> Column:
        return F.lit(str(value)).cast("decimal(20,0)")

    def draw(state: Column) -> Column:
        return F.pmod(state * whole(MULTIPLIER) + F.lit(1), whole(WORD)).cast("decimal(20,0)")

    def step(s: Column, _: Column) -> Column:
        high = ((s["state"] - F.pmod(s["state"], whole(SHIFT))) / whole(SHIFT)).cast("bigint")
        far = F.floor((s["next"] + 1) * (F.lit(float(HALF)) / (high + 1).cast("double")))
        jumped = F.struct(s["next"].alias("shard"), far.alias("next"), draw(s["state"]).alias("state"))
        return F.when(s["next"] < shards, jumped).otherwise(s)

    unsigned = F.pmod(key.cast("decimal(20,0)") + whole(WORD), whole(WORD)).cast("decimal(20,0)")
    start = F.struct(
        F.lit(-1).cast("bigint").alias("shard"),
        F.lit(0).cast("bigint").alias("next"),
        draw(unsigned).alias("state"),
    )
    def walk(first: int, last: int, state: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(first), F.lit(last)), state, step)

    if shards <= STEPS:
        return walk(1, shards, start)["shard"].cast("int")
    # an array of the one state, so that the first steps are not computed again for each of its uses
    reached = F.transform(
        F.array(walk(1, STEPS, start)),
        lambda s: F.when(s["next"] < shards, walk(STEPS + 1, shards, s)["shard"]).otherwise(s["shard"]),
    )
    return F.element_at(reached, 1).cast("int")


def shard_rows(df: DataFrame, key: str, shards: int, tie: list[str] | None = None) -> DataFrame:
    """All rows with ``shard``, ``slot`` (gapless from 0 in each shard) and ``grown_shard``.

    Slots are dealt without gathering a shard: rows are counted per shard and hash bucket, the
    buckets' offsets are summed (at most 4,096 rows per shard), and rows are numbered inside their
    bucket, by key and then by the ``tie`` columns.
    """
    rows = df.drop("shard", "slot", "grown_shard", "_bucket")
    key_of = integer_key(rows, key)
    digest = F.md5(F.coalesce(rows[key].cast("string"), F.lit("")).cast("binary"))
    placed = rows.select(
        "*",
        jump_shard(key_of, shards).alias("shard"),
        jump_shard(key_of, shards + 1).alias("grown_shard"),
        F.substring(digest, 1, BUCKET_DIGITS).alias("_bucket"),
    )
    counts = placed.groupBy("shard", "_bucket").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "shard", "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("shard", "_bucket").orderBy(key, *(tie or []))
    return (
        placed.join(offsets, ["shard", "_bucket"])
        .withColumn("slot", F.col("_offset") + F.row_number().over(inside) - 1)
        .select(*rows.columns, "shard", "slot", "grown_shard")
    )


def write_shards(df: DataFrame, key: str, shards: int, path: str, tasks: int) -> None:
    """Write all columns as one folder per shard; a shard may have several files."""
    rows = df.drop("shard")
    placed = rows.withColumn("shard", jump_shard(integer_key(rows, key), shards))
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(max(1, tasks // shards)))
    placed.repartition(tasks, "shard", spread).write.partitionBy("shard").parquet(path)
