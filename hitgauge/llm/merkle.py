"""Merkle manifest of a table: leaves, a tree per group, a tree of the groups, and sibling proofs.

A leaf is the SHA-256 of a row's fields. The leaves of a group in the order of their keys are reduced ``fanout``
at a time until one node, the group's subroot, is left; subroots in the order of their groups are reduced to
the root in the same way. A digest of several inputs is taken over their concatenated hex texts.

A level is one slot pivot: children are grouped by their parent, and conditional aggregates spread them
into ``fanout`` columns. The columns together make the parent's digest; left and right of a child's own column they
are its siblings. Going down again, each level's columns are joined with what is above their parent, so a leaf gets its
path without its group ever being in one place: a row holds ``fanout`` children and one path.

Places come from a range partitioning by (group, key): rows are numbered within their partition, and the counts of
(partition, group) say how many came before. A group with any share of the rows lies in many partitions, and so do
rows that repeat a key or are equal altogether. Leaves, places and levels are written, so a lost executor repeats
its own tasks only, and Spark sees what each level measures. No level depends on the number of groups.

Cases: NULL fields are ``-``, others their UTF-8 byte count, a colon and the value, so no two rows of different
fields have one leaf; NULL keys and groups come first; empty and very long texts are values like any other; rows that
repeat a key are leaves of their own, in the order of their digests (equal ones may change places, which changes
nothing); a lone leaf is its subroot and a lone subroot the root, with an empty path; an empty table has no rows. Only
the named fields are read, and no own name can clash with further columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitgauge.staging import attach, stage

#: Bits of a row's number within its partition.
PLACE_BITS = 33
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the concatenated texts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """``-`` for NULL, else byte count, colon and value."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return digest(*[framed(f) for f in fields])


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``gid`` (numbers of groups, in their order), ``pos`` from 0 in the group and its count ``n``."""
    by = [group, *order, "_row"]
    placed = rows.withColumn("_row", F.monotonically_increasing_id())  # splits rows that are equal altogether
    placed = placed.repartitionByRange(*by).sortWithinPartitions(*by).drop("_row")
    placed = stage(placed.withColumn("_mid", F.monotonically_increasing_id()), "merkle-places")
    placed = placed.withColumns({
        "_part": F.shiftrightunsigned("_mid", PLACE_BITS), "_place": F.col("_mid").bitwiseAND((1 << PLACE_BITS) - 1),
    }).drop("_mid")
    runs = placed.groupBy("_part", group).agg(F.count("*").alias("_rows"), F.min("_place").alias("_low"))
    own = Window.partitionBy(group)
    before = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "_part", group, "_low",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(own).alias("n"),
        F.min(F.shiftleft("_part", PLACE_BITS).bitwiseOR(F.col("_low"))).over(own).alias("gid"),
    )
    found = attach(placed, stage(runs, "merkle-runs"), ["_part", group])
    return found.withColumn("pos", F.col("_place") - F.col("_low") + F.col("_before")).drop("_part", "_place", "_low", "_before")


def _level(nodes: DataFrame, payload: list[str], fanout: int) -> DataFrame:
    """Parents (gid, pos, n, digest) of nodes, with the children in columns ``c0`` and so on; ``n`` counts children.

    The only node of a finished group is handed on as it is.
    """
    child = F.struct("digest", *payload)
    spread = nodes.groupBy("gid", F.expr(f"pos div {fanout}").alias("pos")).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("pos") % fanout == i, child)).alias(f"c{i}") for i in range(fanout)],
    )
    joined = digest(*[F.coalesce(f"c{i}.digest", F.lit("")) for i in range(fanout)])
    return spread.withColumn("digest", F.when(F.col("n") > 1, joined).otherwise(F.col("c0.digest")))


def climb(nodes: DataFrame, payload: list[str], fanout: int) -> list[DataFrame]:
    """The levels above ``nodes`` (gid, pos, n, digest, payload), the last with one node per group."""
    levels, most = [], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(stage(_level(nodes, payload, fanout), "merkle-level"))
        most = -(-most // fanout)
        nodes, payload = levels[-1].withColumn("n", F.expr(f"(n + {fanout - 1}) div {fanout}")), []
    return levels


def descend(levels: list[DataFrame], payload: list[str], above: DataFrame, fanout: int) -> DataFrame:
    """The lowest nodes (gid, pos, digest, payload) with the columns of ``above``, their ``path`` made longer.

    ``above`` has a row per group: gid, path and whatever else belongs to it.
    """
    carried = [c for c in above.columns if c not in ("gid", "path")]
    paths = above.withColumn("pos", F.lit(0).cast("bigint"))
    for number, level in reversed(list(enumerate(levels))):
        own = payload if number == 0 else []

        def beside(slots: range) -> Column:
            return F.concat(F.lit(""), *[F.coalesce(f"c{j}.digest", F.lit("")) for j in slots])

        children = F.array(*[
            F.when(F.col(f"c{i}").isNotNull(), F.struct(
                F.lit(i).alias("slot"), f"c{i}.digest", *[f"c{i}.{p}" for p in own],
                beside(range(i)).alias("left"), beside(range(i + 1, fanout)).alias("right"),
            ))
            for i in range(fanout)
        ])
        held = level.drop("digest").join(paths, ["gid", "pos"])
        held = held.select("gid", "pos", "n", "path", *carried, F.explode(children).alias("c")).filter("c is not null")
        step = F.array(F.struct("c.left", "c.right"))
        paths = held.select(
            "gid", (F.col("pos") * fanout + F.col("c.slot")).alias("pos"),
            F.when(F.col("n") > 1, F.concat(step, "path")).otherwise(F.col("path")).alias("path"),
            *carried, "c.digest", *[f"c.{p}" for p in own],
        )
    return paths


def manifest(
    docs: DataFrame, key: str, group: str, fields: list[str], altered: dict[str, Column] | None = None, fanout: int = 8,
) -> DataFrame:
    """(key, leaf, tampered, subroot, root, path): one row per row of ``docs``.

    ``path`` holds from leaf to root what stands left and right of the node on that level. ``tampered`` is the leaf with
    the fields in ``altered`` replaced (equal to ``leaf`` without any), for checks of the manifest.
    """
    own = [F.col(f) for f in fields]
    other = [(altered or {}).get(f, F.col(f)) for f in fields]
    leaves = docs.select(
        F.col(key).alias("key"), F.col(group).alias("grp"), leaf(own).alias("digest"), leaf(other).alias("tampered")
    )
    leaves = numbered(stage(leaves, "merkle-leaves"), "grp", ["key", "digest", "tampered"]).drop("grp")
    payload = ["key", "tampered"]
    levels = climb(leaves, payload, fanout)
    tops = (levels[-1] if levels else leaves).select("gid", "digest")
    whole = numbered(tops.select(F.lit(0).alias("grp"), F.col("gid").alias("own"), "digest"), "grp", ["own"]).drop("grp")
    upper = climb(whole, ["own"], fanout)
    root = (upper[-1] if upper else whole).select(
        "gid", F.array().cast(PATH).alias("path"), F.col("digest").alias("root")
    )
    subroots = descend(upper, ["own"], root, fanout) if upper else whole.join(root, "gid")
    subroots = subroots.select(F.col("own").alias("gid"), "path", F.col("digest").alias("subroot"), "root")
    found = descend(levels, payload, subroots, fanout) if levels else leaves.join(subroots, "gid")
    return found.select(F.col("key").alias(key), F.col("digest").alias("leaf"), "tampered", "subroot", "root", "path")


def proof(path: Column) -> Column:
    """Digest of all siblings from leaf to root, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def fold(leaf_: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, leaf_, lambda node, s: digest(s["left"], node, s["right"]))
