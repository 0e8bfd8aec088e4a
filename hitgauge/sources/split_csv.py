"""Reading a large CSV file with line breaks inside quotes in many tasks.

A task that starts in the middle of a file cannot know whether it is inside a quoted field. So every byte range of the
file is read twice, each time as lines:

1. For each range: where it ends (inside a quoted field or not) if it began outside, and if it began inside.
   These are two bits per range; running through the ranges of a file in order gives where each really begins.
2. With that known, the lines of a range are put together to records. A record that reaches into later ranges
   leaves as fragments, at most two per range, which are joined by a second, small step.

Records are parsed by ``from_csv``, so types and missing values are those of Spark's reader. A quote opens a field only at
its start; inside it is doubled. Lines end in ``\\n`` or ``\\r\\n``. Blank lines between records are skipped, and the
first record of every file is its header.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

QUOTE, DELIMITER, BLANK = '"', ",", ("", "\r")
#: What a range gives: whole records, the rest of a record begun before, and the beginning of one.
WHOLE, REST, BEGUN = 0, 1, 2
_RANGE = ["file", "block"]
_FOUND = "file string, block bigint, place bigint, kind int, header boolean, record string"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether the end of a line is inside a quoted field."""
    if QUOTE not in line:
        return inside
    at = 0
    while True:
        if not inside and line.startswith(QUOTE, at):
            at, inside = at + 1, True
        if inside:
            while True:
                at = line.find(QUOTE, at) + 1
                if not at:
                    return True
                if line[at : at + 1] != QUOTE:
                    break
                at += 1
            inside = False
        at = line.find(DELIMITER, at) + 1
        if not at:
            return False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, place, line): lines by the byte range in which they begin, in order of their places."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"),
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    files, blocks = (batch.column(c).to_pylist() for c in _RANGE)
    start = 0
    for i in range(1, batch.num_rows + 1):
        if i == batch.num_rows or blocks[i] != blocks[start] or files[i] != files[start]:
            yield files[start], blocks[start], batch.slice(start, i - start)
            start = i


def _range_ends(lines: DataFrame) -> DataFrame:
    """(file, block, from_outside, from_inside, blank): where each range ends, by where it begins, and if it has blank lines only."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ends, blank = None, [False, True], True

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "file": [now[0]], "block": pa.array([now[1]], pa.int64()), "from_outside": [ends[0]], "from_inside": [ends[1]],
                "blank": [blank],
            })

        for batch in batches:
            for file, block, rows in _runs(batch):
                if (file, block) != now:
                    if now is not None:
                        yield row()
                    now, ends, blank = (file, block), [False, True], True
                for line in rows.column("line").to_pylist():
                    blank = blank and line in BLANK
                    if QUOTE in line:
                        ends = [ends_inside(line, x) for x in ends]
        if now is not None:
            yield row()

    return lines.mapInArrow(work, "file string, block bigint, from_outside boolean, from_inside boolean, blank boolean")


def range_starts(ends: DataFrame) -> DataFrame:
    """(file, block, inside, first): whether each range begins inside a quoted field, and before any record.

    A range that ends alike from both states fixes what follows; others keep the state or turn it, so the state is the
    last fixed one, turned as often as ranges turned it since.
    """
    same, turns = F.col("from_outside") == F.col("from_inside"), F.col("from_outside") & ~F.col("from_inside")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counted = ends.withColumn("turned", F.coalesce(F.sum(turns.cast("int")).over(before), F.lit(0)))
    # turns up to and with the fixing range, which itself does not turn
    fixed = F.when(same, F.struct((F.col("from_outside").cast("int") + F.col("turned")).alias("level")))
    level = F.coalesce(F.last(fixed, ignorenulls=True).over(before)["level"], F.lit(0))
    first = F.coalesce(F.bool_and("blank").over(before), F.lit(True))
    return counted.select("file", "block", ((level + F.col("turned")) % 2 == 1).alias("inside"), first.alias("first"))


def _found_records(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """(file, block, place, kind, header, record); the join may deal ranges anew, so their lines are brought in order."""
    own = starts.select(F.col("file").alias("_file"), F.col("block").alias("_block"), "inside", "first")
    held = lines.join(own, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    held = held.select(*_RANGE, "place", "inside", "first", "line").sortWithinPartitions("place")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place, out, held = None, 0, [], []
        inside = before = header = False

        def add(kind: int) -> None:
            nonlocal header
            text = "\n".join(held)
            if kind != WHOLE or text not in BLANK:
                out.append((kind, header, text))
                header = False
            held.clear()

        def found() -> pa.RecordBatch:
            n = len(out)
            return pa.RecordBatch.from_pydict({
                "file": pa.array([now[0]] * n, pa.string()), "block": pa.array([now[1]] * n, pa.int64()),
                "place": pa.array(range(place, place + n), pa.int64()), "kind": pa.array([x[0] for x in out], pa.int32()),
                "header": pa.array([x[1] for x in out], pa.bool_()), "record": pa.array([x[2] for x in out], pa.string()),
            })

        for batch in batches:
            for file, block, rows in _runs(batch):
                if (file, block) != now:
                    if held:
                        add(REST if before else BEGUN)
                    if out:
                        yield found()
                    now, place, out = (file, block), 0, []
                    inside = before = rows.column("inside")[0].as_py()
                    header = rows.column("first")[0].as_py()
                for line in rows.column("line").to_pylist():
                    held.append(line)
                    inside = ends_inside(line, inside)
                    if not inside:
                        add(REST if before else WHOLE)
                        before = False
                if out:
                    yield found()
                    place, out = place + len(out), []
        if held:
            add(REST if before else BEGUN)
        if out:
            yield found()

    return held.mapInArrow(work, _FOUND)


def joined_fragments(fragments: DataFrame) -> DataFrame:
    """(file, block, place, record): records of several ranges, put together."""
    order = Window.partitionBy("file").orderBy("block", "place")
    begun = F.sum((F.col("kind") == BEGUN).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    parts = F.array_sort(F.collect_list(F.struct("block", "place", "header", "record")))
    whole = fragments.withColumn("_n", begun).groupBy("file", "_n").agg(parts.alias("p"))
    return whole.select(F.col("p")[0]["header"].alias("header"), F.array_join("p.record", "\n").alias("record"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(header, record) of all records, blank lines left out; ``header`` marks the first of each file."""
    lines = _lines(spark, path)
    found = _found_records(lines, range_starts(_range_ends(lines)))
    whole = found.filter(F.col("kind") == WHOLE).select("header", "record")
    rows = whole.unionByName(joined_fragments(found.filter(F.col("kind") != WHOLE)))
    # As in Spark's reader, line breaks inside quotes become \n where lines end in \r\n; here each record tells for itself.
    windows = F.regexp_replace(F.regexp_replace("record", r"\r\z", ""), r"\r\n", "\n")
    return rows.withColumn("record", F.when(F.col("record").endswith("\r"), windows).otherwise(F.col("record")))


def read_split_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """The rows of :func:`hitgauge.sources.csv_files.read_csv` without its restriction to one task per file.

    Without a schema the names are those of a header and the types those that Spark infers from all records.
    """
    options = {"escape": QUOTE, "multiLine": "true"}
    body = csv_records(spark, path).filter(~F.col("header")).select("record")
    if schema is None:
        names = spark.read.options(**options).option("header", True).csv(path).columns  # the first record only
        kinds = spark.read.options(**options).option("inferSchema", True).csv(body.rdd.map(lambda r: r[0])).schema
        kinds = [*[f.dataType for f in kinds], *[StringType()] * len(names)]
        schema = StructType([StructField(n, t) for n, t in zip(names, kinds)])
    if isinstance(schema, StructType):
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return body.select(F.from_csv("record", schema, options).alias("r")).select("r.*")
