"""CSV files with row numbers, read in splits: the key of every first-occurrence audit.

Files are read as lines, in as many splits as Spark likes. Whether a line begins inside
a quoted field depends on all lines before it, but a line only ever maps the two states
(outside, inside) to two states, and such maps can be put together in any grouping: so
states are found within the blocks of a file first, then over the few blocks, and so
are numbers of records and rows. A block is up to ``LINES`` lines of a split's part of one
file: several windows hold a block at once in a task, at some hundred bytes a line, and can't
spill it for one another. What a task orders is bounded by that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

#: Lines of a block, and records of a file that are numbered together.
LINES, NUMBERED_TOGETHER = 1 << 15, 1 << 15

_FIELD = r'"[^"]*+(?:""[^"]*+)*+"'
_REST = r'^[^"]*+(?:""[^"]*+)*+"'


def _ends_inside(line: Column) -> Column:
    """Whether a quoted field is open at the end of a line that began outside of one; a quote inside an unquoted field is text."""
    return F.regexp_like(F.regexp_replace(line, f"(^|,){_FIELD}", "$1"), F.lit('(^|,)"'))


def line_states(line: Column) -> tuple[Column, Column]:
    """(end state of a line that begins outside, of one that begins inside a quoted field): 1 is inside."""
    quoted = F.contains(line, F.lit('"'))
    closed = F.when(F.regexp_like(line, F.lit(_REST)), _ends_inside(F.regexp_replace(line, _REST, "x"))).otherwise(True)
    return F.when(quoted, _ends_inside(line)).otherwise(False).cast("int"), F.when(quoted, closed).otherwise(True).cast("int")


def _after(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """``a0`` and ``a1``: the state after each row if the first of its keys begins outside or inside.

    A row keeps the state, flips it or sets it: the state is what the last setting row
    gave, flipped as often as rows flip after it.
    """
    by = Window.partitionBy(*keys).orderBy(*order)
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = df.withColumn("__flips", F.sum(F.when((F.col("t0") == 1) & (F.col("t1") == 0), 1).otherwise(0)).over(upto) % 2)
    held = counted.withColumn("__set", F.last(F.when(F.col("t0") == F.col("t1"), (F.col("t0") + F.col("__flips")) % 2), ignorenulls=True).over(upto))
    return held.withColumns({"a0": (F.coalesce("__set", F.lit(0)) + F.col("__flips")) % 2, "a1": (F.coalesce("__set", F.lit(1)) + F.col("__flips")) % 2}).drop("__flips", "__set")


def csv_records(spark: SparkSession, paths) -> DataFrame:
    """(source_file, record_no, record): the records of text files from 0 on, line breaks inside quotes kept.

    Lines end with a line feed; a carriage return before it goes. Files that aren't
    valid UTF-8 are decoded as Latin-1, which has a sign for every byte.
    """
    read = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(paths)
    lines = read.select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    t0, t1 = line_states(F.col("value"))
    # A split's lines have consecutive numbers, so pieces of a split stand in the order of its lines.
    block = ["source_file", "block", "piece"]
    own = _after(lines.withColumns({"t0": t0, "t1": t1, "piece": F.floor(F.col("line") / LINES)}), block, "line")
    ordered = Window.partitionBy(*block).orderBy("line")
    own = own.withColumns({"b0": F.coalesce(F.lag("a0").over(ordered), F.lit(0)), "b1": F.coalesce(F.lag("a1").over(ordered), F.lit(1))})
    starts = lambda b: F.sum(1 - F.col(b)).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = own.withColumns({"n0": starts("b0"), "n1": starts("b1")})
    blocks = own.groupBy(*block).agg(F.max_by("a0", "line").alias("t0"), F.max_by("a1", "line").alias("t1"), F.sum(1 - F.col("b0")).alias("s0"), F.sum(1 - F.col("b1")).alias("s1"), F.min(F.is_valid_utf8("value")).alias("valid"))
    file = Window.partitionBy("source_file").orderBy("block", "piece")
    placed = _after(blocks, ["source_file"], "block", "piece").withColumn("inside", F.coalesce(F.lag("a0").over(file), F.lit(0)))
    placed = placed.withColumn("starts", F.when(F.col("inside") == 1, F.col("s1")).otherwise(F.col("s0")))
    placed = placed.select(*block, "inside", F.coalesce(F.sum("starts").over(file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.min("valid").over(Window.partitionBy("source_file")).alias("utf8"))
    inside = F.col("inside") == 1
    met = own.join(placed, block).select(
        "source_file", "block", "line", (F.col("offset") + F.when(inside, F.col("n1")).otherwise(F.col("n0")) - 1).alias("record_no"),
        F.when(inside, F.col("b1")).otherwise(F.col("b0")).alias("begins"), F.when(inside, F.col("a1")).otherwise(F.col("a0")).alias("ends"),
        F.when(F.col("utf8"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1")).alias("value"),
    )
    single = (F.col("begins") == 0) & (F.col("ends") == 0)
    whole = met.where(single).select("source_file", "record_no", F.col("value").alias("record"))
    broken = met.where(~single).groupBy("source_file", "record_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "line", "value"))), lambda x: x["value"]), "\n").alias("record"))
    return whole.unionByName(broken).withColumn("record", F.regexp_replace("record", "\r$", ""))


def read_csv_rows(spark: SparkSession, paths, schema: str, null_value: str = "NA") -> DataFrame:
    """A CSV tree with ``source_file`` and ``row_no``: the place, from 0, of each row among those of its file.

    The first record of a file is its header; its columns are ``schema``'s, in order.
    Blank records aren't rows. A record with more fields than columns is dropped and has
    no number (a trailing comma is no field); one with fewer is filled with nulls. Empty
    fields, ``null_value`` and what can't be read as its column's type are null. No
    files' rows, no result; a file of a header alone has none.
    """
    wanted = T._parse_datatype_string(schema)
    names = [f"c{i}" for i in range(len(wanted.fields) + 1)]
    options = {"mode": "PERMISSIVE", "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}
    records = csv_records(spark, paths).where("record_no > 0 AND trim(record) <> ''")
    parsed = records.withColumn("x", F.from_csv("record", ", ".join(f"{c} string" for c in names), options)).where(f"x.{names[-1]} IS NULL")
    together = F.floor(F.col("record_no") / NUMBERED_TOGETHER)
    numbered = parsed.withColumn("part", together)
    before = Window.partitionBy("source_file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = numbered.groupBy("source_file", "part").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inner = F.row_number().over(Window.partitionBy("source_file", "part").orderBy("record_no")) - 1
    placed = numbered.withColumn("inner", inner).join(offsets, ["source_file", "part"])
    field = lambda c, kind: F.when(F.col(f"x.{c}") != null_value, F.col(f"x.{c}")).try_cast(kind)
    return placed.select(*(field(c, f.dataType).alias(f.name) for c, f in zip(names, wanted.fields, strict=False)), "source_file", (F.col("offset") + F.col("inner")).alias("row_no"))
