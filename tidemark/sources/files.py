"""File sources and sinks: discovery, CSV with bad lines, manifests, provenance, JSON documents, parts."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.columns import normalized


def discover(spark: SparkSession, root: str, globs: list[str]) -> DataFrame:
    """(path, size, modified, file_no): the union of the globs under a folder of any store, by path."""
    out = None
    for g in globs:
        found = spark.read.format("binaryFile").option("pathGlobFilter", g).option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
        out = found if out is None else out.unionByName(found)
    out = out.distinct()
    # File names are few: their order is one small sort.
    return out.selectExpr("*", "dense_rank() OVER (ORDER BY path) - 1 AS file_no")


def read_csv(spark: SparkSession, paths, schema=None, encoding: str = "UTF-8", null_value: str = "NA") -> DataFrame:
    """A CSV tree: header, bad lines dropped, names normalised, ``source_file`` as provenance."""
    reader = spark.read.option("header", "true").option("mode", "DROPMALFORMED").option("encoding", encoding).option("nullValue", null_value).option("recursiveFileLookup", "true")
    df = (reader.schema(schema) if schema else reader).csv(paths)
    named = df.toDF(*(normalized(c) for c in df.columns))
    return named.withColumn("source_file", F.expr("_metadata.file_path")) if "_metadata" not in named.columns and not schema else named.withColumn("source_file", F.input_file_name())


def undecodable(spark: SparkSession, paths) -> list[str]:
    """The files of a text tree that aren't valid UTF-8 (their names alone come to the driver)."""
    lines = spark.read.option("recursiveFileLookup", "true").text(paths).select(F.input_file_name().alias("path"), F.is_valid_utf8("value").alias("valid"))
    return [r["path"] for r in lines.where("not valid").select("path").distinct().collect()]


def read_csv_any(spark: SparkSession, paths, schema: str, null_value: str = "NA") -> DataFrame:
    """``read_csv`` in UTF-8, but files that aren't valid UTF-8 in Latin-1, which decodes every byte.

    The schema is needed, for the two groups of files are one table.
    """
    odd = undecodable(spark, paths)
    every = [r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path").collect()]
    tail = {x.split(":", 1)[-1].lstrip("/") for x in odd}
    plain, latin = ([x for x in every if (x.split(":", 1)[-1].lstrip("/") in tail) is side] for side in (False, True))
    parts = [read_csv(spark, files, schema, encoding, null_value) for files, encoding in ((plain, "UTF-8"), (latin, "ISO-8859-1")) if files]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def with_source(df: DataFrame, path: str, depth: int = 2, benign: list[str] | None = None, out: str = "source_class") -> DataFrame:
    """The folder ``depth`` levels up of a path column as the row's source class, 'benign' if a token stands in it."""
    folder = F.element_at(F.split(F.col(path), "/"), -depth)
    if benign:
        folder = F.when(F.exists(F.array(*map(F.lit, benign)), lambda t: F.contains(F.lower(folder), t)), F.lit("benign")).otherwise(F.lit("attack"))
    return df.withColumn(out, folder)


def file_manifest(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, size, sha256, modified) of every file; contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))


def tree_hash(manifest: DataFrame, root: str) -> DataFrame:
    """One digest of a tree: the sorted relative paths and file digests (one short line a file)."""
    line = F.concat(F.substring_index("path", root.rstrip("/") + "/", -1), F.lit(" "), F.col("sha256"))
    return manifest.agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(line))), 256).alias("tree_sha256"))


def unique_manifest(spark: SparkSession, path: str, key: str = "cell_id") -> DataFrame:
    """A CSV manifest whose key must be unique; a repeated key is an error."""
    df = spark.read.option("header", "true").option("nullValue", "NA").option("inferSchema", "true").csv(path)
    if df.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"repeated {key} in {path}")
    return df


def read_seeds(spark: SparkSession, path_glob: str, expected: int | None = None) -> DataFrame:
    """Parquet parts of many runs with ``training_seed`` from the folder name; their number can be asserted."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(path_glob).withColumn("training_seed", F.regexp_extract(F.expr("_metadata.file_path"), r"seed(\d+)", 1).cast("int"))
    if expected is not None and (n := df.select("training_seed").distinct().count()) != expected:
        raise ValueError(f"{n} seeds instead of {expected}")
    return df


def write_splits(df: DataFrame, path: str, split: str = "split", mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(split).parquet(path)


def part_manifest(spark: SparkSession, path: str, label: str = "label", split: str = "split") -> DataFrame:
    """(split, rows, benign, attack) of written parts."""
    return spark.read.parquet(path).groupBy(split).agg(F.count("*").alias("rows"), F.count_if(F.col(label) == 0).alias("benign"), F.count_if(F.col(label) == 1).alias("attack"))


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_once(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append a batch whose rows belong to ``keys`` (a cell and a round, say): a key that is there already is replaced.

    A batch that is written again, or again after half of it, leaves each of its keys
    once. Keys are folders, and only those that the batch has are touched.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One small JSON document; Spark's committer makes it appear whole or not at all."""
    df.coalesce(1).write.mode("overwrite").json(path)


def same_parts(a: DataFrame, b: DataFrame) -> bool:
    """Whether two part manifests (path, sha256) name the same contents: the test for reuse."""
    left, right = a.select("sha256").distinct(), b.select("sha256").distinct()
    return not left.exceptAll(right).limit(1).count() and not right.exceptAll(left).limit(1).count()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which the driver and all executors share; a temporary folder only for a local master without one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder: a plan that reads them often is cut there and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def signature(inputs: DataFrame, columns: list[str], version: str) -> str:
    """A digest of what a table is built from: contents of the inputs (path, sha256), kept columns, version of the code."""
    line = F.concat_ws(" ", "path", "sha256")
    parts = inputs.agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(line))), 256)).first()[0]
    return hashlib.sha256(json.dumps([parts, columns, version]).encode()).hexdigest()


def built_once(spark: SparkSession, root: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of a signature: read if it is under ``root`` and whole, else built and published.

    A build goes to a folder of its own; then one small commit file names that folder
    and the digests of its parts, so a build that breaks off is never seen, on stores
    without a rename too. A part that is gone or has other bytes makes a new build.
    """
    home = f"{root}/{key}"
    try:
        commits = spark.read.schema("build string, at long, parts array<string>").json(f"{home}/commits").orderBy(F.desc("at")).limit(1).collect()
    except AnalysisException:
        commits = []
    for c in commits:
        try:
            if _part_digests(spark, f"{home}/{c.build}") == sorted(c.parts):
                return spark.read.parquet(f"{home}/{c.build}")
        except AnalysisException:
            pass
    name = uuid.uuid4().hex
    build().write.parquet(f"{home}/{name}")
    row = [(name, time.time_ns(), _part_digests(spark, f"{home}/{name}"))]
    spark.createDataFrame(row, "build string, at long, parts array<string>").coalesce(1).write.mode("append").json(f"{home}/commits")
    return spark.read.parquet(f"{home}/{name}")


def _part_digests(spark: SparkSession, path: str) -> list[str]:
    """One digest a part; parts are hashed where they are read."""
    return sorted(r["sha256"] for r in file_manifest(spark, path, "part-*").select("sha256").collect())
