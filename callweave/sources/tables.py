"""Reading and writing fact tables: snapshots, interchange files, compilation databases."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from callweave.operators.fixpoint import remove
from callweave.operators.merge import absorb, build_stats, entry_counts
from callweave.plans.schema import TABLES, conform, struct

FORMAT_VERSION = 1


def save_snapshot(tables: dict[str, DataFrame], folder: str, config: str = "") -> None:
    """Write tables as Parquet into a new version under ``folder``, then switch to it.

    The switch is one row more in ``meta``, a commit of its own: until it is there the
    version before stays what ``load_snapshot`` reads.  Older versions go afterwards.
    """
    spark = next(iter(tables.values())).sparkSession
    last = _latest(spark, folder)
    n = last.seq + 1 if last else 1
    version = f"version-{n}-{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        conform(df, name).write.parquet(f"{folder}/{version}/{name}")
    meta = spark.createDataFrame([(n, FORMAT_VERSION, config, ",".join(sorted(tables)), version)], _META)
    meta.coalesce(1).write.mode("append").parquet(f"{folder}/meta")
    if last:
        remove(spark, f"{folder}/{last.version}")


_META = "seq int, format_version int, config string, tables string, version string"


def _latest(spark: SparkSession, folder: str):
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(_META).parquet(f"{folder}/meta").orderBy(F.desc("seq")).first()
    except AnalysisException:
        return None


def load_snapshot(spark: SparkSession, folder: str, config: str = "") -> dict[str, DataFrame] | None:
    """The tables of the latest snapshot, or None if it is absent, of another format or made with another config."""
    meta = _latest(spark, folder)
    if meta is None or meta.format_version != FORMAT_VERSION or meta.config != config:
        return None
    return {name: spark.read.schema(struct(name)).parquet(f"{folder}/{meta.version}/{name}") for name in meta.tables.split(",")}


def write_shard(tables: dict[str, DataFrame], folder: str) -> None:
    """One worker's tables, all or nothing: the marker comes last."""
    for name, df in tables.items():
        conform(df, name).write.parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(",".join(sorted(tables)),)], "tables string").coalesce(1).write.parquet(f"{folder}/_complete.parquet")


def read_shards(spark: SparkSession, folders: list[str]) -> dict[str, DataFrame]:
    """The tables of every complete shard, merged; a shard without its marker counts as absent."""
    from pyspark.errors import AnalysisException

    found: dict[str, list[DataFrame]] = {}
    for folder in folders:
        try:
            names = spark.read.parquet(f"{folder}/_complete.parquet").first().tables.split(",")
        except AnalysisException:
            continue
        for name in names:
            found.setdefault(name, []).append(spark.read.schema(struct(name)).parquet(f"{folder}/{name}"))
    return {name: absorb(name, shards) for name, shards in found.items()}


def read_facts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every known table that has a folder or file of its name, as Parquet or JSON lines, with declared columns."""
    from pyspark.errors import AnalysisException

    out = {}
    for name in TABLES:
        for suffix, kind in ((".parquet", "parquet"), (".json", "json"), ("", "parquet")):
            try:
                out[name] = conform(spark.read.format(kind).load(f"{folder}/{name}{suffix}"), name)
                break
            except AnalysisException:
                continue
    return out


def read_call_site_dump(spark: SparkSession, path: str) -> DataFrame:
    """Contexts from one JSON document {totalCallSites, callSites: [...]}."""
    # Declared, not inferred: nested fields would come in order of name.
    document = StructType().add("totalCallSites", "long").add("callSites", ArrayType(struct("call_sites")))
    found = spark.read.schema(document).option("multiLine", True).json(path).select(F.explode("callSites").alias("x")).select("x.*")
    return conform(found, "call_sites")


def write_node_tsv(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """usr, name, file, line, comma-joined callers, tab-separated."""
    callers = edges.groupBy("callee").agg(F.array_join(F.array_sort(F.collect_set("caller")), ",").alias("callers"))
    rows = nodes.join(callers, F.col("usr") == F.col("callee"), "left")
    rows.select("usr", "qualified_name", "file", "line", F.coalesce("callers", F.lit(""))).write.option("sep", "\t").option("emptyValue", "").mode("overwrite").csv(path)


def read_node_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(usr, qualified_name, file, line, callers)."""
    rows = spark.read.option("sep", "\t").schema("usr string, qualified_name string, file string, line int, callers string").csv(path)
    return rows.withColumn("callers", F.filter(F.split(F.coalesce("callers", F.lit("")), ","), lambda c: c != "")).fillna("", ["qualified_name", "file"])


def compile_commands(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(directory, file, arguments, db): commands of several databases; for each file those of the first that has any."""
    every = None
    for i, path in enumerate(paths):
        rows = spark.read.schema("directory string, file string, command string, arguments array<string>").option("multiLine", True).json(path)
        rows = rows.select("directory", "file", F.coalesce("command", F.array_join("arguments", " ")).alias("arguments"), F.lit(i).alias("db"))
        every = rows if every is None else every.unionByName(rows)
    first = F.min("db").over(Window.partitionBy("file"))
    return every.withColumn("_first", first).where("db = _first").drop("_first")


def stamp_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, mtime_ns, size) of files that the driver sees; 0 and 0 where there is none."""
    rows = []
    for p in paths:
        try:
            s = os.stat(p)
            rows.append((p, s.st_mtime_ns, s.st_size))
        except OSError:
            rows.append((p, 0, 0))
    return spark.createDataFrame(rows, struct("file_stamps"))


def files_with(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(file, text) of whole files that a regular expression matches somewhere."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return rows.where(F.col("text").rlike(pattern))


def pack_files(rows: DataFrame, folder: str) -> None:
    """Files (file, text) as a table of as many parts as the data has: a file system has no entry for each of them."""
    rows.select("file", "text").write.parquet(folder)


def packed_with(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """``files_with`` over packed files."""
    return spark.read.schema("file string, text string").parquet(folder).where(F.col("text").rlike(pattern))


JOURNAL = "seq long, tu_path string, stamp string, state string"


def append_journal(records: DataFrame, folder: str, header: str = "") -> None:
    """Add records (seq, tu_path, stamp, state) to a journal of one configuration; each write is atomic."""
    records.withColumn("header", F.lit(header)).write.mode("append").partitionBy("header").parquet(folder)


def read_journal(spark: SparkSession, folder: str, header: str = "") -> DataFrame:
    """The latest record of each unit of a journal; of one with another header, or none, nothing."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(f"{JOURNAL}, header string").parquet(folder)
    except AnalysisException:
        return spark.createDataFrame([], JOURNAL)
    rows = rows.where(F.coalesce("header", F.lit("")) == header).drop("header")
    last = rows.groupBy("tu_path").agg(F.max_by(F.struct("seq", "stamp", "state"), "seq").alias("x"))
    return last.select("x.seq", "tu_path", "x.stamp", "x.state")


def stats_json(stats: DataFrame, tables: dict[str, DataFrame], mode: str = "cold") -> str:
    """One JSON document on a run: its mode, wall time and failures by phase, sizes of the tables, and every unit."""
    phases = {r.phase: {"files": r.n, "failed": r.failed, "ms": r.total_ms} for r in build_stats(stats).collect()}
    sizes = {r["name"]: r.n for r in entry_counts(tables).collect()}
    files = [r.asDict() for r in stats.select("file", "phase", "ms", F.col("tool_status").alias("status")).orderBy("file", "phase").toLocalIterator()]
    return json.dumps({"mode": mode, "phases": phases, "tables": sizes, "files": files}, sort_keys=True)
