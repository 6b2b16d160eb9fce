"""Files: JSON lines with explicit schemas, packs, exports with checksums, CSV submissions, keyed ledgers."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.blocked import blocked_cumsum


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, key: str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped. With a key, a duplicate is an error, as is an empty file."""
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    if key:
        counts = df.groupBy(key).count()
        if (bad := counts.where("count > 1").first()) is not None:
            raise ValueError(f"duplicate {key}: {bad[0]}")
        if counts.isEmpty():
            raise ValueError(f"no rows in {path}")
    return df


def read_last(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lines of which the last row of a key counts (by file, then by position in the text)."""
    rows = spark.read.schema(schema).json(path)
    # numbers rise within the piece of a file that a task reads
    at = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("__at"))
    return rows.select("*", at.alias("__at")).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__at")


def _small_text(spark: SparkSession, path: str) -> str | None:
    """A file that readers of tables pass over, as its name begins with an underscore; None if it isn't there."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(context.hadoopConfiguration())
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_pack(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The manifests of a stage pack, if its marker says that it is complete."""
    marker = _small_text(spark, f"{path}/_SUCCESS.json")
    if marker is None or json.loads(marker).get("status") != "success":
        raise ValueError(f"the pack at {path} isn't complete")
    return spark.read.schema(schema).json(f"{path}/manifests/*.jsonl")


def read_frame_map(spark: SparkSession, path: str, video_id: str) -> DataFrame:
    """A CSV of (n, frame_idx, pts_time) as keyframe rows in order of frames."""
    rows = spark.read.option("header", "true").schema("n int, pts_time double, fps double, frame_idx bigint").csv(path)
    named = rows.select(F.lit(video_id).alias("video_id"), "frame_idx", "pts_time", F.lit(1).alias("__one"))
    numbered = blocked_cumsum(named, ["video_id"], ["frame_idx", "pts_time"], "__one", "row", F.floor(F.col("frame_idx") / 100_000))
    return numbered.select("video_id", "frame_idx", "pts_time", "row")


def export(tables: dict[str, DataFrame], keys: dict[str, str], path: str) -> dict[str, int]:
    """Each table as JSON lines in a folder of its own, after a check that keys are unique; and a manifest with the counts."""
    counts = {}
    for name, df in tables.items():
        if (bad := df.groupBy(keys[name]).count().where("count > 1").first()) is not None:
            raise ValueError(f"duplicate {keys[name]} in {name}: {bad[0]}")
        ordered = df.select(*sorted(df.columns))
        ordered.write.mode("overwrite").json(f"{path}/{name}")
        counts[name] = df.sparkSession.read.text(f"{path}/{name}").count()
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame(list(counts.items()), "name string, rows bigint").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return counts


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, length) of every file of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), "length")


def verify_export(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """(file, problem): files (file, sha256) that are missing, changed or unexpected."""
    now = checksums(spark, path)
    met = expected.select("file", F.col("sha256").alias("want")).join(now.select("file", "sha256"), "file", "full")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("want") != F.col("sha256"), "changed")
    return met.select("file", problem.alias("problem")).where("problem is not null")


def submission_lines(rows: DataFrame, task: str, most: int = 100) -> DataFrame:
    """(query_id, rank, line) of a submission without header: video,frame[,answer] or video,f1..fn; quoted only where needed."""

    def quoted(c):
        return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    parts = {"KIS": ["video_id", "frame_idx"], "QA": ["video_id", "frame_idx", "answer"]}.get(task)
    line = F.concat_ws(",", *[quoted(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in parts]) if parts else F.concat_ws(",", "video_id", F.array_join("frames", ","))
    return rows.where(F.col("rank") <= most).select("query_id", "rank", line.alias("line"))


def write_submission(lines: DataFrame, path: str) -> None:
    """One text file per query, its lines in order of rank."""
    lines.repartition("query_id").sortWithinPartitions("query_id", "rank").select("query_id", "line").write.mode("overwrite").partitionBy("query_id").text(path)


def merge_ledger(ledger: DataFrame, updates: DataFrame, key: str = "video_id") -> DataFrame:
    """The ledger with the rows of ``updates`` in place of those of the same key: to be written to a new folder, then swapped."""
    return ledger.join(updates.select(key), key, "left_anti").unionByName(updates)


def latest_traces(traces: DataFrame, most: int = 2000) -> DataFrame:
    """The newest traces (session_id, created_at): an append-only table seen as a bounded store."""
    return traces.orderBy(F.desc("created_at"), F.desc("session_id")).limit(most)


def safe_path(path: str) -> bool:
    """Whether a path is relative, stays inside, and has no scheme but an allowed one."""
    if "://" in path:
        return path.split("://", 1)[0] in ("s3", "gs", "hdfs", "https")
    p = PurePosixPath(path)
    return not p.is_absolute() and ".." not in p.parts
