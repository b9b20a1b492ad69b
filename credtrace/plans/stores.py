"""Stored tables by scan, in committed versions.

A write puts its rows beside what is there, with a list of the scans that it covers, and then names itself in ``commits``: one
empty file, whose creation is the only step that readers see. Of a scan they see the version of the last commit that covers it,
whole; a write that ends half-way has no commit and is never seen. A scan that is covered and has no rows has none from then on.

    <table>/data/version=<v>/scan=<s>/...    rows        <table>/listings/<v>/...    covered scans and the schema of the rows
    <table>/commits/<number>-<v>             empty files
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

LISTING = "scan_id string, version string, fields string"


def _path(spark: SparkSession, path: str):
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def commits(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, version) of the commits, in their order; two writers that took the same number are ordered by version."""
    system, folder = _path(spark, f"{path}/commits")
    if not system.exists(folder):
        return []
    names = [f.getPath().getName() for f in system.listStatus(folder)]
    return sorted((int(number), version) for number, _, version in (n.partition("-") for n in names) if version)


def prepare(rows: DataFrame, path: str, covered: DataFrame | None = None) -> str:
    """Write the rows of a version and the scans that it covers (those of the rows, if not given); the version is not committed yet.

    Rows are gathered by scan first, a huge scan is split. The partition column repeats scan_id with a letter before it, so that no
    reader takes it for a number.
    """
    spark, version = rows.sparkSession, uuid.uuid4().hex
    (rows.withColumn("scan", F.concat(F.lit("s"), "scan_id")).hint("rebalance", "scan_id").write.partitionBy("scan")
     .parquet(f"{path}/data/version={version}"))
    schema = rows.schema
    if covered is None:
        scans = _data(spark, path, schema, version).select("scan_id").distinct()
    else:
        scans = covered.select("scan_id").distinct()
    # The row without a scan tells the schema, also where a version has no rows.
    listed = scans.select("scan_id", F.lit(version).alias("version"), F.lit(None).cast("string").alias("fields")).unionByName(
        spark.createDataFrame([(None, version, schema.json())], LISTING))
    listed.write.parquet(f"{path}/listings/{version}")
    return version


def commit(spark: SparkSession, path: str, version: str) -> None:
    """Let readers see a prepared version."""
    number = max((n for n, _ in commits(spark, path)), default=0) + 1
    system, name = _path(spark, f"{path}/commits/{number:020d}-{version}")
    system.create(name, False).close()


def write(rows: DataFrame, path: str, covered: DataFrame | None = None) -> None:
    commit(rows.sparkSession, path, prepare(rows, path, covered))


def _data(spark: SparkSession, path: str, schema: StructType, version: str | None = None) -> DataFrame:
    """Rows of all versions, or of one."""
    folder = f"{path}/data" if version is None else f"{path}/data/version={version}"
    system, hadoop = _path(spark, folder)
    full = StructType([*schema.fields, StructField("scan", StringType()), StructField("version", StringType())])
    if not system.exists(hadoop):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", f"{path}/data").parquet(folder)


def current(spark: SparkSession, path: str) -> DataFrame:
    """(scan_id, version): the version that counts for each scan."""
    done = commits(spark, path)
    if not done:
        return spark.createDataFrame([], "scan_id string, version string")
    order = spark.createDataFrame(done, "number long, version string")
    listed = spark.read.schema(LISTING).parquet(*[f"{path}/listings/{v}" for _, v in done]).where("scan_id IS NOT NULL")
    # As many rows as commits.
    return listed.join(F.broadcast(order), "version").groupBy("scan_id").agg(F.max(F.struct("number", "version")).alias("last")).select(
        "scan_id", "last.version")


def read(spark: SparkSession, path: str, scan_id: str | None = None) -> DataFrame:
    """The rows of all scans, or of one, whose partition alone is read then. Columns are those of the last commit."""
    done = commits(spark, path)
    if not done:
        raise FileNotFoundError(f"nothing is committed in {path}")
    last = spark.read.schema(LISTING).parquet(f"{path}/listings/{done[-1][1]}").where("scan_id IS NULL").first()["fields"]
    schema = StructType.fromJson(json.loads(last))
    versions = current(spark, path)
    if scan_id is not None:
        found = versions.where(F.col("scan_id") == scan_id).first()
        rows = _data(spark, path, schema, found["version"] if found else done[-1][1])
        return rows.where((F.col("scan") == "s" + scan_id) if found else F.lit(False)).select(*schema.names)
    rows = _data(spark, path, schema)
    return rows.join(versions, ["scan_id", "version"]).select(*schema.names)


def discard_superseded(spark: SparkSession, path: str) -> int:
    """Delete the versions that no scan's current rows are in, those never committed included; no write may run meanwhile."""
    kept = {r["version"] for r in current(spark, path).select("version").distinct().collect()} | {v for _, v in commits(spark, path)[-1:]}
    system, listings = _path(spark, f"{path}/listings")
    gone = [f.getPath().getName() for f in system.listStatus(listings) if f.getPath().getName() not in kept]
    for version in gone:
        for number, v in commits(spark, path):
            if v == version:
                system.delete(_path(spark, f"{path}/commits/{number:020d}-{v}")[1], False)
        for folder in (f"{path}/listings/{version}", f"{path}/data/version={version}"):
            system.delete(_path(spark, folder)[1], True)
    return len(gone)
