"""Tables that Spark has written: steps of a long plan in the folder that all machines see, and named tables that are worked out once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Table properties: of what source a cached table was made, and the folder it was in before.
SOURCE, BEFORE = "tradeframe.source", "tradeframe.before"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where none is set, a new local one, which only a local session can use."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines see")
        named = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Whether Spark deletes a query's shuffle files as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_once(df: DataFrame, path: str) -> None:
    """Write rows as Parquet. Their plan won't run again, so its shuffle files go when it has ended, and not only once the
    driver has forgotten the plan: a chain of such tables would fill the disks with the files of steps long done."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once as Parquet in the shared folder: lineage ends there, and what a plan draws or deals by
    chance stays as it was first drawn."""
    path = scratch(df.sparkSession, name)
    write_once(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path with the file system that Spark has for it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def files_version(df: DataFrame) -> str:
    """What tells the files that a scan reads from others: their number, and a digest of paths, sizes and times. Only the
    files' metadata is read, no column."""
    files = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("at")).distinct()
    n, digest = files.agg(F.count("*"), F.bit_xor(F.xxhash64("path", "size", "at"))).first()
    return f"{n}:{digest or 0}"


def cache_table(df: DataFrame, name: str, folder: str, version: str | None = None) -> DataFrame:
    """The table `name` of the catalogue with these rows. Where it is there already and was made of the same version of its
    source, it is read as it is and nothing is worked out.

    The rows go to a new folder first; then the catalogue's entry is pointed to it in one step, so a reader sees the old
    table or the new one, and a job that fails leaves the old one. The folder before stays for those who still read it,
    until the table is made anew once more. A table of other columns is dropped and made again. Rows without a version are
    always worked out."""
    spark = df.sparkSession
    there = spark.catalog.tableExists(name)
    held = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()} if there else {}
    if there and version is not None and held.get(SOURCE) == version:
        return spark.table(name)
    path = f"{folder.rstrip('/')}/{name.replace('.', '/')}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    quoted = (version or "").replace("\\", "\\\\").replace("'", "\\'")
    plain = lambda schema: [(f.name, f.dataType.simpleString()) for f in schema]
    if there and plain(spark.table(name).schema) == plain(df.schema):
        now = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").first().data_type
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{SOURCE}' = '{quoted}', '{BEFORE}' = '{now}')")
        if held.get(BEFORE):
            remove(spark, held[BEFORE])
    else:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.catalog.createTable(name, path, "parquet", df.schema)
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{SOURCE}' = '{quoted}')")
    spark.catalog.refreshTable(name)
    return spark.table(name)
