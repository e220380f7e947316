"""Writers.  Each is one Spark write; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from belfry.sources import versions
from belfry.sources.files import path_exists


def write_json(df: DataFrame, path: str, compression: str = "none") -> None:
    """JSON lines; null fields are written, non-ASCII text is kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).option("compression", compression).json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a fixed column order as the next version of ``path``: readers see the old file set or the new one."""
    spark = df.sparkSession
    number = versions.latest(spark, path)[0]
    data = versions.fresh("csv")
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    text.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(f"{path}/{data}")
    versions.commit(spark, path, {"dir": data}, number)


def drop_dir(spark: SparkSession, path: str) -> bool:
    """Delete a table directory we own; says whether it was there."""
    existed = path_exists(spark, path)
    if existed:
        fs_path = spark._jvm.org.apache.hadoop.fs.Path
        fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs_path(path), True)
    return existed


def write_lines(df: DataFrame, path: str, order: list, line: Column | str = "line", compression: str = "none") -> None:
    """A text file of ``line``, sorted across files by ``order``; an expression is computed where its row is sorted to."""
    df.orderBy(*order).select(line).write.mode("overwrite").option("compression", compression).text(path)


def append_cache(results: DataFrame, cache: DataFrame, path: str) -> None:
    """Add results (classifier, version, content_hash, result) that the cache lacks, once each."""
    keys = ["classifier", "version", "content_hash"]
    fresh = (results.where(F.col("content_hash") != "").groupBy(*keys).agg(F.any_value("result").alias("result"))
             .join(cache.select(*keys), keys, "left_anti"))
    fresh.write.partitionBy("classifier", "version").mode("append").parquet(path)
