"""CSV and JSON readers and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.formats import csv_line

_CSV = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one in the warehouse only where none is set (tests)."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted fields, doubled quotes, line ends within quotes; rows that do not fit the schema and rows without any value are dropped."""
    return spark.read.options(**_CSV).option("mode", "DROPMALFORMED").schema(schema).csv(path).na.drop("all")


def write_csv(df: DataFrame, path: str, metadata: dict[str, str] | None = None) -> None:
    """Values are quoted only where they need it; metadata goes beside the rows, as a folder of `# key: value` lines."""
    df.write.options(**_CSV).csv(path)
    if metadata:
        lines = [(f"# {k}: {v}",) for k, v in metadata.items()]
        df.sparkSession.createDataFrame(lines, "value string").coalesce(1).write.text(f"{path}_metadata")


def export_lines(df: DataFrame, key: str, columns: list[str], order: list[str], title: str) -> DataFrame:
    """A file's lines for each value of key (key, place, line): the title, the key, the number of rows and an empty remark, a header, then the
    rows in order. Only counts are joined to the rows; a key's rows are numbered together."""
    heads = df.groupBy(key).agg(F.count("*").alias("n"))
    head = F.array(F.lit(f"# {title}"), F.concat(F.lit(f"# {key}: "), F.coalesce(F.col(key).cast("string"), F.lit(""))), F.concat(F.lit("# total_attempts: "), "n"), F.lit("#"), F.lit(",".join(columns)))
    heads = heads.select(key, F.posexplode(head).alias("place", "line"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order)) + 4
    return heads.unionByName(df.select(key, place.alias("place"), csv_line(*[F.col(c) for c in columns]).alias("line")))


def write_lines(lines: DataFrame, key: str, path: str) -> None:
    """Lines (key, place, line) as a folder of text files, one folder a key and its lines in order."""
    lines.repartition(key).sortWithinPartitions(key, "place").select(key, "line").write.partitionBy(key).text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def written(df: DataFrame) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back: later steps plan only the scan, and lost executors lose nothing of it."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
