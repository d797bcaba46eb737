"""Readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .writers import NULL, RECORD_END, csv_options


def _ours(spark: SparkSession, path: str) -> bool:
    """Whether the first file that holds anything ends with the record end of our own files; a folder without such a file counts as ours."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in system.globStatus(top) or []:
        for file in system.listStatus(found.getPath()):
            if file.isFile() and file.getLen() and file.getPath().getName()[0] not in "._":
                stream = system.open(file.getPath())
                try:
                    stream.seek(file.getLen() - 1)
                    return stream.read() == ord(RECORD_END)
                finally:
                    stream.close()
    return True


def read_csv(
    spark: SparkSession, path: str, schema: str, header: bool = False, line_end: str | None = RECORD_END, null: str = NULL
) -> DataFrame:
    """Typed CSV; a doubled quote inside quotes is a quote, blanks around values are kept.

    Files of other writers are read with ``line_end=None``, where records are lines, and ``null=""``. Files that
    don't end with our record end are read by lines in any case.
    """
    if line_end == RECORD_END and not _ours(spark, path):
        line_end = None
    return spark.read.schema(schema).options(header=header, **csv_options(line_end, null)).csv(path)


def read_csv_strings(spark: SparkSession, path: str, types: dict[str, str]) -> DataFrame:
    """CSV with a header read as strings, then cast; dirty numbers become null."""
    raw = read_csv(spark, path, ", ".join(f"{c} string" for c in types), header=True)
    return raw.select(*[F.col(c).try_cast(t).alias(c) for c, t in types.items()])


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_parquet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """One word per line in Latin-1, line ends of either kind; trimmed, distinct."""
    lines = (
        spark.read.schema("token string")
        .option("encoding", "ISO-8859-1")
        .option("sep", "\t")
        .option("quote", "")
        .csv(path)
    )
    return lines.select(F.trim("token").alias("token")).where("token <> ''").distinct()


def numbered(scan: DataFrame) -> DataFrame:
    """The rows of a file scan with ``index``, counted from 1 in file and line order.

    The rows do not move: the input splits are counted, and every row adds its place within its
    split to the number of rows in the splits before. The table of splits has one small row per
    input split and the planner decides by its size whether to broadcast it.
    """
    rows = scan.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    splits = rows.groupBy("_file", "_start").agg(
        F.min("_id").alias("_first"), F.count("*").alias("_n")
    )
    earlier = Window.partitionBy(F.lit(0)).orderBy("_file", "_start").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = splits.select(
        "_file", "_start", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    place = F.col("_before") + F.col("_id") - F.col("_first") + 1
    return rows.join(offsets, ["_file", "_start"]).select(place.alias("index"), *scan.columns)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(index, value): the numbered lines of a text file or folder."""
    return numbered(spark.read.text(path))


def read_label_file(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A keyless one-column label file; the key is the line number."""
    lines = read_lines(spark, path)
    return lines.select("index", F.trim("value").try_cast("int").alias(name))


def read_vector_text(spark: SparkSession, path: str) -> DataFrame:
    """(index, vec): one vector per line, blank-separated."""
    parts = F.split(F.trim("value"), " +")
    return read_lines(spark, path).select(
        "index", F.transform(parts, lambda x: x.cast("double")).alias("vec")
    )
