"""Writers. They write as many files as there are partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: The end of a record and the mark of a null in CSV files, signs that no text may hold or be: so line
#: breaks stay inside values, files stay splittable, and an empty text is no null.
RECORD_END, NULL = "\x1e", "\x1f"


def csv_options(line_end: str | None = RECORD_END, null: str = NULL) -> dict[str, object]:
    """Options common to reading and writing."""
    options = {
        "escape": '"',
        "nullValue": null,
        "emptyValue": "",
        "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
    }
    return options | ({"lineSep": line_end} if line_end else {})


def _checked(df: DataFrame) -> DataFrame:
    """Texts that would be read back as something else stop the job."""
    texts = [c for c, kind in df.dtypes if kind == "string"]
    bad = lambda c: F.col(c).contains(RECORD_END) | (F.col(c) == NULL)
    error = F.raise_error(F.lit("a text holds the CSV record end or is the mark of a null"))
    return df.withColumns({c: F.when(bad(c), error).otherwise(F.col(c)) for c in texts})


def write_csv(
    df: DataFrame, path: str, header: bool = True, sort: str | None = None, files: int | None = None
) -> None:
    """CSV with doubled quotes; optionally in key order across and within the files."""
    if sort:
        df = df.repartitionByRange(files, sort) if files else df.repartitionByRange(sort)
        df = df.sortWithinPartitions(sort)
    elif files:
        df = df.coalesce(files)
    _checked(df).write.options(header=header, quoteAll=True, **csv_options()).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def write_lines(df: DataFrame, value, key: str, path: str, line_end: str = "\n") -> None:
    """One text line per row, in key order across the files."""
    ordered = df.repartitionByRange(key).sortWithinPartitions(key)
    ordered.select(value.alias("value")).write.option("lineSep", line_end).text(path)


def write_vector_text(df: DataFrame, vec: str, key: str, path: str) -> None:
    """Blank-separated numbers, one vector per line, in key order."""
    write_lines(df, F.array_join(F.transform(vec, lambda x: x.cast("string")), " "), key, path)
