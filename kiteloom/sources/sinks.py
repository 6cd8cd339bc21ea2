"""Sinks: new table contents as DataFrames, and writers that commit as a whole."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Tasks a core that write a file a row.
TASKS = 4


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows of keys that ``new`` lacks, with all of ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def not_loaded(rows: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in the loaded table yet."""
    return rows.join(loaded.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def export_rows(rows: DataFrame, columns: dict[str, str | None], constants: dict[str, str]) -> DataFrame:
    """Named string columns in order, null and absent as blank, then constants."""
    picked = [(F.coalesce(F.col(c).cast("string"), F.lit("")) if c else F.lit("")).alias(k) for k, c in columns.items()]
    return rows.select(*picked, *[F.lit(v).alias(k) for k, v in constants.items()])


def write_csv(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    """CSV with a header and a fixed order of columns; missing values are blank.

    Spark's committer publishes the folder's files together when the job is done.
    """
    have = set(rows.columns)
    out = rows.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")).alias(c) for c in columns])
    out.write.mode("overwrite").csv(path, header=True, emptyValue="", escape='"')


def write_each(rows: DataFrame, path: str, column: str) -> None:
    """A file a row, with the row's text.

    A file costs far more than its row, so rows are dealt over all cores however few
    partitions they come in.
    """
    dealt = rows.select(F.col(column).alias("value")).repartition(TASKS * rows.sparkSession.sparkContext.defaultParallelism)
    dealt.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def write_json_arrays(rows: DataFrame, path: str, size: int = 5000) -> None:
    """Files of one JSON array each, of about ``size`` rows."""
    number = rows.agg(F.greatest(F.ceil(F.count(F.lit(1)) / size), F.lit(1)).alias("_n"))  # one row
    dealt = rows.crossJoin(F.broadcast(number)).select(F.struct(*rows.columns).alias("row"), F.pmod(F.xxhash64(*rows.columns), F.col("_n")).alias("part"))
    write_each(dealt.groupBy("part").agg(F.to_json(F.collect_list("row")).alias("array")), path, "array")


def write_pages(rows: DataFrame, send: Callable[[list[dict]], None], size: int = 500) -> None:
    """Send rows to a service in pages of ``size``, from every partition by itself."""

    def run(part) -> None:
        page: list[dict] = []
        for row in part:
            page.append(row.asDict(recursive=True))
            if len(page) == size:
                send(page)
                page = []
        if page:
            send(page)

    rows.foreachPartition(run)
