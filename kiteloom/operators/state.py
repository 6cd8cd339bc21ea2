"""State transitions as functions from a table and its changes to the new table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, changes: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """The union with one row a key: the change with the last ``seq``, else the base row.

    One aggregation by key; ties of ``seq`` go to the greater row.
    """
    values = [c for c in base.columns if c not in key]
    old = base.withColumn("order", F.struct(F.lit(0).alias("side"), F.lit(0).cast("long").alias("seq")))
    new = changes.withColumn("order", F.struct(F.lit(1).alias("side"), F.col(seq).cast("long").alias("seq")))
    both = old.select(*base.columns, "order").unionByName(new.select(*base.columns, "order"))
    row = F.max_by(F.struct(*values), F.struct("order", *values)).alias("row")
    return both.groupBy(*key).agg(row).select(*key, "row.*")


def upsert_owned(base: DataFrame, changes: DataFrame, key: str, owned: Sequence[str]) -> DataFrame:
    """Insert or update only ``owned`` columns; the others keep the base's values."""
    new = changes.select(F.col(key), *[F.col(c).alias(f"new_{c}") for c in owned])
    both = base.join(new, key, "full_outer")
    return both.select(key, *[F.coalesce(f"new_{c}", c).alias(c) if c in owned else F.col(c) for c in base.columns if c != key])


def mark_used(rows: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Rows named in ``used`` become freshly used once more."""
    flag = used.select(key).distinct().withColumn("hit", F.lit(True))
    both = rows.join(flag, key, "left")
    return both.withColumns({
        "used_ago": F.when(F.col("hit"), F.lit(0)).otherwise(F.col("used_ago")),
        "use_count": F.col("use_count") + F.when(F.col("hit"), 1).otherwise(0),
    }).drop("hit")


def mark_used_or_insert(rows: DataFrame, used: DataFrame, key: Sequence[str]) -> DataFrame:
    """As ``mark_used``, with a row of its own for what had none."""
    flag = used.select(*key).distinct().withColumn("hit", F.lit(True))
    both = rows.join(flag, list(key), "full_outer")
    return both.withColumns({
        "used_ago": F.when(F.col("hit"), F.lit(0)).otherwise(F.col("used_ago")),
        "use_count": F.coalesce("use_count", F.lit(0)) + F.when(F.col("hit"), 1).otherwise(0),
    }).drop("hit")


def advance(rows: DataFrame, span: int = 5) -> DataFrame:
    """Age every used row by one; beyond ``span`` it is eligible (null) again."""
    return rows.withColumn("used_ago", F.when(F.col("used_ago") + 1 <= span, F.col("used_ago") + 1))


def status_times(status: Column, at: Column, seen: Column, applied: Column, link: Column, new_link: Column) -> tuple[Column, Column, Column]:
    """Seen and applied times and the link after a change of status at ``at``.

    "applied" sets both times, and the link if there is a new one; "skipped" sets the seen
    time; "new" clears all three; other statuses change nothing.
    """
    clear = status == "new"
    new_seen = F.when(clear, F.lit(None)).when(status.isin("applied", "skipped"), at).otherwise(seen)
    new_applied = F.when(clear, F.lit(None)).when(status == "applied", at).otherwise(applied)
    links = F.when(clear, F.lit(None)).when((status == "applied") & (F.coalesce(new_link, F.lit("")) != ""), new_link).otherwise(link)
    return new_seen, new_applied, links


#: The progress that a stage stands for, and statuses after which a job does nothing more.
STAGE_PROGRESS = {"extract": 10, "generate": 20, "review": 55, "generate_explanations": 70, "answer_key": 75, "solutions": 75, "build": 85}
TERMINAL = ("DONE", "FAILED", "TIMEOUT", "CANCELLED", "EXPIRED")


def job_lifecycle(changes: DataFrame, job: str, order: Sequence[str], at: str) -> DataFrame:
    """Add ``progress`` and ``finished_at`` after each change of a job (columns status, stage, progress).

    Progress never falls: it is the largest so far of 100 for DONE, else the change's own
    progress within 0..100, else its stage's. The first terminal status finishes a job.
    """
    stages = F.create_map(*[F.lit(x) for kv in STAGE_PROGRESS.items() for x in kv])
    own = F.when(F.col("progress").isNotNull(), F.least(F.greatest(F.col("progress"), F.lit(0)), F.lit(100)))
    step = F.when(F.upper("status") == "DONE", F.lit(100)).otherwise(F.coalesce(own, F.try_element_at(stages, F.lower("stage")), F.lit(0)))
    upto = Window.partitionBy(job).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ended = F.when(F.upper("status").isin(*TERMINAL), F.col(at))
    return changes.withColumns({"progress": F.max(step).over(upto).cast("int"), "finished_at": F.first(ended, ignorenulls=True).over(upto)})


def expired(jobs: DataFrame, now: Column, kept: Column) -> DataFrame:
    """Jobs past their ``expires_at``, or ``kept`` after ``created_at`` without one: status, no outputs, and why."""
    gone = (F.col("status") == "EXPIRED") | (now > F.coalesce("expires_at", F.col("created_at") + kept))
    gone = F.coalesce(gone, F.lit(False))
    return jobs.withColumns({
        "status": F.when(gone, "EXPIRED").otherwise(F.col("status")), "outputs": F.when(gone, F.array().cast("array<string>")).otherwise(F.col("outputs")),
        "error": F.when(gone, "Generated files expired.").otherwise(F.col("error")),
    })
