"""Roll-ups over checkpoints, events and plan reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def status_rollup(checkpoints: DataFrame) -> DataFrame:
    """Per session: tables, finished tables, rows, latest change and the status that the command line shows."""
    bad, done = F.count_if(F.col("status") == "error"), F.count_if(F.col("status") == "done")
    status = F.when(F.col("n_error") > 0, "error").when(F.col("tables_done") == F.col("tables_total"), "done").when(F.col("n_started") > 0, "in_progress").otherwise("created")
    return (
        checkpoints.groupBy("session_id")
        .agg(
            F.count("*").alias("tables_total"), done.alias("tables_done"), bad.alias("n_error"), F.count_if(F.col("status") != "pending").alias("n_started"),
            F.sum("last_offset").alias("rows_done"), F.sum("row_count").alias("rows_total"), F.max("updated_at").alias("updated_at"),
            F.min(F.when(F.col("status") == "error", F.struct("table_name", "error_message")))["error_message"].alias("first_error"),
        )
        .withColumn("status", status)
        .drop("n_error", "n_started")
    )


def session_rollup(checkpoints: DataFrame, events: DataFrame) -> DataFrame:
    """The same with the last event's say: an error that came last makes the session an error, a finish makes it done."""
    last = latest_event(events).select("session_id", F.col("level").alias("last_level"), F.col("message").alias("last_message"))
    out = status_rollup(checkpoints).join(last, "session_id", "left")
    status = F.when(F.col("last_level") == "error", "error").when((F.col("last_level") == "done") & (F.col("status") != "error"), "done").otherwise(F.col("status"))
    return out.withColumn("status", status).withColumn("first_error", F.coalesce("first_error", F.when(F.col("last_level") == "error", F.col("last_message")))).drop("last_level", "last_message")


def latest_event(events: DataFrame) -> DataFrame:
    """Each session's event with the largest id, by an aggregate."""
    cols = [c for c in events.columns if c != "session_id"]
    return events.groupBy("session_id").agg(F.max_by(F.struct(*cols), "id").alias("e")).select("session_id", "e.*")


def tail(events: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The last ``n`` events in rising order. Filter to a session first: ids are shared by all."""
    return events.orderBy(F.desc(order)).limit(n).orderBy(order)


def after(events: DataFrame, last_id: int, page: int = 500, order: str = "id") -> DataFrame:
    """A page of the log after an id."""
    return events.filter(F.col(order) > last_id).orderBy(order).limit(page)


def running_progress(batches: DataFrame, table: str = "table_name", order: str = "batch_no", n: str = "n") -> DataFrame:
    """Rows loaded up to each batch of a table."""
    return batches.withColumn("rows_done", F.sum(n).over(Window.partitionBy(table).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def plan_totals(report: DataFrame) -> DataFrame:
    """Issues of every level, the manual items as the report counts them, and all manual items."""
    manual = F.col("severity") == "manual"
    counted = manual & F.col("kind").isin("view", "function", "trigger", "fk_source_missing")
    return report.agg(F.count_if(F.col("severity") == "issue").alias("issues"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(counted).alias("manual_items"), F.count_if(manual).alias("manual_all"))


def throughput(rows: int, seconds: float) -> float:
    return rows / seconds if seconds > 0 else 0.0
