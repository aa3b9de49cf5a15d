"""Streams: fixed-window counters, incremental reads with stored marks, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators.cdc import numbered


def window_start(at: Column, seconds: int) -> Column:
    """The start of the fixed window that holds a time."""
    return F.timestamp_seconds(F.floor(F.unix_timestamp(at) / seconds) * seconds)


def fixed_windows(hits: DataFrame, key: str, at: str, seconds: int, watermark: str | None = None) -> DataFrame:
    """(key, window_start, n): hits per key and window, of a table or of a stream (with a watermark)."""
    if watermark:
        hits = hits.withWatermark(at, watermark)
    grouped = hits.groupBy(key, F.window(at, f"{seconds} seconds"))
    return grouped.agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("window_start"), "n")


def limited(hits: DataFrame, key: str, at: str, order: str, seconds: int, most: int) -> DataFrame:
    """Hits with their number in their window and whether the limit admits them. A hit whose clock
    lies before the current window, in arrival order, counts in the current one."""
    arrival = Window.partitionBy(key).orderBy(order)
    current = F.max(window_start(F.col(at), seconds)).over(arrival.rowsBetween(Window.unboundedPreceding, 0))
    rows = hits.withColumn("window_start", current)
    number = F.row_number().over(Window.partitionBy(key, "window_start").orderBy(order))
    return rows.withColumn("n", number).withColumn("admitted", F.col("n") <= most)


def changes_since(rows: DataFrame, at: str, mark, overlap_seconds: int = 3600) -> DataFrame:
    """Rows after a stored mark less an overlap; everything without a mark."""
    return rows if mark is None else rows.where(F.col(at) >= F.lit(mark).cast("timestamp") - F.expr(f"INTERVAL {int(overlap_seconds)} SECONDS"))


def advanced_marks(marks: DataFrame, passes: DataFrame) -> DataFrame:
    """(place, mark) after passes (place, started_at, finished): only finished ones move a mark, forward."""
    new = passes.where("finished").groupBy("place").agg(F.max("started_at").alias("__new"))
    return marks.join(new, "place", "full_outer").select("place", F.greatest("mark", "__new").alias("mark"))


def until_known(found: DataFrame, order: str, known: str, run: int) -> DataFrame:
    """Newest-first rows up to where ``run`` known ones in a row have been seen; all if they never are.
    Rows are numbered by ranges; a run ends where so many known ones before it count for it."""
    rows = numbered(found, "__k", F.col(order))
    ends = rows.where(known).select(F.explode(F.sequence(F.col("__k"), F.col("__k") + run - 1)).alias("end"))
    stop = ends.groupBy("end").agg(F.count("*").alias("n")).where(F.col("n") == run).agg(F.min("end").alias("__stop"))  # one row
    read = rows.crossJoin(F.broadcast(stop)).where(F.col("__stop").isNull() | (F.col("__k") <= F.col("__stop")))
    return read.drop("__k", "__stop")


def ledger_totals(entries: DataFrame) -> DataFrame:
    """(counted, settled, open): items of a reserve-and-settle ledger (kind, request_id, items); a
    reservation that has been settled counts as settled."""
    settled = entries.where("kind = 'settle'").select("request_id").distinct()
    reserved = entries.where("kind = 'reserve'").join(settled, "request_id", "left_anti")
    sums = lambda df, kinds, name: df.where(F.col("kind").isin(*kinds)).agg(F.coalesce(F.sum("items"), F.lit(0)).alias(name))
    out = sums(entries, ["count", "legacy"], "counted").crossJoin(sums(entries, ["settle"], "settled"))
    return out.crossJoin(sums(reserved, ["reserve"], "open"))


def append_changes(spark: SparkSession, source: DataFrame, keys: list[str], sink: str, checkpoint: str, by: str | None = None):
    """Writes a stream to a parquet log once per key and content, whatever is delivered twice: each batch
    is held against the log before it is appended. With ``by``, a column that is one of the key's and
    the same whenever a row is delivered, such as its day, the log is partitioned by it and only the
    partitions that a batch touches are read."""
    from pyspark.errors import AnalysisException

    def put(batch: DataFrame, _: int) -> None:
        batch = batch.dropDuplicates(keys)
        try:
            seen = spark.read.schema(batch.schema).parquet(sink)
        except AnalysisException as e:  # the log doesn't exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            if by is not None:
                touched = [r[0] for r in batch.select(by).distinct().collect()]  # few: a batch spans few days
                seen = seen.where(F.col(by).isin(touched))
            batch = batch.join(seen.select(*keys), keys, "left_anti")
        out = batch.write.mode("append")
        (out.partitionBy(by) if by else out).parquet(sink)

    return source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
