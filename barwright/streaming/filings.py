"""Polling of landed filings as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from barwright.operators.filings import filings, submissions
from barwright.session import run_folder

KEY = ["accession_number", "cik"]


def landed_documents(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of JSON documents, one per line."""
    reader = spark.readStream.schema("value string").format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).select(F.col("value").alias("doc"))


def filing_stream(docs: DataFrame) -> DataFrame:
    rows = filings(submissions(docs))
    return rows.withColumn("filed_at", F.to_timestamp("filing_date"))


def without_repeats(rows: DataFrame, late: str | None = None, stamp: str = "filed_at") -> DataFrame:
    """Drop re-delivered filings. State is bounded by a watermark when ``late`` is given."""
    if late:
        return rows.withWatermark(stamp, late).dropDuplicatesWithinWatermark(KEY)
    return rows.dropDuplicates(KEY)


def above_mark(rows: DataFrame) -> DataFrame:
    """Keep filings whose accession passes the largest seen for their company.

    Needs files to arrive in accession order: a late filing with a smaller accession
    is lost. The state is one string per company.
    """
    columns = [f.name for f in rows.schema.fields]

    def run(key, batches, state):
        import pandas as pd

        mark = state.get[0] if state.exists else ""
        frames = list(batches)
        if not frames:
            return
        df = pd.concat(frames).sort_values("accession_number", kind="stable")
        fresh = df[df["accession_number"] > mark].drop_duplicates("accession_number")
        if len(fresh):
            state.update((fresh["accession_number"].iloc[-1],))
        yield fresh[columns]

    from pyspark.sql.streaming.state import GroupStateTimeout

    return rows.groupBy("cik").applyInPandasWithState(
        run, rows.schema, T.StructType([T.StructField("mark", T.StringType())]), "append", GroupStateTimeout.NoTimeout
    )


def append_new(path: str, stored: str | None = None):
    """Sink for ``foreachBatch``: each batch goes to a folder of its own number.

    Filings that ``stored`` or an earlier batch holds are left out, so no state has to
    remember them. A batch that is run again after a failure replaces its own folder, so
    rows are stored once.
    """

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(KEY)
        reader = batch.sparkSession.read
        if stored:
            fresh = fresh.join(reader.schema(batch.schema).parquet(stored).select(*KEY), KEY, "left_anti")
        if number:
            earlier = reader.schema(T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
            fresh = fresh.join(earlier.filter(F.col("batch") < number).select(*KEY), KEY, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def poll(rows: DataFrame, target: str, state: str, every: str | None = None, stored: str | None = None):
    """Start the poll: ``every`` such as ``'600 seconds'`` keeps it running, None drains once."""
    writer = rows.writeStream.foreachBatch(append_new(target, stored)).option("checkpointLocation", state).outputMode("append")
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def order_filings(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"),
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("accession_number"),
        F.to_date("o_orderdate").alias("filing_date"),
    )


def drain_orders(spark: SparkSession, sf_dir: str, stored: str | None = None) -> DataFrame:
    """Poll the orders as filings once and read back what was stored."""
    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    rows = order_filings(raw)
    run = run_folder(spark, "poll")
    # Each batch is held against what is stored; nothing grows in the stream's own state.
    query = poll(rows, f"{run}/rows", f"{run}/state", stored=stored)
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{run}/rows").select(*rows.columns)
