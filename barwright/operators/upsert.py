"""Merges of a batch into stored rows, as DataFrames and as partition rewrites.

Every merge is one pass over the rows of a key in order, or an equi-join on the key that
Spark may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def keep_one(df: DataFrame, keys: list[str], order: list[str], last: bool = True) -> DataFrame:
    """The last (or first) row of each key in the given order.

    One shuffle on the key and one sort behind it: the row before which none stands is
    kept. Structs and strings have no fixed-width aggregation buffer, so a max_by would
    sort the whole feed on both sides of the shuffle. NULL keys count as a value of their
    own; NULLs in the order come first going up and last going down, as they do in max_by.
    """
    ranked = [F.col(c).desc_nulls_last() if last else F.col(c).asc_nulls_first() for c in order]
    spec = Window.partitionBy(*keys).orderBy(*ranked)
    return df.withColumn("_before", F.lag(F.lit(1)).over(spec)).filter("_before IS NULL").select(*df.columns)


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[k])
    return on


def upsert_bars(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Batch rows enter where the key is absent, or where the stored volume is 0 and theirs is not.

    ``batch`` has one row per key; see :func:`fold_bars` for a batch with repeats.
    """
    keys = ["symbol", "date"]
    values = [c for c in stored.columns if c not in keys]
    s = stored.select(*keys, F.struct(*values).alias("s"))
    b = batch.select(*keys, F.struct(*values).alias("b"))
    both = s.join(b, keys, "full_outer")
    take = F.col("s").isNull() | (F.col("b").isNotNull() & (F.col("s.volume") == 0) & (F.col("b.volume") > 0))
    return both.select(*keys, F.when(take, F.col("b")).otherwise(F.col("s")).alias("r")).select(*keys, "r.*").select(
        *stored.columns
    )


def fold_bars(batch: DataFrame, order: list[str]) -> DataFrame:
    """One row per key, as if the rows had been upserted one by one in ``order``.

    The first row of a key wins, unless its volume is 0 and a later row trades; then
    the first trading row wins.
    """
    df = batch.withColumn("_idle", F.col("volume") <= 0)
    return keep_one(df, ["symbol", "date"], ["_idle", *order], last=False).drop("_idle", *order)


def overwrite(stored: DataFrame, batch: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Batch rows replace stored rows of the same key; the last of a batch wins."""
    order = order or []
    cols = stored.columns
    old = stored.select(*cols, F.lit(0).alias("_from"))
    new = batch.select(*cols, F.lit(1).alias("_from"))
    return keep_one(old.unionByName(new), keys, ["_from", *order]).drop("_from")


def insert_absent(stored: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Batch rows whose key is not stored, first of the batch winning; NULLs match NULLs."""
    first = keep_one(batch, keys, order, last=False)
    return first.join(stored, null_safe(first, stored, keys), "left_anti")


def update_by_key(stored: DataFrame, changes: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Set ``fields`` of stored rows where a change gives a value."""
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in fields])
    out = stored.join(new, keys, "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in stored.columns])


def delete_by_key(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(gone.select(*keys), keys, "left_anti")


def latest_wins(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Concatenate in order and keep the last part that has a key."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("_part", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return keep_one(out, keys, ["_part"]).drop("_part")


def save_bars(bars: DataFrame, path: str) -> None:
    """Write the panel partitioned by year, replacing only the years present in ``bars``.

    Rows of one year are spread over symbol, so no writer holds a whole year.
    """
    (
        bars.withColumn("year", F.year("date"))
        .repartition("year", "symbol")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year")
        .parquet(path)
    )


def merge_bars(spark: SparkSession, path: str, batch: DataFrame, target: str) -> DataFrame:
    """Upsert ``batch`` into the stored panel at ``path`` and write the result to ``target``.

    Written to a new folder, so a lost executor or a failed job leaves the old one whole.
    """
    stored = spark.read.parquet(path).drop("year")
    save_bars(upsert_bars(stored, batch), target)
    return spark.read.parquet(target).drop("year")


def json_records(df: DataFrame, column: str = "record") -> DataFrame:
    """Rows as JSON text with NaN and infinities as null."""
    from barwright.functions.series import finite

    cols = [finite(F.col(n)).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias(column))


def without_nan(df: DataFrame) -> DataFrame:
    """NaN to NULL in double columns and inside arrays of doubles."""
    cols = []
    for n, t in df.dtypes:
        c = F.col(n)
        if t in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        elif t in ("array<double>", "array<float>"):
            c = F.transform(c, lambda x: F.when(~F.isnan(x), x))
        cols.append(c.alias(n))
    return df.select(*cols)
