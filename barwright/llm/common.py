"""What several operators share: reading, cutting lineage, words, components of a graph of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barwright.session import run_folder, shared_folder

# The white space of the contracts: the ASCII space and the five controls 0x09-0x0D.
SPACE = "[\\x20\\x09-\\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is to be shuffled and merged, however small Spark takes it for.

    What an explode or an aggregate yields is sized by the file it comes from, and so may be
    broadcast from the driver's memory although it grows with the corpus.
    """
    return df.hint("merge")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` to the folder that spark.checkpoint.dir names, and read it again.

    The files are shared by all executors, so a lost one costs nothing that was written.
    """
    spark = df.sparkSession
    path = run_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freed(df: DataFrame, label: str) -> DataFrame:
    """``stored``, with the shuffles that led to the table given up once it is written."""
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        return stored(df, label)
    finally:
        spark.conf.set(name, before)


def given_up(table: DataFrame) -> None:
    """Delete a table of ``stored`` that nothing reads any more; files elsewhere are left alone."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if shared_folder(spark).rstrip("/").split(":", 1)[-1].lstrip("/") + "/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ASCII texts take the fast built-in, which changes nothing else in them."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def word_count(text: Column) -> Column:
    """Number of runs without white space; NULL counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node reachable.

    Alternating large-star and small-star steps: each is one aggregation and one equi-join,
    whose hot side adaptive execution may split; none is broadcast. Each round is written to the shared folder.
    Self-links and repeated links are allowed.
    """
    links = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label
    )
    seen = None
    while True:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(shuffled(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(shuffled(low), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), label)
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        links.select("v", "v").distinct()
    )
