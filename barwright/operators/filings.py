"""Filing lists, company facts and key metrics from landed JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barwright.operators.upsert import insert_absent, overwrite
from barwright.schema import FACTS_FLAT, FACTS_NESTED, SUBMISSIONS, TICKERS

# The metrics picked from the facts of a company.
KEY_METRICS = [
    "Revenue",
    "NetIncome",
    "GrossProfit",
    "OperatingIncome",
    "Assets",
    "Liabilities",
    "StockholdersEquity",
    "EarningsPerShareBasic",
    "EarningsPerShareDiluted",
    "DividendsPerShareCommonStockDeclared",
    "OperatingExpenses",
    "CashAndCashEquivalentsAtCarryingValue",
    "Goodwill",
    "AccountsReceivableNetCurrent",
    "Inventory",
]

# Array of the filing list behind each output column.
FILING_FIELDS = {
    "form_type": "form",
    "filing_date": "filingDate",
    "accession_number": "accessionNumber",
    "file_number": "fileNumber",
    "items": "items",
    "size": "size",
    "isXBRL": "isXBRL",
    "isInlineXBRL": "isInlineXBRL",
    "primaryDocument": "primaryDocument",
    "primaryDocDescription": "primaryDocDescription",
}


def submissions(docs: DataFrame) -> DataFrame:
    return docs.select(F.from_json("doc", SUBMISSIONS).alias("s")).select("s.*")


def filings(subs: DataFrame) -> DataFrame:
    """One row per filing; arrays that are missing or shorter than the accession list give NULL."""
    recent = [F.coalesce(F.col(f"filings.recent.{src}"), F.array()).alias(src) for src in FILING_FIELDS.values()]
    rows = subs.select("cik", F.col("name").alias("company_name"), *recent)
    zipped = F.slice(F.arrays_zip(*FILING_FIELDS.values()), F.lit(1), F.size("accessionNumber"))
    rows = rows.select("cik", "company_name", F.inline(zipped))
    return rows.select("cik", "company_name", *[F.col(src).alias(out) for out, src in FILING_FIELDS.items()])


def surplus_elements(subs: DataFrame) -> DataFrame:
    """(cik, column, surplus): elements of a parallel array beyond the accession list, which no filing row has a place for."""
    size = lambda src: F.size(F.coalesce(F.col(f"filings.recent.{src}"), F.array()))
    cells = [F.struct(F.lit(out).alias("column"), (size(src) - size("accessionNumber")).cast("long").alias("surplus")) for out, src in FILING_FIELDS.items()]
    return subs.select("cik", F.inline(F.array(*cells))).filter("surplus > 0").groupBy("cik", "column").agg(F.sum("surplus").alias("surplus"))


def filing_records(rows: DataFrame, directory: DataFrame, fetched_at: Column) -> DataFrame:
    """Filing rows as they are kept: with the symbol of the company and when they were fetched.

    Of several tickers of a company the first by code points, upper-cased, is its symbol; a
    company that the directory lacks has NULL. The directory is reduced to a row a company
    before the join, so that no filing is repeated.
    """
    symbols = directory.groupBy("cik").agg(F.min(F.upper("ticker")).alias("symbol"))
    return rows.join(symbols, "cik", "left").withColumn("fetched_at", fetched_at)


def filing_keys(docs: DataFrame) -> DataFrame:
    """(cik, accession_number, filing_date) of documents: the parser is asked for three fields only."""
    schema = "cik string, filings struct<recent: struct<accessionNumber: array<string>, filingDate: array<string>>>"
    recent = docs.select(F.from_json("doc", schema).alias("s")).select("s.cik", "s.filings.recent.*")
    dates = F.coalesce("filingDate", F.array().cast("array<string>")).alias("filingDate")
    names = F.coalesce("accessionNumber", F.array().cast("array<string>")).alias("accessionNumber")
    zipped = recent.select("cik", names, dates).select("cik", F.inline(F.slice(F.arrays_zip("accessionNumber", "filingDate"), F.lit(1), F.size("accessionNumber"))))
    return zipped.select("cik", F.col("accessionNumber").alias("accession_number"), F.col("filingDate").alias("filing_date"))


def latest_filings(rows: DataFrame) -> DataFrame:
    """Accession of the latest-dated filing of each company."""
    rank = F.struct("filing_date", "accession_number")
    return rows.groupBy("cik").agg(
        F.max_by("accession_number", rank).alias("latest_accession"), F.max("filing_date").alias("latest_date")
    )


def new_filings(rows: DataFrame, stored: DataFrame, high_water: bool = False) -> DataFrame:
    """Filings to take in.

    By default those whose accession is not stored. With ``high_water`` those whose
    accession sorts after that of the latest-dated stored filing, which loses late
    rows with a smaller accession.
    """
    if not high_water:
        return rows.join(stored.select("cik", "accession_number"), ["cik", "accession_number"], "left_anti")
    mark = latest_filings(stored).select("cik", "latest_accession")
    return (
        rows.join(mark, "cik", "left")
        .filter(F.col("latest_accession").isNull() | (F.col("accession_number") > F.col("latest_accession")))
        .drop("latest_accession")
    )


def write_filings(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Insert by accession, or overwrite the stored filing of the same accession."""
    return overwrite(stored, rows, ["accession_number"], ["filing_date"])


def facts(docs: DataFrame) -> DataFrame:
    """Parsed facts by taxonomy, whichever layout a document uses."""
    return docs.select(
        *[c for c in docs.columns if c != "doc"],
        F.coalesce(F.from_json("doc", FACTS_NESTED)["facts"]["facts"], F.from_json("doc", FACTS_FLAT)["facts"]).alias("facts"),
    )


def fact_points(parsed: DataFrame, taxonomy: str = "us-gaap") -> DataFrame:
    """One row per tag, unit and reported value. Values stay text beyond 64 bits."""
    keys = [c for c in parsed.columns if c != "facts"]
    tags = parsed.select(*keys, F.explode(F.col("facts")[taxonomy]).alias("metric", "body"))
    units = tags.select(*keys, "metric", F.explode("body.units").alias("unit", "points"))
    return units.select(*keys, "metric", "unit", F.inline("points"))


def key_metrics(parsed: DataFrame, tags: list[str] = KEY_METRICS) -> DataFrame:
    """Reported values of the chosen tags with the names used downstream."""
    points = fact_points(parsed).filter(F.col("metric").isin(tags))
    keys = [c for c in parsed.columns if c != "facts"]
    return points.select(
        *keys,
        "metric",
        F.col("val").alias("value"),
        "unit",
        "form",
        F.col("filed").alias("filed_date"),
        F.col("end").alias("period_end"),
        F.col("start").alias("period_start"),
        "accn",
        F.col("fy").alias("fiscal_year"),
        F.col("fp").alias("fiscal_period"),
    )


METRIC_KEY = ["cik", "symbol", "metric", "period_end", "value"]


def insert_metrics(stored: DataFrame, metrics: DataFrame) -> DataFrame:
    return insert_absent(stored, metrics, METRIC_KEY, ["accn", "unit"])


def as_integer(text: str):
    """Whole number of any length, or NULL where it does not fit 38 digits."""
    return F.expr(f"try_cast({text} AS decimal(38,0))")


def tag_counts(parsed: DataFrame, taxonomy: str = "us-gaap", top: int | None = None) -> DataFrame:
    """Documents per tag, most frequent first; the first ``top`` where the caller asks for a report."""
    out = parsed.select(F.explode(F.map_keys(F.col("facts")[taxonomy])).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "tag").limit(top) if top else out


def document_shape(parsed: DataFrame, taxonomy: str = "us-gaap") -> DataFrame:
    """Tags with their units and how many values each unit holds."""
    return (
        fact_points(parsed, taxonomy)
        .groupBy("metric", "unit")
        .agg(F.count("*").alias("points"), F.min("end").alias("first_end"), F.max("end").alias("last_end"))
    )


def tickers(docs: DataFrame) -> DataFrame:
    """Directory entries of an object of objects."""
    return docs.select(F.explode(F.map_values(F.from_json("doc", TICKERS))).alias("t")).select(
        "t.ticker", F.lpad(F.col("t.cik_str").cast("string"), 10, "0").alias("cik")
    )


def resolved(stocks: DataFrame, directory: DataFrame) -> DataFrame:
    """CIK of each symbol, ignoring case; the smallest CIK wins. NULL where none matches."""
    first = directory.groupBy(F.upper("ticker").alias("_key")).agg(F.min("cik").alias("cik"))
    return stocks.join(first, F.upper("symbol") == F.col("_key"), "left").drop("_key")


def unmatched(stocks: DataFrame, directory: DataFrame) -> DataFrame:
    keys = directory.select(F.upper("ticker").alias("_key")).distinct()
    return stocks.join(keys, F.upper("symbol") == F.col("_key"), "left_anti").select("symbol")


def upsert_companies(stored: DataFrame, rows: DataFrame) -> DataFrame:
    return overwrite(stored, rows, ["cik"], ["updated_at"])


def with_company(metrics: DataFrame, companies: DataFrame, captured_at) -> DataFrame:
    """Metrics with the company's name, sector and industry, NULL where it is unknown, and when they were taken."""
    names = companies.select("symbol", "company_name", "sector", "industry")
    return metrics.join(names, "symbol", "left").withColumn("captured_at", captured_at)


def schema_of_facts(parsed: DataFrame) -> DataFrame:
    """Taxonomies, tags and units with the number of values and the first by period and accession."""
    tags = parsed.select(F.explode("facts").alias("taxonomy", "tags")).select("taxonomy", F.explode("tags").alias("metric", "body"))
    points = tags.select("taxonomy", "metric", F.explode("body.units").alias("unit", "points")).select("taxonomy", "metric", "unit", F.inline("points"))
    order = F.struct("end", "accn", F.length("val"))
    return points.groupBy("taxonomy", "metric", "unit").agg(F.count("*").alias("points"), F.min_by("val", order).alias("first_value"))


def tickers_of_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Directory entries of lines ``ticker TAB number``; lines without both are dropped."""
    parts = F.split(column, "\t")
    rows = lines.select(F.trim(F.get(parts, 0)).alias("ticker"), F.trim(F.get(parts, 1)).alias("cik"))
    return rows.filter("ticker <> '' AND cik <> ''").select("ticker", F.lpad("cik", 10, "0").alias("cik"))
