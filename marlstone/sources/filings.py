"""Filing indexes and files, without a network: lookups, column-parallel JSON, what is still to be fetched."""

from __future__ import annotations

import logging
import os
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

log = logging.getLogger(__name__)

#: Ticker and central index key.
CIKS = {
    "AAPL": "0000320193",
    "MSFT": "0000789019",
    "GOOGL": "0001652044",
    "AMZN": "0001018724",
    "NVDA": "0001045810",
    "META": "0001326801",
    "JPM": "0000019617",
    "GS": "0000886982",
    "BAC": "0000070858",
    "XOM": "0000034088",
    "CVX": "0000093410",
    "JNJ": "0000200406",
    "PFE": "0000078003",
    "UNH": "0000731766",
    "KO": "0000021344",
    "PG": "0000080424",
    "WMT": "0000104169",
    "COST": "0000909832",
    "TSLA": "0001318605",
    "BRK.B": "0001067983",
}
MIN_BYTES = 1024
SUBMISSIONS = "struct<filings:struct<recent:struct<accessionNumber:array<string>,filingDate:array<string>,reportDate:array<string>,form:array<string>,primaryDocument:array<string>>>>"


def cik(ticker: Column, table: dict[str, str] = CIKS) -> Column:
    """Ten digits, or empty for an unknown ticker."""
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.try_element_at(known, F.upper(ticker))
    return F.coalesce(F.lpad(found, 10, "0"), F.lit(""))


def unzipped(submissions: DataFrame, form: str, json_col: str = "json") -> DataFrame:
    """Rows (ticker, cik, ...) of column-parallel arrays, of one form type."""
    recent = F.from_json(F.col(json_col), SUBMISSIONS)["filings"]["recent"]
    zipped = F.arrays_zip(recent["accessionNumber"].alias("accession_number"), recent["filingDate"].alias("filing_date"), recent["reportDate"].alias("report_date"), recent["form"].alias("form_type"), recent["primaryDocument"].alias("document"))
    rows = submissions.select("ticker", "cik", F.explode(zipped).alias("x")).select("ticker", "cik", "x.*").filter(F.col("form_type") == form)
    year = F.left(F.coalesce(F.nullif("report_date", F.lit("")), F.col("filing_date")), F.lit(4))
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.col("cik").cast("long").cast("string"), F.lit("/"), F.replace("accession_number", F.lit("-"), F.lit("")), F.lit("/"), F.col("document"))
    return rows.select("ticker", "cik", "filing_date", year.cast("int").alias("fiscal_year"), "accession_number", "form_type", url.alias("url"))


def recent_years(filings: DataFrame, years: int, this_year: int) -> DataFrame:
    return filings.filter(F.col("fiscal_year") >= this_year - years)


def missing(wanted: DataFrame, present: DataFrame, least: int = MIN_BYTES) -> DataFrame:
    """Wanted rows (path, ...) without a file (path, length) of a size that counts."""
    return wanted.join(present.filter(F.col("length") > least).select("path"), "path", "left_anti")


def files(spark: SparkSession, path: str) -> DataFrame:
    """path and length of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def raw_html(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """doc_key (the path) and text of whole HTML files."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("doc_key"), F.col("value").alias("html"))


def plain_path(path: Column) -> Column:
    """A file's path as qualified() has it: one stroke after `file:`."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system, as the reader of files names it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return re.sub("^file:/+", "file:/", where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri().toString())


def write_manifest(filings: DataFrame, path: str) -> None:
    filings.write.mode("overwrite").parquet(path)


MANIFEST = "ticker string, cik string, filing_date string, fiscal_year int, accession_number string, form_type string, url string, local_path string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest; columns that an older one lacks are null."""
    rows = spark.read.parquet(path)
    want = StructType.fromDDL(MANIFEST)
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])


def ingest(spark: SparkSession, tickers: list[str], index_of: Callable[[str, str], str], fetch: Callable[[str, str], int], folder: str, manifest: str, years: int, this_year: int, form: str = "10-K") -> DataFrame:
    """Indexes of the tickers, then files that are not there yet, then the manifest of those that are.

    index_of(ticker, cik) gives an index as JSON, fetch(url, path) writes a file and gives its size; both are the caller's.
    What fails is warned of and passed by: a ticker or a file less, not a run. Fetching is a driver's loop, as the service
    allows few calls a second; a ticker has a filing a year."""
    found = []
    for ticker in tickers:
        number = CIKS.get(ticker.upper())
        try:
            if number is None:
                raise ValueError("unknown ticker")
            found.append((ticker, number, index_of(ticker, number)))
        except Exception as e:  # noqa: BLE001
            log.warning("index of %s: %s", ticker, e)
    listed = recent_years(unzipped(spark.createDataFrame(found, "ticker string, cik string, json string"), form), years, this_year)
    rows = listed.withColumn("local_path", F.concat(F.lit(f"{folder}/"), F.concat_ws("_", "ticker", "filing_date"), F.lit(".htm"))).collect()
    kept = []
    for r in rows:
        try:
            size = os.path.getsize(r.local_path) if os.path.exists(r.local_path) else 0
            if size > MIN_BYTES or fetch(r.url, r.local_path) > MIN_BYTES:
                kept.append(r)
        except Exception as e:  # noqa: BLE001
            log.warning("filing %s: %s", r.local_path, e)
    out = spark.createDataFrame([[r[f] for f in StructType.fromDDL(MANIFEST).names] for r in kept], MANIFEST)
    write_manifest(out.coalesce(1), manifest)
    return read_manifest(spark, manifest)


SAMPLE = """<html><head><title>Sample filing</title><style>p{}</style></head><body>
<p>Item 1. Business</p><p>Contents</p>
<h2>Item 1. Business</h2><p>%s</p>
<h2>Item 1A. Risk Factors</h2><p>%s</p>
<h2>Item 7. Management's Discussion</h2><p>%s</p></body></html>""" % (
    " ".join(["The company makes and sells instruments for weather stations."] * 12),
    " ".join(["Demand may fall if harvests are poor, and suppliers may fail."] * 12),
    " ".join(["Revenue rose with the number of stations served in the year."] * 12),
)


def write_sample(path: str) -> str:
    """One small filing as a file, for trying things out."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(SAMPLE)
    return path
