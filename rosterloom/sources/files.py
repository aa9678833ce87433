"""Readers of the file formats that results, lists and traces come in, each with an explicit schema."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.functions.emails import EMAIL
from rosterloom.functions.text import alnum_key

TRACE = "target struct<name: string, url: string, country: string>, university string, home_url string, run_id string, ranked_contacts array<struct<name: string, email: string, title: string, source_url: string>>, candidates_ranked array<string>, _corrupt string"


def traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace documents, one per file, of either schema; files that can't be parsed are left out.

    (name, url, country, contacts, file, modified)
    """
    raw = spark.read.schema(TRACE).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = raw.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified")).filter("_corrupt is null")
    return rows.select(F.coalesce("target.name", "university").alias("name"), F.coalesce("target.url", "home_url").alias("url"), F.col("target.country").alias("country"), "ranked_contacts", "file", "modified")


def trace_contacts(rows: DataFrame, first: int | None = None) -> DataFrame:
    """Contacts of traces in their order; ``first`` keeps the first so many of each (a report's cap)."""
    items = F.col("ranked_contacts") if first is None else F.slice("ranked_contacts", 1, first)
    return rows.select("name", "url", F.posexplode(items).alias("pos", "c")).select(F.col("name").alias("institution"), "url", "pos", "c.name", "c.email", "c.title", "c.source_url")


def trace_directories(rows: DataFrame) -> DataFrame:
    """Per directory: traces, contacts, first country by file name, first and last change."""
    d = rows.withColumn("directory", F.regexp_replace("file", "/[^/]*$", ""))
    size = F.coalesce(F.size("ranked_contacts"), F.lit(0))
    return d.groupBy("directory").agg(F.count("*").alias("traces"), F.sum(F.greatest(size, F.lit(0))).alias("contacts"), F.min_by("country", F.when(F.coalesce("country", F.lit("")) != "", F.col("file"))).alias("country"), F.min("modified").alias("first"), F.max("modified").alias("last"))


def directories(listed: DataFrame) -> DataFrame:
    """The distinct directories of a listing, in order."""
    return listed.select("directory").distinct().orderBy("directory")


#: What every source of targets gives: one row per organisation to process.
TARGET = "name string, url string, country string, org_type string, source string, metadata map<string,string>"


class TargetSource(Protocol):
    """A source of organisations: rows of ``TARGET`` for a country (all without one), at most ``limit`` of them."""

    def targets(self, spark: SparkSession, country: str | None = None, limit: int | None = None) -> DataFrame: ...


@dataclass(frozen=True)
class LandedPages:
    """Institutions of landed result pages (a cursor-paged service's answers, one JSON document each) that have a home page."""

    path: str

    def targets(self, spark: SparkSession, country: str | None = None, limit: int | None = None) -> DataFrame:
        rows = openalex(spark, self.path, country)
        out = rows.select("name", "url", "country", F.lit("university").alias("org_type"), F.lit("openalex").alias("source"), F.create_map(F.lit("type"), "type").alias("metadata"))
        return out if limit is None else out.limit(limit)


@dataclass(frozen=True)
class CompanyList:
    """Companies of a fixed list and of a CSV, under one limit; the list comes first."""

    path: str | None = None
    fixed: tuple[tuple[str, str, str], ...] = ()

    def targets(self, spark: SparkSession, country: str | None = None, limit: int | None = None) -> DataFrame:
        first = spark.createDataFrame([(n, u, c.upper(), {}, 0) for n, u, c in self.fixed], "name string, url string, country string, metadata map<string,string>, band int")
        rows = first if self.path is None else first.unionByName(companies(spark, self.path).withColumn("band", F.lit(1)))
        rows = rows if country is None else rows.filter(F.col("country") == country.upper())
        rows = rows if limit is None else rows.orderBy("band", "name", "url").limit(limit)
        return rows.select("name", "url", "country", F.lit("company").alias("org_type"), F.lit("company").alias("source"), "metadata")


def name_and_url(targets: DataFrame) -> DataFrame:
    return targets.select("name", "url")


#: Columns of result files, in order. Fixed values.
BENCHMARK = "method string, university string, status string, error string, candidates_found int, candidates_ranked int, probe_attempts int, candidates_probed int, contacts_extracted int, contacts_kept int, time_seconds double, tokens_in bigint, tokens_out bigint, cost_dollars double, best_url string"


def benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Result rows of a CSV with the fifteen columns."""
    return spark.read.schema(BENCHMARK).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


CONTACT_DOCUMENT = "method string, university string, university_url string, rows array<struct<name: string, email: string, role: string, page_url: string, score: int>>, summary struct<candidates_found: int, probe_attempts: int, total_kept: int, time_seconds: double>, _corrupt string"


def contact_documents(spark: SparkSession, path: str, method: str | None = None) -> DataFrame:
    """Documents of contacts, of one method or all; unreadable ones are left out."""
    raw = spark.read.schema(CONTACT_DOCUMENT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", False).json(path)
    rows = raw.select("*").filter("_corrupt is null").drop("_corrupt")
    return rows if method is None else rows.filter(F.col("method") == method)


def recovered(spark: SparkSession, path: str, csv_path: str | None = None) -> DataFrame:
    """Result rows rebuilt from contact documents; methods and organisations that a result CSV has already are skipped."""
    rows = contact_documents(spark, path).select("method", "university", F.coalesce("summary.candidates_found", F.lit(0)).alias("candidates_found"), F.coalesce("summary.probe_attempts", F.lit(0)).alias("probe_attempts"), F.size("rows").alias("contacts_kept"), F.lit(0).cast("bigint").alias("tokens_in"), F.lit(0).cast("bigint").alias("tokens_out"))
    return rows if csv_path is None else rows.join(benchmark(spark, csv_path).select("method", "university"), ["method", "university"], "left_anti")


def run_folders(spark: SparkSession, path: str) -> DataFrame:
    """Run folders below a path with their metadata, the latest first. Both names of the number of targets are read."""
    schema = "timestamp string, country string, methods array<string>, num_universities int, total_universities int"
    raw = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "run_info.json").option("recursiveFileLookup", True).json(path)
    rows = raw.select(F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/run_info.json$", 1).alias("run"), "country", "methods", F.coalesce("num_universities", "total_universities").alias("targets"), "timestamp")
    return rows.orderBy(F.col("timestamp").desc_nulls_last(), F.col("run").desc())


#: What Windows-1252 has in place of the control characters of ISO 8859-1.
_LETTERS = "".join(c for c in (bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)) if c)
_CONTROLS = "".join(chr(b) for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore"))


def mail_merge(spark: SparkSession, path: str) -> DataFrame:
    """(first_name, email) of a CSV in UTF-8 or, where its bytes are no UTF-8, in Windows-1252."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.decode("content", "UTF-8")).otherwise(F.translate(F.decode("content", "ISO-8859-1"), _CONTROLS, _LETTERS))
    lines = raw.select("path", F.posexplode(F.split(text, r"\r?\n")).alias("no", "line")).filter("no > 0 and trim(line) <> ''")
    return lines.select(F.btrim(F.split_part("line", F.lit(","), F.lit(1)), F.lit(' "')).alias("first_name"), F.btrim(F.split_part("line", F.lit(","), F.lit(2)), F.lit(' "')).alias("email")).filter(F.contains("email", F.lit("@")))


def sql_scan(spark: SparkSession, text: str, tables: dict[str, DataFrame], **args: object) -> DataFrame:
    """A parameterised query over named tables; parameters are bound, not pasted."""
    return spark.sql(text, args=args, **tables)


def companies(spark: SparkSession, path: str, country: str | None = None, limit: int | None = None) -> DataFrame:
    """Companies of a CSV with columns name, url, country; further columns become a map. Blank names or addresses are left out."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    known = {"name", "url", "country"}
    extra = [c for c in raw.columns if c.lower() not in known]
    meta = F.map_from_arrays(F.array(*[F.lit(c) for c in extra]), F.array(*[F.col(c) for c in extra])) if extra else F.create_map().cast("map<string,string>")
    col = lambda n: F.btrim(F.coalesce(F.col(n), F.lit(""))) if n in {c.lower() for c in raw.columns} else F.lit("")
    out = raw.select(col("name").alias("name"), col("url").alias("url"), F.upper(col("country")).alias("country"), F.map_filter(meta, lambda k, v: v.isNotNull()).alias("metadata")).filter("name <> '' and url <> ''")
    out = out if country is None else out.filter(F.col("country") == country.upper())
    return out if limit is None else out.limit(limit)


def email_list(spark: SparkSession, path: str, sep: str = ",", column: str | None = None, head: int | None = None) -> DataFrame:
    """(row_no, email) of a CSV, of its first rows if ``head`` says so.

    The column is the given one, the first whose name is email or emails or ends so, or the first with addresses in it.
    """
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    raw = raw if head is None else raw.limit(head)
    name = column or next((c for c in raw.columns if re.search("(^|[^a-z])e?-?mails?$", c.strip().lower())), None)
    if name is None:  # one pass over all columns counts addresses
        counts = raw.agg(*[F.count_if(F.col(f"`{c}`").rlike(EMAIL)).alias(str(n)) for n, c in enumerate(raw.columns)]).first()
        name = raw.columns[max(range(len(raw.columns)), key=lambda n: (counts[n], -n))]
    return raw.select(F.monotonically_increasing_id().alias("row_no"), F.col(name).alias("email"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text list: trimmed, lower case, without blank ones and comments, each once."""
    return spark.read.text(path).select(F.lower(F.btrim("value")).alias("value")).filter("value <> '' and not startswith(value, '#')").distinct()


def target_names(spark: SparkSession, path: str, also: list[str] | None = None) -> DataFrame:
    """Names asked for, by flag or file, once each without regard to case and accents: (key, name)."""
    rows = spark.read.text(path).select("value", F.lit(1).alias("source"))
    if also:
        rows = rows.unionByName(spark.createDataFrame([(a, 0) for a in also], "value string, source int"))
    rows = rows.select(F.btrim("value").alias("name"), "source").filter("name <> ''").withColumn("key", alnum_key(F.col("name")))
    return rows.groupBy("key").agg(F.min_by("name", F.struct("source", "name")).alias("name"))


def openalex(spark: SparkSession, path: str, country: str | None = None) -> DataFrame:
    """Institutions of landed result pages that have a home page: (name, url, country, type)."""
    schema = "results array<struct<id: string, display_name: string, homepage_url: string, country_code: string, type: string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("results").alias("r")).select(F.col("r.display_name").alias("name"), F.col("r.homepage_url").alias("url"), F.col("r.country_code").alias("country"), F.col("r.type").alias("type"))
    rows = rows.filter(F.coalesce("url", F.lit("")) != "")
    return rows if country is None else rows.filter(F.upper("country") == country.upper())


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a path with size and time of change, without reading them, by directory and name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("directory"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "modificationTime", "length").orderBy("directory", F.lower("name"))
