"""Writers: every one is lazy up to the write and distributed; none gathers rows on the driver."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.functions.text import slug
from rosterloom.sources.files import BENCHMARK

#: Columns of the CRM export that lead, in this order. Fixed values.
CRM = ("Organisation", "Country", "Name", "Email", "Title", "Priority", "Confidence", "SourceURL", "Outcome")


def crm_rows(df: DataFrame, canonical: Sequence[str] = CRM) -> DataFrame:
    """Canonical columns that occur, then the others as they come, everything as text and missing values as ''."""
    order = [c for c in canonical if c in df.columns] + [c for c in df.columns if c not in canonical]
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in order])


def write_crm(df: DataFrame, path: str, form: str = "csv") -> bool:
    """Write CRM rows; an empty input writes nothing and gives False."""
    if df.limit(1).count() == 0:
        return False
    rows = crm_rows(df)
    (rows.write.mode("overwrite").option("header", True).csv(path) if form == "csv" else rows.write.mode("overwrite").json(path))
    return True


def flat_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Line breaks and commas of text columns replaced by blanks, for line-oriented readers."""
    return df.withColumns({c: F.translate(F.col(c), "\n\r,", "   ") for c in columns})


def append_training(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Rows added to a training CSV: line breaks and commas of text become blanks."""
    flat_text(df.select(*columns), [c for c, t in df.select(*columns).dtypes if t == "string"]).write.mode("append").option("header", True).csv(path)


def write_documents(df: DataFrame, keys: Sequence[str], path: str) -> None:
    """One JSON document per key with all its rows, laid out by the first key. Keys without rows get none.

    A document is as long as its key has rows: that is the format. Where a key may have very many, use ``write_traces``
    per row, or the tables themselves.
    """
    rest = [c for c in df.columns if c not in keys]
    has = F.lit(False)
    for c in rest:
        has = has | F.col(c).isNotNull()
    grouped = df.filter(has).groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("rows"))
    grouped.write.mode("overwrite").partitionBy(keys[0]).json(path)


def write_traces(df: DataFrame, name: str, path: str) -> None:
    """One JSON document per row in a file of its own, in a folder of the row's slugged name."""
    rows = df.select(slug(F.coalesce(F.col(name).cast("string"), F.lit(""))).alias("file"), F.to_json(F.struct(*df.columns)).alias("value"))
    rows.write.mode("overwrite").partitionBy("file").option("maxRecordsPerFile", 1).text(path)


def benchmark_rows(df: DataFrame) -> DataFrame:
    """The fifteen columns of result files; seconds to 2 and dollars to 6 places, a missing address as ''."""
    fields = [f.strip().split(" ") for f in BENCHMARK.split(",")]
    out = df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])
    return out.withColumn("time_seconds", F.round("time_seconds", 2)).withColumn("cost_dollars", F.round("cost_dollars", 6)).withColumn("best_url", F.coalesce("best_url", F.lit("")))


def write_benchmark(df: DataFrame, path: str) -> None:
    benchmark_rows(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_bundle(df: DataFrame, contacts: DataFrame, path: str) -> None:
    """All artefacts of a comparison: result CSV, results as JSON, one document of contacts per method and organisation."""
    write_benchmark(df, f"{path}/results")
    df.write.mode("overwrite").json(f"{path}/debug")
    write_documents(contacts, ["method", "university"], f"{path}/contacts")


def write_sheet(df: DataFrame, path: str, by: str = "University", score: str = "Score") -> None:
    """The sheet of contacts by institution and falling score; ranges of institutions are sorted apart, so files are in order."""
    df.repartitionByRange(by).sortWithinPartitions(by, F.col(score).desc_nulls_last()).write.mode("overwrite").option("header", True).csv(path)


def write_validated(df: DataFrame, path: str, risk: str = "bounce_risk") -> DataFrame:
    """Write checked addresses; gives the number of rows by risk, the most frequent first."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return df.groupBy(risk).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), risk)


def write_run_info(spark: SparkSession, path: str, **info: object) -> None:
    """The metadata of a run as one JSON document (a single row)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run_info.json")
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(json.dumps(info), "utf-8"))
    out.close()


def markdown(rows: Sequence[dict], columns: Sequence[str]) -> str:
    """A small report table (rows of a summary, collected) as Markdown."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join("" if r.get(c) is None else str(r[c]) for c in columns) + " |" for r in rows])


def write_tuning(detail: DataFrame, summary: DataFrame, path: str) -> str:
    """Rows and summary of a tuning run as CSV; gives the summary as Markdown."""
    detail.write.mode("overwrite").option("header", True).csv(f"{path}/detail")
    summary.write.mode("overwrite").option("header", True).csv(f"{path}/summary")
    return markdown([r.asDict() for r in summary.limit(1000).collect()], summary.columns)


def write_store(store: dict[str, DataFrame], path: str) -> None:
    """Every table of the store into a new folder beside the last one, which a pointer file names when all are written.

    A reader sees the old tables or the new ones, never a part; a failed write leaves the old ones in place.
    """
    spark = next(iter(store.values())).sparkSession
    folder = f"{path}/{uuid.uuid4().hex}"
    for name, df in store.items():
        df.write.parquet(f"{folder}/{name}")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(where, True)
    out.write(bytearray(folder.rsplit("/", 1)[1], "utf-8"))
    out.close()


def read_store(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """The tables that the pointer file names; none if there is no store yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return {}
    folder = spark.read.text(f"{path}/CURRENT").first()["value"]
    return {n: spark.read.parquet(f"{path}/{folder}/{n}") for n in names}
