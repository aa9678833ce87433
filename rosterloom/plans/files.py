"""Files out and in again: every writer's output is read back by the reader for it and must give the rows it was made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.functions import emails
from rosterloom.plans.dashboards import _targets
from rosterloom.plans.reports import results
from rosterloom.session import new_path, table
from rosterloom.sources import files, sinks

FIXED = (("Acme Words", "https://acme.example", "fr"), ("Zenith", "https://zenith.example", "DE"))


def _institutions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "institutions").select(F.regexp_replace("canonical_name", '[",]', " ").alias("name"), F.concat(F.lit("https://"), "home_domain").alias("url"), "country_code", "institution_id")


def target_sources(spark: SparkSession, d: str) -> DataFrame:
    """Targets of a country from landed pages of answers, and from a fixed list with a CSV, through one interface."""
    i = _institutions(spark, d)
    pages, csv = new_path(spark, "pages"), new_path(spark, "companies")
    item = F.struct(F.col("name").alias("display_name"), F.when(F.ascii(F.right("institution_id", F.lit(1))) % 2 == 0, F.col("url")).alias("homepage_url"), "country_code", F.lit("education").alias("type"))
    i.groupBy("country_code").agg(F.collect_list(item).alias("results")).write.option("maxRecordsPerFile", 1).json(pages)  # a page of answers a file
    i.select("name", "url", F.lower("country_code").alias("country"), F.col("institution_id").alias("registry")).write.option("header", True).csv(csv)
    sources: list[files.TargetSource] = [files.LandedPages(pages), files.CompanyList(csv, FIXED)]
    out = [s.targets(spark, "FR") for s in sources]
    return out[0].unionByName(out[1]).select("name", "url", "country", "source", F.coalesce(F.try_element_at("metadata", F.lit("registry")), F.lit("")).alias("registry"))


def limited_companies(spark: SparkSession, d: str) -> DataFrame:
    """Four companies, the fixed list first, under one limit."""
    csv = new_path(spark, "companies")
    _institutions(spark, d).select("name", "url", F.col("country_code").alias("country")).write.option("header", True).csv(csv)
    return files.name_and_url(files.CompanyList(csv, FIXED).targets(spark, limit=4))


def _results(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d).filter("org <= 20")
    return r.groupBy("method", "org").agg(F.count("*").cast("int").alias("candidates_found"), F.sum("kept").cast("int").alias("contacts_kept"), (F.sum(F.col("seconds").cast("decimal(18,4)")).cast("double") / 7).alias("time_seconds"), (F.sum(F.col("cost").cast("decimal(18,2)")).cast("double") / 7e6).alias("cost_dollars")).withColumn("university", F.concat(F.lit('Org "'), F.col("org").cast("string"), F.lit('", x'))).drop("org")


def benchmark_files(spark: SparkSession, d: str) -> DataFrame:
    """Result rows through the bundle's CSV."""
    path = new_path(spark, "bundle")
    rows = _results(spark, d)
    sinks.write_bundle(rows, rows.select("method", "university", F.lit("n").alias("name")), path)
    return files.benchmark(spark, f"{path}/results").select("method", "university", "candidates_found", "contacts_kept", "time_seconds", "cost_dollars", F.coalesce("best_url", F.lit("")).alias("best_url"))


def _documents(spark: SparkSession, d: str, path: str) -> None:
    c = table(spark, d, "contacts").filter("page_id % 5 = 0").select(F.col("evidence_type").alias("method"), F.col("institution_id").alias("university"), "name", "email", "role", "page_url", "score")
    sinks.write_documents(c, ["method", "university"], path)


def contact_documents(spark: SparkSession, d: str) -> DataFrame:
    """Contacts through one document per method and institution, of one method."""
    path = new_path(spark, "documents")
    _documents(spark, d, path)
    docs = files.contact_documents(spark, path)
    one = docs.select("method", "university", F.explode("rows").alias("c"))
    return one.groupBy("method", "university").agg(F.count("*").alias("n"), F.count("c.name").alias("named"), F.sum("c.score").alias("score"))


def recovered_results(spark: SparkSession, d: str) -> DataFrame:
    """Result rows rebuilt from documents, but for those a CSV has."""
    path, csv = new_path(spark, "documents"), new_path(spark, "csv")
    _documents(spark, d, path)
    done = table(spark, d, "institutions").filter("country_code = 'FR'").select(F.lit("mailto").alias("method"), F.col("institution_id").alias("university"))
    sinks.write_benchmark(done, csv)
    return files.recovered(spark, path, csv).select("method", "university", "contacts_kept", "tokens_in")


def _traces(spark: SparkSession, d: str, path: str) -> None:
    r = table(spark, d, "ranked_contacts").groupBy("institution_id").agg(F.collect_list(F.struct("name", "email", "title", "source_url")).alias("ranked_contacts"))
    i = _institutions(spark, d).filter("country_code in ('FR', 'IT')").join(r, "institution_id")
    sinks.write_traces(i.select(F.struct("name", "url", F.col("country_code").alias("country")).alias("target"), F.col("institution_id").alias("run_id"), "ranked_contacts"), "run_id", path)


def trace_files(spark: SparkSession, d: str) -> DataFrame:
    """Traces in a file each, read back: two contacts of each at most."""
    path = new_path(spark, "traces")
    _traces(spark, d, path)
    rows = files.traces(spark, f"{path}/*")
    return files.trace_contacts(rows, 2).groupBy("institution", "url").agg(F.count("*").alias("contacts"), F.max("pos").alias("last"))


def trace_listing(spark: SparkSession, d: str) -> DataFrame:
    """Files of traces by directory, those of folders that hold a letter, with what each directory holds."""
    path = new_path(spark, "traces")
    _traces(spark, d, path)
    listed = files.listing(spark, path, "*.txt")
    chosen = files.directories(listed).filter(F.contains(F.regexp_extract("directory", "([^/]*)$", 1), F.lit("a")))
    per = files.trace_directories(files.traces(spark, f"{path}/*"))
    bare = lambda c: F.regexp_extract(c, "file=([^/]*)$", 1)
    return chosen.select(bare("directory").alias("folder")).join(per.select(bare("directory").alias("folder"), "traces", "contacts", "country"), "folder")


def run_folders(spark: SparkSession, d: str) -> DataFrame:
    """Folders of runs with their metadata, numbered from the latest; both names of the count are known."""
    path = new_path(spark, "runs")
    for n in range(5):
        count = {"num_universities": n} if n % 2 else {"total_universities": n}
        sinks.write_run_info(spark, f"{path}/run{n}", timestamp=f"2025-0{n + 1}-01", country="FR", methods=["a", "b"][: n % 2 + 1], **count)
    return files.run_folders(spark, path).select("run", "targets", F.size("methods").alias("methods"))


def training_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows appended twice to a training file."""
    path = new_path(spark, "training")
    rows = table(spark, d, "acquired_pages").select("page_id", "url", F.left("visible_text", F.lit(40)).alias("beginning"))
    for part in ("page_id % 2 = 0", "page_id % 2 = 1"):
        sinks.append_training(rows.filter(part), path, ["page_id", "url", "beginning"])
    back = spark.read.option("header", True).schema("page_id bigint, url string, beginning string").csv(path)
    return back.select("page_id", "url", (F.contains("beginning", F.lit(",")) | F.contains("beginning", F.lit("\n"))).alias("odd"))


def email_files(spark: SparkSession, d: str) -> DataFrame:
    """Checked addresses through a file with another separator, counted by risk; the column is found by its content."""
    path, lists = new_path(spark, "emails"), new_path(spark, "disposable")
    r = table(spark, d, "ranked_contacts").select(F.col("ranked_id").alias("key"), emails.normalized(F.col("email")).alias("contact_field")).filter("contact_field <> ''")
    r.write.option("header", True).option("sep", ";").csv(path)
    i = table(spark, d, "institutions").filter("country_code = 'FR'").select(F.upper("home_domain").alias("value"))
    i.unionByName(spark.createDataFrame([("# comment",), ("",)], "value string")).write.text(lists)
    back = files.email_list(spark, path, ";").select("email", emails.domain(F.col("email")).alias("value"))
    risk = back.join(files.lines(spark, lists).withColumn("hit", F.lit(True)), "value", "left").select("email", F.coalesce("hit", F.lit(False)).alias("bounce_risk"))
    return sinks.write_validated(risk, new_path(spark, "checked"))


def requested_targets(spark: SparkSession, d: str) -> DataFrame:
    """Names asked for by file and by flag, each once without regard to case and accents."""
    path = new_path(spark, "names")
    _institutions(spark, d).select(F.explode(F.array("name", F.upper("name"))).alias("value")).write.text(path)
    return files.target_names(spark, path, ["ACME  words"]).select("key")


def sql_scan(spark: SparkSession, d: str) -> DataFrame:
    """A query with bound parameters."""
    return files.sql_scan(spark, "select institution_id, city from {inst} where country_code = :country and canonical_name like :pattern", {"inst": table(spark, d, "institutions")}, country="FR", pattern="%a%")


def contact_sheets(spark: SparkSession, d: str) -> DataFrame:
    """The sheet of contacts in its order, read back: no row stands before a better one of its institution."""
    path = new_path(spark, "sheet")
    c = table(spark, d, "contacts").select(F.col("institution_id").alias("University"), F.coalesce("score", F.lit(0)).alias("Score"), "contact_id")
    sinks.write_sheet(c, path)
    back = spark.read.option("header", True).schema("University string, Score int, contact_id bigint").csv(path).select("University", "Score", F.monotonically_increasing_id().alias("at"))
    return back.groupBy(F.col("University").alias("institution_id")).agg(F.count("*").alias("n"), F.min_by("Score", F.col("at") * -1).alias("last"), F.min_by("Score", "at").alias("first"))


def tuning_files(spark: SparkSession, d: str) -> DataFrame:
    """Rows and summary of variants through files, with the summary as Markdown beside."""
    path = new_path(spark, "tuning")
    t = _targets(spark, d)
    summary = t.groupBy("variant").agg(F.count("*").alias("targets"), F.sum("exported").alias("exported")).orderBy("variant")
    report = sinks.write_tuning(t, summary, path)
    back = spark.read.option("header", True).schema("variant string, targets bigint, exported bigint").csv(f"{path}/summary")
    return back.withColumn("lines", F.lit(report.count("\n") + 1))


def mail_merge(spark: SparkSession, d: str) -> DataFrame:
    """A mailing list in one of two encodings, told apart by its bytes."""
    path = new_path(spark, "merge")
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = fs.getFileSystem(spark._jsc.hadoopConfiguration())
    for name, text, code in (("a.csv", "FirstName,Email\nZoë,zoe@x.example\n\nBob,none\n", "utf-8"), ("b.csv", "FirstName,Email\r\nJosé,jose@x.example\r\n", "cp1252")):
        out = system.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)
        out.write(bytearray(text.encode(code)))
        out.close()
    return files.mail_merge(spark, path)


def store_files(spark: SparkSession, d: str) -> DataFrame:
    """The store written twice, each time as a whole, and read back by its pointer."""
    from rosterloom.plans.ingest import TABLES, incoming, ingest

    path = new_path(spark, "store")
    rows = incoming(spark, d)
    for part in ("not new", "new"):
        sinks.write_store(ingest(sinks.read_store(spark, path, list(TABLES)), rows.filter(part)), path)
    store = sinks.read_store(spark, path, list(TABLES))
    return store["contacts"].agg(F.count("*").alias("contacts")).crossJoin(store["targets"].agg(F.count("*").alias("targets")))


def _queries() -> dict:
    from rosterloom.plans.ingest import QUERIES as QUERIES_OF
    from rosterloom.plans.reports import _R
    from rosterloom.plans.scalars import _E

    inst = "(select regexp_replace(canonical_name, '[\",]', ' ', 'g') \"name\", 'https://' || home_domain url, country_code, institution_id from institutions)"
    trim = "trim(\"name\", ' ')"
    res = f"(select \"method\", 'Org \"' || org || '\", x' university, count(*)::int candidates_found, sum(kept)::int contacts_kept, round(sum(secs::decimal(18,4))::double / 7, 2) time_seconds, round(sum(cost::decimal(18,2))::double / 7e6, 6) cost_dollars from {_R} where org <= 20 group by \"method\", org)"
    docs = "(select evidence_type \"method\", institution_id university, count(*) n, count(name) named, sum(score)::bigint score from contacts where page_id % 5 = 0 group by 1, 2)"
    key = "trim(regexp_replace(strip_accents(replace(replace(replace(replace(replace(replace(replace(lower({x}), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae'), 'ø', 'o'), 'ł', 'l'), 'đ', 'd'), 'ı', 'i')), '[^a-z0-9]+', ' ', 'g'), ' ')"
    return {
        "target_sources": (target_sources, f"select \"name\", url, country_code country, 'openalex' source, '' registry from {inst} where country_code = 'FR' and ascii(institution_id[-1]) % 2 = 0 union all select {trim}, url, country_code, 'company', institution_id from {inst} where country_code = 'FR' union all select 'Acme Words', 'https://acme.example', 'FR', 'company', ''"),
        "limited_companies": (limited_companies, f"select \"name\", url from (select 'Acme Words' \"name\", 'https://acme.example' url, 0 b union all select 'Zenith', 'https://zenith.example', 0 union all select {trim}, url, 1 from {inst}) order by b, \"name\", url limit 4"),
        "benchmark_files": (benchmark_files, f"select *, '' best_url from {res}"),
        "contact_documents": (contact_documents, f"select * from {docs}"),
        "recovered_results": (recovered_results, f"select \"method\", university, n::int contacts_kept, 0 tokens_in from {docs} where not (\"method\" = 'mailto' and university in (select institution_id from institutions where country_code = 'FR'))"),
        "trace_files": (trace_files, f"select \"name\" institution, url, least(n, 2)::bigint contacts, (least(n, 2) - 1)::int \"last\" from {inst} join (select institution_id, count(*) n from ranked_contacts group by 1) using (institution_id) where country_code in ('FR', 'IT')"),
        "trace_listing": (trace_listing, f"select institution_id folder, 1 traces, n contacts, country_code country from {inst} join (select institution_id, count(*) n from ranked_contacts group by 1) using (institution_id) where country_code in ('FR', 'IT') and contains('file=' || institution_id, 'a')"),
        "run_folders": (run_folders, "select 'run' || n run, n targets, n % 2 + 1 methods from range(5) t(n)"),
        "training_rows": (training_rows, "select page_id, url, false odd from acquired_pages"),
        "email_files": (email_files, f"select dm in (select lower(home_domain) from institutions where country_code = 'FR') bounce_risk, count(*) n from (select split_part({_E}, '@', -1) dm, {_E} em from ranked_contacts) where em <> '' group by 1"),
        "requested_targets": (requested_targets, f"select distinct {key.format(x=chr(34) + 'name' + chr(34))} \"key\" from {inst} union select 'acme words'"),
        "sql_scan": (sql_scan, "select institution_id, city from institutions where country_code = 'FR' and canonical_name like '%a%'"),
        "contact_sheets": (contact_sheets, "select institution_id, count(*) n, min(coalesce(score, 0)) \"last\", max(coalesce(score, 0)) \"first\" from contacts group by 1"),
        "tuning_files": (tuning_files, "with t as (select run_id, institution_id, least(count(*), 5) e from ranked_contacts group by 1, 2), s as (select run_mode variant, count(*) targets, sum(e)::bigint exported from t join runs using (run_id) group by 1) select *, (select count(*) + 2 from s)::int \"lines\" from s"),
        "mail_merge": (mail_merge, "select * from (values ('Zoë', 'zoe@x.example'), ('José', 'jose@x.example')) t(first_name, email)"),
        "store_files": (store_files, f"select (select count(*) from ({QUERIES_OF['merge_store_contacts'][1]})) contacts, (select count(*) from ({QUERIES_OF['merge_targets'][1]})) targets"),
    }


QUERIES = _queries()
