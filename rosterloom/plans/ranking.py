"""Page candidates: families by weighted terms, order, de-duplication, quotas; HTML and streaming end to end."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.functions import urls
from rosterloom.functions.text import contains_any, token_estimate
from rosterloom.operators.records import compose_quota, top_per_group
from rosterloom.plans.views import us
from rosterloom.session import new_path, table
from rosterloom.sources import html
from rosterloom.streaming.current_state import StateStore

#: Families of pages by terms, in order of precedence.
FAMILIES = {
    "international": ["international", "mobility", "erasmus", "exchange"],
    "directory": ["people", "staff", "team", "directory"],
    "contact": ["contact", "office"],
    "about": ["about"],
}


def families(spark: SparkSession, d: str) -> DataFrame:
    """Family of every page: 2.6 per term in the address, 0.8 per term in the first 1,200 characters; best, then precedence."""
    p = table(spark, d, "acquired_pages").select("page_id", "institution_id", "url", us("fetched_at").alias("at"), F.lower("url").alias("u"), F.lower(F.substring("visible_text", 1, 1200)).alias("t"))
    scored = []
    for rank, (name, terms) in enumerate(FAMILIES.items()):
        score = sum(((F.contains("u", F.lit(t)).cast("int") * 26 + F.contains("t", F.lit(t)).cast("int") * 8) for t in terms), F.lit(0))
        scored.append(F.struct(score.alias("score"), F.lit(-rank).alias("rank"), F.lit(name).alias("family")))
    best = F.array_max(F.array(*scored, F.struct(F.lit(1).alias("score"), F.lit(-99).alias("rank"), F.lit("generic").alias("family"))))
    return p.withColumn("b", best).select("page_id", "institution_id", "url", "at", "b.family", "b.score")


def page_family(spark: SparkSession, d: str) -> DataFrame:
    return families(spark, d).select("page_id", "family", "score")


def candidate_order(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of every institution by score, then depth, then text: the first ten."""
    f = families(spark, d)
    order = [F.col("score").desc(), urls.depth(F.col("url")), F.col("url"), F.col("page_id")]
    return top_per_group(f, ["institution_id"], order, 10, "position").select("institution_id", "position", "page_id")


def url_dedup(spark: SparkSession, d: str) -> DataFrame:
    """One row per normalised address: the best by score keeps its place, families are united."""
    f = families(spark, d).withColumn("address", urls.normalized(F.col("url")))
    g = f.groupBy("address").agg(F.max_by("page_id", F.struct("score", -F.col("page_id"))).alias("page_id"), F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.count("*").alias("n"))
    return g


def quota_compose(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each institution under a quota per family and a limit in all."""
    quotas = {"international": 3, "directory": 2, "contact": 2, "about": 1, "generic": 1}
    out = compose_quota(families(spark, d), "institution_id", "family", [F.col("score").desc(), F.col("page_id")], quotas, 6)
    return out.select("institution_id", "position", "page_id", "family")


def pruned_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every page with the reason why it would be left out: asset, visited before, dead address, or none."""
    p = table(spark, d, "acquired_pages").select("page_id", "url", "http_status", us("fetched_at").alias("at"))
    first = p.groupBy("url").agg(F.min_by("page_id", F.struct("at", "page_id")).alias("first"), F.max(F.coalesce("http_status", F.lit(0)).isin(404, 410, 451)).alias("dead"))
    out = p.join(first, "url")
    return out.select("page_id", F.when(urls.is_asset(F.col("url")), "asset").when(F.col("page_id") != F.col("first"), "visited").when(F.col("dead"), "dead_url").otherwise("").alias("reason"))


def shell_pages(spark: SparkSession, d: str) -> DataFrame:
    """Renderings with embedded documents and little visible text."""
    e = table(spark, d, "fetched_extractions")
    density = F.try_divide(F.col("visible_text_length"), F.col("page_length"))
    return e.select("extraction_id", ((F.col("embedded_document_count") >= 1) & (F.coalesce(density, F.lit(1.0)) <= 0.06) & (F.col("mailto_count") == 0)).alias("shell"))


def promising_pages(spark: SparkSession, d: str) -> DataFrame:
    """A cheap test before an expensive extractor: terms and an address sign in the text."""
    t = F.lower("visible_text")
    return table(spark, d, "acquired_pages").select("page_id", (contains_any(t, ["international", "mobility", "admissions"]) & F.contains(t, F.lit("@"))).alias("promising"), token_estimate(F.col("visible_text")).alias("tokens"))


def ordered_union(spark: SparkSession, d: str) -> DataFrame:
    """Acquisition modes of a rendering and its page as one ordered list without repeats."""
    e = table(spark, d, "fetched_extractions").select("extraction_id", "page_id", "acquisition_modes")
    p = table(spark, d, "acquired_pages").select("page_id", "acquisition_mode")
    both = F.array_distinct(F.concat(F.col("acquisition_modes"), F.array("acquisition_mode")))
    return e.join(p, "page_id").select("extraction_id", F.array_join(both, ">").alias("modes"))


def html_visible_text(spark: SparkSession, d: str) -> DataFrame:
    """Page texts set as HTML and read back by the parser: the same lines come out."""
    p = table(spark, d, "acquired_pages").select("page_id", F.regexp_replace(F.regexp_replace(F.replace(F.col("visible_text"), F.lit("&"), F.lit("&amp;")), "<", "&lt;"), "\n", "</p><p>").alias("body"))
    page = F.concat(F.lit("<html><head><script>var a = '<b>';</script><style>p{}</style></head><body><p>"), "body", F.lit("</p></body></html>"))
    return html.parsed_pages(p.select("page_id", page.alias("html")), "page_id", "html").select("page_id", F.sha1(F.col("text").cast("binary")).alias("text"))


def streamed_state(spark: SparkSession, d: str) -> DataFrame:
    """Current state of contacts kept up from a stream of observations; the batch view is its oracle."""
    from rosterloom.plans.views import identity

    schema = table(spark, d, "contacts").schema
    folder = new_path(spark, "stream")
    store = StateStore(spark, folder + "/state")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/contacts.parquet")
    is_folder = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4)
    # a stream reads folders: a table of one file is picked out of its folder by name
    rows = source.option("pathGlobFilter", "*.parquet").parquet(f"{d}/contacts.parquet") if is_folder else source.option("pathGlobFilter", "contacts.parquet").parquet(d)
    rows = rows.select(identity().alias("identity"), "contact_id", us("observed_at").alias("observed"))
    query = rows.writeStream.foreachBatch(store.apply).option("checkpointLocation", folder + "/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    return store.read().select("identity", "latest_id", "observations", "last_seen")


_FAM = "select page_id, institution_id, url, s.family family, s.score score from (select page_id, institution_id, url, list_sort([" + ", ".join(
    "{'score': " + " + ".join(f"contains(u, '{t}')::int * 26 + contains(t, '{t}')::int * 8" for t in terms) + f", 'rank': {-rank}, 'family': '{name}'}}" for rank, (name, terms) in enumerate(FAMILIES.items())
) + ", {'score': 1, 'rank': -99, 'family': 'generic'}], 'desc')[1] s from (select *, lower(url) u, lower(substring(visible_text, 1, 1200)) t from acquired_pages))"


def _queries() -> dict:
    from rosterloom.plans.scalars import _NET, _PATH, _SCHEME
    from rosterloom.plans.views import _OBS_SQL

    u = {"u": "url"}
    depth = "len(list_filter(string_split(" + _PATH.format(**u) + ", '/'), lambda x: x <> ''))"
    address = f"{_SCHEME.format(**u)} || '://' || {_NET.format(**u)} || case when {_PATH.format(**u)} = '' then '/' else {_PATH.format(**u)} end || case when regexp_extract(url, '\\?([^#]*)', 1) = '' then '' else '?' || regexp_extract(url, '\\?([^#]*)', 1) end"
    return {
        "page_family": (page_family, f"select page_id, family, score from ({_FAM})"),
        "candidate_order": (candidate_order, f"select institution_id, row_number() over (partition by institution_id order by score desc, {depth}, url, page_id)::int position, page_id from ({_FAM}) qualify position <= 10"),
        "url_dedup": (url_dedup, f"select {address} address, arg_max(page_id, (score, -page_id)) page_id, max(score) score, array_to_string(list_sort(list(distinct family)), ',') families, count(*) n from ({_FAM}) group by 1"),
        "quota_compose": (quota_compose, f"with q as (select *, row_number() over (partition by institution_id, family order by score desc, page_id) k from ({_FAM})) select institution_id, row_number() over (partition by institution_id order by score desc, page_id)::int position, page_id, family from q where k <= case family when 'international' then 3 when 'directory' then 2 when 'contact' then 2 else 1 end qualify position <= 6"),
        "pruned_candidates": (pruned_candidates, "with f as (select url, arg_min(page_id, (epoch_us(fetched_at), page_id)) f, bool_or(coalesce(http_status, 0) in (404, 410, 451)) dead from acquired_pages group by 1) select page_id, case when regexp_matches(url, '(?i)\\.(?:pdf|jpe?g|png|gif|svg|webp|ico|css|js|zip|gz|docx?|xlsx?|pptx?|mp[34]|avi|mov|woff2?)(?:$|[?#])') then 'asset' when page_id <> f then 'visited' when dead then 'dead_url' else '' end reason from acquired_pages join f using (url)"),
        "shell_pages": (shell_pages, "select extraction_id, embedded_document_count >= 1 and coalesce(case when page_length > 0 then visible_text_length::double / page_length end, 1) <= 0.06 and mailto_count = 0 shell from fetched_extractions"),
        "promising_pages": (promising_pages, "select page_id, (contains(t, 'international') or contains(t, 'mobility') or contains(t, 'admissions')) and contains(t, '@') promising, greatest(1, floor(length(t0) / 4))::int tokens from (select page_id, lower(visible_text) t, visible_text t0 from acquired_pages)"),
        "ordered_union": (ordered_union, "select extraction_id, array_to_string(case when list_contains(acquisition_modes, acquisition_mode) then acquisition_modes else list_append(acquisition_modes, acquisition_mode) end, '>') modes from fetched_extractions join acquired_pages using (page_id)"),
        "html_visible_text": (html_visible_text, "select page_id, sha1(array_to_string(list_filter(list_transform(string_split(visible_text, chr(10)), lambda x: trim(regexp_replace(x, '[\\s\\x{00a0}]+', ' ', 'g'), ' ')), lambda x: x <> ''), chr(10))) \"text\" from acquired_pages"),
        "streamed_state": (streamed_state, f"select identity, arg_max(contact_id, (observed, contact_id)) latest_id, count(*) observations, max(observed) last_seen from ({_OBS_SQL}) group by 1"),
    }


QUERIES = _queries()
