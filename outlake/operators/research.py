"""Research history of companies: runs, bullets, criteria, news, contacts by criteria."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from outlake.functions.people import domain_matches_name, is_noted_match, noted_terms, page_mentions_company

MOST_RUNS, MOST_NEWS, MOST_BULLETS = 10, 10, 8
#: Pages of less text don't count; of a page and of a company so much is read.
LEAST_PAGE, PAGE_CHARS, COMPANY_CHARS = 80, 5_000, 24_000


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def norm(text: Column) -> Column:
    """What makes two wordings the same bullet: letters and digits in lower case."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def kept_runs(runs: DataFrame, most: int = MOST_RUNS) -> DataFrame:
    """The last ``most`` runs of each company: a run replaces earlier ones of its job, runs without a job replace nothing.
    ``runs`` has company_id, run_id (their order) and job_id."""
    job = F.coalesce("job_id", F.concat(F.lit("run:"), F.col("run_id").cast("string")))
    last = runs.withColumn("n", F.row_number().over(W.partitionBy("company_id", job).orderBy(F.desc("run_id")))).where("n = 1")
    return last.withColumn("n", F.row_number().over(W.partitionBy("company_id").orderBy(F.desc("run_id")))).where(F.col("n") <= most).drop("n")


def distinct_in_order(value: Column, order: Column, most: int | None = None) -> Column:
    """Aggregate: distinct values in the order of their first appearance; nulls are left out."""
    pairs = F.array_sort(F.collect_set(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
    values = F.array_distinct(F.transform(pairs, lambda x: x["v"]))
    return values if most is None else F.slice(values, 1, most)


def consolidated(companies: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per company: its runs, criteria in order, first and last date, latest estimate and distinct news."""
    label = F.nullif(squeezed(F.col("criteria")), F.lit(""))
    firsts = runs.withColumn("label", label).withColumn("key", norm(F.col("news")))
    news = firsts.groupBy("company_id", "key").agg(F.min("run_id").alias("at"), F.min_by("news", "run_id").alias("text"))
    # ranks with a limit: Spark cuts each group before it is sent, and only so many are gathered
    first = F.row_number().over(W.partitionBy("company_id").orderBy("at", "text"))
    news = news.withColumn("r", first).where(F.col("r") <= MOST_NEWS).groupBy("company_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("news"))
    labels = firsts.where("label is not null").groupBy("company_id", "label").agg(F.min("run_id").alias("at"))
    labels = labels.groupBy("company_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]).alias("criteria"))
    g = runs.groupBy("company_id").agg(
        F.count("*").alias("run_count"), F.min("researched_at").alias("first_researched_at"), F.max("researched_at").alias("last_researched_at"),
        F.max_by("employee_estimate", F.when(F.col("employee_estimate").isNotNull(), F.col("run_id"))).alias("employee_estimate"),
    )
    none = F.array().cast("array<string>")
    out = companies.select("company_id", "name").join(g, "company_id", "left").join(labels, "company_id", "left").join(news, "company_id", "left")
    return out.withColumns({"run_count": F.coalesce("run_count", F.lit(0)), "criteria": F.coalesce("criteria", none), "news": F.coalesce("news", none)})


def in_report_order() -> list[Column]:
    """Companies with runs first, the last researched first, then by name."""
    return [(F.col("run_count") > 0).desc(), F.desc_nulls_last("last_researched_at"), F.col("name"), F.col("company_id")]


def bullets(runs: DataFrame) -> DataFrame:
    """Runs' bullets, one row each: ``company_id, run_id, category, place, text``."""
    each = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(i).alias("place"), squeezed(F.col(k)).alias("text")) for i, (c, k) in enumerate((("changes", "bullet_1"), ("changes", "bullet_2"), ("policies", "bullet_3")))])
    return runs.select("company_id", "run_id", F.nullif(squeezed(F.col("criteria")), F.lit("")).alias("label"), F.explode(each).alias("b")).select("company_id", "run_id", "label", "b.*")


def merged_bullets(rows: DataFrame) -> DataFrame:
    """Bullets across runs: the first wording stays, with the criteria that led to it in order."""
    keyed = rows.withColumn("key", norm(F.col("text"))).where("key <> ''").withColumn("order", F.struct("run_id", "place"))
    texts = keyed.groupBy("company_id", "category", "key").agg(F.min_by("text", "order").alias("text"), F.min("order").alias("order"))
    labels = keyed.where("label is not null").groupBy("company_id", "category", "key", "label").agg(F.min("order").alias("at"))
    labels = labels.groupBy("company_id", "category", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]).alias("criteria"))
    return texts.join(labels, ["company_id", "category", "key"], "left").withColumn("criteria", F.coalesce("criteria", F.array().cast("array<string>")))


def bullets_per_run(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run_id").agg(F.count("*").alias("n"))


def latest_bullets(rows: DataFrame, most: int = MOST_BULLETS) -> DataFrame:
    """Per company and category the distinct texts of the latest runs before those of prior ones, ``most`` of them."""
    once = rows.groupBy("company_id", "category", "text").agg(F.min(F.struct((-F.col("run_id")).alias("o"), F.col("place"))).alias("at"))
    n = F.row_number().over(W.partitionBy("company_id", "category").orderBy("at", "text"))
    return once.withColumn("place", n.cast("long")).where(F.col("place") <= most).select("company_id", "category", "place", "text")


def by_criteria(contacts: DataFrame) -> DataFrame:
    """Contacts by the criteria term that found them, whatever its case: ``company_id, term, contact_id``; a contact may
    be under several, an unlabelled match is under ``Criteria match``, others under a null term."""
    terms = noted_terms(F.col("notes"))
    shown = F.when(F.size(terms) > 0, terms).when(is_noted_match(F.col("notes")), F.array(F.lit("Criteria match"))).otherwise(F.array(F.lit(None).cast("string")))
    long = contacts.select("company_id", "contact_id", F.posexplode(shown).alias("place", "term"))
    first = long.groupBy("company_id", F.lower("term").alias("key")).agg(F.min_by("term", F.struct("contact_id", "place")).alias("label"))
    once = long.select("company_id", "contact_id", F.lower("term").alias("key")).distinct()
    same = once["company_id"].eqNullSafe(first["company_id"]) & once["key"].eqNullSafe(first["key"])
    return once.join(first, same).select(once["company_id"], F.col("label").alias("term"), "contact_id")


def criteria_totals(contacts: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(c).cast("long")
    return contacts.groupBy("company_id").agg(
        F.count("*").alias("total"), n(F.trim("address") != "").alias("with_email"), n(F.coalesce(F.col("profile"), F.lit("")) != "").alias("with_profile"),
        n((F.size(noted_terms(F.col("notes"))) > 0) | is_noted_match(F.col("notes"))).alias("matched"),
    )


def quality_tier(summary: Column, pages: Column, someone: Column) -> Column:
    """high: a summary, four pages and a named or titled person; medium: a summary and two pages; else low."""
    has = F.coalesce(summary, F.lit("")) != ""
    return F.when(has & (pages >= 4) & someone, "high").when(has & (pages >= 2), "medium").otherwise("low")


def company_pages(pages: DataFrame, key: str, text: Column, order: str) -> DataFrame:
    """Page texts of a key in order, joined and cut: short pages don't count, each is cut first.

    Only as many pages as may fit are sent and gathered, so no key's pages are collected whole.
    """
    rows = pages.select(key, F.col(order).alias("__order"), F.substring(text, 1, PAGE_CHARS).alias("__text")).where(F.length("__text") > LEAST_PAGE)
    rank = F.row_number().over(W.partitionBy(key).orderBy("__order"))
    rows = rows.withColumn("__rank", rank).where(F.col("__rank") <= COMPANY_CHARS // LEAST_PAGE)
    ahead = F.sum(F.length("__text") + 2).over(W.partitionBy(key).orderBy("__order").rowsBetween(W.unboundedPreceding, -1))
    fit = rows.where(F.length("__text") > 0).withColumn("__ahead", F.coalesce(ahead, F.lit(0))).where(F.col("__ahead") < COMPANY_CHARS)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__order", "__text"))), lambda x: x["__text"]), "\n\n")
    return fit.groupBy(key).agg(F.count("*").alias("pages"), F.substring(joined, 1, COMPANY_CHARS).alias("text"))


def site_identity(companies: DataFrame, corpus: DataFrame, contacts: DataFrame) -> DataFrame:
    """``company_id, verified, contacts, mismatch`` (J15): whether a company's site is its own, by its domain or by the texts
    of the site's pages taken together (see ``company_pages``); what was found on another company's site is dropped.

    ``companies`` has company_id, name, domain and site, ``corpus`` site and text, ``contacts`` company_id and contact_id.
    A site without pages names nobody.
    """
    found = contacts.groupBy("company_id").agg(F.count("*").alias("n"))
    at = companies.join(corpus.select("site", "text"), "site", "left").join(found, "company_id", "left")
    ours = domain_matches_name(F.col("name"), F.col("domain")) | page_mentions_company(F.col("name"), F.col("text"))
    at = at.withColumn("verified", F.coalesce(ours, F.lit(False)))
    return at.select("company_id", "verified", F.when(F.col("verified"), F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("contacts"), F.when(~F.col("verified"), F.coalesce("domain", "site")).alias("mismatch"))
