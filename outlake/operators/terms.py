"""Many terms looked up in many texts, and quotes in pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlake.functions.text import addresses_in
from outlake.sources.store import written

# Short words of titles that count in a term.
SHORT = "vp svp evp avp cto ceo coo cfo cpo cmo cio chro hr ml ai ux qa".split()
QUOTES = 256  # so many quotes are looked up in a page at once


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def found_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``text_id, term_id`` of every term that a text holds, each pair once.

    ``texts`` has text_id, role and evidence; ``terms`` term_id, term and place.  A term of place ``role`` needs all its
    words of three letters or more (or well-known short ones) in the role, in any order; if it has none, all its words in
    order.  One of place ``education`` needs its words one after another in role or evidence.

    An inverted index: words of texts, once per text and place, meet the terms by each term's rarest word; what meets is
    checked word by word.  The plan doesn't grow with the terms, and frequent words lead nowhere.
    """
    # "merge": files of words that repeat are small on disk and say little of the rows in memory, so no broadcasts go by them
    role, both = words(F.col("role")), words(F.concat_ws(" ", "role", "evidence"))
    at = written(texts.select("text_id", F.explode(F.array(F.struct(F.lit("role").alias("place"), role.alias("words")), F.struct(F.lit("education").alias("place"), both.alias("words")))).alias("x")).select("text_id", "x.place", "x.words"))
    index = at.select("text_id", "place", F.explode(F.array_distinct("words")).alias("word"))
    all_words = words(F.col("term"))
    telling = F.filter(all_words, lambda w: (F.length(w) >= 3) | w.isin(*SHORT))
    loose = (F.col("place") == "role") & (F.size(telling) > 0)
    asked = written(terms.select("term_id", "place", loose.alias("loose"), F.when(loose, F.array_distinct(telling)).otherwise(all_words).alias("asked")).where(F.size("asked") > 0))
    counts = index.groupBy("place", "word").agg(F.count("*").alias("n"))
    each = asked.select("term_id", "place", F.explode(F.array_distinct("asked")).alias("word")).join(counts.hint("merge"), ["place", "word"], "left")
    # a word that no text has rules its term out, and is the rarest
    rarest = each.groupBy("term_id", "place").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    keyed = asked.join(rarest.hint("merge"), ["term_id", "place"])
    met = index.hint("merge").join(keyed, ["place", "word"]).join(at.hint("merge"), ["text_id", "place"])
    # blanks around the words make a phrase a part of the text's words
    joined = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    fits = F.when(F.col("loose"), F.size(F.array_except("asked", "words")) == 0).otherwise(F.contains(joined("words"), joined("asked")))
    return met.where(fits).select("text_id", "term_id").distinct()


def criteria_scores(people: DataFrame, terms: DataFrame) -> DataFrame:
    """``contact_id, score, matched, alumni_match``: which share of the criteria (``terms``: criterion, term, place; a
    school's other names are further terms of its criterion) a person meets.  ``people`` has contact_id, title, evidence."""
    named = written(terms.select("criterion", "place", "term", F.struct("criterion", "term", "place").alias("term_id")).distinct())
    n = named.select("criterion").distinct().count()
    texts = people.select(F.col("contact_id").alias("text_id"), F.col("title").alias("role"), "evidence")
    hits = found_terms(texts, named.select("term_id", "term", "place"))
    per = hits.groupBy("text_id").agg(
        F.array_sort(F.collect_set("term_id.criterion")).alias("matched"), F.bool_or(F.col("term_id.place") == "education").alias("alumni_match")
    )
    out = people.select("contact_id").join(per, F.col("contact_id") == F.col("text_id"), "left")
    return out.select("contact_id", F.round(F.coalesce(F.size("matched"), F.lit(0)) / max(n, 1), 3).alias("score"), F.array_join(F.coalesce("matched", F.array().cast("array<string>")), "|").alias("matched"), F.coalesce("alumni_match", F.lit(False)).alias("alumni_match"))


def caseless(text: Column) -> Column:
    """Text as it is compared whatever its case: letters that become several ones (ß is SS) or that have several small forms
    included.  Capitals with a small form that isn't theirs alone (ẞ, the sign of Kelvin) need both steps, and Spark drops
    the first if nothing stands between."""
    return F.upper(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")))


def grounded(records: DataFrame, pages: DataFrame) -> DataFrame:
    """``record_id, email`` of extracted records that their page bears out: the address is one of the page's (and is given
    as the page writes it), a quote of 20 characters or more stands there literally whatever the case and blanks, and so
    does the source, if one is named.

    ``records`` has record_id, page_id, email, quote and source_url; ``pages`` page_id and text.  Records go to their
    page in groups of ``QUOTES``, so that a page's text is sent once for so many records and none is gathered without bound.
    """
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    clean = records.select(
        "record_id", "page_id", F.lower(F.trim(F.coalesce("email", F.lit("")))).alias("email"), squeeze(F.coalesce("quote", F.lit(""))).alias("quote"), F.trim(F.coalesce("source_url", F.lit(""))).alias("source")
    ).where("email <> '' and length(lower(quote)) >= 20").withColumn("quote", caseless(F.col("quote")))
    sizes = clean.groupBy("page_id").agg(F.ceil(F.count("*") / QUOTES).alias("parts"))
    parted = clean.join(sizes, "page_id").withColumn("part", F.pmod(F.xxhash64("record_id"), "parts"))
    asked = parted.groupBy("page_id", "part").agg(F.collect_list(F.struct("record_id", "email", "quote", "source")).alias("asked"))
    known = pages.select("page_id", "text", caseless(squeeze(F.col("text"))).alias("squeezed"), addresses_in(F.col("text")).alias("known"))
    at = asked.join(known, "page_id").select("text", "squeezed", "known", F.explode("asked").alias("r"))
    written_as = F.get(F.filter("known", lambda x: F.lower(x) == F.col("r.email")), F.lit(0))
    fits = written_as.isNotNull() & F.contains("squeezed", "r.quote") & ((F.col("r.source") == "") | F.contains("text", "r.source"))
    return at.where(fits).select("r.record_id", written_as.alias("email"))
