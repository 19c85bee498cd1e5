"""URL filter: rules first, then naive Bayes over segmented host words and path words.

Host labels are split into words by a unigram Viterbi search; word counts come from the texts of all pages, plus
``SEED_COUNT`` for each seed word.  Only words that occur inside some host label are joined, so the search has at most
as many words as the label has substrings.  Naive Bayes learns from the pages themselves: hosts with two seed words
or a strong one are examples of what to block, the others of what to allow.  Hosts and path shapes (digits count
alike) are scored once each; pages get their sum.

The labels come from a lexicon; what naive Bayes adds are the words and paths that go with labelled hosts.  The lexicon
is also the prior of the word counts: a listed word counts as ``PRIOR`` pages to block that were seen before.  A host
without a label is judged by what other hosts say about its words (its own pages don't count as harmless), and blocked
only if one of its words is ``EVIDENCE`` times as frequent with labelled hosts as with others.  So a single weak word
blocks its host unless other harmless hosts use it as well: enough of their pages overrule the lexicon.

Defined results: a url that is null or has no ``://`` has an empty host and path, fits no rule and is allowed; so is a
host without words; null pages have no words; ties go to allow; repeated rows are judged alike; urls and labels are read
whole, whatever their length (words of more than ``LONGEST`` characters fit no host label); empty tables give empty
results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlake.llm.common import save

#: (host, path, verdict); the longest rule that fits wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
# Words of hosts that are usually blocked; strong ones suffice alone.
STRONG = "casino pills viagra porn xxx bets betting poker spam jackpot slots gambling escort malware phishing warez".split()
WEAK = "cheap free win winner ads track tracker farm click loans lottery replica bonus deals adult dating pharma crack torrent popup offer".split()
SEED_COUNT = 50
LONGEST = 63  # a host label has no more characters
PRIOR = 8  # so many pages to block that a listed word is taken to have been on
EVIDENCE = 5.0  # so many times as often with labelled hosts as with others
UNKNOWN = -2.5  # log10 of an unknown character's share, besides one count in all


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    has = F.locate("://", text) > 0
    rest = F.when(has, F.substring(text, F.locate("://", text) + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def segment(label: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable words of ``label``; characters of no word stand alone and cost more than any word."""
    unknown = UNKNOWN - math.log10(total)
    best: list[tuple[float, int]] = [(0.0, 0)] + [(-math.inf, 0)] * len(label)
    for i in range(len(label)):
        here = best[i][0]
        for j in range(i + 1, min(len(label), i + LONGEST) + 1):
            n = counts.get(label[i:j])
            score = here + (math.log10(n / total) if n else unknown if j == i + 1 else -math.inf)
            if score > best[j][0]:
                best[j] = (score, i)
    out, j = [], len(label)
    while j:
        i = best[j][1]
        out.append(label[i:j])
        j = i
    return out[::-1]


def _segments(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for label, found in zip(batch.column("label").to_pylist(), batch.column("found").to_pylist(), strict=True):
                out.append([w for w in segment(label, {x["word"]: x["n"] for x in found}, total) if len(w) > 1])
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(out, pa.list_(pa.string()))], ["label", "words"])

    return run


def host_words(hosts: DataFrame, texts: DataFrame) -> DataFrame:
    """``host, words`` for each row of ``hosts(host)``; ``texts(text)`` are the pages' texts."""
    seeds = hosts.sparkSession.createDataFrame([(w, SEED_COUNT) for w in STRONG + WEAK], "word string, n long")
    words = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    # words with their count; a lone letter is no word
    counts = save(words.where(f"length(word) between 2 and {LONGEST}").groupBy("word").agg(F.count("*").alias("n")).unionByName(seeds).groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0]
    labels = hosts.select("host", F.explode(F.split("host", r"[^a-z0-9]+")).alias("label")).where("length(label) > 0").distinct()
    each = labels.select("label").distinct()
    inside = each.select(
        "label",
        F.explode(F.expr(f"array_distinct(flatten(transform(sequence(1, length(label)), i -> transform(sequence(1, least({LONGEST}, length(label) - i + 1)), k -> substring(label, i, k)))))")).alias("word"),
    )
    found = each.join(inside.join(counts, "word").groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("found")), "label", "left")
    found = found.select("label", F.coalesce("found", F.expr("cast(array() as array<struct<word: string, n: bigint>>)")).alias("found"))
    cut = found.mapInArrow(_segments(total), "label string, words array<string>")
    return labels.join(cut, "label").groupBy("host").agg(F.flatten(F.collect_list("words")).alias("words"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` (above 0: block)."""
    host, path = parsed(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    shape = F.regexp_replace(F.lower("path"), "[0-9]+", "0")
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), shape.alias("shape"))
    groups = save(rows.groupBy("host", "shape").agg(F.count("*").alias("n")))
    texts = pages.select(F.regexp_replace(F.col(html_col).cast("string"), "(?s)<[^>]*>", " ").alias("text"))
    hosts = save(host_words(groups.where("host <> ''").select("host").distinct(), texts))
    listed = lambda ws: F.array(*[F.lit(w) for w in ws])
    seeded = (F.size(F.array_intersect("words", listed(STRONG))) > 0) | (F.size(F.array_intersect("words", listed(STRONG + WEAK))) > 1)
    hosts = save(hosts.withColumn("bad", seeded))
    path_words = F.array_remove(F.split("shape", "[^a-z0-9]+"), "")
    known = groups.join(hosts, "host").withColumn("word", F.explode(F.concat("words", F.transform(path_words, lambda w: F.concat(F.lit("/"), w)))))
    counted = save(known.groupBy("word").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("a")).select("word", (F.col("b") + F.when(F.col("word").isin(STRONG + WEAK), PRIOR).otherwise(0)).alias("b"), "a"))
    t = counted.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.count("*").alias("v")).first()
    p = groups.join(hosts, "host").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("b"), F.sum("n").alias("n")).first()
    bad, every = p.b or 0, p.n or 0
    prior = math.log((bad + 1) / (every - bad + 1))
    weight = lambda b, a: F.log((b + 1) / F.lit(float(t.b + t.v + 1))) - F.log((a + 1) / F.lit(float(t.a + t.v + 1)))

    # a host without a label is judged by what other hosts say about its words
    pages_of = groups.where("host <> ''").groupBy("host").agg(F.sum("n").alias("pages"))
    each = hosts.join(pages_of, "host").select("host", "bad", "pages", F.explode("words").alias("word")).groupBy("host", "bad", "pages", "word").agg(F.count("*").alias("k"))
    own = F.when(F.col("bad"), 0).otherwise(F.col("pages") * F.col("k"))
    # against a listed word only other hosts' pages speak, against any other word the host's own too
    against = F.col("a") - F.when(F.col("word").isin(STRONG + WEAK), own).otherwise(0)
    said = each.join(counted, "word").withColumn("evidence", F.col("bad") | (weight(F.col("b"), against) >= math.log(EVIDENCE)))
    said = said.withColumn("a", F.col("a") - own)
    sums = said.groupBy("host").agg(F.sum(F.when(F.col("a") + F.col("b") > 0, F.col("k") * weight(F.col("b"), F.col("a")))).alias("host_score"), F.bool_or("evidence").alias("evidence"))
    host_score = save(sums.select("host", F.coalesce("host_score", F.lit(0.0)).alias("host_score"), "evidence"))
    shapes = groups.select("shape").distinct().select("shape", F.explode(F.transform(path_words, lambda w: F.concat(F.lit("/"), w))).alias("word"))
    path_score = save(shapes.join(counted, "word").groupBy("shape").agg(F.sum(weight(F.col("b"), F.col("a"))).alias("path_score")))
    out = rows.join(host_score, "host", "left").join(path_score, "shape", "left")
    score = F.lit(prior) + F.coalesce("host_score", F.lit(0.0)) + F.coalesce("path_score", F.lit(0.0))
    said = F.when((score > 0) & F.coalesce("evidence", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", said).alias("verdict"), score.alias("score"))
