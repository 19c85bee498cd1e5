"""Quality rules with adaptive thresholds: fences from mergeable KLL sketches per language and source.

Every rule compares a ratio of the document with the spread of that ratio among the documents of its language and
source: above ``q3 + SPREAD * (q3 - q1) + slack`` (for the mean word length also below the mirrored fence) it fails.
The sketches are built where the rows are and merged after the shuffle, so a source with a third of all rows costs no
more than another.  Groups of fewer than ``ENOUGH`` documents take the merged sketch of their language, languages of
fewer take the merged sketch of everything.  The fences (one row for each language and source) are written out and
joined; Spark broadcasts them below its size threshold and shuffles beyond it.

Defined results: null text has no words and fails the base rule; null languages and sources are groups of their own;
empty tables give empty results; ties and repeated rows are judged row by row; texts are read whole and their repeated
windows compared word by word, whatever their length; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlake.llm.common import save

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SKETCH_K = 1024
ENOUGH = 100
SPREAD = 6.0
#: The rule's ratio and how far beyond the fence it may be: ratios of groups without spread stay usable.
SLACK = {"symbol_ratio": 0.1, "upper_ratio": 0.2, "dup_line_ratio": 0.5, "word_length": 1.5}
TWO_SIDED = ("word_length",)

_WORDS = r"array_remove(split(body, '[\\x20\\x09-\\x0D]+'), '')"
_LINES = r"filter(split(body, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"


def with_metrics(docs: DataFrame, text_col: str = "text", repeats: bool = True) -> DataFrame:
    """``docs`` as a struct column ``doc`` and its base counts as a struct of longs, ``m`` (``n_repeat_words`` only with
    ``repeats``).

    The counts come out of a generator over one struct for each row: filters and projections of the caller aren't
    moved below it, where they would have the arrays built again for every use.
    """
    d = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own = F.struct(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
    text = F.col(f"c{docs.columns.index(text_col)}")
    d = d.select(own.alias("doc"), F.coalesce(text.cast("string"), F.lit("")).alias("body"))
    d = d.select("doc", "body", F.expr(_WORDS).alias("w"), F.expr(_LINES).alias("l"))
    d = d.select(
        "doc", "w",
        F.expr("bigint(size(w))").alias("n_words"),
        F.expr(r"bigint(char_length(regexp_replace(body, '[\\x20\\x09-\\x0D]+', '')))").alias("word_chars"),
        F.expr(r"bigint(regexp_count(body, '[#*$%&|<>]'))").alias("n_symbols"),
        F.expr(r"bigint(regexp_count(body, '\\p{Lu}'))").alias("n_upper"),
        F.expr("bigint(size(l))").alias("n_lines"),
        F.expr("bigint(size(l) - size(array_distinct(l)))").alias("n_dup_lines"),
        # bits that a position takes; the rest of the 64 bits holds the window's hash
        F.expr("char_length(bin(size(w)))").alias("bits"),
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines"]
    if not repeats:
        return d.select("doc", F.explode(F.array(F.struct(*counts))).alias("m"))
    d = d.withColumn(
        "windows",
        F.expr(
            "case when n_words < 3 then cast(array() as array<bigint>) else sort_array(transform(sequence(0, size(w) - 3), i -> "
            "shiftleft(shiftrightunsigned(xxhash64(w[i], w[i + 1], w[i + 2]), bits), bits) | bigint(i))) end"
        ),
    )
    # windows whose hashes agree in the bits that are left, and of these the ones whose words agree
    d = d.withColumn(
        "maybe",
        F.expr(
            "filter(windows, (x, k) -> (k > 0 and shiftrightunsigned(windows[k - 1], bits) = shiftrightunsigned(x, bits)) or "
            "(k < size(windows) - 1 and shiftrightunsigned(windows[k + 1], bits) = shiftrightunsigned(x, bits)))"
        ),
    )
    d = d.withColumn("at", F.expr("transform(maybe, x -> int(x & (shiftleft(1L, bits) - 1)))"))
    d = d.withColumn("named", F.expr("sort_array(transform(at, i -> struct(struct(w[i] as a, w[i + 1] as b, w[i + 2] as c) as words, i as i)))"))
    d = d.withColumn(
        "again",
        F.expr("filter(named, (x, k) -> (k > 0 and named[k - 1].words = x.words) or (k < size(named) - 1 and named[k + 1].words = x.words)).i"),
    )
    d = d.withColumn("n_repeat_words", F.expr("bigint(size(array_distinct(flatten(transform(again, i -> array(i, i + 1, i + 2))))))"))
    return d.select("doc", F.explode(F.array(F.struct(*counts, "n_repeat_words"))).alias("m"))


def _ratios() -> dict[str, Column]:
    words = F.greatest(F.col("m.n_words"), F.lit(1)).cast("double")
    return {
        "symbol_ratio": F.col("m.n_symbols") / words,
        "upper_ratio": F.col("m.n_upper") / F.greatest(F.col("m.word_chars"), F.lit(1)).cast("double"),
        "dup_line_ratio": F.col("m.n_dup_lines") / F.greatest(F.col("m.n_lines"), F.lit(1)).cast("double"),
        "word_length": F.col("m.word_chars") / words,
    }


def fences(measured: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source`` and for each rule ``<rule>_lo, <rule>_hi``, from rows that pass the base rule's word count."""
    rows = measured.where(F.col("m.n_words") >= MIN_WORDS).select(
        F.col("doc")[lang_col].cast("string").alias("lang"), F.col("doc")[source_col].cast("string").alias("source"), *[c.alias(k) for k, c in _ratios().items()]
    )
    own = save(rows.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(k, F.lit(SKETCH_K)).alias(k) for k in SLACK]))
    merged = lambda g: g.agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(k, F.lit(SKETCH_K)).alias(k) for k in SLACK])
    by_lang = save(merged(own.groupBy("lang")))
    everything = merged(by_lang.groupBy())
    o, g = own.alias("o"), by_lang.alias("g")
    at = o.join(g, F.col("o.lang").eqNullSafe(F.col("g.lang")))
    # one sketch of bounded size: a scalar subquery
    pick = lambda k: F.when(F.col("o.n") >= ENOUGH, F.col(f"o.{k}")).when(F.col("g.n") >= ENOUGH, F.col(f"g.{k}")).otherwise(everything.select(k).scalar())
    out = at.select("o.lang", "o.source", *[pick(k).alias(k) for k in SLACK])
    quantile = lambda k, q: F.kll_sketch_get_quantile_double(k, F.lit(q))
    bounds = []
    for k, slack in SLACK.items():
        q1, q3 = quantile(k, 0.25), quantile(k, 0.75)
        bounds.append((q1 - SPREAD * (q3 - q1) - slack if k in TWO_SIDED else F.lit(float("-inf"))).alias(f"{k}_lo"))
        bounds.append((q3 + SPREAD * (q3 - q1) + slack).alias(f"{k}_hi"))
    return save(out.select("lang", "source", *bounds))


def judged(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: the struct ``doc`` (the row itself) and the struct ``quality`` (the base counts,
    ``base_failed`` and ``kept``).  Both are structs, so that no column of ``docs`` can clash with one of ours."""
    measured = with_metrics(docs, text_col)
    limits = fences(with_metrics(docs, text_col, repeats=False), lang_col, source_col)
    lang, source = (F.col("doc")[c].cast("string") for c in (lang_col, source_col))
    at = measured.join(limits, lang.eqNullSafe(F.col("lang")) & source.eqNullSafe(F.col("source")), "left")
    m = F.col("m")
    failed = (m.n_words < MIN_WORDS) | (100 * m.n_repeat_words > MAX_REPEAT_PERCENT * m.n_words)
    fine = F.lit(True)
    for k, ratio in _ratios().items():
        fine &= F.coalesce(ratio.between(F.col(f"{k}_lo"), F.col(f"{k}_hi")), F.lit(True))
    return at.select("doc", F.struct("m.*", failed.alias("base_failed"), (~failed & fine).alias("kept")).alias("quality"))


def quality_filter(docs: DataFrame, **cols: str) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    return judged(docs, **cols).where("quality.kept").select("doc.*")
