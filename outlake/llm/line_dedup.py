"""Line dedup by an exact set-similarity join: the first of matching lines stays, later matches go.

A line's tokens are its distinct lower-cased words.  A line goes when an earlier line (by document id, then by place)
has a Jaccard similarity of ``PERCENT`` or more; lines of fewer than ``MIN_TOKENS`` tokens stay.

1. The texts are split into words once, and the tokens (64-bit hashes of the words) of every line are saved.  The lines
   of each token are counted in a fixed number of hash buckets; the buckets' levels (an array of ``BUCKETS`` numbers,
   whatever the corpus) order the tokens of every line by rarity.  Any fixed order makes the prefix filter exact; rarity
   makes it selective.
2. Lines with equal token sets form a class, of which only the first line takes part in the join, so common lines
   cost one row.
3. Lines with the same smallest, or the same largest, token hash are compared with the first of them only.  What is
   similar to it goes; so most of a large group of near copies is settled by a number of pairs in proportion to it.
4. For the lines that are still undecided the join is exact: two similar classes share a token among the rarest few of
   each (prefix filter).  The join on these tokens drops pairs by length, by what can still follow a token's position,
   and by a 64-bit parity map of the tokens, whose Hamming distance is never above the size of the symmetric
   difference.  All three are exact bounds.
5. Candidates of both steps are verified on the tokens of the whole lines, which are read back from the texts.

Everything is DataFrame operations.  Defined results: null texts stay null; rows with a null id are left as they are
and match nothing; a row is told by its id and text, so repeated rows are treated alike; lines of any length are compared
whole; empty tables give empty results; other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlake.llm.common import drop, save

PERCENT = 85
MIN_TOKENS = 5
BUCKETS = 1 << 17
REST = 64 - 17  # bits of a hash below its bucket
_LINE = ["id", "hash", "line"]
_SET = ["set", "least", "most", "n"]  # what tells a line's token set: a hash, its smallest and largest token and its size


def _spaced(low: Column) -> Column:
    """A space for each blank but line breaks, so that splits at a single character need no pattern.  Most texts hold no
    such blank, and looking for one is cheaper than replacing; ``low`` is a column, as it is used several times."""
    out, found = low, F.lit(False)
    for blank in ("\t", "\x0b", "\x0c", "\r"):
        out, found = F.replace(out, F.lit(blank), F.lit(" ")), found | F.contains(low, F.lit(blank))
    return F.when(found, out).otherwise(low)


def _split_lines(texts: DataFrame, *cols: str) -> DataFrame:
    """``cols`` and one row per line: its place ``line`` and its ``words`` in lower case, with spaces as blanks."""
    low = texts.select(*cols, F.lower("text").alias("low"))
    return low.select(*cols, F.posexplode_outer(F.split(_spaced(F.col("low")), "\n")).alias("line", "words"))


def _tokens(line: Column) -> Column:
    """Hashes of a line's distinct words."""
    hashed = F.transform(F.split(line, " "), lambda w: F.xxhash64(w))
    return F.array_remove(F.array_distinct(hashed), F.xxhash64(F.lit("")))


def _token_rows(texts: DataFrame) -> DataFrame:
    """One row per line: where it is, what tells its token set, and the tokens ``t``, sorted."""
    lines = _split_lines(texts, "id", "hash").select(*_LINE, F.sort_array(_tokens(F.col("words"))).alias("t"))
    # never null, as sets are joined by them
    ends = [F.coalesce(F.get("t", at), F.lit(0)).alias(c) for c, at in (("least", F.lit(0)), ("most", F.size("t") - 1))]
    return lines.select(*_LINE, F.xxhash64("t").alias("set"), *ends, F.size("t").alias("n"), "t")


def _levels(tokens: DataFrame) -> Column:
    """For every bucket (the first bits of a hash) what turns them into its level of rarity, 0 to 15, and the rest of the
    bucket, by exclusive or: an octave of the number of lines with the bucket's tokens around the mean number.  Levels
    rise with signed numbers.

    ``BUCKETS`` longs, whatever the corpus, come to the driver as one JSON text and go out as a constant array: a
    subquery can't be used in a lambda, and a joined column would be copied for every line.
    """
    counted = save(tokens.select(F.explode("t").alias("h")).groupBy(F.shiftrightunsigned("h", REST).alias("bucket")).agg(F.count("*").alias("n")))
    mean = F.greatest(F.lit(1.0), F.coalesce(counted.agg(F.sum("n")).scalar(), F.lit(0)) / BUCKETS)
    level = F.least(F.lit(15), F.greatest(F.lit(0), F.floor(F.log2(F.coalesce("n", F.lit(1)) / mean) + 8))).cast("long")
    every = tokens.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket").join(counted, "bucket", "left")
    ranked = level.bitwiseXOR(F.lit(8)) * F.lit(BUCKETS >> 4) + F.col("bucket") % F.lit(BUCKETS >> 4)
    every = every.select("bucket", F.call_function("shiftleft", F.col("bucket").bitwiseXOR(ranked), F.lit(REST)).alias("x"))
    found = every.agg(F.to_json(F.array_sort(F.collect_list(F.struct("bucket", "x")))["x"])).first()[0]
    drop(counted)
    return F.from_json(F.lit(found), "array<bigint>")


def _prefixes(tokens: DataFrame, levels: Column, percent: int) -> DataFrame:
    """``tokens`` with the parity map and the prefix of each line instead of its tokens."""
    # never null, so that the array is sorted as longs and not as objects
    place = lambda h: h.bitwiseXOR(F.coalesce(F.get(levels, F.shiftrightunsigned(h, REST).cast("int")), F.lit(0)))
    return tokens.select(*_LINE, *_SET, F.sort_array(F.transform("t", place)).alias("t")).select(
        *_LINE, *_SET,
        F.expr("aggregate(t, 0L, (a, x) -> a ^ shiftleft(1L, int(x & 63)))").alias("map"),
        F.expr(f"transform(slice(t, 1, size(t) - int(floor((size(t) * {percent} + 99) / 100)) + 1), x -> int(x & 2147483647))").alias("prefix"),
    )


def _need(percent: int) -> str:
    """The least overlap of similar lines ``a`` and ``b``, as SQL."""
    return f"floor(({percent} * (a.n + b.n) + {99 + percent}) / {100 + percent})"


def _bounds(percent: int) -> str:
    """What similar lines ``a`` and ``b`` satisfy, as SQL."""
    return (
        f"100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) "
        f"and bit_count(a.map ^ b.map) <= a.n + b.n - 2 * {_need(percent)}"
    )


def _first_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of a line and the first one with its smallest or largest token hash."""
    rows = classes.select(F.explode(F.array("least", "most")).alias("key"), F.struct(*_LINE).alias("who"), "n", "map")
    heads = save(rows.groupBy("key").agg(F.min(F.struct("who", "n", "map")).alias("x"), F.count("*").alias("k")).where("k > 1").select("key", "x.*"))
    a, b = heads.alias("a"), rows.alias("b")
    near = a.join(b, (F.col("a.key") == F.col("b.key")) & F.expr(f"a.who < b.who and {_bounds(percent)}"))
    out = save(near.select(F.col("a.who").alias("a"), F.col("b.who").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).distinct())
    drop(heads)
    return out


def _candidates(classes: DataFrame, settled: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of first lines, a the earlier one and b not settled, that no bound tells apart."""
    # the condition on settled needs it of both sides (it is never below 0), so that it isn't pushed to one of them, no
    # column is pruned from one, and both read the same exchange
    mark = settled.withColumn("settled", F.lit(1))
    rows = classes.join(mark, _LINE, "left").select(F.posexplode("prefix").alias("at", "token"), *_LINE, "n", "map", F.coalesce("settled", F.lit(0)).alias("settled"))
    a, b = rows.alias("a"), rows.alias("b")
    after = (
        f"{_bounds(percent)} and least(a.n - a.at, b.n - b.at) >= {_need(percent)} "
        "and b.settled <= least(a.settled, 0) and struct(a.id, a.hash, a.line) < struct(b.id, b.hash, b.line)"
    )
    who = lambda side: F.struct(*[F.col(f"{side}.{c}") for c in _LINE]).alias(side)
    return a.join(b, (F.col("a.token") == F.col("b.token")) & F.expr(after)).select(who("a"), who("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The later lines of the pairs that are similar: ``id, hash, line``.  The lines are read back from the texts, and each
    is hashed once; ``pairs`` has the sizes of both sets."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("who")).select("who.*").groupBy("id", "hash").agg(F.collect_set("line").alias("lines"))
    # hashed on the small side at every size: the texts needn't be sorted
    parts = texts.join(wanted.hint("shuffle_hash"), ["id", "hash"]).select("id", "hash", "lines", F.split("text", "\n").alias("l"))
    # l is used twice, or the split would move into the lambda and be done for each line
    parts = parts.select("id", "hash", F.explode(F.expr("if(size(l) > 0, transform(lines, i -> struct(i as line, l[i] as words)), null)")).alias("x"))
    low = parts.select(F.struct("id", "hash", F.col("x.line").alias("line")).alias("who"), F.lower("x.words").alias("low"))
    found = save(low.select("who", _tokens(_spaced(F.col("low"))).alias("t")).dropDuplicates(["who"]))  # repeated rows
    both = pairs.join(found.select(F.col("who").alias("a"), F.col("t").alias("ta")), "a").join(found.select(F.col("who").alias("b"), F.col("t").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    # one use of what is common: the condition is moved below other projections, where it would be computed for each use
    out = save(both.where(common * (100 + percent) >= percent * (F.col("na") + F.col("nb"))).select("b.*").distinct())
    drop(found, pairs)
    return out


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """The lines that go: ``id, hash`` (of the text), ``line`` (from 0)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.where("id is not null and text is not null").withColumn("hash", F.xxhash64("text"))
    every = save(_token_rows(texts))
    # filtered only now: a filter on the size would be pushed down and have the tokens computed twice
    lines = every.where(F.col("n") >= min_tokens)
    # most sets have one line: they are counted away before any minimum of structs, which sorts
    again = save(lines.groupBy(_SET).agg(F.count("*").alias("k")).where("k > 1").select(*_SET, F.lit(True).alias("again")))
    marked = save(_prefixes(lines, _levels(every), percent).join(again.hint("shuffle_hash"), _SET, "left"))
    drop(every, again)
    parts = [*_LINE, "map", "prefix"]
    equal = marked.where("again")
    firsts = save(equal.groupBy(_SET).agg(F.min(F.struct(*parts)).alias("x")).select(*_SET, "x.*"))
    first = firsts.select(*_SET, F.struct(*_LINE).alias("first"))
    copies = save(equal.join(first, _SET).where(F.struct(*_LINE) != F.col("first")).select(*_LINE))
    classes = marked.where("again is null").select(*_SET, *parts).unionByName(firsts)
    settled = _verified(_first_pairs(classes, percent), texts, percent)
    pairs = save(_candidates(classes, settled, percent))
    drop(marked, firsts)
    near = settled.unionByName(_verified(pairs, texts, percent))
    out = save(copies.unionByName(near).groupBy("id", "hash").agg(F.collect_set("line").alias("gone")))
    drop(copies, settled)
    return out


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """One row per row of ``docs``: the struct ``doc`` (the row without the lines that go) and the struct ``lines`` with
    ``n_lines`` and ``n_removed`` (long).

    The texts come out of a generator over one struct for each row, so that filters of the caller aren't moved below
    it, where they would rebuild the texts for every use.
    """
    gone = removed_lines(docs, id_col, text_col, percent, min_tokens).toDF("id", "hash", "gone").hint("shuffle_hash")
    d = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    key, text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    text = text.cast("string")
    at = d.join(gone, (key.cast("long") == F.col("id")) & (F.xxhash64(text) == F.col("hash")), "left")
    left = "array_join(transform(array_except(sequence(0, size(l) - 1), gone), i -> l[i]), '\n')"
    at = at.withColumn("l", F.split(text, "\n"))
    counts = F.struct(
        F.when(text.isNull(), F.lit(0)).otherwise(F.size("l")).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
    made = F.struct(F.when(F.col("gone").isNull(), text).otherwise(F.expr(left)).alias("text"), counts.alias("lines"))
    at = at.select("*", F.explode(F.array(made)).alias("made"))
    own = [(F.col("made.text") if c == text_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)]
    return at.select(F.struct(*own).alias("doc"), F.col("made.lines").alias("lines"))
