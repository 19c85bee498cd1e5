"""The registered query of each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlake.llm import chat, embedding_dedup, html_text, lattice_lm, license_scan, line_dedup, near_dedup, packing, quality
from outlake.llm import sentencepiece_codec, url_filter, vector_codes, whitening
from outlake.llm.common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings")).select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept"
    )


def op2_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), with_ids=False)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).select(
        "doc.doc_id", "quality.n_words", "quality.word_chars", "quality.n_symbols", "quality.n_dup_lines", "quality.n_repeat_words",
        "quality.base_failed", "quality.kept",
    )


OP3_SQL = r"""
with t as (select doc_id, lang, source, coalesce(text, '') as body from documents),
w as (select doc_id, lang, source, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') as w,
  list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from
  (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
again as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from g) where n > 1),
covered as (select doc_id, count(distinct i + j) as n from again, (values (0), (1), (2)) as v(j) group by doc_id),
m as (select w.doc_id, lang, source, cast(len(w) as bigint) as n_words,
  cast(length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
  cast(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  cast(len(regexp_extract_all(body, '\p{Lu}')) as bigint) as n_upper, cast(len(l) as bigint) as n_lines,
  cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, coalesce(n, 0) as n_repeat_words
  from w left join covered using (doc_id)),
r as (select *, n_symbols / greatest(n_words, 1)::double as r1, n_upper / greatest(word_chars, 1)::double as r2,
  n_dup_lines / greatest(n_lines, 1)::double as r3, word_chars / greatest(n_words, 1)::double as r4 from m),
o as (select lang, source, count(*) as n, quantile_disc(r1, [0.25, 0.75]) as q1, quantile_disc(r2, [0.25, 0.75]) as q2,
  quantile_disc(r3, [0.25, 0.75]) as q3, quantile_disc(r4, [0.25, 0.75]) as q4 from r where n_words >= 50 group by lang, source),
b as (select lang, count(*) as n, quantile_disc(r1, [0.25, 0.75]) as q1, quantile_disc(r2, [0.25, 0.75]) as q2,
  quantile_disc(r3, [0.25, 0.75]) as q3, quantile_disc(r4, [0.25, 0.75]) as q4 from r where n_words >= 50 group by lang),
a as (select quantile_disc(r1, [0.25, 0.75]) as q1, quantile_disc(r2, [0.25, 0.75]) as q2,
  quantile_disc(r3, [0.25, 0.75]) as q3, quantile_disc(r4, [0.25, 0.75]) as q4 from r where n_words >= 50),
f as (select o.lang, o.source, case when o.n >= 100 then o.q1 when b.n >= 100 then b.q1 else a.q1 end as q1,
  case when o.n >= 100 then o.q2 when b.n >= 100 then b.q2 else a.q2 end as q2,
  case when o.n >= 100 then o.q3 when b.n >= 100 then b.q3 else a.q3 end as q3,
  case when o.n >= 100 then o.q4 when b.n >= 100 then b.q4 else a.q4 end as q4
  from o left join b on o.lang is not distinct from b.lang, a),
j as (select r.*, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, coalesce(
  r1 <= q1[2] + 6 * (q1[2] - q1[1]) + 0.1 and r2 <= q2[2] + 6 * (q2[2] - q2[1]) + 0.2
  and r3 <= q3[2] + 6 * (q3[2] - q3[1]) + 0.5
  and r4 between q4[1] - 6 * (q4[2] - q4[1]) - 1.5 and q4[2] + 6 * (q4[2] - q4[1]) + 1.5, true) as fine
  from r left join f on r.lang is not distinct from f.lang and r.source is not distinct from f.source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
  not base_failed and fine as kept from j
"""


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept"
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select(
        "doc.doc_id", "doc.text", "lines.n_lines", "lines.n_removed"
    )


OP6_SQL = r"""
with l as (select doc_id, i - 1 as line, list_distinct(list_filter(regexp_split_to_array(lower(ls[i]), '[\x20\x09-\x0D]+'), lambda x: x <> '')) as t
  from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null))),
big as (select doc_id, line, list_sort(t) as t, len(t) as n from l where len(t) >= 5),
c as (select t, n, min((doc_id, line)) as who, row_number() over (order by t) as id from big group by t, n),
tok as (select id, n, who, unnest(t) as w from c),
df as (select w, count(*) as k from tok group by w),
r as (select id, n, who, tok.w, row_number() over (partition by id order by k, tok.w) as pos from tok join df on df.w = tok.w),
p as (select * from r where pos <= n - ceil(n * 85 / 100) + 1),
pairs as (select distinct a.id as a, b.id as b from p a join p b on a.w = b.w and a.who < b.who and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
near as (select distinct cb.who as who from pairs join c ca on ca.id = a join c cb on cb.id = b
  where 100 * len(list_intersect(ca.t, cb.t)) >= 85 * (ca.n + cb.n - len(list_intersect(ca.t, cb.t)))),
gone as (select doc_id, line from big join c on c.t = big.t where (big.doc_id, big.line) <> c.who
  union select who[1], who[2] from near),
g as (select doc_id, list(line) as lines from gone group by doc_id)
select d.doc_id, case when g.lines is null then text else
  coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: not list_contains(g.lines, i - 1)), chr(10)), '') end as text,
  cast(coalesce(len(string_split(text, chr(10))), 0) as bigint) as n_lines, cast(coalesce(len(g.lines), 0) as bigint) as n_removed
from documents d left join g on g.doc_id = d.doc_id
"""


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.lattice_scores(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    # each text as a list of one typed part, so that the turns go through the visitor like turns with attachments
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"))
    typed = turns.unionByName(more).withColumn("text", F.to_json(F.array(part)))
    return chat.digests(chat.format_turns(typed, typed=True))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings")).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256"
    )


def _op12_sql() -> str:
    """The rounds one after another; distances by dot products of whole doubles, which are exact."""
    parts = """
with kept as (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select vec_id, k, v[k * len(v) // 4 + 1 : (k + 1) * len(v) // 4] as x from kept, range(4) as r(k)),
q as (select *, list_dot_product(x, x) as xx from p),
b0 as (select k, row_number() over (partition by k order by vec_id) - 1 as e, x as y from p
  where vec_id in (select vec_id from kept order by vec_id limit 256))"""
    for i in range(5):
        parts += f""",
a{i} as (select vec_id, k, min(struct_pack(d := xx - 2 * list_dot_product(x, y) + list_dot_product(y, y), e := e)) as m
  from q join b{i} using (k) group by vec_id, k)"""
        if i < 4:
            parts += f""",
s{i} as (select k, e, list(f order by i) as y from (select k, e, i, floor(sum(c) / count(*)) as f from
  (select p.k, a.m.e as e, unnest(p.x) as c, unnest(range(len(p.x))) as i from p join a{i} a using (vec_id, k)) group by k, e, i) group by k, e),
b{i + 1} as (select k, e, coalesce(s.y, b.y) as y from b{i} b left join s{i} s using (k, e))"""
    return parts + """,
h as (select sha256(string_agg(c::bigint::varchar, ',' order by k, e, i)) as codebooks_sha256 from
  (select k, e, unnest(y) as c, unnest(range(len(y))) as i from b4)),
o as (select vec_id, string_agg(lower(lpad(to_hex(m.e), 2, '0')), '' order by k) as code, cast(sum(m.d) as bigint) as error from a4 group by vec_id)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from o join kept using (vec_id), h
"""


OP12_SQL = _op12_sql()


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scanned(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
    return found.withColumn("expressions", F.concat_ws("; ", "expressions"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_embedding_near_dedup, op2_sentencepiece_codec, op3_quality_rules, op4_url_filter, op5_minhash_near_dedup, op6_line_dedup,
            op7_html_extraction, op8_lattice_scores, op9_chat_format, op10_best_fit_packing, op11_embedding_whitening,
            op12_vector_codes, op13_license_scan,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": OP3_SQL, "op6_line_dedup": OP6_SQL, "op12_vector_codes": OP12_SQL}
