"""The pipeline's stages, each against a plain version on what its predecessor kept."""

import pytest

import corpus_pipeline
from outlake.llm import quality
from tests.conftest import SF
from tests.llm.test_near_and_lines import brute_lines, brute_near
from tests.llm.test_text_operators import check_packing


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.save(stage(spark, out[-1], SF)))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_keep_the_columns(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_quality_stage(stages):
    kept = {r.doc_id for r in quality.judged(stages[0]).where("quality.kept").select("doc.doc_id").collect()}
    assert {i for i, _ in rows(stages[1])} == kept and len(kept) < stages[0].count()


def test_line_stage(stages):
    before = rows(stages[1])
    gone = brute_lines(before)
    want = {}
    for i, text in before:
        left = [x for k, x in enumerate(text.split("\n")) if (i, k) not in gone]
        if "".join(left).strip(" \t\n\r\x0b\x0c") or len(left) == len(text.split("\n")):
            want[i] = "\n".join(left)
    assert dict(rows(stages[2])) == want
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_near_dedup_stage(stages):
    want = {i for i, _, _, kept in brute_near(rows(stages[2])) if kept}
    assert {i for i, _ in rows(stages[3])} == want


def test_packing_stage(stages):
    check_packing(stages[4], stages[3])


def test_run_gives_the_last_stage(spark, stages):
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).select(cols).collect())
    assert got == sorted(tuple(r) for r in stages[4].select(cols).collect())


def odd_rows(spark):
    words = " ".join(f"w{i}" for i in range(80))
    texts = [None, "", " \n", "short", words, words, words.upper() + "\n" + words, "long " * 3 + " ".join(f"v{i}" for i in range(40_000)), "\n".join([words] * 3), "tie one two three four five", "tie one two three four five"]
    rows = [(i, t, None if i % 3 == 0 else "en", None, None if t is None else len(t), 7, "x") for i, t in enumerate(texts)]
    rows += [(None, words, "en", "s", 1, 7, "x"), rows[4], rows[4]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id int, gone string")


def test_stages_on_odd_rows(spark):
    docs = odd_rows(spark)
    quality_, lines, near, packed = (stage(spark, docs, SF) for _, stage in corpus_pipeline.STAGES)
    key = lambda df: sorted((str(r.doc_id), r.text or "") for r in df.select("doc_id", "text").collect())
    every = rows(docs)
    enough = [(str(i), t) for i, t in every if len((t or "").split()) >= 50]
    assert {*key(quality_)} <= {x for x in enough if x[0] != "8"} and key(quality_).count(("4", every[4][1])) == 3 and quality_.columns == docs.columns
    got = key(lines)
    assert [x for x in got if x[0] == "8"] == [] and ("9", every[9][1]) in got and ("10", every[10][1]) not in got and ("None", every[11][1]) in got
    assert sum(x[0] == "4" for x in got) == 3 and all(x in got for x in [("1", ""), ("2", " \n"), ("3", "short")]) and lines.where("doc_id = 0 and text is null").count() == 1
    kept = [i for i, _ in key(near.where("text is not null"))]
    assert {"1", "2", "3", "4", "9", "None"} <= set(kept) and not {"5", "10"} & set(kept) and near.columns == docs.columns
    check_packing(packed, docs)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
