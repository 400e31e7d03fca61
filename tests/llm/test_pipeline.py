"""The stages one by one on planted cases, and all of them on the small tables."""

import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from provenir.llm.common import settle
from tests.llm.cases import PASSAGE, docs, words

SF = "/root/testdata/sf0.001"


def planted(spark):
    """Clean rows, copies, near copies, benchmark passages and repeated ones."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(i, words(i, 120)) for i in range(20)]
    rows += [(100, rows[3][1]), (101, rows[4][1] + " end"), (102, None), (103, "123 !"), (104, rows[3][1])]
    rows += [(200, f"{words(201, 60)} {item} {words(202, 60)}")]
    rows += [(300 + i, f"{words(301 + i, 50)} {PASSAGE * 2} {words(401 + i, 50)}") for i in range(4)]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return table.withColumns({"hits": F.lit(1), "language_found": F.lit("x")}), item


def test_stages_act_and_keep_columns(spark):
    table, item = planted(spark)
    ids = {}
    for name, stage in pipeline.STAGES[:-1]:
        before, table = table, settle(stage(spark, table, SF), name)
        assert table.columns == before.columns and table.dtypes == before.dtypes
        ids[name] = {r.doc_id for r in table.select("doc_id").collect()}
    assert ids["language_id"] == set(range(20)) | {100, 101, 104, 200, 300, 301, 302, 303}
    assert ids["near_dedup"] == set(range(20)) | {200, 300, 301, 302, 303}
    assert ids["suffix_dedup"] == ids["near_dedup"]
    assert ids["decontamination"] == ids["near_dedup"] - {200}
    left = {r.doc_id: r for r in table.collect()}
    assert sum(PASSAGE in r.text for r in left.values()) == 1 and PASSAGE in left[300].text
    assert all(r.n_chars == len(r.text) for r in left.values())
    assert all(left[i].text == words(i, 120) for i in range(20))
    last = pipeline.STAGES[-1][1](spark, table, SF)
    assert {r.doc_id for r in last.collect()} == set(left)


def test_empty_input(spark):
    table = planted(spark)[0].limit(0)
    for name, stage in pipeline.STAGES:
        table = settle(stage(spark, table, SF), name)
        assert table.count() == 0


def test_run(spark):
    got = pipeline.run(spark, SF)
    assert 150 < got.count() < 200 and got.where("n_tokens <= 0").isEmpty()


def test_stage_names_and_sql():
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "decontamination", "bpe"]
    assert pipeline.ORACLE_SQL is None


def test_repeated_rows_are_dropped_once(spark):
    rows = [(1, words(1, 60)), (1, words(1, 60)), (1, words(2, 60)), (None, words(3, 60)), (None, words(3, 60)), (None, words(4, 60)), (2, None), (2, None), (None, None), (None, "")]
    table = docs(spark, rows)
    got = pipeline.drop_near_duplicates(spark, table, SF)
    assert got.columns == table.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got.collect()))) == sorted({repr(r) for r in rows})


def test_a_passage_of_51_words_is_long_enough():
    assert len(" ".join("a" * 51)) >= pipeline.PASSAGE_BYTES
