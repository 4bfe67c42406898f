"""The corpus pipeline's stages in order, and the registered queries."""
import corpus_pipeline as cp

import __spark_entry__ as entry
from flowsieve.llm.common import load, prepare

SMALL = "/root/testdata/sf0.001"


def test_every_dealt_query_is_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names


def test_stages_keep_columns_and_take_effect(spark):
    prepare(spark)
    docs = load(spark, SMALL, "documents")
    extra = docs.limit(1).selectExpr("cast(9000 as bigint) doc_id", "'12 34' text", "lang", "source", "n_chars").union(
        docs.limit(1).selectExpr("cast(9001 as bigint)", "'mail joe@example.com now, and some more English words'",
                                 "lang", "source", "n_chars"))
    now = docs.union(extra).cache()
    first = now.count()
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, now, SMALL).cache()
        assert out.columns == docs.columns and 0 < out.count() <= now.count(), name
        now = out
    left = {r.doc_id: r for r in now.collect()}
    assert 9000 not in left and len(left) < first  # no letter, copies and contaminated documents went
    assert left[9001].text == "mail [EMAIL] now, and some more English words"
    assert left[9001].n_chars == len(left[9001].text)
    packed = cp.STAGES[-1][1](spark, now, SMALL).toPandas()
    assert set(packed.doc_id) == set(left)


def test_empty_table_passes_through(spark):
    prepare(spark)
    now = load(spark, SMALL, "documents").limit(0)
    for _, stage in cp.STAGES:
        now = stage(spark, now, SMALL)
    assert now.count() == 0


def test_near_dedup_keeps_a_row_of_each_group(spark):
    prepare(spark)
    rows = [(7, "one text about rivers and lakes"), (7, "quite another text on trains"), (None, "a third text with no id"),
            (None, "a fourth one, no id either"), (None, "one text about rivers and lakes")]
    out = cp.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL)
    assert sorted(r.text for r in out.collect()) == sorted({t for _, t in rows})


def test_language_without_labels_drops_only_texts_without_letters(spark):
    prepare(spark)
    rows = [(1, "some English words", None), (2, "12 34", None), (3, None, None), (4, "\u00e9", None), (5, "", None)]
    out = cp.language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), SMALL)
    assert sorted(r.doc_id for r in out.collect()) == [1, 4] and out.columns == ["doc_id", "text", "lang"]
