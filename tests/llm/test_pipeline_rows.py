"""Stages of the pipeline over columns with clashing names, nulls, repeated rows and empty tables."""

import pytest

import corpus_pipeline as pipeline

FOLDER = "/root/testdata/sf0.001"
CLASHES = "doc_id long, text string, n_chars long, _digest string, _before int, _leak long, _digest_ string, _keeper long, node long"
LONG = "one two three four five six seven eight nine ten eleven twelve"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(1, LONG), (2, LONG), (3, "Mail anna.smith@example.org now"), (4, None), (5, ""), (None, LONG), (None, None), (6, "x"), (6, "x"), (6, "y z")]
    return spark.createDataFrame([(i, t, len(t) if t else 0, f"d{k}", k, 7, "e", 8, 9) for k, (i, t) in enumerate(texts)], CLASHES)


@pytest.mark.parametrize("stage", [pipeline.one_of_each_group, pipeline.drop_contaminated, pipeline.replace_private])
def test_clashing_columns_keep_their_values(spark, docs, stage):
    kept = stage(spark, docs, FOLDER)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    was = {r._digest: r for r in docs.collect()}
    for row in kept.collect():
        assert row._before == was[row._digest]._before and row._leak == 7 and row._digest_ == "e" and row._keeper == 8 and row.node == 9
        assert stage is pipeline.replace_private or row.text == was[row._digest].text
    none = stage(spark, docs.limit(0), FOLDER)
    assert none.columns == docs.columns and none.count() == 0


def test_what_each_stage_keeps(spark, docs):
    kept = [(r.doc_id, r.text) for r in pipeline.one_of_each_group(spark, docs, FOLDER).collect()]
    assert (2, LONG) not in kept and kept.count((1, LONG)) == 1 and kept.count((6, "x")) == 1 and (4, None) in kept and (None, LONG) in kept
    assert pipeline.drop_contaminated(spark, docs, FOLDER).count() == docs.count()
    changed = {r.doc_id: r for r in pipeline.replace_private(spark, docs, FOLDER).collect()}
    assert "anna.smith@example.org" not in changed[3].text and changed[3].n_chars == len(changed[3].text)
    assert pipeline.free_name(docs, "_digest") == "_digest__" and pipeline.free_name(docs, "_new") == "_new"
