"""What Python workers hold between the tasks of the operators."""

import os
from pathlib import Path

import pyarrow as pa
import pytest

import corpus_pipeline
from canopy.llm import bpe, common, decontaminate, jaccard
from canopy.llm.queries import tokenizer_path


@pytest.mark.skipif(not common._trim, reason="needs glibc")
def test_a_waiting_worker_holds_little(spark):
    def private_mb(pid: int) -> float:
        rows = (line.split() for line in Path(f"/proc/{pid}/smaps_rollup").read_text().splitlines())
        return sum(int(row[1]) for row in rows if row[0] in ("Private_Dirty:", "Private_Clean:")) / 1024

    def run(batch):
        held = [bytes(2000) for _ in range(150_000)]  # 300 MB, between what stays
        run.kept = held[::1000]
        full = private_mb(os.getpid())
        del held
        yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([full])], ["pid", "full"])

    (row,) = common.over_batches(spark.range(1).coalesce(1), run, "pid long, full double").collect()
    assert row.full > 300 and private_mb(row.pid) < row.full - 200


def test_a_worker_keeps_the_caches_of_one_operator():
    bpe.vocabulary.cache_clear()
    bpe.encode_texts([b"some words"], tokenizer_path())
    jaccard.shingle_set(b"some words")
    common.empty_other_caches("canopy.llm.bpe")
    assert bpe.vocabulary.cache_info().currsize == 1 and not jaccard._words
    jaccard.shingle_set(b"some words")
    common.empty_other_caches("canopy.llm.jaccard")
    assert bpe.vocabulary.cache_info().currsize == 0 and jaccard._words
    common.empty_other_caches("canopy.llm.toxicity")
    assert not jaccard._words


def test_windows_reach_the_jvm_without_python_workers(spark):
    rows = [(7, 1, [1, 2, 3], [5, 6]), (-1, 0, [4], [])]
    table = decontaminate._window_table(spark, [r[:2] for r in rows], [r[2] for r in rows], [r[3] for r in rows])
    assert table.dtypes == [("key", "bigint"), ("offset", "int"), ("ids", "array<int>"), ("items", "array<bigint>")]
    assert [tuple(r) for r in table.collect()] == rows
    assert "ExistingRDD" not in table._jdf.queryExecution().executedPlan().toString()
    assert decontaminate._window_table(spark, [], [], []).collect() == []


def test_a_task_of_the_pipeline_has_one_python_worker(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, ""), (3, None), (None, "more")], "doc_id long, text string")
    done = corpus_pipeline.encode(spark, docs, "")
    assert done._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {r.doc_id: r.n_tokens for r in done.collect()} == {1: 2, 2: 0, 3: 0, None: 1}
