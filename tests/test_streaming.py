"""Streams end in the state that the batch operators give, replays and late rows included."""

import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from canopy.functions.times import utc_instant
from canopy.operators import metrics, review
from canopy.streaming import parts, refresh, review_fold


def test_refresh_sees_only_whole_versions_and_survives_a_replay(spark, nodes_of, tmp_path):
    incoming, root = str(tmp_path / "in"), str(tmp_path / "table")

    def drop(file, name, count, version, only=None):
        rows_ = [{"file_path": file, "node_id": i, "depth": 0 if i == 0 else 1, "name": name,
                  "descendant_count": count - 1 if i == 0 else 0} for i in range(count)]
        part = rows_ if only is None else rows_[only]
        refresh.changes_of(nodes_of(part), version).coalesce(1).write.mode("append").parquet(incoming)

    def run():
        refresh.start_refresh(spark, incoming, root, files_per_batch=1).awaitTermination()
        return sorted(rows(refresh.current_nodes(spark, root), "file_path", "name", "node_id"))

    drop("a", "v1", 3, 1)
    drop("b", "v1", 1, 1)
    first = [("a", "v1", 0), ("a", "v1", 1), ("a", "v1", 2), ("b", "v1", 0)]
    assert run() == first
    drop("a", "v2", 2, 2, only=slice(0, 1))
    assert run() == first
    drop("a", "v2", 2, 2, only=slice(1, 2))
    second = [("a", "v2", 0), ("a", "v2", 1), ("b", "v1", 0)]
    assert run() == second
    # The last batch again, as after a crash between its manifest and its commit.
    taken = refresh.node_parts(spark, root)
    refresh.take_batch(spark.read.schema(refresh.CHANGE_SCHEMA).parquet(incoming), taken.batch, root)
    assert refresh.node_parts(spark, root).live == taken.live
    assert sorted(rows(refresh.current_nodes(spark, root), "file_path", "name", "node_id")) == second
    refresh.deletions_of(spark.createDataFrame([("b",)], "file_path string"), 3).write.mode("append").parquet(incoming)
    assert run() == second[:2]
    packed = refresh.compact(spark, root, str(tmp_path / "packed"))
    assert sorted(rows(packed, "file_path", "name", "node_id")) == second[:2]

    # In the packed history too, what is older than the kept version or deletion loses, and a repeated version is one.
    later, root = str(tmp_path / "later"), str(tmp_path / "packed")
    incoming = later
    drop("a", "v1-stale", 3, 1)
    drop("b", "v1-stale", 1, 2)
    drop("a", "v2", 2, 2)
    assert run() == second[:2]
    drop("b", "v4", 1, 4)
    drop("b", "v4", 1, 4)
    assert run() == [*second[:2], ("b", "v4", 0)]


def _write(spark, path, data):
    df = spark.createDataFrame([(p, m, v, dt.datetime.fromisoformat(t), i) for i, (p, m, v, t) in enumerate(data)],
                               "plan_slug string, model string, verdict string, t timestamp_ntz, seq bigint")
    df.coalesce(1).write.mode("append").parquet(path)


def test_fold_over_batches_equals_the_batch_fold_late_rounds_included(spark, tmp_path):
    incoming, root = str(tmp_path / "in"), str(tmp_path / "state")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        parts = [
            [("p", "m1", "FAILED", "2024-01-01T23:30:00"), ("q", "m1", "PASSED", "2024-01-01T01:00:00")],
            [("p", "m2", "PASSED", "2024-01-01T23:50:00"), ("p", "m3", "CONDITIONAL", "2024-01-02T00:10:00")],
            [("q", "m4", "FAILED", "2024-01-09T00:00:00")],
            [("q", "late", "FAILED", "2024-01-01T12:00:00")],
            [("r", "m5", "PASSED", "2024-01-09T03:00:00")],
        ]
        for part in parts:
            _write(spark, incoming, part)
            stream = spark.readStream.schema(spark.read.parquet(incoming).schema).parquet(incoming)
            review_fold.start_fold(stream.withColumn("ts", utc_instant(F.col("t"))), root).awaitTermination()
        got = sorted(rows(review_fold.current_states(spark, root)))
        batch = spark.read.parquet(incoming).withColumns({"ts": F.col("t"), "run": F.date_format("t", "yyyy-MM-dd")})
        assert got == sorted(rows(review.fold_reviews(batch)))
        assert ("p", 3, "m3", "CONDITIONAL", "2024-01-02") in got and ("q", 3, "m4", "FAILED", "2024-01-09") in got
        assert review_fold.current_states(spark, str(tmp_path / "never")).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def _totals(spark, batch):
    data = [(f"p{k % 7}", f"2024-01-{1 + (batch + k) % 9:02d}", 1, 1 + (batch * k) % 3, (dt.datetime(2024, 1, 1), batch * 10 + k, f"m{batch}")) for k in range(5)]
    return spark.createDataFrame(data, review_fold.RUN_SCHEMA)


def test_many_batches_leave_few_parts_and_the_same_state(spark, tmp_path):
    root, expected = str(tmp_path / "state"), None
    for batch in range(21):
        store = review_fold.run_parts(spark, root)
        store.publish(batch, {"totals": _totals(spark, batch)})
        store.publish(batch, {"totals": _totals(spark, batch)})  # replayed: passed over
        expected = _totals(spark, batch) if expected is None else expected.unionByName(_totals(spark, batch))
        # 4 batches make a part of level 1, 16 one of level 2.
        digits = [batch_ for batch_ in ((batch + 1) % 4, (batch + 1) // 4 % 4, (batch + 1) // 16)]
        live = review_fold.run_parts(spark, root).live
        assert [sum(p.level == level for p in live) for level in range(3)] == digits
    assert len(parts.names_in(spark, f"{root}/manifest")) == 2
    assert len(parts.names_in(spark, f"{root}/parts")) <= 9
    folded = review_fold.fold_runs(review_fold._added_up(expected))
    assert sorted(rows(review_fold.current_states(spark, root))) == sorted(rows(folded))


def test_a_crash_during_a_merge_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "state")
    for batch in range(3):
        review_fold.run_parts(spark, root).publish(batch, {"totals": _totals(spark, batch)})
    before = sorted(rows(review_fold.current_states(spark, root)))
    reader = review_fold.run_parts(spark, root).read("totals")
    write = parts.Parts._write

    def failing(self, kind, level, data):
        part = write(self, kind, level, data)
        if level:
            raise OSError("lost")
        return part

    monkeypatch.setattr(parts.Parts, "_write", failing)
    with pytest.raises(OSError):
        review_fold.run_parts(spark, root).publish(3, {"totals": _totals(spark, 3)})
    monkeypatch.undo()
    assert sorted(rows(review_fold.current_states(spark, root))) == before
    review_fold.run_parts(spark, root).publish(3, {"totals": _totals(spark, 3)})
    assert review_fold.run_parts(spark, root).read("totals").agg({"rounds": "sum"}).first()[0] == 20
    assert reader.agg({"rounds": "sum"}).first()[0] == 15  # a reader of the manifest before still finds its parts
    assert len(parts.names_in(spark, f"{root}/parts")) == 4  # the merged part, and those of the manifest before it


def test_refresh_in_random_pieces_equals_the_newest_whole_versions(spark, nodes_of, tmp_path, monkeypatch):
    rng, root = random.Random(6), str(tmp_path / "table")
    sizes = {(f, v): rng.randint(1, 4) for f in "abcde" for v in range(1, 4)}
    pieces = []
    for (file, version), size in sizes.items():
        whole = [{"file_path": file, "node_id": i, "depth": min(i, 1), "name": f"v{version}", "descendant_count": 0 if i else size - 1, "semantic_type": "DEFINITION_FUNCTION"} for i in range(size)]
        cut = rng.randint(0, size)
        pieces += [(version, part) for part in (whole[:cut], whole[cut:], whole[: rng.randint(0, size)]) if part]
    rng.shuffle(pieces)
    read, asked = parts.Parts.read, []
    monkeypatch.setattr(parts.Parts, "read", lambda self, kind: (asked.append(kind), read(self, kind))[1])
    arrived, gone = set(), {}
    for batch, at in enumerate(range(0, len(pieces), 4)):
        some = pieces[at : at + 4]
        changes = [refresh.changes_of(nodes_of(part), version) for version, part in some]
        if batch == 4:
            gone["c"] = 2
            changes.append(refresh.deletions_of(spark.createDataFrame([("c",)], "file_path string"), 2))
        union = changes[0]
        for more in changes[1:]:
            union = union.unionByName(more)
        refresh.take_batch(union, batch, root)
        arrived |= {(r["file_path"], version, r["node_id"]) for version, part in some for r in part}
        assert "nodes" not in asked, "node rows of other files are only read by readers and merges of their own"
        done = {}
        for (file, version), size in sizes.items():
            if sum(a[:2] == (file, version) for a in arrived) == size:
                done[file] = max(done.get(file, 0), version)
        live = {f: v for f, v in done.items() if v > gone.get(f, 0)}
        want = sorted((f, f"v{v}", i) for f, v in live.items() for i in range(sizes[f, v]))
        got = sorted(rows(refresh.current_nodes(spark, root), "file_path", "name", "node_id"))
        assert got == want, batch
        asked.clear()
        measured = refresh.current_metrics(spark, root)
        assert "nodes" not in asked
        assert sorted(rows(measured)) == sorted(rows(metrics.function_metrics(refresh.current_nodes(spark, root))))
        asked.clear()
    assert batch > 5
    top = refresh.current_hotspots(spark, root, "**", 3)
    assert rows(top) == rows(metrics.complexity_hotspots(refresh.current_nodes(spark, root), "**", 3)) and top.count() == 3


def test_open_rows_are_read_only_once_a_version_may_be_whole(spark, nodes_of, tmp_path, monkeypatch):
    root, reads = str(tmp_path / "table"), []
    whole = refresh._whole
    monkeypatch.setattr(refresh, "_whole", lambda seen: reads.append(seen.count()) or whole(seen))

    def node(i):
        return {"file_path": "a", "node_id": i, "depth": 0 if i == 0 else 1, "name": str(i), "descendant_count": 7 if i == 0 else 0}

    # The root first, rows that come again, and the last ones.
    for number, ids in enumerate([[0, 1], [2, 3], [1, 2, 3], [4], [4, 5], [6], [7]]):
        refresh.take_batch(refresh.changes_of(nodes_of([node(i) for i in ids]), 1), number, root)
        assert refresh.current_nodes(spark, root).count() == (8 if number == 6 else 0)
    # Looked at when eight rows are there, five of them distinct, and when the three that lacked have come, one repeated.
    assert reads == [5, 7, 8]
    assert refresh.current_metrics(spark, root).count() == 0


def test_rows_that_wait_are_written_once_and_dealt_out_only_if_they_repeat(spark, nodes_of, tmp_path, monkeypatch):
    root, written = str(tmp_path / "table"), []
    write = parts.Parts._write

    def noted(self, kind, level, rows_):
        written.append((kind, level, "Deduplicate" in rows_._jdf.queryExecution().logical().toString()))
        return write(self, kind, level, rows_)

    monkeypatch.setattr(parts.Parts, "_write", noted)

    def node(i, file):
        return {"file_path": file, "node_id": i, "depth": 0 if i == 0 else 1, "name": str(i), "descendant_count": 4 if i == 0 else 0}

    for number in range(4):
        refresh.take_batch(refresh.changes_of(nodes_of([node(number, "a"), node(0, "b")]), 1), number, root)
    # The first four parts of open rows become one: node 0 of "b" is in each.
    assert [w for w in written if w[0] == "open"] == [("open", 1, True)]
    assert sorted(rows(refresh.node_parts(spark, root).read("open"), "file_path", "node_id")) == [*(("a", i) for i in range(4)), ("b", 0)]
    refresh.take_batch(refresh.changes_of(nodes_of([node(4, "a")]), 1), 4, root)
    assert sorted(rows(refresh.current_nodes(spark, root), "file_path", "node_id")) == [("a", i) for i in range(5)]

    root, written[:] = str(tmp_path / "other"), []
    for number in range(4):
        refresh.take_batch(refresh.changes_of(nodes_of([node(number, "a")]), 1), number, root)
    assert [w for w in written if w[0] == "open"] == [("open", 1, False)]
    assert refresh.node_parts(spark, root).read("open").count() == 4
