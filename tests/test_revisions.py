"""The revision store against whole copies of every revision."""

import random

import pytest
from conftest import rows

from canopy.nodes import NODE_SCHEMA
from canopy.operators.diff import structural_diff
from canopy.sources import corpus
from canopy.sources.revisions import RevisionStore
from canopy.streaming.parts import names_in

SHOWN = ["file_path", "node_id", "name", "semantic_type", "descendant_count", "depth"]


def history(rng, revisions=7):
    """Node tables as dicts: files come, change, go and come back as they were."""
    def content(file, version):
        inner = random.Random(f"{file}{version}")
        return [{"file_path": file, "node_id": i, "depth": min(i, 1), "name": f"n{inner.randrange(3)}", "semantic_type": "DEFINITION_FUNCTION", "descendant_count": inner.randrange(4)} for i in range(1 + inner.randrange(4))]

    for _ in range(revisions):
        yield [row for file in ("a.go", "b.go", "src/c.go", "d.py") if rng.random() < 0.8 for row in content(file, rng.randrange(2))]


def test_every_revision_and_pair_equals_whole_copies(spark, nodes_of, tmp_path):
    rng = random.Random(4)
    copies = [nodes_of(data) if data else nodes_of([{}]).where("false") for data in history(rng)]
    store = RevisionStore(spark, str(tmp_path / "store"))
    assert store.revisions() == [] and store.at(3).count() == 0
    for number, nodes in enumerate(copies, 1):
        store.commit(nodes, 10 * number)
        store.commit(copies[0], 10 * number)  # there already
    assert store.revisions() == [10 * k for k in range(1, len(copies) + 1)]
    with pytest.raises(ValueError):
        store.commit(copies[0], 15)
    for number, nodes in enumerate(copies, 1):
        assert sorted(rows(store.at(10 * number), *SHOWN)) == sorted(rows(nodes, *SHOWN))
        assert sorted(rows(store.at(10 * number + 9), *SHOWN)) == sorted(rows(nodes, *SHOWN))  # between two revisions
    assert store.at(10).columns == NODE_SCHEMA.fieldNames()
    for old, new in ((1, 2), (1, 7), (5, 3), (4, 4), (2, 6)):
        assert sorted(rows(store.diff(10 * old, 10 * new)), key=repr) == sorted(rows(structural_diff(copies[old - 1], copies[new - 1])), key=repr)
        changed = corpus.file_changes(corpus.node_manifest(copies[old - 1]), corpus.node_manifest(copies[new - 1]))
        assert sorted(rows(store.changes(10 * old, 10 * new))) == sorted(rows(changed))
        differ = {r[0] for r in rows(changed)}
        narrow = [r for r in rows(structural_diff(copies[old - 1], copies[new - 1])) if r[0] in differ]
        assert sorted(rows(store.diff(10 * old, 10 * new, changed_only=True)), key=repr) == sorted(narrow, key=repr)
    assert sorted(rows(store.diff(10, 70, "src/**")), key=repr) == sorted(rows(structural_diff(copies[0], copies[6], "src/**")), key=repr)
    assert {r[0] for r in rows(store.tagged(10, 20), "snapshot_id")} <= {"10", "20"}


def test_storage_follows_the_changes_and_a_crash_is_not_seen(spark, nodes_of, tmp_path):
    root = str(tmp_path / "store")
    store = RevisionStore(spark, root)
    base = [{"file_path": f"f{k}.go", "node_id": 0, "name": "x"} for k in range(50)]
    store.commit(nodes_of(base), 1)
    for number in range(2, 6):
        store.commit(nodes_of([*base, {"file_path": "new.go", "node_id": 0, "name": f"v{number}"}]), number)
    assert spark.read.parquet(f"{root}/nodes").count() == 50 + 4
    assert spark.read.parquet(f"{root}/entries").count() == 50 + 4
    # A commit that dies before its entries are whole.
    nodes_of([{"file_path": "half.go", "node_id": 0}]).write.parquet(f"{root}/nodes/revision=6")
    assert store.at(6).where("file_path = 'half.go'").count() == 0 and store.revisions()[-1] == 5
    store.commit(nodes_of(base), 6)
    assert store.at(6).count() == 50 and store.at(5).count() == 51
    assert [r[0] for r in rows(store.changes(5, 6), "status")] == ["deleted"]
    assert "revision=6" in names_in(spark, f"{root}/entries")
    # Files that are equal in both are not read: the plan joins nodes with the files that differ.
    old, new = store.pair(5, 6)
    assert old.count() == 1 and new.count() == 0
