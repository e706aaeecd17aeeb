import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

from canopy.nodes import NODE_SCHEMA  # noqa: E402
from canopy.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("8", shuffle_partitions=4, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def nodes_of(spark):
    """Node rows from dicts, with the missing columns filled in."""

    def build(rows):
        blank = {f.name: None for f in NODE_SCHEMA.fields}
        full = []
        for i, row in enumerate(rows):
            base = {"file_path": "a.go", "node_id": i, "depth": 1, "descendant_count": 0, "children_count": 0,
                    "start_line": 1, "end_line": 1, "peek": ""}
            full.append(tuple({**blank, **base, **row}[f.name] for f in NODE_SCHEMA.fields))
        return spark.createDataFrame(full, NODE_SCHEMA)

    return build


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
