"""Run registered queries against DuckDB: ``python tests/compare.py [sf] [name prefix ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

from canopy.catalog import load  # noqa: E402
from canopy.session import build_session  # noqa: E402
from oracle import connect, duck_rows, normal  # noqa: E402

# DuckDB type -> Spark type, as the schema check sees them.
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double",
         "TIMESTAMP": "timestamp_ntz", "DATE": "date"}


def check(spark, con, name, catalog, folder, need_rows=True) -> str | None:
    """None when equal, otherwise what differs."""
    df = catalog.queries[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    if name not in catalog.oracle:
        return None if df.columns else "no columns"
    names, kinds, want = duck_rows(con, catalog.oracle[name])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    mapped = {n: TYPES.get(k.upper(), k) for n, k in zip(names, kinds)}
    found = dict(df.dtypes)
    if any(mapped[n] != found[n] for n in names):
        return f"types {[(n, found[n], mapped[n]) for n in names if mapped[n] != found[n]]}"
    left, right = normal(df.columns, got), normal(names, want)
    if need_rows and not want:
        return "both are empty, which proves nothing"
    if left != right:
        extra = [r for r in left if r not in set(right)][:2]
        lost = [r for r in right if r not in set(left)][:2]
        return f"rows {len(got)} / {len(want)}; only Spark {str(extra)[:300]}; only DuckDB {str(lost)[:300]}"
    return None


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con, catalog = connect(folder), load()
    bad = 0
    for name in catalog.queries:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problem = check(spark, con, name, catalog, folder)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:400]}"
        bad += problem is not None
        mode = "H" if name in catalog.oracle else "R"
        print(f"{name:34} {mode} {time.time() - start:6.2f}s {'ok' if problem is None else problem}", flush=True)
    print("all equal" if not bad else f"{bad} differ")


if __name__ == "__main__":
    main()
