"""Verdicts, states, gate, rotation."""

import hashlib
import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from canopy.operators import review

ROUND = "plan_slug string, run string, model string, verdict string, ts timestamp, seq bigint"


def rounds_of(spark, data):
    df = spark.createDataFrame(data, "plan_slug string, run string, model string, verdict string, seq bigint")
    return df.withColumn("ts", F.expr("timestamp_seconds(seq)"))


@pytest.mark.parametrize(
    "verdicts,want",
    [
        (["PASSED", "CONDITIONAL", "PASSED"], "CONDITIONAL"),
        (["PASSED", "FAILED", "CONDITIONAL"], "FAILED"),
        (["PASSED"], "PASSED"),
        (["", ""], ""),
        (["failed", "PASSED"], "PASSED"),
        ([None], ""),
    ],
)
def test_worst_verdict(spark, verdicts, want):
    df = spark.createDataFrame([("p", v) for v in verdicts], "plan string, verdict string")
    assert rows(review.worst_verdict(df, ["plan"])) == [("p", want)]


def test_fold_takes_the_latest_run_and_skips_runs_without_verdict(spark):
    rounds = rounds_of(spark, [
        ("p", "d1", "m1", "FAILED", 1), ("p", "d1", "m2", "PASSED", 2),
        ("p", "d2", "m3", "PASSED", 3), ("p", "d2", "m4", "CONDITIONAL", 4), ("p", "d2", "m5", "", 5),
        ("p", "d3", "m6", "", 6), ("q", "d1", "m1", "", 7),
    ])
    assert rows(review.fold_reviews(rounds)) == [("p", 5, "m5", "CONDITIONAL", "d2")]


@pytest.mark.parametrize("hot_rows", [2, 1_000_000])
def test_report_names_count_on_over_runs(spark, hot_rows):
    rounds = rounds_of(spark, [("p", "d1", "m", "", i) for i in range(3)] + [("p", "d2", "m", "", 9)])
    got = sorted(r.report for r in review.report_names(rounds, hot_rows=hot_rows).collect())
    assert got == ["review-d1-p-iter0-r1.md", "review-d1-p-iter1-r2.md", "review-d1-p-iter2-r3.md", "review-d2-p-iter3-r1.md"]


def states(spark, verdicts):
    return spark.createDataFrame([(f"plan-{i}", i, v) for i, v in enumerate(verdicts)], "plan_slug string, iteration bigint, last_verdict string")


@pytest.mark.parametrize(
    "verdicts,strict,want",
    [
        ([], False, (False, "no reviews in progress", [])),
        ([], True, (True, "adversarial review required before completing this session", [])),
        (["PASSED", " conditional "], True, (False, "all plans have PASSED or CONDITIONAL verdicts", [])),
        (["PASSED", "FAILED", "", None], False, (True, "3 plan(s) have FAILED or missing verdicts", ["plan-1", "plan-2", "plan-3"])),
    ],
)
def test_gate(spark, verdicts, strict, want):
    blocked, reason, plans = want
    gate = states(spark, verdicts)
    assert rows(review.review_gate(gate, strict=strict)) == [(blocked, reason, len(plans))]
    assert sorted(r.plan_slug for r in review.blocking_plans(gate).collect()) == plans


@pytest.mark.parametrize("verdict", ["PASSED\n", "\tpassed", "\r\nPassed ", "\u00a0PASSED\u3000", "conditional\x0b"])
def test_white_space_of_any_kind_does_not_block(spark, verdict):
    assert rows(review.review_gate(states(spark, [verdict])), "blocked") == [(False,)]
    assert rows(review.blocking_plans(states(spark, [verdict]), exact=True), "plan_slug") == [("plan-0",)]


def test_state_files(spark, tmp_path):
    files = {
        "a": json.dumps({"plan_slug": "a", "iteration": 4, "last_model": "m", "last_verdict": "PASSED", "history": [{"iteration": 1}]}, indent=2),
        "b": json.dumps({"verdict": "FAILED"}),
        "c": "{broken",
    }
    for name, body in files.items():
        (tmp_path / f"{name}.json").write_text(body)
    (tmp_path / "reports").mkdir()
    (tmp_path / "reports" / "d.json").write_text(files["b"])
    found = review.read_states(spark, str(tmp_path))
    got = {r.plan_slug: (r.iteration, r.last_model, r.last_verdict, r.malformed) for r in found.collect()}
    assert got == {"a": (4, "m", "PASSED", False), "b": (0, "", "FAILED", False), "c": (0, "", "", True)}
    blocking = lambda **k: sorted(rows(review.blocking_plans(found, **k), "plan_slug", "next_slot"))
    assert blocking() == [("b", 0)] and blocking(on_malformed="block") == [("b", 0), ("c", 0)]
    asked = spark.createDataFrame([("a",), ("z",)], "plan_slug string")
    assert sorted(rows(review.states_for(asked, found), "plan_slug", "iteration")) == [("a", 4), ("z", 0)]


def test_clamp_and_slots(spark):
    df = spark.createDataFrame([(n,) for n in (0, -1, 1, 3, 50, 51)], "n int")
    assert [r[0] for r in df.select(review.clamp_rounds(F.col("n"))).collect()] == [1, 1, 1, 3, 50, 50]
    assert [r[0] for r in df.select(review.next_slot(F.col("n"))).collect()] == [0, 2, 1, 0, 2, 0]


@pytest.mark.parametrize(
    "raw,want",
    [
        (" pool/m , east/k ", ["pool/m", "east/k"]),
        ("pool/m,,east/k", ["pool/m", "east/k"]),
        ("noslash,pool/m!,/x,y/,pool/n", ["pool/n"]),
        ("one,two", list(review.DEFAULT_REVIEWERS)),
        ("", list(review.DEFAULT_REVIEWERS)),
        (None, list(review.DEFAULT_REVIEWERS)),
        ("p/a/b", ["p/a/b"]),
        ("a/b,c/d\n", ["a/b", "c/d"]),
        ("a/b\n.c,\tc/d,\u00a0e/f\u2003", ["c/d", "e/f"]),
    ],
)
def test_reviewer_list(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(review.parse_reviewers(F.col("raw"))).first()[0] == want


@pytest.mark.parametrize(
    "pool,excluded,want",
    [
        (["pool/m", "east/k"], "", ["pool/m", "east/k"]),
        (["pool/m", "east/k"], "  ", ["pool/m", "east/k"]),
        (["pool/m", "east/k", "pool/mm"], " POOL/M ", ["pool/mm", "east/k"]),
        (["pool/m"], "pool/m", ["pool/m"]),
        (["pool/m", "east/k"], "pool)", ["pool/m", "east/k"]),
        (["pool/m", "east/k"], "a", ["pool/m", "east/k"]),
    ],
)
def test_exclusion_fails_open(spark, pool, excluded, want):
    df = spark.createDataFrame([("g", m) for m in pool], "grp string, member string")
    assert sorted(r.member for r in review.exclude_reviewer(df, "grp", "member", excluded).collect()) == sorted(want)


def test_interleave_spreads_groups_and_seeds_differ(spark):
    df = spark.createDataFrame([(i, "big") for i in range(8)] + [(i + 10, "small") for i in range(2)], "id int, grp string")
    order = lambda **k: [r.id for r in review.interleave(df, "grp", "id", **k).collect()]
    assert [i for i, v in enumerate(order()) if v >= 10] == [2, 7]
    assert sorted(order(seed=1)) == sorted(order()) and order(seed=1) != order(seed=2)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 8])
def test_rotation_is_shuffled_per_batch_without_equal_neighbours(spark, size):
    names = [f"p{k % 3}/m{k}" for k in range(size)]
    pool = spark.createDataFrame([(m,) for m in names], "m string")
    plans = spark.createDataFrame([(f"p{k}", 50 - k, k) for k in range(12)] + [("none", 0, 1), ("many", 99, 1)], "plan string, rounds int, seed int")
    got = review.rotation_schedule(plans, pool, "plan", "rounds", "seed", "m").collect()
    by_plan = {}
    for r in sorted(got, key=lambda r: r.round):
        assert r.batch == (r.round - 1) // 5
        by_plan.setdefault(r.plan, []).append(r.m)
    assert {p: len(m) for p, m in by_plan.items()} == {f"p{k}": 50 - k for k in range(12)} | {"none": 1, "many": 50}
    if size > 1:
        assert all(a != b for ms in by_plan.values() for a, b in zip(ms, ms[1:]))
    if size >= 5:
        assert all(len(set(ms[k : k + 5])) == 5 for ms in by_plan.values() for k in range(0, len(ms) - 4, 5))
        assert len({tuple(ms[:5]) for ms in by_plan.values()}) > 3 and len({tuple(by_plan["p0"][k : k + 5]) for k in range(0, 50, 5)}) > 3
    assert by_plan["many"][:44] == by_plan["p1"][:44]  # the seed decides, not the plan


def greedy(groups):
    """Always the group with most left that is not the last one's; on ties the first by name."""
    left, out, last = dict(groups), [], None
    while any(left.values()):
        free = [g for g in sorted(left, key=lambda g: (g is None, g)) if left[g] and g != last] or [last]
        last = max(free, key=lambda g: left[g])
        left[last] -= 1
        out.append(last)
    return out


def test_interleave_apart_equals_the_greedy_pick(spark):
    rng = random.Random(5)
    cases = [{"a": 1}, {"a": 5, "b": 5}, {"a": 9, "b": 2, "c": 1}, {"b": 4, "a": 4, "c": 1}, {"b": 5, "a": 4}, {"z": 6, "a": 6, "m": 5}, {None: 3, "a": 3, "b": 1}, {"a": 3, "b": 1, "c": 1, "d": 1}]
    cases += [{g: rng.randint(1, 9) for g in rng.sample("abcdefg", rng.randint(1, 6))} for _ in range(14)]
    for case in cases:
        pairs = [(g, k) for g, n in case.items() for k in range(n)]
        rng.shuffle(pairs)
        df = spark.createDataFrame([(k * 10 + i, g, "x") for i, (g, k) in enumerate(pairs)], "id int, grp string, position2 string")
        for options in ({}, {"seed": 3, "hot_rows": 4}):
            got = review.interleave_apart(df, "grp", "id", **options).collect()
            assert [r.grp for r in got] == greedy(case) and [r.position for r in got] == list(range(1, len(pairs) + 1)), (case, options)
            assert sorted(r.id for r in got) == sorted(r[0] for r in df.collect())
            for g in case if not options else ():
                assert [r.id for r in got if r.grp == g] == sorted(r.id for r in got if r.grp == g)
    assert review.interleave_apart(df.limit(0), "grp", "id").count() == 0


def test_a_large_pool_gives_the_rows_of_the_whole_order(spark, monkeypatch):
    monkeypatch.setattr(review, "CHUNK", 16)
    rng = random.Random(2)
    names = [f"big/{k}" for k in range(150)] + [f"p{k}/{j}" for k in range(40) for j in range(rng.randint(1, 4))] + ["mid/%d" % k for k in range(20)]
    size = {g: sum(n.split("/")[0] == g for n in names) for g in {n.split("/")[0] for n in names}}

    def order(seed, batch):
        h = {n: hashlib.md5(f"{seed}:{batch}:0:{n}".encode()).hexdigest() for n in names}
        place = {}
        for n in sorted(names, key=lambda n: (h[n], n)):
            g = n.split("/")[0]
            place[n] = sum(m.split("/")[0] == g for m in place)
        return sorted(names, key=lambda n: ((place[n] + 0.5) / size[n.split("/")[0]], n.split("/")[0], n))[:5]

    plans = [(f"p{k}", rng.randint(1, 50), k % 4) for k in range(9)]
    pool = spark.createDataFrame([(n,) for n in names] + [(names[0],), (None,)], "m string")
    got = review.rotation_schedule(spark.createDataFrame(plans, "plan string, rounds int, seed int"), pool, "plan", "rounds", "seed", "m")
    want = []
    for plan, rounds, seed in plans:
        chosen = []
        for batch in range(-(-rounds // 5)):
            five = order(seed, batch)
            if batch and five[0] == order(seed, batch - 1)[-1]:
                five[:2] = five[1::-1]
            chosen += five
        want += [(plan, k + 1, k // 5, m) for k, m in enumerate(chosen[:rounds])]
    assert sorted(rows(got)) == sorted(want)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_rotation_needs_a_pool(spark):
    plans = spark.createDataFrame([("p", 1, 1)], "plan string, rounds int, seed int")
    with pytest.raises(ValueError, match="pool"):
        review.rotation_schedule(plans, spark.createDataFrame([], "m string"), "plan", "rounds", "seed", "m")


def test_report_consistency(spark):
    df = spark.createDataFrame([("r1", "PASSED", "FAILED"), ("r1", "FAILED", "FAILED"), ("r2", "CONDITIONAL", "PASSED")], "r string, v string, o string")
    got = sorted(rows(review.report_consistency(df, ["r"], "v", "o")))
    assert got == [("r1", "FAILED", "FAILED", True), ("r2", "PASSED", "CONDITIONAL", False)]
