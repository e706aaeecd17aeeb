"""Gate checks: completion, thresholds, limits, and their roll-up to pass or fail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.session import written

# Largest sizes of one task.
MAX_FILES = 10
MAX_TESTS = 20
MAX_CHAIN = 3
# Levels of a dependency graph that one job takes at most, and dependants of one task that are looked up in one place.
ROUNDS, DEPENDANTS = 16, 100_000


def is_done(text: Column, strict: bool = False) -> Column:
    """Whether a document reports itself as done.

    The loose form takes any line with Status ... Done, so "Status: Not Done"
    passes. The strict form wants the value itself to be Done or Completed.
    """
    if strict:
        return text.rlike(r"(?im)^[^\w\n]*Status[^\w\n]*(Done|Completed)\b")
    return text.rlike(r"(?i)Status.*(Done|Completed)")


def group_completion(members: DataFrame, group: str, text: str, strict: bool = False) -> DataFrame:
    """Per group: members, members not done, and whether all are."""
    open_members = F.count_if(~is_done(F.col(text), strict))
    return members.groupBy(group).agg(
        F.count("*").alias("members"), open_members.alias("incomplete"), (open_members == 0).alias("complete")
    )


def threshold_check(values: DataFrame, key: str, value: str, threshold: int) -> DataFrame:
    """Compare a percentage with a threshold, its decimals cut off; NULL is a warning."""
    whole = F.floor(F.col(value)).cast("bigint")
    severity = F.when(F.col(value).isNull(), "warn").when(whole < threshold, "fail").otherwise("pass")
    return values.select(key, whole.alias("whole"), severity.alias("severity"))


def check_row(summary: DataFrame, check: str, severity: Column, message: Column) -> DataFrame:
    """A one-row summary as a gate row."""
    return summary.select(F.lit(check).alias("check"), severity.alias("severity"), message.alias("message"))


def stub_check(total: DataFrame) -> DataFrame:
    """Fails on any remaining stub; ``total`` is one row with ``hits``."""
    return check_row(total, "stubs", F.when(F.col("hits") > 0, "fail").otherwise("pass"),
                     F.concat(F.col("hits").cast("string"), F.lit(" stub(s)")))


def annotation_check(counts: DataFrame, strict: bool = False) -> DataFrame:
    """Open annotations warn, and fail when strict: one row per count column in strict mode, else one in all."""
    names = counts.columns
    if strict:
        rows = counts.select(
            F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in names])).alias("c")
        ).select("c.*")
        return check_row(rows, "annotations", F.when(F.col("n") > 0, "fail").otherwise("pass"),
                         F.concat("name", F.lit(": "), F.col("n").cast("string")))
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return check_row(counts, "annotations", F.when(total > 0, "warn").otherwise("pass"),
                     F.concat_ws(", ", *[F.concat(F.lit(f"{n}: "), F.col(n).cast("string")) for n in names]))


def completion_check(groups: DataFrame) -> DataFrame:
    """Fails on any group with open members."""
    total = groups.agg(F.coalesce(F.sum("incomplete"), F.lit(0)).alias("open"))
    return check_row(total, "status", F.when(F.col("open") > 0, "fail").otherwise("pass"),
                     F.concat(F.col("open").cast("string"), F.lit(" open")))


def coverage_rows(checked: DataFrame, key: str) -> DataFrame:
    """Threshold results as gate rows, one per key."""
    return check_row(checked, "coverage", F.col("severity"), F.concat(F.col(key), F.lit(": "), F.col("whole").cast("string")))


def roll_up(checks: DataFrame) -> DataFrame:
    """One row: failures, warnings, and whether the gate is passed (no failures)."""
    failures = F.count_if(F.col("severity") == "fail")
    return checks.agg(
        failures.alias("failures"), F.count_if(F.col("severity") == "warn").alias("warnings"), (failures == 0).alias("passed")
    )


def next_sequence(members: DataFrame, group: str, sequence: str) -> DataFrame:
    """The next sequence number of each group, at least three digits wide."""
    following = F.coalesce(F.max(sequence), F.lit(0)) + 1
    return members.groupBy(group).agg(F.format_string("%03d", following.cast("bigint")).alias("next_id"))


def next_task_sequence(names: DataFrame, name: str) -> DataFrame:
    """The same from document names like P1-003-title.md: (phase, next_id)."""
    parsed = names.select(
        F.regexp_extract(name, r"^P(\d+)-(\d+)-", 1).alias("phase"), F.regexp_extract(name, r"^P(\d+)-(\d+)-", 2).alias("seq")
    ).where("phase <> ''")
    return next_sequence(parsed.select("phase", F.col("seq").cast("bigint").alias("seq")), "phase", "seq")


def size_limits(tasks: DataFrame, key: str, files: str, tests: str) -> DataFrame:
    """Tasks with more files or tests than allowed, and which limit they break."""
    over_files, over_tests = F.col(files) > MAX_FILES, F.col(tests) > MAX_TESTS
    return tasks.where(over_files | over_tests).select(
        key, files, tests, over_files.alias("over_files"), over_tests.alias("over_tests")
    )


def _pending(tasks: DataFrame, links: DataFrame, rounds: int) -> DataFrame:
    """``tasks(id, base, slots)`` with ``chain``: known if all links of a task are resolved within so many rounds."""
    # A task that many depend on is looked up in several slots, each a row of its own.
    slot = F.sequence(F.lit(0).cast("bigint"), F.col("slots") - 1)
    open_ = F.lit(None).cast("bigint")
    now = tasks.select("id", "base", "slots", open_.alias("chain"))
    for _ in range(rounds):
        known = now.select(F.col("id").alias("depends_on"), F.explode(slot).alias("slot"), "chain")
        below = links.join(known, ["depends_on", "slot"]).select("id", open_.alias("base"), open_.alias("slots"), "chain", F.col("chain").isNull().alias("open"))
        own = tasks.select("id", "base", "slots", open_.alias("chain"), F.lit(False).alias("open"))
        folded = below.unionByName(own).groupBy("id").agg(
            F.max("base").alias("base"), F.max("slots").alias("slots"), F.max("chain").alias("longest"), F.max("open").alias("open")
        )
        now = folded.select("id", "base", "slots", F.when(~F.col("open"), F.greatest("base", "longest") + 1).alias("chain"))
    return now


def dependency_chains(edges: DataFrame, limit: int = MAX_CHAIN) -> DataFrame:
    """Length of the longest chain below each task, whether it is over ``limit``, and whether it runs into a cycle.

    ``edges`` (id, depends_on). Lengths are found from the ends up: a task is resolved once all it depends on is, one row
    per task and a link at a time, so tables stay as small as the edges. A job takes 1, 2, 4 and up to ROUNDS levels;
    then resolved tasks leave, and links to them become a number at their task. So a chain of n tasks takes about
    n / ROUNDS jobs over what is still open. What is never resolved runs into a cycle: such a task has no longest chain,
    ``chain`` is NULL, ``over_limit`` and ``cyclic`` are true.
    """
    spark = edges.sparkSession
    links = written(edges.select("id", "depends_on").where("id is not null and depends_on is not null").distinct())
    counts = written(links.groupBy("depends_on").agg(F.ceil(F.count("*") / DEPENDANTS).alias("slots")))
    links = links.join(counts, "depends_on").select("id", "depends_on", F.pmod(F.xxhash64("id"), "slots").alias("slot"))
    tasks = links.select("id").distinct().join(counts.withColumnRenamed("depends_on", "id"), "id", "left")
    tasks = written(tasks.select("id", F.lit(0).cast("bigint").alias("base"), F.coalesce("slots", F.lit(1)).cast("bigint").alias("slots")))
    links = written(links.join(tasks.select(F.col("id").alias("depends_on")), "depends_on", "left_semi"))
    resolved = [spark.createDataFrame([], tasks.select("id", F.col("base").alias("chain")).schema)]
    rounds = 1
    while True:
        state = written(_pending(tasks, links, rounds))
        known = state.where("chain is not null").select("id", "chain")
        if known.limit(1).count() == 0:
            break
        resolved.append(known)
        open_links = links.join(known.select("id"), "id", "left_anti")
        # The longest chain among resolved dependencies goes on as a number.
        floor = open_links.join(known.withColumnRenamed("id", "depends_on"), "depends_on").groupBy("id").agg(F.max("chain").alias("below"))
        left = state.where("chain is null").join(floor, "id", "left")
        tasks = written(left.select("id", F.greatest("base", "below").alias("base"), "slots"))
        links = written(open_links.join(known.select(F.col("id").alias("depends_on")), "depends_on", "left_anti"))
        rounds = min(2 * rounds, ROUNDS)
    chains = reduce(DataFrame.unionByName, resolved)
    straight = chains.select("id", "chain", (F.col("chain") > limit).alias("over_limit"), F.lit(False).alias("cyclic"))
    looped = tasks.select("id", F.lit(None).cast("bigint").alias("chain"), F.lit(True).alias("over_limit"), F.lit(True).alias("cyclic"))
    return straight.unionByName(looped)
