"""Review rounds: verdicts, state, gates, reports and reviewer rotation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.text import trimmed
from canopy.plans.numbering import HOT_ROWS, key_sizes, numbered, running_sum
from canopy.session import written

# Verdicts from mild to severe; anything else ranks 0 and counts as missing.
VERDICTS = ("PASSED", "CONDITIONAL", "FAILED")
OPEN_VERDICTS = ("PASSED", "CONDITIONAL")

# Limits on the rounds of one call, and reviewer slots.
DEFAULT_ROUNDS = 1
MAX_ROUNDS = 50
SLOTS = 3
BATCH = 5
# Names of a reviewer pool that one row holds.
CHUNK = 256

# The reviewers used when none are named.
DEFAULT_REVIEWERS = (
    "copilot/claude-sonnet-4.6",
    "gemini/gemini-3.1-pro-preview",
    "copilot/gpt-4.1",
    "vertexai/gemini-3.1-pro-preview",
    "copilot/gpt-4o",
)
# What a reviewer's name may hold.
REVIEWER_CHARACTERS = r"\A[a-zA-Z0-9_./-]+\z"
# The answers of the gate.
REVIEW_REQUIRED = "adversarial review required before completing this session"
NO_REVIEWS = "no reviews in progress"
SOME_BLOCK = " plan(s) have FAILED or missing verdicts"
NONE_BLOCKS = "all plans have PASSED or CONDITIONAL verdicts"


def severity(verdict: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), verdict), F.lit(0)).cast("int")


def verdict_of(rank: Column) -> Column:
    return F.element_at(F.array(F.lit(""), *[F.lit(v) for v in VERDICTS]), rank + 1)


def worst_verdict(rounds: DataFrame, by: Sequence[str], verdict: str = "verdict") -> DataFrame:
    """The most severe verdict per group; unknown verdicts are passed over."""
    return rounds.groupBy(*by).agg(verdict_of(F.coalesce(F.max(severity(F.col(verdict))), F.lit(0))).alias("worst"))


def run_totals(rounds: DataFrame, by: Sequence[str] = ("plan_slug", "run")) -> DataFrame:
    """One row per plan and run: rounds, worst rank, and the reviewer of the last round."""
    last = F.max(F.struct("ts", "seq", "model"))
    return rounds.groupBy(*by).agg(
        F.count("*").alias("rounds"), F.max(severity(F.col("verdict"))).alias("worst"), last.alias("last")
    )


def fold_runs(totals: DataFrame) -> DataFrame:
    """Review state per plan from its runs.

    Rounds add up over runs; the verdict is the worst of the latest run only.
    A run without any valid verdict leaves no trace.
    """
    latest = F.max(F.struct("run", F.col("last.model").alias("model"), "worst"))
    folded = totals.where("worst > 0").groupBy("plan_slug").agg(F.sum("rounds").alias("iteration"), latest.alias("latest"))
    return folded.select(
        "plan_slug", "iteration", F.col("latest.model").alias("last_model"),
        verdict_of(F.col("latest.worst")).alias("last_verdict"), F.col("latest.run").alias("last_review_date"),
    )


def fold_reviews(rounds: DataFrame) -> DataFrame:
    """Review state per plan from single rounds (plan_slug, run, model, verdict, ts, seq)."""
    return fold_runs(run_totals(rounds))


def report_consistency(vectors: DataFrame, by: Sequence[str], result: str, overall: str) -> DataFrame:
    """Whether the overall verdict of a report is the worst of its vectors."""
    checked = vectors.groupBy(*by).agg(F.max(severity(F.col(result))).alias("_worst"), F.max(overall).alias("overall"))
    worst = verdict_of(F.col("_worst"))
    return checked.select(*by, "overall", worst.alias("worst"), (F.col("overall") == worst).alias("consistent"))


def with_round_numbers(rounds: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Number the rounds of each run by time."""
    return numbered(rounds, ["plan_slug", "run"], ["ts", "seq"], "round", hot_rows=hot_rows)


def report_names(rounds: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """File name of each round's report: date, plan, iteration at that round, round number."""
    totals = rounds.groupBy("plan_slug", "run").agg(F.count("*").alias("rounds"))
    before = running_sum(totals, ["plan_slug"], ["run"], "rounds", "before", hot_rows=hot_rows)
    placed = with_round_numbers(rounds, hot_rows).join(before.select("plan_slug", "run", "before"), ["plan_slug", "run"])
    iteration = F.col("before") + F.col("round") - 1
    name = F.format_string("review-%s-%s-iter%d-r%d.md", "run", "plan_slug", iteration, "round")
    return placed.select("plan_slug", "run", "round", iteration.alias("iteration"), name.alias("report"))


def append_reports(reports: DataFrame, path: str) -> None:
    """Add reports to the store; nothing already there is touched."""
    reports.write.mode("append").partitionBy("run").parquet(path)


# --- gate -----------------------------------------------------------------


def blocks(verdict: Column, exact: bool = False) -> Column:
    """Whether a verdict, or a missing one, blocks; white space and case do not count. ``exact`` compares as written."""
    seen = F.coalesce(verdict, F.lit(""))
    return ~(seen if exact else F.upper(trimmed(seen))).isin(*OPEN_VERDICTS)


STATE_SCHEMA = (
    "plan_slug string, iteration bigint, last_model string, last_verdict string, last_review_date string, verdict string"
)


def parse_states(raw: DataFrame, slug: str, json: str) -> DataFrame:
    """Review states from JSON text: one row per slug, ``malformed`` where it cannot be read.

    The older field ``verdict`` stands in for a missing ``last_verdict``.
    """
    parsed = F.from_json(json, STATE_SCHEMA + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    state = raw.select(F.col(slug).alias("plan_slug"), parsed.alias("s"))
    return state.select(
        "plan_slug",
        F.coalesce("s.iteration", F.lit(0).cast("bigint")).alias("iteration"),
        F.coalesce("s.last_model", F.lit("")).alias("last_model"),
        F.coalesce("s.last_verdict", "s.verdict", F.lit("")).alias("last_verdict"),
        F.coalesce("s.last_review_date", F.lit("")).alias("last_review_date"),
        (F.col("s").isNull() | F.col("s._bad").isNotNull()).alias("malformed"),
    )


def read_states(spark, folder: str) -> DataFrame:
    """State files directly in a folder, one JSON object each, keyed by file name."""
    files = spark.read.format("text").option("wholetext", "true").option("pathGlobFilter", "*.json").load(folder)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return parse_states(files.select(stem.alias("slug"), "value"), "slug", "value")


def states_for(slugs: DataFrame, states: DataFrame) -> DataFrame:
    """States of the asked plans; a plan without one gets the zero state."""
    joined = slugs.select("plan_slug").distinct().join(states, "plan_slug", "left")
    return joined.na.fill({"iteration": 0, "last_model": "", "last_verdict": "", "last_review_date": ""})


def blocking_plans(states: DataFrame, on_malformed: str = "skip", exact: bool = False) -> DataFrame:
    """Plans that block, with the reviewer slot that is next."""
    if on_malformed not in ("skip", "block"):
        raise ValueError(f"on_malformed must be 'skip' or 'block', not {on_malformed!r}")
    bad = F.col("malformed") if "malformed" in states.columns else F.lit(False)
    wanted = F.when(bad, F.lit(on_malformed == "block")).otherwise(blocks(F.col("last_verdict"), exact))
    return states.where(wanted).select("plan_slug", "last_verdict", "iteration", next_slot(F.col("iteration")).alias("next_slot"))


def review_gate(states: DataFrame, *, strict: bool = False, on_malformed: str = "skip", exact: bool = False) -> DataFrame:
    """The gate's answer in one row: blocked, reason, and how many plans block; ``blocking_plans`` lists them.

    Without any state there is nothing to wait for, unless ``strict``.
    """
    bad = F.col("malformed") if "malformed" in states.columns else F.lit(False)
    wanted = F.when(bad, F.lit(on_malformed == "block")).otherwise(blocks(F.col("last_verdict"), exact))
    totals = states.agg(F.count("*").alias("states"), F.count_if(wanted).alias("blocking"))
    none = F.col("states") == 0
    reason = (
        F.when(none & F.lit(strict), REVIEW_REQUIRED)
        .when(none, NO_REVIEWS)
        .when(F.col("blocking") > 0, F.concat(F.col("blocking").cast("string"), F.lit(SOME_BLOCK)))
        .otherwise(NONE_BLOCKS)
    )
    return totals.select(((F.col("blocking") > 0) | (none & F.lit(strict))).alias("blocked"), reason.alias("reason"), "blocking")


# --- reviewers and rotation -----------------------------------------------


def clamp_rounds(rounds: Column) -> Column:
    """At least 1 (the default), at most 50."""
    return F.least(F.greatest(rounds, F.lit(DEFAULT_ROUNDS)), F.lit(MAX_ROUNDS))


def next_slot(iteration: Column) -> Column:
    return F.pmod(iteration, F.lit(SLOTS)).cast("int")


def parse_reviewers(raw: Column, defaults: Sequence[str] = DEFAULT_REVIEWERS) -> Column:
    """Valid ``provider/model`` entries of a comma list, or the defaults if there are none."""
    entries = F.transform(F.split(F.coalesce(raw, F.lit("")), ","), trimmed)
    valid = F.filter(entries, lambda e: e.rlike(REVIEWER_CHARACTERS) & e.rlike(r"\A[^/]+/.+\z"))
    return F.when(F.size(valid) > 0, valid).otherwise(F.array(*[F.lit(d) for d in defaults]))


def exclude_reviewer(pool: DataFrame, group: str, member: str, excluded: str) -> DataFrame:
    """Drop one reviewer from each pool, unless the name is malformed or the pool would be empty."""
    name = excluded.strip()
    if not name:
        return pool
    matches = F.lower(member) == F.lit(name.lower())
    well_formed = F.lit(name).rlike(REVIEWER_CHARACTERS)
    marked = pool.withColumn("_out", well_formed & F.coalesce(matches, F.lit(False)))
    emptied = marked.groupBy(group).agg(F.min("_out").alias("_all")).where("_all").select(group)
    kept = marked.where("not _out").unionByName(marked.where("_out").join(emptied, group, "left_semi"))
    return kept.drop("_out")


def provider_of(member: Column) -> Column:
    return F.substring_index(member, "/", 1)


def interleave(
    members: DataFrame, group: str, order: str, seed: int | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Spread the members of each group evenly: sort by ``position``, then group.

    ``position`` is (row number - 0.5) / group size, with the rows of a group
    in ``order``, or shuffled by a seeded hash of it. Groups are spread as evenly as
    their sizes allow; equal neighbours are not ruled out.
    """
    keyed = members.withColumn("_by", F.col(order) if seed is None else F.md5(F.concat_ws(":", F.col(order), F.lit(seed)).cast("binary")))
    sizes = members.groupBy(group).agg(F.count("*").alias("_size"))
    top = key_sizes(members, [group])
    ranked = numbered(keyed, [group], ["_by", order], "_rank", sizes=top, hot_rows=hot_rows)
    placed = ranked.join(sizes, group).withColumn("position", (F.col("_rank") - 0.5) / F.col("_size"))
    return placed.drop("_by", "_rank", "_size").orderBy("position", group)


def interleave_apart(
    members: DataFrame, group: str, order: str, seed: int | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Arrange members so that no two of a group are neighbours while another group has members left.

    ``position`` counts from 1. The rows are those of the greedy pick (always a member of the group with most members left
    that is not the last one's; on ties the first group by name), found without picking. A member's level is how many of
    its group are left when it is picked. The largest group T takes turns with the others, these by (level, name), while T
    has most left; from there on all go by (level, name). When the turns end follows from the first place among the others
    whose level is above what T has left by then, and every position from a rank and a count per level. So one global
    numbering and joins on rank and level do it. Inside a group members are in ``order``, or shuffled by a seeded hash of
    it. Rows without a group are a group of their own, the last by name. Two rows, the name and size of T and the end of
    the turns, go to the driver.
    """
    named = F.struct(F.col(group).isNull().alias("none"), F.col(group).alias("name"))
    keyed = members.withColumns(
        {"_g": named, "_by": F.col(order) if seed is None else F.md5(F.concat_ws(":", F.col(order), F.lit(seed)).cast("binary"))}
    )
    sizes = written(keyed.groupBy("_g").agg(F.count("*").alias("_size")))
    top = sizes.orderBy(F.desc("_size"), "_g").first()
    if top is None:
        return members.withColumn("position", F.lit(0).cast("bigint"))
    ranked = numbered(keyed, ["_g"], ["_by", order], "_rank", sizes=key_sizes(members, [group]), hot_rows=hot_rows)
    ranked = written(ranked.join(sizes, "_g").withColumn("_level", F.col("_size") - F.col("_rank") + 1))
    largest = F.struct(F.lit(top["_g"]["none"]).alias("none"), F.lit(top["_g"]["name"]).cast(members.schema[group].dataType).alias("name"))
    others = ranked.where(F.col("_g") != largest).withColumn("_down", -F.col("_level"))
    others = written(numbered(others, [], ["_down", "_g"], "_i", hot_rows=hot_rows).drop("_down").withColumn("_i", F.col("_i") - 1))
    count, size = others.count(), top["_size"]
    # T is picked at turn i if it has more left than the others' next, or as many and comes first, or the next was just picked.
    gap = size - F.col("_i") - F.col("_level")
    before = others.select((F.col("_i") + 1).alias("_i"), F.col("_g").alias("_last"))
    ties = others.where((gap == 0) & (F.col("_g") < largest)).select("_i", "_g").join(before, "_i", "left")
    ends = ties.where("_last is null or _last <> _g").select("_i").union(others.where(gap < 0).select("_i"))
    turns = ends.agg(F.min("_i")).first()[0]
    turns = count if turns is None else turns
    left = size - turns
    earlier = F.greatest(F.lit(left) - F.col("_level"), F.lit(0)) + F.when((F.col("_level") <= left) & (largest < F.col("_g")), 1).otherwise(0)
    placed = others.withColumn("position", F.when(F.col("_i") < turns, 2 * F.col("_i") + 2).otherwise(turns + F.col("_i") + earlier + 1))
    levels = others.groupBy("_level").agg(F.min("_i").alias("_first"), F.count_if(F.col("_g") < largest).alias("_less"))
    own = ranked.where(F.col("_g") == largest)
    turn = F.col("_rank") - 1
    among = F.coalesce(F.col("_first") + F.col("_less"), F.lit(count))  # the others before a member of T that has no turn
    rest = turns + F.greatest(among, F.lit(turns)) + (left - F.col("_level")) + 1
    own = own.join(levels, "_level", "left").withColumn("position", F.when(turn < turns, 2 * turn + 1).otherwise(rest))
    columns = [*members.columns, F.col("position").cast("bigint").alias("position")]
    return own.select(*columns).unionByName(placed.select(*columns)).orderBy("position")


# --- rotation ---


def _pool_chunks(pool: DataFrame, member: str) -> DataFrame:
    """The pool as rows of at most CHUNK members: ``(chunk, members)``, written.

    Members are sorted by provider and name. Each carries the size of its provider, its place among the provider's members
    in the chunk, and whether the provider has members in other chunks.
    """
    names = pool.select(F.col(member).alias("m")).where("m is not null").distinct().withColumn("g", provider_of(F.col("m")))
    placed = numbered(names, [], ["g", "m"], "n").withColumn("chunk", F.floor((F.col("n") - 1) / CHUNK))
    sizes = placed.groupBy("g").agg(F.count("*").alias("size"), (F.min("chunk") != F.max("chunk")).alias("spread"))
    inside = placed.groupBy("chunk", "g").agg(F.min("n").alias("first"))
    rows = placed.join(inside, ["chunk", "g"]).join(sizes, "g")
    entry = F.struct("g", "m", "size", "spread", (F.col("n") - F.col("first") + 1).alias("place"))
    return written(rows.groupBy("chunk").agg(F.array_sort(F.collect_list(entry)).alias("members")))


def _first_members(batches: DataFrame, chunks: DataFrame, n_chunks: int) -> DataFrame:
    """``(seed, batch, fill, five)``: the first members of the pool in the order of each of ``batches(seed, batch, fill)``.

    In that order the members of a provider are shuffled by a hash of seed, batch and fill, and providers are spread evenly.
    Every chunk of the pool gives the few that can be among the first: of providers of its own the first BATCH of all, of
    a provider that reaches into other chunks the first BATCH of it.
    """
    asked = batches.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_chunks - 1).cast("bigint"))))
    rows = asked.join(chunks, "chunk")
    hashed = lambda e: F.md5(F.concat_ws(":", "seed", "batch", "fill", e["m"]).cast("binary"))
    # Sorted by provider and hash, a provider's members stand where they stood sorted by name.
    shuffled = F.array_sort(F.transform("members", lambda e: F.struct(e["g"].alias("g"), hashed(e).alias("h"), e["m"].alias("m"))))
    both = F.zip_with(shuffled, "members", lambda x, e: F.struct(
        ((e["place"] - 0.5) / e["size"]).alias("p"), x["g"].alias("g"), x["m"].alias("m"), x["h"].alias("h"), e["size"].alias("size"), e["spread"].alias("spread"), e["place"].alias("place")))
    near = F.filter(both, lambda e: e["place"] <= BATCH)
    rows = rows.select("seed", "batch", "fill", near.alias("near"))
    whole = F.slice(F.array_sort(F.filter("near", lambda e: ~e["spread"])), 1, BATCH)
    each = rows.select("seed", "batch", "fill", F.explode(F.concat(whole, F.filter("near", lambda e: e["spread"]))).alias("e"))
    each = each.select("seed", "batch", "fill", "e.*")
    inside = Window.partitionBy("seed", "batch", "fill", "g").orderBy("h", "m")
    spread = each.withColumn("p", F.when(F.col("spread"), (F.row_number().over(inside) - 0.5) / F.col("size")).otherwise(F.col("p")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("p", "g", "m"))), lambda e: e["m"])
    return spread.where(F.col("p") * F.col("size") < BATCH).groupBy("seed", "batch", "fill").agg(F.slice(ordered, 1, BATCH).alias("five"))


def _swapped_unlike(order: Column, last: Column) -> Column:
    """The order with its first two entries exchanged if it would begin with ``last``."""
    return F.when(order[0] == last, F.concat(F.array(order[1], order[0]), F.slice(order, 3, F.size(order)))).otherwise(order)


def rotation_schedule(plans: DataFrame, pool: DataFrame, plan: str, rounds: str, seed: str, member: str) -> DataFrame:
    """A reviewer for every round of every plan, in batches of five that are shuffled anew.

    Rounds are clamped to [1, 50]. The order of a batch is a function of (seed, batch) alone: providers are spread evenly, a
    small pool is gone through again, and where two batches or passes would meet in one reviewer the later one swaps its
    first two. Two reviewers take turns. The pool is a table of any size, worked off in chunks; what a batch begins
    with is computed once per seed, and a batch learns the end of the one before by a join.
    """
    chunks = _pool_chunks(pool, member)
    n_chunks, n_names = chunks.agg(F.count("*"), F.sum(F.size("members"))).first()
    if not n_chunks:
        raise ValueError("the reviewer pool is empty")
    each = plans.select(plan, F.col(seed).alias("seed"), clamp_rounds(F.col(rounds)).alias("_rounds"))
    number = F.sequence(F.lit(0), F.floor((F.max("_rounds") - 1) / BATCH).cast("int"))
    seeds = each.groupBy("seed").agg((number if n_names > 2 else F.array(F.lit(0))).alias("numbers"))
    batches = seeds.select("seed", F.explode("numbers").alias("batch"))
    fills = F.array(*(F.lit(k) for k in range(2 if 2 < n_names < BATCH else 1)))
    orders = written(_first_members(batches.withColumn("fill", F.explode(fills)), chunks, n_chunks))
    first = orders.where("fill = 0").drop("fill")
    if n_names > 2:
        if n_names < BATCH:
            again = orders.where("fill = 1").select(F.col("seed").alias("s"), F.col("batch").alias("b"), F.col("five").alias("more"))
            both = first.join(again, F.col("seed").eqNullSafe(F.col("s")) & (F.col("batch") == F.col("b")))
            passed = F.concat("five", _swapped_unlike(F.col("more"), F.element_at("five", -1)))
            first = both.select("seed", "batch", F.slice(passed, 1, BATCH).alias("five"))
        ends = first.select(F.col("seed").alias("s"), (F.col("batch") + 1).alias("b"), F.element_at("five", -1).alias("last"))
        met = first.join(ends, F.col("seed").eqNullSafe(F.col("s")) & (F.col("batch") == F.col("b")), "left")
        order = F.when(F.col("last").isNull(), F.col("five")).otherwise(_swapped_unlike(F.col("five"), F.col("last")))
        ready = met.select(F.col("seed").alias("s"), "batch", order.alias("five"))
    else:
        turn = lambda k: F.pmod(F.col("batch") * BATCH + k, F.lit(n_names).cast("int"))
        turns = F.transform(F.sequence(F.lit(0), F.lit(BATCH - 1)), lambda k: F.col("five")[turn(k)])
        numbers = each.groupBy("seed").agg(number.alias("numbers")).select(F.col("seed").alias("s"), F.explode("numbers").alias("batch"))
        ready = first.drop("batch").join(numbers, F.col("seed").eqNullSafe(F.col("s"))).select("s", "batch", turns.alias("five"))
    rows = each.join(written(ready), F.col("seed").eqNullSafe(F.col("s"))).select(plan, "batch", "_rounds", F.posexplode("five").alias("_at", member))
    rows = rows.withColumn("round", (F.col("batch") * BATCH + F.col("_at") + 1).cast("int")).where("round <= _rounds")
    return rows.select(plan, "round", "batch", member)
