"""Review-history queries over events, orders, parts and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.catalog import Catalog
from canopy.functions.text import WHITE_SPACE
from canopy.functions.times import utc_instant
from canopy.operators import review
from canopy.session import new_path
from canopy.sources import records, stores
from canopy.sources.forest import table
from canopy.streaming import review_fold

VERDICT = """case event_type when 'error' then 'FAILED' when 'click' then 'CONDITIONAL' when 'signup' then 'PASSED'
  when 'purchase' then 'PASSED' else '' end"""
RANK = "(case {v} when 'FAILED' then 3 when 'CONDITIONAL' then 2 when 'PASSED' then 1 else 0 end)"
NAME = "(case {r} when 3 then 'FAILED' when 2 then 'CONDITIONAL' when 1 then 'PASSED' else '' end)"

ROUNDS = f"""rounds as (select 'plan-' || user_id as plan_slug, strftime(ts, '%Y-%m-%d') as run, event_type as model,
  {VERDICT} as verdict, ts, event_id as seq from events)"""


def rounds(events):
    """Events as review rounds: a user is a plan, a day is a run, its events are the rounds."""
    return events.select(
        F.concat(F.lit("plan-"), "user_id").alias("plan_slug"), F.date_format("ts", "yyyy-MM-dd").alias("run"),
        F.col("event_type").alias("model"), F.expr(VERDICT).alias("verdict"), "ts", F.col("event_id").alias("seq"),
    )


def _rounds(spark, folder):
    return rounds(table(spark, folder, "events"))


def fold_sql(where: str = "true") -> str:
    return f"""runs as (select plan_slug, run, count(*) as n, max({RANK.format(v='verdict')}) as worst,
        arg_max(model, (ts, seq)) as model from rounds where {where} group by 1, 2),
      valid as (select * from runs where worst > 0),
      state as (select plan_slug, cast(sum(n) as bigint) as iteration, arg_max(model, run) as last_model,
        {NAME.format(r='arg_max(worst, run)')} as last_verdict, max(run) as last_review_date from valid group by plan_slug)"""


def register(catalog: Catalog) -> None:
    add = catalog.add
    add(
        "d04_worst_verdict",
        lambda s, d: review.worst_verdict(_rounds(s, d), ["plan_slug"]),
        f"""with {ROUNDS} select plan_slug, {NAME.format(r=f"max({RANK.format(v='verdict')})")} as worst
          from rounds group by plan_slug""",
    )
    add(
        "d05_review_fold",
        lambda s, d: review.fold_reviews(_rounds(s, d)),
        f"with {ROUNDS}, {fold_sql()} select * from state",
    )

    def streamed(s, d):
        """The same fold, with the events read as a stream."""
        events = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parque[t]")  # a pattern, since the table may be a file or a folder
        root = new_path(s)
        instants = rounds(events).withColumn("ts", utc_instant(F.col("ts")))
        review_fold.start_fold(instants, root).awaitTermination()
        return review_fold.current_states(s, root)

    add("t02_stream_review_fold", streamed, f"with {ROUNDS}, {fold_sql()} select * from state")

    def written_states(s, d):
        """Early states written as a version, then the upsert written as the next one."""
        store = stores.VersionedTable(s, new_path(s), folded(s, d, early).schema)
        store.write(folded(s, d, early), 1)
        store.write(stores.replace_by_key(store.read(), folded(s, d, late), ["plan_slug"]), 2)
        return store.read()

    def stored_reports(s, d):
        path = new_path(s)
        names = review.report_names(_rounds(s, d)).select("run", "report")
        review.append_reports(names.where("run < '2024-01-16'"), path)
        review.append_reports(names.where("run >= '2024-01-16'"), path)
        return s.read.schema("report string, run string").parquet(path)

    def reports(s, d):
        vectors = _rounds(s, d).withColumn("vector", F.col("seq") % 7 + 1)
        overall = vectors.groupBy("plan_slug", "run").agg(F.max(F.struct("ts", "seq", "verdict"))["verdict"].alias("overall"))
        return vectors.join(overall, ["plan_slug", "run"])

    add(
        "d06_report_consistency",
        lambda s, d: review.report_consistency(reports(s, d), ["plan_slug", "run"], "verdict", "overall"),
        f"""with {ROUNDS} select plan_slug, run, overall, worst, overall = worst as consistent from (
          select plan_slug, run, arg_max(verdict, (ts, seq)) as overall, {NAME.format(r=f"max({RANK.format(v='verdict')})")} as worst
          from rounds group by 1, 2)""",
    )
    blocked = "last_verdict not in ('PASSED', 'CONDITIONAL')"
    add(
        "d13_review_gate",
        lambda s, d: review.review_gate(review.fold_reviews(_rounds(s, d))),
        f"""with {ROUNDS}, {fold_sql()} select count(*) > 0 as blocked, count(*) || ' plan(s) have FAILED or missing verdicts' as reason,
          count(*) as blocking from state where {blocked}""",
    )
    add(
        "d13_review_gate_strict_empty",
        lambda s, d: review.review_gate(review.fold_reviews(_rounds(s, d)).where("plan_slug is null"), strict=True),
        f"""with {ROUNDS}, {fold_sql()} select count(*) = 0 as blocked, '{review.REVIEW_REQUIRED}' as reason, count(*) as blocking
          from state where plan_slug is null""",
    )
    add(
        "d13_blocking_plans",
        lambda s, d: review.blocking_plans(review.fold_reviews(_rounds(s, d))),
        f"""with {ROUNDS}, {fold_sql()} select plan_slug, last_verdict, iteration, cast(iteration % 3 as int) as next_slot
          from state where {blocked}""",
    )

    # Each event as a state file: views cannot be read, signups use the older field, errors are odd in case and space.
    state_json = (
        "case event_type when 'view' then '{\"iteration\": ' when 'signup' then concat('{\"verdict\":\"PASSED\",\"iteration\":', event_id, '}')"
        " when 'error' then '{\"last_verdict\":\"\\\\t passed\\\\n\"}' when 'click' then '{\"last_verdict\":\"FAILED\",\"iteration\":3}'"
        " else concat('{\"last_verdict\":\"CONDITIONAL\",\"last_model\":\"m\",\"iteration\":', event_id % 5, '}') end"
    )

    def state_files(s, d):
        raw = table(s, d, "events").selectExpr("concat('plan-', event_id) as slug", f"{state_json} as body")
        return review.parse_states(raw, "slug", "body")

    for mode in ("skip", "block"):
        for exact in (False, True):
            blocked = ["event_type = 'click'"]
            blocked += ["event_type = 'view'"] if mode == "block" else []
            blocked += ["event_type = 'error'"] if exact else []
            add(
                f"b09_blocking_{mode}{'_exact' if exact else ''}",
                lambda s, d, mode=mode, exact=exact: review.blocking_plans(state_files(s, d), mode, exact).select("plan_slug"),
                f"select 'plan-' || event_id as plan_slug from events where {' or '.join(blocked)}",
            )
    add(
        "a13_parse_states",
        lambda s, d: state_files(s, d),
        """select 'plan-' || event_id as plan_slug,
          cast(case event_type when 'signup' then event_id when 'click' then 3 when 'view' then 0 when 'error' then 0
            else event_id % 5 end as bigint) as iteration,
          case when event_type in ('view', 'signup', 'error', 'click') then '' else 'm' end as last_model,
          case event_type when 'view' then '' when 'signup' then 'PASSED' when 'error' then chr(9) || ' passed' || chr(10) when 'click' then 'FAILED'
            else 'CONDITIONAL' end as last_verdict,
          '' as last_review_date, event_type = 'view' as malformed from events""",
    )
    add(
        "a13_event_props",
        lambda s, d: table(s, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("iteration")),
        r"""select event_id, cast(regexp_extract(props, '"k": (\d+)', 1) as bigint) as iteration from events""",
    )

    def folded(s, d, where):
        return review.fold_reviews(_rounds(s, d).where(where))

    early, late = "run < '2024-01-16'", "run >= '2024-01-16'"
    add(
        "a14_upsert_states",
        lambda s, d: stores.replace_by_key(folded(s, d, early), folded(s, d, late), ["plan_slug"]),
        f"""with {ROUNDS}, base as (with {fold_sql(early)} select * from state), news as (with {fold_sql(late)} select * from state)
          select * from base where plan_slug not in (select plan_slug from news) union all select * from news""",
    )
    upsert = catalog.oracle["a14_upsert_states"]
    add("a14_write_states", written_states, upsert)
    add(
        "a15_report_store",
        stored_reports,
        f"""with {ROUNDS} select run, 'review-' || run || '-' || plan_slug || '-iter' ||
            (row_number() over (partition by plan_slug order by run, ts, seq) - 1) || '-r' ||
            row_number() over (partition by plan_slug, run order by ts, seq) || '.md' as report from rounds""",
    )
    add(
        "a15_report_names",
        lambda s, d: review.report_names(_rounds(s, d)),
        f"""with {ROUNDS}, num as (select *, row_number() over (partition by plan_slug, run order by ts, seq) as round,
            row_number() over (partition by plan_slug order by run, ts, seq) - 1 as iteration from rounds)
          select plan_slug, run, round, iteration,
            'review-' || run || '-' || plan_slug || '-iter' || iteration || '-r' || round || '.md' as report from num""",
    )
    add(
        "l05_next_slot",
        lambda s, d: review.fold_reviews(_rounds(s, d)).select("plan_slug", review.next_slot(F.col("iteration")).alias("slot")),
        f"with {ROUNDS}, {fold_sql()} select plan_slug, cast(iteration % 3 as int) as slot from state",
    )
    add(
        "l06_clamp_rounds",
        lambda s, d: table(s, d, "part").select("p_partkey", review.clamp_rounds(F.col("p_size") * 2 - 20).alias("rounds")),
        "select p_partkey, greatest(1, least(50, p_size * 2 - 20)) as rounds from part",
    )
    # Entries end in white space of several kinds; a line end inside an entry makes it invalid.
    raw = "o_orderstatus || '/' || o_orderpriority || chr(9) || ' , ' || 'a/b' || chr(10) || 'c' || ',' || chr(160) || o_orderpriority || ',,' || case when o_orderkey % 2 = 0 then 'pool/m-' || o_orderstatus else '/x' end"
    defaults = ",".join(review.DEFAULT_REVIEWERS)
    add(
        "a16_parse_reviewers",
        lambda s, d: table(s, d, "orders")
        .selectExpr("o_orderkey", f"{raw} as raw")
        .select("o_orderkey", F.array_join(review.parse_reviewers(F.col("raw")), ",").alias("pool")),
        rf"""select o_orderkey, case when pool = '' then '{defaults}' else pool end as pool from (
          select o_orderkey, array_to_string(list_filter(list_transform(string_split({raw}, ','), lambda e: regexp_replace(e, '^{WHITE_SPACE}+|{WHITE_SPACE}+$', '', 'g')),
            lambda e: regexp_matches(e, '^[a-zA-Z0-9_./-]+$') and regexp_matches(e, '^[^/]+/.+$')), ',') as pool from orders)""",
    )

    def pools(s, d):
        return table(s, d, "orders").selectExpr("o_orderkey", "o_custkey", "o_orderstatus || '/' || o_orderpriority as reviewer")

    out = "lower(o_orderstatus || '/' || o_orderpriority) = 'f/1-urgent'"
    add(
        "b06_exclude_reviewer",
        lambda s, d: review.exclude_reviewer(pools(s, d), "o_custkey", "reviewer", " F/1-Urgent "),
        f"""select o_orderkey, o_custkey, o_orderstatus || '/' || o_orderpriority as reviewer from orders o
          where not ({out}) or o_custkey in (select o_custkey from orders group by 1 having bool_and({out}))""",
    )
    add(
        "l03_interleave",
        lambda s, d: review.interleave(table(s, d, "documents").select("doc_id", "source"), "source", "doc_id"),
        """select doc_id, source, (row_number() over (partition by source order by doc_id) - 0.5::double)
          / count(*) over (partition by source) as position from documents""",
    )
    add(
        "l03_interleave_seeded",
        lambda s, d: review.interleave(table(s, d, "documents").select("doc_id", "source"), "source", "doc_id", seed=7),
        """select doc_id, source, (row_number() over (partition by source order by md5(doc_id || ':7'), doc_id) - 0.5::double)
          / count(*) over (partition by source) as position from documents""",
    )

    # The greedy pick itself, member by member: how many each group has left, and the last one's group.
    def picked(order: str) -> str:
        return f"""with recursive sized as materialized (
            select source, count(*) as size, row_number() over (order by source) as spot from documents group by source),
          start as (select list(size order by spot) as counts, sum(size) as total from sized),
          walk(step, counts, total, pick) as (
            select 0, counts, total, 0 from start
            union all
            select step + 1, list_transform(counts, lambda c, i: case when i = best then c - 1 else c end), total, best from (
              select step, counts, total, case when list_max(list_transform(counts, lambda c, i: case when i = pick then 0 else c end)) = 0 then pick
                else list_position(list_transform(counts, lambda c, i: case when i = pick then -1 else c end),
                  list_max(list_transform(counts, lambda c, i: case when i = pick then -1 else c end))) end as best
              from walk where step < total)),
          picks as (select step as position, pick, row_number() over (partition by pick order by step) as turn from walk where step > 0),
          members as (select doc_id, source, row_number() over (partition by source order by {order}) as turn from documents)
          select doc_id, members.source, cast(position as bigint) as position
          from members join sized on sized.source = members.source join picks on picks.pick = sized.spot and picks.turn = members.turn"""

    def apart(s, d, **options):
        return review.interleave_apart(table(s, d, "documents").select("doc_id", "source"), "source", "doc_id", **options)

    add("l03_interleave_apart", apart, picked("doc_id"))
    add("l03_interleave_apart_seeded", lambda s, d: apart(s, d, seed=7), picked("md5(doc_id || ':7'), doc_id"))

    def schedule(s, d):
        pool = table(s, d, "orders").select(F.concat_ws("/", F.col("o_orderstatus"), F.col("o_orderpriority")).alias("reviewer"))
        return review.rotation_schedule(table(s, d, "part"), pool, "p_partkey", "p_size", "p_partkey", "reviewer")

    add(
        "l04_rotation_schedule",
        schedule,
        """with pool as materialized (select distinct o_orderstatus || '/' || o_orderpriority as m, o_orderstatus as g from orders),
          sized as materialized (select g, m, count(*) over (partition by g) as size from pool),
          batches as materialized (select p_partkey, least(50, greatest(1, p_size)) as rounds, unnest(range(0, (least(50, greatest(1, p_size)) - 1) // 5 + 1)) as b from part),
          spots as materialized (select p_partkey, rounds, b, g, m, (row_number() over (partition by p_partkey, b, g
              order by md5(p_partkey || ':' || b || ':0:' || m), m) - 0.5::double) / size as p from batches, sized),
          ranked as materialized (select p_partkey, rounds, b, m, row_number() over (partition by p_partkey, b order by p, g, m) as k from spots),
          firsts as materialized (select p_partkey, rounds, b, m, k from ranked where k <= 5),
          ends as materialized (select p_partkey, b + 1 as b, m as last from firsts where k = 5),
          heads as materialized (select p_partkey, b, m as head from firsts where k = 1)
          select p_partkey, cast(b * 5 + place as int) as round, cast(b as int) as batch, m as reviewer from (
            select f.p_partkey, f.b, f.m, f.rounds, case when head = last and k <= 2 then 3 - k else k end as place
            from firsts f join heads using (p_partkey, b) left join ends using (p_partkey, b))
          where b * 5 + place <= rounds""",
    )

    # Each document as a review report; every fifth has text behind its verdict, so that this does not count.
    rank = "case (doc_id * 7 + k * 5 + n_chars) % 4 when 0 then 'FAILED' when 1 then 'CONDITIONAL' else 'PASSED' end"
    overall = "case doc_id % 3 when 0 then 'FAILED' when 1 then 'CONDITIONAL' else 'PASSED' end"

    def report_texts(s, d):
        vectors = F.array_join(F.expr(f"transform(sequence(1, 7), k -> concat('| ', k, ' | vector ', k, ' | ', {rank}, ' | ', lang, ' |'))"), "\n")
        head = F.format_string("# Report: x\n\n**Plan:** plan-%s\n**Reviewer:** %s/%s\n**Iteration:** %d\n**Date:** 2024-01-02\n\n---\n\n", "doc_id", "lang", "source", F.col("doc_id") % 9)
        tail = F.expr(f"concat('\\n\\nVerdict: FAILED\\n', text, '\\n\\nVerdict: ', {overall}, case when doc_id % 5 = 0 then '\\nmore' else '\\n \\n' end)")
        return table(s, d, "documents").select("doc_id", F.concat(head, F.lit("| # | V | R | N |\n|---|---|---|---|\n"), vectors, tail).alias("body"))

    add(
        "r02_review_reports",
        lambda s, d: records.report_rows(records.read_reports(report_texts(s, d), "body")),
        f"""select doc_id, 'plan-' || doc_id as plan_slug, lang || '/' || source as reviewer, doc_id % 9 as iteration, '2024-01-02' as date,
          case when doc_id % 5 <> 0 then {overall} end as verdict, cast(k as int) as number, 'vector ' || k as vector, {rank} as result
          from documents, range(1, 8) t(k)""",
    )

    def issue_texts(s, d):
        critical = "case when doc_id % 3 = 0 then 'None.' else concat('### ', source, '\n', lang, ' ', n_chars, '\n\n### Security\nx') end"
        major = "case when doc_id % 2 = 0 then concat('### ', lang, '\n\nsee ', doc_id) else 'None.' end"
        body = f"""concat('# Report: x\n\n', replace(text, '#', ''), '\n\n## Critical Issues (must fix)\n\n', {critical}, '\n\n---\n\n## Major Issues (should fix)\n\n', {major}, '\n\n---\n\nVerdict: FAILED\n')"""
        return table(s, d, "documents").selectExpr("doc_id", f"{body} as body")

    add(
        "r04_report_issues",
        lambda s, d: records.report_issues(issue_texts(s, d), "body"),
        """select doc_id, 'critical' as severity, 1 as number, source as title, lang || ' ' || n_chars as detail from documents where doc_id % 3 <> 0
          union all select doc_id, 'critical', 2, 'Security', 'x' from documents where doc_id % 3 <> 0
          union all select doc_id, 'major', 1, lang, 'see ' || doc_id from documents where doc_id % 2 = 0""",
    )
    add(
        "r03_report_consistency",
        lambda s, d: review.report_consistency(records.report_rows(records.read_reports(report_texts(s, d), "body")), ["plan_slug"], "result", "verdict"),
        f"""select plan_slug, overall, worst, overall = worst as consistent from (select 'plan-' || doc_id as plan_slug,
            case when doc_id % 5 <> 0 then {overall} end as overall,
            {NAME.format(r=f"max({RANK.format(v=f'({rank})')})")} as worst from documents, range(1, 8) t(k) group by doc_id)""",
    )
