"""Text, artifact and gate queries over documents, conversations, pages, orders and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.catalog import Catalog
from canopy.functions import text as X
from canopy.functions.patterns import is_valid_slug, slug_of
from canopy.operators import gate, textscan
from canopy.sources import records
from canopy.sources.forest import table

NEEDLES = ("public license", "tion de les", "keit einheit", "all rights reserved", "ing the of")
TERMS = (("tion", "ACTION"), ("ung", "UNIT"), ("that", "which"), ("émen", "element"), ("el día", "the day"))
PAIRS = (("there", "THERE"), ("the", "THE"), ("THErein", "in-there"), ("ment", "m-t"), ("und", "and"))
# The last line carries the report's verdict; every fourth text has none.
REPORT = (
    "concat(text, '\\n\\n---\\n\\n', case n_chars % 4 when 0 then 'Verdict: PASSED' when 1 then 'Verdict:   FAILED'"
    " when 2 then 'Verdict:\\nCONDITIONAL' else ' Verdict: PASSED' end)"
)


def documents(spark, folder):
    return table(spark, folder, "documents")


def _quote(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def register(catalog: Catalog) -> None:
    add = catalog.add
    add(
        "b08_contains_any",
        lambda s, d: documents(s, d).select("doc_id", X.contains_any(F.col("text"), NEEDLES).alias("found")),
        "select doc_id, " + " or ".join(f"contains(lower(text), '{n}')" for n in NEEDLES) + " as found from documents",
    )
    add(
        "b10_banned_terms",
        lambda s, d: textscan.banned_terms(table(s, d, "conversations"), "conv_id", "text", TERMS),
        "select conv_id, term, replacement, count(*) as texts from conversations, (values "
        + ", ".join(f"('{a}', '{b}')" for a, b in TERMS)
        + ") t(term, replacement) where contains(text, term) group by conv_id, term, replacement",
    )
    term = "regexp_extract(text, '([A-Za-z]{6,})', 1)"
    add(
        "b10_banned_term_table",
        lambda s, d: textscan.banned_terms_of(
            table(s, d, "conversations"), "conv_id", "text", documents(s, d).selectExpr(f"{term} as term", f"upper({term}) as replacement")
        ),
        f"""select conv_id, term, upper(term) as replacement, count(*) as texts
          from conversations, (select distinct {term} as term from documents) where term <> '' and contains(text, term) group by conv_id, term""",
    )
    # A log entry is the document with one more command at its end.
    commands = "concat(text, '\\ngit clean -fd ', case when doc_id % 3 = 0 then ' .reviews/x.json' else ' other/' end)"
    duck_commands = commands.replace("\\n", "' || chr(10) || '")
    add(
        "b11_destructive_commands",
        lambda s, d: documents(s, d)
        .selectExpr("doc_id", f"{commands} as command")
        .where(X.is_destructive(F.col("command"), r"\.reviews"))
        .select("doc_id"),
        rf"""select doc_id from documents where
          regexp_matches({duck_commands}, '(rm|rmdir|Remove-Item|find.*-delete|git\s+clean).*\.reviews')""",
    )
    nested = "text"
    for a, b in PAIRS:
        nested = f"replace({nested}, '{a}', '{b}')"
    add(
        "b12_translate_terms",
        lambda s, d: documents(s, d).select("doc_id", F.md5(X.translate_terms(F.col("text"), PAIRS)).alias("text_md5")),
        f"select doc_id, md5({nested}) as text_md5 from documents",
    )
    add(
        "b07_valid_slugs",
        lambda s, d: table(s, d, "pages")
        .select("page_id", F.explode(F.split(F.regexp_replace("url", r"^https?:/", ""), "/")).alias("segment"))
        .select("page_id", "segment", is_valid_slug(F.col("segment")).alias("valid")),
        r"""select page_id, segment, segment <> '' and not regexp_matches(segment, '[/\\]') as valid from (
          select page_id, unnest(string_split(regexp_replace(url, '^https?:/', ''), '/')) as segment from pages)""",
    )
    add(
        "f09_slugs",
        lambda s, d: documents(s, d).select(
            "doc_id", slug_of(F.concat(F.lit("docs/Plans/"), "source", F.lit(" Plan "), "lang", F.lit(" X"), "n_chars", F.lit(".md"))).alias("slug")
        ),
        r"""select doc_id, replace(lower(regexp_replace(regexp_extract('docs/Plans/' || source || ' Plan ' || lang
          || ' X' || n_chars || '.md', '([^/]*)$', 1), '\.md$', '')), ' ', '-') as slug from documents""",
    )
    add(
        "d07_first_label",
        lambda s, d: documents(s, d).selectExpr("doc_id", f"{REPORT} as report").select(
            "doc_id", X.first_label(F.col("report"), "Verdict", ("PASSED", "CONDITIONAL", "FAILED")).alias("verdict")
        ),
        rf"""select doc_id, regexp_extract({REPORT.replace(chr(92) + 'n', "' || chr(10) || '")},
          '(?m)^Verdict:\s*(PASSED|CONDITIONAL|FAILED)', 1) as verdict from documents""",
    )
    lines = "len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, 'tion .*the')))"
    hits = f"(select doc_id, {lines} as hits from documents where {lines} > 0)"
    add(
        "d08_matching_lines",
        lambda s, d: textscan.count_matching_lines(documents(s, d), "doc_id", "text", "tion .*the"),
        f"select doc_id, cast(hits as bigint) as hits from {hits}",
    )
    add(
        "d08_matching_lines_total",
        lambda s, d: textscan.total_matching_lines(documents(s, d), "doc_id", "text", "tion .*the"),
        f"select count(*) as files, cast(coalesce(sum(hits), 0) as bigint) as hits from {hits}",
    )
    markers = {"licenses": "(?i)license", "addresses": r"\S@\S"}
    add(
        "d09_marked_files",
        lambda s, d: textscan.count_marked_files(documents(s, d), "text", markers),
        r"""select count(case when regexp_matches(text, '(?i)license') then 1 end) as licenses,
          count(case when regexp_matches(text, '\S@\S') then 1 end) as addresses from documents""",
    )
    status = "'**Status:** ' || case o_orderstatus when 'F' then 'Done' when 'O' then 'In Progress' else 'Not Done' end"

    def tasks(s, d):
        return table(s, d, "orders").selectExpr("o_custkey", f"{status} as doc")

    for mode, strict in (("loose", False), ("strict", True)):
        done = "o_orderstatus = 'F'" if strict else "o_orderstatus <> 'O'"
        add(
            f"d10_group_completion_{mode}",
            lambda s, d, strict=strict: gate.group_completion(tasks(s, d), "o_custkey", "doc", strict),
            f"""select o_custkey, count(*) as members, count(case when not ({done}) then 1 end) as incomplete,
              count(case when not ({done}) then 1 end) = 0 as complete from orders group by o_custkey""",
        )

    def quality(s, d):
        rated = table(s, d, "labels").join(documents(s, d).select("doc_id", "lang"), "doc_id")
        return rated.groupBy("lang").agg((F.sum("quality") * 100.0 / F.count("*")).alias("rate"))

    rates = """(select lang, cast(floor(sum(quality) * 100.0 / count(*)) as bigint) as whole
      from labels join documents using (doc_id) group by lang)"""
    coverage = f"(select lang, whole, case when whole < 75 then 'fail' else 'pass' end as severity from {rates})"
    add(
        "d11_threshold_check",
        lambda s, d: gate.threshold_check(quality(s, d), "lang", "rate", 75),
        f"select * from {coverage}",
    )

    def all_checks(s, d, strict):
        rows = gate.stub_check(textscan.total_matching_lines(documents(s, d), "doc_id", "text", "tion .*the"))
        rows = rows.unionByName(gate.annotation_check(textscan.count_marked_files(documents(s, d), "text", markers), strict))
        rows = rows.unionByName(gate.completion_check(gate.group_completion(tasks(s, d), "o_custkey", "doc")))
        return rows.unionByName(gate.coverage_rows(gate.threshold_check(quality(s, d), "lang", "rate", 75), "lang"))

    marked = r"""(select count(case when regexp_matches(text, '(?i)license') then 1 end) as licenses,
      count(case when regexp_matches(text, '\S@\S') then 1 end) as addresses from documents)"""
    notes = {
        False: f"select case when licenses + addresses > 0 then 'warn' else 'pass' end as severity from {marked}",
        True: f"""select case when licenses > 0 then 'fail' else 'pass' end as severity from {marked} union all
          select case when addresses > 0 then 'fail' else 'pass' end from {marked}""",
    }
    for mode, strict in (("plain", False), ("strict", True)):
        add(
            f"d12_gate_roll_up_{mode}",
            lambda s, d, strict=strict: gate.roll_up(all_checks(s, d, strict)),
            f"""select count(case when severity = 'fail' then 1 end) as failures,
              count(case when severity = 'warn' then 1 end) as warnings,
              count(case when severity = 'fail' then 1 end) = 0 as passed from (
              select case when coalesce(sum(hits), 0) > 0 then 'fail' else 'pass' end as severity from {hits}
              union all {notes[strict]}
              union all select case when count(case when o_orderstatus = 'O' then 1 end) > 0 then 'fail' else 'pass' end from orders
              union all select severity from {coverage})""",
        )
    add(
        "d14_next_sequence",
        lambda s, d: gate.next_sequence(table(s, d, "conversations"), "conv_id", "turn"),
        "select conv_id, printf('%03d', max(turn) + 1) as next_id from conversations group by conv_id",
    )
    add(
        "d14_next_task_sequence",
        lambda s, d: gate.next_task_sequence(
            table(s, d, "orders").selectExpr("format_string('P%d-%03d-order.md', o_custkey % 30, o_orderkey % 1200) as name"), "name"
        ),
        """select cast(o_custkey % 30 as varchar) as phase, printf('%03d', max(o_orderkey % 1200) + 1) as next_id
          from orders group by 1""",
    )

    def order_sizes(s, d):
        lines = table(s, d, "lineitem").groupBy("l_orderkey").agg(
            F.count("*").alias("tests"), F.countDistinct("l_partkey").alias("files")
        )
        return lines

    add(
        "d15_size_limits",
        lambda s, d: gate.size_limits(order_sizes(s, d), "l_orderkey", "files", "tests"),
        """select l_orderkey, count(distinct l_partkey) as files, count(*) as tests,
          count(distinct l_partkey) > 10 as over_files, count(*) > 20 as over_tests from lineitem group by l_orderkey
          having count(distinct l_partkey) > 10 or count(*) > 20""",
    )
    add(
        "d15_dependency_chains",
        lambda s, d: gate.dependency_chains(
            table(s, d, "conversations").where("turn > 0").selectExpr("concat(conv_id, '-', turn) as id", "concat(conv_id, '-', turn - 1) as depends_on")
        ),
        """select distinct conv_id || '-' || turn as id, cast(turn as bigint) as chain, turn > 3 as over_limit, false as cyclic
          from conversations where turn > 0""",
    )

    # Each order as a task document: its lines are files and tests, and it depends on the orders before it.
    def task_texts(s, d):
        lines = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("lines"))
        orders = table(s, d, "orders").join(lines, F.expr("o_orderkey = l_orderkey"), "left")
        body = """concat('# P1-', o_orderkey, ': Order of ', o_custkey, '\n\n## Status\nStatus: ', case o_orderstatus when 'F' then 'Done' else 'Ready ' end,
          '\nDepends on: P1-', o_orderkey - 1, ' (before), P1-', o_orderkey - 2, '\nBlocks: none\n\n## Summary\n', o_orderpriority,
          '\n| `not/a/file` | Create |\n\n## Tests\n| Test | What |\n|---|---|\n',
          coalesce(array_join(transform(lines, l -> concat('| `Test_', l.l_linenumber, '` | x |')), '\n'), ''),
          '\n\n## Files\n| File | Action | D |\n|---|---|---|\n',
          coalesce(array_join(transform(lines, l -> concat('| `src/', l.l_partkey, '.go` | ', if(l.l_returnflag = 'N', 'Create', 'Modify'), ' | y |')), '\n'), ''),
          '\n\n## Notes\n| `other/file` | Delete |\n')"""
        return orders.select("o_orderkey", F.expr(body).alias("body"))

    def task_documents(s, d):
        return records.read_tasks(task_texts(s, d), "body")

    add(
        "r01_task_documents",
        lambda s, d: task_documents(s, d).select(
            "o_orderkey", "task_id", "title", "status", F.array_join("depends_on", ",").alias("depends_on"), F.size("blocks").alias("blocks"),
            F.array_join(F.transform("files", lambda f: F.concat(f["action"], F.lit(" "), f["path"])), ",").alias("files"), F.array_join("tests", ",").alias("tests"),
        ),
        """select o_orderkey, 'P1-' || o_orderkey as task_id, 'Order of ' || o_custkey as title, case o_orderstatus when 'F' then 'Done' else 'Ready' end as status,
          concat_ws(',', case when o_orderkey >= 1 then 'P1-' || (o_orderkey - 1) end, case when o_orderkey >= 2 then 'P1-' || (o_orderkey - 2) end) as depends_on, 0 as blocks,
          coalesce(string_agg(case l_returnflag when 'N' then 'Create' else 'Modify' end || ' src/' || l_partkey || '.go', ',' order by l_linenumber, l_partkey, l_returnflag), '') as files,
          coalesce(string_agg('Test_' || l_linenumber, ',' order by l_linenumber, l_partkey, l_returnflag), '') as tests
          from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_custkey, o_orderstatus""",
    )
    add(
        "r04_task_sizes",
        lambda s, d: gate.size_limits(records.task_sizes(task_documents(s, d)).withColumns({"files": F.col("files") * 4, "tests": F.col("tests") * 4}), "task_id", "files", "tests"),
        """select 'P1-' || l_orderkey as task_id, 4 * count(*) as files, 4 * count(*) as tests, 4 * count(*) > 10 as over_files, 4 * count(*) > 20 as over_tests
          from lineitem group by l_orderkey having count(*) > 2""",
    )

    def artifacts(s, d):
        title = F.when(F.col("doc_id") % 10 == 0, "\u3000\t\u00a0").otherwise(F.concat("lang", F.lit(" document of "), "source"))
        slug = F.when(F.col("doc_id") % 13 == 5, F.concat("lang", F.lit("/x"))).otherwise(F.concat("lang", F.lit("-"), "doc_id"))
        first = F.when(F.col("doc_id") % 7 == 3, "../up.md").otherwise(F.concat(F.lit("docs/../docs/tasks/"), "source", F.lit(".md")))
        return documents(s, d).select(
            "doc_id", title.alias("title"), slug.alias("slug"), "source", F.col("text").alias("summary"),
            F.concat("lang", F.lit("\u00a0key\u3000facts")).alias("api_surface"), F.col("n_chars").cast("string").alias("constraints"),
            F.col("source").alias("anti_patterns"),
            F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("minimal_examples"),
            F.array(first, F.concat(F.lit("docs/tasks/"), "lang", F.lit(".md"))).alias("referenced_by"),
        )

    error = """case when doc_id % 13 = 5 then 'invalid slug' when doc_id % 10 = 0 then 'required field "title" is empty'
      when doc_id % 7 = 3 then 'invalid referenced_by path' end"""
    add(
        "a17_validate_artifacts",
        lambda s, d: textscan.validate_artifacts(artifacts(s, d)).select("doc_id", "error"),
        f"select doc_id, {error} as error from documents",
    )
    content = """'# Artifact: ' || lang || ' document of ' || source || chr(10) || chr(10) || '**Primary Source:** ' || source || chr(10)
      || '**Date:** 2024-01-01' || chr(10) || '**Produced by:** planner' || chr(10) || '**Referenced by:** ' || links || chr(10)
      || chr(10) || '---' || chr(10) || chr(10) || '## Summary' || chr(10) || text || chr(10) || chr(10)
      || '## API Surface / Key Facts' || chr(10) || lang || chr(160) || 'key' || chr(12288) || 'facts' || chr(10) || chr(10) || '## Constraints' || chr(10) || n_chars || chr(10)
      || chr(10) || '## Anti-Patterns' || chr(10) || source || chr(10)
      || case when doc_id % 2 = 0 then chr(10) || '## Minimal Examples' || chr(10) || lang || chr(10) else '' end"""
    add(
        "a17_assemble_artifacts",
        lambda s, d: textscan.assemble_artifacts(artifacts(s, d), F.lit("2024-01-01"), "planner").select(
            "slug", "path", "links", "word_count", F.md5("content").alias("content_md5")
        ),
        rf"""select slug, path, links, cast(len(list_filter(regexp_split_to_array(content, '{X.WHITE_SPACE}+'), lambda w: w <> '')) as bigint)
          as word_count, md5(content) as content_md5 from (
          select *, {content} as content from (
          select *, lang || '-' || doc_id as slug, 'docs/artifacts/2024-01-01-' || lang || '-' || doc_id || '.md' as path,
            '[' || source || '](../tasks/' || source || '.md), [' || lang || '](../tasks/' || lang || '.md)' as links
          from documents where {error} is null))""",
    )

    # Every label links to the document with twice its number, where there is one.
    marked_text = (
        "case when doc_id % 3 = 0 then concat('> **Prerequisite:** Read `docs/artifacts/x.md`\\n', text) else text end"
    )

    def targets(s, d):
        return documents(s, d).selectExpr("doc_id", f"{marked_text} as text")

    def links(s, d):
        return table(s, d, "labels").selectExpr("doc_id * 2 as doc_id", "'docs/artifacts/x.md' as artifact")

    add(
        "s04_link_outcomes",
        lambda s, d: textscan.link_outcomes(links(s, d), targets(s, d), "artifact", "doc_id", "text", title_mark=""),
        """select l.doc_id * 2 as doc_id, 'docs/artifacts/x.md' as artifact, case when d.doc_id is null then 'not_found'
          when d.doc_id % 3 = 0 then 'already_present' else 'injected' end as outcome
          from (select distinct doc_id from labels) l left join documents d on d.doc_id = l.doc_id * 2""",
    )
    add(
        "s04_inject_links",
        lambda s, d: textscan.inject_links(links(s, d), targets(s, d), "artifact", "doc_id", "text", title_mark="").select(
            "doc_id", F.md5("text").alias("text_md5")
        ),
        """select d.doc_id, md5(case when l.id is null or d.doc_id % 3 = 0 then
            case when d.doc_id % 3 = 0 then '> **Prerequisite:** Read `docs/artifacts/x.md`' || chr(10) || text else text end
          else split_part(text, chr(10), 1) || chr(10) || '> **Prerequisite:** Read `docs/artifacts/x.md`'
            || ' before writing any code in this phase.' || chr(10)
            || substring(text, length(split_part(text, chr(10), 1)) + 2) end) as text_md5
          from documents d left join (select distinct doc_id * 2 as id from labels) l on l.id = d.doc_id""",
    )
