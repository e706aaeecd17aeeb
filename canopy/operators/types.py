"""Type questions over parent-child chains: fields, interfaces, signatures, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions import predicates as P
from canopy.functions.patterns import ilike
from canopy.nodes import child_of
from canopy.plans.copies import copies_in_order

# Node types that can be the type of a field.
FIELD_TYPE_KINDS = (
    "qualified_type", "pointer_type", "type_identifier", "slice_type", "map_type",
    "array_type", "interface_type", "function_type", "channel_type",
)

# How a node of each type uses a type.
USAGE_KINDS = {
    "type_spec": "DEFINED",
    "method_elem": "INTERFACE_METHOD",
    "parameter_declaration": "PARAM_TYPE",
    "field_declaration": "STRUCT_FIELD",
    "type_assertion_expression": "TYPE_ASSERT",
    "type_conversion_expression": "TYPE_CONVERT",
    "type_identifier": "TYPE_REF",
    "qualified_type": "TYPE_REF",
    "function_declaration": "FUNC_SIGNATURE",
    "method_declaration": "METHOD_SIGNATURE",
}
# Node types that only mention a name.
NOT_A_USAGE = ("identifier", "comment", "interpreted_string_literal", "field_identifier")


def children_with_parents(nodes: DataFrame) -> DataFrame:
    """Every node that has a parent, with the parent's type and name."""
    child = nodes.select("file_path", "node_id", "parent_id", "type", "name").alias("c")
    parent = nodes.select("file_path", "node_id", "type", "name").alias("p")
    return child.join(parent, child_of("c", "p")).select(
        "c.file_path", "c.node_id", "c.type", "c.name", F.col("p.type").alias("parent_type"), F.col("p.name").alias("parent_name")
    )


def _links(nodes: DataFrame, *types: str) -> DataFrame:
    return nodes.where(F.col("type").isin(*types)).select("file_path", "node_id", "parent_id")


def _named_bodies(nodes: DataFrame, body: str, specs: Column | None = None) -> DataFrame:
    """type_spec nodes with their body of one type: file_path, spec_name, body_id."""
    spec = nodes.where(F.col("type") == "type_spec")
    spec = spec.where(specs) if specs is not None else spec
    pairs = spec.select("file_path", "node_id", "name").alias("s").join(_links(nodes, body).alias("b"), child_of("b", "s"))
    return pairs.select("s.file_path", F.col("s.name").alias("spec_name"), F.col("b.node_id").alias("body_id"))


def struct_fields(nodes: DataFrame) -> DataFrame:
    """One row per field and type child: type_spec -> struct -> list -> field -> type."""
    structs = _named_bodies(nodes, "struct_type", ~P.is_generated_file())
    lists = structs.alias("s").join(
        _links(nodes, "field_declaration_list").alias("l"), child_of("l", "s", "body_id")
    ).select("s.file_path", "s.spec_name", F.col("l.node_id").alias("list_id"))
    field_nodes = nodes.where(F.col("type") == "field_declaration").select("file_path", "node_id", "parent_id", "name")
    fields = lists.alias("l").join(field_nodes.alias("f"), child_of("f", "l", "list_id")).select(
        "l.file_path", "l.spec_name", F.col("f.name").alias("field_name"), F.col("f.node_id").alias("field_id")
    )
    kinds = nodes.where(F.col("type").isin(*FIELD_TYPE_KINDS)).select("file_path", "node_id", "parent_id", "peek", "type")
    typed = fields.alias("f").join(kinds.alias("t"), child_of("t", "f", "field_id"))
    rows = typed.select(
        F.col("f.spec_name").alias("struct_name"), "f.field_name", F.col("t.peek").alias("field_type"),
        F.col("t.type").alias("type_kind"), "f.file_path", "t.node_id",
    )
    return rows.orderBy("struct_name", "field_name", "file_path", "node_id").drop("node_id")


def _receiver() -> Column:
    return F.regexp_extract(F.try_element_at("parameters", F.lit(1))["name"], r"\*?(\w+)$", 1)


def function_signatures(nodes: DataFrame) -> DataFrame:
    """Functions and methods with receiver, return type and the other parameters."""
    wanted = F.col("type").isin("function_declaration", "method_declaration")
    found = nodes.where(wanted & ~P.is_test_file() & ~P.is_generated_file())
    rows = found.select(
        "name",
        F.when(F.col("type") == "method_declaration", _receiver()).alias("receiver"),
        F.col("signature_type").alias("returns"),
        F.filter("parameters", lambda p: p["type"] != "receiver").alias("params"),
        "file_path",
        "start_line",
        "node_id",
    )
    order = [F.coalesce("receiver", F.lit("")), F.col("name").asc_nulls_last(), "file_path", "node_id"]
    return rows.orderBy(*order).drop("node_id")


def type_flow(nodes: DataFrame, type_name: str) -> DataFrame:
    """Where a type is defined and used, by name or by a mention in the source text."""
    usage = F.coalesce(F.create_map(*[F.lit(x) for pair in USAGE_KINDS.items() for x in pair])[F.col("type")], F.col("type"))
    mentioned = (F.col("name") == type_name) | ilike(F.col("peek"), f"%{type_name}%")
    found = nodes.where(mentioned & ~F.col("type").isin(*NOT_A_USAGE))
    rows = found.select(usage.alias("usage_kind"), "file_path", "start_line", "peek", "node_id")
    return rows.orderBy("file_path", "start_line", "node_id").drop("node_id")


def external_type_files(nodes: DataFrame) -> DataFrame:
    """The files that use each qualified type, with the number of uses: one row per type and file."""
    used = nodes.where((F.col("type") == "qualified_type") & ~P.is_generated_file())
    return used.groupBy(F.col("peek").alias("external_type"), "file_path").agg(F.count("*").alias("uses"))


def external_types(nodes: DataFrame) -> DataFrame:
    """Qualified types with usage count and the number of distinct files; ``external_type_files`` lists these."""
    totals = external_type_files(nodes).groupBy("external_type").agg(F.sum("uses").alias("usage_count"), F.count("*").alias("file_count"))
    return totals.orderBy(F.desc("usage_count"), "external_type")


def interfaces(nodes: DataFrame) -> DataFrame:
    """Interfaces with their method count (0 included) and whether they are exported."""
    bodies = _named_bodies(nodes, "interface_type", ~P.is_generated_file())
    # Methods are counted per parent before the join, so a huge interface is one row in it.
    methods = nodes.where(F.col("type") == "method_elem").groupBy("file_path", "parent_id").agg(F.count("*").alias("n"))
    counted = bodies.alias("b").join(methods.alias("m"), child_of("m", "b", "body_id"), "left")
    totals = counted.groupBy(F.col("b.spec_name").alias("iface_name"), F.col("b.file_path").alias("file_path")).agg(
        F.coalesce(F.sum("m.n"), F.lit(0)).alias("method_count")
    )
    return totals.select("iface_name", "method_count", P.is_exported("iface_name").alias("exported"), "file_path").orderBy(
        F.col("iface_name").asc_nulls_last(), "file_path"
    )


def interface_impls(nodes: DataFrame, iface_name: str) -> DataFrame:
    """Methods named like a method of the interface; a repeated method name repeats its matches."""
    bodies = _named_bodies(nodes, "interface_type", F.col("name") == iface_name)
    elems = nodes.where(F.col("type") == "method_elem").select("file_path", "parent_id", "name")
    names = (
        bodies.alias("b")
        .join(elems.alias("m"), child_of("m", "b", "body_id"))
        .groupBy(F.col("m.name").alias("method_name"))
        .agg(F.count("*").alias("times"))
    )
    methods = nodes.where((F.col("type") == "method_declaration") & ~P.is_test_file()).select(
        _receiver().alias("receiver"), F.col("name").alias("method_name"), "file_path", "start_line"
    )
    matched = methods.join(names, "method_name").select("receiver", "method_name", "file_path", "start_line", "times")
    order = [F.col("receiver").asc_nulls_last(), "method_name", "file_path", "start_line"]
    return copies_in_order(matched, "times", order)
