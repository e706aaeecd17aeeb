"""The query surface under its macro names: each takes a node table first, then the macro's arguments.

The macros re-read source on each call or used one cached table; here the node
table is a DataFrame that the caller has read or built (see ``canopy.sources``).
"""

from __future__ import annotations

from canopy.operators.callers import function_callers
from canopy.operators.deps import link_dependencies, module_dependencies
from canopy.operators.diff import changed_function_summary, structural_diff
from canopy.operators.lookup import (
    find_calls,
    find_definitions,
    find_imports,
    search_symbols,
    table_stats,
)
from canopy.operators.lookup import find_in_tree as find_in_ast
from canopy.operators.metrics import code_structure, complexity_hotspots, function_metrics
from canopy.operators.planning import (
    capture_planning_context,
    capture_quality,
    missing_symbols,
    orientation,
    planning_drift,
)
from canopy.operators.types import external_types as go_external_types
from canopy.operators.types import function_signatures as go_func_signatures
from canopy.operators.types import interface_impls as go_interface_impls
from canopy.operators.types import interfaces as go_interfaces
from canopy.operators.types import struct_fields as go_struct_fields
from canopy.operators.types import type_flow as go_type_flow

__all__ = [
    "capture_planning_context",
    "capture_quality",
    "changed_function_summary",
    "code_structure",
    "complexity_hotspots",
    "find_calls",
    "find_definitions",
    "find_imports",
    "find_in_ast",
    "function_callers",
    "function_metrics",
    "go_external_types",
    "go_func_signatures",
    "go_interface_impls",
    "go_interfaces",
    "go_struct_fields",
    "go_type_flow",
    "link_dependencies",
    "missing_symbols",
    "module_dependencies",
    "orientation",
    "planning_drift",
    "register_views",
    "search_symbols",
    "structural_diff",
    "table_stats",
]


def register_views(nodes, name: str = "ast") -> None:
    """Make a node table, its symbols and the argument-free queries known to ``spark.sql``."""
    from canopy.operators.lookup import symbols

    views = {
        name: nodes,
        f"{name}_symbols": symbols(nodes),
        "function_metrics": function_metrics(nodes),
        "go_struct_fields": go_struct_fields(nodes),
        "go_func_signatures": go_func_signatures(nodes),
        "go_external_types": go_external_types(nodes),
        "go_interfaces": go_interfaces(nodes),
    }
    for view, df in views.items():
        df.createOrReplaceTempView(view)
