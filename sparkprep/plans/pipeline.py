"""Pipelines written down as nodes and edges: each node is one operator of this library with its options."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkprep.operators import (
    aggregate, columns, compare, convert, correlation, corpus, custom, hierarchy, joins, json_ops, profile, reshape, rows,
    text,
)
from sparkprep.session import cut
from sparkprep.sources import calendar, files, jdbc, sinks

# How many tables an operator takes; "many" operators take their inputs as a list of arguments.
SOURCES: dict[str, Callable] = {
    "read_file": files.read_file, "read_csv": files.read_csv, "read_json": files.read_json,
    "read_parquet": files.read_parquet, "read_xml": files.read_xml, "inline": files.inline,
    "generate_calendar": calendar.generate_calendar, "read_jdbc": jdbc.read_jdbc, "read_mongodb": jdbc.read_mongodb,
    "python_input": custom.python_input,
}
SINGLE: dict[str, Callable] = {
    f.__name__: f
    for f in (
        columns.select_columns, columns.rename, columns.rename_columns, columns.rename_dynamic, columns.position_columns,
        columns.concat_columns, columns.formula, rows.filter_rows, rows.sort_rows, rows.row_id, rows.deduplicate,
        rows.sample_rows, aggregate.aggregate, aggregate.chart_table, aggregate.create_json, aggregate.markdown_table,
        reshape.pivot, reshape.unpivot, reshape.split_to_columns, reshape.split_to_rows, profile.summary,
        profile.frequencies, profile.unique_keys, profile.schema_table, correlation.correlation_matrix,
        hierarchy.hierarchy_paths, json_ops.explode_json, json_ops.flatten_json, json_ops.expand_json_list,
        json_ops.validate_json, text.extract, text.cleanse, text.markdown_style, text.validate_markdown,
        text.prompt_column, convert.convert_types, convert.text_to_datetime, convert.datetime_to_text,
        calendar.dynamic_calendar, corpus.to_documents, corpus.fixed_size_chunks, corpus.recursive_chunks,
        corpus.sentence_chunks, corpus.parse_html, corpus.html_to_markdown, custom.python_transform,
        custom.pandas_transform, custom.enrich, sinks.record_payload, jdbc.mapped,
    )
}
DOUBLE: dict[str, Callable] = {"join_datasets": joins.join_datasets, "compare": compare.compare}
MANY: dict[str, Callable] = {
    "concat_rows": rows.concat_rows, "concat_side_by_side": rows.concat_side_by_side,
    "sql_query": lambda *frames, query: custom.sql_query(list(frames), query),
}
SINKS: dict[str, Callable] = {
    f.__name__: f
    for f in (sinks.write_file, sinks.write_csv, sinks.write_json, sinks.write_parquet, sinks.write_xml, jdbc.write_jdbc,
              custom.python_output)
}
SWITCH = "switch_rows"
SILENT = ("annotation",)


def _flow(spec: dict | str) -> tuple[dict, list]:
    spec = json.loads(spec) if isinstance(spec, str) else spec
    flow = spec["pipelines"][0]["flow"] if "pipelines" in spec else spec
    nodes = {n["id"]: n for n in flow["nodes"] if n["type"] not in SILENT}
    edges = [e for e in flow.get("edges", []) if e["source"] in nodes and e["target"] in nodes]
    return nodes, edges


def _ordered(nodes: dict, edges: list, until: str | None) -> list[str]:
    """The nodes with their inputs first; only what ``until`` needs, if given."""
    inputs = {i: [e["source"] for e in edges if e["target"] == i] for i in nodes}
    done, entered, order = set(), set(), []

    def visit(node: str) -> None:
        if node in done:
            return
        if node in entered:
            raise ValueError(f"the pipeline runs in a circle at node {node!r}")
        entered.add(node)
        for source in inputs[node]:
            visit(source)
        done.add(node)
        order.append(node)

    if until is not None and until not in nodes:
        raise ValueError(f"no node {until!r} in the pipeline")
    for node in nodes if until is None else [until]:
        visit(node)
    return order


def _filled_in(value, params: dict):
    """``${name}`` in texts stands for a parameter; a text that is only a parameter takes its value and type."""
    if isinstance(value, dict):
        return {k: _filled_in(v, params) for k, v in value.items()}
    if isinstance(value, list):
        return [_filled_in(v, params) for v in value]
    if isinstance(value, str):
        for name, given in params.items():
            if value == "${" + name + "}":
                return given
            value = value.replace("${" + name + "}", str(given))
    return value


def run_pipeline(
    spark: SparkSession, spec: dict | str, until: str | None = None, params: dict | None = None, shared: str = "recompute"
) -> dict[str, DataFrame | tuple[DataFrame, DataFrame] | None] | DataFrame:
    """Compose a pipeline document into one lazy DataFrame per node and run its sinks.

    The document is ``{"nodes": [{id, type, data}], "edges": [{source, target, sourceHandle, targetHandle}]}``, also
    inside ``{"pipelines": [{"flow": ...}]}``; ``type`` is an operator of this library and ``data`` its options. Inputs
    are ordered by target handle. An edge from a switch has sourceHandle true or false. ``until`` composes only what
    that node needs and returns its table. ``shared='write'`` writes a table that several nodes read, instead of
    leaving it to be computed for each of them.
    """
    if shared not in ("recompute", "write"):
        raise ValueError("shared must be 'recompute' or 'write'")
    nodes, edges = _flow(spec)
    made: dict = {}
    for node in _ordered(nodes, edges, until):
        kind, options = nodes[node]["type"], _filled_in(nodes[node].get("data", {}), params or {})
        incoming = [e for e in edges if e["target"] == node]
        frames = [_branch(made, nodes, e) for e in sorted(incoming, key=lambda e: str(e.get("targetHandle") or ""))]
        try:
            made[node] = _apply(spark, kind, frames, options)
        except (TypeError, ValueError) as error:
            raise ValueError(f"node {node!r} ({kind}): {error}") from error
        if shared == "write" and isinstance(made[node], DataFrame) and sum(e["source"] == node for e in edges) > 1:
            made[node] = cut(made[node], "shared")
    return made if until is None else made[until]


def _branch(made: dict, nodes: dict, edge: dict) -> DataFrame:
    table = made[edge["source"]]
    if nodes[edge["source"]]["type"] != SWITCH:
        return table
    handle = str(edge.get("sourceHandle", "")).lower()
    if handle not in ("true", "false"):
        raise ValueError(f"an edge from switch {edge['source']!r} needs sourceHandle true or false")
    return table[0] if handle == "true" else table[1]


def _apply(spark: SparkSession, kind: str, frames: list[DataFrame], options: dict):
    if kind in SOURCES:
        return SOURCES[kind](spark, **options)
    counts = {**dict.fromkeys([*SINGLE, *SINKS, SWITCH], 1), **dict.fromkeys(DOUBLE, 2)}
    if kind in counts and len(frames) != counts[kind]:
        raise ValueError(f"takes {counts[kind]} input(s), not {len(frames)}")
    if kind == SWITCH:
        return rows.switch_rows(frames[0], **options)
    for table in (SINGLE, DOUBLE, MANY, SINKS):
        if kind in table:
            return table[kind](*frames, **options)
    raise ValueError(f"unknown node type {kind!r}")
