"""The lineage graph: foreign keys and model dependencies merged."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats as fmt
from ..functions.identity import project_of, qualified_id
from ..schemas import local_frame
from .longform import union_all


def _named(*pairs: tuple[str, str | Column]) -> Column:
    """Rows ``id, style`` for several names of one input row."""
    return F.inline(
        F.array(
            *[
                F.struct(
                    F.col(name).alias("id"),
                    (F.lit(style) if isinstance(style, str) else style).alias("style"),
                )
                for name, style in pairs
            ]
        )
    )


def lineage_nodes(fks: DataFrame, models: DataFrame, deps: DataFrame) -> DataFrame:
    """NODES: ends of foreign keys (db), sources (source), models (box).

    A name with several styles keeps the one of highest priority. A parent whose
    name contains a dot is a source. Candidates collapse per task before the
    shuffle, so a table with very many references is no hot spot.
    """
    dotted = F.when(F.col("dependency").contains("."), "source").otherwise("box")
    candidates = union_all(
        [
            fks.select(_named(("source_table", "db"), ("target_table", "db"))),
            models.select(F.col("name").alias("id"), F.lit("box").alias("style")),
            deps.select(_named(("model_name", "box"), ("dependency", dotted))),
        ]
    )
    ranks = F.create_map(*[F.lit(x) for x in chain(*fmt.STYLE_PRIORITY.items())])
    return (
        candidates.groupBy("id")
        .agg(F.max(ranks[F.col("style")]).alias("rank"))
        .select("id", F.col("id").alias("label"), _style_of(F.col("rank")).alias("style"))
    )


def _style_of(rank: Column) -> Column:
    names = F.create_map(
        *[F.lit(x) for x in chain(*((r, s) for s, r in fmt.STYLE_PRIORITY.items()))]
    )
    return names[rank]


def lineage_edges(fks: DataFrame, deps: DataFrame) -> DataFrame:
    """EDGES: child to referenced table (labelled), parent to model; no duplicates."""
    source, target = F.col("source_table"), F.col("target_table")
    dash = F.lit("-")
    keys = fks.select(
        F.concat(source, dash, target, dash, F.lit(fmt.FK_LABEL)).alias("id"),
        source.alias("source"),
        target.alias("target"),
        F.lit(fmt.FK_LABEL).alias("label"),
    )
    parent, model = F.col("dependency"), F.col("model_name")
    logical = deps.select(
        F.concat(parent, dash, model).alias("id"),
        parent.alias("source"),
        model.alias("target"),
        F.lit("").alias("label"),
    )
    return keys.unionByName(logical).distinct()


def _origin(fks: DataFrame) -> Column:
    """Where the tables of foreign keys belong, as far as the keys tell it."""
    known = [F.col(c) for c in ("source", "table_schema") if c in fks.columns]
    return F.concat_ws("/", *known) if known else F.lit("")


def _parent_kind() -> Column:
    return F.when(F.col("dep_kind") == "source", "source").otherwise("box")


def qualified_nodes(fks: DataFrame, models: DataFrame, deps: DataFrame) -> DataFrame:
    """NODES plus ``origin``: objects of unlike origin or kind are nodes of their own."""
    project = project_of(F.col("manifest_path"))
    ends = [
        fks.select(F.lit("db").alias("style"), _origin(fks).alias("origin"), F.col(c).alias("label"))
        for c in ("source_table", "target_table")
    ]
    named = [
        models.select(F.lit("box").alias("style"), project.alias("origin"), F.col("name").alias("label")),
        deps.select(F.lit("box").alias("style"), project.alias("origin"), F.col("model_name").alias("label")),
        deps.select(_parent_kind().alias("style"), project.alias("origin"), F.col("dependency").alias("label")),
    ]
    nodes = union_all([*ends, *named]).where("label IS NOT NULL").distinct()
    return nodes.select(qualified_id(F.col("style"), F.col("origin"), F.col("label")).alias("id"), "label", "style", "origin")


def qualified_edges(fks: DataFrame, deps: DataFrame) -> DataFrame:
    """EDGES between the nodes of `qualified_nodes`; the id is made of both ends and the label."""
    project, origin = project_of(F.col("manifest_path")), _origin(fks)
    keys = fks.select(
        qualified_id("db", origin, F.col("source_table")).alias("source"),
        qualified_id("db", origin, F.col("target_table")).alias("target"),
        F.lit(fmt.FK_LABEL).alias("label"),
    )
    logical = deps.select(
        qualified_id(_parent_kind(), project, F.col("dependency")).alias("source"),
        qualified_id("box", project, F.col("model_name")).alias("target"),
        F.lit("").alias("label"),
    )
    edges = keys.unionByName(logical).distinct()
    return edges.select(
        qualified_id(F.col("source"), F.col("target"), F.col("label")).alias("id"), "source", "target", "label"
    )


def node_line(nodes_id: Column, style: Column, label: Column | None = None) -> Column:
    line = F.lit(None).cast("string")
    shown = nodes_id if label is None else label
    for name, pattern in fmt.NODE_FORMATS.items():
        line = F.when(style == name, F.format_string(pattern, nodes_id, shown)).otherwise(line)
    return line


def lineage_mermaid(nodes: DataFrame, edges: DataFrame, doc_name: str = "lineage") -> DataFrame:
    """LINES of the graph text: header, nodes by name, blank line, edges by id.

    One row per line, ordered by ``section, part, ordinal``: the graph is never
    gathered into one string, `lakedoc.sinks.files.write_lines` sorts and writes it
    in parallel.
    """
    fixed = local_frame(
        nodes.sparkSession,
        [(doc_name, 0, "", 0, fmt.GRAPH_HEADER), (doc_name, 2, "", 0, "")],
        "LINES",
    )
    node_lines = nodes.select(
        F.lit(doc_name).alias("doc_name"),
        F.lit(1).alias("section"),
        F.col("id").alias("part"),
        F.lit(0).cast("long").alias("ordinal"),
        node_line(F.col("id"), F.col("style"), F.col("label")).alias("line"),
    )
    source, target, label = F.col("source"), F.col("target"), F.col("label")
    edge_lines = edges.select(
        F.lit(doc_name).alias("doc_name"),
        F.lit(3).alias("section"),
        F.col("id").alias("part"),
        F.lit(0).cast("long").alias("ordinal"),
        F.when(label != "", F.format_string(fmt.LABELLED_EDGE_FORMAT, source, label, target))
        .otherwise(F.format_string(fmt.PLAIN_EDGE_FORMAT, source, target))
        .alias("line"),
    )
    return union_all([fixed, node_lines, edge_lines])


def lineage_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``kind, id, json``: one JSON record per node and per edge."""
    label = F.struct(F.col("label")).alias("data")
    node = F.to_json(F.struct("id", label, F.col("style").alias("type")))
    edge = F.to_json(F.struct("id", "source", "target", "label"))
    return nodes.select(F.lit("node").alias("kind"), "id", node.alias("json")).unionByName(
        edges.select(F.lit("edge").alias("kind"), "id", edge.alias("json"))
    )
