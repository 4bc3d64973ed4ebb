"""Models, columns and dependencies from parsed project manifests.

Input is the frame of `lakedoc.sources.manifests`: one row per manifest file with
its ``manifest_path`` and the parsed struct ``manifest``. The path stays in every
result and in every join key, so any number of projects can be read together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import NOT_AVAILABLE
from ..functions.parents import direct_parents, parent_chart
from ..functions.text import first_filled, sql_or_note
from .joins import lookup_join


def manifest_nodes(manifests: DataFrame) -> DataFrame:
    """``manifest_path, unique_id, node``: one row per node.

    The outer form with a filter keeps Catalyst from inferring a size condition on the
    parsed map, which would be pushed below the parser and parse every text again.
    """
    return manifests.select(
        "manifest_path", F.explode_outer("manifest.nodes").alias("unique_id", "node")
    ).filter(F.col("unique_id").isNotNull())


def _model_nodes(manifests: DataFrame) -> DataFrame:
    return manifest_nodes(manifests).filter(F.col("node.resource_type") == "model")


def models_of(manifests: DataFrame) -> DataFrame:
    """MODELS rows: nodes of type model, with default chains for text and SQL."""
    node = F.col("node")
    return _model_nodes(manifests).select(
        "manifest_path",
        "unique_id",
        node["name"].alias("name"),
        F.coalesce(
            first_filled(node["description"], node["config"]["description"]), F.lit("")
        ).alias("description"),
        sql_or_note(node["raw_code"], node["raw_sql"]).alias("raw_sql"),
        node["path"].alias("path"),
        node["original_file_path"].alias("original_file_path"),
    )


def model_names(manifests: DataFrame) -> DataFrame:
    """``manifest_path, name`` of every model."""
    return _model_nodes(manifests).select("manifest_path", F.col("node.name").alias("name"))


def lineage_fields(manifests: DataFrame) -> DataFrame:
    """The manifests with only those fields that `model_names` and `model_deps` read."""
    fields = ("resource_type", "name", "source_name", "depends_on")
    nodes = F.transform_values(
        "manifest.nodes", lambda _, node: F.struct(*[node[f].alias(f) for f in fields])
    )
    kept = F.struct(nodes.alias("nodes"), F.col("manifest.sources").alias("sources"))
    return manifests.select("manifest_path", kept.alias("manifest"))


def model_columns(manifests: DataFrame) -> DataFrame:
    """MODEL_COLUMNS rows: one per declared column, in declared order.

    The model's file path comes along, so that proposals need no join to find it.
    """
    nodes = _model_nodes(manifests).select(
        "manifest_path",
        "unique_id",
        F.col("node.name").alias("model_name"),
        F.col("node.original_file_path").alias("original_file_path"),
        F.posexplode("node.columns").alias("position", "column_name", "declared"),
    )
    return nodes.select(
        "manifest_path",
        "unique_id",
        "model_name",
        "column_name",
        (F.col("position") + 1).alias("ordinal"),
        F.coalesce("declared.description", F.lit("")).alias("description"),
        F.coalesce("declared.data_type", F.lit(NOT_AVAILABLE)).alias("data_type"),
        "original_file_path",
    )


def model_deps(manifests: DataFrame) -> DataFrame:
    """MODEL_DEPS rows: the parents of every model, resolved to names.

    Models and seeds resolve to their name, sources to ``source_name.name``; other
    or unknown parents are dropped.
    """
    wanted = _model_nodes(manifests).select(
        "manifest_path",
        F.col("node.name").alias("model_name"),
        F.explode("node.depends_on.nodes").alias("parent_id"),
    )

    def entry(item: Column, kind: Column) -> Column:
        value = item["value"]
        dotted = F.concat(value["source_name"], F.lit("."), value["name"])
        return F.struct(
            item["key"].alias("parent_id"),
            F.when(kind == "source", dotted).otherwise(value["name"]).alias("dependency"),
            kind.alias("dep_kind"),
        )

    # Nodes and sources form one list, so that a text is parsed once for both.
    nodes = F.transform(
        F.map_entries("manifest.nodes"), lambda n: entry(n, n["value"]["resource_type"])
    )
    # A source that both maps list counts once.
    own = F.coalesce(F.map_keys("manifest.sources"), F.array().cast("array<string>"))
    nodes = F.filter(
        nodes, lambda n: (n["dep_kind"] != "source") | ~F.array_contains(own, n["parent_id"])
    )
    sources = F.transform(F.map_entries("manifest.sources"), lambda n: entry(n, F.lit("source")))
    none = F.array().cast(
        "array<struct<parent_id:string,dependency:string,dep_kind:string>>"
    )
    known = F.concat(F.coalesce(nodes, none), F.coalesce(sources, none))
    lookup = manifests.select("manifest_path", F.inline_outer(known)).filter(
        F.col("dep_kind").isin("model", "seed", "source")
    )
    return lookup_join(wanted, lookup, ["manifest_path", "parent_id"]).select(
        "manifest_path", "model_name", "dependency", "dep_kind"
    )


def parents_of(models: DataFrame) -> DataFrame:
    """``name, parent``: one row per direct parent named in the SQL of a model."""
    return models.select("name", F.explode(direct_parents(F.col("raw_sql"))).alias("parent"))


def model_charts(models: DataFrame) -> DataFrame:
    """MODELS plus ``chart``: a flow chart of the direct parents, built per row."""
    return models.withColumn(
        "chart", parent_chart(F.col("name"), direct_parents(F.col("raw_sql")))
    )
