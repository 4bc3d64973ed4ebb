"""From manifests to proposals, checks and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.docs import plan_columns
from ..operators.lineage import (
    lineage_edges,
    lineage_mermaid,
    lineage_nodes,
    qualified_edges,
    qualified_nodes,
)
from ..operators.longform import union_all
from ..operators.manifest import lineage_fields, model_columns, model_deps, model_names, models_of
from ..functions.identity import project_of
from ..functions.text import is_blank
from ..operators.joins import lookup_join
from ..operators.rules import describe_models, drift_verdict, pii_name, tags_of, tests_of
from ..sinks.durable import durable


class DocumentationError(Exception):
    """Documentation is missing or contradicts the data."""


def _with_project(df: DataFrame) -> DataFrame:
    return df.withColumn("project", project_of(F.col("manifest_path")))


def _json_list(items: Column) -> Column:
    """The list as JSON; an empty one is no proposal."""
    return F.when(F.size(items) > 0, F.to_json(items))


def model_proposals(
    models: DataFrame,
    columns: DataFrame,
    profile: DataFrame | None = None,
    tag_rules: list[tuple[str, str]] = (),
) -> DataFrame:
    """PROPOSALS: a summary per model, and for every undescribed column a description,
    ``meta``, ``tags`` and ``tests`` (the last need the profile of the data).

    Rows with a ``manifest_path`` give proposals with their ``project``, so that models of
    one name stay apart; a profile with a ``project`` is joined by it, too.
    """
    keys = ["model_name", "column_name", "doc_key", "proposed_value", "original_file_path"]
    if "manifest_path" in models.columns and "manifest_path" in columns.columns:
        keys.append("project")
        models, columns = (_with_project(df) for df in (models, columns))
    summaries = describe_models(models).select(
        F.col("name").alias("model_name"),
        F.lit(None).cast("string").alias("column_name"),
        F.lit("description").alias("doc_key"),
        F.col("summary").alias("proposed_value"),
        *keys[4:],
    )
    wanted = plan_columns(columns, drift=False).filter(F.col("action") == "propose")
    unique, nulls = F.lit(None).cast("boolean"), F.lit(None).cast("long")
    if profile is not None:
        scope = ["project"] if "project" in profile.columns and "project" in keys else []
        facts = profile.select(
            *scope, F.col("table_name").alias("model_name"), "column_name", "is_unique", "null_count"
        )
        wanted = wanted.join(facts, [*scope, "model_name", "column_name"], "left")
        unique, nulls = F.col("is_unique"), F.col("null_count")
    name = F.col("column_name")
    words = F.replace(name, F.lit("_"), F.lit(" "))
    text = F.concat(F.lit("The "), words, F.lit(" of "), F.col("model_name"), F.lit("."))
    pii = F.when(pii_name(name), "true").otherwise("false")
    values = {
        "description": text,
        "meta": F.concat(F.lit('{"pii": '), pii, F.lit("}")),
        "tags": _json_list(tags_of(name, list(tag_rules))),
        "tests": _json_list(tests_of(unique, nulls)),
    }
    entries = F.array(
        *[
            F.struct(F.lit(k).alias("doc_key"), v.alias("proposed_value"))
            for k, v in values.items()
        ]
    )
    columns_long = wanted.select(
        "model_name", "column_name", *keys[4:], F.inline(entries)
    )
    return union_all(
        [summaries, columns_long.select(*keys).filter(F.col("proposed_value").isNotNull())]
    )


def document_models(
    manifests: DataFrame,
    profile: DataFrame | None = None,
    tag_rules: list[tuple[str, str]] = (),
) -> DataFrame:
    """PROPOSALS straight from parsed manifests, with their ``project``."""
    return model_proposals(
        models_of(manifests), model_columns(manifests), profile, tag_rules
    )


def model_drift(manifests: DataFrame, profile: DataFrame) -> DataFrame:
    """Drift verdicts of the columns that the manifests describe, from their profiles.

    One row per described column with its ``manifest_path``; where profiling gave nothing
    the verdict is MATCH. A profile with a ``project`` is joined by it, too.
    `lakedoc.plans.generated.generated_verdicts` asks a generator.
    """
    columns = _with_project(model_columns(manifests)).filter(~is_blank(F.col("description")))
    scope = ["project"] if "project" in profile.columns else []
    facts = profile.select(
        *scope, F.col("table_name").alias("model_name"), "column_name", "is_unique", "distinct_count"
    )
    return lookup_join(columns, facts, [*scope, "model_name", "column_name"], "left").select(
        "manifest_path",
        "model_name",
        "column_name",
        "description",
        drift_verdict(F.col("description"), F.col("is_unique"), F.col("distinct_count")).alias(
            "verdict"
        ),
    )


def build_lineage(
    fks: DataFrame, models: DataFrame, deps: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """NODES, EDGES and the LINES of the graph text."""
    nodes, edges = lineage_nodes(fks, models, deps), lineage_edges(fks, deps)
    return nodes, edges, lineage_mermaid(nodes, edges)


def lineage_of_project(
    fks: DataFrame, manifests: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lineage of a database's foreign keys and a project's manifests."""
    return build_lineage(fks, *_parsed_once(manifests))


def _parsed_once(manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names and parents of all models. What lineage needs of the manifests is stored first:
    each use would parse the texts again."""
    slim = durable(lineage_fields(manifests))
    return model_names(slim), durable(model_deps(slim))


def qualified_lineage(
    fks: DataFrame, manifests: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lineage of many databases and projects whose objects can have equal names.

    Like `lineage_of_project`, but a table is one of its source and schema (where the keys
    tell them), a model or source one of its project, and ids are surrogates of kind,
    origin and name (`qualified_id`); ``label`` is the name to show and ``origin`` where it
    belongs. Nothing is merged because it is called alike.
    """
    models, deps = _parsed_once(manifests)
    nodes, edges = qualified_nodes(fks, models, deps), qualified_edges(fks, deps)
    return nodes, edges, lineage_mermaid(nodes, edges)


#: The kinds of findings that the operators make.
FINDINGS = ("missing_value", "missing_model", "drift")


def gate(findings: DataFrame) -> None:
    """Raise if there is any finding, or a row with an ``error``; for scheduled checks."""
    if "error" in findings.columns:
        failed = findings.filter(F.col("error").isNotNull()).select("error").head()
        if failed is not None:
            raise DocumentationError(f"calls failed, among them: {failed.error}")
        findings = findings.filter(F.col("finding").isNotNull())
    if not findings.isEmpty():
        kinds = findings.groupBy("finding").count().orderBy("finding").toLocalIterator()
        raise DocumentationError(", ".join(f"{r['count']} x {r['finding']}" for r in kinds))


def write_gated(findings: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write the findings, then raise as `gate` does if there are any.

    What is written is counted while it passes, so the check costs no job of its own, and
    the report is there for whoever has to act on it.
    """
    seen = Observation()
    kinds = {f"n{i}": F.count_if(F.col("finding") == kind) for i, kind in enumerate(FINDINGS)}
    if "error" in findings.columns:
        kinds |= {"failed": F.count("error"), "first_error": F.min("error")}
    counted = findings.observe(
        seen, F.count("finding").alias("total"), *[count.alias(name) for name, count in kinds.items()]
    )
    counted.write.mode(mode).format(fmt).save(path)
    found = seen.get
    if found.get("failed"):
        raise DocumentationError(f"calls failed, among them: {found['first_error']}")
    if found["total"]:
        known = [(kind, found[f"n{i}"]) for i, kind in enumerate(FINDINGS)]
        known.append(("other", found["total"] - sum(n for _, n in known)))
        raise DocumentationError(", ".join(f"{n} x {kind}" for kind, n in sorted(known) if n))
