"""Documentation: merging proposals, checking, drift findings, stubs, coverage.

Documentation is a long table, one row per documented key (see DOCS). A model or
column that is listed without any documentation still has a row, with the key
``name``. Blank proposals count as no proposal.

Models of several projects can have one name. Where both frames of an operation have the
column ``project`` (see `docs_of_projects`), it is part of every key and of the result;
otherwise names alone decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import project_of
from ..functions.ratios import null_ratio
from ..functions.text import dirname, is_blank
from .joins import lookup_join

_KEY = ["model_name", "entity", "doc_key"]


def _scope(*frames: DataFrame) -> list[str]:
    """``["project"]`` if all frames tell projects apart, else nothing."""
    return ["project"] if all("project" in df.columns for df in frames) else []


def docs_of_projects(docs: DataFrame, manifests: DataFrame) -> DataFrame:
    """DOCS plus ``project``: the innermost project whose root folder holds the file.

    Paths are compared as they stand, folder by folder. Files outside all projects have
    the project null, which equals no other.
    """
    roots = manifests.select(project_of(F.col("manifest_path")).alias("project")).distinct()
    files = docs.select("file_path").distinct()
    parts = F.split("file_path", "/")
    folders = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )
    inside = files.select("file_path", F.explode(folders).alias("project")).where("project != ''")
    found = lookup_join(inside, roots, ["project"], "left_semi")
    inner = found.groupBy("file_path").agg(F.max_by("project", F.length("project")).alias("project"))
    return lookup_join(docs, inner, ["file_path"], "left").select(*docs.columns, "project")


def _entity() -> Column:
    """Join key for "this column, or the model itself"."""
    return F.coalesce(F.concat(F.lit("c:"), F.col("column_name")), F.lit("m"))


def models_to_update(proposals: DataFrame, docs: DataFrame) -> DataFrame:
    """Models with proposals that are documented."""
    scope = _scope(proposals, docs)
    names = [_model_names(df, scope) for df in (proposals, docs)]
    return names[0].join(names[1], [*scope, "model_name"], "left_semi")


def models_to_create(proposals: DataFrame, docs: DataFrame) -> DataFrame:
    """Models with proposals that are documented nowhere."""
    scope = _scope(proposals, docs)
    names = [_model_names(df, scope) for df in (proposals, docs)]
    return names[0].join(names[1], [*scope, "model_name"], "left_anti")


def _model_names(df: DataFrame, scope: list[str]) -> DataFrame:
    return df.select(*scope, "model_name").distinct()


def model_file_map(docs: DataFrame) -> DataFrame:
    """``model_name, file_path`` (per project); of several files the greatest path wins."""
    return _file_map(docs, _scope(docs))


def _file_map(docs: DataFrame, scope: list[str]) -> DataFrame:
    return docs.groupBy(*scope, "model_name").agg(F.max("file_path").alias("file_path"))


def _effective_proposals(proposals: DataFrame, scope: list[str]) -> DataFrame:
    """One non-blank proposal per key; repeated proposals collapse before the shuffle."""
    return (
        proposals.filter(~is_blank(F.col("proposed_value")))
        .withColumn("entity", _entity())
        .groupBy(*scope, *_KEY)
        .agg(
            F.min("proposed_value").alias("proposed_value"),
            F.first("column_name", ignorenulls=True).alias("proposed_column"),
        )
    )


def fill_docs(docs: DataFrame, proposals: DataFrame) -> DataFrame:
    """DOCS plus ``changed``: blank or absent keys of documented models are filled.

    Existing values are never overwritten, and only models and columns that are
    already listed are filled (for others see `doc_stubs`). If several files list a
    model, the one of `model_file_map` is the one that is filled.
    """
    scope = _scope(docs, proposals)
    key = [*scope, *_KEY]
    wanted = _effective_proposals(proposals, scope)
    files = _file_map(docs, scope).withColumnRenamed("file_path", "owner_file")
    marked = docs.withColumn("entity", _entity())
    owned = lookup_join(marked, files, [*scope, "model_name"], "left").withColumn(
        "fillable",
        F.coalesce(
            (F.col("node_type") == "models") & (F.col("file_path") == F.col("owner_file")), F.lit(False)
        ),
    )
    blank = (
        F.col("fillable") & is_blank(F.col("doc_value")) & F.col("proposed_value").isNotNull()
    )
    columns = docs.columns
    present = owned.join(wanted.drop("proposed_column"), key, "left").select(
        *[
            F.when(blank, F.col("proposed_value")).otherwise(F.col(c)).alias(c)
            if c == "doc_value"
            else F.col(c)
            for c in columns
        ],
        blank.alias("changed"),
    )
    listed = owned.filter("fillable")
    absent = wanted.join(listed.select(*key).distinct(), key, "left_anti")
    homes = listed.groupBy(*scope, "model_name", "entity").agg(F.max("file_path").alias("file_path"))
    values = {
        "node_type": F.lit("models"),
        "column_name": F.col("proposed_column"),
        "doc_value": F.col("proposed_value"),
    }
    own = [*scope, "model_name", "doc_key", "file_path", *values]
    added = absent.join(homes, [*scope, "model_name", "entity"]).select(
        *[
            values.get(c, F.col(c)).alias(c) if c in own else F.lit(None).cast(docs.schema[c].dataType).alias(c)
            for c in columns
        ],
        F.lit(True).alias("changed"),
    )
    return present.unionByName(added)


def check_docs(docs: DataFrame, proposals: DataFrame) -> DataFrame:
    """FINDINGS: one per key that could be filled, one per undocumented model."""
    scope = _scope(docs, proposals)
    values = (
        fill_docs(docs, proposals)
        .filter("changed")
        .select(*scope, "model_name", "column_name", "doc_key", F.lit("missing_value").alias("finding"))
    )
    none = F.lit(None).cast("string")
    models = models_to_create(proposals, docs).select(
        *scope,
        "model_name",
        none.alias("column_name"),
        none.alias("doc_key"),
        F.lit("missing_model").alias("finding"),
    )
    return values.unionByName(models)


def drift_findings(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """FINDINGS of described columns whose verdict is DRIFT; nothing is changed."""
    scope = _scope(docs, verdicts)
    drifted = (
        verdicts.filter(F.col("verdict") == "DRIFT")
        .select(*scope, "model_name", "column_name")
        .distinct()
    )
    described = docs.filter(
        (F.col("node_type") == "models")
        & (F.col("doc_key") == "description")
        & F.col("column_name").isNotNull()
        & ~is_blank(F.col("doc_value"))
    )
    return described.join(drifted, [*scope, "model_name", "column_name"], "left_semi").select(
        *scope, "model_name", "column_name", "doc_key", F.lit("drift").alias("finding")
    )


def doc_stubs(proposals: DataFrame, docs: DataFrame) -> DataFrame:
    """New documentation rows of undocumented models, with target file and action.

    The target is ``schema.yml`` beside the model's SQL file; ``action`` is append if
    that file is known, else create. Models without a path get no stub. Every
    proposed column appears, with a null value where there is nothing to say.
    """
    folder = dirname(F.col("original_file_path"))
    target = F.when(folder == "", "schema.yml").otherwise(F.concat(folder, F.lit("/schema.yml")))
    scope = _scope(proposals, docs)
    models = _model_names(docs, scope)
    stubs = lookup_join(proposals, models, [*scope, "model_name"], "left_anti").filter(
        ~F.coalesce(F.col("original_file_path") == "", F.lit(True))
    )
    known = docs.select(F.col("file_path").alias("target_file")).distinct()
    located = lookup_join(
        stubs.withColumn("target_file", target),
        known.withColumn("known", F.lit(True)),
        ["target_file"],
        "left",
    )
    value = F.col("proposed_value")
    return located.select(
        *scope,
        "target_file",
        F.when(F.col("known"), "append").otherwise("create").alias("action"),
        "model_name",
        "column_name",
        "doc_key",
        F.when(~is_blank(value), value).alias("doc_value"),
    )


def review(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """PROPOSALS after review: accept (also if undecided), edit or skip.

    An edited text of just ``s`` skips, as at a prompt.
    """
    key = [*_scope(proposals, decisions), *_KEY]
    decided = (
        decisions.withColumn("entity", _entity())
        .groupBy(*key)
        .agg(F.max(F.struct("decision", "edited_value")).alias("choice"))
    )
    edited = F.col("choice.edited_value")
    is_edit = F.coalesce(F.col("choice.decision") == "edit", F.lit(False))
    skipped = F.coalesce(F.col("choice.decision") == "skip", F.lit(False)) | (
        is_edit & F.coalesce(F.lower(edited) == "s", F.lit(False))
    )
    return (
        proposals.withColumn("entity", _entity())
        .join(decided, key, "left")
        .filter(~skipped)
        .withColumn(
            "proposed_value", F.when(is_edit, edited).otherwise(F.col("proposed_value"))
        )
        .select(*proposals.columns)
    )


def apply_review(docs: DataFrame, proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """`fill_docs` with reviewed proposals."""
    return fill_docs(docs, review(proposals, decisions))


def plan_columns(model_columns: DataFrame, drift: bool) -> DataFrame:
    """MODEL_COLUMNS plus ``action``: propose a description, verify it, or nothing."""
    return model_columns.withColumn(
        "action",
        F.when(is_blank(F.col("description")), "propose").otherwise(
            "verify" if drift else "none"
        ),
    )


def is_outdated(findings: DataFrame) -> DataFrame:
    """One row: whether there is any finding."""
    return findings.agg((F.count(F.lit(1)) > 0).alias("is_outdated"))


def coverage(docs: DataFrame, columns: DataFrame) -> DataFrame:
    """Per table, how many of its columns have a description."""
    described = (
        docs.filter(
            F.col("column_name").isNotNull()
            & (F.col("doc_key") == "description")
            & ~is_blank(F.col("doc_value"))
        )
        .select(F.col("model_name").alias("table_name"), "column_name", F.lit(1).alias("has"))
        .distinct()
    )
    return (
        columns.select("table_name", "column_name")
        .join(described, ["table_name", "column_name"], "left")
        .groupBy("table_name")
        .agg(
            F.count(F.lit(1)).alias("column_count"),
            F.count("has").alias("documented_count"),
        )
        .withColumn(
            "documented_ratio", null_ratio("documented_count", "column_count")
        )
    )
