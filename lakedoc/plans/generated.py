"""Documentation written by a text generator instead of the default rules.

The generator is any picklable ``fn(prompt, max_tokens) -> text``. Answers are kept
durably before they are joined back, so that no call is made twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions.formats import MAX_TOKENS
from ..functions.identity import project_of
from ..functions.text import is_blank, profile_text, verdict
from ..operators.columns import column_list
from ..operators.docs import plan_columns
from ..operators.generate import generate, parse_yaml_metadata
from ..operators.joins import lookup_join
from ..operators.longform import union_all
from ..sinks.durable import durable

Generator = Callable[[str, int], str]


def _rows(
    df: DataFrame,
    kind: str,
    node: Column,
    column: Column | None,
    prompt: Column,
    path: Column | None = None,
):
    return df.select(
        *([path] if path is not None else []),
        F.lit(kind).alias("kind"),
        node.alias("node"),
        (F.lit(None).cast("string") if column is None else column).alias("column_name"),
        prompt.alias("prompt"),
        F.lit(MAX_TOKENS[kind]).alias("max_tokens"),
    )


def _profile(hint: bool) -> Column:
    facts = [F.col(c) for c in ("null_ratio", "is_unique", "distinct_count")]
    return profile_text(*facts, hint=hint)


def catalog_prompts(catalog: DataFrame, views: DataFrame) -> DataFrame:
    """``kind, node, column_name, prompt, max_tokens`` for tables, columns and views."""
    table, column = F.col("table_name"), F.col("column_name")
    lists = column_list(catalog)
    view = F.col("view_name")
    return union_all(
        [
            _rows(lists, "table", table, None, prompts.table_prompt(table, F.col("column_list"))),
            _rows(
                catalog,
                "column",
                table,
                column,
                prompts.column_prompt(table, column, F.col("data_type"), _profile(True)),
            ),
            _rows(views, "view", view, None, prompts.view_prompt(view, F.col("definition"))),
        ]
    )


def generated_catalog(
    catalog: DataFrame, views: DataFrame, fn: Generator, partitions: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(catalog, summaries, views)`` with generated texts.

    Where the generator failed, a column keeps the description it had. The catalog is
    stored first: it is needed several times and each use would profile the tables.
    """
    catalog = durable(catalog)
    answers = generate(catalog_prompts(catalog, views), fn, partitions=partitions, keep=True)

    def of(kind: str, **names: str) -> DataFrame:
        picked = [F.col(c).alias(n) for n, c in names.items()]
        return answers.filter(F.col("kind") == kind).select(*picked)

    texts = of("column", table_name="node", column_name="column_name", answer="answer")
    described = catalog.join(texts, ["table_name", "column_name"], "left").withColumn(
        "description", F.coalesce("answer", "description")
    )
    summarised = views.join(of("view", view_name="node", summary="answer"), "view_name", "left")
    return described.drop("answer"), of("table", table_name="node", summary="answer"), summarised


def model_prompts(models: DataFrame, columns: DataFrame) -> DataFrame:
    """Prompts for the summary and chart of every model and its undescribed columns."""
    name, sql = F.col("name"), F.col("raw_sql")
    wanted = plan_columns(columns, drift=False).filter("action = 'propose'")
    with_sql = lookup_join(
        wanted,
        models.select("manifest_path", "unique_id", "raw_sql"),
        ["manifest_path", "unique_id"],
    )
    column = F.col("column_name")
    metadata = prompts.column_metadata_prompt(
        F.col("model_name"), column, F.col("data_type"), sql
    )
    return union_all(
        [
            _rows(df, kind, *rest, path=F.col("manifest_path"))
            for df, kind, *rest in (
                (models, "model", name, None, prompts.model_prompt(name, sql)),
                (models, "lineage", name, None, prompts.lineage_prompt(name, sql)),
                (with_sql, "column_metadata", F.col("model_name"), column, metadata),
            )
        ]
    )


def generated_proposals(
    models: DataFrame, columns: DataFrame, fn: Generator, partitions: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(PROPOSALS, charts)`` of models from a generator's answers, with their ``project``.

    A failed call gives no proposal; its ``error`` is kept with the charts: all rows of
    the answers that failed have a null chart, and ``kind`` and ``column_name`` tell what
    was asked.
    """
    answers = generate(model_prompts(models, columns), fn, partitions=partitions, keep=True)
    summaries = answers.filter("kind = 'model' AND answer IS NOT NULL").select(
        "manifest_path",
        F.col("node").alias("model_name"),
        "column_name",
        F.lit("description").alias("doc_key"),
        F.col("answer").alias("proposed_value"),
    )
    m = F.col("metadata")
    values = {
        "description": m["description"],
        **{k: F.when(F.size(m[k]) > 0, F.to_json(m[k])) for k in ("meta", "tags", "tests")},
    }
    entries = F.array(
        *[
            F.struct(F.lit(k).alias("doc_key"), v.alias("proposed_value"))
            for k, v in values.items()
        ]
    )
    asked = answers.filter("kind = 'column_metadata'")
    parsed = parse_yaml_metadata(asked.select("manifest_path", "node", "column_name", "answer"))
    fields = parsed.select(
        "manifest_path", F.col("node").alias("model_name"), "column_name", F.inline(entries)
    ).filter("proposed_value IS NOT NULL")
    paths = models.groupBy("manifest_path", F.col("name").alias("model_name")).agg(
        F.max("original_file_path").alias("original_file_path")
    )
    project = project_of(F.col("manifest_path")).alias("project")
    proposals = lookup_join(
        summaries.unionByName(fields), paths, ["manifest_path", "model_name"]
    ).select("model_name", "column_name", "doc_key", "proposed_value", "original_file_path", project)
    charts = answers.filter("kind = 'lineage' OR error IS NOT NULL").select(
        project,
        "kind",
        F.col("node").alias("name"),
        "column_name",
        F.when(F.col("kind") == "lineage", F.col("answer")).alias("chart"),
        "error",
    )
    return proposals, charts


def generated_verdicts(
    docs: DataFrame, profile: DataFrame, fn: Generator, partitions: int | None = None
) -> DataFrame:
    """Drift verdicts (see `drift_verdicts`) as a generator judges them.

    A failed call has its ``error`` and no verdict; ``finding`` makes the result fit for
    `lakedoc.plans.models.gate`, which raises on either.
    """
    described = docs.filter(
        F.col("column_name").isNotNull()
        & (F.col("doc_key") == "description")
        & ~is_blank(F.col("doc_value"))
    ).select("model_name", "column_name", F.col("doc_value").alias("description"))
    facts = profile.select(
        F.col("table_name").alias("model_name"),
        "column_name",
        "null_ratio",
        "is_unique",
        "distinct_count",
    )
    asked = described.join(facts, ["model_name", "column_name"], "left").select(
        "model_name",
        "column_name",
        "description",
        prompts.drift_prompt(
            F.col("model_name"), F.col("column_name"), F.col("description"), _profile(False)
        ).alias("prompt"),
        F.lit(MAX_TOKENS["drift"]).alias("max_tokens"),
    )
    return generate(asked, fn, partitions=partitions, keep=True).select(
        "model_name",
        "column_name",
        "description",
        verdict(F.col("answer")).alias("verdict"),
        F.when(verdict(F.col("answer")) == "DRIFT", "drift").alias("finding"),
        "error",
    )
