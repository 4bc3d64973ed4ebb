"""Inventories, keys, documentation, manifests, lineage and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakedoc.functions import prompts
from lakedoc.functions.formats import MAX_TOKENS
from lakedoc.functions.text import basename, dirname, escape_quotes, is_blank, strip_fences, verdict
from lakedoc.operators import columns as C
from lakedoc.operators import docs as D
from lakedoc.operators import keys as K
from lakedoc.operators import lineage as L
from lakedoc.operators import manifest as M
from lakedoc.operators import render as R
from lakedoc.operators import rules
from lakedoc.operators.generate import generate, json_metadata, parse_yaml_metadata
from lakedoc.operators.joins import lookup_join
from lakedoc.plans.generated import generated_proposals
from lakedoc.plans.models import (
    build_lineage,
    document_models,
    lineage_of_project,
    model_drift,
    qualified_lineage,
)
from lakedoc.sources.manifests import parse_manifests

from . import frames as f
from .base import blank_sql, query, ratio_sql
from .frames import c, text


def with_(parts: str, select: str) -> str:
    return f"WITH {parts.strip()} {select}"


# --- Inventories and keys from catalog extracts ---------------------------------------

_INVENTORY = (
    "SELECT source, table_schema, table_name, column_name, ordinal_position::INTEGER AS ordinal,"
    " data_type, is_nullable = 'YES' AS is_nullable, status = 'F' AS is_pk, '' AS description"
    " FROM extract"
)


@query("columns_with_pk", with_(f.EXTRACT_SQL, _INVENTORY))
def columns_with_pk(t):
    columns = f.extract(t)
    return C.columns_with_pk(columns, f.key_usage(columns), f.constraints(t))


@query("mark_pk", with_(f.EXTRACT_SQL, _INVENTORY))
def mark_pk(t):
    columns = f.extract(t)
    return C.mark_pk(columns, columns.filter("status = 'F'"))


@query(
    "base_tables",
    "SELECT o_orderstatus AS source, o_orderpriority AS table_schema,"
    " 't' || o_orderkey AS table_name FROM orders WHERE o_orderstatus <> 'P'",
)
def base_tables(t):
    return C.base_tables(f.table_extract(t))


@query(
    "foreign_keys",
    with_(
        f.EXTRACT_SQL,
        "SELECT source, table_schema, table_name AS source_table, column_name AS source_column,"
        " 'cust_' || o_custkey AS target_table, 'k' || ordinal_position AS target_column"
        " FROM extract WHERE data_type = 'R'",
    ),
)
def foreign_keys(t):
    columns = f.extract(t)
    return K.foreign_keys(f.constraints(t), f.key_usage(columns), f.referenced_usage(columns))


@query(
    "fks_constraint_lists",
    "SELECT 'db' || c_nationkey AS source, 'ord_' || o_orderkey AS source_table, pair.a AS"
    " source_column, 'cust_' || c_custkey AS target_table, pair.b AS target_column FROM orders"
    " JOIN customer ON o_custkey = c_custkey, LATERAL (SELECT 'o_custkey' AS a, c_name AS b"
    " UNION ALL SELECT o_orderpriority, c_mktsegment) pair",
)
def fks_constraint_lists(t):
    bought = t.orders.join(t.customer, c("o_custkey") == c("c_custkey"))
    place = text("db", c("c_nationkey")).alias("source")
    none = F.lit(None).cast("long")
    parents = t.customer.select(
        place,
        text("cust_", c("c_custkey")).alias("table_name"),
        c("c_custkey").alias("constraint_index"),
        F.lit("PRIMARY KEY").alias("constraint_type"),
        F.array("c_name", "c_mktsegment").alias("column_names"),
        none.alias("primary_key_index"),
    )
    children = bought.select(
        place,
        text("ord_", c("o_orderkey")).alias("table_name"),
        (-c("o_orderkey")).alias("constraint_index"),
        F.lit("FOREIGN KEY").alias("constraint_type"),
        F.array(F.lit("o_custkey"), "o_orderpriority").alias("column_names"),
        c("o_custkey").alias("primary_key_index"),
    )
    return K.fks_from_constraint_lists(parents.unionByName(children))


@query(
    "fks_imported",
    "SELECT l_returnflag AS source, 'li_' || l_suppkey AS source_table, 'l_orderkey' AS"
    " source_column, 'orders_' || l_orderkey AS target_table, 'o_orderkey' AS target_column"
    " FROM lineitem",
)
def fks_imported(t):
    return K.fks_from_imported_keys(
        t.lineitem.select(
            c("l_returnflag").alias("source"),
            text("orders_", c("l_orderkey")).alias("pk_table_name"),
            F.lit("o_orderkey").alias("pk_column_name"),
            text("li_", c("l_suppkey")).alias("fk_table_name"),
            F.lit("l_orderkey").alias("fk_column_name"),
        )
    )


@query(
    "fks_pragma",
    "SELECT l_returnflag AS source, 'li_' || l_orderkey AS source_table, 'c' || l_linenumber AS"
    " source_column, 'part_' || l_partkey AS target_table, 'p_partkey' AS target_column"
    " FROM lineitem WHERE l_linestatus = 'O'",
)
def fks_pragma(t):
    return K.fks_from_pragma(
        t.lineitem.select(
            c("l_returnflag").alias("source"),
            text("li_", c("l_orderkey")).alias("table_name"),
            c("l_linenumber").alias("id"),
            F.lit(0).alias("seq"),
            F.when(c("l_linestatus") == "O", text("part_", c("l_partkey"))).alias("table"),
            text("c", c("l_linenumber")).alias("from"),
            F.lit("p_partkey").alias("to"),
        )
    )


@query(
    "column_list",
    with_(
        f.COLUMNS_SQL,
        "SELECT table_name, string_agg(column_name, ', ' ORDER BY ordinal) AS"
        " column_list FROM cols GROUP BY table_name",
    ),
)
def column_list(t):
    return C.column_list(f.as_columns(f.extract(t)))


@query(
    "describe_tables",
    with_(
        f.COLUMNS_SQL,
        "SELECT table_name, string_agg(column_name, ', ' ORDER BY ordinal) AS"
        " column_list, 'Stores ' || table_name || ' records with the columns ' ||"
        " string_agg(column_name, ', ' ORDER BY ordinal) || '.' AS summary"
        " FROM cols GROUP BY table_name",
    ),
)
def describe_tables(t):
    return rules.describe_tables(f.as_columns(f.extract(t)))


@query(
    "catalog_summary",
    with_(
        f.COLUMNS_SQL + "," + f.LINEAGE_SQL + "," + f.MODELS_SQL,
        "SELECT (SELECT count(DISTINCT table_name) FROM cols)::BIGINT AS tables, (SELECT count(*)"
        " FROM cols)::BIGINT AS columns, (SELECT count(*) FROM models)::BIGINT AS views,"
        " (SELECT count(*) FROM fks)::BIGINT AS foreign_keys",
    ),
)
def catalog_summary(t):
    return C.catalog_summary(f.as_columns(f.extract(t)), f.models(t), f.fks(t))


# --- Documentation ----------------------------------------------------------------------

_ROOM = f"(d.doc_value IS NULL OR {blank_sql('d.doc_value')})"
_FILLED = (
    f"SELECT d.node_type, d.model_name, d.column_name, d.doc_key, CASE WHEN {_ROOM} AND"
    " p.proposed_value IS NOT NULL THEN p.proposed_value ELSE d.doc_value END AS doc_value,"
    f" d.file_path, {_ROOM} AND p.proposed_value IS NOT NULL AS changed FROM docs d LEFT JOIN good p"
    " ON p.model_name = d.model_name AND p.column_name IS NOT DISTINCT FROM d.column_name AND"
    " p.doc_key = d.doc_key UNION ALL SELECT 'models', p.model_name, p.column_name, p.doc_key,"
    " p.proposed_value, e.file_path, true FROM good p JOIN (SELECT model_name, column_name,"
    " max(file_path) AS file_path FROM docs GROUP BY model_name, column_name) e ON"
    " e.model_name = p.model_name AND e.column_name IS NOT DISTINCT FROM p.column_name"
    " WHERE NOT EXISTS (SELECT 1 FROM docs d WHERE d.model_name = p.model_name AND"
    " d.column_name IS NOT DISTINCT FROM p.column_name AND d.doc_key = p.doc_key)"
)


def _good(source: str = "proposals") -> str:
    return f", good AS (SELECT * FROM {source} WHERE NOT {blank_sql('proposed_value')})"


@query("docs_fill", with_(f.DOCS_SQL + _good(), _FILLED))
def docs_fill(t):
    return D.fill_docs(f.docs(t), f.proposals(t))


# In SQL the project is the first part of the model's name, and is cut off at the end.
_BOTH = (
    ", both_docs AS (SELECT node_type, 'a/' || model_name AS model_name, column_name, doc_key,"
    " doc_value, file_path FROM docs UNION ALL SELECT node_type, 'b/' || model_name, column_name,"
    " doc_key, CASE WHEN doc_key = 'name' THEN doc_value ELSE ' ' END, file_path FROM docs),"
    " both_good AS (SELECT 'a/' || model_name AS model_name, column_name, doc_key, proposed_value"
    f" FROM proposals WHERE NOT {blank_sql('proposed_value')} UNION ALL SELECT 'b/' || model_name,"
    " column_name, doc_key, 'In b: ' || proposed_value FROM proposals WHERE NOT"
    f" {blank_sql('proposed_value')})"
)


@query(
    "docs_fill_projects",
    with_(
        f.DOCS_SQL + _BOTH,
        "SELECT * REPLACE (model_name[3:] AS model_name), model_name[1:1] AS project FROM ("
        + _FILLED.replace("FROM docs", "FROM both_docs").replace("JOIN good", "JOIN both_good").replace("FROM good", "FROM both_good")
        + ")",
    ),
)
def docs_fill_projects(t):
    """Two projects with models of the same names; in ``b`` nothing is documented yet."""
    docs, proposals = f.docs(t), f.proposals(t)
    empty = F.when(c("doc_key") == "name", c("doc_value")).otherwise(" ")
    told = F.concat(F.lit("In b: "), c("proposed_value"))
    in_a, in_b = F.lit("a").alias("project"), F.lit("b").alias("project")
    both_docs = docs.select("*", in_a).unionByName(docs.withColumn("doc_value", empty).select("*", in_b))
    good = proposals.where(~is_blank(c("proposed_value")))
    both = good.select("*", in_a).unionByName(good.withColumn("proposed_value", told).select("*", in_b))
    return D.fill_docs(both_docs, both)


_CHECK = (
    f"SELECT model_name, column_name, doc_key, 'missing_value' AS finding FROM ({_FILLED})"
    " WHERE changed UNION ALL SELECT DISTINCT model_name, NULL, NULL, 'missing_model' FROM"
    " proposals WHERE model_name NOT IN (SELECT model_name FROM docs)"
)


@query("docs_check", with_(f.DOCS_SQL + _good(), _CHECK))
def docs_check(t):
    return D.check_docs(f.docs(t), f.proposals(t))


@query(
    "docs_drift",
    with_(
        f.DOCS_SQL,
        "SELECT d.model_name, d.column_name, d.doc_key, 'drift' AS finding FROM docs d JOIN bought"
        " ON c_name = d.model_name AND 'o' || o_orderkey = d.column_name WHERE o_totalprice >"
        f" 200000 AND d.doc_key = 'description' AND NOT {blank_sql('d.doc_value')}",
    ),
)
def docs_drift(t):
    verdicts = f.bought(t).select(
        c("c_name").alias("model_name"),
        text("o", c("o_orderkey")).alias("column_name"),
        F.when(c("o_totalprice") > 200000, "DRIFT").otherwise("MATCH").alias("verdict"),
    )
    return D.drift_findings(f.docs(t), verdicts)


@query(
    "docs_stubs",
    with_(
        f.DOCS_SQL,
        "SELECT s.target_file, CASE WHEN k.file_path IS NULL THEN 'create' ELSE 'append' END AS"
        " action, model_name, column_name, doc_key, CASE WHEN NOT"
        f" {blank_sql('proposed_value')} THEN proposed_value END AS doc_value FROM (SELECT *,"
        " regexp_extract(original_file_path, '^(.*)/[^/]*$', 1) || '/schema.yml' AS target_file"
        " FROM proposals WHERE original_file_path <> '' AND model_name NOT IN (SELECT model_name"
        " FROM docs)) s LEFT JOIN (SELECT DISTINCT file_path FROM docs) k"
        " ON k.file_path = s.target_file",
    ),
)
def docs_stubs(t):
    return D.doc_stubs(f.proposals(t), f.docs(t))


@query(
    "docs_review",
    with_(
        f.DOCS_SQL
        + ", reviewed AS (SELECT model_name, column_name, doc_key, CASE WHEN o_orderpriority ="
        " '2-HIGH' AND doc_key = 'description' THEN 'Edited ' || o_orderkey ELSE proposed_value END"
        " AS proposed_value FROM proposals LEFT JOIN orders ON column_name = 'o' || o_orderkey"
        " WHERE o_orderkey IS NULL OR doc_key <> 'description' OR o_orderpriority NOT IN"
        " ('1-URGENT', '3-MEDIUM'))"
        + _good("reviewed"),
        _FILLED,
    ),
)
def docs_review(t):
    priority = c("o_orderpriority")
    decisions = (
        f.bought(t)
        .filter(priority.isin("1-URGENT", "2-HIGH", "3-MEDIUM"))
        .select(
            c("c_name").alias("model_name"),
            text("o", c("o_orderkey")).alias("column_name"),
            F.lit("description").alias("doc_key"),
            F.when(priority == "1-URGENT", "skip").otherwise("edit").alias("decision"),
            F.when(priority == "2-HIGH", text("Edited ", c("o_orderkey")))
            .when(priority == "3-MEDIUM", "s")
            .alias("edited_value"),
        )
    )
    return D.apply_review(f.docs(t), f.proposals(t), decisions)


@query(
    "models_to_update",
    with_(
        f.DOCS_SQL,
        "SELECT DISTINCT model_name FROM proposals WHERE model_name IN"
        " (SELECT model_name FROM docs)",
    ),
)
def models_to_update(t):
    return D.models_to_update(f.proposals(t), f.docs(t))


@query(
    "models_to_create",
    with_(
        f.DOCS_SQL,
        "SELECT DISTINCT model_name FROM proposals WHERE model_name NOT IN"
        " (SELECT model_name FROM docs)",
    ),
)
def models_to_create(t):
    return D.models_to_create(f.proposals(t), f.docs(t))


@query(
    "model_file_map",
    "SELECT 'c' || o_custkey AS model_name, max('models/' || o_orderpriority || '.yml') AS"
    " file_path FROM orders GROUP BY o_custkey",
)
def model_file_map(t):
    return D.model_file_map(
        t.orders.select(
            text("c", c("o_custkey")).alias("model_name"),
            text("models/", c("o_orderpriority"), ".yml").alias("file_path"),
        )
    )


@query(
    "doc_coverage",
    with_(
        f.DOCS_SQL,
        f"SELECT *, {ratio_sql('documented_count', 'column_count')} AS documented_ratio FROM"
        " (SELECT c_name AS table_name, count(*)::BIGINT AS column_count,"
        " count(d.column_name)::BIGINT AS documented_count FROM bought LEFT JOIN docs d ON"
        " d.model_name = c_name AND d.column_name = 'o' || o_orderkey AND d.doc_key ="
        f" 'description' AND NOT {blank_sql('d.doc_value')} GROUP BY c_name)",
    ),
)
def doc_coverage(t):
    columns = f.bought(t).select(
        c("c_name").alias("table_name"), text("o", c("o_orderkey")).alias("column_name")
    )
    return D.coverage(f.docs(t), columns)


@query(
    "plan_columns",
    "SELECT 'm' || o_custkey AS model_name, 'o' || o_orderkey AS column_name,"
    " nullif(o_orderpriority, '5-LOW') AS description, CASE WHEN o_orderpriority = '5-LOW' THEN"
    " 'propose' ELSE 'verify' END AS action FROM orders",
)
def plan_columns(t):
    return D.plan_columns(
        t.orders.select(
            text("m", c("o_custkey")).alias("model_name"),
            text("o", c("o_orderkey")).alias("column_name"),
            F.nullif("o_orderpriority", F.lit("5-LOW")).alias("description"),
        ),
        drift=True,
    )


# --- Manifests --------------------------------------------------------------------------

_PROJECTS = "(SELECT * FROM documents WHERE lang <> 'de')"


@query(
    "manifest_scan",
    "SELECT 'p/' || doc_id AS manifest_path, CASE WHEN lang <> 'de' THEN 3 END::INTEGER AS nodes,"
    " CASE WHEN lang <> 'de' THEN 1 END::INTEGER AS sources, CASE WHEN lang = 'de' THEN"
    " 'not a valid manifest: p/' || doc_id END AS error FROM documents",
)
def manifest_scan(t):
    parsed = parse_manifests(f.manifest_texts(t))
    return parsed.select(
        "manifest_path",
        F.when(c("error").isNull(), F.size("manifest.nodes")).alias("nodes"),
        F.when(c("error").isNull(), F.size("manifest.sources")).alias("sources"),
        "error",
    )


@query(
    "manifest_models",
    "SELECT 'p/' || doc_id AS manifest_path, 'model.p.doc_' || doc_id AS unique_id, 'doc_' ||"
    " doc_id AS name, CASE WHEN lang = 'en' OR text = '' THEN 'From ' || source ELSE text END AS"
    " description, CASE WHEN lang = 'fr' THEN 'select * from {{ ref(''fr_base'') }}, {{ source('''"
    " || source || ''', ''fr'') }}' ELSE '-- SQL code not available --' END AS raw_sql, 'doc_' ||"
    " doc_id || '.sql' AS path, 'models/' || lang || '/doc_' || doc_id || '.sql' AS"
    f" original_file_path FROM {_PROJECTS}",
)
def manifest_models(t):
    return M.models_of(parse_manifests(f.manifest_texts(t)))


@query(
    "manifest_columns",
    "SELECT 'p/' || doc_id AS manifest_path, 'model.p.doc_' || doc_id AS unique_id, 'doc_' ||"
    " doc_id AS model_name, column_name, ordinal::INTEGER AS ordinal, CASE ordinal WHEN 1 THEN ''"
    " ELSE text END AS description, data_type, 'models/' || lang || '/doc_' || doc_id || '.sql' AS"
    " original_file_path FROM"
    f" {_PROJECTS}, (VALUES ('doc_id', 1, 'bigint'), ('email', 2, 'N/A'))"
    " v(column_name, ordinal, data_type)",
)
def manifest_columns(t):
    return M.model_columns(parse_manifests(f.manifest_texts(t)))


@query(
    "manifest_deps",
    "SELECT 'p/' || doc_id AS manifest_path, 'doc_' || doc_id AS model_name, lang || '_base' AS"
    f" dependency, 'seed' AS dep_kind FROM {_PROJECTS} UNION ALL SELECT 'p/' || doc_id, 'doc_' ||"
    f" doc_id, source || '.' || lang, 'source' FROM {_PROJECTS}",
)
def manifest_deps(t):
    return M.model_deps(parse_manifests(f.manifest_texts(t)))


_META = " ".join(
    [
        "SELECT model_name, column_name, doc_key, value AS proposed_value, original_file_path, project FROM",
        "(SELECT 'p/' || doc_id AS project, 'doc_' || doc_id AS model_name, 'models/' || lang || '/doc_' || doc_id || '.sql'",
        f"AS original_file_path, text, lang, source FROM {_PROJECTS}) m, LATERAL (",
        "SELECT NULL AS column_name, 'description' AS doc_key, CASE WHEN lang = 'fr' THEN model_name",
        "|| ' is derived from fr_base, ' || source || '.fr.' ELSE model_name ||",
        "' has no direct parents.' END AS value",
        "UNION ALL SELECT 'doc_id', 'description', 'The doc id of ' || model_name || '.'",
        "UNION ALL SELECT 'doc_id', 'meta', '{\"pii\": false}'",
        "UNION ALL SELECT 'doc_id', 'tags', '[\"key\"]'",
        "UNION ALL SELECT 'email', 'description', 'The email of ' || model_name || '.'",
        "WHERE trim(text) = '' UNION ALL SELECT 'email', 'meta', '{\"pii\": true}' WHERE trim(text) = ''",
        "UNION ALL SELECT 'email', 'tags', '[\"pii\"]' WHERE trim(text) = '') v",
    ]
)


@query("model_catalog", _META)
def model_catalog(t):
    manifests = parse_manifests(f.manifest_texts(t))
    return document_models(manifests, tag_rules=[("_id$", "key")])


@query(
    "model_drift",
    f"SELECT 'p/' || doc_id AS manifest_path, 'doc_' || doc_id AS model_name, 'doc_id' AS"
    " column_name, 'The unique key' AS description, CASE WHEN lang = 'fr' THEN 'MATCH' WHEN"
    f" doc_id % 2 = 0 THEN 'DRIFT' ELSE 'MATCH' END AS verdict FROM {_PROJECTS}",
)
def run_model_drift(t):
    manifests = parse_manifests(f.manifest_texts(t))
    described = F.struct(F.lit("The unique key").alias("description"))
    # every model describes its column; French models have not been profiled
    nodes = F.transform_values(
        "manifest.nodes",
        lambda _, n: n.withField(
            "columns",
            F.transform_values(
                n["columns"],
                lambda k, v: v.withField(
                    "description", F.when(k == "doc_id", described["description"]).otherwise("")
                ),
            ),
        ),
    )
    manifests = manifests.withColumn("manifest", c("manifest").withField("nodes", nodes))
    profile = t.documents.filter("lang <> 'fr'").select(
        text("doc_", c("doc_id")).alias("table_name"),
        F.lit("doc_id").alias("column_name"),
        (c("doc_id") % 2 == 1).alias("is_unique"),
        F.lit(3).cast("long").alias("distinct_count"),
    )
    return model_drift(manifests, profile)


@query(
    "views_extract",
    "SELECT 'doc_' || doc_id AS view_name, coalesce(text, '') AS definition FROM documents"
    " WHERE lang = 'en'",
)
def views_extract(t):
    return C.views_from_extract(
        t.documents.select(
            c("lang").alias("table_schema"),
            text("doc_", c("doc_id")).alias("table_name"),
            c("text").alias("view_definition"),
        ),
        "en",
    )


@query(
    "columns_describe",
    "SELECT 'li_' || l_orderkey AS table_name, 'c' || l_linenumber AS column_name, l_linenumber"
    "::INTEGER AS ordinal, l_linestatus AS data_type, l_returnflag = 'A' AS is_nullable,"
    " l_returnflag = 'N' AS is_pk, '' AS description FROM lineitem",
)
def columns_describe(t):
    return C.columns_from_describe(
        t.lineitem.select(
            text("li_", c("l_orderkey")).alias("table_name"),
            c("l_linenumber").alias("ordinal"),
            text("c", c("l_linenumber")).alias("name"),
            c("l_linestatus").alias("type"),
            F.when(c("l_returnflag") == "A", "YES").otherwise("NO").alias("null"),
            F.when(c("l_returnflag") == "N", "PRI").alias("key"),
        )
    )


@query(
    "direct_parents",
    with_(
        f.MODELS_SQL,
        "SELECT name, p_brand AS parent FROM models UNION ALL SELECT name, source_name FROM models",
    ),
)
def direct_parents(t):
    return M.parents_of(f.models(t))


_SUMMARY = f"name || ' is derived from ' || {f.PARENTS_SQL.format(', ')} || '.'"
_MODEL_FIELDS = (
    "manifest_path, unique_id, name, description, raw_sql, path, original_file_path"
)


@query("describe_models", with_(f.MODELS_SQL, f"SELECT {_MODEL_FIELDS}, {_SUMMARY} AS summary FROM models"))
def describe_models(t):
    return rules.describe_models(f.models(t))


_CHART = (
    "'graph TD;' || chr(10) || '    ' || "
    + f.PARENTS_SQL.format("' || ' --> ' || name || chr(10) || '    ' || '")
    .replace("|| '' ||", "||")
    + " || ' --> ' || name"
)


@query("model_charts", with_(f.MODELS_SQL, f"SELECT name, {_CHART} AS chart FROM models"))
def model_charts(t):
    return M.model_charts(f.models(t)).select("name", "chart")


# --- Lineage ----------------------------------------------------------------------------


@query("lineage_nodes", with_(f.LINEAGE_SQL, "SELECT id, label, style FROM nodes"))
def lineage_nodes(t):
    return L.lineage_nodes(f.fks(t), f.supplier_models(t), f.deps(t))


@query("lineage_edges", with_(f.LINEAGE_SQL, "SELECT id, source, target, label FROM edges"))
def lineage_edges(t):
    return L.lineage_edges(f.fks(t), f.deps(t))


_GRAPH = (
    "SELECT 'lineage' AS doc_name, 0 AS section, '' AS part, 0::BIGINT AS ordinal,"
    " 'graph TD;' AS line UNION ALL SELECT 'lineage', 1, id, 0, '    ' || id || CASE style"
    " WHEN 'box' THEN '[\"' || id || '\"]' WHEN 'db' THEN '[(\"' || id || '\")]' ELSE '((\"' || id"
    " || '\"))' END FROM nodes UNION ALL SELECT 'lineage', 2, '', 0, '' UNION ALL SELECT"
    " 'lineage', 3, id, 0, '    ' || source || CASE WHEN label <> '' THEN ' -- \"' || label ||"
    " '\" --> ' ELSE ' --> ' END || target FROM edges"
)


@query("lineage_mermaid", with_(f.LINEAGE_SQL, _GRAPH))
def lineage_mermaid(t):
    return build_lineage(f.fks(t), f.supplier_models(t), f.deps(t))[2]


@query(
    "lineage_markdown",
    with_(
        f.LINEAGE_SQL,
        f"SELECT doc_name, section + 10 AS section, part, ordinal, line FROM ({_GRAPH}) UNION ALL"
        " SELECT * FROM (VALUES ('lineage', 0, '', 0, '# 🌐 Global Data Lineage'),"
        " ('lineage', 0, '', 1, ''), ('lineage', 0, '', 2, '```mermaid'),"
        " ('lineage', 20, '', 0, '```'))",
    ),
)
def lineage_markdown(t):
    return R.lineage_markdown(t.spark, lineage_mermaid(t))


@query(
    "graph_json",
    with_(
        f.LINEAGE_SQL,
        "SELECT 'node' AS kind, id, '{\"id\":\"' || id || '\",\"data\":{\"label\":\"' || label ||"
        " '\"},\"type\":\"' || style || '\"}' AS json FROM nodes UNION ALL SELECT 'edge', id,"
        " '{\"id\":\"' || id || '\",\"source\":\"' || source || '\",\"target\":\"' || target ||"
        " '\",\"label\":\"' || label || '\"}' FROM edges",
    ),
)
def graph_json(t):
    nodes, edges, _ = build_lineage(f.fks(t), f.supplier_models(t), f.deps(t))
    return L.lineage_json(nodes, edges)


@query(
    "qualified_lineage",
    with_(
        f.LINEAGE_SQL,
        "SELECT 'db' AS s_style, source_table AS s_label, 'db' AS t_style, target_table AS t_label,"
        " 'FK' AS label, '' AS origin FROM (SELECT DISTINCT source_table, target_table FROM fks)"
        " UNION ALL SELECT 'box', lang || '_base', 'box', 'doc_' || doc_id, '', 'p/' || doc_id"
        " FROM documents WHERE lang <> 'de' UNION ALL SELECT 'source', source || '.' || lang,"
        " 'box', 'doc_' || doc_id, '', 'p/' || doc_id FROM documents WHERE lang <> 'de'",
    ),
)
def run_qualified_lineage(t):
    """Edges with the names of their ends: every project has its own ``fr_base``."""
    nodes, edges, _ = qualified_lineage(f.fks(t).drop("source", "table_schema"), parse_manifests(f.manifest_texts(t)))
    end = lambda side: nodes.select(
        c("id").alias({"s": "source", "t": "target"}[side]), c("style").alias(f"{side}_style"),
        c("label").alias(f"{side}_label"), c("origin").alias(f"{side}_origin"),
    )
    named = lookup_join(lookup_join(edges.drop("id"), end("s"), ["source"]), end("t"), ["target"])
    return named.select("s_style", "s_label", "t_style", "t_label", "label", c("t_origin").alias("origin"))


@query(
    "project_lineage",
    with_(
        f.LINEAGE_SQL,
        "SELECT DISTINCT source_table || '-' || target_table || '-FK' AS id, source_table AS"
        " source, target_table AS target, 'FK' AS label FROM fks UNION SELECT lang || '_base-doc_'"
        " || doc_id, lang || '_base', 'doc_' || doc_id, '' FROM documents WHERE lang <> 'de' UNION"
        " SELECT source || '.' || lang || '-doc_' || doc_id, source || '.' || lang, 'doc_' ||"
        " doc_id, '' FROM documents WHERE lang <> 'de'",
    ),
)
def project_lineage(t):
    return lineage_of_project(f.fks(t), parse_manifests(f.manifest_texts(t)))[1]


# --- Documents --------------------------------------------------------------------------

_ERD_LINE = (
    "'    \"' || source_table || '\" ||--o{ \"' || target_table || '\" : \"' || source_column ||"
    " ' to ' || target_column || '\"'"
)


def _erd(doc: str, section: int) -> str:
    return (
        f"SELECT '{doc}' AS doc_name, {section} AS section, '' AS part, 0::BIGINT AS ordinal,"
        f" '```mermaid' AS line UNION ALL SELECT '{doc}', {section}, '', 1, 'erDiagram' UNION ALL"
        f" SELECT '{doc}', {section + 1}, {_ERD_LINE}, 0, {_ERD_LINE} FROM fks UNION ALL SELECT"
        f" '{doc}', {section + 2}, '', 0, '```'"
    )


@query("erd_text", with_(f.LINEAGE_SQL, _erd("erd", 0)))
def erd_text(t):
    return R.erd_text(f.fks(t))


_TABLE_SUMMARY = (
    "'Stores ' || table_name || ' records with the columns ' ||"
    " string_agg(column_name, ', ' ORDER BY ordinal) || '.'"
)
_SUMMARIES_SQL = (
    f", summaries AS (SELECT table_name, {_TABLE_SUMMARY} AS summary FROM cols GROUP BY table_name),"
    f" views AS (SELECT name AS view_name, raw_sql AS definition, {_SUMMARY} AS summary FROM models)"
)
_LAST = 1 << 40


def _lines(section: int, part: str, lines: list[str], source: str) -> str:
    values = ", ".join(f"({i}, {line})" for i, line in enumerate(lines))
    return (
        f"SELECT 'shop', {section}, {part}, v.i, v.line FROM {source},"
        f" LATERAL (VALUES {values}) v(i, line)"
    )


_CATALOG = " UNION ALL ".join(
    [
        _erd("shop", 10),
        "SELECT 'shop', section, '', ordinal, line FROM (VALUES (0, 0, '# 📁 Data Catalog for shop'),"
        " (0, 1, ''), (0, 2, '## 🚀 Entity Relationship Diagram (ERD)'), (0, 3, ''), (19, 0, ''),"
        " (19, 1, '## 🔎 Views'), (19, 2, ''), (29, 0, ''), (29, 1, '## 🗂️ Tables'), (29, 2, ''))"
        " v(section, ordinal, line)",
        _lines(
            21,
            "view_name",
            ["'### 📄 View: `' || view_name || '`'", "''", "'**AI-Generated Summary:**'",
             "'> ' || summary", "''", "'**SQL Definition:**'", "'```sql'", "definition", "'```'", "''"],
            "views",
        ),
        _lines(
            31,
            "table_name",
            ["'### 📄 Table: `' || table_name || '`'", "''", "'**AI-Generated Summary:**'",
             "'> ' || summary", "''", "'| Column Name | Data Type | AI-Generated Description |'",
             "'| :--- | :--- | :--- |'"],
            "summaries",
        ),
        "SELECT 'shop', 31, table_name, ordinal + 100, '| `' || column_name || '` | `' || data_type"
        " || '` | ' || description || ' |' FROM cols",
        f"SELECT 'shop', 31, table_name, {_LAST}, '' FROM summaries",
    ]
)


def _shop(t):
    columns = f.as_columns(f.extract(t))
    summaries = rules.describe_tables(columns)
    views = f.models(t).select(c("name").alias("view_name"), c("raw_sql").alias("definition"))
    return columns, summaries, rules.describe_views(views)


@query(
    "catalog_markdown",
    with_(f.COLUMNS_SQL + "," + f.LINEAGE_SQL + "," + f.MODELS_SQL + _SUMMARIES_SQL, _CATALOG),
)
def catalog_markdown(t):
    columns, summaries, views = _shop(t)
    return R.catalog_markdown(columns, summaries, views, f.fks(t), "shop")


@query(
    "comment_statements",
    with_(
        f.COLUMNS_SQL + "," + f.MODELS_SQL + _SUMMARIES_SQL,
        "SELECT 'comments' AS doc_name, 0 AS section, view_name AS part, 0::BIGINT AS ordinal,"
        " 'COMMENT ON VIEW \"main\".\"' || view_name || '\" IS ''' || replace(summary, '''', '''''')"
        " || ''';' AS line FROM views UNION ALL SELECT 'comments', 1, table_name, 0,"
        " 'COMMENT ON TABLE \"main\".\"' || table_name || '\" IS ''' || replace(summary, '''',"
        " '''''') || ''';' FROM summaries UNION ALL SELECT 'comments', 1, table_name, ordinal,"
        " 'COMMENT ON COLUMN \"main\".\"' || table_name || '\".\"' || column_name || '\" IS ''' ||"
        " replace(description, '''', '''''') || ''';' FROM cols",
    ),
)
def comment_statements(t):
    columns, summaries, views = _shop(t)
    return R.comment_statements(columns, summaries, views, "main")


_MODEL_LINES = [
    "''", "'## 🚀 Model: `' || name || '`'", "''", "'### AI-Generated Model Summary'",
    f"'> ' || {_SUMMARY}", "''", "'### AI-Generated Lineage (Mermaid)'", _CHART, "''",
    "'### Column Details'", "'| Column Name | Data Type | AI-Generated Description |'",
    "'| :--- | :--- | :--- |'",
]


@query(
    "models_markdown",
    with_(
        f.MODELS_SQL
        + ", mcols AS (SELECT DISTINCT 'part_' || l_partkey AS model_name, 's' || l_suppkey AS"
        " column_name, l_suppkey AS ordinal FROM lineitem WHERE l_returnflag = 'R')",
        "SELECT 'shop' AS doc_name, 0 AS section, '' AS part, 0::BIGINT AS ordinal,"
        " '# 🧬 Data Catalog for shop (dbt)' AS line UNION ALL "
        + _lines(1, "name", _MODEL_LINES, "models")
        + " UNION ALL SELECT 'shop', 1, model_name, ordinal + 100, '| `' || column_name ||"
        " '` | `bigint` | (AI description failed) |' FROM mcols UNION ALL SELECT 'shop', 1, name,"
        " 100, '| (No columns found) | | |' FROM models WHERE name NOT IN (SELECT model_name FROM"
        " mcols)",
    ),
)
def models_markdown(t):
    models = M.model_charts(rules.describe_models(f.models(t)))
    columns = (
        t.lineitem.filter("l_returnflag = 'R'")
        .select(
            text("part_", c("l_partkey")).alias("model_name"),
            text("s", c("l_suppkey")).alias("column_name"),
            c("l_suppkey").alias("ordinal"),
            F.lit("bigint").alias("data_type"),
            F.lit(None).cast("string").alias("description"),
        )
        .distinct()
    )
    return R.models_markdown(models, columns, "shop")


# --- Text functions, prompts, generation ---------------------------------------------------


@query(
    "strip_fences",
    "SELECT doc_id, trim(replace(replace('  ```mermaid' || chr(10) || text || chr(10) || '``` ',"
    " '```mermaid', ''), '```', ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    " AS bare FROM documents",
)
def fences(t):
    fenced = text("  ```mermaid\n", c("text"), "\n``` ")
    return t.documents.select("doc_id", strip_fences(fenced).alias("bare"))


@query(
    "path_parts",
    "SELECT page_id, string_split(url, '/')[-1] AS base, regexp_extract(url, '^(.*)/[^/]*$', 1)"
    " AS folder FROM pages",
)
def path_parts(t):
    return t.pages.select(
        "page_id", basename(c("url")).alias("base"), dirname(c("url")).alias("folder")
    )


@query("escape_quotes", "SELECT page_id, replace(html, '''', '''''') AS quoted FROM pages")
def quotes(t):
    return t.pages.select("page_id", escape_quotes(c("html")).alias("quoted"))


@query(
    "verdict_parse",
    "SELECT event_id, CASE WHEN event_type IN ('click', 'error') THEN 'DRIFT' ELSE 'MATCH' END AS"
    " verdict FROM events",
)
def verdict_parse(t):
    answer = F.when(c("event_type") == "click", "It is Drift.").when(
        c("event_type") == "error", " drift"
    )
    answer = F.coalesce(answer, text("No, ", c("event_type"), " MATCHes"))
    return t.events.select("event_id", verdict(answer).alias("verdict"))


_PARSED = (
    "SELECT doc_id, CASE WHEN lang = 'en' THEN 'Document ' || doc_id || ' from ' || source ELSE"
    " 'Just ' || doc_id || ' words' END AS description, CASE WHEN lang = 'en' THEN n_chars > 1000"
    " END AS pii, CASE WHEN lang = 'en' THEN source || ',pii' END AS tags, CASE WHEN lang = 'en'"
    " THEN 'not_null' END AS tests FROM documents"
)


def _answer(t, template: str):
    pii = F.when(c("n_chars") > 1000, "true").otherwise("false")
    filled = F.format_string(template, c("doc_id"), c("source"), pii, c("source"))
    plain = text("  Just ", c("doc_id"), " words \n")
    return t.documents.select(
        "doc_id", F.when(c("lang") == "en", filled).otherwise(plain).alias("answer")
    )


def _flat(parsed):
    m = c("metadata")
    return parsed.select(
        "doc_id",
        m["description"].alias("description"),
        m["meta"]["pii"].alias("pii"),
        F.array_join(m["tags"], ",").alias("tags"),
        F.array_join(m["tests"], ",").alias("tests"),
    )


@query("metadata_parse", _PARSED)
def metadata_parse(t):
    template = (
        "description: Document %d from %s\nmeta:\n  pii: %s\ntags:\n  - %s\n  - pii\n"
        "tests:\n  - not_null\n"
    )
    return _flat(parse_yaml_metadata(_answer(t, template)))


@query("metadata_parse_json", _PARSED)
def metadata_parse_json(t):
    template = (
        '{"description": "Document %d from %s", "meta": {"pii": %s}, "tags": ["%s", "pii"],'
        ' "tests": ["not_null"]}'
    )
    return _flat(_answer(t, template).withColumn("metadata", json_metadata(c("answer"))))


@query(
    "generate_echo",
    "SELECT doc_id, 200 AS max_tokens, length('Say in one or two sentences what the model d' ||"
    " doc_id || ' produces. Its SQL is:' || chr(10) || text) || ' of 200' AS answer,"
    " NULL::VARCHAR AS error FROM documents",
)
def generate_echo(t):
    asked = t.documents.select(
        "doc_id",
        prompts.model_prompt(text("d", c("doc_id")), c("text")).alias("prompt"),
        F.lit(MAX_TOKENS["model"]).alias("max_tokens"),
    )
    return generate(asked, lambda prompt, budget: f" {len(prompt)} of {budget} ").drop("prompt")


_PROMPTS = {
    "column": "'Describe a database column in fewer than 15 words.' || chr(10) || 'Table: ' || name"
    " || chr(10) || 'Column: ' || p_brand || chr(10) || 'Type: ' || source_name || chr(10) ||"
    " 'Profile:' || chr(10) || unique_id || chr(10) || 'Mention uniqueness, few distinct values"
    " (category) and many nulls (optional).'",
    "table": "'Say in one or two sentences what the table ' || name || ' holds. Its columns are: '"
    " || source_name || '.'",
    "view": "'Say in one or two sentences what the view ' || name || ' shows. Its definition is:'"
    " || chr(10) || raw_sql",
    "model": "'Say in one or two sentences what the model ' || name || ' produces. Its SQL is:'"
    " || chr(10) || raw_sql",
    "lineage": "'Draw the direct parents of the model ' || name || ' as a top-down flow chart, from"
    " its ref and source calls:' || chr(10) || raw_sql",
    "column_metadata": "'Document the column ' || p_brand || ' (' || source_name || ') of the model"
    " ' || name || ' as YAML with description, meta.pii, tags and tests. Its SQL is:' || chr(10)"
    " || raw_sql",
    "drift": "'Answer MATCH or DRIFT: does the data contradict the description?' || chr(10) ||"
    " 'Column: ' || name || '.' || p_brand || chr(10) || 'Description: ' || source_name || chr(10)"
    " || 'Profile:' || chr(10) || unique_id",
}
_PROMPT_ROWS = " UNION ALL ".join(
    f"SELECT name, '{kind}' AS kind, {sql} AS prompt, {MAX_TOKENS[kind]} AS max_tokens FROM models"
    for kind, sql in _PROMPTS.items()
)


@query("prompt_rows", with_(f.MODELS_SQL, _PROMPT_ROWS))
def prompt_rows(t):
    named = text("part_", c("p_partkey"))
    models = t.part.join(f.models(t), named == c("name")).withColumn(
        "source_name", text(c("p_type"), ".", c("p_name"))
    )
    name, sql, brand, source = c("name"), c("raw_sql"), c("p_brand"), c("source_name")
    texts = {
        "column": prompts.column_prompt(name, brand, source, c("unique_id")),
        "table": prompts.table_prompt(name, source),
        "view": prompts.view_prompt(name, sql),
        "model": prompts.model_prompt(name, sql),
        "lineage": prompts.lineage_prompt(name, sql),
        "column_metadata": prompts.column_metadata_prompt(name, brand, source, sql),
        "drift": prompts.drift_prompt(name, brand, source, c("unique_id")),
    }
    rows = [
        F.struct(
            F.lit(kind).alias("kind"),
            prompt.alias("prompt"),
            F.lit(MAX_TOKENS[kind]).alias("max_tokens"),
        )
        for kind, prompt in texts.items()
    ]
    return models.select("name", F.inline(F.array(*rows)))


_METADATA_PROMPT_LENGTH = (
    "length('Document the column doc_id (bigint) of the model ' || name || ' as YAML with"
    " description, meta.pii, tags and tests. Its SQL is:' || chr(10) || raw_sql)"
)
_MODEL_PROMPT_LENGTH = (
    "length('Say in one or two sentences what the model ' || name || ' produces. Its SQL is:'"
    " || chr(10) || raw_sql)"
)


@query(
    "generated_proposals",
    "WITH m AS (SELECT 'p/' || doc_id AS project, 'doc_' || doc_id AS name, CASE WHEN lang = 'fr' THEN 'select * from"
    " {{ ref(''fr_base'') }}, {{ source(''' || source || ''', ''fr'') }}' ELSE"
    " '-- SQL code not available --' END AS raw_sql, 'models/' || lang || '/doc_' || doc_id ||"
    f" '.sql' AS original_file_path FROM {_PROJECTS} d) SELECT name AS model_name, NULL AS"
    f" column_name, 'description' AS doc_key, 'words: ' || {_MODEL_PROMPT_LENGTH} AS"
    " proposed_value, original_file_path, project FROM m UNION ALL SELECT name, 'doc_id', v.k, CASE v.k"
    f" WHEN 'description' THEN 'Text ' || {_METADATA_PROMPT_LENGTH} WHEN 'meta' THEN"
    " '{\"pii\":false}' ELSE '[\"a\",\"250\"]' END, original_file_path, project FROM m,"
    " (VALUES ('description'), ('meta'), ('tags')) v(k)",
)
def run_generated_proposals(t):
    def answer(prompt: str, budget: int) -> str:
        if prompt.startswith("Document"):
            return (
                f"description: Text {len(prompt)}\nmeta: {{pii: false}}\ntags: [a, '{budget}']\n"
            )
        return f"words: {len(prompt)}"

    manifests = parse_manifests(f.manifest_texts(t))
    columns = M.model_columns(manifests).filter("column_name = 'doc_id'")
    return generated_proposals(M.models_of(manifests), columns, answer)[0]
