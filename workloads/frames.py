"""Metadata frames derived from the given tables, in Spark and as SQL (``WITH`` parts).

The metadata operators take listings landed from many databases and projects. Here
every order plays a table with its line items as columns, customers and suppliers
play models, and so on; the frames grow with the tables they come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Tables


def text(*parts: str | Column) -> Column:
    """Concatenate columns (given as Column) and literal texts (given as str)."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def c(name: str) -> Column:
    return F.col(name)


# --- Extracts of database catalogs: a table per order, a column per line number -----

EXTRACT_SQL = """
lines AS (
  SELECT l_orderkey, l_linenumber, max(l_returnflag) AS flag, min(l_linestatus) AS status
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
extract AS (
  SELECT o_orderstatus AS source, o_orderpriority AS table_schema,
    't' || o_orderkey AS table_name, 'c' || l_linenumber AS column_name,
    l_linenumber AS ordinal_position, flag AS data_type,
    CASE WHEN status = 'O' THEN 'YES' ELSE 'NO' END AS is_nullable,
    status, o_orderkey, o_custkey
  FROM lines JOIN orders ON l_orderkey = o_orderkey)"""


def extract(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status")
    )
    joined = lines.join(t.orders, c("l_orderkey") == c("o_orderkey"))
    return joined.select(
        c("o_orderstatus").alias("source"),
        c("o_orderpriority").alias("table_schema"),
        text("t", c("o_orderkey")).alias("table_name"),
        text("c", c("l_linenumber")).alias("column_name"),
        c("l_linenumber").alias("ordinal_position"),
        c("flag").alias("data_type"),
        F.when(c("status") == "O", "YES").otherwise("NO").alias("is_nullable"),
        "status",
        "o_orderkey",
        "o_custkey",
    )


_PLACE = ["source", "table_schema"]


def key_usage(columns: DataFrame) -> DataFrame:
    """Primary keys over the finished lines, foreign keys over the returned ones."""
    names = ["table_name", "column_name", "ordinal_position"]
    primary = columns.filter("status = 'F'").select(
        *_PLACE, text("pk_", c("o_orderkey")).alias("constraint_name"), *names
    )
    foreign = columns.filter("data_type = 'R'").select(
        *_PLACE, text("fk_", c("o_orderkey")).alias("constraint_name"), *names
    )
    return primary.unionByName(foreign)


def constraints(t: Tables) -> DataFrame:
    place = [c("o_orderstatus").alias("source"), c("o_orderpriority").alias("table_schema")]
    return t.orders.select(
        *place,
        F.inline(
            F.array(
                F.struct(
                    text("pk_", c("o_orderkey")).alias("constraint_name"),
                    F.lit("PRIMARY KEY").alias("constraint_type"),
                ),
                F.struct(
                    text("fk_", c("o_orderkey")).alias("constraint_name"),
                    F.lit("FOREIGN KEY").alias("constraint_type"),
                ),
            )
        ),
    )


def referenced_usage(columns: DataFrame) -> DataFrame:
    return columns.filter("data_type = 'R'").select(
        *_PLACE,
        text("fk_", c("o_orderkey")).alias("constraint_name"),
        text("cust_", c("o_custkey")).alias("table_name"),
        text("k", c("ordinal_position")).alias("column_name"),
        "ordinal_position",
    )


def table_extract(t: Tables) -> DataFrame:
    return t.orders.select(
        c("o_orderstatus").alias("source"),
        c("o_orderpriority").alias("table_schema"),
        text("t", c("o_orderkey")).alias("table_name"),
        F.when(c("o_orderstatus") == "P", "VIEW").otherwise("BASE TABLE").alias("table_type"),
    )


def as_columns(columns: DataFrame) -> DataFrame:
    """The extract in the COLUMNS layout, with a description of the data type."""
    return columns.select(
        "table_name",
        "column_name",
        c("ordinal_position").alias("ordinal"),
        "data_type",
        text("It's of type ", c("data_type")).alias("description"),
    )


COLUMNS_SQL = (
    EXTRACT_SQL
    + """,
cols AS (
  SELECT table_name, column_name, ordinal_position AS ordinal, data_type,
    'It''s of type ' || data_type AS description FROM extract)"""
)

# --- Models: one per part, with SQL text that names its parents ----------------------

MODELS_SQL = """
models AS (
  SELECT 'shop' AS manifest_path, 'model.shop.part_' || p_partkey AS unique_id,
    'part_' || p_partkey AS name, '' AS description,
    'select * from {{ ref(''' || p_brand || ''') }} join {{ source("' || p_type || '", "'
      || p_name || '") }} using (k) left join {{ ref( ''' || p_brand || ''' ) }}' AS raw_sql,
    p_brand, p_type || '.' || p_name AS source_name,
    'part_' || p_partkey || '.sql' AS path,
    'models/' || p_type || '/part_' || p_partkey || '.sql' AS original_file_path
  FROM part)"""


def models(t: Tables) -> DataFrame:
    name = text("part_", c("p_partkey"))
    return t.part.select(
        F.lit("shop").alias("manifest_path"),
        text("model.shop.", name).alias("unique_id"),
        name.alias("name"),
        F.lit("").alias("description"),
        text(
            "select * from {{ ref('", c("p_brand"), "') }} join {{ source(\"", c("p_type"),
            '", "', c("p_name"), "\") }} using (k) left join {{ ref( '", c("p_brand"), "' ) }}",
        ).alias("raw_sql"),
        text(name, ".sql").alias("path"),
        text("models/", c("p_type"), "/", name, ".sql").alias("original_file_path"),
    )


# Sorted parents of such a model, as SQL.
PARENTS_SQL = (
    "CASE WHEN p_brand < source_name THEN p_brand || '{0}' || source_name"
    " ELSE source_name || '{0}' || p_brand END"
)

# --- Lineage: suppliers are models and also have foreign keys ------------------------

LINEAGE_SQL = """
fks AS (
  SELECT s_name AS source_table, 's_nationkey' AS source_column, n_name AS target_table,
    'n_nationkey' AS target_column FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL
  SELECT c_name, 'c_nationkey', n_name, 'n_nationkey'
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
deps AS (
  SELECT s_name AS model_name, CASE WHEN l_linestatus = 'O' THEN 'part_' || l_partkey
    ELSE p_type || '.part_' || l_partkey END AS dependency
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
nodes AS (
  SELECT id, id AS label, CASE max(rank) WHEN 3 THEN 'box' WHEN 2 THEN 'source' ELSE 'db' END
    AS style FROM (
      SELECT source_table AS id, 1 AS rank FROM fks
      UNION ALL SELECT target_table, 1 FROM fks
      UNION ALL SELECT s_name, 3 FROM supplier
      UNION ALL SELECT model_name, 3 FROM deps
      UNION ALL SELECT dependency, CASE WHEN contains(dependency, '.') THEN 2 ELSE 3 END
        FROM deps) GROUP BY id),
edges AS (
  SELECT DISTINCT source_table || '-' || target_table || '-FK' AS id,
    source_table AS source, target_table AS target, 'FK' AS label FROM fks
  UNION SELECT DISTINCT dependency || '-' || model_name, dependency, model_name, '' FROM deps)"""


def fks(t: Tables) -> DataFrame:
    def of(df: DataFrame, name: str, key: str) -> DataFrame:
        return df.join(t.nation, c(key) == c("n_nationkey")).select(
            c(name).alias("source_table"),
            F.lit(key).alias("source_column"),
            c("n_name").alias("target_table"),
            F.lit("n_nationkey").alias("target_column"),
        )

    return of(t.supplier, "s_name", "s_nationkey").unionByName(
        of(t.customer, "c_name", "c_nationkey")
    )


def supplier_models(t: Tables) -> DataFrame:
    return t.supplier.select(c("s_name").alias("name"))


def deps(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t.supplier, c("l_suppkey") == c("s_suppkey")).join(
        t.part, c("l_partkey") == c("p_partkey")
    )
    part = text("part_", c("l_partkey"))
    return joined.select(
        c("s_name").alias("model_name"),
        F.when(c("l_linestatus") == "O", part)
        .otherwise(text(c("p_type"), ".", part))
        .alias("dependency"),
    )


# --- Documentation: a model per customer, a column per order -------------------------

DOCS_SQL = """
buyers AS (
  SELECT *, 'models/' || c_nationkey || '/' || CASE WHEN c_mktsegment = 'AUTOMOBILE'
    THEN 'schema' ELSE lower(c_mktsegment) END || '.yml' AS doc_file,
    CASE WHEN c_acctbal > 9000 THEN '' WHEN c_acctbal < 1000 THEN 'staging/' || c_name || '.sql'
      ELSE 'models/' || c_nationkey || '/' || c_name || '.sql' END AS sql_file
  FROM customer),
bought AS (SELECT * FROM buyers JOIN orders ON o_custkey = c_custkey),
docs AS (
  SELECT 'models' AS node_type, c_name AS model_name, NULL::VARCHAR AS column_name,
    'description' AS doc_key, nullif(c_mktsegment, 'BUILDING') AS doc_value,
    doc_file AS file_path FROM buyers WHERE c_mktsegment <> 'MACHINERY'
  UNION ALL
  SELECT 'models', c_name, 'o' || o_orderkey,
    CASE WHEN o_orderstatus = 'P' THEN 'name' ELSE 'description' END,
    CASE WHEN o_orderstatus = 'P' THEN 'o' || o_orderkey
      ELSE nullif(o_orderpriority, '5-LOW') END,
    doc_file FROM bought WHERE c_mktsegment <> 'MACHINERY'),
proposals AS (
  SELECT c_name AS model_name, NULL::VARCHAR AS column_name, 'description' AS doc_key,
    'Orders of ' || c_name AS proposed_value, sql_file AS original_file_path FROM buyers
  UNION ALL
  SELECT c_name, 'o' || o_orderkey, 'description', 'Order of ' || o_orderpriority, sql_file
    FROM bought
  UNION ALL
  SELECT c_name, 'o' || o_orderkey, 'tests', CASE WHEN o_orderstatus = 'F' THEN '["unique"]'
    END, sql_file FROM bought)"""


def buyers(t: Tables) -> DataFrame:
    segment = c("c_mktsegment")
    file = F.when(segment == "AUTOMOBILE", "schema").otherwise(F.lower(segment))
    return t.customer.withColumn(
        "doc_file", text("models/", c("c_nationkey"), "/", file, ".yml")
    ).withColumn(
        "sql_file",
        F.when(c("c_acctbal") > 9000, "")
        .when(c("c_acctbal") < 1000, text("staging/", c("c_name"), ".sql"))
        .otherwise(text("models/", c("c_nationkey"), "/", c("c_name"), ".sql")),
    )


def bought(t: Tables) -> DataFrame:
    return buyers(t).join(t.orders, c("o_custkey") == c("c_custkey"))


def docs(t: Tables) -> DataFrame:
    column, partial = text("o", c("o_orderkey")), c("o_orderstatus") == "P"
    models_ = (
        buyers(t)
        .filter("c_mktsegment <> 'MACHINERY'")
        .select(
            F.lit("models").alias("node_type"),
            c("c_name").alias("model_name"),
            F.lit(None).cast("string").alias("column_name"),
            F.lit("description").alias("doc_key"),
            F.nullif(c("c_mktsegment"), F.lit("BUILDING")).alias("doc_value"),
            c("doc_file").alias("file_path"),
        )
    )
    columns = (
        bought(t)
        .filter("c_mktsegment <> 'MACHINERY'")
        .select(
            F.lit("models").alias("node_type"),
            c("c_name").alias("model_name"),
            column.alias("column_name"),
            F.when(partial, "name").otherwise("description").alias("doc_key"),
            F.when(partial, column)
            .otherwise(F.nullif(c("o_orderpriority"), F.lit("5-LOW")))
            .alias("doc_value"),
            c("doc_file").alias("file_path"),
        )
    )
    return models_.unionByName(columns)


def proposals(t: Tables) -> DataFrame:
    models_ = buyers(t).select(
        c("c_name").alias("model_name"),
        F.lit(None).cast("string").alias("column_name"),
        F.lit("description").alias("doc_key"),
        text("Orders of ", c("c_name")).alias("proposed_value"),
        c("sql_file").alias("original_file_path"),
    )
    tests = F.when(c("o_orderstatus") == "F", '["unique"]')
    entries = F.array(
        F.struct(
            F.lit("description").alias("doc_key"),
            text("Order of ", c("o_orderpriority")).alias("proposed_value"),
        ),
        F.struct(F.lit("tests").alias("doc_key"), tests.alias("proposed_value")),
    )
    columns = bought(t).select(
        c("c_name").alias("model_name"),
        text("o", c("o_orderkey")).alias("column_name"),
        F.inline(entries),
        c("sql_file").alias("original_file_path"),
    )
    return models_.unionByName(columns)


# --- Manifests: one per document, as JSON text; German ones hold raw, malformed text --


def manifest_texts(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    name = text("doc_", c("doc_id"))

    def column(description: Column, kind: Column) -> Column:
        return F.struct(description.alias("description"), kind.alias("data_type"))

    def node(kind: str, label: Column, **fields: Column) -> Column:
        empty_columns = F.lit(None).cast("map<string,struct<description:string,data_type:string>>")
        config = F.lit(None).cast("struct<description:string>")
        depends = F.lit(None).cast("struct<nodes:array<string>>")
        values = {
            "resource_type": F.lit(kind),
            "name": label,
            "description": fields.get("description", none),
            "config": fields.get("config", config),
            "path": fields.get("path", none),
            "original_file_path": fields.get("file", none),
            "raw_code": fields.get("raw_code", none),
            "depends_on": fields.get("depends_on", depends),
            "columns": fields.get("columns", empty_columns),
        }
        return F.struct(*[v.alias(k) for k, v in values.items()])

    seed_id, source_id = text("seed.p.", c("lang")), text("source.p.", c("source"))
    model = node(
        "model",
        name,
        description=F.when(c("lang") == "en", "").otherwise(c("text")),
        config=F.struct(text("From ", c("source")).alias("description")),
        path=text(name, ".sql"),
        file=text("models/", c("lang"), "/", name, ".sql"),
        raw_code=F.when(
            c("lang") == "fr",
            text("select * from {{ ref('", c("lang"), "_base') }}, {{ source('", c("source"), "', '",
                 c("lang"), "') }}"),
        ),
        depends_on=F.struct(
            F.array(seed_id, source_id, F.lit("test.p.t"), F.lit("model.p.gone")).alias("nodes")
        ),
        columns=F.create_map(
            F.lit("doc_id"), column(F.lit(""), F.lit("bigint")),
            F.lit("email"), column(c("text"), none),
        ),
    )
    content = F.struct(
        F.create_map(
            text("model.p.", name), model,
            seed_id, node("seed", text(c("lang"), "_base")),
            F.lit("test.p.t"), node("test", F.lit("t")),
        ).alias("nodes"),
        F.create_map(
            source_id,
            F.struct(
                F.lit("source").alias("resource_type"),
                c("source").alias("source_name"),
                c("lang").alias("name"),
            ),
        ).alias("sources"),
    )
    return t.documents.select(
        text("p/", c("doc_id")).alias("manifest_path"),
        F.when(c("lang") == "de", c("text")).otherwise(F.to_json(content)).alias("value"),
    )
