import glob
import os

import pytest
from pyspark.sql import functions as F

from lakedoc.operators import lineage as L
from lakedoc.operators import render as R
from lakedoc.operators.rules import describe_columns
from lakedoc.plans.catalog import build_catalog, catalog_records
from lakedoc.schemas import local_frame
from lakedoc.sinks.comments import apply_comments, with_comments
from lakedoc.sinks.durable import durable
from lakedoc.sinks.files import write_docs, write_json, write_lines
from lakedoc.sources.catalog import list_catalog_columns, list_tables, list_views, read_tables
from lakedoc.sources.files import list_datasets, scan_files, spark_uri
from lakedoc.sources.saved import read_catalog
from tests.conftest import rows

COLUMNS = "table_name string, column_name string, ordinal int, data_type string, description string"
VIEWS = "view_name string, definition string, summary string"


@pytest.fixture(scope="module")
def shop(spark):
    columns = local_frame(
        spark,
        [("users", "id", 1, "int", "User's ID"), ("users", "name", 2, "string", "Name")],
        COLUMNS,
    )
    summaries = local_frame(spark, [("users", "All users")], "table_name string, summary string")
    views = local_frame(spark, [("v", "SELECT 1", "Just one")], VIEWS)
    fks = local_frame(spark, [("orders", "user_id", "users", "id")], "FKS")
    return columns, summaries, views, fks


def written(lines, folder):
    """The text of every document, from its part files in order."""
    write_lines(lines, str(folder))
    texts = {}
    for doc in glob.glob(f"{folder}/doc_name=*"):
        name = os.path.basename(doc).removeprefix("doc_name=")
        parts = sorted(glob.glob(f"{doc}/part-*"))
        texts[name] = "".join(open(p, encoding="utf-8").read() for p in parts)
    return texts


def test_catalog_document(shop, tmp_path):
    text = written(R.catalog_markdown(*shop, "shop"), tmp_path / "d")["shop"]
    assert text == (
        "# 📁 Data Catalog for shop\n\n## 🚀 Entity Relationship Diagram (ERD)\n\n"
        '```mermaid\nerDiagram\n    "orders" ||--o{ "users" : "user_id to id"\n```\n'
        "\n## 🔎 Views\n\n### 📄 View: `v`\n\n**AI-Generated Summary:**\n> Just one\n\n"
        "**SQL Definition:**\n```sql\nSELECT 1\n```\n\n"
        "\n## 🗂️ Tables\n\n### 📄 Table: `users`\n\n**AI-Generated Summary:**\n> All users\n\n"
        "| Column Name | Data Type | AI-Generated Description |\n| :--- | :--- | :--- |\n"
        "| `id` | `int` | User's ID |\n| `name` | `string` | Name |\n\n"
    )


def test_empty_catalog_document(shop, tmp_path):
    empty = [frame.filter("1 = 0") for frame in shop]
    text = written(R.catalog_markdown(*empty, "none"), tmp_path / "d")["none"]
    assert "No foreign key relationships found to generate a diagram.\n" in text
    assert "No views found in this database.\n" in text
    assert text.endswith("No tables found in this database.\n")
    assert "mermaid" not in text


def test_large_document_stays_in_order(spark, tmp_path):
    lines = spark.range(50000).select(
        F.lit("big").alias("doc_name"),
        F.lit(1).alias("section"),
        F.format_string("%08d", "id").alias("part"),
        F.lit(0).cast("long").alias("ordinal"),
        F.format_string("%08d", "id").alias("line"),
    )
    text = written(lines.repartition(7), tmp_path / "d")["big"]
    assert text.split() == [f"{i:08d}" for i in range(50000)]


def test_model_document(spark, tmp_path):
    models = local_frame(
        spark, [("a", "About a", "chart"), ("b", None, None)], "name string, summary string, chart string"
    )
    columns = local_frame(
        spark,
        [("a", "y", 2, "int", None), ("a", "x", 1, "int", "The x")],
        COLUMNS.replace("table_name", "model_name"),
    )
    text = written(R.models_markdown(models, columns, "p"), tmp_path / "d")["p"]
    assert text == (
        "# 🧬 Data Catalog for p (dbt)\n\n## 🚀 Model: `a`\n\n### AI-Generated Model Summary\n> About a\n\n"
        "### AI-Generated Lineage (Mermaid)\nchart\n\n### Column Details\n"
        "| Column Name | Data Type | AI-Generated Description |\n| :--- | :--- | :--- |\n"
        "| `x` | `int` | The x |\n| `y` | `int` | (AI description failed) |\n"
        "\n## 🚀 Model: `b`\n\n### AI-Generated Model Summary\n> (No summary available)\n\n"
        "### AI-Generated Lineage (Mermaid)\n*(Lineage chart generation failed)*\n\n### Column Details\n"
        "| Column Name | Data Type | AI-Generated Description |\n| :--- | :--- | :--- |\n"
        "| (No columns found) | | |\n"
    )


def test_lineage_document(spark, shop, tmp_path):
    nodes = local_frame(spark, [("a", "a", "box")], "NODES")
    edges = local_frame(spark, [], "EDGES")
    graph = L.lineage_mermaid(nodes, edges)
    text = written(R.lineage_markdown(spark, graph), tmp_path / "d")["lineage"]
    assert text == '# 🌐 Global Data Lineage\n\n```mermaid\ngraph TD;\n    a["a"]\n\n```\n'
    none = written(R.lineage_markdown(spark, None), tmp_path / "e")["lineage"]
    assert none == (
        "# 🌐 Global Data Lineage\n\n```mermaid\ngraph TD;\n  A[No lineage data found]\n```\n"
    )


def test_comment_statements(shop, spark):
    columns, summaries, views, _ = shop
    unnamed = local_frame(spark, [("bare", "")], "table_name string, summary string")
    lines = R.comment_statements(columns, summaries.union(unnamed), views, "public")
    assert [r.line for r in lines.orderBy("section", "part", "ordinal").collect()] == [
        'COMMENT ON VIEW "public"."v" IS \'Just one\';',
        'COMMENT ON TABLE "public"."users" IS \'All users\';',
        'COMMENT ON COLUMN "public"."users"."id" IS \'User\'\'s ID\';',
        'COMMENT ON COLUMN "public"."users"."name" IS \'Name\';',
    ]


def test_catalog_round_trip(spark, tmp_path, shop):
    users = spark.createDataFrame([(1, "a"), (2, None)], "id int, nick string")
    built = build_catalog({"users": users})
    records = catalog_records(built, shop[2].select("view_name", "definition"), shop[3])
    path = str(tmp_path / "catalog")
    write_json(records, path)
    saved = read_catalog(spark, path)
    assert rows(saved, *records.columns) == rows(records)
    table = saved.filter("record = 'table'").collect()[0]
    assert [c.name for c in table.columns] == ["id", "nick"]
    assert table.columns[1].profile_stats.null_ratio == 0.5
    assert table.summary == "Stores users records with the columns id, nick."
    with pytest.raises(FileNotFoundError, match="write one first"):
        read_catalog(spark, str(tmp_path / "absent"))


def test_wide_tables_have_one_record(spark):
    frame = spark.range(1).select(*[F.lit(i).alias(f"c{i}") for i in range(70)])
    built = build_catalog({"wide": frame})
    nothing = local_frame(spark, [], VIEWS), local_frame(spark, [], "FKS")
    records = R.assemble_catalog(built, *nothing)
    assert rows(records, "name", F.size("columns")) == [("wide", 70)]


def test_updated_documentation_is_written_per_file(spark, tmp_path):
    filled = local_frame(
        spark,
        [("models", "a", None, "description", "x", "one.yml", True),
         ("models", "b", None, "description", "y", "one.yml", False),
         ("models", "c", None, "description", "z", "two.yml", False)],
        "node_type string, model_name string, column_name string, doc_key string,"
        " doc_value string, file_path string, changed boolean",
    )
    write_docs(filled, str(tmp_path / "docs"))
    saved = spark.read.parquet(str(tmp_path / "docs"))
    assert rows(saved, "model_name", "file_path") == [("a", "one.yml"), ("b", "one.yml")]


def test_unchanged_documentation_files_stay(spark, tmp_path):
    ddl = ("node_type string, model_name string, column_name string, doc_key string,"
           " doc_value string, file_path string, changed boolean")  # fmt: skip
    path = str(tmp_path / "docs")
    old = [("models", m, None, "description", "old", f"{m}.yml", True) for m in "abc"]
    write_docs(local_frame(spark, old, ddl), path)
    new = [("models", m, None, "description", "new", f"{m}.yml", m == "b") for m in "abc"]
    write_docs(local_frame(spark, new, ddl), path)
    saved = spark.read.parquet(path)
    assert rows(saved, "model_name", "doc_value") == [("a", "old"), ("b", "new"), ("c", "old")]


def test_spark_catalog(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS shopdb")
    spark.sql("CREATE TABLE shopdb.users (id INT COMMENT 'old', name STRING) USING parquet")
    spark.sql("CREATE TABLE shopdb.orders (id INT, user_id INT) USING parquet")
    spark.sql("CREATE VIEW shopdb.user_orders AS SELECT u.name,\n o.id FROM shopdb.users u JOIN shopdb.orders o ON u.id = o.user_id")
    spark.range(1).createOrReplaceTempView("passing")
    try:
        assert rows(list_tables(spark, "shopdb")) == [("orders",), ("users",)]
        assert rows(list_views(spark, "shopdb")) == [
            ("user_orders", "SELECT u.name,\n o.id FROM shopdb.users u JOIN shopdb.orders o ON u.id = o.user_id")
        ]
        columns = list_catalog_columns(spark, "shopdb", ["users"])
        assert rows(columns, "ordinal", "column_name", "data_type", "description") == [
            (1, "id", "int", "old"), (2, "name", "string", ""),
        ]
        summaries = local_frame(spark, [("users", "It's \\ users")], "table_name string, summary string")
        texts = local_frame(spark, [("users", "name", "The user's name")], "table_name string, column_name string, description string")
        assert apply_comments(spark, "shopdb", summaries, texts) == 2
        columns = list_catalog_columns(spark, "shopdb", ["users"])
        assert rows(columns, "column_name", "description") == [("id", "old"), ("name", "The user's name")]
        detail = dict(rows(spark.sql("DESCRIBE TABLE EXTENDED shopdb.users"), "col_name", "data_type"))
        assert detail["Comment"] == "It's \\ users"
        assert set(read_tables(spark, "shopdb", ["users"])) == {"users"}
    finally:
        spark.sql("DROP DATABASE shopdb CASCADE")


def test_comments_travel_with_files(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    with_comments(spark.range(2), {"id": "The key"}).write.parquet(path)
    assert spark.read.parquet(path).schema["id"].metadata["comment"] == "The key"


def test_file_sources(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "p.parquet"))
    (tmp_path / "a.csv").write_text("x,y\n1,b\n2,c\n")
    (tmp_path / "b.tsv").write_text("x\ty\n1\tb\n")
    (tmp_path / "c.json").write_text('{"x": 1.5}\n{"x": null}\n')
    (tmp_path / "noending").write_text("x")
    assert scan_files(spark, str(tmp_path / "a.csv")).dtypes == [("x", "int"), ("y", "string")]
    assert scan_files(spark, str(tmp_path / "b.tsv")).columns == ["x", "y"]
    assert scan_files(spark, str(tmp_path / "c.json"), sampling_ratio=1.0).dtypes == [("x", "double")]
    assert scan_files(spark, str(tmp_path / "p.parquet")).count() == 3
    listed = list_datasets(spark, f"{tmp_path}/")
    assert rows(listed, "dataset", "format", "bytes")[:3] == [("a.csv", "csv", 12), ("b.tsv", "csv", 8), ("c.json", "json", 23)]
    assert "noending" not in dict(rows(listed, "dataset", "format"))
    assert rows(list_datasets(spark, f"{tmp_path}/*.csv"), "dataset") == [("a.csv",)]
    paths = {r.dataset: r.path for r in listed.collect()}
    assert scan_files(spark, paths["a.csv"]).count() == 2  # the listed path can be read as it is
    lake = tmp_path / "lake"
    for k in (1, 2):
        spark.range(3).coalesce(1).write.parquet(str(lake / "orders" / f"day={k}"))
    spark.range(3).repartition(2).write.parquet(str(lake / "items"))
    folders = list_datasets(spark, f"{lake}/")
    assert rows(folders, "dataset", "format", "files") == [("items", "parquet", 2), ("orders", "parquet", 2)]
    assert all(r.bytes > 0 for r in folders.collect())
    assert rows(list_datasets(spark, f"{lake}/*"), "dataset") == [("items",), ("orders",)]
    assert rows(list_datasets(spark, f"{lake}/orders/"), "dataset", "files") == [("orders", 2)]
    assert {r.dataset: r.path for r in folders.collect()}["items"].endswith("/lake/items")
    single = str(tmp_path / "a.csv")
    assert rows(list_datasets(spark, single), "dataset", "path") == [(single, single)]
    assert spark_uri("s3://bucket/x/*.parquet") == "s3a://bucket/x/*.parquet"


def test_durable_uses_the_configured_folder(spark):
    kept = durable(spark.range(5))
    assert kept.count() == 5
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert spark.sparkContext.getCheckpointDir().removeprefix("file:").startswith(folder)


def test_descriptions_are_short(spark):
    frame = spark.range(20).select(
        "id", (F.col("id") % 3).alias("very_long_name_of_a_kind"), F.lit(None).cast("int").alias("x")
    )
    texts = build_catalog({"big_table": frame}).select("description").collect()
    assert all(len(r.description.split()) < 15 for r in texts)
    assert describe_columns(frame.limit(0).selectExpr("'t' table_name", "'c' column_name", "true is_unique", "0L distinct_count", "0D null_ratio")).columns[-1] == "description"
