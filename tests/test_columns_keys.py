import pytest
from pyspark.sql import functions as F

from lakedoc.operators import columns as C
from lakedoc.operators import keys as K
from lakedoc.operators import rules
from lakedoc.operators.joins import lookup_join
from lakedoc.plans.generated import catalog_prompts
from lakedoc.schemas import local_frame
from tests.conftest import rows


@pytest.fixture(scope="module")
def extract(spark):
    """Two databases; the schemas share constraint names; order_items has a composite key."""
    columns = spark.createDataFrame(
        [
            ("d1", "s1", "orders", "id", 1, "int", "NO"),
            ("d1", "s1", "orders", "user_id", 2, "int", "YES"),
            ("d1", "s1", "items", "order_id", 1, "int", "NO"),
            ("d1", "s1", "items", "line", 2, "int", "NO"),
            ("d1", "s2", "orders", "id", 1, "int", "NO"),
            ("d2", "s1", "orders", "id", 1, "int", "NO"),
            ("d1", "s1", "log", "line", 1, "text", "YES"),
        ],
        "source string, table_schema string, table_name string, column_name string,"
        " ordinal_position int, data_type string, is_nullable string",
    )
    usage = spark.createDataFrame(
        [
            ("d1", "s1", "pk_orders", "orders", "id", 1),
            ("d1", "s1", "pk_items", "items", "order_id", 1),
            ("d1", "s1", "pk_items", "items", "line", 2),
            ("d1", "s1", "fk_items", "items", "order_id", 1),  # in a PK and an FK at once
            ("d1", "s1", "fk_user", "orders", "user_id", 1),
            ("d1", "s2", "pk_orders", "orders", "id", 1),  # same name, but unique there
        ],
        "source string, table_schema string, constraint_name string, table_name string,"
        " column_name string, ordinal_position int",
    )
    constraints = spark.createDataFrame(
        [
            ("d1", "s1", "pk_orders", "PRIMARY KEY"),
            ("d1", "s1", "pk_items", "PRIMARY KEY"),
            ("d1", "s1", "fk_items", "FOREIGN KEY"),
            ("d1", "s1", "fk_user", "FOREIGN KEY"),
            ("d1", "s2", "pk_orders", "UNIQUE"),
        ],
        "source string, table_schema string, constraint_name string, constraint_type string",
    )
    return columns, usage, constraints


def test_primary_key_flags(extract):
    got = rows(
        C.columns_with_pk(*extract), "source", "table_schema", "table_name", "column_name", "is_pk"
    )
    flagged = [r[:4] for r in got if r[4]]
    assert flagged == [
        ("d1", "s1", "items", "line"),
        ("d1", "s1", "items", "order_id"),
        ("d1", "s1", "orders", "id"),
    ]
    assert len(got) == 7  # one row per column


def test_nullable_and_pk_membership(extract):
    columns, usage, _ = extract
    marked = C.mark_pk(columns, usage.filter("constraint_name like 'pk_%'"))
    assert [r for r in rows(marked, "table_name", "column_name", "is_nullable") if r[2]] == [
        ("log", "line", True),
        ("orders", "user_id", True),
    ]


def test_base_tables(spark):
    tables = spark.createDataFrame(
        [("d", "a", "t", "BASE TABLE"), ("d", "a", "v", "VIEW"), ("d", "b", "u", "BASE TABLE")],
        "source string, table_schema string, table_name string, table_type string",
    )
    assert rows(C.base_tables(tables), "table_name") == [("t",), ("u",)]
    assert rows(C.base_tables(tables, "b"), "table_name") == [("u",)]


def test_foreign_keys(spark, extract):
    _, usage, constraints = extract
    reference = spark.createDataFrame(
        [("d1", "s1", "fk_items", "orders", "id"), ("d1", "s1", "fk_user", "users", "id")],
        "source string, table_schema string, constraint_name string, table_name string,"
        " column_name string",
    )
    names = ("source_table", "source_column", "target_table", "target_column")
    assert rows(K.foreign_keys(constraints, usage, reference, "s1"), *names) == [
        ("items", "order_id", "orders", "id"),
        ("orders", "user_id", "users", "id"),
    ]
    assert rows(K.foreign_keys(constraints, usage, reference, "s2")) == []


def test_composite_foreign_key_is_paired_by_position(spark):
    constraints = spark.createDataFrame(
        [("d", "s", "fk", "FOREIGN KEY")],
        "source string, table_schema string, constraint_name string, constraint_type string",
    )
    layout = (
        "source string, table_schema string, constraint_name string, table_name string,"
        " column_name string, ordinal_position int"
    )
    child = spark.createDataFrame(
        [("d", "s", "fk", "c", "a", 1), ("d", "s", "fk", "c", "b", 2)], layout
    )
    parent = spark.createDataFrame(
        [("d", "s", "fk", "p", "x", 1), ("d", "s", "fk", "p", "y", 2)], layout
    )
    names = ("source_column", "target_column")
    assert rows(K.foreign_keys(constraints, child, parent), *names) == [("a", "x"), ("b", "y")]


def test_pragma_layouts(spark):
    info = spark.createDataFrame(
        [("t", 0, "id", "INTEGER", 1, None, 1), ("t", 1, "part", "TEXT", 0, None, 2), ("t", 2, "x", "TEXT", 0, None, 0)],
        "table_name string, cid int, name string, type string, notnull int, dflt_value string, pk int",
    )
    got = rows(C.columns_from_pragma(info), "ordinal", "column_name", "is_nullable", "is_pk")
    assert got == [(1, "id", False, True), (2, "part", True, True), (3, "x", True, False)]


def test_column_list_order_and_width(spark):
    columns = spark.createDataFrame(
        [("t", f"c{i}", i) for i in range(12, 0, -1)], "table_name string, column_name string, ordinal int"
    )
    whole = rows(C.column_list(columns))
    assert whole == [("t", ", ".join(f"c{i}" for i in range(1, 13)))]


def test_a_table_of_1500_columns_has_one_list_summary_and_prompt(spark):
    wide = spark.range(1500).select(
        F.lit("w").alias("table_name"),
        F.concat(F.lit("c"), "id").alias("column_name"),
        (F.col("id") + 1).cast("int").alias("ordinal"),
    )
    (listed,) = C.column_list(wide).collect()
    assert listed.column_list.split(", ") == [f"c{i}" for i in range(1500)]
    assert rules.describe_tables(wide).count() == 1
    facts = {"data_type": F.lit("int"), "null_ratio": F.lit(0.0), "is_unique": F.lit(True),
             "distinct_count": F.lit(1)}
    prompts = catalog_prompts(wide.withColumns(facts), local_frame(spark, [], "VIEWS"))
    (prompt,) = prompts.filter("kind = 'table'").collect()
    assert "c1499" in prompt.prompt and "c1000" in prompt.prompt


def test_one_constraint_name_on_two_tables(spark):
    place = "source string, table_schema string, "
    constraints = local_frame(
        spark,
        [("d", "s", "k", "a", "PRIMARY KEY"), ("d", "s", "k", "b", "FOREIGN KEY")],
        place + "constraint_name string, table_name string, constraint_type string",
    )
    usage = local_frame(
        spark,
        [("d", "s", "k", "a", "x", 1), ("d", "s", "k", "b", "y", 1)],
        place + "constraint_name string, table_name string, column_name string, ordinal_position int",
    )
    columns = local_frame(
        spark,
        [("d", "s", "a", "x", 1, "int", "NO"), ("d", "s", "b", "y", 1, "int", "NO")],
        place + "table_name string, column_name string, ordinal_position int, data_type string,"
        " is_nullable string",
    )
    flagged = C.columns_with_pk(columns, usage, constraints)
    assert rows(flagged, "table_name", "is_pk") == [("a", True), ("b", False)]


def test_composite_keys_are_paired_by_position_or_listed(spark):
    place = "source string, table_schema string, constraint_name string, "
    constraints = local_frame(
        spark, [("d", "s", "f", "FOREIGN KEY")], place + "constraint_type string"
    )
    child = [("d", "s", "f", "c", "x", 2), ("d", "s", "f", "c", "y", 1)]
    parent = [("d", "s", "f", "p", "m", 1), ("d", "s", "f", "p", "n", 2)]
    ddl = place + "table_name string, column_name string, "
    ends = ["source_column", "target_column"]
    usage = local_frame(spark, child, ddl + "position_in_unique_constraint int")
    paired = K.foreign_keys(constraints, usage, local_frame(spark, parent, ddl + "ordinal_position int"))
    assert rows(paired, *ends) == [("x", "n"), ("y", "m")]
    usage, other = usage.drop("position_in_unique_constraint"), local_frame(spark, parent, ddl + "q int")
    assert rows(K.foreign_keys(constraints, usage, other.drop("q")), *ends) == [("x, y", "m, n")]


def test_extracts_of_other_layouts(spark):
    described = local_frame(
        spark,
        [("t", 1, "id", "int", "NO", "PRI"), ("t", 2, "x", "text", "YES", None)],
        "table_name string, ordinal int, name string, type string, null string, key string",
    )
    got = rows(C.columns_from_describe(described), "column_name", "is_nullable", "is_pk")
    assert got == [("id", False, True), ("x", True, False)]
    views = local_frame(
        spark, [("s", "v", "select 1"), ("o", "w", None)],
        "table_schema string, table_name string, view_definition string",
    )
    assert rows(C.views_from_extract(views)) == [("v", "select 1"), ("w", "")]
    assert rows(C.views_from_extract(views, "o")) == [("w", "")]


@pytest.mark.parametrize(
    "child, parent",
    [("decimal(10,2)", "bigint"), ("decimal(10,2)", "decimal(12,4)"), ("double", "bigint"),
     ("double", "decimal(10,2)"), ("string", "bigint"), ("tinyint", "float")],
)
def test_keys_of_unlike_types_are_compared_by_value(spark, child, parent):
    numbers = spark.range(1, 11)
    tables = {
        "c": numbers.selectExpr(f"CAST(id AS {child}) AS k"),
        "p": numbers.selectExpr(f"CAST(id AS {parent}) AS k"),
    }
    assert fk_rows(tables, K.ForeignKey("c", ("k",), "p", ("k",))) == [(10, 0, 0, 0, 0.0)]


def test_days_are_found_among_times(spark):
    tables = {
        "c": spark.sql("SELECT DATE'2024-05-01' AS k UNION ALL SELECT DATE'2024-05-02'"),
        "p": spark.sql("SELECT TIMESTAMP'2024-05-01 00:00:00' AS k"),
    }
    assert fk_rows(tables, K.ForeignKey("c", ("k",), "p", ("k",))) == [(2, 0, 1, 1, 0.5)]


def test_list_columns_takes_comments(spark):
    frame = spark.range(1).withMetadata("id", {"comment": "the key"})
    assert rows(C.list_columns(frame, "t")) == [("t", "id", 1, "bigint", False, False, "the key")]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_equals_plain_join(spark, how):
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    )
    lookup = spark.range(0, 2000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    plain = left.join(lookup, "k", how)
    assert rows(lookup_join(left, lookup, ["k"], how), *plain.columns) == rows(plain)


def fk_rows(tables, *fks):
    result = K.fk_integrity(tables, list(fks))
    return rows(result, "child_rows", "null_keys", "orphan_rows", "orphan_keys", "orphan_ratio")


def test_integrity(spark):
    child = spark.createDataFrame(
        [(1, "1", 10), (1, "1", 11), (2, "2", 10), (None, None, 10), (9, "9", None)],
        "k int, text string, part int",
    )
    parent = spark.createDataFrame([(1, 10), (2, 12), (None, 10), (1, 11)], "id long, part int")
    tables = {"child": child, "parent": parent}
    single = K.ForeignKey("child", ("k",), "parent", ("id",))
    assert fk_rows(tables, single) == [(5, 1, 1, 1, 0.2)]
    as_text = K.ForeignKey("child", ("text",), "parent", ("id",))
    assert fk_rows(tables, as_text) == [(5, 1, 1, 1, 0.2)]
    pair = K.ForeignKey("child", ("k", "part"), "parent", ("id", "part"))
    assert fk_rows(tables, pair) == [(5, 2, 1, 1, 0.2)]
    assert len(fk_rows(tables, single, as_text, pair)) == 3
    empty = {"child": child.filter("k > 100"), "parent": parent}
    assert fk_rows(empty, single) == [(0, 0, 0, 0, 0.0)]


def test_integrity_with_a_hot_key(spark):
    child = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 100).alias("k")
    )
    tables = {"child": child, "parent": spark.range(100)}
    fk = K.ForeignKey("child", ("k",), "parent", ("id",))
    assert fk_rows(tables, fk) == [(9000, 0, 3000, 1, 0.33)]


def test_ambiguous_keys_are_listed(spark):
    ddl = "source string, table_schema string, constraint_name string, table_name string, column_name string"
    usage = spark.createDataFrame(
        [("d", "s", "fk", "a", "x"), ("d", "s", "fk", "b", "x"), ("d", "s", "own", "a", "y"), ("d", "t", "fk", "a", "x")], ddl
    )
    parents = spark.createDataFrame(
        [("d", "s", "fk", "p", "id"), ("d", "s", "own", "p", "id"), ("d", "t", "fk", "p", "id")], ddl
    )
    assert rows(K.ambiguous_keys(usage, parents)) == [("d", "s", "fk", 2)]
    named = parents.withColumn("constraint_table", F.lit("a"))
    assert rows(K.ambiguous_keys(usage, named)) == []
