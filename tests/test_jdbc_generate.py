import pytest
from pyspark.sql import functions as F

from lakedoc.functions.parents import direct_parents
from lakedoc.functions.text import basename, dirname, strip_fences, verdict
from lakedoc.operators.generate import generate, json_metadata, parse_yaml_metadata
from lakedoc.operators.rules import pii_by_name, run_tests, suggest_tags
from lakedoc.schemas import local_frame
from lakedoc.sources import jdbc
from tests.conftest import rows


@pytest.mark.parametrize(
    "kind, params, url, table",
    [
        ("postgres", {"dbname": "d"}, "jdbc:postgresql://localhost:5432/d", '"public"."t"'),
        ("postgres", {"dbname": "d", "host": "h", "port": 1, "schema": "s"}, "jdbc:postgresql://h:1/d", '"s"."t"'),
        ("mariadb", {"dbname": "d"}, "jdbc:mariadb://localhost:3306/d", "`d`.`t`"),
        ("mysql", {"dbname": "d", "host": "h"}, "jdbc:mysql://h:3306/d", "`d`.`t`"),
        ("snowflake", {"database": "d", "account": "a", "warehouse": "w"},
         "jdbc:snowflake://a.snowflakecomputing.com/?db=d&schema=public&warehouse=w", '"public"."t"'),
        ("sqlite", {"path": "/x.db"}, "jdbc:sqlite:/x.db", '"t"'),
        ("duckdb", {"path": "/x.duckdb"}, "jdbc:duckdb:/x.duckdb", '"t"'),
    ],
)
def test_connection_defaults(kind, params, url, table):
    options = jdbc.jdbc_options(kind, params | {"user": "u"}, "t")
    assert (options["url"], options["dbtable"], options["user"]) == (url, table, "u")
    assert ("duckdb.read_only" in options) == (kind == "duckdb")


@pytest.mark.parametrize(
    "kind, params", [("mysql", {}), ("snowflake", {"account": "a"}), ("sqlite", {}), ("duckdb", {}), ("oracle", {})]
)
def test_missing_parameters(kind, params):
    with pytest.raises(ValueError):
        jdbc.jdbc_options(kind, params, "t")


def test_partitioned_read():
    split = jdbc.Partitioning("id", 0, 1000, 8)
    options = jdbc.jdbc_options("postgres", {"dbname": "d"}, "t", split)
    assert options["partitionColumn"] == '"id"' and options["numPartitions"] == "8"


def test_pushed_profile_is_valid_sql():
    import duckdb

    connection = duckdb.connect()
    connection.execute("CREATE TABLE \"od'd\" AS SELECT * FROM (VALUES (1, 'a'), (2, NULL), (2, 'a')) v(x, \"y z\")")
    sql = jdbc.profile_query("duckdb", {"path": "x"}, "od'd", ["x", "y z"])
    assert sorted(connection.execute(sql).fetchall()) == [("od'd", "x", 3, 0, 2), ("od'd", "y z", 3, 1, 1)]


def test_generation_keeps_going_after_errors(spark):
    asked = local_frame(spark, [("one", 5), ("bad", 5), ("two", 7)], "prompt string, max_tokens int")

    def answer(prompt, budget):
        if prompt == "bad":
            raise RuntimeError("no answer")
        return f"\n {prompt}:{budget} \t"

    got = rows(generate(asked, answer, partitions=2), "prompt", "answer", "error")
    expected = [("bad", None, "RuntimeError: no answer"), ("one", "one:5", None), ("two", "two:7", None)]
    assert got == expected
    assert asked.columns == ["prompt", "max_tokens"]  # the input frame is left alone


def test_kept_answers_are_not_asked_for_again(spark, tmp_path):
    folder = str(tmp_path)

    def answer(prompt, budget):
        import os
        import uuid

        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        return prompt

    asked = local_frame(spark, [("a", 1), ("b", 1)], "prompt string, max_tokens int")
    kept = generate(asked, answer, keep=True)
    assert kept.count() == 2 and kept.filter("answer = 'a'").count() == 1
    assert len(list(tmp_path.iterdir())) == 2


YAML = "description: The email.\nmeta:\n  pii: true\ntags:\n  - user\n  - pii\ntests:\n  - unique\n  - accepted: [1]\n"


@pytest.mark.parametrize(
    "text, expected",
    [
        (YAML, ("The email.", {"pii": True}, ["user", "pii"], ["unique", '{"accepted": [1]}'])),
        ("  just words ", ("just words", None, None, None)),
        ("a: b: c", ("a: b: c", None, None, None)),
        ("- a\n- b", ("- a\n- b", None, None, None)),
        ("description: only", ("only", None, None, None)),
        ("tags: []", (None, None, [], None)),
        (None, (None, None, None, None)),
    ],
)
def test_generated_yaml(spark, text, expected):
    answers = local_frame(spark, [(text,)], "answer string")
    m = parse_yaml_metadata(answers).collect()[0].metadata
    assert (m.description, m.meta, m.tags, m.tests) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ('{"description": "d", "meta": {"pii": false}, "tags": ["t"]}', ("d", {"pii": False}, ["t"])),
        (" plain ", ("plain", None, None)),
        ("[1, 2]", ("[1, 2]", None, None)),
    ],
)
def test_generated_json(spark, text, expected):
    answers = local_frame(spark, [(text,)], "answer string")
    m = answers.select(json_metadata(F.col("answer")).alias("m")).collect()[0].m
    assert (m.description, m.meta, m.tags) == expected


def test_text_functions(spark):
    frame = spark.range(1).select(
        strip_fences(F.lit("```mermaid\ngraph TD;\n```\u2003\n")).alias("bare"),
        basename(F.lit("s3://b/x/y.sql")).alias("base"),
        dirname(F.lit("s3://b/x/y.sql")).alias("folder"),
        dirname(F.lit("y.sql")).alias("none"),
        verdict(F.lit("It looks like drift.")).alias("yes"),
        verdict(F.lit("match")).alias("no"),
    )
    assert rows(frame) == [("graph TD;", "y.sql", "s3://b/x", "", "DRIFT", "MATCH")]


def test_direct_parents(spark):
    sql = "{{ref('b')}} {{ ref( \"a\" ) }} {{ref('b')}} {{ source('s', \"t\") }} href('x')"
    got = spark.range(1).select(direct_parents(F.lit(sql)).alias("p")).collect()[0].p
    assert got == ["a", "b", "s.t"]


def test_names_and_tags(spark):
    columns = local_frame(
        spark, [("user_email",), ("p_name",), ("price",), ("id",)], "column_name string"
    )
    flagged = dict(rows(pii_by_name(columns)))
    assert flagged == {"user_email": True, "p_name": True, "price": False, "id": False}
    assert dict(rows(pii_by_name(columns, ("email",))))["p_name"] is False
    tags = dict(rows(suggest_tags(columns, [("price", "finance"), ("mail", "user")])))
    assert tags == {"user_email": ["pii", "user"], "p_name": ["pii"], "price": ["finance"], "id": []}


def test_declared_tests(spark):
    frame = spark.createDataFrame([(1, "a"), (1, None), (2, None), (3, "b")], "k int, v string")
    got = run_tests({"t": frame}, [("t", "k", "unique"), ("t", "v", "not_null"), ("t", "v", "unique"), ("t", "k", "not_null")])
    assert rows(got, "column_name", "test", "failures", "passed") == [
        ("k", "not_null", 0, True), ("k", "unique", 1, False),
        ("v", "not_null", 2, False), ("v", "unique", 0, True),
    ]


def test_generator_sees_slices_of_a_batch(spark):
    """Python holds few prompts as objects; a failed call spares the rest of its slice."""
    import gc

    def answer(prompt, budget):
        if prompt.endswith("7"):
            raise ValueError("no")
        return str(sum(type(o) is str and o.startswith("prompt number") for o in gc.get_referents(*[
            o for o in gc.get_objects() if type(o) is list
        ])))

    asked = spark.range(600).coalesce(1).selectExpr("id", "concat('prompt number ', id) AS prompt", "7 AS max_tokens")
    got = generate(asked.where("id < 300 OR id % 10 = 7"), answer).collect()
    assert [r.id for r in got] == [*range(300), *range(307, 600, 10)]
    assert all((r.answer is None) == (r.id % 10 == 7) == (r.error is not None) for r in got)
    assert max(int(r.answer) for r in got if r.answer) <= 64


def test_yaml_is_parsed_by_all_tasks(spark):
    answers = spark.range(400).coalesce(1).selectExpr("id", "concat('description: d', id) AS answer")
    parsed = parse_yaml_metadata(answers)
    assert rows(parsed.select("id", "metadata.description")) == sorted(((i, f"d{i}") for i in range(400)), key=repr)
    sizes = parsed.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and max(n for _, n in sizes) <= 110
