"""Projects with models of one name stay apart, from the manifest to filled files and lineage."""

import json

from pyspark.sql import functions as F

from lakedoc.functions.identity import qualified_id
from lakedoc.operators import docs as D
from lakedoc.operators import lineage as L
from lakedoc.operators.manifest import model_columns, models_of
from lakedoc.plans.generated import generated_proposals
from lakedoc.plans.models import document_models, lineage_of_project, model_drift, qualified_lineage
from lakedoc.schemas import local_frame
from lakedoc.sources.manifests import parse_manifests, scan_manifests
from tests.conftest import rows


def project(folder, *columns, parent="raw"):
    def node(name, parents=(), **declared):
        return {
            "resource_type": "model", "name": name, "original_file_path": f"models/{name}.sql",
            "raw_code": f"select 1 from {{{{ ref('{parent}') }}}}", "depends_on": {"nodes": list(parents)},
            "columns": {c: {"name": c, "description": d} for c, d in declared.items()},
        }

    nodes = {
        "model.x.orders": node("orders", ["model.x.raw"], **dict(columns)),
        "model.x.raw": node("raw"),
    }
    (folder / "target").mkdir(parents=True)
    (folder / "target" / "manifest.json").write_text(json.dumps({"nodes": nodes, "sources": {}}))
    return str(folder)


def both(spark, tmp_path):
    a = project(tmp_path / "a", ("id", ""), ("total", "Said."))
    b = project(tmp_path / "b", ("id", ""), ("total", ""))
    manifests = scan_manifests(spark, [a, b])
    return manifests.withColumn("manifest_path", F.regexp_replace("manifest_path", "^file:", "")), a, b


def listed(spark, a, b):
    rows_ = [
        ("models", "orders", column, "name" if column else "description", None, f"{p}/models/schema.yml")
        for p in (a, b)
        for column in (None, "id", "total")
    ]
    return local_frame(spark, rows_, "DOCS")


def test_from_manifest_to_filled_files(spark, tmp_path):
    manifests, a, b = both(spark, tmp_path)
    docs = D.docs_of_projects(listed(spark, a, b), manifests)
    assert rows(docs.select("project").distinct()) == [(a,), (b,)]
    profile = local_frame(
        spark,
        [(a, "orders", "id", True, 0), (b, "orders", "id", False, 7)],
        "project string, table_name string, column_name string, is_unique boolean, null_count long",
    )
    wanted = document_models(manifests, profile)
    filled = D.fill_docs(docs, wanted).filter("changed")
    found = {(r.project, r.column_name, r.doc_key): r.doc_value for r in filled.collect()}
    assert {r.file_path for r in filled.collect()} == {f"{p}/models/schema.yml" for p in (a, b)}
    assert found[a, "id", "tests"] == '["unique","not_null"]' and (b, "id", "tests") not in found
    assert (b, "total", "description") in found and (a, "total", "description") not in found
    assert {p for p, column, _ in found if column is None} == {a, b}
    # what is filled in one project does not settle the other
    only_a = filled.where(F.col("project") == a)
    missing = D.check_docs(docs.where(F.col("project") == a).unionByName(only_a.drop("changed")), wanted)
    assert {r.project for r in missing.where("finding = 'missing_model'").collect()} == {a, b}
    models = rows(D.models_to_create(wanted, docs))
    assert models == [(a, "raw"), (b, "raw")]
    stubs = D.doc_stubs(wanted, docs)
    assert rows(stubs.select("project", "model_name").distinct()) == models
    skip = local_frame(spark, [("orders", "id", "description", "skip", None)], "DECISIONS").withColumn("project", F.lit(a))
    reviewed = D.review(wanted, skip).where("column_name = 'id' AND doc_key = 'description'")
    assert rows(reviewed, "project") == [(b,)]
    # without projects the names decide, as before
    merged = D.fill_docs(docs.drop("project"), wanted).filter("changed")
    assert {r.file_path for r in merged.collect()} == {f"{b}/models/schema.yml"}


def test_drift_by_project(spark, tmp_path):
    manifests, a, b = both(spark, tmp_path)
    profile = local_frame(
        spark,
        [(p, "orders", "total", False, 3) for p in (a, b)],
        "project string, table_name string, column_name string, is_unique boolean, distinct_count long",
    )
    assert rows(model_drift(manifests, profile), "manifest_path", "column_name") == [
        (f"{a}/target/manifest.json", "total")
    ]


def test_files_belong_to_the_innermost_project(spark):
    manifests = local_frame(
        spark, [("/w/target/manifest.json",), ("/w/in/ner/target/manifest.json",)], "manifest_path string"
    )
    files = ["/w/a.yml", "/w/in/b.yml", "/w/in/ner/m/c.yml", "/wider/d.yml", "e.yml"]
    docs = local_frame(spark, [("models", "m", None, "name", "m", file) for file in files], "DOCS")
    assert rows(D.docs_of_projects(docs, manifests), "file_path", "project") == [
        ("/w/a.yml", "/w"), ("/w/in/b.yml", "/w"), ("/w/in/ner/m/c.yml", "/w/in/ner"),
        ("/wider/d.yml", None), ("e.yml", None),
    ]


def test_failed_calls_tell_what_was_asked(spark, tmp_path):
    manifests, a, b = both(spark, tmp_path)

    def fail(prompt, budget):
        raise RuntimeError("no answer")

    proposals, charts = generated_proposals(models_of(manifests), model_columns(manifests), fail)
    assert rows(proposals) == []
    asked = rows(charts, "project", "kind", "name", "column_name")
    assert (a, "column_metadata", "orders", "id") in asked and (b, "model", "orders", None) in asked
    assert (a, "column_metadata", "orders", "total") not in asked  # described already


def test_lineage_keeps_origins_apart(spark, tmp_path):
    manifests, a, b = both(spark, tmp_path)
    fks = local_frame(
        spark,
        [("db1", "orders", "c", "users", "id"), ("db2", "orders", "c", "users", "id"), ("db1", "orders", "d", "users", "id")],
        "source string, source_table string, source_column string, target_table string, target_column string",
    )
    nodes, edges, lines = qualified_lineage(fks, manifests)
    assert rows(nodes, "label", "style", "origin") == sorted(
        [(n, "box", p) for p in (a, b) for n in ("orders", "raw")]
        + [(n, "db", d) for d in ("db1", "db2") for n in ("orders", "users")],
        key=repr,
    )
    assert edges.count() == 4 and edges.select("id").distinct().count() == 4
    ids = {r.id for r in nodes.collect()}
    assert all({r.source, r.target} <= ids for r in edges.collect())
    drawn = [line for (line,) in rows(lines, "line")]
    assert sum('("orders")' in line for line in drawn) == 2 and sum('["orders"]' in line for line in drawn) == 2
    # by names alone they are one
    merged = lineage_of_project(fks, manifests)[0]
    assert rows(merged, "id") == [("orders",), ("raw",), ("users",)]


def test_edges_whose_names_run_together_have_ids_of_their_own(spark):
    fks = local_frame(
        spark, [("a", "x", "b-c", "y"), ("a-b", "x", "c", "y")],
        "source_table string, source_column string, target_table string, target_column string",
    )
    deps = local_frame(
        spark, [], "manifest_path string, model_name string, dependency string, dep_kind string"
    )
    assert L.qualified_edges(fks, deps).select("id").distinct().count() == 2
    pairs = spark.createDataFrame([("a", "b-c"), ("a-b", "c"), ("a", None), (None, "a")], "x string, y string")
    assert pairs.select(qualified_id(F.col("x"), F.col("y"))).distinct().count() == 4


def test_lineage_parses_manifests_once(spark):
    """What nodes and edges are made of is stored: neither plan holds the parser."""
    value = json.dumps({"nodes": {
        "model.p.a": {"resource_type": "model", "name": "a", "depends_on": {"nodes": ["seed.p.s", "x.p.gone"]}},
        "seed.p.s": {"resource_type": "seed", "name": "s"}, "model.p.none": None,
    }, "sources": {"source.p.q": {"resource_type": "source", "source_name": "raw", "name": "q"}}})
    texts = spark.createDataFrame([("m1", value), ("m2", "{"), ("m3", "{}")], "manifest_path string, value string")
    fks = spark.createDataFrame([("t", "k", "u", "k")], "source_table string, source_column string, target_table string, target_column string")
    for lineage in (qualified_lineage, lineage_of_project):
        nodes, edges, _ = lineage(fks, parse_manifests(texts))
        assert rows(nodes, "label", "style") == [("a", "box"), ("s", "box"), ("t", "db"), ("u", "db")]
        assert edges.count() == 2
        for frame in (nodes, edges):
            assert "from_json" not in frame._jdf.queryExecution().optimizedPlan().toString()
