"""Manifests, documentation files and lineage."""

import json
import random

import pytest
from pyspark.errors import PySparkException

from lakedoc.operators import lineage as L
from lakedoc.operators import manifest as M
from lakedoc.operators import rules
from lakedoc.plans.generated import generated_verdicts
from lakedoc.plans.models import DocumentationError, build_lineage, document_models, gate
from lakedoc.schemas import local_frame
from lakedoc.sources.docfiles import scan_docs
from lakedoc.sources.manifests import scan_manifests
from tests.conftest import rows

MANIFEST = {
    "metadata": {"ignored": 1},
    "nodes": {
        "model.shop.customers": {
            "resource_type": "model",
            "name": "customers",
            "description": "",
            "config": {"description": "From the config", "materialized": "table"},
            "raw_code": "",
            "raw_sql": "select * from {{ ref('stg') }} join {{ source(\"raw\", 'people') }}",
            "path": "customers.sql",
            "original_file_path": "models/customers.sql",
            "depends_on": {"nodes": ["model.shop.stg", "source.shop.raw.people", "test.shop.t", "gone"]},
            "columns": {"z_id": {"name": "z_id", "description": "", "data_type": "int"}, "a": {}},
        },
        "model.shop.stg": {"resource_type": "model", "name": "stg", "depends_on": {"nodes": ["seed.shop.s"]}},
        "seed.shop.s": {"resource_type": "seed", "name": "s"},
        "test.shop.t": {"resource_type": "test", "name": "t"},
    },
    "sources": {
        "source.shop.raw.people": {"resource_type": "source", "source_name": "raw", "name": "people"}
    },
}


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    folder = tmp_path_factory.mktemp("project")
    (folder / "target").mkdir()
    (folder / "target" / "manifest.json").write_text(json.dumps(MANIFEST, indent=1))
    return folder


def test_manifest(spark, project):
    manifests = scan_manifests(spark, str(project))
    models = M.models_of(manifests)
    assert rows(models, "unique_id", "name", "description", "raw_sql") == [
        ("model.shop.customers", "customers", "From the config", MANIFEST["nodes"]["model.shop.customers"]["raw_sql"]),
        ("model.shop.stg", "stg", "", "-- SQL code not available --"),
    ]
    assert rows(M.model_columns(manifests), "model_name", "ordinal", "column_name", "description", "data_type") == [
        ("customers", 1, "z_id", "", "int"),
        ("customers", 2, "a", "", "N/A"),
    ]
    assert rows(M.model_deps(manifests), "model_name", "dependency", "dep_kind") == [
        ("customers", "raw.people", "source"),
        ("customers", "stg", "model"),
        ("stg", "s", "seed"),
    ]
    assert rows(M.parents_of(models)) == [("customers", "raw.people"), ("customers", "stg")]
    chart = dict(rows(M.model_charts(models), "name", "chart"))
    assert chart["customers"] == "graph TD;\n    raw.people --> customers\n    stg --> customers"
    assert chart["stg"] == "graph TD;"


def test_proposals_from_a_manifest(spark, project):
    facts = local_frame(
        spark,
        [("customers", "z_id", True, 0)],
        "table_name string, column_name string, is_unique boolean, null_count long",
    )
    got = document_models(scan_manifests(spark, str(project)), facts, [("id$", "key")])
    proposed = {(m, c, k): v for m, c, k, v, _, _ in rows(got)}
    assert {str(project)} == {p.removeprefix("file:") for (p,) in rows(got.select("project").distinct())}
    assert proposed["customers", "z_id", "tests"] == '["unique","not_null"]'
    assert proposed["customers", "z_id", "tags"] == '["key"]'
    assert ("customers", "a", "tests") not in proposed  # nothing to propose
    assert proposed["customers", None, "description"] == "customers is derived from raw.people, stg."


def test_missing_manifest(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="compile the project"):
        scan_manifests(spark, str(tmp_path))


def test_malformed_manifest(spark, project, tmp_path):
    (tmp_path / "target").mkdir()
    (tmp_path / "target" / "manifest.json").write_text('{"nodes": [1, 2')
    both = scan_manifests(spark, [str(project), str(tmp_path)])
    errors = [e for (e,) in rows(both, "error")]
    assert sum(e is None for e in errors) == 1
    assert any(e and str(tmp_path) in e for e in errors)
    assert M.models_of(both).count() == 2
    with pytest.raises(PySparkException, match="not a valid manifest"):
        scan_manifests(spark, str(tmp_path), strict=True).collect()


def test_documentation_files(spark, tmp_path):
    files = {
        "models/schema.yml": "version: 2\nmodels:\n  - name: customers\n    description: Old\n    columns:\n"
        "      - name: customer_id\n        tests: [unique, not_null]\n        meta: {pii: false}\n"
        "      - name: email\n        description:\n",
        "models/deep/er/more.yaml": "sources:\n  - name: raw\n",
        "models/dbt_project.yml": "models: [{name: hidden}]\n",
        "seeds/empty.yml": "",
        "models/notes.txt": "models: [{name: hidden}]\n",
        "other/x.yml": "models: [{name: hidden}]\n",
        "snapshots/s.yml": "snapshots:\n  - name: snap\n  - just text\n",
    }
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    docs = scan_docs(spark, str(tmp_path))
    assert rows(docs, "node_type", "model_name", "column_name", "doc_key", "doc_value") == [
        ("models", "customers", "customer_id", "meta", '{"pii": false}'),
        ("models", "customers", "customer_id", "name", "customer_id"),
        ("models", "customers", "customer_id", "tests", '["unique", "not_null"]'),
        ("models", "customers", "email", "description", None),
        ("models", "customers", "email", "name", "email"),
        ("models", "customers", None, "description", "Old"),
        ("models", "customers", None, "name", "customers"),
        ("snapshots", "snap", None, "name", "snap"),
        ("sources", "raw", None, "name", "raw"),
    ]
    (tmp_path / "models" / "odd.yml").write_text(
        "models:\n  - name: 2024\n    columns: [{name: no, description: 'false', tags: []}]\n"
    )
    odd = scan_docs(spark, str(tmp_path)).filter("file_path LIKE '%odd.yml'")
    assert rows(odd, "model_name", "column_name", "doc_key", "doc_value") == [
        ("2024", "false", "description", "false"),
        ("2024", "false", "name", "false"),
        ("2024", "false", "tags", None),
        ("2024", None, "name", "2024"),
    ]
    (tmp_path / "models" / "bad.yml").write_text("models: - name: customers\n   bad indent")
    with pytest.raises(PySparkException, match="bad.yml"):
        scan_docs(spark, str(tmp_path)).collect()
    lenient = scan_docs(spark, str(tmp_path), strict=False)
    assert [m for (m,) in rows(lenient.filter("doc_key = 'parse_error'"), "model_name")] == [None]
    assert lenient.filter("model_name = 'customers'").count() == 7


def test_a_source_that_both_maps_list_counts_once(spark, tmp_path):
    twice = json.loads(json.dumps(MANIFEST))
    twice["nodes"].update(twice["sources"])
    (tmp_path / "target").mkdir()
    (tmp_path / "target" / "manifest.json").write_text(json.dumps(twice))
    deps = rows(M.model_deps(scan_manifests(spark, str(tmp_path))), "dependency")
    assert deps.count(("raw.people",)) == 1


def test_failed_calls_are_no_match(spark):
    docs = local_frame(
        spark,
        [("models", "m", c, "description", f"the {c}", "f.yml") for c in ("good", "bad", "new")],
        "DOCS",
    )
    profile = local_frame(
        spark, [("m", "good", 0.0, True, 3), ("m", "bad", 0.0, True, 3)],
        "table_name string, column_name string, null_ratio double, is_unique boolean,"
        " distinct_count long",
    )

    def judge(prompt: str, budget: int) -> str:
        if "the bad" in prompt:
            raise TimeoutError("no answer")
        return "MATCH"

    verdicts = generated_verdicts(docs, profile, judge)
    assert rows(verdicts, "column_name", "verdict") == [
        ("bad", None), ("good", "MATCH"), ("new", "MATCH")
    ]
    with pytest.raises(DocumentationError, match="no answer"):
        gate(verdicts)
    gate(verdicts.filter("column_name <> 'bad'"))


FKS = [("visits", "pet_id", "pets", "id"), ("pets", "owner_id", "owners", "id")]
DEPS = [
    ("bills", "visits", "model"),
    ("bills", "prices", "seed"),
    ("visits", "clinic.calendar", "source"),
]
NODES = {
    "owners": "db",
    "pets": "db",
    "clinic.calendar": "source",
    "prices": "box",
    "visits": "box",
    "bills": "box",
}


@pytest.mark.parametrize("seed", range(3))
def test_lineage(spark, seed):
    rng = random.Random(seed)
    fks, deps = FKS * 2, DEPS * 2
    rng.shuffle(deps)
    models = [("bills",), ("visits",)]
    rng.shuffle(models)
    nodes, edges, lines = build_lineage(
        local_frame(spark, fks, "FKS"),
        local_frame(spark, models, "name string"),
        local_frame(spark, deps, "MODEL_DEPS"),
    )
    assert dict(rows(nodes, "id", "style")) == NODES
    plain = sorted((f"{parent}-{model}", parent, model, "") for model, parent, _ in DEPS)
    keys = [(f"{a}-{b}-FK", a, b, "FK") for a, _, b, _ in FKS]
    assert rows(edges) == sorted([*plain, *keys])
    text = [r.line for r in lines.orderBy("section", "part", "ordinal").collect()]
    shapes = {"db": '[("{0}")]', "source": '(("{0}"))', "box": '["{0}"]'}
    shown = [f"    {n}" + shapes[NODES[n]].format(n) for n in sorted(NODES)]
    arrows = [
        f'    {a} -- "FK" --> {b}' if label else f"    {a} --> {b}"
        for _, a, b, label in sorted([*plain, *keys])
    ]
    assert text == ["graph TD;", *shown, "", *arrows]
    records = {(k, json.loads(j)["id"]): json.loads(j) for k, _, j in rows(L.lineage_json(nodes, edges))}
    assert records["node", "pets"] == {"id": "pets", "data": {"label": "pets"}, "type": "db"}
    assert records["edge", "visits-pets-FK"]["label"] == "FK"


def test_views_are_described_by_their_parents(spark):
    views = local_frame(spark, [("v", "select 1")], "VIEWS")
    assert rows(rules.describe_views(views), "view_name", "summary") == [("v", "v has no direct parents.")]
