import pytest

from lakedoc.operators import docs as D
from lakedoc.operators.rules import drift_verdicts
from lakedoc.plans.models import DocumentationError, gate, write_gated
from lakedoc.schemas import local_frame
from tests.conftest import rows

FILE = "models/schema.yml"


def docs(spark, *entries):
    """(model, column, key, value[, file[, node type]])"""
    full = [(*e, *(FILE, "models")[len(e) - 4 :]) for e in entries]
    return local_frame(spark, [(e[5], *e[:4], e[4]) for e in full], "DOCS")


def proposals(spark, *entries):
    """(model, column, key, value[, path])"""
    full = [(*e, "models/x.sql")[:5] for e in entries]
    return local_frame(spark, full, "PROPOSALS")


@pytest.fixture(scope="module")
def listed(spark):
    return docs(
        spark,
        ("customers", None, "name", "customers"),
        ("customers", "customer_id", "name", "customer_id"),
        ("customers", "customer_id", "tests", '["unique", "not_null"]'),
    )


@pytest.fixture(scope="module")
def wanted(spark):
    return proposals(
        spark,
        ("customers", None, "description", "All customers."),
        ("customers", "customer_id", "description", "The key."),
        ("customers", "customer_id", "tests", '["not_null"]'),
        ("customers", "unlisted", "description", "A column the file does not list."),
    )


def values(filled):
    return {
        (r.model_name, r.column_name, r.doc_key): (r.doc_value, r.changed)
        for r in filled.collect()
        if r.doc_key != "name"
    }


def test_fill_adds_blank_keys_and_keeps_others(listed, wanted):
    assert values(D.fill_docs(listed, wanted)) == {
        ("customers", None, "description"): ("All customers.", True),
        ("customers", "customer_id", "description"): ("The key.", True),
        ("customers", "customer_id", "tests"): ('["unique", "not_null"]', False),
    }


def test_existing_text_is_never_overwritten(spark, wanted):
    kept = docs(
        spark,
        ("customers", None, "description", "An older text."),
        ("customers", "customer_id", "description", "  "),
    )
    assert values(D.fill_docs(kept, wanted)) == {
        ("customers", None, "description"): ("An older text.", False),
        ("customers", "customer_id", "description"): ("The key.", True),
        ("customers", "customer_id", "tests"): ('["not_null"]', True),
    }


@pytest.mark.parametrize("text", ["false", "null", "[]", "{}", "0"])
def test_texts_that_look_empty_are_kept(spark, text):
    merged = D.fill_docs(
        docs(spark, ("m", "c", "description", text)), proposals(spark, ("m", "c", "description", "x"))
    )
    assert text in [v for (v,) in rows(merged, "doc_value")]


@pytest.mark.parametrize("blank", [None, "", " "])
def test_blank_values(spark, blank):
    filled = D.fill_docs(
        docs(spark, ("m", "c", "tests", blank)), proposals(spark, ("m", "c", "tests", "[1]"))
    )
    assert values(filled) == {("m", "c", "tests"): ("[1]", True)}
    unchanged = D.fill_docs(
        docs(spark, ("m", "c", "tests", "old")), proposals(spark, ("m", "c", "tests", blank))
    )
    assert values(unchanged) == {("m", "c", "tests"): ("old", False)}


def test_only_the_greatest_path_and_only_models_are_filled(spark, wanted):
    twice = docs(
        spark,
        ("customers", None, "description", "", "models/a.yml"),
        ("customers", None, "description", "", "models/b.yml"),
        ("raw", None, "description", "", "models/a.yml", "sources"),
    )
    more = wanted.unionByName(proposals(spark, ("raw", None, "description", "Raw.")))
    filled = D.fill_docs(twice, more)
    assert rows(filled.filter("changed"), "model_name", "file_path") == [("customers", "models/b.yml")]
    # A documented source is documented: no stub for it.
    assert rows(D.models_to_create(more, twice)) == []
    assert rows(D.models_to_update(more, twice)) == [("customers",), ("raw",)]


def test_check_writes_nothing_and_fill_settles_it(listed, wanted):
    findings = D.check_docs(listed, wanted)
    assert rows(findings) == [
        ("customers", "customer_id", "description", "missing_value"),
        ("customers", None, "description", "missing_value"),
    ]
    filled = D.fill_docs(listed, wanted).drop("changed")
    assert D.check_docs(filled, wanted).isEmpty()
    assert rows(D.fill_docs(filled, wanted).drop("changed")) == rows(filled)


def test_check_reports_undocumented_models_once(spark, listed):
    new = proposals(spark, ("new", None, "description", "x"), ("new", "c", "description", "y"))
    assert rows(D.check_docs(listed, new)) == [("new", None, None, "missing_model")]


def test_blank_proposals_are_no_finding(spark, listed):
    assert D.check_docs(listed, proposals(spark, ("customers", None, "description", None))).isEmpty()


def test_gate(spark, listed, wanted):
    with pytest.raises(DocumentationError, match="2 x missing_value"):
        gate(D.check_docs(listed, wanted))
    gate(D.check_docs(D.fill_docs(listed, wanted).drop("changed"), wanted))


def test_gated_write_counts_while_it_writes(spark, tmp_path, listed, wanted):
    path = str(tmp_path / "findings")
    findings = D.check_docs(listed, wanted)
    findings.write.parquet(str(tmp_path / "stored"))
    stored = spark.read.parquet(str(tmp_path / "stored"))
    spark.sparkContext.setJobGroup("gated", "")
    try:
        with pytest.raises(DocumentationError, match="^2 x missing_value$"):
            write_gated(stored, path)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("gated")) == 1
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert rows(spark.read.parquet(path)) == rows(findings)
    write_gated(findings.limit(0), path)
    assert spark.read.parquet(path).count() == 0
    odd = local_frame(spark, [("m", "odd", None), ("m", None, "timeout"), ("m", "drift", None)], "model_name string, finding string, error string")
    with pytest.raises(DocumentationError, match="timeout"):
        write_gated(odd, path)
    with pytest.raises(DocumentationError, match="^1 x drift, 1 x other$"):
        write_gated(odd.drop("error"), path)


def test_stubs_append_create_or_nothing(spark, listed):
    new = proposals(
        spark,
        ("new_model", None, "description", "New.", "models/new_model.sql"),
        ("new_model", "new_id", "tests", None, "models/new_model.sql"),
        ("stg_orders", "order_id", "description", "Id.", "models/staging/stg_orders.sql"),
        ("top", None, "description", "Top.", "top.sql"),
        ("nowhere", None, "description", "No path.", None),
        ("customers", None, "description", "Known."),
    )
    assert rows(D.doc_stubs(new, listed)) == [
        ("models/schema.yml", "append", "new_model", "new_id", "tests", None),
        ("models/schema.yml", "append", "new_model", None, "description", "New."),
        ("models/staging/schema.yml", "create", "stg_orders", "order_id", "description", "Id."),
        ("schema.yml", "create", "top", None, "description", "Top."),
    ]


def test_review(spark, listed, wanted):
    def decided(*entries):
        frame = local_frame(spark, list(entries), "DECISIONS")
        return values(D.apply_review(listed, wanted, frame))

    model, column = ("customers", None, "description"), ("customers", "customer_id", "description")
    assert decided()[column] == ("The key.", True)
    assert decided((*column, "accept", None))[column] == ("The key.", True)
    assert decided((*column, "edit", "Better."))[column] == ("Better.", True)
    assert column not in decided((*column, "skip", None))
    assert column not in decided((*column, "edit", "S"))
    assert decided((*column, "skip", None))[model] == ("All customers.", True)


def test_plan(spark):
    columns = local_frame(
        spark,
        [("m", "a", ""), ("m", "b", "text"), ("m", "c", None)],
        "model_name string, column_name string, description string",
    )
    assert rows(D.plan_columns(columns, True), "column_name", "action") == [
        ("a", "propose"), ("b", "verify"), ("c", "propose"),
    ]
    assert rows(D.plan_columns(columns, False).filter("action = 'none'"), "column_name") == [("b",)]


PROFILE = "table_name string, column_name string, is_unique boolean, distinct_count long"


@pytest.mark.parametrize(
    "text, unique, distinct, verdict",
    [
        ("Unique ID for the customer", True, 100, "MATCH"),
        ("Unique ID for the customer", False, 10, "DRIFT"),
        ("Status is A or B", False, 2, "MATCH"),
        ("Status is A or B", False, 100000, "DRIFT"),
        ("Something about it", False, 100000, "MATCH"),
        ("Unique ID", None, None, "MATCH"),
    ],
)
def test_drift(spark, text, unique, distinct, verdict):
    described = docs(spark, ("m", "c", "description", text), ("m", None, "description", "unique"))
    profile = local_frame(spark, [("m", "c", unique, distinct)], PROFILE)
    verdicts = drift_verdicts(described, profile)
    assert rows(verdicts, "model_name", "column_name", "verdict") == [("m", "c", verdict)]
    findings = D.drift_findings(described, verdicts)
    expected = [("m", "c", "description", "drift")] if verdict == "DRIFT" else []
    assert rows(findings) == expected
    assert rows(D.is_outdated(findings)) == [(bool(expected),)]


def test_coverage(spark):
    columns = local_frame(spark, [("t", "a"), ("t", "b"), ("t", "c"), ("u", "a")], "table_name string, column_name string")
    known = docs(spark, ("t", "a", "description", "x"), ("t", "b", "description", ""), ("t", "a", "description", "x", "z.yml"))
    assert rows(D.coverage(known, columns)) == [("t", 3, 1, 0.33), ("u", 1, 0, 0.0)]
