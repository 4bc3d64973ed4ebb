"""Profiles, keys, rules on profiles, and whole catalogs of the given tables."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakedoc.functions.formats import MAX_TOKENS
from lakedoc.functions.text import profile_text
from lakedoc.operators import profile as P
from lakedoc.operators import rules
from lakedoc.operators.columns import list_all_columns
from lakedoc.operators.docs import is_outdated
from lakedoc.operators.inclusion import fk_candidates
from lakedoc.operators.keys import ForeignKey, fk_integrity
from lakedoc.operators.lattice import composite_keys
from lakedoc.operators.render import assemble_catalog
from lakedoc.plans.catalog import build_catalog
from lakedoc.plans.generated import generated_catalog
from lakedoc.plans.increments import profile_from_path, sketch_to_path
from lakedoc.schemas import local_frame
from lakedoc.sinks.durable import shared_folder
from lakedoc.sources.files import list_datasets, scan_files

from .base import TABLES, Tables, names_of, profile_sql, query, table_profile_sql, types_of

# A joined frame with missing values: not every document has labels.
LABELLED_SQL = "(SELECT doc_id, lang, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"
GAPPY_SQL = (
    "(SELECT o_orderkey, o_custkey, nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders)"
)


def labelled(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", "lang", "source", "quality", "toxic"
    )


def gappy(t: Tables) -> DataFrame:
    priority = F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority")
    return t.orders.select("o_orderkey", "o_custkey", priority)


NULLABLE = [
    *[("labelled", c, LABELLED_SQL) for c in ("doc_id", "lang", "source", "quality", "toxic")],
    *[("gappy", c, GAPPY_SQL) for c in ("o_orderkey", "o_custkey", "o_orderpriority")],
]
NULLABLE_SQL = profile_sql(NULLABLE)


def nullable_profile(t: Tables) -> DataFrame:
    return P.profile_database({"labelled": labelled(t), "gappy": gappy(t)})


@query("profile_column", f"SELECT * FROM {profile_sql([('orders', 'o_custkey', 'orders')])}")
def profile_column(t):
    return P.profile_column(t.orders, "o_custkey", "orders")


@query("profile_table", f"SELECT * FROM {table_profile_sql('lineitem')}")
def profile_lineitem(t):
    return P.profile_table(t.lineitem, "lineitem")


@query("profile_orders", f"SELECT * FROM {table_profile_sql('orders')}")
def profile_orders(t):
    return P.profile_table(t.orders, "orders")


@query("profile_events", f"SELECT * FROM {table_profile_sql('events')}")
def profile_events(t):
    return P.profile_table(t.events, "events")


@query("profile_one_scan", f"SELECT * FROM {table_profile_sql('orders')}")
def profile_one_scan(t):
    return P.profile_table(t.orders, "orders", one_scan=True)


@query("profile_nullable", f"SELECT * FROM {NULLABLE_SQL}")
def profile_nullable(t):
    return nullable_profile(t)


@query("profile_database", f"SELECT * FROM {table_profile_sql(*TABLES)}")
def profile_database(t):
    return P.profile_database(t.all())


EMPTY_SQL = "(SELECT * FROM orders WHERE o_totalprice < 0)"


@query(
    "profile_empty",
    f"SELECT * FROM {profile_sql([('orders', c, EMPTY_SQL) for c in names_of('orders')])}",
)
def profile_empty(t):
    return P.profile_table(t.orders.filter("o_totalprice < 0"), "orders")


@query(
    "profile_missing_column",
    f"SELECT * FROM {profile_sql([('orders', 'o_orderkey', 'orders')])} UNION ALL SELECT"
    " 'orders', 'no_such_column', NULL, NULL, NULL, NULL, NULL, 'failed'",
)
def profile_missing_column(t):
    return P.profile_table(t.orders, "orders", ["o_orderkey", "no_such_column"])


_NUMBERS = {"o_orderkey", "o_custkey", "o_totalprice"}
_EXTENDED = " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS column_name, min({c})::VARCHAR AS min_value,"
    f" max({c})::VARCHAR AS max_value,"
    f" {f'round(avg({c}::DOUBLE), 4)' if c in _NUMBERS else 'NULL::DOUBLE'} AS avg_value FROM orders)"
    for c in names_of("orders")
)


@query(
    "profile_extended",
    f"SELECT p.*, min_value, max_value, avg_value FROM {table_profile_sql('orders')} p"
    f" JOIN ({_EXTENDED}) x USING (column_name)",
)
def profile_extended(t):
    result = P.profile_table(t.orders, "orders", extended=True)
    return result.withColumn("avg_value", F.round("avg_value", 4))


@query(
    "profile_documented",
    f"SELECT * FROM {profile_sql([('part', c, 'part') for c in ('p_name', 'p_brand', 'p_size')])}",
)
def profile_documented(t):
    return P.profile_columns(t.part, "part", ["p_name", "p_brand", "p_size"])


# The sketched distinct count itself differs by design; all else is exact.
@query(
    "profile_approx",
    "SELECT table_name, column_name, total_count, null_count, null_ratio, is_unique, profile_status"
    f" FROM {table_profile_sql('orders', 'customer', 'part', 'lineitem')}",
)
def profile_approx(t):
    names = ("orders", "customer", "part", "lineitem")
    return P.profile_database({n: getattr(t, n) for n in names}, approx=0.05).drop("distinct_count")


@query(
    "profile_increments",
    "SELECT table_name, column_name, total_count, null_count, null_ratio, distinct_count AS exact_count,"
    " TRUE AS within_bounds, (SELECT count(DISTINCT year(o_orderdate)) FROM orders) AS parts"
    f" FROM {table_profile_sql('orders')}",
)
def profile_increments(t):
    """Orders by year: the first years are sketched, then the table grows to all of them."""
    store = shared_folder(t.spark, "sketches")
    year = F.year("o_orderdate")
    middle = t.orders.agg(F.median(year)).first()[0]
    first = sketch_to_path(t.orders.where(year <= middle), "orders", year, store)
    then = sketch_to_path(t.orders, "orders", year, store)
    if set(first) & set(then):
        raise AssertionError("a part was read twice")
    exact = P.profile_table(t.orders, "orders").select("column_name", F.col("distinct_count").alias("exact_count"))
    # one row per column on both sides
    found = profile_from_path(t.spark, store).join(F.broadcast(exact), "column_name")
    within = F.col("exact_count").between(F.col("distinct_low"), F.col("distinct_high"))
    return found.select(
        "table_name", "column_name", "total_count", "null_count", "null_ratio", "exact_count",
        within.alias("within_bounds"), "parts",
    )


@query(
    "candidate_keys",
    f"SELECT table_name, column_name FROM {table_profile_sql(*TABLES)} WHERE is_unique",
)
def candidate_keys(t):
    return P.candidate_keys(P.profile_database(t.all()))


def _composite_sql(table: str, *columns: str) -> str:
    some_null = " OR ".join(f"{c} IS NULL" for c in columns)
    packed = f"CASE WHEN NOT ({some_null}) THEN row({', '.join(columns)}) END"
    return (
        "SELECT *, (distinct_count = total_count AND null_count = 0) AS is_key FROM (SELECT"
        f" '{table}' AS table_name, '{', '.join(columns)}' AS column_names,"
        " count(*)::BIGINT AS total_count,"
        f" count(CASE WHEN {some_null} THEN 1 END)::BIGINT AS null_count,"
        f" count(DISTINCT {packed})::BIGINT AS distinct_count FROM {table})"
    )


@query(
    "composite_key",
    _composite_sql("lineitem", "l_orderkey", "l_linenumber")
    + " UNION ALL "
    + _composite_sql("conversations", "conv_id", "turn"),
)
def composite_key(t):
    lines = P.is_composite_key(t.lineitem, ["l_orderkey", "l_linenumber"], "lineitem")
    return lines.unionByName(
        P.is_composite_key(t.conversations, ["conv_id", "turn"], "conversations")
    )


def _keys_sql(table: str, most: int = 3) -> str:
    """All minimal keys of up to ``most`` columns, every set counted."""
    sets = [some for n in range(1, most + 1) for some in combinations(names_of(table), n)]
    counted = " UNION ALL ".join(
        f"SELECT {i} AS i, count(*) > 0 AND count(*) = count(DISTINCT row({', '.join(some)}))"
        f" AND {' AND '.join(f'count(*) = count({c})' for c in some)} AS is_key FROM {table}"
        for i, some in enumerate(sets)
    )
    lists = ", ".join(f"({i}, {list(some)!r}, '{', '.join(some)}')" for i, some in enumerate(sets))
    return (
        f"SELECT '{table}' AS table_name, s.names AS column_names, len(s.cols)::INT AS n_columns"
        f" FROM ({counted}) c JOIN (VALUES {lists}) s(i, cols, names) USING (i) WHERE is_key AND"
        f" NOT EXISTS (SELECT 1 FROM ({counted}) d JOIN (VALUES {lists}) p(i, cols, names) USING (i)"
        " WHERE d.is_key AND len(p.cols) < len(s.cols) AND list_has_all(s.cols, p.cols))"
    )


KEYED = ("lineitem", "orders", "events", "conversations", "nation")


@query("composite_keys", " UNION ALL ".join(map(_keys_sql, KEYED)))
def find_composite_keys(t):
    found = [composite_keys(getattr(t, name), name) for name in KEYED]
    return reduce(lambda a, b: a.unionByName(b), found)


FKS = [
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("labels", "doc_id", "documents", "doc_id"),
    ("orders", "o_custkey", "builders", "c_custkey"),  # only some customers: orphans
    ("documents", "doc_id", "labels", "doc_id"),
    ("lineitem", "l_orderkey", "orders_decimal", "o_orderkey"),  # unlike types
    ("lineitem", "l_partkey", "part_double", "p_partkey"),
    ("days", "day", "orders", "o_orderdate"),
    ("order_texts", "o_orderkey", "orders", "o_orderkey"),  # '01' is 1, and 'x7' no number
    ("lines_far", "l_orderkey", "orders_wide", "o_orderkey"),  # beyond doubles and 38 digits
]
_OTHER_TYPES = {
    "orders_decimal": "(SELECT o_orderkey::DECIMAL(20, 2) AS o_orderkey FROM orders)",
    "part_double": "(SELECT p_partkey::DOUBLE AS p_partkey FROM part)",
    "days": "(SELECT l_shipdate::DATE AS day FROM lineitem)",
    # a text that is no number stands for a key of its own
    "order_texts": "(SELECT if(l_orderkey % 7 = 0, -1 - l_orderkey, l_orderkey) AS o_orderkey FROM lineitem)",
    "lines_far": "(SELECT l_orderkey + 9007199254740992 AS l_orderkey FROM lineitem)",
    "orders_wide": "(SELECT 2 * o_orderkey + 9007199254740992 AS o_orderkey FROM orders)",
}
_BUILDERS = "(SELECT * FROM customer WHERE c_mktsegment = 'BUILDING')"


def _integrity_sql(child: str, column: str, parent: str, key: str) -> str:
    target = _BUILDERS if parent == "builders" else _OTHER_TYPES.get(parent, parent)
    source = _OTHER_TYPES.get(child, child)
    return (
        f"SELECT '{child}' AS source_table, '{column}' AS source_column,"
        f" '{parent}' AS target_table, '{key}' AS target_column,"
        f" count(*)::BIGINT AS child_rows, count(CASE WHEN k IS NULL THEN 1 END)::BIGINT AS null_keys,"
        " count(CASE WHEN k IS NOT NULL AND NOT found THEN 1 END)::BIGINT AS orphan_rows,"
        " count(DISTINCT CASE WHEN NOT found THEN k END)::BIGINT AS orphan_keys"
        f" FROM (SELECT q.{column} AS k, p.x IS NOT NULL AS found FROM {source} q LEFT JOIN"
        f" (SELECT DISTINCT {key} AS x FROM {target}) p ON q.{column} = p.x)"
    )


def _with_ratio(sql: str) -> str:
    from .base import ratio_sql

    return f"SELECT *, {ratio_sql('orphan_rows', 'child_rows')} AS orphan_ratio FROM ({sql})"


@query("fk_integrity", _with_ratio(" UNION ALL ".join(_integrity_sql(*fk) for fk in FKS)))
def run_fk_integrity(t):
    tables = t.all() | {
        "builders": t.customer.filter("c_mktsegment = 'BUILDING'"),
        "orders_decimal": t.orders.selectExpr("CAST(o_orderkey AS DECIMAL(20, 2)) AS o_orderkey"),
        "part_double": t.part.selectExpr("CAST(p_partkey AS DOUBLE) AS p_partkey"),
        "days": t.lineitem.selectExpr("CAST(l_shipdate AS DATE) AS day"),
        "order_texts": t.lineitem.selectExpr(
            "concat(if(l_orderkey % 7 = 0, 'x', '0'), l_orderkey) AS o_orderkey"
        ),
        "lines_far": t.lineitem.selectExpr("l_orderkey + 9007199254740992 AS l_orderkey"),
        "orders_wide": t.orders.selectExpr(
            "CAST(2 * o_orderkey + 9007199254740992 AS DECIMAL(38, 20)) AS o_orderkey"
        ),
    }
    return fk_integrity(tables, [ForeignKey(a, (b,), c, (d,)) for a, b, c, d in FKS])


# How SQL brings a column to the domain in which columns are compared.
_DOMAINS = {
    "int": ("number", "({c}::DOUBLE + 0.0)"),
    "bigint": ("number", "({c}::DOUBLE + 0.0)"),
    "double": ("number", "({c} + 0.0)"),
    "timestamp_ntz": ("time", "{c}"),
    "string": ("text", "{c}"),
}
_VALUES = " UNION ALL ".join(
    f"SELECT '{table}' AS t, '{c}' AS c, '{_DOMAINS[kind][0]}' AS d,"
    f" {_DOMAINS[kind][1].format(c=c)}::VARCHAR AS v FROM {table}"
    for table in TABLES
    for c, kind in types_of(table)
    if kind in _DOMAINS  # lists have no column of their kind to refer to
)
CANDIDATES_SQL = f"""
WITH vals AS ({_VALUES}),
cols AS (SELECT t, c, count(*) = count(v) AND count(v) = count(DISTINCT v) AS is_key,
                count(DISTINCT v)::BIGINT AS n FROM vals GROUP BY t, c),
cells AS (SELECT DISTINCT t, c, d, v FROM vals WHERE v IS NOT NULL),
keys AS (SELECT cells.*, n FROM cells JOIN cols USING (t, c) WHERE is_key),
hits AS (SELECT a.t, a.c, b.t AS pt, b.c AS pc, any_value(b.n) AS target_distinct, count(*) AS m
         FROM cells a JOIN keys b ON a.d = b.d AND a.v = b.v AND (a.t, a.c) <> (b.t, b.c)
         GROUP BY a.t, a.c, b.t, b.c)
SELECT t AS source_table, c AS source_column, pt AS target_table, pc AS target_column,
       n AS source_distinct, target_distinct, n / target_distinct AS coverage
FROM hits JOIN cols USING (t, c) WHERE m = n
"""


@query("fk_candidates", CANDIDATES_SQL)
def run_fk_candidates(t):
    return fk_candidates(t.all())


def _words(column: str) -> str:
    return f"replace({column}, '_', ' ')"


ROLE_SQL = (
    "CASE WHEN is_unique THEN 'identifier' WHEN distinct_count < 10 THEN 'category'"
    " ELSE 'attribute' END"
)
DESCRIPTION_SQL = (
    f"(CASE {ROLE_SQL} WHEN 'identifier' THEN 'A unique identifier for each ' || table_name"
    f" WHEN 'category' THEN 'The ' || {_words('column_name')} || ' category of the ' ||"
    " table_name || ', ' || distinct_count || ' values'"
    f" ELSE 'The ' || {_words('column_name')} || ' of the ' || table_name END"
    " || CASE WHEN null_ratio > 0.5 THEN ' (optional).' ELSE '.' END)"
)


@query("column_roles", f"SELECT *, {ROLE_SQL} AS role, null_ratio > 0.5 AS is_optional FROM {NULLABLE_SQL}")
def column_roles(t):
    return rules.column_roles(nullable_profile(t))


@query(
    "describe_columns",
    f"SELECT *, {ROLE_SQL} AS role, null_ratio > 0.5 AS is_optional,"
    f" {DESCRIPTION_SQL} AS description FROM {NULLABLE_SQL}",
)
def describe_columns(t):
    return rules.describe_columns(nullable_profile(t))


@query(
    "suggest_tests",
    "SELECT table_name, column_name, CASE WHEN is_unique AND null_count = 0 THEN"
    " 'unique, not_null' WHEN is_unique THEN 'unique' WHEN null_count = 0 THEN 'not_null'"
    f" ELSE '' END AS tests FROM {NULLABLE_SQL}",
)
def suggest_tests(t):
    return rules.suggest_tests(nullable_profile(t)).select(
        "table_name", "column_name", F.array_join("tests", ", ").alias("tests")
    )


@query(
    "profile_text",
    "SELECT table_name, column_name, '- Null Ratio: ' || null_ratio || ' (0.0 = no nulls)' ||"
    " chr(10) || '- Is Unique: ' || CASE WHEN is_unique THEN 'True' ELSE 'False' END || chr(10)"
    " || '- Distinct Count: ' || distinct_count AS db_text, '- Null Ratio: ' || null_ratio ||"
    " chr(10) || '- Is Unique: ' || CASE WHEN is_unique THEN 'True' ELSE 'False' END || chr(10)"
    f" || '- Distinct Count: ' || distinct_count AS model_text FROM {NULLABLE_SQL}",
)
def profile_texts(t):
    facts = [F.col(c) for c in ("null_ratio", "is_unique", "distinct_count")]
    return nullable_profile(t).select(
        "table_name",
        "column_name",
        profile_text(*facts).alias("db_text"),
        profile_text(*facts, hint=False).alias("model_text"),
    )


_PII_TABLES = ("customer", "part", "documents", "events")


@query(
    "pii_by_name",
    "SELECT table_name, column_name, distinct_count, regexp_matches(lower(column_name),"
    f" 'email|name|phone|ssn') AS pii FROM {table_profile_sql(*_PII_TABLES)}",
)
def pii_by_name(t):
    profile = P.profile_database({n: getattr(t, n) for n in _PII_TABLES})
    return rules.pii_by_name(profile).select("table_name", "column_name", "distinct_count", "pii")


def _pii_sql(table: str, column: str, kind: str, pattern: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, '{column}' AS column_name, '{kind}' AS pattern,"
        f" count({column})::BIGINT AS value_count,"
        f" count(CASE WHEN regexp_matches({column}, '{pattern}') THEN 1 END)::BIGINT AS match_count"
        f" FROM {table}"
    )


_PII_VALUES = [("documents", "text"), ("documents", "source"), ("pages", "html")]
_PII_UNION = " UNION ALL ".join(
    _pii_sql(t, c, k, p) for t, c in _PII_VALUES for k, p in rules.PII_VALUE_PATTERNS.items()
)


@query(
    "pii_by_value",
    "SELECT *, coalesce(match_count / nullif(value_count, 0)::DOUBLE >= 0.01, false) AS pii"
    f" FROM ({_PII_UNION})",
)
def pii_by_value(t):
    found = rules.pii_by_value(t.documents, ["text", "source"], "documents")
    return found.unionByName(rules.pii_by_value(t.pages, ["html"], "pages"))


TAG_RULES = [("price|acctbal|discount|tax", "finance"), ("date|ts$", "time"), ("key$|_id$", "key")]
_TAGS = " || ".join(
    f"CASE WHEN regexp_matches(lower(column_name), '{p}') THEN '{tag},' ELSE '' END"
    for p, tag in sorted([*TAG_RULES, ("email|name|phone|ssn", "pii")], key=lambda r: r[1])
)
_TAG_TABLES = ("orders", "lineitem", "customer", "events")


@query(
    "suggest_tags",
    f"SELECT table_name, column_name, is_unique, rtrim({_TAGS}, ',') AS tags"
    f" FROM {table_profile_sql(*_TAG_TABLES)}",
)
def suggest_tags(t):
    profile = P.profile_database({n: getattr(t, n) for n in _TAG_TABLES})
    return rules.suggest_tags(profile, TAG_RULES).select(
        "table_name", "column_name", "is_unique", F.array_join("tags", ",").alias("tags")
    )


TESTS = [
    ("orders", "o_orderkey", "unique"),
    ("orders", "o_orderkey", "not_null"),
    ("orders", "o_custkey", "unique"),
    ("labelled", "quality", "not_null"),
    ("labelled", "quality", "unique"),
    ("labelled", "doc_id", "unique"),
    ("lineitem", "l_shipdate", "unique"),
    ("lineitem", "l_partkey", "unique"),
    ("documents", "text", "unique"),
]


def _test_sql(table: str, column: str, test: str) -> str:
    source = LABELLED_SQL if table == "labelled" else table
    if test == "not_null":
        failures = f"SELECT count(*) - count({column}) AS f FROM {source}"
    else:
        failures = (
            f"SELECT count(*) AS f FROM (SELECT {column} FROM {source} WHERE {column} IS NOT NULL"
            f" GROUP BY {column} HAVING count(*) > 1)"
        )
    return (
        f"SELECT '{table}' AS table_name, '{column}' AS column_name, '{test}' AS test,"
        f" f::BIGINT AS failures, f = 0 AS passed FROM ({failures})"
    )


@query("run_tests", " UNION ALL ".join(_test_sql(*x) for x in TESTS))
def run_tests(t):
    return rules.run_tests(t.all() | {"labelled": labelled(t)}, TESTS)


DOCUMENTED = [
    ("orders", "o_orderkey", "Unique ID of the order"),
    ("orders", "o_custkey", "Unique identifier of the customer"),
    ("orders", "o_orderpriority", "Either urgent or low"),
    ("orders", "o_totalprice", "Price category, such as high or low"),
    ("lineitem", "l_extendedprice", "One of several price levels"),
    ("lineitem", "l_quantity", "How many pieces"),
    ("lineitem", "l_partkey", ""),
    ("lineitem", "gone", "Unique column that the table no longer has"),
]
_DOCUMENTED_VALUES = ", ".join(f"('{m}', '{c}', '{d}')" for m, c, d in DOCUMENTED)
_FACTS = profile_sql([(m, c, m) for m, c, d in DOCUMENTED if d and c != "gone"])
VERDICT_SQL = (
    "SELECT d.model_name, d.column_name, d.description, CASE WHEN"
    " (regexp_matches(lower(description), 'unique|identifier|primary key') AND NOT is_unique) OR"
    " (regexp_matches(lower(description), 'one of|either|such as|e\\.g\\.|category|categories|status is')"
    " AND distinct_count > 1000) THEN 'DRIFT' ELSE 'MATCH' END AS verdict"
    f" FROM (VALUES {_DOCUMENTED_VALUES}) d(model_name, column_name, description)"
    f" LEFT JOIN {_FACTS} p ON p.table_name = d.model_name AND p.column_name = d.column_name"
    " WHERE d.description <> ''"
)


def verdicts(t: Tables) -> DataFrame:
    rows = [("models", m, c, "description", d, "models/schema.yml") for m, c, d in DOCUMENTED]
    docs = local_frame(t.spark, rows, "DOCS")
    wanted: dict[str, list[str]] = {}
    for m, c, d in DOCUMENTED:
        if d:
            wanted.setdefault(m, []).append(c)
    facts = P.profile_database({m: getattr(t, m) for m in wanted}, wanted)
    return rules.drift_verdicts(docs, facts)


@query("drift_verdicts", VERDICT_SQL)
def drift_verdicts(t):
    return verdicts(t)


@query("is_outdated", f"SELECT count(*) > 0 AS is_outdated FROM ({VERDICT_SQL}) WHERE verdict = 'DRIFT'")
def outdated(t):
    return is_outdated(verdicts(t).filter("verdict = 'DRIFT'"))


_INVENTORY = ", ".join(
    f"('{table}', '{column}', {i}, '{kind}')"
    for table in TABLES
    for i, (column, kind) in enumerate(types_of(table), start=1)
)
_ROWS_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*)::BIGINT AS row_count FROM {t}" for t in TABLES)


def row_counts(t: Tables) -> DataFrame:
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
        for n, df in t.all().items()
    ]
    result = counts[0]
    for frame in counts[1:]:
        result = result.unionByName(frame)
    return result


@query(
    "list_columns",
    "SELECT c.table_name, column_name, ordinal::INTEGER AS ordinal, data_type,"
    " true AS is_nullable, false AS is_pk, '' AS description, row_count"
    f" FROM (VALUES {_INVENTORY}) c(table_name, column_name, ordinal, data_type)"
    f" JOIN ({_ROWS_SQL}) r ON r.table_name = c.table_name",
)
def list_columns(t):
    return list_all_columns(t.all()).join(row_counts(t), "table_name")


@query(
    "list_datasets",
    "SELECT table_name || '.parquet' AS dataset, 'parquet' AS format, 1::BIGINT AS files,"
    f" row_count FROM ({_ROWS_SQL})",
)
def datasets(t):
    counted = row_counts(t).select(F.concat("table_name", F.lit(".parquet")).alias("dataset"), "row_count")
    listed = list_datasets(t.spark, t.folder.rstrip("/") + "/")
    return listed.join(counted, "dataset").select("dataset", "format", "files", "row_count")


@query("scan_files", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def scan(t):
    return scan_files(t.spark, t.folder.rstrip("/") + "/events.parquet")


CATALOG_SQL = (
    "(SELECT p.table_name, p.column_name, ordinal::INTEGER AS ordinal, data_type,"
    " true AS is_nullable, false AS is_pk, total_count, null_count, distinct_count, null_ratio,"
    f" is_unique, profile_status, {ROLE_SQL} AS role, null_ratio > 0.5 AS is_optional,"
    f" {DESCRIPTION_SQL.replace('table_name', 'p.table_name').replace('column_name', 'p.column_name')}"
    " AS description"
    f" FROM {table_profile_sql(*TABLES)} p JOIN (VALUES {_INVENTORY})"
    " c(tn, cn, ordinal, data_type) ON tn = p.table_name AND cn = p.column_name)"
)


@query("build_catalog", f"SELECT * FROM {CATALOG_SQL}")
def catalog(t):
    return build_catalog(t.all())


def flagship(spark, folder: str) -> DataFrame:
    """What is in the orders table, column by column?"""
    return build_catalog({"orders": Tables(spark, folder).orders})


_COLUMN_JSON = (
    "'{\"name\":\"' || column_name || '\",\"type\":\"' || data_type || '\",\"description\":\"'"
    " || description || '\",\"profile_stats\":{\"null_ratio\":' || null_ratio ||"
    " ',\"distinct_count\":' || distinct_count || ',\"is_unique\":' || is_unique || '}}'"
)


# English documents stand for views (with their text as definition), orders for keys.
_VIEWS = "SELECT 'doc_' || doc_id AS name, coalesce(text, '') AS definition FROM documents WHERE lang = 'en'"
_KEYS = (
    "SELECT 'order_' || o_orderkey AS name, 'custkey' AS source_column, 'customer_' || o_custkey AS"
    " target_table, 'c_custkey' AS target_column FROM orders"
)


def catalog_views(t: Tables) -> DataFrame:
    english = t.documents.filter("lang = 'en'")
    return english.selectExpr("concat('doc_', doc_id) AS view_name", "coalesce(text, '') AS definition")


def catalog_keys(t: Tables) -> DataFrame:
    return t.orders.selectExpr(
        "concat('order_', o_orderkey) AS source_table", "'custkey' AS source_column",
        "concat('customer_', o_custkey) AS target_table", "'c_custkey' AS target_column",
    )


@query(
    "catalog_nested",
    "SELECT 'table' AS record, table_name AS name, 'Stores ' || table_name ||"
    " ' records with the columns ' || string_agg(column_name, ', ' ORDER BY ordinal) || '.'"
    f" AS summary, '[' || string_agg({_COLUMN_JSON}, ',' ORDER BY ordinal) || ']' AS columns_json,"
    " NULL AS definition, NULL AS source_column, NULL AS target_table, NULL AS target_column"
    f" FROM {CATALOG_SQL} GROUP BY table_name UNION ALL SELECT 'view', name, name ||"
    f" ' has no direct parents.', NULL, definition, NULL, NULL, NULL FROM ({_VIEWS}) UNION ALL SELECT"
    f" 'foreign_key', name, NULL, NULL, NULL, source_column, target_table, target_column FROM ({_KEYS})",
)
def catalog_nested(t):
    records = assemble_catalog(
        build_catalog(t.all()), rules.describe_views(catalog_views(t)), catalog_keys(t)
    )
    return records.select(
        "record", "name", "summary", F.to_json("columns").alias("columns_json"),
        "definition", "source_column", "target_table", "target_column",
    )


_PROMPT_LENGTH = (
    "length('Describe a database column in fewer than 15 words.' || chr(10) || 'Table: ' ||"
    " table_name || chr(10) || 'Column: ' || column_name || chr(10) || 'Type: ' || data_type ||"
    " chr(10) || 'Profile:' || chr(10) || '- Null Ratio: ' || null_ratio || ' (0.0 = no nulls)' ||"
    " chr(10) || '- Is Unique: ' || CASE WHEN is_unique THEN 'True' ELSE 'False' END || chr(10)"
    " || '- Distinct Count: ' || distinct_count || chr(10) || 'Mention uniqueness, few distinct"
    " values (category) and many nulls (optional).')"
)


_TABLE_LENGTH = (
    "length('Say in one or two sentences what the table ' || table_name || ' holds. Its columns"
    " are: ' || string_agg(column_name, ', ' ORDER BY ordinal) || '.')"
)
_VIEW_LENGTH = (
    "length('Say in one or two sentences what the view ' || name || ' shows. Its definition is:'"
    " || chr(10) || definition)"
)


@query(
    "generated_catalog",
    "SELECT 'column' AS kind, table_name AS name, column_name, CASE WHEN column_name LIKE '%key' THEN"
    f" description ELSE {_PROMPT_LENGTH} || ' in {MAX_TOKENS['column']}' END AS text FROM {CATALOG_SQL}"
    f" UNION ALL SELECT 'table', table_name, NULL, {_TABLE_LENGTH} || ' in {MAX_TOKENS['table']}' FROM"
    f" {CATALOG_SQL} GROUP BY table_name UNION ALL SELECT 'view', name, NULL, {_VIEW_LENGTH} ||"
    f" ' in {MAX_TOKENS['view']}' FROM ({_VIEWS})",
)
def run_generated_catalog(t):
    """The texts of all columns, tables and views; calls for keys fail."""

    def answer(prompt: str, budget: int) -> str:
        if "key\nType" in prompt:
            raise ValueError("no idea")
        return f"{len(prompt)} in {budget}"

    columns, tables, views = generated_catalog(build_catalog(t.all()), catalog_views(t), answer)
    texts = lambda df, kind, name, column, text: df.select(
        F.lit(kind).alias("kind"), F.col(name).alias("name"), column.alias("column_name"), F.col(text).alias("text")
    )
    none = F.lit(None).cast("string")
    return (
        texts(columns, "column", "table_name", F.col("column_name"), "description")
        .unionByName(texts(tables, "table", "table_name", none, "summary"))
        .unionByName(texts(views, "view", "view_name", none, "summary"))
    )
