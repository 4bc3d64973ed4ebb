import glob
import os

import pytest

import corpus_pipeline
from lakedoc.llm import queries
from tests.llm.conftest import documents

FOLDER = "/root/testdata/sf0.001"


def test_stages_on_odd_documents(spark, tmp_path):
    good = " ".join(f"word{i}" for i in range(80))
    long = " ".join(f"other{i}" for i in range(3000))
    rows = [(1, good), (2, good.upper()), (3, None), (4, ""), (5, long), (6, long + " end"),
            (7, "few words"), (8, "x " * 500), (9, good + " passage " + long[:900]), (9, good)]
    documents(spark, *rows).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, left = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), name)
        left.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
        if name != "best_fit_packing":
            assert docs.columns == columns
            clashing = [c for c in columns if c not in ("doc_id", "text", "lang", "n_chars")]
            assert all(set(r) == {"s"} for r in docs.select(*clashing).collect())
    assert left[0] == [1, 2, 5, 6, 9, 9]  # the others are too short or repeat themselves
    assert left[1] == [5, 6, 9, 9]  # texts 1 and 2 equal the shorter text 9, the larger id stays
    assert set(left[2]) <= {5, 6, 9} and len(set(left[2])) == len(left[2])
    assert set(left[4]) == set(left[3]) == set(left[2])


def test_empty_corpus(spark, tmp_path):
    documents(spark, (1, "a"), extra=False).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_over_the_smallest_tables(spark):
    packed = corpus_pipeline.run(spark, FOLDER).toPandas()
    assert (packed.groupby("sequence_id").length.sum() <= 2048).all()
    ordered = packed.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_with_sql(spark, name):
    import duckdb

    database = duckdb.connect()
    for file in glob.glob(f"{FOLDER}/*.parquet"):
        table = os.path.basename(file).removesuffix(".parquet")
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{file}')")
    mine = queries.QUERIES[name](spark, FOLDER).toPandas()
    theirs = database.execute(queries.ORACLE[name]).df()[list(mine.columns)]
    order = list(mine.columns)
    assert mine.sort_values(order).values.tolist() == theirs.sort_values(order).values.tolist()
