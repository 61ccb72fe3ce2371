"""Every graph query against its SQL, and plans that must stay as they are."""

from __future__ import annotations

import duckdb
import pytest

from braid import queries as Q
from braid.graph import Graph
from braid.operators import relations
from braid.plans import inspect
from braid.sources import sample

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(r[i] for i in order) for r in rows], key=repr)


@pytest.fixture(scope="module")
def sql(sf_dir):
    with duckdb.connect() as con:
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        yield con


@pytest.mark.parametrize("name", list(Q.queries()))
def test_query_equals_sql(spark, sf_dir, sql, name):
    frame = Q.queries()[name](spark, sf_dir)
    found = sql.execute(Q.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(columns, found.fetchall())


def test_links_need_no_shuffle(spark, sf_dir, tmp_path):
    sample.order_parts(spark, sf_dir).write.parquet(str(tmp_path / "h"))
    stored = spark.read.parquet(str(tmp_path / "h"))
    assert inspect.shuffles(relations.links(stored)) == 0
    assert "weight" not in inspect.read_columns(relations.links(stored))
    plan = inspect.physical(relations.links(stored, src=17))
    assert plan.index("Generate") < plan.index("array_contains")  # below the explode


def test_full_neighbours_and_materialized_plans(spark, sf_dir, tmp_path):
    sample.order_parts(spark, sf_dir).write.parquet(str(tmp_path / "h"))
    sample.parts(spark, sf_dir).write.parquet(str(tmp_path / "v"))
    graph = Graph(spark.read.parquet(str(tmp_path / "v")), spark.read.parquet(str(tmp_path / "h")), 0, 0)
    assert inspect.shuffles(graph.full_adjacency_from()) == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counted = inspect.nodes(graph.materialized())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert counted["SortMergeJoin"] == 1 and counted["Scan"] + counted["FileScan"] <= 2


def test_entry_imports(spark):
    import __spark_entry__ as entry

    assert set(Q.queries()) <= set(entry.queries())
    assert not entry.entry(spark).isEmpty()


def test_streamed_links(spark, sf_dir, tmp_path):
    from braid.streaming.links import degree_stream

    hyperedges = sample.order_parts(spark, sf_dir)
    hyperedges.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(hyperedges.schema).parquet(str(tmp_path / "in"))
    query = degree_stream(stream).writeStream.outputMode("complete").format("memory").queryName("degrees").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    expected = relations.links(hyperedges).groupBy("src").count()
    assert sorted(map(tuple, spark.table("degrees").collect())) == sorted(map(tuple, expected.collect()))


def test_bulk_adjacency_covers_all_vertices(spark, sf_dir):
    one_way = Q.queries()["adjacent_from"](spark, sf_dir).collect()
    other_way = Q.queries()["adjacent_to_all"](spark, sf_dir).collect()
    assert sorted((r["neighbour_id"], r["vertex_id"]) for r in one_way) == sorted((r["vertex_id"], r["neighbour_id"]) for r in other_way)
