import pytest

from tidemark.plans import catalogue, queries

from .conftest import SMALL, same


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_equals_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, SMALL), duck, queries.ORACLE_SQL[name])


def test_complexity_is_the_raw_deflate_length(spark):
    import zlib

    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    for r in catalogue.kolmogorov_complexity(spark, SMALL).collect():
        packer = zlib.compressobj(9, zlib.DEFLATED, -15)
        assert r.complexity == len(packer.compress(texts[r.doc_id]) + packer.flush())


def test_stream_scores_each_row_but_the_last_of_a_key(spark):
    last, want = {}, []
    for r in spark.read.parquet(f"{SMALL}/events.parquet").orderBy("ts").collect():
        if r.user_id in last:
            gap = abs(r.value - last[r.user_id])
            want.append((str(r.user_id), float("inf") if gap == 0 else 1 / gap))
        last[r.user_id] = r.value
    assert sorted((r.key, r.reward) for r in catalogue.stream_rewards(spark, SMALL).collect()) == sorted(want)


def test_losses_make_a_table(spark):
    rows = catalogue.QUERIES["autoencoder_training"](spark, SMALL).orderBy("epoch").collect()
    assert [r.epoch for r in rows] == [0, 1, 2] and all(type(r.mse) is float and 0 < r.mse < 1 for r in rows)


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert [r.part for r in e.entry(spark).orderBy("part").collect()] == ["prune", "stabilize", "train"]


@pytest.mark.parametrize("name", ["asof_next_purchase", "asof_last_error"])
def test_ties_in_time_go_by_event(spark, tmp_path, name):
    """Of rows at the same time the SQL takes any; the query takes one that is named."""
    rows = [(0, "view", 0, 1), (9, "purchase", 5, 1), (4, "purchase", 5, 1), (7, "purchase", 5, 1), (3, "error", 6, 1), (8, "error", 6, 1), (5, "error", 6, 1), (6, "view", 7, 1)]
    table = spark.createDataFrame([(i, kind, at, user, float(i)) for i, kind, at, user in rows], "event_id long, event_type string, at long, user_id long, value double")
    table.selectExpr("event_id", "event_type", "timestamp_seconds(at) AS ts", "user_id", "value").repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    found = {r.event_id: r for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    if name == "asof_next_purchase":
        assert {i: r.next_id for i, r in found.items()} == {0: 4}
    else:
        assert found[6].error_id == 8 and all(r.error_id in (None, 8) for r in found.values())


@pytest.mark.parametrize("name", ["dense_position", "lead_reward", "series_reward", "discounted_return"])
def test_rows_without_a_time_or_an_id_come_last(spark, duck, tmp_path, name):
    """As the SQL has them: nulls come after all other rows."""
    rows = spark.read.parquet(f"{SMALL}/events.parquet").selectExpr("nullif(event_id, 40) AS event_id", "CASE WHEN event_id % 9 <> 4 THEN ts END AS ts", "user_id", "event_type", "value")
    rows.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    sql = queries.ORACLE_SQL[name].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")
    same(queries.QUERIES[name](spark, str(tmp_path)), duck, sql)
