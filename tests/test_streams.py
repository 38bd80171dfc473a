"""Streams with state, restarts and late rows; SQL functions; the remote data source."""

import json
import threading
import urllib.parse
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tidemark.functions import tables
from tidemark.operators import orders, windows
from tidemark.sources import remote
from tidemark.streaming import ledger as ledger_stream
from tidemark.streaming import windows as closed

DAY = datetime(2024, 1, 1)


def market(spark, n=60, keys=("x", "y")):
    rows = []
    for key in keys:
        for i in range(n):
            price = 10 + ((i * 7 + len(key)) % 13) / 10
            rows.append((key, i, DAY + timedelta(hours=i), (i + (key == "y")) % 3 and 1, price, price - 0.2, price + 0.2, 100.0 + i, 100.0 + i - (i % 5 == 0)))
    return spark.createDataFrame(rows, "key string, pos long, date timestamp_ntz, order_status int, close double, low double, high double, equity double, balance double")


def listed(*hours):
    return [DAY + timedelta(hours=h) for h in hours]


def test_ledger_over_micro_batches(spark, tmp_path):
    """Several accounts; the query is stopped and started again after each part."""
    rows, buys, sells = market(spark), listed(0, 3, 12, 20, 28, 59), listed(4, 9, 12, 13)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for low, high in ((0, 7), (7, 25), (25, 60)):
        rows.filter(F.col("pos").between(low, high - 1)).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        query = closed.write(ledger_stream.ledger(stream, buys, sells, 0.5, 2), out, state)
        assert query.exception() is None
    done = spark.read.schema(f"key string, {ledger_stream.ORDER}").parquet(out)
    left = ledger_stream.open_orders(spark, state)
    found = done.unionByName(left, allowMissingColumns=True)
    want = orders.ledger(orders.signals(rows, buys, sells, ["key"]), 0.5, 2, ["key"])
    assert sorted(map(tuple, found.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert want.filter("closed_at IS NULL").count() > 0 < want.filter("closed_at IS NOT NULL").count()


def test_ledger_of_odd_rows(spark, tmp_path):
    rows = market(spark, 8, ("x",)).withColumn("date", F.when(F.col("pos") % 2 == 0, F.col("date"))).withColumn("extra", F.lit(1))
    rows = rows.withColumn("key", F.lit(None).cast("string"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    closed.write(ledger_stream.ledger(stream, listed(0), [], 1, 1), str(tmp_path / "out"), str(tmp_path / "state"))
    [r] = spark.read.schema(f"key string, {ledger_stream.ORDER}").parquet(str(tmp_path / "out")).collect()
    assert (r.key, r.opened_at, r.closed_at, r.action) == (None, 0, 3, 1)


def events(spark, minutes):
    return spark.createDataFrame([(k, DAY + timedelta(minutes=m), float(v)) for k, m, v in minutes], "k string, ts timestamp, v double")


def parts(spark, tmp_path, stream_of, batches):
    """Rows given out after each batch, and late rows of each."""
    schema = "k string, ts timestamp, v double"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    found = stream_of(stream)
    seen, late, before = [], [], set()
    for batch in batches:
        events(spark, batch).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = closed.write(found, str(tmp_path / "out"), str(tmp_path / "state"))
        late.append(closed.late_rows(query))
        now = {tuple(r) for r in spark.read.schema(found.schema).parquet(str(tmp_path / "out")).select("k", F.date_format("start", "HH:mm"), F.date_format("end", "HH:mm"), "n", "total").collect()}
        assert before <= now  # a window never changes
        seen.append(sorted(now - before))
        before = now
    return seen, late


def test_windows_close_once(spark, tmp_path):
    sums = [F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")]
    batches = [
        [("a", 1, 1), ("a", 9, 2), ("b", 12, 4), ("a", 31, 8)],  # watermark 00:26
        [("a", 3, 100), ("a", 28, 16), ("b", 40, 32)],  # minute 3 is late, 28 isn't; 00:35
        [("b", 80, 64)],
    ]
    seen, late = parts(spark, tmp_path, lambda s: closed.fixed(s, "ts", "10 minutes", "5 minutes", sums, ["k"]), batches)
    assert seen[0] == [("a", "00:00", "00:10", 2, 3.0), ("b", "00:10", "00:20", 1, 4.0)]
    assert seen[1] == [("a", "00:20", "00:30", 1, 16.0)]
    assert seen[2] == [("a", "00:30", "00:40", 1, 8.0), ("b", "00:40", "00:50", 1, 32.0)]
    assert late == [0, 1, 0]


def test_sliding_windows_close_once(spark, tmp_path):
    sums = [F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")]
    seen, _ = parts(spark, tmp_path, lambda s: closed.fixed(s, "ts", "10 minutes", "0 minutes", sums, ["k"], "5 minutes"), [[("a", 7, 1), ("a", 12, 2), ("a", 60, 0)]])
    assert seen[0] == [("a", "00:00", "00:10", 1, 1.0), ("a", "00:05", "00:15", 2, 3.0), ("a", "00:10", "00:20", 1, 2.0)]


def test_sessions_close_once(spark, tmp_path):
    sums = [F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")]
    batches = [
        [("a", 0, 1), ("a", 4, 2), ("a", 20, 4), ("b", 1, 8), ("b", 30, 0)],  # watermark 00:25
        [("a", 2, 100), ("a", 23, 16), ("b", 60, 0)],  # minute 2 is late; 23 isn't, but the session near it is out
    ]
    seen, late = parts(spark, tmp_path, lambda s: closed.sessions(s, "ts", "5 minutes", "5 minutes", sums, ["k"]), batches)
    assert seen[0] == [("a", "00:00", "00:09", 2, 3.0), ("a", "00:20", "00:25", 1, 4.0), ("b", "00:01", "00:06", 1, 8.0)]
    assert seen[1] == [("a", "00:23", "00:28", 1, 16.0), ("b", "00:30", "00:35", 1, 0.0)]
    assert late == [0, 1]


def test_rows_without_a_time(spark, tmp_path):
    sums = [F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")]
    spark.createDataFrame([("a", None, 1.0), ("a", DAY, 2.0), ("a", DAY + timedelta(hours=2), 2.0)], "k string, ts timestamp, v double").write.parquet(str(tmp_path / "in"))
    found = closed.fixed(spark.readStream.schema("k string, ts timestamp, v double").parquet(str(tmp_path / "in")), "ts", "1 hour", "0 minutes", sums, ["k"])
    closed.write(found, str(tmp_path / "out"), str(tmp_path / "state"))
    assert [r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]


# --- SQL functions -----------------------------------------------------------------------------------


@pytest.fixture
def series_view(spark):
    rows = [(k, i, float(i * i % 7) if i != 3 else None, "note") for k, n in (("a", 9), ("b", 2), ("c", 3)) for i in range(n)]
    frame = spark.createDataFrame(rows, "k string, pos long, V double, remark string").repartition(4)
    frame.createOrReplaceTempView("series_rows")
    tables.register(spark)
    return frame


def test_sql_functions_equal_operators(spark, series_view):
    found = spark.sql("SELECT k, pos AS row_id, w FROM sliding_window(TABLE(series_rows) PARTITION BY k ORDER BY (pos), 'v', 3)")
    want = windows.sliding_window(series_view, 3, "V", ["k"])
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    found = spark.sql("SELECT k, pos, V, remark, ret FROM discounted_return(TABLE(series_rows) PARTITION BY k ORDER BY (pos DESC), 'v', 0.9D)")
    want = windows.discounted_return(series_view, 0.9, "V", ["k"])
    assert {(r.k, r.pos): pytest.approx(r.ret) for r in found.collect()} == {(r.k, r.pos): r.ret for r in want.collect()}
    assert found.columns == ["k", "pos", "V", "remark", "ret"]


@pytest.mark.parametrize(
    ("call", "why"),
    [
        ("sliding_window(TABLE(series_rows) PARTITION BY k ORDER BY (pos), 'nothing', 3)", "no column nothing"),
        ("sliding_window(TABLE(series_rows) PARTITION BY k ORDER BY (pos), 'v', 0)", "at least one row"),
        ("sliding_window(TABLE(series_rows) PARTITION BY k ORDER BY (pos), 'v', 'x')", "constant number"),
        ("discounted_return(TABLE(series_rows) PARTITION BY k ORDER BY (pos), 'remark', 0.9D)", "holds no numbers"),
        ("discounted_return(TABLE(SELECT *, 1 AS ret FROM series_rows) PARTITION BY k ORDER BY (pos), 'v', 0.9D)", "a column ret already"),
    ],
)
def test_calls_that_are_refused(spark, series_view, call, why):
    with pytest.raises(Exception, match=why):
        spark.sql(f"SELECT * FROM {call}").collect()


def test_entropy_of_groups(spark):
    tables.register(spark)
    rows = [("flat", 1.0, True), ("flat", 1.0, True), ("off", 1.0, False), ("two", 0.0, True), ("two", 1.0, True), ("two", 0.5, False), ("two", None, True), ("two", 0.7, None)]
    spark.createDataFrame(rows, "g string, w double, e boolean").createOrReplaceTempView("genes")
    assert {r.g: r.h for r in spark.sql("SELECT g, weight_entropy(w, e) AS h FROM genes GROUP BY g").collect()} == {"flat": 0.0, "off": 0.0, "two": 1.0}


# --- remote data source ------------------------------------------------------------------------------


@pytest.fixture
def store():
    class Handler(BaseHTTPRequestHandler):
        calls: list = []
        refuse = 0

        def do_GET(self):
            self.calls.append(("GET", self.headers.get("Authorization")))
            self.send_response(200)
            self.end_headers()
            self.wfile.write({"/list": b"[1]", "/bad": b"{"}.get(self.path, b'{"epochs": 5, "plugin": "neat", "none": null}'))

        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            if Handler.refuse:
                Handler.refuse -= 1
                self.send_response(500)
                self.end_headers()
                return
            self.calls.append(("POST", self.headers.get("Idempotency-Key"), json.loads(urllib.parse.parse_qs(body)["json_rows"][0])))
            self.send_response(200)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield Handler, f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()
    server.server_close()


def sent(handler):
    return sorted(r["id"] for c in handler.calls if c[0] == "POST" for r in c[2])


def test_settings_are_read(spark, store):
    handler, url = store
    remote.register(spark)
    read = spark.read.format(remote.NAME).option("url", url)
    assert {r.key: json.loads(r.value) for r in read.load().collect()} == {"epochs": 5, "plugin": "neat", "none": None}
    assert read.option("username", "u").option("password", "p").load().filter("key = 'epochs'").count() == 1
    assert handler.calls[0][1] is None and handler.calls[-1][1].startswith("Basic ")
    for odd in ("list", "bad"):
        with pytest.raises(Exception, match="settings"):
            spark.read.format(remote.NAME).option("url", url + odd).load().collect()
    with pytest.raises(Exception, match="url"):
        spark.read.format(remote.NAME).load().collect()


def test_rows_are_sent_in_parts(spark, store, tmp_path):
    handler, url = store
    remote.register(spark)
    rows = spark.range(25).withColumn("note", F.lit("é"))
    rows.repartition(3).write.format(remote.NAME).option("url", url).option("stage", str(tmp_path)).option("part_rows", 4).mode("append").save()
    assert sent(handler) == list(range(25)) and max(len(c[2]) for c in handler.calls) == 4 and handler.calls[0][2][0]["note"] == "é"
    assert not list(tmp_path.glob("*.json"))


def test_a_task_that_is_tried_again_sends_nothing_twice(store, tmp_path):
    """Of two attempts of a task the driver gets one message; the other's rows stay unsent."""
    handler, url = store
    writer = remote._StreamWriter(remote._Sender({"url": url, "stage": str(tmp_path), "query": "q", "part_rows": "2"}, _Names(["id"])))
    writer.write(iter([(1,), (2,), (3,)]))  # this attempt is lost before its message arrives
    messages = [writer.write(iter([(1,), (2,), (3,)])), writer.write(iter([(4,)])), None]
    writer.commit(messages, 0)
    assert sent(handler) == [1, 2, 3, 4]


class _Names:
    def __init__(self, names):
        self.names = names


def test_a_batch_goes_on_behind_what_was_sent(store, tmp_path):
    handler, url = store
    sender = remote._Sender({"url": url, "stage": str(tmp_path), "query": "q", "part_rows": "1"}, _Names(["id"]))
    writer = remote._StreamWriter(sender)
    batch = lambda: [writer.write(iter([(i,)])) for i in range(4)]
    messages = batch()
    real, handler_calls = sender._post, []

    def breaks(rows, key):
        if len(handler_calls) == 2:
            raise remote.RemoteError("the line is down")
        handler_calls.append(key)
        real(rows, key)

    sender._post = breaks
    with pytest.raises(remote.RemoteError):
        writer.commit(messages, 7)
    sender._post = real
    writer.commit(batch(), 7)  # Spark replays the batch after a restart
    writer.commit(batch(), 7)  # and once more: it was all sent
    assert sent(handler) == [0, 1, 2, 3] and [c[1] for c in handler.calls] == ["q-7-0", "q-7-1", "q-7-2", "q-7-3"]
    lost = batch()
    writer.abort(lost, 8)
    assert not list(tmp_path.glob("*.json"))


def test_a_stream_is_sent_once_over_restarts(spark, store, tmp_path):
    handler, url = store
    remote.register(spark)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))

    def go():
        sink = stream.writeStream.format(remote.NAME).option("url", url).option("query", "test").option("stage", str(tmp_path / "stage")).option("checkpointLocation", str(tmp_path / "state"))
        query = sink.trigger(availableNow=True).start()
        query.awaitTermination()

    for k in range(3):
        spark.range(10 * k, 10 * k + 10).write.mode("append").parquet(str(tmp_path / "in"))
        if k == 1:
            handler.refuse = 1
            with pytest.raises(Exception, match="can't send"):
                go()
        go()
    go()
    assert sent(handler) == list(range(30))
    with pytest.raises(Exception, match="query is missing"):
        stream.writeStream.format(remote.NAME).option("url", url).option("checkpointLocation", str(tmp_path / "other")).start().processAllAvailable()


def test_rewards_of_a_table_of_several_files_and_missing_values(spark, duck, tmp_path):
    from tidemark.plans import catalogue

    from .conftest import SMALL, canonical

    rows = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("value", F.when(F.col("event_id") % 9 != 4, F.col("value")))
    rows.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    found = catalogue.stream_rewards(spark, str(tmp_path)).select("key", "seq", "reward").collect()
    sql = catalogue.ORACLE_SQL["stream_rewards"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")
    want = duck.execute(f"SELECT key, seq, reward FROM ({sql})").fetchall()
    assert want and canonical(found) == canonical(want)


def test_rewards_of_odd_values_and_times(spark, duck, tmp_path):
    """NaN and infinities are scored as in the SQL; a row without a time is its user's last; ties go by event."""
    from tidemark.plans import catalogue

    from .conftest import SMALL

    odd = "CASE event_id % 9 WHEN 4 THEN double('NaN') WHEN 5 THEN double('inf') WHEN 6 THEN NULL WHEN 7 THEN 0 ELSE value END"
    rows = spark.read.parquet(f"{SMALL}/events.parquet").selectExpr("event_id", "CASE WHEN event_id NOT IN (0, 7, 11) THEN ts END AS ts", "event_id div 25 AS user_id", "event_type", f"{odd} AS value")
    rows.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    found = catalogue.stream_rewards(spark, str(tmp_path)).select("key", "seq", "reward").collect()
    sql = catalogue.ORACLE_SQL["stream_rewards"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'").replace("ORDER BY ts", "ORDER BY ts, event_id")
    want = duck.execute(f"SELECT key, seq, reward FROM ({sql})").fetchall()
    assert len(want) > 700 and any(x != x for *_, x in want if x is not None)
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))

    tied = spark.createDataFrame([(i, float(i)) for i in (8, 2, 6, 4)], "event_id long, value double").selectExpr("event_id", "timestamp_ntz'2024-01-01' AS ts", "1L AS user_id", "value")
    tied.repartition(4).write.parquet(str(tmp_path / "tied" / "events.parquet"))
    assert [r.reward for r in catalogue.stream_rewards(spark, str(tmp_path / "tied")).collect()] == [0.5] * 3


def test_rewards_keep_odd_values_between_batches(spark, tmp_path):
    from tidemark.streaming import rewards
    from tidemark.streaming.windows import write

    schema = "key string, seq long, actual double, predicted double"
    found = []
    for k, (actual, predicted) in enumerate([(1.0, float("nan")), (float("nan"), None), (2.0, float("inf")), (float("inf"), 3.0), (None, 5.0), (4.0, 1.0)]):
        spark.createDataFrame([("a", k, actual, predicted)], schema).write.mode("append").parquet(f"{tmp_path}/in")
        write(rewards.step_rewards(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/state")
    found = {r.seq: r.reward for r in spark.read.schema(rewards.RESULT).parquet(f"{tmp_path}/out").collect()}
    assert found == {0: float("inf"), 1: None, 2: float("inf"), 4: 1.0}
