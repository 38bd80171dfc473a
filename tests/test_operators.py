import json
import math
import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark import __main__ as cli
from tidemark import config, registry, training
from tidemark.functions.cells import as_double, convert_type, fill_zero, parse_timestamp, to_number
from tidemark.functions.numeric import unit_bin
from tidemark.operators import genome, metrics, network, orders, position, windows
from tidemark.sources import settings
from tidemark.sources.series import read_series, write_series


def series(spark, values, name="v"):
    return spark.createDataFrame(list(enumerate(map(float, values))), f"pos long, {name} double")


def column(df, name, order="pos"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_cells(spark):
    texts = ["1", " 2 ", "\t3", "4\n", "1e3", "+5", ".5", "5.", "inf", "-Infinity", "1d", "1f", "0x10", "1,000", "1e400", "", "abc", "1_000", "True", None]
    got = column(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "pos int, t string").select("pos", to_number(F.col("t")).alias("x")), "x")
    assert got == [1, 2, 3, 4, 1000, 5, 0.5, 5, math.inf, -math.inf] + [None] * 10
    filled = spark.createDataFrame([(0, None), (1, math.nan), (2, 3.0)], "pos int, x double").select("pos", fill_zero(F.col("x")).alias("x"))
    assert column(filled, "x") == [0, 0, 3]
    assert [convert_type(x) for x in ("3", "0.5", "a", None)] == [3, 0.5, "a", None]
    dates = spark.createDataFrame([(0, "16/04/2010 20:00"), (1, "3/4/2010 1:00"), (2, "x"), (3, None)], "pos int, t string")
    assert column(dates.select("pos", parse_timestamp(F.col("t")).alias("d")), "d") == [datetime(2010, 4, 16, 20), datetime(2010, 4, 3, 1), None, None]
    stamped = spark.sql("SELECT timestamp_ntz'1970-01-01 00:00:01' AS t")
    with pytest.raises(ValueError, match="timestamp"):
        as_double(F.col("t"), stamped.schema["t"].dataType)


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("16/04/2010 20:00,1,x\n17/04/2010 20:00, 2 ,3\n")
    got = read_series(spark, str(tmp_path / "a.csv"), headers=False)
    assert got.columns == ["date", "col_1", "col_2"] and got.date == "date"
    assert [tuple(r)[2:] for r in got.frame.orderBy("pos").collect()] == [(1.0, None), (2.0, 3.0)]
    (tmp_path / "b.csv").write_text("A,B\n1,x\n2,y\n")
    got = read_series(spark, str(tmp_path / "b.csv"))
    assert [tuple(r) for r in got.frame.orderBy("pos").collect()] == [(0, 1.0, "x"), (1, 2.0, "y")]
    write_series(got.frame, str(tmp_path / "c"), one_file=True)
    assert [tuple(r) for r in read_series(spark, str(tmp_path / "c")).frame.orderBy("pos").collect()] == [(0, 1.0, "x"), (1, 2.0, "y")]
    with pytest.raises(AnalysisException):
        read_series(spark, str(tmp_path / "none.csv"))


def test_positions_are_dense_over_partitions(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("k"), "id").repartition(9)
    assert column(position.with_position(rows, "k", "id"), "pos") == list(range(5000))
    by = position.with_position(rows.withColumn("k", F.when(F.col("k") > 0, F.col("k"))), "id", by=["k"])
    assert by.groupBy("k").agg((F.max("pos") + 1 == F.count("*")).alias("ok")).filter("ok").count() == 7
    assert position.with_position(rows.limit(0), "id").count() == 0


@pytest.mark.parametrize("n", [2, 3, 4, 10, 11])
def test_split(spark, n):
    rows = position.split_thirds(series(spark, [1.0] * n))
    if n < 3:
        with pytest.raises(ValueError, match="x_train_data is empty."):
            position.check_parts(rows)
    else:
        third = n // 3
        assert position.check_parts(rows) == {"train": third, "prune": third, "stabilize": n - 2 * third}


def test_align(spark):
    x, y = series(spark, range(10), "x"), series(spark, range(8), "y")
    for offset, n in ((0, 8), (5, 5), (12, 0)):
        got = position.align(x, y, offset).orderBy("pos").collect()
        assert [(r.x, r.y) for r in got] == [(i + offset, i) for i in range(n)]
    assert column(position.skip(x, -3), "x") == [7, 8, 9]
    with pytest.raises(ValueError, match="different lengths"):
        position.align(x, y, strict=True)
    assert column(position.align(x, y, 2, strict=True), "x") == [*range(2, 10)]


def test_sliding_window_and_inverse(spark):
    w = windows.sliding_window(series(spark, [1, 2, 3, 4, 5]), 3, "v")
    assert column(w, "w", "row_id") == [[1, 2, 3], [2, 3, 4], [3, 4, 5]]
    assert windows.sliding_window(series(spark, [1, 2]), 3, "v").count() == 0
    assert windows.sliding_window(series(spark, [1, 2, 3]), 3, "v").count() == 1
    long = series(spark, np.random.default_rng(0).normal(size=300).tolist())
    blocked = position.blocks(long, 6, size=10).filter("own").count()
    assert blocked == 300
    assert np.allclose(column(windows.overlap_add(windows.sliding_window(long, 7, "v")), "output"), column(long, "v"))


@pytest.mark.parametrize(("n", "w", "divisors"), [(6, 3, [1, 3, 3, 3, 3, 3, 3, 2]), (3, 7, [1, 2, 3, 28, 30, 5, 4, 3, 2])])
def test_older_divisors(spark, n, w, divisors):
    ones = spark.createDataFrame([(i, [1.0] * w) for i in range(n)], "row_id long, w array<double>")
    sums = [min(i + 1, w, n, n + w - 1 - i) for i in range(n + w - 1)]
    assert np.allclose(column(windows.overlap_add(ones, "compat"), "output"), [s / d for s, d in zip(sums, divisors, strict=True)])
    assert set(column(windows.overlap_add(ones), "output")) == {1.0}


def test_returns(spark):
    got = windows.discounted_return(series(spark, [1, 2, 3], "reward"), 0.99)
    assert np.allclose(column(got, "ret"), [5.9203, 4.97, 3.0])
    r = np.random.default_rng(1).normal(size=1600)
    want, g = [], 0.0
    for x in r[::-1]:
        g = x + 0.9 * g
        want.append(g)
    for by in ([], ["k"]):
        rows = series(spark, r.tolist(), "reward").withColumn("k", F.lit(None).cast("string"))
        assert np.allclose(column(windows.discounted_return(rows, 0.9, by=by), "ret"), want[::-1])


@pytest.mark.parametrize("by", [[], ["k"]])
def test_returns_of_long_episodes_fold_in_levels(spark, monkeypatch, by):
    monkeypatch.setattr(windows, "RETURN_BLOCK", 4)
    r = np.random.default_rng(2).normal(size=333)
    for last in (1.0, np.inf):
        r[-1], want, g = last, [], 0.0
        for x in r[::-1]:
            g = x + 0.9 * g
            want.append(g)
        rows = series(spark, r.tolist(), "reward").withColumn("k", F.lit("x"))
        assert np.allclose(column(windows.discounted_return(rows, 0.9, by=by), "ret"), want[::-1])


@pytest.mark.parametrize("most", [3, 5, 9])
def test_episode(spark, most):
    got = windows.episode(series(spark, range(5)), most).orderBy("t").collect()
    assert [(r.t, r.idx, r.done) for r in got] == [(t, min(t, 4), t == min(most, 5)) for t in range(1, min(most, 5) + 1)]
    scored = windows.step_rewards(series(spark, range(5)).withColumn("p", F.lit(1.0)), "v", "p", most)
    assert column(scored, "reward") == [math.inf, 1.0, 0.5, 1 / 3, 1 / 3][: min(most, 5)]


def test_information(spark):
    x = spark.createDataFrame([(0.0, 1.0), (1.0, 4.0), (4.0, 2.0)], "a double, b double")
    v = np.array([[0, 0], [0.25, 1], [1, 1 / 3]])
    bits = 6 * np.log2(1 + (v.mean() / v.std()) ** 2)
    assert metrics.shannon_hartley(x, ["a", "b"]).first().bits == pytest.approx(bits)
    for bad in (metrics.shannon_hartley(x.withColumn("b", F.lit(1.0)), ["a", "b"]), metrics.shannon_hartley(x, []), metrics.shannon_hartley(x.limit(0), ["a"]), metrics.shannon_hartley(x, ["a"], 0)):
        assert bad.first().bits is None
    assert math.isnan(metrics.shannon_hartley(x.union(spark.createDataFrame([(math.nan, 1.0)], x.schema)), ["a", "b"]).first().bits)
    edges = np.linspace(0, 1, 51)
    values = np.unique(np.clip(np.concatenate([edges, np.nextafter(edges, 0), np.nextafter(edges, 1), np.random.default_rng(3).random(2000)]), 0, 1))
    got = spark.createDataFrame([(float(v),) for v in values], "v double").groupBy(unit_bin(F.col("v")).cast("int").alias("b")).count()
    assert {r.b: r["count"] for r in got.collect()} == {i: n for i, n in enumerate(np.histogram(values, bins=50, range=(0, 1))[0].tolist()) if n}


def test_genome(spark):
    links = [("none", "a", 1.0, False), ("one", "a", 1.0, True), ("same", "a", 2.0, True), ("same", "b", 2.0, True), ("mixed", "a", 0.0, True), ("mixed", "b", 1.0, True), ("mixed", "c", 9.0, False)]
    c = spark.createDataFrame(links, "genome_id string, key string, weight double, enabled boolean")
    n = spark.createDataFrame([("mixed", "x"), ("alone", "x")], "genome_id string, key string")
    got = {r.genome_id: r for r in genome.total_information(c, n).collect()}
    assert [got[g].entropy for g in ("none", "one", "same", "mixed")] == [0, 0, 0, 1]
    assert (got["mixed"].n_connections, got["mixed"].total_information, got["alone"].n_nodes) == (3, 3, 1)
    assert {r.genome_id: r.bits % 8 for r in genome.serialised(c).collect()}["one"] == 0


def test_ledger(spark):
    day = datetime(2010, 4, 16)
    rows = [(i, datetime(2010, 4, 16 + i), 0 if i != 3 else 1, float(10 + i), 9.0 + i, 11.0 + i, 100.0, 100.0 - (i == 4)) for i in range(8)]
    market = spark.createDataFrame(rows, "pos long, date timestamp_ntz, order_status int, close double, low double, high double, equity double, balance double")
    acted = orders.signals(market, [day, datetime(2010, 4, 18)], [day, datetime(2010, 4, 21)])
    assert column(acted, "action") == [1, 0, 1, 0, 0, 2, 0, 0]
    got = orders.ledger(orders.until_done(acted, 3), 0.1, 100).orderBy("opened_at").collect()
    assert [(r.opened_at, r.action, r.closed_at, r.balanced) for r in got] == [(0, 1, 1, True), (2, 1, 4, False), (5, 2, 6, True)]
    assert got[0].pips == pytest.approx((10.0 - 10.0) / 0.0001) and got[2].pips == pytest.approx((15 - (17.0 + 0.001)) / 0.0001)
    assert got[2].profit == pytest.approx(got[2].pips * 0.0001 * 1000)


def test_networks(spark, tmp_path):
    actor, critic = network.actor_critic(3, 5)
    wide, _ = network.actor_critic(3, 80)
    x = np.random.default_rng(2).normal(size=(40, 3))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(40, None)], "pos long, state array<double>")
    for net in (actor, critic, wide):
        got = column(network.predict(rows, net, "state"), "Prediction")
        assert np.allclose(np.array(got[:40]), network.evaluate(x, net))
    network.save({"actor": actor}, spark, str(tmp_path / "net"))
    assert all(np.array_equal(a.weights, b.weights) and np.array_equal(a.bias, b.bias) for a, b in zip(actor, network.load(spark, str(tmp_path / "net"))["actor"], strict=True))


def test_gradients_match_differences(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(rng.normal(size=2).tolist(), *rng.normal(size=2).tolist(), float(rng.normal()), float(rng.normal())) for _ in range(30)], "state array<double>, action double, logp double, ret double, adv double")
    nets = [*network.actor_critic(2, 4)]
    at = network.flat(nets)
    found = network.gradients(rows, *nets, 0.2)
    for i in (0, 5, 13, len(at) - 1):
        step = np.zeros(len(at))
        step[i] = 1e-6
        up, down = (network.gradients(rows, *network.shaped(at + s, nets), 0.2)[0] for s in (step, -step))
        assert found[2 + i] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-5)


def test_registry():
    f, params = registry.load_plugin("optimizers", "openrl")
    assert callable(f) and "gamma" in params and registry.get_plugin_params("optimizers", "openrl")["gamma"] == 0.99
    with pytest.raises(ImportError):
        registry.load_plugin("agents", "missing")
    assert registry.add_debug_info({"a": 1}, {"b": 2, "c": 3}, ["b"]) == {"a": 1, "b": 2}


def episode_rows(spark):
    rng = np.random.default_rng(13)
    rows = [(i, rng.random(2).tolist(), float(v)) for i, v in enumerate(rng.random(40))]
    return spark.createDataFrame(rows, "pos long, state array<double>, y double")


def test_the_environment_gives_the_rewards_that_are_trained_on(spark):
    from tidemark import builtin, training
    from tidemark.operators import network

    frame, params = episode_rows(spark), training.PpoParams(hidden=4, k_epochs=1, max_steps=25)
    nets = network.actor_critic(2, 4)
    y = {r.pos: r.y for r in frame.collect()}
    own = training.rollout(frame, *nets, params, environment=lambda rows: builtin.custom(rows, 25)).orderBy("pos").collect()
    assert [r.reward for r in own] == [y[p] for p in range(25)]
    plain = training.rollout(frame, *nets, params).orderBy("pos").collect()
    assert [r.reward for r in plain] == pytest.approx([1 / abs(y[p + 1] - plain[p].action) for p in range(25)])
    losses = [builtin.ppo(frame, 2, 1, environment=e, agent=builtin.actor, hidden=4, max_steps=25)[1] for e in (None, lambda rows: builtin.custom(rows, 25))]
    assert losses[0] != losses[1]
    with pytest.raises(ValueError):
        builtin.ppo(frame, 2, 1, agent=builtin.date_rule)


def test_shorter_trajectories_are_padded(spark):
    from tidemark import training
    from tidemark.operators import network

    steps = training.rollout(episode_rows(spark), *network.actor_critic(2, 4), training.PpoParams(max_steps=90)).orderBy("pos").collect()
    assert [r.pos for r in steps] == list(range(41)) and steps[40].reward == steps[39].reward and steps[40].state == steps[39].state


def test_spaces(spark):
    from tidemark.operators import network

    frame = episode_rows(spark)
    actor, _ = network.actor_critic(2, 4)
    network.check_spaces(frame, "state", 2, actor)
    for inputs, layers in ((3, None), (2, network.actor_critic(3, 4)[0]), (2, [network.Layer(np.zeros((2, 2)), np.zeros(2))])):
        with pytest.raises(ValueError):
            network.check_spaces(frame, "state", inputs, layers)


def test_all_target_columns_are_kept(spark, tmp_path):
    from tidemark.plans import prepare

    (tmp_path / "x.csv").write_text("1,2\n3,4\n5,6\n7,8\n9,10\n11,12\n")
    (tmp_path / "y.csv").write_text("1,7,x\n2,8,4\n3,9,5\n4,1,6\n5,2,7\n6,3,8\n")
    config_ = {"x_train_file": str(tmp_path / "x.csv"), "y_train_file": str(tmp_path / "y.csv"), "headers": False, "input_offset": 0}
    rows = prepare.prepare(spark, config_).train.orderBy("pos").collect()
    assert [r.targets for r in rows][:2] == [[1, 7, 0], [2, 8, 4]] and [r.y for r in rows] == [1, 2, 3, 4, 5, 6]


def test_account(spark):
    from tidemark.operators import orders

    rows = [("a", 0, 1.0, 2.0), ("a", 1, 3.0, 4.0), ("b", 0, 5.0, 6.0)]
    df = spark.createDataFrame(rows, "k string, pos long, balance double, equity double")
    ledger = spark.createDataFrame([("a", 0, 1), ("a", 1, None)], "k string, opened_at long, closed_at long")
    assert sorted(map(tuple, orders.account(df, ledger, ["k"]).collect())) == [("a", 3.0, 4.0, 1), ("b", 5.0, 6.0, 0)]


def test_log_file(tmp_path, monkeypatch):
    import logging

    for handler in list(cli.log.handlers):
        cli.log.removeHandler(handler)
    path = tmp_path / "run.log"
    cli.start_log(str(path))
    cli.start_log(str(path))
    logging.getLogger("tidemark.plans.run").info("first outputs")
    assert path.read_text().count("first outputs") == 1
    for handler in list(cli.log.handlers):
        handler.close()
        cli.log.removeHandler(handler)


def test_config():
    got = cli.configure(["data.csv", "-e", "3", "-io", "2", "--no-headers", "--extra=7", "--flag"])
    assert (got["x_train_file"], got["epochs"], got["input_offset"], got["headers"], got["extra"], got["flag"], got["gamma"]) == ("data.csv", 3, 2, False, 7, True, 0.99)
    saved = config.difference(got | {"username": "u", "password": "p"})
    assert saved == {"x_train_file": "data.csv", "epochs": 3, "input_offset": 2, "headers": False, "extra": 7, "flag": True}
    assert config.merge({"x_train_file": None}, {}, {"x_train_file": "f"}, {}, {}, ["p"])["x_train_file"] == "f"
    with pytest.raises(SystemExit):
        config.parser().parse_known_args(["--epochs", "x"])


def test_remote(tmp_path):
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.headers.get("Authorization"))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b'{"epochs": 5}')

        def do_POST(self):
            seen.append(self.rfile.read(int(self.headers["Content-Length"])).decode())
            self.send_response(200)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    assert settings.remote_load_config(url, "u", "p") == {"epochs": 5}
    assert settings.remote_save_config({"a": 1}, url) and settings.remote_log({"a": 1}, {"b": 2}, url)
    assert seen[0].startswith("Basic ") and seen[1].startswith("json_config=") and "json_result=" in seen[2]
    server.shutdown()
    server.server_close()
    with pytest.raises(settings.RemoteError):
        settings.remote_load_config(url)
    settings.save_config({"a": 1}, tmp_path / "c.json")
    assert settings.load_config(tmp_path / "c.json") == json.loads((tmp_path / "c.json").read_text()) == {"a": 1}


def test_command_line(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("TIDEMARK_LOG", str(tmp_path / "run.log"))
    rng = np.random.default_rng(6)
    for name in ("x", "y", "xv", "yv"):
        width = 2 if name[0] == "x" else 1
        (tmp_path / f"{name}.csv").write_text("".join(",".join(f"{v:.4f}" for v in row) + "\n" for row in rng.random((30, width))))
    path = lambda n: str(tmp_path / n)
    args = [path("x.csv"), "-ytf", path("y.csv"), "-xvf", path("xv.csv"), "-yvf", path("yv.csv"), "--no-headers", "-e", "1", "--hidden", "4", "--k_epochs", "1", "-sm", path("net"), "-sl", path("log.json"), "-sc", path("conf.json")]
    assert cli.main(args) == 0
    report = settings.load_config(path("log.json"))
    assert "first outputs" in (tmp_path / "run.log").read_text()
    assert cli.main([*args, "-ep", "custom"]) == 0 and settings.load_config(path("log.json"))["loss"] != report["loss"]
    assert cli.main([*args, "-ap", "dummy_automation"]) == 1
    assert report["validation_fitness"] > 0 and report["n_connections"] == 12 and report["n_nodes"] == 5
    assert cli.main([path("x.csv"), "-ytf", path("y.csv"), "--no-headers", "-lm", path("net"), "-ef", path("out")]) == 0
    assert read_series(spark, path("out")).frame.count() == 10
    assert cli.main([]) == 1


@pytest.mark.parametrize("name", ["series_reward", "lead_reward"])
def test_rewards_before_missing_values_equal_sql(spark, duck, tmp_path, name):
    from tidemark.plans import catalogue

    from .conftest import SMALL, canonical

    rows = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("value", F.when(F.col("event_id") % 9 != 4, F.col("value")))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    found = catalogue.QUERIES[name](spark, str(tmp_path))
    names = sorted(found.columns)
    sql = catalogue.ORACLE_SQL[name].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")
    assert canonical(found.select(*names).collect()) == canonical(duck.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall())
