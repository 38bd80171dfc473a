"""Plugins of other packages, agents that trade by a rule, fitness by the environment."""

import subprocess
import sys
import textwrap
from datetime import datetime, timedelta

import numpy as np
import pytest

from tidemark import __main__ as cli
from tidemark import registry
from tidemark.plans import run
from tidemark.sources import settings
from tidemark.sources.series import read_series

PACKAGE = {
    "far_market/__init__.py": "",
    "far_market/rewards.py": """
        import numpy as np

        RATE = 3.0

        def punish(pdf_batches):
            for pdf in pdf_batches:
                pdf["reward"] = -np.abs(pdf["y"] - pdf["prediction"]) * RATE
                yield pdf[["pos", "reward"]]
    """,
    "far_market/plugins.py": """
        from .rewards import punish

        def distance(frame, max_steps=6300, limit=0.5):
            return frame.select("pos", "y", "prediction").filter(frame.pos < max_steps).mapInPandas(punish, "pos long, reward double")

        distance.plugin_params = {"max_steps": 6300, "limit": 0.5}
        distance.score = lambda errors: {"worst": errors["mse"]}

        class Plugin:
            plugin_params = {"shift": 1.0, "output": "Prediction"}

            def __init__(self):
                self.params = dict(self.plugin_params)

            def set_params(self, **given):
                self.params.update(given)

            def __call__(self, frame, policy, features="state", output="Prediction"):
                from pyspark.sql import functions as F
                return frame.withColumn(output, F.array(F.lit(self.params["shift"]))).withColumn(output, F.col(output)[0])

        not_callable = 7
    """,
    "far_market-1.0.dist-info/METADATA": "Metadata-Version: 2.1\nName: far-market\nVersion: 1.0\n",
    "far_market-1.0.dist-info/entry_points.txt": """
        [tidemark.environments]
        distance = far_market.plugins:distance
        prediction = far_market.plugins:distance

        [tidemark.agents]
        shifted = far_market.plugins:Plugin
        broken = far_market.absent:Plugin
        odd = far_market.plugins:not_callable
    """,
}


@pytest.fixture
def far_package(tmp_path, monkeypatch):
    root = tmp_path / "site"
    for name, text in PACKAGE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(textwrap.dedent(text).lstrip("\n"))
    monkeypatch.syspath_prepend(str(root))  # the driver's only: workers have PYTHONPATH
    yield root
    registry.forget()
    for name in [m for m in sys.modules if m.partition(".")[0] == "far_market"]:
        del sys.modules[name]


def test_entry_points(far_package):
    f, params = registry.load_plugin("environments", "distance")
    assert f.__name__ == "distance" and params == ["max_steps", "limit"] and registry.get_plugin_params("environments", "distance")["limit"] == 0.5
    assert {"distance", "prediction", "custom"} <= set(registry.names("environments")) and "broken" in registry.names("agents")
    assert registry.load_plugin("environments", "prediction")[0].__module__ == "tidemark.builtin"  # own names come first
    for name in ("nobody", "broken", "odd"):
        with pytest.raises(ImportError, match=name):
            registry.load_plugin("agents", name)
    with pytest.raises(ImportError):
        registry.load_plugin("agents", "distance")  # another group's
    with pytest.raises(ValueError):
        registry.register("nothing", "x")


def test_names_go_with_the_package(far_package):
    registry.load_plugin("environments", "distance")
    registry.forget()
    sys.path.remove(str(far_package))
    with pytest.raises(ImportError):
        registry.load_plugin("environments", "distance")


def test_executors_get_the_package(spark, far_package):
    """The plugin's functions run in Python workers that can't import its package from where it is installed."""
    found, _ = registry.load_plugin("environments", "distance")
    registry.ship(spark, "environments", "distance")
    registry.ship(spark, "environments", "distance")  # once is enough
    registry.ship(spark, "environments", "prediction")  # nothing to bring
    rows = spark.createDataFrame([(0, 1.0, 3.0), (1, 2.0, 2.5)], "pos long, y double, prediction double")
    assert sorted(map(tuple, found(rows, max_steps=9).collect())) == [(0, -6.0), (1, -1.5)]


def test_modules_of_one_file_and_archives_are_shipped(tmp_path, monkeypatch):
    (tmp_path / "lone_rule.py").write_text("X = 1\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    import zipfile

    path = registry._zipped("lone_rule")
    assert zipfile.ZipFile(path).namelist() == ["lone_rule.py"]
    monkeypatch.syspath_prepend(path)
    sys.modules.pop("lone_rule")
    (tmp_path / "lone_rule.py").unlink()
    assert registry._zipped("lone_rule") is None  # from an archive that is on the path already
    sys.modules.pop("lone_rule")


def csv(path, rows):
    path.write_text("".join(",".join(map(str, r)) + "\n" for r in rows))
    return str(path)


def test_an_installed_environment_trains(spark, far_package, tmp_path, monkeypatch):
    monkeypatch.setenv("TIDEMARK_LOG", str(tmp_path / "run.log"))
    rng = np.random.default_rng(2)
    x, y = (csv(tmp_path / f"{n}.csv", rng.random((30, w)).round(4).tolist()) for n, w in (("x", 2), ("y", 1)))
    out = lambda n: str(tmp_path / n)
    args = [x, "-ytf", y, "--no-headers", "-e", "1", "--hidden", "4", "--k_epochs", "1", "-sm", out("net"), "-sl", out("log.json"), "-sc", out("conf.json"), "-ef", out("acted")]
    losses = {}
    for env in ("prediction", "distance"):
        assert cli.main([*args, "-ep", env]) == 0
        report = settings.load_config(out("log.json"))
        losses[env] = report["loss"]
    assert losses["prediction"] != losses["distance"] and set(report["training_fitness"]) == {"worst"}
    saved = settings.load_config(out("conf.json"))
    assert saved["environment_plugin"] == "distance" and "limit" not in saved
    assert cli.main([x, "-ytf", y, "--no-headers", "-lm", out("net"), "-ef", out("acted"), "-ap", "shifted", "--shift", "4"]) == 0
    assert {r.Prediction for r in read_series(spark, out("acted")).frame.collect()} == {4.0}
    assert cli.main([*args, "-ep", "nowhere"]) == 1


def test_fitness_is_the_environments(spark, tmp_path):
    from tidemark import builtin, policies
    from tidemark.operators import network

    rows = spark.createDataFrame([(i, [float(i)], 2.0 * i) for i in range(5)], "pos long, state array<double>, y double")
    policy = policies.Layers([network.Layer(np.ones((1, 1)), np.zeros(1))], {})
    assert run.evaluate(rows, policy, 4, builtin.custom) == (1.5, 3.5)
    assert run.evaluate(rows, policy, 4, builtin.prediction) == run.evaluate(rows, policy, 4) == 1 / 1.5
    config = {"environment_plugin": "custom", "max_steps": 3}
    env = run.environment(spark, config)
    assert env.score({"mae": 1, "mse": 2, "fitness": 3}) == (1, 2)
    acted = rows.withColumnRenamed("state", "prediction")
    assert [r.reward for r in env(acted).orderBy("pos").collect()] == [0, 2, 4, 0]


def market(tmp_path, n=40, account=False):
    first = datetime(2010, 4, 16, 18)
    rows = []
    for i in range(n):
        close = 1.3 + 0.001 * ((i * 7) % 11)
        at = (first + timedelta(hours=i)).strftime("%d/%m/%Y %H:%M")
        rows.append([at, close, close - 0.0005, close + 0.0005, *([i % 3 and 1, 10_000 + i, 10_000 + i - (i == 6)] if account else [])])
    names = ["date", "close", "low", "high", *(["order_status", "equity", "balance"] if account else [])]
    return csv(tmp_path / "market.csv", [names, *rows]), rows


def test_the_rule_runs_from_the_command_line(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("TIDEMARK_LOG", str(tmp_path / "run.log"))
    path, rows = market(tmp_path)
    out = lambda n: str(tmp_path / n)
    args = [path, "-ap", "dummy_automation", "-ef", out("orders"), "-sl", out("log.json"), "-sc", out("conf.json")]
    dates = ["--buy_dates", "16/04/2010 20:00,17/04/2010 03:00", "--sell_dates", "17/04/2010 00:00"]
    assert cli.main([*args, *dates, "--capital_risk", "0.5", "--leverage", "10"]) == 0
    report = settings.load_config(out("log.json"))
    profit = 0.0
    for at, kind in ((2, "buy"), (6, "sell"), (9, "buy")):
        (_, opened, _, _), (_, _, low, high) = rows[at], rows[at + 1]
        profit += (low - opened if kind == "buy" else opened - (high + 0.001)) * 10_000 * 0.5 * 10
    assert report["orders"] == report["num_closes"] == 3 and report["unbalanced"] == 0 and report["balance"] == 10_000
    assert report["profit"] == pytest.approx(profit)
    found = read_series(spark, out("orders")).frame.orderBy("pos").collect()
    assert [(r.opened_at, r.action, r.closed_at, r.volume) for r in found] == [(2, 1, 3, 50_000), (6, 2, 7, 50_000), (9, 1, 10, 50_000)]
    saved = settings.load_config(out("conf.json"))
    assert (saved["capital_risk"], saved["leverage"], saved["agent_plugin"]) == (0.5, 10, "dummy_automation")
    assert cli.main(args) == 0 and settings.load_config(out("log.json"))["orders"] == 1  # the default dates: one is in the file
    assert cli.main([*args, "-lm", out("net")]) == 1  # it has no policy to load


def test_the_rule_sees_the_files_account(spark, tmp_path):
    path, rows = market(tmp_path, account=True)
    config = {"x_train_file": path, "headers": True, "evaluate_file": str(tmp_path / "o"), "agent_plugin": "dummy_automation", "buy_dates": [rows[3][0]], "sell_dates": [rows[9][0]], "capital_risk": 0.1, "leverage": 1}
    report = run.train_and_evaluate(spark, config)
    assert (report["orders"], report["unbalanced"], report["num_closes"]) == (2, 1, 1)
    assert report["equity"] == 10_010  # the run ends with the row after the last order's


def test_what_the_rule_needs(spark, tmp_path):
    config = {"headers": True, "evaluate_file": str(tmp_path / "o"), "agent_plugin": "dummy_automation"}
    with pytest.raises(ValueError, match="high"):
        run.train_and_evaluate(spark, config | {"x_train_file": csv(tmp_path / "a.csv", [["date", "close", "low"], ["16/04/2010 20:00", 1, 1]])})
    with pytest.raises(ValueError, match="date"):
        run.train_and_evaluate(spark, config | {"x_train_file": csv(tmp_path / "b.csv", [["close", "low", "high"], [1, 1, 1]])})


def test_cells_with_line_breaks(spark, tmp_path):
    (tmp_path / "q.csv").write_text('k,note\n1,"two\nlines"\n2,"a ""quoted"" word, and a comma"\n3,plain\n')
    rows = read_series(spark, str(tmp_path / "q.csv"), multiline=True).frame.orderBy("pos").collect()
    assert [(r.k, r.note) for r in rows] == [(1, "two\nlines"), (2, 'a "quoted" word, and a comma'), (3, "plain")]


def test_the_module_runs_as_a_program():
    done = subprocess.run([sys.executable, "-m", "tidemark", "--epochs", "x"], capture_output=True, text=True, cwd=str(registry.Path(__file__).parents[1]), timeout=120)
    assert done.returncode == 2 and "invalid int value" in done.stderr
