"""Evolved networks against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import __main__ as cli
from tidemark import builtin, policies, registry
from tidemark.operators import evolution, genome
from tidemark.operators.evolution import Connection, EvolutionParams, Graph
from tidemark.sources import settings
from tidemark.sources.scratch import Workspace

SMALL = EvolutionParams(population=12, seed=3, add_node=0.5, add_connection=0.6, threshold=0.6, max_species=3)


def episode(spark, n=120):
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (n, 2)).round(3)
    y = np.tanh(0.8 * x[:, 0] - 0.5 * x[:, 1] + 0.1)
    return spark.createDataFrame([(i, v, float(t)) for i, (v, t) in enumerate(zip(x.tolist(), y, strict=True))], "pos long, state array<double>, y double"), x, y


def plain_output(graph, x):
    """The first output by recursion over connections."""

    def value(node):
        if node <= graph.inputs:
            return x[node] if node < graph.inputs else 1.0
        return math.tanh(sum(c.weight * value(c.src) for c in graph.connections if c.enabled and c.dst == node))

    return value(graph.inputs + 1)


def generations(spark, frame, params, n):
    """Tables of n generations, stepped as evolve does with one species an island."""
    work = Workspace(spark, "steps")
    now = work.keep(evolution.initial(spark, 2, 1, params), "c")
    history = evolution.History(spark.createDataFrame([], "innovation long, node long"), work.keep(now.filter("genome_id = 0").select("src", "dst", "innovation"), "h"), 4, 3)
    out = [now]
    for g in range(n):
        scored = evolution.score(frame, now, 2, 1).withColumn("species_id", F.lit(0).cast("long"))
        children = work.keep(evolution.offspring(work.keep(scored, "s"), [(0, 0, params.population, params.population)], g, params), "children")
        genes = evolution.crossover(now, children, g, params)
        now = work.keep(evolution.mutate_structure(genes, history, g, params, work.keep), "c")
        out.append(now)
    return out, history


@pytest.fixture(scope="module")
def stepped(spark):
    """Tables of the first generations, and their history."""
    return generations(spark, episode(spark, 20)[0], SMALL, 3)


def test_fitness_of_every_genome_equals_a_plain_loop(spark, monkeypatch, stepped):
    frame, x, y = episode(spark, 40)
    odd = spark.createDataFrame([(90, None, 1.0), (91, [0.0, 0.0], None)], frame.schema)
    last = stepped[0][-1]
    nets = evolution.graphs(last, 2, 1)
    assert len(nets) == 12 and max(len(g.nodes()) for g in nets.values()) > 4
    want = {}
    for g, net in nets.items():
        gaps = [plain_output(net, row) - t for row, t in zip(x, y, strict=True)]
        want[g] = (len(gaps), sum(map(abs, gaps)) / len(gaps), sum(e * e for e in gaps) / len(gaps))
    for block in (evolution.BLOCK, 30):  # one block, and several
        monkeypatch.setattr(evolution, "BLOCK", block)
        found = {r.genome_id: tuple(r)[1:] for r in evolution.errors(frame.union(odd), last, 2, 1).collect()}
        assert {g: pytest.approx(v) for g, v in want.items()} == found
    fitness = {r.genome_id: r.fitness for r in evolution.score(frame, last, 2, 1).collect()}
    assert fitness == pytest.approx({g: 1 / v[1] for g, v in want.items()})
    squared = {r.genome_id: r.fitness for r in evolution.score(frame, last, 2, 1, lambda mae, mse: -mse).collect()}
    assert squared == pytest.approx({g: -v[2] for g, v in want.items()})
    assert evolution.errors(frame, last.limit(0), 2, 1).count() == 0


def test_genomes_stay_sound(stepped):
    """Innovations mean the same pair everywhere, no connection comes twice, none leads back."""
    tables, history = stepped
    rows = [r for t in tables for r in t.collect()]
    pairs, depths = {}, {}
    for r in rows:
        assert pairs.setdefault(r.innovation, (r.src, r.dst)) == (r.src, r.dst)
        assert depths.setdefault(r.src, r.src_depth) == r.src_depth and depths.setdefault(r.dst, r.dst_depth) == r.dst_depth
        assert r.src_depth < r.dst_depth
    assert len({*pairs.values()}) == len(pairs) <= history.n_pairs
    assert sorted(r.innovation for r in history.pairs.collect()) == list(range(history.n_pairs))
    assert sorted(r.node for r in history.splits.collect()) == list(range(4, history.n_nodes)) and history.n_nodes > 4
    for t in tables:
        keys = [(r.genome_id, r.innovation) for r in t.collect()]
        assert len(keys) == len({*keys}) and {g for g, _ in keys} == set(range(12))
    split = tables[-1].filter("not enabled").count()
    assert split > 0


def test_distances_equal_plain_ones(stepped):
    last = stepped[0][-1]
    genes = {}
    for r in last.collect():
        genes.setdefault(r.genome_id, {})[r.innovation] = r.weight
    reps = last.filter("genome_id < 3").select((F.col("genome_id") + 50).alias("species_id"), "innovation", "weight")
    for r in evolution.distances(last, reps, SMALL).collect():
        a, b = genes[r.genome_id], genes[r.species_id - 50]
        both = a.keys() & b.keys()
        want = len(a.keys() ^ b.keys()) / max(len(a), len(b)) + 0.5 * sum(abs(a[i] - b[i]) for i in both) / len(both)
        assert r.distance == pytest.approx(want)


def test_species_are_near_their_representatives(spark, stepped):
    frame, *_ = episode(spark, 10)
    last = stepped[0][-1]
    work = Workspace(spark, "species")
    assigned, reps, free = evolution.speciate(last, work.keep(evolution.score(frame, last, 2, 1), "s"), None, 0, SMALL, work.keep)
    rows = assigned.collect()
    distance = {(r.genome_id, r.species_id): r.distance for r in evolution.distances(last, reps, SMALL).collect()}
    species = {r.species_id for r in rows}
    assert len(rows) == 12 and len(species) == free <= 3
    for r in rows:
        near = min((distance[r.genome_id, s], s) for s in species)
        assert near[1] == r.species_id and (near[0] < SMALL.threshold or len(species) == 3)


def test_crossover_takes_from_parents(spark):
    parents = [(0, 0, 0, 3, 0.0, 1.0, 1.0, True), (0, 1, 1, 3, 0.0, 1.0, 1.0, False), (0, 5, 2, 3, 0.0, 1.0, 1.0, True), (1, 0, 0, 3, 0.0, 1.0, 2.0, True), (1, 1, 1, 3, 0.0, 1.0, 2.0, True), (1, 9, 0, 4, 0.0, 0.5, 2.0, True)]
    table = spark.createDataFrame(parents, f"genome_id long, {evolution.CONNECTION}")
    n = 400
    children = spark.range(n).selectExpr("id AS child", "cast(0 AS long) AS better", "cast(1 AS long) AS other", "false AS same")
    rows = evolution.crossover(table, children, 0, EvolutionParams(mutate=0.0)).collect()
    assert {r.innovation for r in rows} == {0, 1, 5} and len(rows) == 3 * n
    taken = [r.weight for r in rows if r.innovation == 0]
    assert {*taken} == {1.0, 2.0} and 0.4 < taken.count(1.0) / n < 0.6
    assert all(r.weight == 1.0 and r.enabled for r in rows if r.innovation == 5)
    off = sum(not r.enabled for r in rows if r.innovation == 1)
    assert 0.65 < off / n < 0.85
    moved = evolution.crossover(table, children, 0, EvolutionParams(mutate=1.0, replace=0.0, power=0.5)).filter("innovation = 5").toPandas().weight
    assert abs(moved.mean() - 1) < 0.1 and abs(moved.std() - 0.5) < 0.1


def test_quotas():
    s = [evolution.Species(i, 0) for i in range(3)]
    assert evolution.quotas([(s[0], 5, 6.0), (s[1], 5, 3.0), (s[2], 2, 0.0)], 12) == {0: 7, 1: 4, 2: 1}
    assert evolution.quotas([(s[0], 5, 0.0), (s[1], 5, 0.0)], 5) == {0: 3, 1: 2}
    assert evolution.quotas([(x, 1, 1.0) for x in s], 2) == {0: 1, 1: 1} and evolution.quotas([], 4) == {}


def test_evolution_repeats_and_improves(spark):
    """Islands, of which each sends its best genome on after every generation."""
    frame, x, y = episode(spark, 60)
    params = EvolutionParams(population=15, seed=1, islands=3, migrate_every=1, threshold=1.0, max_species=2)
    best, curve = evolution.evolve(frame, 2, 3, params)
    again, curve_again = evolution.evolve(frame, 2, 3, params)
    assert curve == curve_again and best == again
    assert curve == sorted(curve) and curve[-1] > curve[0]  # the best of each species stays
    gaps = [abs(plain_output(best, row) - t) for row, t in zip(x, y, strict=True)]
    assert 1 / (sum(gaps) / len(gaps)) == pytest.approx(curve[-1])
    with pytest.raises(ValueError):
        evolution.evolve(frame.limit(0), 2, 1, params)


def test_information_of_evolved_genomes(stepped):
    last = stepped[0][-1]
    links = last.select("genome_id", F.col("innovation").cast("string").alias("key"), "weight", "enabled")
    nodes = last.select("genome_id", F.col("dst").cast("string").alias("key")).distinct()
    found = {r.genome_id: r for r in genome.total_information(links, nodes).collect()}
    assert len(found) == 12
    for g, net in evolution.graphs(last, 2, 1).items():
        weights = np.array([c.weight for c in net.connections if c.enabled])
        p = np.histogram((weights - weights.min()) / (weights.max() - weights.min()), 50, (0, 1))[0] / len(weights)
        assert found[g].entropy == pytest.approx(-(p[p > 0] * np.log2(p[p > 0])).sum()) and found[g].n_connections == len(net.connections)
        assert found[g].total_information == pytest.approx(found[g].n_connections * found[g].entropy)


def test_evolved_policies_are_saved(spark, tmp_path):
    net = Graph(2, 1, [Connection(0, 0, 3, 0.0, 1.0, 0.5, True), Connection(1, 1, 3, 0.0, 1.0, 9.0, False), Connection(4, 0, 5, 0.0, 0.5, 1.0, True), Connection(5, 5, 3, 0.5, 1.0, -1.0, True)])
    policies.Evolved(net).save(spark, str(tmp_path / "net"))
    policy = policies.load(spark, str(tmp_path / "net"))
    assert policy.net == net and (policy.inputs, policy.outputs) == (2, 1)
    rows = spark.createDataFrame([(0, [0.3, 0.1]), (1, None)], "pos int, state array<double>")
    found = [r.Prediction for r in policies.first_output(rows, policy, "state", "Prediction").orderBy("pos").collect()]
    assert found == [pytest.approx(math.tanh(0.15 - math.tanh(0.3))), None]
    links, nodes = policy.genome(spark)
    assert links.count() == 4 and nodes.count() == 5


def test_a_run_evolves(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("TIDEMARK_LOG", str(tmp_path / "run.log"))
    rng = np.random.default_rng(6)
    for name, width in (("x", 2), ("y", 1)):
        (tmp_path / f"{name}.csv").write_text("".join(",".join(f"{v:.4f}" for v in row) + "\n" for row in rng.random((30, width))))
    path = lambda n: str(tmp_path / n)
    args = [path("x.csv"), "-ytf", path("y.csv"), "--no-headers", "-e", "2", "-op", "neat_p2p", "--population", "8", "--islands", "2", "-sm", path("net"), "-sl", path("log.json"), "-sc", path("conf.json")]
    assert cli.main(args) == 0
    report = settings.load_config(path("log.json"))
    assert report["n_connections"] >= 3 and report["training_fitness"] > 0 and report["loss"] > 0
    assert cli.main([path("x.csv"), "-ytf", path("y.csv"), "--no-headers", "-lm", path("net"), "-ef", path("out")]) == 0
    assert "population" in registry.get_plugin_params("optimizers", "neat") and builtin.neat_p2p.__doc__


def test_errors_of_repeated_rows_and_any_genome_ids(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(rng.normal(0, 1, 2).tolist(), float(rng.normal())) for _ in range(7)]
    many = spark.createDataFrame(rows * 40 + rows[:1] * 500 + [(None, 1.0), ([1.0, 2.0], None)], "state array<double>, y double").repartition(5)
    links = [(g, k, k, 3, 0.0, 1.0, float(rng.normal()), k != 1 or g != 7) for g in (-5, 7, 1 << 40) for k in range(3)]
    genes = spark.createDataFrame(links, f"genome_id long, {evolution.CONNECTION}")
    x, y = (np.array([r[k] for r in rows * 40 + rows[:1] * 500]) for k in (0, 1))
    passes = []
    monkeypatch.setattr(evolution, "_adder", lambda sent, adder=evolution._adder: passes.append(1) or adder(sent))
    found = evolution.errors(many, genes, 2, 1).collect()
    assert len(passes) == 1 and {r.genome_id for r in found} == {-5, 7, 1 << 40}
    for r in found:
        graph = evolution.graphs(genes.filter(f"genome_id = {r.genome_id}"), 2, 1)[r.genome_id]
        gap = graph.evaluate(x)[:, 0] - y
        assert r.n == 780 and r.mae == pytest.approx(np.abs(gap).mean()) and r.mse == pytest.approx((gap * gap).mean())
