"""Evolution of network topologies: genomes as tables, a population scored in one plan.

A genome is a set of rows in ``connections`` (genome_id, innovation, src, dst, src_depth, dst_depth, weight,
enabled). Innovations and nodes are historical: the same pair of nodes has the same innovation, and the
node that splits an innovation is the same one, in every genome and generation. Nodes have depths, inputs 0,
outputs 1, a split the middle of what it splits; connections lead to greater depths only, so networks
never have cycles and no graph is searched.

A generation is joins and group-bys: fitness from one pass over the distinct rows (each task adds up every
genome's errors; what is broadcast is a block of genomes of bounded size), distances to the species'
representatives by a join on innovation, ranks within a species by a range sort, crossover by a join of two
parents' rows on innovation, and mutations by hashes of (seed, generation, genome, place), so that a seed
repeats its run. Only the species' totals, a row each, come to the driver, which deals out the offspring.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import inverse
from ..sources.scratch import Workspace
from .position import with_position

CONNECTION = "innovation long, src long, dst long, src_depth double, dst_depth double, weight double, enabled boolean"
COLUMNS = [c.split()[0] for c in CONNECTION.split(", ")]
BLOCK = 1 << 20  # connections that are broadcast at once
ROWS, TEAM = 1024, 64  # rows and genomes of one shape that are evaluated at once
BEST = 1e300  # a fitness that stands for an infinite one in sums
Fitness = Callable[[Column, Column], Column]  # mean absolute and mean squared error -> fitness, larger is better


@dataclass(frozen=True)
class EvolutionParams:
    population: int = 150
    seed: int = 0
    max_steps: int = 6300
    islands: int = 1
    migrate_every: int = 5
    threshold: float = 3.0
    max_species: int = 16  # of an island
    disjoint_weight: float = 1.0
    weight_weight: float = 0.5
    survivors: float = 0.3
    stagnation: int = 15
    crossover: float = 0.75
    stay_disabled: float = 0.75
    mutate: float = 0.8
    replace: float = 0.1
    power: float = 0.5
    add_connection: float = 0.3
    add_node: float = 0.1


class Connection(NamedTuple):
    innovation: int
    src: int
    dst: int
    src_depth: float
    dst_depth: float
    weight: float
    enabled: bool


@dataclass(frozen=True)
class Graph:
    """One genome: nodes 0 .. inputs - 1 are the inputs, the next one is constantly 1, then the outputs."""

    inputs: int
    outputs: int
    connections: Sequence[Connection]

    def nodes(self) -> list[int]:
        return sorted({*range(self.inputs + 1 + self.outputs), *(n for c in self.connections for n in (c.src, c.dst))})

    def evaluate(self, x: np.ndarray) -> np.ndarray:
        """Outputs (rows, outputs): each node is the tanh of what its enabled connections bring."""
        value = self._values(x, [c.weight for c in self.connections])
        nothing = np.zeros(len(x))
        return np.column_stack([value.get(self.inputs + 1 + k, nothing) for k in range(self.outputs)])

    def first_outputs(self, x: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """First outputs (rows, genomes) of genomes that have these connections with weights of their own."""
        value = self._values(x[:, :, None], list(weights.T))
        return np.broadcast_to(value.get(self.inputs + 1, np.zeros((1, 1))), (len(x), len(weights)))

    def _values(self, x: np.ndarray, weights: Sequence) -> dict[int, np.ndarray]:
        """What each node gives; weights: of each connection, a number or one of each genome."""
        depth = {c.dst: c.dst_depth for c in self.connections}
        into: dict[int, list[tuple]] = {}
        for c, w in zip(self.connections, weights, strict=True):
            if c.enabled:
                into.setdefault(c.dst, []).append((c.src, w))
        value = {i: x[:, i] for i in range(self.inputs)} | {self.inputs: np.ones((len(x), *x.shape[2:]))}
        nothing = np.zeros((len(x), *x.shape[2:]))
        for node in sorted(depth, key=lambda n: (depth[n], n)):
            total = nothing
            for src, w in into.get(node, ()):
                total = total + w * value.get(src, nothing)
            value[node] = np.tanh(total)
        return value


def _unit(*of) -> Column:
    h = F.xxhash64(*[c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(c) for c in of])
    return (F.pmod(h, F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _normal(*of) -> Column:
    return F.sqrt(-2 * F.ln(_unit(*of, 1001))) * F.cos(F.lit(2 * np.pi) * _unit(*of, 1002))


def initial(spark: SparkSession, inputs: int, outputs: int, params: EvolutionParams) -> DataFrame:
    """A population whose genomes connect each input, and the constant, with each output."""
    n = (inputs + 1) * outputs
    rows = spark.range(params.population).select(F.col("id").alias("genome_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("innovation"))
    src, dst = F.col("innovation") % (inputs + 1), F.floor(F.col("innovation") / (inputs + 1)) + (inputs + 1)
    weight = _normal("genome_id", "innovation", params.seed)
    return rows.select("genome_id", "innovation", src.alias("src"), dst.alias("dst"), F.lit(0.0).alias("src_depth"), F.lit(1.0).alias("dst_depth"), weight.alias("weight"), F.lit(True).alias("enabled"))


def graphs(connections: DataFrame, inputs: int, outputs: int) -> dict[int, Graph]:
    """The genomes of a bounded table, brought to the driver."""
    out: dict[int, list[Connection]] = {}
    for r in connections.orderBy("genome_id", "innovation").select("genome_id", *COLUMNS).collect():
        out.setdefault(r.genome_id, []).append(Connection(*r[1:]))
    return {g: Graph(inputs, outputs, links) for g, links in out.items()}


def predict(df: DataFrame, graph: Graph, features: str, output: str = "Prediction") -> DataFrame:
    """df with the network's output array; a null vector gives null."""

    @F.pandas_udf("array<double>")
    def batch(vectors):
        import pandas as pd

        at = np.flatnonzero(vectors.notna())
        out = [None] * len(vectors)
        if len(at):
            for i, found in zip(at, graph.evaluate(np.stack(vectors.iloc[at].to_numpy())), strict=True):
                out[i] = found
        return pd.Series(out, dtype=object)

    return df.withColumn(output, batch(F.col(features)))


def errors(frame: DataFrame, connections: DataFrame, inputs: int, outputs: int) -> DataFrame:
    """(genome_id, n, mae, mse) of every genome's first output against y, over all rows (state, y); rows
    with a null state or y don't count. Equal rows are scored once and count as often as they come. A block
    of genomes, about BLOCK connections, is broadcast at a time; a usual population is one block, and one
    pass."""
    rows = frame.select("state", "y").filter("state IS NOT NULL AND y IS NOT NULL")
    rows = rows.groupBy("state", "y").agg(F.count(F.lit(1)).alias("times"))
    blocks = -(-connections.count() // BLOCK)
    parts = []
    for block in range(blocks):
        own = connections.filter(F.pmod(F.xxhash64("genome_id"), F.lit(blocks)) == block)
        sent = frame.sparkSession.sparkContext.broadcast(graphs(own, inputs, outputs))
        parts.append(rows.mapInPandas(_adder(sent), "genome_id long, n long, a double, s double"))
    if not parts:
        return frame.sparkSession.createDataFrame([], "genome_id long, n long, mae double, mse double")
    sums = reduce(DataFrame.union, parts).groupBy("genome_id").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("s").alias("s"))
    return sums.select("genome_id", "n", (F.col("a") / F.col("n")).alias("mae"), (F.col("s") / F.col("n")).alias("mse"))


def _adder(sent):
    def run(batches) -> Iterator:
        import pandas as pd

        block = sent.value
        alike: dict[tuple, list[int]] = {}  # genomes, by number, whose graphs differ in weights alone
        for k, graph in enumerate(block.values()):
            alike.setdefault(tuple((c.src, c.dst, c.dst_depth, c.enabled) for c in graph.connections), []).append(k)
        every = list(block.values())
        teams = [(every[own[0]], np.array(own), np.array([[c.weight for c in every[k].connections] for k in own])) for own in alike.values()]
        n, total = 0, np.zeros((len(block), 2))
        for pdf in batches:
            for at in range(0, len(pdf), ROWS):
                part = pdf.iloc[at : at + ROWS]
                x, y, times = np.stack(part["state"].to_numpy()), part["y"].to_numpy()[:, None], part["times"].to_numpy()
                n += int(times.sum())
                for graph, own, weights in teams:
                    for first in range(0, len(own), TEAM):
                        gap = np.abs(graph.first_outputs(x, weights[first : first + TEAM]) - y)
                        mine = own[first : first + TEAM]
                        total[mine, 0] += times @ gap
                        total[mine, 1] += times @ (gap * gap)
        if n:
            yield pd.DataFrame({"genome_id": list(block), "n": n, "a": total[:, 0], "s": total[:, 1]})

    return run


def score(frame: DataFrame, connections: DataFrame, inputs: int, outputs: int, fitness: Fitness | None = None) -> DataFrame:
    """(genome_id, fitness): without another measure the inverse of the mean absolute error. Rounded to 12
    decimals of the errors, as tasks may add up in any order."""
    found = errors(frame, connections, inputs, outputs)
    mae, mse = F.round("mae", 12), F.round("mse", 12)
    value = inverse(mae) if fitness is None else fitness(mae, mse)
    return found.select("genome_id", F.least(F.coalesce(F.nanvl(value, F.lit(None)), F.lit(0.0)), F.lit(BEST)).alias("fitness"))


def distances(connections: DataFrame, representatives: DataFrame, params: EvolutionParams) -> DataFrame:
    """(genome_id, species_id, distance) of genomes and representatives (species_id, innovation, weight) that
    share an innovation: what they don't share, for each connection of the larger one, and how far apart
    the shared weights are. Genomes that share nothing with any are farther than all."""
    other = representatives.select("species_id", "innovation", F.col("weight").alias("_w"))
    own = connections.groupBy("genome_id").agg(F.count(F.lit(1)).alias("_n"))
    held = representatives.groupBy("species_id").agg(F.count(F.lit(1)).alias("_m"))
    met = connections.join(F.broadcast(other), "innovation").groupBy("genome_id", "species_id").agg(F.count(F.lit(1)).alias("_both"), F.avg(F.abs(F.col("weight") - F.col("_w"))).alias("_apart"))
    rows = met.join(own, "genome_id").join(F.broadcast(held), "species_id")
    loose = (F.col("_n") + F.col("_m") - 2 * F.col("_both")) / F.greatest("_n", "_m")
    return rows.select("genome_id", "species_id", (params.disjoint_weight * loose + params.weight_weight * F.round("_apart", 12)).alias("distance"))


@dataclass
class Species:
    species_id: int
    island: int
    best: float = -np.inf
    improved: int = 0


def speciate(connections: DataFrame, scored: DataFrame, representatives: DataFrame | None, first_id: int, params: EvolutionParams, keep) -> tuple[DataFrame, DataFrame, int]:
    """(genome_id, island, fitness, species_id), representatives (species_id, island, innovation, weight) and
    the next free species id. Genomes join the nearest species within the threshold; of those left over
    the fittest of each island founds one, until none is left or an island has max_species, whose
    remaining genomes join the nearest."""
    per_island = params.population // params.islands
    island = F.least(F.floor(F.col("genome_id") / per_island), F.lit(params.islands - 1)).cast("int")
    rows = keep(connections.select("genome_id", "innovation", "weight").withColumn("island", island), "genes")
    every = scored.withColumn("island", island)
    known = representatives
    while True:
        if known is not None:
            near = distances(rows, known, params).join(F.broadcast(known.select("species_id", F.col("island").alias("_i")).distinct()), "species_id")
            near = near.join(every.select("genome_id", "island"), "genome_id").filter("island = _i")
            full = known.select("species_id", "island").distinct().groupBy("island").agg((F.count(F.lit(1)) >= params.max_species).alias("_full"))
            near = near.join(F.broadcast(full), "island").filter(F.col("_full") | (F.col("distance") < params.threshold))
            best = near.groupBy("genome_id").agg(F.min(F.struct("distance", "species_id")).alias("_near")).select("genome_id", F.col("_near.species_id").alias("species_id"))
            assigned = keep(every.join(best, "genome_id", "left"), "species")
        else:
            assigned = every.withColumn("species_id", F.lit(None).cast("long"))
        left = assigned.filter("species_id IS NULL").groupBy("island").agg(F.max(F.struct("fitness", (-F.col("genome_id")).alias("g"))).alias("_b"))
        founders = [(r.island, -r._b.g) for r in left.orderBy("island").collect()]  # a row an island
        if not founders:
            return assigned, known, first_id
        numbered = [(first_id + k, g) for k, (_, g) in enumerate(founders)]
        first_id += len(numbered)
        new = rows.join(F.broadcast(rows.sparkSession.createDataFrame(numbered, "species_id long, genome_id long")), "genome_id").select("species_id", "island", "innovation", "weight")
        known = keep(new if known is None else known.unionByName(new), "representatives")


def quotas(found: list[tuple[Species, int, float]], n: int) -> dict[int, int]:
    """Offspring of each species (species, members, mean fitness): in proportion to the mean, at least one
    each while there is room, by largest remainders."""
    if not found:
        return {}
    found = sorted(found, key=lambda x: (-x[2], x[0].species_id))[:n]
    mean = np.array([max(0.0, m) for _, _, m in found])
    share = mean / mean.sum() if mean.sum() > 0 else np.full(len(found), 1 / len(found))
    room = n - len(found)
    whole = np.floor(share * room).astype(int)
    rest = np.argsort(-(share * room - whole), kind="stable")[: room - whole.sum()]
    whole[rest] += 1
    return {s.species_id: 1 + int(k) for (s, _, _), k in zip(found, whole, strict=True)}


def offspring(assigned: DataFrame, plan: list[tuple[int, int, int, int]], generation: int, params: EvolutionParams) -> DataFrame:
    """(child, better, other, same): the parents of each new genome. plan: (species, its first child,
    children, members). The first child of a species is its best genome, the same."""
    spark = assigned.sparkSession
    ranked = with_position(assigned.withColumn("_low", -F.col("fitness")), "_low", "genome_id", by=("species_id",), name="_rank").select("species_id", "_rank", "genome_id")
    # a row for each child and what it needs to know of its species; the plan has a row a species
    table = spark.createDataFrame(plan, "species_id long, _first long, _n long, _members long").filter("_n > 0")
    rows = table.select("species_id", "_first", "_members", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)).alias("child"))
    fit_to = F.greatest(F.lit(1), F.ceil(F.col("_members") * params.survivors))
    pick = lambda k: F.floor(_unit("child", params.seed, generation, k) * fit_to)
    same = F.col("child") == F.col("_first")
    crossed = _unit("child", params.seed, generation, 13) < params.crossover
    a, b = pick(11), F.when(crossed, pick(12)).otherwise(pick(11))
    rows = rows.select("species_id", "child", same.alias("same"), F.when(same, 0).otherwise(F.least(a, b)).alias("_a"), F.when(same, 0).otherwise(F.greatest(a, b)).alias("_b"))
    for end, name in (("_a", "better"), ("_b", "other")):
        rows = rows.join(ranked.select("species_id", F.col("_rank").alias(end), F.col("genome_id").alias(name)), ["species_id", end])
    return rows.select("child", "better", "other", "same")


def crossover(connections: DataFrame, children: DataFrame, generation: int, params: EvolutionParams) -> DataFrame:
    """connections of children (child, better, other, same): those of the better parent, shared ones with
    either's weight; what is disabled in a parent mostly stays so. Weights of others than the same mutate."""
    mine = connections.withColumnRenamed("genome_id", "better")
    theirs = connections.select(F.col("genome_id").alias("other"), "innovation", F.col("weight").alias("_w"), F.col("enabled").alias("_e"))
    rows = children.join(mine, "better").join(theirs, ["other", "innovation"], "left")
    u = lambda k: _unit("child", "innovation", params.seed, generation, k)
    both = F.col("_w").isNotNull()
    weight = F.when(both & (u(21) < 0.5), F.col("_w")).otherwise(F.col("weight"))
    off = ~F.col("enabled") | F.coalesce(~F.col("_e"), F.lit(False))
    enabled = F.when(F.col("better") == F.col("other"), F.col("enabled")).otherwise(~off | (u(22) >= params.stay_disabled))
    noise = _normal("child", "innovation", params.seed, generation)
    moved = F.when(u(23) >= params.mutate, weight).when(u(24) < params.replace, noise).otherwise(weight + params.power * noise)
    return rows.select(F.col("child").alias("genome_id"), "same", "innovation", "src", "dst", "src_depth", "dst_depth", F.when(F.col("same"), F.col("weight")).otherwise(moved).alias("weight"), enabled.alias("enabled"))


@dataclass
class History:
    """Known splits (innovation, node) and pairs (src, dst, innovation), and how many there are."""

    splits: DataFrame
    pairs: DataFrame
    n_nodes: int
    n_pairs: int


def _numbered(rows: DataFrame, known: DataFrame, keys: list[str], first: int, name: str, keep) -> tuple[DataFrame, int]:
    """known, and rows whose keys it lacks, numbered in the order of the keys from ``first`` on."""
    new = rows.select(*keys).distinct().join(known, keys, "left_anti")
    fresh = keep(with_position(new, *keys, name=name).withColumn(name, F.col(name) + first), "numbers")
    return keep(known.unionByName(fresh), "history"), first + fresh.count()


def mutate_structure(genes: DataFrame, history: History, generation: int, params: EvolutionParams, keep) -> DataFrame:
    """genes (with ``same``) after new nodes and connections: a node splits a connection, which is disabled;
    a connection joins two nodes of a genome that aren't joined yet."""
    genes = keep(genes, "crossed")
    u = lambda k, *of: _unit("genome_id", *of, params.seed, generation, k)
    middle = (F.col("src_depth") + F.col("dst_depth")) / 2
    splittable = genes.filter(~F.col("same") & F.col("enabled") & (u(31) < params.add_node) & (middle > F.col("src_depth")) & (middle < F.col("dst_depth")))
    facts = F.struct("innovation", "src", "dst", "src_depth", "dst_depth", "weight")
    chosen = splittable.groupBy("genome_id").agg(F.min_by(facts, u(32, "innovation")).alias("c")).select("genome_id", "c.*")
    history.splits, history.n_nodes = _numbered(chosen, history.splits, ["innovation"], history.n_nodes, "node", keep)
    ends = genes.select("genome_id", F.col("dst").alias("node")).distinct()
    split = keep(chosen.join(history.splits, "innovation").join(ends, ["genome_id", "node"], "left_anti"), "split")
    middle = (F.col("src_depth") + F.col("dst_depth")) / 2
    halves = split.select("genome_id", "src", F.col("node").alias("dst"), "src_depth", middle.alias("dst_depth"), F.lit(1.0).alias("weight")).unionByName(
        split.select("genome_id", F.col("node").alias("src"), "dst", middle.alias("src_depth"), "dst_depth", "weight")
    )
    places = genes.filter(~F.col("same") & (u(33) < params.add_connection))
    nodes = places.select("genome_id", F.explode(F.array(F.struct(F.col("src").alias("n"), F.col("src_depth").alias("d")), F.struct(F.col("dst").alias("n"), F.col("dst_depth").alias("d")))).alias("p")).distinct()
    pick = lambda k, ok: F.min(F.when(ok, F.struct(u(k, "p.n").alias("u"), "p")))
    joined = nodes.groupBy("genome_id").agg(pick(34, F.col("p.d") < 1).alias("a"), pick(35, F.col("p.d") > 0).alias("b")).filter("a.p.d < b.p.d")
    joined = joined.select("genome_id", F.col("a.p.n").alias("src"), F.col("b.p.n").alias("dst"), F.col("a.p.d").alias("src_depth"), F.col("b.p.d").alias("dst_depth"), _normal("genome_id", params.seed, generation, 36).alias("weight"))
    joined = joined.join(genes.select("genome_id", "src", "dst"), ["genome_id", "src", "dst"], "left_anti")
    new = keep(halves.unionByName(joined), "new-genes")
    history.pairs, history.n_pairs = _numbered(new, history.pairs, ["src", "dst"], history.n_pairs, "innovation", keep)
    added = new.join(history.pairs, ["src", "dst"]).withColumn("enabled", F.lit(True))
    off = split.select("genome_id", "innovation", F.lit(True).alias("_off"))
    kept = genes.join(off, ["genome_id", "innovation"], "left").withColumn("enabled", F.col("enabled") & F.col("_off").isNull())
    return kept.select("genome_id", *COLUMNS).unionByName(added.select("genome_id", *COLUMNS))


def evolve(frame: DataFrame, inputs: int, generations: int, params: EvolutionParams, fitness: Fitness | None = None, outputs: int = 1) -> tuple[Graph, list[float]]:
    """(best genome of all, best fitness of each generation). frame: pos, state, y; the first max_steps rows
    count."""
    spark = frame.sparkSession
    rows = frame.filter(F.col("pos") < params.max_steps)
    work = Workspace(spark, "evolution")
    try:
        return _evolve(rows, inputs, outputs, generations, params, fitness, work)
    finally:
        work.drop()


def _evolve(rows: DataFrame, inputs: int, outputs: int, generations: int, params: EvolutionParams, fitness: Fitness | None, work: Workspace) -> tuple[Graph, list[float]]:
    spark, keep = rows.sparkSession, work.keep
    connections = keep(initial(spark, inputs, outputs, params), "connections")
    first_pairs = connections.filter("genome_id = 0").select("src", "dst", "innovation")
    history = History(spark.createDataFrame([], "innovation long, node long"), keep(first_pairs, "history"), inputs + 1 + outputs, (inputs + 1) * outputs)
    known: dict[int, Species] = {}
    representatives, free = None, 0
    best: tuple[float, Graph | None] = (-np.inf, None)
    curve: list[float] = []
    for generation in range(generations):
        scored = keep(score(rows, connections, inputs, outputs, fitness), "scored")
        assigned, representatives, free = speciate(connections, scored, representatives, free, params, keep)
        assigned = keep(assigned, "assigned")
        top = F.max(F.struct("fitness", (-F.col("genome_id")).alias("g"))).alias("top")
        facts = assigned.groupBy("species_id", "island").agg(F.count(F.lit(1)).alias("n"), F.avg("fitness").alias("mean"), top).orderBy("species_id").collect()  # a row a species
        if not facts:
            raise ValueError("x_train_data is empty.")
        lead = max(facts, key=lambda r: (r.top.fitness, r.top.g))
        curve.append(lead.top.fitness)
        if lead.top.fitness > best[0]:
            [graph] = graphs(connections.filter(F.col("genome_id") == -lead.top.g), inputs, outputs).values()
            best = (lead.top.fitness, graph)
        if generation + 1 == generations:
            break
        plan, migrants = [], []
        sizes = [params.population // params.islands] * params.islands
        sizes[-1] += params.population - sum(sizes)
        leaders = {i: max((r for r in facts if r.island == i), key=lambda r: (r.top.fitness, r.top.g)) for i in {r.island for r in facts}}
        at = 0
        for i, size in enumerate(sizes):
            own = []
            for r in (r for r in facts if r.island == i):
                s = known.setdefault(r.species_id, Species(r.species_id, i))
                if r.top.fitness > s.best:
                    s.best, s.improved = r.top.fitness, generation
                if generation - s.improved < params.stagnation or r is leaders[i]:
                    own.append((s, r.n, r.mean))
            come = params.islands > 1 and (generation + 1) % params.migrate_every == 0
            for s, n in quotas(own, size - come).items():
                plan.append((s, at, n, next(r.n for r in facts if r.species_id == s)))
                at += n
            if come:
                migrants.append((at, -leaders[(i - 1) % params.islands].top.g))
                at += 1
        children = offspring(assigned, plan, generation, params)
        if migrants:
            children = children.unionByName(spark.createDataFrame([(c, g, g, True) for c, g in migrants], "child long, better long, other long, same boolean"))
        genes = crossover(connections, keep(children, "children"), generation, params)
        connections = keep(mutate_structure(genes, history, generation, params, keep), "connections")
        held = spark.createDataFrame([(s,) for s, *_ in plan], "species_id long")
        representatives = keep(representatives.join(F.broadcast(held), "species_id", "left_semi"), "representatives")
    return best[1], curve
