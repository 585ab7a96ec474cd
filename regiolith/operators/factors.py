"""Factor graphs from tables: potentials of regions, of similar pairs and of limbs, and learning over all entities.

A graph is long rows, each with its photo.  Variables and regions have names:
region s3 is over the variable of segment 3, p3-5 over those of segments 3 and 5,
l1 over the variable of limb 1, and so on.

    regions   photo, region, vars array<string>
    features  photo, region, feature, state, value      feature: place of its weight
    losses    photo, region, state, value               what a wrong state costs, in training only
    observed  photo, var, state                         null where latent

States count from 0, and in a region's state its first variable varies fastest.
A region's potential is the sum of weight * value over its features.  One photo's
graph fits a task; weights are a bounded array.  Everything is built by Spark, a
photo's messages run in one Python call, and sums over photos are Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regiolith.functions.scalar import ratio
from regiolith.operators.crf import Graph, Region, bethe_counts
from regiolith.operators.small_graphs import spanning_tree
from regiolith.session import packed, per_batch, per_group, reach_workers, settled

FEATURES = ["photo", "region", "feature", "state", "value"]


def segment_name(seg: Column) -> Column:
    return F.concat(F.lit("s"), seg.cast("string"))


def limb_name(limb: Column) -> Column:
    return F.concat(F.lit("l"), limb.cast("string"))


def pair_name(kind: str, a: Column, b: Column) -> Column:
    return F.concat(F.lit(kind), a.cast("string"), F.lit("-"), b.cast("string"))


def rows(df: DataFrame, region: Column, feature: Column, state: Column, value: Column) -> DataFrame:
    """Feature rows; what is zero is left out."""
    out = df.select("photo", region.alias("region"), feature.cast("int").alias("feature"), state.cast("int").alias("state"), value.cast("double").alias("value"))
    return out.filter("value <> 0")


# ---------------------------------------------------------------- potentials of single variables


def bridged(scores: DataFrame, bridge: DataFrame, weight: float, start: int, negative: bool = False, best: bool = False) -> DataFrame:
    """Scores (photo, seg, fine, value) of finer classes, seen through a map (fine, target).

    A feature for each fine class with a target, in the order of the classes.
    negative: what a score lacks of 1 counts against its targets.  best: a feature
    for each target instead, the largest of its scores.  Classes count from 1.
    """
    own = scores.join(bridge, "fine").filter("value <> 0")
    region, state = segment_name(F.col("seg")), F.col("target") - 1
    if best:
        most = own.groupBy("photo", "seg", "target").agg(F.max("value").alias("value"))
        return rows(most, region, F.lit(start) + state, state, weight * F.col("value"))
    value = -weight * (1 - F.col("value")) if negative else weight * F.col("value")
    return rows(own, region, F.lit(start) + F.col("fine") - 1, state, value)


def biases(segments: DataFrame, classes: int, weight: float, start: int, full: bool = False) -> DataFrame:
    """A constant feature for the first class, or for each class.  segments: photo, seg."""
    each = segments.select("photo", "seg", F.explode(F.sequence(F.lit(0), F.lit(classes - 1 if full else 0))).alias("k"))
    return rows(each, segment_name(F.col("seg")), F.lit(start) + F.col("k"), F.col("k"), F.lit(weight))


def by_class(scores: DataFrame, weight: float, start: int) -> DataFrame:
    """A feature for each class (photo, seg, class, value) at its own state."""
    k = F.col("class") - 1
    return rows(scores, segment_name(F.col("seg")), F.lit(start) + k, k, weight * F.col("value"))


def foreground(shares: DataFrame, classes: int, weight: float, start: int, normalised: bool = False) -> DataFrame:
    """One feature: the share outside the foreground (photo, seg, inside, outside) at the first state, the share inside at all others."""
    total = F.col("inside") + F.col("outside")
    pick = lambda c: F.coalesce(F.try_divide(F.col(c), total), F.lit(0.0)) if normalised else F.col(c)
    each = shares.select("photo", "seg", pick("inside").alias("i"), pick("outside").alias("o"), F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("k"))
    return rows(each, segment_name(F.col("seg")), F.lit(start), F.col("k"), weight * F.when(F.col("k") == 0, F.col("o")).otherwise(F.col("i")))


def segment_losses(losses: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """Losses (photo, seg, state from 1, loss), scaled by the segment's share of its photo's area (photo, seg, area) if given."""
    own = losses
    if areas is not None:
        total = areas.groupBy("photo").agg(F.sum("area").alias("whole"))
        own = own.join(areas, ["photo", "seg"]).join(total, "photo").withColumn("loss", F.col("loss") * F.col("area") / F.col("whole"))
    return own.select("photo", segment_name(F.col("seg")).alias("region"), (F.col("state") - 1).cast("int").alias("state"), F.col("loss").alias("value")).filter("value <> 0")


# ---------------------------------------------------------------- potentials of pairs


def similar_pairs(scores: DataFrame, least: float = 0.85, forest: bool = True) -> DataFrame:
    """(photo, s1, s2, p) of more than this similarity; forest: of each photo's pairs a spanning forest of the most similar ones."""
    own = scores.filter(F.col("p") > least).select("photo", "s1", "s2", "p")
    if not forest:
        return own
    kinds = dict(own.dtypes)

    def run(photo, offsets, cols):
        a, b, w = cols["s1"].tolist(), cols["s2"].tolist(), (1 - cols["p"]).tolist()
        kept = [lo + i for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()) for i in sorted(spanning_tree(list(zip(a[lo:hi], b[lo:hi], w[lo:hi]))))]
        return {"photo": np.repeat(photo, np.diff(offsets))[kept], **{c: cols[c][kept] for c in ("s1", "s2", "p")}}

    return per_batch(packed(own, "photo", "s1", "s2", "p"), run, ", ".join(f"{c} {kinds[c]}" for c in ("photo", "s1", "s2", "p")))


def diagonal(classes: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(classes - 1)))


def pair_potentials(pairs: DataFrame, classes: int, weight: float, start: int, full: bool = False) -> DataFrame:
    """Similar pairs (photo, s1, s2, p) rewarded for equal states, by one feature or one a class."""
    each = pairs.select("photo", "s1", "s2", "p", diagonal(classes).alias("k"))
    return rows(each, pair_name("p", F.col("s1"), F.col("s2")), F.lit(start) + (F.col("k") if full else F.lit(0)), F.col("k") * (classes + 1), weight * F.col("p"))


def limb_biases(limbs: DataFrame, classes: int, weight: float, start: int) -> DataFrame:
    """A constant feature a class for each limb (photo, limb)."""
    each = limbs.select("photo", "limb", diagonal(classes).alias("k"))
    return rows(each, limb_name(F.col("limb")), F.lit(start) + F.col("k"), F.col("k"), F.lit(weight))


def limb_losses(limbs: DataFrame, classes: int, loss: float = 10.0) -> DataFrame:
    """The same loss for every class but the observed one (photo, limb, class from 1)."""
    each = limbs.select("photo", "limb", "class", diagonal(classes).alias("state")).filter("state <> class - 1")
    return each.select("photo", limb_name(F.col("limb")).alias("region"), "state", F.lit(loss).alias("value"))


def near_limbs(scores: DataFrame, least: float = 0.01) -> DataFrame:
    """(photo, seg, limb, side, value) of more than this score: which segments a limb is linked with."""
    return scores.filter(F.col("value") > least).select("photo", "seg", "limb", "side", "value")


def limb_segment_potentials(near: DataFrame, classes: int, weight: float, start: int) -> DataFrame:
    """Segments near a limb rewarded for its class, but not for the first one; a feature a limb, counted from 1, a region a side."""
    each = near.select("photo", "seg", "limb", "side", "value", diagonal(classes).alias("k")).filter("k > 0")
    name = F.concat(pair_name("t", F.col("limb"), F.col("seg")), F.lit("-"), F.col("side").cast("string"))
    return rows(each, name, F.lit(start) + F.col("limb") - 1, F.col("k") * (classes + 1), weight * F.col("value"))


def limb_pair_potentials(photos: DataFrame, counts: DataFrame, tree: list[tuple[int, int]], classes: int, never: float, often: float, start: int) -> DataFrame:
    """Pairs of limbs of a tree (from 1): one feature against class pairs never seen together, one for the share of the second limb's class.

    counts: (edge from 1, a, b, n), classes from 1, of the training photos.  Both features belong to the edge.
    """
    spark = photos.sparkSession
    edges = spark.createDataFrame([(i + 1, x, y) for i, (x, y) in enumerate(tree)], "edge int, x int, y int")
    grid = edges.withColumn("a", F.explode(F.sequence(F.lit(1), F.lit(classes)))).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(classes))))
    own = grid.join(counts.select("edge", "a", "b", "n"), ["edge", "a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = own.groupBy("edge", "b").agg(F.sum("n").alias("total"))
    own = own.join(total, ["edge", "b"])
    name, state = pair_name("q", F.col("x"), F.col("y")), (F.col("a") - 1) + classes * (F.col("b") - 1)
    both = F.inline(F.array(
        F.struct((F.lit(start) + 2 * (F.col("edge") - 1)).alias("feature"), F.when(F.col("n") == 0, F.lit(-never)).otherwise(0.0).alias("value")),
        F.struct((F.lit(start + 1) + 2 * (F.col("edge") - 1)).alias("feature"), (often * F.coalesce(ratio(F.col("n"), F.col("total")), F.lit(0.0))).alias("value")),
    ))
    table = own.select(name.alias("region"), state.alias("state"), both).filter("value <> 0")  # as many rows as the tree's edges have class pairs
    return photos.select("photo").crossJoin(table).select(*FEATURES)


# ---------------------------------------------------------------- whole graphs


def regions_of(segments: DataFrame, pairs: DataFrame | None = None, limbs: DataFrame | None = None, near: DataFrame | None = None, tree: list[tuple[int, int]] | None = None) -> DataFrame:
    """(photo, region, vars) of segments (photo, seg), and of the pairs, limbs and links that there are."""
    named = lambda df, name, *variables: df.select("photo", name.alias("region"), F.array(*variables).alias("vars"))
    s, l = lambda c: segment_name(F.col(c)), limb_name(F.col("limb"))  # noqa: E731, E741
    out = [named(segments, s("seg"), s("seg"))]
    if pairs is not None:
        out.append(named(pairs, pair_name("p", F.col("s1"), F.col("s2")), s("s1"), s("s2")))
    if limbs is not None:
        out.append(named(limbs, l, l))
        for x, y in tree or []:
            ends = [limb_name(F.lit(i)) for i in (x, y)]
            out.append(named(limbs.select("photo").distinct(), pair_name("q", F.lit(x), F.lit(y)), *ends))
    if near is not None:
        name = F.concat(pair_name("t", F.col("limb"), F.col("seg")), F.lit("-"), F.col("side").cast("string"))
        out.append(named(near, name, l, s("seg")))
    return reduce(DataFrame.union, out)


def parent_links(regions: DataFrame) -> DataFrame:
    """(photo, region, parent): the regions over more variables that hold all of a region's; found by their variables, not by pairs of regions."""
    held = regions.select("photo", F.col("region").alias("parent"), F.size("vars").alias("n"), F.explode("vars").alias("var"))
    own = regions.select("photo", "region", F.size("vars").alias("m"), F.explode("vars").alias("var"))
    met = own.join(held, ["photo", "var"]).filter("n > m").groupBy("photo", "region", "m", "parent").agg(F.count("*").alias("shared"))
    return met.filter("shared = m").select("photo", "region", "parent")


def same_variables(regions: DataFrame) -> DataFrame:
    """(photo, vars, regions): regions over the same set of variables, in name order, which are one node of the graph."""
    return regions.groupBy("photo", F.array_sort("vars").alias("vars")).agg(F.array_sort(F.collect_list("region")).alias("regions"))


@dataclass(frozen=True)
class Graphs:
    """Packed graphs, one row a photo: regions, features, losses and observations as arrays."""

    packed: DataFrame
    classes: int
    n_weights: int

    @classmethod
    def pack(cls, regions: DataFrame, features: DataFrame, classes: int, n_weights: int, losses: DataFrame | None = None, observed: DataFrame | None = None) -> Graphs:
        def lists(df: DataFrame, name: str, *cols: str) -> DataFrame:
            return df.groupBy("photo").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))

        out = lists(regions, "regions", "region", "vars").join(lists(features, "features", "region", "feature", "state", "value"), "photo", "left")
        for df, name, cols in ((losses, "losses", ("region", "state", "value")), (observed, "observed", ("var", "state"))):
            if df is not None:
                out = out.join(lists(df, name, *cols), "photo", "left")
        return cls(out, classes, n_weights)


class One:
    """One photo's graph in NumPy."""

    def __init__(self, row: object, classes: int, n_weights: int) -> None:
        self.names = [r["region"] for r in row.regions]
        self.place = {name: i for i, name in enumerate(self.names)}
        self.vars = [tuple(r["vars"]) for r in row.regions]
        self.shape = [(classes,) * len(v) for v in self.vars]
        own = lambda name: [] if getattr(row, name, None) is None else getattr(row, name)
        self.features: list[list[tuple[int, int, float]]] = [[] for _ in self.names]
        for f in own("features"):
            self.features[self.place[f["region"]]].append((f["feature"], f["state"], f["value"]))
        self.loss = [np.zeros(s).ravel() for s in self.shape]
        for x in own("losses"):
            self.loss[self.place[x["region"]]][x["state"]] = x["value"]
        self.observed = {o["var"]: o["state"] for o in own("observed") if o["state"] is not None and o["state"] == o["state"]}
        self.classes, self.n_weights = classes, n_weights
        sets = [frozenset(v) for v in self.vars]
        self.parents = [[j for j, b in enumerate(sets) if a < b] for a in sets]

    def graph(self, w: np.ndarray, eps: float, loss: bool = False, fixed: dict | None = None, bethe: bool = False) -> Graph:
        regions = []
        for i, v in enumerate(self.vars):
            table = self.loss[i].copy() if loss else np.zeros(self.loss[i].size)
            for f, state, value in self.features[i]:
                table[state] += w[f] * value
            table = table.reshape(self.shape[i], order="F")
            if fixed and len(v) == 1 and v[0] in fixed:
                table = np.where(np.arange(self.classes) == fixed[v[0]], table, -1e6)
            regions.append(Region(v, table, 1.0, list(self.parents[i])))
        if bethe:
            for r, c in zip(regions, bethe_counts(regions)):
                r.count = c
        return Graph(regions, eps)

    def expected(self, beliefs: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(self.n_weights)
        for own, b in zip(self.features, beliefs):
            flat = b.ravel(order="F")
            for f, state, value in own:
                out[f] += flat[state] * value
        return out

    def seen(self, latent: int | None = 0) -> np.ndarray:
        """The features at the observed states; a latent variable counts as in state `latent`."""
        out = np.zeros(self.n_weights)
        for own, v in zip(self.features, self.vars):
            state = sum(self.observed.get(x, latent) * self.classes**i for i, x in enumerate(v))
            for f, at, value in own:
                out[f] += value * (at == state)
        return out


def infer(graphs: Graphs, w: np.ndarray, eps: float = 1.0, rounds: int = 50, bethe: bool = False) -> DataFrame:
    """(photo, region, state, belief) of all regions; eps 0: of the best states.  A graph that fails gets zeros."""
    kind, size = dict(graphs.packed.dtypes)["photo"], (graphs.classes, graphs.n_weights)
    reach_workers(graphs.packed.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for row in pdf.itertuples(index=False):
                one = One(row, *size)
                try:
                    g = one.graph(w, eps, bethe=bethe)
                    g.run(rounds, 1e-9)
                    beliefs = [g.belief(i).ravel(order="F") for i in range(len(one.names))]
                    if not all(np.isfinite(b).all() for b in beliefs):
                        raise FloatingPointError
                except Exception:  # one entity's graph fails by itself
                    beliefs = [np.zeros(x.size) for x in one.loss]
                out += [(row.photo, name, k, float(b)) for name, own in zip(one.names, beliefs) for k, b in enumerate(own)]
            yield pd.DataFrame(out, columns=["photo", "region", "state", "belief"])

    return graphs.packed.mapInPandas(run, f"photo {kind}, region string, state int, belief double")


def decode(beliefs: DataFrame) -> DataFrame:
    """(photo, seg, class): the first best state of each segment's own region, from 1; 0 where the graph failed."""
    own = beliefs.filter(F.col("region").rlike("^s[0-9]+$"))
    best = own.groupBy("photo", "region").agg(F.max(F.struct(F.col("belief").alias("b"), (-F.col("state")).alias("k"))).alias("m"))
    seg = F.substring("region", 2, 20).cast("int").alias("seg")
    return best.select("photo", seg, F.when(F.col("m.b") > 0, 1 - F.col("m.k")).otherwise(0).cast("int").alias("class"))


def _sums(graphs: Graphs, one_sums) -> np.ndarray:
    """The sum over photos of one_sums(One) arrays; only their total reaches the driver."""
    reach_workers(graphs.packed.sparkSession)
    size = (graphs.classes, graphs.n_weights)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in parts:
            for row in pdf.itertuples(index=False):
                own = one_sums(One(row, *size))
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    found = graphs.packed.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(graphs.n_weights + 1)
    for r in found:
        out[r["i"]] = r["v"]
    return out


def learn(graphs: Graphs, w: np.ndarray, rounds: int = 10, c: float = 1.0, p: float = 2.0, eps: float = 1.0, sweeps: int = 30, armijo: int = 50, bethe: bool = False, target: np.ndarray | None = None) -> tuple[np.ndarray, list[float]]:
    """Weights after some steps, and the objective before each and at the end.

    F(w) = sum of duals with losses + c / p |w|^p - w . target, target the features
    at the observed states, summed over photos.  Every evaluation is one pass over
    the packed graphs; a step is halved until F falls, at most armijo times.
    """
    graphs = Graphs(settled(graphs.packed), graphs.classes, graphs.n_weights)
    if target is None:
        target = _sums(graphs, lambda one: np.append(one.seen(), 0.0))[:-1]

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        def own(one: One) -> np.ndarray:
            g = one.graph(w, eps, loss=True, bethe=bethe)
            g.run(sweeps, 1e-10)
            return np.append(one.expected([g.belief(i) for i in range(len(one.names))]), g.dual())

        out = _sums(graphs, own)
        return out[-1] + c / p * float((np.abs(w) ** p).sum()) - float(w @ target), out[:-1] - target + c * np.abs(w) ** (p - 1) * np.sign(w)

    w, path = np.array(w, float), []
    f, grad = value(w)
    for _ in range(rounds):
        path.append(f)
        step = 1.0 / max(1.0, float(np.abs(grad).max()))
        for _ in range(armijo):
            new_f, new_grad = value(w - step * grad)
            if new_f < f:
                w, f, grad = w - step * grad, new_f, new_grad
                break
            step /= 2
        else:
            break
    return w, [*path, f]


def learn_latent(graphs: Graphs, w: np.ndarray, outer: int = 5, eps: float = 1.0, sweeps: int = 30, bethe: bool = False, tolerance: float = 1e-4, **steps) -> np.ndarray:
    """Learning with variables that aren't observed: in turn they are completed by their beliefs given the observed ones, and the weights are learned for that."""
    graphs = Graphs(settled(graphs.packed), graphs.classes, graphs.n_weights)
    for _ in range(outer):
        def own(one: One, w: np.ndarray = w) -> np.ndarray:
            g = one.graph(w, eps, fixed=one.observed, bethe=bethe)
            g.run(sweeps, 1e-10)
            return np.append(one.expected([g.belief(i) for i in range(len(one.names))]), 0.0)

        new, _ = learn(graphs, w, eps=eps, sweeps=sweeps, bethe=bethe, target=_sums(graphs, own)[:-1], **steps)
        if np.abs(new - w).max() < tolerance:
            return new
        w = new
    return w


def train_and_test(train: Graphs, test: Graphs, **steps) -> tuple[np.ndarray, DataFrame]:
    """Weights learned on train, and (photo, seg, class) of test; both may be the same."""
    w, _ = learn(train, np.ones(train.n_weights), **steps)
    return w, decode(infer(test, w, eps=steps.get("eps", 1.0), bethe=steps.get("bethe", False)))
