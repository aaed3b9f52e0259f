"""Scores of a confirmation set, its what-if worlds, intervals and checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark import schema as S
from quillmark.operators import bootstrap, model, neighbours, ranks, resampling, worlds
from quillmark.operators.audit import require
from quillmark.operators.homogeneity import Tables
from quillmark.sources.staging import staged


def declared_scores(long: DataFrame, bundle: model.Bundle, k: int = S.NEIGHBOURS) -> tuple[DataFrame, DataFrame]:
    """long (uid, label, block, key, value) to (scores, percentiles on the training scale).

    L is the model's probability; G minus the distance to the k-th neighbour within the set;
    S their rank mean. G_eval and S_eval use the set's own scale, and are null where that can't
    be computed (``neighbours.density_problem`` says why).
    """
    p = percentiles(long, bundle)
    return scored(long, p, bundle, k), p


def percentiles(long: DataFrame, bundle: model.Bundle) -> DataFrame:
    return staged(bundle.percentiles(long).select("uid", "label", "block", "key", "p"), "percentiles")


def scored(long: DataFrame, p: DataFrame, bundle: model.Bundle, k: int = S.NEIGHBOURS) -> DataFrame:
    """The scores of ``declared_scores`` from its percentiles."""
    vec = staged(model.vectors(p, ("label",)), "vectors")
    L = model.score(bundle.model, vec).select("uid", (F.col("label") == "bot").alias("is_bot"), "L")
    g = neighbours.train_scale_density(vec.select("uid", "vec"), k).withColumnRenamed("g", "G")
    ge = neighbours.set_density(long, (k,)).select("uid", F.col(f"g_{k}").alias("G_eval"))
    # Ranks read their rows more than once, and must not find the neighbours anew each time.
    s = staged(L.join(g, "uid").join(ge, "uid", "left"), "densities")
    s = ranks.rank_mean(ranks.rank_mean(s, "L", "G", name="S"), "L", "G_eval", name="S_eval")
    s = s.select("uid", "is_bot", "L", "G", "S", "G_eval", F.when(F.col("G_eval").isNotNull(), F.col("S_eval")).alias("S_eval"))
    return staged(s, "scores")


SCORES = ("L", "G", "S", "G_eval", "S_eval")


class EvaluationSet(NamedTuple):
    key: tuple[int, ...]
    code: int | None
    name: str
    worlds: bool


def usable(scores: DataFrame) -> list[str]:
    """Scores that every row has, as a number."""
    missing = scores.agg(*(F.count_if(F.col(s).isNull() | F.isnan(s)).alias(s) for s in SCORES)).first()
    return [s for s in SCORES if missing[s] == 0]


def run_set(long: DataFrame, spec: EvaluationSet, bundle: model.Bundle, confirmation: DataFrame, replicates: int = S.BOOTSTRAPS) -> Tables:
    """long (uid, label, block, key, value) of one set to tables: auc (world, name, point, lo,
    hi) and, with worlds, spread, derived, extra and gates, each made when it is first asked
    for. All worlds share one set of bootstrap weights."""
    spark = long.sparkSession
    inside = long.select("uid").distinct().join(confirmation.select("uid", F.lit(True).alias("_in")), "uid", "left")
    require(inside, F.col("_in").isNotNull(), "an account is outside the confirmation half").count()
    accounts = [(r.uid, r.label) for r in long.select("uid", "label").distinct().orderBy("uid").collect()]
    bots, humans = ([u for u, l in accounts if l == x] for x in ("bot", "human"))
    sides = long.select("uid", (F.col("label") == "bot").alias("is_bot")).distinct()
    seed = [S.WORLD_SEED, S.EXPERIMENT, spec.code]

    def transplanted(part: int, own: list[str], other: list[str], side: str) -> DataFrame:
        return worlds.transplant(long, worlds.donor_table(spark, resampling.donors([*seed, part], own, other)), side)

    makers = {"W0": lambda: long}
    if spec.worlds:
        assert spec.code is not None
        makers |= {"W1": lambda: worlds.remove_centre(long), "W2": lambda: transplanted(2, humans, bots, "human"), "W3": lambda: transplanted(1, bots, humans, "bot")}
    made = Tables({w: (lambda make=make: staged(make(), "world")) for w, make in makers.items()})
    # Spread needs the percentiles alone, the rest scores on shared draws.
    shares = Tables({w: (lambda w=w: percentiles(made[w], bundle)) for w in makers})
    weights = Tables({"all": lambda: staged(bootstrap.replayed_weights(sides, (S.EXPERIMENT, *spec.key), replicates), "weights")})

    scores = Tables({w: (lambda w=w: scored(made[w], shares[w], bundle)) for w in makers})

    def drawn(w: str) -> DataFrame:
        return staged(bootstrap.replicated(scores[w], weights["all"], usable(scores[w])), "draws")

    draws = Tables({w: (lambda w=w: drawn(w)) for w in makers})

    def auc() -> DataFrame:
        # A world is many short jobs, one after the other; worlds don't wait for each other.
        _together([lambda: weights["all"], *(lambda w=w: scores[w] for w in makers)])
        _together([lambda w=w: draws[w] for w in makers])
        rows = [bootstrap.intervals(draws[w], [c for c in draws[w].columns if c != "rep"]) for w in makers]
        return staged(_union([r.select(F.lit(w).alias("world"), "name", "point", "lo", "hi") for w, r in zip(makers, rows)]), "auc")

    def spread() -> DataFrame:
        # Who stays in a world spreads as in the set itself.
        moved = {"W0": ("bot", "human"), "W1": ("bot",), "W2": ("human",), "W3": ("bot",)}
        own = {w: staged(worlds.spread(shares[w], labels=moved[w]), "spread") for w in makers}
        rows = {w: _union([t, own["W0"].where(~F.col("label").isin(*moved[w]))]) for w, t in own.items()}
        return _union([t.select(F.lit(w).alias("world"), "label", "sd", "nn") for w, t in rows.items()])

    def derived() -> DataFrame:
        w = {k: draws[k].select("rep", *(F.col(c).alias(f"{k}_{c}") for c in ("L", "G", "S") if c in draws[k].columns)) for k in ("W0", "W2", "W3")}
        both = w["W0"].join(w["W2"], "rep").join(w["W3"], "rep").select(
            "rep", (F.col("W0_G") - F.col("W2_G")).alias("g_drop"), ((F.col("W0_S") - F.col("W0_L")) - (F.col("W3_S") - F.col("W3_L"))).alias("gain_change")
        )
        flat = both.select("rep", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("x")) for c in ("g_drop", "gain_change")))).alias("c")).select("rep", "c.*")
        q = F.percentile(F.when(F.col("rep") >= 0, F.col("x")), F.array(F.lit(0.025), F.lit(0.975)))
        return flat.groupBy("name").agg(F.max(F.when(F.col("rep") < 0, F.col("x"))).alias("point"), q.alias("q")).select("name", "point", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))

    def extra() -> DataFrame:
        rows = []
        for e in range(1, S.EXTRA_DRAWS + 1):
            drawn_scores, _ = declared_scores(staged(worlds.transplant(long, worlds.donor_table(spark, resampling.donors([*seed, 2, e], humans, bots)), "human"), "world"), bundle)
            rows.append(staged(_points(drawn_scores, ["L", "G", "S"]), "extra").select(F.lit(e).alias("draw"), "L", "G", "S"))
        return _union(rows)

    out = Tables({"auc": auc})
    if spec.worlds:
        gates = lambda: worlds.gates(out["spread"], out["auc"].where("world = 'W1' and name = 'L'"))
        out = Tables({"auc": auc, "spread": spread, "derived": derived, "extra": extra, "gates": gates})
    return out


def _together(makers: Sequence[Callable[[], object]]) -> None:
    """Tables that don't need each other, their jobs side by side."""
    with ThreadPoolExecutor(len(makers)) as pool:
        for made in [pool.submit(make) for make in makers]:
            made.result()


def _points(scores: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: one AUC column per score."""
    flat = scores.select("is_bot", F.explode(F.array(*(F.struct(F.lit(s).alias("score"), F.col(s).alias("v")) for s in names))).alias("s")).select("is_bot", "s.*")
    rows = ranks.auc(flat, ["score"], "v", F.col("is_bot"))
    return rows.groupBy().pivot("score", list(names)).agg(F.first("auc"))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# The human sources of the confirmation half, by name.
SOURCES = ("botometer-feedback", "gilani-17", "midterm-2018", "varol-icwsm")


def evaluation_sets(sources: Sequence[str] = SOURCES) -> list[tuple[EvaluationSet, str]]:
    """The sets and a predicate on (label, source, chosen, excluded) for each; ``trunc:`` marks
    the table without cut tails."""
    out = [(EvaluationSet((501,), 501, "confirmation half", True), "true")]
    for level in S.SUBSAMPLE_LEVELS:
        for seed in S.SUBSAMPLE_SEEDS:
            out.append((EvaluationSet((600 + level, seed), None, f"bots {level} %, seed {seed}", False), f"label = 'human' or chosen_{level}_{seed}"))
    for i, s in enumerate(sorted(sources)):
        out.append((EvaluationSet((511 + i,), 511 + i, f"bots and {s}", False), f"label = 'bot' or source = '{s}'"))
        out.append((EvaluationSet((521 + i,), 521 + i, f"without {s}", False), f"label = 'bot' or source <> '{s}'"))
    out.append((EvaluationSet((531,), 531, "without cut tails", True), "trunc: true"))
    out.append((EvaluationSet((541,), 541, "without flagged accounts", True), "not excluded"))
    return out


def run_all(long: DataFrame, trunc: DataFrame, info: DataFrame, excluded: DataFrame, bundle: model.Bundle, replicates: int = S.BOOTSTRAPS) -> dict[str, Tables]:
    """long and trunc (uid, block, key, value), info (uid, label, source) of all accounts, to
    the tables of every set over the confirmation half."""
    spark = long.sparkSession
    split, _ = resampling.half_split(info)
    conf = staged(info.join(split.where("part = 'confirmation'").select("uid"), "uid"), "confirmation")
    bots = [r.uid for r in conf.where("label = 'bot'").select("uid").orderBy("uid").collect()]
    humans = conf.where("label = 'human'").count()
    flags = conf.join(excluded.select("uid", F.lit(True).alias("excluded")), "uid", "left").na.fill({"excluded": False})
    for level in S.SUBSAMPLE_LEVELS:
        for seed in S.SUBSAMPLE_SEEDS:
            chosen = spark.createDataFrame([(u, True) for u in resampling.subsample(bots, level, humans, seed)], f"uid string, chosen_{level}_{seed} boolean")
            flags = flags.join(chosen, "uid", "left").na.fill({f"chosen_{level}_{seed}": False})
    flags = staged(flags, "flags")
    out = {}
    for spec, rule in evaluation_sets(sorted({r.source for r in conf.where("label = 'human'").select("source").distinct().collect()})):
        table, rule = (trunc, rule.removeprefix("trunc: ")) if rule.startswith("trunc: ") else (long, rule)
        own = flags.where(rule).select("uid", "label")
        out["-".join(map(str, spec.key))] = run_set(table.join(own, "uid"), spec, bundle, conf, replicates)
    return out


def subsample_report(auc: DataFrame) -> DataFrame:
    """auc (level, seed, name, point, lo, hi) to level: mean S, mean S−L, draws whose S−L
    interval lies above 0."""
    s = F.when(F.col("name") == "S", F.col("point"))
    d, lo = (F.when(F.col("name") == "S−L", F.col(c)) for c in ("point", "lo"))
    return auc.groupBy("level").agg(F.avg(s).alias("mean_s"), F.avg(d).alias("mean_gain"), F.count_if(lo > 0).alias("positive"), F.countDistinct("seed").alias("draws"))
