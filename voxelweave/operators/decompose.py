"""The 0/1 programme by windows: Lagrangian decomposition with proven bounds, no component in one task.

Each row of the programme goes to the window of its first variable.  A variable that rows of several windows name has a
copy in each; its cost is shared among the copies, and multipliers that sum to 0 over them make the copies agree.  Windows
are solved exactly, each in a task.  Their minima sum to a lower bound; a solution that meets every row is an upper one.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components, dropped, settled
from .solve import branch_and_bound, hopeless, programme

EPS = 1e-6


def window_code(*places: Column, bits: int = 20) -> Column:
    """Places (0 or more) with their bits in turns, so that halving a code joins neighbours along one direction after the other."""
    n = len(places)
    spread = [F.shiftleft(F.shiftright(p.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), n * b + k) for k, p in enumerate(places) for b in range(bits)]
    return reduce(lambda a, b: a.bitwiseOR(b), spread)


def segment_windows(segments: DataFrame, slices: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """key, window of segments: by interval and the least corner of their slices, in cells of `size` (x, y, z)."""
    ids = segments.select("key", "isi", F.explode(F.concat("sl", "sr")).alias("id"))
    at = ids.join(slices.select("id", "x0", "y0"), "id").groupBy("key").agg(F.first("isi").alias("z"), F.min("x0").alias("x"), F.min("y0").alias("y"))
    # shifted so that border intervals are not negative
    cell = [F.expr(f"greatest({c}, 0) div {s}") for c, s in zip("xy", size)] + [F.expr(f"greatest(z + 1, 0) div {size[2]}")]
    return at.select("key", window_code(*cell).alias("window"))


def _parts(n: int, rows: list[tuple[dict[int, int], str, int]]) -> list[list[int]]:
    """Variables that share rows, directly or over others."""
    up = list(range(n))

    def root(v: int) -> int:
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for coef, _, _ in rows:
        first, *rest = coef
        for v in rest:
            up[root(v)] = root(first)
    groups: dict[int, list[int]] = {}
    for v in range(n):
        groups.setdefault(root(v), []).append(v)
    return list(groups.values())


def _solve_groups(cost: DataFrame, rows: DataFrame, by: list[str], limit: int) -> DataFrame:
    """`by`, key, x, bound of each group of variables (by, key, cost) under rows (by, row, key, coef, relation, value).

    A group's pieces are solved one by one.  bound is a variable's share of its piece's proven least cost (its own negative
    cost where the piece took more than `limit` steps); x is null where a piece has no solution or none was found.
    """
    none = lambda t: F.lit(None).cast(t)
    both = cost.select(*by, "key", "cost", none("string").alias("row"), none("int").alias("coef"), none("string").alias("relation"), none("long").alias("value")).unionByName(
        rows.select(*by, "key", none("double").alias("cost"), "row", F.col("coef").cast("int").alias("coef"), "relation", F.col("value").cast("long").alias("value"))
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        var = pdf[pdf["row"].isna()].sort_values("key")
        keys, c = var["key"].tolist(), var["cost"].tolist()
        at = {k: i for i, k in enumerate(keys)}
        found: dict[str, tuple[dict[int, int], str, int]] = {}
        r = pdf[pdf["row"].notna()]
        for row, key, coef, rel, value in zip(r["row"], r["key"], r["coef"], r["relation"], r["value"]):
            found.setdefault(row, ({}, rel, int(value)))[0][at[key]] = int(coef)
        every = list(found.values())
        of: dict[int, list[int]] = {}
        for i, (coef, _, _) in enumerate(every):
            of.setdefault(next(iter(coef)), []).append(i)
        x: list[int | None] = [None] * len(keys)
        bound = [0.0] * len(keys)
        for part in _parts(len(keys), every):
            place = {v: i for i, v in enumerate(part)}
            mine = [({place[v]: k for v, k in every[i][0].items()}, *every[i][1:]) for v in part for i in of.get(v, ())]
            got, sure = branch_and_bound([c[v] for v in part], mine, limit)
            if sure and not got:  # no assignment meets the rows: any bound holds
                bound[part[0]] = float("inf")
            elif sure:
                bound[part[0]] = sum(c[v] * g for v, g in zip(part, got))
            else:
                bound[part[0]] = sum(min(c[v], 0.0) for v in part)
            for v, g in zip(part, got):
                x[v] = g
        head = {b: pdf[b].iloc[0] for b in by}
        return pd.DataFrame({**head, "key": keys, "x": pd.array(x, dtype="Int32"), "bound": bound})

    kinds = dict(cost.dtypes)
    return both.groupBy(*by).applyInPandas(run, ", ".join(f"{b} {kinds[b]}" for b in by) + ", key string, x int, bound double")


def _repaired(agreed: DataFrame, odd: DataFrame, variables: DataFrame, rows: DataFrame, hops: int, limit: int) -> DataFrame:
    """component, key, x, x null where none was found: what is agreed stays, but near odd variables (within `hops` rows) it is solved anew.

    The open variables form pieces of their own around each disagreement, so a task gets a neighbourhood and not a component.
    """
    name = ["component", "key"]
    open_ = odd.select(*name)
    for _ in range(hops):
        touched = rows.join(open_, name, "left_semi").select("component", "row").distinct()
        open_ = rows.join(touched, ["component", "row"], "left_semi").select(*name).unionByName(open_).distinct()
    open_ = settled(open_)
    fixed = agreed.join(open_, name, "left_anti").select(*name, "x")
    touched = rows.join(open_, name, "left_semi").select("component", "row").distinct()
    near = rows.join(touched, ["component", "row"], "left_semi")
    spent = near.join(fixed, name).groupBy("component", "row").agg(F.sum(F.col("coef") * F.col("x")).alias("spent"))
    rest = settled(near.join(open_, name, "left_semi").join(spent, ["component", "row"], "left").withColumn("value", F.col("value") - F.coalesce("spent", F.lit(0))).drop("spent"))
    node = F.concat_ws("|", "component", "key")
    first = rest.groupBy("component", "row").agg(F.min(node).alias("b"))
    piece = components(rest.join(first, ["component", "row"]).select(node.alias("a"), "b").distinct()).select(F.col("id").alias("node"), F.col("component").alias("piece"))
    cost = variables.join(open_, name, "left_semi").withColumn("node", node).join(piece, "node", "left").withColumn("piece", F.coalesce("piece", "node"))
    rest = rest.withColumn("node", node).join(piece, "node")
    got = _solve_groups(cost.drop("node"), rest.drop("node"), ["component", "piece"], limit)
    return got.select(*name, "x").unionByName(fixed.select(*name, F.col("x").cast("int").alias("x")))


def solve_windows(variables: DataFrame, coefs: DataFrame, rounds: int = 4, most: int = 2_000, hops: int = 3, limit: int = 200_000, merges: int = 40) -> tuple[DataFrame, DataFrame]:
    """solution (key, x, component) and bounds (component, lower, upper, n) of variables (key, cost, window) under coefs (row, key, coef, relation, value).

    window: 0 or more; halving it joins neighbours (`window_code`).  A component is what shares rows; it is done when lower
    and upper meet, and its solution is then proven.  After `rounds` rounds without that, its windows are joined two and two,
    multipliers kept, so the lower bound doesn't fall, until one would hold more than `most` variables (or the `merges`-th
    time): then the best solution is kept and the bounds say how far from the optimum it can be.  No task gets more than a
    window, or what is `hops` rows away from a disagreement.  An upper of null means that no solution was found; x is then 0.
    Defined results: variables in no row take 1 where their cost is below 0; a row of unknown keys isn't there; rows that
    can't be met are an error.
    """
    v = settled(variables.select("key", F.col("cost").cast("double").alias("cost"), F.col("window").cast("long").alias("window")))
    named = settled(coefs.select("row", "key", "coef", "relation", "value").join(v.select("key", "window"), "key"))
    first = named.groupBy("row").agg(F.min("key").alias("b"), F.min("window").alias("home"))
    pieces = components(named.join(first, "row").select(F.col("key").alias("a"), "b").distinct()).withColumnRenamed("id", "key")
    v = settled(v.join(pieces, "key", "left").withColumn("component", F.coalesce("component", "key")))
    rows = settled(named.drop("window").join(first.select("row", F.col("home").alias("window")), "row").join(pieces, "key"))
    alone = v.join(named.select("key").distinct(), "key", "left_anti")
    alone = alone.select("component", "key", (F.col("cost") < 0).cast("int").alias("x"), "cost")
    copies = rows.select("component", "window", "key").distinct()
    n = copies.groupBy("component", "key").agg(F.count("*").alias("n"))
    copies = settled(copies.join(n, ["component", "key"]).join(v.select("key", "cost"), "key").select("component", "window", "key", (F.col("cost") / F.col("n")).alias("cost")))
    done, bounds = [alone.select("component", "key", "x")], [alone.groupBy("component").agg(F.sum(F.col("cost") * F.col("x")).alias("lower"), F.sum(F.col("cost") * F.col("x")).alias("upper"), F.count("*").alias("n"))]
    best, kept, merged, turn = None, None, 0, 0  # best: component, lower, upper; kept: component, key, x of upper
    while True:
        got = settled(_solve_groups(copies, rows, ["component", "window"], limit))
        vote = got.groupBy("component", "key").agg(F.avg(F.coalesce("x", F.lit(0))).alias("x"), F.count_if(F.col("x").isNull()).alias("blank"))
        vote = settled(vote.withColumn("odd", (F.col("blank") > 0) | (F.col("x") > 0) & (F.col("x") < 1)).drop("blank"))
        lower = settled(got.groupBy("component").agg(F.sum("bound").alias("lower")))
        open_ = settled(vote.where("odd").select("component").distinct())
        states = {r[0] for r in lower.select(F.lit("none")).where("lower = double('infinity')").limit(1).unionByName(open_.select(F.lit("odd").alias("none")).limit(1)).collect()}
        if "none" in states:
            raise ValueError("the rows of a window have no solution")
        # where all copies agree they meet every row, at the lower bound's cost; the others are repaired in a level's last round
        tried = vote.join(open_, "component", "left_anti").select("component", "key", F.col("x").cast("int").alias("x"))
        if "odd" in states and turn % rounds == rounds - 1:
            mine = vote.join(open_, "component", "left_semi")
            of = rows.join(open_, "component", "left_semi")
            tried = tried.unionByName(_repaired(mine.where("not odd"), mine.where("odd"), v, of, hops, limit))
        tried = settled(tried)
        upper = tried.join(v.select("key", "cost"), "key").groupBy("component").agg(F.when(F.count("x") == F.count("*"), F.sum(F.col("x") * F.col("cost"))).alias("upper"))
        now = lower.join(upper, "component", "left")
        if best is None:
            best = settled(now.join(vote.groupBy("component").agg(F.count("*").alias("n")), "component"))
            kept = tried.unionByName(vote.join(tried.select("component").distinct(), "component", "left_anti").select("component", "key", F.lit(None).cast("int").alias("x")))
        else:
            both = settled(now.join(best.select("component", F.col("lower").alias("l"), F.col("upper").alias("u"), "n"), "component"))
            better = both.where("upper is not null and (u is null or upper < u)").select("component")
            kept = settled(tried.join(better, "component", "left_semi").unionByName(kept.join(better, "component", "left_anti")))
            best = settled(both.select("component", F.greatest("lower", "l").alias("lower"), F.least("upper", "u").alias("upper"), "n"))
        turn += 1
        over = F.coalesce(F.col("upper") - F.col("lower") <= EPS * (1 + F.abs("upper")), F.lit(False))
        if turn % rounds == 0:  # join windows of what isn't done, if they still fit
            sizes = copies.select("component", F.shiftright("window", 1).alias("window"), "key").distinct().groupBy("component", "window").agg(F.count("*").alias("n"))
            spread = copies.groupBy("component").agg(F.count_distinct("window").alias("windows"))
            stuck = sizes.groupBy("component").agg(F.max("n").alias("n")).join(spread, "component").where((F.col("n") > most) | (F.col("windows") == 1) | F.lit(merged >= merges))
            finished = best.where(over).select("component").unionByName(stuck.select("component")).distinct()
        else:
            finished = best.where(over).select("component")
        finished = settled(finished)
        done.append(settled(kept.join(finished, "component", "left_semi").select("component", "key", F.coalesce("x", F.lit(0)).alias("x"))))
        bounds.append(settled(best.join(finished, "component", "left_semi").select("component", "lower", "upper", "n")))
        best = settled(best.join(finished, "component", "left_anti"))
        if not best.take(1):
            break
        kept = settled(kept.join(best.select("component"), "component", "left_semi"))
        rows = settled(rows.join(best.select("component"), "component", "left_semi"))
        # a step of (upper - lower) / |copies' disagreement|**2 along the disagreement of each component
        wide = F.coalesce(F.col("upper"), F.col("lower") + 1 + 0.1 * F.abs("lower"))
        apart = got.join(vote.select("component", "key", F.col("x").alias("mean")), ["component", "key"]).select("component", "window", "key", (F.coalesce("x", F.lit(0)) - F.col("mean")).alias("off"))
        norm = apart.groupBy("component").agg(F.sum(F.col("off") * F.col("off")).alias("norm")).join(best.join(lower.select("component", F.col("lower").alias("here")), "component"), "component")
        step = norm.select("component", F.when(F.col("norm") > 0, (wide - F.col("here")) / F.col("norm")).otherwise(0.0).alias("step"))
        copies = copies.join(apart, ["component", "window", "key"]).join(step, "component").select("component", "window", "key", (F.col("cost") + F.col("step") * F.col("off")).alias("cost"))
        if turn % rounds == 0:
            merged += 1
            half = F.shiftright("window", 1).alias("window")
            rows = settled(rows.select("component", half, "row", "key", "coef", "relation", "value"))
            copies = copies.groupBy("component", half, "key").agg(F.sum("cost").alias("cost"))
        copies = settled(copies)
        dropped(got)
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return union(done).select("key", "x", "component"), union(bounds)


def solve_volume(segments: DataFrame, slices: DataFrame, cliques: DataFrame, size: tuple[int, int, int], forced: bool = False, user: DataFrame | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """solution (key, x, component) and bounds of all segments (key, type, isi, sl, sr, cost) as one programme, by windows of `size` (x, y, z); `how` as in solve_windows."""
    one = segments.withColumn("problem", F.lit(0).cast("long"))
    rows = programme(one, slices, cliques, forced, user)
    out = settled(hopeless(one, user).select("key")) if not forced else segments.select("key").limit(0)
    open_ = segments.join(out, "key", "left_anti")
    solution, bounds = solve_windows(open_.select("key", "cost").join(segment_windows(open_, slices, size), "key"), rows, **how)
    return solution.unionByName(out.select("key", F.lit(0).alias("x"), F.col("key").alias("component"))), bounds
