"""The 0/1 programme's solution, core by core, and what follows from it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import constraints
from .graph import components, components_within, settled
from .segments import members


class Unproven(RuntimeError):
    """A programme took more steps than allowed; there is no proven solution."""


def branch_and_bound(cost: list[float], rows: list[tuple[dict[int, int], str, int]], limit: int = 20_000_000) -> tuple[list[int], bool]:
    """Least sum of cost * x over 0/1 x under rows (coefficients, relation, value), none if there is no such x; and whether it is proven within `limit` steps.

    Depth first, cheapest variables first; a branch ends when a row can't be met any more or the
    costs that remain can't beat the best.  What remains is bounded by the cheapest variable of
    each group of variables of which a row lets one be chosen.
    """
    n = len(cost)
    order = sorted(range(n), key=lambda i: cost[i])
    place = {v: k for k, v in enumerate(order)}
    group: dict[int, int] = {}
    for r in sorted((r for r, (coef, rel, value) in enumerate(rows) if rel in ("<=", "=") and value == 1 and min(coef.values()) > 0), key=lambda r: -len(rows[r][0])):
        for v in rows[r][0]:
            group.setdefault(v, r)
    gain = [0.0] * (n + 1)  # from place k on
    least: dict[int, float] = {}
    for k in range(n - 1, -1, -1):
        v = order[k]
        g, had = group.get(v, -1 - v), least.get(group.get(v, -1 - v), 0.0)
        least[g] = min(had, cost[v])
        gain[k] = gain[k + 1] + least[g] - had
    of: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    lo, hi = [0] * len(rows), [0] * len(rows)  # what the open variables of each row can add
    for r, (coef, _, _) in enumerate(rows):
        for v, c in coef.items():
            of[place[v]].append((r, c))
            lo[r] += min(0, c)
            hi[r] += max(0, c)
    have = [0] * len(rows)

    def can(r: int) -> bool:
        _, rel, value = rows[r]
        if rel != ">=" and have[r] + lo[r] > value:
            return False
        return rel == "<=" or have[r] + hi[r] >= value

    best, answer, steps = float("inf"), None, 0
    x = [0] * n
    if not all(can(r) for r in range(len(rows))):
        return [], True

    def put(k: int, v: int, sign: int) -> None:
        for r, c in of[k]:
            have[r] += sign * v * c
            lo[r] -= sign * min(0, c)
            hi[r] -= sign * max(0, c)

    stack: list[tuple[int, float, int]] = [(0, 0.0, 0)]  # place, cost so far, stage: 0 first value, 1 second, 2 done
    first = lambda k: 1 if cost[order[k]] < 0 else 0
    while stack:
        k, c, stage = stack.pop()
        if stage > 0:
            put(k, x[k], -1)
        if stage == 2:
            continue
        if k == n:
            if c < best - 1e-12:
                best, answer = c, x[:]
            continue
        steps += 1
        if steps > limit:
            break
        if stage == 0 and c + gain[k] >= best - 1e-12:
            continue
        x[k] = first(k) if stage == 0 else 1 - first(k)
        put(k, x[k], 1)
        stack.append((k, c, stage + 1))
        c2 = c + x[k] * cost[order[k]]
        if c2 + gain[k + 1] < best - 1e-12 and all(can(r) for r, _ in of[k]):
            if k + 1 == n:
                best, answer = c2, x[:]
            else:
                stack.append((k + 1, c2, 0))
    if answer is None:
        return [], steps <= limit
    out = [0] * n
    for k, v in enumerate(order):
        out[v] = answer[k]
    return out, steps <= limit


#: steps of branch and bound before a programme is solved over its open rows instead
FIRST = 300


def _frontier(cost: list[float], rows: list[tuple[dict[int, int], str, int]]) -> list[int]:
    """An order of the variables that keeps few rows open: next is the one of an open row that opens least rows more than it closes."""
    of: list[list[int]] = [[] for _ in cost]
    for r, (coef, _, _) in enumerate(rows):
        for v in coef:
            of[v].append(r)
    left = [len(coef) for coef, _, _ in rows]
    waiting, near, order = set(range(len(cost))), set(), []
    begun: set[int] = set()
    more = lambda v: (sum((r not in begun) - (left[r] == 1) for r in of[v]), len(of[v]), v)
    while waiting:
        v = min(near or waiting, key=more)
        order.append(v)
        waiting.discard(v)
        near.discard(v)
        for r in of[v]:
            left[r] -= 1
            if r not in begun:
                begun.add(r)
                near.update(w for w in rows[r][0] if w in waiting)
    return order


def by_open_rows(cost: list[float], rows: list[tuple[dict[int, int], str, int]], known: list[int], most: int = 1_500_000) -> list[int] | None:
    """What branch_and_bound gives, by dynamic programming: of all choices that leave the open rows alike only the cheapest is kept.

    A row is open from its first variable to its last, and of a row that can't be broken any more it doesn't matter how much
    it has; so the work grows with the number of variables and with what the rows open at once can have, not with all
    choices.  known: a solution that may not be the best, or none.  None if more than `most` states would be kept.
    """
    order = _frontier(cost, rows)
    of: list[list[tuple[int, int]]] = [[] for _ in cost]
    for r, (coef, _, _) in enumerate(rows):
        for v, c in coef.items():
            of[v].append((r, c))
    base = [sum(min(0, c) for c in coef.values()) for coef, _, _ in rows]
    lo, hi = base[:], [sum(max(0, c) for c in coef.values()) for coef, _, _ in rows]
    if any(rel != ">=" and a > value or rel != "<=" and b < value for (_, rel, value), a, b in zip(rows, lo, hi)):
        return []
    ends = [min(value, b) if rel == "<=" else max(value, a) if rel == ">=" else value for (_, rel, value), a, b in zip(rows, lo, hi)]  # no row asks for more than its variables can add
    width = max((b - a for a, b in zip(lo, hi)), default=0).bit_length() + 1
    mask = (1 << width) - 1
    left = [len(coef) for coef, _, _ in rows]
    slot: dict[int, int] = {}
    rest = [0.0] * (len(order) + 1)
    for k in range(len(order) - 1, -1, -1):
        rest[k] = rest[k + 1] + min(0.0, cost[order[k]])
    bar = sum(c for c, x in zip(cost, known) if x) - 1e-12 if known else float("inf")
    layers: list[dict[int, tuple[float, int, int]]] = []
    states: dict[int, tuple[float, int, int]] = {0: (0.0, 0, 0)}  # state: cost, the state before, the last value
    kept = 0
    for k, v in enumerate(order):
        opened, checks = 0, []
        for r, c in of[v]:
            if r not in slot:
                slot[r] = min(set(range(len(slot) + 1)) - set(slot.values()))
                opened |= -base[r] << slot[r] * width
            lo[r] -= min(0, c)
            hi[r] -= max(0, c)
            left[r] -= 1
            checks.append((slot[r] * width, c, base[r], rows[r][1], ends[r], lo[r], hi[r], left[r] == 0))
        after: dict[int, tuple[float, int, int]] = {}
        for state, (spent, _, _) in states.items():
            for x in (0, 1):
                total = spent + x * cost[v]
                if total + rest[k + 1] >= bar:
                    continue
                new = state + opened
                for at, c, low, rel, value, l_, h_, done in checks:
                    have = (new >> at & mask) + low + x * c
                    if rel != ">=" and have + l_ > value or rel != "<=" and have + h_ < value:
                        break
                    if rel == "<=":
                        have = max(have, value - h_)
                    elif rel == ">=":
                        have = min(have, value - l_)
                    new = new & ~(mask << at) | (0 if done else (have - low) << at)
                else:
                    if new not in after or total < after[new][0]:
                        after[new] = (total, state, x)
        for r, _ in of[v]:
            if left[r] == 0:
                del slot[r]
        layers.append(after)
        states = after
        kept += len(after)
        if kept > most:
            return None
    if not states:
        return known
    out, state = [0] * len(cost), min(states, key=lambda s: states[s][0])
    for v, layer in zip(reversed(order), reversed(layers)):
        _, state, out[v] = layer[state]
    return out


def exact(cost: list[float], rows: list[tuple[dict[int, int], str, int]], limit: int = 20_000_000) -> tuple[list[int], bool]:
    """branch_and_bound, and over the open rows where that takes more than FIRST steps."""
    x, sure = branch_and_bound(cost, rows, min(limit, FIRST))
    if sure or limit <= FIRST:
        return x, sure
    got = by_open_rows(cost, rows, x)
    return (got, True) if got is not None else branch_and_bound(cost, rows, limit)


def hopeless(segments: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """problem, key of ends that some best solution leaves out: of slices in no continuation or branch, whose ends cost 0 or more together.

    segments: problem, key, type, sl, sr, cost.  It holds as long as no row makes anything be chosen; `kept` (key) are never named.
    """
    used = members(segments.where("type > 0").select("*", F.col("isi"))).join(segments.select("problem", "key"), "key").select("problem", "id").distinct()
    ends = segments.where("type = 0").select("problem", "key", "cost", F.coalesce(F.get("sl", F.lit(0)), F.get("sr", F.lit(0))).alias("id"))
    free = ends.join(used, ["problem", "id"], "left_anti")
    if kept is not None:
        free = free.join(free.join(kept.select("key"), "key", "left_semi").select("problem", "id").distinct(), ["problem", "id"], "left_anti")
    poor = free.groupBy("problem", "id").agg(F.sum("cost").alias("c")).where("c >= 0").select("problem", "id")
    return free.join(poor, ["problem", "id"], "left_semi").select("problem", "key")


def programme(segments: DataFrame, slices: DataFrame, cliques: DataFrame, forced: bool = False, user: DataFrame | None = None) -> DataFrame:
    """All rows (problem, row, key, coef, relation, value) over segments (problem, key, type, isi, sl, sr): conflicts, exclusivity, flow and a user's."""
    rows = constraints.conflict_rows(cliques, segments, forced).unionByName(constraints.exclusivity_rows(slices, cliques, segments, forced)).unionByName(constraints.continuation_rows(segments))
    if user is not None:
        rows = rows.unionByName(user.join(segments.select("problem", "key"), "key").select(*rows.columns))
    return rows


#: coefficients of a problem that one task takes whole; a problem with more falls apart into components over tables first
WHOLE = 300_000


def pieces(n: int, rows: list[tuple[dict[int, int], str, int]]) -> list[tuple[list[int], list[tuple[dict[int, int], str, int]]]]:
    """Variables 0 .. n - 1 by components that share rows, in order, each with its rows in order over its own numbers."""
    up = list(range(n))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for coef, _, _ in rows:
        first, *others = map(root, coef)
        for r in others:
            first, r = sorted((first, root(r)))
            up[r] = first
    out: dict[int, tuple[list[int], list]] = {}
    place = []
    for i in range(n):
        mine = out.setdefault(root(i), ([], []))[0]
        place.append(len(mine))
        mine.append(i)
    for coef, rel, value in rows:
        out[root(next(iter(coef)))][1].append(({place[i]: c for i, c in coef.items()}, rel, value))
    return list(out.values())


def lean(rows: list[tuple[dict[int, int], str, int]]) -> list[tuple[dict[int, int], str, int]]:
    """Rows but those that another one implies: equal ones, and "at most one" over some of the variables of another such row."""
    out, seen, of = [], set(), {}
    for coef, rel, value in rows:
        if (name := (frozenset(coef.items()), rel, value)) not in seen:
            seen.add(name)
            out.append((coef, rel, value))
    one = [i for i, (coef, rel, value) in enumerate(out) if rel == "<=" and value == 1 and all(c == 1 for c in coef.values())]
    for i in one:
        for v in out[i][0]:
            of.setdefault(v, set()).add(i)
    gone = {i for i in one if any(len(out[j][0]) > len(out[i][0]) for j in set.intersection(*(of[v] for v in out[i][0])))}
    return [r for i, r in enumerate(out) if i not in gone]


def solve(variables: DataFrame, coefs: DataFrame, limit: int = 20_000_000, whole: int = WHOLE) -> DataFrame:
    """problem, key, x of variables (problem, key, cost) under coefs (problem, row, key, coef, relation, value).

    A problem falls apart into components of variables that share rows, each solved alone and exactly.  A problem of at most
    `whole` coefficients (a core's) does so in its task, a larger one over tables, so it needn't fit one task unless it is one
    piece.  A component that can't be solved (Unproven, or no solution) is an error.
    """
    named = settled(coefs.join(variables.select("problem", "key"), ["problem", "key"], "left_semi"))
    big = settled(named.groupBy("problem").agg(F.count("*").alias("n")).where(F.col("n") > whole).select("problem"))
    alone = F.concat(F.lit("all|"), F.col("problem").cast("string")).alias("component")

    if not big.take(1):
        both = _lines(variables, named, alone)
    else:
        node = F.concat_ws("|", F.col("problem").cast("string"), "key")
        small = _lines(variables.join(big, "problem", "left_anti"), named.join(big, "problem", "left_anti"), alone)
        named = settled(named.join(big, "problem", "left_semi").withColumn("node", node))
        first = named.groupBy("problem", "row").agg(F.min("node").alias("b"))
        part = components(named.join(first.hint("merge"), ["problem", "row"]).select(F.col("node").alias("a"), "b").distinct()).withColumnRenamed("id", "node").hint("merge")
        v = variables.join(big, "problem", "left_semi").withColumn("node", node).join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
        both = small.unionByName(_lines(v, named.join(part, "node"), F.col("component")))
    return _solve_lines(both, limit)


def solve_pieces(segments: DataFrame, coefs: DataFrame, pieces: DataFrame, limit: int = 20_000_000) -> DataFrame:
    """What `solve` gives for segments (problem, key, sl, sr, cost) of one problem whose pieces are known.

    pieces: id, component of slices; slices that rows of the programme join, directly or over others, have the same one, and a slice that isn't named is joined with none.
    """
    at = segments.select("problem", "key", "cost", F.get(F.concat("sl", "sr"), F.lit(0)).alias("id"))
    of = settled(at.join(pieces.select("id", "component").hint("merge"), "id", "left").select("problem", "key", "cost", F.coalesce("component", "id").cast("string").alias("component")))
    return _solve_lines(_lines(of, coefs.join(of.select("problem", "key", "component").hint("merge"), ["problem", "key"]), F.col("component")), limit)


def _lines(v: DataFrame, c: DataFrame, part) -> DataFrame:
    """Variables and coefficients as the lines of their components."""
    none = lambda t: F.lit(None).cast(t)
    return v.select("problem", part, "key", "cost", none("string").alias("row"), none("int").alias("coef"), none("string").alias("relation"), none("long").alias("value")).unionByName(
        c.select("problem", part, "key", none("double").alias("cost"), "row", F.col("coef").cast("int").alias("coef"), "relation", F.col("value").cast("long").alias("value"))
    )


def _solve_lines(both: DataFrame, limit: int) -> DataFrame:
    """problem, key, x: every component of the lines solved in a task."""

    def one(lines: list[tuple], done: tuple[list, list, list]) -> None:
        problem, var = lines[0][1], sorted((key, cost) for _, _, key, cost, row, *_ in lines if row is None)
        at = {key: i for i, (key, _) in enumerate(var)}
        rows: dict[str, tuple[dict[int, int], str, int]] = {}
        for row, key, coef, rel, value in sorted((row, key, coef, rel, value) for _, _, key, _, row, coef, rel, value in lines if row is not None):
            rows.setdefault(row, ({}, rel, int(value)))[0][at[key]] = int(coef)
        out = [0] * len(var)
        for mine, its in pieces(len(var), list(rows.values())):
            x, sure = exact([var[i][1] for i in mine], lean(its), limit)
            if not sure:
                raise Unproven(f"{len(mine)} variables of problem {problem} took more than {limit} steps")
            if not x:
                raise ValueError(f"the rows over {var[mine[0]][0]} and {len(mine) - 1} others of problem {problem} have no solution")
            for i, value in zip(mine, x):
                out[i] = value
        for to, what in zip(done, ([problem] * len(var), at, out)):
            to.extend(what)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A partition has its components one after the other; a component is held at a time, whatever batches it comes in."""
        frame = lambda done: pd.DataFrame(dict(zip(("problem", "key", "x"), done)))
        lines: list[tuple] = []
        for b in batches:
            done: tuple[list, list, list] = ([], [], [])
            for line in zip(*(b[c].tolist() for c in ("component", "problem", "key", "cost")), b["row"].where(b["row"].notna(), None).tolist(), *(b[c].tolist() for c in ("coef", "relation", "value"))):
                if lines and lines[0][0] != line[0]:
                    one(lines, done)
                    lines = []
                lines.append(line)
            if done[0]:
                yield frame(done)
        if lines:
            one(lines, done := ([], [], []))
            yield frame(done)

    # as many tasks as there are partitions: they are small in bytes, but not in seconds
    dealt = both.repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), "component").sortWithinPartitions("component")
    return dealt.mapInPandas(run, "problem long, key string, x int")


def lasting(segments: DataFrame) -> DataFrame:
    """segments (key, type, sl, sr, cost) but the ends that no problem made of them chooses: of slices in no continuation or branch, no end of which costs less than 0.

    In any part of the programme such an end stays at 0 (see `hopeless`), so it needn't be copied into the problems that it lies in.
    """
    stay = segments.where("type > 0 or cost < 0 or cost is null").select(F.explode(F.concat("sl", "sr")).alias("__id")).distinct()
    ends = segments.where("type = 0").withColumn("__id", F.coalesce(F.get("sl", F.lit(0)), F.get("sr", F.lit(0))))
    return segments.where("type > 0").unionByName(ends.join(stay.hint("merge"), "__id", "left_semi").select(*segments.columns))


def opened(segments: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """segments with `closed`: whether an end is one of `hopeless`; its slice's ends are grouped where they are flagged, and go no further."""
    used = segments.where("type > 0").select("problem", F.explode(F.concat("sl", "sr")).alias("__id")).distinct().withColumn("__used", F.lit(True))
    if kept is not None:
        named = segments.where("type = 0").join(kept.select("key").distinct(), "key", "left_semi")
        used = used.unionByName(named.select("problem", F.explode(F.concat("sl", "sr")).alias("__id"), F.lit(True).alias("__used"))).distinct()
    ends = segments.where("type = 0").withColumn("__id", F.coalesce(F.get("sl", F.lit(0)), F.get("sr", F.lit(0)))).repartition("problem", "__id")
    spent = F.sum("cost").over(W.partitionBy("problem", "__id"))
    ends = ends.withColumn("__spent", spent).join(used.hint("merge"), ["problem", "__id"], "left")
    ends = ends.withColumn("closed", F.col("__used").isNull() & F.coalesce(F.col("__spent") >= 0, F.lit(False)))
    return segments.where("type > 0").withColumn("closed", F.lit(False)).unionByName(ends.select(*segments.columns, "closed"))


def solved(segments: DataFrame, slices: DataFrame, cliques: DataFrame, forced: bool = False, user: DataFrame | None = None, limit: int = 20_000_000, pieces: DataFrame | None = None) -> DataFrame:
    """All segments (problem, key, type, isi, sl, sr, cost and more) with x under the whole programme.

    Ends that some best solution leaves out are at 0 and in no row; rows are made of what stays open, and of its slices' cliques.
    pieces: see `solve_pieces`.
    """
    if forced:
        every, open_ = None, segments
    else:
        every = settled(opened(segments, user))
        open_ = every.where("not closed").drop("closed")
    ids = settled(open_.select(F.explode(F.concat("sl", "sr")).alias("id")).distinct())
    near = settled(cliques.join(ids.hint("merge"), "id", "left_semi"))
    rows = programme(open_, slices.select("id").join(ids.hint("merge"), "id", "left_semi"), near, forced, user)
    found = solve(open_.select("problem", "key", "cost"), rows, limit) if pieces is None else solve_pieces(open_, rows, pieces, limit)
    got = open_.join(found.hint("merge"), ["problem", "key"])
    if every is None:
        return got
    return got.unionByName(every.where("closed").drop("closed").withColumn("x", F.lit(0)).select(*got.columns))


def solve_segments(segments: DataFrame, slices: DataFrame, cliques: DataFrame, forced: bool = False, user: DataFrame | None = None, limit: int = 20_000_000) -> DataFrame:
    """problem, key, x of all segments (problem, key, type, isi, sl, sr, cost) under the whole programme."""
    return solved(segments, slices, cliques, forced, user, limit).select("problem", "key", "x")


def broken(segments: DataFrame, slices: DataFrame, cliques: DataFrame) -> DataFrame:
    """row, relation, value, have of the rows of `programme` (not forced) over segments with x that their solution breaks.

    A row without a chosen segment has 0, which no row forbids, so only slices of chosen segments are looked at, with all segments that they are in.
    """
    m = settled(segments.where("x <> 0").select("problem", F.explode(F.concat("sl", "sr")).alias("__id")).distinct())
    named = segments.select("*", F.explode(F.concat("sl", "sr")).alias("__id")).join(m.hint("merge"), ["problem", "__id"], "left_semi")
    near = settled(named.drop("__id").dropDuplicates(["problem", "key"]))
    ids = settled(m.select(F.col("__id").alias("id")).distinct())
    rows = programme(near, slices.select("id").join(ids.hint("merge"), "id", "left_semi"), cliques.join(ids.hint("merge"), "id", "left_semi"))
    sums = rows.join(near.select("problem", "key", "x").hint("merge"), ["problem", "key"]).groupBy("problem", "row", "relation", "value").agg(F.sum(F.col("coef") * F.col("x")).alias("have"))
    return sums.where((F.col("relation") == "=") & (F.col("have") != F.col("value")) | (F.col("relation") == "<=") & (F.col("have") > F.col("value")))


def chosen(solution: DataFrame) -> DataFrame:
    return solution.where("x = 1").select("problem", "key")


def reconstruct(segments: DataFrame, solution: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and discarded segments."""
    on = solution.where("x = 1").select("key").distinct()
    return segments.join(on, "key", "left_semi"), segments.join(on, "key", "left_anti")


def assemblies(segments: DataFrame) -> DataFrame:
    """key, assembly (and problem, if segments have one): segments that share slices, directly or over others; named by the least slice id."""
    by = ["problem"] if "problem" in segments.columns else []
    m = constraints._members(segments)
    if not by:
        first = m.groupBy("key").agg(F.min("id").alias("b"))
        comp = components(m.join(first, "key").select(F.col("id").alias("a"), "b").distinct())
        return first.join(comp, F.col("b") == F.col("id")).select("key", F.col("component").alias("assembly"))
    # slices of each problem for themselves
    first = m.groupBy("problem", "key").agg(F.min("id").alias("b"))
    comp = components_within(m.join(first, ["problem", "key"]).select("problem", F.col("id").alias("a"), "b").distinct(), "problem")
    return first.join(comp, (first["problem"] == comp["problem"]) & (F.col("b") == F.col("id"))).select(first["problem"], "key", F.col("component").alias("assembly"))
