"""Slices, segments, solutions and ground truth of blocks and cores, made where they aren't there.

Each call takes the blocks or cores it is about and gives the blocks that its input lacks (then
it has written nothing), or none and the result is in the store.  What is stored is kept: rows
are added once, only the requested blocks and cores are flagged, and a repeated call changes
nothing.  `complete` calls again and again, making what is missing, until nothing is.
Configuration and parameters are dataclasses and pickle.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import costs, features, grid, labels, masks, segments, solve, store
from .operators.graph import settled
from .sources.stacks import ProjectConfiguration, UsageError

log = logging.getLogger("voxelweave")
BLOCK, CORE = ["bx", "by", "bz"], ["cx", "cy", "cz"]


def set_log_level(level: int | str) -> None:
    log.setLevel(level)


def get_log_level() -> int:
    return log.getEffectiveLevel()


@dataclass(frozen=True)
class SliceParameters:
    least: int = 100
    most: int = 100_000
    membrane_is_bright: bool = True


@dataclass(frozen=True)
class SolutionParameters:
    padding: int = 2
    force_explanation: bool = False
    read_costs: bool = False
    store_costs: bool = True


class Engine:
    """runs: every slice of the volume as runs (id, z, y, x0, x1), such as operators.extract makes of images; values: id, value of its pixels."""

    def __init__(self, spark: SparkSession, config: ProjectConfiguration, runs: DataFrame | None = None, values: DataFrame | None = None, cliques: DataFrame | None = None):
        self.spark, self.config, self.runs, self.values, self.cliques = spark, config, runs, values, cliques
        self.grid = grid.Grid(config.block, config.volume, config.core)
        self.tables = store.backend(config.backend)(spark, config.path)

    def _none(self) -> DataFrame:
        return grid.all_blocks(self.spark, self.grid).limit(0)

    def _flag(self, blocks: DataFrame, name: str, keys: list[str] = BLOCK) -> None:
        self.tables.upsert(blocks.select(*keys).distinct().withColumn("flag", F.lit(True)), name, keys)

    def _missing(self, blocks: DataFrame, name: str) -> DataFrame:
        if not self.tables.exists(name):
            return blocks.select(*BLOCK).distinct()
        return grid.missing(blocks.select(*BLOCK).distinct(), self.tables.load(name), "flag")

    def _cells(self, blocks: DataFrame) -> list[str] | None:
        return store.cells_of(blocks.select(grid.cell_of().alias("cell")))

    def _slices_of(self, blocks: DataFrame) -> tuple[DataFrame, list[str] | None]:
        """Stored slices of blocks, and the cells that they are kept in."""
        links = settled(self.tables.near("links", self._cells(blocks)).join(blocks, BLOCK, "left_semi").select("id", "home").distinct())
        homes = store.cells_of(links, "home")
        return settled(self.tables.near("slices", homes).drop("cell").join(links.select("id"), "id", "left_semi")), homes

    def _conflicts(self, homes: list[str] | None) -> DataFrame:
        return self.tables.near("conflicts", homes).drop("cell").distinct()

    def slices(self, blocks: DataFrame, p: SliceParameters = SliceParameters()) -> DataFrame:
        """Stores the slices of blocks within the size bounds, those that share a clique with one of them, their masks, block links and conflicts."""
        todo = settled(self._missing(blocks, "slices_done"))
        if not todo.take(1):
            return self._none()
        if self.runs is None:
            raise UsageError("no slices to take from")
        z = todo.select("bz").distinct().select(F.explode(F.sequence(F.col("bz") * self.grid.block[2], (F.col("bz") + 1) * self.grid.block[2] - 1)).alias("z"))
        runs = self.runs.select("id", "z", "y", "x0", "x1").join(z, "z", "left_semi")
        boxes = settled(masks.measure(runs).where(F.col("sz").between(p.least, p.most)).withColumn("cell", grid.home_of(self.grid)))
        links = grid.slice_blocks(boxes, self.grid)
        near = links.join(todo, BLOCK, "left_semi").select("id").distinct()
        whole = near
        if self.cliques is not None:
            whole = near.union(self.cliques.join(self.cliques.join(near, "id", "left_semi").select("clique").distinct(), "clique", "left_semi").select("id")).distinct()
        whole = settled(whole)
        own = lambda df: df.join(whole, "id", "left_semi")
        self.tables.upsert(own(boxes), "slices", ["id"])
        kept = settled(own(runs).join(boxes.select("id", "sz", "cell"), "id"))
        self.tables.upsert(kept, "runs", ["id", "z", "y", "x0"])
        homes = boxes.select("id", F.col("cell").alias("home"))
        self.tables.upsert(own(links).select("id", *BLOCK).join(homes, "id").withColumn("cell", grid.cell_of()), "links", ["id", *BLOCK])
        t = masks.tiles(kept, "sz")
        pairs = masks.conflict_pairs(t).select("a_id", "b_id", "z", "o")
        for side in ("a", "b"):  # a conflict is found from either slice's cell
            pairs = pairs.join(homes.select(F.col("id").alias(f"{side}_id"), F.col("home").alias(side)), f"{side}_id")
        pairs = pairs.withColumn("cell", F.explode(F.array_distinct(F.array("a", "b")))).drop("a", "b")
        self.tables.upsert(pairs, "conflicts", ["a_id", "b_id", "cell"])
        self._flag(todo, "slices_done")
        log.info("slices of %s blocks", todo.count())
        return self._none()

    def segments(self, blocks: DataFrame) -> DataFrame:
        """Stores the segments of blocks, made of the slices of the blocks and those next to them, with features and block links."""
        todo = settled(self._missing(blocks, "segments_done"))
        if not todo.take(1):
            return self._none()
        need = settled(grid.expand(todo, (1, 1, 1), self.grid))
        lack = settled(self._missing(need, "slices_done"))
        if lack.take(1):
            return lack
        s, homes = self._slices_of(need)
        runs = settled(self.tables.near("runs", homes).drop("cell").join(s.select("id"), "id", "left_semi"))
        pairs = settled(masks.overlap_pairs(masks.tiles(runs, "sz")))
        conflicts = self._conflicts(homes)
        seg = settled(segments.all_segments(s, pairs, conflicts))
        # a segment is kept in the cell of the first of all its blocks, whichever of them are asked for
        every = grid.segment_blocks(seg, s, self.grid)
        first = F.min(F.struct("bz", "by", "bx")).alias("b")
        homes = every.groupBy("key").agg(first).select("key", "b.*").select("key", grid.cell_of().alias("home"))
        links = settled(every.join(todo, BLOCK, "left_semi").join(homes, "key").withColumn("cell", grid.cell_of()))
        seg = settled(seg.join(links.select("key", F.col("home").alias("cell")).distinct(), "key"))
        hist = features.histograms(self.values) if self.values is not None else self.spark.createDataFrame([], "id long, h array<long>")
        new = seg.join(self.tables.near("segments", store.cells_of(seg)).select("key"), "key", "left_anti") if self.tables.exists("segments") else seg
        vectors = features.vector(new, s, runs, pairs, hist).select("key", "features")
        self.tables.upsert(new.join(vectors, "key").withColumn("cost", F.lit(None).cast("double")), "segments", ["key"])
        self.tables.upsert(links, "segment_links", ["key", *BLOCK])
        self._flag(todo, "segments_done")
        return self._none()

    def solve(self, cores: DataFrame, p: SolutionParameters = SolutionParameters(), cost: Callable[[DataFrame], DataFrame] | None = None, user: DataFrame | None = None) -> DataFrame:
        """Stores the solution of cores (cx, cy, cz), each over the segments of its blocks and `padding` blocks around.

        A segment's cost is the stored one where read_costs says so and there is one; else cost(segments) gives (key, cost),
        or the product of features and the configured weights.  New costs are stored if store_costs says so.  user: rows
        (row, key, coef, relation, value) that a solution must meet.
        """
        cores = settled(cores.select(*CORE).distinct())
        wide = settled(grid.core_blocks(cores, self.grid, p.padding))
        lack = settled(self._missing(wide, "segments_done"))
        if lack.take(1):
            return lack
        number = F.xxhash64(*CORE).alias("problem")
        links = self.tables.near("segment_links", self._cells(wide)).join(wide, BLOCK).select(number, *CORE, "key", "home").distinct()
        stored = self.tables.near("segments", store.cells_of(links, "home")).drop("cell")
        links = links.drop("home")
        mine = settled(stored.join(links.select("key").distinct(), "key", "left_semi"))
        known = self.tables.latest("costs", ["key"]) if self.tables.exists("costs") else mine.select("key", "cost").limit(0)
        have = mine.select("key").join(known, "key") if p.read_costs else known.limit(0)
        todo = mine.join(have.select("key"), "key", "left_anti")
        fresh = cost(todo) if cost else costs.linear(todo, self._weights())
        fresh = settled(fresh.select("key", "cost"))
        if p.store_costs:
            self.tables.put(fresh, "costs")
        priced = have.unionByName(fresh)
        every = settled(mine.select("key", "type", "isi", "sl", "sr").join(priced, "key").join(links.select("problem", "key"), "key"))
        slices, homes = self._slices_of(grid.expand(wide.select(*BLOCK).distinct(), (1, 1, 1), self.grid))
        name = F.concat_ws("-", "a_id", "b_id")
        ids = every.select(F.explode(F.concat("sl", "sr")).alias("id")).distinct()
        near = slices.join(ids, "id", "left_semi")
        cliques = self._conflicts(homes).select(name.alias("clique"), F.explode(F.array("a_id", "b_id")).alias("id"), F.lit(True).alias("maximal")).join(ids, "id", "left_semi")
        got = settled(solve.solve_segments(every, near, cliques, p.force_explanation, user))
        chosen = every.join(got.where("x = 1").select("problem", "key"), ["problem", "key"], "left_semi")
        # what of it lies in the core itself, and what hangs together there
        inside = grid.segment_blocks(chosen.select("key", "isi", "sl", "sr").distinct(), slices, grid.cores_grid(self.grid), name="c")
        place = cores.select(number, *CORE)
        chosen = settled(chosen.join(inside.join(place, CORE), ["problem", "key"]))
        found = solve.assemblies(chosen).join(place, "problem").select(*CORE, "assembly", "key")
        members = found.groupBy(*CORE, "assembly").agg(F.xxhash64(F.array_sort(F.collect_set("key"))).alias("hash")).join(found, [*CORE, "assembly"])
        self._store_solution(settled(members.select(*CORE, "hash", "assembly", "key")), cores)
        return self._none()

    def _weights(self) -> list[float]:
        if len(self.config.weights) != len(features.NAMES):
            raise UsageError(f"{len(self.config.weights)} weights, {len(features.NAMES)} features")
        return list(self.config.weights)

    def _store_solution(self, found: DataFrame, cores: DataFrame) -> None:
        """Members of new assemblies (core, hash), and for each core the solution that now has precedence."""
        self.tables.upsert(found, "assemblies", [*CORE, "hash", "key"])
        last = self.tables.load("solutions").agg(F.max("solution")).first()[0] if self.tables.exists("solutions") else None
        solution = F.lit(0 if last is None else last + 1).cast("long").alias("solution")
        links = found.select(*CORE, "hash").distinct().select(solution, "*")
        if last is not None:  # the same assemblies again are the same solution
            latest = self.solution(cores).select(*CORE, "hash").distinct()
            if store.same_sets(latest, links.drop("solution"), [*CORE, "hash"]) and not cores.join(self.tables.load("solution_done"), CORE, "left_anti").take(1):
                return
        self.tables.append(links, "solutions")
        self.tables.put(cores.select(*CORE, solution), "precedence")
        self._flag(cores, "solution_done", CORE)

    def solution(self, cores: DataFrame) -> DataFrame:
        """cx, cy, cz, hash, assembly, key: the chosen segments of cores by assembly, of the solution that has precedence."""
        mine = self.tables.load("solutions").join(self.tables.latest("precedence", CORE).join(cores.select(*CORE), CORE, "left_semi"), [*CORE, "solution"], "left_semi")
        return self.tables.load("assemblies").join(mine.select(*CORE, "hash").distinct(), [*CORE, "hash"], "left_semi")

    def ground_truth(self, cores: DataFrame, labelled: DataFrame) -> DataFrame:
        """Links and ends of the labelled slices (id, label) of cores and of one block around them."""
        wide = settled(grid.core_blocks(cores, self.grid, 1))
        lack = settled(self._missing(wide, "slices_done"))
        if lack.take(1):
            return lack
        s, homes = self._slices_of(wide.select(*BLOCK).distinct())
        s = s.join(labelled.select("id", "label"), "id")
        runs = settled(self.tables.near("runs", homes).drop("cell").join(s.select("id", "label"), "id"))
        links = settled(labels.spanning_forest(runs))
        self.tables.upsert(links, "truth", ["label", "a", "b"])
        self.tables.upsert(labels.open_ends(s, links), "truth_ends", ["id"])
        self._flag(cores, "truth_done", CORE)
        return self._none()

    def complete(self, call: Callable[[], DataFrame], make: Callable[[DataFrame], DataFrame], rounds: int = 10) -> int:
        """Calls `call` until it lacks nothing, making what it lacks with `make` in between, which may itself lack something; gives the number of calls."""
        for k in range(1, rounds + 1):
            lack = call()
            if not lack.take(1):
                return k
            below = make(lack)
            if below.take(1) and make is not self.slices:
                self.complete(lambda lack=lack: make(lack), self.slices, rounds)
        raise RuntimeError(f"still incomplete after {rounds} calls")


__all__ = ["Engine", "ProjectConfiguration", "SliceParameters", "SolutionParameters", "set_log_level", "get_log_level"]
