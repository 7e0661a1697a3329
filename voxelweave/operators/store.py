"""Stores: tables that keep what is there.  Plain Parquet has no MERGE, so writes are anti-joins and new versions.

A version of a table is a manifest: a small file that lists the folders of Parquet files that
make it up.  `save` writes one new folder, `append` adds one to those of the version before, and
both then move a finished manifest into place under the next number; readers take the highest.
So a reader sees one version or the other, never a part of one, and a crash leaves the old one.
Old versions stay until `vacuum`.  Of two writers that make the same version one gets an error.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .graph import settled


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows, and new ones whose key isn't there; one of equal keys (the first by all columns)."""
    w = W.partitionBy(*keys).orderBy(*[F.col(c) for c in new.columns if c not in keys] or [F.lit(1)])
    once = new.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return existing.unionByName(once.join(existing.select(*keys), keys, "left_anti"))


def replace_partitions(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of partitions (values of keys) that `new` has are replaced."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def clique_pairs(cliques: DataFrame) -> DataFrame:
    """clique, a < b (as unsigned numbers): the pairs of each clique (clique, id); cliques of one slice have none."""
    low = lambda c: F.col(c).bitwiseXOR(-(1 << 63))  # noqa: E731  unsigned order
    j = cliques.alias("p").join(cliques.alias("q"), (F.col("p.clique") == F.col("q.clique")) & (low("p.id") < low("q.id")))
    return j.select("p.clique", F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct()


def cliques_by_blocks(pairs: DataFrame, blocks_of: DataFrame, blocks: DataFrame) -> DataFrame:
    """clique, ids: members that pairs stored for the blocks have; a clique cut by the request is partial."""
    near = blocks_of.join(blocks, blocks.columns, "left_semi").select("a", "b").distinct()
    p = pairs.join(near, ["a", "b"], "left_semi")
    return p.select("clique", F.explode(F.array("a", "b")).alias("id")).groupBy("clique").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def slices_by_blocks(slices: DataFrame, links: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each slice once that a requested block has."""
    return slices.join(links.join(blocks, blocks.columns, "left_semi").select("id").distinct(), "id", "left_semi")


def slices_by_segments(slices: DataFrame, segment_slices: DataFrame, keys: DataFrame) -> DataFrame:
    return slices.join(segment_slices.join(keys.select("key"), "key", "left_semi").select("id").distinct(), "id", "left_semi")


def segments_by_blocks(segments: DataFrame, links: DataFrame, blocks: DataFrame, features: DataFrame, read_costs: bool) -> DataFrame:
    """segments (key, cost, sl, sr), with slices (sorted, with side) and features (key), that have a slice in the blocks; links: id and block of slices.

    read_costs: features only where a cost is missing; else always, and segments without any are left out.
    Blocks are looked up before anything is joined, and segments meet the slices found there once, with their own slices in their rows.
    """
    near = links.join(blocks, blocks.columns, "left_semi").select(F.col("id").alias("__id")).distinct()
    s = segments.withColumn("__id", F.explode(F.concat("sl", "sr"))).join(near, "__id", "left_semi").drop("__id").dropDuplicates(["key"])
    side = lambda c, left: F.transform(c, lambda x: F.struct(x.alias("id"), F.lit(left).alias("is_left")))
    s = s.withColumn("slices", F.array_sort(F.array_distinct(F.concat(side("sl", True), side("sr", False))))).drop("sl", "sr")
    if read_costs:
        f = features.withColumnRenamed("key", "__key")
        return s.join(f, (F.col("key") == F.col("__key")) & F.col("cost").isNull(), "left").drop("__key")
    return s.join(features, "key")


def new_assemblies(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Assemblies (core, hash) that aren't stored."""
    return found.select("core", "hash").distinct().join(stored.select("core", "hash"), ["core", "hash"], "left_anti")


def store_solution(stored: DataFrame, links: DataFrame, member: DataFrame, found: DataFrame, solution: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Assemblies (core, hash), links (solution, core, hash) and members (core, hash, key) with a solution's assemblies (core, hash, key) added; members only of new ones."""
    new = new_assemblies(stored, found)
    all_links = links.unionByName(found.select(F.lit(solution).cast("long").alias("solution"), "core", "hash").distinct())
    return stored.unionByName(new), all_links, member.unionByName(found.select("core", "hash", "key").join(new, ["core", "hash"], "left_semi"))


def latest_solution(links: DataFrame, precedence: DataFrame) -> DataFrame:
    """core, hash of the solution that has precedence in each core (core, solution)."""
    return links.join(precedence, ["core", "solution"], "left_semi").select("core", "hash")


def same_sets(a: DataFrame, b: DataFrame, columns: list[str]) -> bool:
    """Whether both have the same rows, as often."""
    x, y = a.select(*columns), b.select(*columns)
    return not x.exceptAll(y).take(1) and not y.exceptAll(x).take(1)


def set_keys(members: DataFrame, name: str = "clique") -> DataFrame:
    """name, ids: each set's members, sorted, as text; sets are equal if these are, whatever their names and order."""
    return members.groupBy(name).agg(F.array_join(F.transform(F.array_sort(F.collect_set("id")), lambda x: x.cast("string")), "-").alias("ids"))


class Missing(LookupError):
    """There is no such table in the store."""


class Concurrent(RuntimeError):
    """Another writer has made the version that this one was about to make."""


def _files(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    of = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    return of, of(path).getFileSystem(conf)


def _versions(spark: SparkSession, path: str, name: str) -> list[tuple[int, str]]:
    of, system = _files(spark, path)
    folder = of(f"{path}/{name}")
    if not system.exists(folder):
        return []
    found = (re.fullmatch(r"version-(\d+)\.json", x.getPath().getName()) for x in system.listStatus(folder))
    return sorted((int(m[1]), f"{path}/{name}/{m[0]}") for m in found if m)


def _read(spark: SparkSession, manifest: str) -> dict:
    return json.loads(spark.read.text(manifest, wholetext=True).first()[0])


def _commit(spark: SparkSession, path: str, name: str, number: int, parts: list[str]) -> None:
    of, system = _files(spark, path)
    who, at = uuid.uuid4().hex, f"{path}/{name}/version-{number:08d}.json"
    tmp = of(f"{path}/{name}/_writing-{who}")
    out = system.create(tmp, False)
    out.write(bytearray(json.dumps({"who": who, "parts": parts}), "utf-8"))
    out.close()
    if system.exists(of(at)) or not system.rename(tmp, of(at)) or _read(spark, at)["who"] != who:
        system.delete(tmp, False)
        raise Concurrent(f"version {number} of {name} was made by another writer")


def _write(df: DataFrame, path: str, name: str) -> str:
    at = f"{path}/{name}/part-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return at


def save(df: DataFrame, path: str, name: str) -> str:
    """Writes df as the next version of table `name`; gives the folder."""
    spark = df.sparkSession
    had = _versions(spark, path, name)
    at = _write(df, path, name)
    _commit(spark, path, name, had[-1][0] + 1 if had else 0, [at])
    return at


def append(df: DataFrame, path: str, name: str, most: int = 64) -> None:
    """Adds rows to table `name`, without reading or writing what is there; after `most` folders they are rewritten as one."""
    spark = df.sparkSession
    had = _versions(spark, path, name)
    if not had:
        save(df, path, name)
        return
    at = _write(df, path, name)
    parts = [*_read(spark, had[-1][1])["parts"], at]
    if len(parts) > most:
        parts = [_write(spark.read.parquet(*parts).hint("rebalance"), path, name)]
    _commit(spark, path, name, had[-1][0] + 1, parts)


def exists(spark: SparkSession, path: str, name: str) -> bool:
    return bool(_versions(spark, path, name))


def load(spark: SparkSession, path: str, name: str) -> DataFrame:
    had = _versions(spark, path, name)
    if not had:
        raise Missing(f"{path} has no table {name}")
    return spark.read.parquet(*_read(spark, had[-1][1])["parts"])


def vacuum(spark: SparkSession, path: str, name: str) -> None:
    """Deletes versions but the last, and folders that it doesn't name; only while nobody reads or writes the table."""
    had = _versions(spark, path, name)
    if not had:
        return
    of, system = _files(spark, path)
    keep = {p.rsplit("/", 1)[1] for p in _read(spark, had[-1][1])["parts"]} | {had[-1][1].rsplit("/", 1)[1]}
    for x in system.listStatus(of(f"{path}/{name}")):
        if x.getPath().getName() not in keep:
            system.delete(x.getPath(), True)


class Tables:
    """Tables in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self, name: str) -> bool:
        return exists(self.spark, self.path, name)

    def load(self, name: str) -> DataFrame:
        return load(self.spark, self.path, name)

    def save(self, df: DataFrame, name: str) -> None:
        save(df, self.path, name)

    def append(self, df: DataFrame, name: str) -> None:
        append(df, self.path, name)

    def upsert(self, df: DataFrame, name: str, keys: list[str]) -> None:
        """Appends the rows whose keys aren't there, one of each.  Of a table with cells only those of the new rows are looked at: equal keys must have equal cells."""
        if not self.exists(name):
            self.save(insert_ignore(df.limit(0), df, keys), name)
            return
        had = self.near(name, cells_of(df)) if "cell" in df.columns else self.load(name)
        self.append(insert_ignore(df.limit(0), df.select(*had.columns), keys).join(had.select(*keys), keys, "left_anti"), name)

    def near(self, name: str, cells: list[str] | None) -> DataFrame:
        """Rows of cells; all rows for None."""
        rows = self.load(name)
        return rows if cells is None else rows.where(F.col("cell").isin(cells))

    def put(self, df: DataFrame, name: str) -> None:
        """Appends rows under a new version; what they replace stays, and latest() reads the newest.  Writes no more than it is given."""
        self.append(df.withColumn("version", F.lit(time.time_ns())), name)

    def latest(self, name: str, keys: list[str]) -> DataFrame:
        """The newest row of each key of a table that put() writes."""
        rows = self.load(name)
        rest = [c for c in rows.columns if c not in (*keys, "version")]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("__row")).select(*keys, "__row.*")


#: cells that a request may name; of more, all partitions are read
MOST_CELLS = 4096


def cells_of(df: DataFrame, column: str = "cell") -> list[str] | None:
    """The distinct cells of rows, at most MOST_CELLS, or None."""
    found = df.select(column).distinct().limit(MOST_CELLS + 1).collect()
    return None if len(found) > MOST_CELLS else sorted(r[0] for r in found if r[0] is not None)


class BlockTables(Tables):
    """Plain Parquet tables, partitioned by `cell` where they have one, so that a request for blocks opens the folders of its cells only.

    Writers append; a table's columns are kept beside it, so reading opens no files to find them.  Rows have keys, and
    the engine sets a block's flag after its rows: a write that was cut short is completed by the next call, and
    rows that it left are found there.  compact() rewrites cells that have gathered many small files.
    """

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _schema(self, name: str):
        of, system = _files(self.spark, self.path)
        return of(f"{self._at(name)}/_columns.json"), system

    def exists(self, name: str) -> bool:
        at, system = self._schema(name)
        return system.exists(at)

    def load(self, name: str) -> DataFrame:
        at, system = self._schema(name)
        if not system.exists(at):
            raise Missing(f"{self.path} has no table {name}")
        stream = system.open(at)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return self.spark.read.schema(StructType.fromJson(json.loads(text))).parquet(self._at(name))

    def _put_down(self, df: DataFrame, name: str, mode: str) -> None:
        at, system = self._schema(name)
        has = "cell" in df.columns
        out = (df.hint("rebalance", "cell") if has else df).write.mode(mode)
        (out.partitionBy("cell") if has else out).parquet(self._at(name))
        if mode == "overwrite" or not system.exists(at):
            fields = [f for f in df.schema.fields if f.name != "cell"] + [f for f in df.schema.fields if f.name == "cell"]
            sink = system.create(at, True)
            sink.write(bytearray(StructType(fields).json(), "utf-8"))
            sink.close()

    def save(self, df: DataFrame, name: str) -> None:
        self._put_down(df, name, "overwrite")

    def append(self, df: DataFrame, name: str) -> None:
        self._put_down(df, name, "append")

    def compact(self, name: str, cells: list[str] | None = None) -> None:
        """Rewrites cells (None: all), each as one file or as many as its bytes need, while nobody writes them."""
        rows = settled(self.near(name, cells))
        out = rows.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").option("partitionOverwriteMode", "dynamic")
        out.parquet(self._at(name))


class Memory(Tables):
    """The same kept by the session alone, for small volumes: rows are cached, not written.  The tables go with the session."""

    def __init__(self, spark: SparkSession, path: str = ""):
        super().__init__(spark, path)
        self.tables: dict[str, DataFrame] = {}

    def exists(self, name: str) -> bool:
        return name in self.tables

    def load(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise Missing(f"no table {name}")
        return self.tables[name]

    def save(self, df: DataFrame, name: str) -> None:
        df = df.cache()
        df.count()
        self.tables[name] = df

    def append(self, df: DataFrame, name: str) -> None:
        self.save(self.tables[name].unionByName(df) if name in self.tables else df, name)


BACKENDS = {"parquet": Tables, "blocks": BlockTables, "memory": Memory}


def backend(name: str):
    """The class of a backend's tables; made with a session and a path."""
    if name not in BACKENDS:
        raise ValueError(f"no backend {name}")
    return BACKENDS[name]
