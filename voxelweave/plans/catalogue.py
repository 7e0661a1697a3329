"""Queries over the driver's tables, one or more for each operator, with SQL for another engine.

"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import isi, key_of, neglog, normalised, one_hot, segment_hash, segment_type, signed, slice_hash, type_name, unsigned
from ..operators import constraints as C
from ..operators import costs, extract, features, graph, grid, labels, learned, masks, solve, spatial, store
from ..operators import segments as SG
from ..sources import adapter, stacks, volumes
from ..sources import tiles as tile_source
from ..sources.adapter import SLICES_SQL as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- SQL pieces ---

OV = """ov AS (SELECT o.*, p.sz AS a_sz, q.sz AS b_sz FROM (SELECT a.id AS a_id, b.id AS b_id, a.z AS z, CAST(sum(least(a.x1,b.x1)-greatest(a.x0,b.x0)) AS BIGINT) AS o
  FROM runs a JOIN runs b ON b.z = a.z+1 AND a.y = b.y AND a.x0<b.x1 AND b.x0<a.x1 GROUP BY 1, 2, 3) o JOIN slices p ON p.id = a_id JOIN slices q ON q.id = b_id)"""
CF = """cf AS (SELECT o.*, p.sz AS a_sz, q.sz AS b_sz FROM (SELECT a.id AS a_id, b.id AS b_id, a.z AS z, CAST(sum(least(a.x1,b.x1)-greatest(a.x0,b.x0)) AS BIGINT) AS o
  FROM runs a JOIN runs b ON b.z = a.z AND a.id < b.id AND a.y = b.y AND a.x0<b.x1 AND b.x0<a.x1 GROUP BY 1, 2, 3) o JOIN slices p ON p.id = a_id JOIN slices q ON q.id = b_id)"""
LIKE = "CAST(o AS DOUBLE)/CAST(greatest(a_sz+b_sz-o,1) AS DOUBLE)"


def _branch_sql(name: str, s: str, t: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT p.{s}_id AS source, p.{t}_id AS t1, q.{t}_id AS t2, p.z AS z, p.o+q.o AS o, p.{s}_sz AS s_sz, p.{t}_sz AS sz1, q.{t}_sz AS sz2
  FROM ov p JOIN ov q ON p.{s}_id = q.{s}_id AND p.{t}_id > q.{t}_id) c
  WHERE CAST(o AS DOUBLE)/CAST(greatest(s_sz+sz1+sz2-o,1) AS DOUBLE) >= 0.5 AND CAST(least(sz1,sz2) AS DOUBLE)/CAST(greatest(sz1,sz2) AS DOUBLE) >= 0.5
  AND NOT EXISTS (SELECT 1 FROM cf WHERE cf.a_id = c.t2 AND cf.b_id = c.t1))"""


BR, BL = _branch_sql("br", "a", "b"), _branch_sql("bl", "b", "a")
MEM = f"""seg AS (SELECT 'E:'||id||':R' AS key, 0 AS type, z+1 AS isi FROM slices UNION ALL SELECT 'E:'||id||':L', 0, z FROM slices
  UNION ALL SELECT 'C:'||a_id||':'||b_id, 1, z+1 FROM ov WHERE {LIKE} >= 0.5
  UNION ALL SELECT 'B:'||source||':'||t2||':'||t1||':R', 2, z+1 FROM br UNION ALL SELECT 'B:'||source||':'||t2||':'||t1||':L', 2, z+1 FROM bl),
mem AS (SELECT 'E:'||id||':R' AS key, id, true AS is_left FROM slices UNION ALL SELECT 'E:'||id||':L', id, false FROM slices
  UNION ALL SELECT 'C:'||a_id||':'||b_id, a_id, true FROM ov WHERE {LIKE} >= 0.5 UNION ALL SELECT 'C:'||a_id||':'||b_id, b_id, false FROM ov WHERE {LIKE} >= 0.5
  UNION ALL SELECT 'B:'||source||':'||t2||':'||t1||':R', source, true FROM br UNION ALL SELECT 'B:'||source||':'||t2||':'||t1||':R', t1, false FROM br UNION ALL SELECT 'B:'||source||':'||t2||':'||t1||':R', t2, false FROM br
  UNION ALL SELECT 'B:'||source||':'||t2||':'||t1||':L', source, false FROM bl UNION ALL SELECT 'B:'||source||':'||t2||':'||t1||':L', t1, true FROM bl UNION ALL SELECT 'B:'||source||':'||t2||':'||t1||':L', t2, true FROM bl)"""
W_OV = f"WITH {S}, {OV} "
W_CF = f"WITH {S}, {CF} "
W_SEG = f"WITH {S}, {OV}, {CF}, {BR}, {BL}, {MEM} "
VOL = "vol AS (SELECT max(x1) AS vx, max(y1) AS vy, max(z)+1 AS vz FROM slices)"
BLOCK, CORE = (64, 16, 10), (2, 2, 2)
EXT = f"ext AS (SELECT (vx+{BLOCK[0] - 1})//{BLOCK[0]} AS ex, (vy+{BLOCK[1] - 1})//{BLOCK[1]} AS ey, (vz+{BLOCK[2] - 1})//{BLOCK[2]} AS ez FROM vol)"
BLOCKS = "blocks AS (SELECT bx, by, bz FROM ext, range(0, ex) r(bx), range(0, ey) s(by), range(0, ez) t(bz))"
LINKS = f"""links AS (SELECT id, bx, by, bz FROM (SELECT id, z//{BLOCK[2]} AS bz, unnest(range(x0//{BLOCK[0]}, (x1-1)//{BLOCK[0]}+1)) AS bx, y0, y1 FROM slices) q, LATERAL (SELECT unnest(range(y0//{BLOCK[1]}, (y1-1)//{BLOCK[1]}+1)) AS by) l)"""
W_GRID = f"WITH {S}, {VOL}, {EXT}, {BLOCKS}, {LINKS} "


_KEPT: dict[tuple, object] = {}


def state_of(spark, d) -> tuple:
    """A folder's entries with their sizes and times: other files are other tables."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(d)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return tuple(sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in found))


def kept(spark, d, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries read, written once a session and state of the folder."""
    key = (spark.sparkContext.applicationId, d, state_of(spark, d), name)
    if key not in _KEPT:
        _KEPT[key] = graph.settled(make())
    return _KEPT[key]


def packed(spark, d):
    """Slices with their masks in their rows."""
    return kept(spark, d, "slices", lambda: adapter.packed(spark, d))


def sl(spark, d):
    return packed(spark, d).drop("lines")


def runs(spark, d):
    return masks.runs_of(packed(spark, d), "sz")


def _met(spark, d):
    return kept(spark, d, "met", lambda: masks.met(packed(spark, d)))


def pairs(spark, d):
    return _met(spark, d).where("dz = 1").drop("dz")


def conflicts(spark, d):
    return _met(spark, d).where("dz = 0").drop("dz")


def segs(spark, d):
    return kept(spark, d, "segments", lambda: SG.all_segments(sl(spark, d), pairs(spark, d), conflicts(spark, d)))


kept_segs = segs


def the_grid(spark, d) -> grid.Grid:
    """The volume is that of all slices: three numbers."""
    v = sl(spark, d).agg(F.max("x1"), F.max("y1"), F.max("z") + 1).first()
    return grid.Grid(BLOCK, tuple(v), CORE)


def cliques(spark, d):
    """clique, id, maximal: pairs of overlapping slices of a section."""
    return conflicts(spark, d).select(F.concat_ws("-", "a_id", "b_id").alias("clique"), F.explode(F.array("a_id", "b_id")).alias("id"), F.lit(True).alias("maximal"))


CLIQUES = "cliques AS (SELECT a_id||'-'||b_id AS clique, unnest([a_id, b_id]) AS id FROM cf)"

# --- flagship ---


@query(W_OV + f"SELECT z, CAST(count(*) AS BIGINT) AS n, CAST(sum(o) AS BIGINT) AS pixels FROM ov WHERE {LIKE} >= 0.5 GROUP BY z")
def continuation_counts(spark, d):
    """The minimum slice, from boxes to continuations by section."""
    return SG.continuations(pairs(spark, d)).groupBy("z").agg(F.count("*").alias("n"), F.sum("o").alias("pixels"))


# --- grid ---


@query(W_GRID + "SELECT bx, by, bz, bx*64 AS min_x, (bx+1)*64 AS max_x, by*16 AS min_y, (by+1)*16 AS max_y, bz*10 AS min_z, (bz+1)*10 AS max_z FROM blocks")
def block_grid(spark, d):
    """Every block of the volume with its box."""
    g = the_grid(spark, d)
    return grid.with_box(grid.all_blocks(spark, g), g)


@query(f"WITH {S} SELECT id, x0//64 AS bx, y0//16 AS by, z//10 AS bz, x0//128 AS cx, y0//32 AS cy, z//20 AS cz FROM slices")
def block_of_slice(spark, d):
    """Block and core at a slice's lower corner."""
    g = grid.Grid(BLOCK, (1, 1, 1), CORE)
    core = [c.alias(f"c{a}") for a, c in zip("xyz", grid.block_at(F.col("x0"), F.col("y0"), F.col("z"), grid.Grid(tuple(b * m for b, m in zip(BLOCK, CORE)), (1, 1, 1))))]
    return sl(spark, d).select("id", *grid.block_at(F.col("x0"), F.col("y0"), F.col("z"), g), *core)


@query(W_GRID + "SELECT id, bx, by, bz FROM links")
def slice_blocks(spark, d):
    """Every block a slice's rectangle meets."""
    return grid.slice_blocks(sl(spark, d), the_grid(spark, d))


@query(W_GRID + "SELECT bx, by, bz FROM blocks WHERE bx BETWEEN 100//64 AND 299//64 AND by BETWEEN 10//16 AND 39//16 AND bz BETWEEN 5//10 AND 24//10")
def blocks_in_box(spark, d):
    """G1, P5: blocks that a box touches, inside the volume."""
    box = spark.range(1).select(*(F.lit(v).cast("long").alias(k) for k, v in dict(min_x=100, max_x=300, min_y=10, max_y=40, min_z=5, max_z=25).items()))
    return grid.blocks_in(box, the_grid(spark, d)).select("bx", "by", "bz")


@query(W_GRID + """SELECT DISTINCT b.bx, b.by, b.bz FROM blocks a JOIN blocks b ON abs(a.bx-b.bx)<=1 AND abs(a.by-b.by)<=1 AND abs(a.bz-b.bz)<=1 WHERE (a.bx*7+a.by*5+a.bz*3)%31=0""")
def expand_blocks(spark, d):
    """Chosen blocks and their neighbours."""
    g = the_grid(spark, d)
    return grid.expand(grid.all_blocks(spark, g).where("(bx*7+by*5+bz*3)%31=0"), (1, 1, 1), g)


@query(W_GRID + """, cores AS (SELECT cx, cy, cz FROM ext, range(0,(ex+1)//2) r(cx), range(0,(ey+1)//2) s(cy), range(0,(ez+1)//2) t(cz))
SELECT cx, cy, cz, bx, by, bz, cx*128 AS min_x, (cx+1)*128 AS max_x, cy*32 AS min_y, (cy+1)*32 AS max_y, cz*20 AS min_z, (cz+1)*20 AS max_z
FROM cores JOIN blocks ON bx BETWEEN cx*2-1 AND cx*2+2 AND by BETWEEN cy*2-1 AND cy*2+2 AND bz BETWEEN cz*2-1 AND cz*2+2""")
def padded_core_blocks(spark, d):
    """A core's blocks with one around them, and the core's box."""
    g = the_grid(spark, d)
    big = grid.Grid(tuple(b * m for b, m in zip(g.block, g.core)), g.volume)
    cores = grid.all_blocks(spark, big).select(*(F.col(f"b{a}").alias(f"c{a}") for a in "xyz"))
    return grid.core_blocks(cores, g, 1).join(grid.core_box(cores, g), ["cx", "cy", "cz"])


@query(W_GRID + ", flags AS (SELECT bx, by, bz, count(*) % 2 = 0 AS flag FROM links GROUP BY 1,2,3) SELECT b.bx, b.by, b.bz FROM blocks b LEFT JOIN flags f ON b.bx=f.bx AND b.by=f.by AND b.bz=f.bz WHERE coalesce(flag,false)=false")
def missing_blocks(spark, d):
    """Q6: requested blocks that aren't flagged."""
    g = the_grid(spark, d)
    flags = grid.slice_blocks(sl(spark, d), g).groupBy("bx", "by", "bz").agg((F.count("*") % 2 == 0).alias("slices_flag"))
    return grid.missing(grid.all_blocks(spark, g), flags, "slices_flag")


@query(W_GRID + ", flags AS (SELECT bx, by, bz, count(*) % 2 = 0 AS flag FROM links GROUP BY 1,2,3) SELECT bx, by, bz, flag FROM flags WHERE bx = 1 AND by = 1")
def block_flags(spark, d):
    """Q8: flags of some blocks."""
    flags = grid.slice_blocks(sl(spark, d), the_grid(spark, d)).where("bx = 1 and by = 1").groupBy("bx", "by", "bz").agg((F.count("*") % 2 == 0).alias("flag"))
    return flags


@query(W_GRID + "SELECT DISTINCT bx, by, bz FROM links")
def block_raster(spark, d):
    """The union of all slices' blocks."""
    return grid.slice_blocks(sl(spark, d), the_grid(spark, d)).select("bx", "by", "bz").distinct()


@query(f"WITH {S} SELECT coalesce(min(x0),0) AS x0, coalesce(min(y0),0) AS y0, coalesce(max(x1),0) AS x1, coalesce(max(y1),0) AS y1, min(greatest(z-1,0)) AS z0, max(z+1) AS z1, min(sx//sz) AS cx0, max(sx//sz) AS cx1, max(l.l_discount) AS brightest FROM slices, (SELECT max(l_discount) AS l_discount FROM lineitem) l")
def volume_extent(spark, d):
    """Bounding boxes and extents."""
    top = adapter.table(spark, d, "lineitem").agg(F.max("l_discount").alias("brightest"))
    mid = F.expr("sx div sz")
    z = F.lit(0).cast("long")
    ext = sl(spark, d).agg(F.coalesce(F.min("x0"), z).alias("x0"), F.coalesce(F.min("y0"), z).alias("y0"), F.coalesce(F.max("x1"), z).alias("x1"), F.coalesce(F.max("y1"), z).alias("y1"), F.min(F.greatest(F.col("z") - 1, z)).alias("z0"), F.max(F.col("z") + 1).alias("z1"), F.min(mid).alias("cx0"), F.max(mid).alias("cx1"))
    return ext.crossJoin(top)  # one row each


# --- spatial joins ---


@query(W_OV + "SELECT a_id, b_id, z, o, a_sz, b_sz FROM ov")
def overlap_pairs(spark, d):
    """Pixels that slices of neighbouring sections share, by bitmap tiles."""
    t = masks.tiles(adapter.runs(spark, d), "sz")
    return masks.overlap_pairs(t)


@query(W_OV + "SELECT a_id, b_id, z, o, a_sz, b_sz FROM ov WHERE o > 150")
def exceeds_overlap(spark, d):
    """More than 150 pixels in common, the bound by sizes first."""
    return spatial.exceeds(pairs(spark, d), 150)


@query(W_OV + """, v AS (SELECT ov.*, CAST(trunc(CAST(a.sx AS DOUBLE)/a.sz-CAST(b.sx AS DOUBLE)/b.sz) AS BIGINT) AS dx, CAST(trunc(CAST(a.sy AS DOUBLE)/a.sz-CAST(b.sy AS DOUBLE)/b.sz) AS BIGINT) AS dy FROM ov JOIN slices a ON a.id=a_id JOIN slices b ON b.id=b_id),
m AS (SELECT a_id, b_id, CAST(sum(greatest(least(p.x1,q.x1+dx)-greatest(p.x0,q.x0+dx),0)) AS BIGINT) AS aligned FROM v JOIN runs p ON p.id=a_id JOIN runs q ON q.id=b_id AND q.y+dy=p.y GROUP BY 1, 2)
SELECT v.a_id, v.b_id, z, o, a_sz, b_sz, coalesce(aligned,0) AS aligned FROM v LEFT JOIN m ON m.a_id=v.a_id AND m.b_id=v.b_id""")
def aligned_overlap(spark, d):
    """Overlap after moving one centre onto the other."""
    return masks.aligned_overlap(pairs(spark, d), sl(spark, d), packed(spark, d))


@query(W_CF + "SELECT a_id, b_id, z, o, a_sz, b_sz FROM cf")
def conflict_pairs(spark, d):
    """Overlapping slices of one section."""
    return masks.conflict_pairs(masks.tiles(adapter.runs(spark, d), "sz"))


@query(W_CF + f"SELECT a_id, b_id, z, o, a_sz, b_sz FROM cf WHERE {LIKE} > 0.75 AND a_sz+b_sz-2*o < 200")
def near_duplicates(spark, d):
    """Nearly the same slices of a section."""
    return masks.near_duplicates(conflicts(spark, d))


@query(W_CF + "SELECT 's'||id AS clique, id FROM slices UNION ALL SELECT a_id||'-'||b_id, unnest([a_id, b_id]) FROM cf")
def conflict_sets(spark, d):
    """The conflict sets of overlapping slices, and one of each slice alone."""
    one = sl(spark, d).select(F.concat(F.lit("s"), F.col("id")).alias("clique"), "id")
    return one.unionByName(cliques(spark, d).select("clique", "id"))


@query(W_CF + "SELECT id FROM slices WHERE id NOT IN (SELECT a_id FROM cf UNION SELECT b_id FROM cf)")
def singleton_conflicts(spark, d):
    """Slices that are in no conflict."""
    c = conflicts(spark, d)
    return sl(spark, d).select("id").join(c.select(F.explode(F.array("a_id", "b_id")).alias("id")), "id", "left_anti")


@query(W_CF + "SELECT count(*) AS sets, CAST(0 AS BIGINT) AS only_first, CAST(0 AS BIGINT) AS only_second FROM cf")
def equal_conflict_sets(spark, d):
    """The conflict sets under other names and in another order are the same sets."""
    first = cliques(spark, d).select("clique", "id")
    names = first.select("clique").distinct().withColumn("number", F.xxhash64("clique"))
    second = first.join(names, "clique").select(F.col("number").alias("clique"), "id")
    p, q = (store.set_keys(x).select("ids") for x in (first, second))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(p, "sets").crossJoin(n(p.exceptAll(q), "only_first")).crossJoin(n(q.exceptAll(p), "only_second"))  # one row each


@query(W_GRID + f""", {CF}, stored AS (SELECT DISTINCT a_id, b_id FROM cf JOIN links l ON l.id = a_id WHERE bx <= 2 AND by <= 1)
SELECT 'z'||s.z AS clique, string_agg(DISTINCT CAST(m.id AS VARCHAR), '-' ORDER BY CAST(m.id AS VARCHAR)) AS ids FROM (SELECT a_id, unnest([a_id, b_id]) AS id FROM stored) m JOIN slices s ON s.id = m.a_id GROUP BY s.z""")
def conflict_sets_of_blocks(spark, d):
    """Q4, F10, A11, J12, SNK2: members of conflict sets as far as the requested blocks' pairs go."""
    s, c = sl(spark, d), conflicts(spark, d)
    links = grid.slice_blocks(s, the_grid(spark, d))
    p = c.select(F.concat(F.lit("z"), F.col("z")).alias("clique"), F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    of = p.join(links.withColumnRenamed("id", "a"), "a").select("bx", "by", "bz", "a", "b")
    blocks = of.where("bx <= 2 and by <= 1").select("bx", "by", "bz").distinct()
    got = store.cliques_by_blocks(p, of, blocks)
    return got.select("clique", F.array_join(F.array_sort(F.transform("ids", lambda x: x.cast("string"))), "-").alias("ids"))


@query(W_CF + "SELECT a_id AS a, b_id AS b, 'z'||z AS clique FROM cf")
def clique_pairs(spark, d):
    """SNK2: pairs of each clique of two, as the store keeps them."""
    c = conflicts(spark, d)
    two = c.select(F.concat_ws("-", "a_id", "b_id").alias("clique"), F.explode(F.array("a_id", "b_id")).alias("id"))
    return store.clique_pairs(two).join(c.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "z"), ["a", "b"]).select("a", "b", F.concat(F.lit("z"), F.col("z")).alias("clique"))


@query(f"WITH {S}, p AS (SELECT id, z, CAST(sx AS DOUBLE)/sz AS cx, CAST(sy AS DOUBLE)/sz AS cy FROM slices) SELECT a.id AS a_id, b.id AS b_id, a.z AS z, round((a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy),6) AS d2 FROM p a JOIN p b ON a.z=b.z AND a.id<b.id WHERE (a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy) < 100")
def radius_join(spark, d):
    """Slices of a section whose squared centre distance is under the radius."""
    s = sl(spark, d).select("id", "z", masks.center("x").alias("cx"), masks.center("y").alias("cy"))
    return spatial.radius_join(s, 100.0).withColumn("d2", F.round("d2", 6))


@query(W_SEG + """, c AS (SELECT m.key, sg.type, sg.isi, CAST(sum(sx) AS DOUBLE)/sum(sz) AS cx, CAST(sum(sy) AS DOUBLE)/sum(sz) AS cy FROM mem m JOIN seg sg ON sg.key=m.key JOIN slices s ON s.id=m.id WHERE sg.type > 0 GROUP BY 1,2,3)
SELECT a.key AS a_id, b.key AS b_id, a.isi, a.type FROM c a JOIN c b ON a.isi=b.isi AND a.type=b.type AND a.key<b.key WHERE (a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy) < 25""")
def radius_join_typed(spark, d):
    """Segments of one interval and type with near centres."""
    c = SG.centers(segs(spark, d).where("type > 0"), sl(spark, d)).withColumnRenamed("key", "id")
    return spatial.radius_join(c, 25.0, ("isi", "type")).select("a_id", "b_id", "isi", "type")


_LL = f"{S}, edges AS (SELECT a.id%50 AS label, a.id AS a, b.id AS b, CAST(sum(least(a.x1,b.x1)-greatest(a.x0,b.x0)) AS BIGINT) AS o FROM runs a JOIN runs b ON b.z=a.z+1 AND a.id%50=b.id%50 AND a.y=b.y AND a.x0<b.x1 AND b.x0<a.x1 GROUP BY 1, 2, 3)"


def labelled(spark, d):
    return runs(spark, d).withColumn("label", F.col("id") % 50)


@query(f"WITH {_LL} SELECT label, a, b, o FROM edges")
def same_label_adjacent(spark, d):
    """Overlapping slices of one label in neighbouring sections."""
    return labels.label_links(labelled(spark, d))


# --- segments ---


@query(W_OV + f"SELECT a_id, b_id, z, o, round({LIKE}, 9) AS likeness FROM ov WHERE {LIKE} >= 0.5")
def continuations(spark, d):
    """Accepted continuations."""
    return SG.continuations(pairs(spark, d)).select("a_id", "b_id", "z", "o", F.round("like", 9).alias("likeness"))


for _to, _sql in (("right", BR), ("left", BL)):

    def _branches(spark, d, to=_to):
        """Branches whose targets don't exclude each other."""
        b = SG.branches(pairs(spark, d), conflicts(spark, d), to)
        return b.select("source", "t1", "t2", "z", "o", F.round("like", 9).alias("likeness"), F.round(F.least("sz1", "sz2") / F.greatest("sz1", "sz2"), 9).alias("ratio"))

    _name = "br" if _to == "right" else "bl"
    QUERIES[f"branches_{_to}"] = _branches
    ORACLE[f"branches_{_to}"] = f"WITH {S}, {OV}, {CF}, {_sql} SELECT source, t1, t2, z, o, round(CAST(o AS DOUBLE)/CAST(greatest(s_sz+sz1+sz2-o,1) AS DOUBLE),9) AS likeness, round(CAST(least(sz1,sz2) AS DOUBLE)/CAST(greatest(sz1,sz2) AS DOUBLE),9) AS ratio FROM {_name}"


@query(f"WITH {S} SELECT 'E:'||id||':R' AS key, z+1 AS isi FROM slices UNION ALL SELECT 'E:'||id||':L', z FROM slices")
def end_segments(spark, d):
    """Both ends of every slice."""
    return SG.end_segments(sl(spark, d)).select("key", "isi")


@query(W_SEG + "SELECT key, type, isi FROM seg")
def all_segments(spark, d):
    """Every hypothesis."""
    return segs(spark, d).select("key", "type", "isi")


@query(W_SEG + "SELECT type, CASE type WHEN 0 THEN 'end' WHEN 1 THEN 'continuation' ELSE 'branch' END AS name, CAST(count(*) AS BIGINT) AS n, min(greatest(isi-1,0)) AS first_section, max(isi) AS last_section FROM seg GROUP BY 1, 2")
def segment_types(spark, d):
    """Types by their sides' sizes, counted."""
    s = segs(spark, d).withColumn("type", segment_type("sl", "sr"))
    return s.groupBy("type").agg(F.count("*").alias("n"), F.min(F.greatest(F.col("isi") - 1, F.lit(0).cast("long"))).alias("first_section"), F.max("isi").alias("last_section")).withColumn("name", type_name("type"))


@query(W_SEG + "SELECT key, string_agg(CAST(id AS VARCHAR), '-' ORDER BY id) AS ids, CAST(sum(CASE WHEN is_left THEN 1 ELSE 0 END) AS BIGINT) AS n_left FROM mem GROUP BY key")
def segment_slice_arrays(spark, d):
    """A segment's slices as one sorted key."""
    return segs(spark, d).select("key", key_of(F.concat("sl", "sr")).alias("ids"), F.size("sl").cast("long").alias("n_left"))


@query(f"WITH {S} SELECT id, z + CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END AS isi FROM slices")
def segment_isi(spark, d):
    """Interval of a source slice by where it looks."""
    return sl(spark, d).select("id", isi("z", F.col("id") % 2 == 0).alias("isi"))


@query(W_SEG + "SELECT m.key, round(CAST(sum(sx) AS DOUBLE)/sum(sz),6) AS cx, round(CAST(sum(sy) AS DOUBLE)/sum(sz),6) AS cy FROM mem m JOIN slices s ON s.id=m.id GROUP BY m.key")
def segment_centers(spark, d):
    """P20: size-weighted centres."""
    return SG.centers(segs(spark, d), sl(spark, d)).select("key", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query(W_OV + f""", r AS (SELECT *, {LIKE} AS li, row_number() OVER (PARTITION BY a_id ORDER BY {LIKE} >= 0.5 DESC, o DESC, b_id DESC) AS a_rank, row_number() OVER (PARTITION BY b_id ORDER BY {LIKE} >= 0.5 DESC, o DESC, a_id DESC) AS b_rank FROM ov)
SELECT a_id, b_id, a_rank, b_rank FROM r WHERE li >= 0.5 OR a_rank <= 2 OR b_rank <= 2""")
def min_partners(spark, d):
    """At least two partners for each slice."""
    return SG.min_partners(pairs(spark, d), 2).select("a_id", "b_id", F.col("a_rank").cast("long").alias("a_rank"), F.col("b_rank").cast("long").alias("b_rank"))


STORED = "stored AS (SELECT key, type, isi, CASE WHEN isi % 3 = 0 THEN NULL ELSE CAST(isi AS DOUBLE) END AS cost FROM seg)"


def _stored(s, *more):
    return s.select("key", "type", "isi", *more, F.when(F.col("isi") % 3 != 0, F.col("isi").cast("double")).alias("cost"))


for _costs in (True, False):

    def _by_blocks(spark, d, read=_costs):
        """Q3, SRC12: segments of the requested blocks with their slices, and features where they are needed."""
        s = kept_segs(spark, d)
        links = grid.slice_blocks(sl(spark, d), the_grid(spark, d))
        blocks = links.where("bx <= 1 and bz <= 3").select("bx", "by", "bz").distinct()
        feats = s.where("isi % 3 = 0 or isi % 2 = 0").select("key", (F.col("isi") * 2).alias("feature"))
        got = store.segments_by_blocks(_stored(s, "sl", "sr"), links, blocks, feats, read)
        return got.select("key", "cost", F.array_join(F.transform("slices", lambda x: F.concat(x["id"].cast("string"), F.when(x["is_left"], "L").otherwise("R"))), "-").alias("slices"), "feature")

    QUERIES[f"segments_by_blocks_{'costs' if _costs else 'features'}"] = _by_blocks
    ORACLE[f"segments_by_blocks_{'costs' if _costs else 'features'}"] = (
        W_SEG + f", {VOL}, {EXT}, {BLOCKS}, {LINKS}, {STORED}, near AS (SELECT DISTINCT m.key FROM links l JOIN mem m ON m.id=l.id WHERE bx<=1 AND bz<=3), f AS (SELECT key, isi*2 AS feature FROM seg WHERE isi%3=0 OR isi%2=0)"
        " SELECT s.key, s.cost, (SELECT string_agg(CAST(id AS VARCHAR)||CASE WHEN is_left THEN 'L' ELSE 'R' END, '-' ORDER BY id, is_left) FROM mem WHERE mem.key=s.key) AS slices, f.feature FROM stored s SEMI JOIN near n ON n.key=s.key "
        + ("LEFT JOIN f ON f.key=s.key AND s.cost IS NULL" if _costs else "JOIN f ON f.key=s.key")
    )


@query(W_GRID + "SELECT id, z, sz FROM slices WHERE id IN (SELECT id FROM links WHERE bx=1 AND by<=2)")
def slices_by_blocks(spark, d):
    """Q1, SRC11, J13, A12: each slice once that a requested block has."""
    links = grid.slice_blocks(sl(spark, d), the_grid(spark, d))
    blocks = links.where("bx = 1 and by <= 2").select("bx", "by", "bz").distinct()
    return store.slices_by_blocks(sl(spark, d), links, blocks).select("id", "z", "sz")


@query(W_SEG + "SELECT id, z, sz FROM slices WHERE id IN (SELECT m.id FROM mem m JOIN seg g ON g.key=m.key WHERE g.type=2)")
def slices_by_segments(spark, d):
    """Q2: slices of the segments named."""
    s = kept_segs(spark, d)
    return store.slices_by_segments(sl(spark, d), SG.members(s), s.where("type = 2")).select("id", "z", "sz")


@query(W_SEG + "SELECT DISTINCT g.key, g.isi FROM seg g JOIN mem m ON m.key=g.key JOIN slices s ON s.id=m.id WHERE g.isi BETWEEN 10 AND 30 AND x0<128 AND x1>0 AND y0<32 AND y1>16")
def cull_to_core(spark, d):
    """Segments whose interval is in the core, both ends included, with a slice that meets it."""
    return SG.in_box(kept_segs(spark, d), sl(spark, d), (0, 16, 10, 128, 32, 30)).select("key", "isi")


@query(W_CF + "SELECT s.id, CAST(count(cf.b_id) AS BIGINT) AS n FROM slices s LEFT JOIN cf ON cf.a_id=s.id WHERE s.z=12 GROUP BY s.id")
def slices_of_section(spark, d):
    """one section's slices with their conflicts; the section is a pushed-down filter."""
    s = sl(spark, d).where("z = 12")
    c = masks.conflict_pairs(masks.tiles(runs(spark, d).where("z = 12"), "sz"))
    return s.select("id").join(c.select(F.col("a_id").alias("id"), "b_id"), "id", "left").groupBy("id").agg(F.count("b_id").alias("n"))


@query(W_CF + f", {CLIQUES}, near AS (SELECT id FROM slices WHERE x0<100 AND x1>50 AND y0<20 AND y1>10) SELECT id FROM near UNION SELECT id FROM cliques WHERE clique IN (SELECT clique FROM cliques JOIN near USING (id))")
def required_slices(spark, d):
    """slices that meet a rectangle and all they share a clique with."""
    return SG.required_slices(sl(spark, d), cliques(spark, d), 50, 10, 100, 20)


@query(f"WITH {S} SELECT id, CAST(x0<=64 AS INTEGER) AS lo_x, CAST(x1>=128 AS INTEGER) AS hi_x, CAST(y0<=16 AS INTEGER) AS lo_y, CAST(y1>=32 AS INTEGER) AS hi_y FROM slices WHERE x0<128 AND x1>64 AND y0<32 AND y1>16 AND (x0<=64 OR x1>=128 OR y0<=16 OR y1>=32)")
def touches_boundary(spark, d):
    """slices in a box that touch its sides."""
    t = {"lo_x": F.col("x0") <= 64, "hi_x": F.col("x1") >= 128, "lo_y": F.col("y0") <= 16, "hi_y": F.col("y1") >= 32}
    inside = sl(spark, d).where("x0 < 128 and x1 > 64 and y0 < 32 and y1 > 16")
    return inside.where(t["lo_x"] | t["hi_x"] | t["lo_y"] | t["hi_y"]).select("id", *(c.cast("int").alias(k) for k, c in t.items()))


# --- features ---

REL = f"""rel AS (SELECT 'C:'||a_id||':'||b_id AS key, 1 AS type, a_id AS s, b_id AS t1, CAST(NULL AS BIGINT) AS t2, o FROM ov WHERE {LIKE} >= 0.5
  UNION ALL SELECT 'B:'||source||':'||t2||':'||t1||':R', 2, source, t1, t2, o FROM br UNION ALL SELECT 'B:'||source||':'||t2||':'||t1||':L', 2, source, t1, t2, o FROM bl),
geo AS (SELECT *, CAST(trunc(ex) AS BIGINT) AS dx, CAST(trunc(ey) AS BIGINT) AS dy FROM (SELECT rel.*, p.sz AS ss, q.sz+coalesce(r.sz,0) AS ts,
  CAST(p.sx AS DOUBLE)/p.sz-CAST(q.sx+coalesce(r.sx,0) AS DOUBLE)/(q.sz+coalesce(r.sz,0)) AS ex, CAST(p.sy AS DOUBLE)/p.sz-CAST(q.sy+coalesce(r.sy,0) AS DOUBLE)/(q.sz+coalesce(r.sz,0)) AS ey
  FROM rel JOIN slices p ON p.id=s JOIN slices q ON q.id=t1 LEFT JOIN slices r ON r.id=t2)),
tg AS (SELECT key, s, t1 AS t, dx, dy FROM geo UNION ALL SELECT key, s, t2, dx, dy FROM geo WHERE t2 IS NOT NULL),
mo AS (SELECT key, CAST(sum(greatest(least(p.x1,q.x1+dx)-greatest(p.x0,q.x0+dx),0)) AS BIGINT) AS m FROM tg JOIN runs p ON p.id=s JOIN runs q ON q.id=t AND q.y+dy=p.y GROUP BY 1),
gm AS (SELECT geo.*, ss+ts AS t, coalesce(m,0) AS al FROM geo LEFT JOIN mo ON mo.key=geo.key),
gf AS (SELECT key, type, s, t1, t2, dx, dy, ex*ex+ey*ey AS f1, CAST(t-2*o AS DOUBLE) AS f2, CAST(t-2*o AS DOUBLE)/t AS f3, CAST(t-2*al AS DOUBLE) AS f4, CAST(t-2*al AS DOUBLE)/t AS f5, CAST(t AS DOUBLE)/(type+1) AS f6,
  CAST(abs(ss-ts) AS DOUBLE) AS f7, CAST(o AS DOUBLE) AS f8, CAST(o AS DOUBLE)/greatest(t-o,1) AS f9, CAST(al AS DOUBLE) AS f10, CAST(al AS DOUBLE)/greatest(t-CASE WHEN type=1 THEN o ELSE al END,1) AS f11 FROM gm)"""
#: the distance of every pixel of one side to the runs of the other, unmoved (m = 0) and moved (m = 1)
#: each pixel of one side against the other side's runs, held as a list a slice, so that no row is made for a pixel and a run
FAR = """mv AS MATERIALIZED (SELECT key, 0 AS m, CAST(0 AS BIGINT) AS ax, CAST(0 AS BIGINT) AS ay FROM geo UNION ALL SELECT key, 1, -dx, -dy FROM geo),
rl AS MATERIALIZED (SELECT id, list({'y': y, 'a': x0, 'b': x1-1}) AS l FROM runs WHERE id IN (SELECT s FROM tg UNION SELECT t FROM tg) GROUP BY id),
pix AS MATERIALIZED (SELECT id, y, unnest(range(x0,x1)) AS x FROM runs WHERE id IN (SELECT s FROM tg UNION SELECT t FROM tg)),
thp AS MATERIALIZED (SELECT mv.key, m, ax, ay, tg.t AS id, rl.l FROM mv JOIN tg ON tg.key=mv.key JOIN rl ON rl.id=tg.s),
th AS (SELECT key, m, avg(d) AS d, max(d) AS top FROM (SELECT key, m, least(50.0, sqrt(list_min([greatest(r.a-x-ax, x+ax-r.b, 0)*greatest(r.a-x-ax, x+ax-r.b, 0)+(r.y-y-ay)*(r.y-y-ay) FOR r IN l]))) AS d FROM thp JOIN pix p ON p.id=thp.id) q GROUP BY 1, 2),
tl AS (SELECT tg.key, any_value(tg.s) AS s, flatten(list(rl.l)) AS l FROM tg JOIN rl ON rl.id=tg.t GROUP BY 1),
tlp AS MATERIALIZED (SELECT mv.key, m, ax, ay, s, l FROM mv JOIN tl ON tl.key=mv.key),
bk AS (SELECT key, m, avg(d) AS d, max(d) AS top FROM (SELECT key, m, least(50.0, sqrt(list_min([greatest(r.a+ax-x, x-r.b-ax, 0)*greatest(r.a+ax-x, x-r.b-ax, 0)+(r.y+ay-y)*(r.y+ay-y) FOR r IN l]))) AS d FROM tlp JOIN pix p ON p.id=tlp.s) q GROUP BY 1, 2),
fa AS (SELECT a.key, a.m, (a.d+b.d)/2 AS mean, greatest(a.top,b.top) AS top FROM th a JOIN bk b ON a.key=b.key AND a.m=b.m),
fd AS (SELECT p.key, p.mean AS f12, p.top AS f13, q.mean AS f14, q.top AS f15 FROM fa p JOIN fa q ON q.key=p.key AND p.m=0 AND q.m=1)"""
W_REL = f"WITH {S}, {OV}, {CF}, {BR}, {BL}, {REL} "


def _geometry(spark, d):
    return features.geometry(features.relations(segs(spark, d)), sl(spark, d), packed(spark, d), pairs(spark, d))


def _rounded(df, names):
    return [F.round(n, 9).alias(n) for n in names]


_GEO = ", ".join(f"round(f{k},9) AS f{k}" for k in range(1, 12))


@query(W_REL + f"SELECT key, s, t1, {_GEO} FROM gf WHERE type=1")
def geometry_features(spark, d):
    """F1-11: of continuations."""
    f = _geometry(spark, d).where("type = 1")
    return f.select("key", "s", "t1", *_rounded(f, [f"f{k}" for k in range(1, 12)]))


@query(W_REL + f"SELECT key, s, t1, t2, {_GEO} FROM gf WHERE type=2")
def branch_features(spark, d):
    """F1-11: of branches; the aligned ratio's divisor is its own, unlike a continuation's."""
    f = _geometry(spark, d).where("type = 2")
    return f.select("key", "s", "t1", "t2", *_rounded(f, [f"f{k}" for k in range(1, 12)]))


@query(W_REL + f", {FAR} SELECT key, round(f12,9) AS f12, round(f13,9) AS f13, round(f14,9) AS f14, round(f15,9) AS f15 FROM fd")
def slice_distance(spark, d):
    """P14, P15, P16, P17, F12-15: distances of the masks of continuations and, of two targets to one, of branches."""
    f = _geometry(spark, d)
    got = masks.distances(f.select("key", "s", "t1", "t2", (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy")), packed(spark, d))
    return got.select("key", *_rounded(got, ["f12", "f13", "f14", "f15"]))


HIST = "hist AS (SELECT l_orderkey AS id, " + ", ".join(f"CAST(sum(CASE WHEN least(9, CAST(floor(l_discount*10*10) AS INTEGER))={k} THEN 1 ELSE 0 END) AS BIGINT) AS h{k}" for k in range(10)) + " FROM lineitem GROUP BY 1)"


@query(f"WITH {HIST} SELECT id, " + ", ".join(f"h{k}" for k in range(10)) + ", " + ", ".join(f"round(CAST(h{k} AS DOUBLE)/greatest({'+'.join(f'h{j}' for j in range(10))},1),9) AS n{k}" for k in range(10)) + " FROM hist")
def histogram_features(spark, d):
    """A4, A5: histograms of slices' values, counts and shares."""
    h = features.histograms(adapter.values(spark, d)).withColumn("n", normalised(F.col("h")))
    return h.select("id", *(F.col("h")[k].alias(f"h{k}") for k in range(10)), *(F.round(F.col("n")[k], 9).alias(f"n{k}") for k in range(10)))


_H0 = ", ".join(f"coalesce(h{k},0) AS h{k}" for k in range(10))
HD = f"""hs AS (SELECT slices.id, {_H0} FROM slices LEFT JOIN hist ON hist.id=slices.id),
hd AS (SELECT key, type, """ + ", ".join(f"p.h{k} AS a{k}, q.h{k}+coalesce(r.h{k},0) AS b{k}" for k in range(10)) + """ FROM rel JOIN hs p ON p.id=s JOIN hs q ON q.id=t1 LEFT JOIN hs r ON r.id=t2)"""
_SA, _SB = (f"greatest({'+'.join(f'{c}{k}' for k in range(10))},1)" for c in "ab")
_DN = [f"abs(CAST(a{k} AS DOUBLE)/{_SA}-CAST(b{k} AS DOUBLE)/{_SB})" for k in range(10)]


@query(W_REL + f", {HIST}, {HD} SELECT key, " + ", ".join(f"abs(a{k}-b{k}) AS d{k}, round({_DN[k]},9) AS n{k}" for k in range(10)) + " FROM hd")
def histogram_differences(spark, d):
    """A5, F36-55: bin differences of continuations and branches (targets summed), of counts and of shares."""
    f = features.histogram_differences(features.relations(segs(spark, d)), features.histograms(adapter.values(spark, d)))
    return f.select("key", *(F.col("d")[k].alias(f"d{k}") for k in range(10)), *(F.round(F.col("dn")[k], 9).alias(f"n{k}") for k in range(10)))


_ZERO = lambda a, b: [(f"f{k}", "0.0") for k in range(a, b)]
_SUM = f"greatest({'+'.join(f'h{k}' for k in range(10))},1)"
_ENDS = [("f0", "sz"), *_ZERO(1, 16), *((f"f{16 + k}", f"h{k}") for k in range(10)), *((f"f{26 + k}", f"CAST(h{k} AS DOUBLE)/{_SUM}") for k in range(10)), *_ZERO(36, 56), ("f56", "1"), ("f57", "0"), ("f58", "0")]
_REST = [("f0", "0.0"), *((f"f{k}", f"gf.f{k}") for k in range(1, 12)), *((f"f{k}", f"fd.f{k}") for k in range(12, 16)), *_ZERO(16, 36), *((f"f{36 + k}", f"abs(a{k}-b{k})") for k in range(10)), *((f"f{46 + k}", _DN[k]) for k in range(10)), ("f56", "0"), ("f57", "CASE WHEN gf.type=1 THEN 1 ELSE 0 END"), ("f58", "CASE WHEN gf.type=2 THEN 1 ELSE 0 END")]
_COLS = lambda v: ", ".join(f"round(CAST({e} AS DOUBLE),9) AS {n}" for n, e in v)


@query(W_REL + f", {HIST}, {HD}, {FAR} SELECT 'E:'||slices.id||side AS key, {_COLS(_ENDS)} FROM slices JOIN hs ON hs.id=slices.id, (VALUES (':R'), (':L')) v(side) UNION ALL SELECT gf.key, {_COLS(_REST)} FROM gf JOIN fd ON fd.key=gf.key JOIN hd ON hd.key=gf.key")
def segment_features(spark, d):
    """FV, F0, F1-11, F12-15, F16-35, F36-55, F56-58: the 59 columns of every segment."""
    v = features.vector(segs(spark, d), sl(spark, d), packed(spark, d), pairs(spark, d), features.histograms(adapter.values(spark, d)))
    return v.select("key", *(F.round(F.col("features")[k], 9).alias(f"f{k}") for k in range(59)))


@query(W_SEG + "SELECT key, CAST(type=0 AS INTEGER) AS is_end, CAST(type=1 AS INTEGER) AS is_continuation, CAST(type=2 AS INTEGER) AS is_branch FROM seg")
def type_onehot(spark, d):
    """Features 56 to 58."""
    return segs(spark, d).select("key", *one_hot("type"))


# --- costs ---

WEIGHTS = [((k * 37) % 11 - 5) / 8.0 for k in range(64)]


@query("SELECT vec_id, round(list_sum([CAST(x AS DOUBLE)*(((k-1)*37)%11-5)/8.0 FOR x, k IN embedding]), 6) AS cost FROM embeddings")
def linear_cost(spark, d):
    """Dot product with the weights of configuration 7, which are looked up and must be there."""
    table = spark.range(10).select(F.col("id").alias("configuration_id"), F.array(*(F.lit(w) + F.when(F.col("id") == 7, 0.0).otherwise(1.0) for w in WEIGHTS)).alias("weights"))
    v = adapter.vectors(spark, d).withColumnRenamed("vec_id", "key")
    return costs.linear(v, stacks.weights_of(table, 7, 64)).select(F.col("key").alias("vec_id"), F.round("cost", 6).alias("cost"))


@query(W_OV + f"SELECT 'C:'||a_id||':'||b_id AS key, CAST(-o AS DOUBLE) AS cost FROM ov WHERE {LIKE} >= 0.5")
def overlap_only_cost(spark, d):
    """The cost without a forest, less the overlap."""
    f = _geometry(spark, d).where("type = 1").select("key", F.array(F.col("f1"), F.col("f8")).alias("features"))
    return costs.overlap_only(f, ("center distance", "overlap"))


@query(W_SEG + ", l AS (SELECT max(isi) AS last FROM seg WHERE type=0) SELECT key, CASE WHEN type=0 AND (isi=0 OR isi=last) THEN 0.0::DOUBLE WHEN type=0 THEN 3.5::DOUBLE WHEN type=1 THEN 1.25::DOUBLE ELSE 2.0::DOUBLE END AS cost FROM seg, l")
def prior_cost(spark, d):
    """Constants by type, outer ends free."""
    return costs.prior(segs(spark, d), 3.5, 1.25, 2.0)


@query(W_SEG + ", l AS (SELECT max(isi) AS last FROM seg WHERE type=0) SELECT key, CASE WHEN type=0 AND (isi=0 OR isi=last) THEN 0.0::DOUBLE ELSE CASE type WHEN 0 THEN 3.5 WHEN 1 THEN 1.25 ELSE 2.0 END + CAST(isi AS DOUBLE)/4 END AS cost FROM seg, l")
def combined_cost(spark, d):
    """A10: the sum of several cost functions, outer ends free."""
    s = kept_segs(spark, d)
    return costs.total(s, lambda x: costs.prior(x, 3.5, 1.25, 2.0), lambda x: x.select("key", (F.col("isi") / 4.0).alias("cost")))


_PM = "(m*0.5)/((m*0.5)+((1-m)*0.5))"
@query(f"WITH v AS (SELECT l_orderkey AS id, l_discount*10 AS m FROM lineitem), p AS (SELECT id, {_PM} AS pm, ((1-m)*0.5) AS f FROM v) SELECT id, round(sum(ln(greatest(0.0001,least(0.9999,pm)))-ln(greatest(0.0001,least(0.9999,f/(f+pm))))),6) AS cost FROM p GROUP BY id")
def posterior_cost(spark, d):
    """Cost of a slice's pixels as foreground."""
    return costs.slice_posterior(adapter.values(spark, d)).select("id", F.round("cost", 6).alias("cost"))


@query(f"WITH {S}, pix AS (SELECT id, y, unnest(range(x0,x1)) AS x FROM runs) SELECT p.id, CAST(4*count(*)-2*count(q.x)-2*count(r.x) AS BIGINT) AS length FROM pix p LEFT JOIN pix q ON q.id=p.id AND q.y=p.y AND q.x=p.x+1 LEFT JOIN pix r ON r.id=p.id AND r.y=p.y+1 AND r.x=p.x GROUP BY p.id")
def boundary_length(spark, d):
    """Boundary faces, from runs of pixels."""
    return costs.boundary_length(packed(spark, d))


@query(W_SEG + f", v AS (SELECT l_orderkey AS id, l_discount*10 AS m FROM lineitem), p AS (SELECT id, {_PM} AS pm, ((1-m)*0.5) AS f FROM v), c AS (SELECT id, sum(ln(greatest(0.0001,least(0.9999,pm)))-ln(greatest(0.0001,least(0.9999,f/(f+pm))))) AS cost FROM p GROUP BY id), tt AS (SELECT a.id, sum(least(a.x1,b.x1)-greatest(a.x0,b.x0)) AS t FROM runs a JOIN runs b ON b.id=a.id AND b.y=a.y+1 AND a.x0<b.x1 AND b.x0<a.x1 GROUP BY 1), le AS (SELECT r.id, 2*sum(r.x1-r.x0)+2*count(*)-2*coalesce(any_value(t),0) AS length FROM runs r LEFT JOIN tt ON tt.id=r.id GROUP BY 1) SELECT m.key, round(sum(0.5*(c.cost+2.0*le.length)),5) AS cost FROM mem m JOIN le ON le.id=m.id JOIN c ON c.id=m.id GROUP BY m.key")
def segmentation_cost(spark, d):
    """Weighted pixel and boundary costs of segments."""
    length = costs.boundary_length(packed(spark, d))
    return costs.segmentation(segs(spark, d), costs.slice_posterior(adapter.values(spark, d)), length, 0.5, 2.0).select("key", F.round("cost", 5).alias("cost"))


@query("SELECT vec_id, label, CASE WHEN label%3<>0 AND -ln(greatest(1e-10, p)) >= -ln(0.05) THEN -1.0::DOUBLE ELSE round(-ln(greatest(1e-10,p)),9)+0.0::DOUBLE END AS cost FROM (SELECT vec_id, label, (vec_id*37%101)/100.0::DOUBLE AS p FROM embeddings)")
def neglog_cost(spark, d):
    """Negative log probabilities; infinity (here -1) under the least probability, ends exempt."""
    v = adapter.vectors(spark, d).withColumn("p", (F.col("vec_id") * 37 % 101) / 100.0)
    c = neglog("p", F.col("label") % 3)
    return v.select("vec_id", "label", F.when(c == float("inf"), -1.0).otherwise(F.round(c, 9) + 0.0).alias("cost"))


@query(W_SEG + f", {STORED} SELECT key, CASE WHEN type=1 THEN CAST(isi*10 AS DOUBLE) ELSE cost END AS cost FROM stored")
def cost_writeback(spark, d):
    """SNK5, Q15: new costs into stored rows."""
    s = kept_segs(spark, d)
    return costs.write_back(_stored(s), s.where("type = 1").select("key", (F.col("isi") * 10).cast("double").alias("cost"))).select("key", "cost")


@query(W_SEG + f", {STORED} SELECT key, coalesce(cost, CAST(isi*0.5+type*2 AS DOUBLE)) AS cost, cost IS NULL AS is_new FROM stored")
def read_costs_coalesce(spark, d):
    """M5: stored costs, or the dot product where there is none."""
    s = kept_segs(spark, d)
    return costs.read_or_compute(_stored(s), s.select("key", F.array(F.col("isi").cast("double"), F.col("type").cast("double")).alias("features")), [0.5, 2.0])


# --- the programme ---


@query(W_SEG + "SELECT key, row_number() OVER (ORDER BY type, isi, key)-1 AS number FROM seg")
def variable_numbering(spark, d):
    """Dense numbers in a fixed order."""
    return C.variables(segs(spark, d))


USED = "used AS (SELECT id, key FROM mem WHERE is_left UNION ALL SELECT id, key FROM mem WHERE NOT is_left AND id NOT IN (SELECT id FROM mem WHERE is_left))"


@query(W_SEG + f", {CLIQUES}, {USED} SELECT DISTINCT 'clique:'||clique AS row, key, 1 AS coef, '<=' AS relation, 1 AS value FROM cliques JOIN used USING (id)")
def conflict_constraints(spark, d):
    """At most one segment over a clique's slices."""
    return C.conflict_rows(cliques(spark, d), kept_segs(spark, d))


@query(W_SEG + f", {CLIQUES}, {USED} SELECT 'slice:'||s.id AS row, key, 1 AS coef, '=' AS relation, 1 AS value FROM slices s JOIN used USING (id) WHERE s.id NOT IN (SELECT id FROM cliques)")
def exclusivity_constraints(spark, d):
    """M2: slices in no clique, explained exactly once."""
    return C.exclusivity_rows(sl(spark, d), cliques(spark, d), kept_segs(spark, d), True)


@query(W_SEG + "SELECT 'flow:'||id AS row, key, CASE WHEN is_left THEN 1 ELSE -1 END AS coef, '=' AS relation, 0 AS value FROM mem")
def continuation_constraints(spark, d):
    """M3: as many segments leave a slice as reach it (every slice has both kinds here)."""
    return C.continuation_rows(kept_segs(spark, d))


@query(W_SEG + f", {VOL}, {EXT}, {BLOCKS}, {LINKS} SELECT 'flow:'||id AS row, string_agg(key||'*'||(CASE WHEN is_left THEN 1 ELSE -1 END), ' ' ORDER BY key) AS terms FROM mem WHERE id IN (SELECT id FROM links WHERE bx<=1 AND bz<=2) GROUP BY id")
def constraints_by_blocks(spark, d):
    """Q5: rows of the requested blocks with their distinct terms as one array."""
    near = grid.slice_blocks(sl(spark, d), the_grid(spark, d)).where("bx <= 1 and bz <= 2").select(F.concat(F.lit("flow:"), F.col("id")).alias("row")).distinct()
    rows = C.continuation_rows(kept_segs(spark, d)).join(near, "row", "left_semi")
    terms = F.array_sort(F.collect_set(F.struct("key", "coef")))
    return rows.groupBy("row").agg(terms.alias("t")).select("row", F.array_join(F.transform("t", lambda x: F.concat(x["key"], F.lit("*"), x["coef"].cast("string"))), " ").alias("terms"))


@query(W_SEG + "SELECT 'explain:'||id AS row, key, CASE WHEN is_left THEN -1 ELSE 1 END AS coef, '=' AS relation, 0 AS value FROM mem")
def explanation_constraints(spark, d):
    """M7: the same with the right side positive, boundary slices included."""
    return C.explanation_rows(segs(spark, d))


@query(W_SEG + "SELECT 'user:'||z AS row, 'E:'||id||':R' AS key, 1 AS coef, '=' AS relation, 1 AS value FROM slices")
def explicit_constraints(spark, d):
    """M4: a user's rows; those about unknown segments are told apart."""
    u = sl(spark, d).select(F.concat(F.lit("user:"), F.col("z")).alias("row"), F.explode(F.array(F.concat(F.lit("E:"), F.col("id"), F.lit(":R")), F.concat(F.lit("X:"), F.col("id")))).alias("key"), F.lit(1).alias("coef"), F.lit("=").alias("relation"), F.lit(1).alias("value"))
    return C.explicit_rows(u, segs(spark, d))


CONT = "cont AS (SELECT 'C:'||a_id||':'||b_id AS key, v.z+1 AS isi, a_id AS l, b_id AS r, a.sz+b.sz AS sz, CAST(a.sx+b.sx AS DOUBLE)/(a.sz+b.sz) AS cx, CAST(a.sy+b.sy AS DOUBLE)/(a.sz+b.sz) AS cy FROM ov v JOIN slices a ON a.id=a_id JOIN slices b ON b.id=b_id)"
ENC = """sh AS (SELECT a_id AS p, b_id AS q, o FROM cf UNION ALL SELECT b_id, a_id, o FROM cf UNION ALL SELECT id, id, sz FROM slices),
enc AS (SELECT i.key AS i_key, o.key AS o_key FROM cont i JOIN cont o ON i.isi=o.isi AND i.sz<400 AND o.sz>=800 LEFT JOIN sh u ON u.p=i.l AND u.q=o.l LEFT JOIN sh v ON v.p=i.r AND v.q=o.r
 WHERE (i.cx-o.cx)*(i.cx-o.cx)+(i.cy-o.cy)*(i.cy-o.cy) < 1000 AND CAST(coalesce(u.o,0)+coalesce(v.o,0) AS DOUBLE)/i.sz >= 0.9)"""
W_ENC = f"WITH {S}, {OV}, {CF}, {CONT}, {ENC}"


def _cont(spark, d):
    """Continuations that are small (under 400 pixels) or large (800 and more); the others neither enclose nor are enclosed."""
    size = F.col("a_sz") + F.col("b_sz")
    p, s = pairs(spark, d).where((size < 400) | (size >= 800)).select("a_id", "b_id", "z"), sl(spark, d).select("id", "sz", "sx", "sy")
    j = p.join(s.alias("a"), F.col("a_id") == F.col("a.id")).join(s.alias("b"), F.col("b_id") == F.col("b.id"))
    mid = lambda k: (F.col(f"a.s{k}") + F.col(f"b.s{k}")).cast("double") / (F.col("a.sz") + F.col("b.sz"))
    return j.select(F.concat_ws(":", F.lit("C"), "a_id", "b_id").alias("key"), (F.col("z") + 1).alias("isi"), F.col("a_id").alias("left"), F.col("b_id").alias("right"), (F.col("a.sz") + F.col("b.sz")).alias("sz"), mid("x").alias("cx"), mid("y").alias("cy"))


def _shared(spark, d):
    c = conflicts(spark, d).select("a_id", "b_id", "o")
    own = sl(spark, d).select(F.col("id").alias("a_id"), F.col("id").alias("b_id"), F.col("sz").alias("o"))
    return c.unionByName(c.select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), "o")).unionByName(own)


def _enclosing(spark, d):
    c = kept(spark, d, "continuations by size", lambda: _cont(spark, d))
    inner = c.where("sz < 400")
    return inner, C.enclosing(inner, c.where("sz >= 800"), _shared(spark, d))


@query(W_ENC + " SELECT i_key, o_key FROM enc")
def enclosing_segments(spark, d):
    """Large continuations that hold small ones."""
    return _enclosing(spark, d)[1]


@query(W_ENC + " SELECT 'mito:'||key AS row, key, 1 AS coef, '<=' AS relation, CAST(0 AS BIGINT) AS value FROM cont WHERE sz<400 UNION ALL SELECT 'mito:'||i_key, o_key, -1, '<=', 0 FROM enc")
def mitochondria_rows(spark, d):
    """M9."""
    return C.mitochondria_rows(*_enclosing(spark, d))


@query(W_ENC + ", n AS (SELECT i_key, CAST(count(*) AS BIGINT) AS n FROM enc GROUP BY 1) SELECT 'syn:'||i_key AS row, i_key AS key, CAST(n AS INTEGER) AS coef, '<=' AS relation, n AS value FROM n UNION ALL SELECT 'syn:'||e.i_key, o_key, 1, '<=', n FROM enc e JOIN n ON n.i_key=e.i_key")
def synapse_rows(spark, d):
    """M10."""
    return C.synapse_rows(*_enclosing(spark, d))


WIN = 'win AS (SELECT key, isi, w AS "window" FROM seg, range(0, 100) r(w) WHERE isi >= w*7 AND isi < w*7+10)'


@query(W_SEG + f', {WIN} SELECT "window", CAST(count(*) AS BIGINT) AS n, min(isi) AS lo, max(isi) AS hi FROM win GROUP BY 1')
def subproblem_windows(spark, d):
    """Overlapping windows of intervals."""
    return C.in_windows(segs(spark, d), 10, 3).groupBy("window").agg(F.count("*").alias("n"), F.min("isi").alias("lo"), F.max("isi").alias("hi"))


@query(W_SEG + f""", {WIN}, n AS (SELECT id, count(DISTINCT key) AS n FROM mem GROUP BY id), k AS (SELECT id, "window", count(DISTINCT m.key) AS k FROM mem m JOIN win ON win.key=m.key GROUP BY 1,2) SELECT 'flow:'||k.id AS row, "window" FROM k JOIN n ON n.id=k.id WHERE k=n""")
def subproblem_constraints(spark, d):
    """Rows that fit a window whole."""
    return C.continuation_windows(kept_segs(spark, d), 10, 3)


@query("SELECT a*55+b*5+c AS number, a*1e6::DOUBLE AS prior_end, b*1e6::DOUBLE AS prior_continuation, 0.5+c*0.1::DOUBLE AS potts FROM range(0,11) r(a), range(0,11) s(b), range(0,5) t(c)")
def grid_search(spark, d):
    """Every combination of parameters, counted like an odometer."""
    return C.parameter_grid(spark, prior_end=(0, 1e7, 1e6), prior_continuation=(0, 1e7, 1e6), potts=(0.5, 0.9, 0.1)).withColumn("potts", F.round("potts", 9))


ORACLE["grid_search"] = ORACLE["grid_search"].replace("0.5+c*0.1::DOUBLE", "round(0.5+c*0.1::DOUBLE,9)")

# --- graphs ---

CLOSURE = "WITH RECURSIVE {base}, e AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), r(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)"
_CE = f"{S}, {OV}, edges AS (SELECT a_id AS a, b_id AS b FROM ov WHERE {LIKE} >= 0.5)"


@query(CLOSURE.format(base=_CE) + " SELECT a AS id, min(b) AS component FROM r GROUP BY a")
def slice_components(spark, d):
    """Slices joined through continuations."""
    c = SG.continuations(pairs(spark, d))
    return graph.components(c.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))


@query(CLOSURE.format(base=_CE) + ", lab AS (SELECT a AS id, min(b) AS component FROM r GROUP BY a) SELECT 'C:'||a||':'||b AS key, component AS assembly FROM edges JOIN lab ON lab.id=a")
def assemblies(spark, d):
    """Chosen segments (here all continuations) by what they hang together with."""
    return solve.assemblies(SG.continuation_segments(pairs(spark, d)))


@query(CLOSURE.format(base=_CE) + ", lab AS (SELECT a AS id, min(b) AS component FROM r GROUP BY a) SELECT component AS assembly, min(z) AS first_section, max(z) AS last_section, CAST(count(*) AS BIGINT) AS n FROM lab JOIN slices s ON s.id=lab.id GROUP BY 1")
def neuron_extent(spark, d):
    """First and last section of each component."""
    return slice_components(spark, d).join(sl(spark, d), "id").groupBy(F.col("component").alias("assembly")).agg(F.min("z").alias("first_section"), F.max("z").alias("last_section"), F.count("*").alias("n"))


_ED = f"""{S}, moved AS (SELECT id, z, y, x0+CASE WHEN id%7=0 THEN 1 ELSE 0 END AS x0, x1+CASE WHEN id%7=0 THEN 1 ELSE 0 END AS x1 FROM runs),
  so AS (SELECT id, z, string_agg(y||':'||x0||'-'||x1, ',' ORDER BY y, x0) AS mask FROM runs GROUP BY 1, 2), sn AS (SELECT id, z, string_agg(y||':'||x0||'-'||x1, ',' ORDER BY y, x0) AS mask FROM moved GROUP BY 1, 2),
  o AS (SELECT * FROM runs WHERE id NOT IN (SELECT so.id FROM so JOIN sn ON so.z=sn.z AND so.mask=sn.mask)), n AS (SELECT * FROM moved WHERE id NOT IN (SELECT sn.id FROM so JOIN sn ON so.z=sn.z AND so.mask=sn.mask)),
  edges AS (SELECT DISTINCT 'o'||o.id AS a, 'n'||n.id AS b FROM o JOIN n ON n.z=o.z AND n.y=o.y AND o.x0<n.x1 AND n.x0<o.x1)"""


@query(CLOSURE.format(base=_ED) + ", lab AS (SELECT a AS id, min(b) AS c FROM r GROUP BY a) SELECT string_agg(substr(id,2),'-' ORDER BY CAST(substr(id,2) AS BIGINT)) FILTER (WHERE id LIKE 'o%') AS old_ids, string_agg(substr(id,2),'-' ORDER BY CAST(substr(id,2) AS BIGINT)) FILTER (WHERE id LIKE 'n%') AS new_ids FROM lab GROUP BY c")
def edit_components(spark, d):
    """Groups of old slices and those that replace them, where a seventh of all slices was moved; unchanged ones are left out."""
    old, by = packed(spark, d), F.when(F.col("id") % 7 == 0, 1).otherwise(0)
    e = labels.edits(old, old.withColumn("x0", F.col("x0") + by).withColumn("x1", F.col("x1") + by))
    return e.select(F.array_join(F.transform("old_ids", lambda x: x.cast("string")), "-").alias("old_ids"), F.array_join(F.transform("new_ids", lambda x: x.cast("string")), "-").alias("new_ids"))




@query(CLOSURE.format(base=_LL) + ", lab AS (SELECT a AS id, min(b) AS c FROM r GROUP BY a) SELECT id%50 AS label, CAST(count(*)-count(DISTINCT c) AS BIGINT) AS n_links FROM lab GROUP BY 1")
def spanning_forest_sizes(spark, d):
    """Links of each label's spanning forest."""
    return labels.spanning_forest(labelled(spark, d)).groupBy("label").agg(F.count("*").alias("n_links"))


@query("WITH RECURSIVE " + _LL + """, e AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY o DESC, a, b) AS n FROM edges),
r(label, n, node) AS (SELECT label, n, a FROM e UNION SELECT r.label, r.n, CASE WHEN e.a=r.node THEN e.b ELSE e.a END FROM r JOIN e ON e.label=r.label AND e.n<r.n AND (e.a=r.node OR e.b=r.node))
SELECT e.label, e.a, e.b, e.o FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.label=e.label AND r.n=e.n AND r.node=e.b)""")
def spanning_forest(spark, d):
    """The links themselves, in the order of overlap and ids: those whose ends no better links join."""
    return labels.spanning_forest(labelled(spark, d))


@query(f"WITH {_LL} SELECT id, CAST(id NOT IN (SELECT b FROM edges) AS INTEGER) AS left_end, CAST(id NOT IN (SELECT a FROM edges) AS INTEGER) AS right_end FROM slices WHERE id NOT IN (SELECT b FROM edges) OR id NOT IN (SELECT a FROM edges)")
def ground_truth_ends(spark, d):
    """Slices of labels without a link on a side."""
    return labels.open_ends(sl(spark, d), labels.label_links(labelled(spark, d)).select("a", "b"))


@query("SELECT 'c'||c_custkey AS clique, node, depth FROM customer JOIN nation ON n_nationkey=c_nationkey JOIN region ON r_regionkey=n_regionkey, LATERAL (VALUES ('r'||r_regionkey, CAST(0 AS BIGINT)), ('n'||n_nationkey, 1), ('c'||c_custkey, 2)) v(node, depth)")
def tree_cliques(spark, d):
    """Root-to-leaf paths of a tree."""
    r = adapter.table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("node"), F.lit(None).cast("string").alias("parent"))
    n = adapter.table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("node"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"))
    c = adapter.table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent"))
    return graph.leaf_paths(r.unionByName(n).unionByName(c)).where("clique like 'c%'")


# --- solving ---


#: costs that make chains of segments compete: ends cost, the rest pays; steps of a quarter are exact in binary
_COST = {0: "2 + (isi % 3) / 2.0", 1: "-3 - isi % 5", 2: "-4.25 - isi % 3"}


def priced(spark, d):
    c = F.expr("CASE type " + " ".join(f"WHEN {t} THEN CAST({e} AS DOUBLE)" for t, e in _COST.items()) + " END")
    return segs(spark, d).withColumn("cost", c)


def _solved(spark, d):
    """The whole volume as one problem: problem, key, type, isi, sl, sr, cost, x."""

    def make():
        s = priced(spark, d).withColumn("problem", F.lit(0).cast("long"))
        return solve.solved(s, sl(spark, d), cliques(spark, d), pieces=_pieces(spark, d))

    return kept(spark, d, "solved", make)


def _pieces(spark, d):
    """id, component of the slices in continuations and branches: those that share one, or exclude each other, directly or over others.  No end pays, so no other slice matters."""

    def make():
        m = segs(spark, d).where("type > 0").select(F.concat("sl", "sr").alias("ids"))
        m = m.select(F.array_min("ids").alias("a"), F.explode("ids").alias("b"))
        used = graph.settled(m.select(F.col("b").alias("id")).distinct())
        c = conflicts(spark, d).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
        for k in "ab":
            c = c.join(used.withColumnRenamed("id", k).hint("merge"), k, "left_semi")
        return graph.components(m.unionByName(c.select("a", "b")))

    return kept(spark, d, "pieces", make)


_E = lambda z: "(2 + ({}) % 3 / 2.0)".format(z)
#: every choice of continuations and branches of a piece that excludes no other, ends added for free sides: the least cost is the optimum
BEST = f"""w AS MATERIALIZED (SELECT key, row_number() OVER (ORDER BY key) AS n, sl, sr, c FROM (SELECT 'C:'||a_id||':'||b_id AS key, [a_id] AS sl, [b_id] AS sr, CAST(-3-(z+1)%5 AS DOUBLE) AS c FROM ov WHERE {LIKE} >= 0.5
    UNION ALL SELECT 'B:'||source||':'||t2||':'||t1||':R', [source], [t1, t2], -4.25-(z+1)%3 FROM br UNION ALL SELECT 'B:'||source||':'||t2||':'||t1||':L', [t1, t2], [source], -4.25-(z+1)%3 FROM bl)),
  me AS MATERIALIZED (SELECT n, unnest(sl) AS id, true AS l FROM w UNION ALL SELECT n, unnest(sr), false FROM w),
  us AS MATERIALIZED (SELECT DISTINCT id FROM me), cc AS MATERIALIZED (SELECT a_id, b_id FROM cf WHERE a_id IN (SELECT id FROM us) AND b_id IN (SELECT id FROM us)),
  edges AS MATERIALIZED (SELECT p.id AS a, q.id AS b FROM me p JOIN me q ON p.n=q.n AND p.id<q.id UNION SELECT a_id, b_id FROM cc)"""
BEST2 = f""", lab AS MATERIALIZED (SELECT a AS id, min(b) AS component FROM r GROUP BY a),
  bad AS MATERIALIZED (SELECT p.n, q.n AS m FROM me p JOIN me q ON p.id=q.id AND p.l=q.l AND p.n<>q.n UNION SELECT p.n, q.n FROM me p JOIN cc ON p.id=cc.a_id OR p.id=cc.b_id JOIN me q ON q.id=CASE WHEN p.id=cc.a_id THEN cc.b_id ELSE cc.a_id END),
  v AS MATERIALIZED (SELECT w.n, lab.component, coalesce(b.bad, []) AS bad, w.c-(SELECT sum(CASE WHEN me.l THEN {_E("z+1")} ELSE {_E("z")} END) FROM me JOIN slices ON slices.id=me.id WHERE me.n=w.n) AS c FROM w JOIN lab ON lab.id=w.sl[1] LEFT JOIN (SELECT n, list(m) AS bad FROM bad GROUP BY 1) b ON b.n=w.n),
  st(component, last, mem) AS (SELECT component, n, [n] FROM v UNION ALL SELECT st.component, v.n, list_append(mem, v.n) FROM st JOIN v ON v.component=st.component AND v.n>last WHERE NOT list_has_any(mem, v.bad)),
  sx AS (SELECT row_number() OVER () AS k, * FROM st), ch AS (SELECT k, component, unnest(mem) AS n FROM sx),
  co AS (SELECT ch.k, any_value(ch.component) AS component, sum(v.c) AS c FROM ch JOIN v ON v.n=ch.n GROUP BY 1),
  un AS (SELECT k, sum({_E("z+1")}+{_E("z")}) AS e FROM (SELECT DISTINCT k, me.id FROM ch JOIN me ON me.n=ch.n) q JOIN slices ON slices.id=q.id GROUP BY 1),
  best AS (SELECT component, least(0, min(co.c+un.e)) AS objective FROM co JOIN un ON un.k=co.k GROUP BY 1)"""
_BEST = f"{S}, {OV}, {CF}, {BR}, {BL}, {BEST}"


@query(CLOSURE.format(base=_BEST) + BEST2 + " SELECT component, CAST(round(objective,6) AS DOUBLE) AS objective FROM best")
def solve_volume(spark, d):
    """The least cost of each piece of the whole programme (conflicts, exclusivity, flow; ends, continuations, branches) over the volume."""
    piece = _pieces(spark, d)
    on = _solved(spark, d).where("x = 1").select("cost", F.array_min(F.concat("sl", "sr")).alias("id"))
    spent = on.join(piece.hint("merge"), "id").groupBy("component").agg(F.sum("cost").alias("spent"))
    return piece.select("component").distinct().join(spent, "component", "left").select("component", F.round(F.coalesce("spent", F.lit(0.0)), 6).alias("objective"))


@query(W_SEG + ", l AS (SELECT DISTINCT 'flow:'||id AS row FROM mem) SELECT CAST(0 AS BIGINT) AS violated, CAST(0 AS BIGINT) AS undecided")
def solution_feasible(spark, d):
    """M6: rows that the solution breaks, and variables without a value."""
    s = _solved(spark, d)
    left = segs(spark, d).join(s.where("x in (0, 1)").select("key"), "key", "left_anti").agg(F.count("*").alias("undecided"))
    return solve.broken(s, sl(spark, d), cliques(spark, d)).agg(F.count("*").alias("violated")).crossJoin(left)  # one row each


@query(CLOSURE.format(base=_BEST) + BEST2 + " SELECT CAST(round(sum(objective),6) AS DOUBLE) AS cost FROM best")
def reconstruct(spark, d):
    """What the chosen segments cost, all assemblies together."""
    s = _solved(spark, d)
    on, _ = solve.reconstruct(s, s.select("key", "x"))
    return solve.assemblies(on).join(s.select("key", "cost"), "key").agg(F.round(F.sum("cost"), 6).alias("cost"))


@query()
def solve_core(spark, d):
    """Every core's programme over the segments of its blocks and one block around, solved; chosen segments that lie in the core itself, by assembly.

    tests/test_operators.py has all assignments of small programmes; solve_volume has the whole volume's optimum in SQL.
    """
    g, s = the_grid(spark, d), sl(spark, d)
    big = grid.cores_grid(g)
    problem = lambda p: (F.col(f"{p}z") * 100_000 + F.col(f"{p}y")) * 1_000_000 + F.col(f"{p}x")
    every = graph.settled(solve.lasting(priced(spark, d)))  # what is out in all cores isn't copied into them
    of = grid.segment_blocks(every, s, big, g.block, "c").select("key", problem("c").alias("problem"))
    on = graph.settled(solve.solved(every.join(of, "key"), s, cliques(spark, d)).where("x = 1").drop("x"))
    inside = grid.segment_blocks(on.select("key", "isi", "sl", "sr").distinct(), s, big, 0, "c").select("key", problem("c").alias("problem"))
    return solve.assemblies(graph.settled(on.join(inside, ["problem", "key"], "left_semi")))


# --- stores ---


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey%3=0 THEN o_orderstatus ELSE 'new' END AS v FROM orders")
def insert_ignore(spark, d):
    """SNK1: all orders, each twice, into a store that has a third of them: new rows only where the key isn't there."""
    o = adapter.table(spark, d, "orders")
    new = o.select(F.col("o_orderkey").alias("id"), F.lit("new").alias("v"))
    return store.insert_ignore(o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("v")), new.union(new), ["id"])


@query(W_GRID + "SELECT id, bx, by, bz FROM links WHERE bz%4<>0 UNION ALL SELECT id+1000000, bx, by, bz FROM links WHERE bz%4=0")
def replace_partition(spark, d):
    """SNK4, Q16: a block's links are replaced as a whole."""
    links = grid.slice_blocks(sl(spark, d), the_grid(spark, d))
    return store.replace_partitions(links, links.where("bz % 4 = 0").withColumn("id", F.col("id") + 1000000), ["bx", "by", "bz"])


_ASM = "found AS (SELECT DISTINCT o_custkey%16 AS core, o_custkey AS hash FROM orders), stored AS (SELECT * FROM found WHERE hash%2=0)"


@query(f"WITH {_ASM} SELECT core, hash FROM found WHERE hash%2<>0")
def new_assemblies(spark, d):
    """SNK6, Q10: assemblies that aren't stored."""
    f = adapter.table(spark, d, "orders").select((F.col("o_custkey") % 16).alias("core"), F.col("o_custkey").alias("hash")).distinct()
    return store.new_assemblies(f.where("hash % 2 = 0"), f)


@query(f"WITH {_ASM}, links AS (SELECT 1 AS s, core, hash FROM stored UNION ALL SELECT 2, core, hash FROM found) SELECT core, hash FROM links WHERE s = CASE WHEN core%2=0 THEN 2 ELSE 1 END")
def latest_solution(spark, d):
    """Q11, Q12, SNK6: the assemblies of each core's preferred solution."""
    f = adapter.table(spark, d, "orders").select((F.col("o_custkey") % 16).alias("core"), F.col("o_custkey").alias("hash"), F.col("o_orderkey").cast("string").alias("key"))
    stored = f.where("hash % 2 = 0").select("core", "hash").distinct()
    first = stored.select(F.lit(1).cast("long").alias("solution"), "core", "hash")
    _, links, _ = store.store_solution(stored, first, f.where("hash % 2 = 0"), f, 2)
    prec = f.select("core").distinct().withColumn("solution", F.when(F.col("core") % 2 == 0, 2).otherwise(1).cast("long"))
    return store.latest_solution(links, prec)


@query("SELECT n_name AS type, CAST(n_nationkey AS BIGINT) AS stack_id, CAST(1000+n_nationkey AS BIGINT) AS width, CAST(2000 AS BIGINT) AS height, CAST(30+n_nationkey AS BIGINT) AS depth, CAST(8*128 AS BIGINT) AS volume_x, CAST(16*128 AS BIGINT) AS volume_y, least(CAST(40 AS BIGINT), CAST(30+n_nationkey AS BIGINT)) AS volume_z FROM nation")
def stack_config(spark, d):
    """Q13, Q14, SRC8: stack descriptions with their grid."""
    n = adapter.table(spark, d, "nation").withColumn("stack_id", F.col("n_nationkey").cast("long"))
    stack = n.select("stack_id", F.format_string("(%d,2000,%d)", F.col("stack_id") + 1000, F.col("stack_id") + 30).alias("dimension"))
    project = n.select("stack_id", (F.col("stack_id") + 7).alias("project_stack_id"))
    seg = n.select((F.col("stack_id") + 7).alias("project_stack_id"), F.col("n_name").alias("type"), F.lit(1).alias("configuration_id"))
    g = spark.range(1).select(F.lit(1).alias("configuration_id"), *(F.lit(v).cast("long").alias(k) for k, v in dict(num_x=8, num_y=16, num_z=4, block_x=128, block_y=128, block_z=10).items()))
    return stacks.stack_table(stack, project, seg, g)


@query(W_SEG + """, p AS (SELECT key FROM seg WHERE type<2), q AS (SELECT key FROM seg WHERE type>0)
SELECT 'union' AS op, CAST(count(*) AS BIGINT) AS n FROM (SELECT key FROM p UNION SELECT key FROM q) UNION ALL SELECT 'all', CAST((SELECT count(*) FROM p)+(SELECT count(*) FROM q) AS BIGINT) UNION ALL SELECT 'except', CAST(count(*) AS BIGINT) FROM (SELECT key FROM p EXCEPT SELECT key FROM q) UNION ALL SELECT 'intersect', CAST(count(*) AS BIGINT) FROM (SELECT key FROM p INTERSECT SELECT key FROM q)""")
def set_ops(spark, d):
    """Unions, difference and intersection of segments."""
    s = kept_segs(spark, d).select("key", "type")
    p, q = s.where("type < 2").select("key"), s.where("type > 0").select("key")
    out = None
    for op, x in (("union", p.union(q).distinct()), ("all", p.unionByName(q)), ("except", p.subtract(q)), ("intersect", p.intersect(q))):
        n = x.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query(f"""WITH {S}, px AS (SELECT z, y, x, max(id) AS label FROM (SELECT id, z, y, unnest(range(x0, x1)) AS x FROM runs) GROUP BY z, y, x)
SELECT label, z, CAST(count(*) AS BIGINT) AS n_pixels, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y FROM px GROUP BY label, z""")
def label_paint(spark, d):
    """SNK11: the painted volume, of several slices at a pixel the largest label; given as each label's pixels in each section."""
    assembly = sl(spark, d).select("id", F.col("id").alias("label"))
    seen = labels.visible(packed(spark, d).join(assembly, "id"))
    n = F.col("x1") - F.col("x0")
    return seen.groupBy("label", "z").agg(F.sum(n).alias("n_pixels"), F.sum(F.expr("(x0 + x1 - 1) * (x1 - x0) div 2")).alias("sum_x"), F.sum(F.col("y") * n).alias("sum_y"))


@query(f"""WITH {S}, px AS (SELECT z, y, x, max(id) AS label FROM (SELECT id, z, y, unnest(range(x0, x1)) AS x FROM runs WHERE id > 0) GROUP BY z, y, x)
SELECT x//64 AS bx, y//16 AS by, z//10 AS bz, CAST(count(*) AS BIGINT) AS n_labelled, CAST(sum(label*(1+x%7+y%5+z%3)) AS BIGINT) AS weighted FROM px GROUP BY 1, 2, 3""")
def label_volume(spark, d):
    """SNK11: the painted volume written as dense chunks of a block each, read back, and summed up by block."""
    label = sl(spark, d).select("id", F.col("id").alias("label"))
    painted = packed(spark, d).join(label.hint("merge"), "id").where("lines is not null and z is not null")
    index = graph.settled(volumes.export_volume(painted, f"{graph.shared_folder(spark)}/volume-{uuid.uuid4().hex}", BLOCK, deflate=True, shelf=64))
    back = volumes.read_volume(index, BLOCK)
    at = [F.floor(F.col(c) / n).alias(k) for c, n, k in zip(("x0", "y", "z"), BLOCK, ("bx", "by", "bz"))]  # a run lies in one block
    upto = lambda m: 21 * F.expr(f"({m}) div 7") + F.expr(f"(({m}) % 7) * (({m}) % 7 - 1) div 2")  # noqa: E731 -- the sum of x % 7 for x from 0 to m - 1
    rests = F.when(F.col("x0") >= 0, upto("x1") - upto("x0")).otherwise(upto("1 - x1") - upto("1 - x0"))
    n = F.col("x1") - F.col("x0")
    got = back.groupBy(*at).agg(F.sum(n).alias("found"), F.sum(F.col("label") * (n * (1 + F.col("y") % 5 + F.col("z") % 3) + rests)).alias("weighted"))
    return got.join(index, ["bx", "by", "bz"]).where("found = n_labelled").select("bx", "by", "bz", "n_labelled", "weighted")


@query(f"WITH {S} SELECT id, x, y FROM (SELECT id, x0, y0, 1+id%3 AS r FROM slices) s, range(-4, 5) a(i), range(-4, 5) b(j), LATERAL (SELECT x0+i AS x, y0+j AS y) m WHERE i*i+j*j <= r*r AND x >= 0 AND y >= 0")
def brush_strokes(spark, d):
    """Pixels of round brush strokes."""
    return labels.brush(sl(spark, d).select("id", F.col("x0").alias("cx"), F.col("y0").alias("cy"), (1 + F.col("id") % 3).alias("r")))


@query(f"WITH {S}, m AS (SELECT id, y+5 AS y, greatest(x0+3, 20) AS x0, least(x1+3, 500) AS x1 FROM runs WHERE y+5 >= 10 AND y+5 < 60 AND x0+3 < 500 AND x1+3 > 20) SELECT id, CAST(sum(x1-x0) AS BIGINT) AS n, min(x0) AS lo_x, max(x1) AS hi_x, min(y) AS lo_y, max(y)+1 AS hi_y FROM m GROUP BY id")
def translate_and_crop(spark, d):
    """P6, SRC3: slices moved, then cut to a rectangle."""
    m = masks.clip(masks.translate(runs(spark, d), 3, 5), 20, 10, 500, 60)
    return m.groupBy("id").agg(F.sum(F.col("x1") - F.col("x0")).alias("n"), F.min("x0").alias("lo_x"), F.max("x1").alias("hi_x"), F.min("y").alias("lo_y"), (F.max("y") + 1).alias("hi_y"))


@query(f"WITH {S} SELECT a.id AS a_id, b.id AS b_id, CAST(sum(least(a.x1,b.x1)-greatest(a.x0,b.x0)) AS BIGINT) AS sz, min(greatest(a.x0,b.x0)) AS x0, min(a.y) AS y0, max(least(a.x1,b.x1)) AS x1, max(a.y)+1 AS y1 FROM runs a JOIN runs b ON a.z=b.z AND a.y=b.y AND a.id<b.id AND a.x0<b.x1 AND b.x0<a.x1 GROUP BY 1, 2")
def slice_intersections(spark, d):
    """The pixels that two slices of a section both have, as a slice."""
    r = masks.intersect(conflicts(spark, d), packed(spark, d))
    return r.groupBy("a_id", "b_id").agg(F.sum(F.col("x1") - F.col("x0")).alias("sz"), F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), (F.max("y") + 1).alias("y1"))


@query(f"WITH {S}, h AS (SELECT id, z, string_agg(y||':'||x0||'-'||x1, ',' ORDER BY y, x0) AS mask FROM runs GROUP BY 1, 2) SELECT count(*) AS slices, count(DISTINCT mask||'@'||z) AS masks FROM h")
def mask_hashes(spark, d):
    """Ids that follow from a slice's pixels: as many as there are different masks, moved or not."""
    h = masks.pixel_hash(masks.translate(masks.translate(runs(spark, d), 7, -2), -7, 2))
    return h.agg(F.count("*").alias("slices"), F.countDistinct(slice_hash("mask_hash", "z")).alias("masks"))


_TS = "r AS (SELECT id, x0, y0, x1, y1 FROM slices)"


@query(f"WITH {S}, {_TS} SELECT id, c AS col, w AS row, greatest(x0-c*16,0) AS beg_x, least(x1-c*16,16) AS end_x, greatest(c*16-x0,0) AS dst_x, greatest(y0-w*16,0) AS beg_y, least(y1-w*16,16) AS end_y, greatest(w*16-y0,0) AS dst_y, 'http://host/'||(id%80)||'/'||w||'_'||c||'_'||'2.png' AS url FROM (SELECT *, unnest(range(x0//16,(x1-1)//16+1)) AS c FROM r) q, LATERAL (SELECT unnest(range(y0//16,(y1-1)//16+1)) AS w) l")
def tile_requests(spark, d):
    """SRC4, SRC5, SRC6: tiles of a request, their offsets and addresses."""
    t = stacks.tiles_of(sl(spark, d).select("id", "x0", "y0", "x1", "y1"), (16, 16))
    t = t.withColumn("url", stacks.tile_url(1, "http://host/", "png", 2, (16, 16), F.col("id") % 80, "row", "col"))
    return t.drop("x0", "y0", "x1", "y1")


@query("SELECT z, CAST(count(*) AS BIGINT) AS n, round(sum(value),6) AS total FROM (SELECT (l_orderkey%40) AS z, l_discount*10 AS value FROM lineitem) WHERE z>=5 AND z<9 GROUP BY z")
def stack_scan(spark, d):
    """SRC1: sections of a range."""
    px = adapter.table(spark, d, "lineitem").select((F.col("l_orderkey") % 40).alias("z"), (F.col("l_discount") * 10).alias("value"))
    return stacks.section_range(px, 5, 9).groupBy("z").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query(W_OV + f"SELECT 'C:'||a_id||':'||b_id||' 1 '||a_id||' 0 '||b_id||' 1 -1 -1' AS line FROM ov WHERE {LIKE} >= 0.5")
def problem_dump(spark, d):
    """SNK8: segments as text."""
    return labels.problem_lines(SG.continuation_segments(pairs(spark, d)))


@query(W_SEG + "SELECT 'flow:'||id AS row, '0 2 '||(count(*) FILTER (WHERE is_left))||' '||coalesce(string_agg(key,' ' ORDER BY key) FILTER (WHERE is_left),'')||' '||(count(*) FILTER (WHERE NOT is_left))||' '||coalesce(string_agg(key,' ' ORDER BY key) FILTER (WHERE NOT is_left),'') AS line FROM mem GROUP BY id")
def constraint_dump(spark, d):
    """SNK8: rows as text."""
    return labels.constraint_lines(C.continuation_rows(kept_segs(spark, d)))


@query()
def rf_probability(spark, d):
    """M16, M17, SRC10, SNK10, P27: forest trained and applied by Spark ML."""
    v = adapter.vectors(spark, d).withColumn("label", (F.col("label") < 5).cast("int"))
    model = learned.train(v)
    return learned.probability(model, v).select("vec_id", "label", "p", neglog("p", F.lit(1)).alias("cost"))


def section_pixels(spark, d):
    """Sections of 64 x 64 pixels, an event each."""
    e = adapter.table(spark, d, "events").select("event_id", "value")
    x, y, z = F.col("event_id") % 64, F.floor(F.col("event_id") / 64) % 64, F.floor(F.col("event_id") / 4096)
    coarse = ((F.floor(x / 6) * 7 + F.floor(y / 6) * 5 + z * 3) % 10).cast("double") / 10.0
    return e.select(z.alias("z"), y.alias("y"), x.alias("x"), (0.5 * (F.col("value") / (F.col("value") + 35.0)) + 0.5 * coarse).alias("value"))


def extracted(spark, d):
    """Trees of six thresholds, of tiles of 16 x 16 pixels put together."""
    return extract.sections(section_pixels(spark, d), levels=6, least=4, most=2000, height=3, side=16)


def pixel_stack(spark, d):
    """The sections as a stack of tiles of 24 x 16 pixels, written once a session and folder; tiles whose numbers add up to a multiple of 7 are missing."""
    folder = f"{graph.shared_folder(spark)}/tiles-{uuid.uuid4().hex}"
    key = (spark.sparkContext.applicationId, d, state_of(spark, d), "tile stack")
    if key not in _KEPT:
        px = section_pixels(spark, d)
        stack = stacks.StackDescription(64, 64, px.agg(F.max("z") + 1).first()[0], base=f"{folder}/", extension="pgm", tile=(24, 16), source_type=4)
        there = px.where((F.col("z") + F.floor(F.col("y") / 16) + F.floor(F.col("x") / 24)) % 7 != 0)
        tile_source.write_stack(there, stack).count()
        _KEPT[key] = stack
    return _KEPT[key]


@query("""WITH pix AS (SELECT event_id // 4096 AS z, (event_id // 64) % 64 AS y, event_id % 64 AS x, 0.5*(value/(value+35.0::DOUBLE))+0.5*(CAST(((event_id%64)//6*7+((event_id//64)%64)//6*5+(event_id//4096)*3)%10 AS DOUBLE)/10.0::DOUBLE) AS v FROM events)
SELECT z, y, x, CAST(round_even(v*255, 0) AS BIGINT) AS step FROM pix WHERE x >= 20 AND x < 50 AND y >= 8 AND y < 55 AND (z + y//16 + x//24) % 7 <> 0""")
def stack_crop(spark, d):
    """SRC1, SRC3, SRC4, SRC5: a box of a stack of tiles, read by its data source; missing tiles are empty."""
    got = tile_source.read_stack(spark, pixel_stack(spark, d)).where("x >= 20 and x < 50 and y >= 8 and y < 55")
    step = F.rint(F.col("value") * 255).cast("long")
    # a tile is written whole: what the last section doesn't have is 0 there
    return got.select("z", "y", "x", step.alias("step")).join(section_pixels(spark, d).select("z", "y", "x"), ["z", "y", "x"], "left_semi")


#: regions by label propagation over pixels; a node is a pixel set, named by its least pixel and its size
TREE = """RECURSIVE pix AS (SELECT event_id // 4096 AS z, event_id % 4096 AS p, event_id % 64 AS x, (event_id // 64) % 64 AS y, 0.5*(value/(value+35.0::DOUBLE))+0.5*(CAST(((event_id%64)//6*7+((event_id//64)%64)//6*5+(event_id//4096)*3)%10 AS DOUBLE)/10.0::DOUBLE) AS v FROM events),
px AS (SELECT (z*6+k)*4096+p AS id, k, z, p, x, y FROM pix, range(0, 6) r(k) WHERE v > (k+0.5::DOUBLE)/6),
edge AS (SELECT a.id AS a, b.id AS b FROM px a JOIN px b ON b.id = a.id+1 AND a.x < 63 UNION ALL SELECT a.id, b.id FROM px a JOIN px b ON b.id = a.id-1 AND a.x > 0 UNION ALL SELECT a.id, b.id FROM px a JOIN px b ON b.id = a.id+64 AND a.y < 63 UNION ALL SELECT a.id, b.id FROM px a JOIN px b ON b.id = a.id-64 AND a.y > 0),
cc(id, c) USING KEY (id) AS (SELECT id, id FROM px UNION (SELECT e.a, min(v.c) FROM cc v JOIN edge e ON e.b = v.id JOIN recurring.cc u ON u.id = e.a WHERE v.c < u.c GROUP BY e.a)),
lab AS (SELECT k, z, p, x, y, c % 4096 AS c FROM cc JOIN px USING (id)),
reg AS (SELECT k, z, c, count(*) AS size, min(x) AS x0, min(y) AS y0, max(x)+1 AS x1, max(y)+1 AS y1, sum(x) AS sx, sum(y) AS sy FROM lab GROUP BY 1, 2, 3),
node AS (SELECT z, c, size, min(k) AS k0, max(k) AS k1, any_value(x0) AS x0, any_value(y0) AS y0, any_value(x1) AS x1, any_value(y1) AS y1, any_value(sx) AS sx, any_value(sy) AS sy FROM reg WHERE size BETWEEN 4 AND 2000 GROUP BY 1, 2, 3),
anc AS (SELECT DISTINCT n.z, n.c, n.size, m.c AS ac, m.size AS asize FROM node n JOIN lab l ON l.z = n.z AND l.p = n.c AND l.k < n.k0 JOIN reg r ON r.k = l.k AND r.z = l.z AND r.c = l.c JOIN node m ON m.z = r.z AND m.c = r.c AND m.size = r.size WHERE m.size > n.size),
dep AS (SELECT n.z, n.c, n.size, count(a.ac) AS depth FROM node n LEFT JOIN anc a ON a.z = n.z AND a.c = n.c AND a.size = n.size GROUP BY 1, 2, 3),
rise AS (SELECT a.z, a.ac AS c, a.asize AS size, max(d.depth) AS low FROM anc a JOIN dep d ON d.z = a.z AND d.c = a.c AND d.size = a.size GROUP BY 1, 2, 3),
kept AS (SELECT n.*, d.depth FROM node n JOIN dep d USING (z, c, size) LEFT JOIN rise r USING (z, c, size) WHERE coalesce(r.low - d.depth, 0) < 3),
par AS (SELECT a.z, a.c, a.size, min(a.asize) AS up FROM anc a JOIN kept k ON k.z = a.z AND k.c = a.ac AND k.size = a.asize GROUP BY 1, 2, 3)"""


@query(f"WITH {TREE} SELECT k.z, round((k1+0.5::DOUBLE)/6, 9) AS value, k.size, x0, y0, x1, y1, CAST(sx AS BIGINT) AS sx, CAST(sy AS BIGINT) AS sy, p.up AS parent_size FROM kept k LEFT JOIN par p ON p.z = k.z AND p.c = k.c AND p.size = k.size")
def slice_extraction(spark, d):
    """Component trees of all sections, made of tiles and joined along their borders; slices with their parent's size."""
    s = extracted(spark, d).slices
    up = s.select(F.col("id").alias("parent"), F.col("z"), F.col("size").alias("parent_size"))
    return s.join(up.hint("merge"), ["parent", "z"], "left").select("z", F.round("value", 9).alias("value"), "size", "x0", "y0", "x1", "y1", "sx", "sy", "parent_size")


@query(f"""WITH {TREE}, leaf AS (SELECT * FROM kept k WHERE NOT EXISTS (SELECT 1 FROM anc a WHERE a.z = k.z AND a.ac = k.c AND a.asize = k.size)),
path AS (SELECT z, c, size, c AS ac, size AS asize FROM leaf UNION ALL SELECT l.z, l.c, l.size, a.ac, a.asize FROM leaf l JOIN anc a ON a.z = l.z AND a.c = l.c AND a.size = l.size)
SELECT p.z, l.x0, l.y0, p.size AS leaf_size, string_agg(CAST(p.asize AS VARCHAR), '>' ORDER BY p.asize DESC) AS path, count(*) AS n FROM path p JOIN kept k ON k.z = p.z AND k.c = p.ac AND k.size = p.asize JOIN leaf l ON l.z = p.z AND l.c = p.c AND l.size = p.size GROUP BY p.z, p.c, p.size, l.x0, l.y0""")
def extraction_cliques(spark, d):
    """Each leaf's path of extracted slices, by their sizes: the slices that exclude each other."""
    got = extracted(spark, d)
    s = got.slices.select("id", "size")
    at = got.slices.select(F.col("id").alias("clique"), "z", "x0", "y0", F.col("size").alias("leaf_size"))
    path = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "size"))), lambda r: r["size"].cast("string")), ">")
    return got.cliques.join(s.hint("merge"), "id").groupBy("clique").agg(path.alias("path"), F.count("*").alias("n")).join(at.hint("merge"), "clique").select("z", "x0", "y0", "leaf_size", "path", "n")


@query(f"WITH {TREE} SELECT k.z, l.y, count(*) AS pixels, CAST(sum(l.x) AS BIGINT) AS xs FROM kept k JOIN lab l ON l.z = k.z AND l.c = k.c AND l.k = k.k0 GROUP BY k.z, l.y")
def extraction_runs(spark, d):
    """SNK3, G7: the extracted slices' masks, by line."""
    n = F.col("x1") - F.col("x0")
    return extracted(spark, d).runs.groupBy("z", "y").agg(F.sum(n).alias("pixels"), F.sum(F.expr("(x0 + x1 - 1) * (x1 - x0) div 2")).alias("xs"))


@query()
def duplicate_removal(spark, d):
    """Near-duplicate slices merged until there are none; what is left is the intersection."""
    left, _ = masks.remove_duplicates(packed(spark, d))
    return left.groupBy("id").agg(F.sum(F.col("x1") - F.col("x0")).alias("sz"))


_NEAR = f"{S}, {CF}, edges AS (SELECT a_id AS a, b_id AS b FROM cf WHERE {LIKE} > 0.75 AND a_sz+b_sz-2*o < 200)"
#: of groups in which all are near-duplicates of the least (as here): the least, with the pixels that all have
ORACLE["duplicate_removal"] = CLOSURE.format(base=_NEAR) + """, lab AS (SELECT a AS id, min(b) AS c FROM r GROUP BY a), pix AS (SELECT id, z, y, unnest(range(x0,x1)) AS x FROM runs),
  n AS (SELECT c, count(*) AS n FROM lab GROUP BY 1), k AS (SELECT c, y, x, count(*) AS k FROM pix JOIN lab ON lab.id=pix.id GROUP BY 1, 2, 3)
  SELECT id, sz FROM slices WHERE id NOT IN (SELECT id FROM lab) UNION ALL SELECT k.c, count(*) FROM k JOIN n ON n.c=k.c WHERE k=n GROUP BY 1"""

# --- boxes, numbers, order, text and images of what is above ---


@query(W_GRID + "SELECT coalesce(min(bx)*64,0) AS min_x, coalesce((max(bx)+1)*64,0) AS max_x, coalesce(min(by)*16,0) AS min_y, coalesce((max(by)+1)*16,0) AS max_y, coalesce(min(bz)*10,0) AS min_z, coalesce((max(bz)+1)*10,0) AS max_z FROM (SELECT bx, by, bz FROM links GROUP BY 1, 2, 3 HAVING count(*) % 3 = 1)")
def block_bounds(spark, d):
    """A1: the box around the blocks that hold a number of slices with remainder 1 by 3."""
    g = the_grid(spark, d)
    some = grid.slice_blocks(sl(spark, d), g).groupBy("bx", "by", "bz").agg(F.count("*").alias("n")).where("n % 3 = 1")
    return grid.bounding_box(some.drop("n"), g)


@query(W_SEG + "SELECT type, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, min(greatest(isi-1,0)) AS z0, max(isi+1) AS z1 FROM mem JOIN seg USING (key) JOIN slices USING (id) GROUP BY type")
def segment_bounds(spark, d):
    """A2, A3: the box around the segments of each type."""
    b = SG.segment_boxes(segs(spark, d), sl(spark, d))
    z = F.greatest(F.col("isi") - 1, F.lit(0).cast("long"))
    return b.groupBy("type").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min(z).alias("z0"), F.max(F.col("isi") + 1).alias("z1"))


@query(W_GRID + "SELECT q.x, q.y, q.z, (bz*ey+by)*ex+bx AS block, CASE WHEN bx IS NULL THEN NULL ELSE (z//20*((ey+1)//2)+y//32)*((ex+1)//2)+x//128 END AS core FROM (SELECT CAST(l_suppkey*7 AS BIGINT) AS x, CAST(l_linenumber*9 AS BIGINT) AS y, CAST(l_orderkey%90 AS BIGINT) AS z FROM lineitem GROUP BY 1, 2, 3) q, ext LEFT JOIN blocks ON bx=q.x//64 AND by=q.y//16 AND bz=q.z//10")
def block_numbers(spark, d):
    """Number of the block and of the core at a place; none outside the volume."""
    g = the_grid(spark, d)
    big = grid.cores_grid(g)
    at = adapter.table(spark, d, "lineitem").select((F.col("l_suppkey") * 7).cast("long").alias("x"), (F.col("l_linenumber") * 9).cast("long").alias("y"), (F.col("l_orderkey") % 90).cast("long").alias("z")).distinct()
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    here = at.select("*", *grid.block_at(x, y, z, g))
    here = here.select("x", "y", "z", grid.valid(g).alias("ok"), grid.numbered(g).alias("block")).select("*", *grid.block_at(x, y, z, big))
    return here.select("x", "y", "z", F.when(F.col("ok"), F.col("block")).alias("block"), F.when(F.col("ok"), grid.numbered(big)).alias("core"))


@query(W_GRID + "SELECT (bz*ey+by)*ex+bx AS number, bx, by, bz FROM blocks, ext WHERE bx = 1 OR bz = 1 ORDER BY 1 LIMIT 3")
def first_blocks(spark, d):
    """The first three, in order, of the blocks that meet a condition."""
    g = the_grid(spark, d)
    return grid.all_blocks(spark, g).where("bx = 1 or bz = 1").select(grid.numbered(g).alias("number"), "bx", "by", "bz").orderBy("number").limit(3)


@query(f"WITH {S}, {VOL} SELECT part, (v*n+d-1)//d AS most FROM (SELECT '1/2' AS part, 1 AS n, 2 AS d UNION ALL SELECT '2/3', 2, 3 UNION ALL SELECT '7/5', 7, 5) f, (SELECT vx AS v FROM vol) q")
def grid_fractions(spark, d):
    """P33: "n/d" of the volume's width, rounded up."""
    width = the_grid(spark, d).volume[0]
    return spark.createDataFrame([(t, grid.ceil_of(width, *grid.fraction(t))) for t in ("1/2", "2/3", "7/5")], "part string, most long")


@query("SELECT id, CAST(CASE WHEN v<0 THEN v::HUGEINT+18446744073709551616 ELSE v END AS VARCHAR) AS as_unsigned, v AS as_signed FROM (SELECT o_orderkey AS id, (o_orderkey%1000-500)*18000000000000000 AS v FROM orders)")
def id_forms(spark, d):
    """Ids as unsigned numbers, and those as ids again."""
    v = adapter.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") % 1000 - 500) * 18_000_000_000_000_000).alias("v"))
    return v.select("id", unsigned("v").cast("string").alias("as_unsigned"), signed(unsigned("v")).alias("as_signed"))


@query(W_OV + f"""SELECT a_id, b_id, z, row_number() OVER (PARTITION BY z ORDER BY o DESC, d2, a_id, b_id) AS place FROM (SELECT ov.*, pow(CAST(a.sx AS DOUBLE)/a.sz-CAST(b.sx AS DOUBLE)/b.sz, 2)+pow(CAST(a.sy AS DOUBLE)/a.sz-CAST(b.sy AS DOUBLE)/b.sz, 2) AS d2
  FROM ov JOIN slices a ON a.id=a_id JOIN slices b ON b.id=b_id WHERE {LIKE} >= 0.5) q""")
def continuation_order(spark, d):
    """Continuations of a section by overlap, then by how near their centres are."""
    return SG.rank_continuations(SG.continuations(pairs(spark, d)), sl(spark, d)).select("a_id", "b_id", "z", F.col("place").cast("long").alias("place"))


@query(W_CF + ", near AS (SELECT id FROM slices WHERE x0<128 AND x1>64 AND y0<16 AND y1>0) SELECT id FROM near UNION SELECT b_id FROM cf JOIN near ON near.id=a_id UNION SELECT a_id FROM cf JOIN near ON near.id=b_id")
def region_growth(spark, d):
    """Slices that a block of every section needs whole, found in a region that grows until none touches its side; as many as the whole volume shows."""

    def inside(rect):
        cut = masks.clip(runs(spark, d), *rect)
        seen = masks.conflict_pairs(masks.tiles(cut, "sz"))
        return masks.measure(cut), seen.select(F.concat_ws("-", "a_id", "b_id").alias("clique"), F.explode(F.array("a_id", "b_id")).alias("id"))

    ids, _ = SG.grown_region(inside, (1, 0, 2, 1), the_grid(spark, d))
    return ids


@query(W_SEG + """, u AS (SELECT 'ask:'||id%101 AS row, 'E:'||id||':R' AS key FROM slices UNION ALL SELECT 'ask:'||id%101, 'X:'||id FROM slices WHERE id%707=0), n AS (SELECT key, row_number() OVER (ORDER BY type, isi, key)-1 AS number FROM seg)
SELECT u.row, n.number, 1 AS coef, '=' AS relation, 1 AS value FROM u JOIN n USING (key) WHERE u.row NOT IN (SELECT row FROM u WHERE key NOT IN (SELECT key FROM seg))""")
def consistency_constraints(spark, d):
    """M8: a user's rows over the variables' numbers; rows about a segment that isn't there are left out whole."""
    i = F.col("id")
    asked = F.array(F.concat(F.lit("E:"), i, F.lit(":R")), F.when(i % 707 == 0, F.concat(F.lit("X:"), i)))
    u = sl(spark, d).select(F.concat(F.lit("ask:"), i % 101).alias("row"), F.explode(F.array_compact(asked)).alias("key"), F.lit(1).alias("coef"), F.lit("=").alias("relation"), F.lit(1).alias("value"))
    return C.consistency_rows(u, C.variables(segs(spark, d)).select("key", "number"))


@query(f"WITH {S} SELECT id, z, z||'_'||id||'.png' AS name, sz, x0, y0, x1, y1, sx, sy FROM slices")
def slice_images(spark, d):
    """SNK3, SNK9: slices as images with their place, as the store keeps them and the export names them, read back to pixels."""
    flat = F.flatten(F.transform("lines", lambda t: F.array(t["y"], t["x0"], t["x1"]))).alias("lines")
    images = graph.settled(masks.bitmaps_of_lines(adapter.slices(spark, d, ("lines",), deal=True).select("id", "z", flat)))
    back = masks.measure(masks.runs_of_bitmaps(images)).withColumnRenamed("z", "bz")
    return images.select("id", "z", "name").join(back.drop("bz"), "id")


@query(W_CF + "SELECT 'slice' AS kind, id||' '||z||' '||x0||' '||x1||' '||y0||' '||y1||' '||printf('%.3f', (id%8)/8.0)||' '||printf('%.3f', round(CAST(sx AS DOUBLE)/sz,3))||' '||printf('%.3f', round(CAST(sy AS DOUBLE)/sz,3))||' '||sz AS line FROM slices UNION ALL SELECT 'conflict', a_id||' '||b_id FROM cf")
def slice_dump(spark, d):
    """SNK13, SNK8: slices, and the pairs in conflict, as text."""
    s = sl(spark, d)
    lines = labels.slice_lines(s, s.select("id", (F.col("id") % 8 / 8.0).alias("value"))).select(F.lit("slice").alias("kind"), "line")
    return lines.unionByName(labels.conflict_lines(conflicts(spark, d)).select(F.lit("conflict").alias("kind"), "line"))


_PRICE = "CASE type WHEN 0 THEN 2+(isi%3)/2.0 WHEN 1 THEN -3-isi%5 ELSE -4.25-isi%3 END"


@query(W_SEG + f""", {WIN}, num AS (SELECT key, row_number() OVER (ORDER BY type, isi, key)-1 AS number, {_PRICE} AS cost FROM seg), n AS (SELECT id, count(DISTINCT key) AS n FROM mem GROUP BY id), k AS (SELECT id, "window", count(DISTINCT m.key) AS k FROM mem m JOIN win ON win.key=m.key GROUP BY 1,2),
  held AS (SELECT k.id, "window" FROM k JOIN n ON n.id=k.id WHERE k=n), txt AS (SELECT id, '0.0 == '||count(*)||' '||string_agg(CASE WHEN is_left THEN '' ELSE '-' END||number, ' ' ORDER BY NOT is_left, number) AS line FROM mem JOIN num USING (key) GROUP BY id), ws AS (SELECT DISTINCT "window" FROM win)
SELECT CAST(-1 AS BIGINT) AS "window", 0 AS part, '' AS item, CAST(count(*) AS VARCHAR) AS line FROM ws UNION ALL SELECT "window", 1, '', CAST(count(*) AS VARCHAR) FROM win GROUP BY 1 UNION ALL SELECT "window", 2, lpad(CAST(number AS VARCHAR), 20, '0'), number||' '||printf('%.6f', cost) FROM win JOIN num USING (key)
  UNION ALL SELECT ws."window", 3, '', CAST(count(held.id) AS VARCHAR) FROM ws LEFT JOIN held ON held."window"=ws."window" GROUP BY 1 UNION ALL SELECT "window", 4, 'flow:'||id, line FROM held JOIN txt USING (id)""")
def subproblem_text(spark, d):
    """SNK12, M12: windows with their segments' costs and the constraints that fit them, as text."""
    s = C.with_numbers(priced(spark, d))
    rows = C.continuation_spans(s, number="number")
    text = labels.row_text("pos_number", "neg_number", F.lit("="), F.lit(0))
    held = C.spans_in_windows(graph.settled(rows.select("row", "first", "last", text.alias("text"))), 10, 3)
    return labels.window_lines(C.in_windows(s, 10, 3).select("window", "number", "cost"), held)


@query()
def out_of_bag(spark, d):
    """Each row's votes of trees that haven't seen it, and the variables' importance."""
    v = adapter.vectors(spark, d).select(F.col("vec_id").alias("id"), "features", (F.col("label") < 5).cast("int").alias("label"))
    votes = graph.settled(learned.out_of_bag(v))
    top = learned.importances(learned.train(v))
    rank = spark.createDataFrame([(max(range(len(top)), key=top.__getitem__), float(max(top)))], "variable long, importance double")
    return learned.out_of_bag_error(votes).crossJoin(rank)  # one row each


import re as _re  # noqa: E402

#: `by`, a block's place along y, is a word that SQL keeps for itself
ORACLE = {k: _re.sub(r'(?<!["\w])by(?!["\w])', '"by"', v) for k, v in ORACLE.items()}
