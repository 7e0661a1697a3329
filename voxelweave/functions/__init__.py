"""Column functions: boxes, overlaps, likeness, features, costs, keys.  All stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- boxes; the upper bound is exclusive ---


def intersects(a: str, b: str) -> Column:
    """2-D boxes of the aliases a and b overlap."""
    return (F.col(f"{a}.x0") < F.col(f"{b}.x1")) & (F.col(f"{b}.x0") < F.col(f"{a}.x1")) & (F.col(f"{a}.y0") < F.col(f"{b}.y1")) & (F.col(f"{b}.y0") < F.col(f"{a}.y1"))


def overlap(a: str, b: str, dx: Column | int = 0, dy: Column | int = 0) -> Column:
    """Pixels that boxes a and b share, b shifted by (dx, dy)."""
    side = lambda lo, hi, d: F.greatest(F.least(F.col(f"{a}.{hi}"), F.col(f"{b}.{hi}") + d) - F.greatest(F.col(f"{a}.{lo}"), F.col(f"{b}.{lo}") + d), F.lit(0).cast("long"))
    return side("x0", "x1", dx) * side("y0", "y1", dy)


def likeness(o, *sizes) -> Column:
    """o / (sum of sizes - o); where that isn't positive the divisor is 1."""
    total = sum((col(s) for s in sizes[1:]), col(sizes[0]))
    return col(o).cast("double") / F.greatest(total - col(o), F.lit(1)).cast("double")


def div(a: Column, n: int) -> Column:
    """Integer division of numbers from 0 up."""
    return F.floor(a / F.lit(n)).cast("long")


def ceil_div(a: Column, n: int) -> Column:
    return div(a + (n - 1), n)


# --- vectors ---


def dot(a, b) -> Column:
    """Sum of products; vectors of different length are an error, as a cost without its weights would be wrong."""
    a, b = col(a), col(b)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.raise_error(F.lit("features and weights differ in length")).cast("double"))


def bin_of(v, bins: int = 10) -> Column:
    """Bin of a value in [0, 1]; 1 is in the last."""
    return F.least(F.lit(bins - 1), F.floor(col(v) * bins)).cast("int")


def counts(bins_column, bins: int = 10) -> list[Column]:
    return [F.sum(F.when(col(bins_column) == k, 1).otherwise(0)).cast("long").alias(f"h{k}") for k in range(bins)]


def normalised(h: Column) -> Column:
    """Histogram (array) over its sum; an empty one stays 0."""
    total = F.greatest(F.aggregate(h, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(1).cast("long"))
    return F.transform(h, lambda x: x.cast("double") / total.cast("double"))


def abs_difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


# --- segments ---

#: fixed values: codes and names of segment types
TYPES = {0: "end", 1: "continuation", 2: "branch"}


def segment_type(left, right) -> Column:
    """From the number of slices on each side: none on one is an end, one and one a continuation, else a branch."""
    n, m = F.size(col(left)), F.size(col(right))
    return F.when((n == 0) | (m == 0), 0).when((n == 1) & (m == 1), 1).otherwise(2)


def type_name(t) -> Column:
    out = F.lit("unknown")
    for k, v in TYPES.items():
        out = F.when(col(t) == k, v).otherwise(out)
    return out


def one_hot(t) -> list[Column]:
    return [(col(t) == k).cast("int").alias(f"is_{v}") for k, v in TYPES.items()]


def isi(section, left_facing) -> Column:
    """Interval of a source slice: its own section's when it looks left, else the next."""
    return col(section) + F.when(col(left_facing), 0).otherwise(1)


def slice_hash(component_key, section) -> Column:
    return F.xxhash64(col(component_key), col(section))


def segment_hash(ids, direction=None) -> Column:
    """Of the sorted slice ids; an end also of its direction."""
    s = F.array_sort(col(ids))
    return F.xxhash64(s) if direction is None else F.when(F.size(s) == 1, F.xxhash64(s, col(direction))).otherwise(F.xxhash64(s))


def unsigned(i) -> Column:
    """A 64-bit id as the unsigned number of the same bits."""
    return F.when(col(i) < 0, col(i).cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(col(i).cast("decimal(20,0)"))


def signed(u) -> Column:
    """An unsigned number as the 64-bit id of the same bits."""
    u = col(u).cast("decimal(20,0)")
    return F.when(u >= F.lit("9223372036854775808").cast("decimal(20,0)"), u - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(u).cast("long")


def key_of(ids) -> Column:
    """The same as text, for results that other engines read."""
    return F.array_join(F.transform(F.array_sort(col(ids)), lambda x: x.cast("string")), "-")


# --- costs ---


def neglog(p, t, least: float = 0.05, floor: float = 1e-10) -> Column:
    """-ln of a probability; continuations and branches under `least` cost infinity, ends never."""
    c = -F.log(F.greatest(F.lit(floor), col(p)))
    import math

    return F.when((col(t) != 0) & (c >= -math.log(least)), F.lit(float("inf"))).otherwise(c)


def posterior(membrane, prior: float = 0.5, invert: bool = False) -> Column:
    """Cost of one pixel as foreground: -ln pN + ln pM, clamped to [1e-4, 1 - 1e-4].

    Membrane is normalised first, and the foreground with the membrane so normalised, as the data model has it.
    """
    m = 1.0 - col(membrane) if invert else col(membrane)
    fg, bg = (1.0 - m) * prior, m * (1.0 - prior)
    pm = bg / (bg + fg)
    pn = fg / (fg + pm)
    clamp = lambda x: F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), x))
    return F.log(clamp(pm)) - F.log(clamp(pn))
