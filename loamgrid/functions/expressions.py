"""Column expressions: allele counts, divergence, layer transforms, scaling.

Each takes and returns columns, so whole-stage code generation covers them.
Divisions by zero give null.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = ("A", "C", "G", "T")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(n, d) -> Column:
    """n / d as a double; null where d is 0 or null."""
    return col(n).cast("double") / F.nullif(col(d).cast("double"), F.lit(0.0))


def coverage(*bases) -> Column:
    return reduce(add, map(col, bases))


def major_base(*counts, names=BASES) -> Column:
    """Name of the first largest count; null without reads."""
    a = F.array(*map(col, counts))
    return F.when(coverage(*counts) > 0, F.element_at(F.array(*map(F.lit, names)), F.array_position(a, F.array_max(a)).cast("int")))


def major_count(*counts) -> Column:
    return F.greatest(*map(col, counts))


def major_frequency(x, d, missing=None) -> Column:
    """x / d, ``missing`` where there is no read."""
    return F.when(col(d) > 0, ratio(x, d)).otherwise(F.lit(missing))


def homozygosity(*counts) -> Column:
    """Chance that two reads drawn without replacement agree; null below two reads."""
    d = coverage(*counts)
    same = reduce(add, [col(c) * (col(c) - 1) for c in counts])
    return F.when(d >= 2, ratio(same, d * (d - 1)))


def read_pair_divergence(xs, ys, same: bool = False) -> Column:
    """1 - sum x y / (X Y) over bases; for a sample with itself a read isn't drawn twice."""
    x, y = coverage(*xs), coverage(*ys)
    if same:
        return 1 - ratio(reduce(add, [col(a) * (col(a) - 1) for a in xs]), x * (x - 1))
    return 1 - ratio(reduce(add, [col(a) * col(b) for a, b in zip(xs, ys)]), x * y)


def genotype_divergence(a: tuple, b: tuple) -> Column:
    """Expected difference of two samples' genotype probabilities (reference, heterozygous, alternative)."""
    (ar, ah, aa), (br, bh, ba) = [tuple(map(col, x)) for x in (a, b)]
    return ar * ba + aa * br + (ar * bh + ah * br + ah * bh + ah * ba + aa * bh) / 2


def snp_type(total, north, south, least: int) -> Column:
    """'small' below ``least`` reads, 'ns' where both groups vary, else 'other'."""
    varies = lambda p: (col(p) > 0) & (col(p) < 1)
    return F.when(col(total) < least, "small").when(varies(north) & varies(south), "ns").otherwise("other")


def logistic(x) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def linear_combination(columns, weights) -> Column:
    return reduce(add, [col(c) * F.lit(float(w)) for c, w in zip(columns, weights)])


def clamp(x, low, high) -> Column:
    return F.least(F.greatest(col(x), col(low)), col(high))


def entropy_term(p) -> Column:
    """-p ln p, 0 at p = 0."""
    return F.when(col(p) > 0, -col(p) * F.ln(col(p))).otherwise(0.0)


def years_from_divergence(pi, mutation_rate: float = 2.064406e-8) -> Column:
    """Divergence to years: two lineages collect mutations."""
    return col(pi) / mutation_rate / 2


def generations(years, length: float = 25.0) -> Column:
    return col(years) / length


def corrected_heterozygosity(x, error) -> Column:
    """Observed heterozygosity freed of a symmetric base error."""
    e = col(error)
    return 2 * (col(x) - 2 * e * (1 - e)) / ((1 - e) * (1 - e) + e * e)


def equal_bin(x, width, origin=0) -> Column:
    """Left-closed bin number of fixed width."""
    return F.floor((col(x) - origin) / width).cast("long")


def right_closed_bin(x, breaks) -> Column:
    """Index i of the bin (breaks[i-1], breaks[i]]; null outside."""
    out = F.lit(None).cast("int")
    for i in range(len(breaks) - 1, 0, -1):
        out = F.when((col(x) > breaks[i - 1]) & (col(x) <= breaks[i]), i).otherwise(out)
    return out


def distance(x1, y1, x2, y2) -> Column:
    dx, dy = col(x1) - col(x2), col(y1) - col(y2)
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def pack_site(scaffold, pos, span: int = 10_000_000) -> Column:
    return col(scaffold).cast("long") * span + col(pos)


def fuzz(x, eps: float, seed: int, *keys) -> Column:
    """Multiply by a log-normal factor drawn by the hash of the keys."""
    u, v = hash_uniform(*keys, seed=seed), hash_uniform(*keys, seed=seed + 1)
    return col(x) * F.exp(F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v) * eps)


def hash_uniform(*columns, seed: int = 0) -> Column:
    """Uniform in [0, 1) from the hash of the columns: a draw that a retried task repeats."""
    return F.conv(F.substring(hash_text(*columns, seed=seed), 1, 8), 16, 10).cast("double") / float(1 << 32)


def hash_text(*columns, seed: int = 0) -> Column:
    """A hash of the columns that any SQL engine can repeat."""
    return F.md5(F.concat_ws("-", *(col(c).cast("string") for c in columns), F.lit(str(seed))).cast("binary"))
