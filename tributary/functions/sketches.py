"""Functions of finished sketches: distinct counts, membership, frequent items, quantiles, frequencies, buckets.

Layouts: a distinct-count sketch is the binary that Spark's HLL functions share; a Bloom filter is an array of
(k: number of a block of 32768 bits, v: its bitmap) with its parameters kept by the caller; a count-min sketch
is an array of (k: cell, v: count); a distribution is a struct (sketch, low, high, n); top-k is an array of
(item, count).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HLL_LG = 14
BLOOM_P, BLOOM_N = 0.02, 32768
CMS_EPS, CMS_P = 0.002, 0.995
BLOCK_BITS = 32768


def expr(x) -> Column:
    """A column: SQL text is parsed, other plain values are literals."""
    return x if isinstance(x, Column) else F.expr(x) if isinstance(x, str) else F.lit(x)


# distinct counts


def hll_item(x: Column) -> Column:
    """What goes into a distinct-count sketch: the value's hash, null for null. An int and an equal long differ."""
    return F.when(x.isNotNull(), F.xxhash64(x))


def hll_cardinality(sketch) -> Column:
    """The estimate of a sketch; 0 for null."""
    s = expr(sketch)
    return F.coalesce(F.hll_sketch_estimate(s), F.lit(0)).cast("long")


def hll_union(*sketches) -> Column:
    out = expr(sketches[0])
    for s in sketches[1:]:
        s = expr(s)
        out = F.when(out.isNull(), s).when(s.isNull(), out).otherwise(F.hll_union(out, s))
    return out


# Bloom filters


def bloom_shape(p: float = BLOOM_P, n: int = BLOOM_N) -> tuple[int, int]:
    """Bits and hash functions for n values at a false-positive rate of p."""
    if not 0 < p < 1 or n < 1:
        raise ValueError("p must lie between 0 and 1, and n must be positive")
    m = math.ceil(-n * math.log(p) / math.log(2) ** 2)
    return m, max(1, round(math.log(2) * m / n))


def hashed_positions(x: Column, m: int, k: int) -> list[Column]:
    """k places below m by double hashing; remainders are taken first, so that nothing overflows."""
    a, b = F.pmod(F.xxhash64(x), F.lit(m)), F.pmod(F.xxhash64(F.lit(1), x), F.lit(m))
    return [F.pmod(a + F.lit(i) * b, F.lit(m)) for i in range(k)]


def bloom_layout(p: float = BLOOM_P, n: int = BLOOM_N) -> tuple[int, int, int]:
    """Blocks, bits of a block that are used, and hash functions. All bits of a value are in one block."""
    m, k = bloom_shape(p, n)
    blocks = math.ceil(m / BLOCK_BITS)
    return blocks, math.ceil(m / blocks), k


def bloom_block(x: Column, p: float = BLOOM_P, n: int = BLOOM_N) -> Column:
    """The number of the block that a value is in."""
    return F.pmod(F.xxhash64(F.lit(2), x), F.lit(bloom_layout(p, n)[0])).cast("long")


def bloom_hit(block: Column, x: Column, p: float = BLOOM_P, n: int = BLOOM_N) -> Column:
    """Whether the bits of x are set in the bitmap of its block. False for a null bitmap or value."""
    _, width, k = bloom_layout(p, n)
    hit = block.isNotNull() & x.isNotNull()
    for at in hashed_positions(x, width, k):
        byte = F.conv(F.hex(F.substring(block, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        hit = hit & (F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8)))), F.lit(2)) == 1)
    return F.coalesce(hit, F.lit(False))


def bloom_contains(bloom, x, p: float = BLOOM_P, n: int = BLOOM_N) -> Column:
    """Whether the filter may hold x: false only if it was never added. False for a null filter or value.

    This looks through the whole filter for each row; for many rows, join the filter's blocks by bloom_block and ask bloom_hit.
    """
    x = expr(x)
    return bloom_hit(F.try_element_at(F.map_from_entries(expr(bloom)), bloom_block(x, p, n)), x, p, n)


def bloom_bits(bloom) -> Column:
    return F.aggregate(F.transform(expr(bloom), lambda e: F.bitmap_count(e["v"])), F.lit(0).cast("long"), lambda a, x: a + x)


def bloom_cardinality(bloom, p: float = BLOOM_P, n: int = BLOOM_N) -> Column:
    """About how many different values were added: -m ln(1 - bits / m) / k; 0 for null."""
    blocks, width, k = bloom_layout(p, n)
    m = blocks * width
    bits = bloom_bits(bloom).cast("double")
    estimate = F.round(-float(m) * F.log(1 - F.least(bits, F.lit(float(m - 1))) / m) / k)
    return F.coalesce(F.when(bits.isNotNull(), estimate), F.lit(0.0)).cast("long")


# frequent items


def topk_values(top) -> Column:
    return F.transform(expr(top), lambda e: e["item"])


def topk_freqs(top) -> Column:
    return F.transform(expr(top), lambda e: e["count"])


# distributions


def dist_quantile(dist, q: float) -> Column:
    """The q-quantile; 0 and 1 give the exact least and greatest value; null for null or an empty distribution."""
    if not 0 <= q <= 1:
        raise ValueError("a quantile lies between 0 and 1")
    d = expr(dist)
    inner = d["low"] if q == 0 else d["high"] if q == 1 else F.call_function("kll_sketch_get_quantile_double", d["sketch"], F.lit(float(q)))
    return F.when(d["n"] > 0, inner)


def dist_cdf(dist, x) -> Column:
    """The share of values up to x, a constant."""
    d, x = expr(dist), expr(x).cast("double")
    return F.when(d["n"] > 0, F.when(x < d["low"], 0.0).when(x >= d["high"], 1.0).otherwise(F.call_function("kll_sketch_get_rank_double", d["sketch"], x)))


# frequencies


def cms_shape(eps: float = CMS_EPS, p: float = CMS_P) -> tuple[int, int]:
    """Rows and cells a row for an error of eps times the total with probability p."""
    if not 0 < eps < 1 or not 0 < p < 1:
        raise ValueError("eps and p must lie between 0 and 1")
    return max(1, math.ceil(math.log(1 / (1 - p)))), math.ceil(math.e / eps)


def cms_cells(x: Column, eps: float, p: float) -> list[Column]:
    d, w = cms_shape(eps, p)
    return [pos + F.lit(i * w).cast("long") for i, pos in enumerate(hashed_positions(x, w, d))]


def freq(sketch, x, eps: float = CMS_EPS, p: float = CMS_P) -> Column:
    """How often x was added, or somewhat more; 0 for null.

    This looks through the whole sketch for each row; for many rows, join its cells by cms_cells and take the least count.
    """
    s, x = expr(sketch), expr(x)
    cells = F.map_from_entries(s)
    found = [F.coalesce(F.try_element_at(cells, c), F.lit(0)) for c in cms_cells(x, eps, p)]
    return F.coalesce(F.when(x.isNotNull(), F.least(*found) if len(found) > 1 else found[0]), F.lit(0)).cast("long")


def freq_total(sketch, eps: float = CMS_EPS, p: float = CMS_P) -> Column:
    """How many values were added, those of one row of cells."""
    _, w = cms_shape(eps, p)
    return F.coalesce(F.aggregate(F.filter(expr(sketch), lambda e: e["k"] < w), F.lit(0).cast("long"), lambda a, e: a + e["v"]), F.lit(0)).cast("long")


def freq_norm(sketch, x, eps: float = CMS_EPS, p: float = CMS_P) -> Column:
    total = freq_total(sketch, eps, p)
    return F.when(total > 0, freq(sketch, x, eps, p) / total).otherwise(0.0)


# buckets


def bucket_ids(buckets) -> Column:
    """The sets that hold an element, ascending."""
    return F.array_sort(F.array_distinct(F.transform(expr(buckets), lambda e: e["v"]["set_id"])))


def bucket_cardinality(buckets, set_id) -> Column:
    return F.coalesce(F.size(F.filter(expr(buckets), lambda e: e["v"]["set_id"] == expr(set_id))), F.lit(0)).cast("long")


def bucket_cardinalities(buckets) -> Column:
    """Elements of each set, in the order of bucket_ids."""
    b = expr(buckets)
    return F.transform(bucket_ids(b), lambda i: F.size(F.filter(b, lambda e: e["v"]["set_id"] == i)).cast("long"))
