"""Scalar numbers, vectors and hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """M1: 0 where lengths differ or a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | (norms <= 0), 0.0).otherwise(dot(a, b) / norms)


def hamming_hex(a: Column, b: Column) -> Column:
    """M2: differing bits of two hex strings of up to 16 digits (compared from the right); null if either isn't one."""
    ok = lambda c: c.rlike(r"^[0-9A-Fa-f]{1,16}$")

    def half(c: Column, part: int) -> Column:
        full = F.lpad(c, 16, "0")
        return F.conv(F.substring(full, 1 + 8 * part, 8), 16, 10).cast("bigint")

    bits = F.bit_count(half(a, 0).bitwiseXOR(half(b, 0))) + F.bit_count(half(a, 1).bitwiseXOR(half(b, 1)))
    return F.when(ok(a) & ok(b), bits)


def average_hash(luma: Column) -> Column:
    """M3: bit string of an array of gray values, 1 where at least their mean, as hex."""
    mean = F.aggregate(luma, F.lit(0.0), lambda s, x: s + x) / F.size(luma)
    bits = F.array_join(F.transform(luma, lambda x: F.when(x >= mean, "1").otherwise("0")), "")
    wide = F.lpad(bits, 64, "0")
    digits = F.concat(*[F.lpad(F.lower(F.conv(F.substring(wide, 1 + 32 * k, 32), 2, 16)), 8, "0") for k in range(2)])
    return F.substring(digits, 17 - F.ceil(F.size(luma) / 4).cast("int"), F.ceil(F.size(luma) / 4).cast("int"))


def structural_similarity(a: Column, b: Column) -> Column:
    """M4: one-window SSIM of two arrays of gray values, within 0..1; null if lengths differ."""
    n = F.size(a)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    ma, mb = total(a) / n, total(b) / n
    va, vb = total(F.transform(a, lambda x: (x - ma) * (x - ma))) / n, total(F.transform(b, lambda x: (x - mb) * (x - mb))) / n
    cov = total(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb))) / n
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    s = ((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    return F.when((n == F.size(b)) & (n > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))


def gray_grid(rgb: Column, width: Column, height: Column, grid: int = 8) -> Column:
    """M5: gray values of a grid's cell centres in raw RGB bytes."""
    def at(i: Column) -> Column:
        y = F.least(height - 1, F.floor((F.floor(i / grid) + 0.5) * height / grid).cast("int"))
        x = F.least(width - 1, F.floor((i % grid + 0.5) * width / grid).cast("int"))
        byte = lambda k: F.conv(F.hex(F.substring(rgb, (3 * (y * width + x) + k + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.floor((byte(0) * 299 + byte(1) * 587 + byte(2) * 114) / 1000).cast("int")

    return F.transform(F.sequence(F.lit(0), F.lit(grid * grid - 1)), at)


def hash_similarity(a: Column, b: Column) -> Column:
    """M6: share of equal bits of two hex hashes."""
    return F.greatest(F.lit(0.0), 1 - hamming_hex(a, b) / F.greatest(F.lit(1), F.length(a) * 4))


def clip_region(left: Column, top: Column, right: Column, bottom: Column, screen: tuple[int, int, int, int]) -> Column:
    """M7: a window's rectangle inside the screen's; the whole screen if nothing of it is inside."""
    x0, y0, x1, y1 = screen
    l, t, r, b = F.greatest(left, F.lit(x0)), F.greatest(top, F.lit(y0)), F.least(right, F.lit(x1)), F.least(bottom, F.lit(y1))
    inside = (r > l) & (b > t)
    return F.struct(*[F.when(inside, v).otherwise(w).alias(n) for n, v, w in (("left", l, x0), ("top", t, y0), ("right", r, x1), ("bottom", b, y1))])


def token_estimate(chars: Column) -> Column:
    """M8: a quarter of the characters, rounded up; null for none."""
    return F.when(chars > 0, F.floor((chars + 3) / 4).cast("bigint"))


def unit_clamp(c: Column, default: float = 0.0) -> Column:
    """M9: as a number in 0..1; the default if it isn't one."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.try_cast("double"), F.lit(default))))
