"""Scalar functions as Column expressions; all of them stay inside generated code."""

from pyspark.sql import Column, functions as F

from trailmark.schema import BLOOM_BITS, GRID


def _long(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)).cast("long")


def _normalise(degrees, half: float) -> Column:
    d = F.col(degrees) if isinstance(degrees, str) else degrees
    cell = F.floor((d + half) * F.lit(GRID / (2 * half))).cast("int")
    return F.when(d >= half, GRID - 1).when(d <= -half, 0).otherwise(cell)


def norm_lon(degrees) -> Column:
    """Longitude in degrees to the 24-bit grid, clamped at both ends."""
    return _normalise(degrees, 180.0)


def norm_lat(degrees) -> Column:
    """Latitude in degrees to the 24-bit grid, clamped at both ends."""
    return _normalise(degrees, 90.0)


def to_epoch(text) -> Column:
    """Date-time text (year-month-day hour:minute:second) to epoch seconds in UTC, whatever the session's time zone; text that
    cannot be read gives null."""
    t = (F.col(text) if isinstance(text, str) else text).try_cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), t).cast("int")


def _spread(value: Column, gap: int, bits: int) -> Column:
    """Moves bit i of a value to bit i * gap, by halving the runs of bits that stay together."""
    run = 1 << (bits - 1).bit_length()
    value = value.bitwiseAND(F.lit((1 << bits) - 1))
    while run > 1:
        run //= 2
        keep = sum(1 << (i * gap - i % run * (gap - 1)) for i in range(bits))
        value = value.bitwiseOR(F.shiftleft(value, run * (gap - 1))).bitwiseAND(F.lit(keep).cast("long"))
    return value


def z2(x, y) -> Column:
    """Two-dimensional Z-order value of 31-bit inputs; x takes the even bits."""
    return _spread(_long(x), 2, 31).bitwiseOR(F.shiftleft(_spread(_long(y), 2, 31), 1))


def z3(x, y, t) -> Column:
    """Three-dimensional Z-order value of the low 21 bits of each input; t takes bit 0, y bit 1, x bit 2."""
    one, two = F.shiftleft(_spread(_long(y), 3, 21), 1), F.shiftleft(_spread(_long(x), 3, 21), 2)
    return _spread(_long(t), 3, 21).bitwiseOR(one).bitwiseOR(two)


def dist2(x1, y1, x2, y2) -> Column:
    """Squared planar distance of two grid points."""
    dx, dy = _long(x1) - _long(x2), _long(y1) - _long(y2)
    return dx * dx + dy * dy


def _gap(v, low, high) -> Column:
    return F.greatest(_long(low) - _long(v), F.lit(0).cast("long"), _long(v) - _long(high))


def min_dist2(x, y, box: dict) -> Column:
    """Squared distance from a point to the nearest place of a box."""
    dx, dy = _gap(x, box["lon_min"], box["lon_max"]), _gap(y, box["lat_min"], box["lat_max"])
    return dx * dx + dy * dy


def max_dist2(x, y, box: dict) -> Column:
    """Squared distance from a point to the farthest corner of a box."""
    far = lambda v, lo, hi: F.greatest(F.abs(_long(v) - _long(lo)), F.abs(_long(v) - _long(hi)))
    dx, dy = far(x, box["lon_min"], box["lon_max"]), far(y, box["lat_min"], box["lat_max"])
    return dx * dx + dy * dy


def minmax_dist2(x, y, box: dict) -> Column:
    """Squared distance within which a minimal box is sure to hold a point: over the axes, the nearer face of
    one and the farther corner of the other."""
    def sides(v, low, high):
        v, low, high = _long(v), _long(low), _long(high)
        mid = F.floor((low + high) / 2)
        near = v - F.when(v <= mid, low).otherwise(high)
        far = v - F.when(v >= mid, low).otherwise(high)
        return near * near, far * far

    near_x, far_x = sides(x, box["lon_min"], box["lon_max"])
    near_y, far_y = sides(y, box["lat_min"], box["lat_max"])
    return F.least(near_x + far_y, near_y + far_x)


# Start and multiplier of the two string hashes that set the Bloom bits.
HASHES = ((5381, 33), (0, 65599))


def _bloom_positions(oid) -> list[Column]:
    v = _long(oid)
    octets = [F.shiftright(v, 8 * i).bitwiseAND(F.lit(255)) for i in range(4)]
    out = []
    for start, base in HASHES:
        h = F.lit(start % BLOOM_BITS).cast("long")
        for b in octets:
            h = (h * F.lit(base % BLOOM_BITS) + b) % BLOOM_BITS
        out.append(h)
    return out


def bloom_bits(oid) -> tuple[Column, Column]:
    """The low and the high 64 bits that an object id sets in a segment's Bloom filter."""
    def half(base: int) -> Column:
        one = F.lit(1).cast("long")
        bit = lambda p: F.when((p >= base) & (p < base + 64), F.call_function("shiftleft", one, (p - base).cast("int"))).otherwise(F.lit(0).cast("long"))
        a, b = (bit(p) for p in _bloom_positions(oid))
        return a.bitwiseOR(b)

    return half(0), half(64)


def bloom_may_contain(low, high, oid) -> Column:
    """False only if the filter shows that the object id is absent."""
    a, b = bloom_bits(oid)
    return (_long(low).bitwiseAND(a) == a) & (_long(high).bitwiseAND(b) == b)
