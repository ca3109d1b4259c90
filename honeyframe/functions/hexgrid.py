"""Hexagonal coordinates as column expressions.

Offset coordinates (q, r) use shifted odd rows; cube coordinates keep
x + y + z = 0. The home hexagon of radius n holds 3 n^2 pixels and tiles the
plane: -n <= x < n, -n < y <= n, -n <= z < n. Everything here is closed form,
so it stays inside whole-stage codegen and needs neither join nor lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The six neighbour steps in cube (x, z).
NEIGHBOURS = ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _half(r: Column) -> Column:
    return F.shiftright(r, 1)


def to_cube(q, r) -> Column:
    """struct(x, y, z) of an offset coordinate."""
    q, r = _c(q), _c(r)
    x = q - _half(r)
    return F.struct(x.alias("x"), (-x - r).alias("y"), r.alias("z"))


def from_cube(x, z) -> Column:
    """struct(q, r) of a cube coordinate."""
    x, z = _c(x), _c(z)
    return F.struct((x + _half(z)).alias("q"), z.alias("r"))


def with_cube(df: DataFrame, q: str, r: str, center: tuple[int, int] = (0, 0)) -> DataFrame:
    """Add x, y, z relative to the cube coordinate ``center`` = (x0, z0)."""
    x0, z0 = center
    q, r = _c(q), _c(r)
    return (
        df.withColumns({"x": q - _half(r) - x0, "z": r - z0})
        .withColumn("y", -F.col("x") - F.col("z"))
    )


def in_home(x, y, z, n: int) -> Column:
    x, y, z = _c(x), _c(y), _c(z)
    return (x >= -n) & (x < n) & (y > -n) & (y <= n) & (z >= -n) & (z < n)


def in_hexagon(q, r, center: tuple[int, int], n: int, full: bool = False) -> Column:
    """Half-open test, or the closed hexagon |x|+|y|+|z| <= 2n when ``full``."""
    q, r = _c(q), _c(r)
    q0, r0 = center
    x = q - _half(r) - (q0 - (r0 >> 1))
    z = r - r0
    y = -x - z
    if full:
        return (F.abs(x) + F.abs(y) + F.abs(z)) <= 2 * n
    return in_home(x, y, z, n)


def with_wrap(df: DataFrame, n: int, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Fold x, y, z into the home hexagon.

    The shift lattice is spanned by (2n,-n,-n) and (-n,-n,2n). Cut the plane
    into strips of width n along x, y and z: at home the strip numbers
    a = floor(x/n), b = ceil(y/n), c = floor(z/n) have a - b and c - b in
    -2..0, and a shift by a lattice vector changes exactly one of the two
    differences by 3. So the shift is read off by a division.
    """
    X, Z = F.col(x), F.col(z)
    b = F.floor((X + Z) / n)  # -ceil(y/n)
    i = F.floor((F.floor(X / n) + b + 2) / 3)
    j = F.floor((F.floor(Z / n) + b + 2) / 3)
    d = df.withColumns({"_wi": i, "_wj": j})
    d = d.withColumns(
        {
            x: X - 2 * n * F.col("_wi") + n * F.col("_wj"),
            z: Z + n * F.col("_wi") - 2 * n * F.col("_wj"),
        }
    )
    return d.withColumn(y, -F.col(x) - F.col(z)).drop("_wi", "_wj")


def fold(x, z, n: int):
    """``with_wrap`` of whole numbers or arrays of them."""
    b = (x + z) // n
    i, j = (x // n + b + 2) // 3, (z // n + b + 2) // 3
    return x - 2 * n * i + n * j, z + n * i - 2 * n * j


def home_places(n: int) -> list[tuple[int, int]]:
    """The pixels (x, z) of the home hexagon in the order of ``hex_index``."""
    return [(x, z) for x in range(-n, n) for z in range(-n, n) if -n <= x + z < n]


def hex_index(x, z, n: int) -> Column:
    """Dense number 0 .. 3n^2-1 of a home pixel, ordered by (x, z).

    Column x starts after n(3n-1)/2 + 2nx - |x|(x-1)/2 pixels, at z = -n for
    x >= 0 and at z = -n-x for x < 0. The result is declared not NULL: else a
    join on it would repeat the whole expression in an IS NOT NULL filter.
    """
    x, z = _c(x), _c(z)
    start = n * (3 * n - 1) // 2 + n + 2 * n * x - F.shiftright(F.abs(x) * (x - 1), 1)
    return F.coalesce((start + z + F.least(x, F.lit(0))).cast("long"), F.lit(-1).cast("long"))


def hex_distance(x, y, z) -> Column:
    x, y, z = _c(x), _c(y), _c(z)
    return F.shiftright(F.abs(x) + F.abs(y) + F.abs(z), 1)


def sq_distance(x, z) -> Column:
    """Squared Euclidean distance in units of the pixel pitch."""
    x, z = _c(x), _c(z)
    return x * x + z * z + x * z


def with_hex_round(df: DataFrame, p1: str, p2: str) -> DataFrame:
    """Nearest hexagon centre (q, r) of fractional cube coordinates.

    ``p1`` is the x and ``p2`` the z component. Round all three components,
    then repair the one with the largest rounding error.
    """
    a, b = F.col(p1), F.col(p2)
    d = df.withColumns(
        {"_rx": F.floor(a + 0.5), "_ry": F.floor(-a - b + 0.5), "_rz": F.floor(b + 0.5)}
    )
    ex = F.abs(F.col("_rx") - a)
    ey = F.abs(F.col("_ry") + a + b)
    ez = F.abs(F.col("_rz") - b)
    fix_x = (ex > ey) & (ex > ez)
    fix_z = ~fix_x & ~(ey > ez)
    d = d.withColumns(
        {
            "_hx": F.when(fix_x, -F.col("_ry") - F.col("_rz")).otherwise(F.col("_rx")),
            "_hz": F.when(fix_z, -F.col("_rx") - F.col("_ry")).otherwise(F.col("_rz")),
        }
    )
    return d.withColumns(
        {"q": F.col("_hx") + _half(F.col("_hz")), "r": F.col("_hz")}
    ).drop("_rx", "_ry", "_rz", "_hx", "_hz")


def lattice_points(n: int, bond: int) -> list[tuple[int, int]]:
    """Shifts (x, z) of the home hexagon that map the crystal onto itself."""
    if n % bond:
        raise ValueError("the bond length must divide the radius")
    k = n // bond
    out = []
    for i in range(-2 * k, 2 * k + 1):
        for j in range(-2 * k, 2 * k + 1):
            x, z = bond * (2 * i - j), bond * (2 * j - i)
            if -n <= x < n and -n < -x - z <= n and -n <= z < n:
                out.append((x, z))
    return sorted(out)


def _apply(rot: int, mirror: int, x: int, z: int) -> tuple[int, int]:
    """Rotate by 60 degree steps, then mirror."""
    for _ in range(rot):
        x, z = x + z, -x  # (x, y, z) -> (-y, -z, -x)
    return (x, -x - z) if mirror else (x, z)


def operation_table() -> list[tuple[int, ...]]:
    """The twelve point operations as integer matrices (a, b, c, d) on (x, z),
    rotation fastest, each followed by its inverse."""
    ops = []
    for mirror in (0, 1):
        for rot in range(6):
            a, c = _apply(rot, mirror, 1, 0)
            b, d = _apply(rot, mirror, 0, 1)
            det = a * d - b * c
            ops.append((a, b, c, d, d * det, -b * det, -c * det, a * det))
    return ops


def operation(rot, mirror) -> Column:
    """struct(a, b, c, d, ia, ib, ic, id) of the operation of a row."""
    names = ("a", "b", "c", "d", "ia", "ib", "ic", "id")
    table = F.array(
        *[F.struct(*[F.lit(v).alias(k) for k, v in zip(names, op)]) for op in operation_table()]
    )
    return F.get(table, F.pmod(_c(rot), F.lit(6)) + 6 * _c(mirror))


def symmetry_array(n: int, bond: int) -> Column:
    """The copies (sym, lx, lz, rot, mirror) as one constant array column, to
    be exploded: lattice shifts fastest, then rotations, then the mirror.

    Its length 12 (n/bond)^2 is set by the grid, never by the data.
    """
    points = lattice_points(n, bond)
    # the unshifted copy comes first
    points = sorted(points, key=lambda p: (p != (0, 0), p))
    k = len(points)
    pts = F.array(*[F.struct(F.lit(x).alias("lx"), F.lit(z).alias("lz")) for x, z in points])
    ids = F.sequence(F.lit(0), F.lit(12 * k - 1))

    def make(s: Column) -> Column:
        p = F.get(pts, s % k)
        return F.struct(
            s.alias("sym"), p["lx"].alias("lx"), p["lz"].alias("lz"),
            (F.floor(s / k) % 6).cast("int").alias("rot"), F.floor(s / (6 * k)).cast("int").alias("mirror"),
        )

    return F.transform(ids, make)


def with_transform(
    df: DataFrame, n: int, lx="lx", lz="lz", rot="rot", mirror="mirror",
    x: str = "x", z: str = "z", out: tuple[str, str] = ("tx", "tz"),
) -> DataFrame:
    """Shift by a lattice point, rotate, mirror, fold home: a linear map of the
    shifted coordinates."""
    tx, tz = out
    m = F.col("_op")
    d = df.withColumns({"_op": operation(rot, mirror), "_sx": F.col(x) + _c(lx), "_sz": F.col(z) + _c(lz)})
    d = d.withColumns(
        {
            tx: m["a"] * F.col("_sx") + m["b"] * F.col("_sz"),
            tz: m["c"] * F.col("_sx") + m["d"] * F.col("_sz"),
        }
    )
    return with_wrap(d, n, tx, "_ty", tz).drop("_op", "_sx", "_sz", "_ty")


def with_inverse_transform(
    df: DataFrame, n: int, lx="lx", lz="lz", rot="rot", mirror="mirror",
    x: str = "x", z: str = "z", out: tuple[str, str] = ("tx", "tz"),
) -> DataFrame:
    """Undo the point operation, shift back, fold home."""
    tx, tz = out
    m = F.col("_op")
    X, Z = F.col(x), F.col(z)
    d = df.withColumn("_op", operation(rot, mirror))
    d = d.withColumns(
        {"_ix": m["ia"] * X + m["ib"] * Z - _c(lx), "_iz": m["ic"] * X + m["id"] * Z - _c(lz)}
    )
    d = d.withColumns({tx: F.col("_ix"), tz: F.col("_iz")})
    return with_wrap(d, n, tx, "_ty", tz).drop("_op", "_ix", "_iz", "_ty")


def site_class(x, y, z, bond: int) -> Column:
    """Class on the irreducible wedge, from folded cube coordinates.

    m is the largest, k the smallest absolute component; classes of smaller m
    come first, and ring m holds 1 + m div 2 of them. The sum of those is
    closed form: m + floor((m-1)/2) * floor(m/2).
    """
    ax, ay, az = F.abs(_c(x)), F.abs(_c(y)), F.abs(_c(z))
    m, k = F.greatest(ax, ay, az), F.least(ax, ay, az)
    base = m + F.shiftright(m - 1, 1) * F.shiftright(m, 1)
    return F.when(m == 0, 0).otherwise(base + k).cast("long")


def site_number(x, y, z, bond: int) -> Column:
    """Full numbering of the unit cell: a walk along ring after ring.

    Turning by sixty degrees takes x to -z, that to y and so on, so the six
    signed coordinates in that order say all: a pixel lies on the first side
    whose coordinate is the ring's distance, and the next coordinate is the step
    along it. The outermost ring has no pixels of its own on some sides; there
    the second to fourth side count from one side and one pixel less.
    """
    x, y, z = _c(x), _c(y), _c(z)
    d = hex_distance(x, y, z)
    turned = [x, -z, y, -x, z, -y]
    walked = None
    for k, across in enumerate(turned):
        less = F.when(d == bond, d + 1).otherwise(0) if 1 <= k <= 3 else F.lit(0)
        place = k * d + turned[(k + 1) % 6] - less
        walked = F.when(across == d, place) if walked is None else walked.when(across == d, place)
    rings_inside = 1 + 3 * d * (d - 1)
    return F.when(d == 0, 0).otherwise(F.pmod(rings_inside + walked, F.lit(3 * bond * bond))).cast("long")
