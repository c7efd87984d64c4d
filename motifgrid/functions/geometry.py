"""Column expressions on angles and points; a point is a struct of x, y and z."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of a neighbourhood, and numbers of radial, azimuth and polar bins.
RADIUS, N_R, N_THETA, N_PHI = 15.0, 5, 10, 5
CLASSES = ("B", "L", "R", "X")
#: Place of a virtual C-beta in the frame of a residue's backbone.
VIRTUAL = (-0.58273431, 0.56802827, -0.54067466)


def point(x, y, z) -> Column:
    return F.struct(F.col(x).alias("x") if isinstance(x, str) else x.alias("x"), F.col(y).alias("y") if isinstance(y, str) else y.alias("y"), F.col(z).alias("z") if isinstance(z, str) else z.alias("z"))


def minus(a: Column, b: Column) -> Column:
    return F.struct(*[(a[k] - b[k]).alias(k) for k in "xyz"])


def scaled(a: Column, s: Column) -> Column:
    return F.struct(*[(a[k] * s).alias(k) for k in "xyz"])


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return F.struct(*[(a[p] * b[q] - a[q] * b[p]).alias(k) for k, p, q in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y"))])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def let(value: Column, body) -> Column:
    """body(value), with value computed once: expressions that use a point often would grow with each use."""
    return F.transform(F.array(value), body)[0]


def unit(a: Column) -> Column:
    """Null components for a vector without length."""
    return let(a, lambda v: let(F.try_divide(F.lit(1.0), norm(v)), lambda s: scaled(v, s)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(dot(minus(a, b), minus(a, b)) + 1e-10)


def structure_class(phi: Column, psi: Column) -> Column:
    """B, L or R by backbone angles; X for others and for missing ones."""
    pi = math.pi
    right = psi.between(-1.47, 0.63) & phi.between(-2.51, -0.42)
    left = psi.between(-0.84, 1.26) & phi.between(0.63, 2.51)
    strand = psi.between(0.63, 3.14) & phi.between(-pi, -0.42) | psi.between(-pi, -2.09) & phi.between(-pi, -0.84)
    return F.when(right, "R").when(left, "L").when(strand, "B").otherwise("X")


def edges() -> dict[str, list[float]]:
    """Inner and outer edges: shells of equal volume, equal azimuths, zones of equal area."""
    return {
        "r": [(RADIUS**3 * i / N_R) ** (1 / 3) for i in range(N_R + 1)],
        "theta": [2 * math.pi * i / N_THETA for i in range(N_THETA + 1)],
        "phi": [math.acos(1 - 2 * i / N_PHI) for i in range(N_PHI + 1)],
    }


def interval(x: Column, of: list[float]) -> Column:
    """Number of the interval (low, high] that holds x; what lies at or below the first edge is in the first."""
    held = F.array(*[F.lit(e) for e in of])
    return F.greatest(F.size(F.filter(held, lambda e: e < x)) - 1, F.lit(0))


def spherical(p: Column) -> Column:
    """r, theta in [0, 2 pi) and phi of a point; phi is null at the origin."""

    def parts(p):
        theta, r = F.atan2(p["y"], p["x"]), norm(p)
        return F.struct(r.alias("r"), F.when(theta < 0, theta + 2 * math.pi).otherwise(theta).alias("theta"), F.acos(F.try_divide(p["z"], r)).alias("phi"))

    return let(p, parts)


def in_frame(p: Column, ca: Column, cb: Column, n: Column) -> Column:
    """p in the frame with C-alpha at the origin, C-beta on +z, and N in the xz half-plane of x > 0."""

    def along(z, to_n, d):
        x = unit(minus(to_n, scaled(z, dot(to_n, z))))
        return let(x, lambda x: F.struct(dot(d, x).alias("x"), dot(d, cross(z, x)).alias("y"), dot(d, z).alias("z")))

    return let(unit(minus(cb, ca)), lambda z: let(minus(n, ca), lambda to_n: let(minus(p, ca), lambda d: along(z, to_n, d))))


def virtual_beta(n: Column, ca: Column, c: Column) -> Column:
    place = lambda a, b, d: F.struct(*[(VIRTUAL[0] * a[k] + VIRTUAL[1] * b[k] + VIRTUAL[2] * d[k] + ca[k]).alias(k) for k in "xyz"])
    return let(minus(ca, n), lambda b: let(minus(c, ca), lambda d: let(cross(b, d), lambda a: place(a, b, d))))


def dihedral(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Signed angle about b-c; null where three points are in line."""

    def angle(u, v, w):
        signed = lambda p, q: F.when((dot(p, p) > 0) & (dot(q, q) > 0), F.atan2(F.try_divide(dot(cross(p, q), v), norm(v)), dot(p, q)))
        return let(cross(u, v), lambda p: let(cross(v, w), lambda q: signed(p, q)))

    return let(minus(b, a), lambda u: let(minus(c, b), lambda v: let(minus(d, c), lambda w: angle(u, v, w))))


def angle_bin(angle: Column, n: int = 30) -> Column:
    return F.pmod(F.floor((angle + math.pi) / (2 * math.pi / n)), F.lit(n)).cast("int")


def torus_distance(phi1: Column, psi1: Column, phi2: Column, psi2: Column) -> Column:
    short = lambda d: F.least(d, 2 * math.pi - d)
    return F.hypot(short(F.abs(phi2 - phi1)), short(F.abs(psi2 - psi1)))


def bin_id(ss: Column, r: Column, t: Column, p: Column) -> Column:
    place = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), ss).cast("int") - 1
    return ((place * N_R + r) * N_THETA + t) * N_PHI + p
