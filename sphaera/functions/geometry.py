"""Orientation and optics as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Quaternion = Sequence[Column]
Vector = Sequence[Column]
TWO_PI = 2 * math.pi


def wrap_degrees(radians: Column) -> Column:
    """Radians to degrees in [0, 360)."""
    return F.pmod(radians, F.lit(TWO_PI)) * F.lit(180 / math.pi)


def half_turns(phi: Column, theta: Column, psi: Column, flip: bool = True) -> tuple[Quaternion, Quaternion, Quaternion]:
    """The three half-angle quaternions of a ZYZ rotation, angles in radians."""
    zero = F.lit(0.0)
    sign = -1.0 if flip else 1.0
    return (F.cos(phi / 2), zero, zero, -F.sin(phi / 2)), (F.cos(theta / 2), zero, -F.sin(theta / 2), zero), (F.cos(psi / 2), zero, zero, F.sin(psi / 2) * F.lit(sign))


def multiply(q: Quaternion, s: Quaternion) -> tuple[Column, Column, Column, Column]:
    """Hamilton product."""
    a, b, c, d = q
    e, f, g, h = s
    return a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e


def euler_to_quaternion(phi: Column, theta: Column, psi: Column, flip: bool = True) -> tuple[Column, Column, Column, Column]:
    z, y, zs = half_turns(phi, theta, psi, flip)
    return multiply(zs, multiply(y, z))


def with_conjugates(df: DataFrame, n: int | Column, id_col: str = "img_id", quaternion: Sequence[str] = ("q0", "q1", "q2", "q3")) -> DataFrame:
    """Originals and their mirrored twins; a twin's id is n more and its direction the antipode."""
    a, b, c, d = quaternion
    twin = {id_col: F.col(id_col) + n, a: -F.col(b), b: F.col(a), c: -F.col(d), d: F.col(c)}
    return df.withColumn("conj", F.lit(False)).unionByName(df.select(*(twin.get(x, F.col(x)).alias(x) for x in df.columns), F.lit(True).alias("conj")))


def direction(q: Quaternion) -> tuple[Column, Column, Column]:
    """Unit viewing direction of a unit quaternion."""
    a, b, c, d = q
    return 2 * (b * d - a * c), 2 * (a * b + c * d), 2 * (a * a + d * d - 0.5)


def quaternion_to_euler(q: Quaternion) -> tuple[Column, Column, Column]:
    """(phi, theta, psi) in radians: the closed form of the ZYZ fit; two angles are free where theta is 0 or pi."""
    a, b, c, d = q
    first, second = F.atan2(-d, a), F.atan2(b, -c)
    return first + second, 2 * F.atan2(F.sqrt(b * b + c * c), F.sqrt(a * a + d * d)), first - second


def direction_quaternion(v: Vector) -> tuple[Column, Column, Column, Column]:
    """The rotation (1+z, y, -x, 0), normalised, that carries the pole to v."""
    x, y, z = v
    n = F.sqrt((1 + z) * (1 + z) + y * y + x * x)
    return (1 + z) / n, y / n, -x / n, F.lit(0.0)


def direction_to_euler(v: Vector) -> tuple[Column, Column, Column]:
    return quaternion_to_euler(direction_quaternion(v))


def in_plane(q: Quaternion, v: Vector) -> Column:
    """In-plane rotation of q against the mean direction v; 0 where it is undefined."""
    a, b, c, d = q
    x, y, z = v
    s, co = -(1 + z) * d - x * b - y * c, (1 + z) * a + y * b - x * c
    return F.coalesce(2 * F.atan(F.try_divide(s, co)), F.when(s == 0, 0.0).otherwise(F.signum(s) * math.pi))


def to_spherical(v: Vector) -> tuple[Column, Column, Column]:
    """(r, phi, theta), angles in degrees."""
    x, y, z = v
    r = F.sqrt(x * x + y * y + z * z)
    return r, F.degrees(F.atan2(y, x)), F.degrees(F.acos(z / r))


def from_spherical(phi: Column, theta: Column, radius: float = 10.0) -> tuple[Column, Column, Column]:
    """Angles in degrees to a point of the sphere of that radius."""
    p, t = F.radians(phi), F.radians(theta)
    return radius * F.sin(t) * F.cos(p), radius * F.sin(t) * F.sin(p), radius * F.cos(t)


def rotation_matrix(phi: Column, theta: Column, psi: Column) -> list[Column]:
    """ZYZ rotation matrix, row by row, angles in radians."""
    cf, sf, ct, st, cp, sp = F.cos(phi), F.sin(phi), F.cos(theta), F.sin(theta), F.cos(psi), F.sin(psi)
    return [cp * ct * cf - sp * sf, cp * ct * sf + sp * cf, -cp * st, -sp * ct * cf - cp * sf, -sp * ct * sf + cp * cf, sp * st, st * cf, st * sf, ct]


def wavelength(kilovolts: float) -> float:
    """Electron wavelength in Angstrom."""
    return 12.3986 / math.sqrt((2 * 511.0 + kilovolts) * kilovolts)


def contrast_transfer(k: Column, defocus: Column, cs: float, kilovolts: float, envelope: float, amplitude: float) -> Column:
    """CTF at spatial frequency k (1/A) for a defocus in A; cs in mm, Gaussian envelope of half width `envelope`."""
    w = wavelength(kilovolts)
    sigma = envelope / math.sqrt(2 * math.log(2))
    k2 = k * k
    gamma = (0.5 * math.pi * cs * 1e7 * w**3 * k2 - math.pi * w * defocus) * k2
    return (F.sin(gamma) - amplitude * F.cos(gamma)) * F.exp(-k2 / (2 * sigma**2))


def frequency(x: Column, y: Column, n: int) -> Column:
    """Radial frequency of a centred grid cell, 1 at Nyquist."""
    return (2.0 / n) * F.sqrt(x * x + y * y)


def transfer(q: Column, kind: str, cutoff: float, order: int = 8) -> Column:
    """Low-pass weight at frequency q."""
    if kind == "Gauss":
        return F.exp(-(math.log(2) / 2) * F.pow(q / cutoff, F.lit(2)))
    if kind == "Butter":
        return F.sqrt(1 / (1 + F.pow(q / cutoff, F.lit(2 * order))))
    raise ValueError(f"unknown filter {kind!r}")


def thermal_energy(celsius: float = 25.0) -> float:
    """kT in kcal/mol."""
    return 0.0019872041 * (celsius + 273.15)
