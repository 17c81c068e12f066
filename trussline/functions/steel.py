"""Carbon steel as columns: grades, and how strength, stiffness and heat depend on temperature."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Temperatures, and the share of stiffness and of yield strength that is left at them.
TEMPERATURES = (20, 100, 200, 300, 400, 500, 600, 700, 800, 900, 1000, 1100, 1200)
STIFFNESS_LEFT = (1.0, 1.0, 0.9, 0.8, 0.7, 0.6, 0.31, 0.13, 0.09, 0.0675, 0.045, 0.0225, 0.0)
STRENGTH_LEFT = (1.0, 1.0, 1.0, 1.0, 1.0, 0.78, 0.47, 0.23, 0.11, 0.06, 0.04, 0.02, 0.0)
#: Imperfection factors of buckling curves a to d.
IMPERFECTION = {"a": 0.21, "b": 0.34, "c": 0.49, "d": 0.76}


def interpolated(x: Column, at: Sequence[float], values: Sequence[float]) -> Column:
    """Piecewise linear; the first and last value outside."""
    out = F.when(x <= at[0], F.lit(float(values[0])))
    for a, b, p, q in zip(at[:-1], at[1:], values[:-1], values[1:], strict=True):
        out = out.when(x <= b, p + (x - a) * ((q - p) / (b - a)))
    return out.otherwise(F.lit(float(values[-1])))


def stiffness(e_mod: Column, temperature: Column) -> Column:
    return e_mod * interpolated(temperature, TEMPERATURES, STIFFNESS_LEFT)


def strength(sig_y: Column, temperature: Column) -> Column:
    return sig_y * interpolated(temperature, TEMPERATURES, STRENGTH_LEFT)


def conductivity(t: Column) -> Column:
    """W / (m K)."""
    return F.when(t <= 780, 54 - t * 3.33 * 0.01).otherwise(27.3)


def specific_heat(t: Column) -> Column:
    """J / (kg K)."""
    low = 425 + 0.773 * t - 1.69e-3 * t * t + 2.22e-6 * t * t * t
    return F.when(t <= 600, low).when(t <= 735, 666 + 13002 / (738 - t)).when(t <= 900, 545 + 17820 / (t - 731)).otherwise(650.0)


def grade(sig_y: Column, tol: float = 1.0) -> Column:
    """S420 or S355 by the yield strength in Pa, NA else."""
    return F.when(F.abs(sig_y - 420e6) < tol, "S420").when(F.abs(sig_y - 355e6) < tol, "S355").otherwise("NA")


def buckling_use(m_ed: Column, w_y: Column, f_y: Column, e_shear: Column, i_x: Column, i_z: Column, h: Column, w_bottom: Column, length: Column, welded: Column) -> Column:
    """Utilisation of an I beam in lateral-torsional buckling.

    The critical moment leaves warping out, as its source does, which calls it incomplete: not for design.
    """
    slender = h / w_bottom > 2
    factor = F.when(welded, F.when(slender, IMPERFECTION["b"]).otherwise(IMPERFECTION["a"])).otherwise(F.when(slender, IMPERFECTION["d"]).otherwise(IMPERFECTION["c"]))
    critical = math.pi / length * F.sqrt(e_shear * i_x * i_z)
    lam = F.sqrt(w_y * f_y / critical)
    phi = 0.5 * (1 + factor * (lam - 0.2) + lam * lam)
    left = F.least(1 / (phi + F.sqrt(phi * phi - lam * lam)), F.lit(1.0))
    return m_ed / (left * w_y * f_y / 1.15)
