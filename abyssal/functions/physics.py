"""Column expressions of the response chain and of rock properties; all stay inside Spark's expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.traces import G_DISPERSION, G_TERM, NEWTON, WATER


def wavenumber(f: Column, depth: Column) -> Column:
    """Positive root of the rational approximation of the dispersion relation, biquadratic in k; deep water keeps omega**2 / g; 0 at f = 0."""
    w2g = F.pow(2 * math.pi * f, 2) / G_DISPERSION
    x = w2g * depth  # with y = (k depth)**2:  y**2 + (27 - 9 x) y - 27 x = 0
    b = 27 - 9 * x
    root = F.sqrt(b * b + 108 * x)
    y = F.when(b > 0, 54 * x / (b + root)).otherwise((root - b) / 2)
    return F.when(f == 0, 0.0).when(x > 2.96, w2g).otherwise(F.sqrt(y) / depth)


def wavenumber_exact(f: Column, depth: Column, rounds: int = 30) -> Column:
    """Root of omega**2 = g k tanh(k depth) by Newton steps on y = k depth; 0 at f = 0."""
    x = F.pow(2 * math.pi * f, 2) / G_DISPERSION * depth
    start = F.when(x > 1, x).otherwise(F.sqrt(x))

    def step(y: Column, _: Column) -> Column:
        t = F.tanh(y)
        return y - (y * t - x) / (t + y * (1 - t * t))

    return F.when(f == 0, 0.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step) / depth)


def water_height(pressure: Column, k: Column, depth: Column) -> Column:
    return pressure * F.cosh(k * depth) / (WATER * G_TERM)


def water_acceleration(pressure: Column, k: Column, depth: Column) -> Column:
    """Gravitational acceleration of the water column's waves at the sea floor."""
    return 2 * math.pi * NEWTON * WATER * F.exp(-k * depth) * water_height(pressure, k, depth)


def geometric(i: Column, first: float, last: float, n: int) -> Column:
    """Value ``i`` of n values in a constant ratio from ``first`` to ``last``."""
    return first * F.pow(F.lit(last / first), i / (n - 1))


def default_sigma(values: Column) -> Column:
    """The uncertainty of data that come without one (an aggregate)."""
    return F.stddev_pop(values) / 20


def log_likelihood(misfit: Column, *terms: tuple[float, Column]) -> Column:
    """Half the misfit and the weighted terms, negative."""
    return -0.5 * sum((weight * term for weight, term in terms), misfit)


def gravity_ratio(k: Column, depth: Column) -> Column:
    """2 pi G / g exp(-kH) cosh(kH), in the form that can't overflow."""
    return math.pi * NEWTON / G_TERM * (1 + F.exp(-2 * k * depth))


def mass_correction(f: Column) -> Column:
    w2 = F.pow(2 * math.pi * f, 2)
    return w2 / (w2 + 3.07e-5)


def compliance_v1(k, coh, f, depth, psd_z, psd_p, gain):
    return k * coh * mass_correction(f) * (gravity_ratio(k, depth) + F.sqrt(psd_z) / (F.sqrt(psd_p) * gain))


def compliance_v2(k, coh, f, depth, psd_z, psd_p):
    return k * coh * mass_correction(f) * (gravity_ratio(k, depth) + F.sqrt(psd_z) / F.sqrt(psd_p))


def compliance_simple(k, coh2, psd_z, psd_p):
    return k * coh2 * F.sqrt(psd_z / psd_p)


def admittance(k, csd_re, psd_p, gain):
    return k * csd_re / psd_p * gain


def corner(depth: Column, waves: float) -> Column:
    """Frequency at which ``waves`` water depths make a wavelength of infragravity waves."""
    return F.sqrt(G_TERM / (2 * math.pi * waves * depth))


def uncertainty_theory(c, coh, n):
    return c * F.sqrt(1 - coh * coh) / (F.abs(coh) * F.sqrt(2 * n))


def uncertainty_alt(c, coh, n):
    return c * F.sqrt(1 - coh) / F.abs(coh * F.sqrt(2 * n))


def coherence_significance(n: Column, prob: float = 0.95) -> Column:
    if not 0 <= prob <= 1:
        raise ValueError("prob lies between 0 and 1")
    return F.sqrt(1 - F.pow(F.lit(1 - prob), 1 / (n / 2 - 1)))


def vp_from_vs(vs: Column, poisson: float = 0.25) -> Column:
    return vs * math.sqrt((1 - poisson) / (0.5 - poisson))


def gardner_density(vs: Column, poisson: float = 0.25) -> Column:
    return 310 * F.pow(vp_from_vs(vs, poisson), 0.25)


def acceleration(psd: Column, f: Column) -> Column:
    return psd * F.pow(2 * math.pi * f, 4)


def decibel(p: Column) -> Column:
    """Null where the power is not positive."""
    return F.when(p > 0, 10 * F.log10(p))


def serpentinised(median_vs: Column) -> Column:
    return F.least((9000 - 2 * median_vs) / 30, F.lit(100.0))


def hann(n: Column, size: int, periodic: bool = False) -> Column:
    return 0.5 - 0.5 * F.cos(2 * math.pi * n / (size if periodic else size - 1))


def tukey(n: Column, size: int, alpha: float) -> Column:
    edge = alpha * (size - 1) / 2
    if edge <= 0:
        return F.lit(1.0)
    near = F.least(n, size - 1 - n)
    return F.when(near < edge, 0.5 * (1 - F.cos(math.pi * near / edge))).otherwise(1.0)


def misfit_norm(d: Column, m: Column, s: Column, power: float = 2.0) -> Column:
    """Aggregate: the l-norm of the weighted residuals."""
    return F.pow(F.sum(F.pow(F.abs((d - m) / s), power)), 1 / power)


def misfit_sum(d: Column, m: Column, s: Column, power: int = 2) -> Column:
    return F.sum(F.pow((d - m) / s, power))


def roughness(v: Column, spacing: float = 2.0) -> Column:
    """Root of the summed gradient of an array: the sum telescopes to its two first and two last cells; null where negative."""
    n = F.size(v)
    total = (1.5 * F.element_at(v, n) - 0.5 * F.element_at(v, n - 1) + 0.5 * F.element_at(v, 2) - 1.5 * F.element_at(v, 1)) / spacing
    return F.when(total >= 0, F.sqrt(total))
