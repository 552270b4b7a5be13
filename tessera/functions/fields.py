"""Exact flow fields on periodic boxes as column expressions of x, y and time."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .metric import Box, minimum_image, wavenumber


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class Mode:
    amplitude: float
    nx: int
    ny: int
    phase: float = 0.0


class ShearModes:
    """Decaying shear waves of one wave length, carried by a uniform drift."""

    def __init__(self, box: Box, modes: Sequence[Mode], nu: float, drift: tuple[float, float] = (0.0, 0.0)) -> None:
        box.need_positive()
        _need(nu > 0, "nu has to exceed zero")
        _need(bool(modes), "no mode was given")
        self.box, self.nu, self.drift = box, nu, drift
        lines = [max((m.nx, m.ny), (-m.nx, -m.ny)) for m in modes]
        _need((0, 0) not in lines, "a mode needs a wave number other than (0, 0)")
        _need(len(set(lines)) == len(lines), "two modes run along one wave vector")
        self.waves = [(*wavenumber(box, (m.nx, m.ny)), m.amplitude, m.phase) for m in modes]
        squares = [kx * kx + ky * ky for kx, ky, *_ in self.waves]
        self.ksqr = squares[0]
        _need(all(abs(s - self.ksqr) <= 8 * 2.0**-52 * self.ksqr for s in squares), "the modes differ in wave length, so they decay at different rates")
        self.mean = sum(m.amplitude**2 for m in modes) / 2

    @property
    def time_constant(self) -> float:
        return 1 / (self.nu * self.ksqr)

    def decay(self, t: Column) -> Column:
        return F.exp(-t / self.time_constant)

    def decay_time(self, fraction: float) -> float:
        _need(0 < fraction <= 1, "a remaining fraction lies above 0 and is at most 1")
        return -self.time_constant * math.log(fraction)

    def _sum(self, x: Column, y: Column, t: Column, wave: str, factor) -> Column:
        """Sum over the modes of factor(kx, ky, a) times the sine or cosine of the phase."""
        xs, ys = x - self.drift[0] * t, y - self.drift[1] * t
        trig = F.sin if wave == "sin" else F.cos
        return reduce(lambda s, v: s + v, [trig(xs * kx + ys * ky + phase) * factor(kx, ky, a) for kx, ky, a, phase in self.waves])

    def _undecayed(self, x: Column, y: Column, t: Column) -> tuple[Column, Column]:
        k = math.sqrt(self.ksqr)
        return self._sum(x, y, t, "sin", lambda kx, ky, a: -a * ky / k), self._sum(x, y, t, "sin", lambda kx, ky, a: a * kx / k)

    def fields(self, x: Column, y: Column, t: Column) -> tuple[Column, Column, Column]:
        """p, ux, uy."""
        d = self.decay(t)
        ux, uy = self._undecayed(x, y, t)
        c = self._sum(x, y, t, "cos", lambda kx, ky, a: a)
        return d * d * (self.mean - (ux * ux + uy * uy + c * c) / 2), d * ux + self.drift[0], d * uy + self.drift[1]

    def stress(self, x: Column, y: Column, t: Column) -> tuple[Column, Column, Column]:
        """Strain rate sxx, sxy, syy."""
        k, d = math.sqrt(self.ksqr), self.decay(t)
        sxx = d * self._sum(x, y, t, "cos", lambda kx, ky, a: -a * kx * ky / k)
        sxy = d * self._sum(x, y, t, "cos", lambda kx, ky, a: a * (kx * kx - ky * ky) / (2 * k))
        return sxx, sxy, -sxx

    def body_force(self, x: Column, y: Column, t: Column) -> tuple[Column, Column]:
        """The force that holds the field of time zero in the drifting frame."""
        ux, uy = self._undecayed(x, y, t)
        return ux * (self.nu * self.ksqr), uy * (self.nu * self.ksqr)


def shear_wave(box: Box, nx: int, ny: int, u0: float, nu: float, phase: float = 0.0, drift: tuple[float, float] = (0.0, 0.0)) -> ShearModes:
    return ShearModes(box, [Mode(u0, nx, ny, phase)], nu, drift)


def taylor_green(box: Box, nx: int, ny: int, u0: float, nu: float, drift: tuple[float, float] = (0.0, 0.0)) -> ShearModes:
    _need(nx != 0 and ny != 0, "nx and ny have to differ from 0")
    kx, ky = wavenumber(box, (abs(nx), abs(ny)))
    a = u0 * math.sqrt((kx * kx + ky * ky) / (4 * kx * ky))
    return ShearModes(box, [Mode(a, abs(nx), abs(ny)), Mode(a, abs(nx), -abs(ny))], nu, drift)


class AcousticWave:
    """A standing sound wave released from rest."""

    def __init__(self, box: Box, nx: int, ny: int, delta: float, nu: float, nu_bulk: float | None = None, csqr: float = 1 / 3, rho0: float = 1.0, phase: float = 0.0) -> None:
        box.need_positive()
        bulk = nu if nu_bulk is None else nu_bulk
        _need((nx, ny) != (0, 0), "a mode needs a wave number other than (0, 0)")
        _need(delta > 0, "delta has to exceed zero")
        _need(nu > 0 and bulk >= 0, "nu has to exceed zero, and nu_bulk must not be negative")
        _need(csqr > 0 and rho0 > 0, "csqr and rho0 have to exceed zero")
        self.delta, self.csqr, self.rho0, self.phase = delta, csqr, rho0, phase
        self.k = wavenumber(box, (nx, ny))
        ksqr = self.k[0] ** 2 + self.k[1] ** 2
        self.damping_rate = (nu + bulk) * ksqr / 2
        _need(csqr * ksqr > self.damping_rate**2, "with so much viscosity nothing oscillates")
        self.frequency = math.sqrt(csqr * ksqr - self.damping_rate**2)
        self.period = 2 * math.pi / self.frequency

    def fields(self, x: Column, y: Column, t: Column) -> tuple[Column, Column, Column]:
        """rho, ux, uy."""
        g, w = self.damping_rate, self.frequency
        th, e = x * self.k[0] + y * self.k[1] + self.phase, F.exp(t * -g)
        rho = (F.cos(th) * e * (F.cos(t * w) + F.sin(t * w) * (g / w)) * self.delta + 1) * self.rho0
        u = e * F.sin(t * w) * F.sin(th) * (self.delta * self.csqr / w)
        return rho, u * self.k[0], u * self.k[1]


def shear_layer(box: Box, u0: float, x: Column, y: Column, k: float = 80.0, delta: float = 0.05) -> tuple[Column, Column, Column]:
    """p (zero), ux, uy of two perturbed tanh layers."""
    box.need_positive()
    _need(k > 0, "k has to exceed zero")
    h = y / box.sides[1]
    ux = F.tanh(F.when(h <= 0.5, h - 0.25).otherwise(0.75 - h) * k) * u0
    return F.lit(0.0), ux, F.sin((x / box.sides[0] + 0.25) * (2 * math.pi)) * (u0 * delta)


def barotropic_vortex(box: Box, u0: float, centre: tuple[float, float], radius: float, eps: float, x: Column, y: Column, rho0: float = 1.0, csqr: float = 1 / 3) -> tuple[Column, Column, Column]:
    """rho, ux, uy of a Gaussian vortex in density balance."""
    box.need_positive()
    _need(radius > 0, "the radius has to exceed zero")
    _need(rho0 > 0 and csqr > 0, "rho0 and csqr have to exceed zero")
    dx, dy = minimum_image(x - centre[0], box.sides[0]), minimum_image(y - centre[1], box.sides[1])
    g = F.exp(-(dx * dx + dy * dy) / (2 * radius * radius))
    return F.exp(g * g * (-eps * eps / csqr / 2)) * rho0, F.lit(u0) - dy / radius * g * eps, dx / radius * g * eps
