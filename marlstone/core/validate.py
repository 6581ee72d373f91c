"""Checks of scalar parameters.  The messages' wording is a fixed part of the interface."""

from __future__ import annotations

import math


def window(value: int, name: str = "window", least: int = 1) -> None:
    if value < least:
        raise ValueError(f"{name} must be >= {least}, got {value}")


def ddof(value: int, size: int) -> None:
    if value < 0:
        raise ValueError(f"ddof must be >= 0, got {value}")
    if value >= size:
        raise ValueError(f"ddof must be < window, got ddof={value}, window={size}")


def ordered(**windows: int) -> None:
    """Windows must not fall in the order given; each is at least 1."""
    for name, value in windows.items():
        window(value, name)
    values = list(windows.values())
    if any(a > b for a, b in zip(values, values[1:], strict=False)):
        wanted = " <= ".join(windows)
        raise ValueError(f"windows must be ordered {wanted}, got {', '.join(f'{k}={v}' for k, v in windows.items())}")


def periods(value: int) -> None:
    if value < 1:
        raise ValueError(f"periods_per_year must be >= 1, got {value}")


def finite(value: float, name: str) -> None:
    if not math.isfinite(value):
        raise ValueError(f"{name} must be a finite number, got {value}")


def positive(value: float, name: str, zero: bool = False) -> None:
    if not math.isfinite(value) or value < 0 or (value == 0 and not zero):
        raise ValueError(f"{name} must be a finite number {'>= 0' if zero else '> 0'}, got {value}")


def confidence(value: float) -> None:
    if not 0.0 < value < 1.0:
        raise ValueError(f"confidence must be in the open interval (0, 1), got {value}")


def fraction(value: float, name: str) -> None:
    if not 0.0 < value <= 1.0:
        raise ValueError(f"{name} must be in the half-open interval (0, 1], got {value}")


def period_rate(annual: float, periods_per_year: int, name: str = "risk_free_rate") -> float:
    """An annual rate as one for a period, compounded."""
    finite(annual, name)
    if annual < -1:
        raise ValueError(f"{name} must be >= -1, got {annual}")
    return (1.0 + annual) ** (1.0 / periods_per_year) - 1.0
