"""Argument checks with uniform messages."""

from __future__ import annotations

import numbers
from collections.abc import Sequence


def whole(name: str, x: object, least: int | None = None, most: int | None = None) -> int:
    if isinstance(x, bool) or not isinstance(x, numbers.Real) or x != int(x) or (least is not None and x < least) or (most is not None and x > most):
        raise ValueError(f"{name} must be a whole number" + _range(least, most))
    return int(x)


def number(name: str, x: object, least: float | None = None, most: float | None = None) -> float:
    if isinstance(x, bool) or not isinstance(x, numbers.Real) or x != x or (least is not None and x < least) or (most is not None and x > most):
        raise ValueError(f"{name} must be a number" + _range(least, most))
    return float(x)


def numbers_of(name: str, x: Sequence[float], n: int | None = None, positive_sum: bool = True) -> list[float]:
    out = [number(name, v, 0) for v in x]
    if n is not None and len(out) != n or positive_sum and sum(out) <= 0:
        raise ValueError(f"{name} must have {n if n is not None else 'some'} numbers that are not negative, with a positive sum")
    return out


def one_of(name: str, x: object, allowed: Sequence[object]) -> object:
    if x not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(map(str, allowed))}")
    return x


def distinct(name: str, x: Sequence[str]) -> list[str]:
    if len(set(x)) != len(x):
        raise ValueError(f"{name} must not repeat")
    return list(x)


def _range(least: float | None, most: float | None) -> str:
    return (f" of at least {least}" if least is not None else "") + (" and" if None not in (least, most) else "") + (f" of at most {most}" if most is not None else "")
