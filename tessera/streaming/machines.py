"""State machines over arriving rows: smoothing, holding, triggers. One definition for stream and batch."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Machine:
    """``step(state, row) -> (state, output)`` on tuples; inputs are the named columns of a row, in order."""

    inputs: tuple[str, ...]
    state: str
    start: tuple
    output: str
    step: Callable[[tuple, tuple], tuple[tuple, tuple]]
    #: What many rows do to a state, as a value: ``compose(earlier, later)`` of two such, and ``act(value, state)``; ``lift(row)`` is one row's.
    lift: Callable[[tuple], tuple] | None = None
    compose: Callable[[tuple, tuple], tuple] | None = None
    act: Callable[[tuple, tuple], tuple] | None = None


def _blend(a: list[float], b: list[float], share: float) -> list[float]:
    return [x + share * (y - x) for x, y in zip(a, b, strict=True)]


def _quad_area(q: list[float]) -> float:
    return abs(sum(q[2 * i] * q[(2 * i + 3) % 8] - q[(2 * i + 2) % 8] * q[2 * i + 1] for i in range(4))) / 2


def _aligned(q: list[float], to: list[float]) -> list[float]:
    orders = [[(s + d * i) % 4 for i in range(4)] for d in (1, -1) for s in range(4)]
    turned = [[q[2 * k + j] for k in order for j in (0, 1)] for order in orders]
    return min(turned, key=lambda t: sum((x - y) ** 2 for x, y in zip(t, to, strict=True)))


def smooth_and_hold(near: float = 0.4, far: float = 0.8, move: float = 0.08 * 2**0.5, area: tuple[float, float] = (0.7, 1.4), most: int = 5, fade: float = 0.8) -> Machine:
    """Quads (eight numbers, or null for a miss) with a confidence.

    A hit is aligned to the last quad and blended with it: by ``near`` if its centre moved
    less than ``move`` and its area changed within ``area``, else by ``far``. A miss repeats the last
    quad at ``fade`` times its confidence, ``most`` times; then null.
    """

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        last, conf, missed = state
        quad, own = row
        if quad is None:
            if last is None or missed >= most:
                return (None, 0.0, missed + 1), (None, None, "miss")
            return (last, conf * fade, missed + 1), (last, conf * fade, "held")
        quad = [float(x) for x in quad]
        if last is not None:
            last = [float(x) for x in last]
            quad = _aligned(quad, last)
            gone = math.hypot(*(sum(quad[i::2]) / 4 - sum(last[i::2]) / 4 for i in (0, 1)))
            ratio = _quad_area(quad) / max(_quad_area(last), 1e-12)
            quad = _blend(last, quad, near if gone < move and area[0] <= ratio <= area[1] else far)
        return (quad, float(own), 0), (quad, float(own), "fresh")

    return Machine(("quad", "confidence"), "quad array<double>, confidence double, missed int", (None, 0.0, 0), "quad array<double>, confidence double, state string", step)


def hysteresis(threshold: float, rearm: float = 0.7, gap_s: float = 0.120) -> Machine:
    """Fire above the threshold if armed and ``gap_s`` after the last time; armed again below ``rearm`` of it."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        armed, last = state
        t, level = row
        if level is None or t is None:
            return state, (False,)
        fire = bool(armed and level > threshold and (last is None or t - last >= gap_s))
        if fire:
            armed, last = False, float(t)
        elif level < rearm * threshold:
            armed = True
        return (armed, last), (fire,)

    return Machine(("t", "level"), "armed boolean, last double", (True, None), "hit boolean", step)


def one_euro(least: float = 1.0, beta: float = 0.0, speed_cutoff: float = 1.0) -> Machine:
    """Low-pass filter whose cutoff grows with the speed of the signal; null input repeats the last value."""

    def alpha(cutoff: float, dt: float) -> float:
        return 1 / (1 + 1 / (2 * math.pi * cutoff * dt))

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        x0, dx0, t0 = state
        t, x = row
        if x is None or t is None:
            return state, (x0,)
        if x0 is None:
            return (float(x), 0.0, float(t)), (float(x),)
        dt = max(1e-3, t - t0)
        dx = dx0 + alpha(speed_cutoff, dt) * ((x - x0) / dt - dx0)
        value = x0 + alpha(least + beta * abs(dx), dt) * (x - x0)
        return (value, dx, float(t)), (value,)

    return Machine(("t", "value"), "x double, dx double, t double", (None, 0.0, None), "smooth double", step)


def easing(share: float) -> Machine:
    """Each value moves the state by ``share`` of the way; null leaves it."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        (x,), (value,) = state, row
        x = x if value is None else float(value) if x is None else x + share * (value - x)
        return (x,), (x,)

    # x -> keep * x + add, and what becomes of no state at all
    def lift(row: tuple) -> tuple:
        (value,) = row
        return (1.0, 0.0, None) if value is None else (1 - share, share * float(value), float(value))

    def compose(a: tuple, b: tuple) -> tuple:
        fresh = b[2] if a[2] is None else b[0] * a[2] + b[1]
        return (a[0] * b[0], b[0] * a[1] + b[1], fresh)

    def act(f: tuple, state: tuple) -> tuple:
        (x,) = state
        return (f[2] if x is None else f[0] * x + f[1],)

    return Machine(("value",), "x double", (None,), "eased double", step, lift, compose, act)


def cadence(every: int = 4, move: float = 0.20, shrink: float = 0.75, grow: float = 1.33) -> Machine:
    """Whether the costly step runs on a box (x0, y0, x1, y1): first, after ``every`` cached rows, or on a jump.

    ``payload`` is what the costly step would give; it is repeated on cached rows and replaced, also by
    null, on fresh ones.
    """

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        last, count, kept = state
        box, payload = row
        if box is None:
            return state, (False, None)
        box = [float(v) for v in box]
        jumped = last is None
        if last is not None:
            last = [float(v) for v in last]
            diagonal = math.hypot(last[2] - last[0], last[3] - last[1])
            gone = math.hypot((box[0] + box[2] - last[0] - last[2]) / 2, (box[1] + box[3] - last[1] - last[3]) / 2)
            ratio = math.hypot(box[2] - box[0], box[3] - box[1]) / max(diagonal, 1e-6)
            jumped = gone > move * diagonal or not shrink <= ratio <= grow
        if jumped or count >= every:
            return (box, 0, payload), (True, payload)
        return (last, count + 1, kept), (False, kept)

    return Machine(("box", "payload"), "box array<double>, count int, payload string", (None, 0, None), "fresh boolean, payload string", step)


def monotonic() -> Machine:
    """Timestamps in milliseconds that always grow: max(ts, last + 1)."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        (last,), (ts,) = state, row
        if ts is None:
            return state, (None,)
        ts = int(ts) if last is None else max(int(ts), last + 1)
        return (ts,), (ts,)

    # last -> max(floor, last + more); without a last one: the floor
    def lift(row: tuple) -> tuple:
        (ts,) = row
        return (None, 0) if ts is None else (int(ts), 1)

    def compose(a: tuple, b: tuple) -> tuple:
        shifted = None if a[0] is None else a[0] + b[1]
        return (max((v for v in (shifted, b[0]) if v is not None), default=None), a[1] + b[1])

    def act(f: tuple, state: tuple) -> tuple:
        (last,) = state
        return (max((v for v in (None if last is None else last + f[1], f[0]) if v is not None), default=None),)

    return Machine(("ts_ms",), "last bigint", (None,), "ts_fixed bigint", step, lift, compose, act)
