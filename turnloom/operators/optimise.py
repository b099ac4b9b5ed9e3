"""Optimisers over numpy vectors: limited-memory quasi-Newton (with an L1 variant) and conjugate gradient."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import numpy as np

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


#: Numbers of a vector beyond which the optimiser's memory of steps is in files.
IN_FILES = 1 << 20


def add(x: np.ndarray, a: float, y: np.ndarray) -> np.ndarray:
    """``x`` plus ``a`` times ``y``, in its place and by pieces that stay in a cache: no other vector is made."""
    room = np.empty(min(len(x), 1 << 13))
    for k in range(0, len(x), 1 << 13):
        piece = x[k : k + (1 << 13)]
        piece += np.multiply(y[k : k + (1 << 13)], a, out=room[: len(piece)])
    return x


class _Pairs:
    """The last steps and changes of gradients, oldest first; of long vectors in a file that has no name."""

    def __init__(self, memory: int, n: int):
        shape = (2, memory + 1, n)  # one more, for the step that may take the oldest one's place
        self.file = tempfile.TemporaryFile() if n > IN_FILES else None
        self.room = np.empty(shape) if self.file is None else np.asarray(np.memmap(self.file, float, "w+", shape=shape))
        self.memory, self.at, self.dots = memory, [], {}

    def clear(self) -> None:
        self.at = []

    def take(self, new: np.ndarray, w: np.ndarray, ng: np.ndarray, g: np.ndarray) -> None:
        """The step from ``w`` to ``new``, unless its curvature is too small."""
        k = next(k for k in range(self.memory + 1) if k not in self.at)
        s, y = self.room[0, k], self.room[1, k]
        np.subtract(new, w, out=s)
        np.subtract(ng, g, out=y)
        sy, yy = s @ y, y @ y
        if sy > 1e-10 * yy:
            self.dots[k] = sy, yy
            self.at = [*self.at, k][-self.memory :]

    def __len__(self) -> int:
        return len(self.at)

    def direction(self, g: np.ndarray) -> np.ndarray:
        q, saved = g.copy(), []
        for k in reversed(self.at):
            a = self.room[0, k] @ q / self.dots[k][0]
            saved.append(a)
            add(q, -a, self.room[1, k])
        if self.at:
            sy, yy = self.dots[self.at[-1]]
            q *= sy / yy
        for k, a in zip(self.at, reversed(saved), strict=True):
            add(q, a - self.room[1, k] @ q / self.dots[k][0], self.room[0, k])
        return np.negative(q, out=q)


def _pseudo(w: np.ndarray, g: np.ndarray, l1: float) -> np.ndarray:
    """Gradient of the loss plus ``l1`` times the absolute weights, zero where that has its minimum."""
    if not l1:
        return g
    out = g + l1 * np.sign(w)
    at = w == 0
    out[at] = np.where(g[at] + l1 < 0, g[at] + l1, np.where(g[at] - l1 > 0, g[at] - l1, 0))
    return out


def _cubic(a: float, fa: float, ga: float, b: float, fb: float, gb: float) -> float:
    """Minimiser of the cubic through two values and slopes; the middle where it has none."""
    if a == b:
        return a
    d = ga + gb - 3 * (fa - fb) / (a - b)
    root = d * d - ga * gb
    if root < 0:
        return (a + b) / 2
    r = np.sign(b - a) * np.sqrt(root)
    below = gb - ga + 2 * r
    return b - (b - a) * (gb + r - d) / below if below else (a + b) / 2


def more_thuente(along: Callable[[float], tuple[float, float]], f0: float, g0: float, step: float, ftol: float = 1e-4, gtol: float = 0.9, most: int = 40) -> float:
    """A step of sufficient decrease and small slope, by the search of Moré and Thuente (1994).

    ``along`` gives value and slope at a step.  The interval's best end is kept; until a step has
    decreased enough with a rising slope, values are those of the function less the decrease that is
    asked for, so that the interval holds a step that will do.  Trial steps are cubic or quadratic
    minimisers, or halves where the interval has shrunk by less than a third in two trials."""
    best, other = (0.0, f0, g0), (0.0, f0, g0)
    bracketed, lowered = False, True
    widths = [np.inf, np.inf]
    for _ in range(most):
        v, s = along(step)
        bound = f0 + ftol * step * g0
        if v <= bound and abs(s) <= gtol * -g0:
            return step
        if lowered and v <= bound and s >= min(ftol, gtol) * g0:
            lowered = False
        slack = ftol * g0 if lowered and v <= best[1] and v > bound else 0.0
        (a, fa, ga), (b, fb, gb) = ((x, y - x * slack, z - slack) for x, y, z in (best, other))
        t, ft, gt = step, v - step * slack, s - slack
        if ft > fa:  # higher: the minimum is between
            cubic, square = _cubic(a, fa, ga, t, ft, gt), a + ga / ((fa - ft) / (t - a) + ga) / 2 * (t - a)
            new = cubic if abs(cubic - a) < abs(square - a) else (cubic + square) / 2
            bracketed, other = True, (step, v, s)
        else:
            cubic, secant = _cubic(a, fa, ga, t, ft, gt), t + gt / (gt - ga) * (a - t) if gt != ga else t
            if gt * ga < 0:  # lower, and the slope has turned
                new = cubic if abs(cubic - t) >= abs(secant - t) else secant
                bracketed, other = True, best
            elif abs(gt) < abs(ga):  # lower and flatter
                far = t + 4 * (t - a)
                ahead = cubic if (cubic - t) * (t - a) > 0 else far
                if bracketed:
                    new = ahead if abs(ahead - t) < abs(secant - t) else secant
                    limit = t + 0.66 * (b - t)
                    new = min(new, limit) if t > a else max(new, limit)
                else:
                    new = min(max(ahead, secant), far)
            else:  # lower, and no flatter
                new = _cubic(b, fb, gb, t, ft, gt) if bracketed else t + 4 * (t - a)
            best = (step, v, s)
        low, high = sorted((best[0], other[0]))
        if bracketed:
            if high - low >= 0.66 * widths[0]:
                new = best[0] + (other[0] - best[0]) / 2
            widths = [widths[1], high - low]
            if high - low <= 1e-16 * high:
                break
            new = min(max(new, low), high)
        step = float(new) if np.isfinite(new) and new > 0 else step / 2
    return best[0]


def lbfgs(f: Objective, w: np.ndarray, memory: int = 6, most: int = 150, eps: float = 1e-5, l1: float = 0.0, past: int = 0, delta: float = 1e-5, watch: Callable[[np.ndarray, float], None] | None = None, search: str = "wolfe", stop: Callable[[float, float], bool] | None = None) -> tuple[np.ndarray, float]:
    """Minimise ``f``; with ``l1`` steps stay in one orthant (OWL-QN) and only need to lower the loss.

    ``search`` is what a step must do: ``armijo``: the loss falls enough; ``wolfe``: its slope has also
    risen; ``strong``: its slope is also small; these by doubling and halving.  ``more-thuente`` asks for
    the last by that search.  Stops at
    a gradient of ``eps`` times the weights' norm, when ``past`` rounds gained less than ``delta``, or when ``stop`` says so of the losses before and
    after a round."""
    w = w.astype(float).copy()
    loss, g = f(w)
    loss += l1 * np.abs(w).sum()
    pairs = _Pairs(memory, len(w))
    history = [loss]
    for _ in range(most):
        pg = _pseudo(w, g, l1)
        if np.linalg.norm(pg) <= eps * max(1.0, np.linalg.norm(w)):
            break
        d = pairs.direction(pg)
        if l1:
            d[d * pg >= 0] = 0
        slope = d @ pg
        if slope >= 0:
            pairs.clear()
            d = -pg
            slope = d @ pg
        orthant = np.where(w != 0, np.sign(w), -np.sign(pg)) if l1 else None
        step, low, high = (1.0 if pairs else 1.0 / max(np.linalg.norm(d), 1e-12)), 0.0, np.inf
        seen: dict[float, tuple[float, np.ndarray]] = {}

        def at(t: float, w=w, d=d, orthant=orthant, seen=seen) -> tuple[np.ndarray, float, np.ndarray]:
            new = add(w.copy(), t, d)
            if l1:
                new[new * orthant < 0] = 0
            if t not in seen:
                seen.clear()
                value, ng = f(new)
                seen[t] = value + l1 * np.abs(new).sum(), ng
            return new, *seen[t]

        if search == "more-thuente" and not l1:
            step = more_thuente(lambda t, at=at, d=d: (lambda x: (x[1], float(x[2] @ d)))(at(t)), loss, float(slope), step)
            new, value, ng = at(step)
        else:
            for _ in range(40):
                new, value, ng = at(step)
                if not np.isfinite(value) or value > loss + 1e-4 * (pg @ (new - w)):
                    high = step
                elif not l1 and search != "armijo" and ng @ d < 0.9 * slope:
                    low = step
                elif not l1 and search == "strong" and ng @ d > -0.9 * slope:
                    high = step
                else:
                    break
                step = (low + high) / 2 if np.isfinite(high) else 2 * step
        if not np.isfinite(value) or value > loss:
            break
        pairs.take(new, w, ng, g)
        w, loss, g = new, value, ng
        history.append(loss)
        if watch:
            watch(w, loss)
        if stop and stop(history[-2], loss):
            break
        if past and len(history) > past and (history[-1 - past] - loss) / max(abs(loss), 1e-12) < delta:
            break
    return w, loss


def conjugate_gradient(f: Callable[[np.ndarray], tuple[float, np.ndarray, Callable[[np.ndarray], float]]], w: np.ndarray, most: int = 100, eps: float = 1e-6) -> np.ndarray:
    """Hestenes-Stiefel directions, one Newton step along each: ``f`` also gives the curvature along a direction."""
    w = w.astype(float).copy()
    _, g, curve = f(w)
    d = -g
    for _ in range(most):
        if np.linalg.norm(g) < eps * max(1.0, np.linalg.norm(w)):
            break
        bend = curve(d)
        w = w - (g @ d) / bend * d if bend > 0 else w - 1e-3 * g
        _, ng, curve = f(w)
        y = ng - g
        beta = max(0.0, ng @ y / (d @ y)) if d @ y else 0.0
        d, g = -ng + beta * d, ng
        if d @ g >= 0:
            d = -g
    return w
