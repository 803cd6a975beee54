"""Primal-dual interior steps for books: small convex problems, many side by side.

minimise  1/2 x' (diag(q) + F'F) x + c'x + sum_i r_i |x_i - p_i| + sum_j h_j max(0, B_j x - k_j)
subject to  A x = a,  lo <= x <= hi,  G x <= g.

Absolute values and kinks are hinges: an auxiliary variable per hinge is eliminated by hand, so a step solves one system in x
alone, a diagonal plus as many rows as F, G and B have.  Where these are fewer than the names, only a system of their number is solved and no matrix
of names by names exists.  ``c``, ``r`` and ``h`` may differ from problem to problem (first axis); all else is shared.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np

#: Largest residual and complementarity of a solved problem; most steps; share of the way to the boundary.
TOLERANCE, STEPS, SHARE = 1e-9, 80, 0.995
#: A problem with residuals below this is solved.
SOLVED = 1e-6
#: A hinge of less weight is none; what is added to the diagonal of a step's matrix (steps get shorter, solutions stay).
FAINT, FIRM = 1e-9, 1e-10
#: Corrections of a step by what it leaves of its right side: near the optimum, active limits weigh so much that one pass loses the slope.
REFINED = 1
#: Matrix entries of the problems that are solved side by side.
NUMBERS = 1_500_000


@dataclass
class Solution:
    """Per problem: ``x``, multipliers (lower and upper bounds, rows of G, equalities, hinges of x and of B), the gap that bounds the excess over the optimum, and whether it is solved."""

    x: np.ndarray
    lower: np.ndarray
    upper: np.ndarray
    rows: np.ndarray
    equal: np.ndarray
    moved: np.ndarray
    kinks: np.ndarray
    gap: np.ndarray
    solved: np.ndarray


def _system(diagonal, dense, weight, equal, fixed, f):
    """Solver of [[diag + dense' weight dense, equal'], [equal, 0]] (dx, dy) = (right_x, right_a) for every problem.

    The matrix is built once and serves all right sides.  The first ``f`` rows of ``dense`` have weight 1 in every problem; ``fixed`` is their product, if it is used.
    """
    k, n = diagonal.shape
    if fixed is not None:
        rest = dense[f:]
        h = np.matmul(rest.T * weight[:, None, f:], rest) + fixed
        h[:, np.arange(n), np.arange(n)] += diagonal
        inner = lambda right: np.linalg.solve(h, right[:, :, None])[:, :, 0]
    else:
        half = dense / np.sqrt(diagonal)[:, None, :]
        core = np.matmul(half, half.transpose(0, 2, 1))
        r = np.arange(len(dense))
        core[:, r, r] += 1.0 / weight
        turned = np.linalg.inv(core)

        def inner(right):
            scaled = right / diagonal
            return scaled - np.matmul(turned, (scaled @ dense.T)[:, :, None])[:, :, 0] @ dense / diagonal

    slope = np.stack([inner(np.broadcast_to(one, (k, n))) for one in equal], axis=2)
    small = np.matmul(equal, slope)

    def once(right_x, right_a):
        step = inner(right_x)
        dy = np.linalg.solve(small, (step @ equal.T - right_a)[:, :, None])[:, :, 0]
        return step - np.matmul(slope, dy[:, :, None])[:, :, 0], dy

    def solved(right_x, right_a):
        dx, dy = once(right_x, right_a)
        for _ in range(0 if fixed is not None else REFINED):
            off, more = once(right_x - diagonal * dx - ((dx @ dense.T) * weight) @ dense - dy @ equal, right_a - dx @ equal.T)
            dx, dy = dx + off, dy + more
        return dx, dy

    return solved


def _longest(value, change):
    """Largest step that keeps all values positive."""
    ratio = np.where(change < 0, -value / np.where(change < 0, change, -1.0), np.inf)
    return ratio.min(axis=1)


def solve(q, factor, c, equal, total, low, high, rows, limit, weight, place, kinks, level, kink_weight) -> Solution:
    """``weight``: r, ``place``: p, ``kinks``, ``level``, ``kink_weight``: B, k, h; ``rows``, ``limit``: G, g.

    So many problems at once as keep their numbers near the processor; a solved problem takes no further steps.
    """
    c = np.atleast_2d(np.asarray(c, float))
    k, n = c.shape
    weight, kink_weight = np.broadcast_to(weight, (k, n)), np.broadcast_to(kink_weight, (k, len(kinks)))
    many = max(1, NUMBERS // ((len(factor) + len(rows) + len(kinks) + 1) * n))
    parts = [_solve(q, factor, c[i:i + many], equal, total, low, high, rows, limit, weight[i:i + many], place, kinks, level, kink_weight[i:i + many]) for i in range(0, k, many)]
    return parts[0] if len(parts) == 1 else Solution(*[np.concatenate([getattr(p, x.name) for p in parts]) for x in fields(Solution)])


def _solve(q, factor, c, equal, total, low, high, rows, limit, weight, place, kinks, level, kink_weight) -> Solution:
    k, n = c.shape
    hinged = np.flatnonzero(weight.max(axis=0) > FAINT)
    weight = np.maximum(weight[:, hinged], FAINT)
    h = len(hinged)
    rho = np.concatenate((2.0 * weight, kink_weight), axis=1)
    c = c.copy()
    c[:, hinged] -= weight  # r |d| = 2 r max(0, d) - r d
    at = np.concatenate((place[hinged], level))
    dense = np.concatenate((factor, rows, kinks))
    f = len(factor)
    fixed = factor.T @ factor if n <= len(dense) + 8 else None  # else a system of as many rows as ``dense`` is the smaller one

    def g_of(v):
        return np.concatenate((-v, v, v @ rows.T), axis=1)

    def g_back(v):
        return v[:, n:2 * n] - v[:, :n] + v[:, 2 * n:] @ rows

    def b_of(v):
        return np.concatenate((v[:, hinged], v @ kinks.T), axis=1)

    def b_back(v):
        back = v[:, h:] @ kinks
        back[:, hinged] += v[:, :h]
        return back

    bound = np.concatenate((-low, high, limit))
    span = high - low
    x = np.broadcast_to(np.clip(place, low + 0.05 * span, high - 0.05 * span), (k, n)).copy()
    g = np.maximum(bound - g_of(x), 0.01)
    e_raw = b_of(x) - at
    s, e = np.maximum(e_raw, 0.0) + 0.01, np.maximum(-e_raw, 0.0) + 0.01
    z, y, v = np.full_like(g, 0.1), 0.5 * rho, 0.5 * rho
    eta = np.zeros((k, len(equal)))
    count = g.shape[1] + 2 * s.shape[1]
    best = np.full(k, np.inf)
    kept = [u.copy() for u in (x, eta, g, z, y, v, s, e)]
    live = np.arange(k)
    for _ in range(STEPS):
        r_x = q * x + (x @ factor.T) @ factor + c + g_back(z) + b_back(y) + eta @ equal
        r_s, r_g, r_e, r_a = rho - y - v, g_of(x) + g - bound, b_of(x) - at - s + e, x @ equal.T - total
        mu = ((z * g).sum(1) + (y * e).sum(1) + (v * s).sum(1)) / count
        worst = np.max([np.abs(r).max(axis=1) for r in (r_x, r_s, r_g, r_e, r_a)], axis=0)
        now = np.maximum(worst, mu)
        better = now < best[live]
        for held, value in zip(kept, (x, eta, g, z, y, v, s, e)):
            held[live[better]] = value[better]
        best[live] = np.where(better, now, best[live])
        left = best[live] >= TOLERANCE
        if not left.any():
            break
        if not left.all():
            live = live[left]
            x, eta, g, z, y, v, s, e, c, rho, r_x, r_s, r_g, r_e, r_a, mu = (u[left] for u in (x, eta, g, z, y, v, s, e, c, rho, r_x, r_s, r_g, r_e, r_a, mu))
        omega = 1.0 / (s / v + e / y)
        over = z / g
        diagonal = q + over[:, :n] + over[:, n:2 * n] + FIRM
        diagonal[:, hinged] += omega[:, :h]
        inner = np.concatenate((np.ones((len(live), f)), over[:, 2 * n:], omega[:, h:]), axis=1)
        def direction(zg, ye, vs):
            push = r_e + (vs + s * r_s) / v - ye / y
            right = -r_x - g_back((z * r_g - zg) / g) - b_back(omega * push)
            dx, deta = system(right, -r_a)
            dg = -r_g - g_of(dx)
            dz = (-zg - z * dg) / g
            dy = omega * (b_of(dx) + push)
            dv = r_s - dy
            return dx, deta, dg, dz, dy, dv, (-vs - s * dv) / v, (-ye - e * dy) / y

        def longest(dg, dz, dy, dv, ds, de):
            primal = np.minimum(np.minimum(_longest(g, dg), _longest(s, ds)), _longest(e, de))
            dual = np.minimum(np.minimum(_longest(z, dz), _longest(y, dy)), _longest(v, dv))
            return np.minimum(1.0, SHARE * np.minimum(primal, dual))[:, None]

        try:
            system = _system(diagonal, dense, inner, equal, fixed, f)
            _, _, dg, dz, dy, dv, ds, de = direction(z * g, y * e, v * s)
        except np.linalg.LinAlgError:  # as near as double precision gets
            break
        a = longest(dg, dz, dy, dv, ds, de)
        ahead = (((z + a * dz) * (g + a * dg)).sum(1) + ((y + a * dy) * (e + a * de)).sum(1) + ((v + a * dv) * (s + a * ds)).sum(1)) / count
        aim = (np.clip(ahead / mu, 0.0, 1.0) ** 3 * mu)[:, None]
        try:
            dx, deta, dg, dz, dy, dv, ds, de = direction(z * g + dz * dg - aim, y * e + dy * de - aim, v * s + dv * ds - aim)
        except np.linalg.LinAlgError:
            break
        a = longest(dg, dz, dy, dv, ds, de)
        x, eta, g, z, y, v, s, e = x + a * dx, eta + a * deta, g + a * dg, z + a * dz, y + a * dy, v + a * dv, s + a * ds, e + a * de
        if not np.isfinite(x).all():
            break
    x, eta, g, z, y, v, s, e = kept
    gap = (z * g).sum(1) + (y * e).sum(1) + (v * s).sum(1)
    moved = np.zeros((k, n))
    moved[:, hinged] = y[:, :h] - weight
    return Solution(x, z[:, :n], z[:, n:2 * n], z[:, 2 * n:], eta, moved, y[:, h:], gap, best < SOLVED)
