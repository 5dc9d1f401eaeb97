"""Direct solutions of fits whose cells fit one task: Newton steps, conjugate gradients, a profile likelihood.

These reach the same optima as the distributed sweeps in ``effects``, which larger fits take, by other means.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

# Cells of a fit that is solved in one task; a larger one is swept in distributed jobs to the same solution.
LOCAL_CELLS = 200_000

Rows = list[tuple]


def _gradients(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, diagonal: np.ndarray, tol: float = 1e-13, steps: int = 2000) -> np.ndarray:
    """Solve a symmetric positive system by conjugate gradients scaled with its diagonal."""
    x, r = np.zeros_like(b), b.copy()
    z = r / diagonal
    d, rz = z.copy(), float(r @ z)
    limit = tol * tol * max(rz, 1e-300)
    for _ in range(steps):
        if rz <= limit:
            break
        image = apply(d)
        slope = float(d @ image)
        if slope <= 0:
            break
        x += rz / slope * d
        r -= rz / slope * image
        z = r / diagonal
        fresh = float(r @ z)
        d, rz = z + fresh / rz * d, fresh
    return x


def _index(values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    codes, names = pd.factorize(values.astype(str), sort=True)
    return np.asarray(codes), np.asarray(names)


def _numbers(**values: float) -> Rows:
    return [("number", name, float(value), None, None, None) for name, value in values.items()]


def least_squares(c: pd.DataFrame) -> Rows:
    """Two-way weighted least squares by its normal equations; the intercept is shared out by the caller."""
    i, workers = _index(c.Worker)
    j, items = _index(c.ItemKey)
    w, wy, k, m = c.w.to_numpy(), c.wy.to_numpy(), len(workers), len(items)

    def apply(x: np.ndarray) -> np.ndarray:
        part = w * (x[:k][i] + x[k:][j])
        return np.concatenate([np.bincount(i, part, k), np.bincount(j, part, m)])

    x = _gradients(apply, np.concatenate([np.bincount(i, wy, k), np.bincount(j, wy, m)]), np.concatenate([np.bincount(i, w, k), np.bincount(j, w, m)]))
    rows = [("worker", n, v, None, None, None) for n, v in zip(workers, x[:k])] + [("item", n, v, None, None, None) for n, v in zip(items, x[k:])]
    return rows + _numbers(mu=0.0, sweeps=1, converged=1)


def variance_profile(c: pd.DataFrame) -> Rows:
    """Random workers and fixed items: the likelihood is profiled down to the ratio of the variances and searched there."""
    i, workers = _index(c.Worker)
    j, items = _index(c.ItemKey)
    w, wy, wyy, n = (c[x].to_numpy(float) for x in ("w", "wy", "wyy", "n"))
    k, m, total, lnw = len(workers), len(items), n.sum(), c.lnw.sum()
    held, of_item, target = np.bincount(i, w, k), np.bincount(j, w, m), np.bincount(j, wy, m)
    own = np.bincount(i, wy, k)

    def at(log_ratio: float):
        ratio = np.exp(log_ratio)
        pull = ratio / (1 + ratio * held)
        level = _gradients(
            lambda x: of_item * x - np.bincount(j, w * (pull * np.bincount(i, w * x[j], k))[i], m),
            target - np.bincount(j, w * (pull * own)[i], m),
            np.maximum(of_item - np.bincount(j, w * w * pull[i], m), 1e-12),
        )
        left = own - np.bincount(i, w * level[j], k)
        square = max(float((wyy - 2 * wy * level[j] + w * level[j] ** 2).sum() - (pull * left * left).sum()), 1e-10 * total)
        s2 = square / total
        ll = -0.5 * (total * np.log(2 * np.pi * s2) - lnw + np.log1p(ratio * held).sum() + total)
        return ll, s2, ratio * s2, level, left

    low, high, golden = np.log(1e-9), np.log(1e4), (np.sqrt(5) - 1) / 2
    a, b = high - golden * (high - low), low + golden * (high - low)
    fa, fb, looks = at(a)[0], at(b)[0], 2
    while high - low > 1e-7:
        if fa >= fb:
            high, b, fb = b, a, fa
            a = high - golden * (high - low)
            fa = at(a)[0]
        else:
            low, a, fa = a, b, fb
            b = low + golden * (high - low)
            fb = at(b)[0]
        looks += 1
    ll, s2, t2, level, left = at((low + high) / 2)
    square = np.bincount(i, wyy - 2 * wy * level[j] + w * level[j] ** 2, k)
    rows = [("worker", name, x, None, y, h) for name, x, y, h in zip(workers, left, square, held)] + [("item", name, x, None, None, h) for name, x, h in zip(items, level, of_item)]
    return rows + _numbers(mu=(of_item * level).sum() / of_item.sum(), s2=s2, t2=max(t2, 1e-10), ll=ll, sweeps=looks, converged=1)


def crossed_logit(adaptive: bool, penalty: str | None, intercept: float, use_workers: bool, max_iter: int, tol: float) -> Callable[[pd.DataFrame], Rows]:
    """Penalised binomial logit by Newton steps; adaptive variances are the mean squared effects of their own optimum."""

    def solve(c: pd.DataFrame) -> Rows:
        i, workers = _index(c.Worker)
        j, items = _index(c.ItemKey)
        number = np.unique(c.RoundNo.to_numpy())
        h = np.searchsorted(number, c.RoundNo.to_numpy())
        y, n = c.y.to_numpy(float), c.n.to_numpy(float)
        k, m, q = len(workers), len(items), len(number)
        blocks = np.cumsum([0, 1, k, m, q])
        free = np.ones(blocks[-1])
        free[blocks[3]] = 0.0  # the first round is the reference
        if not use_workers:
            free[blocks[1] : blocks[2]] = 0.0

        def spread(x: np.ndarray) -> np.ndarray:
            return x[0] + x[blocks[1] : blocks[2]][i] + x[blocks[2] : blocks[3]][j] + x[blocks[3] :][h]

        def gather(x: np.ndarray) -> np.ndarray:
            return free * np.concatenate([[x.sum()], np.bincount(i, x, k), np.bincount(j, x, m), np.bincount(h, x, q)])

        def optimum(x: np.ndarray, ridge: np.ndarray) -> np.ndarray:
            def cost(z: np.ndarray) -> float:
                eta = spread(z)
                return float((n * np.logaddexp(0, eta) - y * eta).sum() + 0.5 * (ridge * z * z).sum())

            here = cost(x)
            for _ in range(60):
                p = 1 / (1 + np.exp(-np.clip(spread(x), -30, 30)))
                weight = np.maximum(n * p * (1 - p), 1e-8)
                slope = gather(y - n * p) - free * ridge * x
                step = _gradients(lambda d: gather(weight * spread(d)) + free * ridge * d, slope, np.where(free > 0, gather(weight) + ridge, 1.0))
                step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))
                there = cost(x + step)
                while there > here + 1e-12 * abs(here) and np.abs(step).max() > 1e-13:
                    step /= 2
                    there = cost(x + step)
                x, here = x + step, there
                if np.abs(step).max() < 1e-11:
                    break
            return x

        rate = np.clip(y.sum() / n.sum(), 1e-8, 1 - 1e-8) if adaptive else (y.sum() + 0.5) / (n.sum() + 1)
        x = np.zeros(blocks[-1])
        x[0] = np.log(rate / (1 - rate))
        tw = tg = 0.5 if adaptive else 1.0 / float(c[penalty].iloc[0])
        delta, looks = np.inf, 0
        while looks < max_iter and delta >= tol:
            ridge = np.concatenate([[intercept], np.full(k, 1 / max(tw, 1e-8)), np.full(m, 1 / max(tg, 1e-8)), np.full(q, 1.0 if adaptive else 1 / tg)])
            fresh, looks = optimum(x, ridge), looks + 1
            delta, x = sum(np.abs(fresh[a:b] - x[a:b]).max() for a, b in zip(blocks[:-1], blocks[1:])), fresh
            if not adaptive:
                delta = 0.0
                break
            own, group = (max(float((x[a:b] ** 2).mean()), 1e-8) for a, b in ((blocks[1], blocks[2]), (blocks[2], blocks[3])))
            delta += abs(own - tw) + abs(group - tg)
            tw, tg = own, group
        rows = [("worker", name, v, None, None, None) for name, v in zip(workers, x[blocks[1] : blocks[2]])]
        rows += [("item", name, v, None, None, None) for name, v in zip(items, x[blocks[2] : blocks[3]])]
        rows += [("round", str(int(name)), v, None, None, None) for name, v in zip(number, x[blocks[3] :])]
        return rows + _numbers(mu=x[0], tw=tw, tg=tg, Delta=delta, sweeps=looks, converged=float(delta < tol))

    return solve
