"""Entropic optimal transport, on batches of small dense problems."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FLOOR = 1e-8


@dataclass(frozen=True)
class Solver:
    """mode: sinkhorn or unbalanced, each with or without _divergence; the number of iterations is fixed."""

    mode: str = "unbalanced_divergence"
    epsilon: float = 0.1
    iterations: int = 30
    reg_m: float = 0.1

    def __post_init__(self):
        if self.mode.removesuffix("_divergence") not in ("sinkhorn", "unbalanced"):
            raise ValueError(f"unknown mode {self.mode}")
        if self.epsilon <= 0 or self.iterations <= 0 or self.reg_m <= 0:
            raise ValueError("epsilon, iterations and reg_m must be positive")

    @property
    def unbalanced(self) -> bool:
        return self.mode.startswith("unbalanced")

    @property
    def divergence(self) -> bool:
        return self.mode.endswith("_divergence")

    def prepare(self, x: np.ndarray) -> np.ndarray:
        """Measures with a floor; distributions where mass must balance."""
        x = np.maximum(np.asarray(x, float), FLOOR)
        return x if self.unbalanced else x / x.sum(-1, keepdims=True)


def uniform_cost(n: int) -> np.ndarray:
    return 1.0 - np.eye(n)


def vad_cost(vad: np.ndarray) -> np.ndarray:
    """Distances between prototypes over their mean, 0 on the diagonal."""
    c = np.sqrt(((vad[:, None] - vad[None]) ** 2).sum(-1) + 1e-12)
    off = ~np.eye(len(vad), dtype=bool)
    c = c / max(c[off].mean(), FLOOR)
    np.fill_diagonal(c, 0.0)
    return c


def cosine_cost(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    return np.clip((1 - x @ y.T) / 2, 0, 1)


def term_vad_cost(x: np.ndarray, y: np.ndarray, conf_x: np.ndarray, conf_y: np.ndarray, fill: float) -> np.ndarray:
    """Distance over the largest possible one, drawn to `fill` where confidence is missing."""
    d = np.clip(np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1)) / (2 * np.sqrt(3)), 0, 1)
    both = conf_x[:, None] * conf_y[None]
    return d * both + fill * (1 - both)


@dataclass(frozen=True)
class TermCost:
    """Cost between terms given as points (v, a, d, then an embedding, if any) and confidences.

    mode: vad, where missing confidence costs in full; embedding, half of one minus cosine; embedding_vad, alpha times the one and beta
    times the other, where missing confidence costs nothing.
    """

    mode: str = "vad"
    alpha: float = 0.5
    beta: float = 0.5

    def __post_init__(self):
        if self.mode not in ("vad", "embedding", "embedding_vad"):
            raise ValueError(f"unknown cost {self.mode}")

    def __call__(self, x: np.ndarray, y: np.ndarray, conf_x: np.ndarray, conf_y: np.ndarray) -> np.ndarray:
        if self.mode == "vad":
            return term_vad_cost(x[:, :3], y[:, :3], conf_x, conf_y, 1.0)
        near = cosine_cost(x[:, 3:], y[:, 3:])
        return near if self.mode == "embedding" else self.alpha * near + self.beta * term_vad_cost(x[:, :3], y[:, :3], conf_x, conf_y, 0.0)


def _log_sum(x: np.ndarray) -> np.ndarray:
    m = x.max(-1)
    return m + np.log(np.exp(x - m[..., None]).sum(-1))


#: Up to this ratio of cost to epsilon the iterations stay far from the ends of the floating range without logarithms.
SAFE = 30.0
#: Pairs of a shared kernel that are solved at once (about what a cache holds).
SHARED_PAIRS = 2048


def _scalings(a: np.ndarray, b: np.ndarray, kernel: np.ndarray, s: Solver) -> tuple[np.ndarray, np.ndarray]:
    """Scalings u [n, B] and v [m, B] of a kernel that all pairs share: two small matrix products an iteration.

    Pairs are the columns and steps are made in place, so each runs over long rows; powers are taken by logarithm, whose masses are
    taken once.
    """
    tau = s.reg_m / (s.reg_m + s.epsilon) if s.unbalanced else 1.0
    left, right = (np.ascontiguousarray(x.T) if tau == 1.0 else tau * np.log(x.T, order="C") for x in (a, b))
    u, v = np.empty_like(left), np.ones_like(right)
    for _ in range(s.iterations):
        for out, mass, k, other in ((u, left, kernel, v), (v, right, kernel.T, u)):
            np.matmul(k, other, out=out)
            if tau == 1.0:
                np.divide(mass, out, out=out)
            else:
                np.log(out, out=out)
                out *= -tau
                out += mass
                np.exp(out, out=out)
    return u, v


def plan(a: np.ndarray, b: np.ndarray, cost: np.ndarray, s: Solver) -> np.ndarray:
    """[B, n, m] plans between measures a [B, n] and b [B, m]; cost is [n, m] or [B, n, m]."""
    if cost.ndim == 2 and cost.max(initial=0.0) <= SAFE * s.epsilon:
        kernel = np.exp(-cost / s.epsilon)
        u, v = _scalings(a, b, kernel, s)
        return u.T[:, :, None] * kernel * v.T[:, None, :]
    k = -np.broadcast_to(cost, (len(a), a.shape[1], b.shape[1])) / s.epsilon
    kt = np.ascontiguousarray(np.swapaxes(k, -1, -2))
    tau = s.reg_m / (s.reg_m + s.epsilon) if s.unbalanced else 1.0
    log_a, log_b, v = np.log(a), np.log(b), np.zeros_like(b)
    for _ in range(s.iterations):
        u = tau * (log_a - _log_sum(k + v[:, None, :]))
        v = tau * (log_b - _log_sum(kt + u[:, None, :]))
    return np.exp(u[:, :, None] + k + v[:, None, :])


def _kl(p: np.ndarray, q: np.ndarray, axis: int = -1) -> np.ndarray:
    p, q = np.maximum(p, FLOOR), np.maximum(q, FLOOR)
    return (p * (np.log(p) - np.log(q)) - p + q).sum(axis)


def parts(a: np.ndarray, b: np.ndarray, cost: np.ndarray, s: Solver) -> dict[str, np.ndarray]:
    """transport, kl_a, kl_b, masses, total cost and plan of each pair."""
    p = plan(a, b, cost, s)
    out = {"plan": p, "transport": (p * cost).sum((-2, -1)), "mass_a": a.sum(-1), "mass_b": b.sum(-1), "mass_plan": p.sum((-2, -1))}
    out["kl_a"], out["kl_b"] = (_kl(p.sum(-1), a), _kl(p.sum(-2), b)) if s.unbalanced else (np.zeros(len(a)), np.zeros(len(a)))
    return out | {"cost": out["transport"] + (s.reg_m * (out["kl_a"] + out["kl_b"]) if s.unbalanced else 0)}


def costs(a: np.ndarray, b: np.ndarray, cost: np.ndarray, s: Solver, most_cells: int = 1 << 21) -> np.ndarray:
    """Cost of each pair, a bounded number of cells at a time; where all pairs share a kernel no plan is ever laid out."""
    if not len(a):
        return np.zeros(0)
    if cost.ndim == 2 and cost.max(initial=0.0) <= SAFE * s.epsilon:
        if len(a) > SHARED_PAIRS:
            return np.concatenate([costs(a[i : i + SHARED_PAIRS], b[i : i + SHARED_PAIRS], cost, s) for i in range(0, len(a), SHARED_PAIRS)])
        kernel = np.exp(-cost / s.epsilon)
        u, v = _scalings(a, b, kernel, s)
        out = (((kernel * cost).T @ u) * v).sum(0)
        return out + s.reg_m * (_kl(u * (kernel @ v), a.T, 0) + _kl(v * (kernel.T @ u), b.T, 0)) if s.unbalanced else out
    step = max(1, most_cells // (a.shape[1] * b.shape[1]))
    return np.concatenate([parts(a[i : i + step], b[i : i + step], cost, s)["cost"] for i in range(0, len(a), step)])


def self_costs(x: np.ndarray, cost: np.ndarray, s: Solver) -> np.ndarray:
    return costs(x, x, cost, s) if s.divergence else np.zeros(len(x))


def distances(a: np.ndarray, b: np.ndarray, self_a: np.ndarray, self_b: np.ndarray, cost: np.ndarray, s: Solver) -> np.ndarray:
    """Distance of each pair.  Divergences take off half of both self costs, and average both directions, as a fixed number of
    iterations leaves the plan short of symmetric."""
    if not s.divergence:
        return costs(a, b, cost, s)
    if a.shape == b.shape and np.array_equal(cost, np.swapaxes(cost, -1, -2)):  # both directions are pairs of one batch
        both = costs(np.concatenate([a, b]), np.concatenate([b, a]), cost, s).reshape(2, len(a)).sum(0)
    else:
        both = costs(a, b, cost, s) + costs(b, a, cost, s)
    return both / 2 - self_a / 2 - self_b / 2


#: What `screen` was tried for: settings, bins and values (the least ratio of distance to screen found was 0.608, see the README).
SCREEN_SOLVER, SCREEN_BINS, SCREEN_MOST = ("unbalanced_divergence", 0.1, 30, 0.5), 8, 1000.0 + 1e-6


def can_screen(cost: np.ndarray, s: Solver) -> bool:
    return (s.mode, s.epsilon, s.iterations, s.reg_m) == SCREEN_SOLVER and len(cost) <= SCREEN_BINS and np.array_equal(cost, uniform_cost(len(cost)))


def screen(a: np.ndarray, b: np.ndarray, s: Solver) -> np.ndarray:
    """[a, b]: the divergence of each pair if nothing moved between bins, as one matrix product.

    A bin's plan is then p = (a b) ** h with h = reg_m / (2 reg_m + epsilon), which costs reg_m (a + b - 2 p (1 + c ln(a b))).
    """
    h, c = s.reg_m / (2 * s.reg_m + s.epsilon), s.epsilon / (2 * s.reg_m + s.epsilon) / 2
    (pa, la), (pb, lb) = ((x**h, c * np.log(x)) for x in (a, b))
    alone = [(p * p * (1 + 2 * x)).sum(1) for p, x in ((pa, la), (pb, lb))]
    both = np.hstack([pa, pa * la]) @ np.hstack([pb * (1 + lb), pb]).T
    return s.reg_m * (alone[0][:, None] + alone[1][None, :] - 2 * both)


def screen_limit(distance: np.ndarray) -> np.ndarray:
    """The screen beyond which a pair is farther than distance.  Moving mass between bins at a cost of 1 saves at most 1/e of what it
    costs to make and destroy it there, for small epsilon; half is allowed for, and 1e-5 for the floor and the number of iterations."""
    return 2 * (np.maximum(distance, 0) + 1e-5)


def top_flows(p: np.ndarray, cost: np.ndarray, k: int, diagonal: bool = False) -> list[tuple[int, int, float, float]]:
    """Up to k cells (from, to, mass, contribution) of a plan by contribution, while it is positive."""
    c = p * cost
    if not diagonal and c.shape[0] == c.shape[1]:
        c = c - np.diag(np.diag(c))
    order = np.argsort(-c, axis=None, kind="stable")[:k]
    return [(int(i // c.shape[1]), int(i % c.shape[1]), float(p.flat[i]), float(c.flat[i])) for i in order if c.flat[i] > 0]


def exact(a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> float:
    """Least cost of moving distribution a to b (both of one mass), by successive cheapest paths; for a few dozen bins."""
    n, m = cost.shape
    supply, demand = a / a.sum(), b / b.sum()
    flow = np.zeros((n, m))
    while supply.max() > 1e-12:
        dist = np.concatenate([np.where(supply > 1e-12, 0.0, np.inf), np.full(m, np.inf)])
        came = np.full(n + m, -1)
        for _ in range(n + m):
            forward = dist[:n, None] + cost
            j = forward.argmin(0)
            better = forward[j, np.arange(m)] < dist[n:] - 1e-15
            dist[n:][better], came[n:][better] = forward[j, np.arange(m)][better], j[better]
            back = np.where(flow > 1e-15, dist[None, n:] - cost, np.inf)
            k = back.argmin(1)
            shorter = back[np.arange(n), k] < dist[:n] - 1e-15
            dist[:n][shorter], came[:n][shorter] = back[np.arange(n), k][shorter], n + k[shorter]
            if not better.any() and not shorter.any():
                break
        end = n + int(np.where(demand > 1e-12, dist[n:], np.inf).argmin())
        if not np.isfinite(dist[end]):
            break
        path = [end]
        while came[path[-1]] >= 0:
            path.append(int(came[path[-1]]))
        path.reverse()
        room = min(supply[path[0]], demand[end - n], *[flow[y, x - n] for x, y in zip(path[1::2], path[2::2], strict=False)])
        for x, y in zip(path, path[1:], strict=False):
            if x < n:
                flow[x, y - n] += room
            else:
                flow[y, x - n] -= room
        supply[path[0]] -= room
        demand[end - n] -= room
    return float((flow * cost).sum())


def loss(a: np.ndarray, b: np.ndarray, cost: np.ndarray, mode: str, **how) -> np.ndarray:
    """Transport of each pair by mode: emd, or one of the solver's."""
    if mode == "emd":
        return np.array([exact(np.maximum(x, FLOOR), np.maximum(y, FLOOR), cost) for x, y in zip(a, b, strict=True)])
    s = Solver(mode, **how)
    a, b = s.prepare(a), s.prepare(b)
    ab = costs(a, b, cost, s)
    return ab - self_costs(a, cost, s) / 2 - self_costs(b, cost, s) / 2 if s.divergence else ab
