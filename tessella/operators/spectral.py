"""Spectral and dynamical operators.

Matrices are edge tables. A product with a state is one join and one aggregate
(``spmv``); eigenpairs of up to ``DENSE`` nodes are computed densely on the driver, larger
ones by subspace iteration. Its products run on the driver for up to ``LOCAL_EDGES`` edges,
where a round of jobs costs far more than the sum itself, and stay in Spark above; the
projected problem is small.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

DENSE = 3000
LOCAL_EDGES, DEGREE, ROOM = 2_000_000, 10, 1e-3


def normalized_adjacency(edges: DataFrame) -> DataFrame:
    """(src, dst, w) of D^-1/2 A D^-1/2; rows of zero degree stay empty."""
    d = edges.groupBy("src").agg(F.sum("weight").alias("degree")).filter("degree > 0")
    a, b = d.select("src", F.col("degree").alias("da")), d.select(F.col("src").alias("dst"), F.col("degree").alias("db"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", (F.col("weight") / F.sqrt(F.col("da") * F.col("db"))).alias("w"))


def spmv(matrix: DataFrame, state: DataFrame) -> DataFrame:
    """(id, xs): matrix times a batch of states held as arrays."""
    width = len(state.select("xs").first()["xs"])
    terms = matrix.join(state, matrix.dst == state.id).select(matrix.src.alias("id"), *[(F.col("w") * F.col("xs")[i]).alias(f"x{i}") for i in range(width)])
    return terms.groupBy("id").agg(*[F.sum(f"x{i}").alias(f"x{i}") for i in range(width)]).select("id", F.array(*[f"x{i}" for i in range(width)]).alias("xs"))


def _dense(matrix: DataFrame, ids: list[int]) -> np.ndarray:
    place = {v: i for i, v in enumerate(ids)}
    out = np.zeros((len(ids), len(ids)))
    for r in matrix.collect():
        out[place[r["src"]], place[r["dst"]]] += r["w"]
    return (out + out.T) / 2


def _subspace(matrix: pa.Table, ids: np.ndarray, block: np.ndarray, k: int, iterations: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The iteration of ``top_eigenpairs`` over sorted ``ids``, from ``block`` on.

    A step is a Chebyshev polynomial of degree ``DEGREE``, small from -1 to the block's last
    value, so that values close to each other part in far fewer steps than by plain products.
    A block of nothing but the first value (of a graph of many components) would leave no
    room above the last one, so ``ROOM`` is kept.
    """
    src, dst, w = np.searchsorted(ids, matrix["src"].to_numpy()), np.searchsorted(ids, matrix["dst"].to_numpy()), matrix["w"].to_numpy()
    product = lambda x: np.stack([np.bincount(src, w * c[dst], len(ids)) for c in np.ascontiguousarray(x.T)], axis=1)
    values = np.zeros(block.shape[1])
    for _ in range(iterations):
        last = max(min(values[-1], values[0] - ROOM), -0.5)
        middle, half = (last - 1) / 2, (last + 1) / 2
        before, now = block, (product(block) - middle * block) / half
        for _ in range(DEGREE - 1):
            before, now = now, 2 * (product(now) - middle * now) / half - before
        block = np.linalg.qr(now)[0]
        image = product(block)
        inner = block.T @ image
        new, basis = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-new)
        block, image = block @ basis[:, order], image @ basis[:, order]
        moved, values = np.abs(new[order][:k] - values[:k]).max(), new[order]
        # values may also stand still because they hardly move at all
        rest = np.linalg.norm(image[:, :k] - block[:, :k] * values[:k], axis=0).max()
        if moved < tolerance and rest < 10 * tolerance:
            return values, block
    raise RuntimeError(f"eigenvalues did not settle in {iterations} iterations")


def top_eigenpairs(edges: DataFrame, k: int, iterations: int = 200, tolerance: float = 1e-8) -> tuple[np.ndarray, DataFrame]:
    """Largest algebraic eigenvalues of the normalised adjacency, falling, and (id, coords).

    Values that still move by more than ``tolerance`` after ``iterations`` raise.
    """
    spark = edges.sparkSession
    matrix = materialize(normalized_adjacency(edges), "operator")
    nodes = matrix.select(F.col("src").alias("id")).union(matrix.select("dst")).distinct()
    n = nodes.count()
    k = min(k, max(1, n - 1))
    if n <= DENSE:
        ids = sorted(r["id"] for r in nodes.collect())
        values, vectors = np.linalg.eigh(_dense(matrix, ids)) if ids else (np.zeros(0), np.zeros((0, 0)))
        order = np.argsort(-values, kind="stable")[:k]
        rows = [(i, v.tolist()) for i, v in zip(ids, vectors[:, order], strict=True)]
        return values[order], spark.createDataFrame(rows, "id long, coords array<double>")
    width = k + 8
    draw = lambda j: F.xxhash64("id", F.lit(j)) / float(1 << 63)
    if matrix.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES:
        # Arrow tables, which need no setting of the session
        first = nodes.select("id", *[draw(j).alias(f"x{j}") for j in range(width)]).orderBy("id").toArrow()
        start = np.stack([first[f"x{j}"].to_numpy() for j in range(width)], axis=1)
        values, block = _subspace(matrix.toArrow(), first["id"].to_numpy(), start, k, iterations, tolerance)
        ends = pa.array(np.arange(len(block) + 1) * k, pa.int32())
        coords = pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(block[:, :k]).ravel()))
        return values[:k], spark.createDataFrame(pa.table({"id": first["id"], "coords": coords}), "id long, coords array<double>")
    state = materialize(nodes.select("id", F.array(*[draw(j) for j in range(width)]).alias("xs")), "block")

    def gram(a: DataFrame, b: DataFrame) -> np.ndarray:
        j = a.select("id", F.col("xs").alias("l")).join(b.select("id", F.col("xs").alias("r")), "id")
        row = j.agg(*[F.sum(F.col("l")[p] * F.col("r")[q]).alias(f"g{p}_{q}") for p in range(width) for q in range(width)]).first()
        return np.array(list(row)).reshape(width, width)

    def rotate(a: DataFrame, m: np.ndarray) -> DataFrame:
        parts = [sum((F.col("xs")[i] * float(m[i, j]) for i in range(1, width)), F.col("xs")[0] * float(m[0, j])) for j in range(m.shape[1])]
        return a.select("id", F.array(*parts).alias("xs"))

    values = np.zeros(width)
    for _ in range(iterations):
        # (S + I) / 2 keeps the algebraic order of eigenvalues in [-1, 1]
        shifted = spmv(matrix, state).select("id", F.col("xs").alias("ys")).join(state, "id", "right")
        half = F.transform(F.arrays_zip(F.coalesce("ys", F.transform("xs", lambda _: F.lit(0.0))).alias("a"), F.col("xs").alias("b")), lambda z: (z["a"] + z["b"]) / 2)
        state = materialize(shifted.select("id", half.alias("xs")), "block")
        chol = np.linalg.cholesky(gram(state, state) + 1e-14 * np.eye(width))
        state = materialize(rotate(state, np.linalg.inv(chol).T), "block")
        inner = gram(state, spmv(matrix, state))
        new, basis = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-new)
        state = materialize(rotate(state, basis[:, order]), "block")
        moved, values = np.abs(new[order][:k] - values[:k]).max(), new[order]
        if moved < tolerance:
            break
    else:
        raise RuntimeError(f"eigenvalues did not settle in {iterations} iterations")
    return values[:k], state.select("id", F.slice("xs", 1, k).alias("coords"))


def critical_beta(eigenvalues: np.ndarray, alpha: float = 1.0, margin: float = 0.05) -> tuple[float | None, float, bool]:
    """(target eigenvalue, beta, clipped): Perron values within 1e-8 of 1 are dropped first."""
    rest = [v for v in eigenvalues if abs(v - 1) > 1e-8 and v > 0]
    if not rest:
        return None, alpha - margin, True
    target = max(rest)
    beta = (alpha - margin) / target
    return target, min(beta, alpha - margin), beta > alpha - margin


def slow_mode_count(eigenvalues: np.ndarray, alpha: float, beta: float) -> tuple[int, bool]:
    """Modes before the largest gap; whether eigenvalue and timescale gaps agree."""
    lam = np.asarray(eigenvalues)
    by_value = int(np.argmax(np.abs(np.diff(lam)))) + 1
    rate = alpha - beta * lam
    tau = np.log1p(np.where(rate > 0, 1 / np.where(rate > 0, rate, 1), 0))
    by_time = int(np.argmax(np.abs(np.diff(tau)))) + 1
    return by_value, by_value == by_time


def slow_embedding(vectors: np.ndarray, r: int, tau: np.ndarray | None = None) -> np.ndarray:
    """Columns 1..r; the first is dropped by position. Infinite times weigh 0."""
    out = np.asarray(vectors)[:, 1 : r + 1]
    return out if tau is None else out * np.where(np.isfinite(tau[1 : r + 1]), tau[1 : r + 1], 0)


def subspace_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Root of the summed squared sines of the principal angles."""
    s = np.linalg.svd(np.linalg.qr(a)[0].T @ np.linalg.qr(b)[0], compute_uv=False)
    return float(math.sqrt(max(0.0, float(np.sum(1 - np.clip(s, 0, 1) ** 2)))))


def linear_dynamics(values: np.ndarray, vectors: np.ndarray, start: np.ndarray, times: np.ndarray, alpha: float, beta: float) -> np.ndarray:
    """exp(t (-alpha I + beta S)) x for all times, in the modal form of a full spectrum."""
    c = vectors.T @ start
    return np.exp(np.outer(times, -alpha + beta * values)) * c @ vectors.T


def nonlinear_dynamics(s: np.ndarray, start: np.ndarray, law: str, alpha: float, beta: float, gain: float, step: float, steps: int) -> np.ndarray:
    """Runge-Kutta trajectories of the cubic or tanh law; a non-finite state raises."""
    laws = {"cubic": lambda x: -alpha * x + beta * (s @ x) - gain * x**3, "tanh": lambda x: -alpha * x + beta * (s @ np.tanh(x)), "linear": lambda x: -alpha * x + beta * (s @ x)}
    f, x, out = laws[law], start.astype(float), [start.astype(float)]
    for _ in range(steps):
        a = f(x)
        b = f(x + step / 2 * a)
        c = f(x + step / 2 * b)
        d = f(x + step * c)
        x = x + step / 6 * (a + 2 * b + 2 * c + d)
        if not np.isfinite(x).all():
            raise FloatingPointError("the trajectory left the finite numbers")
        out.append(x)
    return np.array(out)


def relative_error(x: np.ndarray, y: np.ndarray) -> float:
    """|x - y| / |x|; 0 for 0/0, infinite for x = 0 and y not."""
    top, base = float(np.linalg.norm(x - y)), float(np.linalg.norm(x))
    return (0.0 if top == 0 else math.inf) if base == 0 else top / base


def reconstruction_error(states: np.ndarray, basis: np.ndarray) -> tuple[float, float]:
    """(relative RMSE, NRMSE by range) of states projected on an orthonormalised basis."""
    q = np.linalg.qr(basis)[0]
    rest = states - states @ q @ q.T
    rmse = float(np.sqrt((rest**2).mean()))
    spread = float(states.max() - states.min())
    return relative_error(states, states @ q @ q.T), rmse / spread if spread else 0.0


def perturbations(n: int, degrees: np.ndarray, seed: int = 0, fraction: float = 0.1) -> dict[str, np.ndarray]:
    """Single-node, Gaussian, random sparse (ceil(n * fraction)) and hub starts of unit norm."""
    random = np.random.default_rng(seed)
    single = np.zeros(n)
    single[0] = 1
    sparse = np.zeros(n)
    sparse[random.choice(n, math.ceil(n * fraction), replace=False)] = 1
    hub = np.zeros(n)
    hub[int(np.argmax(degrees))] = 1
    gauss = random.normal(size=n)
    return {k: v / np.linalg.norm(v) for k, v in {"single": single, "gaussian": gauss, "sparse": sparse, "hub": hub}.items()}


def spectral_summary(values: np.ndarray, alpha: float = 1.0, margin: float = 0.05) -> dict[str, float | int | bool | None]:
    """Gap, synchronizability, coupling and slow-mode count of a falling spectrum of S.

    Synchronizability is the largest over the second smallest Laplacian eigenvalue
    (1 - lambda), null where the latter is at most 1e-14.
    """
    lam = np.asarray(values, float)
    target, beta, clipped = critical_beta(lam, alpha, margin)
    second = 1 - lam[1] if len(lam) > 1 else 0.0
    count, agree = slow_mode_count(lam, alpha, beta) if len(lam) > 1 else (len(lam), True)
    return {
        "gap": float(lam[0] - lam[1]) if len(lam) > 1 else None,
        "synchronizability": float((1 - lam[-1]) / second) if second > 1e-14 else None,
        "target": None if target is None else float(target), "beta": float(beta), "clipped": bool(clipped), "slow_modes": int(count), "gaps_agree": bool(agree),
    }


def bounded_matrix(edges: DataFrame) -> tuple[list[int], np.ndarray]:
    """(ids, S) of a graph of at most ``DENSE`` nodes; a larger one raises."""
    matrix = materialize(normalized_adjacency(edges), "operator")
    nodes = matrix.select(F.col("src").alias("id")).union(matrix.select("dst")).distinct()
    if nodes.limit(DENSE + 1).count() > DENSE:
        raise ValueError(f"over {DENSE} nodes: use top_eigenpairs and spmv")
    ids = sorted(r["id"] for r in nodes.collect())
    return ids, _dense(matrix, ids)


def evaluate_transition(edges: DataFrame, labels: DataFrame, times: np.ndarray | None = None, alpha: float = 1.0, after: float = 0.5) -> dict[str, float | int | None]:
    """One contraction step: what the block means of the fine dynamics lose.

    The coarse graph follows the same law with the coupling of the fine one. Errors are
    means over the perturbations; the slow error compares both on the fine slow modes,
    the late one from the first time at or after ``after`` of the span. All nodes carry a
    label. With under three nodes on a side the errors are null.
    """
    ids, s = bounded_matrix(edges)
    of = {r["node"]: r["label"] for r in labels.select("node", "label").collect()}
    groups = sorted({of[i] for i in ids})
    member = np.zeros((len(ids), len(groups)))
    for row, i in enumerate(ids):
        member[row, groups.index(of[i])] = 1
    mean = member / member.sum(axis=0)  # restriction; ``member`` itself lifts
    la, lb = labels.select(F.col("node").alias("src"), F.col("label").alias("a")), labels.select(F.col("node").alias("dst"), F.col("label").alias("b"))
    quotient = edges.join(la, "src").join(lb, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight"))
    coarse_ids, coarse = bounded_matrix(quotient)
    out = {"fine": len(ids), "coarse": len(groups), "reduction": 1 - len(groups) / max(1, len(ids)), "r_fine": None, "r_coarse": None, "subspace": None, "eigenvalue": None, "full_error": None, "slow_error": None, "late_error": None}
    if min(len(ids), len(groups)) < 3 or coarse_ids != groups:
        return out
    values, vectors = (x[..., ::-1] for x in np.linalg.eigh(s))
    cvalues, cvectors = (x[..., ::-1] for x in np.linalg.eigh(coarse))
    beta = critical_beta(values, alpha)[1]
    r, rc = slow_mode_count(values, alpha, beta)[0], slow_mode_count(cvalues, alpha, beta)[0]
    basis = slow_embedding(vectors, r)
    width = min(r, rc)
    t = np.linspace(0, 10, 21) if times is None else times
    late = int(np.searchsorted(t, t[0] + after * (t[-1] - t[0]) - 1e-12))
    q = np.linalg.qr(basis)[0]
    errors = []
    for start in perturbations(len(ids), np.count_nonzero(s, axis=1)).values():
        x = linear_dynamics(values, vectors, start, t, alpha, beta)
        y = linear_dynamics(cvalues, cvectors, mean.T @ start, t, alpha, beta) @ member.T
        errors.append((relative_error(x, y), relative_error(x @ q, y @ q), relative_error(x[late:], y[late:])))
    paired = min(len(values), len(cvalues))
    full, slow, rest = np.mean(errors, axis=0)
    return out | {
        "r_fine": r, "r_coarse": rc, "subspace": subspace_distance(basis[:, :width], member @ slow_embedding(cvectors, rc)[:, :width]),
        "eigenvalue": float(np.abs(values[1:paired] - cvalues[1:paired]).max()), "full_error": float(full), "slow_error": float(slow), "late_error": float(rest),
    }


LAWS = ("linear", "cubic", "tanh")
LAW_ROW = "level long, law string, fine long, coarse long, r long, beta double, full_error double, late_error double, slow_error double, rank_r_error double, max_state double"


def compare_laws(edges: DataFrame, found: DataFrame, targets: list[int], alpha: float = 1.0, gain: float = 1.0, after: float = 0.5, steps: int = 40, step: float = 0.25) -> DataFrame:
    """``LAW_ROW`` rows: three laws on the levels of a hierarchy (level, node, cluster) nearest to the targets.

    Each level is compared with the next one: the fine law from the perturbations, the
    coarse one from their block means with the same coupling, lifted back. ``late`` starts at
    floor(after * steps). Levels over ``DENSE`` nodes raise.
    """
    from .iterative import pick_levels

    found = materialize(found, "hierarchy")
    sizes = {r["level"]: r["n"] for r in found.groupBy("level").agg(F.count_distinct("cluster").alias("n")).collect()}
    rows = []
    for level in sorted(pick_levels(sizes, targets)[0]):
        own = found.filter(F.col("level") == level).select("node", F.col("cluster").alias("c"))
        a, b = own.select(F.col("node").alias("src"), F.col("c").alias("a")), own.select(F.col("node").alias("dst"), F.col("c").alias("b"))
        fine = materialize(edges.join(a, "src").join(b, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight")), "fine")
        up = materialize(own.join(found.filter(F.col("level") == level + 1).select("node", F.col("cluster").alias("label")), "node").select(F.col("c").alias("node"), "label").distinct(), "up")
        la, lb = up.select(F.col("node").alias("src"), F.col("label").alias("a")), up.select(F.col("node").alias("dst"), F.col("label").alias("b"))
        ids, s = bounded_matrix(fine)
        groups, coarse = bounded_matrix(fine.join(la, "src").join(lb, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight")))
        of = {r["node"]: r["label"] for r in up.collect()}
        place = {g: i for i, g in enumerate(groups)}
        member = np.zeros((len(ids), len(groups)))
        member[range(len(ids)), [place[of[i]] for i in ids]] = 1
        values, vectors = (x[..., ::-1] for x in np.linalg.eigh(s))
        beta = critical_beta(values, alpha)[1]
        r = slow_mode_count(values, alpha, beta)[0]
        basis = slow_embedding(vectors, r)
        starts = list(perturbations(len(ids), np.count_nonzero(s, axis=1)).values())
        late = math.floor(after * steps)
        for law in LAWS:
            x = np.array([nonlinear_dynamics(s, v, law, alpha, beta, gain, step, steps) for v in starts])
            y = np.array([nonlinear_dynamics(coarse, member.T @ v / member.sum(axis=0), law, alpha, beta, gain, step, steps) for v in starts]) @ member.T
            whole, kept = float(np.linalg.norm(x)) ** 2, float(np.linalg.norm(x @ basis)) ** 2
            rank_r = math.sqrt(max(0.0, whole - kept) / whole) if whole else 0.0
            rows.append((level, law, len(ids), len(groups), r, float(beta), relative_error(x, y), relative_error(x[:, late:], y[:, late:]), relative_error(x @ basis, y @ basis), rank_r, float(np.abs(x).max())))
    return edges.sparkSession.createDataFrame(rows, LAW_ROW)


def perturbation_report(edges: DataFrame, seed: int = 0, alpha: float = 1.0) -> DataFrame:
    """(kind, r, rmse, nrmse): how much of the linear dynamics of each perturbation the slow modes hold."""
    ids, s = bounded_matrix(edges)
    values, vectors = (x[..., ::-1] for x in np.linalg.eigh(s))
    beta = critical_beta(values, alpha)[1]
    r = slow_mode_count(values, alpha, beta)[0]
    rows = []
    for kind, start in perturbations(len(ids), np.count_nonzero(s, axis=1), seed).items():
        states = linear_dynamics(values, vectors, start, np.linspace(0, 10, 21), alpha, beta)
        rows.append((kind, r, *(round(e, 9) for e in reconstruction_error(states, slow_embedding(vectors, r)))))
    return edges.sparkSession.createDataFrame(rows, "kind string, r int, rmse double, nrmse double")


def slow_coordinates(edges: DataFrame, r: int) -> DataFrame:
    """(id, coords): slow-mode coordinates of all nodes, the first mode dropped by position."""
    return top_eigenpairs(edges, r + 1)[1].select("id", F.slice("coords", 2, r).alias("coords"))


def angles(a: DataFrame, b: DataFrame) -> tuple[np.ndarray, float]:
    """(principal angles in degrees, subspace distance) of two (id, coords) bases on the ids of both.

    Only the small matrices of inner products reach the driver.
    """
    j = materialize(a.select("id", F.col("coords").alias("x")).join(b.select("id", F.col("coords").alias("y")), "id"), "bases")
    one = j.select(F.size("x").alias("n"), F.size("y").alias("m")).first()

    def inner(p: str, n: int, q: str, m: int) -> np.ndarray:
        row = j.agg(*[F.sum(F.col(p)[i] * F.col(q)[k]).alias(f"g{i}_{k}") for i in range(n) for k in range(m)]).first()
        return np.array(list(row), float).reshape(n, m)

    whiten = lambda g: np.linalg.inv(np.linalg.cholesky(g)).T
    left, right = whiten(inner("x", one["n"], "x", one["n"])), whiten(inner("y", one["m"], "y", one["m"]))
    s = np.clip(np.linalg.svd(left.T @ inner("x", one["n"], "y", one["m"]) @ right, compute_uv=False), 0, 1)
    return np.degrees(np.arccos(s)), float(math.sqrt(max(0.0, float(np.sum(1 - s**2)))))
