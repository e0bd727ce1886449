"""Task-side helpers: what runs inside ``mapInArrow`` / ``applyInPandas``.

They are shipped by value, so executors need NumPy and Arrow but not this
package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: Numbers in one list of a partial result.
LIST = 1 << 16


def _cells(names: list[str], key: list[int], i: int, j0: int, rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row of a product matrix, in lists of bounded length."""
    for k in range(0, len(rows[0]), LIST):
        part = [r[k : k + LIST] for r in rows]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array([x], pa.int32()) for x in (*key, i, j0 + k)],
             *[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in part]], names)


def block_gram(low: int, high: int, columns: int):
    """Sum one task's cross products of ``[1, x...]`` per group: rows ``low`` to
    ``high`` of the matrix, from the diagonal on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows == 0:
                continue
            x, group = matrix(b.column("x"), columns), b.column("grp").to_numpy(zero_copy_only=False)
            complete = ~np.isnan(x).any(axis=1)
            z, group = np.column_stack([np.ones(complete.sum()), x[complete]]), group[complete]
            for g in np.unique(group):
                part = z[group == g]
                sums[int(g)] = sums.get(int(g), 0.0) + part[:, low:high].T @ part[:, low:]
        for g, m in sums.items():
            for i in range(low, high):
                yield from _cells(["grp", "i", "j0", "values"], [g], i, i, [m[i - low, i - low :]])

    return run


#: Sums of a column pair over the rows that have both: rows, x_i, x_j, their squares, their product.
PAIR_SUMS = ("n", "si", "sj", "qi", "qj", "p")


def block_pairs(low: int, high: int, columns: int):
    """Pairwise-complete sums of one task for the pairs of columns ``low`` to ``high`` with all later ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for b in batches:
            if b.num_rows == 0:
                continue
            raw = matrix(b.column("x"), columns)
            there = ~np.isnan(raw)
            x, m = np.where(there, raw, 0.0), there.astype(float)
            xi, mi, xj, mj = x[:, low:high], m[:, low:high], x[:, low:], m[:, low:]
            part = [mi.T @ mj, xi.T @ mj, mi.T @ xj, (xi * xi).T @ mj, mi.T @ (xj * xj), xi.T @ xj]
            sums = part if sums is None else [a + c for a, c in zip(sums, part)]
        if sums is not None:
            for i in range(low, min(high, columns - 1)):
                yield from _cells(["i", "j0", *PAIR_SUMS], [], i, i + 1, [s[i - low, i - low + 1 :] for s in sums])

    return run


def matrix(values: pa.Array, columns: int) -> np.ndarray:
    """Rows of a list column as a matrix; missing readings are NaN."""
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, columns)


def linear_fits(x: np.ndarray, weights: np.ndarray, used: np.ndarray, intercepts: np.ndarray) -> np.ndarray:
    """Predictions of all models, a column each. ``used`` marks the features a
    model knows: a missing one makes its prediction NaN."""
    gone = np.isnan(x)
    if not gone.any():
        return x @ weights + intercepts
    out = np.where(gone, 0.0, x) @ weights + intercepts
    out[gone.astype(float) @ used > 0] = np.nan
    return out


def fits_of(weights: np.ndarray, used: np.ndarray, intercepts: np.ndarray):
    """A column function: the list of a row's features to the list of its predictions."""

    def run(values: pa.Array) -> pa.Array:
        out = linear_fits(matrix(values, len(weights)), weights, used, intercepts)
        ends = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel(), from_pandas=True))

    return run


def score_sums(weights: np.ndarray, used: np.ndarray, intercepts: np.ndarray, shift: float):
    """Sums of one task by split and model from ``split, y, x``: rows, squared
    and absolute errors, and the label less ``shift`` with its square."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, np.ndarray] = {}
        for b in batches:
            if b.num_rows == 0:
                continue
            y = b.column("y").to_numpy(zero_copy_only=False).astype(float)
            e = y[:, None] - linear_fits(matrix(b.column("x"), len(weights)), weights, used, intercepts)
            there = ~np.isnan(e)
            e, moved = np.where(there, e, 0.0), np.where(there, (y - shift)[:, None], 0.0)
            split = b.column("split").dictionary_encode()
            codes = split.indices.fill_null(-1).to_numpy()
            for code in np.unique(codes):
                mine = codes == code
                part = np.stack([f[mine].sum(axis=0) for f in (there, e * e, np.abs(e), moved, moved * moved)])
                name = split.dictionary[code].as_py() if code >= 0 else None
                sums[name] = sums.get(name, 0.0) + part
        for name, part in sums.items():
            models = part.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * models, pa.string()), pa.array(np.arange(models, dtype=np.int32)), pa.array(part[0].astype(np.int64)),
                 *[pa.array(row) for row in part[1:]]], ["split", "at", "n", "rss", "sae", "sy", "syy"])

    return run


def whole_rows(x: np.ndarray) -> np.ndarray:
    """The rows without a missing reading."""
    gone = np.isnan(x).any(axis=1)
    return x[~gone] if gone.any() else x


def complete_lists(columns: int):
    """The rows of ``x`` without a missing reading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                there = ~np.isnan(matrix(b.column("x"), columns)).any(axis=1)
                yield b if there.all() else b.filter(pa.array(there))

    return run


def normal_product(shipped):
    """One task's part of ``X'(X V)``, or of ``X'y`` without directions ``V``,
    over the rows without a missing reading. ``shipped`` holds the centre and
    unit of every column, the label last, and ``V``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, units, v = shipped.value
        total = None
        for b in batches:
            if b.num_rows:
                z = (whole_rows(matrix(b.column("x"), len(centre))) - centre) / units
                x = z[:, :-1]
                part = x.T @ (z[:, -1:] if v is None else x @ v)
                total = part if total is None else total + part
        flat = np.zeros(0) if total is None else total.ravel()
        for k in range(0, len(flat), LIST):
            part = flat[k : k + LIST]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.array(part))], ["start", "values"])

    return run


def centred(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Row count, means and centred cross products of ``[x..., y]``."""
    n = m[0, 0]
    mean = m[0, 1:] / n
    return n, mean, m[1:, 1:] - n * np.outer(mean, mean)


def ridge_path(train: np.ndarray, alphas: np.ndarray) -> np.ndarray:
    """Row per alpha: intercept, then coefficients of ``|y-Xb|^2 + a|b|^2``."""
    _, mean, c = centred(train)
    roots, vectors = np.linalg.eigh(c[:-1, :-1])
    turned = vectors.T @ c[:-1, -1]
    roots = np.maximum(roots, 0.0)
    betas = np.array([vectors @ (turned / (roots + a)) for a in alphas])
    return np.column_stack([mean[-1] - betas @ mean[:-1], betas])


def net_path(train: np.ndarray, alphas: np.ndarray, ratio: float, max_iter: int, tol: float) -> tuple[np.ndarray, list[tuple[int, bool, float]]]:
    """Row per alpha (given in falling order): intercept, then coefficients of
    ``|y-Xb|^2/(2n) + a*ratio*|b|_1 + a*(1-ratio)/2*|b|^2``, by cyclic
    coordinate descent on the centred cross products, each alpha starting from
    the previous solution. And per alpha: sweeps, whether they settled, and how
    far the solution is from the optimality conditions."""
    n, mean, c = centred(train)
    gram, target = c[:-1, :-1] / n, c[:-1, -1] / n
    spread = np.diag(gram).copy()
    usable = np.flatnonzero(spread > 1e-12 * max(spread.max(initial=0.0), 1e-300))
    beta, left = np.zeros(len(target)), target.copy()
    stop = tol * np.sqrt(max(c[-1, -1] / n, 1e-300))
    out, progress = [], []
    for a in alphas:
        settled = False
        for sweep in range(max_iter):
            # full sweeps find the active set, the ones between polish it
            full = sweep % 10 == 0
            moved = 0.0
            for j in usable if full else np.flatnonzero(beta):
                pull = left[j] + spread[j] * beta[j]
                new = np.sign(pull) * max(abs(pull) - a * ratio, 0.0) / (spread[j] + a * (1.0 - ratio))
                step = new - beta[j]
                if step != 0.0:
                    left -= gram[:, j] * step
                    beta[j] = new
                    moved = max(moved, abs(step) * np.sqrt(spread[j]))
            if full and moved <= stop:
                settled = True
                break
        slope = left - a * (1.0 - ratio) * beta
        off = np.where(beta != 0, np.abs(slope - a * ratio * np.sign(beta)), np.maximum(np.abs(slope) - a * ratio, 0.0))
        progress.append((sweep + 1, settled, float(off[usable].max(initial=0.0))))
        out.append(np.concatenate([[mean[-1] - beta @ mean[:-1]], beta]))
    return np.array(out), progress


def held_out_sse(test: np.ndarray, fit: np.ndarray) -> float:
    """Squared error of a fit on the rows behind ``test``, from their sums."""
    w = np.concatenate([fit, [-1.0]])
    return float(max(w @ test @ w, 0.0))


def path_task(shipped, solver: str, max_iter: int, tol: float):
    """Solver for one ``(held, ratio)`` group of the search grid.

    ``shipped`` is a broadcast ``{fold: cross products}``. ``held = -1`` fits
    all rows and returns coefficients; otherwise the fold is left out and its
    error is returned.
    """

    def solve(pdf):
        import pandas as pd

        pdf = pdf.sort_values("alpha_no")
        folds = shipped.value
        held, ratio = int(pdf["held"].iloc[0]), float(pdf["ratio"].iloc[0])
        train = sum(m for g, m in folds.items() if g != held)
        alphas = pdf["alpha"].to_numpy()
        if solver == "ridge":
            path, progress = ridge_path(train, alphas), [(0, True, 0.0)] * len(alphas)
        else:
            path, progress = net_path(train, alphas, ratio, max_iter, tol)
        mse = [None] * len(path)
        if held >= 0:
            test = folds[held]
            mse = [held_out_sse(test, fit) / test[0, 0] for fit in path]
        return pd.DataFrame({
            "held": held,
            "ratio": ratio,
            "alpha_no": pdf["alpha_no"].to_numpy(),
            "alpha": alphas,
            "mse": mse,
            "fit": [fit.tolist() if held < 0 else None for fit in path],
            **{name: list(values) for name, values in zip(("n_iter", "converged", "off_optimum"), zip(*progress))},
        })

    return solve


def leave_one_out_task(total: np.ndarray, alphas: list[float]):
    """Per-task sums of squared leave-one-out ridge errors, one per alpha:
    the residual over one minus the row's leverage."""
    n, mean, c = centred(total)
    roots, vectors = np.linalg.eigh(c[:-1, :-1])
    inverse = 1.0 / (np.maximum(roots, 0.0)[:, None] + np.array(alphas)[None, :])
    weights = (vectors.T @ c[:-1, -1])[:, None] * inverse

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sse = np.zeros(len(alphas))
        for b in batches:
            z = np.column_stack([x.to_numpy(zero_copy_only=False) for x in b.columns]).astype(float)
            z = z[~np.isnan(z).any(axis=1)] - mean
            turned = z[:, :-1] @ vectors
            leverage = 1.0 / n + (turned * turned) @ inverse
            error = (z[:, -1:] - turned @ weights) / (1.0 - leverage)
            sse += (error * error).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([sse.tolist()], pa.list_(pa.float64()))], ["sse"])

    return sums


def _places(batch: pa.RecordBatch, seen: dict[str, int]) -> np.ndarray:
    """Row number of each row within its file's first block, -1 beyond it.
    ``seen`` counts the rows of each file that earlier batches held."""
    file = batch.column("_file").dictionary_encode()
    codes, first = file.indices.to_numpy(), batch.column("_first").to_numpy(zero_copy_only=False)
    out = np.full(batch.num_rows, -1, np.int64)
    for code, name in enumerate(file.dictionary.to_pylist()):
        mine = np.flatnonzero((codes == code) & first)
        out[mine] = seen.get(name, 0) + np.arange(len(mine))
        seen[name] = seen.get(name, 0) + len(mine)
    return out


def after_header(cols: list[str], n_header: int):
    """Rows without the first ``n_header`` of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for b in batches:
            if b.num_rows:
                place = _places(b, seen)
                yield b.select(cols).filter(pa.array((place < 0) | (place >= n_header)))

    return run


def header_rows(cols: list[str], n_header: int):
    """The first ``n_header`` rows of each file, numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for b in batches:
            if b.num_rows:
                place = _places(b, seen)
                head = pa.array((place >= 0) & (place < n_header))
                rows = b.filter(head)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("_file"), pa.array(place, pa.int32()).filter(head), *[rows.column(c) for c in cols]], ["_file", "_row", *cols])

    return run
