"""Cross-product matrices in one pass over the rows.

Every least-squares fit, VIF, condition number and correlation matrix below
is a function of small sums over rows. Those sums are taken where the rows
are; only feature-by-feature matrices travel.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.functions import kernels
from loomstat.functions.exprs import balanced_sum, literal_array, nan_to_null, q
from loomstat.operators.clean import fit_scale, numeric_columns
from loomstat.session import local_rows

# up to this many columns the sums are plain aggregates inside codegen
NARROW = 8
#: Numbers of a product matrix that a task holds (per group); larger matrices are summed in row blocks by tasks of their own.
CELLS = 1 << 20


def row_blocks(size: int, cells: int = CELLS) -> list[tuple[int, int]]:
    """Row ranges of an upper triangle with at most ``cells`` numbers each (one row at least)."""
    out, low = [], 0
    while low < size:
        high = min(size, low + max(1, cells // (size - low)))
        out.append((low, high))
        low = high
    return out


@dataclass
class Moments:
    """Cross products of ``[1, features..., label]`` per group (fold).

    Columns enter as ``x - shift[x]``: sums of large raw values would lose the
    digits that small residuals are made of.
    """

    features: list[str]
    label: str
    groups: dict[int, np.ndarray]
    shift: dict[str, float] = field(default_factory=dict)

    @property
    def total(self) -> np.ndarray:
        return np.sum(list(self.groups.values()), axis=0)

    @property
    def n(self) -> float:
        return float(self.total[0, 0])

    def without(self, group: int) -> np.ndarray:
        return np.sum([m for g, m in self.groups.items() if g != group], axis=0)

    def restricted(self, features: Sequence[str]) -> "Moments":
        """The same sums for some of the features; no new pass is needed."""
        at = [0, *[1 + self.features.index(f) for f in features], len(self.features) + 1]
        return Moments(
            list(features), self.label, {g: m[np.ix_(at, at)] for g, m in self.groups.items()}, self.shift
        )

    def merged(self) -> "Moments":
        """The same sums over all groups together."""
        return Moments(self.features, self.label, {0: self.total}, self.shift)

    def scale(self) -> dict[str, tuple[float, float]]:
        """Mean and population standard deviation of each feature."""
        t = self.total
        mean = t[0, 1:-1] / t[0, 0]
        var = np.maximum(np.diag(t)[1:-1] / t[0, 0] - mean * mean, 0.0)
        # what is left of a constant column's squares is rounding
        var[var <= 1e-14 * np.diag(t)[1:-1] / t[0, 0]] = 0.0
        return {f: (self.shift.get(f, 0.0) + float(m), float(v) ** 0.5) for f, m, v in zip(self.features, mean, var)}

    def standardised(self) -> "Moments":
        """The sums of the standardised features and the centred label: an
        affine change of columns needs no new pass over the rows."""
        t, size = self.total, len(self.features) + 2
        change = np.eye(size)
        mean = t[0] / t[0, 0]
        for j, (_, std) in enumerate(self.scale().values(), start=1):
            change[j, j] = 1.0 / (std or 1.0)
            change[j, 0] = -mean[j] * change[j, j]
        change[-1, 0] = -mean[-1]
        label_mean = self.shift.get(self.label, 0.0) + float(mean[-1])
        shift = {**{f: 0.0 for f in self.features}, self.label: label_mean}
        return Moments(self.features, self.label, {g: change @ m @ change.T for g, m in self.groups.items()}, shift)

    def intercept(self, shifted: float, coefs: Mapping[str, float]) -> float:
        """Undo the shifts in a fitted constant."""
        back = sum(coefs[f] * self.shift.get(f, 0.0) for f in coefs)
        return shifted + self.shift.get(self.label, 0.0) - back


def gram_rows(
    df: DataFrame,
    cols: Sequence[str],
    by: str | None = None,
    shift: Mapping[str, float] | None = None,
    narrow: int = NARROW,
    cells: int = CELLS,
) -> DataFrame:
    """Upper triangle of the cross products of ``[1, cols...]`` as rows
    ``(grp, i, j, value)``, ``i <= j``; rows missing any of the columns do not count.

    Neither a task nor a row of the result nor the plan holds the whole matrix:
    wide ones are summed in row blocks of ``cells`` numbers, each by its own pass
    over the columns from the block on, and merged as a streaming sum of cells."""
    shift = shift or {}
    moved = {c: nan_to_null(q(c).cast("double")) - F.lit(float(shift.get(c, 0.0))) for c in cols}
    group = q(by).cast("int") if by else F.lit(0)
    if len(cols) <= narrow:
        names = [f"x{i}" for i in range(len(cols))]
        x = df.select(group.alias("grp"), *[moved[c].alias(n) for c, n in zip(cols, names)])
        x = x.where(balanced_sum([F.col(n) for n in names]).isNotNull())
        full = [F.lit(1.0), *[F.col(n) for n in names]]
        tri = [F.struct(F.lit(int(i)).alias("i"), F.lit(int(j)).alias("j"), F.sum(full[i] * full[j]).alias("value"))
               for i, j in zip(*np.triu_indices(len(full)))]
        return x.groupBy("grp").agg(F.array(*tri).alias("tri")).select("grp", F.inline("tri"))
    x = df.select(group.alias("grp"), F.array(*[moved[c] for c in cols]).alias("x"))
    parts = [x.mapInArrow(kernels.block_gram(low, high, len(cols)), "grp int, i int, j0 int, values array<double>")
             for low, high in row_blocks(len(cols) + 1, cells)]
    found = reduce(DataFrame.unionByName, parts).select("grp", "i", "j0", F.posexplode("values").alias("k", "value"))
    return found.groupBy("grp", "i", (F.col("j0") + F.col("k")).alias("j")).agg(F.sum("value").alias("value"))


def moments(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    by: str | None = None,
    shift: Mapping[str, float] | None = None,
    narrow: int = NARROW,
) -> Moments:
    """Collect the cross products (p x p numbers per group) for fitting.

    Without ``shift`` the column means are taken first. The solvers work on the
    driver, which therefore holds a few such matrices per group: some 3,000
    features in a 4 GB driver. Beyond, ``iterative.conjugate_gradient`` needs no
    matrix at all.
    """
    cols = [*features, label]
    if shift is None:
        shift = {c: mean for c, (mean, _) in fit_scale(df, cols).items()}
    size = len(cols) + 1
    cells = gram_rows(df, cols, by, shift, narrow).toArrow()
    grp, i, j, value = (cells.column(c).to_numpy() for c in ("grp", "i", "j", "value"))
    groups = {}
    for g in np.unique(grp):
        mine = grp == g
        m = np.zeros((size, size))
        m[i[mine], j[mine]] = m[j[mine], i[mine]] = value[mine]
        groups[int(g)] = m
    if not groups:
        raise ValueError("no complete rows to fit on")
    return Moments(list(features), label, groups, dict(shift))


def gram_frame(df: DataFrame, cols: Sequence[str], by: str | None = None, shift: Mapping[str, float] | None = None,
               narrow: int = NARROW) -> DataFrame:
    """Named cells ``(grp, col_i, col_j, value)``, ``i <= j``; the constant is
    called ``(intercept)``."""
    label = literal_array(["(intercept)", *cols], "array<string>")
    rows = gram_rows(df, cols, by, shift, narrow)
    return rows.select("grp", F.get(label, F.col("i")).alias("col_i"), F.get(label, F.col("j")).alias("col_j"), "value")


# ---------------------------------------------------------------- correlation


def corr_matrix(df: DataFrame, cols: Sequence[str] | None = None, cells: int = CELLS) -> DataFrame:
    """Pearson r of each column pair ``i < j`` over the rows where both are
    present: ``(i, j, col_i, col_j, n, r)``. No spread, or no such row, gives a
    null r. Wide tables are summed in row blocks, as in ``gram_rows``."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    x = df.select(F.array(*[
        nan_to_null(q(c).cast("double")) - F.lit(mean) for c, (mean, _) in fit_scale(df, cols).items()
    ]).alias("x"))
    names = kernels.PAIR_SUMS
    schema = "i int, j0 int, " + ", ".join(f"{c} array<double>" for c in names)
    parts = [x.mapInArrow(kernels.block_pairs(low, high, len(cols)), schema) for low, high in row_blocks(len(cols), cells)]
    rows = reduce(DataFrame.unionByName, parts).select("i", "j0", F.posexplode(F.arrays_zip(*names)).alias("k", "s"))
    sums = rows.groupBy("i", (F.col("j0") + F.col("k")).alias("j")).agg(*[F.sum(f"s.{c}").alias(c) for c in names])
    n = F.when(F.col("n") > 0, F.col("n"))
    var_i = F.col("qi") - F.col("si") * F.col("si") / n
    var_j = F.col("qj") - F.col("sj") * F.col("sj") / n
    cov = F.col("p") - F.col("si") * F.col("sj") / n
    # spread below the rounding noise of its own sum of squares counts as none
    spread = (var_i > F.col("qi") * 1e-14) & (var_j > F.col("qj") * 1e-14)
    r = F.when(spread, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(var_i * var_j))))
    label = literal_array(cols, "array<string>")
    return sums.select(
        "i", "j", F.get(label, F.col("i")).alias("col_i"), F.get(label, F.col("j")).alias("col_j"),
        F.col("n").cast("bigint").alias("n"), r.alias("r"))


def corr_with(pairs: DataFrame, label: str, itself: bool = True) -> DataFrame:
    """``(variable, r)`` of each column against ``label``."""
    other = F.when(F.col("col_i") == label, F.col("col_j")).otherwise(F.col("col_i"))
    out = pairs.where((F.col("col_i") == label) | (F.col("col_j") == label)).select(other.alias("variable"), "r")
    if itself:
        one = local_rows(pairs.sparkSession, [(label, 1.0)], "variable string, r double")
        out = out.unionByName(one)
    return out


def top_correlated(pairs: DataFrame, label: str, n: int = 18, itself: bool = True) -> DataFrame:
    """The ``n`` columns with the largest |r| to the label, signed r kept."""
    ranked = corr_with(pairs, label, itself).where(F.col("r").isNotNull())
    return ranked.orderBy(F.desc(F.abs("r")), F.col("variable") != label, "variable").limit(n)


def top_submatrix(pairs: DataFrame, label: str, n: int = 18) -> DataFrame:
    """Correlations among those columns. ``pairs`` has one row per column
    pair, so the name lookups are small joins."""
    names = top_correlated(pairs, label, n).select("variable")
    return pairs.join(names.withColumnRenamed("variable", "col_i"), "col_i", "left_semi").join(
        names.withColumnRenamed("variable", "col_j"), "col_j", "left_semi"
    ).select("col_i", "col_j", "n", "r")


def correlated_columns(pairs: DataFrame, threshold: float = 0.95, keep: Sequence[str] = ()) -> DataFrame:
    """Columns strongly correlated with any earlier column. Columns in
    ``keep`` (the label) neither fall nor knock out others; pass none of them
    to treat the label like every other column."""
    used = pairs.where(~F.col("col_i").isin(*keep) & ~F.col("col_j").isin(*keep)) if keep else pairs
    return used.where(F.abs("r") > threshold).select(F.col("col_j").alias("variable")).distinct()


# ---------------------------------------------------------------- collinearity


def vif(m: Moments, tolerance: float = 1e-10) -> dict[str, float]:
    """Uncentred variance inflation of each feature, without a constant:
    infinite where the other features explain it up to rounding, finite for
    the rest whatever is aliased among them.

    One factorisation serves all features: the directions without spread name
    the features of each alias group, and for any other feature the diagonal of
    the pseudo-inverse is the reciprocal of what the others leave of it."""
    g = m.total[1:-1, 1:-1]
    d = np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1.0))
    roots, vectors = np.linalg.eigh(g / np.outer(d, d))  # unit diagonal: the ratio does not change, the inverse gains digits
    live = roots > tolerance * max(roots[-1], 1e-300)
    aliased = (vectors[:, ~live] ** 2).sum(axis=1) > tolerance
    inverse = (vectors[:, live] ** 2 / roots[live]).sum(axis=1)
    inflated = np.where(aliased | (inverse * tolerance >= 1.0), np.inf, inverse)
    return dict(zip(m.features, map(float, inflated)))


def condition_number(m: Moments) -> float:
    """Root of the ratio of extreme eigenvalues of ``X'X``, constant included."""
    roots = np.linalg.eigvalsh(m.total[:-1, :-1])
    return float(np.sqrt(roots[-1] / roots[0])) if roots[0] > 0 else float("inf")
