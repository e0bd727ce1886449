"""The same queries as plain SQL over the parquet tables, for checking.

Fits are written out from sums: a chain of sweep steps solves the normal
equations, recursive queries walk coordinate descent and the stepwise search.
"""

from __future__ import annotations

from itertools import combinations
from statistics import NormalDist

from loomstat.operators import domain
from loomstat.plans.catalog import FEATURES, NAME_STEMS
from loomstat.sources.tables import NUMERIC

ORACLE: dict[str, str] = {}

#: Mixing ratios of the elastic net search.
RATIOS = [0.1, 0.3, 0.5, 0.7, 0.9, 0.95, 0.99, 1.0]


def rnd(expr: str, digits: int) -> str:
    return f"round({expr}, {digits}) + 0.0"


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(c for c in ctes if c) + "\n"


# ---------------------------------------------------------------- base tables

LINE = """line AS (
  SELECT concat_ws(':', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS key, l_shipdate AS ts,
         l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_extendedprice * (1 - l_discount) AS disc_price,
         l_extendedprice AS price, l_discount AS discount, l_tax AS tax, nullif(l_quantity, 7.0) AS qty,
         l_extendedprice * 1.001::double + 5 AS price_copy
  FROM lineitem)"""
FEAT = """feat AS MATERIALIZED (
  SELECT concat_ws(':', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS key, l_shipdate AS ts,
         l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_extendedprice * (1 - l_discount) AS disc_price,
         l_extendedprice AS price, l_discount AS discount, l_tax AS tax, nullif(l_quantity, 7.0) AS qty,
         p_size::double AS p_size, p_retailprice, o_totalprice, s_acctbal, c_acctbal,
         l_extendedprice * 1.001::double + 5 AS price_copy, 1.0::double AS const_col, NULL::double AS null_col
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
       JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey)"""
SERIES = """series AS (
  SELECT event_id, ts, event_type, value, CASE WHEN event_id % 11 <> 0 THEN value END AS reading FROM events)"""
RAW = """raw AS (
  SELECT event_id + 2 AS row_idx, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp,
         CASE WHEN event_id % 13 = 0 THEN 'abc' WHEN event_id % 17 = 0 THEN ' ' || value::varchar || ' '
              WHEN event_id % 19 = 0 THEN '1,5' WHEN event_id % 23 = 0 THEN 'NaN' WHEN event_id % 29 = 0 THEN NULL
              ELSE value::varchar END AS flujo_text,
         user_id::varchar AS cons_text,
         CASE WHEN event_id % 5 <> 0 THEN json_extract_string(props, '$.k') END AS nivel_text
  FROM events)"""
NUM = "nullif(try_cast({c} AS double), 'NaN'::double)"
TYPED = f"""typed AS (
  SELECT row_idx, stamp, {NUM.format(c='flujo_text')} AS flujo, {NUM.format(c='cons_text')} AS cons,
         {NUM.format(c='nivel_text')} AS nivel FROM raw)"""


_DIGEST = "md5('2022:' || key)"
# fifths of the range of an eight-digit word, rounded
_FIFTHS = ["33333333", "66666666", "9999999a", "cccccccd"]
SPLIT = f"CASE WHEN substr({_DIGEST}, 1, 8) < '{_FIFTHS[0]}' THEN 'test' ELSE 'train' END"
FOLD = "(CASE " + " ".join(f"WHEN substr({_DIGEST}, 9, 8) < '{cut}' THEN {i}" for i, cut in enumerate(_FIFTHS)) + " ELSE 4 END)"


def prep(features=FEATURES, src: str = "line") -> list[str]:
    """Split, impute and standardise with training parameters."""
    tagged = f"tagged AS (SELECT *, {SPLIT} AS split, {FOLD} AS fold FROM {src} WHERE charge IS NOT NULL)"
    med = "med AS (SELECT " + ", ".join(f"median({f}) AS {f}" for f in features) + " FROM tagged WHERE split = 'train')"
    filled = "filled AS (SELECT key, ts, charge, split, fold, " + ", ".join(
        f"coalesce({f}, (SELECT {f} FROM med)) AS {f}" for f in features) + " FROM tagged)"
    par = "par AS (SELECT " + ", ".join(
        f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in features) + " FROM filled WHERE split = 'train')"
    out = "prep AS (SELECT key, ts, charge, split, fold, " + ", ".join(
        f"({f} - m_{f}) / s_{f} AS {f}" for f in features) + " FROM filled CROSS JOIN par)"
    return [tagged, med, filled, par, out, "train AS (SELECT * FROM prep WHERE split = 'train')"]


PREP = [LINE, *prep()]
HELD = "held AS (SELECT f.fold AS held, t.* FROM train t JOIN (SELECT DISTINCT fold FROM train) f ON t.fold <> f.fold)"


# ---------------------------------------------------------------- solving


def cell(a: str, b: str, order: list[str]) -> str:
    i, j = sorted((order.index(a), order.index(b)))
    return f"t_{order[i]}_{order[j]}"


def sums(name: str, src: str, cols: list[str], by: str = "") -> str:
    """Row count, means and centred cross products per group."""
    keep = f"{by}, " if by else ""
    means = ", ".join(f"avg({c}) AS m_{c}" for c in cols)
    pairs = ", ".join(
        f"covar_pop({a}, {b}) * count(*) AS t_{a}_{b}" for i, a in enumerate(cols) for b in cols[i:])
    group = f" GROUP BY {by}" if by else ""
    return f"{name} AS (SELECT {keep}count(*)::double AS n, {means}, {pairs} FROM {src}{group})"


def sweep(name: str, src: str, cols: list[str], k: str, keep: str) -> str:
    """One sweep step: regress every column on column k."""
    at = lambda a, b: cell(a, b, cols)
    out = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            if a == k and b == k:
                e = f"-1.0 / {at(k, k)}"
            elif k in (a, b):
                e = f"{at(a, b)} / {at(k, k)}"
            else:
                e = f"{at(a, b)} - {at(a, k)} * {at(k, b)} / {at(k, k)}"
            out.append(f"{e} AS {at(a, b)}")
    return f"{name} AS (SELECT {keep}, {', '.join(out)} FROM {src})"


def solve(name: str, src: str, xs: list[str], y: str = "charge", by: str = "", ridge: str = "") -> list[str]:
    """CTEs ending in ``name(by, n, b0, b_x..., v_x..., rss, tss)``; ``v_x`` is
    the diagonal of the inverse cross products."""
    cols = [*xs, y]
    keep = ", ".join([*([by] if by else []), "n", *[f"m_{c}" for c in cols], "tss"])
    ctes = [sums(f"{name}_s", src, cols, by)]
    base = f"{name}_0 AS (SELECT *, t_{y}_{y} AS tss FROM {name}_s)"
    if ridge:
        # the penalised values replace the diagonal by column order
        diag = {f"t_{x}_{x}" for x in xs}
        pairs = [f"t_{a}_{b}" for i, a in enumerate(cols) for b in cols[i:]]
        body = ", ".join(f"{p} + lam AS {p}" if p in diag else p for p in pairs)
        head = ", ".join([*([by] if by else []), "lam", "lam_no", "n", *[f"m_{c}" for c in cols]])
        base = f"{name}_0 AS (SELECT {head}, {body}, t_{y}_{y} AS tss FROM {name}_s CROSS JOIN {ridge})"
        keep = "lam, lam_no, " + keep
    ctes.append(base)
    for i, x in enumerate(xs):
        ctes.append(sweep(f"{name}_{i + 1}", f"{name}_{i}", cols, x, keep))
    at = lambda a, b: cell(a, b, cols)
    b = ", ".join(f"{at(x, y)} AS b_{x}" for x in xs)
    v = ", ".join(f"-{at(x, x)} AS v_{x}" for x in xs)
    b0 = " - ".join([f"m_{y}", *[f"{at(x, y)} * m_{x}" for x in xs]])
    ctes.append(f"{name} AS (SELECT {keep}, {b}, {v}, {b0} AS b0, {at(y, y)} AS rss FROM {name}_{len(xs)})")
    return ctes


def fitted(xs: list[str], fit: str = "f", row: str = "r") -> str:
    return " + ".join([f"{fit}.b0", *[f"{fit}.b_{x} * {row}.{x}" for x in xs]])


OLS = [*PREP, *solve("ols", "train", FEATURES)]
RESID = [*OLS, f"resid AS (SELECT r.*, {fitted(FEATURES)} AS fitted, r.charge - ({fitted(FEATURES)}) AS resid FROM train r CROSS JOIN ols f)"]


def held_out_sse(xs: list[str], fit: str, test: str, y: str = "charge") -> str:
    """Squared error on the left-out rows from their sums."""
    cols = [*xs, y]
    c = lambda a, b: f"{test}." + cell(a, b, cols)
    quad = " + ".join(f"{fit}.b_{a} * {fit}.b_{b} * {c(a, b)}" for a in xs for b in xs)
    cross = " + ".join(f"{fit}.b_{x} * {c(x, y)}" for x in xs)
    bias = " - ".join([f"{test}.m_{y}", f"{fit}.b0", *[f"{fit}.b_{x} * {test}.m_{x}" for x in xs]])
    return f"({c(y, y)} - 2 * ({cross}) + {quad} + {test}.n * pow({bias}, 2))"


TEST_SUMS = sums("test_s", "train", [*FEATURES, "charge"], "fold")


# ---------------------------------------------------------------- sources, cleaning

_TYPES = {"key": "string", "ts": "timestamp_ntz"}
ORACLE["read_profile"] = with_(FEAT) + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS variable, '{_TYPES.get(c, 'double')}' AS type, count(*) AS n_rows, count({c}) AS n_present FROM feat"
    for i, c in enumerate(["key", "ts", "charge", *NUMERIC]))
ORACLE["preview"] = with_(LINE) + "SELECT key, ts, charge FROM line ORDER BY ts, key LIMIT 5"
ORACLE["csv_landing"] = with_(RAW, TYPED) + "SELECT stamp::timestamp AS ts, flujo, cons, nivel FROM typed"
ORACLE["load_export"] = with_(RAW, TYPED) + f"""
SELECT how, count(*) AS n, count(ts) AS n_ts, count(flujo) AS n_flujo, count(cons) AS n_cons, count(nivel) AS n_nivel,
       {rnd('sum(flujo)', 2)} AS sum_flujo, max(ts) AS last_ts, 4::bigint AS n_meta, 'TAG0_0/N/A' AS first_sensor
FROM (SELECT CASE WHEN keep THEN stamp::timestamp END AS ts, CASE WHEN keep THEN flujo END AS flujo, CASE WHEN keep THEN cons END AS cons,
             CASE WHEN keep THEN nivel END AS nivel FROM (SELECT *, row_idx % 31 <> 0 AS keep FROM typed))
CROSS JOIN (VALUES ('built'), ('cached'), ('bypassed')) h(how) GROUP BY how"""
ORACLE["header_split"] = with_(RAW) + """
SELECT v.variable, v.tag, v.unit, v.n_present FROM (
  SELECT count(flujo_text) AS f, count(cons_text) AS c, count(nivel_text) AS l, count(stamp) AS s FROM raw) n,
LATERAL (VALUES ('Unnamed: 0', 'N/A', 'N/A', 0::bigint), ('Unnamed: 1', 'N/A', 'N/A', 0::bigint), ('Unnamed: 2', 'N/A', 'N/A', n.s),
  ('Flujo CLO2 Etapa D0', 'CE05_IP21_547AI1133', 'kg/s', n.f), ('Cons. Específico  O2 EOP', 'CE05_IP21_547FI1201', 'kg/ADt', n.c),
  ('Nivel Etapa D1', 'N/A', 'N/A', n.l)) v(variable, tag, unit, n_present)"""
ORACLE["roundtrip_io"] = with_(SERIES) + f"""
SELECT store, event_type, count(*) AS n, count(reading) AS n_reading, {rnd('avg(value)', 8)} AS mean_value, max(ts) AS last_ts
FROM series CROSS JOIN (VALUES ('parquet'), ('csv')) s(store) GROUP BY store, event_type"""
ORACLE["numeric_coerce"] = with_(RAW, TYPED) + "SELECT row_idx, flujo, cons, nivel FROM typed"
_CELLS = "cells AS (" + " UNION ALL ".join(f"SELECT row_idx AS line, '{c}' AS col, {c}_text AS text FROM raw" for c in ("flujo", "cons", "nivel")) + ")"
_REJECTED = "rejected AS (SELECT * FROM cells WHERE text IS NOT NULL AND nullif(try_cast(text AS double), 'NaN'::double) IS NULL)"
ORACLE["quarantined_cells"] = with_(RAW, _CELLS, _REJECTED) + """
SELECT line, col AS "column", text AS value, CASE WHEN try_cast(text AS double) IS NULL THEN 'unreadable' ELSE 'not a number' END AS reason FROM rejected"""
ORACLE["quarantine_counts"] = with_(RAW, TYPED, _CELLS, _REJECTED) + """
SELECT count(*) AS n_rows, (SELECT count(*) FROM rejected) AS n_rejected, count(flujo) AS n_flujo, count(cons) AS n_cons, count(nivel) AS n_nivel FROM typed"""
ORACLE["dropna_all"] = with_(RAW, TYPED) + "SELECT row_idx, flujo, nivel FROM typed WHERE flujo IS NOT NULL OR nivel IS NOT NULL"
ORACLE["null_counts"] = with_(FEAT) + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count(*) - count({c}) AS n_null FROM feat" for c in ["key", "ts", "charge", *NUMERIC]) + ") WHERE n_null > 0"
ORACLE["null_assert"] = with_(*PREP) + f"""
SELECT 'before' AS stage, (count(*) - count(qty))::bigint AS n_missing FROM line
UNION ALL SELECT 'after', {' + '.join(f'count(*) - count({c})' for c in ['key', 'charge', *FEATURES])} FROM prep"""
_SPREAD = "spread AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count({c}) AS n, min({c}) AS lo, max({c}) AS hi, stddev_samp({c}) AS std, var_samp({c}) AS var, count(DISTINCT {c}) AS k FROM feat"
    for c in [*NUMERIC, "charge"]) + ")"
ORACLE["constant_columns"] = with_(FEAT, _SPREAD) + f"""
SELECT variable, n, {rnd('lo', 6)} AS lo, {rnd('hi', 6)} AS hi, {rnd('std', 6)} AS std, k <= 1 OR coalesce(std <= 1e-7, false) AS dropped
FROM spread WHERE variable <> 'charge'"""
ORACLE["low_variance"] = with_(FEAT, _SPREAD) + """
SELECT variable, coalesce(var = 0, false) AS var_zero, coalesce(var < 0.01, false) AS var_below FROM spread WHERE variable <> 'charge'"""
ORACLE["feature_select"] = with_(FEAT, _SPREAD) + """
SELECT variable, CASE WHEN variable = 'charge' THEN 'target' WHEN k <= 1 OR std <= 1e-7 THEN 'constant'
       WHEN variable = 'disc_price' THEN 'leakage' ELSE 'feature' END AS role FROM spread"""
ORACLE["drop_by_rule"] = with_(FEAT) + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count(*) - count({c}) AS n_null FROM feat" for c in ["charge", "discount", "tax", "qty", "p_size"])
ORACLE["resolve_target"] = with_(LINE) + f"SELECT 'charge' AS target, count(charge) AS n, {rnd('avg(charge)', 4)} AS mean FROM line"
ORACLE["target_filter"] = with_(LINE) + "SELECT key, charge AS target FROM line WHERE qty IS NOT NULL"
ORACLE["median_impute"] = with_(*PREP) + "SELECT key, split, filled.qty, med.qty AS train_median FROM filled CROSS JOIN med"
ORACLE["standardize"] = with_(*PREP) + f"SELECT key, split, {', '.join(f'{rnd(f, 8)} AS {f}' for f in FEATURES)} FROM prep"
ORACLE["scale_params"] = with_(*PREP) + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {rnd(f'(SELECT {f} FROM med)', 6)} AS median, {rnd(f'm_{f}', 6)} AS mean, {rnd(f's_{f}', 6)} AS std_pop FROM par"
    for f in FEATURES)
_WIDE = [c for c in NUMERIC if c not in ("disc_price", "const_col", "null_col")]
ORACLE["prepare_table"] = with_(FEAT, *prep(_WIDE, "feat")) + (
    f"SELECT key, charge, split, fold::int AS fold, {', '.join(f'{rnd(f, 7)} AS {f}' for f in _WIDE)} FROM prep")


# ---------------------------------------------------------------- domain


def _any(needles) -> str:
    return "(" + " OR ".join(f"contains(lower(variable), '{x}')" for x in needles) + ")"


_STAGE = "CASE " + " ".join(f"WHEN {_any(r.needles)} THEN '{r.stage}'" for r in domain.STAGE_RULES) + f" ELSE '{domain.DEFAULT_STAGE}' END"
_CODE = "CASE " + " ".join(f"WHEN {_any(r.needles)} THEN '{r.code}'" for r in domain.CATEGORY_RULES) + f" ELSE '{domain.DEFAULT_CATEGORY}' END"
_FORCED = "CASE " + " ".join(
    f"WHEN {_any(r.needles)} THEN {repr(r.stage) if r.stage else _STAGE}" for r in domain.CATEGORY_RULES) + f" ELSE {_STAGE} END"
_LABEL = "CASE " + " ".join(f"WHEN Categoria_Cod = '{k}' THEN '{v}'" for k, v in domain.CATEGORY_LABELS.items()) + " END"
_STEMS = "[" + ", ".join(f"'{s}'" for s in NAME_STEMS) + "]"
CLASSIFIED = f"""named AS (
  SELECT p_partkey, {_STEMS}[p_partkey % {len(NAME_STEMS)} + 1] || ' ' || p_brand || ' ' || p_partkey AS variable FROM part),
coded AS (SELECT variable AS Variable, CASE WHEN p_partkey % 3 = 0 THEN 'CE05_IP21_' || p_partkey ELSE '' END AS Tag,
  {_CODE} AS Categoria_Cod, {_FORCED} AS Etapa FROM named),
classified AS (SELECT Variable, Tag, {_LABEL} AS Categoria, Categoria_Cod, Etapa FROM coded)"""
ORACLE["domain_classify"] = with_(CLASSIFIED) + "SELECT * FROM classified"
ORACLE["category_counts"] = with_(CLASSIFIED) + "SELECT Categoria, Categoria_Cod, count(*) AS n FROM classified GROUP BY ALL"


# ---------------------------------------------------------------- split

ORACLE["hash_split"] = with_(LINE) + f"SELECT key, {SPLIT} AS split FROM line"
ORACLE["exact_split"] = with_(LINE) + """
SELECT key, CASE WHEN row_number() OVER (ORDER BY md5('2022:' || key), key) <= ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
FROM line"""
ORACLE["hash_sample"] = with_(LINE) + "SELECT key, charge FROM line ORDER BY md5('42:' || key), key LIMIT 2000"
ORACLE["fold_assign"] = with_(LINE) + f"SELECT key, {FOLD}::int AS fold FROM line"


# ---------------------------------------------------------------- profile

ORACLE["describe"] = with_(FEAT) + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count({c}) AS count, " + ", ".join(
        f"{rnd(e.format(c=c), 5)} AS {a}" for a, e in (
            ("mean", "avg({c})"), ("std", "stddev_samp({c})"), ("min", "min({c})"), ("q25", "quantile_cont({c}, 0.25)"),
            ("q50", "quantile_cont({c}, 0.5)"), ("q75", "quantile_cont({c}, 0.75)"), ("max", "max({c})"))) + " FROM feat"
    for c in [*NUMERIC, "charge"])
ORACLE["target_kpis"] = with_(SERIES) + f"""
SELECT count(value) AS n, {rnd('avg(value)', 8)} AS mean, max(value) AS max, count(*) FILTER (value > 17.5) AS n_over,
       {rnd('count(*) FILTER (value > 17.5) / count(value)', 8)} AS share_over, 17.5::double AS design_limit FROM series"""
ORACLE["histogram"] = with_(SERIES, "lim AS (SELECT min(value) AS lo, max(value) AS hi FROM series)",
    """binned AS (SELECT least(floor((value - lo) / (hi - lo) * 40) + 1, 40)::int AS bin, count(*) AS n
       FROM series CROSS JOIN lim WHERE value IS NOT NULL GROUP BY 1)""") + f"""
SELECT b::int AS bin, {rnd('lo + (b - 1) * ((hi - lo) / 40)', 8)} AS lo, {rnd('lo + b * ((hi - lo) / 40)', 8)} AS hi, coalesce(n, 0) AS n
FROM range(1, 41) g(b) CROSS JOIN lim LEFT JOIN binned ON bin = b"""
ORACLE["kde"] = with_(SERIES,
    "lim AS (SELECT count(value) AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) * pow(count(value), -0.2) AS h FROM series)",
    """cells AS (SELECT least(floor((value - lo) / (hi - lo) * 1024), 1023) AS cell, count(*) AS w, avg(value) AS c
       FROM series CROSS JOIN lim GROUP BY 1)""",
    "grid AS (SELECT p::int AS point, lo + p * ((hi - lo) / 199) AS x, n, h FROM range(0, 200) g(p) CROSS JOIN lim)") + f"""
SELECT point, {rnd('x', 8)} AS x, {rnd('sum(w * exp(-0.5 * pow((x - c) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi()))', 10)} AS density
FROM grid CROSS JOIN cells GROUP BY point, x"""
ORACLE["boxplot"] = with_(SERIES,
    "qs AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM series)",
    "s AS (SELECT value, q1, q2, q3, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM series CROSS JOIN qs)") + f"""
SELECT count(value) AS n, {rnd('avg(value)', 8)} AS mean, {rnd('any_value(q1)', 8)} AS q1, {rnd('any_value(q2)', 8)} AS median,
       {rnd('any_value(q3)', 8)} AS q3, min(value) FILTER (inside) AS whisker_low, max(value) FILTER (inside) AS whisker_high,
       count(*) FILTER (NOT inside) AS n_outliers FROM s"""


def _rolling(source: str, over: str, least: int, more: str = "") -> str:
    total = f"CASE WHEN count(reading) OVER ({over}) >= {least} THEN avg(reading) OVER ({over}) * count(reading) OVER ({over}) END"
    return f"""
SELECT * EXCLUDE (total), CASE WHEN abs(total) < 1e14 THEN {rnd('total', 2)} END AS rolling_sum,
       CASE WHEN abs(total) >= 1e14 THEN {rnd('total / 1e17', 6)} END AS rolling_spikes
FROM (SELECT event_id, ts, reading{more}, count(reading) OVER ({over}) AS rolling_n, {total} AS total FROM {source})"""


_TRAILING = "ORDER BY ts, event_id ROWS BETWEEN {} PRECEDING AND CURRENT ROW"
ORACLE["rolling_mean"] = with_(SERIES) + _rolling("series", _TRAILING.format(719), 60, ", 17.5::double AS design_limit")
ORACLE["rolling_mean_by_series"] = with_(SERIES) + _rolling("series", "PARTITION BY event_type " + _TRAILING.format(239), 20, ", event_type")
ORACLE["rolling_mean_spiked"] = with_(
    SERIES, "spiked AS (SELECT event_id, ts, CASE WHEN event_id % 1009 = 5 THEN 1e17 ELSE reading END AS reading FROM series)"
) + _rolling("spiked", _TRAILING.format(719), 60)


# ---------------------------------------------------------------- correlation

_CORR_COLS = [*NUMERIC, "charge"]


def _corr(a: str, b: str) -> str:
    flat = f"(stddev_pop({a}) FILTER ({b} IS NOT NULL) = 0 OR stddev_pop({b}) FILTER ({a} IS NOT NULL) = 0)"
    return f"CASE WHEN {flat} THEN NULL ELSE corr({a}, {b}) END"


PAIRS = "pairs AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT {NUMERIC.index(a) if a in NUMERIC else 99} AS i, '{a}' AS col_i, '{b}' AS col_j, count({a} + {b}) AS n, {_corr(a, b)} AS r FROM feat"
    for a, b in combinations(_CORR_COLS, 2)) + ")"
_WITH_TARGET = "target AS (SELECT col_i AS variable, r FROM pairs WHERE col_j = 'charge' AND r IS NOT NULL)"
ORACLE["corr_matrix"] = with_(FEAT, PAIRS) + f"SELECT col_i, col_j, n, {rnd('r', 8)} AS r FROM pairs"
ORACLE["top_corr"] = with_(FEAT, PAIRS, _WITH_TARGET) + f"""
SELECT variable, {rnd('r', 8)} AS r FROM (SELECT * FROM target UNION ALL SELECT 'charge', 1.0) ORDER BY abs(r) DESC LIMIT 18"""
ORACLE["top10_corr"] = with_(FEAT, PAIRS, _WITH_TARGET) + f"SELECT variable, {rnd('r', 8)} AS r FROM target ORDER BY abs(r) DESC LIMIT 10"
ORACLE["top_corr_matrix"] = with_(FEAT, PAIRS, _WITH_TARGET,
    "top AS (SELECT variable FROM (SELECT * FROM target UNION ALL SELECT 'charge', 1.0) ORDER BY abs(r) DESC LIMIT 18)") + f"""
SELECT col_i, col_j, n, {rnd('r', 8)} AS r FROM pairs
WHERE col_i IN (SELECT variable FROM top) AND col_j IN (SELECT variable FROM top)"""
ORACLE["corr_prune"] = with_(FEAT, PAIRS) + "SELECT DISTINCT col_j AS variable FROM pairs WHERE abs(r) > 0.95 AND col_j <> 'charge'"
ORACLE["corr_prune_with_target"] = with_(FEAT, PAIRS) + "SELECT DISTINCT col_j AS variable FROM pairs WHERE abs(r) > 0.95"


# ---------------------------------------------------------------- cross products

_GRAM_COLS = ["(intercept)", *FEATURES, "charge"]
_UNIT = "unit AS (SELECT fold, 1.0::double AS \"(intercept)\", " + ", ".join(FEATURES) + ", charge / (SELECT avg(charge) FROM train) AS charge FROM train)"


def _gram(by: str) -> str:
    keep, group = (f"{by}::int AS {by}, ", f" GROUP BY {by}") if by else ("", "")
    return with_(*PREP, _UNIT) + " UNION ALL ".join(
        f"SELECT {keep}'{a}' AS col_i, '{b}' AS col_j, count(*) AS n, {rnd(f'avg(\"{a}\" * \"{b}\")', 8)} AS mean_product FROM unit{group}"
        for i, a in enumerate(_GRAM_COLS) for b in _GRAM_COLS[i:])


ORACLE["gram_matrix"] = _gram("")
ORACLE["fold_gram"] = _gram("fold")
_VIF = ["disc_price", *FEATURES]
# price and its affine copy explain each other; for the others the copy adds nothing
ORACLE["vif"] = with_(LINE, *prep(_VIF), *solve("g", "train", _VIF)) + " UNION ALL ".join(
    [f"SELECT '{x}' AS variable, {rnd(f'v_{x} * (SELECT t_{x}_{x} FROM g_s)', 6)} AS vif, false AS aliased FROM g" for x in _VIF if x != "price"]
    + [f"SELECT '{x}', NULL, stddev_pop(price_copy - 1.001 * price) < 1e-6 FROM line" for x in ("price", "price_copy")])


def _condition() -> list[str]:
    """Extreme eigenvalues of the correlation matrix: the trace of its 2^k-th
    power, found by squaring, is the largest one's power; the smallest is that
    of ``trace - matrix``. The constant adds an eigenvalue of 1."""
    size = len(FEATURES)
    cells = [(i, j) for i in range(size) for j in range(i, size)]
    at = lambda i, j: f"c{min(i, j)}{max(i, j)}"
    trace = " + ".join(at(i, i) for i in range(size))
    squares = ", ".join("(" + " + ".join(f"{at(i, k)} * {at(k, j)}" for k in range(size)) + f") / pow({trace}, 2) AS {at(i, j)}" for i, j in cells)
    start = ", ".join(f"{'1.0::double' if i == j else f'corr({FEATURES[i]}, {FEATURES[j]})'} AS {at(i, j)}" for i, j in cells)
    flip = ", ".join(f"{size if i == j else 0}.0 - {at(i, j)} AS {at(i, j)}" for i, j in cells)
    return [
        f"c_top AS (SELECT 'top' AS side, 0 AS k, 0.0::double AS logs, {start} FROM train)",
        f"""powers AS (SELECT * FROM c_top UNION ALL SELECT 'low', 0, 0.0, {flip} FROM c_top
            UNION ALL SELECT side, k + 1, 2 * (logs + ln({trace})), {squares} FROM powers WHERE k < 45)""",
        f"eigen AS (SELECT side, exp((logs + ln({trace})) / pow(2, 45)) AS v FROM powers WHERE k = 45)",
        f"""cond AS (SELECT sqrt(greatest(1, max(v) FILTER (side = 'top')) / least(1, {size} - max(v) FILTER (side = 'low'))) AS condition_number
            FROM eigen)"""]


ORACLE["condition_number"] = with_(*PREP, *_condition(), recursive=True) + f"""
SELECT 4::int AS n_features, (SELECT count(*) FROM train) AS n, {rnd('condition_number', 6)} AS condition_number FROM cond"""


# ---------------------------------------------------------------- least squares


def _measures(e: str = "e", y: str = "charge") -> dict[str, str]:
    return {
        "mse": f"avg({e} * {e})", "rmse": f"sqrt(avg({e} * {e}))", "mae": f"avg(abs({e}))",
        "r2": f"1 - sum({e} * {e}) / (var_pop({y}) * count(*))",
    }


_M = _measures()
ORACLE["ols_simple"] = with_(*PREP, *solve("s", "train", ["price"]),
    "e AS (SELECT r.split, r.charge, r.charge - (f.b0 + f.b_price * r.price) AS e FROM prep r CROSS JOIN s f)") + f"""
SELECT split, count(*) AS n, {rnd(_M['r2'], 9)} AS r2, {rnd(_M['rmse'], 5)} AS rmse, {rnd(_M['mae'], 5)} AS mae,
       {rnd('(SELECT b_price FROM s)', 5)} AS slope, {rnd('(SELECT b0 FROM s)', 5)} AS intercept FROM e GROUP BY split"""
ORACLE["ols_fit"] = with_(*OLS) + " UNION ALL ".join(
    f"SELECT '{x}' AS feature, {rnd(b, 5)} AS coef FROM ols" for x, b in [("(intercept)", "b0"), *[(f, f"b_{f}") for f in FEATURES]])
_SE = [("(intercept)", "b0", "1 / n + " + " + ".join(f"0 * m_{f}" for f in FEATURES)), *[(f, f"b_{f}", f"v_{f}") for f in FEATURES]]
_S2 = f"rss / (n - {len(FEATURES) + 1})"
ORACLE["ols_coefficients"] = with_(*OLS) + " UNION ALL ".join(
    f"SELECT '{x}' AS feature, {rnd(b, 5)} AS coef, {rnd(f'sqrt({_S2} * ({v}))', 6)} AS std_err, {rnd(f'{b} / sqrt({_S2} * ({v}))', 4)} AS t_value FROM ols"
    for x, b, v in _SE)
_K = len(FEATURES)
# upper tail of F with 4 degrees above, in closed form
_F = f"((tss - rss) / 4) / (rss / (n - 5))"
_F_TAIL = f"pow((n - 5) / (n - 5 + 4 * {_F}), (n - 5) / 2) * (1 + (n - 5) / 2 * (4 * {_F}) / (n - 5 + 4 * {_F}))"


def _tail_t(t: str, free: str, steps: int = 4000) -> str:
    """Two-sided probability of Student's t by Simpson's rule over its density; nothing is left beyond 40."""
    area = f"""(SELECT sum(CASE WHEN i % {steps} = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
        * pow(1 + pow(i * h / {steps}, 2) / v, -(v + 1) / 2)) * h / {steps} / 3 FROM range(0, {steps + 1}) g(i))"""
    return f"""(SELECT CASE WHEN h >= 40 THEN 0.0 ELSE greatest(0.0, 1 - 2 * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * {area}) END
      FROM (SELECT abs({t}) AS h, ({free})::double AS v))"""


ORACLE["ols_summary"] = with_(*OLS) + f"""
SELECT n::bigint AS n, {rnd(f'((tss - rss) / {_K}) / (rss / (n - {_K + 1}))', 2)} AS f_statistic, {rnd(_F_TAIL, 8)} AS f_pvalue, {rnd('1 - rss / tss', 9)} AS r2,
       {rnd(f'1 - (rss / tss) * (n - 1) / (n - {_K + 1})', 9)} AS r2_adj,
       {rnd(f'n * ln(2 * pi()) + n * ln(rss / n) + n + 2 * {_K + 1}', 3)} AS aic_loglik,
       {rnd(f'n * ln(2 * pi()) + n * ln(rss / n) + n + ln(n) * {_K + 1}', 3)} AS bic_loglik FROM ols"""
_NINE = ["price", "discount", "tax", "qty", "p_size", "p_retailprice", "o_totalprice", "s_acctbal", "c_acctbal"]
ORACLE["ols_pvalues"] = with_(FEAT, *prep(_NINE, "feat"), *solve("w", "train", _NINE),
    "t AS (" + " UNION ALL ".join(
        f"SELECT '{x}' AS feature, {b} / sqrt(rss / (n - 10) * ({v})) AS t_value, n - 10 AS free FROM w"
        for x, b, v in [("(intercept)", "b0", "1 / n + " + " + ".join(f"0 * m_{f}" for f in _NINE)), *[(f, f"b_{f}", f"v_{f}") for f in _NINE]]) + ")") + (
    f"SELECT feature, {rnd('t_value', 4)} AS t_value, {rnd(_tail_t('t_value', 'free'), 8)} AS p_value FROM t")
ORACLE["ols_iterative"] = with_(FEAT, *prep(_NINE, "feat"), *solve("w", "train", _NINE)) + " UNION ALL ".join(
    f"SELECT '{x}' AS feature, {rnd(b, 5)} AS coef FROM w" for x, b in [("(intercept)", "b0"), *[(f, f"b_{f}") for f in _NINE]])
ORACLE["ridge_iterative"] = with_(
    FEAT, *prep(_NINE, "feat"), "lams(lam_no, lam) AS (VALUES (0, 1.0::double), (1, 100.0::double), (2, 10000.0::double))",
    *solve("w", "train", _NINE, ridge="lams")) + " UNION ALL ".join(
    f"SELECT lam_no::int AS alpha_no, '{f}' AS feature, {rnd(f'b_{f}', 5)} AS coef FROM w" for f in _NINE)
ORACLE["predict"] = with_(*OLS) + f"SELECT r.key, r.split, {rnd(fitted(FEATURES), 2)} AS fitted FROM prep r CROSS JOIN ols f"
_NO_TAX = [f for f in FEATURES if f != "tax"]
ORACLE["predict_missing_column"] = with_(*OLS) + f"SELECT r.key, {rnd(fitted(_NO_TAX), 2)} AS fitted FROM prep r CROSS JOIN ols f"
ORACLE["residuals"] = with_(*RESID) + f"SELECT key, {rnd('fitted', 2)} AS fitted, {rnd('resid', 2)} AS resid FROM resid"
ORACLE["metrics"] = with_(*OLS, f"e AS (SELECT r.split, r.charge, r.charge - ({fitted(FEATURES)}) AS e FROM prep r CROSS JOIN ols f)") + f"""
SELECT 'ols' AS model, split, count(*) AS n, {rnd(_M['mse'], 2)} AS mse, {rnd(_M['rmse'], 5)} AS rmse, {rnd(_M['mae'], 5)} AS mae,
       {rnd(_M['r2'], 9)} AS r2 FROM e GROUP BY split"""


# ---------------------------------------------------------------- residual tests

ORACLE["jarque_bera"] = with_(*RESID,
    "c AS (SELECT resid - (SELECT avg(resid) FROM resid) AS d FROM resid)",
    "m AS (SELECT count(*) AS n, avg(pow(d, 2)) AS m2, avg(pow(d, 3)) AS m3, avg(pow(d, 4)) AS m4 FROM c)",
    "k AS (SELECT n, m3 / pow(m2, 1.5) AS s, m4 / (m2 * m2) AS k FROM m)",
    "j AS (SELECT *, n / 6.0 * (s * s + (k - 3) * (k - 3) / 4) AS jb FROM k)") + f"""
SELECT n, {rnd('s', 7)} AS skewness, {rnd('k', 7)} AS kurtosis, {rnd('jb', 3)} AS jb, {rnd('exp(-jb / 2)', 8)} AS p_value FROM j"""
ORACLE["durbin_watson"] = with_(*RESID, "l AS (SELECT resid AS e, lag(resid) OVER (ORDER BY ts, key) AS p FROM resid)") + f"""
SELECT count(*) AS n, {rnd('sum((e - p) * (e - p)) / sum(e * e)', 8)} AS durbin_watson FROM l"""
_SQUARES = "e2 AS (SELECT " + ", ".join(FEATURES) + ", resid * resid AS sq FROM resid)"
_LM = "n * (1 - rss / tss)"  # chi-square with 4 degrees: its tail has a closed form
ORACLE["breusch_pagan"] = with_(*RESID, _SQUARES, *solve("a", "e2", FEATURES, "sq")) + f"""
SELECT n::bigint AS n, 4::int AS df, {rnd(_LM, 4)} AS lm, {rnd(f'exp(-({_LM}) / 2) * (1 + ({_LM}) / 2)', 8)} AS p_value FROM a"""
ORACLE["residual_trend"] = with_(*RESID, "t AS (SELECT *, ntile(50) OVER (ORDER BY fitted, ts, key) AS tile FROM resid)") + f"""
SELECT tile::int AS tile, count(*) AS n, {rnd('avg(fitted)', 4)} AS mean_fitted, {rnd('avg(resid)', 4)} AS mean_resid FROM t GROUP BY tile"""
ORACLE["scale_location"] = with_(*RESID, "p AS (SELECT avg(resid) AS m, stddev_pop(resid) AS s FROM resid)") + f"""
SELECT key, {rnd('sqrt(abs((resid - m) / s))', 5)} AS scale_location FROM resid CROSS JOIN p"""
_QQ = [(i, i / 200) for i in range(1, 200)]
ORACLE["qq_points"] = with_(*RESID, "p AS (SELECT avg(resid) AS m, stddev_pop(resid) AS s FROM resid)",
    f"qs AS (SELECT unnest(quantile_cont(resid, {[p for _, p in _QQ]})) AS v, unnest(range(1, 200)) AS point FROM resid)",
    "normal(point, theoretical) AS (VALUES " + ", ".join(f"({i}, {NormalDist().inv_cdf(p)!r}::double)" for i, p in _QQ) + ")") + f"""
SELECT point::int AS point, {rnd('point / 200', 6)} AS prob, {rnd('theoretical', 8)} AS theoretical, {rnd('(v - m) / s', 6)} AS sample
FROM qs JOIN normal USING (point) CROSS JOIN p"""
ORACLE["residual_sequence"] = with_(*RESID) + f"SELECT ts, key, {rnd('resid', 2)} AS resid FROM resid ORDER BY ts, key LIMIT 1000"


# ---------------------------------------------------------------- selection

_AIC = "n * ln(2 * pi()) + n * ln({rss} / n) + n + 2 * ({k} + 1)"
ORACLE["stepwise_step1"] = with_(*PREP) + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {rnd(f'1 - regr_r2(charge, {f})', 9)} AS rss_share, "
    + rnd(_AIC.format(rss=f"(regr_syy(charge, {f}) * (1 - regr_r2(charge, {f})))", k=1).replace("n *", "count(*) *").replace("/ n", "/ count(*)").replace("+ n +", "+ count(*) +"), 3)
    + " AS aic FROM train" for f in FEATURES)


def subsets(src: str, by: str = "") -> list[str]:
    """One fit per non-empty feature subset, keyed by bit mask."""
    ctes, names = [], []
    for mask in range(1, 1 << len(FEATURES)):
        xs = [f for i, f in enumerate(FEATURES) if mask >> i & 1]
        ctes += solve(f"u{mask}", src, xs, by=by)
        coefs = ", ".join(f"b_{f}" if f in xs else f"0.0::double AS b_{f}" for f in FEATURES)
        names.append(f"SELECT {by + ', ' if by else ''}{mask} AS mask, {len(xs)} AS k, n, b0, {coefs}, rss FROM u{mask}")
    return [*ctes, f"subs AS ({' UNION ALL '.join(names)})"]


_BITS = "feats(bit, feature, no) AS (VALUES " + ", ".join(f"({1 << i}, '{f}', {i})" for i, f in enumerate(FEATURES)) + ")"
_WALK = [*subsets("train"), _BITS,
    f"""sub_aic AS (SELECT mask, {_AIC.format(rss='rss', k='k')} AS aic FROM subs
        UNION ALL SELECT 0, {_AIC.format(rss='(var_pop(charge) * n)', k=0)} FROM train CROSS JOIN (SELECT count(*) AS n FROM train) GROUP BY n)""",
    """forward AS (SELECT p.mask, f.bit, p.mask | f.bit AS nxt, s.aic FROM sub_aic p JOIN feats f ON p.mask & f.bit = 0
        JOIN sub_aic s ON s.mask = p.mask | f.bit QUALIFY row_number() OVER (PARTITION BY p.mask ORDER BY s.aic, f.no) = 1)""",
    """backward AS (SELECT p.mask, keep.bit AS latest, f.bit, p.mask - f.bit AS nxt, s.aic
        FROM sub_aic p JOIN feats keep ON p.mask & keep.bit > 0 JOIN feats f ON p.mask & f.bit > 0 AND f.bit <> keep.bit
        JOIN sub_aic s ON s.mask = p.mask - f.bit QUALIFY row_number() OVER (PARTITION BY p.mask, keep.bit ORDER BY s.aic, f.no) = 1)""",
    """walk AS (
        SELECT 0 AS turn, 0 AS step, mask, 0 AS latest, aic, 'base' AS action, 0 AS bit FROM sub_aic WHERE mask = 0
        UNION ALL
        SELECT w.turn + 1, CASE WHEN w.turn % 2 = 0 THEN w.step + 1 ELSE w.step END,
               CASE WHEN w.turn % 2 = 0 THEN f.nxt WHEN b.aic < w.aic THEN b.nxt ELSE w.mask END,
               CASE WHEN w.turn % 2 = 0 THEN f.bit ELSE w.latest END,
               CASE WHEN w.turn % 2 = 0 THEN f.aic WHEN b.aic < w.aic THEN b.aic ELSE w.aic END,
               CASE WHEN w.turn % 2 = 0 THEN 'add' WHEN b.aic < w.aic THEN 'remove' ELSE 'none' END,
               CASE WHEN w.turn % 2 = 0 THEN f.bit WHEN b.aic < w.aic THEN b.bit ELSE 0 END
        FROM walk w LEFT JOIN forward f ON f.mask = w.mask
        LEFT JOIN backward b ON b.mask = w.mask AND b.latest = w.latest AND bit_count(w.mask) > 2
        WHERE (w.turn % 2 = 1 OR f.aic < w.aic) AND w.turn < 30)"""]
ORACLE["stepwise_path"] = with_(*PREP, *_WALK,
    "kept AS (SELECT row_number() OVER (ORDER BY turn) - 1 AS step_no, * FROM walk WHERE action <> 'none')", recursive=True) + f"""
SELECT step_no::int AS step_no, step::int AS step, action, feature, {rnd('aic', 3)} AS aic,
       {rnd('lag(aic) OVER (ORDER BY step_no) - aic', 3)} AS gain FROM kept LEFT JOIN feats USING (bit)"""

_SUB_CV = [*PREP, HELD, TEST_SUMS, *subsets("held", "held"),
           f"""cv AS (SELECT f.mask, avg({held_out_sse(FEATURES, 'f', 't')} / t.n) AS mse,
               avg(1 - {held_out_sse(FEATURES, 'f', 't')} / t.t_charge_charge) AS r2
               FROM subs f JOIN test_s t ON t.fold = f.held GROUP BY f.mask)"""]


def _greedy(score: str, best: str, steps: int, shown: str) -> str:
    ctes = [_BITS]
    prev = "SELECT 0 AS mask"
    for i in range(1, steps + 1):
        ctes.append(f"""g{i} AS (SELECT {i} AS step, cv.mask, f.feature, {score} AS score FROM ({prev}) p JOIN feats f ON p.mask & f.bit = 0
            JOIN cv ON cv.mask = p.mask | f.bit ORDER BY {best}, f.no LIMIT 1)""")
        prev = f"SELECT mask FROM g{i}"
    union = " UNION ALL ".join(f"SELECT * FROM g{i}" for i in range(1, steps + 1))
    return with_(*_SUB_CV, *ctes) + f"SELECT step::int AS step, feature, {shown} AS score FROM ({union})"


ORACLE["forward_cv_select"] = _greedy("cv.mse", "cv.mse", 3, rnd("score", 1))
ORACLE["forward_cv_quarter"] = _greedy("cv.mse", "cv.mse", 1, rnd("score", 1))
ORACLE["forward_cv_r2"] = _greedy("cv.r2", "cv.r2 DESC", 2, rnd("score", 9))


def grid(a: float, b: float, n: int, desc: bool = False) -> str:
    """lam table: powers of ten with evenly spaced exponents."""
    pos = f"({n - 1} - i)" if desc else "i"
    return f"lams AS (SELECT i::int AS lam_no, pow(10.0::double, {a}::double + {pos} * {(b - a) / (n - 1)!r}::double) AS lam FROM range(0, {n}) g(i))"


_SPREAD_Y = "(SELECT var_pop(charge) FROM train)"


def _ridge(lams: str) -> list[str]:
    return [*PREP, HELD, TEST_SUMS, lams, *solve("w", "held", FEATURES, by="held", ridge="lams"),
            f"cv AS (SELECT f.lam_no, f.lam, avg({held_out_sse(FEATURES, 'f', 't')} / t.n) AS mse FROM w f JOIN test_s t ON t.fold = f.held GROUP BY ALL)"]


def _cv_out(ratio: str = "0.0::double") -> str:
    return f"""SELECT {ratio} AS ratio, lam_no AS alpha_no, {rnd('lam', 5)} AS alpha, {rnd(f'mse / {_SPREAD_Y}', 7)} AS cv_share,
       mse = (SELECT min(mse) FROM cv) AS chosen FROM cv"""


ORACLE["ridge_cv"] = with_(*_ridge(grid(-4, 4, 60))) + _cv_out()
ORACLE["ridge_custom_grid"] = with_(*_ridge(grid(-6, 6, 13))) + _cv_out()
ORACLE["ridge_coefs"] = with_(*_ridge(grid(-4, 4, 60)), "best AS (SELECT lam, lam_no FROM cv ORDER BY mse, lam_no LIMIT 1)",
    *solve("z", "train", FEATURES, ridge="best")) + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {rnd(f'b_{f}', 3)} AS coef FROM z" for f in FEATURES)


def _net(ratios: list[float], explicit: str = "", sweeps: int = 60, xs: list[str] = FEATURES, base: list[str] = PREP, tests: str = TEST_SUMS) -> list[str]:
    """Coordinate descent as a recursive query: every (fold, ratio, alpha)
    state updates its coefficients in turn, ``sweeps`` times. Fold -1 is the
    fit on all training rows."""
    y = "charge"
    cols = [*xs, y]
    groups = f"""grp AS (SELECT held, {', '.join(cols)} FROM held UNION ALL SELECT -1, {', '.join(cols)} FROM train)"""
    rr = "rr(ratio) AS (VALUES " + ", ".join(f"({r}::double)" for r in ratios) + ")"
    if explicit:
        alphas = [explicit, "al AS (SELECT ratio, lam_no, lam FROM rr CROSS JOIN lams)"]
    else:
        top = "greatest(" + ", ".join(f"abs(t_{f}_{y})" for f in xs) + ") / n"
        alphas = [f"""al AS (SELECT ratio, i::int AS lam_no, {top} / ratio * pow(1e-3::double, i / 99.0::double) AS lam
            FROM c_s CROSS JOIN rr CROSS JOIN range(0, 100) g(i) WHERE held = -1)"""]
    zero = ", ".join(f"0.0::double AS b_{f}" for f in xs)
    inner, names = "w", [f"b_{f}" for f in xs]
    keep = "it, held, ratio, lam_no, lam"
    body = "(SELECT * FROM cd)"
    for j, f in enumerate(xs):
        pull = " - ".join([f"c.t_{f}_{y}", *[f"x.b_{o} * c.{cell(f, o, cols)}" for o in xs if o != f]])
        z = f"(({pull}) / c.n)"
        upd = f"sign({z}) * greatest(abs({z}) - x.lam * x.ratio, 0.0) / (c.t_{f}_{f} / c.n + x.lam * (1 - x.ratio)) AS b_{f}"
        rest = ", ".join(upd if o == f else f"x.b_{o}" for o in xs)
        body = f"(SELECT x.it, x.held, x.ratio, x.lam_no, x.lam, {rest} FROM {body} x JOIN c_s c ON c.held = x.held)"
    return [
        *base, HELD, tests, groups, sums("c_s", "grp", cols, "held"), rr, *alphas,
        f"""cd AS (SELECT 0 AS it, held, ratio, lam_no, lam, {zero} FROM al CROSS JOIN (SELECT held FROM c_s)
            UNION ALL SELECT it + 1, held, ratio, lam_no, lam, {', '.join(names)} FROM {body} WHERE it < {sweeps})""",
        f"""fin AS (SELECT d.held, d.ratio, d.lam_no, d.lam, {', '.join('d.' + n for n in names)},
            c.m_{y} - {' - '.join(f'd.b_{f} * c.m_{f}' for f in xs)} AS b0 FROM cd d JOIN c_s c ON c.held = d.held WHERE it = {sweeps})""",
        f"""cv AS (SELECT f.ratio, f.lam_no, f.lam, avg({held_out_sse(xs, 'f', 't')} / t.n) AS mse
            FROM fin f JOIN test_s t ON t.fold = f.held GROUP BY ALL)""",
    ]


ORACLE["lasso_cv"] = with_(*_net([1.0]), recursive=True) + _cv_out("ratio")
ORACLE["elasticnet_cv"] = with_(*_net(RATIOS), recursive=True) + _cv_out("ratio")
ORACLE["lasso_custom_grid"] = with_(*_net([1.0], grid(-3, 3, 100, desc=True)), recursive=True) + _cv_out("ratio")
ORACLE["elasticnet_custom_grid"] = with_(
    *_net([0.1, 0.5, 0.7, 0.9, 0.95, 0.99, 1.0], grid(-3, 3, 50, desc=True)), recursive=True) + _cv_out("ratio")
ORACLE["lasso_coefs"] = with_(*_net([1.0]), "best AS (SELECT ratio, lam_no FROM cv ORDER BY mse LIMIT 1)",
    "z AS (SELECT * FROM fin JOIN best USING (ratio, lam_no) WHERE held = -1)", recursive=True) + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {rnd(f'b_{f}', 3)} AS coef FROM z" for f in FEATURES)
# leave-one-out by the leverage of each row, from the swept inverse of (G + lam I)
_INV = {(a, b): cell(a, b, [*FEATURES, "charge"]) for a in FEATURES for b in FEATURES}
_LEV = " + ".join(f"r.{a} * r.{b} * -i.{c}" for (a, b), c in _INV.items())
_LOO = [*PREP, grid(-6, 6, 13), *solve("w", "train", FEATURES, ridge="lams"),
    f"""loo AS (SELECT f.lam_no, f.lam, (r.charge - ({fitted(FEATURES)})) / (1 - 1 / f.n - ({_LEV})) AS e
        FROM train r CROSS JOIN w f JOIN w_{len(FEATURES)} i ON i.lam_no = f.lam_no)"""]
ORACLE["ridge_loo"] = with_(*_LOO) + f"""
SELECT lam_no AS alpha_no, {rnd('lam', 6)} AS alpha, {rnd(f'avg(e * e) / {_SPREAD_Y}', 9)} AS loo_share FROM loo GROUP BY lam_no, lam"""
ORACLE["ridge_loo_coefs"] = with_(
    *_LOO, "chosen AS (SELECT lam, lam_no FROM loo GROUP BY ALL ORDER BY avg(e * e), lam_no LIMIT 1)", *solve("z", "train", FEATURES, ridge="chosen")
) + " UNION ALL ".join(f"SELECT '{f}' AS feature, {rnd(f'b_{f}', 4)} AS coef, {rnd('lam', 6)} AS alpha FROM z" for f in FEATURES)


# ---------------------------------------------------------------- comparison


_FOUR = lambda x: f"printf('%.4f', {x})"
_USED = " + ".join(f"(b_{f} <> 0)::int" for f in FEATURES)
_B = ", ".join(f"b_{f}" for f in FEATURES)
_NET_PARAMS = (f"'cv_folds=5, ' || {{ratio}} || 'lambda_optimo=' || {_FOUR('lam')} || ', num_variables_seleccionadas=' || ({_USED}) || "
               f"', regularizacion={{label}}, sparsity_pct=' || {_FOUR(f'100.0 * (1 - ({_USED}) / 4.0)')}")


def _suite() -> list[str]:
    """The five fits, their scores by split, and the records."""
    lasso = _NET_PARAMS.format(ratio="''", label="L1 (Lasso)")
    mixed = _NET_PARAMS.format(ratio=f"'l1_ratio_optimo=' || {_FOUR('ratio')} || ', '", label="Elastic Net (L1+L2)")
    aic = "(SELECT aic FROM sub_aic WHERE mask = walked.mask)"
    ridge = f"'cv_folds=5, lambda_optimo=' || {_FOUR('lam')} || ', regularizacion=L2 (Ridge)'"
    # keys in order: cv_folds, l1_ratio_optimo, lambda_optimo, num_variables_seleccionadas, regularizacion, sparsity_pct
    return [
        *_net(RATIOS, sweeps=150), grid(-4, 4, 60), *solve("w", "held", FEATURES, by="held", ridge="lams"),
        f"rcv AS (SELECT f.lam_no, f.lam, avg({held_out_sse(FEATURES, 'f', 't')} / t.n) AS mse FROM w f JOIN test_s t ON t.fold = f.held GROUP BY ALL)",
        "rbest AS (SELECT lam, lam_no FROM rcv ORDER BY mse, lam_no LIMIT 1)", *solve("z", "train", FEATURES, ridge="rbest"),
        *_WALK, "walked AS (SELECT mask FROM walk ORDER BY turn DESC LIMIT 1)", *solve("ols", "train", FEATURES),
        "lbest AS (SELECT ratio, lam_no FROM cv WHERE ratio = 1 ORDER BY mse, lam_no LIMIT 1)",
        "ebest AS (SELECT ratio, lam_no FROM cv ORDER BY mse, ratio, lam_no LIMIT 1)",
        f"""fits AS (SELECT 'ols' AS model, 'Regresion Lineal MCO (OLS)' AS model_name, b0, {_B}, {_K} AS known, 'N/A' AS params FROM ols
            UNION ALL SELECT 'stepwise', 'Regresion Stepwise (AIC)', b0, {_B}, bit_count(mask), 'aic_final=' || {_FOUR(aic)} || ', criterio=AIC, num_variables_seleccionadas='
              || bit_count(mask) FROM subs JOIN walked USING (mask)
            UNION ALL SELECT 'ridge', 'Regresion Ridge (L2)', b0, {_B}, {_K}, {ridge} FROM z
            UNION ALL SELECT 'lasso', 'Regresion Lasso (L1)', b0, {_B}, {_K}, {lasso} FROM fin JOIN lbest USING (ratio, lam_no) WHERE held = -1
            UNION ALL SELECT 'elasticnet', 'Regresion Elastic Net (L1+L2)', b0, {_B}, {_K}, {mixed} FROM fin JOIN ebest USING (ratio, lam_no) WHERE held = -1)""",
        f"used AS (SELECT model, model_name, {_USED} AS k, regexp_replace(params, '(aic_final=[0-9]+\\.[0-9])[0-9]*', '\\1') AS params FROM fits)",
        f"err AS (SELECT f.model, r.split, r.charge, r.charge - ({fitted(FEATURES)}) AS e FROM prep r CROSS JOIN fits f)",
        f"""sc AS (SELECT model, split, count(*) AS n, sum(e * e) AS rss, {_M['mse']} AS mse, {_M['rmse']} AS rmse, {_M['mae']} AS mae, {_M['r2']} AS r2
            FROM err GROUP BY model, split)""",
        """rec AS (SELECT u.*, a.mse AS train_mse, a.rmse AS train_rmse, a.mae AS train_mae, a.r2 AS train_r2, t.mse AS test_mse,
            t.rmse AS test_rmse, t.mae AS test_mae, t.r2 AS test_r2, 1 - (1 - t.r2) * (t.n - 1) / (t.n - k - 1) AS adjusted_r2,
            a.n * ln(a.rss / a.n) + 2 * (k + 1) AS aic, a.n * ln(a.rss / a.n) + ln(a.n) * (k + 1) AS bic
            FROM used u JOIN sc a ON a.model = u.model AND a.split = 'train' JOIN sc t ON t.model = u.model AND t.split = 'test')"""]


RECORDS = _suite()
#: The residual tests and fit measures of the least-squares model.
CHECKS = [
    f"resid AS (SELECT r.*, {fitted(FEATURES)} AS fitted, r.charge - ({fitted(FEATURES)}) AS resid FROM train r CROSS JOIN ols f)",
    _SQUARES, *solve("a", "e2", FEATURES, "sq"), *_condition(),
    "lagged AS (SELECT resid AS e, lag(resid) OVER (ORDER BY ts, key) AS p FROM resid)",
    "shape AS (SELECT count(*) AS n, avg(pow(d, 2)) AS m2, avg(pow(d, 3)) AS m3, avg(pow(d, 4)) AS m4 FROM (SELECT resid - (SELECT avg(resid) FROM resid) AS d FROM resid))",
    "moment AS (SELECT n, m3 / pow(m2, 1.5) AS s, m4 / (m2 * m2) AS k, n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4) AS jb FROM shape)",
    f"""checks(key, value) AS (
      SELECT 'durbin_watson', sum((e - p) * (e - p)) / sum(e * e) FROM lagged
      UNION ALL SELECT 'jarque_bera_stat', jb FROM moment UNION ALL SELECT 'jarque_bera_pvalue', exp(-jb / 2) FROM moment
      UNION ALL SELECT 'skewness', s FROM moment UNION ALL SELECT 'kurtosis', k FROM moment
      UNION ALL SELECT 'breusch_pagan_stat', {_LM} FROM a UNION ALL SELECT 'breusch_pagan_pvalue', exp(-({_LM}) / 2) * (1 + ({_LM}) / 2) FROM a
      UNION ALL SELECT 'condition_number', condition_number FROM cond
      UNION ALL SELECT 'f_statistic', {_F} FROM ols UNION ALL SELECT 'f_pvalue', {_F_TAIL} FROM ols
      UNION ALL SELECT 'r2_adj', 1 - (rss / tss) * (n - 1) / (n - 5) FROM ols
      UNION ALL SELECT 'aic_loglik', n * ln(2 * pi()) + n * ln(rss / n) + n + 2 * 5 FROM ols
      UNION ALL SELECT 'bic_loglik', n * ln(2 * pi()) + n * ln(rss / n) + n + ln(n) * 5 FROM ols)"""]
_BEST = "best AS (SELECT * FROM rec WHERE (SELECT max(test_r2) FROM rec) - test_r2 < 0.0015 ORDER BY k, test_r2 DESC LIMIT 1)"
_SIDES = ", ".join(f"{rnd(f'{side}_{m}', d)} AS {side}_{m}" for side in ("train", "test") for m, d in (("mse", 1), ("rmse", 4), ("mae", 4), ("r2", 8)))
_RECORD = with_(*RECORDS, *CHECKS, recursive=True) + f"""
SELECT model_name, {_SIDES}, {rnd('adjusted_r2', 8)} AS adjusted_r2, {rnd('aic', 2)} AS aic, {rnd('bic', 2)} AS bic, k::int AS num_features_retained,
       params, CASE WHEN model = 'ols' THEN (SELECT string_agg(key || '=' || printf('%.5e', value), ', ' ORDER BY key) FROM checks) ELSE '' END AS diagnostics
FROM rec"""
ORACLE["model_record"] = ORACLE["report_json"] = _RECORD
ORACLE["comparison"] = ORACLE["run_all"] = with_(*RECORDS, recursive=True) + f"""
SELECT model_name AS model, {rnd('train_r2', 8)} AS train_r2, {rnd('test_r2', 8)} AS test_r2, {rnd('adjusted_r2', 8)} AS test_r2_adj,
       {rnd('test_rmse', 4)} AS test_rmse, {rnd('test_mae', 4)} AS test_mae, {rnd('aic', 2)} AS aic, {rnd('bic', 2)} AS bic,
       k::int AS n_features, params FROM rec"""
# one line per table of the whole job; the rules name none of the seven variables, so they are one category and stage
_OUTPUTS = [
    ("histogram", "(SELECT count(*) FROM range(1, 41))", "count(charge) FROM line"),
    ("density", "(SELECT count(*) FROM range(0, 200))", "100 * (min(charge) + max(charge)) FROM line"),
    ("box_stats", "count(*)", "count(*) FILTER (charge NOT BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) FROM line CROSS JOIN quarter"),
    ("series", "count(*)", "greatest(count(*) - 59, 0) FROM line"), ("top_correlated", "7", "corr(charge, disc_price) FROM line"),
    ("top_correlations", "7 * 6 / 2", "count(*) FROM line"),
    ("target_kpis", "count(*)", "count(*) FILTER (charge > 17.5) / count(*) FROM line"),
    ("parameters", str(_K), " + ".join(f"s_{f}" for f in FEATURES) + " FROM par"), ("classification", "7", "7"), ("category_counts", "1", "7"),
    ("residual_trend", "50", "count(*) FROM train"), ("qq_points", "199", "2.575829"),
    ("scale_location", "count(*)", "avg(sqrt(abs((resid - m) / s))) FROM resid CROSS JOIN (SELECT avg(resid) AS m, stddev_pop(resid) AS s FROM resid)"),
    ("residual_sequence", "count(*)", "avg(abs(resid)) FROM (SELECT resid FROM resid ORDER BY ts, key LIMIT 1000)"),
    ("stepwise_path", "count(*)", "min(aic) FROM walk WHERE action <> 'none'"),
    ("coefficients", "(SELECT sum(CASE WHEN model = 'stepwise' THEN known ELSE 4 END) FROM fits)", "max(greatest(b_price, b_discount, b_tax, b_qty)) FROM fits"),
    ("metrics", "count(*)", "sum(n) FROM sc"),
    ("feature_importance", "any_value(best.k)", "max(greatest(b_price, b_discount, b_tax, b_qty)) FROM fits JOIN best USING (model)"),
    ("train", "count(*)", "avg(charge) FROM train"), ("scored", "count(*)", f"avg({fitted(FEATURES)}) FROM prep r CROSS JOIN ols f"),
    ("ols_coefficients", "5", "greatest(b0, b_price, b_discount, b_tax, b_qty) FROM ols")]
ORACLE["run_outputs"] = with_(
    *RECORDS, CHECKS[0], _BEST, "quarter AS (SELECT quantile_cont(charge, 0.25) AS a, quantile_cont(charge, 0.75) AS b FROM line)", recursive=True
) + " UNION ALL ".join(
    f"SELECT '{name}' AS output, ({n})::bigint AS n, {rnd('(' + value.split(' FROM ', 1)[0] + ')::double', 1)} AS value"
    + (" FROM " + value.split(" FROM ", 1)[1] if " FROM " in value else "") for name, n, value in _OUTPUTS)
ORACLE["comparison_chart"] = with_(*RECORDS, recursive=True) + (
    f"SELECT model_name, {rnd('test_r2', 8)} AS test_r2, {rnd('test_rmse', 4)} AS test_rmse, k::int AS num_features_retained FROM rec")
ORACLE["select_best"] = with_(*RECORDS, _BEST, recursive=True) + f"SELECT model_name, {rnd('test_r2', 8)} AS test_r2, k::int AS num_features_retained FROM best"
ORACLE["select_highest"] = with_(*RECORDS, recursive=True) + f"SELECT model_name, {rnd('test_r2', 8)} AS test_r2 FROM rec ORDER BY rec.test_r2 DESC LIMIT 1"
ORACLE["suite_predictions"] = with_(*RECORDS, recursive=True) + "SELECT r.key, r.split, " + ", ".join(
    f"max(CASE WHEN f.model = '{m}' THEN {rnd(fitted(FEATURES), 1)} END) AS fitted_{m}" for m in ("ols", "stepwise", "ridge", "lasso", "elasticnet")) + (
    " FROM prep r CROSS JOIN fits f GROUP BY r.key, r.split")
ORACLE["suite_coefficients"] = with_(*RECORDS, recursive=True) + " UNION ALL ".join(
    f"SELECT model, '{f}' AS feature, {rnd(f'b_{f}', 3)} AS coef FROM fits WHERE known = {_K} OR b_{f} <> 0" for f in FEATURES)
ORACLE["failed_model_row"] = with_(*RESID, "t AS (SELECT r.charge, r.charge - (" + fitted(FEATURES) + ") AS e FROM prep r CROSS JOIN ols f WHERE split = 'test')") + f"""
SELECT 'ols' AS model, 'Regresion Lineal MCO (OLS)' AS model_name, {rnd(_M['r2'], 9)} AS test_r2, NULL::varchar AS error FROM t
UNION ALL SELECT 'broken', 'OLS broken', NULL, 'ArithmeticError: singular'"""
_SHRUNK = {"weak": 0.5, "middle": 1000.0, "strong": 5000.0}
_PENALTIES = "lams(lam_no, lam, model) AS (VALUES " + ", ".join(f"({i}, {a}::double, '{k}')" for i, (k, a) in enumerate(_SHRUNK.items())) + ")"
ORACLE["nonzero_coefs"] = with_(
    *_net([1.0], _PENALTIES, 150, _NINE, [FEAT, *prep(_NINE, "feat")], sums("test_s", "train", [*_NINE, "charge"], "fold")), recursive=True) + (
    "SELECT model, " + " + ".join(f"(b_{f} <> 0)::bigint" for f in _NINE) + " AS n_active, 9::bigint AS n_total, "
    + rnd("100.0::double * (1 - (" + " + ".join(f"(b_{f} <> 0)::bigint" for f in _NINE) + ") / 9.0::double)", 6) + " AS sparsity_pct, concat_ws(',', "
    + ", ".join(f"CASE WHEN b_{f} <> 0 THEN '{f}' END" for f in sorted(_NINE)) + ") AS features FROM fin JOIN lams USING (lam_no) WHERE held = -1")
_COEFS = [FEAT, *prep(_NINE, "feat"), *solve("w", "train", _NINE), "coefs AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, b_{f} AS coef FROM w" for f in _NINE) + ")"]
ORACLE["top_coefs"] = with_(*_COEFS) + f"""
SELECT feature, {rnd('coef', 5)} AS coef FROM (SELECT *, row_number() OVER (ORDER BY coef DESC) AS hi, row_number() OVER (ORDER BY coef) AS lo FROM coefs)
WHERE hi <= 7 OR lo <= 7"""
ORACLE["top_coefs_by_size"] = with_(*_COEFS) + f"""
SELECT width::int AS width, rank::int AS rank, feature, {rnd('coef', 5)} AS coef
FROM (SELECT *, row_number() OVER (ORDER BY abs(coefs.coef) DESC) AS rank FROM coefs) CROSS JOIN (VALUES (15), (10)) v(width) WHERE rank <= width"""
ORACLE["format_model_params"] = """
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'N/A'
  ELSE 'cv_folds=' || p_size || ', lambda_optimo=' || printf('%.4f', p_retailprice) END AS params FROM part"""


def _facts() -> str:
    f = lambda e, d: f"printf('%.{d}f', {e})"
    ctx = [("design_limit", "'17.50'"), ("observed_mean", f("avg(value)", 2)), ("observed_max", f("max(value)", 2)),
           ("share_over_limit", f("count(*) FILTER (value > 17.5) / count(value)", 4)), ("historical_mean", "'19.10'"),
           ("historical_max", "'20.37'"), ("annual_savings_usd", "'1600000'"), ("benefit_30pct_usd", "'500000'")]
    parts = [f"SELECT 'context' AS section, '{k}' AS key, {v} AS value FROM series" if "(" in v else f"SELECT 'context', '{k}', {v}" for k, v in ctx]
    parts.sort(key=lambda p: "AS section" not in p)
    for k, e in (("test_r2", f("test_r2", 4)), ("test_rmse", f("test_rmse", 4)), ("n_features", "k::varchar")):
        parts.append(f"SELECT 'comparison', model || '.{k}', {e} FROM rec")
    for k, e in (("model", "model_name"), ("test_r2", f("test_r2", 4)), ("test_rmse", f("test_rmse", 4)), ("test_mae", f("test_mae", 4)), ("n_features", "k::varchar")):
        parts.append(f"SELECT 'winner', '{k}', {e} FROM best")
    parts.append("SELECT 'diagnostics', 'ols.' || key, printf('%.5e', printf('%.4f', value)::double) FROM checks")
    return with_(SERIES, *RECORDS, *CHECKS, _BEST, recursive=True) + " UNION ALL ".join(parts)


ORACLE["report_facts"] = _facts()
