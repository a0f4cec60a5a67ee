"""Filling missing positions and fix types of keyframes from the other keyframes of their map.

Within a map the position is close to an affine function of the camera centre, so each map's own conditional
expectation comes from its sufficient statistics (one map-side combined aggregate, a ridge of the smallest weight that
keeps a short track solvable). What is left, the residual in metres east, north and up together with the fix type, is
modelled over all maps as a mixture of Gaussian-categorical components, fitted by expectation-maximisation: each pass
sends the per-partition sums of `COMPONENTS` x (moments) only, and passes end when the penalised likelihood rises by less
than `GAIN` a row. Missing coordinates get the map's expectation plus the mixture's conditional expectation of the
residual given the coordinates and the fix type that are there; missing fix types get the mode of the posterior under the
map's own frequencies. Masks say what was filled. A field that no keyframe of the map carries stays null and unmarked.

Residuals are written once as a table in the shared folder; a pass reads four narrow columns of it and nothing stays cached.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.operators.proximity import finite, norm_lon
from terrafold.operators.skew import GroupSpread
from terrafold.session import stored

# Fix types that receivers report.
FIX_TYPES = ("rtk_fixed", "rtk_float", "dgps", "single")
#: Altitudes of exactly 0 count only where the map's other altitudes lie within so many metres of 0.
ZERO_ALT_M = 20.0
LOWEST_ALT_M = -1000.0
METRES_PER_DEGREE = 111_195.08
#: Components; pseudo-count of each fix type; gain in log likelihood a row at which the fit ends; passes at most (reached by no fit so far).
COMPONENTS, SMOOTHING, GAIN, MOST_PASSES = 3, 1.0, 1e-3, 60
#: Ridge in units of the camera track's variance.
RIDGE = 1e-4
FIELDS = ("lat", "lon", "alt", "fix")
_T = ("e", "n", "u")


def _cleaned(cameras: DataFrame) -> DataFrame:
    """What each row carries: map_id, frame, cx, cy, cz, lat, lon, alt (without zeros), alt_zero, fix (its number in FIX_TYPES)."""
    lat, lon, alt = F.col("gps.lat"), F.col("gps.lon"), F.col("gps.alt")
    null_island = F.coalesce((lat == 0.0) & (lon == 0.0), F.lit(False))
    fix = F.trim("gps_fix")
    code = F.coalesce(*[F.when(fix == v, F.lit(k)) for k, v in enumerate(FIX_TYPES)])
    return cameras.where(F.col("map_id").isNotNull() & F.col("frame").isNotNull()).select(
        "map_id", "frame",
        *[F.when(finite(F.col(c)), F.col(c)).alias(c) for c in ("cx", "cy", "cz")],
        F.when(finite(lat) & (F.abs(lat) <= 90.0) & ~null_island, lat).alias("lat"),
        F.when(finite(lon) & (F.abs(lon) <= 180.0) & ~null_island, lon).alias("lon"),
        F.when(finite(alt) & (alt >= LOWEST_ALT_M) & (alt != 0.0), alt).alias("alt"),
        F.coalesce(alt == 0.0, F.lit(False)).alias("alt_zero"),
        code.alias("fix"),
    )


def keyframes(cameras: DataFrame) -> tuple[DataFrame, GroupSpread]:
    """One row a keyframe with what any of its rows carries (the least value where rows differ), about its map's reference.

    Rows without map_id or frame are no keyframes. Columns: map_id, frame, lat, lon, alt (zeros only where the map lies near
    0), fix (a number), lat0, lon0, alt0, the centred camera _cx, _cy, _cz and the position e, n, u in metres; rows lie
    by (map_id, _salt), placed once for all that follows. The reference is an aggregate of the rows as they are read.
    """
    rows = _cleaned(cameras)
    ref = rows.groupBy("map_id").agg(
        F.min("lat").alias("lat0"), F.min("lon").alias("lon0"), F.min("alt").alias("alt0"), F.max(F.abs("alt")).alias("_far"),
        *[F.avg(c).alias(f"m{c}") for c in ("cx", "cy", "cz")],
        F.sqrt(F.var_pop("cx") + F.var_pop("cy") + F.var_pop("cz")).alias("scale"),
    )
    # A map whose only altitudes are zeros is measured from 0.
    ref = ref.withColumn("alt0", F.coalesce("alt0", F.lit(0.0)))
    spread = GroupSpread(rows, "map_id", "frame")
    least = [F.min(c).alias(c) for c in ("cx", "cy", "cz", "lat", "lon", "alt", "fix")]
    kf = spread.place(rows).groupBy("map_id", "_salt", "frame").agg(*least, F.max("alt_zero").alias("alt_zero"))
    x = spread.join(kf, ref)
    near_zero = F.coalesce(F.col("_far") <= ZERO_ALT_M, F.lit(False))
    x = x.withColumn("alt", F.when(F.col("alt").isNull() & F.col("alt_zero") & near_zero, F.lit(0.0)).otherwise(F.col("alt")))
    scale = F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0)
    x = x.withColumns({f"_{c}": F.coalesce((F.col(c) - F.col(f"m{c}")) / scale, F.lit(0.0)) for c in ("cx", "cy", "cz")})
    x = x.withColumns({
        "e": norm_lon(F.col("lon") - F.col("lon0")) * METRES_PER_DEGREE * F.cos(F.radians(F.coalesce("lat0", F.lit(0.0)))),
        "n": (F.col("lat") - F.col("lat0")) * METRES_PER_DEGREE,
        "u": F.col("alt") - F.col("alt0"),
    })
    return x.drop("cx", "cy", "cz", "mcx", "mcy", "mcz", "scale", "alt_zero", "_far"), spread


def map_models(x: DataFrame) -> DataFrame:
    """Per map: coefficients of e, n, u on (1, cx, cy, cz), how many keyframes carry each field, and the counts of fix types."""
    z = [F.lit(1.0), F.col("_cx"), F.col("_cy"), F.col("_cz")]
    aggs = []
    for t in _T:
        there = F.col(t).isNotNull()
        aggs += [F.coalesce(F.sum(F.when(there, z[i] * z[j])), F.lit(0.0)).alias(f"{t}_{i}{j}") for i in range(4) for j in range(i, 4)]
        aggs += [F.coalesce(F.sum(F.when(there, z[i] * F.col(t))), F.lit(0.0)).alias(f"{t}_y{i}") for i in range(4)]
    # lon needs lat0 for metres; a map that carries longitudes only is measured at the equator's scale.
    carries = [F.count("lat").alias("c_lat"), F.count("lon").alias("c_lon"), F.count("alt").alias("c_alt"), F.count("fix").alias("c_fix")]
    fixes = [F.count(F.when(F.col("fix") == k, 1)).alias(f"f{k}") for k in range(len(FIX_TYPES))]
    stats = x.groupBy("map_id").agg(*aggs, *carries, *fixes)
    keep = ["map_id", "c_lat", "c_lon", "c_alt", "c_fix", *[f"f{k}" for k in range(len(FIX_TYPES))]]
    names = [f"{t}_b{i}" for t in _T for i in range(4)]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[keep].copy()
            for t in _T:
                a = np.zeros((len(b), 4, 4))
                for i in range(4):
                    for j in range(i, 4):
                        a[:, i, j] = a[:, j, i] = b[f"{t}_{i}{j}"].to_numpy()
                y = np.stack([b[f"{t}_y{i}"].to_numpy() for i in range(4)], 1)
                a += np.diag([1e-9, RIDGE, RIDGE, RIDGE])
                beta = np.linalg.solve(a, y[:, :, None])[:, :, 0] if len(b) else np.zeros((0, 4))
                for i in range(4):
                    out[f"{t}_b{i}"] = beta[:, i]
            yield out

    types = {f.name: f.dataType.simpleString() for f in stats.schema}
    schema = ", ".join([f"{c} {types[c]}" for c in keep] + [f"{c} double" for c in names])
    return stats.mapInPandas(solve, schema)


def _expected(r: np.ndarray, c: np.ndarray, m: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """E-step: responsibilities (n x K), residuals with gaps at their conditional expectation (n x K x 3), log likelihood of each row, and the pattern of gaps.

    r: n x 3 residuals with NaN where missing; c: fix type or -1. Rows are taken by pattern; bit i says that coordinate i is there.
    """
    n, k = len(r), len(m["pi"])
    logw, fill = np.tile(np.log(m["pi"]), (n, 1)), np.repeat(np.nan_to_num(r)[:, None, :], k, 1)
    has = c >= 0
    logw[has] += np.log(m["theta"][:, c[has]]).T
    pattern = np.isfinite(r) @ np.array([1, 2, 4])
    for pat in np.unique(pattern):
        rows = slice(None) if (pattern == pat).all() else np.nonzero(pattern == pat)[0]
        o = np.array([bool(pat & 1), bool(pat & 2), bool(pat & 4)])
        for j in range(k):
            mu, s = m["mu"][j], m["sigma"][j]
            part = fill[rows, j]
            if o.any():
                inv = np.linalg.inv(s[np.ix_(o, o)])
                d = part[:, o] - mu[o]
                logw[rows, j] -= 0.5 * (((d @ inv) * d).sum(1) + np.linalg.slogdet(s[np.ix_(o, o)])[1] + o.sum() * np.log(2 * np.pi))
                part[:, ~o] = mu[~o] + d @ (inv @ s[np.ix_(o, ~o)])
            else:
                part[:] = mu
            fill[rows, j] = part
    top = logw.max(1, keepdims=True) if n else logw
    w = np.exp(logw - top)
    total = w.sum(1, keepdims=True)
    return w / total, fill, (top + np.log(total))[:, 0] if n else np.zeros(0), pattern


def _gap_covariance(s: np.ndarray, pat: int) -> np.ndarray:
    """Covariance of the missing coordinates given those there, in a 3 x 3 matrix that is 0 elsewhere."""
    o = np.array([bool(pat & 1), bool(pat & 2), bool(pat & 4)])
    out = np.zeros((3, 3))
    left = s[np.ix_(~o, ~o)]
    if o.any():
        left = left - s[np.ix_(~o, o)] @ np.linalg.inv(s[np.ix_(o, o)]) @ s[np.ix_(o, ~o)]
    out[np.ix_(~o, ~o)] = left
    return out


def _sums(r: np.ndarray, c: np.ndarray, m: dict) -> np.ndarray:
    """Expected sufficient statistics of a batch, flat: K x (1 + 3 + 9 + fix types), then the log likelihood."""
    w, fill, loglik, pattern = _expected(r, c, m)
    k, cats = len(m["pi"]), len(FIX_TYPES)
    out = np.zeros((k, 13 + cats))
    known = c >= 0
    for j in range(k):
        f, wj = fill[:, j, :], w[:, j]
        second = (f * wj[:, None]).T @ f
        for pat in np.unique(pattern[pattern < 7]):
            second += wj[pattern == pat].sum() * _gap_covariance(m["sigma"][j], int(pat))
        out[j, 0], out[j, 1:4], out[j, 4:13] = wj.sum(), wj @ f, second.ravel()
        out[j, 13:] = np.bincount(c[known], wj[known], cats)
    return np.r_[out.ravel(), loglik.sum()]


def _penalty(m: dict, psi: np.ndarray) -> float:
    """The priors' share of what a pass raises: psi keeps covariances off 0, SMOOTHING fix types off 0."""
    return float(sum(-0.5 * np.trace(psi @ np.linalg.inv(s)) for s in m["sigma"]) + SMOOTHING * np.log(m["theta"]).sum())


def _maximised(s: np.ndarray, psi: np.ndarray) -> dict:
    """M-step under the priors, from the summed statistics K x (13 + fix types).

    The components' means stay at 0: each map's own expectation has taken them out of its residuals, and a few maps of wild
    readings must not move what is filled in all others.
    """
    w = np.maximum(s[:, 0], 1e-9)
    fixes = s[:, 13:] + SMOOTHING
    return {"pi": np.maximum(w / w.sum(), 1e-9), "mu": np.zeros((len(w), 3)), "sigma": (s[:, 4:13].reshape(-1, 3, 3) + psi) / w[:, None, None], "theta": fixes / fixes.sum(1, keepdims=True)}


def start_mixture(spread: np.ndarray) -> dict:
    """Components about 0 at one, three and nine times the residuals' spread, leaning to better and worse fix types."""
    cats = len(FIX_TYPES)
    return {
        "pi": np.full(COMPONENTS, 1 / COMPONENTS), "mu": np.zeros((COMPONENTS, 3)),
        "sigma": np.stack([np.diag((spread * 3.0**k) ** 2) for k in range(COMPONENTS)]),
        "theta": np.stack([np.roll(np.linspace(1.6, 0.4, cats), k) for k in range(COMPONENTS)]) / cats,
    }


def fit_mixture(residuals: DataFrame, passes: int = MOST_PASSES, gain: float = GAIN) -> tuple[dict, list[float]]:
    """EM over columns re, rn, ru (null where missing) and cat: (model, penalised log likelihood before each pass, which never falls).

    The driver sees the summed statistics of COMPONENTS components only. A table without rows gives the starting model.
    """
    n, *first = residuals.agg(F.count(F.lit(1)), *[F.percentile_approx(F.abs(c), 0.5, 1000) for c in ("re", "rn", "ru")]).first()
    spread = np.maximum(np.array([1.0 if v is None else v for v in first]) * 1.4826, 1e-3)
    psi, m, seen = np.diag(spread**2 * 1e-3 + 1e-8), start_mixture(spread), []
    width = COMPONENTS * (13 + len(FIX_TYPES)) + 1
    for _ in range(passes if n else 0):

        def part(batches: Iterator[pd.DataFrame], m: dict = m) -> Iterator[pd.DataFrame]:
            total = np.zeros(width)
            for b in batches:
                if len(b):
                    total += _sums(b[["re", "rn", "ru"]].to_numpy(float), b["cat"].to_numpy(int), m)
            yield pd.DataFrame({"k": np.arange(width), "v": total})

        s = np.zeros(width)
        for row in residuals.select("re", "rn", "ru", "cat").mapInPandas(part, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            s[row["k"]] = row["v"]
        seen.append(s[-1] + _penalty(m, psi))
        if len(seen) > 1 and seen[-1] - seen[-2] < gain * n:
            break
        m = _maximised(s[:-1].reshape(COMPONENTS, -1), psi)
    return m, seen


def residual_table(cameras: DataFrame) -> DataFrame:
    """One row a keyframe, stored: what it carries, its map's expectation (xlat, xlon, xalt), the residuals re, rn, ru, cat, the map's fix counts and which fields it has."""
    x, spread = keyframes(cameras)
    y = spread.join(x, map_models(x))
    expect = {t: sum((F.col(f"{t}_b{i}") * F.col(c) for i, c in ((1, "_cx"), (2, "_cy"), (3, "_cz"))), F.col(f"{t}_b0")) for t in _T}
    y = y.withColumns({f"x{t}": expect[t] for t in _T})
    residual: list[Column] = [(F.col(t) - F.col(f"x{t}")).cast("float").alias(f"r{t}") for t in _T]
    degrees = METRES_PER_DEGREE * F.cos(F.radians(F.coalesce("lat0", F.lit(0.0))))
    return stored(y.select(
        "map_id", "frame", "lat", "lon", "alt", "fix",
        (F.coalesce("lat0", F.lit(0.0)) + F.col("xn") / METRES_PER_DEGREE).alias("xlat"), (F.col("lon0") + F.col("xe") / degrees).alias("xlon"), (F.col("alt0") + F.col("xu")).alias("xalt"),
        degrees.alias("degrees"), *residual, F.coalesce("fix", F.lit(-1)).cast("int").alias("cat"),
        *[(F.col(f"c_{f}") > 0).alias(f"c_{f}") for f in FIELDS], *[F.col(f"f{k}").cast("int").alias(f"f{k}") for k in range(len(FIX_TYPES))],
    ))


def fill_keyframes(cameras: DataFrame, mixture: bool = True) -> DataFrame:
    """Every keyframe once: map_id, frame, lat, lon, alt, fix and the masks lat_filled, lon_filled, alt_filled, fix_filled.

    Null, NaN, blank and impossible values are missing. Rows that repeat a keyframe are merged; an empty table gives an
    empty result; further columns of the input are ignored. mixture=False leaves each map's own expectation and most
    frequent fix type alone, to compare with.
    """
    y = residual_table(cameras)
    model = fit_mixture(y)[0] if mixture else None
    schema = "map_id string, frame int, lat double, lon double, alt double, fix string, lat_filled boolean, lon_filled boolean, alt_filled boolean, fix_filled boolean"

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = np.array(FIX_TYPES, dtype=object)
        for b in batches:
            if not len(b):
                continue
            c, freq = b["cat"].to_numpy(int), b[[f"f{k}" for k in range(len(FIX_TYPES))]].to_numpy(float)
            mean = np.zeros((len(b), 3))
            if model is not None:
                w, fill, _, _ = _expected(b[["re", "rn", "ru"]].to_numpy(float), c, model)
                mean = (w[:, :, None] * fill).sum(1)
                freq = freq * np.maximum(w @ model["theta"], 1e-12) / np.maximum(model["pi"] @ model["theta"], 1e-12)
            est = {"lat": np.clip(b.xlat.to_numpy(float) + mean[:, 1] / METRES_PER_DEGREE, -90.0, 90.0), "lon": (b.xlon.to_numpy(float) + mean[:, 0] / b.degrees.to_numpy(float) + 180.0) % 360.0 - 180.0, "alt": b.xalt.to_numpy(float) + mean[:, 2]}
            out = b[["map_id", "frame"]].copy()
            for f in ("lat", "lon", "alt"):
                gap = b[f].isna().to_numpy() & b[f"c_{f}"].to_numpy(bool)
                out[f], out[f"{f}_filled"] = np.where(gap, est[f], b[f].to_numpy(float)), gap
            gap = (c < 0) & b.c_fix.to_numpy(bool)
            code = np.where(gap, np.argmax(freq, 1), c)
            out["fix"], out["fix_filled"] = np.where(code >= 0, names[code], None), gap
            yield out[["map_id", "frame", *FIELDS, *[f"{f}_filled" for f in FIELDS]]]

    return y.mapInPandas(apply, schema)


def filled_fields(filled: DataFrame) -> DataFrame:
    """The marks as rows: map_id, frame, field."""
    marks = F.array_compact(F.array(*[F.when(F.col(f"{f}_filled"), F.lit(f)) for f in FIELDS]))
    return filled.select("map_id", "frame", F.explode(marks).alias("field"))
