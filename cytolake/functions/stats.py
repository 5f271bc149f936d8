"""Weighted moments, Welch's test and the Student t distribution as column expressions.

Observations are ratios of counts, weighted by depth. Groups of any size are plain sums that merge before and after a
shuffle. The squares around the mean are a difference of sums, and nothing cancels in it: a call's square, methylated
times methylated over depth, is kept as a whole number and a proper fraction, so the whole numbers are taken from each
other exactly and only fractions below one are rounded. Where all calls of a site are in hand as an array, squares are
taken around the mean itself. Equal observations have a variance of exactly zero.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import INF, NAN, safe_div

#: Lanczos coefficients for g = 7.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
#: Terms of the continued fraction of the incomplete beta function, taken two at a time.
TERMS = 50


@dataclass(frozen=True)
class Moments:
    """Columns of one group of weighted observations."""

    n: Column
    mean: Column
    variance: Column


#: What is kept of a part of a group: observations, weights, their squares, the mean, squares around it, least and greatest.
_KEPT = ("n", "w", "w2", "mean", "ss", "lo", "hi")


#: Sums of a group: observations, depth, its squares, methylated; of the squares of calls over depth the whole numbers and
#: the fractions; least and greatest ratio.
_SUMS = ("n", "t", "t2", "m", "q", "f", "lo", "hi")
#: Greatest count whose square is a long.
_SQUARE = 3_037_000_499


def _whole_and_rest(m: Column, t: Column) -> tuple[Column, Column]:
    """``m * m`` divided by ``t``: the whole number, and the rest as a part of ``t``; null at depth 0. Counts are whole."""
    m, t = m.cast("long"), F.nullif(t.cast("long"), F.lit(0).cast("long"))
    small, great = m <= _SQUARE, m.cast("decimal(19,0)") * m.cast("decimal(19,0)")
    wide = t.cast("decimal(19,0)")
    square = F.when(small, m) * F.when(small, m)
    whole = F.when(small, F.call_function("div", square, t)).otherwise(F.call_function("div", great, wide))
    rest = F.when(small, (square % t).cast("double")).otherwise((great % wide).cast("double"))
    return whole, rest / t.cast("double")


def count_sums(methylated: Column, total: Column, chosen: Column, name: str) -> list[Column]:
    """The aggregates of a part's calls, those where ``chosen`` holds, named ``name`` and the sum."""
    v, (whole, rest) = safe_div(methylated, total), _whole_and_rest(methylated, total)
    of = lambda x: F.when(chosen, x)
    depth = total.cast("double")
    made = {
        "n": F.count(of(v)), "t": F.sum(of(total.cast("long"))), "t2": F.sum(of(depth * depth)), "m": F.sum(of(methylated.cast("long"))),
        "q": F.sum(of(whole)), "f": F.sum(of(rest)), "lo": F.min(of(v)), "hi": F.max(of(v)),
    }
    return [made[k].alias(f"{name}{k}") for k in _SUMS]


def with_parts(groups: DataFrame, names: dict[str, str]) -> DataFrame:
    """``groups`` with a struct as ``part`` makes it for each of ``names``, from the sums of ``count_sums``, which go."""
    steps: dict[str, Column] = {}
    for name in names.values():
        c = lambda k, name=name: F.col(f"{name}{k}")
        m, t = c("m").cast("decimal(19,0)"), F.nullif(c("t"), F.lit(0).cast("long")).cast("decimal(19,0)")
        steps[f"{name}whole"] = c("q") - F.call_function("div", m * m, t)
        steps[f"{name}rest"] = c("f") - (m * m % t).cast("double") / c("t").cast("double")
    out = groups.withColumns(steps)
    parts = {}
    for part_name, name in names.items():
        c = lambda k, name=name: F.col(f"{name}{k}")
        one, none = c("lo") == c("hi"), F.isnan(c("hi"))
        mean = F.when(none, F.lit(NAN)).when(one, c("lo")).otherwise(safe_div(c("m"), c("t")))
        squares = F.when(none, F.lit(NAN)).when(one, F.lit(0.0)).otherwise(F.greatest(c("whole").cast("double") + c("rest"), F.lit(0.0)))
        made = {"n": c("n"), "w": c("t").cast("double"), "w2": c("t2"), "mean": mean, "ss": squares, "lo": c("lo"), "hi": c("hi")}
        parts[part_name] = F.struct(*[made[k].alias(k) for k in _KEPT])
    gone = [f"{name}{k}" for name in names.values() for k in (*_SUMS, "whole", "rest")]
    return out.withColumns(parts).drop(*gone)


def _sum(items: Column, f) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + f(x))


def part(items: Column) -> Column:
    """A struct of what is kept of an array of observations, each a value ``v`` and a weight ``w``."""
    n, w = F.size(items).cast("long"), _sum(items, lambda x: x["w"])
    lo, hi = F.array_min(F.transform(items, lambda x: x["v"])), F.array_max(F.transform(items, lambda x: x["v"]))
    one = F.array(F.struct(items.alias("x"), n.alias("n"), w.alias("w"), lo.alias("lo"), hi.alias("hi")))

    def centred(s: Column) -> Column:
        mean = F.when(s["lo"] == s["hi"], s["lo"]).otherwise(safe_div(_sum(s["x"], lambda x: x["w"] * x["v"]), s["w"]))
        return F.struct(s["x"].alias("x"), s["n"].alias("n"), s["w"].alias("w"), s["lo"].alias("lo"), s["hi"].alias("hi"), mean.alias("mean"))

    def kept(s: Column) -> Column:
        squares = F.when(s["lo"] == s["hi"], F.lit(0.0)).otherwise(_sum(s["x"], lambda x: x["w"] * (x["v"] - s["mean"]) * (x["v"] - s["mean"])))
        made = {"n": s["n"], "w": s["w"], "w2": _sum(s["x"], lambda x: x["w"] * x["w"]), "mean": s["mean"], "ss": squares, "lo": s["lo"], "hi": s["hi"]}
        return F.struct(*[made[k].alias(k) for k in _KEPT])

    return F.transform(F.transform(one, centred), kept)[0]  # in steps, so that each value is worked out once


def moments(p: Column) -> Moments:
    """Weighted mean, and the variance that is unbiased for repeated observations, of a struct of ``part`` or ``with_parts``."""
    return Moments(F.coalesce(p["n"], F.lit(0)), p["mean"], safe_div(p["w"], p["w"] * p["w"] - p["w2"]) * p["ss"])


def with_moments(groups: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and n, mean and variance of both conditions from ``part_1`` and ``part_2``."""
    a, b = moments(F.col("part_1")), moments(F.col("part_2"))
    made = {"n_1": a.n, "mean_1": a.mean, "variance_1": a.variance, "n_2": b.n, "mean_2": b.mean, "variance_2": b.variance}
    return groups.select(*keep, *[c.alias(n) for n, c in made.items()])


def with_welch(groups: DataFrame) -> DataFrame:
    """``groups`` of ``with_moments`` with ``t`` and ``df``: both variances zero give an infinite or NaN t
    and NaN degrees. Every step is a projection of its own, which keeps its expressions small."""
    c = F.col
    parts = groups.withColumns({"va": safe_div(c("variance_1"), c("n_1")), "vb": safe_div(c("variance_2"), c("n_2"))})
    parts = parts.withColumns({"pooled": c("va") + c("vb"), "above": c("mean_1") - c("mean_2")})
    parts = parts.withColumns({"root": F.sqrt("pooled"), "da": safe_div(c("va") * c("va"), c("n_1") - 1), "db": safe_div(c("vb") * c("vb"), c("n_2") - 1)})
    parts = parts.withColumns({"square": c("pooled") * c("pooled"), "below": c("da") + c("db")})
    out = parts.withColumns({"t": safe_div(c("above"), c("root")), "df": safe_div(c("square"), c("below"))})
    return out.drop("va", "vb", "pooled", "above", "root", "da", "db", "square", "below")


def log_gamma(x: Column) -> Column:
    """For x of one half or more."""
    z = x - 1.0
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (z + float(i))
    t = z + 7.5
    return F.lit(0.9189385332046727) + (z + 0.5) * F.log(t) - t + F.log(series)


def _fraction(a: Column, b: Column, x: Column, y: Column, log_beta: Column) -> Column:
    """The regularised incomplete beta function where its continued fraction converges; y = 1 - x."""

    def step(acc: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1.0 + even / (1.0 + odd / acc)

    pairs = F.array(*[F.lit(float(m)) for m in range(TERMS // 2, 0, -1)])
    tail = 1.0 - (a + b) * x / (a + 1.0) / F.aggregate(pairs, F.lit(1.0), step)
    return F.exp(a * F.log(x) + b * F.log(y) - log_beta) / (a * tail)


def two_tailed_p(t: Column, df: Column) -> Column:
    """The probability of a Student t at least as far from zero; NaN if t or df is NaN, null if either is null.

    It is the regularised incomplete beta function of df/2 and 1/2 at df / (df + t*t)."""

    def prepared(s: Column) -> Column:
        t2, n = s["t"] * s["t"], s["df"]
        sound = ~(s["t"].isNull() | n.isNull() | F.isnan(s["t"]) | F.isnan(n) | (F.abs(s["t"]) == F.lit(INF)) | (t2 == 0))
        return F.struct(
            s["t"].alias("t"), n.alias("df"), sound.alias("sound"), (n / 2.0).alias("a"),
            F.when(sound, n / (n + t2)).alias("x"), F.when(sound, t2 / (n + t2)).alias("y"),
            F.when(sound, log_gamma(n / 2.0) + F.lit(0.5723649429247001) - log_gamma(n / 2.0 + 0.5)).alias("log_beta"),
        )

    def of(s: Column) -> Column:
        a, x, y, half = s["a"], s["x"], s["y"], F.lit(0.5)
        direct = _fraction(a, half, x, y, s["log_beta"])
        mirrored = 1.0 - _fraction(half, a, y, x, s["log_beta"])
        return (
            F.when(s["sound"], F.when(x <= (a + 1.0) / (a + 2.5), direct).otherwise(mirrored))
            .when(s["t"].isNull() | s["df"].isNull(), F.lit(None).cast("double"))
            .when(F.isnan(s["t"]) | F.isnan(s["df"]), F.lit(NAN))
            .when(F.abs(s["t"]) == F.lit(INF), F.lit(0.0))
            .otherwise(F.lit(1.0))
        )

    one = F.array(F.struct(t.cast("double").alias("t"), df.cast("double").alias("df")))
    return F.transform(F.transform(one, prepared), of)[0]  # in two steps, so that terms are worked out once


def close_to(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Whether two statistics agree within a relative tolerance; two NaN agree."""
    return (F.isnan(a) & F.isnan(b)) | (a == b) | (F.abs(a - b) <= F.abs(a) * tolerance)
