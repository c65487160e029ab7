"""Column expressions shared by every operator (all JVM-side, codegen friendly)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fidelis import config

_TWO_52 = float(2 ** 52)


def clean(col: str | Column) -> Column:
    """NaN -> NULL so that comparisons and aggregates follow missing-value semantics."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nanvl(c, F.lit(None).cast("double"))


def clean_frame(df: DataFrame) -> DataFrame:
    """Apply :func:`clean` to every floating-point column, keeping names and order."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(clean(F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def hash_uniform(key: str | Column, seed: int | Column, salt: str = "") -> Column:
    """Deterministic uniform in [0, 1) from (key, seed, salt).

    Unlike ``rand(seed)`` the value does not depend on partitioning, so a
    re-executed task (executor loss) or a different cluster produces the same draw.
    Equivalent SQL: ``conv(substr(md5(concat(key,'-',seed,'-',salt)),1,13),16,10)/2^52``.
    """
    k = F.col(key) if isinstance(key, str) else key
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    digest = F.md5(F.concat(k.cast("string"), F.lit("-"), s.cast("string"), F.lit("-"), F.lit(salt)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(_TWO_52)


def hash_normal(key: str | Column, seed: int | Column, salt: str = "") -> Column:
    """Standard normal draw by Box-Muller over two hashed uniforms."""
    u1 = F.greatest(hash_uniform(key, seed, salt + "#u1"), F.lit(2.0 ** -53))
    u2 = hash_uniform(key, seed, salt + "#u2")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def clip(col: str | Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Clamp to [lower, upper]; NULL stays NULL (``greatest`` alone would turn it into the bound)."""
    c = F.col(col) if isinstance(col, str) else col
    out = c
    if lower is not None:
        out = F.greatest(out, F.lit(float(lower)))
    if upper is not None:
        out = F.least(out, F.lit(float(upper)))
    return F.when(c.isNotNull(), out)


def threshold_label(col: str | Column, cut: float = 0.5) -> Column:
    """Float label from a generator -> 0/1 integer (strictly above ``cut`` is 1)."""
    c = F.col(col) if isinstance(col, str) else col
    return (c > F.lit(cut)).cast("int")


def seconds_to_hours(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c / F.lit(3600.0)


def log1p_amount(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.log1p(c)


def quality_band(stat: str | Column, bands=None, otherwise: str = "Poor") -> Column:
    """KS quality band: first upper bound the statistic is strictly below."""
    c = F.col(stat) if isinstance(stat, str) else stat
    bands = bands or config.KS_BANDS
    expr = None
    for bound, name in bands:
        expr = F.when(c < F.lit(bound), F.lit(name)) if expr is None else expr.when(c < F.lit(bound), F.lit(name))
    return expr.otherwise(F.lit(otherwise))


def ks_p_value(stat: str | Column, n: str | Column, m: str | Column, terms: int = 100) -> Column:
    """Asymptotic two-sided KS p-value (Kolmogorov series with Stephens' correction).

    lambda = (sqrt(e) + 0.12 + 0.11/sqrt(e)) * D with e = n*m/(n+m);
    Q(lambda) = 2 * sum_{k>=1} (-1)^(k-1) exp(-2 k^2 lambda^2), clamped to [0, 1].
    The exact distribution of small sides is ``dist.exact_ks_tail``.
    """
    d = F.col(stat) if isinstance(stat, str) else stat
    nn = (F.col(n) if isinstance(n, str) else n).cast("double")
    mm = (F.col(m) if isinstance(m, str) else m).cast("double")
    en = F.sqrt(nn * mm / (nn + mm))
    lam = (en + F.lit(0.12) + F.lit(0.11) / en) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.exp(F.lit(-2.0) * k * k * lam * lam),
    )
    q = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(2.0) * series))
    return F.when((nn <= 0) | (mm <= 0) | d.isNull(), F.lit(None).cast("double")).when(lam < 0.2, F.lit(1.0)).otherwise(q)
