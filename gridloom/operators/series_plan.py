"""Feature blocks over a series: many lags, rolling moments and event distances from one ordering.

Features are declared first.  The plan then collects what they need and emits two window selects with
the same partitioning and ordering, which Spark serves with a single sort:

1. running sums of the powers of each column (and of its presence), each a frame that only grows;
2. lags of those sums and of the columns.  A rolling moment over n rows is the difference of two
   lags, so its cost does not depend on n, and the move by ``shift`` rows that keeps the described
   day out of its own features is part of the offset.

Exponential means come from running sums inside blocks of rows plus what earlier blocks carry over,
all half-lives in one pass.  Group statistics of a date are aggregated and met by the date of the row
they describe, so nothing is ordered again after them.

Input is at (entity, date) grain; a partition is one entity's series, bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.functions.num import col, div


class SeriesPlan:
    """Declared features of a series; ``run`` computes them."""

    def __init__(self, entity: str = "entity", date: str = "date", shift: int = 1):
        self.entity, self.date, self.shift = entity, date, shift
        self.sums: dict[str, Column] = {}
        self.lags: dict[str, tuple[str, int]] = {}
        self.features: dict[str, Column] = {}
        self.fades: dict[str, tuple[str, float]] = {}

    # --- pieces of features -----------------------------------------------------------------
    def past(self, c: str, k: int = 0) -> Column:
        """Value of ``c``, ``k`` rows before the described row."""
        return self._lag(c, k + self.shift)

    def _lag(self, c: str, k: int) -> Column:
        name = f"_l{k}_{c}"
        self.lags[name] = (c, k)
        return F.col(name)

    def total(self, c: str, n: int | None, power: int = 1) -> Column:
        """Sum of ``c ** power`` (0: number of values) over the ``n`` rows that end with the described one, or all."""
        name = f"_s{power}_{c}"
        x = F.col(c).cast("double")
        self.sums[name] = x.isNotNull().cast("double") if power == 0 else (x * x if power == 2 else x * x * x) if power > 1 else x
        zero = F.lit(0.0)
        upto = F.coalesce(self._lag(name, self.shift), zero)
        return upto if n is None else upto - F.coalesce(self._lag(name, n + self.shift), zero)

    def rolling(self, c: str, n: int, how: str, min_obs: int | None = None) -> Column:
        """Mean, sd, sum or skew (adjusted for its size) over ``n`` rows; ``min_obs`` defaults to max(2, n // 2)."""
        cnt = self.total(c, n, 0)
        enough = cnt >= (max(2, n // 2) if min_obs is None else min_obs)
        s1 = self.total(c, n, 1)
        if how == "sum":
            return F.when(enough, s1)
        mean = div(s1, cnt)
        if how == "mean":
            return F.when(enough, mean)
        m2 = F.greatest(self.total(c, n, 2) - mean * s1, F.lit(0.0))
        if how == "sd":
            return F.when(enough & (cnt > 1), F.sqrt(div(m2, cnt - 1)))
        if how != "skew":
            raise ValueError(how)
        m3 = self.total(c, n, 3) - 3 * mean * self.total(c, n, 2) + 2 * cnt * mean**3
        adjust = F.sqrt(cnt * (cnt - 1)) / (cnt - 2)
        return F.when(enough & (cnt > 2) & (m2 > 1e-14), adjust * (m3 / cnt) / F.pow(m2 / cnt, F.lit(1.5)))

    def growth(self, c: str, n: int) -> Column:
        """Change over ``n`` rows of a column that is already in logs."""
        return self.past(c) - self.past(c, n)

    def since(self, flag: Column, name: str) -> Column:
        """Days from the last flagged row to the described one, NULL before the first."""
        self.sums[f"_m_{name}"] = F.when(flag, F.col(self.date))
        return F.datediff(self.past(self.date), self._lag(f"_m_{name}", self.shift))

    def faded(self, c: str, half_life: float, name: str, min_obs: int = 3) -> None:
        """Bias-adjusted exponential mean ``name`` and sd ``name_sd`` of ``c`` over the whole past; needs a shift of 0 or 1."""
        self.fades[name] = (c, half_life)
        self.features[f"_obs_{name}"] = self.total(c, None, 0) >= min_obs

    def add(self, name: str, expr: Column) -> Column:
        self.features[name] = expr
        return F.col(name)

    # --- the plan ---------------------------------------------------------------------------
    def select(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """The block without exponential means: one sort of the series."""
        w = Window.partitionBy(self.entity).orderBy(self.date)
        grow = w.rowsBetween(Window.unboundedPreceding, 0)
        run = {n: F.max(e) if n.startswith("_m_") else F.sum(e) for n, e in self.sums.items()}
        d = df.select(*df.columns, *[e.over(grow).alias(n) for n, e in run.items()], (F.row_number().over(w) - 1).alias("_i"))
        d = d.select(*d.columns, *[F.lag(c, k).over(w).alias(n) for n, (c, k) in self.lags.items()])
        raw = sorted({c for c, _ in self.fades.values()})
        return d.select(*keep, *(["_i", *[F.col(c).alias(f"_x_{c}") for c in raw]] if raw else []), *[e.alias(n) for n, e in self.features.items()])

    def exponentials(self, d: DataFrame) -> DataFrame:
        """Adds the exponential means to the written result of ``select``."""
        if not self.fades:
            return d
        size = max(1, int(round(8 * min(h for _, h in self.fades.values()))))
        out = [c for c in d.columns if not c.startswith("_obs_") and not c.startswith("_x_") and c != "_i"]
        d = d.withColumn("_k", F.floor(F.col("_i") / size)).withColumn("_o", F.col("_i") % size)
        parts, fade = {}, {}
        for name, (c, h) in self.fades.items():
            lam = 0.5 ** (1.0 / h)
            x = F.col(f"_x_{c}").cast("double")
            up = F.pow(F.lit(1 / lam), F.col("_o"))
            there, v = x.isNotNull().cast("double"), F.coalesce(x, F.lit(0.0))
            for p, e, f in (("w", there * up, lam), ("q", there * up * up, lam * lam), ("x", v * up, lam), ("s", v * v * up, lam)):
                parts[f"{p}_{name}"], fade[f"{p}_{name}"] = e, f
        blocks = d.groupBy(self.entity, "_k").agg(*[(F.sum(e) * fade[p] ** size).alias(p) for p, e in parts.items()])
        blocks = blocks.groupBy(self.entity).agg(F.sort_array(F.collect_list(F.struct("_k", *parts))).alias("_b"))
        step = ", ".join(f"'{p}', a.{p} * {fade[p] ** size!r}D + b.{p}" for p in parts)
        zero = ", ".join(f"'{p}', 0D" for p in parts)
        carry = F.expr(f"aggregate(_b, array(named_struct({zero})), (s, b) -> array_append(s, transform(array(element_at(s, -1)), a -> named_struct({step}))[0]))")
        d = d.join(blocks.select(F.col(self.entity).alias("_e"), carry.alias("_c")), F.col(self.entity).eqNullSafe(F.col("_e")), "left")
        inside = Window.partitionBy(self.entity, "_k").orderBy("_i").rowsBetween(Window.unboundedPreceding, -self.shift)
        at = F.get(F.col("_c"), F.col("_k").cast("int"))
        d = d.select(*d.columns, *[F.coalesce(F.sum(e).over(inside), F.lit(0.0)).alias(f"_in_{p}") for p, e in parts.items()])
        age = F.col("_o") - F.lit(self.shift)
        v = {p: F.pow(F.lit(fade[p]), age) * (F.col(f"_in_{p}") + at[p]) for p in parts}
        for name in self.fades:
            w, q, x, s = (v[f"{p}_{name}"] for p in "wqxs")
            mean = div(x, w)
            var = (div(s, w) - mean * mean) * div(w * w, w * w - q)
            ok = F.col(f"_obs_{name}")
            d = d.withColumn(name, F.when(ok, mean)).withColumn(f"{name}_sd", F.when(ok, F.sqrt(F.greatest(var, F.lit(0.0)))))
            out += [name, f"{name}_sd"]
        return d.select(*out)


def one_hot(c: str, values: Sequence[str], prefix: str) -> dict[str, Column]:
    return {f"{prefix}_{v.split()[0].lower()}": F.coalesce((col(c) == v).cast("double"), F.lit(0.0)) for v in values}
