"""Checks between tables: equal contents without a join, torn snapshots, currency, winners, matched samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.operators.joins import with_scalars


def fingerprint(cols: Sequence[str]) -> list[Column]:
    """Aggregates that tell multisets of rows apart whatever their order: count, two sums and an xor of hashes.

    Sums are taken as decimals, so neither order nor overflow changes them, and combine before a
    shuffle.  NULLs count; a column's value in another column changes the hash.
    """
    tagged = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in cols]
    one, two = F.xxhash64(*tagged), F.xxhash64(F.lit("second"), *reversed(tagged))
    return [F.count("*").alias("rows"), F.sum(one.cast("decimal(38,0)")).alias("sum1"), F.sum(two.cast("decimal(38,0)")).alias("sum2"), F.bit_xor(one).alias("xor1")]


PRINT = ["rows", "sum1", "sum2", "xor1"]


def same_rows(a: DataFrame, b: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per group: rows on either side and whether both hold the same multiset of rows.

    Only one row per group and side meets the other; without ``by`` there is one group.
    """
    by = list(by)
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(by)] or [F.lit(0).alias("_k0")]
    side = lambda df, s: df.groupBy(*keys).agg(*fingerprint(cols)).select("*", F.lit(s).alias("_side"))
    both = side(a, 0).unionByName(side(b, 1))
    names = [f"_k{i}" for i in range(max(1, len(by)))]
    of = lambda c, s: F.max(F.when(F.col("_side") == s, F.col(c)))
    g = both.groupBy(*names).agg(F.coalesce(of("rows", 0), F.lit(0)).alias("rows_left"), F.coalesce(of("rows", 1), F.lit(0)).alias("rows_right"),
                                 (F.count("*") == 2).alias("_two"), *[(of(c, 0).eqNullSafe(of(c, 1))).alias(f"_same_{c}") for c in PRINT])
    equal = F.col("_two")
    for c in PRINT:
        equal = equal & F.col(f"_same_{c}")
    return g.select(*[F.col(n).alias(k) for n, k in zip(names, by)], "rows_left", "rows_right", equal.alias("equal"))


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``same_rows`` of the distinct keys of both tables."""
    cols = list(dict.fromkeys([*by, *keys]))
    return same_rows(a.select(*cols).distinct(), b.select(*cols).distinct(), keys, by)


def stale_majority(stamps: DataFrame, source: str, stamp: str, now: Column, max_age_days: int) -> DataFrame:
    """One row: sources, how many are older than the limit at ``now``, the middle age, passed unless a majority is stale.

    Ages are counted per source on its newest stamp, so one fresh source hides nobody.
    """
    g = stamps.groupBy(source).agg(F.max(stamp).alias("_latest")).withColumn("_age", F.datediff(now, "_latest"))
    a = g.agg(F.count("*").alias("sources"), F.sum((F.col("_age") > max_age_days).cast("long")).alias("stale"), F.percentile("_age", F.lit(0.5)).alias("median_age"))
    return a.withColumn("passed", F.col("stale") * 2 <= F.col("sources"))


def torn_snapshots(parts: DataFrame, snapshot: str, stamp: str, derived: DataFrame, built: str) -> DataFrame:
    """Per snapshot: its parts' first and last stamp, when the table derived from it was built, torn if before the last part."""
    g = parts.groupBy(snapshot).agg(F.count("*").alias("parts"), F.min(stamp).alias("first_part"), F.max(stamp).alias("last_part"))
    d = derived.groupBy(snapshot).agg(F.min(built).alias("built"))
    return g.join(d, snapshot, "left").withColumn("torn", F.coalesce(F.col("built") < F.col("last_part"), F.lit(True)))


def end_against_source(panel: DataFrame, date: str, source: DataFrame, stamp: str, slack: int = 1) -> DataFrame:
    """One row: last day of the panel, last day of its source, days behind, passed within ``slack``."""
    a = with_scalars(panel.agg(F.max(date).alias("panel_end")), source.agg(F.max(stamp).alias("e")))
    behind = F.datediff("s.e", "panel_end")
    return a.select("panel_end", F.col("s.e").alias("source_end"), behind.cast("long").alias("days_behind"), F.coalesce(behind <= slack, F.lit(False)).alias("passed"))


def _check(df: DataFrame, name: str, bad: Column) -> DataFrame:
    v = F.coalesce(F.sum(F.coalesce(bad, F.lit(True)).cast("long")), F.lit(0).cast("long"))
    return df.agg(v.alias("violations")).select(F.lit(name).alias("check"), "violations", (F.col("violations") == 0).alias("passed"))


def matched_n(preds: DataFrame, model: str, by: Sequence[str], y: str, yhat: str, name: str = "matched n") -> DataFrame:
    """Groups whose models are not scored on the same number of rows; a model without any row in a group counts as zero."""
    models = with_scalars(preds.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).groupBy(*by, model).agg(F.count("*").alias("_n")), preds.agg(F.countDistinct(model).alias("m")))
    g = models.groupBy(*by).agg((F.min("_n") != F.max("_n")).alias("_a"), (F.count("*") != F.max("s.m")).alias("_b"))
    return _check(g, name, F.col("_a") | F.col("_b"))


def finite_values(df: DataFrame, cols: Sequence[str], name: str = "finite") -> DataFrame:
    """Rows with a NULL, NaN or infinite value in one of ``cols``."""
    bad = F.lit(False)
    for c in cols:
        x = F.col(c).cast("double")
        bad = bad | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return _check(df, name, bad)


def ordered_bounds(df: DataFrame, cols: Sequence[str], name: str = "interval order") -> DataFrame:
    """Rows whose ``cols`` do not ascend."""
    bad = F.lit(False)
    for a, b in zip(cols[:-1], cols[1:]):
        bad = bad | F.coalesce(F.col(a) > F.col(b), F.lit(True))
    return _check(df, name, bad)


def exact_ratio(df: DataFrame, a: str, b: str, ratio: float, tol: float = 1e-9, name: str = "exact ratio") -> DataFrame:
    """Rows where ``a`` is not ``ratio`` times ``b``: a unit converted twice or not at all; NULL pairs are left out."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    due = F.col(b) * ratio
    return _check(d, name, ~(F.abs(F.col(a) - due) <= tol * F.greatest(F.abs(due), F.lit(1.0))))


def winners(published: DataFrame, preds: DataFrame, by: Sequence[str], model: str, y: str, yhat: str, digits: int = 9) -> DataFrame:
    """Per group: the published winner, the one recomputed from the predictions (ties by name), whether they agree."""
    by = list(by)
    rm = preds.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).groupBy(*by, model).agg(F.sqrt(F.avg((F.col(y) - F.col(yhat)) ** 2)).alias("_e"))
    best = rm.groupBy(*by).agg(F.min_by(model, F.struct(F.round("_e", digits), F.col(model))).alias("recomputed"))
    j = published.select(*by, F.col(model).alias("published")).join(best, by, "full")
    return j.withColumn("agrees", F.coalesce(F.col("published") == F.col("recomputed"), F.lit(False)))
