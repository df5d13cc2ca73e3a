"""Panel -> deviation -> gap bins -> mean next-period closure."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridloom.functions.num import rnd


def gap_closure(t) -> DataFrame:
    from gridloom.operators.econometrics import band_table

    return band_table(t.devm, "dev", calendar_exact=False).select(
        "bin", "n", rnd("closure_pp").alias("closure_pp"), rnd("se").alias("se"))
