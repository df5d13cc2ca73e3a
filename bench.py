"""Headline queries on $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "p5_fallback_with_provenance", "j2_left_enrichment_chain", "j12_exact_horizon", "a1_entity_summary", "a14_quantile_bins",
    "w4_mad_outlier_scrub", "w5_rolling_min_periods", "w10_cross_deviation", "w19_chain_linked_index", "e3_cluster_robust",
    "e11_band_table", "e14_threshold_ar", "m2_feature_block", "b7_signal_grid", "b15_true_holdout", "r6_derived_daily",
    "q3_expectations", "t3_intraday_profile",
]
#: Timed beside the headline: two-way effects, components, simulation, fits, sources and late corrections.
HEAVY = ["e1_absorb_two_way", "e25_panel_pca", "b19_block_bootstrap_quantiles", "m8_regressors", "s1_read_snapshots", "t6_late_corrections"]
#: Read once more when everything is compiled.
WARM = ["a14_quantile_bins", "r6_derived_daily", "b7_signal_grid", "e3_cluster_robust"]


def main() -> None:
    from gridloom.queries import load
    from gridloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = local_session(cores=cpus, partitions=max(8, int(cpus)), app="bench")
    qs = load()[0]
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().write.format("noop").mode("overwrite").save()
    failed = {}

    def timed(names) -> dict[str, float]:
        """Seconds of each query; a failing one is named with its error and costs nothing else."""
        out = {}
        for name in names:
            t0 = time.time()
            try:
                qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                out[name] = round(time.time() - t0, 3)
            except Exception as e:  # noqa: BLE001 - reported in the line
                failed[name] = str(e).strip().split("\n")[0][:200]
        return out

    times, rest = timed(only), {}
    if not os.environ.get("BENCH_QUERIES"):
        for key, names in (("heavy", HEAVY), ("warm", WARM)):
            rest[key] = timed(n for n in names if n in qs)
    if failed:
        rest["failed"] = failed
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf)} | rest))
    spark.stop()


if __name__ == "__main__":
    main()
