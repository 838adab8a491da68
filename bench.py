"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

HEADLINE = (
    "agg_01_functional_connectivity", "agg_05_region_statistics", "agg_15_mutual_information_matrix", "agg_32_quality_report",
    "joi_06_epochs", "joi_11_apply_weights", "win_05_run_lengths", "win_09_connectivity_dynamics", "win_14_rank_transform",
    "spc_02_spectrogram", "spc_05_analytic_signal", "spc_12_morlet", "spc_18_band_csd", "nlt_07_sample_entropy",
    "nlt_11_all_entropies", "nlt_12_natural_visibility", "nlt_22_log_signature_changes", "nlt_23_dynamic_modes", "nlt_24_sparse_dynamics",
    "gra_03_clustering", "gra_05_path_length", "mat_01_principal_components", "mat_06_linear_model", "mat_18_hmm_fit", "mat_29_vfa_fit",
    "mat_31_bounded_fit", "str_01_hopping_band_power",
)


def main() -> None:
    from ondula.plans import load
    from ondula.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    all_queries = load()
    small = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    for name in ("set_06_value_counts", "agg_12_sample_covariance"):  # start the session and the Python workers
        if name in all_queries:
            all_queries[name].run(spark, small if os.path.isdir(small) else sf).collect()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        all_queries[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
