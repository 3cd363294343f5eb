"""The training-data queries pN_ and, where SQL can express them, the SQL they are compared with."""
from __future__ import annotations

from . import clusters, knn, lookalike, mixing, oracles, percentiles, quotas, runs, subset, tokens


def queries() -> dict:
    return {
        "p1_found": subset.p1_found,
        "p1_subset": subset.p1_subset,
        "p2_found": knn.p2_found,
        "p2_knn": knn.p2_knn,
        "p3_found": clusters.p3_found,
        "p3_clusters": clusters.p3_clusters,
        "p4_percentiles": percentiles.p4_percentiles,
        "p4_merged_days": percentiles.p4_merged_days,
        "p5_found": quotas.p5_found,
        "p5_sample": quotas.p5_sample,
        "p5_report": quotas.p5_report,
        "p5_files": quotas.p5_files,
        "p6_found": runs.p6_found,
        "p6_runs": runs.p6_runs,
        "p6_segments": runs.p6_segments,
        "p7_ids": tokens.p7_ids,
        "p7_round_trip": tokens.p7_round_trip,
        "p8_sample": mixing.p8_sample,
        "p8_report": mixing.p8_report,
        "p9_found": lookalike.p9_found,
        "p9_classes": lookalike.p9_classes,
        "p9_links": lookalike.p9_links,
        "p9_folded": lookalike.p9_folded,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
