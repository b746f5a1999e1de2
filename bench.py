"""Times the headline queries and prints one JSON line.

`BENCH_SF_DIR` names the tables (default sf0.1), `BENCH_CPUS` the local cores (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from themeloom.catalog import QUERIES, inputs  # noqa: E402
from themeloom.inference.embed import hashing_tfidf  # noqa: E402
from themeloom.operators import clusters, silhouette as sil  # noqa: E402
from themeloom.plans import search  # noqa: E402
from themeloom.runtime import build_session, cut  # noqa: E402

HEADLINES = (
    "e1_load_records", "b1_normalize_text", "g1_suggest_text_columns", "e2_column_profile", "k1_embed_texts",
    "f1_cumulative_coverage", "l1_faq_coverage", "d6_keepers_and_losers", "g6_hash_sample", "f2_representatives",
    "d7_knn_join", "j7_knn_graph", "j2_pca", "j10_trial_table", "j4_kmeans_sweep", "j6_density_sweep",
    "j9_community_sweep", "a11_cluster_list", "k4_annotate_clusters",
)


def timed(run) -> float:
    started = time.perf_counter()
    result = run()
    if result is not None:
        result.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["e6_cluster_sizes"](spark, sf_dir).collect()  # JVM warm-up
    times = {name: timed(lambda name=name: QUERIES[name](spark, sf_dir)) for name in HEADLINES}

    # The published figures: load, search (warm vectors), score one candidate, representatives.
    recs = cut(inputs.records(spark, sf_dir))
    vectors = cut(hashing_tfidf(recs))
    found = {}

    def run_search():
        found["best"] = search.find_best_clustering(vectors)

    times["full_search_documents"] = timed(run_search)
    best = found["best"]
    unit = cut(clusters.unit_vectors(vectors))
    labels = cut(best.labels)
    times["score_one_candidate"] = timed(lambda: sil.silhouettes(unit, labels.selectExpr("0 AS trial_ord", "row_id", "cluster_id")))
    times["summarize_clusters"] = timed(lambda: clusters.summarize_clusters(recs, vectors, labels))
    print(
        json.dumps(
            {
                "metric": "total seconds over headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": Path(sf_dir).name, "cpus": int(cpus), "n_vectors": best.n_rows,
            }
        )
    )


if __name__ == "__main__":
    main()
