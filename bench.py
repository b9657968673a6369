"""Headline queries on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR``; prints one JSON line.

``stored_model`` is the offline part: typed titles to stored components, without payload parsing and K-means. The searches that
follow read what it wrote, as the service they stand for would. Each query is materialised in full; the best of two runs is reported.
"""

from __future__ import annotations

import json
import os
import time

from marquee.plans import views
from marquee.plans.queries import QUERIES
from marquee.session import local_session

HEADLINE = [
    "rating_fusion", "scalar_norm", "top_titles", "payload_parse", "vocab_words", "feature_combos", "loc_vector_128",
    "hash_encode", "components", "grouped_kmeans", "weighted_search", "search_filtered", "batch_search", "recommend",
    "recommend_by_title", "weight_sweep", "locale_preferences",
]


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session("marquee-bench", cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)

    def materialise(name: str) -> None:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    seconds = {"stored_model": timed(lambda: views.stored_model(spark, sf_dir))}
    for name in HEADLINE:
        seconds[name] = min(timed(lambda: materialise(name)) for _ in range(2))
    asked = views.table(spark, sf_dir, "conversations").count()
    films, _ = views.stored_model(spark, sf_dir)
    report = {
        "metric": "headline queries, total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": {name: round(value, 3) for name, value in seconds.items()},
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": cpus,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "spark": spark.version,
        "catalogue_titles": films.count(),
        "batch_search_requests": asked,
        "batch_search_ms_per_request": round(1000 * seconds["batch_search"] / max(asked, 1), 3),
    }
    spark.stop()
    print(json.dumps(report))


if __name__ == "__main__":
    main()
