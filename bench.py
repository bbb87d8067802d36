"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one line of JSON."""

import json
import os
import sys
import time

from prismview.plans import queries
from prismview.session import session

HEADLINE = ("dist_distribution", "quantile_dist", "norm_robust", "knn_purity_tiesafe", "margins", "intra_inter", "corr_pearson", "corr_spearman", "knn_overlap", "agreement", "pooled_metrics", "assign_prototypes", "swap_scan", "weight_step_global", "wide_pivot", "crosstab_dominance", "weights_wide")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(f"local[{os.environ.get('BENCH_CPUS', '8')}]", int(os.environ.get("BENCH_CPUS", "8")), os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    known = queries.queries()
    spark.range(1000).selectExpr("sum(id)").collect()  # the session's own start doesn't count
    took = {}
    for name in sys.argv[1:] or HEADLINE:
        began = time.time()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
