"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quillspark.plans import workload  # noqa: E402
from quillspark.session import local_session  # noqa: E402

HEADLINE = [
    "word_ngrams", "char_ngrams", "tfidf_uni", "lm_loglik", "content_features", "vocab_index",
    "clean_term_freq", "trigram_continuations", "known_edits", "spell_candidates", "feature_table", "lm_generate",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) * 2 if cpus.isdigit() else 16)
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf}/documents.parquet").selectExpr("sum(length(text))").collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        workload.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
