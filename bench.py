"""Time the registered queries, model scoring and the feature stream; prints one JSON line.

BENCH_SF_DIR is the data folder (default /root/testdata/sf0.1), BENCH_CPUS the cores (default 8).
`bench.py name ...` runs the named queries only.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from txrisk.operators import features, scoring, training  # noqa: E402
from txrisk.options import TrainingOptions  # noqa: E402
from txrisk.plans import catalog  # noqa: E402
from txrisk.session import local_session  # noqa: E402
from txrisk.sources import adapters, tables  # noqa: E402
from txrisk.streaming import queries as live  # noqa: E402


#: Queries that write tables or run a stream from its start; they are run once.
ONCE = {"routed_transactions", "routed_dead_letters", "stream_features", "queued_slices", "run_record"}


def timed(df) -> float:
    start = time.perf_counter()
    df().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, cpus)
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    seconds = {}
    timed(lambda: spark.range(1000))
    for name, query in catalog.QUERIES.items():
        if only and name not in only:
            continue
        if name not in ONCE:
            timed(lambda: query(spark, folder))
        seconds[name] = timed(lambda: query(spark, folder))
    rows = adapters.read_events(spark, folder).count()
    if not only:
        work = tempfile.mkdtemp(prefix="run-bench-", dir="/tmp")
        tx = adapters.transactions(adapters.read_events(spark, folder))
        features.feature_vector(tx).write.parquet(f"{work}/vectors")
        vectors = spark.read.parquet(f"{work}/vectors")
        opts = TrainingOptions(rounds=5, depth=4, leaves=12, chunk=5)
        start = time.perf_counter()
        training.train(vectors, f"{work}/runs", f"{work}/models", opts)
        seconds["train_5_rounds"] = round(time.perf_counter() - start, 3)
        model, version, serve = scoring.load_champion(spark, f"{work}/runs", opts.model_name)
        timed(lambda: scoring.score(vectors, model, version, serve=serve))
        seconds["score_rows"] = timed(lambda: scoring.score(vectors, model, version, serve=serve))
        live.use_rocksdb(spark)
        adapters.raw_messages(adapters.read_events(spark, folder)).repartitionByRange(1, "offset").write.parquet(f"{work}/messages")
        start = time.perf_counter()
        live.write_features(live.feature_stream(tables.message_stream(spark, f"{work}/messages")),
                            f"{work}/out", f"{work}/checkpoint").awaitTermination()
        seconds["feature_stream"] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total seconds of all queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "event_rows": rows,
        "rows_per_sec": {k: round(rows / v) for k, v in seconds.items()
                         if k in ("feature_vector", "parse_ok", "score_rows", "feature_stream")},
    }))


if __name__ == "__main__":
    main()
