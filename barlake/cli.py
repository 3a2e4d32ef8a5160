"""python -m barlake.cli --data-csv FILE [--chunk-strategy monthly|hourly|daily] [--query SQL ...] [--keep-repeated] [--json FILE] [--benchmark]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from barlake.plans import pipeline
from barlake.plans.engine import FullScanEngine


def main(argv: list[str] | None = None) -> dict:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--data-csv", required=True)
    p.add_argument("--chunk-strategy", choices=sorted(pipeline.STRATEGIES), default="monthly")
    p.add_argument("--query", action="append", default=[])
    p.add_argument("--keep-repeated", action="store_true", help="load all rows of a key that comes more than once, with a warning")
    p.add_argument("--json", help="write the figures here")
    p.add_argument("--benchmark", action="store_true", help="also time the unpruned engine, after holding results equal")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("barlake").getOrCreate()
    done = pipeline.run_pipeline(spark, a.data_csv, a.chunk_strategy, tuple(a.query), a.keep_repeated)
    pipeline.print_store(done["store"])
    figures: dict = {"summary": done["summary"], "queries": {}}
    for sql, result in done["query_results"].items():
        pipeline.print_result(sql, result)
        figures["queries"][sql] = {"rows": result.row_count, "seconds": result.elapsed_seconds, "skipped": result.pushdown.chunks_skipped_ratio}
        if a.benchmark:
            full = FullScanEngine(done["store"]).execute(sql)
            if result.data.exceptAll(full.data).count() or full.data.exceptAll(result.data).count():
                raise AssertionError(f"engines disagree: {sql}")
            figures["queries"][sql]["full_rows"], figures["queries"][sql]["full_seconds"] = full.row_count, full.elapsed_seconds
    if a.json:
        pipeline.write_json(a.json, figures)
    return figures


if __name__ == "__main__":
    main()
