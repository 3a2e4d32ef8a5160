"""From a file to answers: load, cut into chunks, query."""

from __future__ import annotations

import json
import os
from datetime import timedelta

from pyspark.sql import SparkSession

from barlake.operators.store import BarStore
from barlake.plans.engine import Engine
from barlake.sources.bars_csv import load_bars, load_summary

STRATEGIES = {"monthly": "monthly", "hourly": timedelta(hours=1), "daily": timedelta(days=1)}


def run_pipeline(spark: SparkSession, path: str, boundary="monthly", queries: tuple[str, ...] = (), keep_repeated: bool = False) -> dict:
    """{summary, store, query_results}."""
    bars = load_bars(spark, path, keep_repeated)
    store = BarStore(bars, None, STRATEGIES.get(boundary, boundary) if isinstance(boundary, str) else boundary, base_unique=None if keep_repeated else True)
    engine = Engine(store)
    return {"summary": load_summary(bars).first().asDict(), "store": store, "query_results": {q: engine.execute(q) for q in queries}}


def write_json(path: str, payload: object) -> None:
    """Written beside and renamed, so readers never see half a file."""
    tmp = f"{path}.tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(payload, f, indent=2, default=str)
    os.replace(tmp, path)


def print_store(store: BarStore) -> None:
    for name, value in store.stats().first().asDict().items():
        print(f"{name}: {value}")


def print_result(sql: str, result) -> None:
    p = result.pushdown
    print(f"{sql}\n  rows {result.row_count}, selectivity {result.selectivity:.4f}, {result.elapsed_seconds:.3f} s", end="")
    print(f", chunks {p.candidate_count} of {p.total_chunks}, skipped {p.chunks_skipped_ratio:.1%}" if p else "")
