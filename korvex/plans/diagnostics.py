"""Latency per layer, and a bundle of files that describes an index."""

from __future__ import annotations

import json
import math
import os
import time
from typing import Any

from korvex.operators import retrieval as R


def percentile(values: list[float], p: float) -> float | None:
    """Nearest rank; None of nothing."""
    return sorted(values)[max(0, math.ceil(p * len(values)) - 1)] if values else None


def benchmark(client, queries: list[str], iterations: int = 5) -> dict[str, dict[str, float | None]]:
    """p50 and p95 of searches in diagnostic mode, limit 10: in all, of each channel, and of fusion with what follows it; all layers of the same runs."""
    took: dict[str, list[float]] = {"Total": [], "FTS": [], "Vector": [], "SQL": [], "Fusion": []}
    for _ in range(iterations):
        for q in queries:
            began = time.perf_counter()
            hits, _ = client.search(q, R.SearchRequest(10, profile=R.PROFILES["diagnostic"]))
            found = time.perf_counter()
            hits.collect()
            took["Total"].append(time.perf_counter() - began)
            took["Fusion"].append(time.perf_counter() - found)
            for layer, channel in (("FTS", "fts"), ("Vector", "vector"), ("SQL", "exact")):
                took[layer] += [client.timings[channel]] if channel in client.timings else []
    return {layer: {"p50": percentile(own, 0.5), "p95": percentile(own, 0.95)} for layer, own in took.items()}


_PRIVATE = ("id", "document_id", "source_uri", "message")


def bundle(client, folder: str, sensitive: bool = False, last_search: Any = None) -> list[str]:
    """Writes JSON files with sorted keys; ids, messages and paths are left out unless sensitive."""
    if os.path.exists(folder) and not os.path.isdir(folder):
        raise NotADirectoryError(folder)
    os.makedirs(folder, exist_ok=True)

    def rows(df) -> list[dict]:
        out = [r.asDict() for r in df.collect()]
        return out if sensitive else [{k: "<redacted>" if k in _PRIVATE and v is not None else v for k, v in r.items()} for r in out]

    parts = {"health": client.health(), "snapshot": client.snapshot(), "model": client.model_status(), "pipeline": client.retrieval_pipeline(), "jobs": rows(client.jobs()), "failures": rows(client.failures())}
    if sensitive and last_search is not None:
        parts["last-search"] = last_search
    names = [f"{k}.json" for k in (*parts, "last-search")]
    for n in names:
        if os.path.isfile(os.path.join(folder, n)):
            os.remove(os.path.join(folder, n))
    for k, v in parts.items():
        with open(os.path.join(folder, f"{k}.json"), "w") as f:
            json.dump(v, f, indent=2, sort_keys=True, default=str)
    return sorted(f"{k}.json" for k in parts)
