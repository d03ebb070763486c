"""A catalog of indexes and one search over those that are enabled."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from korvex.client import IndexClient
from korvex.functions.text import fold_text
from korvex.operators import retrieval as R
from korvex.plans.util import written


@dataclass
class IndexEntry:
    id: str
    name: str
    is_search_enabled: bool
    store: str


class Workspace:
    """Indexes by name (unique but for case and diacritics), kept in a JSON file that is replaced atomically."""

    def __init__(self, spark: SparkSession, root: str, opener: Callable[[SparkSession, str], IndexClient] = IndexClient):
        self.spark, self.root, self.opener = spark, root, opener
        self.file = os.path.join(root, "catalog.json")
        self.entries: list[IndexEntry] = []
        self.sessions: dict[str, IndexClient] = {}
        if os.path.exists(self.file):
            with open(self.file) as f:
                self.entries = [IndexEntry(**e) for e in json.load(f)]

    def _save(self) -> None:
        os.makedirs(self.root, exist_ok=True)
        draft = f"{self.file}.{uuid.uuid4().hex}"
        with open(draft, "w") as f:
            json.dump([asdict(e) for e in self.entries], f, indent=2, sort_keys=True)
        os.replace(draft, self.file)

    def _checked(self, name: str, but: str | None = None) -> str:
        name = name.strip()
        if not name:
            raise ValueError("an index needs a name")
        if any(fold_text(e.name) == fold_text(name) for e in self.entries if e.id != but):
            raise ValueError(f"there is an index named {name}")
        return name

    def entry(self, index_id: str) -> IndexEntry:
        return next(e for e in self.entries if e.id == index_id)

    def create(self, name: str) -> IndexEntry:
        name, own = self._checked(name), uuid.uuid4().hex
        self.entries.append(IndexEntry(own, name, True, os.path.join(self.root, "indexes", own)))
        self._save()
        return self.entries[-1]

    def rename(self, index_id: str, name: str) -> None:
        self.entry(index_id).name = self._checked(name, index_id)
        self._save()

    def enable(self, index_id: str, enabled: bool) -> None:
        self.entry(index_id).is_search_enabled = enabled
        self._save()

    def delete(self, index_id: str) -> None:
        self.session(index_id).corpus.drop()
        self.entries = [e for e in self.entries if e.id != index_id]
        self.sessions.pop(index_id, None)
        self._save()

    def session(self, index_id: str) -> IndexClient:
        if index_id not in self.sessions:
            self.sessions[index_id] = self.opener(self.spark, self.entry(index_id).store)
        return self.sessions[index_id]

    def rebuild(self, index_id: str) -> dict[str, int]:
        return self.session(index_id).rebuild_embeddings()

    def search(self, query: str | DataFrame, request: R.SearchRequest = R.SearchRequest()) -> tuple[DataFrame | None, dict[str, str]]:
        """Hits of all enabled indexes in one order, and each index's status; one that fails stops no other."""
        hits: dict[str, DataFrame] = {}
        status: dict[str, Any] = {}
        spaces: dict[str, str | None] = {}
        for e in self.entries:
            if not e.is_search_enabled:
                continue
            try:
                client = self.session(e.id)
                found, diagnostics = client.search(query, request)
                hits[e.id] = written(found)  # runs here, so that what breaks in a task is this index's failure alone
                missing = diagnostics["missing_channels"]
                spaces[e.id], status[e.id] = client.space, f"degraded: {', '.join(missing)}" if missing else "ok"
            except Exception as x:  # noqa: BLE001 - any failure of one index is its status
                status[e.id] = f"failed: {str(x)[:500]}"
        names = {e.id: e.name for e in self.entries}
        return (R.federate(hits, names, spaces) if hits else None), status
