"""Named cursors, apart by namespace."""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korvex.operators.maintain import merge
from korvex.plans.store import Corpus


class CursorStore:
    """Cursors of one namespace in a corpus's table."""

    def __init__(self, corpus: Corpus, namespace: str = ""):
        self.corpus, self.namespace = corpus, namespace

    def get(self, key: str) -> str | None:
        row = self.corpus.read("cursors").where((F.col("namespace") == self.namespace) & (F.col("key") == key)).first()
        return None if row is None or row.value is None else base64.b64decode(row.value).decode()

    def with_value(self, key: str, value: str | None) -> DataFrame:
        """The table with a cursor set, to be committed with other tables."""
        coded = None if value is None else base64.b64encode(value.encode()).decode()
        new = self.corpus.spark.createDataFrame([(self.namespace, key, coded)], self.corpus.read("cursors").schema)
        return merge(self.corpus.read("cursors"), new, ["namespace", "key"])

    def set(self, key: str, value: str | None) -> None:
        self.corpus.commit({"cursors": self.with_value(key, value)})
