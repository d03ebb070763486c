"""Content extractors: from a binary or paged body to text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korvex.functions.text import trim

#: An extractor turns a column into struct<text string, error string>.
Extractor = Callable[[Column], Column]


def paged_text(pages: Column, locked: Column | None = None) -> Column:
    """Pages (array<string>) trimmed, empty ones dropped, joined by a blank line, with their number before; null is unreadable, none left or a locked document an error."""
    kept = F.filter(F.transform(pages, trim), lambda p: p.isNotNull() & (p != ""))
    text = F.array_join(kept, "\n\n")
    bad = F.when(F.lit(False) if locked is None else F.coalesce(locked, F.lit(False)), "locked").when(pages.isNull(), "unreadable").when(F.size(kept) == 0, "noExtractableText")
    return F.struct(F.when(bad.isNull(), text).alias("text"), bad.alias("error"), F.size(pages).alias("page_count"))


def utf8_text(content: Column) -> Column:
    valid = F.is_valid_utf8(content.cast("string"))
    return F.struct(F.when(valid, content.cast("string")).alias("text"), F.when(~F.coalesce(valid, F.lit(False)), "unreadable").alias("error"))


class Registry:
    """Extractors by content type; the first one that was registered for a type is used."""

    def __init__(self) -> None:
        self.known: list[tuple[frozenset[str], Extractor]] = []

    def register(self, content_types: set[str], extractor: Extractor) -> None:
        self.known.append((frozenset(content_types), extractor))

    def apply(self, payloads: DataFrame, content: str = "content", content_type: str = "content_type") -> DataFrame:
        """payloads with body and error; types without an extractor are an error."""
        out = F.lit(None).cast("struct<text string, error string>")
        for types, extractor in reversed(self.known):
            own = extractor(F.col(content))
            out = F.when(F.col(content_type).isin(sorted(types)), F.struct(own["text"].alias("text"), own["error"].alias("error"))).otherwise(out)
        df = payloads.withColumn("_x", out)
        return df.withColumn("body", F.col("_x.text")).withColumn("error", F.when(F.col("_x").isNull(), "unsupported").otherwise(F.col("_x.error"))).drop("_x")
