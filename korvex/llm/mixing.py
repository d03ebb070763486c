"""Mixing sources to target weights by Pareto order sampling.

Every source gets a whole number of draws from its target weight. A document's
expected copies are draws * size / (the source's size); its whole part is
certain, and the fraction that remains is an inclusion probability p. Documents
are ranked by the odds of a uniform number over the odds of p, and the smallest
ones fill the draws that are left: a sample of fixed size with unequal
probabilities. All shares are integer fractions, so every engine and every
partitioning gives the same rows.

Nothing is sorted as a whole: keys are counted in buckets, and only the bucket
that holds a source's threshold is ranked.

Defined results: a null source is a source of its own; a null or empty text
has size 1; rows that repeat are drawn for separately only as far as their ids
differ (equal keys rank by id, then by all columns); no rows in give no rows;
ids may have any type; other columns may have any names and types, maps too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from korvex.plans.util import BROADCAST_LIMIT, all_columns, cut, fresh, row_hash, table

#: The uniform numbers have this many values, and their bits are a hash's first ones.
SPAN = 1 << 48
BUCKETS = 1 << 14


def uniform(id_col: Column, seed: int) -> Column:
    """An integer in [0, SPAN) from a hash of the id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("bigint")


def draws(counts: DataFrame, weights: dict[str, float] | None, total: int | None) -> DataFrame:
    """(source, n, size) to (source, size, draws): largest remainders; weights are scaled to millionths.

    Without weights, the target is the square root of a source's share, which
    flattens a dominating source and keeps small ones.
    """
    if weights is None:
        raw = F.floor(F.sqrt(F.col("n").cast("double") * 1e6)).cast("bigint")
    else:
        raw = F.lit(0).cast("bigint")
        for name, w in weights.items():
            raw = F.when(F.col("source") == name, F.lit(int(round(w * 1e6))).cast("bigint")).otherwise(raw)
    everything = Window.partitionBy()  # one row a source
    c = counts.withColumn("w", raw)
    c = c.withColumn("sum_w", F.sum("w").over(everything)).withColumn("total", F.lit(total).cast("bigint") if total is not None else F.sum("n").over(everything))
    product = F.col("total").cast("decimal(38,0)") * F.col("w")
    c = c.where("sum_w > 0").withColumn("whole", F.floor(product / F.col("sum_w")).cast("bigint"))
    c = c.withColumn("whole", F.expr("CAST((CAST(total AS DECIMAL(19,0)) * CAST(w AS DECIMAL(19,0)) - (CAST(total AS DECIMAL(19,0)) * CAST(w AS DECIMAL(19,0))) % CAST(sum_w AS DECIMAL(19,0))) / CAST(sum_w AS DECIMAL(19,0)) AS BIGINT)"))
    c = c.withColumn("rest", F.expr("CAST((CAST(total AS DECIMAL(19,0)) * CAST(w AS DECIMAL(19,0))) % CAST(sum_w AS DECIMAL(19,0)) AS BIGINT)"))
    order = Window.partitionBy().orderBy(F.desc("rest"), F.col("source").asc_nulls_first())
    left = F.col("total") - F.sum("whole").over(everything)
    return c.withColumn("draws", F.col("whole") + F.when(F.row_number().over(order) <= left, 1).otherwise(0)).select("source", "size", "draws")


def _by_source(docs: DataFrame, rows: DataFrame, source_col: str, name: str, how: str) -> DataFrame:
    """docs with its source's row; the rows, one a source, are broadcast if their measured number is small."""
    side = F.broadcast(rows) if rows.count() * 64 <= BROADCAST_LIMIT else rows
    return docs.join(side, F.col(source_col).eqNullSafe(F.col(name)), how)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", copies_col: str | None = None) -> DataFrame:
    """docs with a last column, copies, the times that each row is drawn (rows drawn at least once).

    weights: target share by source (None: square root of the share); total:
    draws in all (None: as many as rows); copies_col: the column's name (None:
    copies, with underscores before it where docs has that already).
    """
    copies_col = copies_col or fresh(docs, "copies")
    s2, end, take, rank = (fresh(docs, f"kx_{x}") for x in ("source2", "end", "take", "rank"))
    s, d, z, e, u, r, key, b = (fresh(docs, f"kx_{x}") for x in ("source", "draws", "size", "own", "u", "rest", "key", "bucket"))
    # A size is 1 + the root of the length: longer texts are likelier, not in proportion.
    own = F.floor(F.sqrt(F.coalesce(F.length(text_col), F.lit(0)).cast("double"))).cast("bigint") + 1
    sized = docs.withColumn(e, own)
    counts = sized.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum(e).alias("size"))
    targets = cut(draws(counts, weights, total)).select(F.col("source").alias(s), F.col("size").alias(z), F.col("draws").alias(d))
    x = _by_source(sized, targets, source_col, s, "inner").drop(s)
    x = x.withColumn(copies_col, F.expr(f"(`{d}` * `{e}`) div `{z}`")).withColumn(r, F.expr(f"(`{d}` * `{e}`) % `{z}`"))
    x = x.withColumn(u, uniform(F.col(id_col), seed))
    odds = (F.col(u).cast("double") / (F.lit(SPAN) - F.col(u)).cast("double")) / (F.col(r).cast("double") / (F.col(z) - F.col(r)).cast("double"))
    x = x.withColumn(key, F.when(F.col(r) > 0, odds))
    x = x.withColumn(b, F.floor(F.col(key) / (1 + F.col(key)) * BUCKETS).cast("int"))
    # Where each source's sample ends: draws left, counted through the buckets.
    narrow = x.groupBy(F.col(source_col).alias(s), F.col(b).alias("at")).agg(F.sum(F.col(r).cast("decimal(20,0)")).alias("rests"), F.count(key).alias("n"), F.max(z).alias("size"))
    per = Window.partitionBy(s)
    # The rests of a source may add up to more than 64 bits hold; their sum is a whole number of its size.
    ends = narrow.withColumn("left", F.expr(f"CAST(CAST(sum(CAST(rests AS DECIMAL(28,0))) OVER (PARTITION BY `{s}`) AS DECIMAL(38,0)) div CAST(size AS DECIMAL(20,0)) AS BIGINT)"))
    ends = ends.withColumn("before", F.coalesce(F.sum("n").over(per.orderBy(F.col("at").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ends = cut(ends.where("at IS NOT NULL AND before < left AND before + n >= left").select(s, F.col("at").alias("end"), (F.col("left") - F.col("before")).alias("take")))
    t = ends.select(F.col(s).alias(s2), F.col("end").alias(end), F.col("take").alias(take))
    x = _by_source(x, t, source_col, s2, "left")
    below = F.coalesce(F.col(b) < F.col(end), F.lit(False))
    at = F.coalesce(F.col(b) == F.col(end), F.lit(False))
    clear = x.where(~at).withColumn(copies_col, F.col(copies_col) + below.cast("bigint"))
    tie = [F.col(key).asc(), F.col(id_col).asc_nulls_first(), row_hash(docs)]
    edge = x.where(at).withColumn(rank, F.row_number().over(Window.partitionBy(source_col).orderBy(*tie)))
    edge = edge.withColumn(copies_col, F.col(copies_col) + (F.col(rank) <= F.col(take)).cast("bigint"))
    columns = [*all_columns(docs), F.col(copies_col)]
    return clear.select(*columns).unionByName(edge.select(*columns)).where(F.col(copies_col) > 0)


def repeat(mixed: DataFrame) -> DataFrame:
    """Each row as often as the last column says, without that column."""
    *columns, copies = all_columns(mixed)
    name = fresh(mixed, "kx_copy")
    return mixed.withColumn(name, F.explode(F.sequence(F.lit(1).cast("bigint"), copies))).select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "source", "copies")


SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(floor(sqrt(CAST(coalesce(length(text), 0) AS DOUBLE))) AS BIGINT) + 1 AS own,
    CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS u FROM documents),
c AS (SELECT source, count(*) AS n, CAST(sum(own) AS BIGINT) AS size, CAST(floor(sqrt(CAST(count(*) AS DOUBLE) * 1e6)) AS BIGINT) AS w FROM d GROUP BY source),
t AS (SELECT *, CAST(sum(n) OVER () AS BIGINT) AS total, CAST(sum(w) OVER () AS BIGINT) AS sum_w FROM c),
f AS (SELECT *, (total * w) // sum_w AS whole, (total * w) % sum_w AS rest FROM t),
g AS (SELECT source, size, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, source NULLS FIRST) <= total - sum(whole) OVER () THEN 1 ELSE 0 END AS draws FROM f),
x AS (SELECT doc_id, d.source, u, size, (draws * own) // size AS whole, (draws * own) % size AS r FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
k AS (SELECT *, CASE WHEN r > 0 THEN (CAST(u AS DOUBLE) / CAST({SPAN} - u AS DOUBLE)) / (CAST(r AS DOUBLE) / CAST(size - r AS DOUBLE)) END AS key,
  sum(r) OVER (PARTITION BY source) // size AS remaining FROM x),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY key NULLS LAST, doc_id NULLS FIRST) AS rank FROM k)
SELECT doc_id, source, CAST(whole + CASE WHEN key IS NOT NULL AND rank <= remaining THEN 1 ELSE 0 END AS BIGINT) AS copies FROM o
WHERE whole + CASE WHEN key IS NOT NULL AND rank <= remaining THEN 1 ELSE 0 END > 0
"""
