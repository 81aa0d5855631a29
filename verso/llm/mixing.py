"""Mixing sources to target weights, in DataFrame operations only.

The size of a document is its number of words. Sources in the order of their code points, null last, weigh 1, 2, 3 and so on
in turn, and share the total of all sizes; a target stops at `most` times its source's size and what is left goes to the
others by weight. With sources in the order of limit / weight, those that stop are a prefix, so one running sum finds the
level: no rounds. A document is then emitted floor(rate) times, and once more if a hash of its id says so (Bernoulli
with the fraction's probability), where rate = target / source size. The draw depends on seed and id alone: reruns agree.

Rows are counted per source before any shuffle. The table of sources has one row each; it is broadcast if it has at
most `BROADCAST_ROWS` rows and else joined by the source, where Spark splits large partitions.

Edge cases: a null text has size 0; a null source is a source of its own; a null id draws as the text 'null'; rows with equal
ids draw alike; a source or a total of size 0 has target 0 and gives nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from verso.cluster import stored

BROADCAST_ROWS = 10_000
MOST = 3
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: int = 3, most: int = MOST) -> DataFrame:
    """From rows (source, size): a row (source, source_size, target) for each source, by water-filling in whole numbers."""
    whole = "decimal(38,0)"
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = W.partitionBy()
    per = per.withColumn("weight", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % weights + 1)
    per = per.withColumns({"total": F.sum("source_size").over(everything).cast(whole), "all_weight": F.sum("weight").over(everything).cast(whole)})
    per = per.withColumn("stop", (F.col("source_size") * most).cast(whole))
    # limit / weight in whole numbers: all weights divide `even`
    even = math.lcm(*range(1, weights + 1))
    order = W.orderBy(F.col("stop") * (F.lit(even) / F.col("weight")).cast(whole), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumns({"gone": F.coalesce(F.sum("stop").over(order), F.lit(0)).cast(whole), "gone_weight": F.coalesce(F.sum("weight").over(order), F.lit(0)).cast(whole)})
    per = per.withColumn("stops", (F.col("total") - F.col("gone")) * F.col("weight") > F.col("stop") * (F.col("all_weight") - F.col("gone_weight")))
    rest = F.col("total") - F.sum(F.when(F.col("stops"), F.col("stop")).otherwise(0)).over(everything)
    rest_weight = F.sum(F.when(F.col("stops"), 0).otherwise(F.col("weight"))).over(everything)
    level = (rest * F.col("weight")).cast("double") / rest_weight.cast("double")
    return per.select("source", "source_size", F.when(F.col("stops"), F.col("stop").cast("double")).otherwise(level).alias("target"))


def with_copies(df: DataFrame, targets: DataFrame, id_col: str, source_col: str, seed: str = SEED) -> DataFrame:
    """df with the columns mix_source_size, mix_target and mix_copies. targets: from source_targets()."""
    table = stored(targets).select(F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    if table.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    both = df.join(table, df[source_col].eqNullSafe(F.col("mix_source")), "left").drop("mix_source")
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return both.withColumn("mix_copies", (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long"))


def mix_plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """Per row: id, size, source_size, target, taken (size times copies), copies."""
    sizes = stored(df.select(df[id_col].alias("doc_id"), df[source_col].alias("source"), n_words(df[text_col]).alias("size")))
    planned = with_copies(sizes, source_targets(sizes), "doc_id", "source", seed)
    return planned.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("size") * F.col("mix_copies")).alias("taken"), F.col("mix_copies").alias("copies"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The mixed documents: each row of df as often as it is emitted, with df's columns."""
    targets = source_targets(df.select(df[source_col].alias("source"), n_words(df[text_col]).alias("size")))
    whole = df.select(F.struct("*").alias("row"), df[id_col].alias("doc_id"), df[source_col].alias("source"))
    planned = with_copies(whole, targets, "doc_id", "source", seed).where("mix_copies > 0")
    return planned.select(F.explode(F.array_repeat("row", F.col("mix_copies").cast("int"))).alias("row")).select("row.*")


SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents)
, p AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1))
, q AS (SELECT *, sum(source_size) OVER () AS t, sum(w) OVER () AS aw, ({MOST} * source_size)::HUGEINT AS stop FROM p)
, r AS (SELECT *, coalesce(sum(stop) OVER o, 0)::HUGEINT AS gone, coalesce(sum(w) OVER o, 0)::HUGEINT AS gw FROM q
    WINDOW o AS (ORDER BY stop * (6 // w), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
, s AS (SELECT *, (t - gone) * w > stop * (aw - gw) AS stops FROM r)
, u AS (SELECT source, source_size, CASE WHEN stops THEN stop::DOUBLE ELSE ((t - sum(CASE WHEN stops THEN stop ELSE 0 END) OVER ()) * w)::DOUBLE / (sum(CASE WHEN stops THEN 0 ELSE w END) OVER ())::DOUBLE END AS target FROM s)
, v AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE / {1 << 48}::DOUBLE AS draw
    FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
, x AS (SELECT *, (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM v)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM x"""
