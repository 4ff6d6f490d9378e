"""Mixing sources to target weights by hash-threshold histograms. Native DataFrame code throughout.

The ids' hashes spread each source's documents over [0, 2**60). A source's target is so many whole passes over it and a fraction
of one; the fraction is the documents whose hash lies below a threshold. The threshold is found without sorting: words are summed by
source and the top bits of the hash, the bucket where the running sum crosses the budget is the boundary, and only its documents
are summed again by the next bits, until the boundary buckets hold one hash each or the hash is used up. A hash group is
taken if its middle lies at or below the budget, so the taken words miss the target by at most half a group.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; repeated rows and equal ids share a hash and
are taken together; sources without words have target 0; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Fixed values of the task: weights of the sources by code point, repeating, and the most passes over a source.
WEIGHTS, MOST = (5, 2, 1), 3
HASH_BITS, LEVEL_BITS = 60, 12


def hash_of_id():
    """60 bits of the id's digest; a null id has the digest of the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and the 60-bit hash of the id."""
    words = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    return common.pick(docs, ["doc_id", "source", "text"]).select("doc_id", "source", words.alias("size"), hash_of_id().alias("h"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, target. ``sizes`` has one row per source, so windows over all of it are small.

    Water filling: in order of ``most * size / weight`` the sources that stop early come first; a source stops if at its turn its
    share of what is left exceeds its cap.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(most))
    order = [F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source")]
    everything = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(everything)).withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("weight_left", F.sum("weight").over(rest))
    level = (F.col("total") - F.col("capped_before")) / F.col("weight_left")
    s = s.withColumn("stops", level * F.col("weight") > F.col("cap")).withColumn("level", F.when(~F.col("stops"), level))
    free = F.first("level", ignorenulls=True).over(everything)
    return s.select("source", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(free * F.col("weight")).alias("target"))


def _thresholds(docs: DataFrame, weights: Sequence[float], most: int) -> tuple[DataFrame, DataFrame, int]:
    """The sized rows; per source (s) its whole passes, boundary bucket and whether that is taken; and the bits below a bucket."""
    rows = common.materialize(sized(docs), "sizes")
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("passes", F.least(F.floor(ratio), F.lit(most)).cast("long")).withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
    # per source: the words known to lie below the bucket looked at (below), the bucket's first hash (low)
    state = common.materialize(goal.withColumn("below", F.lit(0).cast("long")).withColumn("low", F.lit(0).cast("long")), "thresholds")
    left = HASH_BITS
    while left > 0:
        left -= LEVEL_BITS
        inside = rows.join(state.select(F.col("source").alias("s"), "low"), F.col("source").eqNullSafe(F.col("s")))
        if left + LEVEL_BITS < HASH_BITS:
            inside = inside.where(F.shiftright("h", left + LEVEL_BITS) == F.shiftright("low", left + LEVEL_BITS))
        histogram = inside.groupBy("source", F.shiftright("h", left).alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("least"), F.max("h").alias("greatest"))
        running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        placed = histogram.withColumn("to", running).join(state.select(F.col("source").alias("s"), "below", "budget"), F.col("source").eqNullSafe(F.col("s")))
        placed = placed.withColumn("to", F.col("to") + F.col("below")).where(F.col("to") >= F.col("budget"))
        edge = placed.groupBy("source").agg(F.min(F.struct("bucket", (F.col("to") - F.col("words")).alias("below"), (F.col("least") == F.col("greatest")).alias("single"))).alias("e"))
        edge = edge.select(F.col("source").alias("es"), F.shiftleft(F.col("e.bucket"), left).alias("e_low"), F.col("e.below").alias("e_below"), F.col("e.single").alias("single"))
        joined = state.drop("single").join(edge, F.col("source").eqNullSafe(F.col("es")), "left")
        new = common.materialize(joined.select("source", "source_size", "target", "passes", "budget", F.coalesce("e_below", "below").alias("below"), F.coalesce("e_low", "low").alias("low"), F.coalesce("single", F.lit(True)).alias("single")), "thresholds")
        common.discard(state)
        state, done = new, new.agg(F.min("single")).first()[0]
        if done is not False:
            break
    # the boundary group itself: taken whole or not at all
    at = F.shiftright("low", left)
    marks = state.select(F.col("source").alias("s"), "source_size", "target", "passes", "budget", "below", at.alias("bucket"))
    edge = rows.join(marks, F.col("source").eqNullSafe(F.col("s"))).where(F.shiftright("h", left) == F.col("bucket")).groupBy("source").agg(F.sum("size").alias("group"))
    marks = common.materialize(marks.join(edge.select(F.col("source").alias("es"), "group"), F.col("s").eqNullSafe(F.col("es")), "left").select("s", "source_size", "target", "passes", "bucket", (F.col("below") + F.coalesce("group", F.lit(0)) / 2 <= F.col("budget")).alias("takes")), "marks")
    common.discard(state)
    return rows, marks, left


def _times(left: int, most: int, names: dict[str, str] | None = None):
    """How often a document is taken, by its hash (h) and its source's marks; ``names`` has their columns where they differ."""
    h, passes, bucket, takes = (F.col((names or {}).get(c, c)) for c in ("h", "passes", "bucket", "takes"))
    here = F.shiftright(h, left)
    extra = ((here < bucket) | ((here == bucket) & takes)).cast("long")
    return F.when(passes >= most, passes).otherwise(passes + extra)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken and times (how often a document is taken)."""
    rows, marks, left = _thresholds(docs, weights, most)
    times = _times(left, most)
    out = rows.join(marks, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", (times * F.col("size")).alias("taken"), times.alias("times"), "source")


#: The same mix in DuckDB's SQL: documents in order of hash, taken while their middle lies within the budget.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, source_size * 3.0::DOUBLE AS cap,
         CAST(CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight
  FROM s
), c AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_before,
         sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM w
), l AS (
  SELECT *, CAST(total - capped_before AS DOUBLE) / weight_left AS level FROM c
), f AS (
  SELECT *, level * weight > cap AS stops FROM l
), t AS (
  SELECT source, source_size, CASE WHEN stops THEN cap ELSE weight * (SELECT level FROM f WHERE NOT stops ORDER BY cap / weight, source IS NULL, source LIMIT 1) END AS target FROM f
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS passes FROM t
), g AS (
  SELECT d.source, h, sum(size) AS group_size FROM d GROUP BY d.source, h
), r AS (
  SELECT source, h, group_size, sum(group_size) OVER (PARTITION BY source ORDER BY h) - group_size AS below FROM g
)
SELECT d.doc_id, d.size, p.source_size, CAST(p.target AS DOUBLE) AS target,
       CAST((p.passes + CASE WHEN p.passes < 3 AND r.below + r.group_size / 2.0 <= p.target - p.passes * p.source_size THEN 1 ELSE 0 END) * d.size AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.h = r.h
"""


def apply(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of ``docs`` as often as the mixture takes them, with their columns.

    The thresholds are one small row per source, so the texts are filtered and repeated where they are read, without a shuffle of theirs.
    """
    rows, marks, left = _thresholds(docs, weights, most)
    common.discard(rows)
    taken_names = list(docs.columns)
    names = {}
    for c in ("s", "passes", "bucket", "takes", "h", "times", "n"):
        names[c] = common.free_name(taken_names, f"mix_{c}")
        taken_names.append(names[c])
    marks = marks.select(*[F.col(c).alias(names[c]) for c in ("s", "passes", "bucket", "takes")])
    marked = docs.withColumn(names["h"], hash_of_id()).join(marks, F.col("source").eqNullSafe(F.col(names["s"])))
    taken = marked.withColumn(names["times"], _times(left, most, names).cast("int")).where(F.col(names["times"]) > 0)
    return taken.withColumn(names["n"], F.explode(F.sequence(F.lit(1), F.col(names["times"])))).select(*[F.col(f"`{c}`") for c in docs.columns])
