"""Operator 1: mixing sources to target weights with a time-varying curriculum.

Every source has a weight and a schedule: a piecewise linear rate over training time 0..1. Weights give each source
its target number of words (none above `cap` times its size; the excess is shared again by weight). The schedule's
integral is the source's cumulative demand; documents of a source stand in a fixed pseudo-random order, and a
document's training position is the time at which demand reaches it, the inverse of that integral. Documents that
demand passes k times are taken k times; the result is range-sorted by position.

Running sums need no global order: a source is dealt into buckets of its hash order, each with the words before it. There is a
bucket for every ROWS_A_BUCKET rows of the table, so the hottest source is spread and no window grows with the input. Sizes are
summed before anything moves. plan() counts words once and goes on with narrow rows; copies() counts them twice, since whole rows
would cost more to write than words to count.

Nulls: a null source is a source of its own, last in order; a null text has size 0. Empty texts take no words, and are taken
once more than their source's whole passes only where the source has words left over. A source
without words has target 0 and its documents stay once. Repeated rows count as often as they occur; the hash order is that of
doc_id and text, its ties fall to (doc_id, size). Extra columns are carried by copies() and ignored by plan().
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.common import SPACE_CLASS, SPACES, materialise, whole_row

#: Weights that sources take in turn, in code point order.
WEIGHTS = (1, 2, 3)
#: Rate over training time for each weight: (time, rate) knots. Heavier sources come later.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
CAP, BUCKETS, ROWS_A_BUCKET = 3, 1024, 8192


def word_count(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE_CLASS + "+"))).cast("long")


def _keyed(docs: DataFrame, buckets: int, *row: Column) -> DataFrame:
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))))
    return docs.select(
        *row,
        F.col("doc_id").cast("long").alias("_id"),
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source").cast("string"))).alias("_src"),
        word_count(F.col("text")).alias("_size"),
        order.alias("_order"),
        F.floor(F.conv(F.substring(order, 1, 12), 16, 10).cast("double") * F.lit(float(buckets)) / F.lit(2.0**48)).cast("long").alias("_bucket"),
    )


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """_src, _total (a source's size) -> also _class (place in weights), _target. One row a source."""
    rank = F.row_number().over(Window.orderBy(F.col("_src") == "n", "_src"))
    w = sizes.withColumn("_rank", rank).withColumn("_class", F.pmod(F.col("_rank") - 1, F.lit(len(weights))))
    w = w.withColumn("_w", F.get(F.array(*[F.lit(int(x)) for x in weights]), F.col("_class")).cast("long"))
    by_need = Window.orderBy(F.col("_total") / F.col("_w"), "_rank")
    every = Window.partitionBy()
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    after = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # sources in the order in which they fill up: the first that stays below its cap fixes the share of all later ones
    w = w.withColumn("_left", F.sum("_total").over(every) - cap * F.coalesce(F.sum("_total").over(before), F.lit(0)))
    w = w.withColumn("_open", F.sum("_w").over(after)).withColumn("_i", F.row_number().over(by_need))
    full = F.col("_w") * F.col("_left") > cap * F.col("_total") * F.col("_open")
    w = w.withColumn("_first", F.min(F.when(~full, F.struct("_i", "_left", "_open"))).over(every))
    capped = F.col("_first").isNull() | (F.col("_i") < F.col("_first._i"))
    share = (F.col("_w") * F.col("_first._left")).cast("double") / F.col("_first._open").cast("double")
    return w.select("_src", "_total", "_class", F.when(capped, (cap * F.col("_total")).cast("double")).otherwise(share).alias("_target"))


def position(demand: Column, klass: Column, schedules=SCHEDULES) -> Column:
    """Training time at which a source of this class has used the share `demand` (0..1) of its target."""
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        area = [0.0]
        for (t0, m0), (t1, m1) in zip(knots, knots[1:], strict=False):
            area.append(area[-1] + (m0 + m1) / 2 * (t1 - t0))
        time = F.lit(float(knots[-1][0]))
        for i in reversed(range(len(knots) - 1)):
            (t0, m0), (t1, m1) = knots[i], knots[i + 1]
            v = demand * area[-1] - area[i]
            root = F.sqrt(F.greatest(F.lit(m0 * m0) + F.lit(2 * (m1 - m0) / (t1 - t0)) * v, F.lit(0.0)))
            inside = F.lit(float(t0)) + F.lit(2.0) * v / F.nullif(F.lit(float(m0)) + root, F.lit(0.0))
            time = F.when(v < area[i + 1] - area[i], F.coalesce(inside, F.lit(float(t0)))).otherwise(time)
        out = F.when(klass == k, time).otherwise(out)
    return out


def _buckets(docs: DataFrame, buckets: int | None) -> int:
    return buckets or max(BUCKETS, docs.count() // ROWS_A_BUCKET)


def _taken(keyed: DataFrame, sums: DataFrame, weights, cap) -> DataFrame:
    goal = targets(sums.groupBy("_src").agg(F.sum("_words").alias("_total")), weights, cap)
    earlier = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_src", "_bucket", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_offset")).join(goal, "_src")
    inside = Window.partitionBy("_src", "_bucket").orderBy("_order", F.col("_id").asc_nulls_first(), "_size").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_offset") + F.coalesce(F.sum("_size").over(inside), F.lit(0))
    rows = keyed.join(offsets, ["_src", "_bucket"]).withColumn("_at", at)
    passes = F.when(F.col("_total") > 0, F.floor(F.col("_target") / F.nullif(F.col("_total"), F.lit(0)).cast("double"))).otherwise(F.lit(1)).cast("long")
    rest = F.col("_target") - (passes * F.col("_total")).cast("double")
    again = (F.col("_total") > 0) & (rest > 0) & ((2 * F.col("_at") + F.col("_size")).cast("double") <= F.lit(2.0) * rest)
    return rows.withColumn("_copies", passes + F.when(again, F.lit(1)).otherwise(F.lit(0)))


def _time(copy: Column, schedules) -> Column:
    demand = (F.col("_at") + copy * F.col("_total")).cast("double") / F.nullif(F.col("_target"), F.lit(0.0))
    return F.coalesce(position(demand, F.col("_class"), schedules), F.lit(0.0))


def _sums(keyed: DataFrame) -> DataFrame:
    return materialise(keyed.groupBy("_src", "_bucket").agg(F.sum("_size").alias("_words")), "mix-buckets")


def plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, schedules=SCHEDULES, buckets: int | None = None) -> DataFrame:
    """Per row: doc_id, size, source_size, target (its source's), taken, copies, position of the first copy; range-sorted by position."""
    narrow = docs.select("doc_id", "source", "text")
    keyed = materialise(_keyed(narrow, _buckets(narrow, buckets)), "mix-sizes")
    rows = _taken(keyed, _sums(keyed), weights, cap)
    out = rows.select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).alias("taken"), F.col("_copies").alias("copies"),
        F.when(F.col("_copies") > 0, F.round(_time(F.lit(0), schedules), 6)).alias("position"),
    )
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def copies(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, schedules=SCHEDULES, buckets: int | None = None) -> DataFrame:
    """The training set: the rows of docs, each as often as it is taken, range-sorted by training position."""
    n = _buckets(docs, buckets)
    rows = _taken(_keyed(docs, n, whole_row(docs).alias("_row")), _sums(_keyed(docs, n)), weights, cap).filter("_copies > 0")
    each = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies").cast("int") - 1)))
    timed = each.select("_row", _time(F.col("_copy"), schedules).alias("_position"), "_order")
    return timed.repartitionByRange("_position", "_order").sortWithinPartitions("_position", "_order").select("_row.*")


SQL = """
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')) AS ord,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS total FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rk FROM sources),
weighed AS (SELECT *, CAST(1 + (rk - 1) % 3 AS BIGINT) AS w FROM ranked),
filling AS (
  SELECT *, row_number() OVER need AS i, CAST(sum(w) OVER (ORDER BY total / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS wopen,
         CAST(sum(total) OVER () - 3 * coalesce(sum(total) OVER (ORDER BY total / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest
  FROM weighed WINDOW need AS (ORDER BY total / w, rk)),
edge AS (SELECT min(i) AS i FROM filling WHERE NOT (w * rest > 3 * total * wopen)),
goals AS (
  SELECT f.source, f.total, f.w,
         CASE WHEN e.i IS NULL OR f.i < e.i THEN CAST(3 * f.total AS DOUBLE)
              ELSE CAST(f.w * g.rest AS DOUBLE) / CAST(g.wopen AS DOUBLE) END AS target
  FROM filling f CROSS JOIN edge e LEFT JOIN filling g ON g.i = e.i),
placed AS (
  SELECT s.doc_id, s.size, g.total, g.w, g.target,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ord, s.doc_id NULLS FIRST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at_
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
passed AS (SELECT *, CASE WHEN total > 0 THEN CAST(floor(target / CAST(total AS DOUBLE)) AS BIGINT) ELSE 1 END AS passes FROM placed),
taken AS (
  SELECT *, passes + CASE WHEN total > 0 AND target - CAST(passes * total AS DOUBLE) > 0 AND CAST(2 * at_ + size AS DOUBLE) <= 2.0 * (target - CAST(passes * total AS DOUBLE)) THEN 1 ELSE 0 END AS copies,
         coalesce(CAST(at_ AS DOUBLE) / nullif(target, 0), 0) AS u FROM passed)
SELECT doc_id, size, total AS source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies,
       CASE WHEN copies > 0 THEN round(coalesce(CASE
         WHEN u >= 1 THEN 1.0
         WHEN w = 1 THEN 2.0 * u / (1.5 + sqrt(greatest(2.25 - 2.0 * u, 0)))
         WHEN w = 2 THEN 2.0 * u / 2.0
         ELSE 2.0 * u / (0.5 + sqrt(0.25 + 2.0 * u)) END, 0), 6) END AS position
FROM taken
"""
