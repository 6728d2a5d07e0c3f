"""Operator 4, mixing sources to target weights, in DataFrame operations alone.

Tokens (here: words) are summed by source; a source's rate is its target over its size. Each document is emitted floor(rate) times, plus once more with the
fraction's probability: a Bernoulli draw seeded by a hash of the document's id and its text, so reruns and other partitionings agree. Rows that repeat both, and their source, are numbered, and the number is in the seed of all but
the first, so that they are drawn independently of each other: of 2,000 equal rows at a rate of 1.5, about 1,000 are taken twice.

Targets: sources in code point order (null last) weigh ``WEIGHTS`` in turn and share ``SHARE`` of all sizes; a target stops at ``MOST`` times its source's size, and the rest
is shared again by weight, among those that aren't full, until none is above: one sum over the sources each time, with whole numbers.

Null texts have size 0; a null source is a source; repeated rows are drawn each; an empty table gives an empty result. Where rows repeat an id and a text but differ in other columns, how many of them are taken more often
is fixed, while which ones depends on how they are dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, column, documents, prepare, small, unused

WEIGHTS = (5, 2, 1)
#: As fractions of whole numbers, so that all sums are exact.
SHARE_NUM, SHARE_DEN, MOST = 3, 2, 2


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(total: DataFrame) -> DataFrame:
    """Rows with their place in code point order of source (null last), from 0: sorted by ranges, each row's place in its range after the sizes of the ranges before. No task holds all sources."""
    order = F.col("source").asc_nulls_last()
    placed = total.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()).checkpoint()
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = {r[0]: r[1] for r in placed.groupBy(part).count().collect()}  # as many rows as the sort has tasks
    before, n = [], 0
    for k in range(max(sizes, default=-1) + 1):
        before.append(n)
        n += sizes.get(k, 0)
    first = F.get(F.array(*map(F.lit, before or [0])), part.cast("int"))
    return placed.withColumn("place", first + row).drop("at")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target double of each source. sizes: source, size."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = ranked(total).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS)).cast("int") + 1).cast("long"))
    size, weight = (F.col(k).cast("decimal(38,0)") for k in ("source_size", "weight"))
    sums = lambda df: [int(x or 0) for x in df.agg(F.sum(size), F.sum(weight)).first()]
    all_size, all_weight = sums(weighed)
    full_size = full_weight = 0
    # sources that are full stay so, since the others' share grows with each of them
    while True:
        left, rest = SHARE_NUM * all_size - MOST * SHARE_DEN * full_size, SHARE_DEN * (all_weight - full_weight)
        full = weight * F.lit(left).cast("decimal(30,0)") > size * F.lit(MOST * rest).cast("decimal(30,0)")
        now = sums(weighed.filter(full))
        if now == [full_size, full_weight] or now[1] == all_weight:
            break
        full_size, full_weight = now
    share = (F.lit(left) * F.col("weight")).cast("double") / F.lit(float(rest or 1))
    return weighed.select("source", "source_size", F.when(full, (MOST * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def draw(*seed: Column) -> Column:
    """[0, 1): 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(s.cast("string"), F.lit("")) for s in seed])), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def copies(target: Column, source_size: Column, seed: Column) -> Column:
    """floor(rate), plus one with the fraction's probability."""
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    return F.floor(rate).cast("long") + (seed < rate - F.floor(rate)).cast("long")


def numbered(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """rows (kept in a checkpoint, so that its parts stay the same) with the number, from 1, of each row among those with the same keys.

    A task's rows of a key are numbered by themselves, after those of the tasks before it: a key that many rows have is no single task's work."""
    part, before = unused(rows, "part", "before")
    dealt = rows.withColumn(part, F.spark_partition_id())
    same = Window.partitionBy(*map(column, keys)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*map(column, keys), column(part)).agg(F.count("*").alias(before)).withColumn(before, F.coalesce(F.sum(before).over(same), F.lit(0)))
    within = F.row_number().over(Window.partitionBy(*map(column, keys), column(part)).orderBy(F.lit(0)))
    of = unused(dealt, *[f"of_{k}" for k in range(len(keys))], "of_part")
    sizes = sizes.select(*[column(k).alias(o) for k, o in zip([*keys, part], of, strict=True)], before)
    on = column(part) == column(of[-1])
    for k, o in zip(keys, of, strict=False):
        on &= column(k).eqNullSafe(column(o))
    return dealt.withColumn(number, within).join(sizes, on).withColumn(number, column(number) + column(before)).select(*map(column, rows.columns), number)


def _seed(ident: Column, digest: Column, number: Column) -> Column:
    """The draw of the number-th row of an id, a text and a source."""
    return F.when(number > 1, draw(ident, digest, number)).otherwise(draw(ident, digest))


def _repeats(narrow: DataFrame) -> DataFrame | None:
    """ident, digest that several rows have, or None."""
    again = narrow.groupBy("ident", "digest").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("ident").alias("of_ident"), F.col("digest").alias("of_digest")).checkpoint()
    return None if again.isEmpty() else small(again)


def _same(ident: Column, digest: Column) -> Column:
    return ident.eqNullSafe(F.col("of_ident")) & (digest == F.col("of_digest"))


def _narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """ident, digest, source, size of each row, kept in the shared folder: texts are read once for all counts."""
    text = column(text_col)
    return docs.select(column(id_col).alias("ident"), F.md5(F.coalesce(text, F.lit(""))).alias("digest"), column(source_col).alias("source"), words(text).alias("size")).checkpoint()


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, copies of each row."""
    prepare(docs.sparkSession)
    narrow = _narrow(docs.withColumn(id_col, column(id_col).cast("long")), id_col, text_col, source_col)
    again = _repeats(narrow)
    rows = narrow.withColumn("number", F.lit(1))
    if again is not None:
        on = _same(F.col("ident"), F.col("digest"))
        rows = narrow.join(again, on, "left_anti").withColumn("number", F.lit(1)).unionByName(numbered(narrow.join(again, on, "left_semi").checkpoint(), ["ident", "digest", "source"], "number"))
    goal = targets(narrow).withColumnRenamed("source", "of")
    u = _seed(F.col("ident"), F.col("digest"), F.col("number"))
    return rows.join(goal, F.col("source").eqNullSafe(F.col("of"))).select(F.col("ident").alias("doc_id"), "size", "source_size", "target", copies(F.col("target"), F.col("source_size"), u).alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns."""
    prepare(docs.sparkSession)
    narrow = _narrow(docs, id_col, text_col, source_col)
    again = _repeats(narrow)
    goal = targets(narrow)
    of, size, target, n, number, digest = unused(docs, "of", "source_size", "target", "copies", "number", "digest")
    goal = goal.select(F.col("source").alias(of), F.col("source_size").alias(size), F.col("target").alias(target))
    rows = docs.withColumn(digest, F.md5(F.coalesce(column(text_col), F.lit(""))))
    if again is None:
        rows = rows.withColumn(number, F.lit(1))
    else:
        mark = unused(rows, "of_ident", "of_digest")
        again = again.select(F.col("of_ident").alias(mark[0]), F.col("of_digest").alias(mark[1]))
        on = column(id_col).eqNullSafe(column(mark[0])) & (column(digest) == column(mark[1]))
        rows = rows.join(again, on, "left_anti").withColumn(number, F.lit(1)).unionByName(numbered(rows.join(again, on, "left_semi").checkpoint(), [id_col, digest, source_col], number))
    u = _seed(column(id_col), column(digest), column(number))
    # few and small rows, but their number isn't known beforehand: the optimizer broadcasts them if their measured size allows
    taken = rows.join(goal, column(source_col).eqNullSafe(F.col(of))).withColumn(n, copies(F.col(target), F.col(size), u).cast("int"))
    return taken.select(*map(column, docs.columns), F.explode(F.array_repeat(F.lit(0), F.col(n))).alias(of)).drop(of)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: DuckDB, for op4_mix_sources.
SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) || CASE WHEN number > 1 THEN ':' || number ELSE '' END), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, coalesce(text, ''), source) AS number FROM documents)),
total AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighed AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS BIGINT) AS weight FROM total),
filled AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS all_size, CAST(sum(weight) OVER () AS BIGINT) AS all_weight,
    CAST(coalesce(sum(source_size) OVER o, 0) AS BIGINT) AS size_before, CAST(coalesce(sum(weight) OVER o, 0) AS BIGINT) AS weight_before
  FROM weighed
  WINDOW o AS (ORDER BY source_size * (10 // weight), source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marked AS (SELECT *, (3 * all_size - 4 * size_before) * weight > 4 * source_size * (all_weight - weight_before) AS filled_up FROM filled),
goal AS (
  SELECT source AS of_source, source_size, CASE WHEN filled_up THEN CAST(2 * source_size AS DOUBLE) ELSE
    CAST((3 * all_size - 4 * CAST(coalesce(sum(source_size) FILTER (filled_up) OVER (), 0) AS BIGINT)) * weight AS DOUBLE)
    / CAST(2 * (all_weight - CAST(coalesce(sum(weight) FILTER (filled_up) OVER (), 0) AS BIGINT)) AS DOUBLE) END AS target
  FROM marked),
rates AS (
  SELECT doc_id, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE CAST(0 AS DOUBLE) END AS rate
  FROM sizes JOIN goal ON source IS NOT DISTINCT FROM of_source)
SELECT doc_id, size, source_size, target, size * (CAST(floor(rate) AS BIGINT) + CAST(u < rate - floor(rate) AS BIGINT)) AS taken FROM rates
"""
