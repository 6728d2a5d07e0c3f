"""Operator 12, filter interaction audit: a relational word pipeline, in DataFrame operations alone.

Words are exploded and counted by (document, word), those counts by document to totals and distincts; the other filters' flags are joined to them from outside, since a document without words has no
row there. Five flags make one of 32 masks: each part's rows are counted by mask, in 32 conditional counts, and again for the good and for the toxic ones. All 120 orders of the filters follow from
these counts: a filter removes, at its place in an order, the masks that hold it and none of the filters before it. So the corpus is read for its flags alone, and what is shuffled for the orders is
one row a part and task.

Texts are dealt out by document before their words are exploded, so that a document's words are in one task and no word is shuffled. A filter's Shapley value over all orders needs no sum over
orders: of the filters that a document fails, each is the first in 120 / (number of those) orders.

A document is a row's id and text. Rows that repeat both are counted each; they fail the same filters, and their words are counted once. Null texts are empty, null sources the empty string's part. A
null id is no smaller and no larger than any, so such rows never repeat another, and have no labels. Where an id has several rows of labels, one of quality 1 makes it good, and one of toxic 1 toxic. An
empty table gives an empty result.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, documents, prepare, release, small

FILTERS = "ABCDE"
#: A: words at least; B: distinct words of a hundred at least; C: capitals of a hundred characters at most; D: symbols that may not occur.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, "[#$%&*|]"
MASKS = 1 << len(FILTERS)
#: Bytes of text of a task that explodes words, as planned.
TASK_BYTES = 24 << 20


def word_totals(texts: DataFrame) -> DataFrame:
    """doc_id, key, words, distinct_words of each document (doc_id, key, text) that has a word."""
    words = texts.select("doc_id", "key", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).filter("word <> ''")
    by_word = words.groupBy("doc_id", "key", "word").agg(F.count("*").alias("n"))
    return by_word.groupBy("doc_id", "key").agg(F.sum("n").alias("words"), F.count("*").alias("distinct_words"))


def flagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, mask (bit k: the k-th filter fails), rows: how many rows are so."""
    prepare(docs.sparkSession)
    text = F.coalesce(column(text_col), F.lit(""))
    named = docs.select(column(id_col).cast("long").alias("doc_id"), F.coalesce(column(part_col), F.lit("")).alias("part"), text.alias("text")).withColumn("key", F.xxhash64("text"))
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    plain = named.select("doc_id", "part", "key", F.unhex(F.md5("text")).alias("digest"), F.octet_length("text").cast("long").alias("bytes"), (100 * capitals.cast("long") > MOST_CAPITALS * F.length("text").cast("long")).alias("c"), F.col("text").rlike(SYMBOLS).alias("d"))
    rows = plain.groupBy("doc_id", "part", "key", "digest", "bytes", "c", "d").agg(F.count("*").alias("rows")).checkpoint()

    # a document's text goes to one task once: where rows repeat an id and a text, those of a task are made one before they travel
    total, repeats = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("rows"), F.lit(0))).first()
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    again = rows.groupBy("doc_id", "key").agg(F.sum("rows").alias("rows")).filter("rows > 1").select(F.col("doc_id").alias("of"), F.col("key").alias("of_key"))
    texts = named.select("doc_id", "key", "text")
    if not again.isEmpty():
        again = small(again.checkpoint())
        same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key"))
        texts = texts.join(again, same, "left_anti").unionByName(texts.join(again, same, "left_semi").dropDuplicates(["doc_id", "key"]))
    counted = word_totals(texts.repartition(tasks, "doc_id", "key")).select(F.col("doc_id").alias("of"), F.col("key").alias("of_key"), "words", "distinct_words").checkpoint()
    release(docs.sparkSession)

    # the smallest id of texts that several ids have
    shared = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select(F.col("digest").alias("same"), "least")
    known = rows.join(small(shared.checkpoint()), F.col("digest") == F.col("same"), "left").join(counted, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    words, distinct = (F.coalesce(c, F.lit(0)) for c in ("words", "distinct_words"))
    fails = [words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, F.col("c"), F.col("d"), F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))]
    return known.select("doc_id", "part", sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0)).alias("mask"), "rows")


def cells(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """part, and counts, good, toxic: each an array of 32 counts, by mask."""
    marks = labels.select(F.col("doc_id").cast("long").alias("of"), "quality", "toxic").filter("of IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("of")
    marks = marks.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marked = flags.join(small(marks.checkpoint()), F.col("doc_id") == F.col("of"), "left")
    kinds = {"counts": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    count = lambda k, m: F.sum(F.when((F.col("mask") == m) & kinds[k], F.col("rows")).otherwise(F.lit(0).cast("long"))).alias(f"{k}_{m}")
    wide = marked.groupBy("part").agg(*[count(k, m) for k in kinds for m in range(MASKS)])
    return wide.select("part", *[F.array(*[F.col(f"{k}_{m}") for m in range(MASKS)]).alias(k) for k in kinds])


def audit(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: all orders and steps of each part."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.ascii(letter) - ord("A"))
    steps = cells(flags, labels).withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    steps = steps.withColumn("own", bit(F.substr("filter_order", F.col("step"), F.lit(1))))
    before = F.aggregate(F.sequence(F.lit(1), F.lit(len(FILTERS))), F.lit(0), lambda s, i: s + F.when(i < F.col("step"), bit(F.substr("filter_order", i, F.lit(1)))).otherwise(0))
    steps = steps.withColumn("before", before)
    own, prior = F.col("own"), F.col("before")

    def total(of: str, wanted, weight=None) -> Column:
        """The sum of counts of the masks that are wanted, each times its weight."""
        one = lambda x, m: F.when(wanted(m), x * weight(m) if weight else x).otherwise(F.lit(0).cast("long"))
        return F.aggregate(F.transform(of, one), F.lit(0).cast("long"), lambda s, x: s + x)

    fails = lambda m: m.bitwiseAND(own) != 0
    there = lambda m: m.bitwiseAND(prior) == 0
    lost = lambda m: fails(m) & there(m)
    n_orders = len(list(permutations(FILTERS)))
    return steps.select(
        "part", "filter_order", "step", total("counts", lambda m: ~fails(m) & there(m)).alias("kept"), total("counts", lost).alias("removed"), total("counts", lambda m: fails(m) & ~there(m)).alias("redundant"),
        total("counts", lambda m: m == own).alias("unique_fails"), total("good", lost).alias("good_lost"), total("toxic", lost).alias("toxic_lost"), total("counts", fails, lambda m: (F.lit(n_orders) / F.bit_count(m)).cast("long")).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(flagged(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: DuckDB, for op12_filter_audit: every order's steps by themselves, from each row's flags.
SQL = r"""
WITH flags AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
    100 * len(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * len(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS good, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL), false) AS toxic
  FROM (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)),
cell AS MATERIALIZED (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM flags GROUP BY 1, 2),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits FROM letter p, letter q, letter r, letter s, letter t
  WHERE p.bit | q.bit | r.bit | s.bit | t.bit = 31),
steps AS MATERIALIZED (
  SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS prior FROM orders, range(1, 6) s(step)),
counted AS MATERIALIZED (
  SELECT part, filter_order, step, own,
    CAST(coalesce(sum(n) FILTER (mask & own = 0 AND mask & prior = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (mask & own <> 0 AND mask & prior = 0), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (mask & own <> 0 AND mask & prior <> 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (mask & own <> 0 AND mask & prior = 0), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & prior = 0), 0) AS BIGINT) AS toxic_lost
  FROM cell, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM counted
"""
