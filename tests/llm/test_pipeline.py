"""The pipeline against the same stages by brute force or by the operators' tested single-row functions."""

import base64

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from touchline.llm import jaccard_join, mixture, pii, quality

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("n_chars", "n_chars")
    kept = corpus_pipeline.quality_rules(spark, docs, SF)
    want = {r.doc_id for r in quality.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns
    one = corpus_pipeline.near_duplicates(spark, kept, SF)
    groups = {r.component_id for r in jaccard_join.near_duplicates(kept).collect()}
    assert {r.doc_id for r in one.collect()} == groups
    clean = corpus_pipeline.mask_pii(spark, one, SF)
    texts = {r.doc_id: r.text for r in one.collect()}
    for r in clean.collect():
        assert r.text == pii.masked(texts[r.doc_id]) and r.n_chars == len(r.text) and not pii.identifiers(r.text)
    mixed = corpus_pipeline.mix_sources(spark, clean, SF)
    copies = {r.doc_id: r.copies for r in mixture.plan(clean).collect()}
    assert mixed.columns == docs.columns and mixed.count() == sum(copies.values())
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    masked = {r.doc_id: r.text for r in clean.collect()}
    want = sorted((i, enc.encode_ordinary(masked[i])) for i, n in copies.items() for _ in range(n))
    assert sorted((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_repeated_rows_null_ids_and_one_id_with_two_texts(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    verdict = {r.doc_id: (r.kept, r.llr) for r in quality.judge(source, labels).collect()}
    groups = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(source).collect()}
    # the five that the rules keep by the widest margin: the rows added below shift the scores a little
    alone = sorted((i for i, c in groups.items() if i == c and list(groups.values()).count(c) == 1 and verdict[i][0]), key=lambda i: -verdict[i][1])[:5]
    text = {r.doc_id: r.text for r in source.collect()}
    a, b, c, d, e = (text[i] for i in alone)
    bad = "junk ### junk"
    rows = [(900_001, a, "x"), (900_001, a, "x"), (900_001, a, "w"), (900_002, a, "x"), (None, a, "x"), (None, b, "x"), (None, b, "x"), (None, bad, "x"), (None, c, "x"), (900_003, d, "x"), (900_003, bad, "x"), (900_003, e, "x"), (900_004, bad, "x"), (None, None, "x")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.quality_rules(spark, docs.unionByName(source), SF).filter("doc_id IS NULL OR doc_id > 900000")
    assert sorted((repr(r.doc_id), r.text) for r in kept.collect()) == sorted((repr(i), t) for i, t, _ in rows if t not in (bad, None))
    one = corpus_pipeline.near_duplicates(spark, docs.filter("length(text) > 20"), SF)
    assert one.columns == docs.columns
    assert sorted((repr(r.doc_id), r.text, r.source) for r in one.collect()) == sorted([("900001", a, "w"), ("None", b, "x"), ("None", c, "x"), ("900003", d, "x"), ("900003", e, "x")])


def test_columns_of_any_name_and_type_and_empty_tables(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    more = {"_n": "1", "_kept": "true", "kept": "true", "key": "'k'", "copies": "2", "of": "'o'", "row": "named_struct('x', 1)", "a.b": "1.5D", "t": "timestamp'2020-01-02 03:04:05'", "d": "cast(1.25 as decimal(20,2))", "f": "cast(1 as float)", "list": "array(1, null)", "m": "map('k', 1)", "chunk": "1", "cls": "1", "bin": "binary('x')"}
    docs = source.selectExpr("*", *[f"{v} AS `{k}`" for k, v in more.items()])
    docs = docs.unionByName(docs.limit(5)).unionByName(docs.limit(3).withColumns({"doc_id": F.lit(None).cast("long")})).unionByName(docs.limit(2).withColumns({"text": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})).checkpoint()
    for table, least in ((docs, 1), (docs.limit(0), 0)):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            if name != "quality_rules":  # sixty documents are few; null texts go here
                found = stage(spark, now, SF)
            else:
                found = stage(spark, now, SF)
                assert found.filter("text IS NULL").count() == 0
                found = now.filter("text IS NOT NULL")
            path = corpus_pipeline.scratch(spark, name)
            found.write.parquet(path)
            now = spark.read.parquet(path)
            if name != "encode":
                assert now.dtypes == table.dtypes
        assert now.columns == ["doc_id", "ids", "n_tokens"] and now.count() >= least
    clean = corpus_pipeline.mask_pii(spark, docs, SF)
    same = [c for c in docs.columns if c not in ("text", "n_chars")]
    assert sorted(map(repr, clean.select(*[f"`{c}`" for c in same]).collect())) == sorted(map(repr, docs.select(*[f"`{c}`" for c in same]).collect()))
