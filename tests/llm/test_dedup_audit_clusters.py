"""Operators 11 to 13 against brute force and SQL, and their edges: nulls, empty and long texts, repeats, ties, empty tables, clashing extra columns."""

import hashlib
import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from touchline.llm import clustering, filter_audit, queries, simhash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \n", "One", "one TWO", "a b c", "A B C", "x\0y z\x85w q", "ÄÖ äö ß", "w " * 60, "word " * 200_000, "A" * 70_000, "Hello # world", "same text here", "same text here", "same text here"]


def table(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, fp string, part int, mask int, rows int, words int, of int"
    return spark.createDataFrame([(i, t, "en", s, 0, "k", "f", 1, 2, 3, 4, 5) for i, t, s in rows], schema).repartition(3)


@pytest.fixture(scope="module")
def rows(spark):
    found = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found += [(10_000 + i, t, (None, "", "odd")[i % 3]) for i, t in enumerate(TEXTS)]
    return found + [(20_000, found[3][1], "s"), (20_000, found[3][1], "s"), (20_000, "another text", "s"), (None, "no id here", None), (None, "no id here", None), (None, "same text here", "odd")]


def fingerprint(text):
    w = [x.encode() for x in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps):
    """Component numbers, by all pairs."""
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            label[max(root(a), root(b))] = min(root(a), root(b))
    return [root(x) for x in range(len(fps))]


def test_simhash_equals_brute_force(spark, rows):
    plain = [r for r in rows if not r[1] or len(r[1]) < 20_000]
    r = random.Random(4)
    long = [f"w{r.randrange(4000)}" for _ in range(1500)]
    plain += [(30_000 + k, " ".join([*long[:k], "changed", *long[k + 1 :]]), "near") for k in range(0, 1500, 100)]
    fps = [fingerprint(t) for _, t, _ in plain]
    comp = groups(fps)
    least = {}
    for (i, _, _), c in zip(plain, comp, strict=True):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    want = [(i, f"{f:016x}", least[c]) for (i, _, _), f, c in zip(plain, fps, comp, strict=True)]
    got = simhash.near_duplicates(table(spark, plain))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert len(set(least.values())) < len(set(fps)), "some distinct fingerprints link"
    assert simhash.near_duplicates(table(spark, plain).limit(0)).count() == 0


def test_simhash_of_long_texts():
    assert simhash.fingerprint("word " * 200_000) == fingerprint("word word word")
    r = random.Random(1)
    for n in (1, 2, 3, 4, 7, 300, 70_000):
        text = " ".join(r.choice(["Ab", "c", "ÉÀ", "zzz"]) + str(r.randrange(50)) for _ in range(n))
        assert simhash.fingerprint(text) == fingerprint(text)


def test_links_of_postings_small_and_large(spark):
    """Clusters around centres: chains, dense postings over FEW members, pairs whose bits differ in one byte and in two, pairs just too far."""
    r = random.Random(7)
    fps = {0, (1 << 64) - 1, 1 << 63, 3 << 62}
    for _ in range(40):
        c = r.getrandbits(64)
        fps |= {c ^ sum(1 << b for b in r.sample(range(64), k)) for k in (1, 2, 2, 3, 3, 4, 5)} | {c}
    dense = r.getrandbits(64)
    fps |= {dense ^ (r.getrandbits(8) << 8) ^ (r.getrandbits(8) << 40) for _ in range(400)}
    chain = r.getrandbits(64)
    for b in range(0, 64, 2):
        fps.add(chain := chain ^ (3 << b))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(5)
    edges = [(a, b) for a, b in simhash.links(df).collect()]
    at = {s: k for k, s in enumerate(signed)}
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        assert a != b
        x, y = root(at[a]), root(at[b])
        label[max(x, y)] = min(x, y)
    assert [root(k) for k in range(len(fps))] == groups(fps)
    assert len(edges) < 28 * len(fps)


def test_postings_go_on_over_batches():
    import pyarrow as pa

    members = np.arange(5000, dtype=np.int64) * 2  # bits 1 to 13: positions 0 and 1, number 0
    cols = [np.zeros(5000, np.int32), np.zeros(5000, np.int64), members]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[k : k + 700]) for c in cols], names=["number", "key", "fp"]) for k in range(0, 5000, 700)]
    out = list(simhash._postings(iter(batches)))
    assert sum(b.num_rows for b in out) == 4999 and {x for b in out for x in b.column(1).to_pylist()} == {0}


def duck(name, spark, tables):
    c = duckdb.connect()
    for t, df in tables.items():
        c.register(t, df.toArrow())
    r = c.execute(queries.ORACLES[name])
    return [x[0] for x in r.description], r.fetchall()


def compare(df, cols, want):
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_centroid_clustering"])
def test_queries_equal_sql(spark, name):
    tables = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "embeddings")}
    compare(queries.QUERIES[name](spark, SF), *duck(name, spark, tables))


def test_audit_of_odd_rows(spark, rows):
    docs = table(spark, rows)
    labels = spark.createDataFrame([(i, q, t, "x") for i, q, t in [(20_000, 0, 1), (20_000, 1, 0), (10_003, 1, 1), (10_004, None, None), (None, 1, 1), (10_013, 1, 0), (10_014, 0, 1)]], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.audit(filter_audit.flagged(docs), labels)
    compare(got, *duck("op12_filter_audit", spark, {"documents": docs, "labels": labels}))
    assert filter_audit.audit(filter_audit.flagged(docs.limit(0)), labels).count() == 0
    compare(filter_audit.audit(filter_audit.flagged(docs), labels.limit(0)), *duck("op12_filter_audit", spark, {"documents": docs, "labels": labels.limit(0)}))


def test_audit_by_brute_force(spark, rows):
    least, counts = {}, {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = "".join(k for k, f in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > least[t]), strict=True) if f)
        counts.setdefault(s or "", []).append(fails)
    want = []
    for part, all_fails in counts.items():
        removed = {}
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, x in enumerate(order):
                n = lambda f, k=k, order=order: sum(map(f, all_fails))
                gone = lambda f, k=k, order=order: any(y in f for y in order[:k])
                lost = n(lambda f, x=x: x in f and not gone(f))
                removed[x] = removed.get(x, 0) + lost
                want.append([part, order, k + 1, n(lambda f, x=x: x not in f and not gone(f)), lost, n(lambda f, x=x: x in f and gone(f)), n(lambda f, x=x: f == x), x])
        for row in want:
            if row[0] == part:
                row[7] = removed.get(row[7], row[7])
    got = filter_audit.audit(filter_audit.flagged(table(spark, rows)), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = [(r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in got.collect()]
    assert sorted(got) == sorted(map(tuple, want)) and len(got) == 600 * len(counts)


def test_repeated_rows_travel_once(spark):
    docs = table(spark, [(1, "the same row", "a")] * 500 + [(1, "the same row", "b"), (2, "x " * 80, "a")])
    flags = {(r.doc_id, r.part): (r.mask, r.rows) for r in filter_audit.flagged(docs).collect()}
    assert flags == {(1, "a"): (1, 500), (1, "b"): (1, 1), (2, "a"): (2, 1)}


def lloyd(vectors, k=8, rounds=10, dims=64):
    """Whole numbers of any size throughout."""
    kept = [(i, v) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    q = [[math.floor(int(x) * 1024) if abs(x) > 2**53 else math.floor(x * 1024) for x in v] for _, v in kept]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, hashlib.sha256(f"3:{kept[r][0]}".encode()).hexdigest() if kept[r][0] is not None else "", kept[r][1]))
    c = [q[r] for r in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for v in q]
        for j in range(len(c)):
            mine = [v for v, o in zip(q, of, strict=True) if o == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    found = [near(v) for v in q]
    cut = lambda x: min(x, (1 << 63) - 1)
    inertia = {j: cut(sum(cut(d) for d, o in found if o == j)) for j in range(len(c))}
    total = cut(sum(inertia[j] for j in {o for _, o in found}))
    return [(i, o, cut(d), inertia[o], total, hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for (i, _), (d, o) in zip(kept, found, strict=True)]


def clusters(spark, vectors):
    df = spark.createDataFrame([(i, v, 9, 1, "k") for i, v in vectors], "vec_id long, embedding array<double>, cluster int, v int, n string").repartition(3)
    return clustering.described(*clustering.cluster(df))


def test_clusters_equal_brute_force(spark):
    vectors = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    odd = [(None, vectors[0][1]), (None, vectors[1][1]), (1 << 60, vectors[2][1]), ((1 << 60) + 1, None), (-5, vectors[3][1][:63]), (-6, [*vectors[3][1][:63], None]), (-7, [*vectors[3][1][:63], math.nan]), (-8, [*vectors[3][1][:63], math.inf]), *[vectors[4]] * 30, (vectors[5][0], vectors[6][1])]
    got = clusters(spark, vectors + odd)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, lloyd(vectors + odd)))


def test_clusters_of_large_components_and_few_rows(spark):
    r = np.random.default_rng(2)
    huge = [(i, (r.standard_normal(64) * 10.0 ** (i % 300)).tolist()) for i in range(0, 600, 40)] + [(1000 + i, r.standard_normal(64).tolist()) for i in range(40)]
    for vectors in (huge, huge[:3], [(7, [1.0] * 64)] * 5, [(i, [float(i % 2)] * 64) for i in range(20)]):
        assert sorted(map(repr, map(tuple, clusters(spark, vectors).collect()))) == sorted(map(repr, lloyd(vectors)))
    assert clusters(spark, []).count() == 0 and clusters(spark, [(1, None)]).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
