"""What the operators share: shipping the package to workers, the shared folder, and scans of text columns in Arrow batches.

Words everywhere are maximal runs of characters other than space, tab, LF, VT, FF and CR: ``bytes.split()`` splits just so.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.package import ship

WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that a batch sent to a Python worker holds at most (a longer single text makes its own batch).
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Ship this package to the executors once a session, bound Arrow batches by bytes, and see to a checkpoint folder."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    shared_dir(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where that is unset on one machine (tests) a temporary folder is made; a cluster must name one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="touchline-shared-")
        atexit.register(shutil.rmtree, found, True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/touchline-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, whatever file system holds it."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session is gone; the folder's owner cleans up
        pass


def release(spark: SparkSession) -> None:
    """Let the driver's JVM notice which shuffles and checkpoints nothing refers to any more, so that Spark deletes their files now rather than at the end."""
    gc.collect()
    spark._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until no column of df is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def column(name: str) -> Column:
    """The column of just this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Rows up to which a join's small side (narrow rows) is broadcast; more are shuffled.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has BROADCAST_ROWS rows at most. It is counted, so it should be cheap to read."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def scan(docs: DataFrame, columns: list[str], schema: str, batch: Callable[..., dict]) -> DataFrame:
    """mapInArrow over the named columns alone. ``batch`` gets one Python list a column (null texts stay None) and returns one sequence a result column.

    Other columns are dropped before the worker, so clashing extra names don't matter. Empty tables give empty results.
    """
    prepare(docs.sparkSession)
    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(Task(_Scan(batch, schema), batch.__module__), schema)


#: What a worker does to drop an operator's caches, by the operator's module; and the module whose task the worker ran last.
_forget: dict[str, Callable[[], None]] = {}
_last = ""
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # a C library that has no such call
    _trim = None


def caches(module: str, forget: Callable[[], None]) -> None:
    """Say how a module's caches are dropped. Spark uses workers again, so one operator's caches would else lie in memory while the next one runs."""
    _forget[module] = forget


def enter(module: str) -> None:
    """Called in a worker as a task begins: caches of other modules go. Tasks without texts have no module, and drop all."""
    global _last
    if module != _last:
        _last = module
        _hashes.clear()
        for name, forget in _forget.items():
            if name != module:
                forget()


def leave() -> None:
    """Called in a worker as a task ends: unused memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


class Task:
    """A mapInArrow function of a module, between enter and leave."""

    def __init__(self, f: Callable, module: str):
        self.f, self.module = f, module

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(self.module)
        try:
            yield from self.f(batches)
        finally:
            leave()


class _Scan:
    def __init__(self, batch, schema: str):
        self.batch, self.types = batch, [_TYPES[x.split()[1]] for x in schema.split(", ")]
        self.names = [x.split()[0] for x in schema.split(", ")]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = self.batch(*[c.to_pylist() for c in b.columns])
                yield pa.RecordBatch.from_arrays([pa.array(found[n], t) for n, t in zip(self.names, self.types, strict=True)], names=self.names)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}


class HashCache(dict):
    """Word (bytes) to 64-bit hash; forgets all when full, so a worker's memory stays bounded."""

    FULL = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.FULL:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_hashes = HashCache()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def lower_words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased (other letters stay), as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


#: Odd multipliers, one a place in an n-gram.
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit sways every output bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams of a sequence of (well-mixed) hashes, in order; empty if it is shorter than n."""
    m = len(h) - n + 1
    if m < 1:
        return np.empty(0, np.uint64)
    out = h[:m] * _ODD[0]
    for i in range(1, n):
        out += h[i : m + i] * _ODD[i]
    return mix(out)


def by_group(f: Callable, keyed: bool = False, module: str = "") -> Callable:
    """f as the bare function that applyInArrow wants. Without a module, all caches go beforehand."""

    def one(table):
        enter(module)
        try:
            return f(table)
        finally:
            leave()

    def two(key, table):
        enter(module)
        try:
            return f(key, table)
        finally:
            leave()

    return two if keyed else one
