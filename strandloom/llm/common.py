"""What the operators share: packaging, shared tables, Arrow helpers, hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from itertools import islice
from pathlib import Path
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKAGE = Path(__file__).resolve().parents[1]
#: Bytes of an Arrow batch, where the session keeps Spark's own default of 64 MB.
BATCH_BYTES = 4 << 20
#: Bytes that one Python worker may remember from batch to batch, in all.
MEMORY_BYTES = 64 << 20
_shipped: set[str] = set()
_tables: dict[str, SparkSession] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Ship this package to the executors once per application, and bound Arrow batches by bytes.

    Texts may be long, and Spark reads the bound from the session when a job runs, so it is
    set there: 4 MB a batch (or one longer row), unless the user has chosen a bound.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        folder = tempfile.mkdtemp()  # the driver serves the file from here
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        target = Path(folder) / f"{PACKAGE.name}_pkg.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(PACKAGE.rglob("*.py")):
                z.write(f, f"{PACKAGE.name}/{f.relative_to(PACKAGE)}")
        sc.addPyFile(str(target))
        _shipped.add(sc.applicationId)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "64MB").lower() in ("64mb", "67108864b", "67108864"):
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; one of our own only in a local session that sets none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strandloom-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
        atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/strandloom/{name}-{uuid.uuid4().hex}"
    _tables[path] = spark
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, on whatever file system they are."""
    for t in tables:
        if path := getattr(t, "_stored_at", None):
            _delete(path)


def _delete(path: str) -> None:
    if spark := _tables.pop(path, None):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    """What results still read lasts as long as the session."""
    for path in list(_tables):
        if _tables[path].sparkContext._jsc is not None:
            _delete(path)
        elif path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


class Memory:
    """What a worker has computed: a young and an old generation, bounded together by bytes.

    `young` may be read directly; put() costs an entry at its bytes and, when the young
    generation is full, makes it the old one and forgets the one before.
    """

    def __init__(self, most_bytes: int) -> None:
        self.most, self.size = most_bytes // 2, 0
        self.young: dict = {}
        self.old: dict = {}

    def put(self, key, value, n_bytes: int) -> None:
        if self.size + n_bytes > self.most:
            self.old, self.young, self.size = self.young, {}, 0
        self.young[key] = value
        self.size += n_bytes

    def put_all(self, items: dict[str, bytes]) -> None:
        """put() of texts and their values, a few thousand at a time."""
        pairs = iter(items.items())
        while some := dict(islice(pairs, 4096)):
            n_bytes = 70 * len(some) + sum(map(getsizeof, some)) + sum(map(getsizeof, some.values()))
            if self.size + n_bytes > self.most:
                self.old, self.young, self.size = self.young, {}, 0
            self.young |= some
            self.size += n_bytes

    def take(self, keys: set[str], found: dict[str, bytes]) -> set[str]:
        """Add what is known of the keys to found, and return the rest."""
        young, old = self.young, self.old
        found |= {k: young[k] for k in keys & young.keys()}
        keys = keys - young.keys()
        again = {k: old[k] for k in keys & old.keys()}
        found |= again
        self.put_all(again)
        return keys - again.keys()


def text_bytes(text: str) -> int:
    """About what a string costs as a key of a table, with its entry."""
    return 150 + (len(text) if text.isascii() else 4 * len(text))


_kept: dict = {}


def worker_keeps(key, make):
    """The object of this key in this Python worker; a worker keeps one, and frees it for the next."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and no other, so that extra columns cannot clash with ours."""
    return df.select(*[df[f"`{n}`"] for n in names])


def carried(df: DataFrame, *taken: str) -> Column:
    """A struct of all other columns, to go through an operator untouched (a flag where there are none)."""
    rest = [df[f"`{c}`"].alias(c) for c in df.columns if c not in taken]
    return F.struct(*(rest or [F.lit(True).alias("none")])).alias("rest")


def without_clash(df: DataFrame, *added: str) -> None:
    """Raise if df has a column, in any case of letters, that an operator is going to add."""
    if clash := sorted({c for c in df.columns if c.lower() in {a.lower() for a in added}}):
        raise ValueError(f"the table already has the columns {', '.join(clash)} that this operator adds; rename them first")


def ids(df: DataFrame, id_col: str) -> Column:
    """The id column as long; ids that are no integers are refused, as a cast would make nulls of them."""
    kind = df.schema[id_col].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{id_col} must be of an integer type, not {kind.simpleString()}")
    return df[f"`{id_col}`"].cast("long")


def restored(out: DataFrame, docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """docs' columns in their order, from i, t and rest, then more."""
    columns = [F.col("i").alias(c) if c == id_col else F.col("t").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns]
    return out.select(*columns, *more)


def sql_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as Python strings; a null counts as an empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def byte_view(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column in one array, and row offsets into it; nulls are empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_large_string(col.type):
        kind, width = np.int64, 8
    else:
        kind, width = np.int32, 4
    if col.null_count:
        col = pa.array(texts(batch, name), col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, kind, len(col) + 1, col.offset * width).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """The public 64-bit finaliser of MurmurHash3, vectorised."""
    x = x ^ (x >> _S)
    x = x * _M1
    x ^= x >> _S
    x = x * _M2
    return x ^ (x >> _S)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, base & (2**64 - 1)
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(step)
        step = step * step & (2**64 - 1)
        done += take
    return out


def connected(edges: DataFrame, a: str = "a", b: str = "b", name: str = "cc") -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges.

    Alternates large-star and small-star steps (Kiveris et al., 2014). Every step
    is a grouped minimum and a join, so a node with very many edges is combined
    before it is shuffled; each round is written to the shared folder.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = stored(e, name)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("x")).select("x.u", "x.v")
        small = stored(small.where("u <> v").distinct(), name)
        drop(e, large)
        # done when every node points at a node that points nowhere
        deep = small.groupBy("u").agg(F.countDistinct("v").alias("n")).where("n > 1").limit(1).count()
        if not deep and not small.join(small.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            out = small.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out._stored_at = small._stored_at
            return out
        e = small


def hashed(c: Column | str, seed: int = 0) -> Column:
    return F.xxhash64(F.lit(seed), c)


def blocks(batches: Iterable[pa.RecordBatch], most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Join small batches into blocks of about most_bytes, so that numpy has long arrays.

    A batch of more than twice that size is split, down to single rows.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        for part in _halves(b, 2 * most_bytes):
            held.append(part)
            size += part.nbytes
            if size >= most_bytes:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def small(batches: Iterable[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many bytes, down to single rows."""
    for b in batches:
        yield from _halves(b, most_bytes)


def _halves(b: pa.RecordBatch, most_bytes: int) -> Iterator[pa.RecordBatch]:
    if b.num_rows > 1 and b.nbytes > most_bytes:
        half = b.num_rows // 2
        yield from _halves(b.slice(0, half), most_bytes)
        yield from _halves(b.slice(half), most_bytes)
    elif b.num_rows:
        yield b


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(held) == 1:
        return held[0]
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]
