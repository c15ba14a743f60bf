"""Helpers shared by the training-data operators: shared storage and table access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace that separates words everywhere in this package.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a task works on at a time; its arrays take some thirty times as much.
SLICE = 1 << 19

_own_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a temporary folder serves, which only a local master can share; a cluster
    without the setting is refused.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="terseframe-"))
    return _own_dir[0]


#: Folders made inside the innermost open :func:`scratch` block.
_made: list[list[str]] = []


def fresh_dir(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared storage, by the file system that Spark wrote them with."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession):
    """Folders made inside are deleted at the end; what is to stay is made after the block or given to the list it yields."""
    stay: list[str] = []
    _made.append([])
    try:
        yield stay
    finally:
        made = _made.pop()
        remove(spark, *[p for p in made if p not in stay])
        if _made:  # an outer block deletes what stayed
            _made[-1].extend(p for p in made if p in stay)


def unused(name: str, *tables: DataFrame) -> str:
    """``name`` with as many underscores before it as no column of ``tables`` needs, whatever its case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def materialise(df: DataFrame, name: str, stay: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage; ``stay`` is the list of a :func:`scratch` block.

    The files outlive any executor; a lost one costs at most its running tasks.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    if stay is not None:
        stay.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the folder of a table that :func:`materialise` wrote and that nothing reads any more."""
    remove(df.sparkSession, *{f.rsplit("/", 1)[0] for f in df.inputFiles()})


def split_uri(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow file system and path of ``uri``; a bare path is local."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return pafs.FileSystem.from_uri(uri)


def write_bytes(uri: str, data) -> None:
    """Put ``data`` at ``uri`` by way of a temporary name, so that readers see whole files only."""
    store, path = split_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def read_bytes(uri: str) -> bytes:
    store, path = split_uri(uri)
    with store.open_input_file(path) as f:
        return f.read()


def bounded_broadcast(df: DataFrame, most: int) -> DataFrame:
    """Hint a broadcast of ``df`` if it has at most ``most`` rows; else leave it to a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each slice has about ``most`` bytes of ``column``; one row is never cut."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        col = batch.column(at)
        if col.null_count:
            col = col.fill_null("")
            batch = batch.set_column(at, batch.schema.field(at).name, col)
        n, start, size = len(col), 0, 0
        if n == 0:
            continue
        lengths = pc.binary_length(col).to_numpy(zero_copy_only=False)
        for i in range(n):
            if size and size + lengths[i] > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(lengths[i])
        yield batch.slice(start, n - start)


#: Bits of a key filter for each key, hashes of a key, and the bounds of a filter's size in bits (8 MB at most).
FILTER_PER_KEY, FILTER_HASHES, FILTER_BITS = 16, 4, (1 << 20, 1 << 26)


def _filter_places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    h = keys.view(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(FILTER_HASHES):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(k)
            yield (h >> np.uint64(32)) & np.uint64(bits - 1)


@lru_cache(2)
def _filter_bits(path: str) -> np.ndarray:
    return np.frombuffer(read_bytes(path), np.uint8)


def key_filter(keys: DataFrame, n: int):
    """A function that gives, for a column of 64-bit keys, whether each may be among the ``n`` rows of ``keys`` (key).

    A Bloom filter of bounded size in a file of the shared folder: it never misses a key, so it may stand
    before a join; when a table has too many keys for it, it lets more rows through, and the join decides.
    """
    bits = FILTER_BITS[0]
    while bits < min(FILTER_BITS[1], FILTER_PER_KEY * n):
        bits *= 2
    shards = 64

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for b in batches:
            for at in _filter_places(b.column(0).to_numpy(), bits):
                own[at.astype(np.int64)] = True
        if own.any():
            raw = np.packbits(own).reshape(shards, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(shards), pa.int32()), pa.array([pa.compress(r.tobytes(), "zstd", asbytes=True) for r in raw], pa.binary())], names=["shard", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for s, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(pa.decompress(blob, bits // 8 // shards, "zstd", asbytes=True), np.uint8)
                held[s] = held[s] | part if s in held else part
        for s, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["shard", "bits"])

    spark = keys.sparkSession
    made = keys.mapInArrow(mark, "shard int, bits binary").repartition(shards, "shard").mapInArrow(join, "shard int, bits binary").collect()
    whole = np.zeros((shards, bits // 8 // shards), np.uint8)
    for r in made:  # one row a shard, of a fixed size
        whole[r["shard"]] = np.frombuffer(r["bits"], np.uint8)
    path = f"{fresh_dir(spark, 'key-filter')}/bits"
    write_bytes(path, whole.tobytes())

    @F.arrow_udf("boolean")
    def may_be(key: pa.Array) -> pa.Array:
        data, found = _filter_bits(path), np.ones(len(key), bool)
        for at in _filter_places(key.to_numpy(zero_copy_only=False), bits):
            found &= (data[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1
        return pa.array(found)

    return may_be


def held_out(doc_id, folds: int = 5):
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings for the time of a block (names with dots given as keyword dict)."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
