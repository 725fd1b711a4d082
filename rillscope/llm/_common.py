"""Helpers shared by the text operators: shared storage, blocks and words.

A *block* is a run of consecutive rows of one input task whose texts together
hold at most a fixed number of bytes (a longer single text is a block of its
own).  Operators that look something up for every word or n-gram first remove
repeats inside a block, send only the distinct keys of each block through a
shuffle, and send the answers back to the block.  So no key is sent more than
once per block however often it occurs, and a task holds one block or one key
shard at a time.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)
GOLD = np.uint64(0x9E3779B97F4A7C15)

_made: list[tuple[SparkSession, str]] = []
_paths: dict[int, tuple[DataFrame, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset in a
    local session (as in tests) a temporary folder is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='rillscope-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the driver exits."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            drop_scratch(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


def materialize(spark: SparkSession, df: DataFrame, tag: str, *parts: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts lineage: a lost executor costs no recomputation of what was
    written.  Shuffle files behind it are not needed any more; a collection in
    the driver lets Spark's cleaner remove them now rather than at some time.
    """
    path = scratch(spark, tag)
    schema = df.schema
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*parts) if parts else writer).parquet(path)
    del df, writer
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    _paths[id(out)] = (out, path)
    return out


def drop_part(df: DataFrame, part: str) -> None:
    """Delete one partition folder of a table of :func:`materialize` that is not read any more."""
    drop_scratch(df.sparkSession, f"{_paths[id(df)][1]}/{part}")


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` whose results have been written in turn."""
    kept, path = _paths.pop(id(df))
    drop_scratch(kept.sparkSession, path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it takes to be none of the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pin_splits(spark: SparkSession) -> None:
    """Have tables that are read again cut into the same input tasks, whatever executors have come or gone.

    Spark derives the size of splits from the cores that it sees when a scan is
    planned, unless the least number of them is set.
    """
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, to size the number of shards."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def shards_for(n_bytes: int, each: int, least: int = 8) -> int:
    """Number of key shards so that one holds what comes from ``each`` bytes of text."""
    return max(least, -(-n_bytes // each))


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut or join batches into blocks of at most ``most`` text bytes.

    Rows keep their order, so the blocks of a task are the same if it is run
    again over the same input.
    """
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            ends = np.cumsum(sizes[at:])
            fits = int(np.searchsorted(ends, most - size, side="right"))
            if fits == 0 and not held:
                fits = 1
            if fits:
                held.append(batch.slice(at, fits))
                size += int(ends[fits - 1])
                at += fits
            if at < batch.num_rows or size >= most:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    r"""Words (runs without ``[\x20\x09-\x0D]``) of an array of texts.

    Returns the codes of all words in order, the row boundaries (one more than
    there are texts) and the distinct words that the codes index.  A null text
    has no words.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    codes = np.asarray(coded.indices, dtype=np.int64)
    words = coded.dictionary
    blank = np.asarray(pc.equal(pc.binary_length(words), 0))
    if blank.any():  # leading and trailing white space leaves empty strings
        keep = ~blank[codes]
        ends = np.concatenate(([0], np.cumsum(keep)))
        offsets = ends[offsets]
        renumber = np.cumsum(~blank) - 1
        codes = renumber[codes[keep]]
        words = words.filter(pa.array(~blank))
    return codes, offsets, words


def hash_words(words: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of distinct words."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in words.cast(pa.large_binary()).to_pylist()), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(codes: np.ndarray, offsets: np.ndarray, word_hash: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words of each text, in order, and their boundaries.

    A text with some words but fewer than ``width`` has one window of all its
    words.
    """
    h = word_hash[codes]
    n = len(h)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out[: max(0, n - k)] = mix(out[: max(0, n - k)] + GOLD + h[k:])
    lengths = np.diff(offsets)
    counts = np.where(lengths >= width, lengths - width + 1, np.minimum(lengths, 1))
    for row in np.flatnonzero((lengths > 0) & (lengths < width)):
        acc = np.zeros(1, dtype=np.uint64)
        for x in h[offsets[row] : offsets[row + 1]]:
            acc = mix(acc + GOLD + x)
        out[offsets[row]] = acc[0]
    ends = np.concatenate(([0], np.cumsum(counts)))
    index = np.repeat(offsets[:-1] - ends[:-1], counts) + np.arange(ends[-1])
    return out[index], ends


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting takes a fraction of the time of the hash table that ``np.unique`` uses alone."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def pack(values: np.ndarray) -> bytes:
    """Compressed bytes of integers, stored byte plane by byte plane."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T)
    return pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, count: int, dtype: np.dtype | type) -> np.ndarray:
    """The integers that :func:`pack` packed."""
    dtype = np.dtype(dtype)
    raw = pa.decompress(data, decompressed_size=count * dtype.itemsize, codec="zstd", asbytes=True) if count else b""
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)
