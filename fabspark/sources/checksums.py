"""SHA-256 of files of any size, no file read whole by one task.

A digest is a chain over the bytes, so a large file is hashed part by part: each
job hashes the next part of every large file and hands the hash's state on, a
hundred bytes a file. The bytes come from Spark's text reader, which splits
files: lines end at ``\\n`` only, their bytes are kept as they are.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stream_folder

BOM = b"\xef\xbb\xbf"
# The text reader would decompress these.
PACKED = r"\.(gz|gzip|bz2|deflate|lz4|snappy|zst|xz|br)$"


# OpenSSL's SHA256_CTX, taken as it is: hashlib cannot hand a state on.
STATE_BYTES = 112


def _openssl():
    import _hashlib

    return ctypes.CDLL(_hashlib.__file__)


def first_state() -> bytes:
    state = ctypes.create_string_buffer(STATE_BYTES)
    _openssl().SHA256_Init(state)
    return state.raw


def next_state(state: bytes, data: bytes) -> bytes:
    kept = ctypes.create_string_buffer(state, STATE_BYTES)
    _openssl().SHA256_Update(kept, data, ctypes.c_size_t(len(data)))
    return kept.raw


def hexdigest(state: bytes) -> str:
    out = ctypes.create_string_buffer(32)
    _openssl().SHA256_Final(out, ctypes.create_string_buffer(state, STATE_BYTES))
    return out.raw.hex()


def can_resume() -> bool:
    """Whether this Python's OpenSSL lets a state be handed on, by a trial."""
    try:
        return hexdigest(next_state(next_state(first_state(), b"a" * 100), b"b" * 100)) == hashlib.sha256(b"a" * 100 + b"b" * 100).hexdigest()
    except (ImportError, AttributeError, OSError):
        return False


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the lines of a batch: (file, start, seq, bytes). Lines of a
    split arrive in order."""
    seq = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start, value = batch.column("file"), batch.column("start"), batch.column("value").cast(pa.large_binary())
        ends = pc.run_end_encode(file).run_ends.to_pylist(), pc.run_end_encode(start).run_ends.to_pylist()
        lo = 0
        for hi in sorted({*ends[0], *ends[1]}):
            # Every line, a line end, nothing: the last argument is the separator.
            joined = pc.binary_join_element_wise(value.slice(lo, hi - lo), pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
            data = joined.buffers()[2]
            size = pc.sum(pc.binary_length(joined)).as_py()
            yield pa.RecordBatch.from_arrays(
                [file.slice(lo, 1), start.slice(lo, 1), pa.array([seq], pa.int64()), pa.array([data.slice(0, size).to_pybytes()], pa.binary())],
                names=["file", "start", "seq", "bytes"],
            )
            seq, lo = seq + 1, hi


def _resumed(known: dict[int, tuple[bytes, int]], sizes: dict[int, int]):
    """Hashes a part of each file that reaches the task: (file, state, done)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, state, done = None, b"", 0

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([state], pa.binary()), pa.array([done], pa.int64())], names=["file", "state", "done"])

        for batch in batches:
            for f, data in zip(batch.column("file").to_pylist(), batch.column("bytes")):
                if f != file:
                    if file is not None:
                        yield result()
                    file, (state, done) = f, known[f]
                raw = data.as_buffer().to_pybytes()
                # The last line may have no line end.
                raw = raw[: sizes[f] - done]
                state = next_state(state, raw)
                done += len(raw)
        if file is not None:
            yield result()

    return run


def large_file_checksums(lines: DataFrame, files: list[tuple[str, str, int]], part_bytes: int) -> list[tuple[str, int, str]]:
    """(path, length, sha256) of files given by path, URI and length; ``lines``
    reads them. One row a large file is on the driver, at most a file per
    ``part_bytes`` of input."""
    spark = lines.sparkSession
    names = spark.createDataFrame([(i, uri) for i, (_, uri, _) in enumerate(files)], "file long, uri string")
    rows = lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("start"))
    rows = rows.join(F.broadcast(names), "uri").select("file", "start", "value")
    folder = stream_folder(spark, "checksums")
    pieces = rows.mapInArrow(_pieces, "file long, start long, seq long, bytes binary")
    pieces.withColumn("part", F.floor(F.col("start") / part_bytes).cast("int")).write.partitionBy("part").option("compression", "lz4").parquet(folder)
    kept = spark.read.schema("file long, start long, seq long, bytes binary, part int").parquet(folder)
    # Bytes read of a file fall short of its length where a mark at its start was skipped.
    held = {r["file"]: r["n"] for r in kept.groupBy("file").agg(F.sum(F.octet_length("bytes")).alias("n")).collect()}
    known: dict[int, tuple[bytes, int]] = {}
    for i, (path, _, length) in enumerate(files):
        # A last line without line end counts one byte more.
        missing = length - held.get(i, 0)
        if missing not in (len(BOM), len(BOM) - 1, 0, -1):
            raise RuntimeError(f"{path}: its lines do not make up its {length} bytes")
        known[i] = (next_state(first_state(), BOM), len(BOM)) if missing > 0 else (first_state(), 0)
    sizes = {i: length for i, (_, _, length) in enumerate(files)}
    for part in range(max(sizes.values()) // part_bytes + 1):
        due = [i for i, n in sizes.items() if n >= part * part_bytes]
        place = F.element_at(F.create_map(*[F.lit(v) for at, i in enumerate(due) for v in (i, at)]), F.col("file").cast("int"))
        step = kept.filter(F.col("part") == part).repartitionById(len(due), place).sortWithinPartitions("file", "start", "seq")
        for r in step.select("file", "bytes").mapInArrow(_resumed(known, sizes), "file long, state binary, done long").collect():
            known[r["file"]] = (bytes(r["state"]), r["done"])
    for i, (path, _, length) in enumerate(files):
        if known[i][1] != length:
            raise RuntimeError(f"{path}: {known[i][1]} of {length} bytes were hashed")
    return [(path, length, hexdigest(known[i][0])) for i, (path, _, length) in enumerate(files)]


def file_checksums(spark: SparkSession, path: str, glob: str = "*", part_bytes: int = 128 << 20) -> DataFrame:
    """(path, length, sha256) of every file below a folder. Files above
    ``part_bytes`` are hashed part by part (compressed ones whole, as their bytes
    cannot be split)."""
    reader = {"pathGlobFilter": glob, "recursiveFileLookup": True}
    files = spark.read.format("binaryFile").options(**reader).load(path)
    digest = F.sha2("content", 256).alias("sha256")
    # On the listing alone: files left out by it are not read.
    split = (F.col("_metadata.file_size") > part_bytes) & ~F.col("_metadata.file_name").rlike(PACKED)
    large = []
    if can_resume():
        large = [tuple(r) for r in files.filter(split).select("path", "_metadata.file_path", "length").orderBy("path").collect()]
    if not large:
        return files.select("path", "length", digest)
    lines = spark.read.options(lineSep="\n", **reader).text(path).filter(split)
    found = large_file_checksums(lines, large, part_bytes)
    return files.filter(~split).select("path", "length", digest).unionByName(spark.createDataFrame(found, "path string, length long, sha256 string"))
