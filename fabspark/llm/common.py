"""Helpers shared by the operators of this subpackage.

Row functions run on Arrow batches inside Spark tasks (``mapInArrow``). They
keep one batch at a time, so a task's memory does not grow with its partition.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, table

__all__ = ["col", "cut_lineage", "fresh", "map_batches", "pairs_schema", "slices", "sql_type", "table", "texts_of", "tokenizer"]

_SHIPPED: set[str] = set()


def map_batches(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose workers can import this package: it is handed to
    them once per application, wherever the driver found it."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        folder = tempfile.mkdtemp()  # served by the driver until it ends
        atexit.register(shutil.rmtree, folder, True)
        sc.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
        _SHIPPED.add(sc.applicationId)
    return df.mapInArrow(run, schema)


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def sql_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores in front until no column has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def pairs_schema(df: DataFrame, name: str, alias: str, rest: str) -> str:
    """Schema text with the type of an identifier column and further columns."""
    return f"`{alias}` {sql_type(df, name)}, {rest}"


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches cut to at most ``rows`` rows, so that Python objects of long
    texts are made for a few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, at: int) -> list[str]:
    """A text column as Python strings, null as empty."""
    return [x or "" for x in batch.column(at).to_pylist()]


_TOKENIZERS: dict[str, object] = {}


def tokenizer(name: str):
    """A public tokenizer by its file name, loaded once per Python worker."""
    if name not in _TOKENIZERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        _TOKENIZERS[name] = Tokenizer.from_file(public_tokenizers.path(name))
    return _TOKENIZERS[name]


