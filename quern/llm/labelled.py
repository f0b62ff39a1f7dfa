"""A bounded, deterministic sample of labelled documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(column: str, parts: int):
    """crc32 of an id as text, modulo parts."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def _ids(labels: DataFrame, label: str, parts: int, held: int) -> DataFrame:
    ids = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    return ids.filter(fold("doc_id", parts) != held)


def weights(labels: DataFrame, label: str, parts: int, held: int, most: tuple[int, int]) -> tuple[float, float]:
    """What a sampled document of labels 0 and 1 weighs, so that the classes have the shares of all labels outside the held-out fold; 1 on average."""
    got = {r[0]: r[1] for r in _ids(labels, label, parts, held).groupBy("label").count().collect()}
    every = [got.get(k, 0) for k in (0, 1)]
    kept = [min(n, m) for n, m in zip(every, most, strict=True)]
    zero, one = (n / k * sum(kept) / sum(every) if k else 1.0 for n, k in zip(every, kept, strict=True))
    return zero, one


def sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, most: tuple[int, int]) -> DataFrame:
    """(doc_id, text, label) of at most `most` documents labelled 0 and 1 outside the held-out fold, those whose ids hash lowest.

    Ids come from the labels alone, so only those documents' texts are moved. An id with several labels has the largest;
    a null label is none. At most sum(most) rows of ids and labels are broadcast.
    """
    ids = _ids(labels, label, parts, held)
    zero, one = (ids.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in enumerate(most))
    ids = zero.unionByName(one)
    return docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids), "doc_id")


def smallest(x: np.ndarray) -> bytes:
    """Numbers from 0 as bytes of 16 bits if all fit, else of 32."""
    return x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.uint32).tobytes()


def numbers(raw: memoryview, count: int) -> np.ndarray:
    """What smallest() wrote, of so many numbers; a view."""
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * count else np.uint32)


def _views(column: pa.ChunkedArray) -> list[memoryview]:
    """A binary column's values, without copies."""
    out: list[memoryview] = []
    for part in column.chunks:
        _, off, data = part.buffers()
        off = np.frombuffer(off, np.int32)[part.offset : part.offset + len(part) + 1].tolist()
        data = memoryview(data if data is not None else b"")
        out += [data[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
    return out


@contextmanager
def collected(rows: DataFrame) -> Iterator[list[tuple]]:
    """Rows of (doc_id, label, binary...) in the driver, as tuples of the label and views of the bytes, by id and then bytes. Their memory is given back at the end."""
    table = rows.toArrow()
    ids, labels = table.column(0).to_pylist(), table.column(1).to_pylist()
    views = [_views(table.column(k)) for k in range(2, table.num_columns)]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], *(zlib.crc32(v[i]) for v in views)))
    out = [(labels[i], *(v[i] for v in views)) for i in order]
    del views
    yield out
    out.clear()
    del table
    pa.default_memory_pool().release_unused()
