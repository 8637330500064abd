"""Array views of Arrow text batches: words, lines and rolling hashes without per-word Python."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words are maximal runs of other bytes than these.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def release() -> None:
    """Give memory that this worker no longer uses back to the machine: workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20, binary: bool = False) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most ``most`` bytes of text each; a longer text stands alone. Null texts become empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        text = pc.fill_null(batch.column(at).cast(pa.large_binary() if binary else pa.large_string()), b"" if binary else "")
        batch = batch.set_column(at, column, text)
        size = np.cumsum(np.maximum(1, pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)))
        start = 0
        while start < len(size):
            end = max(start + 1, int(np.searchsorted(size, most + (size[start - 1] if start else 0), "right")))
            yield batch.slice(start, end - start)
            start = end
    release()


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts on end, and where each begins (one more entry than texts)."""
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(text) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary array over ``data`` cut at the offsets ``at``."""
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


class Words:
    """Words of a batch of texts.

    ``data``/``at``: bytes of the words on end and each word's offset; ``doc``: first word of each text
    (one more entry than texts); ``start``: byte of the text buffer where each word begins.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        keep = ~_SPACE[buf]
        first = keep.copy()
        first[1:] &= ~keep[:-1]
        heads = offsets[:-1][offsets[:-1] < len(buf)]
        first[heads] = keep[heads]
        self.start = np.flatnonzero(first)
        self.doc = np.searchsorted(self.start, offsets)
        total = np.cumsum(keep)
        self.data = buf[keep]
        self.at = np.append(total[self.start] - 1, len(self.data)) if len(self.start) else np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.start)

    def codes(self) -> tuple[np.ndarray, list[bytes]]:
        """Each word's index in the list of distinct words."""
        if not len(self):
            return np.zeros(0, np.int64), []
        coded = pieces(self.data, self.at).dictionary_encode()
        return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()

    def hashes(self, seed: int = 0) -> np.ndarray:
        codes, words = self.codes()
        return np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words], np.uint64)[codes] if words else np.zeros(0, np.uint64)


def emitter(ddl: str):
    """A function that makes record batches of exactly the given Spark columns from arrays, lists or numpy columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def emit(columns: dict) -> pa.RecordBatch:
        made = [columns[f.name].cast(f.type) if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema]
        return pa.RecordBatch.from_arrays(made, schema=schema)

    return emit


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive entries (len(h) - n + 1 of them; none when too few)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    base, out, have, parts = 0x9FB21C651E98DF25, None, 1, h
    done, rest = 0, n
    # square and multiply over run lengths
    while rest:
        if rest & 1:
            out = parts if out is None else out[: len(h) - done - have + 1] * np.uint64(pow(base, have, 1 << 64)) + parts[done : len(h) - have + 1]
            done += have
        rest >>= 1
        if rest:
            parts = parts[: len(h) - 2 * have + 1] * np.uint64(pow(base, have, 1 << 64)) + parts[have:]
            have *= 2
    return mix(out)


def per_doc(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def doc_of(at: np.ndarray) -> np.ndarray:
    """The text that each entry belongs to."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))
