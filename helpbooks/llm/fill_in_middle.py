"""Fill-in-the-middle texts, cut between units by a sparse checkpoint index.

A text's units (lines, words with the white space after them, or code points) are
counted in one pass over its bytes, block by block. The pass keeps the byte and
the code-point offset of every ``every``-th unit alone. A cut after u units is then
the last checkpoint at or before u, found by binary search, and a scan from there
over fewer than ``every`` units.

Two draws from the hash of a document's id say where the middle begins and ends,
further ones whether the text is changed at all and in which order its parts
come: ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle), each
part after its mark. Empty texts and those that hold a mark stay ``plain``.
``restored`` gives the text back from output and form alone.

A null text is empty; a null id draws as one of no digits. Texts are taken whole
however long they or their units are; equal rows give equal results; an
empty table gives no rows; only the two columns named are read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .textarrays import SPACE

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
SEED, RATE, SPM = 7, 100, 50
EVERY, BLOCK_BYTES = 64, 1 << 20
UNITS = ("line", "word", "char")


def _inside(block: np.ndarray) -> np.ndarray:
    """Where a byte is not the first of its code point."""
    return (block & 0xC0) == 0x80


def _starts(unit: str, block: np.ndarray, before: int) -> np.ndarray:
    """Offsets in a block where a unit starts; ``before`` is the byte in front of it, -1 at the start of a text."""
    if unit == "char":
        return np.flatnonzero(~_inside(block))
    if unit == "line":
        starts = np.flatnonzero(block[:-1] == 10) + 1
        return np.concatenate([[0], starts]) if before in (-1, 10) else starts
    space = SPACE[block]
    left = np.concatenate([[before < 0 or bool(SPACE[before])], space[:-1]])
    starts = np.flatnonzero(left & ~space)
    return np.concatenate([[0], starts]) if before < 0 and space[0] else starts


class Checkpoints:
    """The units of a text: their number, and the offsets of every ``every``-th."""

    def __init__(self, text: bytes, unit: str = "line", every: int = EVERY, block_bytes: int = BLOCK_BYTES):
        if unit not in UNITS:
            raise ValueError(f"unit must be one of {UNITS}")
        self.data, self.unit, self.every = np.frombuffer(text, dtype=np.uint8), unit, every
        self.n, self.chars = 0, 0
        self.units: list[int] = []
        self.bytes_at: list[int] = []
        self.chars_at: list[int] = []
        before = -1
        for at in range(0, len(self.data), block_bytes):
            block = self.data[at : at + block_bytes]
            inside = _inside(block)
            plain = not inside.any()
            starts = _starts(unit, block, before)
            kept = starts[-self.n % every :: every]
            self.units += range(self.n + -self.n % every, self.n + len(starts), every)
            self.bytes_at += (kept + at).tolist()
            self.chars_at += (self.chars + (kept if plain else kept - np.concatenate([[0], np.cumsum(inside)])[kept])).tolist()
            self.n += len(starts)
            self.chars += len(block) - int(inside.sum())
            before = int(block[-1])

    def cut(self, u: int) -> tuple[int, int]:
        """(bytes, code points) before unit ``u``; the whole text's for the number of units."""
        if u >= self.n:
            return len(self.data), self.chars
        k = bisect_right(self.units, u) - 1
        begin, end = self.bytes_at[k], self.bytes_at[k + 1] if k + 1 < len(self.bytes_at) else len(self.data)
        if u == self.units[k]:
            return begin, self.chars_at[k]
        window = self.data[begin:end]
        to = int(_starts(self.unit, window, int(self.data[begin - 1]) if begin else -1)[u - self.units[k]])
        return begin + to, self.chars_at[k] + to - int(_inside(window[:to]).sum())


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from an id."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[8 * k : 8 * k + 8], 16) for k in range(4))


def transformed(doc_id: int | None, text: bytes, unit: str = "line", rate: int = RATE, spm: int = SPM, seed: int = SEED, every: int = EVERY) -> tuple[int, str, bytes, int | None, int | None]:
    """(units, form, output, code points of prefix and middle)."""
    index = Checkpoints(text, unit, every)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in MARKS) or h3 % 100 >= rate:
        return index.n, "plain", text, None, None
    a, b = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    (i, before), (j, upto) = index.cut(a), index.cut(b)
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if h4 % 100 < spm:
        return index.n, "spm", SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle, before, upto - before
    return index.n, "psm", PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle, before, upto - before


SCHEMA = "doc_id long, n long, form string, output string, prefix_chars long, middle_chars long"


def transform(docs: DataFrame, unit: str = "line", rate: int = RATE, spm: int = SPM, seed: int = SEED, every: int = EVERY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document; columns as in ``SCHEMA``. ``rate`` and ``spm`` are per cent. No shuffle."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = [transformed(i, t, unit, rate, spm, seed, every) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            cols[2] = cols[2].cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), common.text_bytes(text).alias("text")).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form stand for; no part of it holds a mark, so marks split it."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def digest(out: DataFrame) -> DataFrame:
    """A row per document of ``transform``, with hashes of the output and of the text that is rebuilt from it."""
    again = F.sha2(restored(F.col("output"), F.col("form")), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), again.alias("restored_sha256"))
