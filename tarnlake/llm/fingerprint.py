"""Document fingerprints from closed syncmers.

A run of ANCHOR characters is an anchor if the smallest hash among its runs of INNER characters is the first or the last
one. That depends on these characters alone, so an edit moves no anchor outside its reach. A fingerprint holds every
anchor of the whole text, with its position: it grows with the text, and texts of all lengths have the same anchors. Two
fingerprints are compared by position: the k-th occurrence of a hash in one meets the k-th in the other, and of these
matches the longest run whose positions rise in both counts. The likeness is 2 L / (a + b), L matches of a and b anchors,
about the share of text in common.

Defined results: a null text is empty; an empty text's fingerprint has no anchors, and two empty ones have likeness 1,
one empty one 0. A text without an anchor (most often one shorter than ANCHOR) has its own hash as the only one. Equal
texts have equal fingerprints. In the descending order of doc_id, null ids come last and rows of one id go by text. An
only row is its own next. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import partitions, strings, with_columns

#: Characters of an anchor and of the runs within. One in (ANCHOR - INNER + 1) / 2 runs is an anchor.
INNER, ANCHOR = 4, 12
CHUNK = 1 << 20
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
Sketch = tuple[np.ndarray, np.ndarray, int]  #: 32-bit hashes in the text's order, their positions, the text's code points


def twice(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of runs of 2 * size from those of runs of size."""
    x = h[:-size] * A + h[size:] * B
    x ^= x >> np.uint64(29)
    x *= A
    x ^= x >> np.uint64(32)
    return x


def sketches(texts: list[str], inner: int = INNER, whole: int = ANCHOR) -> list[Sketch]:
    sizes = np.array([len(t) for t in texts], np.int64)
    off = np.concatenate([[0], np.cumsum(sizes)])
    at, code = anchors("".join(texts), inner, whole)
    doc = np.searchsorted(off, at, side="right") - 1
    inside = at + whole <= off[doc + 1]
    at, code = at[inside], code[inside]
    cut = np.searchsorted(at, off)
    out = []
    for d, t in enumerate(texts):
        a, b = cut[d], cut[d + 1]
        if a == b and t:
            out.append((np.array([xxhash.xxh64_intdigest(t) >> 32], np.uint32), np.zeros(1, np.int64), len(t)))
        else:
            out.append((code[a:b], at[a:b] - off[d], len(t)))
    return out


def anchors(joined: str, inner: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """Where anchors begin in the text, and their hashes."""
    h = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    if len(h) < whole:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    size = 1
    while size < inner:
        h, size = twice(h, size), 2 * size
    span, low = whole - inner, h
    step = 1
    while step * 2 <= span + 1:
        low, step = np.minimum(low[:-step], low[step:]), step * 2
    rest = span + 1 - step
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    at = np.flatnonzero((h[: len(low)] == low) | (h[span : span + len(low)] == low))
    code = np.zeros(len(at), np.uint64)
    for k in range(0, whole, inner):
        code = (code ^ h[at + k]) * A
        code ^= code >> np.uint64(31)
    return at, (code * B >> np.uint64(32)).astype(np.uint32)


def packed(numbers: np.ndarray) -> bytes:
    """Seven bits a byte, the last byte of a number without its top bit."""
    width = 1 + sum((numbers >> 7 * k > 0).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(width)
    place = np.arange(ends[-1]) - np.repeat(ends - width, width)
    more = np.repeat(width, width) - 1 > place
    return ((np.repeat(numbers, width) >> 7 * place & 127) | more * 128).astype(np.uint8).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8).astype(np.int64)
    heads = np.concatenate([[0], np.flatnonzero(x < 128) + 1])
    place = np.arange(len(x)) - np.repeat(heads[:-1], np.diff(heads))
    return np.add.reduceat((x & 127) << 7 * place, heads[:-1])


def shown(s: Sketch) -> str:
    """The fingerprint as a string: the text's length, then in base64 the anchors' hashes, then the steps between their positions."""
    if not len(s[0]):
        return f"{s[2]}"
    steps = packed(np.diff(s[1], prepend=0))
    return f"{s[2]}:{base64.b64encode(s[0].astype('<u4').tobytes()).decode()}:{base64.b64encode(steps).decode()}"


def read(fingerprint: str) -> Sketch:
    size, _, rest = fingerprint.partition(":")
    if not rest:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), int(size)
    hashes, steps = (base64.b64decode(x) for x in rest.split(":"))
    return np.frombuffer(hashes, "<u4"), np.cumsum(unpacked(steps)), int(size)


def numbered(hashes: np.ndarray) -> np.ndarray:
    """Each hash with the number of its occurrences before it."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    out = np.empty(len(h), np.uint64)
    out[order] = h.astype(np.uint64) << np.uint64(32) | (np.arange(len(h)) - np.repeat(heads, np.diff(np.append(heads, len(h))))).astype(np.uint64)
    return out


def longest_rise(places: np.ndarray) -> int:
    """The length of the longest strictly rising subsequence."""
    if (np.diff(places) > 0).all():
        return len(places)
    rising: list[int] = []
    for p in places.tolist():
        k = bisect_left(rising, p)
        if k == len(rising):
            rising.append(p)
        else:
            rising[k] = p
    return len(rising)


def likeness(x: Sketch, y: Sketch) -> float:
    """From 0 to 1; 1 for equal fingerprints."""
    if not len(x[0]) or not len(y[0]):
        return float(len(x[0]) == len(y[0]))
    both, i, j = np.intersect1d(numbered(x[0]), numbered(y[0]), assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    return 2 * longest_rise(y[1][j][np.argsort(x[1][i], kind="stable")]) / (len(x[0]) + len(y[0]))


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """df with the fingerprint of each whole text."""

    @F.arrow_udf("string")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([shown(s) for part in chunks(strings(col)) for s in sketches(part)], pa.string())

    return df.withColumn(out, run(F.col(text)))


def chunks(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, helper) in partitions that are ranges of descending doc_id and sorted; each ends with a helper, a copy of the first row of the next range (after the last, of the first). Only a column of ids is read to find the ranges, and a few numbers for each range come to the driver."""
    n = partitions(docs.sparkSession)
    bounds = np.array(sorted(set(docs.select("doc_id").where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else [], np.float64)

    @F.arrow_udf("int")
    def place(ids: pa.Array) -> pa.Array:
        x = ids.to_numpy(zero_copy_only=False).astype(np.float64)
        return pa.array(np.where(np.isnan(x), len(bounds) + 1, len(bounds) - np.searchsorted(bounds, x)).astype(np.int32))

    placed = docs.withColumn("at", place("doc_id"))
    tops = sorted((r["at"], r["top"]) for r in placed.groupBy("at").agg(F.max("doc_id").alias("top")).collect())
    before = {top: tops[i - 1][0] for i, (_, top) in enumerate(tops)}

    @F.arrow_udf("array<int>")
    def places(ids: pa.Array, at: pa.Array) -> pa.Array:
        return pa.array([[a] + ([-1 - before[i]] if i in before else []) for i, a in zip(ids.to_pylist(), at.to_pylist(), strict=True)], pa.list_(pa.int32()))

    spread = placed.withColumn("code", F.explode(places("doc_id", "at")))
    spread = spread.select("doc_id", "text", (F.col("code") < 0).alias("helper"), F.when(F.col("code") < 0, -1 - F.col("code")).otherwise(F.col("code")).alias("at"))
    return spread.repartitionById(len(bounds) + 2, F.col("at")).sortWithinPartitions(F.asc("helper"), F.desc_nulls_last("doc_id"), F.asc("text")).select("doc_id", "text", "helper")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text (the last third of the characters replaced by the first ones of the next document), and the likeness of its own to the edited and to the next one's."""
    docs = with_columns(docs, doc_id="bigint", text="string").select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []

        def done() -> pa.RecordBatch:
            """All rows but the last, which is the next one's text."""
            n = len(ids) - 1
            edited = []
            for t, after in zip(texts, texts[1:], strict=False):
                k = len(t) // 3
                edited.append(t[: len(t) - k] + after[:k])
            own, changed = sketches(texts), sketches(edited)
            cols = [ids[:n], [s[2] for s in own[:n]], [hashlib.sha256(t.encode()).hexdigest() for t in edited], [shown(s) for s in own[:n]], [shown(s) for s in changed], [likeness(a, b) for a, b in zip(own, changed, strict=False)], [likeness(a, b) for a, b in zip(own[:n], own[1:], strict=True)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, OUT.types, strict=True)], schema=OUT)

        size, over = 0, False
        for b in batches:
            for i, t, helper in zip(b.column("doc_id"), b.column("text"), b.column("helper"), strict=True):
                if over:
                    break
                over = helper.as_py()
                ids.append(i.as_py())
                texts.append(t.as_py())
                size += len(texts[-1])
                if size >= CHUNK and len(ids) > 1:
                    yield done()
                    del ids[:-1], texts[:-1]
                    size = 0
        if len(ids) > 1:
            yield done()

    return with_next(docs).mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
