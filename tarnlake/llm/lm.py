"""LM scoring by a hierarchical Pitman-Yor model over word pairs.

The root restaurant serves words; below it stands one restaurant for each of RESTAURANTS hashes of the word before,
which all share the root as their parent: a table of theirs is a customer of the root. How many tables serve a dish is
sampled by Gibbs sweeps, a dish of a restaurant at a time given all others: with up to EXACT customers from its exact
conditional by generalised Stirling numbers; of more, the first EXACT so and the rest one table after another, in TRIALS
trials of which one is taken by importance weights, so that the draw nears the same conditional (the README has figures). Within a sweep restaurants and root see the totals of the sweep before. Discounts come
from counts of ones and twos, concentrations are sampled given the tables. A token's probability is the mean over the kept
samples; a text's score sums its tokens' logarithms.

Spark moves compact arrays. Each task packs the distinct (word, restaurant, document) of about CHUNK bytes of text by
bucket; a bucket holds whole words, so that a word's counts, tables and root customers meet there, and gets its part of
the model and its tokens in one exchange. Words that would fill a good part of a bucket by themselves are spread over all
buckets by restaurant, and their few sums travel with the totals; which words these are is told from a sample of rows
and changes no count. What the driver holds is one number for each restaurant and spread word.

Defined results: a null text is empty and still has its end token. Rows are scored one by one and learned each, so
repeated rows count as often as they stand; a null id is learned from or not by the crc32 of an empty text. Without
training rows every probability is one. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import discard, partitions, pieces, remainder, store, utf8, with_columns
from tarnlake.llm.words import mix, words

ROOM_BITS = 20
RESTAURANTS = 1 << ROOM_BITS
SWEEPS, KEPT = 4, 2
#: Customers of a dish up to which its tables have their exact conditional.
EXACT = 512
#: Trials of which one is chosen for a dish of more.
TRIALS = 32
CHUNK = 4 << 20
#: Bytes of training text for each bucket, at least; there are no fewer buckets than shuffle partitions.
BUCKET = 256 << 20
#: Rows read to find the words that are spread, and the share of a bucket from which a word is.
SAMPLE_ROWS, SPREAD = 20_000, 0.3
END, BEGIN = np.uint64(0x452821E638D01377), np.uint64(0xBE5466CF34E90C6C)


def pack(*arrays: np.ndarray) -> bytes:
    head = ";".join(f"{a.dtype.str}:{len(a)}" for a in arrays).encode()
    return zstandard.compress(len(head).to_bytes(4, "little") + head + b"".join(a.tobytes() for a in arrays), 3)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    out, at = [], 4 + n
    for x in raw[4 : 4 + n].decode().split(";"):
        kind, size = x.split(":")
        out.append(np.frombuffer(raw, np.dtype(kind), int(size), at))
        at += out[-1].nbytes
    return out


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's words and end token: their hashes, their restaurants, and the number of their text."""
    w = words(data, off)
    n = len(off) - 1
    size = np.diff(w.offsets)
    word = np.empty(len(w.hashes) + n, np.uint64)
    ends = w.offsets[1:] + np.arange(n)
    inner = np.ones(len(word), bool)
    inner[ends] = False
    word[inner], word[ends] = w.hashes, END
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[0 if not n else np.concatenate([[0], ends[:-1] + 1])] = BEGIN
    return word, (mix(before) % np.uint64(RESTAURANTS)).astype(np.int64), np.repeat(np.arange(n), size + 1)


def bucket_of(word: np.ndarray, room: np.ndarray, spread: np.ndarray, n: int) -> np.ndarray:
    """spread: the hashes, in order, of words that go by restaurant too."""
    h = mix(word ^ np.uint64(0x3C6EF372FE94F82B))
    if len(spread):
        at = np.minimum(np.searchsorted(spread, word), len(spread) - 1)
        h = np.where(spread[at] == word, mix(h + room.astype(np.uint64)), h)
    return (h % np.uint64(n)).astype(np.int64)


def grouped(word: np.ndarray, room: np.ndarray, doc: np.ndarray, spread: np.ndarray, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """By bucket: distinct words, their number of entries, and of each entry the restaurant, document and occurrences; entries go by word hash, restaurant, document."""
    distinct, number = np.unique(word, return_inverse=True)
    bucket = bucket_of(word, room, spread, n)
    widths = [max(1, int(x).bit_length()) for x in (len(distinct) - 1, RESTAURANTS - 1, doc.max(), n - 1)]
    if sum(widths) <= 64:  # one number for each token sorts fastest
        key = bucket.astype(np.uint64)
        for x, bits in ((number, widths[0]), (room, widths[1]), (doc, widths[2])):
            key = key << np.uint64(bits) | x.astype(np.uint64)
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        times = np.diff(np.append(first, len(key)))
        key = key[first]
        doc = key & np.uint64((1 << widths[2]) - 1)
        key >>= np.uint64(widths[2])
        room = key & np.uint64((1 << widths[1]) - 1)
        key >>= np.uint64(widths[1])
        number, bucket = key & np.uint64((1 << widths[0]) - 1), key >> np.uint64(widths[0])
    else:
        order = np.lexsort((doc, room, number, bucket))
        columns = [x[order] for x in (bucket, number, room, doc)]
        first = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in columns], 0)]))
        times = np.diff(np.append(first, len(order)))
        bucket, number, room, doc = (x[first] for x in columns)
    doc, room, number, bucket = doc.astype(np.uint32), room.astype(np.uint32), number.astype(np.int64), bucket.astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        heads = np.flatnonzero(np.concatenate([[True], number[a + 1 : b] != number[a : b - 1]]))
        yield int(bucket[a]), [distinct[number[a:b][heads]], np.diff(np.append(heads, b - a)).astype(np.uint32), room[a:b], doc[a:b], times[a:b].astype(np.uint32)]


def chunks(parts: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """Texts as bytes and offsets, with their batch rows: (data, off, [doc_id, held_out])."""
    for b in parts:
        data, off = utf8(b.column("text"))
        for x, y in pieces(off, limit):
            yield data[off[x] : off[y]], off[x : y + 1] - off[x], b.slice(x, y - x)


# --- seating


@dataclass
class Totals:
    """Sums over all buckets: of each restaurant the customers and tables, of each spread word the root's customers."""

    customers: np.ndarray
    tables: np.ndarray
    spread_counts: np.ndarray  #: training tokens
    spread_root: np.ndarray  #: root customers
    spread_tables: np.ndarray  #: root tables
    tokens: int = 0
    words: int = 0
    root_customers: float = 0.0
    root_tables: float = 0.0
    discount: float = 0.5
    strength: float = 1.0
    root_discount: float = 0.5
    root_strength: float = 1.0

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The root's probability of words with so many customers at so many tables."""
        new = self.root_strength + self.root_discount * self.root_tables
        return (customers - self.root_discount * tables + new / (self.words + 1)) / (self.root_strength + self.root_customers)


def dense(x: object) -> bytes:
    """Totals in few bytes, since most restaurants have few customers: each broadcast lies on every machine's disk."""
    return zstandard.compress(pickle.dumps(x), 3)


def undense(raw: bytes) -> Any:
    return pickle.loads(zstandard.decompress(raw))


def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of generalised Stirling numbers S(c, t) up to most."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0
    for c in range(1, most + 1):
        stay = np.log(np.maximum(c - 1 - discount * np.arange(1, most + 1), 1e-300)) + out[c - 1, 1:]
        stay[c - 1 :] = -np.inf
        out[c, 1:] = np.logaddexp(out[c - 1, :-1], stay)
    return out


def seat(customers: np.ndarray, base: np.ndarray, others: np.ndarray, strength: float, discount: float, stirling: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish given its customers, its base probability and the restaurant's tables of other dishes."""
    out = np.ones(len(customers), np.int64)
    most = len(stirling) - 1

    def draw(c: int, rows: np.ndarray, tilt: np.ndarray | None = None) -> np.ndarray:
        """From the exact conditional of c customers; with tilt, times exp(tilt) for each table."""
        parts, step = [], max(1, 1_000_000 // c)
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            steps = np.log(strength + discount * (others[part][:, None] + np.arange(c))) + np.log(base[part])[:, None]
            if tilt is not None:
                steps += tilt[a : a + step][:, None]
            weight = stirling[c, 1 : c + 1] + np.cumsum(steps, 1)
            total = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
            parts.append(1 + (total < (rng.random(len(part)) * total[:, -1])[:, None]).sum(1))
        return np.concatenate(parts)

    for c in np.unique(customers[(customers > 1) & (customers <= most)]).tolist():
        rows = np.flatnonzero(customers == c)
        out[rows] = draw(c, rows)
    many = np.flatnonzero(customers > most)
    if not len(many):
        return out
    # The rest comes one table after another, in trials of which one is taken by importance weights. A table at the n-th of
    # c customers makes all later ones less likely, by about (n / c) ** power; new tables are drawn so much more rarely.
    rows = np.repeat(many, TRIALS)
    c = customers[rows].astype(float)
    power = np.maximum(discount * (1 - base[rows]), 1e-6)
    tilt = power * np.log(most / c)
    tables, at, x = draw(most, rows, tilt), np.full(len(rows), float(most)), (most / c) ** power
    weight = -tilt * tables
    alive = np.arange(len(rows))
    while len(alive):
        r, t, n, p = rows[alive], tables[alive], at[alive], power[alive]
        new = (strength + discount * (others[r] + t)) * base[r]
        upto = x[alive] + rng.exponential(size=len(alive)) * p / new
        on = upto < 1
        upto = np.minimum(upto, 1.0)
        after = c[alive] * upto ** (1 / p)
        weight[alive] += log_gamma(after - discount * t) - log_gamma(n - discount * t) + (upto - x[alive]) * new / p
        weight[alive] += np.where(on, -np.log(upto) - np.log1p(-(1 + discount * t) / after), 0)
        at[alive], x[alive] = after, upto
        tables[alive[on]] += 1
        alive = alive[on]
    chosen = (weight.reshape(-1, TRIALS) + rng.gumbel(size=(len(many), TRIALS))).argmax(1)
    out[many] = tables.reshape(-1, TRIALS)[np.arange(len(many)), chosen]
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For numbers of some tens and more."""
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x)


def sample_strength(now: float, discount: float, customers: np.ndarray, tables: np.ndarray, rng: np.random.Generator) -> float:
    """The concentration given all tables, by auxiliary variables; the sum of the many coin flips is taken at its mean."""
    full = customers > 1
    if not full.any():
        return now
    logs = np.log(np.maximum(rng.beta(now + 1, customers[full] - 1), 1e-300)).sum()
    x = now / discount
    flips = x * (np.log((x + tables[full]) / (x + 1)) + 0.5 / (x + 1) - 0.5 / (x + tables[full]))
    return float(np.clip(rng.gamma(1 + np.maximum(flips, 0).sum()) / (1 - logs), 1e-2, 1e7))


def discount_of(ones: float, twos: float) -> float:
    return float(np.clip(ones / max(ones + 2 * twos, 1), 0.05, 0.95))


# --- passes


BLOBS = "bucket int, chunk bigint, kind int, blob binary"
BLOB_SCHEMA = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])


def row(bucket: int, chunk: int, kind: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bucket": [bucket], "chunk": [chunk], "kind": [kind], "blob": [blob]}, BLOB_SCHEMA)


MODEL, TOKENS, INFO = 0, 1, 2


def size_of(docs: DataFrame) -> tuple[int, int]:
    """Rows, and buckets for the bytes of their texts."""
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return rows, max(partitions(docs.sparkSession), -(-size // BUCKET))


def find_spread(docs: DataFrame, rows: int, n: int) -> np.ndarray:

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, off, _ in chunks(parts, CHUNK):
            word = tokens(data, off)[0]
            h, count = np.unique(word, return_counts=True)
            much = count > SPREAD / n * len(word) / 2
            yield pa.RecordBatch.from_arrays([pa.array(np.append(h[much], np.uint64(0)).view(np.int64)), pa.array(np.append(count[much], len(word)).astype(np.int64))], ["word", "n"])

    found = docs.sample(min(1.0, SAMPLE_ROWS / max(rows, 1)), 7).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    got = {r["word"]: r["n"] for r in found.collect()}
    total = got.pop(0, 0)
    return np.sort(np.array([w for w, k in got.items() if k > SPREAD / n * total], np.int64).view(np.uint64))


def count(docs: DataFrame, spread: np.ndarray, n: int) -> DataFrame:
    """(bucket, kind, blob, totals): each bucket's words, entries by word, restaurants, customers, tables and root tables."""
    limit = CHUNK

    def split(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, off, _ in chunks(parts, limit):
            word, room, _ = tokens(data, off)
            for bucket, (distinct, sizes, rooms, _, times) in grouped(word, room, np.zeros(len(word), np.int64), spread, n):
                yield row(bucket, 0, TOKENS, pack(distinct, sizes, rooms, times))

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size, at = 0, -1
        for b in parts:
            for bucket, blob in zip(b.column("bucket"), b.column("blob"), strict=True):
                at = bucket.as_py()
                distinct, sizes, rooms, times = unpack(blob.as_py())
                held.append([np.repeat(distinct, sizes), rooms, times.astype(np.int64)])
                size += len(rooms)
                if size > 2 * sum(len(x[0]) for x in held[:1]) + 4_000_000:
                    held, size = [merged(held)], 0
        if not held:
            return
        word, room, customers = merged(held)
        heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        sizes = np.diff(np.append(heads, len(word))).astype(np.uint32)
        distinct = word[heads]
        counts = np.add.reduceat(customers, heads)
        own = ~np.isin(distinct, spread)
        sums = vector(spread, distinct, counts, own, room, customers, np.bincount(customers, minlength=3)[1:3])
        sums[-4:] = counts.sum(), own.sum(), 0, 0
        # every customer starts at a table of its own
        root_tables = np.where(own, 1, 0).astype(np.uint32)
        yield state_row(at, [distinct, sizes, room, customers.astype(np.uint32), customers.astype(np.uint32), root_tables], sums)

    blobs = docs.select("text").mapInArrow(split, BLOBS)
    return blobs.repartitionById(n, F.col("bucket")).mapInArrow(merge, STATE)


STATE = "bucket int, blob binary, totals binary"
STATE_SCHEMA = pa.schema([("bucket", pa.int32()), ("blob", pa.binary()), ("totals", pa.binary())])


def state_row(bucket: int, arrays: list[np.ndarray], sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bucket": [bucket], "blob": [pack(*arrays)], "totals": [pack(sums)]}, STATE_SCHEMA)


def merged(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The entries in order of word and restaurant, those of equal ones summed."""
    word, room, times = (np.concatenate([x[k] for x in held]) for k in range(3))
    order = np.lexsort((room, word))
    word, room, times = word[order], room[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (room[1:] != room[:-1])]))
    return [word[first], room[first], np.add.reduceat(times, first)]


def vector(spread: np.ndarray, distinct: np.ndarray, counts: np.ndarray, own: np.ndarray, room: np.ndarray, per_entry: np.ndarray, small: np.ndarray) -> np.ndarray:
    """Sums of a bucket: per restaurant, per spread word, two small counts and four more numbers."""
    out = np.zeros(RESTAURANTS + len(spread) + 6)
    out[:RESTAURANTS] = np.bincount(room, per_entry, RESTAURANTS)
    if len(spread):
        out[RESTAURANTS + np.searchsorted(spread, distinct[~own])] = counts[~own]
    out[-6 : -6 + len(small)] = small
    return out


def add_up(states: DataFrame) -> np.ndarray | None:
    """The sum of all buckets' totals, added up in a few tasks."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in parts:
            for blob in b.column("totals"):
                (x,) = unpack(blob.as_py())
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_pydict({"totals": [pack(total)]}, pa.schema([("totals", pa.binary())]))

    rows = states.select("totals").coalesce(8).mapInArrow(run, "totals binary").collect()
    return sum(unpack(r["totals"])[0] for r in rows) if rows else None


def sweep(states: DataFrame, totals: Totals, spread: np.ndarray, seed: int, keep: bool) -> DataFrame:
    """The states after a Gibbs sweep; with keep, its tables are appended to the kept samples."""
    shared = states.sparkSession.sparkContext.broadcast(dense(totals))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = undense(shared.value)
        stirling, root_stirling = log_stirling(t.discount), log_stirling(t.root_discount)
        for b in parts:
            for bucket, blob in zip(b.column("bucket"), b.column("blob"), strict=True):
                rng = np.random.default_rng([seed, bucket.as_py()])
                distinct, sizes, room, customers, tables, root_tables, *samples = unpack(blob.as_py())
                heads = np.cumsum(sizes, dtype=np.int64) - sizes
                own = ~np.isin(distinct, spread)
                number = np.repeat(np.arange(len(distinct)), sizes)
                root_customers = np.add.reduceat(tables.astype(np.int64), heads)
                seated = root_tables.astype(np.int64)
                if not own.all():
                    at = np.searchsorted(spread, distinct[~own])
                    root_customers[~own], seated[~own] = t.spread_root[at], t.spread_tables[at]
                base = t.root(root_customers, seated)
                several = np.flatnonzero(customers > 1)
                new = np.ones(len(customers), np.int64)
                others = np.maximum(t.tables[room[several]] - tables[several], 0)
                new[several] = seat(customers[several].astype(np.int64), base[number[several]], others, t.strength, t.discount, stirling, rng)
                root_customers = np.add.reduceat(new, heads)
                mine = np.flatnonzero(own)
                uniform = np.full(len(mine), 1 / (t.words + 1))
                seated = np.zeros(len(distinct), np.int64)
                seated[mine] = seat(root_customers[mine], uniform, np.maximum(t.root_tables - root_tables[mine], 0), t.root_strength, t.root_discount, root_stirling, rng)
                sums = vector(spread, distinct, root_customers, own, room, new, np.bincount(root_customers[mine], minlength=3)[1:3])
                sums[-4:] = root_customers[mine].sum(), seated.sum(), 0, 0
                arrays = [distinct, sizes, room, customers, new.astype(np.uint32), seated.astype(np.uint32)]
                yield state_row(bucket.as_py(), arrays + samples + (arrays[4:] if keep else []), sums)

    return states.select("bucket", "blob").mapInArrow(run, STATE)


@dataclass
class Model:
    states: DataFrame
    spread: np.ndarray
    samples: list[Totals] = field(default_factory=list)
    buckets: int = 1


def train(docs: DataFrame, seed: int = 11) -> Model | None:
    """docs: text of training rows. None if there are none."""
    rows, n = size_of(docs)
    spread = find_spread(docs, rows, n)
    states = store(count(docs, spread, n), "lm-counts", "uncompressed")
    sums = add_up(states)
    if sums is None:
        return None
    r, k = RESTAURANTS, len(spread)
    rng = np.random.default_rng(seed)
    per_word = sums[r : r + k]
    now = Totals(sums[:r], sums[:r].copy(), per_word, per_word.copy(), np.ones(k), int(sums[-4]), int(sums[-3]) + k)
    now.discount = discount_of(sums[-6], sums[-5])
    now.root_customers, now.root_tables = float(sums[-4]), float(now.words)
    model = Model(states, spread, [], n)
    for turn in range(SWEEPS):
        keep = turn >= SWEEPS - KEPT
        after = store(sweep(states, now, spread, seed * 1000 + turn, keep), "lm-states", "uncompressed")
        sums = add_up(after)
        discard(states)
        states = after
        root = sums[r : r + k]
        seated = seat(root.astype(np.int64), np.full(k, 1 / (now.words + 1)), np.maximum(now.root_tables - now.spread_tables, 0), now.root_strength, now.root_discount, log_stirling(now.root_discount), rng) if k else np.zeros(0)
        now = Totals(now.customers, sums[:r], per_word, root, seated.astype(float), now.tokens, now.words, float(sums[-4] + root.sum()), float(sums[-3] + seated.sum()), now.discount, now.strength, now.root_discount, now.root_strength)
        now.root_discount = discount_of(sums[-6], sums[-5])
        now.strength = sample_strength(now.strength, now.discount, now.customers, now.tables, rng)
        now.root_strength = sample_strength(now.root_strength, now.root_discount, np.array([now.root_customers]), np.array([now.root_tables]), rng)
        if keep:
            model.samples.append(now)
    model.states = states
    return model


def lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where wanted stand in the ordered keys, and whether they do."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs: doc_id, held_out and text of all rows."""
    spark = docs.sparkSession
    n = model.buckets if model else partitions(spark)
    spread = model.spread if model else np.zeros(0, np.uint64)
    shared = spark.sparkContext.broadcast(dense(model.samples if model else []))
    total = model.samples[0].tokens if model else 0

    def split(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, turn = TaskContext.get().partitionId() << 32, 0
        for data, off, rows in chunks(parts, CHUNK):
            word, room, doc = tokens(data, off)
            ids = rows.column("doc_id")
            yield row((base >> 32) % n, base + turn, INFO, pack(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), rows.column("held_out").to_numpy(zero_copy_only=False), np.bincount(doc, minlength=len(ids))))
            for bucket, arrays in grouped(word, room, doc, spread, n):
                yield row(bucket, base + turn, TOKENS, pack(np.array([len(ids)]), *arrays))
            turn += 1

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The model's row comes first, so tokens pass one by one."""
        rows = (x for b in parts for x in zip(*b.columns, strict=True))
        state: list[np.ndarray] = []
        score_of = None
        for bucket, chunk, kind, blob in rows:
            if kind.as_py() == MODEL:
                state = unpack(blob.as_py())
            elif kind.as_py() == INFO:
                yield row(bucket.as_py(), chunk.as_py(), INFO, blob.as_py())
            else:
                score_of = score_of or scorer(state)
                yield row(0, chunk.as_py(), TOKENS, score_of(blob.as_py()))

    def scorer(state: list[np.ndarray]) -> Callable[[bytes], bytes]:
        samples: list[Totals] = undense(shared.value)
        distinct, sizes, room, customers, _, _, *seated = state or [np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 5]
        heads = np.cumsum(sizes, dtype=np.int64) - sizes
        keys = np.repeat(np.arange(len(distinct)), sizes) << ROOM_BITS | room
        count = np.add.reduceat(customers.astype(np.int64), heads) if len(distinct) else np.zeros(0, np.int64)
        own = ~np.isin(distinct, spread)
        at = np.searchsorted(spread, distinct[~own])
        roots = []
        for s, t in enumerate(samples):
            if len(distinct):
                root_customers, root_tables = np.add.reduceat(seated[2 * s].astype(np.int64), heads), seated[2 * s + 1].astype(np.float64)
                root_customers[~own], root_tables[~own] = t.spread_root[at], t.spread_tables[at]
                roots.append(t.root(root_customers, root_tables))
        if samples:
            count[~own] = samples[0].spread_counts[at]
        def of(blob: bytes) -> bytes:
            docs_here, word, size, rooms, doc, times = unpack(blob)
            # a spread word may be known though this bucket has no training entry of it
            place, known = lookup(distinct, word)
            far, spread_known = lookup(spread, word)
            number = np.where(known, place, -1)
            c = np.where(known, count[np.minimum(place, max(len(count) - 1, 0))] if len(count) else 0, 0)
            if samples and len(spread):
                c = np.where(spread_known, samples[0].spread_counts[far], c)
            total, vocabulary = (samples[0].tokens, samples[0].words) if samples else (0, 0)
            base = np.repeat(np.log10((c + 0.5) / (total + 0.5 * (vocabulary + 1))), size)
            entry, there = lookup(keys, np.repeat(number, size) << ROOM_BITS | rooms)
            p = np.zeros(len(rooms)) if samples else np.ones(len(rooms))
            for s, t in enumerate(samples):
                up = np.full(len(word), float(t.root(np.zeros(1), np.zeros(1))[0]))
                if len(distinct):
                    up = np.where(known, roots[s][place], up)
                if len(spread):
                    up = np.where(spread_known, t.root(t.spread_root[far], t.spread_tables[far]), up)
                seats = np.where(there, customers[entry] - t.discount * seated[2 * s][entry], 0) if len(keys) else 0
                p += (seats + (t.strength + t.discount * t.tables[rooms]) * np.repeat(up, size)) / (t.strength + t.customers[rooms]) / len(samples)
            m = int(docs_here[0])
            return pack(np.bincount(doc, times * np.log10(p), m), np.bincount(doc, times * base, m), np.bincount(doc, times * np.repeat(c > 0, size), m).astype(np.uint32))

        return of

    def finish(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info: dict[int, list[np.ndarray]] = {}
        sums: dict[int, list[np.ndarray]] = {}
        for b in parts:
            for chunk, kind, blob in zip(*(b.column(c).to_pylist() for c in ("chunk", "kind", "blob")), strict=True):
                got = unpack(blob)
                if kind == INFO:
                    info[chunk] = got
                else:
                    sums[chunk] = [x + y for x, y in zip(sums[chunk], got, strict=True)] if chunk in sums else got
        for chunk, (ids, none, held_out, size) in info.items():
            score, base, known = sums[chunk]
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=none), pa.array(held_out), pa.array(size), pa.array(known.astype(np.int64)), pa.array(np.full(len(ids), total)), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    blobs = docs.select("doc_id", "held_out", "text").mapInArrow(split, BLOBS)
    if model:
        blobs = blobs.union(model.states.select("bucket", F.lit(0).cast("bigint").alias("chunk"), F.lit(MODEL).alias("kind"), "blob"))
    partial = blobs.repartitionById(n, F.col("bucket")).sortWithinPartitions("kind").mapInArrow(meet, BLOBS)
    home = (F.shiftright("chunk", 32) + F.col("chunk").bitwiseAND(F.lit((1 << 32) - 1))) % n
    return partial.repartitionById(n, home.cast("int")).mapInArrow(finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def score_documents(docs: DataFrame, modulus: int = 5, apart: int = 1) -> DataFrame:
    """Learns from the rows whose remainder isn't `apart` and scores all."""
    docs = with_columns(docs, doc_id="bigint", text="string").select(F.col("doc_id").cast("bigint").alias("doc_id"), (remainder("doc_id", modulus) == apart).alias("held_out"), "text")
    return score(docs, train(docs.where("not held_out").select("text")))
