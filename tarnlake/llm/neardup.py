"""MinHash near-duplicates by ProbMinHash.

A text's weighted shingles are its runs of five words; a weight is 1 and up to an eighth more for repeats. Each shingle
starts a Poisson process whose rate is its weight; an arrival goes to a random register, which keeps the earliest one, and
a process stops once its arrivals are later than all registers. Two texts agree in a register with the probability Jaccard
similarity of their weights. Bands of ROWS registers give candidates, which the whole texts verify: a link is a pair whose
Jaccard similarity of distinct shingles is at least the threshold t, so that a line repeated in two texts doesn't make
them near. Since weights are within an eighth of each other, a pair with t has a probability Jaccard similarity of 0.74 at
least, however unequal its repeats are, and shares a band with probability 0.998; with equal repeats it is 0.99995.

Equal texts are one node from the start, named by a digest of the text: only one signature of each goes on, so thousands
of copies meet no join. Buckets are never compared as all pairs. The member of a bucket that is first by (degree, name) is
its head, and all others are compared with it. With x, y and h as sets of shingles, let D(x) be the shingles that x has more
or less than the head h. If x and y are linked, D(x) and D(y) share a shingle, or both are linked to h: else the common part
of x and y is in h, and h in their union, so that both have a similarity of t to h. So the members of a star that holds more
than one component meet again in finer buckets by (h, shingle of D), and every link between members of a bucket ends in one
component: none is capped. Not all of D is needed: D(x) and D(y) differ in no more shingles than x and y do, which if they are
linked is at most d = (1 - t) / (1 + t) (|x| + |y|) <= k = (1 - t) / t |x|. They have (|D(x)| + |D(y)| - d) / 2 shingles in
common then, so by any order one of the first (|D(x)| - |D(y)| + d) / 2 + 1 <= k + 1 of D(x) and as many of D(y) is; the order
is from rare to frequent within the star. Of finer buckets, whatever their size, the pairs of different components that these
bounds leave open are compared in one round. The bounds are tried on a few numbers of each pair, without texts or joined rows;
buckets of more than WHOLE members are dealt to tasks as pairs of blocks. So the number of rounds doesn't grow with the groups.

A star is compared in blocks of BLOCK members, each with the head's text once. Components come from label propagation over
the new links between the components so far. Lookups by a hot name deal it to SALTS tasks; nothing of the texts, pairs or
components comes to the driver but counts.

Defined results: a null text is empty; texts without words are one class of equal texts only if they are equal; a text of fewer
than five words is one shingle. Case of A-Z and white space don't count for similarity. A class's id is its smallest
doc_id, and the row of it that is kept has the smallest (doc_id, digest of the text), of equal such rows the first by a hash
of all columns. Rows that repeat an id with other texts have each the class of their text. Rows with a null id have a null
class and are kept. An empty table gives none. Other columns pass through.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnlake.llm.common import discard, fresh, partitions, pieces, store, utf8, with_columns
from tarnlake.llm.words import mix, shingles, words

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: By how much repeats can raise a weight of 1.
EXTRA = 0.125
#: Members of a star that are compared in one go.
BLOCK = 256
#: Members of a block of a finer bucket; a task tries the bounds on a block, or on two blocks against each other.
WHOLE = 512
#: Pairs that the bounds are tried on in one go.
PAIRS = 1 << 18
#: Rows of 32 bytes of a table that may be broadcast, and tasks that a hot name of a larger one is dealt to.
BROADCAST_ROWS, SALTS = 200_000, 16
#: Stored tables of comparisons that were read side by side; of no effect since one round serves, and kept for those who set it.
TABLES = 8
CHUNK = 1 << 18
#: Of a shingle's hash. Above them stands the number of its text in a chunk, so that one sort serves a chunk.
BITS = 48
UNIT = 1.0 / (1 << 53)


def weights(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text in rising order, their weights, and n + 1 offsets. A weight is 1 + EXTRA * (1 - 1 / count)."""
    h, at = shingles(words(data, off), SHINGLE)
    n = len(off) - 1
    key = np.sort(np.repeat(np.arange(n, dtype=np.uint64) << np.uint64(BITS), np.diff(at)) | (h >> np.uint64(64 - BITS)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    key = key[first]
    return key & np.uint64((1 << BITS) - 1), 1 + EXTRA * (1 - 1 / np.diff(np.append(first, len(h)))), np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(BITS))


def signatures(h: np.ndarray, weight: np.ndarray, off: np.ndarray) -> np.ndarray:
    """REGISTERS values of 32 bits for each text; zeros for a text without shingles."""
    n = len(off) - 1
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    total = np.add.reduceat(np.append(weight, 0.0), np.minimum(off[:-1], len(weight))) if n else np.zeros(0)
    rate = weight / np.where(size > 0, total, 1)[doc]
    best = np.full(n * REGISTERS, np.inf)
    owner = np.zeros(n * REGISTERS, np.uint64)
    alive = np.arange(len(h))
    time = np.zeros(len(h))
    turn = 0
    while len(alive):
        turn += 1
        r = mix(h[alive] + np.uint64(turn * 0xD1342543DE82EF95 % (1 << 64)))
        u = ((r >> np.uint64(11)).astype(np.float64) + 0.5) * UNIT
        now = time[alive] - np.log(u) / rate[alive]
        time[alive] = now
        register = ((r & np.uint64(0xFFFFFFFF)) % np.uint64(REGISTERS)).astype(np.int64) + doc[alive] * REGISTERS
        np.minimum.at(best, register, now)
        won = now == best[register]
        owner[register[won]] = h[alive[won]]
        latest = best.reshape(n, REGISTERS).max(1)
        alive = alive[time[alive] < latest[doc[alive]]]
    return (mix(owner) >> np.uint64(32)).astype(np.uint32).reshape(n, REGISTERS) * (size > 0)[:, None].astype(np.uint32)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """What signatures estimate: the probability Jaccard similarity of weights x of shingles a and y of b."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    p, q = x[i] / x.sum(), y[j] / y.sum()
    order = np.argsort(q / p, kind="stable")
    p, q = p[order], q[order]
    # for each common d: 1 / sum of max(p' / p, q' / q) over all shingles, where p' / p is larger up to its ratio
    p_rest, q_rest = 1 - p.sum(), 1 - q.sum()
    p_upto, q_after = np.cumsum(p), q.sum() - np.cumsum(q)
    return float((1 / ((p_upto + p_rest) / p + (q_after + q_rest) / q)).sum())


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two ordered sets of shingles."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def digest(text: F.Column) -> F.Column:
    """128 bits that name a text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, id, signature): id names the text; signature is null for a text without words."""

    @F.arrow_udf("binary")
    def run(col: pa.Array) -> pa.Array:
        data, off = utf8(col)
        out: list[bytes | None] = []
        for a, b in pieces(off, CHUNK):
            h, count, at = weights(data[off[a] : off[b]], off[a : b + 1] - off[a])
            got = signatures(h, count, at)
            out += [got[i].tobytes() if at[i + 1] > at[i] else None for i in range(b - a)]
        return pa.array(out, pa.binary())

    return docs.select("doc_id", digest(F.col("text")).alias("id"), run(F.coalesce("text", F.lit(""))).alias("signature"))


def bands(classes: DataFrame) -> DataFrame:
    """(key, id) for each band of each signature."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for k in range(0, b.num_rows, 2000):
                ids, raw = (b.column(c)[k : k + 2000] for c in ("id", "signature"))
                x = np.frombuffer(b"".join(raw.to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
                h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), x.shape[:2]).copy()
                for r in range(ROWS):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + x[:, :, r])
                yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), ids.take(pa.array(np.repeat(np.arange(len(ids)), BANDS)))], ["key", "id"])

    return classes.where("signature is not null").select("id", "signature").mapInArrow(run, "key bigint, id binary")


def looked_up(df: DataFrame, column: str, table: DataFrame, out: str, default: str) -> DataFrame:
    """df with what the stored table (id, value) has for a column's name, or else the default column."""
    found = F.coalesce(F.col("__value"), F.col(default)).alias(out)
    rest = [c for c in df.columns if c != out]
    table = table.select(F.col("id").alias("__id"), F.col("value").alias("__value"))
    if table.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(table), F.col(column) == F.col("__id"), "left").select(*rest, found)
    salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = df.withColumn("__deal", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, (F.col(column) == F.col("__id")) & (F.col("__deal") == F.col("__salt")), "left").select(*rest, found)


MEMBERS = "a binary, b binary, similarity double, more array<bigint>, less array<bigint>, size int"
MEMBER_SCHEMA = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64()), ("more", pa.list_(pa.int64())), ("less", pa.list_(pa.int64())), ("size", pa.int32())])


def member(head: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, int]:
    """The similarity of ordered sets of shingles, what x has more and less than the head, and its size."""
    more, less = np.setdiff1d(x, head, assume_unique=True), np.setdiff1d(head, x, assume_unique=True)
    return (len(x) - len(more)) / max(1, len(head) + len(more)), more, less, len(x)


def compare(pairs: DataFrame, texts: DataFrame, heads_too: bool = True) -> DataFrame:
    """MEMBERS of the pairs (a, b): a is a head, or else no shingles are given. texts: (id, text) of all that occur."""
    large = store(pairs.groupBy(F.col("a").alias("id")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("value")).where("value > 1"), "neardup-large")
    dealt = looked_up(pairs.withColumn("one", F.lit(1)), "a", large, "blocks", "one").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("part"))
    dealt = store(dealt, "neardup-dealt")
    heads = dealt.select("a", "part").distinct().join(texts.withColumnRenamed("id", "a"), "a").select("a", "part", F.lit(None).cast("binary").alias("b"), "text")
    members = dealt.join(texts.withColumnRenamed("id", "b"), "b").select("a", "part", "b", "text")
    together = heads.union(members).repartition(partitions(pairs.sparkSession), "a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in parts:
            off = utf8(batch.column("text"))[1]
            for p, q in pieces(off, CHUNK, 1 << 10):
                h, _, at = weights(*utf8(batch.column("text")[p:q]))
                rows = []
                for i, (a, b) in enumerate(zip(batch.column("a")[p:q].to_pylist(), batch.column("b")[p:q].to_pylist(), strict=True)):
                    own = h[at[i] : at[i + 1]]
                    if b is None:
                        head = own.copy()
                    else:
                        rows.append((a, b, *member(head, own)))
                cols = list(zip(*rows, strict=True)) or [()] * 6
                lists = [pa.array([x.view(np.int64) if heads_too else [] for x in c], pa.list_(pa.int64())) for c in cols[3:5]]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.float64()), *lists, pa.array(cols[5], pa.int32())], schema=MEMBER_SCHEMA)

    out = store(together.mapInArrow(run, MEMBERS), "neardup-checked")
    discard(large)
    discard(dealt)
    return out


def components(links: DataFrame) -> DataFrame:
    """(id, value) of every id of the links (a, b): the smallest id of its component. Each round, a node takes the smallest label around it and then that label's own label, so chains halve."""
    both = store(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "neardup-links")
    labels = store(both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("id"), F.least("a", "near").alias("value")), "neardup-labels")
    while True:
        near = store(looked_up(both, "b", labels, "label", "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("value")), "neardup-near")
        better = store(looked_up(labels, "id", near, "near", "value").select("id", F.col("value").alias("old"), F.least("value", "near").alias("value")), "neardup-better")
        after = store(looked_up(better, "value", better.select("id", "value"), "next", "value").select("id", "old", F.least("value", "next").alias("value")), "neardup-labels")
        changed = after.where("value < old").limit(1).count()
        for scratch in (labels, near, better):
            discard(scratch)
        labels = after.select("id", "value")
        labels.scratch_path = after.scratch_path
        if not changed:
            discard(both)
            return labels


def merged(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """The labels (id, value) after new links (a, b); the old ones are removed."""
    if labels is None:
        return components(found)
    ends = looked_up(looked_up(found.select("a", "b"), "a", labels, "la", "a"), "b", labels, "lb", "b")
    between = store(ends.where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "neardup-between")
    if not between.limit(1).count():
        discard(between)
        return labels
    joined = components(between)
    old = looked_up(labels, "value", joined, "to", "value").select("id", F.col("to").alias("value"))
    out = store(old.union(joined.join(labels.select("id"), "id", "left_anti").select("id", "value")), "neardup-labels")
    for scratch in (between, joined, labels):
        discard(scratch)
    return out


def stars(buckets: DataFrame, degrees: DataFrame) -> DataFrame:
    """Pairs (a, b) of each bucket's first member by (degree, id) with its other ones."""
    heads = buckets.join(degrees, "id").groupBy("key").agg(F.max(F.struct("degree", "id")).alias("top")).select("key", F.col("top.id").alias("a"))
    return buckets.join(heads, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct()


def finer(checked: DataFrame, labels: DataFrame | None, t: float) -> DataFrame:
    """(key, id, label, size, more, less, rank, n): buckets of at most n members of one star that have the same shingle more, or less, than its head; of stars and buckets with one component there are none. more, less: how many; rank: of the shingle among the member's, from rare to frequent."""
    if labels is None:
        star = checked.withColumns({"la": F.col("a"), "lb": F.col("b")})
    else:
        star = looked_up(looked_up(checked, "a", labels, "la", "a"), "b", labels, "lb", "b")
    star = star.select("a", "b", "more", "less", "size", F.xxhash64("la").alias("la"), F.xxhash64("lb").alias("label"))
    # a star with one component needs no other look; of others, all members
    several = store(star.where("la <> label").select("a").distinct(), "neardup-several")
    star = star.join(F.broadcast(several) if several.count() <= BROADCAST_ROWS else several, "a", "left_semi")
    keys = F.array_union(F.transform("more", lambda x: F.xxhash64(F.lit(1), x)), F.transform("less", lambda x: F.xxhash64(F.lit(2), x)))
    apart = star.select("a", "b", "label", "size", F.size("more").alias("more"), F.size("less").alias("less"), F.explode(keys).alias("shingle"))
    apart = store(apart.withColumn("key", F.xxhash64("a", "shingle")).drop("shingle"), "neardup-apart")
    # a member's shingles that no other has come first in the order and make no bucket, so its others are counted from the end
    times = apart.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.min("label") != F.max("label")).alias("mixed")).where("n > 1")
    last = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("n"), F.desc("key")))
    ranked = apart.join(times, "key").withColumn("rank", F.col("more") + F.col("less") + 1 - last)
    k = F.col("size") * ((1 - t) / t) + 1e-6
    out = ranked.where(F.col("mixed") & (F.col("rank") <= F.floor(k) + 1)).select("key", F.col("b").alias("id"), "label", "size", "more", "less", "rank", "n")
    out = store(out, "neardup-finer")
    for scratch in (several, apart):
        discard(scratch)
    return out


def open_pairs(group: np.ndarray, alone: np.ndarray, second: np.ndarray, label: np.ndarray, rows: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of different labels that the bounds leave open: all of a group that stands alone, of others those of a first and a second member. Members are ordered by (group, second, label); rows: their size, more, less and rank."""
    n = len(group)
    at = group * n + np.unique(label, return_inverse=True)[1]
    one, first, other = np.flatnonzero(alone), np.flatnonzero(~alone & ~second), np.flatnonzero(~alone & second)
    # runs of partners: those of the same label lie together and are left out
    runs = [(one, one, np.searchsorted(at[one], at[one], "right"), np.searchsorted(at[one], (group[one] + 1) * n))]
    runs.append((first, other, np.searchsorted(at[other], group[first] * n), np.searchsorted(at[other], at[first])))
    runs.append((first, other, np.searchsorted(at[other], at[first], "right"), np.searchsorted(at[other], (group[first] + 1) * n)))
    for own, partner, low, high in runs:
        off = np.append(0, np.cumsum(high - low))
        for p, q in pieces(off, PAIRS, n):
            many = high[p:q] - low[p:q]
            i = np.repeat(own[p:q], many)
            j = partner[np.arange(off[p], off[q]) + np.repeat(low[p:q] - off[p:q], many)]
            (size, more, less, rank), (size_, more_, less_, rank_) = rows[:, i], rows[:, j]
            most = (1 - t) / (1 + t) * (size + size_) + 1e-6
            differ = np.abs(more - more_) + np.abs(less - less_)
            longer = more + less - more_ - less_
            # so many of each one's first shingles hold a common one
            fits = (differ <= most) & (rank <= (longer + most) / 2 + 1) & (rank_ <= (most - longer) / 2 + 1)
            yield i[fits], j[fits]


def within(buckets: DataFrame, t: float) -> DataFrame:
    """Pairs (a, b) of members of different components that the bounds leave open. A bucket of up to n members is dealt as the pairs of its n / WHOLE blocks, each with itself too."""
    blocks = F.ceil(F.col("n") / max(1, WHOLE)).cast("int")
    dealt = buckets.withColumns({"own": F.pmod(F.xxhash64("id"), blocks).cast("int"), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    dealt = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("second"), "label", "id", "size", "more", "less", "rank")
    groups = ["key", "low", "high"]
    together = dealt.repartition(partitions(buckets.sparkSession), *groups).sortWithinPartitions(*groups, "second", "label")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in itertools.chain(parts, [None]):
            filled = [x for x in (rest, batch) if x is not None and x.num_rows]
            if not filled:
                continue
            held = pa.Table.from_batches(filled)
            key, low, high = (held.column(c).to_numpy() for c in groups)
            new = np.append(True, (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
            # the last group may go on in the next batch
            upto = held.num_rows if batch is None else int(np.flatnonzero(new)[-1])
            whole, rest = held.slice(0, upto), held.slice(upto).combine_chunks().to_batches()
            rest = rest[0] if rest else None
            if upto:
                ids = whole.column("id").combine_chunks()
                rows = np.stack([whole.column(c).to_numpy().astype(np.int32) for c in ("size", "more", "less", "rank")])
                second = whole.column("second").to_numpy().astype(bool)
                for i, j in open_pairs(np.cumsum(new[:upto]) - 1, (low == high)[:upto], second, whole.column("label").to_numpy(), rows, t):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)).cast(pa.binary()) for x in (i, j)], ["a", "b"])

    found = together.mapInArrow(run, "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked(texts: DataFrame, buckets: DataFrame, threshold: float) -> DataFrame | None:
    """(id, value): the component of every id that has a link within a bucket (key, id), or None if there are no links."""
    size = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    degrees = store(buckets.join(size, "key").groupBy("id").agg(F.sum("n").alias("degree")), "neardup-degrees")
    pairs = store(stars(buckets, degrees), "neardup-pairs")
    labels, scratch = None, [degrees, pairs]
    if pairs.limit(1).count():
        checked = compare(pairs, texts)
        labels = with_links(None, checked, threshold)
        several = finer(checked, labels, threshold)
        found = store(within(several, threshold), "neardup-within")
        scratch += [checked, several, found]
        if found.limit(1).count():
            again = compare(found, texts, False)
            labels = with_links(labels, again, threshold)
            scratch.append(again)
    for x in scratch:
        discard(x)
    return labels


def with_links(labels: DataFrame | None, checked: DataFrame, threshold: float) -> DataFrame | None:
    """The labels after the links among compared pairs."""
    links = checked.where(F.col("similarity") >= threshold - 1e-9).select("a", "b")
    return merged(labels, links) if links.limit(1).count() else labels


def classified(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, id, class_id, first) of each row with a doc_id: id names its text, first the text of the class's row to keep."""
    signed = store(sign(docs.where("doc_id is not null")), "neardup-signed")
    classes = store(signed.groupBy("id").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("n"), F.any_value("signature").alias("signature")), "neardup-classes")
    keyed = bands(classes)
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    buckets = store(keyed.join(shared, "key", "left_semi"), "neardup-buckets")
    # one row of each text, found by its smallest doc_id too, so that copies don't meet
    one = classes.select("id", F.col("doc").alias("doc_id")).join(buckets.select("id").distinct(), "id", "left_semi")
    texts = docs.where("doc_id is not null").select(digest(F.col("text")).alias("id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = store(texts.join(one, ["id", "doc_id"], "left_semi").groupBy("id").agg(F.first("text").alias("text")), "neardup-texts")
    labels = linked(texts, buckets, threshold)
    # only texts that stand in several rows or have a link need a lookup
    if labels is None:
        several = classes.where("n > 1").select("id", F.struct("doc", F.col("id").alias("first")).alias("value"))
    else:
        known = labels.join(classes.select("id", "doc"), "id")
        tops = store(known.groupBy(F.col("value").alias("id")).agg(F.min(F.struct("doc", F.col("id").alias("first"))).alias("value")), "neardup-tops")
        of = looked_up(known.withColumn("own", F.struct("doc", F.col("id").alias("first"))), "value", tops, "top", "own").select("id", F.col("top").alias("value"))
        alone = classes.where("n > 1").join(labels.select("id"), "id", "left_anti").select("id", F.struct("doc", F.col("id").alias("first")).alias("value"))
        several = of.union(alone)
    several = store(several, "neardup-several")
    own = signed.select("doc_id", "id", F.struct(F.col("doc_id").alias("doc"), F.col("id").alias("first")).alias("own"))
    out = looked_up(own, "id", several, "top", "own").select("doc_id", "id", F.col("top.doc").alias("class_id"), F.col("top.first").alias("first"))
    for scratch in (classes, buckets, texts, *([labels, tops] if labels is not None else [])):
        discard(scratch)
    return out


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, keep) of each row."""
    docs = with_columns(docs, doc_id="bigint", text="string").select(F.col("doc_id").cast("bigint"), "text")
    out = classified(docs, threshold).select("doc_id", "class_id", ((F.col("doc_id") == F.col("class_id")) & (F.col("id") == F.col("first"))).alias("keep"))
    return out.unionByName(docs.where("doc_id is null").select("doc_id", F.lit(None).cast("bigint").alias("class_id"), F.lit(True).alias("keep")))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents of which one of each class stays, as the rules above say."""
    full = with_columns(docs, doc_id="bigint", text="string")
    found = classified(full.select(F.col("doc_id").cast("bigint"), "text"), threshold)
    name, turn = fresh(full, "name", "turn")
    drop = store(found.where("doc_id <> class_id or id <> first").select("doc_id", F.col("id").alias(name)).distinct(), "neardup-drop")
    kept = full.where("doc_id is not null").withColumn(name, digest(F.col("text"))).join(drop, ["doc_id", name], "left_anti")
    order = Window.partitionBy("doc_id", name).orderBy(F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in docs.columns]))
    one = kept.withColumn(turn, F.row_number().over(order)).where(F.col(turn) == 1)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return one.select(*columns).unionByName(full.where("doc_id is null").select(*columns))
