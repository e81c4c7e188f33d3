"""Benchmark decontamination with SimHash windows, in DataFrame functions only.

Texts and benchmark items are lower-cased and split at white space; a shingle is a run of five words (an item of fewer is
one shingle of its own length). Windows of an item's size are fingerprinted wherever they could match: a similarity of at
least t to an item of m shingles needs t * m of them, so one of any floor((1 - t) * m) + 1 is in the window, and every
window that holds one of an item's first so many shingles, at any place, has its SimHash taken; no other can match. Those
shingles are found by their longest word, so that a text's words are looked up once each.

A SimHash is 64 bits, each the majority of that bit over the shingles, each as often as it occurs. Candidates come from it
alone: of BLOCKS blocks of 16 bits, one differs in at most RADIUS // BLOCKS bits if all 64 differ in at most RADIUS. The
items' blocks are written with every value so near, and blocks of windows of the same size join by equality: all pairs
within the radius are found, each once, by its first near block. At a similarity of 0.8, 10 bits differ, with a deviation of
3, so a pair at the threshold is found with probability 0.98, and more so above; of unrelated pairs 1 in 25 agrees in a
block and 1 in 40,000 is within the radius. Windows of one SimHash meet the items as one. The similarity of shingle counts
(sum of smaller over sum of larger ones) of all candidates then decides.

The items' tables are broadcast only if they have at most BROADCAST_ROWS rows; else the joins shuffle words, in SALTS
parts of each, and hashes. Rows are told apart by 128 bits of a hash of id and text.

Defined results: null texts are empty; an item without words matches nothing; items of equal text each match; repeated
rows and several windows of a document give one row with the largest similarity, ties to the smallest place. A null id
is an id. A text that is shorter than an item, or ends within it, has windows that end with it. Empty tables give no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm.common import discard, fresh, store, with_columns

SHINGLE, THRESHOLD = 5, 0.8
#: Bits in which SimHashes of candidates may differ, and the blocks that the 64 are cut into.
RADIUS, BLOCKS = 15, 4
WIDTH = 64 // BLOCKS
#: Values that a block is compared with: it itself with up to RADIUS // BLOCKS bits turned.
NEAR = [sum(1 << b for b in turned) for k in range(RADIUS // BLOCKS + 1) for turned in combinations(range(WIDTH), k)]
#: Rows of 24 bytes and more of an items' table that may be broadcast.
BROADCAST_ROWS = 200_000
SALTS = 16
#: Starts of windows that share a piece of a text, so that no window carries the text.
STEP = 64


WHITE = " \t\n\x0b\f\r"


def split_words(text: str) -> Column:
    low = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WHITE))
    return F.when(low == "", F.array().cast("array<string>")).otherwise(F.split(low, r"[ \t\n\x0B\f\r]+"))


def shingles(words: str, size: int) -> Column:
    """The hash of each run of size words of an array column, in order; empty if there are fewer words."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(size)]))
    return F.when(F.size(words) >= size, hashes).otherwise(F.array().cast("array<bigint>"))


def simhashes(shingled: DataFrame, *keys: str) -> DataFrame:
    """(keys, simhash) of rows (keys, hash), one for each shingle: 32 sums, each of bit j in its lower and bit j + 32 in its upper half."""
    two = F.lit((1 << 32) + 1)
    sums = [F.sum(F.call_function("shiftrightunsigned", F.col("hash"), F.lit(j)).bitwiseAND(two)).alias(f"b{j}") for j in range(32)]
    low = F.lit((1 << 32) - 1)
    out = F.lit(0).cast("bigint")
    for j in range(32):
        for place, total in ((j, F.col(f"b{j}").bitwiseAND(low)), (j + 32, F.call_function("shiftrightunsigned", F.col(f"b{j}"), F.lit(32)))):
            out = out.bitwiseOR(F.call_function("shiftleft", (total * 2 > F.col("m")).cast("bigint"), F.lit(place)))
    return shingled.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), *sums).select(*keys, out.alias("simhash"))


def block(value: Column, i: int | Column) -> Column:
    bits = F.call_function("shiftrightunsigned", value, (F.lit(i) * WIDTH).cast("int"))
    return bits.bitwiseAND(F.lit((1 << WIDTH) - 1))


def similarity(a: Column, b: str) -> Column:
    """Over the distinct hashes of both arrays, the sum of the smaller number of occurrences over that of the larger one."""

    def of(x: Column) -> Column:
        def times(y: Column | str, h: Column) -> Column:
            return F.size(F.filter(y, lambda z: z == h))

        once = (F.size(F.array_distinct(x)) == F.size(x)) | (F.size(F.array_distinct(b)) == F.size(b))
        counted = F.aggregate(F.array_intersect(x, b), F.lit(0), lambda acc, h: acc + F.least(times(x, h), times(b, h)))
        both = F.when(once, F.size(F.array_intersect(x, b))).otherwise(counted)
        # bound again, so that it is worked out once
        return F.get(F.transform(F.array(both), lambda n: n / (F.size(x) + F.size(b) - n)), F.lit(0))

    return F.get(F.transform(F.array(a), of), F.lit(0))


def of_size(words: str, size: Column) -> Column:
    """The shingles of a column of words whose runs have the size of an item's."""
    return F.coalesce(*[F.when(size == k, shingles(words, k)) for k in range(SHINGLE, 0, -1)])


def prepare_items(items: DataFrame) -> DataFrame:
    """(item_id, words, n, size, shingles): n words, shingles of size words."""
    items = with_columns(items, item_id="bigint", text="string").select("item_id", split_words("text").alias("words"))
    items = items.where(F.size("words") > 0).select("item_id", "words", F.size("words").alias("n"), F.least(F.size("words"), F.lit(SHINGLE)).alias("size"))
    return items.withColumn("shingles", of_size("words", F.col("size")))


def anchors_of(items: DataFrame, threshold: float) -> DataFrame:
    """(word, n, size, before, into, hash): of each item's first shingles the longest word's hash, the words before it in the item and in the shingle, and the shingle's hash."""
    need = F.floor(F.size("shingles") * F.lit(1 - threshold) + F.lit(1e-9)) + 1
    first = items.select("words", "n", "size", F.posexplode(F.slice("shingles", F.lit(1), need.cast("int"))).alias("first", "hash"))
    first = first.withColumn("piece", F.slice("words", F.col("first") + 1, F.col("size")))
    lengths = F.transform("piece", F.length)
    first = first.withColumn("into", (F.array_position(lengths, F.array_max(lengths)) - 1).cast("int"))
    return first.select(F.xxhash64(F.get("piece", F.col("into"))).alias("word"), "n", "size", (F.col("first") + F.col("into")).alias("before"), "into", "hash").distinct()


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


ROW = ("row", "row2")


def keyed(docs: DataFrame) -> DataFrame:
    """(row, row2, doc_id, text): the keys are one for equal rows, also of null ids."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.xxhash64("doc_id", text).alias("row"), F.xxhash64(text, F.lit(1), "doc_id").alias("row2"), "doc_id", "text")


def places(docs: DataFrame, anchors: DataFrame, few: bool) -> DataFrame:
    """(row, row2, n, size, low, high): the starts, from low to high, of all full windows of an item's size that hold an anchor, and of that with the anchor in its place if the text's end cuts it."""
    words = docs.select(*ROW, split_words("text").alias("words"))
    at = words.select(*ROW, F.size("words").alias("length"), "words", F.posexplode("words").alias("pos", "at"))
    # the shingle's hash for each place of the looked-up word in it is taken only after the join
    at = at.select(*ROW, "length", "pos", F.xxhash64("at").alias("word"), F.slice("words", F.greatest(F.col("pos") - SHINGLE + 2, F.lit(1)), F.lit(2 * SHINGLE - 1)).alias("around"))
    if few:
        found = at.join(F.broadcast(anchors), "word")
    else:  # a frequent word is dealt to several tasks
        salted = anchors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = at.withColumn("salt", (F.col("pos") % SALTS).cast("int")).join(salted, ["word", "salt"])
    begin = F.col("pos") - F.col("into")
    first = begin - F.greatest(F.col("pos") - SHINGLE + 1, F.lit(0))
    there = F.xxhash64(*[F.get("around", first + k) for k in range(SHINGLE)])
    found = found.where((F.col("size") < SHINGLE) | (there == F.col("hash")))
    last = F.greatest(F.col("length") - F.col("n"), F.lit(0))
    found = found.withColumn("low", F.greatest(F.least(begin - F.col("n") + F.col("size"), last), F.lit(0)))
    aligned = F.greatest(F.col("pos") - F.col("before"), F.lit(0))
    full = F.struct(F.col("low"), F.greatest(F.least(begin, last), F.col("low")).alias("high"))
    cut = F.struct(aligned.alias("low"), aligned.alias("high"))
    return found.select(*ROW, "n", "size", F.explode(F.when(aligned > last, F.array(full, cut)).otherwise(F.array(full))).alias("at")).select(*ROW, "n", "size", "at.*")


def regions(docs: DataFrame, hit: DataFrame) -> DataFrame:
    """(row, row2, doc_id, n, size, chunk, starts, region): the starts of windows, each once, by chunks of STEP, with the words that a chunk's windows cover."""
    order = Window.partitionBy(*ROW, "n").orderBy("high", "low")
    apart = hit.withColumn("low", F.greatest("low", F.coalesce(F.lag("high").over(order) + 1, F.lit(0)))).where("low <= high")
    starts = apart.select(*ROW, "n", "size", F.explode(F.sequence("low", "high")).alias("start")).withColumn("chunk", F.floor(F.col("start") / STEP).cast("int"))
    chunks = starts.groupBy(*ROW, "n", "size", "chunk").agg(F.collect_list("start").alias("starts"))
    wanted = store(chunks.groupBy(*ROW).agg(F.collect_list(F.struct("n", "size", "chunk", "starts")).alias("chunks")), "leaks-chunks")
    # one row for equal rows of the table
    held = docs.join(small(wanted.select(*ROW), wanted.count()), [*ROW], "left_semi").groupBy(*ROW).agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))

    def pieces(words: Column) -> Column:
        return F.transform("chunks", lambda c: F.struct(c["n"].alias("n"), c["size"].alias("size"), c["chunk"].alias("chunk"), c["starts"].alias("starts"), F.slice(words, c["chunk"] * STEP + 1, c["n"] + STEP).alias("region")))

    # bound by a lambda, so that the text is split once for all chunks
    every = F.get(F.transform(F.array(split_words("text")), pieces), F.lit(0))
    out = store(held.join(wanted, [*ROW]).select(*ROW, "doc_id", F.explode(every).alias("at")).select(*ROW, "doc_id", "at.*"), "leaks-regions")
    discard(wanted)
    return out


def window() -> Column:
    return F.slice("region", F.col("start") - F.col("chunk") * STEP + 1, F.col("n"))


def candidates(hashes: DataFrame, items: DataFrame, rows: int) -> DataFrame:
    """(n, simhash, item): the items of that size whose SimHash differs in at most RADIUS bits. items: (item, n, item_hash)."""
    turned = F.explode(F.lit(NEAR).cast("array<bigint>"))
    index = items.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).withColumn("turned", turned)
    index = index.select("item", "n", "item_hash", "i", block(F.col("item_hash"), F.col("i")).bitwiseXOR(F.col("turned")).alias("value"))
    blocks = hashes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).withColumn("value", block(F.col("simhash"), F.col("i")))
    pairs = blocks.join(small(index, rows * BLOCKS * len(NEAR)), ["n", "i", "value"])
    differ = F.col("simhash").bitwiseXOR(F.col("item_hash"))
    first = F.coalesce(*[F.when(F.bit_count(block(differ, i)) <= RADIUS // BLOCKS, F.lit(i)) for i in range(BLOCKS)])
    return pairs.where((F.bit_count(differ) <= RADIUS) & (F.col("i") == first)).select("n", "simhash", "item")


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, start, similarity) of each document and item whose text it holds; start counts words."""
    docs = keyed(with_columns(docs, doc_id="bigint", text="string").select("doc_id", "text"))
    ready = store(prepare_items(items), "leaks-items")
    anchors = store(anchors_of(ready, threshold), "leaks-anchors")
    hit = store(places(docs, anchors, anchors.count() <= BROADCAST_ROWS).distinct(), "leaks-places")
    cuts = regions(docs, hit)
    shingled = cuts.select(*ROW, "n", "size", "chunk", "region", F.explode("starts").alias("start")).select(*ROW, "n", "size", "start", window().alias("window"))
    shingled = shingled.select(*ROW, "n", "start", F.explode(of_size("window", F.col("size"))).alias("hash"))
    taken = store(simhashes(shingled, *ROW, "n", "start"), "leaks-simhashes")
    profiles = ready.groupBy(F.xxhash64("words").alias("item")).agg(F.first("n").alias("n"), F.first("size").alias("size"), F.first("shingles").alias("shingles"))
    hashed = simhashes(profiles.select("item", F.explode("shingles").alias("hash")), "item").withColumnRenamed("simhash", "item_hash")
    index = store(profiles.join(hashed, "item"), "leaks-index")
    known = index.count()
    near = store(candidates(taken.select("n", "simhash").distinct(), index.select("item", "n", "item_hash"), known), "leaks-candidates")
    pairs = taken.join(small(near, near.count()), ["n", "simhash"]).join(small(index.select("item", "size", "shingles"), known), "item")
    pairs = pairs.withColumn("chunk", F.floor(F.col("start") / STEP).cast("int")).join(cuts.drop("starts", "size"), [*ROW, "n", "chunk"])
    pairs = pairs.select("doc_id", "item", "start", "size", "shingles", window().alias("window"))
    # filtered only after the aggregation, so that a similarity is worked out once
    found = pairs.select("doc_id", "item", "start", similarity(of_size("window", F.col("size")), "shingles").alias("similarity"))
    best = F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("start"))).alias("best")
    of = ready.select(F.xxhash64("words").alias("item"), "item_id")
    out = store(found.groupBy("doc_id", "item").agg(best).where(F.col("best.similarity") >= threshold).join(small(of, ready.count()), "item").groupBy("doc_id", "item_id").agg(F.max("best").alias("best")), "leaks-found")
    for scratch in (ready, anchors, hit, cuts, taken, index, near):
        discard(scratch)
    return out.select("doc_id", "item_id", (-F.col("best.start")).alias("start"), "best.similarity")


def drop_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no item, with their columns."""
    full = with_columns(docs, doc_id="bigint", text="string")
    (leak,) = fresh(full, "leak")
    found = store(leaks(full, items, threshold).select(F.col("doc_id").alias(leak)).distinct(), "leaks")
    kept = full.join(small(found, found.count()), F.col("doc_id").eqNullSafe(F.col(leak)), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
