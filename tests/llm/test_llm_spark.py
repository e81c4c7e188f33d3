"""The operators over small tables with nulls, empty and repeated rows, ties, clashing columns and no rows."""

import base64
import collections
import hashlib
import math
import random
import zlib

import pytest

from tarnlake.llm import bpe, chat, decontaminate, fingerprint, html, lm, neardup, quality, toxicity, warc
from tarnlake.llm.common import table
from tarnlake.llm.queries import CONTROL, vocabulary

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, keep string, ids string"
RNG = random.Random(3)
VOCABULARY = ["".join(RNG.choices("aeiourstlnd", k=RNG.randint(2, 7))) for _ in range(400)]
BASE = RNG.choices(VOCABULARY, k=150)


def prose(n):
    return " ".join(RNG.choices(VOCABULARY, k=n))


def edited(words, *places):
    out = list(words)
    for p in places:
        out[p] = f"edit{p}"
    return " ".join(out)


@pytest.fixture(scope="module")
def rows():
    item = prose(40)
    texts = {1: " ".join(BASE), 2: edited(BASE, 20), 3: " ".join(BASE), 4: edited(BASE, 60, 90), 5: prose(100), 6: "", 7: None, 8: prose(30) + " " + item.upper() + " " + prose(30), 9: "one two", 10: "One  two", 11: prose(20_000), 12: prose(50), 13: "x" * 3000, 14: edited(BASE, 20)}
    return item, [(i, t, "en", "s1", len(t or ""), 1.5, "k", "i") for i, t in texts.items()] + [(5, texts[5], "en", "s1", 1, None, None, None), (None, "a text without id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows[1], SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(1, 15)] + [(None, 1, None), (3, None, 1), (4, 0, 0)], "doc_id bigint, quality int, toxic int")


def test_lm(docs, none, rows):
    got = [r.asDict() for r in lm.score_documents(docs).collect()]
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t, *_ in rows[1] if i is not None}
    learned = [(i, t) for i, t, *_ in rows[1] if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1]
    count = collections.Counter(w for _, t in learned for w in (t or "").encode().lower().split() + [None])
    n, v = sum(count.values()), len(count)
    assert len(got) == len(rows[1]) and {r["train_tokens"] for r in got} == {n}
    for r in got:
        if r["doc_id"] is not None:
            want = tokens[r["doc_id"]]
            assert (r["n_tokens"], r["n_known"]) == (len(want), sum(count[w] > 0 for w in want))
            assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in want))
            assert r["score"] < 0 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
    assert sum(r["score"] for r in got if not r["held_out"]) > sum(r["base_score"] for r in got if not r["held_out"])
    assert lm.score_documents(none).count() == 0


def test_lm_prefers_what_it_saw(spark):
    """Of words after aa, the one that follows it most is the likeliest; an unknown one is less likely than those seen there."""
    vocabulary = ["aa", "bb", "cc", "dd"]
    learned = [(i, t) for i, t in enumerate(["aa bb aa bb", "aa cc", "bb aa dd", "aa bb"] * 5) if zlib.crc32(str(i).encode()) % 5 != 1]
    model = lm.train(spark.createDataFrame(learned, "doc_id bigint, text string").select("text"))
    texts = [(k, False, f"aa {w} aa") for k, w in enumerate([*vocabulary, "unknown"])]
    score = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(texts, "doc_id bigint, held_out boolean, text string"), model).collect()}
    assert all(s < 0 for s in score.values()) and max(score, key=score.get) == 1 and score[4] < min(score[2], score[3])


def test_lm_scores_by_plain_dictionaries(docs, rows):
    """The seats of the kept samples, put in dictionaries, give each document's score."""
    import numpy as np

    from tarnlake.llm.common import utf8
    import pyarrow as pa
    from pyspark.sql import functions as F

    split = docs.select(F.col("doc_id"), F.lit(False).alias("held_out"), "text")
    model = lm.train(split.where("doc_id % 2 = 0").select("text"))
    seats = [{} for _ in model.samples]
    root = [{} for _ in model.samples]
    customers = {}
    for r in model.states.collect():
        distinct, sizes, room, count, _, _, *kept = lm.unpack(r["blob"])
        for k, (w, q) in enumerate(zip(np.repeat(distinct, sizes).tolist(), room.tolist(), strict=True)):
            customers[w, q] = int(count[k])
            for s in range(len(seats)):
                seats[s][w, q] = int(kept[2 * s][k])
        for s in range(len(seats)):
            root[s] |= dict(zip(distinct.tolist(), kept[2 * s + 1].tolist(), strict=True))
    for s, t in enumerate(model.samples):
        root[s] |= dict(zip(model.spread.tolist(), t.spread_tables.tolist(), strict=True))
    got = {r["doc_id"]: r["score"] for r in lm.score(split.where("doc_id is not null"), model).collect()}
    texts = {i: t for i, t, *_ in rows[1] if i is not None}
    for i, text in texts.items():
        word, room, _ = lm.tokens(*utf8(pa.array([text], pa.string())))
        want = 0.0
        for w, q in zip(word.tolist(), room.tolist(), strict=True):
            p = 0.0
            for s, t in enumerate(model.samples):
                at_root = sum(n for (x, _), n in seats[s].items() if x == w)
                new = t.root_strength + t.root_discount * t.root_tables
                base = (at_root - t.root_discount * root[s].get(w, 0) + new / (t.words + 1)) / (t.root_strength + t.root_customers)
                mine = customers.get((w, q), 0) - t.discount * seats[s].get((w, q), 0)
                p += (mine + (t.strength + t.discount * t.tables[q]) * base) / (t.strength + t.customers[q]) / len(model.samples)
            want += math.log10(p)
        if len(word) < 500:
            assert got[i] == pytest.approx(want, rel=1e-9)
    for s, t in enumerate(model.samples):  # what each restaurant's totals should be
        for q in {q for _, q in customers}:
            assert t.tables[q] == sum(n for (_, x), n in seats[s].items() if x == q) and t.customers[q] == sum(n for (_, x), n in customers.items() if x == q)


def test_near_duplicates(docs, none):
    got = {(r["doc_id"], r["class_id"], r["keep"]) for r in neardup.near_duplicates(docs).collect()}
    classes = {i: c for i, c, _ in got if i is not None}
    assert [classes[i] for i in (1, 2, 3, 4, 14)] == [1] * 5 and classes[7] == classes[6] == 6 and classes[10] == classes[9] == 9
    assert all(classes[i] == i for i in (5, 8, 11, 12, 13)) and (None, None, True) in got
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 5, 6, 8, 9, 11, 12, 13]
    assert kept.where("doc_id is null").count() == 2
    assert neardup.near_duplicates(none).count() == 0 and neardup.keep_one(none).count() == 0


def test_near_duplicates_against_brute_force(spark):
    """Chains of edits, whose ends are not near each other, and many copies of one text."""
    rng = random.Random(8)
    texts, words = [], rng.choices(VOCABULARY, k=120)
    for i in range(60):
        texts.append(" ".join(words))
        if i % 3 == 2:
            words[rng.randrange(120)] = f"w{i}"
        if i % 20 == 19:
            words = rng.choices(VOCABULARY, k=120)
    texts += [texts[0]] * 50
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == label


def test_near_duplicates_after_a_round_without_links(spark, monkeypatch):
    """All in one bucket whose head links to none: two members that are near each other meet by what the head lacks."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(neardup, "bands", lambda classes: classes.select(F.lit(1).alias("key"), "id"))
    own = lambda i, n: [f"own{i}x{k}" for k in range(n)]
    texts = [BASE, *(BASE[: 110 - i] + own(i, 40) for i in range(1, 9))]
    texts += [BASE[:110] + own(9, 40), BASE[:110] + own(9, 39) + ["last"]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    assert got == {**{i: i for i in range(10)}, 10: 9}


def components_of(sets, t=0.8):
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9 and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("bounds", [{}, {"WHOLE": 0, "BROADCAST_ROWS": 0, "BLOCK": 4, "TABLES": 1}, {"WHOLE": 4}])
def test_every_link_in_a_bucket_is_found(spark, monkeypatch, bounds):
    """One bucket of all: chains, truncations and extensions of the head, families that aren't near it, unrelated texts; no link is lost at any size."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(neardup, "bands", lambda classes: classes.select(F.lit(1).cast("bigint").alias("key"), "id"))
    for k, v in bounds.items():
        monkeypatch.setattr(neardup, k, v)
    rng = random.Random(41)
    new = lambda n: [f"n{rng.getrandbits(40)}" for _ in range(n)]
    main = new(100)
    texts = [main, main[:70], main[:72], main[:70] + new(1), main[30:], main[28:], main + new(60), main[:50]]
    texts += [main[:80] + own for own in [new(30)] for _ in range(1)] + [main[:80] + new(30) for _ in range(6)]
    for _ in range(3):
        family = rng.choice([main[:60], new(20)]) + new(60)
        for i in range(8):
            texts.append(list(family))
            family[rng.randrange(len(family))] = f"e{i}"
            if i % 2:
                family[rng.randrange(len(family))] = f"f{i}"
    texts += [new(rng.randint(1, 60)) for _ in range(6)]
    texts = [" ".join(t) for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == components_of(sets)


def test_rounds_of_near_duplicates_do_not_grow_with_groups(spark, monkeypatch):
    """Buckets of many times WHOLE members, most of them near no other: a star and one comparison of open pairs find all links."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(neardup, "bands", lambda classes: classes.select(F.lit(1).cast("bigint").alias("key"), "id"))
    monkeypatch.setattr(neardup, "WHOLE", 2)
    calls, compare = [], neardup.compare
    monkeypatch.setattr(neardup, "compare", lambda *args: calls.append(args) or compare(*args))
    rng = random.Random(7)
    main = [f"m{i}" for i in range(90)]
    texts = [main]
    for i in range(40):
        own = list(main)
        for k in rng.sample(range(9), 3) if i % 4 else [0, 4, 8]:  # of nine places, so that many lack the same shingles
            own[k * 10] = f"o{i % 10}x{k}"
        texts.append(own)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in texts]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == components_of(sets)
    assert len(set(got.values())) > 5 and len(calls) == 2


def test_near_duplicates_of_repeated_ids(spark):
    """Rows of one id with other texts are told apart by their text; what is kept doesn't depend on the order of rows."""
    other = prose(60)
    rows = [(1, " ".join(BASE), "a"), (1, other, "b"), (2, other, "c"), (1, " ".join(BASE), "z"), (3, edited(BASE, 20), "d"), (3, edited(BASE, 21), "e"), (4, prose(50), None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, __name string")
    got = collections.Counter((r["doc_id"], r["class_id"], r["keep"]) for r in neardup.near_duplicates(frame).collect())
    assert got == {(1, 1, True): 3, (2, 1, False): 1, (3, 1, False): 2, (4, 4, True): 1}
    kept = [sorted(map(tuple, neardup.keep_one(frame.repartition(n)).collect()), key=str) for n in (1, 2, 5)]
    assert kept[0] == kept[1] == kept[2] and sorted((i, t) for i, t, _ in kept[0]) == sorted({(1, " ".join(BASE)), (1, other), (4, rows[-1][1])})


def test_decontamination(spark, docs, none, rows):
    item = rows[0]
    items = spark.createDataFrame([(1, item, "x"), (2, None, "y"), (3, "", "z"), (4, "one TWO", ""), (5, item, ""), (6, prose(30), "")], "item_id bigint, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["similarity"]) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(8, 1): (30, 1.0), (8, 5): (30, 1.0), (9, 4): (0, 1.0), (10, 4): (0, 1.0)}
    kept = decontaminate.drop_leaks(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0


def test_decontamination_against_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    items = [[rng.choice(VOCABULARY) for _ in range(rng.choice([12, 45, 60]))] for _ in range(8)]
    texts = []
    for k in range(40):
        w = list(items[k % 8])
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = f"e{k}"
        texts.append([rng.choice(VOCABULARY) for _ in range(k % 3 * 7)] + w + [rng.choice(VOCABULARY) for _ in range(k % 2 * 9)])
    bag = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    want = set()
    for i, t in enumerate(texts):
        for j, w in enumerate(items):
            n = len(w)
            if any((a := bag(t[s : s + n]), b := bag(w)) and sum((a & b).values()) >= 0.8 * sum((a | b).values()) for s in range(max(1, len(t) - n + 1))):
                want.add((i, j))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    table_of = spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)], "item_id bigint, text string")
    for bound in (decontaminate.BROADCAST_ROWS, 0):  # the second way joins without broadcasts
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", bound)
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, table_of).collect()} == want


def test_decontamination_of_shifted_windows(spark, monkeypatch):
    """Words put in, left out or moved, so that windows beside the aligned ones are the best."""
    rng = random.Random(21)
    bag = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    near = lambda a, b: sum((bag(a) & bag(b)).values()) / sum((bag(a) | bag(b)).values())
    items, texts = [], []
    for k in range(4):
        item, other = ([f"{rng.choice(VOCABULARY)}{i}" for i in range(60)] for _ in range(2))
        changed = [item[30:] + item[:30], item[:8] + ["new"] + item[8:], item[:20] + item[22:], item[12:] + item[:12]][k]
        items.append(item)
        texts.append(other[:30] + changed + other[30:])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    table_of = spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)], "item_id bigint, text string")
    for bound in (decontaminate.BROADCAST_ROWS, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", bound)
        got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(docs, table_of).collect()}
        assert got == {(i, i): pytest.approx(max(near(t[s : s + 60], items[i]) for s in range(len(t) - 59))) for i, t in enumerate(texts)}


def test_decontamination_of_null_ids_both_ways(spark, docs, monkeypatch):
    items = spark.createDataFrame([(1, "a text without id")], "item_id bigint, text string")
    for bound in (decontaminate.BROADCAST_ROWS, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", bound)
        assert [(r["doc_id"], r["item_id"], r["start"]) for r in decontaminate.leaks(docs, items).collect()] == [(None, 1, 0)]


def test_simhash_blocks_find_all_within_the_radius(spark):
    """Against the Hamming distance of all pairs, at every distance, by both joins."""
    rng = random.Random(1)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    items = [rng.getrandbits(64) for _ in range(20)]
    hashes = []
    for bits in range(25):
        for x in items[bits % 5 :: 5]:
            for k in rng.sample(range(64), bits):
                x ^= 1 << k
            hashes.append(x)
    want = {(signed(h), i) for h in hashes for i, x in enumerate(items) if (h ^ x).bit_count() <= decontaminate.RADIUS}
    assert len(want) > 50
    left = spark.createDataFrame([(40, signed(h)) for h in hashes], "n int, simhash bigint").distinct()
    right = spark.createDataFrame([(i, 40, signed(x)) for i, x in enumerate(items)], "item bigint, n int, item_hash bigint")
    for rows in (len(items), 1 << 40):
        got = decontaminate.candidates(left, right, rows).collect()
        assert {(r["simhash"], r["item"]) for r in got} == want and len(got) == len(want)


def test_simhash_is_the_majority_of_bits(spark):
    rng = random.Random(2)
    groups = {k: [rng.getrandbits(64) - (1 << 63) for _ in range(n)] for k, n in enumerate((1, 2, 3, 8, 55))}
    groups[5] = [-1] * 4 + [0] * 3
    rows = spark.createDataFrame([(k, h) for k, v in groups.items() for h in v], "k int, hash bigint")
    for r in decontaminate.simhashes(rows, "k").collect():
        hashes = groups[r["k"]]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert r["simhash"] % (1 << 64) == want


def test_decontamination_recall_at_the_threshold(spark):
    """Of windows at 0.8 to 0.85, items of 9 to 60 words, at least 95 in 100 are found; above, 99."""
    rng = random.Random(77)
    bag = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    near = lambda a, b: sum((bag(a) & bag(b)).values()) / sum((bag(a) | bag(b)).values())
    items = [[rng.choice(VOCABULARY) for _ in range(9 + k % 52)] for k in range(150)]
    texts, want = [], {}
    while len(texts) < 900:
        j = len(texts) % len(items)
        w = list(items[j])
        for _ in range(rng.randint(1, 3)):
            w[rng.choice([0, 1, 2, -1, -2, -3, rng.randrange(len(w))])] = rng.choice(VOCABULARY)
        if (s := near(w, items[j])) >= 0.8:
            want[len(texts), j] = s
        texts.append(w)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    table_of = spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, table_of).collect()}
    for low, high, share in ((0.8, 0.85, 0.95), (0.85, 1.01, 0.99)):
        part = [k for k, s in want.items() if low <= s < high]
        assert len(part) > 60 and sum(k in got for k in part) >= share * len(part)
    assert got <= set(want)


def test_decontamination_of_long_and_clashing_rows(spark, docs):
    from pyspark.sql import functions as F

    item = ["w%d" % i for i in range(30)]
    rows = [(1, " ".join(["filler"] * 20_000 + item + ["filler"] * 5)), (2, " ".join(item[:27])), (3, " ".join(["x"] * 9 + item[:26])), (4, " ".join(item)), (4, "other words here"), (None, " ".join(item))]
    table_of = spark.createDataFrame([(1, " ".join(item)), (7, " ".join(item)), (8, "filler " * 40)], "item_id bigint, text string")
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"__leak": F.lit(1), "row": F.lit(2), "n": F.lit(3), "start": F.lit("s")})
    got = {(r["doc_id"], r["item_id"]): r["start"] for r in decontaminate.leaks(frame, table_of).collect()}
    assert got == {**{(d, i): s for i in (1, 7) for d, s in ((1, 20_000), (2, 0), (3, 9), (4, 0), (None, 0))}, (1, 8): 0}
    kept = decontaminate.drop_leaks(frame, table_of)
    assert kept.columns == frame.columns and kept.count() == 0


def test_quality(docs, none, labels):
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 < r["score"] < 1 and 0 < r["host_rate"] < 1 for r in got)
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.classify(docs, labels.limit(0)).where("not keep").count() == 0
    assert quality.classify(none, labels).count() == 0 and quality.keep_good(none, labels).count() == 0


GOOD, BAD = "The quick words of a plain text go on and on here. " * 3, "%%% ### @@@ !!! $$$ *** " * 3


def test_quality_shrinks_sites(spark):
    """A path of few rows stays near its host, a host of few rows near all; large ones go their way."""
    rows = [(i, GOOD if i % 10 else BAD, "good.org/a") for i in range(200)] + [(200 + i, BAD if i % 10 else GOOD, "https://bad.org/a/b") for i in range(200)] + [(400, BAD, "good.org/tiny"), (401, GOOD, "new.org")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(i, int("plain" in t), 0) for i, t, *_ in rows[:350]], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert got[1]["keep"] and not got[0]["keep"] and got[1]["path_rate"] > 0.8 and got[201]["path_rate"] < 0.2
    assert got[400]["path_rate"] > 0.3 and 0.3 < got[401]["host_rate"] < 0.95
    assert all(got[i]["keep"] == ("plain" in t) for i, t, *_ in rows)


@pytest.mark.parametrize("bound", [quality.BROADCAST_ROWS, 0])
def test_quality_posteriors_against_brute_force(spark, monkeypatch, bound):
    """Each rate without the document itself, from plain sums over the others of its host and path."""
    monkeypatch.setattr(quality, "BROADCAST_ROWS", bound)
    rng = random.Random(51)
    sources = ["a.org/x/1", "a.org/x/2?q", "http://a.org/y", "b.org", "B.org/", "c.org/z", None, ""]
    rows = [(i, prose(rng.randint(3, 40)) + (" %%% ###" * rng.randint(0, 9) if rng.random() < 0.5 else ""), rng.choice(sources)) for i in range(120)]
    docs = spark.createDataFrame([*rows, (121, "alone", "only.org/p")], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(i, int("%" not in t)) for i, t, _ in rows], "doc_id bigint, quality int")
    counted = quality.counted_documents(docs)
    model = quality.train(counted, labels)
    base = [(r["doc_id"], r["host"], r["path"], model.evidence.of(__import__("numpy").array([r["counts"]]))[0]) for r in counted.collect()]
    assert {(h, p) for _, h, p, _ in base} == {("a.org", "x"), ("a.org", "y"), ("b.org", ""), ("c.org", "z"), ("", ""), ("only.org", "p")}
    prior = math.log(model.evidence.prior / (1 - model.evidence.prior))
    part = {i: 1 / (1 + math.exp(-(e + prior))) for i, _, _, e in base}
    got = {r["doc_id"]: r for r in quality.score(counted, model).collect()}
    for i, h, p, e in base:
        near = [part[j] for j, g, _, _ in base if g == h and j != i]
        host = (sum(near) + model.host_strength * model.mean) / (len(near) + model.host_strength)
        own = [part[j] for j, g, q, _ in base if (g, q) == (h, p) and j != i]
        path = (sum(own) + model.path_strength * host) / (len(own) + model.path_strength) if p else host
        assert got[i]["host_rate"] == pytest.approx(host) and got[i]["path_rate"] == pytest.approx(path)
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-(e + math.log(path / (1 - path))))), rel=1e-6)
    assert got[121]["path_rate"] == pytest.approx(model.mean)
    sums = {}
    for i, h, _, _ in base:
        sums.setdefault(h, []).append(part[i])
    n, good = len(base), sum(part.values())
    mean = (good + 1) / (n + 2)
    spread = sum(sum(v) ** 2 / len(v) for v in sums.values()) / n - (good / n) ** 2 - mean * (1 - mean) * len(sums) / n
    assert model.mean == pytest.approx(mean) and model.host_strength == pytest.approx(min(1000, max(1, mean * (1 - mean) / max(spread, 1e-9) - 1)))


def test_quality_sample_and_repeated_ids(spark):
    """About as many as asked for by a hash of the id, the same ones each time; of a repeated id the smallest counts."""
    docs = spark.createDataFrame([(i, prose(5), "s", "x") for i in range(2000)] + [(3, "a b", "s", "x")] * 50, "doc_id bigint, text string, source string, counts string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id bigint, quality int")
    counted = quality.counted_documents(docs)
    x, y = quality.sample_of(counted, labels, 300)
    again = quality.sample_of(counted.repartition(3), labels, 300)
    assert 220 < len(y) < 380 and (x == again[0]).all() and (y == again[1]).all() and len(quality.sample_of(counted, labels, 5000)[1]) == 2000
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_toxicity(docs, none, labels):
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert {r["held_out"] for r in got if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0} <= {True}
    scores = collections.defaultdict(set)
    for r in got:
        scores[r["doc_id"]].add(r["score"])
    assert scores[1] == scores[3] and len(scores[5]) == 1
    assert toxicity.keep_clean(docs, labels).columns == docs.columns
    assert toxicity.classify(none, labels).count() == 0 and toxicity.classify(docs, labels.limit(0)).count() == docs.count()


def test_toxicity_thresholds_from_all_rows_kept_apart(spark):
    """However few rows are fitted, the threshold is the best one over every labelled row of its fold."""
    rng = random.Random(12)
    rows = [(i, int(i % 9 == 0)) for i in range(4000)]
    texts = [(i, f"word zo{rng.choices(range(10), [(k + 1 if y else 10 - k) ** 2 for k in range(10)])[0]}mark") for i, y in rows]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    model = toxicity.train(docs, spark.createDataFrame(rows, "doc_id bigint, toxic int"), 150)
    fold = [(r["score"], dict(rows)[r["doc_id"]]) for r in toxicity.score(docs.where("crc32(string(doc_id)) % 5 = 4"), model).collect()]
    f1 = lambda least: 2 * sum(y for s, y in fold if s >= least) / (sum(s >= least for s, _ in fold) + sum(y for _, y in fold))
    assert len(fold) > 700 and f1(0.5) > max(f1(s) for s, _ in fold) - 0.005


def test_toxicity_sample(spark, monkeypatch):
    """About as many of each kind as asked for, whole texts within the bytes, one row for an id, whatever the order of rows."""
    rows = [(i, f"text {i}") for i in range(3000)] + [(7, f"a{k}") for k in range(40)] + [(8, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(3000)], "doc_id bigint, toxic int")
    found = [[tuple(r) for r in toxicity.sample_of(docs.repartition(n), labels, 400)] for n in (1, 5)]
    ids = [r[0] for r in found[0]]
    assert found[0] == found[1] and len(set(ids)) == len(ids) and all(320 < sum(r[2] == k for r in found[0]) < 480 for k in (0, 1))
    every = {r["doc_id"]: r["text"] for r in toxicity.sample_of(docs, labels, 5000)}
    assert len(every) == 3000 and every[7] == "a0" and every[8] == ""
    monkeypatch.setattr(toxicity, "BYTES", 900)
    assert 0 < sum(len(r["text"]) for r in toxicity.sample_of(docs, labels, 5000)) <= 900


def test_operators_with_clashing_columns(docs, labels):
    """Columns named as the operators' own helper and result columns stay as they are, and change nothing."""
    from pyspark.sql import functions as F

    names = ("host", "path", "counts", "own", "evidence", "keep_", "__toxic", "__name", "__turn", "id", "a", "b", "label", "signature", "class_id", "held_out", "predicted", "fingerprint", "helper", "at", "code", "word", "kind", "bucket")
    clash = docs.withColumns({n: F.lit(f"x{n}") for n in names})
    plain = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert plain(quality.classify(clash, labels)) == plain(quality.classify(docs, labels))
    assert plain(toxicity.classify(clash, labels)) == plain(toxicity.classify(docs, labels))
    assert plain(fingerprint.compare_edited(clash)) == plain(fingerprint.compare_edited(docs))
    assert plain(neardup.near_duplicates(clash)) == plain(neardup.near_duplicates(docs))
    for kept in (quality.keep_good(clash, labels), toxicity.keep_clean(clash, labels), neardup.keep_one(clash)):
        assert kept.columns == clash.columns and {r["path"] for r in kept.select("path").collect()} <= {"xpath"}


def test_operators_with_a_very_long_text(spark):
    """A text of three megabytes between short ones goes whole through every operator on documents."""
    rng = random.Random(61)
    long = " ".join(rng.choices(VOCABULARY, k=500_000))
    rows = [(i, prose(40)) for i in range(2, 12)] + [(0, long), (1, long[:-6] + " other")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(12)], "doc_id bigint, quality int, toxic int")
    classes = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    assert classes[1] == 0 and all(classes[i] == i for i in range(2, 12))
    tokens = {r["doc_id"]: r["n_tokens"] for r in lm.score_documents(docs).collect()}
    assert tokens[0] == 500_001
    near = {r["doc_id"]: r for r in fingerprint.compare_edited(docs).collect()}
    assert near[0]["n_chars"] == len(long) and near[1]["near_next"] > 0.99
    assert quality.classify(docs, labels).count() == toxicity.classify(docs, labels).count() == 12
    item = spark.createDataFrame([(1, " ".join(long.split()[400_000:400_050]))], "item_id bigint, text string")
    assert {(r["doc_id"], r["start"]) for r in decontaminate.leaks(docs, item).collect()} == {(0, 400_000), (1, 400_000)}


def test_labels_column_changes_no_score(docs, labels):
    from pyspark.sql import functions as F

    a = toxicity.classify(docs, labels)
    b = toxicity.classify(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")), labels)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_bpe(docs, none, rows):
    pytest.importorskip("public_tokenizers")
    content = vocabulary()
    got = bpe.documents_round_trip(docs, content).collect()
    assert len(got) == len(rows[1])
    texts = {i: t or "" for i, t, *_ in rows[1] if i is not None}
    for r in got:
        if r["doc_id"] is not None:
            assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() and (r["n_tokens"] == 0) == (texts[r["doc_id"]] == "")
    both = bpe.decode(bpe.encode(docs, content, out="ids2"), content, "ids2", "back")
    assert both.where("not (coalesce(text, '') <=> back)").count() == 0 and set(docs.columns) < set(both.columns)
    assert bpe.documents_round_trip(none, content).count() == 0


def test_fingerprints(docs, none, spark):
    got = fingerprint.compare_edited(docs).collect()
    assert len(got) == docs.count()
    order = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in docs.collect()), key=lambda x: (-x[0], x[1]))
    want = collections.Counter()
    for k, (i, t) in enumerate(order):
        after, n = order[(k + 1) % len(order)][1], len(t) // 3
        want[i, len(t), hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()] += 1
    assert collections.Counter((-1 if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == by[3]["fingerprint"] and by[2]["near_next"] > 0.5 > by[11]["near_next"] and by[11]["near_edited"] > 0.5
    assert fingerprint.compare_edited(none).count() == 0
    (only,) = fingerprint.compare_edited(spark.createDataFrame([(1, "abc def", 2)], "doc_id bigint, text string, helper int")).collect()
    assert only["near_next"] == 1.0


@pytest.mark.parametrize("bound", [warc.BROADCAST_ROWS, 0])
def test_warc(spark, monkeypatch, bound):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", bound)
    rows = [(1, "http://a", "same", 0), (5, "http://b", "same", 0), (5, "http://b", "same", 0), (None, None, "same", 0), (2, "http://c", None, 0), (3, "http://d", "", 0), (4, "http://e", "é" * 5000, 0)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, sha int").withColumnRenamed("sha", "kept")
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect())
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert got == collections.Counter({(1, 4, digest("same"), "revisit", 5): 1, (5, 4, digest("same"), "response", None): 2, (None, 4, digest("same"), "revisit", 5): 1, (2, 0, digest(""), "revisit", 3): 1, (3, 0, digest(""), "response", None): 1, (4, 10000, digest("é" * 5000), "response", None): 1})
    assert warc.round_trip(pages, min_bytes=5).where("record_type <> 'response'").count() == 0
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_sidecar_fetches_single_records(spark):
    pages = spark.createDataFrame([(i, f"http://{i}", prose(30)) for i in range(40)], "page_id bigint, url string, html string")
    data, sidecar = warc.normalise_archives(warc.write(pages))
    assert sidecar.columns == ["archive", "part", "record", "offset", "length"] and sidecar.count() == 40 and "index" not in data.columns
    texts = {r["page_id"]: r["html"] for r in pages.collect()}
    wanted = sidecar.where(sidecar["record"].isin(warc.record_id(7), warc.record_id(33)))
    assert {r["page_id"]: r["payload"] for r in warc.read(data, wanted).collect()} == {k: texts[k] for k in (7, 33)}


def test_chat(spark):
    rows = [(1, 1, "assistant", CONTROL, "x"), (1, 0, "user", None, "x"), (2, 0, None, "no role", None), (None, 0, "user", "no id", None), (3, 0, "assistant", "twice", None), (3, 0, "assistant", "twice", None), (4, 2, "assistant", "<\\|<", None)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, part string")
    got = {r["conv_id"]: r.asDict() for r in chat.read_back(chat.format_conversations(turns)).collect()}
    want = collections.defaultdict(list)
    for c, t, r, x, _ in sorted(rows, key=lambda r: (r[0] or 0, r[1])):
        want[c].append((r or "", x or ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for c, said in want.items():
        loss = "".join(x for r, x in said if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), sha("".join(f"{r}\n{x}\n" for r, x in said)), len(loss), sha(loss))
    assert len(got) == len(want) and chat.format_conversations(turns.limit(0)).count() == 0


def test_chat_templates_that_read_messages_twice_or_never(spark):
    turns = spark.createDataFrame([(c, t, "user", f"{c}{t}") for c in range(3) for t in range(2)], "conv_id bigint, turn int, role string, text string")
    said = lambda template: {r["conv_id"]: r["text"] for r in chat.format_conversations(turns, template).collect()}
    loop = "{% for m in messages %}{{ m.text }},{% endfor %}"
    assert said("hi") == {c: "hi" for c in range(3)}
    assert said(loop + "|" + loop) == {c: f"{c}0,{c}1,|{c}0,{c}1," for c in range(3)}
    assert said("{% if messages %}{{ messages | length }}{% endif %}" + loop) == {c: f"2{c}0,{c}1," for c in range(3)}
    assert said("{% for m in messages %}{% for n in messages %}{{ n.text }},{% endfor %}|{% endfor %}") == {c: f"{c}0,{c}1,|" * 2 for c in range(3)}
    assert chat.Template(chat.TEMPLATE).streams and not chat.Template(loop + loop).streams


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>Some text of a page.</p></article>", "t"), (1, "u", "<article><p>Some text of a page.</p></article>", "t"), (None, None, None, None), (2, "u", "", "")], "page_id bigint, url string, html string, text string")
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html.main_text(pages).collect())
    assert got == [(0, "", 0), (1, "Some text of a page.", 20), (1, "Some text of a page.", 20), (2, "", 0)]
    assert html.main_text(pages.limit(0)).count() == 0


def test_pipeline(spark, rows, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    d = str(tmp_path)
    spark.createDataFrame(rows[1], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, rows[0])], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, d).where("doc_id is not null").collect()}
    assert sorted(got) == [1, 5, 6, 9, 11, 12, 13] and all(r["exact"] for r in got.values()) and got[6]["n_tokens"] == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), d).count() == 0
    assert table(spark, d, "documents").count() == len(rows[1])
