"""Toxicity by a convolutional text classifier trained in numpy.

A word's embedding is the mean of hashed rows: of the whole word and of its first 3 to 6 bytes. Filters over one, two
and three neighbouring words slide over the whole text, the largest value of each is kept, and a logistic layer scores
them. The embedding's first column starts as the rows' log-odds in the training texts; all else is trained by AdaGrad.
A score is shifted so that 0.5 is the best threshold of the text's language, found on all training rows kept apart; the
language is told from function words of the text itself, so no other column is an input of a score.

The model is fitted on about SAMPLE labelled documents of each kind, those whose hash of the id is below a bound, and of
these, in the order of the hash, on as many whole texts as fit in BYTES. Of rows that repeat an id, the smallest text counts.
Thresholds sample nothing: the executors score every labelled document kept apart, and the driver gets counts by language
and STEPS of a logit.

Defined results: a null text is empty; a text without words has the score of the bias. Equal texts have equal scores.
Without labels of both kinds every score is the smoothed share of toxic labels. Very long texts are scored whole. Other
columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import discard, fresh, pieces, remainder, store, utf8, with_columns
from tarnlake.llm.words import Words, mix, words

#: Labelled documents of each kind that the model is fitted on, about, and the bytes of their texts at most.
SAMPLE, BYTES = 2000, 64 << 20
#: To a logit, of the counts that thresholds are chosen from.
STEPS = 256
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
PREFIXES = (3, 4, 5, 6)
EPOCHS, RATE = 3, 0.05
CHUNK = 1 << 18
#: Frequent function words by language.
FUNCTION_WORDS = {
    "de": "der die und das den von ist mit nicht ein eine zu auf für sich dem",
    "en": "the of and to in is that it was for on with be by are as",
    "es": "de la que el los se las por con una para del no su al como",
    "fr": "le les des et est une dans que pour pas qui sur au plus du par",
}
LANGUAGES = (*FUNCTION_WORDS, "")
OFFSETS = [(w, k) for w in WIDTHS for k in range(w)]


def features(w: Words, which: np.ndarray) -> np.ndarray:
    """The buckets of the words numbered by which: of the whole word and of its beginnings, which for a shorter word are the word."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.values)])
    begin, size = w.begins[which], w.lengths[which]
    out = np.empty((len(which), 1 + len(PREFIXES)), np.int64)
    out[:, 0] = (w.hashes[which] >> np.uint64(48)).astype(np.int64)
    for i, k in enumerate(PREFIXES):
        cut = mix((total[begin + np.minimum(size, k)] - total[begin]) ^ np.uint64(k))
        out[:, i + 1] = np.where(size >= k, (cut >> np.uint64(48)).astype(np.int64), out[:, 0])
    return out


def function_words() -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order, and languages x hashes of whether a word is in the list."""
    lists = [v.split() for v in FUNCTION_WORDS.values()]
    every = sorted({x for v in lists for x in v})
    raw = [x.encode() for x in every]
    h = words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])).hashes
    order = np.argsort(h)
    return h[order], np.array([[every[i] in v for i in order] for v in lists], np.float64)


@dataclass
class Cnn:
    embedding: np.ndarray
    filters: np.ndarray  #: offsets x DIM x FILTERS
    bias: np.ndarray  #: of filters, widths x FILTERS
    out: np.ndarray  #: widths x FILTERS
    base: float
    shift: np.ndarray  #: by language

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The score of each text."""
        logit, language = self.logits(data, off)
        return 1 / (1 + np.exp(-np.clip(logit - self.shift[language], -30, 30)))

    def logits(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The unshifted logit and the language of each text."""
        w = words(data, off)
        logit, language = np.full(len(off) - 1, self.base), np.full(len(off) - 1, len(LANGUAGES) - 1)
        full = np.flatnonzero(np.diff(w.offsets))
        if len(full):
            distinct, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
            pooled = self.pool(features(w, first), inverse, w.offsets, full)[0]
            logit[full] += (np.maximum(pooled + self.bias, 0) * self.out).sum((1, 2))
            language[full] = tell(distinct, inverse, w.offsets, full)
        return logit, language

    def pool(self, rows: np.ndarray, inverse: np.ndarray, off: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The largest value of each filter by text, and the values at each position; beyond a text's end stand zeros."""
        embedded = self.embedding[rows].mean(1)
        last = off[1:][full] - 1
        heads = off[:-1][full]
        out = np.empty((len(full), len(WIDTHS), FILTERS), np.float32)
        values = []
        for i, width in enumerate(WIDTHS):
            total = (embedded @ self.filters[OFFSETS.index((width, 0))])[inverse]
            for k in range(1, width):
                more = np.zeros_like(total)
                more[:-k] = (embedded @ self.filters[OFFSETS.index((width, k))])[inverse[k:]]
                for j in range(k):
                    edge = last - j
                    more[edge[edge >= heads]] = 0
                total += more
            out[:, i] = np.maximum.reduceat(total, heads)
            values.append(total)
        return out, values


def tell(distinct: np.ndarray, inverse: np.ndarray, off: np.ndarray, full: np.ndarray) -> np.ndarray:
    """The language of each text with words: the one of whose function words it has most, or none."""
    h, member = function_words()
    at = np.minimum(np.searchsorted(h, distinct), len(h) - 1)
    found = h[at] == distinct
    hits = np.where(found[:, None], member[:, at].T, 0)
    counts = np.add.reduceat(hits[inverse], off[:-1][full]) if found.any() else np.zeros((len(full), len(FUNCTION_WORDS)))
    return np.where(counts.max(1) > 0, counts.argmax(1), len(LANGUAGES) - 1)


def fit(texts: list[str], y: np.ndarray, apart: np.ndarray, seed: int = 5) -> Cnn:
    """apart: rows kept for the thresholds."""
    rng = np.random.default_rng(seed)
    shape = (len(OFFSETS), DIM, FILTERS)
    cnn = Cnn(np.zeros((BUCKETS, DIM), np.float32), np.zeros(shape, np.float32), np.zeros((len(WIDTHS), FILTERS), np.float32), np.zeros((len(WIDTHS), FILTERS), np.float32), 0.0, np.zeros(len(LANGUAGES)))
    learn = np.flatnonzero(~apart)
    if not len(learn) or len(set(y[learn])) < 2:
        rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.01
        cnn.base = float(np.log(rate / (1 - rate)))
        return cnn
    prepared = {}
    for i in learn:
        raw = np.frombuffer((texts[i] or "").encode(), np.uint8)
        w = words(raw, np.array([0, len(raw)]))
        if len(w.hashes):
            _, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
            prepared[i] = features(w, first), inverse
    seen = np.full((2, BUCKETS), 0.5)
    for i, (rows, _) in prepared.items():
        seen[int(y[i]), np.unique(rows)] += 1
    totals = np.array([(y[learn] == k).sum() + 1.0 for k in (0, 1)])
    odds = np.log(seen[1] / totals[1]) - np.log(seen[0] / totals[0])
    odds[seen.sum(0) < 4] = 0
    cnn.embedding = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    cnn.embedding[:, 0] = np.clip(odds, -1, 5) / 2
    cnn.filters = rng.normal(0, 0.2, shape).astype(np.float32)
    cnn.filters[0, 0, 0] = 2.0
    cnn.bias[:] = -0.5
    cnn.out = np.abs(rng.normal(0.2, 0.05, cnn.out.shape)).astype(np.float32)
    cnn.out[0, 0] = 2.0
    cnn.base = -2.0
    balance = np.array([0.5 / max((y[learn] == k).mean(), 1e-3) for k in (0, 1)])
    sums = [np.full(x.shape, 1e-2, np.float32) for x in (cnn.embedding, cnn.filters, cnn.bias, cnn.out)]
    base_sum = 1e-2
    one = np.zeros(1, np.int64)
    for epoch in range(EPOCHS):
        for i in rng.permutation(np.array(list(prepared))):
            rows, inverse = prepared[i]
            n = len(inverse)
            pooled, values = cnn.pool(rows, inverse, np.array([0, n]), one)
            active = np.maximum(pooled[0] + cnn.bias, 0)
            logit = float((active * cnn.out).sum()) + cnn.base
            error = float(balance[int(y[i])] * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[i]))
            if abs(error) < 1e-3:
                continue
            at_value = error * cnn.out * (active > 0)
            steps = (None, np.zeros(shape, np.float32), at_value, error * active)
            touched, grads = [], []
            for f, (width, k) in enumerate(OFFSETS):
                j = WIDTHS.index(width)
                at = values[j].argmax(0) + k
                ok = at < n
                bags = rows[inverse[at[ok]]]
                embedded = cnn.embedding[bags].mean(1)
                steps[1][f][:, ok] = embedded.T * at_value[j][ok]
                grad = cnn.filters[f][:, ok].T * at_value[j][ok][:, None] / bags.shape[1]
                touched.append(bags.ravel())
                grads.append(np.repeat(grad, bags.shape[1], 0))
            where, spot = np.unique(np.concatenate(touched), return_inverse=True)
            step = np.zeros((len(where), DIM), np.float32)
            np.add.at(step, spot, np.concatenate(grads))
            sums[0][where] += step * step
            cnn.embedding[where] -= RATE * step / np.sqrt(sums[0][where])
            for x, s, g in zip((cnn.filters, cnn.bias, cnn.out), sums[1:], steps[1:], strict=True):
                s += g * g
                x -= RATE * g / np.sqrt(s)
            base_sum += error * error
            cnn.base -= RATE * error / np.sqrt(base_sum)
    rows = np.flatnonzero(apart) if len(set(y[apart])) == 2 else learn
    raw = [(texts[i] or "").encode() for i in rows]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    logit, language = logits_of(cnn, data, off)
    calibrate(cnn, language, 1 - y[rows], y[rows], logit, logit)
    return cnn


def logits_of(cnn: Cnn, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The logits, within 30 of zero, and languages of the texts, a piece of them at a time."""
    parts = [cnn.logits(data[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in pieces(off, CHUNK)] or [(np.zeros(0), np.zeros(0, np.int64))]
    return np.clip(np.concatenate([x for x, _ in parts]), -30, 30), np.concatenate([x for _, x in parts])


def calibrate(cnn: Cnn, language: np.ndarray, clean: np.ndarray, toxic: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
    """Sets the shift of each language to the threshold of the largest F1, in the middle of the gap around it; a language with fewer than five rows of a kind has that of all. An entry counts the rows of a language whose logits lie from low to high."""

    def best(part: np.ndarray) -> float:
        part = part[np.argsort(-low[part], kind="stable")]
        hit, total = np.cumsum(toxic[part]), np.cumsum(clean[part] + toxic[part])
        k = int((2 * hit / (total + max(hit[-1], 1))).argmax())
        # entries of other languages may reach into the gap
        below = high[part][k + 1 :].max() if k + 1 < len(part) else low[part][k] - 1
        return float((low[part][k] + min(below, low[part][k])) / 2)

    cnn.shift[:] = best(np.arange(len(low)))
    for i in range(len(LANGUAGES)):
        part = np.flatnonzero(language == i)
        if min(toxic[part].sum(), clean[part].sum()) >= 5:
            cnn.shift[i] = best(part)


def counts(docs: DataFrame, labels: DataFrame, cnn: Cnn) -> list[np.ndarray]:
    """Of the labelled documents, each once, what calibrate() takes: languages, clean and toxic rows, least and largest logits by language and step."""
    shared = docs.sparkSession.sparkContext.broadcast(cnn)

    @F.arrow_udf("struct<logit:double,language:int>")
    def run(col: pa.Array) -> pa.Array:
        logit, language = logits_of(shared.value, *utf8(col))
        return pa.StructArray.from_arrays([pa.array(logit, pa.float64()), pa.array(language, pa.int32())], ["logit", "language"])

    scored = docs.select("doc_id", run("text").alias("at")).join(labels, "doc_id")
    one = scored.groupBy("doc_id").agg(F.min("at").alias("at"), F.max("toxic").alias("toxic")).select("at.*", "toxic")
    totals = [F.sum(1 - F.col("toxic")), F.sum("toxic"), F.min("logit"), F.max("logit")]
    found = one.groupBy("language", F.floor(F.col("logit") * STEPS).alias("step")).agg(*totals).drop("step").collect()
    return [np.array(x) for x in zip(*found, strict=True)]


def sample_of(docs: DataFrame, labels: DataFrame, sample: int) -> list:
    """Rows (doc_id, toxic, text) to fit on, in the order of doc_id. Repeated ids are one before anything is sent."""
    many = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    bound = F.coalesce(*[F.when(F.col("toxic") == k, F.lit(int(min(1.0, sample / n) * (1 << 40)))) for k, n in many.items()], F.lit(0))
    chosen = labels.withColumn("at", at).where(F.col("at") < bound)
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("toxic").alias("toxic"), F.first("at").alias("at"))
    rows = store(rows, "toxicity-sample")
    sizes = sorted((r["at"], r["doc_id"], r["size"]) for r in rows.select("at", "doc_id", F.octet_length("text").alias("size")).collect())
    room, fit_in = BYTES, []
    for _, key, size in sizes:
        if size <= room:
            room -= size
            fit_in.append(key)
    ids = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in fit_in], "doc_id bigint"))
    found = sorted(rows.join(ids, "doc_id").collect(), key=lambda r: r["doc_id"])
    discard(rows)
    return found


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Cnn:
    """Learns from labelled rows whose remainder isn't 0; all those with remainder 4 set the thresholds, or the others where they lack a kind."""
    spark = docs.sparkSession
    labels = with_columns(labels, doc_id="bigint", toxic="int").where("doc_id is not null and toxic is not null").where(remainder("doc_id") != 0)
    labels = labels.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    apart = remainder("doc_id") == 4
    docs = docs.select("doc_id", "text")
    kept = sample_of(docs, labels.where(~apart), sample)
    y = np.array([r["toxic"] for r in kept], np.int64)
    cnn = fit([r["text"] or "" for r in kept], y, np.zeros(len(y), bool))
    if len(set(y)) < 2:
        n, toxic = docs.select("doc_id").distinct().join(labels, "doc_id").agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        rate = (toxic + 0.5) / (n + 1) if n else 0.01
        cnn.base = float(np.log(rate / (1 - rate)))
        return cnn
    for fold in (apart, ~apart & (remainder("doc_id") != 0)):
        found = counts(docs.where(fold), labels.where(fold), cnn)
        if found and min(found[1].sum(), found[2].sum()):
            calibrate(cnn, *found)
            break
    return cnn


def score(docs: DataFrame, cnn: Cnn, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(cnn)

    @F.arrow_udf("double")
    def run(col: pa.Array) -> pa.Array:
        data, off = utf8(col)
        parts = [shared.value.scores(data[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in pieces(off, CHUNK)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(out, run(F.col(f"`{text}`")))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = with_columns(docs, doc_id="bigint", text="string").select("doc_id", "text")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (remainder("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't toxic, with their columns."""
    full = with_columns(docs, doc_id="bigint", text="string")
    (out,) = fresh(full, "toxic")
    return score(full, train(full, labels), out=out).where(F.col(out) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])
