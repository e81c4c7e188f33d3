"""Quality classifier by hierarchical empirical Bayes.

A logistic model on counts of a text's bytes and words gives each document evidence: the log-likelihood ratio of good
against bad. Sites are a hierarchy: all, hosts, paths of a host. Grouped sums of the documents' posteriors (of evidence and
the share of good labels) give each site's rate; a host's rate shrinks toward the global rate, a path's toward its host's, as
beta posteriors whose strengths come from the spread between sites by the method of moments. A document's score is the
posterior of its evidence with its path's rate as the prior, where its own part is taken out of the sums of its host and
path: no document counts twice, and one that is alone on its site has the rate of what stands above. A source is
[scheme://]host[/path]; the first directory of the path counts, and a document without one has its host's rate.

The model is fitted on the labelled documents whose hash of the id is below a bound, chosen so that about SAMPLE of them are;
of rows that repeat an id, that with the smallest counts. The site rates take in all rows.

Defined results: a null text is empty and an empty one has all counts zero; a null host is an empty one. Rows are scored
one by one, so repeated rows have equal scores; of several labels of an id the mean counts. Without labels of both kinds the
evidence is zero and everything is kept. An empty table gives none. Other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import discard, pieces, store, utf8, with_columns
from tarnlake.llm.words import words

#: Labelled documents that the model is fitted on, about.
SAMPLE = 20_000
RIDGE = 1.0
#: Rows of about 100 bytes of the table of site rates that may be broadcast.
BROADCAST_ROWS = 100_000
CHUNK = 1 << 18

UPPER, ALPHA, DIGIT, MARK, LINE = (np.zeros(256, bool) for _ in range(5))
UPPER[65:91] = True
ALPHA[65:91] = ALPHA[97:123] = True
ALPHA[128:] = True
DIGIT[48:58] = True
MARK[33:127] = True
MARK &= ~ALPHA & ~DIGIT
MARK[[44, 46]] = False  # comma and full stop are prose
LINE[10] = True
NAMES = ("upper", "marks", "digits", "bare_words", "repeats", "near_repeats", "word_bytes", "lines", "log_words")


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text."""
    n = len(off) - 1
    w = words(data, off)

    def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[at[1:]] - total[at[:-1]]).astype(np.float64)

    count = np.diff(w.offsets).astype(np.float64)
    alpha = per_text(ALPHA[data], off)
    ink = per_text(data > 32, off)
    out = np.zeros((n, len(NAMES)))
    out[:, 0] = per_text(UPPER[data], off) / np.maximum(alpha, 1)
    out[:, 1] = per_text(MARK[data], off) / np.maximum(ink, 1)
    out[:, 2] = per_text(DIGIT[data], off) / np.maximum(ink, 1)
    if len(w.hashes):
        bare = ~np.logical_or.reduceat(ALPHA[w.raw], w.begins)
        out[:, 3] = per_text(bare, w.offsets) / np.maximum(count, 1)
        for k, column in ((1, 4), (2, 5)):
            same = np.zeros(len(w.hashes), bool)
            same[k:] = w.hashes[k:] == w.hashes[:-k]
            for j in range(k):
                edge = w.offsets[:-1] + j
                same[edge[edge < len(same)]] = False
            out[:, column] = per_text(same, w.offsets) / np.maximum(count, 1)
    out[:, 6] = np.minimum(ink / np.maximum(count, 1), 50) / 10
    out[:, 7] = per_text(LINE[data], off) / np.maximum(count, 1)
    out[:, 8] = np.log1p(count)
    return out


@dataclass(frozen=True)
class Evidence:
    """Log-likelihood ratio of good against bad: scaled counts times weights, plus bias."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float  #: share of good rows in the sample

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias


def fit(x: np.ndarray, y: np.ndarray) -> Evidence:
    """A ridge logistic regression by Newton steps, both kinds with equal weight, so its margin is the ratio itself."""
    d = len(NAMES)
    good = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < good < 1:
        return Evidence(np.zeros(d), np.ones(d), np.zeros(d), 0.0, (y.sum() + 1) / (len(y) + 1) if len(y) else 1.0)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])
    weight = np.where(y > 0.5, 0.5 / good, 0.5 / (1 - good))
    beta, ridge = np.zeros(d + 1), np.append(np.full(d, RIDGE), 1e-6)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(h, z.T @ (weight * (y - p)) - ridge * beta)
        beta += step * min(1.0, 3 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return Evidence(mean, scale, beta[:-1], float(beta[-1]), good)


def count_udf():
    @F.arrow_udf("array<float>")
    def run(col: pa.Array) -> pa.Array:
        data, off = utf8(col)
        rows = [features(data[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in pieces(off, CHUNK)]
        flat = np.concatenate(rows).astype(np.float32) if rows else np.zeros((0, len(NAMES)), np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * len(NAMES)), pa.array(flat.ravel()))

    return run


def evidence_of(counts: str, model: Evidence) -> F.Column:
    """The evidence as an expression of the array of counts."""
    out = F.lit(model.bias)
    for i in range(len(NAMES)):
        scaled = (F.col(counts)[i].cast("double") - F.lit(float(model.mean[i]))) / F.lit(float(model.scale[i]))
        out = out + F.least(F.greatest(scaled, F.lit(-8.0)), F.lit(8.0)) * F.lit(float(model.weights[i]))
    return out


def logit(p: F.Column) -> F.Column:
    return F.log(p / (1 - p))


def sigmoid(x: F.Column) -> F.Column:
    return 1 / (1 + F.exp(-x))


@dataclass
class Model:
    evidence: Evidence
    rates: DataFrame  #: host, path, host_good, host_n, path_good, path_n
    rows: int  #: of rates
    mean: float  #: of all hosts
    host_strength: float
    path_strength: float


def strength(rates: DataFrame) -> tuple[float, float]:
    """The mean of the rates, and the beta strength that their spread says: m (1 - m) / variance - 1, from 1 to 1000. rates: good and n of each site."""
    row = rates.agg(F.sum("good").alias("good"), F.sum("n").alias("n"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("square"), F.count(F.lit(1)).alias("sites")).first()
    if not row["n"]:
        return 1.0, 1.0
    mean = (row["good"] + 1) / (row["n"] + 2)
    spread = max(0.0, row["square"] / row["n"] - (row["good"] / row["n"]) ** 2 - mean * (1 - mean) * row["sites"] / row["n"])
    return mean, float(np.clip(mean * (1 - mean) / max(spread, 1e-9) - 1, 1, 1000))


def own_part(model: Evidence) -> F.Column:
    """What a document adds to the sums of its sites: its posterior with the share of good labels as the prior."""
    prior = min(max(model.prior, 1e-3), 1 - 1e-3)
    return sigmoid(evidence_of("counts", model) + F.lit(float(np.log(prior / (1 - prior)))))


def sample_of(counted: DataFrame, labels: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and labels of about so many labelled documents: all, or those whose hash of the id is below a bound."""
    labels = with_columns(labels, doc_id="bigint", quality="int").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("label"))
    share = min(1.0, sample / max(1, labels.count()))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    rows = counted.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("counts").alias("counts"), F.first("label").alias("label")).collect()
    rows = sorted(rows, key=lambda r: r["doc_id"])
    return np.array([r["counts"] for r in rows], np.float64).reshape(-1, len(NAMES)), np.array([r["label"] for r in rows], np.float64)


def train(counted: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """counted: doc_id, host, path and counts of all documents."""
    model = fit(*sample_of(counted, labels, sample))
    paths = store(counted.groupBy("host", "path").agg(F.sum(own_part(model)).alias("good"), F.count(F.lit(1)).alias("n")), "quality-paths")
    hosts = store(paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n")), "quality-hosts")
    mean, a = strength(hosts)
    _, b = strength(paths)
    rates = paths.select("host", "path", F.col("good").alias("path_good"), F.col("n").alias("path_n")).join(hosts.select("host", F.col("good").alias("host_good"), F.col("n").alias("host_n")), "host")
    rates = store(rates, "quality-rates")
    for scratch in (paths, hosts):
        discard(scratch)
    return Model(model, rates, rates.count(), mean, a, b)


def score(counted: DataFrame, model: Model) -> DataFrame:
    """counted (host, path, counts) with evidence, host_rate, path_rate, score and keep; the rates are those without the row itself."""
    rates = F.broadcast(model.rates) if model.rows <= BROADCAST_ROWS else model.rates
    out = counted.join(rates, ["host", "path"], "left").withColumn("evidence", evidence_of("counts", model.evidence)).withColumn("own", own_part(model.evidence))
    a, b = F.lit(model.host_strength), F.lit(model.path_strength)
    out = out.withColumn("host_rate", (F.col("host_good") - F.col("own") + a * F.lit(model.mean)) / (F.col("host_n") - 1 + a))
    shrunk = (F.col("path_good") - F.col("own") + b * F.col("host_rate")) / (F.col("path_n") - 1 + b)
    out = out.withColumn("path_rate", F.when(F.col("path") == "", F.col("host_rate")).otherwise(shrunk))
    rate = F.least(F.greatest("path_rate", F.lit(1e-3)), F.lit(1 - 1e-3))
    out = out.withColumn("score", sigmoid(F.col("evidence") + logit(rate)))
    return out.withColumn("keep", F.col("score") >= 0.5)


def sites(docs: DataFrame) -> tuple[F.Column, F.Column]:
    """The documents' host and the first directory of their path, empty if there is none."""
    source = F.regexp_replace(F.lower(F.coalesce(F.col("source").cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_extract(source, r"^([^/?#]*)", 1), F.regexp_extract(source, r"^[^/?#]*/+([^/?#]+)", 1)


def counted_documents(docs: DataFrame) -> DataFrame:
    docs = with_columns(docs, doc_id="bigint", text="string", source="string")
    host, path = sites(docs)
    return docs.select("doc_id", host.alias("host"), path.alias("path"), count_udf()("text").alias("counts"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, score and keep of each document."""
    counted = store(counted_documents(docs), "quality-counts")
    return score(counted, train(counted, labels)).select("doc_id", "evidence", "host_rate", "path_rate", "score", "keep")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns. Texts are read twice rather than shuffled."""
    columns = docs.columns
    counted = store(counted_documents(docs), "quality-counts")
    model = train(counted, labels)
    discard(counted)
    full = with_columns(docs, doc_id="bigint", text="string", source="string")
    host, path = sites(full)
    whole = full.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), host.alias("host"), path.alias("path"), count_udf()("text").alias("counts"))
    return score(whole, model).where("keep").select("row.*")
