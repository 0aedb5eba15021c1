"""Language identification by sparse multinomial logistic regression.

Features are character n-grams (n = 1, 2, 3 of the lower-cased text) hashed
into a fixed number of places, weighted by TF-IDF: a feature's share of the
text's n-grams times its inverse document frequency. Training is
follow-the-regularised-leader (proximal) with elastic-net penalties, one
document at a time, the start value of a language being a feature like the
others; afterwards a temperature is fitted on documents kept apart for that.
The fit uses a bounded sample of labelled rows (`per_language` expected rows of
each language); document frequencies and predictions are over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, row_mapper

BITS = 18
NGRAMS = (1, 2, 3)
L1, L2 = 0.1, 1e-4
MOST_WEIGHTS = 1 << 25  # numbers of the model on the driver, three of four bytes for each while it is trained
_PRIMES = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_MIX = np.uint32(0x27D4EB2F)


def places(text: str) -> np.ndarray:
    """The hashed place of every character n-gram of a text."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    with np.errstate(over="ignore"):
        for n in NGRAMS:
            k = len(c) - n + 1
            if k <= 0:
                break
            h = np.full(k, n, np.uint32)
            for i in range(n):
                h = (h ^ c[i : i + k]) * _PRIMES[i]
                h ^= h >> np.uint32(15)
            out.append((h * _MIX) >> np.uint32(32 - BITS))
    return np.concatenate(out)


@dataclass
class Model:
    languages: list[str]
    row: np.ndarray  # of each place its row among the weights; row 0 is that of places without any
    weights: np.ndarray  # rows x languages, already times the inverse document frequency
    bias: np.ndarray
    temperature: float
    zero: float = 0.0  # share of the weights of places seen in training that are zero

    def scores(self, text: str) -> np.ndarray:
        """Calibrated probabilities."""
        z = (self.weights[self.row[places(text)]].mean(axis=0) * SCALE + self.bias) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not has_letter(text) or not self.languages:
            return "und", 0.0
        p = self.scores(text)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


SCALE = 20.0  # the weighted n-gram shares are multiplied by this, to be of the size of one


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text))


def fit(rows: list[tuple[str, str]], frequency: np.ndarray | None = None, n_docs: int = 0, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = L1, l2: float = L2, seed: int = 7, most_weights: int = MOST_WEIGHTS) -> Model:
    """FTRL-proximal over (text, language) rows; every fifth is kept apart for the temperature.

    frequency: in how many of n_docs documents each place occurs (None: in the
    rows themselves). Only places of the rows get weights. There are at most
    `most_weights` of them: with so many languages that the sample's places do
    not all fit, those that most of its rows hold are taken, and the temperature
    is fitted on as many rows as fit. All languages are learned.
    """
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in rows})
    number = {x: k for k, x in enumerate(languages)}
    n_lang, size = len(languages), 1 << BITS
    feats = []
    for text, lang in rows:
        p, n = np.unique(places(text), return_counts=True)
        feats.append((p.astype(np.int32), (n / n.sum()).astype(np.float32), number[lang]))
    occurs = np.zeros(size, np.int64)  # in how many rows of the sample each place is
    for p, _, _ in feats:
        occurs[p] += 1
    if frequency is None:
        frequency, n_docs = occurs, len(rows)
    idf = np.log((1 + n_docs) / (1 + frequency)) + 1
    # rows of weights: row 0 for places without any, then the places of the sample, and last the start value, which is in every document
    most = max(1, most_weights // max(n_lang, 1))
    used = np.flatnonzero(occurs)
    if len(used) > most:
        used = np.sort(used[np.lexsort((used, -occurs[used]))[:most]])
    row = np.zeros(size, np.int32)
    row[used] = np.arange(1, len(used) + 1)
    start = len(used) + 1
    z, sq = np.zeros((start + 1, n_lang), np.float32), np.zeros((start + 1, n_lang), np.float32)

    def weights(z: np.ndarray, sq: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, np.float32(0), -(z - np.sign(z) * np.float32(l1)) / ((np.float32(beta) + np.sqrt(sq)) / np.float32(alpha) + np.float32(l2)))

    kept_apart = [f for k, f in enumerate(feats) if k % 5 == 4]
    train = [f for k, f in enumerate(feats) if k % 5 != 4] or feats
    for _ in range(epochs if n_lang > 1 else 0):
        for k in rng.permutation(len(train)):
            p, tf, y = train[k]
            r = row[p]
            has = r > 0
            p, tf, r = p[has], tf[has], np.append(r[has], start)
            x = np.append(tf * idf[p] * SCALE, 1.0)
            zp, sp = z[r], sq[r]
            wp = weights(zp, sp)
            s = x @ wp
            e = np.exp(s - s.max())
            e /= e.sum()
            e[y] -= 1.0
            g = x[:, None] * e
            g2 = sp + g * g
            z[r] = zp + g - (np.sqrt(g2) - np.sqrt(sp)) / alpha * wp
            sq[r] = g2
    seen = sq[:start].any(axis=1)
    none, n_seen = 0, 0
    for at in range(0, start + 1, 4096):  # in place: z becomes the weights
        z[at : at + 4096] = weights(z[at : at + 4096], sq[at : at + 4096])
        here = seen[at : at + 4096]
        part = z[at : min(at + 4096, start)][here[: max(0, start - at)]]
        none, n_seen = none + int((part == 0).sum()), n_seen + part.size
    del sq
    bias = z[start].astype(np.float64)
    z[1:start] *= idf[used, None].astype(np.float32)
    some = z[:start].any(axis=1)
    some[0] = True
    row = (np.cumsum(some) - 1).astype(np.int32)[np.where(some[row], row, 0)]
    model = Model(languages, row, z[:start][some], bias.astype(np.float32), 1.0, none / n_seen if n_seen else 0.0)
    del z
    kept_apart = kept_apart[: max(1, most_weights // max(n_lang, 1))]
    if n_lang > 1 and kept_apart:
        logits = np.array([tf @ model.weights[row[p]] * SCALE + bias for p, tf, _ in kept_apart])
        # where all are told right, the count of documents bounds how sure one may be
        doubt = 1 / (len(kept_apart) + 2)
        truth = np.full(logits.shape, doubt / (n_lang - 1))
        truth[np.arange(len(truth)), [y for _, _, y in kept_apart]] = 1 - doubt

        def loss(log_t: float) -> float:
            s = logits / np.exp(log_t)
            s -= s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - (s * truth).sum(axis=1)).mean())

        low, high = np.log(0.2), np.log(20.0)
        for _ in range(40):  # golden section: the loss is unimodal in the temperature
            a, b = high - 0.618 * (high - low), low + 0.618 * (high - low)
            low, high = (low, b) if loss(a) < loss(b) else (a, high)
        model.temperature = float(np.exp((low + high) / 2))
    return model


def frequencies(texts: DataFrame) -> np.ndarray:
    """In how many of the texts (one column) each place occurs; 2**BITS numbers at most come to the driver."""
    shape = pa.schema([("place", pa.int32()), ("n", pa.int64())])

    def run(batches):
        claim("langid")
        n = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for t in batch.column(0):
                n[np.unique(places(t.as_py()))] += 1
        seen = np.flatnonzero(n)
        for at in range(0, len(seen), 10_000):
            part = seen[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(n[part])], schema=shape)

    got = texts.mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BITS, np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def train(df: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang", per_language: int = 800, most_bytes: int = 16 << 20) -> Model:
    """Fit on rows where `usable` holds and text and language are there.

    Rows are chosen by a hash of the text against their language's share, so
    that about `per_language` of each come to the driver, whatever the table's
    size, ids and partitions, and at most about `most_bytes` of texts in all
    (fewer rows a language, if theirs are longer). All labels are learned.
    Document frequencies are of all usable rows. Without usable rows the model
    knows no language and answers `und`.
    """
    rows = df.filter(usable).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()  # a row for each label
    if not counts:
        return Model([], np.zeros(1 << BITS, np.int32), np.zeros((1, 0), np.float32), np.zeros(0, np.float32), 1.0)
    each = most_bytes / len(counts)
    share = df.sparkSession.createDataFrame([(r["lang"], min(1.0, per_language / r["n"], each / max(1, r["size"]))) for r in counts], "lang string, share double")
    spread = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = rows.join(F.broadcast(share), "lang").filter(spread < F.col("share"))  # a row for each label, which the model holds anyway
    # copies of a text teach nothing new; one row of each text and language is enough
    sample = sorted(tuple(r) for r in picked.select("lang", "text").distinct().collect())
    order = np.random.default_rng(3).permutation(len(sample))
    return fit([(sample[k][1], sample[k][0]) for k in order], frequencies(rows.select("text")), sum(r["n"] for r in counts))


def predicted(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (0 to 1).

    Null texts and such without a letter: `und`, 0. Of equal scores the first
    language by name wins. Rows that repeat all stay and get equal results; an
    empty table gives none, and other columns, whatever their names, are not looked at.
    """
    fields = [pa.field("doc_id", pa.int64()), pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())]
    sent = df.sparkSession.sparkContext.broadcast(model)  # weights of the places that the sample holds, by language

    def make():
        m = sent.value
        return lambda cols: [cols[0], *map(list, zip(*(m.predict(t) for t in cols[1]), strict=True))]

    d = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    return row_mapper(d, "doc_id long, lang_pred string, score double", fields, make)


def kept(df: DataFrame, model: Model, text_col: str = "text", least_score: float = 0.5) -> DataFrame:
    """The rows with a language predicted with a score of `least_score` or more, with all their columns as they were; not those with null texts or such without a letter. Rows that repeat are decided alike; an empty table gives none."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches):
        claim("langid")
        m = sent.value
        for batch in batches:
            keep = []
            for t in batch.column(at):
                lang, score = m.predict(t.as_py())
                keep.append(lang != "und" and score >= least_score)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)
