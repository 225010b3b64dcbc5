"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character n-grams are hashed to a fixed number of features. Document frequencies come from all labelled
training documents; the classifier is fitted by follow-the-regularised-leader with elastic-net penalties on a
bounded sample of every language's, and a temperature, fitted on a part of the sample that the classifier has not seen,
calibrates its probabilities. Term frequencies are relative, so a text's logits are the mean of its n-grams'
weights and a text of any length is scored in one pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowdelta.workers import ship

from .common import forget, free_name, stored
from .tokens import slices, utf8

BITS, ORDERS, SCALE = 15, (1, 2, 3), 30.0
UNKNOWN = "und"
#: The model has 0.5 MB a language on the driver and in each task.
MOST_LANGUAGES = 1000
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_low = np.arange(1 << 16, dtype=np.uint32)
for _i in range(1 << 16):
    _c = chr(_i).lower()
    _low[_i] = ord(_c) if len(_c) == 1 else _i
_low[[*range(9, 14)]] = 32


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts on end, and where each text begins (len + 1)."""
    data, offsets = utf8(texts)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.uint32)
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32) & 0x3F
    cp = np.where(lead < 0x80, lead, lead & 0x1F)
    for n, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
        more = lead >= least
        cp[more] = (cp[more] << 6) | padded[at[more] + n]
    cp &= 0x1FFFFF  # what is left of a four-byte lead's marker
    begin = np.searchsorted(at, offsets)
    bmp = cp < (1 << 16)
    cp[bmp] = _low[cp[bmp]]
    return cp, begin


def ngrams(cp: np.ndarray, order: int) -> np.ndarray:
    """The feature of the n-gram at each place but the last order - 1."""
    n = len(cp) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, order, np.uint64)
    for j in range(order):
        h = (h + cp[j : j + n].astype(np.uint64) + np.uint64(1)) * _FACTORS[j]
        h ^= h >> np.uint64(29)
    return (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int64)


def counts_of(cp: np.ndarray) -> np.ndarray:
    """The number of n-grams of each feature in one text."""
    return np.bincount(np.concatenate([ngrams(cp, o) for o in ORDERS]), minlength=1 << BITS)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts each feature occurs, and how many texts there are."""

    def count(batches):
        df, n = np.zeros(1 << BITS, np.int64), 0
        for whole in batches:
            for batch in slices(whole, "text"):
                cp, begin = code_points(batch.column("text"))
                for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    own = np.zeros(1 << BITS, bool)
                    for o in ORDERS:
                        own[ngrams(cp[a:b], o)] = True
                    df += own
                    n += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], n))], ["feature", "n"])

    # at most 2 ** BITS + 1 rows
    found = docs.select("text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    feature, n = found.column("feature").to_numpy(), found.column("n").to_numpy()
    df = np.zeros(1 << BITS)
    df[feature[feature >= 0]] = n[feature >= 0]
    return df, int(n[feature < 0].sum())


class Ftrl:
    """Multinomial logistic regression by FTRL-proximal with L1 and L2 penalties."""

    def __init__(self, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z = np.zeros((1 << BITS, classes))
        self.n = np.zeros((1 << BITS, classes))
        self.bias = np.zeros(classes)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w + self.bias)
        p[label] -= 1
        g = x[:, None] * p[None, :]
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        self.bias -= 0.02 * p


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least cross-entropy, by golden section over its logarithm.

    Labels count as 1 / (n + 2) uncertain, so that a part without any error still gives a finite answer."""
    if not len(labels):
        return 1.0
    unsure = 1 / (len(labels) + 2)

    def loss(t: float) -> float:
        p = np.log(softmax(logits / np.exp(t)) + 1e-12)
        return -((1 - unsure) * p[np.arange(len(labels)), labels] + unsure * p.mean(1)).mean()

    a, b, r = -3.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, sample: int = 4000, epochs: int = 3, least: int = 20, most_features: int = 1 << 24) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Languages, feature weights (with IDF), biases and temperature from labelled ``docs`` (doc_id, text, lang).

    The classifier sees a bounded sample: of every language the documents of least hash, about an even share of
    ``sample`` and no more, but ``least`` of each, the languages taking turns until ``most_features`` distinct features of documents are
    held. Document frequencies cover all of ``docs``."""
    df, n = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)) + 1

    def features(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                cp, begin = code_points(batch.column("text"))
                at, x = [], []
                for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    c = counts_of(cp[a:b])
                    some = np.flatnonzero(c)
                    at.append(some.astype("<u2").tobytes())
                    x.append((c[some] / max(c.sum(), 1)).astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("lang"), pa.array(at, pa.binary()), pa.array(x, pa.binary())], ["h", "lang", "at", "x"])

    docs = docs.select("lang", "text", F.xxhash64("doc_id", "text", F.lit(4)).alias("h"))
    # a row for each language, as the model has a column. Repeated rows are one document: a sketch counts distinct ones
    by_lang = stored(docs.groupBy("lang").agg(F.approx_count_distinct("h", 0.01).alias("n")), "languages")
    if (n_langs := by_lang.count()) > MOST_LANGUAGES:
        raise ValueError(f"{n_langs} languages: a model holds at most {MOST_LANGUAGES}")
    share = max(least, sample // max(1, n_langs))
    # hashes are even over their range, so a language's least ones are those under its share of the range
    even = F.shiftrightunsigned("h", 11) / float(1 << 53)
    chosen = docs.join(F.broadcast(by_lang), "lang").where(even * F.col("n") < share).dropDuplicates(["lang", "h"])
    rows = chosen.select("text", "h", "lang").mapInArrow(features, "h long, lang string, at binary, x binary")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    rows = stored(rows.withColumn("turn", turn).where(F.col("turn") <= share), "features")
    sizes = rows.groupBy("turn").agg((F.sum(F.octet_length("at")) / 2).alias("n")).orderBy("turn").collect()
    turns = max(1, int((np.cumsum([r["n"] for r in sizes]) <= most_features).sum()))
    found = rows.where(F.col("turn") <= turns).orderBy("turn", "lang").collect()
    forget(rows)
    forget(by_lang)
    langs = sorted({r["lang"] for r in found})
    label = np.array([langs.index(r["lang"]) for r in found], int)
    rows = [(np.frombuffer(r["at"], "<u2").astype(int), np.frombuffer(r["x"], "<f4") * idf[np.frombuffer(r["at"], "<u2")] * SCALE) for r in found]
    check = np.arange(len(rows)) % 5 == 4
    model = Ftrl(max(len(langs), 1))
    for _ in range(epochs):
        for i in np.flatnonzero(~check):
            model.learn(*rows[i], label[i])
    w = model.weights()
    logits = np.array([rows[i][1] @ w[rows[i][0]] + model.bias for i in np.flatnonzero(check)]).reshape(-1, max(len(langs), 1))
    return langs, (w * idf[:, None] * SCALE).astype(np.float32), model.bias, temperature(logits, label[check])


def held_out(doc_id: str = "doc_id", folds: int = 5):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def identify(docs: DataFrame, sample: int = 4000, epochs: int = 3) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, lang, ...) with held_out, lang_pred, score and lift.

    Learns from text and lang of rows with a lang whose crc32(doc_id as text) mod 5 is not 0; a prediction
    depends on the text alone. score is the calibrated probability of lang_pred, lift that times the number of
    languages: 1 says that the text fits none of them better than the others. A text that is null or has
    no letter is ``und`` with score 0, as is any if nothing could be learned. A null doc_id is neither held
    out nor learned from. Equal texts get equal results. An empty table gives an empty result. Other columns come
    back whatever their names, but for those named like the four new ones, which are replaced.
    """
    spark = ship(docs.sparkSession)
    letter = F.col("text").rlike(r"\p{L}")
    learned = docs.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & letter).select("doc_id", "text", "lang")
    sent = spark.sparkContext.broadcast(fit(learned, sample, epochs))

    def predict(batches):
        langs, w, bias, t = sent.value
        by_lang = np.ascontiguousarray(w.T)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                n = batch.num_rows
                pred, score = np.full(n, UNKNOWN, object), np.zeros(n)
                seen = batch.column(flag).to_numpy(zero_copy_only=False).astype(bool)
                if langs and seen.any():
                    cp, begin = code_points(batch.column("text"))
                    logits, grams = np.zeros((n, len(langs))), np.zeros(n)
                    for o in ORDERS:
                        h = ngrams(cp, o)
                        ends = np.maximum(begin[1:] - o + 1, begin[:-1])
                        own = ends > begin[:-1]
                        # sums of [begin, end) at the even places; what is between, across texts, at the odd ones
                        cut = np.stack([begin[:-1][own], ends[own]], 1).ravel()
                        for k in range(len(langs) if own.any() else 0):
                            logits[own, k] += np.add.reduceat(np.append(by_lang[k][h], np.float32(0)), cut, dtype=np.float64)[::2]
                        grams += ends - begin[:-1]
                    p = softmax((logits / np.maximum(grams, 1)[:, None] + bias) / t)
                    best = p.argmax(1)
                    pred[seen], score[seen] = np.array(langs, object)[best[seen]], p[np.arange(n), best][seen]
                new = [batch.column(held), pa.array(pred, pa.string()), pa.array(score), pa.array(score * len(langs))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *new], [*names, "held_out", "lang_pred", "score", "lift"])

    own = docs.drop("held_out", "lang_pred", "score", "lift")
    names, flag = own.columns, free_name(own, "letter")
    held = free_name(own, "held")
    schema = own.schema.add("held_out", "boolean").add("lang_pred", "string").add("score", "double").add("lift", "double")
    return own.select("*", held_out().alias(held), F.coalesce(letter, F.lit(False)).alias(flag)).mapInArrow(predict, schema)
