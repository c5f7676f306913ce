"""Toxicity: boosted trees over dense features, with isotonic calibration.

Words are compared in a plain form: A-Z lower-cased, look-alike digits and
signs read as letters, other signs dropped.  A lexicon of such words and word
beginnings is learned from labelled texts; the features are its densities, how
close its words stand to a second-person pronoun, and the shares of capitals,
punctuation and obfuscated words.  Labels, language, source and key are never
features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import arrow_batches, materialize
from .textbatch import NOT_SPACE, byte_values, chunks, span_hashes, text_bytes, with_columns, words

#: Fit on about so many labelled texts, chosen by hash of the key.
MAX_LABELLED = 40_000
#: Most entries of the lexicon, those of the largest evidence.
MAX_LEXICON = 4_000
#: Least log-likelihood ratio of an entry against the share of toxic texts.
MIN_EVIDENCE = 30.0
PREFIXES = (4, 5, 6, 7, 8, 10)  # bytes of a longer word's beginning
NEAR = 6  # words
TREES, DEPTH = 20, 4

# Signs that stand for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
# Second-person pronouns of the languages served.
SECOND_PERSON = (
    "you your yours yourself u ur "
    "du dich dir dein deine deinen ihr euch euer sie ihnen "
    "tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros vuestro"
).split()

FEATURES = [
    "log_words", "hits", "hit_density", "max_weight", "weight_density", "strong_hits", "near_second_person", "near_density",
    "second_person_density", "capitals", "all_capital_words", "exclamations", "questions", "other_signs", "digits", "obfuscated", "obfuscated_hits",
]

_PLAIN = np.zeros(256, np.uint8)
_PLAIN[0x61:0x7B] = _PLAIN[0x41:0x5B] = np.arange(0x61, 0x7B)
_PLAIN[0x80:] = np.arange(0x80, 0x100)
for _sign, _letter in LOOKALIKES.items():
    _PLAIN[ord(_sign)] = ord(_letter)
_SIGN = np.zeros(256, bool)  # read as a letter, or dropped within a word
_SIGN[[c for c in range(0x21, 0x7F) if not (chr(c).isalpha() or chr(c) in "-'")]] = True
_VALUES = byte_values(False)


def _hash_words(texts: list[str]) -> np.ndarray:
    data, offsets = text_bytes(pa.array(texts))
    return np.unique(span_hashes(data, offsets[:-1], offsets[1:], _VALUES))


def _plain_words(data: np.ndarray, offsets: np.ndarray):
    """Words, hashes of their plain forms, and of their beginnings by length."""
    w = words(data, offsets, NOT_SPACE)
    plain = _PLAIN[data]
    keep = plain > 0
    # a run-on "!" or "." at a word's end is punctuation, not a letter
    letters = np.concatenate([[0], np.cumsum(((data >= 0x41) & (data <= 0x5A)) | ((data >= 0x61) & (data <= 0x7A)) | (data >= 0x80))])
    end = w.end.copy()
    for _ in range(4):
        last = data[np.maximum(end - 1, 0)]
        trim = (end > w.start) & _SIGN[last]
        if not trim.any():
            break
        end = np.where(trim, end - 1, end)
    place = np.concatenate([[0], np.cumsum(keep)])
    body = plain[keep]
    a, b = place[w.start], place[end]
    full = span_hashes(body, a, b, _VALUES)
    # beginnings and whole words are told apart
    begins = [(~span_hashes(body, a, np.minimum(a + n, b), _VALUES), b - a > n) for n in PREFIXES]
    return w, end, letters, full, begins


@dataclass
class Lexicon:
    keys: np.ndarray
    weights: np.ndarray

    def weigh(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(hashes))
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == hashes, self.weights[at], 0.0)


def learn_lexicon(labelled: DataFrame, text: str, label: str) -> Lexicon:
    """Words and beginnings that mark toxic texts, by log-likelihood ratio.

    Equal texts count once, so copies are no evidence.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("long").alias("y")).filter(F.col("text").isNotNull() & F.col("y").isNotNull())
    rows = rows.groupBy(F.xxhash64("text").alias("_h"), F.length("text")).agg(F.first("text").alias("text"), F.max("y").alias("y")).select("text", "y")
    rows = materialize(rows)
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("t")).first()
    n, t = int(totals["n"]), int(totals["t"] or 0)
    if not n or not t or t == n:
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0))

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged():
            keys, inverse = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return keys, *(np.bincount(inverse, weights=np.concatenate([h[i] for h in held])) for i in (1, 2))

        for part in chunks(batches, "text"):
            w, _, _, full, begins = _plain_words(*text_bytes(part.column("text")))
            y = part.column("y").to_numpy()
            keys = np.concatenate([full, *(h[ok] for h, ok in begins)])
            docs = np.concatenate([w.doc, *(w.doc[ok] for _, ok in begins)])
            order = np.lexsort((keys, docs))
            keys, docs = keys[order], docs[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
            keys, docs = keys[new], docs[new]
            held.append((keys, np.ones(len(keys)), y[docs].astype(float)))
            if len(held) >= 16:
                held = [merged()]
        for keys, a, b in [merged()] if held else []:
            for i in range(0, len(keys), 200_000):
                s = slice(i, i + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(keys[s]).view(np.int64)), pa.array(a[s].astype(np.int64)), pa.array(b[s].astype(np.int64))], ["h", "n", "t"])

    found = rows.mapInArrow(count, "h long, n long, t long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    base = t / n
    part = lambda k, p: F.when(k > 0, k * F.log(k / (F.col("n") * F.lit(p)))).otherwise(0.0)
    evidence = 2 * (part(F.col("t"), base) + part(F.col("n") - F.col("t"), 1 - base))
    weight = F.log(((F.col("t") + 0.5) / (t + 1)) / ((F.col("n") - F.col("t") + 0.5) / (n - t + 1)))
    best = found.filter(F.col("t") >= 4).select("h", evidence.alias("e"), weight.alias("w")).filter((F.col("w") > 1.5) & (F.col("e") >= MIN_EVIDENCE))
    table = best.orderBy(F.desc("e"), "h").limit(MAX_LEXICON).toArrow()
    keys = table["h"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return Lexicon(keys[order], table["w"].to_numpy()[order])


def features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon, second: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each text; an empty text has only zeros."""
    rows = len(offsets) - 1
    w, end, letters, full, begins = _plain_words(data, offsets)
    weight = lexicon.weigh(full)
    for h, ok in begins:
        weight = np.maximum(weight, np.where(ok, lexicon.weigh(h), 0.0))
    hit = weight > 0
    at = np.searchsorted(second, full)
    at[at == len(second)] = 0
    you = second[at] == full if len(second) else np.zeros(len(full), bool)
    near = np.zeros(len(full), bool)
    for d in range(1, NEAR + 1):
        if len(full) > d:
            same = w.doc[d:] == w.doc[:-d]
            near[d:] |= you[:-d] & same
            near[:-d] |= you[d:] & same
    signs = np.concatenate([[0], np.cumsum(_SIGN[data])])
    capital = (data >= 0x41) & (data <= 0x5A)
    capitals = np.concatenate([[0], np.cumsum(capital)])
    n_letters = letters[end] - letters[w.start]
    # signs or digits between letters of one word
    odd = (signs[end] - signs[w.start] > 0) & (n_letters >= 2) & (end - w.start >= 3)
    shout = (capitals[end] - capitals[w.start] == n_letters) & (n_letters >= 3)
    add = lambda x: np.bincount(w.doc, weights=x, minlength=rows)
    per_byte = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
    size, n = np.maximum(np.diff(offsets), 1), np.maximum(w.count, 1)
    top = np.zeros(rows)
    np.maximum.at(top, w.doc, weight)
    hits, close = add(hit), add(hit & near)
    all_letters = np.maximum(np.diff(letters[offsets]), 1)
    excl, ask = per_byte(data == 0x21), per_byte(data == 0x3F)
    return np.column_stack([
        np.log1p(w.count), hits, hits / n, top, add(weight) / n, add(weight > 3), close, close / n,
        add(you) / n, per_byte(capital) / all_letters, add(shout) / n, excl / size, ask / size,
        (per_byte(_SIGN[data]) - excl - ask) / size, per_byte((data >= 0x30) & (data <= 0x39)) / size, add(odd) / n, add(odd & hit),
    ])


@dataclass
class Model:
    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    base: float  # the share of toxic texts, where nothing else could be learned


def _with_features(df: DataFrame, lexicon: Lexicon, text: str, keep: list[str]) -> DataFrame:
    second = _hash_words(SECOND_PERSON)
    shared = df.sparkSession.sparkContext.broadcast((lexicon, second))

    def add(data, offsets):
        x = features(data, offsets, *shared.value)
        flat = pa.array(x.ravel())
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), flat)]

    return with_columns(df, text, add, [("_features", "array<double>")], keep)


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit lexicon, trees and calibration on rows with a label.

    Three of four rows, by hash of the key, fit the trees, the fourth the
    calibration.  Where one class is absent the share of toxic texts is all
    that is learned.
    """
    arrow_batches(labelled.sparkSession)
    rows = labelled.filter(F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("text"), F.col(label).cast("double").alias("y"))
    total = rows.count()
    draw = F.pmod(F.xxhash64(F.lit("toxic"), "k"), F.lit(1 << 20)) / float(1 << 20)
    sample = materialize(rows.filter(draw < min(1.0, MAX_LABELLED / max(total, 1))))
    base = sample.agg(F.avg("y")).first()[0]
    if base is None or base in (0.0, 1.0):
        return Model(Lexicon(np.zeros(0, np.uint64), np.zeros(0)), None, None, float(base or 0.0))
    lexicon = learn_lexicon(sample, "text", "y")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "k"), F.lit(4))
    ready = materialize(_with_features(sample.withColumn("fold", fold), lexicon, "text", ["y", "fold"]))
    ready = ready.select("y", "fold", array_to_vector("_features").alias("features")).coalesce(8)
    fit, rest = ready.filter("fold < 3").cache(), ready.filter("fold = 3")
    if fit.select("y").distinct().count() < 2 or rest.select("y").distinct().count() < 2:
        fit.unpersist()
        fit = ready.cache()
        rest = ready
    trees = GBTClassifier(featuresCol="features", labelCol="y", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, minInstancesPerNode=3).fit(fit)
    fit.unpersist()
    raw = trees.transform(rest).select("y", vector_to_array("probability")[1].alias("raw"))
    calibration = IsotonicRegression(featuresCol="raw", labelCol="y", predictionCol="score").fit(raw)
    return Model(lexicon, trees, calibration, float(base))


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score``, 0 to 1: higher, likelier toxic.

    Null and empty texts are scored by their zero features.  ``score`` takes
    the place of an equal name.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    if model.trees is None:
        return docs.select(*keep, F.lit(model.base).alias("score"))
    rows = _with_features(docs, model.lexicon, text, keep)
    # one column for what passes through, so no name can clash with the model's
    rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), array_to_vector("_features").alias("features"))
    rows = PipelineModel([model.trees]).transform(rows).select("row", vector_to_array("probability")[1].alias("raw"))
    rows = model.calibration.transform(rows)
    # isotonic steps tie; the trees' own score orders within a step
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") + (F.col("raw") - 0.5) * 1e-6))
    return rows.select("row.*", value.alias("score"))


def held_out(key: str = "doc_id"):
    """Rows kept from training: crc32 of the key's text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def predict(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Train on labelled rows not held out and score all documents.

    Returns ``doc_id, held_out, score, predicted``, a row for each document,
    repeats included.  A label is set if any row of its key sets it; null
    labels are left out, and a null key has no label and isn't held out.  Null
    and empty texts are scored by their zero features; without labels of both
    classes every score is the share of toxic ones.
    """
    known = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labelled = docs.select("doc_id", "text").filter(~held_out()).join(known, "doc_id")
    model = train(labelled)
    out = score(docs.select("doc_id", held_out().alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
