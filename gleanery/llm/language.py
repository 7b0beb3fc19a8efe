"""Language identification with error-correcting output codes.

Each language has a codeword; one binary classifier a bit tells the languages with that bit from the
others, by naive Bayes over hashed character n-grams (1 to 3 letters, word ends included). On the
training sample each bit gets a scale (its mean margin) and a weight (the log odds of its being
right). A text is decoded to the codeword of least weighted logistic loss; the score is that language's
share after a softmax over minus the losses, and a small gap to the second best flags ambiguity.

The classifiers are fitted on a bounded sample: about ``per_language`` training documents a language,
chosen by a hash of the id, whole texts, and on the ``most_languages`` languages with the most training documents.
Tables hold ``2**bits`` n-gram buckets for each language.

Defined cases: null text and text without a letter give ``und`` with score 0; null ids are not trained
on; languages of one training document count; without any training document all is ``und``; one
language alone is always predicted, with score 1; ties go to the language first by name; repeated rows
are predicted each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import boolean, double, slices, string, strings, text_map
from gleanery.session import cut_lineage


@lru_cache(1)
def letters() -> np.ndarray:
    """Is this code point a letter?"""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str, bits: int) -> np.ndarray | None:
    """Buckets of all n-grams of a text's words, each with a space at both ends; None without letters."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(letters()[points], points, 32)
    space = points == 32
    points = points[~(space & np.r_[False, space[:-1]])].astype(np.uint32)
    if len(points) < 3:
        return None
    c1, c2 = points[:-1], points[1:]
    with np.errstate(over="ignore"):
        two = c1 * np.uint32(0x9E3779B1) + c2 * np.uint32(0x85EBCA77)
        three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0xC2B2AE3D) + points[2:] * np.uint32(0x27D4EB2F)
        keys = np.concatenate([points * np.uint32(0x165667B1), two + np.uint32(1), three + np.uint32(2)])
        keys ^= keys >> np.uint32(15)
        return (keys * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1: all splits for up to seven languages, else the best spread of random codes."""
    if n <= 7:
        splits = [[1] + [1 if s >> i & 1 else -1 for i in range(n - 1)] for s in range(2 ** (n - 1) - 1)] if n > 1 else [[1]]
        return np.array(splits).T
    rng = np.random.default_rng(seed)
    width = 8 * int(np.ceil(np.log2(n))) + 7
    best, distance = None, -1
    for _ in range(64):
        code = rng.choice([-1, 1], (n, width))
        apart = (width - code @ code.T) // 2 + width * np.eye(n, dtype=int)
        flat = (abs(code.sum(0)) == n).any()
        if not flat and apart.min() > distance:
            best, distance = code, apart.min()
    return best


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray, bits: int, smoothing: float = 0.5):
        self.languages, self.bits = languages, bits
        self.code = codewords(len(languages))
        yes = (self.code > 0).astype(float)
        ones, zeros = yes.T @ counts + smoothing, (1 - yes).T @ counts + smoothing
        self.weights = np.ascontiguousarray((np.log(ones / ones.sum(1, keepdims=True)) - np.log(zeros / zeros.sum(1, keepdims=True))).T.astype(np.float32))
        self.scale = np.ones(self.code.shape[1])
        self.trust = np.ones(self.code.shape[1])

    def margins(self, text: str | None) -> np.ndarray | None:
        """Mean log odds of each bit; None if there is nothing to go by."""
        keys = grams(text, self.bits) if text else None
        if keys is None:
            return None
        if len(keys) > 1 << 13:
            total = np.bincount(keys, minlength=1 << self.bits).astype(np.float32) @ self.weights
        else:
            total = self.weights[keys].sum(0, dtype=np.float64)
        return total / len(keys)

    def predict(self, text: str | None, gap: float) -> tuple[str, float, bool]:
        margins = self.margins(text)
        if margins is None or not self.languages:
            return "und", 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        losses = np.logaddexp(0, -self.code * (3 * margins / self.scale)) @ self.trust / self.trust.mean()
        best = int(np.argmin(losses))
        share = np.exp(losses[best] - losses)
        rest = np.delete(losses, best).min()
        return self.languages[best], float(min(1.0, 1 / share.sum())), bool(rest - losses[best] < gap)


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1500, bits: int = 15, most_languages: int = 256) -> Model:
    """Fit on about ``per_language`` documents a language among the rows where ``train`` holds."""
    rows = docs.where(train & docs[id_col].isNotNull() & docs[lang_col].isNotNull() & docs[text_col].isNotNull())
    rows = rows.select(docs[id_col].alias("__id"), docs[lang_col].alias("__lang"), docs[text_col].alias("__text"))
    found = rows.groupBy("__lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "__lang").limit(most_languages)
    sizes = {r["__lang"]: r["n"] for r in found.collect()}
    languages = sorted(sizes)
    if not languages:
        return _nothing(bits)
    million = 1_000_000
    limit = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, int(million * per_language / sizes[k]) + 1)]), F.col("__lang"))
    sample = cut_lineage(rows.where(F.col("__lang").isin(languages)).where(F.pmod(F.xxhash64("__id"), F.lit(million)) < limit).select("__lang", "__text"))
    place = {k: i for i, k in enumerate(languages)}

    def count(batches):
        total = np.zeros((len(languages), 1 << bits), np.int64)
        for part in slices(batches):
            for lang, text in zip(strings(part.column(0)), strings(part.column(1))):
                keys = grams(text, bits)
                if keys is not None:
                    total[place[lang]] += np.bincount(keys, minlength=1 << bits)
        at, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bucket), pa.array(total[at, bucket])], ["lang", "bucket", "n"])

    summed = sample.mapInArrow(count, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # languages x buckets
    counts = np.zeros((len(languages), 1 << bits))
    counts[summed["lang"].to_numpy(), summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    model = Model(languages, counts, bits)

    def rate(batches):
        sure, right, n = np.zeros(len(model.scale)), np.zeros(len(model.scale), np.int64), 0
        for part in slices(batches):
            for lang, text in zip(strings(part.column(0)), strings(part.column(1))):
                margins = model.margins(text)
                if margins is not None:
                    sure += abs(margins)
                    right += margins * model.code[place[lang]] > 0
                    n += 1
        bit = np.arange(len(sure))
        yield pa.RecordBatch.from_arrays([pa.array(bit), pa.array(sure), pa.array(right), pa.array(np.full(len(bit), n))], ["bit", "sure", "good", "n"])

    for r in sample.mapInArrow(rate, "bit long, sure double, good long, n long").groupBy("bit").agg(F.sum("sure").alias("sure"), F.sum("good").alias("good"), F.sum("n").alias("n")).collect():
        if r["n"]:
            wrong = (r["n"] - r["good"] + 1) / (r["n"] + 2)
            model.scale[r["bit"]] = max(r["sure"] / r["n"], 1e-6)
            model.trust[r["bit"]] = max(np.log((1 - wrong) / wrong), 0.05)
    return model


def _nothing(bits: int) -> Model:
    model = Model(["und"], np.zeros((1, 1 << bits)), bits)
    model.languages = []
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, gap: float = 0.5) -> DataFrame:
    """The kept columns, ``lang_pred``, ``score`` and ``ambiguous``."""

    def make():
        def run(texts):
            rows = [model.predict(t, gap) for t in texts]
            return dict(zip(("lang_pred", "score", "ambiguous"), map(list, zip(*rows)))) if rows else {}

        return run

    return text_map(docs, text_col, make, T.StructType([string("lang_pred"), double("score"), boolean("ambiguous")]), keep)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1500) -> DataFrame:
    """The id, ``held_out`` (crc32 of the id modulo 3 is 1), ``lang_pred``, ``score``, ``ambiguous``."""
    held = F.coalesce(F.crc32(docs[id_col].cast("string")) % 3 == 1, F.lit(False))
    model = fit(docs, ~held, id_col, text_col, lang_col, per_language)
    source = docs.select(docs[id_col].alias("__id"), held.alias("held_out"), docs[text_col].alias("__body"))
    return predict(source, model, "__body", ["__id", "held_out"]).withColumnRenamed("__id", id_col)
