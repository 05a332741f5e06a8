"""Language of a text by error-correcting output codes.

Every language has a codeword of bits. For each bit a classifier over byte
n-grams tells the languages with a 1 there from those with a 0. A text's bits
come with margins; the language whose codeword has the least weighted loss on
them is chosen, and where the second one is close the text is flagged.

The model is fitted on a bounded sample; it is some arrays of fixed size. A text
is then judged by itself, whole, so prediction is one pass without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reachgrid.llm.texts import free
from reachgrid.llm.words import bytes_of, slices

#: Lengths of n-grams in bytes, and the hashed features of all of them.
ORDERS = (2, 3, 4)
FEATURE_BITS = 15
FEATURES = 1 << FEATURE_BITS
#: Texts of a language to fit on, about: the bound of the sample.
SAMPLE = 4_000
#: Up to so many languages every dichotomy is a bit; beyond, the best of random codes.
EXHAUSTIVE = 7
CODES_TRIED = 100
#: Weights are whole numbers, this many to a unit, so that sums do not depend on their order.
UNIT = 4096
#: Two languages whose losses differ by less than this are too close to tell apart.
CLOSE = math.log(3)
UNKNOWN = "und"

#: ASCII letters and all bytes of other characters stand for themselves, the rest for a space.
PLAIN = np.where([b >= 0x80 or chr(b).isalpha() for b in range(256)], np.arange(256), 0x20).astype(np.uint8)


def prepared(text: Column) -> Column:
    """The text as features see it: lower case, with a space at both ends."""
    return F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))


def _grams(raw: np.ndarray, bounds: np.ndarray):
    """For each order the feature that starts at each byte, FEATURES where there is none; bounds[0] is 0."""
    flat = PLAIN[raw].astype(np.uint32)
    n = len(flat)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    left = ends - np.arange(n)
    blank = flat == 0x20
    # Runs of spaces are one space.
    wide = np.zeros(n, dtype=bool)
    wide[:-1] = blank[:-1] & blank[1:]
    code = flat
    for k in range(2, max(ORDERS) + 1):
        more = np.zeros(n, dtype=np.uint32)
        more[: max(n - k + 1, 0)] = flat[k - 1 :]
        code = (code << np.uint32(8)) | more
        if k in ORDERS:
            place = ((code ^ np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - FEATURE_BITS)
            yield np.where(wide | (left < k), FEATURES, place).astype(np.int64)


def _counts(sample: DataFrame) -> dict[str, np.ndarray]:
    """{language: occurrences of each feature} of (lang, text)."""

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            raw, bounds = bytes_of(batch.column(1))
            for i, j in slices(bounds):
                own = raw[bounds[i] : bounds[j]]
                ends = bounds[i : j + 1] - bounds[i]
                for grams in _grams(own, ends):
                    for r in range(i, j):
                        total = found.setdefault(langs[r], np.zeros(FEATURES + 1, dtype=np.int64))
                        part = grams[ends[r - i] : ends[r - i + 1]]
                        if len(part) > FEATURES:
                            total += np.bincount(part, minlength=FEATURES + 1)
                        else:
                            np.add.at(total, part, 1)
        for lang, total in found.items():
            some = np.flatnonzero(total[:FEATURES])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(total[some])], names=["lang", "feature", "n"])

    rows = sample.mapInArrow(count, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    out: dict[str, np.ndarray] = {}
    # FEATURES rows for each language.
    for batch in rows.toArrow().to_batches():
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        features, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        for lang in set(langs):
            at = langs == lang
            out.setdefault(lang, np.zeros(FEATURES, dtype=np.int64))[features[at]] = n[at]
    return out


def codewords(n: int) -> np.ndarray:
    """(n, bits) of 0 and 1: every dichotomy of few languages, else the random code of largest least distance."""
    if n <= EXHAUSTIVE:
        dichotomies = np.arange(1, 1 << max(n - 1, 0))
        return ((dichotomies[None, :] >> np.arange(n)[:, None]) & 1).astype(np.int8)
    rng = np.random.default_rng(n)
    bits = math.ceil(10 * math.log2(n))
    best, most = None, -1
    for _ in range(CODES_TRIED):
        # Halves of the languages on either side of each bit.
        code = np.stack([rng.permutation(n) % 2 for _ in range(bits)], axis=1).astype(np.int8)
        least = min(int((code[a] != code[b]).sum()) for a, b in combinations(range(n), 2))
        if least > most:
            best, most = code, least
    return best


@dataclass
class Model:
    """Languages in order, their codewords, and for each bit its weights, calibration and loss weight."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    slope: np.ndarray
    offset: np.ndarray
    trust: np.ndarray


def _margins(column: pa.Array, weights: np.ndarray):
    """Margin of each bit for each prepared text: its sum of weights by the root of its number of n-grams."""
    raw, bounds = bytes_of(column)
    for i, j in slices(bounds):
        own = raw[bounds[i] : bounds[j]]
        ends = bounds[i : j + 1] - bounds[i]
        total = np.zeros((j - i, weights.shape[1]), dtype=np.int64)
        n = np.zeros(j - i, dtype=np.int64)
        # A prepared text has two bytes at least, so no row is empty.
        for grams in _grams(own, ends):
            total += np.add.reduceat(weights[grams], ends[:-1], axis=0, dtype=np.int64)
            n += np.add.reduceat(grams < FEATURES, ends[:-1], dtype=np.int64)
        yield total / UNIT / np.sqrt(n + 1.0)[:, None]


def _losses(margins: np.ndarray, model: Model) -> np.ndarray:
    """Weighted logistic loss of each codeword on each row of margins."""
    z = margins * model.slope + model.offset
    ones, zeros = np.logaddexp(0, -z) * model.trust, np.logaddexp(0, z) * model.trust
    return ones @ model.code.T + zeros @ (1 - model.code).T


def _calibrated(u: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[float, float]:
    """Slope and offset of a logistic regression of bits *y* on margins *u*, with classes of equal weight and a small ridge."""
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    b = np.zeros(2)
    x = np.stack([u, np.ones_like(u)], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + 1e-4 * b
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        b = b - np.clip(np.linalg.solve(curve, gradient), -5, 5)
    return float(b[0]), float(b[1])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from (lang, text, key), where key is a hash of the row.

    Of a language with more than *sample* texts those with the least keys are
    taken, about *sample* of them; whole texts. Null langs, and texts without a
    letter, teach nothing. Without texts the model knows no language.
    """
    usable = labelled.where(F.col("lang").isNotNull() & has_letter(F.col("text"))).select("lang", prepared(F.col("text")).alias("text"), "key")
    # One row for each language.
    sizes = {r["lang"]: r["n"] for r in labelled.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    part = F.lit(0.0)
    for lang, n in sorted(sizes.items()):
        part = F.when(F.col("lang") == lang, min(1.0, sample / n)).otherwise(part)
    drawn = usable.where(F.shiftrightunsigned("key", 11) / F.lit(float(1 << 53)) < part).select("lang", "text")
    counts = _counts(drawn)
    languages = sorted(counts)
    code = codewords(len(languages))
    bits = code.shape[1]
    if bits == 0:
        return Model(languages, code, np.zeros((FEATURES + 1, 0), dtype=np.int32), np.zeros(0), np.zeros(0), np.zeros(0))
    shares = np.stack([(counts[x] + 0.5) / (counts[x].sum() + 0.5 * FEATURES) for x in languages])
    weights = np.zeros((FEATURES + 1, bits), dtype=np.int32)
    for b in range(bits):
        ratio = np.log(shares[code[:, b] == 1].mean(axis=0) / shares[code[:, b] == 0].mean(axis=0))
        weights[:FEATURES, b] = np.round(ratio * UNIT)

    def measure(batches):
        for batch in batches:
            rows = np.concatenate([*_margins(batch.column(1), weights), np.zeros((0, bits))])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * bits, pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["lang", "margins"])

    # About *sample* rows of a few numbers for each language.
    seen = drawn.mapInArrow(measure, "lang string, margins array<double>").toArrow()
    place = {x: i for i, x in enumerate(languages)}
    truth = np.array([place[x] for x in seen.column("lang").to_pylist()])
    margins = np.array(seen.column("margins").to_pylist()).reshape(-1, bits)
    turn = np.lexsort((*margins.T, truth))
    truth, margins = truth[turn], margins[turn]
    slope, offset, trust = np.zeros(bits), np.zeros(bits), np.zeros(bits)
    for b in range(bits):
        y = code[truth, b].astype(float)
        slope[b], offset[b] = _calibrated(margins[:, b], y)
        wrong = ((margins[:, b] * slope[b] + offset[b] > 0) != (y == 1)).mean()
        trust[b] = math.log((1 - min(max(wrong, 0.001), 0.499)) / min(max(wrong, 0.001), 0.499))
    return Model(languages, code, weights, slope, offset, trust / trust.mean())


def has_letter(text: Column) -> Column:
    return F.coalesce(F.regexp(text, F.lit(r"\p{L}")), F.lit(False))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """*docs* (text, ...) with lang_pred, score (0 to 1) and ambiguous.

    score is the part of the chosen language in exp(-loss) over all languages;
    ambiguous says that the second one is close. Equal losses go to the language
    first in order. A null or empty text, or one without a letter, is ``und`` with
    score 0, and so is every text for a model without languages; both are
    ambiguous. Rows are judged one by one, so repeated rows are judged alike.
    Only the text is read; columns of the three names are replaced.
    """
    kind = "struct<lang: string, score: double, ambiguous: boolean>"

    @F.arrow_udf(kind)
    def judge(text: pa.Array) -> pa.Array:
        best, score, close = [], [], []
        for margins in _margins(text, model.weights):
            losses = _losses(margins, model)
            first = losses.argmin(axis=1)
            least = losses.min(axis=1)
            share = np.exp(least[:, None] - losses)
            best.append(first)
            score.append(1 / share.sum(axis=1))
            close.append(np.sort(losses, axis=1)[:, 1] - least < CLOSE if losses.shape[1] > 1 else np.zeros(len(first), dtype=bool))
        names = np.array(model.languages, dtype=object)[np.concatenate(best)] if best else []
        parts = [pa.array(list(names), pa.string())] + [pa.array(np.concatenate(x) if x else [], t) for x, t in ((score, pa.float64()), (close, pa.bool_()))]
        return pa.StructArray.from_arrays(parts, names=["lang", "score", "ambiguous"])

    none = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    own = free(docs, "_language")
    others = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    seen = judge(prepared(F.col("text"))) if model.languages else F.lit(None).cast(kind)
    found = docs.withColumn(own, seen)
    told = F.when(has_letter(F.col("text")), F.coalesce(F.col(own), none)).otherwise(none)
    out = found.withColumn(own, told)
    return out.select(*others, F.col(f"{own}.lang").alias("lang_pred"), F.col(f"{own}.score").alias("score"), F.col(f"{own}.ambiguous").alias("ambiguous"))


def fold(doc_id: Column, folds: int = 3) -> Column:
    """crc32 of the id as text, modulo *folds*; a null id is an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def identify(docs: DataFrame, held_out: int = 1, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every row of *docs* (doc_id, text, lang).

    The model learns from rows with a lang outside fold *held_out*. lang and
    doc_id draw the sample and have no part in a prediction.
    """
    taught = docs.where(fold(F.col("doc_id")) != held_out).select("lang", "text", F.xxhash64(F.col("doc_id").cast("long")).alias("key"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == held_out).alias("held_out"), "text")
    return predict(rows, fit(taught, sample)).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
