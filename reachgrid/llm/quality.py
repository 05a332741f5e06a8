"""Quality rules with risk-controlled cutoffs.

Each rule is a measure of a text that is high for junk, with a grid of cutoffs
from lenient to strict. Joint settings of all rules form one sequence, fixed
beforehand: the rules take turns to become one step stricter. A stratum takes
the strictest setting up to which labelled good texts prove, at each step, that
the rules together reject few of them: the exact (Clopper-Pearson) upper bound
of the share that any rule rejects is at most the allowed risk. The first
failure ends the sequence, so all of it costs one test, and only the strata
share the error level (Bonferroni). With probability 1 - delta no stratum loses
more than the allowed share of good texts to the rules.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reachgrid.llm.texts import PORTION, free, text_key, written
from reachgrid.llm.words import SAME, U, WHITE, Words, bytes_of, grams, slices, text_grams, words_of

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
UPPER = np.isin(np.arange(256), list(range(0x41, 0x5B)))
LETTER = UPPER | np.isin(np.arange(256), list(range(0x61, 0x7B)))
BANG = np.arange(256) == 0x21
WINDOW = 5

#: Rules and their cutoffs from lenient to strict; a text above the cutoff is rejected.
GRIDS: dict[str, list[float]] = {
    "symbol_share": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03],
    "upper_share": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2],
    "bang_share": [2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "repeated_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2],
    "word_length": [30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0],
}
#: The sequence of joint settings: in step t this rule is set to this cutoff, and the others stay.
STEPS: list[tuple[str, float]] = [(r, grid[i]) for i in range(max(map(len, GRIDS.values()))) for r, grid in GRIDS.items() if i < len(grid)]
#: Languages with cutoffs of their own; all others, and null, are one stratum.
STRATA = ["de", "en", "es", "fr"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Name of the added column.
Q = "_quality_counts"
EXTRA = ["n_upper", "n_letters", "n_bangs", "n_lines"]
MEASURES = "struct<" + ", ".join(f"{c}: long" for c in COUNTS + EXTRA) + ">"


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated(words: Words) -> np.ndarray:
    """Words of each row inside runs of WINDOW words that the row has twice or more."""
    count = np.diff(words.first)
    hashes, bounds = text_grams(words, WINDOW)
    size = np.diff(bounds)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(hashes)) - np.repeat(bounds[:-1] - words.first[:-1], size)
    whole = np.repeat(count >= WINDOW, size)
    hashes, row, place = hashes[whole], row[whole], place[whole]
    turn = np.lexsort((hashes, row))
    same = (hashes[turn][1:] == hashes[turn][:-1]) & (row[turn][1:] == row[turn][:-1])
    twice = np.zeros(len(turn), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = place[turn][twice]
    marks = np.zeros(len(words.hash) + 1, dtype=np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + WINDOW, -1)
    return _per_row(np.cumsum(marks)[:-1] > 0, words.first)


def _repeated_lines(text: str) -> tuple[int, int]:
    """(lines with a word that equal an earlier line, lines)."""
    lines = text.split("\n")
    seen: set[str] = set()
    n = 0
    for line in lines if len(lines) > 1 else ():
        if line.strip("\t\n\x0b\x0c\r "):
            n += line in seen
            seen.add(line)
    return n, len(lines)


def measure(column: pa.Array) -> pa.Array:
    """The counts of each text, as a struct array; null counts as empty."""
    raw, bounds = bytes_of(column)
    found: list[list[np.ndarray]] = []
    for i, j in slices(bounds):
        words = words_of(raw, bounds[i : j + 1], WHITE, SAME)
        inside = np.zeros(len(words.raw) + 1, dtype=np.int64)
        np.add.at(inside, words.start, 1)
        np.add.at(inside, words.end, -1)
        points = (words.raw & 0xC0) != 0x80
        chars = _per_row(points & (np.cumsum(inside)[:-1] > 0), words.bounds)
        flags = [_per_row(kind[words.raw], words.bounds) for kind in (SYMBOLS, UPPER, LETTER, BANG)]
        found.append([np.diff(words.first), chars, flags[0], _repeated(words), *flags[1:]])
    parts = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 7
    lines = [_repeated_lines(t or "") for t in column.to_pylist()]
    dup, n_lines = (np.array(x, dtype=np.int64) for x in (zip(*lines) if lines else ([], [])))
    ordered = [parts[0], parts[1], parts[2], dup, parts[3], *parts[4:], n_lines]
    return pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in ordered], names=COUNTS + EXTRA)


def measured(docs: DataFrame, name: str = Q) -> DataFrame:
    """*docs* with a struct column of counts; only the text goes through Python."""

    @F.arrow_udf(MEASURES)
    def of(text: pa.Array) -> pa.Array:
        _, bounds = bytes_of(text)
        return pa.concat_arrays([measure(text.slice(i, j - i)) for i, j in slices(bounds, PORTION)] or [measure(text)])

    return docs.withColumn(name, of(F.coalesce("text", F.lit(""))))


def rule_values(q: str = Q) -> dict[str, Column]:
    def share(a: str, b: str) -> Column:
        return F.coalesce(F.col(f"{q}.{a}") / F.when(F.col(f"{q}.{b}") > 0, F.col(f"{q}.{b}")), F.lit(0.0))

    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "upper_share": share("n_upper", "n_letters"),
        "bang_share": share("n_bangs", "n_words"),
        "repeated_line_share": share("n_dup_lines", "n_lines"),
        "word_length": share("word_chars", "n_words"),
    }


def base_failed(q: str = Q) -> Column:
    return (F.col(f"{q}.n_words") < 10) | (100 * F.col(f"{q}.n_repeat_words") > 20 * F.col(f"{q}.n_words"))


def stratum() -> Column:
    return F.when(F.col("lang").isin(STRATA), F.col("lang")).otherwise(F.lit("other"))


def upper_bound(k: int, n: int, level: float) -> float:
    """Exact upper confidence bound of a share of which *k* of *n* draws were seen.

    The share p at which so few or fewer have probability *level*, by bisection
    on the binomial sum in logarithms.
    """
    if n == 0 or k >= n:
        return 1.0
    i = np.arange(k + 1)
    whole = math.lgamma(n + 1)
    ways = whole - np.array([math.lgamma(x + 1) + math.lgamma(n - x + 1) for x in i.tolist()])
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        terms = ways + i * math.log(p) + (n - i) * math.log1p(-p)
        top = terms.max()
        if top + math.log(np.exp(terms - top).sum()) > math.log(level):
            low = p
        else:
            high = p
    return high


def table_of(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, text hashes, counts) of every row, written once; no text moves."""
    return written(measured(docs).select("doc_id", "lang", *text_key(F.col("text")), Q), "measures")


def first_rejected(q: str = Q) -> Column:
    """The first step whose setting rejects a text, or the number of steps."""
    values = rule_values(q)

    def of(rule: str) -> Column:
        out = F.lit(len(STEPS))
        for t, (r, cutoff) in reversed(list(enumerate(STEPS))):
            if r == rule:
                out = F.when(values[rule] > F.lit(cutoff), t).otherwise(out)
        return out

    return F.least(*[of(r) for r in GRIDS])


def proven_steps(rejected_at: dict[int, int], risk: float, level: float) -> int:
    """How many steps of the sequence hold, from the number of good texts first rejected at each step."""
    n, lost = sum(rejected_at.values()), 0
    for t in range(len(STEPS)):
        lost += rejected_at.get(t, 0)
        if upper_bound(lost, n, level) > risk:
            return t
    return len(STEPS)


def fit_cutoffs(table: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> dict[tuple[str, str], float]:
    """{(stratum, rule): cutoff} from all rows of *labels* (doc_id, quality) that *table* (:func:`table_of`) has.

    A doc_id whose labels differ counts as good. Equal texts are one draw.
    Texts that fail the base rules are not at stake and are left out. A stratum
    needs ln(delta / strata) / ln(1 - risk) good texts (228) to prove a setting
    that rejects none of them; with fewer it has no cutoffs, and rules reject
    nothing there.
    """
    good = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(F.max("quality").alias("_good")).where("_good = 1")
    held = table.withColumn("_doc", F.col("doc_id").cast("long")).join(good, "_doc").where(~base_failed())
    texts = held.groupBy("_k1", "_k2", stratum().alias("stratum")).agg(F.min(first_rejected()).alias("step"))
    found: dict[str, dict[int, int]] = {}
    # At most one row for each stratum and step.
    for r in texts.groupBy("stratum", "step").agg(F.count("*").alias("n")).collect():
        found.setdefault(r["stratum"], {})[r["step"]] = r["n"]
    level = delta / (len(STRATA) + 1)
    out: dict[tuple[str, str], float] = {}
    for name, rejected_at in found.items():
        for rule, cutoff in STEPS[: proven_steps(rejected_at, risk, level)]:
            out[name, rule] = cutoff
    return out


def rejected(cutoffs: dict[tuple[str, str], float], q: str = Q) -> Column:
    """Whether a rule's value is above its cutoff in the row's stratum."""
    values = rule_values(q)
    tests = [(stratum() == s) & (values[rule] > F.lit(c)) for (s, rule), c in sorted(cutoffs.items())]
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def judge(docs: DataFrame, cutoffs: dict[tuple[str, str], float]) -> DataFrame:
    """*docs* with measures (:func:`measured` or :func:`table_of`), and base_failed and kept.

    Null texts count as empty and fail the base rules; a null or unknown lang is
    the stratum "other". Repeated rows are judged alike. Empty tables are
    allowed: without labels there are no cutoffs and only the base rules reject.
    """
    return docs.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected(cutoffs))


def kept_of(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The rows that the rules keep, with the columns of *docs*."""
    cutoffs = fit_cutoffs(table_of(docs), labels, risk, delta)
    q = free(docs, Q)
    return measured(docs, q).where(~base_failed(q) & ~rejected(cutoffs, q)).drop(q)
