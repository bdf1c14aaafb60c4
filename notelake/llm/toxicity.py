"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: accents, homoglyphs and digit substitutions become plain letters, letters of
other scripts stay and everything else becomes a space. Lexicon entries are whole words and word
beginnings; their weights are the log odds of toxic against clean documents over the labelled training
rows, of which ``FIT_ROWS`` at most are taken, the first by a hash of their id. Phrases in which an entry
occurs in clean documents only are exceptions: a match inside one does not count. The score is a
logistic function of the matched weights normalised by length.
"""

from __future__ import annotations

import math
import re
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import Scratch, small

#: Labelled documents that lexicon and logistic function are fitted on, at most.
FIT_ROWS = 200_000
#: Fewest toxic training documents that hold an entry, and its lowest weight.
SUPPORT, WEIGHT = 5, 2.0
BEGINNINGS = (4, 5, 6)
#: Look-alike letters and substitutions, each with the letter it stands for. i, l and 1 are one letter.
_LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ß": "s", "æ": "a", "ø": "o", "ł": "i",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "l": "i", "|": "i",
}
_TABLE = str.maketrans(_LOOKALIKES)
_OTHER = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """The folded words of a text with one space before and after each."""
    text = text.lower()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " " + _OTHER.sub(" ", text.translate(_TABLE)).strip() + " "


def entries_of(words: set[str]) -> set[str]:
    """Candidate entries: each whole word and its beginnings, a space marking the word's ends."""
    found = {f" {w} " for w in words}
    for n in BEGINNINGS:
        found.update(" " + w[:n] for w in words if len(w) >= n)
    return found


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: set[str] = frozenset()):
        self.weights, self.exceptions = weights, exceptions
        self.automaton = ahocorasick.Automaton()
        for entry, weight in weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        if weights:
            self.automaton.make_automaton()

    def matches(self, folded: str) -> list[tuple[int, float]]:
        """Start and weight of the strongest match of each word; exceptions left out."""
        best: dict[int, float] = {}
        if self.weights:
            for end, (size, weight) in self.automaton.iter(folded):
                at = end - size + 1
                if weight > best.get(at, 0.0):
                    best[at] = weight
        if self.exceptions and best:
            best = {at: w for at, w in best.items() if not any(p in self.exceptions for p in phrases(folded, at))}
        return sorted(best.items())

    def features(self, text: str) -> tuple[float, float, float]:
        """Log of the matched weight, matched weight for each square root of a word, matches."""
        folded = fold(text)
        found = self.matches(folded)
        total = sum(w for _, w in found)
        return math.log1p(total), total / math.sqrt(max(1, folded.count(" ") - 1)), math.log1p(len(found))


def phrases(folded: str, at: int) -> list[str]:
    """The word that starts behind the space at ``at`` with its left and with its right neighbour."""
    end = folded.find(" ", at + 1)
    left = folded.rfind(" ", 0, at) if at else -1
    right = folded.find(" ", end + 1)
    return [folded[left + 1 : end]] * (left >= 0) + [folded[at + 1 : right]] * (right >= 0)


def _counted(make):
    """Count (key, toxic) over a partition's documents; partial counts leave when the table is large."""

    def run(batches):
        counts: dict[str, list[int]] = {}

        def flush():
            rows = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())],
                names=["entry", "clean", "toxic"],
            )
            counts.clear()
            return rows

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for key in make(text or ""):
                    counts.setdefault(key, [0, 0])[toxic] += 1
                if len(counts) > 400_000:
                    yield flush()
        if counts:
            yield flush()

    return run


def learn(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str, text_col: str, exceptions: tuple[str, ...] = (), fit_rows: int = FIT_ROWS) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and logistic weights from labelled rows: ``labels(id, toxic)``, toxic 0 or 1."""
    known = labels.filter("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    train = scratch.save(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(small(scratch.save(known)), "id"))
    sizes = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return Lexicon({}), np.array([math.log((toxic + 0.5) / (clean + 0.5)) if toxic + clean else -3.0, 0, 0, 0])
    schema = "entry string, clean bigint, toxic bigint"
    counted = train.select("text", "toxic").mapInArrow(_counted(lambda text: entries_of(set(fold(text).split()))), schema)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    totals = counted.groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    chosen = totals.filter(F.col("toxic") >= SUPPORT).withColumn("weight", odds).filter(F.col("weight") >= WEIGHT)
    lexicon = Lexicon({r["entry"]: r["weight"] for r in chosen.select("entry", "weight").collect()}, {fold(x).strip() for x in exceptions})

    weights = lexicon.weights
    around = train.select("text", "toxic").mapInArrow(_counted(lambda text: Contexts.of(weights)(text)), schema)
    excused = around.groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter((F.col("clean") >= SUPPORT) & (F.col("toxic") == 0))
    exceptions_all = lexicon.exceptions | {r["entry"] for r in excused.select("entry").collect()}

    made = train.select("text", "toxic").mapInArrow(_features(weights, exceptions_all, ["toxic"]), "a double, b double, c double, toxic int").toArrow()
    x = np.column_stack([np.ones(made.num_rows), *[made[c].to_numpy() for c in "abc"]])
    return Lexicon(weights, exceptions_all), _logistic(x, made["toxic"].to_numpy().astype(float))


class Contexts:
    """One automaton per Python worker for counting the phrases around matches."""

    cached: tuple[dict, Lexicon] | None = None

    @classmethod
    def of(cls, weights: dict[str, float]):
        if cls.cached is None or cls.cached[0] is not weights:
            cls.cached = (weights, Lexicon(weights))
        plain = cls.cached[1]

        def contexts(text: str) -> set[str]:
            folded = fold(text)
            return {p for at, _ in plain.matches(folded) for p in phrases(folded, at)}

        return contexts


def _features(weights, exceptions, carry):
    def run(batches):
        lexicon = Lexicon(weights, exceptions)
        for batch in batches:
            made = np.array([lexicon.features(t or "") for t in batch.column("text").to_pylist()], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*[pa.array(made[:, i]) for i in range(3)], *map(batch.column, carry)], names=["a", "b", "c", *carry])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method for ridge logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def scored(docs: DataFrame, lexicon: Lexicon, logit: np.ndarray, cut: float = 0.7, text_col: str = "text", dropped: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``docs``, all columns but ``dropped`` kept, with ``score`` and ``predicted``, which replace columns of these names."""
    spare = [c for c in docs.columns if c not in ("score", "predicted", *dropped)]
    inner = [f"c{i}" for i in range(len(spare))]
    plain = docs.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(spare, inner, strict=True)), F.col(text_col).cast("string").alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields if f.name != "text")
    made = plain.mapInArrow(_features(lexicon.weights, lexicon.exceptions, inner), f"a double, b double, c double, {fields}")
    line = F.lit(float(logit[0])) + sum(F.lit(float(w)) * F.col(c) for w, c in zip(logit[1:], "abc", strict=True))
    score = 1 / (1 + F.exp(-line))
    return made.select(*(F.col(i).alias(c) for i, c in zip(inner, spare, strict=True)), score.alias("score"), (score >= cut).cast("int").alias("predicted"))


def learned(docs: DataFrame, labels: DataFrame, folds: int = 3, held_fold: int = 1, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", exceptions: tuple[str, ...] = (), fit_rows: int = FIT_ROWS) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and weights from the labels whose crc32(id as text) mod ``folds`` is not ``held_fold``."""
    taught = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic")).filter(_remainder(F.col("id"), folds) != held_fold)
    return learn(docs, taught, Scratch(docs.sparkSession, "toxicity"), id_col, text_col, exceptions, fit_rows)


def _remainder(ids, folds: int):
    return F.pmod(F.crc32(ids.cast("string").cast("binary")), F.lit(folds))


def toxicity(
    docs: DataFrame, labels: DataFrame, folds: int = 3, held_fold: int = 1, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", exceptions: tuple[str, ...] = (), fit_rows: int = FIT_ROWS
) -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` in 0 to 1 and ``predicted``.

    Labels teach only where crc32(id as text) mod ``folds`` is not ``held_fold``. A document labelled
    more than once is toxic if any row says so; null labels and ids teach nothing, and a label of an
    id that several rows have teaches each of them. Beyond ``fit_rows`` labelled ids, those first by a
    hash teach. The score depends on the text alone; a null text scores as an empty one, which has no
    matches. A null id is not held out. Rows that repeat are rows of their own; other columns are
    ignored; an empty table gives an empty result.
    """
    lexicon, logit = learned(docs, labels, folds, held_fold, id_col, text_col, label_col, exceptions, fit_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = scored(rows, lexicon, logit, cut, dropped=("text",))
    held = F.coalesce(_remainder(F.col("id"), folds) == held_fold, F.lit(False))
    return made.select(F.col("id").alias(id_col), held.alias("held_out"), "score", "predicted")
