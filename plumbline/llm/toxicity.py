"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding undoes look-alike letters and digit substitutions.  Terms are words, or
stems that any word may start with.  A document's weights are added, phrases of
the exception list excepted, and set against its length; a logistic curve turns
that into a score from 0 to 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fractions_of, utf8
from plumbline.session import materialize

#: Letters and signs that look like Latin letters, and digits that stand for them.
LOOK_ALIKES = str.maketrans(
    "аеорсухіјѕһԁԛԝкмтвнαεορυικτν013457@$",
    "aeopcyxijshdqwkmtbhaeopuiktvoieastas",
)
WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows of each class that the lexicon and the curve are fitted on at most.
SAMPLE = 6000
#: Terms, and exception phrases, at most; lengths of stems.
TERMS, PHRASES, STEMS = 2000, 500, (4, 5, 6)
#: A term's likelihood ratio must exceed this beyond twice the logarithm of the number of terms tried.
LEAST_RATIO = 4.0
#: The share of toxic documents among those with a term, classes as in the whole table, at least.
LEAST_PRECISION = 0.9


def folded(text: str) -> str:
    return text.lower().translate(LOOK_ALIKES)


@dataclass(frozen=True)
class Toxicity:
    """Terms are (text, is a stem, weight); the curve is intercept, slope of the sum, slope of the density."""

    terms: tuple[tuple[str, bool, float], ...] = ()
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-20.0, 0.0, 0.0)

    def matcher(self) -> ahocorasick.Automaton | None:
        by_text: dict[str, list] = {}
        for term, stem, weight in self.terms:
            by_text.setdefault(term, []).append((len(term), stem, weight))
        for phrase in self.exceptions:
            by_text.setdefault(phrase, []).append((len(phrase), False, None))
        if not by_text:
            return None
        automaton = ahocorasick.Automaton()
        for term, values in by_text.items():
            automaton.add_word(term, values)
        automaton.make_automaton()
        return automaton


def hits(text: str, automaton: ahocorasick.Automaton | None) -> list[tuple[int, int, float]]:
    """Start, end and weight of each matched term of folded text; of terms at one start the longest counts."""
    if automaton is None:
        return []
    best: dict[int, tuple[int, float]] = {}
    spared: list[tuple[int, int]] = []
    n = len(text)
    for last, values in automaton.iter(text):
        for size, stem, weight in values:
            start, end = last + 1 - size, last + 1
            if start and text[start - 1].isalpha() or not stem and end < n and text[end].isalpha():
                continue
            if weight is None:
                spared.append((start, end))
            elif start not in best or best[start][0] < end:
                best[start] = (end, weight)
    found = [(a, b, w) for a, (b, w) in best.items()]
    if spared:
        found = [x for x in found if not any(a <= x[0] and x[1] <= b for a, b in spared)]
    return found


def features(raw: bytes, automaton: ahocorasick.Automaton | None) -> tuple[float, float]:
    """Logarithms of the summed weight and of the weight per hundred words."""
    total = sum(w for _, _, w in hits(folded(raw.decode("utf-8", "replace")), automaton))
    if total <= 0:
        return 0.0, 0.0
    return float(np.log1p(total)), float(np.log1p(100 * total / max(1, len(raw.split()))))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document counts of words and stems by label, summed within the task."""
    counts: dict[tuple[str, bool], list[int]] = {}
    for batch in batches:
        for raw, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            words = set(WORD.findall(folded(raw.decode("utf-8", "replace"))))
            seen = {(w, False) for w in words} | {(w[:k], True) for w in words for k in STEMS if len(w) > k}
            for term in seen:
                counts.setdefault(term, [0, 0])[toxic] += 1
        if len(counts) > 400_000:
            yield _counted(counts)
            counts = {}
    yield _counted(counts)


def _counted(counts: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([t for t, _ in counts], pa.string()), pa.array([s for _, s in counts], pa.bool_()),
         pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())],
        ["term", "stem", "clean", "toxic"],
    )


def _phrases(model: Toxicity):
    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's two-word phrases around matched terms."""
        automaton = model.matcher()
        for batch in batches:
            out: list[tuple[str, int]] = []
            for raw, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                text, near = folded(raw.decode("utf-8", "replace")), set()
                for a, b, _ in hits(text, automaton):
                    left, right = re.search(r"[^\W\d_]+ $", text[max(0, a - 40) : a]), re.match(r"[^\W\d_]* [^\W\d_]+", text[b : b + 40])
                    near |= {text[a - len(left[0]) : b]} if left else set()
                    near |= {text[a : b + right.end()]} if right else set()
                out += [(p, toxic) for p in near]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([t for _, t in out], pa.int32())], ["phrase", "toxic"])

    return phrases


def _features(model: Toxicity):
    @F.pandas_udf("sum double, density double")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = model.matcher()
        for texts in batches:
            yield pd.DataFrame([features(bytes(t), automaton) for t in texts], columns=["sum", "density"])

    return both


def train(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, doc_id: str = "doc_id", text: str = "text",
    toxic: str = "toxic", sample: int = SAMPLE, seed: int = 7,
) -> Toxicity:
    """Lexicon, exceptions and curve from labelled rows that are ``usable``.

    The fit reads at most ``sample`` rows of each class, those of least hash, so
    it costs the same at any size, and of equal texts one; the share of toxic rows
    is counted over all.
    Null labels or ids, and labels without a document, are left out.  Without
    rows of both classes the lexicon is empty and the score is the toxic share.
    """
    marked = labels.select(F.col(doc_id).alias("_id"), (F.col(toxic) != 0).cast("int").alias("toxic")).where("toxic is not null and _id is not null")
    if usable is not None:
        marked = marked.where(usable)
    n = {r[0]: r[1] for r in marked.groupBy("toxic").count().collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    flat = Toxicity(curve=(float(np.log((share + 1e-9) / (1 - share + 1e-9))), 0.0, 0.0))
    if not n.get(0) or not n.get(1):
        return flat
    chosen = None
    for label in (0, 1):
        rows = marked.where(F.col("toxic") == label).orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(sample)
        chosen = rows if chosen is None else chosen.union(rows)
    texts = docs.select(F.col(doc_id).alias("_id"), utf8(text).alias("text"))
    rows = texts.join(F.broadcast(chosen), "_id").select("text", "toxic").dropDuplicates(["text"])
    rows = materialize(rows, "labelled")

    size = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    a, b = size.get(0, 0), size.get(1, 0)
    if not a or not b:
        return flat
    counts = rows.mapInArrow(_terms, "term string, stem boolean, clean long, toxic long").groupBy("term", "stem")
    counts = materialize(counts.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "terms")
    odds = lambda k, m: F.log((F.col(k) + 0.5) / (F.lit(m + 0.5) - F.col(k)))
    part = lambda k, m: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / ((F.col("clean") + F.col("toxic")) * m / (a + b)))).otherwise(0.0)
    best = counts.select("term", "stem", (odds("toxic", b) - odds("clean", a)).alias("weight"), (2 * (part("toxic", b) + part("clean", a))).alias("ratio"))
    # log odds of toxic given the term = weight + log odds of toxic
    least = float(np.log(LEAST_PRECISION / (1 - LEAST_PRECISION)) - np.log(share / (1 - share)))
    best = best.where((F.col("weight") >= least) & (F.col("ratio") >= LEAST_RATIO + 2 * float(np.log(max(1, counts.count())))))
    best = best.orderBy(F.desc("ratio"), "term", "stem").limit(TERMS).collect()
    lexicon = Toxicity(tuple((r.term, r.stem, float(r.weight)) for r in best))

    phrases = rows.mapInArrow(_phrases(lexicon), "phrase string, toxic int").groupBy("phrase")
    phrases = phrases.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).where("toxic = 0 and n >= 5")
    spared = tuple(r.phrase for r in phrases.orderBy(F.desc("n"), "phrase").limit(PHRASES).collect())
    lexicon = Toxicity(lexicon.terms, spared)

    found = rows.select(_features(lexicon)("text").alias("f"), "toxic").select("f.*", "toxic").collect()
    x = np.array([[1.0, r["sum"], r["density"]] for r in found])
    y = np.array([r["toxic"] for r in found], float)
    return Toxicity(lexicon.terms, spared, _curve(x, y, share))


def _curve(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small ridge; classes weigh as in the whole table."""
    weight = np.where(y > 0, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 0.1 * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def score(docs: DataFrame, model: Toxicity, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 of each whole text.

    Null counts as empty; a text without a match, an empty one too, has the
    curve's base score.  Rows are independent and keep their columns, except that
    a column called ``name`` is replaced; an empty table stays empty.
    """

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton, (base, a, b) = model.matcher(), model.curve
        for texts in batches:
            f = np.array([features(bytes(t), automaton) for t in texts]).reshape(-1, 2)
            yield pd.Series(1 / (1 + np.exp(-np.clip(base + a * f[:, 0] + b * f[:, 1], -30, 30))))

    return docs.withColumn(name, scored(utf8(text)))


def train_by_contract(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> Toxicity:
    """Training without the rows whose crc32 of the id, modulo 4, is 2."""
    return train(docs, labels, fractions_of("_id", 4) != 2, doc_id)
