"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: look-alike letters and digit substitutions become the letters they
stand for.  The lexicon (word beginnings and whole words with log-odds weights), phrases
that except a match, and the calibration are learned from labelled documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrospark.llm.common import arrow_map, batch, keep_texts
from hydrospark.scratch import cut

#: Labelled documents the lexicon and the calibration are learned from, at most.
MOST_LABELLED = 10_000
MOST_ENTRIES = 500
PREFIXES = range(4, 9)
LEAST_TOXIC, LEAST_WEIGHT, LEAST_Z = 5, 1.5, 3.0

# Letters of other scripts that look like Latin ones, and digits and signs written
# for letters.  "l", "1", "!" and "|" all fold to "i", as each may stand for "i" or "l".
HOMOGLYPHS = str.maketrans(
    "абсԁеһіјкӏорԛѕтѵхуԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορτυχАВЕКМНОРСТХІЈЅ",
    "abcdehijkiopqstvxywabezhikmnoptyxaiknoptuxabekmhopctxijs")
SUBSTITUTES = str.maketrans("013457@$!|l", "oieastasiii")
_FOREIGN = re.compile("[Ͱ-ԯ！-～]")
_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
_ASCII = bytes(ord(chr(b).lower().translate(SUBSTITUTES)) if b < 128 else b for b in range(256))
_GAPS = re.compile(r"[^\w*]+|_+|(?<!\w)\*+|\*+(?!\w)")


def fold(text: str) -> str:
    """Lower case, look-alikes and substitutes replaced, gaps as single spaces, a space at both ends."""
    text = text.encode("utf-8", "replace").translate(_ASCII).decode("utf-8")
    if _FOREIGN.search(text):
        text = text.translate(_WIDE).lower().translate(HOMOGLYPHS).translate(SUBSTITUTES)
    return f" {_GAPS.sub(' ', text).strip()} "


def _patterns(folded: str) -> set[str]:
    """Word beginnings and whole words, with the spaces that tie them to a word's start and end."""
    found = set()
    for word in set(folded.split()):
        if len(word) >= 3:
            found.add(f" {word} ")
            found.update(f" {word[:k]}" for k in PREFIXES if k <= len(word))
    return found


def _log_odds(a, b, of_a, of_b) -> float:
    return math.log((a + 0.5) / (of_a - a + 0.5)) - math.log((b + 0.5) / (of_b - b + 0.5))


_COUNTED = pa.schema([("pattern", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])


def _tally(batches, extract):
    toxic, clean = Counter(), Counter()
    for rows in batches:
        for text, label in zip(rows.column("text").to_pylist(), rows.column("toxic").to_pylist(), strict=True):
            (toxic if label else clean).update(extract(fold(text or "")))
    names = list(toxic.keys() | clean.keys())
    for low in range(0, len(names), 50_000):
        part = names[low:low + 50_000]
        yield batch(_COUNTED, part, [toxic[n] for n in part], [clean[n] for n in part])


def _counts(labelled: DataFrame, extract) -> DataFrame:
    """Documents of each label that hold a pattern; every task counts its own first."""
    counted = arrow_map(labelled.select("text", "toxic"), partial(_tally, extract=extract), "pattern string, toxic long, clean long")
    return counted.groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _phrases(folded: str, automaton) -> set[str]:
    """Whole words and word pairs around each match of a lexicon entry."""
    found = set()
    for end, (entry, _) in automaton.value.iter(folded):
        start = end - len(entry) + 1
        stop = folded.index(" ", start + 1)
        found.add(folded[start:stop + 1])
        if start:
            found.add(folded[folded.rindex(" ", 0, start):stop + 1])
        if stop < len(folded) - 1:
            found.add(folded[start:folded.index(" ", stop + 1) + 1])
    return found


class Automaton:
    """Entries with their weights and excepted phrases; built where it is first used."""

    def __init__(self, lexicon: dict[str, float], exceptions: frozenset[str] = frozenset()):
        self.lexicon, self.exceptions, self._machine = lexicon, exceptions, None

    def __getstate__(self):
        return {"lexicon": self.lexicon, "exceptions": self.exceptions, "_machine": None}

    @property
    def value(self):
        if self._machine is None:
            import ahocorasick

            self._machine = ahocorasick.Automaton()
            for phrase in self.exceptions - self.lexicon.keys():
                self._machine.add_word(phrase, (phrase, None))
            for entry, weight in self.lexicon.items():
                if entry not in self.exceptions:
                    self._machine.add_word(entry, (entry, weight))
            self._machine.make_automaton()
        return self._machine

    def features(self, folded: str) -> list[float]:
        """Sum of distinct weights; weights per root of length; greatest weight; sum per log of length."""
        words = max(1, folded.count(" ") - 1)
        if not self.lexicon:
            return [0.0, 0.0, 0.0, 0.0]
        hits, excepted = [], []
        for end, (entry, weight) in self.value.iter(folded):
            (excepted if weight is None else hits).append((end - len(entry) + 1, end, entry, weight))
        if excepted:
            hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b, _, _ in excepted)]
        best: dict[int, float] = {}
        for start, _, _, weight in hits:  # a beginning and its longer form count once
            best[start] = max(weight, best.get(start, 0.0))
        distinct = {folded[s:folded.index(" ", s + 1)]: w for s, w in best.items()}
        total = sum(distinct.values())
        return [total, sum(best.values()) / math.sqrt(words), max(distinct.values(), default=0.0),
                total / (1 + math.log(words))]


def _choose(counted: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Lexicon entries: significant ones, the strongest first, without forms that add nothing."""
    likely = counted.where((F.col("toxic") >= LEAST_TOXIC) & (F.col("toxic") * clean > F.col("clean") * toxic * 2))
    likely = likely.withColumn("z", (F.col("toxic") / toxic - F.col("clean") / clean) / F.sqrt(F.col("toxic") + F.col("clean")))
    found = []
    for row in likely.orderBy(F.desc("z"), "pattern").limit(20 * MOST_ENTRIES).collect():
        weight = _log_odds(row.toxic, row.clean, toxic, clean)
        z = weight / math.sqrt(1 / (row.toxic + 0.5) + 1 / (row.clean + 0.5))
        if weight >= LEAST_WEIGHT and z >= LEAST_Z:
            found.append((z, row.pattern, weight, row.toxic))
    found.sort(key=lambda x: (-x[0], -len(x[1]), x[1]))
    chosen: dict[str, float] = {}
    seen: dict[str, int] = {}
    for _, pattern, weight, toxic_docs in found:
        shorter = [pattern[:k] for k in range(5, len(pattern))]
        if any(p in chosen and weight < chosen[p] + 0.7 for p in shorter):
            continue
        if any(p.startswith(pattern.rstrip()) and seen[p] * 2 > toxic_docs and weight < chosen[p] + 0.7 for p in chosen):
            continue
        chosen[pattern], seen[pattern] = weight, toxic_docs
        if len(chosen) == MOST_ENTRIES:
            break
    return chosen


_FEATURES = pa.schema([("toxic", pa.int32()), *[(f"f{i}", pa.float64()) for i in range(4)]])


def _features(batches, automaton):
    for rows in batches:
        values = [automaton.features(fold(t or "")) for t in rows.column("text").to_pylist()]
        yield batch(_FEATURES, rows.column("toxic"), *np.array(values, float).reshape(-1, 4).T)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients, the constant first, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1e-6, *np.ones(x.shape[1] - 1)])  # none to speak of on the constant
    if not len(y):
        return beta
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> tuple[Automaton, np.ndarray]:
    """Lexicon, exceptions and calibration from at most ``most`` labelled documents.

    Labels are deduplicated by id (toxic if any row says so; null labels don't count); the
    sample is the ``most`` ids with the least hashes.  Half of it gives the lexicon, half the
    exceptions' and scores' calibration.  Without labels every score is one half.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = known.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(most)
    ids = {r.doc_id: r.toxic for r in sample.collect()}
    spark = docs.sparkSession
    chosen = spark.createDataFrame(list(ids.items()) or [(None, None)], "doc_id long, toxic int")
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).withColumn(
        "half", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)))
    labelled = cut(labelled)
    first, second = labelled.where("half = 0"), labelled.where("half = 1")
    sizes = {r.toxic: r.n for r in first.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    lexicon = _choose(_counts(first, _patterns), toxic, clean) if toxic and clean else {}
    automaton = Automaton(lexicon)
    if lexicon:
        phrases = _counts(labelled, partial(_phrases, automaton=automaton))
        harmless = phrases.where((F.col("clean") >= 3) & (F.col("toxic") * clean <= F.col("clean") * toxic))
        kept = harmless.orderBy(F.desc("clean"), "pattern").limit(20 * MOST_ENTRIES).collect()
        automaton = Automaton(lexicon, frozenset(r.pattern for r in kept))
    rows = arrow_map(second.select("text", "toxic"), partial(_features, automaton=automaton),
                     "toxic int, f0 double, f1 double, f2 double, f3 double").collect()
    data = np.array([tuple(r) for r in rows], float).reshape(-1, 5)
    return automaton, fit_logistic(data[:, 1:], data[:, 0])


_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _scores(texts: list[str | None], automaton, beta) -> np.ndarray:
    values = np.array([automaton.features(fold(t or "")) for t in texts], float).reshape(-1, 4)
    return 1 / (1 + np.exp(-np.clip(beta[0] + values @ beta[1:], -30, 30)))


def _score(batches, automaton, beta):
    for rows in batches:
        yield batch(_SCORED, rows.column("doc_id"), _scores(rows.column("text").to_pylist(), automaton, beta))


def _is_clean(texts: pa.Array, state) -> np.ndarray:
    automaton, beta, threshold = state
    return _scores(texts.to_pylist(), automaton, beta) < threshold


def without_toxic(docs: DataFrame, automaton: Automaton, beta: np.ndarray, threshold: float) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``, all columns unchanged; no row moves."""
    return keep_texts(docs, _is_clean, (automaton, beta, threshold))


def score_toxicity(docs: DataFrame, automaton: Automaton, beta: np.ndarray) -> DataFrame:
    """``doc_id, score`` in 0 to 1 for every whole text.

    Only the text counts.  Null and empty texts score as texts without any match.  Repeated
    rows score alike; an empty table gives no rows; other columns are ignored.
    """
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(chosen, partial(_score, automaton=automaton, beta=beta), "doc_id long, score double")
