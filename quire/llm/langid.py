"""Language identification in two levels: language family first, then one-versus-one linear SVMs within the family.

Features are counts of byte n-grams (1 to 3) of the lower-cased text, hashed, damped and brought to unit length.
Each support vector machine is trained in a Spark task of its own, on a bounded sample of labelled documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize

#: Language codes of each family. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi".split(),
    "romance": "ca es fr gl it la oc pt ro".split(),
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk".split(),
    "uralic": "et fi hu".split(),
    "turkic": "az kk ky tk tr tt ug uz".split(),
    "indic": "as bn gu hi mr ne or pa sa si ur".split(),
    "semitic": "am ar he mt".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
#: Feature places, and documents of each language in the training sample: the bound of the fitted sample.
PLACES, MAX_PER_LANGUAGE = 1 << 13, 1500
EPOCHS, C = 12, 8.0
#: Least score of a document whose language counts as known.
KNOWN = 0.35
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and unit-length values of a text's n-gram features."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8).astype(np.uint32)
    two = (b[:-1] << 8) | b[1:]
    three = (two[:-1] << 8) | b[2:]
    keys = np.concatenate([b * np.uint32(0x9E3779B1), (two + np.uint32(1 << 25)) * np.uint32(0x85EBCA6B), (three + np.uint32(1 << 26)) * np.uint32(0xC2B2AE35)])
    counts = np.bincount(keys >> np.uint32(32 - 13), minlength=PLACES)
    at = np.flatnonzero(counts)
    value = np.sqrt(counts[at])
    return at, value / np.linalg.norm(value)


def train_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> np.ndarray:
    """Weights and bias of an L2-regularised squared-hinge SVM, by dual coordinate descent in a fixed random order."""
    rng, n = np.random.default_rng(1), len(rows)
    w, alpha = np.zeros(PLACES + 1), np.zeros(n)
    balance = np.where(y > 0, n / max(1, 2 * (y > 0).sum()), n / max(1, 2 * (y < 0).sum()))
    slack = 1 / (2 * C * balance)
    for _ in range(EPOCHS):
        for i in rng.permutation(n):
            at, value = rows[i]
            gradient = y[i] * (value @ w[at] + w[-1]) - 1 + slack[i] * alpha[i]
            new = max(alpha[i] - gradient / (2 + slack[i]), 0.0)  # unit length and a bias of 1: squared norm 2
            step, alpha[i] = (new - alpha[i]) * y[i], new
            w[at] += step * value
            w[-1] += step
    return w


class Model:
    """families: languages of each. pair: weights that are positive for the first of two names (families or languages)."""

    def __init__(self, families: dict[str, list[str]], pair: dict[tuple[str, str], np.ndarray]):
        self.families, self.pair = families, pair
        self.stack = np.stack([*pair.values()], axis=1) if pair else np.zeros((PLACES + 1, 0))
        self.order = {k: i for i, k in enumerate(pair)}

    def vote(self, names: list[str], margins: np.ndarray) -> tuple[str, float]:
        """One-versus-one: most duels won, then greatest sum of margins, then first name. Probability: the winner's closest duel."""
        wins, total, least = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, np.inf)
        for a, b in combinations(names, 2):
            m = margins[self.order[a, b]]
            wins[a if m >= 0 else b] += 1
            total[a] += m
            total[b] -= m
            least[a], least[b] = min(least[a], m), min(least[b], -m)
        best = max(sorted(names), key=lambda x: (wins[x], total[x]))
        return best, 1.0 if len(names) == 1 else float(1 / (1 + np.exp(-4 * np.clip(least[best], -20, 20))))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or not has_letter(text):
            return "und", 0.0
        at, value = features(text)
        margins = value @ self.stack[at] + self.stack[-1]
        family, sure = self.vote(sorted(self.families), margins)
        language, also = self.vote(self.families[family], margins)
        return language, min(1.0, max(0.0, sure * also))


def training_rows(docs: DataFrame, seed: int = 7) -> DataFrame:
    """text and lang of about MAX_PER_LANGUAGE documents of each language, by hash of text. A text counts once for a language, however often it stands there, so a much copied text is one in the sample and among those that it is drawn from."""
    usable = docs.where("text is not null and lang is not null and lang <> 'und'")
    # Equal texts are told by their digests, so that texts need not move; a language is counted by what it has of them.
    texts = usable.select("lang", F.sha2(F.encode("text", "UTF-8"), 256).alias("_key")).distinct()
    count = {r.lang: r["count"] for r in texts.groupBy("lang").count().collect()}  # one row for each language
    cut = F.lit(0)
    for lang, n in count.items():
        cut = F.when(F.col("lang") == lang, int(min(1.0, MAX_PER_LANGUAGE / n) * 1_000_000) + 1).otherwise(cut)
    drawn = usable.select("text", "lang").where(F.expr(f"pmod(xxhash64(text, {seed}), 1000000)") < cut)
    return drawn.distinct()


def fit(docs: DataFrame) -> Model:
    """A model of the languages in docs (text, lang); rows without either, or without a letter, teach nothing."""

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lang, *features(text)) for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if has_letter(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1].astype(np.int32).tobytes() for r in rows], pa.binary()), pa.array([r[2].tobytes() for r in rows], pa.binary())], ["lang", "places", "vals"])

    rows = materialize(map_batches(training_rows(docs), featurize, "lang string, places binary, vals binary"))
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect())
    families: dict[str, list[str]] = {}
    for lang in languages:
        families.setdefault(FAMILY_OF.get(lang.split("-")[0], lang), []).append(lang)
    duels = [(a, b, families[a], families[b]) for a, b in combinations(sorted(families), 2)]
    duels += [(a, b, [a], [b]) for members in families.values() for a, b in combinations(members, 2)]
    if not duels:
        return Model(families, {})
    sides = docs.sparkSession.createDataFrame([(a, b, lang, y) for a, b, x, z in duels for y, langs in ((1, x), (-1, z)) for lang in langs], "a string, b string, lang string, y int")

    def train(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["places", "vals"], kind="stable")
        data = [(np.frombuffer(p, np.int32), np.frombuffer(v)) for p, v in zip(table.places, table.vals, strict=True)]
        return pd.DataFrame({"a": [key[0]], "b": [key[1]], "w": [train_svm(data, table.y.to_numpy(np.float64)).tobytes()]})

    # A duel's task holds the bounded samples of its languages.
    got = rows.join(F.broadcast(sides), "lang").groupBy("a", "b").applyInPandas(train, "a string, b string, w binary").collect()
    return Model(families, {(r.a, r.b): np.frombuffer(r.w) for r in sorted(got, key=lambda r: (r.a, r.b))})


def predict_language(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) for each row of docs.

    docs needs doc_id and text; other columns are left aside. A text that is null or without a letter gets `und` and 0,
    as does every text if nothing was learned. Texts are read whole, however long. Repeated rows come back as often as
    given. Ties between languages go to the first name. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # PLACES weights for each duel

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(docs, run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least: float = KNOWN) -> DataFrame:
    """docs, all columns and repeated rows, without the documents of no language (`und`) or of a score below least.

    Texts that are null, empty or without a letter go, as no language is theirs; null ids make no difference; long texts
    are read whole; an empty table gives an empty one.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.predict(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in got], pa.bool_()))

    return map_batches(docs, run, docs.schema)
