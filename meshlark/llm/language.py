"""Operator 2: language identification by a string kernel with Nyström landmarks.

*Kernel.* A text becomes the set of the character n-grams (n = 1, 2, 3) of its lower-cased
letters, words set apart by single blanks: the blended spectrum, by presence. Two texts'
kernel is the size of the sets' intersection over the geometric mean of their sizes.

*Landmarks.* ``landmarks`` training texts, spread evenly over the languages. With the kernel
matrix of the landmarks, every text gets Nyström features.

*Regression.* One kernel ridge regression for each language against the rest, in closed form on
the Nyström features, folds into one matrix: a batch's scores are (presence matrix of the batch)
x (presence matrix of the landmarks), scaled to kernel values, x (coefficients).

The model is fitted on a bounded sample of training rows (``FIT_ROWS``), drawn for each language apart: as many
for each as have room, all of a language with fewer, and never less than ``FIT_LEAST`` of one that has them,
so that rare languages are learned too. It reads only their texts and languages. Every text is scored whole.

Defined cases: a text that is null or has no letter is ``und`` with score 0; ties go to the
language that comes first in code-point order; with no training row every text is ``und``; with one
language every text with a letter is of it; repeated rows are learned from once and predicted alike; a very
long text has no more features than ``SPACE``, and no more than ``SPACE / 8`` bytes of it reach the
driver; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.llm.common import free_names

#: Training rows and landmarks, at most; ridge; steepness of the score.
FIT_ROWS, LANDMARKS, RIDGE, STEEP = 4000, 128, 1e-3, 6.0
#: Rows of each language that the sample has room for, however many languages there are.
FIT_LEAST = 64
#: Letters become one of 255 symbols (0 is a blank); feature numbers of n-grams start at these.
TWO, THREE, SPACE = 256, 256 + 65536, 256 + 65536 + 65536
#: Texts scored by one matrix product.
BATCH = 128


@cache
def symbols() -> np.ndarray:
    """The symbol of every code point: 0 if it is no letter; case makes no difference."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = ord(s.lower()[0])
            out[c] = low - 96 if 97 <= low < 123 else 27 + low % 229
    return out


def features(text: str | None) -> np.ndarray:
    """The sorted numbers of the n-grams that a text has; empty if it has no letter."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    s = symbols()[points]
    if not s.any():
        return np.zeros(0, np.int32)
    s = np.r_[np.uint8(0), s, np.uint8(0)]
    s = s[np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]].astype(np.uint32)  # one blank between words
    two = s[:-1] << 8 | s[1:]
    three = (two[:-1] << 8 | s[2:]) * np.uint32(2654435761) >> np.uint32(16)
    have = np.zeros(SPACE, bool)
    have[s], have[TWO + two], have[THREE + three] = True, True, True
    return np.flatnonzero(have).astype(np.int32)


@dataclass
class Model:
    """``column`` of each feature (-1: in no landmark), presence of landmarks, their sizes, coefficients."""

    langs: list[str]
    column: np.ndarray
    marks: np.ndarray
    size: np.ndarray
    coef: np.ndarray

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Kernel values of a batch against the landmarks."""
        x = np.zeros((len(sets), self.marks.shape[1]), np.float32)
        for row, f in zip(x, sets, strict=True):
            at = self.column[f]
            row[at[at >= 0]] = 1
        sizes = np.array([max(1, len(f)) for f in sets])
        return (x @ self.marks.T) / np.sqrt(sizes[:, None] * self.size)

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        """A probability for each text and language."""
        out = []
        for k in range(0, len(sets), BATCH):
            z = STEEP * (self.kernel(sets[k : k + BATCH]) @ self.coef)
            e = np.exp(z - z.max(1, keepdims=True))
            out.append(e / e.sum(1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(self.langs)))


def fit_model(sets: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """The model of training texts; None without any."""
    if not sets:
        return None
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(5)
    each = [rng.permutation(np.flatnonzero(y == k)) for k in range(len(names))]
    chosen = [int(rows[i]) for i in range(max(map(len, each))) for rows in each if i < len(rows)][:landmarks]
    used = np.unique(np.concatenate([sets[i] for i in chosen]))
    column = np.full(SPACE, -1, np.int32)
    column[used] = np.arange(len(used))
    marks = np.zeros((len(chosen), len(used)), np.float32)
    for row, i in zip(marks, chosen, strict=True):
        row[column[sets[i]]] = 1
    model = Model(names, column, marks, np.array([len(sets[i]) for i in chosen], float), np.zeros((len(chosen), len(names))))
    among = model.kernel([sets[i] for i in chosen]).astype(float)
    value, vector = np.linalg.eigh((among + among.T) / 2)
    root = vector / np.sqrt(np.maximum(value, 1e-6))  # features = kernel @ root
    phi = np.concatenate([model.kernel(sets[k : k + BATCH]) for k in range(0, len(sets), BATCH)]) @ root
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = (1 / np.bincount(y))[y][:, None] / len(names)  # languages count alike
    gram = phi.T @ (weight * phi) + ridge * np.eye(phi.shape[1])
    model.coef = (root @ np.linalg.solve(gram, phi.T @ (weight * target))).astype(np.float32)
    return model


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [packed(features(t)) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], ["found", "lang"])


def packed(found: np.ndarray) -> bytes:
    """Feature numbers as a byte of the form and 4 bytes each, or a bit for every possible one: ``SPACE / 8 + 1`` bytes at most."""
    if len(found) * 32 <= SPACE:
        return b"\0" + found.astype("<i4").tobytes()
    bits = np.zeros(SPACE, bool)
    bits[found] = True
    return b"\1" + np.packbits(bits).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """What :func:`packed` packs."""
    if data[0]:
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1))).astype(np.int32)
    return np.frombuffer(data, "<i4", offset=1)


def _share(counts: list[int], most: int) -> int:
    """The largest number of rows a language at which all languages together have no more than ``most``."""
    left, room = len(counts), most
    for n in sorted(counts):
        if n * left > room:
            return max(FIT_LEAST, room // left)
        left, room = left - 1, room - n
    return max([FIT_LEAST, *counts])


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """The different ``(text, lang)`` of the least hashes of each language, at most about ``most`` texts in all.

    A language with more rows than its share gives exactly its share of different texts.
    """
    hashed = F.xxhash64("text", F.lit(977))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(hashed, 0.02).alias("n")).collect()}
    share = _share(list(counts.values()), most)
    thinned = {lang: n for lang, n in counts.items() if n > 0.9 * share}
    if not thinned:
        return rows.distinct()
    scale = 1 << 62
    kept = F.pmod(hashed, F.lit(scale))

    def of(values: dict) -> Column:
        known = F.create_map(*[x for lang, v in values.items() for x in (F.lit(lang), F.lit(v).cast("long"))])
        return F.coalesce(F.element_at(known, F.col("lang")), F.lit(scale))

    # About twice the share lies below the first limits; the exact ones are ranks among those few hashes.
    first = {lang: min(scale, int(scale * 2.0 * share / n)) for lang, n in thinned.items()}
    few = rows.where(F.col("lang").isin(*thinned)).select("lang", kept.alias("h")).where(F.col("h") < of(first)).distinct()
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") == share + 1)
    exact = {r["lang"]: r["h"] for r in ranked.collect()}
    return rows.where(kept < of({**first, **exact})).distinct()


def fit(training: DataFrame, *, text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> Model | None:
    """The model of the rows of ``training`` that have a text with a letter and a language."""
    rows = training.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    got = _sample(rows.where(F.col("text").rlike(r"\p{L}")), fit_rows).mapInArrow(_sets, "found binary, lang string").toArrow()
    pairs = zip(got.column("found").to_pylist(), got.column("lang").to_pylist(), strict=True)
    got = sorted(((unpacked(f), lang) for f, lang in pairs if len(f) > 1), key=lambda r: (r[1], r[0].tobytes()))
    return fit_model([f for f, _ in got], [lang for _, lang in got])


def identify(docs: DataFrame, model: Model | None, *, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "lang_score") -> DataFrame:
    """``docs`` with two more columns, ``lang_out`` and ``score_out`` (or :func:`free_names` for them)."""
    both, lang_out, score_out = free_names(docs, "language", lang_out, score_out)

    @F.pandas_udf("lang string, score double")
    def predict(texts):
        import pandas as pd

        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        if model is not None:
            texts = texts.tolist()
            for k in range(0, len(texts), BATCH):
                sets = [(i, f) for i, t in enumerate(texts[k : k + BATCH], k) if len(f := features(t))]
                for (i, _), p in zip(sets, model.scores([f for _, f in sets]), strict=True):
                    lang[i], score[i] = model.langs[int(p.argmax())], float(p.max())
        return pd.DataFrame({"lang": lang, "score": score})

    out = docs.withColumn(both, predict(F.col(text_col)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(both)["lang"].alias(lang_out), F.col(both)["score"].alias(score_out))
