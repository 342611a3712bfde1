"""Operator 5: toxicity of whole texts after undoing obfuscation by a noisy channel.

*Channel.* A token that is not plain letters, has a letter three times running, or comes out of
letters that are spaced out, may be an obfuscated word. Its character lattice has, at each
position, the letters that the character may stand for (itself, look-alikes), nothing (marks and
blanks put between letters), and for a run of one letter, one or two of it; every choice has a
cost.

*Language model.* Letter trigrams over all words of plain letters of the whole table, counted by
Spark (at most ``LETTERS ** 3`` counts come back). A token's restored form is the path of least
total cost, found by Viterbi decoding over pairs of letters.

*Score.* A logistic regression over the restored words and word beginnings that a text has (present
or not), fitted on a bounded sample of the labelled rows of the training fold (``FIT_ROWS``); its
features are those that tell the labels apart most surely. Labels come from the join with ``labels``; a score
reads the text alone.

Defined cases: a text without words (null, empty, white space) gets the score of the constant; without
training rows of both labels all texts get the share of toxic ones (0, where there is none); equal
texts score alike; a text with both labels is trained on once for each, equal texts of one label once; of paths of one
cost the first found stays, of equally sure features the lower number; a very long text is read whole, and no more than
``USED`` bits of a text reach the driver; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm.common import bounded_sample, free_names, materialise

#: Labelled rows for fitting, at most; hashed features; features that the regression may use.
FIT_ROWS, HASHED, USED = 20_000, 1 << 20, 2048
#: Lengths of the word beginnings that are features beside the words.
STARTS = (4, 7)
#: Symbols of the language model: 0 a word's edge, 1-26 a-z, 27 any other letter.
LETTERS, OTHER = 28, 27
#: What characters may stand for: fixed values.
LOOKALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i",
}
#: Costs in nats: a look-alike, a mark between letters, a digit dropped, letters of a long run or of a pair dropped.
STAND_IN, MARK, DIGIT, RUN, PAIR = 0.5, 0.3, 12.0, 0.3, 2.5
#: Distinct tokens whose restored form and features a worker remembers.
MEMORY = 1 << 18

_PLAIN = re.compile(r"[^\W\d_]+")
_TRIPLE = re.compile(r"(.)\1\1")
_EDGE = re.compile(r"^(?:[^\w$@]|_|([$@])\1\1+)+|(?:[^\w$@]|_|([$@])\2\2+)+$")


def hashed(word: str) -> tuple[int, ...]:
    """The hashed numbers of a restored word and its beginnings."""
    parts = [word, *(f"{word[:n]}-" for n in STARTS if len(word) >= n)]
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % HASHED for x in parts)


def symbol(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else OTHER


def trigrams(text: str) -> np.ndarray:
    """Counts of letter trigrams over the words of plain letters, edges included."""
    words = [w for w in text.lower().split() if w.isalpha()]
    raw = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    s = np.where(raw == 32, 0, np.where((raw >= 97) & (raw < 123), raw - 96, OTHER))
    if not words:
        return np.zeros(LETTERS**3, np.int64)
    # Two blanks between words: the pair (edge, edge) never goes into one word's trigram.
    code = (s[:-2] * LETTERS + s[1:-1]) * LETTERS + s[2:]
    return np.bincount(code[(s[1:-1] != 0)], minlength=LETTERS**3)


@dataclass
class Restorer:
    """Undoes obfuscation under ``cost``: nats of a letter after two others, LETTERS cubed.

    With ``only``, features are those among it.
    """

    cost: np.ndarray
    only: frozenset[int] | None = None
    memory: dict[str, tuple[str, tuple[int, ...]]] = field(default_factory=dict)

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Restorer:
        three = counts.reshape((LETTERS,) * 3).astype(float)
        two = three.sum(0) + 0.1  # letter after letter, to back off to
        two /= two.sum(1, keepdims=True)
        many = three.sum(2, keepdims=True)
        return cls(-np.log((three + 2 * two[None]) / (many + 2)))

    def __getstate__(self):
        return {"cost": self.cost, "only": self.only, "memory": {}}

    def options(self, ch: str, run: int) -> list[tuple[str, float]]:
        """What a run of one character may stand for, with costs."""
        out = []
        if ch.isalpha():
            out.append((ch, PAIR if run == 2 else RUN * (run > 1)))
            if run > 1:
                out.append((ch * 2, RUN * (run > 2)))
        for x in LOOKALIKE.get(ch, ""):
            out.append((x, STAND_IN + (PAIR if run == 2 else RUN * (run > 1))))
            if run > 1:
                out.append((x * 2, 2 * STAND_IN + RUN * (run > 2)))
        if not ch.isalpha():
            out.append(("", (DIGIT if ch.isdigit() else MARK) * run))
        return out

    def decode(self, token: str) -> str:
        """The path of least cost through the token's lattice."""
        best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        # From an edge, the model has seen words' first two letters after (edge, first).
        at = 0
        while at < len(token):
            run = 1
            while at + run < len(token) and token[at + run] == token[at]:
                run += 1
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, path) in best.items():
                for letters, price in self.options(token[at], run):
                    x, y, total, way = a, b, cost + price, path
                    for ch in letters:
                        s = symbol(ch)
                        total += 2.0 if y == 0 else self.cost[x, y, s]
                        x, y, way = y, s, (way, ch)
                    if (x, y) not in new or total < new[x, y][0]:
                        new[x, y] = (total, way)
            best, at = new, at + run
        ends = [(cost + (self.cost[a, b, 0] if b else 8.0), path) for (a, b), (cost, path) in best.items()]
        _, path = min(ends, key=lambda e: e[0])
        letters = []
        while path:
            path, ch = path
            letters.append(ch)
        return "".join(reversed(letters))

    def restored(self, token: str) -> tuple[str, tuple[int, ...]]:
        """The restored form of one lower-cased token ('' if nothing of it is a word), and its features."""
        got = self.memory.get(token)
        if got is None:
            plain = token.isalpha() and not _TRIPLE.search(token)
            core = token if plain else _EDGE.sub("", token)
            if not (plain or _PLAIN.fullmatch(core) and not _TRIPLE.search(core)):
                core = self.decode(core) if any(c.isalpha() or c in LOOKALIKE for c in core) else ""
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            codes = hashed(core) if core else ()
            got = self.memory[token] = core, codes if self.only is None else tuple(k for k in codes if k in self.only)
        return got

    def tokens(self, text: str | None) -> set[str]:
        """The lower-cased tokens of a text; letters that are spaced out also as one token."""
        tokens = (text or "").lower().split()
        found, begin = set(tokens), None
        for i, t in enumerate([*tokens, "--"]):
            single = len(t) < 3 and (len(t) == 1 and (t.isalpha() or t in LOOKALIKE) or len(t) == 2 and t[0].isalpha() and t[1] in ".,-_*")
            if single and begin is None:
                begin = i
            elif not single and begin is not None:
                # A word of one letter may stand beside the run: also without its first, without its last.
                found.update(" ".join(tokens[a:b]) for a in (begin, begin + 1) for b in (i, i - 1) if b - a >= 3)
                begin = None
        return found

    def word(self, token: str) -> str:
        return self.restored(token)[0]

    def words(self, text: str | None) -> set[str]:
        """The restored words of a text."""
        return {self.restored(t)[0] for t in self.tokens(text)} - {""}

    def restore(self, text: str | None) -> str:
        """A text of the restored tokens, in order, joined by blanks."""
        return " ".join(w for t in (text or "").lower().split() if (w := self.word(t)))

    def numbers(self, text: str | None) -> np.ndarray:
        """The hashed numbers of the features that a text has, ascending."""
        found: set[int] = set()
        known = self.memory.get
        for t in self.tokens(text):
            if codes := (known(t) or self.restored(t))[1]:
                found.update(codes)
        return np.fromiter(sorted(found), np.int64, len(found))


def count_trigrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The language model's counts over the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    total += trigrams(t)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "many"])

    rows = docs.select(F.col(text_col)).mapInArrow(run, "code long, many long").groupBy("code").agg(F.sum("many")).collect()
    out = np.zeros(LETTERS**3, np.int64)
    for code, many in rows:
        out[code] = many
    return out


def fit(has: np.ndarray, toxic: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Weights of the features and, last, the constant, from a matrix of the features that each row has."""
    row, col = np.nonzero(has)
    base = toxic.mean()
    w, m, v = np.zeros(has.shape[1] + 1), 0.0, 0.0
    w[-1] = np.log(base / (1 - base))
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[col], len(toxic)) + w[-1]
        off = 1 / (1 + np.exp(-z)) - toxic
        grad = np.r_[np.bincount(col, off[row], has.shape[1]), off.sum()] / len(toxic) + np.r_[2e-4 * w[:-1], 0]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit_toxicity(docs: DataFrame, labelled: DataFrame, *, text_col: str = "text", used: int = USED) -> tuple[Restorer, np.ndarray, float]:
    """The model: a restorer for the language of ``docs``, and weights learned from ``labelled(text, toxic)``.

    Spark counts the features; the driver gets the counts of the ``used`` surest ones, and a bit for each of
    these from every row: 256 bytes a row, however long the texts are.
    """
    restorer = Restorer.of_counts(count_trigrams(docs, text_col))

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [restorer.numbers(t).astype("<i4").tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], ["found", "toxic"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, HASHED), np.int64)
        for batch in batches:
            for found, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n[toxic, np.frombuffer(found, "<i4")] += 1  # a row has each number once
        at = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.sum(0)[at]), pa.array(n[1, at])], ["code", "n", "pos"])

    rows = labelled.select("text", (F.col("toxic") > 0).cast("int").alias("toxic")).where("toxic is not null")
    rows = materialise(rows.mapInArrow(numbers, "found binary, toxic int"), "features")
    many, toxic = rows.agg(F.count("toxic"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    weights = np.zeros(HASHED)
    share = toxic / many if many else 0.0
    if share in (0.0, 1.0):
        return restorer, weights, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))

    n, pos, var = F.col("n"), F.col("pos"), F.greatest(F.col("n") * (share * (1 - share)), F.lit(1e-9))
    sure = F.abs(pos - n * share) / F.sqrt(var)
    counts = rows.mapInArrow(counted, "code long, n long, pos long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    top = counts.where((n >= 5) & (sure > 4)).orderBy(sure.desc(), "code").limit(used).select("code").collect()
    chosen = np.sort(np.array([r.code for r in top], np.int64))
    column = np.full(HASHED, -1, np.int64)
    column[chosen] = np.arange(len(chosen))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = np.zeros((batch.num_rows, max(1, len(chosen))), bool)
            for row, found in zip(has, batch.column(0).to_pylist(), strict=True):
                at = column[np.frombuffer(found, "<i4")]
                row[at[at >= 0]] = True
            packed = [x.tobytes() for x in np.packbits(has, axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column(1)], ["has", "toxic"])

    got = rows.mapInArrow(bits, "has binary, toxic int").toArrow()
    got = sorted(zip(got.column("toxic").to_pylist(), got.column("has").to_pylist(), strict=True))
    has = np.unpackbits(np.frombuffer(b"".join(x for _, x in got), np.uint8).reshape(len(got), -1), axis=1)[:, : len(chosen)]
    w = fit(has, np.array([float(y) for y, _ in got]))
    weights[chosen] = w[:-1]
    return restorer, weights, float(w[-1])


def labelled_rows(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Different ``(text, toxic)`` of at most about ``fit_rows`` labels; the labels' ids are broadcast, bounded by that."""
    chosen = bounded_sample(labels.select(F.col(id_col).alias("__id"), "toxic").where("__id is not null and toxic is not null"), "__id", fit_rows)
    return docs.join(F.broadcast(chosen), docs[id_col] == chosen["__id"]).select(F.col(text_col).alias("text"), "toxic").distinct()


def score_toxicity(docs: DataFrame, model: tuple[Restorer, np.ndarray, float], *, text_col: str = "text", score_out: str = "toxicity") -> DataFrame:
    """``docs`` with one more column ``score_out`` (or :func:`free_names` for it), 0 to 1."""
    (score_out,) = free_names(docs, score_out)
    restorer, weights, const = model
    restorer = Restorer(restorer.cost, frozenset(np.flatnonzero(weights).tolist()))

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        z = np.array([const + weights[restorer.numbers(t)].sum() for t in texts], float)
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -50, 50))))

    return docs.withColumn(score_out, score(F.col(text_col)))
