"""Operator 7: a quality classifier without gold labels.

1. *Labellers.* Overlapping heuristics look at each whole text and vote good, bad or nothing.
2. *Label model.* Votes are counted by pattern over the whole table (at most ``3 ** labellers``
   patterns); expectation-maximisation fits the class prior and each labeller's class-conditional
   vote probabilities to the counts, and gives every pattern a posterior. Voting patterns of
   all documents count, whatever the table's size.
3. *Scorer.* A linear scorer over hashed features (shapes of words, and binned statistics of the
   text) learns the posteriors by logistic regression on all different texts, then scores every
   document. The texts are dealt to shards of about ``FIT_ROWS`` by their hashes; each shard fits its
   weights, and a feature's weight is the mean over the shards' texts that have it.

A document is kept when its score is at least ``threshold``.

Defined cases: a text without words (null, empty, white space) scores 0 and is rejected;
equal texts score the same, and repeated rows count as often as they are there in the label model and once
for the scorer; vote patterns that tie take the same posterior; a very long text is read whole and has
``HASHED`` features at most, 6 bytes each; ids and other columns play no part; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm.common import free_names, materialise, sweep

#: Different texts of a shard that the scorer is fitted on (about); hashed features.
FIT_ROWS, HASHED = 10_000, 1 << 12
#: Weights are averaged as whole numbers of 1 / FIXED, so that the order of sums does not matter.
FIXED = 1 << 24
GOOD, BAD, NONE = 1, 2, 0

# Character classes: 0 white space, 1 lower-case letter, 2 upper-case, 3 digit, others themselves.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[[32, *range(9, 14)]] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[128:] = 1  # parts of letters beyond ASCII, by far most of them lower-case
_TO_CLASS = _CLASS.tobytes()


def measures(text: bytes) -> dict[str, float] | None:
    """Statistics of one text; None if it has no words."""
    words = text.split()
    n = len(words)
    if not n:
        return None
    c = np.frombuffer(text.translate(_TO_CLASS), np.uint8)
    counts = np.bincount(c, minlength=256)
    lower, upper, digits = int(counts[1]), int(counts[2]), int(counts[3])
    marks = int(counts[4:].sum())
    plain = int(counts[[ord(c) for c in ".,;:!?'\"()-"]].sum())
    lines = [x for x in text.splitlines() if x.strip()]
    return {
        "words": n,
        "odd_marks": (marks - plain) / (lower + upper + digits + marks),
        "mark_runs": int(((c[2:] > 3) & (c[2:] == c[1:-1]) & (c[2:] == c[:-2])).sum()) / n,
        "shouting": int(counts[ord("!")]) / n,
        "upper": upper / max(1, lower + upper),
        "digits": digits / (lower + upper + digits + marks),
        "letterless": sum(not w.translate(_TO_CLASS).strip(b"\x00").strip(_MARKS) for w in words) / n if marks else 0.0,
        "stutter": sum(a == b for a, b in zip(words, words[1:])) / n,
        "distinct": len(set(words)) / n,
        "line_copies": 1 - len(set(lines)) / max(1, len(lines)),
        "mean_word": len(text) / n - 1,
    }


_MARKS = bytes(b for b in range(4, 128) if _CLASS[b] == b)


def _less(key: str, good: float, bad: float, least: int = 1):
    """Votes good below ``good``, bad above ``bad``, else nothing; nothing on fewer words than ``least``."""
    return lambda m: NONE if m["words"] < least else BAD if m[key] > bad else GOOD if m[key] < good else NONE


def _only_bad(test):
    return lambda m: BAD if test(m) else NONE


#: The labellers, by name. Each sees the measures of a text that has words.
LABELLERS = {
    "marks": _less("odd_marks", 0.02, 0.05),
    "mark runs": _only_bad(lambda m: m["words"] >= 4 and m["mark_runs"] > 0.2),
    "shouting": _only_bad(lambda m: m["words"] >= 4 and m["shouting"] > 0.4),
    "capitals": _less("upper", 0.15, 0.6, 4),
    "bare marks": _only_bad(lambda m: m["letterless"] > 0.25),
    "stutter": _only_bad(lambda m: m["words"] >= 8 and m["stutter"] > 0.3),
    "vocabulary": _only_bad(lambda m: m["words"] >= 20 and m["distinct"] < 0.2 * min(1.0, (200 / m["words"]) ** 0.5)),
    "line copies": _only_bad(lambda m: m["line_copies"] > 0.5),
    "digits": _less("digits", 0.1, 0.4, 4),
    "word length": lambda m: NONE if m["words"] < 8 else GOOD if 2.5 < m["mean_word"] < 12 else BAD,
}


def votes(m: dict[str, float]) -> int:
    """The votes of all labellers as the digits of a number to base 3."""
    code = 0
    for vote in LABELLERS.values():
        code = 3 * code + vote(m)
    return code


def unpacked(codes: np.ndarray) -> np.ndarray:
    """Votes as a matrix: a row for each code, a column for each labeller."""
    k = len(LABELLERS)
    return codes[:, None] // 3 ** np.arange(k - 1, -1, -1) % 3


def fit_label_model(codes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> dict[int, float]:
    """Posterior probability of *good* for each vote pattern, by expectation-maximisation.

    The first posterior takes one bad vote for bad: labellers are asked to vote bad only on
    plain evidence. Probabilities are smoothed, so a labeller that never votes one way still
    leaves every pattern possible. Without any pattern there is nothing to fit.
    """
    if not len(codes):
        return {}
    seen = unpacked(codes)
    good = np.where((seen == BAD).any(1), 0.1, np.where((seen == GOOD).any(1), 0.95, 0.5))
    one_hot = seen[:, :, None] == np.arange(3)
    for _ in range(rounds):
        mass = np.stack([counts * (1 - good), counts * good])
        prior = (mass.sum(1) + 1) / (mass.sum() + 2)
        table = (np.einsum("cn,nkv->ckv", mass, one_hot) + 0.5) / (mass.sum(1)[:, None, None] + 1.5)
        # A vote never speaks against what it says: where counts would have it so, it says nothing.
        pooled = (table * mass.sum(1)[:, None, None]).sum(0) / mass.sum()
        for vote, wrong in ((BAD, table[0, :, BAD] < table[1, :, BAD]), (GOOD, table[1, :, GOOD] < table[0, :, GOOD])):
            table[:, wrong, vote] = pooled[wrong, vote]
        table /= table.sum(2, keepdims=True)
        log = np.log(prior)[:, None] + np.einsum("nkv,ckv->cn", one_hot, np.log(table))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        done = np.abs(new - good).max(initial=0) < 1e-9
        good = new
        if done:
            break
    return dict(zip(codes.tolist(), good.tolist(), strict=True))


_shapes: dict[bytes, int] = {}


def features(text: bytes, m: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of one text: shares of word shapes, and bins of the measures."""
    c = np.frombuffer(text.translate(_TO_CLASS), np.uint8)
    squeezed = c[np.r_[True, c[1:] != c[:-1]]].tobytes()
    found: dict[int, float] = {}
    for shape, many in Counter(squeezed.split(b"\0")).items():
        if shape:
            at = zlib.crc32(shape) % HASHED
            found[at] = found.get(at, 0.0) + many / m["words"]
    for key in ("odd_marks", "mark_runs", "shouting", "upper", "digits", "letterless", "stutter", "line_copies"):
        found[zlib.crc32(f"{key}:{min(9, int(10 * m[key]))}".encode()) % HASHED] = 1.0
    scarce = m["distinct"] / min(1.0, (200 / m["words"]) ** 0.5)
    found[zlib.crc32(f"distinct:{min(9, int(10 * scarce))}:{m['words'] >= 20}".encode()) % HASHED] = 1.0
    found[zlib.crc32(f"mean_word:{min(16, int(m['mean_word']))}:{m['words'] >= 8}".encode()) % HASHED] = 1.0
    return np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), float, len(found))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"row": [], "votes": [], "at": [], "value": []}
        for k, t in enumerate(batch.column(2).to_pylist()):
            if (m := measures(t or b"")) is not None:
                at, value = features(t, m)
                for c, v in (("row", k), ("votes", votes(m)), ("at", at.astype("<u2").tobytes()), ("value", value.astype("<f4").tobytes())):
                    out[c].append(v)
        row = pa.array(out["row"], pa.int64())
        cols = [batch.column(0).take(row), batch.column(1).take(row), pa.array(out["votes"], pa.int64()), pa.array(out["at"], pa.binary()), pa.array(out["value"], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["th", "tg", "votes", "at", "value"])


def _shard_weights(posterior: dict[int, float]):
    """The weights that a shard fits, times the number of its texts that have the feature: (feature, whole number, texts)."""

    def run(rows: pa.Table) -> pa.Table:
        got = rows.to_pydict()
        order = sorted(range(rows.num_rows), key=lambda k: (got["votes"][k], zlib.crc32(got["at"][k]), got["at"][k], got["value"][k]))
        at, value = ([np.frombuffer(got[name][k], kind) for k in order] for name, kind in (("at", "<u2"), ("value", "<f4")))
        w = fit_scorer(np.array([got["votes"][k] for k in order], np.int64), at, value, posterior)
        texts = np.append(np.bincount(np.concatenate(at).astype(np.int64), minlength=HASHED), len(order))
        has = np.flatnonzero(texts)
        return pa.table({"feature": has, "value": np.rint(w[has] * FIXED).astype(np.int64) * texts[has], "texts": texts[has]})

    return run


def fit_scorer(vote: np.ndarray, at: list[np.ndarray], value: list[np.ndarray], posterior: dict[int, float], rounds: int = 300) -> np.ndarray:
    """Weights of the hashed features and, last, the constant: logistic regression on posteriors."""
    n = len(vote)
    row = np.repeat(np.arange(n), [len(a) for a in at])
    col = np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64)
    share = np.concatenate([*value, np.zeros(0)]).astype(float)
    target = np.array([posterior[v] for v in vote.tolist()])
    w, m, v = np.zeros(HASHED + 1), np.zeros(HASHED + 1), np.zeros(HASHED + 1)
    for t in range(1, rounds + 1 if n else 1):
        score = np.bincount(row, w[col] * share, n) + w[-1]
        off = 1 / (1 + np.exp(-score)) - target
        grad = np.r_[np.bincount(col, off[row] * share, HASHED), off.sum()] / n + 1e-5 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit(docs: DataFrame, *, text_col: str = "text", fit_rows: int = FIT_ROWS) -> tuple[dict[int, float], np.ndarray]:
    """The label model's posteriors and the scorer's weights."""
    text = docs.select(F.xxhash64(text_col).alias("th"), F.xxhash64(F.lit(1), text_col).alias("tg"), F.col(text_col).cast("binary").alias("text"))
    rows = materialise(text.mapInArrow(_sparse, "th long, tg long, votes long, at binary, value binary"), "features")
    patterns = sorted(rows.groupBy("votes").count().collect(), key=lambda r: r["votes"])
    counts = np.array([r["count"] for r in patterns], float)
    posterior = fit_label_model(np.array([r["votes"] for r in patterns], np.int64).reshape(-1), counts)
    # Copies of a text go before texts meet their shards.
    texts = materialise(rows.groupBy("th", "tg").agg(*(F.first(c).alias(c) for c in ("votes", "at", "value"))), "texts")
    sweep(docs.sparkSession, rows)
    shards = max(1, -(-texts.count() // fit_rows))
    each = texts.withColumn("shard", F.pmod("th", F.lit(shards))).groupBy("shard").applyInArrow(_shard_weights(posterior), "feature long, value long, texts long")
    mean = each.groupBy("feature").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total"), F.sum("texts").alias("texts")).collect()
    sweep(docs.sparkSession, texts)
    weights = np.zeros(HASHED + 1)
    for r in mean:
        weights[r["feature"]] = int(r["total"]) / r["texts"] / FIXED
    return posterior, weights


def score_quality(
    docs: DataFrame, *, text_col: str = "text", fit_rows: int = FIT_ROWS, posterior_out: str = "quality_posterior", score_out: str = "quality_score"
) -> DataFrame:
    """``docs`` with two more columns, 0 to 1: ``posterior_out`` (label model) and ``score_out`` (or :func:`free_names` for them)."""
    both, posterior_out, score_out = free_names(docs, "quality", posterior_out, score_out)
    posterior, weights = fit(docs, text_col=text_col, fit_rows=fit_rows)

    @F.pandas_udf("posterior double, score double")
    def score(texts):
        import pandas as pd

        out = []
        for t in texts:
            m = measures(bytes(t)) if t is not None else None
            if m is None:
                out.append((0.0, 0.0))
                continue
            at, value = features(bytes(t), m)
            out.append((posterior.get(votes(m), 0.5), 1 / (1 + np.exp(-float(weights[at] @ value + weights[-1])))))
        return pd.DataFrame(out, columns=["posterior", "score"])

    scored = docs.withColumn(both, score(F.col(text_col).cast("binary")))
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(both)["posterior"].alias(posterior_out), F.col(both)["score"].alias(score_out))


def keep_good(docs: DataFrame, *, text_col: str = "text", threshold: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, unchanged."""
    posterior, score = free_names(docs, "quality_posterior", "quality_score")
    scored = score_quality(docs, text_col=text_col, fit_rows=fit_rows, posterior_out=posterior, score_out=score)
    return scored.where(F.col(score) >= threshold).drop(posterior, score)
