"""Operator 9: secrets in whole texts, by rules and by a character network over every candidate.

*Rules* (kinds ``assign``, ``access``, ``hex``) give the base findings. Each kind is matched
leftmost and without overlaps of its own; matches that are too short are dropped.

*Candidates* are all maximal runs of ``[A-Za-z0-9+/_=-]`` of at least ``LEAST`` characters with a
digit and a letter, and all values that are assigned to a name of any length (``name = value``, ``name: value``)
of at least ``ASSIGNED`` characters, as in the base rule; the network sees each with ``CONTEXT`` characters of both sides.
Names that a value is assigned to are masked, as the rules know secrets by some of them. A longer candidate is seen in
overlapping windows and takes its highest probability.

*Training.* The base findings are the labelled findings: pieces of candidates that overlap one are the
positives, all others, and plain stretches of text, the negatives. They are looked for in all
documents, and all different windows are used, whatever their number. Of every eight windows of
a label, six train the network, one calibrates its probabilities and one sets the threshold: the highest one
that finds ``recall`` of the positives among these, however low. A candidate at or over it that overlaps no
base finding is a further span, of kind ``network``. Base findings always stay.

Windows that train are dealt to shards of about ``FIT_ROWS`` of each label; the label with fewer windows has fewer different
shards, which repeat. In every of ``FIT_ROUNDS`` rounds each shard trains the network from the same parameters for
``FIT_EPOCHS`` epochs, and the parameters are averaged (an embedding: over the shards that have its symbol). One shard has
nothing to average and trains for all the epochs at once.
The calibration is of counts of logits, rounded to ``1 / GRAIN``; the threshold is an exact order statistic.

Offsets are code points, ends exclusive.

Defined cases: a null or empty text has no findings; repeated rows have the same findings and train once; of candidates
that overlap, the one that starts first, and of those the shorter, is taken; a text of any length is scanned whole, its
windows ``AT_ONCE`` at a time; where the
table has less than ``FIT_LEAST`` different positive windows, or negative ones (an empty table, too),
there is no network and the base findings are all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlark.llm.charcnn import CharCNN, encode
from meshlark.llm.common import free_names, kth_least, materialise, sweep

#: The base rules: fixed patterns.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "network")

VALUE = re.compile(rb"""(?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]*[A-Za-z_]["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
NAME = re.compile(rb"""([A-Za-z0-9_.-]+)["']?\x20*[:=]\x20*["']?$""")
LEAST, ASSIGNED, CONTEXT, INNER = 16, 8, 16, 64
WIDTH = INNER + 2 * CONTEXT
#: Windows of each label in a shard, about; of each label in all, at least; recall on the held-out ones.
FIT_ROWS, FIT_LEAST, RECALL = 20_000, 8, 0.99
#: Rounds of training, and the epochs of each.
FIT_ROUNDS, FIT_EPOCHS = 4, 3
#: Parts of one that logits are rounded to for the calibration, and where they end; parameters are averaged as whole numbers of 1 / FIXED.
GRAIN, FAR, FIXED = 1024, 64, 1 << 32
#: Windows that are in matrices at once.
AT_ONCE = 4096

_RUN = np.zeros(256, bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True


def base(text: bytes) -> list[tuple[int, int, str]]:
    """The base findings as (start, end, kind) in bytes, by start and then kind as listed."""
    found = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGNED]
    if b"AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(a, b, "hex") for s, e in runs(text, 32) for a, b in ((m.start() + s, m.end() + s) for m in HEX.finditer(text[s:e]))]
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[2])))


def runs(text: bytes, least: int) -> list[tuple[int, int]]:
    """Maximal runs of the candidates' characters, of at least ``least`` of them."""
    inside = np.r_[False, _RUN[np.frombuffer(text, np.uint8)], False]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= least
    return list(zip(begin[long].tolist(), end[long].tolist(), strict=True))


def candidates(text: bytes) -> list[tuple[int, int]]:
    """Every candidate as (start, end) in bytes, ascending."""
    found = {(a, b) for a, b in runs(text, LEAST) if re.search(rb"[0-9]", text[a:b]) and re.search(rb"[A-Za-z]", text[a:b])}
    if b"=" in text or b":" in text:
        found |= {m.span(1) for m in VALUE.finditer(text) if m.end(1) - m.start(1) >= ASSIGNED}
    return sorted(found)


def pieces(begin: int, end: int) -> list[tuple[int, int]]:
    """A candidate in pieces that overlap; one, if it is short."""
    return [(k, min(k + INNER, end)) for k in range(begin, max(begin + 1, end - CONTEXT), INNER - CONTEXT)]


def window(text: bytes, begin: int, end: int) -> bytes:
    """What the network sees of a piece: it and its surroundings, the name that a value is assigned to as a cross.

    The rules know secrets by some names; a network that saw these would only learn the rules.
    """
    before = text[max(0, begin - CONTEXT) : begin]
    if m := NAME.search(before):
        before = before[: m.start(1)] + b"x" + before[m.end(1) :]
    return before + text[begin : end + CONTEXT]


def windows(text: bytes, begin: int, end: int) -> list[bytes]:
    """The windows of a candidate's pieces."""
    return [window(text, a, b) for a, b in pieces(begin, end)]


def overlapping(spans: list[tuple[int, int]], found: list) -> list[bool]:
    """For each of ``spans`` whether it overlaps one of ``found``; both ascend by start. One merge of the two."""
    reach = np.maximum.accumulate(np.array([f[1] for f in found], np.int64)) if found else np.zeros(0, np.int64)
    # Of the findings that start before the span's end, the one that reaches furthest decides.
    before = np.searchsorted(np.array([f[0] for f in found], np.int64), np.array([b for _, b in spans], np.int64), "left")
    return [bool(k and reach[k - 1] > a) for (a, _), k in zip(spans, before.tolist(), strict=True)]


def labelled(text: bytes) -> list[tuple[bytes, int]]:
    """Training windows of one text: all windows of all candidates, and a stretch of plain text, with their labels."""
    found = base(text)
    seen = [p for a, b in candidates(text) for p in pieces(a, b)]
    out = [(window(text, a, b), int(y)) for (a, b), y in zip(seen, overlapping(seen, found), strict=True)]
    middle = len(text) // 2
    if not overlapping([(middle - CONTEXT, middle + INNER + CONTEXT)], found)[0]:
        out.append((window(text, middle, middle + INNER - CONTEXT), 0))
    return out


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [x for t in batch.column(0).to_pylist() for x in labelled(t or b"")]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.binary()), pa.array([y for _, y in rows], pa.int64())], ["window", "label"])


def dealt(found: DataFrame, shards: dict[int, int]) -> DataFrame:
    """``found(window, label)`` with ``bucket``, one of the label's ``shards``, and ``use``: 0 calibrates, 1 sets the threshold, 2 and more train."""
    bucket = F.pmod(F.xxhash64("window", F.lit(977)), F.when(F.col("label") == 1, shards[1]).otherwise(shards[0]).cast("long"))
    place = F.row_number().over(Window.partitionBy("label", "bucket").orderBy("window"))
    return found.withColumn("bucket", bucket).withColumn("use", (place - 1) % 8)


def packed(split: DataFrame, shards: dict[int, int]) -> DataFrame:
    """One row ``(windows)`` for each shard: its training windows with their labels, in order."""
    most = max(shards.values())
    step = F.when(F.col("label") == 1, shards[1]).otherwise(shards[0]).cast("long")
    rows = split.where("use > 1").select(F.explode(F.sequence("bucket", F.lit(most - 1).cast("long"), step)).alias("shard"), F.struct("window", "label").alias("w"))
    return rows.repartitionByRange(most, "shard").groupBy("shard").agg(F.sort_array(F.collect_list("w")).alias("windows")).select("windows")


def _shard_parameters(net: CharCNN, epochs: int, seed: int):
    """The parameters that each shard trains ``net`` to, as (place, whole number); embeddings only of symbols that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batch.column(0):
                x = encode(rows.values.field("window").to_pylist(), WIDTH)
                own = net.with_parameters(net.parameters())
                own.fit(x, rows.values.field("label").to_numpy(), epochs=epochs, seed=seed)
                has = np.ones(len(own.parameters()), bool)
                has[: own.emb.size] = np.repeat(np.isin(np.arange(len(own.emb)), x), own.emb.shape[1])
                at = np.flatnonzero(has)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.rint(own.parameters()[at] * FIXED).astype(np.int64))], ["at", "value"])

    return run


def train(packs: DataFrame, rounds: int = FIT_ROUNDS) -> CharCNN:
    """The network trained on :func:`packed` shards. Sums are of whole numbers, so that their order does not matter."""
    net = CharCNN.start()
    for k in range(rounds):
        each = packs.mapInArrow(_shard_parameters(net, FIT_EPOCHS * FIT_ROUNDS // rounds, 11 + k), "at long, value long")
        mean = each.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total"), F.count(F.lit(1)).alias("n")).collect()
        flat = net.parameters()
        for r in mean:
            flat[r["at"]] = int(r["total"]) / r["n"] / FIXED
        net = net.with_parameters(flat)
    return net


def _logits(net: CharCNN):
    """The logits of held-out windows, as whole numbers in the order of the logits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = batch.column(0).to_pylist()
            z = [net.logits(encode(seen[k : k + AT_ONCE], WIDTH)) for k in range(0, len(seen), AT_ONCE)]
            bits = ordered(np.concatenate([*z, np.zeros(0)]))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(bits), pa.array(in_grains(unordered(bits)))], ["label", "use", "bits", "grain"])

    return run


def ordered(z: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the numbers ``z``."""
    bits = (z + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


def unordered(bits: np.ndarray) -> np.ndarray:
    """The numbers that :func:`ordered` has made whole ones of."""
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits).view(np.float64)


def in_grains(z: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(z, -FAR, FAR) * GRAIN).astype(np.int64)


def fit(docs: DataFrame, *, text_col: str = "text", fit_rows: int = FIT_ROWS, recall: float = RECALL) -> tuple[CharCNN, float] | None:
    """The network and its threshold, of all different windows; None where there are less than ``FIT_LEAST`` of a label."""
    spark = docs.sparkSession
    text = docs.select(F.col(text_col).cast("binary").alias("text"))
    # Different windows only, so that copies of one finding cannot thin out the others.
    found = materialise(text.mapInArrow(_labelled, "window binary, label long").distinct(), "windows")
    many = {r["label"]: r["count"] for r in found.groupBy("label").count().collect()}
    if min(many.get(label, 0) for label in (0, 1)) < FIT_LEAST:
        sweep(spark, found)
        return None
    shards = {label: -(-n // max(fit_rows, FIT_LEAST)) for label, n in many.items()}
    split = materialise(dealt(found, shards), "dealt")
    sweep(spark, found)
    packs = materialise(packed(split, shards), "shards")
    net = train(packs, FIT_ROUNDS if max(shards.values()) > 1 else 1)
    held = materialise(split.where("use < 2").select("window", "label", "use").mapInArrow(_logits(net), "label long, use int, bits long, grain long"), "logits")
    sweep(spark, split, packs)
    tune = held.where("use = 0").groupBy("label", "grain").count().orderBy("label", "grain").toArrow()
    net.calibrate_counts(*(tune.column(c).to_numpy().astype(float) / (GRAIN if c == "grain" else 1) for c in ("grain", "label", "count")))
    hits = held.where("use = 1 and label = 1")
    n = hits.count()
    k = int(np.floor((1 - recall) * n))
    # The k-th least probability; these fall as logits rise if the calibration has turned the network round.
    bits = kth_least(hits, "bits", k if net.scale >= 0 else n - 1 - k)
    sweep(spark, held)
    return net, float(net.calibrated(unordered(np.array([bits])))[0])


def probabilities(net: CharCNN, seen: list[bytes]) -> Iterator[float]:
    """The network's probability for each window, a bounded number of them at a time."""
    for k in range(0, len(seen), AT_ONCE):
        yield from net.probability(encode(seen[k : k + AT_ONCE], WIDTH)).tolist()


def scan(text: bytes, model: tuple[CharCNN, float] | None) -> list[tuple[int, int, str]]:
    """All findings of one text as (start, end, kind) in code points."""
    found = base(text)
    if model is not None:
        spans = candidates(text)
        spans = [s for s, known in zip(spans, overlapping(spans, found), strict=True) if not known]
        at = [(k, w) for k, (a, b) in enumerate(spans) for w in windows(text, a, b)]
        net, least = model
        high = [0.0] * len(spans)
        for (k, _), p in zip(at, probabilities(net, [w for _, w in at]), strict=True):
            high[k] = max(high[k], p)
        last = 0
        for (a, b), p in zip(spans, high, strict=True):
            if p >= least and a >= last:
                found.append((a, b, "network"))
                last = b
    if found and not text.isascii():
        # Code points before a byte: bytes that do not continue one.
        points = np.r_[0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)]
        found = [(int(points[a]), int(points[b]), kind) for a, b, kind in found]
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[2]), f[1]))


def find_secrets(docs: DataFrame, *, text_col: str = "text", fit_rows: int = FIT_ROWS, recall: float = RECALL, out: str = "secrets") -> DataFrame:
    """``docs`` with one more column ``out`` (or :func:`free_names` for it), an array of ``(start, end, kind)`` in order."""
    (out,) = free_names(docs, out)
    model = fit(docs, text_col=text_col, fit_rows=fit_rows, recall=recall)

    @F.pandas_udf("array<struct<start:long,end:long,kind:string>>")
    def spans(texts):
        import pandas as pd

        return pd.Series([[{"start": a, "end": b, "kind": k} for a, b, k in scan(bytes(t) if t is not None else b"", model)] for t in texts])

    return docs.withColumn(out, spans(F.col(text_col).cast("binary")))


def redact(docs: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars", mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every finding replaced by ``mark`` (overlapping ones by one), other text as it was.

    ``chars_col``, where the table has it, is set to the new number of code points of the texts that change.
    """
    columns = docs.columns
    spans, new = free_names(docs, "secrets", "redacted")
    found = find_secrets(docs, text_col=text_col, out=spans, **options)
    # What stays lies between the spans: from the furthest end so far to the next start.
    edges = F.aggregate(
        spans,
        F.struct(F.array().cast("array<struct<start:long,end:long>>").alias("gaps"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(F.array_append(acc["gaps"], F.struct(acc["at"].alias("start"), s["start"].alias("end"))).alias("gaps"), s["end"].alias("at")),
        ).otherwise(F.struct(acc["gaps"].alias("gaps"), F.greatest(acc["at"], s["end"]).alias("at"))),
        lambda acc: F.array_append(acc["gaps"], F.struct(acc["at"].alias("start"), F.lit(1 << 30).cast("long").alias("end"))),
    )
    text = F.col(text_col)
    step = F.array_join(F.transform(edges, lambda g: F.substr(text, (g["start"] + 1).cast("int"), (g["end"] - g["start"]).cast("int"))), mark)
    out = found.withColumn(new, F.when(F.size(spans) > 0, step))
    if chars_col in columns:
        out = out.withColumn(chars_col, F.when(F.col(new).isNotNull(), F.length(new).cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars_col)))
    return out.withColumn(text_col, F.coalesce(new, text_col)).drop(spans, new)
