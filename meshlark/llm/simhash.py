"""Operator 3: near-duplicate documents by SimHash, linked through shards of BK-trees.

Fingerprint: each word shingle's XXH64 votes on 64 bits; a bit is set when over half of the
shingles set it. Two fingerprints link when they differ in at most ``radius`` bits.

Sharding. The 64 bits are cut into ``radius + 2`` blocks. Two fingerprints within ``radius``
agree on at least two blocks, so every link shows in a shard named by some pair of blocks and
their bits; each distinct fingerprint enters one shard for each such pair. Each shard's
fingerprints become one BK-tree, sent to the task that searches it. A shard of more than
``SHARD`` fingerprints is split into blocks, and a tree is built for each pair of its blocks,
so no task depends on how full a shard is. Nothing is capped and no link is lost.

Wide fingerprints. Documents of Jaccard similarity 0.8 differ in about 10 of 64 bits, which no exact sharding
of 64 bits makes cheap. With ``similarity``, a fingerprint has ``WORDS`` words of 64 bits, for which each distinct
shingle votes once, as the similarity is of sets; texts of one set of shingles are one node. Nodes meet in shards
named by the least hashes of their shingles, ``BAND`` of them in each of ``BANDS`` bands (texts of similarity 0.8
share a shard with a probability of 0.9999), where BK-trees search with the radius that the similarity implies
and ``NOISE`` standard deviations of the differing bits more. What is linked so is only a candidate: within each
component of candidates, texts link if the true Jaccard similarity of their sets of shingles is as high as wished.
In a component of many texts or shingles, those that are similar to its first text are its core, and are linked by that
alone; the rest is compared with the core and with itself in blocks, and each pair of blocks is one group of a task. So a
group of copies, however large, costs no more than its number.

A task returns a spanning forest of the links that it found instead of the links; the forests
are joined by :func:`meshlark.llm.components.connected_components`.

Defined cases: null or empty text has no words and fingerprint 0, which links like any other;
equal texts have equal fingerprints and meet before any search; a repeated row is one more
row of its component; a null id never names a component (one of null ids only has null);
a very long text is hashed in parts and has one fingerprint like any other; which of equal texts a node stands for
plays no part; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.llm.bktree import BKForest, roots
from meshlark.llm.common import free_names, materialise
from meshlark.llm.components import connected_components

SEED = 42
SHARD = 2048
#: Words of a wide fingerprint, and how many standard deviations its radius has to spare for noise of the bits.
WORDS, NOISE = 8, 6
#: Bands of least hashes that name a wide fingerprint's shards, and hashes in a band.
BANDS, BAND = 20, 4
#: Shingles in a block of texts that are compared exactly, and texts of the core in one.
BLOCK, CORE = 1 << 20, 512
#: Shingles whose bits are counted at once, so that a very long text needs no more memory.
VOTES = 1 << 16
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle of a text, in order."""
    tokens = (text or b"").translate(LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(tokens), max(1, len(tokens) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    if n == 1:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    begins = np.r_[0, ends[:-1] + 1][:n].tolist()
    ends = ends[shingle - 1 :].tolist()
    return np.fromiter((digest(joined[b:e], SEED) for b, e in zip(begins, ends, strict=True)), np.uint64, n)


def fingerprint(text: bytes | None, shingle: int = 4, words: int = 1, distinct: bool = False) -> np.ndarray:
    """The SimHash of one text, ``words`` times 64 bits. The first word votes with the shingles' hashes, others with mixes of them.

    Every occurrence of a shingle votes, or with ``distinct`` every shingle once.
    """
    hashes = shingle_hashes(text, shingle)
    return votes_of(np.unique(hashes) if distinct else hashes, words)


def votes_of(hashes: np.ndarray, words: int) -> np.ndarray:
    """The bits that over half of the hashes set, in ``words`` words."""
    n, out = len(hashes), np.zeros(words, np.uint64)
    for k in range(words if n else 0):
        votes = np.zeros(64, np.int64)
        for at in range(0, n, VOTES):
            part = mixed(hashes[at : at + VOTES], k).astype("<u8")
            votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
        out[k] = int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")
    return out


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th of a family of hashes of hashes; the 0-th leaves them as they are."""
    if not k:
        return hashes
    x = (hashes + np.uint64(k * 0x9E3779B97F4A7C15 & 2**64 - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, words: int = 1) -> DataFrame:
    """``(id, text_hash long, fp)`` for every row; ``fp`` is a signed long, or binary of several words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle, words) for t in batch.column(1).to_pylist()]
            col = pa.array([f.view(np.int64)[0] for f in fps], pa.int64()) if words == 1 else pa.array([f.tobytes() for f in fps], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), col], ["id", "text_hash", "fp"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), _text_hash(text_col).alias("text_hash"))
    return narrow.mapInArrow(run, f"id {kind}, text_hash long, fp {'long' if words == 1 else 'binary'}")


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _masks(radius: int) -> list[int]:
    """For each pair of the ``radius + 2`` blocks, the bits of both, as a signed long."""
    cut = [round(64 * k / (radius + 2)) for k in range(radius + 3)]
    block = [(1 << b) - (1 << a) for a, b in zip(cut, cut[1:])]
    return [int(np.uint64(a | b).astype(np.int64)) for a, b in combinations(block, 2)]


def _forest_edges(radius: int):
    """A function for ``mapInArrow`` over rows sorted by shard, of four key columns, node and fingerprint.

    It holds one batch and one shard.
    """

    def edges(shard: np.ndarray, node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        forest = BKForest(fp, shard)
        root = roots(len(fp), forest.links(radius))
        moved = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], ["a", "b"])

    def words(col: pa.Array) -> np.ndarray:
        if pa.types.is_integer(col.type):
            return col.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1)
        return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(len(col), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:5]] + [words(batch.column(5))]
            cols = [np.concatenate(pair) for pair in zip(cols, new, strict=True)] if cols else new
            shard = np.r_[0, np.cumsum(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0))]
            done = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on in the next batch
            if done:
                yield edges(shard[:done], cols[4][:done], cols[5][:done])
                cols = [c[done:] for c in cols]
        if cols:
            shard = np.r_[0, np.cumsum(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0))]
            yield edges(shard, cols[4], cols[5])

    return run


def block_shards(radius: int) -> Column:
    """Shards that hold every pair of 64-bit fingerprints within ``radius``: by two of ``radius + 2`` blocks."""
    masks = [F.struct(F.lit(k).cast("long").alias("pair"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for k, m in enumerate(_masks(radius))]
    return F.array(*masks)


def least_hashes(hashes: np.ndarray) -> list[int]:
    """A name for each band of least hashes of a set of shingles; none for the empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * BAND, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), VOTES):
        for k in range(len(least)):
            least[k] = min(least[k], mixed(hashes[at : at + VOTES], 64 + k).min())
    return [int(np.uint64(xxhash.xxh64_intdigest(band.tobytes(), SEED)).astype(np.int64)) for band in least.reshape(BANDS, BAND)]


def wide_fingerprints(docs: DataFrame, *, id_col: str, text_col: str, shingle: int, words: int) -> DataFrame:
    """``(id, text_hash, fp binary, node long, bands array<long>)`` for every row; equal sets of shingles have equal ``node``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, shingle)) for t in batch.column(1).to_pylist()]
            fps = pa.array([votes_of(s, words).tobytes() for s in sets], pa.binary())
            nodes = pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64))
            bands = pa.array([least_hashes(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), fps, nodes, bands], ["id", "text_hash", "fp", "node", "bands"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), _text_hash(text_col).alias("text_hash"))
    return narrow.mapInArrow(run, f"id {kind}, text_hash long, fp binary, node long, bands array<long>")


def band_shards() -> Column:
    """Shards of wide fingerprints: by each band of least hashes."""
    return F.transform("bands", lambda b, k: F.struct(k.cast("long").alias("pair"), b.alias("bits")))


def similar_forest(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Arrays ``(i, j)``: a spanning forest of the pairs of sets whose Jaccard similarity is at least that.

    A search from each set goes only to sets that no search has reached yet.
    """
    size = np.array([len(s) for s in sets], np.int64)
    value = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, np.int64)
    own = np.split(value, np.cumsum(size)[:-1])
    owner, left = np.repeat(np.arange(len(sets)), size), np.ones(len(sets), bool)
    listed = 0  # how many sets the posting lists hold; they are made anew when half of these are reached
    a, b = [], []
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first], queue = False, [first]
        while queue and (many := int(left.sum())):
            if not listed or many * 2 < listed:
                keep = left[owner]
                order = np.argsort(value[keep], kind="stable")
                posting, listed = owner[keep][order], many
                edge = np.searchsorted(value[keep][order], np.arange(value.max(initial=0) + 2))
            i = queue.pop()
            begin, count = edge[own[i]], edge[own[i] + 1] - edge[own[i]]
            at = np.arange(count.sum()) + np.repeat(begin - np.r_[0, np.cumsum(count)[:-1]], count)
            shared = np.bincount(posting[at], minlength=len(sets))
            near = np.flatnonzero(left & (shared > 0) & (shared >= similarity * (size + size[i] - shared) - 1e-9))
            left[near] = False
            queue += near.tolist()
            a.append(np.full(len(near), i))
            b.append(near)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def similar_to(sets: list[np.ndarray], others: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Arrays ``(i, j)``: for each of ``sets`` that is similar to any of ``others``, the first such one."""
    size = np.array([len(s) for s in others], np.int64)
    value = np.concatenate([*others, np.zeros(0, np.uint64)])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], np.repeat(np.arange(len(others)), size)[order]
    a, b = [], []
    for i, s in enumerate(sets):
        begin = np.searchsorted(value, s, "left")
        count = np.searchsorted(value, s, "right") - begin
        at = np.arange(count.sum()) + np.repeat(begin - np.r_[0, np.cumsum(count)[:-1]], count)
        shared = np.bincount(owner[at], minlength=len(others))
        near = np.flatnonzero((shared > 0) & (shared >= similarity * (size + len(s) - shared) - 1e-9))
        if len(near):
            a.append(i)
            b.append(int(near[0]))
    return np.array(a, np.int64), np.array(b, np.int64)


def _similar_edges(similarity: float):
    """A function for ``mapInArrow`` over rows sorted by group, of three key columns, node, set of shingles, and whether it is known to be in the core.

    A group that has nodes of the core links each of its other nodes to one of them; any other group links all that it has.
    """

    def edges(node: np.ndarray, sets: np.ndarray, core: np.ndarray) -> pa.RecordBatch:
        node, at = np.unique(node, return_index=True)  # a repeated row is there again
        core, held = core[at].astype(bool), [np.frombuffer(sets[k], np.uint64) for k in at]
        if core.any():
            mine, others = np.flatnonzero(~core), np.flatnonzero(core)
            i, j = similar_to([held[k] for k in mine], [held[k] for k in others], similarity)
            i, j = mine[i], others[j]
        else:
            i, j = similar_forest(held, similarity)
        return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols = [np.concatenate(pair) for pair in zip(cols, new, strict=True)] if cols else new
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
            for begin, end in zip(np.r_[0, cut[:-1]], cut):  # the last group may go on in the next batch
                yield edges(*[c[begin:end] for c in cols[3:]])
            if len(cut):
                cols = [c[cut[-1] :] for c in cols]
        if cols:
            yield edges(*cols[3:])

    return run


def _near_first(similarity: float):
    """A function for ``mapInArrow``: whether each row's set of shingles is similar to that of its group's first node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core = []
            for own, first in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                x, y = np.frombuffer(own, np.uint64), np.frombuffer(first, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                core.append(own == first or bool(shared) and shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(core, pa.bool_())], ["root", "first", "node", "size", "shingles", "core"])

    return run


def verified_edges(docs: DataFrame, members: DataFrame, *, id_col: str, text_col: str, shingle: int, similarity: float, shard: int = SHARD) -> DataFrame:
    """``(a, b)``: a spanning forest of the pairs of one ``root`` whose texts have that Jaccard similarity.

    ``members(node, root, rep)`` has the ``(id, text_hash)`` of a text for each node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, shingle)) for t in batch.column(2).to_pylist()]
            size = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), size, pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "root", "size", "shingles"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), _text_hash(text_col).alias("text_hash"))
    wanted = members.select("node", "root", F.col("rep.id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"))
    found = texts.join(wanted, texts["id"].eqNullSafe(wanted["rep_id"]) & (texts["text_hash"] == wanted["rep_hash"])).select("node", "root", "text")
    sets = materialise(found.mapInArrow(run, "node long, root long, size long, shingles binary"), "shingles")
    facts = sets.groupBy("root").agg(F.count(F.lit(1)).alias("many"), F.sum("size").alias("size"), F.min(F.struct(F.xxhash64("node"), "node"))["node"].alias("first"))
    full = materialise(facts.where((F.col("many") > shard) | (F.col("size") > BLOCK)).select("root", "first"), "full")
    plain = sets.join(full, "root", "left_anti").select("root", *[F.lit(0).cast("long").alias(c) for c in "ij"], "node", "shingles", F.lit(False).alias("core"))

    # Of a large group, those that are similar to its first node are its core, which needs no comparison within itself.
    first = full.join(sets.select(F.col("node").alias("first"), F.col("shingles").alias("first_shingles")).dropDuplicates(["first"]), "first")
    against = sets.join(first, "root").select("root", "first", "node", "size", "shingles", "first_shingles")
    large = materialise(against.mapInArrow(_near_first(similarity), "root long, first long, node long, size long, shingles binary, core boolean"), "large")
    star = large.where("core and node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    blocks = [F.ceil(F.greatest(F.count_if(c) / n, F.sum(F.when(c, F.col("size"))) / BLOCK)).cast("long").alias(name) for name, c, n in (("rests", ~F.col("core"), shard), ("cores", F.col("core"), CORE))]
    counted = large.join(large.groupBy("root").agg(*blocks).where("rests > 0"), "root")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("core"), F.col("cores")).otherwise(F.col("rests")))
    upto = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    beside = F.transform(F.sequence(F.lit(0).cast("long"), F.col("cores") - 1), lambda c: F.struct(F.col("own").alias("i"), (F.col("rests") + c).alias("j")))
    before = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1), lambda o: F.struct(o.alias("i"), (F.col("rests") + F.col("own")).alias("j")))
    pairs = F.explode(F.when(F.col("core"), before).otherwise(F.concat(upto, beside)))
    placed = counted.withColumn("own", own).withColumn("p", pairs).select("root", "p.i", "p.j", "node", "shingles", "core")

    keys = ["root", "i", "j"]
    compared = plain.unionByName(placed).repartition(*keys).sortWithinPartitions(*keys)
    return compared.mapInArrow(_similar_edges(similarity), "a long, b long").unionByName(star)


def near_edges(distinct: DataFrame, shards: Column, radius: int, shard: int = SHARD) -> DataFrame:
    """``(a, b)``: a spanning forest of the links within shards between the ``(node, fp)`` of the input."""
    rows = distinct.select("node", "fp", F.explode(shards).alias("m")).select("node", "fp", "m.*")
    full = rows.groupBy("pair", "bits").count().where(F.col("count") > shard)
    blocks = full.select("pair", "bits", F.ceil(F.col("count") / shard).cast("long").alias("blocks"))
    own = F.pmod(F.xxhash64("node", "pair"), F.col("blocks"))
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = (
        rows.join(blocks, ["pair", "bits"], "left")
        .select("pair", "bits", "node", "fp", F.coalesce(own, F.lit(0)).cast("long").alias("own"), other.alias("other"))
        .select("pair", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "fp")
    )
    keys = ["pair", "bits", "i", "j"]
    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_forest_edges(radius), "a long, b long")


def wide_radius(similarity: float, words: int) -> int:
    """Within how many differing bits texts of that Jaccard similarity are, for fingerprints of so many words."""
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(64 * words * differ + NOISE * math.sqrt(64 * words * differ * (1 - differ)))


def simhash_groups(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    radius: int = 4,
    shard: int = SHARD,
    similarity: float | None = None,
    words: int = WORDS,
) -> DataFrame:
    """``(id, text_hash, fp, root, component)``, a row for each row of ``docs``.

    ``root`` names the group; ``component`` is the least id reachable in it. With ``similarity``, texts link
    if the Jaccard similarity of their sets of shingles is at least that; wide fingerprints of ``words`` words
    show the candidates.
    """
    columns = {"id_col": id_col, "text_col": text_col, "shingle": shingle}
    if similarity is None:
        fps = materialise(fingerprints(docs, **columns).withColumn("node", F.col("fp")), "simhash")
        distinct = materialise(fps.groupBy("node").agg(F.min("id").alias("least")).withColumn("fp", F.col("node")), "distinct")
        names = connected_components(near_edges(distinct.select("node", "fp"), block_shards(radius), radius, shard))
    else:
        fps = materialise(wide_fingerprints(docs, words=words, **columns), "simhash")
        rep = F.min(F.struct("id", "text_hash")).alias("rep")
        distinct = materialise(fps.groupBy("node").agg(F.min("id").alias("least"), rep, F.first("fp").alias("fp"), F.first("bands").alias("bands")), "distinct")
        candidates = connected_components(near_edges(distinct.select("node", "fp", "bands"), band_shards(), wide_radius(similarity, words), shard))
        members = candidates.join(distinct.select("node", "rep"), "node")
        names = connected_components(verified_edges(docs, members, similarity=similarity, shard=max(1, shard // 2), **columns))
    named = distinct.join(names, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    # Written first: a plain join of two tables is one whose hot groups adaptive execution can split.
    least = materialise(named.groupBy("root").agg(F.min("least").alias("component")), "least")
    groups = materialise(named.join(least, "root").select("node", "root", "component"), "groups")
    return fps.join(groups, "node").select("id", "text_hash", "fp", "root", "component")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each group, with all its columns.

    It is a row of the group's least id; where several rows of a group have that id (or all
    have none), the one whose text hashes lowest, and any one of equal texts.
    """
    groups = simhash_groups(docs, id_col=id_col, text_col=text_col, **options)
    key, least = free_names(docs, "text_hash", "least_id")
    first = groups.where(F.col("id").eqNullSafe(F.col("component"))).groupBy("root").agg(F.min("text_hash").alias("hash"), F.first("id").alias("id"))
    first = first.select(F.col("hash").alias(key), F.col("id").alias(least)).distinct()
    marked = docs.withColumn(key, _text_hash(text_col))
    kept = marked.join(first, marked[id_col].eqNullSafe(first[least]) & (marked[key] == first[key]), "left_semi")
    return kept.dropDuplicates([id_col, key]).drop(key)
