import hashlib
import re

import xxhash

from meshlark.llm import minhash
from tests.llm.cases import DOCS, awkward, frame

MASK = 2**64 - 1


def xx(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else (v & MASK).to_bytes(8, "little"), h)
    return h - 2**64 if h >= 2**63 else h


def plain(text, k=minhash.SHINGLE, bins=minhash.BINS):
    words = [xx(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    if not words:
        return ""
    if len(words) < k:
        acc = 0
        for w in words:
            acc = xx(acc, w)
        hashes = [acc]
    else:
        hashes = [xx(*words[i : i + k]) for i in range(len(words) - k + 1)]
    best = {}
    for h in hashes:
        v = (h & MASK) >> 1
        b = v >> 56
        best[b] = min(best.get(b, v), v)
    out = []
    for b in range(bins):
        if b not in best:
            end = ((b + 1) << 56) - 1
            near = min((xx(end, x) & -bins) | x for x in best)
            out.append(best[near & (bins - 1)])
        else:
            out.append(best[b])
    return "".join(f"{xx(v) & 255:02x}" for v in out)


def alike(a, b):
    if not a or not b:
        return float(a == b)
    pairs = list(zip(re.findall("..", a), re.findall("..", b), strict=True))
    m = sum(x == y for x, y in pairs) / len(pairs)
    return max(0.0, (m - 1 / 256) / (1 - 1 / 256))


def expected(rows):
    """All columns by brute force, from (id, text) pairs."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (2**63 - 1 if r[0] is None else r[0], xx(r[1].encode())))
    prints = {t: plain(t) for _, t in rows}
    want = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        p = plain(e)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), prints[t], p, round(alike(prints[t], p), 9), round(alike(prints[t], prints[nxt]), 9)))
    return sorted(want, key=str)


def computed(docs, **options):
    got = minhash.edited_fingerprints(docs, **options).collect()
    return sorted(((r.id, r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest(), r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=str)


def test_all_columns_match_brute_force(spark):
    want = expected([(i, t) for i, t, *_ in awkward()])
    for size in (minhash.RANGE, 2):
        assert computed(frame(spark), size=size) == want


def test_hot_ids_and_hot_rows(spark):
    rows = [(None if i % 3 else 7, f"text {i} of a hot id", None, None, None) for i in range(120)]
    rows += [(50, "one row many times over", None, None, None)] * 80 + [(i, f"other {i}", None, None, None) for i in range(60)]
    docs = frame(spark, rows)
    assert computed(docs, size=8) == expected([r[:2] for r in rows])
    keys = docs.selectExpr("coalesce(doc_id, 9223372036854775807) as key", "xxhash64(coalesce(text, '')) as tie")
    cuts, heavy = minhash.range_cuts(keys, 8)
    assert len(heavy) == 1 and heavy[0][0] == 50
    placed = keys.select(minhash._range_of(keys.key, keys.tie, cuts).alias("r"), "key").where("key <> 50").groupBy("r").count()
    assert max(r["count"] for r in placed.collect()) < 40  # a third of the rows has one id


def test_likeness_estimates_jaccard(spark):
    base = [f"w{i}" for i in range(600)]
    rows = [(k, " ".join(base[: 600 - 40 * k] + [f"x{k}_{i}" for i in range(40 * k)]), None, None, None) for k in range(10)]
    prints = [r.fp for r in minhash.with_fingerprint(spark.createDataFrame(rows, DOCS), "text", "fp").orderBy("doc_id").collect()]
    sets = [{tuple(t[1].split()[i : i + 5]) for i in range(596)} for t in rows]
    off = [abs(alike(prints[0], p) - len(sets[0] & s) / len(sets[0] | s)) for p, s in zip(prints, sets)]
    assert max(off) < 0.16 and sum(off) / len(off) < 0.06


def test_empty(spark):
    assert minhash.edited_fingerprints(spark.createDataFrame([], DOCS)).count() == 0
