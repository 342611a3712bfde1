from collections import Counter
from itertools import combinations

from hypothesis import given
from hypothesis import strategies as st

from meshlark.llm import packing
from tests.llm.cases import DOCS, awkward, frame


def padding(hist, upper):
    return sum(n * (min(b for b in upper if b >= x) - x) for x, n in hist)


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 6))
def test_boundaries_are_optimal(hist, buckets):
    rows = sorted(hist.items())
    got = packing.boundaries([x for x, _ in rows], [n for _, n in rows], buckets)
    xs = [x for x, _ in rows]
    best = min(padding(rows, (*c, xs[-1])) for k in range(min(buckets, len(xs))) for c in combinations(xs[:-1], k))
    assert len(got) <= buckets and got[-1] == xs[-1]
    assert padding(rows, got) == best


def test_no_lengths():
    assert packing.boundaries([], []) == []


def test_every_token_is_packed_once(spark):
    rows = awkward() + [(100 + i, "w " * (i % 37), None, None, None) for i in range(300)]
    got = packing.pack(frame(spark, rows), context=50, buckets=5, budget=120).collect()
    want = Counter()
    for r in rows:
        n = len((r[1] or "").split())
        for p in range(-(-n // 50)):
            want[r[0], p, min(50, n - 50 * p)] += 1
    assert Counter((r.id, r.piece, r.n_tokens) for r in got) == want
    assert all(r.n_tokens <= r.padded for r in got)
    places = Counter((r.bucket, r.batch) for r in got)
    assert len({(r.bucket, r.batch, r.slot) for r in got}) == len(got)
    padded = {r.bucket: r.padded for r in got}
    for (bucket, batch), n in places.items():
        most = max(1, 120 // padded[bucket])
        last = max(b for k, b in places if k == bucket)
        assert n <= most and (n == most or batch == last)
    assert {b for _, b in places} >= {0}
    assert all(r.first_token == 50 * r.piece for r in got)


def test_texts_of_pieces_are_the_words(spark):
    rows = awkward() + [(100 + i, " w0\n" + " ".join(f"w{k}" for k in range(i)) + " \t ", None, None, None) for i in range(120)]
    got = packing.pack(frame(spark, rows), context=50, buckets=5, budget=120, with_text=True).collect()
    plain = packing.pack(frame(spark, rows), context=50, buckets=5, budget=120).collect()
    assert Counter((r.id, r.piece, r.n_tokens, r.bucket) for r in got) == Counter((r.id, r.piece, r.n_tokens, r.bucket) for r in plain)
    want = Counter((i, p, tuple((t or "").split()[50 * p : 50 * p + 50])) for i, t, *_ in rows for p in range(-(-len((t or "").split()) // 50)))
    assert Counter((r.id, r.piece, tuple(r.text.split())) for r in got) == want


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0
    assert packing.pack(spark.createDataFrame([(1, None, None, None, None)], DOCS)).count() == 0
