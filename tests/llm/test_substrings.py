import hashlib
import pathlib
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from meshlark.llm import common
from meshlark.llm import substrings as s
from tests.llm.cases import DOCS, awkward, frame


def plain(rows, window):
    words = [(t or "").encode().split() for _, t, *_ in rows]
    count = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for (i, *_), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_with_passages(seed):
    rng = np.random.default_rng(seed)
    word = lambda n, m: [f"w{x}" for x in rng.integers(0, m, n)]
    passages = [word(int(rng.integers(20, 90)), 500) for _ in range(6)]
    rows = awkward()
    for k in range(60):
        text = word(int(rng.integers(0, 80)), [3, 40, 5000][k % 3])
        for _ in range(int(rng.integers(0, 3))):
            p = passages[int(rng.integers(0, 6))]
            a = int(rng.integers(0, 10))
            text += p[a:] + word(int(rng.integers(0, 20)), 5000)
        rows.append((100 + k, " ".join(text), None, None, None))
    return rows


def test_matches_brute_force(spark):
    for seed in (0, 1):
        rows = rows_with_passages(seed)
        got = s.remove_repeats(frame(spark, rows), window=35).collect()
        assert sorted(((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == plain(rows, 35)


def words_of(numbers):
    return [b"%d" % x for x in numbers]


def laid(*texts, window=35, rounds=s.ROUNDS):
    word, text, begin = s.laid_out([words_of(t) for t in texts], window)
    return s.recompress(word, text, rounds), begin


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 6), st.integers(0, 30), st.integers(0, 30), st.integers(0, 30), st.sampled_from([2, 7, 35]))
def test_equal_windows_have_one_high_symbol_at_one_place(seed, letters, before, between, after, window):
    """The claim that no window is missed, also for runs and periods, and that names are of content."""
    rng = np.random.default_rng(seed)
    raw = rng.integers(0, letters, before + between + after)
    same = rng.integers(0, letters, window)
    if seed % 3 == 0:
        same = np.resize(same[: 1 + seed % 7], window)
    text = np.r_[raw[:before], same, raw[before : before + between], same, raw[before + between :]]
    levels, begin = laid(text, window=window)
    name, first = s.high_symbols(levels, begin, window)
    names = s.window_names(levels, begin, window)
    content = [tuple(text[b : b + window].tolist()) for b in begin]
    seen = {}
    for c, n, at, b, w in zip(content, name.tolist(), first.tolist(), begin.tolist(), names.T.tolist(), strict=True):
        assert b <= at < b + window
        assert seen.setdefault(c, (n, at - b, w)) == (n, at - b, w)
    assert len({tuple(w) for _, _, w in seen.values()}) == len(seen)  # different windows, different names


def test_rounds_replace_runs_and_pairs():
    """Symbols of every round stand for the words that they should, and the rounds leave few."""
    rng = np.random.default_rng(2)
    text = np.r_[rng.integers(0, 50, 3000), np.full(1000, 7), np.resize([1, 2], 500)]
    levels, _ = laid(text)
    for level, after in zip(levels, levels[1:]):
        assert (level.start[np.r_[True, level.to[1:] != level.to[:-1]]] == after.start).all()
        if level.kind == "R":
            assert (after.name[0, 1:] != after.name[0, :-1])[np.diff(level.edge)[1:] > 1].all()
        else:
            assert np.bincount(level.to).max() <= 2
    for level in levels:  # equal names stand for equal words
        ends, named = np.r_[level.start[1:], len(text)], {}
        for n, a, b in zip(level.name[0].tolist(), level.start, ends):
            assert named.setdefault(n, tuple(text[a:b])) == tuple(text[a:b])
    assert len(levels[-1].start) < 0.2 * len(text)


def test_high_symbols_make_few_candidates():
    """Without the rounds, words alone would make nearly every window a candidate."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 40, 400) for _ in range(60)]

    def candidates(rounds):
        levels, begin = laid(*texts, rounds=rounds)
        name, first = s.high_symbols(levels, begin)
        kept = np.unique(np.stack([name, first.astype(np.uint64)]), axis=1)[0]
        values, many = np.unique(kept, return_counts=True)
        return np.isin(name, values[many > 1]).mean()

    assert candidates("") > 0.99 and candidates("RPP") > 0.5 and candidates(s.ROUNDS) < 0.1


def test_several_texts_at_once_are_as_one_by_one():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 3, n) for n in (40, 35, 0, 90, 10, 36)]
    levels, begin = laid(*texts)
    together = s.window_names(levels, begin)
    alone = [s.window_names(*laid(t)) for t in texts if len(t) >= 35]
    assert (together == np.concatenate(alone, axis=1)).all()


def test_any_rounds_give_the_same_result(spark):
    rows = rows_with_passages(7)
    for rounds in ("", "R", "PPPP", "RPRPRPRPRPRPRPRPRPRPRP"):
        got = s.remove_repeats(frame(spark, rows), window=35, rounds=rounds).collect()
        assert sorted(((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == plain(rows, 35)


def test_hot_text_and_equal_ids(spark):
    rows = [(k if k % 2 else 4, " ".join(f"h{x}" for x in range(50)), None, None, None) for k in range(60)]
    rows += [(100, " ".join(f"h{x}" for x in range(10, 50)) + " tail", None, None, None), (None, " ".join(["z"] * 80), None, None, None)]
    got = s.remove_repeats(frame(spark, rows)).collect()
    assert sorted(((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == plain(rows, 35)


def test_names_that_share_a_half(spark):
    rows = [(1, 0, 5, 1), (1, 1, 5, 2), (2, 0, 5, 1), (2, 3, 7, 1), (3, 0, 7, 1), (4, 0, 9, 1), (5, 2, 11, 1), (5, 3, 11, 2)]
    got = s.repeated_starts(spark.createDataFrame(rows, "row long, start int, w1 long, w2 long"))
    assert sorted(map(tuple, got.collect())) == [(1, 0), (2, 0), (2, 3), (3, 0)]


def test_empty(spark):
    assert s.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_batches_hold_a_bounded_number_of_words():
    """What a Python worker holds while it names words and symbols, however many texts a batch has."""
    texts = [" ".join(f"w{(k * 7919 + j) % 9973}" for j in range(400)).encode() for k in range(2500)]
    keys = [[1]] * len(texts)
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["th", "tg", "text", "shared"])
    tracemalloc.start()
    rows = sum(out.num_rows for out in s._candidates(35, s.ROUNDS)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts) and peak < 120e6


def test_tables_on_the_way_are_deleted_but_what_the_result_reads(spark):
    where = pathlib.Path(common._tables(spark))
    before = set(where.iterdir()) if where.exists() else set()
    out = s.remove_repeats(frame(spark, rows_with_passages(3)))
    left = {p.name.rpartition("-")[0] for p in set(where.iterdir()) - before}
    assert left <= {"keyed", "fates", "repeats", "clashes"} and {"keyed", "fates"} <= left
    assert out.count() == len(rows_with_passages(3))
