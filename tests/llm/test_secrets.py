import random
import re

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from meshlark.llm import secrets
from meshlark.llm.charcnn import CharCNN, encode, recall_threshold
from tests.llm.cases import DOCS, awkward, frame, new_columns

ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")


def plain(text):
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda f: (f[0], secrets.KINDS.index(f[2])))


PARTS = ["password", "Token", "api_key", "APIKEY", "secreT", "passwd", ":", "=", " ", '"', "'", "abcdefgh", "AKIA", "ABCDEFGH1234", "0123456789abcdef" * 2, "é", "漢", "\n", "x", "ſecret", "-_.=/+"]


@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_base_findings_are_the_patterns(text):
    assert secrets.scan(text.encode(), None) == plain(text)


def corpus():
    rng = random.Random(4)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for i in range(300):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) for _ in range(60)]
        if i % 5 == 0:
            words.insert(20, f'token = "{hexes(40)}"')
        if i % 7 == 0:
            words.insert(30, f"see http://example.com/{rng.choice(words)}/page-2024-archive-of-{rng.choice(words)}")
        if i % 11 == 0:
            words.insert(40, f"ref: {hexes(24)}x")
        rows.append((i, " ".join(words), "en", "a", 1))
    return rows


def test_network_is_trained_and_only_adds(spark):
    docs = frame(spark, corpus() + awkward())
    model = secrets.fit(docs)
    assert model is not None and model[1] >= 0.5
    got = {(r.doc_id, r.text): [(s.start, s.end, s.kind) for s in r.secrets_] for r in secrets.find_secrets(docs).collect()}
    assert new_columns(secrets.find_secrets(docs), docs) == ["secrets_"]
    for (_, text), spans in got.items():
        assert [s for s in spans if s[2] != "network"] == plain(text or "")
        assert all(0 <= a < b <= len(text) for a, b, _ in spans)
        assert spans == sorted(spans, key=lambda f: (f[0], secrets.KINDS.index(f[2]), f[1]))


def test_network_learns_and_threshold_keeps_recall():
    rng = np.random.default_rng(0)
    rows = [(bytes(rng.choice(list(b"0123456789abcdef"), 40).tolist()), 1) for _ in range(80)] + [(bytes(rng.choice(list(b"etaoin shrdlu"), 40).tolist()), 0) for _ in range(80)]
    x, y = encode([w for w, _ in rows], secrets.WIDTH), np.array([v for _, v in rows])
    net = CharCNN.start()
    net.fit(x[::2], y[::2])
    net.calibrate(x[1::2], y[1::2])
    p = net.probability(x[1::2])
    assert ((p > 0.5) == y[1::2]).mean() > 0.97
    t = recall_threshold(p, y[1::2], 0.95)
    assert (p[y[1::2] == 1] >= t).mean() >= 0.95


def test_long_candidate_is_seen_whole():
    text = b"a" * 15 + b"1" + b"b" * 500
    seen = secrets.windows(text, 0, len(text))
    assert seen[-1].endswith(b"b" * 16) and len(seen) > 5


def test_redaction(spark):
    rows = [(1, f'é token = "{"ab12" * 10}" end', "en", "a", 0), (2, None, None, None, None), (3, "clean text", "en", "a", 10), (4, "AKIA" + "A" * 20, "en", "a", 24)]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert new_columns(secrets.redact(docs), docs) == []
    assert secrets.redact(docs).columns == docs.columns
    assert got[1].text == 'é [SECRET]" end' and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[3].text == "clean text" and got[3].n_chars == 10
    assert got[4].text == "[SECRET]"


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert secrets.find_secrets(docs).count() == 0 and secrets.fit(docs) is None


def test_rare_findings_still_train_the_network(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) + str(rng.randrange(999)) for _ in range(30)), "en", "a", 1) for i in range(3000)]
    for i in range(0, 3000, 250):  # 12 findings, and many copies of one
        rows[i] = (i, f'{rows[i][1]} token = "{rng.randbytes(20).hex()}"', "en", "a", 1)
    rows += [(5000 + i, rows[0][1], "en", "a", 1) for i in range(500)]
    assert secrets.fit(frame(spark, rows), fit_rows=100) is not None
    few = [r for r in rows if "token" not in r[1] or r[0] in range(0, 1750, 250)]
    assert secrets.fit(frame(spark, few), fit_rows=100) is None


def test_threshold_keeps_recall_where_probabilities_are_low(spark):
    rng = random.Random(6)
    # 32 digits are a finding, 31 are none: hard to tell apart, so the calibrated probability is about their share.
    rows = [(i, f"the number {rng.randbytes(16).hex()[: 32 if i % 10 == 0 else 31]} is here", "en", "a", 1) for i in range(1500)]
    net, least = secrets.fit(frame(spark, rows))
    hits = [w for r in rows for w, y in secrets.labelled(r[1].encode()) if y]
    assert least < 0.5 and (net.probability(encode(hits, secrets.WIDTH)) >= least).mean() > 0.95


class Sure:
    """A network that takes everything for a secret."""

    def probability(self, x):
        return np.ones(len(x))


def test_short_assigned_values_are_candidates():
    text = b"pwd = Zx81kQ72 and passphrase: q7Rt55Lm02 but id = a1b2c3d end"
    assert [text[a:b] for a, b in secrets.candidates(text)] == [b"Zx81kQ72", b"q7Rt55Lm02"]
    assert secrets.scan(text, (Sure(), 0.5)) == [(6, 14, "network"), (31, 41, "network")]
    assert [y for _, y in secrets.labelled(b"one token = Zx81kQ72 two")][0] == 1


def test_network_finds_what_no_rule_does(spark):
    rng = random.Random(8)
    rows = []
    for i in range(1200):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) for _ in range(30)]
        if i % 3 == 0:
            words.insert(10, f"token = {rng.randbytes(12).hex()}Q7")
        if i % 3 == 1:
            words.insert(10, f"page-{rng.choice(words)}-of-{rng.choice(words)}-2024")
        if i % 3 == 2 and i % 30 == 2:
            words.insert(10, f"bearer = {rng.randbytes(12).hex()}Q7")  # no name that the rules know
        rows.append((i, " ".join(words), "en", "a", 1))
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: (r.text, [s for s in r.secrets if s.kind == "network"]) for r in secrets.find_secrets(docs).collect()}
    hidden = [k for k, (t, _) in got.items() if "bearer" in t]
    assert sum(bool(got[k][1]) for k in hidden) >= 0.6 * len(hidden)
    assert all(got[k][0][s.start : s.end].endswith("Q7") for k in hidden for s in got[k][1])
    pages = [k for k, (t, _) in got.items() if "-2024" in t]
    assert sum(bool(got[k][1]) for k in pages) <= 0.1 * len(pages)


def test_overlaps_are_those_of_all_pairs():
    rng = random.Random(9)
    for _ in range(200):
        spans, found = (sorted((a := rng.randrange(60), a + rng.randrange(1, 12)) for _ in range(rng.randrange(9))) for _ in range(2))
        assert secrets.overlapping(spans, [(*f, "hex") for f in found]) == [any(a < y and x < b for x, y in found) for a, b in spans]


def test_text_of_very_many_findings():
    text = b" ".join(b"token = %d%s" % (k, b"ab12cd34") for k in range(200_000))
    assert len(secrets.scan(text, (Sure(), 0.5))) == 200_000
    assert len(secrets.candidates(b"a-b." * 200_000 + b"c=" + b"x" * 9)) == 1


def test_long_candidates_train_with_all_windows():
    text = b"token = " + b"0123456789abcdef" * 20
    assert len(secrets.labelled(text)) == len(secrets.pieces(8, len(text)))
    assert all(y for _, y in secrets.labelled(text))


def test_few_texts_on_many_rows_train(spark):
    docs = spark.range(30_000).selectExpr("id as doc_id", "concat('the number ', if(id % 2 = 0, sha1(string(id % 60)), concat('page-', id % 60, '-of-some-archive')), ' is here') as text")
    assert secrets.fit(docs, fit_rows=40) is not None


def test_all_windows_train_calibrate_and_set_the_threshold(spark):
    rng = random.Random(10)
    docs = spark.createDataFrame([(i, f"the number {rng.randbytes(16).hex()[: 32 if i % 3 == 0 else 31]} is here", "en", "a", 1) for i in range(2400)], DOCS)
    rows = sorted({w for r in docs.collect() for w in secrets.labelled(r.text.encode())})
    found = spark.createDataFrame([(bytearray(w), y) for w, y in rows], "window binary, label long")
    shards = {y: -(-sum(v == y for _, v in rows) // 64) for y in (0, 1)}
    split = secrets.dealt(found, shards).collect()
    assert sorted((bytes(r.window), r.label) for r in split) == rows
    packs = [[(bytes(w.window), w.label) for w in r.windows] for r in secrets.packed(secrets.dealt(found, shards), shards).collect()]
    assert len(packs) == max(shards.values()) and all({y for _, y in p} == {0, 1} for p in packs)
    assert {w for p in packs for w in p} == {(bytes(r.window), r.label) for r in split if r.use > 1}
    net, least = secrets.fit(docs, fit_rows=64)
    last = [bytes(r.window) for r in split if r.use == 1 and r.label == 1]
    assert len(last) > 64  # more than a sample of 64 windows could hold out
    assert abs(least - recall_threshold(net.probability(encode(last, secrets.WIDTH)), np.ones(len(last)), secrets.RECALL)) < 1e-9


def test_whole_numbers_keep_the_order():
    z = np.array([-np.inf, -2.5, -1e-300, 0.0, 1e-300, 3.0, 1e9])
    assert (np.diff(secrets.ordered(z)) > 0).all() and (secrets.unordered(secrets.ordered(z)) == z).all()
    assert secrets.ordered(np.array([-0.0]))[0] == secrets.ordered(np.array([0.0]))[0]
