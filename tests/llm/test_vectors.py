import numpy as np

from meshlark.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, least=0.9):
    sound = [v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, _ in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if s else None for s, (_, v, _) in zip(sound, rows)]
    n = len(rows)
    link = [[sound[i] and sound[j] and len(unit[i]) == len(unit[j]) and (list(rows[i][1]) == list(rows[j][1]) or float(unit[i] @ unit[j]) >= least) for j in range(n)] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        for i in range(n):
            label[i] = min([label[i], *(label[j] for j in range(n) if link[i][j])])
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if label[j] == label[i] and rows[j][0] is not None]
        out.append((rows[i][0], sum(link[i]) - bool(sound[i]), min(ids, default=None)))
    return sorted(out, key=str)


def data():
    rng = np.random.default_rng(6)
    rows = []
    for c in range(12):
        centre = rng.normal(size=16)
        for _ in range(9):
            v = np.float32(centre + rng.normal(size=16) * rng.choice([0.1, 0.25, 0.4]))
            rows.append((len(rows), v.tolist(), 0))
    rows += [(900 + k, rows[3][1], 1) for k in range(5)] + [(3, rows[3][1], 1), (950, (np.float32(rows[3][1]) * 4).tolist(), 0)]
    rows += [(960, None, 0), (961, [0.0] * 16, 0), (962, [float("nan")] + [1.0] * 15, 0), (963, [None] + [1.0] * 15, 0), (964, [float("inf")] * 16, 0), (965, [1.0, 2.0], 0), (966, [1.0, 2.01], 0), (967, [], 0), (None, rows[0][1], 0), (968, [1e-30, 1e-30], 0), (969, [3e38, 3e38], 0)]
    return rows


def test_matches_brute_force_in_any_blocks(spark):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as node", "3 as root")
    want = plain(rows)
    for block in (None, 30):
        got = sorted(((r.id, r.n_links, r.component) for r in vectors.embedding_groups(df, block=block).collect()), key=str)
        assert got == want


def test_bound_holds():
    rng = np.random.default_rng(2)
    unit = vectors.normalised(rng.normal(size=(300, 24)))
    q, s, e = vectors.quantised(unit)
    near = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None]
    room = (1 + e)[:, None] * e[None] + e[:, None] * (1 + e + e)[None]
    assert (np.abs(near - unit @ unit.T) <= room).all()


def test_empty(spark):
    assert vectors.embedding_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_double_precision_stays(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [0.9, (1 - 0.81) ** 0.5 - 1e-9], 0), (3, [0.9 - 1e-9, (1 - 0.81) ** 0.5 + 1e-9], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.id: r.n_links for r in vectors.embedding_groups(df).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    assert got == {i: sum(float(unit[i] @ unit[j]) >= 0.9 for j in unit if j != i) for i in unit}
