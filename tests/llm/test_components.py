import random

from meshlark.llm.common import materialise, release, shared_dir
from meshlark.llm.components import connected_components


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    return {x: find(x) for x in root}


def test_chains_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 150)] + [(rng.randrange(3000, 3100), rng.randrange(3000, 3100)) for _ in range(90)] + [(5, 5), (2, 1), (2, 1)]
    df = spark.createDataFrame(edges + [(None, 4), (4, None)], "a long, b long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    want = {k: v for k, v in plain([e for e in edges if e[0] != e[1]]).items()}
    assert set(got) == set(want)
    pairs = {}
    for k, v in got.items():
        assert pairs.setdefault(v, want[k]) == want[k]
    assert len(pairs) == len(set(want.values()))


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tables_are_in_the_shared_folder_and_can_go(spark):
    df = materialise(spark.range(3), "numbers")
    assert df.count() == 3 and df.inputFiles()[0].removeprefix("file:").lstrip("/").startswith(shared_dir(spark).removeprefix("file:").lstrip("/"))
    release(spark)
    assert not list(__import__("pathlib").Path(shared_dir(spark)).glob("meshlark/*/numbers-*"))
    assert materialise(spark.range(2), "numbers").count() == 2
