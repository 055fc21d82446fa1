"""The forest's joints against prefixes compared one by one, and the depth that a join stops at."""

import random

import numpy as np

from test_near_duplicates import edited, grouped, jaccard, shingles
from tightknit.llm import jaccard_join, lsh_forest
from tightknit.llm.shingles import recall


def some_paths(n, trees, depth, seed):
    rng = np.random.default_rng(seed)
    return [rng.integers(0, 3, trees * depth, dtype=np.uint8).tobytes() for _ in range(n - 3)] + [b"\1" * (trees * depth)] * 3


def test_joints_connect_what_shares_a_prefix(spark):
    trees, depth, floor = 3, 6, 3
    all_paths = some_paths(150, trees, depth, 4)
    rows = [(i * 7 - 300, p) for i, p in enumerate(all_paths)]
    sets = spark.createDataFrame(rows, "sid bigint, paths binary").repartition(5)
    found = lsh_forest.joints(sets, trees, depth, floor).collect()
    assert len({(r.a, r.b) for r in found}) == len(found) and all(r.a < r.b for r in found)
    place = {sid: i for i, (sid, _) in enumerate(rows)}
    for d in range(floor, depth + 1):
        by_prefix = [
            (i, j)
            for i in range(len(rows))
            for j in range(i)
            for t in range(trees)
            if all_paths[i][t * depth :][:d] == all_paths[j][t * depth :][:d]
        ]
        joined = [(place[r.a], place[r.b]) for r in found if r.agree >= d]
        assert grouped(len(rows), joined) == grouped(len(rows), by_prefix)
    assert by_prefix and lsh_forest.joints(sets.limit(0), trees, depth, floor).count() == 0


def test_joints_cross_the_ends_of_ranges(spark):
    """One prefix that all sets share, cut into many ranges, one row or none in some."""
    rows = [(i, b"\5\5\5" + bytes([i // 250, i % 250])) for i in range(1000)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for n in (1000, 25):
            found = lsh_forest.joints(spark.createDataFrame(rows[:n], "sid bigint, paths binary"), 1, 5, 3)
            links = [(r.a, r.b) for r in found.collect()]
            assert set(grouped(n, links)) == {0} and len(links) <= n - 1 + 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])


def test_paths_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**64, 1300, dtype=np.uint64)
    values = np.concatenate([np.sort(pool[:1000]), np.sort(pool[200:1300])])
    a, b = lsh_forest.paths(values, np.array([0, 1000, 2100]), 80, 10)
    assert abs((a == b).mean() - 800 / 1300) < 0.06  # four deviations of 800 draws


def depths_of(monkeypatch, docs, **options):
    """Prefixes that a join shortens to, and its rows."""
    asked = []
    real = lsh_forest.stop_depth
    monkeypatch.setattr(jaccard_join, "stop_depth", lambda *args: asked.append(real(*args)) or asked[-1])
    rows = jaccard_join.jaccard_classes(docs, **options).collect()
    return asked[1:], rows


def test_prefixes_shorten_to_the_weakest_link(docs_of, monkeypatch):
    rng = random.Random(21)
    base = [f"w{i}" for i in range(2000)]
    near = [" ".join(base[: 1000]), " ".join(base[:1000] + ["more"])]
    asked, rows = depths_of(monkeypatch, docs_of(list(enumerate(near))))
    assert asked == [10] and [r.n_links for r in rows] == [1, 1]  # a link near 1 needs no shorter prefix
    weak = [" ".join(base[1000:1200]), " ".join(base[1000:1200] + [f"x{i}" for i in range(45)])]
    assert 0.8 <= jaccard(*map(shingles, weak)) < 0.83
    asked, rows = depths_of(monkeypatch, docs_of(list(enumerate(near + weak))))
    assert asked[-1] == 7 and [r.n_links for r in rows] == [1, 1, 1, 1]
    asked, rows = depths_of(monkeypatch, docs_of([(i, " ".join(edited(base[:60], rng, 1))) for i in range(4)]))
    assert asked == [] and [r.n_links for r in rows] == [0] * 4


def test_recall_against_brute_force(docs_of):
    rng = random.Random(22)
    texts = []
    for group in range(40):
        base = [f"g{group}w{i}" for i in range(150)]
        texts += [" ".join(edited(base, rng, rng.choice([0.005, 0.01, 0.015, 0.02]))) for _ in range(6)]
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    weak = sum(jaccard(sets[i], sets[j]) < 0.85 for i, j in links)
    rows = jaccard_join.jaccard_classes(docs_of(list(enumerate(texts)))).collect()
    assert weak > 20 and sum(r.n_links for r in rows) == 2 * len(links)
    root = grouped(len(texts), links)
    assert {r.doc_id: r.class_id for r in rows} == dict(enumerate(root))
    assert recall(0.8, jaccard_join.TREES, jaccard_join.DEPTH) > 0.98
