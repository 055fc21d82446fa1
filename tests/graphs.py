"""Small graphs with known answers, random graphs and brute-force searches."""

import itertools
import random


def complete(ids):
    return list(itertools.combinations(sorted(ids), 2))


def multipartite(*groups):
    return [
        (a, b) for g, h in itertools.combinations(groups, 2) for a in g for b in h
    ]


# name -> edges, (V, E), k-clique counts K3 K4 K5, maximal cliques by size
FIXTURES = {
    "two_triangles": (
        [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (4, 5)], (5, 6), (2, 0, 0), {2: 1, 3: 2}),
    "k5": (complete(range(1, 6)), (5, 10), (10, 5, 1), {5: 1}),
    "octahedron": (multipartite([0, 1], [2, 3], [4, 5]), (6, 12), (8, 0, 0), {3: 8}),
    "k333": (multipartite([0, 1, 2], [3, 4, 5], [6, 7, 8]), (9, 27), (27, 0, 0), {3: 27}),
    "k33": (multipartite([1, 2, 3], [4, 5, 6]), (6, 9), (0, 0, 0), {2: 9}),
    "c5": ([(1, 2), (2, 3), (3, 4), (4, 5), (1, 5)], (5, 5), (0, 0, 0), {2: 5}),
    "triangle": ([(1, 2), (1, 3), (2, 3)], (3, 3), (1, 0, 0), {3: 1}),
}

MESSY = "# comment\n1 2\n2 1\n1\t3 0.75 1700000000\n  2 3\n\n3 3\n3 10\n10 -4\n7\nabc 5\n8 8\n"


def edges_df(spark, pairs):
    return spark.createDataFrame(
        [(min(p), max(p)) for p in pairs], "src bigint, dst bigint"
    )


def random_pairs(seed=11, graphs=14, n=9):
    """Disjoint random graphs of mixed density, some ids negative or above 32 bits."""
    rng = random.Random(seed)
    pairs = []
    for g in range(graphs):
        base = (g - 3) * 1_000_000_000
        density = rng.choice([0.3, 0.5, 0.7, 0.9])
        ids = rng.sample(range(base, base + 100), n)
        pairs += [(min(a, b), max(a, b)) for a, b in itertools.combinations(ids, 2) if rng.random() < density]
    return pairs


def brute_cliques(pairs, upto):
    """All cliques by size, as sorted tuples, by plain search."""
    nbrs = {}
    for a, b in pairs:
        nbrs.setdefault(a, set()).add(b)
        nbrs.setdefault(b, set()).add(a)
    found = {1: {(v,) for v in nbrs}}
    for k in range(2, upto + 1):
        found[k] = {
            c + (w,)
            for c in found[k - 1]
            for w in set.intersection(*(nbrs[v] for v in c))
            if w > c[-1]
        }
    return found, nbrs


def brute_maximal(pairs):
    found, nbrs = brute_cliques(pairs, 12)
    return {
        c for cliques in found.values() for c in cliques if not set.intersection(*(nbrs[v] for v in c))
    }


def cliques_of(df):
    rows = [tuple(r.clique) for r in df.collect()]
    assert len(rows) == len(set(rows)), "a clique was listed twice"
    return set(rows)
