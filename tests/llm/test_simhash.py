"""SimHash components against comparisons of all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from tightknit.llm.simhash import fingerprints, forest, group_masks, links, simhash_components, visits


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        parent[root(a)] = root(b)
    found = {}
    for n in nodes:
        found.setdefault(root(n), set()).add(n)
    return sorted(sorted(g) for g in found.values())


def clusters(n, seed, most=6):
    rng = random.Random(seed)
    points = set()
    for _ in range(n):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 20])):
            for _ in range(rng.randint(0, most)):
                x ^= 1 << rng.randrange(64)
            points.add(x)
    return np.array(sorted(points), np.uint64)


def near_pairs(points, bits):
    a, b = np.nonzero(np.bitwise_count(points[:, None] ^ points) <= bits)
    return {(int(x), int(y)) for x, y in zip(a, b) if x < y}


@pytest.mark.parametrize("bits", [1, 4, 7])
def test_a_shard_of_one_tree_holds_every_pair(bits):
    points = clusters(150, 1)
    want = near_pairs(points, bits)
    masks = group_masks(bits)
    assert sum(int(m) for m in masks) == 2**64 - 1 and len(masks) > bits / 2
    found = set()
    for tree, mask in enumerate(masks):
        at, node, home = visits(points, mask, bits // len(masks), 5, tree)
        assert sorted(at[home]) == list(range(len(points)))
        for shard in np.unique(node):
            own, everything = at[(node == shard) & home], at[node == shard]
            found |= {tuple(sorted((int(a), int(b)))) for a in own for b in everything if (min(a, b), max(a, b)) in want}
    assert found == want


def test_forest_connects_what_pairs_connect():
    points = clusters(100, 2)
    a, b = forest(points, points, 4)
    assert len(a) < len(points)
    pairs = [(points[i], points[j]) for i, j in near_pairs(points, 4)]
    assert groups_of(zip(a, b), points) == groups_of(pairs, points)


@pytest.mark.parametrize("shard, block", [(4096, 1 << 17), (64, 1 << 17), (256, 40)])
def test_links_connect_what_pairs_connect(spark, shard, block):
    points = clusters(200, 3, 5)
    nodes = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fingerprint bigint")
    found = links(nodes, len(points), shard=shard, block=block).collect()
    pairs = [(points[i], points[j]) for i, j in near_pairs(points, 4)]
    unsigned = [(np.uint64(r.a % 2**64), np.uint64(r.b % 2**64)) for r in found]
    assert groups_of(unsigned, points) == groups_of(pairs, points)


def texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"Word{i}" for i in range(400)] + ["É", "x", "\x1c"]
    found = []
    for _ in range(40):
        words = rng.choices(vocabulary, k=rng.choice([2, 30, 300]))
        for _ in range(rng.randint(1, 6)):
            found.append(rng.choice([" ", "\n", " \t"]).join(words))
            words = [w.upper() if rng.random() < 0.2 else w for w in words]
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
    return found


def test_documents_agree_with_a_plain_search(docs_of):
    rng = random.Random(6)
    docs = [(i, t) for i, t in enumerate(texts(5))]
    rng.shuffle(docs)
    docs += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "a b c"), (5, "repeated id"), docs[3], docs[3]]
    docs += [(None, "one"), (None, "nobody else has these words"), (2000, "long text of words " * 60_000)]
    got = simhash_components(docs_of(docs), shard=16).collect()
    prints = [brute_fingerprint(t) for _, t in docs]
    assert sorted((str(r.doc_id), r.fingerprint % 2**64) for r in got) == sorted((str(d), p) for (d, _), p in zip(docs, prints))
    points = sorted(set(prints))
    pairs = [(a, b) for a in points for b in points if (a ^ b).bit_count() <= 4]
    least = {}
    for group in groups_of(pairs, points):
        ids = [d for (d, _), p in zip(docs, prints) if p in set(group) and d is not None]
        least |= {p: min(ids, default=None) for p in group}
    assert {(r.doc_id, r.component_id) for r in got} == {(d, least[p]) for (d, _), p in zip(docs, prints)}


def test_no_documents(docs_of):
    assert simhash_components(docs_of([])).collect() == []
    assert [tuple(r) for r in fingerprints(docs_of([(1, None)])).collect()] == [(1, 0)]
