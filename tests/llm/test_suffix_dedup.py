"""Byte-exact dedup against brute force."""

import random

import numpy as np
import pytest

from tightknit.llm import suffix_dedup as sd


def brute(rows):
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - 49):
            if doc is not None:
                key = data[i : i + 50]
                first[key] = min(first.get(key, doc), doc)
    found = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        if doc is not None:
            for i in range(len(data) - 49):
                if first[data[i : i + 50]] < doc:
                    gone[i : i + 50] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        found.append((doc if doc is not None else -1, len(data), [tuple(x) for x in edges.reshape(-1, 2).tolist()], kept))
    return sorted(found)


def run(docs_of, rows):
    found = sd.without_repeats(docs_of(rows)).collect()
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, [(s.start, s.stop) for s in r.spans], bytes(r.kept)) for r in found)


def corpus(seed, n=70):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefghé ") for _ in range(rng.choice([60, 150, 400]))) for _ in range(8)]
    rows = [(rng.randint(-5, 10_000), t) for t in (None, "", "short", "x" * 49, "y" * 50, "a" * 300, "a" * 70, "ab" * 200, "ab" * 90)]
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            b = rng.choice(base)
            a = rng.randint(0, len(b) - 40)
            parts.append(b[a : a + rng.choice([30, 49, 50, 51, 75, 200])])
            if rng.random() < 0.5:
                parts.append("".join(rng.choice("xyz") for _ in range(rng.randint(1, 30))))
        text = "".join(parts)
        rows.append((rng.randint(-5, 10_000), text))
        if rng.random() < 0.15:
            rows.append((rng.randint(0, 10_000), text))
    return rows


@pytest.mark.parametrize("chunk", [16 << 20, 2500])
def test_removed_bytes_equal_brute_force(docs_of, monkeypatch, chunk):
    monkeypatch.setattr(sd, "CHUNK", chunk)
    monkeypatch.setattr(sd, "SLICE", 1000)
    rows = corpus(chunk)
    expected = brute(rows)
    assert sum(len(r[2]) for r in expected) > 30
    assert run(docs_of, rows) == expected


def test_odd_rows(docs_of):
    text = "The same passage of rather more than fifty bytes, which repeats itself."
    rows = [(None, text), (None, text), (4, text), (4, text), (4, "x" + text), (9, text + "tail"), (2, None)]
    assert run(docs_of, rows) == brute(rows)
    same = docs_of(rows[:1]).repartition(1)  # chunks of equal content have one name
    assert sd.without_repeats(same.unionByName(same).unionByName(docs_of(rows).repartition(1))).count() == len(rows) + 2
    assert sd.without_repeats(docs_of([])).count() == 0


def test_order_of_suffixes(monkeypatch):
    rng = np.random.default_rng(1)
    n = 400
    left, right = rng.integers(0, sd.REACH + 1, n), rng.integers(0, sd.REACH + 1, n)
    cells = rng.integers(97, 99, (n, sd.WIDTH)).astype(np.uint8)
    cells[:, sd.REACH : sd.REACH + sd.GRAM + 10] = 97
    column = np.arange(sd.WIDTH) - sd.REACH
    cells[(column < -left[:, None]) | (column >= sd.GRAM + right[:, None])] = 0
    hashes = rng.integers(0, 5, n).astype(np.uint64)
    s = sd.Suffixes(cells, left, right, hashes)
    text = [(int(hashes[i]), cells[i, sd.REACH : sd.REACH + sd.GRAM + right[i]].tobytes()) for i in range(n)]
    assert [text[i] for i in s.order] == sorted(text)
    common = s.common
    for k in range(1, n):
        a, b = text[s.order[k - 1]], text[s.order[k]]
        if a[0] == b[0]:
            assert common[k] == next((i for i, (x, y) in enumerate(zip(a[1], b[1])) if x != y), min(len(a[1]), len(b[1])))


def test_equal_hashes_of_different_bytes_are_told_apart(monkeypatch):
    rows = corpus(9, n=25)
    monkeypatch.setattr(sd, "_POWERS", np.ones(sd.WIDTH, np.uint64))  # sums of bytes: anagrams collide
    monkeypatch.setattr(sd, "_VALUES", np.arange(256, dtype=np.uint64))
    rng = random.Random(4)
    for _ in range(10):
        piece = rows[-1][1][:24] if len(rows[-1][1]) > 60 else "q" * 24
        rows.append((rng.randint(0, 9999), "ba" + piece + "ab" * 20))
        rows.append((rng.randint(0, 9999), "ab" + piece + "ba" * 20))
    parts = [(d, t) for d, t in rows if d is not None]
    cells = np.stack([np.frombuffer((t or "").encode().ljust(sd.WIDTH, b"\1")[: sd.WIDTH], np.uint8) for _, t in parts])
    ids = np.array([d for d, _ in parts])
    s = sd.Suffixes(cells, np.full(len(ids), sd.REACH), np.full(len(ids), sd.REACH), np.zeros(len(ids), np.uint64))
    most, _ = sd.covered(s, ids)
    for i in range(len(ids)):
        for reach in range(sd.REACH + 1):
            w = cells[i, sd.REACH - reach :][: sd.SIZE].tobytes()
            if any(ids[j] < ids[i] and cells[j, sd.REACH - reach :][: sd.SIZE].tobytes() == w for j in range(len(ids))):
                assert most[i] >= reach
