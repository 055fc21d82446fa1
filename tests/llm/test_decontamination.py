"""Contamination against brute force, short and repeated items included."""

import random
import re
import time

import pytest

from tightknit.llm import decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = []
    for item, text in items:
        w = words(text)
        size = min(len(w), 13)
        windows += [(item, size, tuple(w[i : i + size])) for i in range(len(w) - size + 1) if size]
    found = []
    for doc, text in docs:
        w = words(text)
        hit, ids = set(), set()
        for item, size, part in windows:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) == part:
                    hit.update(range(i, i + size))
                    ids.add(item)
        found.append((str(doc), len(w), len(hit), sorted(str(i) for i in ids if i is not None)))
    return sorted(found)


def run(docs_of, docs, items):
    rows = decontamination.contamination(docs_of(docs), docs_of(items, "item_id bigint, text string")).collect()
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in rows)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_hits_equal_brute_force(docs_of, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK", block)
    rng = random.Random(block)
    vocabulary = ["The", "the", "a", "Fox", "x1", "é", "É", "dog's", "run-on", "漢字"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([1, 3, 5, 8, 9, 11, 12, 13, 14, 20, 40, 40])]
    items += [(50, None), (51, ""), (52, "..."), (53, "a a a " * 9), (53, items[9][1]), (54, items[10][1]), (None, items[11][1])]
    docs = [(0, None), (1, ""), (2, "!"), (3, "a " * 300), (None, items[10][1])]
    for i in range(60):
        text = " ".join(rng.choice([w, " ".join(rng.choice(vocabulary) for _ in range(9))]) for _, t in rng.sample(items[:12], 3) for w in [t])
        cut = rng.randint(0, 30)
        docs.append((100 + i, text[cut:].replace(" ", rng.choice([" ", ", ", "\n"]))))
    docs += [docs[-1], (100, "another text of the same id " + items[9][1])]
    assert run(docs_of, docs, items) == brute(docs, items)


def test_empty_tables(docs_of):
    docs = [(1, "some words"), (2, None)]
    assert run(docs_of, docs, []) == brute(docs, [])
    assert run(docs_of, [], [(1, "some words")]) == []
    kept = decontamination.clean(docs_of(docs), docs_of([(1, "some words")], "item_id bigint, text string"))
    assert [r.doc_id for r in kept.collect()] == [2] and kept.columns == docs_of(docs).columns


def test_long_texts_and_short_items_take_linear_time(docs_of):
    rng = random.Random(9)
    spoken = [f"w{rng.randrange(3000)}" for _ in range(100_000)]
    docs = [(1, " ".join(spoken)), (2, " ".join(spoken[:20_000])), (3, "nothing here")]
    items = [(1, "w17"), (3, " ".join(spoken[500:503])), (8, " ".join(spoken[60_000:60_008])), (9, " ".join(spoken[70_000:70_009]))]
    started = time.monotonic()
    got = run(docs_of, docs, items)
    assert time.monotonic() - started < 60
    places = [i for i, w in enumerate(spoken) if w == "w17"]
    for (_, n_words, n_hit, found), size in zip(got, (100_000, 20_000)):
        hit = {i for i in places if i < size} | {i for a, b in ((500, 503), (60_000, 60_008), (70_000, 70_009)) for i in range(a, b) if b <= size}
        assert n_words == size and n_hit == len(hit)
        assert found == (["1", "3", "8", "9"] if size > 70_000 else ["1", "3"])
    assert got[2] == ("3", 2, 0, [])
