"""Near-duplicate documents and paragraphs against brute force."""

import random
import re

import numpy as np

from tightknit.llm import jaccard_join, paragraph_dedup, similar_sets
from tightknit.llm.components import components
from tightknit.llm.shingles import recall


def norm(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = norm(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b)


def grouped(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(n)]


def edited(words, rng, share):
    return [rng.choice(["new", "odd", "zzz"]) + str(rng.random())[2:6] if rng.random() < share else w for w in words]


def corpus(seed, groups=6, size=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", "  \n ", "one two", "One, two!", "one two three four", "x", "é 漢 ñ ü à", "É 漢 ñ ü à"]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 40, 120, 400]))]
        for _ in range(size):
            w = edited(base, rng, rng.choice([0, 0, 0.01, 0.02, 0.03, 0.08]))
            texts.append(rng.choice([" ", "  ", " \n"]).join(x.upper() if rng.random() < 0.1 else x for x in w) + rng.choice(["", ".", "!"]))
    rng.shuffle(texts)
    return texts


def check_join(docs_of, texts, **options):
    rows = jaccard_join.jaccard_classes(docs_of(list(enumerate(texts))), **options).collect()
    sets = [shingles(t) for t in texts]
    links = [
        (i, j)
        for i in range(len(texts))
        for j in range(i)
        if sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8
    ]
    root = grouped(len(texts), links)
    degree = np.bincount([x for pair in links for x in pair], minlength=len(texts))
    assert len(rows) == len(texts)
    assert {r.doc_id: (r.class_id, r.n_links) for r in rows} == {i: (root[i], degree[i]) for i in range(len(texts))}


def test_join_finds_every_link(docs_of):
    check_join(docs_of, corpus(1))


def test_join_in_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(similar_sets, "BLOCK", 3)
    monkeypatch.setattr(similar_sets, "COLUMNS", 16)
    check_join(docs_of, corpus(2, groups=4, size=15))


def test_join_of_odd_rows(docs_of):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (None, text), (7, text), (7, text), (7, "other words of the same id here"), (9, text + " end")]
    found = jaccard_join.jaccard_classes(docs_of(rows)).collect()
    assert sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in found) == [
        (-1, -1, 0), (-1, -1, 0), (7, 7, 0), (7, 7, 2), (7, 7, 2), (9, 7, 2)]
    assert jaccard_join.jaccard_classes(docs_of([])).count() == 0
    kept = jaccard_join.one_of_each(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == sorted(
        [(-1, text), (-1, text), (7, text), (7, "other words of the same id here")])


def test_depth_and_bands_reach_their_recall():
    depth = jaccard_join.stop_depth(40, 8, 0.8, 0.9999)
    assert recall(0.8, 40, depth) >= 0.9999 > recall(0.8, 40, depth + 1)
    bands, rows = paragraph_dedup.tuned_bands(56, 0.8, 0.999)
    assert bands * rows <= 56 and recall(0.8, bands, rows) >= 0.999


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 30)] + [(300, 300), (5, 4)]
    edges += [(rng.randint(1000, 1200), rng.randint(1000, 1200)) for _ in range(120)]
    rng.shuffle(edges)
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = grouped(1300, edges)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert found == {i: root[i] for i in touched}


def test_forests_span_all_links():
    rng = np.random.default_rng(6)
    path = np.zeros((4, 4), bool)
    for a, b in ((0, 2), (2, 3), (3, 1)):  # the first partner of each would lose the middle link
        path[a, b] = path[b, a] = True
    for n, m, share in ((4, 4, 0), (1, 1, 0), (40, 40, 0.03), (90, 90, 0.012), (60, 45, 0.02), (1, 30, 0.3), (30, 1, 0.3)):
        for two_sided in (False, True) if n == m else (True,):
            links = path if n == 4 else rng.random((n, m)) < share
            if not two_sided:
                links = (links | links.T) & ~np.eye(n, dtype=bool)
            shift = n if two_sided else 0
            up, down = similar_sets.spanning_forest(links, two_sided)
            kept = [(i, p + shift) for i, p in enumerate(up) if p >= 0]
            assert all(links[i, p - shift] for i, p in kept)
            if two_sided:
                kept += [(p, j + shift) for j, p in enumerate(down) if p >= 0]
                assert all(links[p, j - shift] for p, j in kept)
            edges = [(int(i), int(j) + shift) for i, j in zip(*np.nonzero(links))]
            assert grouped(n + m, kept) == grouped(n + m, edges)
            assert len(kept) == n + m - len(set(grouped(n + m, edges)))


def test_classes_of_chains(docs_of, monkeypatch):
    """Texts of which each is near the next one only, in blocks of all sizes and in one."""
    words = [f"c{i}" for i in range(1200)]
    rng = random.Random(15)
    starts = list(range(0, 900, 14))
    rng.shuffle(starts)
    texts = [" ".join(words[s : s + 200]) for s in starts]
    check_join(docs_of, texts)
    monkeypatch.setattr(similar_sets, "BLOCK", 5)
    check_join(docs_of, texts)


def brute_paragraphs(texts, min_words=30):
    found = []
    for i, text in enumerate(texts):
        at = 0
        for line in (text or "").split("\n"):
            stop = at + len(line.encode()) + 1
            if len(norm(line)) >= min_words:
                found.append((i, at, min(stop, len(text.encode())), shingles(line)))
            at = stop
    links = [
        (a, b) for a in range(len(found)) for b in range(a) if jaccard(found[a][3], found[b][3]) >= 0.8
    ]
    root = grouped(len(found), links)
    return {(found[k][0], found[k][1], found[k][2], found[root[k]][0]) for k in range(len(found)) if root[k] != k}


def test_paragraphs_equal_brute_force(docs_of):
    rng = random.Random(8)
    lines = [[f"v{rng.randint(0, 400)}é" for _ in range(rng.choice([3, 29, 30, 60, 90]))] for _ in range(25)]
    texts = [None, "", "\n\n"]
    for _ in range(60):
        own = [" ".join(edited(rng.choice(lines), rng, rng.choice([0, 0, 0.02, 0.05]))) for _ in range(rng.randint(1, 6))]
        texts.append(rng.choice(["\n", "\n\n"]).join(own) + rng.choice(["", "\n"]))
    docs = docs_of(list(enumerate(texts)))
    expected = brute_paragraphs(texts)
    found = paragraph_dedup.repeated_paragraphs(docs).collect()
    assert len(found) == len(expected) > 20
    assert {(r.doc_id, r.start, r.stop, r.first_doc_id) for r in found} == expected
    cut = paragraph_dedup.without_repeats(docs)
    assert cut.columns == [*docs.columns, "removed"]
    for r in cut.collect():
        data = (texts[r.doc_id] or "").encode()
        for _, start, stop, _ in sorted((e for e in expected if e[0] == r.doc_id), reverse=True):
            data = data[:start] + data[stop:]
        assert (r.text or "").encode() == data and (r.text is None) == (texts[r.doc_id] is None)


def test_paragraphs_of_odd_rows(docs_of):
    line = " ".join(f"w{i}" for i in range(40))
    rows = [(None, line), (3, line), (3, line), (3, line + "\nshort"), (8, line), (9, None)]
    found = paragraph_dedup.without_repeats(docs_of(rows)).collect()
    assert sorted((r.doc_id or -1, r.text or "", len(r.removed)) for r in found)[0] == (-1, line, 0)
    assert sum(len(r.removed) for r in found) >= 2
    assert [(r.text, len(r.removed)) for r in found if r.doc_id == 8] == [("", 1)]
    assert paragraph_dedup.without_repeats(docs_of([])).count() == 0


def brute_passages(texts, size=50):
    """For each text which of its words stand in a run that an earlier place has."""
    first, gone = {}, []
    for d, text in enumerate(texts):
        w = norm(text)
        gone.append([False] * len(w))
        for i in range(len(w) - size + 1):
            at = first.setdefault(tuple(w[i : i + size]), (d, i))
            if at[0] != d or i - at[1] >= size:
                gone[d][i : i + size] = [True] * size
    return gone


def test_passages_that_no_line_holds_equal_brute_force(docs_of):
    rng = random.Random(12)
    some = lambda n: [f"u{rng.randint(0, 900)}é" for _ in range(n)]
    passages = [some(n) for n in (49, 50, 51, 64, 120)]
    wrap = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    texts = [None, "", "stutter " * 160, " ".join(some(60)), "a b " * 20]
    for p in passages:
        texts.append(" ".join([*some(70), *p, *some(80)]) + ".")  # mid-line
        texts.append(wrap(some(11) + p + some(5), 13))  # lines of fewer than 30 words
        texts.append(" ".join(some(90) + p[:20]) + "\n" + " ".join(p[20:] + some(100)))  # across a line feed
        texts.append(", ".join(x.upper() if x.isascii() else x for x in some(75) + p + some(75)))
        texts.append(" ".join(some(70) + p + some(60) + p + some(70)))  # twice in one text
    rng.shuffle(texts)
    assert not brute_paragraphs(texts)
    gone = brute_passages(texts)
    found = paragraph_dedup.without_repeated_text(docs_of(list(enumerate(texts)))).collect()
    assert len(found) == len(texts)
    for r in found:
        left = [w for w, cut in zip(norm(texts[r.doc_id]), gone[r.doc_id]) if not cut]
        assert norm(r.text) == left and (r.text is None) == (texts[r.doc_id] is None)
        assert sum(p.n_words for p in r.removed) == sum(gone[r.doc_id])
        if not any(gone[r.doc_id]):
            assert r.text == texts[r.doc_id] and r.removed == []
    assert sum(map(any, gone)) >= 16
    assert paragraph_dedup.without_repeated_text(docs_of([])).count() == 0


def test_passages_with_lines(docs_of):
    line, inner = " ".join(f"w{i}" for i in range(60)), " ".join(f"x{i}" for i in range(55))
    head, other = (" ".join(f"{c}{i}" for i in range(40)) for c in "yz")
    twice = (3, other + " " + inner + ". End\n" + line)
    rows = [(1, line), (2, line + "\n" + head + " (one) " + inner + " tail"), twice, twice, (None, inner)]
    found = paragraph_dedup.without_repeated_text(docs_of(rows)).collect()
    assert sorted((r.doc_id or -1, r.text) for r in found) == [
        (-1, inner), (1, line), (2, head + " (one) " + inner + " tail"), (3, other + " End\n"), (3, other + " End\n")]
    assert {tuple(p.first_doc_id for p in r.removed) for r in found if r.doc_id == 3} == {(2, 1)}
