"""Spelling variants against comparisons of all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from tightknit.llm import spelling
from tightknit.llm.spelling import counted_words, spelling_forms


def brute_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(counts):
    rows, forms = {}, {}
    for w, n in counts.items():
        others = [(-m, u) for u, m in counts.items() if near(w, u)]
        best = min(others, default=None)
        forms[w] = best[1] if best and -best[0] >= 10 * n else None
        rows[w] = (n, len(others), -best[0] if forms[w] else None)
    found = set()
    for w, (n, n_near, form_n) in rows.items():
        root = w
        while forms[root]:
            root = forms[root]
        found.add((w, forms[w], root, n, n_near, form_n))
    return found


def forms_of(spark, counts):
    frame = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    rows = [tuple(r) for r in spelling_forms(frame).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def typos(rng, word, n):
    letters = "abcéÿl"
    for _ in range(n):
        i = rng.randrange(len(word) + 1)
        word = rng.choice([word[:i] + rng.choice(letters) + word[i:], word[:i] + word[i + 1 :], word[:i] + rng.choice(letters) + word[i + 1 :]])
    return word


def variants(seed, bases, each):
    rng = random.Random(seed)
    counts = {}
    for base in bases:
        counts[base] = rng.choice([50, 5000])
        for _ in range(each):
            counts[typos(rng, base, rng.randint(1, 3))] = rng.choice([2, 2, 5, 60, 400])
    return {w: n for w, n in counts.items() if w}


def test_forms_agree_with_all_pairs(spark):
    counts = variants(1, ["aaabbbccc", "banana", "éclairé", "letterall", "abcabcabc"], 60)
    assert forms_of(spark, counts) == brute_forms(counts)


@pytest.mark.parametrize("plain", [0, 9])
def test_hashed_prefixes_agree_with_plain_ones(spark, monkeypatch, plain):
    monkeypatch.setattr(spelling, "PLAIN", plain)
    monkeypatch.setattr(spelling, "ROWS", 5)
    counts = variants(2, ["aaabbbccc", "lettersall", "éééééé"], 40)
    assert forms_of(spark, counts) == brute_forms(counts)


def test_long_words(spark):
    base = "".join(random.Random(3).choices("abcdefgh", k=3000))
    counts = {base: 500, base + "a": 3, base[1:]: 2, base[:50] + base[51:]: 4, base[:70] + "z" + base[71:]: 40, base[:-2]: 9}
    counts |= {base[:k]: 2 for k in range(60, 70)}
    assert forms_of(spark, counts) == brute_forms(counts)


def test_ties_and_chains(spark):
    counts = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaaac": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaabbbb": 19_999, "zzzzzzz": 7}
    got = forms_of(spark, counts)
    assert got == brute_forms(counts)
    assert ("aaaaaaa", "aaaaaab", "aaaabbb", 2, 2, 20) in got


def test_words_of_texts(docs_of, spark):
    rng = random.Random(4)
    words = ["Letters", "ÉCLAIRÉS", "éclairés", "abcdefg", "ABCDEFG", "short", "x" * 40, "naïveté×÷ÿÀ"]
    docs = [(i, " ".join(rng.choices(words, k=200)) + rng.choice(["", "_", "3", "\n"])) for i in range(60)]
    docs += [(None, "Letters letters-Letters"), (1, None), (2, ""), (3, "a" * 200_000), (4, "a" * 200_000), docs[0], docs[0]]
    got = {(r.word, r.n) for r in counted_words(docs_of(docs)).collect()}
    assert got == set(brute_words(docs).items())
    assert {w for w, _ in got} > {"naïveté×÷ÿÀ", "naïveté÷ÿÀ"}  # a thinned run beside the whole one


def test_whole_query_on_texts(docs_of):
    rng = random.Random(5)
    words = [typos(rng, w, rng.choice([0, 0, 0, 0, 1])) for w in rng.choices(["lettersx", "bananas", "mississippi"], k=3000)]
    docs = [(i, " ".join(words[20 * i : 20 * i + 20])) for i in range(150)]
    got = spelling_forms(counted_words(docs_of(docs)))
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == brute_forms(brute_words(docs))


def test_no_words(docs_of, spark):
    empty = counted_words(docs_of([(1, None), (2, "a b")]))
    assert spelling_forms(empty).collect() == []
    assert forms_of(spark, {"abcdefg": 2}) == {("abcdefg", None, "abcdefg", 2, 0, None)}
