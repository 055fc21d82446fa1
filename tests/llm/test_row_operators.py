"""Token counts, quality rules, language ID and quality classifier on small texts."""

import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tightknit.llm import language_id, quality_model, quality_rules, token_counts
from tightknit.llm.batches import crc_of_id

WORDS = "The quick Brown fox it's we'll 12 345 don't <|endoftext|> Σίσυφος ΟΔΟΣ été ǅ İstanbul ß 漢字 😀 a b   Ᲊ \x1c zz_zz !!! .,.".split(" ")


def messy(seed, n=60):
    rng = random.Random(seed)
    found = [None, "", " \t\n ", "a", "the " * 30_000, "x" * 50_000]
    for _ in range(n):
        found.append(rng.choice(["", " "]).join(rng.choice(WORDS) + rng.choice(["", " ", "\n", "  "]) for _ in range(rng.randint(1, 40))))
    return found + found[-3:]


def test_token_counts_equal_the_library(docs_of):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = messy(1)
    rows = token_counts.count_tokens(docs_of(list(enumerate(texts))), path).collect()
    library = Tokenizer.from_file(path)
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.n_tokens == len(library.encode(text, add_special_tokens=False).ids), text
        assert r.n_bytes == len(text.encode()) and r.over_limit == (r.n_tokens > 2048)


def test_token_counts_of_an_empty_table(docs_of):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert token_counts.count_tokens(docs_of([]), path).count() == 0


def test_whole_tokens_are_proved():
    with open(public_tokenizers.path("word_bpe_49k.json")) as file:
        spec = file.read()
    library = Tokenizer.from_str(spec)
    whole = token_counts.whole_tokens(spec)
    assert len(whole) > 20_000
    for word in random.Random(2).sample(sorted(whole), 500):
        assert len(library.encode(word, add_special_tokens=False).ids) == 1


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    n = len(words)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit),
        "base_failed": n < 10 or 100 * len(hit) > 20 * n,
    }


def test_quality_measures_equal_brute_force(docs_of):
    rng = random.Random(5)
    texts = messy(3)
    for _ in range(60):
        words = [rng.choice(["a", "b", "é", "#x", "Z!", "漢"]) for _ in range(rng.randint(1, 60))]
        texts.append("".join(w + rng.choice([" ", "\n", "\n\n", "\t", "\r\n", " \x0b"]) for w in words))
    rows = quality_rules.quality_rules(docs_of(list(enumerate(texts)))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        brute = brute_measures(texts[r.doc_id] or "")
        assert {k: r[k] for k in brute} == brute, texts[r.doc_id]
        assert not (r.base_failed and r.kept)


def test_cascade_does_not_depend_on_the_order():
    texts = ["plain words " + str(i) + " of some text which is long enough to stay" for i in range(20)]
    texts += ["# # # $ $ a b c d e f g h i", "LOUD WORDS ARE HERE TO STAY AND MORE OF THEM COME", "1 2 3 4 5 6 7 8 9 10 11 12 13"]
    column = pa.array(texts, pa.string())
    rules = list(quality_rules.RULES)
    verdicts = []
    for seed in range(6):
        random.Random(seed).shuffle(rules)
        loaded = quality_rules.Texts(column)
        quality_rules.base_measures(loaded)
        verdicts.append(quality_rules.cascade(loaded, rules).tolist())
    assert all(v == verdicts[0] for v in verdicts)
    assert verdicts[0][:20] == [True] * 20 and verdicts[0][20:] == [False] * 3


def test_quality_rules_of_an_empty_table(docs_of):
    assert quality_rules.quality_rules(docs_of([])).count() == 0


SPOKEN = {
    "aa": ["lorem", "ipsum", "dolor", "amet"],
    "bb": ["kaza", "wuku", "zwik", "ykka"],
    "cc": ["ñoñu", "ñeña", "güi", "ñañe"],
}


def spoken(n, seed):
    rng = random.Random(seed)
    return [
        (i, " ".join(rng.choice(SPOKEN[lang]) for _ in range(rng.randint(3, 200))), lang)
        for i in range(n)
        for lang in [rng.choice(sorted(SPOKEN))]
    ]


def test_language_id_on_held_out_texts(docs_of):
    rows = spoken(240, 4) + [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !", "cc"), (903, "漢", None), (5, "kaza wuku", "bb")]
    docs = docs_of(rows, "doc_id bigint, text string, lang string")
    out = crc_of_id() % 4 == 2
    found = language_id.identify(docs, language_id.train_on(docs, ~out)).withColumn("out", out).collect()
    assert len(found) == len(rows)
    truth = {i: lang for i, _, lang in rows[:240]}
    held = [r for r in found if r.out and r.doc_id in truth]
    assert len(held) > 20 and np.mean([truth[r.doc_id] == r.lang_pred for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in found)
    assert {r.lang_pred for r in found if r.doc_id in (900, 901, 902)} == {"und"}


def test_training_draws_from_whole_texts(docs_of, monkeypatch):
    monkeypatch.setattr(language_id, "fit", lambda texts, labels: list(zip(texts, labels)))
    rng = random.Random(2)
    whole = {i: "".join(rng.choices("abcdefgh", k=300 + i)) for i in range(40)}
    docs = docs_of([(i, t, "aa") for i, t in whole.items()] + [(99, "short", "bb")], "doc_id bigint, text string, lang string")
    drawn = language_id.train_on(docs, F.lit(True), chars=50)
    pieces = [t for t, lang in drawn if lang == "aa"]
    assert len(pieces) == 40 and ("short", "bb") in drawn
    assert all(len(p) == 50 and any(p in t for t in whole.values()) for p in pieces)
    assert sum(any(t.startswith(p) for t in whole.values()) for p in pieces) < 20


def test_texts_of_two_languages_stay(docs_of):
    rows = [(i, t, lang) for i, t, lang in spoken(120, 8)]
    net = language_id.train_on(docs_of(rows, "doc_id bigint, text string, lang string"), F.lit(True))
    mixed = [(i, rows[i][1] + " " + rows[i + 1][1] + " " * 600 + rows[i + 2][1]) for i in range(0, 100, 3)]
    kept = language_id.of_known_language(docs_of(mixed + [(900, None), (901, "12 !"), (902, "")]), net).collect()
    assert sorted(r.doc_id for r in kept) == [i for i, _ in mixed]


def test_language_id_without_labels(docs_of):
    docs = docs_of([(1, "abc", None), (2, None, None)], "doc_id bigint, text string, lang string")
    for frame in (docs, docs.limit(0)):
        found = language_id.identify(frame, language_id.train_on(frame, F.lit(True))).collect()
        assert {r.lang_pred for r in found} <= {"und"}


def test_byte_net_tables_agree_with_its_filters():
    net = language_id.fit(["abc def", "ghi jkl xyz"], ["a", "b"], epochs=2)
    windows = np.random.default_rng(0).integers(0, 256, (5, language_id.WINDOW)).astype(np.uint8)
    answer, _ = net.features(windows)
    direct = language_id.softmax(np.maximum(answer, 0) @ net.out + net.out_bias)
    assert np.allclose(direct, net.probabilities(windows, net.paired()), atol=1e-5)


def test_quality_classifier_separates_junk(docs_of, spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.8
        words = [rng.choice(["some", "plain", "words", "of", "prose", "the"]) for _ in range(rng.randint(5, 80))]
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)))
        if i % 2:
            labels.append((i, int(good)))
    rows += [(1000, None), (1001, ""), (1002, None)]
    labels += [(None, 1), (1, None), (5000, 1)]
    docs, marks = docs_of(rows), spark.createDataFrame(labels, "doc_id bigint, quality int")
    out = crc_of_id() % 5 == 0
    found = quality_model.score_quality(docs, quality_model.train_on(docs, marks, ~out)).withColumn("out", out).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    truth = {i: int(not t.isupper()) for i, t in rows[:400]}
    held = [r for r in found if r.out and r.doc_id in truth]
    assert np.mean([truth[r.doc_id] == r.predicted for r in held]) >= 0.9


def test_quality_classifier_without_labels(docs_of, spark):
    docs, none = docs_of([(1, "a"), (2, None)]), spark.createDataFrame([], "doc_id bigint, quality int")
    model = quality_model.train_on(docs, none, F.lit(True))
    assert model is None
    assert [r.score for r in quality_model.score_quality(docs, model).collect()] == [0.5, 0.5]
    assert quality_model.score_quality(docs.limit(0), model).count() == 0


def test_language_sample_counts_copies_once(docs_of, monkeypatch):
    texts = [f"text number {i}" for i in range(12)]
    rows = [(i, texts[i % 12] if i < 12 else texts[i % 3], "aa") for i in range(90)]
    docs = docs_of(rows, "doc_id bigint, text string, lang string")
    monkeypatch.setattr(language_id, "fit", lambda texts, labels: (sorted(texts), labels))
    assert language_id.train_on(docs, F.lit(True)) == (sorted(texts), ["aa"] * 12)
    few, labels = language_id.train_on(docs, F.lit(True), texts=8)
    assert len(set(few)) == 8 and labels == ["aa"] * 8
