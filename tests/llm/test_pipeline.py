"""The pipeline's stages on a small table with planted cases."""

import random

import corpus_pipeline
from tokenizers import Tokenizer
import public_tokenizers


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_stages_catch_what_is_planted_and_keep_the_rest(spark, tmp_path):
    rng = random.Random(6)
    words = {"aa": [f"lor{c}m{d}" for c in "aeiou" for d in "abcdefgh"], "bb": [f"{c}üß{d}k" for c in "wzkj" for d in "abcdefgh"]}
    rows = []
    for i in range(120):
        lang = rng.choice(["aa", "bb"])
        rows.append((i, "\n".join(sentence(rng, words[lang], rng.randint(15, 28)) for _ in range(4)), lang, "s", 0))
    passage, item = sentence(rng, words["aa"], 60), sentence(rng, words["aa"], 30)
    rows += [(200, rows[0][1], "aa", "s", 0), (201, rows[1][1] + " word", "aa", "s", 0)]
    rows += [(210 + i, sentence(rng, words["aa"], 25) + "\n" + passage + "\n" + sentence(rng, words["aa"], 25), "aa", "s", 0) for i in range(3)]
    rows += [(220, sentence(rng, words["aa"], 100) + " " + item, "aa", "s", 0)]
    rows += [(230, "123 456", None, None, None), (231, None, "aa", None, None), (232, "", None, "s", 0)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({r.doc_id: r.text for r in docs.collect()})
    clean = {i: t for i, t, *_ in rows[:120]}
    for kept in seen:
        assert {i: kept.get(i) for i in clean} == clean
    assert not {230, 231, 232} & set(seen[0]) and {200, 201, 210, 220} <= set(seen[0])
    assert not {200, 201} & set(seen[1]) and {210, 211, 212, 220} <= set(seen[1])
    assert passage in seen[2][210] and all(passage not in seen[2][i] and seen[2][i] for i in (211, 212))
    assert 220 not in seen[3] and {210, 211, 212} <= set(seen[3])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert found == {i: library.encode(t, add_special_tokens=False).ids for i, t in seen[3].items()}


def test_last_stage_decodes_what_it_encodes(docs_of):
    texts = ["two words", "é 漢\nñ ü", "", "  blanks  and\ttabs "]
    docs = docs_of(list(enumerate(texts))).select("doc_id", "text")
    found = corpus_pipeline.encoded(docs.sparkSession, docs, "").collect()
    assert {r.doc_id: (r.decoded, r.n_tokens) for r in found} == {i: (t, len(r.ids)) for i, t in enumerate(texts) for r in found if r.doc_id == i}
