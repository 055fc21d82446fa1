"""BPE encoding against the tokenizers library, and the round trip back."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tightknit.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["The", "quick ", " brown", "fox's", "we'll", "12", "345", "\n", "\n\n ", "   ", "\t", "<|endoftext|>", "é", "Straße", "漢字",
         "😀", " ", " ", "ǅ", "_", "--", "<|", "|>", "\x00", "\x1c", "é", "ᲊ", "\U000107bf", "don't", "...", "ة", "²"]


@pytest.fixture(params=[16 << 20, 3000])
def chunk(request, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", request.param)


def test_ids_and_texts_equal_the_library(docs_of, chunk):
    rng = random.Random(2)
    texts = [None, "", " ", "a", "x" * 30_000, "word " * 10_000, "<|endoftext|>", "a  <|endoftext|>  b"]
    texts += ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    texts += texts[-5:]
    library = Tokenizer.from_file(PATH)
    encoded = bpe.encode(docs_of(list(enumerate(texts))), PATH)
    rows = bpe.decode(encoded, PATH)
    digests = {r.doc_id: r for r in bpe.digests(encoded, PATH).collect()}
    found = rows.collect()
    assert len(found) == len(texts) == len(digests)
    for r in found:
        text = texts[r.doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.ids == ids, repr(text)
        assert r.decoded == library.decode(ids, skip_special_tokens=False) == text
        d = digests[r.doc_id]
        assert d.n_tokens == len(ids)
        assert d.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert d.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_odd_rows(docs_of, spark):
    text = "same text"
    found = bpe.encode(docs_of([(None, text), (None, text), (4, text), (4, text), (4, None)]), PATH).collect()
    assert sorted(len(r.ids) for r in found) == [0, 2, 2, 2, 2]
    assert bpe.encode(docs_of([]), PATH).count() == 0
    # Chunks of equal content have one name.
    same = docs_of([(1, text), (2, "other words")]).repartition(1)
    found = bpe.encode(same.unionByName(same).unionByName(same), PATH).collect()
    assert sorted(len(r.ids) for r in found) == [2] * 6
    loose = spark.createDataFrame([(1, [159, 244]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    library = Tokenizer.from_file(PATH)
    decoded = {r.doc_id: r.decoded for r in bpe.decode(loose, PATH).collect()}
    assert decoded == {1: library.decode([159, 244], skip_special_tokens=False), 2: "", 3: ""}
