"""PPM scores against a plain model, and the unigram base against its formula."""

import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tightknit.llm import ppm
from tightknit.llm.batches import bytes_of, offsets_of
from tightknit.plans.stable import table_folder


def trie(texts, order=ppm.ORDER):
    counts = defaultdict(Counter)
    for data in texts:
        symbols = [0] * order + [b + 1 for b in data] + [ppm.END]
        for i in range(order, len(symbols)):
            for k in range(order + 1):
                counts[tuple(symbols[i - k : i])][symbols[i]] += 1
    return counts


def plain(context, symbol, counts, least):
    """Log10 probability by walking the contexts with a set of excluded symbols."""
    excluded, total = set(), 0.0
    for k in range(len(context), -1, -1):
        kids = {s: n for s, n in counts.get(tuple(context[len(context) - k :]), {}).items() if n >= least}
        if not kids:
            continue
        fair = {s: n for s, n in kids.items() if s not in excluded}
        here = tuple(context[len(context) - k :])
        cut = sum(counts[here].values()) - sum(kids.values()) if k and any(here) else 0
        escape = len(fair) / 2 + cut
        if fair or cut:
            size = sum(fair.values()) + cut
            if symbol in fair:
                return total + math.log10((fair[symbol] - 0.5) / size)
            total += math.log10(escape / size)
        excluded |= set(kids)
    return total - math.log10(ppm.SYMBOLS - len(excluded))


def grams_of(counts, least):
    found = []
    for k in range(ppm.ORDER + 1):
        codes, n = [], []
        for context, kids in counts.items():
            if len(context) == k:
                for s, c in kids.items():
                    if c >= least:
                        codes.append(sum(x << ppm.BITS * (k - i) for i, x in enumerate((*context, s))))
                        n.append(c)
        found.append((np.array(codes, np.uint64), np.array(n, np.int64)))
    return found


@pytest.mark.parametrize("least", [1, 3])
def test_code_lengths_equal_the_plain_walk(least):
    rng = random.Random(least)
    texts = ["".join(rng.choice(["ab", "abc", "the ", "ñ", "q"]) for _ in range(30)).encode() for _ in range(20)]
    counts = trie(texts)
    levels = ppm.build(grams_of(counts, least))
    for data in [*texts[:4], b"", b"zzz", "the abñ".encode()]:
        codes, ends = ppm.coded(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        symbols = [0] * ppm.ORDER + [b + 1 for b in data] + [ppm.END]
        expected = [plain(symbols[i - ppm.ORDER : i], symbols[i], counts, least) for i in range(ppm.ORDER, len(symbols))]
        assert ends.tolist() == [0, len(data) + 1]
        assert np.allclose(ppm.log_probabilities(codes, levels), expected, atol=1e-5)


def test_probabilities_sum_to_one():
    counts = trie([b"abracadabra", b"abrakadabra alakazam", b"banana"] * 3)
    levels = ppm.build(grams_of(counts, 1))
    for context in [(0, 0, 0, 0), (98, 99, 115, 98), (1, 2, 3, 98), (99, 98, 98, 98), (5, 5, 5, 5)]:
        head = sum(x << ppm.BITS * (ppm.ORDER - i) for i, x in enumerate(context))
        codes = np.array([head + s for s in range(1, 258)], np.uint64)
        assert abs((10 ** ppm.log_probabilities(codes, levels)).sum() - 1) < 1e-4


def test_scores_and_base(docs_of):
    rng = random.Random(3)
    words = ["The", "the", "THE", "fox", "é", "É", "x\x85y", "a b", " ", "zz"]
    texts = [None, "", " \t\r\n", "x" * 9000]
    texts += [rng.choice([" ", "\n", "\x0b", "  "]).join(rng.choice(words) + rng.choice(["", "", str(rng.randint(0, 50))]) for _ in range(rng.randint(1, 60))) for _ in range(90)]
    rows = list(enumerate(texts)) + [(None, "the fox"), (7, texts[7]), (7, "the the")]
    found = ppm.score(docs_of(rows), word_share=0.02).collect()
    out = [zlib.crc32(str(d).encode()) % 10 == 0 if d is not None else True for d, _ in rows]
    tokens = [(t or "").encode().lower().split() for _, t in rows]
    c = Counter(w for own, o in zip(tokens, out) if not o for w in own)
    n_ends = sum(not o for o in out)
    n, v = sum(c.values()) + n_ends, len(c) + 1
    value = lambda k: math.log10((k + 0.1) / (n + 0.1 * (v + 1)))
    counts = trie([(t or "").encode() for (_, t), o in zip(rows, out) if not o])
    expected = []
    for (d, t), own, o in zip(rows, tokens, out):
        data = (t or "").encode()
        symbols = [0] * ppm.ORDER + [b + 1 for b in data] + [ppm.END]
        ppm_score = sum(plain(symbols[i - ppm.ORDER : i], symbols[i], counts, 1) for i in range(ppm.ORDER, len(symbols)))
        expected.append((-1 if d is None else d, o, len(own) + 1, sum(c[w] > 0 for w in own) + 1, n, value(n_ends) + sum(value(c[w]) for w in own), ppm_score))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found)
    assert len(got) == len(rows)
    for a, b in zip(got, sorted(expected)):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-6) and a[6] == pytest.approx(b[6], rel=1e-4)


def test_without_training_texts(docs_of):
    found = ppm.score(docs_of([(None, "ab"), (None, None)])).collect()
    assert sorted(round(r.score, 6) for r in found) == sorted(round(-k * math.log10(257), 6) for k in (3, 1))
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 for r in found)
    assert ppm.score(docs_of([])).count() == 0


def test_codes_turn_back():
    codes = np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64)
    assert (ppm.straight(ppm.rotated(codes)) == codes).all()


def test_codes_are_told_apart_by_sorting():
    codes = np.random.default_rng(2).integers(0, 50, 1000, dtype=np.uint64)
    for some in (codes, codes[:1], codes[:0]):
        values, at = np.unique(some, return_inverse=True)
        assert ppm.deduped(some).tolist() == values.tolist()
        assert [x.tolist() for x in ppm.placed(some)] == [values.tolist(), at.tolist()]
        assert (ppm.of_planes(ppm.planes(some), "<u8") == some).all()


def test_no_count_is_cut_above_a_million_symbols(docs_of, monkeypatch):
    """Continuations seen once count as well where a millionth of all symbols is more than one; in many buckets and chunks."""
    monkeypatch.setattr(ppm, "BUCKET_BYTES", 40_000)
    monkeypatch.setattr(ppm, "CHUNK_BYTES", 100_000)
    rng = random.Random(5)
    texts = ["ab" * 60_000] * 20 + ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(40)]
    rows = [(d, t) for d, t in enumerate(texts)]
    out = [zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    assert sum(len(t) + 1 for (_, t), o in zip(rows, out) if not o) > 1_000_001
    counts, long = trie([t.encode() for (_, t), o in zip(rows, out) if not o and len(t) < 100]), trie([texts[0].encode()])
    n_long = sum(not o for o in out[:20])
    for context, kids in long.items():
        for s, c in kids.items():
            counts[context][s] += c * n_long
    found = {r.doc_id: r.score for r in ppm.score(docs_of(rows)).collect()}
    assert len(found) == len(rows)
    for d, t in rows[20:]:
        symbols = [0] * ppm.ORDER + [b + 1 for b in t.encode()] + [ppm.END]
        expected = sum(plain(symbols[i - ppm.ORDER : i], symbols[i], counts, 1) for i in range(ppm.ORDER, len(symbols)))
        assert found[d] == pytest.approx(expected, rel=1e-4)


def test_a_chunk_asks_once_and_leaves_no_texts(docs_of, spark, monkeypatch):
    """Texts of 6 MB in one task ask for their distinct codes once; texts, codes and words that were sent are not kept."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(1_500)) for _ in range(600)]
    docs, n_bytes = docs_of(list(enumerate(texts))).coalesce(1), sum(map(len, texts))
    seen, make = [], ppm._sent

    def sent(rows, n):
        table = make(rows, n)
        asked = table.where(f"kind = {ppm.CODES}").selectExpr("count(*)", "sum(octet_length(payload))").first()
        seen.append((n, *asked))
        return table

    def stored():
        return sum(p.stat().st_size for p in Path(table_folder(spark)).rglob("*.parquet"))

    monkeypatch.setattr(ppm, "_sent", sent)
    before = stored()
    found = ppm.score(docs)
    (n, rows, size), codes = seen[0], len({t[i : i + 7] for t in texts for i in range(len(t) - 6)})
    assert n_bytes > 6_000_000 and rows <= n and size < 8 * codes
    assert stored() - before < n_bytes / 20
    assert found.count() == len(texts)


def test_runs_are_merged_without_copies_of_them_all(monkeypatch):
    """The memory that stopped the check tool: all runs were copied, sorted and counted at once."""
    rng = np.random.default_rng(7)
    runs = [ppm.deduped(rng.integers(0, 3_000_000, n, dtype=np.uint64)) for n in (900_000, 300_000, 300_000, 0, 1)]
    counts = [rng.integers(0, 9, len(run), dtype=np.uint32) for run in runs]
    expected = ppm.summed(runs, counts)
    for at_once in (200_000, 7_000):
        monkeypatch.setattr(ppm, "MERGED_CODES", at_once)
        tracemalloc.start()
        codes, times = ppm.merged(runs, counts)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert (codes == expected[0]).all() and (times == expected[1]).all() and times.dtype == np.uint32
        assert most < (2.2 if at_once < 10_000 else 3) * (codes.nbytes + times.nbytes)


def test_counted_and_looked_up():
    rng = np.random.default_rng(8)
    for n in (0, 1, 5_000):
        codes, out = ppm.rotated(rng.integers(0, 900, n, dtype=np.uint64) << np.uint64(53)), rng.random(n) < 0.3
        found, times = ppm.counted(codes, out)
        assert found.tolist() == sorted(set(codes.tolist()))
        assert times.tolist() == [int(((codes == c) & ~out).sum()) for c in found]
        keys = ppm.mix(codes)
        keys[: n // 2] = keys[: n // 2] & np.uint64(2**11 - 1)  # alike in their high bits
        asked = np.unique(keys)
        logs = rng.random(len(asked)).astype(np.float32)
        value = dict(zip(asked.tolist(), logs.tolist()))
        assert ppm.looked_up(keys, asked, logs).tolist() == [value[k] for k in keys.tolist()]


def test_words_end_at_blanks_and_texts():
    texts = ["", "a", "B c", " \t\r\n\x0b\x0c", "É\x85x\xa0y \x1cZ\x1fq", "", " End", "x\x00Y", "end "]
    for own in (texts, texts[:1], [], ["", " "]):
        column = pa.array(["skip", *own])[1:]
        found, offsets = ppm.words_of(bytes_of(column), offsets_of(column))
        words = found.dictionary.take(found.indices).to_pylist()
        assert [words[a:b] for a, b in zip(offsets[:-1], offsets[1:])] == [t.encode().lower().split() for t in own]
