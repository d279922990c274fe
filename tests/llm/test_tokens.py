"""BPE against the tokenizers library, packing by its own rules."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ringscope.llm import bpe, packing

TEXTS = [
    None, "", " ", "  a  b \n c", "Hello, it's a TEST's test'LL  done", "<|endoftext|>", "a<|startoftext|>b<|endoftext|> c", "aaaa aaa aaaaaa", "Été İΣ ΣαΣ 中文 \U0001f600\U0001f600",
    "x\n\n y \t z  ", "1234567 12,5 ²Ⅷ", "\x00\x1f\x7f \u0085  ", "don't 'tis ''s", "word " * 5000,
]


def fuzz(n=150):
    rng = random.Random(9)
    alphabet = ["a", "b", "E", "'", "s", " ", " ", "\n", "1", "!", "é", "́", "Σ", "中", "\U0001f600", " ", "<|endoftext|>"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, piece int")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encode_decode(spark, name):
    texts = TEXTS + fuzz()
    t = Tokenizer.from_file(public_tokenizers.path(name))
    rows = {r.doc_id: r for r in bpe.encode_decode(frame(spark, texts), bpe.vocabulary_file(None, name), with_ids=True).collect()}
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert rows[i].ids == ids and rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        if name.startswith("word"):
            assert rows[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_memory_bound(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 3)
    v = bpe.Vocabulary(bpe.vocabulary_file(None, "byte_bpe_50k.json"))
    m = bpe.WordMemory(v, lambda ids, bounds: [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], b"".join)
    for text in ("a b c d e", "f a g", "h b"):
        units = v.units(text)
        m.learn([text])
        assert all(u in m.known for u in units)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_random_mixtures(name):
    """White space, signs, letters, newer letters and special tokens, against the library."""
    v, t = bpe.Vocabulary(bpe.vocabulary_file(None, name)), Tokenizer.from_file(public_tokenizers.path(name))
    parts = ["a", "The", "'s", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "\u3000", "é", "e\u0301", "漢", "12", "²", "#", "$$", "...", "<|endoftext|>", "<|", "\0", "_", "Σ", "😀"]
    parts += [chr(c) for c in (0x1C89, 0xA7CB, 0xA7DC, 0xA7CE, 0x10D50, 0x10D65, 0x16D40, 0x10D40, 0x16EA0, 0x13460)]
    rng = random.Random(7)
    for _ in range(1500):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        words = [w for u in v.units(text) for w in v.words(u)]
        ids = [i for w in words for i in ([v.special[w]] if w in v.special else v.encode_words([w])[0].tolist())]
        assert ids == t.encode(text, add_special_tokens=False).ids, text


def test_pieces_and_packing(spark):
    rng = random.Random(3)
    texts = [*TEXTS, *[" ".join(rng.choice(["alpha", "beta", "x1"]) for _ in range(rng.randint(1, 4000))) for _ in range(60)]]
    source = bpe.vocabulary_file(None, "byte_bpe_50k.json")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(frame(spark, texts), source, block=20).collect()
    want = set()
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = sorted({0, *range(len(ids), 0, -1024)})
        want |= {(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(bins) <= -(-sum(r.length for r in rows) // 1024) + 4
    assert packing.pack_documents(frame(spark, []), source).count() == 0


def test_crossover_keeps_every_item():
    rng = random.Random(1)
    lengths = [rng.randint(1, 1023) for _ in range(300)]
    made = []
    for _ in range(2):
        p = packing.Packing(lengths, 1024)
        order = list(range(300))
        rng.shuffle(order)
        p.put(order)
        made.append(p)
    child = packing.crossover(*made, rng)
    mutant = packing.mutate(child, rng)
    for p in (child, mutant):
        assert sorted(i for b in p.bins for i in b) == list(range(300))
        assert all(sum(lengths[i] for i in b) == f <= 1024 for b, f in zip(p.bins, p.fill, strict=True))
    best = packing.evolve(lengths, 1024, 0, [])
    assert best.max() + 1 <= min(len(p.bins) for p in made)


def test_search_beats_best_fit_on_triples():
    """Lengths of which three fill a sequence exactly: crossover and migration save some."""
    import random

    from ringscope.llm import packing

    rng, lengths = random.Random(1), []
    for _ in range(40):
        a = rng.randint(380, 490)
        b = rng.randint(250, (1000 - a) // 2)
        lengths += [a, b, 1000 - a - b]
    plain = packing.Packing(lengths, 1000)
    plain.put(sorted(range(120), key=lambda i: -lengths[i]))
    first = packing.evolve(lengths, 1000, 5, [], generations=10)
    after = packing.evolve(lengths, 1000, 6, [first, packing.evolve(lengths, 1000, 7, [], generations=10)], generations=20)
    filled = [0] * (int(after.max()) + 1)
    for length, b in zip(lengths, after, strict=True):
        filled[b] += length
    assert sum(filled) == sum(lengths) and max(filled) <= 1000
    assert 40 <= len(filled) <= first.max() + 1 < len(plain.bins)
