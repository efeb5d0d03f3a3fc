import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm import _text as T
from seqloom.llm.token_store import PieceEncoder


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\x0b.\x1c　", max_size=12)), max_size=8), st.integers(1, 30))
@settings(max_examples=150, deadline=None)
def test_words_and_hashes(texts, block):
    got, hashes = [], {}
    for w in T.word_blocks(pa.array(texts, pa.string()), lower=False, block=block):
        h = w.hashes()
        for i in range(w.n):
            a, b = w.bounds[i], w.bounds[i + 1]
            got.append([w.buf[s:e].tobytes() for s, e in zip(w.start[a:b], w.end[a:b])])
            for k, word in zip(h[a:b], got[-1]):
                assert hashes.setdefault(word, k) == k
    assert got == [words_of(t) for t in texts]
    assert len(set(hashes.values())) == len(hashes)


def test_lower_is_ascii_only():
    (w,) = T.word_blocks(pa.array(["AÉz"]))
    assert w.buf.tobytes().decode() == "aÉz"


@pytest.mark.parametrize("k", [1, 3, 5])
def test_shingles(k):
    texts = ["", None, "a", "a b", "a b c d e f", "b c d", "a b c d e f"]
    sets = []
    for w in T.word_blocks(pa.array(texts, pa.string())):
        h, bounds = T.shingles(w, k)
        sets += [tuple(h[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
    assert [len(s) for s in sets] == [0, 0, 1, 2 if k == 1 else 1, 6 - k + 1, 3 - k + 1 if k <= 3 else 1, 6 - k + 1]
    assert sets[4] == sets[6] and sets[2] != sets[3]


def test_sliced_and_large_columns():
    col = pa.array(["x y", "", "z"], pa.large_string()).slice(1)
    assert [w.counts.tolist() for w in T.word_blocks(col)] == [[0, 1]]


@pytest.fixture(scope="module")
def encoders():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    return plain, PieceEncoder("byte_bpe_50k.json", remember=50)


def test_pieces_give_the_library_ids(encoders):
    plain, own = encoders
    r = random.Random(3)
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "B", "é", "word", "The", "'s", "'", ".", "!!", "***", "12", "3.5", " ", "　", "中", "_", "😀", "\x1c", "…", "don't", "\r\n", " x", " ,", "<|endoftext|>"]
    for _ in range(400):
        texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(r.randint(0, 6))]
        for i, n, buf, offsets in T.byte_blocks(pa.array(texts, pa.string()), 40):
            ids, bounds = own.encode(buf, offsets, 0)
            for j in range(n):
                assert ids[bounds[j] : bounds[j + 1]].tolist() == [*plain.encode(texts[i + j], add_special_tokens=False).ids, 0]


def test_literals_of_added_tokens_give_the_library_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    from seqloom.llm.token_store import encoder

    plain, own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), encoder("byte_bpe_50k.json")
    assert plain.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    r = random.Random(5)
    parts = [" ", "  ", "\n", "a", " word", "The", "'s", ".", " ,", "12", "é", "\u3000", "<|", "endoftext", "|>", "<|endo", "ftext|>", "<|endoftext|>", " <|endoftext|>", "<|endoftext|> "]
    for _ in range(400):
        texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(r.randint(0, 6))]
        for i, n, buf, offsets in T.byte_blocks(pa.array(texts, pa.string()), 40):
            ids, bounds = own.encode(buf, offsets, 0)
            for j in range(n):
                assert ids[bounds[j] : bounds[j + 1]].tolist() == [*plain.encode(texts[i + j], add_special_tokens=False).ids, 0]


def test_mix_is_a_bijection_on_samples():
    x = np.arange(100_000, dtype=np.uint64)
    assert len(np.unique(T.mix64(x))) == len(x)


def test_long_texts_have_the_hashes_of_short_ones():
    words = [f"w{i % 5000}" for i in range(400_000)]
    (long,) = T.word_blocks(pa.array([" ".join(words)]))
    (short,) = T.word_blocks(pa.array([" ".join(words[:5000])]))
    assert len(long.buf) > 4 * T.BLOCK
    assert (long.hashes() == np.tile(short.hashes(), 80)).all()


def thue_morse(n):
    x = "a"
    for _ in range(n):
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_hashes_tell_regular_words_apart():
    for n in (5, 6, 8, 10, 11, 12, 14):
        for second in (False, True):
            buf = np.frombuffer("".join(thue_morse(n)).encode(), np.uint8)
            h = T.span_hashes(buf, np.array([0, len(buf) // 2]), np.array([len(buf) // 2, len(buf)]), second)
            assert h[0] != h[1]


@given(st.lists(st.text(alphabet="ab", min_size=0, max_size=90), max_size=30))
@settings(max_examples=100, deadline=None)
def test_both_hashes_are_of_the_bytes(texts):
    data = "".join(texts).encode()
    ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
    starts = ends - np.array([len(t) for t in texts], np.int64)
    one, two = (T.span_hashes(np.frombuffer(data, np.uint8), starts, ends, second=k) for k in (False, True))
    for h in (one, two):
        assert len(set(h.tolist())) == len(set(texts)) and len(set(zip(h.tolist(), texts))) == len(set(texts))
    assert not set(one.tolist()) & set(two.tolist())


def test_long_spans_have_one_hash_in_any_buffer():
    r = np.random.default_rng(3)
    word = r.integers(97, 120, T.BLOCK * 2 + 13).astype(np.uint8)
    whole = T.span_hashes(word, np.array([0]), np.array([len(word)]))
    moved = T.span_hashes(np.concatenate([word[:5], word, word[:3]]), np.array([5]), np.array([5 + len(word)]))
    other = word.copy()
    other[T.BLOCK + 100] ^= 1
    assert whole[0] == moved[0] != T.span_hashes(other, np.array([0]), np.array([len(word)]))[0]


def test_pieces_that_share_a_hash_are_told_apart(encoders, monkeypatch):
    from seqloom.llm import token_store

    plain, _ = encoders
    real = T.span_hashes
    monkeypatch.setattr(token_store, "span_hashes", lambda buf, start, end, second=False: real(buf, start, end, second) if second else real(buf, start, end) % np.uint64(7))
    own = PieceEncoder("byte_bpe_50k.json", remember=40)
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["a longer piece of one word " * 3, "x" * 40, "y" * 40, *thue_morse(10)]
    for _ in range(40):
        texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 40))) for _ in range(3)]
        for i, n, buf, offsets in T.byte_blocks(pa.array(texts, pa.string())):
            ids, bounds = own.encode(buf, offsets, 0)
            for j in range(n):
                assert ids[bounds[j] : bounds[j + 1]].tolist() == [*plain.encode(texts[i + j], add_special_tokens=False).ids, 0]
