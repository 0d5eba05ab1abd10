"""Token counts and BPE beside the library."""

from __future__ import annotations

import random
from hashlib import sha256

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lettermill.llm import bpe, tokencount
from tests.llm.helpers import AWKWARD, LONG, awkward

ALPHABET = ["<|startoftext|>", "<|endoftext|>", "'s", "'LL", " ", "\n", " ", "İ", "ß", "Σ", "ΑΣ", "é", "漢字", "😀", "‍", "Å", "\x00", "\x1c", "\x85", "Ⅷ", "½", "ǅ", "ﬁ", "٣", "a", "B", "zz", "9", "!", "...", "ẞ"]


@pytest.fixture(scope="module")
def byte_level():
    return tokencount.load_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def own():
    return bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))


def _random_texts(n, seed):
    draw = random.Random(seed)
    letters = ALPHABET + [chr(draw.randrange(0x20, 0x2FFF)) for _ in range(200)]
    return ["".join(draw.choice(letters) for _ in range(draw.randrange(0, 40))) for _ in range(n)]


def test_bpe_ids_and_decoding_equal_the_library(own, library):
    for text in [*_random_texts(3000, 1), *[t or "" for _, t, _, _ in AWKWARD]]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.joined(text)[1] == own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_merge_skips_stale_entries_and_long_words(own, library):
    for word in ("a" * 3000, "ababab" * 300, "thethethe", "x"):
        assert own.merge(word) == library.encode(word, add_special_tokens=False).ids


def test_kept_words_are_bounded(own, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 5)
    own.joined(" ".join(f"w{i}" for i in range(50)))
    assert len(own.kept) <= 6


def test_chunked_counts_equal_whole_counts(byte_level):
    whole = lambda t: len(byte_level.encode(t, add_special_tokens=False).ids)
    for text in _random_texts(1000, 2):
        for chunk, overlap in ((8, 2), (16, 4), (40, 1)):
            assert tokencount.count_chunked(byte_level, text * 3, chunk, overlap) == whole(text * 3)
    assert tokencount.count_chunked(byte_level, LONG, 1000, 16) == whole(LONG)


def test_overlap_widens_where_no_boundary_is_stable(byte_level):
    for text in ("a" * 5000, " " * 5000, "a" * 3000 + " b" * 3000 + "é" * 3000, "x'll" * 900):
        assert tokencount.count_chunked(byte_level, text, 256, 8) == len(byte_level.encode(text).ids)


def test_stable_boundaries():
    assert tokencount.stable("ab cd", 2) and not tokencount.stable("ab cd", 3)
    assert not tokencount.stable("a", 0) and not tokencount.stable("a ", 2)


def test_queries_on_awkward_rows(spark, byte_level, library):
    counted = tokencount.token_counts(awkward(spark), chunk=2000).collect()
    assert len(counted) == len(AWKWARD)
    expected = sorted((d or -1, len((t or "").encode()), len(byte_level.encode(t or "").ids)) for d, t, _, _ in AWKWARD)
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in counted) == expected
    assert all(r.over_limit == (r.n_tokens > 1024) for r in counted)
    encoded = bpe.encoded(awkward(spark)).collect()
    want = []
    for d, t, _, _ in AWKWARD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d or -1, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert [r.ids for r in encoded if r.doc_id == d and r.n_tokens == len(ids)][0] == ids
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encoded) == sorted(want)
    empty = awkward(spark).limit(0)
    assert tokencount.token_counts(empty).count() == bpe.encoded(empty).count() == 0
