"""Locally consistent parsing."""

from __future__ import annotations

import random
from hashlib import sha256

import numpy as np

from lettermill.llm import fingerprint as fp
from tests.llm.helpers import AWKWARD, awkward


def _text(n, seed, letters="abcdefgh "):
    draw = random.Random(seed)
    return "".join(draw.choice(letters) for _ in range(n))


def _names(text, level):
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return next((set(names.tolist()) for at, names, _, _ in fp.parse(codes, np.zeros(len(codes), int)) if at == level), set())


def test_equal_substrings_share_interior_phrases_at_any_offset():
    common = _text(600, 1)
    inside = _names(common, 2)
    for offset in (1, 2, 3, 7, 50):
        shifted = _names(_text(offset, offset, "xyz") + common + _text(40, 9, "pqr"), 2)
        assert len(inside & shifted) > 0.9 * len(inside)


def test_phrases_have_two_symbols_at_least_and_few_at_most():
    for text, repeats in ((_text(500, 3), False), (_text(900, 4, "ab"), True), ("ab" * 300, True), ("abc" * 100, True), ("a" * 50, True)):
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        before = None
        for _, names, _, _ in fp.parse(codes, np.zeros(len(codes), int)):
            if before and before > 8:
                assert len(names) <= before / 2 + 1
                # A text that repeats itself becomes one run.
                assert repeats or len(names) >= before / 4
            before = len(names)
        assert before == 1


def test_colours_differ_between_neighbours():
    draw = np.random.default_rng(4)
    symbols = draw.integers(0, 2**64, 3000, dtype=np.uint64)
    label = fp.colours(symbols, np.array([0, 1000, 1001, 2500]))
    assert label.max() <= 2
    same = np.flatnonzero(label[1:] == label[:-1]) + 1
    assert set(same.tolist()) <= {1000, 1001, 2500}


def test_a_text_has_the_same_sketch_in_any_batch():
    texts = [_text(n, n) for n in (0, 1, 2, 3, 5, 40, 900)] + ["aaaa", "", "\U0001f600é"]
    together = fp.sketches(texts)
    for text, sketch in zip(texts, together):
        assert (fp.sketches([text])[0] == sketch).all()


def test_likeness_follows_what_is_shared():
    base = _text(3000, 5)
    quarter = base[:2250] + _text(750, 6)
    half = base[:1500] + _text(1500, 7)
    a, b, c, d = fp.sketches([base, quarter, half, _text(3000, 8)])
    assert fp.likeness(a, a) == 1
    assert 1 > fp.likeness(a, b) > fp.likeness(a, c) > fp.likeness(a, d) + 0.1
    assert fp.likeness(a, a[:0]) == 0 and fp.likeness(a[:0], a[:0]) == 1


def _expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    texts = [t or "" for _, t, *_ in order]
    for i, (doc_id, *_) in enumerate(order):
        changed = fp.edited(texts[i], texts[(i + 1) % len(texts)])
        yield doc_id, len(texts[i]), sha256(changed.encode()).hexdigest(), fp.written(fp.sketches([texts[i]])[0])


def test_rows_meet_the_next_document(spark):
    for buckets in (1, 4):
        found = fp.fingerprints(awkward(spark), buckets).collect()
        mine = sorted((r.doc_id or -1, r.n_chars, r.edited_sha256, r.fingerprint) for r in found)
        assert mine == sorted((d or -1, *rest) for d, *rest in _expected(AWKWARD))
    many = [(i * 3, _text(20 + i % 50, i)) for i in range(400)]
    found = fp.fingerprints(spark.createDataFrame(many, "doc_id long, text string"), 16).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint) for r in found) == sorted(_expected(many))
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    assert fp.fingerprints(awkward(spark).limit(0)).count() == 0
