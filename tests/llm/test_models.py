"""Language and quality: held-out accuracy and awkward rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lettermill.llm import langid, quality
from tests.llm.helpers import AWKWARD, awkward

SYLLABLES = {"xx": "ka lo mi ru ta pen".split(), "yy": "sch ung ein ver ßer tz".split(), "zz": "ção ñe eau oi ré".split()}


def _prose(language, n, seed):
    draw = random.Random(f"{language}{seed}")
    return " ".join("".join(draw.choices(SYLLABLES[language], k=draw.randint(1, 4))) for _ in range(n)).capitalize() + "."


def _junk(language, n, seed):
    draw = random.Random(seed)
    return " ".join(w + draw.choice(["***", "$$$", "%%%"]) for w in _prose(language, n, seed).split())


def _held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_languages_on_held_out_rows(spark):
    rows = [(i, _prose(("xx", "yy", "zz")[i % 3], 5 + i % 40, i), ("xx", "yy", "zz")[i % 3]) for i in range(450)]
    found = langid.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(found) == 450
    truth = {i: lang for i, _, lang in rows}
    assert all(r.held_out == _held(r.doc_id) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert np.mean([r.rejected for r in held]) < 0.1


def test_far_texts_are_rejected_but_have_a_nearest(spark):
    model = langid.fit([(lang, _prose(lang, 60, i)) for lang in SYLLABLES for i in range(40)])
    docs = spark.createDataFrame([(1, "qjxw vbzk qqq wwjj " * 20), (2, _prose("xx", 50, 99))], "doc_id long, text string")
    found = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert found[1].language == "und" and found[1].nearest in SYLLABLES
    assert found[2].language == found[2].nearest == "xx"


def test_counts_do_not_depend_on_parts(monkeypatch):
    letters = langid.letters_table()
    text = "Ünï çödé TEXT, with 12 gaps — and é!  " * 9
    whole = langid.n_gram_counts(text, letters)
    monkeypatch.setattr(langid, "PART", 7)
    assert (langid.n_gram_counts(text, letters) == whole).all()
    assert langid.n_gram_counts("12 !?", letters) is None and langid.n_gram_counts("", letters) is None


def test_awkward_languages(spark):
    found = langid.languages(awkward(spark)).collect()
    assert len(found) == len(AWKWARD)
    assert all(r.lang_pred == "und" and r.score == 0 for r in found if r.doc_id in (2, 3, 4, 8))
    assert all(r.lang_pred in ("en", "de", "fr", "es") for r in found if r.doc_id in (1, 5, 7, 9, 10))
    assert langid.languages(awkward(spark).limit(0)).count() == 0
    unlabelled = langid.languages(awkward(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = [], []
    for i in range(600):
        language, good = ("xx", "yy", "zz")[i % 3], i % 4 != 0
        rows.append((i, (_prose if good else _junk)(language, 20 + i % 60, i)))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_on_held_out_rows(labelled):
    docs, labels = labelled
    found = quality.quality_scores(docs, labels).collect()
    assert len(found) == 600 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    held = [r for r in found if r.held_out]
    assert all(r.held_out == _held(r.doc_id) for r in found)
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) > 0.97
    assert abs(np.mean([r.score for r in held]) - 0.75) < 0.08


def test_keep_good_keeps_clean_rows_and_columns(labelled):
    docs, labels = labelled
    more = docs.withColumns({"score": F.lit("x"), "score_": F.lit(None)})
    kept = quality.keep_good(more, labels)
    assert kept.columns == more.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert len([i for i in range(600) if i % 4 and i in ids]) > 0.98 * 450
    assert len([i for i in range(600) if i % 4 == 0 and i in ids]) < 0.05 * 150


def test_awkward_quality(spark, labelled):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, None), (7, 2), (9, 1)], "doc_id long, quality int")
    found = quality.quality_scores(awkward(spark), labels).collect()
    assert len(found) == len(AWKWARD) and len({r.score for r in found}) == 1
    model = quality.fit_quality(*labelled)
    scored = quality.with_scores(awkward(spark).drop("score"), model).collect()
    assert all(r.score == model.share for r in scored if r.text in (None, ""))
    assert len({r.score for r in scored if r.doc_id in (1, 9)}) == 1
    assert quality.quality_scores(awkward(spark).limit(0), labels).count() == 0
    assert {r.score for r in quality.quality_scores(awkward(spark), labels.limit(0)).collect()} == {0.5}


def test_labels_of_any_number_share_the_sample(spark):
    """More labels than rows of the sample: the commonest have one each; all labels have some where there is room."""
    from lettermill.llm.common import labelled_sample

    rows = [(i, f"text {i}", f"l{i % 1500}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    sample, counts = labelled_sample(docs, docs.select("doc_id", "lang"), "lang", 5, 100)
    assert len(counts) == len({l for l, _ in sample}) > 1400
    again, _ = labelled_sample(docs.repartition(7), docs.select("doc_id", "lang"), "lang", 5, 100)
    assert sample == again
    few, counts = labelled_sample(docs, docs.select("doc_id", "lang"), "lang", 5, 100, total=40)
    assert len(counts) == 40 and len(few) <= 40
    many, _ = labelled_sample(docs, docs.select("doc_id", "lang"), "lang", 5, 100, total=3000)
    assert max(sum(l == k for l, _ in many) for k in counts) <= 2


def test_cosines_equal_a_plain_version(spark):
    """Nearest centroid and cosine of each text, from dictionaries of n-grams instead of hashed arrays."""
    import math
    import re

    rows = [(i, l, t) for i, (l, t) in enumerate(_language_rows())]
    model = langid.fit([(l, t) for _, l, t in rows[::2]])
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    letters = langid.letters_table()

    def slow(text):
        plain = " " + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower())).strip() + " "
        counts = {}
        for n in (1, 2, 3):
            for k in range(len(plain) - n + 1):
                counts[plain[k : k + n]] = counts.get(plain[k : k + n], 0) + 1
        return counts

    def bucket(gram):  # an n-gram's place: that of the text that adds it
        h = (ord(gram[0]) * 0x9E3779B1) & 0xFFFFFFFF
        for c in gram[1:]:
            h = (((h ^ (h >> 15)) * 0x85EBCA77) + ord(c) * 0xC2B2AE3D) & 0xFFFFFFFF
        return h >> (32 - langid.DIMENSIONS.bit_length() + 1)

    found = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    for i, _, text in rows:
        vector = [0.0] * langid.DIMENSIONS
        for gram, n in slow(text).items():
            if gram != "  " and (len(gram) == 1 or gram != " " * len(gram)):
                vector[bucket(gram)] += n
        vector[bucket(" ")] -= 1  # the space before the text begins no n-gram of one
        mine = langid.n_gram_counts(text, letters)
        assert np.allclose(mine, vector)
        weights = [math.sqrt(v) * w for v, w in zip(vector, model.idf)]
        norm = math.sqrt(sum(w * w for w in weights))
        cosines = [sum(a * b for a, b in zip(weights, c)) / norm for c in model.centroids.tolist()]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert found[i].nearest == model.languages[model.language_of[best]]
        assert abs(found[i].score - cosines[best]) < 1e-5


def _language_rows():
    draw = np.random.default_rng(12)
    parts = {"aa": "ka lo mi ta", "bb": "sch ei ung ver", "cc": "ção lh nho é"}
    for language, syllables in parts.items():
        own = syllables.split()
        for _ in range(10):
            yield language, " ".join("".join(own[k] for k in draw.integers(0, len(own), 3)) for _ in range(12)) + ", 3!"
