import zlib

import numpy as np
import pyarrow as pa
import pytest

from rowdelta.llm import language_id as li

PARTS = {
    "aa": ["ka", "lo", "mi", "nu", "pe"],
    "bb": ["ßtr", "schö", "über", "ein", "gel"],
    "cc": ["ção", "ão", "lhe", "nho", "que"],
    "дд": ["при", "вет", "мир", "сло", "во"],
}


def rows(n=600, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for d in range(n):
        lang = list(PARTS)[d % 4]
        words = ["".join(rng.choice(PARTS[lang], rng.integers(1, 4))) for _ in range(int(rng.integers(3, 30)))]
        out.append((d, " ".join(words).capitalize(), lang))
    return out


@pytest.fixture(scope="module")
def predicted(spark):
    data = rows() + [(9001, None, "aa"), (9002, "", "bb"), (9003, "12 + 34 ?! \n", "cc"), (None, "ka lo mi", None), (9004, "schögel " * 20_000, "bb"), (9005, "😀😀 миртslovo", None)]
    data += data[:3]
    docs = spark.createDataFrame([(d, t, lang, "src", 0.5, False) for d, t, lang in data], "doc_id long, text string, lang string, source string, score double, held_out boolean")
    return data, li.identify(docs, sample=200).collect()


def test_held_out_accuracy_and_calibration(predicted):
    data, out = predicted
    held = [r for r in out if r["held_out"] and r["text"] and r["lang"] and r["lang_pred"] != "und"]
    assert len(held) > 80 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(0.25 <= r["score"] <= 1 for r in held)
    assert np.mean([r["score"] for r in held]) > 0.9


def test_rules(predicted):
    data, out = predicted
    assert len(out) == len(data) and all(r["source"] == "src" for r in out)
    for r in out:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert (r["lang_pred"] == "und") == (r["text"] is None or not any(c.isalpha() for c in r["text"]))
        assert r["lang_pred"] in PARTS or (r["lang_pred"], r["score"]) == ("und", 0.0)
    by_id = {r["doc_id"]: r["lang_pred"] for r in out}
    assert by_id[None] == "aa" and by_id[9004] == "bb"


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert li.identify(none).count() == 0
    r = li.identify(spark.createDataFrame([(1, "abc", None)], none.schema)).first()
    assert (r["lang_pred"], r["score"]) == ("und", 0.0)


def test_labels_of_held_out_rows_are_not_seen(spark):
    data = rows(200)
    wrong = [(d, t, "xx" if zlib.crc32(str(d).encode()) % 5 == 0 else lang) for d, t, lang in data]
    a, b = (li.identify(spark.createDataFrame(x, "doc_id long, text string, lang string")).select("doc_id", "lang_pred", "score") for x in (data, wrong))
    assert sorted(a.collect()) == sorted(b.collect())


def test_code_points_and_ngrams():
    texts = ["aÉ\t😀", None, "", "Straße Ω ﬀ"]
    cp, begin = li.code_points(pa.array(texts))
    for i, t in enumerate(texts):
        want = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in (t or "").replace("\t", " ")]
        assert cp[begin[i] : begin[i + 1]].tolist() == want
    assert len(li.ngrams(cp[:4], 3)) == 2 and len(li.ngrams(cp[:1], 3)) == 0
    assert (li.ngrams(cp[1:4], 2) == li.ngrams(cp[:4], 2)[1:]).all()


def test_logits_are_means_of_ngram_weights(spark):
    """One pass over a batch gives what each text alone gives."""
    data = rows(120, seed=3)
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    langs, w, bias, t = li.fit(docs, sample=80)
    assert langs == sorted(PARTS) and 0.04 < t < 21 and (w == 0).mean() > 0.5  # L1 leaves most weights at zero
    cp, _ = li.code_points(pa.array([data[0][1]]))
    h = np.concatenate([li.ngrams(cp, o) for o in li.ORDERS])
    p = li.softmax((w[h].astype(float).mean(0) + bias) / t)
    assert langs[p.argmax()] == data[0][2]
    short = [(-1, "é", None), (-2, "ka", None), (-3, "kal", None), (-4, None, None), (-5, "ß" * 4000, None)]
    both = spark.createDataFrame([*data, *short], docs.schema)
    got = {r["doc_id"]: r for r in li.identify(both, sample=80).collect()}
    langs, w, bias, t = li.fit(both.where("doc_id >= 0 AND crc32(CAST(doc_id AS STRING)) % 5 <> 0"), sample=80)
    for d, text, _ in [*data, *short]:
        if text:
            cp, _ = li.code_points(pa.array([text]))
            h = np.concatenate([li.ngrams(cp, o) for o in li.ORDERS])
            p = li.softmax((w[h].astype(float).mean(0) + bias) / t)
            assert got[d]["lang_pred"] == langs[p.argmax()] and abs(got[d]["score"] - p.max()) < 1e-6


def test_columns_with_clashing_names(spark):
    names = ["_letter", "letter", "held", "held_out", "lang_pred", "score", "lift"]
    docs = spark.createDataFrame([(d, t, lang, *names) for d, t, lang in rows(60)], ", ".join(["doc_id long", "text string", "lang string", *(f"{n} string" for n in names)]))
    for r in li.identify(docs, sample=40).collect():
        assert (r["_letter"], r["letter"], r["held"]) == ("_letter", "letter", "held")
        assert r["lang_pred"] in PARTS and 0 < r["score"] <= 1 and abs(r["lift"] - 4 * r["score"]) < 1e-9


def test_rare_languages_are_learned(spark):
    """A language with few of very many labelled documents is in the sample, and its held-out texts are recognised."""
    data = [(d, t, lang) for d, t, lang in rows(1600) if lang != "cc" or d % 40 == 2]
    assert sum(lang == "cc" for _, _, lang in data) < 60
    out = li.identify(spark.createDataFrame(data + data[:50] * 3, "doc_id long, text string, lang string"), sample=80).where("held_out AND lang = 'cc'").collect()
    assert len(out) > 4 and all(r["lang_pred"] == "cc" for r in out)


def test_sample_is_bounded_by_features(spark):
    docs = spark.createDataFrame(rows(400), "doc_id long, text string, lang string")
    for sample, least, most in ((40, 1, 1 << 24), (4000, 20, 3000)):
        langs, w, _, _ = li.fit(docs, sample=sample, least=least, most_features=most)
        assert langs == sorted(PARTS) and np.isfinite(w).all()


def test_scorer_against_plain_python(spark):
    """From texts to probabilities by a scorer of its own: n-grams by the definition, weights from a dictionary."""
    docs = spark.createDataFrame(rows(200), "doc_id long, text string, lang string")
    langs, w, bias, t = li.fit(docs.where("crc32(CAST(doc_id AS STRING)) % 5 <> 0"), sample=80)
    for r in li.identify(docs, sample=80).where("doc_id < 40").collect():
        text = [c if len(c) == 1 else o for c, o in ((o.lower(), o) for o in r["text"])]
        z, n = [0.0] * len(langs), 0
        for order in (1, 2, 3):
            for i in range(len(text) - order + 1):
                h = order
                for c, f in zip(text[i : i + order], (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), strict=False):
                    h = (h + ord(c) + 1) * f % 2**64
                    h ^= h >> 29
                own = w[h * 0xD6E8FEB86659FD93 % 2**64 >> 49]
                z, n = [a + float(b) for a, b in zip(z, own, strict=True)], n + 1
        z = [(a / n + b) / t for a, b in zip(z, bias, strict=True)]
        e = [2.718281828459045 ** (a - max(z)) for a in z]
        assert r["lang_pred"] == langs[z.index(max(z))] and abs(r["score"] - max(e) / sum(e)) < 1e-5


def test_a_document_repeated_very_often_is_one(spark):
    """Copies of one document do not push the language's others, or the language itself, out of the sample."""
    data = [(d, t, lang) for d, t, lang in rows(600) if lang != "cc"]
    one = next((d, t, lang) for d, t, lang in rows(600) if lang == "cc" and zlib.crc32(str(d).encode()) % 5)
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").unionByName(spark.createDataFrame([one], "doc_id long, text string, lang string").crossJoin(spark.range(5001)).drop("id"))
    out = li.identify(docs, sample=80)
    assert {r[0] for r in out.select("lang_pred").distinct().collect()} == set(PARTS)
    assert out.where("lang = 'cc' and lang_pred = 'cc'").count() == 5001


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(li, "MOST_LANGUAGES", 3)
    with pytest.raises(ValueError, match="4 languages"):
        li.fit(spark.createDataFrame(rows(40), "doc_id long, text string, lang string"))
