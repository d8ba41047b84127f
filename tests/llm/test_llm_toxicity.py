from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from edge_rows import edge_documents, empty_documents

from riskweave.llm import toxicity

PLAIN = "the of and river stone walking under green light morning water table window garden letter".split()
BAD = ["moron", "idiot", "scumbag"]
DISGUISED = ["m0r0n", "1d10t", "i d i o t", "s.c.u.m.b.a.g", "mooooron", "sc*mbag", "m0r@n#", "1di0t!!"]


def sentence(rng, n=30):
    return [rng.choice(PLAIN) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    """800 labelled texts, a quarter of them with a plain bad word, and disguised ones without labels."""
    rng, rows, labels = random.Random(5), [], []
    for i in range(800):
        words = sentence(rng)
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((i, " ".join(words)))
        labels.append((i, 1 if i % 4 == 0 else 0))
    for j, bad in enumerate(DISGUISED):
        words = sentence(rng)
        words[10] = bad
        rows.append((10_000 + j, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_trigram_counts_cover_whole_texts(monkeypatch):
    texts = ["Ab", None, "", "é1 ж" * 50, "日本語 x", "ﬁ"]
    whole = dict(zip(*map(list, toxicity.trigram_counts(texts))))
    # by hand: two boundaries in front and one behind, letters and marks as code points
    want = Counter()
    for text in texts:
        low = toxicity.fold(text)
        points = [0, 0, *[ord(c) if toxicity.is_plain(c) else 0 for c in low], 0]
        if low:
            want.update(toxicity.packed(*points[i : i + 3]) for i in range(len(low) + 1))
    assert whole == dict(want)
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    assert dict(zip(*map(list, toxicity.trigram_counts(texts)))) == whole


def test_counts_of_the_whole_table(spark):
    docs = spark.createDataFrame([("some words",), ("тоже слова",), (None,), ("some words",)], "text string")
    got = {r.gram: r.n for r in toxicity.corpus_trigrams(docs).collect()}
    texts = [r.text for r in docs.collect()]
    assert got == dict(zip(*[x.tolist() for x in toxicity.trigram_counts(texts)]))
    few = toxicity.corpus_model(docs, rows=3)
    assert len(few.grams) == 3 and few.log(ord("q"), ord("q"), ord("q")) < 0


def test_language_model_is_a_distribution():
    model = toxicity.language_model(toxicity.trigram_counts(["some words of text", "тоже слова"] * 3))
    letters = [*model.letters, 1]  # 1 for all that the corpus does not have
    for a, b in [(0, 0), (ord("s"), ord("o")), (ord("q"), ord("z")), (0, ord("т")), (ord("о"), ord("в"))]:
        assert sum(np.exp(model.log(a, b, c)) for c in letters) == pytest.approx(1)


def test_decoding_restores_words():
    model = toxicity.language_model(toxicity.trigram_counts([" ".join(PLAIN + BAD)] * 20))
    restored = {d: toxicity.restore(d, model) for d in DISGUISED}
    assert restored["m0r0n"] == restored["mooooron"] == "moron"
    assert restored["1d10t"] == restored["i d i o t"] == restored["1di0t!!"] == "idiot"
    assert restored["s.c.u.m.b.a.g"] == restored["sc*mbag"] == "scumbag"
    assert toxicity.restore("walking under 173 water", model) == "walking under 173 water"
    assert toxicity.restore(None, model) == ""
    assert toxicity.tokens_of(toxicity.fold("Mо\u200bRON")) == ["moron"]


def test_decode_is_the_best_path():
    """Against trying all readings of a short token."""
    from itertools import product

    model = toxicity.language_model(toxicity.trigram_counts([" ".join(PLAIN + BAD)]))
    for token in ["m0r", "1d1", "a33b", "t+e", "0n"]:
        best = None
        for way in product(*toxicity._lattice(token, model)):
            text, score = "".join(t for t, _ in way) + " ", sum(c for _, c in way)
            a = b = 0
            for ch in text:
                c = 0 if ch == " " else ord(ch)
                if c or b:
                    score += model.log(a, b, c)
                    a, b = b, c
            if best is None or score > best[0]:
                best = (score, text)
        assert toxicity.decode(token, model).split() == best[1].split()


def test_held_out_accuracy_and_disguised_words(corpus):
    docs, labels = corpus
    rows = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    assert len(rows) == docs.count()
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in rows.values() if r.held_out and r.doc_id < 800]
    assert len(held) > 100
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in held)
    assert sum(rows[10_000 + j].predicted for j in range(len(DISGUISED))) >= len(DISGUISED) - 1


def test_labels_of_the_held_out_quarter_are_not_read(spark, corpus):
    docs, labels = corpus
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(labels.doc_id), 1 - labels.toxic).otherwise(labels.toxic))
    plain = sorted(map(tuple, toxicity.score_documents(docs, labels).collect()))
    assert sorted(map(tuple, toxicity.score_documents(docs, turned).collect())) == plain


def test_edge_rows(spark, corpus):
    labels = corpus[1]
    docs = edge_documents(spark)
    odd = labels.unionByName(spark.createDataFrame([(None, 1), (4, None), (5, 1), (5, 0)], labels.schema))
    scored = toxicity.score_documents(docs, odd)
    assert scored.count() == docs.count()
    assert scored.where("score is null or held_out is null").count() == 0
    kept = toxicity.keep_clean(docs, odd)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    none = labels.where("false")
    assert toxicity.score_documents(docs, none).select("score").distinct().count() == 1
    kept = toxicity.keep_clean(docs, none)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert toxicity.score_documents(empty_documents(spark), labels).count() == 0
    assert toxicity.with_scores(docs, toxicity.fit(docs, none), "text", "score").columns.count("score") == 1


def test_any_spacing_and_repetition_is_decoded():
    bad = ["moron", "idiot", "scum"]
    model = toxicity.language_model(toxicity.trigram_counts([" ".join(PLAIN + bad)] * 20))
    reader = toxicity.Reader(model)

    def words(text):
        return {w for t in reader.tokens(text) for w in reader.words(t)}

    for text in ["i  d  i  o  t", "i, d, i, o, t", "i/d/i/o/t", "i\nd\ni\no\nt", "id io t", "iddiot", "iidiioott", "i d i o t!!!"]:
        assert "idiot" in words(f"walking under {text}"), text
        assert toxicity.restore(f"walking under {text}", model) == "walking under idiot", text
    assert "moron" in words("mooron") and "scum" in words("s c u m!")
    assert "letter" in words("green letter")
    assert toxicity.restore("1 2 3 and 40 50", model) == "1 2 3 and 40 50"


# Invented toxic words of other scripts, with clean ones beside them.
SCRIPTS = {
    "cyrillic": ("придурок мразота", "река камень утро свет стол окно вода сад письмо дорога трава"),
    "greek": ("βλάκας ηλίθιος", "ποτάμι πέτρα πρωί φως τραπέζι νερό κήπος γράμμα δρόμος χορτάρι"),
    "polish": ("głupiec łajdak", "rzeka kamień ranek światło stół woda ogród list droga trawa źdźbło"),
    "turkish": ("şerefsiz ahmaklığı", "nehir taş sabah ışık masa su bahçe mektup yol çimen gökyüzü"),
    "hindi": ("मूर्खता बेवकूफ़", "नदी पत्थर सुबह रोशनी मेज़ पानी बगीचा चिट्ठी सड़क घास"),
}
HAN = ("混蛋 白痴", "河流 石头 早晨 光线 桌子 清水 花园 书信 道路 青草")


@pytest.fixture(scope="module")
def scripts(spark):
    rng, rows, kinds = random.Random(8), [], {}
    for name, (bad, plain) in {**SCRIPTS, "han": HAN}.items():
        bad, plain, gap = bad.split(), plain.split(), "" if name == "han" else " "
        for i in range(160):
            words = [rng.choice(plain) for _ in range(20)]
            if i % 4 == 0:
                words[rng.randrange(20)] = rng.choice(bad)
            rows.append((len(rows), gap.join(words), int(i % 4 == 0)))
            kinds[rows[-1][0]] = name
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), kinds


def test_every_script_is_read(scripts):
    docs, labels, kinds = scripts
    rows = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    for name in set(kinds.values()):
        held = [r for r in rows.values() if r.held_out and kinds[r.doc_id] == name]
        caught = [r.predicted for r in held if toxic[r.doc_id]]
        clean = [r.predicted for r in held if not toxic[r.doc_id]]
        assert len(caught) >= 4 and sum(caught) > 0.9 * len(caught), name
        assert sum(clean) <= 0.05 * len(clean), name


def test_disguises_in_other_scripts(scripts):
    model = toxicity.corpus_model(scripts[0])
    for text, word in [
        ("п р и д у р о к", "придурок"), ("приду*ок", "придурок"), ("придуууурок", "придурок"),
        ("g ł u p i e c", "głupiec"), ("g\u0142upi3c", "głupiec"), ("ş.e.r.e.f.s.i.z", "şerefsiz"),
        ("βλά*ας", "βλάκας"), ("\uff47\u0142upiec", "głupiec"), ("\U0001d420\u0142upiec", "głupiec"),
    ]:
        assert toxicity.restore(text, model) == word, text


def test_compatibility_forms_and_mixed_scripts():
    words = lambda t: toxicity.tokens_of(toxicity.fold(t))
    assert words("ｉｄｉｏｔ 𝐢𝐝𝐢𝐨𝐭 ídiot") == ["idiot", "idiot", "ídiot"]
    assert words("іdіоt") == ["idiot"]  # Latin d and t among Cyrillic letters
    assert words("тот") == ["тот"] and words("это не то") == ["это", "не", "то"]
    assert words("głupi Straße") == ["głupi", "straße"]
    assert toxicity.words_of("混蛋啊") == ["混蛋", "蛋啊", "混蛋啊"]


def test_short_words_behind_a_spelt_one_stay_apart():
    plain = "this is a letter to us and it is of no use to me or my".split()
    rng = random.Random(3)
    texts = [" ".join(rng.choice(plain + ["idiot"]) for _ in range(30)) for _ in range(60)]
    model = toxicity.language_model(toxicity.trigram_counts(texts))
    assert toxicity.restore("i.d.i.o.t is", model) == "idiot is"
    assert toxicity.restore("i d i o t", model) == "idiot"
