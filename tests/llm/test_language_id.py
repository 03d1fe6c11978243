"""Language ID: features and prediction against direct sums, and accuracy."""

import base64
import random

import numpy as np
from pyspark.sql import functions as F

from fathom.llm import language_id as I
from fathom.llm.queries import op3_language_id
from tests.llm.conftest import SF


def test_held_out_accuracy_and_und(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op3_language_id(spark, SF).collect()
    own = [r for r in rows if r["held_out"] and len(docs[r["doc_id"]]["text"]) > 100]
    assert len(rows) == len(docs) and len(own) > 20
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in own]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert not any(r["rejected"] for r in own)


def brute_counts(text):
    s = b" " + b" ".join(bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in text.lower().encode()).split()) + b" "
    out = np.zeros(I.DIMS, int)
    for i in range(len(s)):
        for n, salt, mul in ((1, 0, 0x9E3779B1), (2, 0x10000, 0x85EBCA6B), (3, 0x2000000, 0xC2B2AE35)):
            if i + n <= len(s):
                out[((int.from_bytes(s[i:i + n], "big") + salt) * mul % (1 << 32)) >> 20] += 1
    return out


def test_features_like_brute_force(monkeypatch):
    for piece in (I.PIECE, 4):
        monkeypatch.setattr(I, "PIECE", piece)
        for t in ("", "a", "Öl im Meer, 12 x!", "word " * 20, "ÇÉ"):
            assert (I.ngram_counts(t) == brute_counts(t)).all()


def test_prediction_is_the_nearest_centroid(spark, odd, none):
    model = I.fit(odd.where(F.col("lang").isin("en", "de")))
    assert set(model.languages) <= {"en", "de"}
    got = I.predict(odd, model)
    assert set(odd.columns) - {"score"} <= set(got.columns)
    rows = got.collect()
    assert len(rows) == odd.count()
    for r in rows:
        if not I.has_letter(r["text"]):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        v = np.where(brute_counts(r["text"]) > 0, 1 + np.log(np.maximum(1, brute_counts(r["text"]))), 0) * model.idf
        cosine = model.centroids @ (v / np.linalg.norm(v))
        assert abs(r["score"] - min(1, max(0, cosine.max()))) < 1e-4
        assert cosine[[model.languages[o] == r["lang_pred"] for o in model.owner]].max() > cosine.max() - 1e-5
    assert I.predict(none, model).collect() == []


def test_nothing_to_learn_from(odd, none):
    model = I.fit(none)
    assert {r["lang_pred"] for r in I.predict(odd, model).collect()} == {"und"}


def test_far_texts_are_rejected(spark, table):
    model = I.fit(table("documents"))
    r = I.predict(spark.createDataFrame([(1, "漢字仮名交じり文" * 5), (2, "the and of to in is that")], "doc_id long, text string"), model).collect()
    assert [x["rejected"] for x in sorted(r, key=lambda x: x["doc_id"])] == [True, False]


FINNISH = ("Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja "
           "heidän on toimittava toisiaan kohtaan veljeyden hengessä. Jokainen on oikeutettu kaikkiin tässä julistuksessa esitettyihin "
           "oikeuksiin ja vapauksiin ilman minkäänlaista erotusta.")
POLISH = ("Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i "
          "powinni postępować wobec innych w duchu braterstwa. Każdy człowiek posiada wszystkie prawa i wolności.")


def test_latin_junk_and_unlearned_languages_are_rejected(spark):
    docs = spark.read.parquet(SF.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text", "lang")
    held = F.col("doc_id") % 3 == 1
    model = I.fit(docs.where(~held))
    rng = random.Random(3)
    letters = lambda al, n: " ".join("".join(rng.choice(al) for _ in range(rng.randint(2, 9))) for _ in range(n))
    junk = [letters("abcdefghijklmnopqrstuvwxyz", n) for n in (12, 50, 200, 1500)]
    junk += [letters("bcdfghjklmnpqrstvwxz", n) for n in (12, 50, 1500)]
    junk += [base64.b64encode(rng.randbytes(n)).decode() for n in (60, 300, 6000)]
    junk += [FINNISH, POLISH]
    assert [t for t, (_, _, rejected) in zip(junk, model.predict(junk)) if not rejected] == []
    own = [r["text"] for r in docs.where(held).collect() if I.has_letter(r["text"])]
    out = [len(t) for t, (_, _, rejected) in zip(own, model.predict(own)) if rejected]
    assert len(own) > 300 and out == []
