import collections
import zlib

from diurna.llm import langid
from pyspark.sql import functions as F

SAMPLES = {
    "en": "the quick brown fox jumps over the lazy dog and then it goes home with the other animals ",
    "de": "der schnelle braune fuchs springt über den faulen hund und geht dann nach hause mit den anderen ",
    "fr": "le rapide renard brun saute par dessus le chien paresseux et rentre chez lui avec les autres ",
    "es": "el rápido zorro marrón salta sobre el perro perezoso y luego vuelve a casa con los demás ",
}


def corpus(spark):
    rows = []
    for i in range(400):
        lang = list(SAMPLES)[i % 4]
        w = SAMPLES[lang].split()
        rows.append((i, " ".join(w[(i * 7 + k * (i % 5 + 1)) % len(w)] for k in range(20)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    got = langid.predict(docs).join(docs, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(r["lang_pred"] == r["lang"] and 0 < r["score"] <= 1 for r in got)


def test_filter_has_no_false_negatives_and_knows_its_false_positives(spark):
    docs = corpus(spark)
    model = langid.train(docs)
    import numpy as np
    import pyarrow as pa

    from diurna.llm.textbatch import text_bytes

    for i, lang in enumerate(model.languages):
        texts = [r["text"] for r in docs.filter(F.col("lang") == lang).collect()]
        grams, _ = langid.ngrams(*text_bytes(pa.array(texts)))
        values, count = np.unique(grams, return_counts=True)
        common = values[count >= langid.MIN_SHARE * count.sum()]
        assert ((model.masks(common)[0] >> np.uint8(i)) & 1).all()
    random = np.random.default_rng(0).integers(0, 1 << 32, 200_000).astype(np.uint32)
    for i in range(4):
        seen = float(((model.masks(random)[0] >> np.uint8(i)) & 1).mean())
        assert abs(seen - model.false_share[i]) < 0.003


def test_decision_equals_brute_force(spark):
    """Counts of n-grams by plain sets, corrected for the filter's share of false positives."""
    docs = corpus(spark)
    model = langid.train(docs)
    grams, seen = collections.defaultdict(collections.Counter), {}
    for r in docs.collect():
        b = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in f" {r['text']} ".encode())
        seen[r["doc_id"]] = [b[i : i + 4] for i in range(len(b) - 3) if 32 not in b[i + 1 : i + 3]]
        grams[r["lang"]].update(seen[r["doc_id"]])
    wrong = 0
    for r in langid.identify(docs, model).collect():
        count = [sum(grams[name][g] >= langid.MIN_SHARE * grams[name].total() and g in grams[name] for g in seen[r["doc_id"]]) for name in model.languages]
        best = max(range(4), key=lambda i: (count[i], -i))
        assert model.languages[best] == r["lang_pred"]
        wrong += abs(r["lang_score"] - count[best] / sum(count)) > 0.02
    assert wrong < 8  # where false positives came in


def test_many_languages(spark):
    """More languages than bits in a word: filters get a second plane."""
    rows = [(i * 10 + k, f"{chr(97 + i % 26)}{chr(97 + i // 26)}zq " * 5, f"l{i:03d}") for i in range(70) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs, langid.train(docs)).collect()
    assert len(langid.train(docs).slots) == 2
    assert all(r["lang"] == r["lang_pred"] for r in got)


def test_odd_rows(spark, odd, none):
    out = langid.identify(odd, langid.train(corpus(spark)))
    by = {r["doc_id"]: r for r in out.collect()}
    assert len(out.columns) == len(odd.columns) + 2 and out.count() == odd.count()
    assert [by[k]["lang_pred"] for k in (2, 3, 6, 9)] == ["und"] * 4
    assert by[7]["lang_pred"] != "und" and by[2]["lang_score"] == 0
    empty = langid.train(none)
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd, empty).collect()} == {k: "und" if k in (2, 3, 6, 9) else "unknown" for k in by}
    assert langid.identify(none, empty).count() == 0
    clash = odd.withColumn("lang_pred", F.lit(1))
    assert dict(langid.identify(clash, empty).dtypes)["lang_pred"] == "string"
