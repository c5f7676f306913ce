import random
import zlib

import numpy as np
import pyarrow as pa

from diurna.llm import toxicity as tx
from diurna.llm.textbatch import text_bytes


def corpus(spark, n=600):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(10, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["blarg", "zwumpy", "zwumpish", "Blarg!", "bl4rg"])
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    rows = tx.predict(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.95


def test_features_by_hand():
    words = ["blarg", "zwumpy"]
    lexicon = tx.Lexicon(tx._hash_words(words), np.full(2, 4.0))
    texts = ["you BLARG", "b.l.a.r.g zwumpy", "nice day!!", "", None, "zwumpy " + "calm " * 20 + "you"]
    x = tx.features(*text_bytes(pa.array(texts)), lexicon, tx._hash_words(tx.SECOND_PERSON))
    f = {name: x[:, i].tolist() for i, name in enumerate(tx.FEATURES)}
    assert f["hits"] == [1, 2, 0, 0, 0, 1]
    assert f["near_second_person"] == [1, 0, 0, 0, 0, 0]
    assert f["obfuscated_hits"] == [0, 1, 0, 0, 0, 0]
    assert f["all_capital_words"][0] == 0.5 and f["exclamations"][2] == 0.2
    assert not x[3].any() and not x[4].any()


def test_odd_rows(spark, odd, none):
    docs, labels = corpus(spark, 200)
    model = tx.train(docs.join(labels, "doc_id"))
    out = tx.score(odd, model)
    assert out.columns == [*odd.columns, "score"] and out.count() == odd.count()
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    assert tx.score(none, model).count() == 0
    # labels for documents that aren't there, repeated labels, null labels, one class
    more = labels.unionByName(labels).unionByName(spark.createDataFrame([(10_000, 1), (1, None)], "doc_id long, toxic int"))
    assert tx.predict(docs, more).count() == 200
    assert {r["score"] for r in tx.predict(docs, labels.filter("toxic = 0")).collect()} == {0.0}
    assert tx.predict(none.select("doc_id", "text"), labels).count() == 0
