import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from diurna.llm import packing
from diurna.llm.queries import vocabulary
from diurna.llm.textbatch import text_bytes


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_ids_equal_the_tokenizers(tokenizer):
    rng = random.Random(7)
    parts = ["'", "s", "re", "'ll", " ", "  ", "\n", "\t", "a", "É", "1", "²", "!", "..", " ", "漢", "𝒳", "don't", "ve", "’", "٣", "　", "​", "\x1c", "😀", "́", "Ᲊ", "\U0001e5f6", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    ids, count = packing.WordIds(vocabulary()).encode(*text_bytes(pa.array(texts)))
    at = 0
    for text, n, e in zip(texts, count, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids[at : at + n].tolist() == e.ids, text
        at += n


def test_added_tokens_are_tokens(tokenizer):
    texts = ["a <|endoftext|> b", "plain", "", "<|endoftext|>", "<|endof", "text|>", "x<|endoftext|><|endoftext|>", "é"]
    assert tokenizer.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    ids, count = packing.WordIds(vocabulary()).encode(*text_bytes(pa.array(texts)))
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert count.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def fewest(lengths, capacity):
    """The least number of bins, by search."""
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for r in sorted({x for x in rooms if x >= lengths[i]}):
            left = list(rooms)
            left.remove(r)
            go(i + 1, [*left, r - lengths[i]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best


def test_plan_is_near_the_optimum():
    """Small cases against exhaustive search: nearly all equal it, none needs more than one bin more."""
    rng = random.Random(4)
    over = []
    for _ in range(150):
        lengths = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = {n: lengths.count(n) for n in lengths}
        over.append(packing.plan(counts, 20).sequences - fewest(lengths, 20))
    assert min(over) == 0 and max(over) <= 1 and sum(over) <= 8


def test_plan_places_every_piece():
    rng = random.Random(2)
    for _ in range(30):
        counts = {rng.randint(1, 64): rng.randint(1, 20) for _ in range(rng.randint(1, 30))}
        p = packing.plan(counts, 64)
        spots: dict[int, list] = {}
        for n, c in counts.items():
            entries = [i for i in range(len(p.length)) if p.length[i] == n]
            for rank in range(c):
                e = max(i for i in entries if p.rank[i] <= rank)
                i = rank - p.rank[e]
                spots.setdefault(int(p.sequence[e] + i // p.each[e]), []).append((int(p.offset[e] + i % p.each[e] * n), n))
        assert len(spots) == p.sequences
        for held in spots.values():
            at = 0
            for offset, n in sorted(held):
                assert offset == at
                at += n
            assert at <= 64
            assert sum(3 * n > 64 for _, n in held) <= 2


def test_largest_pieces_are_matched():
    p = packing.plan({600: 2, 424: 2, 100: 1}, 1024)
    assert p.sequences == 3  # two full pairs and the small one
    assert packing.plan({}, 1024).sequences == 0


def check(rows, docs, tokenizer):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    for key, texts in docs.items():
        ids = np.array([*tokenizer.encode(texts[0] or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted(by_doc[key], key=lambda r: r["piece"])
        assert len(mine) == len(texts) * -(-len(ids) // 1024)
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
            assert r["length"] == 1024 or r["piece"] == 0


def test_documents(spark, odd, none, tokenizer):
    docs: dict = {}
    for r in odd.collect():
        docs.setdefault(r["doc_id"], []).append(r["text"])
    check(packing.pack_documents(odd, vocabulary()).collect(), docs, tokenizer)
    out = packing.pack_documents(none, vocabulary())
    assert out.count() == 0
    assert dict(out.dtypes)["piece"] == "int"
