import random
import unicodedata
import zlib
from collections import defaultdict

import pytest

from quern.llm.packing import Encoder, Packer, pack

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


ODD = ["it's, don't. ΑΣ. İstanbul, <|endoftext|>, x<|ENDOFTEXT|>.  a\tb  c\r\n", "12,5 a1. !!! ?a. é́, ﬁ. ǅ Å, 가, か.", "", "  ", "'S 'LL, we'LL. I'M!", "\x1c\x1f \x85 a　b.", "word " * 10, "x" * 300]


def test_encoder_is_the_tokenizer(tokenizer):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("aB é'.,;!? \n\t1中ß") for _ in range(200)) for _ in range(60)]
    want = [b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    code = Encoder(PATH)
    assert code.texts(texts) == want
    assert code.texts(texts) == want  # from the store


def check(rows, docs, tokenizer, capacity):
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for d, t in docs}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[d])
            part = ids[d][r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            at += r.length
        assert at == len(ids[d])
    pad = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        pad += 0 if at & (at - 1) == 0 else capacity - at
    return pad / sum(map(len, ids.values()))


def test_pieces_cover_documents(spark, documents, tokenizer):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["alpha", "beta.", "Gamma", "delta's", "é"]) for _ in range(int(rng.paretovariate(0.7) * 40) % 9000))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "x " * 30_000)]
    got = pack(documents(docs).withColumnRenamed("n_chars", "length").repartition(3), PATH).collect()
    assert check(got, docs, tokenizer, 2048) < 0.05
    assert pack(documents([]), PATH).count() == 0


def test_repeated_rows_are_packed_each(spark, documents):
    got = pack(documents([(1, "a b"), (1, "a b"), (None, "c")]), PATH).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 2), (1, 3), (1, 3)]


def test_classes_hold_a_fixed_number():
    p, rng = Packer(64, 0), random.Random(1)
    lengths = {i: rng.randint(1, 150) for i in range(400)}
    rows = [r for i, n in lengths.items() for r in p.put(i, b"\1\0\0\0" * n)]
    before = max(r[5] for r in rows)
    rows += list(p.end())
    bins = defaultdict(list)
    for r in rows:
        bins[r[5]].append(r)
    cut = {i for i, n in lengths.items() if sum(r[0] == i for r in rows) > -(-n // 64)}
    for sequence, inside in bins.items():
        assert sum(r[2] for r in inside) == 64 or sequence == max(bins)
        whole = [r[2] for r in inside if r[0] not in cut and r[1] + r[2] == r[4]]
        if sequence <= before and inside[0][2] < 64:  # the first is of the bin's class, which has as many
            i = 64 // inside[0][2]
            assert sum(64 // n == i for n in whole) >= i
    assert len(cut) < 120 and len(rows) < 400 + 2 * len(bins)


def test_encoder_over_all_of_unicode(tokenizer):
    """100,000 short texts of any characters, marks after every letter among them."""
    rng = random.Random(6)
    letters = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and (c.isalnum() or unicodedata.combining(c))]
    texts = [f"a{c}{m}b {c}{m} {c}a{m}" for c in letters[:40_000] for m in ".,"]
    some = letters[:3000] + list("aB é'.,;!? \n\t") * 100 + ["İ", "ǰ", "क़", "ﬁ", "ß", "Σ"] * 50
    texts += ["".join(rng.choice(some) for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    want = [b"".join(i.to_bytes(4, "little") for i in e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    code = Encoder(PATH)
    got = [x for at in range(0, len(texts), 1000) for x in code.texts(texts[at : at + 1000])]
    assert [t for t, g, w in zip(texts, got, want) if g != w] == []


def test_ids_round_trip(spark, documents, tokenizer):
    text = "Some words, and others. " * 400
    rows = pack(documents([(1, text)]), PATH, with_ids=True).orderBy("start").collect()
    raw = b"".join(bytes(r.ids) for r in rows)
    ids = [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids + [1]
