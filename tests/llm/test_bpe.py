import hashlib
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loomspark.llm import bpe
from loomspark.llm.queries import BPE_FILE

from .helpers import docs, odd_texts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE_FILE)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(BPE_FILE)


def odd():
    r = random.Random(1)
    pool = [chr(c) for c in [*range(0, 0x250), *range(0x370, 0x600), *range(0x900, 0x980), *range(0x1E00, 0x2100), *range(0x3040, 0x3100), *range(0xAC00, 0xAC40), 0x1F600, 0x1F468, 0x200D, 0x130, 0x3A3, 0x1C, 0x85, 0xFEFF, 0x300, 0x301, 0x323, 0x1C89, 0xA7DC]]
    pool += [" ", "a", "'", "s", "'re", "'ll", "<|endoftext|>", "<|startoftext|>", "<|"] * 20
    texts = ["".join(r.choices(pool, k=r.randint(0, 60))) for _ in range(4000)]
    return [*texts, "x" * 5000, "ab" * 9000, "=" * 20000, "ha" * 40 + "!" * 97, "é" * 3000, "ΣΑΣ", "", " \n", *("".join(r.choices("aehlorst", k=k)) for k in range(80, 120))]


def test_ids_and_texts_are_the_librarys(library, vocabulary):
    texts = odd()
    encoder = bpe.Encoder(vocabulary)
    ids = [np.frombuffer(encoder(t), "<u4").astype(np.int64) for t in texts]
    want = library.encode_batch(texts, add_special_tokens=False)
    assert [i.tolist() for i in ids] == [w.ids for w in want]
    first = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
    assert bpe._decoded(np.concatenate(ids), first, pa.array(vocabulary.tokens)).to_pylist() == [library.decode(w.ids, skip_special_tokens=False) for w in want]


def test_every_character(library, vocabulary):
    """Each code point between two letters: the tables of letters, numbers, blanks and capitals are the library's."""
    texts = [f"a{chr(c)}b" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    encoder = bpe.Encoder(vocabulary)
    assert [t for t, w in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True) if np.frombuffer(encoder(t), "<u4").tolist() != w.ids] == []


def test_long_words_by_heap_equal_the_rank_array(vocabulary):
    r = random.Random(2)
    for _ in range(300):
        word = [vocabulary.inner[b] for b in "".join(r.choices("aehlorstn", k=r.randint(0, 200))).encode()]
        assert bpe.merge_by_rank_array(word, vocabulary.merges) == bpe.merge_by_heap(word, vocabulary.merges)


def test_what_is_remembered_changes_nothing(library, vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 4)
    encoder = bpe.Encoder(vocabulary)
    for text in ["one two three four five six one two seven eight nine one " * 3, "a b c d e f a b c g h i a"]:
        assert np.frombuffer(encoder(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(encoder.runs) <= 4


def test_digests(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 1000)
    texts = [*odd_texts(), (90, "x <|endoftext|>Y"), (91, "ΣΑΣ \x1c")]
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.token_digests(docs(spark, texts), BPE_FILE).collect())
    want = []
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)


def test_encode_keeps_columns_and_decode_takes_any_ids(spark, library):
    d = docs(spark, odd_texts())
    encoded = bpe.encode(d, BPE_FILE)
    assert encoded.columns == [*d.columns, "ids"]
    back = bpe.decode(encoded, BPE_FILE).collect()
    assert all(r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in back) and len(back) == d.count()
    odd_ids = spark.createDataFrame([(1, None), (2, []), (3, [None, 5, -1, 10**6, 320])], "doc_id int, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(odd_ids, BPE_FILE).collect()} == {1: "", 2: "", 3: library.decode([5, 320], skip_special_tokens=False)}


def test_empty(spark):
    assert bpe.token_digests(docs(spark, odd_texts()).limit(0), BPE_FILE).collect() == []


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary(BPE_FILE.replace("word_bpe_49k", "byte_bpe_50k"))
