import hashlib
import random
import struct
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from loomspark.llm import pieces
from loomspark.llm.queries import PIECES_MODEL
from loomspark.llm.textkernels import slices

from .helpers import docs, odd_texts, prose

pytestmark = pytest.mark.skipif(not Path(PIECES_MODEL).exists(), reason="no vocabulary file")
LETTERS = "abcdefghijklmnopqrstuvwxyz   \n\tABC.,!?01239éèñßüö中文字你🙂 -_/()[]{}\"'=+*▁"


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=PIECES_MODEL)


def encoded(t, texts):
    encoder, decoder, out = pieces.Encoder(t), pieces.Decoder(t), []
    for a, b, data, offsets in slices(pa.array(texts, pa.string())):
        ids, first = encoder.encode(data, offsets)
        back, at = decoder.decode(ids, first)
        out += [(ids[first[i] : first[i + 1]].tolist(), back[at[i] : at[i + 1]].tobytes().decode()) for i in range(b - a)]
    return out


def test_equals_the_library(library):
    r = random.Random(0)
    texts = ["", " ", "  ", "   a", "a  b", " hello   world  ", "\n", "a\nb", " \n ", "▁", "a" * 40, "    " * 30 + "x", "x" + " " * 17 + "." + " " * 33]
    texts += ["".join(r.choice(LETTERS) for _ in range(r.randint(1, 120))) for _ in range(3000)] + [prose(i, 200) for i in range(20)]
    for text, (ids, back) in zip(texts, encoded(pieces.compile_model(PIECES_MODEL), texts), strict=True):
        assert ids == library.encode(text), text
        assert back == text.replace("▁", " ")


def field(number, kind, payload):
    head = bytes([number << 3 | kind])
    return head + (bytes([len(payload)]) + payload if kind == 2 else payload)


def unigram_file(path, scored):
    data = b""
    for piece, score, kind in scored:
        data += field(1, 2, field(1, 2, piece.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind])))
    data += field(2, 2, field(3, 0, bytes([pieces.UNIGRAM])))
    data += field(3, 2, field(1, 2, b"identity") + field(3, 0, b"\1") + field(4, 0, b"\1"))
    path.write_bytes(data)


def big(number, payload):
    """A field of any length."""
    n, size = len(payload), b""
    while n > 127:
        size, n = size + bytes([n & 127 | 128]), n >> 7
    return bytes([number << 3 | 2]) + size + bytes([n]) + payload


def normaliser(rule):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    return next(v for n, v in pieces._fields(model) if n == 3)


COMPOSED = ["ｱﾊﾟｰﾄ ﬁne  e\u0301 ①\t x", "한국 \u1112\u1161\u11ab", "A\u030a Å ½ ㌔ ™ x\u0300\u0301", "\u200bzero\ufeff \r\n\u3000wide", "ｶﾞ ﾊﾟ", "", " ", "\u0007bell", "É\u0323 ǆ"]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "nfkc"])
def test_character_maps_equal_the_librarys(tmp_path, rule):
    sentencepiece = pytest.importorskip("sentencepiece")
    letters = sorted({c for t in COMPOSED for c in t} | set("abcdefghijklmnopqrstuvwxyzåé한국アパートガ1kg⁄2 "))
    scored = [("<unk>", 0.0, pieces.UNKNOWN), ("▁", -3.0, 1), *((c, -4.0 - i / 64, 1) for i, c in enumerate(x for x in letters if x.strip())), ("fi", -5.0, 1), ("▁x", -3.5, 1), ("アパ", -4.5, 1), ("ne", -4.75, 1)]
    data = b""
    for piece, score, kind in scored:
        data += field(1, 2, field(1, 2, piece.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind])))
    data += field(2, 2, field(3, 0, bytes([pieces.UNIGRAM]))) + big(3, normaliser(rule))
    (tmp_path / "n.model").write_bytes(data)
    library, t = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "n.model")), pieces.compile_model(str(tmp_path / "n.model"))
    r = random.Random(1)
    texts = COMPOSED + ["".join(r.choice("".join(COMPOSED)) for _ in range(r.randint(1, 40))) for _ in range(800)]
    one_unknown = lambda ids: [x for i, x in enumerate(ids) if x or not i or ids[i - 1]]  # noqa: E731  the library joins unknown characters on end
    for text, (ids, _) in zip(texts, encoded(t, texts), strict=True):
        assert one_unknown(ids) == one_unknown(library.encode(text)), (rule, text)


def test_user_defined_pieces_are_never_split(tmp_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    data = Path(PIECES_MODEL).read_bytes()
    for piece in ("<sep>", "<sep>x", "don't", "中文字"):
        data += field(1, 2, field(1, 2, piece.encode()) + field(2, 5, struct.pack("<f", 0.0)) + field(3, 0, bytes([pieces.USER_DEFINED])))
    (tmp_path / "u.model").write_bytes(data)
    library, t = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "u.model")), pieces.compile_model(str(tmp_path / "u.model"))
    r = random.Random(2)
    parts = ["<sep>", "<sep>x", "don't", "中文字", "a", " ", "word", "<se", "p>", "x", "  ", "é", "do", "n't", "🙂"]
    texts = ["<sep>", "a<sep>b", "<sep>xyz", " don't  <sep> ", *("".join(r.choice(parts) for _ in range(r.randint(1, 25))) for _ in range(600))]
    for text, (ids, back) in zip(texts, encoded(t, texts), strict=True):
        assert ids == library.encode(text), text
        assert back == text


def test_unigram_takes_the_least_weight(tmp_path):
    scored = [("<unk>", 0.0, pieces.UNKNOWN), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.0, 1), ("▁a", -2.2, 1), ("ba", -2.4, 1), ("▁ab", -6.0, 1), ("c", -4.0, 1)]
    unigram_file(tmp_path / "u.model", scored)
    t = pieces.compile_model(str(tmp_path / "u.model"))
    weights = {p: -s for p, s, k in scored if k == 1}

    def best(text):
        text = "▁" + text.replace(" ", "▁")
        cost = [0.0] + [float("inf")] * len(text)
        for i in range(1, len(text) + 1):
            cost[i] = min(cost[j] + weights[text[j:i]] for j in range(i) if text[j:i] in weights)
        return cost[-1]

    for text in ("ab", "abab ba", "ba ab abc", "a b c", "abba"):
        (ids, back), = encoded(t, [text])
        assert back == text
        assert np.isclose(sum(weights[scored[i][0]] for i in ids), best(text))
    assert encoded(t, ["  a   b "])[0][1] == "a b"


def test_columns_and_round_trip(spark, library):
    rows = odd_texts()
    d = docs(spark, rows)
    e = pieces.encode(d, PIECES_MODEL)
    assert e.columns == [*d.columns, "ids"]
    for r in pieces.decode(e, PIECES_MODEL).collect():
        assert r.ids == library.encode(r.text or "") and r.decoded == (r.text or "")
    got = {(r.doc_id, r.n_pieces, r.n_byte_pieces, r.ids_sha256) for r in pieces.encoding_digests(d, PIECES_MODEL).collect()}
    want = set()
    for i, t in rows:
        ids = library.encode(t or "")
        want.add((i, len(ids), sum(library.is_byte(x) for x in ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()))
    assert got == want
    assert pieces.encoding_digests(d, PIECES_MODEL).where("not round_trip").count() == 0
    assert pieces.encode(d.limit(0), PIECES_MODEL).collect() == []


def test_memory_of_segments_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "_REMEMBERED", 10)
    t = pieces.compile_model(PIECES_MODEL)
    texts = [prose(i, 50) for i in range(5)]
    one, two = pieces.Encoder(t), pieces.Encoder(t)
    for text in texts + texts:
        data = np.frombuffer(text.encode(), np.uint8)
        assert one.encode(data, np.array([0, len(data)]))[0].tolist() == two.encode(data, np.array([0, len(data)]))[0].tolist()
