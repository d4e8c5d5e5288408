import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from sparklake.llm.common import texts
from sparklake.llm.queries import QUERIES
from sparklake.llm.sentencepiece_bpe import Model, encode_decode, mended

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return Model(f.read())


def test_against_the_library(model, library):
    rng = random.Random(4)
    strings = ["", " ", "  ", "a", "\n", "\n\n  \n", " a", "a ", "a  b", "▁", "a▁b", "aaaaaaaaaaaaaa", "bcbcbcbcabcabcabc", "<s> x </s>", "<0x0A>", "\x00a", "日本語 テキスト", "😀😀 ok", "�", " " * 40 + "x" + " " * 33, "1234 5678", "x" * 5000, "ab" * 3000]
    for alphabet in ("abcdehinorst  \n▁éç日.,1", "aebo ", "ab", " ▁\n"):
        strings += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    ids, at = model.encode(texts(pa.array(strings)))
    full = [np.r_[model.bos, ids[at[i] : at[i + 1]], model.eos] for i in range(len(strings))]
    decoded = model.decode(np.concatenate(full), np.r_[0, np.cumsum([len(x) for x in full])])
    for s, x, d in zip(strings, full, decoded, strict=True):
        want = library.encode(s, add_bos=True, add_eos=True)
        assert x.tolist() == want, s
        assert d.decode() == library.decode(want)


def test_invalid_bytes_decode_as_in_the_library(model, library):
    for raw in (b"\xe6\x97", b"\xff", b"a\xc3", b"\xed\xa0\x80", b"\xf0\x9f\x98", b"\xe6\x97\xa5\x80"):
        ids = [model.byte_id[b] for b in raw]
        assert mended(b"".join(model.surface[i] for i in ids)).decode() == library.decode([int(i) for i in ids])


def test_query(spark, sf_dir, library, texts_by_id):
    rows = QUERIES["op6_sentencepiece"](spark, sf_dir).collect()
    assert len(rows) == len(texts_by_id)
    for r in rows:
        ids = library.encode(texts_by_id[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows(odd, none, library):
    rows = encode_decode(odd, PATH).collect()
    assert len(rows) == odd.count() and encode_decode(none, PATH).count() == 0
    by = {r.id: r for r in rows}
    assert by[3].n_tokens == by[4].n_tokens == 2 and bytes(by[3].decoded) == b""
    assert np.frombuffer(by[7].ids, "<u4").tolist() == library.encode(odd.where("doc_id = 7").first().text, add_bos=True, add_eos=True)


def test_other_models_are_refused():
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(PATH, "rb") as f:
        m.ParseFromString(f.read())
    m.normalizer_spec.name = "nmt_nfkc"
    with pytest.raises(ValueError, match="normaliser"):
        Model(m.SerializeToString())
