import hashlib

import numpy as np
import pytest
import sentencepiece

from cladeflow.llm.piece_encoding import CharMap, encode, encode_digests, encode_documents, normalise, spans
from cladeflow.llm.pieces import PieceModel, load
from cladeflow.llm.queries import model_path
from cladeflow.llm.token_counts import count_tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = [
    "", " ", "  ", "   a", "a ", "a  b   c ", "one two", "Tab\there\nline\r\n", "▁mark▁▁x", "<s> </s> <unk> <0x41>",
    "café 你好 \U0001f600\U0001f600   nbsp", "\x00zero \x7f", "a" * 3000, "word " * 5000, "1234567890 3.14", "ﬁ ① Ａ",
    " ▁ ▁", "x" + " " * 40 + "y",
]


@pytest.fixture(scope="module")
def model():
    return load(model_path())


def test_segments_give_the_library_s_ids(model):
    assert model.safe
    want = model.lib.encode(TEXTS)
    got = encode(model, TEXTS)
    assert [ids for ids, _ in got] == want
    assert [joined for _, joined in got] == [",".join(map(str, ids)) for ids in want]


def test_spans_are_those_of_the_library(model):
    for text in TEXTS:
        proto = model.lib.encode(text, return_type="proto")
        ids = [p.id for p in proto.pieces]
        at = spans(model, text.encode(), ids)
        if not ids:
            assert len(at) == 0
            continue
        assert at[0] == 0 and at[-1] == len(text.encode())
        whole = [(p.begin, p.end) for p in proto.pieces]
        for (b, e), (x, y), p in zip(whole, zip(at[:-1], at[1:], strict=True), proto.pieces, strict=True):
            if model.kinds[p.id] != 6:  # the library gives bytes of one character the span of the whole character or nothing
                assert (x, y) == (b, e), (text, p.piece)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "nfkc", "identity"])
def test_compiled_character_map(rule):
    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto.FromString(lib.serialized_model_proto())
    table = CharMap(proto.normalizer_spec.precompiled_charsmap)

    class Model:
        plain, normalizer = False, proto.normalizer_spec

    Model.normalizer.remove_extra_whitespaces = Model.normalizer.add_dummy_prefix = Model.normalizer.escape_whitespaces = False
    for text in TEXTS[:-3] + TEXTS[-3:-2] + ["ｶﾞ é Å 　​"]:
        normal, align = normalise(Model, text.encode())
        assert normal.decode() == lib.normalize(text), text
        assert len(align) == len(normal) + 1 and (np.diff(align) >= 0).all()
    assert (table.longest("ﬁ".encode(), 0) is None) == (rule == "identity")


def test_queries_rows(spark, model):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (3, None), (3, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, n_tokens int")
    counts = count_tokens(docs, model_path()).collect()
    want = sorted((str(i), len((t or "").encode()), len(model.lib.encode(t or ""))) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in counts) == want
    full = encode_documents(docs, model_path()).collect()
    assert sorted((str(r.doc_id), r.ids) for r in full) == sorted((str(i), model.lib.encode(t or "")) for i, t in rows)
    assert sorted(r.decoded for r in full) == sorted(model.lib.decode(model.lib.encode(t or "")) for _, t in rows)
    digests = encode_digests(docs, model_path()).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted(r.ids_sha256 for r in digests) == sorted(sha(",".join(map(str, model.lib.encode(t or "")))) for _, t in rows)
    assert count_tokens(docs.limit(0), model_path()).count() == encode_digests(docs.limit(0), model_path()).count() == 0


def test_json_and_long_texts(spark, model, monkeypatch):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    want = {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.n_tokens for r in count_tokens(docs, path).collect()} == want
    import cladeflow.llm.token_counts as module

    monkeypatch.setattr(module, "BATCH_BYTES", 100)
    assert module._piece_counts(model_path(), TEXTS) == [len(x) for x in model.lib.encode(TEXTS)]


def test_table_of_segments_is_bounded(monkeypatch):
    import cladeflow.llm.pieces as module

    monkeypatch.setattr(module, "KEPT", 5)
    small = PieceModel(model_path())
    for text in TEXTS:
        assert encode(small, [text])[0][0] == small.lib.encode(text)
