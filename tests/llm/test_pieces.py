import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from quern.llm.pieces import Pieces, decode, encode
from quern.llm.queries import PIECE_MODEL

ODD = ["", " ", "a", "   ", "\n\n x\n", "  a  b\tc\nﬁ ", "    " * 9 + "x", "héllo 执行\u0001😀 ok", "a" * 300, "<s> x </s> <0x41>", "end  ", "é" * 50]


@pytest.fixture(scope="module")
def model():
    with open(PIECE_MODEL, "rb") as f:
        return f.read()


def noise(rng, n):
    return "".join(rng.choice("abcdefgh  ,.\nETAOIN éßж0123_('") for _ in range(n))


def test_a_merge_model_gives_the_ids_of_the_library(model):
    rng, pieces = random.Random(3), Pieces(model)
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    for text in [*ODD, *(noise(rng, rng.randrange(200)) for _ in range(300))]:
        assert pieces.encode(text).tolist() == library.encode(text)
        assert pieces.decode(library.encode(text)) == library.decode(library.encode(text)) == text


def test_a_unigram_model_gives_the_best_score(model):
    changed = proto.ModelProto.FromString(model)
    changed.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    pieces, rng = Pieces(changed.SerializeToString()), random.Random(4)
    for _ in range(60):
        text = noise(rng, 30).replace("ж", "")
        marked = "▁" + text.replace(" ", "▁")
        best = [0.0] + [float("-inf")] * len(marked)
        for end in range(1, len(marked) + 1):
            for start in range(max(0, end - 16), end):
                i = pieces.id.get(marked[start:end])
                if i is not None:
                    best[end] = max(best[end], best[start] + pieces.score[i])
            if marked[end - 1] not in pieces.id:
                best[end] = max(best[end], best[end - 1] + pieces.unknown)
        ids = pieces.encode(text).tolist()
        assert all(i in pieces.score for i in ids) or "\n" in text
        if all(i in pieces.score for i in ids):
            assert sum(pieces.score[i] for i in ids) == best[-1]
        assert pieces.decode(ids) == text


def test_tables_with_nulls_repeats_and_clashing_names(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "the cat  sat", "z"), (3, "the cat  sat", "z"), (None, "é😀\n", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pieces string")
    out = decode(encode(docs, PIECE_MODEL), PIECE_MODEL).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in out) == sorted((str(d), t or "") for d, t, _ in rows)
    assert {len(r.pieces) for r in out if not r.text} == {0}
    both = encode(docs, PIECE_MODEL, decoded="text2").collect()
    assert all(r.text2 == (r.text or "") for r in both)
    assert encode(docs.limit(0), PIECE_MODEL).collect() == []
    nothing = spark.createDataFrame([(None,)], "pieces array<int>")
    assert decode(nothing, PIECE_MODEL).first().decoded == ""


def test_the_memory_of_units_does_not_change_results(model, monkeypatch):
    import quern.llm.pieces as module

    rng = random.Random(9)
    texts = [noise(rng, 400) for _ in range(20)]
    whole = [Pieces(model).encode(t).tolist() for t in texts]
    monkeypatch.setattr(module, "MEMO_UNITS", 5)
    monkeypatch.setattr(module, "MEMO_PAIRS", 7)
    small = Pieces(model)
    assert [small.encode(t).tolist() for t in texts] == whole


def test_the_viterbi_query_decodes_to_the_texts_and_scores_best(spark, model):
    from quern.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op9_viterbi_pieces"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(r.round_trip for r in rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)  # a few texts for the slow comparison
    own, merged = Pieces(model, True), Pieces(model)
    for r in encode(docs, PIECE_MODEL, viterbi=True).collect():
        if r.text:
            score = lambda ids: sum(own.score.get(i, own.unknown / 3) for i in ids)
            assert score(r.pieces) >= score(merged.encode(r.text).tolist()) - 1e-6


def test_a_very_long_text_and_a_clashing_name(spark):
    text = "the cat sat on the mat\n" * 20_000 + "x" * 50_000
    docs = spark.createDataFrame([(1, text, 5)], "doc_id long, text string, found int")
    row = encode(docs, PIECE_MODEL, decoded="again").first()
    assert row.again == text and row.found == 5
