import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from paritymill.llm import pieces, queries, units

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def odd_texts():
    rng = random.Random(5)
    parts = ["word", " ", "  ", "   ", "\n", "\u2581", "\u2581 ", " \u2581", "\u3000", "\u00a0", "\u00e9", "e\u0301", "\u4f60",
             "\U0001f600", "\x00", "\t", "\r\n", "</s>", "<s>", "<unk>", "<0x0A>", "123", "\ufffd", "\u200d", "."]
    fixed = [None, "", " ", "  ", "a ", " a", "a  ", "\u2581", "\u2581a", " \u2581 ", "a" * 5000, "\n", "\u2581" * 7, " " * 40]
    return fixed + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(400)]


def check(spark, library, texts, end=True):
    rows = [(i, t) for i, t in enumerate(texts)]
    got = pieces.encode(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH, ["doc_id"], end=end).collect()
    assert sorted(r.row.doc_id for r in got) == list(range(len(texts)))
    for r in got:
        ids = library.encode(texts[r.row.doc_id] or "")
        assert r.ids == ids + [library.eos_id()] * end, texts[r.row.doc_id]
        assert r.decoded == library.decode(r.ids), texts[r.row.doc_id]


def test_odd_texts_equal_the_library(spark, library):
    check(spark, library, odd_texts())
    check(spark, library, odd_texts()[:60], end=False)


def test_chunks_encode_as_their_text_does(library):
    may, alone = pieces.joints(PATH), pieces.processor(PATH, marked=False)
    for text in odd_texts():
        column = pa.array([text, text, "x"])
        for part in units.slices(pieces.marked_texts(column), 8):
            starts = pieces.chunk_starts(part, may)
            blob, ends = part.data.tobytes(), [*starts[1:], len(part.data)]
            chunks = [blob[a:b].decode() for a, b in zip(starts, ends, strict=True)]
            for row, low, high in zip(column.to_pylist()[part.first :], part.bounds, part.bounds[1:], strict=False):
                mine = [c for c, at in zip(chunks, starts, strict=True) if low <= at < high]
                ids = alone.encode(mine)
                assert [i for c in ids for i in c] == library.encode(row or "")
                assert "".join(alone.decode(ids))[1:] == library.decode(library.encode(row or "")) if mine else not row


def test_a_table_that_is_emptied_gives_the_same(library, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_CHUNKS", 20)
    table = pieces.ChunkTable(PATH)
    for text in odd_texts():
        for part in units.slices(pieces.marked_texts(pa.array([text, "", text]))):
            ids, texts = table.encode(part, 2)
            want = library.encode(text or "")
            assert ids.to_pylist() == [want + [2], [2], want + [2]]
            assert texts.to_pylist() == [library.decode(want), "", library.decode(want)]


def test_whole_table_equals_the_library(spark, library, tiny):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    rows = queries.op11_piece_ids(spark, tiny).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id]) + [library.eos_id()]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_very_long_texts_and_repeats(spark, library):
    rng = random.Random(1)
    long = " ".join(f"{rng.randrange(10**9)}" for _ in range(90_000))
    check(spark, library, [long, "same text", "same text", "x" * 200_000])


def test_carried_columns_and_empty_table(spark):
    schema = "doc_id bigint, text string, ids int, decoded string, block int, chunk string, row string"
    df = spark.createDataFrame([(1, "a b", 5, "d", 6, "c", "r")], schema)
    row = pieces.encode(df, PATH, df.columns).collect()[0]
    assert tuple(row.row) == (1, "a b", 5, "d", 6, "c", "r") and row.decoded == "a b"
    assert pieces.encode(df.limit(0), PATH, ["doc_id"]).collect() == []


def test_decoding_any_ids(spark, library):
    rng = random.Random(2)
    lists = [[rng.randrange(library.get_piece_size()) for _ in range(n)] for n in range(30)] + [None]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(lists)], "k int, ids array<int>, decoded string")
    for r in pieces.decode_ids(df, PATH).collect():
        assert r.decoded == library.decode(lists[r.k] or [])


def test_words_are_cut_at_their_markers_and_punctuation():
    part = next(units.slices(pieces.marked_texts(pa.array(["Some words.\nAnd  more, here"]))))
    starts = pieces.chunk_starts(part, pieces.joints(PATH))
    text = part.data.tobytes().decode()
    assert [text[a:b] for a, b in zip(starts, [*starts[1:], None], strict=True)] == [
        " Some", " words", ".", "\n", "And", "  more", ",", " here"
    ]


def test_a_model_of_another_kind_is_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    for change in ("normalizer", "type", "own"):
        spec = proto.ModelProto.FromString(open(PATH, "rb").read())
        if change == "normalizer":
            spec.normalizer_spec.remove_extra_whitespaces = True
        elif change == "type":
            spec.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
        else:
            spec.pieces[400].type = proto.ModelProto.SentencePiece.USER_DEFINED
        (tmp_path / f"{change}.model").write_bytes(spec.SerializeToString())
        with pytest.raises(ValueError, match="the model must"):
            pieces.processor(str(tmp_path / f"{change}.model"))
