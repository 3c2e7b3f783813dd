import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from paraspark.llm import sentencepiece_fst as S
from paraspark.llm.sentencepiece_fst import MODEL_PATH, Transducer, _Cache, decode_ids, encode_texts
from tests.llm.helpers import docs, edge_texts, rows_by, sentence


@pytest.fixture(scope="module")
def model():
    with open(MODEL_PATH, "rb") as f:
        return Transducer(f.read())


@pytest.fixture(scope="module")
def public():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)


def test_ids_equal_the_public_library(model, public):
    rng, cache = random.Random(9), _Cache(model)
    letters = "abcdeéß漢字 \n\t😀▁<s>0x A!|ing the"
    pieces = [p for p in model.vocabulary if p.isascii()]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice(pieces) for _ in range(4)) for _ in range(3000)]
    texts += [t.replace(" ", "    ") for t in texts[:500]] + ["a" * 999, "▁▁▁ x", "\n\n"]
    for text in texts:
        assert model.encode(text, cache).tolist() == public.encode(text), text


def test_unigram_paths_are_shortest():
    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    def field(number, raw):
        return bytes([number << 3 | 2]) + varint(len(raw)) + raw

    import struct
    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.0, 1), ("ab", -3.5, 1), ("▁ab", -9.0, 1), ("ba", -2.5, 1)]
    raw = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + bytes([0x18, k])) for p, s, k in pieces)
    built = Transducer(raw + field(2, b"\x18\x01"))
    spell = lambda t: [built.spell[i] for i in built.encode(t).tolist()]
    assert spell("ab") == ["▁", "ab"]
    assert spell("aba") == ["▁", "a", "ba"]
    assert spell(" a  b ") == ["▁", "a", "▁", "b"]
    assert spell("ac") == ["▁", "a", "<unk>"]


def test_round_trip_on_spark(spark, public):
    rng = random.Random(2)
    texts = [*edge_texts(), "x" * 500, *(" ".join(sentence(rng, 40)) for _ in range(20)), "line\nline  two\t😀"]
    encoded = encode_texts(docs(spark, texts))
    got = rows_by(encoded, "doc_id")
    back = rows_by(decode_ids(encoded), "doc_id")
    for i, text in enumerate(texts):
        assert got[i]["ids"] == public.encode(text or "")
        assert got[i]["n_tokens"] == len(got[i]["ids"]) and got[i]["round_trip"]
        assert back[i]["text"] == (text or "")
    marked = encode_texts(docs(spark, ["a▁b"])).first()
    assert not marked.round_trip


def test_empty_table_repeated_rows_and_extra_columns(spark):
    assert encode_texts(docs(spark, [])).count() == 0
    clash = docs(spark, [(1, "a b"), (1, "a b"), (None, None)]).withColumn("ids", F.lit("x")).withColumn("id", F.lit(3))
    got = encode_texts(clash).collect()
    assert sorted(len(r.ids) for r in got) == [0, 2, 2] and {r.doc_id for r in got} == {1, None}


def test_long_runs_of_tied_pieces_are_merged_like_the_library(spark):
    import sentencepiece

    from paraspark.llm import sentencepiece_fst as S
    with open(S.MODEL_PATH, "rb") as f:
        model = S.Transducer(f.read())
    library = sentencepiece.SentencePieceProcessor(model_file=S.MODEL_PATH)
    for text in (" " * 5000 + "a", "a" + " " * 777 + "b" + " " * 17, " \n" * 300):
        assert model.encode(text).tolist() == library.encode(text)
    assert len(model.encode(" " * 100_000)) < 10_000


def test_segments_searched_side_by_side_take_the_path_of_each():
    with open(S.MODEL_PATH, "rb") as f:
        raw = f.read()
    model, alone = S.Transducer(raw), S.Transducer(raw)
    cache, rng = S._Cache(model), random.Random(9)
    pieces = list(model.vocabulary)
    segments = {"".join(rng.choice(pieces) for _ in range(rng.randint(1, 5)))[:rng.randint(1, 60)] for _ in range(1000)}
    segments |= {"".join(rng.choice("abdeinst▁éß漢\0\U0001f600") for _ in range(rng.randint(1, 70))) for _ in range(1000)}
    cache.fill(segments)
    assert len(cache) > 1000 and not model.known        # no pair was tried by itself
    for x in segments:
        assert cache[x] == S.array("i", alone.path(x)).tobytes()
    texts = ["", "one two  three\n\nfour", "▁ \0 漢字 \U0001f600 " + "a" * 500, *segments]
    for t, ids in zip(texts, model.encode_all(texts, cache), strict=True):
        assert ids.tolist() == alone.encode(t).tolist()
