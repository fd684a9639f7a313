from __future__ import annotations

import random

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from touchline.llm import pieces
from touchline.llm.texts import map_rows

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BITS = ["a", "the", " ", "  ", "   ", "\n", "\t", "é", "漢", "😀", "▁", "t", " th", "<s>", "</s>", "<0x41>", "xxxxx", "ß", "　",
        " " * 17, " " * 30, "1", "23", ".", ",,", "Zw"]


def random_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_ids_equal_the_library_and_decode_back(monkeypatch):
    monkeypatch.setattr(pieces, "STEADY_UNITS", 500)
    monkeypatch.setattr(pieces, "FRESH_UNITS", 200)
    texts = random_texts(4000)
    codec = pieces.Codec(MODEL, 1)
    ids = []
    for at in range(0, len(texts), 250):
        part, agree = codec.encode(texts[at: at + 250])
        assert all(agree)
        ids += part
    other = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert ids == other.encode(texts)
    assert codec.decode(ids) == [t.replace("▁", " ") for t in texts] == codec.tok.decode_batch(ids, skip_special_tokens=False)


def test_bad_bytes_go_to_the_library():
    codec = pieces.Codec(MODEL, 1)
    lists = [[3 + 0xC3, 3 + 0x28], [3 + 0xFF], [], [300, 3 + 0xE2]]
    assert codec.decode(lists) == codec.tok.decode_batch(lists, skip_special_tokens=False)
    with pytest.raises(ValueError):
        codec.decode([[10 ** 6]])


def unigram_model(path):
    m = pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback, m.trainer_spec.unk_id = 1, True, 0
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = True, False
    m.pieces.add(piece="<unk>", score=0, type=2)
    for b in range(256):
        m.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    for n, p in enumerate(["▁", "a", "b", "c", "▁a", "ab", "abc", "▁ab", "bc", "ca", "cab", "▁c"]):
        m.pieces.add(piece=p, score=-1.0 - 0.37 * n, type=1)
    path.write_bytes(m.SerializeToString())
    return str(path)


def test_unigram_scores_and_byte_fallback(tmp_path):
    path = unigram_model(tmp_path / "u.model")
    rng = random.Random(1)
    texts = ["".join(rng.choice("aaabbbccc  zé\n") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    codec = pieces.Codec(path, 1)
    assert codec.model.kind == pieces.UNIGRAM
    ids, _ = codec.encode(texts)
    assert ids == sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)
    assert codec.decode(ids) == texts


def test_not_a_model_is_an_error():
    with pytest.raises(ValueError):
        pieces.parse_model(b"\x0a\xff\xff\xff\x01 cut off")


def test_table_cases(spark, docs_of):
    long = "Übung macht den Meister. " * 20_000
    rows = [(1, None), (2, ""), (3, "a  b"), (3, "a  b"), (None, "x"), (5, long)]
    df = pieces.encoded_pieces(docs_of(rows), MODEL)
    got = sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [(r.doc_id, r.ids is None, r.parity, r.round_trip) for r in got] == [
        (1, True, None, None), (2, False, True, True), (3, False, True, True), (3, False, True, True), (5, False, True, True), (None, False, True, True)]
    assert all(r.n_tokens == len(r.ids or []) for r in got)
    back = {r.doc_id: r.text for r in pieces.decoded_texts(df, MODEL).collect()}
    assert back == {1: None, 2: "", 3: "a  b", None: "x", 5: long}
    assert pieces.encoded_pieces(docs_of(rows).limit(0), MODEL).count() == 0


def test_tasks_of_a_worker_share_one_codec(spark, docs_of, tmp_path):
    """Many small tasks build and teach a codec once per worker, so memory does not grow with their number."""
    import shutil

    own = str(tmp_path / "own.model")
    shutil.copy(MODEL, own)
    texts = random_texts(300)
    got = {r["doc_id"]: r["ids"] for r in pieces.encoded_pieces(docs_of(list(enumerate(texts))).repartition(60), own).collect()}
    other = sentencepiece.SentencePieceProcessor(model_file=own)
    assert got == dict(enumerate(other.encode(texts)))

    def look(it):
        import os

        if list(it):
            held = pieces._built.cache_info()
            yield os.getpid(), held.misses, held.hits

    seen = map_rows(spark.range(40).repartition(40), look, "pid long, misses long, hits long", keeps=True).distinct().collect()
    # Other tests' models count as misses too; not every worker of the job comes again.
    assert any(r["hits"] for r in seen) and sum(r["hits"] for r in seen) > sum(r["misses"] for r in seen), seen

    # A task of another kind drops it, so that no other stage runs beside it.
    seen = map_rows(spark.range(40).repartition(40), look, "pid long, misses long, hits long").distinct().collect()
    assert not any(r["hits"] or r["misses"] for r in seen), seen
