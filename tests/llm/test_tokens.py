import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from labelvec.llm import bpe, token_counts

BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "aabbccddeehhtt   \n\t'stre0123é中ΣσİǅA<|>endoftext́\x85\xa0　\x1c!$%▁😀\x00"


@pytest.fixture(scope="module")
def texts(odd_rows):
    rng = random.Random(4)
    out = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(90))) for _ in range(1500)]
    out += ["a" * k + " " * k for k in range(0, 300, 13)] + [" " * k for k in range(20)]
    out += ["<|endoftext|>", "a<|startoftext|><|endoftext|>b", "e<|endoftext|>́", "<s></s><unk>", "ab▁ c ▁▁d", "ahahahahah aaaaaaa"]
    out += ["".join(rng.choice("abcdehtinr") for _ in range(40_000)), None]
    return out + [r[1] for r in odd_rows]


def test_bpe_equals_the_library(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    library = Tokenizer.from_file(BPE)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    got = bpe.decode(bpe.encode(docs, BPE), BPE).collect()
    assert {r.doc_id: r.ids for r in got} == want
    assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in got)
    for r in bpe.round_trip_digests(docs, BPE).collect():
        ids = b"".join(i.to_bytes(4, "little") for i in want[r.doc_id])
        text = library.decode(want[r.doc_id], skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(want[r.doc_id]), hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_groups_of_any_size_agree(spark, texts, monkeypatch):
    import pyarrow as pa

    batch = pa.record_batch([pa.array(range(200)), pa.array(texts[:200])], names=["doc_id", "text"])

    def ids():
        return [i for b in bpe._encode(BPE)([batch]) for i in b.column("ids").to_pylist()]

    whole = ids()
    monkeypatch.setattr(bpe, "GROUP_BYTES", 500)
    assert ids() == whole and len(whole) == 200


def test_token_counts_equal_the_library(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = {i: len(library.encode(t or "")) for i, t in enumerate(texts)}
    got = token_counts.token_counts(docs, PIECES, limit=100).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.n_bytes == len((texts[r.doc_id] or "").encode()) and r.over_limit == (r.n_tokens > 100) for r in got)


def test_chunks_of_any_size_give_the_same_states(texts, monkeypatch):
    import numpy as np

    data = np.frombuffer(" ".join(t or "" for t in texts[:300]).encode(), np.uint8)
    starts = token_counts.unit_starts(data, np.array([0, len(data)]), token_counts.pieces_of(PIECES).alone)
    starts = np.union1d(starts, [0])
    whole = token_counts.unit_states(data, starts)
    for size in (1, 3, 64, 1000):
        monkeypatch.setattr(token_counts, "CHUNK", size)
        assert (token_counts.unit_states(data, starts) == whole).all()


def test_no_rows(nothing):
    assert bpe.encode(nothing, BPE).count() == bpe.round_trip_digests(nothing, BPE).count() == 0
    assert token_counts.token_counts(nothing, PIECES).count() == 0
