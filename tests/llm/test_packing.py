import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from fixtures import awkward_rows, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from groundline.llm import packing
from groundline.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2]


def test_word_ids_equal_whole_text_ids():
    rng = random.Random(3)
    letters = "aAbBéÉßœÿıİΣσςñ.,!?'#|$*0129²½ \t\n\r\x0b\x0c\x1c\x85\xa0 　日本éªº<>|end-​\U0001f600"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += [None, "", "<|endoftext|>", "a<|endoftext|>b.", "x" * 500, "don't I'M", "<|startoftext|>Hi!"]
    ids, bounds = Encoder(PATH).of_texts(pa.array(texts, pa.string()))
    whole = Tokenizer.from_file(PATH)
    for n, text in enumerate(texts):
        assert ids[bounds[n] : bounds[n + 1]].tolist() == whole.encode(text or "", add_special_tokens=False).ids


def test_a_full_word_table_is_emptied(monkeypatch):
    monkeypatch.setattr("groundline.llm.tokens.KNOWN_WORDS", 5)
    encoder = Encoder(PATH)
    for text in ("a b c d", "e f g h", "a b c d"):
        ids, _ = encoder.of_texts(pa.array([text]))
        assert ids.tolist() + [2] == ids_of(text)


@given(st.lists(st.integers(1, 64), max_size=80))
@settings(max_examples=60, deadline=None)
def test_best_fit_equals_a_plain_search(sizes):
    sizes = sorted(sizes, reverse=True)
    windows, offsets = packing.best_fit_decreasing(sizes, 64)
    room: list[int] = []
    for size, window, offset in zip(sizes, windows, offsets, strict=True):
        fits = [r for r in room if r >= size]
        if fits:
            assert room[window] == min(fits)
        else:
            assert window == len(room)
            room.append(64)
        assert offset == 64 - room[window]
        room[window] -= size


def test_every_id_lies_in_one_piece_and_sequences_have_no_gaps(spark):
    docs = documents(spark).withColumn("offset", F.lit("clash")).withColumn("sequence_id", F.lit("clash"))
    pieces = packing.token_pieces(docs, PATH, 2, window=256).withColumn("ids_crc32", F.crc32("ids"))
    rows = packing.pack(pieces, 3, ["doc_id", "start", "ids_crc32"], window=256).collect()
    by_doc = {}
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id in {r[0] for r in awkward_rows()}:
        want = sorted(ids_of(r[1]) for r in awkward_rows() if r[0] == doc_id)
        got = sorted(by_doc[doc_id], key=lambda r: (r.doc_tokens, bytes(r.ids) if not r.start else b"", r.start))
        assert sum(r.length for r in got) == sum(map(len, want))
        if len(want) == 1:
            got = sorted(got, key=lambda r: r.start)
            assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in got]).tolist() == want[0]
            assert [r.start for r in got] == list(range(0, len(want[0]), 256))
            assert {r.doc_tokens for r in got} == {len(want[0])}
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
    assert sum(r.length for r in rows) / (256 * len(sequences)) > 0.9
    whole = packing.sequences(packing.pack(pieces, 3, ["doc_id", "start", "ids_crc32"], window=256)).collect()
    assert len(whole) == len(sequences) and all(len(w.ids) == 4 * w.length for w in whole)


def test_no_documents_and_wrong_lengths(spark):
    empty = packing.token_pieces(documents(spark, []), PATH, 2)
    assert packing.pack(empty.drop("ids"), 1, ["doc_id", "start"]).count() == 0
    with pytest.raises(Exception, match="piece lengths"):
        packing.pack(spark.sql("SELECT 1L AS doc_id, 0L AS start, 5000L AS length"), 1, ["doc_id"]).collect()
