"""Byte-level BPE against the tiktoken library."""

import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken

from lethe.llm import byte_bpe as B

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(1)
    letters = "aé ñ\x1c\x1d\x1e\x1f\x85\xa0​ 's\n\t12Ⅷ½ß漢字🙂👨‍<|endoftext|>'llTHE"
    rows = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(800)]
    return rows + ["", " ", "\n\n  x", "a" * 3000, "ab " * 2000, "é漢" * 900, "thetheing" * 80, "don't 'S 'll"]


def test_encoder_equals_library(library):
    enc = B.Encoder(B.load_ranks(PATH), P.PATTERN)
    rows = texts()
    assert [x.tolist() for x in enc.encode_batch(rows)] == [library.encode_ordinary(t) for t in rows]
    assert all(enc.decode(ids) == t.encode() for t, ids in zip(rows, enc.encode_batch(rows)))


def test_long_pieces_equal_the_library(library):
    """Pieces of 100,000 bytes, and such around a block's size, by the rounds of all others."""
    r = random.Random(2)
    enc = B.Encoder(B.load_ranks(PATH), P.PATTERN)
    rows = ["a" * 100_000, "".join(r.choice("etaoinshrdlu") for _ in range(100_000)), "é漢" * 20_000]
    rows += ["".join(r.choice("etaoinab") for _ in range(n)) for n in (511, 512, 513, 640, 1023, 1024, 1025, 5000)]
    for t, ids in zip(rows, enc.encode_batch(rows)):
        assert ids.tolist() == library.encode_ordinary(t)


def test_memory_is_bounded(library, monkeypatch):
    monkeypatch.setattr(B, "REMEMBERED", 50)
    enc = B.Encoder(B.load_ranks(PATH), P.PATTERN)
    for t in texts()[:60]:
        assert enc.encode_batch([t])[0].tolist() == library.encode_ordinary(t)
    assert len(enc.known) < 120


def test_query_rows(spark, library):
    rows = [(i, t) for i, t in enumerate(texts()[-30:])] + [(None, "null id"), (777, None), (777, "again"), (777, "again")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, B.encode_decode(docs, PATH, P.PATTERN).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    ids = B.encode_decode(docs, PATH, P.PATTERN, with_ids=True).where("doc_id = 777 and n_tokens > 0").first().ids
    assert ids == library.encode_ordinary("again")
    assert B.encode_decode(docs.limit(0), PATH, P.PATTERN).collect() == []
