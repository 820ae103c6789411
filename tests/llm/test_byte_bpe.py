"""Byte-level BPE against the library that reads rank files, offsets against bytes, and decoding of cut pieces."""
import hashlib
import random

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from fixtures import awkward, frame

from firmground.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def ids_of(x):
    return np.frombuffer(x, "<u4").tolist()


def random_texts(rng, n):
    alphabets = ["ab", "a-=", "  \n\t", "ha", "xyé中\U0001f600", "0123 ½", "-_=*. ", "aeinrst '", "дорогие ", "ılığ", "'s're'LL", "\x1c\x85\xa0 　x", "한국어 ́"]
    for _ in range(n):
        a = rng.choice(alphabets) + (rng.choice(alphabets) if rng.random() < 0.5 else "")
        s = "".join(rng.choice(a) for _ in range(rng.randrange(0, 60)))
        yield s[:1] * rng.randrange(1, 200) + s if rng.random() < 0.3 else s


def test_ids_are_those_of_the_rank_library():
    coder, rng = byte_bpe.Coder(PATH, most=3000), random.Random(1)
    texts = list(random_texts(rng, 6000))
    for at in range(0, len(texts), 100):
        some = texts[at:at + 100]
        ids, bounds, starts, ends = coder.encode(some)
        assert [ids[bounds[i]:bounds[i + 1]].tolist() for i in range(len(some))] == PLAIN.encode_ordinary_batch(some)
        for i, t in enumerate(some):
            of_byte = np.repeat(np.arange(len(t)), [len(c.encode()) for c in t])
            size = [len(PLAIN.decode_single_token_bytes(k)) for k in ids[bounds[i]:bounds[i + 1]]]
            last = np.cumsum(size)
            assert starts[bounds[i]:bounds[i + 1]].tolist() == [of_byte[e - n] for e, n in zip(last, size)]
            assert ends[bounds[i]:bounds[i + 1]].tolist() == [of_byte[e - 1] + 1 for e in last]


def test_every_character():
    coder = byte_bpe.Coder(PATH)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(points[at:at + 500]) for at in range(0, len(points), 500)] + [" a".join(points[at:at + 200]) for at in range(0, 0x3000, 200)]
    ids, bounds, _, _ = coder.encode(texts)
    wrong = [i for i, want in enumerate(PLAIN.encode_ordinary_batch(texts)) if ids[bounds[i]:bounds[i + 1]].tolist() != want]
    assert not wrong


def test_on_spark(spark):
    texts = awkward() + [(100 + i, t) for i, t in enumerate(random_texts(random.Random(2), 300))] + [(999, "x" * 200_000)]
    docs = frame(spark, texts).repartition(3)
    encoded = byte_bpe.encode(docs, PATH, keep=("doc_id", "text", "n"))
    got = byte_bpe.decode(encoded, PATH, keep=("doc_id", "text", "n_tokens", "ids", "n_split", "starts", "ends")).collect()
    assert sorted((repr(r.doc_id), r.text or "") for r in got) == sorted((repr(i), t or "") for i, t in texts)
    for r in got:
        assert ids_of(r.ids) == PLAIN.encode_ordinary(r.text or "") and r.n_tokens == len(ids_of(r.ids))
        assert bytes(r.data) == (r.text or "").encode()
        starts, ends = ids_of(r.starts), ids_of(r.ends)
        assert r.n_split == sum(a < b for a, b in zip(starts[1:], ends)) and (not ends or ends[-1] == len(r.text))
    assert any(r.n_split for r in got)
    assert byte_bpe.encode(docs.limit(0), PATH).count() == 0 and byte_bpe.decode(encoded.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.encode(docs.withColumnRenamed("n", "ids"), PATH, keep=("ids",))
    odd = spark.createDataFrame([(1, None), (2, b""), (3, np.array([2**32 - 1, 50255, 60_000], "<u4").tobytes())], "doc_id long, ids binary")
    assert {r.doc_id: bytes(r.data) for r in byte_bpe.decode(odd, PATH).collect()} == {1: b"", 2: b"", 3: PLAIN.decode_single_token_bytes(50255)}


def test_pieces_cut_inside_characters(spark):
    text = "a中\U0001f600é文b" * 3 + "\U0001f9ff\U00013000"
    ids = PLAIN.encode_ordinary(text)
    rng = random.Random(4)
    for size in (1, 2, 3):
        pieces = [(5, at, np.array(ids[at:at + size], "<u4").tobytes()) for at in range(0, len(ids), size)] + [(6, 0, b"")]
        rng.shuffle(pieces)
        table = spark.createDataFrame(pieces, "doc_id long, start long, ids binary")
        joined = {r.doc_id: r.text for r in byte_bpe.decode_pieces(table, PATH).collect()}
        assert joined == {5: text, 6: ""}
        parts = byte_bpe.whole_characters(byte_bpe.decode(table, PATH, keep=("doc_id", "start"))).orderBy("doc_id", "start").collect()
        assert b"".join(bytes(r.head) + r.text.encode() + bytes(r.tail) for r in parts) == text.encode()
        assert all("�" not in r.text for r in parts)


def test_query_against_the_rank_library(spark):
    from firmground.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    got = QUERIES["op12_byte_bpe"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = PLAIN.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
