"""Token files: exact round trips and the library's own ids."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillstack.llm import tokenfiles

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=30), max_size=8), st.sampled_from([1, 8]))
def test_chunk_round_trip(docs, width):
    ids = np.array([x for d in docs for x in d], np.uint32)
    names = [None if k == 1 else k - 3 for k in range(len(docs))]
    lengths = np.array([len(d) for d in docs], np.int64)
    payload = tokenfiles.pack_chunk(names, lengths, ids, width, block=16)
    got = tokenfiles.unpack_chunk(payload)
    assert got[0] == names and got[1].tolist() == lengths.tolist() and got[2].tolist() == ids.tolist()


def test_damaged_chunk():
    with pytest.raises(ValueError):
        tokenfiles.unpack_chunk(b"XXXX" + b"\0" * 40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40) | st.sampled_from(["Don't STOP's 'll", "é é ́x y\x1cz", "<|endoftext|> a<|startoftext|>b", "ΑΣ ΣΑΣ.", "İI ǅ ﬁ"]), max_size=5))
def test_words_give_the_same_ids(texts):
    import pyarrow as pa

    plain = Tokenizer.from_file(PATH)
    encoder = tokenfiles._encoders.setdefault(PATH, None) or tokenfiles.WordEncoder(PATH)
    tokenfiles._encoders[PATH] = encoder
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    want = [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    got = []
    for _, _, n, ids in encoder.encode(pa.array(texts, pa.string()), 2):
        ends = np.cumsum(n)
        got += [ids[a:b].tolist() for a, b in zip(ends - n, ends, strict=True)]
    assert got == want


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") & 1] for k in range(n))


def ids_by(encoder, texts):
    import pyarrow as pa

    got = []
    for _, _, n, ids in encoder.encode(pa.array(texts, pa.string()), 2):
        ends = np.cumsum(n)
        got += [ids[a:b].tolist() for a, b in zip(ends - n, ends, strict=True)]
    return got


def test_words_of_one_polynomial_hash():
    plain = Tokenizer.from_file(PATH)
    one = thue_morse(2048)
    texts = [one, one.translate(str.maketrans("ab", "ba"))]
    want = [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert want[0] != want[1] and ids_by(tokenfiles.WordEncoder(PATH), texts) == want


def test_words_of_one_hash(monkeypatch):
    plain = Tokenizer.from_file(PATH)
    monkeypatch.setattr(tokenfiles, "span_hashes", lambda b, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    texts = ["one two three", "four five", None, "", "one two four", "six"]
    encoder = tokenfiles.WordEncoder(PATH)
    for _ in range(2):
        assert ids_by(encoder, texts) == [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_tokenizers_that_keep_white_space():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, plain = tokenfiles.WordEncoder(path), Tokenizer.from_file(path)
    texts = ["two  words", " a b\n c", None]
    assert not encoder.by_words and tokenfiles.WordEncoder(PATH).by_words
    assert ids_by(encoder, texts) == [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_write_and_read(spark):
    rows = [(5, "Hello World's end"), (3, None), (None, "first"), (4, ""), (9, "word " * 5000), (5, "Hello World's end"), (7, "é\n\nça va")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    files = tokenfiles.write_tokens(df, PATH, chunk_ids=50)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfiles.read_tokens(files).collect())
    plain, start, want = Tokenizer.from_file(PATH), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((start, doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert tokenfiles.read_tokens(tokenfiles.write_tokens(df.where("false"), PATH)).count() == 0


def test_rows_of_one_id_are_dealt_out(spark):
    rows = [(None, f"word {k} of many " * 20) for k in range(600)] + [(7, "the same text")] * 600
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = tokenfiles.write_tokens(df, PATH).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [len(tokenfiles.unpack_chunk(bytes(f.payload))[0]) for f in files]
    assert sum(sizes) == 1200 and max(sizes) < 600
    got = tokenfiles.read_tokens(tokenfiles.write_tokens(df, PATH)).collect()
    ends = sorted((r.start, r.start + r.n_tokens, r.doc_id is None) for r in got)
    assert all(a[1] == b[0] and a[2] >= b[2] for a, b in zip(ends, ends[1:], strict=False))
