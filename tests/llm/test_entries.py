"""Every registered query over the test tables, against SQL or a plain version of it."""

import hashlib
import os
import re
import zlib
from html import unescape

import numpy as np
import pytest

import corpus_pipeline
from quillstack.llm import entries, media, packing, webp
from tests.llm import test_jaccard, test_mixing, test_spans

SMALL, LARGER, LARGEST = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test tables")


def rows(spark, name, columns, path=SMALL):
    return [tuple(r) for r in spark.read.parquet(f"{path}/{name}.parquet").select(columns).collect()]


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = entries.queries()[name](spark, SMALL)
    want = con.sql(entries.oracle_sql()[name])
    order = [want.columns.index(c) for c in sorted(want.columns)]
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(tuple(r) for r in df.select(sorted(df.columns)).collect()) == sorted(tuple(r[i] for i in order) for r in want.fetchall())


def test_op1(spark):
    want = {}
    for page, html in rows(spark, "pages", ["page_id", "html"]):
        article = re.search(r"<article>(.*?)</article>", html, re.S)[1]
        blocks = (" ".join(unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        want[page] = "\n".join(b for b in blocks if b)
    got = entries.op1_pages(spark, SMALL).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_op2(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for doc, text in sorted(rows(spark, "documents", ["doc_id", "text"])):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in entries.op2_tokenfiles(spark, SMALL).collect()) == want


def test_op3(spark):
    docs = rows(spark, "documents", ["doc_id", "text"])
    assert {r.doc_id: (r.text, r.n_removed) for r in entries.op3_spans(spark, SMALL).collect()} == test_spans.brute(docs, 2, 20)


def check_packing(got, sizes, capacity=2048, limit=3):
    covered, bins = {}, {}
    for r in got:
        assert (r.bin_id is None) == (r.n_words == 0)
        covered.setdefault(r.doc_id, []).append((r.piece, r.start_word, r.n_words))
        if r.n_words:
            bins.setdefault(r.bin_id, []).append(r)
    for doc, pieces in covered.items():
        at = 0
        whole = sorted(pieces)
        for k in range(max(p for p, _, _ in whole) + 1):
            own = {(s, n) for p, s, n in whole if p == k}
            assert len(own) == 1
            s, n = own.pop()
            assert s == at
            at += n
        assert at == sizes[doc]
    for own in bins.values():
        assert sum(r.n_words for r in own) == own[0].bin_words <= capacity
        assert len({r.cluster for r in own}) == len(own)
        assert max(sum(r.source == s for r in own) for s in {r.source for r in own}) <= limit


def test_op6(spark):
    sizes = {d: len((t or "").encode().split()) for d, t in rows(spark, "documents", ["doc_id", "text"])}
    got = entries.op6_packing(spark, SMALL).collect()
    assert {r.doc_id for r in got} == set(sizes)
    check_packing(got, sizes)
    # No bin more than a plain best fit needs over the same pieces, dealt into the same groups.
    groups: dict = {}
    for r in got:
        if r.n_words:
            groups.setdefault(r.bin_id >> 32, []).append(r)
    from tests.llm.test_packing import brute

    for own in groups.values():
        order = sorted(own, key=lambda r: (-r.n_words, r.doc_id, r.piece, r.cluster))
        n = len(brute([(r.n_words, r.doc_id, r.piece, r.cluster, r.source) for r in order], 2048, 3))
        assert abs(len({r.bin_id for r in own}) - n) <= max(2, n // 100)


def test_op7(spark):
    labels = dict(rows(spark, "labels", ["doc_id", "toxic"], LARGER))
    got = {r.doc_id: r for r in entries.op7_toxicity(spark, LARGER).collect()}
    assert len(got) == len(rows(spark, "documents", ["doc_id"], LARGER))
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for d, r in got.items())
    held = [(got[d].predicted, y) for d, y in labels.items() if got[d].held_out]
    assert sum(p for p, y in held if not y) == 0 and sum(p for p, y in held if y) >= 0.8 * sum(y for _, y in held)


@pytest.mark.skipif(not os.path.isdir(LARGEST), reason="no test tables")
def test_op7_held_out(spark):
    """Recall and precision on rows that are not learned from: 92 of 97 and 0.98 when this was written; some labelled texts hold no cue."""
    labels = dict(rows(spark, "labels", ["doc_id", "toxic"], LARGEST))
    held = [(r.predicted, labels[r.doc_id]) for r in entries.op7_toxicity(spark, LARGEST).where("held_out").collect() if r.doc_id in labels]
    caught = sum(p and y for p, y in held)
    assert caught >= 0.9 * sum(y for _, y in held) and caught >= 0.95 * sum(p for p, _ in held)


def test_op8(spark):
    texts = dict(rows(spark, "documents", ["doc_id", "text"]))
    got = entries.op8_webp(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        payload, n = media.payload_of(texts[r.doc_id])
        stored = webp.encode_payload(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        read = b"".join((webp.decode(f) >> 8 & 255).astype(np.uint8).tobytes() for f in webp.files_in(stored))
        assert read == payload  # every file by the decoder of the whole format


def test_op10(spark):
    labels = dict(rows(spark, "labels", ["doc_id", "quality"], LARGER))
    got = {r.doc_id: r for r in entries.op10_quality(spark, LARGER).collect()}
    right = [got[d].kept == (y == 1) for d, y in labels.items()]
    assert len(got) == len(rows(spark, "documents", ["doc_id"], LARGER)) and sum(right) >= 0.97 * len(right)
    assert sum(got[d].kept for d, y in labels.items() if y) >= 0.99 * sum(labels.values())


@pytest.mark.skipif(not os.path.isdir(LARGEST), reason="no test tables")
def test_op10_held_out(spark):
    """Recall and precision for documents whose labels the classifier doesn't see."""
    from pyspark.sql import functions as F

    from quillstack.llm import quality

    labels = spark.read.parquet(f"{LARGEST}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    docs = spark.read.parquet(f"{LARGEST}/documents.parquet")
    got = quality.score_documents(docs, labels.where(~held)).join(labels.where(held), "doc_id").select("kept", labels["quality"].alias("y")).collect()
    kept, good = [r for r in got if r.kept], [r for r in got if r.y == 1]
    right = sum(r.y == 1 for r in kept)
    assert right >= 0.98 * len(good) and right >= 0.98 * len(kept)


def test_pipeline(spark):
    """Each stage against a plain version of it, on what the stage before it kept."""
    from quillstack.llm.common import written

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SMALL), "test")
        kept[name] = docs.collect()
        if name != "best-fit packing":
            assert docs.columns == columns
    first, second, third, mixed, packed = kept.values()
    all_docs = {d: t for d, t in rows(spark, "documents", ["doc_id", "text"])}
    good = {r.doc_id for r in entries.op10_quality(spark, SMALL).where("kept").collect()}
    assert {r.doc_id for r in first} == good and all(all_docs[r.doc_id] == r.text for r in first)
    groups = test_jaccard.brute([(r.doc_id, r.text) for r in first], 5, 80)
    assert {r.doc_id for r in second} == {d for d, c in groups.items() if d == c}
    spans_left = test_spans.brute([(r.doc_id, r.text) for r in second], 2, 20)
    assert {r.doc_id: r.text for r in third} == {d: t for d, (t, n) in spans_left.items() if t or not n}
    words = lambda t: len((t or "").encode().split())
    sizes, took = {}, {}
    for r in third:
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    own = {r.doc_id: r.text for r in third}
    for r in mixed:
        took[r.source] = took.get(r.source, 0) + words(r.text)
        assert own[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    for s, target in test_mixing.fill(sizes).items():
        assert target - 1 < took.get(s, 0) <= target
    assert sum(r.n_words for r in packed) == sum(took.values())
    by_bin: dict = {}
    for r in packed:
        by_bin.setdefault(r.bin_id, []).append(r)
    for b in by_bin.values():
        assert sum(r.n_words for r in b) <= 2048 and len({r.cluster for r in b}) == len(b)
    assert packing.pack(docs.sparkSession.createDataFrame([], "doc_id long, text string, source string")).count() == 0
