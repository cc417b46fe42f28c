"""Token ids in binary files of bit or byte planes.

A file's table has one row a chunk: shard, chunk, n_ids and a payload. Shards are in
ascending order of document ids, chunks in order within a shard, so ids in (shard,
chunk) order are the corpus in ascending doc_id order. A payload holds whole documents:

    magic "QPL1", plane width in bits (1 or 8), block size, documents, ids, blocks
    documents: ids (int64), null flags (uint8), numbers of ids (uint32)
    chunk index: for each block its number of ids and the length of each plane (uint32)
    planes: for each block the planes of its 32-bit ids, lowest first, each in zstandard

All numbers are little-endian. A plane of one bit or byte of all ids of a block is far
more regular than the ids; the upper ones are nearly empty.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .shingles import chunks, span_hashes, text_buffer, word_bounds

MAGIC = b"QPL1"
BLOCK = 1 << 16
#: Ids of a chunk: it ends with the document that reaches them.
CHUNK_IDS = 1 << 20


def planes_of(ids: np.ndarray, width: int) -> list[bytes]:
    """The bit (width 1) or byte (width 8) planes of 32-bit ids, lowest first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if width == 8:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def ids_of(planes: list[bytes], n: int, width: int) -> np.ndarray:
    if width == 8:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


def pack_chunk(docs: list[int | None], lengths: np.ndarray, ids: np.ndarray, width: int = 8, block: int = BLOCK, level: int = 3) -> bytes:
    squeeze = zstandard.ZstdCompressor(level=level)
    index, body = [], []
    for at in range(0, len(ids), block):
        part = ids[at : at + block]
        planes = [squeeze.compress(p) for p in planes_of(part, width)]
        index.append([len(part), *map(len, planes)])
        body += planes
    head = struct.pack("<4sIIIQI", MAGIC, width, block, len(docs), len(ids), len(index))
    table = np.array([d or 0 for d in docs], "<i8").tobytes() + np.array([d is None for d in docs], np.uint8).tobytes() + lengths.astype("<u4").tobytes()
    return b"".join((head, table, np.array(index, "<u4").tobytes(), *body))


def unpack_chunk(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, numbers of ids, ids."""
    magic, width, _, n_docs, n_ids, n_blocks = struct.unpack_from("<4sIIIQI", payload)
    if magic != MAGIC:
        raise ValueError("not a chunk of token ids")
    at = struct.calcsize("<4sIIIQI")
    docs = np.frombuffer(payload, "<i8", n_docs, at)
    null = np.frombuffer(payload, np.uint8, n_docs, at + 8 * n_docs)
    lengths = np.frombuffer(payload, "<u4", n_docs, at + 9 * n_docs).astype(np.int64)
    at += 13 * n_docs
    planes = 32 // width
    index = np.frombuffer(payload, "<u4", n_blocks * (planes + 1), at).reshape(-1, planes + 1)
    at += 4 * index.size
    open_ = zstandard.ZstdDecompressor()
    out = [np.empty(0, np.uint32)]
    for n, *sizes in index.tolist():
        part = []
        for size in sizes:
            part.append(open_.decompress(payload[at : at + size]))
            at += size
        out.append(ids_of(part, n, width))
    ids = np.concatenate(out)
    if len(ids) != n_ids or int(lengths.sum()) != n_ids:
        raise ValueError("chunk of token ids is damaged")
    return [None if z else d for d, z in zip(docs.tolist(), null.tolist(), strict=True)], lengths, ids


class Numbers:
    """Numbers, from 0 on, of 64-bit hashes in order of arrival: an open-addressing table in arrays."""

    def __init__(self, bits: int):
        self.mask, self.n = np.uint64((1 << bits) - 1), 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for those that aren't in."""
        slot = (h & self.mask).astype(np.int64)
        out = self.values[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != h))
        while len(todo):
            slot[todo] = slot[todo] + 1 & int(self.mask)
            out[todo] = self.values[slot[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[slot[todo]] != h[todo])]
        return out

    def add(self, h: np.ndarray) -> None:
        """Numbers distinct hashes that aren't in."""
        slot = (h & self.mask).astype(np.int64)
        todo = np.arange(len(h))
        number = np.arange(self.n, self.n + len(h), dtype=np.int32)
        while len(todo):
            free = self.values[slot[todo]] < 0
            at = todo[free]
            self.values[slot[at]] = number[at]  # of several for one slot, the last has it
            won = np.zeros(len(todo), bool)
            won[free] = self.values[slot[at]] == number[at]
            self.keys[slot[todo[won]]] = h[todo[won]]
            todo = todo[~won]
            slot[todo] = slot[todo] + 1 & int(self.mask)
        self.n += len(h)


#: A pre-tokenizer that keeps runs of letters and of signs apart; white space goes.
LETTERS_AND_SIGNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Signs next to which a cut changes nothing: not the apostrophe of contractions, nor those of special tokens.
_SIGN = np.zeros(256, bool)
_SIGN[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")] = True


#: White space that pre-tokenizers drop, and normalizers that work within words, or on runs of white space, alone.
_DROPS = ("Whitespace", "WhitespaceSplit", "BertPreTokenizer")
_INNER = ("NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents")


def splits_at_white_space(rules: dict) -> bool:
    """Whether a tokenizer, given by its rules, encodes what stands between white space on its own."""
    first, normalizer = rules.get("pre_tokenizer") or {}, rules.get("normalizer") or {"type": "Sequence", "normalizers": []}
    if first.get("type") == "Sequence":
        first = (first["pretokenizers"] or [{}])[0]
    steps = normalizer["normalizers"] if normalizer["type"] == "Sequence" else [normalizer]
    squeezes = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    keeps = {"type": "Split", "pattern": {"Regex": LETTERS_AND_SIGNS}, "behavior": "Removed", "invert": True}
    return (first.get("type") in _DROPS or first == keeps) and all(s["type"] in _INNER or s == squeezes for s in steps)


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of so many places for each start, in a row."""
    before = np.concatenate(([0], np.cumsum(sizes)))
    return np.repeat(starts - before[:-1], sizes) + np.arange(before[-1])


def appended(bounds: np.ndarray, store: np.ndarray, n: int, sizes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """bounds and store, grown where needed, with entries of these sizes put behind the first n."""
    end = int(bounds[n])
    while n + len(sizes) + 1 > len(bounds):
        bounds = np.concatenate((bounds, np.zeros_like(bounds)))
    while end + len(values) > len(store):
        store = np.concatenate((store, np.zeros_like(store)))
    store[end : end + len(values)] = values
    bounds[n + 1 : n + 1 + len(sizes)] = end + np.cumsum(sizes)
    return bounds, store


class WordEncoder:
    """A tokenizer whose text is cut into words without changing its ids.

    That holds for tokenizers whose pre-tokenizer drops white space, as the word
    vocabulary's does: what stands between white space is then encoded on its own. Others
    (by_words is false) encode whole texts with the library. If the pre-tokenizer also
    keeps letters and signs apart, words are cut between these too, and if it lowers
    case, A-Z count as a-z. Words are found for a whole part of a column at once, looked up
    by 64-bit hashes and compared byte by byte with the word remembered; a text with a word
    that differs is encoded by the library. The library encodes each distinct word once,
    and ids are put together from these. Words remembered are bounded by `most`; past that
    they start afresh.

    Distinct words go to the library many in one text: those of letters between spaces,
    told apart again by the vocabulary's end-of-word tokens, others between a special
    token; words that hold that token's sign, or come out uneven, on their own.
    """

    def __init__(self, path: str, most: int = 2_000_000, bits: int = 22):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.bits = Tokenizer.from_file(path), min(most, 1 << bits - 1), bits
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[k for w, k in vocabulary.items() if w.endswith("</w>")]] = True
        special = [(k, t.content) for k, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        self.special = min(special, default=None)
        rules = json.loads(self.tokenizer.to_str())
        self.by_words = splits_at_white_space(rules)
        self.cuts = LETTERS_AND_SIGNS in json.dumps(rules["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\")
        self.lowers = '"Lowercase"' in json.dumps(rules["normalizer"])
        self.forget()

    def forget(self) -> None:
        self.numbers = Numbers(self.bits)
        self.arena = np.zeros(1 << 20, np.uint32)
        self.bounds = np.zeros(1 << 18, np.int64)
        self.bytes = np.zeros(1 << 20, np.uint8)  # of the words, by number
        self.byte_bounds = np.zeros(1 << 18, np.int64)

    def ids_of_text(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def ids_of_words(self, words: list[bytes], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of the words, and all their ids."""
        text = [w.decode("utf-8", "surrogatepass") for w in words]
        if plain and self.last.any():
            ids = self.ids_of_text(" ".join(text))
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(words) and ends[-1] == len(ids):
                return np.diff(ends, prepend=0), ids
        if self.special and not any(self.special[1][:1] in t for t in text):
            ids = self.ids_of_text(self.special[1].join(text))
            cuts = np.flatnonzero(ids == self.special[0])
            if len(cuts) == len(words) - 1:
                return np.diff(np.concatenate(([-1], cuts, [len(ids)]))) - 1, ids[ids != self.special[0]]
        each = [e.ids for e in self.tokenizer.encode_batch_fast(text, add_special_tokens=False)]
        return np.array([len(e) for e in each], np.int64), np.array([x for e in each for x in e], np.uint32)

    def learn(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        """Encodes and remembers distinct new words."""
        count = lambda mask: np.concatenate(([0], np.cumsum(mask)))
        ascii_, letters = count(_LETTER[raw]), count(_LETTER[raw] | (raw >= 128))
        sizes = ends - starts
        kind = (ascii_[ends] - ascii_[starts] == sizes).astype(int) + (letters[ends] - letters[starts] == sizes)
        text = raw.tobytes()
        for of in range(3):
            of_kind = np.flatnonzero(kind == of)
            for k in range(0, len(of_kind), 2000):
                at = of_kind[k : k + 2000]
                sizes, ids = self.ids_of_words([text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], of > 0)
                own = raw[runs(starts[at], ends[at] - starts[at])]
                self.bounds, self.arena = appended(self.bounds, self.arena, self.numbers.n, sizes, ids)
                self.byte_bounds, self.bytes = appended(self.byte_bounds, self.bytes, self.numbers.n, ends[at] - starts[at], own)
                self.numbers.add(hashes[at])

    def differs(self, numbers: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bool:
        """Whether a word isn't the one that its number stands for."""
        at, sizes = self.byte_bounds[numbers], ends - starts
        return not np.array_equal(self.byte_bounds[numbers + 1] - at, sizes) or not np.array_equal(self.bytes[runs(at, sizes)], raw[runs(starts, sizes)])

    def whole_texts(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and ids of the texts, each encoded by the library in one piece."""
        rows = [np.append(self.ids_of_text(t or ""), np.uint32(end)) for t in column.to_pylist()]
        return np.array([len(r) for r in rows], np.int64), np.concatenate(rows) if rows else np.empty(0, np.uint32)

    def encode(self, column: pa.Array, end: int):
        """For parts of a string column: (rows from, to, ids of each row, all ids); each text has the id `end` appended."""
        offsets, data = text_buffer(column)
        for first, last in chunks(offsets):
            low, high = int(offsets[first]), int(offsets[last])
            if not self.by_words:
                yield first, last, *self.whole_texts(column.slice(first, last - first), end)
                continue
            raw, bounds = data[low:high], offsets[first : last + 1] - low
            if low == high:
                yield first, last, np.ones(last - first, np.int64), np.full(last - first, end, np.uint32)
                continue
            if self.lowers and not (raw == 60).any():  # "<": special tokens keep their case
                raw = raw + (((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5)
            cuts = np.zeros(len(raw) + 1, bool)
            if self.cuts:
                letter, sign = _LETTER[raw], _SIGN[raw]
                cuts[1:-1] = letter[:-1] & sign[1:] | sign[:-1] & letter[1:]
            starts, ends = word_bounds(raw, bounds, cuts)
            hashes = span_hashes(raw, starts, ends)
            at = self.numbers.find(hashes)
            if (at < 0).any():
                new, where = np.unique(hashes[at < 0], return_index=True)
                if self.numbers.n + len(new) > self.most:
                    self.forget()
                    new, where = np.unique(hashes, return_index=True)
                else:
                    where = np.flatnonzero(at < 0)[where]
                self.learn(raw, starts[where], ends[where], new)
                at = self.numbers.find(hashes)
            if self.differs(at, raw, starts, ends):
                yield first, last, *self.whole_texts(column.slice(first, last - first), end)
                continue
            begin = self.bounds[at]
            sizes = self.bounds[at + 1] - begin
            before = np.concatenate(([0], np.cumsum(sizes)))
            ends_at = before[np.searchsorted(starts, bounds)]
            # The words' ids in a row, with the end id of each text put in.
            source = runs(begin, sizes)
            ids = np.insert(self.arena[source], ends_at[1:], np.uint32(end))
            yield first, last, np.diff(ends_at) + 1, ids


_encoders: dict[str, WordEncoder] = {}


def write_tokens(docs: DataFrame, tokenizer: str, end: int = 2, width: int = 8, block: int = BLOCK, chunk_ids: int = CHUNK_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts and writes token files in ascending doc_id order. Returns the
    written table (shard, chunk, n_ids, payload).

    Null text: as empty, which is the end id alone. Null ids come first; rows that share
    an id follow each other in the order of their texts' checksums. Very long texts: a
    chunk of their own size. Empty table: no chunks. Other columns are ignored.
    """

    def encode(batches):
        encoder = _encoders.setdefault(tokenizer, None) or WordEncoder(tokenizer)
        _encoders[tokenizer] = encoder
        shard, chunk = TaskContext.get().partitionId(), 0
        names, lengths, parts, held = [], [], [], 0

        def flush():
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "chunk": pa.array([chunk], pa.int32()), "n_ids": pa.array([held], pa.int64()), "payload": pa.array([pack_chunk(names, np.concatenate(lengths), np.concatenate(parts), width, block)], pa.binary())})

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, last, n, ids in encoder.encode(batch.column(1), end):
                names += keys[first:last]
                lengths.append(n)
                parts.append(ids)
                held += len(ids)
                if held >= chunk_ids:
                    yield flush()
                    chunk += 1
                    names, lengths, parts, held = [], [], [], 0
        if names:
            yield flush()

    # Rows of one id, null or not, are dealt over as many shards as they fill: by their texts' checksums, and equal ones by place.
    order = (F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("sum"), F.monotonically_increasing_id().alias("place"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *order)
    rows = rows.repartitionByRange("doc_id", "sum", "place").sortWithinPartitions("doc_id", "sum", "place").select("doc_id", "text")
    return written(rows.mapInArrow(encode, "shard int, chunk int, n_ids long, payload binary"), "tokens", "none")


def read_tokens(files: DataFrame) -> DataFrame:
    """Reads token files back. Returns for each document: doc_id, start (ids of all
    documents before it), n_tokens and ids_crc32 (of its ids as 32-bit little-endian)."""

    def decode(batches):
        for batch in batches:
            for shard, chunk, payload in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                docs, lengths, ids = unpack_chunk(payload)
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lengths)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                n = len(docs)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard, np.int32)), pa.array(np.full(n, chunk, np.int32)), pa.array(docs, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], ["shard", "chunk", "doc_id", "inside", "n_tokens", "ids_crc32"])

    sizes = files.select("shard", "chunk", "n_ids")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(earlier(Window.orderBy("shard"))), F.lit(0)))  # one row a shard
    starts = sizes.join(shards.drop("n"), "shard").select("shard", "chunk", (F.col("ahead") + F.coalesce(F.sum("n_ids").over(earlier(Window.partitionBy("shard").orderBy("chunk"))), F.lit(0))).alias("base"))
    rows = files.select("shard", "chunk", "payload").mapInArrow(decode, "shard int, chunk int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["shard", "chunk"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
