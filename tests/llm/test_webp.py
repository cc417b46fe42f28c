"""Lossless WebP: images written here with each feature of the format, read back by the decoder."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from quillstack.llm import media, webp
from quillstack.llm.webp import GREEN, NEAR, Writer, _joined, _split, _spread


def extend(value):
    """Prefix symbol, extra bits and their number of a length or distance."""
    for symbol in range(40):
        extra = 0 if symbol < 4 else (symbol - 2) >> 1
        for low in (symbol + 1 if symbol < 4 else ((2 + (symbol & 1)) << extra) + 1,):
            if low <= value < low + (1 << extra):
                return symbol, value - low, extra
    raise ValueError(value)


def entropy(out, pixels, width, main, cache_bits=0, copies=False, blocks=None):
    """Writes pixels (flat list of ARGB). blocks: bits of the entropy image's blocks; two groups of codes in a chequered pattern."""
    n = len(pixels)
    out.put(cache_bits > 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    group_at = lambda at: 0
    if main:
        out.put(blocks is not None, 1)
        if blocks is not None:
            height = n // width
            across, down = -(-width >> blocks), -(-height >> blocks)
            groups = [(x + y) & 1 for y in range(down) for x in range(across)]
            out.put(blocks - 2, 3)
            entropy(out, [g << 8 for g in groups], across, False)
            group_at = lambda at: groups[(at // width >> blocks) * across + (at % width >> blocks)]
    tokens, cache, at, last = [], [None] * (1 << cache_bits), 0, {}
    while at < n:
        p, best = pixels[at], 0
        if copies and at in range(1, n) and (d := at - last.get(p, at)):
            best = 1
            while at + best < n and best < 4000 and pixels[at + best] == pixels[at + best - d]:
                best += 1
        slot = (webp.HASH * p & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if best >= 3:
            near = [k + 1 for k, (x, y) in enumerate(NEAR) if max(1, x + y * width) == d]
            tokens.append((group_at(at), "copy", extend(best), extend(near[0] if near else d + 120)))
        elif cache_bits and cache[slot] == p:
            tokens.append((group_at(at), "cache", slot, None))
            best = 1
        else:
            tokens.append((group_at(at), "pixel", p, None))
            best = 1
        for q in pixels[at : at + best]:
            if cache_bits:
                cache[(webp.HASH * q & 0xFFFFFFFF) >> (32 - cache_bits)] = q
            last[q] = at
            at += 1
    count = 2 if blocks is not None else 1
    sizes = (GREEN + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [[np.zeros(s, int) for s in sizes] for _ in range(count)]
    for g, kind, a, b in tokens:
        c = counts[g]
        if kind == "pixel":
            for k, s in ((0, 8), (1, 16), (2, 0), (3, 24)):
                c[k][a >> s & 255] += 1
        elif kind == "cache":
            c[0][GREEN + a] += 1
        else:
            c[0][256 + a[0]] += 1
            c[4][b[0]] += 1
    codes = []
    for c in counts:
        own = []
        for k in c:
            lengths = webp.code_lengths(k if k.any() else np.eye(1, len(k), dtype=int)[0], 15).tolist()
            webp.write_code(out, lengths)
            own.append(({s: (bits, m) for s, m, bits in webp.canonical(lengths)}, sum(map(bool, lengths)) == 1))
        codes.append(own)

    def put(code, symbol):
        if not code[1]:
            out.put(*code[0][symbol])

    for g, kind, a, b in tokens:
        c = codes[g]
        if kind == "pixel":
            for k, s in ((0, 8), (1, 16), (2, 0), (3, 24)):
                put(c[k], a >> s & 255)
        elif kind == "cache":
            put(c[0], GREEN + a)
        else:
            put(c[0], 256 + a[0])
            out.put(a[1], a[2])
            put(c[4], b[0])
            out.put(b[1], b[2])


def image(p, transforms=(), **options):
    """A WebP file of the ARGB array p."""
    out = Writer()
    height, width = p.shape
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)
    rnd = random.Random(1)
    for kind in transforms:
        out.put(1, 1)
        out.put({"predict": 0, "cross": 1, "green": 2, "palette": 3}[kind], 2)
        c = _split(p)
        if kind in ("predict", "cross"):
            bits = 2
            out.put(bits - 2, 3)
            across, down = -(-width >> bits), -(-height >> bits)
        if kind == "predict":
            modes = [k % 14 for k in range(across * down)]
            entropy(out, [m << 8 for m in modes], across, False)
            per = _spread(np.array(modes).reshape(down, across), bits, width, height).ravel().tolist()
            flat = c.reshape(-1, 4).tolist()
            rest = [[(a - b) & 255 for a, b in zip(flat[k], webp.prediction_at(flat, k % width, k // width, width, per[k]), strict=True)] for k in range(len(flat))]
            p = _joined(np.array(rest)).reshape(height, width)
        elif kind == "cross":
            t = np.array([[255, rnd.randrange(256), rnd.randrange(256), rnd.randrange(256)] for _ in range(across * down)])
            entropy(out, _joined(t).tolist(), across, False)
            p = _joined(webp.cross_colour(_spread(t.reshape(down, across, 4), bits, width, height), c, -1))
        elif kind == "green":
            c[..., 1] -= c[..., 2]
            c[..., 3] -= c[..., 2]
            p = _joined(c)
        else:
            colours, index = np.unique(p, return_inverse=True)
            index = index.reshape(p.shape)
            out.put(len(colours) - 1, 8)
            q = _split(colours)
            entropy(out, _joined(np.diff(q, axis=0, prepend=0)).tolist(), len(colours), False)
            pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            each, many = 8 >> pack, 1 << pack
            padded = np.pad(index, ((0, 0), (0, -width % many))).reshape(height, -1, many)
            p = (sum(padded[:, :, k] << (each * k) for k in range(many)) << 8).astype(np.uint32) | np.uint32(0xFF000000)
            width = p.shape[1]
    out.put(0, 1)
    entropy(out, p.ravel().tolist(), width, True, **options)
    stream = out.value.to_bytes(-(-out.n // 8), "little")
    pad = b"\0" * (len(stream) & 1)
    return b"RIFF" + (12 + len(stream) + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream + pad


def picture(colours, width=21, height=13, seed=2):
    rng = np.random.default_rng(seed)
    some = rng.integers(0, 1 << 32, colours, dtype=np.uint32)
    p = some[np.minimum(rng.geometric(0.3, (height, width)) - 1, colours - 1)]
    p[5:8] = p[2:5]
    return p


@pytest.mark.parametrize("transforms", [(), ("predict",), ("cross",), ("green",), ("palette",), ("green", "predict", "cross"), ("predict", "cross", "green"), ("palette", "predict")])
@pytest.mark.parametrize("options", [{}, {"cache_bits": 4}, {"copies": True}, {"cache_bits": 9, "copies": True, "blocks": 2}, {"blocks": 3}])
def test_features(transforms, options):
    for colours in (1, 2, 4, 13, 60) if "palette" in transforms else (1, 200):
        p = picture(colours)
        assert np.array_equal(webp.decode(image(p, transforms, **options)), p)


def test_long_copies_and_wide_images():
    p = np.full((3, 5000), 0xFF102030, np.uint32)
    p[1, 77] = 5
    assert np.array_equal(webp.decode(image(p, copies=True)), p)


def test_damage():
    whole = image(picture(50))
    for broken in (b"", whole[:40], b"RIFF1234WEBPVP8X", whole[:20] + b"\0" + whole[21:]):
        with pytest.raises((ValueError, IndexError)):
            webp.decode(broken)


def test_samples_round_trip():
    rng = np.random.default_rng(3)
    rows = [b"\0" * 64, b"a" * 128, bytes(range(256)), rng.bytes(6400), b"ab" * 32, rng.geometric(0.6, 64000).clip(0, 255).astype(np.uint8).tobytes()]
    skew, x = [], 1
    for s in range(26):
        skew += [s] * x
        x = int(x * 1.6) + 1
    rows.append(bytes(skew[: len(skew) // 64 * 64]))
    files = [webp.encode_payload(r) for r in rows]
    assert webp.decode_payloads(files) == rows
    for r, f in zip(rows[:5], files, strict=False):
        assert (webp.decode(f) >> 8 & 255).astype(np.uint8).tobytes() == r
    other = image(picture(60), ("predict",))  # not of literals only: read by the general decoder
    assert webp.decode_many([files[2], other])[1] == (picture(60) >> 8 & 255).astype(np.uint8).tobytes()



def header(data):
    """Kind of a file's first transform, as a list; empty without one."""
    bits = webp.Bits(webp.stream_of(data))
    webp._header(bits)
    return [bits.read(2)] if bits.read(1) else []


def samples(data):
    return (webp.decode(data) >> 8 & 255).astype(np.uint8).tobytes()


def test_forms_of_texts():
    rnd = random.Random(6)
    word = lambda n=5: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    prose = " ".join(word(rnd.randint(2, 9)) for _ in range(900))
    line = " ".join(word() for _ in range(12)) + "\n"
    far = word(3000) + prose[:800] + word(2500) + prose[:800] * 3
    texts = {"prose": prose, "lines": line * 60, "runs": "a" * 5000 + "b", "few": "".join(rnd.choice("abcd") for _ in range(700)), "sixteen": "".join(rnd.choice("0123456789abcde") for _ in range(3000)), "two": "ab" * 40 + "b" * 48, "far": far, "short": "x", "empty": ""}
    sizes = {}
    for name, text in texts.items():
        payload, _ = media.payload_of(text)
        stored = webp.encode_samples(payload)
        assert samples(stored) == payload == webp.decode_payloads([stored])[0], name
        sizes[name] = len(stored) / len(payload)
    assert header(webp.encode_samples(media.payload_of(texts["few"])[0])) == [3]
    assert sizes["lines"] < 0.1 and sizes["runs"] < 0.05 and sizes["few"] < 0.4 and sizes["far"] < 0.5 < sizes["prose"] < 0.65


def test_predictors_where_they_pay():
    ramp = bytes((k * 3 + (k // 64) * 7) % 256 for k in range(64 * 40))
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 256, 64)
    below = np.cumsum(np.vstack([rows, rng.integers(0, 2, (50, 64))]), axis=0).astype(np.uint8).tobytes()
    for data in (ramp, below):
        stored = webp.encode_samples(data)
        assert header(stored) == [0] and samples(stored) == data and len(stored) < len(data) / 3


@pytest.mark.parametrize("width", [64, 128])
def test_each_form_is_read_back(width):
    rng = np.random.default_rng(4)
    d = rng.choice(np.array([7, 9, 200, 31], np.uint8), width * 30)
    d[width * 10 : width * 20] = d[: width * 10]
    wrap = lambda x: b"RIFF" + (12 + len(x) + (len(x) & 1)).to_bytes(4, "little") + b"WEBPVP8L" + len(x).to_bytes(4, "little") + x + b"\0" * (len(x) & 1)
    forms = [webp._plain(d, width, 30, []), webp._plain(d, width, 30, webp.repeats(d)), webp._palette(d, width, 30)]
    forms += [webp._predicted(d, width, 30, mode, webp._residuals(d, width, mode)) for mode in (1, 2)]
    for x in forms:
        assert samples(wrap(x)) == d.tobytes()


def test_repeats():
    rng = np.random.default_rng(8)
    d = rng.integers(0, 4, 4000).astype(np.uint8)
    d[3000:3900] = d[100:1000]
    d[2000:2300] = 5
    done = 0
    for s, distance, n in webp.repeats(d):
        assert s >= done and distance > 0 and all(d[s + k] == d[s + k - distance] for k in range(n))
        done = s + n
    assert sum(n for _, _, n in webp.repeats(d)) >= 900 + 270


def test_files_of_another_encoder():
    """Two well-known images of one pixel that web pages probe browsers with."""
    import base64

    for text in ("UklGRh4AAABXRUJQVlA4TBEAAAAvAAAAAAfQ//73v/+BiOh/AAA=", "UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="):
        assert webp.decode(base64.b64decode(text)).tolist() in ([[0xFFFFFFFF]], [[0]])


def test_media(spark):
    rows = [(1, "hello world"), (2, None), (3, ""), (4, "é" * 5000), (1, "hello world"), (None, "x" * 64)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = media.describe(media.store(df)).collect()
    assert len(got) == 6
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id)
        payload, n = media.payload_of(text)
        assert len(payload) % 64 == 0 and payload.rstrip(b"\0") == (text or "").encode()
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(webp.encode_payload(payload)) and r.feature == media.features_of(payload)
    assert media.describe(media.store(df.where("false"))).count() == 0
