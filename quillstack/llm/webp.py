"""Lossless WebP (VP8L): a decoder of the whole format, and an encoder of 8-bit samples.

`decode` reads any lossless image: prefix codes, back-references, colour cache, entropy
images, and the predictor, cross-colour, subtract-green and palette transforms.
`encode_samples` stores bytes as the green samples of an image in the smallest of these
forms: literals; literals and back-references to what repeats; either of them over a
palette that packs several pixels into one, where 16 samples or fewer occur; or over what a
predictor leaves, where its entropy is far less. Images of one channel have no use for the
others: nothing crosses colours, and a cache entry costs the bits of the sample itself.
`decode_many` decodes streams that hold nothing but literals side by side, two symbols a
step, and hands every other stream to `decode`.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

# Fixed values of the VP8L format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
# Near distances as (x, y), by distance code from 1 on.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
HASH = 0x1E35A7BD
GREEN, PLAIN, DISTANCE = 256 + 24, 256, 40
#: Longest code the encoder makes, and the index width of the tables of decode_many.
LONGEST = 12


class Bits:
    """Reads bits, lowest first; past the end it reads zeros, and `check` complains."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.n, self.at = data, len(data) * 8, at

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + (n + 14) // 8], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        x = self.peek(n)
        self.at += n
        return x

    def check(self) -> None:
        if self.at > self.n:
            raise ValueError("the image ends early")


def canonical(lengths: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, length, code with its first bit lowest) of each symbol in use."""
    code, last, out = 0, 0, []
    for length, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= length - last
        last = length
        out.append((symbol, length, int(format(code, f"0{length}b")[::-1], 2)))
        code += 1
    if len(out) > 1 and code != 1 << last:
        raise ValueError("prefix code isn't complete")
    return out


class Code:
    """A prefix code: a dictionary from (length, bits) to symbols, or a single symbol of no bits."""

    def __init__(self, lengths: list[int]):
        entries = canonical(lengths)
        if not entries:
            raise ValueError("prefix code without symbols")
        self.lengths = lengths
        self.only = entries[0][0] if len(entries) == 1 else None
        self.longest = max(n for _, n, _ in entries)
        self.entries = entries
        self._table: list | None = None

    def table(self) -> list:
        if self._table is None:
            table = [None] * (1 << self.longest)
            for symbol, n, bits in self.entries:
                table[bits :: 1 << n] = [(symbol, n)] * (1 << self.longest - n)
            self._table = table
        return self._table

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        symbol, n = self.table()[bits.peek(self.longest)]
        bits.at += n
        return symbol


def read_code(bits: Bits, size: int) -> Code:
    lengths = [0] * size
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        for s in symbols:
            lengths[s] = 1
        return Code(lengths)
    of_lengths = [0] * 19
    for k in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        of_lengths[k] = bits.read(3)
    code = Code(of_lengths)
    left = size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    at, before = 0, 8
    while at < size and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            before = s or before
            at += 1
            continue
        if s == 16:
            n, value = 3 + bits.read(2), before
        else:
            n, value = 3 + bits.read(3) if s == 17 else 11 + bits.read(7), 0
        if at + n > size:
            raise ValueError("code lengths run over")
        lengths[at : at + n] = [value] * n
        at += n
    bits.check()
    return Code(lengths)


def _pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as ARGB words; main: it may have several groups of codes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    group_of, block, across = None, 0, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        across, down = -(-width >> block), -(-height >> block)
        group_of = ((_pixels(bits, across, down, False) >> 8) & 0xFFFF).tolist()
    count = max(group_of) + 1 if group_of else 1
    sizes = (GREEN + (1 << cache_bits if cache_bits else 0), PLAIN, PLAIN, PLAIN, DISTANCE)
    groups = [[read_code(bits, n) for n in sizes] for _ in range(count)]
    cache = [0] * (1 << cache_bits) if cache_bits else None
    shift, out, n, cached, at = 32 - cache_bits, [], width * height, 0, 0
    data, pos = bits.data, bits.at >> 3
    window, held = int.from_bytes(data[pos : pos + 16], "little") >> (bits.at & 7), 128 - (bits.at & 7)
    pos += 16
    tables = [[(c.table(), (1 << c.longest) - 1) if c.only is None else ([(c.only, 0)], 0) for c in g] for g in groups]
    constant = [c[1].only << 16 | c[2].only | c[3].only << 24 if all(x.only is not None for x in c[1:4]) else None for c in groups]
    own, fixed = tables[0], constant[0]
    while at < n:
        if held < 64:  # no pixel takes more
            window |= int.from_bytes(data[pos : pos + 16], "little") << held
            held += 128
            pos += 16
        if group_of is not None:
            g = group_of[(at // width >> block) * across + (at % width >> block)]
            own, fixed = tables[g], constant[g]
        table, mask = own[0]
        s, k = table[window & mask]
        window >>= k
        held -= k
        if s < 256:
            if fixed is not None:
                out.append(fixed | s << 8)
            else:
                p = s << 8
                for (table, mask), place in zip(own[1:4], (16, 0, 24), strict=True):
                    x, k = table[window & mask]
                    window >>= k
                    held -= k
                    p |= x << place
                out.append(p)
            at += 1
        elif s < GREEN:
            values = []
            for symbol in (s - 256, None):
                if symbol is None:
                    table, mask = own[4]
                    symbol, k = table[window & mask]
                    window >>= k
                    held -= k
                extra = max(0, (symbol - 2) >> 1)
                values.append(symbol + 1 if symbol < 4 else ((2 + (symbol & 1)) << extra) + (window & ((1 << extra) - 1)) + 1)
                window >>= extra if symbol >= 4 else 0
                held -= extra if symbol >= 4 else 0
            length, d = values
            if d > 120:
                d -= 120
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            if d > at or at + length > n:
                raise ValueError("back-reference out of the image")
            if d >= length:
                out += out[at - d : at - d + length]
            else:
                piece = out[at - d :]
                out += (piece * (length // d + 1))[:length]
            at += length
        else:
            for p in out[cached:]:
                cache[(HASH * p & 0xFFFFFFFF) >> shift] = p
            cached = at
            out.append(cache[s - GREEN])
            at += 1
    bits.at = 8 * pos - held
    bits.check()
    return np.array(out, np.uint32)


def _split(p: np.ndarray) -> np.ndarray:
    """ARGB words as int32 channels on the last axis: alpha, red, green, blue."""
    return np.stack([(p >> s & 255).astype(np.int32) for s in (24, 16, 8, 0)], axis=-1)


def _joined(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32) & 255
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def predict(mode: int, left, top, top_left, top_right):
    """Prediction of a pixel, as a list of four channels."""
    half = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clamp = lambda x: 0 if x < 0 else min(x, 255)
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return half(half(left, top_right), top)
    if mode == 6:
        return half(left, top_left)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(top_left, top)
    if mode == 9:
        return half(top, top_right)
    if mode == 10:
        return half(half(left, top_left), half(top, top_right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, top_left, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, top_left, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, top_left, strict=True)]
    if mode == 13:
        return [clamp(a + int((a - c) / 2)) for a, c in zip(half(left, top), top_left, strict=True)]
    return [255, 0, 0, 0]


def prediction_at(image: list, x: int, y: int, width: int, mode: int):
    """Prediction of pixel (x, y) from those before it: image holds channel lists in scan order."""
    at = y * width + x
    if not at:
        return [255, 0, 0, 0]
    if not y:
        return image[at - 1]
    if not x:
        return image[at - width]
    return predict(mode, image[at - 1], image[at - width], image[at - width - 1], image[at - width + 1])


def cross_colour(t: np.ndarray, c: np.ndarray, sign: int) -> np.ndarray:
    """Adds (sign 1) or takes away (-1) what green says of red and blue, and red of blue. t, c: channels."""
    signed = lambda x: (x & 255) - ((x & 128) << 1)
    delta = lambda a, b: (signed(a) * signed(b)) >> 5
    out = c.copy()
    out[..., 1] = (c[..., 1] + sign * delta(t[..., 3], c[..., 2])) & 255
    red = out[..., 1] if sign > 0 else c[..., 1]
    out[..., 3] = (c[..., 3] + sign * (delta(t[..., 2], c[..., 2]) + delta(t[..., 1], red))) & 255
    return out


def _spread(t: np.ndarray, bits: int, width: int, height: int) -> np.ndarray:
    """Block values to pixels."""
    return np.repeat(np.repeat(t, 1 << bits, axis=0), 1 << bits, axis=1)[:height, :width]


def stream_of(data: bytes) -> bytes:
    """The VP8L stream of a WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image")


def _header(bits: Bits) -> tuple[int, int]:
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    return width, height


def decode(data: bytes) -> np.ndarray:
    """A lossless WebP file as an array of ARGB words, height by width."""
    bits = Bits(stream_of(data))
    full, height = _header(bits)
    width, steps = full, []
    while bits.read(1):
        kind = bits.read(2)
        if kind in [k for k, *_ in steps]:
            raise ValueError("a transform is there twice")
        if kind < 2:
            size = bits.read(3) + 2
            across, down = -(-width >> size), -(-height >> size)
            steps.append((kind, width, size, _pixels(bits, across, down, False).reshape(down, across)))
        elif kind == 2:
            steps.append((kind, width, 0, None))
        else:
            n = bits.read(8) + 1
            palette = _joined(np.cumsum(_split(_pixels(bits, n, 1, False)), axis=0))
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((kind, width, pack, palette))
            width = -(-width >> pack)
    p = _pixels(bits, width, height, True).reshape(height, width)
    for kind, width, size, t in reversed(steps):
        if kind == 0:
            modes = _spread((t >> 8 & 15).astype(np.int32), size, width, height).ravel().tolist()
            rest, done = _split(p).reshape(-1, 4).tolist(), []
            for at, r in enumerate(rest):
                guess = prediction_at(done, at % width, at // width, width, modes[at])
                done.append([(a + b) & 255 for a, b in zip(r, guess, strict=True)])
            p = _joined(np.array(done, np.int64)).reshape(height, width)
        elif kind == 1:
            p = _joined(cross_colour(_spread(_split(t), size, width, height), _split(p), 1))
        elif kind == 2:
            c = _split(p)
            c[..., 1] += c[..., 2]
            c[..., 3] += c[..., 2]
            p = _joined(c)
        else:
            index = p >> 8 & 255
            if size:
                each = 8 >> size
                index = np.stack([index >> (each * k) & ((1 << each) - 1) for k in range(1 << size)], axis=-1).reshape(height, -1)[:, :width]
            p = np.where(index < len(t), t[np.minimum(index, len(t) - 1)], np.uint32(0))
    return p.astype(np.uint32)


# --- 8-bit samples ---


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Prefix code lengths of at most `longest` for the symbols that occur; one symbol gets 1."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    heap = [(int(counts[s]), k, k) for k, s in enumerate(used)]
    heapq.heapify(heap)
    n = len(used)
    up = [0] * (2 * n - 1)
    for node in range(n, 2 * n - 1):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        up[a[2]] = up[b[2]] = node
        heapq.heappush(heap, (a[0] + b[0], node, node))
    depth = [0] * (2 * n - 1)
    for node in range(2 * n - 3, -1, -1):
        depth[node] = depth[up[node]] + 1
    lengths = depth[:n]
    if max(lengths) > longest:  # shorten the deepest, then lengthen others until the code fits
        lengths = [min(x, longest) for x in lengths]
        room = sum(1 << longest - x for x in lengths) - (1 << longest)
        order = sorted(range(n), key=lambda k: (-lengths[k], int(counts[used[k]])))
        while room > 0:
            k = next(k for k in order if lengths[k] < longest)
            room -= 1 << longest - lengths[k] - 1
            lengths[k] += 1
            order.sort(key=lambda k: (-lengths[k], int(counts[used[k]])))
        for k in sorted(range(n), key=lambda k: -int(counts[used[k]])):  # and use what is left over
            while lengths[k] > 1 and room + (1 << longest - lengths[k]) <= 0:
                room += 1 << longest - lengths[k]
                lengths[k] -= 1
    out[used] = lengths
    return out


class Writer:
    """Writes bits, lowest first."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def write_code(out: Writer, lengths: list[int]) -> None:
    """A prefix code's description."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and used[-1] < 256:
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        wide = used[0] > 1
        out.put(wide, 1)
        out.put(used[0], 8 if wide else 1)
        if len(used) == 2:
            out.put(used[1], 8)
        return
    items, at, end = [], 0, used[-1] + 1
    while at < end:  # zeros in runs, others as they are
        if lengths[at]:
            items.append((lengths[at], 0, 0))
            at += 1
            continue
        run = next(k for k in range(at, end) if lengths[k]) - at
        at += run
        while run >= 11:
            n = min(run, 138)
            items.append((18, n - 11, 7))
            run -= n
        if run >= 3:
            items.append((17, run - 3, 3))
            run = 0
        items += [(0, 0, 0)] * run
    counts = np.bincount([s for s, _, _ in items], minlength=19)
    own = code_lengths(counts, 7).tolist()
    codes = {s: (bits, n) for s, n, bits in canonical(own)}
    single = len(codes) == 1
    kept = max(k for k, s in enumerate(CODE_LENGTH_ORDER) if own[s]) + 1
    out.put(0, 1)
    out.put(max(4, kept) - 4, 4)
    for s in CODE_LENGTH_ORDER[: max(4, kept)]:
        out.put(own[s], 3)
    out.put(1, 1)  # the number of items, as the rest of the alphabet has no codes
    wide = max(2, (len(items) - 2).bit_length() + 1 & ~1)
    out.put((wide - 2) // 2, 3)
    out.put(len(items) - 2, wide)
    for s, extra, n in items:
        if not single:
            out.put(*codes[s])
        out.put(extra, n)


def size_of(n: int) -> tuple[int, int]:
    """Width and height for n samples, a multiple of 64: 64 wide, or the next power of two that fits."""
    width = 64
    while n > width * 16384 or n % width:
        width *= 2
        if width > 8192:
            raise ValueError("too many samples")
    return width, n // width


#: Most samples in an image; a longer payload is stored as several files in a row.
MOST = 1 << 26


#: Least bytes of a repeat that is stored as a back-reference, most of one, and how far back it may lie.
REPEAT, LONGEST_COPY, FARTHEST = 16, 4096, (1 << 20) - 120
#: Bytes among which repeats are looked for at a time.
REACH = 1 << 22


def repeats(d: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, distance, length) of stretches of REPEAT bytes or more that were there before, in order and apart."""
    out: list[tuple[int, int, int]] = []
    for low in range(0, len(d), REACH):
        out += [(low + s, c, n) for s, c, n in _repeats(d[low : low + REACH])]
    return out


def _repeats(d: np.ndarray) -> list[tuple[int, int, int]]:
    m = len(d) - REPEAT + 1
    if m < 2:
        return []
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(d, 8)).view("<u8").ravel()
    a, b = words[:m], words[8 : 8 + m]
    bits = min(20, max(8, m.bit_length() + 1))
    at = np.arange(m)
    c, rest = at.copy(), at
    for factor in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F):  # those whose slot another window has try again
        h = ((a[rest] * np.uint64(factor) ^ b[rest]) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - bits)).astype(np.int64)
        first = np.zeros(1 << bits, np.int32)
        first[h[::-1]] = rest[::-1]
        found = first[h]
        same = (a[found] == a[rest]) & (b[found] == b[rest])
        c[rest[same]] = found[same]
        rest = rest[~same]
        if not len(rest):
            break
    hit = np.flatnonzero(c < at)
    if not len(hit):
        return []
    # Neighbours that repeat neighbours are one stretch.
    new = np.concatenate(([True], (np.diff(hit) != 1) | (np.diff(c[hit]) != 1)))
    firsts, before = hit[new], c[hit[new]]
    ends = hit[np.concatenate((np.flatnonzero(new)[1:], [len(hit)])) - 1] + REPEAT
    out, done, k = [], 0, 0
    while k < len(firsts):
        distance, end = int(firsts[k] - before[k]), int(ends[k])
        s = max(int(firsts[k]), done)
        if distance <= FARTHEST:
            if end < len(d) and d[end] == d[end - distance]:
                end = _extended(d, end, distance)
            out += [(x, distance, min(LONGEST_COPY, end - x)) for x in range(s, end, LONGEST_COPY)]
            done = end
        k = max(k + 1, int(np.searchsorted(ends, done + REPEAT)))
    return out


def _extended(d: np.ndarray, end: int, distance: int) -> int:
    """Where a stretch that repeats what is distance before it stops."""
    step = 64
    while end < len(d):
        differs = d[end : end + step] != d[end - distance : end - distance + len(d[end : end + step])]
        if differs.any():
            return end + int(differs.argmax())
        end, step = min(len(d), end + step), 2 * step
    return end


def _prefixed(v: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number of a length or distance."""
    u = v - 1
    if u < 4:
        return u, 0, 0
    high = u.bit_length() - 1
    return 2 * high + (u >> high - 1 & 1), u & (1 << high - 1) - 1, high - 1


def _only(out: Writer, symbol: int) -> None:
    """The description of a code of one symbol below 256."""
    out.put(1 | (symbol > 1) << 2, 3)
    out.put(symbol, 8 if symbol > 1 else 1)


def _near_codes(width: int) -> dict[int, int]:
    codes: dict[int, int] = {}
    for k, (x, y) in enumerate(NEAR, 1):
        codes.setdefault(max(1, x + y * width), k)
    return codes


def _green_image(head: Writer, d: np.ndarray, width: int, copies: list[tuple[int, int, int]], rest: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Writes the codes of an image whose green samples are d, and red, blue and alpha the
    constants of rest; returns values and sizes of the bits that follow."""
    near = _near_codes(width) if copies else {}
    covered = np.zeros(len(d) + 1, np.int64)
    items = []  # place, symbol of the length, its extra bits, symbol of the distance, its extra bits
    for s, distance, n in copies:
        covered[s] += 1
        covered[s + n] -= 1
        items.append((s, _prefixed(n), _prefixed(near.get(distance, distance + 120))))
    plain = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
    counts = np.bincount(d[plain], minlength=GREEN)
    far = np.zeros(DISTANCE, np.int64)
    for _, (length, _, _), (symbol, _, _) in items:
        counts[256 + length] += 1
        far[symbol] += 1
    lengths = code_lengths(counts)
    if items:
        far_lengths = code_lengths(far)
    write_code(head, lengths[: (GREEN if items else 256)].tolist())
    for only in rest:
        _only(head, only)
    if items:
        write_code(head, far_lengths.tolist())
    else:
        _only(head, 0)
    single = np.count_nonzero(lengths) < 2
    code, size = np.zeros(GREEN, np.uint64), np.zeros(GREEN, np.int64)
    if not single:
        for s, n, bits in canonical(lengths.tolist()):
            code[s], size[s] = bits, n
    values, sizes, keys = [code[d[plain]]], [size[d[plain]]], [plain * 4]
    if items:
        far_code = {s: (0, 0) for s in np.flatnonzero(far_lengths).tolist()}
        if len(far_code) > 1:
            far_code = {s: (bits, n) for s, n, bits in canonical(far_lengths.tolist())}
        more = [((int(code[256 + a]), int(size[256 + a])), (x, n), far_code[b], (y, m)) for _, (a, x, n), (b, y, m) in items]
        values.append(np.array([v for row in more for v, _ in row], np.uint64))
        sizes.append(np.array([n for row in more for _, n in row], np.int64))
        keys.append((np.array([s for s, _, _ in items])[:, None] * 4 + np.arange(4)).ravel())
    order = np.argsort(np.concatenate(keys), kind="stable") if items else slice(None)
    return np.concatenate(values)[order], np.concatenate(sizes)[order]


def _stream(head: Writer, values: np.ndarray, n: np.ndarray) -> bytes:
    """The bits of head and then of the values, each of at most 32 bits."""
    if not n.any():
        return head.value.to_bytes(-(-head.n // 8), "little")
    ends = np.cumsum(n)
    at = ends - n + (head.n & 31)
    word = at >> 5
    v = values << (at & 31).astype(np.uint64)
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    sums = np.zeros(int(word[-1]) + 2, np.uint64)
    sums[word[first]] = np.add.reduceat(v & np.uint64(0xFFFFFFFF), first)
    sums[word[first] + 1] += np.add.reduceat(v >> np.uint64(32), first)
    full, rest = head.n >> 5 << 5, head.value >> (head.n >> 5 << 5)
    sums[0] += np.uint64(rest)
    stream = (head.value & ((1 << full) - 1)).to_bytes(full // 8, "little") + sums.astype("<u4").tobytes()
    return stream[: -(-(head.n + int(ends[-1])) // 8)]


def _start(width: int, height: int) -> Writer:
    head = Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3)):
        head.put(value, n)  # signature, size, no alpha, version
    return head


def _single(head: Writer, pixels: list[tuple[int, int]]) -> None:
    """A small image of (alpha, green) pixels behind its codes, without cache."""
    head.put(0, 1)
    greens, alphas = ([p[k] for p in pixels] for k in (1, 0))
    lengths = [code_lengths(np.bincount(x, minlength=256)).tolist() for x in (greens, alphas)]
    write_code(head, lengths[0])
    write_code(head, [1])
    write_code(head, [1])
    write_code(head, lengths[1])
    write_code(head, [1])
    codes = [{s: (bits, n) for s, n, bits in canonical(x)} for x in lengths]
    for alpha, green in pixels:
        for x, own in ((green, codes[0]), (alpha, codes[1])):
            if len(own) > 1:
                head.put(*own[x])


def _plain(d: np.ndarray, width: int, height: int, copies) -> bytes:
    head = _start(width, height)
    head.put(0, 3)  # no transform, no cache, one group
    return _stream(head, *_green_image(head, d, width, copies, (0, 0, 255)))


def _palette(d: np.ndarray, width: int, height: int) -> bytes:
    """Indices of the samples, several to a pixel."""
    used = np.unique(d)
    pack = 3 if len(used) <= 2 else 2 if len(used) <= 4 else 1
    head = _start(width, height)
    head.put(1 | 3 << 1, 3)
    head.put(len(used) - 1, 8)
    steps = np.diff(used.astype(np.int64), prepend=0)
    _single(head, [(255 if k == 0 else 0, int(x)) for k, x in enumerate(steps)])
    head.put(0, 3)
    each = 8 >> pack
    index = np.searchsorted(used, d).reshape(height, -1, 1 << pack)
    packed = (index << each * np.arange(1 << pack)).sum(axis=2).astype(np.uint8).ravel()
    return _stream(head, *_green_image(head, packed, width >> pack, repeats(packed), (0, 0, 255)))


def _predicted(d: np.ndarray, width: int, height: int, mode: int, left: np.ndarray) -> bytes:
    """What predictor 1 (left) or 2 (above) leaves of the samples."""
    head = _start(width, height)
    head.put(1, 3)
    head.put(7, 3)
    _single(head, [(0, mode)] * ((-(-width >> 9)) * (-(-height >> 9))))
    head.put(0, 3)
    return _stream(head, *_green_image(head, left, width, repeats(left), (0, 0, 0)))


def _residuals(d: np.ndarray, width: int, mode: int) -> np.ndarray:
    out = d.reshape(-1, width).copy()
    if mode == 1:
        out[:, 1:] -= d.reshape(-1, width)[:, :-1]
        out[1:, 0] -= d.reshape(-1, width)[:-1, 0]
    else:
        out[1:] -= d.reshape(-1, width)[:-1]
        out[0, 1:] -= d[: width - 1]
    return out.ravel()


def _entropy(d: np.ndarray) -> float:
    p = np.bincount(d, minlength=256)
    p = p[p > 0] / len(d)
    return float(-(p * np.log2(p)).sum())


def encode_samples(data: bytes) -> bytes:
    """A WebP file whose green samples are data (a positive multiple of 64 bytes, MOST at
    most): the smallest of the forms that may pay; of equals the plainest."""
    d = np.frombuffer(data, np.uint8)
    width, height = size_of(len(d))
    own = _entropy(d)
    copies = repeats(d)
    # Back-references make decoding slower: they are used where they cover an eighth of the samples.
    if sum(n for _, _, n in copies) * 8 < len(d):
        copies = []
    forms = [_plain(d, width, height, copies)]
    if 1 < len(np.unique(d)) <= 16:
        forms.append(_palette(d, width, height))
    for mode in (1, 2) if own > 5 else ():  # below that, as in prose, prediction has never paid
        left = _residuals(d, width, mode)
        if _entropy(left) < own * 0.75:
            forms.append(_predicted(d, width, height, mode, left))
    stream = min(forms, key=len)
    pad = b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad


def encode_payload(data: bytes) -> bytes:
    return b"".join(encode_samples(data[k : k + MOST]) for k in range(0, len(data), MOST))


def files_in(media: bytes) -> list[bytes]:
    """The WebP files that media holds one after another."""
    out, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append(media[at : at + size])
        at += size
    return out


def _literals(data: bytes):
    """(stream, first bit, samples, green code) if the image holds green literals only, else None."""
    stream = stream_of(data)
    bits = Bits(stream)
    width, height = _header(bits)
    if bits.read(3):  # a transform, a cache or several groups
        return None
    codes = [read_code(bits, n) for n in (GREEN, PLAIN, PLAIN, PLAIN, DISTANCE)]
    green = codes[0]
    if any(c.only is None for c in codes[1:4]) or any(green.lengths[256:]) or green.longest > LONGEST:
        return None
    return stream, bits.at, width * height, green


def _pair_table(green: Code) -> np.ndarray:
    """For each LONGEST next bits: one or two symbols, their number and their bits, in one word."""
    size = 1 << LONGEST
    one = np.zeros(size, np.uint32)
    for symbol, n, bits in green.entries:
        one[bits :: 1 << n] = symbol | n << 8
    at = np.arange(size, dtype=np.uint32)
    n1 = one >> 8
    second = one[at >> n1]
    both = n1 + (second >> 8) <= LONGEST
    return np.where(both, one & 255 | (second & 255) << 8 | np.uint32(2 << 16) | (n1 + (second >> 8)) << 20, one & 255 | np.uint32(1 << 16) | n1 << 20).astype(np.uint32)


def decode_many(files: list[bytes], together: int = 512) -> list[bytes]:
    """The green samples of each file."""
    out: list = [None] * len(files)
    easy = []
    for k, data in enumerate(files):
        x = _literals(data)
        if x is None:
            out[k] = (decode(data) >> 8 & 255).astype(np.uint8).tobytes()
        elif x[3].only is not None:
            out[k] = bytes([x[3].only]) * x[2]
        else:
            easy.append((x[2], k, x))
    easy.sort(key=lambda e: -e[0])
    for at in range(0, len(easy), together):
        group = easy[at : at + together]
        tables = np.concatenate([_pair_table(x[3]) for _, _, x in group])
        streams = [x[0] + b"\0" * 8 for _, _, x in group]
        data = np.frombuffer(b"".join(streams), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in streams])))
        wide = np.zeros(len(data), np.uint32)  # each byte with the two after it
        wide[:-2] = data[:-2].astype(np.uint32) | data[1:-1].astype(np.uint32) << 8 | data[2:].astype(np.uint32) << 16
        pos = offsets[:-1] * 8 + np.array([x[1] for _, _, x in group])
        sizes = np.array([n for n, _, _ in group])
        room = np.concatenate(([0], np.cumsum(sizes + 2)))
        samples = np.zeros(room[-1], np.uint8)
        to, end = room[:-1].copy(), room[:-1] + sizes
        base = np.arange(len(group)) << LONGEST
        while len(pos):  # sorted by length: those that are done are mostly at the end
            for _ in range(max(1, int((end - to).min()) // 2)):
                e = tables[base + (wide[pos >> 3] >> (pos & 7).astype(np.uint32) & 0xFFF)]
                samples[to] = e & 255
                samples[to + 1] = e >> 8 & 255
                to += e >> 16 & 3
                pos += e >> 20
            left = to < end
            if not left.all():
                pos, to, end, base = pos[left], to[left], end[left], base[left]
        for (n, k, _), start in zip(group, room[:-1].tolist(), strict=True):
            out[k] = samples[start : start + n].tobytes()
    return out


def decode_payloads(media: list[bytes]) -> list[bytes]:
    parts = [files_in(m) for m in media]
    flat = iter(decode_many([f for p in parts for f in p]))
    return [b"".join(next(flat) for _ in p) for p in parts]
