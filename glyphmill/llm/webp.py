"""Lossless WebP: a writer for 8-bit samples and a reader for whole lossless files."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from glyphmill.llm.common import read, text_of
from glyphmill.llm.shingles import hashes

UNIT = 64
MOST = 1 << 14  # pixels a side
#: Samples that a copy has at least; shorter ones cost more time than they save room.
LEAST_COPY = 32
#: What the format allows.
LONGEST_COPY, FARTHEST = 4096, (1 << 20) - 120

# Fixed values of the format.
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
LENGTH_SYMBOLS, DISTANCE_SYMBOLS = 24, 40


def near_offsets() -> list[tuple[int, int]]:
    """The 120 short distance codes as (columns left, rows up): by squared distance, then columns, left before right."""
    found = [(x, y) for y in range(8) for x in range(-7 if y else 1, 9)]
    return sorted(found, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class BitReader:
    """Bits of a stream, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.n = data, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + 5], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        if self.at + n > self.n:
            raise ValueError("the stream ends early")
        out = self.peek(n)
        self.at += n
        return out


class BitWriter:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def bits(self) -> np.ndarray:
        raw = np.frombuffer(self.value.to_bytes((self.n + 7) // 8, "little"), np.uint8)
        return np.unpackbits(raw, bitorder="little")[: self.n]


def canonical(lengths: list[int]) -> dict[tuple[int, int], int]:
    """Symbols by (length, code); shorter codes first, then by symbol."""
    out, code = {}, 0
    for n in range(1, 16):
        code <<= 1
        for symbol in (s for s, k in enumerate(lengths) if k == n):
            out[n, code] = symbol
            code += 1
        if code > 1 << n:
            raise ValueError("too many codes")
    return out


class Code:
    """A prefix code; a code of one symbol takes no bits."""

    def __init__(self, lengths: list[int]):
        used = [s for s, n in enumerate(lengths) if n]
        if not used:
            used = [0]
        self.only = used[0] if len(used) == 1 else None
        self.uniform = 0
        if self.only is not None:
            return
        table = canonical(lengths)
        if sum(1 << (15 - n) for n, _ in table) != 1 << 15:
            raise ValueError("the code isn't complete")
        self.most = max(n for n, _ in table)
        if all(n == self.most for n, _ in table):
            self.uniform = self.most
        self.table = np.zeros((1 << self.most, 2), np.int64)
        for (n, code), symbol in table.items():
            low = int(f"{code:0{n}b}"[::-1], 2)
            self.table[low :: 1 << n] = symbol, n
        self.symbols, self.sizes = self.table[:, 0].tolist(), self.table[:, 1].tolist()

    def read(self, r: BitReader) -> int:
        if self.only is not None:
            return self.only
        at = r.peek(self.most)
        r.at += self.sizes[at]
        if r.at > r.n:
            raise ValueError("the stream ends early")
        return self.symbols[at]


@lru_cache(maxsize=256)
def code_of(lengths: tuple[int, ...]) -> Code:
    return Code(list(lengths))


def read_code(r: BitReader, alphabet: int) -> Code:
    lengths = [0] * alphabet
    if r.read(1):
        two = r.read(1)
        symbols = [r.read(8 if r.read(1) else 1)]
        if two:
            symbols.append(r.read(8))
        for s in symbols:
            lengths[s] = 1
        return code_of(tuple(lengths))
    first = [0] * 19
    for k in CODE_LENGTH_ORDER[: 4 + r.read(4)]:
        first[k] = r.read(3)
    code = code_of(tuple(first))
    left = alphabet
    if r.read(1):
        left = 2 + r.read(2 + 2 * r.read(3))
    i, last = 0, 8
    while i < alphabet and left:
        left -= 1
        k = code.read(r)
        if k < 16:
            lengths[i] = k
            last = k or last
            i += 1
            continue
        value, times = (last, 3 + r.read(2)) if k == 16 else (0, 3 + r.read(3)) if k == 17 else (0, 11 + r.read(7))
        if i + times > alphabet:
            raise ValueError("too many code lengths")
        lengths[i : i + times] = [value] * times
        i += times
    return code_of(tuple(lengths))


def run_value(r: BitReader, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + r.read(extra) + 1


NEAR = near_offsets()


def read_pixels(r: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """Entropy-coded ARGB pixels as uint32, row by row."""
    cache_bits = r.read(4) if r.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    groups_of, tile = None, 0
    groups = 1
    if main and r.read(1):
        tile = r.read(3) + 2
        across = -(-width // (1 << tile))
        meta = read_pixels(r, across, -(-height // (1 << tile)), False)
        groups_of = (meta >> 8 & 0xFFFF).reshape(-1, across)
        groups = int(groups_of.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [[read_code(r, 256 + LENGTH_SYMBOLS + cache_size), *(read_code(r, 256) for _ in range(3)), read_code(r, DISTANCE_SYMBOLS)] for _ in range(groups)]
    total = width * height
    if groups == 1 and not cache_size and (fast := plain_pixels(r, codes[0], total)) is not None:
        return fast
    if groups == 1 and not cache_size and codes[0][0].only is None and codes[0][0].uniform and all(c.only is not None for c in codes[0][1:4]):
        return run_pixels(r, codes[0], width, total)
    out = [0] * total
    cache, cached = [0] * cache_size, 0

    def keep_up(to: int) -> None:
        nonlocal cached
        while cached < to:
            p = out[cached]
            cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            cached += 1

    i = 0
    group = codes[0]
    while i < total:
        if groups_of is not None:
            group = codes[groups_of[i // width >> tile][i % width >> tile]]
        s = group[0].read(r)
        if s < 256:
            red, blue, alpha = group[1].read(r), group[2].read(r), group[3].read(r)
            out[i] = alpha << 24 | red << 16 | s << 8 | blue
            i += 1
        elif s < 256 + LENGTH_SYMBOLS:
            length = run_value(r, s - 256)
            d = distance(r, group[4], width)
            if d > i or i + length > total:
                raise ValueError("a copy from outside the image")
            for j in range(i, i + length):
                out[j] = out[j - d]
            i += length
        else:
            keep_up(i)
            if s - 256 - LENGTH_SYMBOLS >= cache_size:
                raise ValueError("no such cache entry")
            out[i] = cache[s - 256 - LENGTH_SYMBOLS]
            i += 1
    return np.array(out, np.uint32)


def distance(r: BitReader, code: Code, width: int) -> int:
    d = run_value(r, code.read(r))
    if d > 120:
        return d - 120
    x, y = NEAR[d - 1]
    return max(1, x + y * width)


def run_pixels(r: BitReader, group: list[Code], width: int, total: int) -> np.ndarray:
    """Pixels where green has one code length and the others one symbol: literals run by run, copies one by one.

    What follows is read as if it were all literals, a stretch at a time, up to the first symbol that is a copy.
    """
    green, k = group[0], group[0].uniform
    rest = np.uint32(group[1].only << 16 | group[2].only | group[3].only << 24)
    bits = np.unpackbits(np.frombuffer(r.data, np.uint8), bitorder="little")
    out = np.empty(total, np.uint32)
    i, ahead = 0, 256
    while i < total:
        n = min(ahead, total - i, (r.n - r.at) // k)
        if n <= 0:
            raise ValueError("the stream ends early")
        index = np.packbits(bits[r.at : r.at + n * k].reshape(n, k), axis=1, bitorder="little").astype(np.int64)
        symbol = green.table[index[:, 0] if k <= 8 else index[:, 0] | index[:, 1] << 8, 0]
        stop = np.flatnonzero(symbol > 255)
        run = int(stop[0]) if len(stop) else n
        out[i : i + run] = symbol[:run].astype(np.uint32) << np.uint32(8) | rest
        i += run
        r.at += run * k
        if run == n:
            ahead = min(2 * ahead, 1 << 16)
            continue
        ahead = max(64, 2 * run)
        r.at += k
        length = run_value(r, int(symbol[run]) - 256)
        d = distance(r, group[4], width)
        if d > i or i + length > total or r.at > r.n:
            raise ValueError("a copy from outside the image")
        out[i : i + length] = np.resize(out[i - d : i - d + min(d, length)], length)  # repeats itself where it overlaps
        i += length
    return out


def plain_pixels(r: BitReader, group: list[Code], total: int) -> np.ndarray | None:
    """All pixels at once where every code has one length and none of its symbols is a copy or a cache entry."""
    green, red, blue, alpha, _ = group
    four = [green, red, blue, alpha]
    if any(c.only is None and not c.uniform for c in four):
        return None
    if (green.only if green.only is not None else max(green.symbols)) > 255:
        return None
    widths = [c.uniform if c.only is None else 0 for c in four]
    each = sum(widths)
    if r.at + each * total > r.n:
        raise ValueError("the stream ends early")
    out = np.zeros(total, np.uint32)
    if each:
        bits = np.unpackbits(np.frombuffer(r.data, np.uint8)[r.at >> 3 : (r.at + each * total + 7) >> 3], bitorder="little")[r.at & 7 :][: each * total].reshape(total, each)
    at = 0
    for c, n, shift in zip(four, widths, (8, 16, 0, 24), strict=True):
        if n:
            index = np.packbits(bits[:, at : at + n], axis=1, bitorder="little")[:, 0].astype(np.int64) if n <= 8 else bits[:, at : at + n] @ (1 << np.arange(n))
            out |= c.table[index, 0].astype(np.uint32) << np.uint32(shift)
            at += n
        else:
            out |= np.uint32(c.only << shift)
    r.at += each * total
    return out


def channels(p: np.ndarray) -> np.ndarray:
    """uint32 pixels as (..., 4): alpha, red, green, blue."""
    return np.stack([p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255], -1).astype(np.int32)


def packed(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32) & 255
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def predicted(mode: int, left, top, top_left, top_right) -> np.ndarray:
    avg = lambda a, b: (a + b) // 2
    if mode in (0, 14, 15):
        return np.array([255, 0, 0, 0])
    if mode == 11:
        p = left + top - top_left
        return left if np.abs(p - left).sum() < np.abs(p - top).sum() else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        a = avg(left, top)
        d = a - top_left
        return np.clip(a + np.where(d >= 0, d // 2, -((-d) // 2)), 0, 255)
    return [None, left, top, top_right, top_left, avg(avg(left, top_right), top), avg(left, top_left), avg(left, top), avg(top_left, top), avg(top, top_right), avg(avg(left, top_left), avg(top, top_right))][mode]


def undo_predictor(p: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    c = channels(p)
    h, w, _ = c.shape
    c[0, 0] = (c[0, 0] + [255, 0, 0, 0]) & 255
    c[0] = np.cumsum(c[0], 0) & 255
    for y in range(1, h):
        c[y, 0] = (c[y, 0] + c[y - 1, 0]) & 255
        row = modes[y >> tile]
        for x in range(1, w):
            right = c[y - 1, x + 1] if x + 1 < w else c[y, 0]
            c[y, x] = (c[y, x] + predicted(int(row[x >> tile]), c[y, x - 1], c[y - 1, x], c[y - 1, x - 1], right)) & 255
    return packed(c)


def undo_colour(p: np.ndarray, elements: np.ndarray, tile: int) -> np.ndarray:
    c = channels(p)
    h, w, _ = c.shape
    signed = lambda x: (x & 255).astype(np.int8).astype(np.int32)
    e = channels(elements)[np.arange(h)[:, None] >> tile, np.arange(w)[None] >> tile]
    red_to_blue, green_to_blue, green_to_red = signed(e[..., 1]), signed(e[..., 2]), signed(e[..., 3])
    green = signed(c[..., 2])
    red = c[..., 1] + (green_to_red * green >> 5) & 255
    blue = c[..., 3] + (green_to_blue * green >> 5) + (red_to_blue * signed(red) >> 5) & 255
    return packed(np.stack([c[..., 0], red, c[..., 2], blue], -1))


def read_webp(data: bytes) -> np.ndarray:
    """The pixels of a lossless file as (height, width) uint32 ARGB.

    Prefix codes, meta codes, copies, the colour cache and all four transforms are undone. Files
    that break the format raise ValueError; other kinds of WebP do so too.
    """
    if len(data) < 21 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    size = int.from_bytes(data[16:20], "little")
    if 20 + size > len(data):
        raise ValueError("the file ends early")
    r = BitReader(data[21 : 20 + size])
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)  # a hint whether alpha is used
    if r.read(3):
        raise ValueError("unknown version")
    undo, seen, w = [], set(), width
    while r.read(1):
        kind = r.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind < 2:
            tile = r.read(3) + 2
            across, down = -(-w // (1 << tile)), -(-height // (1 << tile))
            undo.append((kind, tile, read_pixels(r, across, down, False).reshape(down, across), w))
        elif kind == 2:
            undo.append((2, 0, None, w))
        else:
            n = r.read(8) + 1
            table = np.cumsum(channels(read_pixels(r, n, 1, False)), 0) & 255
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((3, pack, packed(table), w))
            w = -(-w // (1 << pack))
    p = read_pixels(r, w, height, True).reshape(height, w)
    for kind, tile, extra, w in reversed(undo):
        if kind == 0:
            p = undo_predictor(p, extra >> 8 & 15, tile)
        elif kind == 1:
            p = undo_colour(p, extra, tile)
        elif kind == 2:
            c = channels(p)
            c[..., 1] += c[..., 2]
            c[..., 3] += c[..., 2]
            p = packed(c)
        else:
            index = (p >> 8 & 255).astype(np.int64)
            if tile:
                each = 8 >> tile
                index = (index[..., None] >> each * np.arange(1 << tile) & ((1 << each) - 1)).reshape(height, -1)[:, :w]
            p = np.concatenate([extra, np.zeros(256 - len(extra), np.uint32)])[index] if len(extra) < 256 else extra[index]
    return p


def phased(n: int) -> list[int]:
    """Code lengths of n symbols that use up all codes, as even as can be; one symbol takes no bits."""
    if n == 1:
        return [1]
    k = (n - 1).bit_length()
    short = (1 << k) - n
    return [k - 1] * short + [k] * (n - short)


def codes_of(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """Symbol: (code, bits) with the first bit of the code lowest, as the stream has it."""
    if sum(map(bool, lengths)) == 1:
        return {s: (0, 0) for s, n in enumerate(lengths) if n}
    return {s: (int(f"{code:0{n}b}"[::-1], 2), n) for (n, code), s in canonical(lengths).items()}


def steps_of(lengths: list[int]) -> list[tuple[int, int, int]]:
    """Code lengths as (symbol, extra, extra bits): 16 repeats the last one that is not 0, 17 and 18 are runs of 0."""
    out, last, i = [], 8, 0
    while i < len(lengths):
        n, j = lengths[i], i
        while j < len(lengths) and lengths[j] == n:
            j += 1
        left = j - i
        if n and n != last:
            out.append((n, 0, 0))
            last, left = n, left - 1
        while left >= 3:
            most = 6 if n else 138
            take = min(left, most)
            out.append((16, take - 3, 2) if n else (18, take - 11, 7) if take >= 11 else (17, take - 3, 3))
            left -= take
        out += [(n, 0, 0)] * left
        i = j
    return out


def put_code(w: BitWriter, lengths: list[int]) -> None:
    """A prefix code by the code lengths of its symbols; a code of one symbol below 256 in the short form."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 1 and used[0] < 256:
        for value, bits in ((1, 1), (0, 1), (1, 1), (used[0], 8)):
            w.put(value, bits)
        return
    while lengths and not lengths[-1]:
        lengths = lengths[:-1]
    steps = steps_of(lengths)
    if len(steps) < 2:
        raise AssertionError("two steps at least")
    kinds = sorted({s for s, _, _ in steps})
    first = [0] * 19
    for s, n in zip(kinds, phased(len(kinds)), strict=True):
        first[s] = n
    w.put(0, 1)
    count = max(4, 1 + max(CODE_LENGTH_ORDER.index(s) for s in kinds))
    w.put(count - 4, 4)
    for s in CODE_LENGTH_ORDER[:count]:
        w.put(first[s], 3)
    w.put(1, 1)  # the number of steps follows; lengths after them are 0
    bits = max(2, (max(1, len(steps) - 2)).bit_length() + 1 & ~1)
    w.put((bits - 2) // 2, 3)
    w.put(len(steps) - 2, bits)
    codes = codes_of(first)
    for s, extra, n in steps:
        w.put(*codes[s])
        w.put(extra, n)


def shape_of(n: int) -> tuple[int, int]:
    """Height and width for n samples, n a positive multiple of 64: rows of 64 as long as they fit, else wider ones."""
    width = UNIT * max(1, -(-n // (UNIT * MOST)))
    return -(-n // width), width


def run_symbol(value: int) -> tuple[int, int, int]:
    """Symbol, extra and extra bits of a length or distance: the inverse of ``run_value``."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    extra = v.bit_length() - 2
    half = v >> extra & 1
    return 2 * extra + 2 + half, v - ((2 + half) << extra), extra


def copies_in(samples: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, distance) of stretches that repeat what is before, from the left, LEAST_COPY samples at least.

    The nearest earlier place with the same hash of so many samples is compared and followed as far as it is equal.
    """
    if len(samples) < 2 * LEAST_COPY:
        return []
    h = hashes(samples, LEAST_COPY)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    at, before = order[1:][same], order[:-1][same]
    by = np.argsort(at)
    at, before = at[by], before[by]
    near = at - before <= FARTHEST
    at, before = at[near].tolist(), before[near].tolist()
    out, end = [], 0
    for p, q in zip(at, before, strict=True):
        if p < end:
            continue
        n, most = 0, len(samples) - p
        step = 4 * LEAST_COPY
        while n < most:
            a, b = samples[p + n : p + n + step], samples[q + n : q + n + step]
            differ = np.flatnonzero(a != b[: len(a)])
            if len(differ):
                n += int(differ[0])
                break
            n += len(a)
            step *= 2
        if n >= LEAST_COPY:
            while n:
                take = min(n, LONGEST_COPY)
                out.append((p, take, p - q))
                p, q, n = p + take, q + take, n - take
            end = p
    return out


@lru_cache(maxsize=64)
def tables(main: int, k: int) -> np.ndarray:
    """Bits that say: no colour cache, (in the main image) no groups, green in k bits, everything else 0."""
    w = BitWriter()
    w.put(0, 1 + main)
    put_code(w, [k] * (1 << k) if k else [1])
    for _ in range(4):
        put_code(w, [1])
    return w.bits()


def copied_image(index: np.ndarray, n: int, copies: list[tuple[int, int, int]]) -> np.ndarray | None:
    """Bits of an image of levels 0 to n - 1 with copies; None if its literals and lengths don't fit 256 codes.

    Literals and copy lengths have codes of one length, what is left over goes to levels that don't occur.
    """
    lengths = [run_symbol(c[1]) for c in copies]
    far = [run_symbol(c[2] + 120) for c in copies]
    used = sorted({s for s, _, _ in lengths})
    k = (n + len(used) - 1).bit_length()
    literals = (1 << k) - len(used)
    if k > 8 or literals > 256:
        return None
    green = [k] * literals + [0] * (256 - literals) + [k * (s in used) for s in range(LENGTH_SYMBOLS)]
    kinds = sorted({s for s, _, _ in far})
    distances = [0] * DISTANCE_SYMBOLS
    for s, bits in zip(kinds, phased(len(kinds)), strict=True):
        distances[s] = bits
    w = BitWriter()
    w.put(0, 2)
    put_code(w, green)
    for _ in range(3):
        put_code(w, [1])
    put_code(w, distances)
    of_length, of_distance = codes_of(green), codes_of(distances)
    literal = np.unpackbits(index.astype(np.uint8)[:, None], axis=1)[:, 8 - k :]
    parts, at = [w.bits()], 0
    for (p, n_, _), (ls, lx, lb), (ds, dx, db) in zip(copies, lengths, far, strict=True):
        parts.append(literal[at:p].reshape(-1))
        c = BitWriter()
        c.put(*of_length[256 + ls])
        c.put(lx, lb)
        c.put(*of_distance[ds])
        c.put(dx, db)
        parts.append(c.bits())
        at = p + n_
    parts.append(literal[at:].reshape(-1))
    return np.concatenate(parts)


def write_image(samples: np.ndarray) -> bytes:
    """Up to 2^28 8-bit samples as the green channel of a lossless image, with a palette of the levels that occur.

    Up to 16 levels share a pixel as the format bundles them. More have a prefix code of as many bits as
    their number needs; stretches that repeat earlier ones are copies where that makes the image smaller. The last
    row is filled up with the first level; the reader of the samples knows their number.
    """
    height, width = shape_of(len(samples))
    levels, index = np.unique(samples, return_inverse=True)
    full = np.zeros(height * width, np.int64)
    full[: len(samples)] = index
    n = len(levels)
    pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    if pack:
        each = 8 >> pack
        full = (full.reshape(-1, 1 << pack) << each * np.arange(1 << pack)).sum(-1)
    k = 8 if pack else (n - 1).bit_length()
    image = np.concatenate([tables(1, k), np.unpackbits(full.astype(np.uint8)[:, None], axis=1)[:, 8 - k :].reshape(-1)])
    if not pack and (copies := copies_in(full.astype(np.uint8))) and (other := copied_image(full, n, copies)) is not None and len(other) < len(image):
        image = other
    w = BitWriter()
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)
    w.put(1, 1)
    w.put(3, 2)
    w.put(n - 1, 8)
    step = np.diff(levels, prepend=np.uint8(0))  # a palette holds differences
    bits = np.concatenate([w.bits(), tables(0, 8), np.unpackbits(step), np.array([0], np.uint8), image])
    stream = b"\x2f" + np.packbits(bits, bitorder="little").tobytes()
    chunk = b"VP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def write_webp(samples: np.ndarray, most: int = MOST * MOST) -> bytes:
    """Samples as one lossless file, or several behind each other where one image can't hold them."""
    return b"".join(write_image(samples[a : a + most]) for a in range(0, len(samples), most))


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % UNIT or (0 if text else UNIT))


def samples_of(media: bytes, n: int) -> np.ndarray:
    """The first n green samples of the files that stand in ``media`` behind each other; what an image holds beyond them fills it up."""
    out, at, left = [], 0, n
    while left > 0:
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        found = (read_webp(media[at : at + size]) >> 8 & 255).astype(np.uint8).reshape(-1)[:left]
        out.append(found)
        at, left = at + size, left - len(found)
    return np.concatenate(out)


def features(samples: np.ndarray) -> str:
    """Mean and standard deviation of the samples, mean step between neighbours, and number of levels."""
    x = samples.astype(np.float64)
    step = np.abs(np.diff(x)).mean() if len(x) > 1 else 0.0
    return f"mean={x.mean():.4f};std={x.std():.4f};step={step:.4f};levels={len(np.unique(samples))}"


def media_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Every text as a lossless WebP image and what reading the image back gives.

    One row per row of ``df``: the id, n_bytes, media (binary, with ``keep_media``), payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature. The payload is the text's UTF-8
    bytes with zero bytes up to a positive multiple of 64; digests and features come from the samples
    decoded from the file. Null texts count as empty (64 zero bytes). Repeated rows give equal
    values; an empty table gives an empty result. Other columns aren't read. Texts over 2^28 bytes
    become several files behind each other. Memory: one text and its image at a time.
    """
    kind = df.schema[id_col].dataType
    fields = [("n_bytes", T.LongType()), ("media", T.BinaryType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    fields = [x for x in fields if keep_media or x[0] != "media"]
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(*x) for x in fields)])
    base = df.select(id_col, text_of(text_col).alias("_text"))

    def row(text: bytes) -> list:
        media = write_webp(np.frombuffer(padded(text), np.uint8))
        n = len(text) + (-len(text) % UNIT or (0 if text else UNIT))
        samples = samples_of(media, n)
        got = samples.tobytes()
        out = [len(text), media, len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(samples)]
        return out if keep_media else out[:1] + out[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        types = types if keep_media else types[:1] + types[2:]
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                rows = [row(t) for t in part.column(1).cast(pa.binary()).to_pylist()]
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=schema.names)

    return base.mapInArrow(run, schema)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_column(read(spark, sf_dir, "documents"), keep_media=False)
