"""Lossless WebP: a decoder in numpy, and the writer that stores payloads with it.

The decoder reads prefix codes (simple, run-length coded, one group or many), back-references,
the colour cache, and inverts the predictor, cross-colour, subtract-green and palette transforms. Literals of an image with one group
of codes take a vectorised path up to the first pixel that is none: code lengths
are looked up at every bit position at once, composed to whole pixels, and only the chain of
pixel starts is followed step by step. From there on it is decoded pixel by pixel.

The writer estimates, file by file, how many bits its samples take as they are, with a predictor (the pixel above), with a predictor and then green subtracted, with
a cross-colour transform of red and blue by green, and by a palette, and writes the smallest. The run of equal pixels
that ends a file, as padding does, is one back-reference.

A stored payload is one file, or several one after another when it has more than TILE_PIXELS pixels, so
that memory stays bounded whatever the length of a text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

SIGNATURE = 0x2F
#: Pixels of one file.
TILE_PIXELS = 1 << 16
#: Bytes of a unit of the payload: 12 x 12 pixels of four samples.
UNIT = 576
WIDTH = 12
LONGEST_CODE = 12
#: Pixels up to which the starts of pixels are found by doubling, and not one by one.
CHAIN_BY_DOUBLING = 8192

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LENGTH_CODES, DISTANCE_CODES = 24, 40
CACHE_MULTIPLIER = 0x1E35A7BD
#: The short distance of the pixel to the left, and the predictor that takes the pixel above.
LEFT, ABOVE = 2, 2
#: A transform is tried where one pixel in so many shows its sign: it equals the one above, or its red equals its green.
SIGN = 8
#: Blocks of the writer's transforms: as large as the format has them.
BLOCK_BITS = 9


@lru_cache(1)
def near_offsets() -> list[tuple[int, int]]:
    """The 120 short distances (x, y): by Euclidean distance, then by |x|, to the left before to the right."""
    around = [(x, y) for y in range(8) for x in range(-7, 9) if (x > 0 or y > 0) and (y > 0 or x > 0)]
    return sorted(around, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class Bits:
    """Bits of a byte string, the lowest of each byte first."""

    def __init__(self, data: bytes):
        self.at, self.data = 0, data

    def read(self, n: int) -> int:
        at = self.at
        self.at += n
        return int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & (1 << n) - 1


#: Longest code of the format, and all numbers of so many bits with their bits turned round.
MOST_BITS = 15
TURNED = sum((np.arange(1 << MOST_BITS) >> k & 1) << (MOST_BITS - 1 - k) for k in range(MOST_BITS))


def by_length(lengths: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The symbols with a code in the order of their codes, and their lengths."""
    every = np.frombuffer(lengths, np.uint8)
    used = np.flatnonzero(every)
    order = used[np.argsort(every[used], kind="stable")]
    return order, every[order].astype(np.int64)


class Code:
    """A canonical prefix code as a table over the next `bits` bits: symbol and code length."""

    def __init__(self, lengths: bytes):
        order, sizes = by_length(lengths)
        self.single = int(order[0]) if len(order) == 1 else 0 if not len(order) else None
        self.bits = 0 if self.single is not None else int(sizes[-1])
        if self.single is not None:
            self.symbol, self.length = np.full(1, self.single, np.int32), np.zeros(1, np.int32)
            return
        share = 1 << self.bits - sizes
        if share.sum() != 1 << self.bits:
            raise ValueError("prefix code is not complete")
        place = TURNED[: 1 << self.bits] >> (MOST_BITS - self.bits)
        self.symbol = np.repeat(order.astype(np.int32), share)[place]
        self.length = np.repeat(sizes.astype(np.int32), share)[place]

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        at = bits.at
        i = bits.read(self.bits)
        bits.at = at + int(self.length[i])
        return int(self.symbol[i])


@lru_cache(64)
def _code(lengths: bytes) -> Code:
    return Code(lengths)


def code_of(lengths: bytes) -> Code:
    """The code; symbols at the end that it does not use make no difference."""
    return _code(lengths.rstrip(b"\0"))


def read_lengths(bits: Bits, alphabet: int) -> bytes:
    lengths = bytearray(alphabet)
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return bytes(lengths)
    first = bytearray(19)
    for k in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        first[k] = bits.read(3)
    code = code_of(bytes(first))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    symbol, length, mask = code.symbol.tolist(), code.length.tolist(), len(code.symbol) - 1
    start = bits.at
    ahead = int.from_bytes(bits.data[start >> 3 : (start >> 3) + 2 * alphabet], "little") >> (start & 7)
    at, used, previous = 0, 0, 8
    while at < alphabet and left:
        left -= 1
        i = ahead & mask
        k = symbol[i]
        ahead >>= length[i]
        used += length[i]
        if k < 16:
            lengths[at] = k
            at += 1
            previous = k or previous
        else:
            extra, least = ((2, 3), (3, 3), (7, 11))[k - 16]
            n = least + (ahead & (1 << extra) - 1)
            ahead >>= extra
            used += extra
            lengths[at : at + n] = bytes([previous if k == 16 else 0]) * n
            at += n
    bits.at = start + used
    if at > alphabet:
        raise ValueError("too many code lengths")
    return bytes(lengths)


def read_group(bits: Bits, cache_size: int) -> list[Code]:
    """Codes of green (with lengths and cache), red, blue, alpha and distance.

    A description that repeats the one before it bit by bit means the same code and isn't read twice.
    """
    out = [code_of(read_lengths(bits, 256 + LENGTH_CODES + cache_size))]
    known, size = None, 0
    for _ in range(3):
        start = bits.at
        if known is not None and bits.read(size) == known:
            out.append(out[-1])
            continue
        bits.at = start
        out.append(code_of(read_lengths(bits, 256)))
        size, bits.at = bits.at - start, start
        known = bits.read(size)
    return [*out, code_of(read_lengths(bits, DISTANCE_CODES))]


def extended(bits: Bits, k: int) -> int:
    if k < 4:
        return k + 1
    extra = (k - 2) >> 1
    return ((2 + (k & 1)) << extra) + bits.read(extra) + 1


def literal_pixels(bits: Bits, group: list[Code], n: int) -> np.ndarray:
    """The first pixels of one group, at most n, up to the first that is no literal; bits then stands before that."""
    green, red, blue, alpha, _ = group
    data = np.frombuffer(bits.data, np.uint8)[bits.at >> 3 :]
    data = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.int32)
    around = data[:-2] | data[1:-1] << 8 | data[2:] << 16
    windows = np.empty((len(around), 8), np.int32)
    for k in range(8):
        windows[:, k] = around >> k
    windows = windows.ravel()
    last = len(windows) - 1
    position = np.arange(len(windows), dtype=np.int32)

    def after(code: Code) -> np.ndarray:
        if not code.bits:
            return position
        return np.minimum(position + code.length[windows & (1 << code.bits) - 1], last)

    steps = {c: after(c) for c in {green, red, blue, alpha}}
    g, r, b, a = (steps[c] for c in (green, red, blue, alpha))
    pair = r[g]
    pixel = pair[pair] if len(steps) == 1 else a[b[pair]]
    if n <= CHAIN_BY_DOUBLING:
        here = np.array([bits.at & 7], np.int32)
        while len(here) <= n:
            here = np.concatenate([here, pixel[here]])
            if len(here) <= n:
                pixel = pixel[pixel]
        here, end = here[:n], int(here[n])
    else:
        follow, starts, end = pixel.tolist(), [], bits.at & 7
        for _ in range(n):
            starts.append(end)
            end = follow[end]
        here = np.array(starts, np.int32)
    if len(green.symbol) and int(green.symbol.max()) > 255:
        other = np.flatnonzero(green.symbol[windows[here] & (1 << green.bits) - 1] > 255)
        if len(other):
            end, here = int(here[other[0]]), here[: other[0]]
    out = np.empty((len(here), 4), np.uint8)
    for channel, code, step in ((1, green, g), (0, red, r), (2, blue, b), (3, alpha, a)):
        out[:, channel] = code.symbol[windows[here] & (1 << code.bits) - 1]
        here = step[here]
    bits.at += end - (bits.at & 7)
    return out


def repeated_tail(bits: Bits, group: list[Code], at: int, n: int) -> int:
    """Pixels of a back-reference that repeats the last pixel up to the image's end; 0, and nothing read, if there is another token."""
    start = bits.at
    s = group[0].read(bits)
    if at and 256 <= s < 256 + LENGTH_CODES:
        length = extended(bits, s - 256)
        if at + length == n and extended(bits, group[4].read(bits)) == LEFT:
            return length
    bits.at = start
    return 0


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as rows of red, green, blue, alpha."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    cache_size = 1 << cache_bits if cache_bits else 0
    groups_at, block_bits, blocks = None, 0, 0
    if main and bits.read(1):
        block_bits = bits.read(3) + 2
        blocks = (width + (1 << block_bits) - 1) >> block_bits
        image = read_image(bits, blocks, (height + (1 << block_bits) - 1) >> block_bits, False)
        groups_at = (image[:, :, 0].astype(int) << 8 | image[:, :, 1]).ravel().tolist()
    groups = [read_group(bits, cache_size) for _ in range(1 + max(groups_at, default=0) if groups_at else 1)]
    n = width * height
    out, cache, at = [0] * n, [0] * cache_size, 0
    if len(groups) == 1 and not cache_size:
        found = literal_pixels(bits, groups[0], n)
        at = len(found)
        if at == n:
            return found.reshape(height, width, 4)
        if tail := repeated_tail(bits, groups[0], at, n):
            return np.concatenate([found, np.repeat(found[-1:], tail, axis=0)]).reshape(height, width, 4)
        wide = found.astype(np.int64)
        out[:at] = (wide[:, 3] << 24 | wide[:, 0] << 16 | wide[:, 1] << 8 | wide[:, 2]).tolist()
    group = groups[0]
    while at < n:
        if groups_at:
            y, x = divmod(at, width)
            group = groups[groups_at[(y >> block_bits) * blocks + (x >> block_bits)]]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = (c.read(bits) for c in group[1:4])
            made = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < 256 + LENGTH_CODES:
            length = extended(bits, s - 256)
            distance = extended(bits, group[4].read(bits))
            if distance > 120:
                distance -= 120
            else:
                x, y = near_offsets()[distance - 1]
                distance = max(1, x + y * width)
            if distance > at or at + length > n:
                raise ValueError("back-reference outside the image")
            for k in range(length):
                out[at + k] = out[at + k - distance]
            made = out[at : at + length]
        else:
            made = [cache[s - 256 - LENGTH_CODES]]
        out[at : at + len(made)] = made
        at += len(made)
        if cache_size:
            for p in made:
                cache[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    argb = np.array(out, np.uint32)
    return np.stack([argb >> 16 & 255, argb >> 8 & 255, argb & 255, argb >> 24], 1).astype(np.uint8).reshape(height, width, 4)


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _select(left: np.ndarray, top: np.ndarray, corner: np.ndarray) -> np.ndarray:
    to_left, to_top = np.abs(top - corner).sum(), np.abs(left - corner).sum()
    return left if to_left < to_top else top


def predicted(mode: int, left, top, right_top, left_top) -> np.ndarray:
    """The prediction of a pixel; arrays of red, green, blue, alpha as integers."""
    if mode in (1, 2, 3, 4):
        return (left, top, right_top, left_top)[mode - 1]
    if mode == 5:
        return _average(_average(left, right_top), top)
    if mode == 6:
        return _average(left, left_top)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(left_top, top)
    if mode == 9:
        return _average(top, right_top)
    if mode == 10:
        return _average(_average(left, left_top), _average(top, right_top))
    if mode == 11:
        return _select(left, top, left_top)
    if mode == 12:
        return np.clip(left + top - left_top, 0, 255)
    if mode == 13:
        mean = _average(left, top)
        difference = mean - left_top
        return np.clip(mean + (np.abs(difference) // 2) * np.sign(difference), 0, 255)
    return np.array([0, 0, 0, 255])


def undo_predictor(image: np.ndarray, modes: np.ndarray, block_bits: int) -> np.ndarray:
    height, width, _ = image.shape
    if (modes[:, :, 1] == ABOVE).all():  # sums along the first row, then down the columns
        out = image.copy()
        out[0, :1, 3] -= 1  # and 255
        out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
        return np.cumsum(out, axis=0, dtype=np.uint8)
    out = image.astype(np.int64).reshape(-1, 4)
    black = np.array([0, 0, 0, 255])
    for at in range(height * width):
        y, x = divmod(at, width)
        if not at:
            p = black
        elif not y:
            p = out[at - 1]
        elif not x:
            p = out[at - width]
        else:
            p = predicted(int(modes[y >> block_bits, x >> block_bits, 1]), out[at - 1], out[at - width], out[at - width + 1], out[at - width - 1])
        out[at] = out[at] + p & 255
    return out.astype(np.uint8).reshape(height, width, 4)


def undo_cross_colour(image: np.ndarray, elements: np.ndarray, block_bits: int) -> np.ndarray:
    height, width, _ = image.shape
    e = elements[np.arange(height)[:, None] >> block_bits, np.arange(width)[None, :] >> block_bits].view(np.int8).astype(np.int64)
    signed = lambda channel: channel.astype(np.uint8).view(np.int8).astype(np.int64)
    green = signed(image[:, :, 1])
    red = image[:, :, 0].astype(np.int64) + (e[:, :, 2] * green >> 5) & 255
    blue = image[:, :, 2].astype(np.int64) + (e[:, :, 1] * green >> 5) + (e[:, :, 0] * signed(red) >> 5) & 255
    out = image.copy()
    out[:, :, 0], out[:, :, 2] = red, blue
    return out


def undo_palette(image: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    pack = palette_bits(len(table))
    index = image[:, :, 1].astype(np.int64)
    if pack:
        each = 8 >> pack
        index = (index[:, :, None] >> each * np.arange(1 << pack) & (1 << each) - 1).reshape(index.shape[0], -1)[:, :width]
    full = np.zeros((256, 4), np.uint8)
    full[: len(table)] = table
    return full[index]


def palette_bits(size: int) -> int:
    """log2 of the pixels that share one packed index."""
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def decode_stream(data: bytes) -> np.ndarray:
    """Pixels (height, width, [red, green, blue, alpha]) of a VP8L stream."""
    bits = Bits(data)
    if bits.read(8) != SIGNATURE:
        raise ValueError("not a lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, stored = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            side = lambda n: (n + (1 << block) - 1) >> block  # noqa: B023, E731
            image = read_image(bits, side(stored), side(height), False)
            undo.append((undo_predictor if kind == PREDICTOR else undo_cross_colour, image, block))
        elif kind == SUBTRACT_GREEN:
            undo.append((None, None, None))
        else:
            table = np.cumsum(read_image(bits, bits.read(8) + 1, 1, False)[0], axis=0, dtype=np.uint8)
            undo.append((undo_palette, table, stored))
            stored = (stored + (1 << palette_bits(len(table))) - 1) >> palette_bits(len(table))
    image = read_image(bits, stored, height, True)
    for step, arg, extra in reversed(undo):
        if step is None:
            image = image.copy()
            image[:, :, 0] += image[:, :, 1]
            image[:, :, 2] += image[:, :, 1]
        else:
            image = step(image, arg, extra)
    return image


def files(data: bytes) -> Iterable[bytes]:
    """The VP8L streams of WebP files that lie one after another."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 16] != b"WEBPVP8L":
            raise ValueError("not a lossless WebP file")
        yield data[at + 20 : at + 20 + int.from_bytes(data[at + 16 : at + 20], "little")]
        at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")


def container(stream: bytes) -> bytes:
    body = b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def code_lengths(counts: list[int], longest: int = LONGEST_CODE) -> bytes:
    """Lengths of a complete prefix code of at most `longest` bits for the symbols with a count."""
    lengths = bytearray(len(counts))
    heap = [(n, s, (s,)) for s, n in enumerate(counts) if n]
    heapq.heapify(heap)
    if len(heap) == 1:
        lengths[heap[0][1]] = 1
        return bytes(lengths)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            lengths[s] += 1
        heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
    if max(lengths) > longest:
        return code_lengths([(n >> 1) + 1 if n else 0 for n in counts], longest)
    return bytes(lengths)


def codes(lengths: bytes) -> np.ndarray:
    """Codes with their bits in the order they are stored."""
    order, sizes = by_length(lengths)
    out = np.zeros(len(lengths), np.int64)
    if len(order):
        room = 1 << MOST_BITS - sizes
        out[order] = TURNED[(np.cumsum(room) - room) & (1 << MOST_BITS) - 1] if len(order) > 1 else 0
    return out


class Writer:
    def __init__(self):
        self.value, self.at = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.at
        self.at += n

    def lengths(self, lengths: bytes) -> None:
        """A prefix code, given by its code lengths."""
        used = [s for s, n in enumerate(lengths) if n]
        if len(used) <= 2 and (not used or used[-1] < 256) and all(lengths[s] == 1 for s in used):
            used = used or [0]
            self.put(1, 1)
            self.put(len(used) - 1, 1)
            self.put(1, 1)
            for s in used:
                self.put(s, 8)
            return
        tokens: list[tuple[int, int, int]] = []
        before = -1
        for at in [*used, len(lengths)]:
            gap = at - before - 1
            while gap >= 3:
                run = min(gap, 138)
                tokens.append((17, run - 3, 3) if run < 11 else (18, run - 11, 7))
                gap -= run
            tokens += [(0, 0, 0)] * gap
            if at < len(lengths):
                tokens.append((lengths[at], 0, 0))
            before = at
        counts = [0] * 19
        for k, _, _ in tokens:
            counts[k] += 1
        first = code_lengths(counts, 7)
        n = max(i for i, k in enumerate(CODE_LENGTH_ORDER) if first[k]) + 1
        self.put(0, 1)
        self.put(max(n, 4) - 4, 4)
        for k in CODE_LENGTH_ORDER[: max(n, 4)]:
            self.put(first[k], 3)
        self.put(0, 1)
        code, single = codes(first).tolist(), sum(map(bool, first)) == 1
        for k, extra, bits in tokens:
            if not single:
                self.put(code[k], first[k])
            self.put(extra, bits)

    def to_bytes(self) -> bytes:
        return self.value.to_bytes((self.at + 7) // 8, "little")


def size_of(counts: np.ndarray) -> float:
    """Bits that symbols with these counts take, about, with their code."""
    used = counts[counts > 0].astype(np.float64)
    return float((used * np.log2(used.sum() / used)).sum()) + 6.0 * len(used) if len(used) > 1 else 10.0


def put_small(out: Writer, pixels: np.ndarray) -> None:
    """A small image of literals, rows of red, green, blue, alpha, in place: what a transform needs to know."""
    out.put(0, 1)
    every = []
    for channel, rest in ((1, LENGTH_CODES), (0, 0), (2, 0), (3, 0)):
        every.append(code_lengths(np.bincount(pixels[:, channel], minlength=256).tolist()) + bytes(rest))
        out.lengths(every[-1])
    out.lengths(bytes(DISTANCE_CODES))
    stored = [(codes(lengths).tolist(), sum(map(bool, lengths)) > 1, lengths) for lengths in every]
    for pixel in pixels[:, [1, 0, 2, 3]].tolist():
        for value, (code, many, lengths) in zip(pixel, stored):
            if many:
                out.put(code[value], lengths[value])


def above(pixels: np.ndarray, width: int) -> np.ndarray:
    """What is left of pixels after each is predicted by the one above it, and the first row by the one to the left."""
    out = pixels.copy()
    out[width:] -= pixels[:-width]
    out[1:width] -= pixels[: width - 1]
    out[:1, 3] += 1  # less 255
    return out


def less_green(pixels: np.ndarray, share: int) -> np.ndarray:
    """pixels with share / 32 of green taken from red and blue."""
    out = pixels.copy()
    delta = (share * pixels[:, 1].view(np.int8).astype(np.int16) >> 5).astype(np.uint8)
    out[:, 0] -= delta
    out[:, 2] -= delta
    return out


def encode_pixels(samples: np.ndarray, width: int) -> bytes:
    """A VP8L stream; samples: bytes of whole rows of red, green, blue, alpha."""
    pixels = samples.reshape(-1, 4)
    height = len(pixels) // width
    head = Writer()
    head.put(SIGNATURE, 8)
    head.put(width - 1, 14)
    head.put(height - 1, 14)
    head.put(1, 1)
    head.put(0, 3)
    whole = samples.view("<u4")
    other = np.flatnonzero(whole != whole[-1])
    tail = len(whole) - 1 - (int(other[-1]) + 1 if len(other) else 0)  # pixels that only repeat the one before
    plain = np.bincount(samples, minlength=256)
    best, kind, made, counts = size_of(plain), None, pixels, plain
    tries = []
    if SIGN * np.count_nonzero(whole[width:] == whole[:-width]) > len(whole):
        lifted = above(pixels, width)
        tries += [(PREDICTOR, lifted), (SUBTRACT_GREEN, less_green(lifted, 32))]
    if SIGN * np.count_nonzero(samples[::4] == samples[1::4]) > len(whole):
        tries.append((CROSS_COLOUR, less_green(pixels, 16)))
    for name, changed in tries:
        found = np.bincount(changed.ravel(), minlength=256)
        bits = size_of(found) + 80
        if bits < best:
            best, kind, made, counts = bits, name, changed, found
    few = np.unique(whole[:256])
    if len(few) <= 128 and len(few := np.unique(whole)) <= 256:
        each = np.bincount(np.searchsorted(few, whole))
        if size_of(each) + 36 * len(few) + 60 < best:
            kind = PALETTE
    if kind == PALETTE:
        table = few.view(np.uint8).reshape(-1, 4)
        head.put(1, 1)
        head.put(PALETTE, 2)
        head.put(len(few) - 1, 8)
        put_small(head, np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8)))
        pack = palette_bits(len(few))
        index = np.searchsorted(few, whole).reshape(height, width)
        packed = np.zeros((height, -(-width // (1 << pack)) << pack), np.int64)
        packed[:, :width] = index
        green = (packed.reshape(height, -1, 1 << pack) << (8 >> pack) * np.arange(1 << pack)).sum(2).ravel()
        head.put(0, 1)
        return finish(head, green[:, None], np.bincount(green, minlength=256), 0)
    if kind in (PREDICTOR, SUBTRACT_GREEN):
        head.put(1, 1)
        head.put(PREDICTOR, 2)
        put_blocks(head, (0, ABOVE, 0, 255), width, height)
    if kind == SUBTRACT_GREEN:
        head.put(1, 1)
        head.put(SUBTRACT_GREEN, 2)
    if kind == CROSS_COLOUR:
        head.put(1, 1)
        head.put(CROSS_COLOUR, 2)
        put_blocks(head, (0, 16, 16, 255), width, height)
    head.put(0, 1)
    if kind is not None:
        last = made.view("<u4").ravel() if made.flags.c_contiguous else np.ascontiguousarray(made).view("<u4").ravel()
        other = np.flatnonzero(last != last[-1])
        tail = len(last) - 1 - (int(other[-1]) + 1 if len(other) else 0)
    if tail > 1:
        made = made[: len(made) - tail]
        counts = np.bincount(made.ravel(), minlength=256)
    return finish(head, made, counts, tail if tail > 1 else 0)


def put_blocks(out: Writer, element: tuple[int, int, int, int], width: int, height: int) -> None:
    """A transform's image, whose blocks all have the same element."""
    out.put(BLOCK_BITS - 2, 3)
    side = lambda n: (n + (1 << BLOCK_BITS) - 1) >> BLOCK_BITS
    put_small(out, np.full((side(width) * side(height), 4), element, np.uint8))


def prefixed(value: int) -> tuple[int, int, int]:
    """(symbol, extra, bits of extra) of a length or distance."""
    value -= 1
    if value < 4:
        return value, 0, 0
    bits = value.bit_length() - 2
    return 2 * bits + (value >> bits), value & (1 << bits) - 1, bits


def with_lengths(lengths: bytes, symbols: set[int]) -> bytes:
    """The code with further symbols, each of which takes half the place of the one with the longest code."""
    out = bytearray(lengths + bytes(LENGTH_CODES))
    for s in symbols:
        used = [i for i, n in enumerate(out) if n]
        longest = max(used, key=out.__getitem__, default=None)
        if len(used) > 1:
            out[longest] += 1
        out[s] = out[longest] if used else 1
    return bytes(out)


def finish(head: Writer, pixels: np.ndarray, counts: np.ndarray, tail: int) -> bytes:
    """The image itself: literals (red, green, blue, alpha, or green alone, whose others are 0), then a back-reference over `tail` pixels."""
    head.put(0, 1)  # no colour cache
    head.put(0, 1)  # one group of codes
    alone = pixels.shape[1] == 1
    most = 4096
    runs = [most] * (tail // most) + [tail % most] * (tail % most > 0)
    whole = code_lengths(counts.tolist())
    first = with_lengths(whole, {256 + prefixed(run)[0] for run in runs})
    head.lengths(first)
    rest = bytes([1]) + bytes(255) if alone else whole
    part = Writer()
    part.lengths(rest)
    for _ in range(3):
        head.put(part.value, part.at)
    distance = bytearray(DISTANCE_CODES)
    distance[prefixed(LEFT)[0]] = bool(runs)
    head.lengths(bytes(distance))
    many = [sum(map(bool, x)) > 1 for x in (first, rest)]
    tables = [np.where(many[i], np.frombuffer(x, np.uint8)[:256], 0).astype(np.int64) for i, x in enumerate((first, rest))]
    stored = [codes(x) for x in (first, rest)]
    if alone:
        sizes, values = tables[0][pixels[:, 0]], stored[0][pixels[:, 0]]
    else:
        ordered = pixels[:, [1, 0, 2, 3]]
        sizes, values = tables[1][ordered], stored[1][ordered]
        sizes[:, 0], values[:, 0] = tables[0][ordered[:, 0]], stored[0][ordered[:, 0]]
        sizes, values = sizes.ravel(), values.ravel()
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.arange(total) - np.repeat(ends - sizes, sizes)
    body = (np.repeat(values, sizes) >> shift & 1).astype(np.uint8)
    end = Writer()
    for run in runs:
        symbol, extra, bits = prefixed(run)
        if many[0]:
            end.put(int(stored[0][256 + symbol]), first[256 + symbol])
        end.put(extra, bits)
    unpacked = lambda w: np.unpackbits(np.frombuffer(w.to_bytes(), np.uint8), bitorder="little")[: w.at]
    return np.packbits(np.concatenate([unpacked(head), body, unpacked(end)]), bitorder="little").tobytes()


def store(payload: bytes) -> bytes:
    """The payload, whole units of UNIT bytes, as lossless WebP."""
    samples, step = np.frombuffer(payload, np.uint8), 4 * (TILE_PIXELS // (UNIT // 4)) * (UNIT // 4)
    return b"".join(container(encode_pixels(samples[i : i + step], WIDTH)) for i in range(0, len(samples), step))


def load(data: bytes) -> list[np.ndarray]:
    return [decode_stream(s) for s in files(data)]


def padded(text: bytes) -> bytes:
    units = max(1, -(-len(text) // UNIT))
    return text + b"\xff" * (units * UNIT - len(text))
