"""A small writer of lossless streams that uses every feature; only for tests, written apart from the decoder."""

import numpy as np

from docstat.llm import webp


def prefix(n):
    """Code, number of extra bits and their value of a length or distance."""
    if n <= 4:
        return n - 1, 0, 0
    n -= 1
    top = n.bit_length() - 1
    half = n >> (top - 1) & 1
    return 2 * top + half, top - 1, n & ((1 << (top - 1)) - 1)


def put_image(w, pixels, main, cache_bits=0, back=False, groups=0):
    """pixels: (h, w, 4) of red, green, blue, alpha."""
    h, width, _ = pixels.shape
    argb = [int(a) << 24 | int(r) << 16 | int(g) << 8 | int(b) for r, g, b, a in pixels.reshape(-1, 4)]
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    block = 2
    if main:
        w.put(1 if groups else 0, 1)
        if groups:
            w.put(block - 2, 3)
            bh, bw = -(-h // 4), -(-width // 4)
            image = np.zeros((bh, bw, 4), np.uint8)
            image[:, :, 1] = np.arange(bh * bw).reshape(bh, bw) % groups
            image[:, :, 3] = 255
            put_image(w, image, False)
    group_of = lambda i: ((i // width // 4) * -(-width // 4) + i % width // 4) % groups if groups else 0
    tokens, cache, i, seen = [], {}, 0, {}
    while i < len(argb):
        length, distance = 0, 0
        if back and i:
            d = seen.get(argb[i])
            if d is not None:
                distance = i - d
                while i + length < len(argb) and argb[i + length] == argb[i + length - distance] and length < 60:
                    length += 1
        place = (0x1E35A7BD * argb[i] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
        if length >= 3:
            near = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(webp.near_offsets())))}
            tokens.append((group_of(i), "back", length, near.get(distance, distance + 120)))
        elif cache_bits and cache.get(place) == argb[i]:
            length = 1
            tokens.append((group_of(i), "cache", place, 0))
        else:
            length = 1
            tokens.append((group_of(i), "pixel", argb[i], 0))
        for k in range(length):
            seen[argb[i + k]] = i + k
            if cache_bits:
                cache[(0x1E35A7BD * argb[i + k] & 0xFFFFFFFF) >> (32 - cache_bits)] = argb[i + k]
        i += length
    sizes = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    counts = [[[0] * n for n in sizes] for _ in range(max(1, groups))]
    for g, kind, a, b in tokens:
        c = counts[g]
        if kind == "pixel":
            for k, v in enumerate((a >> 8 & 255, a >> 16 & 255, a & 255, a >> 24)):
                c[k][v] += 1
        elif kind == "cache":
            c[0][280 + a] += 1
        else:
            c[0][256 + prefix(a)[0]] += 1
            c[4][prefix(b)[0]] += 1
    made = []
    for c in counts:
        lengths = [webp.code_lengths(k, 15) if any(k) else bytes(len(k)) for k in c]
        for n in lengths:
            w.lengths(n)
        made.append([(webp.codes(n).tolist(), n, sum(map(bool, n)) == 1) for n in lengths])

    def put(code, s):
        stored, lengths, single = code
        if not single:
            w.put(stored[s], lengths[s])

    for g, kind, a, b in tokens:
        codes = made[g]
        if kind == "pixel":
            for code, v in zip(codes, (a >> 8 & 255, a >> 16 & 255, a & 255, a >> 24)):
                put(code, v)
        elif kind == "cache":
            put(codes[0], 280 + a)
        else:
            k, n, extra = prefix(a)
            put(codes[0], 256 + k)
            w.put(extra, n)
            k, n, extra = prefix(b)
            put(codes[4], k)
            w.put(extra, n)


def guess(mode, p, y, x):
    """The predictor, pixel by pixel and channel by channel."""
    h, w, _ = p.shape
    P = lambda yy, xx: [int(v) for v in p[yy, xx]]
    if y == 0 and x == 0:
        return [0, 0, 0, 255]
    if y == 0:
        return P(0, x - 1)
    if x == 0:
        return P(y - 1, 0)
    L, T, TL = P(y, x - 1), P(y - 1, x), P(y - 1, x - 1)
    TR = P(y - 1, x + 1) if x + 1 < w else P(y, 0)
    avg = lambda a, b: [(i + j) // 2 for i, j in zip(a, b)]
    clamp = lambda v: max(0, min(255, v))
    if mode == 11:
        est = [a + b - c for a, b, c in zip(L, T, TL)]
        return L if sum(abs(e - a) for e, a in zip(est, L)) < sum(abs(e - b) for e, b in zip(est, T)) else T
    if mode == 12:
        return [clamp(a + b - c) for a, b, c in zip(L, T, TL)]
    if mode == 13:
        return [clamp(m + int((m - c) / 2)) for m, c in zip(avg(L, T), TL)]
    return {0: [0, 0, 0, 255], 1: L, 2: T, 3: TR, 4: TL, 5: avg(avg(L, TR), T), 6: avg(L, TL), 7: avg(L, T), 8: avg(TL, T), 9: avg(T, TR), 10: avg(avg(L, TL), avg(T, TR))}[mode]


def signed(v):
    return v - 256 if v > 127 else v


def write(pixels, transforms=(), seed=0, **how):
    """A stream of the pixels under the transforms, in the order they are stored."""
    rng = np.random.default_rng(seed)
    h, width, _ = pixels.shape
    w = webp.Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(h - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    p = pixels.copy()
    for kind in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        h, width, _ = p.shape
        block = np.zeros((-(-h // 4), -(-width // 4), 4), np.uint8)
        if kind == webp.PREDICTOR:
            w.put(0, 3)
            block[:, :, 1] = rng.integers(0, 14, block.shape[:2])
            put_image(w, block, False)
            p = np.array([[[(int(v) - g) % 256 for v, g in zip(p[y, x], guess(int(block[y // 4, x // 4, 1]), p, y, x))] for x in range(width)] for y in range(h)], np.uint8)
        elif kind == webp.CROSS_COLOUR:
            w.put(0, 3)
            block[:, :, :3] = rng.integers(0, 256, (*block.shape[:2], 3))
            put_image(w, block, False)
            q = p.copy()
            for y in range(h):
                for x in range(width):
                    rb, gb, gr = (signed(int(v)) for v in block[y // 4, x // 4, :3])
                    r, g, b = (int(v) for v in p[y, x, :3])
                    q[y, x, 0] = (r - (gr * signed(g) >> 5)) % 256
                    q[y, x, 2] = (b - (gb * signed(g) >> 5) - (rb * signed(r) >> 5)) % 256
            p = q
        elif kind == webp.SUBTRACT_GREEN:
            p[:, :, 0] -= p[:, :, 1]
            p[:, :, 2] -= p[:, :, 1]
        else:
            colours, index = np.unique(p.reshape(-1, 4), axis=0, return_inverse=True)
            w.put(len(colours) - 1, 8)
            put_image(w, np.diff(colours, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)[None], False)
            each = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            index = index.reshape(h, width)
            packed = np.zeros((h, -(-width // (1 << each)), 4), np.uint8)
            packed[:, :, 3] = 255
            for x in range(width):
                packed[:, x >> each, 1] |= (index[:, x] << (8 >> each) * (x & ((1 << each) - 1))).astype(np.uint8)
            p = packed
    w.put(0, 1)
    put_image(w, p, True, **how)
    return w.to_bytes()
