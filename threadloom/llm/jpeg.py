"""Baseline JPEG (ITU T.81) in numpy: the intra frames of motion-JPEG.

Entropy coding is sequential by nature and runs over plain integers; dequantisation and the
cosine transform run over all blocks at once. Frames without Huffman tables use the standard
ones, as motion-JPEG allows. Progressive, arithmetic and lossless files raise ``ValueError``.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_k = np.arange(8)
_DCT = np.sqrt(np.where(_k == 0, 1, 2) / 8)[:, None] * np.cos((2 * _k + 1)[None, :] * _k[:, None] * np.pi / 16)
_BASIS = np.kron(_DCT, _DCT)[_ZIGZAG]  # the pixels of each coefficient, in file order


def _ac(order: str) -> bytes:
    """Run and size symbols: those named, then all others in ascending order."""
    first = bytes.fromhex(order)
    rest = [16 * r + s for r in range(16) for s in range(1, 11) if 16 * r + s not in first]
    return first + bytes(rest)


_DIGITS = bytes(range(12))
STANDARD = {
    (0, 0): bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]) + _DIGITS,
    (0, 1): bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]) + _DIGITS,
    (1, 0): bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]) + _ac("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a"),
    (1, 1): bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]) + _ac("0001020311040521310612415107617113223281081442" + "91a1b1c109233352f0156272d10a162434e125f1"),
}


def _codes(spec: bytes) -> list[tuple[int, int, int]]:
    """(code, bits, symbol) of a table in file form."""
    out, code, at = [], 0, 16
    for bits in range(1, 17):
        for _ in range(spec[bits - 1]):
            out.append((code, bits, spec[at]))
            code, at = code + 1, at + 1
        code <<= 1
    return out


@lru_cache(maxsize=64)
def _lookup(spec: bytes) -> list[int]:
    """By the next 16 bits: 256 * bits + symbol, or 0."""
    table = np.zeros(1 << 16, np.int64)
    for code, bits, symbol in _codes(spec):
        table[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | symbol
    return table.tolist()


def _scan(data: bytes, parts: list[tuple[np.ndarray, int, list[int], list[int]]], order: list[tuple[int, int]], mcus: int) -> None:
    """Decode up to ``mcus`` units of one restart interval into the parts' blocks."""
    raw = data.replace(b"\xff\x00", b"\xff") + b"\xff" * 8
    at, held, n, end = 0, 0, 0, len(raw)
    dc = [0] * len(parts)
    for _ in range(mcus):
        for c, step in order:
            blocks, place, dc_table, ac_table = parts[c]
            values = [0] * 64
            k = 0
            while k < 64:
                if n < 32:
                    if at > end:
                        raise ValueError("the scan ends early")
                    held = (held & ((1 << n) - 1)) << 32 | int.from_bytes(raw[at : at + 4].ljust(4, b"\xff"), "big")
                    at, n = at + 4, n + 32
                x = (dc_table if k == 0 else ac_table)[held >> (n - 16) & 0xFFFF]
                if not x:
                    raise ValueError("bad Huffman code")
                n -= x >> 8
                x &= 255
                if k:
                    if x == 0:
                        break
                    k += x >> 4
                    if x == 0xF0:
                        k += 1
                        continue
                    x &= 15
                    if k > 63:
                        raise ValueError("too many coefficients")
                elif x > 15:
                    raise ValueError("bad size")
                if x:
                    n -= x
                    v = held >> n & ((1 << x) - 1)
                    values[k] = v if v >> (x - 1) else v - (1 << x) + 1
                k += 1
            dc[c] += values[0]
            values[0] = dc[c]
            blocks[place] = values
            parts[c] = (blocks, place + 1, dc_table, ac_table)


def decode(data: bytes) -> list[np.ndarray]:
    """The planes of an image (one, or Y, Cb and Cr), each as large as it was coded."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    tables, quant, restart, frame = dict(STANDARD), {}, 0, None
    i = 2
    while i + 4 <= len(data):
        if data[i] != 0xFF:
            raise ValueError("marker expected")
        mark = data[i + 1]
        if mark == 0xFF or 0xD0 <= mark <= 0xD8 or mark == 1:
            i += 1 if mark == 0xFF else 2
            continue
        if mark == 0xD9:
            break
        size = int.from_bytes(data[i + 2 : i + 4], "big")
        body = data[i + 4 : i + 2 + size]
        if size < 2 or len(body) != size - 2:
            raise ValueError("cut off")
        i += 2 + size
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(float)
                body = body[1 + 64 * (1 + wide) :]
        elif mark == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = bytes(body[1:n])
                body = body[n:]
        elif mark == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif mark in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("8 bits a sample are supported")
            h, w = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            frame = [(body[6 + 3 * c], body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15, body[8 + 3 * c]) for c in range(body[5])]
            if not h or not w or not frame or any(not 1 <= x <= 4 for f in frame for x in f[1:3]):
                raise ValueError("bad frame header")
        elif 0xC2 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
            raise ValueError("only baseline JPEG is supported")
        elif mark == 0xDA:
            if frame is None or body[0] != len(frame):
                raise ValueError("one interleaved scan is supported")
            if len(frame) == 1:
                frame = [(frame[0][0], 1, 1, frame[0][3])]
            hm, vm = max(f[1] for f in frame), max(f[2] for f in frame)
            across, down = -(-w // (8 * hm)), -(-h // (8 * vm))
            chosen = {body[1 + 2 * c]: body[2 + 2 * c] for c in range(body[0])}
            parts = []
            for name, x, y, _ in frame:
                t = chosen[name]
                parts.append((np.zeros((across * down * x * y, 64), np.int32), 0, _lookup(tables[0, t >> 4]), _lookup(tables[1, t & 15])))
            order = [(c, s) for c, f in enumerate(frame) for s in range(f[1] * f[2])]
            stop = i
            pieces, begin = [], i
            while True:
                stop = data.find(b"\xff", stop)
                if stop < 0 or stop + 1 >= len(data):
                    stop = len(data)
                    break
                if data[stop + 1] == 0:
                    stop += 2
                elif 0xD0 <= data[stop + 1] <= 0xD7:
                    pieces.append(data[begin:stop])
                    stop += 2
                    begin = stop
                elif data[stop + 1] == 0xFF:
                    stop += 1
                else:
                    break
            pieces.append(data[begin:stop])
            todo = across * down
            for piece in pieces:
                _scan(piece, parts, order, min(todo, restart or todo))
                todo -= min(todo, restart or todo)
            if todo:
                raise ValueError("the scan ends early")
            planes = []
            for (blocks, *_), (_, x, y, q) in zip(parts, frame):
                if q not in quant:
                    raise ValueError("no quantisation table")
                pixels = np.rint((blocks * quant[q]) @ _BASIS + 128).clip(0, 255).astype(np.uint8)
                plane = pixels.reshape(down, across, y, x, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(down * y * 8, across * x * 8)
                planes.append(plane[: -(-h * y // vm), : -(-w * x // hm)])
            return planes
    raise ValueError("no picture")


_ENCODE = {key: {symbol: (code, bits) for code, bits, symbol in _codes(spec)} for key, spec in STANDARD.items()}


def encode(planes: list[np.ndarray], quant: int = 4, tables: bool = True) -> bytes:
    """A JPEG of planes of one size with one step for all coefficients; ``tables`` false leaves
    the (standard) Huffman tables out."""
    h, w = planes[0].shape
    segment = lambda mark, body: bytes([0xFF, mark]) + (len(body) + 2).to_bytes(2, "big") + body
    out = b"\xff\xd8" + segment(0xDB, b"\0" + bytes([quant] * 64))
    out += segment(0xC0, bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([len(planes)]) + b"".join(bytes([c + 1, 0x11, 0]) for c in range(len(planes))))
    if tables:
        out += b"".join(segment(0xC4, bytes([16 * kind + which]) + STANDARD[kind, which]) for kind in (0, 1) for which in ((0, 1) if len(planes) > 1 else (0,)))
    out += segment(0xDA, bytes([len(planes)]) + b"".join(bytes([c + 1, 0x11 if c else 0]) for c in range(len(planes))) + b"\0\x3f\0")
    coded = []
    for p in planes:
        p = np.pad(p.astype(float), ((0, -h % 8), (0, -w % 8)), mode="edge") if h % 8 or w % 8 else p
        blocks = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).transpose(0, 2, 1, 3).reshape(-1, 64)
        coded.append(np.rint((blocks - 128.0) @ _BASIS.T / quant).astype(int).tolist())
    bits, n, before = 0, 0, [0] * len(planes)

    def put(code: int, size: int) -> None:
        nonlocal bits, n
        bits, n = bits << size | code, n + size

    def number(v: int, size: int) -> int:
        return v if v >= 0 else v + (1 << size) - 1

    for group in zip(*coded):
        for c, values in enumerate(group):
            dc, ac = _ENCODE[0, min(c, 1)], _ENCODE[1, min(c, 1)]
            d, before[c] = values[0] - before[c], values[0]
            size = abs(d).bit_length()
            put(*dc[size])
            put(number(d, size), size)
            run = 0
            last = 63
            while last and not values[last]:
                last -= 1
            for v in values[1 : last + 1]:
                if not v:
                    run += 1
                    continue
                while run > 15:
                    put(*ac[0xF0])
                    run -= 16
                size = abs(v).bit_length()
                put(*ac[16 * run + size])
                put(number(v, size), size)
                run = 0
            if last < 63:
                put(*ac[0])
    put((1 << (-n % 8)) - 1, -n % 8)
    return out + bits.to_bytes(n // 8, "big").replace(b"\xff", b"\xff\x00") + b"\xff\xd9"
