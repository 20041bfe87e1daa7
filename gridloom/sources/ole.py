"""Compound files: streams by name, with every chain bounded by the number of sectors."""

from __future__ import annotations

import struct

_MAGIC, _FREE_FROM, _MINI = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", 0xFFFFFFFA, 64


def streams(data: bytes) -> dict[str, bytes]:
    """Streams of the file by name, the first of each name; ValueError for anything damaged."""
    if len(data) < 512 or data[:8] != _MAGIC:
        raise ValueError("not a compound file")
    shift = struct.unpack_from("<H", data, 30)[0]
    if shift not in (9, 12):
        raise ValueError("unknown sector size")
    size = 1 << shift
    n_fat, root, cutoff, mini_first, _, more_first, n_more = struct.unpack_from("<I I 4x I I I I I", data, 44)
    total = (len(data) - 1) // size

    def sector(i: int) -> bytes:
        if i >= total:
            raise ValueError("a sector lies outside the file")
        return data[(i + 1) * size : (i + 2) * size]

    def numbers(raw: bytes) -> tuple[int, ...]:
        return struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])

    def chain(first: int, table: list[int]) -> list[int]:
        out, i = [], first
        while i < _FREE_FROM:
            if i >= len(table) or len(out) > len(table):
                raise ValueError("a chain of sectors is broken")
            out.append(i)
            i = table[i]
        return out

    blocks, at = list(numbers(data[76:512])), more_first
    for _ in range(min(n_more, total)):
        if at >= _FREE_FROM:
            break
        *held, at = numbers(sector(at))
        blocks += held
    fat = [x for b in blocks[:n_fat] if b < _FREE_FROM for x in numbers(sector(b))]
    whole = lambda first: b"".join(map(sector, chain(first, fat)))
    mini_fat = list(numbers(whole(mini_first))) if mini_first < _FREE_FROM else []
    found, small, directory = {}, b"", whole(root)
    for i in range(0, len(directory) - 127, 128):
        entry = directory[i : i + 128]
        length, kind = struct.unpack_from("<HB", entry, 64)
        first, count = struct.unpack_from("<II", entry, 116)
        name = entry[: max(0, min(length, 64) - 2)].decode("utf-16-le", "replace")
        if kind == 5:
            small = whole(first) if first < _FREE_FROM else b""
        elif kind == 2 and name not in found:
            if count < cutoff:
                body = b"".join(small[s * _MINI : (s + 1) * _MINI] for s in chain(first, mini_fat)) if count else b""
            else:
                body = whole(first)
            if len(body) < count:
                raise ValueError("a stream is cut short")
            found[name] = body[:count]
    return found
