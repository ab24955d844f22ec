"""Codecs of postings lists: gaps, variable bytes and Elias gamma."""

from __future__ import annotations

from itertools import accumulate


def to_gaps(ids: list[int]) -> list[int]:
    """Sorted distinct positive ids as differences; what is not greater than the id before goes."""
    out, last = [], 0
    for i in ids:
        if i > last:
            out.append(i - last)
            last = i
    return out


def from_gaps(gaps: list[int]) -> list[int]:
    return list(accumulate(g for g in gaps if g > 0))


def encode_bytes(numbers: list[int]) -> bytes:
    """Seven bits a byte, highest first; the last byte of a number has its high bit set."""
    out = bytearray()
    for n in numbers:
        part = [n & 127 | 128]
        while n := n >> 7:
            part.append(n & 127)
        out += bytes(reversed(part))
    return bytes(out)


def decode_bytes(data: bytes) -> list[int]:
    out, n = [], 0
    for b in data:
        n = n << 7 | b & 127
        if b & 128:
            out.append(n)
            n = 0
    return out


def encode_gamma(numbers: list[int]) -> bytes:
    """The number of bits in four bytes, then each number's bits behind as many zeros as it has bits less one."""
    bits = "".join("0" * (n.bit_length() - 1) + f"{n:b}" for n in numbers)
    return len(bits).to_bytes(4, "big") + (int(bits, 2) << (-len(bits) % 8)).to_bytes(-(-len(bits) // 8), "big") if bits else (0).to_bytes(4, "big")


def decode_gamma(data: bytes) -> list[int]:
    size = int.from_bytes(data[:4], "big")
    bits = f"{int.from_bytes(data[4:], 'big'):0{8 * len(data[4:])}b}"[:size] if size else ""
    out, at = [], 0
    while at < len(bits):
        one = bits.index("1", at)
        end = one + (one - at) + 1
        out.append(int(bits[one:end], 2))
        at = end
    return out
