"""Vectorised codecs between bases and packed bytes.

Fixed values: A, C, G, T are 0, 1, 2, 3 in either case.  Every other byte is 4 (``uint8``, ``4bit``),
or 0 with its flag set (``2bit``).  The legacy family differs: 4-bit codes are 0, 4, 8, 12 and 1
for N, and symbols other than A, C, G, T, N count as A without a flag.  The first base is in the
highest bits; the last byte is padded with zeros, so decoding needs the logical length.
"""

from __future__ import annotations

import numpy as np


def _table(default: int, codes: dict[str, int]) -> np.ndarray:
    out = np.full(256, default, np.uint8)
    for base, code in codes.items():
        out[ord(base)] = out[ord(base.lower())] = code
    return out


_ACGT = {"A": 0, "C": 1, "G": 2, "T": 3}
_CODE = _table(4, _ACGT)
_TWO = _table(0, _ACGT)
_FLAG = _table(1, dict.fromkeys("ACGT", 0))
_LEGACY4 = _table(0, {"A": 0, "C": 4, "G": 8, "T": 12, "N": 1})
_LEGACY_FLAG = _table(0, {"N": 1})

#: component: (code of each byte, bits of a code)
COMPONENTS = {
    "uint8": (_CODE, 8),
    "4bit": (_CODE, 4),
    "2bit_seq": (_TWO, 2),
    "2bit_flag": (_FLAG, 1),
    "legacy_uint8": (_CODE, 8),
    "legacy_4bit": (_LEGACY4, 4),
    "legacy_2bit_seq": (_TWO, 2),
    "legacy_2bit_flag": (_LEGACY_FLAG, 1),
}
#: architecture: its components
ARCHITECTURES = {"uint8": ("uint8",), "4bit": ("4bit",), "2bit": ("2bit_seq", "2bit_flag"), "legacy_uint8": ("legacy_uint8",), "legacy_4bit": ("legacy_4bit",), "legacy_2bit": ("legacy_2bit_seq", "legacy_2bit_flag")}
LETTERS = np.frombuffer(b"ACGTNNNNNNNNNNNN", np.uint8)
SECTOR = 4096


def ascii_bytes(text: str, on_non_ascii: str = "error") -> bytes:
    """``error`` rejects other characters; ``N`` makes each of them one unknown base."""
    if on_non_ascii == "N":
        return text.encode("ascii", "replace")
    if on_non_ascii != "error":
        raise ValueError("on_non_ascii must be 'error' or 'N'")
    return text.encode("ascii")


def bases_per_byte(component: str) -> int:
    return 8 // COMPONENTS[component][1]


def encoded_length(component: str, bases: int) -> int:
    if component not in COMPONENTS:
        raise ValueError(f"unknown component: {component}")
    per = bases_per_byte(component)
    return (bases + per - 1) // per


def pack(codes: np.ndarray, bits: int) -> np.ndarray:
    """Codes of ``bits`` bits into bytes, the first in the highest bits."""
    if bits == 8:
        return codes
    if bits == 1:
        return np.packbits(codes)
    per = 8 // bits
    full = np.zeros(-(-len(codes) // per) * per, np.uint8)
    full[: len(codes)] = codes
    out = np.zeros(len(full) // per, np.uint8)
    for i in range(per):
        out |= full[i::per] << (8 - bits * (i + 1))
    return out


def unpack(payload: bytes, bits: int, start: int = 0, count: int | None = None) -> np.ndarray:
    """``count`` codes from code number ``start``; all to the end by default."""
    raw = np.frombuffer(payload, np.uint8)
    if bits == 8:
        out = raw
    elif bits == 1:
        out = np.unpackbits(raw)
    else:
        per = 8 // bits
        out = np.empty(len(raw) * per, np.uint8)
        for i in range(per):
            out[i::per] = (raw >> (8 - bits * (i + 1))) & ((1 << bits) - 1)
    return out[start:] if count is None else out[start : start + count]


def encode(data: bytes, component: str) -> bytes:
    table, bits = COMPONENTS[component]
    return pack(table[np.frombuffer(data, np.uint8)], bits).tobytes()


def decode_4bit(payload: bytes, logical_length: int) -> str:
    return LETTERS[unpack(payload, 4, 0, logical_length)].tobytes().decode("ascii")


def padded(payload: bytes, sector: int = SECTOR) -> bytes:
    return payload + bytes(-len(payload) % sector)
