import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from basepack.functions import codes, compress

LENGTHS = [0, 1, 2, 3, 7, 8, 9, 31, 32, 33, 63, 64, 65, 4097]
VECTORS = {
    "": ("", "", "", "", ""),
    "A": ("00", "00", "00", "00", "00"),
    "acgt": ("0123", "048c", "1b", "00", "00"),
    "ACGTN": ("012340", "048c10", "1b00", "08", "08"),
    "ACGTNRY": ("01234440", "048c1000", "1b00", "0e", "08"),
    "TTA": ("3300", "cc00", "f0", "00", "00"),
}


def plain(text, component):
    """One base after another."""
    value = {"4bit": lambda c: "ACGT".find(c) if c in "ACGT" else 4, "uint8": lambda c: "ACGT".find(c) if c in "ACGT" else 4, "2bit_seq": lambda c: max(0, "ACGT".find(c)), "2bit_flag": lambda c: int(c not in "ACGT"), "legacy_4bit": lambda c: {"A": 0, "C": 4, "G": 8, "T": 12, "N": 1}.get(c, 0), "legacy_2bit_flag": lambda c: int(c == "N")}[component]
    width = codes.COMPONENTS[component][1]
    bits = "".join(format(value(c.upper()), f"0{width}b") for c in text)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


@pytest.mark.parametrize("text", VECTORS)
def test_vectors(text):
    got = [codes.encode(text.encode(), c).hex() for c in ("4bit", "legacy_4bit", "2bit_seq", "2bit_flag", "legacy_2bit_flag")]
    assert tuple(got) == VECTORS[text]


@pytest.mark.parametrize("component", ["4bit", "uint8", "2bit_seq", "2bit_flag", "legacy_4bit", "legacy_2bit_flag"])
@pytest.mark.parametrize("n", LENGTHS)
def test_against_plain(component, n):
    text = "".join(random.Random(n).choices("ACGTNacgtnRYKMSWBDHV-* ", k=n))
    packed = codes.encode(text.encode(), component)
    assert packed == plain(text, component)
    assert len(packed) == codes.encoded_length(component, n)


@settings(max_examples=60, deadline=None)
@given(st.text("ACGTNacgtnRYx", max_size=200), st.integers(0, 50), st.integers(0, 80))
def test_decode_and_windows(text, start, count):
    normal = "".join(c if c in "ACGT" else "N" for c in text.upper())
    assert codes.decode_4bit(codes.encode(text.encode(), "4bit"), len(text)) == normal
    for component in ("4bit", "2bit_seq", "2bit_flag", "uint8"):
        whole = codes.unpack(codes.encode(text.encode(), component), codes.COMPONENTS[component][1])[: len(text)]
        n = max(0, min(count, len(text) - start))
        got = codes.unpack(codes.encode(text.encode(), component), codes.COMPONENTS[component][1], start, n)
        assert np.array_equal(got, whole[start : start + n])


def test_non_ascii():
    with pytest.raises(UnicodeEncodeError):
        codes.ascii_bytes("Aé")
    assert codes.ascii_bytes("Aé", "N") == b"A?"
    with pytest.raises(ValueError):
        codes.ascii_bytes("A", "drop")


def test_padding():
    assert codes.padded(b"") == b"" and len(codes.padded(b"x")) == 4096 and len(codes.padded(bytes(4096))) == 4096


def test_unknown_component():
    with pytest.raises(ValueError):
        codes.encoded_length("3bit", 4)


@pytest.mark.parametrize("name", compress.NAMES)
def test_compressors(name):
    for data in (b"", b"x", bytes(5000), random.Random(1).randbytes(3000)):
        assert compress.decompressor(name)(compress.compressor(name)(data), len(data)) == data


def test_unknown_compressor():
    with pytest.raises(ValueError):
        compress.compressor("brotli")
    with pytest.raises(ValueError):
        compress.decompressor("brotli")
