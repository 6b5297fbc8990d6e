import hashlib
import zlib

import numpy as np
import pytest

from linkweave.llm import media


def one_by_one(data, schedule, units):
    """A plain Huffman decoder of one interval."""
    bits, out, last = "".join(f"{b:08b}" for b in data), [], {}
    codes = []
    for _, dc, ac in schedule:
        pair = []
        for t in (dc, ac):
            code, at, table = 0, 16, {}
            for length in range(1, 17):
                for _ in range(t[length - 1]):
                    table[f"{code:0{length}b}"] = t[at]
                    code, at = code + 1, at + 1
                code <<= 1
            pair.append(table)
        codes.append(pair)
    i = 0

    def symbol(table):
        nonlocal i
        j = i + 1
        while bits[i:j] not in table:
            j += 1
        i, s = j, table[bits[i:j]]
        return s

    def value(size):
        nonlocal i
        v = int(bits[i : i + size] or "0", 2)
        i += size
        return v - (1 << size) + 1 if size and v < 1 << (size - 1) else v

    for _ in range(units):
        for (component, _, _), (dc, ac) in zip(schedule, codes):
            block = [0] * 64
            last[component] = last.get(component, 0) + value(symbol(dc))
            block[0], k = last[component], 1
            while k < 64:
                s = symbol(ac)
                if s & 15 == 0 and s >> 4 < 15:
                    break
                k += s >> 4
                block[k] = value(s & 15)
                k += 1
            out.append(block)
    return out


def test_general_tables_in_step():
    """Codes of different lengths, runs, end of block and prediction, against the plain decoder."""
    rng = np.random.default_rng(2)
    dc = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, *[0] * 7]) + bytes(range(12))
    symbols = [0x01, 0x02, 0x00, 0x03, 0x11, 0x04, 0x21, 0xF0, 0x12]
    ac = bytes([0, 2, 1, 2, 2, 1, 1, *[0] * 9]) + bytes(symbols)

    def book(t):
        code, at, out = 0, 16, {}
        for length in range(1, 17):
            for _ in range(t[length - 1]):
                out[t[at]] = f"{code:0{length}b}"
                code, at = code + 1, at + 1
            code <<= 1
        return out

    dcs, acs = book(dc), book(ac)
    schedule = ((0, dc, ac), (0, dc, ac), (1, dc, ac))
    streams, sizes = [], []
    for _ in range(9):
        units, text = int(rng.integers(1, 5)), ""
        for _ in range(units * 3):
            size = int(rng.integers(0, 6))
            text += dcs[size] + "".join(rng.choice(["0", "1"], size))
            k = 1
            while k < 64:
                s = int(rng.choice(symbols))
                if s == 0:
                    text += acs[0]
                    break
                if k + (s >> 4) > 63:
                    text += acs[0]
                    break
                text += acs[s] + "".join(rng.choice(["0", "1"], s & 15))
                k += (s >> 4) + 1
        text += "1" * (-len(text) % 8)
        streams.append(np.array([int(text[i : i + 8], 2) for i in range(0, len(text), 8)], np.uint8))
        sizes.append(units)
    data = np.concatenate([*streams, np.full(4, 255, np.uint8)])
    begins = np.concatenate([[0], np.cumsum([len(s) for s in streams])])[:-1]
    got = media.decode_intervals(data, begins, np.array(sizes), schedule)
    want = [b for s, n in zip(streams, sizes) for b in one_by_one(s, schedule, n)]
    assert got.tolist() == want


@pytest.mark.parametrize("units", [1, 2, 3, 7, 64, 9000])
def test_round_trip(units):
    payload = np.random.default_rng(units).integers(0, 256, units * 192).astype(np.uint8)
    payload[: min(400, len(payload))] = 255  # stuffing
    (picture, coefficients), = media.decode([media.encode(payload)])
    assert (media.payload(picture, coefficients) == payload).all()
    thumb = media.thumbnail(picture, coefficients)
    assert thumb.shape == (picture.height // 8, picture.width // 8)
    dc = coefficients[:units, 0, 0].astype(int)
    assert (thumb.reshape(-1)[:units] == np.clip((dc + 1028) // 8, 0, 255)).all()


def test_zigzag():
    assert media.zigzag()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(media.zigzag()) == list(range(64))


def test_rejects_other_files():
    with pytest.raises(ValueError):
        media.parse(b"\x89PNG")


def test_odd_documents(odd, odd_rows, none):
    found = media.media_columns(odd).collect()
    want = []
    for doc, text in odd_rows:
        raw = (text or "").encode()
        padded = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        want.append((doc, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:])))
    assert sorted((tuple(r[:5]) for r in found), key=repr) == sorted(want, key=repr)
    same = {}
    for r in found:
        same.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["feature"], r["media_bytes"]))
    assert all(len(v) == 1 for v in same.values())
    assert media.media_columns(none).count() == 0
