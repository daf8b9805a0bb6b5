"""FITS blocks: headers as cards, big-endian data, scaling and nulls. Files are read by byte ranges."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np

BLOCK, CARD = 2880, 80
#: BITPIX by data type; fixed values of the format.
KINDS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
TABLE_KINDS = {"L": "i1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "A": "S"}


class FitsError(ValueError):
    pass


def _value(text: str):
    text = text.strip()
    if text.startswith("'"):
        end = 1
        while end < len(text) and (text[end] != "'" or text[end : end + 2] == "''"):
            end += 2 if text[end] == "'" else 1
        return text[1:end].replace("''", "'").rstrip()
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    try:
        return int(text)
    except ValueError:
        try:
            return float(text.replace("D", "E"))
        except ValueError:
            return text


@dataclass
class Header:
    cards: dict[str, object]
    data_at: int = 0
    next_at: int = 0

    def __getitem__(self, key: str):
        return self.cards[key]

    def get(self, key: str, default=None):
        return self.cards.get(key, default)

    @property
    def naxes(self) -> list[int]:
        return [int(self.cards[f"NAXIS{k}"]) for k in range(1, int(self.cards["NAXIS"]) + 1)]

    def freq_axis(self) -> int:
        """Number (from 1) of the first axis whose CTYPE contains FREQ."""
        for k in range(1, len(self.naxes) + 1):
            if "FREQ" in str(self.cards.get(f"CTYPE{k}", "")).upper():
                return k
        raise FitsError("no axis is a frequency")


def read_header(f: BinaryIO, at: int = 0) -> Header:
    f.seek(at)
    cards: dict[str, object] = {}
    done = False
    while not done:
        block = f.read(BLOCK)
        if len(block) < BLOCK:
            raise FitsError("the header has no end")
        at += BLOCK
        for k in range(0, BLOCK, CARD):
            card = block[k : k + CARD].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                done = True
                break
            if card[8:10] == "= " and key not in cards:
                cards[key] = _value(card[10:])
    n = int(cards.get("NAXIS", 0))
    if n > 99:
        raise FitsError(f"NAXIS is {n}")
    size = math.prod(int(cards[f"NAXIS{k}"]) for k in range(1, n + 1)) if n else 0
    size = (size + int(cards.get("PCOUNT", 0))) * int(cards.get("GCOUNT", 1)) * abs(int(cards.get("BITPIX", 8))) // 8
    return Header(cards, at, at + -(-size // BLOCK) * BLOCK)


def headers(f: BinaryIO) -> Iterator[Header]:
    """Headers of all parts of a file."""
    f.seek(0, 2)
    end, at = f.tell(), 0
    while at + BLOCK <= end:
        h = read_header(f, at)
        yield h
        at = h.next_at


def card(key: str, value) -> bytes:
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, str):
        text = "'" + value.replace("'", "''").ljust(8) + "'"
    elif isinstance(value, float):
        text = f"{value!r:>20}".replace("e", "E")
    else:
        text = f"{value:>20}"
    return f"{key:<8}= {text}".ljust(CARD)[:CARD].encode("ascii")


def header_bytes(cards: dict[str, object]) -> bytes:
    out = b"".join(card(k, v) for k, v in cards.items()) + b"END".ljust(CARD)
    return out + b" " * (-len(out) % BLOCK)


def primary_cards(bitpix: int, naxes: list[int], extra: dict[str, object]) -> dict[str, object]:
    base: dict[str, object] = {"SIMPLE": True, "BITPIX": bitpix, "NAXIS": len(naxes)}
    return base | {f"NAXIS{k}": n for k, n in enumerate(naxes, 1)} | extra


@dataclass
class Box:
    """Ranges [first, last] counted from 1, with steps, on each axis of a file."""

    ranges: list[tuple[int, int, int]] = field(default_factory=list)


def read_box(f: BinaryIO, h: Header, box: Box) -> np.ndarray:
    """Values of a box as doubles, slowest axis first; scaled, with BLANK as NaN. Only rows of the box are read."""
    kind = np.dtype(KINDS[int(h["BITPIX"])])
    naxes = h.naxes
    picks = [np.arange(a - 1, b, s) for a, b, s in box.ranges]
    first, last = int(picks[0][0]), int(picks[0][-1])
    out = np.empty([len(p) for p in reversed(picks)], kind)
    for place in np.ndindex(*out.shape[:-1]):
        at = 0
        for axis in range(len(naxes) - 1, 0, -1):
            at = at * naxes[axis] + int(picks[axis][place[len(naxes) - 1 - axis]])
        f.seek(h.data_at + (at * naxes[0] + first) * kind.itemsize)
        row = np.frombuffer(f.read((last - first + 1) * kind.itemsize), kind)
        out[place] = row[picks[0] - first]
    values = out.astype(np.float64)
    blank = h.get("BLANK")
    if blank is not None and kind.kind != "f":
        values[out == blank] = np.nan
    return values * float(h.get("BSCALE", 1.0)) + float(h.get("BZERO", 0.0))


def table_columns(h: Header) -> list[tuple[str, str, int, int]]:
    """(name, type letter, repeat, byte offset) of a binary table's columns."""
    out, at = [], 0
    for k in range(1, int(h["TFIELDS"]) + 1):
        form = str(h[f"TFORM{k}"]).strip()
        digits = "".join(c for c in form if c.isdigit()) if form[0].isdigit() else ""
        letter = form[len(digits)]
        n = int(digits) if digits else 1
        if letter not in TABLE_KINDS:
            raise FitsError(f"column type {form} isn't known")
        out.append((str(h.get(f"TTYPE{k}", f"col{k}")), letter, n, at))
        at += n * (1 if letter == "A" else np.dtype(TABLE_KINDS[letter]).itemsize)
    return out


def read_table(f: BinaryIO, h: Header, names: list[str], first: int, last: int) -> dict[str, list]:
    """Rows [first, last) of chosen columns of a binary table."""
    width = int(h["NAXIS1"])
    f.seek(h.data_at + first * width)
    raw = np.frombuffer(f.read((last - first) * width), np.uint8).reshape(-1, width)
    out: dict[str, list] = {}
    for name, letter, n, at in table_columns(h):
        if name not in names:
            continue
        size = n * (1 if letter == "A" else np.dtype(TABLE_KINDS[letter]).itemsize)
        part = np.ascontiguousarray(raw[:, at : at + size])
        if letter == "A":
            out[name] = [bytes(r).split(b"\0")[0].decode("ascii", "replace").rstrip() for r in part]
        else:
            values = part.view(TABLE_KINDS[letter]).reshape(len(raw), n)
            values = values == ord("T") if letter == "L" else values
            out[name] = values[:, 0].tolist() if n == 1 else values.tolist()
    return out
