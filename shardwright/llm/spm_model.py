"""Reading a SentencePiece model file (protocol-buffer wire format) without its library."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

# Fixed values of the public file format: field numbers of ModelProto and its parts.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: The escaped blank.
BLANK = "▁"
#: Score by which an unknown character lies below the worst piece.
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and raw value of each field of a message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            yield number, varint()
        elif kind == 1:
            yield number, data[at : at + 8]
            at += 8
        elif kind == 2:
            size = varint()
            yield number, data[at : at + size]
            at += size
        elif kind == 5:
            yield number, struct.unpack("<f", data[at : at + 4])[0]
            at += 4
        else:
            raise ValueError(f"wire type {kind} is not part of the format")


@dataclass
class SpmModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    whitespace_as_suffix: bool = False

    @property
    def unknown_id(self) -> int:
        return next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN)

    @property
    def lowest(self) -> float:
        """The least score of a normal piece."""
        return min(score for _, score, kind in self.pieces if kind == NORMAL)

    @property
    def splits_at_blanks(self) -> bool:
        """No piece has a blank after another character, so no piece crosses the start of a blank run."""
        return not any(BLANK in piece.lstrip(BLANK) for piece, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))


def parse(data: bytes) -> SpmModel:
    """The parts of a model file that encoding and decoding need."""
    model = SpmModel()
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            model.pieces.append((own[1].decode(), own.get(2, 0.0), own.get(3, NORMAL)))
        elif number == 2:
            own = dict(_fields(value))
            model.kind = own.get(3, UNIGRAM)
            model.byte_fallback = bool(own.get(35, 0))
            model.whitespace_as_suffix = bool(own.get(24, 0))
        elif number == 3:
            own = dict(_fields(value))
            model.charsmap = own.get(2, b"")
            model.add_dummy_prefix = bool(own.get(3, 1))
            model.remove_extra_whitespaces = bool(own.get(4, 1))
            model.escape_whitespaces = bool(own.get(5, 1))
    if any(kind == USER_DEFINED for _, _, kind in model.pieces):
        raise ValueError("user-defined pieces are not supported")
    if model.whitespace_as_suffix:
        raise ValueError("blanks as suffixes are not supported")
    return model


def load(path: str) -> bytes:
    """The model file's bytes, read on the driver; operators send them to the workers."""
    with open(path, "rb") as file:
        return file.read()
