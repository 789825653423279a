"""Byte-aligned variable-length integers with separate control bytes.

Four integers share a control byte; two bits of it give each one's length, one to four bytes, little
endian.  Control bytes and data bytes are kept apart, so a decoder finds the place of every quad by
one cumulative sum over a table of lengths and gathers its bytes by a table of places.  The last quad
is filled with zeros of one byte.
"""

import numpy as np

_LANES = (np.arange(256)[:, None] >> (2 * np.arange(4))) & 3
#: Bytes of data that belong to a control byte.
_TOTAL = (_LANES + 1).sum(axis=1)
_BEGIN = np.concatenate([np.zeros((256, 1), np.int64), np.cumsum(_LANES + 1, axis=1)[:, :3]], axis=1)
_BYTE = np.arange(4)
#: Place of each of the 16 bytes of a quad within its data; -1 is a zero byte.
_PLACES = np.where(
    _BYTE <= _LANES[:, :, None], _BEGIN[:, :, None] + _BYTE, -1
).reshape(256, 16)


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit integers."""
    padded = np.zeros(-(-len(values) // 4) * 4, "<u4")
    padded[: len(values)] = values
    lane = (padded > 0xFF).astype(np.uint8) + (padded > 0xFFFF) + (padded > 0xFFFFFF)
    data = padded.view(np.uint8).reshape(-1, 4)[_BYTE <= lane[:, None]]
    quads = lane.reshape(-1, 4).astype(np.uint8)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    return control.tobytes(), data.tobytes()


def decode(control: bytes, data: bytes) -> np.ndarray:
    """All integers of the quads, padding included."""
    codes = np.frombuffer(control, np.uint8)
    body = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(1, np.uint8)])
    out = np.empty((len(codes), 16), np.uint8)
    begin = np.cumsum(_TOTAL[codes]) - _TOTAL[codes] if len(codes) else np.zeros(0, np.int64)
    for low in range(0, len(codes), 1 << 16):  # a few MB of places at a time
        places = _PLACES[codes[low : low + (1 << 16)]]
        at = np.where(places < 0, len(body) - 1, places + begin[low : low + (1 << 16), None])
        out[low : low + (1 << 16)] = body[at]
    return out.reshape(-1).view("<u4")
