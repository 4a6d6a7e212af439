"""CRC-32 of any substring of a scanned text, from running CRCs.

The CRC register is linear over GF(2).  With a register that starts at zero, the value after
byte ``b`` is the value after byte ``a``, moved on by ``b - a`` zero bytes, xor the register of
the bytes between alone.  So one scan that keeps every running value gives the CRC of any
``[a, b)`` from two of them: what came before ``a`` is moved on and cancels.
"""

from __future__ import annotations

import numpy as np

ONES = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    """Register after one byte: the reflected polynomial, bit by bit."""
    register = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        register = (register >> np.uint32(1)) ^ np.where(register & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return register


BYTE = _byte_table()


def _moved(tables: np.ndarray, register: np.ndarray) -> np.ndarray:
    """Apply a linear map given by its values for each of the four bytes of a register."""
    out = tables[0][register & np.uint32(255)]
    for i in range(1, 4):
        out = out ^ tables[i][(register >> np.uint32(8 * i)) & np.uint32(255)]
    return out


def _one_zero_byte() -> np.ndarray:
    values = np.arange(256, dtype=np.uint32)
    return np.stack([
        BYTE[register & np.uint32(255)] ^ (register >> np.uint32(8))
        for register in (values << np.uint32(8 * i) for i in range(4))
    ])


#: Maps for 1, 2, 4, ... zero bytes; each is the one before it, applied twice.
_doublings = [_one_zero_byte()]


def _doubling(k: int) -> np.ndarray:
    while len(_doublings) <= k:
        last = _doublings[-1]
        _doublings.append(np.stack([_moved(last, last[i]) for i in range(4)]))
    return _doublings[k]


def move_on(register: np.ndarray, zeros) -> np.ndarray:
    """Registers after so many zero bytes each (one number, or one per register)."""
    register, zeros = register.copy(), np.asarray(zeros, dtype=np.int64)
    for k in range(int(zeros.max(initial=0)).bit_length()):
        bit = (zeros >> k) & 1 == 1
        if zeros.ndim == 0:
            register = _moved(_doubling(k), register) if bit else register
        elif bit.all():
            register = _moved(_doubling(k), register)
        else:
            register[bit] = _moved(_doubling(k), register[bit])
    return register


def running(data: np.ndarray) -> np.ndarray:
    """Zero-started registers before the first byte and after each byte of ``data``.

    The bytes are laid out as rows that are scanned side by side; each row's start is then
    found by doubling, and moved along the row.  Zero bytes in front leave a zero register.
    """
    n = len(data)
    width = int(min(max(n, 1) ** 0.5 + 1, 1024))
    rows = -(-n // width) if n else 0
    if not rows:
        return np.zeros(1, np.uint32)
    pad = rows * width - n
    columns = np.zeros(rows * width, np.uint8)
    columns[pad:] = data
    columns = np.ascontiguousarray(columns.reshape(rows, width).T)
    seen = np.empty((width, rows), np.uint32)
    state = np.zeros(rows, np.uint32)
    for c in range(width):
        state = BYTE[(state ^ columns[c]) & np.uint32(255)] ^ (state >> np.uint32(8))
        seen[c] = state
    # ends[r]: register after rows 0..r.
    ends, reach = state.copy(), 1
    while reach < rows:
        ends[reach:] ^= move_on(ends[:-reach], width * reach)
        reach *= 2
    start = np.zeros(rows, np.uint32)
    start[1:] = ends[:-1]
    for c in range(width):
        start = BYTE[start & np.uint32(255)] ^ (start >> np.uint32(8))
        seen[c] ^= start
    out = np.zeros(n + 1, np.uint32)
    out[1:] = seen.T.reshape(-1)[pad:]
    return out


def substring_crc(registers: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of ``data[begins:ends]`` for the data whose ``running`` registers are given."""
    return move_on(registers[begins] ^ ONES, ends - begins) ^ registers[ends] ^ ONES
