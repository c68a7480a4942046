"""An adaptive context-mixing range coder for token ids, in independent blocks.

Order 2 and order 1 each foretell the id that last followed the last two ids, or the last id (a small
hashed table of the block). What is left goes by order 0, the shares of all ids in the segment. How the
three are mixed depends on whether both foretell the same, and on which of them was right for each of the
last four ids: for each such state the segment's head holds the chances that order 2, or order 1 alone, is
right, as counted over the segment. The head has the shares of the ids and these chances in 16 bits each;
each block begins anew with them and needs nothing else.

The blocks of a segment are coded in lockstep, one array element a block, so the work for one id is a
few numpy operations over all blocks, and one step of the coder; what a step looks up is small, as it is
looked up at random. Only whole numbers are used, and quotients of them below 2**32, so every machine
decodes what another wrote.

Coder: 64-bit low and range, 32 bits for a chance; below 2**32 the upper 32 bits of low go out. A carry
is added to the word before and settled at the end of the block.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 1024
#: A block's table has lines (bits), one for each hash of the last id: its first entry is order 1, the others order 2.
_LINES, _ENTRIES = 7, 4
#: States of the mix: two bits for the outcome of each of the last four ids, one for equal guesses.
_STATES = 1 << 9
#: Outcomes of an id in each state: neither is right, order 1, order 2, both.
_OUTCOMES = 4
#: Chance of 65,536 that an order is right, where a segment has counted none.
_GUESS = 12_000
_ONE, _LOW32, _S32 = np.uint64(1), np.uint64(0xFFFFFFFF), np.uint64(32)


def shares_of(ids: np.ndarray) -> np.ndarray:
    """Of each 16-bit id its share of 65,536 in a segment: one at least if it occurs, zero if not."""
    counts = np.bincount(ids, minlength=1 << 16)
    out = (counts > 0).astype(np.int64)
    if len(ids):
        out += counts * ((1 << 16) - int(out.sum())) // len(ids)
        out[np.argmax(counts)] += (1 << 16) - out.sum()
    return out


def chances_of(seen: np.ndarray | None = None) -> np.ndarray:
    """(state, 2): the shares of 65,536 of order 2 (or both) and of order 1 alone, from counts by state and outcome.

    Each share and what is left for order 0 is one at least.
    """
    guess = np.full((_STATES, 2), _GUESS)
    if seen is None:
        return guess
    seen = seen.reshape(_STATES, _OUTCOMES)
    right, of = np.stack([seen[:, 2] + seen[:, 3], seen[:, 1]], 1), seen.sum(1)[:, None]
    return np.where(of > 0, 1 + right * 65533 // np.maximum(of, 1), guess)


class _Mix:
    """By state and outcome: begin and width of its part of 65,536; by state: where order 2 and both orders end."""

    def __init__(self, chances: np.ndarray):
        self.end2, self.end = chances[:, 0].copy(), chances.sum(1)
        zero, rest = np.zeros_like(self.end), 65536 - self.end
        self.begin = np.stack([self.end, self.end2, zero, zero], 1).ravel() << 16
        self.width = np.stack([rest, chances[:, 1], self.end2, self.end2], 1).ravel()


class _Model:
    """The tables and states of all blocks of a segment at one step. An entry that no id has been put in foretells id 0."""

    def __init__(self, lanes: int):
        self.base = np.arange(lanes, dtype=np.int64) * (_ENTRIES << _LINES)
        self.table = np.zeros(lanes * (_ENTRIES << _LINES), np.uint16)
        self.at1, self.at2 = self.base, self.base + 1
        self.before = np.zeros(lanes, np.uint8)
        self.entry = np.ones(lanes, np.uint16)

    def predict(self) -> np.ndarray:
        """The state of each block; ``told1`` and ``told2`` have what the orders foretell."""
        self.told1, self.told2 = self.table.take(self.at1), self.table.take(self.at2)
        return self.before | ((self.told1 == self.told2).astype(np.uint16) << np.uint16(8))

    def outcome(self, x: np.ndarray) -> np.ndarray:
        return (self.told1 == x).view(np.uint8) | ((self.told2 == x).view(np.uint8) << np.uint8(1))

    def learn(self, x: np.ndarray, outcome: np.ndarray) -> None:
        """Takes in the ids ``x`` (16 bits)."""
        self.table[self.at1] = x
        self.table[self.at2] = x
        self.before = (self.before << np.uint8(2)) | outcome
        self.at1 = self.base + ((x * np.uint16(40503) >> np.uint16(16 - _LINES)) * np.uint16(_ENTRIES))
        self.at2 = self.at1 + self.entry
        # where its line has what followed this id
        self.entry = x * np.uint16(30011) % np.uint16(_ENTRIES - 1) + np.uint16(1)


def _grid(ids: np.ndarray, block: int) -> np.ndarray:
    """(step, lane) of a segment's ids; the last block is filled up with its last id."""
    lanes, steps = -(-len(ids) // block), min(block, len(ids))
    padded = np.full(lanes * steps, ids[-1], np.uint16)
    padded[: len(ids)] = ids
    return np.ascontiguousarray(padded.reshape(lanes, steps).T)


def _cases(grid: np.ndarray) -> np.ndarray:
    """(step, lane) of the state and outcome of each id, as one number; no chance has a part in it."""
    m, out = _Model(grid.shape[1]), np.empty(grid.shape, np.uint16)
    for x, case in zip(grid, out, strict=True):
        state = m.predict()
        outcome = m.outcome(x)
        np.bitwise_or(state << np.uint16(2), outcome, out=case)
        m.learn(x, outcome)
    return out


def _code(grid: np.ndarray, cases: np.ndarray, shares: np.ndarray, chances: np.ndarray) -> list[bytes]:
    lanes = grid.shape[1]
    mix = _Mix(chances)
    # the last of 65,537 ids stands for the whole of a part that a guess has
    shares, starts = np.append(shares, 65536), np.append(np.cumsum(shares) - shares, 0)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    of_lane: list[np.ndarray] = []  # what each step sends: a word each of some blocks, and carries to their last words
    sent: list[np.ndarray] = []
    carries: list[np.ndarray] = []
    for x, case in zip(grid, cases, strict=True):
        told, case = case & np.uint16(3) != 0, case.astype(np.int64)
        x = np.where(told, 65536, x.astype(np.int64))
        part = mix.width.take(case)
        start = mix.begin.take(case) + part * starts.take(x)
        r = rng >> _S32
        new = low + r * start.view(np.uint64)
        rng = r * (part * shares.take(x)).view(np.uint64)
        carry = np.flatnonzero(new < low)
        if len(carry):
            of_lane.append(carry)
            sent.append(np.zeros(len(carry), np.uint64))
            carries.append(np.ones(len(carry), bool))
        small = np.flatnonzero(rng <= _LOW32)
        if len(small):
            word = new.take(small)
            of_lane.append(small)
            sent.append(word >> _S32)
            carries.append(np.zeros(len(small), bool))
            new[small] = word << _S32
            rng[small] = rng.take(small) << _S32
        low = new
    every = np.arange(lanes)
    lane = np.concatenate([*of_lane, every, every])
    words = np.concatenate([*sent, low >> _S32, low & _LOW32])
    carry = np.concatenate([*carries, np.zeros(2 * lanes, bool)])
    order = np.argsort(lane.astype(np.uint16) if lanes <= 1 << 16 else lane, kind="stable")
    lane, words, carry = lane[order], words[order], carry[order]
    at = (np.cumsum(~carry) - 1)[carry]
    lane, words = lane[~carry], words[~carry]
    np.add.at(words, at, _ONE)  # the first word of a block gets no carry that goes on
    while len(over := np.flatnonzero(words > _LOW32)):
        words[over] &= _LOW32
        np.add.at(words, over - 1, _ONE)
    ends = np.cumsum(np.bincount(lane, minlength=lanes))
    raw = words.astype("<u4").tobytes()
    return [raw[4 * a : 4 * b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]


def encode_blocks(ids: np.ndarray, block: int = BLOCK, shares: np.ndarray | None = None) -> list[bytes]:
    """The payload of each block of a segment's ids (each below 2**16), without counted chances."""
    if not len(ids):
        return []
    grid = _grid(ids, block)
    return _code(grid, _cases(grid), shares_of(ids) if shares is None else shares, chances_of())


def decode_blocks(payloads: list[bytes], total: int, block: int, shares: np.ndarray, chances: np.ndarray | None = None) -> np.ndarray:
    """The ids of a segment from its payloads."""
    lanes = len(payloads)
    if not lanes:
        return np.zeros(0, np.int64)
    steps = min(block, total)
    width = max(len(p) for p in payloads) // 4 + 4
    words = np.zeros((lanes, width), np.uint32)
    for i, p in enumerate(payloads):
        words[i, : len(p) // 4] = np.frombuffer(p, "<u4")
    flat = words.ravel()
    m, mix = _Model(lanes), _Mix(chances_of() if chances is None else chances)
    id_at = np.repeat(np.arange(1 << 16, dtype=np.uint16), shares)  # of each of 65,536 places the id
    shares, starts = np.append(shares, 65536), np.append(np.cumsum(shares) - shares, 0)
    rng = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    code = (words[:, 0].astype(np.uint64) << _S32) | words[:, 1]
    pos = np.arange(lanes) * width + 2
    grid = np.zeros((steps, lanes), np.uint16)
    for t in range(steps):
        mixed = m.predict()
        state, r = mixed.astype(np.int64), rng >> _S32
        v = (code // r).view(np.int64)
        top, end = v >> 16, mix.end.take(state)
        # quotients below 2**32 of whole numbers: a division of doubles, cut off, is exact
        place = ((v - (end << 16)) / (65536 - end)).astype(np.int64)
        told = top < end
        x = np.where(told, np.where(top < mix.end2.take(state), m.told2, m.told1), id_at.take(place, mode="clip"))
        outcome = m.outcome(x)
        case = (state << 2) + outcome
        part, of = mix.width.take(case), np.where(told, 65536, x.astype(np.int64))
        code = code - r * (mix.begin.take(case) + part * starts.take(of)).view(np.uint64)
        rng = r * (part * shares.take(of)).view(np.uint64)
        small = np.flatnonzero(rng <= _LOW32)
        if len(small):
            at = pos.take(small)
            code[small] = (code.take(small) << _S32) | flat.take(at, mode="clip")
            pos[small] = at + 1
            rng[small] = rng.take(small) << _S32
        grid[t] = x
        m.learn(x, outcome)
    return grid.T.ravel()[:total].astype(np.int64)


MAGIC = b"CMR4"


def _checksum(ids: np.ndarray, payload: bytes) -> int:
    """Of the ids and of the bytes that hold them: the last bytes of a payload have bits that no id depends on."""
    return zlib.crc32(payload, zlib.crc32(ids.tobytes()))


def _pack_known(shares: np.ndarray, chances: np.ndarray) -> bytes:
    ids = np.flatnonzero(shares)
    return zlib.compress(b"".join(x.astype("<u2").tobytes() for x in (chances, np.diff(ids, prepend=0), shares[ids] - 1)))


def _unpack_known(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(zlib.decompress(data), "<u2").astype(np.int64)
    chances, (gaps, less) = numbers[: 2 * _STATES].reshape(-1, 2), numbers[2 * _STATES :].reshape(2, -1)
    shares = np.zeros(1 << 16, np.int64)
    shares[np.cumsum(gaps)] = less + 1
    return shares, chances


def pack_segment(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A segment: magic, block size, number of ids, length and checksum of the shares and chances, these, then of each block its length and checksum, then the payloads."""
    raw = np.ascontiguousarray(ids, "<u2")
    shares, chances, payloads = shares_of(raw), chances_of(), []
    if len(raw):
        grid = _grid(raw, block)
        cases = _cases(grid)
        chances = chances_of(np.bincount(cases.ravel(), minlength=_STATES * _OUTCOMES))
        payloads = _code(grid, cases, shares, chances)
    known = _pack_known(shares, chances)
    heads = [(len(p), _checksum(raw[i * block : (i + 1) * block], p)) for i, p in enumerate(payloads)]
    numbers = [block, len(raw), len(known), zlib.crc32(known)]
    return b"".join([MAGIC, np.array(numbers, "<u4").tobytes(), known, np.array(heads, "<u4").tobytes(), *payloads])


def unpack_segment(data: bytes) -> np.ndarray:
    """The ids of a segment as unsigned 16-bit numbers; what doesn't match its checksum is an error."""
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    block, total, size, check = map(int, np.frombuffer(data, "<u4", 4, 4))
    known, at = data[20 : 20 + size], 20 + size
    if zlib.crc32(known) != check:
        raise ValueError("the shares of the segment do not match their checksum")
    lanes = -(-total // block)
    heads = np.frombuffer(data[at : at + 8 * lanes], "<u4").reshape(lanes, 2)
    begin = at + 8 * lanes + np.concatenate([[0], np.cumsum(heads[:, 0], dtype=np.int64)])
    payloads = [data[begin[i] : begin[i + 1]] for i in range(lanes)]
    ids = decode_blocks(payloads, total, block, *_unpack_known(known)).astype("<u2")
    for i, payload in enumerate(payloads):
        if _checksum(ids[i * block : (i + 1) * block], payload) != heads[i, 1]:
            raise ValueError(f"block {i} does not match its checksum")
    return ids
