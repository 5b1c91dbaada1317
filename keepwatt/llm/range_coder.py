"""An adaptive range coder for token ids that mixes predictions of order 0, 1 and 2.

A block of ids is coded in frames, each up to four times as long as the one before it. Within a
frame the model stands still; after it, encoder and decoder both learn from its ids. So all
probabilities of a frame come from whole-array operations, and its ids are dealt to lanes of
``STEPS`` ids with a coder state each, which advance together. Blocks start from nothing.

The probability of an id is a mixture: a share for the id that last followed the two ids before
it, a share for the one that last followed the one before it, and the rest by frequency. The
shares are learned for each state of confidence of the two contexts.

Coder states and masses are whole numbers below 2**53 held as floats, whose products, quotients
and floors are exact here and, unlike those of integers, run several at a time. A lane's low end
keeps its carry until its word is written; words that carry are settled at the end of a frame.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

STEPS = 128
FIRST_FRAME, LARGEST_FRAME = 4096, 1 << 19  # few frames, so few steps with some cost each
TOTAL_BITS, FREQ_BITS, SLOT_BITS = 24, 20, 18
WORD_BITS, LEAST_BITS = 24, 28  # of a word, and of the least width of a lane
WORD, LEAST = 2.0 ** WORD_BITS, 2.0 ** LEAST_BITS
FULL, TOTAL, FREQ = WORD * LEAST, 2.0 ** TOTAL_BITS, 2.0 ** FREQ_BITS
SURE, SURE_BITS = 4, 3  # the most sure a context gets, and the bits that hold it
STATES = 2 * (SURE + 1) ** 2
HEAD = struct.Struct("<4sIII")
MAGIC = b"KWT2"


@dataclass
class Frame:
    """Contexts and what the model says about them."""

    slot: np.ndarray
    known2: np.ndarray
    known1: np.ndarray
    second: np.ndarray
    first: np.ndarray
    state: np.ndarray


def _floor(bounds: np.ndarray, ids: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Bounds of ids in masses of which ``rest`` goes by frequency."""
    masses = bounds.take(ids)
    masses *= rest
    return np.floor(masses, out=masses)


class Model:
    def __init__(self, vocab: int):
        if vocab > 1 << (FREQ_BITS - 1):
            raise ValueError(f"at most {1 << (FREQ_BITS - 1)} ids can be coded")
        self.vocab, self.none = vocab, vocab
        self.counts = np.zeros(vocab, np.int64)
        # the id that last followed a context, and below it how sure that is: 0 if none did
        self.next1 = np.zeros(vocab + 1, np.int32)
        self.next2 = np.zeros(1 << SLOT_BITS, np.int32)
        self.seen, self.hit2, self.hit1 = (np.zeros(STATES, np.int64) for _ in range(3))
        self.settle()

    def settle(self) -> None:
        """Frequencies and shares for the next frame."""
        spare = (1 << FREQ_BITS) - self.vocab
        known = max(int(self.counts.sum()), 1)
        self.frequency = 1 + self.counts * spare // known
        self.frequency[-1] += (1 << FREQ_BITS) - self.frequency.sum()
        bounds = np.concatenate([[0], np.cumsum(self.frequency)]) / FREQ
        self.below, self.after = bounds[:-1], bounds[1:]
        room = (1 << TOTAL_BITS) - (1 << FREQ_BITS)
        share2 = room * self.hit2 // (self.seen + 1)
        share1 = room * self.hit1 // (self.seen + 1)
        self.share2, self.share1 = share2.astype(float), share1.astype(float)
        self.rest = TOTAL - self.share2 - self.share1

    def look(self, before2: np.ndarray, before1: np.ndarray) -> Frame:
        slot = before2.view(np.uint32) * np.uint32(0x85EBCA77)
        slot += before1.view(np.uint32) * np.uint32(0x9E3779B1)
        slot >>= np.uint32(32 - SLOT_BITS)
        known2, known1 = self.next2.take(slot), self.next1.take(before1)
        second, first = known2 >> SURE_BITS, known1 >> SURE_BITS
        low = (1 << SURE_BITS) - 1
        state = known2 & low
        state *= SURE + 1
        state += known1 & low
        state += state
        state += second == first
        return Frame(slot, known2, known1, second, first, state)

    def interval(self, at: Frame, ids: np.ndarray, share2, share1, rest):
        """Where the masses of ids start, and the masses."""
        start, size = _floor(self.below, ids, rest), _floor(self.after, ids, rest)
        size -= start
        for guess, share in ((at.second, share2), (at.first, share1)):
            start += share * (guess < ids)
            size += share * (guess == ids)
        return start, size

    def learn(self, at: Frame, before1: np.ndarray, ids: np.ndarray) -> None:
        right2, right1 = at.second == ids, at.first == ids
        self.seen += np.bincount(at.state, minlength=STATES)
        self.hit2 += np.bincount(at.state[right2], minlength=STATES)
        self.hit1 += np.bincount(at.state[right1 & (at.second != at.first)], minlength=STATES)
        new, low = ids << SURE_BITS, (1 << SURE_BITS) - 1
        self.next2[at.slot] = new + np.where(right2, np.minimum((at.known2 & low) + 1, SURE), 1)
        self.next1[before1] = new + np.where(right1, np.minimum((at.known1 & low) + 1, SURE), 1)
        self.counts += np.bincount(ids, minlength=self.vocab)
        self.settle()


def frames(n: int):
    """(from, to) of the frames of a block of n ids."""
    low, size = 0, FIRST_FRAME
    while low < n:
        yield low, min(low + size, n)
        low, size = low + size, min(4 * size, LARGEST_FRAME)


def _lanes(ids: np.ndarray, none: int):
    """Ids in lanes (rows of STEPS) and the two ids before each within its lane, row by row."""
    lanes = -(-len(ids) // STEPS)
    grid = np.zeros(lanes * STEPS, np.int32)
    grid[:len(ids)] = ids
    before1, before2 = np.empty_like(grid), np.empty_like(grid)
    before1[1:], before2[2:] = grid[:-1], grid[:-2]
    before1[::STEPS] = before2[::STEPS] = before2[1::STEPS] = none
    return grid, before2, before1


def _packed(words: np.ndarray, written: np.ndarray) -> bytes:
    """The words of each lane (column), carries settled: how many, then all of them."""
    flat = np.ascontiguousarray(words.T)[written.T]
    while len(over := np.flatnonzero(flat >> WORD_BITS)):
        flat[over] -= 1 << WORD_BITS
        flat[over - 1] += 1  # of the same lane, whose first word cannot carry
    used = written.sum(axis=0).astype("<u2")
    return used.tobytes() + flat.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _encode_frame(model: Model, ids: np.ndarray) -> bytes:
    grid, before2, before1 = _lanes(ids, model.none)
    at = model.look(before2, before1)
    starts, sizes = model.interval(at, grid, model.share2.take(at.state),
                                   model.share1.take(at.state), model.rest.take(at.state))
    # the last lane may be short: its other steps code nothing
    starts[len(ids):], sizes[len(ids):] = 0, TOTAL
    # one step at a time, all lanes side by side
    starts = np.ascontiguousarray(starts.reshape(-1, STEPS).T)
    sizes = np.ascontiguousarray(sizes.reshape(-1, STEPS).T)
    lanes = starts.shape[1]
    low, width = np.zeros(lanes), np.full(lanes, FULL)
    words = np.zeros((STEPS + 2, lanes), np.int32)
    written = np.zeros((STEPS + 2, lanes), bool)
    for step in range(min(STEPS, len(ids))):
        unit = width * (1 / TOTAL)
        np.floor(unit, out=unit)
        low += starts[step] * unit
        np.multiply(sizes[step], unit, out=width)
        narrow = np.less(width, LEAST, out=written[step])
        out = np.flatnonzero(narrow)
        some = low[out]
        word = np.floor(some * (1 / LEAST))
        words[step, out] = word
        low[out] = (some - word * LEAST) * WORD
        width[out] *= WORD
    low = np.ceil(low * (WORD / LEAST))  # all but the last four bits
    words[-2], words[-1] = np.floor(low / WORD), low % WORD
    written[-2:] = True
    n = len(ids)
    model.learn(Frame(*(x[:n] for x in vars(at).values())), before1[:n], grid[:n])
    return _packed(words, written)


def _decode_frame(model: Model, n: int, data: memoryview) -> tuple[np.ndarray, int]:
    lanes = -(-n // STEPS)
    used = np.frombuffer(data, "<u2", lanes).astype(np.int64)
    total = int(used.sum())
    words = np.zeros((total + 3, 4), np.uint8)
    words[:total, :3] = np.frombuffer(data, np.uint8, 3 * total, 2 * lanes).reshape(-1, 3)
    words = words.view("<u4").ravel().astype(np.int64)
    # a lane holds two words and four bits more, so it goes on with words cut four bits later
    extra = WORD_BITS - (LEAST_BITS - WORD_BITS)
    stream = ((words[:-1] << WORD_BITS | words[1:]) >> extra & (1 << WORD_BITS) - 1).astype(float)
    at_word = np.cumsum(used) - used
    code = (words.take(at_word, mode="clip") * LEAST
            + (words.take(at_word + 1, mode="clip") << WORD_BITS
               | words.take(at_word + 2, mode="clip")) // (1 << extra))
    at_word += 2
    id_at = np.repeat(np.arange(model.vocab, dtype=np.int32), model.frequency)
    width = np.full(lanes, FULL)
    before1 = np.full(lanes, model.none, np.int32)
    before2 = before1
    grid = np.zeros((STEPS, lanes), np.int32)
    last = n - (lanes - 1) * STEPS
    for step in range(min(STEPS, n)):
        at = model.look(before2, before1)
        share2, share1 = model.share2.take(at.state), model.share1.take(at.state)
        rest = model.rest.take(at.state)
        unit = width * (1 / TOTAL)
        plain = code / np.floor(unit, out=unit)
        np.floor(plain, out=plain)
        # a guess has its share behind its mass by frequency: take out what lies below
        after2, after1 = (_floor(model.after, guess, rest) for guess in (at.second, at.first))
        after2 += share1 * (at.first < at.second)
        for end, share in ((after2, share2), (after1, share1)):
            np.subtract(plain, end, out=end)
            end += 1
            np.maximum(end, 0, out=end)
            plain -= np.minimum(end, share, out=end)
        plain *= FREQ
        plain += FREQ - 1
        plain /= rest
        found = id_at.take(plain.astype(np.int32), mode="clip")
        start, size = model.interval(at, found, share2, share1, rest)
        if step >= last:
            start[-1], size[-1], found[-1] = 0, TOTAL, 0
        start *= unit
        code -= start
        size *= unit
        width = size
        out = np.flatnonzero(width < LEAST)
        width[out] *= WORD
        some = at_word[out]
        code[out] = code[out] * WORD + stream.take(some, mode="clip")
        at_word[out] = some + 1
        grid[step] = found
        before2, before1 = before1, found
    ids = np.ascontiguousarray(grid.T).ravel()[:n]
    _, lane2, lane1 = _lanes(ids, model.none)
    model.learn(model.look(lane2[:n], lane1[:n]), lane1[:n], ids)
    return ids, 2 * lanes + 3 * total


def encode_block(ids: np.ndarray, vocab: int) -> bytes:
    """A block that can be read on its own: head with a CRC-32 of the ids, then the frames."""
    ids = np.asarray(ids)
    if len(ids) and not 0 <= ids.min() <= ids.max() < vocab:
        raise ValueError("ids outside the vocabulary")
    model = Model(vocab)
    body = [_encode_frame(model, ids[low:high]) for low, high in frames(len(ids))]
    return b"".join([HEAD.pack(MAGIC, vocab, len(ids), zlib.crc32(ids.astype("<u4"))), *body])


def decode_block(data: bytes) -> np.ndarray:
    """The ids of a block as unsigned 32-bit numbers; damage is an error."""
    magic, vocab, n, crc = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    model, rest, parts = Model(vocab), memoryview(data)[HEAD.size:], [np.zeros(0, np.int32)]
    with np.errstate(all="ignore"):  # damaged lanes may get any value; the checksum tells
        for low, high in frames(n):
            ids, length = _decode_frame(model, high - low, rest)
            rest = rest[length:]
            parts.append(ids)
    ids = np.concatenate(parts).astype("<u4")
    if zlib.crc32(ids) != crc:
        raise ValueError("the checksum of the block does not match")
    return ids
