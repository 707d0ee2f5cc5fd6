"""Blocks of token ids under an adaptive context-mixing range coder.

A block is coded from a fresh model. Order 0 counts every id; orders 1 and 2 hold, for the id before and the two ids before,
small lists of the ids that followed and how often. The three distributions are mixed: the probability of a listed id is the sum
of what each order gives it, times the order's weight (its share of order 0 is noted when it comes), and an id that neither list
holds has its share of order 0 in what the listed ids leave. The weights follow how much each order contributed to the ids so far, apart for every standing of the two
lists (how much they have seen, and whether it was always the same). Order 0 gives ids not met before as much as ids met once
have; which of them it is takes a second step, in which all are alike. The mixed probabilities drive a range coder with 62-bit
state and 31-bit words. Shares are rounded to whole numbers before they are used, by steps that the decoder does alike.

For speed in numpy a block is cut into STREAMS runs that are coded side by side, many blocks at once; each run has its own
coder, all of a block share its model. The lists learn after every step of all runs, order 0 and the weights at the end of each
short segment, in the decoder as in the encoder. Memory is bounded by the callers, who give blocks of bounded size, a bounded
number at once: a block's model takes about two megabytes for 50,000 ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMR3"
STREAMS = 128
#: All shares add up to 1 << MIX_BITS; counts of order 0 to LIMIT at most. LEAST is left for ids that no list holds, SLACK for rounding.
MIX_BITS, LIMIT, LEAST, SLACK = 30, 1 << 20, 1 << 22, 1 << 12
#: Contexts of orders 1 and 2, by hash (powers of two), and how many ids that followed each holds, how often at most.
SLOTS, FOLLOW, MOST = (1 << 14, 1 << 16), 4, 255
_FOLLOW_BITS = FOLLOW.bit_length() - 1
#: An entry of a list: an id, the share that order 0 gave it when it last came (four bits of exponent, three of mantissa), its count.
_ID, _HELD, _SHARE = 15, 255, 127 << 8
#: What makes the bits of a share, 20 to the left, those of a float32 from 2^-16 to 1.
_BIAS = 111 << 23
_STANDINGS, _TIMES = 64, 22
_WORD, _UNIT = np.uint64(31), np.uint64(MIX_BITS)
_MASK = np.uint64((1 << 31) - 1)
_LOW = np.uint64(1 << 31)
_LISTED = 2 * FOLLOW


def _levels() -> np.ndarray:
    """By whether a list holds one id alone and how much it has seen: one of eight levels."""
    n = np.arange(FOLLOW * (MOST + 1))
    several = np.digitize(n, (1, 4, 10, 32)) + 3
    alone = np.minimum(n, 3)
    return np.stack([np.where(n == 0, 0, several), alone], 1).ravel()


_LEVEL = _levels()
_RANK = np.arange(_LISTED, 0, -1, dtype=np.uint8)[:, None]
_PLACE = np.arange(FOLLOW, dtype=np.int32)[:, None]


class _Model:
    """Of several blocks; `block` says whose each lane is. An empty place of a list holds an id of its own that never occurs."""

    def __init__(self, blocks: int, size: int, block: np.ndarray, orders: int):
        if size + 2 > 1 << 32 - _ID:
            raise ValueError(f"{size} ids are too many")
        self.blocks, self.size, self.orders, self.block = blocks, size, orders, block
        self.seen = np.zeros((blocks, size), np.int32)
        self.places = np.zeros((blocks, size), np.int64)  # how many ids before this one, in order, and how often it came
        self.share = np.zeros((blocks, size), np.int16)
        self.met, self.total = np.zeros(blocks, np.int64), np.zeros(blocks)
        self.lists = np.empty((blocks * sum(SLOTS), FOLLOW), np.int32)
        for k, rows in enumerate(np.split(self.lists.view(np.uint32), [blocks * SLOTS[0]])):
            rows[...] = (size + k) << _ID
        self.rows, self.entries = self.lists.view(np.complex128).ravel(), self.lists.ravel()
        self.part = np.full((3, blocks * _STANDINGS), 32.0)
        self.first = (block * size).astype(np.int64)
        self.base = np.stack([block * SLOTS[0], blocks * SLOTS[0] + block * SLOTS[1]]).astype(np.int64)
        self.own = block * _STANDINGS
        self.lane = np.arange(len(block))
        self.kept: list[tuple] = []
        self.hit, self.n = None, -1
        self._settle()

    def _settle(self) -> None:
        """What coding reads: order 0 as all ids met in order, and the orders' weights."""
        runs = []
        for b in range(self.blocks):
            seen = self.seen[b]
            ids = (seen != 0).nonzero()[0]
            n = seen[ids]
            if n.sum() >= LIMIT:
                n = (n + 1) // 2
                seen[ids] = n
            stop = np.cumsum(n)
            once, total = np.count_nonzero(n == 1) + 1, int(stop[-1]) if len(n) else 0
            self.places[b, ids] = (stop - n) << _TIMES | n
            share = (n / np.float32(total + once)).astype(np.float32).view(np.int32) - _BIAS
            self.share[b, ids] = np.clip(share >> 20, 0, 127) << 8
            self.met[b], self.total[b] = total, total + once
            runs.append(np.repeat(ids.astype(np.int32), n))
        self.ordered = np.concatenate(runs)
        self.at = np.cumsum(self.met) - self.met
        spare = (1 << MIX_BITS) - LEAST - SLACK
        share = self.part / self.part.sum(0)
        if self.orders < 2:
            share[self.orders + 1 :] = 0
        self.weight = (share[1:] * spare).astype(np.float32)
        self.rest = ((1 - share[1:].sum(0)) * spare).astype(np.float32)

    def mix(self, before: np.ndarray, last: np.ndarray) -> None:
        """For the first lanes, with these two ids before: the ids listed, what each order gives them, and where each begins."""
        n = len(last)
        if n != self.n:
            self._room(n)
        count, ids, begin, wide = self.count, self.ids, self.begin, self.wide
        np.bitwise_and(last, SLOTS[0] - 1, out=self.slot[0])
        np.bitwise_and((before * 40503 + last * 2654435761) >> 7, SLOTS[1] - 1, out=self.slot[1])
        self.slot += self.base[:, :n]
        entry = self.entry
        entry[...] = self.rows.take(self.slot).view(np.int32).reshape(2, n, FOLLOW).transpose(0, 2, 1)
        np.bitwise_and(entry, _HELD, out=count)
        np.right_shift(entry.view(np.uint32), _ID, out=ids.view(np.uint32))
        sums, most = count[:, 0] + count[:, 1], np.maximum(count[:, 0], count[:, 1])
        for k in range(2, FOLLOW):
            sums += count[:, k]
            np.maximum(most, count[:, k], out=most)
        most = (most == sums).view(np.int8).astype(np.int32)
        most += sums
        most += sums
        level = _LEVEL.take(most)
        self.standing = standing = level[0] * 8
        standing += level[1]
        standing += self.own[:n]
        np.maximum(sums, 1, out=sums)
        scale = self.weight.take(standing, axis=1)
        scale /= sums.astype(np.float32)
        one, both, two = self.gave[0, :FOLLOW], self.gave[1, :FOLLOW], self.gave[1, FOLLOW:_LISTED]
        one[...], two[...] = count[0], count[1]
        one *= scale[0]
        two *= scale[1]
        same = ids[0] == ids[1][:, None]  # what both lists hold counts with the first
        np.add.reduce(same.view(np.int8).astype(np.float32) * two[:, None], out=both)
        once = np.bitwise_or.reduce(same, axis=1)
        np.logical_not(once, out=once)
        np.bitwise_and(entry, _SHARE, out=entry)
        entry <<= 12
        entry += _BIAS
        share = entry.view(np.float32)
        whole = np.add.reduce(share.reshape(_LISTED, n))  # noted at different times, they may be more than 1
        share *= self.rest.take(standing) / np.maximum(whole, np.float32(1), out=whole)
        share += 1
        share[0] += one
        share[0] += both
        share[1] += two
        share[1] *= once.view(np.int8).astype(np.float32)
        wide[:_LISTED] = share.reshape(_LISTED, n)
        for k in range(_LISTED):
            np.add(begin[k], wide[k], out=begin[k + 1])
        np.subtract(1 << MIX_BITS, begin[_LISTED], out=wide[_LISTED])

    def _room(self, n: int) -> None:
        self.n, self.slot = n, np.empty((2, n), np.int64)
        self.entry, self.count, self.ids = (np.empty((2, FOLLOW, n), np.int32) for _ in range(3))
        self.begin, self.wide = np.zeros((_LISTED + 1, n), np.int32), np.empty((_LISTED + 1, n), np.int32)
        self.gave = np.zeros((2, _LISTED + 1, n), np.float32)  # what each order gives: rows for the ids of both lists, then none

    def span(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where id x begins in the mixture and how wide it is; the lanes whose id wasn't met before."""
        self.hit = self.ids == x.astype(np.int32)
        self.k = _LISTED - np.maximum.reduce(self.hit.view(np.uint8).reshape(_LISTED, -1) * _RANK).astype(np.int64)
        out = (self.k == _LISTED).nonzero()[0]
        place = self.first[out] + x[out]
        return self.settled(out, place)

    def settled(self, out: np.ndarray, place: np.ndarray, new: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and width where the listed id is known, and for the lanes `out` by order 0. Products stay below 2^53, so that the
        floors of these quotients are exact."""
        at = self.k * self.n
        at += self.lane[: self.n]
        begin, wide = self.begin.ravel().take(at), self.wide.ravel().take(at)
        self.part_of = self.gave.reshape(2, -1).take(at, axis=1)
        self.part_of /= wide.astype(np.float32)
        block = self.block[out]
        under = self.places.ravel().take(place)
        times = (under & ((1 << _TIMES) - 1)).astype(np.float64)
        under = (under >> _TIMES).astype(np.float64)
        new = times == 0 if new is None else new
        left, total = wide[out].astype(np.float64), self.total[block]
        under[new], times[new] = self.met[block[new]], total[new] - self.met[block[new]]
        lo, hi = np.floor(left * under / total), np.floor(left * (under + times) / total)
        begin[out] += lo.astype(np.int32)
        wide[out] = (hi - lo).astype(np.int32)
        return begin, wide, out[new]

    def find(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The id in whose span v lies, and the same as span() of it; an id not met before isn't known yet."""
        self.k = np.add.reduce((self.begin[1:] <= v).view(np.uint8), dtype=np.uint8).astype(np.int64)
        out = (self.k == _LISTED).nonzero()[0]
        at = np.minimum(self.k, _LISTED - 1) * self.n + self.lane[: self.n]
        x = self.ids.ravel().take(at)
        block = self.block[out]
        left = self.wide[_LISTED, out]
        t = np.floor(((v[out] - self.begin[_LISTED, out] + 1) * self.total[block] - 1) / left).astype(np.int64)
        new = t >= self.met[block]
        got = self.ordered.take(np.minimum(self.at[block] + t, len(self.ordered) - 1)) if len(self.ordered) else np.zeros(len(out), np.int32)
        place = self.first[out] + got
        x[out] = got
        return x, *self.settled(out, place, new)

    def learn(self, x: np.ndarray) -> None:
        """The lists: the count of a listed id grows; one not listed takes the place of the rarest if that came once at most, and wears
        it down otherwise. Of lanes that change the same place in one step, the last has its way."""
        n, x = self.n, x.astype(np.int32)
        hit = (self.ids == x if self.hit is None else self.hit).astype(np.int32)
        self.hit = None
        hit <<= 20
        mark = self.count * FOLLOW
        mark += _PLACE
        mark -= hit  # the least is the listed place, else the rarest
        low = np.minimum(mark[:, 0], mark[:, 1])
        for k in range(2, FOLLOW):
            np.minimum(low, mark[:, k], out=low)
        known, held = low < 0, (low & ((1 << 20) - 1)) >> _FOLLOW_BITS
        at = (low & (FOLLOW - 1)).astype(np.int64)
        self.slot *= FOLLOW
        at += self.slot
        place = x + self.first[:n]
        entry = held & (low >> 31)
        entry += (x << _ID) + (self.share.ravel().take(place).astype(np.int32) + 1)
        at, entry, worn = at.ravel(), entry.ravel(), ((held > 1) > known).ravel().nonzero()[0]
        entry[worn] = self.entries[at[worn]] - 1
        self.entries[at] = entry
        if held.max() >= MOST - 1:
            full = at[((held >= MOST - 1) & known).ravel()] // FOLLOW
            rows = self.lists[full]
            self.lists[full] = rows - ((rows & _HELD) >> 1)
        self.kept.append((self.standing, place, self.part_of))

    def end(self) -> None:
        """Order 0 and the weights learn what came since the last segment."""
        standing, place = (np.concatenate([k[i] for k in self.kept]) for i in (0, 1))
        share = np.concatenate([k[2] for k in self.kept], axis=1)
        np.add.at(self.seen.ravel(), place, np.int32(1))
        got = [np.bincount(standing, s, minlength=self.part.shape[1]) for s in share]
        n = np.bincount(standing, minlength=self.part.shape[1])
        for k, s in enumerate((np.maximum(n - got[0] - got[1], 0), *got)):
            self.part[k] += s * 32
        self.kept.clear()
        self._settle()


def _segments(steps: int) -> list[int]:
    """After which steps order 0 and the weights learn."""
    out, at = [], 1
    while at < steps:
        out.append(at - 1)
        at += max(1, min(64, at))
    return out


def _layout(sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start within its block and length of each lane, and the order in which they are coded: the longest first, so that those not at
    their end are always the first ones."""
    per = np.array([-(-n // STREAMS) for n in sizes], np.int64)
    starts = (np.arange(STREAMS)[None, :] * per[:, None]).ravel()
    lengths = np.clip(np.repeat(np.array(sizes, np.int64), STREAMS) - starts, 0, np.repeat(per, STREAMS))
    return starts, lengths, np.argsort(-lengths, kind="stable")


def encode(blocks: list[np.ndarray], size: int, orders: int = 2) -> list[bytes]:
    """The coded words of each block of ids below `size`, which is below 2^17 - 1; fewer orders than two are there to compare."""
    if not blocks:
        return []
    if max(map(len, blocks)) > 1 << 21:
        raise ValueError("a block is too long")
    starts, lengths, order = _layout([len(b) for b in blocks])
    steps, lanes = int(lengths.max(initial=0)), len(starts)
    data = np.zeros((lanes, steps + 2), np.int32)  # two zeros stand before each run
    for j, i in enumerate(order.tolist()):
        data[j, 2 : 2 + lengths[i]] = blocks[i // STREAMS][starts[i] : starts[i] + lengths[i]]
    data = np.ascontiguousarray(data.T)
    live = np.searchsorted(-lengths[order], -np.arange(steps))
    model = _Model(len(blocks), size, order // STREAMS, orders)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 62) - 1, np.uint64)
    out, at = np.zeros((2 * steps + 2, lanes), np.uint32), np.zeros(lanes, np.int64)  # the highest bit of a word is its carry

    def put(on, begin: np.ndarray, wide: np.ndarray) -> None:
        unit = width[on] >> _UNIT
        lo, w = low[on] + unit * begin.astype(np.uint64), unit * wide.astype(np.uint64)
        full = (w < _LOW).nonzero()[0]
        lane, some = full if isinstance(on, slice) else on[full], lo[full]
        out[at[lane], lane] = some >> _WORD
        at[lane] += 1
        lo[full] = (some & _MASK) << _WORD
        w[full] <<= _WORD
        low[on], width[on] = lo, w

    ends = set(_segments(steps))
    for t, n in enumerate(live.tolist()):
        before, last, x = (data[t + k, :n].astype(np.int64) for k in range(3))
        model.mix(before, last)
        begin, wide, new = model.span(x)
        put(slice(0, n), begin, wide)
        if len(new):
            lo = (x[new] << MIX_BITS) // size
            put(new, lo, ((x[new] + 1 << MIX_BITS) // size) - lo)
        model.learn(x)
        if t in ends:
            model.end()
    # one word more tells a run from the next: the least multiple of 2^31 in its range
    every = np.arange(lanes)
    low += _MASK
    out[at, every] = low >> _WORD
    at += 1
    for k in range(len(out) - 1, 0, -1):
        out[k - 1] += out[k] >> np.uint32(31)
    out &= np.uint32((1 << 31) - 1)
    at[lengths[order] == 0] = 0
    place = np.argsort(order)
    words, counts = np.ascontiguousarray(out[: at.max()].T, "<u4"), at.tolist()
    coded = [np.concatenate([words[j, : counts[j]] for j in place[i : i + STREAMS].tolist()]) for i in range(0, lanes, STREAMS)]
    return [at[place[i : i + STREAMS]].astype("<u2").tobytes() + c.tobytes() for i, c in zip(range(0, lanes, STREAMS), coded, strict=True)]


def decode(coded: list[bytes], sizes: list[int], size: int, orders: int = 2) -> list[np.ndarray]:
    if not coded:
        return []
    starts, lengths, order = _layout(sizes)
    steps, lanes = int(lengths.max(initial=0)), len(starts)
    counts = np.concatenate([np.frombuffer(c, "<u2", STREAMS) for c in coded]).astype(np.int64)
    words = np.concatenate([*(np.frombuffer(c, "<u4", offset=2 * STREAMS) for c in coded), np.zeros(1, "<u4")]).astype(np.uint64)
    if len(words) - 1 != counts.sum():
        raise ValueError("a block is cut short")
    stop = np.cumsum(counts)
    at, stop = (stop - counts)[order], stop[order]

    def word(lane) -> np.ndarray:
        got = words[np.where(at[lane] < stop[lane], at[lane], len(words) - 1)]  # zeros after the end
        at[lane] += 1
        return got

    every = slice(0, lanes)
    code, width = (word(every) << _WORD) | word(every), np.full(lanes, (1 << 62) - 1, np.uint64)
    data = np.zeros((steps + 2, lanes), np.int32)
    live = np.searchsorted(-lengths[order], -np.arange(steps))
    model = _Model(len(coded), size, order // STREAMS, orders)

    def value(on) -> tuple[np.ndarray, np.ndarray]:
        unit = width[on] >> _UNIT
        return unit, np.minimum(code[on] // unit, np.uint64((1 << MIX_BITS) - 1)).astype(np.int64)

    def take(on, unit: np.ndarray, begin: np.ndarray, wide: np.ndarray) -> None:
        c, w = code[on] - unit * begin.astype(np.uint64), unit * wide.astype(np.uint64)
        full = (w < _LOW).nonzero()[0]
        c[full] = (c[full] << _WORD) | word(full if isinstance(on, slice) else on[full])
        w[full] <<= _WORD
        code[on], width[on] = c, w

    ends = set(_segments(steps))
    for t, n in enumerate(live.tolist()):
        model.mix(data[t, :n].astype(np.int64), data[t + 1, :n].astype(np.int64))
        unit, v = value(slice(0, n))
        x, begin, wide, new = model.find(v.astype(np.int32))
        take(slice(0, n), unit, begin, wide)
        if len(new):
            unit, v = value(new)
            got = ((v + 1) * size - 1) >> MIX_BITS
            lo = (got << MIX_BITS) // size
            take(new, unit, lo, ((got + 1 << MIX_BITS) // size) - lo)
            x[new] = got
        data[t + 2, :n] = x
        model.learn(x)
        if t in ends:
            model.end()
    whole, place = np.ascontiguousarray(data[2:].T), np.argsort(order)
    return [np.concatenate([whole[place[i + k], : lengths[i + k]] for k in range(STREAMS)]) for i in range(0, lanes, STREAMS)]


def frame(coded: bytes, ids: np.ndarray, index: bytes) -> bytes:
    """A block of a file: magic, number of ids, length of the index, checksum of the ids, index, words, checksum of all."""
    head = MAGIC + struct.pack("<QII", len(ids), len(index), zlib.crc32(ids.astype("<u4").tobytes()))
    body = head + index + coded
    return body + struct.pack("<I", zlib.crc32(body))


def unframe(block: bytes) -> tuple[int, int, bytes, bytes]:
    """(number of ids, their checksum, index, words); a damaged block raises ValueError."""
    if len(block) < 24 or block[:4] != MAGIC or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("a block is damaged")
    n, size, crc = struct.unpack("<QII", block[4:20])
    return n, crc, block[20 : 20 + size], block[20 + size : -4]
