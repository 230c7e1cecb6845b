"""Adaptive context-mixing range coder for blocks of token ids.

Every block is coded on its own: its model starts empty and its header carries
checksums, so blocks can be read, lost or checked singly. A block lists its
distinct ids and is cut into ``STREAMS`` streams that share one model and take
a step at a time side by side, as do those of up to ``LANES`` blocks: a numpy
lane each.

Order-2 and order-1 contexts each predict one id. Which of them is right is an
event (order-2, order-1, neither). Both contexts give it a distribution, from
the events seen at their confidence, and the two are mixed by weights that are
learned, one for each pair of confidences. An id that neither foresaw is coded
by the adaptive order-0 model of the block's ids, within the same step.

The model learns in rounds, after 1, 2, 4, ... and then every ``_ROUND`` steps,
from all that its streams coded in the round. Its counts are whole numbers, and
its weights come from sums, products and quotients alone.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK, STREAMS = 1 << 15, 32
#: Blocks coded side by side; about 500 KB of tables and buffers each, at the default block.
LANES = 128
MAGIC = b"PSIE"
_ROUND = 128
#: Slots of a block's order-2 contexts.
_SLOTS = 1 << 13
_GAIN = 4
#: Of 2**16, what an id that neither context foresaw has at least.
_REST = 256
_HEAD = struct.Struct("<4sIIIIII")
_U = np.uint64
_FULL, _LOW, _WORD = _U(2**64 - 1), _U(1 << 32), _U(32)

#: Confidence after a miss, by the confidence before, then after a hit.
_SURE = np.array([0, 0, 0, 1, 1, 2, 3, 3], np.int32)


def _steps(n: int) -> int:
    return -(-n // STREAMS)


def _rounds(steps: int) -> list[tuple[int, int]]:
    ends, at = [], 1
    while at < steps:
        ends.append(at)
        at += min(at, _ROUND)
    ends.append(steps)
    return list(zip([0, *ends[:-1]], ends))


class _Model:
    """Predictions and counts of all blocks, in flat arrays of block after block."""

    def __init__(self, distinct: np.ndarray, streams: int):
        k, self.streams = len(distinct), streams
        self.size = distinct
        bits = np.array([max(15, int(d).bit_length() + 2) for d in distinct], np.int64)
        self.total, self.start = 1 << bits, np.cumsum(distinct) - distinct
        self.local = np.arange(int(distinct.sum())) - np.repeat(self.start, distinct)
        self.local = self.local.astype(np.uint16 if int(distinct.max()) <= 1 << 16 else np.int32)
        self.count = np.ones(len(self.local), np.int64)
        self.one, self.two = np.zeros(len(self.local), np.int32), np.zeros(k * _SLOTS, np.int32)
        self.events = [np.tile(np.array(start, np.int64), (k, 4, 1)) for start in ((6, 2, 16), (2, 6, 16))]
        self.weight = np.full((k, 4, 4), 0.5)
        lane = lambda x: np.repeat(x, streams)
        self.bits, self.top = lane(bits).astype(_U), lane(self.total - 1).astype(_U)
        self.symbols, self.hashes = lane(self.start), lane(np.arange(k) * _SLOTS)
        self.slots, self.pairs = lane(np.cumsum(self.total) - self.total), lane(np.arange(k) * 16)
        self.order0()
        self.mix()

    def order0(self) -> None:
        """Interval of each id in its block's ``total``."""
        before = np.cumsum(self.count) - self.count
        sums = np.add.reduceat(self.count, self.start)
        before -= np.repeat(before[self.start], self.size)
        low = before * np.repeat(self.total - self.size, self.size) // np.repeat(sums, self.size) + self.local
        self.part = np.append(low[1:], 0) - low
        last = self.start + self.size - 1
        self.part[last] = self.total - low[last]
        self.low, self.wide = low.astype(_U), self.part.astype(_U)

    def lookup(self) -> np.ndarray:
        """The id at each place of all blocks' intervals."""
        return np.repeat(self.local, self.part)

    def mix(self) -> None:
        """Where the events end, of 2**16, for each pair of confidences."""
        self.odds = [e / (e[..., :1] + e[..., 1:2] + e[..., 2:]) for e in self.events]
        self.odds = [self.odds[0][:, :, None], self.odds[1][:, None]]
        w = self.weight[..., None]
        self.mixed = self.odds[0] * w + self.odds[1] * (1 - w)
        bounds = (self.mixed[..., :2] * ((1 << 16) - _REST - 3)).astype(np.int64) + 1
        self.first, self.second = bounds[..., 0].ravel().astype(_U), (bounds[..., 0] + bounds[..., 1]).ravel().astype(_U)

    def places(self, prev: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the order-1 and order-2 contexts of the first lanes are."""
        n = prev.shape[-1]
        return prev + self.symbols[:n], (prev * 40503 + before & _SLOTS - 1) + self.hashes[:n]

    def learn(self, ids: np.ndarray, one: np.ndarray, two: np.ndarray, *saw: np.ndarray) -> None:
        """From a round's ids, step after step, the places of their contexts and what the two said there."""
        n, k = ids.shape[1], ids.shape[1] // self.streams
        right = [s >> 4 == ids for s in saw]
        event = np.where(right[1], 0, np.where(right[0], 1, 2))
        pair = ((saw[0] | saw[1]) & 15) + self.pairs[:n]
        seen = np.bincount((pair * 3 + event).ravel(), minlength=len(self.first) * 3).reshape(-1, 4, 4, 3)[:k]
        post = self.weight[:k, ..., None] * self.odds[0][:k] / self.mixed[:k]
        gain = seen * post
        self.weight[:k] = (8 * self.weight[:k] + (gain[..., 0] + gain[..., 1] + gain[..., 2])) / (8 + seen.sum(axis=3))
        self.events[0][:k] += seen.sum(axis=2)
        self.events[1][:k] += seen.sum(axis=1)
        self.mix()
        self.count += _GAIN * np.bincount((ids + self.symbols[:n])[event == 2], minlength=len(self.count))
        self.order0()
        for table, at, was, hit, shift in ((self.one, one, saw[0], right[0], 0), (self.two, two, saw[1], right[1], 2)):
            sure = (was & 15) >> shift
            table[at.ravel()] = (np.where(hit | (sure > 1), was & -16, ids << 4) | _SURE.take(sure + 4 * hit) << shift).ravel()


class _Encoder:
    def __init__(self, lanes: int, room: int):
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, _FULL)
        self.out, self.pos = np.zeros((lanes, room), np.uint32), np.zeros(lanes, np.int64)

    def _carry(self, lanes: np.ndarray) -> None:
        where = self.pos[lanes] - 1
        while lanes.size:
            self.out[lanes, where] += np.uint32(1)
            more = self.out[lanes, where] == 0
            lanes, where = lanes[more], where[more] - 1

    def put(self, add: np.ndarray, rng: np.ndarray) -> None:
        """Narrows the intervals of the first lanes to ``rng`` beyond ``add``."""
        n = len(add)
        low = self.low[:n] + add
        if (over := np.flatnonzero(low < add)).size:
            self._carry(over)
        if (small := np.flatnonzero(rng < _LOW)).size:
            at = low[small]
            self.out[small, self.pos[small]] = at >> _WORD
            self.pos[small] += 1
            low[small], rng[small] = at << _WORD, rng[small] << _WORD
        self.low[:n], self.range[:n] = low, rng

    def finish(self) -> list[bytes]:
        """Each lane's words; what follows is read as zeros."""
        low = self.low + (_LOW - _U(1))
        self._carry(np.flatnonzero(low < self.low))
        self.out[np.arange(len(low)), self.pos] = low >> _WORD
        return [self.out[i, : n + 1].astype("<u4").tobytes() for i, n in enumerate(self.pos.tolist())]


def _squeeze(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 6)


def _stretch(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _alphabet(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, ascending, and the place of each id among them."""
    if (top := int(ids.max())) >> 20:
        return np.unique(ids, return_inverse=True)
    place = np.zeros(top + 1, np.int32)
    place[ids] = 1
    distinct = np.flatnonzero(place)
    place[distinct] = np.arange(len(distinct))
    return distinct, place.take(ids)


def _checksum(says: tuple[int, ...], body: bytes) -> int:
    return zlib.crc32(body, zlib.crc32(struct.pack("<IIII", *says)))


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """Coded blocks of ``ids`` (unsigned, below 2**31), ``block`` ids (at most 2**18) in each but the last.

    A stream of any length takes the memory of ``LANES`` blocks.
    """
    if not 0 < block <= 1 << 18:
        raise ValueError("a block has 1 to 2**18 ids")
    room = block * LANES
    return [b for a in range(0, len(ids), room) for b in _encode_lanes(np.asarray(ids[a : a + room]), block)]


def _encode_lanes(ids: np.ndarray, block: int) -> list[bytes]:
    cuts = [ids[i : i + block] for i in range(0, len(ids), block)]
    steps = np.array([_steps(len(c)) for c in cuts])
    known, grid = [], np.zeros((len(cuts) * STREAMS, int(steps[0])), np.int32)
    for i, c in enumerate(cuts):
        distinct, own = _alphabet(c)
        known.append(distinct)
        filled = np.zeros(STREAMS * int(steps[i]), np.int32)
        filled[: len(c)] = own
        grid[i * STREAMS : (i + 1) * STREAMS, : steps[i]] = filled.reshape(STREAMS, -1)
    grid = np.concatenate([np.zeros((2, len(grid)), np.int32), grid.T])  # two steps that nobody codes come first
    model, coder = _Model(np.array([len(d) for d in known]), STREAMS), _Encoder(grid.shape[1], int(steps[0]) + 4)
    for a, b in _rounds(int(steps[0])):
        # lanes of steps a to b; those of a shorter last block end on the way
        n, x = STREAMS * int((steps > a).sum()), grid[a + 2 : b + 2]
        x = x[:, :n]
        one, two = model.places(grid[a + 1 : b + 1, :n].astype(np.int64), grid[a:b, :n])
        p, q = model.one.take(one), model.two.take(two)
        pair = ((p | q) & 15) + model.pairs[:n]
        hit2, hit1 = q >> 4 == x, p >> 4 == x
        either = hit1 | hit2
        first, second = model.first.take(pair), model.second.take(pair)
        at = x + model.symbols[:n]
        low, wide = model.low.take(at), model.wide.take(at)
        for t in range(b - a):
            m = n if a + t < steps[-1] else STREAMS * int((steps > a + t).sum())
            rng = coder.range[:m]
            r = rng >> _U(16)
            add = second[t, :m] * r
            left = rng - add
            own = left >> model.bits[:m]
            left = wide[t, :m] * own
            if (hits := np.flatnonzero(either[t, :m])).size:
                head, is2 = first[t, hits] * r[hits], hit2[t, hits]
                left[hits] = np.where(is2, head, add[hits] - head)
                own *= low[t, :m]
                add += own
                add[hits] = np.where(is2, _U(0), head)
            else:
                add += low[t, :m] * own
            coder.put(add, left)
        if b < steps[0]:
            m = STREAMS * int((steps > b).sum())
            model.learn(x[:, :m], one[:, :m], two[:, :m], p[:, :m], q[:, :m])
    streams, blocks = coder.finish(), []
    for i, c in enumerate(cuts):
        own = streams[i * STREAMS : (i + 1) * STREAMS]
        side = _squeeze(np.concatenate([np.diff(known[i], prepend=0).astype(np.int64), [len(s) // 4 for s in own]]))
        body = side + b"".join(own)
        says = len(c), len(side), zlib.crc32(c.astype("<u4").tobytes()), len(body)
        blocks.append(_HEAD.pack(MAGIC, *says, _checksum(says, body), STREAMS) + body)
    return blocks


def decode_blocks(blocks: list[bytes]) -> list[np.ndarray]:
    """Ids of each block; a block that isn't as it was written raises ValueError."""
    return [x for a in range(0, len(blocks), LANES) for x in _decode_lanes(blocks[a : a + LANES])]


def _decode_lanes(blocks: list[bytes]) -> list[np.ndarray]:
    heads = [_HEAD.unpack_from(b) for b in blocks]
    for h, b in zip(heads, blocks):
        if h[0] != MAGIC or h[6] != STREAMS or h[4] != len(b) - _HEAD.size or h[5] != _checksum(h[1:5], b[_HEAD.size :]):
            raise ValueError("a block of ids is damaged")
    if not blocks:
        return []
    order = sorted(range(len(blocks)), key=lambda i: -heads[i][1])
    steps = np.array([_steps(heads[i][1]) for i in order])
    known, sizes, body = [], [], []
    for i in order:
        at = _HEAD.size + heads[i][2]
        side = _stretch(blocks[i][_HEAD.size : at])
        known.append(np.cumsum(side[:-STREAMS]))
        sizes.append(side[-STREAMS:])
        body.append(np.append(np.frombuffer(blocks[i], "<u4", offset=at).astype(np.uint32), np.zeros(2, np.uint32)))
    lanes = len(order) * STREAMS
    # a lane's words, then zeros
    size = np.concatenate(sizes)
    words = np.zeros((lanes, int(size.max()) + 3), np.uint32)
    for i, (s, b) in enumerate(zip(sizes, body)):
        ends = np.cumsum(s)
        for j, (e, w) in enumerate(zip(ends.tolist(), s.tolist())):
            words[i * STREAMS + j, :w] = b[e - w : e]
    room, words = words.shape[1], words.ravel()
    pos = np.arange(lanes) * room
    code = words.take(pos).astype(_U) << _WORD | words.take(pos + 1)
    pos += 2
    rng = np.full(lanes, _FULL)
    model = _Model(np.array([len(d) for d in known]), STREAMS)
    grid = np.zeros((int(steps[0]) + 2, lanes), np.int32)
    prev, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for a, b in _rounds(int(steps[0])):
        n = STREAMS * int((steps > a).sum())
        slot, both = model.lookup(), model.low << _WORD | model.wide
        places = [np.zeros((b - a, n), np.int64) for _ in range(2)]
        saw = [np.zeros((b - a, n), np.int32) for _ in range(2)]
        for t in range(a, b):
            m = n if t < steps[-1] else STREAMS * int((steps > t).sum())
            if m < len(prev):
                prev, before, code, rng, pos = prev[:m], before[:m], code[:m], rng[:m], pos[:m]
            one, two = model.places(prev, before)
            p, q = model.one.take(one), model.two.take(two)
            places[0][t - a, :m], places[1][t - a, :m], saw[0][t - a, :m], saw[1][t - a, :m] = one, two, p, q
            pair = ((p | q) & 15) + model.pairs[:m]
            r = rng >> _U(16)
            second = model.second.take(pair) * r
            left, rest = rng - second, code - second
            own = left >> model.bits[:m]
            place = np.minimum(rest // own, model.top[:m]).view(np.int64)
            x = slot.take(place + model.slots[:m]).astype(np.int64)
            left = both.take(x + model.symbols[:m])
            rest -= (left >> _WORD) * own
            left &= _LOW - _U(1)
            left *= own
            if (hits := np.flatnonzero(code < second)).size:
                head, c = model.first.take(pair[hits]) * r[hits], code[hits]
                is2 = c < head
                rest[hits] = np.where(is2, c, c - head)
                left[hits] = np.where(is2, head, second[hits] - head)
                x[hits] = np.where(is2, q[hits], p[hits]) >> 4
            if (small := np.flatnonzero(left < _LOW)).size:
                where = pos[small]
                rest[small] = rest[small] << _WORD | words.take(where)
                left[small] <<= _WORD
                pos[small] = where + 1
            grid[t + 2, :m] = x
            code, rng, before, prev = rest, left, prev, x
        if b < steps[0]:
            m = STREAMS * int((steps > b).sum())
            model.learn(grid[a + 2 : b + 2, :m], *(y[:, :m] for y in places + saw))
    out = [np.zeros(0, np.int64)] * len(blocks)
    for k, i in enumerate(order):
        own = grid[2 : steps[k] + 2, k * STREAMS : (k + 1) * STREAMS].T.ravel()[: heads[i][1]]
        out[i] = known[k].take(own)
        if zlib.crc32(out[i].astype("<u4").tobytes()) != heads[i][3]:
            raise ValueError("a block's ids don't match their checksum")
    return out
