"""Adaptive context-mixing range coder for token ids.

Ids are coded in blocks that are reset and checksummed on their own. In a block, the id before (order 1)
and the two ids before (order 2) each predict the id that followed them last. One of the two is proposed;
whether it is right is coded with a probability from a logistic mixer: the confidence of the order-2 prediction,
that of the order-1 prediction and the recent hits each choose a weight, the weights add up, and all three
learn from the error of the mixed probability. If it is wrong, the id is coded by adaptive order-0 frequencies
of its high and low byte, each by itself: order 0 stands behind the mixer, not in it. All numbers are integers (those of the
coder are below 2^53 and held in doubles, where they are exact), so a block decodes alike on every machine.

Blocks don't depend on each other, so many are coded side by side: a numpy array holds one number for
each block, and step t codes the id at place t of all of them. A step takes all blocks through the same operations,
whatever was right in which, and the frequencies are drawn up anew at the places ``RENEWED`` only.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 2048
MAGIC = b"CMR2"
#: Slots of the order-1 contexts; the order-2 contexts have twice as many.
SLOTS = 512
#: What the frequencies of a byte add up to, and the probability that a proposal is right and that it is not.
TOTAL = 1 << 11
SURE = 1 << 12
#: A range is below 2^48 and, between ids, not below this.
LEAST = 2.0**32
WORD = 65536.0
#: Places before which a block's frequencies are drawn up from the ids so far; beyond the last, every 1,024.
RENEWED = (40, 256)
#: Entries of a block's frequencies: of 256 bytes, and of the whole. An entry is a start times 65,536, and a width.
ROW, WHOLE = 257, 256
#: 12-bit probability of log(p / (1 - p)) in 1/256 from -2048 to 2047; made by rule, the same everywhere. Neither outcome costs more than seven bits.
_SQUASH = np.array([round(4096 / (1 + 2.718281828459045 ** (-x / 256))) for x in range(-2048, 2048)], np.int32).clip(32, 4064)
#: How often in a row an id has followed, by how its entry differs from that of the id that comes: 0 to 15 where the id is the same.
_SURE = np.array([*range(1, 16), 15, 1], np.int32)
#: Slot of an id as the last one, and what it adds to that as the one before the last (order 2).
_LAST = (np.arange(1 << 16, dtype=np.int64) * 0x2F0B4C47 >> 7) & (SLOTS - 1)
_BEFORE = (np.arange(1 << 16, dtype=np.int64) * 0x6C8E9CF5 >> 9) & (SLOTS - 1)


def _renewed(t: int) -> bool:
    return t in RENEWED or (t > 0 and t % 1024 == 0)


class _Model:
    """Predictions and frequencies of n blocks. With ``inverse`` also the byte at each place of the frequencies."""

    def __init__(self, n: int, inverse: bool = False):
        rows = np.arange(n)
        self.at_row, self.at_place = rows * ROW, rows * TOTAL
        self.at_slot = [rows * SLOTS, rows * (2 * SLOTS)]
        self.at_weight = [rows * 16, rows * 32, rows * 64]
        # The id that followed a context last, times 16, and how often in a row (0: never seen).
        self.seen = [np.zeros(n * SLOTS * (order + 1), np.int32) for order in range(2)]
        # In 1/65,536; the middle of _SQUASH is part of the last.
        self.weight = [np.zeros(n * w, np.int32) for w in (16, 32, 64)]
        self.weight[0][::16] = -(1 << 17)
        self.weight[2][:] = 1 << 19
        self.hits = np.zeros(n, np.int64)
        self.slot = self.at_slot
        self.before = np.zeros(n, np.int64)
        even = np.append((np.arange(256, dtype=np.int32) * (TOTAL // 256) << 16) + TOTAL // 256, np.int32(TOTAL)).astype(np.int32)
        self.count = [np.zeros((n, 256), np.int32) for _ in range(2)]
        self.row = [np.tile(even, n) for _ in range(2)]
        self.inverse = [np.tile(np.repeat(np.arange(256, dtype=np.uint8), TOTAL // 256), n) for _ in range(2)] if inverse else []

    def renew(self, ids: np.ndarray) -> None:
        """Frequencies of all bytes, at least 1 each, that add up to TOTAL; ``ids`` (places, blocks) are those since the last time."""
        k = ids.shape[1]
        base = np.arange(k) * 256
        for side, byte in enumerate((ids >> 8, ids & 255)):
            count = self.count[side][:k]
            count += np.bincount((byte + base).ravel(), minlength=k * 256).reshape(k, 256)
            sums = np.cumsum(count, axis=1, dtype=np.int32)
            # Quotients of integers below 2^24 are rounded to no integer that they don't reach.
            scaled = sums * (TOTAL - 256.0)
            scaled /= sums[:, -1:]
            ends = scaled.astype(np.int32)
            ends += np.arange(1, 257, dtype=np.int32)
            widths = np.diff(ends, axis=1, prepend=np.int32(0))
            self.row[side].reshape(-1, ROW)[:k, :256] = ((ends - widths) << 16) + widths
            if self.inverse:
                self.inverse[side][: k * TOTAL] = np.repeat(np.tile(np.arange(256, dtype=np.uint8), k), widths.ravel())

    def propose(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Entry of the id proposed in the first k blocks, and the 12-bit probability that it is right."""
        self.by = [seen.take(slot[:k], mode="clip") for seen, slot in zip(self.seen, self.slot, strict=True)]
        by1, by2 = self.by
        sure2 = by2 & 15
        guess = by1 * (by2 == 0)
        guess += by2
        cell1 = by1 & 15
        cell1 += cell1
        cell1 += (by1 ^ guess) < 16
        self.cell = [self.at_weight[0][:k] + sure2, self.at_weight[1][:k] + cell1, self.at_weight[2][:k] + self.hits[:k]]
        self.held = [w.take(c, mode="clip") for w, c in zip(self.weight, self.cell, strict=True)]
        mixed = self.held[0] + self.held[1]
        mixed += self.held[2]
        mixed >>= 8
        self.chance = _SQUASH.take(mixed, mode="clip")
        return guess, self.chance

    def learn(self, k: int, ids: np.ndarray, hit: np.ndarray) -> None:
        wrong = hit.astype(np.int32)
        hits = self.hits[:k]
        hits += hits
        hits += hit
        hits &= 63
        wrong <<= 12
        wrong -= self.chance
        for weight, cell, held in zip(self.weight, self.cell, self.held, strict=True):
            held += wrong
            weight[cell] = held
        now = ids << 4
        for seen, slot, by in zip(self.seen, self.slot, self.by, strict=True):
            by ^= now
            by = _SURE.take(by, mode="clip")
            by += now
            seen[slot[:k]] = by
        last = _LAST.take(ids, mode="clip")
        self.slot = [last + self.at_slot[0][:k], self.before[:k] + self.at_slot[1][:k]]
        self.slot[1] += last
        self.before = _BEFORE.take(ids, mode="clip")


def _laid_out(lengths: list[int]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Blocks by falling length, their lengths, and the number of blocks that have an id at each place."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    sizes = np.array([lengths[i] for i in order])
    return order, sizes, np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Payload of each block of ids below 65,536, larger ones raise; blocks may differ in length, none is empty."""
    if not blocks:
        return []
    if max(int(b.max()) for b in blocks) >= 1 << 16:
        raise ValueError("the range coder takes ids below 65,536")
    n = len(blocks)
    order, sizes, active = _laid_out([len(b) for b in blocks])
    longest = int(sizes[0])
    ids = np.zeros((n, longest), np.uint16)
    for lane, i in enumerate(order):
        ids[lane, : sizes[lane]] = blocks[i]
    ids = np.ascontiguousarray(ids.T)
    model = _Model(n)
    low, span = np.zeros(n), np.full(n, 2.0**48)
    # Words of 16 bits and a carry. An id ends at most two, and the last state is three.
    out = np.zeros(n * (2 * longest + 4), np.uint32)
    at = np.arange(n)
    since = 0
    for t, k in enumerate(active.tolist()):
        if _renewed(t):
            model.renew(ids[since:t, :k])
            since = t
        x = ids[t, :k].astype(np.int32)
        guess, chance = model.propose(k)
        hit = (guess >> 4) == x
        # Whether the proposal is right, ...
        lo, r, pos = low[:k], span[:k], at[:k]
        split = r * (1 / SURE)
        np.floor(split, out=split)
        split *= chance
        r -= split
        right = np.flatnonzero(hit)
        r[right] = split[right]
        split[right] = 0.0
        lo += split
        # ... then the high and the low byte; those of a right proposal have the whole width.
        for row, byte in zip(model.row, (x >> 8, x & 255), strict=True):
            byte[right] = WHOLE
            entry = row.take(byte + model.at_row[:k], mode="clip")
            r *= 1 / TOTAL
            np.floor(r, out=r)
            lo += r * (entry >> 16)
            entry &= 0xFFFF
            r *= entry
        model.learn(k, x, hit)
        # The topmost words of ranges that have become narrow are done.
        for _ in range(2):
            to = np.flatnonzero(r < LEAST)
            if not len(to):
                break
            held, place = lo.take(to), pos.take(to)
            word = np.floor(held * (1 / LEAST))
            out[place] = word
            place += n
            pos[to] = place
            word *= LEAST
            held -= word
            held *= WORD
            lo[to] = held
            r[to] = r.take(to) * WORD
    for _ in range(3):
        word = np.floor(low * (1 / LEAST))
        out[at] = word
        at += n
        low = (low - word * LEAST) * WORD
    counts = at // n
    by_block = np.ascontiguousarray(out[: int(counts.max()) * n].reshape(-1, n).T)
    words = by_block[np.arange(by_block.shape[1]) < counts[:, None]]
    while len(over := np.flatnonzero(words > 0xFFFF)):  # a block's first word has no carry
        words[over] &= 0xFFFF
        words[over - 1] += 1
    coded, ends = words.astype(">u2").tobytes(), np.cumsum(counts) * 2
    payloads: list[bytes] = [b""] * n
    for lane, i in enumerate(order):
        payloads[i] = coded[ends[lane] - 2 * counts[lane] : ends[lane]]
    return payloads


@np.errstate(over="ignore")
def decode_blocks(payloads: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """Ids of each payload, as uint32; those of a damaged one are any ids."""
    if not payloads:
        return []
    n = len(payloads)
    order, sizes, active = _laid_out(lengths)
    ids = np.zeros((int(sizes[0]), n), np.uint16)
    # Each block's words, and zeros behind the last for those that a damaged block may ask for.
    sources = [payloads[i][: len(payloads[i]) // 2 * 2] for i in order]
    ends = np.cumsum([len(p) // 2 + 4 for p in sources])
    words = np.frombuffer(b"".join(p + bytes(8) for p in sources), ">u2").astype(np.uint16)
    at, last = np.append(0, ends[:-1]), ends - 1
    model = _Model(n, inverse=True)
    code, span = np.zeros(n), np.full(n, 2.0**48)
    for _ in range(3):
        code *= WORD
        code += words[at]
        at += 1
    since = 0
    for t, k in enumerate(active.tolist()):
        if _renewed(t):
            model.renew(ids[since:t, :k])
            since = t
        guess, chance = model.propose(k)
        c, r, pos = code[:k], span[:k], at[:k]
        split = r * (1 / SURE)
        np.floor(split, out=split)
        split *= chance
        hit = c < split
        r -= split
        right = np.flatnonzero(hit)
        r[right] = split[right]
        split[right] = 0.0
        c -= split
        found = []
        for row, inverse in zip(model.row, model.inverse, strict=True):
            r *= 1 / TOTAL
            np.floor(r, out=r)
            # A quotient of integers below 2^48 is rounded to no integer that it doesn't reach. Only damaged blocks have one beyond TOTAL.
            value = c / r
            value = np.minimum(value, TOTAL - 1, out=value).astype(np.int64)
            value += model.at_place[:k]
            place = inverse.take(value, mode="clip").astype(np.int64)
            found.append(place.astype(np.int32))
            place[right] = WHOLE
            place += model.at_row[:k]
            entry = row.take(place, mode="clip")
            c -= r * (entry >> 16)
            entry &= 0xFFFF
            r *= entry
        x = found[0]
        x <<= 8
        x |= found[1]
        x[right] = guess[right] >> 4
        ids[t, :k] = x
        model.learn(k, x, hit)
        for _ in range(2):
            to = np.flatnonzero(r < LEAST)
            if not len(to):
                break
            place = pos.take(to)
            np.minimum(place, last.take(to), out=place)
            held = c.take(to)
            held *= WORD
            held += words.take(place, mode="clip")
            c[to] = held
            pos[to] = place + 1
            r[to] = r.take(to) * WORD
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * n
    by_block = ids.T.astype(np.uint32, order="C")
    for lane, i in enumerate(order):
        out[i] = by_block[lane, : sizes[lane]]
    return out


def pack_blocks(payloads: list[bytes], blocks: list[np.ndarray]) -> bytes:
    """A run of blocks: magic, number of blocks, then of each the number of ids, bytes and crc32 of the ids, then all payloads."""
    head = [MAGIC, struct.pack("<I", len(payloads))]
    head += [struct.pack("<III", len(b), len(p), zlib.crc32(b.astype("<u4").tobytes())) for p, b in zip(payloads, blocks, strict=True)]
    return b"".join([*head, *payloads])


def unpack_blocks(run: bytes) -> tuple[list[bytes], list[int], list[int]]:
    """Payloads, numbers of ids and checksums of a run."""
    if run[:4] != MAGIC:
        raise ValueError("not a run of coded token blocks")
    (n,) = struct.unpack_from("<I", run, 4)
    heads = [struct.unpack_from("<III", run, 8 + 12 * i) for i in range(n)]
    at, payloads = 8 + 12 * n, []
    for _, size, _ in heads:
        payloads.append(run[at : at + size])
        at += size
    if at != len(run):
        raise ValueError("a run of coded token blocks is cut short or has rest")
    return payloads, [h[0] for h in heads], [h[2] for h in heads]
