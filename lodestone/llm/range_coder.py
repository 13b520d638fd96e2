"""Adaptive coding of token ids: predictions of order 0 to 2 are mixed and drive a range coder.

Blocks of ids are coded independently of one another, from a reset model. Many blocks are coded in step,
one array element a block, so that numpy does the work. All arithmetic is of whole numbers or of single
IEEE operations in a fixed order, so every machine decodes what another one has encoded.
"""

from __future__ import annotations

import numpy as np

#: What becomes of an id: the order-2 prediction, the order-1 prediction, an id of the block so far, a new one.
TWO, ONE, ZERO, NEW = range(4)
#: Parts of a probability of these four, as a power of two, the fewest that one of them gets, and what is left.
PARTS, LEAST = 14, 16
FREE = (1 << PARTS) - 4 * LEAST
#: A prediction is an id and, in the lowest bits, its state: how often in a row it was right (up to SURE), or that there is none.
STATE_BITS = 2
SURE, NONE = 2, 3
STATES = 1 << STATE_BITS
NOTHING = 0xFFFFFFFF
#: States of both orders together, and of order 1 with whether both say the same.
PAIRS, SAME = 2 * STATES * STATES, 2 * STATES
#: Probabilities and the weights of the orders follow what they have seen whenever so many ids have been coded.
WINDOW = 128
#: Weights are parts of this, as a power of two.
WEIGHTS = 8
#: A run of order 0 or of new ids is one number: an id, where its parts begin and, above that, how many they are.
ID_BITS, SLOT_BITS = 22, 23
#: Ids must be below this. Blocks are no longer than LONGEST.
MOST_IDS = 1 << ID_BITS
LONGEST = 1 << 17
#: Contexts are hashed by products below 2^32.
ONE_FACTOR, TWO_FACTOR = np.uint32(0x9E3779B1), np.uint32(0x2545F491)
#: A run of order 0 that is no choice: one part of one.
ALONE = np.array([1 << SLOT_BITS + ID_BITS])
#: Steps whose known parts are worked out at a time when ids are encoded.
AHEAD = 16
RANGE_LOW = np.uint64(1 << 48)
WORD = np.uint64(16)
FIRST_WORD = np.uint64(48)


def new_bits(limit: int) -> int:
    """All new ids together have two to the power of this parts: 8 to 16 an id, or fewer for very many ids."""
    return min((limit - 1).bit_length() + 4, SLOT_BITS)


def new_ids(limit: int) -> np.ndarray:
    """Bounds of the parts that each id below ``limit`` has as a new one, by Zipf's rule: vocabularies put frequent ids first."""
    upto = np.append(0, np.cumsum((1 << 32) // (np.arange(limit) + 1000)))
    return np.arange(limit + 1) + upto * ((1 << new_bits(limit)) - limit) // upto[-1]


def refreshes(block: int) -> list[int]:
    """When the order-0 counts are made anew: after 16, 32, 64, ... ids."""
    return [1 << i for i in range(4, 32) if 1 << i < block]


def _runs(ids: np.ndarray, starts: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return (parts << SLOT_BITS | starts) << ID_BITS | ids


def windows(length: int) -> list[int]:
    """When probabilities and weights are learnt: with every refresh of the first WINDOW ids, and then every WINDOW ids."""
    return [*(t for t in refreshes(length) if t < WINDOW), *range(WINDOW, length, WINDOW)]


def _first_guess(state: int, own: int, other: int | None = None) -> list[int]:
    """Starting counts of the four cases after a prediction in ``state``."""
    hit = 0 if state == NONE else 4 + 8 * state
    out = [1, 1, 5, 3]
    out[own if other is None else other] += hit
    return out


class Model:
    """Predictions for blocks that are coded in step.

    Orders 1 and 2 each predict the id that followed their context last. What such a prediction is
    worth depends on its state; each order has counts of the four cases by state, order 0 has one
    set. The three distributions are mixed by weights, which follow how much probability an order gave
    to what came. ``bounds`` has the mix for each pair of states and block: where the four cases begin,
    in 16 bits each. Arrays have the block last, those of both orders have order 1 first.
    """

    def __init__(self, blocks: int, length: int):
        if length > LONGEST:
            raise ValueError(f"blocks have at most {LONGEST} ids")
        self.blocks, self.length = blocks, length
        self.bits = max(8, (length - 1).bit_length())
        self.lanes = np.arange(blocks)
        self.base = np.stack([self.lanes << self.bits, (self.lanes + blocks) << self.bits])
        self.known = np.full(2 * blocks << self.bits, NOTHING, np.uint32)  # by order, block and context: a prediction
        first = [[_first_guess(s & NONE, ONE, TWO if s & STATES else None) for s in range(SAME)], [_first_guess(s, TWO) for s in range(STATES)], [[1, 1, 5, 3]]]
        self.counts = [np.repeat(np.array(x, np.int64).T[:, :, None], blocks, axis=2) for x in first]  # case, state, block
        self.weights = np.full((3, blocks), (1 << WEIGHTS) // 3, np.int64)
        self.worth = np.zeros((3, blocks), np.int64)
        self.ids = np.zeros((length, blocks), np.int32)
        self.seen = np.zeros((WINDOW, blocks), np.int64)  # of the window: case, pair of states and block
        self.times, self.due, self.ends = 0, set(refreshes(length)), set(windows(length))
        self.since = 0
        self._mix()

    def context(self, before: np.ndarray, before2: np.ndarray) -> np.ndarray:
        """Places of the predictions of both orders after these ids, in one more dimension before the last."""
        mixed = np.empty((*before.shape[:-1], 2, self.blocks), np.uint32)
        one, two = mixed[..., 0, :], mixed[..., 1, :]
        np.multiply(before, ONE_FACTOR, out=one)
        np.multiply(before2, TWO_FACTOR, out=two)
        two += one
        mixed >>= np.uint32(32 - self.bits)
        return mixed + self.base

    def pair(self, found: np.ndarray) -> np.ndarray:
        """The pair of states of predictions of both orders, with the block: a place in ``bounds``."""
        one, two = found[..., 0, :], found[..., 1, :]
        state = two & NONE
        state <<= 1
        state |= (one ^ two) < STATES
        state <<= STATE_BITS
        state |= one & NONE
        out = state.astype(np.int64)
        out *= self.blocks
        out += self.lanes
        return out

    def tell(self, at: np.ndarray, found: np.ndarray, key: np.ndarray) -> None:
        """The id after the contexts at ``at``, where ``found`` was predicted; ``key`` is the id with an empty state."""
        state = found ^ key
        right = state < NONE
        state += 1
        np.minimum(state, SURE, out=state)
        state *= right
        state |= key
        self.known[at.ravel()] = state.ravel()

    def passed(self, steps: int) -> None:
        """So many ids of each block have been written to ``ids`` and ``seen``."""
        self.times += steps
        self.since += steps
        if self.times in self.ends:
            self._learn(self.seen[: self.since])
            self.since = 0

    def _learn(self, seen: np.ndarray) -> None:
        """Counts and weights take in the ids of a window, and forget a part of what was before."""
        came = np.bincount(seen.ravel(), minlength=4 * PAIRS * self.blocks).reshape(4, STATES, SAME, self.blocks)
        of_two = came.sum(axis=2)
        for k, new in enumerate((came.sum(axis=1), of_two, of_two.sum(axis=1)[:, None])):
            counts = self.counts[k]
            # what the order gave to what came, before it takes that in
            self.worth[k] -= self.worth[k] >> 1
            self.worth[k] += (new * ((counts << 10) // counts.sum(axis=0))).sum(axis=(0, 1))
            counts -= counts >> 2
            counts += new * 4
            np.maximum(counts, 1, out=counts)
        worth = (self.worth >> 4) ** 2 + 1
        self.weights = (worth << WEIGHTS) // worth.sum(axis=0)
        self._mix()

    def _mix(self) -> None:
        """Weighted bounds of each pair of states; all weights and probabilities are whole numbers."""
        packed = []
        for k, counts in enumerate(self.counts):
            upto = np.cumsum(counts, axis=0)
            bounds = FREE * upto[:3] // upto[3]
            bounds *= self.weights[k]
            bounds >>= WEIGHTS
            if k == 2:
                bounds += LEAST * np.arange(1, 4)[:, None, None]
            packed.append((bounds[0] << 16) + (bounds[1] << 32) + (bounds[2] << 48))
        mixed = packed[1][:, None] + packed[0] + packed[2]
        self.bounds = np.append(mixed.ravel(), 0).astype("<i8").view("<u2")

    def share(self, pair: np.ndarray, case: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, parts) of the cases."""
        at = pair << 2
        at += case
        start = self.bounds.take(at)
        at += 1
        parts = self.bounds.take(at)
        parts -= start
        parts &= (1 << PARTS) - 1  # what begins after NEW is 0
        return start.astype(np.uint64), parts.astype(np.uint64)

    def refresh(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order 0: the ids of each block so far, sorted; an id's parts are its places there.

        Returns of each different id of a block where its run begins among all places, how long it is, and the run.
        """
        t, blocks = self.times, self.blocks
        rows = np.sort(np.ascontiguousarray(self.ids[:t].T), axis=1)
        new = np.ones((blocks, t), bool)
        np.not_equal(rows[:, 1:], rows[:, :-1], out=new[:, 1:])
        heads = np.flatnonzero(new)
        lengths = np.diff(heads, append=blocks * t)
        return heads, lengths, _runs(rows.ravel()[heads], heads & t - 1, lengths)  # t is a power of two


class Encoder:
    """Range coders in step, of 64 bits, that give 16 at a time."""

    def __init__(self, blocks: int, length: int):
        self.low = np.zeros(blocks, np.uint64)
        self.range = np.full(blocks, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.room = 3 * length + 8
        self.words = np.zeros(blocks * self.room, np.uint16)
        self.at = np.arange(blocks) * self.room

    def put(self, n: int, start: np.ndarray, parts: np.ndarray, whole: np.ndarray, start2: np.ndarray, parts2: np.ndarray) -> None:
        """Of the first n blocks, a case with its parts of 2 to the PARTS, and in it parts of 2 to the ``whole``."""
        low, span = self.low[:n], self.range[:n]
        span >>= np.uint64(PARTS)
        more = span * start
        span *= parts
        span >>= whole
        more += span * start2
        span *= parts2
        low += more
        self._carry(np.flatnonzero(low < more))
        # every block writes its next word, which stays if it is final
        at = self.at[:n]
        self.words[at] = low >> FIRST_WORD
        final = span < RANGE_LOW
        at += final
        bits = final * WORD
        low <<= bits
        span <<= bits
        while len(rows := np.flatnonzero(span < RANGE_LOW)):
            some = low[rows]
            self.words[at[rows]] = some >> FIRST_WORD
            at[rows] += 1
            low[rows] = some << WORD
            span[rows] <<= WORD

    def _carry(self, blocks: np.ndarray) -> None:
        at = self.at[blocks] - 1
        while len(at):
            self.words[at] += 1
            at = at[self.words[at] == 0] - 1

    def end(self) -> list[bytes]:
        for _ in range(4):
            self.words[self.at] = self.low >> FIRST_WORD
            self.at += 1
            self.low <<= WORD
        return [self.words[i * self.room : n].astype("<u2").tobytes() for i, n in enumerate(self.at.tolist())]


def encode(ids: np.ndarray, length: int, limit: int) -> list[bytes]:
    """Payloads of the blocks of ``length`` ids into which ``ids`` are cut; only the last may be shorter."""
    blocks = -(-len(ids) // length)
    if not blocks:
        return []
    model, coder, bounds_new = Model(blocks, length), Encoder(blocks, length), new_ids(limit)
    by_block = np.zeros((blocks, length), np.int32)
    by_block.ravel()[: len(ids)] = ids
    model.ids = np.ascontiguousarray(by_block.T)
    del by_block
    short = len(ids) - (blocks - 1) * length
    whole = np.array([0, 0, 0, new_bits(limit)], np.uint64)
    bits, runs = 0, np.full(blocks, -1)  # by block and hash: a run of order 0
    ends = sorted({*windows(length), *range(AHEAD, length, AHEAD), min(length, len(ids))})
    before2 = before = np.zeros((1, blocks), np.uint32)
    for first, end in zip([0, *ends], ends, strict=False):
        if first >= len(ids) or first >= length:
            break
        x = model.ids[first:end].astype(np.int64)
        said = np.concatenate([before2, before, model.ids[first:end].view(np.uint32)])
        at, key = model.context(said[1:-1], said[:-2]), said[2:] << STATE_BITS
        before2, before = said[-2:-1], said[-1:]
        found = np.empty((end - first, 2, blocks), np.uint32)
        for t in range(end - first):
            model.known.take(at[t], out=found[t], mode="clip")
            model.tell(at[t], found[t], key[t])
        run = runs.take(_hash(x, bits) + (model.lanes << bits))
        case = NEW - ((run & MOST_IDS - 1 == x) & (run >= 0)).astype(np.int64)
        right = (found ^ key[:, None]) < NONE
        case[right[:, 0]] = ONE
        case[right[:, 1]] = TWO
        pair = model.pair(found)
        start, parts = model.share(pair, case)
        run -= ALONE
        run *= case == ZERO
        run += ALONE
        run >>= ID_BITS
        start2 = run & (1 << SLOT_BITS) - 1
        run >>= SLOT_BITS
        rows = np.flatnonzero(case == NEW)
        new = x.ravel()[rows]
        begins = bounds_new[new]
        start2.ravel()[rows] = begins
        run.ravel()[rows] = bounds_new[new + 1] - begins
        of, start2, parts2 = whole.take(case), start2.view(np.uint64), run.view(np.uint64)
        for t in range(end - first):
            n = blocks if first + t < short else blocks - 1
            coder.put(n, start[t, :n], parts[t, :n], of[t, :n], start2[t, :n], parts2[t, :n])
        case *= PAIRS * blocks
        case += pair
        model.seen[model.since : model.since + end - first] = case
        model.passed(end - first)
        if end in model.due and end < min(length, len(ids)):
            heads, _, made = model.refresh()
            bits = end.bit_length() - 1
            whole[ZERO] = bits
            runs = np.full(blocks << bits, -1)
            runs[(heads & -end) + _hash(made & MOST_IDS - 1, bits)] = made
    return coder.end()


def _hash(x: np.ndarray, bits: int) -> np.ndarray:
    x = x * 0x9E3779B1
    x &= 0xFFFFFFFF
    x >>= 32 - bits
    return x


def decode(payloads: list[bytes], count: int, length: int, limit: int) -> np.ndarray:
    """The ``count`` ids of blocks of ``length`` that :func:`encode` has made."""
    blocks = len(payloads)
    if not blocks:
        return np.zeros(0, np.int32)
    words = np.frombuffer(b"".join([*payloads, bytes(8)]), "<u2")
    place = np.cumsum([0, *(len(p) // 2 for p in payloads[:-1])])
    code, span = np.zeros(blocks, np.uint64), np.full(blocks, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for _ in range(4):
        code = (code << WORD) | words[place]
        place += 1
    model, bounds_new = Model(blocks, length), new_ids(limit)
    whole = np.array([0, 0, 0, new_bits(limit)], np.uint64)
    # by their parts: a run that is no choice, those of new ids, and then those of order 0
    fixed_parts = np.append(1, np.diff(bounds_new))
    fixed = np.append(ALONE, _runs(np.arange(limit), bounds_new[:-1], fixed_parts[1:]))
    runs = np.repeat(fixed, fixed_parts)
    firsts, mask = np.zeros(blocks, np.int64), 0
    before2 = before = np.zeros(blocks, np.uint32)
    steps = min(length, count)
    for t in range(steps):  # what a last block that has ended gives from there on is cut off below
        at = model.context(before, before2)
        found = model.known.take(at, mode="clip")
        pair = model.pair(found)
        bounds = model.bounds.view("<i8").take(pair).view("<u2").reshape(-1, 4)
        share = span >> np.uint64(PARTS)
        value = np.minimum(code // share, (1 << PARTS) - 1).astype(np.uint16)
        case = (value >= bounds[:, 1]).astype(np.int64)
        case += value >= bounds[:, 2]
        case += value >= bounds[:, 3]
        start, parts = model.share(pair, case)
        code -= share * start
        np.multiply(share, parts, out=span)
        share = span >> whole.take(case)
        value = (code // share).view(np.int64)
        spot = value & mask
        spot += firsts
        spot *= case == ZERO
        value += 1
        value *= case == NEW
        spot += value
        run = runs.take(spot, mode="clip")
        x = (run & MOST_IDS - 1).astype(np.uint32)
        guess = found >> STATE_BITS
        guess[0] *= case == ONE
        guess[1] *= case == TWO
        x += guess[0]
        x += guess[1]
        run >>= ID_BITS
        start2 = run & (1 << SLOT_BITS) - 1
        run >>= SLOT_BITS
        code -= share * start2.view(np.uint64)
        np.multiply(share, run.view(np.uint64), out=span)
        final = span < RANGE_LOW
        bits = final * WORD
        code <<= bits
        code |= words.take(place, mode="clip") * final
        span <<= bits
        place += final
        while len(rows := np.flatnonzero(span < RANGE_LOW)):
            code[rows] = (code[rows] << WORD) | words.take(place[rows], mode="clip")
            place[rows] += 1
            span[rows] <<= WORD
        model.tell(at, found, x << STATE_BITS)
        model.ids[t] = x
        before2, before = before, x
        case *= PAIRS * blocks
        case += pair
        model.seen[model.since] = case
        model.passed(1)
        if t + 1 in model.due and t + 1 < steps:
            _, lengths, made = model.refresh()
            runs = np.repeat(np.concatenate([fixed, made]), np.concatenate([fixed_parts, lengths]))
            firsts, mask = model.lanes * (t + 1) + 1 + int(bounds_new[-1]), t
            whole[ZERO] = (t + 1).bit_length() - 1
    ids = model.ids
    del model, runs
    return np.ascontiguousarray(ids.T).ravel()[:count]
