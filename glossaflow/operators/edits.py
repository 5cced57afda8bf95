"""Edit distances of two small blocks of texts, all pairs at once, for use inside tasks.

Numbers of character pairs tell most pairs of two languages apart, by one product of matrices.  The others
are compared by bit vectors over the diagonals that so few edits can reach, many pairs side by side, until a
pair is beyond its limit.  No pair within its limit is lost.
"""

from __future__ import annotations

import numpy as np

#: Bins that character pairs are counted in; pairs that share one make texts look more alike, never less.
BINS = 2048
#: So often a bin is told apart in a text; what is beyond counts as shared.
REPEATS = 64
#: Pairs side by side: what they need stays in a core's cache.
SIDE_BY_SIDE = 32768
#: Texts on each side of those pairs, and entries of the tables of letters that are kept for them.
RUN, ENTRIES = 128, 16384
#: Pairs are put off when only one in so many is left, and compared with all others that are.
FEW = 8
#: Texts longer than this are left to the caller, as few of them lie side by side.
LONG = 2048
UNDECIDED = -1


def _padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Texts as rows of small numbers from 1 with at least one 0 on both sides, their lengths, and the largest number."""
    points = [np.frombuffer(t.encode("utf-32-le"), "<u4") for t in texts]
    lengths = np.array([len(p) for p in points], dtype=np.int64)
    letters, numbers = np.unique(np.concatenate(points), return_inverse=True)
    rows = np.zeros((len(texts), int(lengths.max()) + 2), dtype=np.int64)
    rows[:, 1:-1][np.arange(rows.shape[1] - 2) < lengths[:, None]] = numbers.ravel() + 1
    return rows, lengths, len(letters)


def _counts(rows: np.ndarray, lengths: np.ndarray, letters: int) -> np.ndarray:
    """How often each bin of character pairs occurs in a row, its ends included."""
    bins = (rows[:, :-1] * (letters + 1) + rows[:, 1:]) % BINS
    inside = np.arange(bins.shape[1]) <= lengths[:, None]
    flat = (bins + np.arange(len(rows))[:, None] * BINS)[inside]
    return np.bincount(flat, minlength=len(rows) * BINS).reshape(len(rows), BINS).astype(np.int32)


def _shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Character pairs that each row of the one has in common with each of the other, or more."""
    often = np.minimum(left.max(axis=0), right.max(axis=0))
    a, b = [], []
    for k in range(1, min(REPEATS, int(often.max())) + 1):
        both = np.flatnonzero(often >= k)
        a.append((left[:, both] >= k).astype(np.float32))
        b.append((right[:, both] >= k).astype(np.float32))
    if not a:
        return np.zeros((len(left), len(right)), dtype=np.float32)
    rest = [np.maximum(c - REPEATS, 0).sum(axis=1).astype(np.float32) for c in (left, right)]
    return np.hstack(a) @ np.hstack(b).T + np.minimum(rest[0][:, None], rest[1][None, :])


def close_pairs(left: list[str], right: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in both lists, and edits, of the pairs with at most (1 - threshold) edits a character of the longer.

    Pairs with a text over ``LONG`` that may be so close come with ``UNDECIDED``.
    """
    if sum(map(len, left)) * len(right) < sum(map(len, right)) * len(left):
        # Where the patterns are the longer ones, pairs of unlike length end soonest.
        j, i, found = close_pairs(right, left, threshold)
        return i, j, found
    rows, lengths, letters = _padded([*left, *right])
    split = len(left)
    # By length, so that pairs side by side need the same diagonals.
    first, second = np.argsort(lengths[:split], kind="stable"), np.argsort(lengths[split:], kind="stable")
    counts = _counts(rows, lengths, letters)
    shared = _shared(counts[first], counts[split:][second])
    patterns, texts = rows[first, 1:], rows[split:][second, 1:]
    n, m = lengths[first], lengths[split:][second]
    edits_of = np.floor(np.arange(int(lengths.max()) + 1) * (1 - threshold) + 1e-9).astype(np.int64)
    longer = np.maximum(n[:, None], m)
    # An edit takes away two character pairs at most.
    near = (np.minimum(n[:, None], m) >= longer * threshold - 1e-9) & (shared >= longer + 1 - 2 * edits_of[longer])
    long = near & (longer > LONG)
    near &= ~long
    for k in np.flatnonzero(long.any(axis=1)):
        some = np.flatnonzero(long[k])
        exact = np.minimum(counts[first[k]], counts[split:][second[some]]).sum(axis=1)
        long[k, some] = exact >= longer[k, some] + 1 - 2 * edits_of[longer[k, some]]
    i, j = np.nonzero(long)
    done, open_ = [(i, j, np.full(len(i), UNDECIDED, dtype=np.int64))], []
    run = max(1, min(RUN, ENTRIES // (letters + 1)))
    across = SIDE_BY_SIDE // run
    for top in range(0, len(n), run):
        for begin in range(0, len(m), across):
            i, j = np.nonzero(near[top : top + run, begin : begin + across])
            if len(i):
                here = slice(top, top + run), slice(begin, begin + across)
                found, late = _distances(patterns[here[0]], n[here[0]], texts[here[1]], m[here[1]], letters, i, j, edits_of, FEW)
                done += [(a + top, b + begin, d) for a, b, d in found]
                open_.append((i[late] + top, j[late] + begin))
    if open_:
        i, j = (np.concatenate(side) for side in zip(*open_))
        for start in range(0, len(i), SIDE_BY_SIDE):
            a, b = i[start : start + SIDE_BY_SIDE], j[start : start + SIDE_BY_SIDE]
            own, slot = np.unique(a, return_inverse=True)
            found, _ = _distances(patterns[own], n[own], texts, m, letters, slot.ravel(), b, edits_of, 0)
            done += [(own[p], q, d) for p, q, d in found]
    i, j, found = (np.concatenate(side) for side in zip(*done))
    return first[i], second[j], found


def _distances(
    patterns: np.ndarray, n: np.ndarray, texts: np.ndarray, m: np.ndarray, letters: int,
    i: np.ndarray, j: np.ndarray, edits_of: np.ndarray, few: int,
) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """Pattern, text and edits of the given pairs that are within their limits, and the places of pairs put off.

    Pairs are put off when fewer than one in ``few`` are left (never if that is 0), so that the last ones do not take as many steps
    as all.  A step is a character of the texts.  In it a pair's bits are the rows around the diagonals that its
    edits can reach: bit b is row step + low + b, so they move down by one from step to step.  Edits along the
    diagonal that ends in the last cell never decrease and are never more than the pair's, so a pair ends when
    they are beyond its limit.
    """
    apart, limit = n[i] - m[j], edits_of[np.maximum(n[i], m[j])]
    spare = (limit - np.abs(apart)) // 2
    place = np.flatnonzero(spare >= 0)
    if not len(place):
        return [], place
    apart, limit, spare = apart[place], limit[place], spare[place]
    low = int((np.minimum(apart, 0) - spare).min())
    width = int((np.maximum(apart, 0) + spare).max()) - low + 1
    # In several words the last bit of each is left free for what is carried over.
    kind = np.uint32 if width <= 32 else np.uint64
    bits = 32 if width <= 32 else 64 if width <= 64 else 63
    words = -(-width // bits)
    one, top, whole = kind(1), kind(bits - 1), kind((1 << bits) - 1)
    size, reach = letters + 1, bits * words
    has = [np.zeros(len(n) * size, dtype=kind) for _ in range(words)]
    slots = np.arange(len(n)) * size
    for b in range(max(0, -low), min(reach, patterns.shape[1] - low)):
        has[b // bits][slots + patterns[:, low + b]] |= kind(1 << b % bits)
    steps = np.ascontiguousarray(texts.T)
    base, column, end = slots[i[place]], j[place], m[j[place]]
    # Edits that are left along the last diagonal, and those steps that needed none.
    slack = (limit - np.maximum(apart, 0)).astype(kind)
    goal = apart - low
    in_word = [(goal // bits == w).astype(kind) for w in range(words)]
    in_word = [None if not mask.any() else mask for mask in in_word]
    goal = (goal % bits).astype(kind)
    rising = [kind(sum(1 << b for b in range(bits) if w * bits + b >= -low)) for w in range(words)]
    up = [np.full(len(place), value, dtype=kind) for value in rising]
    down = [np.zeros(len(place), dtype=kind) for _ in range(words)]
    found, started, soonest = [], len(place), int(end.min())
    room = [np.empty(len(place), dtype=kind) for _ in range(3 * words + 1)]
    index = np.empty(len(place), dtype=np.int64)
    for step in range(1, int(end.max()) + 1):
        count = len(place)
        np.take(steps[step - 1], column, out=index[:count], mode="clip")
        index[:count] += base
        spread, same = room[-1][:count], [r[:count] for r in room[:words]]
        carried = None
        for w in range(words):
            equal, pv, mv, zero = room[words + w][:count], up[w], down[w], same[w]
            np.take(has[w], index[:count], out=equal, mode="clip")
            np.bitwise_and(equal, pv, out=zero)
            zero += pv
            if carried is not None:
                zero += carried
            if words > 1 and w < words - 1:
                carried = np.right_shift(zero, kind(63), out=room[2 * words + w][:count])
            zero ^= pv
            zero |= equal
            zero |= mv
            if words > 1:
                zero &= whole
            if in_word[w] is not None:
                np.right_shift(zero, goal, out=spread)
                spread &= in_word[w]
                slack += spread
        for w in range(words):
            pv, mv, zero, level = up[w], down[w], same[w], room[words + w][:count]
            # Cells that are not one more than those left of them; those that are one less.
            np.bitwise_or(zero, pv, out=level)
            level ^= mv
            pv &= zero
            np.right_shift(zero, one, out=spread)
            if w < words - 1:
                spread |= (same[w + 1] & one) << top
            np.bitwise_or(spread, level, out=mv)
            spread ^= mv
            pv |= spread
            mv ^= level
        # The row that comes in next, if the patterns have it.
        for w in range(words):
            has[w] >>= one
            if w < words - 1:
                has[w] |= (has[w + 1] & one) << top
        if 0 <= step + low + reach - 1 < patterns.shape[1]:
            has[-1][slots + patterns[:, step + low + reach - 1]] |= one << top
        ending = step >= soonest
        if not ending and step % 4:
            continue
        alive = slack >= kind(step)
        if ending:
            last = end == step
            within = np.flatnonzero(alive & last)
            if len(within):
                spent = step - slack[within].astype(np.int64) + limit[within]
                found.append((i[place[within]], j[place[within]], spent))
            alive &= ~last
        left = np.count_nonzero(alive)
        if few and left * few < started:
            return found, place[alive]
        if left < 0.85 * count or ending:
            if not left:
                break
            up, down = [u[alive] for u in up], [d[alive] for d in down]
            in_word = [None if mask is None else mask[alive] for mask in in_word]
            base, column, end, slack, goal = base[alive], column[alive], end[alive], slack[alive], goal[alive]
            limit, place = limit[alive], place[alive]
            soonest = int(end.min())
    return found, place[:0]
