"""Runs of windows that share their most significant digit, for use inside tasks."""

from __future__ import annotations

import numpy as np

GRAM = 32  # bytes of the first digit
PLACE_BITS = np.uint64(24)  # of a key; the other 40 bits are the hash
CHUNK = 1 << 18  # bytes looked at together; a few dozen times as many are in use meanwhile
DIGIT = 8  # bytes of the later digits
PART = 1 << 18  # suffixes sorted together
FACTOR = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def polynomial(data: np.ndarray, width: int) -> np.ndarray:
    """The hash of every ``width`` bytes: a polynomial modulo 2**64, by doubling."""
    n = len(data) - width + 1
    level, power, size = data.astype(np.uint64) + np.uint64(1), FACTOR, 1
    out, done = None, 0  # out: the hash of the first ``done`` bytes
    rest = width
    while True:
        if rest & 1:
            piece = level[done : done + n]
            out = piece.copy() if out is None else out * np.uint64(power) + piece
            done += size
        rest >>= 1
        if not rest:
            return out
        level = level[:-size] * np.uint64(power) + level[size:]
        power = power * power & MASK
        size *= 2


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    n, size = len(keys) - width + 1, 1
    while size * 2 <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    return np.minimum(keys[:n], keys[width - size : width - size + n])


def chunks(texts: list[bytes], window: int) -> list[list[tuple[int, int, bytes]]]:
    """The texts in groups of about ``CHUNK`` bytes, each piece with its text's number and place;
    longer texts are cut so that every window lies in one piece."""
    groups: list[list[tuple[int, int, bytes]]] = [[]]
    size = 0
    for number, text in enumerate(texts):
        for at in range(0, max(1, len(text) - window + 1), CHUNK):
            piece = text[at : at + CHUNK + window - 1]
            if len(piece) < window:
                continue
            if size and size + len(piece) > CHUNK:
                groups.append([])
                size = 0
            groups[-1].append((number, at, piece))
            size += len(piece)
    return [g for g in groups if g]


def runs(texts: list[bytes], window: int, gram: int = GRAM):
    """Yields arrays: text number, first window, number of windows, digit and, as a list, the
    bytes of each run of windows with the same digit.

    A window's digit is its least hash of ``gram`` bytes, at the first place that has it; windows
    of equal bytes have it at the same place. Windows in a row share the place until it leaves
    them or a lesser one comes in.
    """
    for group in chunks(texts, window):
        whole = b"".join(piece for _, _, piece in group)
        sizes = np.array([len(piece) for _, _, piece in group])
        begins = np.cumsum(sizes) - sizes
        grams = mix(polynomial(np.frombuffer(whole, np.uint8), gram))
        keys = grams >> PLACE_BITS << PLACE_BITS | np.arange(len(grams), dtype=np.uint64)
        least = sliding_least(keys, window - gram + 1)
        at = (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
        # windows that reach into the next piece are none
        owner = np.searchsorted(begins, np.arange(len(at)), side="right") - 1
        inside = np.arange(len(at)) + window <= (begins + sizes)[owner]
        same = np.zeros(len(at), bool)
        same[1:] = (at[1:] == at[:-1]) & inside[:-1] & inside[1:]
        first = np.flatnonzero(inside & ~same)
        ends = np.flatnonzero(inside & ~np.append(same[1:], False)) + 1
        count = ends - first
        own = owner[first]
        number = np.array([n for n, _, _ in group])[own]
        start = first - begins[own] + np.array([p for _, p, _ in group])[own]
        spans = [whole[a:b] for a, b in zip(first.tolist(), (ends + window - 1).tolist())]
        yield number, start, count, grams[at[first]], spans


def repeated(contents: list[bytes], groups: np.ndarray, window: int) -> list[np.ndarray]:
    """Per content, which of its windows also begin a suffix elsewhere in its group. ``groups``
    numbers the group of each content, ascending.

    The suffixes with ``window`` bytes or more left are sorted through that many bytes, the most
    significant digit of ``DIGIT`` bytes first. After each digit those that are alone are out; what
    still stands together after the last one agrees in all bytes.
    """
    lengths = np.array([len(c) for c in contents])
    sizes = lengths - window + 1
    before = np.cumsum(sizes) - sizes
    whole = b"".join(contents) + bytes(DIGIT)
    digits = np.ndarray((len(whole) - DIGIT + 1,), ">u8", whole, strides=(1,))  # one at every byte
    place = np.arange(sizes.sum()) + np.repeat(np.cumsum(lengths) - lengths - before, sizes)
    group = np.repeat(groups, sizes)
    found = np.zeros(len(place), bool)
    # equal windows have equal first digits, so large inputs are sorted in parts
    parts = -(-len(place) // PART)
    unused = np.uint64(8 * max(0, DIGIT - window))  # bits of the only digit of a shorter window
    share = mix(digits[place].astype(np.uint64) >> unused) % np.uint64(parts) if parts > 1 else None
    for part in range(parts):
        chosen = np.arange(len(place)) if share is None else np.flatnonzero(share == np.uint64(part))
        found[chosen[_not_alone(digits, place[chosen], group[chosen], window)]] = True
    return np.split(found, before[1:])


def _not_alone(digits: np.ndarray, place: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """The numbers of the suffixes (at ``place``, by ascending ``group``) that share ``window`` bytes."""
    unused = np.uint64(8 * max(0, DIGIT - window))  # bits of the only digit of a shorter window
    left = np.arange(len(place))
    opens = np.ones(len(place), bool)  # where a group begins
    opens[1:] = group[1:] != group[:-1]
    for depth in (*range(0, window - DIGIT, DIGIT), max(0, window - DIGIT)):
        digit = digits[place[left] + depth].astype(np.uint64) >> unused
        owner = np.cumsum(opens) - 1
        other = digit != digit[opens][owner]
        if other.any():
            mixed = np.zeros(owner[-1] + 1, bool)
            mixed[owner[other]] = True
            at = np.flatnonzero(mixed[owner])  # groups of one digit need no sorting
            turn = at[np.lexsort((digit[at], owner[at]))]
            left[at], digit[at] = left[turn], digit[turn]
            opens[1:] |= digit[1:] != digit[:-1]
        several = ~(opens & np.append(opens[1:], True))
        left, opens = left[several], opens[several]
        if not len(left):
            break
    return left


def stretches(found: np.ndarray) -> list[tuple[int, int]]:
    """The stretches (from, to) of true values."""
    edges = np.diff(np.concatenate([[0], found.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()))
