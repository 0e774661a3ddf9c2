"""The radix sort of suffixes against plain comparison of bytes."""

import random
from collections import Counter

import numpy as np
import pytest

from trendloom.llm import suffixes


def plainly(contents, groups, window):
    windows = [[c[i : i + window] for i in range(len(c) - window + 1)] for c in contents]
    counts = Counter((g, w) for g, ws in zip(groups, windows) for w in ws)
    return [[counts[g, w] > 1 for w in ws] for g, ws in zip(groups, windows)]


def contents(letters, count, window, seed):
    dice = random.Random(seed)
    base = bytes(dice.choice(letters) for _ in range(3 * window))
    made = []
    for _ in range(count):
        at = dice.randrange(window)
        piece = bytearray(base[at : at + window + dice.randrange(window)])
        for _ in range(dice.randrange(3)):
            piece[dice.randrange(len(piece))] = dice.choice(letters)
        made.append(bytes(piece))
    return made


@pytest.mark.parametrize("window", [1, 5, 8, 12, 16, 37, 200])
@pytest.mark.parametrize("letters", [b"ab", b"\x00\x01\xff", bytes(range(256))])
@pytest.mark.parametrize("part", [50, 1 << 18])
def test_windows_are_found_by_their_bytes(window, letters, part, monkeypatch):
    monkeypatch.setattr(suffixes, "PART", part)
    given = contents(letters, 40, window, window)
    groups = np.array(sorted(random.Random(1).choice([3, 4, 9]) for _ in given))
    found = suffixes.repeated(given, groups, window)
    assert [f.tolist() for f in found] == plainly(given, groups.tolist(), window)


def test_one_window_and_groups_apart():
    same = bytes(range(200))
    assert [f.tolist() for f in suffixes.repeated([same], np.array([0]), 200)] == [[False]]
    assert [f.tolist() for f in suffixes.repeated([same, same], np.array([0, 1]), 200)] == [[False], [False]]
    assert [f.tolist() for f in suffixes.repeated([same, same], np.array([2, 2]), 200)] == [[True], [True]]
    # the last byte decides
    other = same[:-1] + b"x"
    assert [f.tolist() for f in suffixes.repeated([same, other], np.array([0, 0]), 200)] == [[False], [False]]
