"""A run-length grammar of a sequence by recompression, and the common extensions it answers.

Levels alternate: blocks of one symbol become a symbol each, then pairs whose first symbol is on the
left side and whose second is on the right side do, sides being drawn per symbol. What follows a common
symbol border is cut in the same way wherever it stands, so two equal stretches share almost all
symbols: a longest common extension climbs the levels while both places are borders, walks equal
symbols at the top and comes down again, a few steps a level. Many extensions are taken at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SIDES = 4  # drawings of the sides, of which the one with the most pairs is taken
SMALL = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Level:
    """Symbols of one level; how many equal ones begin or end at a border; the borders that stay in the next level."""

    symbols: np.ndarray
    ahead: np.ndarray | None
    behind: np.ndarray | None
    stays: np.ndarray | None = None
    above: np.ndarray | None = None  # border of this level to border of the next one
    below: np.ndarray | None = None  # border of the next level to border of this one


class Grammar:
    """Over numbers in which the first and the last stand nowhere else."""

    def __init__(self, sequence: np.ndarray):
        self.levels: list[Level] = []
        symbols = np.asarray(sequence, np.int64)
        fresh = int(symbols.max()) + 1 if len(symbols) else 0
        turn = 0
        while len(symbols) > SMALL:
            borders, firsts = self._blocks(symbols)
            if len(borders) - 1 < len(symbols):
                lengths = np.diff(borders)
                level = Level(symbols, np.repeat(borders[1:], lengths) - np.arange(len(symbols)), None)
                level.behind = np.append(0, np.arange(1, len(symbols) + 1) - np.repeat(borders[:-1], lengths))
                self._close(level, borders)
                symbols, fresh = self._named(firsts, lengths, lengths > 1, fresh)
            starts, pairs = self._pairs(symbols, turn)
            turn += 1
            if not len(pairs):
                break
            level = Level(symbols, None, None)
            borders = np.flatnonzero(starts)
            self._close(level, borders)
            second = symbols[np.minimum(borders[:-1] + 1, len(symbols) - 1)]
            symbols, fresh = self._named(symbols[borders[:-1]], second, np.diff(borders) > 1, fresh)
        self.levels.append(Level(symbols, None, None))

    def _close(self, level: Level, borders: np.ndarray) -> None:
        level.stays = np.zeros(len(level.symbols) + 1, bool)
        level.stays[borders] = True
        level.above = np.cumsum(level.stays) - 1
        level.below = borders
        self.levels.append(level)

    @staticmethod
    def _blocks(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        borders = np.append(np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1])), len(symbols))
        return borders, symbols[borders[:-1]]

    @staticmethod
    def _pairs(symbols: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        best: np.ndarray | None = None
        for draw in range(SIDES):
            salt = np.uint64((turn * SIDES + draw + 1) * 0xD6E8FEB86659FD93 % (1 << 64))
            x = (symbols.astype(np.uint64) + salt) * _ODD
            side = ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(63)
            found = np.flatnonzero((side[:-1] == 0) & (side[1:] == 1))
            if best is None or len(found) > len(best):
                best = found
        starts = np.ones(len(symbols) + 1, bool)
        starts[best + 1] = False
        return starts, best

    @staticmethod
    def _named(first: np.ndarray, second: np.ndarray, joined: np.ndarray, fresh: int) -> tuple[np.ndarray, int]:
        """New names for joined symbols, equal for equal ones; the others keep theirs."""
        at = np.flatnonzero(joined)
        both = np.stack([first[at], second[at]])
        wide = max(int(both[1].max()) + 1, 1) if len(at) else 1
        names, place = np.unique(both[0] * wide + both[1], return_inverse=True)
        out = first.copy()
        out[at] = fresh + place
        return out, fresh + len(names)

    def common_ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch that begins at both places."""
        return self._extend(i, j, 1)

    def common_behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch that ends before both places."""
        return self._extend(i, j, -1)

    def _extend(self, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
        a, b = np.array(i, np.int64), np.array(j, np.int64)
        stopped = np.full(len(a), len(self.levels) - 1)
        climbing = np.arange(len(a))
        for number, level in enumerate(self.levels[:-1]):
            active = climbing
            while len(active):  # walk to borders that stay, or to a difference
                active = active[~(level.stays[a[active]] & level.stays[b[active]])]
                moved = self._step(level, a, b, active, way)
                stopped[active[~moved]] = number
                active = active[moved]
            climbing = climbing[stopped[climbing] > number]
            a[climbing], b[climbing] = level.above[a[climbing]], level.above[b[climbing]]
        for number in range(len(self.levels) - 1, -1, -1):
            level = self.levels[number]
            here = np.flatnonzero(stopped >= number)
            if number < len(self.levels) - 1:
                down = here[stopped[here] > number]
                a[down], b[down] = level.below[a[down]], level.below[b[down]]
            while len(here):
                here = here[self._step(level, a, b, here, way)]
        return (a - i) * way

    @staticmethod
    def _step(level: Level, a: np.ndarray, b: np.ndarray, active: np.ndarray, way: int) -> np.ndarray:
        """Move both places over an equal symbol, or over as many equal ones as both have; which ones could."""
        x, y = a[active], b[active]
        # the outermost numbers are unique, so the places never both leave the sequence
        last = len(level.symbols) - 1
        p, q = (x, y) if way > 0 else (x - 1, y - 1)
        inside = (p >= 0) & (q >= 0) & (p <= last) & (q <= last)
        moved = inside & (level.symbols[np.clip(p, 0, last)] == level.symbols[np.clip(q, 0, last)])
        x, y = x[moved], y[moved]
        if level.ahead is None:
            far = 1
        elif way > 0:
            far = np.minimum(level.ahead[x], level.ahead[y])
        else:
            far = np.minimum(level.behind[x], level.behind[y])
        a[active[moved]] += way * far
        b[active[moved]] += way * far
        return moved
