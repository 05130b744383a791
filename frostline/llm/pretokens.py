"""Pre-tokenisation without a regex: codepoint classes and a scan of transition functions.

The pattern splits text into contractions ('s 't 're 've 'm 'll 'd), runs of letters, of
numbers and of other characters, each with one leading space if there is one, and runs of
white space. That is a finite automaton over symbols that look at most two characters
ahead. The symbols of a whole batch are made by array operations; every block of symbols is
then reduced to the function it applies to the automaton's states, all blocks side by side;
composing those functions is associative, so a scan over the blocks gives each block's first
state, and one more pass over the blocks gives the places where a piece starts.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3  # classes of codepoints

# The codepoints with the property White_Space.
WHITE_SPACE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)

# Symbols: classes with what follows taken into account.
S_LETTER, S_NUMBER, S_OTHER = 0, 1, 2
S_JOINED = 3  # a space before something else: it leads the next piece
S_SINGLE = 4  # other white space before something else: a piece of its own
S_BLANK = 5  # white space before white space or at the end of a text
S_SHORT = 6  # an apostrophe before s, t, m, d
S_LONG = 7  # an apostrophe before re, ve, ll
S_BREAK = 8  # between two texts

# States: what the piece read so far is.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, IN_BLANKS, ONE_LEFT, TWO_LEFT = range(8)
STATES = 8


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and 'a piece starts here', by symbol * STATES + state."""
    begin = [IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, FRESH, IN_BLANKS, ONE_LEFT, TWO_LEFT, FRESH]
    step = np.repeat(np.array(begin, np.uint8)[:, None], STATES, axis=1)
    start = np.ones((9, STATES), bool)

    def stay(state, symbols, to):
        for symbol in symbols:
            step[symbol, state] = to
            start[symbol, state] = False

    others = (S_OTHER, S_SHORT, S_LONG)
    stay(IN_LETTERS, (S_LETTER,), IN_LETTERS)
    stay(IN_NUMBERS, (S_NUMBER,), IN_NUMBERS)
    stay(IN_OTHER, others, IN_OTHER)
    stay(AFTER_SPACE, (S_LETTER,), IN_LETTERS)
    stay(AFTER_SPACE, (S_NUMBER,), IN_NUMBERS)
    stay(AFTER_SPACE, others, IN_OTHER)
    stay(IN_BLANKS, (S_BLANK,), IN_BLANKS)
    stay(ONE_LEFT, range(8), FRESH)
    stay(TWO_LEFT, range(8), ONE_LEFT)
    return step.reshape(-1), start.reshape(-1)


STEP, START = _automaton()
BLOCK = 256


@functools.cache
def codepoint_classes() -> np.ndarray:
    """The class of every codepoint, from the Unicode general categories."""
    kinds = {"L": LETTER, "N": NUMBER}
    names = map(unicodedata.category, map(chr, range(0x110000)))
    table = np.fromiter((kinds.get(name[0], OTHER) for name in names), np.uint8, 0x110000)
    table[list(WHITE_SPACE)] = SPACE
    return table


def symbols(codes: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """One symbol per codepoint; ``breaks`` marks the separators between texts."""
    kind = codepoint_classes()[codes]
    n = len(codes)
    out = kind.copy()
    next_blank = np.ones(n, bool)  # white space, a separator or the end follows
    next_blank[:-1] = (kind[1:] == SPACE) | breaks[1:]
    blank = kind == SPACE
    out[blank] = S_BLANK
    leads = blank & ~next_blank
    out[leads] = S_SINGLE
    out[leads & (codes == 0x20)] = S_JOINED
    quotes = np.flatnonzero(codes == 0x27)
    if len(quotes):
        one = codes[np.minimum(quotes + 1, n - 1)]
        two = codes[np.minimum(quotes + 2, n - 1)]
        inside = quotes + 2 < n
        out[quotes[np.isin(one, [ord(c) for c in "stmd"]) & (quotes + 1 < n)]] = S_SHORT
        pairs = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        out[quotes[pairs & inside]] = S_LONG
    out[breaks] = S_BREAK
    return out


def scan(found: np.ndarray) -> np.ndarray:
    """Where pieces start, by composing the blocks' transition functions."""
    n = len(found)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, S_BREAK, np.uint16)
    padded[:n] = found
    padded *= STATES
    by_place = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    # each block as a function of its first state
    effect = np.tile(np.arange(STATES, dtype=np.uint8), (blocks, 1)).T.copy()
    for place in by_place:
        effect = STEP.take(effect + place)
    # exclusive scan over the blocks: pairs are composed at doubling distance
    total, distance = effect.T.copy(), 1
    while distance < blocks:
        total[distance:] = np.take_along_axis(total[distance:], total[:-distance], axis=1)
        distance *= 2
    state = np.full(blocks, FRESH, np.uint8)
    state[1:] = total[:-1, FRESH]
    starts = np.empty((BLOCK, blocks), bool)
    for place, row in enumerate(by_place):
        at = state + row
        starts[place] = START.take(at)
        state = STEP.take(at)
    return starts.T.reshape(-1)[:n]


class Pieces:
    """The pieces of a group of texts: where they lie, and which of them are equal.

    ``starts`` and ``ends`` are offsets in the texts' joined characters; text ``i`` has the
    pieces ``bounds[i]`` to ``bounds[i + 1]`` and begins at ``firsts[i]``.
    """

    def __init__(self, texts: list[str]):
        self.joined = "\x00".join(texts)
        self.codes = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(self.codes)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        text_ends = np.cumsum(lengths + 1) - 1
        self.firsts = text_ends - lengths
        breaks = np.zeros(n, bool)
        breaks[text_ends[:-1]] = True
        found = scan(symbols(self.codes, breaks)) if n else np.zeros(0, bool)
        cuts = np.flatnonzero(found)  # separators start something too, which ends the text's last piece
        real = ~breaks[cuts]
        self.starts = cuts[real]
        self.ends = np.append(cuts[1:], n)[real]
        self.bounds = np.searchsorted(self.starts, np.append(self.firsts, n))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(one piece of each kind, the kind of every piece).

        Kinds are found by a polynomial hash of all pieces at once and then compared
        character by character; should two kinds share a hash, every piece stays its own.
        """
        if not len(self.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        power, inverse = _powers(max(1 << 16, 1 << (len(self.codes) - 1).bit_length()))
        sums = np.zeros(len(self.codes) + 1, np.uint64)
        np.cumsum((self.codes + np.uint64(1)) * power[: len(self.codes)], out=sums[1:])
        lengths = self.ends - self.starts
        keys = (sums[self.ends] - sums[self.starts]) * inverse[self.starts]
        _, chosen, kind = np.unique(keys, return_index=True, return_inverse=True)
        shift = np.repeat(self.starts[chosen][kind] - self.starts, lengths)
        at = np.repeat(self.starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(shift))
        same = np.array_equal(lengths[chosen][kind], lengths) and np.array_equal(
            self.codes[at + shift], self.codes[at]
        )
        if not same:
            chosen = kind = np.arange(len(self.starts))
        return chosen, kind

    def strings(self, chosen: np.ndarray) -> list[str]:
        joined = self.joined
        return [joined[a:b] for a, b in zip(self.starts[chosen].tolist(), self.ends[chosen].tolist())]


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    out = []
    for b in (base, pow(base, -1, 2**64)):
        factors = np.full(n, b, np.uint64)
        factors[0] = 1
        out.append(np.cumprod(factors, dtype=np.uint64))
    return tuple(out)


def piece_offsets(texts: list[str]) -> list[np.ndarray]:
    """For each text the offsets (in characters) of its pieces, with the end at last."""
    found = Pieces(texts)
    out = []
    for i, text in enumerate(texts):
        own = found.starts[found.bounds[i] : found.bounds[i + 1]] - found.firsts[i]
        out.append(np.append(own, len(text)))
    return out
