"""Word boundaries of byte-level BPE, found without regular expressions.

Code points become classes by table look-up, runs of white space and
contractions are told apart by comparing neighbours, and a finite automaton
over the resulting symbols marks where a match begins. A symbol is a function
from states to states; functions compose associatively, so blocks of symbols
are composed side by side, the composed blocks are folded, and every block
then knows its first state.
"""

import unicodedata

import numpy as np

# The classes of code points.
LETTER, NUMBER, OTHER, SPACE = range(4)

# White_Space of Unicode (fixed values).
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Symbols. APOS1 and APOS2 are an apostrophe that one or two letters can complete to a contraction; the white
# space before a word is JOIN (a blank, taken into the word) or ALONE; INNER is other white space.
S_LETTER, S_NUMBER, S_OTHER, S_APOS1, S_APOS2, S_JOIN, S_ALONE, S_INNER = range(8)
# States: what the last code point left behind.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINED, LEFT1, LEFT2, IN_SPACE = range(8)

BLOCK = 64


def class_table() -> np.ndarray:
    """Class of every code point; none has letters or numbers from U+E01F0 on."""
    table = np.full(0x110000, OTHER, np.uint8)
    for first, stop in ((0, 0x33480), (0xE0000, 0xE01F0)):
        kinds = [unicodedata.category(chr(c))[0] for c in range(first, stop)]
        kinds = np.array(kinds)
        table[first:stop][kinds == "L"] = LETTER
        table[first:stop][kinds == "N"] = NUMBER
    table[WHITE] = SPACE
    return table


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a match begins, for (symbol, state); symbols + 8 are first in their text."""
    step = np.zeros((16, 8), np.uint8)
    begins = np.ones((16, 8), bool)
    runs = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHERS}
    for symbol in range(8):
        for state in range(8):
            if symbol == S_LETTER and state in (LEFT1, LEFT2):
                to, goes_on = (FRESH if state == LEFT1 else LEFT1), True
            elif symbol in (S_APOS1, S_APOS2):
                goes_on = state in (IN_OTHERS, JOINED)
                to = IN_OTHERS if goes_on else (LEFT1 if symbol == S_APOS1 else LEFT2)
            elif symbol in runs:
                to = runs[symbol]
                goes_on = state in (to, JOINED)
            else:
                to = {S_JOIN: JOINED, S_ALONE: FRESH, S_INNER: IN_SPACE}[symbol]
                goes_on = symbol == S_INNER and state == IN_SPACE
            step[symbol, state], begins[symbol, state] = to, not goes_on
    step[8:], begins[8:] = step[:8, FRESH][:, None], True
    return step, begins


def symbols(codes: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The symbol of every code point. ``first`` marks those that begin a text."""
    kind = table[codes]
    out = kind.copy()
    n = len(codes)
    ends = np.ones(n, bool)
    ends[:-1] = first[1:]
    space = kind == SPACE
    before_word = np.zeros(n, bool)
    before_word[:-1] = ~space[1:]
    before_word &= space & ~ends
    out[space] = S_INNER
    out[before_word] = S_ALONE
    out[before_word & (codes == 32)] = S_JOIN
    apos = np.nonzero(codes == ord("'"))[0]
    if len(apos):
        def at(k):
            inside = apos + k < n
            i = np.minimum(apos + k, n - 1)
            inside &= ~first[i]
            return np.where(inside, codes[i], 0)
        one = at(1)
        two = np.where(one > 0, at(2), 0)
        out[apos[np.isin(one, [ord(c) for c in "stmd"])]] = S_APOS1
        for a, b in ("re", "ve", "ll"):
            out[apos[(one == ord(a)) & (two == ord(b))]] = S_APOS2
    return out + np.where(first, np.uint8(8), np.uint8(0))


def fours(step: np.ndarray) -> np.ndarray:
    """The functions of all sequences of four symbols, one after another in a flat table."""
    two = step[None, :, :].repeat(16, 0)
    two = np.take_along_axis(two, step[:, None, :].repeat(16, 1), 2).reshape(256, 8)
    four = np.take_along_axis(np.broadcast_to(two[None], (256, 256, 8)), np.broadcast_to(two[:, None], (256, 256, 8)), 2)
    return np.ascontiguousarray(four).ravel()


def scan(symbol: np.ndarray, step: np.ndarray, four: np.ndarray) -> np.ndarray:
    """The state before every symbol, by composing the functions of blocks."""
    n = len(symbol)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, S_INNER, np.uint8)
    padded[:n] = symbol
    padded = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    base = padded.astype(np.int32) << 3
    quads = (base[0::4] << 12) + (base[1::4] << 8) + (base[2::4] << 4) + base[3::4]
    whole = four[quads[0][:, None] + np.arange(8)]
    for row in quads[1:]:
        whole = four[row[:, None] + whole]
    # Prefix composition of the blocks, by doubling.
    prefix, width = whole, 1
    while width < blocks:
        after = prefix.copy()
        after[width:] = np.take_along_axis(prefix[width:], prefix[:-width], 1)
        prefix, width = after, width * 2
    state = np.empty(blocks, np.uint8)
    state[0], state[1:] = FRESH, prefix[:-1, FRESH]
    before = np.empty((BLOCK, blocks), np.uint8)
    flat = step.ravel()
    for i, row in enumerate(base):
        before[i] = state
        state = flat[row + state]
    return before.T.ravel()[:n]


class Splitter:
    """Cuts texts into the pieces that are merged separately."""

    def __init__(self):
        self.table = class_table()
        self.step, self.begins = automaton()
        self.four = fours(self.step)

    def pieces(self, data: bytes, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets of the pieces (with the end), and which piece each text begins with (with the end).

        ``texts`` are the byte offsets of the texts in ``data``, with the end.
        """
        codes = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        if not len(codes):
            return np.zeros(1, np.int64), np.zeros(len(texts), np.int64)
        width = 1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF)
        begin = np.cumsum(width, dtype=np.int64) - width
        first = np.zeros(len(codes), bool)
        first[np.searchsorted(begin, texts[:-1][np.diff(texts) > 0])] = True
        symbol = symbols(codes, first, self.table)
        marks = self.begins[symbol, scan(symbol, self.step, self.four)]
        offsets = np.append(begin[marks], len(data))
        return offsets, np.searchsorted(offsets, texts)
