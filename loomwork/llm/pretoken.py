"""Pre-tokenisation by scans over code-point classes, without regular expressions.

The boundaries are those of the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^sLN]+|s+(?!S)|s+

(L letters, N numbers, s white space).  Each code point becomes a symbol that
also knows its next neighbours; an automaton of eight states reads symbols and
says where a token starts.  Its transition functions compose associatively, so
a text is cut into equal chunks, each chunk's function is composed, the states
at the chunks' starts follow from these, and all chunks are then read at once.
"""

from __future__ import annotations

import unicodedata

import numpy as np

# symbols; +8 at the start of a text
L, N, O, S_MID, S_LAST_SPACE, S_LAST, A1, A2 = range(8)
RESET = 8
# states: 0 a token ended, 1 letters, 2 numbers, 3 others, 4 white space, 5 a space that joins what follows, 6 and 7 one or two letters of a contraction to come
STATES, SYMBOLS = 8, 16
CHUNK, TAIL = 256, 32
#: The code points with Unicode's White_Space property.
WHITE_SPACE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_LETTER, _NUMBER, _OTHER, _SPACE, _BLANK = range(5)  # _BLANK: U+0020
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Letter, number, other, white space or blank, by code point."""
    if not _classes:
        kind = np.array([{"L": _LETTER, "N": _NUMBER}.get(c[0], _OTHER) for c in map(unicodedata.category, map(chr, range(0x110000)))], np.uint8)
        kind[list(WHITE_SPACE)] = _SPACE
        kind[32] = _BLANK
        _classes.append(kind)
    return _classes[0]


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    to, starts = np.zeros((STATES, SYMBOLS), np.uint8), np.ones((STATES, SYMBOLS), bool)
    for s in range(STATES):
        to[s, [L, N, O, S_MID, S_LAST_SPACE, S_LAST]] = 1, 2, 3, 4, 5, 0
        to[s, [A1, A2]] = (3, 3) if s in (3, 5) else (6, 7)
        starts[s, L] = s not in (1, 5, 6, 7)
        starts[s, N] = s not in (2, 5)
        starts[s, [O, A1, A2]] = s not in (3, 5)
        starts[s, S_MID] = s != 4
    to[6, L], to[7, L] = 0, 6
    to[:, RESET:] = to[0, :RESET]
    return to.ravel(), starts.ravel()


TO, STARTS = _automaton()
TO_ROW = TO.astype(np.intp) * SYMBOLS  # the next state's row of the table


#: Symbol by class, then by class of white space that stands before something else.
_SYMBOL = np.array([L, N, O, S_MID, S_MID, L, N, O, S_LAST, S_LAST_SPACE], np.uint8)


def symbols(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The automaton's input. first: positions at which a text starts."""
    n = len(codes)
    kind = classes()[codes]
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    begins[n] = True
    solid = kind < _SPACE
    last = np.zeros(n, bool)
    np.greater(solid[1:], solid[:-1], out=last[:-1])
    last &= ~begins[1:]
    sym = _SYMBOL[kind + last.view(np.uint8) * np.uint8(5)]
    quotes = np.flatnonzero(codes == 39)
    if len(quotes):
        padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
        one = np.where(begins[quotes + 1], 0, padded[quotes + 1])
        two = np.where((one == 0) | begins[np.minimum(quotes + 2, n)], 0, padded[quotes + 2])
        sym[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = A1
        sym[quotes[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))]] = A2
    sym[first[first < n]] += RESET
    return sym


def _compose(part: np.ndarray) -> np.ndarray:
    """The transition function of each row of symbols, as rows of states."""
    f = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], len(part), 1)
    for col in np.ascontiguousarray(part.T):
        f = TO[f.astype(np.intp) * SYMBOLS + col]
    return f


def boundaries(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions at which a token starts, in ascending order."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    rows = -(-n // CHUNK)
    grid = np.full(rows * CHUNK, S_LAST, np.uint8)
    grid[:n] = symbols(codes, first)
    grid = grid.reshape(rows, CHUNK)
    # most symbols have constant functions: a chunk's tail mostly settles its function
    f = _compose(grid[:, -TAIL:])
    if len(open_ := np.flatnonzero((f != f[0]).any(0))):
        f[:, open_] = _compose(grid[open_])
    at, state = np.zeros(rows, np.uint8), 0
    moves = f.T.tolist()
    for r in range(rows):
        at[r] = state
        state = moves[r][state]
    marks = np.empty((CHUNK, rows), bool)
    where = at.astype(np.intp) * SYMBOLS
    for j, col in enumerate(np.ascontiguousarray(grid.T)):
        where += col
        np.take(STARTS, where, out=marks[j])
        where = TO_ROW[where]
    return np.flatnonzero(marks.T.ravel()[:n])


def pretokens(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The tokens of all texts, one text behind the other, and the index of each text's first token, with the count at the end."""
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=edges[1:])
    at = boundaries(codes, edges[:-1])
    cut = at.tolist()
    cut.append(len(joined))
    return [joined[a:b] for a, b in zip(cut, cut[1:])], np.searchsorted(at, edges)


def batches_of(texts: list[str], limit: int = 1 << 20):
    """Ranges of texts of about limit characters; a longer text stands alone."""
    i, n = 0, len(texts)
    while i < n:
        j, size = i, 0
        while j < n and (j == i or size + len(texts[j]) <= limit):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j
