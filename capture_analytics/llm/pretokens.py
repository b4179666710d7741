"""Pre-tokens of many texts at once, as the pattern of byte-level BPE vocabularies splits them.

The pattern only asks whether a character is a letter, a number, white space or something else,
so a table of these classes and comparisons of neighbours give all boundaries with numpy. Where
Unicode versions disagree about a character's class, the text is not split here but left whole:
the encoders split it themselves.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import regex

OTHER, LETTER, NUMBER, SPACE, UNSURE = range(5)
QUOTE, BLANK = 0x27, 0x20
# A code point that no text should hold.
MARK = 0xFFFF


class Classes:
    """The class of every code point, made once per process."""

    def __init__(self):
        self.table = None

    def __getstate__(self):
        return {"table": None}

    def of(self, codes: np.ndarray) -> np.ndarray:
        if self.table is None:
            points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
            text = "".join(map(chr, points))
            table = np.zeros(0x110000, np.uint8)
            for value, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
                table[[ord(c) for c in regex.findall(pattern, text)]] = value
            kinds = {"L": LETTER, "N": NUMBER}
            other = np.array([kinds.get(unicodedata.category(c)[0], OTHER) for c in text], np.uint8)
            known = table[points]
            sure = (known == other) | (known == SPACE)
            table[points] = np.where(sure, known, UNSURE)
            self.table = table
        return self.table[codes]


CLASSES = Classes()


def pretokens(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """All pre-tokens in order, and the number of the first one of each text, with the total."""
    return split_texts(texts)[:2]


def split_texts(texts: list[str | None]) -> tuple[list[str], np.ndarray, list[int]]:
    """`pretokens`, and the numbers of the texts that are left whole."""
    texts = [t or "" for t in texts]
    joined = "".join(texts)
    begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    if not joined:
        return [], np.zeros(len(texts) + 1, np.int64), []
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = CLASSES.of(codes)
    n = len(codes)
    head = np.zeros(n + 1, bool)
    head[begins] = True
    start = head[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last blank before something else leads its pre-token, another space stands alone
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~head[1:n])
    start[last] = True
    start[last + 1] = codes[last] != BLANK
    # 's 't 'm 'd and 're 've 'll, unless the quote continues a pre-token
    quote = np.flatnonzero((codes == QUOTE) & start)
    if len(quote):
        ends = begins[np.searchsorted(begins, quote, side="right")]
        padded = np.concatenate([codes, [0, 0]])
        one, two = padded[quote + 1], padded[quote + 2]
        length = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
        for a, b in ("re", "ve", "ll"):
            length[(one == ord(a)) & (two == ord(b))] = 3
        fits = (length > 0) & (quote + length <= ends)
        quote, length = quote[fits], length[fits]
        start[quote + 1] = False
        inside = quote[length == 3] + 2
        start[inside] = False
        after = quote + length
        start[after[after < n]] = True
    whole = []
    if (kind == UNSURE).any():
        whole = np.unique(np.searchsorted(begins, np.flatnonzero(kind == UNSURE), "right") - 1).tolist()
        for i in whole:
            start[begins[i] + 1:begins[i + 1]] = False
    return cut(joined, codes, start), np.searchsorted(np.flatnonzero(start), begins), whole


def cut(joined: str, codes: np.ndarray, start: np.ndarray) -> list[str]:
    """The parts of a text that begin where `start` says. Splitting at a mark put between them is
    much faster than slicing; a text that holds the mark itself is sliced."""
    if (codes == MARK).any():
        places = np.flatnonzero(start).tolist()
        return [joined[a:b] for a, b in zip(places, [*places[1:], len(joined)])]
    number = np.cumsum(start)
    marked = np.full(len(codes) + int(number[-1]) - 1, MARK, np.uint32)
    marked[np.arange(len(codes)) + number - 1] = codes
    return marked.tobytes().decode("utf-32-le").split(chr(MARK))
