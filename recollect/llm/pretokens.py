"""Pre-tokens of byte-level tokenizers, found by vector operations on whole batches.

The pattern is the one of the public rank files (``public_tokenizers.PATTERN``):
contractions, letters, numbers and other characters with one blank before them, and
white space.  ``pretokens`` gives the same spans as its matches; the tests compare both.
"""

from __future__ import annotations

import base64
import sys
import unicodedata

import numpy as np

from recollect.llm.textbatch import characters, documents_of

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Unicode's White_Space property (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters after an apostrophe that make a pre-token of their own (fixed values).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

_classes: list[np.ndarray] = []


def character_classes() -> np.ndarray:
    """The class of every code point."""
    if not _classes:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        table[WHITE_SPACE] = SPACE
        _classes.append(table)
    return _classes[0]


def pretokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start, byte end and document of every pre-token, in order."""
    if not len(buf):
        return (np.zeros(0, np.int64),) * 3
    cp, at = characters(buf)
    border = np.zeros(len(cp), bool)
    inner = offs[offs < len(buf)]
    border[np.searchsorted(at, inner)] = True
    kind = character_classes()[cp]
    change = border.copy()
    change[0] = True
    change[1:] |= kind[1:] != kind[:-1]
    start = np.flatnonzero(change)
    end = np.append(start[1:], len(cp))
    of = kind[start]
    followed = np.append(~border[start[1:]], False)  # another run of the same document comes next

    # the last blank before something else goes with it; another white space there stands alone
    white = np.flatnonzero((of == SPACE) & followed)
    blank = cp[end[white] - 1] == 0x20
    joined = white[blank]
    end[joined] -= 1
    start[joined + 1] -= 1
    alone = white[~blank]
    alone = alone[end[alone] - start[alone] > 1]
    end[alone] -= 1
    more = [end[alone]], [end[alone] + 1]

    # contractions: an apostrophe without a blank before it takes letters from the next run
    mark = np.flatnonzero((of == OTHER) & followed & (end - start == 1))
    mark = mark[cp[start[mark]] == 0x27]
    mark = mark[of[mark + 1] == LETTER]
    for letters in CONTRACTIONS:
        codes = [ord(c) for c in letters]
        fits = end[mark + 1] - start[mark + 1] >= len(codes)
        for j, c in enumerate(codes):
            fits &= cp[np.minimum(start[mark + 1] + j, len(cp) - 1)] == c
        taken = mark[fits]
        end[taken] += len(codes)
        start[taken + 1] += len(codes)
        mark = mark[~fits]

    start = np.concatenate([start, *more[0]])
    end = np.concatenate([end, *more[1]])
    keep = end > start
    start, end = start[keep], end[keep]
    order = np.argsort(start, kind="stable")
    first = at[start[order]]
    return first, at[end[order]], documents_of(offs, first)


def read_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken rank file: bytes in base64 and their rank, by line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
