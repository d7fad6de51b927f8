"""Levenshtein automata walked over tries: all words of a vocabulary within some edits of a word.

The automaton of a word is its set of states, kept as bits: bit i of row k tells that i letters of the word
are read with k edits. A letter moves all states of a row at once; exchanged neighbours count as one edit.
A branch of the trie is left as soon as no state remains, so what lies within the bound comes out complete.
"""

from __future__ import annotations

from collections.abc import Iterable

END = ""


def build_trie(words: Iterable[str]) -> dict:
    """Nested dictionaries by letter; the word itself stands under END."""
    root: dict = {}
    for word in words:
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[END] = word
    return root


def search(root: dict, word: str, most: int = 1) -> list[tuple[str, int]]:
    """(word of the trie, edits) of all within most edits of word."""
    n = len(word)
    whole, accept = (2 << n) - 1, 1 << n
    masks: dict[str, int] = {}
    for i, c in enumerate(word):
        masks[c] = masks.get(c, 0) | 1 << i
    out: list[tuple[str, int]] = []
    rows = tuple((2 << k) - 1 & whole for k in range(most + 1))
    stack = [(root, rows, (0,) * most)]
    while stack:
        node, rows, crossed = stack.pop()
        if not any(rows[:-1]) and not any(crossed):
            # No edit is left: what remains of the word must follow.
            row, at = rows[-1], 0
            while row:
                step = (row & -row).bit_length()
                at, row = at + step, row >> step
                below = node
                for c in word[at - 1 :]:
                    below = below.get(c)
                    if below is None:
                        break
                else:
                    if END in below:
                        out.append((below[END], most))
            continue
        for c, below in node.items():
            if c == END:
                for k, row in enumerate(rows):
                    if row & accept:
                        out.append((below, k))
                        break
                continue
            m = masks.get(c, 0)
            last = rows[0]
            new = last & m
            new <<= 1
            moved, over, live = [new], [], new
            for k in range(most):
                # One edit more: the letter is added, it stands for another, or the word's next one is left out.
                over.append(last & m >> 1)
                row = rows[k + 1]
                new = ((row & m) << 1 | last | last << 1 | new << 1 | (crossed[k] & m) << 2) & whole
                moved.append(new)
                live |= new
                last = row
            if live or any(over):
                stack.append((below, tuple(moved), tuple(over)))
    return out
