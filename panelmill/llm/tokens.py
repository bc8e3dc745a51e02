"""Token ids by the tokenizers library, with one library call for each new piece of text.

Byte-pair encoders treat the text between two cuts independently when no match of their
pre-tokenizer crosses the cut. Both vocabularies used here have that property at a single space
between two non-space characters, so the ids of a text are the ids of its pieces in order. Pieces
repeat, so each Python worker remembers the ids that the library returned for a piece. New pieces
are cut once more where the pre-tokenizer always cuts, so that a word with another mark behind it or
in other case needs no new call.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

#: White space other than space and newline, in Python's or the pre-tokenizers' sense.
_ODD = [*range(0x09, 0x0A), *range(0x0B, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
ODD_SPACE = re.compile("[" + "".join(map(chr, _ODD)) + "]")
#: Pieces beyond this length are encoded but not remembered.
LONGEST_REMEMBERED = 64
#: Marks that may close a word, and characters outside of which lower case is the same for every library.
CLOSING = ".,;:!?%&$*#|)]}\"'-"
BEYOND_LATIN = re.compile("[^\x00-\u012f\u0131-\u024f]")
#: Either of the two.
ODD_OR_BEYOND = re.compile("[" + "".join(map(chr, _ODD)) + "\u0130\u0250-\U0010ffff]")
#: How byte-level vocabularies write the bytes that are not printable: as characters from 256 on, in order.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_FORM = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_ENCODERS: dict[tuple, PieceEncoder] = {}


class PieceEncoder:
    """Encodes texts to bytes of little-endian unsigned ids.

    keeps_space: the pre-tokenizer attaches a space to the word behind it, so pieces are encoded
    with that space; otherwise white space only separates and is dropped.
    """

    def __init__(self, path: str, keeps_space: bool, remembered: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")
        self.typecode = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.keeps_space, self.remembered = keeps_space, remembered
        self.known: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.mark, self.mark_id = special[-1] if special else ("", -1)
        #: How control strings open; a text with one goes to the library whole, which gives the string its own id.
        self.opening = {t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()}

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, dtype=self.dtype).tobytes()

    def _library(self, pieces: list[str], lead: str) -> dict[str, bytes]:
        """Ids of pieces from the library. A special token between them, which plain pieces never yield, marks the cuts."""
        out, other, tokenize = {}, [], self.tokenizer.model.tokenize
        mark = "\u0120" if lead else ""
        for p in pieces:
            # Latin letters are one pre-token and need no normalizing, so the model can be asked directly.
            if p.isalpha() and (p.isascii() or not BEYOND_LATIN.search(p)):
                form = mark + (p if p.isascii() else p.encode().decode("latin-1").translate(BYTE_FORM))
                out[p] = array(self.typecode, [t.id for t in tokenize(form)]).tobytes()
            else:
                other.append(p)
        plain = other if self.mark else []
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            text = self.mark.join([lead + p for p in part])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
            cuts = np.flatnonzero(ids == self.mark_id)
            if len(cuts) != len(part) - 1:
                raise ValueError("the special token does not mark the cuts")
            packed, width = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
            begin = np.concatenate(([0], cuts + 1)) * width
            end = np.concatenate((cuts, [len(ids)])) * width
            out.update((p, packed[b:e]) for p, b, e in zip(part, begin.tolist(), end.tolist(), strict=True))
        for p in pieces:
            if p not in out:
                out[p] = self.whole(lead + p)
        return out

    def _atoms(self, line: str, begins: bool) -> tuple:
        """A new line of a piece as one or two parts that the pre-tokenizer never joins: (begins the piece, part).

        The cut lies between a Latin letter and closing marks other than an apostrophe. Where case is
        dropped anyway, Latin text is lower-cased.
        """
        if not self.keeps_space and (line.isascii() or not BEYOND_LATIN.search(line)):
            line = line.lower()
        base = line.rstrip(CLOSING)
        if base and len(base) < len(line) and line[len(base)] != "'" and base[-1].isalpha() and not BEYOND_LATIN.match(base[-1]):
            return (begins, base), (False, line[len(base) :])
        return ((begins, line),)

    def _learn(self, pieces: set[str], openings: set[str]) -> None:
        """Remember the ids of new pieces, and of new pieces that open a text. A newline between two other characters is a part of its own."""
        known, inner, plans, first, later = self.known, self.inner, {}, set(), openings
        for p in pieces:
            if p.isalpha() and (self.keeps_space or p.islower()):
                first.add(p)
                continue
            if "\n" in p and p.count("\n") == 1 and p[0] != "\n" and p[-1] != "\n":
                head, tail = p.split("\n")
                plan = (*self._atoms(head, True), (False, "\n"), *self._atoms(tail, False))
            else:
                plan = self._atoms(p, True)
                if len(plan) == 1 and plan[0][1] == p:
                    first.add(p)
                    continue
            plans[p] = plan
            for begins, atom in plan:
                if begins:
                    if atom not in known:
                        first.add(atom)
                elif atom not in inner:
                    later.add(atom)
        known.update(self._library(list(first), " " if self.keeps_space else ""))
        inner.update(self._library(list(later), ""))
        for p, plan in plans.items():
            known[p] = b"".join([known[a] if b else inner[a] for b, a in plan])

    def _cut(self, text: str) -> list[str] | None:
        """Pieces of a text (behind its first piece, if spaces are kept), or None if only the whole is safe."""
        if any(o in text for o in self.opening):
            return None
        if not self.keeps_space and not ODD_OR_BEYOND.search(text):
            return text.lower().split()
        if ODD_SPACE.search(text):
            return None
        if not self.keeps_space:
            return text.split()
        if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " ":
            return None
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.remembered:
            self.known.clear()
        if len(self.inner) > self.remembered:
            self.inner.clear()
        cuts = [self._cut(t) for t in texts]
        bodies, openings = cuts, []
        if self.keeps_space:
            bodies, openings = [c[1:] if c else c for c in cuts], [c[0] for c in cuts if c]
        new = set().union(*filter(None, bodies)).difference(self.known)
        opening = set(openings).difference(self.inner)
        if new or opening:
            self._learn(new, opening)
        known, out = self.known.__getitem__, []
        for text, cut, body in zip(texts, cuts, bodies, strict=True):
            if cut is None:
                out.append(self.whole(text) if text else b"")
            elif self.keeps_space and cut:
                out.append(self.inner[cut[0]] + b"".join(map(known, body)))
            else:
                out.append(b"".join(map(known, body)))
        for memory, pieces in ((self.known, new), (self.inner, opening)):
            for p in pieces:
                if len(p) > LONGEST_REMEMBERED:
                    memory.pop(p, None)
        return out


def encoder(path: str, keeps_space: bool) -> PieceEncoder:
    """The encoder of this Python process; it lives as long as the worker does."""
    key = (path, keeps_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, keeps_space)
    return _ENCODERS[key]
