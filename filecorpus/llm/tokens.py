"""Texts to token ids with a public tokenizer file, each distinct word encoded once.

No token of these vocabularies runs from a word into the white space after it, so a text is
encoded piece by piece: a piece is a word, or, where a token may hold the space before a
word, a word with the white space before it. Ids of pieces are kept in a dictionary of
bounded size. Of a new piece of Latin letters and then punctuation, both parts are tokens of
their own; the letters go to the tokenizer's model directly, once for all endings. Other new pieces are encoded many at a time, with a
control character between them whose token tells where each ends. Texts for which this does
not hold (other white space than blanks and newlines, the control character itself), texts
with the string of one of the vocabulary's special tokens, which the library makes that token,
and texts with very long pieces are encoded whole.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Sequence

import numpy as np

PIECES_KEPT = 400_000
LONG_PIECE = 200
MARK = "\x01"
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
PUNCTUATION = r"!-/:-@\[-`{-~"


def _byte_characters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable ones as they are, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """``ids(texts)`` gives each text's ids as little-endian bytes of ``dtype``.

    Broadcast one, and every Python worker keeps it, with the pieces it has met, from task
    to task; what is sent is the path.
    """

    def __init__(self, path: str, *, spaces_in_tokens: bool, kept: int = PIECES_KEPT) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._made_of = (path, spaces_in_tokens, kept)
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        wide = self._tokenizer.get_vocab_size() > 1 << 16
        self.dtype, self._format = np.dtype("<u4" if wide else "<u2"), "I" if wide else "H"
        self._spaces = spaces_in_tokens
        self._lower = "Lowercase" in str(self._tokenizer.normalizer)
        self._piece = re.compile(r"[ \n]+[^ \n]*|[^ \n]+" if spaces_in_tokens else r"[^ \n]+")
        special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        odd = [MARK, *map(re.escape, special), *([r"[^\S \n]"] if spaces_in_tokens else [])]
        # Written in any case, as a normaliser may come before the token.
        self._whole = re.compile("|".join(odd), re.IGNORECASE)
        # A newline before a word is a token of its own.
        before, blank = (r"\n?", " ?") if spaces_in_tokens else ("", "")
        self._latin = re.compile(rf"({before})({blank}[{LATIN}]+)([{PUNCTUATION}]*)").fullmatch
        self._bytes = _byte_characters()
        # A mark after white space is a token of its own, and so is that white space.
        self._join = "\n" + MARK if spaces_in_tokens else f" {MARK} "
        self._joined = self._plain([self._join])[0]
        self._newline = self._plain(["\n"])[0].tobytes()
        self._kept, self._known = kept, {}

    def __reduce__(self):
        return _made, self._made_of

    def _plain(self, texts: Sequence[str]) -> list[np.ndarray]:
        encoded = self._tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)
        return [np.array(e.ids, self.dtype) for e in encoded]

    def _letters(self, word: str) -> bytes:
        """Ids of Latin letters, by the tokenizer's model."""
        if word.isascii():
            written = "Ġ" + word[1:] if word[0] == " " else word
        else:
            written = word.encode().decode("latin-1").translate(self._bytes)
        ids = [t.id for t in self._model.tokenize(written)]
        return struct.pack(f"<{len(ids)}{self._format}", *ids)

    def _learn(self, pieces: set[str]) -> tuple[dict[str, bytes], list[str]]:
        """The ids of each piece, and the pieces that are not of Latin letters."""
        found, others, known = {}, [], self._known
        for piece in pieces:
            parts = self._latin(piece)
            if parts is None:
                others.append(piece)
                continue
            before, word, end = parts.groups()
            if self._lower:
                word = word.lower()
            ids = known.get(word) or found.get(word)
            if ids is None:
                ids = found[word] = self._letters(word)
            if end:
                after = known.get(end) or found.get(end)
                if after is None:
                    after = found[end] = self._plain([end])[0].tobytes()
                ids += after
            found[piece] = self._newline + ids if before else ids
        return found, others

    def _learn_others(self, pieces: list[str], found: dict[str, bytes]) -> None:
        alone, together = [], pieces
        if self._spaces:
            # Without white space before, or with white space at the end, a mark would change them.
            alone = [p for p in pieces if p[0] not in " \n" or p[-1] in " \n"]
            together = [p for p in pieces if p[0] in " \n" and p[-1] not in " \n"]
        found.update((p, i.tobytes()) for p, i in zip(alone, self._plain(alone), strict=True))
        runs = [together[i : i + 1000] for i in range(0, len(together), 1000)]
        width = len(self._joined)
        for run, ids in zip(runs, self._plain([self._join.join(r) for r in runs]), strict=True):
            ends = np.flatnonzero(ids == self._joined[-1]) + 1
            size, raw = ids.itemsize, ids.tobytes()
            firsts = [0, *(ends * size).tolist()]
            lasts = [*((ends - width) * size).tolist(), len(raw)]
            found.update(zip(run, [raw[a:b] for a, b in zip(firsts, lasts, strict=True)], strict=True))

    def ids(self, texts: Sequence[str | None]) -> list[bytes]:
        """Each text's ids; a null text has none."""
        split = [self._piece.findall(t) if t else [] for t in texts]
        known = self._known
        learned, others = self._learn(set().union(*split).difference(known))
        odd = {p for p in others if len(p) > LONG_PIECE or self._whole.search(p)}
        whole = [i for i, pieces in enumerate(split) if not odd.isdisjoint(pieces)] if odd else []
        for i in whole:
            split[i] = []
        self._learn_others([p for p in others if p not in odd], learned)
        room = len(known) + len(learned) <= self._kept
        known.update(learned)
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in split]
        if not room:
            # The first pieces met are the frequent ones; later ones are not kept.
            for piece in learned:
                del known[piece]
        for i, ids in zip(whole, self._plain([texts[i] for i in whole]), strict=True):
            out[i] = ids.tobytes()
        return out


def _made(path: str, spaces_in_tokens: bool, kept: int) -> Encoder:
    return Encoder(path, spaces_in_tokens=spaces_in_tokens, kept=kept)
