"""Token ids by the tokenizers library, with words looked up in a bounded memory of earlier results.

Byte-pair models of these files encode each word by itself, so a text's ids are the ids of its words in order.
Texts are cut at spaces, each piece is encoded once and remembered; a text that holds the name of a special token goes to
the library whole. The result is the library's own for every text.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterable

#: Pieces remembered by a worker process; later ones are encoded each time they come up in a batch.
MEMORY = 900_000
#: A piece longer than this is encoded but not remembered.
LONGEST = 64

#: A piece may follow a cut only if it begins with one of these, none of which is white space to any of the libraries.
_START = re.compile("[!-~¡-ᙿ]")
#: Stands for the first piece of a text, which follows no space; no piece is equal to it.
_NONE = " "
_CUT = re.compile(" (?=[!-~¡-ᙿ])")
#: Letters that need no normalisation but lower case, then marks that the pre-tokenizers split from letters.
_MARKS = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
_CORE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _gaps(got: list[bytes | None], pieces: list[str]) -> tuple[list[int], list[str]]:
    """Where got holds None, and the pieces there."""
    places: list[int] = []
    k = -1
    try:
        while True:
            k = got.index(None, k + 1)
            places.append(k)
    except ValueError:
        return places, [pieces[k] for k in places]


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    file: a tokenizer file; a name without a slash is one of the public tokenizers.
    """

    def __init__(self, file: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        where = file if "/" in file else path(file)
        self.whole = Tokenizer.from_file(where)
        self.added = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        self.lower = self.whole.normalizer is not None  # the word model: lower case, white space dropped
        self.core = Tokenizer.from_file(where)  # for one run of letters: nothing to split, and lower case is made here
        self.core.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        if self.lower:
            self.core.normalizer = None
        self.lead = "" if self.lower else " "
        # the alphabet in which the models spell bytes: ASCII letters are themselves
        spell = self.core.pre_tokenizer.pre_tokenize_str
        self.alphabet = {ord(c): spell(c)[0][0] for c in map(chr, range(0xC0, 0x100))}
        self.mark = spell(self.lead)[0][0] if self.lead else ""
        self.memory = memory
        self.known: dict[str, bytes] = {_NONE: b""}  # of pieces behind a space
        self.opened: dict[str, bytes] = {}  # of pieces at the beginning of a text
        self.marks: dict[str, bytes] = {}

    @staticmethod
    def packed(ids: Iterable[int]) -> bytes:
        got = array("I", ids)
        if sys.byteorder == "big":
            got.byteswap()
        return got.tobytes()

    def _encode(self, tokenizer, texts: list[str]) -> list[bytes]:
        return [self.packed(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spelled(self, letters: str) -> bytes:
        """Ids of a run of letters: one word of the model, so no normaliser and no cutting is needed."""
        spelling = self.mark + (letters if letters.isascii() else letters.translate(self.alphabet))
        ids = self.packed([t.id for t in self.core.model.tokenize(spelling)])
        if len(self.known) < self.memory and len(letters) <= LONGEST:
            self.known[letters] = ids
        return ids

    def _marks(self, marks: str) -> bytes:
        if len(self.marks) >= 10_000:
            self.marks.clear()
        ids = self.marks[marks] = self._encode(self.whole, [marks])[0]
        return ids

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces that follow a space."""
        rest, new, known, marks_of = [], {}, self.known, self.marks
        for p in pieces:
            bare = p[:-1]
            if p.isascii() and p.isalpha():
                letters, marks = p, ""
            elif bare.isascii() and bare.isalpha() and p[-1] in _MARKS:
                letters, marks = bare, p[-1]
            elif m := _CORE.fullmatch(p):
                letters, marks = m.groups()
            else:
                rest.append(p)
                continue
            if self.lower:
                letters = letters.lower()
            ids = known.get(letters)
            if ids is None:
                ids = self._spelled(letters)
            if marks:
                ids += marks_of.get(marks) or self._marks(marks)
            new[p] = ids
        new.update(zip(rest, self._encode(self.whole, [self.lead + p for p in rest])))
        if len(known) < self.memory:
            known.update(new if len(max(new, key=len, default="")) <= LONGEST else {p: ids for p, ids in new.items() if len(p) <= LONGEST})
        return new

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null is the empty text."""
        get = self.known.get
        out: list[list[bytes | None] | None] = []
        gaps: list[tuple[list[bytes | None], list[int], list[str]]] = []  # where pieces of texts are not known, and these pieces
        missing: set[str] = set()
        firsts: list[str] = []
        whole: list[str] = []
        for text in texts:
            text = text or ""
            if any(a in text for a in self.added):
                out.append(None)
                whole.append(text)
                continue
            pieces = text.split(" ")
            firsts.append(pieces[0])
            pieces[0] = _NONE
            got = list(map(get, pieces))
            places, absent = _gaps(got, pieces)
            if not all(map(_START.match, absent)):  # several spaces in a row, or other white space after one
                pieces = _CUT.split(text)
                firsts[-1], pieces[0] = pieces[0], _NONE
                got = list(map(get, pieces))
                places, absent = _gaps(got, pieces)
            if places:
                gaps.append((got, places, absent))
                missing.update(absent)
            out.append(got)
        new = self._learn(missing)
        for got, places, absent in gaps:
            for k, p in zip(places, absent):
                got[k] = new[p]
        if unseen := list(set(firsts).difference(self.opened)):
            if len(self.opened) + len(unseen) > self.memory // 8:
                self.opened = {}
                unseen = list(set(firsts))
            self.opened.update(zip(unseen, self._encode(self.whole, unseen)))
        entire, opened = iter(self._encode(self.whole, whole)), iter(firsts)
        joined = []
        for got in out:
            if got is None:
                joined.append(next(entire))
            else:
                got[0] = self.opened[next(opened)]
                joined.append(b"".join(got))
        return joined


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(file: str, memory: int = MEMORY) -> Encoder:
    """This worker process's encoder, kept from task to task."""
    if (file, memory) not in _ENCODERS:
        _ENCODERS[file, memory] = Encoder(file, memory)
    return _ENCODERS[file, memory]
