"""Token ids of whole texts by a public tokenizer file, with work shared between equal words."""

from __future__ import annotations

import functools
import itertools
import json
import operator
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Both vocabularies used here split a text before merging, and never across these
# units: a run of plain letters (with one blank before) that ends at white space or
# a mark, another run without white space, or white space.
_UNIT = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[ \n.,;:!?]|\Z)| ?\S+|\s+(?!\S)|\s+")
# White space on which regex dialects differ, or that is not plain: such texts are encoded whole.
_ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
_SAFE_CUT = re.compile(r"(?<=[^\s']) (?=[^\s])")
PIECE_CHARS = 1 << 18
MEMO_UNITS = 400_000
UNIT_CHARS = 64
GROUP = 32
# A unit of letters, with marks behind it or not. Both vocabularies split before a run of marks and keep it whole
# (an apostrophe may begin a suffix, so it is none of these).
_WORD = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
# Without these, all white space is single blanks and line ends, no two side by side: a token ends before each and after a line end.
_WIDE = ("  ", " \n", "\n ", "\n\n", "\t", "\r")
# Marks a word with no blank before it; a text that has this character is encoded whole.
_BARE = "\x0b"


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """A long text cut before a single blank between two words, where no token can cross."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE_CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else one from 256 up."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Memo:
    """Ids of units made lately: of the last ``MEMO_UNITS`` at least, and at most of twice as many."""

    def __init__(self, make: Callable[[set[str]], dict[str, bytes]]):
        self.make = make
        self.young: dict[str, bytes] = {}

    def parts(self, units: list[str]) -> list[bytes]:
        parts = list(map(self.young.get, units))
        if None in parts:
            own = self.make({u for u, p in zip(units, parts) if p is None})
            over = len(self.young) + len(own) - 2 * MEMO_UNITS
            if over > 0:
                self.young = dict(itertools.islice(self.young.items(), over + MEMO_UNITS, None))
            self.young.update(own if max(map(len, own)) <= UNIT_CHARS else {u: ids for u, ids in own.items() if len(u) <= UNIT_CHARS})
            parts = [own[u] if p is None else p for u, p in zip(units, parts)]
        return parts


def _latin(text: str) -> bool:
    """Whether no character is beyond U+00FF; much faster than the largest one."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()  # much faster than numpy for a few ids


class _Encoder:
    """A tokenizer file and a memo of units."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.merges = Tokenizer(self.model)
        # how special tokens begin; in lower case another text may become one, but not these marks
        self.special = {t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.letters = _byte_letters()
        layout = json.loads(self.tokenizer.to_str())
        steps = [n["type"] for n in (layout["normalizer"] or {}).get("normalizers", [])]
        splits = [p["type"] for p in layout["pre_tokenizer"].get("pretokenizers", [layout["pre_tokenizer"]])]
        # the two layouts whose treatment of plain letters is known
        self.lower = steps == ["NFC", "Replace", "Lowercase"] and splits == ["Split", "ByteLevel"]
        self.plain = self.lower or (layout["normalizer"] is None and splits == ["ByteLevel"])
        # the letter of a byte that no text has: if nothing merges with it, words beside it get their own ids
        joint = self.letters[0xC0]
        alone = joint in layout["model"]["vocab"] and not any(joint in "".join(m) for m in layout["model"]["merges"])
        self.joint = joint if self.plain and not self.lower and alone else None
        self.units = _Memo(self.new_ids)
        self.words = _Memo(self.word_ids)

    def new_ids(self, units: set[str]) -> dict[str, bytes]:
        """Ids of units; words of letters go to the merges without further analysis, marks after them apart."""
        own, mixed, marked, model = {}, [], [], self.model
        for u in units:
            word = _WORD.fullmatch(u) if self.plain else None
            if word is None:
                mixed.append(u)
            elif word[2]:
                marked.append((u, *word.groups()))
            else:
                letters = word[1].lstrip(" ").lower() if self.lower else word[1]
                if not letters.isascii() or letters[0] == " ":
                    letters = letters.encode().decode("latin-1").translate(self.letters)
                own[u] = _bytes([t.id for t in model.tokenize(letters)])
        if marked:
            words, marks = (self.units.parts([x[i] for x in marked]) for i in (1, 2))
            own |= {u: w + m for (u, *_), w, m in zip(marked, words, marks)}
        if mixed:
            encoded = self.tokenizer.encode_batch_fast(mixed, add_special_tokens=False)
            own |= {u: _bytes(e.ids) for u, e in zip(mixed, encoded)}
        return own

    def merged(self, words: list[str]) -> list[bytes]:
        """Ids of words in byte letters by the merges alone; many words a call, unless they end in a suffix of their own."""
        if self.lower:
            return [_bytes([t.id for t in self.model.tokenize(w)]) for w in words]
        texts = [self.joint.join(words[i:i + GROUP]) for i in range(0, len(words), GROUP)]
        end = self.tokenizer.token_to_id(self.joint)
        flat = array("I")
        for e in self.merges.encode_batch_fast(texts, add_special_tokens=False):
            flat.extend(e.ids)
            flat.append(end)
        cuts = (4 * np.flatnonzero(np.frombuffer(flat, np.uint32) == end)).tolist()
        raw = flat.tobytes()
        return [raw[i:j] for i, j in zip([0, *[c + 4 for c in cuts]], cuts)]

    def word_ids(self, words: set[str]) -> dict[str, bytes]:
        """Ids of what lies between blanks, with the blank before it; of line ends, and of words after ``_BARE``, alone.

        A layout in lower case drops blanks, and all its words here are up to U+00FF.
        """
        plain, letters, marked, bases, marks, others, blank = [], [], [], [], [], {}, "" if self.lower else self.letters[32]
        for w in words:
            if w.isalpha() and (self.lower or w.isascii() or max(w) <= "ÿ"):
                plain.append(w)
                letters.append(blank + (w if w.isascii() else w.encode().decode("latin-1").translate(self.letters)))
                continue
            word = w.rstrip(_MARKS)
            if word.isalpha() and (self.lower or word.isascii() or max(word) <= "ÿ"):
                marked.append(w)
                bases.append(word)
                marks.append(w[len(word):])
            else:
                others[w] = w if self.lower or w == "\n" else w[1:] if w[:1] == _BARE else " " + w
        own = dict(zip(plain, self.merged(letters)))
        if marked:
            apart = list(set(bases).difference(own))
            own.update(zip(apart, self.words.parts(apart)))
            own.update(zip(marked, map(operator.add, map(own.get, bases), self.units.parts(marks))))
        if others:
            ids = self.new_ids(set(others.values()))
            own.update((w, ids[u]) for w, u in others.items())
        return own

    def shares_words(self, text: str) -> bool:
        """Whether ``together`` may take a text without special tokens."""
        if self.lower:  # lower case is letter by letter up to U+00FF, and such text has no other composed form
            return _latin(text) and not _ODD.search(text)
        return self.joint is not None and not _ODD.search(text) and not any(x in text for x in _WIDE)

    def together(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that ``shares_words`` lets pass.

        Each different word of all these texts is looked up once; the ids of the texts are gathered from theirs.
        """
        if self.lower:
            words = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
        else:
            words = pc.split_pattern(pa.array([_BARE + t.replace("\n", " \n " + _BARE) for t in texts], pa.large_string()), " ")
        coded = words.values.dictionary_encode()
        parts = self.words.parts(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        each = coded.indices.to_numpy()
        n = sizes[each]
        ends = np.cumsum(n)
        place = np.repeat((np.cumsum(sizes) - sizes)[each] - (ends - n), n) + np.arange(n.sum())
        ids = np.frombuffer(b"".join(parts), "<u4")[place]
        cuts = np.concatenate([[0], ends])[words.offsets.to_numpy()]
        return [ids[i:j] for i, j in zip(cuts[:-1], cuts[1:])]

    def whole(self, text: str) -> bytes:
        return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def piece(self, text: str) -> bytes:
        if _ODD.search(text):
            return self.whole(text)
        return b"".join(self.units.parts(_UNIT.findall(text)))


_encoder = functools.lru_cache(maxsize=4)(_Encoder)


def encode(path: str, texts: list[str]) -> list[np.ndarray]:
    """Ids (unsigned 32 bits) of each text; none are added, but a special token that a text holds keeps its id.

    Equal words get equal ids, so a worker encodes a word once while it keeps coming back.
    The result is that of encoding the whole text by the library's defaults.
    """
    encoder = _encoder(path)

    out, plain = [np.zeros(0, "<u4")] * len(texts), []
    for i, text in enumerate(texts):
        if not text:
            continue
        if any(x in text for x in encoder.special):
            out[i] = np.frombuffer(encoder.whole(text), "<u4")
        elif not encoder.shares_words(text):
            out[i] = np.frombuffer(b"".join([encoder.piece(p) for p in pieces(text)]), "<u4")
        elif len(text) > PIECE_CHARS:
            out[i] = np.concatenate([encoder.together([p])[0] for p in pieces(text)])
        else:
            plain.append(i)
    for i, ids in zip(plain, encoder.together([texts[i] for i in plain]) if plain else []):
        out[i] = ids
    return out
