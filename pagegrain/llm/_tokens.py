"""Tokenizing with a public vocabulary, one library call for many distinct pieces.

A text is cut at places no token crosses.  Arrow codes the pieces of a batch,
each distinct one is encoded by the library once for a worker, and texts are
put together from piece results by array operations.
"""

from __future__ import annotations

import os
import re
import string
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._text import view

#: Bytes of pieces, ids and their entries that a Python worker keeps from task to task; then it starts anew, so memory stays bounded.
KEEP_BYTES = 128 << 20
#: Bytes of a dictionary entry beside its string's own.
ENTRY_BYTES = 140
#: Text bytes of a batch; larger ones repeat more of their pieces.
BATCH_BYTES = 4 << 20
#: Pieces that one library call encodes.
GROUP = 10_000
#: White space other than space and line feed, and control characters that libraries class differently.
ODD = "\t\x0b-\x0d\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Runs of white space whose split depends on more than one cut.
HARD = re.compile(f"[ \n]{{3}}|[ \n]{{2}}\\Z|[{ODD}][ \n]|[ \n][{ODD}]")
ODD_ONE = re.compile(f"[{ODD}]")
#: Letters before this are letters to every version of Unicode's tables.
OLD_LETTERS = "\u0250"
_loaded: dict[str, object] = {}


def vocabulary(path: str):
    """The library's object for a file, once for a process; its own threads stay off."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
        _loaded[path].model._resize_cache(0)  # callers keep what is known; each piece comes once
    return _loaded[path]


def added_tokens(library) -> tuple[str, ...]:
    return tuple(t.content for t in library.get_added_tokens_decoder().values())


def kept(kind, path: str):
    """``kind(path)``, once for a process, so a worker's later tasks find the pieces of earlier ones."""
    key = f"{kind.__name__} of {path}"
    if key not in _loaded:
        _loaded[key] = kind(path)
    return _loaded[key]


def distinct_pieces(column: pa.Array) -> tuple[np.ndarray, list[str], list[str], np.ndarray]:
    """Code of every piece, the distinct pieces, the heads, and each text's first place (and the end).

    A piece begins at a space, which is not part of it, or at a line feed,
    which is.  What comes before the first of these is a text's head: head j
    has the code after those of the distinct pieces plus j.
    """
    data, offsets = view(column)
    starts = (data == 32) | (data == 10)
    begin = offsets[:-1][np.diff(offsets) > 0]
    is_head = np.zeros(len(data), bool)
    is_head[begin] = ~starts[begin]
    starts[begin] = True
    at = np.flatnonzero(starts)
    is_head = is_head[at]
    at = np.append(at, len(data)).astype(np.int32)
    cut = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data))
    coded = cut.take(pa.array(np.flatnonzero(~is_head))).dictionary_encode()
    shown, bounds = view(coded.dictionary)
    pieces = shown.tobytes().decode().replace("\n", " \n").split(" ")[1:]
    heads = cut.take(pa.array(np.flatnonzero(is_head))).to_pylist()
    codes = np.empty(len(is_head), np.int64)
    codes[~is_head] = coded.indices.to_numpy()
    codes[is_head] = len(pieces) + np.arange(len(heads))
    return codes, pieces, heads, np.searchsorted(at[:-1], offsets)


def held_by(strings) -> int:
    """Bytes that the strings take as keys, about: up to four for a character."""
    return sum(len(s) if s.isascii() else 4 * len(s) for s in strings) + ENTRY_BYTES * len(strings)


class Tails:
    """Cuts punctuation from a piece's end where it follows a letter or digit: pre-tokens end there.

    Characters of added tokens stay, so none of these is cut.
    """

    def __init__(self, added: tuple[str, ...]):
        self.marks = "".join(c for c in string.punctuation if not any(c in a for a in added))

    def cut(self, pieces: set[str]) -> dict[str, tuple[str, str]]:
        """(stem, tail) of those pieces that have a tail."""
        marks, last = self.marks, frozenset(self.marks)
        out = {}
        for piece in [p for p in pieces if p and p[-1] in last]:
            stem = piece.rstrip(marks)
            if stem and stem[-1].isalnum() and stem[-1] < OLD_LETTERS:
                out[piece] = stem, piece[len(stem) :]
        return out


class ByteLevelIds:
    """Ids of whole texts for a byte-level BPE vocabulary.

    Cutting before a space or line feed is safe there: a token holds white
    space only at its start or is all white space.  Texts with runs of three or
    unusual white space, or with the string of an added token, before which
    white space splits as at the end, go to the library whole.
    """

    #: What an instance keeps, where that is not ``KEEP_BYTES``.
    keep_bytes: int | None = None

    def __init__(self, path: str):
        self.library = vocabulary(path)
        size = self.library.get_vocab_size()
        self.lengths = np.array([len(self.library.id_to_token(i) or "") for i in range(size)], np.int64)
        self.added = added_tokens(self.library)
        self.tails = Tails(self.added)
        self.clear()

    def clear(self) -> None:
        """Entries of pieces (after a space, or a line feed of their own) and of bare strings; entry 0 is no ids."""
        self.known: dict[str, int] = {}
        self.bare: dict[str, int] = {"": 0}
        self.ids, self.starts, self.sizes = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.held = 0

    def add(self, ids: np.ndarray, sizes) -> range:
        """New entries, their ids one after the other."""
        first = len(self.sizes)
        sizes = np.asarray(sizes, np.int64)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids])
        self.held += 4 * len(ids)
        return range(first, len(self.sizes))

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def learn_bare(self, strings: set[str]) -> None:
        absent = list(strings.difference(self.bare))
        self.held += held_by(absent)
        told = [e.ids for e in self.library.encode_batch_fast(absent, add_special_tokens=False)]
        self.bare.update(zip(absent, self.add(np.array([i for ids in told for i in ids], "<u4"), list(map(len, told)))))

    def learn(self, pieces: list[str]) -> None:
        """Encode the pieces joined; token lengths tell where each piece ends."""
        for at in range(0, len(pieces), GROUP):
            group = pieces[at : at + GROUP]
            self.held += held_by(group)
            text = (" " + " ".join(group)).replace(" \n", "\n")
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.concatenate([[0], np.cumsum(self.lengths[ids])])
            raw = np.frombuffer(text.encode(), np.uint8)
            bounds = np.append(np.flatnonzero((raw == 32) | (raw == 10)), len(raw))  # a piece has one of these, at its start
            places = np.searchsorted(ends, bounds)
            if (ends[np.minimum(places, len(ends) - 1)] != bounds).any():
                alone = [self.whole(p if p[:1] == "\n" else " " + p) for p in group]
                ids, places = np.concatenate(alone), np.concatenate([[0], np.cumsum(list(map(len, alone)))])
            self.known.update(zip(group, self.add(ids, np.diff(places))))

    def learn_cut(self, pieces: set[str]) -> None:
        """Learn the pieces; of those with a tail the stem, which other pieces share, and the tail."""
        cut = self.tails.cut(pieces)
        plain = (pieces - cut.keys()).union(stem for stem, _ in cut.values())
        self.learn(list(plain.difference(self.known)))
        self.learn_bare({tail for _, tail in cut.values()})
        if cut:
            self.held += held_by(cut)
            stems = np.fromiter((self.known[stem] for stem, _ in cut.values()), np.int64, len(cut))
            tails = np.fromiter((self.bare[tail] for _, tail in cut.values()), np.int64, len(cut))
            both = np.stack([stems, tails], 1)
            self.known.update(zip(cut, self.add(self.gather(both.ravel())[0], self.sizes[both].sum(1))))

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the entries, one after the other, and the bounds of each."""
        counts = self.sizes[entries]
        upto = np.concatenate([[0], np.cumsum(counts)])
        places = np.repeat(self.starts[entries] - upto[:-1], counts)
        places += np.arange(upto[-1])
        return self.ids[places], upto

    def hard_rows(self, column: pa.Array, texts: list[str]) -> np.ndarray:
        """Which texts go to the library whole; a text may be named without need, as runs are sought across texts."""
        data, offsets = view(column)
        blank = (data == 32) | (data == 10)
        hard = np.zeros(len(texts), bool)
        runs = np.flatnonzero(blank[2:] & blank[1:-1] & blank[:-2])
        hard[np.searchsorted(offsets, runs, side="right") - 1] = True
        long = np.flatnonzero(np.diff(offsets) > 1)
        hard[long] |= blank[offsets[long + 1] - 1] & blank[offsets[long + 1] - 2]
        for i, text in enumerate(texts):
            if not hard[i] and (any(a in text for a in self.added) or ODD_ONE.search(text) and HARD.search(text)):
                hard[i] = True
        return hard

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls), one after the other, and each text's bounds in them."""
        if self.held > (self.keep_bytes or KEEP_BYTES):
            self.clear()
        texts = column.to_pylist()
        hard = np.flatnonzero(self.hard_rows(column, texts))
        if len(hard):
            plain = np.ones(len(texts), bool)
            plain[hard] = False
            column = pc.if_else(pa.array(plain), column, pa.scalar("", column.type))
        codes, pieces, heads, first = distinct_pieces(column)
        self.learn_cut(set(pieces).difference(self.known))
        self.learn_bare(set(heads))
        entry_of = np.fromiter(chain(map(self.known.__getitem__, pieces), map(self.bare.__getitem__, heads)), np.int64, len(pieces) + len(heads))
        ids, upto = self.gather(entry_of[codes])
        bounds = upto[first]
        if len(hard):
            alone = {i: self.whole(texts[i]) for i in hard.tolist()}
            parts = [alone[i] if i in alone else ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum(list(map(len, parts)))])
        return ids, bounds


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``end_id`` after each text."""
    return np.insert(ids, bounds[1:], end_id).astype("<u4", copy=False), bounds + np.arange(len(bounds))
