"""Byte-level BPE of whole texts from content-defined chunks that documents share, and back.

A chunk ends where a rolling hash of the bytes before it says so, so equal
passages give equal chunks wherever they stand.  A worker encodes each distinct
chunk once.  A chunk's ids hold in any context only between its first and last
pre-token borders that no context moves; the rest of it, with its neighbour's,
is the join.  A join takes one pre-token more on either side and is encoded
anew: if these come out as in the chunk, join and chunk agree; else the chunk
is given up to the join, until all agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import RangeHash, id_text, slices, view
from ._tokens import ByteLevelIds, kept

#: Bytes that the rolling hash sees, bits of it that are zero at a border, and bytes of the shortest chunk but a text's last.
WINDOW, BITS, SHORTEST = 16, 9, 64
#: Bytes of strings and ids that a Python worker keeps from task to task; then it starts anew.
KEPT_BYTES = 32 << 20
#: The same of the pieces that new chunks and joins are encoded from.
PIECES_BYTES = 48 << 20
#: Text bytes of a batch.
BATCH = 1 << 20


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of the chunks of all texts, ascending: each text's end, and borders inside it, at starts of characters."""
    ends = offsets[1:][np.diff(offsets) > 0]
    if len(data) <= WINDOW:
        return ends
    at = np.arange(WINDOW, len(data))
    at = at[RangeHash(data)(at - WINDOW, at) >> np.uint64(64 - BITS) == 0]
    text = np.searchsorted(offsets, at, side="right") - 1
    at = at[at - offsets[text] >= WINDOW]  # the hash saw one text only
    while (inner := (data[at] & 0xC0) == 0x80).any():
        at = at + inner
        at = at[at < len(data)]
    chosen, last, limits = [], 0, iter(offsets[np.searchsorted(offsets, at, side="right") - 1].tolist())
    for place in at.tolist():
        last = max(last, next(limits))
        if place - last >= SHORTEST:
            chosen.append(place)
            last = place
    return np.union1d(ends, np.array(chosen, np.int64))


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges (start, size) of ``values``, one after the other."""
    upto = np.cumsum(sizes)
    places = np.repeat(starts - upto + sizes, sizes)
    places += np.arange(len(places))
    return values[places]


class Encoder:
    """Ids of strings, each distinct one encoded once; what is kept is bounded by its bytes."""

    def __init__(self, path: str):
        self.fresh_ids = ByteLevelIds(path)
        self.fresh_ids.keep_bytes = PIECES_BYTES
        special = {i: len(t.content.encode()) for i, t in self.fresh_ids.library.get_added_tokens_decoder().items()}
        self.lengths = np.array([special.get(i, n) for i, n in enumerate(self.fresh_ids.lengths.tolist())], np.int64)
        self.clear()

    def clear(self) -> None:
        """Entry e has the ids from starts[e] on, sizes[e] of them, and the borders inner[e]."""
        self.known: dict[bytes, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.inner = np.zeros((0, 8), np.int64)
        self.held = 0

    def entries(self, column: pa.Array) -> np.ndarray:
        """The entry of each string."""
        coded = column.dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        fresh = [s for s in distinct if s not in self.known]
        if fresh:
            ids, bounds = self.fresh_ids(pa.array(fresh, pa.binary()).cast(pa.string()))
            self.known.update(zip(fresh, range(len(self.sizes), len(self.sizes) + len(fresh))))
            self.inner = np.concatenate([self.inner, self.borders(fresh, ids, bounds)])
            self.starts = np.concatenate([self.starts, len(self.ids) + bounds[:-1]])
            self.ids, self.sizes = np.concatenate([self.ids, ids.astype(np.int32)]), np.concatenate([self.sizes, np.diff(bounds)])
            self.held += sum(map(len, fresh)) + 4 * len(ids) + 250 * len(fresh)
        return np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]

    def borders(self, strings: list[bytes], ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Of each string its first, second, last but one and last sure border in bytes, the tokens before each of the
        middle two, and the tokens between the first two and between the last two; zeros if it has under four.

        Sure: a blank after a visible ASCII character, where a pre-token begins whatever stands around.
        """
        data = np.frombuffer(b"".join(strings), np.uint8)
        begin = np.concatenate([[0], np.cumsum(list(map(len, strings)))])
        blank = ((data[1:] == 32) | (data[1:] == 10)) & (data[:-1] > 32) & (data[:-1] < 127)
        blank[begin[(begin > 0) & (begin < len(data))] - 1] = False
        sure = np.flatnonzero(blank) + 1
        low, high = np.searchsorted(sure, begin[:-1]), np.searchsorted(sure, begin[1:])
        full = np.flatnonzero(high - low >= 4)
        outer = sure[np.stack([low[full], low[full] + 1, high[full] - 2, high[full] - 1], 1)]
        ends = np.cumsum(self.lengths[ids])
        at = np.searchsorted(ends, outer)
        fit = (ends[np.minimum(at, len(ends) - 1)] == outer).all(1) if len(full) else np.zeros(0, bool)
        at += 1 - bounds[full][:, None]
        told = np.zeros((len(strings), 8), np.int64)
        told[full] = np.concatenate([outer - begin[full][:, None], at[:, 1:3], at[:, 1:2] - at[:, :1], at[:, 3:] - at[:, 2:3]], 1) * fit[:, None]
        return told

    def differ(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n ids from place a on are others than those from place b on."""
        wrong = ragged(self.ids, a, n) != ragged(self.ids, b, n)
        return np.bincount(np.repeat(np.arange(len(n)), n)[wrong], minlength=len(n)) > 0

    def disagree(self, join: np.ndarray, chunk: np.ndarray, left: bool) -> np.ndarray:
        """Whether a join's outermost pre-token has other ids than in the chunk (both entries), which stands left of the join or right."""
        inner = self.inner[chunk]
        n = inner[:, 7] if left else inner[:, 6]
        fits = self.sizes[join] >= n
        n = np.where(fits, n, 0)
        here = self.starts[join] + (0 if left else self.sizes[join] - n)
        there = self.starts[chunk] + (inner[:, 5] if left else inner[:, 4] - n)
        return ~fits | self.differ(here, there, n)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls), one after the other, and each text's bounds in them."""
        if self.held > KEPT_BYTES:
            self.clear()
        data, offsets = view(texts)
        ends = chunk_ends(data, offsets)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        cut = pa.StringArray.from_buffers(len(ends), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data))
        chunk = self.entries(cut)
        text_of = np.searchsorted(offsets, starts, side="right") - 1
        parts = self.inner[chunk]
        firm = parts[:, 5] > parts[:, 4]
        while True:
            keep = np.flatnonzero(firm)
            # a text: join, chunk, join, ..., chunk, join; a join runs up to a chunk's second border and from its last but one
            low, high = starts[keep] + parts[keep, 1], starts[keep] + parts[keep, 2]
            edge = np.concatenate([offsets[:-1], high])
            order = np.lexsort([np.concatenate([np.zeros(len(texts)), np.ones(len(keep))]), edge, np.concatenate([np.arange(len(texts)), text_of[keep]])])
            begin = edge[order]  # of each join
            piece = np.where(order >= len(texts), order - len(texts), -1)  # the firm chunk before it
            after = np.append(piece[1:], -1)
            owner = np.concatenate([np.arange(len(texts)), text_of[keep]])[order]
            stop = np.where(after >= 0, low[after], offsets[owner + 1]) if len(keep) else offsets[owner + 1]
            joins = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(begin),
                [None, pa.py_buffer(np.concatenate([[0], np.cumsum(stop - begin)]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ragged(data, begin, stop - begin)))],
            )
            join = self.entries(joins.cast(pa.large_string()))
            has, has_next = piece >= 0, after >= 0
            before, behind = keep[piece[has]], keep[after[has_next]]
            wrong = np.concatenate([before[self.disagree(join[has], chunk[before], True)], behind[self.disagree(join[has_next], chunk[behind], False)]])
            if not len(wrong):
                break
            firm[wrong] = False
        # joins and the chunks before them, in turn
        size = np.zeros(2 * len(begin), np.int64)
        place = np.zeros(2 * len(begin), np.int64)
        mine = keep[piece[has]]
        place[::2][has], size[::2][has] = self.starts[chunk[mine]] + parts[mine, 4], parts[mine, 5] - parts[mine, 4]
        place[1::2], size[1::2] = self.starts[join], self.sizes[join]
        ids = ragged(self.ids, place, size)
        bounds = np.concatenate([[0], np.cumsum(size)])[2 * np.searchsorted(owner, np.arange(len(texts) + 1))]
        return ids, bounds


def encode(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) of every row: the library's for the whole text, without special tokens around it.

    ``vocabulary_path`` is a byte-level tokenizers file without normaliser;
    strings of its special tokens inside a text become these tokens.  Null text
    counts as empty, ids may be null or repeat (a row each), an empty table
    gives no rows, other columns are ignored.
    """

    def run(batches):
        encoder = kept(Encoder, vocabulary_path)
        for batch in slices(batches, limit=BATCH):
            ids, bounds = encoder(batch.column(1))
            told = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), told], names=["doc_id", "ids"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


class Decoder:
    """The bytes of every id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        # the byte-level alphabet: visible Latin-1 characters stand for themselves, the others for 256 and on
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        shown = [library.id_to_token(i) or "" for i in range(library.get_vocab_size())]
        raw = [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in shown]
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def __call__(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Texts of the ids between the bounds; bytes that are no UTF-8 become replacement characters."""
        raw = ragged(self.data, self.starts[ids], self.sizes[ids]).tobytes()
        at = np.concatenate([[0], np.cumsum(self.sizes[ids])])[bounds]
        data = np.frombuffer(raw, np.uint8)
        if not ((data[at[at < len(data)]] & 0xC0) == 0x80).any():  # no character lies in two texts
            try:
                raw.decode()
                return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw))
            except UnicodeDecodeError:
                pass
        ends = at.tolist()
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])], pa.string())


def decode(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids, text of rows of ids, special tokens included.  Null ids count as none; an id outside the vocabulary raises."""

    def run(batches):
        decoder = kept(Decoder, vocabulary_path)
        for batch in batches:
            ids = batch.column(1)
            flat, bounds = ids.flatten().to_numpy(), ids.offsets.to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, decoder(flat, bounds - bounds[0])], names=["doc_id", "ids", "text"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{ids_col}`").cast("array<int>"), F.expr("CAST(array() AS array<int>)")).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, text string")
