"""Token counts of documents without materialising ids.

Each document becomes its pre-token frequencies: a pair (pre-token, times) for
each distinct one.  The library counts the tokens of each distinct pre-token
once for a worker, the frequencies are joined with these counts, and a
document's count is the sum of times * tokens.  Pre-tokens, counts and
frequencies stay in the task: there is no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import id_text, slices, view
from ._tokens import BATCH_BYTES, GROUP, KEEP_BYTES, Tails, added_tokens, distinct_pieces, held_by, kept, vocabulary


def frequencies(codes: np.ndarray, first: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pre-token, times), a row for each pair that occurs, from each place's pre-token and the documents' first places."""
    document = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pair, times = np.unique(document * kinds + codes, return_counts=True)
    return pair // max(kinds, 1), pair % max(kinds, 1), times


class PieceCounts:
    """Tokens in each pre-token: the runs between spaces and line feeds.

    Fit for vocabularies that drop white space before merging: no token crosses
    a run's end.  Added tokens inside a run are the library's to find.
    """

    def __init__(self, path: str):
        self.library = vocabulary(path)
        self.tails = Tails(added_tokens(self.library))
        self.known: dict[str, int] = {}
        self.held = 0

    def learn(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), GROUP):
            group = pieces[at : at + GROUP]
            told = self.library.encode(group, is_pretokenized=True, add_special_tokens=False)
            counts = np.bincount(np.array(told.word_ids, np.int64), minlength=len(group))
            self.known.update(zip(group, counts.tolist()))

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """Token counts of the texts (no nulls): frequencies of their distinct pre-tokens joined with counts, summed."""
        if self.held > KEEP_BYTES:
            self.known.clear()
            self.held = 0
        codes, pieces, heads, first = distinct_pieces(texts)
        pieces = [p.removeprefix("\n") for p in pieces] + heads
        missing = set(pieces).difference(self.known)
        cut = self.tails.cut(missing)
        plain = (missing - cut.keys()).union(*cut.values())
        self.held += held_by(plain) + held_by(cut)
        self.learn(list(plain.difference(self.known)))
        known = self.known
        known.update([(p, known[stem] + known[tail]) for p, (stem, tail) in cut.items()])
        tokens = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        document, piece, times = frequencies(codes, first, len(pieces))
        totals = np.zeros(len(texts) + 1, np.int64)
        np.add.at(totals, document + 1, tokens[piece] * times)
        return totals[1:]


def token_counts(
    df: DataFrame, vocabulary_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) of every row.

    ``vocabulary_path`` is a tokenizers file that drops white space; counts are
    those of the library for the whole text without begin, end or added special
    tokens.  Null text counts as empty, ids may be null or repeat (a row each),
    an empty table gives no rows, other columns are ignored.
    """

    def run(batches):
        count = kept(PieceCounts, vocabulary_path)
        for batch in slices(batches, limit=BATCH_BYTES):
            _, offsets = view(batch.column(1))
            totals = count(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(totals)], names=["doc_id", "n_bytes", "n_tokens"]
            )

    counted = id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
