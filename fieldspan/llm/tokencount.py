"""Operator 6: token counts by trie-shared dynamic programming.

Texts are cut into pre-tokens. The distinct pre-tokens of a batch are put into a trie of bytes
(sorted, with a stack of shared prefixes, so that the trie is walked rather than kept). At each node the
best score of the path from the root is computed once, from the scores of vocabulary pieces that
end there, and so is its number of tokens; where a pre-token ends the count is stored. A text's count is the
sum over its pre-tokens.

The unigram model: each piece of a public byte-level vocabulary scores minus the logarithm of its
rank, as a whole number of millionths, so that sums are exact in any order. The segmentation
with the highest sum counts; of equal sums, the one of fewest tokens.

The driver reads the vocabulary and broadcasts it; its size is the file's, whatever the corpus.

Defined cases: a null text has no tokens; texts are counted as a whole; rows are looked at one by
one; an empty table gives an empty result; other columns are not read. Stored counts are dropped
once there are CACHE of them.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

ship(__name__)

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE = 500_000
#: Pre-tokens: a run of letters, of digits, of other signs, each with the space before it; a run of white space.
PRE_TOKEN = re.compile(r" ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+")
NONE = -(1 << 60)


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    """Pieces and their scores from a rank file (base64 and rank on each line)."""
    scores = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                piece, rank = line.split()
                scores[base64.b64decode(piece)] = -round(1e6 * math.log(int(rank) + 2))
    return scores


def lengths_of(scores: dict[bytes, int]) -> dict[int, list[int]]:
    """For each byte, the lengths of the pieces that end with it, rising."""
    found: dict[int, set[int]] = {}
    for piece in scores:
        found.setdefault(piece[-1], set()).add(len(piece))
    return {b: sorted(x) for b, x in found.items()}


def counts_of(words: list[bytes], scores: dict[bytes, int], longest: int | None = None, lengths: dict[int, list[int]] | None = None) -> dict[bytes, int]:
    """Tokens of each distinct word. Words are taken in order, so that they run through the trie in
    depth-first order; best and number of the prefix shared with the word before stay on the stack.

    longest: pieces above this length are not used; lengths: lengths_of(scores), if they are at hand."""
    if lengths is None:
        lengths = lengths_of(scores)
    out, before = {}, b""
    best, number = [0], [0]
    for w in sorted(words):
        shared, most = 0, min(len(w), len(before))
        while shared < most and w[shared] == before[shared]:
            shared += 1
        del best[shared + 1 :], number[shared + 1 :]
        for end in range(shared + 1, len(w) + 1):
            top, n = NONE, 0
            for size in lengths.get(w[end - 1], ()):
                if size > end or longest and size > longest:
                    break
                start = end - size
                score = scores.get(w[start:end])
                if score is not None and best[start] > NONE:
                    score += best[start]
                    if score > top or score == top and number[start] + 1 < n:
                        top, n = score, number[start] + 1
            best.append(top)
            number.append(n)
        if best[len(w)] == NONE:
            raise ValueError("the vocabulary doesn't spell every byte")
        out[w] = number[len(w)]
        before = w
    return out


def _counter(vocabulary, piece_bytes: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, lengths = vocabulary.value
        known: dict[str, int] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                found = [PRE_TOKEN.findall(x.as_py() or "") for x in part.column(1)]
                new = {w for ws in found for w in ws if w not in known}
                if len(known) + len(new) > CACHE:
                    known, new = {}, {w for ws in found for w in ws}
                got = counts_of([w.encode("utf-8", "surrogatepass") for w in new], scores, piece_bytes, lengths)
                known |= {w: got[w.encode("utf-8", "surrogatepass")] for w in new}
                pre = pa.array(list(map(len, found)), pa.int64())
                tokens = pa.array([sum(map(known.__getitem__, ws)) for ws in found], pa.int64())
                kinds = pa.array([len(Counter(ws)) for ws in found], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pre, kinds, tokens], names=["id", "n_pre_tokens", "n_distinct", "n_tokens"])

    return run


def count(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, piece_bytes: int | None = None) -> DataFrame:
    """A row for each document: id, n_pre_tokens, n_distinct, n_tokens. vocabulary: a path that the
    driver can read; piece_bytes: pieces above this length are not used (None: all are)."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scores = read_vocabulary(vocabulary)
    shared = df.sparkSession.sparkContext.broadcast((scores, lengths_of(scores)))
    return rows.mapInArrow(_counter(shared, piece_bytes), f"id {kind}, n_pre_tokens bigint, n_distinct bigint, n_tokens bigint").withColumnRenamed("id", id_col)
