"""Token counts of whole texts by overlap resynchronisation.

A text of up to ``chunk_chars`` characters is one chunk. A longer one is encoded in overlapping chunks with offsets;
neighbours are spliced at a position inside the overlap where both have a token boundary and which is proven stable:
a white-space boundary that no pre-token, normal form or special token of the tokenizer spans. If an overlap holds no
such position, it is widened by doubling until one is found or the two chunks are one. Memory in a task is bounded by
a chunk and, where a text has no white space at all, by that run.

Null text: as empty, 0 tokens. Repeated rows are counted each. An empty table gives an empty result. Columns besides
the id and the text are ignored, whatever their names. SentencePiece models (.model) have no stable boundaries of
this kind; their texts are encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .tokens import encoder

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512


def _stable(text: str, at: int, before_space: bool) -> bool:
    """No token can span position ``at``: it ends (or, for before_space, starts) a run of white space."""
    a, b = text[at - 1].isspace(), text[at].isspace()
    return (not a and b) if before_space else (a and not b)


def resync_count(text: str, encode, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, before_space: bool = False) -> int:
    """Tokens of text; encode(part) returns the start offset of every token of a part."""
    n, total, start = len(text), 0, 0
    while n - start > chunk_chars:
        end = min(n, start + chunk_chars)
        left = encode(text[start:end])
        overlap, spliced = overlap_chars, None
        while spliced is None:
            begin = max(start + 1, end - overlap)
            stop = min(n, end + overlap)
            right = {begin + x for x in encode(text[begin:stop])}
            # The last shared stable boundary; left[i:] are then tokens of the next chunk.
            for i in range(len(left) - 1, 0, -1):
                at = start + left[i]
                if at <= begin:
                    break
                if left[i] != left[i - 1] and at in right and _stable(text, at, before_space):
                    spliced = (i, at)
                    break
            if spliced is None:
                if begin == start + 1:  # nothing to splice at in the whole chunk: make the chunk itself longer
                    if end == n:
                        return total + len(left)
                    end = min(n, end + (end - start))
                    left = encode(text[start:end])
                    overlap = overlap_chars
                else:
                    overlap *= 2
        total += spliced[0]
        start = spliced[1]
    return total + len(encode(text[start:]))


def _counter(path: str, chunk_chars: int, overlap_chars: int):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text, num_threads=1))
    e = encoder(path)
    before = e.lower is False  # byte-level tokens carry the space before a word
    known = e.lower is not None

    def starts(part: str) -> list[int]:
        at = [a for a, _ in e.tokenizer.encode(part, add_special_tokens=False).offsets]
        # Byte-level offsets leave out the space that a token begins with.
        return [a - 1 if a and part[a - 1] == " " else a for a in at] if before else at

    def count(text: str) -> int:
        if len(text) <= chunk_chars or not known:
            return e.count(text)
        return resync_count(text, starts, chunk_chars, overlap_chars, before)

    return count


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (n_tokens > limit). No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer_path, chunk_chars, overlap_chars)
        for b in batches:
            n = [count(t or "") for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = rows.mapInArrow(run, "id long, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
