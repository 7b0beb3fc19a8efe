"""Exact token counts of long texts by overlap resynchronisation (sentencepiece models of merge type).

A text of up to ``chunk_chars`` is encoded at once. A longer one is cut into chunks that overlap;
each is encoded with offsets, and two neighbours are spliced at a boundary that both have and that
is proven stable: no piece of the vocabulary holds the two characters that meet there next to each
other, so no merge ever crosses it and what lies left and right is encoded independently. Where the
overlap has no such boundary it is widened, in the end to the whole left chunk; if that has none either,
the text is searched on to the next one, and the stretch up to there is encoded once, whole. So no part of a text is
encoded more than a few times, however long it goes without a boundary.

Defined cases: null text counts as empty (0 bytes, 0 tokens); repeated rows are counted each; an
empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from bisect import bisect_left

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gleanery.llm.common import boolean, long, text_map

DEFAULT_MODEL = "piece_bpe_32k.model"


def load_pieces(path: str):
    """The processor of a model file and the pairs of characters that stand together in some piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    glued: set[tuple[str, str]] = set()
    for i in range(sp.get_piece_size()):
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)):
            piece = sp.id_to_piece(i)
            glued.update(zip(piece, piece[1:]))
    return sp, glued


class ChunkedCounter:
    """Counts the tokens of one text at a time."""

    def __init__(self, path: str, chunk_chars: int = 32_768, overlap_chars: int = 128):
        self.sp, self.glued = load_pieces(path)
        self.chunk, self.overlap = chunk_chars, overlap_chars

    def starts(self, text: str) -> list[int]:
        """Where the tokens of a chunk begin, in UTF-8 bytes."""
        return [p.begin for p in self.sp.encode(text, return_type="proto").pieces]

    def stable(self, shared: str, left: list[int], left_shift: int, right: list[int]) -> int | None:
        """The first byte offset in ``shared`` where both chunks have a proven boundary."""
        begins_left, begins_right = set(left[bisect_left(left, left_shift) :]), set(right[: bisect_left(right, len(shared.encode()))])
        at, before = 0, None
        for c in shared:
            d = "▁" if c == " " else c
            if before is not None and (before, d) not in self.glued and at + left_shift in begins_left and at in begins_right:
                return at
            at, before = at + len(c.encode()), d
        return None

    def boundary(self, text: str, begin: int, end: int, block: int = 65_536) -> int | None:
        """The first place after ``begin`` and before ``end`` that no merge can cross."""
        for at in range(begin, end, block):
            part = text[at : min(end, at + block + 1)].replace(" ", "▁")
            for i, pair in enumerate(zip(part, part[1:]), at + 1):
                if pair not in self.glued:
                    return i
        return None

    def count(self, text: str) -> int:
        if len(text) <= self.chunk:
            return len(self.sp.encode(text))
        total, begin, end = 0, 0, self.chunk
        left, done = self.starts(text[:end]), 0  # done: tokens of the left chunk that were counted before
        while end < len(text):
            overlap, cut = self.overlap, None
            stop = min(len(text), end + self.chunk)
            while cut is None and overlap < end - begin:
                if self.boundary(text, end - overlap, end) is not None:
                    shared = text[end - overlap : end]
                    right = self.starts(text[end - overlap : stop])
                    shift = len(text[begin : end - overlap].encode())
                    cut = self.stable(shared, left, shift, right)
                if cut is None:
                    overlap *= 2
            if cut is None:  # no stable boundary in the whole left chunk: it grows to the next one, and past it by an overlap
                found = self.boundary(text, end - 1, len(text))
                stop = len(text) if found is None else min(len(text), found + self.overlap - 1)
                seen = left[done] if done < len(left) else None
                left = self.starts(text[begin:stop])
                done = bisect_left(left, seen) if seen is not None else done
            else:
                total += bisect_left(left, cut + shift) - done
                begin, left, done = end - overlap, right, bisect_left(right, cut)
            end = stop
        return total + len(left) - done


def count_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: str | None = None,
    limit: int = 4096,
    chunk_chars: int = 32_768,
    overlap_chars: int = 128,
) -> DataFrame:
    """One row for each input row: the id, ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    path = model or public_tokenizers.path(DEFAULT_MODEL)

    def make():
        counter = ChunkedCounter(path, chunk_chars, overlap_chars)

        def run(texts):
            texts = [t or "" for t in texts]
            short = [i for i, t in enumerate(texts) if len(t) <= chunk_chars]
            counts = [0] * len(texts)
            for i, ids in zip(short, counter.sp.encode([texts[i] for i in short], num_threads=1) if short else []):
                counts[i] = len(ids)
            for i, t in enumerate(texts):
                if len(t) > chunk_chars:
                    counts[i] = counter.count(t)
            return {
                "n_bytes": [len(t.encode()) for t in texts],
                "n_tokens": counts,
                "over_limit": [c > limit for c in counts],
            }

        return run

    return text_map(docs, text_col, make, T.StructType([long("n_bytes"), long("n_tokens"), boolean("over_limit")]), [id_col])
