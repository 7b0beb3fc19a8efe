"""Harmonic packing of token sequences.

Lengths fall into classes by the reciprocal of the capacity: class ``s = capacity // k`` holds pieces of
exactly ``s`` tokens, and each of its bins takes exactly ``k`` of them. A document gives as many full
sequences as fit, then from what remains the largest class that is at least ``min_cut`` long, again and
again; the tail under ``min_cut`` stays whole and forms a class by its own length, with
``capacity // length`` to a bin. So a bin's fill and every offset in it follow from the class alone, and
each task fills its bins without knowing of the others; no row is shuffled for that. Only the pieces of
the bins that a task leaves open (under ``k`` in each class) are ranked over all tasks, by counts by
task and class, and fill bins together. What is left then is under ``k`` pieces in each class over all
data, a bound that depends on the capacity only; those few go into bins by first fit, longest first.

Tokenising: ids are those of the tokenizers library. Plain texts are encoded by tiktoken's merge loop over the same file's vocabulary, where ``merges_agree`` proves that both
merge alike: the library merges the pairs that the file lists, tiktoken any pair that gives a token, both the one of lowest rank first. Say tiktoken merges a pair that is not listed, and
all was alike before. No merge has crossed the ends of the token it gives, so inside them all went as in that token's bytes alone; but there, as is checked for each token, the
last merge is the listed one. A text is plain if it has no special string and only characters that all versions of Unicode class alike (``PLAIN``); other texts, and
files of any other kind, go through the library.

Defined cases: null text counts as empty and gives the one token 0; null ids are packed like others
and repeated rows are packed each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gleanery.llm.common import long, slices, strings
from gleanery.session import cut_lineage

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
#: Characters beyond those that all versions of Unicode class alike: letters of common scripts, digits, signs, and white space that is no control character.
PLAIN = re.compile("[^\\t\\n\\r -~\u00a1-\u024f\u0400-\u045f\u2010-\u2027\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")


def merges_agree(merges: list[tuple[str, str]], vocabulary: dict[str, int]) -> bool:
    """Do ids rise with the merges, and do the merges of each token's own signs end in that token?"""
    made = [vocabulary[a + b] for a, b in merges]
    if made != sorted(made):
        return False
    ranks = {pair: i for i, pair in enumerate(merges)}
    far = len(merges)
    for a, b in merges:
        parts = list(a + b)
        while len(parts) > 1:
            rank, at = min((ranks.get(pair, far), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == far:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return True


def merge_core(path: str):
    """tiktoken's merge loop over the vocabulary of a tokenizers file, or None if the file is not plain byte-level BPE whose merges agree."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
    if model.get("type") != "BPE" or not plain or odd or spec.get("normalizer"):
        return None
    vocabulary = model["vocab"]
    if not merges_agree([tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]], vocabulary):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in piece): i for piece, i in vocabulary.items() if piece not in special}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class TextEncoder:
    """Token ids of whole texts as the tokenizers library gives them."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.core = merge_core(path)

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def is_plain(self, text: str) -> bool:
        return self.core is not None and not PLAIN.search(text) and not any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> list[bytes]:
        out = [self.core.encode_to_numpy(t, disallowed_special=()).astype("<u4").tobytes() if self.is_plain(t) else None for t in texts]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self.library([texts[i] for i in rest])):
            out[i] = ids
        return out


@lru_cache(1)
def text_encoder(path: str) -> TextEncoder:
    """One for all tasks of a worker."""
    return TextEncoder(path)


def class_sizes(capacity: int, min_cut: int) -> list[int]:
    """The lengths documents are cut into: capacity // k, not under ``min_cut``, longest first."""
    return sorted({capacity // k for k in range(1, capacity // min_cut + 1)}, reverse=True)


def cuts(length: int, sizes: list[int]) -> list[int]:
    """The lengths of a document's pieces, in order."""
    out = [sizes[0]] * (length // sizes[0])
    rest = length % sizes[0]
    for s in sizes[1:]:
        while rest >= s:
            out.append(s)
            rest -= s
    return out + [rest] * (rest > 0)


PIECE = [
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()),
]
#: Sequence numbers: task and number in the task; then bins shared by tasks; then the last few.
SHARED, LAST = 1 << 61, 1 << 62


def first_fit(totals: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(length, number in its class, bin, offset) for under capacity // length pieces of each length."""
    fill: list[int] = []
    out = []
    for s in sorted(totals, reverse=True):
        at = 0
        for i in range(totals[s]):
            while at < len(fill) and fill[at] + s > capacity:
                at += 1
            if at == len(fill):
                fill.append(0)
            out.append((s, i, at, fill[at]))
            fill[at] += s
    return out


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    capacity: int = 1024,
    min_cut: int = 64,
    end_id: int = 0,
    with_ids: bool = True,
) -> DataFrame:
    """One row for each piece: the id and the columns of PIECE, and ``ids`` (binary, little-endian uint32) if asked."""
    path = tokenizer or public_tokenizers.path(DEFAULT_TOKENIZER)
    sizes = class_sizes(capacity, min_cut)
    source = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text"))
    extra = [T.StructField("ids", T.BinaryType())] if with_ids else []
    schema = T.StructType([source.schema["__id"], *PIECE, *extra, long("__task"), long("__rank")])

    def run(batches):
        out = to_arrow_schema(schema)
        names = [f.name for f in schema]
        encoder, task, end = text_encoder(path), TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        plans: dict[int, list[int]] = {}
        open_bins: dict[int, list[tuple]] = {}
        filled = 0

        def batch(rows):
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, out.field(n).type) for n, c in zip(names, columns)], schema=out)

        for part in slices(batches):
            rows = []
            for key, raw in zip(part.column("__id").to_pylist(), encoder.encode([t or "" for t in strings(part.column("__text"))])):
                raw += end
                total, start = len(raw) // 4, 0
                rest = total % capacity
                plan = plans.get(rest)
                if plan is None:
                    plan = plans[rest] = cuts(rest, sizes)
                for s in [capacity] * (total // capacity) + plan:
                    ids = raw[4 * start : 4 * (start + s)]
                    held = open_bins.setdefault(s, [])
                    held.append((key, start, s, zlib.crc32(ids), total, ids))
                    start += s
                    if len(held) == capacity // s:
                        for i, p in enumerate(held):
                            rows.append((*p[:5], task << 32 | filled, i * s, *p[5:][:with_ids], None, None))
                        filled += 1
                        held.clear()
            yield batch(rows)
        yield batch([(*p[:5], None, None, *p[5:][:with_ids], task, i) for held in open_bins.values() for i, p in enumerate(held)])

    pieces = cut_lineage(source.mapInArrow(run, schema))
    left = pieces.where(F.col("sequence_id").isNull())
    counts = left.groupBy("__task", "length").agg(F.count("*").alias("__n"))
    before = W.partitionBy("length").orderBy("__task")
    offsets = counts.select(
        "__task",
        "length",
        (F.sum("__n").over(before) - F.col("__n")).alias("__before"),
    )
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # under capacity rows
    last = first_fit({s: n % (capacity // s) for s, n in totals.items() if n % (capacity // s)}, capacity)
    spark = docs.sparkSession
    last_bins = F.broadcast(spark.createDataFrame(last, "length long, __i long, __bin long, __at long"))  # under capacity * 8 rows
    limits = F.broadcast(spark.createDataFrame([(s, n // (capacity // s) * (capacity // s)) for s, n in totals.items()], "length long, __full long"))
    k = (F.lit(capacity) / F.col("length")).cast("long")
    number = F.col("__before") + F.col("__rank")
    ranked = (
        left.drop("sequence_id", "offset")
        .join(offsets, ["__task", "length"])
        .join(limits, "length")
        .withColumn("__n", number)
        .withColumn("__i", F.when(F.col("__n") >= F.col("__full"), F.col("__n") - F.col("__full")))
        .join(last_bins, ["length", "__i"], "left")
        .withColumn(
            "sequence_id",
            F.when(F.col("__i").isNull(), F.lit(SHARED) + F.floor(F.col("__n") / k) * F.lit(capacity + 1) + F.col("length")).otherwise(F.lit(LAST) + F.col("__bin")),
        )
        .withColumn("offset", F.when(F.col("__i").isNull(), F.col("__n") % k * F.col("length")).otherwise(F.col("__at")))
    )
    columns = [F.col("__id").alias(id_col), *[f.name for f in PIECE], *[f.name for f in extra]]
    return pieces.where(F.col("sequence_id").isNotNull()).select(*columns).unionByName(ranked.select(*columns))


def sequences(packed: DataFrame, capacity: int = 1024, pad_id: int = 0) -> DataFrame:
    """The padded sequences of ``pack(..., with_ids=True)``: ``sequence_id``, ``n_tokens``, ``ids`` (binary).

    A sequence is padded to ``capacity`` unless its fill is a power of two. At most ``capacity`` pieces meet in a group.
    """
    joined = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    out = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("__p"))
    hexes = F.array_join(F.transform("__p", lambda p: F.hex(p["ids"])), "")
    pad = (F.lit(pad_id) * 1).cast("int")
    unit = F.concat(*[F.lpad(F.hex(F.shiftright(pad, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(4)])
    short = F.when(F.bit_count("n_tokens") == 1, 0).otherwise(F.lit(capacity) - F.col("n_tokens")).cast("int")
    return out.select("sequence_id", "n_tokens", F.unhex(F.concat(hexes, F.repeat(unit, short))).alias("ids"))
