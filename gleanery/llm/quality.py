"""Document rules and host verdicts: failures by host, rates shrunk by an empirical beta prior.

Each document is measured (see ``FEATURES``) and held against rules: the base rule, hard and soft ones.
Failures are counted by host; for each rule, and for documents that fail the base or a hard rule, the hosts' rates give
a beta prior by the method of moments, and a host's rate is shrunk to ``(failures + m * s) / (documents + s)``
with the prior's mean ``m`` and strength ``s``. The last of these rates, less two standard deviations of its
beta posterior (so a few documents condemn no host), gives the odds that a document of the host is bad. The
odds are joined back to the documents, and each hard rule that a document fails multiplies them by
``hard_weight``, each soft one by ``soft_weight``: it is kept if it passes the base rule and its odds come to 1 at most.

So the host decides in every case but the base rule: all go from a host whose documents fail more often than
not (``rejected``), one soft failure is enough where the odds are over a third (``suspect``), two are in the middle, and where
the odds are under 1 in 64 even a hard failure is forgiven (``trusted``).

Words are runs of characters other than space and U+0009 to U+000D.

Defined cases: null text counts as empty (no words, so the base rule fails); a null host and the host
'' are one; repeated rows count each; an empty table gives an empty result; input columns that bear the
name of a result give way to it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import long, text_map
from gleanery.session import cut_lineage, join_small

#: Fixed values of the digest: white space, symbols.
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of five words that occurs at least twice; windows are compared exactly."""
    n = len(words)
    if n <= size:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return 0
    window, width = ids, 1
    while width < size:  # double the width, at last by less, numbering the windows anew each time
        step = min(width, size - width)
        pairs = window[:-step] * (int(window.max()) + 1) + window[step:]
        found, window = np.unique(pairs, return_inverse=True)
        if len(found) == len(window):
            return 0
        width += step
    again = np.bincount(window)[window] > 1
    cover = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + size, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def measure(texts: list[str | None]) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in FEATURES}
    for t in texts:
        t = t or ""
        words = t.encode().split()
        lines = [x for x in t.split("\n") if x.strip(SPACES)]
        out["n_words"].append(len(words))
        out["word_chars"].append(len(t) - sum(map(t.count, SPACES)))
        out["n_symbols"].append(sum(map(t.count, SYMBOLS)))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        out["n_repeat_words"].append(repeated_words(words))
        out["n_lines"].append(len(lines))
    return out


def rules() -> dict[str, tuple[str, Column]]:
    """Rule: how it acts (base, hard, soft) and the failure as a column."""
    c = F.col
    return {
        "base": ("base", (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words"))),
        "symbols": ("hard", 10 * c("n_symbols") > c("n_words")),
        "word_length": ("hard", (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 20 * c("n_words"))),
        "dup_lines": ("soft", 10 * c("n_dup_lines") > 3 * c("n_lines")),
        "some_repeats": ("soft", 100 * c("n_repeat_words") > 10 * c("n_words")),
        "some_symbols": ("soft", 30 * c("n_symbols") > c("n_words")),
    }


def host_verdicts(measured: DataFrame, host_col: str, hard_weight: float = 64.0, soft_weight: float = 3.0) -> DataFrame:
    """One row for each host: documents, failures and shrunk rate of each rule and of ``any``, odds and verdict."""
    failed = {k: f for k, (_, f) in rules().items()}
    failed["any"] = F.greatest(*[f for kind, f in rules().values() if kind != "soft"])
    hosts = measured.groupBy(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("__host")).agg(
        F.count("*").alias("n_docs"), *[F.sum(f.cast("long")).alias(f"failed_{k}") for k, f in failed.items()]
    )
    hosts = cut_lineage(hosts)
    rates = {k: F.col(f"failed_{k}") / F.col("n_docs") for k in failed}
    prior = hosts.agg(*[x for k, r in rates.items() for x in (F.avg(r).alias(f"m_{k}"), F.var_pop(r).alias(f"v_{k}"))]).first()
    shrunk, strength = {}, {}
    for k in failed:
        m, v = prior[f"m_{k}"] or 0.0, prior[f"v_{k}"] or 0.0
        s = strength[k] = min(max(m * (1 - m) / v - 1, 1.0), 10_000.0) if v > 0 else 10_000.0
        shrunk[k] = (F.col(f"failed_{k}") + m * s) / (F.col("n_docs") + s)
    out = hosts.select("*", *[r.alias(f"rate_{k}") for k, r in shrunk.items()])
    rate = F.col("rate_any")
    low = F.greatest(rate - 2 * F.sqrt(rate * (1 - rate) / (F.col("n_docs") + strength["any"] + 1)), F.lit(0.0))
    odds = F.when(low < 1, low / (1 - low)).otherwise(F.lit(float("inf")))
    verdict = F.when(odds > 1, "rejected").when(odds * soft_weight > 1, "suspect").when(odds * hard_weight <= 1, "trusted").otherwise("usual")
    return out.select("*", odds.alias("host_odds"), verdict.alias("verdict"))


def apply_verdicts(measured: DataFrame, verdicts: DataFrame, host_col: str, hard_weight: float = 64.0, soft_weight: float = 3.0) -> DataFrame:
    """The measured rows with ``base_failed`` and ``kept``."""
    failed = rules()
    names = [c for c in measured.columns if c not in ("base_failed", "kept")]
    rows = measured.select(*names, F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("__host"))
    joined = join_small(rows, verdicts.select("__host", F.col("host_odds").alias("__odds")), "__host")
    odds = F.col("__odds")
    for kind, f in failed.values():
        if kind != "base":
            odds = odds * F.when(f, hard_weight if kind == "hard" else soft_weight).otherwise(1.0)
    base = failed["base"][1]
    return joined.select(*names, base.alias("base_failed"), (~base & (odds <= 1)).alias("kept"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """One row for each document: the id, the features, ``base_failed`` and ``kept``."""
    source = docs.select(docs[id_col].alias("__id"), docs[host_col].alias("__source"), docs[text_col].alias("__body"))
    new = T.StructType([long(k) for k in FEATURES])
    measured = cut_lineage(text_map(source, "__body", lambda: measure, new, ["__id", "__source"]))
    out = apply_verdicts(measured, host_verdicts(measured, "__source", **limits), "__source", **limits)
    return out.select(F.col("__id").alias(id_col), *FEATURES, "base_failed", "kept")


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The rows that are kept, with the columns they came with."""
    names = docs.columns
    source = docs.select(*[docs[c].alias(f"in_{i}") for i, c in enumerate(names)])
    body, host = (f"in_{names.index(c)}" for c in (text_col, host_col))
    measured = cut_lineage(text_map(source, body, lambda: measure, T.StructType([long(k) for k in FEATURES])))
    out = apply_verdicts(measured, host_verdicts(measured, host, **limits), host, **limits)
    return out.where("kept").select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(names)])
