"""SentencePiece encoding and decoding for merge-type vocabularies: a score-ordered agenda of adjacent pairs.

The agenda holds every adjacent pair of symbols whose concatenation is a piece, best score first, the
leftmost of equals; popping one merges it and adds the pairs with its new neighbours. A text is first cut
where no piece of the vocabulary holds the two characters that meet, since no merge can cross such a
place; what lies between is encoded once and remembered, in a memory of bounded size. New words of every
Arrow batch are checked against the sentencepiece library, and so are whole texts with runs of spaces;
where the two differ the library's ids are taken, and ``from_library`` says so.

Defined cases: null text counts as empty (begin and end ids only); repeated rows are encoded each; an
empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gleanery.llm.common import boolean, long, string, text_map
from gleanery.llm.token_counts import DEFAULT_MODEL, load_pieces

SPACE = "▁"
#: Words and parts of words remembered in a task, and the longest that are.
MEMORY, LONGEST = 900_000, 48


class Agenda:
    def __init__(self, path: str):
        self.sp, self.glued = load_pieces(path)
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte = [0] * 256
        for i in range(self.sp.get_piece_size()):
            piece = self.sp.id_to_piece(i)
            if self.sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (self.sp.is_control(i) or self.sp.is_unknown(i)):
                self.ids[piece] = i
                self.rank[piece] = -self.sp.get_score(i)
        self.bos, self.eos = self.sp.bos_id(), self.sp.eos_id()
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.fresh: list[tuple[str, bytes]] = []
        self.settled: dict[str, bytes] = {}  # words whose ids are the library's because the agenda's differed
        self.once: list[tuple[str, bytes]] = []  # words too long to remember, until they are checked

    def merge(self, part: str) -> list[str]:
        """The pieces of a stretch of text by the agenda."""
        symbols: list[str | None] = list(part)
        n, rank = len(symbols), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in rank:
                agenda.append((rank[pair], i, i + 1, pair))
        heapify(agenda)
        while agenda:
            _, i, j, pair = heappop(agenda)
            if symbols[i] is None or symbols[j] is None or after[i] != j or len(symbols[i]) + len(symbols[j]) != len(pair):
                continue  # one of the two was merged meanwhile
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                longer = pair + symbols[k]
                if longer in rank:
                    heappush(agenda, (rank[longer], i, k, longer))
            h = before[i]
            if h >= 0:
                longer = symbols[h] + pair
                if longer in rank:
                    heappush(agenda, (rank[longer], h, i, longer))
        return [s for s in symbols if s is not None]

    def encode_part(self, part: str) -> bytes:
        out = self.parts.get(part)
        if out is None:
            ids: list[int] = []
            for piece in self.merge(part):
                if piece in self.ids:
                    ids.append(self.ids[piece])
                else:
                    ids += [self.byte[b] for b in piece.encode()]
            out = np.array(ids, "<u4").tobytes()
            if len(part) <= LONGEST:
                if len(self.parts) >= MEMORY:
                    self.parts.clear()
                self.parts[part] = out
        return out

    def encode_word(self, word: str) -> bytes:
        """Ids of a stretch that begins with the space mark, cut where no merge can cross."""
        cuts = [i for i in range(1, len(word)) if (word[i - 1], word[i]) not in self.glued]
        if not cuts:
            out = self.encode_part(word)
        else:
            out = b"".join(self.encode_part(word[a:b]) for a, b in zip([0, *cuts], [*cuts, len(word)]))
        return out

    def __missing(self, word: str) -> bytes:
        out = self.settled.get(word) or self.encode_word(SPACE + word)
        if len(word) <= LONGEST:
            if len(self.words) >= MEMORY:
                self.words.clear()
            self.words[word] = out
            self.fresh.append((word, out))
        else:
            self.once.append((word, out))
        return out

    def check(self) -> int:
        """Hold the words that were new since the last call, and all longer ones since then, against the library; the
        number that differed, which from now on have the library's ids."""
        held, wrong = self.fresh + self.once, 0
        for (word, out), ids in zip(held, self.sp.encode([w for w, _ in held], num_threads=1) if held else []):
            right = np.array(ids, "<u4").tobytes()
            if right != out:
                wrong += 1
                self.settled[word] = right
                self.words.pop(word, None)
        self.fresh.clear()
        self.once.clear()
        return wrong

    def encode(self, text: str) -> tuple[bytes, bool]:
        """Ids of a text as little-endian unsigned 32-bit integers, without begin and end; are some the library's?"""
        if not text:
            return b"", False
        words = text.split(" ")
        if "" in words or SPACE in text:  # runs of spaces are pieces of their own
            out = b"".join(self.encode_word(w) for w in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE)))
            right = np.array(self.sp.encode(text), "<u4").tobytes()
            return right, right != out
        get, out = self.words.get, []
        for w in words:
            ids = get(w)
            out.append(self.__missing(w) if ids is None else ids)
        return b"".join(out), bool(self.settled) and not self.settled.keys().isdisjoint(words)

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """As ``encode``, checked."""
        out = [self.encode(t) for t in texts]
        return [self.encode(t) for t in texts] if self.check() else out


def encode_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: str | None = None,
    with_ids: bool = True,
    with_text: bool = True,
) -> DataFrame:
    """The id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, ``from_library``, and if asked ``ids`` and the ``decoded`` text."""
    path = model or public_tokenizers.path(DEFAULT_MODEL)
    new = [long("n_tokens"), string("ids_sha256"), string("decoded_sha256"), boolean("from_library")]
    new += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids + [string("decoded")] * with_text

    def make():
        agenda = Agenda(path)
        bos, eos = np.array([agenda.bos], "<u4").tobytes(), np.array([agenda.eos], "<u4").tobytes()

        def run(texts):
            out = {f.name: [] for f in new}
            for body, settled in agenda.encode_all([t or "" for t in texts]):
                raw = bos + body + eos
                ids = np.frombuffer(raw, "<u4").tolist()
                decoded = agenda.sp.decode(ids)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(raw).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                out["from_library"].append(settled)
                if with_ids:
                    out["ids"].append(ids)
                if with_text:
                    out["decoded"].append(decoded)
            return out

        return run

    return text_map(docs, text_col, make, T.StructType(new), [id_col])
