"""Token counts of a unigram vocabulary without building the tokens.

An Aho-Corasick automaton over the bytes of the pieces, compiled to one dense transition table,
enumerates every piece that ends at each byte; dynamic programming carries the best score and
its number of pieces. It runs over many words at once, a byte position at a time.

Ties follow the tokenizer: a path is replaced only by a strictly better one, and of paths that
end at the same byte the one whose last piece begins earlier comes first. An unknown character
is taken only where no piece spells it alone, lies ``UNKNOWN_PENALTY`` below the worst piece,
and counts as its bytes under byte fallback or, with its unknown neighbours, as one piece.
Scores are double precision, as in the ``tokenizers`` library.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shardwright.llm.common import lean, prepare_workers, table, text_of
from shardwright.llm.hf_backend import DEFAULT_MODEL, normalizer
from shardwright.llm.spm_model import BLANK, NORMAL, UNKNOWN_PENALTY, SpmModel, load, parse

#: Words whose counts a worker remembers.
REMEMBERED = 300_000
#: Cells (words times bytes) of the tables of one run.
CELLS = 1 << 20


class Automaton:
    def __init__(self, model: SpmModel) -> None:
        self.model = model
        self.unknown = model.lowest - UNKNOWN_PENALTY
        children: list[dict[int, int]] = [{}]
        ends = {}
        for piece, score, kind in model.pieces:
            if kind != NORMAL:
                continue
            node = 0
            for byte in piece.encode():
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                node = children[node][byte]
            ends.setdefault(node, (len(piece.encode()), score, len(piece) == 1))
        n = len(children)
        self.step = np.zeros((n, 256), np.int32)
        self.length, self.score = np.zeros(n, np.int32), np.zeros(n)
        self.single = np.zeros(n, bool)
        for node, (length, score, single) in ends.items():
            self.length[node], self.score[node], self.single[node] = length, score, single
        #: The longest piece that ends in a state, and after it the next shorter one; 0 ends the chain.
        self.first, self.shorter = np.zeros(n, np.int32), np.zeros(n, np.int32)
        fail = np.zeros(n, np.int32)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            if node:
                self.shorter[node] = self.first[fail[node]]
                self.first[node] = node if self.length[node] else self.shorter[node]
                self.step[node] = self.step[fail[node]]
            for byte, child in children[node].items():
                fail[child] = self.step[node, byte] if node else 0
                self.step[node, byte] = child
                queue.append(child)
        self.normalizer = normalizer(model)
        self.word = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+") if model.splits_at_blanks else re.compile("(?s).+")
        self.known: dict[str, tuple[int, float]] = {}

    def solve(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of pieces and score of the best path through each word."""
        data = [w.encode("utf-8", "replace") for w in words]
        sizes = np.array([len(b) for b in data])
        order = np.argsort(-sizes, kind="stable")
        counts, scores = np.zeros(len(words), np.int64), np.zeros(len(words))
        begin = 0
        while begin < len(order):
            end = min(len(order), begin + max(1, CELLS // (int(sizes[order[begin]]) + 1)))
            own = order[begin:end]
            counts[own], scores[own] = self._run([data[i] for i in own], sizes[own])
            begin = end
        return counts, scores

    def _run(self, data: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words come longest first, so those still active are always the first ones."""
        n, width = len(data), int(sizes[0])
        text = np.zeros((width + 1, n), np.uint8)  # by position, so that a step reads one row
        filled = np.arange(width)[None, :] < sizes[:, None]
        grid = np.zeros((n, width), np.uint8)
        grid[filled] = np.frombuffer(b"".join(data), np.uint8)
        text[:width] = grid.T
        best = np.full((width + 1, n), -np.inf)
        count = np.zeros((width + 1, n), np.int32)
        run = np.zeros((width + 1, n), bool)  # the best path ends in an unknown character
        best[0] = 0.0
        state = np.zeros(n, np.int32)
        char_start = np.zeros(n, np.int64)
        active = np.searchsorted(-sizes, -np.arange(width), side="left")
        for at in range(width):
            k = int(active[at])
            byte = text[at, :k]
            char_start[:k] = np.where((byte & 0xC0) != 0x80, at, char_start[:k])
            state[:k] = self.step[state[:k], byte]
            row_best, row_count, row_run = best[at + 1], count[at + 1], run[at + 1]
            single = np.zeros(k, bool)
            piece = self.first[state[:k]]
            live = np.flatnonzero(piece)
            piece = piece[live]
            while len(live):
                from_ = at + 1 - self.length[piece]
                score = best[from_, live] + self.score[piece]
                single[live] |= self.single[piece]
                better = score > row_best[live]
                won = live[better]
                row_best[won] = score[better]
                row_count[won] = count[from_[better], won] + 1
                piece = self.shorter[piece]
                more = piece > 0
                live, piece = live[more], piece[more]
            whole = (text[at + 1, :k] & 0xC0) != 0x80  # the character ends here
            lost = np.flatnonzero(whole & ~single)
            if len(lost):
                from_ = char_start[lost]
                score = best[from_, lost] + self.unknown
                better = score > row_best[lost]
                won, from_ = lost[better], from_[better]
                row_best[won] = score[better]
                if self.model.byte_fallback:
                    row_count[won] = count[from_, won] + (at + 1 - from_)
                else:
                    row_count[won] = count[from_, won] + ~run[from_, won]
                    row_run[won] = True
        at = (sizes, np.arange(n))
        return count[at], best[at]

    def count(self, texts: list[str]) -> list[tuple[int, float]]:
        """Pieces and score of each text; words met before are looked up."""
        split = [self.word.findall(self.normalizer.normalize_str(t)) if t else [] for t in texts]
        missing = list({w for words in split for w in words} - self.known.keys())
        if len(self.known) + len(missing) > REMEMBERED:
            self.known.clear()
            missing = list({w for words in split for w in words})
        counts, scores = self.solve(missing)
        self.known.update(zip(missing, zip(counts.tolist(), scores.tolist(), strict=True), strict=True))
        out = []
        for words in split:
            found = [self.known[w] for w in words]
            out.append((sum(f[0] for f in found), float(sum(f[1] for f in found))))
        return out


@lru_cache(1)
def automaton_of(data: bytes) -> Automaton:
    return Automaton(parse(data))


def count_tokens(docs: DataFrame, model: bytes) -> DataFrame:
    """``doc_id, n_chars, n_tokens, score`` of every whole text under the unigram reading of ``model``.

    Texts are normalised as the model says and cut where a run of blanks begins, which no piece
    crosses, so the best path of a text is the best paths of its words end to end; a model whose
    pieces do cross blanks is worked off text by text. A null text is empty and has no tokens.
    Rows that repeat are counted each. An empty table gives an empty result; other columns are
    ignored.
    """
    prepare_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = automaton.count(texts)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0).cast(pa.int64()),
                    "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                    "n_tokens": pa.array([n for n, _ in found], pa.int64()),
                    "score": pa.array([s for _, s in found], pa.float64()),
                }
            )

    schema = "doc_id long, n_chars long, n_tokens long, score double"
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(lean(work), schema)


def op4_token_counts(spark, sf_dir: str, model_path: str = DEFAULT_MODEL) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), load(model_path))
