"""Token counts by a finite-state transducer compiled from a BPE vocabulary.

The vocabulary's pieces never hold a word mark (U+2581) after another character, so a text falls into segments
that start at word marks. Inside a segment the greedy merge encoding of each prefix ends with one token that is
compatible with the encoding before it; a state therefore needs only the longest suffix that can still grow into
a piece, with the last token at each of its places and the token counts relative to its end. These states are
finite; transitions are compiled on first use, each annotated with the number of tokens it adds (it can be
negative where a merge undoes others), and kept for the next texts.

A chunk of text acts on the state as a map: what stands before its first segment border depends on the state that
comes in, the rest does not. Such a map is (head, count, tail), maps compose associatively, and a long text's count
is the composition of its chunks' maps, found in parallel and folded in order.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import textnum as T
from skein.llm.common import small_batches, texts, tokenizer_path

MARK = "▁"
#: Texts above so many characters are counted as several chunks, by several tasks.
CHUNK = 1 << 16
#: Transitions and whole segments kept by a worker before that table starts anew.
KEPT_MOVES, KEPT_SEGMENTS = 800_000, 200_000


class CountTransducer:
    """Counts tokens of merge-by-score encodings. scores: piece -> score of every mergeable piece."""

    def __init__(self, scores: dict[str, float]):
        if any(MARK in p.lstrip(MARK) for p in scores):
            raise ValueError("a piece holds a word mark inside")
        self.scores = scores
        self.open = {p[:i] for p in scores for i in range(1, len(p) + 1)}
        self.longest = max(map(len, scores))
        self._clear()

    def _clear(self):
        # a state: (suffix, last token at each place from before the suffix to its end, counts relative to the end)
        self.states: list[tuple] = [("", ("",), (0,))]
        self.numbers: dict[tuple, int] = {self.states[0]: 0}
        self.moves: dict[tuple[int, str], tuple[int, int]] = {}
        self.known: dict[str, int] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """Greedy encoding: the best-scored mergeable neighbours first, the leftmost of equals (short texts)."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _follows(self, before: str, token: str) -> bool:
        """Whether the two tokens stay as they are next to one another ('' before: at a border)."""
        got = self.pairs.get((before, token))
        if got is None:
            got = self.pairs[before, token] = self.merge(before + token) == ([before, token] if before else [token])
        return got

    def _move(self, state: int, char: str) -> tuple[int, int]:
        suffix, last, rel = self.states[state]
        if char not in self.scores:  # falls back to bytes and touches nothing
            out = (0, len(char.encode()))
        else:
            grown = suffix + char
            for k in range(len(grown)):
                token = grown[k:]
                if (token in self.scores or len(token) == 1) and self._follows(last[k], token):
                    break
            added = 1 + rel[k]
            lasts, counts = (*last, token), (*(c - added for c in rel), 0)
            cut = 0
            while cut < len(grown) and grown[cut:] not in self.open:
                cut += 1
            new = (grown[cut:], lasts[cut:], counts[cut:])
            number = self.numbers.setdefault(new, len(self.states))
            if number == len(self.states):
                self.states.append(new)
            out = (number, added)
        self.moves[state, char] = out
        return out

    def segment(self, text: str) -> int:
        """Tokens of a segment: word marks and then other characters."""
        got = self.known.get(text)
        if got is not None:
            return got
        if text.startswith(MARK * 2):  # pieces of several marks share one score: encode the run as it is
            run = len(text) - len(text.lstrip(MARK))
            got = self._marks(run, text[run:])
        else:
            state, got, moves = 0, 0, self.moves
            for char in text:
                state, more = moves.get((state, char)) or self._move(state, char)
                got += more
        if len(self.known) >= KEPT_SEGMENTS:
            self.known.clear()
            if len(self.moves) >= KEPT_MOVES:
                self._clear()
        self.known[text] = got
        return got

    def _marks(self, run: int, rest: str) -> int:
        """The word takes one mark if its encoding starts with one; the other marks merge from the left."""
        whole = self.segment(MARK + rest)
        joined = rest and rest[0] in self.scores and self.merge(MARK + rest[:2 * self.longest])[0] != MARK
        lone = run - 1 if joined else run
        marks = self._run(lone)
        return marks + (whole if joined else whole - 1)

    @lru_cache(maxsize=4096)
    def _run(self, n: int) -> int:
        left = n % (64 * self.longest)  # long runs repeat with the longest piece
        left = left if n < 128 * self.longest else left + 64 * self.longest
        return len(self.merge(MARK * left)) + (n - left) // self._longest_run()

    def _longest_run(self) -> int:
        return max(len(p) for p in self.scores if not p.strip(MARK))

    def text(self, text: str) -> int:
        """Tokens of a whole text; a word mark is put before it, as the library does."""
        if not text:
            return 0
        whole = MARK + text.replace(" ", MARK)
        return sum(map(self.segment, _MARKED.findall(whole)))


_MARKED = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def summary(machine: CountTransducer, chunk: str) -> tuple[str, int | None, str]:
    """State map of a chunk (word marks in place of blanks): head, tokens of the whole segments inside, tail."""
    parts = _MARKED.findall(chunk)
    if len(parts) < 2 + (not chunk.startswith(MARK)):
        return chunk, None, ""
    # the first part may continue a run of marks or a word, the last may be continued
    return parts[0], sum(map(machine.segment, parts[1:-1])), parts[-1]


def compose(machine: CountTransducer, a, b):
    """The map of chunk a and then chunk b."""
    if a[1] is None and b[1] is None:
        return summary(machine, a[0] + b[0])
    if a[1] is None:
        h, m, t = summary(machine, a[0] + b[0])
        return (h + t, b[1], b[2]) if m is None else (h, m + machine.segment(t) + b[1], b[2])
    h, m, t = summary(machine, a[2] + b[0])
    if b[1] is None:
        return (a[0], a[1], h) if m is None else (a[0], a[1] + machine.segment(h) + m, t)
    return (a[0], a[1] + (machine.segment(h) if m is None else machine.segment(h) + m + machine.segment(t)) + b[1], b[2])


def close(machine: CountTransducer, m) -> int:
    """Tokens of a whole text from its map."""
    return machine.segment(m[0]) + (m[1] + machine.segment(m[2]) if m[1] is not None else 0) if m[0] else 0


@lru_cache(maxsize=2)
def machine(path: str) -> CountTransducer:
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    return CountTransducer({sp.id_to_piece(i): sp.get_score(i) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))})


def _counts(path: str):
    def run(batches):
        m = machine(path)
        for batch in batches:
            col = batch.column("text")
            _, offs = T.buffers(col)
            n = [m.text(x) if len(x) <= CHUNK else None for x in col.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array(np.diff(offs)), pa.array(n, pa.int64())], ["rid", "doc_id", "n_bytes", "n_tokens"])
    return run


def _cut_long(batches):
    for batch in batches:
        for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), strict=True):
            whole = MARK + text.replace(" ", MARK)
            for no, i in enumerate(range(0, len(whole), CHUNK)):
                yield pa.RecordBatch.from_arrays([pa.array([rid]), pa.array([no]), pa.array([whole[i:i + CHUNK]])], ["rid", "no", "chunk"])


def _maps(path: str):
    def run(batches):
        m = machine(path)
        for batch in batches:
            maps = [summary(m, c) for c in batch.column("chunk").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("no"), *(pa.array([x[k] for x in maps], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string())))], ["rid", "no", "head", "inner", "tail"])
    return run


def _fold(path: str):
    def run(batches):
        m = machine(path)
        for batch in batches:
            out = []
            for maps in batch.column("maps").to_pylist():
                todo = [(x["head"], x["inner"], x["tail"]) for x in maps]
                while len(todo) > 1:  # a tree of compositions, in order
                    todo = [compose(m, *todo[i:i + 2]) if i + 1 < len(todo) else todo[i] for i in range(0, len(todo), 2)]
                out.append(close(m, todo[0]))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(out, pa.int64())], ["rid", "long_tokens"])
    return run


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row; null and empty texts have none; repeated rows get equal results."""
    small_batches(docs.sparkSession)
    path = tokenizer_path(model)
    rows = texts(docs, id_col, text_col)
    short = rows.mapInArrow(_counts(path), "rid long, doc_id long, n_bytes long, n_tokens long")
    chunks = rows.where(F.length("text") > CHUNK).select("rid", "text").mapInArrow(_cut_long, "rid long, no long, chunk string").repartition("rid", "no").dropDuplicates(["rid", "no"])
    maps = chunks.mapInArrow(_maps(path), "rid long, no long, head string, inner long, tail string")
    each = maps.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("no", "head", "inner", "tail"))).alias("maps"))
    long = each.mapInArrow(_fold(path), "rid long, long_tokens long")
    return short.join(long, "rid", "left").select("doc_id", "n_bytes", F.coalesce("n_tokens", "long_tokens").alias("n_tokens"))
