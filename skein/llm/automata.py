"""Word-level substring dedup with suffix automata of reference shards.

A reference shard is a block of whole minimiser keys (see ``repeats``), so it holds every occurrence of each window
that belongs to it. The task that holds a shard builds the suffix automaton of its distinct word sequences, each
state carrying the smallest doc_id that reaches it, and streams the sequences through it: where the matching
statistic reaches the window length, the state tells the first document with that window. Automata are built where
the shard's rows are, in place of broadcasting each one to the whole corpus: broadcasting would cost shards x corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm import textnum as T
from skein.llm.common import texts
from skein.llm.repeats import Repeats, covered, join_ranges, packed, removed_ranges

WINDOW = 13
_NONE = (1 << 63) - 1


class SuffixAutomaton:
    """Suffix automaton of several sequences; ``least[s]`` is the smallest label among sequences through state s."""

    def __init__(self):
        self.step: list[dict] = [{}]
        self.link, self.size, self.least = [-1], [0], [_NONE]

    def _state(self, size, link, step):
        self.step.append(step)
        self.size.append(size)
        self.link.append(link)
        self.least.append(_NONE)
        return len(self.size) - 1

    def _split(self, p, word, q):
        """The state for the shorter strings of q, when p -word-> q is not a longest path."""
        if self.size[p] + 1 == self.size[q]:
            return q
        twin = self._state(self.size[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = twin
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = twin
            p = self.link[p]
        return twin

    def add(self, sequence, label: int) -> None:
        last = 0
        for word in sequence:
            q = self.step[last].get(word)
            if q is not None:
                last = self._split(last, word, q)
            else:
                new, p = self._state(self.size[last] + 1, 0, {}), last
                while p >= 0 and word not in self.step[p]:
                    self.step[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, word, self.step[p][word])
                last = new
            if label < self.least[last]:
                self.least[last] = label

    def close(self) -> None:
        """Carry the labels down the suffix links, longest states first."""
        for s in np.argsort(-np.array(self.size), kind="stable").tolist():
            up = self.link[s]
            if up >= 0 and self.least[s] < self.least[up]:
                self.least[up] = self.least[s]

    def first_labels(self, sequence, window: int) -> list[int]:
        """Smallest label holding each window of the sequence (its matching statistic capped at ``window``)."""
        state, size, out = 0, 0, []
        for word in sequence:
            while state and word not in self.step[state]:
                state = self.link[state]
                size = self.size[state]
            if word in self.step[state]:
                state = self.step[state][word]
                size += 1
            while self.size[self.link[state]] >= window if state else False:
                state = self.link[state]
                size = self.size[state]
            out.append(self.least[state] if size >= window else _NONE)
        return out[window - 1:]


def _engine(contents, docs, places):
    shard = SuffixAutomaton()
    names: dict[bytes, int] = {}
    sequences = [[names.setdefault(w, len(names)) for w in c.split(b" ")] for c in contents]
    for seq, doc in zip(sequences, docs.tolist(), strict=True):
        shard.add(seq, doc)
    shard.close()
    runs: list[tuple[int, int, int, int, int]] = []
    for n, seq in enumerate(sequences):
        for i, doc in enumerate(shard.first_labels(seq, WINDOW)):
            if i and runs[-1][3] == doc:
                runs[-1] = (n, runs[-1][1], i, doc, 0)
            else:
                runs.append((n, i, i, doc, 0))
    return tuple(np.array(runs, np.int64).reshape(-1, 5).T)


CONFIG = Repeats(unit="word", window=WINDOW, gram=4, within=False, block=60_000, engine=_engine)


def _strip(batches):
    for batch in batches:
        data, offs = T.unpack(batch.column("z"))
        copy, ranges = batch.column("copy"), batch.column("ranges")
        total, removed, kept = [], [], []
        for i, j in T.chunks(offs):
            d = data[offs[i]:offs[j]]
            s, e, r = T.words(d, offs[i:j + 1] - offs[i])
            own, raw = np.searchsorted(r, np.arange(j - i + 1)), d.tobytes()
            for k in range(j - i):
                a, b = own[k], own[k + 1]
                found, n = ranges[i + k].as_py(), int(b - a)
                words = [raw[x:y] for x, y in zip(s[a:b].tolist(), e[a:b].tolist(), strict=True)]
                if found or copy[i + k].as_py():
                    gone = covered(n, WINDOW, copy[i + k].as_py(), found)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                total.append(n)
                removed.append(n - len(words))
                kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): texts without words covered by a 13-word window of an earlier document.

    Null and empty texts have no words; texts under 13 words keep all. Rows with equal doc_id are one document in
    the order (not earlier than one another); repeated rows stay and get equal results. Rows with a null doc_id
    keep everything. An empty table gives an empty result.
    """
    rows = texts(docs, id_col, text_col)
    bodies = packed(rows)
    return join_ranges(bodies, removed_ranges(rows, bodies, CONFIG)).mapInArrow(_strip, "doc_id long, n_words long, n_removed long, kept string")
