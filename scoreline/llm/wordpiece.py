"""Token counts by greedy longest match in linear time, without building pieces.

The vocabulary is a trie over bytes.  Each trie node has a failure link: the node reached
when the piece matched so far is cut off greedily and matching goes on with the rest, and
the number of pieces that this cuts off (popped tokens), both computed once.  A word walks
the trie; where it cannot go on it follows failure links and adds their counts, so every
byte costs a constant number of steps and no piece is ever materialised.  Words of a block
walk side by side (one array step per byte position), and each distinct word of a block
walks once; the last few (unbroken runs of bytes may be very long) walk alone.

A word that no sequence of pieces covers counts as one unknown token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreline.llm import words as wd

SPACE = 0x20
DEAD = -1
FEW = 64       # words that are cheaper to walk one by one than side by side


class LongestMatch:
    """Trie with failure links and popped-token counts.

    ``first`` are the pieces that may begin a word and ``later`` those that may follow."""

    def __init__(self, first: list[bytes], later: list[bytes]):
        edges: dict[int, int] = {}          # node * 256 + byte -> node
        self.n = 2                          # node 0: word begin, node 1: inside a word
        token = {}
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                s = root
                for b in piece:
                    k = s * 256 + b
                    if k not in edges:
                        edges[k] = self.n
                        self.n += 1
                    s = edges[k]
                if piece:
                    token[s] = True
        self.fail = np.full(self.n, DEAD, dtype=np.int64)
        self.pops = np.zeros(self.n, dtype=np.int64)
        kids: list[list[tuple[int, int]]] = [[] for _ in range(self.n)]
        for k, v in edges.items():
            kids[k >> 8].append((k & 255, v))
        fail, pops = self.fail, self.pops
        level = [0, 1]
        while level:                        # breadth first: links of shorter nodes are known
            deeper = []
            for u in level:
                for b, v in kids[u]:
                    deeper.append(v)
                    if v in token:
                        fail[v], pops[v] = 1, 1
                        continue
                    z, n = fail[u], pops[u]
                    while z != DEAD and int(z) * 256 + b not in edges:
                        n += pops[z]
                        z = fail[z]
                    if z != DEAD:
                        fail[v], pops[v] = edges[int(z) * 256 + b], n
            level = deeper
        self.edges, self.links, self.cuts = edges, fail.tolist(), pops.tolist()
        self.keys = np.array(sorted(edges), dtype=np.int64)
        self.to = np.array([edges[k] for k in self.keys.tolist()], dtype=np.int64)
        # edges of a node are neighbours in ``keys``: base gives its first one, rank its bytes
        size = 1 << int(np.ceil(np.log2(max(2, len(self.keys) * 2))))
        self.mask = size - 1
        self.slot = np.full(size, -1, dtype=np.int64)
        self._fill()

    def _home(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(32)).astype(np.int64) & self.mask

    def _fill(self) -> None:
        """Open addressing: edges that find their place taken move on by one."""
        todo, at = np.arange(len(self.keys)), self._home(self.keys)
        while len(todo):
            free = self.slot[at] < 0
            where, who = at[free], todo[free]
            self.slot[where[::-1]] = who[::-1]
            lost = self.slot[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & self.mask

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Next node of each walk by its byte, or DEAD."""
        keys = state * 256 + byte
        out = np.full(len(keys), DEAD, dtype=np.int64)
        at, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            e = self.slot[at]
            some = e >= 0
            hit = some & (self.keys[e] == keys[todo])
            out[todo[hit]] = self.to[e[hit]]
            on = some & ~hit
            todo, at = todo[on], (at[on] + 1) & self.mask
        return out

    def count(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray,
              lead: int | None) -> np.ndarray:
        """Tokens of each byte range (with the byte ``lead`` in front of it, if given)."""
        n = len(starts)
        total = np.zeros(n, dtype=np.int64)
        unknown = np.zeros(n, dtype=bool)
        state = np.zeros(n, dtype=np.int64)
        live = np.arange(n)
        if lead is not None:
            live = self._advance(live, np.full(n, lead, dtype=np.int64), state, total, unknown)
        k = 0
        while len(live) > FEW:
            live = live[starts[live] + k < ends[live]]
            live = self._advance(live, buf[starts[live] + k].astype(np.int64), state, total,
                                 unknown)
            k += 1
        for i in live.tolist():
            state[i], total[i], unknown[i] = self._alone(
                int(state[i]), int(total[i]), buf[starts[i] + k:ends[i]].tobytes())
        # end of the word: cut off everything that is still held
        hold = np.flatnonzero(~unknown & (state > 1))
        while len(hold):
            total[hold] += self.pops[state[hold]]
            state[hold] = self.fail[state[hold]]
            unknown[hold[state[hold] == DEAD]] = True
            hold = hold[state[hold] > 1]
        total[unknown] = 1
        return total

    def _alone(self, state: int, total: int, rest: bytes) -> tuple[int, int, bool]:
        """The walk of one word over its ``rest``: (node, tokens, whether it is unknown)."""
        edges, links, cuts = self.edges, self.links, self.cuts
        for b in rest:
            new = edges.get(state * 256 + b)
            while new is None:
                total += cuts[state]
                state = links[state]
                if state == DEAD:
                    return 0, total, True
                new = edges.get(state * 256 + b)
            state = new
        return state, total, False

    def _advance(self, live: np.ndarray, byte: np.ndarray, state: np.ndarray,
                 total: np.ndarray, unknown: np.ndarray) -> np.ndarray:
        todo, b = live, byte
        while len(todo):
            new = self.step(state[todo], b)
            ok = new != DEAD
            state[todo[ok]] = new[ok]
            todo, b = todo[~ok], b[~ok]
            total[todo] += self.pops[state[todo]]
            state[todo] = self.fail[state[todo]]
            dead = state[todo] == DEAD
            unknown[todo[dead]] = True
            todo, b = todo[~dead], b[~dead]
        return live[~unknown[live]]


def byte_level_pieces(vocab: dict[str, int]) -> list[bytes]:
    """Byte strings of a byte-level vocabulary (printable stand-ins for bytes undone)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    back |= {chr(256 + i): b for i, b in enumerate(rest)}
    return [bytes(back[c] for c in piece) for piece in vocab if all(c in back for c in piece)]


def load(path: str) -> LongestMatch:
    """Automaton of a tokenizer file with a byte-level vocabulary: pieces with a leading
    space begin words, pieces without white space follow."""
    from tokenizers import Tokenizer
    pieces = byte_level_pieces(Tokenizer.from_file(path).get_vocab(with_added_tokens=False))
    first = [p for p in pieces if p[:1] == b" " and not any(not wd.PLAIN[c] for c in p[1:])]
    later = [p for p in pieces if not any(not wd.PLAIN[c] for c in p)]
    return LongestMatch(first, later)


_LOADED: dict[str, LongestMatch] = {}


def automaton(path: str) -> LongestMatch:
    if path not in _LOADED:
        _LOADED[path] = load(path)
    return _LOADED[path]


SCHEMA = "doc_id long, n_words long, n_tokens long"


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Words and greedy longest-match tokens of every row's whole text.

    A word is a run of characters other than space and 0x09-0x0D, and is matched as a
    space and the word.  Null and empty texts have none.  One row per input row, repeated
    rows included; a null id stays null; an empty table gives an empty result; other
    columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = automaton(tokenizer_path)
        for batch in batches:
            for part, buf, offs in wd.blocks(batch):
                w = wd.Words(buf, offs)
                _, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
                per = match.count(buf, w.starts[first], w.ends[first], SPACE)[back]
                total = np.append(0, np.cumsum(per))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(w.counts, pa.int64()),
                     pa.array(np.diff(total[w.first]), pa.int64())],
                    names=["doc_id", "n_words", "n_tokens"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, SCHEMA)
