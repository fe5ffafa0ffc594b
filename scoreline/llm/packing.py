"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A document's tokens (plus an end token) are cut into pieces of at most ``capacity``.
Piece lengths fall into reciprocal-capacity classes: class k holds the lengths in
(capacity/(k+1), capacity/k], and each of its sequences takes exactly k pieces.  A piece
much shorter than capacity/k would leave padding in every sequence of its class, so a
remainder is left whole only if k of them fill a sequence up to ``slack``; otherwise a
head of the next power of two is cut off (class capacity/2^j, which fills its sequences
exactly) and the rest is classified again.  Every task packs its own documents class by
class, without any exchange between workers; what a class has left over at the end of a
task is cut down to powers of two, and their sequences end at powers of two, so nothing
but the slack is ever padded.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreline.llm import words as wd

CAPACITY = 1024
SLACK = 1 / 64          # share of a sequence that whole pieces may leave empty
BATCH_PIECES = 8192     # pieces handed to Spark at once
END_ID = 0

# fixed value: the word pattern of byte-level tokenizers (possessive form of the same matches)
_PATTERN = (r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s")


def _byte_of() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable Latin-1 stands
    for itself, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _fast(spec: dict):
    """The same tokenizer as a rank table, if the file is plain byte-level BPE with merges in
    the order of their ids; else None."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if (model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel"
            or pre.get("add_prefix_space") or not pre.get("use_regex", True)
            or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback",
                                          "end_of_word_suffix", "ignore_merges"))
            or any(t.get(k) for t in spec["added_tokens"]
                   for k in ("single_word", "lstrip", "rstrip", "normalized"))):
        return None
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    byte_of = _byte_of()
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if (not all(c in byte_of for t in vocab for c in t) or None in merged
            or merged != sorted(set(merged)) or len(merged) + 256 != len(vocab)):
        return None
    import tiktoken
    return tiktoken.Encoding("vocabulary", pat_str=_PATTERN, special_tokens=special,
                             mergeable_ranks={bytes(map(byte_of.get, t)): i for t, i in vocab.items()})


class Encoder:
    """Ids of whole texts.  Plain byte-level BPE files are read as a rank table, which gives
    the same ids several times faster; others, and texts whose white space is too long for
    that, go through the tokenizer itself."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"    # one thread per task
        self.path = path
        with open(path, encoding="utf-8") as f:
            self.fast = _fast(json.load(f))
        self.slow = None

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
            except ValueError:
                pass
        if self.slow is None:
            from tokenizers import Tokenizer
            self.slow = Tokenizer.from_file(self.path)
            self.slow.no_padding()
            self.slow.no_truncation()
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def cut_lengths(rest: int, capacity: int, slack: float) -> list[int]:
    """Pieces of a remainder below ``capacity``: heads of powers of two until what is left
    fills its reciprocal class."""
    out = []
    while rest:
        k = capacity // rest
        if capacity - k * rest <= slack * capacity or rest & (rest - 1) == 0:
            out.append(rest)
            break
        head = 1 << (rest.bit_length() - 1)
        out.append(head)
        rest -= head
    return out


class Packer:
    """Sequences of one task."""

    def __init__(self, capacity: int, slack: float, prefix: int):
        self.capacity, self.slack, self.next = capacity, slack, prefix
        self.open: dict[int, list[tuple]] = defaultdict(list)
        self.rows: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for p in pieces:
            self.rows.append((p[0], p[1], p[2], p[3], p[4], self.next, at))
            at += p[2]
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        full = total // self.capacity
        lengths = [self.capacity] * full + cut_lengths(
            total - full * self.capacity, self.capacity, self.slack)
        for n in lengths:
            self._piece(doc, start, ids[start:start + n], total)
            start += n

    def _piece(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        n = len(ids)
        piece = (doc, start, n, zlib.crc32(ids.astype("<u4").tobytes()), total)
        k = self.capacity // n
        if k == 1:
            self._close([piece])
            return
        # pieces with different lengths of one class share sequences; ids are kept so that
        # left-over pieces can be cut again
        group = self.open[k]
        group.append((piece, ids))
        if len(group) == k:
            self._close([p for p, _ in group])
            group.clear()

    def finish(self) -> None:
        """Cut what is left to powers of two; a sequence then ends at a power of two."""
        left: dict[int, list[tuple]] = defaultdict(list)
        for group in self.open.values():
            for (doc, start, n, crc, total), ids in group:
                at = 0
                while at < n:
                    size = 1 << ((n - at).bit_length() - 1)
                    part = ids[at:at + size]
                    left[size].append((doc, start + at, size,
                                       zlib.crc32(part.astype("<u4").tobytes()), total))
                    at += size
        self.open.clear()
        for size, pieces in left.items():
            i = 0
            while i < len(pieces):
                room = min(self.capacity // size, 1 << ((len(pieces) - i).bit_length() - 1))
                self._close(pieces[i:i + room])
                i += room


SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, slack: float = SLACK,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every row of ``docs``; one result row per piece.

    Null and empty texts have the end token alone.  Repeated rows are packed once per row;
    a null id stays null.  An empty table gives an empty result.  Other columns are not
    read, whatever their names.  ``capacity`` must be a power of two.  Sequence ids are
    (scan task, counter) and unique in the result; they are not consecutive.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(tokenizer_path)
        packer = Packer(capacity, slack, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc, np.append(enc.encode(text.as_py() or ""), np.uint32(END_ID)))
                if len(packer.rows) >= BATCH_PIECES:
                    yield table(packer.rows)
                    packer.rows = []
        del enc                  # the worker lives on
        wd.release()
        packer.finish()
        if packer.rows:
            yield table(packer.rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                          names=[x.split()[0] for x in SCHEMA.split(", ")])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, SCHEMA)
