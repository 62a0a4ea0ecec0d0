"""Hierarchical multi-length packing of tokenized documents.

Documents are tokenized where they are read; nothing is shuffled. A task packs
its rows in windows of ``window_tokens``, so its memory is bounded:

1. Route: a document gives as many whole sequences of the longest tier as it
   fills; what is left goes to the smallest tier that holds it.
2. Pack each tier, longest first: every piece opens a sequence of its tier.
3. Fill: the gap behind it takes whole pieces from shorter tiers, longest
   fitting first, and at last the head of one piece, cut to the exact gap; the
   rest of that piece is routed again.
4. Balance: full sequences of a tier are dealt into step groups of equal token
   counts (``step_tokens`` // tier sequences a group).

What cannot fill a sequence waits for the next window of the task; at the
task's end the remainder is cut into powers of two, so no sequence needs
padding. Row order is kept at the grain of a window.

Order. Without more, sequences are numbered by task. Rows read from files whose names number them, as a sorted
write leaves them, come to tasks by the size of their files; with ``in_file_order`` they are packed file by file and numbered by
file and place in it, so ascending sequence ids follow the order of the rows over all files, and still nothing is shuffled.

Defined cases: null text is the empty text, a document of the end id alone; a
null id is kept as null; repeated rows are packed as often as they occur. Whole texts are packed, whatever their length. An
empty table gives no pieces. Ids are integers (or cast to them); only the id and the text are read, so other columns may have any names.
Step groups, named by their first sequence, are those of a task, or of a file: the last one of a tier may be part-filled.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slateql.llm.process import per_process, tidy

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("tier", pa.int32()),
        ("step_group", pa.int64()),
    ]
)
PIECES_DDL = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_group bigint"


@dataclass(frozen=True)
class PackingPlan:
    tiers: tuple[int, ...] = (4096, 2048, 1024, 512, 256)
    end_id: int = 2
    window_tokens: int = 2_000_000
    step_tokens: int = 65_536

    def __post_init__(self):
        if list(self.tiers) != sorted(set(self.tiers), reverse=True) or any(t & (t - 1) for t in self.tiers):
            raise ValueError("tiers are distinct powers of two, longest first")


class WordIds:
    """word -> its ids as little-endian uint32 bytes, for a tokenizer that never merges across white space.

    Holds two generations of ``limit`` words each: a full one becomes the old
    one, from which words in use come back. This bounds its memory.
    """

    SEPARATORS = "\n\t\r\x0b\x0c"
    LONGEST_KEPT = 64

    def __init__(self, path: str, limit: int = 300_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.ids, self.old = {"": b""}, {}
        self.model, cut = self.tokenizer.model, self.tokenizer.pre_tokenizer
        letters = [chr(c) for c in range(256) if chr(c).isalpha()]
        #: How the tokenizer spells the letters up to U+00FF before it merges.
        self.spelling = str.maketrans({c: cut.pre_tokenize_str(c)[0][0] for c in letters if c == c.lower()})
        #: Whether a-z are spelled as they are.
        self.plain = all(self.spelling[ord(c)] == c for c in ascii_lowercase)
        self.packed = [n.to_bytes(4, "little") for n in range(self.tokenizer.get_vocab_size())]
        self.marks = {m: self._whole(m) for m in ".,"}
        #: Whether upper case is folded; if not, words with any are left to the tokenizer.
        self.folds = self._whole("ABÉ") == self._whole("abé")
        for apart in ("ab cd", "ab\n\tCd. é"):
            if self._whole(apart) != b"".join(map(self._whole, apart.split())):
                raise ValueError(f"{path} does not drop white space before it merges")

    def _whole(self, word: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.tokenizer.encode(word, add_special_tokens=False).ids))

    def _encoded(self, word: str) -> bytes:
        """Letters up to U+00FF need no normalising but folding, and are one piece; a mark behind them is another."""
        mark = self.marks.get(word[-1], b"")
        bare = word[:-1] if mark else word
        if bare.isalpha() and (self.folds or bare == bare.lower()):
            spelled = None
            if self.plain and bare.isascii():
                spelled = bare.lower()
            elif max(bare) <= "\xff":
                spelled = bare.lower().translate(self.spelling)
            if spelled is not None:
                return b"".join([self.packed[t.id] for t in self.model.tokenize(spelled)]) + mark
        return self._whole(word)

    def encode(self, text: str) -> bytes:
        for c in self.SEPARATORS:
            text = text.replace(c, " ")
        words = text.split(" ")
        found = list(map(self.ids.get, words))
        if None not in found:
            return b"".join(found)
        fresh = {}
        for k, ids in enumerate(found):
            if ids is None:
                w = words[k]
                found[k] = fresh.get(w) or fresh.setdefault(w, self.old.get(w) or self._encoded(w))
        self.ids.update((w, x) for w, x in fresh.items() if len(w) <= self.LONGEST_KEPT)
        if len(self.ids) > self.limit:
            self.old, self.ids = self.ids, {"": b""}
        return b"".join(found)


class _Packer:
    """Packs one task's or file's documents; ``add`` and ``finish`` yield pieces, sequences are numbered from ``first`` to ``end``."""

    def __init__(self, plan: PackingPlan, first: int, end: int):
        self.plan, self.longest = plan, plan.tiers[0]
        self.pools = {t: deque() for t in plan.tiers}
        self.held = 0
        self.next_sequence, self.end = first, end
        self.groups: dict[int, tuple[int, int]] = {}  # tier -> its open step group and the sequences still missing there

    def _route(self, piece) -> None:
        """piece: (document, start, length), of at most the longest tier."""
        self.pools[min(t for t in self.plan.tiers if t >= piece[2])].append(piece)

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        n = len(ids) // 4
        doc = (doc_id, ids, n)
        whole = n // self.longest
        for k in range(whole):
            yield from self._write([(doc, k * self.longest, self.longest)], self.longest)
        if n % self.longest:
            self._route((doc, whole * self.longest, n % self.longest))
            self.held += n % self.longest
        if self.held >= self.plan.window_tokens:
            yield from self._pack()

    def _write(self, pieces: list, tier: int) -> Iterator[tuple]:
        sequence, offset = self.next_sequence, 0
        self.next_sequence += 1
        if sequence >= self.end:
            raise ValueError("too many sequences for one file")
        group = None
        if tier in self.pools:
            group, missing = self.groups.get(tier) or (sequence, max(1, self.plan.step_tokens // tier))
            self.groups[tier] = (group, missing - 1) if missing > 1 else None
        for (doc_id, ids, n), start, length in pieces:
            yield doc_id, start, length, ids[4 * start : 4 * (start + length)], n, sequence, offset, tier, group
            offset += length

    def _take(self, gap: int):
        """A piece for a gap: the longest shorter one that fits whole, else one to be cut."""
        for tier in self.plan.tiers:
            if tier <= gap and self.pools[tier]:
                return self.pools[tier].popleft()
        for tier in reversed(self.plan.tiers):
            if self.pools[tier]:
                return self.pools[tier].popleft()
        return None

    def _pack(self) -> Iterator[tuple]:
        left = []
        for tier in self.plan.tiers:
            while self.pools[tier]:
                pieces = [self.pools[tier].popleft()]
                gap = tier - pieces[0][2]
                while gap and (piece := self._take(gap)):
                    doc, start, length = piece
                    pieces.append((doc, start, min(gap, length)))
                    if length > gap:
                        self._route((doc, start + gap, length - gap))
                    gap -= min(gap, length)
                if gap:
                    left += pieces
                else:
                    yield from self._write(pieces, tier)
        for piece in left:
            self._route(piece)
        self.held = sum(p[2] for p in left)

    def finish(self) -> Iterator[tuple]:
        yield from self._pack()
        left = deque(p for t in self.plan.tiers for p in self.pools[t])
        total = sum(p[2] for p in left)
        for size in (1 << k for k in reversed(range(total.bit_length())) if total >> k & 1):
            pieces, gap = [], size
            while gap:
                doc, start, length = left.popleft()
                pieces.append((doc, start, min(gap, length)))
                if length > gap:
                    left.appendleft((doc, start + gap, length - gap))
                gap -= min(gap, length)
            yield from self._write(pieces, size)


#: Bits of a sequence id for the number of a file, the place of a row in it, and the sequences behind that row.
_FILES, _ROWS, _SEQUENCES = 20, 24, 19


def pack_documents(df: DataFrame, tokenizer: str, plan: PackingPlan | None = None, doc_id: str = "doc_id", text: str = "text", in_file_order: bool = False, cached_words: int = 600_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset, tier, step_group.

    ``tokenizer`` is the path of a tokenizer file that drops white space before it merges. ``in_file_order`` is for a ``df`` read from Parquet
    files named part-<number>-..., at most a million of them with 16 million rows each. A worker keeps the ids of up to twice ``cached_words`` words.
    """
    plan = plan or PackingPlan()
    end = np.array([plan.end_id], "<u4").tobytes()

    def numbers(task: int, file: int | None, row: int | None) -> tuple[int, int]:
        """First sequence id and the one after the last: of a task, or of the rows of a file from ``row`` on, those of one task."""
        if file is None:
            return task << 32, (task + 1) << 32
        if file >> _FILES or row >> _ROWS:
            raise ValueError("too many files or rows in one")
        first = ((file << _ROWS) + row) << _SEQUENCES
        return first, first + (1 << _SEQUENCES)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = per_process(("word ids", tokenizer, cached_words), lambda: WordIds(tokenizer, cached_words))
        task, packer, current = TaskContext.get().partitionId(), None, None
        rows, size = [], 0

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)
            rows.clear()
            return batch

        def pieces():
            nonlocal packer, current
            for batch in batches:
                for d, t, file, row in zip(batch.column(0).to_pylist(), batch.column(1), *(c.to_pylist() for c in batch.columns[2:])):
                    if packer is None or file != current:
                        if packer is not None:
                            yield from packer.finish()
                        packer, current = _Packer(plan, *numbers(task, file, row)), file
                    yield from packer.add(d, words.encode(t.as_py() or "") + end)
            if packer is not None:
                yield from packer.finish()

        for row in pieces():
            rows.append(row)
            size += len(row[3])
            if size > 8_000_000:
                yield flush()
                size = 0
        if rows:
            yield flush()

    none = F.lit(None).cast("bigint")
    file = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("bigint") if in_file_order else none
    row = F.col("_metadata.row_index") if in_file_order else none
    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), file.alias("file"), row.alias("row")).mapInArrow(tidy(emit), PIECES_DDL)
