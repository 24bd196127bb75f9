"""Best-fit packing of token pieces into sequences by bin completion.

Pieces of one length are alike, so the plan is made over the histogram of lengths, which has as many rows as a sequence has
tokens however large the corpus: it says which lengths fill a sequence together and how many such sequences there are. Every
piece then finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .tokens import vocabulary, word_ids

#: Steps and fillings that the search looks at before it gives up the proof; the plan says then how far it is from its bound.
NODES = 40_000
_LOG = logging.getLogger(__name__)


@dataclass
class Pattern:
    """copies sequences, each filled by these (length, pieces of it), the largest first."""

    copies: int
    parts: list[tuple[int, int]]


@dataclass
class Plan:
    """Patterns that hold all pieces in this many sequences; no plan has fewer than least. It is proved to be minimal if the search came to its end."""

    patterns: list[Pattern]
    sequences: int
    least: int
    nodes: int
    proved: bool


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing: each sequence takes the largest length that still fits, as often as it does, again and again."""
    left, out = counts.copy(), []
    while left.any():
        room, parts = capacity, []
        lengths = np.flatnonzero(left[: capacity + 1])
        while len(lengths := lengths[: np.searchsorted(lengths, room, "right")]):
            length = int(lengths[-1])
            n = min(int(left[length]), room // length)
            parts.append((length, n))
            room -= n * length
            lengths = lengths[:-1]
        copies = min(int(left[x]) // n for x, n in parts)
        for x, n in parts:
            left[x] -= copies * n
        out.append(Pattern(copies, parts))
    return out


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any plan needs: for each k, pieces over half a sequence each need their own, and those from k tokens to half
    of one share what room the ones up to capacity - k leave, and further sequences."""
    n, total = np.cumsum(counts), np.cumsum(counts * np.arange(len(counts)))
    k, half = np.arange(capacity // 2 + 1), capacity // 2
    large = n[-1] - n[half]
    room = (n[capacity - k] - n[half]) * capacity - (total[capacity - k] - total[half])
    small = total[half] - np.where(k > 0, total[k - 1], 0)
    return int(large + max(0, -(-(small - room).max() // capacity)))


def _spread(bits: int, by: int) -> int:
    """The bits, and those up to so many places above each."""
    width = 1
    while 2 * width <= by + 1:
        bits |= bits << width
        width *= 2
    return bits | bits << (by + 1 - width)


def dominated(parts: list[tuple[int, int]], unused: int, slack: int) -> bool:
    """Whether a piece that isn't used (a bit for each such length) fits too, or fits instead of a lesser one or of several no larger together.

    Where that is so, a plan with this filling is as good with the piece in it: what it replaces fits where it came from.
    """
    if unused & (1 << (slack + 1)) - 1:
        return True
    one = several = 0
    for length, n in parts:
        for _ in range(n):
            several |= several << length | one << length
            one |= 1 << length
    return bool(unused & (_spread(several, slack) | (_spread(one << 1, slack - 1) if slack else 0)))


def _unused(left: np.ndarray, room: int) -> int:
    return int.from_bytes(np.packbits(left[: room + 1] > 0, bitorder="little").tobytes(), "little")


class _Search:
    """Depth-first: the largest length left is completed by each undominated filling in turn, until none is left to try."""

    def __init__(self, counts: np.ndarray, capacity: int, budget: int):
        self.left, self.capacity, self.budget, self.nodes = counts.copy(), capacity, budget, 0
        self.total = int((counts * np.arange(len(counts))).sum())
        self.best = best_fit(counts, capacity)
        self.sequences = sum(p.copies for p in self.best)
        self.least = lower_bound(counts, capacity)
        self.used = self.waste = 0
        self.path: list[Pattern] = []

    def spare(self) -> int:
        """Tokens that may still be wasted by a plan with a sequence less than the best."""
        return (self.sequences - 1) * self.capacity - self.total - self.waste

    def fillings(self, top: int) -> Iterator[list[tuple[int, int]]]:
        """Undominated fillings beside a piece of length top, the least waste first; of one waste mostly larger pieces first.

        A piece that fills the room exactly dominates all others. Next come two pieces that do so, which need no table of sums.
        It reads what is left each time that it goes on, so what is left must then be as at the start.
        """
        room = self.capacity - top
        if self.left[room] > (room == top):
            yield [(room, 1)]
            return
        at = room  # pairs below this have not been given yet
        while True:
            some = np.flatnonzero(self.left[: room + 1])
            n = self.left[some] - (some == top)
            some, n = some[n > 0], n[n > 0]
            if not len(some):
                yield []
                return
            have = np.zeros(room + 1, np.int64)
            have[some] = n
            pair = some[(some < at) & (2 * some >= room)]
            pair = pair[have[room - pair] > (2 * pair == room)]
            if not len(pair):
                break
            at = int(pair[-1])
            yield [(at, 1), (room - at, 1)] if 2 * at != room else [(at, 2)]
        first = None
        for exact in (True, False):  # first one filling from sums of the least lengths that reach the room, then all from all
            steps, reach, mask = [], 1, (1 << (room + 1)) - 1
            for length, most in zip(some.tolist(), n.tolist(), strict=True):
                before = reach
                for _ in range(min(most, room // length)):
                    if (grown := (reach | reach << length) & mask) == reach:
                        break
                    reach = grown
                steps.append((length, min(most, room // length), before))
                if exact and reach >> room & 1:
                    break
            if exact:
                if reach >> room & 1 and (first := next((p for p in self._ways(steps, room) if not self._pair(p)), None)):
                    yield first
                continue
            free = _unused(have, room)
            while reach:
                total = reach.bit_length() - 1
                reach ^= 1 << total
                if room - total > self.spare():
                    return
                for parts in self._ways(steps, total):
                    self.nodes += 1
                    if self.nodes >= self.budget:
                        return
                    if parts == first or total == room and self._pair(parts):
                        continue
                    unused = free
                    for length, k in parts:
                        if have[length] == k:
                            unused ^= 1 << length
                    if not dominated(parts, unused, room - total):
                        yield parts

    @staticmethod
    def _pair(parts: list[tuple[int, int]]) -> bool:
        return sum(k for _, k in parts) == 2

    @staticmethod
    def _ways(steps: list[tuple[int, int, int]], total: int) -> Iterator[list[tuple[int, int]]]:
        """All ways to make this sum, by the sums that the lengths before each can make."""
        stack = [(len(steps) - 1, total, ())]
        while stack:
            i, rest, parts = stack.pop()
            if not rest:
                yield list(parts)
                continue
            length, most, before = steps[i]
            if before >> rest & 1:
                stack.append((i - 1, rest, parts))
            for k in range(1, min(most, rest // length) + 1):  # the last that is put on the stack comes first
                if before >> (rest - k * length) & 1:
                    stack.append((i - 1, rest - k * length, (*parts, (length, k))))

    def steps(self) -> Iterator[Pattern]:
        """What may be done with the largest length left: each filling, as often as its pieces allow, and then once."""
        top = int(np.flatnonzero(self.left)[-1])
        for parts in self.fillings(top):
            merged = dict(parts)
            merged[top] = merged.get(top, 0) + 1
            parts = sorted(merged.items(), reverse=True)
            most = min(int(self.left[x]) // n for x, n in parts)
            yield Pattern(most, parts)
            if most > 1:
                yield Pattern(1, parts)

    def _take(self, p: Pattern, sign: int) -> None:
        for x, n in p.parts:
            self.left[x] -= sign * p.copies * n
        self.used += sign * p.copies
        self.waste += sign * p.copies * (self.capacity - sum(x * n for x, n in p.parts))

    def run(self) -> Plan:
        seen: dict[bytes, int] = {}
        stack = [self.steps()] if self.sequences > self.least else []
        while stack and self.sequences > self.least and self.nodes < self.budget:
            step = next(stack[-1], None)
            if step is None:
                stack.pop()
                if self.path:
                    self._take(self.path.pop(), -1)
                continue
            self.nodes += 1
            self._take(step, 1)
            self.path.append(step)
            if not self.left.any():
                if self.used < self.sequences:
                    self.best, self.sequences = list(self.path), self.used
            elif self.spare() >= 0 and self.used + lower_bound(self.left, self.capacity) < self.sequences:
                state = xxhash.xxh3_128_digest(self.left)
                if seen.get(state, 1 << 62) > self.used:
                    seen[state] = self.used
                    stack.append(self.steps())
                    continue
            self._take(self.path.pop(), -1)
        return Plan(self.best, self.sequences, self.least, self.nodes, self.sequences == self.least or self.nodes < self.budget)


def search(histogram: dict[int, int], capacity: int, budget: int = NODES) -> Plan:
    """The plan for the histogram (length: pieces), and whether it is proved to have the fewest sequences.

    Best-fit decreasing is the first incumbent. Bin completion then takes the largest length left and its undominated fillings,
    depth first; it turns back where the waste, or a bound on what is left, shows that the incumbent can't be beaten, or where
    the same pieces were left before. It ends at the lower bound, when all is tried, or after budget steps and fillings.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit {capacity}")
        counts[length] += n
    return _Search(counts, capacity, budget).run() if counts.any() else Plan([], 0, 0, 0, True)


def plan(histogram: dict[int, int], capacity: int, budget: int = NODES) -> list[Pattern]:
    """The patterns of search(); logs a warning if they are not proved to be as few as can be."""
    found = search(histogram, capacity, budget)
    if not found.proved:
        _LOG.warning("%d sequences; at least %d are needed, and the search ended after %d steps without a proof", found.sequences, found.least, found.nodes)
    return found.patterns


def slots(patterns: list[Pattern]) -> pd.DataFrame:
    """For ranges of ranks of a length: the sequences and the offsets they go to."""
    rows, used, sequence = [], {}, 0
    for p in patterns:
        offset = 0
        for length, n in p.parts:
            rank = used.get(length, 0)
            rows.append((length, rank, n, sequence, offset))
            used[length] = rank + n * p.copies
            offset += n * length
        sequence += p.copies
    return pd.DataFrame(rows, columns=["length", "rank", "each", "sequence", "offset"]).astype("int64")


def tokenize_pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents' ids with end_id, cut only where longer than capacity: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterable[dict[str, list]]) -> Iterator[pd.DataFrame]:
        encoder, end = word_ids(path), int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encoder.ids(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(own) // 4, zlib.crc32(own)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"], dtype=object)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), shared.valid(text).alias("text"))
    return shared.map_lists(rows, cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = 4096, budget: int = NODES) -> DataFrame:
    """Gives each row of pieces (with a length of 1 to capacity) a sequence_id and an offset, gapless from 0.

    The pieces are sorted by length over all tasks; a task's rows get their places in that order, and the tasks' counts give
    the ranks. The driver sees a row for each length and for each task. Rows that are alike may change places with each other.
    A row with a null length gets nulls; columns of these two names are replaced; other nulls, repeated rows and an empty table
    are as any.
    """
    sized = shared.materialize(pieces.drop("sequence_id", "offset"), "pieces")
    names = sized.columns
    some = sized.filter(F.col("length").isNotNull())
    order = ["length", *(c for c in names if c != "length")]
    kinds = ", ".join(f"`{n}` {t}" for n, t in sized.dtypes)

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, "int32")), pa.array(np.arange(at, at + n, dtype="int64"))], [*names, "_in_part", "_in_place"])
            at += n

    sorted_rows = some.repartitionByRange(*map(F.col, order)).sortWithinPartitions(*order)
    numbered = shared.materialize(sorted_rows.mapInArrow(number, f"{kinds}, _in_part int, _in_place long"), "sorted-pieces")
    histogram = {r["length"]: r["count"] for r in numbered.groupBy("length").count().collect()}
    tasks = {r["_in_part"]: r["count"] for r in numbered.groupBy("_in_part").count().collect()}
    ends = np.cumsum([0, *(tasks.get(p, 0) for p in range(max(tasks, default=-1) + 1))])
    by_length = np.cumsum([0, *(histogram.get(x, 0) for x in range(capacity + 1))])
    places = slots(plan(histogram, capacity, budget))
    places["at"] = by_length[places["length"].to_numpy()] + places["rank"].to_numpy()
    places = places.sort_values("at")
    at, each, sequence, offset = (places[c].to_numpy() for c in ("at", "each", "sequence", "offset"))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *own, part, number = batch.columns
            rank = ends[part.to_numpy()] + number.to_numpy()
            slot = np.searchsorted(at, rank, "right") - 1
            nth = rank - at[slot]
            to, start = sequence[slot] + nth // each[slot], offset[slot] + nth % each[slot] * own[names.index("length")].to_numpy()
            yield pa.RecordBatch.from_arrays([*own, pa.array(to), pa.array(start.astype("int64"))], [*names, "sequence_id", "offset"])

    null = F.lit(None).cast("long")
    return numbered.mapInArrow(place, f"{kinds}, sequence_id long, offset long").unionByName(sized.filter(F.col("length").isNull()).withColumns({"sequence_id": null, "offset": null}))


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, budget: int = NODES) -> DataFrame:
    """Tokenizes the documents and packs their pieces into sequences of at most capacity tokens; one row for each piece.

    A null text counts as empty, so its document is the end id alone. Rows that repeat a doc_id are documents of their own,
    a null doc_id stays null, other columns are left out, and an empty table gives no rows. Pieces of one length may change
    places with each other.
    """
    return pack(tokenize_pieces(docs, path, capacity, end_id), capacity, budget)


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """A row for each piece with its sequence and offset. Odd rows as in pack_documents."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
