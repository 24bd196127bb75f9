"""Benchmark decontamination: passages within an edit distance of test items.

By the pigeonhole principle, an item found with at most k errors holds one of its k + 1 pieces unchanged. All pieces are looked
for at once. The text around an item's hits, where an end within the distance can lie, is joined where it overlaps and verified
once by Myers' bit-parallel distance.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import content_of, map_lists, materialize, valid

#: One error for so many characters of an item.
CHARS_FOR_ERROR = 20
#: Items are searched in blocks of so many characters, a pass over the documents for each.
BLOCK_CHARS = 8 << 20
_GAPS = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """Lower case, with one space for what is neither a letter nor a digit; a space at both ends unless empty."""
    flat = _GAPS.sub(" ", (text or "").lower()).strip()
    return f" {flat} " if flat else ""


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly one length: (offset, piece)."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """An item's bit masks for Myers' distance, one for each of its characters."""

    def __init__(self, item: str):
        self.item, self.size = item, len(item)
        codes = np.frombuffer(item.encode("utf-32-le", "surrogatepass"), "<u4")
        order = np.argsort(codes, kind="stable")
        self._masks: dict[str, int] = {}
        for at in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if self.size else []:
            bits = np.zeros(self.size, bool)
            bits[at] = True
            self._masks[chr(codes[at[0]])] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    def distances(self, text: str, anchored: bool = False) -> Iterator[int]:
        """After each character of text, the least distance of the item to a part of text that ends there.

        The part may start anywhere; anchored, it starts where text does.
        """
        get, full, top, first = self._masks.get, (1 << self.size) - 1, 1 << (self.size - 1), int(anchored)
        plus, minus, score = full, 0, self.size
        for c in text:
            eq = get(c, 0)
            x = eq | minus
            d0 = ((((x & plus) + plus) ^ plus) | x) & full
            hp = minus | (~(d0 | plus) & full)
            hm = plus & d0
            if hp & top:
                score += 1
            elif hm & top:
                score -= 1
            hp, hm = hp << 1 & full | first, hm << 1 & full  # the row above the item: one more for each character if anchored, else 0
            plus, minus = hm | (~(d0 | hp) & full), hp & d0
            yield score

    def ends(self, text: str, most: int) -> list[tuple[int, int]]:
        """(distance, end): of each run of ends within most errors the least distance, and the first end that has it."""
        out, best = [], None
        for end, score in enumerate(self.distances(text), 1):
            if score <= most:
                best = (score, end) if best is None or score < best[0] else best
            elif best is not None:
                out.append(best)
                best = None
        return out if best is None else [*out, best]


class Matcher:
    """Finds items, given as (id, normalised text), in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], chars_for_error: int = CHARS_FOR_ERROR):
        import ahocorasick

        self._items, self._chars = items, chars_for_error
        self._patterns: dict[int, tuple[Pattern, Pattern]] = {}  # made when an item is first hit
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for n, (_, item) in enumerate(items):
            for offset, piece in pieces(item, len(item) // chars_for_error):
                by_piece.setdefault(piece, []).append((n, offset))
        self._machine = ahocorasick.Automaton()
        for piece, places in by_piece.items():
            self._machine.add_word(piece, (len(piece), places))
        self._any = bool(by_piece)
        if self._any:
            self._machine.make_automaton()

    def _windows(self, text: str) -> dict[int, list[list[int]]]:
        """For each item that has a hit, the parts of text that a passage with this hit can take, joined where they overlap."""
        starts: dict[int, list[int]] = {}
        for last, (size, places) in self._machine.iter(text):
            for n, offset in places:
                starts.setdefault(n, []).append(last + 1 - size - offset)
        out = {}
        for n, found in starts.items():
            size = len(self._items[n][1])
            errors = size // self._chars
            parts: list[list[int]] = []
            for start in sorted(found):
                lo, hi = max(0, start - errors), min(len(text), start + size + errors)
                if parts and lo <= parts[-1][1]:
                    parts[-1][1] = max(parts[-1][1], hi)
                else:
                    parts.append([lo, hi])
            out[n] = parts
        return out

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(id, start, end, errors) of each passage, in code points of the normalised text.

        Ends within the distance that follow each other without a gap are one passage: the end is the first with the least
        errors, and the start the one that gives as many errors, the last of equals.
        """
        out: list[tuple[int, int, int, int]] = []
        if not self._any or not text:
            return out
        for n, parts in self._windows(text).items():
            key, item = self._items[n]
            if n not in self._patterns:
                self._patterns[n] = Pattern(item), Pattern(item[::-1])
            pattern, back = self._patterns[n]
            most = len(item) // self._chars
            for lo, hi in parts:
                for errors, end in pattern.ends(text[lo:hi], most):
                    end += lo
                    head = text[max(0, end - len(item) - errors) : end][::-1]
                    size = next((i for i, score in enumerate(back.distances(head, anchored=True), 1) if score == errors), 0)
                    out.append((key, end - size, end, errors))
        return out


_LAST: tuple[object, Matcher | None] = (None, None)


def _matcher(name: str, sent) -> Matcher:
    """The matcher of a block of items, kept by a worker process for its next task."""
    global _LAST
    if _LAST[0] != name:
        _LAST = (name, Matcher(*sent.value))
    return _LAST[1]


def _blocks(benchmark: DataFrame, most_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items a block at a time: a block is all that the driver and a task hold of them."""
    block, size = [], 0
    for row in benchmark.toLocalIterator():
        text = normal(row["text"])
        if not text:
            continue
        if block and size + len(text) > most_chars:
            yield block
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, chars_for_error: int = CHARS_FOR_ERROR, block_chars: int = BLOCK_CHARS, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """A row for each passage of a document that is an item but for one error in chars_for_error characters.

    Result: doc_id, content (a hash of the text), item_id, start, end (code points of the normalised text, end exclusive) and
    errors; ends in a row are one passage, with the least errors (ties: the first end, the shortest passage). Null or empty texts and items match nothing; null keys are kept; rows that repeat a document have rows each; items
    that repeat another are found each under their own id; other columns are left out; either table may be empty. The items are
    the query set: blocks of a bounded size go to all tasks, one pass over the documents for each block.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), content_of(text).alias("content"), valid(text).alias("text"))
    items = benchmark.select(F.col(item_key).cast("long").alias("item_id"), valid(item_text).alias("text"))
    kinds = "doc_id long, content long, item_id long, start long, end long, errors int"
    spark, out = docs.sparkSession, None
    for block in _blocks(items, block_chars):
        sent = spark.sparkContext.broadcast((block, chars_for_error))

        def search(batches: Iterable[dict[str, list]], sent=sent, name=uuid.uuid4().hex) -> Iterator[pd.DataFrame]:
            matcher = _matcher(name, sent)
            for batch in batches:
                found = []
                for doc, content, text in zip(batch["doc_id"], batch["content"], batch["text"], strict=True):
                    if text:
                        found += [(doc, content, *x) for x in matcher.search(normal(text))]
                yield pd.DataFrame(found, columns=["doc_id", "content", "item_id", "start", "end", "errors"], dtype=object)

        part = map_lists(rows, search, kinds)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], kinds) if out is None else out


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that hold no passage of the benchmark, with their columns. Rows that repeat doc_id and text go or stay together."""
    found = find_leaks(docs, benchmark, text=text, key=key, **options).select(F.col("doc_id").alias("_d"), F.col("content").alias("_c")).distinct()
    bad = materialize(found, "leaks")
    return docs.join(bad, docs[key].cast("long").eqNullSafe(bad["_d"]) & (content_of(docs[text]) == bad["_c"]), "left_anti")


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """A row for each passage of a benchmark item in a document. Odd rows as in find_leaks."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("content")
