"""Removal of long repeated byte strings from a whole corpus, by suffix arrays of the parts that can hold them.

Every window of LENGTH bytes goes to the bucket of its minimizer, the least hash among its K-byte parts, so that equal windows
meet in one bucket, and neighbouring windows mostly travel together as one segment. A segment whose minimizer is found nowhere
else holds no repeat; segments that are equal as a whole, by 128-bit hashes, are repeats without a look at their bytes. Only
buckets with different segments are searched: their bytes make a Burrows-Wheeler transform, and the common prefixes of its rows
are found by increasing value up to LENGTH, breadth first, each step prepending one byte.

Equal windows have their minimizer at one distance, so a bucket with too many segments is dealt by distances: the windows with
some neighbouring distances go on together, and with them only those of other segments that have the same bytes where all these
windows overlap. What still is too many for one task is dealt again by fewer distances at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import content_of, discard, map_lists, materialize, valid

LENGTH = 200
#: Bytes whose hashes are compared for the minimizer.
K = 32
#: Windows of a text that are cut at once, a power of two.
CHUNK = 1 << 22
#: A bucket with more segments than this is dealt by distances, so many at a time; two leave a bucket at most 65,536 kinds.
HOT = 2000
DISTANCES = (32, 8, 2)
#: Bytes of whole buckets that are sorted together, about.
BATCH_BYTES = 64 << 10
#: Where more than one in so many rows is new, all rows are looked at; else only the intervals of the new ones.
DENSE = 64
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def part_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k bytes in a row; k is a power of two."""
    h = _mix((np.arange(256, dtype="uint64") + np.uint64(1)) * _M)[data]
    factor, size = np.uint64(0xD6E8FEB86659FD93), 1
    while size < k:
        h = h[:-size] * factor + h[size:]
        with np.errstate(over="ignore"):
            factor = factor * factor
        size *= 2
    return _mix(h)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in a row."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def segments(data: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, windows, the minimizer's distance from the first) of each run of windows with their minimizer at one place, the leftmost if it recurs.

    So a segment has at most length - k + 1 windows, and two equal windows are never in one.
    """
    out = []
    for lo in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[lo : lo + CHUNK + length - 1]
        with np.errstate(over="ignore"):
            hashes = part_hashes(part, k)
        spot = least_of(hashes & ~np.uint64(2 * CHUNK - 1) | np.arange(len(hashes), dtype="uint64"), length - k + 1)
        start = np.flatnonzero(np.append(True, spot[1:] != spot[:-1]))
        at = (spot[start] & np.uint64(2 * CHUNK - 1)).astype("int64")
        out.append((hashes[at].view("int64"), start + lo, np.diff(np.append(start, len(spot))), at - start))
    if not out:
        none = np.zeros(0, "int64")
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """The places sorted by their next symbols, at least depth of them, by prefix doubling; what is alone is not sorted again."""
    n, size = len(symbols), 7
    wide = np.concatenate([symbols, np.zeros(size, symbols.dtype)]).astype("int64")
    key = np.zeros(n, "int64")
    for i in range(size):
        key = key * 258 + wide[i : n + i]
    order = np.argsort(key)
    slots, place, sorted_key = np.arange(n), order, key[order]
    rank = np.empty(n, "int64")
    while True:
        head = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        group = slots[np.flatnonzero(head)][np.cumsum(head) - 1]  # the first slot of those that are equal so far
        rank[place] = group
        alone = head & np.append(head[1:], True)
        if size >= depth or alone.all():
            return order
        slots, place, group = slots[~alone], place[~alone], group[~alone]
        after = place + size
        key = group * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        own = np.argsort(key)
        sorted_key, place = key[own], place[own]
        order[slots] = place
        size *= 2


def short_prefixes(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each row of the sorted suffixes, whether it shares length symbols or more with the row before.

    On the Burrows-Wheeler transform, the row that prepends c to row j follows the one that prepends c to the c-row before j, and
    shares one symbol more than the least that rows between them share. So the rows with a common prefix of l, once known, give
    those with l + 1: breadth first by increasing value, up to length - 1. What is left shares length or more.
    """
    n = len(order)
    before = symbols[order - 1]  # the transform; place 0 has the last symbol before it
    by_symbol = np.argsort(before, kind="stable")  # row i of the sorted suffixes prepends to row by_symbol[i]
    first = np.concatenate([[True], before[by_symbol[1:]] != before[by_symbol[:-1]]])
    since = np.concatenate([[0], by_symbol[:-1]])
    lead = np.zeros(n + 1, "int64")  # the row that prepends to a row
    lead[by_symbol] = np.arange(n)
    unset = np.append(~first, False)
    fresh = np.flatnonzero(first)  # rows that begin with another symbol share 0
    for _ in range(length - 1):
        if len(fresh) * DENSE > n:
            mark = np.zeros(n, "int32")
            mark[fresh] = 1
            seen, rows = np.cumsum(mark, dtype="int32"), np.flatnonzero(unset)
            fresh = rows[seen.take(by_symbol.take(rows)) > seen.take(since.take(rows))]
        else:
            fresh = _extended(fresh, lead, since, unset)
        if not len(fresh):
            break
        unset[fresh] = False
    return unset[:n]


def _extended(fresh: np.ndarray, lead: np.ndarray, since: np.ndarray, unset: np.ndarray) -> np.ndarray:
    """The unset rows that prepend a symbol to an interval that begins at a fresh row, the first with that symbol.

    An interval goes on as long as rows are unset. It is looked at a window at a time, each twice as wide.
    """
    rows = lead.take(fresh)
    out = [rows[unset.take(rows) & (since.take(rows) < fresh)]]
    start, at, width = fresh, fresh + 1, 1
    while len(start):
        span = np.minimum(at[:, None] + np.arange(width), len(since))
        inside = np.logical_and.accumulate(unset.take(span), axis=1)
        rows = lead.take(span)
        out.append(rows[inside & unset.take(rows) & (since.take(rows) < start[:, None])])
        more = inside[:, -1]
        start, at, width = start[more], at[more] + width, 2 * width
    return np.concatenate(out)


def repeated_windows(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part, whether the window at each of its places stands anywhere else in the parts."""
    sizes = np.array([len(p) for p in parts])
    symbols = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype("uint16") + np.uint16(1)
    ends = np.cumsum(sizes + 1) - 1
    symbols[ends] = 0  # no window that is looked at reaches one
    order = suffix_order(symbols, length)
    same = short_prefixes(symbols, order, length)
    twice = np.empty(len(order), bool)
    twice[order] = same | np.append(same[1:], False)
    return [twice[end - size : end - size + max(0, size - length + 1)] for size, end in zip(sizes.tolist(), ends.tolist(), strict=True)]


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view("int8"), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


def _bytes(text: str | None) -> bytes:
    return (text or "").encode()


def _hashes(parts: Iterable) -> np.ndarray:
    """Two 64-bit numbers for each part."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), "<i8").reshape(-1, 2)


def by_distance(data: bytes, gap: int, n: int, width: int, length: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """(key, first window, windows) of a segment's windows, dealt by their minimizer's distance, width distances at a time.

    gap is the first window's distance. The key is a hash of the distances and of the bytes that all windows with them have in
    common, so windows that are equal have one key.
    """
    first = 0
    while first < n:
        block = (gap - first) // width
        last = min(n - 1, gap - block * width)
        core = data[gap - block * width : gap - (block + 1) * width + 1 + length]  # from the last of the block's windows to the end of its first, whether all are here or not
        yield xxhash.xxh3_64_intdigest(core, seed=block) - (1 << 63), first, last - first + 1
        first = last + 1


_SPOT = "doc_id long, content long, start long, n long"
_OWN = ["doc_id", "content", "start", "n"]
_KIND = ["least", "second", "same", "same2"]


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, content, spans: array of struct(start, n), n windows in a row that stand elsewhere too; written, one row a text.

    Counts of minimizers combine on the map side. The tables joined are written first, so that Spark splits the partition of
    a minimizer or segment that many texts share. Of equal segments, one goes on to the search.
    """

    def cut(batches: Iterable[dict[str, list]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, content, text in zip(batch["doc_id"], batch["content"], batch["text"], strict=True):
                data = _bytes(text)
                key, start, n, gap = segments(np.frombuffer(data, np.uint8), length)
                if len(key):
                    view = memoryview(data)
                    same = _hashes([view[a : a + m + length - 1] for a, m in zip(start.tolist(), n.tolist(), strict=True)])
                    out.append(pd.DataFrame({"least": key, "same": same[:, 0], "same2": same[:, 1], "doc_id": pd.array([doc] * len(key), "Int64"), "content": np.int64(content), "start": start, "n": n, "gap": gap}))
            if out:
                yield pd.concat(out)

    parts = materialize(map_lists(rows, cut, f"least long, same long, same2 long, {_SPOT}, gap long"), "segments")
    several = (F.min("same") != F.max("same")) | (F.min("same2") != F.max("same2"))
    often = parts.groupBy("least").agg(F.count(F.lit(1)).alias("times"), several.alias("mixed")).filter("times > 1")
    often = materialize(often.select(F.col("least").alias("_l"), "mixed", (F.col("times") > HOT).alias("hot")), "minimizers")
    found = materialize(parts.join(often, F.col("least") == F.col("_l")).drop("_l"), "shared-segments")
    discard(parts, often)
    equal = found.filter("not mixed").select(*_OWN)
    mixed = found.filter("mixed").withColumn("second", F.lit(0).cast("long"))
    kinds = materialize(mixed.groupBy(*_KIND).agg(F.count(F.lit(1)).alias("times"), F.min(F.struct(*_OWN, "gap")).alias("at"), F.first("hot").alias("hot")), "different-segments")
    equal = equal.unionByName(_all_of(mixed, kinds))
    wanted = kinds.groupBy(F.col("at.doc_id").alias("_d"), F.col("at.content").alias("_c")).agg(F.collect_list(F.struct("least", "hot", "times", "at.start", "at.n", "at.gap")).alias("wanted"))  # a text's segments bound the list
    wanted = materialize(wanted, "wanted-segments")
    texts = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["_d"]) & (rows["content"] == wanted["_c"])).select("doc_id", "content", "text", "wanted")
    if not rows.groupBy("doc_id", "content").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        texts = texts.groupBy("doc_id", "content").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted"))  # of rows that repeat both, one

    def fetch(batches: Iterable[dict[str, list]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, content, text, want in zip(batch["doc_id"], batch["content"], batch["text"], batch["wanted"], strict=True):
                data = _bytes(text)
                out += [(x["least"], 0, doc, content, x["start"], x["n"], x["gap"], x["times"], x["hot"], data[x["start"] : x["start"] + x["n"] + length - 1]) for x in want]
            yield pd.DataFrame(out, columns=["least", "second", *_OWN, "gap", "times", "hot", "data"], dtype=object)

    kind = f"least long, second long, {_SPOT}, gap long, times long"
    fetched = materialize(map_lists(texts, fetch, f"{kind}, hot boolean, data binary"), "fetched-segments")
    cold, hot = fetched.filter("not hot").drop("hot"), fetched.filter("hot").drop("hot")
    for width in DISTANCES:
        if hot.isEmpty():
            break
        searched, again, hot = _dealt(hot, width, length, last=width == DISTANCES[-1])
        cold, equal = cold.unionByName(searched), equal.unionByName(again)
    sizes = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = cold.select("least", "second", *_OWN, "times", "data").repartition(sizes, "least", "second").sortWithinPartitions("least", "second")

    def solve(have: list[tuple]) -> pd.DataFrame:
        distinct: dict[bytes, int] = {}
        of = [distinct.setdefault(x[-1], len(distinct)) for x in have]
        count = np.bincount(of, minlength=len(distinct))
        twice = repeated_windows(list(distinct), length)
        out = []
        for (doc, content, start, n, times, _), i in zip(have, of, strict=True):
            if times > 1:
                continue  # all of it was found above
            at, m = (np.array([0]), np.array([n])) if count[i] > 1 else _runs(twice[i])
            out += [(doc, content, start + a, b) for a, b in zip(at.tolist(), m.tolist(), strict=True)]
        return pd.DataFrame(out, columns=_OWN, dtype=object)

    def search(batches: Iterable[dict[str, list]]) -> Iterator[pd.DataFrame]:
        have, size, last = [], 0, None
        for batch in batches:
            for key, *x in zip(zip(batch["least"], batch["second"], strict=True), *(batch[c] for c in (*_OWN, "times", "data")), strict=True):
                if key != last and size >= BATCH_BYTES:
                    yield solve(have)
                    have, size = [], 0
                last = key
                have.append(x)
                size += len(x[-1])
        if have:
            yield solve(have)

    partly = map_lists(spread, search, _SPOT)
    spans = equal.unionByName(partly).groupBy("doc_id", "content").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    return materialize(spans, "repeated-spans")


def _all_of(members: DataFrame, kinds: DataFrame) -> DataFrame:
    """The places of all members of kinds that are there more than once."""
    again = kinds.filter("times > 1").select(*[F.col(c).alias(f"_{c}") for c in _KIND])
    on = F.lit(True)
    for c in _KIND:
        on = on & (members[c] == again[f"_{c}"])
    return members.join(again, on).select(*[members[c] for c in _OWN])


def _dealt(hot: DataFrame, width: int, length: int, last: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The segments dealt by so many distances, one of each kind: those to be searched; all places of kinds found twice; those
    of buckets that are still hot.

    A segment that was there several times before is known to be repeated, and is only looked at for the others' sake.
    """

    def split(batches: Iterable[dict[str, list]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for least, second, doc, content, start, n, gap, times, data in zip(*(batch[c] for c in ("least", "second", *_OWN, "gap", "times", "data")), strict=True):
                for key, a, m in by_distance(data, gap, n, width, length):
                    out.append((least, second ^ key, doc, content, start + a, m, gap - a, times, data[a : a + m + length - 1]))
            made = pd.DataFrame(out, columns=["least", "second", *_OWN, "gap", "times", "data"], dtype=object)
            same = _hashes(made["data"])
            yield made.assign(same=same[:, 0], same2=same[:, 1])

    members = materialize(map_lists(hot, split, f"least long, second long, same long, same2 long, {_SPOT}, gap long, times long, data binary"), "dealt-segments")
    at = F.min(F.struct(*_OWN, "gap")).alias("at")
    kinds = materialize(members.groupBy(*_KIND).agg(F.sum("times").alias("times"), at, F.first("data").alias("data")), "dealt-kinds")
    found = _all_of(members, kinds)
    flat = kinds.select("least", "second", "at.*", "times", "data")
    if last:
        return flat, found, flat.filter("false")
    many = kinds.groupBy(F.col("least").alias("_l"), F.col("second").alias("_s")).agg(F.count(F.lit(1)).alias("n_kinds")).filter(F.col("n_kinds") > HOT)
    many = materialize(many, "hot-buckets")
    on = (flat["least"] == many["_l"]) & (flat["second"] == many["_s"])
    return flat.join(many, on, "left_anti"), found, flat.join(many, on, "left_semi")


def covered(size: int, spans, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(start, bytes) of the maximal runs that the spans' windows cover."""
    mark = np.zeros(size + 1, "int64")
    start = np.array([x["start"] for x in spans], "int64")
    np.add.at(mark, start, 1)
    np.add.at(mark, start + np.array([x["n"] for x in spans], "int64") + length - 1, -1)
    return _runs(np.cumsum(mark)[:size] > 0)


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that are left) and removed (struct(start, end)).

    Each byte is removed that a string of length bytes covers which starts anywhere else too. A null text counts as empty; null
    keys are kept; rows that repeat a key are texts of their own, and repeats of each other; other columns are left out; an empty
    table gives no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), content_of(text).alias("content"), valid(text).alias("text"))
    spans = repeated_spans(rows, length)
    spans = spans.select(F.col("doc_id").alias("_d"), F.col("content").alias("_c"), "spans")
    both = rows.join(spans, rows["doc_id"].eqNullSafe(spans["_d"]) & (rows["content"] == spans["_c"]), "left").select("doc_id", "text", "spans")

    def remove(batches: Iterable[dict[str, list]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, found in zip(batch["doc_id"], batch["text"], batch["spans"], strict=True):
                data = _bytes(text)
                at, n = covered(len(data), found, length) if found is not None and len(found) else ((), ())
                ends, kept, last = [], [], 0
                for a, m in zip(map(int, at), map(int, n), strict=True):
                    kept.append(data[last:a])
                    ends.append({"start": a, "end": a + m})
                    last = a + m
                kept.append(data[last:])
                out.append((doc, len(data), int(sum(n)), len(ends), b"".join(kept), ends))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "removed"], dtype=object)

    return map_lists(both, remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<start:long,end:long>>")


def op8_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """A row for each document: bytes, removed bytes and runs, and a digest of what is left. Odd rows as in remove_repeats."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The query's columns but the id, by counting every window: for small inputs in tests."""
    seen: dict[bytes, int] = {}
    all_bytes = [_bytes(t) for t in texts]
    for data in all_bytes:
        for i in range(len(data) - length + 1):
            seen[data[i : i + length]] = seen.get(data[i : i + length], 0) + 1
    out = []
    for data in all_bytes:
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if seen[data[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((len(data), int(gone.sum()), len(_runs(gone)[0]), hashlib.sha256(kept).hexdigest()))
    return out
