"""N-gram Jaccard join by chosen paths: similar documents of a corpus, and the groups they form.

A document is the set of its shingles, WORDS words in a row; documents with one set are one class from the start. A run sends a
class to a bucket by one sampled shingle: the least under the run's hash, which two sets share with a probability that is their
similarity. Buckets that stay large are split again, by two more samples at a time whose hashes depend on the path so far, so
that sets that share one passage part soon; a bucket small enough is compared in full, with exact similarities. Runs are
repeated until a pair at the threshold meets with the target recall.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import content_of, map_lists, materialize, valid

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: A bucket above LARGE is split; after DEPTH samples it is compared all the same, a block against another. A block has some
#: BLOCK members or BLOCK_BYTES of sets, whichever are fewer members.
LARGE = 64
DEPTH = 4
CHILDREN = 2
BLOCK = 400
BLOCK_BYTES = 16 << 20
#: At SHIP members or fewer a bucket is compared from the second sample on: splitting it again costs more.
SHIP = 2000


def missed(depth: int, threshold: float = THRESHOLD, children: int = CHILDREN) -> float:
    """The probability that two sets at the threshold, together in a bucket, part in all children over so many splits."""
    out = 0.0
    for _ in range(depth):
        out = (1 - threshold * (1 - out)) ** children
    return out


def runs_for(recall: float, depth: int = DEPTH, threshold: float = THRESHOLD) -> int:
    """Runs after which a pair at the threshold has met with this probability, however often its buckets are split."""
    one = 1 - threshold * (1 - missed(depth - 1, threshold))
    return max(1, math.ceil(math.log(1 - recall) / math.log(one)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << n.bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.append(np.ones(1, "uint64"), np.full(size - 1, x, "uint64")), dtype="uint64") for x in (_BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


_LETTERS = _mix(np.arange(1, 257, dtype="uint64") * np.uint64(0xD1B54A32D192ED03))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted hashes of a text's shingles; one of all its words if it has fewer; none without words."""
    parts = (text or "").split()
    if not parts:
        return np.zeros(0, "uint64")
    data = np.frombuffer(" ".join(parts).encode(), np.uint8)
    gap = np.flatnonzero(data == 32)
    start, end = np.concatenate([[0], gap + 1]), np.append(gap, len(data))
    k = min(words, len(start))
    start, end = start[: len(start) - k + 1], end[k - 1 :]
    power, inverse = _power(len(data) + 1)
    total = np.concatenate([np.zeros(1, "uint64"), np.cumsum(_LETTERS[data] * power[:-1])])
    return np.unique(_mix((total[end] - total[start]) * inverse[start]))


def sample(tokens: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """For each seed the key that its least token gives."""
    out = np.empty(len(seeds), "uint64")
    for i, seed in enumerate(seeds):
        out[i] = tokens[np.argmin(_mix(tokens ^ seed))]
    return _mix(out ^ _mix(seeds + np.uint64(1))).view("int64")


def _seeds(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype="uint64") * np.uint64(0xA0761D6478BD642F))


def _children(keys: Iterable[int], children: int = CHILDREN) -> np.ndarray:
    wide = np.repeat(np.array(list(keys), "int64").view("uint64"), children)
    return _mix(wide + np.tile(np.arange(1, children + 1, dtype="uint64"), len(wide) // children))


def _buckets(rows: DataFrame, most: int) -> DataFrame:
    """key, n, size (hashes of all members' sets) of the buckets with two members or more; of buckets with the same members that are compared (most or fewer), one.

    Larger ones are only split, and each gives children of its own: runs stay independent, as the recall assumes.
    """
    sums = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("size"), F.bit_xor(F.xxhash64("sig")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "sig")).alias("y")).filter("n > 1")
    apart = F.when(F.col("n") > most, F.col("key")).alias("apart")
    return materialize(sums.groupBy("n", "size", "x", "y", apart).agg(F.min("key").alias("_key")).select("_key", "n", "size"), "buckets")


def _blocks(n: int, size: int) -> int:
    """The blocks that a bucket of n sets with so many hashes is dealt to: one while it is small in both."""
    by_size = -(-8 * size // BLOCK_BYTES)
    return max(-(-n // BLOCK) if n > 2 * BLOCK else 1, by_size if by_size > 2 else 1)


def _most(depth: int) -> int:
    """The members up to which a bucket is compared after so many samples."""
    return LARGE if depth < 2 else (SHIP if depth < DEPTH else 1 << 62)


def compare(sets: list[np.ndarray], other: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which sets reach the threshold with which others, by exact counts of common tokens."""
    every = sets + (other or [])
    sizes = np.array([len(s) for s in every])
    tokens = np.concatenate(every) if every else np.zeros(0, "uint64")
    owner = np.repeat(np.arange(len(every)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    fresh = np.concatenate([[True], tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, bool)
    group = np.cumsum(fresh) - 1
    often = np.bincount(group, minlength=1) > 1
    keep = often[group] if len(group) else fresh
    owner, group = owner[keep], np.unique(group[keep], return_inverse=True)[1] if len(group) else group
    a, b = len(sets), len(every)
    common = np.zeros((a, b - a if other is not None else a), "float32")
    width = int(group.max()) + 1 if len(group) else 0
    for lo in range(0, width, 4096):
        some = (group >= lo) & (group < lo + 4096)
        dense = np.zeros((b, 4096), "float32")
        dense[owner[some], group[some] - lo] = 1
        common += dense[:a] @ (dense[a:] if other is not None else dense[:a]).T
    left, right = sizes[:a, None], (sizes[None, a:] if other is not None else sizes[None, :a])
    return common >= threshold * (left + right - common) - 1e-4


def _shared_before(keys: list[np.ndarray], other: list[np.ndarray], key: int) -> np.ndarray:
    """Which pairs have a leaf bucket with a lesser key in common: their link is counted there."""
    names: dict[int, int] = {}
    spots = [[names.setdefault(int(k), len(names)) for k in ks if k < key] for ks in keys]
    known = [[names[int(k)] for k in ks if k < key and int(k) in names] for ks in other]
    left, right = np.zeros((len(keys), len(names)), "float32"), np.zeros((len(other), len(names)), "float32")
    for i, s in enumerate(spots):
        left[i, s] = 1
    for i, s in enumerate(known):
        right[i, s] = 1
    return left @ right.T > 0.5


def _solve(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """The links within a bucket, or between two blocks of one: sig, links counted here, and the least sig that it is tied to."""
    key = int(pdf["key"].iloc[0])
    one, two = int(pdf["one"].iloc[0]), int(pdf["two"].iloc[0])
    pdf = pdf.sort_values("sig", ignore_index=True)
    sets = [np.frombuffer(x, "uint64") for x in pdf["tokens"]]
    paths = [np.asarray(x, "int64") for x in pdf["leaves"]]
    if one == two:
        left = right = np.arange(len(pdf))
        link = compare(sets, None, threshold)
        np.fill_diagonal(link, False)
    else:
        block = pdf["block"].to_numpy()
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        link = compare([sets[i] for i in left], [sets[i] for i in right], threshold)
    count = np.zeros(len(pdf), "int64")
    at, to = np.nonzero(link)
    if len(at):
        own = link & ~_shared_before([paths[i] for i in left], [paths[i] for i in right], key)
        np.add.at(count, left, own.sum(axis=1))
        if one != two:
            np.add.at(count, right, own.sum(axis=0))
    least = np.arange(len(pdf))
    a, b = left[at], right[to]
    while len(a):
        before = least.copy()
        np.minimum.at(least, a, before[b])
        np.minimum.at(least, b, before[a])
        if (least == before).all():
            break
    sig = pdf["sig"].to_numpy()
    some = (least != np.arange(len(pdf))) | (count > 0)
    return pd.DataFrame({"sig": sig[some], "links": count[some], "tied": sig[least[some]]}, dtype=object)


def components(edges: DataFrame) -> DataFrame:
    """a, least: for each node of the edges (a, b) the least node of its component.

    Large and small stars by turns: every node's neighbours are tied to the least of them. Each turn is written, so that a lost
    executor costs one turn and joins on a hub's edges can be split.
    """

    def tidy(e: DataFrame) -> DataFrame:
        return materialize(e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = tidy(edges)
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy(F.col("a").alias("_a")).agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        now = tidy(both.join(least, F.col("a") == F.col("_a")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = materialize(now.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("m")), "least")
        joined = now.join(least, F.col("a") == F.col("_a"))
        now = tidy(joined.select("b", F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("_a").alias("a"), F.col("m").alias("b"))))
        after = mark(now)
        if after == seen:
            break
        seen = after
    return now.groupBy("a").agg(F.min("b").alias("least"))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row: doc_id, content (a hash of the text), class_id, n_links and n_copies.

    class_id is the least doc_id of the documents that links of at least the threshold connect, directly or by others; n_links
    counts the other sets of shingles that this row's set is linked to; n_copies the rows with its set, itself included. Copies
    are never paired: they share a class from the start. A text with fewer words than a shingle is one shingle; texts without
    words, null ones too, are copies of each other. A null doc_id stays null and names no class unless all are null; rows that
    repeat a doc_id are documents of their own; other columns are left out; an empty table gives no rows.
    """
    return _classed(docs, threshold, recall, words, text, key).drop("class")


def _classed(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """What jaccard_join returns, and class: the least sig of the class, which unlike class_id names one class alone."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), content_of(text).alias("content"), valid(text).alias("text"))
    seeds = _seeds(runs_for(recall, DEPTH, threshold))

    def sign(batches: Iterable[dict[str, list]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, content, text in zip(batch["doc_id"], batch["content"], batch["text"], strict=True):
                tokens = shingles(text, words)
                sig = xxhash.xxh3_128_digest(tokens.tobytes())
                out.append((doc, content, sig, len(tokens), sample(tokens, seeds).tolist() if len(tokens) else []))
            yield pd.DataFrame(out, columns=["doc_id", "content", "sig", "tokens", "keys"], dtype=object)

    signed = materialize(map_lists(rows, sign, "doc_id long, content long, sig binary, tokens long, keys array<long>"), "signed")
    classes = signed.groupBy("sig").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_copies"), F.min(F.struct("doc_id", "content")).alias("at"), F.first("tokens").alias("tokens"), F.first("keys").alias("keys"))
    classes = materialize(classes, "classes")
    paths = classes.select("sig", "tokens", F.explode("keys").alias("key")).distinct()
    found = _buckets(paths, _most(1))
    members = materialize(paths.join(found, F.col("key") == F.col("_key")).drop("_key"), "members")
    wanted = members.select(F.col("sig").alias("_sig")).distinct()
    spots = classes.join(wanted, F.col("sig") == F.col("_sig")).select(F.col("sig"), F.col("at.doc_id").alias("_d"), F.col("at.content").alias("_c"))
    spots = materialize(spots, "compared")
    texts = rows.join(spots, rows["doc_id"].eqNullSafe(spots["_d"]) & (rows["content"] == spots["_c"])).select("sig", "text")
    if not signed.groupBy("doc_id", "content").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        texts = texts.groupBy("sig").agg(F.first("text").alias("text"))  # rows repeat doc_id and text: one of them is the set's

    def tokens(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_sig": batch["sig"], "tokens": [shingles(x, words).tobytes() for x in batch["text"]]}, dtype=object)

    sets = materialize(texts.mapInPandas(tokens, "_sig binary, tokens binary"), "sets")

    def deeper(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for sig, keys, own in zip(batch["sig"], batch["keys"], batch["tokens"], strict=True):
                out += [(sig, len(own) // 8, k) for k in set(sample(np.frombuffer(own, "uint64"), _children(keys)).tolist())]
            yield pd.DataFrame(out, columns=["sig", "tokens", "key"], dtype=object)

    leaves, depth = None, 1
    while True:
        most = _most(depth)
        small = members.filter(F.col("n") <= most)
        leaves = small if leaves is None else leaves.unionByName(small)
        large = members.filter(F.col("n") > most)
        if depth == DEPTH or large.isEmpty():
            break
        lists = large.groupBy("sig").agg(F.collect_list("key").alias("keys"))  # as many as runs and splits give
        paths = materialize(lists.join(sets, F.col("sig") == F.col("_sig")).select("sig", "keys", "tokens").mapInPandas(deeper, "sig binary, tokens long, key long").distinct(), "paths")
        found = _buckets(paths, _most(depth + 1))
        members = materialize(paths.join(found, F.col("key") == F.col("_key")).drop("_key"), "members")
        depth += 1
    lists = leaves.groupBy("sig").agg(F.collect_list(F.struct("key", "n", "size")).alias("leaves"))

    def send(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, held = [], 0
            for sig, found, own in zip(batch["sig"], batch["leaves"], batch["tokens"], strict=True):
                keys = sorted({int(x["key"]) for x in found})
                for key, n, size in {(int(x["key"]), int(x["n"]), int(x["size"])) for x in found}:
                    blocks = _blocks(n, size)
                    mine = xxhash.xxh3_64_intdigest(sig, seed=1) % blocks
                    for b in range(blocks):
                        out.append((key, min(mine, b), max(mine, b), mine, sig, own, keys))
                        held += len(own)
                if held > 1 << 25 or len(out) > 2000:
                    yield pd.DataFrame(out, columns=["key", "one", "two", "block", "sig", "tokens", "leaves"], dtype=object)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=["key", "one", "two", "block", "sig", "tokens", "leaves"], dtype=object)

    sent = lists.join(sets, F.col("sig") == F.col("_sig")).select("sig", "leaves", "tokens").mapInPandas(send, "key long, one int, two int, block int, sig binary, tokens binary, leaves array<long>")
    links = materialize(sent.groupBy("key", "one", "two").applyInPandas(lambda pdf: _solve(pdf, threshold), "sig binary, links long, tied binary"), "links")
    counts = links.groupBy(F.col("sig").alias("_sig")).agg(F.sum("links").alias("n_links"))
    tied = components(links.select(F.col("sig").alias("a"), F.col("tied").alias("b")))
    tied = tied.select(F.col("a"), F.col("least").alias("top"))
    named = classes.select("sig", "least", "n_copies").join(tied, F.col("sig") == F.col("a"), "left").withColumn("top", F.coalesce("top", "sig")).drop("a")
    named = materialize(named.join(counts, F.col("sig") == F.col("_sig"), "left").drop("_sig"), "named")
    first = materialize(named.groupBy(F.col("top").alias("_top")).agg(F.min("least").alias("class_id")), "class-ids")
    named = materialize(named.join(first, F.col("top") == F.col("_top")).select(F.col("sig").alias("_sig"), F.col("top").alias("class"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies"), "named-classes")
    return signed.select("doc_id", "content", "sig").join(named, F.col("sig") == F.col("_sig")).select("doc_id", "content", "class", "class_id", "n_links", "n_copies")


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """One row of docs for each class: that with the least doc_id, and of rows with that doc_id the least hash of the text; of rows that repeat both, the least as JSON. A null doc_id comes last."""
    joined = _classed(docs, text=text, key=key, **options).groupBy("class", "doc_id", "content").agg(F.count(F.lit(1)).alias("n"))
    stays = joined.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "content", "n")).alias("at"))
    stays = materialize(stays.select(F.col("at.doc_id").alias("_d"), F.col("at.content").alias("_c"), F.col("at.n").alias("_n")), "first-of-class")

    def rows_of(some: DataFrame, how: str) -> DataFrame:
        return docs.join(some, docs[key].cast("long").eqNullSafe(some["_d"]) & (content_of(docs[text]) == some["_c"]), how)

    alone = rows_of(stays.filter("_n = 1"), "left_semi")
    whole = F.struct(*[docs[c] for c in docs.columns])
    repeated = rows_of(stays.filter("_n > 1"), "inner").groupBy("_d", "_c").agg(F.min_by(whole, F.to_json(whole)).alias("row"))
    return alone.unionByName(repeated.select("row.*"))


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """A row for each document: class_id, n_links, n_copies. Odd rows as in jaccard_join."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("content")


def brute_force(texts: dict[int, str | None] | list[tuple[int, str | None]], threshold: float = THRESHOLD, words: int = WORDS) -> dict[int, tuple[int, int, int]] | list[tuple[int, int, int]]:
    """(class_id, n_links, n_copies) of each doc_id, or of each row of a list, by comparing all sets: for small inputs in tests."""
    rows = list(texts.items()) if isinstance(texts, dict) else texts
    own_sets, distinct = [], {}
    for doc, text in rows:
        parts = (text or "").split()
        own = frozenset(" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))) if parts else frozenset()
        own_sets.append(own)
        distinct.setdefault(own, []).append(doc)
    sets, place = list(distinct), {}
    top, links = list(range(len(sets))), [0] * len(sets)
    where: dict[str, list[int]] = {}
    for i, own in enumerate(sets):
        place[own] = i
        for s in own:
            where.setdefault(s, []).append(i)

    def root(i: int) -> int:
        while top[i] != i:
            i = top[i]
        return i

    for i, own in enumerate(sets):
        common: dict[int, int] = {}
        for s in own:
            for j in where[s]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if n >= threshold * (len(own) + len(sets[j]) - n) - 1e-9:
                links[i] += 1
                links[j] += 1
                top[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, own in enumerate(sets):
        least[root(i)] = min(least.get(root(i), 1 << 62), *distinct[own])
    out = [(least[root(place[own])], links[place[own]], len(distinct[own])) for own in own_sets]
    return dict(zip(texts, out, strict=True)) if isinstance(texts, dict) else out
