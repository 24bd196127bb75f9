"""Quality rules: counts of a text's own words and lines, and line frequency across documents. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import content_of, let, materialize

SPACE = r"[\x20\x09-\x0D]+"
#: A line is boilerplate of its host above this share of the host's different documents, and above this many of them.
MOST_SHARE = 0.02
MOST_DOCUMENTS = 5
#: A document is depleted when fewer words than this, or a smaller share of its words, remain.
LEAST_WORDS = 5
LEAST_SHARE = 0.3
_WINDOW = 5


def words_of(text: Column, separators: str = SPACE) -> Column:
    return F.array_remove(F.split(text, separators, -1), "")


def _repeated_words(words: Column) -> Column:
    """Words in five-word windows found twice or more. Windows are compared by 64-bit hashes, and sorted only if some repeat."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - _WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(_WINDOW)]))

    def covered(hashes: Column) -> Column:
        order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(order, lambda o: F.filter(o, lambda x, k: x["h"].eqNullSafe(F.get(o, k - 1)["h"]) | x["h"].eqNullSafe(F.get(o, k + 1)["h"])))
        at = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return let(at, lambda a: F.aggregate(F.transform(a, lambda p, k: F.least(F.lit(_WINDOW), F.coalesce(F.get(a, k + 1) - p, F.lit(_WINDOW)))), F.lit(0).cast("long"), lambda s, x: s + x))

    some = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) >= _WINDOW, some).otherwise(F.lit(0).cast("long"))


def text_counts(rows: DataFrame) -> DataFrame:
    """rows with text replaced by n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    kept = [c for c in rows.columns if c != "text"]
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = rows.select(*kept, text.alias("_t"), words_of(text).alias("_w"), lines.alias("_l"))
    out = split.select(
        *kept, F.size("_w").cast("long").alias("n_words"), F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), _repeated_words(F.col("_w")).alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def normal_lines(text: Column) -> Column:
    """The lines that have a word, as structs of x (lower case, each run of digits as 0, white space as one space) and at (its place among all lines)."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), r"[\x20\x09\x0B-\x0D]+", " ")
    return F.filter(F.transform(F.split(flat, "\n", -1), lambda x, i: F.struct(F.trim(x).alias("x"), i.alias("at"))), lambda s: s["x"] != "")


def without_lines(text: Column, places: Column) -> Column:
    """The text without its lines at these places."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(places, i)), "\n")


_LINE = ["host", "line", "line2"]


def _lines(rows: DataFrame, counted: bool = False) -> DataFrame:
    """A row for each line: doc_id, content, host, line and line2 (its 128-bit hash), words, at (its place).

    If counted, each document has a line more, of zeros: its number of documents is that of the host.
    """
    own = F.transform(normal_lines(F.col("text")), lambda s: F.struct(F.xxhash64(s["x"]).alias("line"), F.xxhash64(F.lit(1), s["x"]).alias("line2"), F.size(F.split(s["x"], " ")).alias("words"), s["at"].alias("at")))
    if counted:
        zero = F.lit(0).cast("long")
        none = F.struct(zero.alias("line"), zero.alias("line2"), F.lit(0).alias("words"), F.lit(-1).alias("at"))
        own = F.concat(F.array(none), F.coalesce(own, F.array_remove(F.array(none), none)))
    return rows.select("doc_id", "content", "host", F.explode(own).alias("x")).select("doc_id", "content", "host", "x.line", "x.line2", "x.words", "x.at")


def frequent_lines(rows: DataFrame, most: int = MOST_DOCUMENTS, most_share: float = MOST_SHARE) -> DataFrame:
    """The hosts' lines that stand in more than this many different texts, and more than this share of all: host, line, line2, first (the document that keeps it).

    Copies of one text count once, so a page that is copied often isn't boilerplate for that; texts are told apart by 64-bit
    hashes. Both counts combine on the map side, so a line that stands in all documents moves a row for each task.
    """
    each = _lines(rows, counted=True).groupBy(*_LINE, "content").agg(F.min("doc_id").alias("first"))
    whole = (F.col("line") == 0) & (F.col("line2") == 0)
    often = each.groupBy(*_LINE).agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first")).filter(whole | (F.col("n") > most))
    often = materialize(often, "lines-and-hosts")
    hosts = often.filter(whole).select(F.col("host").alias("_host"), F.col("n").alias("_all"))
    out = often.filter(~whole).join(hosts, F.col("host").eqNullSafe(F.col("_host"))).filter(100 * F.col("n") > round(100 * most_share) * F.col("_all"))
    return materialize(out.select(*_LINE, "first"), "frequent-lines")


def removed_words(rows: DataFrame, most: int = MOST_DOCUMENTS, most_share: float = MOST_SHARE) -> DataFrame:
    """doc_id, content, removed (words in lines above the limit), places (of these lines) of the documents that have such lines.

    The frequent lines are a table of their own, so that Spark may broadcast it after a look at its size, and otherwise splits
    the partition of a line that is in a large share of the documents.
    """
    frequent = frequent_lines(rows, most, most_share)
    lines = _lines(rows)
    same = lines["host"].eqNullSafe(frequent["host"]) & (lines["line"] == frequent["line"]) & (lines["line2"] == frequent["line2"])
    hits = lines.join(frequent, same & ~lines["doc_id"].eqNullSafe(frequent["first"]))
    one = F.struct(lines["at"], lines["words"]).alias("one")  # copies of a row have the same, so a set has each line once
    by_row = hits.select(lines["doc_id"], lines["content"], one).groupBy("doc_id", "content").agg(F.collect_set("one").alias("all"))
    return by_row.select("doc_id", "content", F.aggregate("all", F.lit(0).cast("long"), lambda n, s: n + s["words"]).alias("removed"), F.transform("all", lambda s: s["at"]).alias("places"))


def _verdicts(docs: DataFrame, most: int, most_share: float, least_words: int, least_share: float, text: str, key: str, host: str) -> DataFrame:
    """What quality_rules returns, with the rows' own text and the places of the lines that go (null if none goes)."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(host).cast("string").alias("host"))
    rows = rows.withColumn("content", content_of("text"))
    gone = removed_words(rows, most, most_share).withColumnsRenamed({"doc_id": "_d", "content": "_c"})
    counted = text_counts(rows.select("doc_id", "content", F.col("text").alias("own"), "text"))
    out = counted.join(gone, counted["doc_id"].eqNullSafe(gone["_d"]) & (counted["content"] == gone["_c"]), "left").drop("_d", "_c")
    left = F.col("n_words") - F.least(F.coalesce("removed", F.lit(0)), F.col("n_words"))
    kept = ~F.col("base_failed") & (left >= least_words) & (100 * left >= round(100 * least_share) * F.col("n_words"))
    return out.withColumn("kept", kept).withColumn("removed_words", F.col("n_words") - left).drop("removed")


def quality_rules(docs: DataFrame, most: int = MOST_DOCUMENTS, most_share: float = MOST_SHARE, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE, text: str = "text", key: str = "doc_id", host: str = "source") -> DataFrame:
    """One row for each row: doc_id, content (a hash of the text), text (without its frequent lines), the counts of text_counts (of the whole text), removed_words and kept.

    Lines that stand in more than most different documents of a host, and in a larger share of them than most_share, are
    removed, but for the least doc_id that has the line; a document is kept if it passes the base rules and enough of its words remain. A null text counts as empty, so it fails; a
    null host is a host of its own; rows with a null doc_id keep no line as the first. Rows that repeat a doc_id and text count
    as one document and share a verdict, and the words of their lines count once. Other columns are left out, and an empty table
    gives no rows.
    """
    out = _verdicts(docs, most, most_share, least_words, least_share, text, key, host)
    clean = F.when(F.col("places").isNull(), F.col("own")).otherwise(without_lines(F.col("own"), F.col("places")))
    return out.withColumn("text", clean).drop("own", "places")


def keep_good(docs: DataFrame, most: int = MOST_DOCUMENTS, most_share: float = MOST_SHARE, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE, text: str = "text", key: str = "doc_id", host: str = "source") -> DataFrame:
    """The rows of docs that the rules keep, with their columns, and without the frequent lines in their texts; odd rows as in quality_rules."""
    verdicts = _verdicts(docs, most, most_share, least_words, least_share, text, key, host).filter(~F.col("kept") | F.col("places").isNotNull())
    verdicts = verdicts.groupBy(F.col("doc_id").alias("_d"), F.col("content").alias("_c")).agg(F.first("kept").alias("_kept"), F.first("places").alias("_places"))
    found = materialize(verdicts, "changed-or-rejected")
    found = found.hint("merge")  # it grows with the corpus, so small corpora go the way of large ones
    joined = docs.join(found, docs[key].eqNullSafe(found["_d"]) & (content_of(docs[text]) == found["_c"]), "left").filter(F.coalesce("_kept", F.lit(True)))
    clean = F.when(F.col("_places").isNull(), F.col(text)).otherwise(without_lines(F.col(text), F.col("_places")))
    return joined.withColumn(text, clean).select(*docs.columns)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """A row for each document: its counts, the base verdict, kept, and the words in frequent lines. Odd rows as in quality_rules."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("content", "text")


def oracle_op4() -> str:
    space = r"[\x20\x09-\x0D]+"
    return rf"""
    with d as (select doc_id, source, coalesce(text, '') as text from documents),
    w as (select doc_id, source, text, list_filter(string_split_regex(text, '{space}'), lambda x: x <> '') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
    g as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from w)),
    r as (select doc_id, i from g where (doc_id, g) in (select (doc_id, g) from g group by doc_id, g having count(*) > 1)),
    c as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from r) group by doc_id),
    n as (select doc_id, source, text, unnest(list_filter(list_transform(string_split(regexp_replace(regexp_replace(lower(text), '[0-9]+', '0', 'g'), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')) as line from d),
    h as (select source, count(distinct text) as n from d group by source),
    o as (select source, line, min(doc_id) as first, count(distinct text) as n from n group by source, line having count(distinct text) > {MOST_DOCUMENTS}),
    f as (select o.source, line, first from o join h on o.source is not distinct from h.source where 100 * o.n > {round(100 * MOST_SHARE)} * h.n),
    x as (select n.doc_id, sum(len(string_split(n.line, ' '))) as gone from n join f on n.source is not distinct from f.source and n.line = f.line and n.doc_id is distinct from f.first group by n.doc_id),
    a as (select w.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
      (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words, coalesce(x.gone, 0)::bigint as gone from w left join c on w.doc_id = c.doc_id left join x on w.doc_id = x.doc_id),
    b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, n_words - gone as rest from a)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rest >= {LEAST_WORDS} and 100 * rest >= {round(100 * LEAST_SHARE)} * n_words as kept, gone as removed_words from b"""
