"""URL filters: host and path rules, and a list of URLs behind a blocked Bloom filter and an exact join.

The filter is a table with a row for each block, and a page's bits are tested where it meets its block in a join: Spark sends a
small filter to all tasks, and deals a large one and the pages by blocks. So its size is no limit, and all runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: Rules and their verdicts.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: The query lists the pages whose URLs hold this, as links that someone tracks.
TRACKED = "utm_source="
#: A block of the filter is eight 32-bit words, one bit of each set for a URL; so many URLs go to a block.
WORDS = 8
URLS_IN_BLOCK = 20
# Odd multipliers that give each word of a block its bit, those of Parquet's split-block filter.
_SALTS = [0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31]


def host_of(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """host/path without scheme, www., default port, query, fragment and closing slash; empty if there is no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(?:80|443)$", ""), r"^www\.", "")
    return F.when(host == "", "").otherwise(F.concat(host, F.regexp_replace(path_of(url), "/+$", "")))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        top, slash, rest = text.partition("/")
        fits = ((host == top) | host.endswith("." + top)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return rule, verdict


def block_of(hash_: Column, blocks: int) -> Column:
    """The block of a 64-bit hash, by its upper half."""
    return F.shiftright(F.shiftrightunsigned(hash_, 32) * F.lit(blocks), 32)


def bits_of(hash_: Column) -> list[Column]:
    """The bit that a hash sets in each word of its block, by its lower half."""
    low = hash_.bitwiseAND(F.lit(0x7FFFFFFF))  # 31 bits, so that products stay within 64
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(low * F.lit(salt & 0x7FFFFFFF), 27).bitwiseAND(F.lit(31)).cast("int")) for salt in _SALTS]


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """A row for each block that has a URL of listed.hash: block, and its words w0 to w7."""
    marked = listed.select(block_of(F.col("hash"), blocks).alias("block"), *[bit.alias(f"w{i}") for i, bit in enumerate(bits_of(F.col("hash")))])
    return materialize(marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), "bloom-filter")


def with_maybe(rows: DataFrame, words: DataFrame, blocks: int) -> DataFrame:
    """rows (with a hash column _h) and maybe: whether the filter may hold the hash. It is never wrong where it says no."""
    joined = rows.withColumn("_b", block_of(F.col("_h"), blocks)).join(words, F.col("_b") == F.col("block"), "left")
    hit = F.col("block").isNotNull()
    for i, bit in enumerate(bits_of(F.col("_h"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(bit) != 0)
    return joined.select(*[rows[c] for c in rows.columns], F.coalesce(hit, F.lit(False)).alias("maybe"))


def listed_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """The tracked URLs of the pages, spelled as some lists do: the host in capitals, a slash and another query at the end."""
    text = F.col(url).cast("string")
    return pages.filter(text.contains(TRACKED)).select(F.concat(F.lit("HTTP://"), F.upper(host_of(text)), path_of(text), F.lit("/?listed")).alias("url"))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]] = RULES, url: str = "url", key: str = "page_id", listed_url: str = "url") -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, listed (its canonical URL is in the list), verdict.

    The verdict is the rule's, else block for listed URLs and allow for all others. Pages that the filter passes go on to the
    exact join; a page is there once however often the list has its URL, and as often as it is repeated. A null URL, or one
    without ://, has an empty host and path and is on no list; null keys are kept; other columns are left out; either table may
    be empty.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("_c"))
    rows = rows.withColumn("_h", F.xxhash64("_c"))
    names = listed.select(canonical(F.col(listed_url).cast("string")).alias("name")).filter("name <> ''").distinct()
    names = materialize(names.select("name", F.xxhash64("name").alias("hash")), "listed-urls")
    blocks = max(1, -(-names.count() // URLS_IN_BLOCK))
    tested = materialize(with_maybe(rows, bloom_filter(names, blocks), blocks), "tested-urls")  # URLs without the pages, read twice below
    maybe, never = tested.filter("maybe"), tested.filter("not maybe")
    exact = maybe.join(names, (maybe["_h"] == names["hash"]) & (maybe["_c"] == names["name"]), "left")
    both = exact.select("page_id", "host", "path", F.col("name").isNotNull().alias("listed")).unionByName(never.select("page_id", "host", "path", F.lit(False).alias("listed")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return both.select("page_id", "host", "path", rule.alias("rule"), "listed", F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def op9_url_filters(spark, sf_dir: str) -> DataFrame:
    """A row for each page: host, path, rule, listed and verdict. Odd rows as in filter_urls."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, listed_urls(pages))


def oracle_op9() -> str:
    rules = sorted(RULES, key=lambda r: -len(r[1]))
    fits = [(f"(host = '{t}' or ends_with(host, '.{t}')) and starts_with(path, '/{p}')", w, f"{t}/{p}") for w, text in rules for t, _, p in [text.partition("/")]]
    rule = " ".join(f"when {f} then '{text}'" for f, _, text in fits)
    verdict = " ".join(f"when {f} then '{w}'" for f, w, _ in fits)

    def parted(source: str) -> str:
        return rf"""select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from {source}"""

    name = r"case when host = '' then '' else regexp_replace(regexp_replace(host, ':(?:80|443)$', ''), '^www\.', '') || regexp_replace(path, '/+$', '') end"
    return rf"""
    with u as ({parted("pages")}),
    t as (select u.page_id, 'HTTP://' || upper(u.host) || u.path || '/?listed' as url from u join pages p on u.page_id = p.page_id where contains(p.url, '{TRACKED}')),
    l as (select distinct {name} as name from ({parted("t")})),
    c as (select *, {name} as name from u),
    f as (select *, name <> '' and name in (select name from l) as listed from c)
    select page_id, host, path, case {rule} end as rule, listed, case {verdict} when listed then 'block' else 'allow' end as verdict from f"""
