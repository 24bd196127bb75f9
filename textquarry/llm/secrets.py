"""Secret scans: credential patterns, and sliding-window entropy over candidate strings. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let

#: Fixed patterns: kind, pattern, the group whose length counts, its least length.
_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
BASE = [
    ("assign", rf"""(?:{_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # the runs of at least 24: shorter ones fail
]
#: A candidate is a whole run of these; it needs a letter and a digit, as keys have: without that, long names and links of words pass for secrets.
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
#: kind, characters of the class, window, least bits a character. The last class has all of a candidate's characters; a candidate that an earlier one holds whole is left to that.
CLASSES = [("entropy16", r"^[0-9A-Fa-f]+$", 24, 3.0), ("entropy64", r"^[A-Za-z0-9+/=_-]+$", 20, 3.7)]
#: What is no secret: whole candidates (anchored) that are UUIDs, slugs or paths of plain words, and the parts of candidates that are samples or counting rows.
ALLOWED = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"EXAMPLE|[Ee]xample|[Ss]ample|[Pp]laceholder",
    r"^[A-Za-z]{2,}(?:[-_/][A-Za-z]{2,})*(?:[-_/=]?[0-9]{1,4})?$",
    r"0123456789|1234567890|abcdefghij|ABCDEFGHIJ",
]
KINDS = [kind for kind, *_ in BASE] + [kind for kind, *_ in CLASSES]
_SCALE = 1_000_000
_FIRST, _CODES = 43, 80  # codes of the candidates' characters, from +
_CHUNK = 256


def bits(count: int) -> int:
    """count * log2(count) in millionths: whole numbers, so that sums don't depend on their order."""
    return round(count * math.log2(count) * _SCALE) if count > 1 else 0


def most_bits(window: int, least: float) -> int:
    """The sum of bits() over a window's characters up to which its entropy is at least this."""
    return math.floor(window * (math.log2(window) - least) * _SCALE)


def _before(values: Column, first: int, step) -> Column:
    """For each value, what step makes of first and all values before it; by chunks, so that the work isn't quadratic.

    step is associative, and first changes nothing.
    """

    def running(array: Column) -> Column:
        return F.aggregate(array, F.array(F.lit(first).cast("long")), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))

    def joined(parts: Column) -> Column:
        return let(running(F.transform(parts, lambda p: F.element_at(p, -1))), lambda base: F.flatten(F.transform(parts, lambda p, i: F.transform(F.slice(p, 1, F.size(p) - 1), lambda v: step(v, F.get(base, i))))))

    return F.when(F.size(values) > 0, let(F.transform(_starts(values), lambda s: running(F.slice(values, s, _CHUNK))), joined)).otherwise(F.array().cast("array<bigint>"))


def _starts(array: Column) -> Column:
    """The place of each chunk's first element, from 1."""
    return F.sequence(F.lit(1), F.size(array), F.lit(_CHUNK))


def _places(text: Column, pattern: str, found: Column) -> Column:
    """Start and end, in code points, of each match that found lists."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g).cast("long"))
    sizes = F.transform(found, lambda m: F.char_length(m).cast("long"))

    def ends(g: Column, s: Column) -> Column:
        both = _before(F.zip_with(F.slice(g, 1, F.size(s)), s, lambda a, b: a + b), 0, lambda a, b: a + b)
        return F.transform(both, lambda b, i: F.struct((b + F.get(g, i)).alias("start"), (b + F.get(g, i) + F.get(s, i)).alias("end")))

    return let(gaps, lambda g: let(sizes, lambda s: ends(g, s)))


_SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"


def _base_spans(text: Column, rank: int) -> Column:
    _, pattern, group, least = BASE[rank]
    none = F.array().cast(_SPAN)

    def spans(found: Column) -> Column:
        value = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda v: F.transform(_places(text, pattern, found), lambda p, i: F.struct(p["start"].alias("start"), F.lit(rank).alias("rank"), p["end"].alias("end"), (F.char_length(F.get(v, i)) >= least).alias("ok"))))
        return F.transform(F.filter(value, lambda s: s["ok"]), lambda s: F.struct(s["start"], s["rank"], s["end"]))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, spans(found)).otherwise(none))


def _hot_windows(candidate: Column, window: int, least: float) -> Column:
    """Spans of the candidate whose windows reach the entropy, joined where they touch.

    The window moves by one character: its counts lose one and gain one, and the sum of count * log2(count) changes by
    these two counts alone.
    """
    table = F.array(*[F.lit(bits(n)).cast("long") for n in range(window + 2)])
    most = F.lit(most_bits(window, least))
    codes = F.transform(F.split(candidate, ""), lambda c: F.ascii(c) - _FIRST)

    def run(cs: Column) -> Column:
        counts = let(F.slice(cs, 1, window), lambda head: F.transform(F.sequence(F.lit(0), F.lit(_CODES - 1)), lambda k: F.size(F.filter(head, lambda c: c == k))))
        start = let(counts, lambda n: F.struct(n.alias("n"), F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + F.get(table, x)).alias("sum"), F.lit(-1).alias("open"), F.lit(-1).alias("until"), F.array().cast("array<struct<a:int,b:int>>").alias("out")))

        def move(s: Column, i: Column) -> Column:
            gone, come = F.get(cs, i - 1), F.get(cs, i + window - 1)
            same = (i == 0) | (gone == come)
            less, more = F.get(s["n"], gone), F.get(s["n"], come)
            counts = F.when(same, s["n"]).otherwise(F.transform(s["n"], lambda x, k: x + (k == come).cast("int") - (k == gone).cast("int")))
            total = F.when(same, s["sum"]).otherwise(s["sum"] - F.get(table, less) + F.get(table, less - 1) - F.get(table, more) + F.get(table, more + 1))

            def mark(total: Column) -> Column:
                hot, apart = total <= most, i > s["until"]
                return F.struct(
                    counts.alias("n"), total.alias("sum"), F.when(hot & apart, i).otherwise(s["open"]).alias("open"), F.when(hot, i + window).otherwise(s["until"]).alias("until"),
                    F.when(hot & apart & (s["open"] >= 0), F.concat(s["out"], F.array(F.struct(s["open"].alias("a"), s["until"].alias("b"))))).otherwise(s["out"]).alias("out"),
                )

            return let(total, mark)

        def end(s: Column) -> Column:
            return F.when(s["open"] >= 0, F.concat(s["out"], F.array(F.struct(s["open"].alias("a"), s["until"].alias("b"))))).otherwise(s["out"])

        return F.aggregate(F.sequence(F.lit(0), F.size(cs) - window), start, move, end)

    return F.when(F.char_length(candidate) >= window, let(codes, run)).otherwise(F.array().cast("array<struct<a:int,b:int>>"))


def _moved(by: Column, rank: int):
    return lambda w: F.struct((by + w["a"]).alias("start"), F.lit(rank).alias("rank"), (by + w["b"]).alias("end"))


def _is(rank: int):
    return lambda s: s["rank"] == rank


def _entropy_spans(text: Column) -> Column:
    """What lies between allowed parts of a candidate is judged by itself: as a whole by the widest class, and its runs of a narrower class by that class."""
    none = F.array().cast(_SPAN)
    within = "|".join(f"(?:{p})" for p in ALLOWED if not p.startswith("^"))

    def mixed(piece: Column) -> Column:
        return piece.rlike("[0-9]") & piece.rlike("[A-Za-z]")

    def of(piece: Column, at: Column) -> Column:
        good = mixed(piece)
        for pattern in ALLOWED:
            good = good & ~piece.rlike(pattern) if pattern.startswith("^") else good
        *narrow, (_, _, window, least) = CLASSES
        last = len(KINDS) - 1
        whole = F.transform(_hot_windows(piece, window, least), _moved(at, last))
        every, alone = [], F.lit(False)
        for rank, (_, members, window, least) in enumerate(narrow, len(BASE)):
            run = members.removeprefix("^").removesuffix("+$") + f"{{{window},}}"
            every.append(_runs(piece, run, at, rank, window, least, mixed))
            alone = alone | piece.rlike(members)
        return F.when(good, F.concat(*every, F.when(alone, none).otherwise(whole))).otherwise(none)

    def pieces(candidate: Column, place: Column) -> Column:
        allowed = let(F.regexp_extract_all(candidate, F.lit(within), F.lit(0)), lambda found: _places(candidate, within, found))
        return let(allowed, lambda ps: F.flatten(F.transform(F.split(candidate, within, -1), lambda c, i: of(c, place["start"] + F.coalesce(F.get(ps, i - 1)["end"], F.lit(0).cast("long"))))))

    def spans(found: Column) -> Column:
        return let(_places(text, CANDIDATE, found), lambda p: F.flatten(F.transform(found, lambda c, i: F.when(mixed(c), pieces(c, F.get(p, i))).otherwise(none))))

    return let(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda found: F.when(F.exists(found, lambda c: c.rlike("[0-9]")), spans(found)).otherwise(none))


def _runs(piece: Column, run: str, at: Column, rank: int, window: int, least: float, good) -> Column:
    """Spans of the runs of a class's characters in the piece."""
    none = F.array().cast(_SPAN)

    def spans(found: Column) -> Column:
        one = lambda r, p: F.when(good(r), F.transform(_hot_windows(r, window, least), _moved(at + p["start"], rank))).otherwise(none)
        return let(_places(piece, run, found), lambda ps: F.flatten(F.transform(found, lambda r, i: one(r, F.get(ps, i)))))

    return let(F.regexp_extract_all(piece, F.lit(run), F.lit(0)), spans)


def secret_spans(text: Column) -> Column:
    """All spans of a text: array of struct(start, rank in KINDS, end), by start, then kind, in code points, end exclusive."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.array_sort(F.concat(*[_base_spans(text, r) for r in range(len(BASE))], _entropy_spans(text)))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row: key, and found, all its spans.

    A null text counts as empty; null and repeated keys are kept as they are, and repeated rows have a row each; spans that start
    at one place stand in the order of their kinds; other columns are left out; an empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.select("doc_id", secret_spans(F.col("text")).alias("found"))


def _joined_spans(spans: Column) -> Column:
    """The spans, sorted by start, as structs (a, b) of which no two touch or overlap."""
    until = _before(F.transform(spans, lambda s: s["end"]), -1, F.greatest)

    def merged(u: Column) -> Column:
        heads = F.filter(F.transform(spans, lambda s, i: F.when(s["start"] > F.get(u, i), i)), lambda i: i.isNotNull())
        last = F.greatest(F.element_at(u, -1), F.element_at(spans, -1)["end"])
        return let(heads, lambda hs: F.transform(hs, lambda h, k: F.struct(F.get(spans, h)["start"].alias("a"), F.coalesce(F.get(u, F.get(hs, k + 1)), last).alias("b"))))

    return let(until, merged)


def _cut(text: Column, a: Column, b: Column) -> Column:
    return F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))


def _without(text: Column, spans: Column, mark: str) -> Column:
    """The text with each of the spans replaced; it is cut at every _CHUNK-th span first, so that no cut goes through all of it."""
    size = F.char_length(text).cast("long")

    def part(spans: Column, first: Column) -> Column:
        own = F.slice(spans, first, _CHUNK)
        lo = F.coalesce(F.get(spans, first - 2)["b"], F.lit(0).cast("long"))
        hi = F.when(first + _CHUNK > F.size(spans), size).otherwise(F.element_at(own, -1)["b"])

        def marked(x: Column) -> Column:
            pieces = F.transform(own, lambda s, i: F.concat(_cut(x, F.coalesce(F.get(own, i - 1)["b"], lo) - lo, s["a"] - lo), F.lit(mark)))
            return F.concat(F.array_join(pieces, ""), _cut(x, F.element_at(own, -1)["b"] - lo, hi - lo))

        return let(_cut(text, lo, hi), marked)

    return let(spans, lambda all_: F.array_join(F.transform(_starts(all_), lambda s: part(all_, s)), ""))


def redact(docs: DataFrame, mark: str = "[SECRET]", text: str = "text") -> DataFrame:
    """docs with every secret in text, spans that touch or overlap taken as one, replaced by mark. Nulls stay null, repeated rows stay."""
    source, spans, parts = F.col(text), "_secret_spans", "_secret_parts"
    found = docs.withColumn(spans, secret_spans(source))
    found = found.withColumn(parts, F.when(F.size(spans) > 0, _joined_spans(F.col(spans))))
    return found.withColumn(text, F.when(F.col(parts).isNull() | source.isNull(), source).otherwise(_without(source, F.col(parts), mark))).select(*docs.columns)


def op1_secret_scans(spark, sf_dir: str) -> DataFrame:
    """A row for each document: the counts of the base kinds, their digest, and all spans. Odd rows as in scan_secrets; an empty table gives no rows."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    counts = [F.size(F.filter("found", _is(r))).cast("long").alias(f"n_{kind}") for r, (kind, *_) in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def oracle_op1() -> str:
    """The same in DuckDB's SQL, with whole windows counted anew."""
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        p = pattern.replace("'", "''")
        parts.append(f"""select doc_id, {rank} as r, '{kind}' as kind, unnest(regexp_extract_all(text, '{p}')) as m, unnest(regexp_extract_all(text, '{p}', {group})) as v, unnest(string_split_regex(text, '{p}')[:-2]) as g, generate_subscripts(regexp_extract_all(text, '{p}'), 1) as i, {least} as least from d""")
    allowed = " and ".join(f"not regexp_matches(m, '{p}')" for p in ALLOWED if p.startswith("^"))
    within = "|".join(f"(?:{p})" for p in ALLOWED if not p.startswith("^"))
    *narrow, _ = CLASSES
    mixed = "regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Za-z]')"
    runs = " union all ".join(
        f"select doc_id, i || ':' || j as i, {rank} as class, s, unnest(regexp_extract_all(m, '{run}')) as m, unnest(string_split_regex(m, '{run}')[:-2]) as g, generate_subscripts(regexp_extract_all(m, '{run}'), 1) as k from good"
        for rank, (_, members, w, _) in enumerate(narrow, len(BASE)) for run in [members.removeprefix("^").removesuffix("+$") + f"{{{w},}}"]
    )
    alone = " and ".join(f"not regexp_matches(m, '{members}')" for _, members, _, _ in narrow)
    windows = " ".join(f"when {rank} then {w}" for rank, (_, _, w, _) in enumerate(CLASSES, len(BASE)))
    limits = " ".join(f"when {rank} then {most_bits(w, h)}" for rank, (_, _, w, h) in enumerate(CLASSES, len(BASE)))
    names = " ".join(f"when {rank} then '{kind}'" for rank, kind in enumerate(KINDS))
    parts.append(f"select doc_id, 9, 'x', unnest(regexp_extract_all(text, '{CANDIDATE}')), '', unnest(string_split_regex(text, '{CANDIDATE}')[:-2]), generate_subscripts(regexp_extract_all(text, '{CANDIDATE}'), 1), 0 from d")
    return f"""
    with d as (select doc_id, coalesce(text, '') as text from documents),
    raw as ({" union all ".join(parts)}),
    placed as (select *, sum(length(g) + length(m)) over (partition by doc_id, r order by i) as e from raw),
    base as (select doc_id, r, e - length(m) as s, e from placed where r < 9 and length(v) >= least),
    cand as (select doc_id, i, m, e - length(m) as s from placed where r = 9 and {mixed}),
    cuts as (select doc_id, i, s, unnest(string_split_regex(m, '{within}')) as m, generate_subscripts(string_split_regex(m, '{within}'), 1) as j, list_concat([''], regexp_extract_all(m, '{within}')) as gone from cand),
    piece as (select doc_id, i, j, m, s + sum(length(m) + length(gone[j])) over (partition by doc_id, i order by j) - length(m) as s from cuts),
    good as (select * from piece where {mixed} and {allowed}),
    run as (select doc_id, i, class, m, s + sum(length(g) + length(m)) over (partition by doc_id, i, class order by k) - length(m) as s, k from ({runs})),
    part as (select doc_id, i || ':' || class || ':' || k as i, class, m, s from run where {mixed} union all select doc_id, i || ':' || j as i, {len(KINDS) - 1}, m, s from good where {alone}),
    sized as (select *, case class {windows} end as w, case class {limits} end as most from part),
    win as (select doc_id, i, class, s, w, most, k, substr(m, k + 1, w) as t from (select *, unnest(range(0, length(m) - w + 1)) as k from sized)),
    chars as (select doc_id, i, class, s, w, most, k, unnest(string_split(t, '')) as c from win),
    tally as (select doc_id, i, class, s, w, most, k, c, count(*) as n from chars group by all),
    hot as (select doc_id, i, class, s, w, k from tally group by doc_id, i, class, s, w, k, most having sum(case when n > 1 then round(n * log2(n) * {_SCALE}) else 0 end) <= most),
    led as (select *, case when k > lag(k) over (partition by doc_id, i order by k) + w then 1 else 0 end as gap from hot),
    isle as (select *, sum(gap) over (partition by doc_id, i order by k) as b from led),
    ent as (select doc_id, class as r, s + min(k) as s, s + max(k) + w as e from isle group by doc_id, i, class, s, w, b),
    every as (select * from base union all select * from ent),
    txt as (select *, (case r {names} end) || ':' || s::bigint || ':' || e::bigint as x from every)
    select d.doc_id, count(case when r = 0 then 1 end) as n_assign, count(case when r = 1 then 1 end) as n_access, count(case when r = 2 then 1 end) as n_hex,
      sha256(coalesce(string_agg(case when r < {len(BASE)} then x end, ',' order by s, r), '')) as base_sha256, coalesce(string_agg(x, ',' order by s, r), '') as spans
    from d left join txt on d.doc_id = txt.doc_id group by d.doc_id"""
