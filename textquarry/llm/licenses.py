"""License scans: phrases, and diagonal voting of word k-grams against license templates. DataFrame functions only."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Phrases and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
SPACES = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Notices of common licenses, as their authors ask for them to be given, and their labels.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
]
K = 3
#: Diagonals this far apart at most are one: words were put in or left out between their matches.
GAP = 3
#: The share of a template's words that a span must match for its label.
SHARE = 0.8
#: Template k-grams up to which the templates are sent to all tasks; more are joined by a shuffle.
MOST_SENT = 100_000


def words_of(text: Column) -> Column:
    """The words, with A-Z lower-cased and no other letters."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), SPACES, -1), "")


def _words(text: str) -> list[str]:
    import re

    return [w for w in re.split(SPACES, text.lower()) if w]


def template_grams(templates: list[tuple[str, str]] = TEMPLATES, k: int = K) -> list[tuple]:
    """(template, label, its words, k-gram's position, the k words)."""
    out = []
    for t, (label, text) in enumerate(templates):
        words = _words(text)
        out += [(t, label, len(words), i, *words[i : i + k]) for i in range(len(words) - k + 1)]
    return out


def _places(words: Column, j: Column) -> Column:
    """Struct(start, label's place in PHRASES) of each phrase; the words are only walked through if a phrase is there."""

    def starts(phrase: str, i: Column) -> Column:
        hit = F.lit(True)
        for n, word in enumerate(phrase.split(" ")):
            hit = hit & F.get(words, i + n).eqNullSafe(F.lit(word))
        return hit

    def each(i: Column) -> Column:
        out = F.lit(None).cast("int")
        for rank, (phrase, _) in enumerate(PHRASES):
            out = F.when(starts(phrase, i), rank).otherwise(out)
        return F.struct(i.cast("long").alias("start"), out.alias("rank"))

    some = j.rlike("(?:^| )(?:" + "|".join(p for p, _ in PHRASES) + ")(?: |$)")
    return F.when(some, F.filter(F.transform(F.sequence(F.lit(0), F.size(words) - 1), each), lambda x: x["rank"].isNotNull())).otherwise(F.array().cast("array<struct<start:bigint,rank:int>>"))


def diagonal_votes(rows: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, k: int = K, gap: int = GAP) -> DataFrame:
    """For each row's key columns (all but text) and span: label, template, first and last word of the span, share of the template.

    Every k-gram of the texts is joined to the templates' k-grams by hash and words; places with one difference of positions
    are a diagonal, and diagonals at most gap apart are merged. A span is then verified from its first place to its last: only
    matches that go on in the template's order count, the share is that of the template's words they cover, and it is 0 where
    they take more than twice the template's words of the text.
    """
    spark: SparkSession = rows.sparkSession
    keys = [c for c in rows.columns if c != "text"]
    parts = [f"g{i}" for i in range(k)]
    grams = template_grams(templates, k)
    kinds = ", ".join(f"t{i} string" for i in range(k))
    side = spark.createDataFrame(grams, f"template int, label string, size int, at int, {kinds}")
    side = side.withColumn("hash", F.xxhash64(*[f"t{i}" for i in range(k)]))
    words = rows.select(*keys, words_of(F.col("text")).alias("_w")).filter(F.size("_w") >= k)
    each = F.transform(F.sequence(F.lit(0), F.size("_w") - k), lambda i: F.struct(i.alias("pos"), *[F.get(F.col("_w"), i + n).alias(p) for n, p in enumerate(parts)]))
    exploded = words.select(*keys, F.explode(each).alias("_x")).select(*keys, "_x.*").withColumn("_hash", F.xxhash64(*parts))
    on = exploded["_hash"] == side["hash"]
    for i, p in enumerate(parts):
        on = on & (exploded[p] == side[f"t{i}"])
    hits = exploded.join(F.broadcast(side) if len(grams) <= MOST_SENT else side, on).select(*keys, "template", "label", "size", "at", "pos", (F.col("pos") - F.col("at")).alias("diagonal"))
    near = Window.partitionBy(*keys, "template").orderBy("diagonal", "at")
    led = hits.withColumn("_new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(near) > gap).cast("int"), F.lit(1)))
    merged = led.withColumn("_span", F.sum("_new").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy(*keys, "template", "label", "size", "_span").agg(F.array_sort(F.collect_set(F.struct("pos", "at"))).alias("_hits"))
    none = F.struct(F.lit(-1).alias("pos"), F.lit(-k).alias("top"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def on(s: Column, x: Column) -> Column:
        """The next hit counts if its place in the template is beyond all before; of hits at one word, the first is looked at."""
        fresh, ahead = x["pos"] != s["pos"], x["at"] > s["top"]
        return F.struct(
            x["pos"].alias("pos"), F.when(fresh & ahead, x["at"]).otherwise(s["top"]).alias("top"), (s["n"] + F.when(fresh & ahead, F.least(F.lit(k), x["at"] - s["top"])).otherwise(0)).alias("n"),
            F.coalesce(s["first"], x["pos"]).alias("first"), F.when(fresh & ahead, x["pos"]).otherwise(s["last"]).alias("last"),
        )

    chained = spans.select(*keys, "label", "template", "size", F.aggregate("_hits", none, on).alias("_c"))
    words = F.col("_c.last") + k - F.col("_c.first")
    share = F.when(words <= 2 * F.col("size"), F.col("_c.n") / F.col("size")).otherwise(F.lit(0.0))
    return chained.select(*keys, "label", "template", F.col("_c.first").cast("long").alias("first"), (F.col("_c.last") + k - 1).cast("long").alias("last"), share.alias("share"))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, share: float = SHARE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row: doc_id, content (a hash of the text), n_words, places (phrases), found (templates), score.

    found lists struct(label, first, last, share) of the spans with at least this share, first and last being words from 0.
    score is 1 where a phrase stands, else the greatest share of any span, else 0. A null text counts as empty. Rows that repeat
    a doc_id and text have the same result; null keys are kept; other columns are left out; an empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("content", F.xxhash64(F.coalesce("text", F.lit(""))))
    base = rows.select("doc_id", "content", words_of(F.col("text")).alias("_w"))
    base = base.select("doc_id", "content", F.size("_w").cast("long").alias("n_words"), _places(F.col("_w"), F.array_join("_w", " ")).alias("places"))
    spans = diagonal_votes(rows, templates)
    good = F.when(F.col("share") >= share, F.struct("label", "first", "last", "share"))
    by_row = spans.groupBy(F.col("doc_id").alias("_d"), F.col("content").alias("_c")).agg(F.array_sort(F.collect_set(good)).alias("found"), F.max("share").alias("best"))
    out = base.join(by_row, base["doc_id"].eqNullSafe(by_row["_d"]) & (base["content"] == by_row["_c"]), "left")
    none = F.array().cast(by_row.schema["found"].dataType)
    return out.select("doc_id", "content", "n_words", "places", F.coalesce("found", none).alias("found"), F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def op6_license_scans(spark, sf_dir: str) -> DataFrame:
    """A row for each document: its words, its phrases, labels and score. Odd rows as in scan_licenses."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.array(*[F.lit(label) for _, label in PHRASES])
    base = F.array_distinct(F.transform("places", lambda p: F.get(names, p["rank"])))
    own = F.transform("found", lambda x: x["label"])
    starts = F.transform("places", lambda p: p["start"])
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"), "score",
    )


def oracle_op6() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({t}, {q(label)}, {size}, {at}, {q(' '.join(w))})" for t, label, size, at, *w in template_grams())
    phrases = " union all ".join(f"select doc_id, i, {q(label)} as label from p where array_to_string(w[i:i + {len(p.split()) - 1}], ' ') = {q(p)}" for p, label in PHRASES)
    return rf"""
    with w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{SPACES}'), lambda x: x <> '') as w from documents),
    p as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from w),
    base as ({phrases}),
    b as (select doc_id, count(*) as n, min(i) - 1 as first_word, max(i) - 1 as last_word, list_distinct(list(label)) as labels from base group by doc_id),
    t(template, label, size, tp, g) as (values {rows}),
    h as (select doc_id, template, label, size, tp, i - 1 as pos, i - 1 - tp as diagonal from p join t on array_to_string(w[i:i + {K - 1}], ' ') = g where i <= len(w) - {K - 1}),
    l as (select *, case when diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal, tp) <= {GAP} then 0 else 1 end as fresh from h),
    m as (select *, sum(fresh) over (partition by doc_id, template order by diagonal, tp) as span from l),
    a as (select doc_id, template, label, size, span, pos, min(tp) as tp from m group by all),
    z as (select *, coalesce(max(tp) over (partition by doc_id, template, span order by pos rows between unbounded preceding and 1 preceding), -{K}) as top from a),
    c as (select doc_id, template, label, size, span, case when max(pos) + {K} - min(pos) <= 2 * size then sum(least({K}, tp - top)) / size else 0 end as share from z where tp > top group by doc_id, template, label, size, span),
    s as (select doc_id, max(share) as best, list_distinct(list(case when share >= {SHARE} then label end)) as labels from c group by doc_id)
    select w.doc_id, len(w)::bigint as n_words, coalesce(b.n, 0) as n_base, b.first_word, b.last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') as base_labels,
      coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), list_filter(coalesce(s.labels, []), lambda x: x is not null)))), ','), '') as labels, case when b.n > 0 then 1.0 else coalesce(s.best, 0.0) end::double as score
    from w left join b on w.doc_id = b.doc_id left join s on w.doc_id = s.doc_id"""
