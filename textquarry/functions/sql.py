"""The functions under names for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources import ucd
from . import columns as C
from .columns import Unicode

#: Functions over whole batches, by their own names.
BATCHED = ("grapheme_count", "word_count", "display_width", "graphemes", "words", "grapheme_breaks", "code_points")
#: Steps of the library, one after the other.
_STEPS = {"to_nfc": (C.NFC,), "to_nfkc": (C.NFKC,), "to_nfd": (C.NFD,), "to_nfkd": (C.NFKD,), "casefold": (C.FOLD,), "canonical_key": C.CANONICAL, "compatibility_key": C.COMPATIBILITY}


def _quoted(text: str) -> str:
    return "r'" + text + "'" if "'" not in text else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession, **options) -> None:
    """Registers names for SQL, as temporary functions of the session.

    On texts: grapheme_count, word_count, display_width, graphemes, words, grapheme_breaks, code_points; to_nfc, to_nfd, to_nfkc,
    to_nfkd, normal_equal(a, b), casefold, canonical_key, compatibility_key; simple_upper, simple_lower, is_upper_text,
    is_lower_text, changes_when_casefolded; category_counts, script_counts, numeric_type_counts, property_counts (maps);
    wrap_text(text, columns, threshold), pad_left, pad_right and pad_center(text, total, pad), which give null where a text or a
    pad is too long; reverse_code_points. Nulls give null. options are those of Unicode.
    """
    u = Unicode(spark, **options)
    for name in BATCHED:
        spark.udf.register(f"_{name}", u.udf(name))
        spark.sql(f"create or replace temporary function {name}(t {'binary' if name == 'code_points' else 'string'}) returns {_kind(name)} return _{name}({'t' if name == 'code_points' else 'make_valid_utf8(t)'})")

    def define(name: str, arguments: str, kind: str, body: str) -> None:
        spark.sql(f"create or replace temporary function {name}({arguments}) returns {kind} return {body}")

    for name, steps in _STEPS.items():
        body = "make_valid_utf8(t)"
        for kind, method, more in steps:
            body = f"reflect('com.ibm.icu.{kind}', '{method}', {body}, {str(more).lower()})"
        define(name, "t string", "string", f"case when t is not null then {body} end")
    spark.udf.register("_wrap_text", u.wrap_udf())
    define("wrap_text", "t string, columns int, threshold int", "string", "_wrap_text(make_valid_utf8(t), columns, threshold)")
    define("normal_equal", "a string, b string", "boolean", "to_nfc(a) = to_nfc(b)")
    define("reverse_code_points", "t string", "string", "array_join(reverse(filter(split(t, ''), c -> c <> '')), '')")
    for name, table in (("simple_upper", u._t.simple_upper), ("simple_lower", u._t.simple_lower)):
        define(name, "t string", "string", f"translate(make_valid_utf8(t), '{''.join(map(chr, table))}', '{''.join(map(chr, table.values()))}')")
    flags = u._t.flags
    define("is_upper_text", "t string", "boolean", f"not rlike(t, {_quoted(u._class(flags['cased'] & ~flags['upper']))})")
    define("is_lower_text", "t string", "boolean", f"not rlike(t, {_quoted(u._class(flags['cased'] & ~flags['lower']))})")
    define("changes_when_casefolded", "t string", "boolean", f"rlike(t, {_quoted(u._class(flags['cwcf']))})")
    for name, counts, names in (("category_counts", "category_counts", ucd.GC), ("script_counts", "script_counts", [x or "none" for x in u._t.scripts]), ("numeric_type_counts", "numeric_type_counts", ucd.NT), ("property_counts", "flag_counts", list(ucd.FLAGS))):
        spark.udf.register(f"_{counts}", u.udf(counts))
        keys = ", ".join(f"'{x}'" for x in names)
        define(name, "t string", "map<string,bigint>", f"map_from_arrays(array({keys}), _{counts}(make_valid_utf8(t)))")
    pad = "display_width(pad)"
    for name, out in (("pad_left", "concat(repeat(pad, n), t)"), ("pad_right", "concat(t, repeat(pad, n))")):
        n = f"cast(floor((total - display_width(t)) / {pad}) as int)"
        define(name, "t string, total int, pad string", "string", f"case when total - display_width(t) >= {pad} then {out.replace('n)', n + ')')} end")
    side = f"cast(floor(floor((total - display_width(t)) / 2) / {pad}) as int)"
    more = "case when pmod(total, 2) <> pmod(display_width(t), 2) then 1 else 0 end"
    define("pad_center", "t string, total int, pad string", "string", f"case when total = display_width(t) then t when floor((total - display_width(t)) / 2) >= {pad} then concat(repeat(pad, {side}), t, repeat(pad, {side} + {more})) end")


def _kind(name: str) -> str:
    from .columns import CODE_POINT, SEGMENT

    return {"graphemes": SEGMENT, "words": SEGMENT, "code_points": CODE_POINT, "grapheme_breaks": "array<boolean>", "display_width": "int"}.get(name, "bigint").replace("long", "bigint")
