"""Unicode functions as columns. Null gives null throughout, and each ill-formed part of a text counts as U+FFFD."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..sources import ucd
from . import kernels

SEGMENT = "array<struct<offset:long,len:long,text:string>>"
CODE_POINT = "array<struct<code:int,len:int,offset:long>>"
CATEGORIES = {"control": "C", "letter": "L", "mark": "M", "number": "N", "punctuation": "P", "symbol": "S", "separator": "Z"}


def valid(text: Column) -> Column:
    """The text as well-formed UTF-8: each longest ill-formed part is U+FFFD."""
    return F.make_valid_utf8(text.cast("string"))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def is_latin1(text: Column) -> Column:
    """No code point above U+0100."""
    return ~text.rlike(r"[^\x{0}-\x{100}]")


#: Steps of the ICU library: class, method, and what to ask of it.
NFC, NFKC, NFD, NFKD = (("text.Normalizer", method, compat) for method in ("compose", "decompose") for compat in (False, True))
FOLD = ("lang.UCharacter", "foldCase", True)
CANONICAL, COMPATIBILITY = (NFD, FOLD, NFD), (NFD, FOLD, NFKD, FOLD, NFKD)


def _icu(text: Column, *steps: tuple) -> Column:
    """Spark calls the library's static methods in the JVM, one on the other's result; that must be a column of its own before joins and aggregates.

    Null is asked for once, of the text: asked of a step's result, it would evaluate all steps before once more.
    """
    out = valid(text)
    for kind, method, more in steps:
        out = F.reflect(F.lit(f"com.ibm.icu.{kind}"), F.lit(method), out, F.lit(more))
    return F.when(text.isNotNull(), out)


def nfc(text: Column) -> Column:
    return _icu(text, NFC)


def nfkc(text: Column) -> Column:
    return _icu(text, NFKC)


def nfd(text: Column) -> Column:
    return _icu(text, NFD)


def nfkd(text: Column) -> Column:
    return _icu(text, NFKD)


def normal_equal(a: Column, b: Column) -> Column:
    """Whether two texts are equal after NFC."""
    return nfc(a) == nfc(b)


def casefold(text: Column) -> Column:
    """Full case folding."""
    return _icu(text, FOLD)


def canonical_key(text: Column) -> Column:
    """Equal for texts that match without regard to case by canonical equivalence."""
    return _icu(text, *CANONICAL)


def compatibility_key(text: Column) -> Column:
    return _icu(text, *COMPATIBILITY)


# Lists of code points


def characters(text: Column) -> Column:
    """The code points as an array of texts."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def to_codes(text: Column) -> Column:
    """The code points as an array of numbers."""
    return _to_codes()(valid(text))


def from_codes(codes: Column) -> Column:
    """The text of an array of code points; what can't be in a text becomes U+FFFD."""
    return _from_codes()(codes.cast("array<int>"))


def nfd_codes(codes: Column) -> Column:
    """The canonical decomposition of an array of code points, in canonical order."""
    return to_codes(nfd(from_codes(codes)))


def nfkd_codes(codes: Column) -> Column:
    return to_codes(nfkd(from_codes(codes)))


def fold_codes(codes: Column) -> Column:
    """An array of code points with each folded; one may give up to three."""
    return to_codes(casefold(from_codes(codes)))


def reverse_code_points(text: Column) -> Column:
    return F.array_join(F.reverse(characters(text)), "")


# Places among segments or code points


def item_at(items: Column, index) -> Column:
    """The segment or code point that holds the byte at index, null beyond the text."""
    return F.get(F.filter(items, lambda x: (x["offset"] <= index) & (index < x["offset"] + x["len"])), F.lit(0))


def starting_at(items: Column, index) -> Column:
    return F.get(F.filter(items, lambda x: x["offset"] == index), F.lit(0))


def after(items: Column, item: Column) -> Column:
    return F.filter(items, lambda x: x["offset"] >= item["offset"] + item["len"])


def before(items: Column, item: Column) -> Column:
    """What precedes the item, nearest first."""
    return F.reverse(F.filter(items, lambda x: x["offset"] < item["offset"]))


def peek_ahead(items: Column, item: Column) -> Column:
    """What comes next after the item, null at the end."""
    return starting_at(items, item["offset"] + item["len"])


def peek_behind(items: Column, item: Column) -> Column:
    return F.get(F.filter(items, lambda x: x["offset"] + x["len"] == item["offset"]), F.lit(0))


def flip_back(items: Column, item: Column) -> Column:
    """What an iteration forward gives when it is turned at the item: the item once more, then what precedes it, nearest first."""
    return F.reverse(F.filter(items, lambda x: x["offset"] <= item["offset"]))


def flip_forth(items: Column, item: Column) -> Column:
    """What an iteration backward gives when it is turned at the item: the item once more, then what follows."""
    return F.filter(items, lambda x: x["offset"] >= item["offset"])


_sent: dict[tuple, object] = {}


def _send(spark: SparkSession, key: tuple, make):
    """A broadcast value, sent once for each application."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _sent:
        _sent[key] = spark.sparkContext.broadcast(make())
    return _sent[key]


class Unicode:
    """The functions that need property tables. Options change the display width only."""

    def __init__(self, spark: SparkSession, cjk: bool = False, c0_width: int | None = None, c1_width: int | None = None):
        self._t = t = ucd.tables(spark)
        self._sent = _send(spark, ("breaks",), lambda: (t.codes["gcb"], t.codes["incb"], t.codes["wb"], t.flags["ext_pict"]))
        self._width = _send(spark, ("width", cjk, c0_width, c1_width), lambda: t.width(cjk, c0_width, c1_width))
        self._classes = {name: (_send(spark, (name,), lambda name=name: t.codes[name]), size) for name, size in (("gc", len(ucd.GC)), ("nt", len(ucd.NT)), ("script", len(t.scripts)))}
        self._bits = _send(spark, ("flags",), lambda: sum(t.flags[name].astype("uint16") << np.uint16(i) for i, name in enumerate(ucd.FLAGS)))
        self._udfs: dict[str, object] = {}

    def _class(self, mask: np.ndarray) -> str:
        return ucd.char_class(self._t.ranges(mask))

    def udf(self, name: str):
        """The Arrow function of this name: graphemes, words, grapheme_count, word_count, grapheme_breaks, code_points, display_width, category_counts, numeric_type_counts, script_counts, flag_counts.

        Its text must be well-formed. The same object each time, so that Spark evaluates what is asked for twice once.
        """
        if name not in self._udfs:
            sent, taken = self._sent, self._width
            grapheme = lambda c: kernels.grapheme_breaks(c, sent.value[0], sent.value[1], sent.value[3])
            word = lambda c: kernels.word_breaks(c, sent.value[2], sent.value[3])

            def number(values: np.ndarray, flat: kernels.Flat, kind: pa.DataType) -> pa.Array:
                return pa.array(values, kind, mask=flat.null)

            def many(values: np.ndarray, flat: kernels.Flat) -> pa.Array:
                return kernels.lists(np.full(len(values), values.shape[1]), pa.array(values.ravel(), pa.int64()), flat.null)

            def classes(which: str):
                table, n = self._classes[which]
                return "array<long>", lambda f: many(kernels.class_counts(f, table.value, n), f)

            def breaks(f: kernels.Flat) -> pa.Array:
                own = np.ones(len(f.codes), bool)
                own[f.heads] = False
                return kernels.lists(np.diff(f.heads) - 1, pa.array(grapheme(f.codes)[own]), f.null)

            bits = self._bits
            work = {
                "graphemes": lambda: (SEGMENT, lambda f: kernels.segments(f, grapheme(f.codes))),
                "words": lambda: (SEGMENT, lambda f: kernels.segments(f, word(f.codes))),
                "grapheme_count": lambda: ("long", lambda f: number(kernels.per_text(grapheme(f.codes), f.heads), f, pa.int64())),
                "word_count": lambda: ("long", lambda f: number(kernels.per_text(word(f.codes), f.heads), f, pa.int64())),
                "grapheme_breaks": lambda: ("array<boolean>", breaks),
                "display_width": lambda: ("int", lambda f: number(kernels.widths(f, grapheme, taken.value), f, pa.int32())),
                "category_counts": lambda: classes("gc"),
                "numeric_type_counts": lambda: classes("nt"),
                "script_counts": lambda: classes("script"),
                "flag_counts": lambda: ("array<long>", lambda f: many(kernels.flag_counts(f, bits.value, len(ucd.FLAGS)), f)),
            }
            if name == "code_points":
                self._udfs[name] = _arrow_parts(CODE_POINT, kernels.decoded)
            else:
                kind, run = work[name]()
                self._udfs[name] = (_arrow_parts if kind == SEGMENT else _arrow)(kind, lambda texts: run(kernels.flatten(texts)))
        return self._udfs[name]

    def code_points(self, text: Column) -> Column:
        """Array of struct(code, len, offset) of a text or of bytes that may not be UTF-8."""
        return self.udf("code_points")(text.cast("binary"))

    def graphemes(self, text: Column) -> Column:
        return self.udf("graphemes")(valid(text))

    def words(self, text: Column) -> Column:
        return self.udf("words")(valid(text))

    def grapheme_breaks(self, text: Column) -> Column:
        """For each code point, whether a grapheme cluster begins there."""
        return self.udf("grapheme_breaks")(valid(text))

    def grapheme_count(self, text: Column) -> Column:
        return self.udf("grapheme_count")(valid(text))

    def word_count(self, text: Column) -> Column:
        return self.udf("word_count")(valid(text))

    def display_width(self, text: Column) -> Column:
        return self.udf("display_width")(valid(text))

    def wrap(self, text: Column, columns: int, threshold: int) -> Column:
        """Lines of words; a line ends once it is over the columns, or no further from them than the threshold."""
        sent, taken = self._sent, self._width
        grapheme = lambda c: kernels.grapheme_breaks(c, sent.value[0], sent.value[1], sent.value[3])
        return _arrow("string", lambda texts: kernels.wrap(kernels.flatten(texts), columns, threshold, grapheme, taken.value))(valid(text))

    def wrap_udf(self):
        """The same as an Arrow function of texts, columns and thresholds, which may differ from row to row."""
        sent, taken = self._sent, self._width
        grapheme = lambda c: kernels.grapheme_breaks(c, sent.value[0], sent.value[1], sent.value[3])

        @F.arrow_udf("string")
        def run(texts: pa.Array, columns: pa.Array, thresholds: pa.Array) -> pa.Array:
            out = np.full(len(texts), None, dtype=object)
            asked = np.array(list(zip(columns.to_pylist(), thresholds.to_pylist(), strict=True)), dtype=object).reshape(-1, 2)
            for pair in {tuple(x) for x in asked if None not in tuple(x)}:
                rows = np.flatnonzero((asked == pair).all(axis=1))
                done = [kernels.wrap(kernels.flatten(part), *pair, grapheme, taken.value) for part in kernels.parts(texts.take(pa.array(rows)))]
                out[rows] = pa.concat_arrays(done).to_pylist()
            return pa.array(out, pa.string())

        return run

    def _padded(self, text: Column, total: int, pad: str, strict: bool, side: str) -> Column:
        width = self.display_width(text)
        t = self._sent.value
        one = int(kernels.widths(kernels.flatten([pad]), lambda c: kernels.grapheme_breaks(c, t[0], t[1], t[3]), self._width.value)[0])
        if one < 1:
            raise ValueError("the pad has no width")
        room = total - width
        if side == "centre":
            half = F.floor(room / 2)
            n = F.floor(half / one).cast("int")
            more = (F.pmod(F.lit(total), F.lit(2)) != F.pmod(width, F.lit(2))).cast("int")
            out = F.concat(F.repeat(F.lit(pad), n), valid(text), F.repeat(F.lit(pad), n + more))
            good, bad = half >= one, F.when(room == 0, valid(text))
        else:
            fill = F.repeat(F.lit(pad), F.floor(room / one).cast("int"))
            out = F.concat(fill, valid(text)) if side == "left" else F.concat(valid(text), fill)
            good, bad = room >= one, None
        error = lambda name: F.raise_error(F.lit(name)).cast("string") if strict else F.lit(None).cast("string")
        chosen = F.when(text.isNull(), F.lit(None).cast("string")).when(room < 0, error("StrTooLong"))
        if bad is not None:
            chosen = chosen.when(room == 0, valid(text))
        return chosen.when(good, out).otherwise(error("PadTooLong"))

    def center(self, text: Column, total: int, pad: str, strict: bool = True) -> Column:
        """Errors where the text or the pad is too long; null instead unless strict."""
        return self._padded(text, total, pad, strict, "centre")

    def pad_left(self, text: Column, total: int, pad: str, strict: bool = True) -> Column:
        return self._padded(text, total, pad, strict, "left")

    def pad_right(self, text: Column, total: int, pad: str, strict: bool = True) -> Column:
        return self._padded(text, total, pad, strict, "right")

    def _translated(self, text: Column, table: dict[int, int]) -> Column:
        return F.translate(valid(text), "".join(map(chr, table)), "".join(map(chr, table.values())))

    def to_upper(self, text: Column) -> Column:
        """Simple mappings, one code point for one."""
        return self._translated(text, self._t.simple_upper)

    def to_lower(self, text: Column) -> Column:
        return self._translated(text, self._t.simple_lower)

    def is_upper(self, text: Column) -> Column:
        """No cased code point that isn't upper case."""
        return ~text.rlike(self._class(self._t.flags["cased"] & ~self._t.flags["upper"]))

    def is_lower(self, text: Column) -> Column:
        return ~text.rlike(self._class(self._t.flags["cased"] & ~self._t.flags["lower"]))

    def changes_when_casefolded(self, text: Column) -> Column:
        return text.rlike(self._class(self._t.flags["cwcf"]))

    def word_reverse(self, text: Column) -> Column:
        """The words from the last to the first."""
        return F.reverse(self.words(text))

    def grapheme_reverse(self, text: Column) -> Column:
        """The grapheme clusters from the last to the first."""
        return F.reverse(self.graphemes(text))

    def count_flag(self, text: Column, name: str) -> Column:
        """Code points of the text with a property of ucd.FLAGS."""
        return F.get(self.udf("flag_counts")(valid(text)), F.lit(list(ucd.FLAGS).index(name)))

    def count_category(self, text: Column, name: str) -> Column:
        """Code points of a general category (Lu), or of a group: control, letter, mark, number, punctuation, symbol, separator."""
        counts, prefix = self.udf("category_counts")(valid(text)), CATEGORIES.get(name, name)
        out = [F.get(counts, F.lit(i)) for i, x in enumerate(ucd.GC) if x.startswith(prefix)]
        return sum(out[1:], out[0])

    def count_numeric(self, text: Column, name: str) -> Column:
        """Code points of a numeric type: Decimal, Digit or Numeric, which exclude each other."""
        return F.get(self.udf("numeric_type_counts")(valid(text)), F.lit(ucd.NT.index(name)))

    def count_script(self, text: Column, name: str) -> Column:
        return F.get(self.udf("script_counts")(valid(text)), F.lit(self._t.scripts.index(name)))


def _arrow(kind: str, work):
    """A column function over Arrow batches, which are worked on in parts of bounded bytes; for results smaller than the texts, or about as large."""

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        done = [work(part) for part in kernels.parts(texts)]
        return done[0] if len(done) == 1 else pa.concat_arrays(done)

    return run


def _arrow_parts(kind: str, work):
    """The same for results many times larger than the texts: each part is given back as a batch of its own, so that none is held whole."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in kernels.parts(texts):
                yield work(part)

    return run


@cache
def _to_codes():
    return _arrow_parts("array<int>", kernels.codes_of)


@cache
def _from_codes():
    return _arrow("string", kernels.text_of)
