"""Segmentation, width, wrapping and counts over whole Arrow batches of texts, in NumPy. No Spark here.

A batch becomes one array of code points with a line feed before each text; no segment crosses a line feed, so that texts don't
affect each other, and all rules are evaluated for all places at once. Segments are given as views of the batch's own bytes.

That takes some hundred bytes for each byte of text, so batches are cut to parts before: a batch is limited by its rows only.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..sources.ucd import GCB, INCB, WB


#: Bytes of text worked on at once.
PART = 1 << 18


def parts(values: pa.Array, limit: int = PART) -> Iterator[pa.Array]:
    """The batch's rows in order, in slices of some limit bytes (a text that is longer is one by itself); a batch without rows is one slice."""
    listed = pa.types.is_list(values.type) or pa.types.is_large_list(values.type)
    sizes = pc.fill_null(pc.list_value_length(values) if listed else pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(sizes, dtype="int64")
    at = done = 0
    while True:
        end = max(at + 1, int(np.searchsorted(upto, done + limit, "right")))
        yield values[at:end]
        if end >= len(values):
            return
        at, done = end, int(upto[end - 1])


@dataclass
class Flat:
    """The texts of a batch in a row.

    data has their bytes; codes their code points, with a line feed before each text and after the last; heads is the place of
    these line feeds in codes; place the byte in data at which each code point begins (a line feed put there: the next one);
    starts the byte at which each text begins, and the end of the last; null says which texts aren't there.
    """

    data: np.ndarray
    codes: np.ndarray
    heads: np.ndarray
    place: np.ndarray
    starts: np.ndarray
    null: np.ndarray


def flatten(texts: pa.Array | list[str | None]) -> Flat:
    """A batch of well-formed texts in a row; nulls are empty."""
    found = pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())
    null = found.is_null().to_numpy(zero_copy_only=False)
    found = found.fill_null("") if null.any() else found
    n = len(found)
    ends = np.frombuffer(found.buffers()[1], "<i4", n + 1, 4 * found.offset).astype("int64") if n else np.zeros(1, "int64")
    raw = found.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8)
    starts = ends - ends[0]
    breaks = starts + np.arange(n + 1)
    mixed = np.empty(len(data) + n + 1, np.uint8)
    own = np.ones(len(mixed), bool)
    own[breaks] = False
    mixed[own], mixed[breaks] = data, 10
    lead = (mixed & 0xC0) != 0x80
    codes = np.frombuffer(mixed.tobytes().decode().encode("utf-32-le"), "<u4").astype("int32")
    at = np.flatnonzero(lead)
    return Flat(data, codes, np.cumsum(lead)[breaks] - 1, at - np.cumsum(~own)[at] + ~own[at], starts, null)


def _last(mask: np.ndarray) -> np.ndarray:
    """For each place, the last place up to it where mask holds, or -1."""
    return np.maximum.accumulate(np.where(mask, np.arange(len(mask)), -1))


def _odd_run(member: np.ndarray) -> np.ndarray:
    """Whether the members just before each place are odd in number."""
    since = np.arange(len(member)) - _last(~member)  # members in a row up to here, this one included
    return np.concatenate([[False], since[:-1] % 2 == 1])


def grapheme_breaks(codes: np.ndarray, gcb: np.ndarray, incb: np.ndarray, pict: np.ndarray) -> np.ndarray:
    """Whether a grapheme cluster begins at each place."""
    g, b, x = gcb[codes], incb[codes], pict[codes]
    cr, lf, control, extend, zwj, ri, prepend, spacing, hl, hv, ht, hlv, hlvt = range(1, len(GCB))
    p, c = g[:-1], g[1:]
    stop = np.isin(g, [cr, lf, control])
    join = np.isin(c, [extend, zwj, spacing]) | (p == prepend)
    if (g >= hl).any():
        join |= (p == hl) & np.isin(c, [hl, hv, hlv, hlvt]) | np.isin(p, [hlv, hv]) & np.isin(c, [hv, ht]) | np.isin(p, [hlvt, ht]) & (c == ht)
    consonant, inner, linker = range(1, len(INCB))
    if (b == linker).any():
        base = _last(~np.isin(b, [inner, linker]))[:-1]
        links = np.cumsum(b == linker)
        join |= (b[1:] == consonant) & (base >= 0) & (b[base] == consonant) & (links[:-1] > links[base])
    if (g == zwj).any():
        before = np.concatenate([[-1], _last(g != extend)[:-2]])  # the last that isn't Extend before the one before
        join |= (p == zwj) & x[1:] & (before >= 0) & x[before]
    if (g == ri).any():
        join |= (p == ri) & (c == ri) & _odd_run(g == ri)[1:]
    join &= ~stop[:-1] & ~stop[1:]
    join |= (p == cr) & (c == lf)
    return np.concatenate([[True], ~join])


def word_breaks(codes: np.ndarray, wb: np.ndarray, pict: np.ndarray) -> np.ndarray:
    """Whether a word segment begins at each place."""
    w, x = wb[codes], pict[codes]
    of = {name: i for i, name in enumerate(WB)}
    line = np.isin(w, [of["CR"], of["LF"], of["Newline"]])
    skip = np.isin(w, [of["Extend"], of["Format"], of["ZWJ"]])
    skip[0] = False
    skip[1:] &= ~line[:-1]
    kept = np.flatnonzero(~skip)
    k = w[kept]
    none = np.zeros(1, k.dtype)
    back2, back, now, ahead = np.concatenate([none, none, k[:-2]])[: len(k)], np.concatenate([none, k[:-1]]), k, np.append(k[1:], none)
    letter = lambda a: (a == of["ALetter"]) | (a == of["Hebrew_Letter"])
    between = lambda a, *names: np.isin(a, [of[n] for n in names])
    mid_letter = lambda a: between(a, "MidLetter", "MidNumLet", "Single_Quote")
    mid_number = lambda a: between(a, "MidNum", "MidNumLet", "Single_Quote")
    hebrew, quote, number, kata, low, ri = (of[n] for n in ("Hebrew_Letter", "Double_Quote", "Numeric", "Katakana", "ExtendNumLet", "Regional_Indicator"))
    join = letter(back) & letter(now) | letter(back) & mid_letter(now) & letter(ahead) | letter(back2) & mid_letter(back) & letter(now)
    join |= (back == hebrew) & ((now == of["Single_Quote"]) | (now == quote) & (ahead == hebrew)) | (back2 == hebrew) & (back == quote) & (now == hebrew)
    join |= (back == number) & (now == number) | letter(back) & (now == number) | (back == number) & letter(now)
    join |= (back2 == number) & mid_number(back) & (now == number) | (back == number) & mid_number(now) & (ahead == number)
    join |= (back == kata) & (now == kata)
    wordy = lambda a: letter(a) | (a == number) | (a == kata)
    join |= (wordy(back) | (back == low)) & (now == low) | (back == low) & wordy(now)
    join |= (back == ri) & (now == ri) & _odd_run(k == ri)
    out = np.zeros(len(w), bool)
    out[kept] = ~join
    p, c = w[:-1], w[1:]
    out[1:] &= ~((p == of["ZWJ"]) & x[1:] | (p == of["WSegSpace"]) & (c == of["WSegSpace"]))
    out[1:] |= line[:-1] | line[1:]
    out[1:] &= ~((p == of["CR"]) & (c == of["LF"]))
    out[0] = True
    return out


def per_text(marks: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The sum of the marks of each text's code points."""
    total = np.concatenate([[0], np.cumsum(marks, dtype="int64")])
    return total[heads[1:]] - total[heads[:-1] + 1]


def class_counts(flat: Flat, classes: np.ndarray, n: int) -> np.ndarray:
    """For each text a row with the number of its code points of each of n classes."""
    texts = len(flat.heads) - 1
    own = np.ones(len(flat.codes), bool)
    own[flat.heads] = False
    text = np.repeat(np.arange(texts), np.diff(flat.heads) - 1)
    return np.bincount(text * n + classes[flat.codes[own]], minlength=texts * n).reshape(texts, n)


def flag_counts(flat: Flat, bits: np.ndarray, n: int) -> np.ndarray:
    """For each text a row with the number of its code points that have each of n flags; bits has a bit for each flag."""
    own = bits[flat.codes]
    own[flat.heads] = 0
    return np.stack([per_text(own >> i & 1, flat.heads) for i in range(n)], axis=1)


def lists(counts: np.ndarray, values: pa.Array, null: np.ndarray) -> pa.ListArray:
    """The values dealt to lists with these numbers of elements."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values, mask=pa.array(null) if null.any() else None)


def segments(flat: Flat, breaks: np.ndarray) -> pa.ListArray:
    """For each text its segments: offset and len in UTF-8 bytes, text."""
    is_head = np.zeros(len(breaks), bool)
    is_head[flat.heads] = True
    first = np.flatnonzero(breaks & ~is_head)
    edge = np.append(flat.place[first], len(flat.data))
    counts = per_text(breaks & ~is_head, flat.heads)
    offset = edge[:-1] - np.repeat(flat.starts[:-1], counts)
    text = pa.StringArray.from_buffers(len(first), pa.py_buffer(edge.astype("<i4")), pa.py_buffer(np.ascontiguousarray(flat.data)))
    struct = pa.StructArray.from_arrays([pa.array(offset, pa.int64()), pa.array(np.diff(edge), pa.int64()), text], ["offset", "len", "text"])
    return lists(counts, struct, flat.null)


def code_points(flat: Flat) -> pa.ListArray:
    """For each text its code points: code, len and offset in UTF-8 bytes."""
    own = np.ones(len(flat.codes), bool)
    own[flat.heads] = False
    counts = np.diff(flat.heads) - 1
    edge = np.append(flat.place[own], len(flat.data))
    fields = [pa.array(flat.codes[own], pa.int32()), pa.array(np.diff(edge), pa.int32()), pa.array(edge[:-1] - np.repeat(flat.starts[:-1], counts), pa.int64())]
    return lists(counts, pa.StructArray.from_arrays(fields, ["code", "len", "offset"]), flat.null)


def codes_of(texts: pa.Array) -> pa.ListArray:
    """The code points of each text as numbers."""
    flat = flatten(texts)
    own = np.ones(len(flat.codes), bool)
    own[flat.heads] = False
    return lists(np.diff(flat.heads) - 1, pa.array(flat.codes[own], pa.int32()), flat.null)


def text_of(codes: pa.ListArray) -> pa.StringArray:
    """The texts of lists of code points; what can't be in a text, a null too, becomes U+FFFD."""
    null = codes.is_null().to_numpy(zero_copy_only=False)
    sizes = np.where(null, 0, codes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    found = codes.flatten().cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    found = np.where((found >= 0) & (found < 0xD800) | (found > 0xDFFF) & (found < 0x110000), found, 0xFFFD)
    data = found.astype("<u4").tobytes().decode("utf-32-le").encode()
    bytes_before = np.concatenate([[0], np.cumsum(1 + (found > 0x7F) + (found > 0x7FF) + (found > 0xFFFF))])
    ends = bytes_before[np.concatenate([[0], np.cumsum(sizes)])].astype("<i4")
    there = pa.py_buffer(np.packbits(~null, bitorder="little")) if null.any() else None
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(data), there)


def columns_taken(codes: np.ndarray, breaks: np.ndarray, width: np.ndarray) -> np.ndarray:
    """At one code point of each grapheme the columns it takes: of the first code point with a width, or what a variation selector after it says."""
    w = width[codes].astype("int64")
    group = np.cumsum(breaks) - 1
    some = np.flatnonzero(w != 0)
    at = some[np.concatenate([[True], group[some[1:]] != group[some[:-1]]])] if len(some) else some
    value = w[at]
    after = np.minimum(at + 1, len(codes) - 1)
    same = (after > at) & (group[after] == group[at])
    out = np.zeros(len(codes), "int64")
    out[at] = np.where(same & (codes[after] == 0xFE0E), 1, np.where(same & (codes[after] == 0xFE0F), 2, value))
    return out


def widths(flat: Flat, breaks_of, width: np.ndarray) -> np.ndarray:
    """Columns of each text, not below 0."""
    own = columns_taken(flat.codes, breaks_of(flat.codes), width)
    own[flat.heads] = 0  # a line feed takes no column, but one put between texts may be part of what options give it
    return np.maximum(0, per_text(own, flat.heads))


def wrap(flat: Flat, columns: int, threshold: int, breaks_of, width: np.ndarray) -> pa.StringArray:
    """Words and a space each; a line ends once it is over the columns or so near to them. The last space or break goes.

    Words stand between spaces and line breaks. The words of all texts are measured at once; then the word that ends a line is
    found from the sums of the columns, for every word that a line might begin with.
    """
    space = np.isin(flat.codes, [10, 13, 32])
    codes = np.where(space, 10, flat.codes)  # so that a word is measured by itself
    own = columns_taken(codes, breaks_of(codes), width)
    own[space] = 0
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype("int8")))
    first, last = edge[::2], edge[1::2]  # each word's first code point, and the one after it
    sums = np.concatenate([[0], np.cumsum(own)])
    reach = np.cumsum(np.maximum(0, sums[last] - sums[first]) + 1)  # columns up to each word and its space
    before = np.concatenate([[0], reach[:-1]])
    ends = np.maximum(np.searchsorted(reach, before + min(columns + 1, columns - threshold), "left"), np.arange(len(first))).tolist()
    of_text = np.searchsorted(first, flat.heads)  # the first word of each text
    broken = np.zeros(len(first), bool)
    for a, b in zip(of_text[:-1].tolist(), of_text[1:].tolist(), strict=True):
        stops = []
        while a < b and (a := ends[a]) < b:
            stops.append(a)
            a += 1
        broken[stops] = True
    final = np.zeros(len(first), bool)
    final[of_text[1:][np.diff(of_text) > 0] - 1] = True
    start, end = flat.place[first], np.append(flat.place, len(flat.data))[last]
    size = end - start
    room = size + np.where(final, 0, 1 + broken)
    to = np.concatenate([[0], np.cumsum(room)])
    out = np.full(to[-1], 32, np.uint8)
    out[(to[:-1] + size + 1)[broken & ~final]] = 10
    from_ = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    out[np.repeat(to[:-1] - start, size) + from_] = flat.data[from_]
    there = pa.py_buffer(np.packbits(~flat.null, bitorder="little")) if flat.null.any() else None
    return pa.StringArray.from_buffers(len(flat.null), pa.py_buffer(to[of_text].astype("<i4")), pa.py_buffer(out), there)


def _mark_bad(error: UnicodeDecodeError):
    return "\udcff" + chr(0xDC00 + error.end - error.start - 1), error.end


codecs.register_error("textquarry_mark", _mark_bad)


def decode(data: bytes) -> list[dict]:
    """code, len and offset of each code point; U+FFFD for each longest part of a sequence that could have gone on."""
    out, at, bad = [], 0, False
    for c in data.decode("utf-8", "textquarry_mark"):
        if c == "\udcff":
            bad = True
            continue
        code, size = (0xFFFD, ord(c) - 0xDC00 + 1) if bad else (ord(c), len(c.encode()))
        out.append({"code": code, "len": size, "offset": at})
        at, bad = at + size, False
    return out


def decoded(values: pa.Array) -> pa.ListArray:
    """code_points for bytes: those of well-formed texts at once; the others are found by halves and decoded one by one."""
    kind = pa.list_(pa.struct([("code", pa.int32()), ("len", pa.int32()), ("offset", pa.int64())]))
    values = values.cast(pa.binary())
    try:
        return code_points(flatten(values.cast(pa.string())))
    except (pa.ArrowInvalid, UnicodeDecodeError):
        if len(values) > 1:
            half = len(values) // 2
            return pa.concat_arrays([decoded(values[:half]), decoded(values[half:])])
        return pa.array([decode(values[0].as_py())], kind)
