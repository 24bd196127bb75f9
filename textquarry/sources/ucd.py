"""Unicode property tables, read from the ICU library that Spark carries."""

from __future__ import annotations

import os
import stat
import tempfile
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 0x110000
UNICODE = "16.0"
GC = "Cn Lu Ll Lt Lm Lo Mn Me Mc Nd Nl No Zs Zl Zp Cc Cf Co Cs Pd Ps Pe Pc Po Sm Sc Sk So Pi Pf".split()
GCB = ["none", "CR", "LF", "Control", "Extend", "ZWJ", "Regional_Indicator", "Prepend", "SpacingMark", "L", "V", "T", "LV", "LVT"]
INCB = ["none", "Consonant", "Extend", "Linker"]
WB = "none CR LF Newline Extend ZWJ Format Katakana Hebrew_Letter ALetter Single_Quote Double_Quote MidNumLet MidLetter MidNum Numeric ExtendNumLet Regional_Indicator WSegSpace".split()
HST = "none L V T LV LVT".split()
NT = "none Decimal Digit Numeric".split()
FLAGS = {
    "math": "Math", "alphabetic": "Alphabetic", "id_start": "ID_Start", "id_continue": "ID_Continue", "xid_start": "XID_Start", "xid_continue": "XID_Continue", "whitespace": "White_Space", "hex_digit": "Hex_Digit", "diacritic": "Diacritic",
    "cased": "Cased", "upper": "Uppercase", "lower": "Lowercase", "cwcf": "CWCF", "ext_pict": "ExtPict", "composition_excluded": "CompEx", "in_15": "age=15.0",
}
#: Format characters that take a column, those of the Arabic script.
_ARABIC_FORMAT = [(0x600, 0x605), (0x61C, 0x61C), (0x6DD, 0x6DD), (0x890, 0x891), (0x8E2, 0x8E2)]


@dataclass
class Tables:
    """Dense arrays by code point, and maps of code points to lists."""

    codes: dict[str, np.ndarray] = field(default_factory=dict)
    flags: dict[str, np.ndarray] = field(default_factory=dict)
    scripts: list[str | None] = field(default_factory=list)
    simple_upper: dict[int, int] = field(default_factory=dict)
    simple_lower: dict[int, int] = field(default_factory=dict)
    canon: dict[int, list[int]] = field(default_factory=dict)
    compat: dict[int, list[int]] = field(default_factory=dict)
    fold: dict[int, list[int]] = field(default_factory=dict)

    def width(self, cjk: bool = False, c0_width: int | None = None, c1_width: int | None = None) -> np.ndarray:
        """Columns of each code point on a terminal; later rules win over earlier ones."""
        out = np.ones(SIZE, np.int8)
        out[self.flags["wide"]] = 2
        if cjk:
            out[self.flags["ambiguous"]] = 2
        out[np.isin(self.codes["gc"], [GC.index(x) for x in ("Mn", "Me", "Mc")])] = 0
        arabic = np.zeros(SIZE, bool)
        for lo, hi in _ARABIC_FORMAT:
            arabic[lo : hi + 1] = True
        out[(self.codes["gc"] == GC.index("Cf")) & ~arabic] = 0
        out[0x2E3B] = 3
        out[0:0x21] = c0_width or 0
        out[0x80:0xA0] = c1_width or 0
        for lo, hi in ((0x2028, 0x2029), (0x1160, 0x11FF), (0xD7B0, 0xD7FF), (0x2060, 0x206F), (0xFFF0, 0xFFF8), (0xE0000, 0xE0FFF)):
            out[lo : hi + 1] = 0
        out[0x2E3A] = 2
        for lo, hi in ((0x1F1E6, 0x1F200), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FFFD), (0x30000, 0x3FFFD)):
            out[lo : hi + 1] = 2
        out[0x20:0x7F] = 1
        out[0xAD] = 1
        out[[8, 0x7F]] = -1 if c0_width is None else c0_width
        return out

    def ranges(self, mask: np.ndarray) -> list[tuple[int, int]]:
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype("int8"), [0]])))
        return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def char_class(ranges: list[tuple[int, int]]) -> str:
    """A Java regular expression for one character of these ranges; surrogates can't be in a string."""
    return "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ranges if not 0xD800 <= lo <= 0xDFFF) + "]" if ranges else "(?!)"


def _read(spark: SparkSession) -> Tables:
    icu = spark._jvm.com.ibm.icu
    if not str(icu.lang.UCharacter.getUnicodeVersion().toString()).startswith(UNICODE):
        raise RuntimeError(f"Spark's ICU library isn't at Unicode {UNICODE}")

    def mask(pattern: str) -> np.ndarray:
        found, out = icu.text.UnicodeSet(f"[:{pattern}:]"), np.zeros(SIZE, bool)
        for i in range(found.getRangeCount()):
            out[found.getRangeStart(i) : found.getRangeEnd(i) + 1] = True
        return out

    t = Tables()
    for name, prop, values in (("gc", "gc", GC), ("gcb", "GCB", GCB), ("incb", "InCB", INCB), ("wb", "WB", WB), ("hst", "hst", HST), ("nt", "nt", NT)):
        code = np.zeros(SIZE, np.uint8)
        for i, value in enumerate(values[1:], 1):
            code[mask(f"{prop}={value}")] = i
        t.codes[name] = code
    script, t.scripts = np.zeros(SIZE, np.uint8), [None]
    for v in range(icu.lang.UCharacter.getIntPropertyMaxValue(0x100A) + 1):
        name = icu.lang.UCharacter.getPropertyValueName(0x100A, v, 1)
        if name and name != "Unknown" and (own := mask(f"sc={name}")).any():
            script[own] = len(t.scripts)
            t.scripts.append(str(name))
    t.codes["script"] = script
    ccc = np.zeros(SIZE, np.uint8)
    for v in range(1, 255):
        if (own := mask(f"ccc={v}")).any():
            ccc[own] = v
    t.codes["ccc"] = ccc
    for name, prop in FLAGS.items():
        t.flags[name] = mask(prop)
    t.flags |= {"wide": mask("Ea=W") | mask("Ea=F"), "ambiguous": mask("Ea=A"), "nfd": ~mask("NFD_QC=N"), "nfkd": ~mask("NFKD_QC=N")}
    hangul = np.zeros(SIZE, bool)
    hangul[0xAC00:0xD7A4] = True
    char = icu.lang.UCharacter
    for name, out, one in (("CWU", t.simple_upper, char.toUpperCase), ("CWL", t.simple_lower, char.toLowerCase)):
        for cp in np.flatnonzero(mask(name)).tolist():
            if (to := one(cp)) != cp:
                out[cp] = to
    nfd, nfkd = icu.text.Normalizer2.getNFDInstance(), icu.text.Normalizer2.getNFKDInstance()
    for cp in np.flatnonzero(~t.flags["nfkd"] & ~hangul).tolist():
        canon = nfd.getRawDecomposition(cp)
        if canon is not None:
            t.canon[cp] = [ord(c) for c in canon]
        elif (compat := nfkd.getRawDecomposition(cp)) is not None:
            t.compat[cp] = [ord(c) for c in compat]
    for cp in np.flatnonzero(mask("CWCF") | mask("Cased")).tolist():
        if (to := char.foldCase(chr(cp), True)) != chr(cp):
            t.fold[cp] = [ord(c) for c in to]
    return t


_MAPS = ("canon", "compat", "fold")


def _save(t: Tables, path: str) -> None:
    """The tables as plain arrays: nothing in the file is run when it is read."""
    arrays = {f"codes_{k}": v for k, v in t.codes.items()} | {f"flags_{k}": np.packbits(v) for k, v in t.flags.items()} | {"scripts": np.array([x or "" for x in t.scripts])}
    for name in ("simple_upper", "simple_lower"):
        arrays[name] = np.array(list(getattr(t, name).items()), np.int32).reshape(-1, 2)
    for name in _MAPS:
        items = getattr(t, name)
        arrays[f"{name}_from"] = np.array(list(items), np.int32)
        arrays[f"{name}_ends"] = np.cumsum([0, *map(len, items.values())]).astype(np.int32)
        arrays[f"{name}_to"] = np.array([c for to in items.values() for c in to], np.int32)
    with open(f"{path}.{os.getpid()}", "wb") as f:
        np.savez_compressed(f, **arrays)
    os.replace(f.name, path)


def _load(path: str) -> Tables:
    t = Tables()
    with np.load(path, allow_pickle=False) as found:
        for name in found.files:
            if name.startswith("codes_"):
                t.codes[name.removeprefix("codes_")] = found[name]
            elif name.startswith("flags_"):
                t.flags[name.removeprefix("flags_")] = np.unpackbits(found[name])[:SIZE].astype(bool)
        t.scripts = [x or None for x in found["scripts"].tolist()]
        t.simple_upper, t.simple_lower = (dict(found[name].tolist()) for name in ("simple_upper", "simple_lower"))
        for name in _MAPS:
            to = found[f"{name}_to"].tolist()
            setattr(t, name, {cp: to[a:b] for cp, (a, b) in zip(found[f"{name}_from"].tolist(), pairwise(found[f"{name}_ends"].tolist()), strict=True)})
    return t


def _own_folder() -> str | None:
    """A folder of the driver's that no other user can write to; None if there is none."""
    path = os.path.join(tempfile.gettempdir(), f"textquarry-{os.getuid()}")
    try:
        os.makedirs(path, 0o700, exist_ok=True)
        found = os.lstat(path)
    except OSError:
        return None
    return path if stat.S_ISDIR(found.st_mode) and found.st_uid == os.getuid() and not found.st_mode & 0o077 else None


_held: Tables | None = None


def tables(spark: SparkSession) -> Tables:
    """The tables, read once by the driver and kept in a folder of its own for the next session."""
    global _held
    if _held is None:
        folder = _own_folder()
        path = folder and os.path.join(folder, f"ucd-{UNICODE}-2.npz")
        if path and os.path.exists(path):
            try:
                _held = _load(path)
                return _held
            except (OSError, ValueError, KeyError):
                pass  # a file that can't be read is made again
        _held = _read(spark)
        if path:
            _save(_held, path)
    return _held


def unicode_props(spark: SparkSession, cjk: bool = False, c0_width: int | None = None, c1_width: int | None = None) -> DataFrame:
    """One row for each code point (cp) with its properties; script is null where none is listed."""
    t = tables(spark)
    columns = [("gc", GC), ("gcb", GCB), ("incb", INCB), ("wb", WB), ("hangul", HST), ("numeric_type", NT), ("script", t.scripts)]
    sent = spark.sparkContext.broadcast((
        [t.codes[{"hangul": "hst", "numeric_type": "nt"}.get(name, name)] for name, _ in columns], t.codes["ccc"], t.width(cjk, c0_width, c1_width), {**{n: t.flags[n] for n in FLAGS}, "nfd": t.flags["nfd"], "nfkd": t.flags["nfkd"]}, t.simple_upper, t.simple_lower,
    ))
    names = [*FLAGS, "nfd", "nfkd"]
    kinds = "cp int, " + ", ".join(f"{n} string" for n, _ in columns) + ", ccc int, width int, " + ", ".join(f"is_{n} boolean" for n in names) + ", simple_upper int, simple_lower int"

    def look_up(batches):
        import pandas as pd

        codes, ccc, width, flags, upper, lower = sent.value
        for batch in batches:
            cp = batch["id"].to_numpy()
            out = {"cp": cp.astype("int32")}
            for (name, values), code in zip(columns, codes, strict=True):
                out[name] = np.array(values, dtype=object)[code[cp]]
            out |= {"ccc": ccc[cp].astype("int32"), "width": width[cp].astype("int32")} | {f"is_{n}": flags[n][cp] for n in names}
            out |= {"simple_upper": [upper.get(c, c) for c in cp.tolist()], "simple_lower": [lower.get(c, c) for c in cp.tolist()]}
            yield pd.DataFrame(out)

    return spark.range(SIZE).mapInPandas(look_up, kinds)


def mapping(spark: SparkSession, name: str) -> DataFrame:
    """cp, to (array of code points): name is canon, compat or fold."""
    return spark.createDataFrame(sorted(getattr(tables(spark), name).items()), "cp int, to array<int>")


def compositions(spark: SparkSession) -> DataFrame:
    """first, second, cp: the pairs that NFC makes one code point; Hangul goes by arithmetic."""
    t = tables(spark)
    rows = [(to[0], to[1], cp) for cp, to in t.canon.items() if len(to) == 2 and not t.flags["composition_excluded"][cp]]
    return spark.createDataFrame(rows, "first int, second int, cp int")


def code_points_with_props(df: DataFrame, text: str, *names: str) -> DataFrame:
    """df's rows for each code point of text: pos, char, cp and these properties, by a join with the table. An empty text has none."""
    spark = df.sparkSession
    chars = df.select("*", F.posexplode(F.split(F.make_valid_utf8(F.col(text)), "")).alias("pos", "char")).filter("char <> ''").withColumn("cp", F.ascii("char"))
    props = unicode_props(spark).select("cp", *names)
    return chars.join(F.broadcast(props), "cp", "left")  # the table has a row for each code point, however large df is
