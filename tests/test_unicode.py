import tracemalloc
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textquarry.functions import columns as C
from textquarry.functions import kernels
from textquarry.operators import frames
from textquarry.plans import queries
from textquarry.sources import ucd

BEAR = "\U0001f43b‍❤️"


@pytest.fixture(scope="module")
def u(spark):
    return C.Unicode(spark)


@pytest.fixture(scope="module")
def rules(u):
    t = u._sent.value
    return lambda c: kernels.grapheme_breaks(c, t[0], t[1], t[3]), lambda c: kernels.word_breaks(c, t[2], t[3]), u._width.value


def segments(texts, breaks):
    flat = kernels.flatten(texts)
    return kernels.segments(flat, breaks(flat.codes)).to_pylist()


def widths(texts, rules):
    return kernels.widths(kernels.flatten(texts), rules[0], rules[2]).tolist()


def wrapped(texts, columns, threshold, rules):
    return kernels.wrap(kernels.flatten(texts), columns, threshold, rules[0], rules[2]).to_pylist()


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "t string").select(*columns).first()


@pytest.mark.parametrize(
    ("data", "expected"),
    [
        ("C0AF", [(0xFFFD, 1)] * 2), ("E080AF", [(0xFFFD, 1)] * 3), ("F08080AF", [(0xFFFD, 1)] * 4), ("EDADBF", [(0xFFFD, 1)] * 3),
        ("E180E2F09192F1BF41", [(0xFFFD, 2), (0xFFFD, 1), (0xFFFD, 3), (0xFFFD, 2), (0x41, 1)]), ("E180", [(0xFFFD, 2)]), ("", []),
    ],
)
def test_decode(data, expected):
    assert [(x["code"], x["len"]) for x in kernels.decode(bytes.fromhex(data))] == expected


@pytest.mark.parametrize(("text", "n"), [(BEAR + "‍" + BEAR, 1), (BEAR + "​" + BEAR, 3), (BEAR + BEAR, 2), ("Hé", 2), ("aΔ👨🏻‍🌾→", 4), ("🇪🇸🇫🇷🇩", 3), ("", 0), ("\r\n\n", 2), ("क्षि", 1), ("각", 1)])
def test_graphemes(rules, text, n):
    assert len(segments([text], rules[0])[0]) == n


def test_words(rules):
    found = segments(["Metonym   Μετωνύμιο メトニム", "don't a:ka fin! 3.14"], rules[1])
    assert [[x["text"] for x in f] for f in found] == [["Metonym", "   ", "Μετωνύμιο", " ", "メトニム"], ["don't", " ", "a:ka", " ", "fin", "!", " ", "3.14"]]


@given(st.lists(st.text(alphabet="ab́\r\n ‍🐻🇪🇸👍🏻'.,1ש\"カ_क्ष각ᄀ­"), max_size=4))
@settings(max_examples=150, deadline=None)
def test_segments_cover_each_text_alone(rules, texts):
    for breaks in rules[:2]:
        together = segments(texts, breaks)
        assert together == [segments([t], breaks)[0] for t in texts]
        for text, parts in zip(texts, together, strict=True):
            assert "".join(p["text"] for p in parts) == text
            assert [p["offset"] for p in parts] == [sum(q["len"] for q in parts[:i]) for i in range(len(parts))]
            assert all(len(p["text"].encode()) == p["len"] > 0 for p in parts)


@given(st.lists(st.text(max_size=12), max_size=4))
@settings(max_examples=60, deadline=None)
def test_graphemes_like_another_library(rules, texts):
    import regex

    keep = [t for t in texts if not any("\ud800" <= c <= "\udfff" or unicodedata.category(c) in ("Cn", "Co") for c in t)]
    assert [[p["text"] for p in f] for f in segments(keep, rules[0])] == [regex.findall(r"\X", t) for t in keep]


@pytest.mark.parametrize(
    ("text", "width"),
    [
        ("Hello\r\n", 5), ("é", 1), ("Hello 😊", 8), ("Héllo 🇪🇸", 8), ("⚡", 2), ("⚡︎", 1), ("⚡️", 2), ("❤", 1), ("❤️", 2), ("A\x08", 0), ("\x7fA", 0), ("\x7fA\x08\x08", 0), ("", 0),
        ("hello\0world", 10), ("コンニチハ, セカイ!", 19), ("\x1b[0m", 3), ("ರ಼್ಚ", 2), ("🔥🗡🍩👩🏻‍🚀⏰💃🏼🔦👍🏻", 15), ("슬라바 우크라이나", 17), ("͸", 1),
    ],
)
def test_width(rules, text, width):
    assert widths([text], rules) == [width]


def test_code_point_widths(spark):
    width = ucd.tables(spark).width()
    assert {hex(c): int(width[c]) for c in (0, 8, 0x7F, 5, 0x70F, 0x603, 0xAD, 0x2E3A, 0x2E3B, 0xBD, 0xE9, 0x1F60A, 0x7EDF)} == dict(zip(map(hex, (0, 8, 0x7F, 5, 0x70F, 0x603, 0xAD, 0x2E3A, 0x2E3B, 0xBD, 0xE9, 0x1F60A, 0x7EDF)), (0, -1, -1, 0, 0, 1, 1, 2, 3, 1, 1, 2, 2), strict=True))
    assert ucd.tables(spark).width(cjk=True)[0xBD] == 2


def test_padding_and_wrap(spark, u, rules):
    t = F.col("t")
    assert one(spark, "abc", u.center(t, 9, "*"), u.pad_left(t, 9, "*"), u.pad_right(t, 9, "*"))[:] == ("***abc***", "******abc", "abc******")
    assert one(spark, "w😊w", u.center(t, 10, "-"), u.pad_left(t, 10, "-"), u.pad_right(t, 10, "-"))[:] == ("---w😊w---", "------w😊w", "w😊w------")
    assert one(spark, "123", u.center(t, 3, "-"), u.center(t, 2, "-", False), u.pad_left(t, 3, "-", False), u.center(t, 8, "-"))[:] == ("123", None, None, "--123---")
    with pytest.raises(Exception, match="StrTooLong"):
        one(spark, "123", u.center(t, 2, "-"))
    with pytest.raises(ValueError):
        u.center(t, 9, "‍")
    assert wrapped(["The quick brown fox\r\njumped over the lazy dog!", "ab", None, ""], 10, 3, rules) == ["The quick \nbrown fox \njumped \nover the \nlazy dog!", "ab", None, ""]


def wrap_by_words(text, columns, threshold, rules):
    out, line = [], 0
    words = [w for part in text.replace("\r", "\n").split("\n") for w in part.split(" ") if w]
    for word in words:
        out.append(word + " ")
        line += widths([word], rules)[0] + 1
        if line > columns or columns - line <= threshold:
            out.append("\n")
            line = 0
    return "".join(out)[: -2 if out and out[-1] == "\n" else -1]


@given(st.lists(st.text(alphabet="ab \n\r漢\u0301😊\x08\u200d", max_size=40), max_size=5), st.integers(0, 12), st.integers(0, 5))
@settings(max_examples=200, deadline=None)
def test_wrap_like_word_by_word(rules, texts, columns, threshold):
    assert wrapped(texts, columns, threshold, rules) == [wrap_by_words(t, columns, threshold, rules) for t in texts]


@pytest.mark.parametrize(
    ("cp", "name", "value"),
    [
        ("A", "gc", "Lu"), ("3", "gc", "Nd"), ("©", "gc", "So"), ("F", "is_hex_digit", True), ("z", "is_hex_digit", False), ("́", "is_diacritic", True), ("3", "is_alphabetic", False), ("+", "is_math", True), ("❿", "numeric_type", "Numeric"),
        ("⁰", "numeric_type", "Digit"), ("3", "numeric_type", "Decimal"), ("1", "is_id_start", False), ("1", "is_id_continue", True), ("ଳ", "is_xid_start", True), ("ำ", "is_xid_continue", True), ("Ω", "script", "Greek"), ("צ", "script", "Hebrew"),
        ("É", "is_cased", True), ("ש", "wb", "Hebrew_Letter"), ("ヿ", "wb", "Katakana"), ("👇", "is_ext_pict", True), ("✁", "is_ext_pict", True), ("ß", "simple_upper", 0xDF), ("İ", "simple_lower", ord("i")), ("́", "ccc", 230), ("각", "hangul", "LVT"),
    ],
)
def test_properties(spark, cp, name, value):
    assert spark_table(spark)[ord(cp)][name] == value


def spark_table(spark, held={}):  # noqa: B006
    if not held:
        some = [ord(c) for c in "A3©Fź+❿⁰1ଳำΩצÉשヿ👇✁ßİ각"]
        held.update({r["cp"]: r for r in ucd.unicode_props(spark).filter(F.col("cp").isin(some)).collect()})
    return held


def test_table_sizes(spark):
    t = ucd.tables(spark)
    assert [(t.codes["nt"] == i).sum() for i in (1, 2, 3)] == [760, 128, 1114]
    assert len(t.canon) == 2081


def test_normal_forms_and_keys(spark):
    t = F.col("t")
    row = one(spark, "Héllo World! ϓ", C.nfd(t), C.nfkd(t), C.nfc(t))
    assert row[:] == ("Héllo World! ϓ", "Héllo World! Ύ", "Héllo World! ϓ")
    assert one(spark, "Ύ ϓ", C.nfkc(t), C.nfc(t))[:] == ("Ύ Ύ", "Ύ ϓ")
    assert one(spark, "éḊ각ㆉ", C.to_codes(C.nfd(t)))[0] == [0x65, 0x301, 0x44, 0x307, 0x1100, 0x1161, 0x11A8, 0x3189]
    a, b, c = "Héllo World! ϓ", "Héllo World! Ύ", "Héllo World! ϓ"
    keys = {x: one(spark, x, C.canonical_key(t), C.compatibility_key(t))[:] for x in (a, b, c, "straße", "STRASSE")}
    assert keys[a][1] == keys[b][1] == keys[c][1] and keys[a][0] == keys[c][0] != keys[b][0] and keys["straße"][0] == keys["STRASSE"][0]
    assert one(spark, None, C.nfc(t), C.canonical_key(t))[:] == (None, None)


def test_code_point_lists(spark):
    row = spark.createDataFrame([([0xE9, 0x1E0A, 0xACE1, 0x3D3, 0x3189],)], "c array<int>").select(C.nfd_codes(F.col("c")), C.nfkd_codes(F.col("c")), C.fold_codes(F.col("c"))).first()
    assert row[0] == [0x65, 0x301, 0x44, 0x307, 0x1100, 0x1169, 0x11A8, 0x3D2, 0x301, 0x3189]
    assert row[1] == [0x65, 0x301, 0x44, 0x307, 0x1100, 0x1169, 0x11A8, 0x3A5, 0x301, 0x1188] and row[2] == [0xE9, 0x1E0B, 0xACE1, 0x3D3, 0x3189]
    codes = spark.createDataFrame([([],), (None,), ([0x41, 0xD800, 0x110000, -1, 0, 0x1F60A],), ([0xFEFF, 0x61],)], "c array<int>").select(C.from_codes(F.col("c")), C.to_codes(C.from_codes(F.col("c")))).collect()
    assert [tuple(r) for r in codes] == [("", []), (None, None), ("A\ufffd\ufffd\ufffd\0😊", [0x41, 0xFFFD, 0xFFFD, 0xFFFD, 0, 0x1F60A]), ("\ufeffa", [0xFEFF, 0x61])]
    assert one(spark, "∅δq🦾ă", C.reverse_code_points(F.col("t")))[0] == "ă🦾qδ∅"
    pairs = spark.createDataFrame([("foé", "foe\u0301"), ("foϓ", "fo\u03d2\u0301"), ("a", "A"), (None, "a")], "a string, b string")
    assert [r[0] for r in pairs.select(C.normal_equal(F.col("a"), F.col("b"))).collect()] == [True, True, False, None]


def test_peeks_and_flips(spark, u):
    """Turned at an item, an iteration gives it once more."""
    x, t = F.col("x"), F.col("t")
    rows = spark.createDataFrame([("don't a:ka fin!",)], "t string").withColumn("x", u.words(t)).withColumn("h", C.item_at(F.col("x"), 7))
    text = lambda items: F.transform(items, lambda i: i["text"])
    row = rows.select(F.col("h.text"), C.peek_ahead(x, F.col("h"))["text"], C.peek_behind(x, F.col("h"))["text"], text(C.flip_back(x, F.col("h"))), text(C.flip_forth(x, F.col("h"))), text(C.before(x, F.col("h"))), text(C.after(x, F.col("h")))).first()
    assert row[:] == ("a:ka", " ", " ", ["a:ka", " ", "don't"], ["a:ka", " ", "fin", "!"], [" ", "don't"], [" ", "fin", "!"])
    edges = rows.select(C.peek_behind(x, F.get(x, F.lit(0))), C.peek_ahead(x, F.element_at(x, -1)), text(u.word_reverse(t)), u.grapheme_breaks(F.lit("e\u0301🇪🇸a"))).first()
    assert edges[0] is None and edges[1] is None and edges[2] == ["!", "fin", " ", "a:ka", " ", "don't"] and edges[3] == [True, False, True, False, True]


ILL = ["61FF62", "E180", "", "F09F98", "C0AF", "61E18062"]


def test_ill_formed_and_empty_texts(spark, u, rules):
    """Each longest ill-formed part counts as U+FFFD, in every function; an empty text has nothing."""
    rows = spark.createDataFrame([(i, bytes.fromhex(x)) for i, x in enumerate(ILL)] + [(9, None)], "id int, b binary").select("id", F.col("b").cast("string").alias("t"))
    t = F.col("t")
    want = {i: "".join(chr(x["code"]) for x in kernels.decode(bytes.fromhex(h))) for i, h in enumerate(ILL)}
    out = rows.select("id", C.valid(t).alias("valid"), u.grapheme_count(t).alias("n"), u.word_count(t).alias("w"), u.display_width(t).alias("wide"), u.words(t).alias("words"), u.graphemes(t).alias("graphemes"), C.nfc(t).alias("nfc"), C.casefold(t).alias("fold"), u.wrap(t, 10, 2).alias("wrap"), u.pad_left(t, 9, "*").alias("pad"), u.count_category(t, "Ll").alias("ll"), u.count_category(t, "So").alias("so"), u.to_upper(t).alias("upper"), C.reverse_code_points(C.valid(t)).alias("back"), u.code_points(t).alias("cps"))
    for r in out.collect():
        if r["id"] == 9:
            assert all(r[c] is None for c in out.columns[1:])
            continue
        text = want[r["id"]]
        assert r["valid"] == r["nfc"] == r["fold"] == r["wrap"] == text and r["n"] == r["wide"] == len(text) and r["so"] == text.count("\ufffd") and r["ll"] == len(text) - r["so"]
        assert "".join(x["text"] for x in r["words"]) == "".join(x["text"] for x in r["graphemes"]) == text and r["pad"] == "*" * (9 - len(text)) + text
        assert r["upper"] == text.upper() and r["back"] == text[::-1] and [x["code"] for x in r["cps"]] == [ord(c) for c in text]
    census = frames.census(spark.createDataFrame([("",), ("a",), (None,)], "t string"), "t", "gc").collect()
    assert [tuple(r) for r in census] == [("Ll", 1)]
    assert frames.census(rows.filter("id = 0"), "t", "gc").count() == 2


def test_tables_like_pythons(spark):
    """All code points that Python's tables have, against them: they are of 15.1, and what changed since is named."""
    t = ucd.tables(spark)
    gc, known = t.codes["gc"], [c for c in range(ucd.SIZE) if unicodedata.category(chr(c)) != "Cn"]
    assert [hex(c) for c in known if ucd.GC[gc[c]] != unicodedata.category(chr(c))] == ["0x1171e"]
    assert [c for c in known if t.codes["ccc"][c] != unicodedata.combining(chr(c))] == []
    wide = lambda c: unicodedata.east_asian_width(chr(c)) in "WF"
    changed = [c for c in known if t.flags["wide"][c] != wide(c)]
    assert len(changed) == 188 and all(0x2630 <= c <= 0x268F or 0x4DC0 <= c <= 0x4DFF or 0x1D300 <= c <= 0x1D37F for c in changed)  # trigrams and hexagrams became wide
    kind = lambda c: "Decimal" if unicodedata.decimal(chr(c), None) is not None else "Digit" if unicodedata.digit(chr(c), None) is not None else "Numeric" if unicodedata.numeric(chr(c), None) is not None else "none"
    assert [hex(c) for c in known if ucd.NT[t.codes["nt"][c]] != kind(c)] == []
    maps = {"canon": {}, "compat": {}}
    for c in known:
        if (said := unicodedata.decomposition(chr(c))) and not 0xAC00 <= c < 0xD7A4:
            parts = said.split()
            maps["compat" if parts[0][0] == "<" else "canon"][c] = [int(x, 16) for x in parts if x[0] != "<"]
    for name, want in maps.items():
        assert {c: to for c, to in getattr(t, name).items() if unicodedata.category(chr(c)) != "Cn"} == want
    assert {c: to for c, to in t.fold.items() if unicodedata.category(chr(c)) != "Cn"} == {c: [ord(x) for x in chr(c).casefold()] for c in known if chr(c).casefold() != chr(c)}
    one_to_one = lambda name, f: {c: to for c, to in getattr(t, name).items() if unicodedata.category(chr(c)) != "Cn" and unicodedata.category(chr(to)) != "Cn" and len(f(chr(c))) == 1}
    assert one_to_one("simple_upper", str.upper) == {c: ord(chr(c).upper()) for c in known if len(chr(c).upper()) == 1 and chr(c).upper() != chr(c)}
    assert one_to_one("simple_lower", str.lower) == {c: ord(chr(c).lower()) for c in known if len(chr(c).lower()) == 1 and chr(c).lower() != chr(c)}
    for form, flag in (("NFD", "nfd"), ("NFKD", "nfkd")):
        assert [c for c in known if not 0xD800 <= c < 0xE000 and t.flags[flag][c] != unicodedata.is_normalized(form, chr(c))] == []
    assert [c for c in known if not 0xD800 <= c < 0xE000 and t.flags["composition_excluded"][c] == unicodedata.is_normalized("NFC", chr(c))] == []
    pairs = {(r["first"], r["second"]): r["cp"] for r in ucd.compositions(spark).collect()}
    assert all(unicodedata.normalize("NFC", chr(a) + chr(b)) == chr(c) for (a, b), c in pairs.items() if unicodedata.category(chr(c)) != "Cn")
    syllable = lambda c: "L" if 0x1100 <= c < 0x1160 or 0xA960 <= c < 0xA97D else "V" if 0x1160 <= c < 0x11A8 or 0xD7B0 <= c < 0xD7C7 else "T" if 0x11A8 <= c < 0x1200 or 0xD7CB <= c < 0xD7FC else "none" if not 0xAC00 <= c < 0xD7A4 else "LVT" if (c - 0xAC00) % 28 else "LV"
    assert [c for c in known if ucd.HST[t.codes["hst"][c]] != syllable(c)] == []


@pytest.mark.parametrize("cjk", [False, True])
def test_widths_of_code_points_by_rule(spark, cjk):
    """The rules from the last to the first, by Python's categories and widths, which know the characters of 15.1."""
    inside = lambda c, *ranges: any(a <= c <= b for a, b in ranges)

    def rule(c):
        kind, wide = unicodedata.category(chr(c)), unicodedata.east_asian_width(chr(c))
        if c in (8, 0x7F):
            return -1
        if c == 0xAD or 0x20 <= c < 0x7F:
            return 1
        if inside(c, (0x1F1E6, 0x1F200), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FFFD), (0x30000, 0x3FFFD), (0x2E3A, 0x2E3A)):
            return 2
        if c < 0x20 or inside(c, (0x80, 0x9F), (0x2028, 0x2029), (0x1160, 0x11FF), (0xD7B0, 0xD7FF), (0x2060, 0x206F), (0xFFF0, 0xFFF8), (0xE0000, 0xE0FFF)):
            return 0
        if c == 0x2E3B:
            return 3
        if kind in ("Mn", "Me", "Mc") or kind == "Cf" and not unicodedata.name(chr(c)).startswith("ARABIC"):
            return 0
        return 2 if wide in "WF" or cjk and wide == "A" else 1

    found, t = ucd.tables(spark).width(cjk), ucd.tables(spark)
    known = [c for c in range(ucd.SIZE) if unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs") and t.flags["wide"][c] == (unicodedata.east_asian_width(chr(c)) in "WF")]
    assert len(known) > 149_000 and [hex(c) for c in known if found[c] != rule(c)] == []


def test_tables_are_kept_as_plain_arrays(spark, tmp_path):
    t = ucd.tables(spark)
    ucd._save(t, str(tmp_path / "t.npz"))
    again = ucd._load(str(tmp_path / "t.npz"))
    assert all((again.codes[k] == v).all() for k, v in t.codes.items()) and all((again.flags[k] == v).all() for k, v in t.flags.items())
    assert (again.scripts, again.simple_upper, again.simple_lower, again.canon, again.compat, again.fold) == (t.scripts, t.simple_upper, t.simple_lower, t.canon, t.compat, t.fold)


def test_case(spark, u):
    t = F.col("t")
    for text, upper, lower in (("HELLO, WORLD 2112!", True, False), ("hello, world 2112!", False, True), ("Hello, World 2112!", False, False), ("12", True, True)):
        assert one(spark, text, u.is_upper(t), u.is_lower(t))[:] == (upper, lower)
    assert one(spark, "Hello, straße ŉ", u.to_upper(t), u.to_lower(t))[:] == ("HELLO, STRAßE ŉ", "hello, straße ŉ")
    assert one(spark, "þÿ", C.is_ascii(t), C.is_latin1(t))[:] == (False, True) and one(spark, "ϓ", C.is_latin1(t))[0] is False


def test_at_index_for_every_byte(spark, u):
    text = "first sécond 👩‍🔬!"
    rows = spark.range(len(text.encode())).select("id", F.lit(text).alias("t")).withColumn("x", u.words(F.col("t")))
    for r in rows.select("id", C.item_at(F.col("x"), F.col("id")).alias("w")).collect():
        assert r["w"]["offset"] <= r["id"] < r["w"]["offset"] + r["w"]["len"]
    assert one(spark, "abc", C.item_at(u.words(F.col("t")), 99))[0] is None


def test_joins_nulls_and_streams(spark, u, tmp_path):
    left, right = spark.createDataFrame([("STRASSE", 1), (None, 2)], "t string, a int"), spark.createDataFrame([("straße", 7), (None, 8)], "s string, b int")
    assert frames.matching_join(left, right, "t", "s").select("a", "b").collect() == [(1, 7)]
    assert one(spark, None, u.grapheme_count(F.col("t")), u.words(F.col("t")), u.display_width(F.col("t")), u.code_points(F.col("t")))[:] == (None,) * 4
    from textquarry.streaming.streams import measured

    spark.createDataFrame([("👩‍🔬",), ("abc",)], "t string").write.parquet(str(tmp_path / "in"))
    stream = measured(spark.readStream.schema("t string").parquet(str(tmp_path / "in")), "t")
    run = stream.writeStream.format("memory").queryName("measured").start()
    run.processAllAvailable()
    run.stop()
    assert {tuple(r) for r in spark.table("measured").collect()} == {("👩‍🔬", 1, 2), ("abc", 3, 3)}


def test_sql_names(spark, rules):
    from textquarry.functions.sql import register

    register(spark)
    assert spark.sql("select grapheme_count('éa'), word_count('a b'), display_width('😊'), to_nfc('é')").first()[:] == (2, 3, 2, "é")
    row = spark.sql("select casefold('Straße'), canonical_key('É') = canonical_key('é'), compatibility_key('Ａ'), normal_equal('é', 'e\u0301'), simple_upper('straße'), simple_lower('İA'), is_upper_text('AB 1'), is_lower_text('aB'), changes_when_casefolded('ß'), reverse_code_points('añ'), to_nfkd('ﬆ')").first()
    assert row[:] == ("strasse", True, "a", True, "STRAßE", "ia", True, False, True, "ña", "st")
    row = spark.sql("select category_counts('aB1')['Ll'], script_counts('aΩ')['Greek'], numeric_type_counts('1²')['Digit'], property_counts('a b')['whitespace'], pad_left('w😊w', 10, '-'), pad_right('abc', 9, '*'), pad_center('123', 8, '-'), pad_center('123', 3, '-'), pad_left('123', 2, '-')").first()
    assert row[:] == (1, 1, 1, 1, "------w😊w", "abc******", "--123---", "123", None)
    assert spark.sql("select words('a b')[2].text, graphemes('e\u0301a')[0].len, code_points(X'61FF')[1].code, grapheme_breaks('ab')").first()[:] == ("b", 3, 0xFFFD, [True, True])
    assert spark.sql("select grapheme_count(cast(X'61FF62' as string)), casefold(null), words(null)").first()[:] == (3, None, None)
    rows = spark.sql("select wrap_text('a bc de', id, 1) as w from range(1, 8) union all select wrap_text(null, 3, 1) union all select wrap_text('a', null, 1)").collect()
    assert [r["w"] for r in rows] == [*(wrap_by_words("a bc de", n, 1, rules) for n in range(1, 8)), None, None]


def test_every_oracle_has_its_query():
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_all_words_are_counted(spark, rules, tmp_path):
    texts = {1: "don't e.g. a 3.14 x_1 don't", 2: "Straße Μετωνύμιο é é — 漢字 🐻", 3: "plain words, plain", 4: "", 5: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for doc, text in texts.items():
        for part in segments([text or ""], rules[1])[0]:
            if any(unicodedata.category(c)[0] in "LN" for c in part["text"]):
                want[doc, part["text"]] = want.get((doc, part["text"]), 0) + 1
    got = queries.QUERIES["word_counts"](spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["word"]): r["n"] for r in got} == want and len(got) == len(want)
    assert want[1, "don't"] == 2 and want[1, "e.g"] == want[1, "3.14"] == want[2, "Straße"] == 1 and want[2, "é"] == 2 and want[3, "plain"] == 2


def test_batches_are_worked_on_in_parts(u):
    """What a batch takes doesn't grow with its texts, and what is much larger than these leaves in several batches."""
    some = ["Héllo, wörld 3.14 don't \u0301🐻 " * 3000, None, "", "a"]
    batch = pa.array(some * 20, pa.string())
    names = {"graphemes": True, "words": True, "code_points": True, "grapheme_count": False, "word_count": False, "grapheme_breaks": False, "display_width": False, "category_counts": False, "flag_counts": False}
    for run, large in [(u.udf(name).func, large) for name, large in names.items()] + [(C._to_codes().func, True)]:
        alone = next(run(iter([batch[:4]]))) if large else run(batch[:4])
        tracemalloc.start()
        sizes = []
        for part in run(iter([batch])) if large else [run(batch)]:
            sizes.append(len(part))
            first = part[:4].equals(alone) if len(sizes) == 1 else first
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert first and sum(sizes) == len(batch) and most < 80 << 20 and (not large or max(sizes) <= 12)


@given(st.lists(st.one_of(st.none(), st.text(max_size=9)), max_size=9), st.integers(1, 20), st.integers(0, 4))
@settings(max_examples=100, deadline=None)
def test_parts(texts, limit, skipped):
    texts = [t if t is None else t.encode("utf-8", "replace").decode() for t in texts]
    batch = pa.array(texts, pa.string())[skipped:]
    found = [p.to_pylist() for p in kernels.parts(batch, limit)]
    assert [t for p in found for t in p] == texts[skipped:] and all(len(p) < 2 or sum(len((t or "").encode()) for t in p) <= limit for p in found)


def test_one_ill_formed_text_in_a_batch():
    data = ["é🐻".encode(), None, b"a\xffb", b"", b"\xe1\x80", "añ".encode()]
    assert kernels.decoded(pa.array(data, pa.binary())).to_pylist() == [None if x is None else kernels.decode(x) for x in data]


def test_empty_texts_and_nulls_as_in_sql(spark, tmp_path):
    """The queries follow their SQL: an empty text is split into one empty string, with the code -1; the sum over no words is null."""
    spark.createDataFrame([(1, ""), (2, None), (3, "a b")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    of = lambda name: {r[0]: r[1:] for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    words, codes, none = of("word_segments"), of("decomposed_code_points"), "d41d8cd98f00b204e9800998ecf8427e"
    assert words[1] == (0, none, None, 0) and words[2] == (None,) * 4 and words[3][0] == words[3][2] == 3
    assert codes[1] == ("6bb61e3b7bce0931da574d19d1d82c88",) * 3 + (none,) and codes[2] == (None,) * 4
    assert of("cp_iterate") == {1: (1, -1, 0, 0), 3: (3, 227, 3, 3)} and of("wrap")[2] == (None, 0, 0, 0) and of("grapheme_segments")[2] == (None,) * 4
    assert sorted(map(tuple, queries.QUERIES["grapheme_rows"](spark, str(tmp_path)).filter("doc_id < 3").collect())) == [(1, 0, 0, 0, "")]


def test_keys_take_each_step_once(spark):
    """A null check at each step would evaluate the steps before it twice, 31 steps for the 5 of a key."""
    rows = spark.createDataFrame([("a",)], "t string")
    plan = rows.select(C.compatibility_key(F.col("t")).alias("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("com.ibm.icu") == 5


def test_groups_that_match(spark):
    left, right = spark.createDataFrame([("ÉTÉ", 1), ("x", 2), (None, 3)], "t string, a int"), spark.createDataFrame([("été", 5), ("e\u0301te\u0301", 4), (None, 6)], "s string, b int")
    assert frames.matching_groups_join(left, right, "t", "s", F.min("b"), F.count(F.lit(1))).select("a", "min(b)", "count(1)").collect() == [(1, 4, 2)]
