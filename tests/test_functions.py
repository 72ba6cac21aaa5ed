import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.errors import ConfigError
from corpusloom.functions import decode, globs, lines, regexes, spans, tokens


@pytest.mark.parametrize("bad", ["(?=a)", "(?!a)", "(?<=a)b", r"(a)\1", "(?>a)", "a*+", "[a--b]", "[a", "a\\", "(?P=x)"])
def test_patterns_that_are_refused(bad):
    with pytest.raises(ConfigError):
        regexes.translated(bad)


def test_bad_pattern_is_found_on_the_driver(spark):
    with pytest.raises(ConfigError):
        regexes.checked(spark, regexes.translated("(a"))


@pytest.mark.parametrize(
    "pattern, text, options, want",
    [
        (r"\w+", "é", {}, True), ("É", "é", {"ignore_case": True}, True), ("[[:alpha:]]+", "b", {}, True), ("(?P<n>a)", "a", {}, True),
        ("b$", "a\r\nb\r\nc", {"multiline": True}, True), ("a\nb", "a\r\nb", {"multiline": True}, True), (r"a\nb", "a\r\nb", {"multiline": True}, True),
        ("^b", "a\nb", {"multiline": True}, True), ("a.b", "a\nb", {"multiline": True}, True), ("a.b", "a\nb", {}, False), ("[]x]", "]", {}, True),
    ],
)
def test_patterns(spark, pattern, text, options, want):
    p = regexes.translated(pattern, **options)
    assert spark.createDataFrame([(text,)], "t string").select(F.rlike("t", F.lit(p))).first()[0] is want


@pytest.mark.parametrize(
    "glob, path, want",
    [
        ("*.txt", "a.txt", True), ("*.txt", "nested/a.txt", False), ("**/*.txt", "a.txt", True), ("**/*.txt", "x/y/a.txt", True), ("src/**", "src/a/b", True), ("{a,b}/?.rs", "b/x.rs", True),
        ("[!a]*", "b", True), ("[!a]*", "a", False), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("a.b", "axb", False), ("*", ".hidden", True),
    ],
)
def test_globs(spark, glob, path, want):
    assert globs.matches(path, [glob]) is want
    assert spark.createDataFrame([(path,)], "p string").select(F.rlike("p", F.lit(globs.as_regex(glob)))).first()[0] is want


def test_glob_lists(spark):
    paths = ["a.txt", "skip_me.txt", "nested/deep.txt", "b.rs"]
    kept = lambda g: [r.p for r in spark.createDataFrame([(p,) for p in paths], "p string").where(globs.glob_filter(F.col("p"), g)).collect()]
    assert kept(["*.txt", "!skip_me.txt"]) == ["a.txt"]
    assert kept(["*.txt", "**/*.txt", "!skip_me.txt"]) == ["a.txt", "nested/deep.txt"]
    assert kept("!**/*.txt") == ["b.rs"]
    assert globs.glob_filter(F.col("p"), None) is None
    for bad in ("!", "", "[a", "{a"):
        with pytest.raises(ConfigError):
            globs.glob_filter(F.col("p"), [bad])
    with pytest.raises(ConfigError):
        globs.type_filter(F.col("p"), "nonesuch")


def test_lines(spark):
    df = spark.createDataFrame([("a\r\nb\r\n",), ("a\r",), ("",), ("x" * 3000,)], "t string")
    seen = [r[0] for r in df.select(lines.search_lines(F.col("t"))).collect()]
    assert seen[:3] == [["a", "b", ""], ["a\r"], [""]]
    read = [r[0] for r in df.select(lines.read_lines(F.col("t"))).collect()]
    assert read[:3] == [["a", "b"], ["a"], []]
    cut = df.select(lines.truncated(F.col("t"))).collect()[3][0]
    assert cut.startswith("x" * 2000 + " ") and "3000" in cut


CHINESE, JAPANESE, KOREAN = "你好，世界。" * 8 + "\n", "こんにちは世界。" * 8 + "\n", "안녕하세요세계." * 8 + "\n"


def test_decoding_steps():
    d = decode.decoded
    assert d("né\n".encode()).text == "né\n"
    for codec, mark in (("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"), ("utf-32-le", b"\xff\xfe\0\0"), ("utf-8", b"\xef\xbb\xbf")):
        assert d(mark + "你好\n".encode(codec)).text == "你好\n"
    assert d(b"\xef\xbb\xbf\xff").reason == "bom_mismatch"
    assert d(b"a\0b").kind == "binary" and d(b"\x7fELF\xff").kind == "binary"
    assert d(b"\x1b$B!!").reason == "iso_2022_signature"
    assert d(("é" * 20).encode() + b"\xff\xfe").reason == "mixed_or_inconsistent at byte 0x28"
    assert d(b"\xe9").reason == "ambiguous" and "windows-1252" in d(b"\xe9").candidates
    assert d(b"\xe9" * (8 << 20)).reason == "undecodable"
    for text, label in ((CHINESE, "gbk"), (JAPANESE, "shift_jis"), (KOREAN, "euc-kr"), (CHINESE.replace("，", ""), "big5")):
        data = text.encode(decode.codec_of(label), "ignore")
        assert d(data, label).text and d(data, None, label).rescued
    assert d(b"\xef\xbb\xbfa", "gbk").reason == "bom_mismatch"
    with pytest.raises(ConfigError):
        d(b"a", "klingon")


def test_headers_of_binary_formats():
    for head in (b"PK\x03\x04", b"\x1f\x8b", b"7z\xbc\xaf\x27\x1c", b"\x7fELF", b"MZ", b"\xfe\xed\xfa\xce", b"\xfe\xed\xfa\xcf", b"\xce\xfa\xed\xfe", b"\xcf\xfa\xed\xfe", b"SQLite format 3\x00", b"\x00asm"):
        assert decode.is_magic(head + b"rest") and not decode.is_magic(b"x" + head)
        assert decode.decoded(head + b"\xff").kind == "binary"
    assert len(decode.MAGIC) == 11
    for head in (b"%PDF-1.4", b"\x89PNG", b"GIF89a", b"\xff\xd8\xff"):
        assert not decode.is_magic(head)
    assert decode.decoded(b"%PDF-1.4 is text").kind == "text"


def test_trials_of_legacy_codecs_refuse_control_characters():
    assert decode.decoded(b"\xe9\x01").reason == "undecodable" and decode.decoded(b"\xe9\x7f").reason == "undecodable"
    assert decode.decoded(b"\xe9\t\r\n").reason == "ambiguous"
    assert decode.decoded("é".encode(), "windows-1252").note and not decode.decoded(b"\xe9", "windows-1252").note and not decode.decoded("é".encode(), "utf-8").note


def test_nullable_patterns():
    for pattern, want in (("a*", True), ("a+", False), ("^", True), (r"\b", True), ("a|", True), ("[a-z]{0,3}", True), (r"\p{L}", False), (r"(?P<x>a)?", True), ("x[[:alpha:]]", False), (r"\d+\.", False)):
        assert spans.nullable(regexes.translated(pattern)) == want, pattern
        assert spans.nullable(regexes.translated(pattern, True, True)) == want, pattern


def test_decoding_in_spark_agrees_with_the_driver(spark):
    data = [b"plain", "é".encode(), b"\xe9", b"a\0", b"\xff\xfea\0", b"", b"\x1b$B!!", b"MZ\xff", b"MZ fine"]
    out = decode.decode_files(spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(data)], "k int, content binary")).orderBy("k").collect()
    for x, r in zip(data, out):
        want = decode.decoded(x)
        assert (r.kind, r.text, r.reason, list(r.candidates)) == (want.kind, want.text, want.reason, list(want.candidates))


def test_spans():
    p = spans.python_pattern(regexes.translated("a*"))
    assert spans.spans_of(p, "baac") == [(0, 0), (1, 2), (4, 0)]


def test_tokens():
    assert tokens.TokenCounter()("é") == 2 and not tokens.TokenCounter().exact


@pytest.mark.parametrize(
    ("label", "text"),
    [("iso-8859-2", "Łódź"), ("Windows-1251", "Привет"), ("koi8-r", "Привет"), ("x-cp1253", "γειά"), ("tis-620", "สวัสดี"), ("ibm866", "Мир"), ("euc-jp", "日本"), ("ms932", "日本"), ("ks_c_5601-1987", "안녕"), ("big5", "繁體"), ("gb18030", "€漢"), ("latin1", "naïve"), ("ISO-8859-9", "ığş"), ("macintosh", "Ünï"), ("utf-16be", "a€"), ("UTF-32LE", "a\U0001f600")],
)
def test_labels_of_the_web(label, text):
    d = decode.explicit(text.encode(decode.codec_of(label)), label)
    assert (d.kind, d.text, d.encoding) == ("text", text, label)


def test_labels_that_are_none():
    for label in ("nope", "hz-gb-2312", "iso-8859-12", "cp9999", ""):
        with pytest.raises(ConfigError):
            decode.codec_of(label)


@pytest.mark.parametrize(("name", "good", "bad"), [("kotlin", "a/b.kt", "b.ktx"), ("make", "x/Makefile", "Makefile.txt"), ("docker", "my.Dockerfile.dev", "docker"), ("c", "a.H", "a.cc"), ("ruby", "lib/Rakefile", "Rakefile.md"), ("cmake", "CMakeLists.txt", "Lists.txt"), ("tf", "a.tf.json", "a.json")])
def test_more_file_types(name, good, bad):
    assert globs.wanted(good, None, name) and not globs.wanted(bad, None, name)


def test_every_file_type_has_globs_that_are_sound():
    for name, found in globs.TYPES.items():
        assert found and all(globs.as_regex(g, anywhere=True) for g in found), name


def test_few_texts_of_a_batch_are_python_objects_at_a_time():
    batch = pa.array([b"\xff\xfe" + f"{k} ".encode("utf-16-le") * 2000 for k in range(3000)] + [None, b"", b"\xff"], pa.binary())
    tracemalloc.start()
    out = decode.decode_array(batch)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 3003 and out[2999]["text"].as_py() == "2999 " * 2000 and [x["kind"].as_py() for x in out[-3:]] == ["rejected", "text", "rejected"]
    assert most < 10_000_000 and decode.decode_array(batch[:0]).type == out.type
