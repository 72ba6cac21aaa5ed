"""Bytes to text by strict steps that never replace a character.

In order: byte order marks, a NUL near the start (binary), valid UTF-8 (but
ISO-2022 escapes are rejected), headers of binary formats, a long valid UTF-8
beginning that breaks off (mixed), a size limit, the encoding that a nominator
names (see nominate.py; without one, none), and a trial of legacy codecs, of which
none may be guessed: a file that any of them decodes is ambiguous.
"""

from __future__ import annotations

import codecs
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.errors import ConfigError

SENTINEL_BYTES, LEGACY_BYTES = 8 << 10, 8 << 20
#: A valid beginning counts as UTF-8 from so many bytes and non-ASCII bytes on.
CONFLICT_BYTES, CONFLICT_NON_ASCII = 32, 8

# fixed values: byte order marks in the order they are tried, with codecs
MARKS = [(b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")]
# fixed values: headers of binary formats: zip, gzip, 7z, ELF, DOS and Windows programs, four of Mach-O, SQLite, WebAssembly
MAGIC = [
    b"PK\x03\x04",
    b"\x1f\x8b",
    b"7z\xbc\xaf\x27\x1c",
    b"\x7fELF",
    b"MZ",
    b"\xfe\xed\xfa\xce",
    b"\xfe\xed\xfa\xcf",
    b"\xce\xfa\xed\xfe",
    b"\xcf\xfa\xed\xfe",
    b"SQLite format 3\x00",
    b"\x00asm",
]
# fixed values: legacy encodings and Python's names of them
LEGACY = {"windows-1252": "cp1252", "gbk": "gbk", "shift_jis": "shift_jis", "big5": "big5", "euc-kr": "euc_kr"}
# fixed values: labels of encodings that don't mean what a codec of that name does, and Python's names of what they mean
LABELS = {
    "utf8": "utf-8", "unicode-1-1-utf-8": "utf-8", "unicode11utf8": "utf-8", "unicode20utf8": "utf-8", "x-unicode20utf8": "utf-8",
    "utf-16": "utf-16-le", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "ucs-2": "utf-16-le", "unicode": "utf-16-le", "csunicode": "utf-16-le", "iso-10646-ucs-2": "utf-16-le", "unicodefeff": "utf-16-le", "unicodefffe": "utf-16-be",
    "utf-32": "utf-32-le", "utf-32le": "utf-32-le", "utf-32be": "utf-32-be",
    "ascii": "cp1252", "us-ascii": "cp1252", "latin1": "cp1252", "l1": "cp1252", "iso-8859-1": "cp1252", "iso8859-1": "cp1252", "iso88591": "cp1252", "iso-ir-100": "cp1252", "csisolatin1": "cp1252", "cp819": "cp1252", "ibm819": "cp1252", "ansi-x3.4-1968": "cp1252",
    "latin5": "cp1254", "l5": "cp1254", "iso-8859-9": "cp1254", "iso8859-9": "cp1254", "iso88599": "cp1254", "iso-ir-148": "cp1254", "csisolatin5": "cp1254",
    "iso-8859-11": "cp874", "iso8859-11": "cp874", "iso885911": "cp874", "tis-620": "cp874", "dos-874": "cp874", "windows-874": "cp874",
    "iso-8859-8-i": "iso8859_8", "iso-8859-8-e": "iso8859_8", "logical": "iso8859_8", "visual": "iso8859_8",
    "gb2312": "gbk", "gb-2312-80": "gbk", "chinese": "gbk", "csgb2312": "gbk", "iso-ir-58": "gbk", "x-gbk": "gbk",
    "big5-hkscs": "big5hkscs", "x-x-big5": "big5", "cn-big5": "big5", "csbig5": "big5",
    "sjis": "shift_jis", "x-sjis": "shift_jis", "ms-kanji": "cp932", "ms932": "cp932", "windows-31j": "cp932", "csshiftjis": "shift_jis",
    "x-euc-jp": "euc_jp", "cseucpkdfmtjapanese": "euc_jp", "csiso2022jp": "iso2022_jp",
    "korean": "euc_kr", "ks-c-5601-1987": "euc_kr", "ks-c-5601-1989": "euc_kr", "ksc5601": "euc_kr", "ksc-5601": "euc_kr", "iso-ir-149": "euc_kr", "cseuckr": "euc_kr", "csksc56011987": "euc_kr", "windows-949": "cp949",
    "koi": "koi8_r", "koi8": "koi8_r", "cskoi8r": "koi8_r", "koi8-ru": "koi8_u",
    "866": "cp866", "ibm866": "cp866", "csibm866": "cp866",
    "mac": "mac_roman", "macintosh": "mac_roman", "csmacintosh": "mac_roman", "x-mac-roman": "mac_roman", "x-mac-cyrillic": "mac_cyrillic", "x-mac-ukrainian": "mac_cyrillic",
}
#: Labels that follow a rule: (pattern, Python's name), in which the number counts. What is taken by a codec of the same name is the last.
LABEL_RULES = [
    (r"(?:windows-|x-cp|cp)(125[0-8])", "cp{}"),
    (r"iso-?8859-?([2-8]|1[03-6])", "iso8859_{}"),
    (r"(?:latin|l|csisolatin)([2-46])", "latin{}"),
    (r"(gbk|gb18030|big5|shift[-_]jis|euc-(?:jp|kr)|koi8-[ru]|iso-2022-jp|utf-8|utf-16-[lb]e|utf-32-[lb]e)", "{}"),
]

#: Control characters other than tab, LF and CR, and noncharacters: garbage that some legacy codec takes for text.
_GARBAGE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ufdd0-\ufdef" + "".join(chr(p << 16 | x) for p in range(17) for x in (0xFFFE, 0xFFFF)) + "]")
_ESCAPED = re.compile(rb"\x1b[\x20-\x2f]+[\x40-\x7e]")

#: Rows that are Python objects at a time.
ROWS = 128
RESULT = "kind string, text string, encoding string, reason string, candidates array<string>, rescued boolean, note string"


@dataclass(frozen=True)
class Decoded:
    """kind: text, binary or rejected; reason and candidates of a rejection; a note on how it was decoded."""

    kind: str
    text: str | None = None
    encoding: str | None = None
    reason: str | None = None
    candidates: tuple[str, ...] = ()
    rescued: bool = False
    note: str | None = None


def _strict(data: bytes, codec: str) -> str | None:
    try:
        text = data.decode(codec)
    except (UnicodeDecodeError, LookupError):
        return None
    # undefined C1 bytes must not pass as characters
    return None if codec == "cp1252" and re.search("[\x80-\x9f]", text) else text


#: Bytes of a segment; each must decode by itself where an encoding isn't taken as named.
SEGMENT_BYTES = 4 << 10
SINGLE_BYTE = ("cp1252",)


def non_ascii(data: bytes) -> int:
    return len(data) - len(data.translate(None, bytes(range(128, 256))))


def validated(data: bytes, codec: str, named: bool = False) -> str | None:
    """The text, if the bytes decode without garbage, come back byte by byte, and each segment decodes alone; for an encoding of several bytes that was named, the first is enough."""
    text = _strict(data, codec)
    if text is None or _GARBAGE.search(text):
        return None
    if named and codec not in SINGLE_BYTE:
        return text
    if text.encode(codec) != data or any(_strict(data[a : a + SEGMENT_BYTES], codec) is None for a in range(0, len(data), SEGMENT_BYTES)):
        return None
    return text


def codec_of(label: str) -> str:
    """Python's name of the encoding that a label of the web, in any case, stands for."""
    key = label.strip().lower()
    if found := LEGACY.get(key) or LABELS.get(key) or LABELS.get(key.replace("_", "-")):
        return found
    for pattern, name in LABEL_RULES:
        if m := re.fullmatch(pattern, key.replace("_", "-")):
            return LEGACY.get(m[1]) or codecs.lookup(name.format(m[1])).name.replace("-", "_" if not m[1].startswith("utf") else "-")
    raise ConfigError(f"unknown encoding {label!r}")


def mark(data: bytes) -> tuple[bytes, str] | None:
    return next(((m, c) for m, c in MARKS if data.startswith(m)), None)


def is_magic(data: bytes) -> bool:
    return any(data.startswith(m) for m in MAGIC)


def explicit(data: bytes, label: str) -> Decoded:
    """Decode by a given encoding; its own mark is skipped, another one is an error."""
    codec = codec_of(label)
    if found := mark(data):
        if codecs.lookup(found[1]).name != codecs.lookup(codec).name:
            return Decoded("rejected", reason="bom_mismatch", candidates=(found[1],))
        data = data[len(found[0]) :]
    text = _strict(data, codec)
    if text is None:
        return Decoded("rejected", reason="undecodable")
    doubt = codec not in {c for _, c in MARKS} and _strict(data, "utf-8") is not None
    return Decoded("text", text, label, note="The bytes are UTF-8 as well; without an encoding they would be read as that." if doubt else None)


def ladder(data: bytes, nominator=None) -> Decoded:
    """Decode by the steps above; nominator: what nominate(data, labels) is asked of."""
    if found := mark(data):
        text = _strict(data[len(found[0]) :], found[1])
        return Decoded("rejected", reason="bom_mismatch", candidates=(found[1],)) if text is None else Decoded("text", text, found[1])
    if b"\x00" in data[:SENTINEL_BYTES]:
        return Decoded("binary", reason="nul")
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError as e:
        valid = e.start
    else:
        return Decoded("rejected", reason="iso_2022_signature") if _ESCAPED.search(data) else Decoded("text", text, "utf-8")
    if is_magic(data):
        return Decoded("binary", reason="magic")
    if valid >= CONFLICT_BYTES and sum(b > 127 for b in data[:valid]) >= CONFLICT_NON_ASCII:
        return Decoded("rejected", reason=f"mixed_or_inconsistent at byte {valid:#x}")
    if len(data) >= LEGACY_BYTES:
        return Decoded("rejected", reason="undecodable")
    if nominator and (label := nominator.nominate(data, tuple(x for x, codec in LEGACY.items() if validated(data, codec, True) is not None))):
        return Decoded("text", validated(data, LEGACY[label], True), label)
    clean = tuple(label for label, codec in LEGACY.items() if validated(data, codec) is not None)
    return Decoded("rejected", reason="ambiguous" if clean else "undecodable", candidates=clean)


def decoded(data: bytes, label: str | None = None, fallback: str | None = None, nominator=None) -> Decoded:
    """By the label, or by the steps and then, for what they reject but for marks, by the fallback."""
    if label:
        return explicit(data, label)
    out = ladder(data, nominator)
    if fallback and out.kind == "rejected" and out.reason != "bom_mismatch":
        again = explicit(data, fallback)
        if again.kind == "text":
            return Decoded("text", again.text, fallback, rescued=True)
    return out


def plain(content: Column) -> Column:
    """Bytes that are UTF-8 text by the first steps, judged without leaving the JVM."""
    head = F.substring(content, 1, SENTINEL_BYTES)
    as_text = content.cast("string")
    marked = F.lit(False)
    for m, _ in MARKS:
        marked = marked | F.startswith(content, F.lit(m))
    return ~marked & (F.position(F.lit(b"\x00"), head) == 0) & F.is_valid_utf8(as_text) & ~F.rlike(as_text, F.lit(r"\x1B[\x20-\x2F]+[\x40-\x7E]"))


def decode_array(column: pa.Array, label: str | None = None, fallback: str | None = None, nominator=None) -> pa.Array:
    """Structs of RESULT of an array of bytes, from Arrow to Arrow by ROWS, so that few texts of a batch are Python objects at a time."""
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    fields = pa.struct([(name, kinds[kind]) for name, kind in (f.split() for f in RESULT.split(", "))])
    parts = [pa.array([], fields)]
    for a in range(0, len(column), ROWS):
        each = column.slice(a, ROWS).to_pylist()
        rows = (decoded(x, label, fallback, nominator) if x is not None else Decoded("rejected", reason="undecodable") for x in each)
        parts.append(pa.array((vars(r) for r in rows), fields, size=len(each)))
    return pa.concat_arrays(parts)


def decode_column(content: Column, label: str | None = None, fallback: str | None = None, nominator=None) -> Column:
    """A struct of RESULT for binary content, by an Arrow function."""
    if label:
        codec_of(label)
    if fallback:
        codec_of(fallback)

    sent = SparkSession.active().sparkContext.broadcast(nominator) if nominator else None  # a table of pairs, whatever the files

    @F.arrow_udf(RESULT)
    def step(column: pa.Array) -> pa.Array:
        return decode_array(column, label, fallback, sent.value if sent else None)

    return step(content)


def decode_files(files: DataFrame, label: str | None = None, fallback: str | None = None, nominator=None) -> DataFrame:
    """files (content) with the fields of RESULT; plain UTF-8 stays in the JVM, the rest goes through decode_column()."""
    if label:
        return files.withColumn("_d", decode_column(F.col("content"), label)).select("*", "_d.*").drop("_d", "content")
    files = files.withColumn("_plain", F.coalesce(plain(F.col("content")), F.lit(False)))
    names = [f.split()[0] for f in RESULT.split(", ")]
    # one pass: what is plain goes to the Arrow function as null
    rows = files.withColumn("_d", decode_column(F.when(~F.col("_plain"), F.col("content")), None, fallback, nominator))
    easy = {"kind": F.lit("text"), "text": F.col("content").cast("string"), "encoding": F.lit("utf-8"), "reason": F.lit(None).cast("string"), "candidates": F.array().cast("array<string>"), "rescued": F.lit(False), "note": F.lit(None).cast("string")}
    return rows.select(*(c for c in files.columns if c not in ("_plain", "content")), *(F.when(F.col("_plain"), easy[n]).otherwise(F.col(f"_d.{n}")).alias(n) for n in names))
