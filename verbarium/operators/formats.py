"""File formats by content: byte signatures at offset ranges from either end, members of zip archives, priorities between signatures, extensions.

Signatures are a table. A byte sequence is written in hexadecimal with gaps, wildcards, ranges and alternatives, and compiled to an automaton over the bytes
read as ISO 8859-1: a pattern on the file's beginning or on its end. Members of zip archives are looked up in the central directory, which lies at the end, by name and name length. So a file's first and last bytes
say all (`head_bytes`, `tail_bytes` follow from the table), and `edges` reads no others. Matching is expressions over these two columns; nothing is collected and no file is read twice.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What of a zip archive's end is looked through for its central directory.
DIRECTORY_BYTES = 1 << 16

REGISTRY = "https://www.nationalarchives.gov.uk/PRONOM/"

NO_EXTENSION, ONLY_EXTENSION, ONLY_TEXT = "extension mismatch", "match on extension only", "match on text only; extension mismatch"


@dataclass(frozen=True)
class Sequence:
    bytes: str  # hexadecimal; ?? any byte, {n} and {n-m} gaps, [30:39] a range, (AA|BB) alternatives
    low: int = 0  # distance from the beginning, or of its end from the end
    high: int | None = None  # at most; None: as `low`
    at_end: bool = False


@dataclass(frozen=True)
class Signature:
    puid: str
    name: str
    mime: str | None
    extensions: tuple[str, ...] = ()
    sequences: tuple[Sequence, ...] = ()  # all must match
    members: tuple[str, ...] = ()  # of a zip archive; all must be there
    over: tuple[str, ...] = ()  # puids that give way to this one
    text: bool = False  # a format of plain text: by extension, where the content is text


_S = Sequence
_ZIP = _S("504B0304")
_ODF = "504B0304{26}6D696D65747970656170706C69636174696F6E2F766E642E6F617369732E6F70656E646F63756D656E742E"


def _hex(s: str) -> str:
    return s.encode().hex().upper()


#: fixed values: signatures of a public registry. Public identifier, name, media type, extensions, byte sequences.
SIGNATURES: tuple[Signature, ...] = (
    *(Signature(f"fmt/{n}", f"Acrobat PDF 1.{v} - Portable Document Format", "application/pdf", ("pdf",), (_S(f"255044462D312E3{v}", 0, 1024), _S("2525454F46", 0, 1024, True))) for v, n in enumerate((14, 15, 16, 17, 18, 19, 20, 276))),
    Signature("fmt/1129", "PDF 2.0 - Portable Document Format", "application/pdf", ("pdf",), (_S("255044462D322E30", 0, 1024), _S("2525454F46", 0, 1024, True))),
    Signature("fmt/11", "Portable Network Graphics 1.0", "image/png", ("png",), (_S("89504E470D0A1A0A0000000D49484452"),)),
    Signature("fmt/645", "Exchangeable Image File Format (Compressed) 2.2.1", "image/jpeg", ("jpg", "jpeg", "jpe"), (_S("FFD8FFE1{2}45786966"),), over=("fmt/41",)),
    Signature("fmt/43", "JPEG File Interchange Format 1.01", "image/jpeg", ("jpg", "jpeg", "jpe"), (_S("FFD8FFE0{2}4A464946000101"),), over=("fmt/41",)),
    Signature("fmt/44", "JPEG File Interchange Format 1.02", "image/jpeg", ("jpg", "jpeg", "jpe"), (_S("FFD8FFE0{2}4A464946000102"),), over=("fmt/41",)),
    Signature("fmt/41", "Raw JPEG Stream", "image/jpeg", ("jpg", "jpeg", "jpe"), (_S("FFD8FF"),)),
    Signature("fmt/3", "Graphics Interchange Format 87a", "image/gif", ("gif",), (_S("474946383761"),)),
    Signature("fmt/4", "Graphics Interchange Format 89a", "image/gif", ("gif",), (_S("474946383961"),)),
    Signature("fmt/353", "Tagged Image File Format", "image/tiff", ("tif", "tiff"), (_S("(49492A00|4D4D002A)"),)),
    Signature("fmt/566", "WebP", "image/webp", ("webp",), (_S("52494646{4}57454250"),)),
    Signature("fmt/119", "Windows Bitmap 3.0", "image/bmp", ("bmp",), (_S("424D{4}00000000{4}28000000"),)),
    Signature("fmt/141", "Waveform Audio (PCMWAVEFORMAT)", "audio/x-wav", ("wav",), (_S("52494646{4}57415645666D7420{4}0100"),), over=("fmt/6",)),
    Signature("fmt/6", "Waveform Audio", "audio/x-wav", ("wav",), (_S("52494646{4}57415645"),)),
    Signature("fmt/5", "Audio/Video Interleaved Format", "video/x-msvideo", ("avi",), (_S("52494646{4}415649204C495354"),)),
    Signature("fmt/134", "MPEG 1/2 Audio Layer 3", "audio/mpeg", ("mp3",), (_S("(494433|FFFB|FFF3|FFF2)"),)),
    Signature("fmt/279", "FLAC (Free Lossless Audio Codec)", "audio/flac", ("flac",), (_S("664C614300000022"),)),
    Signature("fmt/203", "Ogg Vorbis Codec Compressed Multimedia File", "audio/ogg", ("ogg", "oga"), (_S("4F676753{24}01766F72626973"),)),
    Signature("fmt/414", "Audio Interchange File Format", "audio/x-aiff", ("aif", "aiff"), (_S("464F524D{4}41494646"),)),
    Signature("fmt/199", "MPEG-4 Media File", "application/mp4", ("mp4", "m4a", "m4v"), (_S("66747970(69736F6D|6D703431|6D703432|4D344120|4D345620)", 4),)),
    Signature("fmt/569", "Matroska", "video/x-matroska", ("mkv", "mka"), (_S("1A45DFA3{0-32}428288" + _hex("matroska")),)),
    Signature("fmt/412", "Microsoft Word for Windows 2007 onwards", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ("docx",), (_ZIP,), ("[Content_Types].xml", "word/document.xml"), ("x-fmt/263",)),
    Signature("fmt/214", "Microsoft Excel for Windows 2007 onwards", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ("xlsx",), (_ZIP,), ("[Content_Types].xml", "xl/workbook.xml"), ("x-fmt/263",)),
    Signature("fmt/215", "Microsoft Powerpoint for Windows 2007 onwards", "application/vnd.openxmlformats-officedocument.presentationml.presentation", ("pptx",), (_ZIP,), ("[Content_Types].xml", "ppt/presentation.xml"), ("x-fmt/263",)),
    Signature("fmt/291", "OpenDocument Text 1.2", "application/vnd.oasis.opendocument.text", ("odt",), (_S(_ODF + _hex("text")),), over=("x-fmt/263",)),
    Signature("fmt/295", "OpenDocument Spreadsheet 1.2", "application/vnd.oasis.opendocument.spreadsheet", ("ods",), (_S(_ODF + _hex("spreadsheet")),), over=("x-fmt/263",)),
    Signature("fmt/483", "ePub format", "application/epub+zip", ("epub",), (_S("504B0304{26}" + _hex("mimetypeapplication/epub+zip")),), over=("x-fmt/263",)),
    Signature("x-fmt/263", "ZIP Format", "application/zip", ("zip",), (_ZIP,)),
    Signature("x-fmt/265", "Tape Archive Format", "application/x-tar", ("tar",), (_S("7573746172", 257),)),
    Signature("x-fmt/266", "GZIP Format", "application/gzip", ("gz", "tgz"), (_S("1F8B08"),)),
    Signature("fmt/484", "7Zip format", "application/x-7z-compressed", ("7z",), (_S("377ABCAF271C"),)),
    Signature("fmt/111", "OLE2 Compound Document Format", None, ("doc", "xls", "ppt", "msg"), (_S("D0CF11E0A1B11AE1"),)),
    Signature("fmt/729", "SQLite Database File Format", "application/vnd.sqlite3", ("sqlite", "sqlite3", "db"), (_S("53514C69746520666F726D6174203300"),)),
    Signature("fmt/355", "Rich Text Format 1.9", "application/rtf", ("rtf",), (_S("7B5C72746631"),)),
    Signature("fmt/471", "Hypertext Markup Language 5", "text/html", ("html", "htm"), (_S("3C21(444F4354595045|646F6374797065)20(48544D4C|68746D6C)3E", 0, 1024),), over=("fmt/101",)),
    Signature("fmt/92", "Scalable Vector Graphics 1.1", "image/svg+xml", ("svg",), (_S("3C3F786D6C20"), _S("3C737667", 0, 2048)), over=("fmt/101",)),
    Signature("fmt/101", "Extensible Markup Language 1.0", "text/xml", ("xml", "eaf", "trs"), (_S("3C3F786D6C20", 0, 3),)),
    Signature("x-fmt/18", "Comma Separated Values", "text/csv", ("csv",), text=True),
    Signature("x-fmt/13", "Tab-separated Values", "text/tab-separated-values", ("tsv",), text=True),
    Signature("fmt/817", "JSON Data Interchange Format", "application/json", ("json", "jsonld"), text=True),
    Signature("fmt/1149", "Markdown", "text/markdown", ("md", "markdown"), text=True),
    Signature("x-fmt/111", "Plain Text File", "text/plain", ("txt", "cha", "log"), text=True),
)


# -- the table compiled ------------------------------------------------------------------------------------------------------------------

_PIECE = re.compile(r"\s*(?:(\?\?)|\{(\d+)(?:-(\d+))?\}|\[([0-9A-Fa-f]{2}):([0-9A-Fa-f]{2})\]|([(|)])|([0-9A-Fa-f]{2}))")


def pattern_of(sequence: str) -> tuple[str, int]:
    """A Java pattern over bytes read as ISO 8859-1, and how many bytes it takes at most."""
    out, at, widths = [], 0, [[0]]
    while at < len(sequence.rstrip()):
        m = _PIECE.match(sequence, at)
        if not m:
            raise ValueError(f"not a byte sequence: {sequence} at {at}")
        at = m.end()
        anything, low, high, first, last, mark, byte = m.groups()
        if mark == "(":
            out.append("(?:")
            widths.append([0])
        elif mark == "|":
            out.append("|")
            widths[-1].append(0)
        elif mark == ")":
            if len(widths) < 2:
                raise ValueError(f"not a byte sequence: {sequence}")
            out.append(")")
            most = max(widths.pop())
            widths[-1][-1] += most
        else:
            out.append("." if anything else f".{{{low},{high or low}}}" if low else rf"[\x{first}-\x{last}]" if first else rf"\x{byte}")
            widths[-1][-1] += int(high or low) if low else 1
    if len(widths) != 1 or len(widths[0]) != 1:
        raise ValueError(f"not a byte sequence: {sequence}")
    return "".join(out), widths[0][0]


def _in_head(s: Sequence) -> tuple[str, int]:
    body, width = pattern_of(s.bytes)
    high = s.low if s.high is None else s.high
    return rf"(?s)\A.{{{s.low},{high}}}?{body}", high + width


def _in_tail(s: Sequence) -> tuple[str, int]:
    body, width = pattern_of(s.bytes)
    high = s.low if s.high is None else s.high
    return rf"(?s){body}.{{{s.low},{high}}}\z", high + width


def _member(name: str) -> str:
    """An entry of a zip's central directory with exactly this name: its header has the name's length at 28 and the name at 46."""
    raw = name.encode()
    text = "".join(rf"\x{b:02X}" for b in raw)
    return rf"(?s)\x50\x4B\x01\x02.{{24}}\x{len(raw) & 255:02X}\x{len(raw) >> 8:02X}.{{16}}{text}"


def head_bytes(signatures: Iterable[Signature] = SIGNATURES) -> int:
    return max([512, *(_in_head(s)[1] for g in signatures for s in g.sequences if not s.at_end)])


def tail_bytes(signatures: Iterable[Signature] = SIGNATURES) -> int:
    return max([0, *(_in_tail(s)[1] for g in signatures for s in g.sequences if s.at_end), *(DIRECTORY_BYTES for g in signatures if g.members)])


def signatures_of(rows: DataFrame, most: int = 5000) -> tuple[Signature, ...]:
    """Signatures from a table in its order: no, puid, name, mime, extensions, sequences (array of bytes, low, high, at_end), members, over, text."""
    found = rows.orderBy("no").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} signatures")
    listed = lambda x: tuple(x or ())
    return tuple(Signature(r.puid, r.name, r.mime, listed(r.extensions), tuple(Sequence(s.bytes, s.low or 0, s.high, bool(s.at_end)) for s in r.sequences or ()), listed(r.members), listed(r.over), bool(r.text)) for r in found)


# -- files -----------------------------------------------------------------------------------------------------------------------------------


def edges_of_content(files: DataFrame, signatures: Iterable[Signature] = SIGNATURES) -> DataFrame:
    """path, head, tail of files that are held whole (path, content)."""
    signatures = tuple(signatures)
    tail = tail_bytes(signatures)
    end = F.substring("content", F.greatest(F.octet_length("content") - tail + 1, F.lit(1)), F.lit(tail))
    return files.select("path", F.substring("content", 1, head_bytes(signatures)).alias("head"), end.alias("tail"))


def edges(spark: SparkSession, folder: str, signatures: Iterable[Signature] = SIGNATURES) -> DataFrame:
    """path, head, tail of all files below a folder: listed by Spark, and of each only the bytes that the signatures need are read. The folder's scheme must be one that
    `pyarrow.fs` knows on the executors (empty files aren't listed); elsewhere, edges_of_content() on Spark's binaryFile does."""
    signatures = tuple(signatures)
    first, last = head_bytes(signatures), tail_bytes(signatures)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                paths, sizes = (batch.column(c).slice(k, 200).to_pylist() for c in ("path", "length"))
                rows = []
                for path, size in zip(paths, sizes):
                    fs, name = pafs.FileSystem.from_uri(path)
                    with fs.open_input_file(name) as f:
                        rows.append((path, f.read_at(min(first, size), 0), f.read_at(min(last, size), size - min(last, size))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary(), pa.binary()))], ["path", "head", "tail"])

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return listed.mapInArrow(run, "path string, head binary, tail binary")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1))


_TEXT = r"(?s)\A[\x09\x0A\x0C\x0D\x1B\x20-\x7E\x80-\xFF]+\z"


def identify(edges: DataFrame, signatures: Iterable[Signature] = SIGNATURES) -> DataFrame:
    """path, puid, name, mime, warning of the files that match something, from path, head and tail.

    Of the signatures that match, those to which another gives no precedence count, the first of the table. Where no bytes match: text formats by extension, then other
    formats by extension, then plain text by content; each with the warning that says so.
    """
    signatures = tuple(signatures)
    latin = lambda c: F.decode(F.coalesce(F.col(c), F.lit(b"")), "ISO-8859-1")
    rows = edges.select("path", latin("head").alias("h"), latin("tail").alias("t"), extension(F.col("path")).alias("ext"))

    def matches(s: Signature) -> Column:
        out = F.lit(True)
        for q in s.sequences:
            out = out & (F.col("t").rlike(_in_tail(q)[0]) if q.at_end else F.col("h").rlike(_in_head(q)[0]))
        for m in s.members:
            out = out & F.col("t").rlike(_member(m))
        return out

    def literal(value: object, schema: str) -> Column:
        return F.from_json(F.lit(json.dumps(value)), schema)

    def by_extension(text: bool) -> Column:
        first: dict[str, int] = {}
        for k, s in enumerate(signatures):
            for e in s.extensions if s.text == text else ():
                first.setdefault(e, k)
        return F.try_element_at(literal(first, "map<string,int>"), F.col("ext"))

    table = literal([{"puid": s.puid, "name": s.name, "mime": s.mime, "extensions": s.extensions} for s in signatures], "array<struct<puid: string, name: string, mime: string, extensions: array<string>>>")
    beats = literal([[k for k, other in enumerate(signatures) if other.puid in s.over] for s in signatures], "array<array<int>>")
    plain = next((k for k, s in enumerate(signatures) if s.text and "txt" in s.extensions), None)
    found = F.filter(F.array(*[F.when(matches(s), F.lit(k)) for k, s in enumerate(signatures) if s.sequences or s.members]).cast("array<int>"), lambda k: k.isNotNull())
    rows = rows.withColumn("found", found).withColumn("beaten", F.flatten(F.transform("found", lambda k: F.get(beats, k))))
    is_text = F.col("h").rlike(_TEXT)
    rows = rows.select("path", "ext", is_text.alias("is_text"), F.get(F.array_except("found", "beaten"), F.lit(0)).alias("best"), by_extension(True).alias("as_text"), by_extension(False).alias("as_other"))
    only_text = F.when(F.col("is_text"), F.lit(plain).cast("int"))
    named = rows.withColumn("s", F.get(table, F.coalesce("best", "as_text", "as_other", only_text))).where("s IS NOT NULL")
    warning = (
        F.when(F.col("best").isNotNull(), F.when(~F.array_contains("s.extensions", F.col("ext")), NO_EXTENSION))
        .when(F.col("as_text").isNotNull(), F.when(~F.col("is_text"), ONLY_EXTENSION)).when(F.col("as_other").isNotNull(), ONLY_EXTENSION).otherwise(ONLY_TEXT)
    )
    return named.select("path", "s.puid", "s.name", "s.mime", warning.alias("warning"))


def encoding_formats(identified: DataFrame) -> DataFrame:
    """path, encoding_format (the media type, else the registry's address), puid, name, warning."""
    return identified.select("path", F.coalesce("mime", F.concat(F.lit(REGISTRY), "puid")).alias("encoding_format"), "puid", "name", "warning")
