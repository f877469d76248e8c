"""Files as a source: a scan of binary files, and text out of PDF bytes.

The bytes come with the scan, on whatever file system it reads, so tasks open nothing themselves.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.text import PAGE_BREAK
from cairn.operators.chunking import LEAST_CUT, cut_at_sentences


def scan_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", recursive: bool = False) -> DataFrame:
    """``(path, modificationTime, length, content)``; the pattern minds the case of letters."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(folder)


_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"(": b"(", b")": b")", b"\\": b"\\"}
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_SHOW = re.compile(rb"/[^\s/\[\]()<>{}%]+|\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|T\*|'|\"|-?\d*\.?\d+|[A-Za-z]+\*?", re.S)


def _bytes(token: bytes) -> bytes:
    """What a string of a content stream holds."""
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def plain(m: re.Match) -> bytes:
        x = m.group(1)
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else _ESCAPES.get(x, b"" if x == b"\n" else x)

    return re.sub(rb"\\([0-7]{1,3}|.|\n)", plain, token[1:-1], flags=re.S)


def _string(token: bytes, font: tuple[int, dict[int, str]] | None = None) -> str:
    raw = _bytes(token)
    if font:
        size, table = font
        codes = [int.from_bytes(raw[i : i + size], "big") for i in range(0, len(raw), size)]
        return "".join(table.get(c, "") if size > 1 else table.get(c, bytes([c]).decode("cp1252", "ignore")) for c in codes)
    return raw[2:].decode("utf-16-be", "ignore") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "ignore")


def _to_unicode(cmap: bytes) -> tuple[int, dict[int, str]]:
    """``(bytes of a code, code -> text)`` of a ToUnicode table."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "ignore")
    table: dict[int, str] = {}
    wide = 1
    for part in re.findall(rb"begincodespacerange(.*?)endcodespacerange", cmap, re.S):
        wide = max([wide, *(len(x) // 2 for x in re.findall(rb"<([0-9A-Fa-f]+)>", part))])
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        table |= {int(c, 16): text(u) for c, u in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for low, high, one, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", part, re.S):
            first, last = int(low, 16), min(int(high, 16), int(low, 16) + 0xFFFF)
            if one:
                begin = text(one)
                table |= {c: begin[:-1] + chr(ord(begin[-1]) + c - first) for c in range(first, last + 1)} if begin else {}
            else:
                table |= {first + k: text(u) for k, u in enumerate(re.findall(rb"<([0-9A-Fa-f]+)>", many))}
    return wide, table


def _page_text(content: bytes, fonts: dict[bytes, tuple[int, dict[int, str]]] | None = None) -> str:
    """What a page's content stream shows: strings, a new line for each move of the text line."""
    out: list[str] = []
    stack: list[bytes] = []
    font = None
    for m in _SHOW.finditer(content):
        t = m.group()
        if t[:1] in b"(</" or t in (b"[", b"]") or re.fullmatch(rb"-?\d*\.?\d+", t):
            stack.append(t)
            continue
        strings = [x for x in stack if x[:1] in b"(<"]
        if t == b"Tf":
            font = next((fonts.get(x[1:]) for x in stack if x[:1] == b"/"), None) if fonts else None
        if t in (b"Td", b"TD", b"T*", b"Tm", b"'", b'"') and out and not out[-1].endswith("\n"):
            out.append("\n")
        if t in (b"Tj", b"'", b'"'):
            out += [_string(x, font) for x in strings[-1:]]
        elif t == b"TJ":
            for x in stack:
                if x[:1] in b"(<":
                    out.append(_string(x, font))
                elif x not in (b"[", b"]") and x[:1] != b"/" and float(x) < -200:  # a wide gap is a space
                    out.append(" ")
        stack = []
    return "".join(out).strip("\n")


class _File:
    """The objects of a file, those packed in object streams too."""

    def __init__(self, data: bytes):
        self.objects = {int(n): body for n, body in _OBJECT.findall(data)}
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ValueError("the file is encrypted")
        packed: dict[int, bytes] = {}
        for body in self.objects.values():
            head = body[: body.find(b"stream")]
            if re.search(rb"/Type\s*/ObjStm\b", head):
                count, first = (int(re.search(rb"/%s\s+(\d+)" % k, head).group(1)) for k in (b"N", b"First"))
                inside = self.stream(body)
                places = list(map(int, inside[:first].split()[: 2 * count]))
                ends = [*places[3::2], len(inside) - first]
                packed |= {n: inside[first + a : first + b] for n, a, b in zip(places[::2], places[1::2], ends)}
        self.objects = packed | self.objects

    def stream(self, body: bytes) -> bytes:
        m = re.search(rb"stream\r?\n", body)
        if not m:
            return b""
        head = body[: m.start()]
        size = re.search(rb"/Length\s+(\d+)\b(?!\s+\d+\s+R)", head)
        raw = body[m.end() : m.end() + int(size.group(1))] if size else body[m.end() : body.rindex(b"endstream")]
        if b"ASCIIHexDecode" in head:
            raw = _bytes(b"<" + raw.split(b">")[0] + b">")
        # an object, so that bytes after the data do no harm
        return zlib.decompressobj().decompress(raw) if b"FlateDecode" in head else raw

    def value(self, body: bytes, key: bytes) -> bytes:
        """The dictionary or array after a key, wherever it is; b'' if there is none."""
        m = re.search(rb"/%s\s*(?:(\d+)\s+\d+\s+R\b|(?=<<|\[))" % key, body)
        if not m:
            return b""
        if m.group(1):
            return self.objects.get(int(m.group(1)), b"")
        rest, depth = body[m.end() :], 0
        for x in re.finditer(rb"<<|>>|\[|\]", rest):
            depth += 1 if x.group() in (b"<<", b"[") else -1
            if not depth:
                return rest[: x.end()]
        return rest

    def fonts(self, page: bytes) -> dict[bytes, tuple[int, dict[int, str]]]:
        """Tables of the page's fonts that have one; resources may be those of the page's parents."""
        for _ in range(50):
            resources = self.value(page, b"Resources")
            if resources or not (up := re.search(rb"/Parent\s+(\d+)\s+\d+\s+R", page)):
                break
            page = self.objects.get(int(up.group(1)), b"")
        out = {}
        for name, n in re.findall(rb"/([^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", self.value(resources, b"Font")):
            ref = re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", self.objects.get(int(n), b""))
            if ref:
                out[name] = _to_unicode(self.stream(self.objects.get(int(ref.group(1)), b"")))
        return out


def pdf_pages(data: bytes) -> list[str]:
    """The pages' texts. With ``pypdf`` installed it reads any PDF; otherwise a small reader takes
    plain, hexadecimal and deflated streams, object streams and fonts' ToUnicode tables, but no
    encrypted files."""
    try:
        from pypdf import PdfReader

        return [page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages]
    except ImportError:
        pass
    if not data.startswith(b"%PDF-"):
        raise ValueError("Header doesn't contain versioninfo")
    file = _File(data)
    pages = [(n, b) for n, b in file.objects.items() if re.search(rb"/Type\s*/Page\b", b)]
    if not pages:
        raise ValueError("no pages found")
    order = [int(x) for b in file.objects.values() if re.search(rb"/Type\s*/Pages\b", b) for k in re.findall(rb"/Kids\s*\[(.*?)\]", b, re.S) for x in re.findall(rb"(\d+)\s+\d+\s+R", k)]
    rank = {n: i for i, n in enumerate(order)}
    out = []
    for _, body in sorted(pages, key=lambda x: rank.get(x[0], x[0])):
        refs = re.search(rb"/Contents\s*(?:\[(.*?)\]|(\d+\s+\d+\s+R))", body, re.S)
        parts = [file.stream(file.objects.get(int(r), b"")) for r in re.findall(rb"(\d+)\s+\d+\s+R", (refs.group(1) or refs.group(2)) if refs else b"")]
        out.append(_page_text(b"\n".join(parts), file.fonts(body)))
    return out


def extract(data: bytes | None) -> tuple[str, str]:
    """``(text, debug)``; never raises: a failure is an empty text with its reason."""
    try:
        if not data:
            raise ValueError("the file is empty")
        pages = pdf_pages(data)
        return PAGE_BREAK.join(pages), f"Successfully extracted text from {len(pages)} pages."
    except Exception as e:
        return "", f"Error extracting text from PDF: {e}"


def extract_or_none(data: bytes | None) -> str | None:
    """The text, or None if it can't be had."""
    text, debug = extract(data)
    return None if debug.startswith("Error") else text


def chunks_of_file(path: str, window: int = 1500, overlap: int = 250, at_sentences: bool = False) -> list[tuple[int, int, str]] | None:
    """``(start, end, text)`` chunks of one local file, for a look at it; None if it can't be read."""
    try:
        with open(path, "rb") as f:
            text = extract_or_none(f.read())
    except OSError:
        return None
    return None if text is None else cut_at_sentences(text, window, overlap, LEAST_CUT if at_sentences else 1.0)


def extract_texts(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """``(path, length, text, debug)`` of scanned files, before normalization.

    Many small files share a scan partition; ``partitions`` spreads them for the extraction.
    """
    rows = files.select("path", F.col("length").cast("long").alias("length"), "content")
    if partitions:
        rows = rows.repartition(partitions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # one file's bytes at a time
                one = batch.slice(at, 1)
                text, debug = extract(one.column(2)[0].as_py())
                yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), pa.array([text]), pa.array([debug])], ["path", "length", "text", "debug"])

    return rows.mapInArrow(run, "path string, length long, text string, debug string")


def write_pdf(pages: list[str], compress: bool = False) -> bytes:
    """A plain PDF of some pages of text: a fixture, and a round trip for the reader."""
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b""]
    kids = []
    for page in pages:
        lines = [x.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") for x in page.split("\n")]
        stream = b"BT /F1 10 Tf 14 TL 40 780 Td " + b" T* ".join(b"(" + x + b") Tj" for x in lines) + b" ET"
        if compress:
            stream = zlib.compress(stream)
        objects.append(b"<< /Length %d%s >>\nstream\n" % (len(stream), b" /Filter /FlateDecode" if compress else b"") + stream + b"\nendstream")
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % len(objects))
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<< /Type /Pages /Kids [" + b" ".join(kids) + b"] /Count %d >>" % len(pages)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % (i + 1) + o + b"\nendobj\n" for i, o in enumerate(objects)) + b"trailer << /Root 1 0 R >>\n%%EOF\n"
