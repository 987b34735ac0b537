"""Plain text from files of many formats: a registry of byte extractors."""

from __future__ import annotations

import csv
import email
import io
import os
import re
import shutil
import signal
import subprocess
import tempfile
import threading
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Skip(Exception):
    """The file is left out, which is no error."""


@dataclass
class Extracted:
    text: str
    warn: list[str] = field(default_factory=list)


Extractor = Callable[[bytes], Extracted]

# Extensions read as they are.
TEXT_EXTENSIONS = (
    ".txt .md .markdown .rst .log .json .yaml .yml .toml .xml .ini .cfg .conf .go .py .js .ts .java .sh .sql"
).split()
#: bytes of an inflated PDF stream; a larger one is an error of its file
PDF_STREAM = 1 << 28
_BLOCKS = frozenset("br p div tr li h1 h2 h3 h4 h5 h6 section article".split())
_HIDDEN = frozenset("script style noscript".split())


def collapse(text: str) -> str:
    """Trimmed lines, at most one blank line in a row, no blank ends."""
    out: list[str] = []
    for line in (x.strip() for x in text.split("\n")):
        if line or (out and out[-1]):
            out.append(line)
    return "\n".join(out).strip()


def passthrough(data: bytes) -> Extracted:
    """UTF-8 text; each run of invalid bytes becomes one replacement character."""
    try:
        return Extracted(data.decode("utf-8"))
    except UnicodeDecodeError:
        marked = data.decode("utf-8", "surrogateescape")
        return Extracted(re.sub("[\udc80-\udcff]+", "�", marked), ["invalid UTF-8 replaced"])


class _PageText(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in _HIDDEN
        if tag in _BLOCKS and not self.hidden:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in _HIDDEN and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html(data: bytes) -> Extracted:
    page = _PageText()
    page.feed(passthrough(data).text)
    page.close()
    text = collapse("".join(page.parts))
    if not text:
        raise ValueError("no text in page")
    return Extracted(text)


_BREAKS = frozenset("p h br cr tab".split())


def _xml_text(data: bytes) -> str:
    """Character data; paragraph-like elements begin new lines."""
    parts: list[str] = []
    for event, node in ElementTree.iterparse(io.BytesIO(data), events=("start", "end")):
        name = node.tag.rsplit("}", 1)[-1]
        if event == "start":
            continue
        node_text = (node.text or "") + "".join((child.get("_t", "") + (child.tail or "")) for child in node)
        node.set("_t", ("\n" if name in _BREAKS else "") + node_text)
        for child in list(node):
            node.remove(child)
        root = node
    parts.append(root.get("_t", ""))
    return collapse("".join(parts))


def _zip(data: bytes) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(data))


def docx(data: bytes) -> Extracted:
    with _zip(data) as z:
        return Extracted(_xml_text(z.read("word/document.xml")))


def pptx(data: bytes) -> Extracted:
    with _zip(data) as z:
        slides = [n for n in z.namelist() if n.startswith("ppt/slides/slide") and n.endswith(".xml")]
        return Extracted("\n\n".join(t for n in slides if (t := _xml_text(z.read(n)))))


def odf(data: bytes) -> Extracted:
    with _zip(data) as z:
        return Extracted(_xml_text(z.read("content.xml")))


def _local(node) -> str:
    return node.tag.rsplit("}", 1)[-1]


def xlsx(data: bytes) -> Extracted:
    """Per sheet its name, then rows with tabs between cells."""
    with _zip(data) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iter() if _local(t) == "t") for item in root]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        sheets = [n for n in book.iter() if _local(n) == "sheet"]
        targets = {}
        if "xl/_rels/workbook.xml.rels" in names:
            for rel in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
                targets[rel.get("Id")] = rel.get("Target", "").lstrip("/").removeprefix("xl/")
        out = []
        for k, sheet in enumerate(sheets, 1):
            rel = next((v for a, v in sheet.attrib.items() if a.endswith("}id")), None)
            part = "xl/" + targets.get(rel, f"worksheets/sheet{k}.xml")
            rows = []
            for row in ElementTree.fromstring(z.read(part)).iter():
                if _local(row) == "row":
                    rows.append("\t".join(_cell(c, shared) for c in row))
            out.append("\n".join([sheet.get("name", ""), *rows]))
        return Extracted("\n".join(out))


def _cell(cell, shared: list[str]) -> str:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter() if _local(t) == "t")
    value = next((v.text or "" for v in cell if _local(v) == "v"), "")
    return shared[int(value)] if kind == "s" and value.isdigit() and int(value) < len(shared) else value


def csv_table(data: bytes) -> Extracted:
    text = passthrough(data).text
    try:
        rows = ["\t".join(r) for r in csv.reader(io.StringIO(text, newline=""), strict=False)]
    except csv.Error as e:
        return Extracted(text, [f"csv: {e}"])
    joined = "\n".join(rows)
    return Extracted(joined if joined.strip() else text)


_RTF = re.compile(r"\\'([0-9a-fA-F]{2})|\\([a-zA-Z]+)(-?\d+)? ?|\\([^a-zA-Z])|[{}\r]|([^\\{}\r]+)")


def rtf(data: bytes) -> Extracted:
    """Text without control words; par and line become line ends, tab a tab."""
    out = []
    for code, word, _, escaped, plain in _RTF.findall(data.decode("utf-8", "replace")):
        if plain:
            out.append(plain)
        elif word in ("par", "line"):
            out.append("\n")
        elif word == "tab":
            out.append("\t")
        elif escaped and escaped in "\\{}":
            out.append(escaped)
        del code
    return Extracted(collapse("".join(out)))


def eml(data: bytes) -> Extracted:
    message = email.message_from_bytes(data)
    _, _, body = data.replace(b"\r\n", b"\n").partition(b"\n\n")
    head = [message.get("Subject", ""), f"From: {message.get('From', '')}"]
    return Extracted("\n".join([*head, "", body.decode("utf-8", "replace")]).strip())


def _run(command: list[str], timeout: int = 30) -> str:
    done = subprocess.run(command, capture_output=True, timeout=timeout, check=False)
    if done.returncode:
        raise ValueError(f"{command[0]}: {done.stderr.decode('utf-8', 'replace')[:200]}")
    return done.stdout.decode("utf-8", "replace")


def scanned_pdf(data: bytes, language: str | None) -> Extracted:
    """Pages as images, read by OCR; a page that fails is a warning."""
    if language is None or not (shutil.which("pdftoppm") and shutil.which("tesseract")):
        raise Skip("no text layer")
    pages, warn = [], []
    with tempfile.TemporaryDirectory() as folder:
        with open(f"{folder}/in.pdf", "wb") as f:
            f.write(data)
        _run(["pdftoppm", "-png", "-r", "150", f.name, f"{folder}/page"], 300)
        # the page numbers are padded to one width
        for name in sorted(n for n in os.listdir(folder) if n.endswith(".png")):
            try:
                pages.append(_run(["tesseract", f"{folder}/{name}", "stdout", "-l", language]))
            except (ValueError, subprocess.TimeoutExpired) as e:
                warn.append(f"{name}: {e}")
    text = "\n".join(p for p in pages if p.strip())
    if not text:
        raise Skip("no text layer, and OCR found none")
    return Extracted(text, warn)


def _inflated(stream: bytes) -> bytes:
    """A stream as it is, or inflated where it is a zlib stream."""
    unpack = zlib.decompressobj()
    try:
        out = unpack.decompress(stream, PDF_STREAM)
    except zlib.error:
        return stream
    if unpack.unconsumed_tail:
        raise ValueError("PDF stream is too large")
    return out


def pdf(data: bytes, language: str | None = "eng") -> Extracted:
    """By pdftotext where it is installed, by OCR if there is no text layer and
    *language* is given; without pdftotext the text operators of plain or
    deflated streams, which is enough for simple generated files."""
    if shutil.which("pdftotext"):
        with tempfile.NamedTemporaryFile(suffix=".pdf") as f:
            f.write(data)
            f.flush()
            text = _run(["pdftotext", "-layout", "-enc", "UTF-8", f.name, "-"])
        return Extracted(text) if text.strip() else scanned_pdf(data, language)
    if not data.startswith(b"%PDF"):
        raise ValueError("not a PDF")
    shown = []
    for stream in re.findall(rb"stream\r?\n(.*?)endstream", data, re.S):
        for array, one in re.findall(rb"\[((?:[^\[\]()]|\((?:[^()\\]|\\.)*\))*)\]\s*TJ|\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|')", _inflated(stream)):
            shown.append(one if one or not array else b"".join(re.findall(rb"\(((?:[^()\\]|\\.)*)\)", array)))
    text = "\n".join(re.sub(rb"\\([()\\])", rb"\1", s).decode("latin-1") for s in shown)
    if not text.strip():
        raise Skip("no text layer")
    return Extracted(text)


def image(data: bytes, language: str | None = "eng") -> Extracted:
    """By tesseract where it is installed and *language* is given; else skipped."""
    if language is None or not shutil.which("tesseract"):
        raise Skip("OCR is off")
    with tempfile.NamedTemporaryFile() as f:
        f.write(data)
        f.flush()
        text = _run(["tesseract", f.name, "stdout", "-l", language])
    if not text.strip():
        raise ValueError("no text in image")
    return Extracted(text)


class Registry:
    """Extension to (format name, extractor); the first registration stays.

    *language*: of OCR, None for no OCR."""

    def __init__(self, text_only: bool = False, language: str | None = "eng"):
        self.by_extension: dict[str, tuple[str, Extractor]] = {}
        self.register("text", passthrough, TEXT_EXTENSIONS)
        if not text_only:
            for name, f, exts in (
                ("html", html, ".html .htm .xhtml"), ("pdf", partial(pdf, language=language), ".pdf"), ("docx", docx, ".docx"), ("pptx", pptx, ".pptx"),
                ("odf", odf, ".odt .ods .odp"), ("xlsx", xlsx, ".xlsx"), ("csv", csv_table, ".csv"), ("rtf", rtf, ".rtf"),
                ("eml", eml, ".eml"), ("image", partial(image, language=language), ".png .jpg .jpeg .tif .tiff .bmp .gif .webp"),
            ):
                self.register(name, f, exts.split())

    def register(self, name: str, extractor: Extractor, extensions: list[str]) -> None:
        for e in extensions:
            self.by_extension.setdefault(e.lower(), (name, extractor))

    def extensions(self) -> list[str]:
        return sorted(self.by_extension)

    def formats(self) -> dict[str, str]:
        return {e: name for e, (name, _) in self.by_extension.items()}

    def extract_within(self, ext: str, data: bytes, seconds: float):
        """:meth:`extract`, given up after so many seconds (in a main thread, as
        tasks have it): one file that hangs is an error row, not a stuck job."""
        if seconds <= 0 or threading.current_thread() is not threading.main_thread():
            return self.extract(ext, data)

        def late(*_):
            raise TimeoutError(f"extraction took over {seconds:g} s")

        before = signal.signal(signal.SIGALRM, late)
        signal.setitimer(signal.ITIMER_REAL, seconds)
        try:
            return self.extract(ext, data)
        except TimeoutError as e:
            return "error", None, [], str(e)
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)

    def extract(self, ext: str, data: bytes) -> tuple[str, str | None, list[str], str | None]:
        """(status, text, warnings, error); never raises."""
        try:
            found = self.by_extension.get(ext.lower(), ("text", passthrough))[1](data)
            return ("ok" if found.text.strip() else "empty"), found.text, found.warn, None
        except Skip as e:
            return "skip", None, [], str(e)
        except Exception as e:  # a broken file is a row, not a failed job
            return "error", None, [], f"{type(e).__name__}: {e}"


def dispatch(files: DataFrame, path_col: str, registry: Registry | None = None) -> DataFrame:
    """path, format by extension; unregistered ones have none."""
    from tidewater.functions.text import extension

    formats = (registry or Registry()).formats()
    table = F.create_map(*[F.lit(x) for kv in sorted(formats.items()) for x in kv])
    return files.select(F.col(path_col).alias("path"), F.element_at(table, extension(F.col(path_col))).alias("format"))


def extract_files(files: DataFrame, path_col: str, content_col: str, max_bytes: int | None = None, registry: Registry | None = None, seconds: float = 0) -> DataFrame:
    """path, status, text, warn, error; the text is whole, or with *max_bytes*
    cut at so many bytes, on a character's border.  With *seconds* a file that
    takes longer is an error."""
    registry = registry or Registry()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, data in zip(frame["path"], frame["content"]):
                dot = re.search(r"\.[^./]*$", path or "")
                status, text, warn, error = registry.extract_within(dot[0] if dot else "", bytes(data or b""), seconds)
                if max_bytes is not None and text is not None and len(raw := text.encode("utf-8", "replace")) > max_bytes:
                    text, warn = raw[:max_bytes].decode("utf-8", "ignore"), [*warn, f"cut at {max_bytes} bytes"]
                rows.append((path, status, text, warn, error))
            yield pd.DataFrame(rows, columns=["path", "status", "text", "warn", "error"])

    source = files.select(F.col(path_col).alias("path"), F.col(content_col).cast("binary").alias("content"))
    return source.mapInPandas(run, "path string, status string, text string, warn array<string>, error string")
