"""Structure-aware overlapping chunks.

Sizes are bytes, so everything works on UTF-8 bytes and is decoded at the end.
A text becomes segments (paragraphs, headings, pages), oversized segments are
cut into pieces, and pieces are packed into chunks that begin with an overlap
carried from the chunk before.  A carry that leaves no room for the next piece
becomes a chunk of its own, as the engine this follows has it;
``drop_carry_only`` leaves such chunks out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET, OVERLAP, MAX_LINE = 3072, 256, 1 << 20
_HEADING = re.compile(rb"[ \t]*#{1,6}(?:[ \t]|\Z)")
_SPACE = b" \t\r\n\x0b\x0c"
#: All characters with the White_Space property.
_BLANKS = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _trim(raw: bytes) -> bytes:
    """Without white space at both ends."""
    raw = raw.strip(_SPACE)
    if raw and (raw[0] > 127 or raw[-1] > 127):
        raw = raw.decode("utf-8", "replace").strip(_BLANKS).encode("utf-8")
    return raw


@dataclass
class Segment:
    first: int
    last: int
    text: bytes
    hard: bool = False


@dataclass
class Chunk:
    chunk_index: int
    line_start: int
    line_end: int
    text: str


def sizes(target: int, overlap: int) -> tuple[int, int]:
    target = target if target > 0 else TARGET
    overlap = max(0, overlap)
    return target, overlap if overlap < target else target // 4


def _lines(raw: bytes) -> list[bytes]:
    parts = raw.split(b"\n")
    if parts[-1] == b"":
        parts.pop()
    if any(len(p) > MAX_LINE for p in parts):
        raise ValueError("line too long")
    return [p[:-1] if p.endswith(b"\r") else p for p in parts]


class _Collector:
    """Lines of the segment being read."""

    def __init__(self) -> None:
        self.done: list[Segment] = []
        self.held: list[bytes] = []
        self.first = 0

    def put(self, line: bytes, number: int) -> None:
        if not self.held:
            self.first = number
        self.held.append(line)

    def close(self, last: int, hard: bool = False) -> None:
        text = b"\n".join(self.held).rstrip(b"\n")
        if _trim(text):
            self.done.append(Segment(self.first, last, text, hard))
        self.held = []


def segments(raw: bytes) -> list[Segment]:
    """Paragraphs, headings with what follows them, and pages."""
    c, number = _Collector(), 0
    for number, line in enumerate(_lines(raw), 1):
        if b"\f" in line:
            for k, part in enumerate(line.split(b"\f")):
                if k:
                    c.close(number - 1)
                    c.put(part, number)
                    c.close(number, hard=True)
                elif _trim(part):
                    c.put(part, number)
        elif not _trim(line):
            c.close(number - 1)
        else:
            if _HEADING.match(line):
                c.close(number - 1)
            c.put(line, number)
    c.close(number)
    for k, s in enumerate(c.done):
        if k and _HEADING.match(s.text.split(b"\n", 1)[0]):
            s.hard = True
    return c.done


def pieces(s: Segment, target: int) -> list[Segment]:
    """An oversized segment in windows: cut after a late line end, else before
    the character that the window would split."""
    out, rest = [], s.text
    while rest:
        if len(rest) <= target:
            cut = len(rest)
        else:
            line_end = rest.rfind(b"\n", 0, target)
            if line_end > target // 4:
                cut = line_end + 1
            else:
                cut = target
                while cut > 0 and rest[cut] & 0xC0 == 0x80:
                    cut -= 1
                cut = cut or target
        text = _trim(rest[:cut])
        if text:
            out.append(Segment(s.first, s.last, text, s.hard if not out else True))
        rest = rest[cut:]
    return out


def overlap_suffix(text: bytes, size: int) -> bytes:
    """The end of a chunk that the next one repeats: at most *size* bytes, whole
    characters, from behind the first blank in it, if anything is there."""
    if size <= 0:
        return b""
    if len(text) <= size:
        return text
    at = len(text) - size
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at += 1
    whole = text[at:]
    blank = re.search(rb"[ \t\n](?=.)", whole, re.S)
    return _trim(whole[blank.end() :] if blank else whole)


def chunk_text(text: str, target: int = TARGET, overlap: int = OVERLAP, drop_carry_only: bool = False) -> list[Chunk]:
    target, overlap = sizes(target, overlap)
    out: list[Chunk] = []
    buffer, carry = b"", b""
    first = last = 0
    own = False  # whether anything besides the carry is in the buffer

    def flush() -> None:
        nonlocal buffer, carry, own
        body = _trim(buffer)
        if body:
            if own or not drop_carry_only:
                out.append(Chunk(len(out), first, last, body.decode("utf-8", "replace")))
            carry = overlap_suffix(body, overlap)
        buffer, own = b"", False

    def start(unit: Segment) -> None:
        nonlocal buffer, first
        first = unit.first
        if carry:
            buffer = carry + b"\n"

    def gap() -> bytes:
        return b"" if not buffer or buffer.endswith(b"\n") else b"\n\n"

    for s in segments(text.encode("utf-8", "replace")):
        for unit in pieces(s, target) if len(s.text) > target else [s]:
            if unit.hard and buffer:
                flush()
            if not buffer:
                start(unit)
            if buffer and len(buffer) + len(gap()) + len(unit.text) > target:
                flush()
                start(unit)
            buffer += gap() + unit.text
            own, last = True, unit.last
            if len(buffer) >= target:
                flush()
    if buffer:
        flush()
    return out


def chunk_documents(docs: DataFrame, path_col: str, text_col: str, target: int = TARGET, overlap: int = OVERLAP, cap: int | None = None) -> DataFrame:
    """id, file_path, chunk_index, line_start, line_end, text; one Arrow pass, no
    shuffle.  All chunks of a text come out unless *cap* is set.  A text with a
    line over ``MAX_LINE`` bytes gives none; :func:`chunk_errors` names it."""

    def chunks_of(text: str) -> list[Chunk]:
        try:
            return chunk_text(text, target, overlap)[:cap]
        except ValueError:
            return []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (f"{path}#chunk-{c.chunk_index}", path, c.chunk_index, c.line_start, c.line_end, c.text)
                for path, text in zip(frame["file_path"], frame["text"])
                for c in chunks_of(text or "")
            ]
            yield pd.DataFrame(rows, columns=["id", "file_path", "chunk_index", "line_start", "line_end", "text"])

    kinds = "id string, file_path string, chunk_index int, line_start int, line_end int, text string"
    return docs.select(F.col(path_col).alias("file_path"), F.col(text_col).alias("text")).mapInPandas(run, kinds)


def chunk_errors(docs: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """path, error of the texts that cannot be chunked."""
    long = F.exists(F.split(F.col(text_col), "\n"), lambda x: F.octet_length(x) > MAX_LINE)
    return docs.where(long).select(F.col(path_col).alias("path"), F.lit("line too long").alias("error"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.octet_length("text")).alias("bytes"), F.max("line_end").alias("last_line"))
