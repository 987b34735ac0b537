"""Text and path expressions, all built-in functions inside code generation."""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with diacritics and what they are folded to.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżžſ"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzzs"

TOKEN = r"[\p{L}\p{N}\p{Co}]+"
_QUOTES = "\"'`"


def let(value: Column, body) -> Column:
    """Evaluate *value* once per row and build an expression from it: inside
    lambdas an expression would otherwise be evaluated for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(text: Column) -> Column:
    """Lower case without diacritics; a capital dotted I becomes a plain i."""
    return F.translate(F.lower(F.translate(F.coalesce(text, F.lit("")), "İ", "i")), FOLD_FROM, FOLD_TO)


def tokens(text: Column) -> Column:
    """Folded runs of letters, numbers and private-use characters."""
    return F.regexp_extract_all(fold(text), F.lit(f"({TOKEN})"), F.lit(1))


def plain_tokens(text: str) -> list[str]:
    """The same tokens of a query string, on the driver."""
    folded = text.replace("İ", "i").lower().translate(str.maketrans(FOLD_FROM, FOLD_TO))
    return regex.findall(TOKEN, folded)


def query_phrases(query: str) -> list[list[str]]:
    """A query is the conjunction of its fields; each field is a phrase of tokens.

    Fields are separated by white space and lose quote characters at their ends.
    A field without tokens stays as an empty phrase, which nothing matches.
    """
    fields = [f.strip(_QUOTES) for f in query.split()]
    phrases = [plain_tokens(f) for f in fields if f]
    if not phrases:
        raise ValueError("query has no searchable terms")
    return phrases


def line_terms(query: str, case_sensitive: bool = False) -> list[str]:
    """Terms of a line search: fields without quotes, lower-cased unless case matters."""
    found = [f.strip(_QUOTES) for f in query.split()]
    return [f if case_sensitive else f.lower() for f in found if f]


def substring_count(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a literal term."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int")


def snippet(text: Column, limit: int = 300) -> Column:
    """The first *limit* bytes of the trimmed text and an ellipsis; a character
    that the cut would split is dropped."""
    whole = F.trim(text)
    raw = F.encode(whole, "UTF-8")
    # a cut before a continuation byte (10xxxxxx) splits a character: back up to its first byte
    def continues(at: int) -> Column:
        return F.ascii(F.decode(F.substring(raw, at + 1, 1), "ISO-8859-1")).between(128, 191)

    cut = F.when(~continues(limit), limit).when(~continues(limit - 1), limit - 1).when(~continues(limit - 2), limit - 2).otherwise(limit - 3)
    short = F.concat(F.decode(F.substring(raw, F.lit(1), cut), "UTF-8"), F.lit("..."))
    return F.when(F.octet_length(whole) <= limit, whole).otherwise(short)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """The folder of a path: ``/`` for a file right below it, null without one."""
    above = F.regexp_replace(path, r"/[^/]*$", "")
    return F.when(~F.contains(path, F.lit("/")), F.lit(None).cast("string")).when(above == "", "/").otherwise(above)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, or the empty string."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def is_heading(line: Column) -> Column:
    """Markdown ATX heading: one to six marks, then blank or end."""
    return line.rlike(r"^[ \t]*#{1,6}([ \t]|$)")


def collapse_blank_lines(text: Column) -> Column:
    """Trim each line, keep at most one blank line in a row, trim the whole."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    return F.trim(F.regexp_replace(F.array_join(lines, "\n"), r"^\n+|\n+$|\n{3,}", "\n\n"))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def under(path: Column, root: str, ascii_ci: bool = False) -> Column:
    """The path itself or anything beneath it."""
    root = root.rstrip("/")
    if ascii_ci:
        return (path == root) | F.lower(path).startswith(f"{root}/".lower())
    return (path == root) | path.startswith(f"{root}/")
