"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import METADATA


def tokenize(text: Column | str) -> Column:
    """Lower-case parts of identifiers: runs of letters and digits, cut between digits and letters,
    before a capital after a small letter, and before the last capital of a run of them."""
    text = F.col(text) if isinstance(text, str) else text
    cut = r"(?<=\p{N})(?=\p{L})|(?<=\p{L})(?=\p{N})|(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
    parts = F.split(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), cut, " "), " ")
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.lower(x))


def metadata_text(metadata: Column | str) -> Column:
    """Decorators, return type, superclasses and visibility of a symbol's JSON metadata."""
    m = F.from_json(metadata, METADATA)
    return F.concat_ws(" ", m["decorators"], m["return_type"], m["superclasses"], m["visibility"])


def byte_head(text: Column, most: int) -> Column:
    """The longest beginning of at most ``most`` UTF-8 bytes: a byte that only continues a cut last
    character goes, and so does that character's first byte."""
    raw = F.substring(text.cast("binary"), 1, most)
    heads = [F.substring(raw, F.lit(1), F.length(raw) - n) for n in range(4)]
    return F.coalesce(*[F.try_validate_utf8(h.cast("string")) for h in heads])


def embedding_text(kind: Column, name: Column, signature: Column, metadata: Column, content: Column, max_tokens: int = 512) -> Column:
    """What is embedded of a symbol; the content's head is cut at a number of bytes, at a character's edge."""
    m = F.from_json(metadata, METADATA)
    most = max(256, (max_tokens - 64) * 4)
    head = F.when(F.octet_length(content) <= most, content).otherwise(byte_head(content, most))
    return F.concat_ws(" ", kind, name, m["decorators"], signature, m["return_type"], m["superclasses"], head)


def snippet(text: Column, most: int = 200) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def strip_markup(text: Column) -> Column:
    """Markdown links, code, and bold and italics of either mark become their inner text; an underscore within a word stays."""
    inner = [r"\[([^\]\n]*)\]\([^)\n]*\)", r"`([^`\n]+)`"]
    inner += [rf"{m}([^{m[-1]}\n]+){m}" for m in (r"\*\*", r"\*")] + [rf"(?<!\w){m}([^_\n]+){m}(?!\w)" for m in ("__", "_")]
    for pattern in inner:
        text = F.regexp_replace(text, pattern, "$1")
    return text


def context_window(text: Column, start: Column, end: Column, around: int = 40) -> Column:
    """The text from ``around`` code points before a span (from 0, end exclusive) to as many after, widened to
    whole words; "..." stands for what is left out at either end."""
    n = F.char_length(text)
    left, right = F.greatest(start - around, F.lit(0)), F.least(end + around, n)
    a = left - F.char_length(F.regexp_extract(F.substring(text, F.lit(1), left), r"(\S*)\z", 1))
    b = right + F.char_length(F.regexp_extract(F.substring(text, right + 1, n), r"^(\S*)", 1))
    return F.concat(F.when(a > 0, "...").otherwise(""), F.substring(text, a + 1, b - a), F.when(b < n, "...").otherwise(""))


def iso_time(when: Column) -> Column:
    """A time as ISO 8601 text in UTC, to seconds."""
    return F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def from_iso(text: Column) -> Column:
    """The time of an ISO 8601 text, with or without fractions and offset; null for any other text."""
    return F.try_to_timestamp(text)


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", "")


def snake_case(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1_$2"))


def xml_escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def age_days(when: Column, today: Column | None = None) -> Column:
    return F.datediff(today if today is not None else F.current_date(), F.to_timestamp(when))


def repo_id(path: Column) -> Column:
    """The last component of a path and a short hash of the whole."""
    return F.concat(F.regexp_replace(F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1), "[^A-Za-z0-9_-]", "_"), F.lit("-"), F.substring(F.sha2(path, 256), 1, 8))
