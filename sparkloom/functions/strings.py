"""String expressions: escapes, paths, phrases, templates, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def xml_escape(text: Column) -> Column:
    """The five characters with named entities; the ampersand first."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def percent_encode(text: Column) -> Column:
    """RFC 3986: every byte but letters, digits and - . _ ~ as %XX."""
    for was, to in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        text = F.url_encode(text) if was == "+" else text
        text = F.replace(text, F.lit(was), F.lit(to))
    return text


def percent_decode(text: Column) -> Column:
    """Each valid %XX becomes its byte; a plus stays a plus. Null where an escape is broken."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def normal_path(path: Column) -> Column:
    """Fold ``.`` and ``..`` without a file system; the parent of the root is the root, leading ``..`` of relative paths stay."""
    rooted = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    none = F.slice(parts, 1, 0)
    up = lambda acc: F.when((F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(
        F.when(rooted, acc).otherwise(F.array_append(acc, F.lit("..")))
    )
    folded = F.aggregate(parts, none, lambda acc, p: F.when(p == "..", up(acc)).otherwise(F.array_append(acc, p)))
    return F.concat(F.when(rooted, "/").otherwise(""), F.array_join(folded, "/"))


def tidy_phrases(line: Column, most: int = 8) -> Column:
    """Phrases between commas, trimmed, without closing full stops, each once (case ignored, first spelling), at most ``most``."""
    cut = F.transform(F.split(line, ","), lambda p: F.trim(F.regexp_replace(F.trim(p), r"\.+$", "")))
    take = lambda acc, p: F.when((p != "") & ~F.exists(acc, lambda q: F.lower(q) == F.lower(p)), F.array_append(acc, p)).otherwise(acc)
    kept = F.aggregate(cut, F.slice(cut, 1, 0), take)
    return F.array_join(F.slice(kept, 1, most), ", ")


def redact_paths(text: Column) -> Column:
    """Absolute paths, with a drive letter or a leading slash, become their last part; addresses with a scheme keep theirs."""
    token = r"""(?<![A-Za-z0-9:/])(?:[A-Za-z]:[/\\]|/(?=\S))(?:[^\s()\[\]{}<>"'/\\]*[/\\])*([^\s()\[\]{}<>"'/\\]*)"""
    return F.regexp_replace(text, token, "$1")


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Each ``{name}`` becomes its value, or stays where the value is null; values are not looked through again."""
    names = list(values)
    parts = F.split(template, r"(?=\{[a-z_]+\})|(?<=\})")
    filled = lambda p: F.coalesce(*(F.when(p == "{" + n + "}", values[n].cast("string")) for n in names), p)
    return F.array_join(F.transform(parts, filled), "") if names else template
