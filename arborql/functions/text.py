"""Scalar text functions. Java's regex classes are ASCII only without (?U), and the corpora are not."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def re_split(s: Column, pattern: str) -> Column:
    """ST1: pieces between matches, empty ones dropped."""
    return F.filter(F.split(s, pattern, -1), lambda x: x != "")


def re_sub(s: Column, pattern: str, template: str) -> Column:
    """ST2: every match replaced; $n refers to groups."""
    return F.regexp_replace(s, pattern, template)


def re_sub_with(s: Column, pattern: str, body) -> Column:
    """ST3: every match replaced by body(match), a column expression: the gaps and the changed matches are zipped
    and joined, so no Python runs."""
    gaps, found = F.split(s, pattern, -1), F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
    return F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), F.transform(found, body).alias("m")),
                                    lambda x: F.concat(x["g"], F.coalesce(x["m"], F.lit("")))), "")


def re_is_match(s: Column, pattern: str) -> Column:
    """ST4: whether the pattern is found anywhere."""
    return s.rlike(pattern)


def re_match(s: Column, pattern: str, group: int = 0) -> Column:
    """ST5: a group of the first match; '' for a group that took no part, null without a match."""
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, group))


def re_matches(s: Column, pattern: str, group: int = 0) -> Column:
    """ST6: a group of every match."""
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(group))


def re_escape(pattern: str) -> str:
    """ST7: a pattern that matches the text itself, for Java and RE2 alike."""
    return re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", pattern)


def re_check(pattern: str) -> None:
    """ST7: refuse a malformed pattern on the driver, before a job meets it."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"bad pattern {pattern!r}: {e}") from e


def slugged(s: Column) -> Column:
    """ST8: word characters, spaces and symbols of kind So stay; runs of space become '-'; lower case. 'e' if
    nothing is left of something."""
    out = F.lower(F.regexp_replace(F.regexp_replace(s, r"(?U)[^\w\s\p{So}]", ""), r"(?U)\s+", "-"))
    return F.when((out == "") & (s != ""), F.lit("e")).otherwise(out)


#: Characters that url_encode changes and that a URL path, or a fragment, may hold.
_PATH_OK = {"%21": "!", "%24": "$", "%26": "&", "%27": "'", "%28": "(", "%29": ")", "%2B": "+", "%2C": ",", "%2F": "/", "%3A": ":", "%3D": "=", "%40": "@", "%7E": "~"}
_FRAGMENT_OK = _PATH_OK | {"%3F": "?", "%3B": ";"}


def _encoded(s: Column, allowed: dict[str, str]) -> Column:
    out = F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("*"))
    for code, char in allowed.items():
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def url_path_encoded(s: Column) -> Column:
    """ST9"""
    return _encoded(s, _PATH_OK)


def url_fragment_encoded(s: Column) -> Column:
    """ST9"""
    return _encoded(s, _FRAGMENT_OK)


def url_decoded(s: Column) -> Column:
    return F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))


def html_escaped(s: Column) -> Column:
    """ST10"""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def nesting_depth(path: Column) -> Column:
    """ST12: the number of slashes."""
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def relative_path(source: Column, target: Column) -> Column:
    """ST12: the way from one path to another: up out of what they don't share, then down."""
    a, b = F.split(source, "/"), F.split(target, "/")
    both = F.transform(F.sequence(F.lit(0), F.least(F.size(a), F.size(b)) - 1), lambda i: F.get(a, i) == F.get(b, i))
    shared = F.coalesce(F.array_position(both, F.lit(False)) - 1, F.lit(0))
    shared = F.when(F.array_contains(both, False), shared).otherwise(F.size(both)).cast("int")
    ups = F.array_repeat(F.lit(".."), F.size(a) - shared)
    return F.array_join(F.concat(ups, F.slice(b, shared + 1, F.greatest(F.size(b) - shared, F.lit(0)))), "/")


def glob_pattern(glob: str) -> str:
    """ST13: a shell pattern as a whole-text regex. '*' and '?' cross slashes; [..] classes and backslashes hold."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re_escape(glob[i]))
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1:end]
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]")
            i = end
        else:
            out.append(re_escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def glob_match(s: Column, glob: str) -> Column:
    return s.rlike(glob_pattern(glob))


def link_name(s: Column) -> Column:
    """ST15: a written reference as a dotted name: <doc:X> unwrapped, what follows a '-' and '@' gone, '/' as '.'."""
    s = F.regexp_replace(s, r"^<doc:(.*)>$", "$1")
    s = F.regexp_replace(s, r"(?<!^)-.+$", "")
    return F.replace(F.regexp_replace(s, r"^@", ""), F.lit("/"), F.lit("."))


def display_tail(name: Column) -> Column:
    """ST15: what is shown of a dotted name: its last part, arguments kept."""
    return F.regexp_extract(name, r"([^.(]*(?:\(.*)?)$", 1)


def objc_key(name: Column) -> Column:
    """ST16: '-[Class method:]' or '+[Class(Cat) m]' as 'Class.-method:' or 'Class.+m'; other names as they are."""
    p = r"^([+-])\s*\[(\w+)(?: ?\(\w+\))? ([\w:]+)\]$"
    return F.when(name.rlike(p), F.concat(F.regexp_extract(name, p, 2), F.lit("."), F.regexp_extract(name, p, 1), F.regexp_extract(name, p, 3))).otherwise(name)


def version_at_most(a: Column, b: Column) -> Column:
    """ST17: dotted versions compared by their numbers (1.9.0 is before 1.12.0), missing places as 0."""
    def key(v: Column) -> Column:
        parts = F.transform(F.split(v, r"\."), lambda x: F.coalesce(F.try_to_number(x, F.lit("999999")).cast("int"), F.lit(0)))
        return F.slice(F.concat(parts, F.array_repeat(F.lit(0), 4)), 1, 4)
    return key(a) <= key(b)


def category_name(s: Column) -> Column:
    """ST18: struct<class, category> of 'Class(Category)'; null if it isn't one."""
    p = r"^(\w+)\((\w*)\)$"
    return F.when(s.rlike(p), F.struct(F.regexp_extract(s, p, 1).alias("class"), F.regexp_extract(s, p, 2).alias("category")))


def mark_text(s: Column) -> Column:
    """ST18: the title of a source mark, without its dashes; null for other comments."""
    p = r"^\s*(?:///?\s*)?(?:#pragma mark|MARK:)\s*(?:-\s+|-$)?(.*?)(?:\s*-)?\s*$"
    return F.when(s.rlike(p), F.regexp_extract(s, p, 1))


def split_commas(s: str) -> list[str]:
    """ST19: a configuration list; '\\,' is a comma within an entry."""
    return [x.replace("\0", ",") for x in s.replace("\\,", "\0").split(",")]


def with_environment(s: str, env: dict[str, str]) -> str:
    """ST19: ${NAME} from the environment; unknown names stay."""
    return re.sub(r"\$\{(\w+)\}", lambda m: env.get(m[1], m[0]), s)


def pieces_flat(pieces: Column) -> Column:
    """ST14: array<struct<is_name,text>> as one text."""
    return F.array_join(F.transform(pieces, lambda p: p["text"]), "")


def pieces_wrapped(pieces: Column, before: str, after: str) -> Column:
    """ST14: the same with every name piece wrapped."""
    return F.array_join(F.transform(pieces, lambda p: F.when(p["is_name"], F.concat(F.lit(before), p["text"], F.lit(after))).otherwise(p["text"])), "")


def sortable_name(pieces: Column) -> Column:
    """OR7: the name pieces alone."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["is_name"]), lambda p: p["text"]), "")


def common_prefix(a: Column, b: Column) -> Column:
    """How many characters both begin with; 0 if either is null."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    n = F.least(F.char_length(a), F.char_length(b))
    first = F.array_position(same, F.lit(False))
    return F.when(a.isNull() | b.isNull(), 0).otherwise(F.when(first > 0, F.least(first - 1, n)).otherwise(n)).cast("int")
