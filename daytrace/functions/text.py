"""Scalar text functions as column expressions. Patterns are Unicode-aware where the rules speak of words or spaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)\s+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of spaces become one space; the ends are stripped."""
    return strip(F.regexp_replace(c, SPACES, " "))


def normalize_title(c: Column) -> Column:
    """lower case, punctuation to spaces, spaces collapsed."""
    return collapse(F.regexp_replace(F.lower(strip(c)), r"(?U)[^\w\s]+", " "))


def normalize_text(c: Column) -> Column:
    """spaces collapsed, lower case."""
    return F.lower(collapse(c))


def word_set(c: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)(\w+)"), 1))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two distinct arrays; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value as a lambda's argument: it is made once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_of_each(values: Column, key=F.lower) -> Column:
    """Members whose key did not occur before, in order."""
    return bound(values, lambda every: F.filter(every, lambda v, i: F.array_position(F.transform(every, lambda x: key(x)), key(v)) == i + 1))


def extract_all(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), group)


# without the flag U, \w is ASCII, but \b still is not
_ASCII_EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"


def ascii_only(pattern: str) -> str:
    """The same pattern where only ASCII has words, spaces and digits, as in RE2; letters still match whatever their case in Unicode."""
    return pattern.replace("(?iU)", "(?iu)").replace("(?U)", "").replace(r"\b", _ASCII_EDGE).replace(r"\s", r"[\t\n\f\r ]")


# The patterns in tickets, windows_paths, file_tokens, repositories, branches and task_labels are fixed values.


def tickets(c: Column, rule=str) -> Column:
    """issue keys such as ABC-12 in upper case, each once; ``rule`` may be ``ascii_only``, here and below."""
    return F.array_distinct(F.transform(extract_all(c, rule(r"(?iU)\b([A-Z][A-Z0-9]+-\d+)\b")), lambda t: F.upper(t)))


def trim_path(c: Column) -> Column:
    """without quotes, brackets and separators around, a trailing edit marker and trailing slashes."""
    bare = F.regexp_replace(strip(c), r"""^["'\[\](){}<>,;]+|["'\[\](){}<>,;]+$""", "")
    return F.regexp_replace(strip(F.regexp_replace(bare, r"\s*\*\s*$", "")), r"(?U)[\\/\s]*[\\/]\s*$", "")


def is_windows_path(c: Column) -> Column:
    return (F.length(c) >= 3) & c.rlike(r"^(?:\\\\|//|.:[\\/])")


def normalize_path(c: Column) -> Column:
    """Lower case with forward slashes; repeated separators collapse, but for the two in front of a share."""
    slashed = F.regexp_replace(trim_path(c), r"\\", "/")
    return F.lower(F.regexp_replace(slashed, r"(?<!^)/+", "/"))


def windows_paths(c: Column) -> Column:
    """drive and share paths in a text, trimmed, each once by normalized form."""
    name = r"""[^\\/:*?"<>|\r\n]+"""
    pattern = rf"(?U)(?<!\w)((?:[A-Za-z]:[\\/](?:{name}[\\/])*{name})|(?:(?:\\\\|//)(?:{name}[\\/])+{name}))"
    found = F.filter(F.transform(extract_all(c, pattern), trim_path), lambda p: (p != "") & is_windows_path(p))
    return first_of_each(found, normalize_path)


def path_name(c: Column) -> Column:
    """Last part of a path."""
    return F.regexp_extract(c, r"([^\\/]*)$", 1)


def is_file_path(c: Column) -> Column:
    """The last part has a suffix: a dot that neither starts nor ends it."""
    return path_name(c).rlike(r"^[^.].*\.[^.]+$|^\.+[^.].*\.[^.]+$")


# fixed values: folders of systems and of builds, two lists that are always asked together
PLAIN_FOLDERS = [
    "appdata", "desktop", "documents", "downloads", "home", "local", "program files", "program files (x86)", "projects",
    "source", "src", "temp", "tmp", "users", "workspace", "bin", "build", "dist", "obj", "debug", "release",
]


def project_of_path(c: Column) -> Column:
    """First folder with a name of its own; of none, the first part; null without parts. A share's host and name are its root."""
    rest = F.regexp_replace(F.regexp_replace(c, r"^(?:\\\\|//)[^\\/]+[\\/][^\\/]+[\\/]?", ""), r"^[A-Za-z]:[\\/]?", "")
    parts = F.filter(F.split(rest, r"[\\/]+"), lambda p: p != "")
    folders = F.when(is_file_path(c), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    own = F.filter(folders, lambda p: (strip(p) != "") & ~F.lower(strip(p)).isin(PLAIN_FOLDERS))
    return F.nullif(strip(F.coalesce(F.get(own, F.lit(0)), F.get(parts, F.lit(0)))), F.lit(""))


def file_tokens(c: Column) -> Column:
    """F8: names with a suffix that stand alone, each once."""
    found = F.transform(extract_all(c, r"(?U)(?<![\w/\\])([A-Za-z0-9][A-Za-z0-9._-]{0,127}\.[A-Za-z0-9]{1,10})(?![\w/\\])"), trim_path)
    return first_of_each(F.filter(found, lambda t: (t != "") & ~t.endswith(".") & ~is_windows_path(t)))


def repositories(c: Column, rule=str) -> Column:
    """owner/name pairs, the owner without dots."""
    found = extract_all(c, rule(r"(?U)\b([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)\b"))
    return first_of_each(F.filter(found, lambda r: ~F.split(r, "/")[0].contains(".")))


def branches(c: Column, rule=str) -> Column:
    """names after "branch", between "on" and "branch", and behind refs/heads."""
    name = r"([A-Za-z0-9._/\-]+)"
    return first_of_each(F.concat(*[extract_all(c, rule(p)) for p in (rf"(?iU)\bbranch[:\s]+{name}\b", rf"(?iU)\bon\s+{name}\s+branch\b", rf"(?iU)\brefs/heads/{name}\b")]))


def task_labels(c: Column, rule=str) -> Column:
    """what follows task, case, job, ... or "analysis for", "work on", "follow up on"."""
    both = F.concat(
        extract_all(c, rule(r"(?iU)\b(?:task|case|job|run|build|ticket|issue|story)[:\s#-]+([A-Za-z0-9._/-]{2,})\b")),
        extract_all(c, rule(r"(?iU)\b(?:analysis for|work on|follow up on)\s+([A-Z0-9][A-Z0-9._-]{1,})\b")),
    )
    return first_of_each(F.filter(F.transform(both, lambda t: F.regexp_replace(strip(t), r"^[-_ ]+|[-_ ]+$", "")), lambda t: t != ""))


# fixed values
BROWSERS, MAIL, TALK = ["chrome", "msedge", "edge", "chromium"], ["outlook"], ["teams", "slack", "zoom", "webex", "meet"]
BROWSER_SUFFIXES = r" - Google Chrome| - Chromium| - Microsoft Edge| - Edge"
MAIL_SUFFIXES = r" - Outlook| \| Outlook| - Microsoft Outlook| - Message| - Message \(HTML\)"
TALK_SUFFIXES = r" - Microsoft Teams| \| Microsoft Teams| - Teams| - Slack| \| Slack| - Zoom| \| Zoom| - Webex| \| Webex| - Google Meet| \| Google Meet"


def names_any(process: Column, title: Column, names: list[str]) -> Column:
    """either holds one of the names."""
    return F.lower(process).rlike("|".join(names)) | F.lower(title).rlike("|".join(names))


def strip_browser(c: Column) -> Column:
    """one browser suffix."""
    return strip(F.regexp_replace(c, rf"(?:{BROWSER_SUFFIXES})$", ""))


def strip_mail(c: Column) -> Column:
    """all mail suffixes, repeatedly."""
    return strip(F.regexp_replace(strip(c), rf"(?U)(?:(?:{MAIL_SUFFIXES})\s*)+$", ""))


def strip_talk(c: Column) -> Column:
    """one conversation suffix."""
    return strip(F.regexp_replace(strip(c), rf"(?:{TALK_SUFFIXES})$", ""))


def has_edit_marker(c: Column) -> Column:
    return c.rlike(r"\s*\*\s*$")


def has_transition(c: Column, words) -> Column:
    """any of the words, also inside other words."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w.lower())
    return out


def canonical_text(day: Column, process: Column, title: Column, text: Column, start_ts: Column, end_ts: Column) -> Column:
    """what an embedding is computed of; its sha2(_, 256) is the cache key."""
    hour = lambda ts: F.date_format(F.timestamp_seconds(ts), "HH:mm")
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(collapse(c), F.lit("")))
    return F.concat_ws("\n", line("day", day), line("time", F.concat_ws("-", hour(start_ts), hour(end_ts))), line("app", process), line("window", title), line("summary", text))


def highlight(c: Column, query: str) -> Column:
    """escaped for HTML, matches of the query (any case) marked."""
    import html
    import re

    safe = F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    wanted = re.escape(html.escape(query.strip()))
    return F.regexp_replace(safe, f"(?iu)({wanted})", "<mark>$1</mark>") if wanted else safe


def entity_query(c: Column) -> Column:
    """A search text in the form of normalized entities."""
    return F.lower(collapse(F.replace(c, F.lit("\\"), F.lit("/"))))
