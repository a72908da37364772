"""Text expressions: pure functions from columns to columns, evaluated in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{Nl}\p{No}]+"
SENTENCE = r"[^.!?;\n\r]+[.!?;]?"
_BLANK_START, _BLANK_END = r"^[\s ]+", r"[\s ]+$"

#: Speakers whose turns are usually not analysed, by how their names begin.
MODERATORS = tuple(f"{x}dor" for x in ("modera", "media", "entrevista", "facilita", "pesquisa", "coordena", "apresenta")) + ("palestrante",)
#: A name of letters, dots, digits and blanks at the start of a line, a colon and white space on the same line.
_LABEL = r"(?mU)^[^\S\n]*([A-Za-z\u00c0-\u00ff][A-Za-z\u00c0-\u00ff.\d ]{0,38}?)[^\S\n]*:[^\S\n]"
_LINE_END = "\r\n|[\r\v\f\x1c-\x1e\x85\u2028\u2029]"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and letter-like numbers; decimal digits part tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def strip_blanks(text: Column) -> Column:
    """Without leading and trailing white space, no-break spaces too."""
    return F.regexp_replace(F.regexp_replace(text, _BLANK_START, ""), _BLANK_END, "")


def sentences(text: Column) -> Column:
    """Pieces up to and with one of ``. ! ? ;`` or up to a line end, stripped, none empty."""
    pieces = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(pieces, strip_blanks), lambda s: s != "")


def _accent_table() -> tuple[str, str]:
    source, target = [], []
    for code in range(0xC0, 0x250):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            source.append(chr(code))
            target.append(plain)
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _accent_table()


def strip_accents(text: Column) -> Column:
    """Latin letters without their accents; combining marks go."""
    return F.regexp_replace(F.translate(text, _ACCENTED, _PLAIN), r"\p{Mn}+", "")


def drop_bracketed(text: Column) -> Column:
    """Annotations of up to 60 characters on one line, from ( or [ to the next ) or ], become a space."""
    return F.regexp_replace(text, r"[(\[][^)\]\n]{0,60}[)\]]", " ")


def drop_markers(text: Column) -> Column:
    """Marks of inaudible speech and left-over speaker labels, numbered or not, become a space."""
    marked = F.regexp_replace(text, r"(?iU)\b(?:in(?:aud|compreens|inteleg)[ií]vel|ininteligível)\b", " ")
    return F.regexp_replace(marked, r"(?iU)\b(?:participante|palestrante|moderador|(?:entrevistador|mediador)a?)\s*\d*\b", " ")


def collapse_blanks(text: Column) -> Column:
    """Runs of two or more blanks and tabs become one space."""
    return F.regexp_replace(text, r"[ \t]{2,}", " ")


def clean_transcript(text: Column) -> Column:
    """All artefact removals in order."""
    return strip_blanks(collapse_blanks(drop_markers(drop_bracketed(text))))


def strip_markdown(text: Column) -> Column:
    """Plain text of Markdown: no code, images or marks; links keep their label."""
    for pattern, replacement in (
        (r"(?s)```.*?```", " "),
        (r"`[^`]*`", " "),
        (r"!\[[^\]]*\]\([^)]*\)", " "),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"(?m)^\s{0,3}(?:#{1,6}|>|[-*+]|\d+\.)\s+", ""),
        (r"[*_]{1,3}([^*_]+)[*_]{1,3}", "$1"),
    ):
        text = F.regexp_replace(text, pattern, replacement)
    return text


def normalise_blanks(text: Column) -> Column:
    """One space for every run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(text: Column) -> Column:
    """A name that is safe in a file system."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}_]+", "_")


def split_turns(text: Column) -> Column:
    """Array of (speaker, body), a turn each.

    A line that starts with a label and a colon begins a turn, which lasts until
    the next label; lines before any label are a turn of a null speaker.  One
    pass of a regular expression marks the labels, so the cost is linear.
    """
    lines = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[\x01\x02]", ""), _LINE_END, "\n"), r"\n\z", "")
    pieces = F.split(F.regexp_replace(lines, _LABEL, "\x01$1\x02"), "\x01")
    body = lambda p, last: F.when(last, p).otherwise(F.regexp_replace(p, r"\n\z", ""))
    turn = lambda speaker, p: F.struct(speaker.alias("speaker"), p.alias("body"))
    n = F.size(pieces)
    first = F.get(pieces, F.lit(0))
    head = F.when(first != "", F.array(turn(F.lit(None).cast("string"), body(first, n == 1)))).otherwise(F.array().cast("array<struct<speaker:string,body:string>>"))
    rest = F.transform(
        F.slice(pieces, F.lit(2), n),
        lambda p, i: turn(F.substring_index(p, "\x02", 1), body(F.regexp_replace(p, "^[^\x02]*\x02", ""), i == n - 2)),
    )
    return F.concat(head, rest)


def filter_turns(text: Column, drop: tuple[str, ...] = MODERATORS) -> tuple[Column, Column]:
    """(text without the turns of dropped speakers, number of dropped turns).

    ``drop`` holds case-insensitive regular expressions of how names begin.  A
    text without any label is left as it is, and so is all text if ``drop`` is empty.
    """
    if not drop:
        return text, F.lit(0)
    turns = split_turns(text)
    pattern = "(?iU)^\\s*(?:" + "|".join(drop) + ")"
    labelled = F.exists(turns, lambda t: t["speaker"].isNotNull())
    gone = lambda t: F.coalesce(t["speaker"].rlike(pattern), F.lit(False))
    joined = F.array_join(F.transform(F.filter(turns, lambda t: ~gone(t)), lambda t: t["body"]), "\n")
    return F.when(labelled, joined).otherwise(text), F.when(labelled, F.size(F.filter(turns, gone))).otherwise(0)
