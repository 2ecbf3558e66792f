"""Tokens, untokenised lines and clock times, as column expressions and as driver-side functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Each of these is a token of its own.
DELIMITERS = ".,!?:;(){}[]`|\"'"
_CLASS = r"""\.,!\?:;\(\)\{\}\[\]`\|"'"""
#: Unicode white space separates tokens.
_SPACES = r"\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
TOKEN_PATTERN = f"[{_CLASS}]|[^{_CLASS}{_SPACES}]+"
_PYTHON = re.compile(f"[{_CLASS}]|[^{_CLASS}" + re.sub(r"\\x\{(\w+)\}", lambda m: "\\u" + m[1].zfill(4), _SPACES) + "]+")


def tokenize(text: str) -> list[str]:
    """Tokens of a query text."""
    return _PYTHON.findall(text)


def tokenize_aligned(text: str) -> list[str]:
    """Tokens of a query text, which loses braces around the whole of it, as cues of aligned transcripts do."""
    return tokenize(text[1:-1] if len(text) > 1 and text[0] == "{" and text[-1] == "}" else text)


def unwrapped(text: Column) -> Column:
    """A whole cue in braces loses them (aligned transcripts)."""
    braces = (F.length(text) >= 2) & text.startswith("{") & text.endswith("}")
    return F.when(braces, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)


def tokens(text: Column, aligned: bool = True) -> Column:
    """Array of the tokens of a text; null has none."""
    body = unwrapped(text) if aligned else text
    # several times faster than to extract all that TOKEN_PATTERN matches, with the same tokens
    apart = F.regexp_replace(F.coalesce(body, F.lit("")), F.lit(f"[{_CLASS}]"), F.lit(" $0 "))
    return F.array_remove(F.split(apart, f"[{_SPACES}]+"), "")


def seconds(ms: Column) -> Column:
    """Milliseconds as 32-bit seconds. The added zero keeps the optimizer from skipping the step through 32 bits."""
    return ((ms.cast("float") + F.lit(0).cast("float")) / F.lit(1000.0)).cast("float")


def clock(t: Column, vtt: bool) -> Column:
    """HH:MM:SS,mmm (SRT) or HH:MM:SS.mmm (VTT) of seconds, rounded down in double precision."""
    t = t.cast("double")
    two = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    whole = lambda x: F.floor(x).cast("long")
    millis = F.lpad(F.pmod(whole(t * 1000), F.lit(1000)).cast("string"), 3, "0")
    parts = [two(whole(t / 3600)), F.lit(":"), two(F.pmod(whole(t / 60), F.lit(60))), F.lit(":"), two(F.pmod(whole(t), F.lit(60)))]
    return F.concat(*parts, F.lit("." if vtt else ","), millis)


def span_text(t: Column) -> Column:
    """'HHh MMm SS.mmms' of seconds, each part cut off."""
    t = t.cast("double")
    whole = t.cast("long")
    return F.format_string("%02dh %02dm %02d.%03ds", F.expr("0L") + (t / 3600).cast("long"), F.pmod((t / 60).cast("long"), F.lit(60)), F.pmod(whole, F.lit(60)), ((t - whole) * 1000).cast("long"))


#: Replacements, in order, that turn spaced tokens back into text; True marks a pattern.
_UNTOKENIZE = (
    (False, "`` ", '"'),
    (False, " ''", '"'),
    (False, ". . .", "..."),
    (False, " ( ", " ("),
    (False, " ) ", ") "),
    (True, " ([.,:;?!%>]+)([ '\"`])", "$1$2"),
    (True, " ([.,:;?!%>]+)$", "$1"),
    (False, " '", "'"),
    (False, " n't", "n't"),
    (False, "can not", "cannot"),
    (False, " ` ", " '"),
)


def untokenized(words: Column, unknown: str | None = None) -> Column:
    """An array of tokens as a line of text; nulls are left out, or shown as `unknown`."""
    text = F.array_join(words, " ", unknown)
    for pattern, old, new in _UNTOKENIZE:
        text = F.regexp_replace(text, F.lit(old), F.lit(new)) if pattern else F.replace(text, F.lit(old), F.lit(new))
    return F.trim(text)
