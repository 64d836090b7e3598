"""Source texts with their strings and comments blanked, so that patterns only see code.

Each language's strings and comments are one pattern of alternatives. Matches are found from left to right and do not overlap, so a quote
in a comment opens nothing and a comment sign in a string hides nothing. What is blanked keeps its length and its line feeds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK, _INSIDE = "\u0001", "\u0002"
_QUOTED = r'"(?:[^"\\]++|\\[\s\S])*+"'
_LINE = r"//[^\n]*+"


def _nested(depth: int) -> str:
    """A block comment with comments in it, ``depth`` deep at most; one that is not closed reaches to the end."""
    inside = r"/\*(?:[^*/]++|\*(?!/)|/(?!\*))*+\*/"
    for _ in range(depth):
        inside = rf"/\*(?:[^*/]++|\*(?!/)|/(?!\*)|{inside})*+\*/"
    return rf"{inside}|/\*[\s\S]*+\z"


HIDDEN = {
    "rust": "|".join((_LINE, _nested(6), r'\bb?r(#{0,16})"[\s\S]*?"\1', rf"b?{_QUOTED}", r"b?'(?:[^'\\\n]|\\u\{[0-9A-Fa-f_]*\}|\\[^\n]{1,3})'")),
    "python": "|".join((r"#[^\n]*+", r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""', r"'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''", r'"(?:[^"\\\n]++|\\[\s\S])*+"', r"'(?:[^'\\\n]++|\\[\s\S])*+'")),
    "typescript": "|".join((_LINE, r"/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)", r"`(?:[^`\\]++|\\[\s\S])*+`", r'"(?:[^"\\\n]++|\\[\s\S])*+"', r"'(?:[^'\\\n]++|\\[\s\S])*+'")),
}
HIDDEN["javascript"] = HIDDEN["typescript"]


def code_only(content: Column, language: str, keep_after: str | None = None) -> Column:
    """The text with all but line feeds of its strings and comments replaced by blanks. Null stays null; control characters U+0001 and U+0002 become blanks.

    Comments of Rust nest seven deep at most; a string that is not closed is no string. A template string of TypeScript is one string, whatever it embeds.
    keep_after: what code has to end with for the string behind it to stay.
    """
    clean = F.translate(content, _MARK + _INSIDE, "  ")
    parts = F.split(F.regexp_replace(clean, HIDDEN[language], f"{_MARK}{_INSIDE}$0{_MARK}"), _MARK, -1)
    blank = lambda p: F.when(p.startswith(_INSIDE), F.regexp_replace(F.substr(p, F.lit(2)), r"[^\n]", " ")).otherwise(p)
    if keep_after is None:
        return F.array_join(F.transform(parts, blank), "")
    string = lambda p: p.rlike(f"^{_INSIDE}[a-z]*[\"']")
    kept = lambda before, p: F.when(string(p) & before.rlike(rf"(?:{keep_after})\s*$"), F.substr(p, F.lit(2))).otherwise(blank(p))
    return F.array_join(F.zip_with(F.slice(F.concat(F.array(F.lit("")), parts), F.lit(1), F.size(parts)), parts, kept), "")
