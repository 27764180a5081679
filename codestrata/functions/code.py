"""Line-level detection of JavaScript and TypeScript definitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codestrata.functions.text import NON_SPACE, SPACE

# Definition patterns in the order they are tried, each with a text it cannot match
# without, and the names that are never functions.
FUNCTION_PATTERNS = (
    (r"function\s+(\w+)\s*\(", "function"),
    (r"(\w+)\s*:\s*function\s*\(", "function"),
    (r"(\w+)\s*=\s*function\s*\(", "function"),
    (r"(\w+)\s*=\s*\([^)]*\)\s*=>", "=>"),
    (r"(\w+)\s*\([^)]*\)\s*=>", "=>"),
)
CLASS_PATTERNS = (
    (r"class\s+(\w+)", "class"),
    (r"interface\s+(\w+)", "interface"),
    (r"type\s+(\w+)\s*=", "type"),
    (r"enum\s+(\w+)", "enum"),
)
NOT_FUNCTIONS = ("if", "for", "while", "switch", "catch")
TYPE_WORDS = ("interface", "type", "enum")


#: What ends an arrow function's pattern after its opening parenthesis.
_TO_ARROW = r"[^)]*\)\s*=>"
_WORD = r"[\p{L}\p{N}_]"


def _java(pattern: str) -> str:
    """Python's Unicode `\\w` and `\\s` spelled out for Java, without backtracking.

    What follows a repetition in these patterns never matches the repeated characters, so possessive
    repetition finds the same; and a match from inside a word has a longer one from the word's start
    before it, so starts inside words are not tried. A long word then costs linear time.
    """
    for greedy in (r"\w+", r"\s+", r"\s*"):
        pattern = pattern.replace(greedy, greedy + "+")
    start = f"(?<!{_WORD})" if pattern.startswith(r"(\w") else ""
    return start + pattern.replace(r"\w", _WORD).replace(r"\s", SPACE)


def is_code_line(line: Column) -> Column:
    """Not blank and not the first line of a comment."""
    # Blanks and a first character of ASCII other than a slash decide most lines without the long class of spaces.
    return line.rlike(f"\\A[ \\t]*+(?:[!-.0-~]|{SPACE}*(?!//|/\\*){NON_SPACE})")


def may_define(line: Column) -> Column:
    """A plain text test that every defining line passes, so that most lines meet no regex."""
    needed = dict.fromkeys(text for _, text in (*FUNCTION_PATTERNS, *CLASS_PATTERNS))
    test = F.lit(False)
    for text in needed:
        test = test | line.contains(text)
    return test


#: Bytes of a line up to which an arrow function's whole pattern is searched from every start.
_SHORT_LINE = 256


def _arrow_name(line: Column, head: str) -> Column:
    """Name of the leftmost `head`, up to its opening parenthesis, whose next closing one comes before an arrow.

    A long line is cut at its closing parentheses and each piece searched once, so a line of many openings costs
    linear time; the match cannot reach over a piece's end.
    """
    def first(pieces):
        names = F.transform(pieces, lambda piece, i: F.when(
            F.get(pieces, i + 1).rlike(f"\\A{SPACE}*+=>"), F.regexp_extract(piece, head, 1)))
        return F.get(F.filter(names, lambda name: name != ""), F.lit(0))

    whole = F.regexp_extract(line, head + rf"[^)]*+\){SPACE}*+=>", 1)
    return F.when(F.octet_length(line) <= _SHORT_LINE, whole).otherwise(F.transform(F.array(F.split(line, r"\)")), first)[0])


def _first_name(line: Column, patterns: tuple[tuple[str, str], ...], rejected: tuple[str, ...] = ()) -> Column:
    """Name from the first pattern that gives an allowed one. A plain text search goes before each regex."""
    tried = []
    for pattern, needed in patterns:
        arrow = pattern.endswith(_TO_ARROW)
        name = _arrow_name(line, _java(pattern.removesuffix(_TO_ARROW))) if arrow else F.regexp_extract(line, _java(pattern), 1)
        # Taking names out of an array of one, unlike a condition on it, matches the pattern once.
        allowed = F.array_except(F.array(name), F.array(*map(F.lit, ("", *rejected))))
        tried.append(F.when(line.contains(needed), F.get(allowed, F.lit(0))))
    return F.coalesce(*tried)


def function_name(line: Column) -> Column:
    """Name of the function the line defines, or null."""
    return _first_name(line, FUNCTION_PATTERNS, NOT_FUNCTIONS)


def class_name(line: Column) -> Column:
    """Name of the class-like entity the line defines, or null."""
    return _first_name(line, CLASS_PATTERNS)


def class_type(line: Column) -> Column:
    """Label of a class-like entity, by plain substring of the whole line."""
    label = F.lit("class")
    for word in reversed(TYPE_WORDS):
        label = F.when(line.contains(word), F.lit(word)).otherwise(label)
    return label
