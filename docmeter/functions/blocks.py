"""Blocks of lines cut out of source texts, a batch of rows at a time: a small helper for the tasks that parse programs.

Functions on the arrays of lines are interpreted by Spark for each line, and take more than twice as long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

#: What a pattern's white space stands for, and what of it a line can hold.
BLANKS, _BLANK = " \t\n\x0b\f\r", r"[ \t\x0b\f\r]"
_DIRECTIVE = re.compile(r"(?:>>SOURCE FORMAT|\$SET SOURCEFORMAT)[^\n\r\x85\u2028\u2029]*FREE")
_HEADER = re.compile(_BLANK + r"{0,5}(?:IDENTIFICATION|ID |PROGRAM-ID|DATA |PROCEDURE)")
_DIVISION = re.compile(rf"(?ai){_BLANK}*(IDENTIFICATION|ID|ENVIRONMENT|DATA|PROCEDURE){_BLANK}+DIVISION")
_WORD = re.compile("DIVISION", re.I)
#: A name on a line of its own; what ends a line elsewhere may stand behind it.
_UNIT = re.compile(rf"[{BLANKS}]*([A-Za-z0-9][A-Za-z0-9-]*)\.[{BLANKS}]*[\x85\u2028\u2029]?\Z")
_FIELD = re.compile(rf"[{BLANKS}]*([0-9]{{2}})[{BLANKS}]+([A-Z0-9-]+)")
COLUMNS = "start_line int, end_line int, content string"


def _free_format(lines: list[str]) -> bool:
    directive = "FREE" in "".join(lines[:20]).upper() and any(_DIRECTIVE.search(x.upper()) for x in lines[:20])
    return directive or any(not x.startswith("      ") and _HEADER.match(x.upper()) for x in lines[:50])


def _free(x: str) -> str:
    return "" if x.lstrip(" ").startswith((">>", "*")) else x.split("*>", 1)[0].rstrip(BLANKS)


def _fixed(x: str) -> str:
    body = x[6:] if len(x) > 7 else x
    return "" if x[6:7] in ("*", "/", "D", "d") or body.startswith("*") else body.rstrip(BLANKS)


def _cleaner(lines: list[str]):
    return _free if _free_format(lines) else _fixed


def clean(source: str) -> list[str]:
    """Lines without sequence areas, comments and directives; their number stays."""
    lines = source.split("\n")
    return list(map(_cleaner(lines), lines))


def _division(line: str) -> str | None:
    found = _DIVISION.match(line) if "DIVISION" in line.upper() else None
    return found and found[1].upper()


def _cut(lines: list[str], name, first: int, end: int) -> list[tuple[str, int, int]]:
    """``name, from, to`` (exclusive) of the blocks that begin at lines with a name."""
    heads = [(n, i) for i in range(first, end) if (n := name(lines[i]))]
    return [(n, i, j) for (n, i), (_, j) in zip(heads, heads[1:] + [("", end)])]


def _places(source: str) -> Iterator[int]:
    """Where the word DIVISION stands, in any case; other than ASCII letters may change their number with the case."""
    if not source.isascii():
        yield from (x.start() for x in _WORD.finditer(source))
        return
    text, at = source.upper(), -1
    while (at := text.find("DIVISION", at + 1)) >= 0:
        yield at


def _divisions(source: str, lines: list[str], cleaned) -> list[tuple[str, int, int]]:
    """``name, from, to`` (exclusive) of the divisions; only lines with the word are cleaned and looked at."""
    heads, line, at = [], 0, 0
    for place in _places(source):
        line, at = line + source.count("\n", at, place), place
        if (not heads or heads[-1][1] != line) and (name := _division(cleaned(lines[line]))):
            heads.append((name, line))
    return [(n, i, j) for (n, i), (_, j) in zip(heads, heads[1:] + [("", len(lines))])]


def _last(source: str, only: str | None) -> Iterator[tuple[str, int, list[str]]]:
    """Name, first line and clean lines of each division, or of one only; of divisions of one name the last counts."""
    raw = source.split("\n")
    cleaned = _cleaner(raw)
    for division, i, j in {n: (n, i, j) for n, i, j in _divisions(source, raw, cleaned) if only in (None, n)}.values():
        yield division, i, list(map(cleaned, raw[i:j]))


def cutter(only: str | None, inner=None):
    """A function for ``mapInArrow``: divisions of ``program, source``, or the blocks within them that ``inner`` names.

    Of divisions of one name the last counts; ``only`` leaves out all others, whose lines are not cleaned. A division's
    name precedes its blocks' names.
    """

    def rows(source: str) -> Iterator[tuple]:
        for division, i, lines in _last(source, only):
            for n, a, b in _cut(lines, inner, 0, len(lines)) if inner else [(division, 0, len(lines))]:
                yield division, n, i + a, i + b - 1, "\n".join(lines[a:b])

    return _batches(rows, {"division": pa.string(), "name": pa.string(), "start_line": pa.int32(), "end_line": pa.int32(), "content": pa.string()})


def unit_cutter(reserved: tuple[str, ...]):
    """A function for ``mapInArrow``: paragraphs of ``program, source`` for unit tests, as ``unit_paragraphs`` has them."""

    def head(line: str) -> str | None:
        found = _UNIT.match(line) if line[6:7] != "*" else None
        name = found and found[1].upper()
        return None if not name or name in reserved or "DIVISION" in name or "SECTION" in name else name

    def rows(source: str) -> Iterator[tuple]:
        lines = source.split("\n")
        start = next((i for i, x in enumerate(lines) if "PROCEDURE DIVISION" in x.upper()), len(lines))
        heads = [(n, i) for i in range(start + 1, len(lines)) if "." in lines[i] and (n := head(lines[i]))]
        ends = [i - 1 for _, i in heads[1:]] + [len(lines)]
        return [(n, i + 1, j, "\n".join(lines[i:j])) for (n, i), j in zip(heads, ends)]

    return _batches(rows, {"name": pa.string(), "line_start": pa.int32(), "line_end": pa.int32(), "body": pa.string()})


def field_cutter():
    """A function for ``mapInArrow``: upper-cased lines of the data division that begin with a level and a name, with both
    and the name of the nearest line above of a smaller level."""

    def rows(source: str) -> Iterator[tuple]:
        for _, i, lines in _last(source, "DATA"):
            above: list[tuple[int, str]] = []
            for at, line in enumerate(map(str.upper, lines), i):
                if found := _FIELD.match(line):
                    level, name = int(found[1]), found[2]
                    while above and above[-1][0] >= level:
                        above.pop()
                    yield at, line, level, name, above[-1][1] if above else None
                    above.append((level, name))

    return _batches(rows, {"line_no": pa.int32(), "line": pa.string(), "level": pa.int32(), "name": pa.string(), "parent": pa.string()})


#: A test on a variable, and an EVALUATE; what stands before a word is looked at after the word is found.
_TEST = re.compile(r"(?a)IF(?<![\w-]IF)\s+(?!NOT(?u:\b))([A-Z0-9-]+)(?:\s*(NOT\s*=|NOT\s+EQUAL|=|EQUAL(?:\s+TO)?|>|GREATER(?:\s+THAN)?|<|LESS(?:\s+THAN)?)\s*\S+)?")
_CASE, _CASE_END = re.compile(r"(?a)EVALUATE(?<![\w-]EVALUATE)\s+([A-Z0-9-]+)\s"), re.compile(r"\bEND-EVALUATE\b")
_NEXT = re.compile(r"(?a)\n\s*[A-Z0-9][A-Z0-9-]*\.\s*\n")


def test_cutter(most: int = 500):
    """A function for ``mapInArrow``: ``nth, variable, operator, block`` of the tests and then the EVALUATEs (without an
    operator) of upper-case sources.

    A test's block is what follows, ``most`` characters at most. An EVALUATE's reaches to its END-EVALUATE however far that is,
    without one to the next paragraph, and without that is cut as a test's.
    """

    def rows(source: str) -> Iterator[tuple]:
        nth = -1
        for nth, m in enumerate(_TEST.finditer(source)):
            yield nth, m[1], m[2] or "", source[m.end() : m.end() + most]
        for nth, m in enumerate(_CASE.finditer(source), nth + 1):
            end = _CASE_END.search(source, m.end()) or _NEXT.search(source, m.end())
            yield nth, m[1], None, source[m.end() : end.start() if end else m.end() + most]

    return _batches(rows, {"nth": pa.int32(), "variable": pa.string(), "operator": pa.string(), "block": pa.string()})


def computation_cutter(patterns: dict[str, tuple[str, int, int]]):
    """A function for ``mapInArrow``: ``variable, operation, expression`` of each match of an operation's pattern, of which the
    groups of the variable and the expression are known."""
    dot = r"[^\n\r\x85\u2028\u2029]"  # What a pattern's dot stands for elsewhere.
    made = [(op, re.match("[A-Z]+", p.removeprefix("(?s)"))[0], re.compile("(?a)" + (p if p.startswith("(?s)") else p.replace(".+?", dot + "+?"))), v, e) for op, (p, v, e) in patterns.items()]

    def rows(source: str) -> Iterator[tuple]:
        return ((m[v], op, m[e]) for op, word, p, v, e in made if word in source for m in p.finditer(source))

    return _batches(rows, {"variable": pa.string(), "operation": pa.string(), "expression": pa.string()})


def _batches(rows, columns: dict[str, pa.DataType]):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [(k, *row) for k, source in enumerate(part.column("source").to_pylist()) if source is not None for row in rows(source)]
            at, *values = zip(*found) if found else [()] * (1 + len(columns))
            arrays = [part.column("program").take(pa.array(at, pa.int32())), *[pa.array(v, t) for v, t in zip(values, columns.values())]]
            yield pa.RecordBatch.from_arrays(arrays, names=["program", *columns])

    return batches
