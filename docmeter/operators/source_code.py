"""Source programs to rows: clean lines, divisions, sections, paragraphs, statements, fields, calls, jumps and rules.

A program is a row with ``program`` and ``source``. Divisions, sections, paragraphs and statements are cut inside the row,
without a shuffle; numbers and graphs are grouped by program, so no group is larger than one source file.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType
from pyspark.sql.window import Window

from docmeter.functions import blocks
from docmeter.functions.text import as_column, lines
from docmeter.operators.ranges import shuffled

# Words and patterns of the source language.
VERBS = (
    "MOVE", "ADD", "SUBTRACT", "MULTIPLY", "DIVIDE", "COMPUTE", "IF", "ELSE", "EVALUATE", "WHEN", "PERFORM", "GO", "GOTO",
    "CALL", "OPEN", "CLOSE", "READ", "WRITE", "REWRITE", "ACCEPT", "DISPLAY", "STOP", "EXIT", "CONTINUE",
    "SEARCH", "SET", "INITIALIZE", "INSPECT", "STRING", "UNSTRING",
)
RULE_PATTERNS = (
    ("complex_formula", r"COMPUTE\s+([A-Z0-9-]+)\s*=\s*(.+)", 0.95, "CRITICAL"),
    ("threshold_check", r"IF\s+([A-Z0-9-]+)\s*([<>=]+)\s*([0-9]+)", 0.95, "CRITICAL"),
    ("range_check", r"IF\s+([A-Z0-9-]+)\s+>=\s*([0-9]+)\s+AND\s+([A-Z0-9-]+)\s+<=\s*([0-9]+)", 0.95, "CRITICAL"),
    ("validation_rule", r"IF\s+([A-Z0-9-]+)\s+(NOT\s+)?=\s*['\"]?([A-Z0-9]+)['\"]?", 0.95, "IMPORTANT"),
    ("conditional_assignment", r"IF\s+(.+?)\s+MOVE\s+(.+?)\s+TO\s+([A-Z0-9-]+)", 0.80, "IMPORTANT"),
    ("status_check", r"IF\s+(FILE-STATUS|SQL-STATUS|RETURN-CODE|STATUS)", 0.90, "IMPORTANT"),
    ("accumulation", r"(ADD|COMPUTE)\s+(.+?)\s+TO\s+([A-Z0-9-]+)", 0.90, "TRIVIAL"),
    ("date_formatting", r"(COMPUTE|ADD|SUBTRACT)\s+.*(DATE|DAY|MONTH|YEAR|AGE)", 0.90, "IMPORTANT"),
)
EXCLUDED_RULES = (
    r"^MOVE\s+.*(DATE|DAY|MONTH|YEAR)\s+TO",
    r"^MOVE\s+SPACES\s+TO",
    r"^MOVE\s+ZEROS?\s+TO",
    r"^MOVE\s+LOW-VALUES\s+TO",
    r"^INITIALIZE\s+",
    r"^DISPLAY\s+",
    r"^ADD\s+\+?1\s+TO\s+.*-(CNT|COUNT|CTR)",
)
HANDLER_PATTERNS = (
    (r"ON\s+SIZE\s+ERROR", "size_error"),
    (r"NOT\s+ON\s+SIZE\s+ERROR", "size_error_success"),
    (r"INVALID\s+KEY", "invalid_key"),
    (r"NOT\s+INVALID\s+KEY", "valid_key"),
    (r"AT\s+END", "end_of_file"),
    (r"NOT\s+AT\s+END", "not_at_end"),
    (r"ON\s+EXCEPTION", "exception_handler"),
    (r"NOT\s+ON\s+EXCEPTION", "exception_success"),
    (r"ON\s+OVERFLOW", "overflow_handler"),
    (r"NOT\s+ON\s+OVERFLOW", "overflow_success"),
    (r"FILE-STATUS", "file_status_check"),
    (r"IF\s+.*-STATUS\s*(?:=|NOT)", "status_check"),
    (r"DISPLAY\s+[\"']?\*\*\s*ERROR", "error_display"),
    (r"DISPLAY\s+[\"']?ERROR[:\s]", "error_display"),
    (r"DISPLAY\s+[\"']?Bad\s+", "validation_error"),
    (r"DISPLAY\s+[\"']?Invalid\s+", "validation_error"),
    (r"WHEN\s+OTHER", "default_handler"),
    (r"GOBACK", "abnormal_termination"),
    (r"STOP\s+RUN", "program_termination"),
    (r"HANDLE\s+CONDITION", "cics_error_handler"),
    (r"HANDLE\s+ABEND", "cics_abend_handler"),
    (r"RESP\s*\(", "cics_response_check"),
)
INFRASTRUCTURE_NAMES = (r"^\d{4}-(OPEN|CLOSE|READ|WRITE|INIT|HOUSE)", r"^0000[-_]MAIN", r"^9999[-_]")
INFRASTRUCTURE_LINES = (
    r"^\s*(?:OPEN|CLOSE)\s+(?:INPUT|OUTPUT|I-O|EXTEND)\s+\w+",
    r"^\s*READ\s+[A-Z][A-Z0-9-]*\s*(?:INTO|AT\s+END|KEY)",
    r"^\s*WRITE\s+[A-Z][A-Z0-9-]*\s*(?:FROM|AFTER|BEFORE)",
    r"^\s*REWRITE\s+[A-Z][A-Z0-9-]*\s*(?:FROM|INVALID)",
)
EXTERNAL = (r"EXEC\s+(SQL|CICS)", r"CALL\s+")
LOGIC = (r"\b(COMPUTE|IF|EVALUATE|MULTIPLY|DIVIDE)\b",)
MIDDLEWARE = ("CICS", "DFH", "CEE", "DSN", "SQL", "MQ", "IMS", "DB2")
# End of fixed values.


def free_format(source: str | Column) -> Column:
    """A directive in the first 20 lines, or a header word with under six leading spaces in the first 50."""
    text = F.upper(as_column(source))
    return (F.contains(text, F.lit("FREE")) & text.rlike(_DIRECTIVE)) | text.rlike(_HEADER)


#: What a pattern's white space stands for, and what of it a line can hold.
_BLANKS, _BLANK = " \t\n\x0b\f\r", r"[ \t\x0B\f\r]"
_DIRECTIVE = r"\A(?:[^\n]*+\n){0,19}?[^\n]*?(?:>>SOURCE FORMAT|\$SET SOURCEFORMAT).*FREE"
_HEADER_WORD = rf"{_BLANK}{{0,5}}+(?:IDENTIFICATION|ID |PROGRAM-ID|DATA |PROCEDURE)"
_HEADER = rf"(?d)\A(?:(?!{_HEADER_WORD}).*\n){{0,49}}+{_HEADER_WORD}"
#: A line, of which the first group is kept: no blanks at its end, comments, directives and sequence areas. A pattern takes a
#: whole line at once; one of the noise alone would be tried at each of its characters.
_CODE = r"(.*[^ \t\x0B\f\r\n])?+"
_FREE_COMMENT, _FREE_LINE = r"(?dm)^ *+(?:>>|\*).*$|\*>.*$", rf"(?dm)^{_CODE}{_BLANK}*+$"
_FIXED_LINE = rf"(?dm)^(?:.{{6}}[*/Dd].*|\*.{{0,6}}|(?:.{{6}}(?=..))?+{_CODE}{_BLANK}*+)$"


def clean_text(source: str | Column) -> Column:
    """Text without sequence areas, comments and directives; the number of its lines stays.

    Patterns take the whole text: functions on each line are interpreted, and slower.
    """
    source = as_column(source)
    return F.when(free_format(source), F.regexp_replace(F.regexp_replace(source, _FREE_COMMENT, ""), _FREE_LINE, "$1")).otherwise(F.regexp_replace(source, _FIXED_LINE, "$1"))


def clean_lines(source: str | Column) -> Column:
    """Lines without sequence areas, comments and directives; their number stays."""
    return lines(clean_text(source))


_SECTION = rf"(?a){_BLANK}*([A-Za-z0-9-]+){_BLANK}+(?i:SECTION)\b"
_PARAGRAPH = rf"(?!(?i:{'|'.join(VERBS)}|END-))[A-Za-z][A-Za-z0-9-]*\.\Z"


def _section(line: str) -> str | None:
    found = re.match(_SECTION, line) if "SECTION" in line.upper() else None
    return found and found[1].upper()


def _paragraph(line: str) -> str | None:
    word = line.strip(_BLANKS) if line.endswith(".") else ""
    return word[:-1].upper() if word and " " not in word and re.match(_PARAGRAPH, word, re.A) else None


def _cut(programs: DataFrame, only: str | None = None, inner=None) -> DataFrame:
    return in_batches(programs, blocks.cutter(only, inner), f"division string, name string, {blocks.COLUMNS}")


def in_batches(programs: DataFrame, cut, columns: str) -> DataFrame:
    """Rows that ``cut`` makes of the sources, batch by batch, with their program."""
    kind = programs.schema["program"].dataType.simpleString()
    return programs.select("program", F.make_valid_utf8("source").alias("source")).mapInArrow(cut, f"program {kind}, {columns}")


def divisions(programs: DataFrame) -> DataFrame:
    """``program, name, start_line, end_line, content`` (lines from 0); of divisions of one name the last counts."""
    return _cut(programs).drop("division")


def sections(programs: DataFrame) -> DataFrame:
    """Blocks under ``NAME SECTION`` within each division."""
    return _cut(programs, None, _section)


def paragraphs(programs: DataFrame) -> DataFrame:
    """Blocks of the procedure division under ``NAME.`` lines whose name doesn't begin like a verb or with ``END-``."""
    return _cut(programs, "PROCEDURE", _paragraph).drop("division")


_PIECE = rf"[^.{_BLANKS}](?:[^.]*[^.{_BLANKS}])?"


def statements(paragraphs_: DataFrame) -> DataFrame:
    """Pieces between full stops: ``program, paragraph, statement_no, statement, line_no``."""
    parts = F.regexp_extract_all("content", F.lit(_PIECE), 0)
    return paragraphs_.select("program", F.col("name").alias("paragraph"), "start_line", F.posexplode(parts).alias("statement_no", "statement")).withColumn("line_no", F.col("start_line") + F.col("statement_no")).drop("start_line")


def program_id(source: str | Column) -> Column:
    return F.translate(F.regexp_extract(as_column(source), r"(?i)PROGRAM-ID\.?\s+([A-Za-z0-9_-]+)", 1), "-", "_")


def targets(statement: str | Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(as_column(statement), F.lit(pattern), 1), lambda x: F.upper(x))


_PERFORM, _GOTO = r"(?i)\bPERFORM\s+([A-Za-z0-9-]+)(?:\s+THROUGH\s+([A-Za-z0-9-]+))?", r"(?i)\bGO\s+TO\s+([A-Za-z0-9-]+)"


def flow_edges(statements_: DataFrame) -> DataFrame:
    """``program, src, dst, type, line_no`` of PERFORM and GO TO; a range's edge goes to its first paragraph."""
    return ranged_edges(statements_).withColumn("type", F.when(F.col("type") == "goto", "goto").otherwise("perform")).drop("through")


def ranged_edges(statements_: DataFrame) -> DataFrame:
    """Edges as ``flow_edges`` has them, with ``through`` (null but for ranges) and the type perform_through for ranges."""
    rows = statements_.filter(any_in(F.upper("statement"), "PERFORM", "GO") & F.col("statement").rlike(_LEADS)).select("program", F.col("paragraph").alias("src"), F.explode(leads("statement")).alias("e"), "line_no")
    return rows.select("program", "src", "e.dst", "e.type", "line_no", "e.through")


def any_in(text: Column, *cores: str) -> Column:
    """Whether a text holds one of the words, which is far cheaper to see than whether it matches a pattern."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in cores])


#: What follows PERFORM in a loop.
_LOOPS = ("UNTIL", "VARYING", "TIMES", "WITH", "TEST")
_LEADS = r"(?i)\b(?:PERFORM\s|GO\s+TO\s)"


def leads(statement: str | Column) -> Column:
    """``dst, type, through`` of each PERFORM and GO TO of a statement, but words that begin a loop."""
    group = lambda i: F.regexp_extract_all(as_column(statement), F.lit(_PERFORM), i)
    lead = lambda dst, type_, through: F.struct(dst.alias("dst"), type_.alias("type"), through.alias("through"))
    performs = F.transform(F.arrays_zip(group(1).alias("d"), group(2).alias("t")), lambda e: lead(F.upper(e["d"]), F.when(e["t"] == "", "perform").otherwise("perform_through"), F.upper(F.nullif(e["t"], F.lit("")))))
    jumps = F.transform(targets(statement, _GOTO), lambda x: lead(x, F.lit("goto"), F.lit(None).cast("string")))
    return F.filter(F.concat(performs, jumps), lambda e: ~e["dst"].isin(*_LOOPS))


def expanded_edges(edges: DataFrame, paragraphs_: DataFrame) -> DataFrame:
    """Edges with one for each paragraph of a range, first to last in the order of the source.

    Each program's paragraphs are listed in order, and a range is a slice of the list. A range with an unknown end, or that
    ends before it begins, stays an edge to its first paragraph. Of paragraphs of one name the first counts as an end.
    """
    names = F.transform(F.array_sort(F.collect_list(F.struct("start_line", "name"))), lambda x: x["name"]).alias("names")
    rows = edges.join(shuffled(paragraphs_.groupBy("program").agg(names)), "program", "left")
    lo, hi = F.array_position("names", F.col("dst")), F.array_position("names", F.col("through"))
    members = F.when((lo > 0) & (lo <= hi), F.slice("names", lo.cast("int"), (hi - lo + 1).cast("int"))).otherwise(F.array("dst"))
    return rows.select("program", "src", F.explode(members).alias("dst"), "type", "line_no")


def flow_graph(edges: DataFrame, paragraphs_: DataFrame) -> DataFrame:
    """Successors of each paragraph over edges whose ends are both known."""
    known = paragraphs_.select("program", F.col("name")).distinct()
    edges = edges.join(shuffled(known.withColumnRenamed("name", "src")), ["program", "src"], "left_semi").join(shuffled(known.withColumnRenamed("name", "dst")), ["program", "dst"], "left_semi")
    return edges.groupBy("program", "src").agg(F.array_sort(F.collect_set("dst")).alias("successors"))


def jump_stats(edges: DataFrame, paragraphs_: DataFrame, statements_: DataFrame) -> DataFrame:
    """Jumps by program: number, forward ones, share of statements, and whether that is over 15 %."""
    at = paragraphs_.groupBy("program", "name").agg(F.min("start_line").alias("at"))
    ends = edges.filter("type = 'goto'").join(shuffled(at.toDF("program", "src", "src_at")), ["program", "src"], "left").join(shuffled(at.toDF("program", "dst", "dst_at")), ["program", "dst"], "left")
    jumps = ends.groupBy("program").agg(F.count("*").alias("gotos"), F.count_if(F.col("dst_at") > F.col("src_at")).alias("forward"))
    total = statements_.groupBy("program").agg(F.count("*").alias("statements"))
    return _density(total.join(shuffled(jumps), "program", "left").fillna(0, ["gotos", "forward"]))


def paragraph_jumps(paragraphs_: DataFrame) -> DataFrame:
    """``jump_stats`` of all jumps that paragraphs hold: each paragraph is read once, and programs gather their jumps in one row."""
    jumps = F.when(F.contains(F.upper("content"), F.lit("GO")), F.filter(targets("content", _GOTO), lambda x: ~x.isin(*_LOOPS))).otherwise(F.array().cast("array<string>"))
    rows = paragraphs_.select("program", "start_line", "name", F.size(F.regexp_extract_all("content", F.lit(_PIECE), 0)).alias("n"), jumps.alias("jumps"))
    places = F.array_sort(F.collect_list(F.struct("start_line", "name")))
    ends = F.flatten(F.collect_list(F.transform("jumps", lambda x: F.struct(F.col("name").alias("src"), x.alias("dst")))))
    out = rows.groupBy("program").agg(F.sum("n").alias("statements"), places.alias("places"), ends.alias("ends")).filter("statements > 0")
    out = out.select("program", "statements", "ends", F.transform("places", lambda x: x["name"]).alias("names"), F.transform("places", lambda x: x["start_line"]).alias("starts"))
    at = lambda name: F.get("starts", F.array_position("names", name).cast("int") - 1)
    forward = F.size(F.filter("ends", lambda e: at(e["dst"]) > at(e["src"]))).cast("long")
    return _density(out.select("program", "statements", F.size("ends").cast("long").alias("gotos"), forward.alias("forward")))


def _density(counts: DataFrame) -> DataFrame:
    return counts.withColumn("density", F.col("gotos") / F.col("statements")).withColumn("spaghetti", F.col("density") > 0.15)


def reached(pairs: list[tuple[str, str]], depth: int) -> set[tuple[str, str]]:
    """Pairs of a name and another that is at most ``depth`` steps from it."""
    steps, out = defaultdict(set), set(pairs)
    for src, dst in out:
        steps[src].add(dst)
    last = out
    for _ in range(depth - 1):
        last = {(src, far) for src, dst in last for far in steps.get(dst, ())} - out
        out = out | last
    return out


@F.pandas_udf(ArrayType(StructType().add("src", StringType()).add("dst", StringType())))
def _closed(src: pd.Series, dst: pd.Series, depth: pd.Series) -> pd.Series:
    return pd.Series([[{"src": a, "dst": b} for a, b in reached(list(zip(x, y, strict=True)), n)] for x, y, n in zip(src, dst, depth, strict=True)], dtype=object)


def perform_closure(edges: DataFrame, depth: int = 2) -> DataFrame:
    """Paragraphs that each paragraph performs within ``depth`` steps, followed within the program's row."""
    steps = edges.filter("type in ('perform', 'perform_through')").groupBy("program").agg(F.collect_set(F.struct("src", "dst")).alias("steps"))
    return steps.select("program", F.inline(_closed("steps.src", "steps.dst", F.lit(depth))))


#: A statement without any of them matches none of the patterns of rules.
_RULE_CORES = ("COMPUTE", "IF", "ADD", "SUBTRACT")


def business_rules(statements_: DataFrame) -> DataFrame:
    """The first pattern that a statement matches, unless it is boilerplate; numbered in paragraph order."""
    # Each step is made an array and spread again: as plain columns they would be computed for every use that a filter makes of them.
    text = F.regexp_replace(F.upper("statement"), r"\s+", " ")
    rows = statements_.filter(any_in(F.upper("statement"), *_RULE_CORES)).select("*", F.explode(F.array(text)).alias("text"))
    kind = lambda name, confidence, priority: F.array(F.struct(F.lit(name).alias("rule_type"), F.lit(confidence).alias("confidence"), F.lit(priority).alias("priority")))
    rule = F.array().cast("array<struct<rule_type:string,confidence:double,priority:string>>")
    for name, pattern, confidence, priority in reversed(RULE_PATTERNS):
        rule = F.when(F.col("text").rlike(pattern), kind(name, confidence, priority)).otherwise(rule)
    excluded = F.col("text").rlike("|".join(f"(?:{p})" for p in EXCLUDED_RULES))
    rows = rows.select("*", F.explode(F.filter(rule, lambda _: ~excluded)).alias("rule"))
    number = F.row_number().over(Window.partitionBy("program").orderBy("line_no", "statement_no"))
    return rows.select("program", F.format_string("BR-%03d", number).alias("rule_id"), "paragraph", "line_no", "rule.*", "statement", rule_keywords(F.col("text")).alias("keywords"))


def rule_keywords(text: Column, most: int = 10) -> Column:
    """Distinct names of four characters or more that are no verbs, the longest first, then by name."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r"([A-Z][A-Z0-9-]{3,})"), 1), lambda w: ~w.isin(*VERBS) & ~w.startswith("END-")))
    order = F.array_sort(F.transform(found, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.slice(F.transform(order, lambda x: x["w"]), 1, most)


def _core(pattern: str) -> str:
    """The longest word, in upper case, that all matches of a handler's pattern hold."""
    plain = re.sub(r"\[[^\]]*\][?*+]?|\(\?:[^)]*\)|\\.[+*]?|[.^]\*?", " ", pattern)
    return max(plain.upper().split(), key=len)


def error_handlers(statements_: DataFrame) -> DataFrame:
    """A row for every pattern that a statement matches."""
    hits = F.array(*[F.when(F.contains("up", F.lit(_core(p))) & F.col("statement").rlike(f"(?i){p}"), F.lit(t)) for p, t in HANDLER_PATTERNS])
    return statements_.withColumn("up", F.upper("statement")).select("program", "paragraph", "line_no", F.explode(F.filter(hits, lambda t: t.isNotNull())).alias("type"))


_CALL = r"\bCALL\s+(['\"]?)([A-Z0-9-]+)['\"]?(?:(?!\bCALL\s)[\s\S])*?(?:\bUSING\s+((?:(?!\bCALL\s)[\s\S])+))?(?=\bCALL\s|\z)"


def calls(statements_: DataFrame) -> DataFrame:
    """``callee, is_dynamic`` (no literal), ``parameters`` of each CALL; a statement may have several."""
    part = lambda i: F.regexp_extract_all(F.upper("statement"), F.lit(_CALL), i)
    each = F.arrays_zip(part(1).alias("quote"), part(2).alias("callee"), part(3).alias("using"))
    rows = statements_.filter(F.contains(F.upper("statement"), F.lit("CALL"))).select("program", "paragraph", "line_no", F.explode(each).alias("c"))
    words_ = F.filter(F.split("c.using", r"[\s,]+"), lambda w: (w != "") & ~w.isin("BY", "REFERENCE", "CONTENT", "VALUE"))
    return rows.select("program", "paragraph", "line_no", "c.callee", (F.col("c.quote") == "").alias("is_dynamic"), words_.alias("parameters"))


def call_class(callee: Column, is_dynamic: Column, known: Column) -> Column:
    middleware = callee.rlike(f"^(?:{'|'.join(MIDDLEWARE)})")
    return F.when(is_dynamic, "unverifiable").when(middleware, "middleware").when(known, "in_scope").otherwise("external")


def paragraph_class(name: str | Column, content: str | Column) -> Column:
    """INFRASTRUCTURE by name, then by its lines; else MIXED, PURE or INFRASTRUCTURE by calls and logic."""
    any_of = lambda c, patterns, flags: reduce(lambda a, b: a | b, [c.rlike(flags + p) for p in patterns])
    content = as_column(content)
    external, logic = any_of(content, EXTERNAL, "(?i)"), any_of(content, LOGIC, "(?i)")
    infrastructure = any_of(as_column(name), INFRASTRUCTURE_NAMES, "(?i)") | any_of(content, INFRASTRUCTURE_LINES, "(?im)")
    return F.when(infrastructure, "INFRASTRUCTURE").when(external & logic, "MIXED").when(logic, "PURE").otherwise("INFRASTRUCTURE")


_EXTERNAL_BLOCK = r"(?is)EXEC\s+(?:SQL|CICS|DLI).*?END-EXEC\.?"


def code_blocks(paragraphs_: DataFrame) -> DataFrame:
    """``program, name, nth, type, start_offset, end_offset, content`` of the runs of a mixed paragraph.

    External blocks reach from EXEC to END-EXEC; what stands between them is a logic block if it holds logic, and left out
    otherwise. Blocks are cut inside the paragraph's row; offsets (from 0, end exclusive) are those before white space is
    stripped from logic blocks.
    """
    between, external = F.split("content", _EXTERNAL_BLOCK), F.regexp_extract_all("content", F.lit(_EXTERNAL_BLOCK), 0)
    logic = lambda x: F.lit(False) if x is None else reduce(lambda a, b: a | b, [x.rlike("(?i)" + p) for p in LOGIC])
    both = F.arrays_zip(between.alias("b"), external.alias("e"))
    block = lambda kind, at, text, content: F.struct(F.lit(kind).alias("type"), at.alias("start_offset"), (at + F.length(text)).alias("end_offset"), content.alias("content"))
    empty = F.array().cast("array<struct<type:string,start_offset:int,end_offset:int,content:string>>")

    def step(s: Column, p: Column) -> Column:
        own = F.array(block("logic", s["at"], p["b"], F.regexp_replace(p["b"], r"\A\s+|\s+\z", "")))
        after = s["at"] + F.length(p["b"])
        out = F.when(logic(p["b"]), F.concat(s["out"], own)).otherwise(s["out"])
        out = F.when(p["e"].isNotNull(), F.concat(out, F.array(block("external", after, p["e"], F.regexp_replace(p["e"], r"\A\s+|\s+\z", ""))))).otherwise(out)
        return F.struct((after + F.coalesce(F.length(p["e"]), F.lit(0))).alias("at"), out.alias("out"))

    blocks = F.aggregate(both, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"])
    return paragraphs_.select("program", "name", F.posexplode(blocks).alias("nth", "b")).select("program", "name", "nth", "b.*")


def picture_digits(picture: str | Column) -> Column:
    """Positions of a picture: letters count once, or as often as their bracket says."""
    found = F.regexp_extract_all(F.upper(as_column(picture)), F.lit(r"([X9AZ])(?:\((\d+)\))?"), 2)
    return F.aggregate(found, F.lit(0), lambda n, x: n + F.when(x == "", 1).otherwise(x.cast("int")))


def picture_bytes(picture: str | Column, usage: str | Column) -> Column:
    digits, usage = picture_digits(picture), F.upper(F.coalesce(as_column(usage), F.lit("DISPLAY")))
    binary = F.when(digits <= 4, 2).when(digits <= 9, 4).otherwise(8)
    return F.when(usage.isin("COMP-3", "PACKED-DECIMAL"), F.floor(digits / 2).cast("int") + 1).when(usage.isin("COMP", "BINARY"), binary).otherwise(digits)


def data_fields(programs: DataFrame) -> DataFrame:
    """Fields of the data division with level, picture, occurs, redefines, value, and the nearest field above of a smaller level."""
    rows = in_batches(programs, blocks.field_cutter(), "line_no int, line string, level int, name string, parent string")
    part = lambda word, p: F.when(F.contains("line", F.lit(word)), F.nullif(F.regexp_extract("line", p, 1), F.lit("")))
    found = {
        "picture": part("PIC", r"\bPIC(?:TURE)?\s+(?:IS\s+)?([^\s]+?)\.?(?:\s|$)"), "occurs": part("OCCURS", r"\bOCCURS\s+(\d+)").cast("int"), "redefines": part("REDEFINES", r"\bREDEFINES\s+([A-Z0-9-]+)"),
        "usage": F.nullif(F.regexp_extract("line", r"\b(COMP-3|COMP|BINARY|PACKED-DECIMAL)\b", 1), F.lit("")), "value": part("VALUE", r"\bVALUES?\s+(?:IS\s+)?(.+?)\.?\s*$"),
    }
    return rows.select("program", "line_no", "level", "name", *[c.alias(k) for k, c in found.items()], "parent").withColumn("bytes", picture_bytes("picture", "usage"))


def structures(fields: DataFrame) -> DataFrame:
    """``program, name, line_no, fields, conditions, has_redefines`` of each group of level 1 with all that stands below it.

    Fields (its own among them) and condition names (level 88) are counted; what stands before the first group of its program
    is in none.
    """
    start = F.max(F.when(F.col("level") == 1, F.col("line_no"))).over(Window.partitionBy("program").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    rows = fields.withColumn("start", start).filter("start is not null").groupBy("program", "start")
    out = rows.agg(F.min_by("name", "line_no").alias("name"), F.count("*").alias("fields"), F.count_if(F.col("level") == 88).alias("conditions"), F.bool_or(F.col("redefines").isNotNull()).alias("has_redefines"))
    return out.select("program", "name", F.col("start").alias("line_no"), "fields", "conditions", "has_redefines")


def condition_names(fields: DataFrame) -> DataFrame:
    """``program, name, parent, value, line_no`` of names for values of a field."""
    return fields.filter("level = 88").select("program", "name", "parent", "value", "line_no")


def redefinitions(fields: DataFrame) -> DataFrame:
    return fields.filter("redefines is not null").select("program", "name", "redefines", "line_no")


def repetitions(fields: DataFrame) -> DataFrame:
    return fields.filter("occurs is not null").select("program", "name", "occurs", "line_no")


def copy_names(source: str | Column) -> Column:
    kept = F.filter(clean_lines(source), lambda x: x != "")
    return F.array_distinct(F.transform(F.regexp_extract_all(F.array_join(kept, "\n"), F.lit(r"(?i)\bCOPY\s+['\"]?([A-Za-z0-9_-]+)"), 1), lambda x: F.upper(x)))


def copy_closure(roots: DataFrame, uses: DataFrame, depth: int = 5) -> DataFrame:
    """Books that each root reaches over ``uses`` (src, dst) in at most ``depth`` steps; cycles add nothing."""
    uses = uses.distinct().toDF("name", "next")
    reached = [roots.select("root", F.col("name")).distinct()]
    for _ in range(depth):
        reached.append(reached[-1].join(shuffled(uses), "name").select("root", F.col("next").alias("name")).distinct())
    return reduce(DataFrame.unionByName, reached).distinct()
