import pytest

from docmeter.operators import source_code as sc
from docmeter.operators.board import leaderboard
from docmeter.sources import results as rs
from docmeter.streaming.board import running_board, write_to_memory

FIXED = """000100 IDENTIFICATION DIVISION.
000200 PROGRAM-ID. PAY-ROLL.
000300* A note about pay.
000400 DATA DIVISION.
000500 WORKING-STORAGE SECTION.
000600 01  WS-PAY.
000700     05  WS-GROSS      PIC 9(5)V99 COMP-3.
000800     05  WS-RATES OCCURS 3.
000900         10  WS-RATE   PIC 9(4) COMP.
001000     05  WS-NAME       PIC X(20) VALUE 'NONE'.
001100 01  WS-ALT REDEFINES WS-PAY.
001200     05  WS-RAW        PIC X(30).
001300 PROCEDURE DIVISION.
001400 MAIN-LINE.
001500     PERFORM CALC-PAY.
001600     IF WS-GROSS > 1000 MOVE 1 TO WS-RATE.
001700     CALL 'TAXCALC' USING BY REFERENCE WS-GROSS WS-NAME.
001800     GO TO FINISH-UP.
001900 CALC-PAY.
002000     COMPUTE WS-GROSS = WS-RATE * 40.
002100     ADD 1 TO WS-LOOP-CNT.
002200     PERFORM SHOW-IT.
002300 SHOW-IT.
002400     DISPLAY 'ERROR: none'.
002500     GO TO CALC-PAY.
002600 FINISH-UP.
002700     CALL DYNAMIC-NAME.
002800     STOP RUN.
"""


@pytest.fixture(scope="module")
def programs(spark):
    return spark.createDataFrame([("p1", FIXED), ("p2", "IDENTIFICATION DIVISION.\nPROCEDURE DIVISION.\nONLY-ONE.\n  DISPLAY 'x'. *> note\n"), ("p3", ""), ("p4", None)], "program string, source string")


def test_structure(programs):
    got = {(r.program, r.name): (r.start_line, r.end_line) for r in sc.divisions(programs).collect()}
    assert got[("p1", "DATA")] == (3, 11) and got[("p1", "PROCEDURE")][0] == 12 and ("p2", "PROCEDURE") in got
    assert [r.name for r in sc.sections(programs).collect()] == ["WORKING-STORAGE"]
    names = [r.name for r in sc.paragraphs(programs).orderBy("program", "start_line").collect()]
    assert names == ["MAIN-LINE", "CALC-PAY", "SHOW-IT", "FINISH-UP", "ONLY-ONE"]
    assert programs.select(sc.program_id("source").alias("x")).first().x == "PAY_ROLL"


def test_fields(programs):
    got = {r.name: r for r in sc.data_fields(programs).collect()}
    assert (got["WS-GROSS"].bytes, got["WS-RATE"].bytes, got["WS-NAME"].bytes) == (4, 2, 20)
    assert (got["WS-RATE"].parent, got["WS-NAME"].parent, got["WS-ALT"].parent, got["WS-RAW"].parent) == ("WS-RATES", "WS-PAY", None, "WS-ALT")
    assert got["WS-RATES"].occurs == 3 and got["WS-ALT"].redefines == "WS-PAY"


def test_flow_rules_and_calls(programs):
    paragraphs = sc.paragraphs(programs)
    statements = sc.statements(paragraphs).cache()
    edges = sc.flow_edges(statements)
    graph = {r.src: r.successors for r in sc.flow_graph(edges, paragraphs).collect()}
    assert graph == {"MAIN-LINE": ["CALC-PAY", "FINISH-UP"], "CALC-PAY": ["SHOW-IT"], "SHOW-IT": ["CALC-PAY"]}
    stats = {r.program: (r.gotos, r.forward) for r in sc.jump_stats(edges, paragraphs, statements).collect()}
    assert stats["p1"] == (2, 1) and stats["p2"] == (0, 0)
    assert {(r.src, r.dst) for r in sc.perform_closure(edges).collect()} == {("MAIN-LINE", "CALC-PAY"), ("CALC-PAY", "SHOW-IT"), ("MAIN-LINE", "SHOW-IT")}
    rules = [(r.rule_id, r.rule_type, r.paragraph) for r in sc.business_rules(statements).orderBy("rule_id").collect()]
    assert rules == [("BR-001", "threshold_check", "MAIN-LINE"), ("BR-002", "complex_formula", "CALC-PAY")]
    calls = {r.callee: (r.is_dynamic, r.parameters) for r in sc.calls(statements).collect()}
    assert calls == {"TAXCALC": (False, ["WS-GROSS", "WS-NAME"]), "DYNAMIC-NAME": (True, [])}
    assert {r.type for r in sc.error_handlers(statements).collect()} == {"error_display", "program_termination"}
    kinds = {r.name: r.c for r in paragraphs.select("name", sc.paragraph_class("name", "content").alias("c")).collect()}
    assert kinds["MAIN-LINE"] == "MIXED" and kinds["CALC-PAY"] == "PURE" and kinds["SHOW-IT"] == "INFRASTRUCTURE"


def test_copy_closure_survives_cycles(spark):
    uses = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("D", "E")], "src string, dst string")
    roots = spark.createDataFrame([("p", "A")], "root string, name string")
    assert {r.name for r in sc.copy_closure(roots, uses).collect()} == {"A", "B", "C"}
    assert spark.createDataFrame([("IDENTIFICATION DIVISION.\nCOPY ABC.\n*> COPY NOT.\ncopy 'x-y'.",)], "s string").select(sc.copy_names("s").alias("x")).first().x == ["ABC", "X-Y"]


def test_result_layouts(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"task_id": "LCB-T1-001", "submitter": {"name": "s", "model": "m"}, "overall_score": 0.7, "result": {"version": "2.3.1", "lcb_score": 70.0, "scores": {"sc": 80.0, "dq": 60.0, "bf": 70.0}, "critical_failures": [{"id": "CF-03", "name": "x"}]}}')
    (tmp_path / "b.json").write_text('{"task_id": "LCB-T2-001", "submitter": {"name": "s", "model": "n"}, "overall_score": 0.5, "result": {"structural_completeness": 0.4, "behavioral_fidelity": 0.5, "semantic_quality": 0.6, "traceability": 0.1, "critical_failures": ["CF-05: calls"]}}')
    (tmp_path / "c.json").write_text('{"other": 1}')
    (tmp_path / "leaderboard.json").write_text("{}")
    got = {r.model: r for r in rs.normalised_results(rs.read_results(spark, str(tmp_path))).collect()}
    assert (got["m"].sc, got["m"].lcb, got["m"].failures) == (0.8, 0.7, ["CF-03"]) and (got["n"].version, got["n"].failures) == ("2.1", ["CF-05"])
    assert len(got) == 2


def test_board_and_sinks(spark, tmp_path):
    rows = [("t1", "m", "s", "T1", "COBOL", 0.8, 0.6, 0.7, 0.7, []), ("t2", "m", "s", "T2", "UniBasic", 0.6, 0.6, 0.5, 0.0, ["CF-03"]), ("t1", "n", "s", "T1", "COBOL", 0.9, 0.9, 0.9, 0.9, [])]
    board = leaderboard(spark.createDataFrame(rows, "task_id string, model string, submitter string, tier string, language string, sc double, dq double, bf double, lcb double, failures array<string>"))
    got = {r.model: r for r in board.collect()}
    assert got["n"].rank == 1 and got["m"].avg_lcb_components == pytest.approx(0.63) and got["m"].avg_lcb_tasks == 0.35 and got["m"].languages == "COBOL,UniBasic"
    rs.write_board(board, str(tmp_path / "board"))
    assert spark.read.csv(str(tmp_path / "board/csv"), header=True).count() == 2
    assert [r.value for r in rs.markdown(board, ["rank", "model"]).orderBy("line_no").collect()] == ["| rank | model |", "| --- | --- |", "| 1 | n |", "| 2 | m |"]


def test_unwrapped_and_merged(spark):
    text = '<!-- Source: a -->{"content": "one"}<!-- Source: b -->\nplain'
    assert spark.createDataFrame([(text,)], "d string").select(rs.unwrapped("d").alias("x")).first().x == "one\n\nplain"


def test_streamed_board(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = write_to_memory(running_board(stream, "event_type", ["value"]), "board_now")
    query.processAllAvailable()
    query.stop()
    got = {r.event_type: r.n for r in spark.table("board_now").collect()}
    assert got == {r.event_type: r["count"] for r in events.groupBy("event_type").count().collect()}
