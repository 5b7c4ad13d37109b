from pyspark.sql import functions as F

from docmeter.sources import books


def test_names_and_kinds_of_paths(spark):
    paths = {"a/b/X.CPY": ("X", "cpy", True), "CPY/noext": ("NOEXT", "", True), "src/copybook.txt": ("COPYBOOK", "txt", False), "d/Copybooks/e/f.dat": ("F", "dat", True), "x.y.cob": ("X.Y", "cob", False), ".hidden": (".HIDDEN", "", False), "cpy": ("CPY", "", False)}
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.path: (r.s, r.x, r.b) for r in rows.select("path", books.stem("path").alias("s"), books.suffix("path").alias("x"), books.is_book("path").alias("b")).collect()}
    assert got == paths


def test_first_path_wins_and_missing_files_are_left_out(spark):
    files = spark.createDataFrame([("d", "z/A.cpy"), ("d", "b/a.copy"), ("e", "c/A.cpy"), ("d", "src/P.cbl")], "ds string, path string")
    index = books.book_index(files, "ds")
    assert sorted(tuple(r) for r in index.collect()) == [("d", "A", "b/a.copy"), ("e", "A", "c/A.cpy")]
    needs = spark.createDataFrame([(1, "d", ["q", "p"], ["a", "none"]), (2, "e", ["p"], []), (3, "d", None, None)], "program int, ds string, calls array<string>, copies array<string>")
    got = books.related_files(needs, index, books.program_index(files, "ds"), ["ds"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, "program", "P", "src/P.cbl"), (1, 1, "book", "A", "b/a.copy")]


def test_only_new_and_changed_sources_are_parsed(spark, tmp_path):
    seen = []

    def parse(df):
        seen.append(sorted(r.program for r in df.collect()))
        return df.select("program", F.length("source").alias("n"))

    make = lambda *rows: spark.createDataFrame(list(rows), "program int, source string")
    run = lambda df, language="first": sorted((r.program, r.n, r.run) for r in books.cached_parse(df, str(tmp_path), parse, language).collect())
    assert run(make((1, "a"), (2, "bb"))) == [(1, 1, 1), (2, 2, 1)]
    assert run(make((1, "a"), (2, "bbb"), (3, "a"))) == [(1, 1, 1), (2, 3, 2), (3, 1, 2)]
    assert run(make((1, "a"), (2, "bb"))) == [(1, 1, 1), (2, 2, 1)]
    assert run(make((1, "a")), "second") == [(1, 1, 1)]
    assert seen == [[1, 2], [2, 3], [], [1]]
    assert run(make()) == []
