"""Files on disk: CSV, workbooks, manifests, catalogs, streams."""

import hashlib
import json
import random
import shutil

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from khata.operators.metrics import usage
from khata.plans import fixtures
from khata.plans.fixtures import workbook_bytes
from khata.session import build_session, shared_dir, spread
from khata.sources import csv_source, delimited, digests, dimensions, folder, manifest, snapshots, stores, workbook
from khata.streaming import ingest, running_metrics


def write(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_text(text)
    return str(folder)


# --- CSV -----------------------------------------------------------------------------

def test_clean_csv_keeps_names(spark, tmp_path):
    d = write(tmp_path / "c", a__csv="Bill No,Total\nB1,5\n")
    df = csv_source.read_clean(spark, d)
    assert df.columns == ["Bill No", "Total"] and df.first()["Total"] == 5


def test_header_detection(spark, tmp_path):
    d = write(tmp_path / "h", plain__csv="a,b,c\n1,2,3\n", title__csv="Acme Ltd\nPeriod, 2021\n\na,b,c\n1,2,3\n4,5,6\n",
              none__csv="x\ny\n", tie__csv="a,b\nc,d,e\n1,2\n1,2,3\n")
    got = {r.source_file.rsplit("/", 1)[1]: r.skip_rows for r in csv_source.find_headers(spark, d).collect()}
    assert got == {"plain.csv": 0, "title.csv": 3, "none.csv": 0, "tie.csv": 0}


def test_messy_folder_is_cleaned_by_default_d17(spark, tmp_path):
    d = write(tmp_path / "m", a__csv='Acme\n\nBill No,Total Amt,,\nB1,"5",,x\nB2,7,,\nbill_no,total_amt,,\n,,,\n',
              b__csv='Bill No,Other,Other\n"B3, x",1,2\n')
    got = sorted(tuple(r)[1:] for r in csv_source.read_messy(spark, d, {
        "bill_no": "string", "total_amt": "int", "col_2": "string", "other": "int", "other_1": "int"}).collect())
    assert got == [("B1", 5, "x", None, None), ("B2", 7, None, None, None), ("B3, x", None, None, 1, 2)]
    assert csv_source.read_messy(spark, d).columns == ["source_file", "bill_no", "col_2", "other", "other_1", "total_amt"]


def test_rows_leave_in_batches(spark, tmp_path):
    d = write(tmp_path / "l", big__csv="Title\nk,v\n" + "".join(f"{i},{i}\n" for i in range(20000)))
    got = csv_source.read_messy(spark, d, {"k": "int", "v": "int"}).agg(F.count("*"), F.sum("k"), F.min("k")).first()
    assert tuple(got) == (20000, sum(range(20000)), 0)


def test_quoted_cells(spark, tmp_path):
    wide = ",".join(f'"c{i}"' for i in range(20000))
    d = write(tmp_path / "q", wide__csv=wide + "\n" + ",".join('"1,5"' for _ in range(20000)) + "\n",
              broken__csv='a,b\n"one\ntwo ""x""",2\n5" pipe,3\n')
    got = csv_source.read_messy(spark, d, {"c0": "string", "c19999": "string", "a": "string", "b": "int"}).collect()
    assert sorted(tuple(r)[1:] for r in got if r.a is None) == [("1,5", "1,5", None, None)]
    assert sorted(tuple(r)[3:] for r in got if r.a) == [('5" pipe', 3), ('one\ntwo "x"', 2)]


def test_files_above_50_mb_are_read_whole(spark, tmp_path):
    d = tmp_path / "large"
    d.mkdir()
    with open(d / "a.csv", "w") as f:
        f.write("Ledger\nk,note\n")
        for i in range(60_000):
            f.write(f'{i},"{"x" * 400}\n{"y" * 500}"\n')
    assert (d / "a.csv").stat().st_size > 50 * 1024 * 1024
    for rows in (csv_source.read_messy(spark, str(d), {"k": "int", "note": "string"}),
                 csv_source.read_by_extension(spark, str(d / "a.csv"), columns={"k": "int", "note": "string"}),
                 csv_source.read_folder(spark, str(d), T.StructType.fromDDL("k INT, note STRING")), folder.read_any(spark, str(d))[0]):
        got = rows.agg(F.count("k"), F.sum(F.col("k").cast("long")), F.min(F.length("note")), F.max(F.length("note"))).first()
        assert tuple(got) == (60_000, sum(range(60_000)), 901, 901)
    card = dimensions.read_dimension(spark, write(tmp_path / "card", a__csv=(d / "a.csv").read_text().split("\n", 1)[1]), ["k"], "k")
    assert card.agg(F.count_if(F.col("pos") == F.col("k").cast("long") + 1)).first()[0] == 60_000


def test_files_split_anywhere_give_the_rows_of_whole_files(spark, tmp_path, monkeypatch):
    d, r = tmp_path / "split", random.Random(7)
    d.mkdir()
    cells = ["1", "b", "", " c d", '"e,f"', '"g\nh"', '"\n\n"', '"i ""j"" k"', 'l"m', '"n"o', ' "p\r\nq"', "é", "A", '""', "\xa0"]
    for i in range(12):
        top = "".join(r.choice(["Title\n", "\n", '"x, y\n', "a,b,c,d\n"]) for _ in range(r.randrange(3)))
        head = r.choice(["A,B,C", "A,,B", "A,A,Unnamed: 2", 'A,"B\nB",C'])
        body = ["" if r.random() < 0.1 else ",".join(r.choice(cells) for _ in range(r.choice([2, 3, 3, 3, 4]))) for _ in range(r.randrange(25))]
        end = r.choice(["\n", "\r\n", "\r"])
        text = "\n".join([top + head, *body]) + r.choice(["", "\n", '\n1,"never closed\n\n2,3\n'])
        (d / f"f {i}+%41.csv").write_bytes(r.choice([b"", b"\xef\xbb\xbf"]) + text.replace("\n", end).encode() + r.choice([b"", b"\xff\0"]))
    expected = {f"file:{p}": sorted((no, sorted(pairs)) for no, pairs in delimited.parsed(p.read_bytes())) for p in d.iterdir()}
    heads = {f"file:{p}": delimited.header_line(delimited.decoded(p.read_bytes())) for p in d.iterdir()}
    for chunk, split in ((1 << 20, "64m"), (40, "64m"), (40, "97b"), (1, "300b")):
        monkeypatch.setattr(delimited, "CHUNK", chunk)
        before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
        for k, v in zip(before, (split, "1b" if split != "64m" else "4m")):
            spark.conf.set(k, v)
        try:
            got = {}
            for row in delimited.line_cells(delimited.file_lines(spark, str(d))).collect():
                got.setdefault(row.source_file, []).append((row.row_no, sorted(row.cells.items())))
            found = {h.source_file: (h.skip_rows, h.header_line) for h in csv_source.find_headers(spark, str(d)).collect()}
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
        assert found == heads
        assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in expected.items() if v}


def test_unclosed_quote_is_an_error_of_its_file(spark, tmp_path, monkeypatch):
    """A stray quote does not make one row of the rest of a file; rows with line breaks over many chunks still are rows."""
    monkeypatch.setattr(delimited, "CHUNK", 40)
    stray = "a,b\n1,x\n2,\"oops\n" + "".join(f"{i},y\n" for i in range(3, 400))
    good = "a,b\n1,x\n2,\"" + "line\n" * 60 + "end\"\n3,z\n"
    d = write(tmp_path / "o", stray__csv=stray, good__csv=good)
    rows, errors = folder.read_any(spark, d)
    assert sorted((r.a, len(r.b)) for r in rows.collect()) == [("1", 1), ("2", 303), ("3", 1)]
    assert [(r.source_file.rsplit("/", 1)[1], r.error) for r in errors.collect()] == [("stray.csv", "Quote that is not closed in row 2")]
    with pytest.raises(Exception, match="Quote that is not closed"):
        csv_source.read_messy(spark, d).collect()


def test_columns_go_by_name(spark, tmp_path):
    d = write(tmp_path / "o", one__csv="a,b\n1,x\n", two__csv="b,a\ny,2\n")
    schema = T.StructType.fromDDL("a INT, b STRING")
    for rows in (csv_source.read_folder(spark, d, schema), csv_source.read_messy(spark, d, {"a": "int", "b": "string"})):
        assert sorted((r.a, r.b) for r in rows.collect()) == [(1, "x"), (2, "y")]
    dataset = str(tmp_path / "ds")
    ingest.load_new_files(spark, d, schema, dataset, str(tmp_path / "check"))
    assert sorted((r.a, r.b) for r in ingest.read_rows(spark, dataset, schema).collect()) == [(1, "x"), (2, "y")]
    with pytest.raises(Exception, match="header|Header"):
        csv_source.read_clean(spark, d, "a INT, b STRING").collect()


def test_mixed_folder_lists_what_cannot_be_read(spark, tmp_path):
    d = write(tmp_path / "mixed", a__csv="Bill No,Amt\nB1,1\n", old__xls="x")
    (tmp_path / "mixed" / "book.xlsx").write_bytes(workbook_bytes([["Bill No", "Party", "Amt"], ["B2", "Z", 2]]))
    (tmp_path / "mixed" / "broken.xlsx").write_bytes(b"no zip")
    rows, errors = folder.read_any(spark, d)
    assert sorted((r.bill_no, r.amt, r.party) for r in rows.collect()) == [("B1", "1", None), ("B2", "2", "Z")]
    got = {r.source_file.rsplit("/", 1)[1]: r.error for r in errors.collect()}
    assert set(got) == {"broken.xlsx", "old.xls"} and "BadZipFile" in got["broken.xlsx"] and "Unsupported" in got["old.xls"]
    rows, errors = folder.read_any(spark, d, sheet="Other")
    assert rows.count() == 1 and errors.count() == 3


def test_incremental_load_of_a_mixed_folder(spark, tmp_path):
    d = write(tmp_path / "data", **{"a b__csv": "Bill No,Amt\nB1,1\n", "a-b__csv": "Bill No,Other\nB2,9\n"})
    book = tmp_path / "data" / "book.xlsx"
    book.write_bytes(workbook_bytes([["Bill No", "Party", "Amt"], ["B3", "Z", 3]]))
    (tmp_path / "data" / "bad.xlsx").write_bytes(b"no zip")
    dataset, m = str(tmp_path / "ds"), [str(tmp_path / f"m{i}") for i in range(4)]

    def state(n):
        return sorted((r.source_name, r.bill_no, r.amt, r.other) for r in
                      manifest.open_dataset(spark, dataset, manifest.read_manifest(spark, m[n])).collect())

    first = manifest.incremental_load(spark, d, dataset, str(tmp_path / "none"), m[0])
    assert {r.filename for r in first.where("error is not null").collect()} == {"bad.xlsx"}
    whole = [("a b.csv", "B1", "1", None), ("a-b.csv", "B2", None, "9"), ("book.xlsx", "B3", "3", None)]
    assert state(0) == whole
    # one of two files with one table name changes; the broken one is mended
    write(tmp_path / "data", **{"a b__csv": "Bill No,Amt\nB1,10\n"})
    (tmp_path / "data" / "bad.xlsx").write_bytes(workbook_bytes([["Bill No", "Party", "Amt"], ["B4", "Y", 4]]))
    second = manifest.incremental_load(spark, d, dataset, m[0], m[1])
    assert (names(second, "MODIFIED"), names(second, "NEW")) == (["a b.csv"], ["bad.xlsx"])
    whole = [("a b.csv", "B1", "10", None), whole[1], ("bad.xlsx", "B4", "4", None), whole[2]]
    assert state(1) == whole
    # a table lost from the dataset is loaded again
    shutil.rmtree(tmp_path / "ds" / "source_table=book")
    manifest.incremental_load(spark, d, dataset, m[1], m[2])
    assert state(2) == whole
    assert names(manifest.incremental_load(spark, d, dataset, m[2], m[3]), "UNCHANGED") == ["a b.csv", "a-b.csv", "bad.xlsx", "book.xlsx"]
    assert state(3) == whole


def test_loads_of_many_files_are_one_pool(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "FOLDERS", 2)
    d = write(tmp_path / "data", **{"a b__csv": "Bill No,Amt\nB1,1\n", "a-b__csv": "Bill No,Other\nB2,9\n", "c__csv": "Bill No\nB3\n"})
    (tmp_path / "data" / "bad.xlsx").write_bytes(b"no zip")
    dataset, m = str(tmp_path / "ds"), [str(tmp_path / f"m{i}") for i in range(6)]
    state = lambda n: sorted(((r.source_name, r.bill_no, r.amt, r.other) for r in
                              manifest.open_dataset(spark, dataset, manifest.read_manifest(spark, m[n])).collect()), key=repr)
    pools = lambda: sorted((tmp_path / "ds" / "_pools").iterdir(), key=lambda p: p.stat().st_mtime)
    manifest.incremental_load(spark, d, dataset, str(tmp_path / "none"), m[0])
    assert state(0) == [("a b.csv", "B1", "1", None), ("a-b.csv", "B2", None, "9"), ("c.csv", "B3", None, None)]
    assert not list((tmp_path / "ds").glob("source_table=*")) and len(pools()) == 1
    # two files (one that is still broken) go to folders, beside the pool, which keeps the rows that no longer count
    write(tmp_path / "data", **{"a b__csv": "Bill No,Amt\nB1,10\n"})
    assert names(manifest.incremental_load(spark, d, dataset, m[0], m[1]), "MODIFIED") == ["a b.csv"]
    whole = [("a b.csv", "B1", "10", None), ("a-b.csv", "B2", None, "9"), ("c.csv", "B3", None, None)]
    assert state(1) == whole and state(0)[1:] == whole[1:] and len(pools()) == 1
    # a changed file, a new one and the broken one are a second pool; a deleted one goes
    write(tmp_path / "data", **{"a b__csv": "Bill No,Amt\nB1,100\n", "e__csv": "Bill No,Amt\nB5,5\n"})
    (tmp_path / "data" / "c.csv").unlink()
    manifest.incremental_load(spark, d, dataset, m[1], m[2])
    whole = [("a b.csv", "B1", "100", None), whole[1], ("e.csv", "B5", "5", None)]
    assert state(2) == whole and len(pools()) == 2
    # a lost pool: all of its tables are loaded again, with the other file of a table that two files share
    shutil.rmtree(pools()[1])
    manifest.incremental_load(spark, d, dataset, m[2], m[3])
    assert state(3) == whole and len(pools()) == 2
    manifest.incremental_load(spark, d, dataset, m[3], m[4])
    assert state(4) == whole and state(3) == whole


def test_folder_reports_bad_lines(spark, tmp_path):
    d = write(tmp_path / "b", good__csv="a,b\n1,x\n2,y\n", bad__csv="a,b\none,x\n3,y\n", skip__txt="a,b\n1,2\n")
    df = csv_source.read_folder(spark, d, T.StructType.fromDDL("a INT, b STRING"))
    got = {r.source_file.rsplit("/", 1)[1]: (r.lines, r.bad_lines) for r in csv_source.bad_lines(df).collect()}
    assert got == {"good.csv": (2, 0), "bad.csv": (2, 1)}


def test_dispatch_by_extension(spark, tmp_path):
    write(tmp_path / "x", a__csv="a,b\n1,2\n")
    assert csv_source.read_by_extension(spark, str(tmp_path / "x" / "a.csv")).count() == 1
    with pytest.raises(ValueError, match="Unsupported file type: .pdf"):
        csv_source.read_by_extension(spark, "x.pdf")


def test_cleaning_of_frames(spark):
    df = spark.createDataFrame([("1", None, "x"), (None, None, None), ("A ", None, "b b")], "`A ` string, e string, `B b` string")
    out = csv_source.drop_empty(df)
    assert out.columns == ["A ", "B b"] and out.count() == 2
    assert csv_source.clean_names(out).columns == ["a", "b_b"]
    again = spark.createDataFrame([("A", "b"), ("A", None), ("x", "b")], "a string, b string")
    assert [tuple(r) for r in csv_source.drop_repeated_headers(again).collect()] == [("x", "b")]


# --- workbooks -----------------------------------------------------------------------

def test_workbook(spark, tmp_path):
    (tmp_path / "w").mkdir()
    book = workbook_bytes([["Acme & Sons Ltd"], [], ["Period", "2021"], ["Bill No", "Party_Name", "Total Amt", "Notes"],
                           ["B1", "Shah", 10.5, None], ["B2", "Rao", 7, None], ["bill_no", "party_name", "total_amt", None]])
    (tmp_path / "w" / "ledger.xlsx").write_bytes(book)
    (tmp_path / "w" / "plain.xlsx").write_bytes(workbook_bytes([["Bill No", "Party", "Amt"], ["B9", "Z", 1]]))
    rows = workbook.read_workbooks(spark, str(tmp_path / "w"), columns={"bill_no": "string", "party_name": "string", "total_amt": "double", "amt": "int"})
    assert sorted(tuple(r)[1:] for r in rows.collect()) == [("B1", "Shah", 10.5, None), ("B2", "Rao", 7.0, None), ("B9", None, None, 1)]


def test_broken_workbook_is_an_error(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "plain.xlsx").write_bytes(workbook_bytes([["Bill No", "Party", "Amt"], ["B9", "Z", 1]]))
    (tmp_path / "w" / "bad.xlsx").write_bytes(b"no zip")
    with pytest.raises(ValueError, match="bad.xlsx: .*BadZipFile"):
        workbook.read_workbooks(spark, str(tmp_path / "w"))
    with pytest.raises(ValueError, match="bad.xlsx"):
        csv_source.read_by_extension(spark, str(tmp_path / "w" / "bad.xlsx"))


def test_small_files_leave_in_common_batches(monkeypatch):
    good, rows_of = workbook_bytes([["a", 1], ["b", 2]]), lambda path, content: ((path, no, cells, texts, None) for no, cells, texts in workbook.sheet_rows(content))
    files = pa.RecordBatch.from_pydict({"path": [f"f{i}" for i in range(100)], "content": [b"no zip" if i == 7 else None if i == 8 else good for i in range(100)]})
    made = lambda: list(delimited.gathered(iter([files, files]), rows_of, lambda path, e: (path, -1, None, None, e), workbook._ARROW))
    one = made()
    assert [b.num_rows for b in one] == [2 * (98 * 2 + 2)]
    assert [(r["source_file"], r["cells"]) for r in one[0].slice(12, 5).to_pylist()] == [
        ("f6", ["a", "1"]), ("f6", ["b", "2"]), ("f7", None), ("f8", None), ("f9", ["a", "1"])]
    # no more rows, and not those of more bytes of files, at once
    monkeypatch.setattr(delimited, "_ROWS_PER_BATCH", 3)
    assert max(b.num_rows for b in made()) == 3 and pa.Table.from_batches(made()).to_pylist() == one[0].to_pylist()
    monkeypatch.setattr(delimited, "_ROWS_PER_BATCH", 5000)
    monkeypatch.setattr(delimited, "_BYTES_PER_BATCH", 1)
    assert {b.num_rows for b in made()} <= {1, 2, 3} and pa.Table.from_batches(made()).to_pylist() == one[0].to_pylist()


def test_workbooks_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "BOOKS_PER_TASK", 10)
    books = fixtures.customer_workbooks(spark, "/root/testdata/sf0.001")
    assert books.rdd.getNumPartitions() == 15 and books.select("path").distinct().count() == 150


def test_workbook_sheet_by_name(spark):
    with pytest.raises(ValueError, match="no sheet"):
        list(workbook.sheet_rows(workbook_bytes([["a"]]), "Other"))
    assert list(workbook.sheet_rows(workbook_bytes([["a", 1]], "Data"), "Data")) == [(0, ["a", "1"], [True, False])]


# --- manifests -----------------------------------------------------------------------

def names(df, change):
    return sorted(r.filename for r in df.where(F.col("change") == change).collect())


def test_changes_and_incremental_load(spark, tmp_path):
    d = write(tmp_path / "data", **{"Sales-Jan__csv": "Bill No,Amt\nB1,1\nB2,2\n", "old__csv": "Bill No,Amt\nB3,3\n", "note__txt": "x"})
    dataset, m1, m2 = (str(tmp_path / n) for n in ("ds", "m1", "m2"))
    cols = {"bill_no": "string", "amt": "int"}
    first = manifest.incremental_load(spark, d, dataset, str(tmp_path / "none"), m1, cols)
    assert names(first, "NEW") == ["Sales-Jan.csv", "old.csv"]
    stored = manifest.read_manifest(spark, m1)
    assert {(r.filename, r.table_name, r.row_count) for r in stored.collect()} == {("Sales-Jan.csv", "sales_jan", 2), ("old.csv", "old", 1)}
    assert manifest.summary(manifest.detect_changes(stored, manifest.scan_files(spark, d))).first().needs_reload is False

    write(tmp_path / "data", **{"Sales-Jan__csv": "Bill No,Amt\nB1,10\n", "new__csv": "Bill No,Amt\nB4,4\n"})
    (tmp_path / "data" / "old.csv").unlink()
    second = manifest.incremental_load(spark, d, dataset, m1, m2, cols)
    assert [names(second, c) for c in ("NEW", "MODIFIED", "DELETED", "UNCHANGED")] == [["new.csv"], ["Sales-Jan.csv"], ["old.csv"], []]
    assert [r.table_name for r in manifest.tables_to_drop(second).collect()] == ["old"]
    got = manifest.open_dataset(spark, dataset, manifest.read_manifest(spark, m2))
    assert sorted((r.source_table, r.bill_no, r.amt) for r in got.collect()) == [("new", "B4", 4), ("sales_jan", "B1", 10)]


def test_lost_table_is_loaded_again(spark):
    old = spark.createDataFrame([("a.csv", "1", "a"), ("b.csv", "1", "b")], "filename string, file_hash string, table_name string")
    new = spark.createDataFrame([("a.csv", "1"), ("b.csv", "1")], "filename string, file_hash string")
    changes = manifest.detect_changes(old, new)
    tables = spark.createDataFrame([("a",)], "table_name string")
    assert [(r.filename, r.change) for r in manifest.load_plan(changes, tables).collect()] == [("b.csv", "NEW")]
    assert manifest.summary(changes, tables).first().needs_reload is True


def test_corrupt_manifest_counts_as_empty(spark, tmp_path):
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part.json").write_text('{"filename": "a.csv", "file_hash": "1"}\nnot json\n')
    assert manifest.read_manifest(spark, str(tmp_path / "bad")).count() == 0
    assert manifest.read_manifest(spark, str(tmp_path / "missing")).count() == 0


def test_accepted_files(spark):
    df = spark.createDataFrame([("a.csv", 10), ("a.XLSX", 52428800), ("a.csv", 52428801), ("a.pdf", 1)], "filename string, file_size bigint")
    assert [r.ok for r in df.select(csv_source.is_accepted(F.col("filename"), F.col("file_size")).alias("ok")).collect()] == [True, True, False, False]


# --- stores --------------------------------------------------------------------------

def test_catalog_store(spark, tmp_path):
    path = str(tmp_path / "cat")
    stores.write_catalog(spark.createDataFrame([("a", "old"), ("b", "old")], "table_name string, description string"), path)
    new = stores.upsert(stores.read_catalog(spark, path), spark.createDataFrame([("b", "new")], "table_name string, description string"))
    assert sorted((r.table_name, r.description) for r in new.collect()) == [("a", "old"), ("b", "new")]
    assert [r.table_name for r in stores.remove(new, "a").collect()] == ["b"]


def test_profiles_and_tenant_filter(spark, tmp_path):
    for name, company in (("zeta", "A Traders"), ("alpha", "B Stores"), ("broken", None)):
        (tmp_path / "ws" / name).mkdir(parents=True)
        (tmp_path / "ws" / name / "profile.json").write_text(json.dumps({"company_name": company}, indent=1) if company else "{oops")
    got = [(r.customer_id, r.company_name) for r in stores.read_profiles(spark, str(tmp_path / "ws")).collect()]
    assert got == [("zeta", "A Traders"), ("alpha", "B Stores")]
    df = spark.createDataFrame([("acme_corp", 1), ("other", 2)], "customer_id string, v int")
    df.write.partitionBy("customer_id").parquet(str(tmp_path / "t"))
    mine = stores.for_tenant(spark.read.parquet(str(tmp_path / "t")), "Acme Corp")
    assert [r.v for r in mine.collect()] == [1]


def test_tables_come_and_go(spark):
    stores.save_table(spark.range(3), "khata_t")
    assert spark.table("khata_t").count() == 3
    stores.save_table(spark.range(2), "khata_t")
    assert spark.table("khata_t").count() == 2
    stores.drop_table(spark, "khata_t")
    stores.drop_table(spark, "khata_t")
    assert not spark.catalog.tableExists("khata_t")


def test_metrics_of_an_empty_log(spark):
    log = spark.createDataFrame([], "name string, type string, value double, ts timestamp")
    r = usage(log).first()
    assert (r.queries_total, r.total_tax_savings, r.session_seconds) == (0, 0.0, 0)


# --- session and streams -------------------------------------------------------------

def test_shared_dir_follows_the_session(spark, tmp_path):
    class Session:
        conf = {"spark.checkpoint.dir": f"{tmp_path}/"}
        sparkContext = None

    assert shared_dir(Session, "x").startswith(f"{tmp_path}/x-")
    assert shared_dir(spark, "x") != shared_dir(spark, "x")
    assert build_session() is not None


def test_spread_leaves_wide_scans_alone(spark):
    wide = spark.range(0, 100, 1, 64)
    assert spread(wide) is wide
    assert spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == 8


def test_file_stream_takes_each_file_once(spark, tmp_path):
    d = write(tmp_path / "in", one__csv="a,b\n1,x\n")
    schema = T.StructType.fromDDL("a INT, b STRING")
    dataset, check = str(tmp_path / "out"), str(tmp_path / "check")
    assert ingest.read_rows(spark, dataset, schema).count() == 0
    ingest.load_new_files(spark, d, schema, dataset, check)
    write(tmp_path / "in", **{"Two-b__csv": "a,b\n2,y\n3,z\n", "odd [1] {x}__csv": "b,a\nw,4\n"})
    (tmp_path / "in" / "book.xlsx").write_bytes(workbook_bytes([["A", "B", "C"], [5, "v", "c"]]))
    (tmp_path / "in" / "bad.xlsx").write_bytes(b"no workbook")
    ingest.load_new_files(spark, d, schema, dataset, check)
    want = [("book", 5, "v"), ("odd_[1]_{x}", 4, "w"), ("one", 1, "x"), ("two_b", 2, "y"), ("two_b", 3, "z")]
    got = lambda: sorted((r.source_table, r.a, r.b) for r in ingest.read_rows(spark, dataset, schema).collect())
    assert got() == want
    files = {r.filename: (r.row_count, r.error is None, r.batch_id) for r in ingest.read_files(spark, dataset).collect()}
    assert files == {"one.csv": (1, True, 0), "Two-b.csv": (2, True, 1), "odd [1] {x}.csv": (1, True, 1), "book.xlsx": (1, True, 1), "bad.xlsx": (0, False, 1)}
    # the last batch is run again, as after a failure before its commit
    (tmp_path / "check" / "commits" / "1").unlink()
    (tmp_path / "check" / "commits" / ".1.crc").unlink(missing_ok=True)
    ingest.load_new_files(spark, d, schema, dataset, check)
    assert got() == want and ingest.read_files(spark, dataset).count() == 5
    # rows of a batch that broke off before its manifest do not count
    shutil.copytree(tmp_path / "out" / "rows" / "batch_id=1", tmp_path / "out" / "rows" / "batch_id=2")
    assert got() == want


def test_running_metrics_over_batches(spark, tmp_path):
    """Rows far behind the watermark count like others, and are counted as late; compaction and replay change nothing."""
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))

    def add(rows):
        df = spark.createDataFrame(rows, "name string, value double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(src)
        running_metrics.run(spark.readStream.schema("name string, value double, ts timestamp").parquet(src), out, check)

    def figures():
        return {str(r.window_start)[:10]: (r.calls, float(r.total), r.max_value, r.min_value, r.late_calls)
                for r in running_metrics.latest(spark, out).collect()}

    running_metrics.compact(spark, out)
    assert figures() == {}
    add([("a", 1.0, "2024-01-01 01:00:00"), ("a", 5.0, "2024-01-09 01:00:00")])
    add([("a", 2.0, "2024-01-01 09:00:00"), ("a", 7.0, "2024-01-08 09:00:00")])
    want = {"2024-01-01": (2, 3.0, 2.0, 1.0, 1), "2024-01-08": (1, 7.0, 7.0, 7.0, 0), "2024-01-09": (1, 5.0, 5.0, 5.0, 0)}
    assert figures() == want
    running_metrics.compact(spark, out)
    running_metrics.compact(spark, out)
    assert figures() == want
    add([("a", 4.0, "2024-01-01 10:00:00")])
    want["2024-01-01"] = (3, 7.0, 4.0, 1.0, 2)
    assert figures() == want
    (tmp_path / "check" / "commits" / "2").unlink()
    (tmp_path / "check" / "commits" / ".2.crc").unlink(missing_ok=True)
    running_metrics.run(spark.readStream.schema("name string, value double, ts timestamp").parquet(src), out, check)
    assert figures() == want
    shutil.copytree(tmp_path / "out" / "added" / "batch_id=2", tmp_path / "out" / "added" / "batch_id=3")  # broke off before its mark
    assert figures() == want


# --- digests and snapshots -----------------------------------------------------------

def test_digests_stream_files(spark, tmp_path):
    """Files larger than the buffer, as those above 2 GB are larger than the usual one; sparse, empty and hidden files."""
    d = tmp_path / "files"
    (d / "sub").mkdir(parents=True)
    data = bytes(range(256)) * 5000
    (d / "large é.csv").write_bytes(data)
    (d / "sub" / "empty.CSV").write_bytes(b"")
    (d / "sub" / "empty.csv").write_bytes(b"")
    (d / "sub" / "_hidden.csv").write_bytes(b"x")
    (d / "note.txt").write_bytes(b"x")
    with open(d / "sparse.xlsx", "wb") as f:
        f.truncate(300 << 20)
    rows = {r.path.rsplit("/", 1)[-1]: (r.length, r.file_hash) for r in digests.file_digests(spark, str(d), buffer=1000 * 1024).collect()}
    zeros = hashlib.md5()
    for _ in range(300):
        zeros.update(bytes(1 << 20))
    assert rows == {"large é.csv": (len(data), hashlib.md5(data).hexdigest()), "empty.csv": (0, hashlib.md5(b"").hexdigest()),
                    "sparse.xlsx": (300 << 20, zeros.hexdigest())}
    assert digests.file_digests(spark, str(d), hashed=False).where("file_hash is not null").count() == 0
    assert digests.file_digests(spark, str(tmp_path / "nowhere")).count() == 0
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(str(d))
    ours = digests.file_digests(spark, str(d), globs=("*.csv",))
    assert {r.path for r in listed.select("path").collect()} == {r.path for r in ours.where("length > 0").collect()}
    assert digests.file_digests(spark, str(d), recursive=False).count() == 2


def test_snapshots(spark, tmp_path):
    path, schema = str(tmp_path / "store"), "a int"
    frame = lambda *v: spark.createDataFrame([(x,) for x in v], schema)
    values = lambda df: sorted(r.a for r in df.collect())
    assert snapshots.read(spark, path, schema) is None
    assert snapshots.write(frame(1, 2), path) == 1
    reader = snapshots.read(spark, path, schema)
    assert snapshots.write(reader.where("a = 2").unionByName(frame(3)), path) == 2  # in place
    assert values(reader) == [1, 2] and values(snapshots.read(spark, path, schema)) == [2, 3]  # a reader keeps what it began with
    with pytest.raises(Exception):  # a write that breaks off
        snapshots.write(spark.range(1).select(F.raise_error(F.lit("stop")).cast("int").alias("a")), path)
    assert values(snapshots.read(spark, path, schema)) == [2, 3]
    (tmp_path / "store" / "commits" / "00000003" / "_temporary").mkdir(parents=True)  # a commit that breaks off
    assert snapshots.write(frame(9), path) == 4 and values(snapshots.read(spark, path, schema)) == [9]
    assert snapshots.write(frame(), path) == 5 and values(snapshots.read(spark, path, schema)) == []
