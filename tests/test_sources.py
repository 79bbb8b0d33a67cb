import random

import pytest
from conftest import by_name, lines

from fieldnotes import bad_rows, open_tables, read_delimited, scan_files
from fieldnotes.operators.clean import clean_headers
from fieldnotes.sources.delimited import reader_headers


def _layout(spark, path):
    row = scan_files(spark, str(path)).first()
    return row["sep"], row["encoding"], row["multiline"]


def test_semicolons_decimal_commas_and_windows_1252(csv):
    text = "ville;température;score\nMontréal;3,5;10\nQuébec – “ok”;-2,25;12\nLyon;7,0;9\n"
    ds = csv(text.encode("cp1252"))
    book = by_name(ds)
    assert list(book) == ["ville", "température", "score"]
    assert (book["température"]["kind"], book["température"]["min"]) == ("numeric", -2.25)
    assert lines(ds.rows().rows, "ville")[1] == "Québec – “ok”"


@pytest.mark.parametrize("content, expected", [
    ("a,b\n1,é\n".encode(), (",", "utf-8", False)),
    (b"\xef\xbb\xbfa;b\n1;2\n", (";", "utf-8", False)),
    ("a|b\n1|é\n2|è\n".encode("cp1252"), ("|", "cp1252", False)),
    (b"a,b\n1,\x81\xe9\n", (",", "latin-1", False)),
    (b'a,b\n1,"x\ny"\n', (",", "utf-8", True)),
    (b"a,b\n1,2\n" * 20000 + "9,é\n".encode("cp1252"), (",", "cp1252", False)),   # found beyond the first bytes
])
def test_layouts(spark, tmp_path, content, expected):
    path = tmp_path / "x.csv"
    path.write_bytes(content)
    assert _layout(spark, path) == expected


def test_tsv_is_split_on_tabs_only(csv):
    assert csv("a\tb,c\n1\t2,3\n4\t5,6\n", "x.tsv").columns == ["a", "b,c"]


def test_byte_order_mark_and_quoted_line_breaks(csv):
    ds = csv(b'\xef\xbb\xbfname,note\nA,"one\ntwo, three"\nB,"say ""hi"""\n')
    assert ds.columns == ["name", "note"]
    assert lines(ds.rows().rows, "name", "note") == [("A", "one\ntwo, three"), ("B", 'say "hi"')]


def test_blank_rows_spaces_and_repeated_headers(csv):
    ds = csv("a,a,b\n1, x ,\n,,\n2,y,  \n")
    assert ds.row_count == 2
    assert ds.columns == ["a", "a.1", "b"]
    assert by_name(ds)["b"]["kind"] == "empty"


def test_header_rules():
    assert reader_headers(["a", "a", "", "a"]) == ["a", "a.1", "Unnamed: 2", "a.2"]
    assert clean_headers([" a", "a ", None, "a", "a (2)"]) == ["a", "a (2)", "column_3", "a (3)", "a (2) (2)"]


def test_empty_filler_columns_are_dropped(csv):
    assert csv("a,,b,\n1,,2,\n3,,4,x\n").columns == ["a", "b", "Unnamed: 3"]


def test_missing_tokens_only_count_as_whole_cells(csv):
    line = by_name(csv("v,w\nNA,1\nN/A,2\nnull,3\nNAN,4\nnone,5\n"))["v"]
    assert (line["valid"], line["missing"]) == (2, 3)


def test_short_rows_are_padded_and_long_rows_are_refused(spark, csv, tmp_path):
    ds = csv("a,b,c\n1,2,3\n4,5\n")
    assert lines(ds.rows().rows, "a", "b", "c") == [(1, 2, 3.0), (4, 5, None)]
    with pytest.raises(Exception, match="more fields"):
        csv("a,b\n1,2\n3,4,5\n6,7,8,9\n", "long.csv").row_count
    path = str(tmp_path / "long.csv")
    assert read_delimited(spark, path, on_bad="quarantine").row_count == 1
    assert [r["first_extra_field"] for r in bad_rows(spark, path).orderBy("a").collect()] == ["5", "8"]


@pytest.mark.parametrize("content", [b"", b"  \n \n"])
def test_empty_files_are_refused(csv, content):
    with pytest.raises(ValueError, match="empty"):
        csv(content)


@pytest.mark.parametrize("content", ["a,b\n", "a,b\n , \n"])
def test_header_without_rows_is_refused(csv, content):
    with pytest.raises(ValueError, match="no data"):
        csv(content)


def test_cells_are_shown_with_the_type_a_reader_gives_them(csv):
    ds = csv("n,f,gap,zip,flag,pay\n1,1.50,7,012,True,$5\n2,2.25,,100,FALSE,$6\n")
    dtypes = dict(ds.rows().rows.dtypes)
    assert [dtypes[c] for c in ("n", "f", "gap", "zip", "flag", "pay")] == [
        "bigint", "double", "double", "string", "boolean", "string"]
    assert ds.rows(q="1.50").total == 0 and ds.rows(q="1.5").total == 1
    assert ds.rows(q="7.0").total == 1


def test_a_folder_of_differently_written_files(spark, tmp_path):
    (tmp_path / "one.csv").write_text("id,name\n1,a\n2,b\n")
    (tmp_path / "two.txt").write_bytes("name;id;extra\né;3;x\nf;4;y\n".encode("cp1252"))
    (tmp_path / "three.tsv").write_text("id\tname\n5\tg\n")
    (tmp_path / "notes.md").write_text("not a table")
    ds = read_delimited(spark, str(tmp_path))
    got = {(r["id"], r["name"], r["extra"]) for r in ds.rows().rows.collect()}
    assert got == {(1, "a", None), (2, "b", None), (3, "é", "x"), (4, "f", "y"), (5, "g", None)}


def test_names_with_spaces_and_accents(spark, tmp_path):
    folder = tmp_path / "mes données"
    folder.mkdir()
    (folder / "un fichier.csv").write_bytes("ville;n\nQuébec;1\n".encode("cp1252"))
    (folder / "un fichier.bin").write_bytes(b"\x00\x01")
    assert _layout(spark, folder) == (";", "cp1252", False)
    assert lines(read_delimited(spark, str(folder)).rows().rows, "ville") == ["Québec"]


def test_a_header_longer_than_the_sample(csv):
    names = [f"column {k} " + "x" * 1000 for k in range(80)]
    assert len(",".join(names)) > 64 * 1024
    ds = csv(",".join(names) + "\n" + ",".join("1" for _ in names) + "\n")
    assert ds.columns == names


def test_tables_by_name_and_the_first_with_data(spark, tmp_path):
    folder = str(tmp_path / "book")
    spark.sql("select cast(null as string) a where false").write.parquet(f"{folder}/a_cover.parquet")
    spark.range(3).toDF("n").write.parquet(f"{folder}/b_data.parquet")
    spark.range(4).toDF("n").write.json(f"{folder}/c_more.json")
    book = open_tables(spark, folder)
    assert book.names == ["a_cover", "b_data", "c_more"]
    assert book.use().table == "b_data"
    assert book.use("c_more").row_count == 4
    with pytest.raises(KeyError):
        book.use("nope")
    with pytest.raises(ValueError):
        book.use("a_cover")


@pytest.mark.parametrize("stage", [True, False])
def test_rows_keep_the_order_of_the_file(spark, tmp_path, stage):
    path = tmp_path / "long.csv"
    path.write_text("n,t\n" + "".join(f"{k},{'x' * (k % 37)}\n" if k % 5 else ",\n" for k in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        ds = read_delimited(spark, str(path), stage=stage)
        assert ds.cells.rdd.getNumPartitions() > 2
        expected = [k for k in range(4000) if k % 5]
        assert lines(ds.rows(page=6, page_size=500).rows, "n") == expected[2500:3000]
        assert lines(ds.rows(page=6, page_size=500).rows, "row_number") == list(range(2501, 3001))
        assert lines(ds.rows(page=2, page_size=20, q="xxx").rows, "n") == [k for k in expected if k % 37 >= 3][20:40]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("content, sep", [
    ("A report, made by hand\nfor you, me, and all\n\n" + "id|name|n\n" + "".join(f"{k}|x, y|{k}\n" for k in range(50)), "|"),
    ("".join(f"{'word, ' * (k % 7)}a;b\n" for k in range(60)), ";"),
    ("a;b\n" + "".join(f'1;"x, {k}, y\nlast, {k}"\n' for k in range(60)), ";"),
    ("v\n1\n2\n", ","),
    ("a,b\n" * 20_000 + "x;y;z\n" * 21_000, ";"),
])
def test_the_delimiter_is_found_from_all_lines(spark, tmp_path, content, sep):
    path = tmp_path / "x.txt"
    path.write_text(content)
    assert _layout(spark, path)[0] == sep
    row = scan_files(spark, str(path), sep="#").first()
    assert row["sep"] == "#"


def test_a_given_delimiter_settles_it(csv):
    assert csv("a#b,c\n1#2,3\n", sep="#").columns == ["a", "b,c"]


def _written_by_rule(rows, sep, rng):
    """Rows as text, cells quoted where they have to be and at times elsewhere."""
    def cell(text):
        if any(c in text for c in ('\n', sep)) or text.startswith('"') or rng.random() < 0.2:
            return '"' + text.replace('"', '""') + '"'
        return text
    return "".join(sep.join(map(cell, row)) + "\n" for row in rows)


@pytest.mark.parametrize("split", [150, 100_000])
def test_cells_with_line_breaks_in_files_that_are_split_anywhere(spark, tmp_path, split):
    rng = random.Random(split)
    parts = ["a", "é", '"', '""', "\n", ";", " x", "5\" pipe", "end", "\n\n", '";', ';"', '"\n']
    rows = [("key", "te\nxt", "note")]
    for k in range(90):
        text = ["".join(rng.choice(parts) for _ in range(rng.randrange(5))) for _ in range(2)]
        rows.append((str(k), *[(t.strip() or "-") for t in text]))
    rows.append(("90", "long\n" * 100 + "end", "after"))
    path = tmp_path / "x.csv"
    path.write_text(_written_by_rule(rows, ";", rng), newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert scan_files(spark, str(path)).first()["multiline"]
        ds = read_delimited(spark, str(path))
        assert ds.columns == ["key", "te\nxt", "note"]
        got = ds.cells.select("c0000", "c0001", "c0002").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [tuple(r) for r in got] == rows[1:]


def test_a_stray_quote_leaves_a_file_in_lines(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('size,what\n5" pipe,a\n"6"" pipe",b\n7,say "hi\n')
    assert not scan_files(spark, str(path)).first()["multiline"]
    assert lines(read_delimited(spark, str(path)).rows().rows, "size", "what") == [('5" pipe', "a"), ('6" pipe', "b"), ("7", 'say "hi')]


@pytest.mark.parametrize("extra", [",,LOST", ",", ",x,", ',"a,b"', ',"line\nbreak",'])
def test_rows_with_more_fields_are_refused_whatever_the_fields_hold(spark, csv, tmp_path, extra):
    text = f"a,b,c\n1,2,3\n4,5,6{extra}\n7,\"8,8\",9\n"
    with pytest.raises(Exception, match="more fields"):
        csv(text)
    path = str(tmp_path / "data.csv")
    assert lines(read_delimited(spark, path, on_bad="quarantine").rows().rows, "a") == [1, 7]
    bad = bad_rows(spark, path, whole=True).collect()
    assert [(r["a"], r["record"], r["header_fields"]) for r in bad] == [("4", f"4,5,6{extra}", 3)]
    assert bad[0]["fields"] == {",,LOST": 5, ",": 4, ",x,": 5, ',"a,b"': 4, ',"line\nbreak",': 5}[extra]


def test_delimited_members_among_tables(spark, tmp_path):
    folder = tmp_path / "book"
    spark.range(3).toDF("n").write.parquet(f"{folder}/d_numbers.parquet")
    (folder / "a_cover.csv").write_text("title,date\n")
    (folder / "b_empty.txt").write_text("")
    (folder / "c_people.csv").write_text("name;zip;pay\nAnn;007;1,5\nBob;012;2,5\n")
    book = open_tables(spark, str(folder))
    assert book.names == ["a_cover", "b_empty", "c_people", "d_numbers"]
    ds = book.use()
    assert (ds.name, ds.table, ds.tables, ds.columns) == (str(folder), "c_people", tuple(book.names), ["name", "zip", "pay"])
    kinds = {name: line["kind"] for name, line in by_name(ds).items()}
    assert (kinds["zip"], kinds["pay"]) == ("categorical", "numeric")
    assert book.use("d_numbers").row_count == 3
    with pytest.raises(ValueError, match="no data"):
        book.use("a_cover")
