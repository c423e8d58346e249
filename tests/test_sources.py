import os

from rankdraft.sources import lines, staged, targets


def write(tmp_path, name, text):
    os.makedirs(tmp_path / "in", exist_ok=True)
    (tmp_path / "in" / name).write_text(text, encoding="utf-8")
    return str(tmp_path / "in")


def test_lines_are_numbered_in_file_order_across_splits(spark, tmp_path):
    body = "".join(f"{i}\tTitle {i}\n" for i in range(4000))
    path = write(tmp_path, "a.tsv", body)
    write(tmp_path, "b.tsv", "4000\tTitle 4000\n4001\tTitle 4001")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows = lines.read_lines(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["line_no"], r["line"]) for r in rows) == [
        (i, f"{i}\tTitle {i}") for i in range(4002)
    ]


def test_targets(spark, tmp_path):
    text = 'number\tt\n1\t"A ""b"""\tx\nbroken\nnumber\tt\n2\tC\x0b3\tD\n'
    path = write(tmp_path, "t.tsv", text)
    got = [tuple(r) for r in targets.scan_targets(spark, path).orderBy("seq").collect()]
    assert got == [(1, '"A ""b"""'), (4, "C"), (5, "D")]
    rejected = targets.rejected_targets(lines.read_lines(spark, path)).collect()
    assert [r["line"] for r in rejected] == ["broken"]


def test_staged(spark, tmp_path):
    text = (
        "{| class=x\n1\t A \t Species of alga \tw\tl\n \t \n2\tB\t*** : x\t\t\n"
        "3\tC\td\tw\tlead {| t\n4\tD\td\n|}\nshort\tline\n"
    )
    path = write(tmp_path, "s.tsv", text)
    got = [tuple(r) for r in staged.scan_staged(spark, path).orderBy("seq").collect()]
    assert got == [(1, "A", "Species of alga"), (3, "B", "*** : x"), (5, "D", "d")]


def test_parts_of_many_digits_keep_their_order(spark, tmp_path):
    names = ["part-99998-x", "part-99999-x", "part-100000-x", "part-100001-x"]
    for i, name in enumerate(names):
        path = write(tmp_path, name, f"{i}a\x0c\n{i}b\n")
    rows = lines.read_lines(spark, path).orderBy("line_no").collect()
    assert [r["line"] for r in rows] == [f"{i}{x}" for i in range(4) for x in "ab"]


def test_rejected_lines_of_a_reviewed_file(spark, tmp_path):
    path = write(tmp_path, "s.tsv", "1\tA\tGenus\n2\tB\njunk\n \n{| x\ty\n")
    read = lines.read_lines(spark, path)
    rejected = staged.rejected_staged(read).orderBy("line_no").collect()
    assert [r["line"] for r in rejected] == ["2\tB", "junk"]
    assert staged.parse_staged(read).count() == 1
