"""CSV files cut into blocks: the same rows and numbers as one task reading the file."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from paraspark.sources import readers as IO
from paraspark.sources.csv_split import open_after, read_csv_split

CELLS = ["", "plain", "a,b", 'q"uo"te', "line\nbreak", "crlf\r\nin", '""', '"', "é😀", "\n\n", "x" * 900 + "\n" + "y" * 900, " pad ", "tail\n"]


@pytest.fixture()
def small_blocks(spark):
    """Files are cut every 1500 bytes or so."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("1500", "0")):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def write(path, rows, newline="\n", header=("one", "two words", "three"), bom=False):
    with open(path, "w", newline="", encoding="utf-8-sig" if bom else "utf-8") as f:
        w = csv.writer(f, lineterminator=newline)
        w.writerow(header)
        w.writerows(rows)


def read(spark, path):
    return [tuple(x or "" for x in r[:3]) + (r[3],) for r in read_csv_split(spark, path, "at").orderBy("at").collect()]


@pytest.mark.parametrize("newline, bom", [("\n", True), ("\r\n", False)])
def test_same_rows_and_numbers_as_the_csv_module(spark, small_blocks, tmp_out, newline, bom):
    rng = random.Random(4)
    rows = [[rng.choice(CELLS) for _ in range(3)] for _ in range(90)]
    write(f"{tmp_out}/t.csv", rows, newline, header=('"one"', "two words", "three"), bom=bom)
    blocks = spark.read.text(f"{tmp_out}/t.csv").select("_metadata.file_block_start").distinct().count()
    assert blocks > 15
    assert read(spark, f"{tmp_out}/t.csv") == [(*r, k) for k, r in enumerate(rows)]


def test_a_record_longer_than_many_blocks(spark, small_blocks, tmp_out):
    long = "\n".join(f"{k}, \"x\"" for k in range(400))
    rows = [["a", "b", "c"], [long, "d", long], ["e", "", long], ["f", "g", "h"]]
    write(f"{tmp_out}/t.csv", rows)
    assert read(spark, f"{tmp_out}/t.csv") == [(*r, k) for k, r in enumerate(rows)]


def test_several_files_blank_lines_and_an_open_end(spark, small_blocks, tmp_out):
    write(f"{tmp_out}/a.csv", [["1", "2\n\n2", "3"]] * 60)
    with open(f"{tmp_out}/b.csv", "w", newline="") as f:
        f.write('one,two words,three\n\nx,y\n\r\n1,2,3,4\nends,"open\n and goes on\n')
    write(f"{tmp_out}/c.csv", [])
    got = read(spark, tmp_out)
    assert [r[3] for r in got] == list(range(63))
    assert got[60:] == [("x", "y", "", 60), ("1", "2", "3", 61), ("ends", got[62][1], "", 62)]
    assert got[62][1].startswith("open\n and goes on") or got[62][1].startswith('"open\n and goes on')


def test_header_only_and_empty_files(spark, tmp_out):
    write(f"{tmp_out}/h.csv", [])
    assert read_csv_split(spark, f"{tmp_out}/h.csv", "at").count() == 0
    open(f"{tmp_out}/e.csv", "w").close()
    assert read_csv_split(spark, f"{tmp_out}/e.csv").count() == 0


def test_state_of_a_line_matches_the_csv_module():
    rng = random.Random(9)
    for _ in range(20_000):
        line = "".join(rng.choice('",ab ') for _ in range(rng.randint(0, 9)))
        for opened in (False, True):
            # an open record swallows the next line
            text = ('"' if opened else "") + line + "\nNEXT,x\n"
            assert open_after(line, opened) == ("NEXT" in "".join(next(csv.reader(io.StringIO(text, newline=""))))), (line, opened)


def test_pairs_and_cases_are_read_by_blocks(spark, small_blocks, tmp_out):
    names = ["term", "target_length", "style", "english_scenario", "spanish_translation"]
    rows = [[f"t{k}", str(k), "formal", f"line one\nline \"{k}\"", "x, y"] for k in range(80)]
    write(f"{tmp_out}/pairs.csv", rows, header=names)
    got = IO.read_pairs(spark, f"{tmp_out}/pairs.csv").orderBy("row_number").collect()
    assert [[r[n] for n in names] + [r.row_number] for r in got] == [r + [k + 1] for k, r in enumerate(rows)]
    write(f"{tmp_out}/cases.csv", [["en-es", f"source\n{k}"] for k in range(80)], header=["direction", "source_text"])
    cases = IO.read_cases(spark, f"{tmp_out}/cases.csv").orderBy(F.col("row_index").cast("int")).collect()
    assert [(r.row_index, r.source_text) for r in cases] == [(str(k), f"source\n{k}") for k in range(80)]
