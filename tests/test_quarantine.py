"""CSV reading with a reject table: every record is good or rejected, with file, row and column."""

import gzip
import os

import pytest

from washkit.sources import quarantine as Q

SCHEMA = "zone string, year int, pct double"


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_good_and_rejected_are_all_records(spark, tmp_path):
    a = write(tmp_path / "a.csv", "zone,year,pct\nKawale,2020,1.5\nArea 25,20x0,2.5\nB, 2021 ,\nC,2022,n/a\n\"D, E\",2023,07.06\n")
    b = write(tmp_path / "b.csv", "pct,extra,zone\n3.5,q,F\nbad,q,G\n4.5,q\n")
    good, rejected = Q.read_csv_quarantined(spark, [a, b, str(tmp_path / "none.csv")], SCHEMA)
    assert {tuple(r) for r in good.collect()} == {("Kawale", 2020, 1.5), ("B", 2021, None), ("D, E", 2023, 7.06), ("F", None, 3.5)}
    got = {(os.path.basename(r.file), r.row): (r.record, [tuple(p) for p in r.problems]) for r in rejected.collect()}
    assert got == {
        ("a.csv", 2): ("Area 25,20x0,2.5", [("year", "20x0", "int")]), ("a.csv", 4): ("C,2022,n/a", [("pct", "n/a", "double")]),
        ("b.csv", 2): ("bad,q,G", [("pct", "bad", "double")]), ("b.csv", 3): ("4.5,q", [(None, None, "3 fields")]),
        ("none.csv", None): (None, [(None, None, "a readable path")]),
    }
    assert good.count() + rejected.where("row IS NOT NULL").count() == 8


def test_required_columns(spark, tmp_path):
    a = write(tmp_path / "a.csv", "zone,year\n,2020\nx,\ny,1\n")
    good, rejected = Q.read_csv_quarantined(spark, a, SCHEMA, required=["zone", "year"])
    assert [tuple(r) for r in good.collect()] == [("y", 1, None)]
    assert sorted((r.row, r.problems[0].column, r.problems[0].expected) for r in rejected.collect()) == [(1, "zone", "a value"), (2, "year", "a value")]
    with pytest.raises(ValueError):
        Q.read_csv_quarantined(spark, a, "other int")


def test_rows_are_numbered_across_the_blocks_of_a_file(spark, tmp_path):
    os.mkdir(tmp_path / "many")
    for k in range(3):
        write(tmp_path / "many" / f"{k}.csv", "zone,year,pct\n" + "".join(f"zone {k} {i},{'x' if i % 997 == 0 else 2000},{i}.5\n" for i in range(1, 5001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        good, rejected = Q.read_csv_quarantined(spark, str(tmp_path / "many"), SCHEMA)
        assert good.count() == 3 * 4995
        assert good.rdd.getNumPartitions() > 5
        got = rejected.collect()
        assert {(os.path.basename(r.file)[0], r.row) for r in got} == {(str(k), i) for k in range(3) for i in range(997, 5001, 997)}
        assert all(r.record.startswith(f"zone {os.path.basename(r.file)[0]} {r.row},x,") for r in got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_file_report(spark, tmp_path):
    os.mkdir(tmp_path / "in")
    write(tmp_path / "in" / "good.csv", "zone,year,pct\na,1,2\n")
    write(tmp_path / "in" / "bad.csv", "zone,year,pct\na,?,2\nb,1,1\n")
    write(tmp_path / "in" / "header.csv", "zone,year,pct\n")
    whole = gzip.compress(("zone,year,pct\n" + "".join(f"z{i},1,{i * 37 % 1000}.25\n" for i in range(20000))).encode())
    (tmp_path / "in" / "broken.csv.gz").write_bytes(b"\x1f\x8b" + b"no gzip at all" * 20)
    (tmp_path / "in" / "cut.csv.gz").write_bytes(whole[: len(whole) // 2])
    files = Q.read_files(spark, [str(tmp_path / "in"), str(tmp_path / "away")], SCHEMA)
    got = {os.path.basename(r.file): r for r in files.collect()}
    assert {k: r.status for k, r in got.items() if k != "cut.csv.gz"} == {"good.csv": "good", "bad.csv": "rejects", "header.csv": "no rows", "broken.csv.gz": "no rows", "away": "absent"}
    assert (got["bad.csv"].rows, got["bad.csv"].rejected, got["good.csv"].rows) == (2, 1, 1)
    good, rejected = Q.read_csv_quarantined(spark, str(tmp_path / "in"), SCHEMA)
    assert good.count() + rejected.count() == sum(r.rows for r in got.values())


def test_nothing_to_read(spark, tmp_path):
    good, rejected = Q.read_csv_quarantined(spark, str(tmp_path / "x.csv"), SCHEMA)
    assert good.collect() == [] and good.columns == ["zone", "year", "pct"] and rejected.count() == 1
