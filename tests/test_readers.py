"""Large CSV files are read by many tasks, whatever their quoted fields hold."""

import csv
import random

from leadloom import fixed
from leadloom.sources import readers


def test_one_file_by_many_tasks(spark, tmp_path):
    rnd = random.Random(4)
    names = fixed.REQUIRED["leads"]
    field = lambda: rnd.choice(["x", "a,b", 'say "hi"', "two\nlines", "\n\n", "é", '"', "" , "long " * rnd.randint(1, 60), 'q"\n"q,\n'])
    rows = {f: [[f"{f}{i}", *(field() for _ in names[1:])] for i in range(400)] for f in ("a", "b")}
    rows["a"][200][3] = "\n".join(f"line {k}, with \"\" quotes" for k in range(300))  # a record longer than several splits
    for f, data in rows.items():
        with open(tmp_path / f"{f}.csv", "w", newline="", encoding="utf-8") as file:
            csv.writer(file, lineterminator="\n").writerows([names, *data])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "4096")
    try:
        assert readers.csv_records(spark, str(tmp_path)).select("archivo").distinct().count() == 2
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = sorted(tuple(r) for r in readers.read_csv(spark, str(tmp_path), "leads").select(*names).collect())
    finally:
        for key, value in zip(("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"), before):
            spark.conf.set(key, value)
    want = sorted(tuple(v if v.strip() else None for v in r) for data in rows.values() for r in data)
    assert got == want


def test_pieces_of_few_lines(spark, tmp_path, monkeypatch):
    """A split is sorted by blocks of lines: records and the header are the same whatever the size of a block."""
    monkeypatch.setattr(readers, "_BLOCK_BITS", 2)
    names = fixed.REQUIRED["leads"]
    rows = [[f"{i}", *(f"{n}\nline {i}\n\n,\"end\"" if (i + k) % 5 == 0 else f"{n}{i}" for k, n in enumerate(names[1:]))] for i in range(60)]
    for f in range(2):
        with open(tmp_path / f"{f}.csv", "w", newline="", encoding="utf-8") as file:
            csv.writer(file, lineterminator="\n").writerows([names, *rows])
    assert readers.csv_records(spark, str(tmp_path)).filter("cabecera").count() == 2
    got = sorted(tuple(r) for r in readers.read_csv(spark, str(tmp_path), "leads").select(*names).collect())
    assert got == sorted(2 * [tuple(r) for r in rows])
