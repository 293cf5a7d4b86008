import pytest

from edgeloom.__main__ import main
from edgeloom.sources import read_partition_records

TEXT = "# tiny\n10\t20\n20,30\n30 10 99\n10 10\n40 20\n20 10\n50 40\n60 50\n10 20\n"


def test_partition(spark, tmp_path, capsys):
    (tmp_path / "g.txt").write_text(TEXT)
    row = main(["partition", "--filename", str(tmp_path / "g.txt"), "--method", "dbh", "--p", "3", "--output", str(tmp_path / "out")])
    assert (row["replication_factor"], row["balance"], row["bucket_sizes"], row["expected_edges"]) == (1.666667, 1.5, [4, 1, 3], 2)
    assert "replication_factor: 1.666667" in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "out/vertices")).count() == 6
    assert read_partition_records(spark.read.parquet(str(tmp_path / "out/records"))).where("tag = 1").count() == 8


def test_convert(spark, tmp_path):
    (tmp_path / "g.adj").write_text("1 2 2 1\n5\n7 2 1 7\n")
    main(["convert", "--filename", str(tmp_path / "g.adj"), "--filetype", "adjlist", "--output", str(tmp_path / "edges")])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "edges")).collect()) == ["1 2", "7 1"]


@pytest.mark.parametrize("bad", [["partition"], ["partition", "--filename", "x", "--method", "metric"], ["other"]])
def test_bad_arguments(bad):
    with pytest.raises(SystemExit):
        main(bad)
