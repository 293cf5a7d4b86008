import numpy as np
import pytest

from edgeloom.operators import hash_masters, normalize, replicas
from edgeloom.sources import parse_adjacency, parse_edges, partition_records, read_binary_edges, read_degrees, read_graph, read_partition_file, read_partition_records, write_binary_edges, write_edge_list, write_partition_file, write_partition_records
from edgeloom.sources.binary import decode_edges, encode_edges, escape, read_binary_file, unescape


def lines(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "line_no long, value string")


def pairs(df):
    return [(r.src, r.dst) for r in df.orderBy("line_no").collect()]


def test_edge_lines(spark):
    got = parse_edges(lines(spark, "# x", "% x", "1,2", "1\t2", "  1  2", "1 2 0.5", "7 7", "a 2", "-1 2", "3 4\r"))
    assert pairs(got) == [(1, 2)] * 4 + [(0, 2), (4294967295, 2), (3, 4)]


@pytest.mark.parametrize("bad", ["5", "", " "])
def test_short_edge_lines_raise(spark, bad):
    with pytest.raises(Exception, match="two vertices"):
        parse_edges(lines(spark, bad)).collect()


@pytest.mark.parametrize("bad", ["a 2", "1 -2", "1 4294967296"])
def test_strict_names(spark, bad):
    with pytest.raises(Exception, match="not a vertex name"):
        parse_edges(lines(spark, bad), strict=True).collect()


def test_adjacency_lines(spark):
    got = parse_adjacency(lines(spark, "# x", "1 3 2 3 4", "9", "1 2 1 2"))
    assert pairs(got) == [(1, 2), (1, 3), (1, 4), (1, 2)]


@pytest.mark.parametrize("bad", ["1 3 2 3", "", "1 0 2"])
def test_adjacency_mismatch_raises(spark, bad):
    with pytest.raises(Exception, match="don't match"):
        parse_adjacency(lines(spark, bad)).collect()


def test_files_keep_their_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("# c\n" + "".join(f"{i} {i + 1}\n" for i in range(500)))
    (tmp_path / "in" / "b.txt").write_text("9000 1\n7 7\n5 9000\n")
    raw = read_graph(spark, str(tmp_path / "in"))
    assert pairs(raw) == [(i, i + 1) for i in range(500)] + [(9000, 1), (5, 9000)]
    write_edge_list(raw, str(tmp_path / "out"))
    assert pairs(read_graph(spark, str(tmp_path / "out"))) == pairs(raw)
    raw.write.parquet(str(tmp_path / "p"))
    assert pairs(read_graph(spark, str(tmp_path / "p"), "parquet")) == pairs(raw)


@pytest.mark.parametrize(("path", "kind"), [("", "edgelist"), ("x", "nonsense")])
def test_bad_arguments(spark, path, kind):
    with pytest.raises(ValueError):
        read_graph(spark, path, kind)


def test_binary_edges(spark, tmp_path):
    graph = normalize(parse_edges(lines(spark, *[f"{i} {i * 7 % 50}" for i in range(1, 200)])))
    want = sorted((r.u, r.v) for r in graph.edges.collect())
    assert sorted((r.u, r.v) for r in read_binary_edges(write_binary_edges(graph.edges, graph.n_vertices)).collect()) == want
    u, v = np.array([0, 10, 255]), np.array([1, 2, 3])
    (tmp_path / "f.binedgelist").write_bytes(encode_edges(u, v, 256))
    assert [(r.eid, r.u, r.v) for r in read_binary_file(spark, str(tmp_path / "f.binedgelist")).orderBy("eid").collect()] == [(0, 0, 1), (1, 10, 2), (2, 255, 3)]
    (tmp_path / "degrees").mkdir()
    (tmp_path / "degrees" / "a").write_bytes(np.array([4, 5, 2], "<u4").tobytes())
    (tmp_path / "degrees" / "b").write_bytes(np.array([7], "<u4").tobytes())
    assert [(r.vid, r.degree) for r in read_degrees(spark, str(tmp_path / "degrees")).orderBy("vid").collect()] == [(0, 4), (1, 5), (2, 2), (3, 7)]
    with pytest.raises(ValueError, match="bytes"):
        decode_edges(encode_edges(u, v, 256)[:-1])


def test_partition_records(spark):
    a = spark.createDataFrame([(0, 10, 255, 10), (1, 2570, 65535, 0), (2, 255, 256, 255)], "eid long, u long, v long, bucket int")
    m = hash_masters(replicas(a), 0)
    records = write_partition_records(a, m)
    assert all(r.record.count(b"\n") == 1 and r.record.endswith(b"\n") for r in records.collect())
    back = read_partition_records(records).collect()
    assert sorted((r.u, r.v, r.bucket) for r in back if r.tag == 1) == sorted((r.u, r.v, r.bucket) for r in a.collect())
    assert sorted((r.u, r.bucket) for r in back if r.tag == 0) == sorted((r.vid, r.bucket) for r in m.collect())


def test_partition_file(spark, tmp_path):
    a = spark.createDataFrame([(i, i * 2570 % 70000, i * 13 % 4099, (10, 255, 3333, 2570)[i % 4]) for i in range(500)], "eid long, u long, v long, bucket int")
    write_partition_file(partition_records(a, hash_masters(replicas(a), 0)), str(tmp_path / "f"))
    back = read_partition_file(spark, str(tmp_path / "f")).collect()
    assert sorted((r.u, r.v, r.bucket) for r in back if r.tag == 1) == sorted((r.u, r.v, r.bucket) for r in a.collect())
    raw = b"".join(f.read_bytes() for f in (tmp_path / "f").glob("part-*"))
    assert raw.count(b"\n") == len(back)
    assert raw.endswith(b"\n")


def test_escape():
    for data in (b"\n", b"\xff", b"\xff\n\xff\x00\xff\x01", bytes(range(256))):
        assert b"\n" not in escape(data)
        assert unescape(escape(data)) == data
