import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException

from cootide import cli
from cootide.core import SparseTensor, TensorError, affine_factor
from cootide.plans import form_queries
from cootide.sources import binary, matrices, text
from cootide.streaming import append
from tests.tensors import SMALL, SMALL4, rows, tensor


def cells(x):
    return rows(x.df)


def small_rows(c):
    return sorted((*k, float(v)) for k, v in c.items())


def test_text_base_per_mode(spark, tmp_path):
    p = tmp_path / "a.tns"
    p.write_text("# head\n\n" + "".join(f"{a + 1}\t{b + 1}  {c + 1} {d} {v}.0 \r\n" for (a, b, c, d), v in SMALL4.items()))
    x = text.read(spark, str(p))
    assert x.dims == [2, 2, 3, 3] and cells(x) == small_rows(SMALL4)


def test_text_round_trip_keeps_all_digits(spark, tmp_path):
    x = tensor(spark, {(0, 1): 0.1 + 0.2, (4, 0): -1e-300, (2, 2): 12345678901.5})
    for n, single in enumerate((True, False)):
        p = str(tmp_path / f"b{n}.tns")
        text.write_text(x, p, single_file=single)
        assert cells(text.read_text(spark, p)) == cells(x)
    assert (tmp_path / "b0.tns").read_text().splitlines()[0] == "1 2 0.30000000000000004"
    assert rows(text.text_lines(x, six_decimals=True))[0] == ("1 2 0.300000",)


def test_text_errors(spark, tmp_path):
    for name, content in (("empty.tns", "# nothing\n"), ("wide.tns", "1 " * 9 + "1\n"), ("neg.tns", "-1 1 2.0\n")):
        (tmp_path / name).write_text(content)
        with pytest.raises(TensorError):
            text.read_text(spark, str(tmp_path / name))
    for name, content in (("ragged.tns", "1 1 1.0\n1 1 1 1.0\n"), ("words.tns", "1 1 1.0\n1 x 1.0\n")):
        (tmp_path / name).write_text(content)
        with pytest.raises(PySparkException, match="no nonzero"):
            text.read_text(spark, str(tmp_path / name))
    good, bad = text.read_lenient(spark, str(tmp_path / "ragged.tns"), 2, [1, 1])
    assert cells(good) == [(0, 0, 1.0)] and rows(bad, "reason") == [("columns",)]
    assert text.format_of("x.bin") == "binary" and text.format_of("x.coo") == text.format_of("x.odd") == "text"


def test_binary(spark, tmp_path):
    p = str(tmp_path / "c.bin")
    for values, width in ((SMALL, 4), ({(0, 0): 0.1, (1, 1): 2.0}, 8)):
        x = tensor(spark, values)
        text.write(x, p)
        h = binary.read_header(p)
        assert (h.index_bytes, h.value_bytes, h.dims, h.nnz) == (4, width, x.dims, len(values))
        assert cells(binary.read_binary(spark, p, nonzeros_per_task=2)) == cells(x)
    with open(p, "rb") as f:
        head = f.read(20)
    assert struct.unpack("=iQQ", head) == (0, 4, 8)
    (tmp_path / "d.bin").write_bytes(b"\1\0\0\0" + head[4:] + b"\0" * 40)
    (tmp_path / "e.bin").write_bytes(open(p, "rb").read()[:-1])
    for name in ("d.bin", "e.bin"):
        with pytest.raises(TensorError):
            binary.read_header(str(tmp_path / name))


def test_matrix_vector_parts(spark, tmp_path):
    p = str(tmp_path / "m.mat")
    matrices.write_matrix(affine_factor(spark, 3, 0, 2), p, 4, 2)
    lines = open(p).read().splitlines()
    assert lines[0] == "-5.00000000e+00 +0.00000000e+00 " and len(lines) == 4 and lines[3].startswith("+0.0")
    assert [r["row"] for r in matrices.read_matrix(spark, p).orderBy("i").collect()][1] == [2.0, -4.0]
    matrices.write_vector(spark, [1.5, 2], str(tmp_path / "l.mat"))
    assert (tmp_path / "l.mat").read_text() == "1.500000e+00\n2.000000e+00\n"
    (tmp_path / "p").write_text("1\n0\n1\n")
    assert rows(matrices.read_parts(spark, str(tmp_path / "p"))) == [(0, 1), (1, 0), (2, 1)]
    with pytest.raises(TensorError):
        matrices.read_parts(spark, str(tmp_path / "p"), 4)
    matrices.write_csr(tensor(spark, SMALL), 0, str(tmp_path / "s"))
    assert (tmp_path / "s").read_text().splitlines()[0] == "1 3.000000 2 1.000000 4 2.000000 "


def test_sinks_reach_any_file_system(spark, tmp_path):
    x = tensor(spark, SMALL)
    matrices.write_csr(x, 0, f"file://{tmp_path}/a")
    matrices.write_csr(x, 0, f"{tmp_path}/b")
    assert (tmp_path / "a").read_text() == (tmp_path / "b").read_text() != ""
    matrices.write_fiber_matrix(x, 0, f"{tmp_path}/c")
    assert (tmp_path / "c").read_text().splitlines() == ["1 1.000000 2 2.000000 ", "0 3.000000 ", "0 4.000000 2 5.000000 ", "1 6.000000 "]
    assert cli.main(["convert", _saved(x, tmp_path), f"{tmp_path}/d", "-t", "fibmat"]) == 0 and (tmp_path / "d").read_text() == (tmp_path / "c").read_text()
    wide = SparseTensor(x.df, [2, 1 << 40, 1 << 40])
    matrices.write_csr(wide, 0, f"{tmp_path}/e")
    assert (tmp_path / "e").read_text().splitlines()[0] == f"1 3.000000 {1 << 40} 1.000000 {2 << 40} 2.000000 "


def _saved(x, folder):
    text.write_text(x, f"{folder}/x.tns", single_file=True)
    return f"{folder}/x.tns"


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    text.write_text(tensor(spark, SMALL), "s.tns", single_file=True)
    assert cli.main(["check", "s.tns"]) == 0 and "NO ERRORS FOUND." in capsys.readouterr().out
    assert cli.main(["stats", "s.tns"]) == 0 and "DENSITY=5.000000e-01" in capsys.readouterr().out
    assert cli.main(["convert", "s.tns", "s.graph", "-t", "graph"]) == 0
    assert open("s.graph").readline() == "7 15 001\n"
    assert cli.main(["convert", "s.tns", "s.bin", "-t", "bin"]) == 0 and binary.read_header("s.bin").nnz == 6
    assert cli.main(["cpd", "s.bin", "-r", "2", "--init", "affine", "-i", "2"]) == 0
    assert "Final fit: 0.66191" in capsys.readouterr().out and len(open("mode2.mat").read().splitlines()) == 3
    assert cli.main(["reorder", "s.tns", "-t", "graph"]) == 1 and cli.main(["stats", "none.bin"]) == 1


def test_stream_counts_batches_once(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(0, 1, 2.0), (0, 1, 3.0), (1, 0, 1.0), (None, 0, 9.0)], "a int, b int, v double").write.parquet(src)
    for _ in range(2):
        stream = spark.readStream.schema("a int, b int, v double").parquet(src)
        append.append_stream(stream, ["a", "b"], "v", str(tmp_path / "t"), str(tmp_path / "log")).awaitTermination()
        assert cells(append.read_table(spark, str(tmp_path / "t"), 2)) == [(0, 1, 5.0), (1, 0, 1.0)]
    assert np.isfinite(append.read_table(spark, str(tmp_path / "t"), 2).norm())


def test_lines_are_read_and_joined_in_pieces(spark, tmp_path):
    p = tmp_path / "long.txt"
    want = [f"{n} " * (n % 7) for n in range(20_000)]
    p.write_text("\n".join(want) + "\n")
    got = form_queries._lines(spark, str(p))
    assert got.rdd.getNumPartitions() > 1  # no task holds the file
    assert [tuple(r) for r in got.orderBy("line_no").collect()] == list(enumerate(want, 1))


def test_fiber_matrix_lines_cross_batches_and_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        x = tensor(spark, {(i % 50, i % 3, i % 2): float(i) for i in range(150)} | {(i, 1, 1): 1.5 for i in range(200, 260)})
        matrices.write_fiber_matrix(x, 1, p := str(tmp_path / "fibers"))
        matrices.write_csr(SparseTensor.from_dataframe(x.df, ["i0", "i1"], "val", [5000, 3]), 0, q := str(tmp_path / "rows"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    fibers, by_row = {}, {}
    for i0, i1, i2, v in sorted(cells(x)):
        fibers.setdefault((i1, i2), []).append(f"{i0} {v:.6f} ")
        by_row.setdefault(i0, {})[i1] = f"{i1} {v:.6f} "
    assert open(p).read() == "".join("".join(fibers[f]) + "\n" for f in sorted(fibers))
    assert open(q).read() == "".join("".join(w for _, w in sorted(by_row.get(i, {}).items())) + "\n" for i in range(5000))
