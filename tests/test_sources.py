import numpy as np
import pytest

from sphaera.config import Config, Transfer
from sphaera.sources import files, stages, tables

ROWS = [(10000 + 100 * k, 10100 + 100 * k, 10.0 * k, 5.0 * k, 3.0 * k) for k in range(5)]
COLUMNS = ("DefocusU", "DefocusV", "AngleRot", "AngleTilt", "AnglePsi")


def head(*columns):
    return "\nloop_\n" + "".join(f"_rln{c} #{k}\n" for k, c in enumerate(columns, 1))


@pytest.fixture
def folder(tmp_path):
    body = ["\t".join(map(str, r)) for r in ROWS]
    (tmp_path / "old.star").write_text("\ndata_\n" + head(*COLUMNS, "Voltage", "SphericalAberration", "AmplitudeContrast") + "\n".join(f"{b} 300 2.7 0.1" for b in body) + "\n")
    (tmp_path / "new.star").write_text("# v\n\ndata_optics\n" + head("Voltage", "SphericalAberration", "AmplitudeContrast") + "300 2.7 0.1\n\n\ndata_particles\n" + head(*COLUMNS, "ImageName") + "\n".join(f"{b} 1@a.mrcs" for b in body) + "\n")
    (tmp_path / "doc.spi").write_text(" ;ext\n" + "\n".join(f"{k} 5 {r[2]} {r[3]} {r[4]} {r[0]} {r[1]}" for k, r in enumerate(ROWS, 1)) + "\n ;end\n")
    return tmp_path


def test_alignment_layouts_agree(spark, folder):
    old, new = (tables.read_alignment(spark, str(folder / n)).collect() for n in ("old.star", "new.star"))
    assert old == new and len(old) == 5 and [r["img_id"] for r in old] == list(range(5)) and old[2]["df"] == 10250.0
    spi = tables.read_spider_alignment(spark, str(folder / "doc.spi"), 2, 3, 4, [5, 6]).collect()
    assert [tuple(r)[:6] for r in spi] == [tuple(r)[:6] for r in old]


def test_missing_columns_are_named(spark, tmp_path):
    (tmp_path / "bad.star").write_text("\ndata_\n" + head("AngleRot") + "1.0\n")
    with pytest.raises(ValueError, match="rlnDefocusU"):
        tables.read_alignment(spark, str(tmp_path / "bad.star"))


def test_byte_ranges_lose_no_line(folder, monkeypatch):
    path = str(folder / "doc.spi")
    size = files.file_size(path)
    whole = list(files.lines_between(path, 0, size, 0))
    for step in (1, 7, 40):
        assert [x for a in range(0, size, step) for x in files.lines_between(path, a, min(a + step, size), 0)] == whole


def test_stacks(spark, tmp_path):
    img = np.random.default_rng(0).random((7, 6, 6)).astype(np.float32)
    (tmp_path / "s.mrcs").write_bytes(files.mrc_bytes(img))
    img.tofile(tmp_path / "s.raw")
    files.register(spark)
    got = spark.read.format("mrcs").option("per_task", 3).load(str(tmp_path / "s.mrcs")).orderBy("img_id").collect()
    assert np.array_equal(np.array([r["px"] for r in got]).reshape(7, 6, 6), img)
    raw = spark.read.format("mrcs").option("box", files.box_size(str(tmp_path / "s.raw"), 7)).load(str(tmp_path / "s.raw"))
    assert sorted(tuple(r["px"]) for r in raw.collect()) == sorted(tuple(r["px"]) for r in got)
    part = spark.read.format("mrcs").option("first", 2).option("last", 5).load(str(tmp_path / "s.mrcs"))
    assert sorted(r["img_id"] for r in part.collect()) == [2, 3, 4]
    vol = spark.read.format("mrc").load(str(tmp_path / "s.mrcs")).first()
    assert (vol["nx"], vol["ny"], vol["nz"]) == (6, 6, 7) and len(vol["vox"]) == 252


def test_export_of_bins(spark, tmp_path):
    rows = [(i % 2, i, [float(i)] * 36, 1.0, 2.0, 3.0, 300.0) for i in range(7)]
    df = spark.createDataFrame(rows, "bin int, img_id long, px array<double>, phi double, theta double, psi double, voltage double")
    out = tables.export_bins(df, str(tmp_path / "out"), per_file=3).collect()
    assert all(r["n"] <= 3 for r in out) and [sum(r["n"] for r in out if r["bin"] == b) for b in (0, 1)] == [4, 3]
    values = []
    for r in out:
        s = spark.read.format("mrcs").load(str(tmp_path / "out" / r["file"])).collect()
        star = spark.read.format("star").load(str(tmp_path / "out" / r["file"].replace(".mrcs", ".star"))).collect()
        assert len(s) == len(star) == r["n"]
        values += [-x["px"][0] for x in s]
    assert sorted(values) == list(map(float, range(7)))


def test_line_writers(spark):
    assert [r[0] for r in tables.spider_lines(spark.createDataFrame([(1, 20)], "key long, value long")).collect()] == ["    1  1    20"]
    assert [r[0] for r in tables.spectrum_lines(spark.createDataFrame([([1.0, 0.5, 0.25],)], "values array<double>")).collect()] == ["1\t0.50000", "2\t0.25000"]


def test_config_round_trip(tmp_path):
    c = Config(filter_kind=Transfer.GAUSS, low=20)
    c.save(tmp_path / "c.json")
    assert Config.load(tmp_path / "c.json") == c and c.con_order(44) == 1


def test_tables_beyond_the_first_megabyte(spark, tmp_path):
    """A long first table, a late second one, and rows of another width."""
    body = ["300 2.7 0.1"] * 120_000
    (tmp_path / "long.star").write_text("data_optics\n" + head("Voltage", "SphericalAberration", "AmplitudeContrast") + "\n".join(body) + "\n\n\ndata_particles\n" + head("AngleRot", "ImageName") + "1.5 1@a\n2.5 2@a\n")
    blocks = files.star_blocks(str(tmp_path / "long.star"))
    assert [(b.name, len(b.columns)) for b in blocks] == [("optics", 3), ("particles", 2)] and (tmp_path / "long.star").stat().st_size > 1 << 20
    files.register(spark)
    read = lambda **o: spark.read.format("star").options(**o).load(str(tmp_path / "long.star"))
    assert read(block="optics").count() == 120_000 and [r["rlnAngleRot"] for r in read().collect()] == [1.5, 2.5]
    (tmp_path / "short.star").write_text("data_\n" + head("AngleRot", "ImageName") + "1.5 1@a\n2.5\n")
    with pytest.raises(Exception, match="a row of 1 values"):
        spark.read.format("star").load(str(tmp_path / "short.star")).collect()


def test_folders_and_vectors(spark, tmp_path):
    for k in (0, 1):
        (tmp_path / f"d{k}.spi").write_text(f" ;ext\n{k} 1 {k}.5\n")
    (tmp_path / ".hidden").write_text("9 1 9\n")
    files.register(spark)
    assert [r["cols"] for r in spark.read.format("spider").load(str(tmp_path)).collect()] == [[0.0, 0.5], [1.0, 1.5]]
    np.arange(10, dtype="<i4").tofile(tmp_path / "v.raw")
    out = stages.read_vector(spark, str(tmp_path / "v.raw"), "int32", per_task=3).orderBy("pos").collect()
    assert [tuple(r) for r in out] == [(k, float(k)) for k in range(10)]
