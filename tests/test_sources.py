import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from logsift import CleanOptions, clean, schemas, sinks
from logsift.sources import storage, tables
from logsift.sources.lines import read_lines, text_lines
from logsift.sources.storage import shared_folder

P = "==12345== "


@pytest.fixture(scope="module")
def log_folder(tmp_path_factory):
    rng = random.Random(5)
    folder = tmp_path_factory.mktemp("logs")
    for name, n_lines in (("big", 9000), ("mid", 700), ("tiny", 3), ("empty", 0)):
        lines = []
        for n in range(n_lines):
            if n % 1000 == 999 and n < n_lines - 500:
                lines.append("Successfully downloaded debug")
            kind = rng.randrange(4)
            lines.append([P + f"Invalid read of size {n % 60}", P + f"   at 0x{n:x}: f{n % 7} (a.c:{n})", "", P][kind])
        (folder / f"{name}.log").write_bytes("\n".join(lines).encode() + (b"\n" if n_lines else b""))
    return folder


def _names(df):
    return df.withColumn("log_id", F.regexp_extract("log_id", r"([a-z]+)\.log", 1))


def test_lines_keep_their_order_over_splits(spark, log_folder):
    want = {}
    for file in log_folder.iterdir():
        text = file.read_bytes().decode()
        want[file.stem] = text.split("\n")[:-1]
    want.pop("empty")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("3000", "20000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            lines = _names(read_lines(spark, str(log_folder)))
            got = {}
            for r in sorted(lines.collect(), key=lambda r: (r["log_id"], r["line_no"])):
                got.setdefault(r["log_id"], []).append((r["line_no"], r["value"]))
            assert {k: [v for _, v in rows] for k, rows in got.items()} == want
            assert all(len({n for n, _ in rows}) == len(rows) for rows in got.values())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_order_holds_however_splits_are_packed(spark, tmp_path):
    """Full splits that share tasks, and passes with another parallelism."""
    text = [f"line {n} with some thirty bytes" for n in range(12_000)]
    (tmp_path / "big.log").write_text("\n".join(text) + "\n")
    names = ("maxPartitionBytes", "maxPartitionNum", "minPartitionNum")
    before = {n: spark.conf.get(f"spark.sql.files.{n}", None) for n in names}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.maxPartitionNum", "2")
        rows = read_lines(spark, str(tmp_path)).collect()
        assert [r["value"] for r in sorted(rows, key=lambda r: r["line_no"])] == text
        assert len({r["line_no"] for r in rows}) == len(text)
        spark.conf.unset("spark.sql.files.maxPartitionNum")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")
        lines = read_lines(spark, str(tmp_path))
        first = sorted(map(tuple, lines.collect()))
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
        assert sorted(map(tuple, read_lines(spark, str(tmp_path)).collect())) == first
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        for name, value in before.items():
            key = f"spark.sql.files.{name}"
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_many_splits_clean_like_one(spark, log_folder):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    results = []
    try:
        for size, bits in (("2000", 6), ("128m", 18)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            lines = read_lines(spark, str(log_folder))
            blocks = clean(lines, CleanOptions(depth=2, chunk_bits=bits))
            results.append(sorted((r["log_id"], r["block_no"], r["block_text"], r["repeats"]) for r in blocks.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert results[0] == results[1]
    assert results[0]


def test_line_ends_and_broken_utf8(spark, tmp_path):
    file = tmp_path / "x.log"
    file.write_bytes(b"==12== Invalid read\r\n==12==  at 0x1: a\rb\n==12== bad \xff\xfe bytes\n==12== nul \x00 x\n")
    lines = read_lines(spark, str(file))
    assert lines.count() == 4
    got = clean(lines, CleanOptions(trim=False, depth=0)).first()
    shown = got["block_text"].split("\n")
    assert shown[:2] == ["Invalid read\r", "a\rb"]
    assert shown[3] == "nul \x00 x"
    assert got["sig_key"].split("\n")[:2] == ["Invalid read", "at 0xADDR: a b"]


def test_text_lines(spark):
    rows = spark.createDataFrame([(1, "a\n\nb\n"), (2, ""), (3, "x"), (4, "\n")], "id long, t string")
    got = sorted(map(tuple, text_lines(rows, "id", "t").collect()))
    assert got == [(1, 0, "a"), (1, 1, ""), (1, 2, "b"), (3, 0, "x"), (4, 0, "")]


def test_tables_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "A", "src/a.c", None, "1", "-")], schemas.FILE_CHANGES)
    for kind in ("parquet", "orc", "json", "csv"):
        rows.write.format(kind).save(str(tmp_path / kind))
        assert tables.file_changes(spark, str(tmp_path / kind), kind).collect() == rows.collect()
    with pytest.raises(ValueError):
        tables.read_table(spark, "x", schemas.TAGS, "xml")
    assert tables.empty(spark, schemas.TAGS).count() == 0


def test_block_text_sink(spark, tmp_path, log_folder):
    blocks = clean(read_lines(spark, str(log_folder / "mid.log")), CleanOptions(trim=False))
    sinks.write_blocks(blocks, str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("part-*.txt"))
    written = "".join(f.read_text() for f in files)
    want = "".join(r["block_text"] + "\n\n" for r in blocks.orderBy("block_no").collect())
    assert written == want


def test_reports(spark, tmp_path):
    report = spark.createDataFrame([("r1", 3, True, None), ("r2", 0, False, 'say "x"\n')], "range_id string, n int, flag boolean, note string")
    kv = sorted(map(tuple, sinks.to_kv_rows(report).collect()), key=str)
    assert ("r1", "N", "3") in kv and ("r2", "FLAG", "false") in kv and len(kv) == 6
    texts = {r["range_id"]: r["json"] for r in sinks.to_json_rows(report).collect()}
    assert texts["r2"] == '{"n":0,"flag":false,"note":"say \\"x\\"\\n"}'
    sinks.write_kv(report.drop("note"), str(tmp_path / "kv"))
    lines = "".join(f.read_text() for f in (tmp_path / "kv").glob("part-*")).splitlines()
    assert [x for x in sorted(lines) if x.startswith("r1\t")] == ["r1\tFLAG=true", "r1\tN=3"]
    sinks.write_json(report, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_shared_folder_is_the_cluster_s(spark):
    assert storage.shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert storage.fresh_folder(spark, "x").startswith(storage.shared_folder(spark))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_its_folder(master):
    """Executors would not see a folder of the driver's own machine."""
    conf = SimpleNamespace(get=lambda *_: None)
    context = SimpleNamespace(master=master, getConf=lambda: conf, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=context, conf=conf))
