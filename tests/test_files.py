"""The FASTQ source and sink, name lists, commands and exit codes."""

import gzip
import random

import pytest
from strandmill.cli import main
from strandmill.sources import fastq, files, text

A = b"@a/1\nAGCT\n+\nFFFF\n"
B = b"@b/1\nTCGA\n+\nFFFF\n"
C = b"@c/1\nGCCA\n+\nFFFF\n"


def rows(df):
    return [tuple(r) for r in df.orderBy("record_no").collect()]


def test_frames(spark, tmp_path):
    p = tmp_path / "x.fq"
    p.write_bytes(b"@a\r\nA\rC\r\n+\n\xe9\n\n\n\n\n")
    assert rows(fastq.read_fastq(spark, str(p))) == [(0, 0, "@a", "A\rC", "+", "\xe9"), (1, 0, "", "", "", "")]
    p.write_bytes(b"")
    assert rows(fastq.read_fastq(spark, str(p))) == []


@pytest.mark.parametrize("data", [A[:-1], A + b"@b\n", A + b"@b\nA\n+\n", b"\n"])
def test_a_cut_record_is_an_error(spark, tmp_path, data):
    p = tmp_path / "x.fq"
    p.write_bytes(data)
    with pytest.raises(Exception, match="unexpected end of file"):
        rows(fastq.read_fastq(spark, str(p)))
    assert len(rows(fastq.read_fastq(spark, str(p), strict=False))) <= 1


def mixed(n):
    rng = random.Random(5)
    end = lambda: rng.choice(["\n", "\r\n"])
    data, want = "", []
    for i in range(n):
        s = "ACGT" * rng.randrange(0, 20)
        q = "@" * len(s)
        data += f"@r{i}{end()}{s}{end()}+{end()}{q}{end()}"
        want.append((i, 0, f"@r{i}", s, "+", q))
    return data.encode(), want


@pytest.mark.parametrize("size", [1, 17, 97, 1000, 1 << 20])
def test_splits_lose_nothing(tmp_path, size):
    data, want = mixed(200)
    p = tmp_path / "x.fq"
    p.write_bytes(data)
    ranges = fastq.ranges_of(str(p), size)
    splits = fastq.plan_splits(str(p), ranges, [fastq.count_feeds(str(p), *r) for r in ranges])
    assert [(n, 0, *(x.decode() for x in lines)) for s in splits for n, lines in fastq.read_split(s)] == want


def test_splits_on_spark(spark, tmp_path):
    data, want = mixed(700)
    p = tmp_path / "x.fq"
    p.write_bytes(data)
    assert rows(fastq.read_fastq(spark, str(p), split_bytes=20_000)) == want
    p.write_bytes(data[:-1])
    with pytest.raises(Exception, match="unexpected end of file"):
        rows(fastq.read_fastq(spark, str(p), split_bytes=20_000))


def test_gzip_by_exact_extension(spark, tmp_path):
    (tmp_path / "x.fq.gz").write_bytes(gzip.compress(A) + gzip.compress(B))
    assert [r[2] for r in rows(fastq.read_fastq(spark, str(tmp_path / "x.fq.gz")))] == ["@a/1", "@b/1"]
    (tmp_path / "x.fq.GZ").write_bytes(A)
    assert len(rows(fastq.read_fastq(spark, str(tmp_path / "x.fq.GZ")))) == 1
    assert [files.is_gzip(x) for x in ("a.gz", "/b/.gz", "a.GZ", "gz", "a.b.gz")] == [True, False, False, False, True]
    assert fastq.count_lines(str(tmp_path / "x.fq.gz")) == 8


def test_writes_one_file_in_order(spark, tmp_path):
    p = tmp_path / "x.fq"
    data = b"".join(b"@r%d/1 x\r\nAC\xe9\n+\nFF\n" % i for i in range(500))
    p.write_bytes(data)
    df = fastq.read_fastq(spark, str(p), split_bytes=3000).repartition(5)
    fastq.write_fastq(df, str(tmp_path / "y.fq"))
    assert (tmp_path / "y.fq").read_bytes() == data.replace(b"\r", b"")
    fastq.write_fastq(df, str(tmp_path / "y.fq.gz"))
    assert gzip.decompress((tmp_path / "y.fq.gz").read_bytes()) == data.replace(b"\r", b"")
    fastq.write_fastq(df.limit(0), str(tmp_path / "y.fq"))
    assert (tmp_path / "y.fq").read_bytes() == b"" and sorted(f.name for f in tmp_path.iterdir()) == ["x.fq", "y.fq", "y.fq.gz"]


def test_name_lists(spark, tmp_path):
    for name in ("n.txt", "n.gz"):
        (tmp_path / name).write_bytes(b"@a\n@b\r\n\n@a\nc\rd")
        assert sorted(r.name for r in text.read_names(spark, str(tmp_path / name)).collect()) == ["", "@a", "@b", "c\rd"]
    (tmp_path / "n.txt").write_bytes(b"\xe9\n")
    with pytest.raises(Exception, match="UTF-8"):
        text.read_names(spark, str(tmp_path / "n.txt")).collect()


@pytest.fixture
def run(spark, tmp_path, capsys):
    def call(*args):
        code = main([str(a) for a in args], spark)
        out = capsys.readouterr()
        return code, out.out, out.err

    for name, data in (("1.fq", A + B + C), ("2.fq", (A + B + C).replace(b"/1", b"/2")), ("short.fq", A + B), ("empty.fq", b""), ("bad.fq", A + b"b\nAX\n+\nFF\n"), ("names", b"b\n")):
        (tmp_path / name).write_bytes(data)
    call.at = lambda name: tmp_path / name
    return call


def test_describe_command(run):
    assert run("describe", run.at("1.fq"))[:2] == (0, "record_count\t3\nmin_sequence_length\t4\nmax_sequence_length\t4\navg_quality_score_per_position\t[37.0, 37.0, 37.0, 37.0]\n")
    assert run("describe", run.at("empty.fq"))[1] == "record_count\t0\nmin_sequence_length\t18446744073709551615\nmax_sequence_length\t0\navg_quality_score_per_position\t[]\n"
    assert run("describe", run.at("none.fq"))[0] == 1


def test_filter_command(run):
    at = run.at
    assert run("filter", "--names", at("names"), "--dsts", at("o1"), "--dsts", at("o2.gz"), at("1.fq"), at("2.fq"))[0] == 0
    assert at("o1").read_bytes() == B and gzip.decompress(at("o2.gz").read_bytes()) == B.replace(b"/1", b"/2")
    assert run("filter", "--sequence-pattern", "^G", "--dsts", at("o1"), at("1.fq"))[0] == 0
    assert at("o1").read_bytes() == C
    assert run("filter", "--dsts", at("o.gz"), at("bad.fq"))[0] == 0
    assert at("o.gz").read_bytes() == at("bad.fq").read_bytes()
    assert run("filter", "--sequence-pattern", "^T", "--dsts", at("p1"), "--dsts", at("p2"), at("short.fq"), at("2.fq"))[0] == 0
    code, _, err = run("filter", "--sequence-pattern", "^T", "--dsts", at("q1"), "--dsts", at("q2"), at("1.fq"), at("short.fq"))
    assert code == 1 and "unexpected end" in err and not at("q1").exists()
    assert run("filter", "--dsts", at("o"))[0] == 1
    with pytest.raises(SystemExit):
        run("filter", "--names", "a", "--sequence-pattern", "b", "--dsts", "o", "i")
    with pytest.raises(SystemExit):
        run("filter", "--sequence-pattern", "(", "--dsts", "o", "i")


def test_lint_command(run):
    at = run.at
    assert run("lint", at("1.fq"), at("2.fq")) == (0, "", "")
    code, _, err = run("lint", at("bad.fq"))
    assert code == 1 and err.splitlines() == [f"{at('bad.fq')}:5:1: [S003] NameValidator: missing @ prefix"]
    code, _, err = run("lint", "--lint-mode", "log", at("bad.fq"))
    assert code == 1 and [x.split("[")[1][:4] for x in err.splitlines()] == ["S003", "S002"]
    assert run("lint", "--disable-validator", "S003", "--disable-validator", "S002", at("bad.fq"))[0] == 0
    code, _, err = run("lint", "--lint-mode", "log", at("1.fq"), at("short.fq"))
    assert code == 1 and "r2-src unexpectedly ended" in err
    assert "r1-src unexpectedly ended" in run("lint", at("short.fq"), at("2.fq"))[2]
    assert run("lint", "--record-definition-separator", "/", at("1.fq"), at("2.fq"))[0] == 0


def test_subsample_command(run):
    at = run.at
    assert run("subsample", "-n", 2, "-s", 1, "--r1-dst", at("o1"), "--r2-dst", at("o2"), at("1.fq"), at("2.fq"))[0] == 0
    one, two = at("o1").read_bytes(), at("o2").read_bytes()
    assert one.count(b"@") == 2 and one.replace(b"/1", b"/2") == two and one in (A + B, A + C, B + C)
    assert run("subsample", "-n", 9, "--r1-dst", at("o1"), at("1.fq"))[0] == 0 and at("o1").read_bytes() == A + B + C
    assert run("subsample", "-n", 0, "--r1-dst", at("o1"), at("1.fq"))[0] == 0 and at("o1").read_bytes() == b""
    assert run("subsample", "-p", 0.5, "-s", 3, "--r1-dst", at("o1"), at("1.fq"))[0] == 0
    for args, said in (
        (("-n", 1, "--r1-dst", at("x"), at("empty.fq")), "invalid uniform range"),
        (("-n", 1, "--r1-dst", at("x"), at("1.fq"), at("2.fq")), "missing pair destination"),
        (("-n", 1, "--r1-dst", at("x"), "--r2-dst", at("y"), at("1.fq")), "missing pair source"),
        (("-p", 0.5, "--r1-dst", at("x"), "--r2-dst", at("y"), at("1.fq"), at("short.fq")), "r2-src unexpectedly ended"),
    ):
        code, _, err = run("subsample", *args)
        assert code == 1 and said in err and not at("x").exists()
    with pytest.raises(SystemExit):
        run("subsample", "-p", "1.0", "--r1-dst", "x", "i")


def test_a_failed_commit_leaves_the_old_file(spark, tmp_path, monkeypatch):
    old = tmp_path / "y.fq"
    old.write_bytes(A)
    names = lambda: sorted(f.name for f in tmp_path.iterdir())
    parts = []
    for i, data in enumerate((B, C)):
        (tmp_path / f"part{i}").write_bytes(data)
        parts.append(fastq.WrittenPart(i, str(tmp_path / f"part{i}"), len(data)))
    (tmp_path / "part1").unlink()
    with pytest.raises(FileNotFoundError):
        fastq.FastqWriter({"path": str(old)}, True).commit(parts)
    assert old.read_bytes() == A and names() == ["part0", "y.fq"]
    (tmp_path / "part1").write_bytes(C)
    fastq.FastqWriter({"path": str(old)}, True).commit(parts[::-1])
    assert old.read_bytes() == B + C and names() == ["y.fq"]
    df = fastq.read_fastq(spark, str(old)).repartition(3)
    monkeypatch.setattr(fastq, "_in_tasks", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        fastq.write_fastq(df.where("record_no = 0"), str(old))
    assert old.read_bytes() == B + C and names() == ["y.fq"]


def test_writes_where_places_cannot_be_chosen(spark, tmp_path, monkeypatch):
    df = fastq.read_fastq(spark, str(_file(tmp_path, "x.fq", A + B + C)))
    monkeypatch.setattr(files, "is_local", lambda path: False)
    fastq.write_fastq(df.repartition(2), str(tmp_path / "y.fq"))
    assert (tmp_path / "y.fq").read_bytes() == A + B + C and sorted(f.name for f in tmp_path.iterdir()) == ["x.fq", "y.fq"]


def _file(folder, name, data):
    (folder / name).write_bytes(data)
    return folder / name


def test_parts_in_order(spark, tmp_path):
    data, want = mixed(300)
    df = fastq.read_fastq(spark, str(_file(tmp_path, "x.fq", data)))
    for compressed in (False, True):
        parts = fastq.write_parts(df.repartition(4), str(tmp_path / f"parts{compressed}"), compressed)
        read = gzip.decompress if compressed else bytes
        from pathlib import Path

        assert b"".join(read(Path(p).read_bytes()) for p, _ in parts) == data.replace(b"\r", b"") and all(Path(p).stat().st_size == n for p, n in parts)


def test_loaded_by_the_name_of_the_format(spark, tmp_path):
    data, want = mixed(300)
    fastq.register(spark)
    assert rows(spark.read.format("fastq").option("splitBytes", 5000).load(str(_file(tmp_path, "x.fq", data)))) == want


def test_lint_tells_its_totals(run, caplog):
    with caplog.at_level("INFO", "strandmill"):
        run("--verbose", "lint", "--lint-mode", "log", run.at("bad.fq"))
        run("lint", run.at("1.fq"), run.at("2.fq"))
    assert [r.getMessage() for r in caplog.records if "record_count" in r.getMessage()] == [
        "validate_single pass 1: record_count=2 failure_count=2", "validate_pair pass 1: record_count=3 failure_count=0", "validate_pair pass 2: record_count=3 failure_count=0",
    ]
