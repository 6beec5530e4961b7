import json
import sys

import pytest
from pyspark.sql import functions as F

from turnweave import cli
from turnweave.plans import batch
from turnweave.plans.transcripts import plain
from turnweave.sources import documents
from turnweave.sources.backends import ExternalTool, JsonFolder, find_tool
from turnweave.sources.sinks import write_files, write_single

GOOD = {"segments": [{"start": 0, "end": 15.5, "text": " one\n", "id": 3}, {"start": 15.5, "end": 17, "text": "two"}], "language": "ko"}
TURNS = {"segments": [{"start": 0, "end": 16, "speaker": "SPEAKER_01", "text": "x"}, {"start": 16, "end": 20}]}


def raw(spark, *docs):
    return spark.createDataFrame([(f"r{n}", d if isinstance(d, str) else json.dumps(d)) for n, d in enumerate(docs)], "rec string, json string")


def test_segments_keep_order(spark):
    rows = documents.segments(raw(spark, GOOD)).collect()
    assert [(r.pos, r.start, r.end, r.text) for r in rows] == [(0, 0.0, 15.5, " one\n"), (1, 15.5, 17.0, "two")]


def test_turns_default(spark):
    rows = documents.turns(raw(spark, TURNS, {}, {"segments": None}, {"segments": []})).collect()
    assert [(r.rec, r.speaker) for r in rows] == [("r0", "SPEAKER_01"), ("r0", "UNKNOWN")]


@pytest.mark.parametrize("lost", ["start", "end", "text"])
def test_incomplete_segment_fails_even_if_unused(spark, lost):
    bad = {"segments": [{k: v for k, v in GOOD["segments"][0].items() if k != lost}]}
    with pytest.raises(Exception, match="lacks"):
        plain(documents.segments(raw(spark, bad))).collect()


@pytest.mark.parametrize("bad", ["{}", '{"segments": null}', '{"segments": [{"start": 0'])
def test_bad_transcription_fails(spark, bad):
    with pytest.raises(Exception):
        documents.segments(raw(spark, bad)).collect()


def test_incomplete_turn_fails(spark):
    with pytest.raises(Exception, match="lacks"):
        documents.turns(raw(spark, {"segments": [{"start": 1, "speaker": "A"}]})).collect()


def test_command_line(spark, tmp_path):
    speech, turns, out = tmp_path / "speech", tmp_path / "turns", tmp_path / "a" / "b"
    for folder, doc in ((speech, GOOD), (turns, TURNS)):
        folder.mkdir()
        (folder / "회의 1+.json").write_text(json.dumps(doc), encoding="utf-8")
    audio = str(tmp_path / "회의 1+.m4a")
    path = cli.main([audio, "--json-dir", str(speech), "-o", str(out)], spark)
    assert open(path, "rb").read() == "00:00 one\n00:15 two\n".encode()
    cli.main([audio, "--diarize", "--json-dir", str(speech), "--turns-dir", str(turns), "-o", str(out)], spark)
    assert open(path, "rb").read() == "[SPEAKER_01] 00:00 one\n[UNKNOWN] 00:15 two\n".encode()
    with pytest.raises(FileNotFoundError):
        cli.main([str(tmp_path / "_hidden.m4a"), "--json-dir", str(speech), "-o", str(out)], spark)
    with pytest.raises(SystemExit):
        cli.main([audio, "--diarize"], spark)


def test_sinks(spark, tmp_path):
    lines = spark.createDataFrame([("a", 1, "second"), ("a", 0, "first\nstill first"), ("b", 0, "x")], "rec string, pos int, line string")
    all_of_them = spark.createDataFrame([("a",), ("b",), ("silent",)], "rec string")
    out = tmp_path / "out"
    write_files(lines, str(out), all_of_them)
    assert {p.name: p.read_bytes() for p in out.iterdir()} == {"a.txt": b"first\nstill first\nsecond\n", "b.txt": b"x\n", "silent.txt": b""}
    # the folder is replaced as a whole, or stays as it was if a task fails
    broken = lines.withColumn("line", F.when(F.col("rec") == "b", F.raise_error(F.lit("broken off"))).otherwise(F.col("line")))
    for bad in (broken, lines.withColumn("rec", F.lit("a/b"))):
        with pytest.raises(Exception):
            write_files(bad, str(out), all_of_them)
        assert sorted(p.name for p in out.iterdir()) == ["a.txt", "b.txt", "silent.txt"] and len(list(tmp_path.iterdir())) == 1
    write_files(lines.where("rec = 'a'"), f"file://{out}")
    assert [p.name for p in out.iterdir()] == ["a.txt"]
    write_files(lines.where("false"), str(out))
    assert list(out.iterdir()) == []
    write_single(lines.where("false"), str(tmp_path / "empty.txt"))
    assert (tmp_path / "empty.txt").read_bytes() == b""


def counting_tool(folder, doc):
    """A tool that leaves ``doc`` and a file per run."""
    runs = folder / "runs"
    runs.mkdir()
    tool = folder / "tool.py"
    tool.write_text(
        f"#!{sys.executable}\nimport sys, os, json, uuid\nstem = os.path.splitext(os.path.basename(sys.argv[-1]))[0]\n"
        f"open(os.path.join({str(runs)!r}, stem + '-' + uuid.uuid4().hex), 'w').close()\njson.dump({doc!r}, open(os.path.join(sys.argv[-2], stem + '.json'), 'w'))\n"
    )
    tool.chmod(0o755)
    return tool, lambda: sorted(p.name.split("-")[0] for p in runs.iterdir())


def test_external_tool(spark, tmp_path):
    tool, _ = counting_tool(tmp_path, GOOD)
    one = spark.createDataFrame([("a", "/x/a.m4a")], "rec string, path string")
    found = ExternalTool(find_tool("nothing", [str(tool)])).documents(spark, one)
    assert documents.segments(found).count() == 2
    with pytest.raises(FileNotFoundError):
        find_tool("no-such-tool-anywhere")


def test_tools_run_once_per_recording(spark, tmp_path, monkeypatch):
    """Checks, sorts and sinks read what the tool left, they do not run it again."""
    for name, doc in (("speech", GOOD), ("speakers", TURNS)):
        (tmp_path / name).mkdir()
    speech, speech_runs = counting_tool(tmp_path / "speech", GOOD)
    speakers, speaker_runs = counting_tool(tmp_path / "speakers", TURNS)
    monkeypatch.setattr(cli, "speech_tool", lambda results: ExternalTool(str(speech), results=results))
    monkeypatch.setattr(cli, "speaker_tool", lambda token, results: ExternalTool(str(speakers), results=results))
    path = cli.main([str(tmp_path / "m.m4a"), "-o", str(tmp_path)], spark)
    assert speech_runs() == ["m"] and open(path).read() == "00:00 one\n00:15 two\n"
    cli.main([str(tmp_path / "m.m4a"), "--diarize", "--hf-token", "t", "-o", str(tmp_path)], spark)
    assert speech_runs() == ["m", "m"] and speaker_runs() == ["m"]
    assert open(path).read() == "[SPEAKER_01] 00:00 one\n[UNKNOWN] 00:15 two\n"
    many = spark.createDataFrame([(f"r{n}", f"/x/r{n}.m4a") for n in range(5)], "rec string, path string")
    batch.transcribe(spark, many, str(tmp_path / "out"), ExternalTool(str(speech)), ExternalTool(str(speakers)))
    assert speech_runs()[2:] == speaker_runs()[1:] == [f"r{n}" for n in range(5)]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"r{n}.txt" for n in range(5)]


def test_progress_of_a_run(spark, tmp_path):
    tool, _ = counting_tool(tmp_path, GOOD)
    slow = tmp_path / "slow.sh"
    slow.write_text(f'#!/bin/sh\nsleep 0.5\nexec "{tool}" "$@"\n')
    slow.chmod(0o755)
    frame = lambda n: spark.createDataFrame([(f"r{i}", f"/x/r{i}.m4a") for i in range(n)], "rec string, path string")
    seen = []
    backend = ExternalTool(str(slow), results=str(tmp_path / "kept"), progress=seen.append, progress_seconds=0.1)
    assert backend.documents(spark, frame(8)).count() == 8
    assert seen == sorted(seen) and seen[-1] == 8 and any(0 < n < 8 for n in seen)
    seen.clear()
    assert backend.documents(spark, frame(10)).count() == 10 and seen[-1] == 2
    seen.clear()
    slow.write_text("#!/bin/sh\nexit 3\n")
    with pytest.raises(Exception):
        backend.documents(spark, frame(11)).count()
    assert seen[-1] == 0


def test_a_run_takes_up_what_a_failed_one_has_done(spark, tmp_path):
    (tmp_path / "s").mkdir()
    tool, runs = counting_tool(tmp_path / "s", GOOD)
    tool.write_text(tool.read_text().replace("json.dump", f"stem == 'r7' and not os.path.exists({str(tmp_path / 'mended')!r}) and sys.exit('broken')\njson.dump", 1))
    recordings = spark.createDataFrame([(f"r{n}", f"/x/r{n}.m4a", 5) for n in range(10)], "rec string, path string, length int").repartition(1)
    keeping = ExternalTool(str(tool), results=str(tmp_path / "kept"))
    with pytest.raises(Exception):
        keeping.documents(spark, recordings)
    first = runs()
    assert first.count("r7") >= 1 and all(first.count(f"r{n}") <= 1 for n in range(10) if n != 7)
    (tmp_path / "mended").touch()
    assert keeping.documents(spark, recordings).count() == 10
    second = runs()
    assert all(second.count(f"r{n}") == 1 for n in range(10) if n != 7) and second.count("r7") == first.count("r7") + 1
    assert keeping.documents(spark, recordings).count() == 10 and runs() == second
    # a recording that has changed, and other options
    assert keeping.documents(spark, recordings.withColumn("length", F.when(F.col("rec") == "r3", 6).otherwise(F.col("length")))).count() == 10
    assert len(runs()) == len(second) + 1 and runs().count("r3") == 2
    assert ExternalTool(str(tool), ("--more",), results=str(tmp_path / "kept")).documents(spark, recordings).count() == 10
    assert len(runs()) == len(second) + 11


def test_recordings_that_only_spark_can_open(spark, tmp_path):
    (tmp_path / "audio").mkdir()
    for name in ("one é", "two"):
        (tmp_path / "audio" / f"{name}.m4a").write_bytes(f"sound of {name}".encode())
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./audio", f"file://{tmp_path}/audio")
    tool = tmp_path / "tool.py"
    tool.write_text(f"#!{sys.executable}\nimport sys, os, json\nstem = os.path.splitext(os.path.basename(sys.argv[-1]))[0]\nheard = open(sys.argv[-1], encoding='utf-8').read()\njson.dump({{'segments': [{{'start': 0, 'end': 1, 'text': heard}}]}}, open(os.path.join(sys.argv[-2], stem + '.json'), 'w'))\n")
    tool.chmod(0o755)
    recordings = documents.recordings(spark, "viewfs://store/audio/*.m4a")
    found = documents.segments(ExternalTool(str(tool)).documents(spark, recordings)).collect()
    assert sorted((r.rec, r.text) for r in found) == [("one é", "sound of one é"), ("two", "sound of two")]


def test_batch_refuses_what_it_cannot_tell_apart(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text(json.dumps(GOOD))
    frame = lambda *rows: spark.createDataFrame(rows, "rec string, path string")
    with pytest.raises(ValueError, match="more than one recording"):
        batch.transcribe(spark, frame(("a", "/x/a.m4a"), ("a", "/y/a.wav")), str(tmp_path / "o"), JsonFolder(str(tmp_path / "j")))
    with pytest.raises(FileNotFoundError, match="b"):
        batch.transcribe(spark, frame(("a", "/x/a.m4a"), ("b", "/x/b.m4a")), str(tmp_path / "o"), JsonFolder(str(tmp_path / "j")))
    assert not (tmp_path / "o").exists()
    silent = spark.createDataFrame([("s", "/x/s.m4a")], "rec string, path string")
    (tmp_path / "j" / "s.json").write_text('{"segments": []}')
    batch.transcribe(spark, silent, str(tmp_path / "o"), JsonFolder(str(tmp_path / "j")))
    assert [(p.name, p.read_bytes()) for p in (tmp_path / "o").iterdir()] == [("s.txt", b"")]


@pytest.mark.parametrize("exact", [False, True])
def test_integrity_is_part_of_the_job(spark, tmp_path, exact):
    """Nothing runs before the lines are asked for, each folder of documents is read once, and any use of them is checked."""
    for folder, doc in (("s", GOOD), ("t", TURNS)):
        (tmp_path / folder).mkdir()
        for rec in "ab":
            (tmp_path / folder / f"{rec}.json").write_text(json.dumps(doc))
    asked = lambda *recs: spark.createDataFrame([(r, f"/x/{r}.m4a") for r in recs], "rec string, path string")
    speech, speakers = JsonFolder(str(tmp_path / "s")), JsonFolder(str(tmp_path / "t"))
    sc, group = spark.sparkContext, f"lines-{exact}"
    sc.setJobGroup(group, "")
    found = batch.lines(spark, asked("a"), speech, exact=exact)
    missing, twice = batch.lines(spark, asked("a", "c"), speech, exact=exact), batch.lines(spark, asked("b", "b"), speech, exact=exact)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert not sc.statusTracker().getJobIdsForGroup(group)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
    assert [r.rec for r in found.collect()] == ["a", "a"]
    assert {r.rec for r in batch.lines(spark, asked("a", "b"), speech, speakers, exact).collect()} == {"a", "b"}
    for lines, kind, told in ((missing, FileNotFoundError, "^no document for c$"), (twice, ValueError, "^more than one recording is named b$")):
        for use in (lambda f: f.collect(), lambda f: f.count(), lambda f: f.select("pos").collect()):
            with pytest.raises(kind, match=told), documents.told_plainly():
                use(lines)
    with pytest.raises(ZeroDivisionError), documents.told_plainly():
        1 / 0
    (tmp_path / "s2").mkdir()
    (tmp_path / "s2" / "a.json").write_text(json.dumps(GOOD))
    with pytest.raises(ValueError, match="^more than one document for a$"), documents.told_plainly():
        batch.lines(spark, asked("a"), JsonFolder(str(tmp_path / "{s,s2}")), exact=exact).collect()


def test_a_failed_run_leaves_the_earlier_file(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "a.txt").write_text("earlier")
    with pytest.raises(FileNotFoundError):
        cli.main([str(tmp_path / "a.m4a"), "--json-dir", str(tmp_path / "s"), "-o", str(tmp_path)], spark)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.txt", "s"] and (tmp_path / "a.txt").read_text() == "earlier"


def test_strict_command_line(spark, tmp_path):
    doc = {"segments": [{"start": 0, "end": 2, "speaker": None}]}
    for folder, d in (("s", {"segments": [{"start": 0, "end": 2, "text": "x"}]}), ("t", doc)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.json").write_text(json.dumps(d))
    told = [str(tmp_path / "a.m4a"), "--diarize", "--json-dir", str(tmp_path / "s"), "--turns-dir", str(tmp_path / "t"), "-o", str(tmp_path)]
    assert open(cli.main(told, spark)).read() == "[UNKNOWN] 00:00 x\n"
    assert open(cli.main([*told, "--strict"], spark)).read() == "[None] 00:00 x\n"


def test_recordings_and_folders(spark, tmp_path):
    for name in ("a b+.m4a", "c%d.m4a"):
        (tmp_path / name).write_bytes(b"12345")
    found = documents.recordings(spark, str(tmp_path / "*.m4a"))
    assert sorted((r.rec, r.length) for r in found.collect()) == [("a b+", 5), ("c%d", 5)]
    spark.createDataFrame([("007", json.dumps(GOOD)), ("x y", json.dumps(GOOD))], "rec string, json string").repartition(1).write.partitionBy("rec").text(str(tmp_path / "docs"))
    assert sorted(r.rec for r in documents.raw_documents(spark, str(tmp_path / "docs"), by_folder=True).collect()) == ["007", "x y"]
