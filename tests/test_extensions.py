"""Overlap join, card times, files in two phases, metrics, merged decks, WebVTT, the table function, growing transcripts, the source of videos."""

import json
import os
import random
import stat
import subprocess
import sys
import time
import wave

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cueforge import cli
from cueforge.functions import tables
from cueforge.operators import analysis, captions, cards, decks, metrics, overlaps, render, resources, segments, voice
from cueforge.sinks import files, video_files
from cueforge.sources import media, subtitles, videos
from cueforge.streaming import drop_folder, growing

CUES = "video_id string, idx long, start double, end double, text string"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_overlaps(spark):
    """Nested and equal intervals, none, long ones, crowded buckets; each pair once, as by comparing all."""
    rng = random.Random(1)

    def cues(n, salt):
        out = []
        for i in range(n):
            start = rng.choice([0.0, 5.0, 10.0, 20.0, round(rng.uniform(0, 200), 2)])
            out.append((rng.choice("ab"), i, start, start + rng.choice([0.0, 5.0, 10.0, 0.5, 500.0, -1.0, 50_000.0, 9e13]), f"{salt}{i % 3}"))
        return out + [("a", n, None, 3.0, "x"), ("a", n + 1, float("nan"), 3.0, "x"), (None, 0, 0.0, 9.0, "x"), ("c", 0, 0.0, float("inf"), "x"), ("d" + salt, 0, 1.0, 2.0, "only")]

    a, b = cues(60, "s"), cues(50, "v")
    want = sorted((x[0], x[1], y[1]) for x in a for y in b if x[0] is not None and x[0] == y[0] and None not in (x[2], y[2]) and x[2] < y[3] and y[2] < x[3] and x[3] != float("inf") and y[3] != float("inf"))
    one, two = spark.createDataFrame(a, CUES), spark.createDataFrame(b, CUES)
    for width, long in ((10.0, 2000), (3.0, 4), (1000.0, 7)):
        found = overlaps.overlapping(one, two, width, long)
        assert sorted((r.video_id, r.spoken_idx, r.visual_idx) for r in found.collect()) == want
    assert not any(x in plan(overlaps.overlapping(one, two)) for x in ("CartesianProduct", "NestedLoop"))
    assert overlaps.overlapping(one.limit(0), two).count() == 0 and overlaps.both_paths(one.limit(0), two.limit(0)).count() == 0


def test_both_paths(spark):
    spoken = spark.createDataFrame([("v", 0, 0.0, 4.0, "hello"), ("v", 1, 4.0, 6.0, "there")], CUES)
    visual = spark.createDataFrame([("v", 0, 0.0, 2.0, "a cat"), ("v", 1, 2.0, 3.0, "a dog"), ("v", 2, 3.0, 4.5, "a cat"), ("v", 3, 6.0, 8.0, "the end")], CUES)
    assert [tuple(r)[1:] for r in overlaps.both_paths(spoken, visual).orderBy("idx").collect()] == [(0, 0.0, 4.0, "hello 〔a cat；a dog〕"), (1, 4.0, 6.0, "there 〔a cat〕"), (2, 6.0, 8.0, "the end")]


def test_card_times(spark):
    cues = spark.createDataFrame([("v", 0, 5.0, 9.0, "the the common words"), ("v", 1, 65.0, 70.0, "the zebra crosses"), ("v", 2, 70.0, 80.0, "The  Zebra crosses again"), ("v", 3, 90.0, 95.0, "你好世界"), ("w", 0, 3.0, 4.0, "zebra")], CUES)
    asked = [("v", 0, "q", "a zebra crosses"), ("v", 1, "q", "zebra crosses again!"), ("v", 2, "q", "世界你好世界"), ("v", 3, "q", "xyzzy"), ("v", 4, "q", ""), ("v", 5, "q", None), ("w", 0, "q", "ZEBRA"), ("none", 0, "q", "zebra"), ("v", 6, "q", "the t")]
    rows = spark.createDataFrame(asked, "video_id string, ord long, question string, answer string")
    got = {(r.video_id, r.ord): r.timestamp for r in cards.timed(rows, cues).collect()}
    assert got == {("v", 0): "01:05", ("v", 1): "01:10", ("v", 2): "01:30", ("v", 3): "", ("v", 4): "", ("v", 5): "", ("w", 0): "00:03", ("none", 0): "", ("v", 6): "00:05"}
    made = cards.card_rows(cards.timed(rows, cues).withColumn("source", F.lit("s")))
    assert made.filter("timestamp = '01:05'").count() == 1 and {r.timestamp for r in cards.card_rows(rows.withColumn("source", F.lit("s"))).collect()} == {""}


def names_under(folder):
    return sorted(os.path.relpath(os.path.join(at, n), folder) for at, _, found in os.walk(folder) for n in found)


def test_files_in_two_phases(spark, tmp_path):
    rows = spark.createDataFrame([(f"v {i}", f"text {i}" * 3, None if i == 3 else "") for i in range(8)], "video_id string, one string, two string").repartition(4)
    out = str(tmp_path / "out")
    assert video_files.write_files(rows, out, {"one": "a.txt", "two": "b.txt"}) == 15
    assert len(names_under(out)) == 15 and open(f"{out}/v 2/a.txt").read() == "text 2" * 3 and not os.path.exists(f"{out}/v 3/b.txt")
    boom = F.udf(lambda v: 1 / 0 if v == "v 5" else "new")
    with pytest.raises(PySparkException):
        video_files.write_files(rows.withColumn("one", boom("video_id")), out, {"one": "a.txt"})
    assert len(names_under(out)) == 15 and open(f"{out}/v 2/a.txt").read() == "text 2" * 3 and not any(n.startswith("_") for n in os.listdir(out))
    # a run that stopped after its journal is finished by the next one
    run = tmp_path / "out" / "_pending-x"
    (run / "t" / "v 2").mkdir(parents=True)
    (run / "t" / "v 2" / "a.txt").write_text("late")
    (run / "t.list").write_text(json.dumps(["v 2", "a.txt"]) + "\n" + json.dumps(["v 1", "a.txt"]) + "\n")
    (run / "journal.json").write_text(json.dumps([str(run / "t.list")]))
    (tmp_path / "out" / "_pending-y" / "t").mkdir(parents=True)  # one at work
    assert video_files.write_files(rows.filter("video_id = 'v 0'"), out, {"one": "c.txt"}) == 1
    assert open(f"{out}/v 2/a.txt").read() == "late" and not run.exists() and (tmp_path / "out" / "_pending-y").exists()
    spark.dataSource.register(video_files.VideoFiles)
    rows.write.format("video_files").mode("append").option("names", '{"one": "d.txt"}').save(out)
    assert open(f"{out}/v 7/d.txt").read() == "text 7" * 3
    with pytest.raises(PySparkException):
        rows.write.format("video_files").mode("append").option("names", '{"three": "d.txt"}').save(out)


def test_metrics(spark, tmp_path):
    text = "1\n00:00:01,0 --> 00:00:02,0\na\n\nbad\n\n2\n00:00:01 --> x\nb\n\n3\n00:00:03,0 --> 00:00:04,0\nc\n"
    docs = spark.createDataFrame([("x", text), ("y", ""), ("z", "one\ntwo"), ("n", None)], "video_id string, document string")
    own = metrics.RunMetrics()
    read = subtitles.srt_segments(docs, own)
    assert read.count() == 2 and own.told() == {"cues_read": 2, "blocks_dropped": 3}

    class Client:
        def ask(self, prompt):
            return {"S": "a fine answer", "L": "no", "W": None}.get(prompt[0], "ok then")

    raw = spark.createDataFrame([(1, "[00:00] a"), (2, "[00:00] b")], "video_id long, raw_text string")
    counted = metrics.RunMetrics()
    analysis.analyse(raw, "en", "all", Client, "m", str(tmp_path / "kept"), counted).collect()
    assert counted.told() == {"answers_accepted": 2, "answers_refused": 6, "answers_missing": 2}


def test_failed_answers_are_asked_again(spark, tmp_path):
    raw = spark.createDataFrame([(1, "[00:00] a")], "video_id long, raw_text string")
    folder = str(tmp_path / "answers")

    class Away:
        def ask(self, prompt):
            return None

    class Back:
        def ask(self, prompt):
            return "here I am"

    assert analysis.analyse(raw, "en", "csv", Away, "m", folder).first().qa == analysis.FALLBACK_QA
    assert analysis.analyse(raw, "en", "csv", Back, "m", folder).first().qa == "here I am"
    assert analysis.analyse(raw, "en", "csv", Away, "m", folder).first().qa == "here I am"
    (tmp_path / "begun" / "_temporary").mkdir(parents=True)  # a run that was killed
    assert analysis.analyse(raw, "en", "csv", Back, "m", str(tmp_path / "begun")).first().qa == "here I am"


def test_deep_braces(spark):
    deep = "{" * 40_000 + "}" * 40_000 + ' {"a": 1}'
    rows = spark.createDataFrame([(deep,), ('}{"b": {"c": "}"}} {"d": {}}',)], "t string")
    assert [r[0] for r in rows.select(analysis.first_object("t")).collect()] == ["{}", '{"d": {}}']


def test_merged_decks(spark, tmp_path):
    def noted(pairs):
        rows = spark.createDataFrame([(i, q, a, "", "", "s") for i, (q, a) in enumerate(pairs)], "ord long, question string, answer string, tags string, timestamp string, source string")
        return cards.notes(rows, "d", by_position=False, keep=["ord"])

    table = decks.NoteTable(spark, str(tmp_path / "notes"))
    held = lambda: sorted((r.fields[0], r.fields[1]) for r in table.read().collect())
    assert table.read().count() == 0 and table.merge(noted([("a", "1"), ("b", "2")])) == 1
    assert table.merge(noted([("a", "1"), ("b", "2")])) == 2 and held() == [("a", "1"), ("b", "2")]
    assert table.merge(noted([("new", "0"), ("a", "1"), ("b", "3"), ("b", "4")])) == 3
    assert held() == [("a", "1"), ("b", "4"), ("new", "0")] and table.read(1).count() == 2
    with pytest.raises(PySparkException):  # fails midway: nothing is seen of it
        table.merge(noted([("c", "1")]).withColumn("guid", F.udf(lambda g: 1 / 0)("guid")))
    assert table.versions() == [1, 2, 3] and len(held()) == 3
    (tmp_path / "notes" / "v000000000004").mkdir()  # another merge that came first
    stale = decks.NoteTable(spark, str(tmp_path / "notes"))
    stale.versions = lambda: [1, 2, 3]
    with pytest.raises(decks.StaleVersion):
        stale.merge(noted([("c", "1")]))
    (tmp_path / "notes" / "v000000000004").rmdir()
    table.forget(1)
    assert table.versions() == [3] and len(held()) == 3
    (tmp_path / "c.csv").write_text("question,answer,tags,timestamp,source\nq,a,,,s\n")
    for _ in range(2):
        assert cli.main(["merge", "--csv", str(tmp_path / "c.csv"), "--table", str(tmp_path / "t")], spark) == 0
    assert decks.NoteTable(spark, str(tmp_path / "t")).read().count() == 1 and cli.main(["merge", "--csv", "none", "--table", "t"], spark) == 2


VTT = """﻿WEBVTT - a title
Kind: captions

NOTE a note
over two lines

STYLE
::cue { color: red }

first
00:01.500 --> 00:02.250 align:start position:10%
<v Ann>Hello &amp; <i>good</i> day</v>
second &lt;line&gt;

101:00:00.000\t-->\t101:00:01.000
late

00:03.000 --> 00:04.00
too few digits

00:61.000 --> 00:62.000
no such second

5
00:05.000 --> 00:06.000"""


def test_webvtt(spark, tmp_path):
    docs = spark.createDataFrame([("a", VTT.replace("\n", "\r\n")), ("b", "WEBVTT\n00:01.000 --> 00:02.000\nright below"), ("c", "WEBVTTX\n\n00:01.000 --> 00:02.000\nx"), ("d", "1\n00:00:01,000 --> 00:00:02,000\nx"), ("e", None), ("f", "WEBVTT")], "video_id string, document string")
    got = [tuple(r) for r in subtitles.vtt_segments(docs).orderBy("video_id", "idx").collect()]
    assert got == [("a", 0, 1.5, 2.25, "<v Ann>Hello &amp; <i>good</i> day</v> second &lt;line&gt;", "align:start position:10%"), ("a", 1, 363600.0, 363601.0, "late", ""), ("a", 2, 5.0, 6.0, "", ""), ("b", 0, 1.0, 2.0, "right below", "")]
    assert subtitles.vtt_segments(docs, plain=True).filter("video_id = 'a' and idx = 0").first().text == "Hello & good day second <line>"
    (tmp_path / "x.vtt").write_text(VTT)
    (tmp_path / "y.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nx\n")
    assert {r.video_id for r in subtitles.read_subtitles(spark, str(tmp_path)).collect()} == {"y.srt"}
    assert {(r.video_id, r.idx) for r in subtitles.read_subtitles(spark, str(tmp_path), vtt=True).collect()} == {("x.vtt", 0), ("x.vtt", 1), ("x.vtt", 2), ("y.srt", 0)}


def test_srt_cues(spark):
    texts = ["1\r\n00:00:01,5 --> 00:00:02.250\r\nHello\r\nworld\r\n\r\n2\n00:00:03,000 --> 00:00:04,000\n\n3\nbad --> 00:00:04,000\nx\n\n \n4\n00:00:05,000-->00:00:06,000 x\n　\nlast\x1c", "", None, "a\n\n\nb"]
    docs = spark.createDataFrame(list(enumerate(texts)), "video_id int, document string")
    tables.register(spark)
    got = spark.sql("SELECT d.video_id, c.* FROM {d} d, LATERAL srt_cues(d.document) c", d=docs).collect()
    want = subtitles.srt_segments(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 2
    with pytest.raises(PySparkException):
        spark.sql("SELECT * FROM srt_cues(5)").collect()


def test_growing_transcripts(spark, tmp_path):
    """Segments in any order, with repeats, over batches and a restart, give the batch transcript; a closed video takes no more."""
    rng = random.Random(4)
    rows = [(v, i, i * 2.0, i * 2.0 + 2, f"{v} line {i}") for v in ("a", "b", "c") for i in range(12)]
    want = {r.video_id: r.raw_text for r in segments.transcript(spark.createDataFrame(rows, CUES)).collect()}
    told = rng.sample(rows, len(rows)) + [(v, i, s, e, "repeated") for v, i, s, e, _ in rows[:5]]
    last, closed = {}, set()

    def batch(df, number):
        for r in df.collect():
            closed.update([r.video_id] if r.closed else [])
            if len(r.raw_text) >= len(last.get(r.video_id, "")):
                last[r.video_id] = r.raw_text

    def run(timeout_ms=3_600_000):
        stream = spark.readStream.schema(CUES).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = growing.growing(stream, timeout_ms).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        assert query.awaitTermination(90)

    def arrive(name, part):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("video_id", "idx", "start", "end", "text"), r, strict=True))) for r in part))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else timers keep the query alive
    try:
        arrive("1", told[:15])
        arrive("2", told[15:22])
        run()
        assert last != want
        arrive("3", told[22:])
        run(1)  # from the checkpoint; from now on a video closes at once
        assert last == want
        time.sleep(0.1)
        arrive("4", [("c", 99, 0.0, 1.0, "closes the others"), ("d", 0, 0.0, 1.0, "new")])
        run(1)
        arrive("5", [("a", 100, 0.0, 1.0, "too late"), ("d", 0, 0.0, 1.0, "again")])
        run(1)
        assert last["a"] == want["a"] and last["d"] == "[00:00] new" and closed >= {"a", "b"}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_videos_source(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name in ("one.mp4", "two.mp4", "deep/three.mp4", "notes.txt"):
        (tmp_path / "in" / name).write_bytes(b"x" * len(name))
    log, tool = tmp_path / "log", tmp_path / "probe"
    tool.write_text(f'#!/bin/sh\necho x >> {log}\ncase "$@" in *two*) exit 1;; esac\necho \'{{"format": {{"duration": "2.5"}}}}\'\n')
    tool.chmod(tool.stat().st_mode | stat.S_IEXEC)
    starts = lambda: len(log.read_text().split()) if log.exists() else 0
    read = lambda **o: videos.read_videos(spark, str(tmp_path / "in"), pattern="*.mp4", probe=str(tool), **o)
    assert {(r.video_id, r.size) for r in read(columns="video_id string, size long").collect()} == {("one", 7), ("two", 7), ("three", 14)} and starts() == 0
    one = read().filter("video_id = 'one'")
    assert [(r.duration, r.error) for r in one.collect()] == [(2.5, None)] and starts() == 1
    assert {(r.video_id, r.duration) for r in read().collect()} == {("one", 2.5), ("two", None), ("three", 2.5)} and starts() == 4
    assert read().filter("video_id like 't%' and path like '%deep/three.mp4'").count() == 1 and starts() == 5
    told = spark._jvm.PythonSQLUtils.explainString(one._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [EqualTo(video_id,one)]" in told and starts() == 5


def test_silent_videos(spark, tmp_path):
    class Speech:
        def transcribe(self, path, language):
            return ([captions.Spoken(0.0, 1.0, " a ")] if path == "loud" else []), ("en" if path == "loud" else None, 0.5, 3.25)

    sounds = spark.createDataFrame([(1, "loud"), (2, "silent")], "video_id long, path string")
    found = captions.transcribed(sounds, Speech)
    cues, about = captions.cues_of(found), captions.files_of(found)
    texts = {r.video_id: json.loads(r.document) for r in files.subtitles_json(cues, about).collect()}
    assert texts == {1: {"language": "en", "language_probability": 0.5, "duration": 3.25, "segments": [{"start": 0.0, "end": 1.0, "text": "a"}]}, 2: {"language": None, "language_probability": 0.5, "duration": 3.25, "segments": []}}
    assert {r.video_id: r.document for r in files.vtt(cues, about).collect()}[2] == "WEBVTT\n\n" and {r.video_id: r.document for r in files.srt(cues, about).collect()}[2] == ""
    assert {r.video_id: r.document for r in files.captions_json(cues, about).collect()}[2] == "[]"


def test_caption_and_transcribe_commands(spark, tmp_path, monkeypatch):
    """Files of a video without speech and of its frames; --fps reaches the tool."""
    commands = str(tmp_path / "commands")

    def tool(command):
        with open(commands, "a") as f:
            f.write(" ".join(command) + "\n")
        if command[0] == "ffprobe":
            return '{"format": {"duration": "6.0"}}'
        for name in [command[-1] % i for i in (1, 2, 3)] if "%06d" in command[-1] else [command[-1]]:
            with open(name, "wb") as f:
                f.write(b"x")
        return ""

    class Silence:
        def __init__(self, *_):
            pass

        def transcribe(self, path, language):
            return [], ("zh", 0.25, 6.0)

    class Sees:
        def __init__(self, *_):
            pass

        def reachable(self):
            return True

        def describe(self, image):
            return f"{len(image)} byte"

    real = media.extracted_frames, media.extracted_audio
    monkeypatch.setattr(media, "extracted_frames", lambda v, root, interval, fps=None: real[0](v, root, interval, fps, tool))
    monkeypatch.setattr(media, "extracted_audio", lambda v, root: real[1](v, root, tool))
    monkeypatch.setattr(captions, "WhisperRecognizer", Silence)
    monkeypatch.setattr(captions, "HttpDescriber", Sees)
    (tmp_path / "talk.mp4").write_bytes(b"v")
    out = tmp_path / "out"
    assert cli.main(["transcribe", "--video", str(tmp_path / "talk.mp4"), "--out-dir", str(out)], spark) == 0
    assert json.loads((out / "talk" / "subtitles.json").read_text()) == {"language": "zh", "language_probability": 0.25, "duration": 6.0, "segments": []} and (out / "talk" / "subtitles.srt").read_text() == ""
    assert cli.main(["caption", "--video", str(tmp_path / "talk.mp4"), "--out-dir", str(out), "--fps", "0.5"], spark) == 0
    assert [s["text"] for s in json.loads((out / "talk" / "captions.json").read_text())] == ["1 byte"] * 3
    manifest = json.loads((out / "talk" / "frames.json").read_text())
    assert manifest["fps"] == 0.5 and manifest["count"] == 3 and "fps=0.5" in open(commands).read()


def test_template_vtt_and_card_times_commands(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.vtt").write_text("WEBVTT\n\n01:05.000 --> 01:07.000\nthe zebra crosses\n")
    (tmp_path / "t.md").write_text("{{title}} / {{ title }} / {{meta}}")
    common = ["--subtitles", str(tmp_path / "in"), "--model", "", "--date", "d", "--template", str(tmp_path / "t.md"), "--format", "knowledge"]
    assert cli.main(["knowledge", *common, "--out-dir", str(tmp_path / "o"), "--vtt"], spark) == 0
    assert (tmp_path / "o" / "a.vtt" / "knowledge.md").read_text() == "a / {{ title }} / segments=1 model=none"
    assert "cues_read" in capsys.readouterr().err
    assert cli.main(["knowledge", *common[:-3], str(tmp_path / "none.md"), "--out-dir", str(tmp_path / "o")], spark) == 2


def test_both_paths_command(spark, tmp_path):
    for folder, name, text in (("said", "a.srt", "hello"), ("said", "b.json", None), ("seen", "a.json", "a cat")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text("[]" if text is None else f"1\n00:00:01,000 --> 00:00:02,000\n{text}\n" if name.endswith("srt") else json.dumps([{"start": 0, "end": 3, "text": text}]))
    (tmp_path / "t.md").write_text("{{summary}}{{timeline}}{{meta}}")
    rest = ["--model", "", "--template", str(tmp_path / "t.md"), "--format", "knowledge", "--date", "d", "--out-dir", str(tmp_path / "o")]
    assert cli.main(["knowledge", "--subtitles", str(tmp_path / "said"), "--captions", str(tmp_path / "seen"), *rest], spark) == 0
    assert "hello 〔a cat〕" in (tmp_path / "o" / "a.srt" / "knowledge.md").read_text() and "segments=0" in (tmp_path / "o" / "b.json" / "knowledge.md").read_text()
    (tmp_path / "seen" / "a.json").rename(tmp_path / "captions.json")
    assert cli.main(["knowledge", "--subtitles", str(tmp_path / "said" / "a.srt"), "--captions", str(tmp_path / "captions.json"), *rest], spark) == 0
    assert "hello 〔a cat〕" in (tmp_path / "o" / "a.srt" / "knowledge.md").read_text()
    assert cli.main(["knowledge", "--subtitles", str(tmp_path / "said"), "--captions", str(tmp_path / "none"), *rest], spark) == 2


def test_drop_folders_keep_apart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nhi\n")
    for checkpoint in ("one", "two", "one"):
        assert drop_folder.watch_srt(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / checkpoint)).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_voice(spark, tmp_path):
    """Loud stretches of a sound file; pauses within, clicks that are none, a run over two chunks."""
    rate, size = 16000, 480
    loud = [*range(50, 70), *range(76, 90), 200, *range(300, 420)]
    rng = random.Random(1)
    data = b"".join(int(rng.uniform(-1, 1) * (9000 if n in loud else 20)).to_bytes(2, "little", signed=True) for n in range(500) for _ in range(size))
    with wave.open(str(tmp_path / "a.wav"), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(data + b"\x00\x00" * 7)
    sounds = spark.createDataFrame([("v", str(tmp_path / "a.wav"))], "video_id string, path string")
    windows = voice.levels(sounds)
    assert windows.count() == 501
    for chunk in (64, 4096):
        assert sorted((r["first"], r["last"]) for r in voice.voiced(windows, chunk=chunk).collect()) == [(50, 89), (300, 419)]
    cues = spark.createDataFrame([("v", 0, 0.0, 1.0, "hum"), ("v", 1, 2.5, 3.0, "hello"), ("v", 2, 5.9, 6.1, "click"), ("v", 3, 12.0, 13.0, "end"), ("w", 0, 2.5, 3.0, "other")], CUES)
    assert {r.text for r in voice.only_voiced(cues, voice.voiced(windows)).collect()} == {"hello", "end"}
    with wave.open(str(tmp_path / "b.wav"), "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(b"\x00" * 400)
    with pytest.raises(PySparkException):
        voice.levels(sounds.withColumn("path", F.lit(str(tmp_path / "b.wav")))).count()


AT_ONCE = """
import os, sys, time
sys.path[:0] = [{root!r}]
import pandas as pd
from pyspark.sql import SparkSession
from cueforge.operators import captions, resources
spark = SparkSession.builder.master("local-cluster[1,4,1024]").config("spark.ui.enabled", "false").config("spark.executorEnv.PYTHONPATH", {root!r}).config("spark.sql.warehouse.dir", {folder!r}).getOrCreate()
profile = resources.task_profile("small", "int8", "cpu", 2.4, 4)
assert profile.taskResources["cpus"].amount == 2.0

class Sees:
    def describe(self, image):
        own = {folder!r} + "/" + str(os.getpid())
        open(own, "w").close()
        n = len(os.listdir({folder!r}))
        time.sleep(0.5)
        os.remove(own)
        return str(n)

rows = spark.range(8).repartition(8).selectExpr("id as video_id", "0 as idx", "0d as t", "cast('x' as binary) as content")
told = captions.describe(rows, Sees, profile=profile)
print("PLAN", told._jdf.queryExecution().executedPlan().toString())
print("MOST", max(int(r.text) for r in told.collect()))
spark.stop()
"""


def test_tasks_that_hold_models(tmp_path):
    """Of tasks that ask for two cores of four, two run at once and no more."""
    (tmp_path / "at_once").mkdir()
    code = AT_ONCE.format(root=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), folder=str(tmp_path / "at_once"))
    ran = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=240, cwd=tmp_path)
    assert "MOST 2" in ran.stdout, ran.stdout[-500:] + ran.stderr[-1500:]
    assert "Profile" in ran.stdout.split("MOST")[0] and "cpus" in ran.stdout.split("MOST")[0], ran.stdout
    assert resources.memory_of("tiny", "float16") == 1.0 and resources.memory_of("other", "int8") == 6.5
    cuda = resources.task_profile("large-v3", "float16", "cuda", 16, 8)
    assert cuda.taskResources["gpu"].amount == 1.0 and resources.task_profile("large-v3", "float16", "cpu", 16, 8).taskResources["cpus"].amount == 5.0


def test_page_layout():
    assert "body{" in render.HEAD[1] and "<body>" in render.HEAD[1]


def _sent(spark):
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None).iterator()
    total = 0
    while stages.hasNext():
        total += stages.next().shuffleWriteBytes()
    return total


def test_card_times_send_texts_and_no_stretches(spark):
    """What is shuffled is a few times the texts, however their stretches are spread; and neither many small tasks nor one change the times."""
    draw, letters = random.Random(5), "abcdefghijklmnopqrstuvwxyz"
    text = lambda: "".join(draw.choices(letters, k=400))
    said = [(v, i, float(i), text()) for v in range(20) for i in range(20)]
    asked = [(v, i, "", said[20 * v + 19 - i][3][100:300]) for v in range(20) for i in range(20)]
    cues = spark.createDataFrame(said, "video_id long, idx long, start double, text string").localCheckpoint()
    answers = spark.createDataFrame(asked, "video_id long, ord long, question string, answer string").localCheckpoint()
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _sent(spark)
        got = {(r.video_id, r.ord): r.timestamp for r in cards.timed(answers, cues).collect()}
        time.sleep(1)
        sent = _sent(spark) - before
        assert sent < 8 * (sum(len(s[3]) for s in said) + sum(len(a[3]) for a in asked)), sent
        fine = {(r.video_id, r.ord): r.timestamp for r in cards.timed(answers, cues, parts=50).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert got == fine == {(v, i): f"00:{19 - i:02d}" for v in range(20) for i in range(20)}
