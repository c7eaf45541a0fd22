"""Traps of text, rounding and order, and small goldens."""

import hashlib
import http.server
import json
import sqlite3
import threading
import zipfile
from collections import defaultdict

import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cueforge import cli
from cueforge.functions import text as X
from cueforge.operators import analysis, captions, cards, hosts, profiles, render, segments
from cueforge.sinks import files, packages, video_files
from cueforge.sources import media, subtitles
from cueforge.streaming import drop_folder


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_times(spark):
    assert column(spark, [0.0005, 0.0015, 3661.2, 360000.0, None], X.timecode, "double")[:4] == ["00:00:00,000", "00:00:00,002", "01:01:01,200", "100:00:00,000"]
    assert column(spark, [61.9, 3661.0, 6000.0], X.mmss, "double") == ["01:01", "61:01", "100:00"]


def test_strings(spark):
    texts = [" a b　", "\x1cx ", "", "\n\t", "a\r\nb\rc\n", "a\n\n", "a b"]
    assert column(spark, texts, X.strip) == [t.strip() for t in texts]
    assert column(spark, texts, lambda v: F.to_json(X.splitlines(v))) == [__import__("json").dumps(t.splitlines(), ensure_ascii=False, separators=(",", ":")) for t in texts]
    assert column(spark, ["```json\na\n```", "a", "```"], X.strip_fence) == ["a", "a", ""]
    assert column(spark, ["x</think>y</think>\n z ", "a\nb"], X.without_thinking) == ["z", "a b"]
    assert column(spark, ["a_b.c.json", ".srt", "x"], X.title_of) == ["a b.c", ".srt", "x"]
    assert column(spark, ["Default"], X.deck_id) == [(9120451233 + sum(map(ord, "Default"))) % 2**31]


@settings(max_examples=6, deadline=None, phases=[Phase.generate])
@given(st.lists(st.tuples(st.integers(0, 10**8), st.from_regex(r"[a-zé<&$]{1,9}( [a-z{}]{1,5})?", fullmatch=True)), min_size=1, max_size=6))
def test_srt_round_trip(spark, cues):
    rows = [("v", i, ms / 1000, ms / 1000 + 1.5, text) for i, (ms, text) in enumerate(cues)]
    back = subtitles.srt_segments(files.srt(spark.createDataFrame(rows, "video_id string, idx int, start double, end double, text string")))
    assert [(round(r.start, 3), r.text) for r in back.orderBy("idx").collect()] == [(r[2], r[4]) for r in rows]


def test_srt_rules(spark, tmp_path):
    text = "1\r\n00:00:01,5 --> 00:00:02.250\r\nHello\r\nworld\r\n\r\n2\n00:00:03,000 --> 00:00:04,000\n\n3\nbad --> 00:00:04,000\nx\n"
    (tmp_path / "a.srt").write_bytes(text.encode())
    (tmp_path / "b.vtt").write_text("WEBVTT\n\n00:00:01.000 --> 00:00:02.000\nx\n")
    (tmp_path / "c.json").write_text('{"segments": [], "captions": [{"start": 1, "end": 2, "text": "c"}]}')
    (tmp_path / "d.JSON").write_text('[{"start": 0.5, "end": 2, "text": "d"}]')
    (tmp_path / "e.json").write_text("{")
    got = {(r.video_id, r.start, r.end, r.text) for r in subtitles.read_subtitles(spark, str(tmp_path)).collect()}
    assert got == {("a.srt", 1.005, 2.25, "Hello world"), ("c.json", 1.0, 2.0, "c"), ("d.JSON", 0.5, 2.0, "d")}
    assert [r.video_id for r in subtitles.rejected_subtitles(spark, str(tmp_path)).collect()] == ["e.json"]


def test_frames(spark, tmp_path):
    (tmp_path / "frames.json").write_text('{"video": "v", "interval": 2.0, "fps": null, "count": 3, "frames": [{"file": "a", "t": 0.0}, {"file": "b", "t": 2.0}, {"file": "c", "t": 4.0}]}')
    rows = subtitles.read_frames(spark, str(tmp_path)).withColumnRenamed("video", "video_id")
    assert [(r.start, r.end) for r in segments.intervals(rows, 2.0).orderBy("idx").collect()] == [(0.0, 2.0), (2.0, 4.0), (4.0, 6.0)]


def test_cards(spark, tmp_path):
    lines = ["A: lost", "Q: one", "A: first", "a: second", "more", "Q:", "- Q: no", "q: three"]
    rows = spark.createDataFrame([("v", i, s) for i, s in enumerate(lines)], "video_id string, n int, line string")
    got = cards.parse_qa(rows).orderBy("ord")
    assert [tuple(r)[1:] for r in got.collect()] == [(0, "one", "second"), (1, "", ""), (2, "three", "")]
    full = cards.card_rows(got, spark.createDataFrame([("v", 'a,"b"')], "video_id string, source string"))
    files.write_cards(full.coalesce(1), str(tmp_path / "cards"))
    data = b"".join(p.read_bytes() for p in (tmp_path / "cards").glob("part*"))
    assert data.startswith(b"question,answer,tags,timestamp,source\r\none,second,,,") and b'"a,""b"""\r\n' in data
    assert subtitles.read_cards(spark, str(tmp_path / "cards")).filter("source = 'a,\"b\"'").count() == 3
    assert {r.deck_id for r in cards.notes(full, "d").collect()} == {(9120451233 + ord("d")) % 2**31}
    items = spark.createDataFrame([("v", 0, "", "x"), ("v", 1, " q ", None)], "video_id string, n int, q string, a string")
    assert [tuple(r) for r in cards.parse_qa_items(items).collect()] == [("v", 0, "q", "")]


def test_rendering(spark):
    lines = ["# T <x>", "- [01:20] **a**", "- [100:00] b", "> q", "", "**b** c", "####### no"]
    rows = spark.createDataFrame([("v", i, s) for i, s in enumerate(lines)], "video_id string, n int, line string")
    assert render.html_bodies(rows).first().body.split("\n") == ["<h1>T &lt;x&gt;</h1>", "<ul>", "<li>[<a class='ts' href='#t-01:20'>01:20</a>] **a**</li>", "<li>[100:00] b</li>", "</ul>", "<p>&gt; q</p>", "", "<p><strong>b</strong> c</p>", "<p>####### no</p>"]
    one = spark.range(1).select(render.fill(F.lit("{{title}}|{{qa}}|{{ qa }}|{{none}}"), {"title": F.lit("$1 {{qa}}"), "qa": F.lit("{{title}}")}).alias("x")).first().x
    assert one == "$1 {{title}}|{{title}}|{{ qa }}|{{none}}"


def test_profiles(spark):
    hosts = [(32.0, None, False), (16.0, 7.9, False), (7.0, None, True), (7.0, None, False), (8.0, None, True), (5.9, 8.0, False), (0.0, None, True)]
    rows = spark.createDataFrame([(i, *h) for i, h in enumerate(hosts)], "i int, ram double, vram double, apple boolean")
    got = [r[0] for r in rows.orderBy("i").select(profiles.select_profile(F.col("ram"), F.col("vram"), F.col("apple"))).collect()]
    assert got == ["max", "high", "low-mac", "low", "mid", "high-gpu", "tiny"]


def test_inference(spark):
    raw = spark.createDataFrame([(1, "[00:00] a")], "video_id long, raw_text string")
    assert analysis.fan_out(raw, "en", "csv").count() == 1 and analysis.fan_out(raw, "fr").count() == 5
    answers = analysis.infer(analysis.fan_out(raw, "zh"), analysis.EchoClient)
    row = analysis.wide(raw, answers.filter("field <> 'qa'")).first()
    assert row.summary == analysis.INSTRUCTIONS["zh"][0] and row.qa == analysis.FALLBACK_QA


def test_media(spark):
    videos = spark.createDataFrame([("a", "x"), ("b", "bad")], "video_id string, path string")

    def fake(command):
        return '{"format": {"duration": "2.5"}}' if command[-1] == "x" else "{}"

    assert {(r.video_id, r.duration) for r in media.durations(videos, fake).collect()} == {("a", 2.5), ("b", None)}
    assert "fps=3" in " ".join(media.frames_command("v", "o", 2.0, 3)) and "fps=1/2.0" in media.frames_command("v", "o", 2.0, None)


def media_tool():
    """Stand-in of the media tools: three frames, or a sound file, where they would be written."""

    def tool(command):
        if command[0] == "ffprobe":
            return '{"format": {"duration": "6.0"}}'
        for name in [command[-1] % i for i in (1, 2, 3)] if "%06d" in command[-1] else [command[-1]]:
            with open(name, "wb") as f:
                f.write(b"x" * len(name.rsplit("/", 1)[1]))
        return ""

    return tool


def test_frames_to_captions(spark, tmp_path):
    videos = spark.createDataFrame([("a b", "v.mp4")], "video_id string, path string")
    for _ in range(2):  # a second try leaves no frame of the first
        spaced = segments.even_spacing(media.extracted_frames(videos, str(tmp_path / "f"), runner=media_tool()))
        assert [r.t for r in spaced.orderBy("idx").collect()] == [0.0, 2.0, 4.0]
    document = json.loads(media.manifests(spaced, videos, 2.0, None).first().document)
    assert (document["video"], document["interval"], document["fps"], document["count"]) == ("v.mp4", 2.0, None, 3) and [f["t"] for f in document["frames"]] == [0.0, 2.0, 4.0]
    pictures = spaced.join(media.images(spark, str(tmp_path / "f" / "*" / "*.jpg")), "file")
    found = captions.captioned(pictures, captions.SizeDescriber, 2.0).orderBy("idx").collect()
    assert [(r.start, r.end, r.text) for r in found] == [(0.0, 2.0, "16 bytes"), (2.0, 4.0, "16 bytes"), (4.0, 6.0, "16 bytes")]
    none = media.manifests(spaced.filter("false"), videos, 2.0, 1.0).first().document
    assert json.loads(none) == {"video": "v.mp4", "interval": 2.0, "fps": 1.0, "count": 0, "frames": []}


def test_speech(spark, tmp_path):
    class Speech:
        def transcribe(self, path, language):
            cues = [(0.0005, 1.0015, " a "), (2.0, 2.9996, "b")] if path.endswith("audio_16k.wav") else []
            return (captions.Spoken(*c) for c in cues), (language, 0.5, 3.0)

    videos = spark.createDataFrame([(7, "v.mp4")], "video_id long, path string")
    sounds = media.extracted_audio(videos, str(tmp_path), media_tool())
    found = captions.transcribed(sounds, Speech, "en")
    assert [tuple(r) for r in captions.cues_of(found).orderBy("idx").collect()] == [(7, 0, round(0.0005, 3), round(1.0015, 3), "a"), (7, 1, 2.0, 3.0, "b")]
    assert [tuple(r) for r in captions.files_of(found).collect()] == [(7, "en", 0.5, 3.0)]
    silent = captions.transcribed(sounds.withColumn("path", F.lit("silent")), Speech)
    assert captions.cues_of(silent).count() == 0 and captions.files_of(silent).count() == 1


def test_thousandths(spark):
    values = [k / 2000 for k in range(1, 4001, 2)] + [0.0, 1e-4, 2.0005, 1e6 + 0.0015, 123456.7895]
    assert column(spark, values, X.thousandth, "double") == [round(v, 3) for v in values]


@pytest.fixture
def server():
    asked = []

    class Answers(http.server.BaseHTTPRequestHandler):
        def reply(self, value):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(value).encode())

        def do_GET(self):  # noqa: N802
            self.reply({"models": []})

        def do_POST(self):  # noqa: N802
            asked.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.reply({"response": f" answer {len(asked[-1]['prompt'])} "})

        def log_message(self, *_):
            pass

    own = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}", asked
    own.shutdown()


def test_http_clients(server):
    host, asked = server
    client = analysis.HttpClient(host, "m")
    assert client.reachable() and client.ask("abc") == " answer 3 "
    assert captions.HttpDescriber(host, "v").describe(b"img").startswith(" answer")
    assert asked[0] == {"model": "m", "stream": False, "think": False, "prompt": "abc", "options": {"temperature": 0.3}}
    assert asked[1]["images"] == ["aW1n"] and asked[1]["options"] == {"temperature": 0.2, "num_predict": 160}
    gone = analysis.HttpClient("http://127.0.0.1:9", "m", 1)
    assert not gone.reachable(1) and gone.ask("x") is None
    with pytest.raises(OSError):
        captions.HttpDescriber("http://127.0.0.1:9", "m", 1).describe(b"")


def test_answers_are_asked_once(spark, tmp_path, server):
    host, asked = server
    raw = spark.createDataFrame([(1, "[00:00] a"), (2, "[00:00] a"), (3, "[00:00] b")], "video_id long, raw_text string")
    client = lambda: analysis.HttpClient(host, "m")
    folder = str(tmp_path / "answers")
    out = analysis.analyse(raw, "en", "csv", client, "m", folder)
    assert out.filter("qa like 'answer%'").count() == 3 and out.count() == 3 and len(asked) == 2
    analysis.analyse(raw, "en", "all", client, "m", folder).collect()
    assert len(asked) == 10
    assert analysis.analyse(raw, "en", "all", client, "other", folder).count() == 3 and len(asked) == 20
    away = analysis.analyse(raw, "en", "all", lambda: analysis.HttpClient("http://127.0.0.1:9", "m"), "m", folder)
    assert away.first().qa == analysis.FALLBACK_QA and len(asked) == 20


def test_forms_of_answers(spark):
    forms = ['[{"q": "", "question": " b ", "A": "c"}, {"Q": "d"}, {"a": "no question"}, "Q: e\\nA: f\\nQ: g", 5, null]', "Q: plain\nA: x", '{"q": "an object"}', "", None, "[]"]
    rows = spark.createDataFrame(list(enumerate(forms)), "video_id int, qa string")
    got = defaultdict(list)
    for r in cards.qa_cards(rows).orderBy("video_id", "ord").collect():
        got[r.video_id].append((r.ord, r.question, r.answer))
    assert got == {0: [(0, "b", "c"), (1, "d", ""), (2, "e", "f"), (3, "g", "")], 1: [(0, "plain", "x")]}
    assert column(spark, ['["a", {"q": "b", "answer": "c"}]', '{"z": "1", "a": 2}', "[]", "{}", "", None, "plain [x]"], analysis.as_markdown) == ["- a\n- b: c", "- **z**: 1\n- **a**: 2", "(无)", "(无)", "(无)", "(无)", "plain [x]"]
    assert column(spark, ['```json\n{"a": {"b": 1}} x```', 'x {no} {"c": 2}', '{"}": 1}', "none", None], analysis.first_object) == ['{"a": {"b": 1}}', '{"c": 2}', None, None, None]


def test_pages(spark, tmp_path):
    """A document's page, files of videos, and a source that is escaped twice in the page."""
    own = spark.createDataFrame([("a/b", "x_<y>.srt", 6.0, 3, *["- [00:02] s"] * 5), ("c", "n.json", 0.0, 0, *[""] * 5)], "video_id string, source string, duration double, n_segments long, summary string, timeline string, key_points string, qa string, glossary string")
    pages = render.pages(render.filled(own, "m", "2024-01-01"))
    rows = {r.video_id: r for r in pages.collect()}
    assert rows["a/b"].title == "x <y>" and "`x_&lt;y&gt;.srt`" in rows["a/b"].markdown
    lines = rows["a/b"].html.split("\n")
    assert lines[0].startswith("<!doctype html><html lang='zh'>") and lines[1] == "<title>x &lt;y&gt;</title>" and lines[-1] == "</body></html>"
    assert "<h1>x <y></h1>".replace("<y>", "&lt;y&gt;") in lines and "<p>&gt; 来源: `x_&amp;lt;y&amp;gt;.srt` | 时长: 00:06 | 生成日期: 2024-01-01</p>" in lines
    assert "<li>[<a class='ts' href='#t-00:02'>00:02</a>] s</li>" in lines and "<p>(无)</p>" in rows["c"].html
    anchored = render.pages(render.filled(own, "m", "d"), anchors=True).filter("video_id = 'a/b'").first().html
    assert "<li id='t-00:02'>" in anchored
    assert video_files.write_files(pages, str(tmp_path), {"markdown": "knowledge.md", "html": "knowledge.html"}) == 4
    assert (tmp_path / "a%2Fb" / "knowledge.html").read_text() == rows["a/b"].html and sorted(p.name for p in (tmp_path / "c").iterdir()) == ["knowledge.html", "knowledge.md"]
    made = spark.createDataFrame([("c", 0, 'q "1"', "a,b", "", "", "s"), ("c", 1, "q2", "", "", "", "s")], "video_id string, ord long, question string, answer string, tags string, timestamp string, source string")
    texts = {r.video_id: r.document for r in files.cards_csv(made, own).collect()}
    assert texts == {"a/b": "question,answer,tags,timestamp,source\r\n", "c": 'question,answer,tags,timestamp,source\r\n"q ""1""","a,b",,,s\r\nq2,,,,s\r\n'}


def test_deck_package(spark, tmp_path):
    """Packages hold their notes in order, a card each, and the deck; one for each video, or one in all."""
    made = [("a b", i, f"q {i}", f"a {i}", "t" if i == 1 else "", "00:01", "s") for i in range(3)] + [("c", 0, "é?", "", "", "", "s")]
    rows = spark.createDataFrame(made, "video_id string, ord long, question string, answer string, tags string, timestamp string, source string")
    noted = cards.notes(rows, F.col("video_id"), keep=["video_id", "ord"]).withColumn("deck", F.col("video_id")).repartition(3)
    found = {r.video_id: r for r in packages.packages(noted, 1_700_000_000).collect()}

    def opened(data, video):
        (tmp_path / "x.apkg").write_bytes(data)
        with zipfile.ZipFile(tmp_path / "x.apkg") as z:
            assert sorted(z.namelist()) == ["collection.anki2", "media"]
            z.extract("collection.anki2", tmp_path / video)
        return sqlite3.connect(tmp_path / video / "collection.anki2")

    db = opened(found["a b"].package, "a b")
    assert found["a b"].notes == 3 and [r[0].split("\x1f") for r in db.execute("SELECT flds FROM notes ORDER BY id")] == [[f"q {i}", f"a {i}", "t" if i == 1 else "", "00:01", "s"] for i in range(3)]
    assert [r[0] for r in db.execute("SELECT tags FROM notes ORDER BY id")] == ["", " t ", ""]
    own = (9120451233 + sum(map(ord, "a b"))) % 2**31
    assert db.execute("SELECT count(*), min(did), max(did) FROM cards JOIN notes ON nid = notes.id").fetchone() == (3, own, own)
    models, decks = (json.loads(x) for x in db.execute("SELECT models, decks FROM col").fetchone())
    assert decks[str(own)]["name"] == "a b" and [f["name"] for f in models[str(cards.MODEL_ID)]["flds"]] == ["Question", "Answer", "Tags", "Timestamp", "Source"]
    assert opened(found["c"].package, "c").execute("SELECT count(*) FROM notes").fetchone() == (1,)
    one = cards.notes(rows.filter("video_id = 'a b'"), "d", keep=["ord"]).withColumns({"video_id": F.lit("d"), "deck": F.lit("d")})
    assert packages.write_package(one, str(tmp_path / "d.apkg"), 0) == 3 and opened((tmp_path / "d.apkg").read_bytes(), "d").execute("SELECT guid FROM notes ORDER BY id").fetchall() == [(hashlib.sha256(f"q {i}|{i}".encode()).hexdigest(),) for i in range(3)]
    assert packages.write_package(one.limit(0), str(tmp_path / "none.apkg"), 0) == 0


def test_hosts(spark):
    def mac(command):
        return {"sysctl": str(7 * 2**30), "system_profiler": "  Hardware:\n      Chip: Apple M2 Pro\n"}[command[0]] if command[0] != "nvidia-smi" else "x"

    def linux(command):
        if command[0] == "cat":
            return "MemTotal:       16461000 kB\nMemFree: 1 kB\n"
        if command[0] == "nvidia-smi":
            return "12288\n8192\n"
        raise OSError

    def nothing(command):
        raise OSError

    assert hosts.facts(mac, "Darwin", "arm64") == ("darwin", "arm64", 7.0, "Apple M2 Pro", None)
    assert hosts.facts(linux, "Linux", "x86_64") == ("linux", "x86_64", 16461000 / 2**20, None, 12.0)
    assert hosts.facts(nothing, "Plan9", "mips") == ("plan9", "mips", 0.0, None, None)
    rows = hosts.described(spark.createDataFrame([hosts.facts(mac, "Darwin", "arm64"), hosts.facts(linux, "Linux", "x86_64"), hosts.facts(nothing, "Linux", "x")], hosts.FACTS)).collect()
    assert [(r.profile, r.ram_gb, r.nvidia_vram_gb, r.asr_model) for r in rows] == [("low-mac", 7.0, None, "small"), ("high-gpu", 15.7, 12.0, "large-v3"), ("tiny", 0.0, None, "tiny")]
    assert hosts.field(rows[0], "compute_type") == "int8" and "Apple M2 Pro" in hosts.as_text(rows[0]) and json.loads(hosts.as_json(rows[1]))["device"] == "cuda"
    assert hosts.default(lambda: rows[0], "device", "x") == "cpu" and hosts.default(lambda: 1 / 0, "device", "x") == "x"
    with pytest.raises(hosts.UnknownField):
        hosts.field(rows[0], "colour")
    assert hosts.detect(spark, linux).os
    found = hosts.of_executors(spark, 3, linux).collect()
    assert [(r.profile, r.ram_gb) for r in found] == [("high-gpu", 15.7)] and found[0].host


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "my_talk.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nhi\n")
    (tmp_path / "in" / "none.json").write_text("[]")
    out = tmp_path / "out"
    assert cli.main(["knowledge", "--subtitles", str(tmp_path / "in"), "--out-dir", str(out), "--model", "", "--date", "2024-01-01", "--packages"], spark) == 0
    page = (out / "my_talk.srt" / "knowledge.html").read_text()
    assert "<title>my talk</title>" in page and "segments=1 model=none" in page and (out / "none.json" / "cards.csv").read_bytes() == b"question,answer,tags,timestamp,source\r\n"
    assert cli.main(["knowledge", "--subtitles", str(tmp_path / "no"), "--out-dir", "x"], spark) == 2
    assert cli.main(["frames", "--video", str(tmp_path / "no"), "--out-dir", "x"], spark) == 2
    assert cli.main(["profile", "--key", "colour"], spark) == 2 and cli.main(["profile", "--key", "os"], spark) == 0
    (tmp_path / "c.csv").write_text("question,answer,tags,timestamp,source\nq,a,,,s\n")
    assert cli.main(["deck", "--csv", str(tmp_path / "c.csv"), "--out", str(tmp_path / "d.apkg")], spark) == 0 and zipfile.is_zipfile(tmp_path / "d.apkg")
    (tmp_path / "v.mp4").write_bytes(b"")
    assert cli.main(["transcribe", "--video", str(tmp_path / "v.mp4"), "--out-dir", str(out)], spark) == 3
    assert "not installed: faster_whisper" in capsys.readouterr().err


def test_drop_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nhi\n")
    query = drop_folder.watch_srt(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert query.awaitTermination(60)
    assert [tuple(r)[:2] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a.srt", "[00:01] hi")]


def test_sql_functions(spark):
    X.register(spark)
    assert tuple(spark.sql("SELECT mmss(3661.5D), timecode(1.0005D, '.')").first()) == ("61:01", "00:00:01.000")


@pytest.mark.parametrize("limit", [1, 15, 8000])
def test_transcript_prefix(spark, limit):
    rows = spark.createDataFrame([("v", i, float(i), i + 1.0, "ab" * i) for i in range(20)], "video_id string, idx int, start double, end double, text string")
    whole = segments.transcript(rows).first().raw_text
    assert segments.transcript(rows, limit).first().raw_text == whole[:limit]


@pytest.mark.parametrize("limit", [8, 9, 10, 20])
def test_transcript_cut_at_a_separator(spark, limit):
    """A line that begins right after the cut still brings the newline before it."""
    rows = spark.createDataFrame([("v", i, 0.0, 0.0, "a") for i in range(4)], "video_id string, idx int, start double, end double, text string")
    assert segments.transcript(rows, limit).first().raw_text == "\n".join(["[00:00] a"] * 4)[:limit]
