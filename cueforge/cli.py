"""The commands: `python -m cueforge.cli COMMAND ...`. Exit codes: 0 done; 2 an input, key or server is missing; 3 a library is missing."""

import argparse
import datetime
import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cueforge.functions import text as X
from cueforge.operators import analysis, captions, cards, decks, hosts, metrics, overlaps, profiles, render, segments
from cueforge.sinks import files, packages
from cueforge.sinks.video_files import write_files
from cueforge.sources import media, subtitles

HOST = "http://localhost:11434"


class Missing(Exception):
    """An input, a key or a server that is not there."""


def say(text: str) -> None:
    print(text, file=sys.stderr)


def _present(path: str, what: str) -> str:
    if not os.path.exists(path):
        raise Missing(f"{what} not found: {path}")
    return path


def _videos(spark: SparkSession, path: str):
    return spark.createDataFrame([(os.path.splitext(os.path.basename(path))[0], os.path.abspath(path))], "video_id string, path string")


def _captions(spark: SparkSession, o, files_):
    """Visual cues of the files whose names, but for what follows the last dot, are those of subtitle files; one file goes with one file whatever their names."""
    seen = subtitles.read_subtitles(spark, _present(o.captions, "captions"))
    if os.path.isfile(o.captions) and os.path.isfile(o.subtitles):
        return seen.withColumn("video_id", F.lit(os.path.basename(o.subtitles)))
    stem = F.regexp_replace("video_id", "(?<=.)\\.[^.]*$", "")
    return seen.withColumn("stem", stem).drop("video_id").join(files_.withColumn("stem", stem), "stem").select("video_id", "idx", "start", "end", "text")


def knowledge(spark: SparkSession, o) -> None:
    """Documents, pages and cards of every subtitle file under a path."""
    _present(o.subtitles, "subtitles")
    template = subtitles.read_template(_present(o.template, "template")) if o.template else render.TEMPLATE
    counted = metrics.RunMetrics()
    rows = subtitles.read_subtitles(spark, o.subtitles, o.vtt, counted)
    files_ = spark.read.format("binaryFile").load(o.subtitles).select(F.element_at(F.split("path", "/"), -1).alias("video_id"))
    if o.captions:
        rows = overlaps.both_paths(rows, _captions(spark, o, files_))
    own = files_.join(segments.summaries(rows), "video_id", "left")
    own = own.withColumns({"raw_text": F.coalesce("raw_text", F.lit("")), "duration": F.coalesce("duration", F.lit(0.0)), "n_segments": F.coalesce("n_segments", F.lit(0)), "source": F.col("video_id"), "title": F.lit(o.title).cast("string")})
    client = (lambda: analysis.HttpClient(o.host, o.model)) if o.model else None
    fields = analysis.analyse(own, o.lang, o.format, client, o.model, os.path.join(o.out_dir, ".answers"), counted)
    names = {}
    documents = render.filled(own.join(fields, "video_id"), o.model or "none", o.date or datetime.date.today().isoformat(), template)
    if o.format != "csv":
        names["markdown"] = "knowledge.md"
    if o.format in ("html", "all"):
        documents, names["html"] = render.pages(documents), "knowledge.html"
    if o.format in ("csv", "all"):
        found = cards.qa_cards(fields.select("video_id", "qa"))
        made = cards.card_rows(cards.timed(found, rows) if o.card_times else found, own.select("video_id", "source"))
        documents, names["document"] = documents.join(files.cards_csv(made, own), "video_id"), "cards.csv"
        if o.packages:
            noted = cards.notes(made, X.title_of(F.col("source")), keep=["video_id", "ord"]).join(own.select("video_id", X.title_of(F.col("source")).alias("deck")), "video_id")
            documents, names["package"] = documents.join(packages.packages(noted, int(time.time())), "video_id", "left"), "cards.apkg"
    written = write_files(documents, o.out_dir, names)
    say(f"[ok] {written} files -> {o.out_dir}; " + ", ".join(f"{k}={n}" for k, n in counted.told().items()))


def frames(spark: SparkSession, o) -> None:
    """Frames of a video and their manifest."""
    videos = _videos(spark, _present(o.video, "video"))
    spaced = segments.even_spacing(media.extracted_frames(videos, o.out_dir, o.interval, o.fps))
    write_files(media.manifests(spaced, videos, o.interval, o.fps), o.out_dir, {"document": "frames.json"})


def caption(spark: SparkSession, o) -> None:
    """Captions of a video's frames by a vision model."""
    videos = _videos(spark, _present(o.video, "video"))
    describer, host, model = captions.HttpDescriber, o.host, o.model
    if not describer(host, model).reachable():
        raise Missing(f"no answer from {o.host}")
    frames_ = media.extracted_frames(videos, os.path.join(o.out_dir, "frames"), o.interval, o.fps)
    frames_.write.mode("overwrite").parquet(os.path.join(o.out_dir, ".frames"))  # videos are taken apart once
    spaced = segments.even_spacing(spark.read.schema(frames_.schema).parquet(os.path.join(o.out_dir, ".frames")))
    pictures = spaced.join(media.images(spark, os.path.join(o.out_dir, "frames", "*", "*.jpg")), "file")
    found = captions.captioned(pictures, lambda: describer(host, model), o.interval)
    found.write.mode("overwrite").parquet(os.path.join(o.out_dir, ".captions"))  # the model is asked once
    found = spark.read.parquet(os.path.join(o.out_dir, ".captions"))
    texts = files.srt(found, videos).join(files.captions_json(found, videos).withColumnRenamed("document", "json"), "video_id")
    texts = texts.join(media.manifests(spaced, videos, o.interval, o.fps).withColumnRenamed("document", "frames"), "video_id")
    say(f"[ok] {write_files(texts, o.out_dir, {'document': 'captions.srt', 'json': 'captions.json', 'frames': 'frames.json'})} files -> {o.out_dir}")


def transcribe(spark: SparkSession, o) -> None:
    """Subtitles of a video's speech."""
    videos = _videos(spark, _present(o.video, "video"))
    own = hosts.detect(spark)
    model, device, compute = o.model or own.asr_model, o.device or own.device, o.compute_type or own.compute_type
    heavy = spark.range(1).select(profiles.heavy_warning(F.lit(model), F.lit(own.ram_gb), F.lit(own.profile))).first()[0]
    if heavy:
        say(f"[warn] model '{model}' may need more memory than {own.ram_gb} GB; '{own.asr_model}' suits profile {own.profile}")
    sounds = media.extracted_audio(videos, os.path.join(o.out_dir, "audio"))
    recognizer = captions.WhisperRecognizer
    getattr(recognizer, "check", lambda: None)()
    found = captions.transcribed(sounds, lambda: recognizer(model, device, compute), o.language)
    found.write.mode("overwrite").parquet(os.path.join(o.out_dir, ".subtitles"))
    found = spark.read.parquet(os.path.join(o.out_dir, ".subtitles"))
    cues, about = captions.cues_of(found), captions.files_of(found)
    texts = files.srt(cues, about).withColumnRenamed("document", "srt").join(files.vtt(cues, about).withColumnRenamed("document", "vtt"), "video_id").join(files.subtitles_json(cues, about).withColumnRenamed("document", "json"), "video_id")
    say(f"[ok] {write_files(texts, o.out_dir, {'srt': 'subtitles.srt', 'vtt': 'subtitles.vtt', 'json': 'subtitles.json'})} files -> {o.out_dir}")


def deck(spark: SparkSession, o) -> None:
    """A deck package of a card file."""
    rows = subtitles.read_cards(spark, _present(o.csv, "csv")).coalesce(1).withColumn("ord", F.monotonically_increasing_id())  # one file's rows in order
    notes = cards.notes(rows, o.deck, keep=["ord"]).withColumns({"video_id": F.lit(o.deck), "deck": F.lit(o.deck)})
    n = packages.write_package(notes, os.path.abspath(o.out), int(time.time()))
    say(f"[ok] {n} notes -> {o.out}")


def merge(spark: SparkSession, o) -> None:
    """The notes of a card file, merged by question into a table of notes."""
    rows = subtitles.read_cards(spark, _present(o.csv, "csv")).coalesce(1).withColumn("ord", F.monotonically_increasing_id())
    table = decks.NoteTable(spark, o.table)
    version = table.merge(cards.notes(rows, o.deck, by_position=False, keep=["ord"]))
    say(f"[ok] version {version} of {o.table}: {table.read().count()} notes")


def profile(spark: SparkSession, o) -> None:
    """The profile of this machine, or a line of JSON for each host of the cluster's executors."""
    if o.executors:
        for row in hosts.of_executors(spark).collect():
            print(json.dumps(row.asDict(), ensure_ascii=False))
        return
    own = hosts.detect(spark)
    print(hosts.field(own, o.key) if o.key else hosts.as_json(own) if o.json else hosts.as_text(own))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cueforge", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(run, **options) -> None:
        sub = commands.add_parser(run.__name__, help=run.__doc__)
        sub.set_defaults(run=run)
        for name, given in options.items():
            sub.add_argument("--" + name.replace("_", "-"), **given)

    need, server = {"required": True}, {"default": os.environ.get("OLLAMA_HOST", HOST)}
    command(knowledge, subtitles=need, out_dir=need, captions={}, template={}, format={"choices": list(analysis.NEEDED), "default": "all"}, model={"default": os.environ.get("CUEFORGE_TEXT_MODEL", "openbmb/minicpm5:Q4_K_M")}, title={}, lang={"choices": list(analysis.INSTRUCTIONS), "default": "zh"}, host=server, date={}, vtt={"action": "store_true"}, card_times={"action": "store_true"}, packages={"action": "store_true"})
    command(frames, video=need, out_dir=need, interval={"type": float, "default": 2.0}, fps={"type": float})
    command(caption, video=need, out_dir=need, model={"default": "openbmb/minicpm-v4.6:latest"}, interval={"type": float, "default": 2.0}, fps={"type": float}, host=server)
    command(transcribe, video=need, out_dir=need, model={}, language={"default": "zh"}, device={}, compute_type={})
    command(deck, csv=need, out=need, deck={"default": "视频知识卡"})
    command(merge, csv=need, table=need, deck={"default": "视频知识卡"})
    command(profile, json={"action": "store_true"}, key={}, executors={"action": "store_true"})
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    o = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("cueforge").getOrCreate()
    try:
        o.run(spark, o)
    except (Missing, hosts.UnknownField) as e:
        say(f"[err] {e.args[0]}")
        return 2
    except ImportError as e:
        say(f"[err] not installed: {e.name}")
        return 3
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
