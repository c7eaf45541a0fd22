"""Segments from pictures and from sound: models behind interfaces, and stand-ins that need none."""

import base64
from collections.abc import Callable, Iterable, Iterator
from importlib.util import find_spec
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueforge.functions import text as X
from cueforge.operators.analysis import HttpClient
from cueforge.operators.segments import intervals

FRAME_PROMPT = "用不超过四十个字的中文说明这一帧画面：主要物体、画面文字、动作和图表。只写说明本身，不要写思考过程，也不要用英文。"


class Describer(Protocol):
    def describe(self, image: bytes) -> str: ...


class Spoken(NamedTuple):
    start: float
    end: float
    text: str


class Recognizer(Protocol):
    """Speech of one sound file in order, and (language, its probability, duration). Silence is left out by the recognizer."""

    def transcribe(self, path: str, language: str | None) -> tuple[Iterable[Spoken], tuple[str, float, float]]: ...


class SizeDescriber:
    """Stand-in: says how many bytes an image has."""

    def describe(self, image: bytes) -> str:
        return f"<think>{image[:4]!r}</think>\n{len(image)} bytes"


class HttpDescriber(HttpClient):
    """A vision model behind HTTP. What goes wrong is raised: the task is tried again, as a caption can't be made up."""

    def __init__(self, host: str, model: str, timeout: float = 120):
        super().__init__(host, model, timeout)

    def describe(self, image: bytes) -> str:
        return self.generate(prompt=FRAME_PROMPT, images=[base64.b64encode(image).decode()], options={"temperature": 0.2, "num_predict": 160})


class WhisperRecognizer:
    """Speech recognition by an installed library; it is imported where a task first needs it."""

    @staticmethod
    def check() -> None:
        """An ImportError where the library is missing, before any task starts."""
        if not find_spec("faster_whisper"):
            raise ImportError("not installed", name="faster_whisper")

    def __init__(self, size: str, device: str, compute_type: str):
        from faster_whisper import WhisperModel

        self.model = WhisperModel(size, device=device, compute_type=compute_type)

    def transcribe(self, path: str, language: str | None):
        found, info = self.model.transcribe(path, language=None if language == "auto" else language, beam_size=5, word_timestamps=True, vad_filter=True)
        return (Spoken(s.start, s.end, s.text) for s in found), (info.language, info.language_probability, info.duration)


def describe(frames: DataFrame, client: Callable[[], Describer], requests: int | None = None, profile: ResourceProfile | None = None) -> DataFrame:
    """frames(video_id, idx, t, content) -> (video_id, idx, t, text), each frame with its own caption, cleaned of thinking. requests: how many run at a time, at most. profile: what a task asks of an executor (resources.task_profile). Write the result before it is used twice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = client()
        for batch in batches:
            yield batch[["video_id", "idx", "t"]].assign(said=[one.describe(bytes(c)) for c in batch["content"]])

    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    rows = frames.select("video_id", "idx", "t", "content")
    rows = rows.repartition(requests, "video_id", "idx") if requests else rows
    said = rows.mapInPandas(run, f"video_id {kinds['video_id']}, idx {kinds['idx']}, t double, said string", profile=profile)
    return said.select("video_id", "idx", "t", X.without_thinking(F.col("said")).alias("text"))


def captioned(frames: DataFrame, client: Callable[[], Describer], interval: float) -> DataFrame:
    """frames(video_id, idx, t, content) -> segments (video_id, idx, start, end, text)."""
    return intervals(describe(frames, client), interval).select("video_id", "idx", "start", "end", "text")


def projected(spoken: DataFrame) -> DataFrame:
    """spoken(video_id, idx, start, end, text, ...) -> segments: times to a thousandth, stripped texts, nothing else."""
    return spoken.select("video_id", "idx", X.thousandth(F.col("start")).alias("start"), X.thousandth(F.col("end")).alias("end"), X.strip(F.col("text")).alias("text"))


def transcribed(sounds: DataFrame, recognizer: Callable[[], Recognizer], language: str = "zh", profile: ResourceProfile | None = None) -> DataFrame:
    """sounds(video_id, path) -> for each file a row of language, language_probability and duration, with a null idx, and its segments; one recognizer a task. files_of and cues_of tell them apart. profile: what a task asks of an executor (resources.task_profile). Write the result before it is used twice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = recognizer()
        for batch in batches:
            for video, path in zip(batch["video_id"], batch["path"], strict=True):
                found, info = one.transcribe(path, language)
                rows = [(video, i, float(s.start), float(s.end), s.text, None, None, None) for i, s in enumerate(found)]
                frame = pd.DataFrame([(video, None, None, None, None, *info), *rows], columns=["video_id", "idx", "start", "end", "text", "language", "language_probability", "duration"])
                yield frame.astype({"idx": "Int32"})

    kind = sounds.schema["video_id"].dataType.simpleString()
    spoken = sounds.select("video_id", "path").mapInPandas(run, f"video_id {kind}, idx int, start double, end double, text string, language string, language_probability double, duration double", profile=profile)
    about = ("language", "language_probability", "duration")
    return spoken.select("video_id", "idx", X.thousandth(F.col("start")).alias("start"), X.thousandth(F.col("end")).alias("end"), X.strip(F.col("text")).alias("text"), *about)


def files_of(found: DataFrame) -> DataFrame:
    """transcribed rows -> (video_id, language, language_probability, duration), a row a file, whether anything is said in it or not."""
    return found.filter("idx is null").select("video_id", "language", "language_probability", "duration")


def cues_of(found: DataFrame) -> DataFrame:
    """transcribed rows -> segments."""
    return found.filter("idx is not null").select("video_id", "idx", "start", "end", "text")
