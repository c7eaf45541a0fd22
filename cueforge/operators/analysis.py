"""Analysis of transcripts: prompts, inference clients, fallback, wide table."""

import json
import re
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueforge.functions import text as X
from cueforge.operators.metrics import RunMetrics, watched

FIELDS = ("summary", "timeline", "key_points", "qa", "glossary")
PROMPT_CHARACTERS = 8000
NEEDED = {"knowledge": FIELDS, "html": FIELDS, "csv": ("qa",), "all": FIELDS}
INSTRUCTIONS = {
    "zh": ("请用三到五句话概括下面的字幕，不要照抄。", "列出最多八个关键时间点，每行写作 `- [mm:ss] 事件`。", "列出最多八个要点，每行以 `- ` 开头。", "写六到十组问答，每组一行 `Q: ` 和一行 `A: `。", "列出术语及解释，每行写作 `- 术语: 解释`。"),
    "en": ("Summarise the subtitles below in three to five sentences of your own.", "List up to eight key moments, each as `- [mm:ss] event`.", "List up to eight key points, each starting with `- `.", "Write six to ten questions with answers, as lines `Q: ` and `A: `.", "List terms with explanations, each as `- term: explanation`."),
}
LABELS = {"zh": "字幕", "en": "subtitles"}
# What stands in for an answer of a model that can't be reached.
FALLBACK_SUMMARY = ("(本地模型不可用，原始字幕共 ", " 行)")
FALLBACK_TIMELINE = "- [未分段] "
FALLBACK_KEY_POINTS = "- 原始字幕见下方；启用 Ollama 文本模型可生成结构化要点"
FALLBACK_QA = "- Q: (启用本地模型自动生成问答)\n  A: ..."
FALLBACK_GLOSSARY = "- (启用本地模型自动生成术语表)"
NOTHING = "(无)"


class InferenceClient(Protocol):
    def ask(self, prompt: str) -> str | None: ...


class EchoClient:
    """Deterministic stand-in: answers with the prompt's first line in a fence."""

    def ask(self, prompt: str) -> str | None:
        return "```text\n" + prompt.split("\n", 1)[0] + "\n```"


class HttpClient:
    """A text model behind HTTP; None where it can't be reached."""

    def __init__(self, host: str, model: str, timeout: float = 180):
        self.host, self.model, self.timeout = host, model, timeout

    def ask(self, prompt: str) -> str | None:
        try:
            return self.generate(prompt=prompt, options={"temperature": 0.3})
        except OSError:
            return None

    def generate(self, **fields) -> str:
        """One answer, without a stream and without thinking aloud."""
        body = json.dumps({"model": self.model, "stream": False, "think": False} | fields).encode()
        request = urllib.request.Request(f"{self.host}/api/generate", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.loads(answer.read()).get("response", "")

    def reachable(self, timeout: float = 10) -> bool:
        """Whether the server answers at all."""
        try:
            with urllib.request.urlopen(f"{self.host}/api/tags", timeout=timeout) as answer:
                json.loads(answer.read())
        except (OSError, ValueError):
            return False
        return True


def prompts(spark: SparkSession) -> DataFrame:
    rows = [(lang, i, field, text, LABELS[lang]) for lang, texts in INSTRUCTIONS.items() for i, (field, text) in enumerate(zip(FIELDS, texts, strict=True))]
    return spark.createDataFrame(rows, "lang string, ord int, field string, instruction string, label string")


def fan_out(transcripts: DataFrame, lang: str, wanted: str = "all") -> DataFrame:
    """transcripts(video_id, raw_text) -> a row for each field that the output needs (csv: one in five), with its prompt. Unknown languages take English tasks."""
    tasks = prompts(transcripts.sparkSession).filter((F.col("lang") == (lang if lang in INSTRUCTIONS else "en")) & F.col("field").isin(*NEEDED[wanted]))
    text = F.concat("instruction", F.lit("\n\n"), "label", F.lit(":\n"), F.substring("raw_text", 1, PROMPT_CHARACTERS))
    return transcripts.crossJoin(F.broadcast(tasks)).select("video_id", "ord", "field", text.alias("prompt"))  # ten tasks at most


def infer(tasks: DataFrame, client: Callable[[], InferenceClient]) -> DataFrame:
    """tasks(video_id, field, prompt) -> (video_id, field, response). Write the result before it is used twice: a model is asked once."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = client()
        for batch in batches:
            yield pd.DataFrame({"video_id": batch["video_id"], "field": batch["field"], "response": [one.ask(p) for p in batch["prompt"]]})

    kind = tasks.schema["video_id"].dataType.simpleString()
    return tasks.select("video_id", "field", "prompt").mapInPandas(ask, f"video_id {kind}, field string, response string")


def answers(tasks: DataFrame, client: Callable[[], InferenceClient], model: str, folder: str) -> DataFrame:
    """tasks(video_id, field, prompt) -> (video_id, field, response), kept in folder by model and prompt: what is there is not asked again, and what is used twice is asked once. A prompt without an answer has a null response; it is not kept, so the next run asks it again."""
    spark = tasks.sparkSession
    keyed = tasks.withColumn("key", F.sha2(F.concat_ws("\n", F.lit(model), "prompt"), 256))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    kept = spark.read.schema("key string, response string")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        new = keyed.join(kept.parquet(folder).filter("response is not null"), "key", "left_anti")
    else:
        new = keyed
    once = new.dropDuplicates(["key"]).select(F.col("key").alias("video_id"), "field", "prompt")
    infer(once, client).filter("response is not null").select(F.col("video_id").alias("key"), "response").write.mode("append").parquet(folder)
    known = kept.parquet(folder).groupBy("key").agg(F.max("response").alias("response"))
    return keyed.join(known, "key", "left").select("video_id", "field", "response")


def analyse(transcripts: DataFrame, lang: str, wanted: str, client: Callable[[], InferenceClient] | None, model: str, folder: str, metrics: RunMetrics | None = None) -> DataFrame:
    """transcripts(video_id, raw_text) -> (video_id, the five fields). Without a client, or where it says that its server can't be reached, no model is asked. metrics: counts answers_accepted, answers_refused and answers_missing."""
    one = client() if client else None
    if one is None or not getattr(one, "reachable", lambda: True)():
        return transcripts.select("video_id", *[c.alias(f) for f, c in fallback(F.col("raw_text")).items()])
    found = answers(fan_out(transcripts, lang, wanted), client, model, folder)
    good, none = F.coalesce(F.length(X.strip(F.col("response"))) > 3, F.lit(False)), F.col("response").isNull()
    return wide(transcripts, watched(metrics, found, answers_accepted=good, answers_refused=~good & ~none, answers_missing=none))


def fallback(raw_text: Column) -> dict[str, Column]:
    first = F.coalesce(F.get(X.splitlines(raw_text), F.lit(0)), F.lit(""))
    return {
        "summary": F.concat(F.lit(FALLBACK_SUMMARY[0]), X.line_count(raw_text).cast("string"), F.lit(FALLBACK_SUMMARY[1])),
        "timeline": F.concat(F.lit(FALLBACK_TIMELINE), F.substring(first, 1, 60)),
        "key_points": F.lit(FALLBACK_KEY_POINTS),
        "qa": F.lit(FALLBACK_QA),
        "glossary": F.lit(FALLBACK_GLOSSARY),
    }


def accepted(response: Column) -> Column:
    """An answer of more than three characters without its fence; null for any other."""
    return F.when(F.length(X.strip(response)) > 3, X.strip_fence(response))


def wide(transcripts: DataFrame, answers: DataFrame) -> DataFrame:
    """(video_id, the five fields): accepted answers, or the fallback where there is none."""
    table = answers.groupBy("video_id").pivot("field", list(FIELDS)).agg(F.first("response"))
    both = transcripts.select("video_id", "raw_text").join(table, "video_id", "left")
    default = fallback(F.col("raw_text"))
    return both.select("video_id", *[F.coalesce(accepted(F.col(f)), default[f]).alias(f) for f in FIELDS])


def shown(field: Column) -> Column:
    return F.coalesce(F.nullif(field, F.lit("")), F.lit(NOTHING))


def as_markdown(value: Column) -> Column:
    """What a field shows, by its form: a JSON array as a list (texts, or objects as `question: answer`), a JSON object as a list of its entries, anything else as it is; what is empty as nothing."""
    v = F.try_parse_json(value)
    part = lambda i, *keys: F.coalesce(*[F.nullif(F.try_variant_get(i, f"$.{k}", "string"), F.lit("")) for k in keys], F.lit(""))
    item = lambda i: F.when(F.schema_of_variant(i) == "STRING", F.try_variant_get(i, "$", "string")).otherwise(F.concat(part(i, "q", "question"), F.lit(": "), part(i, "a", "answer")))
    bullets = F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda i: F.concat(F.lit("- "), item(i))), "\n")
    entries = F.map_entries(F.from_json(value, "map<string,string>"))
    pairs = F.array_join(F.transform(entries, lambda e: F.concat(F.lit("- **"), e["key"], F.lit("**: "), F.coalesce(e["value"], F.lit("None")))), "\n")
    kind = F.schema_of_variant(v)
    return shown(F.when(kind.startswith("ARRAY"), bullets).when(kind.startswith("OBJECT"), pairs).otherwise(value))


@F.pandas_udf(T.StringType())
def first_object(texts: pd.Series) -> pd.Series:
    """The first stretch from an opening brace to where as many are closed that is a JSON object; braces within strings count too. Braces are paired in one pass."""

    def found(text: str | None) -> str | None:
        open_, closed, opening = [], {}, re.compile(r'\{\s*["}]')
        for hit in re.finditer("[{}]", text or ""):
            if hit[0] == "{":
                open_.append(hit.start())
            elif open_:
                closed[open_.pop()] = hit.end()
        for start in sorted(closed):
            if not opening.match(text, start):
                continue
            try:
                json.loads(text[start : closed[start]])
                return text[start : closed[start]]
            except (ValueError, RecursionError):
                pass
        return None

    return texts.map(found)
