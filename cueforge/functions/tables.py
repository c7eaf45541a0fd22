"""Table functions for SQL: `FROM docs, LATERAL srt_cues(docs.document)`."""

from collections.abc import Iterator

import regex
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

_CUE = T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("text", T.StringType())])
_TIMES = regex.compile(r"([0-9]+):([0-9]+):([0-9]+)[,.]([0-9]+)\s*-->\s*([0-9]+):([0-9]+):([0-9]+)[,.]([0-9]+)", regex.ASCII)


@udtf
class SrtCues:
    """The cues of one SRT document, by the rules of subtitles.srt_segments: idx is the block's place."""

    @staticmethod
    def analyze(document: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(document.dataType, T.StringType | T.NullType):
            raise ValueError(f"srt_cues takes a text, not {document.dataType.simpleString()}")
        return AnalyzeResult(_CUE)

    def eval(self, document: str | None) -> Iterator[tuple]:
        text = (document or "").replace("\r\n", "\n").replace("\r", "\n").strip()
        for idx, block in enumerate(regex.split(r"\n[ \t\n\x0b\f\r]*\n", text)):
            lines = [x for x in block.splitlines() if x.strip()]
            found = _TIMES.match(lines[1]) if len(lines) >= 3 else None
            if found:
                g = [float(x) for x in found.groups()]
                start, end = (g[i] * 3600 + g[i + 1] * 60 + g[i + 2] + g[i + 3] / 1000 for i in (0, 4))
                yield idx, start, end, " ".join(lines[2:])


def register(spark: SparkSession) -> None:
    spark.udtf.register("srt_cues", SrtCues)
