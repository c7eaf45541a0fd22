"""Documents: a template filled in order, and its lines as HTML."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueforge.functions import text as X
from cueforge.operators.analysis import FIELDS, shown
from cueforge.operators.segments import joined

KEYS = ("title", "source", "duration", "date", "summary", "timeline", "key_points", "qa", "glossary", "meta")
# Fixed value: the default template.
TEMPLATE = """# {{title}}

> 来源: `{{source}}` | 时长: {{duration}} | 生成日期: {{date}}

## 摘要
{{summary}}

## 时间轴
{{timeline}}

## 核心知识点
{{key_points}}

## 知识问答 (Q&A)
{{qa}}

## 术语表
{{glossary}}

## 元数据
{{meta}}
"""
_STYLE = "body{width:min(46rem,92vw);margin:2rem auto;font:1.05rem/1.6 Georgia,serif}h2{border-bottom:1px solid #ccc}a.ts{font-variant-numeric:tabular-nums}"
#: Faces of a card, and their look.
FRONT = "<p class='ask'>{{Question}}</p><p class='when'>{{Timestamp}}</p>"
BACK = "{{FrontSide}}<hr id=answer><div class='reply'>{{Answer}}</div><p class='from'>{{Source}}</p>"
CARD_STYLE = ".card{font:1.1rem sans-serif}.ask{font-weight:bold;text-align:center}.when,.from{font-size:.8rem;opacity:.7}"


def fill(template: Column, values: dict[str, Column]) -> Column:
    """Each {{key}} replaced in KEYS' order, literally; so a value put in early is searched for later keys."""
    for key in KEYS:
        if key in values:
            template = F.replace(template, F.lit("{{" + key + "}}"), F.coalesce(values[key], F.lit("")))
    return template


def html_lines(lines: DataFrame, anchors: bool = False) -> DataFrame:
    """lines(video_id, n, line) -> (video_id, n, html): headings, list items in one list for each run, paragraphs, empty lines. Escaping comes first, so a quote mark is plain text. anchors: an item is the target of the link to its first time."""
    s = X.html_escape(F.col("line"))
    level = F.length(F.regexp_extract(s, "^(#{1,6}) ", 1))
    rows = lines.select("video_id", "n", s.alias("s"), level.alias("level"), s.startswith("- ").alias("item"))
    order = Window.partitionBy("video_id").orderBy("n")
    opens = F.when(F.col("item") & ~F.coalesce(F.lag("item").over(order), F.lit(False)), "<ul>\n").otherwise("")
    closes = F.when(F.col("item") & ~F.coalesce(F.lead("item").over(order), F.lit(False)), "\n</ul>").otherwise("")
    tag = F.col("level").cast("string")
    time = F.regexp_extract("s", "\\[(\\d{2}:\\d{2})\\]", 1)
    identity = F.when(F.lit(anchors) & (time != ""), F.concat(F.lit(" id='t-"), time, F.lit("'"))).otherwise("")
    body = (
        F.when(F.col("level") > 0, F.concat(F.lit("<h"), tag, F.lit(">"), F.expr("substring(s, level + 2)"), F.lit("</h"), tag, F.lit(">")))
        .when(F.col("item"), F.concat(F.lit("<li"), identity, F.lit(">"), X.linkify(F.expr("substring(s, 3)")), F.lit("</li>")))
        .when(X.strip(F.col("s")) == "", F.lit(""))
        .otherwise(F.concat(F.lit("<p>"), X.bold(F.col("s")), F.lit("</p>")))
    )
    return rows.select("video_id", "n", F.concat(opens, body, closes).alias("html"))


def html_bodies(lines: DataFrame, anchors: bool = False) -> DataFrame:
    """(video_id, body): a document's lines joined."""
    return joined(html_lines(lines, anchors), "video_id", "n", "html", "\n", "body")


def pages(documents: DataFrame, anchors: bool = False) -> DataFrame:
    """documents(video_id, title, markdown, ...) -> with `html`, the page of the markdown; a source that was escaped for the markdown is escaped once more."""
    lines = documents.select("video_id", F.posexplode(X.splitlines(F.col("markdown"))).alias("n", "line"))
    bodies = html_bodies(lines, anchors)
    return documents.join(bodies, "video_id", "left").withColumn("html", html_page(F.col("title"), F.coalesce("body", F.lit("")))).drop("body")


#: What stands before a page's title, between title and body, and after the body.
HEAD = ("<!doctype html><html lang='zh'><head><meta charset='utf-8'>\n<title>", f"</title>\n<style>\n{_STYLE}</style></head><body>\n")
TAIL = "\n</body></html>"


def html_page(title: Column, body: Column) -> Column:
    return F.concat(F.lit(HEAD[0]), X.html_escape(title), F.lit(HEAD[1]), body, F.lit(TAIL))


def filled(videos: DataFrame, model: str, run_date: str, template: str = TEMPLATE) -> DataFrame:
    """videos(video_id, source, duration, n_segments, the five fields, title if it has one) -> (video_id, title, source, markdown)."""
    title = F.coalesce("title", X.title_of(F.col("source"))) if "title" in videos.columns else X.title_of(F.col("source"))
    values = {"title": title, "source": X.html_escape(F.col("source")), "duration": X.mmss(F.col("duration")), "date": F.lit(run_date), "meta": F.concat(F.lit("segments="), F.col("n_segments").cast("string"), F.lit(f" model={model}"))}
    values |= {f: shown(F.col(f)) for f in FIELDS}
    return videos.select("video_id", values["title"].alias("title"), "source", fill(F.lit(template), values).alias("markdown"))
