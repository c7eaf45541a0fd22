"""Every query with its SQL."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueforge.functions import tables
from cueforge.functions import text as X
from cueforge.operators import analysis as A
from cueforge.operators import captions, decks, hosts
from cueforge.operators import cards as C
from cueforge.operators import overlaps as O
from cueforge.operators import profiles as P
from cueforge.operators import render as R
from cueforge.operators import segments as S
from cueforge.operators import voice
from cueforge.plans import views as V
from cueforge.sinks import files
from cueforge.sources import subtitles

RUN_DATE, MODEL = "2024-01-01", "offline"
QUERIES, SQL = {}, {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@_query(f"WITH {V.SEGMENTS} SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY idx) AS number, \"start\", \"end\", text FROM segs")
def segments_base(spark, sf_dir):
    return S.numbered(V.segments(spark, sf_dir)).select("video_id", F.col("number").cast("long").alias("number"), "start", "end", "text")


@_query(f"WITH {V.SEGMENTS} SELECT video_id, idx, round_even(\"start\" * 1000, 0)::BIGINT AS start_ms, round_even(\"end\" * 1000, 0)::BIGINT AS end_ms FROM segs")
def segment_ms(spark, sf_dir):
    return V.segments(spark, sf_dir).select("video_id", "idx", X.milliseconds(F.col("start")).alias("start_ms"), X.milliseconds(F.col("end")).alias("end_ms"))


def _timecodes(spark, sf_dir, separator) -> DataFrame:
    return V.segments(spark, sf_dir).select("video_id", "idx", X.timecode(F.col("start"), separator).alias("start_tc"), X.timecode(F.col("end"), separator).alias("end_tc"))


_TC = "WITH {s} SELECT video_id, idx, {a} AS start_tc, {b} AS end_tc FROM segs"


@_query(_TC.format(s=V.SEGMENTS, a=V.sql_timecode('"start"'), b=V.sql_timecode('"end"')))
def srt_timecodes(spark, sf_dir):
    return _timecodes(spark, sf_dir, ",")


@_query(_TC.format(s=V.SEGMENTS, a=V.sql_timecode('"start"', "."), b=V.sql_timecode('"end"', ".")))
def vtt_timecodes(spark, sf_dir):
    return _timecodes(spark, sf_dir, ".")


_SRT = f"""SELECT video_id, string_agg(number::VARCHAR || chr(10) || {V.sql_timecode('"start"')} || ' --> ' || {V.sql_timecode('"end"')} || chr(10) || {V.sql_strip('text')} || chr(10), chr(10) ORDER BY number) AS document
 FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY idx) AS number FROM segs) GROUP BY video_id"""


@_query(f"WITH {V.SEGMENTS} {_SRT}")
def srt_document(spark, sf_dir):
    return files.srt(V.segments(spark, sf_dir))


@_query(f"""WITH {V.SEGMENTS} SELECT video_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({V.sql_timecode('"start"', '.')} || ' --> ' || {V.sql_timecode('"end"', '.')} || chr(10) || {V.sql_strip('text')} || chr(10), chr(10) ORDER BY idx) AS document FROM segs GROUP BY video_id""")
def vtt_document(spark, sf_dir):
    return files.vtt(V.segments(spark, sf_dir))


_TIMES = "^(\\d+):(\\d+):(\\d+)[,.](\\d+)\\s*-->\\s*(\\d+):(\\d+):(\\d+)[,.](\\d+)"
_AT = "regexp_extract(lines[2], '" + _TIMES + "', {i})::DOUBLE"


def _seconds(i: int) -> str:
    return f"({_AT.format(i=i)} * 3600 + {_AT.format(i=i + 1)} * 60 + {_AT.format(i=i + 2)} + {_AT.format(i=i + 3)} / 1000)"


@_query(f"""WITH {V.SEGMENTS}, docs AS ({_SRT}), parts AS (SELECT video_id, string_split_regex({V.sql_strip('document')}, '\\n\\s*\\n') AS b FROM docs),
 blocks AS (SELECT video_id, unnest(b) AS cue, generate_subscripts(b, 1) - 1 AS block FROM parts), ls AS (SELECT video_id, block, list_filter({V.sql_lines('cue')}, lambda s: {V.sql_strip('s')} <> '') AS lines FROM blocks)
 SELECT video_id, block::BIGINT AS idx, {_seconds(1)} AS "start", {_seconds(5)} AS "end", array_to_string(lines[3:], ' ') AS text FROM ls WHERE len(lines) >= 3 AND regexp_matches(lines[2], '{_TIMES}')""")
def srt_parse_roundtrip(spark, sf_dir):
    return subtitles.srt_segments(files.srt(V.segments(spark, sf_dir))).withColumn("idx", F.col("idx").cast("long"))


@_query(f"WITH {V.SEGMENTS} SELECT video_id, idx, {V.sql_mmss('\"start\"')} AS label, {V.sql_mmss('\"start\" * 100')} AS late_label FROM segs")
def mmss_labels(spark, sf_dir):
    return V.segments(spark, sf_dir).select("video_id", "idx", X.mmss(F.col("start")).alias("label"), X.mmss(F.col("start") * 100).alias("late_label"))


_RAW = f"raw AS (SELECT video_id, string_agg('[' || {V.sql_mmss('\"start\"')} || '] ' || text, chr(10) ORDER BY idx) AS raw_text FROM segs GROUP BY video_id)"


@_query(f"""WITH {V.SEGMENTS}, {V.DOCUMENT_LINES}, {_RAW}, d AS (SELECT video_id, string_agg('[' || {V.sql_mmss('idx * 10')} || '] ' || text, chr(10) ORDER BY idx) AS raw_text FROM dlines GROUP BY video_id)
 SELECT 'conversation' AS kind, video_id, substring(raw_text, 1, 8000) AS raw_text FROM raw UNION ALL SELECT 'document', video_id, substring(raw_text, 1, 8000) FROM d""")
def transcript_prefix(spark, sf_dir):
    parts = [("conversation", V.segments(spark, sf_dir)), ("document", V.document_lines(spark, sf_dir))]
    a, b = (S.transcript(s, A.PROMPT_CHARACTERS).select(F.lit(kind).alias("kind"), "video_id", "raw_text") for kind, s in parts)
    return a.unionByName(b)


@_query(f"WITH {V.SEGMENTS} SELECT c.c_custkey AS video_id, coalesce(arg_max(\"end\", idx), 0.0e0) AS duration, count(s.idx) AS n_segments FROM customer c LEFT JOIN segs s ON s.video_id = c.c_custkey GROUP BY 1")
def video_duration(spark, sf_dir):
    return S.durations(V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video_id")), V.segments(spark, sf_dir))


@_query(f"WITH {V.FRAMES} SELECT video_id, idx::BIGINT AS idx, n, t FROM spaced")
def frames_even_spacing(spark, sf_dir):
    return S.even_spacing(V.frames(spark, sf_dir)).select("video_id", F.col("idx").cast("long").alias("idx"), "n", "t")


@_query(f"WITH {V.FRAMES} SELECT video_id, idx::BIGINT AS idx, t AS \"start\", coalesce(lead(t) OVER (PARTITION BY video_id ORDER BY idx), t + 2.0e0) AS \"end\" FROM spaced")
def frame_intervals(spark, sf_dir):
    return S.intervals(S.even_spacing(V.frames(spark, sf_dir)), 2.0).select("video_id", F.col("idx").cast("long").alias("idx"), "start", "end")


_LINES_N = "(length(raw_text) - length(replace(raw_text, chr(10), '')) + 1)"
_DEFAULTS = {
    "summary": f"{_quoted(A.FALLBACK_SUMMARY[0])} || {_LINES_N}::VARCHAR || {_quoted(A.FALLBACK_SUMMARY[1])}",
    "timeline": f"{_quoted(A.FALLBACK_TIMELINE)} || substring(coalesce({V.sql_lines('raw_text')}[1], ''), 1, 60)",
    "key_points": _quoted(A.FALLBACK_KEY_POINTS),
    "qa": _quoted(A.FALLBACK_QA),
    "glossary": _quoted(A.FALLBACK_GLOSSARY),
}


@_query(f"WITH {V.SEGMENTS}, {_RAW} SELECT video_id, " + ", ".join(f"{v} AS {k}" for k, v in _DEFAULTS.items()) + " FROM raw")
def fallback_analysis(spark, sf_dir):
    raw = S.transcript(V.segments(spark, sf_dir))
    return raw.select("video_id", *[c.alias(k) for k, c in A.fallback(F.col("raw_text")).items()])


_TASKS = "tasks AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {_quoted(f)}, {_quoted(t)})" for i, (f, t) in enumerate(zip(A.FIELDS, A.INSTRUCTIONS["en"], strict=True))) + ") v(ord, field, instruction))"


@_query(f"WITH {V.SEGMENTS}, {_RAW}, {_TASKS} SELECT video_id, ord::INT AS ord, field, instruction || chr(10) || chr(10) || 'subtitles:' || chr(10) || substring(raw_text, 1, 8000) AS prompt FROM raw CROSS JOIN tasks")
def prompt_fanout(spark, sf_dir):
    return A.fan_out(S.transcript(V.segments(spark, sf_dir), A.PROMPT_CHARACTERS), "en")


def _fake(raw: DataFrame) -> DataFrame:
    """Answers with and without fences, too short, and none."""
    text = {
        "summary": F.concat(F.lit("```text\n"), F.substring("raw_text", 1, 40), F.lit("\n```")),
        "timeline": F.lit(" ok "),
        "key_points": F.concat(F.lit("\n- "), F.substring("raw_text", 1, 20), F.lit(" \n")),
        "qa": F.lit("```\n```"),
        "glossary": F.lit(None).cast("string"),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), v.alias("response")) for k, v in text.items()])
    return raw.select("video_id", F.inline(pairs))


def _sql_fence(x: str) -> str:
    return V.sql_strip(f"regexp_replace(regexp_replace({V.sql_strip(x)}, '^```[a-zA-Z]*\\s*\\n?', ''), '\\n?```\\s*$', '')")


_FAKE = {"summary": "'```text' || chr(10) || substring(raw_text, 1, 40) || chr(10) || '```'", "timeline": "' ok '", "key_points": "chr(10) || '- ' || substring(raw_text, 1, 20) || ' ' || chr(10)", "qa": "'```' || chr(10) || '```'", "glossary": "NULL::VARCHAR"}


@_query(f"WITH {V.SEGMENTS}, {_RAW} SELECT video_id, " + ", ".join(f"CASE WHEN length({V.sql_strip(v)}) > 3 THEN {_sql_fence(v)} ELSE {_DEFAULTS[k]} END AS {k}" for k, v in _FAKE.items()) + " FROM raw")
def analysis_wide(spark, sf_dir):
    raw = S.transcript(V.segments(spark, sf_dir))
    return A.wide(raw, _fake(raw))


_CARDS = f"""{V.QA_LINES}, st AS (SELECT video_id, n, {V.sql_strip('line')} AS s FROM ql), fl AS (SELECT *, lower(substring(s, 1, 2)) = 'q:' AS q, lower(substring(s, 1, 2)) = 'a:' AS a FROM st),
 g AS (SELECT *, sum(q::INT) OVER (PARTITION BY video_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS card FROM fl),
 cards AS (SELECT video_id, (card - 1)::BIGINT AS ord, arg_max({V.sql_strip('substring(s, 3)')}, n) FILTER (WHERE q) AS question, coalesce(arg_max({V.sql_strip('substring(s, 3)')}, n) FILTER (WHERE a), '') AS answer FROM g WHERE card > 0 GROUP BY video_id, card)"""


@_query(f"WITH {_CARDS} SELECT video_id, ord, question, answer, '' AS tags, '' AS \"timestamp\", 'conv' || video_id::VARCHAR || '.json' AS source FROM cards")
def qa_cards(spark, sf_dir):
    cards = C.parse_qa(V.qa_lines(spark, sf_dir))
    return C.card_rows(cards.withColumn("source", F.concat(F.lit("conv"), F.col("video_id").cast("string"), F.lit(".json"))))


@_query(f"WITH {_CARDS} SELECT video_id, ord, sha256(question || '|' || ord::VARCHAR) AS guid FROM cards")
def card_ordinals(spark, sf_dir):
    return C.parse_qa(V.qa_lines(spark, sf_dir)).select("video_id", "ord", F.sha2(F.concat_ws("|", "question", F.col("ord").cast("string")), 256).alias("guid"))


@_query(f"SELECT source AS name, ({X.DECK_ID_BASE} + coalesce(list_sum([unicode(c)::BIGINT FOR c IN string_split(source, '')]), 0))::BIGINT % {X.DECK_ID_MODULUS} AS deck_id FROM (SELECT DISTINCT source FROM documents)")
def deck_ids(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct().select("name", X.deck_id(F.col("name")).alias("deck_id"))


@_query(f"SELECT page_id, {V.sql_escape('html')} AS escaped FROM pages")
def html_escape(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", X.html_escape(F.col("html")).alias("escaped"))


@_query(f"""WITH {V.SEGMENTS} SELECT video_id, idx, regexp_replace('[' || {V.sql_mmss('"start" * 40')} || '] ' || text, '\\[(\\d{{2}}:\\d{{2}})\\]', '[<a class=''ts'' href=''#t-\\1''>\\1</a>]', 'g') AS item FROM segs""")
def linkify_timestamps(spark, sf_dir):
    item = F.concat(F.lit("["), X.mmss(F.col("start") * 40), F.lit("] "), "text")
    return V.segments(spark, sf_dir).select("video_id", "idx", X.linkify(item).alias("item"))


def _sql_fill(values: dict[str, str]) -> str:
    out = _quoted(R.TEMPLATE)
    for k in R.KEYS:
        out = f"replace({out}, '{{{{{k}}}}}', {values[k]})"
    return out


_SOURCE = "'conv_' || d.video_id::VARCHAR || '.json'"
_VALUES = {"title": "'conv ' || d.video_id::VARCHAR", "source": V.sql_escape(_SOURCE), "duration": V.sql_mmss("duration"), "date": _quoted(RUN_DATE), "meta": f"'segments=' || n_segments::VARCHAR || ' model={MODEL}'"} | _DEFAULTS


def _knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = S.summaries(V.segments(spark, sf_dir)).withColumn("source", F.concat(F.lit("conv_"), F.col("video_id").cast("string"), F.lit(".json")))
    return R.filled(videos.select("*", *[c.alias(k) for k, c in A.fallback(F.col("raw_text")).items()]), MODEL, RUN_DATE)


@_query(f"WITH {V.SEGMENTS}, {_RAW}, d AS (SELECT video_id, arg_max(\"end\", idx) AS duration, count(*) AS n_segments FROM segs GROUP BY video_id) SELECT d.video_id, 'conv ' || d.video_id::VARCHAR AS title, {_SOURCE} AS source, {_sql_fill(_VALUES)} AS markdown FROM d JOIN raw USING (video_id)")
def template_fold(spark, sf_dir):
    return _knowledge(spark, sf_dir)


_PAGE_MD = f"SELECT d.video_id, 'conv ' || d.video_id::VARCHAR AS title, {_SOURCE} AS source, {_sql_fill(_VALUES)} AS markdown FROM d JOIN raw USING (video_id)"

_BODY = f"""CASE WHEN regexp_matches(s, '^#{{1,6}} ') THEN '<h' || lv || '>' || substring(s, lv + 2) || '</h' || lv || '>' WHEN item THEN '<li>' || regexp_replace(substring(s, 3), '\\[(\\d{{2}}:\\d{{2}})\\]', '[<a class=''ts'' href=''#t-\\1''>\\1</a>]', 'g') || '</li>'
 WHEN {V.sql_strip('s')} = '' THEN '' ELSE '<p>' || regexp_replace(s, '\\*\\*(.+?)\\*\\*', '<strong>\\1</strong>', 'g') || '</p>' END"""


@_query(f"""WITH {V.MARKDOWN}, e AS (SELECT video_id, n, {V.sql_escape('line')} AS s FROM md), k AS (SELECT *, length(regexp_extract(s, '^(#{{1,6}}) ', 1)) AS lv, starts_with(s, '- ') AS item FROM e),
 w AS (SELECT *, coalesce(lag(item) OVER o, false) AS pi, coalesce(lead(item) OVER o, false) AS ni FROM k WINDOW o AS (PARTITION BY video_id ORDER BY n))
 SELECT video_id, string_agg(CASE WHEN item AND NOT pi THEN '<ul>' || chr(10) ELSE '' END || {_BODY} || CASE WHEN item AND NOT ni THEN chr(10) || '</ul>' ELSE '' END, chr(10) ORDER BY n) AS body FROM w GROUP BY video_id""")
def html_list_runs(spark, sf_dir):
    return R.html_bodies(V.markdown_lines(spark, sf_dir))


_RENDERED = f"""k AS (SELECT *, length(regexp_extract(s, '^(#{{1,6}}) ', 1)) AS lv, starts_with(s, '- ') AS item FROM e),
 w AS (SELECT *, coalesce(lag(item) OVER o, false) AS pi, coalesce(lead(item) OVER o, false) AS ni FROM k WINDOW o AS (PARTITION BY video_id ORDER BY n)),
 b AS (SELECT video_id, string_agg(CASE WHEN item AND NOT pi THEN '<ul>' || chr(10) ELSE '' END || {_BODY} || CASE WHEN item AND NOT ni THEN chr(10) || '</ul>' ELSE '' END, chr(10) ORDER BY n) AS body FROM w GROUP BY video_id)"""


@_query(f"""WITH {V.SEGMENTS}, {_RAW}, d AS (SELECT video_id, arg_max("end", idx) AS duration, count(*) AS n_segments FROM segs GROUP BY video_id), docs AS ({_PAGE_MD}),
 l AS (SELECT video_id, {V.sql_lines('markdown')} AS lines FROM docs), u AS (SELECT video_id, generate_subscripts(lines, 1) AS n, unnest(lines) AS line FROM l), e AS (SELECT video_id, n, {V.sql_escape('line')} AS s FROM u), {_RENDERED}
 SELECT video_id, title, source, markdown, {_quoted(R.HEAD[0])} || {V.sql_escape('title')} || {_quoted(R.HEAD[1])} || body || {_quoted(R.TAIL)} AS html FROM docs JOIN b USING (video_id)""")
def knowledge_page(spark, sf_dir):
    return R.pages(_knowledge(spark, sf_dir))


@_query(f"WITH {V.FRAMES} SELECT video_id, idx::BIGINT AS idx, t AS \"start\", coalesce(lead(t) OVER (PARTITION BY video_id ORDER BY idx), t + 2.0e0) AS \"end\", length(event_type) || ' bytes' AS text FROM spaced JOIN (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, event_type FROM events) USING (video_id, idx)")
def caption_join(spark, sf_dir):
    frames = S.even_spacing(V.frames(spark, sf_dir)).select("video_id", F.col("idx").cast("long").alias("idx"), "t", F.encode("event_type", "utf-8").alias("content"))
    return captions.captioned(frames, captions.SizeDescriber, 2.0)


@_query(f"WITH {V.SEGMENTS} SELECT video_id, idx, round(\"start\" + idx / 8 + 0.0001, 3) AS \"start\", round(\"end\" + idx / 8 + 0.0001, 3) AS \"end\", {V.sql_strip('text')} AS text FROM segs")
def segment_projection(spark, sf_dir):
    shift = F.col("idx") / 8 + 0.0001
    spoken = V.segments(spark, sf_dir).select("video_id", "idx", (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"), F.concat(F.lit(" \n"), "text", F.lit("\t")).alias("text"), F.lit("words").alias("words"))
    return captions.projected(spoken)


@_query(f"""WITH t AS (SELECT conv_id AS video_id, turn, text, coalesce({V.sql_lines('text')}[1], '') AS head FROM conversations)
 SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY turn) - 1)::BIGINT AS ord, {V.sql_strip("CASE WHEN turn % 4 = 3 THEN head ELSE text END")} AS question, CASE WHEN turn % 4 = 3 THEN '' ELSE 'a' || turn END AS answer FROM t WHERE turn % 4 = 3 OR text <> ''""")
def qa_list_cards(spark, sf_dir):
    turn = V.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), "turn", F.coalesce("text", F.lit("")).alias("head"), F.concat(F.lit("a"), F.col("turn").cast("string")).alias("a"))
    k = F.col("turn") % 4
    item = F.when(k == 0, F.to_json(F.struct(F.col("head").alias("q"), F.col("a").alias("answer")))).when(k == 1, F.to_json(F.struct(F.lit("").alias("q"), F.col("head").alias("question"), "a"))).when(k == 2, F.to_json(F.struct(F.col("head").alias("Q"), F.col("a").alias("A")))).otherwise(F.get_json_object(F.to_json(F.struct(F.concat(F.lit("Q: "), "head").alias("x"))), "$"))
    text = F.when(k == 3, F.regexp_replace(item, "^\\{\"x\":|\\}$", "")).otherwise(item)
    lists = S.joined(turn.withColumn("item", text), "video_id", "turn", "item", ",", "items")
    return C.qa_cards(lists.select("video_id", F.concat(F.lit("["), "items", F.lit("]")).alias("qa")))


@_query("SELECT conv_id AS video_id, turn, CASE turn % 3 WHEN 0 THEN '- ' || role || chr(10) || '- ' || turn || ': ' || role WHEN 1 THEN '- **role**: ' || role || chr(10) || '- **turn**: ' || turn ELSE '(无)' END AS markdown FROM conversations")
def field_markdown(spark, sf_dir):
    k, turn = F.col("turn") % 3, F.col("turn").cast("string")
    value = F.when(k == 0, F.concat(F.lit('["'), "role", F.lit('",{"question":"'), turn, F.lit('","a":"'), "role", F.lit('"}]'))).when(k == 1, F.concat(F.lit('{"role":"'), "role", F.lit('","turn":'), turn, F.lit("}"))).otherwise("[]")
    return V.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), "turn", A.as_markdown(value).alias("markdown"))


_MEET = 's.video_id = p.video_id AND s."start" < p."end" AND p."start" < s."end"'


@_query(f"""WITH {V.SEGMENTS}, {V.PICTURES} SELECT s.video_id, s.idx AS spoken_idx, p.idx AS visual_idx, greatest(s."start", p."start") AS "start", least(s."end", p."end") AS "end" FROM segs s JOIN pics p ON {_MEET}""")
def cue_overlaps(spark, sf_dir):
    pairs = O.overlapping(V.segments(spark, sf_dir), V.pictures(spark, sf_dir))
    return pairs.select("video_id", "spoken_idx", "visual_idx", F.greatest("spoken_start", "visual_start").alias("start"), F.least("spoken_end", "visual_end").alias("end"))


@_query(f"""WITH {V.SEGMENTS}, {V.PICTURES}, pairs AS (SELECT s.video_id, s.idx, p.idx AS pic, p.text FROM segs s JOIN pics p ON {_MEET}),
 seen AS (SELECT video_id, idx, string_agg(text, {_quoted(O.BETWEEN)} ORDER BY pic) AS seen FROM (SELECT video_id, idx, text, min(pic) AS pic FROM pairs GROUP BY ALL) GROUP BY ALL),
 rows_ AS (SELECT video_id, idx, "start", "end", text || coalesce({_quoted(O.SEEN)} || seen || '〕', '') AS text, 0 AS path FROM segs LEFT JOIN seen USING (video_id, idx)
 UNION ALL SELECT video_id, idx, "start", "end", text, 1 FROM pics WHERE (video_id, idx) NOT IN (SELECT (video_id, pic) FROM pairs))
 SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY "start", "end", path, idx) - 1)::BIGINT AS idx, "start", "end", text FROM rows_""")
def both_paths(spark, sf_dir):
    return O.both_paths(V.segments(spark, sf_dir), V.pictures(spark, sf_dir))


def _sql_grams(x: str) -> str:
    single = f"regexp_replace({x}, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')"
    stretches = "list_distinct(list_transform(range(1, length(p) - 2), lambda i: substring(p, i, 4)))"
    return f"(SELECT CASE WHEN length(p) >= 4 THEN {stretches} WHEN p <> '' THEN [p] ELSE [] END FROM (SELECT lower({V.sql_strip(single)}) AS p))"


@_query(f"""WITH {V.SEGMENTS}, {_CARDS}, a AS (SELECT video_id, ord, {_sql_grams('answer')} AS g FROM cards), c AS (SELECT video_id, idx, "start", {_sql_grams('text')} AS g FROM segs),
 ag AS (SELECT video_id, ord, unnest(g) AS gram FROM a), cg AS (SELECT video_id, idx, unnest(g) AS gram FROM c), df AS (SELECT video_id, gram, count(*) AS n FROM cg GROUP BY ALL),
 rare AS (SELECT video_id, ord, gram FROM ag JOIN df USING (video_id, gram) QUALIFY row_number() OVER (PARTITION BY video_id, ord ORDER BY n, gram) = 1),
 found AS (SELECT video_id, ord, "start" FROM rare JOIN cg USING (video_id, gram) JOIN a USING (video_id, ord) JOIN c USING (video_id, idx) QUALIFY row_number() OVER (PARTITION BY video_id, ord ORDER BY len(list_intersect(a.g, c.g)) DESC, "start", idx) = 1)
 SELECT video_id, ord, question, answer, coalesce({V.sql_mmss('"start"')}, '') AS "timestamp" FROM cards LEFT JOIN found USING (video_id, ord)""")
def card_timestamps(spark, sf_dir):
    characters = V.table(spark, sf_dir, "conversations").agg(F.sum(F.length("text"))).first()[0] or 0
    timed = C.timed(C.parse_qa(V.qa_lines(spark, sf_dir)), V.segments(spark, sf_dir), parts=characters // 500_000 + 1)
    return timed.select("video_id", "ord", "question", "answer", "timestamp")


@_query("""WITH w AS (SELECT user_id AS video_id, epoch_us(ts) // 3600000000 AS n, sum(round_even(value * 100, 0)::BIGINT)::BIGINT AS level FROM events GROUP BY ALL),
 loud AS (SELECT video_id, n FROM w QUALIFY level * 2 * count(*) OVER (PARTITION BY video_id) > 3 * sum(level) OVER (PARTITION BY video_id)),
 runs AS (SELECT *, sum(opens) OVER (PARTITION BY video_id ORDER BY n) AS run FROM (SELECT *, (coalesce(n - lag(n) OVER (PARTITION BY video_id ORDER BY n), 99) > 25)::INT AS opens FROM loud))
 SELECT video_id, min(n) AS first, max(n) AS last FROM runs GROUP BY video_id, run HAVING max(n) - min(n) + 1 >= 3""")
def voice_intervals(spark, sf_dir):
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000))
    windows = V.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("video_id"), hour.alias("n")).agg(F.sum(F.rint(F.col("value") * 100).cast("long")).alias("level"))
    return voice.voiced(windows, hang=24, least=3, chunk=100)


_DECK = "knowledge"
_FIELDS = "[question, {answer}, '', '', 'conv' || video_id::VARCHAR]"


@_query(f"""WITH {_CARDS}, old AS (SELECT sha256(question) AS guid, {_FIELDS.format(answer="'old'")} AS fields, 0 AS since, -1 AS ord FROM cards WHERE ord % 2 = 0),
 new AS (SELECT sha256(question) AS guid, {_FIELDS.format(answer="answer")} AS fields, 1 AS since, ord + 1 AS ord FROM cards UNION ALL SELECT sha256('first ' || video_id::VARCHAR), ['first ' || video_id::VARCHAR, '', '', '', 'conv' || video_id::VARCHAR], 1, 0 FROM (SELECT DISTINCT video_id FROM cards))
 SELECT {(X.DECK_ID_BASE + sum(map(ord, _DECK))) % X.DECK_ID_MODULUS}::BIGINT AS deck_id, {C.MODEL_ID}::BIGINT AS model_id, guid, array_to_string(fields, '|') AS fields FROM (SELECT * FROM old UNION ALL SELECT * FROM new) QUALIFY row_number() OVER (PARTITION BY guid ORDER BY since DESC, ord DESC, fields DESC) = 1""")
def merged_notes(spark, sf_dir):
    cards = C.parse_qa(V.qa_lines(spark, sf_dir)).withColumn("source", F.concat(F.lit("conv"), F.col("video_id").cast("string")))
    first = cards.select("video_id", "source").distinct().select("video_id", F.lit(0).cast("long").alias("ord"), F.concat(F.lit("first "), F.col("video_id").cast("string")).alias("question"), F.lit("").alias("answer"), "source")
    noted = lambda rows: C.notes(C.card_rows(rows), _DECK, by_position=False, keep=["ord"])
    new = cards.withColumn("ord", F.col("ord") + 1).unionByName(first)
    notes = decks.merged(noted(cards.filter("ord % 2 = 0").withColumn("answer", F.lit("old"))), noted(new))
    return notes.withColumn("fields", F.array_join("fields", "|"))


_VTT = subtitles.VTT_TIMES
_VTT_AT = "coalesce(nullif(regexp_extract(lines[k], '" + _VTT + "', {i}), ''), '0')::DOUBLE"


def _vtt_seconds(i: int) -> str:
    parts = [_VTT_AT.replace("{i}", str(i + k)) for k in range(4)]
    return f"({parts[0]} * 3600 + {parts[1]} * 60 + {parts[2]} + {parts[3]} / 1000)"


@_query(f"""WITH docs AS ({SQL['vtt_document']}), parts AS (SELECT video_id, string_split_regex(substring(regexp_replace(document, '\\r\\n?', chr(10), 'g'), 7), '\\n{{2,}}') AS b FROM docs),
 blocks AS (SELECT video_id, unnest(b) AS cue, generate_subscripts(b, 1) AS block FROM parts), ls AS (SELECT video_id, block, string_split(regexp_replace(cue, '^\\n+|\\n+$', '', 'g'), chr(10)) AS lines FROM blocks), t AS (SELECT *, CASE WHEN contains(lines[1], '-->') THEN 1 ELSE 2 END AS k FROM ls)
 SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY block) - 1)::BIGINT AS idx, {_vtt_seconds(1)} AS "start", {_vtt_seconds(5)} AS "end", array_to_string(lines[k + 1:], ' ') AS text FROM t WHERE regexp_matches(lines[k], '{_VTT}')""")
def vtt_parse_roundtrip(spark, sf_dir):
    return subtitles.vtt_segments(files.vtt(V.segments(spark, sf_dir))).withColumn("idx", F.col("idx").cast("long")).drop("settings")


@_query(SQL["srt_parse_roundtrip"])
def srt_cues_lateral(spark, sf_dir):
    tables.register(spark)
    cues = spark.sql("SELECT d.video_id, c.idx, c.start, c.end, c.text FROM {docs} AS d, LATERAL srt_cues(d.document) AS c", docs=files.srt(V.segments(spark, sf_dir)))
    return cues.withColumn("idx", F.col("idx").cast("long"))


@_query(f"""WITH {V.SEGMENTS}, f AS (SELECT c_custkey AS video_id, CASE WHEN c_custkey % 3 <> 0 THEN 'l' || c_custkey % 3 END AS language, c_custkey % 8 / 8e0 AS p, c_custkey * 0.25e0 AS duration FROM customer),
 l AS (SELECT video_id, string_agg('{{"start":' || "start"::VARCHAR || ',"end":' || "end"::VARCHAR || ',"text":' || to_json(text)::VARCHAR || '}}', ',' ORDER BY idx) AS items FROM segs GROUP BY video_id)
 SELECT f.video_id, '{{"language":' || coalesce('"' || language || '"', 'null') || ',"language_probability":' || p::VARCHAR || ',"duration":' || duration::VARCHAR || ',"segments":[' || coalesce(items, '') || ']}}' AS document FROM f LEFT JOIN l USING (video_id)""")
def subtitles_document(spark, sf_dir):
    key = F.col("c_custkey")
    about = V.table(spark, sf_dir, "customer").select(key.alias("video_id"), F.when(key % 3 != 0, F.concat(F.lit("l"), (key % 3).cast("string"))).alias("language"), (key % 8 / 8.0).alias("language_probability"), (key * 0.25).alias("duration"))
    return files.subtitles_json(V.segments(spark, sf_dir), about)


_PROFILE = "CASE WHEN vram >= 8 THEN 'high-gpu' WHEN ram >= 32 THEN 'max' WHEN ram >= 16 THEN 'high' WHEN apple AND ram >= 6 AND ram < 8 THEN 'low-mac' WHEN ram >= 8 THEN 'mid' WHEN ram >= 6 THEN 'low' ELSE 'tiny' END"


def _profiled(spark, sf_dir) -> DataFrame:
    return V.hosts(spark, sf_dir).withColumn("profile", P.select_profile(F.col("ram"), F.col("vram"), F.col("apple")))


@_query(f"WITH {V.HOSTS} SELECT host, ram, {_PROFILE} AS profile FROM hosts")
def hardware_profile(spark, sf_dir):
    return _profiled(spark, sf_dir).select("host", "ram", "profile")


_TABLE = "prof AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in P.PROFILES) + ") v(profile, asr, compute, device, vlm, note))"


@_query(f"WITH {V.HOSTS}, {_TABLE} SELECT host, p.* FROM (SELECT host, {_PROFILE} AS profile FROM hosts) h JOIN prof p USING (profile)")
def profile_lookup(spark, sf_dir):
    return P.look_up(_profiled(spark, sf_dir).select("host", "profile")).select("host", "profile", "asr", "compute", "device", "vlm", "note")


@_query(f"""WITH {V.HOSTS}, {_TABLE} SELECT host, 'linux' AS os, 'x86_64' AS arch, round_even(ram * 1048576 / 1048576, 1) AS ram_gb, CASE WHEN apple THEN 'chip' END AS apple_chip, CASE WHEN vram <> 0 THEN round_even(vram, 1) END AS nvidia_vram_gb, h.profile,
 p.asr AS asr_model, p.compute AS compute_type, p.device, p.vlm AS vlm_model, p.note FROM (SELECT *, {_PROFILE} AS profile FROM hosts) h JOIN prof p USING (profile)""")
def host_profile(spark, sf_dir):
    kilobytes = (F.col("ram") * F.lit(1048576)).cast("long")
    found = V.hosts(spark, sf_dir).select("host", F.lit("linux").alias("os"), F.lit("x86_64").alias("arch"), hosts.gigabytes(kilobytes, "kB").alias("ram"), F.when(F.col("apple"), "chip").alias("apple_chip"), "vram")
    return hosts.described(found, keep=["host"])


@_query(f"WITH {V.HOSTS}, h AS (SELECT host, ram, {_PROFILE} AS profile FROM hosts) SELECT host, m AS model, m IN ('large', 'large-v1', 'large-v2', 'large-v3', 'medium') AND ram <> 0 AND ram < 16 AND profile <> 'high-gpu' AS warn FROM h CROSS JOIN (VALUES ('small'), ('medium'), ('large-v3')) v(m)")
def heavy_model_warning(spark, sf_dir):
    models = F.explode(F.array(*map(F.lit, ("small", "medium", "large-v3"))))
    rows = _profiled(spark, sf_dir).select("host", "ram", "profile", models.alias("model"))
    return rows.select("host", "model", P.heavy_warning(F.col("model"), F.col("ram"), F.col("profile")).alias("warn"))


_THOUGHT = "CASE WHEN idx % 2 = 0 THEN '<think>a</think> b ' || chr(10) || '</think>' || chr(10) ELSE ' ' END || text || chr(10)"


@_query(f"WITH {V.SEGMENTS}, t AS (SELECT video_id, idx, replace({V.sql_strip(_THOUGHT)}, chr(10), ' ') AS x FROM segs) SELECT video_id, idx, CASE WHEN contains(x, '</think>') THEN {V.sql_strip(r'''regexp_replace(x, '(?s)^.*</think>', '')''')} ELSE x END AS caption FROM t")
def think_tag_cleanup(spark, sf_dir):
    head = F.when(F.col("idx") % 2 == 0, "<think>a</think> b \n</think>\n").otherwise(" ")
    return V.segments(spark, sf_dir).select("video_id", "idx", X.without_thinking(F.concat(head, "text", F.lit("\n"))).alias("caption"))


@_query(f"WITH {V.SEGMENTS} SELECT shape, video_id, (row_number() OVER (PARTITION BY shape, video_id ORDER BY idx) - 1)::BIGINT AS idx, \"start\", \"end\", text FROM segs CROSS JOIN (VALUES ('array'), ('segments'), ('captions')) v(shape)")
def json_shape_resolution(spark, sf_dir):
    docs = files.captions_json(V.segments(spark, sf_dir))
    shapes: dict[str, Column] = {
        "array": F.col("document"),
        "segments": F.concat(F.lit('{"language":"en","segments":'), "document", F.lit("}")),
        "captions": F.concat(F.lit('{"segments":[],"captions":'), "document", F.lit("}")),
    }
    rows = docs.select("video_id", F.inline(F.array(*[F.struct(F.lit(k).alias("shape"), v.alias("document")) for k, v in shapes.items()])))
    out = rows.select("shape", "video_id", F.posexplode(subtitles.json_segments(F.col("document"))).alias("idx", "s"))
    return out.select("shape", "video_id", F.col("idx").cast("long").alias("idx"), "s.start", "s.end", "s.text")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments to knowledge documents."""
    return _knowledge(spark, sf_dir)
