"""Question-and-answer cards and notes."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueforge.functions import text as X

# Fixed value: the note model's id.
MODEL_ID = 1830540287


def parse_qa(lines: DataFrame) -> DataFrame:
    """lines(video_id, n, line) -> (video_id, ord, question, answer): `Q:` opens a card, a later `A:` sets its answer, the last one wins; what stands before the first `Q:` is lost. Gaps and islands: the running count of `Q:` is the card."""
    s = X.strip(F.col("line"))
    head = F.lower(F.substring(s, 1, 2))
    rows = lines.select("video_id", "n", s.alias("s"), (head == "q:").alias("q"), (head == "a:").alias("a"))
    so_far = Window.partitionBy("video_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("card", F.sum(F.col("q").cast("int")).over(so_far)).filter("card > 0 and (q or a)")
    body = X.strip(F.substring("s", 3, 1_000_000_000))
    cards = rows.withColumn("body", body).groupBy("video_id", "card").agg(F.expr("max_by(body, n) filter (where q)").alias("question"), F.coalesce(F.expr("max_by(body, n) filter (where a)"), F.lit("")).alias("answer"))
    return cards.select("video_id", (F.col("card") - 1).alias("ord"), "question", "answer")


def parse_qa_items(items: DataFrame) -> DataFrame:
    """items(video_id, n, q, a) -> cards of structured answers; those without a question are skipped."""
    kept = items.filter(F.coalesce("q", F.lit("")) != "")
    ord_ = F.row_number().over(Window.partitionBy("video_id").orderBy("n")) - 1
    return kept.select("video_id", ord_.cast("long").alias("ord"), X.strip(F.col("q")).alias("question"), X.strip(F.coalesce("a", F.lit(""))).alias("answer"))


def card_rows(cards: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """The five columns of a card file, and its order; tags are empty, and timestamp is unless `timed` put one in. sources(video_id, source), unless cards have a source."""
    when = F.col("timestamp") if "timestamp" in cards.columns else F.lit("")
    rows = cards.join(sources, "video_id") if sources else cards
    return rows.select("video_id", "ord", "question", "answer", F.lit("").alias("tags"), when.alias("timestamp"), "source")


def grams(text: Column, size: int) -> Column:
    """Distinct stretches of `size` characters of a text in small letters, its white space made single spaces; a shorter text is one."""
    plain = F.lower(X.strip(F.regexp_replace(text, "[ \\t\\n\\x0b\\f\\r]+", " ")))

    def cut(letters: Column) -> Column:  # a lambda's argument, so the text is taken apart once
        long = F.transform(F.sequence(F.lit(0), F.size(letters) - size), lambda i: F.concat(*[F.get(letters, i + k) for k in range(size)]))
        whole = F.array_join(letters, "")
        return F.when(F.size(letters) >= size, F.array_distinct(long)).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(F.split(plain, "")), cut), F.lit(0))


def timed(cards: DataFrame, cues: DataFrame, size: int = 4, parts: int | None = None) -> DataFrame:
    """cards(video_id, ord, question, answer) and cues(video_id, idx, start, text) -> cards with `timestamp`, the mm:ss of the cue that an answer comes from; empty where no cue shares anything with it.

    An inverted index of the stretches of `size` characters, within each video. An answer's candidates are the cues on the
    shortest list among its own (ties by the stretch), so common stretches come last: they find no candidate where a rarer one
    does. Of the candidates the one that shares most distinct stretches with the answer wins, of equal ones the earlier.
    Texts are dealt by video, once, over `parts` tasks (None: as the session has it); their stretches are listed and counted
    where the video lies and never sent. A video is one task's work, as it is where its cues are numbered; what does not fit spills.
    """
    asked = cards.select("video_id", "ord", F.col("answer").alias("text"))
    said = cues.select("video_id", "idx", "start", "text")
    texts = asked.withColumn("idx", F.lit(None)).unionByName(said.drop("start").withColumn("ord", F.lit(None)).withColumn("held", F.lit(1)), allowMissingColumns=True)
    dealt = texts.repartition(parts, "video_id") if parts else texts.repartition("video_id")
    listed = dealt.select("video_id", "ord", "idx", "held", F.explode(grams(F.col("text"), size)).alias("gram"))
    of_gram = Window.partitionBy("video_id", "gram")
    counts = {"length": F.count("held").over(of_gram), "n": F.count("*").over(of_gram)}
    both = listed.withColumns(counts).filter("length > 0 and n > length")
    own = Window.partitionBy("video_id", "ord").orderBy("length", "gram")
    chosen = both.withColumn("least", F.when(F.col("held").isNull(), F.row_number().over(own) == 1))
    lists = chosen.withColumn("met", F.max("least").over(of_gram)).filter("met and (least or held = 1)")
    met = lists.groupBy("video_id", "gram").agg(F.expr("collect_list(ord) filter (where held is null)").alias("ord"), F.collect_list("idx").alias("idx"))
    pairs = met.select("video_id", F.explode("ord").alias("ord"), "idx").select("video_id", "ord", F.explode("idx").alias("idx"))
    heard = pairs.join(said.withColumnRenamed("text", "cue"), ["video_id", "idx"]).join(asked, ["video_id", "ord"])
    shared = F.size(F.array_intersect(grams(F.col("text"), size), grams(F.col("cue"), size)))
    best = heard.groupBy("video_id", "ord").agg(F.min(F.struct((-shared).alias("least"), "start", "idx")).alias("best"))
    found = best.select("video_id", "ord", X.mmss(F.col("best.start")).alias("timestamp"))
    return cards.join(found, ["video_id", "ord"], "left").withColumn("timestamp", F.coalesce("timestamp", F.lit("")))


def notes(cards: DataFrame, deck: str | Column, by_position: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Notes with ids, and columns to keep: guid from the question and, unless by_position is off, the place in the deck."""
    key = F.concat_ws("|", "question", F.col("ord").cast("string")) if by_position else F.col("question")
    fields = F.array(*[F.coalesce(c, F.lit("")) for c in ("question", "answer", "tags", "timestamp", "source")])
    return cards.select(*(keep or []), X.deck_id(F.lit(deck) if isinstance(deck, str) else deck).alias("deck_id"), F.lit(MODEL_ID).cast("long").alias("model_id"), F.sha2(key, 256).alias("guid"), fields.alias("fields"))


def qa_cards(answers: DataFrame) -> DataFrame:
    """answers(video_id, qa) -> cards of whatever form qa has: a JSON array of objects (q, question or Q; a, answer or A; the first that is not empty) and of texts, each read by its own lines; or one text. Other JSON values are texts too."""
    v = F.try_parse_json("qa")
    elements = F.try_variant_get(v, "$", "array<variant>")
    parts = answers.select("video_id", F.posexplode(F.coalesce(elements, F.array(F.try_parse_json(F.to_json(F.struct(F.col("qa").alias("text"))))))).alias("item", "v"), elements.isNotNull().alias("listed"))
    get = lambda key: F.nullif(F.try_variant_get("v", f"$.{key}", "string"), F.lit(""))
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    objects = parts.filter(F.col("listed") & is_object).select("video_id", "item", F.lit(0).cast("long").alias("at"), F.coalesce(get("q"), get("question"), get("Q")).alias("question"), F.coalesce(get("a"), get("answer"), get("A"), F.lit("")).alias("answer"))
    objects = objects.filter(F.col("question").isNotNull()).withColumns({"question": X.strip(F.col("question")), "answer": X.strip(F.col("answer"))})
    text = F.when(F.col("listed"), F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string"))).otherwise(get("text"))
    lines = parts.filter(~F.col("listed") | ~is_object).select(F.struct("video_id", "item").alias("video_id"), F.posexplode(X.splitlines(text)).alias("n", "line"))
    texts = parse_qa(lines).select("video_id.video_id", "video_id.item", F.col("ord").alias("at"), "question", "answer")
    ord_ = F.row_number().over(Window.partitionBy("video_id").orderBy("item", "at")) - 1
    return objects.unionByName(texts).select("video_id", ord_.cast("long").alias("ord"), "question", "answer")
