"""Column expressions for text and time that follow Python's string rules, all inside code generation."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that str.strip() removes; line ends of str.splitlines(); deck id base and modulus.
STRIPPED = "[\\s\\x1c-\\x1f]+"
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
DECK_ID_BASE, DECK_ID_MODULUS = 9120451233, 2**31


def strip(x: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(x, f"(?U)^{STRIPPED}|{STRIPPED}$", "")


def splitlines(x: Column) -> Column:
    """Lines of a text; a line end at its end opens no further line."""
    parts = F.split(x, LINE_END)
    n = F.size(parts)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(n - 1, F.lit(0)))).otherwise(parts)


def newlines(x: Column) -> Column:
    """As read in text mode: every line end is a newline."""
    return F.regexp_replace(x, "\\r\\n?", "\n")


def milliseconds(seconds: Column) -> Column:
    """Half goes to even."""
    return F.rint(seconds * 1000).cast("long")


def thousandth(x: Column) -> Column:
    """x to the nearest thousandth, by its exact binary value: where 1000 x is rounded to a tie, the product's error tells on which side x lies."""
    high = x * 134217729.0 - (x * 134217729.0 - x)  # the upper half of x's bits; both halves times 1000 are exact
    product = x * 1000.0
    error = (high * 1000.0 - product) + (x - high) * 1000.0
    below = F.floor(product).cast("double")
    tie = (product - below == 0.5) & (error != 0)
    return F.when(tie, F.when(error < 0, below).otherwise(below + 1)).otherwise(F.rint(product)) / 1000.0


def timecode(seconds: Column, separator: str = ",") -> Column:
    """HH:MM:SS,mmm; hours take as many digits as they need."""
    ms = milliseconds(seconds)
    return F.format_string(f"%02d:%02d:%02d{separator}%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def mmss(seconds: Column) -> Column:
    """MM:SS; minutes run on past 60."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60), F.pmod(s, F.lit(60)))


def html_escape(x: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(raw), F.lit(entity))
    return x


def linkify(x: Column) -> Column:
    """[mm:ss] as a link; two digits of minutes only."""
    return F.regexp_replace(x, "\\[(\\d{2}:\\d{2})\\]", "[<a class='ts' href='#t-$1'>$1</a>]")


def bold(x: Column) -> Column:
    return F.regexp_replace(x, "\\*\\*(.+?)\\*\\*", "<strong>$1</strong>")


def strip_fence(x: Column) -> Column:
    """Without a code fence around the whole answer."""
    inner = F.regexp_replace(strip(x), "^```[a-zA-Z]*\\s*\\n?", "")
    return strip(F.regexp_replace(inner, "\\n?```\\s*$", ""))


def without_thinking(x: Column) -> Column:
    """A model's answer on one line, after its last closing thinking tag."""
    flat = F.replace(strip(x), F.lit("\n"), F.lit(" "))
    return F.when(F.contains(flat, F.lit("</think>")), strip(F.regexp_replace(flat, "(?s)^.*</think>", ""))).otherwise(flat)


def deck_id(name: Column) -> Column:
    total = F.aggregate(F.transform(F.split(name, ""), lambda c: F.ascii(c).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return (total + F.lit(DECK_ID_BASE)) % F.lit(DECK_ID_MODULUS)


def line_count(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))) + 1


def title_of(file_name: Column) -> Column:
    """A file's stem with spaces for underscores; a leading dot is part of the stem."""
    return F.replace(F.regexp_replace(file_name, "(?<=.)\\.[^.]*$", ""), F.lit("_"), F.lit(" "))


def register(spark) -> None:
    """timecode and mmss as SQL functions."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION mmss(s DOUBLE) RETURNS STRING RETURN format_string('%02d:%02d', CAST(floor(CAST(s AS BIGINT) / 60) AS BIGINT), pmod(CAST(s AS BIGINT), 60))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION timecode(s DOUBLE, sep STRING) RETURNS STRING RETURN format_string('%02d:%02d:%02d%s%03d', CAST(rint(s * 1000) AS BIGINT) div 3600000, CAST(rint(s * 1000) AS BIGINT) div 60000 % 60, CAST(rint(s * 1000) AS BIGINT) div 1000 % 60, sep, CAST(rint(s * 1000) AS BIGINT) % 1000)")
