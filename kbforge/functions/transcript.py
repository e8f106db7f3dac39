"""Clean-up of speech transcripts, in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that open a clause, and words that make a question.
CLAUSE_OPENERS = ["然后", "但是", "所以", "因为", "如果", "不过", "而且", "另外", "比如"]
QUESTION_WORDS = ["吗", "呢", "吧", "啊", "么", "谁", "什么", "怎么", "哪", "多少", "几", "为什么", "如何", "是不是", "能不能", "有没有"]
MARKS = r"。？！；，、：,.!?;:"


def collapse_repeats(text: Column) -> Column:
    """Phrases of 2 to 4 characters repeated at once stand once, single characters twice."""
    return F.regexp_replace(text, r"(?s)(.{4})\1+|(.{3})\2+|(.{2})\3+|(.)\4+", "$1$2$3$4$4")


def restore_marks(text: Column) -> Column:
    """A comma before clause openers, and a final question mark or full stop, where none stands."""
    commas = F.regexp_replace(text, rf"(?<=[^{MARKS}\s])(?=(?:{'|'.join(CLAUSE_OPENERS)}))", "，")
    asks = F.right(commas, F.lit(6)).rlike("|".join(QUESTION_WORDS))
    return F.when(commas.rlike(rf"[^{MARKS}]$"), F.concat(commas, F.when(asks, "？").otherwise("。"))).otherwise(commas)


def merge_short(text: Column, least: int = 10) -> Column:
    """Sentences of under ``least`` characters join the one before with a comma."""
    parts = F.filter(F.transform(F.split(text, "[。？！；]"), lambda p: F.trim(p)), lambda p: p != "")
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("open"))

    def add(s: Column, p: Column) -> Column:
        short = (F.char_length(p) < least) & (s["open"] != "")
        comma = F.when(s["open"].rlike("[，、]$"), "").otherwise("，")
        return F.struct(
            F.when(short | (s["open"] == ""), s["done"]).otherwise(F.concat(s["done"], s["open"], F.lit("。"))).alias("done"),
            F.when(short, F.concat(s["open"], comma, p)).otherwise(p).alias("open"),
        )

    merged = F.aggregate(parts, start, add, lambda s: F.concat(s["done"], s["open"], F.lit("。")))
    return F.when(F.size(parts) <= 1, text).otherwise(merged)


def tidy_blanks(text: Column) -> Column:
    """No blanks between CJK characters, single ones else, no blank lines."""
    cjk = r"\x{4e00}-\x{9fff}"
    x = F.regexp_replace(text, rf"(?<=[{cjk}])[ \t\r\n]+(?=[{cjk}])", "")
    x = F.regexp_replace(x, " {2,}", " ")
    lines = F.filter(F.transform(F.split(x, "\n"), lambda p: F.trim(p, F.lit(" \t\r"))), lambda p: p != "")
    return F.array_join(lines, "\n")


def clean_transcript(text: Column) -> Column:
    return tidy_blanks(merge_short(restore_marks(collapse_repeats(text))))
