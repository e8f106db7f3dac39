"""Column functions over whole texts; all stay inside Spark's expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

CJK = r"\x{4e00}-\x{9fff}"
#: Phrases that mark an attempt to override instructions.
INJECTION_PHRASES = [
    "ignore previous instructions", "ignore above instructions", "disregard all prior", "you are now", "system prompt", "act as if", "pretend you are",
    "forget your instructions", "override your rules", "bypass your guidelines", "忽略之前的指令", "忽略以上指令", "你现在是", "系统提示词",
]
#: Words that mark a failed step.
FAILURE_WORDS = ["失败", "错误", "不支持", "无法", "遇到问题", "未能完成", "failed", "error", "not supported", "unable", "cannot", "blocked", "exception"]


def literals(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def clean_markup(text: Column) -> Column:
    """Images dropped, links to their label, tags stripped, blanks and blank lines collapsed; fenced code stays as it is."""

    def prose(p: Column) -> Column:
        p = F.regexp_replace(p, r"!\[[^\]]*\]\([^)]*\)", "")
        p = F.regexp_replace(p, r"\[([^\]]*)\]\([^)]*\)", "$1")
        p = F.regexp_replace(p, r"<[^>]+>", "")
        p = F.regexp_replace(p, r"[ \t\r]+", " ")
        p = F.regexp_replace(p, r" +\n", "\n")
        return F.regexp_replace(p, r"\n{3,}", "\n\n")

    def part(p: Column, i: Column) -> Column:
        last = i == F.size(parts) - 1
        fenced = (i % 2 == 1) & ~last
        return F.when(fenced, F.concat(F.lit("```"), p, F.lit("```"))).when(i % 2 == 1, F.concat(F.lit("```"), prose(p))).otherwise(prose(p))

    parts = F.split(text, "```", -1)
    return F.trim(F.array_join(F.transform(parts, part), ""), F.lit(" \n"))


def html_text(html: Column) -> Column:
    """Script, style and comment blocks dropped, tags to blanks, blanks collapsed."""
    x = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(x, r"[ \t\r\n]+", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def title_of(text: Column, fallback: Column) -> Column:
    """The first ``# `` heading, else the first line that is not blank; not over 120 characters nor with control characters."""
    heading = F.trim(F.regexp_extract(text, r"(?m)^# +([^\n]+)$", 1))
    first = F.trim(F.regexp_extract(text, r"^[ \t\r\n]*([^\n]+)", 1))
    title = F.when(heading != "", heading).otherwise(first)
    usable = (title != "") & (F.char_length(title) <= 120) & ~title.rlike(r"[\x00-\x1f\x7f\x{fffd}]")
    return F.when(usable, title).otherwise(fallback)


def title_from_name(name: Column) -> Column:
    """A file name without extension, dashes and underscores as blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), r"[-_ ]+", " "))


def tags_of(name: Column, section: Column, stop: Sequence[str]) -> Column:
    """Sorted distinct tokens of a file name (at ``-``, ``_`` and blanks) and a section path (at `` > ``)."""
    tokens = F.concat(F.split(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), "[-_ ]"), F.split(section, " > "))
    kept = F.filter(F.transform(tokens, lambda x: F.trim(x)), lambda t: (F.octet_length(t) >= 2) & ~F.lower(t).isin(list(stop)))
    return F.array_sort(F.array_distinct(kept))


def slugify(text: Column) -> Column:
    """Lower-case ASCII; runs of other ASCII become one dash; non-ASCII letters stay."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "-"), F.lit("-"))


def word_count(text: Column) -> Column:
    """Runs of CJK characters or of ASCII letters and digits count one word each."""
    return F.regexp_count(text, F.lit(rf"[{CJK}]+|[A-Za-z0-9]+"))


def language_class(text: Column) -> Column:
    """zh, zh-en or en by the share of CJK among characters that are not blank; unknown if there are none."""
    solid = F.regexp_replace(text, r"[ \t\r\n]", "")
    share = F.regexp_count(solid, F.lit(f"[{CJK}]")) / F.char_length(solid)
    return F.when(F.char_length(solid) == 0, "unknown").when(share > 0.3, "zh").when(share > 0.05, "zh-en").otherwise("en")


def grams(run: Column, n: int) -> Column:
    """All n-grams of characters of one string."""
    last = F.char_length(run) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def ngram_tokens(text: Column, words: str = "[a-z0-9]+") -> Column:
    """CJK runs as bigrams and trigrams, then ``words`` of the lower-cased text."""
    runs = F.regexp_extract_all(text, F.lit(f"[{CJK}]+"), F.lit(0))
    cjk = F.flatten(F.transform(runs, lambda r: F.concat(grams(r, 2), grams(r, 3))))
    return F.concat(cjk, F.regexp_extract_all(F.lower(text), F.lit(words), F.lit(0)))


def entities(text: Column) -> Column:
    """Titles in 《》, names that end like an organisation or product, and acronyms of 2-10 capitals; distinct, in that order."""
    titles = F.regexp_extract_all(text, F.lit("《([^》]+)》"), F.lit(1))
    names = F.regexp_extract_all(text, F.lit(rf"[{CJK}]{{2,}}(?:公司|集团|系统|模块|平台|软件|产品|方案|服务)"), F.lit(0))
    acronyms = F.regexp_extract_all(text, F.lit("(?<![A-Za-z])[A-Z]{2,10}(?![A-Za-z])"), F.lit(0))
    return F.array_distinct(F.concat(titles, names, acronyms))


def sentences(text: Column) -> Column:
    """Cut after 。！？ unless a closer follows, and after .!? only before a blank, a closer or the end; over 3 bytes."""
    cut = F.split(text, r"(?<=[。！？])(?![”’」』）)\]])|(?<=[.!?])(?=[ \t\r\n]|$)", -1)
    return F.filter(F.transform(cut, lambda s: F.trim(s, F.lit(" \t\r\n"))), lambda s: F.octet_length(s) > 3)


def keep_separators(text: Column) -> Column:
    return F.filter(F.split(text, "(?<=[。！？；])", -1), lambda s: s != "")


def token_estimate(text: Column, wide: float = 1.2, narrow: float = 3.5) -> Column:
    """ceil(non-ASCII characters / wide + (bytes - non-ASCII characters) / narrow); the subtraction keeps the known budget contract."""
    non_ascii = F.char_length(F.regexp_replace(text, r"[\x00-\x7f]", ""))
    return F.ceil(non_ascii / F.lit(wide) + (F.octet_length(text) - non_ascii) / F.lit(narrow))


def preview(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def truncate_to_budget(text: Column, budget: int, wide: float = 1.2, narrow: float = 3.5) -> Column:
    """The longest prefix whose token estimate stays within ``budget``, by bisection over the prefix length.

    A character counts at least 1 / ``narrow``, so no prefix beyond ``budget`` * ``narrow`` fits, and no more of a text is read.
    """
    most = max(0, math.floor(budget * narrow)) + 1
    head = F.left(text, F.lit(most))
    fits = lambda n: token_estimate(F.left(head, n), wide, narrow) <= budget
    start = F.struct(F.lit(0).alias("low"), F.char_length(head).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
        ok = fits(mid)
        return F.struct(F.when(ok, mid).otherwise(s["low"]).alias("low"), F.when(ok, s["high"]).otherwise(F.greatest(mid - 1, s["low"])).alias("high"))

    return F.left(head, F.aggregate(F.sequence(F.lit(1), F.lit(most.bit_length() + 1)), start, halve)["low"])


def context_prefix(title: Column, section: Column, text: Column) -> Column:
    where = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(" "), section, F.lit("章节"))).otherwise("")
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("文档《"), title, F.lit("》"), where, F.lit("\n"), text)).otherwise(text)


def citations(text: Column) -> Column:
    """Names and numbers cited as [来源：x.md], （来源：x.md）, [src:n] or [chunk:n]."""
    named = F.regexp_extract_all(text, F.lit(r"[\[（(]来源：([^\]）)]+\.md)[\]）)]"), F.lit(1))
    return F.concat(named, F.regexp_extract_all(text, F.lit(r"\[(?:src|chunk):(\d+)\]"), F.lit(1)))


def first_injection_phrase(text: Column) -> Column:
    low = F.lower(text)
    return F.try_element_at(F.filter(literals(INJECTION_PHRASES), lambda p: F.contains(low, p)), F.lit(1))


def has_failure_word(text: Column) -> Column:
    low = F.lower(text)
    return F.exists(literals(FAILURE_WORDS), lambda w: F.contains(low, w))


def scrub_context(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<context>.*?(?:</context>|$)", "")


def json_of_answer(text: Column) -> Column:
    """The JSON in a model's answer: inside a fence, else the outermost object, else the outermost array."""
    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.when(fence != "", F.trim(fence)).when(text.contains("{"), F.regexp_extract(text, r"(?s)(\{.*\})", 1)).otherwise(F.regexp_extract(text, r"(?s)(\[.*\])", 1))


def source_keys(sources: Column) -> Column:
    """Sorted distinct keys of a JSON array of objects: ``source_id:`` and its value, else ``document_id:`` and its value; null if it is no array of objects.

    Numbers and strings that are not blank are values, nested ones and nulls are not.
    """
    value = lambda o, name: F.when(~o[name].rlike(r"^\s*(?:[\[{]|$)"), F.concat(F.lit(f"{name}:"), F.trim(o[name])))
    objects = F.from_json(sources, "array<struct<source_id: string, document_id: string>>")
    keys = F.transform(objects, lambda o: F.coalesce(value(o, "source_id"), value(o, "document_id")))
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: k.isNotNull())))


@F.pandas_udf(ArrayType(StringType()))
def whole_objects(text: pd.Series) -> pd.Series:
    """The complete top-level objects of a JSON array that may break off, as texts; braces inside strings do not count."""

    def scan(x: str | None) -> list[str] | None:
        if x is None:
            return None
        found, depth, start, inside, skip = [], 0, 0, False, False
        for k, c in enumerate(x):
            if inside:
                inside, skip = skip or c != '"', not skip and c == "\\"
            elif c == '"':
                inside = True
            elif c == "{":
                start = k if depth == 0 else start
                depth += 1
            elif c == "}" and depth > 0:
                depth -= 1
                if depth == 0:
                    found.append(x[start : k + 1])
        return found

    return text.map(scan)


def front_matter_tags(text: Column) -> Column:
    """The tags of a leading yaml block, ``[a, "b"]`` or ``a, b``."""
    block = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1)
    tags = F.regexp_replace(F.regexp_extract(block, r"(?m)^tags:[ ]*(.*)$", 1), r"[\[\]\"']", "")
    return F.filter(F.transform(F.split(tags, ","), lambda x: F.trim(x)), lambda t: t != "")


def change_ratio(a: Column, b: Column, cut: int | None = None) -> Column:
    """Edit distance over the longer length; 0 for two empty texts.

    The distance is exact for texts of any length, unless ``cut`` asks for positional mismatches
    beyond that many characters (linear, but one character put in front makes all differ).
    """
    longer = F.greatest(F.char_length(a), F.char_length(b))
    ratio = F.when(longer == 0, 0.0)
    if cut is not None:
        chars = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y))
        ratio = ratio.when(longer > cut, F.size(F.filter(chars, lambda apart: apart)) / longer)
    return ratio.otherwise(F.levenshtein(a, b) / longer)


def mask_digits(text: Column) -> Column:
    """Keep-part masks: e-mail names, runs of 13-19 digits and phone numbers keep their ends."""
    x = F.regexp_replace(text, r"([A-Za-z0-9])[A-Za-z0-9._%+-]*@", "$1***@")
    x = F.regexp_replace(x, r"([0-9]{4})[0-9]{5,11}([0-9]{4})", "$1****$2")
    return F.regexp_replace(x, r"(\+[0-9]{1,3} ?\(?[0-9]{3}\)? ?)[0-9]{3}(-?[0-9]{4})", "$1***$2")


#: What is sanitised: a kind's pattern, in groups of which the first and last stay visible under a mask.
SENSITIVE = {
    "card": r"([0-9]{4})[0-9]{5,11}([0-9]{4})",
    "phone": r"(\+[0-9]{1,3} ?\(?[0-9]{3}\)? ?)[0-9]{3}(-?[0-9]{4})",
    "email": r"([A-Za-z0-9])[A-Za-z0-9._%+-]*(@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9])",
}


def sanitise(text: Column, policies: dict[str, str]) -> Column:
    """``text`` with each kind of ``policies`` masked (its ends stay), replaced by a placeholder, or deleted; kinds without policy stay."""
    for kind, pattern in SENSITIVE.items():
        if kind in policies:
            text = F.regexp_replace(text, pattern, {"mask": "$1***$2", "placeholder": f"[{kind.upper()}]", "delete": ""}[policies[kind]])
    return text


def residue(text: Column, kinds: Sequence[str]) -> Column:
    """How many of ``kinds`` a text still holds."""
    return sum((F.coalesce(text.rlike(SENSITIVE[k]), F.lit(False)).cast("long") for k in kinds), F.lit(0).cast("long"))
