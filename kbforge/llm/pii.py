"""Personal data by weak supervision, in DataFrame functions only (operator 1).

1. Candidates. Rows that can hold any (a digit, an at sign) are set aside; four base patterns and
   three wider ones (obfuscated addresses, numbers of cards that stand next to other digits,
   national phone numbers) give candidate spans with some
   characters of context. Offsets come from the lengths of the pieces between matches.
2. Votes. A pattern labeler (the base rule holds, fails, or abstains), a gazetteer labeler (known
   top-level domains, card issuers, country codes, reserved networks), a context labeler (cue
   words before the span) and a boundary labeler vote for or against each candidate.
3. Expectation-maximisation over the counts of vote patterns (at most 81 for a kind) estimates
   each labeler's reliability and each pattern's probability, for each kind, in one expression.
4. These probabilities are the soft labels of a naive-Bayes classifier over features of the span
   itself and the votes; it decides on the candidates that the base rules do not cover.

Base spans are never taken away. A further span is added if its probability reaches
``threshold``, no rule of its kind (a checksum, a count of digits) fails for it, and it overlaps
neither a base span nor an added one that starts before it (at one start the longer one is added).

Defined cases: null text is empty; empty texts have no spans; very long texts are matched whole, and
texts with any number of spans settled and redacted, in (but for sorting) linear time; repeated rows are handled each; an empty table gives an empty result; other columns,
of whatever names, are carried by ``redact`` and ignored else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import written

#: Kinds in the order of the contract.
KINDS = ["email", "ip", "card", "phone"]
LABELERS = 4
#: Rows without any of these hold no candidate.
GUARD = r"[0-9@]|[\[({] ?(?:at|AT)"
# The base patterns, written so that a failing start is not tried again inside the same run
# (a look-behind, or the end of the match before) and loops never backtrack: linear in the text.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++ ?[\[({] ?(?:at|AT|@) ?[\])}] ?[A-Za-z0-9-]++(?: ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]){3}[0-9]{4}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
}
#: Gazetteers and cue words.
DOMAINS = "com org net edu gov mil int info biz io co de fr es it uk eu ch at nl be pl us ca au jp cn in br ru se no fi dk pt".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6)"
COUNTRIES = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[235689][0-9]{2})"
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|kontakt|courriel|correo)\W*(?:\w+\W+)?$",
    "ip": r"(?i)(?:\bip|host|server|address|adresse|from|client)\W*(?:\w+\W+)?$",
    "card": r"(?i)(?:card|visa|mastercard|amex|karte|carte|tarjeta|credit)\W*(?:\w+\W+)?$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|telefon|teléfono|téléphone)\W*(?:\w+\W+)?$",
}
AGAINST = r"(?i)(?:version|isbn|issn|order|invoice|build|release|serial|ref|token|section)\W*(?:\w+\W+)?$"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    doubled = lambda i: (F.substring(digits, n - i + 1, F.lit(1)).cast("int") * (F.lit(2) - i % 2))  # noqa: E731  every second from the right
    return F.aggregate(places, F.lit(0), lambda s, i: s + F.when(doubled(i) > 9, doubled(i) - 9).otherwise(doubled(i))) % 10 == 0


def holds(kind: str, found: Column) -> Column:
    """Whether a match of a base pattern passes the kind's further rule."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    return {
        "email": F.lit(True),
        "ip": found.rlike(r"^(?:0*+(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5]|)(?:\.|$)){4}$"),
        "card": F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False),
        "phone": F.length(digits).between(9, 15),
    }[kind]


def _gazetteer(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    known = {
        "email": F.lower(F.regexp_extract(found, r"([A-Za-z0-9-]+)$", 1)).isin(DOMAINS),
        "ip": ~found.rlike(r"^(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.") & ~found.rlike(r"^[0-9](?:\.[0-9]){3}$"),
        "card": digits.rlike(ISSUERS),
        "phone": digits.rlike(COUNTRIES),
    }[kind]
    return F.when(known, 1).otherwise(-1)


def _matches(rows: DataFrame, kind: str, pattern: str, base: bool) -> DataFrame:
    """One row for each match: (uid, kind, base, i, left, found, before, after, votes, features); ``left`` is the length since the match before."""
    around = F.transform(F.split("text", pattern, -1), lambda p: F.struct(F.char_length(p).alias("n"), F.right(p, F.lit(40)).alias("tail"), F.left(p, F.lit(1)).alias("head")))
    each = rows.where(F.col("text").rlike(pattern)).select("uid", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("all"), around.alias("around"))
    each = each.select("uid", "around", F.posexplode("all").alias("i", "found"))
    each = each.select("uid", "i", "found", F.get("around", F.col("i")).alias("left"), F.get("around", F.col("i") + 1).alias("right"))
    return each.select(
        "uid", F.lit(kind).alias("kind"), F.lit(base).alias("of_base"), (holds(kind, F.col("found")) if base else F.lit(False)).alias("base"), "i", F.col("left.n").alias("gap"), "found",
        F.col("left.tail").alias("before"), F.col("right.head").alias("after"), _votes(kind, base).alias("votes"), _features().alias("features"),
    )


def _votes(kind: str, base: bool) -> Column:
    """The four labelers' votes, each -1, 0 or 1."""
    found, before, after = F.col("found"), F.col("left.tail"), F.col("right.head")
    rule = F.when(holds(kind, found), 1).otherwise(-1) if base or kind == "card" else F.lit(0)
    context = F.when(before.rlike(CUES[kind]), 1).when(before.rlike(AGAINST), -1).otherwise(0)
    bounded = F.when(before.rlike(r"[\p{L}0-9_#=/]$") | after.rlike(r"^[\p{L}0-9_=/]"), -1).otherwise(1)
    return F.array(rule, _gazetteer(kind, found), context, bounded)


def _features() -> Column:
    """Discrete features of the span itself, as name=value."""
    found = F.col("found")
    digits = F.regexp_replace(found, "[^0-9]", "")
    kinds = F.size(F.array_distinct(F.split(digits, "")))
    feature = lambda name, x: F.concat(F.lit(name + "="), x.cast("string"))
    return F.array(
        feature("length", F.least(F.floor(F.char_length(found) / 4), F.lit(12))),
        feature("digits", F.least(F.length(digits), F.lit(20))),
        feature("variety", F.least(kinds, F.lit(9))),
        feature("separators", F.least(F.regexp_count(found, F.lit(r"[\x20().-]")), F.lit(8))),
        feature("left", F.when(F.col("left.tail") == "", "edge").when(F.col("left.tail").rlike(r"[\x20\n]$"), "space").otherwise("other")),
        feature("right", F.when(F.col("right.head") == "", "edge").when(F.col("right.head").rlike(r"^[\x20\n.,;]"), "space").otherwise("other")),
    )


def _table(state: Column, side: str, at: Column) -> Column:
    return F.element_at(state[side], (at + 1).cast("int"))


def reliabilities(counts: DataFrame, rounds: int = 25, smoothing: float = 2.0, weight: float = 1000.0) -> DataFrame:
    """(kind, votes, probability) by expectation-maximisation from (kind, votes, n).

    The state is the share of true spans and, for true and false spans, each labeler's
    probabilities of its three votes; the start trusts every labeler moderately. Counts weigh as
    shares of ``weight``, so that the same mixture has the same outcome at any size of the corpus.
    """
    counts = counts.withColumn("n", F.col("n") * weight / F.sum("n").over(Window.partitionBy("kind")))  # at most 81 rows
    patterns = counts.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("patterns"))  # at most 81
    slots = [(k, v) for k in range(LABELERS) for v in (-1, 0, 1)]
    floats = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    start = F.struct(F.lit(0.5).alias("share"), floats([0.1, 0.3, 0.6] * LABELERS).alias("yes"), floats([0.6, 0.3, 0.1] * LABELERS).alias("no"))

    def probability(state: Column, votes: Column) -> Column:
        odds = F.log(state["share"]) - F.log(1 - state["share"])
        for k in range(LABELERS):
            at = F.lit(3 * k + 1) + F.get(votes, F.lit(k))
            odds = odds + F.log(_table(state, "yes", at)) - F.log(_table(state, "no", at))
        return 1 / (1 + F.exp(-odds))

    def maximise(weighed: Column) -> Column:
        total = lambda what: F.aggregate(weighed, F.lit(0.0), lambda s, p: s + what(p))
        true, every = total(lambda p: p["n"] * p["q"]), total(lambda p: p["n"])
        hit = lambda p, k, v: F.when(F.get(p["votes"], F.lit(k)) == v, p["n"]).otherwise(0.0)
        yes = [(total(lambda p, k=k, v=v: hit(p, k, v) * p["q"]) + smoothing) / (true + 3 * smoothing) for k, v in slots]
        no = [(total(lambda p, k=k, v=v: hit(p, k, v) * (1 - p["q"])) + smoothing) / (every - true + 3 * smoothing) for k, v in slots]
        return F.struct(((true + smoothing) / (every + 2 * smoothing)).alias("share"), F.array(*yes).alias("yes"), F.array(*no).alias("no"))

    def step(state: Column, _: Column) -> Column:
        weighed = F.transform("patterns", lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), probability(state, p["votes"]).alias("q")))
        return F.get(F.transform(F.array(weighed), maximise), F.lit(0))

    fitted = patterns.withColumn("state", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step))
    each = fitted.select("kind", "state", F.explode("patterns").alias("p"))
    return each.select("kind", F.col("p.votes").alias("votes"), probability(F.col("state"), F.col("p.votes")).alias("probability"))


def find_candidates(rows: DataFrame) -> DataFrame:
    """All candidate spans of ``rows`` (uid, text), with votes and features: (uid, kind, base, start, stop, found, before, after, votes, features)."""
    found = None
    for base, patterns in ((True, PATTERNS), (False, WIDE)):
        for kind, pattern in patterns.items():
            part = _matches(rows, kind, pattern, base)
            found = part if found is None else found.unionByName(part)
    so_far = Window.partitionBy("uid", "kind", "of_base").orderBy("i")
    found = found.withColumn("stop", F.sum(F.col("gap") + F.char_length("found")).over(so_far).cast("long"))
    return found.select("uid", "kind", "base", (F.col("stop") - F.char_length("found")).alias("start"), "stop", "found", "before", "after", "votes", "features")


def classify(candidates: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """``candidates`` with ``probability`` from the span classifier."""
    voted = F.transform(F.sequence(F.lit(0), F.lit(LABELERS - 1)), lambda k: F.concat(F.lit("vote"), k.cast("string"), F.lit("="), F.get("votes", k).cast("string")))
    candidates = candidates.withColumn("features", F.concat("features", voted))
    soft = written(reliabilities(candidates.groupBy("kind", "votes").agg(F.count("*").alias("n"))), "votes")  # a row for each pattern of votes
    weighed = candidates.join(F.broadcast(soft), ["kind", "votes"])
    prior = weighed.groupBy("kind").agg(F.sum("probability").alias("yes"), F.sum(1 - F.col("probability")).alias("no"))
    values = weighed.select("kind", "probability", F.explode("features").alias("feature")).groupBy("kind", "feature").agg(F.sum("probability").alias("y"), F.sum(1 - F.col("probability")).alias("n"))
    odds = values.join(F.broadcast(prior), "kind").select(
        "kind", "yes", "no", "feature", (F.log((F.col("y") + smoothing) / (F.col("yes") + 2 * smoothing)) - F.log((F.col("n") + smoothing) / (F.col("no") + 2 * smoothing))).alias("odds")
    )
    model = odds.groupBy("kind").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "odds"))).alias("model"),  # a few dozen values for a kind
        F.any_value(F.log((F.col("yes") + smoothing) / (F.col("no") + smoothing))).alias("prior"),
    )
    scored = candidates.join(F.broadcast(written(model, "model")), "kind")
    total = F.aggregate("features", F.col("prior"), lambda s, f: s + F.coalesce(F.element_at("model", f), F.lit(0.0)))
    return scored.withColumn("probability", 1 / (1 + F.exp(-total))).drop("model", "prior")


def detect(rows: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(uid, bases, spans): each an array of (start, rank of the kind, stop) in order, for ``rows`` (uid, text) with any."""
    candidates = written(find_candidates(rows), "candidates")
    extra = (F.col("probability") >= threshold) & ~F.col("base") & (F.get("votes", F.lit(0)) >= 0)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int").alias("rank")
    found = classify(candidates).where(F.col("base") | extra).select("uid", "base", "start", rank, "stop").distinct()
    added = added_spans(found)
    span = F.struct("start", "rank", "stop")
    whole = found.where("base").select("uid", "base", span.alias("span")).unionByName(added.select("uid", F.lit(False).alias("base"), span.alias("span")))
    return whole.groupBy("uid").agg(F.array_sort(F.collect_list(F.when(F.col("base"), F.col("span")))).alias("bases"), F.array_sort(F.collect_list("span")).alias("spans"))


def added_spans(found: DataFrame) -> DataFrame:
    """(uid, start, rank, stop): the spans of ``found`` (uid, base, start, rank, stop) that are not base and meet no base one, nor each other.

    Sweeps over a document's spans in order: a base span meets one if it begins before and ends
    inside or behind, or is the next to begin. Spans that overlap in a chain are settled from the left,
    the longer of two that begin together first; such chains are short.
    """
    document = Window.partitionBy("uid")
    base_stop, base_start = (F.when(F.col("base"), F.col(c)) for c in ("stop", "start"))
    swept = found.withColumn("reached", F.max(base_stop).over(document.orderBy("start"))).withColumn("next", F.min(base_start).over(document.orderBy(F.col("start").desc())))
    free = swept.where(~F.col("base") & (F.coalesce("reached", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("next") >= F.col("stop"), F.lit(True)))
    longest_first = document.orderBy("start", F.col("stop").desc(), "rank")
    before = F.max("stop").over(longest_first.rowsBetween(Window.unboundedPreceding, -1))
    chained = free.withColumn("opens", F.coalesce((F.col("start") >= before), F.lit(True)).cast("long")).withColumn("chain", F.sum("opens").over(longest_first))
    chains = chained.groupBy("uid", "chain").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("stop")).alias("back"), "rank", "stop"))).alias("all"))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.slice("all", 1, 0).alias("kept"))
    take = lambda a, e: F.when(e["start"] >= a["at"], F.struct(e["stop"].alias("at"), F.concat(a["kept"], F.array(e)).alias("kept"))).otherwise(a)
    return chains.select("uid", F.inline(F.aggregate("all", begin, take)["kept"])).select("uid", "start", "rank", "stop")


def _suspect() -> Column:
    return F.coalesce(F.col("text").cast("string").rlike(GUARD), F.lit(False))


def _suspects(docs: DataFrame) -> DataFrame:
    """(uid, row) of the rows that can hold any; the id is fixed by writing them."""
    return written(docs.where(_suspect()).select(F.monotonically_increasing_id().alias("uid"), F.struct("*").alias("row")), "suspects")


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select("uid", F.col("row.text").cast("string").alias("text"))


def personal_data(docs: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(doc_id, bases, spans) for each row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = _suspects(docs)
    found = detect(_texts(rows), threshold)
    none = F.array().cast("array<struct<start:bigint,rank:int,stop:bigint>>")
    some = rows.select("uid", "row.doc_id").join(found, "uid", "left").select("doc_id", F.coalesce("bases", none).alias("bases"), F.coalesce("spans", none).alias("spans"))
    clean = docs.where(~_suspect()).select("doc_id", none.alias("bases"), none.alias("spans"))
    return clean.unionByName(some)


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"], s["stop"])), ",")


def redact(docs: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; other rows and columns stay as they are."""
    rows = _suspects(docs)
    changed = rows.join(detect(_texts(rows), threshold).select("uid", "spans"), "uid", "left")
    text = F.col("row.text").cast("string")
    whole = F.when(F.size("spans") > 0, replaced(text, F.col("spans"))).otherwise(text)
    return docs.where(~_suspect()).unionByName(changed.select(F.col("row").withField("text", whole).alias("row")).select("row.*"))


def replaced(text: Column, spans: Column, block: int = 256) -> Column:
    """``text`` with each of ``spans`` (start, rank, stop; sorted) replaced by its kind in brackets.

    A substring far into a text costs the way to it, so the text is cut into blocks once and only
    blocks with parts of spans are folded; what lies between them is joined as it is.
    """
    # inside lambdas, so that no part is evaluated again for each element
    given = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    label = lambda s: F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), s["rank"])), F.lit("]"))

    def parts_of(s: Column) -> Column:
        """A span's parts in each block that it touches; the first bears its kind."""

        def part(b: Column) -> Column:
            first = b == F.floor(s["start"] / block)
            return F.struct(b.alias("b"), F.greatest(s["start"] - b * block, F.lit(0)).alias("low"), first.cast("int").alias("first"), s["rank"].alias("rank"), F.least(s["stop"] - b * block, F.lit(block)).alias("high"), F.when(first, label(s)).otherwise("").alias("label"))

        return F.transform(F.sequence(F.floor(s["start"] / block), F.floor((s["stop"] - 1) / block)), part)

    def folded(whole: Column, parts: Column) -> Column:
        begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("made"))
        plain = lambda a, p: F.substring(whole, (a["at"] + 1).cast("int"), F.greatest(p["low"] - a["at"], F.lit(0)).cast("int"))
        step = lambda a, p: F.struct(F.greatest(a["at"], p["high"]).alias("at"), F.concat(a["made"], plain(a, p), p["label"]).alias("made"))
        return F.aggregate(parts, begin, step, lambda a: F.concat(a["made"], F.substring(whole, (a["at"] + 1).cast("int"), F.lit(block))))

    def joined(blocks: Column, parts: Column) -> Column:
        new = lambda i: (i == 0) | (F.get(parts, i)["b"] != F.get(parts, i - 1)["b"])
        n = F.size(parts)

        def assembled(starts: Column) -> Column:
            at = lambda j: F.coalesce(F.get(parts, F.get(starts, j))["b"], F.lit(-1))

            def piece(start: Column, j: Column) -> Column:
                here, before = at(j).cast("int"), F.when(j == 0, F.lit(-1)).otherwise(at(j - 1)).cast("int")
                own = F.slice(parts, start + 1, F.coalesce(F.get(starts, j + 1), n) - start)
                return F.concat(F.array_join(F.slice(blocks, before + 2, here - before - 1), ""), folded(F.get(blocks, here), own))

            rest = F.slice(blocks, at(F.size(starts) - 1).cast("int") + 2, F.size(blocks))
            return F.concat(F.array_join(F.transform(starts, piece), ""), F.array_join(rest, ""))

        return given(F.filter(F.sequence(F.lit(0), n - 1), new), assembled)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    return given(blocks, lambda whole: given(F.array_sort(F.flatten(F.transform(spans, parts_of))), lambda parts: joined(whole, parts)))
