"""The training-data operators against brute force, round trips, held-out accuracy and odd tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbforge.llm import bpe, chat, langid, media, minhash, mixing, packing, pii, quality, queries, tokens, topk

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kind string, size long, votes string"


def odd_documents(spark):
    """Nulls, blanks, repeated rows, ties, a very long text and columns whose names clash with internal ones."""
    texts = ["", None, "  \n", "a", "a b", "A  b", "one two three four five six", "one two three four five six", "x " * 30000, "mail me at jo@ex.org or +1 (555) 123-4567", "é" * 50, "9" * 3000 + " @@ " + "a" * 3000]
    rows = [(k, t, None if k == 3 else "en", None if k % 4 == 0 else f"s{k % 3}", None, "q", 1, "v") for k, t in enumerate(texts)]
    rows += [rows[6], (None, "one two three four five six", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    found = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text or "") if ok(m[0])]
    return sorted(found)


def test_pii_base_spans_match_brute_force(spark):
    random.seed(2)
    parts = ["a@b.co", "x_y@d-e.f.g", "1.2.3.4", "256.1.1.1", "0010.1.2.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+123", "12", "é", " ", ".", "@", "_", "+", "-", "\n", "x", "😀"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(1, 12))) for _ in range(400)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(r.doc_id + 1000, r.text) for r in documents(spark).collect()] + [(r.doc_id, r.text) for r in odd_documents(spark).collect()]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    out = pii.personal_data(made).select("doc_id", pii.spans_text(F.col("bases")).alias("b"), pii.spans_text(F.col("spans")).alias("s")).collect()
    want = sorted((str(k), ",".join(f"{pii.KINDS[kind]}:{a}:{b}" for a, kind, b in base_spans(t))) for k, t in rows)
    assert sorted((str(r.doc_id), r.b) for r in out) == want
    assert all(set(filter(None, r.b.split(","))) <= set(r.s.split(",")) for r in out)
    assert any(r.b for r in out)


def test_pii_finds_more_and_redacts(spark):
    cue = [(k, f"my phone is 555-123-{1000 + k} today") for k in range(30)] + [(100 + k, f"call +1 555-123-{1000 + k} now") for k in range(60)]
    made = spark.createDataFrame(cue, "doc_id long, text string")
    safe = {r.doc_id: r.text for r in pii.redact(made).collect()}
    assert safe[100] == "call [PHONE] now"
    clean = documents(spark).where(~F.col("text").rlike(r"[0-9@]"))
    assert pii.redact(clean).exceptAll(clean).isEmpty()
    odd = odd_documents(spark)
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()


def test_pii_reliabilities_match_reference_em(spark):
    """The SQL expectation-maximisation against plain loops."""
    random.seed(3)
    counts = {tuple(random.choice((-1, 0, 1)) for _ in range(pii.LABELERS)): random.randint(1, 40) for _ in range(25)}
    weighed = {v: n * 1000 / sum(counts.values()) for v, n in counts.items()}  # the operator weighs counts as shares
    share, yes, no = 0.5, np.tile([0.1, 0.3, 0.6], (pii.LABELERS, 1)), np.tile([0.6, 0.3, 0.1], (pii.LABELERS, 1))
    q_of = lambda v: 1 / (1 + (1 - share) / share * np.prod([no[k, x + 1] / yes[k, x + 1] for k, x in enumerate(v)]))
    for _ in range(25):
        q = {v: q_of(v) for v in counts}
        true, every = sum(n * q[v] for v, n in weighed.items()), sum(weighed.values())
        yes_n, no_n = np.full((pii.LABELERS, 3), 2.0), np.full((pii.LABELERS, 3), 2.0)
        for v, n in weighed.items():
            for k, x in enumerate(v):
                yes_n[k, x + 1] += n * q[v]
                no_n[k, x + 1] += n * (1 - q[v])
        share, yes, no = (true + 2) / (every + 4), yes_n / (true + 6), no_n / (every - true + 6)
    made = spark.createDataFrame([("ip", list(v), n) for v, n in counts.items()], "kind string, votes array<int>, n long")
    out = {tuple(r.votes): r.probability for r in pii.reliabilities(made).collect()}
    assert out.keys() == counts.keys() and all(abs(out[v] - q_of(v)) < 1e-9 for v in counts)


def test_pii_adds_spans_that_overlap_nothing(spark):
    """National numbers and hidden addresses near many true ones are added; ones within base spans or with a failed rule are not."""
    rows = [(k, f"call me, phone +1 555-123-{1000 + k} or mail jo{k}@corp.com please") for k in range(80)]
    rows += [(200 + k, f"my phone: (555) 234-{1000 + k}, e-mail jo{k} [at] corp [dot] com") for k in range(40)]
    rows += [(300, "card 4111 1111 1111 1112 x"), (301, "plain words only, no. 7")]
    made = spark.createDataFrame([(*r, "u", 1, "b") for r in rows], "doc_id long, text string, uid string, row int, spans string")
    out = {r.doc_id: (r.b, r.s) for r in pii.personal_data(made).select("doc_id", pii.spans_text(F.col("bases")).alias("b"), pii.spans_text(F.col("spans")).alias("s")).collect()}
    assert all(not out[200 + k][0] and "phone:10:24" in out[200 + k][1] for k in range(40))
    both = [200 + k for k in range(40) if "email:" in out[200 + k][1]]
    assert len(both) >= 30
    assert out[300] == out[301] == ("", "")
    for _, s in out.values():
        ends = [tuple(map(int, x.split(":")[1:])) for x in s.split(",") if x]
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    safe = pii.redact(made)
    assert safe.columns == made.columns and safe.where(F.col("doc_id") == both[0]).first().text == "my phone: [PHONE], e-mail [EMAIL]"


def test_chat_keeps_maximal_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", None), (3, 0, "user", "other"), (4, 0, "user", "other"), (5, 0, None, None), (6, 5, "user", "hi"), (None, 0, "user", "z"), (7, None, "user", "a"), (7, None, "user", "a")]
    out = {r.conv_id: r.rendered for r in chat.render_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(out) == {2, 3, 5, 7}
    assert out[2].endswith("<|im_start|>user\n<|im_end|>") and out[5] == "<|im_start|>unknown\n<|im_end|>"
    assert chat.render_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).isEmpty()


def test_chat_ties_and_long_conversations(spark):
    rows = [(1, k, "user", f"t{k}") for k in range(3000)] + [(2, k, "user", f"t{k}") for k in range(2500)] + [(3, k, "user", f"t{k}" if k != 2400 else "other") for k in range(2500)]
    rows += [(4, None, "user", f"n{k}") for k in range(50)] + [(5, 1, "user", "b"), (5, 1, "assistant", "a"), (6, 1, "assistant", "a"), (6, 1, "user", "b"), (6, 2, "user", "c"), (8, 0, "user", ""), (9, 0, "user", None)]
    random.seed(1)
    random.shuffle(rows)
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    out = {r.conv_id: r for r in chat.render_chat(made).collect()}
    assert set(out) == {1, 3, 4, 6, 8, 9}  # 2 is a prefix of 1, 5 one of 6; null and empty texts differ
    assert out[1].n_turns == 3000 and out[1].rendered == "\n".join(f"<|im_start|>user\nt{k}<|im_end|>" for k in range(3000))
    assert out[4].n_turns == 50 and out[6].rendered.endswith("<|im_start|>user\nc<|im_end|>")


def test_token_counts_match_naive_longest_match(spark):
    with open(queries._vocabulary(), encoding="utf-8") as f:
        pieces = tokens.byte_level_pieces(f.read())
    known, longest = set(pieces), max(map(len, pieces))

    def naive(word):
        at = n = 0
        while at < len(word):
            at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in known)
            n += 1
        return n

    automaton = tokens.LongestMatch(pieces)
    random.seed(1)
    words = [bytes(random.randrange(256) for _ in range(random.randint(1, 20))) for _ in range(500)] + [b" " + p + q for p, q in zip(random.sample(pieces, 2000), random.sample(pieces, 2000))] + [b"a" * 5000]
    assert [automaton.count(w) for w in words] == [naive(w) for w in words]
    texts = {r.doc_id: r.text for r in odd_documents(spark).collect()}
    for r in tokens.token_counts(odd_documents(spark), queries._vocabulary()).collect():
        parts = (texts[r.doc_id] or "").encode().split()
        assert (r.n_words, r.n_tokens) == (len(parts), sum(naive(b" " + w) for w in parts))


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.quality_scores(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    right = [r.predicted == r.quality for r in out]
    assert len(right) > 50 and sum(right) / len(right) > 0.95


def test_quality_matches_brute_force_discriminant(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.collect()}
    docs = [(r.doc_id, r.text) for r in documents(spark).collect()]
    train = [(k, np.array(quality.statistics_of(t)), known[k]) for k, t in docs if zlib.crc32(str(k).encode()) % 5 and k in known]
    fold_of = {r[0]: r[1] for r in documents(spark).select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(3)).cast("int")).collect()}

    def score(rows, x, pool, ridge, temperature):
        group = {c: np.stack([v for _, v, y in rows if y == c]) for c in (0, 1)}
        own = {c: np.cov(v.T, bias=True) for c, v in group.items()}
        pooled = sum(len(group[c]) * own[c] for c in (0, 1)) / len(rows)
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        logs = {}
        for c in (0, 1):
            s = ((1 - pool) * own[c] + pool * pooled) / np.outer(scale, scale)
            s = (1 - ridge) * s + ridge * max(np.trace(s) / len(s), 1e-3) * np.eye(len(s))
            z = (x - group[c].mean(axis=0)) / scale
            logs[c] = -0.5 * z @ np.linalg.solve(s, z) - 0.5 * np.linalg.slogdet(s)[1]
        prior = len(group[1]) / len(group[0])
        return 1 / (1 + np.exp(-((logs[1] - logs[0]) / temperature + np.log(prior))))

    losses = {}
    for choice in [(p, r, t) for p in quality.POOLS for r in quality.RIDGES for t in quality.TEMPERATURES]:
        loss = 0.0
        for k, x, y in train:
            p = np.clip(score([row for row in train if fold_of[row[0]] != fold_of[k]], x, *choice), 1e-6, 1 - 1e-6)
            loss -= np.log(p if y else 1 - p)
        losses[choice] = round(loss / len(train), 6)
    model = quality.fit(quality.statistics(documents(spark)), labels)
    chosen = (model.pool, model.ridge, model.temperature)
    assert losses[chosen] <= min(losses.values()) + 2e-6
    out = {r.doc_id: r.score for r in quality.quality_scores(documents(spark), labels).collect()}
    for k, t in docs[::5]:
        assert abs(out[k] - score(train, np.array(quality.statistics_of(t)), *chosen)) < 1e-6


def test_quality_odd_tables(spark):
    labels = spark.createDataFrame([(0, 1), (0, 0), (6, 1), (1, None), (99, 0)], "doc_id long, quality int")
    out = quality.quality_scores(odd_documents(spark), labels).collect()
    assert len(out) == 14 and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert quality.quality_scores(documents(spark).limit(0), labels).isEmpty()
    assert quality.keep_good(odd_documents(spark), labels.limit(0)).count() == 14  # nothing learned, nothing dropped


def shingles(text, width):
    w = WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_components(rows, width, percent):
    parent = {k: k for k, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(k, shingles(t, width)) for k, t in rows]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            common = len(x & y)
            if x and y and 100 * common >= percent * (len(x) + len(y) - common):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {k: find(k) for k, _ in rows}, {k: len(s) for k, s in sets}


def test_near_duplicates_match_brute_force(spark):
    random.seed(5)
    base = [f"w{k}" for k in range(60)]
    rows = [(r.doc_id + 500, r.text) for r in documents(spark).collect()]
    for k in range(80):  # a chain-like group around one text, with ties and copies
        words = list(base)
        for _ in range(k % 5):
            words[random.randrange(60)] = f"x{random.randrange(9)}"
        rows.append((k, " ".join(words)))
    rows += [(200, None), (201, ""), (202, "A b"), (203, "a\tB"), (204, "a")]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    comps, sizes = brute_components(rows, 3, 85)
    for r in minhash.near_duplicates(made, 3, 85).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (sizes[r.doc_id], comps[r.doc_id], comps[r.doc_id] == r.doc_id)


def test_near_duplicates_odd_tables(spark):
    out = minhash.near_duplicates(odd_documents(spark), 3, 85).collect()
    assert len(out) == 14 and {r.component_id for r in out if r.doc_id in (6, 7)} == {6}
    assert [r.kept for r in out if r.doc_id is None] == [True]
    assert minhash.near_duplicates(documents(spark).limit(0), 3, 85).isEmpty()
    kept = minhash.keep_one(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["0", "1", "2", "3", "4", "6", "8", "9", "10", "11", "None"])


def test_keep_one_drops_texts_not_ids(spark):
    near, clean = " ".join(f"w{k}" for k in range(60)), " ".join(f"clean{k}" for k in range(60))
    rows = [(1, near), (5, near + " end"), (5, clean), (7, clean + " end"), (7, "short"), (9, None), (9, ""), (9, "")]
    kept = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text or "", r.text is None) for r in kept) == sorted([(1, near, False), (5, clean, False), (7, "short", False), (9, "", True), (9, "", False)])


def test_leftover_buckets_cross_blocks(spark, monkeypatch):
    """Buckets of far more than ``unit`` members in several components: pairs of blocks are compared, and no link is lost."""
    random.seed(8)
    base, rows = [f"w{k}" for k in range(80)], []
    for k in range(120):
        words = list(base)
        for _ in range(random.choice([0, 1, 2, 4, 8])):
            words[random.randrange(80)] = f"x{random.randrange(40)}"
        rows.append((k, " ".join(words)))
    seen, real = [], minhash.link_leftovers
    monkeypatch.setattr(minhash, "link_leftovers", lambda placed, *a: seen.append(placed.agg(F.max("m")).first()[0]) or real(placed, *a))
    comps, sizes = brute_components(rows, 3, 85)
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, bands=40, perms_per_band=1, unit=8).collect()
    assert seen[0] > 16 and {r.doc_id: r.component_id for r in out} == comps


def test_near_duplicates_plans_stay_small(spark, monkeypatch):
    """No step of near-dedup derives again what an earlier one has: a plan's joins would multiply, and so would the stages that start at once."""
    seen, real = {}, minhash.written

    def counted(df, name):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        seen[name] = max(seen.get(name, 0), plan.count("Join "))
        return real(df, name)

    monkeypatch.setattr(minhash, "written", counted)
    near = " ".join(f"w{k}" for k in range(60))
    rows = [(k, near + f" end{k}" * (k % 3)) for k in range(9)]
    assert len(minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == 1
    assert {"checked", "mixed", "left"} <= set(seen) and max(seen.values()) <= 10, seen


def test_repeated_and_null_ids_follow_one_rule(spark):
    near = " ".join(f"w{k}" for k in range(60))
    rows = [(3, "text a one two"), (7, "text b one two"), (7, "text a one two"), (9, "text c one two"), (None, near), (None, near)]
    kept = lambda rows: sorted((str(r.doc_id), r.text) for r in minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [("3", "text a one two"), ("7", "text b one two"), ("9", "text c one two"), ("None", near), ("None", near)]
    assert kept(rows) == want
    assert kept([*rows, (9, "text c one two")]) == want  # a repeated row changes nothing for rows without id
    placed = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in placed if r.doc_id) == [("3", 3), ("7", 3), ("7", 7), ("9", 9)]


def test_cut_texts_keep_their_spacing(spark):
    docs = spark.createDataFrame([(1, "s", "\n a\n\n  b\tc d e "), (2, "t", "x")], "doc_id long, source string, text string")
    mix = mixing.queue(docs).where("doc_id = 1").withColumn("virtual_finish", F.lit(1.0))
    for taken, text in ((1, "\n a"), (3, "\n a\n\n  b\tc"), (5, "\n a\n\n  b\tc d e ")):
        assert mixing.mixed_documents(docs, mix.withColumn("taken", F.lit(taken))).first().text == text


def test_document_tokenizer_equals_library():
    from tokenizers import Tokenizer

    with open(queries._vocabulary(), encoding="utf-8") as f:
        text = f.read()
    ours, theirs = bpe.DocumentTokenizer(text), Tokenizer.from_str(text)
    random.seed(3)
    for x in ("x" + " " * 1_500_000 + "y", "\n" * 2_000_000, "a" * 2_000_000, "after all"):
        assert ours.ids(x).tolist() == theirs.encode(x, add_special_tokens=False).ids, len(x)
    parts = ["a", "B", " ", "  ", "\n", "\t", " ", "\x1c", "\x85", "é", "1", "²", "'s", "!", "😀", "<|endoftext|>", "中", "_", "don't", "the "]
    for _ in range(3000):
        x = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        assert ours.ids(x).tolist() == theirs.encode(x, add_special_tokens=False).ids, x


def test_packing_places_each_id_once(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries._vocabulary())
    docs = documents(spark).select("doc_id", "text").unionByName(odd_documents(spark).where("doc_id is not null").distinct().select(F.col("doc_id") + 10**6, "text").toDF("doc_id", "text"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in packing.pack_documents(docs, queries._vocabulary()).collect():
        by_doc[r.doc_id].append((r.start, r.ids))
        by_seq[r.sequence_id].append((r.offset, r.length))
        assert r.length == len(r.ids)
    for r in docs.collect():
        whole = [x for _, ids in sorted(by_doc[r.doc_id]) for x in ids]
        assert whole == tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
    room = 0
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
        room += 2048 - at
    assert packing.pack_documents(documents(spark).limit(0), queries._vocabulary()).isEmpty()


def test_packing_fills_windows_over_any_number_of_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for partitions in (1, 200):
        out = packing.pack_documents(docs.repartition(partitions), queries._vocabulary())
        used = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.sum("n").alias("ids"), F.count("*").alias("sequences")).first()
        assert used.ids >= 0.99 * 2048 * used.sequences


def test_packing_in_several_runs(spark):
    """Runs of few ids, repeated rows, rows without id and clashing columns: every row is packed, sequences of runs never mix."""
    rows = [(k % 7, f"text number {k} " * (k % 30), "x", 1) for k in range(200)] + [(None, "no id", "y", 2)] * 3 + [(5, None, "z", 3)] * 2
    made = spark.createDataFrame(rows, "doc_id long, text string, ids string, length int").repartition(2)
    out = packing.pack_documents(made, queries._vocabulary(), window=64, run_tokens=500, task_bytes=1).collect()
    by_seq = defaultdict(list)
    for r in out:
        by_seq[r.sequence_id].append((r.offset, r.length))
        assert r.length == len(r.ids) <= 64
    for pieces in by_seq.values():
        ends = [0, *np.cumsum([n for _, n in sorted(pieces)]).tolist()]
        assert [o for o, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 64
    assert len({q >> 33 for q in by_seq}) == 2 and sum(r.start == 0 for r in out) == 205
    with open(queries._vocabulary(), encoding="utf-8") as f:
        tokenizer = bpe.DocumentTokenizer(f.read())
    want = defaultdict(int)
    for k, t, *_ in rows:
        want[k] += len(tokenizer.ids(t or "")) + 1
    got = defaultdict(int)
    for r in out:
        got[r.doc_id] += r.length
    assert got == want


def test_token_counts_and_media_of_odd_tables(spark):
    made = spark.createDataFrame([(1, "a b", 9, "m"), (1, "a b", 9, "m"), (None, "x" * 400_000, 9, "m"), (2, None, 9, "m")], "doc_id long, text string, n_words int, media string")
    out = sorted((str(r.doc_id), r.n_words) for r in tokens.token_counts(made, queries._vocabulary()).collect())
    assert out == [("1", 2), ("1", 2), ("2", 0), ("None", 1)]
    found = sorted((str(r.doc_id), r.n_bytes) for r in media.media_features(media.store_media(made)).collect())
    assert found == [("1", 3), ("1", 3), ("2", 0), ("None", 400_000)]


def test_best_fit_decreasing_is_tightest():
    random.seed(4)
    lengths = np.array([random.randint(1, 100) for _ in range(500)])
    windows, offsets, count = packing.best_fit_decreasing(lengths, 100)
    rooms = []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [r for r in rooms if r >= lengths[i]]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else 100) - lengths[i])
    used = [int(lengths[windows == w].sum()) for w in range(count)]
    assert sorted(100 - u for u in used) == sorted(rooms)


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [(k, [float(x) for x in rng.normal(size=6)]) for k in range(400)]
    vectors += [(400 + k, vectors[7][1]) for k in range(60)] + [(500, None), (501, [1.0, float("nan")]), (502, [1.0, None]), (503, [float("inf")]), (550, [1.0, 2.0]), (600, []), (None, [1.0] * 6)]
    ints = {k: np.floor(256 * np.array(v)).astype(int) for k, v in vectors[:460]}
    out = defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), shard_numbers=540, query_numbers=24, block_rows=16).collect():
        out[r.query_id].append((r["rank"], r.vec_id, r.score))
    for q in [k for k in ints if k % 50 == 0]:
        best = sorted(((-int(ints[q] @ v), k) for k, v in ints.items() if k != q))[:5]
        assert sorted(out.pop(q)) == [(n + 1, k, -s) for n, (s, k) in enumerate(best)]
    assert not out  # the one query of another length has no partner


def test_top_k_deals_repeats_of_one_row(spark, monkeypatch):
    """A row that occurs thousands of times is dealt over all units, and every occurrence is found."""
    made = []
    keep = topk.written
    monkeypatch.setattr(topk, "written", lambda df, name: made.append(keep(df, name)) or made[-1])
    rows = [(0, [1.0, 2.0])] + [(1, [3.0, 1.0])] * 4000
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_numbers=800).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in out) == [(n, 1, 256 * 256 * 5) for n in range(1, 6)]
    units = [r["count"] for r in made[0].groupBy(F.pmod(F.xxhash64("row"), F.lit(11)).alias("shard")).count().collect()]
    assert len(units) == 11 and max(units) < 2 * 4001 / 11


def test_empty_tables_and_further_columns(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>, vec string, dims string, group int, shard int")
    assert topk.top_k(none).isEmpty()
    some = spark.createDataFrame([(0, [1.0, 2.0], "a", "b", 1, 2), (7, [2.0, 1.0], None, None, None, None), (7, [2.0, 1.0], None, None, None, None)], none.schema)
    assert [(r.query_id, r["rank"], r.vec_id) for r in topk.top_k(some).collect()] == [(0, 1, 7), (0, 2, 7)]
    turns = spark.createDataFrame([(1, 0, "user", "x", 9, 9, 9, 9)], "conv_id long, turn long, role string, text string, pos long, block long, n long, one long")
    assert chat.render_chat(turns).count() == 1
    empty = odd_documents(spark).limit(0)
    assert tokens.token_counts(empty, queries._vocabulary()).isEmpty()
    assert pii.personal_data(empty).isEmpty() and pii.redact(empty).isEmpty()
    assert langid.identify(empty, langid.learn(empty)).isEmpty()


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs)
    out = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
    odd = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd_documents(spark), model).collect()}
    assert odd[0] == odd[1] == odd[2] == ("und", 0.0) and odd[6][0] != "und"
    none = langid.learn(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(odd_documents(spark), none).collect()} == {"und"}


def brute_language(train, text, grams_of, min_share=2e-5):
    """Predictions with plain dictionaries: counts by language and slot, a bit where the share suffices, corrected counts."""
    counts, totals = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for t, lang in train:
        for gram in grams_of(t):
            for slot in gram:
                counts[lang][slot] += 1
                totals[lang] += 1
    bits = {g: {s for s, n in c.items() if n * langid.HASHES >= min_share * totals[g]} for g, c in counts.items()}
    parts = 1 << langid.SLOT_BITS
    rate = {g: np.prod([sum(s // parts == k for s in b) / parts for k in range(langid.HASHES)]) for g, b in bits.items()}
    grams = grams_of(text)
    level = {g: max((sum(all(s in b for s in gram) for gram in grams) - len(grams) * rate[g]) / (1 - rate[g]), 0) for g, b in bits.items()}
    best = min(level, key=lambda g: (-level[g], g))
    return best, level[best] / sum(level.values()) if sum(level.values()) else 0.0


def test_language_filter_matches_brute_force_beyond_64_languages(spark, monkeypatch):
    random.seed(6)
    text = "Größe x\U00010428y 12 " * 9
    whole = list(langid.slots(text))
    monkeypatch.setattr(langid, "BLOCK", 16)  # a text of many blocks has the same n-grams
    assert len(list(langid.slots(text))) > 5 and np.array_equal(np.concatenate([x for _, x in langid.slots(text)]), whole[0][1])
    monkeypatch.undo()
    rows = []
    for k in range(70):
        letters = random.sample("abcdefghijklmnopqrstuvwxyzäöüßéèñçøåþð\U00010428", 6)
        for m in range(8):
            rows.append((len(rows), " ".join("".join(random.choice(letters) for _ in range(random.randint(2, 7))) for _ in range(40)), f"l{k:02d}"))
    rows += [(1000, None, "l01"), (1001, "1 2 3", "l02"), (1002, "abc", None)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string").unionAll(spark.createDataFrame(rows[:2], "doc_id long, text string, lang string"))
    model = langid.learn(made, held_langs=3)
    assert len(model.langs) == 70 and model.masks.shape[0] == 2

    def grams_of(text):
        low = " " + "".join(c.lower() if c.isalpha() else " " for c in text) + " "
        return [tuple(x) for g in (low[k : k + 3] for k in range(len(low) - 2)) if g[1] != " " and g.strip(" ") and len(g.replace(" ", "")) >= 2 for x in slot_of(g)]

    def slot_of(gram):
        value = 0
        for c in gram:
            value = value << 21 | (0 if c == " " else ord(c))
        x = int(langid.mix(np.array([value], np.uint64))[0])
        return [[(x >> langid.SLOT_BITS * k & (1 << langid.SLOT_BITS) - 1) + (k << langid.SLOT_BITS) for k in range(langid.HASHES)]]

    train = [(r.text, r.lang) for r in made.collect() if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5]
    out = {r.doc_id: r for r in langid.identify(made, model).collect()}
    for k, text, _ in rows[::23]:
        lang, score = brute_language(train, text, grams_of)
        assert out[k].lang_pred == lang and abs(out[k].score - score) < 1e-8
    assert sum(out[k].lang_pred == lang for k, _, lang in rows[:560]) > 500
    assert out[1000].lang_pred == out[1001].lang_pred == "und"


def brute_targets(sizes, share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, budget = {}, share * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in target]
        left = budget - sum(target.values())
        level = left / sum(weight[s] for s in rest) if rest else 0
        full = [s for s in rest if level * weight[s] > most * sizes[s]]
        if not full:
            return target | {s: level * weight[s] for s in rest}
        target |= {s: most * sizes[s] for s in full}


@pytest.mark.parametrize("make", [documents, odd_documents])
def test_mixing_meets_targets(spark, make):
    docs = make(spark)
    queued = mixing.queue(docs, blocks=16)
    mix = mixing.mix_sources(queued, blocks=16)
    out = mixing.words_taken(queued, mix).collect()
    assert len(out) == docs.count()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want = brute_targets(sizes)
    for r in out:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + r.target)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    finish = [r.virtual_finish for r in mix.select("virtual_finish").collect()]
    assert finish == sorted(finish)
    mixed = mixing.mixed_documents(docs, mix, in_order=True)
    assert mixed.columns == docs.columns and mixed.count() == mix.count()
    assert sum(len(WORD.findall(r.text)) for r in mixed.collect()) == sum(taken.values())
    key = lambda rows: sorted((str(r.doc_id), r.size, r.taken) for r in rows)
    again = mixing.queue(docs.repartition(3), blocks=16)
    assert key(mixing.words_taken(again, mixing.mix_sources(again, blocks=16)).collect()) == key(out)
    assert mixing.mix_sources(mixing.queue(docs.limit(0))).isEmpty()


def brute_mix(queued, most=2, grain=16384, in_order=True):
    """Words taken by (document, start in its queue): all parts in one list, sorted by virtual finish, truncated at the budget."""
    parts = []
    for r in queued:
        quantum = -(-r.source_size // grain)
        for copy in range(most):
            for at in range(0, r.size, max(1, quantum)):
                sent = r.start + copy * r.source_size + at
                words = min(quantum, r.size - at, most * r.source_size - sent)
                if sent < r.target and words > 0:
                    parts.append(((sent + words) / r.target, r.source is None, (r.source or "").encode(), sent, words, (r.doc_id, r.source, r.start)))
    left, taken = queued[0].budget if queued else 0, defaultdict(int)
    for *_, words, row in sorted(parts) if in_order else sorted(parts, key=lambda part: part[1:4]):
        taken[row] += min(words, left)
        left -= min(words, left)
    return {row: n for row, n in taken.items() if n}


@pytest.mark.parametrize("make", [documents, odd_documents])
@pytest.mark.parametrize("grain", [16384, 50, 1])
def test_mixing_is_cut_in_virtual_finish_order(spark, make, grain):
    """What is taken equals a plain sort and truncation, whatever the length of parts; another order takes other words."""
    queued = mixing.queue(make(spark), blocks=16)
    rows = queued.collect()
    mix = mixing.mix_sources(queued, blocks=16, grain=grain)
    taken = defaultdict(int)
    for r in mix.collect():
        taken[(r.doc_id, r.source, r.start)] += r.taken
    assert taken == brute_mix(rows, grain=grain) and sum(taken.values()) <= rows[0].budget
    if make is documents:
        assert taken != brute_mix(rows, grain=grain, in_order=False) and sum(taken.values()) == rows[0].budget
        got = defaultdict(int)
        for (_, source, _), n in taken.items():
            got[source] += n
        for r in rows:
            assert abs(got[r.source] - r.target) <= max(-(-r.source_size // grain), 1)


def test_mixing_tells_two_texts_of_one_id_apart(spark):
    docs = spark.createDataFrame([(1, "a b c", "s"), (1, "d e f g", "s"), (1, "a b c", "s"), (2, "x " * 9, None)], "doc_id long, text string, source string")
    queued = mixing.queue(docs)
    mix = mixing.mix_sources(queued)
    mixed = mixing.mixed_documents(docs, mix, in_order=True)
    assert sum(len(WORD.findall(r.text)) for r in mixed.collect()) == sum(r.taken for r in mix.collect())
    assert {r.text for r in mixed.collect()} >= {"a b c", "d e f g"}


def test_media_round_trip(spark):
    docs = odd_documents(spark).unionByName(documents(spark).withColumns({"kind": F.lit("k"), "size": F.lit(1), "votes": F.lit("")}))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    out = media.media_features(media.store_media(docs)).collect()
    want = []
    for k, t in texts:
        data = (t or "").encode()
        pay = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        want.append((str(k), len(data), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out) == sorted(want)
    by_text = defaultdict(set)
    for r in out:
        by_text[r.payload_sha256].add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values())
    assert media.media_features(media.store_media(docs.limit(0))).isEmpty()


def test_media_of_lost_attempts_is_not_read(spark, tmp_path):
    """Archives that a lost attempt has left beside the others, whole or broken, take no part."""
    docs = odd_documents(spark)
    folder, manifest = f"file://{tmp_path}/a", f"file://{tmp_path}/m"
    assert media.write_archives(docs, folder).count() > 0  # an attempt whose result nobody took
    media.write_archives(docs, folder).write.parquet(manifest)
    (tmp_path / "a" / "part-000000-00000-999999.zip").write_bytes(b"broken")
    kept = media.read_archives(spark, folder, manifest=manifest)
    ids = lambda df: sorted(str(r.doc_id) for r in df.collect())
    assert ids(kept) == ids(docs)
    empty = f"file://{tmp_path}/e"
    media.write_archives(docs.limit(0), folder).write.parquet(empty)
    assert media.read_archives(spark, folder, manifest=empty).isEmpty()


def test_media_retries_members_by_offset(tmp_path):
    import zipfile

    from pyarrow import fs

    with zipfile.ZipFile(tmp_path / "part-0.zip", "w") as z:
        for k in range(5):
            z.writestr(f"{k:08d}_{k}.png", media.encode_png(media.payload_of("x" * k)))
    reader = media.ArchiveReader({"path": str(tmp_path), "rangebytes": "200"})
    parts = reader.partitions()
    assert len(parts) > 1
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows] == [0, 1, 2, 3, 4]
    assert [media.decode_png(r["media"])[:4] for r in rows][3] == b"xxx\xff"

    class Flaky:
        """A store whose first ``failures`` handles fail: a lost open, a short read, or a read that raises."""

        def __init__(self, kinds):
            self.kinds, self.opened = list(kinds), 0

        def open_input_file(self, path):
            self.opened += 1
            kind = self.kinds.pop(0) if self.kinds else None
            if kind == "open":
                raise OSError("lost")
            source = fs.LocalFileSystem().open_input_file(path)
            if kind is None:
                return source

            class Bad:
                seek, close = source.seek, source.close

                def read(self, n):
                    if kind == "read":
                        raise OSError("lost")
                    return source.read(min(n, 7))  # short

            return Bad()

    path = str(tmp_path / "part-0.zip")
    infos = zipfile.ZipFile(path).infolist()
    for kinds in (["open"], ["short"], ["read"], ["open", "short"]):
        store = Flaky(kinds)
        archive = media.ArchiveHandle(store, path, 3)
        assert media.decode_png(reader.member(archive, infos[2]))[:2] == b"xx" and store.opened == len(kinds) + 1
        assert media.decode_png(reader.member(archive, infos[3]))[:3] == b"xxx" and store.opened == len(kinds) + 1  # the same handle
    store = Flaky(["open", "open"])
    assert len(reader.directory(media.ArchiveHandle(store, path, 3))) == 5 and store.opened == 3
    with pytest.raises(RuntimeError, match="lost"):
        reader.directory(media.ArchiveHandle(Flaky(["open"] * 3), path, 3))
    infos[2].CRC ^= 1
    with pytest.raises(RuntimeError, match="checksum"):
        reader.member(media.ArchiveHandle(fs.LocalFileSystem(), path, 3), infos[2])


def test_pipeline_stages_match_brute_force(spark):
    """Each stage's content against a plain version of it, on what the stage before has kept."""
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    as_rows = lambda df: [r.asDict() for r in df.collect()]
    docs = documents(spark)
    # quality classifier: rows at or above the threshold of a model of the same labels, unchanged
    good = stage["quality classifier"](spark, docs, SF)
    model = quality.fit(quality.statistics(docs), labels)
    scored = {r.doc_id: float(model.scores(np.array([quality.statistics_of(r.text)]))[0]) for r in docs.collect()}
    assert as_rows(good.orderBy("doc_id")) == [r for r in as_rows(docs.orderBy("doc_id")) if scored[r["doc_id"]] >= 0.3]
    # near-dedup: the smallest id of each component of five-word shingles at 0.8
    kept = stage["min-max near-dedup"](spark, good, SF)
    comps, _ = brute_components([(r["doc_id"], r["text"]) for r in as_rows(good)], 5, 80)
    assert as_rows(kept.orderBy("doc_id")) == [r for r in as_rows(good.orderBy("doc_id")) if comps[r["doc_id"]] == r["doc_id"]]
    # personal data: every span of the detector replaced, all else as it was
    safe = stage["personal data"](spark, kept, SF)
    spans = {r.doc_id: [(s["start"], s["stop"], pii.KINDS[s["rank"] - 1]) for s in r.spans] for r in pii.personal_data(kept).collect()}
    want = []
    for r in as_rows(kept.orderBy("doc_id")):
        for start, stop, kind in reversed(spans[r["doc_id"]]):
            r["text"] = r["text"][:start] + f"[{kind.upper()}]" + r["text"][stop:]
        want.append({**r, "n_chars": len(r["text"] or "")})
    assert as_rows(safe.orderBy("doc_id")) == want
    # mixing: each source near its target, texts whole but for one prefix a source
    mixed = stage["source mixing"](spark, safe, SF)
    before, sizes, taken, cut = {r["doc_id"]: r for r in want}, defaultdict(int), defaultdict(int), defaultdict(int)
    for r in want:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    for r in as_rows(mixed):
        old = before[r["doc_id"]]
        assert old["text"].startswith(r["text"]) and r["n_chars"] == len(r["text"]) and all(r[c] == old[c] for c in ("lang", "source"))
        taken[r["source"]] += len(WORD.findall(r["text"]))
        cut[r["source"]] += r["text"] != old["text"]
    goal = brute_targets(sizes)
    assert all(abs(taken[s] - goal[s]) <= 1 and cut[s] <= 1 for s in sizes)
    # packing: the ids of every mixed text
    packed = stage["packing"](spark, mixed, SF)
    with open(queries._vocabulary(), encoding="utf-8") as f:
        tokenizer = bpe.DocumentTokenizer(f.read())
    whole = defaultdict(int)
    for r in as_rows(mixed):
        whole[r["doc_id"]] += len(tokenizer.ids(r["text"])) + 1
    assert {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == whole


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    docs = documents(spark).unionByName(odd_documents(spark).select(documents(spark).columns)).withColumns({"kept": F.lit("k"), "uid": F.lit(1), "score": F.lit(None).cast("double")})
    columns, count = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == columns and stage(spark, docs.limit(0), SF).isEmpty(), name
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert 0 < docs.count() <= 2 * count
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.agg(F.sum("length")).first()[0] > 0
