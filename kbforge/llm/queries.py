"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, langid, media, minhash, mixing, negatives, packing, pieces, pii, quality, tokens, topk, variants
from .workspace import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("bases", lambda s: s["rank"] == pii.KINDS.index(kind) + 1)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.spans_text(F.col("bases")), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_chat(_table(spark, sf_dir, "conversations"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), _vocabulary())


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), _vocabulary())

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values, ends = ids.values.to_numpy().astype("<u4"), ids.offsets.to_pylist()
            crc = pa.array([zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.int64())
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), crc], [*names, "ids_crc32"])

    return pieces.mapInArrow(digest, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    queued = written(mixing.queue(_table(spark, sf_dir, "documents")), "queued")
    taken = mixing.words_taken(queued, mixing.mix_sources(queued))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.store_media(_table(spark, sf_dir, "documents")))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(variants.word_counts(_table(spark, sf_dir, "documents"), slips=97))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return negatives.hard_negatives(vectors.withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    encoded = pieces.encode_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    text = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_pii, op2_chat, op3_tokens, op4_quality, op5_minhash, op6_packing, op7_topk, op8_langid, op9_mixing, op10_media, op11_variants, op12_negatives, op13_pieces]
    found = {f.__name__: f for f in own}
    import corpus_pipeline

    found["pipeline"] = corpus_pipeline.run
    return found


ORACLES = {
    "op2_chat": r"""
        with rows as (select conv_id, coalesce(role, 'unknown') as shown, role, text,
                   row_number() over (partition by conv_id order by turn nulls first, md5(coalesce(md5(role), '') || '|' || coalesce(md5(text), ''))) as pos
            from conversations where conv_id is not null),
        whole as (select conv_id, count(*) as n, list(struct_pack(r := role, t := text) order by pos) as turns,
                   string_agg('<|im_start|>' || shown || chr(10) || coalesce(text, '') || '<|im_end|>', chr(10) order by pos) as rendered
            from rows group by conv_id),
        once as (select min(conv_id) as conv_id from whole group by turns),
        inner_prefixes as (select distinct turns[1:k] as turns from whole, range(1, n) as r(k))
        select w.conv_id, w.n as n_turns, w.rendered from whole w join once using (conv_id)
        where w.turns not in (select turns from inner_prefixes)""",
    "op5_minhash": r"""
        with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
                   else list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) end as s from words),
        each as (select doc_id, len(s) as n, unnest(s) as x from sets),
        pairs as (select a.doc_id as a, b.doc_id as b from each a join each b on a.x = b.x and a.doc_id <> b.doc_id
            group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        reach as (select doc_id as a, doc_id as b from sets union select r.a, p.b from reach r join pairs p on r.b = p.a)
        select s.doc_id, len(s.s) as n_shingles, c.component_id, s.doc_id = c.component_id as kept
        from sets s join (select a, min(b) as component_id from reach group by a) c on c.a = s.doc_id""",
    "op7_topk": """
        with v as (select vec_id, [cast(floor(256 * cast(c as double)) as bigint) for c in embedding] as x from embeddings),
        scored as (select q.vec_id as query_id, c.vec_id, cast(list_sum([q.x[i] * c.x[i] for i in range(1, len(q.x) + 1)]) as bigint) as score
            from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
        select query_id, cast(rank as int) as rank, vec_id, score
        from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 5""",
    "op11_variants": r"""
        with recursive runs as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run from documents),
        each as (select doc_id, run, count(*) as n from runs group by all),
        bits as (select *, list_reduce(list_prepend(cast(4294967295 as ubigint), flatten([[cast(('0x' || substr(b, 2 * k - 1, 2)) as ubigint), 0, 0, 0, 0, 0, 0, 0] for k in range(1, len(b) // 2 + 1)])),
                lambda c, x: xor(xor(c, x) >> 1, cast(3988292384 as ubigint) * (xor(c, x) & 1))) as c
            from (select *, hex(encode(doc_id || ':' || run)) as b from each)),
        summed as (select run, n, xor(c, 4294967295) as h from bits),
        slipped as (select case when h % 97 = 0 then substr(run, 1, cast(h % length(run) as bigint)) || substr(run, cast(h % length(run) as bigint) + 2) else run end as word, n from summed),
        words as (select word, cast(sum(n) as bigint) as n from slipped where length(word) >= 5 group by word having sum(n) >= 3),
        skips as (select word, n, i, substr(word, 1, i - 1) as a, substr(word, i + 1) as b from words, range(1, length(word) + 1) as r(i)),
        near as (select distinct x.word, y.word as other, y.n from skips x join skips y on x.i = y.i and x.a = y.a and x.b = y.b and x.word <> y.word
            union select x.word, y.word, y.n from skips x join words y on x.a || x.b = y.word
            union select y.word, x.word, x.n from skips x join words y on x.a || x.b = y.word),
        best as (select word, count(*) as n_near, arg_min(struct_pack(other := other, n := n), struct_pack(m := -n, other := encode(other))) as top from near group by word),
        formed as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when top.n >= 2 * w.n then top.other end as form, case when top.n >= 2 * w.n then top.n end as form_n from words w left join best using (word)),
        led as (select word, word as here, form as next, 0 as step from formed union all select l.word, f.word, f.form, l.step + 1 from led l join formed f on f.word = l.next)
        select f.word, f.n, f.n_near, f.form, f.form_n, e.root from formed f join (select word, arg_max(here, step) as root from led group by word) e using (word)""",
    "op12_negatives": """
        with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                   [cast(floor(256 * cast(c as double)) as bigint) for c in embedding] as x from embeddings where label is not null),
        scored as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, cast(list_sum([a.x[i] * c.x[i] for i in range(1, len(a.x) + 1)]) as bigint) as score
            from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 100 = 0),
        positives as (select anchor_id, vec_id as positive_id, score as positive_score from scored where same
            qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
        select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as int) as rank,
            vec_id as negative_id, positive_score, score as negative_score
        from positives join scored using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
        qualify rank <= 10""",
}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
