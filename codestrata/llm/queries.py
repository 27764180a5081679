"""Registered queries of the training-data operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import embed_dup, langid, lexical, mixing, near_dup, packing, pii, prefix_trie, quality, sharding, token_ids, topk, url_filter

END_ID = 1


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, from the token files it was written to."""
    import public_tokenizers

    folder, files = token_ids.write_token_ids(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return token_ids.read_token_ids(spark, folder, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return url_filter.judged(_table(spark, sf_dir, "pages"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every row whose id is divisible by 50."""
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data and disclosing terms, as places in its text."""
    found = pii.found(_table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != pii.TERM)
    return found.select(F.col("row.doc_id").alias("doc_id"), *map(count, pii.KINDS), F.sha2(pii.written(base), 256).alias("base_sha256"),
                        pii.written(F.col("spans")).alias("spans"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from four fifths of the ids."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.trained(docs.where(~langid.held_out()).select("text", "lang"))
    return langid.predicted(docs, model).select(
        F.col("row.doc_id").alias("doc_id"), langid.held_out("row`.`doc_id").alias("held_out"), "lang_pred", "score")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near copies."""
    return near_dup.labelled(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its measures and verdict."""
    return quality.judged(_table(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot among 40."""
    return sharding.interleaved(_table(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words the mix takes of it."""
    return mixing.sampled(_table(spark, sf_dir, "documents"), weight=mixing.log_size).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bucket, batch and slot by its number of words."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", mixing.word_count(F.col("text")).alias("n_words"))
    return packing.packed(docs, "n_words")


def op11_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links within its label, and its component."""
    return embed_dup.links(_table(spark, sf_dir, "embeddings"), 0.93)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return lexical.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 10)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie.trie(prefix_trie.with_heads(prefix_trie.conversations_of(_table(spark, sf_dir, "conversations"))))


QUERIES = {
    "op1_token_ids": op1_token_ids,
    "op2_url_filter": op2_url_filter,
    "op3_top_k": op3_top_k,
    "op4_pii": op4_pii,
    "op5_language": op5_language,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_quality_rules": op7_quality_rules,
    "op8_sharding": op8_sharding,
    "op9_mixing": op9_mixing,
    "op10_packing": op10_packing,
    "op11_embedding_links": op11_embedding_links,
    "op12_ranked_search": op12_ranked_search,
    "op13_prefix_trie": op13_prefix_trie,
}
_STOPS = ", ".join(f"'{w}'" for line in quality.STOP_WORDS for w in line.split())

ORACLE: dict[str, str] = {
    "op7_quality_rules": rf"""
        with d as (
            select row_number() over () as r, doc_id, coalesce(text, '') as t from documents
        ), split as (
            select r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d
        ), w as (
            select r, unnest(ws) as word, unnest(range(len(ws))) as pos from split
        ), windows as (
            select r, pos, word, lead(word, 1) over p as b, lead(word, 2) over p as c, lead(word, 3) over p as e, lead(word, 4) over p as f
            from w window p as (partition by r order by pos)
        ), found as (
            select *, f is not null and count(*) over (partition by r, word, b, c, e, f) > 1 as again from windows
        ), covered as (
            select r, word, max(case when again then 1 else 0 end) over (partition by r order by pos rows between 4 preceding and current row) as hit from found
        ), words as (
            select r, count(*) as n_words, sum(length(word)) as word_chars, sum(hit) as n_repeat_words,
                   sum(case when lower(word) in ({_STOPS}) then 1 else 0 end) as n_stop_words
            from covered group by r
        ), l as (
            select r, unnest(string_split(t, chr(10))) as line from d
        ), lines as (
            select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines,
                   sum(case when regexp_matches(line, '^[\x20\x09-\x0D]*[-*•]') then 1 else 0 end) as n_bullet_lines,
                   sum(case when regexp_matches(line, '([.][.][.]|…)[\x20\x09-\x0D]*$') then 1 else 0 end) as n_cut_lines
            from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by r
        ), m as (
            select doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars,
                   len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
                   coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_stop_words, 0) as n_stop_words,
                   coalesce(n_lines, 0) as n_lines, coalesce(n_bullet_lines, 0) as n_bullet_lines, coalesce(n_cut_lines, 0) as n_cut_lines
            from d left join words using (r) left join lines using (r)
        ), base as (
            select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m
        )
        select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
               cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
               not base_failed and word_chars >= 2 * n_words and word_chars <= 15 * n_words and 10 * n_symbols <= n_words
               and 100 * (n_stop_words + 1) >= 4 * n_words and 10 * (n_dup_lines - 1) <= 3 * n_lines
               and 10 * n_bullet_lines <= 9 * n_lines and 10 * n_cut_lines <= 3 * n_lines as kept
        from base
    """,
    "op11_embedding_links": """
        with recursive v as (
            select row_number() over () as r, vec_id, label, cast(embedding as double[]) as e from embeddings
        ), whole as (
            select * from v where label is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
                              and len(list_filter(e, lambda x: x <> 0)) > 0
        ), pairs as (
            select a.r as x, b.r as y from whole a join whole b on a.label = b.label and len(a.e) = len(b.e) and a.r <> b.r
            where list_cosine_similarity(a.e, b.e) >= 0.93
        ), reach as (
            select r as x, r as y from v union select reach.x, pairs.y from reach join pairs on reach.y = pairs.x
        ), comps as (
            select reach.x, min(vec_id) as component_id from reach join v on v.r = reach.y group by reach.x
        ), amounts as (
            select x, count(*) as n from pairs group by x
        )
        select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
        from v join comps on comps.x = v.r left join amounts on amounts.x = v.r
    """,
    "op13_prefix_trie": """
        with said as (
            select conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))
                                 order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as own
            from conversations where conv_id is not null group by conv_id
        ), crc_table as (
            select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k:
                case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as e
        ), hashed as (
            select conv_id, own, conv_id - conv_id % 100 as base, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(
                string_split(cast(conv_id as varchar), ''), lambda ch: ascii(ch)::bigint)), lambda c, b: xor(c >> 8, e[(xor(c, b) & 255) + 1]))) % 6 as h
            from said, crc_table
        ), rebuilt as (
            select a.conv_id, list_concat(coalesce(b.own[1 : a.h], []), a.own[a.h + 1 :]) as turns
            from hashed a left join said b on a.base = b.conv_id
        ), prefixes as (
            select conv_id, turns, unnest(range(len(turns) + 1)) as depth from rebuilt
        ), nodes as (
            select turns[1 : depth] as path, depth, min(conv_id) as conv_id, count(*) as n_convs,
                   sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (len(turns) = depth), '')) as ends_sha256
            from prefixes group by all
        ), numbered as (
            select *, row_number() over () as node from nodes
        ), kids as (
            select p.node, count(*) as n from numbered p join numbered c on c.depth = p.depth + 1 and c.path[1 : p.depth] = p.path group by p.node
        ), facts as (
            select n.*, coalesce(k.n, 0) as n_children, case when depth > 0 then (n_convs - 1) * length(path[depth].t) else 0 end as mine
            from numbered n left join kids k using (node)
        ), above as (
            select node, unnest(range(depth + 1)) as up, path, n_children, mine from facts
        ), sums as (
            select path[1 : up] as path, count(*) filter (n_children = 0) as n_leaves, sum(mine) as saved from above group by all
        )
        select f.conv_id, f.depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, s.n_leaves, cast(s.saved as bigint) as saved_tokens, f.ends_sha256
        from facts f join sums s on f.path = s.path left join facts p on f.depth > 0 and p.path = f.path[1 : f.depth - 1] and p.depth = f.depth - 1
    """,
    "op12_ranked_search": r"""
        with d as (
            select row_number() over () as r, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents
        ), held as (
            select r, doc_id, ts, len(ts) as n from d where len(ts) > 0
        ), totals as (
            select count(*) as whole, cast(sum(n) as bigint) as length from held
        ), items as (
            select distinct item_id, unnest(regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark
        ), words as (
            select r, unnest(ts) as term from held
        ), uses as (
            select r, term, count(*) as tf from words where term in (select term from items) group by r, term
        ), weights as (
            select term, cast(floor(1000 * ln(cast(2 * whole + 2 as double) / (2 * count(*) + 1))) as bigint) as w
            from uses, totals group by term, whole
        ), worth as (
            select u.r, u.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * whole) // length))) as part
            from uses u join held using (r) join weights using (term), totals
        ), scored as (
            select item_id, r, cast(sum(part) as bigint) as score from items join worth using (term) group by item_id, r
        ), placed as (
            select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank
            from scored join held using (r) where score > 0
        )
        select item_id, cast(rank as integer) as rank, doc_id, score from placed where rank <= 10
    """,
    "op3_top_k": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
            where vec_id is not null and embedding is not null
        ), scored as (
            select q.vec_id as query_id, c.vec_id,
                   cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) as score
            from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
        ), placed as (
            select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
        )
        select query_id, cast(rank as integer) as rank, vec_id, score from placed where rank <= 5
    """,
}
