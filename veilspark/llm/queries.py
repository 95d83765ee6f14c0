"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of a text, as every contract has them.
WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.substring_dedup import removed_passages

    out = removed_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = f"""
with docs as (select doc_id, {WORDS_SQL} as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as k
        from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from docs where len(w) >= 13)),
gone as (select distinct doc_id, i + o as p
         from (select doc_id, i, min(doc_id) over (partition by k) as m from win), range(0, 13) as r(o) where m < doc_id),
cut as (select doc_id, list(p) as ps from gone group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(len(ps), 0) as n_removed,
       sha256(array_to_string(case when ps is null then w else list_filter(w, lambda x, i: not list_contains(ps, i)) end, ' ')) as kept_sha256
from docs d left join cut c using (doc_id)
"""

def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.url_filter import judged

    return judged(_table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.ngram_jaccard import grouped

    return grouped(_table(spark, sf_dir, "documents"))


OP2_SQL = f"""
with recursive docs as (select doc_id, {WORDS_SQL.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
sh as (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end as s, len(w) < 5 as short
       from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from docs where len(w) > 0)),
n as (select doc_id, count(*) as n from sh group by doc_id),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.short = b.short and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pair join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
edges as (select a, b from links union all select b, a from links),
reach as (select a as node, a as r from edges union select e.b, reach.r from reach join edges e on e.a = reach.node)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m.r, d.doc_id)) as component_id
from docs d left join n using (doc_id) left join (select node, min(r) as r from reach group by node) m on m.node = d.doc_id
"""

def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.token_counts import LIMIT, count_tokens

    out = count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


def packed(documents: DataFrame) -> DataFrame:
    from veilspark.llm.packing import pack_documents

    out = pack_documents(documents, vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm import quality

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, *quality.train(docs)).select("doc_id", "quality", "posterior", "keep")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm import toxicity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels"))).drop("text")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.embedding_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


OP7_SQL = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
ok as (select vec_id, label, e from v where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x != 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id != b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (select a as node, least(a, b) as r from links union select l.b, reach.r from reach join links l on l.a = reach.node)
select v.vec_id, (select count(*) from links l where l.a = v.vec_id) as n_links, least(v.vec_id, coalesce(m.r, v.vec_id)) as component_id, v.vec_id = least(v.vec_id, coalesce(m.r, v.vec_id)) as kept
from v left join (select node, min(r) as r from reach group by node) m on m.node = v.vec_id
"""

def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.decontamination import contaminated

    return contaminated(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


_PLAIN = "translate(lower(coalesce(text, '')), '.,;:!?\"''()[]', '')"
_SEED_WORDS = r"regexp_extract_all(" + _PLAIN + r", '[^\x20\x09-\x0D]+')"
_MASK_SQL = "[[0, 1, 2, 3, 4, 5], [0, 1, 3, 4, 7, 9], [0, 2, 3, 6, 7, 8], [0, 1, 2, 5, 8, 10]]"
OP4_SQL = f"""
with d as (select doc_id, {_SEED_WORDS} as w from documents), b as (select item_id, {_SEED_WORDS} as w from benchmark),
mask as (select unnest({_MASK_SQL}) as m, unnest(range(4)) as k),
ds as (select doc_id, p, k, array_to_string(list_transform(m, lambda o: w[p + o + 1]), ' ') as s from (select doc_id, w, unnest(range(len(w) - 10)) as p from d where len(w) >= 11), mask),
bs as (select distinct item_id, q, k, array_to_string(list_transform(m, lambda o: w[q + o + 1]), ' ') as s from (select item_id, w, unnest(range(len(w) - 10)) as q from b where len(w) >= 11), mask),
hit as (select distinct doc_id, item_id, p - q as g from ds join bs using (k, s)),
lay as (select doc_id, item_id, g, greatest(0, -g) as f, least(len(b.w), len(d.w) - g) as z, d.w as dw, b.w as bw from hit join d using (doc_id) join b using (item_id)),
eq as (select doc_id, item_id, g, least(20, z - f) as size, list_transform(range(f, z), lambda i: (dw[g + i + 1] = bw[i + 1])::int) as e from lay),
best as (select doc_id, item_id, g, size, list_max(list_transform(range(1, len(e) - size + 2), lambda i: list_sum(e[i:i + size - 1]))) as o,
 coalesce(list_max(list_transform(range(1, len(e) - 11), lambda i: list_sum(e[i:i + 12]))), 0) = 13 as run from eq),
short as (select item_id, w, len(w) as n, array_to_string(w, ' ') as s from b where len(w) between 5 and 10),
near as (select doc_id, p, n, array_to_string(w[p + 1:p + n], ' ') as s from (select doc_id, w, n, unnest(range(len(w) - n + 1)) as p from d, (select distinct n from short) where len(w) >= n))
select doc_id, item_id, max(o)::int as overlap, arg_max(g, o * 1000000 - g) as start from best where run or 100 * o >= 80 * size group by 1, 2
union all select doc_id, item_id, any_value(n)::int as overlap, min(p) as start from near join short using (n, s) group by 1, 2
"""

def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm import kneser_ney

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).alias("held_out"))
    return kneser_ney.score(docs, kneser_ney.train(docs.where("not held_out"))).drop("text")


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.fingerprint import edited, likeness

    out = edited(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.vector_codes import compressed

    return compressed(_table(spark, sf_dir, "embeddings"))


def _codebook_round(k: int) -> str:
    """The SQL of a round: distances of all parts to codebook k, and codebook k + 1."""
    return f"""
far{k} as (select p.n, p.part, entry, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as far from p join c{k} c using (part)),
near{k} as (select n, part, min(entry) as entry from (select *, min(far) over (partition by n, part) as least from far{k}) where far = least group by n, part),
sum{k} as (select part, entry, place, sum(x)::bigint as s, count(*)::bigint as c from (select a.part, a.entry, unnest(p.v) as x, unnest(range(len(p.v))) as place from near{k} a join p using (n, part)) group by all),
c{k + 1} as (select c.part, c.entry, coalesce(m.v, c.v) as v from c{k} c left join (select part, entry, list((s - ((s % c) + c) % c) // c order by place) as v from sum{k} group by part, entry) m using (part, entry)),"""


OP12_SQL = f"""
with kept as (select row_number() over (order by vec_id, embedding) as n, * from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select n, part, list_transform(embedding[part * (len(embedding) // 16) + 1 : (part + 1) * (len(embedding) // 16)], lambda x: floor(256 * x::double)::bigint) as v from kept, range(16) as r(part)),
c0 as (select part, n - 1 as entry, v from p where n <= 64),
{_codebook_round(0)}{_codebook_round(1)}
far2 as (select p.n, p.part, entry, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as far from p join c2 c using (part)),
code as (select n, string_agg(printf('%02x', entry), '' order by part) as code, sum(far)::bigint as error
         from (select n, part, min(entry) as entry, min(far) as far from (select *, min(far) over (partition by n, part) as least from far2) where far = least group by n, part) group by n)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
       (select sha256(string_agg(x::varchar, ',' order by part, entry, place)) from (select part, entry, unnest(v) as x, unnest(range(len(v))) as place from c2)) as codebooks_sha256
from kept join code using (n)
"""


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.whitening import whitened

    return whitened(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_packing": op8_packing,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity": op10_toxicity,
    "op11_document_fingerprints": op11_document_fingerprints,
    "op12_vector_codes": op12_vector_codes,
    "op13_embedding_whitening": op13_embedding_whitening,
}
SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": OP2_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op4_benchmark_decontamination": OP4_SQL,
    "op7_embedding_near_dedup": OP7_SQL,
    "op12_vector_codes": OP12_SQL,
}
