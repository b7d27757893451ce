"""The queries of this subpackage, as the driver calls them: thin wrappers that derive fixed columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import new_dir, ship

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archive, write_archive

    write_archive(table(spark, sf_dir, "pages"), folder := new_dir(spark, "warc"))
    return read_archive(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1 = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html)) as n, sha256(html) as sha from p),
g as (select *, min(page_id) over (partition by sha) as first_id, row_number() over (partition by sha order by page_id nulls last) as nth from d)
select page_id, n as payload_bytes, sha as payload_digest,
  case when n < 100 or nth = 1 then 'response' else 'revisit' end as record_type,
  case when n < 100 or nth = 1 then null else first_id end as refers_to
from g"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import token_counts

    return token_counts(table(spark, sf_dir, "documents"), WORD_BPE)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import KINDS, find_secrets, fit

    documents = table(spark, sf_dir, "documents")
    found = find_secrets(documents, fit(documents))
    mark = F.transform("findings", lambda f: F.struct(f["kind"].alias("kind"), F.concat_ws(":", f["kind"], f["start"], f["end"]).alias("mark")))
    base = F.filter(mark, lambda f: f["kind"] != KINDS[3])
    kinds = F.transform("findings", lambda f: f["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, lambda f: f["mark"]), ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform(mark, lambda f: f["mark"]), ",").alias("spans"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


OP5 = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
g as (select distinct doc_id, array_to_string(w[pos:pos + 4], ' ') as gram from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as pos from d where len(w) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from g a join g b using (gram) where a.doc_id <> b.doc_id group by 1, 2),
links as (select x, y, c = a.n and c = b.n as same from pairs join n a on x = a.doc_id join n b on y = b.doc_id where 9 * c >= 4 * (a.n + b.n)),
reach(x, y) as (select x, y from links union select r.x, l.y from reach r join links l on r.y = l.x),
least_of as (select x, min(y) as y from reach group by x),
counts as (select x, count(*) as n_links, min(y) filter (where same) as y from links group by x)
select doc_id, least(doc_id, c.y) as class_id, coalesce(n_links, 0)::bigint as n_links, least(doc_id, l.y) as group_id
from d left join counts c on c.x = doc_id left join least_of l on l.x = doc_id"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import languages

    return languages(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import best_fit_pack

    packed = best_fit_pack(table(spark, sf_dir, "documents"), WORD_BPE, 4096, 1)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import decontaminate, hit_words

    judged = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = hit_words(F.col("hits"))
    return judged.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


OP9 = r"""
with d as (select doc_id, row_number() over () as row_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select item_id, unnest(case when len(w) >= 13 then list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' ')) else [array_to_string(w, ' ')] end) as win, least(len(w), 13) as n from b where len(w) > 0),
sizes as (select distinct n from bw),
dw as (select row_id, n, unnest(range(1, len(w) - n + 2)) as pos, w from d, sizes where len(w) >= n),
hit as (select dw.row_id, dw.pos, dw.n, bw.item_id from (select row_id, n, pos, array_to_string(w[pos:pos + n - 1], ' ') as win from dw) dw join bw on dw.win = bw.win and dw.n = bw.n),
places as (select row_id, count(distinct p) as n_hit from (select row_id, unnest(range(pos, pos + n)) as p from hit) group by row_id),
found as (select row_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hit group by row_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join places using (row_id) left join found using (row_id)"""


def op10_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearest import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def secret_scan_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the secret scan that SQL can say: everything but what the network adds."""
    return op4_secret_scan(spark, sf_dir).drop("spans")


def _matches(kind: str, rank: int, pattern: str, least: str) -> str:
    """Matches of a pattern with their places: the pieces between them and those before them are as long as what precedes."""
    return f"""select r, '{kind}' as kind, {rank} as rank, length(ms[i]) as size, (list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::bigint as start
from (select r, ms, ps, gs, unnest(range(1, len(ms) + 1)) as i from (select r, regexp_extract_all(t, '{pattern}') as ms, string_split_regex(t, '{pattern}') as ps, regexp_extract_all(t, '{pattern}', {2 if kind == "assign" else 0}) as gs from d)) where {least}"""


# The patterns of the base findings, with either case of the letters written out.
_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
SECRET_SCAN_BASE = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
m as ({_matches("assign", 0, _ASSIGN, "length(gs[i]) >= 6")} union all {_matches("access", 1, "AKIA[A-Z0-9]{16,}", "true")} union all {_matches("hex", 2, "[0-9a-f]{24,}", "true")}),
g as (select r, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex, string_agg(kind || ':' || start || ':' || (start + size), ',' order by start, rank) as marks from m group by r)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(marks, '')) as base_sha256 from d left join g using (r)"""


def packing_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of every packing: all documents are there, pieces follow one another, and sequences have no gap and no excess."""
    packed = op7_best_fit_packing(spark, sf_dir)
    last = F.max("piece") + 1
    by_doc = packed.groupBy("doc_id").agg(((last == F.count("*")) & (F.max(F.col("start") + F.col("length")) == F.sum("length")) & (F.min("length") > 0)).alias("whole")).agg(F.count("*").alias("documents"), F.count(F.when(~F.col("whole"), 1)).alias("broken"))
    by_sequence = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.min("offset").alias("begin"), F.count_distinct("offset").alias("places"), F.count("*").alias("pieces"))
    bad = by_sequence.agg(F.count(F.when(F.col("n") > 4096, 1)).alias("overfull"), F.count(F.when((F.col("n") != F.col("end")) | (F.col("begin") != 0) | (F.col("places") != F.col("pieces")), 1)).alias("gaps"))
    return by_doc.crossJoin(bad)  # one row each


PACKING_CHECKED = "select count(distinct doc_id) as documents, 0::bigint as broken, 0::bigint as overfull, 0::bigint as gaps from documents"

#: All other rows of each query by cosine; windows of at least 512 ranks on either side hold the whole of a small table.
OP10 = """
with v as (select vec_id, embedding::double[] as e from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select q.vec_id as query_id, c.vec_id, list_cosine_similarity(q.e, c.e) as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5"""

QUERIES = {f.__name__: f for f in (op1_warc, op2_toxicity, op3_token_counts, op4_secret_scan, op5_ngram_jaccard_join, op6_language_id, op7_best_fit_packing, op8_quality_classifier, op9_benchmark_decontamination, op10_hilbert_neighbours, secret_scan_base, packing_checked)}
ORACLES: dict[str, str] = {"op1_warc": OP1, "op5_ngram_jaccard_join": OP5, "op9_benchmark_decontamination": OP9, "op10_hilbert_neighbours": OP10, "secret_scan_base": SECRET_SCAN_BASE, "packing_checked": PACKING_CHECKED}
