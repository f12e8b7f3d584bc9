"""The subpackage's registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm import bpe, conversations, decontaminate, lattice, licenses, mixing, neighbours, pii, quality, simhash, spelling, substrings, urls

# Fixed values of the queries.
TOKENIZER = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
PII_KEY = "key of the registered query"  # a real run passes a secret of its own
URL_RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY, count="n_entities")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), TOKENIZER, public_tokenizers.PATTERN)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op5_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(_table(spark, sf_dir, "documents"), PIECES)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"), keep_text=False)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents")).drop("copies")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return conversations.repair_report(rows, conversations.damage(rows))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(_table(spark, sf_dir, "documents"), slip=spelling.SLIP)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_pii": op2_pii,
    "op3_bpe": op3_bpe,
    "op4_url_filter": op4_url_filter,
    "op5_lattice": op5_lattice,
    "op6_licenses": op6_licenses,
    "op7_substrings": op7_substrings,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality": op9_quality,
    "op10_neighbours": op10_neighbours,
    "op11_mixing": op11_mixing,
    "op12_conversations": op12_conversations,
    "op13_spelling": op13_spelling,
}

_SPACED = r"[^\x20\x09-\x0D]+"
_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWERED = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: DuckDB equivalents of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op7_substrings": f"""
with w as (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') as ws from documents),
t as (select rid, doc_id, ws, unnest(range(len(ws) - 12)) as s from w where len(ws) >= 13),
k as materialized (select rid, doc_id, s, array_to_string(ws[s + 1:s + 13], ' ') as win from t),
f as (select win, min(doc_id) as first from k group by win),
g as (select distinct rid, s + d as p from (select k.rid, k.s from k join f on f.win = k.win where k.doc_id > f.first), unnest(range(13)) u(d)),
e as (select rid, unnest(ws) as word, unnest(range(len(ws))) as p from w),
r as (select e.rid, string_agg(word, ' ' order by e.p) as kept, count(*) as n from e left join g on g.rid = e.rid and g.p = e.p where g.p is null group by e.rid)
select w.doc_id, len(ws) as n_words, len(ws) - coalesce(r.n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join r on r.rid = w.rid""",
    "op8_decontaminate": f"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all({_LOWERED.format('text')}, '{_PLAIN}') as ws from documents),
i as (select item_id, regexp_extract_all({_LOWERED.format('text')}, '{_PLAIN}') as ws from benchmark),
iw as (select item_id, ws, least(len(ws), 10) as size, unnest(range(greatest(len(ws) - 9, 1))) as s from i where len(ws) > 0),
v as materialized (select distinct item_id, size, array_to_string(ws[s + 1:s + size], ' ') as win from iw),
sizes as (select distinct size from v),
dw as (select rid, ws, size, unnest(range(len(ws) - size + 1)) as s from d, sizes where len(ws) >= size),
m as materialized (select dw.rid, dw.s, dw.size, v.item_id from dw join v on v.size = dw.size and v.win = array_to_string(dw.ws[dw.s + 1:dw.s + dw.size], ' ')),
h as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(s, s + size)) as p from m) group by rid),
n as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, cast(item_id as varchar) as item from m) group by rid)
select d.doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h on h.rid = d.rid left join n on n.rid = d.rid""",
    "op11_mixing": f"""
with d as materialized (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_SPACED}'))::bigint as size from documents),
g as (select source, sum(size)::bigint as ss from d group by source),
r as (select *, ([3, 1, 2])[1 + (row_number() over (order by source is null, source) - 1) % 3]::double as w from g),
o as (select *, row_number() over x as j, sum(ss) over x - ss as a, sum(w) over x - w as b from r window x as (order by ss / w, source is null, source rows unbounded preceding)),
c as (select o.*, (1.5::double * (select sum(ss) from r) - 2.0::double * a) / ((select sum(w) from r) - b) as lam from o),
l as (select lam from c where not (w * lam > 2.0::double * ss) order by j limit 1),
t as (select source, ss, least(w * lam, 2.0::double * ss) as target, ('0x' || substr(md5('mixing:' || coalesce(source, '')), 1, 5))::bigint as u from r, l),
e as (select *, case when ss > 0 then floor(target / ss * 1099511627776::double)::hugeint else 0::hugeint end as rate from t),
p as (select d.*, row_number() over (partition by source order by size, substr(md5(coalesce(doc_id::varchar, '')), 1, 8), coalesce(doc_id::varchar, '')) as k from d)
select doc_id, size, ss as source_size, target, size * (((k * rate + u * 1048576) // 1099511627776) - (((k - 1) * rate + u * 1048576) // 1099511627776))::bigint as taken
from p join e on e.source is not distinct from p.source""",
}
