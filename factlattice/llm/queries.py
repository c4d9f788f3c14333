"""The queries of the text operators: each over its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embeddings, mixing, pii, quality, secrets, simhash, substrings, tokens, toxicity

#: Folder of the public vocabularies; a parameter, never copied.
TOKENIZERS = os.environ.get("LATTICE_TOKENIZERS", "/opt/tokenizers")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark, sf_dir):
    return pii.pii(_table(spark, sf_dir, "documents"))


def op2_secrets(spark, sf_dir):
    return secrets.secrets(_table(spark, sf_dir, "documents"))


def op3_mixing(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_embeddings(spark, sf_dir):
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_decontaminate(spark, sf_dir):
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_quality(spark, sf_dir):
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_simhash(spark, sf_dir):
    return simhash.simhash(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark, sf_dir):
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_substrings(spark, sf_dir):
    return substrings.substrings(_table(spark, sf_dir, "documents"))


def op10_tokens(spark, sf_dir):
    return tokens.token_counts(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


QUERIES = {f.__name__: f for f in (op1_pii, op2_secrets, op3_mixing, op4_embeddings, op5_decontaminate, op6_quality, op7_simhash, op8_toxicity, op9_substrings, op10_tokens)}

EMBEDDINGS_SQL = """
with recursive v as (select row_number() over () as rid, vec_id, label, cast(embedding as double[]) as e from embeddings),
ok as (select * from v where label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select a.rid, a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and len(a.e) = len(b.e) and a.rid <> b.rid where list_cosine_similarity(a.e, b.e) >= 0.98),
far(a, b) as (select distinct a, b from links union select far.a, links.b from far join links on links.a = far.b),
low as (select a, min(b) as b from far group by a)
select v.vec_id, coalesce(n.n, 0) as n_links, least(v.vec_id, coalesce(low.b, v.vec_id)) as component_id, v.vec_id = least(v.vec_id, coalesce(low.b, v.vec_id)) as kept
from v left join (select rid, count(*) as n from links group by rid) n on n.rid = v.rid left join low on low.a = v.vec_id
"""

_BENCH_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATE_SQL = f"""
with d as (select doc_id, {_BENCH_WORDS} as ws from documents),
i as (select item_id, {_BENCH_WORDS} as ws from benchmark),
phrases as (select distinct item_id, n, array_to_string(ws[k:k + n - 1], ' ') as phrase from (select item_id, ws, least(10, len(ws)) as n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as k from i where len(ws) > 0) x),
places as (select doc_id, k, n, array_to_string(ws[k:k + n - 1], ' ') as phrase from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as k from d, (select distinct n from phrases) l where len(ws) >= n) x),
hits as (select doc_id, k, places.n, item_id from places join phrases on phrases.n = places.n and phrases.phrase = places.phrase),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from hits) x group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from hits) x group by doc_id)
select d.doc_id, len(d.ws) as n_words, coalesce(words.n_hit, 0) as n_hit, coalesce(items.n_items, 0) as n_items, sha256(coalesce(items.items, '')) as items_sha256, coalesce(words.n_hit, 0) > 0 as contaminated
from d left join words on words.doc_id = d.doc_id left join items on items.doc_id = d.doc_id
"""

SUBSTRINGS_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
places as (select doc_id, k, md5(array_to_string(ws[k:k + 34], ' ')) as phrase from (select doc_id, ws, unnest(range(1, len(ws) - 33)) as k from d where len(ws) >= 35) x),
often as (select phrase from places group by phrase having count(*) > 1),
gone as (select distinct doc_id, p from (select doc_id, unnest(range(k, k + 35)) as p from places where phrase in (select phrase from often)) x),
words as (select doc_id, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as p from d),
kept as (select w.doc_id, count(*) as n, string_agg(w.w, ' ' order by w.p) as line from words w left join gone g on g.doc_id = w.doc_id and g.p = w.p where g.p is null group by w.doc_id)
select d.doc_id, len(d.ws) as n_words, len(d.ws) - coalesce(kept.n, 0) as n_removed, sha256(coalesce(kept.line, '')) as kept_sha256 from d left join kept on kept.doc_id = d.doc_id
"""

#: The others have no form in DuckDB: XXH64 keys and fingerprints, compression, learnt models, corpus statistics of
#: contexts, tokenizer files. Tests hold those against plain versions.
ORACLES: dict[str, str] = {"op4_embeddings": EMBEDDINGS_SQL, "op5_decontaminate": DECONTAMINATE_SQL, "op9_substrings": SUBSTRINGS_SQL}
