"""The registered queries of this subpackage, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm import (
    bagminhash,
    blockknn,
    linebloom,
    ordersketch,
    packing,
    pii,
    planes,
    secretlinks,
    spelling,
    toxicity,
    turns,
    urltree,
    winnow,
)
from txrisk.llm.common import new_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    """Where the public tokenizer package keeps a file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "planes")
    docs = _table(spark, sf_dir, "documents")
    planes.write_ids(docs, folder, _vocabulary("byte_bpe_50k.json"), end_id=0)
    return planes.digests(spark, folder)


def op2_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op3_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_copies(_table(spark, sf_dir, "documents"))


def op4_order_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=1)


def op5_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op6_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretlinks.find(_table(spark, sf_dir, "documents"))


def op7_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return blockknn.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


def op8_line_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linebloom.summary(_table(spark, sf_dir, "documents"))


#: Fixed values of the contract: host, path, verdict.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op9_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judged(_table(spark, sf_dir, "pages"), urltree.rules_table(spark, RULES))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_spelling_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.misspelt(spelling.runs(_table(spark, sf_dir, "documents")))
    return spelling.variants(spelling.counted(words, least_length=7, least=2), factor=10)


def op12_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordersketch.fingerprints(_table(spark, sf_dir, "documents"))


def op13_hirschberg_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return turns.report(conversations, turns.damaged(conversations))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bit_planes": op1_bit_planes,
    "op2_ordinal_toxicity": op2_ordinal_toxicity,
    "op3_bag_minhash": op3_bag_minhash,
    "op4_order_packing": op4_order_packing,
    "op5_weak_labels": op5_weak_labels,
    "op6_linked_secrets": op6_linked_secrets,
    "op7_block_join": op7_block_join,
    "op8_line_bloom": op8_line_bloom,
    "op9_template_tree": op9_template_tree,
    "op10_winnowing": op10_winnowing,
    "op11_spelling_tiles": op11_spelling_tiles,
    "op12_order_minhash": op12_order_minhash,
    "op13_hirschberg_repair": op13_hirschberg_repair,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op9_template_tree": urltree.sql(RULES),
    "op11_spelling_tiles": spelling.SQL,
    "op13_hirschberg_repair": turns.sql(),
    "op7_block_join": """
with v as (
  select vec_id, cast(embedding as double[]) e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (
  select q.vec_id query_id, v.vec_id,
    list_reduce(list_prepend(0.0::double, list_transform(list_zip(q.e, v.e), lambda x: x[1] * x[2])), lambda a, b: a + b) score
  from v q join v on q.vec_id % 20 = 0 and q.vec_id <> v.vec_id and len(q.e) = len(v.e)),
ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) r from pairs)
select query_id, cast(r as integer) rank, vec_id, score from ranked where r <= 20
""",
    "op8_line_bloom": r"""
with lines as (
  select doc_id, r, i, line,
    translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k
  from (select doc_id, r, unnest(l) line, generate_subscripts(l, 1) i
    from (select doc_id, row_number() over () r, string_split(coalesce(text, ''), chr(10)) l from documents))),
bad as (
  select k, max(doc_id) keeper from lines where length(k) >= 20 group by k having count(distinct r) >= 3),
marked as (
  select doc_id, r, i, line, keeper is not null and doc_id is distinct from keeper gone
  from lines left join bad using (k))
select doc_id, count(*) n_lines, count(*) filter (where gone) n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) kept_sha256
from marked group by doc_id, r
""",
    "op10_winnowing": f"""
with items as (
  select cast(item_id as varchar) item_id, {_WORDS.format("coalesce(text, '')")} w from benchmark),
wins as (
  select distinct item_id, least(len(w), 13) size,
    array_to_string(w[p:p + least(len(w), 13) - 1], ' ') win
  from (select *, unnest(range(1, len(w) - least(len(w), 13) + 2)) p from items where len(w) > 0)),
docs as (
  select doc_id, row_number() over () r, {_WORDS.format("coalesce(text, '')")} w from documents),
places as (
  select r, size, p, array_to_string(w[p:p + size - 1], ' ') win
  from (select r, w, size, unnest(range(1, cast(len(w) as bigint) - size + 2)) p
    from docs, (select distinct size from wins))),
hits as (
  select r, size, p, item_id from places join wins using (size, win)),
words as (
  select r, count(distinct q) n_hit
  from (select r, unnest(range(p, p + size)) q from hits) group by r),
named as (
  select r, count(*) n_items, string_agg(item_id, ',' order by item_id) items
  from (select distinct r, item_id from hits) group by r)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  sha256(coalesce(items, '')) items_sha256,
  coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) contaminated
from docs left join words using (r) left join named using (r)
""",
}
