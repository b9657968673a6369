"""One query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives, language, toxicity, tree_search
from .alignment import align_documents
from .common import crc_fold, documents
from .exact_dedup import exact_groups
from .mixing import poisson_mix
from .ngram_join import similar_components
from .packing import pack, piece_rows
from .secrets import find_secrets, joined
from .shards import shard_rows
from .simhash import simhash_components
from .tokens import count_tokens, utf8_bytes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary() -> tuple[str, str]:
    """Paths of the byte-level BPE file and of the ranks of the same vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@query
def op5_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy that the mixture holds: square-root target shares, one epoch."""
    mixed = poisson_mix(documents(spark, sf_dir), source="source", key="doc_id", seed=7)
    return mixed.select("doc_id", "source", F.col("copy"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_md5"))


ORACLES["op5_poisson_mixing"] = """
with sizes as (select source, count(*) as n from documents group by source),
rates as (select source, sqrt(n) / (select sum(sqrt(n)) from sizes) * (select sum(n) from sizes) / n as rate from sizes),
parted as (select source, rate, greatest(ceil(rate / 16.0), 1)::integer as parts from rates),
drawn as (
  select d.doc_id, d.source, d.text, p.rate / p.parts as mean, i,
    ('0x' || substr(md5('7:' || d.doc_id::varchar || ':' || i::varchar), 1, 13))::bigint / 4503599627370496.0 as u
  from documents d join parted p on d.source is not distinct from p.source, range(1, p.parts + 1) as parts(i)),
steps as (
  select m.mean, k, sum(exp(-m.mean + j * ln(m.mean) - lgamma(j + 1.0))) as c
  from (select distinct mean from drawn) m, range(0, 120) as ks(k), range(0, 120) as js(j) where j <= k group by m.mean, k),
times as (
  select doc_id, source, text, sum((select count(*) from steps s where s.mean = drawn.mean and s.c <= drawn.u)) as n
  from drawn group by doc_id, source, text)
select doc_id, source, copy::integer as copy, md5(coalesce(text, '')) as text_md5 from times, range(1, n::bigint + 1) as copies(copy)
"""


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text under the byte-level BPE vocabulary."""
    sized = documents(spark, sf_dir).select("doc_id", "text", utf8_bytes("text").alias("n_bytes"))
    counted = count_tokens(sized, *vocabulary(), carry=["doc_id", "n_bytes"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query
def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of nearly equal bytes."""
    placed = shard_rows(documents(spark, sf_dir), shards=8)
    return placed.withColumn("grown_shard", F.lit(None).cast("int"))


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document."""
    return exact_groups(documents(spark, sf_dir))


ORACLES["op10_exact_dedup"] = r"""
with texts as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
groups as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from texts group by text_sha256)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from texts join groups using (text_sha256)
"""


@query
def op1_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text: fixed patterns, and keys that pass the randomness battery."""
    found = find_secrets(documents(spark, sf_dir))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "random")).alias("spans"), F.size("random").cast("long").alias("n_random"),
    )


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from three of four folds of the labels."""
    docs, fold = documents(spark, sf_dir), crc_fold(F.col("doc_id"), 4)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold != 2, fold == 3)
    scored = toxicity.score_toxicity(docs, model, carry=["doc_id"])
    return scored.select("doc_id", (fold == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from four of five folds."""
    docs, fold = documents(spark, sf_dir), crc_fold(F.col("doc_id"), 5)
    model = language.fit(docs, fold != 0)
    found = language.identify(docs, model, carry=["doc_id"])
    return found.select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score")


@query
def op4_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingles have a similarity of 0.75 or more."""
    return similar_components(documents(spark, sf_dir))


ORACLES["op4_parity_sketch_join"] = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
  from documents),
shingles as (
  select distinct doc_id, s from (
    select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from words)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (
  select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * pairs.n >= 75 * (x.n + y.n - pairs.n)),
ways as (select a, b from links union all select b, a from links),
reach as (select a as doc_id, a as root from ways union select ways.b, reach.root from reach join ways on ways.a = reach.doc_id)
select d.doc_id, coalesce(s.n, 0) as n_shingles, coalesce(r.root, d.doc_id) as component_id
from documents d left join sizes s using (doc_id) left join (select doc_id, min(root) as root from reach group by doc_id) r using (doc_id)
"""


@query
def op2_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50, against all rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index = tree_search.TreeIndex(vectors)
    queries = vectors.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    return index.search(queries, k=5)


@query
def op3_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return piece_rows(pack(documents(spark, sf_dir), *vocabulary()))


@query
def op13_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document, and the component of documents within two bits of each other."""
    return simhash_components(documents(spark, sf_dir))


@query
def op12_identity_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of every text under the byte-level and the piece vocabulary."""
    import public_tokenizers

    return align_documents(documents(spark, sf_dir), *vocabulary(), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op11_four_russians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive, by exact scores against all rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.select("vec_id", "embedding", shifted.alias("label")), F.col("vec_id") % 100 == 0)


ORACLES["op11_four_russians"] = """
with base as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
  from base a join base b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
ranked as (
  select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::integer as rank,
    vec_id as negative_id, positive_score, score as negative_score
  from positives join scored using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select * from ranked where rank <= 10
"""
