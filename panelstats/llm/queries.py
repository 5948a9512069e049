"""One registered query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import byte_bpe, infill, language, licenses, merkle, mtree, packing, simhash, suffix_dedup, token_counts, token_store, toxicity, vptree
from .common import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORDS = public_tokenizers.path("word_bpe_49k.json")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tokens")
    token_store.write(_documents(spark, sf_dir), path, WORDS)
    return token_store.read(spark, path, with_ids=False)


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), WORDS)[0]


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_report(token_counts.encoded_lengths(_documents(spark, sf_dir), WORDS))


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", simhash.hexed().alias("fingerprint"), "component_id")


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = language.fit(docs.where(~language.held_out()))
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(_documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)
    return byte_bpe.digests(byte_bpe.decode(encoded, ranks, public_tokenizers.PATTERN))


@query
def op4_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op9_m_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return licenses.scan(docs, licenses.fit(docs))


@query
def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill.transform(_documents(spark, sf_dir).select("doc_id", "text"))
    digests = [F.sha2(c.cast("binary"), 256) for c in (F.col("infill"), infill.restored())]
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digests[0].alias("output_sha256"), digests[1].alias("restored_sha256"))


ORACLES["op11_infill"] = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
drawn AS (
  SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM cut),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s
  FROM formed)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


@query
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = merkle.hashed(_documents(spark, sf_dir), ["doc_id", "source", "lang", "n_chars", "text"], altered={"text": merkle.ascii_lower(F.col("text"))}, where=tampered)
    found = merkle.manifest(leaves).withColumn("folded_root", merkle.folded(F.coalesce("altered", "leaf")))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _merkle_sql(levels: int = 8) -> str:
    """The tree level by level: ``levels`` of 16 for the sources (16^8 leaves) and as many for their subroots."""
    def value(column: str, shown: str | None = None) -> str:
        return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({shown or column}::VARCHAR)::VARCHAR || ':' || ({shown or column})::VARCHAR END"

    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = f"translate(text, '{capitals}', '{capitals.lower()}')"
    fields = [value(c) for c in ("doc_id", "source", "lang", "n_chars")]
    # crc32 as a fold over each byte of the decimal id and eight shifts
    steps = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END), 4294967295::BIGINT)"
    parts = [f"""base AS (
  SELECT doc_id, source, sha256({' || '.join([*fields, value('text')])}) AS leaf, sha256({' || '.join([*fields, value('text', lowered)])}) AS lowered,
         coalesce({crc} % 5 = 0, false) AS tampered FROM documents),
placed AS (
  SELECT *, row_number() OVER () AS r, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM base),
s0 AS (SELECT g AS k, i, leaf AS h FROM placed),
w0 AS (SELECT r, doc_id, leaf, g, g AS k, i, CASE WHEN tampered THEN lowered ELSE leaf END AS f, '' AS proof FROM placed)"""]

    def climb(s: str, w: str) -> None:
        for n in range(levels):
            parts.append(f"""{s}r{n} AS MATERIALIZED (SELECT k, i // 16 AS run, list(h ORDER BY i) AS hs, count(*) OVER (PARTITION BY k) AS runs FROM {s}{n} GROUP BY k, i // 16),
{s}{n + 1} AS MATERIALIZED (SELECT k, run AS i, CASE WHEN runs = 1 AND len(hs) = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {s}r{n}),
{w}{n + 1} AS MATERIALIZED (SELECT r, doc_id, leaf, g, k, run AS i,
  CASE WHEN runs = 1 AND len(hs) = 1 THEN f ELSE sha256(array_to_string(hs[1:(i % 16)], '') || f || array_to_string(hs[(i % 16) + 2:16], '')) END AS f,
  proof || CASE WHEN runs = 1 AND len(hs) = 1 THEN '' ELSE array_to_string(hs[1:(i % 16)], '') || array_to_string(hs[(i % 16) + 2:16], '') END AS proof
  FROM {w}{n} JOIN {s}r{n} USING (k) WHERE i // 16 = run)""")

    climb("s", "w")
    parts.append(f"t0 AS (SELECT 0 AS k, k AS i, h FROM s{levels}), v0 AS (SELECT r, doc_id, leaf, g, 0 AS k, g AS i, f, proof FROM w{levels})")
    climb("t", "v")
    return f"""WITH {', '.join(parts)}
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = t.h AS verified
FROM v{levels} v JOIN s{levels} s ON s.k = v.g CROSS JOIN t{levels} t"""


ORACLES["op12_merkle"] = _merkle_sql()


@query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    found = toxicity.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")
