"""The corpus operators as queries over the driver's tables: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocation, decontam, html_extract, lang_id, lm_score, neardup, packing, pii, quality, runs, sentpiece, shard, substring
from .common import table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op9_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes, equal texts together."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard.assign(docs, keep_text=False).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the pieces of all documents and of what they decode to."""
    return sentpiece.digests(table(spark, sf_dir, "documents"))


@query
def op7_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their counts and verdicts; cutoffs are proven on labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    rows = written(quality.features(docs), "features")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    cutoffs = written(quality.thresholds(rows.join(labels, "doc_id"), "lang", key="doc_id"), "cutoffs")
    out = quality.verdicts(rows, cutoffs, "lang")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All overlaps of documents with the benchmark."""
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to repeated windows of 35 words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.removals(docs)


def held_out(modulus: int) -> Column:
    """crc32 of doc_id as text has remainder 2; a null id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 2, F.lit(False))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = lang_id.train(docs, ~held_out(4))
    rows = docs.select("doc_id", held_out(4).alias("held_out"), "text")
    return lang_id.predicted(rows, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query
def op8_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near-duplicates on two-word shingles."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=neardup.PAIRS)


@query
def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans counted, all spans listed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.found(docs, pii.fitted(docs))


@query
def op1_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the lattice and by the base, held-out ones not learned from.

    ``score`` is the lattice with an edge over each training word (the operator's ``word_score``), ``piece_score`` that of the vocabulary's pieces alone.
    """
    out = lm_score.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), held_out(7))
    return out.select(*out.columns[: out.columns.index("score")], F.col("word_score").alias("score"), "fitted_score", F.col("score").alias("piece_score"))


@query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 phrases of each language over all documents."""
    return collocation.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


@query
def op12_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2,048 ids, a row a piece."""
    out = packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all documents, every tenth (by checksum of its id) made periodic as the contract says."""
    return runs.found(table(spark, sf_dir, "documents").select("doc_id", "text"), plant=True)


ORACLE["op11_phrase_collocations"] = r"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
sentence AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM sentence GROUP BY lang),
place AS (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM sentence, (VALUES (1), (2), (3), (4)) AS s(m) WHERE len(w) >= m),
freq AS (SELECT lang, ph, count(*) AS f FROM (SELECT lang, w[i:i + m - 1] AS ph FROM place) GROUP BY lang, ph HAVING count(*) >= 30),
cand AS (SELECT * FROM freq WHERE len(ph) >= 2),
cut AS (SELECT c.lang, c.ph, c.f AS a, c.k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.f // (l.f + r.f))::BIGINT AS score
    FROM (SELECT *, unnest(generate_series(1, len(ph) - 1)) AS k FROM cand) c JOIN freq l ON l.lang = c.lang AND l.ph = c.ph[1:c.k] JOIN freq r ON r.lang = c.lang AND r.ph = c.ph[c.k + 1:len(c.ph)]),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
inside AS (SELECT lang, ph[s:s + m - 1] AS ph, max(f) AS f FROM (SELECT lang, ph, f, m, unnest(generate_series(1, len(ph) - m + 1)) AS s FROM cand, (VALUES (2), (3)) AS v(m) WHERE len(ph) > m) GROUP BY ALL),
kept AS (SELECT b.lang, array_to_string(b.ph, ' ') AS phrase, b.a, b.l, b.r, b.score FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.ph = b.ph WHERE i.f IS NULL OR 100 * i.f < 80 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, t.n, k.score FROM ranked k JOIN total t ON t.lang = k.lang WHERE k.rank <= 2000
"""
