"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from .common import ready, table
from .encoding import library_ids

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ready(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("op2_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from .byte_bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


@query("op6_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from .token_files import read_checksums, write_token_files

    path = write_token_files(table(spark, sf_dir, "documents"), partial(library_ids, P.path("word_bpe_49k.json"), None), vocabulary=49_408, end_id=1)
    return read_checksums(spark, path)


@query("op9_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), partial(library_ids, P.path("byte_bpe_50k.json"), P.PATTERN), end_id=0, capacity=2048)


#: Windows of 13 words as whole texts, so a run over a small table only.
REPEATS = r"""WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)),
firsts AS (SELECT k, min(doc_id) AS f FROM windows GROUP BY k),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (k) WHERE f < doc_id),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM words) ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (doc_id)"""


@query("op4_substring_dedup", REPEATS)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import removals

    return removals(table(spark, sf_dir, "documents"), window=13, start=7)


#: All pairs that share a run of words, so a run over a small table only.
GROUPS = r"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON x = r)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""


@query("op5_near_dedup", GROUPS)
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import groups

    return groups(table(spark, sf_dir, "documents"))


@query("op1_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality

    return quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "p_good", "kept")


@query("op3_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, severity

    docs = table(spark, sf_dir, "documents")
    return severity(docs, fit(docs, table(spark, sf_dir, "labels")))


@query("op7_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(table(spark, sf_dir, "documents"))


@query("op8_fingerprints")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import searched

    return searched(table(spark, sf_dir, "documents"))


@query("op10_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, identify

    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


@query("op11_whitening")
def whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"))


#: Every pair of an item's term and a document as a row, so a run over a small table only.
RANKED = r"""WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
docs AS (SELECT r, doc_id, len(w) AS n FROM words WHERE len(w) > 0),
whole AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM docs),
item_terms AS (SELECT DISTINCT i, item_id, unnest(w) AS t FROM (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark)),
tfs AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM words) SEMI JOIN item_terms USING (t) GROUP BY r, t),
ws AS (SELECT t, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, whole GROUP BY t),
parts AS (SELECT r, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))) AS s FROM tfs JOIN docs USING (r) JOIN ws USING (t), whole),
scores AS (SELECT i, item_id, doc_id, r, sum(s)::BIGINT AS score FROM parts JOIN item_terms USING (t) GROUP BY ALL),
ranks AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranks WHERE rank <= 10"""


@query("op12_lexical_search", RANKED)
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import ranked

    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_jaccard_join", GROUPS.replace(">= 75 *", ">= 80 *").replace(" AS component_id, doc_id = min(r) AS kept", " AS component_id"))
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_groups

    return jaccard_groups(table(spark, sf_dir, "documents"))
