"""The operators as catalogue queries ``op<N>_<name>`` over whole tables, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (decontaminate, exact_dedup, licenses, line_dedup, merkle, mixing, pieces, quality, simhash,
                          substring_dedup, toxicity, url_filter, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Target weights of the mixing query: language and labelled quality.
TARGETS = {"en/1": 0.45, "de/1": 0.18, "fr/1": 0.18, "es/1": 0.14, "en/0": 0.02, "de/0": 0.01, "fr/0": 0.01, "es/0": 0.01}


def _query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int):
    """crc32 of the id as text, modulo ``n``; null ids are never held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def _held_out(n: int, fold: int):
    return F.coalesce(_remainder(n) == fold, F.lit(False))


def toxic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label) of the rows to learn toxicity from."""
    return (table(spark, sf_dir, "labels").where(_remainder(5) != 0)
            .select("doc_id", F.col("toxic").alias("label")))


@_query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = toxicity.score_toxicity(table(spark, sf_dir, "documents"), toxic_labels(spark, sf_dir))
    return s.select("doc_id", _held_out(5, 0).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours")


@_query("op2_decontaminate", sql=r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
         lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
         lambda w: w <> '') FROM benchmark WHERE item_id IS NOT NULL
), shingles AS (
  SELECT DISTINCT side, id, unnest(CASE WHEN len(w) > 5
         THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS s FROM words
), sizes AS (SELECT id AS item_id, count(*) AS n FROM shingles WHERE side = 'i' GROUP BY id),
shared AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared
  FROM shingles d JOIN shingles i USING (s) WHERE d.side = 'd' AND i.side = 'i' GROUP BY ALL
)
SELECT doc_id, item_id, n_shared, n AS n_shingles, round(n_shared / n, 6) AS containment
FROM shared JOIN sizes USING (item_id) WHERE n_shared >= 0.8 * n - 1e-9
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_shingles", F.round("containment", 6).alias("containment"))


@_query("op3_licenses")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


@_query("op4_exact_dedup", sql=r"""
WITH rows AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM rows WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id)
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@_query("op5_url_filter")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


@_query("op6_substring_dedup", sql=r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words)
), copies AS (
  SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS low FROM windows) WHERE low < doc_id
), gone AS (SELECT doc_id, list_sort(list_distinct(flatten(list(range(i, i + 50))))) AS p FROM copies GROUP BY doc_id),
marked AS (
  SELECT words.doc_id, w, coalesce(p, []) AS p FROM words LEFT JOIN gone USING (doc_id)
), places AS (
  SELECT doc_id, len(w) AS n_words, len(p) AS n_removed, w,
         list_filter(range(1, len(w) + 1), lambda i: i NOT IN p) AS keep FROM marked WHERE len(p) > 0
  UNION ALL SELECT doc_id, len(w), 0, w, range(1, len(w) + 1) FROM marked WHERE len(p) = 0
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(list_select(w, keep), ' ')) AS kept_sha256 FROM places
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@_query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents")).drop("row_key")


def domain_labels(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """(doc_id, domain) of labelled documents: language and quality label."""
    return (table(spark, sf_dir, "labels").where("quality is not null").join(docs.select("doc_id", "lang"), "doc_id")
            .select("doc_id", F.concat_ws("/", "lang", F.col("quality").cast("string")).alias("domain")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, domain_labels(spark, sf_dir, docs), TARGETS).drop("row_key")


@_query("op8_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, table(spark, sf_dir, "documents"), sf_dir)


@_query("op9_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = (table(spark, sf_dir, "labels").where(_remainder(4) != 2)
              .select("doc_id", F.col("quality").alias("label")))
    s = quality.score_quality(table(spark, sf_dir, "documents"), labels)
    return s.select("doc_id", _held_out(4, 2).alias("held_out"), "score",
                    (F.col("score") >= 0.7).cast("int").alias("predicted"))


@_query("op10_line_dedup", sql=r"""
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM texts),
sums AS (SELECT doc_id, i, past, past - length(line) AS before FROM (
  SELECT *, sum(length(line)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS past FROM lines)),
-- from each line the shortest run of 50 characters or more forwards, and backwards
forwards AS (SELECT s.doc_id, s.i, e.i AS j FROM (SELECT *, before + 50 AS want FROM sums) s
  ASOF JOIN (SELECT doc_id, past, min(i) AS i FROM sums GROUP BY ALL) e ON s.doc_id = e.doc_id AND s.want <= e.past),
backwards AS (SELECT s.doc_id, e.i, s.i AS j FROM (SELECT *, past - 50 AS want FROM sums) s
  ASOF JOIN (SELECT doc_id, before, max(i) AS i FROM sums GROUP BY ALL) e ON s.doc_id = e.doc_id AND s.want >= e.before),
runs AS (SELECT doc_id, i, j, l[i:j] AS run FROM (FROM forwards UNION FROM backwards) JOIN texts USING (doc_id)),
copies AS (SELECT doc_id, i, j FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS n FROM runs) WHERE n > 1),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, j + 1)))) AS p FROM copies GROUP BY doc_id),
marked AS (SELECT texts.doc_id, l, coalesce(p, []) AS p FROM texts LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(l) AS n_lines, len(p) AS n_removed,
       sha256(coalesce(array_to_string(list_select(l, list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(p, i))), chr(10)), ''))
         AS kept_sha256
FROM marked
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.remove_copied_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text: bit by bit over its bytes (reflected polynomial 0xEDB88320)."""
    eight = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384::BIGINT * (x & 1)))"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), "
            f"lambda ch: ascii(ch)::BIGINT)), lambda c, b: {eight}), 4294967295::BIGINT)")


def _tree_sql(name: str, start: str, levels: int) -> str:
    """CTEs of a hash tree of fan-out 16 over ``start`` (tree, p, h, n): node levels ``name``0.. and runs ``name``r0.."""
    out = [f"{name}0 AS MATERIALIZED (SELECT tree, p, h, n FROM {start})"]
    for k in range(levels):
        out.append(f"{name}r{k} AS MATERIALIZED (SELECT tree, p // 16 AS q, list(h ORDER BY p) AS run FROM {name}{k} WHERE n > 1 GROUP BY ALL)")
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT tree, q AS p, sha256(array_to_string(run, '')) AS h, "
                   f"count(*) OVER (PARTITION BY tree) AS n FROM {name}r{k} UNION ALL SELECT tree, p, h, n FROM {name}{k} WHERE n = 1)")
    return ",\n".join(out)


def _climb_sql(name: str, start: str, levels: int, keep: str) -> str:
    """CTEs that follow rows (tree, p, proof, folded, keep...) of ``start`` up to the root: last one ``name``c<levels>."""
    out, last = [], start
    for k in range(levels):
        at = f"(c.p // {16 ** k}) % 16"
        out.append(f"""{name}c{k + 1} AS MATERIALIZED (SELECT c.tree, c.p, {keep},
  c.proof || coalesce(array_to_string(r.run[:{at}] || r.run[{at} + 2:], ''), '') AS proof,
  CASE WHEN r.run IS NULL THEN c.folded ELSE sha256(array_to_string(r.run[:{at}] || [c.folded] || r.run[{at} + 2:], '')) END AS folded
  FROM {last} c LEFT JOIN {name}r{k} r ON r.tree = c.tree AND r.q = c.p // {16 ** (k + 1)})""")
        last = f"{name}c{k + 1}"
    return ",\n".join(out)


def _leaf_sql(text: str) -> str:
    own = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({c})) || ':' || {c}, '-')" for c in own) + ")"


#: Levels that the statement spells out: 16^8 documents per source, 16^5 sources.
_DEEP, _WIDE = 8, 5


@_query("op11_merkle_manifest", sql=f"""
WITH digests AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf_sql('text')} AS h,
         CASE WHEN {_crc32_sql('doc_id::VARCHAR')} % 5 = 0
              THEN {_leaf_sql(f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')")} END AS other
  FROM documents
), numbered AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS p, count(*) OVER (PARTITION BY tree) AS n
  FROM digests
), {_tree_sql('s', 'numbered', _DEEP)},
subroots AS MATERIALIZED (
  SELECT '' AS tree, tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS p, count(*) OVER () AS n FROM s{_DEEP}
), {_tree_sql('t', 'subroots', _WIDE)},
start AS (SELECT tree, p, doc_id, h AS leaf, '' AS proof, coalesce(other, h) AS folded FROM numbered),
{_climb_sql('s', 'start', _DEEP, 'c.doc_id, c.leaf')},
upper AS (
  SELECT b.tree, b.p, b.h AS subroot, c.doc_id, c.leaf, c.proof, c.folded
  FROM sc{_DEEP} c JOIN subroots b ON b.name = c.tree
), {_climb_sql('t', 'upper', _WIDE, 'c.doc_id, c.leaf, c.subroot')}
SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.h AS verified
FROM tc{_WIDE} c, t{_WIDE} t
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_proofs(table(spark, sf_dir, "documents"))


@_query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@_query("op13_sentencepiece")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    rows = pieces.encode_texts(table(spark, sf_dir, "documents"), model)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def load() -> None:
    """Also register the pipeline, which lies at the top of the repository."""
    import corpus_pipeline

    QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
