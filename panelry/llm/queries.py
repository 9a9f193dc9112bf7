"""The registered queries of the text operators, and SQL for those that SQL can express.

Each query applies one operator, with its production parameters, to the whole of its table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, tokenfile, toxicity
from .decontam import found_items
from .divergence import audit
from .exactdedup import exact_groups
from .lexical import Index, ranked
from .neardup import near_duplicates
from .pieces import decoded, encoded
from .htmlmain import extracted, trained_model
from .suffixdedup import repeated_bytes
from .topk import top_k
from .windowdedup import repeated_windows


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, by a model of the rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    return langid.identify(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share three quarters of their five-word shingles."""
    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files of all documents, written and read back."""
    folder = tokenfile.new_folder(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenfile.write(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, 2, folder)
    return tokenfile.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector with all others."""
    rows = _table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 100 = 0"), 10)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every text, by a model of the labels that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").where(~langid.held_out()))
    scored = toxicity.scored(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", langid.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test items that each document contains."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = found_items(docs, _table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.transform("item_ids", lambda x: x.cast("string")), ",")
    return found.select("doc_id", F.size("item_ids").cast("long").alias("n_items"), items.alias("item_ids"), (F.size("item_ids") > 0).alias("contaminated"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50-byte strings that also start in a smaller document, cut out of every text."""
    cut = repeated_bytes(_table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    return cut.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """13-word windows that also start in a smaller document, cut out of every text."""
    cut = repeated_windows(_table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    return cut.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = extracted(_table(spark, sf_dir, "pages"), trained_model())
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pieces of every text, and the text that they decode to."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = decoded(encoded(docs, path).select("doc_id", "pieces"), path)
    return out.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language lie apart, and the terms that tell them."""
    return audit(_table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents that rank highest for each benchmark item."""
    return ranked(Index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"), 50)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that are equal without white space."""
    found = exact_groups(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_near_dedup": op2_near_dedup,
    "op3_token_files": op3_token_files,
    "op4_top_k": op4_top_k,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_window_dedup": op8_window_dedup,
    "op9_main_text": op9_main_text,
    "op10_sampled_pieces": op10_sampled_pieces,
    "op11_source_divergence": op11_source_divergence,
    "op12_lexical_search": op12_lexical_search,
    "op13_exact_dedup": op13_exact_dedup,
}

SQL: dict[str, str] = {
    "op2_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id, doc_id AS r FROM words
  UNION SELECT links.y, reach.r FROM reach JOIN links ON links.x = reach.doc_id
), found AS (
  SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM found LEFT JOIN sizes USING (doc_id)
""",
    "op8_window_dedup": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13
), wins AS (
  SELECT doc_id, i, list_slice(w, i, i + 12) AS win FROM starts
), owners AS (
  SELECT win, min(doc_id) AS owner FROM wins GROUP BY win
), gone AS (
  SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS k
  FROM wins JOIN owners USING (win) WHERE owner < doc_id
), lost AS (
  SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN ks IS NULL THEN w
         ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(ks, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM words LEFT JOIN lost USING (doc_id)
""",
    "op4_top_k": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS x FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
""",
    "op6_decontamination": r"""
WITH words AS (
  SELECT 0 AS side, item_id AS id, text FROM benchmark UNION ALL SELECT 1, doc_id, text FROM documents
), split AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM words
), runs AS (
  SELECT side, id, unnest(flatten(list_transform(range(1, 6), lambda k: CASE WHEN len(w) < k THEN [] WHEN side = 1 OR k = 5 OR len(w) = k
    THEN list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' ')) ELSE [] END))) AS s FROM split
), items AS (SELECT DISTINCT id, s FROM runs WHERE side = 0),
sizes AS (SELECT id, count(*) AS n FROM items GROUP BY id),
present AS (SELECT DISTINCT id, s FROM runs WHERE side = 1 AND s IN (SELECT s FROM items)),
found AS (
  SELECT p.id AS doc_id, i.id AS item_id FROM present p JOIN items i USING (s) JOIN sizes z ON z.id = i.id
  GROUP BY p.id, i.id, z.n HAVING count(*) >= 0.75 * z.n
), lists AS (SELECT doc_id, list_sort(list(item_id)) AS ids FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(len(ids), 0)::BIGINT AS n_items, coalesce(array_to_string(ids, ','), '') AS item_ids, ids IS NOT NULL AS contaminated
FROM documents LEFT JOIN lists USING (doc_id)
""",
    # The pages' own layout says where the article is, which the operator has to find out.
    "op9_main_text": r"""
WITH found AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS a FROM pages
), bare AS (
  SELECT page_id, url, regexp_replace(regexp_replace(a, '<br>|</?p>|</?h[1-6]>', ' ', 'g'), '<[^>]*>', '', 'g') AS a FROM found
), plain AS (
  SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(a, '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM bare
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM plain
""",
    "op11_source_divergence": r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM docs) GROUP BY lang, term HAVING count(*) >= 10
), sizes AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
counts AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM (SELECT lang, source, unnest(w) AS term FROM docs) SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), sources AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM sources LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
everywhere AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY lang, term),
all_totals AS (SELECT lang, sum(n)::HUGEINT AS total FROM everywhere GROUP BY lang),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (s.total + 2 * v) AS p
  FROM totals s JOIN kept k USING (lang) JOIN sizes USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), q AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 2) // (total + 2 * v) AS q FROM everywhere JOIN all_totals USING (lang) JOIN sizes USING (lang)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), ranks AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found
)
SELECT * FROM ranks WHERE part = 'pair' OR rank <= 10
""",
    "op12_lexical_search": r"""
WITH texts AS (
  SELECT 0 AS side, item_id AS id, text FROM benchmark UNION ALL SELECT 1, doc_id, text FROM documents
), terms AS (
  SELECT side, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts
), tfs AS (SELECT id, term, count(*) AS tf FROM terms WHERE side = 1 GROUP BY id, term),
lengths AS (SELECT id, sum(tf)::BIGINT AS n FROM tfs GROUP BY id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lengths),
asked AS (SELECT DISTINCT id AS item_id, term FROM terms WHERE side = 0),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tfs, whole WHERE term IN (SELECT term FROM asked) GROUP BY term, docs
), scores AS (
  SELECT item_id, t.id AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tfs t USING (term) JOIN lengths l ON l.id = t.id, whole GROUP BY item_id, t.id
), ranks AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT * FROM ranks WHERE rank <= 50
""",
    "op13_exact_dedup": r"""
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
), found AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM bare
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM found
""",
}
