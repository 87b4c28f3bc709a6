"""The queries over the test tables, one per operator, with their SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.llm import conversations, cutting, decontaminate, langid, linededup, minhash, negatives, packing, secrets, surrogates, toxicity, vectors, warc
from ionloom.llm.common import shared_folder
from ionloom.session import tune

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(tune(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def held_out(doc_id: str = "doc_id"):
    """Rows whose crc32 of the id, as text, leaves 2 on division by 4: never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query(
    "op3_line_dedup",
    """
    WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
    lines AS (SELECT doc_id, unnest(p) AS line, unnest(range(len(p))) AS i FROM parts),
    keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
    often AS (SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
    marked AS (SELECT doc_id, i, line, holder IS NOT NULL AND holder <> doc_id AS gone FROM keyed LEFT JOIN often USING (k))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op3_line_dedup(spark, sf_dir):
    found = linededup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op8_language_id")
def op8_language_id(spark, sf_dir):
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(documents.where(~held_out()))
    found = langid.identify(documents.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


@query("op4_minhash_near_dedup")
def op4_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), words=4)


@query(
    "op7_benchmark_decontamination",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    item_at AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
    item_window AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM item_at),
    lengths AS (SELECT DISTINCT n FROM item_window),
    doc_at AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n),
    doc_window AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM doc_at),
    hit AS (SELECT doc_id, i, n, item_id FROM doc_window JOIN item_window USING (n, g)),
    hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
    hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
    """,
)
def op7_benchmark_decontamination(spark, sf_dir):
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A vocabulary file of the packing queries, read where it is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


@query(
    "op1_secret_scan",
    r"""
    WITH t AS (SELECT doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS text FROM documents),

    raw AS (
        SELECT doc_id, owner, 0 AS rank, 'assign' AS kind, 0 AS whole, 12 AS least, regexp_split_to_array(text, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS g,
            regexp_extract_all(text, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS m,
            regexp_extract_all(text, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS v FROM t
        UNION ALL SELECT doc_id, owner, 1, 'access', 18, 0, regexp_split_to_array(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+') FROM t
        UNION ALL SELECT doc_id, owner, 2, 'hex', 16, 0, regexp_split_to_array(text, '[0-9a-f]{16,}'), regexp_extract_all(text, '[0-9a-f]{16,}'), regexp_extract_all(text, '[0-9a-f]{16,}') FROM t
        UNION ALL SELECT doc_id, owner, 3, 'owned', 20, 0, regexp_split_to_array(text, '[A-Za-z0-9+/_-]{20,}'), regexp_extract_all(text, '[A-Za-z0-9+/_-]{20,}'), regexp_extract_all(text, '[A-Za-z0-9+/_-]{20,}') FROM t),
    each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM raw WHERE len(m) > 0),
    span AS (SELECT doc_id, owner, rank, kind, v[i] AS value, length(m[i]) AS size,
            CAST(list_sum([length(x) FOR x IN g[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) AS BIGINT) AS start
        FROM each WHERE length(m[i]) >= whole AND length(v[i]) >= least
            AND (rank < 3 OR (regexp_matches(v[i], '[A-Z]') AND regexp_matches(v[i], '[a-z]') AND regexp_matches(v[i], '[0-9]')))),
    own AS (SELECT value, count(DISTINCT owner) AS n_owners FROM span GROUP BY value),
    known AS (SELECT *, n_owners <= 1 AS live, kind || ':' || start || ':' || (start + size) AS w FROM span JOIN own USING (value) WHERE rank < 3 OR n_owners <= 1),
    per_doc AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
            count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied,
            string_agg(w, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(w, ',' ORDER BY start, rank) AS spans FROM known GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
    FROM t LEFT JOIN per_doc USING (doc_id)
    """,
)
def op1_secret_scan(spark, sf_dir):
    found = secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))

    def number(test):
        return F.size(F.filter("spans", test)).cast("long")

    def of(kind):
        return lambda s: s["kind"] == kind

    return found.select(
        "doc_id",
        *(number(of(kind)).alias(f"n_{kind}") for kind in secrets.BASE),
        F.sha2(secrets.written(F.filter("spans", lambda s: s["rank"] < len(secrets.BASE))), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
        number(lambda s: s["live"]).alias("n_live"),
        number(lambda s: ~s["live"]).alias("n_copied"),
    )


@query(
    "op6_warc_revisits",
    """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    first AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN first <> page_id THEN first END AS refers_to
    FROM p LEFT JOIN first USING (payload_digest)
    """,
)
def op6_warc_revisits(spark, sf_dir):
    folder = shared_folder(spark, "warc")
    warc.write_archives(read(spark, sf_dir, "pages"), folder)
    found = warc.resolved_records(warc.read_archives(spark, folder))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_embedding_near_dedup")
def op9_embedding_near_dedup(spark, sf_dir):
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


@query("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    found = toxicity.score(documents, toxicity.fit(documents, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", toxicity.decided().alias("predicted"))


# The key of the test tables' stand-ins. A user passes a secret of their own.
SURROGATE_KEY = b"test tables"


@query("op10_pii_surrogates")
def op10_pii_surrogates(spark, sf_dir):
    found = surrogates.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)
    counts = (F.coalesce(F.col("entities")[kind], F.lit(0).cast("long")).alias(f"n_{kind}") for kind in surrogates.KINDS)
    return found.select("doc_id", "text", *counts)


@query(
    "op11_conversation_repair",
    r"""
    WITH RECURSIVE
    keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ord(c) AS BIGINT)) AS bytes
        FROM conversations),
    told AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, b:
        list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS f FROM keyed),
    after AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM told, range(CASE WHEN f = 0 THEN 0 WHEN f = 3 THEN 2 ELSE 1 END)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
        rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM after),
    judged AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
        WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS i,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM placed),
    inserts AS (SELECT * FROM (VALUES (0, 0, 0, ''), (0, 1, 2, 'u'), (0, 2, 3, 'ua'), (1, 0, 1, ''), (1, 1, 2, 'u'), (1, 2, 3, 'ua'),
        (2, 0, 2, ''), (2, 1, 3, 'a'), (2, 2, 2, 'au'), (3, 0, 3, ''), (3, 1, 2, 'u'), (3, 2, 3, 'ua')) AS v(state, k, spot, made)),
    moves AS (SELECT state, k, made, spot AS next, 'D' AS op, '' AS needs, '' AS role FROM inserts
        UNION ALL SELECT state, k, made, CASE WHEN spot = 2 THEN 3 ELSE 2 END, 'R', '', CASE WHEN spot = 2 THEN 'assistant' ELSE 'user' END FROM inserts
        UNION ALL SELECT state, k, made, next, 'K', needs, '' FROM inserts JOIN (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) AS v(spot, needs, next) USING (spot)),
    path AS (
        SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, 0 AS state, {'cost': CAST(0 AS BIGINT), 'audit': '', 'made': ''} AS best FROM after
        UNION ALL
        SELECT p.conv_id, p.n + 1, m.next, min({'cost': p.best.cost + 3 * m.k + CASE m.op WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN m.op <> 'D' AND r.fault = 'truncated' THEN 3 ELSE 0 END,
            'audit': p.best.audit || repeat('I', m.k) || m.op,
            'made': p.best.made || replace(replace(m.made, 'a', chr(10) || 'assistant:'), 'u', chr(10) || 'user:') || CASE m.op WHEN 'D' THEN '' WHEN 'R' THEN chr(10) || m.role || ':' || r.text ELSE chr(10) || r.role || ':' || r.text END})
        FROM path p JOIN judged r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.n = p.n + 1
            JOIN moves m ON m.state = p.state AND (m.op = 'D' OR (r.fault NOT IN ('blank', 'duplicate') AND (m.op = 'R' OR m.needs = r.i)))
        GROUP BY p.conv_id, p.n, m.next),
    counted AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
    ended AS (SELECT p.conv_id, min({'cost': p.best.cost + 3 * length(t.made), 'audit': p.best.audit || repeat('I', length(t.made)),
            'made': p.best.made || replace(replace(t.made, 'a', chr(10) || 'assistant:'), 'u', chr(10) || 'user:')}) AS best
        FROM path p JOIN counted c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.n JOIN (VALUES (0, ''), (1, 'ua'), (2, 'a'), (3, '')) AS t(state, made) ON t.state = p.state GROUP BY p.conv_id)
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
        coalesce(e.best.cost, 0) AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(substr(e.best.made, 2), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
    """,
)
def op11_conversation_repair(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    return conversations.digests(conversations.damaged(turns), turns)


@query(
    "op12_hard_negatives",
    """
    WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    met AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
        FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
    positive AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM met WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM positive JOIN met USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
    """,
)
def op12_hard_negatives(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


@query("op13_cutting_stock_packing")
def op13_cutting_stock_packing(spark, sf_dir):
    return cutting.pack(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
