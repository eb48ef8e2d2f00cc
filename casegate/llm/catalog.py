"""The queries of this subpackage over the benchmark tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from casegate.llm import align, ann, decontam, langid, merkle, mixing, neardup, packing, quality, tokens, toxicity, urlfilter, warc
from casegate.llm.common import fold, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


_ITEM_WORDS = r"regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS w
  FROM (SELECT doc_id, {_LOWER} AS lower_ascii FROM documents)
), items AS (
  SELECT item_id, {_ITEM_WORDS} AS w
  FROM (SELECT item_id, {_LOWER} AS lower_ascii FROM benchmark)
), phrases AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS p
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i)
  WHERE len(w) > 0
), places AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM docs, (SELECT DISTINCT n FROM phrases) AS lengths, unnest(range(1, len(w) - n + 2)) AS t(i)
), found AS (
  SELECT r, i, n, item_id FROM places JOIN phrases USING (n, p)
), words AS (
  SELECT r, count(DISTINCT i + k) AS n_hit FROM found, unnest(range(0, n)) AS t(k) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""


@query("op7_decontaminate", OP7_SQL)
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that windows of ten benchmark words hit."""
    index = decontam.build_index(table(spark, sf_dir, "documents"))
    return decontam.report(decontam.matches(index, table(spark, sf_dir, "benchmark"), window=10))


@query("op9_mix")
def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op10_nearest")
def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every vector whose id is divisible by 100."""
    return ann.Index(table(spark, sf_dir, "embeddings"), k=10).search(F.col("vec_id") % 100 == 0)


OP1_SQL = """
WITH sized AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), tops AS (
  SELECT hex, payload_bytes, max(page_id) AS top FROM sized GROUP BY ALL
), coded AS (
  SELECT page_id, payload_bytes, top, array_to_string([substr(
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31)::INT, 1)
    FOR i IN range(0, 32)], '') AS payload_digest
  FROM sized JOIN tops USING (hex, payload_bytes)
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN top IS NULL OR page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top IS NULL OR page_id IS NOT DISTINCT FROM top THEN NULL ELSE top END AS refers_to
FROM coded
"""


@query("op1_warc", OP1_SQL)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC records, written and read back along the chain of lengths."""
    read = warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# The captures' days and the lists' entries are bound to the pages: a capture's day
# comes from its page_id, and domains that occur are listed and cleared on days that
# come from the digits of their MD5.
OP6_SQL = r"""
WITH captures AS (
  SELECT page_id, url, (DATE '2023-01-01' + ((page_id * 37) % 730)::INT)::DATE AS fetched,
         nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', ''), '') AS host
  FROM pages
), keys AS (
  SELECT DISTINCT host, fetched, array_to_string(string_split(host, '.')[i:], '.') AS domain
  FROM captures, unnest(range(1, len(string_split(host, '.')) + 1)) AS t(i)
), drawn AS (
  SELECT domain, ('0x' || substr(md5(domain), 1, 10))::BIGINT AS n FROM (SELECT DISTINCT domain FROM keys)
), entries AS (
  SELECT domain, (DATE '2023-01-01' + ((n // (97 * k)) % 730)::INT)::DATE AS day, bool_or((n // (7 * k)) % 2 = 1) AS listed
  FROM drawn, unnest(range(1, 5)) AS t(k) WHERE n % 3 > 0 GROUP BY ALL
), valid AS (
  SELECT domain, listed, day AS valid_from, lead(day) OVER (PARTITION BY domain ORDER BY day) AS valid_to FROM entries
), best AS (
  SELECT host, fetched, arg_max(valid, length(domain)) AS e
  FROM keys JOIN valid USING (domain) WHERE valid_from <= fetched AND (valid_to IS NULL OR fetched < valid_to) GROUP BY ALL
)
SELECT page_id, host, fetched,
       CASE WHEN host IS NULL OR fetched IS NULL THEN 'invalid' WHEN e.listed THEN 'blocked'
            WHEN NOT e.listed THEN 'allowed' ELSE 'unlisted' END AS verdict,
       e.domain AS "domain", e.valid_from AS valid_from, e.valid_to AS valid_to
FROM captures LEFT JOIN best USING (host, fetched)
"""


@query("op6_url_filter", OP6_SQL)
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the list entries valid on the day it was fetched."""
    start = F.lit("2023-01-01").cast("date")
    captures = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.date_add(start, (F.col("page_id") * 37 % 730).cast("int")).alias("fetched")
    )
    listed = captures.select(F.explode(urlfilter.domains(urlfilter.host(F.col("url")))).alias("domain")).distinct()
    drawn = F.conv(F.substring(F.md5("domain"), 1, 10), 16, 10).cast("bigint")
    entries = (
        listed.select("domain", drawn.alias("n"), F.explode(F.array(*[F.lit(k) for k in range(1, 5)])).alias("k"))
        .where("n % 3 > 0")
        .select("domain", F.expr("date_add(date'2023-01-01', cast((n div (97 * k)) % 730 as int))").alias("day"), F.expr("(n div (7 * k)) % 2 = 1").alias("listed"))
    )
    return urlfilter.judge(captures, entries).drop("url")


@query("op3_language")
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    learned = langid.fit(docs.where(fold(F.col("doc_id")) != 0))
    return langid.predict(docs, learned).withColumn("held_out", fold(F.col("doc_id")) == 0)


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the documents that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learned = fold(F.col("doc_id")) != 0
    models = toxicity.fit(docs.where(learned), labels.where(learned))
    return toxicity.score(docs, models).withColumn("held_out", ~learned)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The public vocabulary that the queries encode with."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op8_tokens")
def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token ids, written to compressed shards and read back."""
    read = tokens.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op5_jaccard_join")
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near copies, copies and links of 0.8 or more over five-word shingles."""
    return neardup.join(table(spark, sf_dir, "documents")).drop("row_hash", "class_key")


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under a model of trusted text, and whether it is kept."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row_hash")


@query("op11_align")
def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two vocabularies cover each document, and how usual their links are."""
    found = align.align(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op12_pack")
def op12_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in sequences of 2048 tokens, written and read back by piece."""
    return packing.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1, size=2048)


# Reads the CRC of ids byte by byte; the table of the polynomial comes first.
OP13_SQL = r"""
WITH RECURSIVE crc(byte, code) AS (
  SELECT b, list_reduce([b::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)
  FROM range(256) AS t(b)
), codes AS MATERIALIZED (SELECT list(code ORDER BY byte) AS t FROM crc
), named AS (
  SELECT row_number() OVER () AS r, *, doc_id::VARCHAR AS d FROM documents
), drawn AS (
  SELECT r, doc_id, coalesce('s' || source, 'n') AS tree,
         [d, source, lang, n_chars::VARCHAR] AS columns, text,
         CASE WHEN xor(list_reduce(list_concat([4294967295::UBIGINT], [ord(x)::UBIGINT FOR x IN string_split(d, '')]),
                lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)::INT])), 4294967295::UBIGINT) % 2 = 0
              THEN replace(text, chr(10), '') ELSE text END AS found
  FROM named, codes
), leaves AS MATERIALIZED (
  SELECT r, doc_id, tree,
         sha256(array_to_string([coalesce(strlen(x) || ':' || x, '-') FOR x IN list_append(columns, text)], '')) AS leaf,
         sha256(array_to_string([coalesce(strlen(x) || ':' || x, '-') FOR x IN list_append(columns, found)], '')) AS found
  FROM drawn
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), nodes(tree, level, idx, h, n) AS (
  SELECT tree, 0, pos, leaf, n FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 3, n
), subs AS MATERIALIZED (
  SELECT tree, level AS top, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops(level, idx, h, n) AS (
  SELECT 0, pos, subroot, n FROM subs
  UNION ALL
  SELECT level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, idx // 3, n
), all_nodes AS (
  SELECT tree, level, idx, h FROM nodes WHERE n > 1
  UNION ALL
  SELECT NULL, level, idx, h FROM tops WHERE n > 1
), kin AS MATERIALIZED (
  SELECT a.tree, a.level, a.idx,
         coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before,
         coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
  FROM all_nodes a JOIN all_nodes b ON a.tree IS NOT DISTINCT FROM b.tree AND a.level = b.level AND a.idx // 3 = b.idx // 3
  GROUP BY ALL
), climbs(r, tree, level, idx, proof, folded) AS (
  SELECT r, tree, 0, pos, '', found FROM placed
  UNION ALL
  SELECT r, k.tree, k.level + 1, k.idx // 3, proof || before || after, sha256(before || folded || after)
  FROM climbs c JOIN kin k ON c.tree = k.tree AND c.level = k.level AND c.idx = k.idx
), under AS MATERIALIZED (
  SELECT r, proof, folded, s.subroot, s.pos FROM climbs c JOIN subs s ON c.tree = s.tree AND c.level = s.top
), rises(r, level, idx, proof, folded) AS (
  SELECT r, 0, pos, proof, folded FROM under
  UNION ALL
  SELECT r, k.level + 1, k.idx // 3, proof || before || after, sha256(before || folded || after)
  FROM rises c JOIN kin k ON k.tree IS NULL AND c.level = k.level AND c.idx = k.idx
), root AS (
  SELECT level, h AS root FROM tops WHERE n = 1
)
SELECT doc_id, leaf, subroot, root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = root AS verified
FROM placed JOIN under USING (r) JOIN rises c USING (r) JOIN root USING (level)
"""


@query("op13_merkle", OP13_SQL)
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document, and which of them still hold when texts lost their line ends."""
    lost = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    found = F.when(lost, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf_dir, "documents"), found)
