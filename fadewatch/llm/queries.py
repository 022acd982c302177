"""One query for each operator, bound to the driver's tables, and the SQL that checks it where SQL can."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, conversation_repair, decontaminate, extendible_shards, hard_negatives, line_dedup, line_quality, neighbour_graph, ngram_join, suffix_dedup, surrogates, token_counts, url_filter
from .staging import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------- 1: personal data

#: Stands for a secret that a user of the library keeps; the query needs a fixed one.
SURROGATE_KEY = b"a key for the queries of this repository"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for the personal data in it."""
    return surrogates.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)


# ------------------------------------------------------------- 2: decontamination


def op2_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and the best window."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# ------------------------------------------------------------- 3: byte-level BPE


def byte_bpe_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole document."""
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), *byte_bpe_files())


# ------------------------------------------------------------- 4: token counts

END_OF_DOCUMENT = 50256


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as flat token files in the shared folder and count the tokens of each from these files."""
    return token_counts.count_documents(table(spark, sf_dir, "documents"), shared_folder(spark), *byte_bpe_files(), END_OF_DOCUMENT)


# ------------------------------------------------------------- 5: shards

SHARD_BYTES = 1 << 20


def op5_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, at most SHARD_BYTES of text each."""
    return extendible_shards.assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES, F.octet_length("text"), ["doc_id", "text"]).drop("text")


SHARD_SQL = f"""WITH rows AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes,
    CAST('0x' || substr(md5(concat_ws(':', md5(CAST(doc_id AS VARCHAR)), md5(text))), 1, 15) AS BIGINT) AS bits FROM documents),
sizes AS (
  SELECT depth, bits >> (60 - depth) AS bucket, sum(bytes) AS bytes, count(*) AS n FROM rows, range(0, 61) d(depth) GROUP BY ALL)
SELECT doc_id, any_value(r.bytes) AS bytes, CAST(min(depth) AS INTEGER) AS depth,
  CASE WHEN min(depth) = 0 THEN '' ELSE lpad(bin(any_value(bits) >> (60 - min(depth))), CAST(min(depth) AS INTEGER), '0') END AS shard
FROM rows r JOIN sizes s ON s.bucket = r.bits >> (60 - s.depth) WHERE s.bytes <= {SHARD_BYTES} OR s.n = 1 GROUP BY doc_id"""

# ------------------------------------------------------------- 6: lines


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that equal or nearly equal an earlier line of the corpus."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


LINE_SQL = f"""WITH lines AS (
  SELECT doc_id, u.k - 1 AS line_no, u.line, regexp_split_to_array(trim(u.line, e' \\t\\r\\x0b\\f'), '[ \\t\\r\\x0b\\f]+') AS words
  FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k) u),
firsts AS (
  SELECT line, min((doc_id, line_no)) AS place, any_value(words) AS words, len(any_value(words)) AS n
  FROM lines WHERE regexp_matches(line, '[^ \\t\\r\\x0b\\f]') GROUP BY line),
long AS (SELECT * FROM firsts WHERE n >= {line_dedup.MIN_WORDS}),
halves AS (
  SELECT DISTINCT place, n, words, h, side, CASE side WHEN 0 THEN words[1:h] ELSE words[n - h + 1:n] END AS half
  FROM long, LATERAL (SELECT unnest([(n - 1) // 2, n // 2]) AS h) a, (VALUES (0), (1)) s(side)),
pairs AS (
  SELECT DISTINCT b.place, a.words AS x, b.words AS y, a.n, b.n AS m FROM halves a JOIN halves b
    ON a.h = b.h AND a.side = b.side AND a.half = b.half AND a.place < b.place AND abs(a.n - b.n) <= 1),
near AS (
  SELECT DISTINCT place FROM pairs WHERE CASE
    WHEN n = m THEN len(list_filter(range(1, n + 1), lambda i: x[i] != y[i])) <= 1
    WHEN n > m THEN len(list_filter(range(1, n + 1), lambda i: list_concat(x[1:i - 1], x[i + 1:n]) = y)) > 0
    ELSE len(list_filter(range(1, m + 1), lambda i: list_concat(y[1:i - 1], y[i + 1:m]) = x)) > 0 END),
kept AS (
  SELECT l.doc_id, l.line_no, l.line FROM lines l LEFT JOIN firsts f ON f.place = (l.doc_id, l.line_no)
  WHERE NOT regexp_matches(l.line, '[^ \\t\\r\\x0b\\f]') OR (f.place IS NOT NULL AND f.place NOT IN (SELECT place FROM near))),
texts AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text, count(*) AS n_kept FROM kept GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(t.text, '') END AS text, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS INTEGER) AS n_lines,
  CAST(coalesce(t.n_kept, 0) AS INTEGER) AS n_kept FROM documents d LEFT JOIN texts t USING (doc_id)"""

# ------------------------------------------------------------- 7: URL filter

URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge the url of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).drop("url")


_RULE = "WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{o}'"
_FITTING = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
_TERM = "CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN {x} END"
URL_SQL = f"""WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest,
    translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM pages),
split AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_replace(regexp_replace(rest, '^[^/?#]*', ''), '[?#].*$', '', 's') AS path FROM parts),
judged AS (
  SELECT page_id, host, path, CASE {' '.join(_RULE.format(h=h, p=p, o=h + p) for _, h, p in _FITTING)} END AS rule,
    CASE {' '.join(_RULE.format(h=h, p=p, o=v) for v, h, p in _FITTING)} END AS verdict,
    list_sort(list_filter([{', '.join(_TERM.format(t=t, x=f"'{t}'") for t, _ in url_filter.VOCABULARY)}], lambda x: x IS NOT NULL)) AS hit_terms,
    CAST({' + '.join(f"coalesce({_TERM.format(t=t, x=w)}, 0)" for t, w in url_filter.VOCABULARY)} AS INTEGER) AS hit_weight
  FROM split)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN hit_weight >= {url_filter.REJECT_FROM} THEN 'block' ELSE 'allow' END) AS verdict,
  hit_terms, hit_weight FROM judged"""


# ------------------------------------------------------------- 8: quality

KEEP_FROM = 0.7


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document; no label of a held-out row is learnt from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = line_quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = line_quality.score(docs, model).drop("text")
    return scored.select("doc_id", line_quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))



# ------------------------------------------------------------- 9: nearest neighbours


def op9_neighbour_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every vector whose id is divisible by 20, among all others."""
    return neighbour_graph.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


# ------------------------------------------------------------- 10: n-gram Jaccard join


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of 3-word shingle sets with a Jaccard similarity of 0.9 or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.similarity_components(docs, 3, 90).drop("text_key1", "text_key2")


NGRAM_SQL = """WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 3 THEN array_to_string(words, ' ') ELSE array_to_string(words[k:k + 2], ' ') END AS gram
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(words) - 1, 2))) AS k) u WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * common >= 90 * (na.n + nb.n - common)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""


# ------------------------------------------------------------- 11: hard negatives


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten negatives at most for each of the five positives of every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), F.col("id") % 100 == 0)


NEGATIVE_SQL = """WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
  n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY rank <= 10"""

# ------------------------------------------------------------- 12: repeated byte strings


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without the 100-byte strings that also start earlier in the corpus."""
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])
    return kept.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SUFFIX_SQL = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
strings AS (SELECT doc_id, p, row_number() OVER (PARTITION BY b[p:p + 99] ORDER BY doc_id, p) AS nth FROM d, LATERAL (SELECT unnest(range(1, n - 98)) AS p) u),
later AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM strings WHERE nth > 1),
numbered AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM later),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS e FROM numbered GROUP BY doc_id, span),
listed AS (SELECT doc_id, count(*) AS n_spans, sum(e - a) AS n_removed, list_concat([1], list(e ORDER BY a)) AS begins, list(a ORDER BY a) AS ends FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN n_spans IS NULL THEN b ELSE unhex(array_to_string(list_transform(range(1, n_spans + 2), lambda k: hex(b[begins[k]:coalesce(ends[k], n + 1) - 1])), '')) END) AS kept_sha256
FROM d LEFT JOIN listed USING (doc_id)"""

# ------------------------------------------------------------- 13: conversations


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the damage of the contract, chosen by a checksum of ``conv_id:turn``; nulls are one space."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    kind = (F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20).alias("kind")
    rows = conversations.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), kind).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and digest of the repaired rows of every conversation, after the damage of the contract."""
    given = table(spark, sf_dir, "conversations")
    repaired, audits, reports = conversation_repair.repair(damaged(given))
    parts = audits.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "audit"))).alias("parts"))
    whole = parts.select(F.col("conv").alias("c1"), F.array_join("parts.audit", "").alias("audit"))
    digests = conversation_repair.digests(repaired).withColumnRenamed("conv", "c2")
    ids = given.select("conv_id").distinct()
    found = ids.join(reports, F.expr("conv_id <=> conv"), "left").join(whole, F.expr("conv_id <=> c1"), "left").join(digests, F.expr("conv_id <=> c2"), "left")
    none = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select("conv_id", *(F.coalesce(c, none.get(c, F.lit(0).cast("bigint"))).alias(c) for c in [*counts, *none]))


REPAIR_SQL = r"""WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS bytes FROM conversations),
hit AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(list_concat([4294967295], bytes), lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INTEGER)])), 4294967295) % 20 AS kind FROM keyed, crc),
rows AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
  FROM hit, range(1, 3) r(copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    rtrim(text, e' 	

') AS trimmed FROM rows),
faulty AS (
  SELECT *, CASE WHEN ltrim(trimmed, e' 	

') = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM placed),
convs AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal,
    list({'role': role, 'text': text, 'fault': fault} ORDER BY i) AS rows FROM faulty GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0 AS i, rows, [{'cost': 0, 'audit': '', 'g': '', 'out': CAST([] AS VARCHAR[])}] AS best FROM convs
  UNION ALL
  SELECT conv_id, i + 1, rows, list_filter(list_transform(['', 's', 'u', 'a'], lambda g: list_sort(list_filter(cand, lambda x: x.g = g))[1]), lambda x: x IS NOT NULL)
  FROM (
    SELECT w.*, list_filter(list_concat(
      list_transform(ins, lambda x: {'cost': x.cost + 3, 'audit': x.audit || 'D', 'g': x.g, 'out': x.out}),
      CASE WHEN r.fault IN ('blank', 'duplicate') THEN [] ELSE list_concat(
        list_transform(list_filter(ins, lambda x: (x.g || r.role[1]) IN ('s', 'u', 'su', 'ua', 'au')),
          lambda x: {'cost': x.cost + t, 'audit': x.audit || 'K', 'g': r.role[1], 'out': list_append(x.out, r.role || ':' || r.text)}),
        list_transform(ins, lambda x: {'cost': x.cost + 2 + t, 'audit': x.audit || 'R', 'g': CASE WHEN x.g = 'u' THEN 'a' ELSE 'u' END,
          'out': list_append(x.out, CASE WHEN x.g = 'u' THEN 'assistant:' ELSE 'user:' END || r.text)})) END), lambda x: true) AS cand
    FROM (
      SELECT w.*, rows[i + 1] AS r, CASE WHEN rows[i + 1].fault = 'truncated' THEN 1 ELSE 0 END AS t, flatten(list_transform(best, lambda x: list_transform(range(4), lambda k: {
        'cost': CAST(x.cost + 2 * k AS INTEGER), 'audit': x.audit || repeat('I', k), 'g': CASE WHEN k = 0 THEN x.g WHEN (x.g = 'u') = (k % 2 = 1) THEN 'a' ELSE 'u' END,
        'out': list_concat(x.out, list_transform(range(k), lambda j: CASE WHEN (x.g = 'u') = (j % 2 = 0) THEN 'assistant:' ELSE 'user:' END))}))) AS ins
      FROM walk w WHERE i < len(rows)) w)),
ended AS (
  SELECT conv_id, list_sort(list_transform(list_filter(best, lambda x: true), lambda x: {
    'cost': x.cost + CASE x.g WHEN 'u' THEN 2 WHEN 's' THEN 4 ELSE 0 END, 'audit': x.audit || CASE x.g WHEN 'u' THEN 'I' WHEN 's' THEN 'II' ELSE '' END,
    'out': list_concat(x.out, CASE x.g WHEN 'u' THEN ['assistant:'] WHEN 's' THEN ['user:', 'assistant:'] ELSE [] END)}))[1] AS b FROM walk WHERE i = len(rows))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(b.cost, 0) AS BIGINT) AS cost, coalesce(b.audit, '') AS audit,
  sha256(coalesce(array_to_string(b.out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN convs c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""


QUERIES = {f.__name__: f for f in (op1_pii_surrogates, op2_simhash_decontamination, op3_byte_bpe, op4_token_counts, op5_extendible_shards, op6_line_dedup, op7_url_filter, op8_line_quality, op9_neighbour_graph, op10_ngram_jaccard, op11_hard_negatives, op12_suffix_dedup, op13_conversation_repair)}
ORACLES = {"op5_extendible_shards": SHARD_SQL, "op6_line_dedup": LINE_SQL, "op7_url_filter": URL_SQL, "op10_ngram_jaccard": NGRAM_SQL, "op11_hard_negatives": NEGATIVE_SQL, "op12_suffix_dedup": SUFFIX_SQL, "op13_conversation_repair": REPAIR_SQL}
