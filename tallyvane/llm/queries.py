"""The registered queries of this folder: thin wrappers around its operators."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .backoff_lm import lm_scores
from .decontaminate import contamination
from .lexical_search import lexical_search
from .media import document_media, sequences
from .mixing import posteriors, rates
from .pseudonyms import kind_counts, pseudonymised
from .quality import scored
from .simhash import near_duplicates
from .token_counts import token_counts
from .token_output import read_tokens, write_tokens
from .toxicity import toxicity
from .url_filter import url_verdicts
from .whitening import whitened


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of the URL query, as (host, path, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


#: Production parameter: wanted shares of tokens by language.
MIX = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}


def labelled_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, domain): the language of the documents that the labels table covers."""
    languages = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("domain"))
    return table(spark, sf_dir, "labels").select("doc_id").join(languages, "doc_id")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents towards MIX."""
    found, domains = posteriors(table(spark, sf_dir, "documents"), labelled_languages(spark, sf_dir))
    targets = {d: w for d, w in MIX.items() if d in domains}
    if missing := sorted(set(MIX) - set(targets)):
        warnings.warn(f"no labelled documents in {missing}: their weight goes to the other languages", stacklevel=2)
    names = F.array(*map(F.lit, domains)).cast("array<string>")
    return rates(found, domains, targets).select(F.col("id").alias("doc_id"), "n_tokens", names.alias("domains"), "posterior", "rate")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages by URL_RULES."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_verdicts(table(spark, sf_dir, "pages"), rules)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and bigram scores of all documents."""
    return lm_scores(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return scored(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents, exact and by proximity."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated", F.size("near").cast("long").alias("n_near"))


def word_vocabulary() -> str:
    """Place of the word BPE vocabulary; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the token files hold per document."""
    return read_tokens(spark, write_tokens(table(spark, sf_dir, "documents"), word_vocabulary()))


#: The session's setting with the secret key; the second stands in where it is unset.
PSEUDONYM_KEY = "spark.tallyvane.pseudonymKey", "registered query"


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms, their spans and counts by kind."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymised(docs, spark.conf.get(*PSEUDONYM_KEY).encode()).select("doc_id", "text", "spans", kind_counts(F.col("spans")).alias("found"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored payload of every document's text, by way of its page."""
    return document_media(table(spark, sf_dir, "documents"))


def media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of all pages in order, with captions: the sequences of operator 9 by themselves."""
    return sequences(table(spark, sf_dir, "pages")).select("page_id", F.inline("items"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def piece_model() -> str:
    """Place of the subword model; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


#: Production parameter: documents of more tokens are over the limit.
TOKEN_LIMIT = 4096


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents."""
    found = token_counts(table(spark, sf_dir, "documents"), piece_model())
    return found.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


#: Production parameter: documents returned for each benchmark item.
BEST = 50


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of all for every benchmark item."""
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), BEST)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened leading components of all embeddings. A deviation beyond a long is null; deviation_exact has it."""
    found = whitened(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation_exact", F.col("deviation")).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_url_filter": op2_url_filter,
    "op3_simhash": op3_simhash,
    "op4_backoff_lm": op4_backoff_lm,
    "op5_quality": op5_quality,
    "op6_decontaminate": op6_decontaminate,
    "op7_token_output": op7_token_output,
    "op8_pseudonyms": op8_pseudonyms,
    "op9_media": op9_media,
    "op10_toxicity": op10_toxicity,
    "op11_token_counts": op11_token_counts,
    "op12_lexical_search": op12_lexical_search,
    "op13_whitening": op13_whitening,
    "media_sequences": media_sequences,
}

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLES = {
    "op12_lexical_search": r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), d AS (SELECT doc_id, w, len(w)::BIGINT AS n FROM t WHERE len(w) > 0),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM d),
p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM d) GROUP BY ALL),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), v AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY term, docs),
r AS (
  SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN v USING (term), s GROUP BY 1, 2
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 50
""",
    "op4_backoff_lm": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w,
         coalesce(doc_id::VARCHAR, '') AS id FROM documents
), crc AS (
  -- CRC32: a fold over the bytes, each followed by eight shifts (-1).
  SELECT doc_id, w, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(id) + 1), lambda i: [ascii(id[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % 5 = 1 AS held_out FROM d
), t AS (
  SELECT doc_id, held_out, unnest(list_append(w, chr(10))) AS word, unnest(list_prepend(' ', w)) AS before FROM crc
), c AS (SELECT word, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1),
n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, coalesce(sum(c), 0) + 0.5 * (count(*) + 1) AS z FROM c),
h AS (SELECT before, count(*) AS c_state FROM t WHERE NOT held_out GROUP BY 1),
b AS (SELECT before, word, count(*) AS c_pair FROM t WHERE NOT held_out GROUP BY 1, 2),
p AS (
  SELECT doc_id, held_out, c IS NOT NULL AS known, (coalesce(c, 0) + 0.5) / z AS p_word, coalesce(c_state, 0) AS c_state, coalesce(c_pair, 0) AS c_pair
  FROM t LEFT JOIN c USING (word) LEFT JOIN h USING (before) LEFT JOIN b USING (before, word), n
)
SELECT doc_id, held_out, count(*) AS n_tokens, count_if(known)::BIGINT AS n_known, (SELECT n FROM n) AS train_tokens, sum(log10(p_word)) AS base_score,
       sum(log10((c_pair + 500 * p_word) / (c_state + 500))) AS score
FROM p GROUP BY 1, 2
""",
    "op2_url_filter": f"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), rules(h, p, v) AS (VALUES {_RULE_ROWS}),
best AS (
  SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best
""",
    "op6_decontaminate": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM bw))
), m AS (SELECT doc_id, s, k, item_id FROM dw JOIN bw USING (k, phrase)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY 1),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM m GROUP BY 1),
t AS (SELECT doc_id, generate_subscripts(w, 1) AS p, unnest(w) AS term FROM d),
b3 AS (
  SELECT item_id, term, min(o) AS o, (SELECT count(*) FROM t WHERE t.term = x.term) AS n
  FROM (SELECT item_id, generate_subscripts(w, 1) AS o, unnest(w) AS term FROM b) x GROUP BY item_id, term
), b4 AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS need FROM (SELECT item_id, term FROM b3 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n, o) <= 3)),
l AS (SELECT doc_id, item_id, p, term, need FROM t JOIN b4 USING (term)),
near AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (
    SELECT doc_id, item_id, need, len(list_distinct(list(term) OVER (PARTITION BY doc_id, item_id ORDER BY p RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING))) AS seen FROM l
  ) WHERE seen = need GROUP BY 1
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN near USING (doc_id)
""",
}
