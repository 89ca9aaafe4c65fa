"""The queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import decontaminate, exact_dedup, license_scan, line_dedup, lm_score, mixing, ngram_join, quality, substring_dedup, token_count


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_score(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(_table(spark, sf_dir, "documents")).drop("row", "first_row")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents"))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_count(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_lm_score, op2_mixing, op3_exact_dedup, op4_substring_dedup, op5_ngram_join, op6_license_scan, op7_token_count, op8_quality, op9_line_dedup, op10_decontaminate)}

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op2_mixing": rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
         md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight,
         2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM sources),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
goals AS (
  SELECT source, source_size,
         CASE WHEN cap <= weight * level THEN cap
              ELSE weight * (budget - sum(CASE WHEN cap <= weight * level THEN cap ELSE 0 END) OVER ())
                   / sum(CASE WHEN cap <= weight * level THEN 0 ELSE weight END) OVER () END AS target
  FROM levels),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, floor(g.target)::BIGINT AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id NULLS FIRST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
cut AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM cut""",
    "op3_exact_dedup": f"""
WITH t AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM t""",
}


def _regex(template: str) -> str:
    """A template as a regular expression over words that each follow one space, straight from its markup."""
    out = ""
    for part in re.findall(r"\[\[|\]\]|\{\{\w+:\d+-\d+\}\}|\([^)]*\)|[^\s\[\]{}()]+", template):
        if part[0] == "{":
            out += "(?: [^ ]+)" + re.sub(r".*:(\d+)-(\d+).*", r"{\1,\2}", part)
        else:
            out += {"[[": "(?:", "]]": ")?"}.get(part, " (?:" + part.strip("()") + ")")
    return out


def _license_sql() -> str:
    cases = lambda templates: [(label, f"regexp_matches(line, '{_regex(t)}(?: |$)')") for label, t in templates]
    listed = lambda templates: ", ".join(f"CASE WHEN {test} THEN '{label}' END" for label, test in cases(templates))
    places = " || ".join("list_filter(range(1, len(w) + 1), lambda i: " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())) + ")" for phrase in license_scan.PHRASES)
    base = ", ".join(f"CASE WHEN contains(line || ' ', ' {phrase} ') THEN '{label}' END" for phrase, label in license_scan.PHRASES.items())
    joined = "array_to_string(list_sort(list_distinct(list_filter({}, lambda x: x IS NOT NULL))), ',')".format
    some = "len(list_filter({}, lambda x: x IS NOT NULL)) > 0".format
    return rf"""
WITH t AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
l AS (SELECT doc_id, w, CASE WHEN len(w) > 0 THEN ' ' || array_to_string(w, ' ') ELSE '' END AS line FROM t),
p AS (SELECT doc_id, len(w)::BIGINT AS n_words, {places} AS places, [{base}] AS b, [{listed(license_scan.LICENSES)}] AS f, [{listed(license_scan.NOTICES)}] AS g FROM l)
SELECT doc_id, n_words, len(places)::BIGINT AS n_base, (list_min(places) - 1)::BIGINT AS first_word, (list_max(places) - 1)::BIGINT AS last_word,
       {joined("b")} AS base_labels, {joined("b || f || g")} AS labels,
       CASE WHEN {some("f")} THEN 1.0::DOUBLE WHEN {some("g")} THEN 0.75::DOUBLE WHEN len(places) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM p"""


ORACLES["op6_license_scan"] = _license_sql()

#: Every alignment of every item with every document that shares a word with it: no seeds.
ORACLES["op10_decontaminate"] = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ 	-
]+'), lambda x: x <> '') AS w FROM benchmark),
items AS (SELECT item_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS k FROM b WHERE len(w) >= 5),
common AS (SELECT word FROM items GROUP BY word),
words AS (SELECT doc_id, word, k FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS k FROM d) SEMI JOIN common USING (word)),
equal AS (SELECT DISTINCT doc_id, item_id, n, words.k - items.k AS first_word, items.k AS k FROM words JOIN items USING (word)),
totals AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, first_word) AS equal_words FROM equal),
likely AS (SELECT * FROM totals WHERE equal_words >= least(n, {decontaminate.WINDOW}) - floor(least(n, {decontaminate.WINDOW}) * {decontaminate.SUBSTITUTIONS} / {decontaminate.WINDOW}.0)),
windows AS (
  SELECT doc_id, item_id, first_word, n, equal_words,
         count(*) OVER (PARTITION BY doc_id, item_id, first_word ORDER BY k RANGE BETWEEN least(n, {decontaminate.WINDOW}) - 1 PRECEDING AND CURRENT ROW) AS inside
  FROM likely),
best AS (SELECT doc_id, item_id, first_word, n, equal_words, max(inside) AS best_window FROM windows GROUP BY ALL),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS number FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
counted AS (SELECT doc_id, number, list_filter(regexp_split_to_array(lower(line), '[ 	-
]+'), lambda x: x <> '') AS w FROM lines),
placed AS (SELECT doc_id, w, coalesce(sum(len(w)) OVER (PARTITION BY doc_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_word FROM counted),
short AS (SELECT p.doc_id, b.item_id, p.first_word, len(b.w) AS n FROM placed p JOIN b ON p.w = b.w WHERE len(b.w) BETWEEN 1 AND 4),
kept AS (SELECT doc_id, item_id, first_word, n, n AS equal_words, n AS best_window FROM short UNION ALL SELECT doc_id, item_id, first_word, n, equal_words, best_window FROM best WHERE best_window >= least(n, {decontaminate.WINDOW}) - floor(least(n, {decontaminate.WINDOW}) * {decontaminate.SUBSTITUTIONS} / {decontaminate.WINDOW}.0)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY equal_words DESC, best_window DESC, first_word) AS r FROM kept)
SELECT doc_id, item_id, first_word::BIGINT AS first_word, n::BIGINT AS item_words, equal_words::BIGINT AS equal_words, best_window::BIGINT AS best_window
FROM ranked WHERE r = 1"""

#: All pairs of texts that share a shingle, and their components.
ORACLES["op5_ngram_join"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
k AS (SELECT doc_id, w, array_to_string(w, ' ') AS node FROM d),
nodes AS (SELECT node, any_value(w) AS w, min(doc_id) AS least, count(*) AS copies FROM k GROUP BY node),
shingles AS (
  SELECT DISTINCT node, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT node, w, unnest(range(1, len(w) - 3)) AS i FROM nodes WHERE len(w) >= 5)
  UNION ALL SELECT node, ' ' || node FROM nodes WHERE len(w) BETWEEN 1 AND 4),
sizes AS (SELECT node, count(*) AS n FROM shingles GROUP BY node),
pairs AS (SELECT a.node AS a, b.node AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.node <> b.node GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.node = a JOIN sizes y ON y.node = b WHERE common >= {ngram_join.THRESHOLD} * (x.n + y.n - common) - 1e-9 * (x.n + y.n)),
reach AS (SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
classes AS (SELECT a AS node, min(least) AS class_id FROM reach JOIN nodes ON node = b GROUP BY a),
counts AS (SELECT a AS node, sum(copies)::BIGINT AS n FROM links JOIN nodes ON node = b GROUP BY a)
SELECT doc_id, class_id, (copies - 1 + coalesce(n, 0))::BIGINT AS n_links
FROM k JOIN nodes USING (node) JOIN classes USING (node) LEFT JOIN counts USING (node)"""

#: Lines settled in rounds over all pairs that share what is left without one word; whole sequences instead of hashes.
ORACLES["op9_line_dedup"] = rf"""
WITH RECURSIVE l AS (SELECT doc_id, text, unnest(ls) AS line, unnest(range(len(ls))) AS k FROM (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
w AS (SELECT doc_id, k, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM l),
c AS (SELECT w, min((doc_id, k)) AS first FROM w WHERE len(w) > 0 GROUP BY w),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY first) AS n FROM c),
v AS (SELECT w, n, i, w[:i] || w[i + 2:] AS v FROM (SELECT *, unnest(range(len(w))) AS i FROM o WHERE len(w) >= {line_dedup.WORDS_PER_EDIT})),
p AS (SELECT DISTINCT a.n AS a, b.n AS b FROM v a JOIN v b ON a.v = b.v AND a.i = b.i AND a.n < b.n
      UNION SELECT DISTINCT least(a.n, b.n), greatest(a.n, b.n) FROM o a JOIN v b ON b.v = a.w WHERE len(a.w) >= {line_dedup.WORDS_PER_EDIT}),
-- one line after the other: the state of all lines in pairs, as a list of those that stay
q AS MATERIALIZED (SELECT b, list(a) AS earlier, row_number() OVER (ORDER BY b) AS step FROM p GROUP BY b),
r AS (SELECT 0::BIGINT AS step, []::BIGINT[] AS near
      UNION ALL SELECT q.step, CASE WHEN len(list_filter(q.earlier, lambda x: NOT list_contains(r.near, x))) > 0 THEN list_append(r.near, q.b) ELSE r.near END
      FROM r JOIN q ON q.step = r.step + 1),
near AS (SELECT unnest(near) AS n FROM (SELECT near FROM r ORDER BY step DESC LIMIT 1)),
m AS (SELECT w.doc_id, w.k, w.line, coalesce((w.doc_id, w.k) <> o.first OR near.n IS NOT NULL, false) AS gone FROM w LEFT JOIN o ON o.w = w.w LEFT JOIN near ON near.n = o.n)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS text_sha256
FROM m GROUP BY doc_id"""
