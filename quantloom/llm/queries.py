"""One query per operator: its whole table in, its contract columns out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, embeddings, licences, pii, quality, toxicity, whitening
from .catalog import query
from .common import size_of, table
from .html_text import extract
from .jaccard import link
from .language import identify
from .mixing import SALT, mix, quality_weight
from .secrets import scan


def weighted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, source, size and quality weight of each document; several labels of one document are averaged."""
    good = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.avg("quality").alias("quality"))
    d = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"))
    return d.join(good, d.doc_id == good.labelled, "left").select("doc_id", "source", "size", quality_weight(F.col("quality")).alias("weight"))


MIX_SQL = f"""
WITH good AS (SELECT doc_id, avg(quality) AS quality FROM labels GROUP BY doc_id),
d AS (SELECT d.doc_id, d.source, CAST(coalesce(len(regexp_extract_all(d.text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
        CASE WHEN g.quality IS NULL THEN 1.0::DOUBLE WHEN g.quality >= 0.5 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS weight
      FROM {{docs}} d LEFT JOIN good g ON d.doc_id = g.doc_id),
k AS (SELECT *, -ln((CAST(('0x' || substr(md5('{SALT}' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / weight AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS w, 2.0::DOUBLE * source_size AS most FROM s),
l AS (SELECT *, row_number() OVER o AS pos,
        (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
      FROM w WINDOW o AS (ORDER BY most / w, source ASC NULLS LAST)),
f AS (SELECT level FROM l WHERE level <= most / w ORDER BY pos LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN (SELECT count(*) FROM f) = 0 THEN most ELSE least(most, (SELECT level FROM f) * w) END AS target FROM l),
r AS (SELECT k.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM k),
e AS (SELECT r.*, t.source_size, t.target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, CAST(floor(target + 0.5) AS BIGINT) - epochs * source_size - ahead)) AS BIGINT) AS taken,
  source, epochs FROM e"""


@query("op1_mixing", sql=MIX_SQL.format(docs="documents"))
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(weighted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


@query("op2_language")
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


@query("op3_secrets")
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def listing(spans, kinds) -> Column:
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_sql(kind, plain: str, good: str) -> str:
    """Spans of one kind in plain SQL: the text split at the matches gives the gaps before each."""
    start = ("CAST(coalesce(list_sum([length(x) FOR x IN g[1:i]]), 0) + coalesce(list_sum([length(x) FOR x IN f[1:i - 1]]), 0) AS BIGINT)")
    return f"""{kind.name}_f AS (SELECT n, regexp_extract_all(text, '{plain}') AS f, string_split_regex(text, '{plain}') AS g FROM d),
{kind.name} AS (SELECT n, f[i] AS v, {start} AS s, {start} + length(f[i]) AS e,
    CASE WHEN regexp_matches(right(g[i], {pii.NEAR}), '(?i)\b(?:{kind.words})\b') THEN '{kind.score + pii.BONUS:.2f}' ELSE '{kind.score:.2f}' END AS score
  FROM (SELECT n, f, g, unnest(range(1, len(f) + 1)) AS i FROM {kind.name}_f)),
{kind.name}_ok AS (SELECT n, '{kind.name}' AS kind, s, e, score FROM {kind.name} WHERE {good})"""


def digits_sql(v: str) -> str:
    """Sum of the digits of ``v``, every second one from the right doubled."""
    d = f"CAST(substr({v}, length({v}) - j, 1) AS INT)"
    return f"list_sum([CASE WHEN j % 2 = 0 THEN {d} WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END FOR j IN range(0, length({v}))])"


LETTERS_AS_NUMBERS = "list_aggregate([CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END FOR c IN string_split(substr(t, 5) || substr(t, 1, 4), '')], 'string_agg', '')"
PII_SQL = "WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM {docs}),\n" + ",\n".join([
    pii_sql(pii.EMAIL, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    pii_sql(pii.IP, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len([x FOR x IN string_split(v, '.') IF length(ltrim(x, '0')) > 3 OR CAST('0' || right(ltrim(x, '0'), 3) AS INT) > 255]) = 0"),
    pii_sql(pii.CARD, r"[0-9](?:[\x20-]?[0-9])+", f"length(translate(v, ' -', '')) BETWEEN 16 AND 19 AND {digits_sql("translate(v, ' -', '')")} % 10 = 0"),
    pii_sql(pii.PHONE, r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 8 AND 15"),
    pii_sql(pii.IBAN, r"\b(?:[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b", f"length(translate(v, ' ', '')) BETWEEN 15 AND 34 AND CAST(replace({LETTERS_AS_NUMBERS.replace('t,', "translate(v, ' ', ''),")}, '', '') AS HUGEINT) % 97 = 1"),
    """s AS (SELECT *, ['email', 'ip', 'card', 'phone', 'iban'] AS kinds FROM (SELECT * FROM email_ok UNION ALL SELECT * FROM ip_ok UNION ALL SELECT * FROM card_ok UNION ALL SELECT * FROM phone_ok UNION ALL SELECT * FROM iban_ok)),
a AS (SELECT n, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
    string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY list_position(kinds, kind), s) FILTER (kind <> 'iban') AS base,
    string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY list_position(kinds, kind), s) AS spans, string_agg(score, ',' ORDER BY list_position(kinds, kind), s) AS scores FROM s GROUP BY n)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN a ON d.n = a.n"""])


@query("op4_pii", sql=PII_SQL.replace("{docs}", "documents"))
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [k.name for k in pii.BASE]
    counts = [F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in base]  # noqa: B023
    scores = F.array_join(F.transform("found", lambda s: F.format_number(s["score"], 2)), ",")
    return pii.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", *counts, F.sha2(listing(F.col("found"), base), 256).alias("base_sha256"),
        listing(F.col("found"), [k.name for k in pii.KINDS]).alias("spans"), scores.alias("scores"))


LEAK_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
LEAK_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({LEAK_WORDS}, []) AS w FROM {{docs}}),
i AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {LEAK_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS p FROM i)),
dp AS (SELECT r, w, n, unnest(range(1, CAST(greatest(len(w) - n + 2, 1) AS BIGINT))) AS p FROM d CROSS JOIN (SELECT DISTINCT n FROM i)),
h AS (SELECT r, p, dw.n, item_id FROM (SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS win FROM dp) dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
hw AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS k FROM h) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw ON d.r = hw.r LEFT JOIN hi ON d.r = hi.r"""


@query("op8_decontamination", sql=LEAK_SQL.format(docs="documents"))
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op7_html_text")
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


JOIN_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT r, doc_id, list_distinct([array_to_string(w[p:p + least(len(w), 4) - 1], ' ') FOR p IN range(1, CAST(greatest(len(w) - 2, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END) AS BIGINT))]) AS g FROM d),
k AS (SELECT min(r) AS k, min(doc_id) AS doc_id, g, len(g) AS n FROM (SELECT r, doc_id, list_sort(g) AS g FROM s) WHERE len(g) > 0 GROUP BY g),
t AS (SELECT k, n, unnest(g) AS t FROM k),
p AS (SELECT a.k AS a, b.k AS b FROM t a JOIN t b ON a.t = b.t AND a.k < b.k AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c AS (WITH RECURSIVE c(k, m) AS (SELECT k, k FROM k UNION SELECT e.b, c.m FROM c JOIN e ON c.k = e.a) SELECT k, min(m) AS m FROM c GROUP BY k),
n AS (SELECT c.m, min(k.doc_id) AS component_id FROM c JOIN k USING (k) GROUP BY c.m)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE n.component_id END AS component_id
FROM s LEFT JOIN k ON list_sort(s.g) = k.g LEFT JOIN c ON k.k = c.k LEFT JOIN n ON c.m = n.m"""


@query("op6_jaccard_join", sql=JOIN_SQL)
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


NEAR_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT r, vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.r < b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95::DOUBLE),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c AS (WITH RECURSIVE c(k, m) AS (SELECT r, r FROM v UNION SELECT e.b, c.m FROM c JOIN e ON c.k = e.a) SELECT k, min(m) AS m FROM c GROUP BY k),
n AS (SELECT c.m, min(v.vec_id) AS component_id FROM c JOIN v ON v.r = c.k GROUP BY c.m),
l AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT v.vec_id, coalesce(l.n, 0) AS n_links, n.component_id, v.vec_id IS NOT DISTINCT FROM n.component_id AS kept
FROM v JOIN c ON v.r = c.k JOIN n ON c.m = n.m LEFT JOIN l ON v.r = l.a"""


@query("op10_embedding_duplicates", sql=NEAR_SQL)
def op10_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op5_licences")
def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = whitening.whiten(table(spark, sf_dir, "embeddings"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "value")
    return row.select("vec_id", "n", "deviation", "identity_error", each).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("value.whitened").alias("whitened"), F.col("value.explained").alias("explained"), "identity_error")


QUALITY_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
p AS (SELECT r, p, count(*) OVER (PARTITION BY r, win) AS c FROM (SELECT r, p, array_to_string(w[p:p + 7], ' ') AS win FROM (SELECT r, w, unnest(range(1, CAST(len(w) - 6 AS BIGINT))) AS p FROM d WHERE len(w) > 8))),
c AS (SELECT r, count(DISTINCT hit) AS n FROM (SELECT r, unnest(range(p, p + 8)) AS hit FROM p WHERE c > 1) GROUP BY r),
m AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed FROM (
  SELECT d.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '{quality.SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM d JOIN l ON d.r = l.r LEFT JOIN c ON d.r = c.r)),
{quality.limits_sql()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.r IS NULL AS kept FROM m LEFT JOIN bad ON m.r = bad.r"""


@query("op12_quality_rules", sql=QUALITY_SQL)
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, byte by byte and bit by bit."""
    bit = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384::BIGINT) ELSE {0} >> 1 END"
    eight = f"list_reduce(range(8), lambda c, j: {bit.format('c')}, xor(a, b))"
    codes = f"list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT)))"
    return f"xor(list_reduce({codes}, lambda a, b: {eight}), 4294967295::BIGINT)"


def _least_sql(*ways: tuple[str, str, str, str]) -> str:
    """Least (cost, audit) of ways (condition, state before, cost, letter); a state is nine digits of cost and the audit, null if out of reach."""
    return "least(" + ", ".join(f"CASE WHEN {when} THEN lpad(CAST(CAST(left({state}, 9) AS INT) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10) || '{letter}' END" for when, state, cost, letter in ways) + ")"


def _inserted_sql(source: str, of: str) -> str:
    """States 2 (after user) and 3 (after assistant) once more with an insertion."""
    return f"SELECT * REPLACE (least(s2, {_least_sql(*[('true', s, '3', 'I') for s in ('s0', 's1', 's3')])}) AS s2, least(s3, {_least_sql(('true', 's2', '3', 'I'))}) AS s3) FROM ({of.format(source)})"


_KEPT = "go AND i = '{}'"
_TURNED = "go AND i <> '{}'"
REPAIR_SQL = f"""
WITH RECURSIVE c0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS drawn FROM conversations),
c1 AS (SELECT conv_id, turn, CASE WHEN drawn = 4 THEN 'user' ELSE role END AS role, CASE drawn WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN drawn = 3 THEN 2 ELSE 1 END)) AS again FROM c0 WHERE drawn <> 0),
c2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(role, 32), left(text, 32), md5(length(role) || ':' || role || text)) AS n, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM c1),
c3 AS (SELECT *, left(role, 1) AS i, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM c2),
r AS (SELECT conv_id, n, i, fault NOT IN (1, 2) AS go, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS cut FROM c3),
dp AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS n, '000000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM r
  UNION ALL
  SELECT conv_id, n, {_least_sql(("true", "s0", "4", "D"))} AS s0,
    {_least_sql(("true", "s1", "4", "D"), (_KEPT.format("s"), "s0", "cut", "K"))} AS s1,
    {_least_sql(("true", "s2", "4", "D"), *[(w.format("u"), s, c, x) for s in ("s0", "s1", "s3") for w, c, x in ((_KEPT, "cut", "K"), (_TURNED, "cut + 3", "R"))])} AS s2,
    {_least_sql(("true", "s3", "4", "D"), (_KEPT.format("a"), "s2", "cut", "K"), (_TURNED.format("a"), "s2", "cut + 3", "R"))} AS s3
  FROM ({_inserted_sql("(SELECT r.conv_id, r.n, r.i, r.go, r.cut, s0, s1, s2, s3 FROM dp JOIN r ON dp.conv_id IS NOT DISTINCT FROM r.conv_id AND r.n = dp.n + 1)", _inserted_sql("{}", "SELECT * FROM {}").replace("{}", "{0}"))})),
z AS (SELECT conv_id, least(s0, s3) AS s FROM ({_inserted_sql("(SELECT * FROM dp QUALIFY n = max(n) OVER (PARTITION BY conv_id))", _inserted_sql("{}", "SELECT * FROM {}").replace("{}", "{0}"))})),
e AS (SELECT conv_id, p, letter, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER w AS n, sum(CASE WHEN letter <> 'D' THEN 1 ELSE 0 END) OVER w AS o, sum(CASE WHEN letter <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS whole
  FROM (SELECT conv_id, p, substr(s, p + 9, 1) AS letter FROM (SELECT conv_id, s, unnest(range(1, CAST(length(s) - 8 AS BIGINT))) AS p FROM z)) WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
f AS (SELECT e.conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - whole) % 2 = 0 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS repaired
  FROM e LEFT JOIN c3 ON e.conv_id IS NOT DISTINCT FROM c3.conv_id AND e.n = c3.n WHERE letter <> 'D' GROUP BY e.conv_id),
g AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (b IS NOT NULL AND b || i NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY n) AS b FROM c3) GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(left(s, 9), '0') AS BIGINT) AS cost, coalesce(substr(s, 10), '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN g ON o.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN z ON o.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN f ON o.conv_id IS NOT DISTINCT FROM f.conv_id"""


@query("op11_conversation_repair", sql=REPAIR_SQL)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations")
    return conversations.report(told, conversations.damaged(told))
