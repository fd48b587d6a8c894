"""Registered queries of this package and their comparison SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm import collocation, decontaminate, fim, hyperminhash, lm, mixing, pii, quality, secrets, toxicity, transcript, urlfilter, warc

#: Rank file of a public tokenizer.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

QUERIES = {}
ORACLE = {}


def register(name: str, sql: str = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@register("op1_pii")
def op1(spark, folder):
    return pii.digest(pii.find(table(spark, folder, "documents")))


@register("op4_quality_rules")
def op4(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    judged = quality.judge(docs)
    m = F.col("measured")
    counts = [m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, quality.base_failed(m).alias("base_failed"), "kept", F.round("quality", 9).alias("quality"))


@register("op5_secrets")
def op5(spark, folder):
    return secrets.digest(secrets.find(table(spark, folder, "documents")))


def words_sql(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{pattern}')"


OP2_SQL = rf"""
WITH iw AS (SELECT item_id, {words_sql("text", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM iw WHERE len(w) > 0)),
dw AS (SELECT row_number() OVER () AS rid, doc_id, {words_sql("text", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS w FROM documents),
ks AS (SELECT DISTINCT k FROM win),
grams AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram
          FROM (SELECT rid, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM dw, ks WHERE len(w) >= k)),
occ AS (SELECT g.rid, g.i, g.k, win.item_id FROM grams g JOIN win ON g.k = win.k AND g.gram = win.gram),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + k - 1)) AS p FROM occ) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""


@register("op2_decontamination", OP2_SQL)
def op2(spark, folder):
    index = decontaminate.build(table(spark, folder, "documents"))
    return decontaminate.digest(decontaminate.search(index, decontaminate.windows(table(spark, folder, "benchmark"))))


@register("op10_hyperminhash")
def op10(spark, folder):
    return hyperminhash.group(table(spark, folder, "documents"))


def sainte_lague_sql(rows: str, name: str, group: str, weight: str, of: str, seats: str, most: str) -> str:
    """Seats handed out one by one to the highest quotient, over all quotients of each row."""
    return f"""
{name}_q AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY w / (2 * k + 1) DESC, tie NULLS LAST, k) AS place
  FROM (SELECT *, CAST({weight} AS DOUBLE) AS w, unnest(generate_series(0, CAST({most} AS BIGINT) - 1)) AS k FROM {rows}) WHERE w > 0),
{name} AS (SELECT r.*, coalesce(n, 0) AS quota FROM {rows} r LEFT JOIN
  (SELECT id, count(*) AS n FROM {name}_q WHERE place <= {seats} GROUP BY id) USING (id))"""


#: Shards are apportioned in one level here, as the operator does up to FANOUT shards.
OP3_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key FROM documents),
al AS (SELECT CAST(sum(size) AS BIGINT) AS t FROM d),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, CAST({mixing.REPEATS} * source_size AS DOUBLE) AS room FROM s0),
s2 AS (SELECT *, row_number() OVER o AS at_, coalesce(sum(room) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_ FROM s1 WINDOW o AS (ORDER BY room / weight, source NULLS LAST)),
s3 AS (SELECT s2.*, (CAST(t AS DOUBLE) - before) / CAST(left_ AS DOUBLE) AS level FROM s2, al),
op AS (SELECT at_ AS open_at, level AS final FROM s3 WHERE level * weight <= room ORDER BY at_ LIMIT 1),
tg AS (SELECT source, source_size, CASE WHEN at_ < open_at THEN room ELSE final * weight END AS target, at_ AS id, source AS tie FROM s3, op),
{sainte_lague_sql("tg", "sq", "1", "target", "t", f"(SELECT t // {mixing.BLOCK} FROM al)", f"floor(source_size * {mixing.REPEATS} / {mixing.BLOCK})")},
sh AS (SELECT d.*, CAST(('0x' || substr(key, 1, 8)) AS BIGINT) % (SELECT greatest(1, t // {mixing.SHARD_WORDS}) FROM al) AS shard FROM d),
p0 AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS shard_size FROM sh GROUP BY source, shard),
p1 AS (SELECT p0.*, row_number() OVER () AS id, shard AS tie, source_size, target, sq.quota AS source_quota FROM p0 JOIN sq ON p0.source IS NOT DISTINCT FROM sq.source),
{sainte_lague_sql("p1", "pq", "source", "shard_size", "source_size", "source_quota", f"floor(shard_size * {mixing.REPEATS} / {mixing.BLOCK})")},
ln AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sh),
rs AS (SELECT ln.*, source_size, target, shard_size, quota * {mixing.BLOCK} AS words,
         CASE WHEN shard_size > 0 THEN (quota * {mixing.BLOCK}) // shard_size ELSE 0 END AS rounds
       FROM ln JOIN pq ON ln.source IS NOT DISTINCT FROM pq.source AND ln.shard = pq.shard)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(rounds * size + least(size, greatest(words - rounds * shard_size - before, 0)) AS BIGINT) AS taken FROM rs
"""


@register("op3_source_mix", OP3_SQL)
def op3(spark, folder):
    return mixing.mix(table(spark, folder, "documents"))


OP6_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d FROM p),
m AS (SELECT d, max(page_id) AS best FROM q WHERE n >= {warc.SMALL} GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, q.d AS payload_digest,
       CASE WHEN n >= {warc.SMALL} AND page_id IS DISTINCT FROM best AND best IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {warc.SMALL} AND page_id IS DISTINCT FROM best THEN best END AS refers_to
FROM q LEFT JOIN m ON q.d = m.d
"""


@register("op6_warc", OP6_SQL)
def op6(spark, folder):
    return warc.digest(warc.read(spark, warc.archive(table(spark, folder, "pages"))))


def _terms_sql(terms) -> str:
    return " + ".join(f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS BIGINT)" for t in terms)


_RULES_SQL = sorted(urlfilter.RULES, key=lambda r: -len(r[1] + r[2]))
_FITS_SQL = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in _RULES_SQL]
OP9_SQL = rf"""
WITH a AS (SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
b AS (SELECT *, CASE {' '.join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(_FITS_SQL, _RULES_SQL, strict=True))} END AS rule,
  CASE {' '.join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(_FITS_SQL, _RULES_SQL, strict=True))} END AS ruled,
  {_terms_sql(urlfilter.STRICT)} AS n_strict, {_terms_sql(urlfilter.SOFT)} AS n_soft FROM a)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN n_strict > 0 OR n_soft >= {urlfilter.SOFT_HITS} THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft FROM b
"""


@register("op9_url_filter", OP9_SQL)
def op9(spark, folder):
    return urlfilter.judge(table(spark, folder, "pages"))


@register("op8_toxicity")
def op8(spark, folder):
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register("op7_transcripts")
def op7(spark, folder):
    lines = transcript.flatten(table(spark, folder, "conversations"))
    found = transcript.turns(transcript.decode(lines.select("conv_id", "line_no", "line"), transcript.learn(lines)))
    return found.select("conv_id", "turn_no", F.floor(F.col("first_line") / transcript.TURN_LINES).cast("long").alias("turn"), "role", "text", F.sha2("rendered", 256).alias("rendered_sha256"))


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""


@register("op11_fill_in_middle", OP11_SQL)
def op11(spark, folder):
    return fim.digest(fim.rewrite(table(spark, folder, "documents")))


OP13_SQL = r"""
WITH p AS (SELECT lang, row_number() OVER () AS pid, piece FROM (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
w AS (SELECT lang, pid, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
      FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (VALUES (1), (2), (3)) AS ks(k) WHERE len(w) >= k) GROUP BY lang, k, phrase),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS t FROM g WHERE k >= 2 AND f >= 10),
cuts AS (SELECT c.lang, c.phrase, c.a, j, CAST(x.f AS BIGINT) AS l, CAST(y.f AS BIGINT) AS r, 1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f) AS s
         FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM c) c
         JOIN g x ON x.lang = c.lang AND x.k = j AND x.phrase = array_to_string(t[1:j], ' ') JOIN g y ON y.lang = c.lang AND y.k = c.k - j AND y.phrase = array_to_string(t[j + 1:c.k], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY s, j) = 1),
long AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, array_to_string(t[1:2], ' ') AS phrase, a AS f FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(t[2:3], ' '), a FROM c WHERE k = 3) GROUP BY lang, phrase),
kept AS (SELECT b.* FROM best b LEFT JOIN long ON b.lang = long.lang AND b.phrase = long.phrase WHERE long.f IS NULL OR 100 * long.f < 50 * b.a),
ranked AS (SELECT kept.*, row_number() OVER (PARTITION BY lang ORDER BY s DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, l, r, n, CAST(s AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


@register("op13_collocations", OP13_SQL)
def op13(spark, folder):
    return collocation.top(collocation.phrases(table(spark, folder, "documents")))


@register("op12_attention_lm")
def op12(spark, folder):
    corpus = lm.prepare(table(spark, folder, "documents"), TOKENIZER)
    return lm.score(corpus, lm.fit(corpus))
