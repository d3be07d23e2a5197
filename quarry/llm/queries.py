"""Registered queries of the training-data operators and their DuckDB twins."""
from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import (
    context_mixing,
    decontaminate,
    langid,
    mixing,
    pu_classifier,
    quality_rules,
    resample,
    reshard,
    secret_scan,
    simhash,
    spelling,
    warc,
    wavelet,
)
from quarry.llm.common import fold, text_batches

QueryFn = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _op1_sql() -> str:
    ms = list(quality_rules.MEASURES)
    sketch = " UNION ALL ".join(
        f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM m WHERE NOT base_failed" for m in ms)
    width = lambda v: f"(2 ** greatest(length(ltrim(bin({v}), '0')) - {quality_rules.SUB_BITS + 1}, 0))::BIGINT"
    level = "CASE measure " + " ".join(f"WHEN '{m}' THEN {p}" for m, (p, _, _) in
                                       quality_rules.MEASURES.items() if p) + " END"
    def quart(keys: list[str], mark: str) -> str:
        by = ", ".join([*keys, "measure"])
        return f"""SELECT {by}, max(total) AS rows, min(CASE WHEN 4 * upto >= total THEN bucket END) AS q1,
            min(CASE WHEN 4 * upto >= 3 * total THEN bucket END) AS q3,
            min(CASE WHEN 100 * upto >= {level} * total THEN bucket END) AS q FROM (
            SELECT {by}, bucket, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto,
                   sum(n) OVER (PARTITION BY {by}) AS total
            FROM (SELECT {by}, bucket, count(*) AS n FROM s GROUP BY {by}, bucket)) GROUP BY {by}"""
    fences, tests = [], []
    for m, (percent, count, once) in quality_rules.MEASURES.items():
        upper = "q" if percent else "q3 + 3 * (q3 - q1)"
        fences.append(f"max(CASE WHEN measure = '{m}' THEN {upper} END) AS {m}_max")
        if percent:
            tests.append(f"(({m} // {width(m)}) * {width(m)} <= {m}_max OR {count} <= {once})")
        else:
            tests.append(f"({m} // {width(m)}) * {width(m)} BETWEEN {m}_min AND {m}_max")
            fences.append(f"max(CASE WHEN measure = '{m}' THEN q1 - 3 * (q3 - q1) END) AS {m}_min")
    names = [f.rsplit(" AS ", 1)[1] for f in fences]
    tells = lambda t: f"{t}.rows >= 200 AND ({t}.q IS NOT NULL OR {t}.q3 > {t}.q1)"
    pick = lambda q: f"""CASE WHEN {tells("o")} THEN o.{q} WHEN {tells("l")} THEN l.{q}
        ELSE e.{q} END"""  # noqa: E731
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, '[^ 	-
]+') AS ws FROM d)),
g AS (SELECT doc_id, i, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c FROM w
      WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
      FROM g WHERE c IS NOT NULL) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) x(k)
        GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (
       SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d)
       WHERE regexp_matches(x, '[^ 	-
]') GROUP BY doc_id),
b AS (SELECT d.doc_id, lang, source,
        len(regexp_extract_all(t, '[^ 	-
]+'))::BIGINT AS n_words,
        length(regexp_replace(t, '[ 	-
]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(ln.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        len(string_split(t, chr(10))) AS n_lines
      FROM d LEFT JOIN ln ON ln.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        1000 * n_symbols // greatest(n_words, 1) AS symbols_pm,
        1000 * n_dup_lines // n_lines AS dup_lines_pm,
        1000 * n_repeat_words // greatest(n_words, 1) AS repeats_pm,
        100 * word_chars // greatest(n_words, 1) AS word_len_pc FROM b),
s AS (SELECT lang, source, measure, (v // width) * width AS bucket FROM (SELECT *,
        {width("v")} AS width FROM ({sketch}))),
o AS ({quart(["lang", "source"], "o")}), l AS ({quart(["lang"], "l")}), e AS ({quart([], "e")}),
f AS (SELECT lang, source, {", ".join(fences)} FROM (
      SELECT o.lang, o.source, o.measure, {pick("q1")} AS q1, {pick("q3")} AS q3, {pick("q")} AS q
      FROM o JOIN l ON l.lang IS NOT DISTINCT FROM o.lang AND l.measure = o.measure
      JOIN e ON e.measure = o.measure) GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce({" AND ".join(tests)}, false) AS kept,
  {", ".join(ms)}, {", ".join(names)}
FROM m LEFT JOIN f ON f.lang IS NOT DISTINCT FROM m.lang AND f.source IS NOT DISTINCT FROM m.source"""


@register("op1_quality_rules", _op1_sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@register("op3_pu_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels of folds 1 to 4 are learned."""
    found = pu_classifier.classify(table(spark, sf_dir, "documents"),
                                   table(spark, sf_dir, "labels"), fold("doc_id") != 0)
    return found.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", "predicted")


@register("op4_decontaminate")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, with item and place."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"),
                                    table(spark, sf_dir, "benchmark"))


@register("op5_source_mix", r"""
WITH d AS (SELECT doc_id, source,
             len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS size,
             md5(concat('20:', coalesce(doc_id::VARCHAR, ''))) AS k FROM documents),
s AS (SELECT source, sum(size) AS ssize,
        [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS w
      FROM d GROUP BY source),
o AS (SELECT *, sum(ssize) OVER () - coalesce(sum(3 * ssize) OVER p, 0) AS rest,
        sum(w) OVER () - coalesce(sum(w) OVER p, 0) AS ws
      FROM s WINDOW p AS (ORDER BY 3 * ssize / w, source NULLS LAST
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT source, ssize, w, rest::DOUBLE * w / ws > 3 * ssize AS full_ FROM o),
t AS (SELECT source, ssize, CASE WHEN full_ THEN (3 * ssize)::DOUBLE ELSE
        ((sum(ssize) OVER ()) - coalesce(sum(CASE WHEN full_ THEN 3 * ssize END) OVER (), 0))::DOUBLE
        * w / sum(CASE WHEN NOT full_ THEN w END) OVER () END AS target FROM c),
q AS (SELECT *, CASE WHEN ssize > 0 THEN floor(target / ssize) ELSE 0 END AS base FROM t),
g AS (SELECT d.source, k, sum(size) AS gs, any_value(target - base * ssize) AS extra
      FROM d JOIN q ON q.source IS NOT DISTINCT FROM d.source GROUP BY d.source, k),
h AS (SELECT *, sum(gs) OVER (PARTITION BY source ORDER BY k) AS upto FROM g),
x AS (SELECT source, k, (upto <= extra AND extra > 0) OR (upto - gs <= extra AND extra < upto
        AND 2 * upto - gs <= 2 * extra) AS more FROM h)
SELECT doc_id, size, q.ssize::BIGINT AS source_size, target,
       (size * (base + more::INT))::BIGINT AS taken
FROM d JOIN q ON q.source IS NOT DISTINCT FROM d.source
JOIN x ON x.source IS NOT DISTINCT FROM d.source AND x.k = d.k""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix_report(table(spark, sf_dir, "documents")).drop("draws")


@register("op2_wavelet_tokens")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and checksums of every document, read from its shard."""
    return wavelet.encode_documents(spark, table(spark, sf_dir, "documents"),
                                    public_tokenizers.path("byte_bpe_50k.json"))


@register("op6_context_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model and unigram score of every document; fold 1 is held out."""
    found = context_mixing.score_documents(table(spark, sf_dir, "documents"), fold("doc_id") != 1)
    return found.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "n_tokens", "n_known",
                        "train_tokens", "base_score", "score", "total_bits", "bits_per_byte")


@register("op7_warc_round_trip", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END
    AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM d JOIN f ON f.payload_digest = d.payload_digest""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the archives."""
    return warc.archive_pages(spark, table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op8_simhash_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


@register("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; dictionaries from folds 1 to 4."""
    docs = table(spark, sf_dir, "documents")
    learned = langid.learn_dictionaries(docs.where(fold("doc_id") != 0).select("text", "lang"))
    found = langid.identify(docs, learned)
    return found.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "lang_pred", "score",
                        "narrow", "lang_or_und")


@register("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate secret of the documents with its forest score."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@register("op11_spelling_variants", r"""WITH RECURSIVE
d AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
r AS (SELECT id, w, count(*) AS n FROM (
        SELECT id, unnest(regexp_extract_all(t, '[a-zÀ-ÿ]+')) AS w FROM d) GROUP BY id, w),
h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
        string_split(id || ':' || w, ''), lambda c: CASE WHEN ord(c) < 128
        THEN [256 + ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0]
        ELSE [451::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0, 192 + ord(c), 0, 0, 0, 0, 0, 0, 0, 0] END))),
        lambda c, x: CASE WHEN x >= 256 THEN xor(c, x - 256)
        ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295) AS h FROM r),
c AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2)
        ELSE w END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1),
v AS (SELECT word, n FROM c WHERE length(word) >= 6 AND n >= 5),
k AS (SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b
      FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM v)),
e AS (SELECT x.word, y.word AS near, y.n AS near_n FROM k x JOIN k y
        ON y.i = x.i AND y.a = x.a AND y.b = x.b AND y.word <> x.word
      UNION SELECT x.word, y.word, y.n FROM k x JOIN v y ON y.word = x.a || x.b
      UNION SELECT y.word, x.word, x.n FROM k x JOIN v y ON y.word = x.a || x.b),
f AS (SELECT v.word, v.n, count(near) AS n_near, max(near_n) AS top,
        arg_min(near, (-near_n, near)) AS best FROM v LEFT JOIN e ON e.word = v.word GROUP BY v.word, v.n),
g AS (SELECT word, CASE WHEN top >= 5 * n THEN best END AS form, n, n_near,
        CASE WHEN top >= 5 * n THEN top END AS form_n FROM f),
u AS (SELECT word, word AS root, form AS up FROM g
      UNION ALL SELECT u.word, g.word, g.form FROM u JOIN g ON g.word = u.up)
SELECT g.word, form, root, n, n_near, form_n FROM g JOIN u ON u.word = g.word AND u.up IS NULL""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with the far more frequent word that it is a variant of."""
    return spelling.group_variants(table(spark, sf_dir, "documents"))


@register("op12_importance_resample", r"""WITH a AS (SELECT 's' AS side, doc_id AS id, text FROM documents UNION ALL
  SELECT 't', NULL, text FROM benchmark),
w AS (SELECT side, id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM a),
o AS (SELECT side, row, f, count(*) AS n FROM (SELECT side, row, unnest(list_concat(w,
  list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w) GROUP BY ALL),
f AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
    range(0, length(x) // 2), lambda i: [256 + ('0x' || substr(x, 2 * i + 1, 2))::BIGINT,
    0, 0, 0, 0, 0, 0, 0, 0]))), lambda c, x: CASE WHEN x >= 256 THEN xor(c, x - 256)
    ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295) % 10000 AS bucket
  FROM (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM o))),
c AS (SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0)::BIGINT AS s,
  coalesce(sum(n) FILTER (side = 't'), 0)::BIGINT AS t FROM o JOIN f USING (f) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE /
  ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE))::BIGINT AS gain FROM c),
m AS (SELECT row, sum(n)::BIGINT AS n, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight
  FROM o JOIN f USING (f) JOIN g USING (bucket) WHERE side = 's' GROUP BY row),
x AS (SELECT id, len(w) AS words, coalesce(n, 0) AS n, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(id::VARCHAR, '')),
  1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN m ON m.row = w.row WHERE side = 's'),
r AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, id NULLS LAST) AS r,
  25 * count(*) FILTER (words >= 20) OVER () // 100 AS k FROM x)
SELECT id AS doc_id, n AS n_features, weight, score,
  CASE WHEN words >= 20 AND r <= k THEN r END AS rank FROM r""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document; the benchmark is the target."""
    return resample.resample(table(spark, sf_dir, "documents"),
                             table(spark, sf_dir, "benchmark")).drop("n_words")


#: Shards of the layout that op13 finds, and that it makes of them.
OLD_SHARDS, NEW_SHARDS = 5, 8


@register("op13_flow_reshard")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lie in shards by their text, equal texts together; moved
    into shards of equal bytes and read back from the files."""
    docs = table(spark, sf_dir, "documents")
    text_crc32 = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    old = reshard.write_layout(docs, text_crc32 % OLD_SHARDS, reshard.document_size(F.col("text")),
                               [F.col("doc_id"), text_crc32])
    found = reshard.read_layout(reshard.balance(old, NEW_SHARDS))
    return found.select(
        "doc.doc_id", "size",
        F.crc32(F.coalesce("doc.text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "old_shard")


register("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)


def queries() -> dict[str, QueryFn]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
