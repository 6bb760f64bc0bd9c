"""One query for each training-data operator, over its whole table, and SQL equivalents where SQL has them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm import bytebpe, classifier, decontam, licences, packing, quality, simhash, suffix, tokenbin, tokencount, urlfilter, vectorcodes, yinyang
from scholium.llm.common import end_with_session, read, shared_path, spread
from scholium.llm.quality import STOP_WORDS


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents by SimHash."""
    found = simhash.simhash_components(_documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and verdict of every document."""
    return quality.quality_rules(_documents(spark, sf_dir))


def _op2_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))
    within = " AND ".join(f"{a} >= CAST({lo!r} AS DOUBLE) * {b} AND {a} <= CAST({hi!r} AS DOUBLE) * {b}" for _, a, b, lo, hi in quality.RULES)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT doc_id, r, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, i, list_slice(w, i, i + 7) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
cov AS (SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS c FROM twice),
rep AS (SELECT r, sum(c) AS c FROM cov GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(ls) AS BIGINT) AS n_lines,
        CAST(len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {within} AS kept FROM b"""


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bin and offset of each piece of each document."""
    return packing.pack(_documents(spark, sf_dir))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and spans that each document loses to earlier ones, and a digest of the rest."""
    found = suffix.remove_earlier(_documents(spark, sf_dir))
    return found.select("rest.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, b, substr(x, 2 * b + 1, 2 * (256 + 49)) AS y FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49, 256)) AS b FROM d)),
w AS (SELECT doc_id, b + j AS i, substr(y, 2 * j + 1, 100) AS s FROM (SELECT doc_id, b, y, unnest(range(0, length(y) // 2 - 49)) AS j FROM c)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE m < doc_id),
new AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true) AS first FROM hit),
run AS (SELECT doc_id, i, sum(first::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM new),
span AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS e FROM run GROUP BY doc_id, k),
gap AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM span),
cut AS (SELECT doc_id, sum(e - a) AS n_removed, count(*) AS n_spans, max(e) AS e, string_agg(substr(x, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS k
        FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k, '') || substr(x, 2 * coalesce(e, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)"""


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they hold."""
    return decontam.contaminated(_documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))


def _op8_sql() -> str:
    def quoted(words):
        return ", ".join(f"'{w}'" for w in sorted(set(words)))

    edges = decontam.EDGES.replace("'", "''")
    return rf"""
WITH x AS (SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT k, id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'), lambda v: trim(v, '{edges}')), lambda v: v <> '') AS w FROM x),
u AS (SELECT k, id, w, list_transform(w, lambda v: CASE WHEN regexp_matches(v, '{decontam.NUMBER}') THEN '<num>'
        WHEN regexp_matches(v, '{decontam.NAME}') AND lower(v) NOT IN ({quoted(STOP_WORDS)}) THEN '<name>' ELSE lower(v) END) AS t FROM w),
p AS (SELECT k, id, generate_subscripts(w, 1) AS i, unnest(w) AS v, unnest(t) AS t FROM u WHERE len(w) >= 5),
q AS (SELECT k, id, i, lower(v) AS v, CASE WHEN t IN ({quoted(decontam.UNITS)}) AND lag(t) OVER (PARTITION BY k, id ORDER BY i) = '<num>' THEN '<unit>' ELSE t END AS t FROM p),
s AS (SELECT k, id, i, t, CASE WHEN t IN ('<num>', '<unit>', '<name>') THEN v END AS slot, replace(v, 'ß', 'ss') AS w FROM q),
win AS (SELECT k, id, i, list(t) OVER f AS h, list(slot) OVER f AS slots, list(w) OVER f AS plain, count(*) OVER f AS n FROM s WINDOW f AS (PARTITION BY k, id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
d AS (SELECT id AS doc_id, i, h, slots AS held FROM win WHERE k = 'd' AND n = 5),
b AS (SELECT id AS item_id, i AS q, h, slots FROM win WHERE k = 'b' AND n = 5 AND len(list_filter(slots, lambda z: z IS NULL)) >= {decontam.LITERALS}),
c AS (SELECT item_id, count(DISTINCT h) AS n_windows FROM b GROUP BY item_id),
m AS (SELECT doc_id, item_id, i - q AS g, h, slots, held FROM d JOIN b USING (h)),
y AS (SELECT DISTINCT doc_id, item_id, g, slots[z] AS a, held[z] AS e FROM (SELECT *, unnest(range(1, 6)) AS z FROM m) WHERE slots[z] IS NOT NULL),
o AS (SELECT doc_id, item_id, g, a, list(e) AS es FROM y GROUP BY doc_id, item_id, g, a HAVING count(*) > 1),
odd AS (SELECT doc_id, item_id, g, list(a) AS vs, flatten(list(es)) AS es FROM o GROUP BY doc_id, item_id, g),
x2 AS (SELECT m.*, vs, es, [z for z in range(1, 6) if slots[z] IS NOT NULL] AS zs FROM m LEFT JOIN odd USING (doc_id, item_id, g)),
ok AS (SELECT doc_id, item_id, h FROM x2 WHERE vs IS NULL OR len([z for z in zs if slots[z] <> held[z]]) = 0
       OR len([z for z in zs if list_contains(vs, slots[z]) OR (slots[z] <> held[z] AND list_contains(es, held[z]))]) = 0),
r AS (SELECT doc_id, item_id, count(DISTINCT h) AS n_matched, any_value(n_windows) AS n_windows FROM ok JOIN c USING (item_id) GROUP BY doc_id, item_id HAVING count(DISTINCT h) >= 0.8 * any_value(n_windows)),
bp AS (SELECT DISTINCT id AS item_id, plain FROM win WHERE k = 'b' AND n = 5), cp AS (SELECT item_id, count(*) AS n_windows FROM bp GROUP BY item_id),
dp AS (SELECT DISTINCT id AS doc_id, plain FROM win WHERE k = 'd' AND n = 5),
rp AS (SELECT doc_id, item_id, count(*) AS n_matched, any_value(n_windows) AS n_windows FROM dp JOIN bp USING (plain) JOIN cp USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_windows))
SELECT *, n_matched / n_windows AS similarity FROM (SELECT * FROM r UNION ALL SELECT * FROM rp ANTI JOIN r USING (doc_id, item_id))"""


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and lines that are a known licence or notice."""
    return licences.licence_scan(_documents(spark, sf_dir))


def _op5_sql() -> str:
    def q(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    known = ", ".join(f"({q(name)}, {q(digest)}, {n}, {q(first)})" for name, digest, n, first in licences.digest_table())
    one = "CASE w " + " ".join(f"WHEN {q(old)} THEN {q(new)}" for old, new in licences.SPELLINGS.items()) + " ELSE w END"
    after = "CASE " + " ".join(f"WHEN v = {q(own)} AND lag(v) OVER (PARTITION BY r ORDER BY i) = {q(before)} THEN {q(new)}" for (before, own), new in licences.AFTER.items()) + " ELSE v END"
    return rf"""
WITH known(license, digest, n, first) AS (VALUES {known}),
l AS (SELECT doc_id, r, unnest(ls) AS x, generate_subscripts(ls, 1) AS line FROM (SELECT doc_id, row_number() OVER () AS r, regexp_split_to_array(coalesce(text, ''), '\r?\n|\r') AS ls FROM documents)),
w0 AS (SELECT doc_id, r, line, unnest(ws) AS w, generate_subscripts(ws, 1) AS k, len(ws) AS m FROM (SELECT *, list_filter(regexp_split_to_array(lower(x), '{licences.OTHER}'), lambda z: z <> '') AS ws FROM l WHERE NOT regexp_matches(x, {q(licences.COPYRIGHT_LINE)}))),
w1 AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY line, k) AS i, {one} AS v FROM w0),
w2 AS (SELECT *, {after} AS word FROM w1),
d AS (SELECT r, any_value(doc_id) AS doc_id, list(word ORDER BY i) AS ws, list(k = m ORDER BY i) AS ends FROM w2 GROUP BY r),
s AS (SELECT r, line, i FROM w2 WHERE k = 1),
f AS (SELECT doc_id, line, i, ws, ends, unnest(list_distinct([array_to_string(ws[i:i], ' '), array_to_string(ws[i:i + 1], ' '), array_to_string(ws[i:i + 2], ' ')])) AS first FROM s JOIN d USING (r))
SELECT doc_id, CAST(line AS INTEGER) AS line_no, CAST(n AS INTEGER) AS n_words, i = 1 AND n = len(ws) AS whole, license FROM f JOIN known USING (first) WHERE ends[i + n - 1] AND sha256(array_to_string(ws[i:i + n - 1], ' ')) = digest"""


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return urlfilter.url_filter(read(spark, sf_dir, "pages"))


def _op6_sql() -> str:
    ordered = sorted(urlfilter.RULES, key=lambda r: -len(r[1] + r[2]))

    def fits(host: str, path: str) -> str:
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"

    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered)
    listed = " OR ".join(f"host = '{x}' OR ends_with(host, '.{x}')" for x in urlfilter.LISTED)
    return rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host,
           regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict FROM u"""


#: Where the public tokenizers' files lie on the driver.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: how byte_bpe_50k cuts a text before merging bytes.
BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BPE_END = 50256


def op7_training_order(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Place, document and digest of every record of the shards that the token sequences are written to."""
    ranks = Path(tokenizers, "byte_bpe_50k.tiktoken").read_bytes()
    path = shared_path(spark, "shards")
    found = tokenbin.sequences(_documents(spark, sf_dir), ranks, BPE_PATTERN, BPE_END)
    tokenbin.write_shards(found, path, spent=found.made_of)
    end_with_session(spark, path)
    return tokenbin.read_shards(spark, path).withColumn("record_md5", F.md5("record")).drop("record")


def op9_token_counts(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Unigram token count and score of every document."""
    return tokencount.token_counts(_documents(spark, sf_dir), tokencount.vocabulary(Path(tokenizers, "piece_bpe_32k.model").read_bytes()))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality score of every document."""
    return classifier.quality_scores(_documents(spark, sf_dir), read(spark, sf_dir, "labels"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Token count of every document and digests of its ids and of what they decode to."""
    ranks = Path(tokenizers, "byte_bpe_50k.tiktoken").read_bytes()
    found = bytebpe.encode(_documents(spark, sf_dir), ranks, BPE_PATTERN, back=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and sums of distances of every vector."""
    return yinyang.clusters(read(spark, sf_dir, "embeddings"))


def _whole_sql(scale: int, where: str) -> str:
    """Kept vectors as lists of whole numbers, numbered by r."""
    return f"""k AS MATERIALIZED (SELECT row_number() OVER () AS r, *, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
   WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND {where})"""


def _far(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


#: The floor of s / n for either sign of s.
_FLOOR = "CAST((s - (s % n + n) % n) // n AS BIGINT)"


def _op12_sql() -> str:
    parts = [f"WITH {_whole_sql(yinyang.SCALE, f'len(embedding) = {yinyang.DIM}')}", "p AS MATERIALIZED (SELECT r, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM k)"]
    parts.append(f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v AS w FROM k ORDER BY c LIMIT {yinyang.K})")
    for t in range(yinyang.ROUNDS + 1):
        parts.append(f"a{t} AS MATERIALIZED (SELECT r, c, d FROM (SELECT r, c, {_far('v', 'w')} AS d FROM k, c{t}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if t < yinyang.ROUNDS:
            parts.append(f"s{t} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{t} JOIN p USING (r) GROUP BY c, i), m{t} AS (SELECT c, list({_FLOOR} ORDER BY i) AS m FROM s{t} GROUP BY c)")
            parts.append(f"c{t + 1} AS MATERIALIZED (SELECT c, coalesce(m, w) AS w FROM c{t} LEFT JOIN m{t} USING (c))")
    t = yinyang.ROUNDS
    return ",\n".join(parts) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256 FROM a{t} JOIN k USING (r) JOIN c{t} USING (c)"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector, and the error over its label."""
    return vectorcodes.vector_codes(read(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _op13_sql() -> str:
    n = vectorcodes.PARTS
    parts = [f"WITH {_whole_sql(vectorcodes.SCALE, f'len(embedding) % {n} = 0 AND len(embedding) > 0')}"]
    parts.append(f"x AS MATERIALIZED (SELECT r, p, v[p * len(v) // {n} + 1:(p + 1) * len(v) // {n}] AS q FROM k, range({n}) AS t(p))")
    parts.append(f"f AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY e LIMIT {vectorcodes.ENTRIES})")
    parts.append("b0 AS MATERIALIZED (SELECT p, e, q AS w FROM f JOIN x USING (r))")
    for t in range(vectorcodes.ROUNDS + 1):
        parts.append(f"a{t} AS MATERIALIZED (SELECT r, p, e, d FROM (SELECT r, p, e, {_far('q', 'w')} AS d FROM x JOIN b{t} USING (p)) QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY d, e) = 1)")
        if t < vectorcodes.ROUNDS:
            parts.append(f"s{t} AS (SELECT p, e, i, sum(y) AS s, count(*) AS n FROM (SELECT p, e, generate_subscripts(q, 1) AS i, unnest(q) AS y FROM a{t} JOIN x USING (r, p)) GROUP BY p, e, i)")
            parts.append(f"m{t} AS (SELECT p, e, list({_FLOOR} ORDER BY i) AS m FROM s{t} GROUP BY p, e), b{t + 1} AS MATERIALIZED (SELECT p, e, coalesce(m, w) AS w FROM b{t} LEFT JOIN m{t} USING (p, e))")
    t = vectorcodes.ROUNDS
    parts.append(f"y AS (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{t} GROUP BY r)")
    parts.append(f"h AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{t})")
    return ",\n".join(parts) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM y JOIN k USING (r), h"""


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_quality_rules": op2_quality_rules,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_suffix_array": op4_suffix_array,
    "op5_licence_scan": op5_licence_scan,
    "op6_url_filter": op6_url_filter,
    "op7_training_order": op7_training_order,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_token_counts": op9_token_counts,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_vector_codes": op13_vector_codes,
}
SQL = {
    "op2_quality_rules": _op2_sql(),
    "op4_suffix_array": OP4_SQL,
    "op5_licence_scan": _op5_sql(),
    "op6_url_filter": _op6_sql(),
    "op8_benchmark_decontamination": _op8_sql(),
    "op12_centroid_clustering": _op12_sql(),
    "op13_vector_codes": _op13_sql(),
}
