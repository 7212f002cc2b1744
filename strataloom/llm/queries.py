"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, toxicity
from .common import crc_mod, new_folder, table
from .decontamination import contamination
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives
from .html_extraction import extract_main_text
from .license_scan import TEMPLATES, scan_licenses
from .mixing import mix_sources
from .nearest import nearest
from .ngram_jaccard import jaccard_components
from .sharding import shard_by_bytes
from .spelling import spelling_variants
from .token_counts import token_counts


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, n.text_sha256 FROM n JOIN g USING (text_sha256)
"""


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", "license", F.round("dice", 9).alias("dice"), "licenses", "n_spans")


_BIGRAMS = "list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
OP3_SQL = rf"""
WITH templates(license, template) AS (VALUES {", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in sorted(TEMPLATES.items()))}),
tw AS (SELECT license, string_split(trim(regexp_replace(lower(template), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM templates),
t AS (SELECT license, {_BIGRAMS.format(w="w")} AS own FROM tw),
lines AS (SELECT doc_id, 'line' AS kind, unnest(string_split(coalesce(text, ''), chr(10))) AS body, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS span FROM documents),
blocks AS (SELECT doc_id, 'paragraph' AS kind, unnest(regexp_split_to_array(coalesce(text, ''), '
[ 	-
]*
')) AS body, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '
[ 	-
]*
'), 1) AS span FROM documents),
spans AS (SELECT * FROM lines UNION ALL SELECT * FROM blocks WHERE contains(trim(body, chr(10)), chr(10))),
sw AS (SELECT doc_id, kind, span, string_split(trim(regexp_replace(lower(body), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM spans),
s AS (SELECT doc_id, kind, span, {_BIGRAMS.format(w="w")} AS own FROM sw WHERE len(w) > 1),
sb AS (SELECT doc_id, kind, span, len(own) AS n, unnest(own) AS b FROM s), tb AS (SELECT license, len(own) AS size, unnest(own) AS b FROM t),
m AS (SELECT doc_id, kind, span, license, 2.0::DOUBLE * count(*) / (n + size) AS dice FROM sb JOIN tb USING (b) GROUP BY doc_id, kind, span, license, n, size HAVING 2.0::DOUBLE * count(*) / (n + size) >= 0.8),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, license) AS k FROM m),
g AS (SELECT doc_id, max(license) FILTER (k = 1) AS license, round(max(dice), 9) AS dice, array_to_string(list_sort(list_distinct(list(license))), ',') AS licenses, count(DISTINCT (kind, span)) AS n_spans FROM r GROUP BY doc_id)
SELECT d.doc_id, g.license, g.dice, coalesce(g.licenses, '') AS licenses, coalesce(g.n_spans, 0) AS n_spans FROM documents d LEFT JOIN g USING (doc_id)
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 4) == 2
    model = language_id.learn(docs.where(~held_out))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"), unnamed=True)
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "n_near"
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = rf"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT item_id, len(w) AS n, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(n, 13) AS n, array_to_string(w[s:s + least(n, 13) - 1], ' ') AS g FROM iw),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n),
dg AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM dw),
m AS (SELECT doc_id, s, n, item_id FROM dg JOIN win USING (n, g)),
p AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS at FROM (SELECT DISTINCT doc_id, s, n FROM m)),
h AS (SELECT doc_id, count(*) AS n_hit FROM p GROUP BY doc_id),
k AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',') AS items FROM m GROUP BY doc_id),
it AS (SELECT array_to_string(w, ' ') AS item, w, len(w) AS size, least(len(w), 13) AS length FROM (SELECT DISTINCT w FROM i WHERE len(w) > 0)),
sp AS (SELECT item, size, length, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS place FROM it),
dp AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM d),
bp AS (SELECT * FROM dp WHERE term IN (SELECT term FROM sp)),
sn AS (SELECT term, count(*) AS seen FROM bp GROUP BY term),
ws AS (SELECT item, length, place, term, seen, unnest(range(greatest(place - length + 1, 0), least(place, size - length) + 1)) AS s FROM sp LEFT JOIN sn USING (term)),
rk AS (SELECT *, row_number() OVER (PARTITION BY item, s ORDER BY seen, place) AS rank, count(seen) OVER (PARTITION BY item, s) AS known FROM ws),
ch AS (SELECT item, s, place, term, rank, least(length, 3) AS ranks FROM rk WHERE rank <= 3 AND known = length),
li AS (SELECT doc_id, item, s, rank, ranks, pos - place AS diagonal FROM bp JOIN ch USING (term)),
nr AS (SELECT a.doc_id, a.item, a.s FROM li a JOIN li b ON a.doc_id = b.doc_id AND a.item = b.item AND a.s = b.s AND abs(a.diagonal - b.diagonal) <= 3
       WHERE a.rank = 1 GROUP BY a.doc_id, a.item, a.s, a.diagonal, a.ranks HAVING count(DISTINCT b.rank) = a.ranks),
nn AS (SELECT doc_id, count(DISTINCT (item, s)) AS n_near FROM nr GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN nn USING (doc_id)
"""


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod("doc_id", 3) == 1
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS own FROM w),
n AS (SELECT doc_id, len(own) AS n FROM s), e AS (SELECT doc_id, unnest(own) AS g FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b),
c AS (SELECT a, least(a, min(b)) AS component_id FROM r GROUP BY a)
SELECT n.doc_id, n AS n_shingles, coalesce(component_id, n.doc_id) AS component_id FROM n LEFT JOIN c ON c.a = n.doc_id
"""


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = shard_by_bytes(docs, 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _crc_table() -> list[int]:
    """CRC-32 of the single bytes, by the reflected polynomial 0xEDB88320."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return out


OP9_SQL = rf"""
WITH t AS (SELECT {_crc_table()}::BIGINT[] AS crc), d AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size, md5(coalesce(text, ''))[1:15] AS h FROM documents),
b AS (SELECT *, sum(size) OVER (ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS every, list_transform(list_filter(regexp_split_to_array(regexp_replace(hex(encode(text)), '(..)', '\1,', 'g'), ','), lambda x: x <> ''), lambda x: ('0x' || x)::BIGINT) AS bytes FROM d),
p AS (SELECT *, least(7, ((2 * before + size) * 8) // (2 * every))::INTEGER AS shard FROM b)
SELECT doc_id, size, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]))) AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY h, doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard FROM p, t
"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts(docs, str(public_tokenizers.path("byte_bpe_50k.json")), new_folder(spark, "token-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 100 = 0"), k=10)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95)


OP12_SQL = r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, list_inner_product(a.v, e.v)::BIGINT AS score FROM e a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same),
n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM p JOIN s USING (anchor_id) WHERE k <= 5 AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling_variants(docs, least=6, often=5, ratio=5, every=199)


OP13_SQL = rf"""
WITH RECURSIVE t AS (SELECT {_crc_table()}::BIGINT[] AS crc),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
o AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 6 GROUP BY ALL),
b AS (SELECT run, n, list_transform(list_filter(regexp_split_to_array(regexp_replace(hex(encode(doc_id || ':' || run)), '(..)', '\1,', 'g'), ','), lambda x: x <> ''), lambda x: ('0x' || x)::BIGINT) AS bytes FROM o),
h AS (SELECT run, n, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]))) AS h FROM b, t),
m AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM m WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS (SELECT word, n, spot, left(word, spot - 1) || substr(word, spot + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS spot FROM w)),
e AS (SELECT x.word, y.word AS near, y.n AS near_n FROM d x JOIN d y ON x.spot = y.spot AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.rest = w.word UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.rest = w.word),
k AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM e),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM w LEFT JOIN k ON k.word = w.word AND k = 1),
c AS (SELECT word, word AS last, form AS onward FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON f.word = c.onward)
SELECT f.*, c.last AS root FROM f JOIN c ON c.word = f.word WHERE c.onward IS NULL
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_license_scan": op3_license_scan,
    "op4_language_id": op4_language_id,
    "op5_decontamination": op5_decontamination,
    "op6_source_mix": op6_source_mix,
    "op7_toxicity": op7_toxicity,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_sharding": op9_sharding,
    "op10_token_counts": op10_token_counts,
    "op11_nearest": op11_nearest,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_spelling": op13_spelling,
}
ORACLES: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op3_license_scan": OP3_SQL, "op5_decontamination": OP5_SQL, "op8_ngram_jaccard": OP8_SQL, "op9_sharding": OP9_SQL, "op12_hard_negatives": OP12_SQL, "op13_spelling": OP13_SQL}
