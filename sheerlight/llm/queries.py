"""The registered query of each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .labelled import fold, sample
    from .toxicity import SAMPLE, fit, score

    docs = table(spark, sf_dir, "documents")
    net = fit(sample(docs, table(spark, sf_dir, "labels"), "toxic", fold("doc_id", 4) != 2, SAMPLE))
    return score(docs, net).withColumn("held_out", fold("doc_id", 4) == 2).select("doc_id", "held_out", "score", "predicted")


def op3_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import edit_probe

    return edit_probe(table(spark, sf_dir, "documents"))


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import line_report

    return line_report(table(spark, sf_dir, "documents"))


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hilbert import shard_report

    return shard_report(table(spark, sf_dir, "documents"))


def op8_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .labelled import fold, sample
    from .quality import SAMPLE, fit, score

    docs = table(spark, sf_dir, "documents")
    model = fit(sample(docs, table(spark, sf_dir, "labels"), "quality", fold("doc_id", 3) != 1, SAMPLE))
    return score(docs, model).withColumn("held_out", fold("doc_id", 3) == 1).select("doc_id", "held_out", "score", "predicted")


def op9_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .dac import token_files

    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def weighed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with the quality classifier's score as ``__quality``, learned from the labels that op8 learns from."""
    from .labelled import fold, sample
    from .quality import SAMPLE, fit, with_score

    return with_score(docs, fit(sample(docs, labels, "quality", fold("doc_id", 3) != 1, SAMPLE)), "__quality")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(weighed(docs, table(spark, sf_dir, "labels")), weight="__quality")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_token_counts, op2_toxicity, op3_merkle_fingerprints, op4_fuzzy_lines, op5_benchmark_leaks, op6_ngram_jaccard, op7_hilbert_shards, op8_quality_neighbours, op9_addressable_codes, op10_source_mixing)}

#: Words of a text, A-Z in small letters.
_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
#: All pairs that share a shingle, their links, and the least id that links reach.
_JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (g) WHERE x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.c + y.c - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT doc_id, coalesce(c, 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id, c"""


def _shards_sql() -> str:
    """The curve's cells come from the operator's own table, which a test walks; bins, order, shards, slots and checksums are worked out anew."""
    from .hilbert import BITS, DIMENSIONS, SHARDS, curve

    m = 1 << BITS
    size_bin = " + ".join(f"CASE WHEN size > (SELECT quantile_disc(size, {k / m}) FROM t) THEN 1 ELSE 0 END" for k in range(1, m))
    text_bin = lambda c: f"b_{c} AS (SELECT v, CAST(floor((sum(n) OVER (ORDER BY v) - n / 2) * {m} / sum(n) OVER ()) AS INTEGER) AS bin FROM (SELECT {c} AS v, count(*) AS n FROM t WHERE {c} IS NOT NULL GROUP BY {c}))"
    texts = [d for d in DIMENSIONS if d != "size"]
    cell = "0"
    for d in DIMENSIONS:
        cell = f"({cell}) * {m} + {'size_bin' if d == 'size' else f'coalesce(b_{d}.bin, 0)'}"
    step = "CASE WHEN {0} % 2 = 1 THEN xor({0} // 2, 3988292384) ELSE {0} // 2 END"
    table = "x.v"
    for _ in range(8):
        table = f"(SELECT {step.format('q.v')} AS v FROM (SELECT {table} AS v) q)"
    return f"""WITH k AS (SELECT list(c ORDER BY i) AS c FROM (SELECT x.v AS i, {table} AS c FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS v) x)),
d AS (SELECT doc_id, source, lang, hex(encode(coalesce(text, ''))) AS h FROM documents),
t AS (SELECT doc_id, source, lang, length(h) // 2 + 1 AS size, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, length(h), 2), lambda i: CAST('0x' || substr(h, CAST(i + 1 AS INTEGER), 2) AS BIGINT))), lambda a, b: xor(a // 256, k.c[(xor(a, b) & 255) + 1]))) AS text_crc32 FROM d, k),
{', '.join(text_bin(c) for c in texts)}, z AS (SELECT *, {size_bin} AS size_bin FROM t),
g AS (SELECT doc_id, size, text_crc32, ({curve(BITS, len(DIMENSIONS))})[{cell} + 1] AS hilbert FROM z {' '.join(f'LEFT JOIN b_{c} ON b_{c}.v = z.{c}' for c in texts)}),
o AS (SELECT *, row_number() OVER (ORDER BY hilbert, doc_id NULLS FIRST, text_crc32, size) - 1 AS pos, count(*) OVER () AS n FROM g),
f AS (SELECT *, CAST(pos * {SHARDS} // n AS INTEGER) AS shard FROM o)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY pos) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(hilbert AS INTEGER) AS hilbert FROM f"""


def _merkle_sql() -> str:
    """Leaves by places among their line's words instead of by a pattern; the tree by grouped strings."""
    from .merkle import LEAF_ENDS, LEAF_WORDS, NODE, WORD_CHARS

    gap = "\\x20\\x09-\\x0D"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text, coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), first_value(doc_id) OVER (ORDER BY doc_id DESC)) AS next_id FROM d),
t AS (SELECT doc_id, false AS changed, text FROM o UNION ALL SELECT doc_id, true, substr(text, 1, n - n // 3) || substr(next_text, 1, n // 3) FROM o),
l AS (SELECT doc_id, changed, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t),
w AS (SELECT doc_id, changed, i, unnest(x) AS token, generate_subscripts(x, 1) AS j FROM (SELECT *, CASE WHEN regexp_full_match(line, '[{gap}]+') THEN [line] ELSE regexp_extract_all(line, '^[{gap}]*[^{gap}]{{1,{WORD_CHARS}}}[{gap}]*|[^{gap}]{{1,{WORD_CHARS}}}[{gap}]*') END AS x FROM l)),
e AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(token, '[{LEAF_ENDS}][{gap}]*$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, changed, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM w),
f AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, changed, i, run ORDER BY j) - 1) // {LEAF_WORDS} AS part FROM e),
v AS (SELECT doc_id, changed, i, min(j) AS j, sha256(string_agg(token, '' ORDER BY j)) AS h FROM f GROUP BY doc_id, changed, i, run, part),
p AS (SELECT l.doc_id, l.changed, l.i, sha256(coalesce(string_agg(h, '' ORDER BY j), '')) AS h, ':' || coalesce(string_agg(h[1:{NODE}], '' ORDER BY j), '') AS leaves FROM l LEFT JOIN v ON v.doc_id = l.doc_id AND v.changed = l.changed AND v.i = l.i GROUP BY ALL),
q AS (SELECT *, sum(CASE WHEN i > 1 AND h[1] IN ('0', '1') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, changed ORDER BY i) AS part FROM p),
u AS (SELECT doc_id, changed, part, sha256(string_agg(h, '' ORDER BY i)) AS h, string_agg(h[1:{NODE}] || leaves, '(' ORDER BY i) AS paragraphs FROM q GROUP BY doc_id, changed, part),
z AS (SELECT doc_id, changed, sha256(string_agg(h, '' ORDER BY part)) AS root, string_agg(h[1:{NODE}] || '(' || paragraphs, '|' ORDER BY part) AS tree FROM u GROUP BY doc_id, changed),
s AS (SELECT doc_id, changed, root, root || '|' || tree AS fp FROM z),
g AS (SELECT doc_id, changed, list_distinct(list(h[1:{NODE}])) AS leaves FROM v GROUP BY doc_id, changed),
a AS (SELECT s.*, coalesce(leaves, []) AS leaves FROM s LEFT JOIN g USING (doc_id, changed)),
m AS (SELECT o.doc_id, o.n, o.text, o.next_text, x.fp, y.fp AS fp2, x.leaves AS own, y.leaves AS ed, z.leaves AS nx, x.root = y.root AS same_ed, x.root = z.root AS same_nx, sha256(substr(o.text, 1, o.n - o.n // 3) || substr(o.next_text, 1, o.n // 3)) AS edited FROM o JOIN a x ON x.doc_id = o.doc_id AND NOT x.changed JOIN a y ON y.doc_id = o.doc_id AND y.changed JOIN a z ON z.doc_id = o.next_id AND NOT z.changed)
SELECT doc_id, n AS n_chars, edited AS edited_sha256, fp AS fingerprint, fp2 AS edited_fingerprint, CAST(CASE WHEN same_ed THEN 1 WHEN len(own) + len(ed) = 0 THEN 0 ELSE 2.0::DOUBLE * len(list_intersect(own, ed)) / (len(own) + len(ed)) END AS DOUBLE) AS near_edited, CAST(CASE WHEN same_nx THEN 1 WHEN len(own) + len(nx) = 0 THEN 0 ELSE 2.0::DOUBLE * len(list_intersect(own, nx)) / (len(own) + len(nx)) END AS DOUBLE) AS near_next FROM m"""


ORACLE_SQL: dict[str, str] = {"op3_merkle_fingerprints": _merkle_sql(), "op6_ngram_jaccard": _JACCARD, "op7_hilbert_shards": _shards_sql()}
