"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table; one that is a single small file is dealt over the cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    pieces = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bm25")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import document_evidence, identify, text_model

    docs = _table(spark, sf_dir, "documents")
    return identify(document_evidence(docs), text_model(docs), columns=["doc_id"]).select("doc_id", "lang_id", "posterior", "text_lang", "accepted")


def op2_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify, page_evidence, text_model

    evidence = page_evidence(_table(spark, sf_dir, "pages"))
    judged = identify(evidence, text_model(_table(spark, sf_dir, "documents")), columns=["page_id", "declared", "suffix"])
    return judged.select("page_id", "lang_id", "posterior", "text_lang", "declared", "suffix", "accepted")


def op3_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mpeg import read_media, store_texts

    read = read_media(store_texts(_table(spark, sf_dir, "documents")))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "duration_samples",
        "hertz",
        F.size("offsets").cast("long").alias("n_frames"),
        F.col("offsets").alias("frame_offsets"),
    )


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import Scratch
    from .warc import CHUNKS, read_records, resolve_revisits, with_revisits, write_archives

    scratch = Scratch(spark)
    write_archives(with_revisits(_table(spark, sf_dir, "pages")), f"{scratch.root}/archives")
    records = scratch.keep(read_records(spark.read.schema(CHUNKS).parquet(f"{scratch.root}/archives")), "records")
    scratch.free("archives")
    return resolve_revisits(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_good", "whole")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_text

    return extract_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "path")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = _table(spark, sf_dir, "documents")
    return score(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie

    return prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0).drop("source")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import compress

    return compress(_table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4).drop("label")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_language_id": op2_language_id,
        "op2_language_id_pages": op2_language_id_pages,
        "op3_mpeg_audio": op3_mpeg_audio,
        "op4_ngram_join": op4_ngram_join,
        "op5_warc": op5_warc,
        "op6_line_dedup": op6_line_dedup,
        "op7_html_text": op7_html_text,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_toxicity": op9_toxicity,
        "op10_decontaminate": op10_decontaminate,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_mixing": op12_mixing,
        "op13_vector_codes": op13_vector_codes,
    }


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op4_ngram_join": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reached) AS component_id FROM r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id""",
    "op5_warc": """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages), o AS (SELECT d, n, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY 1, 2)
SELECT page_id, p.n AS payload_bytes, p.d AS payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to, true AS digest_good, true AS whole
FROM p LEFT JOIN o ON p.d = o.d AND p.n = o.n""",
    "op6_line_dedup": f"""WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), l AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM t),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
h AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY 1 HAVING count(DISTINCT doc_id) > 1)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE owner <> doc_id) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE owner IS NULL OR owner = doc_id), '')) AS kept_sha256 FROM k LEFT JOIN h ON k.key = h.key GROUP BY doc_id""",
    "op8_substring_dedup": f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM w), x AS (SELECT doc_id, p, sha256(array_to_string(w[p:p+49], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS first FROM x GROUP BY 1), g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM x JOIN f ON x.h = f.h WHERE first < doc_id),
e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
k AS (SELECT e.doc_id, count(*) AS n, count(g.i) AS gone, string_agg(word, ' ' ORDER BY e.i) FILTER (WHERE g.i IS NULL) AS kept FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id""",
}

ORACLES["op11_prefix_trie"] = f"""WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, len({_WORDS.format("coalesce(text, '')")}) AS w FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({{'k': md5(strlen(role)::VARCHAR || ':' || role || text), 'w': w}} ORDER BY turn NULLS FIRST, md5(strlen(role)::VARCHAR || ':' || role || text)) AS s FROM t GROUP BY 1),
h AS (SELECT c, s, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda y, i: xor(y >> 1, (y & 1) * 3988292384)))) % 4 AS h FROM o),
r AS (SELECT h.c, list_concat(coalesce(b.s, [])[1:h.h], h.s[h.h + 1:]) AS s FROM h LEFT JOIN o b ON b.c = h.c - h.c % 20),
p AS (SELECT c, s, len(s) AS n, unnest(range(0, len(s) + 1)) AS d FROM r),
q AS (SELECT c, n, d, md5(array_to_string(list_transform(s[1:d], lambda x: x.k), '')) AS k, md5(array_to_string(list_transform(s[1:d - 1], lambda x: x.k), '')) AS above, CASE WHEN d > 0 THEN s[d].w ELSE 0 END AS w FROM p),
v AS (SELECT k, d, min(CASE WHEN d > 0 THEN above END) AS above, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256 FROM q GROUP BY 1, 2),
kids AS (SELECT above AS k, count(*) AS n FROM v WHERE above IS NOT NULL GROUP BY 1),
a AS (SELECT v.k, y.k AS y, (y.n_convs - 1) * y.w AS saved FROM v JOIN q ON q.k = v.k AND q.c = v.conv_id JOIN (SELECT q.k AS low, x.k, x.n_convs, x.w, q.c, x.d FROM v x JOIN q ON q.c = x.conv_id AND q.d <= x.d) y ON y.low = v.k),
z AS (SELECT a.k, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE kids.k IS NULL) AS n_leaves FROM a LEFT JOIN kids ON kids.k = a.y GROUP BY 1)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(kids.n, 0) AS n_children, z.n_leaves, z.saved_tokens, v.ends_sha256 FROM v LEFT JOIN v u ON u.k = v.above LEFT JOIN kids ON kids.k = v.k JOIN z ON z.k = v.k"""
ORACLES["op12_mixing"] = f"""WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")}) AS size, substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY 1),
w AS (SELECT *, [5, 2, 1][(r - 1) % 3 + 1] AS w, 2.0::DOUBLE * source_size AS most FROM s),
b AS (SELECT 1.5::DOUBLE * sum(source_size) AS b FROM w),
c AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled, sum(w) OVER (ORDER BY most / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
l AS (SELECT (b - filled) / rest AS level FROM c, b WHERE (b - filled) / rest <= most / w ORDER BY most / w, r LIMIT 1),
t AS (SELECT source, source_size, least(level * w, most) AS target FROM w, l),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
g AS (SELECT source, h, sum(size)::BIGINT AS mass FROM d GROUP BY 1, 2),
u AS (SELECT *, (sum(mass) OVER (PARTITION BY source ORDER BY h))::BIGINT AS upto FROM g)
SELECT d.doc_id, d.size, k.source_size, k.target, (copies * d.size + CASE WHEN upto <= floor(target - copies * source_size) THEN d.size WHEN upto - mass < floor(target - copies * source_size) THEN d.size::HUGEINT * (floor(target - copies * source_size)::BIGINT - (upto - mass)) // mass ELSE 0 END)::BIGINT AS taken
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source JOIN u ON u.source IS NOT DISTINCT FROM d.source AND u.h = d.h"""


def _vector_codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The rounds of the codebooks, written out."""
    steps = [
        f"""k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, q, v[q * len(v) // {parts} + 1:(q + 1) * len(v) // {parts}] AS v FROM k, range({parts}) r(q)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < {entries}),
c0 AS MATERIALIZED (SELECT q, e, v FROM f JOIN p USING (vec_id))"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT p.vec_id, p.q, any_value(p.v) AS v, min({{'d': list_dot_product(p.v, p.v) + list_dot_product(c.v, c.v) - 2 * list_dot_product(p.v, c.v), 'e': c.e}}) AS m FROM p JOIN c{i} c ON c.q = p.q GROUP BY 1, 2)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT q, m.e AS e, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}), n{i} AS (SELECT q, e, j, floor(sum(x) / count(*)) AS x FROM s{i} GROUP BY 1, 2, 3),
c{i + 1} AS MATERIALIZED (SELECT c.q, c.e, coalesce(any_value(n.v), any_value(c.v)) AS v FROM c{i} c LEFT JOIN (SELECT q, e, list(x ORDER BY j) AS v FROM n{i} GROUP BY 1, 2) n ON n.q = c.q AND n.e = c.e GROUP BY 1, 2)""")
    return f"""WITH {", ".join(steps)}, z AS (SELECT vec_id, string_agg(printf('%02x', m.e::BIGINT), '' ORDER BY q) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY 1),
y AS (SELECT z.*, k.label FROM z JOIN k USING (vec_id)),
w AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY q, e, j)) AS s FROM (SELECT q, e, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM c{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM y, w"""


ORACLES["op13_vector_codes"] = _vector_codes_sql()


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express; the others are tested against brute force."""
    return dict(ORACLES)
