"""The queries of this subpackage and their SQL, for __spark_entry__."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.llm import bpe, byte_bpe, codes, exact, jaccard, labelled, packing, quality, ranked, repeats, secrets, toxicity, vectors, warc
from searchloom.llm.tables import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_bpe.encode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), special=bpe.added_tokens(vocabulary("byte_bpe_50k.json")))


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.whole_numbers(table(spark, sf_dir, "embeddings"), 256.0, "embedding")
    return vectors.exact_topk(rows, rows.where("vec_id % 50 = 0"), 5)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each secret found: where it is, the rule, the score and its digest."""
    out = secrets.scan(table(spark, sf_dir, "documents")).select("doc_id", F.explode("findings").alias("f"))
    return out.select("doc_id", F.col("f.start").alias("start_char"), F.col("f.n_chars").alias("n_chars"), F.col("f.rule").alias("rule"), F.col("f.score").alias("score"), F.sha2("f.value", 256).alias("secret_sha256"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vectors.nearest(rows, rows.where("vec_id % 20 = 0"), 20)


def _scored(module, spark: SparkSession, sf_dir: str, modulus: int, held: int) -> DataFrame:
    """Scores of all documents by a model fitted on labels whose key's remainder isn't held."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rest = labelled.remainder("doc_id", modulus)
    out = module.score(docs, module.train(docs, labels, rest != held))
    return out.select("doc_id", (rest == held).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(quality, spark, sf_dir, 5, 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(toxicity, spark, sf_dir, 4, 2)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write(table(spark, sf_dir, "pages"))
    return warc.read_pages(spark, archive)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact.duplicates(table(spark, sf_dir, "documents"), digests=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(ranked.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), 10)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_exact_topk": op1_exact_topk,
    "op2_repeats": op2_repeats,
    "op3_quality": op3_quality,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_secrets": op5_secrets,
    "op6_nearest": op6_nearest,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_jaccard": op9_jaccard,
    "op10_warc": op10_warc,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_ranked_search": op12_ranked_search,
    "op13_vector_codes": op13_vector_codes,
}
ORACLES: dict[str, str] = {
    "op2_repeats": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
             b AS (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 99, 256)) AS o FROM d WHERE len(x) >= 200),
             c AS (SELECT doc_id, o, substr(x, 2 * o + 1, 710) AS y FROM b),
             w AS (SELECT doc_id, o, y, unnest(range(least(256, len(y) // 2 - 99))) AS p FROM c),
             g AS (SELECT doc_id, o + p AS p, substr(y, 2 * p + 1, 200) AS s FROM w),
             f AS (SELECT s, min({'d': doc_id, 'p': p}) AS a FROM g GROUP BY s HAVING count(*) > 1),
             m AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM g JOIN f USING (s) WHERE {'d': doc_id, 'p': p} <> a),
             i AS (SELECT *, sum(CASE WHEN q IS NULL OR p > q + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM m),
             r AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY doc_id, k),
             e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM r),
             o AS (SELECT e.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
                          string_agg(substr(x, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept
                   FROM e JOIN d USING (doc_id) GROUP BY e.doc_id)
        SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(kept, x))) AS kept_sha256
        FROM d LEFT JOIN o USING (doc_id)""",
    "op9_jaccard": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             t AS (SELECT doc_id, n, g FROM s JOIN n USING (doc_id)),
             p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) AS x, any_value(b.n) AS y FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id
                   WHERE least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 90 GROUP BY a.doc_id, b.doc_id),
             l AS (SELECT a, b FROM p WHERE 100 * i >= 90 * (x + y - i) UNION ALL SELECT b, a FROM p WHERE 100 * i >= 90 * (x + y - i)),
             r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = w.doc_id), doc_id)) AS component_id
        FROM w LEFT JOIN n USING (doc_id)""",
    "op1_exact_topk": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                   FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             t AS (SELECT vec_id, unnest(v) AS w, generate_subscripts(v, 1) AS d FROM e),
             s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score
                   FROM t q JOIN t c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL),
             r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
             d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
             m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM m""",
    "op11_exact_dedup": """
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
             r AS (SELECT *, row_number() OVER g AS nth, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
                   FROM d WINDOW g AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST))
        SELECT doc_id, keep_id, group_size, nth = 1 AS kept, text_sha256 FROM r""",
    "op12_ranked_search": """
        WITH t AS (SELECT rowid_ AS d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
                   FROM (SELECT row_number() OVER () AS rowid_, doc_id, text FROM documents)),
             i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
             n AS (SELECT d, count(*) AS n FROM t GROUP BY d),
             c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
             f AS (SELECT d, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY d, term),
             w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM f, c GROUP BY term),
             s AS (SELECT item_id, d, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // words))))) AS BIGINT) AS score
                   FROM f JOIN i USING (term) JOIN w USING (term) JOIN n USING (d), c GROUP BY item_id, d)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10""",
}


def _codes_sql(rounds: int = 2) -> str:
    """The SQL of op13, round by round."""
    ctes = [
        """e AS (SELECT row_number() OVER (ORDER BY vec_id) AS d, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
             WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "p AS (SELECT d, vec_id, label, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM (SELECT *, unnest(range(16)) AS p FROM e))",
        "u AS (SELECT DISTINCT p, x FROM p)",
        "b0 AS (SELECT p, d - 1 AS c, x AS y FROM p WHERE d <= 64)",
    ]
    near = "(SELECT p, x, arg_min(c, (dist, c)) AS c, min(dist) AS dist FROM (SELECT u.p, u.x, b.c, CAST(list_sum(list_transform(list_zip(u.x, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS dist FROM u JOIN {} b USING (p)) GROUP BY p, x)"
    for r in range(rounds):
        ctes += [
            f"a{r} AS {near.format(f'b{r}')}",
            f"""m{r} AS (SELECT p, c, i, CAST(floor(sum(z) / count(*)) AS BIGINT) AS z FROM (SELECT p.p, a.c, unnest(range(len(p.x))) AS i, unnest(p.x) AS z FROM p JOIN a{r} a ON a.p = p.p AND a.x = p.x) GROUP BY p, c, i)""",
            f"b{r + 1} AS (SELECT b.p, b.c, coalesce(n.y, b.y) AS y FROM b{r} b LEFT JOIN (SELECT p, c, list(z ORDER BY i) AS y FROM m{r} GROUP BY p, c) n ON n.p = b.p AND n.c = b.c)",
        ]
    ctes += [
        f"z AS {near.format(f'b{rounds}')}",
        "r AS (SELECT d, any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(lower(printf('%02x', z.c)), '' ORDER BY p.p) AS code, CAST(sum(z.dist) AS BIGINT) AS error FROM p JOIN z ON z.p = p.p AND z.x = p.x GROUP BY d)",
        f"h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, c)) AS codebooks_sha256 FROM b{rounds})",
    ]
    return "WITH " + ",\n    ".join(ctes) + "\n    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, h"


ORACLES["op13_vector_codes"] = _codes_sql()
