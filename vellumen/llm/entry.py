"""The queries of this folder's operators, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumen.llm import cover_tree, embed_dedup, fim, langid, merkle, mixing, packing, sharding, simhash, suffix_dedup, superkmer, warc, wfst


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
    SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.e, d.e)::BIGINT AS score,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, d.e) DESC, d.vec_id) AS rank
    FROM v q, v d WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id)
WHERE rank <= 5
"""


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = superkmer.drop_repeated_windows(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: Unnested by word; a window is the list of 13 words.
OP2_SQL = r"""
WITH words AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
windows AS (
    SELECT doc_id, i, w[i : i + 12] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM words)),
firsts AS (SELECT g, min(doc_id) AS least FROM windows GROUP BY g HAVING count(*) > 1),
hits AS (SELECT doc_id, list(i) AS h FROM windows JOIN firsts USING (g) WHERE least < doc_id GROUP BY doc_id),
spread AS (SELECT doc_id, list_distinct(flatten(list_transform(h, lambda i: generate_series(i, i + 12)))) AS gone FROM hits),
kept AS (
    SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, w, gone FROM words LEFT JOIN spread USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
    sha256(coalesce((SELECT string_agg(w[i], ' ' ORDER BY i) FROM (SELECT unnest(generate_series(1, len(w))) AS i) WHERE gone IS NULL OR NOT list_contains(gone, i)), '')) AS kept_sha256
FROM kept
"""


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cut = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(simhash.fingerprints(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


#: Five hexadecimal digits are four of base 32.
OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, b, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS least FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
    array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31)::BIGINT + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = least THEN NULL ELSE least END AS refers_to
FROM d
"""


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    found = wfst.decode(wfst.encode(table(spark, sf_dir, "documents"), model), model)
    return found.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("decoded_sha256"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.topology(16)
    return sharding.assign(table(spark, sf_dir, "documents"), tree, sharding.grown(tree))


def op7_sql() -> str:
    """The same draws, level by level, as joins with the tree. DuckDB has no CRC-32: its bits are worked out."""
    draw = "-ln((('0x' || substr(md5({level} || '/' || {node} || '/' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / {weight}"
    rows = ", ".join(f"('{s.region}', '{s.rack}', {s.shard}, {s.weight})" for s in sharding.topology(16))
    one = sharding.grown(sharding.topology(16))[-1]
    step = """{name}_r AS (SELECT doc_id, region FROM (SELECT doc_id, region, row_number() OVER (PARTITION BY doc_id ORDER BY d) AS n FROM (
        SELECT doc_id, region, {dr} AS d FROM documents, (SELECT region, sum(w) AS w FROM {tree} GROUP BY region))) WHERE n = 1),
    {name}_k AS (SELECT doc_id, rack FROM (SELECT doc_id, rack, row_number() OVER (PARTITION BY doc_id ORDER BY d) AS n FROM (
        SELECT doc_id, rack, {dk} AS d FROM {name}_r JOIN (SELECT region, rack, sum(w) AS w FROM {tree} GROUP BY region, rack) USING (region))) WHERE n = 1),
    {name}_s AS (SELECT doc_id, shard FROM (SELECT doc_id, shard, row_number() OVER (PARTITION BY doc_id ORDER BY d) AS n FROM (
        SELECT doc_id, shard, {ds} AS d FROM {name}_k JOIN {tree} USING (rack))) WHERE n = 1)"""
    levels = {"dr": draw.format(level="'region'", node="region", weight="w"), "dk": draw.format(level="'rack'", node="rack", weight="w"), "ds": draw.format(level="'shard'", node="shard", weight="w")}
    return f"""
WITH RECURSIVE tree AS (SELECT * FROM (VALUES {rows}) AS t(region, rack, shard, w)),
larger AS (SELECT * FROM tree UNION ALL VALUES ('{one.region}', '{one.rack}', {one.shard}, {one.weight})),
{step.format(name="a", tree="tree", **levels)},
{step.format(name="b", tree="larger", **levels)},
bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
crc_table AS (SELECT b, r FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r FROM range(256) AS t(b))),
crc_list AS (SELECT list(r ORDER BY b) AS l FROM crc_table),
crcs AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, l[1 + (xor(c, b) & 255)])), 4294967295) AS c, len(h) // 2 + 1 AS size FROM bytes, crc_list)
SELECT doc_id, size::BIGINT AS size, c::BIGINT AS text_crc32, 'key' AS law, a_s.shard::INTEGER AS shard,
    (row_number() OVER (PARTITION BY a_s.shard ORDER BY doc_id) - 1)::BIGINT AS slot, b_s.shard::INTEGER AS grown_shard
FROM crcs JOIN a_s USING (doc_id) JOIN b_s USING (doc_id)
"""


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages; a page's doc_id is -1 - page_id."""
    return langid.corpus(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.drop_repeated_bytes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes as pairs of hexadecimal digits.
OP9_SQL = r"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS (SELECT doc_id, h, unnest(generate_series(0, len(h) // 2 - 200)) AS p FROM docs),
strings AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 400)) AS s FROM places),
hits AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY s) AS n FROM strings) WHERE n > 1),
runs AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (
    SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS opens FROM hits)),
spans AS (SELECT doc_id, min(p) AS s, max(p) + 200 AS e FROM runs GROUP BY doc_id, run),
lists AS (SELECT doc_id, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es, sum(e - s) AS gone FROM spans GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(len(ss), 0)::BIGINT AS n_spans,
    sha256(CASE WHEN ss IS NULL THEN unhex(h) ELSE unhex(array_to_string(list_transform(generate_series(1, len(ss) + 1),
        lambda i: substr(h, 2 * (CASE WHEN i = 1 THEN 0 ELSE es[i - 1] END) + 1, 2 * ((CASE WHEN i > len(ss) THEN len(h) // 2 ELSE ss[i] END) - (CASE WHEN i = 1 THEN 0 ELSE es[i - 1] END)))), '')) END) AS kept_sha256
FROM docs LEFT JOIN lists USING (doc_id)
"""


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.98)


OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(embedding, embedding) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
roots AS (SELECT u AS vec_id, min(v) AS component_id FROM reach GROUP BY u),
counts AS (SELECT u AS vec_id, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN roots USING (vec_id) LEFT JOIN counts USING (vec_id)
"""


def op11_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.by_document(mixing.mixed(table(spark, sf_dir, "documents")))


def op11_sql() -> str:
    """The same schedules, integrated and inverted line by line, as CASE expressions."""
    number = lambda x: f"'{x!r}'::DOUBLE"

    def due(schedule: mixing.Schedule) -> str:
        parts = mixing.segments(schedule)
        cases = []
        for i, (done, start, length, weight, slope) in enumerate(parts):
            rest = f"greatest(u - {number(done)}, 0::DOUBLE)"
            root = f"sqrt(greatest({number(weight * weight)} + {number(2.0 * slope)} * {rest}, 0::DOUBLE))"
            time = f"CASE WHEN {rest} = 0 THEN {number(start)} ELSE least({number(start)} + 2::DOUBLE * {rest} / ({number(weight)} + {root}), {number(start + length)}) END"
            cases.append(f"WHEN u < {number(parts[i + 1][0])} THEN {time}" if i + 1 < len(parts) else f"ELSE {time}")
        return "CASE " + " ".join(cases) + " END" if len(cases) > 1 else cases[0].removeprefix("ELSE ")

    dues = " ".join(f"WHEN {j} THEN {due(s)}" for j, s in enumerate(mixing.CURRICULUM))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN source IS NULL THEN '=' ELSE '-' || source END AS source, md5(coalesce(doc_id::VARCHAR, '')) AS draw,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][place % 3 + 1]::DOUBLE AS weight, 2::DOUBLE * source_size AS bound FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(bound) OVER () / 2 - coalesce(sum(bound) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level
    FROM w WINDOW p AS (ORDER BY bound / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
one AS (SELECT arg_min(level, (bound / weight, source)) AS level FROM l WHERE bound > weight * level),
t AS (SELECT source, source_size, place, coalesce(least(bound, weight * one.level), bound) AS target FROM l, one),
o AS (SELECT d.*, source_size, place, target, pass, coalesce(sum(size) OVER (PARTITION BY d.source, pass ORDER BY draw, doc_id NULLS FIRST, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + pass * source_size AS ahead
    FROM d JOIN t USING (source), range(2) AS q(pass)),
k AS (SELECT *, greatest(least(size, floor(target)::BIGINT - ahead), 0)::BIGINT AS taken, ahead::DOUBLE / target AS u FROM o),
g AS (SELECT *, CASE place % {len(mixing.CURRICULUM)} {dues} END AS position FROM k WHERE taken > 0),
b AS (SELECT r, taken, coalesce(sum(taken) OVER (ORDER BY position, source, draw, doc_id NULLS FIRST, size, pass, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM g),
m AS (SELECT r, sum(taken) AS taken, min(start) AS first_start, max(start) AS last_start FROM b GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_start::BIGINT AS first_start, last_start::BIGINT AS last_start FROM d JOIN t USING (source) LEFT JOIN m USING (r)
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fim.rearranged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT *, length(t)::BIGINT AS n, list_transform(range(4), lambda i: ('0x' || substr(s, 8 * i + 1, 8))::BIGINT) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1, n - b) AS x FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs are checked against a copy of the table in which a seventh of the rows have one more in n_chars."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = merkle.manifest(table(spark, sf_dir, "documents"), F.when(chosen, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    digests = found.select("doc_id", *(merkle.hexed(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")), merkle.proof_digest(F.col("path")).alias("proof_sha256"), merkle.hexed(merkle.folded(F.col("changed_leaf"), F.col("path"))).alias("folded_root"))
    return digests.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels as recursion; a leaf walks up with its siblings. DuckDB has no CRC-32: its bits are worked out.
OP13_SQL = """
WITH RECURSIVE crc_list AS (SELECT list(r ORDER BY b) AS l FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r FROM range(256) AS t(b))),
drawn AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(doc_id::VARCHAR)), lambda i: ord(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT)),
    lambda c, b: xor(c >> 8, l[1 + (xor(c, b) & 255)])), 4294967295) % 7 = 0 AS chosen FROM documents, crc_list),
parts AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS k, chosen, list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text, (n_chars + 1)::VARCHAR],
    lambda x: CASE WHEN x IS NULL THEN '-' ELSE strlen(x) || ':' || x END) AS f FROM drawn),
leaves AS (SELECT doc_id, k, leaf, bad, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS n, row_number() OVER () AS r FROM (
    SELECT doc_id, k, sha256(array_to_string(f[1:5], '')) AS leaf, CASE WHEN chosen THEN sha256(f[1] || f[2] || f[3] || f[6] || f[5]) ELSE sha256(array_to_string(f[1:5], '')) END AS bad FROM parts)),
nodes AS (SELECT k, 0 AS lv, i, n, leaf AS h FROM leaves UNION ALL
    SELECT k, lv + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY k, lv + 1, i // 2, (n + 1) // 2),
tops AS (SELECT k, h, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
crown AS (SELECT 0 AS lv, i, n, h FROM tops UNION ALL SELECT lv + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM crown WHERE n > 1 GROUP BY lv + 1, i // 2, (n + 1) // 2),
walk AS (SELECT r, k, 0 AS lv, i, n, bad AS h, '' AS told FROM leaves UNION ALL
    SELECT r, w.k, w.lv + 1, w.i // 2, (w.n + 1) // 2, sha256(CASE WHEN w.i % 2 = 1 THEN s.h || w.h ELSE w.h || coalesce(s.h, '') END), told || coalesce(s.h, '')
    FROM walk w LEFT JOIN nodes s ON s.k = w.k AND s.lv = w.lv AND s.i = xor(w.i, 1) WHERE w.n > 1),
climb AS (SELECT r, w.k, 0 AS lv, t.i, t.n, w.h, told, t.h AS subroot FROM walk w JOIN tops t ON t.k = w.k WHERE w.n = 1 UNION ALL
    SELECT r, w.k, w.lv + 1, w.i // 2, (w.n + 1) // 2, sha256(CASE WHEN w.i % 2 = 1 THEN s.h || w.h ELSE w.h || coalesce(s.h, '') END), told || coalesce(s.h, ''), subroot
    FROM climb w LEFT JOIN crown s ON s.lv = w.lv AND s.i = xor(w.i, 1) WHERE w.n > 1)
SELECT doc_id, leaf, subroot, o.h AS root, sha256(told) AS proof_sha256, c.h AS folded_root, c.h = o.h AS verified FROM leaves JOIN climb c USING (r), crown o WHERE c.n = 1 AND o.n = 1
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_top_k_search": op1_top_k_search,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_simhash_near_dedup": op4_simhash_near_dedup,
        "op5_warc": op5_warc,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_sharding": op7_sharding,
        "op8_language_id": op8_language_id,
        "op9_suffix_array_dedup": op9_suffix_array_dedup,
        "op10_embedding_near_dedup": op10_embedding_near_dedup,
        "op11_curriculum_mix": op11_curriculum_mix,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_top_k_search": OP1_SQL,
        "op2_substring_dedup": OP2_SQL,
        "op5_warc": OP5_SQL,
        "op7_sharding": op7_sql(),
        "op9_suffix_array_dedup": OP9_SQL,
        "op10_embedding_near_dedup": OP10_SQL,
        "op11_curriculum_mix": op11_sql(),
        "op12_fill_in_middle": OP12_SQL,
        "op13_merkle_manifest": OP13_SQL,
    }
