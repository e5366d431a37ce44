"""Queries over the synthetic corpus tables: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.chat_format import answer_pairs
from tidewright.llm.common import table
from tidewright.llm.decontaminate import contaminated
from tidewright.llm.filter_audit import DUPLICATE, filter_audit
from tidewright.llm.hilbert_ann import nearest
from tidewright.llm.katz import lm_scores
from tidewright.llm.language import language_id
from tidewright.llm.ngram_jaccard import ngram_jaccard_groups
from tidewright.llm.packing import pack
from tidewright.llm.pii import pseudonymise
from tidewright.llm.secret_scan import secret_scan
from tidewright.llm.spelling import spelling_groups
from tidewright.llm.tokens import tokenised
from tidewright.llm.toxicity import toxicity

#: The tokenizer file of the queries; its place is a parameter of the operators.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: The key of the queries' surrogates; real data need a secret one.
TEST_KEY = "key of the synthetic tables"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_groups(table(spark, sf_dir, "documents"), k=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", *[F.round(c, 6).alias(c) for c in ("score", "question_overlap", "answer_overlap")])


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), TEST_KEY)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenised(table(spark, sf_dir, "documents"), TOKENIZER, end=2)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_pairs(table(spark, sf_dir, "conversations"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), TOKENIZER, capacity=2048, end=0)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = {
        "A": F.col("n_words") < 100,
        "B": 100 * F.col("n_distinct") < 80 * F.col("n_words"),
        "C": 100 * F.col("n_capitals") > 10 * F.col("n_chars"),
        "D": F.col("n_symbols") > 0,
        "E": DUPLICATE,
    }
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), filters, part="lang", symbols="#$%&*|")


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"), least=5, often=3, ratio=2, spoil=97)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_ngram_jaccard_join,
        op3_benchmark_decontamination,
        op4_secret_scan,
        op5_pii_surrogates,
        op6_nearest_neighbours,
        op7_token_files,
        op8_toxicity,
        op9_preference_format,
        op10_best_fit_packing,
        op11_filter_audit,
        op12_lm_scoring,
        op13_spelling_variants,
    )
}

#: Queries that SQL can express over whole tables; the others are tested against brute force.
ORACLES: dict[str, str] = {
    # All pairs of texts that share a shingle, and a transitive closure.
    "op2_ngram_jaccard_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM w),
        c AS (SELECT s, len(s) AS n, min(doc_id) AS rep FROM s GROUP BY s),
        e AS (SELECT rep, n, unnest(s) AS x FROM c),
        l AS (
            SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
            GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
        links AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT rep AS a, rep AS b FROM c WHERE n > 0 UNION SELECT r.a, links.b FROM r JOIN links ON r.b = links.a),
        g AS (SELECT a AS rep, min(b) AS component_id FROM r GROUP BY a)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(g.component_id, s.doc_id) AS component_id FROM s JOIN c ON c.s = s.s LEFT JOIN g ON g.rep = c.rep AND c.n > 0""",
    # Every passage against every part that shares a word.
    "op3_benchmark_decontamination": """
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
        i AS (
            SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark WHERE text IS NOT NULL),
        k AS (SELECT row_number() OVER () AS item, item_id, w, greatest(1, (len(w) + 63) // 64) AS k FROM i),
        q AS (SELECT item_id, item, w, k, unnest(range(0, k)) AS j FROM k),
        parts AS (
            SELECT row_number() OVER () AS part, item_id, w[j * (len(w) // k) + least(j, len(w) % k) + 1:(j + 1) * (len(w) // k) + least(j + 1, len(w) % k)] AS p FROM q),
        long AS (SELECT * FROM parts WHERE len(p) >= 5),
        tf AS (SELECT part, len(p) AS n, t, count(*) AS tf FROM (SELECT part, p, unnest(p) AS t FROM long) GROUP BY ALL),
        df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
        im AS (
            SELECT part, t, ln(1 + ((SELECT count(*) FROM long) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / (SELECT avg(len(p)) FROM long))) AS v FROM tf JOIN df USING (t)),
        share AS (SELECT part, t, v / sum(v) OVER (PARTITION BY part) AS v FROM im),
        pas AS (SELECT doc_id, w[64 * s + 1:64 * s + 128] AS w, s FROM (SELECT doc_id, w, unnest(range(0, greatest(1, (len(w) + 63) // 64 - 1))) AS s FROM d)),
        has AS (SELECT DISTINCT doc_id, s, t FROM (SELECT doc_id, s, unnest(w) AS t FROM pas)),
        hit AS (SELECT doc_id, s, part, sum(v) AS score FROM has JOIN share USING (t) GROUP BY ALL HAVING sum(v) >= 0.6),
        cand AS (
            SELECT doc_id, item_id, score, p[1:len(p) - greatest(2, len(p) // 3)] AS question, p[len(p) - greatest(2, len(p) // 3) + 1:] AS answer, w
            FROM hit JOIN long USING (part) JOIN pas USING (doc_id, s)),
        sides AS (
            SELECT doc_id, item_id, score, list_transform([question, answer], lambda x: list_avg(list_transform(range(1, len(x) - least(3, len(x)) + 2), lambda a: CASE WHEN list_contains(
                list_transform(range(1, len(w) - least(3, len(x), len(w)) + 2), lambda b: w[b:b + least(3, len(x), len(w)) - 1]), x[a:a + least(3, len(x)) - 1]) THEN 1 ELSE 0 END))) AS o FROM cand),
        found AS (
            SELECT doc_id, item_id, score, o[1] AS qo, o[2] AS ao FROM sides WHERE least(o[1], o[2]) >= 0.6
            UNION ALL SELECT doc_id, item_id, 1, 1, 1 FROM d JOIN parts ON d.w = parts.p WHERE len(p) BETWEEN 1 AND 4)
        SELECT doc_id, item_id, round(b.score, 6) AS score, round(b.qo, 6) AS question_overlap, round(b.ao, 6) AS answer_overlap
        FROM (SELECT doc_id, item_id, max({'score': score, 'qo': qo, 'ao': ao}) AS b FROM found GROUP BY ALL)""",
    # The exact neighbours, which the search gives at any size.
    "op6_nearest_neighbours": """
        WITH v AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        p AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20""",
    "op9_preference_format": """
        WITH plain AS (
            SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        answers AS (
            SELECT conv_id, turn, text FROM plain WHERE role = 'assistant'
            QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, text DESC) = 1),
        swap AS (
            SELECT a.conv_id, a.turn, b.text FROM answers a JOIN answers b ON b.conv_id = xor(a.conv_id, 1)),
        turns AS (
            SELECT conv_id AS pair_id, 0 AS side, turn, role, text FROM plain
            UNION SELECT p.conv_id, 1, p.turn, p.role, p.text FROM plain p JOIN swap s ON p.conv_id = s.conv_id AND (p.turn IS NULL OR p.turn < s.turn)
            UNION SELECT conv_id, 1, turn, 'assistant', text FROM swap),
        sides AS (
            SELECT pair_id, side, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS turns FROM turns GROUP BY ALL),
        pairs AS (
            SELECT pair_id, c.turns AS c, r.turns AS r
            FROM (SELECT * FROM sides WHERE side = 0) c FULL JOIN (SELECT * FROM sides WHERE side = 1) r USING (pair_id)),
        cut AS (
            SELECT pair_id, c, r, CAST(coalesce(
                list_min(list_filter(range(1, greatest(len(c), len(r)) + 1), lambda i: c[i] IS DISTINCT FROM r[i])) - 1,
                CASE WHEN c IS NULL OR r IS NULL THEN 0 ELSE len(c) END) AS INTEGER) AS prompt_turns
            FROM pairs),
        parts AS (
            SELECT pair_id, prompt_turns, CASE WHEN prompt_turns = 0 THEN [] ELSE c[1:prompt_turns] END AS p,
                list_transform(c[prompt_turns + 1:], lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)) AS ct,
                list_transform(r[prompt_turns + 1:], lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)) AS rt,
                c[prompt_turns + 1:] AS c, r[prompt_turns + 1:] AS r
            FROM cut)
        SELECT pair_id, prompt_turns,
            list_aggregate(list_concat([''], list_transform(p, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10))), 'string_agg', '') AS prompt,
            CASE WHEN c IS NOT NULL THEN list_aggregate(list_concat([''], ct), 'string_agg', '') END AS chosen,
            CASE WHEN r IS NOT NULL THEN list_aggregate(list_concat([''], rt), 'string_agg', '') END AS rejected,
            CASE WHEN c IS NOT NULL THEN coalesce(list_aggregate(list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant'), lambda i:
                CAST(CAST(coalesce(list_sum(list_transform(ct[1:i - 1], lambda s: length(s))), 0) AS BIGINT) + 13 + length(c[i].role) AS VARCHAR) || ':' ||
                CAST(CAST(list_sum(list_transform(ct[1:i], lambda s: length(s))) AS BIGINT) - 1 AS VARCHAR)), 'string_agg', ','), '') END AS chosen_mask,
            CASE WHEN r IS NOT NULL THEN coalesce(list_aggregate(list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i].role = 'assistant'), lambda i:
                CAST(CAST(coalesce(list_sum(list_transform(rt[1:i - 1], lambda s: length(s))), 0) AS BIGINT) + 13 + length(r[i].role) AS VARCHAR) || ':' ||
                CAST(CAST(list_sum(list_transform(rt[1:i], lambda s: length(s))) AS BIGINT) - 1 AS VARCHAR)), 'string_agg', ','), '') END AS rejected_mask
        FROM parts""",
    # Every order of the five filters against the counts by mask.
    "op11_filter_audit": """
        WITH d AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        l AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
        m AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::INT
                + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
            FROM d LEFT JOIN l USING (doc_id)),
        c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
        o AS (
            SELECT [a.f, b.f, c.f, d.f, e.f] AS fs, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
            FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f) JOIN f d ON d.f NOT IN (a.f, b.f, c.f) JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
        s AS (SELECT array_to_string(fs, '') AS filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS gone FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
        r AS (
            SELECT part, filter_order, step, own, sum(CASE WHEN mask & (gone | own) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & gone = 0 AND mask & own > 0 THEN n ELSE 0 END) AS removed,
                sum(CASE WHEN mask & gone > 0 AND mask & own > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
                sum(CASE WHEN mask & gone = 0 AND mask & own > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & gone = 0 AND mask & own > 0 THEN toxic ELSE 0 END) AS toxic_lost
            FROM c, s GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
            CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
            CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
        FROM r""",
}
