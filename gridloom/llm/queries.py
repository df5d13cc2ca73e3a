"""The registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import bpe, ctw, quality
from gridloom.llm.exact_dedup import exact_groups
from gridloom.llm.html_text import extract
from gridloom.llm.licenses import BLOCK, IN_A_ROW, PHRASE_SCORE, PHRASES, STEP, TEMPLATES, THRESHOLD, scan
from gridloom.llm.merkle import FIELDS, document_manifest
from gridloom.llm.mixing import mix
from gridloom.llm.near_dedup import near_classes
from gridloom.llm.registry import ORACLE, QUERIES, op
from gridloom.llm.runs import collapse_runs
from gridloom.llm.topk import top_k
from gridloom.llm.toxicity import held_out_scores
from gridloom.llm.url_rules import HOST_RULES, UNWANTED, judge

__all__ = ["ORACLE", "QUERIES"]

LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@op(
    "op1_exact_topk",
    "embeddings",
    sql="""
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.n <> c.n AND c.vec_id IS NOT NULL AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
)
def op1(embeddings: DataFrame) -> DataFrame:
    """The 20 largest integer inner products of every twentieth vector with all others."""
    return top_k(embeddings, F.col("vec_id") % 20 == 0)


@op(
    "op2_source_mix",
    "documents",
    sql=r"""
WITH d AS (SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
c AS (SELECT *, 2 * source_size / w AS full_at, sum(source_size) OVER () * 1.5 AS total FROM w),
p AS (SELECT *, (total - coalesce(sum(2 * source_size) OVER (ORDER BY full_at, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY full_at, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate,
             row_number() OVER (ORDER BY full_at, i) AS k FROM c),
l AS (SELECT arg_min(rate, k) AS rate FROM p WHERE full_at >= rate),
g AS (SELECT source, source_size, least(2.0 * source_size, w * coalesce((SELECT rate FROM l), 1e300)) AS target FROM p),
f AS (SELECT *, CAST(floor(target + 1e-6) AS BIGINT) AS quota FROM g),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS whole,
             CASE WHEN source_size > 0 THEN quota % source_size ELSE 0 END AS rest FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
b AS (SELECT *, substr(o, 1, 3) AS slice,
             sum(size) OVER (PARTITION BY source ORDER BY o, size ROWS UNBOUNDED PRECEDING) - size AS start,
             sum(size) OVER (PARTITION BY source ORDER BY substr(o, 1, 3)) AS upto FROM r)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(size * (whole + CASE WHEN upto <= rest OR (start * 2 + size <= rest * 2 AND upto - rest > 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM b""",
)
def op2(docs: DataFrame) -> DataFrame:
    """Words that a mix of 150 % of the corpus takes from every document, by source weights."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@op("op3_ctw_score", "documents")
def op3(docs: DataFrame) -> DataFrame:
    """Context-tree weighting score and word base of every document."""
    return ctw.score(docs)


def _license_sql() -> str:
    words = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    stands = lambda p: " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split()))
    hits = " || ".join(f"list_transform(list_filter(range(len(w)), lambda i: {stands(p)}), lambda i: struct_pack(s := i, l := '{label}'))" for p, label in PHRASES.items())
    sets = ", ".join(f"('{label}', {sorted(set(t.split()))}, {sorted(set(m.split()))}::VARCHAR[], {sorted(set(n.split()))}::VARCHAR[], '{IN_A_ROW.get(label, '')}')" for label, t, m, n in TEMPLATES)
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, {LOWER_SQL} AS low FROM documents),
w AS (SELECT r, doc_id, low, {words.format('low')} AS w FROM t),
h AS (SELECT *, {hits} AS hits FROM w),
k(label, need, must, never, said) AS (VALUES {sets}),
b AS (SELECT r, list_distinct(w[i * {STEP} + 1 : i * {STEP} + {BLOCK}]) AS block, ' ' || array_to_string(w[i * {STEP} + 1 : i * {STEP} + {BLOCK}], ' ') || ' ' AS speech FROM w, unnest(range(0, CAST(len(w) // {STEP} AS BIGINT) + 1)) u(i)),
m AS (SELECT r, label, len(list_intersect(block, need)) AS n, len(need) AS of FROM b, k
      WHERE 100 * len(list_intersect(block, need)) >= {THRESHOLD} * len(need) AND len(list_intersect(block, must)) = len(must) AND len(list_intersect(block, never)) = 0 AND (said = '' OR contains(speech, ' ' || said || ' '))),
g AS (SELECT r, list(label) AS labels, max(n / of) AS best FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(hits) AS BIGINT) AS n_base,
       CAST(list_min(list_transform(hits, lambda x: x.s)) AS BIGINT) AS first_word, CAST(list_max(list_transform(hits, lambda x: x.s)) AS BIGINT) AS last_word,
       array_to_string(list_sort(list_distinct(list_transform(hits, lambda x: x.l))), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_transform(hits, lambda x: x.l) || coalesce(labels, []))), ',') AS labels,
       greatest(coalesce(best, 0.0)::DOUBLE, CASE WHEN len(hits) > 0 THEN {PHRASE_SCORE}::DOUBLE ELSE 0.0::DOUBLE END) AS score
FROM h LEFT JOIN g ON h.r = g.r"""


@op("op4_license_scan", "documents", sql=_license_sql())
def op4(docs: DataFrame) -> DataFrame:
    """Places of license phrases and labels of notice templates in every document."""
    return scan(docs).drop("matches")


@op("op5_main_text", "pages")
def op5(pages: DataFrame) -> DataFrame:
    """Main text of every page."""
    return extract(pages)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer file on the driver; its text is broadcast."""
    import public_tokenizers

    return public_tokenizers.path(name)


@op("op6_bpe_codec", "documents")
def op6(docs: DataFrame) -> DataFrame:
    """Token ids of every text and the text they decode to, as digests."""
    return bpe.digests(docs, tokenizer_path())


@op("op7_near_dedup", "documents")
def op7(docs: DataFrame) -> DataFrame:
    """Classes and components of documents with 75 % of their five-word shingles in common."""
    return near_classes(docs).select("doc_id", "n_shingles", "component_id", "kept", "class_size")


@op(
    "op8_exact_dedup",
    "documents",
    sql=f"""
WITH t AS (SELECT doc_id, sha256({LOWER_SQL}) AS s FROM documents),
g AS (SELECT s, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY s)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, t.s AS text_sha256
FROM t JOIN g ON t.s = g.s""",
)
def op8(docs: DataFrame) -> DataFrame:
    """Groups of equal texts; the largest id stays."""
    return exact_groups(docs)


def _url_sql() -> str:
    rules = ", ".join(f"('{t}', '{t.split('/', 1)[0]}', '/{t.split('/', 1)[1]}', '{v}')" for t, v in HOST_RULES)
    words = "|".join(w for words in UNWANTED.values() for w in words.split())
    return f"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rule, rhost, rpath, verdict) AS (VALUES {rules}),
m AS (
  SELECT p.*, (SELECT max_by(struct_pack(rule := rule, verdict := verdict), length(rule)) FROM r
               WHERE (p.host = rhost OR p.host LIKE '%.' || rhost) AND starts_with(p.path, rpath)) AS best
  FROM p)
SELECT page_id, host, path, best.rule AS rule,
       CASE WHEN best IS NOT NULL THEN best.verdict
            WHEN regexp_matches(host || path, '(^|[^0-9A-Za-z])({words})([^0-9A-Za-z]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM m"""


@op("op9_url_rules", "pages", sql=_url_sql())
def op9(pages: DataFrame) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


@op("op10_toxicity", "documents", "labels")
def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Toxicity score of every document, learnt without the held-out fold."""
    return held_out_scores(docs, labels)


@op("op11_quality", "documents", "labels")
def op11(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality score of every document, learnt without the held-out fold."""
    return quality.held_out_scores(docs, labels)


@op("op12_periodic_runs", "documents")
def op12(docs: DataFrame) -> DataFrame:
    """Runs of periodic words of every document and the text with each run cut to its first period."""
    return collapse_runs(docs)


#: crc32 of the id as text, computed bit by bit.
CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ord(x)::UBIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)))"""


def _merkle_sql() -> str:
    part = lambda c, s: f"coalesce(strlen(CAST({s} AS VARCHAR)) || ':' || CAST({s} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(part(c, text if c == "text" else c) for c in FIELDS) + ")"
    sides = """string_agg(h, '') OVER (PARTITION BY {g}, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
               string_agg(h, '') OVER (PARTITION BY {g}, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r"""
    return f"""
WITH RECURSIVE
d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {CRC_SQL} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} END AS tampered FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
t(lvl, source, pos, n, h) AS (
  SELECT 0, source, pos, n, leaf FROM o
  UNION ALL SELECT lvl + 1, source, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lvl, source, pos // 3, n),
s AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u(lvl, pos, n, h) AS (
  SELECT 0, pos, n, h FROM s
  UNION ALL SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lvl, pos // 3, n),
ts AS (SELECT *, {sides.format(g="lvl, source")} FROM t WHERE n > 1),
us AS (SELECT *, {sides.format(g="lvl")} FROM u WHERE n > 1),
up AS (SELECT s.source, list(struct_pack(l := coalesce(us.l, ''), r := coalesce(us.r, ''), h := '') ORDER BY us.lvl) AS steps FROM s JOIN us ON us.pos = s.pos // CAST(3 ** us.lvl AS BIGINT) GROUP BY s.source),
lo AS (SELECT o.source, o.pos, list(struct_pack(l := coalesce(ts.l, ''), r := coalesce(ts.r, ''), h := '') ORDER BY ts.lvl) AS steps
       FROM o JOIN ts ON ts.source IS NOT DISTINCT FROM o.source AND ts.pos = o.pos // CAST(3 ** ts.lvl AS BIGINT) GROUP BY o.source, o.pos),
j AS (SELECT o.*, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, coalesce(lo.steps, []) || coalesce(up.steps, []) AS steps
      FROM o JOIN s ON s.source IS NOT DISTINCT FROM o.source LEFT JOIN up ON up.source IS NOT DISTINCT FROM o.source
      LEFT JOIN lo ON lo.source IS NOT DISTINCT FROM o.source AND lo.pos = o.pos),
f AS (SELECT *, list_reduce(list_prepend(struct_pack(l := '', r := '', h := coalesce(tampered, leaf)), steps),
                            lambda a, b: struct_pack(l := '', r := '', h := sha256(b.l || a.h || b.r))).h AS folded_root FROM j)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda x: x.l || x.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM f"""


@op("op13_merkle_manifest", "documents", sql=_merkle_sql())
def op13(docs: DataFrame) -> DataFrame:
    """Leaf, roots, proof and the check of a tampered text of every document."""
    return document_manifest(docs)
