"""Search, owners and reuse over the chunks and symbols of all projects."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import paths as P
from orrery.functions import text as X
from orrery.functions.vectors import embed_rows, fnv1a
from orrery.operators import relations as R
from orrery.operators import retrieval as S
from orrery.plans.relations import ORACLE as RELATIONS
from orrery.session import table
from orrery.sources import tables as T
from orrery.sources.tables import with_

QUERY = "refresh harbor ledger session guard"
REUSE_QUERY = "rate limit token bucket"
_TEXT = ("file_path", "symbol_name", "content")
BM25_TERMS = ["bucket", "generation", "tracer"]


def x01_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Distinct tokens of every document."""
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("tokens"), F.array_min("t").alias("first_token"))


def x02_identifier_parts(spark: SparkSession, d: str) -> DataFrame:
    s = T.symbols(spark, d).where("kind <> 'file'").select(F.explode(X.split_identifier(F.col("name"))).alias("part"))
    return s.groupBy("part").agg(F.count(F.lit(1)).alias("symbols"))


def x17_word_hashes(spark: SparkSession, d: str) -> DataFrame:
    w = T.symbols(spark, d).where("kind <> 'file'").select(F.explode(X.split_identifier(F.col("name"))).alias("word")).distinct()
    return w.select("word", fnv1a(F.col("word")).alias("hash"))


def x17_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Hashed embeddings of the chunks' contents, as non-zero entries."""
    e = embed_rows(T.chunks(spark, d, "content"), "id", F.col("content"))
    return e.select("id", "slot", F.round("weight", 9).alias("weight"))


def x23_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Bodies with names and literals blotted out, by how many chunks share them."""
    c = T.chunks(spark, d, "content").select("id", normalized_body(F.col("content")).alias("body"))
    return c.groupBy(F.substring(F.sha2("body", 256), 1, 32).alias("fingerprint")).agg(F.count(F.lit(1)).alias("chunks"), F.min("id").alias("first_id"))


def normalized_body(content):
    named = F.regexp_replace(content, r"[A-Za-z_$][A-Za-z0-9_$]*", "Identifier")
    return F.trim(F.regexp_replace(F.regexp_replace(named, r"""\d+(?:\.\d+)?|'[^'\n]*'|"[^"\n]*\"""", "Literal"), r"\s+", " "))


def s14_bm25(spark: SparkSession, d: str) -> DataFrame:
    b = S.bm25(table(spark, d, "documents").where("text IS NOT NULL"), "doc_id", F.col("text"), BM25_TERMS, 50)
    return b.select("doc_id", "dl", F.round("score", 6).alias("score"))


def s14_postings(spark: SparkSession, d: str) -> DataFrame:
    """The same ranks from a full-text index: built, then read by the buckets of the terms."""
    import uuid

    from orrery.session import ensure_checkpoint_dir
    from orrery.sources import postings

    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/postings-{uuid.uuid4().hex}"
    postings.build(table(spark, d, "documents").select("doc_id", "text"), "doc_id", F.col("text"), root)
    return postings.search(spark, root, BM25_TERMS, 50).select(F.col("key").alias("doc_id"), "dl", F.round("score", 6).alias("score"))


def x08_ranked_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Keyword search over the chunks with the rank of a full-text search of the same chunks added to each score."""
    c = T.chunks(spark, d, *_TEXT)
    ranked = S.bm25(c, "id", F.concat_ws("\n", *_TEXT), X.py_words(QUERY), None).select("id", F.col("score").alias("rank_score"))
    k = S.keyword_hits(c, X.Profile(QUERY, X.py_tokens(QUERY)), 40, stems=False, ranked=ranked)
    return k.select("id", "file_path", F.round("score", 6).alias("score"))


def x06_keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    k = S.keyword_hits(T.chunks(spark, d, *_TEXT), X.Profile(QUERY, X.py_tokens(QUERY)), 40, stems=False)
    return k.select("id", "file_path", F.round("score", 6).alias("score"))


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    v = T.chunks(spark, d, "embedding").where("size(embedding) = 64 AND exists(embedding, x -> x <> 0)")
    row = v.agg(F.min_by("embedding", "id").alias("e")).first()
    return list(row["e"]) if row and row["e"] else [0.0] * 64


def s15_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The chunks most similar to the first one, exactly."""
    v = S.vector_hits(T.chunks(spark, d, "file_path", "embedding"), _query_vector(spark, d), 40)
    return v.select("id", "file_path", F.round("score", 6).alias("score"))


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return S.fuse(("keyword", S.keyword_hits(T.chunks(spark, d, *_TEXT), X.Profile(QUERY, X.py_tokens(QUERY)), 40, stems=False)), ("semantic", S.vector_hits(T.chunks(spark, d, "file_path", "embedding"), _query_vector(spark, d), 40)))


def n01_rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("id", "file_path", "source", F.round("score", 6).alias("score"))


def search_code(spark: SparkSession, d: str) -> DataFrame:
    """Fused keyword and vector search with mode boosts, the 20 best."""
    hits = S.boosted(_fused(spark, d), T.chunks(spark, d, *_TEXT), QUERY, X.resolve_mode(QUERY), 20)
    return hits.select("id", "file_path", "source", F.round("score", 6).alias("score"))


def q03_search_expanded(spark: SparkSession, d: str) -> DataFrame:
    """Keyword search with stems and the names of symbols that the query spells out."""
    profile = S.expanded_names(T.symbols(spark, d), QUERY)
    return S.keyword_hits(T.chunks(spark, d, *_TEXT), profile, 40).select("id", "file_path", F.round("score", 6).alias("score"))


def _symbol_matches(spark: SparkSession, d: str, query: str) -> DataFrame:
    profile = X.Profile(query, X.py_tokens(query))
    s = T.symbols(spark, d).where("kind <> 'file'")
    cov = S.with_stems(s, "id", F.col("name")).withColumn("coverage", X.symbol_coverage(F.col("parts"), F.col("stems"), profile)).select("id", "coverage")
    s = s.join(cov, "id", "left").withColumn("text", X.searchable(F.col("name"), F.col("file_path"), F.col("signature")))
    return s.withColumn("score", X.symbol_score(F.col("text"), F.col("coverage"), profile)).where("score IS NOT NULL")


def a03_owners(spark: SparkSession, d: str) -> DataFrame:
    """Files that own the query's topic, the 20 best."""
    c = T.chunks(spark, d, *_TEXT)
    hits = S.keyword_hits(c, X.Profile(QUERY, X.py_tokens(QUERY)), 50, stems=False)
    low = c.select("id", F.lower(F.concat_ws("\n", "file_path", "symbol_name", "content")).alias("text"))
    m = _symbol_matches(spark, d, QUERY).select("id", "file_path", "name", "score", F.lower(F.concat_ws("\n", "file_path", "name", "signature")).alias("text"))
    o = S.owners(hits.join(low, "id"), m, QUERY)
    return o.orderBy(F.desc("score"), "file_path").limit(20).select("file_path", F.round("score", 6).alias("score"), "exact", "names")


def _reuse(spark: SparkSession, d: str) -> DataFrame:
    """Reuse candidates by similarity of names, structure and use."""
    terms = list(dict.fromkeys([*X.py_tokens(REUSE_QUERY), *EXPANSIONS["limit"]]))
    s = T.symbols(spark, d).where("kind NOT IN ('file', 'unknown')")
    hay = F.lower(F.concat_ws(" ", "name", F.array_join(X.split_identifier(F.col("name")), " "), "file_path", F.coalesce("signature", F.lit(""))))
    own = F.lit(0.0)
    for t in terms:
        own = own + F.when(F.contains(hay, F.lit(t)), min(1.2, len(t) / 5)).otherwise(0.0)
    drafts = s.withColumn("score", own).where("score > 0").select("id", "file_path", "name", "kind", F.coalesce("exported", F.lit(False)).alias("exported"), F.col("score"))
    st = table(spark, d, "symbol_structures").select("symbol_id", "body_fingerprint", "signature_tokens", "imports", "callees", "generation")
    sig = R.duplicate_signals(T.latest(st, ["symbol_id"], "generation", ["body_fingerprint", "signature_tokens", "imports", "callees"]))
    from orrery.plans.relations import a13_callers_and_tests

    return S.reuse_scores(drafts, sig, a13_callers_and_tests(spark, d))


#: Terms that a topic brings with it (fixed values).
EXPANSIONS = {
    "limit": ["rate", "limit", "limiter", "throttle", "throttlerequest", "token", "bucket", "tokenbucket"],
    "payment": ["payment", "billing", "checkout", "charge", "invoice"],
    "auth": ["auth", "login", "session", "user"],
}


def q11_reuse_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _reuse(spark, d).orderBy(F.desc("score"), "file_path", "id").limit(50)


def a16_reuse_decision(spark: SparkSession, d: str) -> DataFrame:
    return S.reuse_decision(_reuse(spark, d).orderBy(F.desc("score"), "file_path", "id").limit(8))


def _engine(spark: SparkSession, d: str):
    from orrery.api import Engine

    return Engine(spark, d)


def x06_keyword_search(spark: SparkSession, d: str) -> DataFrame:
    """Keyword search with stems and expanded names over files that aren't stale, which x06_keyword_topk leaves out."""
    e = _engine(spark, d)
    return e.keyword(QUERY, 40).select("id", "file_path", F.round("score", 6).alias("score"))


def n01_search_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Whole keyword and vector lists of 40, fused."""
    return _engine(spark, d).fused(QUERY).select("id", "file_path", "source", F.round("score", 6).alias("score"))


def q03_search_code(spark: SparkSession, d: str) -> DataFrame:
    """Engine.search_code: stems, expanded names, stale files left out, the 20 best."""
    return _engine(spark, d).search_code(QUERY).select("id", "file_path", "source", F.round("score", 6).alias("score"))


def q10_find_owner(spark: SparkSession, d: str) -> DataFrame:
    """Engine.find_owner: stems, expanded names, stale files left out, the 20 best."""
    return _engine(spark, d).find_owner(QUERY, k=20).select("file_path", F.round("score", 6).alias("score"), "exact", "names")


def _whole_reuse(spark: SparkSession, d: str) -> DataFrame:
    st = table(spark, d, "symbol_structures").select("symbol_id", "body_fingerprint", "signature_tokens", "imports", "callees", "generation")
    st = T.latest(st, ["symbol_id"], "generation", ["body_fingerprint", "signature_tokens", "imports", "callees"])
    return _engine(spark, d).find_reuse_candidates(REUSE_QUERY, st).orderBy(F.desc("score"), "file_path", "id")


def q11_find_reuse_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Reuse candidates with drafts of search hits, owners and structural duplicates too, which q11_reuse_candidates leaves out."""
    return _whole_reuse(spark, d).limit(50)


def a16_find_reuse_decision(spark: SparkSession, d: str) -> DataFrame:
    """The decision over the 8 best of q11_find_reuse_candidates."""
    return S.reuse_decision(_whole_reuse(spark, d).limit(8))


QUERIES = {k: v for k, v in list(globals().items()) if re.match(r"[xsnaq]\d\d_|search_code$", k)}


def _split(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda p: p <> '')"


def _search_text(*cols: str) -> str:
    raw = "concat_ws(chr(10), " + ", ".join(f"nullif({c}, '')" for c in cols) + ")"
    return f"lower({raw}) || chr(10) || array_to_string({_split(raw)}, ' ')"


def _count_terms(text: str, terms: list[str]) -> str:
    one = lambda t: "(" + " OR ".join(f"regexp_matches({text}, '{X.term_pattern(v)}')" for v in X.variants([t])) + ")::INT"
    return " + ".join(one(t) for t in terms)


_TERMS = X.py_tokens(QUERY)
_KW = f"kt AS (SELECT id, file_path, symbol_name, content, {_search_text('file_path', 'symbol_name', 'content')} AS t FROM chk), kw AS (SELECT id, file_path, n / {len(_TERMS)} AS score FROM (SELECT id, file_path, {_count_terms('t', _TERMS)} AS n FROM kt) WHERE n > 0 ORDER BY score DESC, file_path, id LIMIT 40)"
_VEC = "vq AS (SELECT arg_min(embedding, id)::DOUBLE[64] AS q FROM vec WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0), vs AS (SELECT id, file_path, round(list_cosine_similarity(embedding::DOUBLE[], q[1:len(embedding)]::DOUBLE[]), 9) AS score FROM vec, vq WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0), vt AS (SELECT * FROM vs WHERE score > 0 ORDER BY score DESC, file_path, id LIMIT 40)"
_FUSE = "fu AS (SELECT id, file_path, CASE WHEN count(*) > 1 THEN 'graph' ELSE min(source) END AS source, sum(60.0::DOUBLE / (60 + r)) AS score FROM (SELECT id, file_path, 'keyword' AS source, row_number() OVER (ORDER BY score DESC, file_path, id) AS r FROM kw UNION ALL SELECT id, file_path, 'semantic', row_number() OVER (ORDER BY score DESC, file_path, id) FROM vt) GROUP BY id, file_path)"
_EVID = f"CASE WHEN regexp_matches(lower(file_path), '{P._TEST_PATH}') THEN 'test' WHEN regexp_matches(lower(file_path), '{P._FIXTURE_PATH}') THEN 'fixture' WHEN regexp_matches(lower(file_path), '{P._DOCS_PATH}') THEN 'docs' ELSE 'implementation' END"
_EXPLAIN = " OR ".join(f"contains(text, '{w}')" for w in X.MODE_BOOSTS["explain"][1])
_OWN_TERMS = " + ".join(["0.0"] + [f"CASE WHEN contains(hay, '{t}') THEN {min(1.2, len(t) / 5)} ELSE 0.0 END" for t in dict.fromkeys([*X.py_tokens(REUSE_QUERY), *EXPANSIONS["limit"]])])
_BM = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(BM25_TERMS))
_BMS = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(BM25_TERMS)))

_WORDS = X.py_words(QUERY)
_RANKED = (
    f"kt AS (SELECT id, file_path, symbol_name, content, {_search_text('file_path', 'symbol_name', 'content')} AS t FROM chk), "
    + "bw AS (SELECT id, list_filter(regexp_split_to_array(lower(concat_ws(chr(10), file_path, symbol_name, content)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM chk), "
    + "bt AS (SELECT id, len(w)::INT AS dl, " + ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(_WORDS)) + " FROM bw), "
    + "bc AS (SELECT count(*) AS n, avg(dl) AS avgdl, " + ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(_WORDS))) + " FROM bt), "
    + "bs AS (SELECT id, " + " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(_WORDS))) + " AS bm FROM bt, bc)"
)

ORACLE = {
    "x01_tokens": rf"""WITH p AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_./:-]+'), lambda x: x <> '') AS ps FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, list_distinct(flatten(list_transform(ps, lambda q: list_concat([lower(q)], CASE WHEN NOT regexp_matches(q, '[._/:-]') AND regexp_matches(q, '[a-z0-9][A-Z]|[A-Z]{{2,}}[a-z]') THEN {_split('q')} ELSE [] END)))) AS ts FROM p)
SELECT doc_id, len(ts) AS tokens, list_min(ts) AS first_token FROM t""",
    "x02_identifier_parts": with_("sym") + f" SELECT part, count(*) AS symbols FROM (SELECT unnest({_split('name')}) AS part FROM sym WHERE kind <> 'file') GROUP BY 1",
    "x17_word_hashes": with_("sym") + f" SELECT word, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(word, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS hash FROM (SELECT DISTINCT unnest({_split('name')}) AS word FROM sym WHERE kind <> 'file')",
    "x17_embedding": with_("chk") + """, w AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(content), '[^a-z0-9_]+'), lambda x: x <> '')) AS word FROM chk),
s AS (SELECT id, (list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(word, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) % 64)::INT AS slot, count(*) AS n FROM w GROUP BY ALL)
SELECT id, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 9) AS weight FROM s""",
    "x23_fingerprints": with_("chk") + r""" SELECT substr(sha256(trim(regexp_replace(regexp_replace(regexp_replace(content, '[A-Za-z_$][A-Za-z0-9_$]*', 'Identifier', 'g'), '\d+(?:\.\d+)?|''[^''\n]*''|"[^"\n]*"', 'Literal', 'g'), '\s+', ' ', 'g'))), 1, 32) AS fingerprint, count(*) AS chunks, min(id) AS first_id FROM chk GROUP BY 1""",
    "s14_bm25": rf"""WITH b AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, len(w)::INT AS dl, {_BM} FROM b),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(BM25_TERMS)))} FROM t)
SELECT doc_id, dl, round({_BMS}, 6) AS score FROM t, s WHERE {" OR ".join(f"tf{i} > 0" for i in range(len(BM25_TERMS)))} ORDER BY {_BMS} DESC, doc_id LIMIT 50""",
    "x08_ranked_keywords": with_("chk") + f", {_RANKED} SELECT id, file_path, round(score, 6) AS score FROM (SELECT id, file_path, n / {len(_TERMS)} + least(0.25, ln(1 + coalesce(bm, 0))) AS score FROM (SELECT k.id, k.file_path, {_count_terms('t', _TERMS)} AS n, b.bm FROM kt k LEFT JOIN bs b USING (id)) WHERE n > 0) ORDER BY score DESC, file_path, id LIMIT 40",
    "x06_keyword_topk": with_("chk") + f", {_KW} SELECT id, file_path, round(score, 6) AS score FROM kw",
    "s15_vector_topk": with_("vec") + f", {_VEC} SELECT id, file_path, round(score, 6) AS score FROM vt",
    "n01_rank_fusion": with_("chk", "vec") + f", {_KW}, {_VEC}, {_FUSE} SELECT id, file_path, source, round(score, 6) AS score FROM fu",
    "search_code": with_("chk", "vec") + f", {_KW}, {_VEC}, {_FUSE}, bo AS (SELECT f.id, f.file_path, f.source, greatest(0, f.score + CASE WHEN {_EXPLAIN} THEN 0.2 ELSE 0 END + CASE ev WHEN 'implementation' THEN 0.25 WHEN 'test' THEN -0.65 ELSE -0.55 END) AS score FROM (SELECT fu.*, lower(concat_ws(chr(10), c.file_path, coalesce(c.symbol_name, ''), c.content)) AS text, {_EVID.replace('file_path', 'c.file_path')} AS ev FROM fu JOIN chk c ON c.id = fu.id) f) SELECT id, file_path, source, round(score, 6) AS score FROM bo WHERE score > 0 ORDER BY bo.score DESC, file_path, id LIMIT 20",
    "a03_owners": with_("chk", "sym")
    + f""", {_KW.replace('LIMIT 40', 'LIMIT 50')},
sm AS (SELECT id, file_path, name, {_search_text('name', 'file_path', 'signature')} AS t, {_split('name')} AS p FROM sym WHERE kind <> 'file'),
sc AS (SELECT *, {_count_terms('t', _TERMS)} AS n, CASE WHEN len(p) >= 2 AND len(list_filter(p, lambda x: x IN ({', '.join(repr(t) for t in _TERMS)}))) >= 2 THEN len(list_filter(p, lambda x: x IN ({', '.join(repr(t) for t in _TERMS)}))) / len(p) END AS cov FROM sm),
m AS (SELECT file_path, 1 + n / {len(_TERMS)} + 1.2 * coalesce(cov, 0) AS score FROM sc WHERE n > 0 OR cov IS NOT NULL),
a AS (SELECT file_path, sum(CASE WHEN r <= 4 THEN score * pow(0.5, r - 1) ELSE 0 END) + ln(1 + greatest(count(*) - 4, 0)) * 0.1 AS c FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC) AS r FROM kw) GROUP BY 1),
b AS (SELECT file_path, sum(CASE WHEN r <= 4 THEN score * pow(0.5, r - 1) ELSE 0 END) + ln(1 + greatest(count(*) - 4, 0)) * 0.1 AS s FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC) AS r FROM m) GROUP BY 1),
j AS (SELECT file_path, coalesce(c, 0) + coalesce(s, 0) + CASE WHEN regexp_matches(lower(file_path), '(^|/)index\\.[cm]?[jt]sx?$') THEN 0.5 ELSE 0 END AS raw, regexp_matches(lower(file_path), '{P._TEST_PATH}') AS test FROM a FULL JOIN b USING (file_path)),
o AS (SELECT file_path, CASE WHEN test AND (SELECT max(raw) FROM j WHERE NOT test) IS NOT NULL THEN least(raw * 0.55, 0.95 * (SELECT max(raw) FROM j WHERE NOT test)) ELSE raw END AS score FROM j)
SELECT file_path, round(score, 6) AS score, 0 AS exact, 0 AS names FROM o ORDER BY o.score DESC, file_path LIMIT 20""",
}
_KIND = r"""CASE WHEN regexp_matches(file_path, '(^|/)(__tests__|tests?)(/|$)|\.(test|spec)\.[jt]sx?$') THEN 'test_fixture' WHEN regexp_matches(file_path, '\.tsx?$') AND regexp_matches(name, '^use[A-Z]') THEN 'react_hook' WHEN regexp_matches(file_path, '\.tsx$') AND regexp_matches(name, '^[A-Z]') THEN 'component'
WHEN regexp_matches(file_path, '(?i)api|client|sdk|fetch') OR regexp_matches(name, '(?i)api|client|fetch') THEN 'api_wrapper' WHEN kind = 'type' OR regexp_matches(file_path, '(?i)schema|type|interface') THEN 'type_or_schema'
WHEN regexp_matches(file_path, '(?i)config|constant|env') OR regexp_matches(name, '^[A-Z0-9_]+$') THEN 'config_constant' WHEN regexp_matches(file_path, '(?i)service|billing|repo|repository') OR kind = 'method' THEN 'service_method' WHEN kind = 'function' THEN 'helper' ELSE 'unknown' END"""
_REUSE = with_("sym") + f""", h AS (SELECT *, lower(concat_ws(' ', name, array_to_string({_split('name')}, ' '), file_path, coalesce(signature, ''))) AS hay FROM sym WHERE kind NOT IN ('file', 'unknown')),
d AS (SELECT *, {_OWN_TERMS} AS own FROM h), g AS ({RELATIONS['j18_duplicate_signals']}), u AS ({RELATIONS['a13_callers_and_tests']}),
c AS (SELECT d.id, d.file_path, d.name, d.kind, coalesce(d.exported, false) AS exported, coalesce(u.callers, 0) AS callers, coalesce(u.tests, 0) AS tests, coalesce(g.duplicates, 0) AS duplicates,
  own + CASE WHEN coalesce(d.exported, false) THEN 1.2 ELSE 0 END + least(2.0, coalesce(u.callers, 0) * 0.4) + least(1.5, coalesce(u.tests, 0) * 0.8) + CASE WHEN g.duplicates > 0 THEN 2.5 ELSE 0 END + CASE WHEN g.signature_similarity >= 0.75 THEN 0.7 ELSE 0 END + CASE WHEN g.import_overlap >= 0.5 THEN 0.5 ELSE 0 END + CASE WHEN g.callee_overlap >= 0.5 THEN 0.5 ELSE 0 END AS raw
  FROM d LEFT JOIN g ON g.symbol_id = d.id LEFT JOIN u ON u.id = d.id WHERE own > 0),
r AS (SELECT id, file_path, name, {_KIND} AS candidate_kind, round(raw, 3)::DOUBLE AS score, CASE WHEN raw >= 3.5 THEN 'high' WHEN raw >= 2 THEN 'medium' ELSE 'low' END AS confidence, exported, callers, tests, duplicates FROM c)
"""
ORACLE["q11_reuse_candidates"] = _REUSE + "SELECT * FROM r ORDER BY score DESC, file_path, id LIMIT 50"
ORACLE["a16_reuse_decision"] = (
    _REUSE
    + """, t AS (SELECT * FROM r ORDER BY score DESC, file_path, id LIMIT 8), b AS (SELECT * FROM t ORDER BY score DESC, id DESC LIMIT 1)
SELECT CASE WHEN b.confidence = 'high' AND b.exported THEN 'reuse' WHEN b.confidence = 'high' THEN 'extend' WHEN b.confidence = 'medium' AND b.exported THEN 'wrap' ELSE 'uncertain' END AS decision,
CASE WHEN (SELECT count(*) FROM t WHERE duplicates > 0 AND confidence = 'high') > 0 OR b.confidence = 'high' OR (SELECT count(*) FROM t WHERE b.score - score < 1) - 1 >= 2 THEN 'high' WHEN b.confidence = 'medium' OR (SELECT count(*) FROM t) > 1 THEN 'medium' ELSE 'low' END AS duplicate_risk,
CASE WHEN (SELECT count(*) FROM t WHERE exported AND confidence = 'high') > 0 THEN 'review_required' ELSE 'allow_new' END AS guard FROM b"""
)
ORACLE["a03_owners"] = ORACLE["a03_owners"].replace("0 AS exact, 0 AS names", "0::INT AS exact, 0::BIGINT AS names")
ORACLE["s14_postings"] = ORACLE["s14_bm25"]
