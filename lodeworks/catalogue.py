"""Every operator as a query over the driver's tables, with the same query in DuckDB's SQL where SQL can say it.

The tables hold no source code, so they stand in for it: documents are chunks, parts are symbols, consecutive items
of an order are calls, benchmark items are diffs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions import text as T, vectors as V
from .operators import budget, chunking, diff, evaluate, fusion, graph, ivf, lexical, snapshot, spans, traverse, vectors
from .scratch import spread, stored

QUERY = "Therein that andThe station of 1984 antiHTTPIn reon"
K = 10
#: Documents have no definitions; these sentence openings play their part.
OPENING = "^(?:The|That|Of|In|Der|Die|La|De|El|Le)[ .,]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Stand-ins -----------------------------------------------------------------


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: ``(chunk_id, path, symbol, lang, text)``."""
    d = spread(read(spark, sf_dir, "documents"))
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    return d.select(F.col("doc_id").alias("chunk_id"), path.alias("path"), F.col("lang").alias("symbol"), "lang", F.coalesce("text", F.lit("")).alias("text"))


SQL_CHUNKS = """chunks AS (
  SELECT doc_id AS chunk_id, source || '/' || doc_id AS path, lang AS symbol, lang, coalesce(text, '') AS text FROM documents
)"""


def lexical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunk_rows(spark, sf_dir)
    return c.select("chunk_id", T.lexical_text(F.col("path"), F.col("symbol"), F.col("text")).alias("body"))


SQL_BODY = "path || ' ' || symbol || chr(10) || text"


def symbol_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    start = F.col("p_size").cast("int") * 7
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.concat(F.when(F.col("p_size") % 10 == 0, "tests.").otherwise(""), "p_type", F.lit("."), "p_name").alias("qualified"),
        F.when(F.col("p_size") > 5, "callable").otherwise("container").alias("kind"),
        F.col("p_brand").alias("path"),
        start.alias("start_line"),
        (start + (F.col("p_partkey") % 37).cast("int")).alias("end_line"),
    )


SQL_SYMBOLS = """symbols AS (
  SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size % 10 = 0 THEN 'tests.' ELSE '' END || p_type || '.' || p_name AS qualified,
    CASE WHEN p_size > 5 THEN 'callable' ELSE 'container' END AS kind, p_brand AS path,
    p_size * 7 AS start_line, p_size * 7 + p_partkey % 37 AS end_line
  FROM part
)"""


def call_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item calls the part of the next one of its order; a seventh line calls from module scope."""
    from pyspark.sql import Window as W

    item = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    rows = item.join(part, "l_partkey").select(
        (F.col("l_orderkey") * 1000 + F.row_number().over(w)).alias("call_id"),
        F.when(F.col("l_linenumber") == 7, F.lit(-1)).otherwise(F.col("l_partkey")).cast("long").alias("caller_id"),
        F.lead("p_name").over(w).alias("callee"),
        F.col("p_brand").alias("path"),
        F.col("l_linenumber").cast("int").alias("line"),
    )
    return rows.where(F.col("callee").isNotNull())


SQL_CALLS = """calls AS (
  SELECT * FROM (
    SELECT l_orderkey * 1000 + row_number() OVER w AS call_id,
      CASE WHEN l_linenumber = 7 THEN -1 ELSE l_partkey END AS caller_id,
      lead(p_name) OVER w AS callee, p_brand AS path, l_linenumber AS line
    FROM lineitem JOIN part ON l_partkey = p_partkey
    WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)
  ) WHERE callee IS NOT NULL
)"""

SQL_RESOLVED = """pairs AS (
  SELECT c.call_id, s.id, s.path = c.path AS here, bool_or(s.path = c.path) OVER (PARTITION BY c.call_id) AS any_here
  FROM calls c JOIN symbols s ON s.name = c.callee
), resolved AS (
  SELECT c.call_id, c.caller_id, c.callee, c.path, c.line, coalesce(r.ids, []) AS resolved
  FROM calls c LEFT JOIN (
    SELECT call_id, list(id ORDER BY id) AS ids FROM pairs WHERE here OR NOT any_here GROUP BY call_id
  ) r USING (call_id)
)"""

SQL_EDGES = """edges AS (
  SELECT call_id, caller_id, path, line, unnest(resolved) AS target, len(resolved) > 1 AS ambiguous FROM resolved
)"""


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


SQL_GRAPH = _with(SQL_SYMBOLS, SQL_CALLS, SQL_RESOLVED, SQL_EDGES)


def linked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.linked(call_rows(spark, sf_dir), symbol_rows(spark, sf_dir))


def diff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-hunk diffs made from benchmark items."""
    i = F.col("item_id")
    s = lambda c: c.cast("string")
    body = F.concat(
        F.lit("diff --git a/x b/x\n--- a/x\n+++ b/Brand#"), s(i % 28 + 1), F.lit("\n@@ -1 +"), s(i * 5 + 1), F.lit(","), s(i % 4),
        F.lit(" @@ fn\n+"), F.regexp_replace("text", "[^A-Za-z ]", ""), F.lit("\n@@ -9,2 +"), s(i * 3 + 40), F.lit(" @@\n+y"),
    )
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("diff_id"), body.alias("text"))


SQL_HUNKS = """diffs AS (
  SELECT item_id AS diff_id, 'diff --git a/x b/x' || chr(10) || '--- a/x' || chr(10) || '+++ b/Brand#' || (item_id % 28 + 1) || chr(10)
    || '@@ -1 +' || (item_id * 5 + 1) || ',' || (item_id % 4) || ' @@ fn' || chr(10) || '+' || regexp_replace(text, '[^A-Za-z ]', '', 'g')
    || chr(10) || '@@ -9,2 +' || (item_id * 3 + 40) || ' @@' || chr(10) || '+y' AS text
  FROM benchmark
), diff_lines AS (
  SELECT diff_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT diff_id, string_split(text, chr(10)) AS l FROM diffs)
), under AS (
  SELECT *, last_value(CASE WHEN x LIKE '+++ %' THEN regexp_extract(x, '^\\+\\+\\+ (?:b/)?(.*)$', 1) END IGNORE NULLS)
    OVER (PARTITION BY diff_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path
  FROM diff_lines
), parsed AS (
  SELECT diff_id, pos AS hunk, path, TRY_CAST(regexp_extract(x, '^@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,(\\d+))? @@', 1) AS INT) AS first,
    TRY_CAST(coalesce(nullif(regexp_extract(x, '^@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,(\\d+))? @@', 2), ''), '1') AS INT) AS n
  FROM under WHERE regexp_matches(x, '^@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,(\\d+))? @@')
), hunks AS (
  SELECT diff_id, CAST(hunk AS INT) AS hunk, path, CASE WHEN n > 0 THEN first END AS start,
    CASE WHEN n > 0 THEN first + n - 1 END AS "end", CAST(n = 0 AS INT) AS deletion_only
  FROM parsed
)"""

SQL_CHANGED = """ranges AS (SELECT DISTINCT path, start, "end" FROM hunks WHERE start IS NOT NULL),
changed AS (
  SELECT DISTINCT id FROM (
    SELECT s.id, row_number() OVER (PARTITION BY r.path, r.start, r."end" ORDER BY s.end_line - s.start_line, s.id) AS n
    FROM ranges r JOIN symbols s ON s.path = r.path AND NOT (s.end_line < r.start OR s.start_line > r."end")
  ) WHERE n = 1
)"""


def manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """documents before and after: some gone, some changed, some new."""
    c = chunk_rows(spark, sf_dir)
    i = F.col("chunk_id")
    before = c.select("path", F.sha2("text", 256).alias("hash"))
    kept = c.where(i % 10 != 0).select("path", F.sha2(F.when(i % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("hash"))
    new = c.where(i % 11 == 0).select(F.concat("path", F.lit(".new")).alias("path"), F.sha2("text", 256).alias("hash"))
    return before, kept.unionByName(new)


SQL_MANIFESTS = f"""{SQL_CHUNKS}, before AS (SELECT path, sha256(text) AS hash FROM chunks), after AS (
  SELECT path, sha256(CASE WHEN chunk_id % 7 = 0 THEN text || 'x' ELSE text END) AS hash FROM chunks WHERE chunk_id % 10 <> 0
  UNION ALL SELECT path || '.new', sha256(text) FROM chunks WHERE chunk_id % 11 = 0
)"""


# SQL forms of expressions -----------------------------------------------------


def sql_tokens(text: str) -> str:
    parts = r"regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')"
    return (
        f"flatten(list_transform(regexp_extract_all({text}, '[A-Za-z0-9]+'), lambda w: CASE WHEN len({parts}) > 1 "
        f"THEN list_concat([lower(w)], list_transform({parts}, lambda p: lower(p))) ELSE [lower(w)] END))"
    )


def sql_hash_embedding(text: str) -> str:
    words = rf"list_filter(regexp_split_to_array(replace(lower({text}), '_', ' '), '\s+'), lambda w: w <> '')"
    marks = f"array_to_string(list_transform({words}, lambda w: ',' || right(md5(w), 2)), '')"
    pair = "',' || lpad(lower(to_hex(b)), 2, '0')"
    return f"list_transform([{marks}], lambda s: list_transform(range(256), lambda b: (length(s) - length(replace(s, {pair}, ''))) / 3.0::DOUBLE))[1]"


SQL_UNIT = "list_transform({v}, lambda x: CAST(x AS DOUBLE) / CASE WHEN {n} = 0 THEN 1 ELSE {n} END)"


def sql_unit(v: str) -> str:
    return SQL_UNIT.format(v=v, n=f"sqrt(list_sum(list_transform({v}, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))")


SQL_EMBEDDED = f"embedded AS (SELECT chunk_id, {sql_unit('v')} AS v FROM (SELECT chunk_id, {sql_hash_embedding('text')} AS v FROM chunks))"
SQL_LISTS = "list_transform({v}, lambda x: round(x, 6))"

SQL_INDEX = f"""postings AS (
  SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest({sql_tokens(SQL_BODY)}) AS term FROM chunks) GROUP BY ALL
), lengths AS (SELECT chunk_id, len({sql_tokens(SQL_BODY)}) AS dl FROM chunks),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lengths), dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term)"""

SQL_WEIGHT = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))"


def sql_bm25(terms: str) -> str:
    """``terms``: a relation (item_id, term) with repeats."""
    return f"""(SELECT item_id, chunk_id, sum({SQL_WEIGHT}) AS score
      FROM {terms} JOIN dfs USING (term) JOIN postings USING (term) JOIN lengths USING (chunk_id) CROSS JOIN stats
      GROUP BY item_id, chunk_id)"""


SQL_ONE_QUERY = f"(SELECT 0 AS item_id, unnest({sql_tokens(chr(39) + QUERY + chr(39))}) AS term)"


# Queries -----------------------------------------------------------------------

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _round(c: str | Column, d: int = 6) -> Column:
    """``c``, a double, rounded as DuckDB rounds: the product with a power of ten, ties away from zero, divided again. Spark's own
    rounds the shortest decimal that tells the number, which is another one where the product lies at a tie, and has no -0."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    y = x * F.lit(10.0**d)
    whole = F.floor(F.abs(y)).cast("double")
    near = F.signum(y) * (whole + F.when(F.abs(y) - whole >= 0.5, 1.0).otherwise(0.0))
    large = F.when(F.abs(y) < float("inf"), y / F.lit(10.0**d)).otherwise(x)
    return F.when(F.abs(y) < float(1 << 52), near / F.lit(10.0**d)).otherwise(large)


@query(_with(SQL_CHUNKS) + f"SELECT chunk_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT chunk_id, {sql_tokens(SQL_BODY)} AS t FROM chunks)")
def tokenize(spark, sf_dir):
    rows = lexical_rows(spark, sf_dir).select("chunk_id", T.tokenize(F.col("body")).alias("t"))
    return rows.select("chunk_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(_with(SQL_CHUNKS, SQL_INDEX) + "SELECT term, chunk_id, tf FROM postings")
def term_freq(spark, sf_dir):
    return lexical.term_frequencies(lexical_rows(spark, sf_dir), "chunk_id", F.col("body"))


@query(_with(SQL_CHUNKS, SQL_INDEX) + "SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfs CROSS JOIN stats")
def idf(spark, sf_dir):
    rows = lexical_rows(spark, sf_dir)
    found = lexical.idf_table(lexical.term_frequencies(rows, "chunk_id", F.col("body")), lexical.document_lengths(rows, "chunk_id", F.col("body")))
    return found.select("term", "df", _round("idf").alias("idf"))


@query(
    _with(SQL_CHUNKS, SQL_INDEX)
    + f"SELECT chunk_id, path, round(score, 6) AS score FROM {sql_bm25(SQL_ONE_QUERY)} JOIN chunks USING (chunk_id) ORDER BY round(score, 9) DESC, chunk_id LIMIT {K}"
)
def bm25_topk(spark, sf_dir):
    best = lexical.topk(lexical_rows(spark, sf_dir), "chunk_id", F.col("body"), QUERY, K)
    return chunk_rows(spark, sf_dir).select("chunk_id", "path").join(F.broadcast(best), "chunk_id").select("chunk_id", "path", _round("score").alias("score"))


@query(ORACLES["bm25_topk"].replace("SELECT chunk_id, path, round(score, 6)", "SELECT chunk_id, round(score, 6)"))
def bm25_blocks(spark, sf_dir):
    """The same over posting blocks, of which only those that can hold one of the best are opened."""
    rows = lexical_rows(spark, sf_dir)
    n = read(spark, sf_dir, "documents").count()
    blocks = stored(lexical.blocked_texts(rows, "chunk_id", F.col("body"), lexical.cell_bits(n)), "blocks")
    tokens, dfs = lexical.statistics(blocks, lexical.query_terms(QUERY))
    known = lambda d: d.where("chunk_id is not null")
    best, _ = lexical.blocks_topk(blocks, dfs, n, tokens / max(n, 1), "chunk_id", QUERY, K, ["cell"], known)
    return best.select("chunk_id", _round("score").alias("score"))


SQL_ITEM_TERMS = f"(SELECT item_id, unnest({sql_tokens('text')}) AS term FROM benchmark)"


@query(
    _with(SQL_CHUNKS, SQL_INDEX)
    + f"""SELECT item_id, chunk_id, round(score, 6) AS score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {sql_bm25(SQL_ITEM_TERMS)}
    ) WHERE rank <= 5"""
)
def bm25_batch(spark, sf_dir):
    rows = lexical_rows(spark, sf_dir)
    items = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    postings = stored(lexical.term_frequencies(rows, "chunk_id", F.col("body")), "postings")
    found = lexical.batch_topk(postings, lexical.lengths_of(postings, rows, "chunk_id"), items, "chunk_id", 5)
    return found.select("item_id", "chunk_id", _round("score").alias("score"), F.col("rank").cast("long").alias("rank"))


SQL_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


@query(
    f"SELECT e.vec_id, round({SQL_DOT.format(a='e.embedding', b='q.embedding')}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q "
    f"ORDER BY round({SQL_DOT.format(a='e.embedding', b='q.embedding')}, 9) DESC, e.vec_id LIMIT {K}"
)
def vector_topk(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    first = e.where("vec_id = 0").select("embedding").first()[0]
    return vectors.topk(e, "vec_id", "embedding", list(first), K).select("vec_id", _round("score").alias("score"))


@query(
    f"""SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM (
        SELECT q.vec_id AS query_id, e.vec_id, {SQL_DOT.format(a="e.embedding", b="q.embedding")} AS score
        FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q)
    ) WHERE rank <= 5"""
)
def vector_batch_topk(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = vectors.batch_topk(e, "vec_id", "embedding", q, 5)
    return found.select("query_id", "vec_id", _round("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def vector_ivf_topk(spark, sf_dir):
    """The ten nearest through an inverted file; its recall against the exact search is tested."""
    e = read(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = ivf.batch_topk(ivf.build(e, "vec_id", "embedding"), q, K)
    return found.select("query_id", "vec_id", _round("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"SELECT vec_id, {SQL_LISTS.format(v=sql_unit('embedding'))} AS unit FROM embeddings")
def l2_normalize(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform(V.normalized(F.col("embedding")), lambda x: _round(x)).alias("unit"))


@query(_with(SQL_CHUNKS, SQL_EMBEDDED) + f"SELECT chunk_id, {SQL_LISTS.format(v='v')} AS unit FROM embedded")
def hash_embed(spark, sf_dir):
    rows = chunk_rows(spark, sf_dir)
    return rows.select("chunk_id", F.transform(V.hash_embedding(F.col("text")), lambda x: _round(x)).alias("unit"))


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rankings of the query to the depth of a retrieval, fused."""
    depth, _ = fusion.pools(K, rerank=True)
    lex = lexical.topk(lexical_rows(spark, sf_dir), "chunk_id", F.col("body"), QUERY, depth)
    one = spark.range(1).select(V.hash_embedding(F.lit(QUERY)).alias("q")).first()[0]
    embedded = chunk_rows(spark, sf_dir).select("chunk_id", V.hash_embedding(F.col("text")).alias("v"))
    vec = vectors.topk(embedded, "chunk_id", "v", list(one), depth)
    by = F.desc(F.round("score", 9))
    return fusion.rrf([fusion.ranked(vec, "chunk_id", by), fusion.ranked(lex, "chunk_id", by)], "chunk_id")


SQL_FUSED = _with(SQL_CHUNKS, SQL_INDEX, SQL_EMBEDDED) + f""", lex AS (
  SELECT chunk_id, row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {sql_bm25(SQL_ONE_QUERY)} QUALIFY rank <= 50
), qv AS (SELECT {sql_unit("v")} AS q FROM (SELECT {sql_hash_embedding(chr(39) + QUERY + chr(39))} AS v)), vec AS (
  SELECT chunk_id, row_number() OVER (ORDER BY round({SQL_DOT.format(a="v", b="q")}, 9) DESC, chunk_id) AS rank FROM embedded, qv QUALIFY rank <= 50
), fused AS (
  SELECT chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(l * 1000 + rank) AS seen
  FROM (SELECT chunk_id, rank, 0 AS l FROM vec UNION ALL SELECT chunk_id, rank, 1 FROM lex) GROUP BY chunk_id
), placed AS (SELECT chunk_id, score, row_number() OVER (ORDER BY round(score, 12) DESC, seen, chunk_id) AS fused_rank FROM fused)
"""


@query(SQL_FUSED + f"SELECT chunk_id, round(score, 9) AS score, fused_rank FROM placed WHERE fused_rank <= {K}")
def rrf_hybrid(spark, sf_dir):
    found = _fused(spark, sf_dir).where(F.col("fused_rank") <= K)
    return found.select("chunk_id", _round("score", 9).alias("score"), F.col("fused_rank").cast("long").alias("fused_rank"))


@query(
    SQL_FUSED
    + f"""SELECT chunk_id, score, rank FROM (
      SELECT chunk_id, CAST(len(list_intersect({sql_tokens(chr(39) + QUERY + chr(39))}, {sql_tokens("substring(" + SQL_BODY + ", 1, 1600)")})) AS DOUBLE) AS score,
        row_number() OVER (ORDER BY len(list_intersect({sql_tokens(chr(39) + QUERY + chr(39))}, {sql_tokens("substring(" + SQL_BODY + ", 1, 1600)")})) DESC, fused_rank, chunk_id) AS rank
      FROM placed JOIN chunks USING (chunk_id) WHERE fused_rank <= 50) WHERE rank <= {K}"""
)
def rerank_overlap(spark, sf_dir):
    _, pool = fusion.pools(K, rerank=True)
    found = lexical_rows(spark, sf_dir).join(F.broadcast(_fused(spark, sf_dir).where(F.col("fused_rank") <= pool)), "chunk_id")
    score = fusion.token_overlap(F.lit(QUERY), F.substring("body", 1, fusion.RERANK_CHARS))
    return fusion.rerank(found, "chunk_id", score, pool, K).select("chunk_id", "score", F.col("rank").cast("long").alias("rank"))


SQL_LINES = f"""{SQL_CHUNKS}, lined AS (
  SELECT chunk_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT chunk_id, string_split(text, chr(10)) AS l FROM chunks)
)"""


@query(
    _with(SQL_LINES)
    + """SELECT chunk_id, CAST(i + 1 AS INT) AS start_line, CAST(least(i + 8, len(l)) AS INT) AS end_line, md5(array_to_string(l[i + 1:i + 8], chr(10))) AS digest
    FROM (SELECT chunk_id, l, unnest(range(0, len(l), 6)) AS i FROM lined)"""
)
def chunk_windows(spark, sf_dir):
    rows = chunk_rows(spark, sf_dir).select("chunk_id", T.lines(F.col("text")).alias("lines"))
    return chunking.windows(rows, 8, 2).select("chunk_id", "start_line", "end_line", F.md5("text").alias("digest"))


@query(
    _with(SQL_LINES)
    + rf""", starts AS (
      SELECT chunk_id, l, list_filter(range(len(l)), lambda i: regexp_matches(l[i + 1], '{OPENING}')) AS s FROM lined
    ), all_starts AS (SELECT chunk_id, l, s[1] > 0 AS pre, CASE WHEN s[1] > 0 THEN list_concat([0], s) ELSE s END AS s FROM starts WHERE len(s) > 0),
    blocks AS (SELECT chunk_id, l, pre, s, unnest(range(1, len(s) + 1)) AS k FROM all_starts)
    SELECT chunk_id, CAST(s[k] + 1 AS INT) AS start_line, CAST(coalesce(s[k + 1], len(l)) AS INT) AS end_line,
      CASE WHEN k = 1 AND pre THEN '<module-preamble>' ELSE coalesce(nullif(regexp_extract(l[s[k] + 1], '(\w+)\s*\(', 1), ''), '<block>') END AS symbol
    FROM blocks"""
)
def chunk_definitions(spark, sf_dir):
    rows = chunk_rows(spark, sf_dir).select("chunk_id", T.lines(F.col("text")).alias("lines"))
    return chunking.definition_blocks(rows, F.lit(OPENING)).select("chunk_id", "start_line", "end_line", "symbol")


@query(
    _with(SQL_SYMBOLS)
    + """, points AS (SELECT DISTINCT l_suppkey AS point_id, p_brand AS path, CAST(l_quantity * 7 AS INT) AS "at" FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT point_id, p.path, "at", coalesce(arg_min(s.id, (s.end_line - s.start_line) * 1000000000 + s.id) FILTER (s.start_line <= "at" AND "at" <= s.end_line), -1) AS symbol_id
    FROM points p LEFT JOIN symbols s ON s.path = p.path GROUP BY ALL"""
)
def enclosing_span(spark, sf_dir):
    item = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    points = item.select(F.col("l_suppkey").alias("point_id"), F.col("p_brand").alias("path"), (F.col("l_quantity") * 7).cast("int").alias("at")).distinct()
    return spans.enclosing(points, symbol_rows(spark, sf_dir), ["point_id"])


@query(
    _with(SQL_SYMBOLS)
    + """, targets AS (SELECT p_partkey AS target_id, p_brand AS path, p_size * 7 + 3 AS start, p_size * 7 + 9 AS "end" FROM part)
    SELECT target_id, path, start, "end", symbol_id FROM (
      SELECT t.*, s.id AS symbol_id, row_number() OVER (PARTITION BY target_id ORDER BY s.end_line - s.start_line, s.id) AS n
      FROM targets t JOIN symbols s ON s.path = t.path AND NOT (s.end_line < t.start OR s.start_line > t."end")) WHERE n = 1"""
)
def innermost_symbol(spark, sf_dir):
    size = F.col("p_size").cast("int") * 7
    targets = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("target_id"), F.col("p_brand").alias("path"), (size + 3).alias("start"), (size + 9).alias("end"))
    return spans.innermost(targets, symbol_rows(spark, sf_dir), ["target_id"])


@query(
    _with(SQL_SYMBOLS)
    + """SELECT span_id, chunk_id, rank FROM (
      SELECT a.id AS span_id, b.id AS chunk_id, row_number() OVER (PARTITION BY a.id ORDER BY b.start_line, b.end_line, b.id) AS rank
      FROM symbols a JOIN symbols b ON a.path = b.path AND NOT (b.end_line < a.start_line OR b.start_line > a.end_line)) WHERE rank <= 2"""
)
def chunks_in_span(spark, sf_dir):
    s = symbol_rows(spark, sf_dir)
    wanted = s.select(F.col("id").alias("span_id"), "path", F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    chunks = s.select(F.col("id").alias("chunk_id"), "path", "start_line", "end_line")
    return spans.chunks_in_span(wanted, chunks, "span_id", 2).select("span_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query(SQL_GRAPH + "SELECT call_id, caller_id, callee, path, len(resolved) AS candidates, md5(array_to_string(resolved, ',')) AS digest FROM resolved")
def resolve_calls(spark, sf_dir):
    def told(ids: Column) -> Column:
        return F.struct(F.size(ids).cast("long").alias("candidates"), F.md5(F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")).alias("digest"))

    r = graph.resolve_calls(call_rows(spark, sf_dir), symbol_rows(spark, sf_dir), told=told)
    return r.select("call_id", "caller_id", "callee", "path", "resolved.candidates", "resolved.digest")


@query(
    _with(SQL_SYMBOLS)
    + """SELECT id, qualified FROM symbols WHERE qualified = 'small ring'
      OR (NOT EXISTS (SELECT 1 FROM symbols WHERE qualified = 'small ring') AND (name = 'small ring' OR ends_with(qualified, '.small ring')))"""
)
def symbol_find(spark, sf_dir):
    return graph.find(symbol_rows(spark, sf_dir), "small ring").select("id", "qualified")


SQL_FOUND = "(SELECT id FROM symbols WHERE name = 'small ring')"


@query(SQL_GRAPH + f"SELECT caller_id, path, line, min(target) AS target FROM edges WHERE target IN {SQL_FOUND} GROUP BY ALL")
def callers(spark, sf_dir):
    s = symbol_rows(spark, sf_dir)
    return graph.callers(linked_rows(spark, sf_dir), s, graph.find(s, "small ring"))


@query(SQL_GRAPH + f"SELECT DISTINCT caller_id, target FROM edges WHERE caller_id IN {SQL_FOUND}")
def callees(spark, sf_dir):
    s = symbol_rows(spark, sf_dir)
    return graph.callees(linked_rows(spark, sf_dir), s, graph.find(s, "small ring"))


@query(
    _with(SQL_SYMBOLS, SQL_CALLS)
    + """, named AS (SELECT caller_id, CASE WHEN call_id % 3 = 0 THEN callee || ' lib' ELSE callee END AS callee FROM calls)
    SELECT DISTINCT callee FROM named WHERE caller_id IN (SELECT id FROM symbols WHERE name = 'small ring') AND callee NOT IN (SELECT name FROM symbols)"""
)
def callees_external(spark, sf_dir):
    """A third of the calls are of names that no symbol bears."""
    s = symbol_rows(spark, sf_dir)
    calls = call_rows(spark, sf_dir).withColumn("callee", F.when(F.col("call_id") % 3 == 0, F.concat("callee", F.lit(" lib"))).otherwise(F.col("callee")))
    return graph.external_callees(graph.linked(calls, s), graph.find(s, "small ring"))


@query(
    SQL_GRAPH
    + """SELECT id, coalesce(fan_in, 0) AS fan_in, coalesce(call_sites, 0) AS call_sites, coalesce(fan_out, 0) AS fan_out FROM symbols
    LEFT JOIN (SELECT target AS id, count(DISTINCT caller_id) AS fan_in, count(*) AS call_sites FROM edges GROUP BY 1) USING (id)
    LEFT JOIN (SELECT caller_id AS id, count(DISTINCT target) AS fan_out FROM edges WHERE caller_id >= 0 GROUP BY 1) USING (id)"""
)
def call_degree(spark, sf_dir):
    return graph.degrees(symbol_rows(spark, sf_dir), linked_rows(spark, sf_dir))


def sql_impact(roots: str, depth: int) -> str:
    """CTEs ``nodes`` of the breadth-first search from the relation ``roots(id)``."""
    out = f""", n0 AS (SELECT r.id AS root_id, 'sym:' || r.id AS node_key, r.id AS symbol_id, false AS uncertain,
      CAST([] AS STRUCT(c BIGINT, t BIGINT)[]) AS way, [s.qualified] AS chain, 0 AS depth, '' AS qualified, '' AS path, 0 AS call_line
      FROM (SELECT DISTINCT id FROM {roots}) r JOIN symbols s USING (id))"""
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT root_id, node_key FROM n{i}" for i in range(d))
        out += f""", m{d} AS (SELECT f.root_id, CASE WHEN e.caller_id >= 0 THEN 'sym:' || e.caller_id ELSE 'mod:' || e.path END AS node_key,
          list_append(f.way, {{'c': CAST(e.call_id AS BIGINT), 't': CAST(e.target AS BIGINT)}}) AS way, e.caller_id, e.path, e.line,
          e.ambiguous OR f.uncertain AS uncertain, f.chain
          FROM n{d - 1} f JOIN edges e ON e.target = f.symbol_id WHERE f.symbol_id >= 0),
        b{d} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root_id, node_key ORDER BY way) AS n FROM m{d}) WHERE n = 1),
        n{d} AS (SELECT b.root_id, b.node_key, CASE WHEN b.caller_id >= 0 THEN b.caller_id ELSE -1 END AS symbol_id, b.uncertain, b.way,
          list_concat([CASE WHEN b.caller_id >= 0 THEN s.qualified ELSE '<module ' || b.path || '>' END], b.chain) AS chain, {d} AS depth,
          CASE WHEN b.caller_id >= 0 THEN s.qualified ELSE '<module ' || b.path || '>' END AS qualified,
          CASE WHEN b.caller_id >= 0 THEN s.path ELSE b.path END AS path, b.line AS call_line
          FROM b{d} b LEFT JOIN symbols s ON s.id = b.caller_id
          WHERE NOT EXISTS (SELECT 1 FROM ({seen}) x WHERE x.root_id = b.root_id AND x.node_key = b.node_key))"""
    every = " UNION ALL ".join(f"SELECT * FROM n{d}" for d in range(1, depth + 1))
    test = "(lower(qualified) LIKE 'test%' OR lower(qualified) LIKE '%.test%' OR lower(qualified) LIKE '%tests.%' OR lower(qualified) LIKE '%.tests')"
    return out + f", nodes AS (SELECT *, {test} AS is_test FROM ({every})) "


SQL_ROOT = "(SELECT 0 AS id)"


def _root(spark: SparkSession) -> DataFrame:
    return spark.range(1).select("id")


@query(SQL_GRAPH + sql_impact(SQL_ROOT, 3) + "SELECT root_id, node_key, symbol_id, qualified, path, call_line, depth, uncertain, is_test FROM nodes")
def impact(spark, sf_dir):
    found = traverse.impact(_root(spark), symbol_rows(spark, sf_dir), linked_rows(spark, sf_dir), 3)
    return found.select("root_id", "node_key", "symbol_id", "qualified", "path", "call_line", "depth", "uncertain", "is_test")


@query(SQL_GRAPH + sql_impact(SQL_ROOT, 3) + "SELECT node_key, depth, array_to_string(chain, ' > ') AS chain FROM nodes")
def impact_chain(spark, sf_dir):
    found = traverse.impact(_root(spark), symbol_rows(spark, sf_dir), linked_rows(spark, sf_dir), 3)
    return found.select("node_key", "depth", F.array_join("chain", " > ").alias("chain"))


@query(SQL_GRAPH + sql_impact(SQL_ROOT, 4) + "SELECT node_key, qualified, depth, array_to_string(chain, ' > ') AS chain FROM nodes WHERE is_test")
def tests_for(spark, sf_dir):
    found = traverse.tests_for(_root(spark), symbol_rows(spark, sf_dir), linked_rows(spark, sf_dir), 4)
    return found.select("node_key", "qualified", "depth", F.array_join("chain", " > ").alias("chain"))


SQL_SUFFIXES = " OR ".join(f"ends_with(f, '{s}')" for s in T.TEST_SUFFIXES)


@query(
    f"""SELECT page_id, url, coalesce(len(list_intersect(p[:-2], {T.TEST_DIRS!r})), 0) > 0 OR starts_with(f, 'test_') OR starts_with(f, 'test-') OR {SQL_SUFFIXES} AS is_test
    FROM (SELECT page_id, url, p, p[-1] AS f FROM (SELECT page_id, url, string_split(lower(replace(url, chr(92), '/')), '/') AS p FROM pages))"""
)
def test_path_flag(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", "url", T.is_test_path(F.col("url")).alias("is_test"))


def _chunk_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = symbol_rows(spark, sf_dir)
    return s.select(F.col("id").alias("chunk_id"), "path", "start_line", "end_line", F.col("qualified").alias("symbol"), F.col("name").alias("text"))


@query(
    SQL_GRAPH
    + """, hits AS (SELECT row_number() OVER (ORDER BY end_line - start_line DESC, id) AS rank, path, start_line, end_line FROM symbols QUALIFY rank <= 8),
    spot AS (SELECT rank, caller_id FROM (
      SELECT h.rank, s.id AS caller_id, row_number() OVER (PARTITION BY h.rank ORDER BY s.end_line - s.start_line, s.id) AS n FROM hits h
      JOIN symbols s ON s.path = h.path AND NOT (s.end_line < h.start_line OR s.start_line > h.end_line) WHERE h.rank <= 3) WHERE n = 1),
    called AS (SELECT rank, caller_id, target, min(call_id) AS call_id FROM spot JOIN edges USING (caller_id) WHERE caller_id <> target GROUP BY ALL),
    found AS (SELECT rank AS hit, call_id, target, caller, c.id AS chunk_id, c.path, c.start_line, c.end_line, c.qualified AS symbol, c.name AS text,
        row_number() OVER (PARTITION BY rank, call_id, target ORDER BY c.start_line, c.end_line, c.id) AS n
      FROM called JOIN (SELECT id AS target, path, start_line AS s, end_line AS e FROM symbols) USING (target)
      JOIN (SELECT id AS caller_id, qualified AS caller FROM symbols) USING (caller_id)
      JOIN symbols c USING (path) WHERE NOT (c.end_line < s OR c.start_line > e)),
    fresh AS (SELECT *, row_number() OVER (PARTITION BY path, start_line, end_line ORDER BY hit, call_id, target, n) AS once FROM found f
      WHERE n <= 2 AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.path = f.path AND h.start_line = f.start_line AND h.end_line = f.end_line))
    SELECT row_number() OVER (ORDER BY hit, call_id, target, n) AS place, path, start_line, end_line, symbol || '  ← called by ' || caller AS symbol
    FROM fresh WHERE once = 1 QUALIFY place <= 6"""
)
def graph_expand(spark, sf_dir):
    s = symbol_rows(spark, sf_dir)
    best = s.orderBy(F.desc(F.col("end_line") - F.col("start_line")), "id").limit(8)
    hits = fusion.ranked(best, "id", F.desc(F.col("end_line") - F.col("start_line"))).select("rank", "path", "start_line", "end_line")
    found = graph.expand_hits(hits, s, linked_rows(spark, sf_dir), _chunk_symbols(spark, sf_dir))
    return found.select(F.col("place").cast("long").alias("place"), "path", "start_line", "end_line", "symbol")


SQL_STATUS = "CASE WHEN b.hash IS NULL THEN 'added' WHEN a.hash IS NULL THEN 'deleted' WHEN a.hash <> b.hash THEN 'changed' ELSE 'unchanged' END"


@query(_with(SQL_MANIFESTS) + f"SELECT path, {SQL_STATUS} AS status FROM before b FULL JOIN after a USING (path)")
def snapshot_diff(spark, sf_dir):
    return snapshot.snapshot_diff(*manifests(spark, sf_dir))


@query(_with(SQL_MANIFESTS) + f"SELECT chunk_id, path FROM chunks WHERE path NOT IN (SELECT path FROM before b FULL JOIN after a USING (path) WHERE {SQL_STATUS} IN ('changed', 'deleted'))")
def remove_paths(spark, sf_dir):
    gone = snapshot.snapshot_diff(*manifests(spark, sf_dir)).where("status in ('changed', 'deleted')")
    return snapshot.remove_paths(chunk_rows(spark, sf_dir), gone).select("chunk_id", "path")


@query(_with(SQL_MANIFESTS) + "SELECT path FROM after a LEFT JOIN before b USING (path) WHERE b.hash IS NULL OR a.hash <> b.hash")
def stale_files(spark, sf_dir):
    before, after = manifests(spark, sf_dir)
    return diff.stale_files(after.select("path"), after, before)


@query(_with(SQL_CHUNKS) + "SELECT DISTINCT path FROM chunks")
def distinct_paths(spark, sf_dir):
    return snapshot.distinct_paths(chunk_rows(spark, sf_dir))


@query(_with(SQL_HUNKS) + "SELECT * FROM hunks")
def diff_hunks(spark, sf_dir):
    return diff.hunks(diff_rows(spark, sf_dir))


@query(_with(SQL_SYMBOLS, SQL_HUNKS, SQL_CHANGED) + "SELECT id, qualified, path FROM symbols JOIN changed USING (id)")
def changed_symbols(spark, sf_dir):
    found = diff.changed_symbols(diff.hunks(diff_rows(spark, sf_dir)), symbol_rows(spark, sf_dir))
    return found.select("id", "qualified", "path")


@query(
    _with(SQL_SYMBOLS, SQL_HUNKS)
    + """SELECT path FROM (SELECT h.path, count(h.start) AS ranges,
        count(*) FILTER (h.start IS NOT NULL AND EXISTS (SELECT 1 FROM symbols s WHERE s.path = h.path AND NOT (s.end_line < h.start OR s.start_line > h."end"))) AS hits
      FROM hunks h GROUP BY h.path) WHERE path NOT IN (SELECT path FROM symbols) OR (hits = 0 AND ranges > 0)"""
)
def unmapped_changes(spark, sf_dir):
    return diff.unmapped_changes(diff.hunks(diff_rows(spark, sf_dir)), symbol_rows(spark, sf_dir))


def _diff_nodes(spark: SparkSession, sf_dir: str, depth: int) -> DataFrame:
    s = symbol_rows(spark, sf_dir)
    roots = diff.changed_symbols(diff.hunks(diff_rows(spark, sf_dir)), s)
    return traverse.impact(roots, s, linked_rows(spark, sf_dir), depth, chains=False)


SQL_DIFF_GRAPH = _with(SQL_SYMBOLS, SQL_CALLS, SQL_RESOLVED, SQL_EDGES, SQL_HUNKS, SQL_CHANGED) + sql_impact("changed", 3)


@query(SQL_DIFF_GRAPH + "SELECT root_id, node_key, depth, uncertain FROM nodes")
def diff_impact(spark, sf_dir):
    return _diff_nodes(spark, sf_dir, 3).select("root_id", "node_key", "depth", "uncertain")


@query(SQL_DIFF_GRAPH + "SELECT DISTINCT path || '::' || qualified AS test FROM nodes WHERE is_test")
def diff_tests_to_run(spark, sf_dir):
    return diff.tests_to_run(_diff_nodes(spark, sf_dir, 3))


def _context_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = fusion.ranked(lexical.topk(lexical_rows(spark, sf_dir), "chunk_id", F.col("body"), QUERY, K), "chunk_id", F.desc(F.round("score", 9)))
    rows = chunk_rows(spark, sf_dir).join(F.broadcast(best), "chunk_id")
    return rows.select("rank", "score", "path", F.lit(1).alias("start_line"), F.size(T.lines(F.col("text"))).alias("end_line"), "symbol", "text")


SQL_HITS = f""", best AS (SELECT chunk_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {sql_bm25(SQL_ONE_QUERY)} QUALIFY rank <= {K}),
hits AS (SELECT rank, score, path, 1 AS start_line, len(l) AS end_line, symbol, text FROM best JOIN chunks USING (chunk_id) JOIN lined USING (chunk_id))"""


@query(
    _with(SQL_LINES, SQL_INDEX)
    + SQL_HITS
    + """, b AS (SELECT rank, path, chr(10) || chr(10) || '--- ' || path || ':' || start_line || '-' || end_line || '  (' || symbol || ') ---' || chr(10) ||
      CASE WHEN length(text) > 1800 THEN substring(text, 1, 1800) || chr(10) || '... [truncated — read ' || path || ':' || start_line || '-' || end_line || ' (' || symbol || ') for the rest]' ELSE text END AS block FROM hits)
    SELECT rank, path, md5(block) AS digest, sum(length(block)) OVER (ORDER BY rank) + 20 <= 6000 AS shown FROM b"""
)
def context_budget(spark, sf_dir):
    found = budget.blocks(_context_hits(spark, sf_dir), 20)
    return found.select(F.col("rank").cast("long").alias("rank"), "path", F.md5("block").alias("digest"), "shown")


@query(
    _with(SQL_LINES, SQL_INDEX)
    + SQL_HITS
    + """SELECT md5(string_agg('--- ' || path || ':' || start_line || '-' || end_line || ' (' || symbol || ')  [score=' || format('{:.3f}', score) || '] ---' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS digest FROM hits"""
)
def llm_context(spark, sf_dir):
    return budget.context(_context_hits(spark, sf_dir)).select(F.md5("context").alias("digest"))


def _eval_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunk_rows(spark, sf_dir).where("chunk_id % 50 = 0")
    return rows.select(
        F.col("chunk_id").alias("item_id"), F.array_join(F.slice(T.tokenize(F.col("text")), 3, 6), " ").alias("query"),
        F.col("path").alias("gold_path"), F.lit(1).alias("gold_start"), F.lit(1).alias("gold_end"),
    )


def _eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = stored(_eval_items(spark, sf_dir), "eval-items")
    depth, _ = fusion.evaluation_pools(K, rerank=False)
    texts = stored(lexical.counted(lexical_rows(spark, sf_dir), "chunk_id", F.col("body")), "counted")
    lex = lexical.counted_topk(texts, items, "chunk_id", depth)
    # Every block of queries reads the vectors again, so they are worked out once.
    embedded = stored(V.hash_embeddings(chunk_rows(spark, sf_dir), "chunk_id", F.col("text"), "v"), "embedded")
    q = items.select(F.col("item_id").alias("query_id"), V.hash_embedding(F.col("query")).alias("vector"))
    vec = vectors.batch_topk(embedded, "chunk_id", "v", q, depth).withColumnRenamed("query_id", "item_id")
    ids = ["item_id", "chunk_id", "rank"]
    vec, lex = stored(vec.select(*ids), "eval-vector"), stored(lex.select(*ids), "eval-lexical")
    both = fusion.rrf([vec, lex], "chunk_id")
    modes = {"vector": vec, "lexical": lex, "hybrid": both.withColumnRenamed("fused_rank", "rank")}
    hits = None
    for mode, found in modes.items():
        part = found.select(F.lit(mode).alias("mode"), "item_id", "chunk_id", "rank")
        hits = part if hits is None else hits.unionByName(part)
    placed = hits.join(chunk_rows(spark, sf_dir).select("chunk_id", "path"), "chunk_id").withColumns({"start_line": F.lit(1), "end_line": F.lit(1)})
    names = spark.createDataFrame([(m,) for m in modes], "mode string")
    return evaluate.metrics(evaluate.first_match(placed, items), names, items, K)


SQL_REPORT = _with(SQL_CHUNKS, SQL_INDEX, SQL_EMBEDDED) + f""", items AS (
  SELECT chunk_id AS item_id, array_to_string(({sql_tokens("text")})[3:8], ' ') AS query FROM chunks WHERE chunk_id % 50 = 0
), lex AS (
  SELECT item_id, chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, chunk_id) AS rank
  FROM {sql_bm25("(SELECT item_id, unnest(" + sql_tokens("query") + ") AS term FROM items)")} QUALIFY rank <= 40
), qv AS (SELECT item_id, {sql_unit("v")} AS q FROM (SELECT item_id, {sql_hash_embedding("query")} AS v FROM items)), vec AS (
  SELECT item_id, chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY round({SQL_DOT.format(a="v", b="q")}, 9) DESC, chunk_id) AS rank
  FROM embedded, qv QUALIFY rank <= 40
), hyb AS (
  SELECT item_id, chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 12) DESC, min(l * 1000 + rank), chunk_id) AS rank
  FROM (SELECT *, 0 AS l FROM vec UNION ALL SELECT *, 1 FROM lex) GROUP BY item_id, chunk_id
), hits AS (SELECT 'vector' AS mode, * FROM vec UNION ALL SELECT 'lexical', * FROM lex UNION ALL SELECT 'hybrid', * FROM hyb),
report AS (
  SELECT m.mode, (SELECT count(*) FROM items) AS n, count(*) FILTER (rank = 1) / (SELECT count(*) FROM items) AS recall_at_1,
    count(rank) / (SELECT count(*) FROM items) AS recall_at_k, coalesce(sum(1.0::DOUBLE / rank), 0) / (SELECT count(*) FROM items) AS mrr
  FROM (VALUES ('vector'), ('lexical'), ('hybrid')) m(mode) LEFT JOIN (SELECT * FROM hits WHERE item_id = chunk_id AND rank <= {K}) h ON h.mode = m.mode
  GROUP BY m.mode
) """


@query(SQL_REPORT + "SELECT mode, n, round(recall_at_1, 6) AS recall_at_1, round(recall_at_k, 6) AS recall_at_k, round(mrr, 6) AS mrr FROM report")
def eval_metrics(spark, sf_dir):
    r = _eval_report(spark, sf_dir)
    return r.select("mode", "n", *[_round(c).alias(c) for c in ("recall_at_1", "recall_at_k", "mrr")])


FLOORS = [("lexical", "mrr", 0.2), ("lexical", "recall_at_k", 0.4), ("vector", "mrr", 0.9), ("graph", "mrr", 0.1)]


@query(
    SQL_REPORT
    + f""", long AS (UNPIVOT (SELECT mode, recall_at_1, recall_at_k, mrr FROM report) ON recall_at_1, recall_at_k, mrr INTO NAME metric VALUE value)
    SELECT f.mode, f.metric, f.floor, coalesce(value >= f.floor, false) AS passed FROM (VALUES {", ".join(map(str, FLOORS))}) f(mode, metric, floor)
    LEFT JOIN long l ON l.mode = f.mode AND l.metric = f.metric""".replace(", 0.", ", 0.")
)
def gate_check(spark, sf_dir):
    floors = spark.createDataFrame(FLOORS, "mode string, metric string, floor double")
    return evaluate.gate(_eval_report(spark, sf_dir), floors).select("mode", "metric", "floor", "passed")


@query(
    SQL_REPORT
    + "SELECT mode, round(greatest(mrr - 2 * sqrt(greatest(mrr * (1 - mrr), 1e-9) / n), 0), 6) AS mrr_floor FROM report"
)
def gate_floor(spark, sf_dir):
    r = _eval_report(spark, sf_dir)
    return r.select("mode", _round(evaluate.floor(F.col("mrr"), F.col("n"))).alias("mrr_floor"))


SQL_WORDS = r"regexp_extract_all(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')"


@query(
    _with(SQL_SYMBOLS)
    + f"""SELECT array_to_string(list_transform({SQL_WORDS}, lambda p: lower(p)), ' ') AS query, path AS gold_path, start_line AS gold_start, end_line AS gold_end
    FROM symbols WHERE kind = 'callable' AND lower(name) NOT IN ('__init__', 'main', 'new', 'default') AND len({SQL_WORDS}) >= 2
      AND length(array_to_string({SQL_WORDS}, '')) >= 6 ORDER BY md5('0:' || id) LIMIT 200"""
)
def name_dataset(spark, sf_dir):
    return evaluate.name_dataset(symbol_rows(spark, sf_dir))


@query(
    _with(SQL_SYMBOLS)
    + """, c AS (SELECT *, end_line - start_line AS size FROM symbols WHERE kind = 'callable' AND end_line - start_line >= 4),
    f AS (SELECT path, -max(size) AS big, arg_min(id, -size * 1000000000 + id) AS first FROM c GROUP BY path),
    t AS (SELECT c.*, big, first, row_number() OVER (PARTITION BY path ORDER BY size DESC, id) AS turn FROM c JOIN f USING (path)),
    o AS (SELECT *, row_number() OVER (PARTITION BY name, start_line, end_line ORDER BY turn, big, first) AS n FROM t)
    SELECT row_number() OVER (ORDER BY turn, big, first) AS place, path, start_line, end_line, qualified AS symbol FROM o WHERE n = 1 QUALIFY place <= 30"""
)
def scaffold_round_robin(spark, sf_dir):
    found = evaluate.scaffold(symbol_rows(spark, sf_dir))
    return found.select(F.col("place").cast("long").alias("place"), "path", "start_line", "end_line", "symbol")


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as Python files of at most 100 functions, three lines each."""
    p = read(spark, sf_dir, "part")
    body = F.concat(F.lit("def part_"), F.col("p_partkey").cast("string"), F.lit("(x):\n    return size_"), F.col("p_size").cast("string"), F.lit("(x)\n\n"))
    path = F.concat(F.lit("f"), F.expr("p_partkey div 100").cast("string"), F.lit(".py"))
    # Files pack to little in a shuffle and cost much to cut: parts by number, which adaptive execution would take for too small.
    dealt = p.select(path.alias("path"), "p_partkey", body.alias("b")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    rows = dealt.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "b"))).alias("r"))
    return rows.select("path", F.lit("python").alias("lang"), F.array_join(F.transform("r", lambda x: x["b"]), "").alias("content"))


SQL_FUNCTIONS = """WITH functions AS (
  SELECT 'f' || (p_partkey // 100) || '.py' AS path, 'part_' || p_partkey AS name, 'size_' || p_size AS callee,
    row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) - 1 AS k
  FROM part
) """


@query(
    SQL_FUNCTIONS
    + """SELECT path, CAST(3 * k + 1 AS INT) AS start_line, CAST(3 * k + 2 AS INT) AS end_line, name AS symbol,
    'def ' || name || '(x):' || chr(10) || '    return ' || callee || '(x)' AS text FROM functions"""
)
def ast_chunks(spark, sf_dir):
    from .sources import syntax

    return syntax.chunks(source_rows(spark, sf_dir)).select("path", "start_line", "end_line", "symbol", "text")


@query(SQL_FUNCTIONS + "SELECT path, name AS qualified, 'callable' AS kind, CAST(3 * k + 1 AS INT) AS start_line, CAST(3 * k + 2 AS INT) AS end_line FROM functions")
def ast_symbols(spark, sf_dir):
    from .sources import syntax

    symbols, _ = syntax.symbols_and_calls(source_rows(spark, sf_dir))
    return symbols.select("path", "qualified", "kind", "start_line", "end_line")


@query(SQL_FUNCTIONS + "SELECT path, name AS caller, callee, CAST(3 * k + 2 AS INT) AS line FROM functions")
def ast_calls(spark, sf_dir):
    from .sources import syntax

    symbols, calls = syntax.symbols_and_calls(source_rows(spark, sf_dir))
    by = symbols.select(F.col("id").alias("caller_id"), F.col("qualified").alias("caller"))
    return calls.join(by, "caller_id").select("path", "caller", "callee", "line")


#: Six lines a part in each language: a container's line, a callable's four, an end. Go's methods stand by themselves.
#: Braces in comments, strings, characters, templates and raw strings are traps.
SNIPPETS = {
    "javascript": ("js", "class Box_{n} {{ // {{\n  part_{n}(x) {{\n    const s = `}} ${{x}} {{`;\n    return size_{m}(x);\n  }}\n}}\n"),
    "typescript": ("ts", "export class Box_{n} {{\n  part_{n}(x: string): Array<{{a: number}}> {{\n    const s = '}}' + /[{{]/.source;\n    return size_{m}(x);\n  }}\n}}\n"),
    "rust": ("rs", "impl<'a> Box_{n}<'a> {{ /* {{ /* */ */\n    fn part_{n}(&self, x: &'a str) -> u8 {{\n        let s = ('{{', r#\"}} \" {{\"#);\n        size_{m}(x)\n    }}\n}}\n"),
    "java": ("java", "class Box_{n} {{\n  int part_{n}(int x) throws E {{\n    String s = \"{{\" + '{{';\n    return size_{m}(x);\n  }}\n}}\n"),
    "csharp": ("cs", "class Box_{n} {{\n  public int part_{n}(int x) {{\n    var s = @\"{{\"\"\";\n    return size_{m}(x);\n  }}\n}}\n"),
    "cpp": ("cpp", "struct Box_{n} {{\n  int part_{n}(int x) const {{\n    auto s = R\"({{)\";\n    return size_{m}(x);\n  }}\n}};\n"),
    "go": ("go", "// {{\nfunc (b *Box) part_{n}(x interface{{}}) int {{\n\ts := `{{`\n\treturn size_{m}(x)\n}}\n\n"),
}


def brace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files of at most 100 snippets, each file in one of the brace languages."""
    p = read(spark, sf_dir, "part").withColumn("file", F.expr("p_partkey div 100"))
    path, lang, body = F.lit(None), F.lit(None), F.lit(None)
    for i, (name, (ending, text)) in enumerate(SNIPPETS.items()):
        pieces = text.replace("{n}", "\0n\0").replace("{m}", "\0m\0").format().split("\0")
        filled = F.concat(*[F.col("p_partkey").cast("string") if x == "n" else F.col("p_size").cast("string") if x == "m" else F.lit(x) for x in pieces])
        here = F.col("file") % len(SNIPPETS) == i
        path = F.when(here, F.concat(F.lit("b"), F.col("file").cast("string"), F.lit("." + ending))).otherwise(path)
        lang, body = F.when(here, name).otherwise(lang), F.when(here, filled).otherwise(body)
    rows = p.groupBy(path.alias("path"), lang.alias("lang")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", body.alias("b")))).alias("r"))
    return rows.select("path", "lang", F.array_join(F.transform("r", lambda x: x["b"]), "").alias("content"))


SQL_BOXES = f"""WITH boxes AS (
  SELECT 'b' || (p_partkey // 100) || '.' || {[e for e, _ in SNIPPETS.values()]!r}[(p_partkey // 100) % {len(SNIPPETS)} + 1] AS path,
    p_partkey AS n, p_size AS m, 6 * (row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) - 1) AS before
  FROM part
), parts AS (
  SELECT *, CASE WHEN path LIKE '%.go' THEN '' ELSE 'Box_' || n || '.' END || 'part_' || n AS name FROM boxes
) """


@query(
    SQL_BOXES
    + """SELECT path, name AS qualified, 'callable' AS kind, CAST(before + 2 AS INT) AS start_line, CAST(before + 5 AS INT) AS end_line FROM parts
    UNION ALL SELECT path, 'Box_' || n, 'container', CAST(before + 1 AS INT), CAST(before + 6 AS INT) FROM parts WHERE path NOT LIKE '%.go'"""
)
def brace_symbols(spark, sf_dir):
    from .sources import syntax

    symbols, _ = syntax.symbols_and_calls(brace_rows(spark, sf_dir))
    return symbols.select("path", "qualified", "kind", "start_line", "end_line")


@query(SQL_BOXES + "SELECT path, name AS caller, 'size_' || m AS callee, CAST(before + 4 AS INT) AS line FROM parts")
def brace_calls(spark, sf_dir):
    from .sources import syntax

    symbols, calls = syntax.symbols_and_calls(brace_rows(spark, sf_dir))
    by = symbols.select(F.col("id").alias("caller_id"), F.col("qualified").alias("caller"))
    return calls.join(by, "caller_id").select("path", "caller", "callee", "line")


@query(
    SQL_BOXES
    + """SELECT path, CAST(before + 2 AS INT) AS start_line, CAST(before + 5 AS INT) AS end_line, name AS symbol FROM parts
    UNION ALL SELECT path, CAST(before + 1 AS INT), CAST(before + 1 AS INT), 'Box_' || n || ' (decl)' FROM parts WHERE path NOT LIKE '%.go'
    UNION ALL SELECT path, CAST(before + 1 AS INT), CAST(before + 1 AS INT), '<module>' FROM parts WHERE path LIKE '%.go'"""
)
def brace_chunks(spark, sf_dir):
    from .sources import syntax

    return syntax.chunks(brace_rows(spark, sf_dir)).select("path", "start_line", "end_line", "symbol")


@query(
    """WITH p AS (SELECT p_partkey, 'h' || (p_partkey // 50) || '.php' AS path, p_size * 4 + 2 AS n FROM part),
    b AS (SELECT path, 'function part_' || p_partkey AS symbol, n, 2 + sum(n) OVER (PARTITION BY path ORDER BY p_partkey) - n AS start FROM p)
    SELECT path, CAST(start AS INT) AS start_line, CAST(start + n - 1 AS INT) AS end_line, symbol FROM b WHERE n <= 120
    UNION ALL SELECT path, CAST(start + i AS INT), CAST(start + least(i + 80, n) - 1 AS INT), symbol || ' (part)' FROM (SELECT *, unnest(range(0, n, 65)) AS i FROM b WHERE n > 120)
    UNION ALL SELECT DISTINCT path, 1, 1, '<module-preamble>' FROM b"""
)
def heuristic_chunks(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    body = F.concat(F.lit("function part_"), F.col("p_partkey").cast("string"), F.lit("(x) {\n"), F.expr("repeat('  step;\\n', int(p_size) * 4)"), F.lit("}\n"))
    path = F.concat(F.lit("h"), F.expr("p_partkey div 50").cast("string"), F.lit(".php"))
    # Files pack to little in a shuffle and cost much to cut: parts by number, which adaptive execution would take for too small.
    dealt = p.select(path.alias("path"), "p_partkey", body.alias("b")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    rows = dealt.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "b"))).alias("r"))
    files = rows.select("path", F.lit("php").alias("lang"), F.concat(F.lit("<?php\n"), F.array_join(F.transform("r", lambda x: x["b"]), "")).alias("content"))
    return chunking.heuristic_chunks(files).select("path", "start_line", "end_line", "symbol")


@query(
    _with(SQL_LINES)
    + """SELECT chunk_id, CAST(i + 1 AS INT) AS start_line, CAST(least(i + 80, len(l)) AS INT) AS end_line, md5(array_to_string(l[i + 1:i + 80], chr(10))) AS digest
    FROM (SELECT chunk_id, l, unnest(range(0, len(l), 65)) AS i FROM lined)"""
)
def file_windows(spark, sf_dir):
    rows = chunk_rows(spark, sf_dir).select("chunk_id", T.lines(F.col("text")).alias("lines"))
    return chunking.windows(rows).select("chunk_id", "start_line", "end_line", F.md5("text").alias("digest"))


@query(_with(SQL_CHUNKS) + "SELECT chunk_id, path FROM chunks WHERE path LIKE 'src1/%' OR path LIKE 'src2/%5'")
def ignored_paths(spark, sf_dir):
    from .sources.files import ignored

    return chunk_rows(spark, sf_dir).select("chunk_id", "path").where(ignored(F.col("path"), ["src1/", "src2/*5"]))


@query(
    _with(SQL_MANIFESTS)
    + f""", status AS (SELECT path, {SQL_STATUS} AS status FROM before b FULL JOIN after a USING (path))
    SELECT chunk_id, path, 'kept' AS state FROM chunks WHERE path IN (SELECT path FROM before) AND path NOT IN (SELECT path FROM status WHERE status IN ('changed', 'deleted'))
    UNION ALL SELECT chunk_id, path, 'fresh' FROM (SELECT chunk_id, path FROM chunks UNION ALL SELECT chunk_id, path || '.new' FROM chunks)
    WHERE path IN (SELECT path FROM status WHERE status IN ('added', 'changed'))"""
)
def incremental_refresh(spark, sf_dir):
    before, after = manifests(spark, sf_dir)
    status = snapshot.snapshot_diff(before, after)
    rows = chunk_rows(spark, sf_dir).select("chunk_id", "path")
    old = rows.join(before.select("path"), "path", "left_semi").withColumn("state", F.lit("kept"))
    grown = rows.unionByName(rows.withColumn("path", F.concat("path", F.lit(".new"))))
    fresh = grown.join(status.where("status in ('added', 'changed')"), "path", "left_semi").withColumn("state", F.lit("fresh"))
    return snapshot.replace_paths(old, status.where("status in ('changed', 'deleted')"), fresh).select("chunk_id", "path", "state")


@query(_with(SQL_MANIFESTS) + "SELECT path, hash FROM after")
def segmented_store(spark, sf_dir):
    """A manifest in segments: the state before, then one segment of what differs, with tombstones; read as one table."""
    from .scratch import new_path
    from .sources.store import Store

    before, after = manifests(spark, sf_dir)
    status = stored(snapshot.snapshot_diff(before, after), "status")
    store = Store(spark, new_path(spark, "store"))
    store.publish({"manifest": before}, "f")
    gone = status.where("status in ('changed', 'deleted')").select("path")
    fresh = after.join(status.where("status in ('added', 'changed')").select("path"), "path", "left_semi")
    store.publish({"manifest": fresh}, "f", {"paths": gone, "stats": gone})
    return store.require("manifest")


# Orders, counts and texts of the surfaces ------------------------------------------


@query(
    SQL_GRAPH
    + f"""SELECT row_number() OVER (ORDER BY path, line, caller_id) AS place, coalesce(qualified, '<module>') AS caller, e.path, e.line
    FROM (SELECT DISTINCT caller_id, path, line FROM edges WHERE target IN {SQL_FOUND}) e LEFT JOIN (SELECT id AS caller_id, qualified FROM symbols) s USING (caller_id)"""
)
def callers_listed(spark, sf_dir):
    """Call sites in the order in which they are listed."""
    from pyspark.sql import Window as W

    s = symbol_rows(spark, sf_dir)
    sites = graph.callers(linked_rows(spark, sf_dir), s, graph.find(s, "small ring"))
    named = sites.join(s.select(F.col("id").alias("caller_id"), "qualified"), "caller_id", "left")
    place = F.row_number().over(W.orderBy("path", "line", "caller_id")).cast("long")
    return named.select(place.alias("place"), F.coalesce("qualified", F.lit("<module>")).alias("caller"), "path", "line")


@query(SQL_GRAPH + sql_impact(SQL_ROOT, 3) + "SELECT row_number() OVER (ORDER BY depth, path, call_line, node_key) AS place, node_key, depth FROM nodes")
def impact_listed(spark, sf_dir):
    """Impact rows in the order in which they are listed."""
    from pyspark.sql import Window as W

    found = traverse.impact(_root(spark), symbol_rows(spark, sf_dir), linked_rows(spark, sf_dir), 3)
    place = F.row_number().over(W.orderBy("depth", "path", "call_line", "node_key")).cast("long")
    return found.select(place.alias("place"), "node_key", "depth")


@query(
    SQL_GRAPH
    + sql_impact(SQL_ROOT, 3)
    + "SELECT depth, count(*) AS nodes, count(*) FILTER (uncertain) AS uncertain, count(*) FILTER (is_test) AS tests FROM nodes GROUP BY depth"
)
def impact_counts(spark, sf_dir):
    """Nodes, uncertain ones and tests at each depth."""
    found = traverse.impact(_root(spark), symbol_rows(spark, sf_dir), linked_rows(spark, sf_dir), 3)
    return found.groupBy("depth").agg(F.count("*").alias("nodes"), F.count_if("uncertain").alias("uncertain"), F.count_if("is_test").alias("tests"))


@query(SQL_FUSED + "SELECT 'lexical' AS mode, chunk_id, rank FROM lex UNION ALL SELECT 'vector', chunk_id, rank FROM vec UNION ALL SELECT 'hybrid', chunk_id, fused_rank FROM placed WHERE fused_rank <= 100")
def first_stages(spark, sf_dir):
    """The first stage of a retrieval in each of its modes, to its depth."""
    from .plans.retrieve import first_stages as stages

    depth, _ = fusion.pools(K, rerank=True)
    chunks = chunk_rows(spark, sf_dir).withColumn("embedding", V.hash_embedding(F.col("text")))
    one = spark.range(1).select(V.hash_embedding(F.lit(QUERY)).alias("q")).first()[0]
    out = None
    for mode, best in stages(chunks, QUERY, list(one), depth).items():
        found = best.select(F.lit(mode).alias("mode"), "chunk_id", F.col("fused_rank").cast("long").alias("rank"))
        out = found if out is None else out.unionByName(found)
    return out


@query(
    _with(SQL_LINES, SQL_INDEX)
    + SQL_HITS
    + "SELECT rank, round(score, 6) AS score, path || ':' || start_line || '-' || end_line || ' (' || symbol || ')' AS locator FROM hits"
)
def hits_listed(spark, sf_dir):
    """Hits as they are shown: rounded scores and locators."""
    at = T.locator(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("symbol"))
    return _context_hits(spark, sf_dir).select(F.col("rank").cast("long").alias("rank"), _round("score").alias("score"), at.alias("locator"))


@query("""SELECT repo, arg_min(prefix, (-mrr, place)) AS prefix, max(mrr) AS mrr FROM (
      SELECT p_brand AS repo, p_partkey AS place, p_type AS prefix, p_size / 50.0::DOUBLE AS mrr FROM part) GROUP BY repo""")
def best_prefix(spark, sf_dir):
    """Each brand's type of the largest size stands for each tree's prefix of the highest MRR: first on ties."""
    p = read(spark, sf_dir, "part")
    reports = p.select(F.col("p_brand").alias("repo"), F.col("p_partkey").alias("place"), F.col("p_type").alias("prefix"), (F.col("p_size") / 50.0).alias("mrr"))
    return evaluate.best_prefix(reports)


@query(
    _with(SQL_LINES)
    + f"""SELECT chunk_id, scheme, md5(before || path || ':1-' || len(l) || ' (' || symbol || ')' || chr(10) || text) AS digest
    FROM chunks JOIN lined USING (chunk_id) CROSS JOIN (VALUES {", ".join(f"('{k}', '{p}')" for k, (_, p) in T.PREFIXES.items())}) s(scheme, before)"""
)
def prefixed_texts(spark, sf_dir):
    """What an embedder is given of each chunk under each prefix scheme."""
    rows = chunk_rows(spark, sf_dir)
    text = T.embedding_text(F.col("path"), F.lit(1), F.size(T.lines(F.col("text"))), F.col("symbol"), F.col("text"))
    schemes = F.array(*[F.struct(F.lit(k).alias("scheme"), F.lit(p).alias("before")) for k, (_, p) in T.PREFIXES.items()])
    given = rows.select("chunk_id", text.alias("t"), F.inline(schemes))
    return given.select("chunk_id", "scheme", F.md5(F.concat("before", "t")).alias("digest"))
