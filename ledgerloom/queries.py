"""Registry of the library's queries over the driver tables, each with the SQL that checks it.

`events` stands for an event log (project: user), `conversations` for
conversation events, `documents` for search documents and source blobs,
`labels` for required evidence, `pages` for file paths, and the star schema for
a typed property graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import canonical as can
from ledgerloom.functions import text as txt
from ledgerloom.operators import blobs, codegraph, events, extract, graph, history, memory, search
from ledgerloom.plans import kernels, star
from ledgerloom.session import shared_dir
from ledgerloom.sources import archive
from ledgerloom.streaming import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# ---------------------------------------------------------------- histories

_LOG = "log AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"


def event_log(spark: SparkSession, d: str) -> DataFrame:
    return history.with_sequence(table(spark, d, "events"), "user_id", "ts", "event_id", name="seq")


@query("""
WITH t AS (SELECT conv_id, turn + 1 AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations)
SELECT conv_id, count(*) AS n_events, min(s) AS first_sequence, max(s) AS last_sequence, CAST(sum(CASE WHEN s <> place THEN 1 ELSE 0 END) AS BIGINT) AS n_broken,
sum(CASE WHEN s <> place THEN 1 ELSE 0 END) = 0 AS contiguous FROM t GROUP BY conv_id""")
def event_sequence_audit(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "conversations").withColumn("s1", F.col("turn") + 1)
    return history.sequence_audit(log, "conv_id", "s1")


@query(f"""
WITH {_LOG},
a AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS active FROM log)
SELECT user_id, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'signup') AS n_sessions, count(*) FILTER (WHERE active IS NULL) AS n_outside,
arg_max(CASE WHEN event_type = 'signup' THEN event_id ELSE active END, seq) AS active_session FROM a GROUP BY user_id""")
def active_session_fold(spark: SparkSession, d: str) -> DataFrame:
    starts = F.col("event_type") == "signup"
    held = history.active_session(event_log(spark, d), "user_id", "seq", F.col("event_id"), starts)
    now = F.max_by(F.struct(F.when(starts, F.col("event_id")).otherwise(F.col("active_session")).alias("s")), "seq")["s"]
    return held.groupBy("user_id").agg(F.count("*").alias("n_events"), F.count_if(starts).alias("n_sessions"), F.count_if(F.col("active_session").isNull()).alias("n_outside"), now.alias("active_session"))


@query(f"""
WITH {_LOG}
SELECT user_id, max(seq) AS last_sequence, arg_max(event_type, seq) AS last_type, arg_max(event_id, seq) AS last_event, round(sum(value), 4) AS total FROM log WHERE seq <= 20 GROUP BY user_id""")
def state_as_of(spark: SparkSession, d: str) -> DataFrame:
    log = history.as_of(event_log(spark, d), "seq", 20)
    return log.groupBy("user_id").agg(F.max("seq").alias("last_sequence"), F.max_by("event_type", "seq").alias("last_type"), F.max_by("event_id", "seq").alias("last_event"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""
WITH {_LOG}
SELECT user_id, event_type, event_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY seq DESC) AS r FROM log) WHERE r = 1 AND event_type <> 'error'""")
def latest_observation_per_path(spark: SparkSession, d: str) -> DataFrame:
    last = history.latest_per(event_log(spark, d), ["user_id", "event_type"], "seq", tombstone=F.col("event_type") == "error")
    return last.select("user_id", "event_type", "event_id", "seq")


@query("""
SELECT o_custkey, o_orderkey, row_number() OVER w AS valid_from, lead(o_orderkey) OVER w AS superseded_by, CASE WHEN lead(o_orderkey) OVER w IS NOT NULL THEN row_number() OVER w + 1 END AS valid_to
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def scd2_supersession(spark: SparkSession, d: str) -> DataFrame:
    log = history.with_sequence(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey", name="seq")
    return history.validity(log, "o_custkey", "seq", "o_orderkey").select("o_custkey", "o_orderkey", "valid_from", "superseded_by", "valid_to")


@query("""
WITH s AS (SELECT o_custkey, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'in_progress' ELSE 'completed' END AS st, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
p AS (SELECT lag(st) OVER (PARTITION BY o_custkey ORDER BY n) AS before, st AS after FROM s)
SELECT before, after, before IN ('active', 'in_progress') AND before <> after AND after IN ('in_progress', 'completed', 'cancelled') AS allowed, count(*) AS n FROM p WHERE before IS NOT NULL GROUP BY ALL""")
def status_transition_check(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("completed")
    log = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", status.alias("after"))
    pairs = log.withColumn("before", F.lag("after").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).where("before is not null")
    return pairs.select("before", "after", history.transition_allowed(F.lit("task"), F.col("before"), F.col("after")).alias("allowed")).groupBy("before", "after", "allowed").agg(F.count("*").alias("n"))


@query("""
SELECT conv_id, turn + 1 AS sequence, CASE role WHEN 'user' THEN 'conversation.user_message' WHEN 'assistant' THEN 'conversation.assistant_message' END AS event_type,
CAST(ceil(octet_length(encode(text)) / 4) AS BIGINT) AS tokens, sha256(text) AS content_hash FROM conversations WHERE role IN ('user', 'assistant')""")
def conversation_source_events(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    kind = F.when(F.col("role") == "user", "conversation.user_message").when(F.col("role") == "assistant", "conversation.assistant_message")
    return c.select("conv_id", (F.col("turn") + 1).alias("sequence"), kind.alias("event_type"), txt.token_cost(F.col("text")).alias("tokens"), F.sha2("text", 256).alias("content_hash")).where("event_type is not null")


@query("""
SELECT l_orderkey, count(*) AS n_lines FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderdate < l.l_shipdate) GROUP BY l_orderkey""")
def provenance_missing(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return history.missing_provenance(lines, orders, "l_orderkey", "o_orderkey", F.col("o_orderdate") < F.col("l_shipdate")).groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))


@query("""
WITH RECURSIVE e AS (SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
r(seed, node, hops) AS (SELECT 'o' || o_orderkey, 'o' || o_orderkey, 0 FROM orders UNION SELECT r.seed, e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.node)
SELECT seed, node, hops FROM r""")
def provenance_closure(spark: SparkSession, d: str) -> DataFrame:
    up = star.edges(spark, d, "PLACED_BY", "LIVES_IN", "PART_OF")
    seeds = table(spark, d, "orders").select(star.node("o", F.col("o_orderkey")).alias("node"))
    return history.closure(up, seeds)


@query("""
SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS n_puts, CAST(max(octet_length(encode(text))) AS BIGINT) AS byte_length FROM documents GROUP BY sha256(text)""")
def blob_put_dedup(spark: SparkSession, d: str) -> DataFrame:
    return blobs.put(table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content")), "doc_id", "content")


@query("""
SELECT doc_id, sha256(text) AS content_hash, CASE doc_id % 5 WHEN 1 THEN 'length' WHEN 2 THEN 'hash' WHEN 3 THEN 'missing' ELSE 'valid' END AS state FROM documents WHERE text IS NOT NULL AND length(text) > 0""")
def blob_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Stored blobs of documents, of which some have another length, another content, or are gone."""
    docs = table(spark, d, "documents").where("length(text) > 0").select("doc_id", F.col("text").cast("binary").alias("content"))
    hash_, fault = F.sha2("content", 256), F.col("doc_id") % 5
    wanted = docs.select("doc_id", hash_.alias("content_hash"))
    stored = docs.where(fault != 3).select("doc_id", hash_.alias("content_hash"), (F.octet_length("content") + (fault == 1).cast("int")).cast("long").alias("byte_length"), F.when(fault == 2, F.concat(F.lit(b"x"), F.substring("content", 2, 1 << 30))).otherwise(F.col("content")).alias("content"))
    # a first byte x would leave the content as it was
    stored = stored.withColumn("content", F.when((fault == 2) & (F.sha2("content", 256) == F.col("content_hash")), F.concat(F.lit(b"y"), F.substring("content", 2, 1 << 30))).otherwise(F.col("content")))
    return wanted.join(stored.select("doc_id", blobs.state("content", "content_hash", "byte_length").alias("state")), "doc_id", "left").select("doc_id", "content_hash", F.coalesce("state", F.lit("missing")).alias("state"))


_ENVELOPE = """'{"created_at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(CAST(floor(extract(microseconds FROM ts) / 1000) AS BIGINT) % 1000 AS VARCHAR), 3, '0') || 'Z","event_id":' || event_id || ',"event_type":"' || event_type || '","project_id":' || user_id || '}'"""


@query(f"""
SELECT event_id, sha256({_ENVELOPE}) AS content_hash, sha256('{can.TAG}:event:v1:' || sha256({_ENVELOPE})) AS id FROM events""")
def event_identity_hash(spark: SparkSession, d: str) -> DataFrame:
    created = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    text = can.canonical_object(created_at=can.quoted(created), event_id=can.integer(F.col("event_id")), event_type=can.quoted(F.col("event_type")), project_id=can.integer(F.col("user_id")))
    hashed = table(spark, d, "events").select("event_id", F.sha2(text, 256).alias("content_hash"))
    return hashed.withColumn("id", can.event_id_column(F.col("content_hash")))


@query("""
WITH r AS (SELECT 'region' AS name, sha256(r_regionkey || '|' || r_name) AS h FROM region UNION ALL SELECT 'nation', sha256(n_nationkey || '|' || n_name || '|' || n_regionkey) FROM nation)
SELECT name, count(*) AS n_rows, sha256(string_agg(h, ',' ORDER BY h)) AS digest FROM r GROUP BY name""")
def dataset_digest(spark: SparkSession, d: str) -> DataFrame:
    region = table(spark, d, "region").select(F.lit("region").alias("name"), F.concat_ws("|", F.col("r_regionkey").cast("string"), "r_name").alias("row"))
    nation = table(spark, d, "nation").select(F.lit("nation").alias("name"), F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")).alias("row"))
    return region.unionByName(nation).groupBy("name").agg(F.count("*").alias("n_rows"), can.dataset_digest(F.col("row")).alias("digest"))


# ---------------------------------------------------------------- search


@query(r"""
WITH n AS (SELECT p_partkey, lower(regexp_replace(regexp_replace(p_type || p_brand || ' ' || p_name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')) AS s FROM part),
w AS (SELECT p_partkey, list_filter(flatten(list_transform(regexp_extract_all(s, '[a-z0-9_]+'), lambda x: string_split(x, '_'))), lambda x: x <> '') AS t FROM n)
SELECT p_partkey, list_filter(t, lambda x, i: list_position(t, x) = i) AS terms FROM w""")
def lexical_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", txt.terms_of(F.concat("p_type", "p_brand", F.lit(" "), "p_name")).alias("terms"))


_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@query(f"""
WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY term""")
def postings_stats(spark: SparkSession, d: str) -> DataFrame:
    return search.term_statistics(search.postings(table(spark, d, "documents"), "doc_id", "text"))


def _bm25_sql(terms: tuple[str, ...]) -> str:
    """BM25 over documents for a few terms, as common table expressions that end in `hits`."""
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""k AS (SELECT doc_id, {_TOKENS} AS tokens FROM documents), c AS (SELECT CAST(count(*) AS DOUBLE) AS n_docs, avg(len(tokens)) AS avgdl FROM k),
f AS (SELECT doc_id, CAST(len(tokens) AS DOUBLE) AS dl, term, CAST(len(list_filter(tokens, lambda x: x = term)) AS DOUBLE) AS tf FROM k, (SELECT unnest([{listed}]) AS term)),
df AS (SELECT term, CAST(count(*) FILTER (WHERE tf > 0) AS DOUBLE) AS df FROM f GROUP BY term),
hits AS (SELECT doc_id, -sum(CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM f JOIN df USING (term), c WHERE tf > 0 GROUP BY doc_id)"""


SINGLE, MULTI = ("reth",), ("reth", "inst", "anly", "sch", "que")


def search_index(spark: SparkSession, d: str) -> search.SearchIndex:
    """The stored index of documents, brought up to date."""
    path = f"{shared_dir(spark)}/search-index-{can.sha256(d)[:16]}"
    search.ensure_index(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", path)
    return search.open_index(spark, path)


@query(f"WITH {_bm25_sql(SINGLE)} SELECT doc_id, round(score, 9) AS score FROM hits ORDER BY hits.score, doc_id LIMIT 20")
def bm25_topk_single(spark: SparkSession, d: str) -> DataFrame:
    """Without an index: one pass over the texts."""
    hits = search.bm25(table(spark, d, "documents"), "doc_id", "text", SINGLE)
    return search.top(hits, 20, "score", "doc_id").select("doc_id", F.round("score", 9).alias("score"))


@query(f"WITH {_bm25_sql(MULTI)} SELECT doc_id, round(score, 9) AS score FROM hits ORDER BY hits.score, doc_id LIMIT 20")
def bm25_topk_multi(spark: SparkSession, d: str) -> DataFrame:
    return search.top(search_index(spark, d).bm25(MULTI), 20, "score", "doc_id").select("doc_id", F.round("score", 9).alias("score"))


@query(f"WITH {_bm25_sql(MULTI)} SELECT doc_id, round(score, 9) AS score FROM hits")
def bm25_index_scan(spark: SparkSession, d: str) -> DataFrame:
    return search_index(spark, d).bm25(MULTI).select("doc_id", F.round("score", 9).alias("score"))


#: Queries of the channels, with their phrases and words.
NAMED = ("promo.hot_ring", "why is ECONOMY.red_widget like Small", "Part-4", "part-9 or LARGE")


@query("""
WITH q(n, phrase, words) AS (VALUES (0, 'promo.hot_ring', ['promo.hot_ring']), (1, 'why is economy.red_widget like small', ['why', 'is', 'economy.red_widget', 'like', 'small']), (2, 'part-4', ['part-4']), (3, 'part-9 or large', ['part-9', 'or', 'large'])),
s AS (SELECT p_partkey, lower(p_type) AS name, lower(p_type || '.' || replace(p_name, ' ', '_')) AS qualified, 'part-' || p_partkey AS id, CASE WHEN p_size <= 5 THEN 'module' WHEN p_size <= 20 THEN 'function' ELSE 'variable' END AS kind FROM part)
SELECT n AS query, p_partkey FROM s, q WHERE id = phrase OR (kind <> 'module' AND phrase IN (name, qualified)) OR (kind = 'function' AND (list_contains(words, name) OR list_contains(words, qualified) OR list_contains(words, id)))""")
def exact_channel(spark: SparkSession, d: str) -> DataFrame:
    """Parts as symbols: type as name, type and name as qualified name, small ones as modules, middle ones as functions."""
    part = table(spark, d, "part").select("p_partkey", "p_type", F.concat("p_type", F.lit("."), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("qualified"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("id"), "p_size")
    out: DataFrame | None = None
    for n, text in enumerate(NAMED):
        q = txt.normalize_query(text)
        found = search.exact(part, q.phrase, q.words, [F.col("p_type"), F.col("qualified")], [F.col("id")], F.col("p_size").between(6, 20), F.col("p_size") <= 5).select(F.lit(n).alias("query"), "p_partkey")
        out = found if out is None else out.unionByName(found)
    return out


@query("""
SELECT page_id, url, lower(url) = 'example.org/en/6' AS whole FROM pages WHERE contains(lower(url), 'example.org/en/6')
UNION ALL SELECT page_id, url, lower(url) = 'http://ththre.example.com/fr/825?page=2&ref=x' FROM pages WHERE contains(lower(url), 'http://ththre.example.com/fr/825?page=2&ref=x')""")
def path_channel(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url")
    part, whole = (txt.normalize_query(text).phrase for text in ("EXAMPLE.org\\en/6", "http://ththre.example.com/fr/825?page=2&ref=x"))
    return search.containing_path(pages, "url", part).unionByName(search.containing_path(pages, "url", whole))


@query(r"""
WITH o AS (SELECT p_partkey AS id, len(list_intersect(regexp_extract_all(lower(p_name), '[a-z0-9]+'), ['which', 'small', 'red', 'bolt', 'or', 'ring'])) AS overlap FROM part WHERE p_size BETWEEN 6 AND 20)
SELECT id, CAST(overlap AS BIGINT) AS overlap FROM o WHERE overlap > 0""")
def symbol_terms_channel(spark: SparkSession, d: str) -> DataFrame:
    q = txt.normalize_query("which small red bolt or ring")
    return search.term_overlap(table(spark, d, "part").where(F.col("p_size").between(6, 20)), "p_partkey", "p_name", q.terms)


_STATE = """m AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'goal' WHEN '2' THEN 'task' WHEN '3' THEN 'blocker' WHEN '4' THEN 'result' ELSE 'action' END AS kind, o_orderstatus IN ('O', 'P') AS open FROM orders),
p AS (SELECT *, list_position(['goal', 'task', 'constraint', 'blocker', 'decision', 'result', 'question'], kind) AS place FROM m WHERE (open OR kind = 'result') AND o_custkey = 7 OR (open AND kind IN ('goal', 'blocker') AND o_orderdate > TIMESTAMP '2000-01-01' AND o_custkey < 40)),
t AS (SELECT *, row_number() OVER (ORDER BY place, o_orderdate DESC, o_orderkey) AS rank FROM p WHERE place IS NOT NULL QUALIFY rank <= 30)"""


@query(f"""WITH {_STATE} SELECT 'project_state' AS channel, o_orderkey AS id, kind, rank FROM t
UNION ALL SELECT 'continue', o_orderkey, kind, row_number() OVER (ORDER BY rank) FROM t WHERE o_custkey % 2 = 1""")
def project_state_channel(spark: SparkSession, d: str) -> DataFrame:
    """Orders as memory: priority as type, open orders and results are current; the second list keeps the order of one session's."""
    kind = F.element_at(F.create_map(*map(F.lit, ("1", "goal", "2", "task", "3", "blocker", "4", "result", "5", "action"))), F.substring("o_orderpriority", 1, 1))
    m = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", kind.alias("kind"), F.col("o_orderstatus").isin("O", "P").alias("open"))
    m = m.where(((F.col("open") | (F.col("kind") == "result")) & (F.col("o_custkey") == 7)) | (F.col("open") & F.col("kind").isin("goal", "blocker") & (F.col("o_orderdate") > F.lit("2000-01-01").cast("timestamp")) & (F.col("o_custkey") < 40)))
    state = search.project_state(m, "kind", "o_orderdate", "o_orderkey", F.lit(True))
    place = F.array_position(F.array(*map(F.lit, search.STATE_ORDER)), F.col("kind"))
    order = (place, F.col("o_orderdate").desc(), F.col("o_orderkey"))
    lists = [search.ranked(x, channel, "o_orderkey", *order) for channel, x in (("project_state", state), ("continue", state.where("o_custkey % 2 = 1")))]
    return lists[0].unionByName(lists[1]).join(F.broadcast(state.select(F.col("o_orderkey").alias("id"), "kind")), "id").select("channel", "id", "kind", "rank")  # 30 rows


_LISTS = f"""{_bm25_sql(MULTI)}, b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score, doc_id) AS rank FROM (SELECT * FROM hits ORDER BY score, doc_id LIMIT 200)),
ov AS (SELECT doc_id AS id, len(list_intersect({_TOKENS}, ['reth', 'inst', 'anly', 'sch', 'que', 'der', 'and'])) AS n FROM documents),
o AS (SELECT id, row_number() OVER (ORDER BY n DESC, id) AS rank FROM (SELECT * FROM ov WHERE n > 0 ORDER BY n DESC, id LIMIT 200)),
u AS (SELECT 'bm25_code' AS channel, id, rank FROM b UNION ALL SELECT 'symbol_terms', id, rank FROM o), fused AS (SELECT id, sum(1.0 / (60 + rank)) AS rrf, count(*) AS n_channels FROM u GROUP BY id)"""


def _lists(spark: SparkSession, d: str) -> DataFrame:
    index = search_index(spark, d)
    best = search.top(index.bm25(MULTI), 200, "score", "doc_id")
    most = search.top(index.overlap((*MULTI, "der", "and")), 200, F.col("n").desc(), "doc_id")
    return search.ranked(best, "bm25_code", "doc_id", F.col("score"), F.col("doc_id")).unionByName(search.ranked(most, "symbol_terms", "doc_id", F.col("n").desc(), F.col("doc_id")))


@query(f"WITH {_LISTS} SELECT id, round(rrf, 12) AS rrf, n_channels FROM fused")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return search.reciprocal_rank_fusion(_lists(spark, d)).select("id", F.round("rrf", 12).alias("rrf"), "n_channels")


@query(f"""WITH {_LISTS}, x AS (SELECT * FROM u UNION ALL SELECT 'explicit', id, rank FROM o WHERE rank IN (3, 60) UNION ALL SELECT 'exact', id, rank - 4 FROM b WHERE rank BETWEEN 5 AND 9 UNION ALL SELECT 'reverse_impact', id, rank FROM o WHERE rank <= 10),
all_ AS (SELECT id, sum(1.0 / (60 + rank)) AS rrf, list(channel) AS c FROM x GROUP BY id),
tiers AS (SELECT id, rrf, CASE WHEN list_contains(c, 'explicit') THEN 0 WHEN list_contains(c, 'exact') THEN 1 WHEN list_contains(c, 'reverse_impact') THEN 2 ELSE 3 END AS priority FROM all_),
top AS (SELECT * FROM tiers ORDER BY priority, rrf DESC, id LIMIT 50)
SELECT id, CAST(priority AS INTEGER) AS priority, round(rrf, 12) AS rrf, round(CASE WHEN priority < 2 THEN 1.0 ELSE rrf / (SELECT max(rrf) FROM top) END, 9) AS relevance FROM top""")
def ranked_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Two ranked lists, with some of their rows also explicit, exact, or reached by impact, so that every tier is there."""
    lists = _lists(spark, d)
    bm25, terms = F.col("channel") == "bm25_code", F.col("channel") == "symbol_terms"
    more = [
        lists.where(terms & F.col("rank").isin(3, 60)).withColumn("channel", F.lit("explicit")),
        lists.where(bm25 & F.col("rank").between(5, 9)).select(F.lit("exact").alias("channel"), "id", (F.col("rank") - 4).alias("rank")),
        lists.where(terms & (F.col("rank") <= 10)).withColumn("channel", F.lit("reverse_impact")),
    ]
    for m in more:
        lists = lists.unionByName(m)
    return search.candidates(search.reciprocal_rank_fusion(lists), 50).select("id", F.col("priority").cast("int").alias("priority"), F.round("rrf", 12).alias("rrf"), F.round("relevance", 9).alias("relevance"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return ranked_candidates(spark, d)


@query(f"""WITH {_LISTS}, g AS (SELECT id, row_number() OVER (ORDER BY rrf DESC, id) AS rank FROM fused),
r AS (SELECT lang, doc_id AS id FROM documents JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) USING (doc_id))
SELECT lang, count(*) AS n_required, round(avg(CASE WHEN coalesce(rank, 101) <= 100 THEN 1.0 ELSE 0.0 END), 9) AS recall_at_k, round(coalesce(1.0 / min(rank), 0), 9) AS mrr FROM r LEFT JOIN g USING (id) GROUP BY lang""")
def recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    fused = search.reciprocal_rank_fusion(_lists(spark, d))
    ranking = search.ranked(fused, "all", "id", F.col("rrf").desc(), F.col("id")).select("id", "rank")
    labels = table(spark, d, "labels").where("quality = 1").select("doc_id").distinct()
    required = table(spark, d, "documents").join(labels, "doc_id", "left_semi").select("lang", F.col("doc_id").alias("id"))
    langs = required.select("lang").distinct()
    out = search.retrieval_metrics(langs.crossJoin(F.broadcast(ranking)), required, "lang", 100)  # at most 400 ranks
    return out.select("lang", "n_required", F.round("recall_at_k", 9).alias("recall_at_k"), F.round("mrr", 9).alias("mrr"))


@query(f"""WITH {_LISTS}, q AS (SELECT DISTINCT doc_id AS id FROM labels WHERE quality = 1)
SELECT count(*) AS n_required, count(f.id) AS n_found, round(count(f.id) / count(*), 9) AS recall FROM q LEFT JOIN fused f USING (id)""")
def required_evidence_recall(spark: SparkSession, d: str) -> DataFrame:
    required = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    return search.required_recall(required, search.reciprocal_rank_fusion(_lists(spark, d))).withColumn("recall", F.round("recall", 9))


@query(r"""
WITH d AS (SELECT doc_id, source, list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT source, t, min(doc_id) AS id, count(*) AS n FROM d WHERE len(t) > 0 GROUP BY source, t),
x AS (SELECT a.source, a.id AS a, b.id AS b, a.n * b.n AS n_pairs, len(list_intersect(a.t, b.t)) AS o, len(a.t) + len(b.t) AS l FROM c a JOIN c b ON a.source = b.source AND a.id < b.id AND len(a.t) * 0.79 <= len(b.t) AND len(b.t) * 0.79 <= len(a.t))
SELECT source, a, b, n_pairs, round(o / (l - o), 9) AS similarity FROM x WHERE o / (l - o) >= 0.8""")
def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a source whose sets of words are alike; documents of one set are one, which n_pairs counts."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "source", F.array_sort(F.array_distinct(txt.search_tokens(F.col("text")))).alias("t"))
    one = docs.where(F.size("t") > 0).groupBy("source", "t").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    own = one.select("id", F.transform("t", lambda w: F.concat_ws(":", "source", w)).alias("t"))  # words of other sources never meet
    pairs = search.similar_pairs(own, "id", "t", 0.8)
    sizes = one.select("id", "source", "n")
    out = pairs.join(sizes.select(F.col("id").alias("a"), "source", F.col("n").alias("na")), "a").join(sizes.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("source", "a", "b", (F.col("na") * F.col("nb")).alias("n_pairs"), F.round("similarity", 9).alias("similarity"))


@query(r"""
WITH n AS (SELECT p_brand, p_type, p_name, min(p_partkey) AS id, min(p_partkey) % 40 AS first, list_sort(list(DISTINCT p_size % 6)) AS symbols, list_sort(list(DISTINCT p_size % 9)) AS events FROM part GROUP BY 1, 2, 3),
t AS (SELECT *, first + length(p_name) AS last, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS t, CASE WHEN first % 3 = 0 THEN [first % 5] ELSE [] END AS memory, CASE WHEN first % 4 > 0 THEN first % 2 END AS blob FROM n),
p AS (SELECT a.p_brand AS brand, a.id AS a, b.id AS b, a.memory = b.memory AND len(a.memory) > 0 AS same,
  CASE WHEN a.blob = b.blob THEN greatest(0, least(a.last, b.last) - greatest(a.first, b.first)) / greatest(1, least(a.last - a.first, b.last - b.first)) ELSE 0 END AS spans,
  0.9 * len(list_intersect(a.symbols, b.symbols)) / len(list_distinct(a.symbols || b.symbols)) AS s, 0.7 * len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t)) AS w, 0.3 * len(list_intersect(a.events, b.events)) / len(list_distinct(a.events || b.events)) AS e
  FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.id < b.id)
SELECT brand, a, b, round(CASE WHEN same THEN 1.0 ELSE greatest(spans, s, w, e, 0.15) END, 9) AS similarity FROM p""")
def evidence_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of distinct names of a brand and type (a few dozen at any size) as units, by all terms of the similarity."""
    n = table(spark, d, "part").groupBy("p_brand", "p_type", "p_name").agg(F.min("p_partkey").alias("id"), F.collect_set(F.col("p_size") % 6).alias("symbols"), F.collect_set(F.col("p_size") % 9).alias("events"))
    first = F.col("id") % 40
    unit = F.struct(
        "id", F.when(first % 3 == 0, F.array(first % 5)).otherwise(F.array().cast("array<bigint>")).alias("memory_ids"), F.when(first % 4 > 0, first % 2).alias("blob"), first.alias("first"), (first + F.char_length("p_name")).alias("last"),
        "symbols", txt.terms_of(F.col("p_name")).alias("terms"), "events", F.col("p_type").alias("path"),
    )
    units = n.select("p_brand", "p_type", "id", unit.alias("u"))
    a, b = units.select("p_brand", "p_type", F.col("u").alias("a")), units.select("p_brand", "p_type", F.col("u").alias("b"))
    pairs = a.join(b, ["p_brand", "p_type"]).where(F.col("a.id") < F.col("b.id"))
    return pairs.select(F.col("p_brand").alias("brand"), F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.round(search.evidence_similarity("a", "b"), 9).alias("similarity"))


@query("""SELECT doc_id, CAST(ceil(octet_length(encode(text)) / 4) AS BIGINT) AS tokens FROM documents""")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", txt.token_cost(F.col("text")).alias("tokens"))


# ---------------------------------------------------------------- graphs

_EDGES = """SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst, 'PLACED_BY' AS type FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'LIVES_IN' FROM customer
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'BASED_IN' FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'PART_OF' FROM nation"""


@query(f"""
WITH e AS ({_EDGES}), x AS (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e)
SELECT node, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM x GROUP BY node""")
def callers_callees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(star.edges(spark, d))


@query("""SELECT 'c' || c_custkey AS src FROM customer WHERE c_nationkey = 3""")
def definitions_of(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(star.edges(spark, d), "n3", "LIVES_IN", incoming=True).select("src")


@query(f"""
WITH RECURSIVE e AS ({_EDGES}), b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
r(node, hop) AS (SELECT 'r1', 0 UNION SELECT b.dst, r.hop + 1 FROM r JOIN b ON b.src = r.node WHERE r.hop < 3)
SELECT node, min(hop) AS hop FROM r GROUP BY node""")
def graph_bfs(spark: SparkSession, d: str) -> DataFrame:
    return graph.levels(star.edges(spark, d), star.seeds(spark, "r1"), 3, both=True)


@query(f"""
WITH RECURSIVE e AS ({_EDGES}), r(node, hop) AS (SELECT 'n4', 0 UNION SELECT e.src, r.hop + 1 FROM r JOIN e ON e.dst = r.node WHERE r.hop < 3 AND type IN ('LIVES_IN', 'PLACED_BY'))
SELECT node, min(hop) AS hop FROM r GROUP BY node""")
def impact_reach(spark: SparkSession, d: str) -> DataFrame:
    return graph.levels(star.edges(spark, d), star.seeds(spark, "n4"), 3, kinds=["LIVES_IN", "PLACED_BY"], reverse=True)


@query("""
SELECT 'r2' AS node, 0 AS hop, 'r2' AS path UNION ALL SELECT 'n' || n_nationkey, 1, 'r2>n' || n_nationkey FROM nation WHERE n_regionkey = 2
UNION ALL SELECT 's' || s_suppkey, 2, 'r2>n' || n_nationkey || '>s' || s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = 2""")
def bfs_paths(spark: SparkSession, d: str) -> DataFrame:
    down = star.edges(spark, d, "PART_OF", "BASED_IN").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "id")
    return graph.paths(down, star.seeds(spark, "r2"), 2).select("node", "hop", F.array_join("path", ">").alias("path"))


def _ppr_sql(rounds: int) -> str:
    """A fixed number of personalized PageRank rounds over suppliers, nations and regions, some nations with an edge to themselves."""
    steps = [
        f"""s{k} AS MATERIALIZED (SELECT t.node, 0.15 * restart + 0.85 * (coalesce(m.moved, 0) + (SELECT coalesce(sum(score), 0) FROM s{k - 1} WHERE node NOT IN (SELECT src FROM p)) * restart) AS score
FROM t LEFT JOIN (SELECT dst AS node, sum(score * pr) AS moved FROM s{k - 1} JOIN p ON p.src = s{k - 1}.node GROUP BY dst) m ON m.node = t.node)"""
        for k in range(1, rounds + 1)
    ]
    return f"""WITH e AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst, 3.0 AS w FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 2.0 FROM nation UNION ALL SELECT 'n' || n_nationkey, 'n' || n_nationkey, 1.0 FROM nation WHERE n_nationkey % 5 = 1),
b AS (SELECT * FROM e UNION ALL SELECT dst, src, w FROM e), p AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS pr FROM b),
t AS (SELECT DISTINCT src AS node, CASE WHEN src IN ('n1', 'n7') THEN 0.5 ELSE 0.0 END AS restart FROM b), s0 AS (SELECT node, restart AS score FROM t), {", ".join(steps)}
SELECT node, round(score, 9) AS score FROM s{rounds} WHERE score > 0"""


@query(_ppr_sql(20))
def ppr_scores(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("type") == "BASED_IN", "TARGETS").otherwise(F.col("type"))
    e = star.edges(spark, d, "BASED_IN", "PART_OF").select("src", "dst", kind.alias("type"))
    own = table(spark, d, "nation").where("n_nationkey % 5 = 1").select(star.node("n", F.col("n_nationkey")).alias("src"))
    e = e.unionByName(own.select("src", F.col("src").alias("dst"), F.lit("RELATED_TO").alias("type")))
    return graph.pagerank_rounds(graph.ranking_steps(e), star.seeds(spark, "n1", "n7"), 20).where("score > 0").select("node", F.round("score", 9).alias("score"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, count(*) > 0 AS present FROM lineitem GROUP BY ALL""")
def edge_dedup(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    return graph.dedup_edges(lines, "l_orderkey", "l_partkey", "l_suppkey").withColumn("present", F.lit(True))


@query(f"""WITH e AS ({_EDGES}) SELECT type, count(*) AS n, count(DISTINCT dst) AS n_targets FROM e GROUP BY type""")
def edge_union_types(spark: SparkSession, d: str) -> DataFrame:
    return star.edges(spark, d).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("n_targets"))


@query(f"""
WITH e AS ({_EDGES}), v AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
SELECT CASE substr(node, 1, 1) WHEN 'o' THEN 'order' WHEN 'c' THEN 'customer' WHEN 's' THEN 'supplier' WHEN 'n' THEN 'nation' ELSE 'region' END AS kind, count(*) AS n_nodes FROM v GROUP BY 1""")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return star.nodes(star.edges(spark, d)).groupBy(star.kind(F.col("node")).alias("kind")).agg(F.count("*").alias("n_nodes"))


@query("""
WITH c AS (SELECT c_custkey, c_mktsegment AS name, [CASE WHEN c_acctbal > 5000 THEN 'c' || c_custkey END, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') AND n_nationkey % 2 = 0 THEN 'n' || n_nationkey END, 'r' || n_regionkey] AS s
FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey, name, CASE WHEN s[1] IS NOT NULL THEN 0 WHEN s[2] IS NOT NULL THEN 1 ELSE 2 END AS depth, coalesce(s[1], s[2], s[3]) AS scope FROM c""")
def nearest_scope_binding(spark: SparkSession, d: str) -> DataFrame:
    return star.nearest_binding(spark, d)


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*/([^?#]*)', 1) AS path FROM pages),
f AS (SELECT host || '/' || path AS file, count(*) AS n FROM p GROUP BY 1),
c AS (SELECT page_id, unnest([host || '/' || path, host || '/' || split_part(path, '/', 1), host || '/' || path || '/index']) AS file FROM p),
m AS (SELECT page_id, count(DISTINCT c.file) AS n_found, min(c.file) AS file, sum(n) AS n_files FROM c JOIN f USING (file) GROUP BY page_id)
SELECT page_id, CAST(n_found AS BIGINT) AS n_found, CASE WHEN n_found = 1 AND n_files = 1 THEN file END AS resolved FROM m""")
def module_resolution(spark: SparkSession, d: str) -> DataFrame:
    return star.resolve_modules(table(spark, d, "pages"))


# ---------------------------------------------------------------- index runs and views


@query("""
WITH a AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s FROM orders WHERE o_orderdate < '1998-01-01' GROUP BY 1),
b AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s FROM orders WHERE o_orderdate < '2000-01-01' GROUP BY 1),
p AS (SELECT * FROM a WHERE s <> 'F'), c AS (SELECT * FROM b WHERE s <> 'F')
SELECT coalesce(c.o_custkey, p.o_custkey) AS o_custkey, CASE WHEN p.o_custkey IS NULL THEN 'added' WHEN c.o_custkey IS NULL THEN 'deleted' WHEN p.k = c.k THEN 'reused' ELSE 'changed' END AS state FROM p FULL JOIN c ON p.o_custkey = c.o_custkey""")
def index_diff(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumn("seq", F.struct("o_orderdate", "o_orderkey"))

    def snapshot(day: str) -> DataFrame:
        return history.latest_per(orders.where(F.col("o_orderdate") < day), ["o_custkey"], "seq", tombstone=F.col("o_orderstatus") == "F")

    return history.diff_snapshots(snapshot("1998-01-01"), snapshot("2000-01-01"), "o_custkey", ["o_orderkey"])


@query("""
SELECT user_id, count(*) AS seen, count(*) FILTER (WHERE event_type = 'purchase') AS changed, count(*) FILTER (WHERE event_type = 'error') AS deleted, count(*) FILTER (WHERE event_type IN ('view', 'click', 'signup')) AS unchanged, round(sum(value), 4) AS total FROM events GROUP BY user_id""")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "changed").when(F.col("event_type") == "error", "deleted").when(F.col("event_type").isin("view", "click", "signup"), "reused")
    log = table(spark, d, "events").withColumn("state", kind)
    totals = log.groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("total"))
    return history.run_counters(log, "user_id", "state").join(totals, "user_id")


@query("""
SELECT c.category, count(e.event_id) AS n FROM (SELECT unnest(['view', 'click', 'error', 'purchase', 'signup', 'unknown']) AS category) c LEFT JOIN events e ON e.event_type = c.category GROUP BY c.category""")
def unresolved_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_type").alias("category"))
    return history.histogram(rows, "category", ["view", "click", "error", "purchase", "signup", "unknown"])


@query("""
SELECT p_partkey, p_brand, p_type, count(*) OVER (PARTITION BY p_brand, p_type) AS n_same, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) - 1 AS ordinal FROM part""")
def overload_ordinals(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    return codegraph.overloads(part, ["p_brand", "p_type"], "p_partkey")


@query("""
WITH m AS (SELECT o_orderkey, o_custkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'goal' WHEN '2' THEN 'task' WHEN '3' THEN 'decision' WHEN '4' THEN 'question' ELSE 'result' END AS kind,
  CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'cancelled' ELSE 'in_progress' END ELSE CASE substr(o_orderpriority, 1, 1) WHEN '4' THEN 'resolved' ELSE 'completed' END END AS status FROM orders),
g AS (SELECT *, CASE WHEN status = 'cancelled' THEN 'history' WHEN kind = 'goal' THEN 'goals' WHEN kind = 'task' AND status IN ('active', 'in_progress') THEN 'active_tasks' WHEN kind = 'task' AND status = 'completed' THEN 'completed_tasks'
  WHEN kind = 'decision' AND status = 'active' THEN 'decisions' WHEN kind = 'question' AND status = 'active' THEN 'open_questions' WHEN kind = 'result' THEN 'recent_results' ELSE 'history' END AS grouped FROM m)
SELECT o_custkey, grouped, count(*) AS n, max(o_orderkey) AS last_id FROM g GROUP BY ALL""")
def handoff_groups(spark: SparkSession, d: str) -> DataFrame:
    """Orders as memory: priority as type, status as status; cancelled ones are closed."""
    first, status = F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus")
    kind = F.coalesce(F.element_at(F.create_map(*map(F.lit, ("1", "goal", "2", "task", "3", "decision", "4", "question"))), first), F.lit("result"))
    now = F.when(status == "O", "active").when(status == "P", F.when(F.col("o_orderkey") % 3 == 0, "cancelled").otherwise("in_progress")).otherwise(F.when(first == "4", "resolved").otherwise("completed"))
    grouped = memory.handoff_group(kind, now, now != "cancelled")
    return table(spark, d, "orders").groupBy("o_custkey", grouped.alias("grouped")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last_id"))


@query("""
SELECT o_custkey, o_orderkey, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders WHERE o_orderpriority < '3' AND o_orderstatus <> 'F') WHERE r <= 20""")
def recent_results(spark: SparkSession, d: str) -> DataFrame:
    entities = table(spark, d, "orders").select(
        F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") < "3", "result").otherwise("action").alias("entity_type"),
        F.col("o_orderdate").alias("valid_from"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("valid_to"),
    )
    return memory.latest_results(entities).select(F.col("project_id").alias("o_custkey"), F.col("id").alias("o_orderkey"), F.col("place").cast("long").alias("place"))


# ---------------------------------------------------------------- event logs, streams, archives, kernels


def conversation_log(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as an event log: a project each, that starts a session, and an event for each turn of user and assistant.

    Some logs are damaged, by the number of their conversation modulo 7: 3, the
    payload of event 4 was changed after it was hashed; 5, event 4 is missing;
    6, event 4 is of a session that was never started.
    """
    c = table(spark, d, "conversations").where("role in ('user', 'assistant')")
    project = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.hex("conv_id"), 12, "0"))
    turns = history.with_sequence(c, "conv_id", "turn", name="n").select(F.lower(project).alias("project_id"), F.col("n").cast("long").alias("n"), "role", "text", (F.col("conv_id") % 7).alias("fault"))
    name = F.when(F.col("role") == "user", "conversation.user_message").otherwise("conversation.assistant_message")
    fault = F.when(F.col("n") == 2, F.col("fault"))
    said = turns.select("project_id", F.when(fault == 6, "ffffffff-0000-4000-8000-ffffffffffff").otherwise(F.col("project_id")).alias("session_id"), (F.col("n") + 2).alias("sequence"), name.alias("event_type"), F.to_json(F.struct(F.col("text").alias("content"))).alias("raw"), fault.alias("fault"))
    projects = turns.select("project_id").distinct()
    none = F.lit(None).cast("long").alias("fault")
    first = projects.select("project_id", F.col("project_id").alias("session_id"), F.lit(1).cast("long").alias("sequence"), F.lit("project.created").alias("event_type"), F.to_json(F.struct(F.col("project_id").alias("name"), F.lit("/").alias("root_path"))).alias("raw"), none)
    second = projects.select("project_id", F.col("project_id").alias("session_id"), F.lit(2).cast("long").alias("sequence"), F.lit("session.started").alias("event_type"), F.lit("{}").alias("raw"), none)
    log = first.unionByName(second).unionByName(said).select("project_id", "session_id", "sequence", "event_type", can.canonical_text("raw").alias("payload"), F.lit("2024-01-01T00:00:00.000Z").alias("created_at"), "fault")
    envelope = can.canonical_object(created_at=can.quoted(F.col("created_at")), event_type=can.quoted(F.col("event_type")), payload=F.col("payload"), project_id=can.quoted(F.col("project_id")), sequence=can.integer(F.col("sequence")), session_id=can.quoted(F.col("session_id")))
    hashed = log.withColumn("content_hash", F.sha2(envelope, 256))
    hashed = hashed.withColumn("id", can.event_id_column(F.col("content_hash"))).where("fault is null or fault <> 5")
    return hashed.withColumn("payload", F.when(F.col("fault") == 3, '{"content":"altered"}').otherwise(F.col("payload"))).select(*[f.name for f in events.EVENT.fields])


_PROJECT = "'00000000-0000-4000-8000-' || lower(lpad(hex(conv_id), 12, '0'))"
_LOGS = f"""g AS (SELECT {_PROJECT} AS project_id, conv_id % 7 AS f, count(*) AS n FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id),
l AS (SELECT project_id, n + 2 AS total, CASE WHEN n >= 2 THEN f END AS fault FROM g)"""


@query(f"""WITH {_LOGS} SELECT project_id, total - CASE WHEN fault = 5 THEN 1 ELSE 0 END AS n_events, total - CASE WHEN fault IN (3, 5) THEN 1 ELSE 0 END AS n_valid FROM l""")
def event_log_verify(spark: SparkSession, d: str) -> DataFrame:
    checked = events.verified(conversation_log(spark, d))
    return checked.groupBy("project_id").agg(F.count("*").alias("n_events"), F.count_if("valid").alias("n_valid"))


@query(f"""
WITH {_LOGS}, s AS (SELECT project_id, CASE WHEN fault IN (3, 5, 6) THEN 3 ELSE total END AS last_sequence,
  CASE WHEN fault = 3 THEN '4: identity does not match the content' WHEN fault = 6 THEN '4: the session is not active' WHEN fault = 5 AND total >= 5 THEN '5: the sequence has a gap' END AS error FROM l)
SELECT project_id, last_sequence, 1 AS n_sessions, project_id AS active_session_id, error,
sha256('{{"active_session_id":"' || project_id || '","checkpoints":[],"last_sequence":' || last_sequence || ',"project":{{"created_at":"2024-01-01T00:00:00.000Z","id":"' || project_id || '","name":"' || project_id || '","root_path":"/"}},"sessions":[{{"details":{{}},"id":"' || project_id || '","sequence":2,"started_at":"2024-01-01T00:00:00.000Z"}}]}}') AS state_hash FROM s""")
def project_state_fold(spark: SparkSession, d: str) -> DataFrame:
    folded = events.fold_projects(conversation_log(spark, d))
    return folded.select("project_id", "last_sequence", F.col("n_sessions").cast("int").alias("n_sessions"), "active_session_id", "error", "state_hash")


@query(f"""
WITH {_LOGS}, s AS (SELECT project_id, CASE WHEN fault = 5 THEN 3 ELSE total END AS n FROM l)
SELECT project_id, n AS n_events, n AS last_sequence, project_id AS active_session_id, CAST(1 AS BIGINT) AS n_sessions FROM s""")
def streaming_project_view(spark: SparkSession, d: str) -> DataFrame:
    root = f"{shared_dir(spark)}/stream-{can.new_uuid()}"
    conversation_log(spark, d).write.parquet(f"{root}/log")
    view = views.ProjectView(spark, f"{root}/view")
    views.follow(views.read_events(spark, f"{root}/log", files_per_batch=4), view.apply, f"{root}/checkpoint").awaitTermination()
    return view.view()


@query("""SELECT user_id, count(*) AS n_events, CAST(sum(event_id) AS BIGINT) AS id_sum, round(sum(value), 4) AS total FROM events GROUP BY user_id""")
def archive_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(spark)}/archive-{can.new_uuid()}"
    table(spark, d, "events").select(F.to_json(F.struct(F.lit("event").alias("type"), F.struct("event_id", "user_id", "event_type", "value").alias("data"))).alias("value")).write.option("compression", "gzip").text(path)
    back = archive.read_archive_lines(spark, path).select(F.from_json("data", "event_id long, user_id long, event_type string, value double").alias("e")).select("e.*")
    return back.groupBy("user_id").agg(F.count("*").alias("n_events"), F.sum("event_id").alias("id_sum"), F.round(F.sum("value"), 4).alias("total"))


def _best_units(spark: SparkSession, d: str, n: int) -> DataFrame:
    """The n best documents of a query with their texts, in one partition for the ordered kernels."""
    docs = table(spark, d, "documents")
    best = search.top(search_index(spark, d).bm25(MULTI), n, "score", "doc_id")
    top = best.agg(F.min("score").alias("low"))
    scored = best.crossJoin(F.broadcast(top)).select("doc_id", (F.col("score") / F.col("low")).alias("relevance"))
    return docs.join(F.broadcast(scored), "doc_id").select("doc_id", "text", "source", "relevance").repartition(1)  # n rows


def _terms_sql(text: str) -> str:
    """Distinct lower-case words of a text, camel case and underscores split."""
    spaced = f"regexp_replace(regexp_replace({text}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"list_distinct(list_filter(flatten(list_transform(regexp_extract_all(lower({spaced}), '[\\p{{L}}\\p{{N}}_]+'), lambda x: string_split(x, '_'))), lambda x: x <> ''))"


@query(f"""
WITH RECURSIVE {_bm25_sql(MULTI)}, best AS (SELECT doc_id, score FROM hits ORDER BY score, doc_id LIMIT 40),
u AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id, source, score / min(score) OVER () AS rel, {_terms_sql('text')} AS t FROM best JOIN documents USING (doc_id)),
s AS (SELECT a.i AS i, list(greatest(0.7::DOUBLE * len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t)), CASE WHEN a.source = b.source THEN 0.15::DOUBLE ELSE 0 END) ORDER BY b.i) AS row FROM u a, u b GROUP BY a.i),
m AS (SELECT list(rel ORDER BY i) AS rel, list(row ORDER BY i) AS sim, list(doc_id ORDER BY i) AS ids, count(*) AS n FROM u JOIN s USING (i)),
r(k, done, pens, pick, penalty) AS (SELECT 0, CAST([] AS BIGINT[]), list_transform(ids, lambda x: 0::DOUBLE), 0::BIGINT, 0::DOUBLE FROM m UNION ALL
  SELECT k + 1, list_append(done, p), list_transform(range(1, n + 1), lambda j: greatest(pens[j], sim[j][p])), CAST(p AS BIGINT), pens[p] FROM
  (SELECT *, list_position(worth, list_max(worth)) AS p FROM (SELECT r.*, m.*, list_transform(range(1, n + 1), lambda j: CASE WHEN list_contains(done, j) THEN -1e9 ELSE 0.7::DOUBLE * rel[j] - (1 - 0.7::DOUBLE) * pens[j] END) AS worth FROM r, m WHERE k < n)))
SELECT ids[pick] AS doc_id, CAST(k AS BIGINT) AS place, round(penalty, 9) AS penalty FROM r, m WHERE k > 0""")
def mmr_order(spark: SparkSession, d: str) -> DataFrame:
    return kernels.diversity(_best_units(spark, d, 40)).select("doc_id", "place", F.round("penalty", 9).alias("penalty"))


@query()
def context_pack(spark: SparkSession, d: str) -> DataFrame:
    return kernels.packed(_best_units(spark, d, 40), 8000, " ".join(MULTI))


@query(f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
c AS (SELECT doc_id, len(p) AS n, CASE WHEN len(p) > 1 AND p[len(p)] = '' THEN p[:len(p) - 1] ELSE p END AS lines, octet_length(encode(t)) AS size FROM d),
l AS (SELECT doc_id, n, len(lines) AS n_lines, size, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM c),
b AS (SELECT doc_id, n_lines, size, i, octet_length(encode(line)) + CASE WHEN i < n THEN 1 ELSE 0 END AS bytes, len(list_intersect({_terms_sql('line')}, [{", ".join(f"'{t}'" for t in MULTI)}])) AS score FROM l),
f AS (SELECT doc_id, greatest(1, arg_max(i, struct_pack(s := score, i := -i)) - 1) AS first FROM b GROUP BY doc_id),
w AS (SELECT b.*, first, sum(bytes) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM b JOIN f USING (doc_id) WHERE size <= 1800 OR i >= first),
x AS (SELECT doc_id, any_value(n_lines) AS n_lines, any_value(size) AS size, any_value(first) AS first, max(i) FILTER (upto <= 1800 OR i = first) AS last, sum(bytes) FILTER (upto <= 1800 OR i = first) AS shown FROM w GROUP BY doc_id)
SELECT doc_id, CAST(CASE WHEN size <= 1800 THEN 1 ELSE first END AS BIGINT) AS first_line, CAST(CASE WHEN size <= 1800 THEN n_lines ELSE last END AS BIGINT) AS last_line,
CAST(CASE WHEN size <= 1800 THEN size ELSE shown END AS BIGINT) AS n_bytes, size > 1800 AND shown < size AS partial FROM x""")
def source_windows(spark: SparkSession, d: str) -> DataFrame:
    return kernels.windows(table(spark, d, "documents").select("doc_id", "text"), MULTI, 1800)


#: Functions of a made file, and files of a made project.
FUNCTIONS, FILES = 20, 1000


@query(f"""
WITH f AS (SELECT p_partkey // {FUNCTIONS * FILES} AS project, p_partkey // {FUNCTIONS} AS file, count(*) AS n FROM part GROUP BY ALL), c AS (SELECT project, count(*) AS files, sum(n) AS n FROM f GROUP BY project)
SELECT CAST(project AS VARCHAR) AS project_id, kind, CAST(CASE kind WHEN 'CALLS' THEN n - files WHEN 'CONTAINS' THEN 2 * n + files ELSE n END AS BIGINT) AS n FROM c, (SELECT unnest(['CALLS', 'CONTAINS', 'DEFINES', 'EXPORTS', 'REFERENCES']) AS kind) WHERE kind <> 'CALLS' OR n > files""")
def code_graph_stress(spark: SparkSession, d: str) -> DataFrame:
    """Parts as functions, each calling the one before it in its file; extracted in parallel, assembled by project, counted."""
    part = table(spark, d, "part").select("p_partkey", F.floor(F.col("p_partkey") / FUNCTIONS).alias("file"), F.floor(F.col("p_partkey") / (FUNCTIONS * FILES)).alias("project"))
    before = F.lag("p_partkey").over(Window.partitionBy("project", "file").orderBy("p_partkey"))
    body = F.coalesce(F.concat(F.lit("work"), before.cast("string"), F.lit("(value)")), F.lit("value + 1"))
    line = F.concat(F.lit("export function work"), F.col("p_partkey").cast("string"), F.lit("(value: number): number {\n  return "), body, F.lit(";\n}\n"))
    files = part.withColumn("line", line).groupBy("project", "file").agg(F.array_join(F.array_sort(F.collect_list(F.struct("p_partkey", "line")))["line"], "").alias("text"))
    files = files.select(F.col("project").cast("string").alias("project_id"), F.concat(F.lit("work"), F.col("file").cast("string"), F.lit(".ts")).alias("path"), F.col("text").cast("binary").alias("content"))
    return codegraph.assembled(extract.extract_files(files), "edges").groupBy("project_id", "kind").agg(F.count("*").alias("n"))
