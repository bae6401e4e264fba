"""The store of chunks, the gate's invariants, the graph of trust, discriminative patterns and labelled sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import gate, graph, mining, retrieval, store
from ..sources import samples
from .registry import query, table
from .request_queries import _VALUES_SQL, traced_values
from .score_queries import EV, events

KEY = b"store-signing-key"


@query("""
    WITH c AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_id % 13 = 0 AS large FROM events),
    r AS (SELECT event_id, large, sum(CASE WHEN large THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) + CASE WHEN user_id % 2 = 0 THEN 5 ELSE 0 END AS n FROM c)
    SELECT event_id, CASE WHEN large THEN 'too large' WHEN n > 20 THEN 'over quota' ELSE 'admitted' END AS verdict FROM r""")
def store_admission(spark, sf):
    """Chunks of a principal up to a quota of twenty, some held already; large ones are refused and take no place."""
    e = table(spark, sf, "events", "event_id", "user_id", "props").select(F.col("event_id").alias("chunk"), F.col("user_id").alias("principal"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 13 == 0, F.repeat("props", 100)).otherwise(F.col("props")).alias("text"))
    held = e.select("principal").distinct().where("principal % 2 = 0").withColumn("n", F.lit(5))
    return store.admitted(e, held, 200, 20).select(F.col("chunk").alias("event_id"), "verdict")


@query(f"""
    WITH {EV}, t AS (SELECT event_id, least(1.0, greatest(0.0, 1 - (.6 * score + .4 * (1 - score) / 2))) AS trust FROM ev), s AS (SELECT event_id, CASE WHEN trust < .4 THEN 'quarantine' WHEN trust < .713 THEN 'review' ELSE 'trusted' END AS status FROM t)
    SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'quarantine' ELSE status END AS status, CASE WHEN event_id % 11 = 0 THEN 'signature' END AS reason FROM s""")
def store_revalidation(spark, sf):
    """Chunks routed by trust and signed; every eleventh text is changed in the store, and just those fail validation."""
    e = events(spark, sf).select(F.col("event_id").alias("chunk"), F.concat(F.lit("text "), F.col("event_id").cast("string")).alias("text"), "score", ((1 - F.col("score")) / 2).alias("l1"))
    held = store.routed(e, "score", "l1", KEY)
    changed = held.withColumn("text", F.when(F.col("chunk") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return store.revalidated(changed, KEY).select(F.col("chunk").alias("event_id"), "status", "reason")


@query("WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) SELECT event_id FROM r WHERE k <= 16")
def store_retention(spark, sf):
    return store.retained(table(spark, sf, "events", "event_id", "user_id"), "user_id", "event_id", 16).select("event_id")


@query(f"""
    WITH {EV}, s AS (SELECT event_id, CASE WHEN score < .3 THEN 'trusted' WHEN score < .6 THEN 'review' ELSE 'quarantine' END AS status FROM ev),
    d AS (SELECT event_id, 1 AS note, 'release' AS decision FROM ev WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 2, 'reject' FROM ev WHERE event_id % 6 = 0), l AS (SELECT event_id, arg_max(decision, note) AS decision, max(note) AS note FROM d GROUP BY event_id)
    SELECT s.event_id, CASE WHEN status = 'review' AND decision = 'release' THEN 'trusted' WHEN status = 'review' AND decision = 'reject' THEN 'quarantine' ELSE status END AS status, note FROM s LEFT JOIN l ON s.event_id = l.event_id""")
def store_review(spark, sf):
    """Held chunks after people's decisions, of which the latest counts."""
    e = events(spark, sf)
    c = e.select(F.col("event_id").alias("chunk"), F.when(F.col("score") < 0.3, "trusted").when(F.col("score") < 0.6, "review").otherwise("quarantine").alias("status"))
    d = e.where("event_id % 3 = 0").select(F.col("event_id").alias("chunk"), F.lit(1).alias("note"), F.lit("release").alias("decision"))
    d = d.unionAll(e.where("event_id % 6 = 0").select(F.col("event_id"), F.lit(2), F.lit("reject")))
    return store.reviewed(c, d).select(F.col("chunk").alias("event_id"), "status", "note")


@query("""
    WITH q AS (SELECT vec_id AS query_id, embedding AS x FROM embeddings WHERE vec_id % 20 = 0),
    s AS (SELECT query_id, vec_id, label, list_cosine_similarity(x::DOUBLE[], embedding::DOUBLE[]) AS c FROM q, embeddings WHERE query_id <> vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM s), t AS (SELECT * FROM r WHERE rank <= 10),
    f AS (SELECT *, min(rank) OVER (PARTITION BY query_id, label) AS of_source, min(rank) OVER (PARTITION BY query_id, vec_id % 50) AS of_cluster FROM t),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM f WHERE rank = of_source AND rank = of_cluster)
    SELECT query_id, vec_id, CAST(k AS INT) AS k, CASE WHEN c < 0.25 THEN 'not_relevant' ELSE 'used' END AS usage FROM k WHERE k <= 3""")
def store_diverse_retrieval(spark, sf):
    """Of the ten nearest chunks of every query three of different sources and clusters, and what becomes of them."""
    rows = table(spark, sf, "embeddings", "vec_id", "embedding")
    ranked = retrieval.nearest(rows.where("vec_id % 20 = 0"), rows, 10).join(table(spark, sf, "embeddings", "vec_id", "label"), "vec_id").withColumn("cluster", F.col("vec_id") % 50)
    d = store.diverse(ranked, "query_id", "rank", "label", "cluster", 3)
    return d.select("query_id", "vec_id", "k", store.usage(F.lit(True), F.lit(False), F.col("similarity")).alias("usage"))


@query(r"""
    WITH d AS (SELECT doc_id, '<document id="' || doc_id || '" source="' || source || '">' || chr(10) || substr(coalesce(text, ''), 1, 300) || chr(10) || '</document>' AS r, doc_id // 3 AS q, doc_id % 3 AS k FROM documents)
    SELECT q, md5('<retrieved_context>' || chr(10) || string_agg(r, chr(10) || chr(10) ORDER BY k) || chr(10) || '</retrieved_context>') AS context FROM d GROUP BY q""")
def store_context(spark, sf):
    """Three documents a query as one block of context."""
    d = table(spark, sf, "documents", "doc_id", "text", "source")
    d = d.select(F.floor(F.col("doc_id") / 3).alias("q"), (F.col("doc_id") % 3).alias("k"), store.rendered(F.col("doc_id"), F.col("source"), F.col("text"), 300).alias("rendered"))
    return store.context(d, "q", "k").select("q", F.md5("context").alias("context"))


@query("""
    WITH c AS (SELECT event_id AS i, event_id % 8 AS what FROM events)
    SELECT i AS event_id, CASE WHEN what = 1 THEN 'I1 token' WHEN what = 2 THEN 'I2 bound to another call' WHEN what = 3 THEN 'I3 arguments' WHEN what = 4 THEN 'I4 expired' WHEN what = 5 THEN 'I9 state' WHEN what = 6 AND i % 3 = 0 THEN 'I6 not approved' WHEN i % 3 = 2 AND what = 7 THEN 'ok' ELSE 'ok' END AS verdict FROM c""")
def gate_invariants(spark, sf):
    """Calls with tokens of which some arrive changed, late, for another session or state, or without a person's yes."""
    i, what = F.col("event_id"), F.col("event_id") % 8
    e = table(spark, sf, "events", "event_id", "user_id", "event_type", "props")
    params = F.create_map(F.lit("k"), F.col("props"), F.lit("a"), F.lit("1"))
    c = e.select("event_id", F.col("user_id").cast("string").alias("sid"), F.lit("agent").alias("principal"), F.col("event_type").alias("tool"), params.alias("params"), F.when(i % 3 == 0, "confirm").otherwise("allow").alias("decision"), i.alias("nonce"), i.alias("now"))
    t = gate.issue(c, KEY, "v1", F.lit("s1"))
    ah = gate.args_hash(F.col("params"))
    t = t.withColumn("approver", F.lit("ann")).withColumn("approved", F.when(what != 6, gate.approval(KEY, F.col("nonce").cast("string"), ah, F.lit("ann"))))
    t = t.withColumn("token", F.when(what == 1, F.lit("forged")).otherwise(F.col("token"))).withColumn("sid", F.when(what == 2, "other").otherwise(F.col("sid")))
    t = t.withColumn("params", F.when(what == 3, F.create_map(F.lit("k"), F.lit("changed"))).otherwise(F.col("params"))).withColumn("at", F.when(what == 4, i + 301).otherwise(i + 5)).withColumn("state", F.when(what == 5, "s2").otherwise("s1"))
    return gate.checked(t, KEY, "v1").select("event_id", "verdict")


@query("""
    WITH o AS (SELECT event_id AS i, event_id // 4 AS nonce, event_id % 4 AS k FROM events) SELECT i AS event_id, CASE WHEN k = 0 OR i = (SELECT min(event_id) FROM events e WHERE e.event_id // 4 = o.nonce) THEN 'ok' ELSE 'I5 used before' END AS verdict FROM o""")
def gate_single_use(spark, sf):
    """Four attempts with one nonce: the first passes."""
    e = table(spark, sf, "events", "event_id")
    c = e.select("event_id", F.lit("s").alias("sid"), F.lit("agent").alias("principal"), F.lit("tool").alias("tool"), F.create_map(F.lit("a"), F.lit("1")).alias("params"), F.lit("allow").alias("decision"), F.floor(F.col("event_id") / 4).alias("nonce"), F.floor(F.col("event_id") / 4).alias("now"), F.lit("s1").alias("state"), F.lit("").alias("approver"), F.lit("").alias("approved"))
    t = gate.issue(c, KEY, "v1", F.lit("s1")).withColumn("at", F.col("now") + F.col("event_id") % 4)
    return gate.checked(t, KEY, "v1").select("event_id", "verdict")


@query(f"""
    WITH {_VALUES_SQL}, n AS (SELECT conv_id AS session, path, CASE WHEN source = 'EXPLICIT_USER_REQUEST' THEN 1 - confidence * (turn % 5) / 10 WHEN source = 'CONTEXT_DERIVED' THEN confidence ELSE 1.0 END AS eff FROM tr),
    least AS (SELECT session, min(eff) AS eff FROM n GROUP BY session) SELECT session, round(eff, 6) AS effective FROM least WHERE eff < 0.75 AND session % 5 <> 1""")
def sessions_trust_paths(spark, sf):
    """Calls of high impact that low trust reaches over the graph of turns, chunks and parameters."""
    o = traced_values(spark, sf)
    said = table(spark, sf, "conversations", "conv_id", "turn", "role").where("role = 'user'").select(F.col("conv_id").alias("session"), "turn", (F.col("turn") % 5 / 10).alias("l1"))
    docs = table(spark, sf, "documents", "doc_id").select(F.col("doc_id").alias("session"), F.lit("doc").alias("chunk"), (F.col("doc_id") % 10 / 10).alias("trust"))
    calls = o.select("session", "call").distinct().withColumn("impact", F.when(F.col("session") % 5 == 1, "LOW").otherwise("HIGH"))
    nodes, edges = graph.session_graph(said, docs, o, calls)
    return graph.low_trust_paths(graph.propagated(nodes, edges)).select("session", F.round("effective", 6).alias("effective"))


@query(f"""
    WITH {EV}, s AS (SELECT session, label, event_id, layer || ':' || CASE WHEN score < .35 THEN 'LOW' WHEN score < .7 THEN 'MEDIUM' ELSE 'HIGH' END AS x FROM ev),
    p AS (SELECT DISTINCT a.session, a.label, a.x || ' > ' || b.x AS pattern FROM (SELECT session, label, x, min(event_id) AS e FROM s GROUP BY ALL) a JOIN (SELECT session, x, max(event_id) AS e FROM s GROUP BY ALL) b ON a.session = b.session AND a.e < b.e WHERE a.x LIKE '%HIGH' AND b.x LIKE '%HIGH'),
    t AS (SELECT count(DISTINCT session) FILTER (WHERE label = 1) AS np, count(DISTINCT session) FILTER (WHERE label = 0) AS nn FROM s), c AS (SELECT pattern, count(*) FILTER (WHERE label = 1) / max(np) AS positive, count(*) FILTER (WHERE label = 0) / max(nn) AS negative FROM p, t GROUP BY pattern)
    SELECT pattern, round(positive, 6) AS positive, round(negative, 6) AS negative, round(positive / (positive + negative), 6) AS ratio FROM c WHERE positive / (positive + negative) >= 0.4""")
def mining_discriminative_patterns(spark, sf):
    """Two high scores in order, by how much more often attackers' sessions hold them."""
    e = events(spark, sf).withColumn("item", mining.symbol("layer", "score"))
    s = mining.sequences(e, "session", "event_id", "item", "label")
    high = [f"L{k}:HIGH" for k in range(1, 6)]
    patterns = spark.createDataFrame([([a, b],) for a in high for b in high], "pattern array<string>")
    out = mining.contrasted(s.where("label = 1"), s.where("label = 0"), "items", patterns, 0.4)
    return out.select(F.array_join("pattern", " > ").alias("pattern"), *[F.round(c, 6).alias(c) for c in ("positive", "negative", "ratio")])


def _samples(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "text", "lang", "source").join(table(spark, sf, "labels", "doc_id", "toxic"), "doc_id", "left")
    label = F.when(F.col("toxic") == 1, "malicious").when(F.col("toxic") == 0, "benign")
    return d.select("text", label.alias("label"), F.when(F.col("toxic") == 1, "toxic").otherwise("none").alias("attack_type"), F.lit("all").alias("target_layer"), F.col("source").alias("source_benchmark"), F.col("doc_id").cast("string").alias("sample_id"), F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))


@query("""
    WITH d AS (SELECT documents.doc_id, text, toxic, CAST((('0x' || md5(coalesce(text, '')))::UHUGEINT % 100) AS INT) < 20 AS test FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id)
    SELECT test, count(*) AS n, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS empty, count(*) FILTER (WHERE toxic IS NULL) AS bad_label FROM d GROUP BY test""")
def sources_splits(spark, sf):
    """Labelled samples in two splits by their texts, each with its checks."""
    s = _samples(spark, sf)
    of = lambda name: samples.integrity(samples.in_split(s, name)).select(F.lit(name == "test").alias("test"), "n", "empty", "bad_label")
    return of("test").unionAll(of("train"))


@query("""
    SELECT count(*) AS shared_texts, (SELECT count(*) FROM (SELECT CASE WHEN toxic = 1 THEN 'toxic' ELSE 'none' END FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id % 5 = 0 INTERSECT SELECT CASE WHEN toxic = 1 THEN 'toxic' ELSE 'none' END FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id % 5 <> 0)) AS shared_types
    FROM (SELECT text FROM documents WHERE doc_id % 5 = 0 INTERSECT SELECT text FROM documents WHERE doc_id % 5 <> 0)""")
def sources_held_out(spark, sf):
    s = _samples(spark, sf).withColumn("k", F.col("sample_id").cast("long") % 5)
    return samples.held_out(s.where("k <> 0"), s.where("k = 0"))


@query("""
    WITH t AS (SELECT conv_id, turn, embedding::DOUBLE[] AS x FROM conversations JOIN embeddings ON vec_id = (conv_id * 7 + turn) % (SELECT max(vec_id) + 1 FROM embeddings)),
    a AS (SELECT embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id < 5) SELECT conv_id, turn, round(max(list_cosine_similarity(t.x, a.x)), 6) AS harm, max(list_cosine_similarity(t.x, a.x)) > 0.15 AS flagged FROM t, a GROUP BY conv_id, turn""")
def conversation_alignment(spark, sf):
    """A turn's nearest of five anchors: the anchors are one row."""
    e = table(spark, sf, "embeddings", "vec_id", "embedding")
    one = e.agg((F.max("vec_id") + 1).alias("n"), F.collect_list(F.when(F.col("vec_id") < 5, F.col("embedding"))).alias("anchors"))
    c = table(spark, sf, "conversations", "conv_id", "turn").crossJoin(F.broadcast(one)).withColumn("vec_id", (F.col("conv_id") * 7 + F.col("turn")) % F.col("n")).join(e, "vec_id")
    harm = F.array_max(F.transform("anchors", lambda a: vectors.cosine(F.col("embedding"), a)))
    return c.select("conv_id", "turn", F.round(harm, 6).alias("harm"), (harm > 0.15).alias("flagged"))


@query("WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events) SELECT event_id, k AS prior_calls FROM r")
def sessions_prior_calls(spark, sf):
    e = table(spark, sf, "events", "event_id", "user_id")
    return e.select("event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("prior_calls"))
