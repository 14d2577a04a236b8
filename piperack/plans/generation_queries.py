"""Generation, sampling and lab queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from piperack.operators import audit, generation, graph, retrieval
from piperack.plans import standins as s

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _register(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


@_register("""WITH e AS (SELECT source AS row_id, doc_id AS ordinal, trim(split_part(coalesce(text, ''), '.', 1), ' ') AS text, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT row_id, ordinal, text, round(least(0.95, 0.4 + 0.15 * n), 3)::DOUBLE AS confidence FROM e WHERE text <> ''""")
def ws_causes(spark, sf_dir):
    return generation.causes(s.table(spark, sf_dir, "documents").select(F.col("source").alias("row_id"), F.col("doc_id").alias("ordinal"), F.col("text").alias("snippet")))


@_register("""SELECT l_orderkey AS row_id, l_returnflag = 'R' AS is_default, round(greatest(0.3, CASE WHEN l_returnflag = 'R' THEN least(0.95, 0.4 + 0.15 * count(*)) * 0.6 ELSE least(0.95, 0.4 + 0.15 * count(*)) END), 3)::DOUBLE AS confidence
FROM lineitem GROUP BY l_orderkey, l_returnflag""")
def ws_consequences(spark, sf_dir):
    found = s.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row_id"), "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    default = F.col("l_returnflag") == "R"
    return found.select("row_id", default.alias("is_default"), generation.consequence_confidence(F.col("n"), default).alias("confidence"))


_GO = "JOIN nodes n ON n.tag = node AND (node = start OR n.equipment_type NOT IN ('pump', 'compressor', 'valve', 'control_valve'))"


@_register(f"""WITH RECURSIVE {s.GRAPH_SQL}, columns AS (SELECT DISTINCT dst AS start FROM edges JOIN hub ON src = start JOIN nodes ON tag = dst WHERE equipment_type = 'column'),
drawn(start, node) AS (SELECT start, start FROM columns UNION SELECT start, dst FROM drawn {_GO} JOIN edges ON src = node),
sure(start, node) AS (SELECT start, start FROM columns UNION SELECT start, dst FROM sure {_GO} JOIN edges ON src = node WHERE verified),
relief AS (SELECT d.start, bool_or(d.node IN (SELECT node FROM sure x WHERE x.start = d.start)) AS v FROM drawn d JOIN nodes ON tag = d.node WHERE d.node <> d.start AND equipment_type = 'relief_valve' GROUP BY d.start)
SELECT 'columns' AS node_id, start AS tag, CASE WHEN v THEN 0.99 ELSE 0.60 END::DOUBLE AS confidence FROM relief ORDER BY NOT v, start LIMIT 1""")
def ws_relief_safeguard(spark, sf_dir):
    """The columns that the hub feeds are one study node; its members in the order of their tags."""
    nodes, edges = s.nodes(spark, sf_dir), graph.cut(s.edges(spark, sf_dir))
    fed = edges.join(s.hub(edges), edges.src == F.col("start")).select(F.col("dst").alias("tag"))
    columns = graph.cut(nodes.where("equipment_type = 'column'").select("tag").join(fed, "tag", "left_semi"))
    relief = graph.relief_paths(edges, nodes, columns.select(F.col("tag").alias("start")))
    members = columns.select(F.lit("columns").alias("node_id"), F.col("tag").alias("ordinal"), "tag")
    return generation.relief_safeguard(members, relief)


@_register("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('audit|' || doc_id), doc_id) AS pick FROM documents QUALIFY pick <= 20")
def au_sample(spark, sf_dir):
    found = generation.sample(s.table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 20, "audit")
    return found.select("source", "doc_id", F.col("pick").cast("long").alias("pick"))


@_register("SELECT quality, doc_id, row_number() OVER (PARTITION BY quality ORDER BY md5('omit|' || doc_id), doc_id) AS pick FROM labels QUALIFY pick <= 3")
def au_seeded_omissions(spark, sf_dir):
    found = generation.sample(s.table(spark, sf_dir, "labels").select("quality", "doc_id"), "quality", "doc_id", 3, "omit")
    return found.select("quality", "doc_id", F.col("pick").cast("long").alias("pick"))


_SEEDED = """rows AS (SELECT o_orderkey AS label, list(l_partkey ORDER BY l_partkey) FILTER (WHERE l_returnflag = 'N') AS consequences FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
picked AS (SELECT label, CASE WHEN len(consequences) > 0 AND substr(md5('omit kind|' || label), 1, 1) >= '8' THEN 'blanked_consequences' ELSE 'dropped_row' END AS kind FROM rows ORDER BY md5('omit row|' || label), label LIMIT 60)"""


def _seeded(spark, sf_dir):
    lines = s.table(spark, sf_dir, "lineitem").join(s.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")).distinct(), "l_orderkey", "left_semi")
    rows = lines.groupBy(F.col("l_orderkey").alias("label")).agg(F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == "N", F.col("l_partkey")))).alias("consequences"))
    return generation.seed_omissions(rows, 60, "omit")


@_register(f"WITH {_SEEDED} SELECT kind, label FROM picked")
def au_omissions(spark, sf_dir):
    return _seeded(spark, sf_dir)[1]


@_register(f"WITH {_SEEDED} SELECT label, CASE WHEN kind IS NULL THEN coalesce(len(consequences), 0) ELSE 0 END::INTEGER AS consequences FROM rows LEFT JOIN picked USING (label) WHERE kind IS NULL OR kind <> 'dropped_row'")
def ws_seeded(spark, sf_dir):
    return _seeded(spark, sf_dir)[0].select("label", F.size("consequences").alias("consequences"))


@_register("""SELECT user_id, count(*) AS questions, round(avg((value > 20)::INTEGER), 6) AS kind_right, round(avg((value > 40)::INTEGER), 6) AS intent_right, round(avg((value > 60)::INTEGER), 6) AS result_right, count(*) FILTER (WHERE event_type = 'error') AS failed_closed FROM events GROUP BY ALL""")
def lab_accuracy(spark, sf_dir):
    over = lambda n: F.coalesce(F.col("value") > n, F.lit(False))
    runs = s.table(spark, sf_dir, "events").select("user_id", over(20).alias("kind_right"), over(40).alias("intent_right"), over(60).alias("result_right"), (F.col("event_type") == "error").alias("failed_closed"))
    return generation.accuracy(runs, "user_id")


@_register("SELECT doc_id, greatest(1, length(text) // 4) AS tokens, round((n_chars::DOUBLE / (nullif(doc_id, 0) * 1000000 / 1e9)), 4) AS per_second FROM documents")
def lab_speed(spark, sf_dir):
    docs = s.table(spark, sf_dir, "documents")
    return docs.select("doc_id", generation.token_estimate(F.col("text")).alias("tokens"), F.round(generation.speed(F.col("n_chars"), F.col("doc_id") * 1_000_000), 4).alias("per_second"))


@_register("""SELECT event_type AS kind, count(*) FILTER (WHERE value >= 50) AS accepted, count(*) FILTER (WHERE value < 20) AS rejected, round(count(*) FILTER (WHERE value >= 50)::DOUBLE / nullif(count(*) FILTER (WHERE value >= 50 OR value < 20), 0), 6) AS precision FROM events GROUP BY ALL""")
def view_precision(spark, sf_dir):
    label = F.when(F.col("value") >= 50, "accept").when(F.col("value") < 20, "reject").otherwise("open")
    return generation.label_precision(s.table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), label.alias("label")), "kind")


@_register("""WITH gold AS (SELECT item_id AS item, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark WHERE len(regexp_extract_all(lower(text), '[a-z0-9]+')) >= 3),
told AS (SELECT role, lower(text) AS t FROM conversations),
hits AS (SELECT item, role, bool_or((contains(t, w[1]) AND contains(t, w[2])) OR contains(t, w[3])) AS hit FROM gold CROSS JOIN told GROUP BY ALL)
SELECT 'all' AS label, role AS slot, count(*) AS expected, sum(hit::INTEGER)::BIGINT AS matched, round(avg(hit::INTEGER), 6) AS recall FROM hits GROUP BY ALL""")
def au_slot_recall(spark, sf_dir):
    """Every item is expected of every role: its first two words together, or its third."""
    from piperack.functions.plant import tokens

    told = s.table(spark, sf_dir, "conversations").select(F.lit("all").alias("label"), F.col("role").alias("slot"), "text")
    words = s.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), tokens(F.col("text")).alias("w")).where(F.size("w") >= 3)
    pair = F.array(F.element_at("w", 1), F.element_at("w", 2))
    gold = words.select(F.lit("all").alias("label"), "item", F.array(pair, F.array(F.element_at("w", 3))).alias("match_any"))
    return audit.slot_recall(gold.join(told.select("label", "slot").distinct(), "label"), told)


@_register("""WITH cells AS (SELECT vec_id, label, unnest(range(len(embedding))) AS bucket, unnest(embedding)::DOUBLE AS raw FROM embeddings),
v AS (SELECT vec_id, bucket, raw / sqrt(sum(raw * raw) OVER (PARTITION BY vec_id)) AS x FROM cells WHERE raw <> 0),
means AS (SELECT label, bucket, avg(raw) AS raw FROM cells GROUP BY ALL), q AS (SELECT label, bucket, raw / sqrt(sum(raw * raw) OVER (PARTITION BY label)) AS x FROM means WHERE raw <> 0),
scored AS (SELECT label AS query_id, vec_id AS chunk_id, round(sum(v.x * q.x), 6) AS score FROM v JOIN q USING (bucket) GROUP BY ALL)
SELECT query_id, chunk_id, score FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10""")
def kb_dense_embeddings(spark, sf_dir):
    """The mean vector of each label asks for its ten nearest rows."""
    from piperack.operators import search

    rows = s.table(spark, sf_dir, "embeddings")
    means = rows.select("label", F.posexplode("embedding").alias("p", "x")).groupBy("label", "p").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda c: c["x"]).alias("embedding"))
    own = search.rows_of(retrieval.unit_cells(rows, "vec_id", "embedding", "chunk_id"))
    return search.top_by_cosine(own, retrieval.unit_cells(means, "label", "embedding", "query_id"), 64, 10, 6).drop("rank")
