"""A question of some kind about every order's items, all answered together."""

from __future__ import annotations

from pyspark.sql import functions as F

from piperack.checkpoints import cut, stored
from piperack.operators import answers
from piperack.plans import standins as s

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _register(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# By the order's number: the kind that is asked for, with the words around its first item (@) and its last one ($).
_ASKED = {
    0: ("downstream", "What is downstream of @?"),
    1: ("upstream", "which items supply flow into $, what feeds $"),
    2: ("path", "show the path from @ to $"),
    3: ("neighbours", "what is connected to @?"),
    4: ("relief", "Is @ protected against overpressure?"),
    5: ("info", "tell me about @"),
    6: ("list", "list all vessels"),
    7: ("count", "how many pumps are there"),
    8: ("downstream", "sing me a song"),  # another reader speaks for these
    9: ("downstream", "sing me a song"),
    10: (None, "sing me a song"),
}


def _answered(spark, sf_dir):
    chains = stored(s.chains(spark, sf_dir))
    tag = lambda pos: F.concat_ws("-", F.lit("Q"), "chain", pos)
    nodes = chains.select(F.col("chain").alias("plant"), tag(F.col("pos")).alias("tag"), "equipment_type", F.concat(F.lit("item "), "tag").alias("name"))
    edges = chains.where("next is not null").select(F.col("chain").alias("plant"), tag(F.col("pos")).alias("src"), tag(F.col("pos") + 1).alias("dst"), "verified")
    sizes = cut(chains.groupBy("chain").agg(F.max("pos").alias("n")).where("n > 1").withColumn("k", F.col("chain") % len(_ASKED)))
    words = F.element_at(F.create_map(*[F.lit(x) for k, (_, text) in _ASKED.items() for x in (k, text)]), F.col("k").cast("int"))
    asked = sizes.select(F.col("chain").alias("question_id"), F.replace(F.replace(words, F.lit("@"), tag(F.lit(1))), F.lit("$"), tag(F.col("n"))).alias("question"))
    # parts of tags, which are in the graph for even orders only
    other = sizes.where("k in (8, 9)").select(F.col("chain").alias("question_id"), F.lit("downstream").alias("kind"), F.concat_ws("-", F.when(F.col("k") == 9, F.lit("Z")), "chain", F.lit(1)).alias("tag"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("equipment_type"))
    return answers.answers(asked, nodes, edges, other, cutoff=None), edges


_ITEMS = f"""{s.CHAIN_SQL}, items AS (SELECT 'Q-' || chain || '-' || pos AS item, chain, pos, equipment_type, verified, 'item ' || tag AS name, max(pos) OVER (PARTITION BY chain) AS n FROM chains),
heads AS (SELECT DISTINCT chain, n, chain % {len(_ASKED)} AS k FROM items WHERE n > 1),
low AS (SELECT chain, coalesce(min(pos) FILTER (WHERE NOT verified AND pos < n), any_value(n)) AS sure_to, coalesce(max(pos) FILTER (WHERE NOT verified AND pos < n) + 1, 1) AS sure_from FROM items GROUP BY chain),
rows_ AS (
  SELECT h.chain, i.item, i.equipment_type AS item_type, CASE WHEN CASE WHEN k = 1 THEN pos >= sure_from ELSE pos <= sure_to END THEN 'verified' ELSE 'unverified' END AS detail, NULL::BIGINT AS number
    FROM heads h JOIN items i USING (chain) JOIN low USING (chain) WHERE k IN (0, 8) AND pos > 1 OR k = 1 AND pos < h.n OR k = 4 AND pos > 1 AND i.equipment_type = 'relief_valve'
  UNION ALL SELECT h.chain, string_agg(item, ' → ' ORDER BY pos), NULL, CASE WHEN bool_and(verified OR pos = h.n) THEN 'verified' ELSE 'unverified' END, max(pos) - 1 FROM heads h JOIN items i USING (chain) WHERE k = 2 GROUP BY h.chain
  UNION ALL SELECT h.chain, i.item, i.equipment_type, CASE WHEN f.verified THEN 'FLOWS_TO (out)' ELSE 'CONNECTED_TO (unknown)' END, NULL FROM heads h JOIN items i ON i.chain = h.chain AND i.pos = 2 JOIN items f ON f.chain = h.chain AND f.pos = 1 WHERE k = 3
  UNION ALL SELECT chain, item, f.p, f.v, NULL FROM (SELECT h.chain, item, unnest([{{'p': 'equipment_type', 'v': equipment_type}}, {{'p': 'name', 'v': name}}, {{'p': 'connections', 'v': '1'}}]) AS f FROM heads h JOIN items i ON i.chain = h.chain AND pos = 1 WHERE k = 5))"""


@_register(f"""WITH {_ITEMS},
free AS (SELECT h.chain, min(pos) FILTER (WHERE pos > 1 AND equipment_type IN ('pump', 'compressor', 'valve', 'control_valve')) AS block FROM heads h JOIN items USING (chain) GROUP BY h.chain),
relief AS (SELECT h.chain, bool_or(pos <= sure_to) FILTER (WHERE pos <= coalesce(block, 1000000)) AS sure, count(*) AS valves FROM heads h JOIN items i USING (chain) JOIN free USING (chain) JOIN low USING (chain) WHERE pos > 1 AND equipment_type = 'relief_valve' GROUP BY h.chain),
sums AS (SELECT chain, count(*) AS n, count(*) FILTER (WHERE detail IN ('verified', 'FLOWS_TO (out)')) AS verified FROM rows_ GROUP BY chain)
SELECT h.chain AS question_id, CASE k WHEN 9 THEN 'unknown tag' WHEN 10 THEN 'unread' ELSE 'ok' END AS status,
  CASE k WHEN 0 THEN 'downstream' WHEN 1 THEN 'upstream' WHEN 2 THEN 'path' WHEN 3 THEN 'neighbours' WHEN 4 THEN 'relief' WHEN 5 THEN 'info' WHEN 6 THEN 'list' WHEN 7 THEN 'count' WHEN 10 THEN NULL ELSE 'downstream' END AS kind,
  CASE WHEN k IN (0, 2, 3, 4, 5, 8) THEN 'Q-' || h.chain || '-1' WHEN k = 1 THEN 'Q-' || h.chain || '-' || h.n WHEN k = 9 THEN 'Z-' || h.chain || '-1' END AS tag,
  CASE WHEN k IN (9, 10) THEN 0 WHEN k = 6 THEN (SELECT count(*) FROM items WHERE equipment_type = 'vessel') WHEN k = 7 THEN 1 ELSE coalesce(s.n, 0) END AS rows,
  CASE WHEN k IN (9, 10) THEN 0 WHEN k IN (6, 7) THEN 0 ELSE coalesce(verified, 0) END AS verified,
  CASE WHEN k = 4 THEN CASE WHEN sure THEN 'verified' WHEN sure IS NOT NULL THEN 'drawn' WHEN valves > 0 THEN 'not credited' ELSE 'none' END END AS outcome
FROM heads h LEFT JOIN sums s USING (chain) LEFT JOIN relief USING (chain)""")
def g_answers(spark, sf_dir):
    """The envelope of every question."""
    found, _ = _answered(spark, sf_dir)
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return found.envelopes.select("question_id", "status", "kind", "tag", count("rows"), count("verified"), "outcome")


@_register(f"""WITH {_ITEMS} SELECT item, item_type, detail, coalesce(number, 0) AS number FROM rows_
UNION ALL SELECT item, equipment_type, name, 0 FROM items WHERE equipment_type = 'vessel' AND EXISTS (SELECT 1 FROM heads WHERE k = 6)
UNION ALL SELECT NULL, 'pump', NULL, (SELECT count(*) FROM items WHERE equipment_type = 'pump') WHERE EXISTS (SELECT 1 FROM heads WHERE k = 7)""")
def g_answer_rows(spark, sf_dir):
    """The rows of every intent."""
    found, _ = _answered(spark, sf_dir)
    return found.rows.select("item", "item_type", "detail", F.coalesce("number", F.lit(0)).alias("number"))
