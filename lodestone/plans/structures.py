"""Importance and components of graphs made of the driver's tables."""

from pyspark.sql import functions as F

from ..operators import structure
from ..sources.store import table
from . import query
from .graphing import BOTH, edges, nodes


def importance_sql(rounds: int) -> str:
    steps = ["r0 AS MATERIALIZED (SELECT node_id, 1 / (SELECT count(*) FROM nodes)::DOUBLE AS s FROM nodes)", "o AS MATERIALIZED (SELECT from_id, count(*) AS out FROM e GROUP BY from_id)"]
    for i in range(rounds):
        steps.append(f"g{i} AS MATERIALIZED (SELECT to_id AS node_id, sum(s / out) AS got FROM e JOIN r{i} ON node_id = e.from_id JOIN o ON o.from_id = e.from_id GROUP BY to_id)")
        steps.append(f"d{i} AS (SELECT coalesce(sum(s), 0) AS d FROM r{i} WHERE node_id NOT IN (SELECT from_id FROM o))")
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT node_id, (0.15 + 0.85 * d) / (SELECT count(*) FROM nodes) + 0.85 * coalesce(got, 0) AS s FROM r{i} LEFT JOIN g{i} USING (node_id), d{i})")
    return f"WITH {BOTH}, e AS MATERIALIZED (SELECT DISTINCT from_id, to_id FROM edges), {', '.join(steps)} SELECT node_id, round(s, 9) AS score FROM r{rounds}"


@query(importance_sql(10))
def node_importance(spark, sf_dir):
    return structure.importance(nodes(spark, sf_dir), edges(spark, sf_dir), rounds=10).select("node_id", F.round("score", 9).alias("score"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'P' || l_partkey AS a, 'S' || l_suppkey AS b FROM lineitem WHERE l_quantity < 3 UNION SELECT DISTINCT 'S' || l_suppkey, 'P' || l_partkey FROM lineitem WHERE l_quantity > 48),
n AS (SELECT a AS node_id FROM e UNION SELECT b FROM e), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT x.a AS node_id, max(x.b) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a) SELECT node_id, coalesce(component, node_id) AS component FROM n LEFT JOIN c USING (node_id)""")
def component_of_nodes(spark, sf_dir):
    """Parts point to the suppliers that sell few of them at once, suppliers to the parts of which they sell many: who is in a circle with whom."""
    l = table(spark, sf_dir, "lineitem")
    p, s = F.concat(F.lit("P"), F.col("l_partkey").cast("string")), F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    e = l.filter("l_quantity < 3").select(p.alias("from_id"), s.alias("to_id")).union(l.filter("l_quantity > 48").select(s, p)).distinct()
    return structure.strong_components(e.select(F.explode(F.array("from_id", "to_id")).alias("node_id")), e)
