"""Queries of the problems tagged llm."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import cluster, dedup, mixing, packing, pii, tokens
from terrafold.session import cut, ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Parts in which the waiting batches are offered to the index, one after the other; the result does not depend on it.
OFFERS = 3


def _offered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The site is indexed once; the waiting batches are offered in turn and the index grows by what each brings."""
    index = dedup.PostingIndex(spark, f"{ensure_checkpoint_dir(spark)}/postings-{uuid.uuid4().hex}")
    index.append(dedup.finite_points(table(spark, sf_dir, "site")), "site")
    batches = table(spark, sf_dir, "site_batches")
    new, repeats = [], []
    for k, (lo, hi) in enumerate(dedup.backlog(batches, OFFERS)):
        n, r = index.offer(batches.where(F.col("ord").between(lo, hi)), f"offer{k:05d}")
        new.append(n)
        repeats.append(r)
    if not new:
        return dedup.accept(batches, index.read())
    return functools.reduce(DataFrame.unionByName, new), functools.reduce(DataFrame.unionByName, repeats)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _offered(spark, sf_dir)[1].select("kept_ord", "dup_ord")


def p2_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points newly accepted."""
    return _offered(spark, sf_dir)[0]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.objects(table(spark, sf_dir, "segments")).select("target_id", "head_ord", "ord")


def p4_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each object's size, centre and most typical points."""
    return cluster.described(cluster.objects(table(spark, sf_dir, "segments")))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [(r["container"], r["capacity"]) for r in table(spark, sf_dir, "containers").limit(packing.MAX_CONTAINERS + 1).collect()]
    return packing.packed(cut(tokens.document_sizes(table(spark, sf_dir, "documents"))), kinds)


def p6_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fill of each container."""
    return packing.fills(p6_packed(spark, sf_dir))


def p7_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each text is used, in pass order of the mix."""
    sizes = cut(tokens.document_sizes(table(spark, sf_dir, "documents")))
    return mixing.mixed(sizes, table(spark, sf_dir, "mix_targets"))[0].select("doc_id", "source", "n_tokens", "times_used", F.round("first_finish", 3).alias("first_finish"))


def p7_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix itself, sorted by virtual finish time."""
    sizes = cut(tokens.document_sizes(table(spark, sf_dir, "documents")))
    return mixing.stream(mixing.mixed(sizes, table(spark, sf_dir, "mix_targets"))[0])


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share each source really gets."""
    sizes = cut(tokens.document_sizes(table(spark, sf_dir, "documents")))
    return mixing.mixed(sizes, table(spark, sf_dir, "mix_targets"))[1].withColumns({"actual_share": F.round("actual_share", 6), "due_tokens": F.round("due_tokens", 3)})


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.mentions(table(spark, sf_dir, "documents"))


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with placeholders."""
    return pii.redacted(table(spark, sf_dir, "documents"))


QUERIES = {"p2_found": p2_found, "p2_accepted": p2_accepted, "p4_found": p4_found, "p4_objects": p4_objects, "p6_packed": p6_packed, "p6_fills": p6_fills, "p7_uses": p7_uses, "p7_stream": p7_stream, "p7_shares": p7_shares, "p8_found": p8_found, "p8_redacted": p8_redacted}
#: Greedy acceptance: a row is settled once an accepted row before it is in reach, or all rows before it in reach are settled. Components: the least ord spreads along links.
_GREEDY = """
WITH RECURSIVE s AS (SELECT ord, min(x) AS x, min(y) AS y, min(z) AS z, min(conf) AS conf, min(late) AS late FROM (SELECT ord, x, y, z, conf, 0 AS late FROM site UNION ALL SELECT ord, x, y, z, conf, 1 FROM site_batches) WHERE ord IS NOT NULL AND isfinite(x) AND isfinite(y) AND isfinite(z) AND isfinite(conf) GROUP BY ord),
c AS (SELECT *, floor(x / 0.05)::BIGINT AS i, floor(y / 0.05)::BIGINT AS j, floor(z / 0.05)::BIGINT AS k FROM s),
n AS (SELECT c.*, i + di AS ni, j + dj AS nj, k + dk AS nk FROM c, (VALUES (-1), (0), (1)) a(di), (VALUES (-1), (0), (1)) b(dj), (VALUES (-1), (0), (1)) d(dk) WHERE late = 1),
e AS MATERIALIZED (SELECT c.ord AS a, n.ord AS b FROM n JOIN c ON ni = c.i AND nj = c.j AND nk = c.k AND c.ord < n.ord WHERE abs(n.conf - c.conf) <= 1.0 AND sqrt(pow(n.x - c.x, 2) + pow(n.y - c.y, 2) + pow(n.z - c.z, 2)) <= 0.05),
m AS MATERIALIZED (SELECT b, count(*) AS n FROM e GROUP BY b),
lab(ord, accepted) USING KEY (ord) AS (
  SELECT ord, true FROM s WHERE late = 0 OR ord NOT IN (SELECT b FROM m)
  UNION
  SELECT w.b, NOT bool_or(r.accepted) FROM (SELECT DISTINCT e.b FROM lab JOIN e ON e.a = lab.ord) w JOIN e ON e.b = w.b JOIN m ON m.b = w.b JOIN recurring.lab r ON r.ord = e.a LEFT JOIN recurring.lab me ON me.ord = w.b
  WHERE me.ord IS NULL GROUP BY w.b, m.n HAVING bool_or(r.accepted) OR count(*) = m.n)
"""
ORACLE: dict[str, str] = {
    "p2_found": _GREEDY + "SELECT min(e.a) AS kept_ord, e.b AS dup_ord FROM e JOIN lab k ON k.ord = e.a AND k.accepted JOIN lab d ON d.ord = e.b AND NOT d.accepted GROUP BY e.b",
    "p2_accepted": _GREEDY + "SELECT s.ord, s.x, s.y, s.z, s.conf FROM s JOIN lab USING (ord) WHERE late = 1 AND accepted",
    "p4_found": """
WITH RECURSIVE p AS (SELECT DISTINCT target_id, ord, x, y, z FROM segments WHERE isfinite(x) AND isfinite(y) AND isfinite(z)),
r AS (SELECT target_id, greatest(0.02 * sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)), 1e-12) AS reach FROM p GROUP BY target_id),
c AS (SELECT target_id, ord, x, y, z, reach, floor(x / reach)::BIGINT AS i, floor(y / reach)::BIGINT AS j, floor(z / reach)::BIGINT AS k FROM p JOIN r USING (target_id)),
n AS (SELECT c.*, i + di AS ni, j + dj AS nj, k + dk AS nk FROM c, (VALUES (-1), (0), (1)) a(di), (VALUES (-1), (0), (1)) b(dj), (VALUES (-1), (0), (1)) d(dk)),
e AS MATERIALIZED (SELECT n.target_id, n.ord AS a, c.ord AS b FROM n JOIN c ON n.target_id = c.target_id AND ni = c.i AND nj = c.j AND nk = c.k AND n.ord <> c.ord WHERE sqrt(pow(n.x - c.x, 2) + pow(n.y - c.y, 2) + pow(n.z - c.z, 2)) <= n.reach),
lab(target_id, ord, head) USING KEY (target_id, ord) AS (
  SELECT target_id, ord, ord FROM p
  UNION
  SELECT e.target_id, e.b, min(lab.head) FROM lab JOIN e ON e.target_id = lab.target_id AND e.a = lab.ord JOIN recurring.lab AS cur ON cur.target_id = e.target_id AND cur.ord = e.b WHERE lab.head < cur.head GROUP BY e.target_id, e.b)
SELECT target_id, head AS head_ord, ord FROM lab QUALIFY count(*) OVER (PARTITION BY target_id, head) >= 20
""",
}
