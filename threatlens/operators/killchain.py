"""Multi-hop paths over internal connections that follow a chain of host name patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..session import settle


def _matches(column: str, pattern: str):
    """A trailing dash means prefix, anything else an exact name."""
    return F.col(column).startswith(pattern) if pattern.endswith("-") else F.col(column) == pattern


def internal_flows(flows: DataFrame) -> DataFrame:
    """Flows known to stay inside; an unknown end does not count as internal."""
    inside = F.coalesce("is_internal_src", F.lit(False)) & F.coalesce("is_internal_dst", F.lit(False))
    return flows.where(inside)


def chain_candidates(flows: DataFrame, hosts: DataFrame, chain: list[str]) -> DataFrame:
    """(hop, ip): addresses that may stand at each place of the chain.

    A pattern without any known host falls back to raw graph nodes of that name.
    """
    named = hosts.groupBy("hostname").agg(F.max("ip_address").alias("ip"))
    nodes = flows.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip"))

    def placed(names: DataFrame, column: str) -> DataFrame:
        hops = F.array_compact(F.array(*[F.when(_matches(column, p), F.lit(i)) for i, p in enumerate(chain)]))
        return names.select(F.explode(hops).alias("hop"), "ip").distinct()

    by_name = placed(named, "hostname")
    by_node = placed(nodes, "ip")  # one pass over the flows for all patterns
    fallback = by_node.join(by_name.select("hop").distinct(), "hop", "left_anti")
    return by_name.unionByName(fallback)


def edges_on_paths(edges: DataFrame, n_hops: int) -> DataFrame:
    """The stored edges (hop, src_ip, dst_ip, ...) that lie on a path over all hops.

    Two passes of semi-joins: from the first hop on, edges stay that an edge of the hop before leads to; from the
    last hop back, those that lead to an edge which stays.
    """
    for hops, own, other in ((range(n_hops), "src_ip", "dst_ip"), (reversed(range(n_hops)), "dst_ip", "src_ip")):
        reached, left = None, None
        for hop in hops:
            step = edges.where(F.col("hop") == hop)
            if reached is not None:
                step = step.join(reached.withColumnRenamed(other, own), own, "left_semi").select(*edges.columns)
            reached = step.select(other).distinct()
            left = step if left is None else left.unionByName(step)
        edges = settle(left, "edges-on-paths")
    return edges


def killchain_paths(flows: DataFrame, hosts: DataFrame, chain: list[str] | None = None) -> DataFrame:
    """Complete paths along the chain with the latest flow of every hop.

    Flows are cut down to candidate ends before they are reduced to distinct edges, and edges are
    reduced before any path is built, so the joins see one row per address pair and hop. Edges that are on no
    complete path leave before paths are joined, so no intermediate result is larger than the output. Every path
    is listed: where patterns let many hosts stand at several hops, the paths are the product of them.
    """
    chain = chain or K.KILL_CHAIN
    inside = internal_flows(flows).select("flow_id", "src_ip", "dst_ip", "start_time")
    who = chain_candidates(inside, hosts, chain)
    starts = who.select(F.col("ip").alias("src_ip"), "hop")
    ends = who.select(F.col("ip").alias("dst_ip"), (F.col("hop") - 1).alias("hop"))
    edges = (
        inside.join(starts, "src_ip").join(ends, ["dst_ip", "hop"])
        .groupBy("hop", "src_ip", "dst_ip")
        .agg(F.max(F.struct("start_time", "flow_id")).alias("latest"))
        .select("hop", "src_ip", "dst_ip", F.col("latest.flow_id").alias("flow_id"))
    )
    edges = edges_on_paths(settle(edges, "edges"), len(chain) - 1)
    paths = None
    for hop in range(len(chain) - 1):
        step = edges.where(F.col("hop") == hop).select(
            F.col("src_ip").alias(f"n{hop}"), F.col("dst_ip").alias(f"n{hop + 1}"),
            F.col("flow_id").alias(f"f{hop}"),
        )
        paths = step if paths is None else paths.join(step, f"n{hop}")
    nodes = [f"n{i}" for i in range(len(chain))]
    ids = [f"f{i}" for i in range(len(chain) - 1)]
    return paths.select(
        F.lit(K.KILL_CHAIN_ID).alias("incident_id"),
        F.concat_ws("→", *nodes).alias("kill_chain"),
        F.col("n0").alias("source_host"),
        F.array(*ids).alias("chain_flow_ids"),
        F.array(*[F.lit(t) for t in K.KILL_CHAIN_TACTICS]).alias("mitre_tactics"),
        F.array(*[F.lit(t) for t in K.KILL_CHAIN_TECHNIQUES]).alias("mitre_techniques"),
        F.lit(K.KILL_CHAIN_CONFIDENCE).alias("confidence"),
    )
