"""What happens to a query before it is searched."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, SparkSession, functions as F, types as T

# Acronyms and what they stand for; pass another table for other domains.
ACRONYMS = {
    "EVPN": "Ethernet VPN",
    "VXLAN": "Virtual Extensible LAN",
    "MLAG": "Multi-chassis Link Aggregation",
    "BGP": "Border Gateway Protocol",
    "OSPF": "Open Shortest Path First",
    "LACP": "Link Aggregation Control Protocol",
    "sFlow": "sampled flow",
    "SR": "Segment Routing",
    "MSS": "Multi-domain Segment Security",
    "LANZ": "Latency Analyzer",
    "VARP": "Virtual ARP",
    "VRRP": "Virtual Router Redundancy Protocol",
    "VRF": "Virtual Routing and Forwarding",
    "QoS": "Quality of Service",
    "ACL": "Access Control List",
    "TCAM": "Ternary Content-Addressable Memory",
}
# Openings of a query that say nothing about its subject, tried in this order.
OPENINGS = (
    "how do i ", "how do you ", "how to ", "how can i ", "how can you ", "what is the ",
    "what are the ", "what is ", "what are ", "what does ", "what do ", "where is ",
    "where are ", "show me how to ", "show me ", "tell me about ", "tell me how to ",
    "explain how to ", "explain ", "describe ", "configure ", "setup ", "set up ", "enable ",
)
_TOKEN = re.compile(r"\b\w[\w\-]*\b")
_OPENING = re.compile(r"\s*(?:" + "|".join(map(re.escape, OPENINGS)) + r")", re.I)


def annotate(query: str | None, acronyms: Mapping[str, str] = ACRONYMS) -> str | None:
    """The query with each known acronym explained once, where it comes first."""
    if query is None:
        return None
    meaning = {k.lower(): v for k, v in acronyms.items()}

    def explain(m: re.Match) -> str:
        known = meaning.pop(m[0].lower(), None)
        return m[0] if known is None else f"{m[0]} ({known})"

    return _TOKEN.sub(explain, query)


def variants(query: str | None) -> list[str]:
    """The query, then it without parentheses, then without its openings."""
    if query is None:
        return []
    plain = re.sub(r"\s{2,}", " ", re.sub(r"\s*\([^)]*\)", "", query)).strip() if "(" in query else query
    out = [query, plain]
    rest = plain or query
    for _ in range(3):
        m = _OPENING.match(rest)
        tail = rest[m.end() :].strip() if m else ""
        if len(tail) < 3:
            break
        out.append(tail)
        rest = tail
    return [v for v in dict.fromkeys(out) if v == query or v.strip()]


def annotated(c: Column, acronyms: Mapping[str, str] = ACRONYMS) -> Column:
    """:func:`annotate` over a (small) query set."""
    table = dict(acronyms)
    return F.udf(lambda q: annotate(q, table), T.StringType(), useArrow=True)(c)


def query_variants(c: Column) -> Column:
    return F.udf(variants, T.ArrayType(T.StringType()), useArrow=True)(c)


def register(spark: SparkSession) -> None:
    """Make the query and text functions callable from SQL."""
    from corpusmill.functions.analyze import analyze

    words = T.ArrayType(T.StringType())
    for name, f, kind in (
        ("annotate_query", annotate, T.StringType()),
        ("query_variants", variants, words),
        ("analyze_text", analyze, words),
    ):
        spark.udf.register(name, F.udf(f, kind, useArrow=True))
