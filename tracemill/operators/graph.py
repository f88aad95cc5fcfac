"""Call graphs: edges between calls, node positions around a centre, compact links, process nodes, and diagram text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import timestats as T
from . import stats as st

#: Where a service stands to the centre, weakest first, and the positions that a scope shows.
POSITIONS = ("Unknown", "Outbound", "Inbound", "OutboundCenter", "InboundCenter", "Center")
SCOPES = {"full": POSITIONS, "centered": POSITIONS[3:], "inbound": ("Inbound", "InboundCenter", "Center"), "outbound": ("Outbound", "OutboundCenter", "Center")}
LINKS = ("Default", "Reachable", "Emphasized")
#: Colours and styles of a diagram's nodes and links.
COLOURS, LINK_STYLE = {2: "#3333ff", 1: "#99ccff"}, "stroke-width:4px,color:blue"
CENTRE_FILL, OPERATION_FILL = "fill:#00b33c", "fill:#00802b"
#: Edge values of a diagram: metric labels and columns.
VALUES = {"count": "count", "rate (req/sec)": "rate", "average duration millis": "avg_ms", "p75 millis": "p75_ms", "p90 millis": "p90_ms", "p95 millis": "p95_ms", "p99 millis": "p99_ms"}


def edges(keyed: DataFrame) -> DataFrame:
    """from_service, from_operation, to_service, to_operation, count, avg_ms: the last pair of calls of each span's chain."""
    a, b = F.element_at("call_chain", -2), F.element_at("call_chain", -1)
    x = keyed.where("size(call_chain) >= 2").select(a["service"].alias("from_service"), a["operation"].alias("from_operation"), b["service"].alias("to_service"), b["operation"].alias("to_operation"), "duration_us")
    return x.groupBy("from_service", "from_operation", "to_service", "to_operation").agg(F.count("*").alias("count"), F.round(F.avg("duration_us") / 1000, 6).alias("avg_ms"))


def paths(keyed: DataFrame) -> DataFrame:
    """steps: the distinct paths of calls, as arrays of service/operation."""
    return keyed.select(F.transform("call_chain", S.plain_call).alias("steps")).distinct()


def chain_table(keyed: DataFrame, statistics: bool = True) -> DataFrame:
    """chain_key, call_chain, steps and count of each chain, with statistics rate, avg_ms and percentiles too."""
    own = keyed.groupBy("chain_key").agg(F.first("call_chain").alias("call_chain"), st.rows(keyed).alias("count"))
    own = own.withColumn("steps", F.transform("call_chain", S.plain_call))
    if not statistics:
        return own
    rate = T.rates(keyed, ["chain_key"]).select("chain_key", F.col("avg_rate").alias("rate"))
    return own.join(st.chain_stats(keyed).drop("count"), "chain_key").join(rate, "chain_key")


def related(chains: DataFrame, all_paths: DataFrame, service: str, operation: str | None = None) -> DataFrame:
    """Chains that lead to a service (or one of its operations), with embedding: Extended if a longest path to it begins the chain, Embedded if
    the chain begins such a path. Prefixes are exploded, so both are equi joins. chains: steps; all_paths: paths()."""
    last = F.element_at("steps", -1)
    ends = all_paths.where(F.startswith(last, F.lit(f"{service}/")) if operation is None else last == f"{service}/{operation}")
    prefixes = lambda most: F.transform(F.sequence(F.lit(1), most), lambda i: F.slice("steps", 1, i))
    inner = ends.where("size(steps) > 1").select(F.explode(prefixes(F.size("steps") - 1)).alias("steps")).distinct()
    longest = ends.join(inner, "steps", "left_anti")
    begun = all_paths.select("steps", F.explode(prefixes(F.size("steps"))).alias("_p")).join(longest.select(F.col("steps").alias("_p")), "_p", "left_semi").select("steps").distinct()
    kinds = begun.withColumn("embedding", F.lit("Extended")).unionByName(all_paths.join(inner, "steps", "left_semi").join(begun, "steps", "left_anti").withColumn("embedding", F.lit("Embedded")))
    return chains.join(kinds, "steps")


def service_graph(chains: DataFrame, all_paths: DataFrame, service: str, operation: str | None = None, selected: str | None = None) -> DataFrame:
    """Edges of the chains that lead to a service: the last two calls of each, statistics (counts and rates add up, the rest are means by
    count), positions of both ends, and, for a selected chain, link_type and the count of chains reachable over it (inbound_count)."""
    a, b = F.element_at("call_chain", -2), F.element_at("call_chain", -1)
    x = related(chains, all_paths, service, operation).where("size(call_chain) >= 2")
    x = x.select("*", a["service"].alias("from_service"), a["operation"].alias("from_operation"), b["service"].alias("to_service"), b["operation"].alias("to_operation"))
    begins = ""
    if selected is not None:
        at = selected.rfind(service + "/" + (operation or ""))
        begins = selected[: at + len(service + "/" + (operation or ""))] if at >= 0 else ""
    x = x.withColumn("_in", F.startswith("chain_key", F.lit(begins)) if begins else F.lit(False))
    mean = lambda c: F.try_divide(F.sum(F.col(c) * F.col("count")), F.sum(F.when(F.col(c).isNotNull(), F.col("count"))))
    out_of, into = F.col("from_service") == service, F.col("to_service") == service
    default = F.when(F.col("embedding") == "Embedded", 2).otherwise(1)
    near = F.when(out_of, 5).when(into, 4).otherwise(default), F.when(into, 5).when(out_of, 3).otherwise(default)
    g = x.groupBy("from_service", "from_operation", "to_service", "to_operation").agg(
        F.sum("count").alias("count"), *[(F.sum(c) if c == "rate" else mean(c)).alias(c) for c in ("rate", "avg_ms", "p75_ms", "p90_ms", "p95_ms", "p99_ms") if c in x.columns],
        F.max(near[0]).alias("from_rank"), F.max(near[1]).alias("to_rank"), F.sum(F.when(F.col("_in"), F.col("count"))).alias("inbound_count"),
    )
    steps = [s.strip().rsplit(" [", 1)[0] for s in selected.split("&")[0].split(" | ")] if selected else []
    on_path = F.concat_ws("/", "from_service", "from_operation", F.lit(">"), "to_service", "to_operation").isin([f"{p}/>/{q}" for p, q in zip(steps, steps[1:])] or [""])
    return g.withColumn("link_type", F.when(on_path, "Emphasized").when(F.col("inbound_count").isNotNull(), "Reachable").otherwise("Default"))


def positions(graph_edges: DataFrame) -> DataFrame:
    """service, position: the strongest of a service's positions on its edges; between the weakest two, Inbound."""
    side = lambda s: graph_edges.select(F.col(f"{s}_service").alias("service"), F.col(f"{s}_rank").alias("r"))
    x = side("from").unionByName(side("to")).groupBy("service").agg(F.max("r").alias("r"))
    return x.select("service", F.element_at(F.array(*map(F.lit, POSITIONS)), F.col("r") + 1).alias("position"))


def compact(edge_table: DataFrame) -> DataFrame:
    """Edges between services."""
    return edge_table.groupBy("from_service", "to_service").agg(F.sum("count").alias("count"))


def reachable(keyed: DataFrame, service: str) -> DataFrame:
    """Chains that go on from the last occurrence of a call of `service`: prefix up to it, and how often each."""
    pattern = rf"^.*\Q{service}\E/"
    prefix = F.regexp_extract("chain_key", pattern, 0)
    return keyed.where(prefix != "").groupBy(prefix.alias("prefix")).agg(st.rows(keyed).alias("count"))


def process_nodes(keyed: DataFrame) -> DataFrame:
    """Calls per service, direction and operation; a service's first call in a chain counts as inbound unless it is outbound."""
    c = F.col("call_chain")
    fixed = F.transform(c, lambda x, i: F.struct(x["service"].alias("service"), x["operation"].alias("operation"), F.when((x["call_direction"] != "Outbound") & ((i == 0) | (F.get(c, i - 1)["service"] != x["service"])), F.lit("Inbound")).otherwise(x["call_direction"]).alias("direction")))
    return keyed.select(F.inline(fixed)).groupBy("service", "direction", "operation").agg(F.count("*").alias("count"))


def mermaid(edge_rows: list, value: str = "count", title: str | None = None, service: str | None = None, operation: str | None = None, scope: str = "full", whole_services: bool = False) -> str:
    """Diagram text of collected edge rows (few: one per pair of calls). Links show a value, and after a slash the count over the selected chain.

    A scope hides links whose target stands elsewhere; whole_services: one node per service and only nodes in scope, without links that
    leave an inbound or enter an outbound operation of the other side."""
    esc = lambda s: s.translate(str.maketrans(" {}()", "_____"))
    rows = sorted(edge_rows, key=lambda r: (r["from_service"], r["from_operation"], r["to_service"], r["to_operation"]))
    get = lambda r, c: r[c] if c in r else None
    rank: dict[str, int] = {}
    for r in rows:
        for side in ("from", "to"):
            rank[r[f"{side}_service"]] = max(rank.get(r[f"{side}_service"], 0), get(r, f"{side}_rank") or 0)
    shown = lambda s: scope == "full" or POSITIONS[rank[s]] in SCOPES[scope]
    links: dict[tuple[str, str], list] = {}
    nodes: dict[str, set[str]] = {}
    for r in rows:
        a, b = r["from_service"], r["to_service"]
        if not whole_services:
            nodes.setdefault(a, set()).add(r["from_operation"])
            nodes.setdefault(b, set()).add(r["to_operation"])
        elif not (shown(a) and shown(b)):
            continue
        else:
            nodes.setdefault(a, set()), nodes.setdefault(b, set())
        if shown(b):
            ends = (a, b) if whole_services else (f"{a}/{r['from_operation']}", f"{b}/{r['to_operation']}")
            own = links.setdefault(ends, [None, None, 0])
            for i, v in enumerate((r[value], get(r, "inbound_count"))):
                own[i] = v if own[i] is None else own[i] + (v or 0)
            own[2] = max(own[2], LINKS.index(get(r, "link_type") or "Default"))
    out = [f"---\ntitle: {title}\n---"] if title else []
    out.append("graph LR")
    for s in sorted(nodes):
        if whole_services:
            out += [f'  {esc(s)}(["{s}"])'] + ([f"  style {esc(s)} {CENTRE_FILL}"] if s == service else [])
            continue
        out.append(f'  subgraph {esc(s)} ["{s}"]' if esc(s) != s else f"  subgraph {s}")
        for o in sorted(nodes[s]):
            out.append(f'    {esc(s + "/" + o)}(["{s}/{o}"])')
            if s == service and o == operation:
                out.append(f"    style {esc(s + '/' + o)} {OPERATION_FILL}")
        out += ["  end"] + ([f"  style {esc(s)} {CENTRE_FILL}"] if s == service else [])
    for (a, b), (v, w, kind) in links.items():
        text = "" if v is None else f"|{v:.0f}|" if w is None else f"|{v:.0f}/{w:.0f}|"
        out.append(f"  {esc(a)} {'==>' if kind == 2 else '-->'}{text} {esc(b)}")
    for kind, colour in COLOURS.items():
        own = [str(i) for i, k in enumerate(links.values()) if k[2] == kind]
        if own:
            out.append(f"linkStyle {','.join(own)} stroke:{colour},{LINK_STYLE};")
    return "\n".join(out) + "\n"


def inbound_prefix(chains: DataFrame, prefixes: DataFrame) -> DataFrame:
    """chains: chain_key. The index of the longest of prefixes (prefix, idx) that a key starts with; 0 if none. prefixes is a viewer's list. Keys are
    cut at the lengths that prefixes have (no more of them than the longest has characters), so the match is an equi join."""
    lengths = [r[0] for r in prefixes.select(F.length("prefix")).distinct().collect()]
    cut = chains.select("chain_key").distinct().select("chain_key", F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")).alias("_n")).where("_n <= length(chain_key)")
    hit = cut.select("chain_key", F.expr("left(chain_key, _n)").alias("prefix")).join(prefixes, "prefix").groupBy("chain_key").agg(F.max_by("idx", F.length("prefix")).alias("inbound_idx"))
    return chains.select("chain_key").distinct().join(hit, "chain_key", "left").select("chain_key", F.coalesce("inbound_idx", F.lit(0)).alias("inbound_idx"))
