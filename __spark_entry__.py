"""

The graph of most queries is the *trade graph* of ``lineitem``: every row links
the ids of its part and its supplier, self-loops and repeats dropped. Each table
row is one edge, so the graph grows with the table. Suppliers are its hubs.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import tightknit as tk  # noqa: E402
from tightknit.functions.text import format_info  # noqa: E402
from tightknit.plans.stable import LIST_BOUND, table_folder  # noqa: E402

try:  # The text operators and the pipeline built from them can be left out.
    from tightknit.llm import queries as text_operators  # noqa: E402
except ImportError:
    text_operators = None
try:
    import corpus_pipeline  # noqa: E402
except ImportError:
    corpus_pipeline = None

SMOKE_DIR = "/root/testdata/sf0.001"


def entry(spark: SparkSession) -> DataFrame:
    """Clique histogram of the trade graph."""
    return tk.clique_histogram(trade(spark, SMOKE_DIR), 4)


# --- inputs -----------------------------------------------------------------


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.edges_from_pairs(lineitem(spark, sf_dir), "l_partkey", "l_suppkey")


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trade graph as a stored table, for the jobs that read it more than once."""
    return tk.stable(trade_edges(spark, sf_dir))


def all_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices known beside the edges: every part, every supplier and every order.

    Order keys above the part keys name vertices without any edge.
    """
    keys = [("part", "p_partkey"), ("supplier", "s_suppkey"), ("orders", "o_orderkey")]
    parts = [spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.col(c).alias("v")) for t, c in keys]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


def edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` written out as a messy edge list, one line per row."""
    part, supp = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    line = (
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit("# "), part, F.lit(" "), supp))
        .when((F.col("l_linenumber") == 2) & (F.col("l_returnflag") == "A"), F.lit("   "))
        .when(F.col("l_linenumber") == 2, part)
        .when((F.col("l_linenumber") == 3) & (F.col("l_returnflag") == "A"), F.concat(F.lit("x"), part, F.lit(" "), supp))
        .when(F.col("l_linenumber") == 4, F.concat(F.lit("  "), part, F.lit("\t"), supp, F.lit(" 0.5 x")))
        .when(F.col("l_linenumber") == 5, F.concat(supp, F.lit(" "), supp))
        .otherwise(F.concat(part, F.lit(" "), supp))
    )
    return lineitem(spark, sf_dir).select(line.alias("value"))


def adjacency_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions of the trade graph as lines of one arc, with comments, arcs left out and bad tokens."""
    v, w = F.col("v").cast("string"), F.col("w").cast("string")
    arc = F.concat(v, F.lit(" "), w)
    arcs = tk.symmetrize(trade_edges(spark, sf_dir)).toDF("v", "w")
    line = (
        F.when(F.pmod(F.col("v") + 2 * F.col("w"), F.lit(11)) == 0, F.concat(F.lit("# "), arc))
        .when(F.pmod(F.col("v") + 2 * F.col("w"), F.lit(11)) == 1, F.concat(arc, F.lit(" 7x")))
        .when(F.pmod(F.col("v") + 2 * F.col("w"), F.lit(11)) == 2, F.concat(F.lit(" "), v, F.lit("\t"), w, F.lit(" "), v))
        .otherwise(arc)
    )
    return arcs.select(line.alias("value"))


def scratch_path(spark: SparkSession) -> str:
    return f"{table_folder(spark)}/text-{uuid.uuid4().hex}"


# --- output shapes ----------------------------------------------------------


def clique_rows(cliques: DataFrame) -> DataFrame:
    return cliques.select(tk.clique_text().alias("clique"), "clique_size", "anchor")


def list_rows(adj: DataFrame) -> DataFrame:
    return adj.select("v", "part", "degree", F.array_join("nbrs", " ").alias("nbrs"))


def state_rows(frontier: DataFrame) -> DataFrame:
    return frontier.select(
        tk.clique_text().alias("clique"), F.array_join(F.sort_array("ext"), " ").alias("ext")
    )


# --- queries ----------------------------------------------------------------


def _edge_list_file(spark, sf_dir) -> tk.sources.edge_list.EdgeList:
    path = scratch_path(spark)
    edge_lines(spark, sf_dir).write.text(path)
    return tk.read_edge_list(spark, path)


def _edge_list_stored(spark, sf_dir) -> tk.sources.edge_list.EdgeList:
    path = scratch_path(spark)
    edge_lines(spark, sf_dir).write.text(path)
    return tk.read_edge_list(spark, path, stored=True)


def _adjacency_file(spark, sf_dir) -> DataFrame:
    adj = tk.adjacency(trade(spark, sf_dir), "both")
    path = tk.write_neighbor_list(adj, scratch_path(spark))
    return tk.read_adjacency(spark, path, merge=True)


def _clique_file(spark, sf_dir, sep) -> DataFrame:
    found = tk.kcliques(trade(spark, sf_dir), 4)
    compression = "gzip" if sep == "," else None
    path = tk.write_cliques(found, scratch_path(spark), sep=sep, compression=compression, num_partitions=3)
    return clique_rows(tk.read_cliques(spark, path, sep=sep))


def _maximal_file(spark, sf_dir) -> DataFrame:
    found = tk.maximal_cliques(trade(spark, sf_dir))
    path = tk.write_maximal(found, scratch_path(spark), compression="gzip", run_id="now")
    return clique_rows(tk.read_maximal(spark, path))


def _bigger(spark, sf_dir) -> DataFrame:
    edges = trade(spark, sf_dir)
    return tk.adjacency(edges, "out", vertices=tk.vertices_of(edges))


def _ranked_by_id(edges: DataFrame) -> DataFrame:
    return tk.rank_graph(edges, "id").out


def _first_states(spark, sf_dir) -> DataFrame:
    edges = trade(spark, sf_dir)
    return tk.init_frontier(_ranked_by_id(edges), tk.vertices_of(edges))


def _first_children(spark, sf_dir) -> DataFrame:
    graph = tk.rank_graph(trade(spark, sf_dir), "id")
    return tk.expand(tk.init_frontier(graph.out), graph.out, graph.longest)


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and the customers who ordered them, linked by id; few vertices are much above the others."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    bought = lineitem(spark, sf_dir).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return tk.edges_from_pairs(bought, "l_partkey", "o_custkey")


def _compact_file(spark, sf_dir) -> DataFrame:
    listing = tk.kcliques(trade(spark, sf_dir), 4, compact=True)
    path = tk.write_cliques(listing, scratch_path(spark), compression="gzip", num_partitions=3)
    return clique_rows(tk.read_cliques(spark, path))


def _maximal_of(edges: DataFrame, listed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return tk.is_maximal(listed(edges), edges)


def _count(k: int, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: tk.count_kcliques(trade(spark, sf_dir), k, **options)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator; each callable takes ``(spark, sf_dir)``."""
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        # sources, parsing, sinks
        "edges_trade": trade_edges,
        "edge_list_parse": lambda s, d: _edge_list_file(s, d).edges,
        "edge_list_vertices": lambda s, d: _edge_list_file(s, d).vertices,
        "edge_list_rejects": lambda s, d: tk.parse_edge_lines(edge_lines(s, d)).rejects,
        "edge_list_stored_edges": lambda s, d: _edge_list_stored(s, d).edges,
        "edge_list_stored_vertices": lambda s, d: _edge_list_stored(s, d).vertices,
        "edge_list_stored_rejects": lambda s, d: _edge_list_stored(s, d).rejects,
        "adjacency_rejects": lambda s, d: tk.check_adjacency_lines(adjacency_lines(s, d)).rejects,
        "adjacency_one_sided": lambda s, d: tk.one_sided(tk.check_adjacency_lines(adjacency_lines(s, d)).lists),
        "adjacency_parse": lambda s, d: _adjacency_file(s, d).select(
            "v", F.array_join("nbrs", " ").alias("nbrs")
        ),
        "adjacency_edges": lambda s, d: tk.edges_from_adjacency(_adjacency_file(s, d)),
        "clique_text_roundtrip": lambda s, d: _clique_file(s, d, ","),
        "clique_tab_roundtrip": lambda s, d: _clique_file(s, d, "\t"),
        "clique_compact_roundtrip": _compact_file,
        "maximal_text_roundtrip": _maximal_file,
        # graph
        "vertices": lambda s, d: tk.vertices_of(trade_edges(s, d), ordered=True),
        "symmetrize": lambda s, d: tk.symmetrize(trade_edges(s, d)),
        "neighbor_list": lambda s, d: list_rows(tk.adjacency(trade(s, d), "both")),
        "bigger_neighbors": lambda s, d: list_rows(_bigger(s, d)),
        "smaller_neighbors": lambda s, d: list_rows(
            tk.adjacency(trade(s, d), "in", vertices=all_ids(s, d))
        ),
        "neighbor_lookup": lambda s, d: list_rows(
            tk.neighbors(
                trade_edges(s, d),
                s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("v")),
            )
        ),
        "list_integrity": lambda s, d: tk.list_integrity(tk.adjacency(trade(s, d), "both")),
        "checked_lists": lambda s, d: list_rows(tk.checked_lists(tk.adjacency(trade(s, d), "both"))),
        "degrees": lambda s, d: tk.degrees(trade_edges(s, d)),
        "graph_info": lambda s, d: tk.graph_info(trade_edges(s, d)),
        "graph_info_text": lambda s, d: format_info(tk.graph_info(trade_edges(s, d), all_ids(s, d))),
        "ego_network": lambda s, d: tk.ego_network(trade(s, d)),
        "ego_network_above": lambda s, d: tk.ego_network(trade(s, d), above=True),
        # states
        "init_frontier": lambda s, d: state_rows(_first_states(s, d)),
        "expand": lambda s, d: state_rows(_first_children(s, d)),
        "degree_prune_k5": lambda s, d: list_rows(tk.prune_vertices(_bigger(s, d), 5)),
        "bound_prune_k5": lambda s, d: state_rows(tk.bound_prune(_first_children(s, d), 5)),
        "format_state": lambda s, d: _first_states(s, d).select(tk.format_state().alias("state")),
        "prune_core_k36": lambda s, d: tk.prune_core(purchases(s, d), 36),
        # k-cliques
        "triangle_count": lambda s, d: tk.triangle_count(trade(s, d)),
        "triangles": lambda s, d: clique_rows(tk.triangles(trade(s, d))),
        "kcliques_k4": lambda s, d: clique_rows(tk.kcliques(trade(s, d), 4)),
        "kcliques_k5_ego": lambda s, d: clique_rows(tk.kcliques(trade(s, d), 5, strategy="ego")),
        "kcliques_k5_bitmap": lambda s, d: clique_rows(tk.kcliques(trade(s, d), 5, strategy="bitmap")),
        "kcliques_k4_peeled": lambda s, d: clique_rows(tk.kcliques(trade(s, d), 4, peel=True)),
        "clique_count_compact_k4": lambda s, d: tk.count_compact(tk.kcliques(trade(s, d), 4, compact=True)),
        "cliques_upto_k4": lambda s, d: clique_rows(tk.cliques_upto(trade(s, d), 4)),
        "clique_histogram_k6": lambda s, d: tk.clique_histogram(trade(s, d), 6, vertices=all_ids(s, d)),
        "clique_histogram_k6_ego": lambda s, d: tk.clique_histogram(
            trade(s, d), 6, strategy="ego", vertices=all_ids(s, d)
        ),
        "clique_histogram_k6_bitmap": lambda s, d: tk.clique_histogram(
            trade(s, d), 6, strategy="bitmap", vertices=all_ids(s, d)
        ),
        "clique_report_k6": lambda s, d: tk.format_report(
            tk.clique_histogram(trade(s, d), 6, vertices=all_ids(s, d))
        ),
        "cliques_per_anchor_k4": lambda s, d: tk.cliques_per_anchor(trade(s, d), 4),
        "cliques_per_last_k4": lambda s, d: tk.cliques_per_anchor(trade(s, d), 4, anchor="max"),
        # maximal cliques
        "maximal_cliques": lambda s, d: clique_rows(tk.maximal_cliques(trade(s, d), pivot=False)),
        "maximal_cliques_pivot": lambda s, d: clique_rows(
            tk.maximal_cliques(trade(s, d), vertices=all_ids(s, d))
        ),
        "maximal_cliques_max_pivot": lambda s, d: clique_rows(
            tk.maximal_cliques(trade(s, d), pivot="max", order="id")
        ),
        "maximal_histogram": lambda s, d: tk.maximal_histogram(trade(s, d)),
        "maximal_per_anchor": lambda s, d: tk.maximal_cliques(trade(s, d), order="id")
        .groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("n_cliques")),
        "maximal_exact_k6": lambda s, d: tk.count_maximal_k(trade(s, d), 6),
        "maximal_exact_k6_peeled": lambda s, d: tk.count_maximal_k(trade(s, d), 6, peel=True),
        "is_maximal_k4": lambda s, d: clique_rows(
            _maximal_of(trade(s, d), lambda edges: tk.kcliques(edges, 4))
        ),
        "is_maximal_upto_k4": lambda s, d: clique_rows(
            _maximal_of(trade(s, d), lambda edges: tk.cliques_upto(edges, 4))
        ),
    }
    for strategy in ("join", "broadcast", "ego", "bitmap"):
        for k in (1, 2, 3, 4, 5):
            found[f"kclique_count_k{k}_{strategy}"] = _count(k, strategy=strategy)
    for order in ("id", "degree", "random", "core"):
        found[f"kclique_count_{order}_order"] = _count(5, order=order, seed=7)
    found["kclique_count_k4_partitions"] = _count(4, strategy="join", num_partitions=5)
    if text_operators:
        found |= text_operators.queries()
    if corpus_pipeline:
        found["pipeline"] = corpus_pipeline.run
    return found


# --- oracles ----------------------------------------------------------------

EDGES = """edges as materialized (
  select distinct least(l_partkey, l_suppkey) as src, greatest(l_partkey, l_suppkey) as dst
  from lineitem where l_partkey <> l_suppkey)"""

ARCS = "arcs as materialized (select src as v, dst as w from edges union all select dst, src from edges)"

IDS = """ids as materialized (
  select p_partkey as v from part union select s_suppkey from supplier union select o_orderkey from orders)"""

OUT = "outs as materialized (select src as v, list(dst order by dst) as nbrs from edges group by src)"

LISTS = "lists as materialized (select v, list(w order by w) as nbrs from arcs group by v)"


def _states(k: int) -> str:
    """All states of fewer than k members: the clique and the larger common neighbors."""
    return f"""states(clique, ext) as (
  select [v], nbrs from outs
  union all
  select list_append(s.clique, s.w), list_intersect(list_filter(s.ext, lambda x: x > s.w), o.nbrs)
  from (select clique, ext, unnest(ext) as w from states where len(clique) < {k - 1}) s
  join outs o on o.v = s.w)"""


def _cliques(k: int) -> str:
    """The k-cliques as ascending lists."""
    return f"""{_states(k)}, cliques as (
  select list_append(clique, unnest(ext)) as clique from states where len(clique) = {k - 1})"""


MAXIMAL = """search(clique, cand, fini) as (
  select [v], list_filter(nbrs, lambda x: x > v), list_filter(nbrs, lambda x: x < v) from lists
  union all
  select list_append(s.clique, s.w), list_intersect(s.cand[s.i + 1:], l.nbrs),
         list_intersect(list_concat(s.fini, s.cand[:s.i - 1]), l.nbrs)
  from (select clique, cand, fini, unnest(cand) as w, unnest(range(1, len(cand) + 1)) as i from search) s
  join lists l on l.v = s.w),
maximal as (
  select clique, len(clique)::int as clique_size, list_max(clique) as anchor
  from search where len(cand) = 0 and len(fini) = 0)"""

CLIQUE_ROWS = (
    "select array_to_string(list_sort(clique), ',') as clique, len(clique)::int as clique_size, "
    "{pick}(clique) as anchor from cliques"
)

LINES = r"""lines as (
  select case
    when l_linenumber = 1 then '# ' || l_partkey || ' ' || l_suppkey
    when l_linenumber = 2 and l_returnflag = 'A' then '   '
    when l_linenumber = 2 then l_partkey::varchar
    when l_linenumber = 3 and l_returnflag = 'A' then 'x' || l_partkey || ' ' || l_suppkey
    when l_linenumber = 4 then '  ' || l_partkey || chr(9) || l_suppkey || ' 0.5 x'
    when l_linenumber = 5 then l_suppkey || ' ' || l_suppkey
    else l_partkey || ' ' || l_suppkey end as line
  from lineitem),
tokens as (
  select line, regexp_split_to_array(regexp_replace(line, '^\s+|\s+$', '', 'g'), '\s+') as t from lines),
parsed as (
  select line, len(t) as n, try_cast(t[1] as bigint) as src, try_cast(t[2] as bigint) as dst
  from tokens where t[1] <> '' and not starts_with(t[1], '#'))"""

#: A row for every LIST_BOUND neighbors; an empty list has one.
LIST_ROWS = f"""select v, p::int as part, len(nbrs)::bigint as degree,
  array_to_string(nbrs[p * {LIST_BOUND} + 1:(p + 1) * {LIST_BOUND}], ' ') as nbrs
from (select v, nbrs, unnest(range(greatest((len(nbrs) + {LIST_BOUND - 1}) // {LIST_BOUND}, 1))) as p from {{source}})"""

HISTOGRAM = f"""with recursive {EDGES}, {IDS}, {OUT}, {_states(6)},
counts as (
  select 1 as clique_size, count(*)::bigint as n from (select v from ids union select src from edges union select dst from edges)
  union all
  select len(clique) + 1, sum(len(ext))::bigint from states group by 1),
hist as (
  select s::int as clique_size, coalesce(sum(n), 0)::bigint as n_cliques
  from range(1, 7) r(s) left join counts on clique_size = s group by s)"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for every key of ``queries()``."""
    children = f"""with recursive {EDGES}, {OUT}, children as (
  select [s.v, s.w] as clique, list_sort(list_intersect(s.nbrs, coalesce(o.nbrs, []))) as ext
  from (select v, nbrs, unnest(nbrs) as w from outs) s left join outs o on o.v = s.w)
select array_to_string(clique, ',') as clique, array_to_string(ext, ' ') as ext from children"""
    bigger = f"""with {EDGES}, {OUT}, full_lists as (
  select u.v, coalesce(o.nbrs, []) as nbrs
  from (select src as v from edges union select dst from edges) u left join outs o on o.v = u.v) """
    triangles = f"""tri as (
  select e.src as x, e.dst as y, f.dst as z from edges e
  join edges f on f.src = e.dst join edges g on g.src = e.src and g.dst = f.dst)"""
    k4 = f"with recursive {EDGES}, {OUT}, {_cliques(4)} " + CLIQUE_ROWS.format(pick="list_min")
    maximal_rows = """select array_to_string(clique, ',') as clique, clique_size, anchor from maximal"""
    maximal = f"with recursive {EDGES}, {ARCS}, {LISTS}, {MAXIMAL} "
    # Straight from the definition: 6-cliques whose members share no neighbor.
    exact = f"""with recursive {EDGES}, {ARCS}, {LISTS}, {OUT}, {_cliques(6)}
select 6 as clique_size, count(*)::bigint as n_cliques
from (select clique[1] as a, clique[2] as b, clique[3] as c, clique[4] as d, clique[5] as e, clique[6] as f from cliques)
join lists l1 on l1.v = a join lists l2 on l2.v = b join lists l3 on l3.v = c
join lists l4 on l4.v = d join lists l5 on l5.v = e join lists l6 on l6.v = f
where len(list_intersect(list_intersect(list_intersect(list_intersect(list_intersect(
  l6.nbrs, l5.nbrs), l4.nbrs), l3.nbrs), l2.nbrs), l1.nbrs)) = 0"""
    found = {
        "edges_trade": f"with {EDGES} select src, dst from edges",
        "edge_list_parse": f"""with {LINES} select distinct least(src, dst) as src, greatest(src, dst) as dst
from parsed where n >= 2 and src <> dst""",
        "edge_list_vertices": f"""with {LINES}, ok as (
  select src, dst from parsed where n >= 2 and src is not null and dst is not null)
select src as v from ok union select dst from ok""",
        "edge_list_rejects": f"""with {LINES}
select line, case when n < 2 then 'too few tokens' else 'not numeric' end as reason
from parsed where n < 2 or src is null or dst is null""",
        "adjacency_rejects": f"""with {EDGES}, {ARCS}
select v || ' ' || w || ' 7x' as line, 'not numeric' as reason from arcs where (v + 2 * w) % 11 = 1""",
        "adjacency_one_sided": f"""with {EDGES}, {ARCS}, kept as (select v, w from arcs where (v + 2 * w) % 11 > 1)
select v, w from kept where (w, v) not in (select v, w from kept)""",
        "adjacency_parse": f"""with {EDGES}, {ARCS}, {LISTS}
select v, array_to_string(nbrs, ' ') as nbrs from lists""",
        "adjacency_edges": f"with {EDGES} select src, dst from edges",
        "clique_text_roundtrip": k4,
        "clique_tab_roundtrip": k4,
        "clique_compact_roundtrip": k4,
        "maximal_text_roundtrip": maximal + maximal_rows,
        "vertices": f"with {EDGES} select src as v from edges union select dst from edges",
        "symmetrize": f"with {EDGES}, {ARCS} select v as src, w as dst from arcs",
        "neighbor_list": f"with {EDGES}, {ARCS}, {LISTS} " + LIST_ROWS.format(source="lists"),
        "bigger_neighbors": bigger
        + LIST_ROWS.format(source="full_lists"),
        "smaller_neighbors": f"""with {EDGES}, {IDS}, ins as (
  select dst as v, list(src order by src) as nbrs from edges group by dst),
full_lists as (select ids.v, coalesce(i.nbrs, []) as nbrs from ids left join ins i on i.v = ids.v) """
        + LIST_ROWS.format(source="full_lists"),
        "neighbor_lookup": f"with {EDGES}, {ARCS}, {LISTS} "
        + LIST_ROWS.format(source="lists where v in (select s_suppkey from supplier)"),
        "list_integrity": f"""with {EDGES}, {ARCS}, sizes as (
  select v, (count(*) + {LIST_BOUND - 1}) // {LIST_BOUND} as parts from arcs group by v)
select sum(parts)::bigint as n_lists, sum(parts)::bigint as n_keys, count(*)::bigint as n_vertices,
  0::bigint as n_duplicated from sizes""",
        "checked_lists": f"with {EDGES}, {ARCS}, {LISTS} " + LIST_ROWS.format(source="lists"),
        "degrees": f"with {EDGES}, {ARCS} select v, count(*)::bigint as degree from arcs group by v",
        "graph_info": f"""with {EDGES}, {ARCS}, n as (
  select count(distinct v) as v, count(*) // 2 as e from arcs)
select v::bigint as n_vertices, e::bigint as n_edges, e / v as edges_per_vertex, 2 * e / v as avg_degree from n""",
        "graph_info_text": f"""with {EDGES}, {IDS}, n as (
  select (select count(*) from (select v from ids union select src from edges union select dst from edges)) as v,
         (select count(*) from edges) as e)
select format('{{:,}}', v) as n_vertices, format('{{:,}}', e) as n_edges,
  format('{{:.2f}}', e / v) as edges_per_vertex, format('{{:.2f}}', 2 * e / v) as avg_degree from n""",
        "ego_network": f"""with {EDGES}, {triangles.replace("tri as (", "tri as materialized (")}
select x as anchor, y as a, z as b from tri union all select y, x, z from tri union all select z, x, y from tri""",
        "ego_network_above": f"with {EDGES}, {triangles} select x as anchor, y as a, z as b from tri",
        "init_frontier": bigger
        + "select v::varchar as clique, array_to_string(nbrs, ' ') as ext from full_lists",
        "expand": children,
        "degree_prune_k5": bigger + LIST_ROWS.format(source="full_lists where len(nbrs) + 1 >= 5"),
        "bound_prune_k5": children + " where len(clique) + len(ext) >= 5",
        "format_state": bigger
        + "select '[' || v || ']->[' || array_to_string(nbrs, ', ') || ']' as state from full_lists",
        "prune_core_k36": _core_sql(36, 40),
        "triangle_count": f"with {EDGES}, {triangles} select count(*)::bigint as n_triangles from tri",
        "triangles": f"""with {EDGES}, {triangles}
select x || ',' || y || ',' || z as clique, 3 as clique_size, x as anchor from tri""",
        "kcliques_k4": k4,
        "kcliques_k5_ego": f"with recursive {EDGES}, {OUT}, {_cliques(5)} " + CLIQUE_ROWS.format(pick="list_min"),
        "kcliques_k5_bitmap": f"with recursive {EDGES}, {OUT}, {_cliques(5)} " + CLIQUE_ROWS.format(pick="list_min"),
        "kcliques_k4_peeled": k4,
        "clique_count_compact_k4": _count_sql(4),
        "cliques_upto_k4": f"""with recursive {EDGES}, {OUT}, {_states(4)}, cliques as (
  select [src] as clique from (select src from edges union select dst from edges)
  union all select list_append(clique, unnest(ext)) from states) """ + CLIQUE_ROWS.format(pick="list_min"),
        "clique_histogram_k6": HISTOGRAM + " select clique_size, n_cliques from hist",
        "clique_histogram_k6_ego": HISTOGRAM + " select clique_size, n_cliques from hist",
        "clique_histogram_k6_bitmap": HISTOGRAM + " select clique_size, n_cliques from hist",
        "clique_report_k6": HISTOGRAM
        + " select clique_size, 'Cliques of size ' || clique_size || ' => ' || format('{:,}', n_cliques) as line from hist",
        "cliques_per_anchor_k4": f"""with recursive {EDGES}, {OUT}, {_cliques(4)}
select list_min(clique) as anchor, count(*)::bigint as n_cliques from cliques group by 1""",
        "cliques_per_last_k4": f"""with recursive {EDGES}, {OUT}, {_cliques(4)}
select list_max(clique) as anchor, count(*)::bigint as n_cliques from cliques group by 1""",
        "maximal_cliques": maximal + maximal_rows,
        "maximal_cliques_max_pivot": maximal + maximal_rows,
        "maximal_cliques_pivot": f"with recursive {EDGES}, {ARCS}, {LISTS}, {IDS}, {MAXIMAL} "
        + maximal_rows
        + " union all select v::varchar, 1, v from ids where v not in (select v from arcs)",
        "maximal_histogram": maximal
        + "select clique_size, count(*)::bigint as n_cliques from maximal group by clique_size",
        "maximal_per_anchor": maximal + "select anchor, count(*)::bigint as n_cliques from maximal group by anchor",
        "maximal_exact_k6": exact,
        "maximal_exact_k6_peeled": exact,
        "is_maximal_k4": maximal + maximal_rows.replace("anchor", "list_min(clique) as anchor")
        + " where clique_size = 4",
        "is_maximal_upto_k4": maximal + maximal_rows.replace("anchor", "list_min(clique) as anchor")
        + " where clique_size <= 4",
    }
    for strategy in ("join", "broadcast", "ego", "bitmap"):
        found[f"kclique_count_k1_{strategy}"] = f"""with {EDGES} select 1 as clique_size, count(*)::bigint as n_cliques
from (select src from edges union select dst from edges)"""
        found[f"kclique_count_k2_{strategy}"] = (
            f"with {EDGES} select 2 as clique_size, count(*)::bigint as n_cliques from edges"
        )
        for k in (3, 4, 5):
            found[f"kclique_count_k{k}_{strategy}"] = _count_sql(k)
    for part in ("edges", "vertices", "rejects"):
        found[f"edge_list_stored_{part}"] = found["edge_list_parse" if part == "edges" else f"edge_list_{part}"]
    for order in ("id", "degree", "random", "core"):
        found[f"kclique_count_{order}_order"] = _count_sql(5)
    found["kclique_count_k4_partitions"] = _count_sql(4)
    if text_operators:
        found |= text_operators.oracle_sql()
    if corpus_pipeline and corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found


def _count_sql(k: int) -> str:
    return f"""with recursive {EDGES}, {OUT}, {_states(k)}
select {k} as clique_size, coalesce(sum(len(ext)), 0)::bigint as n_cliques from states where len(clique) = {k - 1}"""


def _core_sql(k: int, rounds: int) -> str:
    """The (k-1)-core of the purchases, peeled more rounds than it takes."""
    steps = ["""e0 as materialized (
  select distinct least(l_partkey, o_custkey) as src, greatest(l_partkey, o_custkey) as dst
  from lineitem join orders on l_orderkey = o_orderkey where l_partkey <> o_custkey)"""]
    for i in range(rounds):
        steps.append(f"""d{i} as materialized (
  select v from (select src as v from e{i} union all select dst from e{i}) group by v having count(*) >= {k - 1}),
e{i + 1} as materialized (
  select src, dst from e{i} where src in (select v from d{i}) and dst in (select v from d{i}))""")
    return "with " + ", ".join(steps) + f" select src, dst from e{rounds}"
