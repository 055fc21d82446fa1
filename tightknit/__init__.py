"""Clique analytics on undirected graphs, expressed as Spark DataFrame plans.

A graph is a DataFrame of canonical edges: ``src: bigint, dst: bigint`` with
``src < dst`` and no duplicates. Every public function takes and returns
DataFrames.
"""

from tightknit.operators.core import prune_core, removal_rounds
from tightknit.operators.ego import ego_network
from tightknit.operators.graph import (
    adjacency,
    checked_lists,
    degrees,
    graph_info,
    list_integrity,
    neighbors,
    orient,
    prune_vertices,
    symmetrize,
    vertices_of,
)
from tightknit.operators.kclique import (
    bound_prune,
    clique_histogram,
    cliques_per_anchor,
    cliques_upto,
    count_compact,
    count_kcliques,
    expand,
    expand_compact,
    init_frontier,
    kcliques,
    triangle_count,
    triangles,
)
from tightknit.operators.maximal import (
    count_maximal_k,
    is_maximal,
    maximal_cliques,
    maximal_histogram,
)
from tightknit.plans.ranked import rank_graph
from tightknit.plans.stable import clear_tables, drop_table, stable
from tightknit.sources.adjacency_text import (
    check_adjacency_lines,
    edges_from_adjacency,
    one_sided,
    parse_adjacency_lines,
    read_adjacency,
    write_neighbor_list,
)
from tightknit.sources.clique_text import (
    read_cliques,
    read_maximal,
    write_cliques,
    write_maximal,
)
from tightknit.sources.edge_list import edges_from_pairs, parse_edge_lines, read_edge_list, store_edge_lines
from tightknit.functions.text import clique_text, format_report, format_state

__all__ = [
    "adjacency", "bound_prune", "check_adjacency_lines", "checked_lists", "clear_tables", "clique_histogram", "clique_text",
    "cliques_per_anchor", "cliques_upto", "count_compact", "count_kcliques", "count_maximal_k", "degrees", "drop_table",
    "edges_from_adjacency", "edges_from_pairs", "ego_network", "expand", "expand_compact", "format_report",
    "format_state", "graph_info", "init_frontier", "is_maximal", "kcliques", "list_integrity",
    "maximal_cliques", "maximal_histogram", "neighbors", "one_sided", "orient", "parse_adjacency_lines",
    "parse_edge_lines", "prune_core", "prune_vertices", "rank_graph", "read_adjacency", "read_cliques",
    "read_edge_list", "read_maximal", "removal_rounds", "stable", "store_edge_lines", "symmetrize", "triangle_count", "triangles",
    "vertices_of", "write_cliques", "write_maximal", "write_neighbor_list",
]
