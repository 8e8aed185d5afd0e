"""Property graphs as node (id, label, props) and edge (src, rel, dst) tables, and their traversal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandkg.session import written


def present(c: Column) -> Column:
    """Neither null nor empty."""
    return c.isNotNull() & (c != "")


def attribute_links(records: DataFrame, id_col: str, ontology: dict[str, str], order: Column | None = None) -> DataFrame:
    """Records unpivoted: (src, rel, dst, label, value, seq), one row per attribute that is there. One pass over the records, no join with the ontology."""
    made = [F.struct(F.lit(k).alias("label"), F.col(k).cast("string").alias("value"), F.lit(rel).alias("rel")) for k, rel in ontology.items()]
    seq = (order if order is not None else F.lit(0)).alias("seq")
    rows = records.where(present(F.col(id_col).cast("string"))).select(F.col(id_col).cast("string").alias("src"), seq, F.inline(F.filter(F.array(*made), lambda x: present(x["value"]))))
    return rows.select("src", "rel", F.concat_ws("_", "label", "value").alias("dst"), "label", "value", "seq")


def event_edges(records: DataFrame, id_col: str, ontology: dict[str, str], order: Column | None = None) -> DataFrame:
    """Edges of the event graph; of several relations between the same two nodes the last one stays."""
    links = attribute_links(records, id_col, ontology, order)
    return links.groupBy("src", "dst").agg(F.max_by("rel", F.struct("seq", "rel")).alias("rel")).select("src", "rel", "dst")


def event_nodes(records: DataFrame, id_col: str, ontology: dict[str, str], order: Column | None = None) -> DataFrame:
    """Nodes of the event graph: records with all their columns as properties (the last row of an id), and attribute values."""
    seq = (order if order is not None else F.lit(0)).alias("seq")
    rows = records.where(present(F.col(id_col).cast("string"))).select(F.col(id_col).cast("string").alias("id"), seq, F.to_json(F.struct(*[F.col(f"`{c}`") for c in records.columns])).alias("props"))
    events = rows.groupBy("id").agg(F.max_by("props", F.struct("seq", "props")).alias("props")).select("id", F.lit("event").alias("label"), "props")
    values = attribute_links(records, id_col, ontology).select("dst", "label", "value").distinct()
    attributes = values.select(F.col("dst").alias("id"), "label", F.to_json(F.struct(F.col("value").alias("text"))).alias("props"))
    return events.unionByName(attributes.join(events.select("id"), "id", "left_anti"))


def entity_graph(extracted: DataFrame, order: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label) and edges of extraction results (entities, relations); ends that no entity names become nodes without a label."""
    seq = (order if order is not None else F.lit(0)).alias("seq")
    ents = extracted.select(seq, F.posexplode("entities").alias("pos", "e")).where(F.col("e.name").isNotNull())
    named = ents.groupBy(F.col("e.name").alias("id")).agg(F.max_by("e.type", F.struct("seq", "pos")).alias("label"))
    rels = extracted.select(seq, F.posexplode("relations").alias("pos", "r")).where("r.head is not null and r.tail is not null")
    edges = rels.groupBy(F.col("r.head").alias("src"), F.col("r.tail").alias("dst")).agg(F.max_by("r.relation", F.struct("seq", "pos")).alias("rel")).select("src", "rel", "dst")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ends.join(named, "id", "full_outer").select("id", "label"), edges


def neighbors(edges: DataFrame, seeds: DataFrame, direction: str = "out") -> DataFrame:
    """(qid, src, rel, dst) of the edges that leave (``out``) or enter (``in``) the seeds (qid, id)."""
    end = "src" if direction == "out" else "dst"
    return seeds.join(edges, seeds["id"] == edges[end]).select("qid", "src", "rel", "dst")


def _layers(edges: DataFrame, seeds: DataFrame, hops: int, max_degree: int | None = None) -> list[DataFrame]:
    """(qid, id) of the nodes at each distance from 0 to ``hops``, a table each."""
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other")))
    if hops > 1 or max_degree is not None:
        both = both.distinct()
    if hops > 1:
        both = written(both, "adjacency")
    if max_degree is not None:
        both = both.join(both.groupBy("id").count().where(F.col("count") <= max_degree).select("id"), "id", "left_semi")
    visited = frontier = seeds.select("qid", "id").distinct()
    layers = [frontier]
    for hop in range(hops):
        reached = frontier.join(both, "id").select("qid", F.col("other").alias("id")).distinct()
        frontier = reached.join(visited, ["qid", "id"], "left_anti")
        if hop < hops - 1:
            frontier = written(frontier, "frontier")
        visited = visited.unionByName(frontier)
        layers.append(frontier)
    return layers


def hop_nodes(edges: DataFrame, seeds: DataFrame, hops: int, max_degree: int | None = None) -> DataFrame:
    """(qid, id) of all nodes within ``hops`` of the seeds of each question, whatever the direction.

    Only new nodes are expanded. The edges both ways are written once where several rounds read them, and each round is cut from its lineage, so the plan stays flat and survives lost executors.
    ``max_degree`` leaves nodes of more neighbours unexpanded; None, the default, expands all.
    """
    return reduce(DataFrame.unionByName, _layers(edges, seeds, hops, max_degree))


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, src, rel, dst) of the edges both ends of which belong to the question's nodes (qid, id)."""
    left = edges.join(nodes.select("qid", F.col("id").alias("src")), "src")
    return left.join(nodes.select("qid", F.col("id").alias("dst")), ["qid", "dst"], "left_semi").select("qid", "src", "rel", "dst")


def _at(edges: DataFrame, end: str, nodes: DataFrame) -> DataFrame:
    """The edges that have one of ``nodes`` (id) at that end."""
    return edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")


def _between_outermost(edges: DataFrame, layers: list[DataFrame], inner: DataFrame) -> DataFrame | None:
    """(qid, src, rel, dst) of the edges between two nodes next to those of the last layer that are not ``inner`` for the question; None where there can be none.

    Which edges these may be is found without the questions, as a question may have a great many outermost nodes; only at those edges they are looked up.
    """
    rim = written(layers[-1].select("id").distinct(), "rim")
    other = _at(edges, "src", rim).select(F.col("dst").alias("id")).unionByName(_at(edges, "dst", rim).select(F.col("src").alias("id")))
    outermost = written(other.distinct(), "outermost")
    between = written(_at(_at(edges, "dst", outermost), "src", outermost), "between")
    if between.isEmpty():
        return None
    ends = between.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    near = [_at(edges.select(F.col(a).alias("at"), F.col(b).alias("id")), "id", ends).join(layers[-1].withColumnRenamed("id", "at"), "at").select("qid", "id") for a, b in (("src", "dst"), ("dst", "src"))]
    nodes = written(near[0].unionByName(near[1]).distinct().join(inner, ["qid", "id"], "left_anti"), "between-nodes")
    return induced_edges(between, nodes).select("qid", "src", "rel", "dst")


def hop_subgraph(edges: DataFrame, seeds: DataFrame, hops: int, max_degree: int | None = None) -> DataFrame:
    """The induced subgraph within ``hops`` of the seeds, per question.

    Edges at a node that is nearer than ``hops`` belong to it without a further look, as their other end is within ``hops``. Only edges between two of the outermost nodes need both ends looked up, and of these
    only such as join nodes that are outermost for any question at all.
    """
    if hops == 0 or max_degree is not None:
        return induced_edges(edges, hop_nodes(edges, seeds, hops, max_degree))
    layers = [written(x, "layer") for x in _layers(edges, seeds, hops - 1)]
    inner = reduce(DataFrame.unionByName, layers)
    of = lambda end: inner.select("qid", F.col("id").alias(end))
    columns = ["qid", "src", "rel", "dst"]
    leaving, entering = edges.join(of("src"), "src").select(*columns), edges.join(of("dst"), "dst").join(of("src"), ["qid", "src"], "left_anti").select(*columns)
    near, outer = leaving.unionByName(entering), _between_outermost(edges, layers, inner)
    return near if outer is None else near.unionByName(outer)


def hop_summary(edges: DataFrame, seeds: DataFrame, hops: int, line: Column) -> DataFrame:
    """(qid, n_lines, first_line): how many edges the induced subgraph of each question has and the least ``line`` (over src, rel, dst) of them, as ``hop_subgraph`` would give them; questions without edges have no row.

    The edges of a question are never listed. They are counted at their nodes, once for all questions: each node within ``hops - 1`` brings the edges at it, those between two such nodes come twice and are taken off once.
    Edges between two of the outermost nodes are looked up by question, but only at nodes that such an edge could join.
    """
    counted = [F.sum("n").alias("n"), F.min("line").alias("line")]
    if hops == 0:
        found = hop_subgraph(edges, seeds, 0).select("qid", F.lit(1).alias("n"), line.alias("line"))
        return found.groupBy("qid").agg(*counted).select("qid", F.col("n").cast("int").alias("n_lines"), F.col("line").alias("first_line"))
    layers = [written(x, "layer") for x in _layers(edges, seeds, hops - 1)]
    inner = reduce(DataFrame.unionByName, layers)
    ids = written(inner.select("id").distinct(), "ids")
    at_end = [_at(edges, end, ids).select(F.col(end).alias("id"), line.alias("line")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("line")) for end in ("src", "dst")]
    parts = [inner.join(x, "id").select("qid", "n", "line") for x in at_end]
    of = lambda nodes, end: nodes.select("qid", F.col("id").alias(end))
    within = _at(_at(edges, "src", ids), "dst", ids).select("src", "dst")
    twice = within.join(of(inner, "src"), "src").join(of(inner, "dst"), ["qid", "dst"], "left_semi")
    parts.append(twice.groupBy("qid").agg((-F.count(F.lit(1))).alias("n")).select("qid", "n", F.lit(None).cast("string").alias("line")))
    outer = _between_outermost(edges, layers, inner)
    if outer is not None:
        parts.append(outer.select("qid", F.lit(1).cast("long").alias("n"), line.alias("line")))
    whole = reduce(DataFrame.unionByName, parts).groupBy("qid").agg(*counted).where("n > 0")
    return whole.select("qid", F.col("n").cast("int").alias("n_lines"), F.col("line").alias("first_line"))


def hop_lines(edges: DataFrame, seeds: DataFrame, hops: int, line: Column) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The edges ``hop_subgraph`` would give for ``hops`` of 1 at least, as ``line`` (over src, rel, dst), without listing them by question: (qid, nodes: array of numbers), (line, a, b: numbers of its ends, null where it is at no such
    node), and, where there are edges between two outermost nodes, (qid, line). The edges of a question are those at its nodes and the last ones.
    """
    layers = [written(x, "layer") for x in _layers(edges, seeds, hops - 1)]
    inner = reduce(DataFrame.unionByName, layers)
    ids = written(inner.select("id").distinct().withColumn("number", F.monotonically_increasing_id()), "ids")
    of = lambda end, name: ids.select(F.col("id").alias(end), F.col("number").alias(name))
    lines = edges.join(of("src", "a"), "src", "left").join(of("dst", "b"), "dst", "left").where("a is not null or b is not null").select(line.alias("line"), "a", "b")
    nodes = written(inner.join(ids, "id").groupBy("qid").agg(F.collect_list("number").alias("nodes")), "nodes")
    outer = _between_outermost(edges, layers, inner)
    return nodes, written(lines, "lines"), None if outer is None else outer.select("qid", line.alias("line"))


def triples(edges: DataFrame) -> DataFrame:
    """(qid if there, s, r, o); an edge without a relation is ``related_to``."""
    rel = F.coalesce(*[F.col(c) for c in ("rel", "label") if c in edges.columns], F.lit("related_to"))
    keep = [c for c in ("qid",) if c in edges.columns]
    return edges.select(*keep, F.col("src").alias("s"), rel.alias("r"), F.col("dst").alias("o"))


def graph_size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(n_nodes, n_edges), counted in one pass over both."""
    each = nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(edges.select(F.lit(0).alias("n"), F.lit(1).alias("e")))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_nodes"), F.coalesce(F.sum("e"), F.lit(0)).alias("n_edges"))


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes by (label, id). Of the rows of ``new`` for a node the last one's properties are set (greatest ``ord``, where there is such a column); properties that are null are not set, so the old ones stay."""
    order = F.struct("ord", "props") if "ord" in new.columns else F.col("props")
    fresh = new.groupBy("label", "id").agg(F.max_by("props", F.when(F.col("props").isNotNull(), order)).alias("props"))
    both = old.select("label", "id", F.col("props").alias("old_props")).join(fresh, ["label", "id"], "full_outer")
    return both.select("id", "label", F.coalesce("props", "old_props").alias("props"))


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges as a set of (src, rel, dst, dst_label)."""
    columns = ["src", "rel", "dst", "dst_label"]
    return old.select(*columns).unionByName(new.select(*columns)).distinct()


def store_nodes(records: DataFrame, order: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Event records as the persistent store keeps them: nodes (id, label, props, ord) by label and name, the original row as JSON, attribute labels capitalised; edges (src, rel, dst, dst_label) from events to
    attribute nodes, whose label tells apart nodes of one name. ``order``: which row of an id is the last."""
    from strandkg.schema import EVENT_ONTOLOGY

    ord_ = (order if order is not None else F.monotonically_increasing_id()).cast("long").alias("ord")
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in records.columns]))
    props = F.to_json(F.struct(F.coalesce("type", F.lit("unknown")).alias("type"), F.coalesce("impact", F.lit("")).alias("description"), text.alias("original_text")))
    events = records.where(present(F.col("id"))).select("id", F.lit("Event").alias("label"), props.alias("props"), ord_)
    links = attribute_links(records, "id", EVENT_ONTOLOGY)
    label = F.initcap("label")
    values = links.select(F.col("value").alias("id"), label.alias("label")).distinct().select("id", "label", F.lit(None).cast("string").alias("props"), F.lit(None).cast("long").alias("ord"))
    return events.unionByName(values), links.select("src", "rel", F.col("value").alias("dst"), label.alias("dst_label")).distinct()
