"""Sinks: graph store with upserts, graph database, GraphML, JSON and CSV."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandkg import schema
from strandkg.session import written


def _escaped(c: str) -> F.Column:
    out = F.coalesce(F.col(c), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The lines (ord, value) of a GraphML document; ``props`` are JSON text."""
    head = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="label" for="node" attr.name="label" attr.type="string"/>', '<key id="props" for="node" attr.name="props" attr.type="string"/>', '<key id="rel" for="edge" attr.name="rel" attr.type="string"/>', '<graph edgedefault="directed">']
    spark = nodes.sparkSession
    node = F.format_string('<node id="%s"><data key="label">%s</data><data key="props">%s</data></node>', _escaped("id"), _escaped("label"), _escaped("props"))
    edge = F.format_string('<edge source="%s" target="%s"><data key="rel">%s</data></edge>', _escaped("src"), _escaped("dst"), _escaped("rel"))
    ends = spark.createDataFrame([(0, i, h) for i, h in enumerate(head)] + [(3, 0, "</graph>"), (3, 1, "</graphml>")], "part int, line int, value string")
    body = nodes.select(F.lit(1).alias("part"), F.lit(0).alias("line"), node.alias("value")).unionByName(edges.select(F.lit(2).alias("part"), F.lit(0).alias("line"), edge.alias("value")))
    return ends.unionByName(body)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A GraphML document as a folder of text files in order: read one after the other by name they are the document. They are sorted and written by as many tasks as there is data for."""
    lines = graphml_lines(nodes, edges)
    lines.repartitionByRange("part", "line", "value").sortWithinPartitions("part", "line", "value").select("value").write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small CSV with a byte order mark and a header line."""
    first, *others = df.columns
    df.toDF(f"\ufeff{first}", *others).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


class GraphStore:
    """A persistent property graph under ``path``: nodes (id, label, props) by label and id, edges (src, rel, dst, dst_label) as a set, in Parquet.

    Nodes are split into ``buckets`` by their id, edges by their source. A manifest, a small numbered file, names the folder of each bucket. An upsert reads and writes only the buckets it has rows for, beside the old
    folders, and then adds the next manifest, by renaming a finished file; the newest one counts. So there is a readable state at any time, a failed write changes nothing, and running one again does no harm.
    Writers take turns: two at a time would make the same manifest, and the second fails. Folders that only manifests before the last ``KEPT`` name are deleted.
    """

    KEPT = 3

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # --- files ---

    def _hadoop(self, name: str):  # noqa: ANN202
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        at, fs = self._hadoop("manifests")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _manifest(self, number: int | None = None) -> dict:
        """``{"buckets": n, "nodes": {bucket: folder}, "edges": {bucket: folder}}`` of the newest state or of one."""
        if number is None:
            if not (numbers := self._numbers()):
                return {"buckets": self.buckets, "nodes": {}, "edges": {}}
            number = numbers[-1]
        at, fs = self._hadoop(f"manifests/{number:012d}.json")
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        number = (self._numbers() or [0])[-1] + 1
        draft, fs = self._hadoop(f"manifests/draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        final, _ = self._hadoop(f"manifests/{number:012d}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"another writer made version {number}")
        self._clean()

    def _clean(self) -> None:
        numbers = self._numbers()
        kept = [self._manifest(n) for n in numbers[-self.KEPT :]]
        live = {folder for m in kept for kind in ("nodes", "edges") for folder in m[kind].values()}
        for n in numbers[: -self.KEPT]:
            old = self._manifest(n)
            for folder in {f for kind in ("nodes", "edges") for f in old[kind].values()} - live:
                at, fs = self._hadoop(folder)
                fs.delete(at, True)
            at, fs = self._hadoop(f"manifests/{n:012d}.json")
            fs.delete(at, False)

    # --- tables ---

    def _read(self, manifest: dict, kind: str, only: set[str] | None = None) -> DataFrame:
        shape = schema.NODE if kind == "nodes" else schema.STORE_EDGE
        folders = sorted(f"{self.path}/{folder}" for bucket, folder in manifest[kind].items() if only is None or bucket in only)
        return self.spark.read.schema(shape).parquet(*folders) if folders else self.spark.createDataFrame([], shape)

    def read(self) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of the newest state."""
        manifest = self._manifest()
        return self._read(manifest, "nodes"), self._read(manifest, "edges")

    def _merged(self, manifest: dict, kind: str, new: DataFrame, key: str, merge) -> dict[str, str]:  # noqa: ANN001
        """Where the buckets of one kind are once ``new`` is merged in; only those it touches are read and written."""
        bucket = F.pmod(F.xxhash64(key), F.lit(manifest["buckets"])).alias("bucket")
        new = written(new, "upsert")
        touched = {str(r["bucket"]) for r in new.select(bucket).distinct().collect()}  # at most as many as there are buckets
        if not touched:
            return manifest[kind]
        version = f"data/{uuid.uuid4().hex}/{kind}"
        merged = merge(self._read(manifest, kind, touched), new)
        merged.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{version}")
        return manifest[kind] | {b: f"{version}/bucket={b}" for b in touched}

    def upsert(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Nodes (id, label, props and, where rows of a node repeat, ord): the last properties win. Edges are added to the set. Rows without a key are left out."""
        from strandkg.operators.graph import upsert_edges, upsert_nodes

        manifest = self._manifest()
        made = {
            "nodes": self._merged(manifest, "nodes", nodes.where("id is not null and label is not null"), "id", upsert_nodes),
            "edges": self._merged(manifest, "edges", edges.where("src is not null"), "src", upsert_edges),
        }
        if made != {k: manifest[k] for k in made}:
            self._publish(manifest | made)

    def clear(self) -> None:
        """Everything goes; the state before can be read until it is cleaned up."""
        self._publish({"buckets": self.buckets, "nodes": {}, "edges": {}})


def write_graph_database(nodes: DataFrame, edges: DataFrame, uri: str, user: str, secret_name: str, batch: int = 1000) -> None:
    """The store's nodes and edges merged into a graph database over its wire protocol, batch by batch in each task, nodes before edges. Needs the database's Python driver at the executors; merging makes repeated tasks harmless.

    Labels and relations can't be parameters of the query language, so rows of one label or relation go together and its name is quoted.
    """
    from strandkg.sources.readers import secret

    secret(secret_name)  # an error here rather than in the tasks

    def quoted(name: str) -> str:
        return "`" + name.replace("`", "``") + "`"

    def node_query(label: str) -> str:
        key = "id" if label == "Event" else "name"
        return f"UNWIND $rows AS row MERGE (n:{quoted(label)} {{{key}: row.id}}) SET n += row.props"

    def edge_query(rel: str, label: str) -> str:
        return f"UNWIND $rows AS row MATCH (a:Event {{id: row.src}}) MATCH (b:{quoted(label)} {{name: row.dst}}) MERGE (a)-[:{quoted(rel)}]->(b)"

    def send(rows, of, query, row_of) -> None:  # noqa: ANN001
        import neo4j

        with neo4j.GraphDatabase.driver(uri, auth=(user, secret(secret_name))) as driver, driver.session() as session:
            held: dict[tuple, list] = {}
            for r in rows:
                held.setdefault(of(r), []).append(row_of(r))
                if len(held[of(r)]) >= batch:
                    session.execute_write(lambda tx, r=r: tx.run(query(*of(r)), rows=held[of(r)]).consume())
                    held[of(r)] = []
            for key, left in held.items():
                if left:
                    session.execute_write(lambda tx, key=key, left=left: tx.run(query(*key), rows=left).consume())

    nodes.select("id", "label", "props").foreachPartition(lambda rows: send(rows, lambda r: (r["label"],), node_query, lambda r: {"id": r["id"], "props": json.loads(r["props"] or "{}")}))
    edges.select("src", "rel", "dst", "dst_label").foreachPartition(lambda rows: send(rows, lambda r: (r["rel"], r["dst_label"]), edge_query, lambda r: {"src": r["src"], "dst": r["dst"]}))
