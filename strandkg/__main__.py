"""``python -m strandkg COMMAND``: extract from texts, build the graph, ask, compare, evaluate.

    extract FOLDER OUT            texts -> extraction log (JSON lines)
    build EVENTS STORE            event records (JSON lines) -> graph store, its size
    graphml EVENTS OUT            event records -> one GraphML file
    ask CONFIG QUESTION...        answers with their number of triples
    compare CONFIG OUT QUESTION...  report of baseline and graph answers (CSV)
    evaluate CONFIG               hit rate on the gold questions of the configuration
    pipeline CONFIG FOLDER QUESTION   the whole way: texts to entities, records to graph, the best record by vector, its subgraph, an answer

``--offline`` before the command: the stand-ins that need no network and no model, whatever the configuration names.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandkg import schema
from strandkg.operators import chat, context, graph
from strandkg.plans import evaluate, rag
from strandkg.session import ship
from strandkg.sources import readers, sinks


def _engine(spark: SparkSession, config: schema.Config) -> rag.Engine:
    events = readers.read_events(spark, config.data_path)
    return rag.Engine(events.withColumn("seq", readers.line_order()), config)


def _asked(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts, 1)], "qid string, text string")


def _pipeline(spark: SparkSession, config: schema.Config, folder: str, question: str) -> None:
    prompts = {to: config.prompts[k] for k, to in (("extract", "prompt"), ("extract_system", "system")) if k in config.prompts}
    found = chat.extract(readers.read_texts(spark, folder), config.llm, **prompts)
    found.select("doc_id", "status", F.size("extraction_result.entities").alias("n_entities"), F.size("extraction_result.relations").alias("n_relations")).show(truncate=False)
    engine = _engine(spark, config)
    graph.graph_size(engine.nodes, engine.edges).show()
    asked = _asked(spark, [question])
    engine.retrieve(asked, 1, "vector").show(truncate=False)
    lines = engine.context(asked, 1, "vector")
    lines.select("n_lines", F.slice(F.split("context", "\n"), 1, 3).alias("sample")).show(truncate=False)
    chat.answer(lines, config.llm, **engine.answering, failed=context.FAILED).show(truncate=False)


def main(args: list[str]) -> int:
    offline = args[:1] == ["--offline"]
    args = args[1:] if offline else args
    if len(args) < 2:
        print(__doc__)
        return 2
    readers.load_env()
    spark = SparkSession.builder.appName("strandkg").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    command, first, *rest = args
    if command == "extract":
        sinks.write_json(evaluate.extraction_log(readers.read_texts(spark, first), schema.Config().llm), rest[0])
    elif command == "build":
        store = sinks.GraphStore(spark, rest[0])
        store.upsert(*graph.store_nodes(readers.read_events(spark, first), readers.line_order()))
        graph.graph_size(*store.read()).show()
    elif command == "graphml":
        events, order = readers.read_events(spark, first).withColumn("seq", readers.line_order()), F.col("seq")
        sinks.write_graphml(graph.event_nodes(events, "id", schema.EVENT_ONTOLOGY, order), graph.event_edges(events, "id", schema.EVENT_ONTOLOGY, order), rest[0])
    elif command == "ask":
        engine = _engine(spark, readers.read_config(first, offline))
        made = engine.answer(_asked(spark, rest))
        made.select("qid", F.size("evidence").alias("n_triples"), F.slice("evidence", 1, 5).alias("sample"), "draft_answer").show(truncate=False)
    elif command == "compare":
        engine = _engine(spark, readers.read_config(first, offline))
        sinks.write_report(engine.compare(_asked(spark, rest[1:])), rest[0])
    elif command == "evaluate":
        config = readers.read_config(first, offline)
        _engine(spark, config).hit_rate(readers.read_questions(spark, config.qa_path)).show()
    elif command == "pipeline":
        _pipeline(spark, readers.read_config(first, offline), *rest)
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
