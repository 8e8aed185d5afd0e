"""Record schemas and the ontology: which attribute of a record becomes which relation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


EVENT = _strings("id", "type", "location", "time", "impact", "cause", "measure", "source")
QA = _strings("qid", "question", "gold_answer")
KG = T.StructType([T.StructField("entities", T.ArrayType(_strings("name", "type"))), T.StructField("relations", T.ArrayType(_strings("head", "relation", "tail")))])
EXTRACTION_LOG = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("raw_text", T.StringType()), T.StructField("extraction_result", KG), T.StructField("latency", T.DoubleType())])
NODE = _strings("id", "label", "props")
EDGE = _strings("src", "rel", "dst")
#: Edges of the persistent store: its nodes are told apart by label and name.
STORE_EDGE = _strings("src", "rel", "dst", "dst_label")

# The relations of an event record, in their order.
EVENT_ONTOLOGY = {"location": "occurs_in", "time": "occurs_on", "cause": "caused_by", "impact": "has_impact", "measure": "handled_by", "source": "sourced_from"}
# The fields the lexical and the vector retriever read of an event.
LEXICAL_FIELDS = ("type", "location", "time", "impact", "cause", "measure")
VECTOR_FIELDS = ("id", "type", "location", "impact", "cause")


@dataclass(frozen=True)
class Config:
    """Settings of a run; every one of them takes effect."""

    data_path: str = ""
    qa_path: str = ""
    graph_hops: int = 2
    retriever: str = "bm25"
    top_k: int = 3
    llm: dict = field(default_factory=lambda: {"provider": "offline", "model_name": "", "temperature": 0.1})
    embedding_model: str = ""
    #: ``extract``, ``extract_system``, ``answer``, ``answer_system``: what stands in place of the prompts of ``operators.chat``.
    prompts: dict = field(default_factory=dict)
