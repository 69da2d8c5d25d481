"""Tables, enumerations and the search query."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "timestamp": T.TimestampType(), "vector": T.ArrayType(T.FloatType(), False), "weights": T.MapType(T.IntegerType(), T.FloatType(), False), "places": T.ArrayType(T.IntegerType(), True)}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (part.split(":") for part in spec.split())])


FILES = _struct("id:string path:string file_type:string size:long modified_at:timestamp indexed_at:timestamp content_hash:string")
CHUNKS = _struct("chunk_id:string file_id:string chunk_index:int kind:string content:string")
EMBEDDINGS = _struct("chunk_id:string model_id:string dim:int embedding:vector")
SPARSE = _struct("chunk_id:string model_id:string weights:weights")
POSTINGS = _struct("chunk_id:string term:long length:int places:places")
MODELS = _struct("model_id:string local_path:string version:string downloaded_at:timestamp")
EVENTS = _struct("path:string op:string ts:timestamp")
RESULTS = T.StructType([
    T.StructField("file_record", FILES), T.StructField("score", T.DoubleType()), T.StructField("snippet", T.StringType()),
    T.StructField("match_type", T.StringType()), T.StructField("chunk_index", T.IntegerType()),
])
STATS = T.StructType([T.StructField("total_files", T.LongType()), T.StructField("total_chunks", T.LongType()), T.StructField("files_by_type", T.MapType(T.StringType(), T.LongType())), T.StructField("index_size_bytes", T.LongType())])

TABLES = {"files": FILES, "chunks": CHUNKS, "embeddings": EMBEDDINGS, "sparse": SPARSE, "postings": POSTINGS, "models": MODELS}


class SearchMode(str, Enum):
    VECTOR, KEYWORD, HYBRID = "vector", "keyword", "hybrid"

    @classmethod
    def of(cls, name: str | SearchMode) -> SearchMode:
        """Unknown names mean hybrid."""
        return next((m for m in cls if m.value == str(getattr(name, "value", name)).lower()), cls.HYBRID)


@dataclass(frozen=True)
class SearchQuery:
    text: str
    file_types: tuple[str, ...] = ()
    limit: int = 20
    offset: int = 0
    mode: SearchMode = SearchMode.HYBRID
    vector_weight: float = 1.0
    keyword_weight: float = 1.0
