"""The engine: a store, parsers, a model, and all that can be asked of them."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import FileNotIndexed, ModelNotLoaded
from quarry.functions.paths import IgnoreConfig
from quarry.operators import catalog, ingest, merge, postings
from quarry.operators.search import image_hits, search
from quarry.operators.vector import InvertedFile, use_ann
from quarry.plugins import EmbeddingModel, HashEmbedder, ModelRegistry, WordWeights
from quarry.schema import MODELS, SearchMode, SearchQuery
from quarry.sources.parsers import ParserRegistry
from quarry.sources.preview import preview
from quarry.sources.scan import scan, scan_paths
from quarry.store import Store


#: The model of a store that was switched to none; tables that hold what belongs to files.
DEFAULT_MODEL = "hash"
HELD = ("files", "chunks", "embeddings", "sparse", "postings")


@dataclass
class Options:
    """How an engine is built. Without a model, that which the store was switched to, else DEFAULT_MODEL."""

    root: str
    model: str | None = None
    image_model: str | None = None
    ann: str = "auto"  # or "force" or "off"
    ignore: IgnoreConfig = field(default_factory=IgnoreConfig)
    scale: str = "shifted"
    strict: bool = False
    pushdown_types: bool = False


def default_models() -> ModelRegistry:
    registry = ModelRegistry()
    registry.register("hash", HashEmbedder)
    registry.register("words", lambda: WordWeights("words"))
    return registry


class Engine:
    def __init__(self, spark: SparkSession, options: Options | str, parsers: ParserRegistry | None = None, models: ModelRegistry | None = None):
        self.spark = spark
        self.options = options if isinstance(options, Options) else Options(options)
        self.store = Store(spark, self.options.root)
        self.options.model = self.options.model or self.store.setting("model") or DEFAULT_MODEL
        self.parsers, self.models = parsers or ParserRegistry(), models or default_models()
        self._index: tuple[tuple, InvertedFile | None] = ((), None)

    @property
    def model(self) -> EmbeddingModel:
        return self.models.get(self.options.model)

    @property
    def image_model(self) -> EmbeddingModel | None:
        return self.models.get(self.options.image_model) if self.options.image_model else None

    def vector_index(self) -> InvertedFile | None:
        """The inverted file of the current vectors, built when there are many (or ann is force), kept until they change."""
        held = self.store.current().get("embeddings")
        made_of = (hashlib.sha256(json.dumps(held, sort_keys=True).encode()).hexdigest()[:32], self.options.model, self.options.ann)
        if not held or self.options.ann == "off":
            return None
        if self._index[0] != made_of:
            own = self.store.table("embeddings").where(F.col("model_id") == self.model.model_id)
            n = own.count()
            index = None
            if n and use_ann(n, self.options.ann):
                index = InvertedFile.build(own, self.model.dim, path=f"{self.store.root}/ann/{made_of[0]}-{self.options.model}")
            self._index = (made_of, index)
        return self._index[1]

    def has_postings(self) -> bool:
        """Whether keyword search has its index: all stores but those that were filled before there was one."""
        held = self.store.current()
        return "chunks" not in held or "postings" in held

    def switch_model(self, model_id: str) -> None:
        """Files are indexed anew under another model when they are scanned again. The store remembers the choice."""
        self.models.get(model_id)
        self.options.model = model_id
        self.store.set("model", model_id)

    # --- indexing

    def index_scanned(self, scanned: DataFrame, full_sync: bool = False, within: str | None = None) -> DataFrame:
        """Indexes what is new or changed; returns one row of this run's statistics.

        All that belonged to a changed file is replaced. With full_sync, files that lie
        within a folder and weren't scanned are removed.
        """
        tables = self.store.tables()
        changed = ingest.changed_files(scanned, tables["files"], self.model.model_id).persist(StorageLevel.DISK_ONLY)
        try:
            files = ingest.file_rows(changed)
            chunks = ingest.chunk_rows(changed, self.parsers).persist(StorageLevel.DISK_ONLY)
            new = {"files": files, "chunks": chunks, "embeddings": ingest.embedding_rows(chunks, self.model, self.image_model)}
            sparse = ingest.sparse_rows(chunks, self.model)
            new |= {} if sparse is None else {"sparse": sparse}
            new |= {"postings": postings.build(chunks)} if self.has_postings() else {}
            by_type = {r.file_type: r.n_files for r in catalog.files_by_type(changed.select("file_type")).collect()}
            gone = changed.select(F.col("id").alias("file_id"))
            if full_sync:
                known = tables["files"] if within is None else tables["files"].where(F.startswith("path", F.lit(within.rstrip("/") + "/")))
                lost = known.join(scanned.select("path"), "path", "left_anti").select(F.col("id").alias("file_id"))
                n_lost = lost.count()
                gone = gone.unionByName(lost)
            else:
                n_lost = 0
            if by_type or n_lost:
                buckets = self.store.buckets_of(gone)
                held = self._held(buckets)
                self.store.write(merge.replace_files(held, new, gone), buckets)
            total = self.store.table("chunks").count()
            return self.spark.createDataFrame([(sum(by_type.values()), total, by_type, n_lost)], "new_files long, total_chunks long, files_by_type map<string,long>, removed_files long")
        finally:
            changed.unpersist()

    def index_directory(self, folder: str, full_sync: bool = False) -> DataFrame:
        found = scan(self.spark, folder, self.options.ignore)
        uri = self.store._path(folder)
        top = uri.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(uri).toString()
        return self.index_scanned(found, full_sync, top)

    def index_file(self, path: str) -> bool:
        """Whether the file was new or changed."""
        self.parsers.get(path)
        return self.index_scanned(scan_paths(self.spark, [path])).first().new_files > 0

    def remove_file(self, file_id: str) -> None:
        self._remove(catalog.get_file(self.store.table("files"), file_id=file_id), file_id)

    def remove_paths(self, paths: list[str]) -> int:
        """Removes all files with these paths in one write; returns how many there were."""
        named = self.spark.createDataFrame([(p,) for p in paths], "path string")
        found = self.store.table("files").join(named, "path", "left_semi")
        n = found.count()
        if n:
            self._remove(found, "")
        return n

    def remove_path(self, path: str) -> bool:
        try:
            self._remove(catalog.get_file(self.store.table("files"), path=path), path)
        except FileNotIndexed:
            return False
        return True

    def _remove(self, found: DataFrame, what: str) -> None:
        if found.isEmpty():
            raise FileNotIndexed(what)
        gone = found.select(F.col("id").alias("file_id"))
        buckets = self.store.buckets_of(gone)
        self.store.write(merge.delete_files(self._held(buckets), gone), buckets)

    def clear(self) -> None:
        self.store.write({name: rows.limit(0) for name, rows in self._held().items()})

    def _held(self, buckets: list[int] | None = None) -> dict[str, DataFrame]:
        """What belongs to files, in some buckets or all."""
        return {name: self.store.table(name, buckets) for name in HELD if name != "postings" or self.has_postings()}

    # --- queries

    def search(self, query: SearchQuery | str, images: DataFrame | None = None, **options) -> DataFrame:
        q = query if isinstance(query, SearchQuery) else SearchQuery(query, **options)
        tables = self.store.tables()
        if images is None and self.image_model is not None and q.text.strip():
            images = image_hits(tables, q, self.image_model)
        if self.model.sparse_query("x") is None:
            tables.pop("sparse")
        if not self.has_postings():
            tables.pop("postings")
        return search(self.spark, tables, q, self.model, scale=self.options.scale, strict=self.options.strict, pushdown_types=self.options.pushdown_types, images=images, index=self.vector_index())

    def keyword(self, text: str, limit: int = 20) -> DataFrame:
        return self.search(SearchQuery(text, limit=limit, mode=SearchMode.KEYWORD))

    def stats(self) -> DataFrame:
        return catalog.stats(self.store.table("files"), self.store.table("chunks"))

    def list_files(self, limit: int = 20, offset: int = 0) -> DataFrame:
        return catalog.list_files(self.store.table("files"), limit, offset)

    def preview(self, path: str) -> DataFrame:
        """One row of what a file holds, from the file itself."""
        return preview(scan_paths(self.spark, [path]))

    def count_in_dir(self, folder: str) -> int:
        return catalog.count_in_dir(self.store.table("files"), folder).first().n_files

    # --- models

    def record_model(self, model_id: str, local_path: str, version: str | None = None) -> None:
        """Inserts or replaces a row of the models table."""
        if model_id not in self.models.ids():
            raise ModelNotLoaded(model_id)
        row = self.spark.createDataFrame([(model_id, local_path, version, None)], MODELS).withColumn("downloaded_at", F.date_trunc("second", F.current_timestamp()))
        self.store.write({"models": merge.upsert(self.store.table("models"), row, ["model_id"])})

    def list_models(self) -> DataFrame:
        return catalog.list_models(self.store.table("models"))
