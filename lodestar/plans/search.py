"""Searches of a store: through its stored index and a cache of results, both of one version of the store."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from lodestar.operators import ann, retrieval
from lodestar.plans.cache import SemanticCache
from lodestar.plans.catalog import Store


@dataclass
class Searcher:
    """Vector, hybrid and entity search of a store's current version.

    An index is built once for a version and metric, at the first search that
    wants one, and lies in the store beside the data; later sessions open it. It
    serves searches over the whole corpus of at least ``index_from`` chunks;
    smaller corpora and filtered searches are answered exactly. Results are
    cached by their parameters and by the query vector, up to the threshold, and
    forgotten when the store gets another version.
    """

    store: Store
    index_from: int = 10_000
    cells: int = 256
    probes: int = 16
    cache: SemanticCache | None = None
    _opened: dict = field(default_factory=dict)
    _schemas: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        limits = self.store.limits
        self.cache = self.cache or SemanticCache(limits.cache_entries, limits.cache_threshold)

    def index(self, metric: str = "euclidean") -> ann.Index:
        key = (self.store.version, metric)
        if key not in self._opened:
            path, chunks = f"{self.store.path}/index/{key[0]:012d}-{metric}", self.store.read("chunk")
            if not self.store.exists(f"{path}/centroids/_SUCCESS"):
                self.store.remove(path)
                ann.build(chunks, self.cells, metric=metric, path=path)
            self._opened = {key: ann.load(self.store.spark, path, chunks.schema, metric)}
        return self._opened[key]

    def _through_cache(self, signature: tuple, vector: Sequence[float], search: Callable[[], DataFrame]) -> DataFrame:
        self.cache.at_version(self.store.version)

        def rows() -> list:
            found = search()
            self._schemas[signature] = found.schema
            return found.collect()

        return self.store.spark.createDataFrame(self.cache.through(signature, vector, rows), self._schemas[signature])

    def vector_search(self, query: Sequence[float], k: int = 10, metric: str = "euclidean", document: str | None = None, documents: Sequence[str] = (), exact: bool = False) -> DataFrame:
        limits, chunks = self.store.limits, self.store.read("chunk")

        def search() -> DataFrame:
            if exact or document or documents or self.store.stats()["chunk_count"] < self.index_from:
                return retrieval.vector_search(chunks, query, k, metric, limits, document=document, documents=documents)
            found = ann.search(self.index(metric), query, limits.k(k), self.probes)
            return retrieval.hydrate(found, chunks, ["document_id", "ordinal", "content"]).orderBy("distance", "id")

        return self._through_cache(("vector", limits.k(k), metric, document, tuple(documents), exact), query, search)

    def hybrid_search(self, query: Sequence[float], words: str, k: int = 10, **more) -> DataFrame:
        search = lambda: retrieval.hybrid_search(self.store.read("chunk"), query, words, k, limits=self.store.limits, **more)
        shown = tuple((n, tuple(v) if isinstance(v, list) else v) for n, v in sorted(more.items()))
        return self._through_cache(("hybrid", words, k, shown), query, search)
