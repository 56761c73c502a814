"""Embedders: text to vector. The registry is the one extension point."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.buckets import blake2b_bucket, sha2_bucket, sha2_bucket_of
from ..functions.text import ascii_tokens

# Fixed value: the instruction that this model family expects before queries, not before documents.
BGE_PREFIX = "Represent this sentence for searching relevant passages: "
_TOKEN = re.compile(r"[a-z0-9]+")


class Embedder:
    """name, dim, query_prefix, and vectors(texts). Documents never get the prefix."""

    name: str
    dim: int
    query_prefix = ""

    def vectors(self, texts: list[str | None]) -> list[list[float]]:
        raise NotImplementedError

    def embed(self, df: DataFrame, text: str = "text", out: str = "embedding") -> DataFrame:
        """df with the vectors of its text column, in Arrow batches; the model is made once in each worker."""
        make, kind = getattr(self, "matrix", self.vectors), pa.list_(pa.float32())
        if out in df.columns:
            raise ValueError(f"there is a column {out!r} already")
        schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

        def run(batches):
            for b in batches:
                made = make(b.column(text).to_pylist())
                if isinstance(made, np.ndarray):
                    at = np.arange(len(made) + 1, dtype=np.int32) * made.shape[1]
                    made = pa.ListArray.from_arrays(pa.array(at), pa.array(made.ravel(), pa.float32()))
                yield b.append_column(out, made if isinstance(made, pa.Array) else pa.array(made, kind))

        return df.mapInArrow(run, schema)

    def query_vector(self, text: str) -> list[float]:
        return self.vectors([self.query_prefix + text])[0]


@dataclass
class HashEmbedder(Embedder):
    """Unit-length counts of hashed [a-z0-9]+ tokens: deterministic and offline. Texts without tokens give zero.

    bucket is blake2b, or sha2 for the buckets that built-in functions give as well; the name says which.
    """

    dim: int = 256
    name: str = "hash"
    bucket: str = "blake2b"

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        """The vectors as rows. Each distinct token of a batch is hashed once."""
        number: dict[str, int] = {}
        tokens, sizes = [], []
        for t in texts:
            mine = _TOKEN.findall((t or "").lower())
            tokens += [number.setdefault(w, len(number)) for w in mine]
            sizes.append(len(mine))
        bucket = blake2b_bucket if self.bucket == "blake2b" else sha2_bucket_of
        buckets = np.fromiter((bucket(w, self.dim) for w in number), np.int64, len(number))
        at = np.repeat(np.arange(len(texts)), sizes) * self.dim + buckets[np.array(tokens, np.int64)]
        counts = np.bincount(at, minlength=len(texts) * self.dim).reshape(len(texts), self.dim).astype(np.float64)
        length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        return counts / np.where(length, length, 1.0)

    def vectors(self, texts: list[str | None]) -> list[list[float]]:
        return self.matrix(texts).tolist()


class _Neural(Embedder):
    """A model whose weights are not here: loading it says so."""

    def __init__(self, name: str, dim: int, prefix: str, load: Callable[[], Callable[[list[str]], list]] | None = None):
        self.name, self.dim, self.query_prefix, self._load, self._model = name, dim, prefix, load, None

    def __getstate__(self):
        return self.__dict__ | {"_model": None}

    def vectors(self, texts: list[str | None]) -> list[list[float]]:
        if self._model is None:
            if self._load is None:
                raise RuntimeError(f"the weights of embedder {self.name!r} are not installed; register one with a loader")
            self._model = self._load()
        return [list(map(float, v)) for v in self._model([t or "" for t in texts])]


_registry: dict[str, Callable[[], Embedder]] = {
    "hash": HashEmbedder,
    "hash-sha2": lambda: HashEmbedder(name="hash-sha2", bucket="sha2"),
    "default": lambda: _Neural("default", 384, ""),
    "bge": lambda: _Neural("bge", 1024, BGE_PREFIX),
}


def register(name: str, make: Callable[[], Embedder]) -> None:
    _registry[name] = make


def neural(name: str, dim: int, load: Callable[[], Callable[[list[str]], list]], prefix: str = "") -> Embedder:
    """An embedder around a model that load() makes, once in each worker."""
    return _Neural(name, dim, prefix, load)


def embedder(name: str) -> Embedder:
    """By name; an unknown name is an error, never some other model."""
    if name not in _registry:
        raise ValueError(f"unknown embedder {name!r}; there are {', '.join(sorted(_registry))}")
    return _registry[name]()


# --- bag-of-words vectors of built-in functions alone, with the SHA-256 bucket ---


def buckets(text: Column, dim: int = 256) -> Column:
    """array<int>: the bucket of each token of a text, sorted."""
    return F.array_sort(F.transform(ascii_tokens(text), lambda t: sha2_bucket(t, dim)))


def squared_norm(sorted_buckets: Column) -> Column:
    """The sum of squared bucket counts, from one pass over the sorted buckets: the k-th of a run adds 2k - 1."""
    zero = F.struct(F.lit(-1).alias("b"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("s"))

    def step(acc: Column, b: Column) -> Column:
        k = F.when(acc["b"] == b, acc["k"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(b.alias("b"), k.alias("k"), (acc["s"] + 2 * k - 1).alias("s"))

    return F.aggregate(sorted_buckets, zero, step, lambda acc: acc["s"])


def sparse(df: DataFrame, key: list[str], text: str = "text", dim: int = 256) -> DataFrame:
    """(key, bucket, weight): the non-zero entries of the unit vectors, a row each.

    In the sorted buckets the last of each run knows the run's length from where the run before it ended.
    """
    b = df.select(*key, buckets(F.col(text), dim).alias("b")).where(F.size("b") > 0)
    ends = F.filter(F.transform("b", lambda x, i: F.when(F.coalesce(F.get("b", i + 1) != x, F.lit(True)), i)), lambda i: i.isNotNull())
    b = b.withColumn("ends", ends).withColumn("length", F.sqrt(squared_norm(F.col("b")).cast("double")))
    entries = F.transform("ends", lambda e, k: F.struct(F.get("b", e).alias("bucket"), (e - F.coalesce(F.get("ends", k - 1), F.lit(-1))).alias("n")))
    return b.select(*key, "length", F.explode(entries).alias("e")).select(*key, "e.bucket", (F.col("e.n") / F.col("length")).alias("weight"))


def with_query_similarity(df: DataFrame, query: str, text: str = "text", dim: int = 256) -> DataFrame:
    """df with `similarity`, the cosine of each text's bag of words with that of a query; nothing is shuffled.

    The buckets are a column of their own, so that each token is hashed once for both the product and the length.
    """
    want = Counter(sha2_bucket_of(t, dim) for t in _TOKEN.findall(query.lower()))
    if not want:
        return df.withColumn("similarity", F.lit(0.0))
    length = math.sqrt(sum(n * n for n in want.values()))
    weights = F.array(*[F.lit(want[i]).cast("long") for i in range(dim)])
    met = F.aggregate("buckets_", F.lit(0).cast("long"), lambda s, x: s + F.get(weights, x))
    b = df.withColumn("buckets_", buckets(F.col(text), dim)).withColumn("norm_", F.sqrt(squared_norm(F.col("buckets_")).cast("double")))
    return b.withColumn("similarity", F.when(F.col("norm_") > 0, met / (F.col("norm_") * F.lit(length))).otherwise(F.lit(0.0))).drop("buckets_", "norm_")
