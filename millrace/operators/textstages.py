"""Text stages: chunking, embedding and language-model calls per row."""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError
from ..functions.text import fixed_windows, prompt, sentences
from ..session import scratch

SEPARATORS = ["\n\n", "\n", ". ", " ", ""]


def split_recursively(text: str, size: int, separators: list[str]) -> list[str]:
    """Pieces of at most ``size`` characters: split at the first separator, joined again while they fit, the rest split by the next."""
    if len(text) <= size:
        return [text] if text else []
    if not separators or separators[0] == "":
        return [text[i : i + size] for i in range(0, len(text), size)]
    first, rest = separators[0], separators[1:]
    out, held = [], ""
    for piece in text.split(first):
        joined = held + first + piece if held else piece  # nothing is joined to a chunk that is still empty
        if len(joined) <= size:
            held = joined
            continue
        out += [held] if held else []
        held = piece if len(piece) <= size else ""
        out += split_recursively(piece, size, rest) if not held and piece else []
    return out + ([held] if held else [])


def with_overlap(chunks: list[str], overlap: int, size: int) -> list[str]:
    """Each chunk after the end of the one before, as it was."""
    n = min(overlap, size - 1)
    return [c if not i or not n else chunks[i - 1][-n:] + c for i, c in enumerate(chunks)]


def chunk(df: DataFrame, column: str, strategy: str = "fixed_window", size: int = 512, overlap: int = 0, separators: list[str] | None = None) -> DataFrame:
    """A row for each chunk, which replaces the text; ``chunk_index`` counts from 0.  Null and empty texts have none."""
    if size < 1:
        raise SpecError("chunks need a size")
    if strategy == "fixed_window":
        chunks = fixed_windows(F.col(column), size, overlap)
    elif strategy == "recursive_character":
        chosen = SEPARATORS if separators is None else separators

        @F.pandas_udf("array<string>")
        def parts(s):
            return s.map(lambda t: with_overlap(split_recursively(t or "", size, chosen), overlap, size))

        chunks = parts(F.col(column))
    else:
        raise SpecError(f"no strategy {strategy!r}")
    rest = [c for c in df.columns if c != column]
    exploded = df.select(*rest, F.posexplode(chunks).alias("chunk_index", "__chunk"))
    return exploded.select(*[F.col("__chunk").alias(c) if c == column else F.col(c) for c in df.columns], F.col("chunk_index"))


def hash_embed(texts, dimension: int):
    """Vectors that depend on words alone: for tests and for runs without a model."""
    import numpy as np

    known: dict[str, int] = {}  # a number for each different word, which is hashed once
    words, many = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        found = [known.setdefault(w, len(known)) for w in (t or "").lower().split()]
        words += found
        many[i] = len(found)
    h = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in known], np.uint64)
    place, sign = (h % np.uint64(dimension)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)
    words = np.array(words, np.int64)
    row = np.repeat(np.arange(len(texts)), many)
    out = np.bincount(row * dimension + place[words], sign[words], len(texts) * dimension).astype(np.float32).reshape(len(texts), dimension)
    n = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.divide(out, n, out=out, where=n > 0)


CHARS = 1_000_000  # of text that is embedded together, or one longer text


def _slices(sizes: list[int]):
    """Ranges of neighbours with at most CHARS in all, or one larger."""
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if i > at and held + n > CHARS:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes)


def _vectors(embedder, texts: list[str], dimension: int):
    import numpy as np

    found = embedder(texts, dimension)
    if any(len(v) != dimension for v in found):
        raise ValueError("the embedder's vectors have another dimension")
    return np.asarray(found, np.float32).reshape(len(texts), dimension)


def embed(df: DataFrame, column: str, output: str, dimension: int, embedder=hash_embed) -> DataFrame:
    """``df`` with vectors of ``column`` in ``output``, last; rows without text are left out.

    ``embedder(texts, dimension)`` gets neighbours of at most ``CHARS`` characters together, or one longer text; a vector of another length raises.
    """

    @F.arrow_udf("array<float>")
    def vectors(s: pa.Array) -> pa.Array:
        parts = [_vectors(embedder, s.slice(a, b - a).to_pylist(), dimension).ravel() for a, b in _slices(pc.utf8_length(s).to_pylist())]
        return pa.ListArray.from_arrays(pa.array(range(0, (len(s) + 1) * dimension, dimension), pa.int32()), pa.concat_arrays([pa.array(x, pa.float32()) for x in parts] or [pa.nulls(0, pa.float32())]))

    return df.filter(F.length(column) > 0).withColumn(output, vectors(F.col(column)))


def _joined(texts: list[list[str]], dimension: int, threshold: float, embedder) -> list[list[str]]:
    """Sentences of each text joined while each is similar enough to the one before; cosines are summed as ``functions.vectors.cosine`` does."""
    import numpy as np

    flat = [x for t in texts for x in t]
    if not flat:
        return texts
    v = _vectors(embedder, flat, dimension).astype(np.float64)

    def dot(a, b):
        total = np.zeros(len(a))
        for k in range(dimension):
            total += a[:, k] * b[:, k]
        return total

    size = np.sqrt(dot(v, v))
    both = size[:-1] * size[1:]
    new = np.ones(len(flat), bool)
    new[1:] = np.where(both == 0, 0.0, dot(v[:-1], v[1:]) / np.where(both == 0, 1.0, both)) < threshold
    out, at = [], 0
    for t in texts:
        cuts = [0, *(k for k in range(1, len(t)) if new[at + k]), len(t)]
        out.append([" ".join(t[a:b]) for a, b in itertools.pairwise(cuts)] if t else [])
        at += len(t)
    return out


def semantic_chunks(df: DataFrame, column: str, dimension: int, threshold: float = 0.8, embedder=hash_embed) -> DataFrame:
    """A row for each chunk, which replaces the text: sentences joined while each is similar enough to the one before.

    ``chunk_index`` counts from 0 within a row; the other columns stay, and equal rows are cut apart from each other.  A text is cut where it is read: nothing is shuffled.
    """

    @F.arrow_udf("array<string>")
    def chunks(s: pa.Array) -> pa.Array:
        out: list = []
        sizes = pc.fill_null(pc.list_value_length(s), 0).to_pylist()
        chars = pc.utf8_length(s.flatten()).to_pylist()
        ends = list(itertools.accumulate(sizes, initial=0))
        for a, b in _slices([sum(chars[x:y]) for x, y in itertools.pairwise(ends)]):
            out += _joined([t or [] for t in s.slice(a, b - a).to_pylist()], dimension, threshold, embedder)
        return pa.array(out, pa.list_(pa.string()))

    rest = [c for c in df.columns if c != column]
    exploded = df.select(*rest, F.posexplode(chunks(sentences(F.col(column)))).alias("chunk_index", "__chunk"))
    return exploded.select(*[F.col("__chunk").alias(c) if c == column else F.col(c) for c in df.columns], F.col("chunk_index"))


def cache_key(model: str, prompt_column: str, max_tokens: int, temperature: float):
    """Digest that responses are kept by."""
    return F.sha2(F.concat_ws("\0", F.lit(model), F.col(prompt_column), F.lit(str(max_tokens)), F.lit(str(temperature))), 256)


def complete(df: DataFrame, template: str, columns: list[str], output: str, backend, model: str = "local", max_tokens: int = 256, temperature: float = 0.0, cache: str | None = None, ttl_seconds: int | None = None) -> DataFrame:
    """``df`` with ``backend(prompts)`` for each row's prompt; equal prompts are asked once.

    ``cache`` is a Parquet folder of earlier replies: only prompts without one younger than ``ttl_seconds`` are asked, and their
    replies are added to it.  The replies of this call are settled before it returns, so its result doesn't change as the cache ages.
    """
    held = df.drop(output).withColumn("__prompt", prompt(template, columns)).withColumn("__key", cache_key(model, "__prompt", max_tokens, temperature))
    wanted = held.groupBy("__key").agg(F.first("__prompt").alias("__asked"))

    @F.pandas_udf("string")
    def ask(s):
        import pandas as pd

        return pd.Series([str(x) for x in backend(s.tolist())])

    def answered(rows: DataFrame) -> DataFrame:
        return rows.withColumn(output, F.coalesce(ask(F.col("__asked")), F.lit(""))).drop("__asked")

    if cache is None:
        return held.join(answered(wanted), "__key").drop("__key", "__prompt")
    spark, schema = df.sparkSession, "key string, reply string, at timestamp"
    spark.createDataFrame([], schema).write.mode("append").parquet(cache)  # so that a first run has a cache to read
    now = spark.sql("SELECT current_timestamp() AS t").first().t
    young = F.lit(True) if ttl_seconds is None else F.col("at") > F.lit(now) - F.make_dt_interval(secs=F.lit(float(ttl_seconds)))
    kept = spark.read.schema(schema).parquet(cache).filter(young)
    # What is fresh is settled here, once: these replies, and those asked for below, are joined whenever the result is read.
    chosen = scratch(spark, "replies")
    kept.groupBy("key").agg(F.max_by("reply", "at").alias("reply"), F.max("at").alias("at")).join(wanted.select(F.col("__key").alias("key")), "key", "left_semi").write.parquet(chosen)
    known = spark.read.schema(schema).parquet(chosen)
    missing = answered(wanted.join(known.select(F.col("key").alias("__key")), "__key", "left_anti"))
    asked = scratch(spark, "asked")
    missing.select(F.col("__key").alias("key"), F.col(output).alias("reply"), F.current_timestamp().alias("at")).write.parquet(asked)
    new = spark.read.schema(schema).parquet(asked)
    new.write.mode("append").parquet(cache)
    replies = known.unionByName(new).select(F.col("key").alias("__key"), F.col("reply").alias(output))
    return held.join(replies, "__key").drop("__key", "__prompt")


def cost(df: DataFrame, prompt_tokens: str, reply_tokens: str, prompt_price: float, reply_price: float):
    """Sum of prices per thousand tokens."""
    return df.agg(F.sum(F.col(prompt_tokens) / 1000 * prompt_price + F.col(reply_tokens) / 1000 * reply_price).alias("cost"))


def context(found: list[str], question: str, template: str = "{context}\n\n{question}") -> str:
    """Numbered passages and a question as one prompt; no passages are an error."""
    if not found:
        raise LookupError("no passages")
    return template.replace("{context}", "\n\n".join(f"[{i}] {t}" for i, t in enumerate(found, 1))).replace("{question}", question)


def with_script(df: DataFrame, script: str, schema: str | None = None) -> DataFrame:
    """``df`` through a script's ``transform(pandas) -> pandas``, Arrow batch by Arrow batch in tasks.

    ``schema`` says what comes out, the columns of ``df`` by default.  A script without ``transform`` raises when it runs.
    """

    def run(batches):
        scope: dict = {}
        exec(script, scope)
        for pdf in batches:
            yield scope["transform"](pdf)

    return df.mapInPandas(run, schema or df.schema)
