"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import Words, as_bytes, crc_mod, documents, released, scratch_path, ship, total_bytes

HELD_OUT = 10
#: Stand for the begin and the end of a text among the hashes of words.
BEGIN, END = 2, 1
SEED = 11
#: Text bytes to a shard of the model; a shard is what one task merges.
SHARD_BYTES = 16_000_000
#: Contexts at most whose bigrams are dealt over all shards: the driver and each task hold them.
HOT_CONTEXTS = 65_536
#: Files that a worker holds mapped at once.
_OPEN = 512
#: Tokens that are counted at once, and bytes of text that are split or scored at once.
_TOKENS, _GROUP = 2_000_000, 5_000_000
#: Bigrams in a blob: small objects for the JVM that passes them on.
_BLOB = 20_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_UNI = ("c", "cont", "total", "n1", "n2", "n3")


def pair_key(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """A 64-bit hash of a bigram."""
    x = (context * _MIX) ^ (token + (token << np.uint64(7)))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Tokens:
    """Hashes of the lower-cased words of texts, an end after each."""

    def __init__(self):
        self.words = Words(SEED)

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(contexts, tokens, number of tokens of each text)."""
        parts, sizes = [], []
        for t in texts:
            w = (t or b"").lower().split()
            parts += [self.words.of(w), np.array([END], dtype=np.uint64)]
            sizes.append(len(w) + 1)
        token = np.concatenate([np.zeros(0, np.uint64), *parts])
        n = np.array(sizes, dtype=np.int64)
        context = np.concatenate([np.array([BEGIN], dtype=np.uint64), token[:-1]]) if len(token) else token
        if len(n):
            context[np.cumsum(n)[:-1]] = BEGIN
        return context, token, n


def _groups(texts: list, most: int = _GROUP):
    """Slices of the texts of about ``most`` bytes."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays side by side in one blob: the lengths first."""
    return np.array([a.nbytes for a in arrays.values()], dtype="<i8").tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays.values())


def _unpack(blob: bytes, kinds: list) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, dtype="<i8", count=len(kinds))
    out, at = [], 8 * len(kinds)
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(blob, dtype=kind, count=size // np.dtype(kind).itemsize, offset=at))
        at += size
    return out


def bigram_shard(context: np.ndarray, key: np.ndarray, shards: int, hot: np.ndarray) -> np.ndarray:
    """Where a bigram is kept: with its context, or, if that is a hot one, by its own hash."""
    return np.where(np.isin(context, hot), key, context) % np.uint64(shards)


def _cuts(shard: np.ndarray, most: int = _BLOB):
    """(shard, begin, end) of the stretches of sorted shard numbers, long ones in parts; shards without rows cost nothing."""
    begin = np.flatnonzero(np.concatenate([[True], np.diff(shard) != 0])) if len(shard) else np.zeros(0, int)
    for s, a, e in zip(shard[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(shard)], strict=True):
        for at in range(a, e, most):
            yield s, at, min(at + most, e)


def _bigram_blobs(context: np.ndarray, token: np.ndarray, shards: int, hot: np.ndarray):
    """(shard, blob): distinct bigrams with counts, grouped by context."""
    key, first, count = np.unique(pair_key(context, token), return_index=True, return_counts=True)
    context, token = context[first], token[first]
    shard = bigram_shard(context, key, shards, hot)
    order = np.lexsort((context, shard))
    context, token, count, shard = context[order], token[order], count[order].astype(np.uint32), shard[order]
    for s, a, b in _cuts(shard):
        u, n = np.unique(context[a:b], return_counts=True)
        yield s, _pack(u=u, n=n.astype(np.uint32), token=token[a:b], count=count[a:b])


def _merge_bigrams(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, context, token, count) of the distinct bigrams, sorted by key."""
    parts = [_unpack(b, ["<u8", "<u4", "<u8", "<u4"]) for b in blobs]
    context = np.concatenate([np.repeat(u, n) for u, n, _, _ in parts])
    token, count = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
    key = pair_key(context, token)
    order = np.argsort(key, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
    first = order[begin]
    return key[first], context[first], token[first], np.add.reduceat(count[order].astype(np.int64), begin)


def _sums(key: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys, sorted, and the sums of each column."""
    order = np.argsort(key, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
    return key[order][begin], [np.add.reduceat(c[order], begin) for c in columns]


def _small(a: np.ndarray) -> np.ndarray:
    """The array in the smallest unsigned type that holds it."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def store(uri: str, **arrays: np.ndarray) -> None:
    """Write arrays as one file of the shared folder; a retried task replaces it whole."""
    f, path = _filesystem(uri)
    f.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    header = ";".join(f"{k},{a.dtype.str},{len(a)}" for k, a in arrays.items()).encode().ljust(256)
    with f.open_output_stream(part) as out:
        out.write(header)
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 8))
    f.move(part, path)


def load(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped.

    A local or mounted folder is mapped in place. From any other store the file is copied next
    to the worker, mapped, and unlinked at once.
    """
    from pyarrow import fs

    f, path = _filesystem(uri)
    if isinstance(f, fs.LocalFileSystem):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
    else:
        with tempfile.NamedTemporaryFile() as t:
            with f.open_input_stream(path) as src:
                while chunk := src.read(1 << 24):
                    t.write(chunk)
            t.flush()
            raw = np.memmap(t.name, dtype=np.uint8, mode="r")
    out, at = {}, 256
    for part in bytes(raw[:256]).decode().strip().split(";"):
        name, kind, n = part.split(",")
        size = int(n) * np.dtype(kind).itemsize
        out[name] = raw[at : at + size].view(kind)
        at += size + -size % 8
    return out


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of types counted once, twice, three and four times.

    Where those are too few for the formula a discount of 0.75 times its place's share is used.
    """
    n1, n2, n3, n4 = n
    if min(n1, n2, n3) == 0:
        return 0.5, 0.75, 0.75
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))


@dataclass
class Model:
    """Where the arrays are, and the few numbers that hold for all of them."""

    folder: str
    shards: int
    hot: np.ndarray  # contexts whose bigrams are dealt over all shards
    tokens: int  # N
    types: int  # V
    bigrams: int
    d: tuple[float, float, float]  # of bigrams
    d_cont: tuple[float, float, float]  # of continuation counts
    back: float  # weight of the uniform distribution


def hot_contexts(docs: DataFrame, shards: int) -> np.ndarray:
    """Contexts that are more than an eighth of a shard's share of the tokens, at most HOT_CONTEXTS.

    Counted on one text in 32, by a hash; only where bigrams are kept depends on it, not a count.
    """

    def count(batches):
        tokens = Tokens()
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for a, b in _groups(texts):
                word, n = np.unique(tokens.of(texts[a:b])[0], return_counts=True)
                often = n > n.sum() // (64 * shards)
                word, n = np.append(word[often], np.uint64(0)), np.append(n[often], n.sum())  # 0: all
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(32)) == 0)
    rows = some.mapInArrow(released(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(min(8 * shards, HOT_CONTEXTS) + 1).collect()
    total = next((r["n"] for r in rows if r["word"] == 0), 0)
    return np.array([r["word"] for r in rows if r["word"] != 0 and 8 * shards * r["n"] > total], dtype=np.int64).view(np.uint64)


def train(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> Model:
    """Count the bigrams of all texts and write the model to the shared folder.

    Workers count what they read and send, for each shard of contexts that they met, the distinct
    bigrams and counts in blobs. The bigrams of hot contexts are dealt over all shards. One task a
    shard merges them, writes the shard, and sends on the sums of words: how often a word occurs,
    how many contexts it follows, how many types follow it. Tasks of a second round merge those.
    Only sums of each shard come to the driver.
    """
    spark = docs.sparkSession
    ship(spark)
    shards = max(8, -(-total_bytes(docs) // shard_bytes))
    folder, hot = scratch_path(spark, "lm"), hot_contexts(docs, shards)

    def count(batches):
        tokens, waiting = Tokens(), []

        def flush():
            context, token = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            rows = _bigram_blobs(context, token, shards, hot)
            while part := list(islice(rows, 16)):
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in part], pa.int32()), pa.array([b for _, b in part], pa.binary())], names=["shard", "blob"])

        for batch in batches:
            texts = as_bytes(batch.column(0))
            for a, b in _groups(texts):
                waiting.append(tokens.of(texts[a:b])[:2])
                if sum(len(x) for x, _ in waiting) >= _TOKENS:
                    yield from flush()
        if waiting:
            yield from flush()

    def merge_bigrams(group: pa.Table) -> pa.Table:
        s = group.column("shard")[0].as_py()
        key, context, token, n = _merge_bigrams(group.column("blob").to_pylist())
        store(f"{folder}/bigram-{s}", key=key, n=_small(n))
        of_token, (c, cont) = _sums(token, [n, np.ones_like(n)])
        of_context, sums = _sums(context, [n, n == 1, n == 2, n > 2])
        sums = [x.astype(np.int64) for x in sums]
        word = np.concatenate([of_token, of_context])
        columns = [np.concatenate([x, np.zeros(len(of_context), np.int64)]) for x in (c, cont)] + [np.concatenate([np.zeros(len(of_token), np.int64), x]) for x in sums]
        word, columns = _sums(word, columns)
        at, blobs, to = word % np.uint64(shards), [], []
        order = np.argsort(at, kind="stable")
        for t, a, b in _cuts(at[order]):
            mine = order[a:b]
            to.append(t)
            blobs.append(_pack(word=word[mine], **{k: x[mine].astype(np.int64) for k, x in zip(_UNI, columns, strict=True)}))
        tell = [[int((n == k).sum()) for k in (1, 2, 3, 4)]] + [None] * (len(to) - 1)
        return pa.table([pa.array(to, pa.int32()), pa.array(blobs, pa.binary()), pa.array(tell, pa.list_(pa.int64()))], names=["shard", "blob", "tell"])

    def merge_words(group: pa.Table) -> pa.Table:
        s = group.column("shard")[0].as_py()
        parts = [_unpack(b, ["<u8"] + ["<i8"] * len(_UNI)) for b in group.column("blob").to_pylist()]
        word, columns = _sums(np.concatenate([p[0] for p in parts]), [np.concatenate([p[k] for p in parts]) for k in range(1, len(_UNI) + 1)])
        store(f"{folder}/word-{s}", key=word, **{k: _small(x) for k, x in zip(_UNI, columns, strict=True)})
        c, cont = columns[0], columns[1]
        tell = [int(c.sum()), int((c > 0).sum()), int(cont.sum()), *(int((cont == k).sum()) for k in (1, 2, 3, 4)), int((cont > 2).sum())]
        told = [x for t in group.column("tell").to_pylist() if t for x in t]
        return pa.table([pa.array([tell], pa.list_(pa.int64())), pa.array([told], pa.list_(pa.int64()))], names=["words", "bigrams"])

    merged = docs.select("text").mapInArrow(released(count), "shard int, blob binary").groupBy("shard").applyInArrow(merge_bigrams, "shard int, blob binary, tell array<bigint>")
    told = merged.groupBy("shard").applyInArrow(merge_words, "words array<bigint>, bigrams array<bigint>").collect()
    w = np.sum([np.array(r["words"]) for r in told], axis=0).tolist() if told else [0] * 8
    b = np.sum([np.array(r["bigrams"]).reshape(-1, 4).sum(axis=0) for r in told], axis=0).tolist() if told else [0] * 4
    d_cont = discounts(w[3:7])
    back = (d_cont[0] * w[3] + d_cont[1] * w[4] + d_cont[2] * w[7]) / w[2] if w[2] else 1.0
    return Model(folder, shards, hot, w[0], w[1], w[2], discounts(b), d_cont, back)


class Scorer:
    """Looks the model's arrays up, each mapped when it is first needed."""

    def __init__(self, model: Model):
        self.m, self.tokens = model, Tokens()
        self._arrays = functools.lru_cache(maxsize=_OPEN)(self._load)

    def _load(self, kind: str, s: int) -> dict[str, np.ndarray] | None:
        try:
            return load(f"{self.m.folder}/{kind}-{s}")
        except FileNotFoundError:  # no training text has a word of the shard
            return None

    def _find(self, kind: str, shard: np.ndarray, key: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
        """The columns at each of the distinct keys; 0 where the model has none."""
        out = [np.zeros(len(key), dtype=np.int64) for _ in names]
        order = np.lexsort((key, shard))
        for s, a, b in _cuts(shard[order], len(shard) or 1):
            which, arrays = order[a:b], self._arrays(kind, s)
            if arrays is None:
                continue
            at = np.minimum(np.searchsorted(arrays["key"], key[which]), len(arrays["key"]) - 1)
            hit = arrays["key"][at] == key[which]
            for o, name in zip(out, names, strict=True):
                o[which[hit]] = arrays[name][at[hit]]
        return out

    @staticmethod
    def _discount(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
        return np.array([0.0, *d])[np.minimum(n, 3)]

    def score(self, texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score, score of each text."""
        m = self.m
        context, token, n = self.tokens.of(texts)
        words, inverse = np.unique(np.concatenate([token, context]), return_inverse=True)
        c, cont, total, n1, n2, n3 = self._find("word", words % np.uint64(m.shards), words, _UNI)
        uniform = m.back / (m.types + 1)
        p_word = np.maximum(cont - self._discount(cont, m.d_cont), 0) / max(m.bigrams, 1) + uniform
        gamma = np.where(total > 0, (m.d[0] * n1 + m.d[1] * n2 + m.d[2] * n3) / np.maximum(total, 1), 1.0)
        base = np.log10((c + 0.1) / (m.tokens + 0.1 * (m.types + 1)))
        of_token, of_context = inverse[: len(token)], inverse[len(token) :]
        key, at, pair = np.unique(pair_key(context, token), return_index=True, return_inverse=True)
        (count,) = self._find("bigram", bigram_shard(context[at], key, m.shards, m.hot), key, ("n",))
        count = count[pair]
        p = np.maximum(count - self._discount(count, m.d), 0) / np.maximum(total[of_context], 1) + gamma[of_context] * p_word[of_token]
        begin = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
        return n, *(np.add.reduceat(x, begin) for x in ((c[of_token] > 0).astype(np.int64), base[of_token], np.log10(p)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score, perplexity for every row of ``docs``.

    ``score`` is the log10 probability of the words and the end of the whole text; perplexity
    is 10 ** (-score / n_tokens). A null or empty text is its end alone; a very long one is held
    whole by a task. Repeated rows are each scored, other columns ignored. Words that training texts lack share the unknown word's probability; without any
    training text every word is unknown and both scores are 0 (N = V = 0: one outcome).
    """
    ship(docs.sparkSession)

    def each(batches):
        scorer = Scorer(model)
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for a, b in _groups(texts):
                n, known, base, total = scorer.score(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(n), pa.array(known), pa.array(base), pa.array(total)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(each), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on the documents that are not held out; one without an id is trained on."""
    docs = documents(spark, sf_dir)
    held = F.coalesce(crc_mod(F.col("doc_id"), HELD_OUT) == 0, F.lit(False))
    model = train(docs.where(~held))
    out = score(docs, model).withColumns({"held_out": held, "train_tokens": F.lit(model.tokens).cast("long")})
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
