"""Byte-level BPE: boundaries by a scan of transition functions, then cached pair merging."""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import documents, release, ship

#: Classes of code points; an apostrophe that a contraction can start with has its own, by the
#: letters that follow it. END stands between two texts.
SPACE, BLANK, LETTER, NUMBER, OTHER, ONE, TWO, END = range(8)
#: States: after white space or at the start, after a blank, in a run of letters, numbers or
#: others, with one or two letters of a contraction to come, after a contraction.
_START, _BLANK, _LETTER, _NUMBER, _OTHER, _NEED1, _NEED2, _DONE = range(8)
_BLOCK, _CHARS, _CACHE = 256, 1 << 19, 50_000


def _transitions() -> np.ndarray:
    t = np.zeros((8, 8), dtype=np.intp)
    t[SPACE], t[BLANK], t[NUMBER], t[OTHER], t[END] = _START, _BLANK, _NUMBER, _OTHER, _START
    t[LETTER] = _LETTER
    t[LETTER, _NEED2], t[LETTER, _NEED1] = _NEED1, _DONE
    for c, need in ((ONE, _NEED1), (TWO, _NEED2)):
        t[c] = need
        t[c, [_BLANK, _OTHER]] = _OTHER  # within a run of others it is one of them
    return t


def _begins() -> np.ndarray:
    """Whether a token begins at a character of the class, by the state before it."""
    b = np.ones((8, 8), dtype=bool)
    b[[SPACE, BLANK], _START] = b[[SPACE, BLANK], _BLANK] = False
    for c, run in ((LETTER, [_BLANK, _LETTER, _NEED1, _NEED2]), (NUMBER, [_BLANK, _NUMBER]), (OTHER, [_BLANK, _OTHER]), (ONE, [_BLANK, _OTHER]), (TWO, [_BLANK, _OTHER])):
        b[c, run] = False
    return b


_T, _B = _transitions().ravel(), _begins().ravel()


def members(pattern: str) -> np.ndarray:
    """The code points that are a match of a pattern of one character, as the tokenizer library has it."""
    import tiktoken

    library = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    found = library.decode_bytes(library.encode_ordinary(every)).decode()
    return np.frombuffer(found.encode("utf-32-le"), dtype=np.uint32)


@functools.cache
def _class_table() -> np.ndarray:
    """The class of each code point; the library's tables of Unicode decide, not the interpreter's older ones."""
    t = np.full(0x110000, OTHER, dtype=np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        t[members(pattern)] = kind
    t[0x20] = BLANK
    return t


def states_before(cls: np.ndarray) -> np.ndarray:
    """The automaton's state before each character, from _START.

    A character is a function from state to state; functions compose associatively. Blocks are
    composed side by side, the blocks' functions by doubling, and a second sweep over the blocks
    fills in the states.
    """
    n = len(cls)
    rows = -(-n // _BLOCK)
    base = np.full(rows * _BLOCK, END, dtype=np.intp)
    base[:n] = cls
    base = np.ascontiguousarray((base * 8).reshape(rows, _BLOCK).T)
    f = np.tile(np.arange(8), (rows, 1))
    for j in range(_BLOCK):
        f = _T[base[j][:, None] + f]
    step = 1
    while step < rows:  # f[r] becomes the function of all blocks up to r
        f = np.concatenate([f[:step], np.take_along_axis(f[step:], f[:-step], axis=1)])
        step *= 2
    state = np.concatenate([[_START], f[:-1, _START]])
    out = np.empty((_BLOCK, rows), dtype=np.uint8)
    for j in range(_BLOCK):
        out[j] = state
        state = _T[base[j] + state]
    return out.T.reshape(-1)[:n]


def classes(cp: np.ndarray) -> np.ndarray:
    """The class of each code point, with apostrophes resolved by what follows."""
    cls = _class_table()[cp]
    at = np.flatnonzero(cp == 0x27)
    if len(at):
        a, b = (np.concatenate([cp[k:], np.zeros(k, cp.dtype)])[at] for k in (1, 2))
        cls[at[np.isin(a, [ord(x) for x in "stmd"])]] = ONE
        cls[at[((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))]] = TWO
    return cls


def boundaries(cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions where a token begins. ``ends``: positions of the separators between texts."""
    cls = classes(cp)
    cls[ends] = END
    begins = _B[cls.astype(np.intp) * 8 + states_before(cls)]
    white = cls <= BLANK
    solid = np.concatenate([~white[1:] & (cls[1:] != END), [False]])
    begins |= white & solid  # the last white space before a word stands apart or joins it
    begins[0] = True
    begins[ends] = True
    begins[ends[ends + 1 < len(cp)] + 1] = True
    return np.flatnonzero(begins)


def pretokens(texts: list[str]) -> list[list[bytes]]:
    """The slices of each text that are merged separately, as UTF-8."""
    out: list[list[bytes]] = [[] for _ in texts]
    group: list[tuple[int, str]] = []

    def flush() -> None:
        if not group:
            return
        joined = "\n".join(t for _, t in group) + "\n"
        cp = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        ends = np.cumsum([len(t) + 1 for _, t in group]) - 1
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        offset = np.concatenate([[0], np.cumsum(width)])
        cut, raw = boundaries(cp, ends), joined.encode()
        last = np.searchsorted(cut, ends)
        at = offset[cut].tolist()
        begin = 0
        for (i, _), end in zip(group, last.tolist(), strict=True):
            out[i] += [raw[a:b] for a, b in zip(at[begin:end], at[begin + 1 : end + 1], strict=True)]
            begin = end + 1
        group.clear()

    size = 0
    for i, t in enumerate(texts):
        while len(t) > _CHARS:  # a long text is cut where a token surely begins: nothing looks back
            flush()
            head, span = np.zeros(0, int), _CHARS
            while not len(head):
                cp = np.frombuffer(t[:span].encode("utf-32-le"), dtype=np.uint32)
                b = boundaries(cp, np.zeros(0, int))
                b = b[(b > 0) & (b < len(cp) - 3)]
                head, span = b[_class_table()[cp[b - 1]] > BLANK], span * 2  # white space depends on what follows it
                if span > 2 * len(t):
                    break
            if not len(head):
                break
            cut = int(head[-1])
            group.append((i, t[:cut]))
            flush()
            t, size = t[cut:], 0
        group.append((i, t))
        size += len(t)
        if size > _CHARS:
            flush()
            size = 0
    flush()
    return out


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merging of one slice, lowest rank first, leftmost on a tie."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == len(ranks):
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Codec:
    """Encodes and decodes with a table of ranks (lines of base64 and rank)."""

    def __init__(self, table: bytes):
        import tiktoken

        pairs = (line.split() for line in table.splitlines() if line)
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        # the library merges the pairs of a slice; its own splitting is not used
        self._piece = tiktoken.Encoding("vellum", pat_str=r"[\s\S]", mergeable_ranks=self.ranks, special_tokens={})._encode_single_piece
        self.cache: dict[bytes, bytes] = {}
        size = max(self.ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for t, r in self.ranks.items():
            tokens[r] = t
        self.blob = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]]) if size else np.zeros(0, np.int64)

    def _merged(self, piece: bytes) -> bytes:
        got = self.cache.get(piece)
        if got is None:
            if len(self.cache) >= _CACHE:
                self.cache.clear()
            got = np.array(self._piece(piece), dtype="<i4").tobytes()
            if len(piece) <= 64:
                self.cache[piece] = got
        return got

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; the slices of about a quarter of a million characters are held at once."""
        out, begin, size = [], 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size < _CHARS // 4 and i + 1 < len(texts):
                continue
            for pieces in pretokens(texts[begin : i + 1]):
                got = list(map(self.cache.get, pieces))
                if None in got:
                    got = [self._merged(p) if g is None else g for p, g in zip(pieces, got, strict=True)]
                out.append(np.frombuffer(b"".join(got), dtype="<i4"))
            begin, size = i + 1, 0
        return out

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte offset at which each token begins, and the end of the last."""
        return np.concatenate([[0], np.cumsum(self.length[ids])])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, placed by the tokens' offsets."""
        out = []
        for at in range(0, len(ids), _CHARS):
            part = ids[at : at + _CHARS]
            offset = self.offsets(part)
            out.append(self.blob[np.repeat(self.start[part] - offset[:-1], self.length[part]) + np.arange(offset[-1])].tobytes())
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def codec(table: bytes) -> Codec:
    return Codec(table)


def default_path() -> str:
    """The vocabulary of the production query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _lists(parts: list[np.ndarray], kind):

    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind), *parts]).astype(kind)))


def functions(spark: SparkSession, path: str | None = None):
    """Column functions: encode(text) -> array<int>, decode(ids) -> binary, offsets(ids) -> array<int>,
    and round_trip(text) -> struct of the ids and of what they decode to.

    The table is read on the driver (under 1 MB) and sent once. A null text encodes as an empty
    one, to no ids; no ids decode to no bytes.
    """

    ship(spark)
    with open(path or default_path(), "rb") as f:
        table = spark.sparkContext.broadcast(f.read())

    @F.arrow_udf("array<int>")
    def encode(text: pa.Array) -> pa.Array:
        return _lists(codec(table.value).encode([t or "" for t in text.to_pylist()]), np.int32)

    def split(ids: pa.Array):
        values, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        return [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        return pa.array([codec(table.value).decode(x) for x in split(ids)], pa.binary())

    @F.arrow_udf("array<int>")
    def offsets(ids: pa.Array) -> pa.Array:
        return _lists([codec(table.value).offsets(x) for x in split(ids)], np.int32)

    @F.arrow_udf("struct<input_ids:array<int>,decoded:binary>")
    def round_trip(text: pa.Array) -> pa.Array:
        c = codec(table.value)
        ids = c.encode([t or "" for t in text.to_pylist()])
        release()
        return pa.StructArray.from_arrays([_lists(ids, np.int32), pa.array([c.decode(x) for x in ids], pa.binary())], ["input_ids", "decoded"])

    return encode, decode, offsets, round_trip


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, input_ids, decoded binary) for every row of ``docs``, from its whole text.

    Null and empty texts have no ids and decode to no bytes; repeated rows are each encoded. Very
    long texts are cut where a token surely begins. Other columns are ignored; an empty table
    gives an empty result.
    """
    round_trip = functions(docs.sparkSession, path)[3]  # one function: a task needs one worker
    return docs.select("doc_id", round_trip("text").alias("r")).select("doc_id", "r.input_ids", "r.decoded")


def digests(encoded: DataFrame) -> DataFrame:
    """n_tokens, and the digests of the ids and of what they decode to."""
    ids = F.sha2(F.array_join(F.col("input_ids").cast("array<string>"), ",").cast("binary"), 256)
    return encoded.select("doc_id", F.size("input_ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encode_documents() over all documents, ids and decoded bytes as digests."""
    return digests(encode_documents(documents(spark, sf_dir)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoded documents: doc_id, n_tokens, the ids, and both digests."""
    e = encode_documents(docs)
    ids = F.sha2(F.array_join(F.col("input_ids").cast("array<string>"), ",").cast("binary"), 256)
    return e.select("doc_id", F.size("input_ids").cast("long").alias("n_tokens"), "input_ids", ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
