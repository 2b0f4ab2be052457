"""Encoding of a corpus by a public byte-level BPE, each shared chunk once.

Texts are cut into content-defined chunks by a rolling hash, so that equal passages give equal chunks wherever they stand.
Chunks meet by their hash, and each distinct one is encoded once (one that stands in very many texts once for each of up to FAN
shares of its references). A chunk encoded alone can differ from the same characters inside a text only at its ends: after a letter,
a sign that is no letter begins a pre-token whatever stands around, as no pre-token goes on from a letter to another sign. At the first and
the last such place of a chunk, its anchors, its own encoding and that of any text it stands in agree exactly. So a chunk
gives the ids between its anchors and the characters outside them, and a join is repaired by re-encoding from the last
anchor before it to the first one after it, through chunks without an anchor where need be.

The text moves over the network once, with the chunks, and the ids once; rows are told apart by 128 bits of key and text.

Defined cases: NULL and empty texts have no ids; strings of special tokens are ordinary text; repeated rows come out as
often as they went in, also where one id has several texts; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary's folder on every machine of the cluster; a parameter of all functions here.
VOCABULARY = "byte_bpe_50k.tiktoken"
WINDOW = 32
MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 64, 8, 2_048
_FIRST, _LAST = regex.compile(r"\p{L}(?=\P{L})"), regex.compile(r"(?r)\p{L}(?=\P{L})")
#: A chunk met HOT times in one batch is spread over FAN tasks by its texts.
HOT, FAN = 16, 128


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def encoder(path: str) -> tiktoken.Encoding:
    import public_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def chunk_cuts(text: str, bits: int = MEAN_BITS, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> list[int]:
    """End of each chunk, in characters: where the gear hash of the last WINDOW characters has ``bits`` zero bits."""
    n = len(text)
    if n <= least:
        return [n] if n else []
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    g = (c * np.uint64(0x9E3779B97F4A7C15)) ^ ((c * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(29))
    width = 1
    while width < WINDOW:  # sums of doubled width
        shifted = np.zeros_like(g)
        shifted[width:] = g[:-width] << np.uint64(width)
        g = g + shifted
        width *= 2
    ends = np.flatnonzero((g >> np.uint64(40)) & np.uint64((1 << bits) - 1) == 0) + 1
    cuts, at = [], 0
    while n - at > least:
        k = np.searchsorted(ends, at + least)
        end = int(ends[k]) if k < len(ends) else n
        at = min(end, at + most, n)
        cuts.append(at)
    if at < n:
        cuts.append(n)
    return cuts


def encode_chunk(text: str, path: str) -> tuple[str, np.ndarray, str | None]:
    """The characters before the first anchor, the ids up to the last one, the characters after it; all characters and None where there is no anchor."""
    first = _FIRST.search(text)
    if first is None:
        return text, np.empty(0, np.uint32), None
    a, b = first.end(), _LAST.search(text).end()
    return text[:a], encoder(path).encode_to_numpy(text[a:b], disallowed_special=()), text[b:]


def repair(parts: Iterable[tuple[str, np.ndarray, str | None]], path: str) -> np.ndarray:
    """ids of the whole text from its chunks in order; equal to encoding the text at once."""
    enc = encoder(path)
    out: list[np.ndarray | list[int]] = []
    open_text = ""
    for lead, ids, trail in parts:
        open_text += lead
        if trail is not None:
            out += [enc.encode_ordinary(open_text), ids]
            open_text = trail
    out.append(enc.encode_ordinary(open_text))
    return np.concatenate([np.asarray(x, np.int32) for x in out])


def _lists(arrays: list) -> pa.Array:
    """list<int32> of arrays of numbers."""
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate([np.asarray(x, np.int32) for x in arrays]) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def ids_of(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids array<int>), one row per row of docs."""
    path = path or vocabulary_path()
    kind = docs.schema[key].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs_, seqs, hashes, chunks, take = [], [], [], [], []
            for i, (k, t) in enumerate(zip(b["key"].to_pylist(), b["text"].to_pylist())):
                t = t or ""
                doc = xxhash.xxh3_128_digest(f"{k!r}\0{t}".encode("utf-8", "surrogatepass"))
                begin = 0
                for s, e in enumerate(chunk_cuts(t) or [0]):
                    part = t[begin:e]
                    take.append(i if s == 0 else None)
                    docs_.append(doc)
                    seqs.append(s)
                    hashes.append(xxhash.xxh3_128_digest(part.encode("utf-8", "surrogatepass")) if part else doc)
                    chunks.append(part)
                    begin = e
            often = {h for h, n in Counter(hashes).items() if n >= HOT}
            salts = [d[0] % FAN if h in often else 0 for h, d in zip(hashes, docs_)]
            cols = [pa.array(docs_, pa.binary()), pa.array(seqs, pa.int32()), b["key"].take(pa.array(take, pa.int64())), pa.array(hashes, pa.binary()), pa.array(salts, pa.int32()), pa.array(chunks, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc", "seq", "key", "h", "salt", "chunk"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        narrow = np.uint16 if encoder(path).n_vocab <= 1 << 16 else np.uint32
        last, made = None, None
        for b in batches:
            done = []
            for i, h in enumerate(b["h"].to_pylist()):
                if h != last:
                    lead, ids, trail = encode_chunk(b["chunk"][i].as_py(), path)
                    last, made = h, (lead, ids.astype(narrow).tobytes(), trail)
                done.append(made)
            leads, ids, trails = zip(*done) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays([b["doc"], b["seq"], b["key"], pa.array(leads, pa.string()), pa.array(ids, pa.binary()), pa.array(trails, pa.string())], ["doc", "seq", "key", "lead", "ids", "trail"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        narrow = np.uint16 if encoder(path).n_vocab <= 1 << 16 else np.uint32
        doc, parts, keys = None, [], []
        for b in batches:
            out_keys, out = [], []
            cells = (b[c].to_pylist() for c in ("doc", "seq", "key", "lead", "ids", "trail"))
            for d, seq, k, lead, ids, trail in zip(*cells):
                if d != doc:
                    if keys:
                        out_keys += keys
                        out += [repair(parts, path)] * len(keys)
                    doc, parts, keys = d, [], []
                if seq == len(parts):
                    parts.append((lead, np.frombuffer(ids, narrow), trail))
                if seq == 0:  # a repeated row has all its parts again
                    keys.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(out_keys, b["key"].type), _lists(out)], ["key", "ids"])
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, b["key"].type), _lists([repair(parts, path)] * len(keys))], ["key", "ids"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    chunks = rows.mapInArrow(split, f"doc binary, seq int, key {kind}, h binary, salt int, chunk string")
    chunks = chunks.repartition("h", "salt").sortWithinPartitions("h", "salt")
    encoded = chunks.mapInArrow(encode, f"doc binary, seq int, key {kind}, lead string, ids binary, trail string")
    return encoded.repartition("doc").sortWithinPartitions("doc", "seq").mapInArrow(assemble, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def sizes_of(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens long): sizes alone need no shuffle, each text is encoded where it lies; NULL and empty texts have 0."""
    path = path or vocabulary_path()
    kind = docs.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["key"], pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in b["text"].to_pylist()], pa.int64())], ["key", "n_tokens"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(count, f"key {kind}, n_tokens long").withColumnRenamed("key", key)
