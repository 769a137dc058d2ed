"""Line dedup with a sharded minimal perfect hash.

Each distinct line that enough documents hold gets a slot of a minimal perfect
hash; compact arrays hold its fingerprint, document count and last document.
Documents send the distinct hashes of a chunk of documents to the shards and
probe the arrays; lines are never joined with lines. The chunk is the unit of a
probe, so a line that very many documents share is asked for once per chunk.
Chunks are dealt over copies of a shard's arrays, so that the size of a probing
task follows from the lines asked for and not from the few that are repeated.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import bucket, id_and_text, id_and_text_columns, parts, shown_id, stored, text_bytes

WHITE = " \t\n\v\f\r"
CHUNK_BYTES = 4 << 20
KEYS_PER_SHARD = 100_000
ASKED_PER_TASK = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


# --- minimal perfect hash ---------------------------------------------------------


def _level(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (keys + np.uint64(level + 1)) * _ODD
        z ^= z >> np.uint64(31)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        return z ^ (z >> np.uint64(29))


def build_mph(keys: np.ndarray, room: float = 1.6) -> list[np.ndarray]:
    """Bit arrays of a minimal perfect hash over distinct 64-bit keys.

    At each level the keys that are alone in their cell stay there; the others
    go on to the next level. The slot of a key is the rank of its cell.
    """
    levels, rest = [], np.unique(keys.astype(np.uint64))
    while len(rest):
        cell = (_level(rest, len(levels)) % np.uint64(int(room * len(rest)) + 1)).astype(np.int64)
        held = np.bincount(cell, minlength=int(room * len(rest)) + 1) == 1
        levels.append(held)
        rest = rest[~held[cell]]
    return levels


def probe_mph(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slot of each key; -1 for keys that no level holds. Other keys may get any slot."""
    slot, start = np.full(len(keys), -1, np.int64), 0
    rest = np.arange(len(keys))
    for n, held in enumerate(levels):
        cell = (_level(keys[rest].astype(np.uint64), n) % np.uint64(len(held))).astype(np.int64)
        hit = held[cell]
        slot[rest[hit]] = start + np.cumsum(held)[cell[hit]] - 1
        start, rest = start + int(held.sum()), rest[~hit]
    return slot


# --- operator ---------------------------------------------------------------------


def _key(line: str, min_points: int) -> bytes | None:
    line = line.strip(WHITE)
    return line.encode().lower() if len(line) >= min_points else None


def _hashes(keys: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes per key."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<i8").reshape(-1, 2)


def line_table(docs: DataFrame, min_points: int) -> DataFrame:
    """(chunk, key, h, f): the distinct line keys of each document as two hashes."""

    def per_batch(batches):
        for b in batches:
            kept = [{k for x in t.split("\n") if (k := _key(x, min_points))} for t in b["text"]]
            n = [len(k) for k in kept]
            h = _hashes([k for ks in kept for k in ks])
            yield pd.DataFrame({"chunk": np.repeat(b["chunk"], n), "key": np.repeat(b["key"], n), "h": h[:, 0], "f": h[:, 1]})

    return docs.mapInPandas(per_batch, "chunk int, key long, h long, f long")


def shard_arrays(counts: DataFrame, n_shards: int) -> DataFrame:
    """One row of compact arrays per shard of (h, f, n, last)."""

    def build(g: pd.DataFrame) -> pd.DataFrame:
        again = g["h"].duplicated()  # equal in one hash only: listed apart
        first, levels = g[~again], build_mph(g["h"].to_numpy())
        slot = probe_mph(levels, first["h"].to_numpy())
        arrays = {}
        for name in ("f", "n", "last"):
            arrays[name] = np.empty(len(first), "<i8")
            arrays[name][slot] = first[name].to_numpy()
        return pd.DataFrame({
            "shard": [g["shard"].iloc[0]], "sizes": [[len(x) for x in levels]],
            "bits": [np.packbits(np.concatenate(levels)).tobytes()], **{k: [v.tobytes()] for k, v in arrays.items()},
            "apart": [g.loc[again, ["h", "f", "n", "last"]].to_numpy("<i8").tobytes()],
        })

    return (
        counts.withColumn("shard", bucket(n_shards, "h")).groupBy("shard")
        .applyInPandas(build, "shard int, sizes array<long>, bits binary, f binary, n binary, last binary, apart binary")
    )


def probe(asked: DataFrame, arrays: DataFrame, n_copies: int) -> DataFrame:
    """(chunk, h, f, n, last) of the asked hashes (shard, chunk, h, f) that the arrays hold.

    ``n_copies`` tasks probe each shard, every one for its own chunks.
    """
    asked = asked.withColumn("copy", bucket(n_copies, "chunk"))
    arrays = arrays.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n_copies - 1))))

    def one_shard(a: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if a.empty or t.empty:
            return pd.DataFrame({"chunk": [], "h": [], "f": [], "n": [], "last": []})
        t = t.iloc[0]
        bits = np.unpackbits(np.frombuffer(t["bits"], np.uint8), count=int(sum(t["sizes"]))).astype(bool)
        levels = np.split(bits, np.cumsum(t["sizes"])[:-1])
        f, n, last = (np.frombuffer(t[k], "<i8") for k in ("f", "n", "last"))
        slot = probe_mph(levels, a["h"].to_numpy())
        ok = (slot >= 0) & (f[slot] == a["f"].to_numpy())
        found = a.loc[ok, ["chunk", "h", "f"]].assign(n=n[slot[ok]], last=last[slot[ok]])
        apart = pd.DataFrame(np.frombuffer(t["apart"], "<i8").reshape(-1, 4), columns=["h", "f", "n", "last"])
        return pd.concat([found, a[["chunk", "h", "f"]].merge(apart, on=["h", "f"])]) if len(apart) else found

    return asked.groupBy("shard", "copy").cogroup(arrays.groupBy("shard", "copy")).applyInPandas(
        one_shard, "chunk int, h long, f long, n long, last long"
    )


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_points: int = 20,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Texts without the lines that at least ``min_docs`` documents hold.

    A line's key is the line without white space at both ends, A-Z lower-cased;
    keys shorter than ``min_points`` code points always stay. A repeated line
    stays in the document with the largest id that holds it, everywhere in it.

    Returns one row per input row: (id_col, n_lines, n_dropped, text), then the
    columns in ``carry``. A NULL or empty text has one empty line. Rows with the
    same id are one document, wherever they are worked on: rows are dealt by id
    and text, so that rows without an id do not meet in one task. A NULL id is
    the smallest id. No rows in, none out.
    """
    texts = id_and_text(docs, id_col, text_col)
    n_chunks = parts(text_bytes(texts), CHUNK_BYTES)
    rows = docs.select(
        *id_and_text_columns(id_col, text_col), *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)]
    ).withColumn("chunk", bucket(n_chunks, "key", "text"))
    lines = stored(line_table(rows.select("chunk", "key", "text"), min_points), "lines")
    counts = stored(
        lines.groupBy("h", "f").agg(F.count_distinct("key").alias("n"), F.max("key").alias("last")).filter(F.col("n") >= min_docs),
        "line-counts",
    )
    n_shards = parts(counts.count(), KEYS_PER_SHARD)
    asked = lines.select("chunk", "h", "f").distinct()
    asked = asked.withColumn("shard", bucket(n_shards, "h"))
    n_copies = parts(lines.count(), ASKED_PER_TASK * n_shards)
    hits = probe(asked, shard_arrays(counts, n_shards), n_copies)
    schema = f"key long, n_lines long, n_dropped long, text string{''.join(f', carry_{i} {docs.schema[c].dataType.simpleString()}' for i, c in enumerate(carry))}"

    def apply(d: pd.DataFrame, hit: pd.DataFrame) -> pd.DataFrame:
        last = dict(zip(zip(hit["h"], hit["f"]), hit["last"]))
        out = []
        for key, text in zip(d["key"], d["text"]):
            lines = text.split("\n")
            keys = [_key(x, min_points) for x in lines]
            h = iter(_hashes([k for k in keys if k]).tolist())
            kept = [x for x, k in zip(lines, keys) if k is None or last.get(tuple(next(h)), key) == key]
            out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
        d = d.drop(columns=["chunk", "text"])
        d["n_lines"], d["n_dropped"], d["text"] = zip(*out) if out else ([], [], [])
        return d

    kept = rows.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInPandas(apply, schema)
    return kept.select(
        shown_id().alias(id_col), "n_lines", "n_dropped", F.col("text").alias(text_col),
        *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)],
    )

