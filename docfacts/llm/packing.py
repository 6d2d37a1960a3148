"""Best-fit packing of tokenized documents into sequences by a grouping genetic algorithm on islands.

Documents become pieces of at most CAPACITY tokens; full pieces fill a sequence each. The others are dealt by hash into
blocks of bounded size. Each block is packed on several islands, each with a population of packings that lives through
all epochs. A crossover injects whole well-filled bins of one parent into the other, removes the bins that hold their
documents a second time, and best-fits displaced documents; parents win a tournament each, and a child takes the place
of the worst packing if it is better. Between epochs each island's elite packing migrates to the next island. An island
rests once its elite has as few bins as the tokens need. The worse-filled bins of all blocks (at least those under the
block's median, at most those not FULL) are then dealt anew into fewer blocks, until one block holds what is left.

Null texts are empty (one token, the closing id). Repeated rows and rows with null ids are pieces of their own. Ties go
to the smaller place. Seeds come from block and island, so a task that runs again gives the same packing. An empty table
gives an empty result; further columns are left alone. A very long text is encoded whole in one task.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, map_arrow

CAPACITY, CLOSING = 2048, 0
#: Pieces in a block, islands for each, epochs between migrations, packings on an island, crossovers an epoch.
BLOCK, ISLANDS, EPOCHS, POPULATION, CHILDREN = 4096, 3, 3, 6, 12
#: A bin this full stays as it is when the rest is dealt anew.
FULL = 0.995
#: Words that a task remembers with their ids; beyond that it starts anew.
REMEMBERED = 400_000

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: The public vocabulary's splitting pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"


def plain_ranks(spec: dict) -> bool:
    """Whether a tokenizers file is what tiktoken's encoder does with its ids as ranks: no normalizer, the byte-level
    splitting pattern without a leading blank, merges in the order of the ids they make, SPECIAL alone added."""
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    vocab = model["vocab"]
    ids = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    return (
        model["type"] == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        and spec["normalizer"] is None
        and split.get("type") == "ByteLevel"
        and split.get("use_regex") is True
        and split.get("add_prefix_space") is False
        and [t["content"] for t in spec["added_tokens"]] == [SPECIAL]
        and all(x < y for x, y in zip(ids, ids[1:], strict=False))
        and min(ids, default=0) >= 0
        and len(ids) + 256 == len(vocab.keys() - {SPECIAL})
    )


class Tokens:
    """Ids of the byte-level BPE vocabulary in a tokenizers file, as little-endian 32-bit integers.

    The splitting pattern never crosses a single blank between two other characters, so such runs are encoded apart,
    each just once while it is remembered. The ranks of the vocabulary are its ids, which lets tiktoken's encoder read
    it; where that does not hold of the file, and for a text with the special token, the tokenizers library encodes."""

    def __init__(self, path: str) -> None:
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        self.path, self.known, self.slow, self.encode = path, {}, None, None
        if plain_ranks(spec):
            back = {c: b for b, c in _byte_letters().items()}
            ranks = {bytes(back[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w != SPECIAL}
            self.encode = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        if self.encode is None or SPECIAL in text:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = _CUT.split(text)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        try:
            tail = b"".join([known[w] for w in rest])
        except KeyError:
            for w in rest:
                if w not in known:
                    known[w] = array("I", self.encode(" " + w)).tobytes()
            tail = b"".join([known[w] for w in rest])
        return array("I", self.encode(first)).tobytes() + tail


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a printable character: itself, or the next one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], n = chr(n), n + 1
    return out


@cache
def _tokens(path: str) -> Tokens:
    return Tokens(path)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(a, capacity) for a in range(head, n, capacity)]


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each document."""

    def run(batches):
        encode, closing = _tokens(path), CLOSING.to_bytes(4, "little")
        for b in batches:
            at, cols = [], ([], [], [], [])
            for k, text in enumerate(b.column("text").to_pylist()):
                ids = encode(text or "") + closing
                for j, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    at.append(k)
                    for c, v in zip(cols, (j, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = dict(documents.dtypes)["doc_id"]
    return map_arrow(
        documents.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(items: np.ndarray, length: np.ndarray, own: np.ndarray, room: np.ndarray, capacity: int) -> int:
    """Put items, in the order given, each into the bin with the least room that takes it, or into a new one. own: the
    bin of each piece, filled in here; room: what each bin has left. Returns the number of bins."""
    order = np.argsort(room, kind="stable")
    free, bins, n = room[order].tolist(), order.tolist(), len(room)
    for i, size in zip(items.tolist(), length[items].tolist(), strict=True):
        at = bisect_left(free, size)
        if at == len(free):
            left, k, n = capacity, n, n + 1
        else:
            left, k = free.pop(at), bins.pop(at)
        own[i] = k
        left -= size
        at = bisect_left(free, left)
        free.insert(at, left)
        bins.insert(at, k)
    return n


def pack_in_order(order: np.ndarray, length: np.ndarray, capacity: int) -> np.ndarray:
    own = np.zeros(len(length), np.int32)
    best_fit(order, length, own, np.zeros(0, np.int64), capacity)
    return own


def fills(own: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.bincount(own, length).astype(np.int64)


def fitness(own: np.ndarray, length: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first; then uneven filling, which leaves room in one place."""
    fill = fills(own, length)
    return -len(fill), float(np.square(fill / capacity).sum())


def crossover(a: np.ndarray, b: np.ndarray, length: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Some of b's better-filled bins go whole into a; a's bins that hold their pieces too are undone, and what is left
    of these is best-fitted, the longest first."""
    fill = fills(b, length)
    good = fill >= np.median(fill)
    chosen = good & (rng.random(len(fill)) < rng.uniform(0.02, 0.5))
    if not chosen.any():
        chosen[rng.choice(np.flatnonzero(good))] = True
    injected = chosen[b]
    undone = np.zeros(int(a.max()) + 1, bool)
    undone[a[injected]] = True
    # a few of a's worst bins are undone as well, so that their pieces find better company
    worst = np.argsort(fills(a, length), kind="stable")[: rng.integers(1, 4)]
    undone[worst] = True
    displaced = np.flatnonzero(undone[a] & ~injected)
    kept, taken = np.cumsum(~undone) - 1, np.cumsum(chosen) - 1
    own = np.where(injected, taken[b] + (~undone).sum(), kept[a]).astype(np.int32)
    room = capacity - np.concatenate((fills(a, length)[~undone], fill[chosen]))
    best_fit(displaced[np.lexsort((displaced, -length[displaced]))], length, own, room, capacity)
    return own


def evolve(
    length: np.ndarray, people: list[np.ndarray], guest: np.ndarray | None, capacity: int, seed: int, population: int = POPULATION, children: int = CHILDREN
) -> list[np.ndarray]:
    """An island's population after one more epoch, the best first; people: its population before (none at first),
    guest: the neighbour's elite."""
    rng = np.random.default_rng(seed)
    people = list(people)
    while len(people) < population:
        noise = rng.normal(0, 0.08, len(length)) if people else 0
        people.append(pack_in_order(np.argsort(-length * (1 + noise), kind="stable"), length, capacity))
        if len(people) == 1 and people[0].max() + 1 <= -(-int(length.sum()) // capacity):
            people *= population  # as few bins as can be: nothing to look for
    scored = sorted(((fitness(p, length, capacity), k, p) for k, p in enumerate(people)), key=lambda x: (x[0], -x[1]), reverse=True)
    if guest is not None:
        scored[-1] = (fitness(guest, length, capacity), population, guest)
        scored.sort(key=lambda x: (x[0], -x[1]), reverse=True)
    bound = -(-int(length.sum()) // capacity)
    for n in range(children):
        if -scored[0][0][0] <= bound:
            break
        # two tournaments of two each; the population is sorted, so the smaller place wins
        i, j = (int(rng.integers(0, population, 2).min()) for _ in range(2))
        child = crossover(scored[i][2], scored[j][2], length, capacity, rng)
        found = fitness(child, length, capacity)
        if found > scored[-1][0] and all(found != x[0] for x in scored):
            scored[-1] = (found, population + 1 + n, child)
            scored.sort(key=lambda x: (x[0], -x[1]), reverse=True)
    return [p for *_, p in scored]


def pack_blocks(items: DataFrame, blocks: int, capacity: int, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """uid, length, block, bin, settled: the best packing of any island for each block, and whether a bin shall stay as
    it is (full, or filled as the block's median or more). items: uid, length."""
    dealt = items.select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int").alias("block"))
    kind = "uid long, length long, block int, island int, people array<int>, elite int"

    def epoch(n: int):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("uid", ignore_index=True)
            length, island = frame["length"].to_numpy(), int(frame["island"].iloc[0])
            people = list(np.array(frame["people"].tolist(), np.int32).T) if n else []
            guest = frame["guest"].to_numpy(np.int32) if n and islands > 1 else None
            seed = [int(frame["block"].iloc[0]), island, n]
            after = np.stack(evolve(length, people, guest, capacity, seed), 1)
            return frame[["uid", "length", "block", "island"]].assign(people=list(after), elite=after[:, 0])

        return run

    state = dealt.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
    for n in range(epochs):
        if n:
            # the elite migrates to the next island of its block
            ring = Window.partitionBy("block", "uid").orderBy("island")
            before = F.coalesce(F.lag("elite").over(ring), F.last("elite").over(ring.rowsBetween(0, Window.unboundedFollowing)))
            state = state.withColumn("guest", before)
        state = state.groupBy("block", "island").applyInPandas(epoch(n), kind)

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        best = None
        for _, own in frame.groupby("island"):
            own = own.sort_values("uid", ignore_index=True)
            score = fitness(own["elite"].to_numpy(), own["length"].to_numpy(), capacity)
            if best is None or score > best[0]:
                best = (score, own)
        own = best[1]
        fill = fills(own["elite"].to_numpy(), own["length"].to_numpy())
        settled = fill >= min(FULL * capacity, np.median(fill))
        return own[["uid", "length", "block"]].assign(bin=own["elite"], settled=settled[own["elite"]])

    slim = state.select("uid", "length", "block", "island", "elite")
    return slim.groupBy("block").applyInPandas(choose, "uid long, length long, block int, bin long, settled boolean")


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cutted = durable(pieces(documents, path, capacity).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    rest = cutted.where(F.col("length") < capacity).select("uid", "length")
    done, turn, size = [], 0, rest.count()
    while size:
        blocks = -(-size // block)
        packed = durable(pack_blocks(rest, blocks, capacity), "packed").withColumn(
            "sequence_id", F.shiftleft(F.lit(turn + 1).cast("long"), 56) + F.shiftleft(F.col("block").cast("long"), 24) + F.col("bin")
        )
        settled = F.lit(True) if blocks == 1 else F.col("settled")
        done.append(packed.where(settled).select("uid", "length", "sequence_id"))
        if blocks == 1:
            break
        rest = packed.where(~settled).select("uid", "length")
        size, turn = rest.count(), turn + 1
    full = cutted.where(F.col("length") >= capacity).select("uid", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = full
    if done:
        every = done[0]
        for d in done[1:]:
            every = every.unionByName(d)
        before = Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
        placed = full.unionByName(
            every.select("uid", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
        )
    return cutted.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
