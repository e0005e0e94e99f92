"""Evaluation texts leaking into training text: CGK embedding and bit-sampling LSH over windows."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, ship
from .darts import mix
from .shared import open_shared, spread

WORD = re.compile(r"[^\W_]+")
#: Keys of item windows that a worker holds at a time (8 bytes each); a larger item set takes one pass over the corpus per so many.
BLOCK_KEYS = 8_000_000
#: Windows of the items (rows of the index) up to this many are joined by broadcast.
INDEX_BROADCAST = 200_000
#: Items whose windows calibrate the number of repetitions, edits tried per kind and position, and the most repetitions.
CALIBRATION_ITEMS = 200
TRIALS = 40
MOST_REPETITIONS = 256
_PAD = np.uint64(0x5851F42D4C957F2D)


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits in the lower-cased text."""
    return WORD.findall(text.lower()) if text else []


class _Hasher(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def all(self, words: list[str]) -> np.ndarray:
        return np.fromiter((self[w] for w in words), np.uint64, len(words))


def walk(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int, wanted: np.ndarray) -> np.ndarray:
    """CGK random walk over windows; the symbols at the wanted steps, one row per window.

    Each step writes the symbol under the pointer and moves the pointer on or
    not by a random bit of (symbol, step).  Two windows at edit distance k meet again
    soon after an edit, so their outputs differ in few places.
    """
    out = np.empty((len(starts), len(wanted)), np.uint64)
    place = {int(j): i for i, j in enumerate(wanted)}
    at = starts.copy()
    padded = np.append(symbols, _PAD)
    for j in range(int(wanted.max()) + 1):
        if j % 64 == 0:
            coins = mix(padded + np.uint64((seed * 2_654_435_761 + j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        i = np.where(at < ends, at, len(symbols))
        if j in place:
            out[:, place[j]] = padded[i]
        at += ((coins[i] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)
    return out


def _keys(symbols, starts, ends, m: int, sample: int, seed: int) -> np.ndarray:
    """The keys of windows of m words in one repetition: hashes of sampled places of their walks."""
    steps = 2 * m  # a walk moves at every other step, so later ones would write the padding only
    wanted = np.sort(np.random.default_rng([1000 + seed, m]).choice(steps, min(sample, steps), replace=False))
    s = walk(symbols, starts, ends, seed, wanted)
    key = np.full(len(starts), np.uint64(seed * 1_000_003 + m))
    for c in range(s.shape[1]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, c])
    return key


def within(a: list[str], b: list[str], most: int) -> bool:
    """Whether some prefix of b lies within ``most`` word edits of a (banded, exact)."""
    if most == 0:
        return a == b[: len(a)]
    inf = most + 1
    row = {j: j for j in range(min(most, len(b)) + 1)}
    for i in range(1, len(a) + 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            best = row.get(j, inf) + 1
            if j:
                best = min(best, row.get(j - 1, inf) + (a[i - 1] != b[j - 1]), new.get(j - 1, inf) + 1)
            new[j] = best
        row = new
        if min(row.values(), default=inf) > most:
            return False
    return min(row.values(), default=inf) <= most


def _edited(words: np.ndarray, edits: list[tuple[int, int]], rng) -> np.ndarray:
    """words after edits (kind, place) of kinds change, delete, insert, followed by words that belong to nobody."""
    out = list(words)
    for kind, at in sorted(edits, key=lambda e: -e[1]):
        fresh = np.uint64(rng.integers(1, 2**62))
        if kind == 0:
            out[at] = fresh
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, fresh)
    return np.concatenate([np.array(out, np.uint64), rng.integers(1, 2**62, len(words)).astype(np.uint64)])


def repetitions(windows: list[np.ndarray], max_edits: int, sample: int, recall: float) -> int:
    """The least number of repetitions whose recall is reached for the worst kind and place of an edit.

    Every kind of edit is tried at every place of the windows, together with max_edits - 1 others at random, in TRIALS windows
    each, and with other words behind; the repetitions are those that the search runs, one after another.
    """
    if not max_edits or not windows:
        return 1
    rng = np.random.default_rng(7)
    parts, group, width, alike = [], [], [], len({len(w) for w in windows}) == 1
    for n, w in enumerate(windows):
        m = len(w)
        for kind in range(3):
            for at in range(m):
                for _ in range(max(1, -(-TRIALS // len(windows)))):
                    others = rng.choice([p for p in range(m) if p != at], min(max_edits - 1, m - 1), replace=False).tolist()
                    parts += [w, _edited(w, [(kind, at), *((int(rng.integers(3)), p) for p in others)], rng)]
                    group.append((kind, at if alike else (10 * at) // m))
                    width.append(m)
    symbols = np.concatenate(parts)
    first = np.cumsum([0] + [len(p) for p in parts[:-1]])
    group, width = np.unique(np.array(group), axis=0, return_inverse=True)[1], np.array(width)
    met = np.zeros(len(group), bool)
    for seed in range(MOST_REPETITIONS):
        for m in np.unique(width):
            some = np.flatnonzero((width == m) & ~met)
            if len(some):
                a, b = first[2 * some], first[2 * some + 1]
                met[some] = _keys(symbols, a, a + m, m, sample, seed) == _keys(symbols, b, b + m, m, sample, seed)
        if min(np.bincount(group, met) / np.bincount(group)) >= recall:
            break
    return seed + 1


def _windows(words: int, window: int | None, edits: int) -> list[tuple[int, int]]:
    """(start, length) of an item's windows; the item itself where the window is as long as the item."""
    if window is None:
        return [(0, words)] if words > 2 * edits else []
    return [(q, window) for q in range(words - window + 1)]


def _indexer(window: int | None, edits: int, sample: int, reps: int):
    """One row per window and repetition: key, length, words, item."""

    def index(batches):
        hasher = _Hasher()
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                own = _windows(len(words), window, edits)
                if own:
                    symbols, starts, m = hasher.all(words), np.array([q for q, _ in own], np.int64), own[0][1]
                    keys = np.stack([_keys(symbols, starts, starts + m, m, sample, r) for r in range(reps)]).view(np.int64)
                    for n, q in enumerate(starts.tolist()):
                        passage = " ".join(words[q : q + m])
                        rows += [(k, m, passage, item) for k in set(keys[:, n].tolist())]
            cols = list(zip(*rows)) or [()] * 4
            types = [pa.int64(), pa.int32(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["key", "m", "passage", "item_id"])

    return index


_held: dict[tuple[str, ...], np.ndarray] = {}


def _block_keys(paths: tuple[str, ...]) -> np.ndarray:
    """The sorted keys of a block, read from the shared folder once per worker."""
    if paths not in _held:
        _held.clear()
        _held[paths] = np.unique(np.concatenate([open_shared(p).read(columns=["key"]).column("key").to_numpy() for p in paths]) if paths else np.zeros(0, np.int64))
    return _held[paths]


def _finder(paths: tuple[str, ...], lengths: list[int], edits: int, sample: int, reps: int):
    """Windows of documents whose key is among the items' keys of a block."""

    def find_block(block, keys, rows):
        symbols = np.concatenate([h for _, _, h in block])
        lens = np.array([len(h) for _, _, h in block])
        base = np.cumsum(lens) - lens
        for m in lengths:
            counts = np.maximum(0, lens - max(1, m - edits) + 1)
            doc = np.repeat(np.arange(len(block)), counts)
            local = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            starts = base[doc] + local
            ends = np.minimum(starts + m, (base + lens)[doc])
            for r in range(reps):
                key = _keys(symbols, starts, ends, m, sample, r).view(np.int64)
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                for w in np.flatnonzero(keys[at] == key).tolist():
                    n, words, _ = block[doc[w]]
                    p = int(local[w])
                    rows.add((int(key[w]), n, " ".join(words[p : p + m + edits])))

    def find(batches):
        hasher, keys = _Hasher(), _block_keys(paths)
        for batch in batches:
            rows: set = set()
            block, size = [], 0
            for n, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                if words and len(keys):
                    block.append((n, words, hasher.all(words)))
                    size += len(words)
                if size > 200_000:
                    find_block(block, keys, rows)
                    block, size = [], 0
            if block:
                find_block(block, keys, rows)
            cols = list(zip(*rows)) or [()] * 3
            types = [pa.int64(), pa.int64(), pa.string()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["key", "doc_id", "found"])
            yield from (out.slice(i, 20_000) for i in range(0, max(1, out.num_rows), 20_000))

    return find


def _verifier(edits: int):
    def verify(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("passage").to_pylist(), batch.column("found").to_pylist()):
                a, b = a.split(" "), b.split(" ")
                # words that the found window lacks altogether each take an edit
                keep.append(len(set(a).difference(b)) <= edits and within(a, b, edits))
            yield batch.select(["doc_id", "item_id"]).filter(pa.array(keep, pa.bool_()))

    return verify


def leaked_items(
    documents: DataFrame, items: DataFrame, window: int | None = 13, max_edits: int = 0, sample: int | None = None, recall: float = 0.95
) -> DataFrame:
    """Each document with each item of which it holds a window, up to ``max_edits`` word edits.

    window: the words of a window, every one of an item being searched; None for windows as long as each item, so that the whole
    item is searched.  Every window of the items and of the documents is embedded by
    the CGK walk, which turns word edits into few differing places; ``sample`` places make a key.
    The number of repetitions is the least that reaches ``recall`` for the worst kind and place of an edit (``repetitions``), on
    the windows of up to CALIBRATION_ITEMS items; unedited windows always meet, so without edits one repetition has recall 1.
    The items' keys are a table in the shared folder.  The workers read BLOCK_KEYS of them at a time and pass over the corpus
    once per block, without a shuffle of texts; only windows with a known key go on, join the
    table on the key, and are verified by edit distance on the words.  Nothing of it is held by the driver.

    Defined cases: null and empty texts and items shorter than the window have no
    match, nor has, with ``window`` None, an item of at most 2 * max_edits words; null ids are left out; a row delivered twice
    counts once; an empty table gives no rows; items of equal text are each reported; other columns are ignored.
    Result: ``doc_id``, ``item_id``.
    """
    spark = documents.sparkSession
    ship(spark)
    scratch = Scratch(spark, "leakage")
    sample = sample or {0: 12, 1: 8}.get(max_edits, 4)
    held = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    reps = 1
    if max_edits:
        some = [words_of(r["text"]) for r in held.orderBy(F.xxhash64("item_id"), "item_id").limit(CALIBRATION_ITEMS).collect()]
        hasher, rng = _Hasher(), np.random.default_rng(5)
        cut = [(w, own[rng.integers(len(own))]) for w in some if (own := _windows(len(w), window, max_edits))]
        reps = repetitions([hasher.all(w[q : q + m]) for w, (q, m) in cut][: max(20, TRIALS)], max_edits, sample, recall)
    index = scratch.save(held.mapInArrow(_indexer(window, max_edits, sample, reps), "key long, m int, passage string, item_id long"), "index")
    rows = index.count()
    lengths = sorted(r["m"] for r in index.select("m").distinct().collect())  # at most the words of the longest item
    blocks = max(1, -(-rows // BLOCK_KEYS))
    docs = spread(documents.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    hits = None
    for b in range(blocks):
        part = scratch.save(index.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).select("key"), "keys")
        found = docs.mapInArrow(_finder(tuple(sorted(part.inputFiles())), lengths, max_edits, sample, reps), "key long, doc_id long, found string")
        hits = found if hits is None else hits.unionByName(found)
    met = hits.join(F.broadcast(index) if rows <= INDEX_BROADCAST else index, "key")
    return met.select("passage", "found", "doc_id", "item_id").mapInArrow(_verifier(max_edits), "doc_id long, item_id long").distinct()
