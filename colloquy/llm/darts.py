"""Near-duplicate records with small edits: DartMinHash signatures, banded join, exact check.

Darts are thrown into the (weight, rank) half-plane of every element.  The plane
is cut into cells; how many darts lie in a cell and where is a hash of element,
cell and number, so every record that holds the element sees the same darts.  A
record keeps an element's darts below the weight it gives it; each dart names one of k
coordinates, and the dart of least rank per coordinate is the signature.  Two
records agree on a coordinate with the probability of their weighted
Jaccard similarity.  A record needs about k (ln k + 3) darts, whatever its size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import ceil, lgamma, log, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_unique
from ..session import Scratch

_FAR = np.uint32(2**32 - 1)
_RANKS = np.concatenate([[0.0], 0.25 * np.sqrt(2.0) ** np.arange(120)])
_WEIGHTS = 2.0 ** np.arange(24) - 1
#: Words in at least 1/COMMON of the records are ordered by their count in the exact join, the rest by hash alone;
#: their number is at most COMMON times the mean words of a record.
COMMON = 1000
#: Words of records signed together, and entries of the table of least darts per word, which bound a worker's memory.
WORDS_AT_ONCE = 60_000
TABLE = 6_000_000
#: Words whose hashes a worker remembers.
REMEMBERED = 100_000
#: Copies up to this many are taken out by a broadcast of their ids, more by a shuffled anti join.
COPIES_BROADCAST = 200_000
#: Members of a bucket compared with each other, 2 * 10^8 pairs at most; a larger bucket goes to the exact join on rare words, without loss.
BUCKET = 20_000
#: Pairs formed at once, and postings per task of the banded join.
PAIRS_AT_ONCE = 1_000_000
POSTINGS_PER_TASK = 400_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _poisson_steps(mean: float) -> np.ndarray:
    """P(count <= i) for i = 0, 1, ..; in logarithms, so no mean underflows."""
    reach = 9 * sqrt(mean) + 30
    lo, hi = max(0, int(mean - reach)), int(mean + reach)
    steps = np.cumsum([np.exp(i * log(mean) - mean - lgamma(i + 1)) for i in range(lo, hi)])
    return np.concatenate([np.zeros(lo), np.minimum(steps, 1.0)])


@dataclass(frozen=True)
class Bands:
    """bands keys of rows coordinates each; a pair of similarity s shares a key with 1-(1-s^rows)^bands.

    ``least`` chooses them: rows grow with the logarithm of the number of records, so that a
    bucket keeps about as many unlike records at every size, and bands follow so that the recall at
    the threshold stays the same.
    """

    bands: int
    rows: int

    @property
    def k(self) -> int:
        return self.bands * self.rows

    @classmethod
    def least(cls, records: int, threshold: float, recall: float = 0.995, alike: float = 0.12, partners: int = 100) -> Bands:
        """alike: the similarity of unlike records, as a mean of high powers; partners: how many of them a bucket may hold."""
        rows = max(4, ceil(log(max(1.0, records / partners)) / -log(alike)))
        return cls(ceil(log(1 - recall) / log(1 - threshold**rows)), rows)


def _darts(words: np.ndarray, weight: np.ndarray, cells: int, k: int):
    """Darts of the elements in the first rank cells: element, rank, coordinate."""
    at, rank, coord = [], [], []
    for b in range(cells):
        r0, r1 = _RANKS[b], _RANKS[b + 1]
        for a in range(len(_WEIGHTS) - 1):
            w0, w1 = _WEIGHTS[a], _WEIGHTS[a + 1]
            some = np.flatnonzero(weight > w0)
            if not len(some):
                break
            cell = mix(words[some] + np.uint64((a * 1009 + b + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            n = np.searchsorted(_poisson_steps((w1 - w0) * (r1 - r0)), _unit(cell), side="right")
            el = np.repeat(np.arange(len(some)), n)
            nth = np.arange(len(el)) - np.repeat(np.cumsum(n) - n, n)
            h = mix(cell[el] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
            pos = w0 + (w1 - w0) * _unit(h)
            inside = pos < weight[some][el]
            el, h = el[inside], mix(h[inside] + np.uint64(0x8CB92BA72F3D8DD7))
            at.append(some[el])
            rank.append(r0 + (r1 - r0) * _unit(h))
            coord.append((mix(h + np.uint64(0xA24BAED4963EE407)) % np.uint64(k)).astype(np.int64))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    # positive floats keep their order as integers
    return np.concatenate(at), np.concatenate(rank).astype(np.float32).view(np.uint32), np.concatenate(coord)


def _least_darts(words: np.ndarray, weight: np.ndarray, cells: int, k: int) -> np.ndarray:
    """Per element its earliest dart at every coordinate, and a last row without darts."""
    out = np.full((len(words) + 1, k), _FAR)
    el, rank, coord = _darts(words, weight, cells, k)
    np.minimum.at(out.reshape(-1), el * k + coord, rank)
    return out


def _sign(words: np.ndarray, weight: np.ndarray, inv: np.ndarray, offsets: np.ndarray, docs: np.ndarray, cells: int, sig: np.ndarray) -> None:
    """Signatures of ``docs`` from the darts of the first rank cells."""
    k = sig.shape[1]
    span = max(1, TABLE // k)
    if len(words) > span:  # few and long records: their words in turns
        for lo in range(0, len(words), span):
            table = _least_darts(words[lo : lo + span], weight[lo : lo + span], cells, k)
            for d in docs.tolist():
                mine = inv[offsets[d] : offsets[d + 1]] - lo
                mine = mine[(mine >= 0) & (mine < span)]
                for at in range(0, len(mine), span):
                    np.minimum(sig[d], table[mine[at : at + span]].min(axis=0), out=sig[d])
        return
    table = _least_darts(words, weight, cells, k)
    size = offsets[docs + 1] - offsets[docs]
    order = np.argsort(size, kind="stable")
    docs, size = docs[order], size[order]
    at = 0
    while at < len(docs):
        n = max(1, 2_000_000 // (k * int(size[min(len(docs) - 1, at + 63)])))
        part, many = docs[at : at + n], size[at : at + n]
        idx = np.full((len(part), int(many[-1])), len(words))
        idx[np.arange(idx.shape[1]) < many[:, None]] = inv[np.repeat(offsets[part] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        sig[part] = table[idx].min(axis=1)
        at += n


def signatures(values: np.ndarray, offsets: np.ndarray, weights: Callable[[np.ndarray], np.ndarray] | None, k: int) -> np.ndarray:
    """k earliest darts of every set values[offsets[i]:offsets[i+1]]; an empty set keeps the greatest code.

    weights: of the distinct elements; None gives each element the weight 1.
    """
    n = len(offsets) - 1
    sig = np.full((n, k), _FAR)
    part = np.zeros(n, np.int64) if not n else (offsets[1:] - 1) // WORDS_AT_ONCE
    for p in np.unique(part):
        here = np.flatnonzero(part == p)
        lo, hi = offsets[here[0]], offsets[here[-1] + 1]
        words, inv = np.unique(values[lo:hi], return_inverse=True)
        if not len(words):
            continue
        weight = np.ones(len(words)) if weights is None else weights(words)
        own = offsets[here[0] : here[-1] + 2] - lo
        heavy = np.concatenate([[0.0], np.cumsum(weight[inv])])
        total = heavy[own[1:]] - heavy[own[:-1]]
        cells = np.searchsorted(_RANKS, k * (log(k) + 3) / np.maximum(total, 1e-9))
        out = np.full((len(here), k), _FAR)
        todo = np.flatnonzero(np.diff(own) > 0)
        while len(todo):
            # nearly all records need about as many cells; the few light ones get theirs in a later throw
            level = int(max(np.percentile(cells[todo], 95), cells[todo].min()))
            docs, later = todo[cells[todo] <= level], todo[cells[todo] > level]
            if len(docs) * 4 < len(here):  # only the words of these few
                some = np.unique(inv[np.concatenate([np.arange(own[d], own[d + 1]) for d in docs])])
                local = np.zeros(len(words), np.int64)
                local[some] = np.arange(len(some))
                _sign(words[some], weight[some], local[inv], own, docs, level, out)
            else:
                _sign(words, weight, inv, own, docs, level, out)
            unmet = docs[(out[docs] == _FAR).any(axis=1)]
            cells[unmet] += 2
            todo = np.concatenate([later, unmet])
        sig[here] = out
    return sig


_PLAIN = bytes(c if 48 <= c < 58 or 97 <= c < 123 else 32 for c in range(256))


def word_set(text: str | None) -> set[bytes]:
    """The distinct runs of a-z and 0-9 in the lower-cased text."""
    return set(text.lower().encode("utf-8", "replace").translate(_PLAIN).split()) if text else set()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def sets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        values, offsets = [], [0]
        for t in texts:
            values += map(self.__getitem__, word_set(t))
            offsets.append(len(values))
        return np.array(values, np.uint64), np.array(offsets, np.int64)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _fingerprints(batches):
    """Two sums of hashed words and their number; records without words go."""
    hashes = _Hashes()
    for batch in batches:
        values, offsets = hashes.sets(batch.column("text").to_pylist())
        h0, h1 = (_sums(mix(values ^ np.uint64(c)), offsets).view(np.int64) for c in (0x9FB21C651E98DF25, 0xC13FA9A902A6328F))
        size = np.diff(offsets)
        out = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(h0), pa.array(h1), pa.array(size.astype(np.int32))], ["id", "h0", "h1", "n"])
        yield out.filter(pa.array(size > 0))


def _parities(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two 64-bit maps of every set: bit j is the parity of the words hashed to j.

    The maps of two sets differ in at most as many bits as there are words in one of them only.
    """
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    bit = (mix(values ^ np.uint64(0x5BD1E9955BD1E995)) & np.uint64(127)).astype(np.int64)
    odd = (np.bincount(owner * 128 + bit, minlength=n * 128) & 1).astype(np.uint8).reshape(n, 128)
    return np.packbits(odd, axis=1).view(np.int64).reshape(n, 2)


_N_BITS = 24


def _poster(bands: Bands):
    """Of every record one posting per band: band, 32 bits of its key and the size in one number; id; parity maps."""

    def post(batches):
        hashes = _Hashes()
        for batch in batches:
            values, offsets = hashes.sets(batch.column("text").to_pylist())
            sig = signatures(values, offsets, None, bands.k)
            some = np.flatnonzero(np.diff(offsets) > 0)
            maps, size = _parities(values, offsets)[some], np.minimum(np.diff(offsets)[some], 2**_N_BITS - 1)
            coords = sig[some].astype(np.uint64).reshape(len(some), bands.bands, bands.rows)
            key = np.zeros(coords.shape[:2], np.uint64)
            for r in range(bands.rows):
                key = mix(key * np.uint64(3) + coords[:, :, r])
            packed = (np.arange(bands.bands, dtype=np.int64) << 56)[None, :] | ((key >> np.uint64(32)).astype(np.int64) << _N_BITS) | size[:, None]
            ids = np.repeat(batch.column("id").to_numpy()[some], bands.bands)
            maps = np.repeat(maps, bands.bands, axis=0)
            out = pa.RecordBatch.from_arrays([pa.array(packed.ravel()), pa.array(ids), pa.array(maps[:, 0].copy()), pa.array(maps[:, 1].copy())], ["p", "id", "s0", "s1"])
            yield from (out.slice(i, 50_000) for i in range(0, out.num_rows, 50_000))

    return post


def _bucket_pairs(threshold: float):
    """Pairs of every bucket in a partition sorted by key; members of a bucket above BUCKET go on one by one, with b = null.

    Only pairs that cannot reach the threshold are left out: by their sizes, and because n1 + n2 words
    of which more than (1 - t) / (1 + t) stand in one record only have too few in common.
    """
    apart = (1 - threshold) / (1 + threshold)

    def pairs(p, ids, s0, s1, starts, ends):
        partners = np.repeat(ends, ends - starts) - np.arange(starts[0], ends[-1]) - 1 if len(starts) else np.zeros(0, np.int64)
        base, done = (starts[0] if len(starts) else 0), np.concatenate([[0], np.cumsum(partners)])
        at = 0
        while at < len(partners):
            upto = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS_AT_ONCE, side="right")) - 1)
            c = partners[at:upto]
            left = np.repeat(np.arange(at, upto), c)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(c) - c, c)
            left, right = left + base, right + base
            bits = np.bitwise_count(s0[left] ^ s0[right]) + np.bitwise_count(s1[left] ^ s1[right])
            n, m = (p[x] & (2**_N_BITS - 1) for x in (left, right))
            fine = (bits <= (n + m) * apart + 1e-9) & (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9) & (ids[left] != ids[right])
            a, b = ids[left[fine]], ids[right[fine]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
            at = upto

    state: list = [None, None]  # the open group, and the key of an open group already known to be large

    def group(p, ids, s0, s1, last):
        key = p >> _N_BITS
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(p) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(p)) if len(p) else starts
        size = ends - starts
        large = size > BUCKET
        if len(starts) and state[1] is not None and key[0] == state[1]:
            large[0] = True
        closed = np.ones(len(starts), bool)
        if len(starts) and not last:
            closed[-1] = large[-1]
            state[1] = key[-1] if large[-1] else None
            state[0] = None if large[-1] else [c[starts[-1] :] for c in (p, ids, s0, s1)]
        else:
            state[0] = None
        for i in np.flatnonzero(large):
            members = ids[starts[i] : ends[i]]
            yield pa.RecordBatch.from_arrays([pa.array(members), pa.nulls(len(members), pa.int64())], ["a", "b"])
        plain = np.flatnonzero(closed & ~large & (size > 1))
        if len(plain):
            keep = np.concatenate([np.arange(starts[i], ends[i]) for i in plain])
            ends2 = np.cumsum(size[plain])
            yield from pairs(p[keep], ids[keep], s0[keep], s1[keep], ends2 - size[plain], ends2)

    def run(batches):
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            cols[2:] = [c.view(np.uint64) for c in cols[2:]]
            if state[0] is not None:
                cols = [np.concatenate(x) for x in zip(state[0], cols)]
            yield from group(*cols, last=False)
        if state[0] is not None:
            yield from group(*state[0], last=True)

    return run


def _count_words(batches):
    hashes = _Hashes()
    for batch in batches:
        w, n = np.unique(hashes.sets(batch.column("text").to_pylist())[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], ["w", "n"])


def _prefixer(common: np.ndarray, count: np.ndarray, threshold: float):
    """The rarest words of every record, as many as a partner at the threshold cannot all lack, with their place."""

    def rarest(batches):
        hashes = _Hashes()
        for batch in batches:
            values, offsets = hashes.sets(batch.column("text").to_pylist())
            at = np.minimum(np.searchsorted(common, values), max(0, len(common) - 1))
            often = np.where(common[at] == values, count[at], 0) if len(common) else np.zeros(len(values), np.int64)
            size = np.diff(offsets)
            owner = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((values, often, owner))
            place = np.arange(len(values)) - np.repeat(offsets[:-1], size)
            keep = place < (size - np.ceil(threshold * size - 1e-9) + 1)[owner]
            word, owner, place, maps = values[order][keep], owner[keep], place[keep], _parities(values, offsets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(word.view(np.int64)), batch.column("id").take(pa.array(owner)), pa.array(size[owner].astype(np.int32)), pa.array(place.astype(np.int32)),
                 pa.array(maps[owner, 0]), pa.array(maps[owner, 1])], ["w", "id", "n", "place", "s0", "s1"],
            )

    return rarest


def _rare_word_pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """All pairs that can reach the threshold, found on a shared word among the rarest of both; loses none.

    Left out are only pairs whose sizes, parity maps, or words that remain from the shared one on, rule the threshold out.
    """
    total = texts.count()
    counted = texts.select("text").mapInArrow(_count_words, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    stats = counted.filter(F.col("n") >= max(2, total // COMMON)).toPandas()  # at most COMMON times the mean words of a record
    common = stats["w"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(common)
    posts = texts.mapInArrow(_prefixer(common[order], stats["n"].to_numpy().astype(np.int64)[order], threshold), "w long, id long, n int, place int, s0 long, s1 long")
    l, r = posts.alias("l"), posts.alias("r")
    both = F.col("l.n") + F.col("r.n")
    near_size = F.least("l.n", "r.n") >= F.greatest("l.n", "r.n") * F.lit(threshold) - 1e-9
    enough = F.least(F.col("l.n") - F.col("l.place"), F.col("r.n") - F.col("r.place")) >= both * F.lit(threshold / (1 + threshold)) - 1e-9
    apart = F.bit_count(F.col("l.s0").bitwiseXOR(F.col("r.s0"))) + F.bit_count(F.col("l.s1").bitwiseXOR(F.col("r.s1")))
    met = l.join(r, (F.col("l.w") == F.col("r.w")) & (F.col("l.id") < F.col("r.id")) & near_size & enough & (apart <= both * F.lit((1 - threshold) / (1 + threshold)) + 1e-9))
    return met.select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()


def _verifier(threshold: float):
    def verify(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist()):
                a, b = word_set(a), word_set(b)
                both = len(a & b)
                keep.append(both > 0 and both >= threshold * (len(a) + len(b) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def near_duplicates(
    records: DataFrame, id: str, fields: Sequence[str], threshold: float = 0.8, bands: Bands | None = None, exact: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Pairs of class representatives at or above the similarity, and the members of the classes.

    The words of a record are the distinct runs of a-z and 0-9 in its lower-cased
    fields together, null as empty; similarity is common words over all words, so every
    word weighs 1 and the darts' agreement is this similarity.
    Records with the same words form a class named by its least id; copies
    are found by one aggregate and never compared.  Representatives get
    DartMinHash signatures and meet in banded keys, sorted by one shuffle; a bucket's pairs are formed as a
    stream and must agree on their sizes and parity maps, two bounds that no pair at the threshold fails.
    A bucket of more than BUCKET members is not squared: its members meet on shared words among
    their rarest, which loses nothing either.  What is left is checked exactly on the texts.
    The only loss is of pairs without a common key, 1-recall at the threshold and less above it (``bands``, by
    default ``Bands.least``).  ``exact`` leaves out the bands and lets all representatives meet on their
    rarest words: no loss, at the cost of more candidates.  Runs eagerly up to the candidates.

    Defined cases: a record without words has no partner; a record delivered
    twice counts once (the id is the key); null ids are left out; an empty table gives
    empty results; other columns are ignored.
    Result: (left_id, right_id) of representatives, and (id, class_id) of
    the classes of two and more.
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "darts")
    text = F.concat_ws(" ", *[F.col(f) for f in fields])
    base = records.filter(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), text.alias("text"))
    prints = scratch.save(base.mapInArrow(_fingerprints, "id long, h0 long, h1 long, n int"), "prints")
    same = ["h0", "h1", "n"]
    classes = prints.groupBy(*same).agg(F.min("id").alias("class_id"), F.max("id").alias("last")).filter("class_id < last").drop("last")
    members = scratch.save(join_unique(prints, classes, same).select("id", "class_id").distinct(), "members")
    copies = members.filter("id <> class_id").select("id")
    repeated = copies.count()
    lead = base.join(F.broadcast(copies) if repeated <= COPIES_BROADCAST else copies, "id", "left_anti")
    if exact:
        met = scratch.save(_rare_word_pairs(lead, threshold), "met")
    else:
        left = prints.count() - repeated
        bands = bands or Bands.least(left, threshold)
        posts = lead.mapInArrow(_poster(bands), "p long, id long, s0 long, s1 long")
        tasks = max(spark.sparkContext.defaultParallelism, -(-left * bands.bands // POSTINGS_PER_TASK))
        key = F.shiftright("p", _N_BITS)
        found = posts.repartition(tasks, key).sortWithinPartitions(key).mapInArrow(_bucket_pairs(threshold), "a long, b long")
        met = scratch.save(found, "met")
        crowd = met.filter("b is null").select(F.col("a").alias("id"))
        pairs = met.filter("b is not null")
        if not crowd.isEmpty():
            pairs = pairs.unionByName(_rare_word_pairs(lead.join(crowd.distinct(), "id", "left_semi"), threshold))
        met = pairs.distinct()
    scratch.drop(prints)
    pairs = met.join(base.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    pairs = pairs.join(base.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    pairs = pairs.select("a", "b", "ta", "tb").mapInArrow(_verifier(threshold), "a long, b long")
    return pairs.select(F.col("a").alias("left_id"), F.col("b").alias("right_id")).distinct(), members


def all_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Every pair of different ids behind ``near_duplicates``: as many rows as there are such pairs."""
    m = members.select("id", "class_id")
    left = pairs.join(m.withColumnRenamed("class_id", "left_id"), "left_id", "left").withColumn("x", F.coalesce("id", "left_id"))
    both = left.drop("id", "left_id").join(m.withColumnRenamed("class_id", "right_id"), "right_id", "left")
    both = both.withColumn("y", F.coalesce("id", "right_id")).select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"))
    inner = m.alias("p").join(m.alias("q"), (F.col("p.class_id") == F.col("q.class_id")) & (F.col("p.id") < F.col("q.id")))
    return both.unionByName(inner.select(F.col("p.id").alias("left_id"), F.col("q.id").alias("right_id")))
