"""Near-duplicate texts: SuperMinHash, banding, verification, union-find groups.

1. Each text becomes its set of word shingles, and the set a fingerprint; copies have equal ones.
2. Each set's SuperMinHash signature is cut into bands. A task gathers (band key, fingerprint) by
   bucket of keys, so that the shuffle carries a few blocks of numbers instead of a row for each
   band. The task of a bucket sorts them; sets that agree in a band are candidates.
3. A key that many sets share is split: a task that meets it often sends its sets on as rows and a
   mark to the key's bucket, which does the same with what others sent. Those rows are compared
   block by block, each block pair being a join key of its own.
4. Only texts of sets with a candidate or a copy are turned into sets again; a Bloom filter of
   bounded size over text hashes finds them. The exact similarity of candidates is computed.
5. Pairs of sets are expanded to pairs of spans at the very end; groups are the connected components
   of the pairs of sets, carried over to their members.

With 4 rows in each of 36 bands, a pair at the bound of 0.6 is missed with probability 0.007, one
at 0.7 with 0.00005. ``exact`` takes the least elements of each set for keys instead, so many that
two sets alike enough share one: nothing is missed, but frequent shingles make many candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.arrow import arrow_schema
from spanloom.functions.bloom import Bloom, build_bloom
from spanloom.functions.hashing import WordHasher, distinct_by_text, mix, set_hashes, shingles
from spanloom.functions.text import decode
from spanloom.llm.superminhash import band_keys, signatures
from spanloom.operators.components import components
from spanloom.operators.parallel import spread
from spanloom.storage import store

_CHUNK_BYTES = 150_000
_FLUSH = 1_000_000  # pairs of key and fingerprint that a task gathers before it sends them on
_GATHER = 4_000_000  # pairs that the task of a bucket holds before it takes out what is frequent
_BUCKET_BYTES = 1_000_000
_MOST_BUCKETS = 1 << 20
_MEMBER = "trace_id string, span_id string, at long, fp long, elements array<long>"
_BLOCK = "bucket int, keys binary, sets binary, x array<long>, y array<long>"
_MET = "kind string, x long, y long"


@dataclass(frozen=True)
class Options:
    shingle: int = 3
    least_words: int = 30
    similarity: str = "0.6"
    rows: int = 4
    bands: int = 36
    block: int = 256
    exact: bool = False


def _sets(texts: list[bytes | None], hasher: WordHasher, o: Options) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Elements, their texts, each text's fingerprint, and which texts count."""
    hashes, counts = hasher.of_texts([decode(t) for t in texts])
    h, text, _ = shingles(hashes, counts, o.shingle)
    enough = (counts >= max(o.least_words, o.shingle))[text]
    elements, owner = distinct_by_text(h[enough], text[enough])
    return elements, owner, set_hashes(elements, owner, len(texts)), counts >= max(o.least_words, o.shingle)


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts are of bounded size, but for single long ones."""
    for batch in batches:
        sizes = np.cumsum([len(t) if t is not None else 0 for t in batch.column(column).to_pylist()])
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            past = max(start + 1, int(np.searchsorted(sizes, base + _CHUNK_BYTES, "right")))
            yield batch.slice(start, past - start)
            start = past


def _keys(elements: np.ndarray, owner: np.ndarray, fps: np.ndarray, o: Options) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sets, each with its set's fingerprint."""
    if not o.exact:
        keys = band_keys(signatures(elements, owner, len(fps), o.rows * o.bands), o.rows)
        return keys.reshape(-1), np.repeat(fps, o.bands)
    # of sets alike enough, the least elements that one can miss and still be so are not all missed by the other
    share = Fraction(o.similarity)
    sizes = np.bincount(owner, minlength=len(fps))
    place = np.arange(len(elements)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    needed = -((-sizes * share.numerator) // share.denominator)
    least = place <= (sizes - needed)[owner]
    return mix(elements[least]), fps[owner[least]]


def _by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of keys by bucket, the buckets that occur, and where each begins and ends."""
    bucket = (mix(keys) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    return order, found, first, np.append(first[1:], len(keys))


def _emit_keys(o: Options, buckets: int):
    """Blocks of (key, fingerprint) by bucket, and the distinct texts of each fingerprint with their number.

    ``x``, ``y`` of a block without ``keys``: fingerprint, then text and number in turn. Of buckets
    below 0: keys that this task found frequent, with fingerprint. Of the others ``x``: such keys.
    """
    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("sets", pa.binary()), ("x", pa.list_(pa.int64())), ("y", pa.list_(pa.int64()))])

    def blocks(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        keys, fps = (np.concatenate(c) for c in zip(*parts))
        distinct, times = np.unique(keys, return_counts=True)
        frequent = distinct[times > o.block]
        marks: dict[int, list[int]] = {}
        rows: list[tuple] = []
        if len(frequent):
            often = np.isin(keys, frequent)
            rows += [(-1 - int(fps[often][i] % np.uint64(buckets)), None, None, keys[often][i : i + 50_000].view(np.int64), fps[often][i : i + 50_000].view(np.int64)) for i in range(0, int(often.sum()), 50_000)]
            for k in frequent:
                marks.setdefault(int(mix(np.array([k]))[0] % np.uint64(buckets)), []).append(int(np.array([k]).view(np.int64)[0]))
            keys, fps = keys[~often], fps[~often]
        order, found, first, past = _by_bucket(keys, buckets)
        keys, fps = keys[order], fps[order]
        rows += [(int(b), keys[i:j].tobytes(), fps[i:j].tobytes(), marks.pop(int(b), None), None) for b, i, j in zip(found, first, past)]
        rows += [(b, b"", b"", x, None) for b, x in marks.items()]
        for i in range(0, len(rows), 1_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 1_000]), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen, held, parts = WordHasher(), {}, 0, []
        copies: dict[tuple[int, int], int] = {}
        for batch in _chunks(batches, 0):
            elements, owner, fps, counted = _sets(batch.column(0).to_pylist(), hasher, o)
            texts = batch.column(1).to_numpy()
            fresh = np.zeros(len(fps), bool)
            for i in np.flatnonzero(counted):
                fp = int(fps[i])
                fresh[i] = fp not in seen
                seen[fp] = None
                copy = (fp, int(texts[i]))
                copies[copy] = copies.get(copy, 0) + 1
            if not fresh.any():
                continue
            number = np.cumsum(fresh) - 1
            mine = fresh[owner]
            parts.append(_keys(elements[mine], number[owner[mine]], fps[fresh], o))
            held += len(parts[-1][0])
            if held >= _FLUSH:
                yield from blocks(parts)
                parts, held = [], 0
        yield from blocks(parts)
        # of each set its texts, by bucket of fingerprints
        if copies:
            fp, text = np.array([c[0] for c in copies], np.uint64), np.array([c[1] for c in copies], np.int64)
            n = np.fromiter(copies.values(), np.int64, len(copies))
            order, found, first, past = _by_bucket(fp, buckets)
            fp, pairs = fp[order].view(np.int64), np.stack([text[order], n[order]], axis=1)
            rows = [(int(b), None, None, fp[i:j], pairs[i:j].reshape(-1)) for b, i, j in zip(found, first, past)]
            for i in range(0, len(rows), 1_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 1_000]), schema)], schema=schema)

    return run


def _meet(block: int):
    """What meets in each bucket: ``pair`` of two sets; ``often`` key and set of a key with more than
    ``block`` sets; ``text`` set and a text of it; ``copied`` set with more than one text or row."""
    schema = arrow_schema(_MET)

    def rows(kind: str, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(x), 50_000):
            part = x[i : i + 50_000]
            columns = [pa.array([kind] * len(part)), pa.array(part.view(np.int64)), pa.array(y[i : i + 50_000].view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    class Bucket:
        def __init__(self) -> None:
            self.keys, self.fps, self.held = [], [], 0
            self.frequent = np.zeros(0, np.uint64)
            self.sets, self.texts = [], []

        def take_out(self) -> Iterator[pa.RecordBatch]:
            """Sends frequent keys' sets on; the others stay, sorted and each once."""
            keys, fps = np.concatenate(self.keys or [np.zeros(0, np.uint64)]), np.concatenate(self.fps or [np.zeros(0, np.uint64)])
            order = np.lexsort((fps, keys))
            keys, fps = keys[order], fps[order]
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1])
            keys, fps = keys[fresh], fps[fresh]
            distinct, times = np.unique(keys, return_counts=True)
            self.frequent = np.union1d(self.frequent, distinct[times > block])
            often = np.isin(keys, self.frequent)
            if often.any():
                yield from rows("often", keys[often], fps[often])
                keys, fps = keys[~often], fps[~often]
            self.keys, self.fps, self.held = [keys], [fps], 0

        def finish(self) -> Iterator[pa.RecordBatch]:
            yield from self.take_out()
            keys, fps = self.keys[0], self.fps[0]
            near, far = [], []
            at, step = np.arange(len(keys)), 1
            while len(at := at[at + step < len(keys)]) and len(at := at[keys[at] == keys[at + step]]):
                near.append(fps[at])  # sorted within a key, hence the lesser one
                far.append(fps[at + step])
                step += 1
            if near:
                a, b = np.concatenate(near).view(np.int64), np.concatenate(far).view(np.int64)
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield from rows("pair", pairs[0], pairs[1])
            if self.sets:
                fp, both = np.concatenate(self.sets), np.concatenate(self.texts).reshape(-1, 2)
                distinct, which = np.unique(fp, return_inverse=True)
                times = np.bincount(which, both[:, 1]).astype(np.int64)
                yield from rows("copied", distinct[times > 1], times[times > 1])
                once = np.unique(np.stack([fp, both[:, 0]]), axis=1)
                yield from rows("text", once[0], once[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bucket = None, Bucket()
        for batch in batches:
            for i in range(batch.num_rows):
                number, keys, sets, x, y = (batch.column(k)[i] for k in range(5))
                if number.as_py() != at:
                    yield from bucket.finish()
                    at, bucket = number.as_py(), Bucket()
                if at < 0:
                    yield from rows("often", x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64))
                    continue
                if not keys.is_valid:
                    bucket.sets.append(x.values.to_numpy())
                    bucket.texts.append(y.values.to_numpy())
                    continue
                if x.is_valid:
                    bucket.frequent = np.union1d(bucket.frequent, x.values.to_numpy().view(np.uint64))
                bucket.keys.append(np.frombuffer(keys.as_py(), np.uint64))
                bucket.fps.append(np.frombuffer(sets.as_py(), np.uint64))
                bucket.held += len(bucket.keys[-1])
                if bucket.held >= _GATHER:
                    yield from bucket.take_out()
        yield from bucket.finish()

    return run


def _emit_members(o: Options, wanted: Bloom):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(), set()
        schema = pa.schema([("trace_id", pa.string()), ("span_id", pa.string()), ("at", pa.int64()), ("fp", pa.int64()), ("elements", pa.list_(pa.int64()))])
        hits = (b.filter(pa.array(wanted.might_hold(b.column(4).to_numpy().view(np.uint64)))) for b in batches if b.num_rows)
        for batch in _chunks(hits, 3):
            elements, owner, fps, counted = _sets(batch.column(3).to_pylist(), hasher, o)
            hit = np.flatnonzero(counted)
            if not len(hit):
                continue
            starts = np.searchsorted(owner, np.arange(len(fps) + 1))
            lists: list[np.ndarray | None] = []
            for i in hit:
                fp = int(fps[i])
                lists.append(None if fp in seen else elements[starts[i] : starts[i + 1]].view(np.int64))
                seen.add(fp)
            rows = batch.take(pa.array(hit))
            columns = [rows.column(0), rows.column(1), rows.column(2), pa.array(fps[hit].view(np.int64)), pa.array(lists, schema.field(4).type)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _in_blocks(often: DataFrame, block: int) -> DataFrame:
    """(a, b), a < b, of every two sets that share a frequent key; its sets are split into blocks."""
    bucket = often.select("key", "fp").distinct()
    sizes = bucket.groupBy("key").agg(F.count("*").alias("m"))
    placed = (
        bucket.join(sizes, "key")
        .withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    )
    left = placed.select("key", F.col("fp").alias("x"), F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"))
    right = placed.select("key", F.col("fp").alias("y"), F.col("own").alias("j"), F.explode(F.sequence(F.lit(0), "own")).alias("i"))
    met = left.join(right, ["key", "i", "j"]).where("i < j OR x < y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


@dataclass
class NearDuplicates:
    """``pairs``: (a, b, shared, total) of different sets; ``members``: (fp, trace_id, span_id)."""

    pairs: DataFrame
    members: DataFrame

    def span_pairs(self) -> DataFrame:
        """Every pair of spans, copies included: (``span_id_a``, ``span_id_b``)."""
        m = self.members
        one = m.select(F.col("fp").alias("a"), F.col("span_id").alias("x"))
        two = m.select(F.col("fp").alias("b"), F.col("span_id").alias("y"))
        different = self.pairs.select("a", "b").join(one, "a").join(two, "b").where("x <> y").select("x", "y")
        copies = one.join(two, F.col("a") == F.col("b")).where("x < y").select("x", "y")
        both = different.unionByName(copies)
        return both.select(F.least("x", "y").alias("span_id_a"), F.greatest("x", "y").alias("span_id_b"))

    def groups(self) -> DataFrame:
        """One row per span with a partner: its group (the least span id of it) and number of links."""
        sizes = self.members.groupBy("fp").agg(F.count("*").alias("n"))
        both = self.pairs.select("a", "b").unionByName(self.pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        outer = both.join(sizes.select(F.col("fp").alias("b"), "n"), "b").groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("others"))
        linked = sizes.join(outer, "fp", "left").select("fp", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")).where("n_links > 0")
        labels = linked.join(components(self.pairs).withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "n_links", F.coalesce("component", "fp").alias("component")
        )
        rows = self.members.join(labels, "fp")
        least = rows.groupBy("component").agg(F.min("span_id").alias("group_id"))
        return rows.join(least, "component").select("trace_id", "span_id", "group_id", "n_links")


def near_duplicates(spans: DataFrame, o: Options = Options()) -> NearDuplicates:
    """Current spans whose texts (input, line feed, output) share enough of their shingles.

    Input: a delivery log of spans (see ``current_spans``); other columns are ignored. Null texts
    count as empty; texts of fewer than ``least_words`` words take no part, whole long ones do.
    Repeated rows and older versions count once, as their current version. Empty tables give no rows.
    """
    text = F.concat(F.coalesce("input_text", F.lit("")), F.lit("\n"), F.coalesce("output_text", F.lit(""))).cast("binary")
    at = F.coalesce(F.unix_micros("ingested_at"), F.lit(-(2**62)))
    key = [F.coalesce("trace_id", F.lit("\0")).alias("trace_id"), F.coalesce("span_id", F.lit("\0")).alias("span_id"), at.alias("at")]

    hashed = F.xxhash64(text)

    buckets = max(1024, min(_MOST_BUCKETS, math.ceil(spans.count() * 16 * o.bands / _BUCKET_BYTES)))
    tasks = max(int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // 32)
    blocks = spread(spans.select(text.alias("text"), hashed.alias("h"))).mapInArrow(_emit_keys(o, buckets), _BLOCK)
    met = store(blocks.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet(o.block), _MET), "met")
    often = met.df.where("kind = 'often'").select(F.col("x").alias("key"), F.col("y").alias("fp"))
    close = met.df.where("kind = 'pair'").select(F.col("x").alias("a"), F.col("y").alias("b"))
    candidates = store(close.unionByName(_in_blocks(often, o.block)).distinct(), "candidates")

    copied = met.df.where("kind = 'copied'").select(F.col("x").alias("fp"))
    wanted = candidates.df.select(F.col("a").alias("fp")).union(candidates.df.select("b")).union(copied).distinct()
    texts = store(met.df.where("kind = 'text'").select(F.col("x").alias("fp"), "y").join(wanted, "fp", "left_semi").select("y").distinct(), "wanted")
    bloom = build_bloom(texts.df, texts.df.count())
    met.drop()
    texts.drop()

    found = store(spread(spans.select(*key, text.alias("text"), hashed.alias("h"))).mapInArrow(_emit_members(o, bloom), _MEMBER), "members")
    sets = found.df.where("elements IS NOT NULL").select("fp", "elements").dropDuplicates(["fp"])
    share = Fraction(o.similarity)
    one, two = sets.select(F.col("fp").alias("a"), F.col("elements").alias("x")), sets.select(F.col("fp").alias("b"), F.col("elements").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    compared = candidates.df.join(one, "a").join(two, "b").select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y") - shared).alias("total"))
    alike = F.col("shared").cast("long") * share.denominator >= F.col("total").cast("long") * share.numerator
    pairs = store(compared.where(alike), "pairs").df
    candidates.drop()

    latest = spans.select(*key).groupBy("trace_id", "span_id").agg(F.max("at").alias("at"))
    members = found.df.select("trace_id", "span_id", "at", "fp").distinct().join(latest, ["trace_id", "span_id", "at"], "left_semi")
    members = members.select("fp", F.nullif("trace_id", F.lit("\0")).alias("trace_id"), F.nullif("span_id", F.lit("\0")).alias("span_id"))
    members = store(members, "current-members").df
    found.drop()
    return NearDuplicates(pairs, members)
