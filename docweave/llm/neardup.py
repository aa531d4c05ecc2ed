"""Near-duplicate records with small edits (problem 2): bands of min-hashes, set pivot table, exact check.

A record is the set of its word triples; the Hamming distance of two sets, as bit vectors over all
triples, is the size of their symmetric difference, so a Jaccard share of t or more is the same as a
distance of at most (1 - t) / (1 + t) times the sum of the two sizes.

1. Candidates: two sets meet when ROWS min-hashes agree in one of BANDS bands. At a share of exactly 7 tenths a
   pair misses all of them with probability (1 - 0.7**4)**50 = 1e-6, at 0.75 5e-9.
2. Pivot distance table: the numbers of triples in CLASSES classes of the triple universe. Every union of classes is
   a reference fingerprint; by the triangle inequality no coordinate difference to any of these 2**CLASSES
   references can exceed the distance of the pair, and the largest of them is the sum of the absolute
   differences of the class numbers. Pairs whose largest coordinate difference is above the allowed
   distance are discarded; this loses nothing.
3. Survivors are verified on their whole triple sets.

Pivot tables alone can't draw the candidates: distances of unlike records to any reference lie closer together
than the distance allowed to a like pair, so that their coordinates agree, and all pairs would have to be looked at.

Exact copies (equal triple sets) are one class: steps 1 to 3 run on one print of each.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.session import staged

CLASSES = 64
ROWS = 4
BANDS = 50
#: Bits of the map of classes that have candidates. Its size is fixed; when it fills up it spares less, but loses nothing.
MAP_BITS = 1 << 23
#: Members of a class that one task pairs with all others; larger classes are spread over several keys.
SPREAD = 200

_U = np.uint64
_SEEDS = np.random.default_rng(20_240_601).integers(1, 1 << 32, (BANDS * ROWS, 2), dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor and multiply)."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


class TripleSets:
    """The distinct word triples of a batch of texts: `row` (index into the batch) and 48-bit `triple`, sorted."""

    def __init__(self, texts: pa.Array, width: int = 3, least_words: int = 40):
        # not pyarrow's utf8_normalize: it gives decomposed text for NFC
        norm = pa.array(["" if x is None else unicodedata.normalize("NFC", x).lower() for x in texts.to_pylist()], pa.large_string())
        spaced = pc.utf8_trim_whitespace(pc.replace_substring_regex(norm, r"[^\pL\pN]+", " "))
        lists = pc.split_pattern(spaced, " ")
        starts = lists.offsets.to_numpy().astype(np.int64)
        words = lists.flatten().dictionary_encode()
        uniq = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.dictionary.to_pylist()), dtype=np.uint64, count=len(words.dictionary))
        codes = words.indices.to_numpy(zero_copy_only=False)
        starts = starts - starts[0]
        count = np.diff(starts)
        empty = pc.equal(pc.binary_length(spaced), 0).to_numpy(zero_copy_only=False)
        self.words = np.where(empty, 0, count)
        long = self.words >= max(least_words, width)
        row = np.repeat(np.arange(len(count)), count)
        pos = np.arange(len(codes)) - np.repeat(starts[:-1], count)
        ok = long[row] & (pos <= count[row] - width)
        at = np.flatnonzero(ok)
        h = np.zeros(len(at), dtype=np.uint64)
        for k in range(width):
            h = _mix(h * _U(0x9E3779B97F4A7C15) + uniq[codes[at + k]] + _U(k + 1))
        key = np.unique((row[at].astype(np.uint64) << _U(48)) | (h >> _U(16))) if len(at) else np.zeros(0, np.uint64)
        self.row = (key >> _U(48)).astype(np.int64)
        self.triple = key & _U((1 << 48) - 1)
        self.rows, self.first, self.size = np.unique(self.row, return_index=True, return_counts=True)

    def set_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit sums per set, the same for equal sets and for no others in practice."""
        if not len(self.rows):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        a = np.add.reduceat(_mix(self.triple), self.first)
        b = np.add.reduceat(_mix(self.triple ^ _U(0x5851F42D4C957F2D)), self.first)
        return a, b

    def band_keys(self) -> np.ndarray:
        """(sets, BANDS) 48-bit keys, made of ROWS min-hashes and the number of the band."""
        base = (self.triple ^ (self.triple >> _U(24))).astype(np.uint32)
        out = np.empty((len(self.rows), BANDS), np.int64)
        for b in range(BANDS):
            key = np.full(len(self.rows), b + 1, np.uint64)
            for a, c in _SEEDS[b * ROWS : (b + 1) * ROWS]:
                h = base * a
                h ^= h >> np.uint32(15)
                h *= c
                key = _mix(key * _U(0x9E3779B97F4A7C15) + np.minimum.reduceat(h, self.first).astype(np.uint64))
            out[:, b] = (key >> _U(16)).view(np.int64)
        return out

    def class_counts(self) -> np.ndarray:
        """(sets, CLASSES / 2) bytes: triples per class in four bits; a number above 15 counts as 15, which keeps the bound sound."""
        if not len(self.rows):
            return np.zeros((0, CLASSES // 2), np.uint8)
        at = np.repeat(np.arange(len(self.rows)), self.size) * CLASSES + (self.triple & _U(CLASSES - 1)).astype(np.int64)
        counts = np.minimum(np.bincount(at, minlength=len(self.rows) * CLASSES), 15).astype(np.uint8).reshape(-1, CLASSES)
        return counts[:, ::2] << 4 | counts[:, 1::2]


_PRINT = "id string, class long, other long, n int, counts binary"
_PRINT_ARROW = pa.schema([("id", pa.string()), ("class", pa.int64()), ("other", pa.int64()), ("n", pa.int32()), ("counts", pa.binary())])
_SLICE = 8_192  # rows per numpy pass, so that a worker's memory doesn't follow the batch size


def _slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        i = 0
        while i < batch.num_rows:
            part = batch.slice(i, _SLICE)
            while part.num_rows > 1 and part.nbytes > most_bytes:
                part = part.slice(0, part.num_rows // 2)
            yield part
            i += part.num_rows


def _id_text(records: DataFrame) -> DataFrame:
    return records.where(F.col("id").isNotNull()).select(F.col("id").cast("string"), F.col("text").cast("string"))


def fingerprints(records: DataFrame, width: int, least_words: int) -> DataFrame:
    """id, class, other (two 64-bit hashes of the triple set), n, counts of every record with at least `least_words` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            s = TripleSets(part.column("text"), width, least_words)
            if len(s.rows):
                a, b = s.set_hashes()
                ids = part.column("id").cast(pa.string()).take(pa.array(s.rows))
                counts = pa.array([x.tobytes() for x in s.class_counts()], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(s.size.astype(np.int32)), counts], schema=_PRINT_ARROW)

    return _id_text(records).mapInArrow(run, _PRINT)


def _of_new_classes(records: DataFrame, width: int, least_words: int, schema: str, make) -> DataFrame:
    """Rows that `make` gives for the sets of a batch, once for each class a task meets: copies cost a task nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in _slices(batches):
            s = TripleSets(part.column("text"), width, least_words)
            if not len(s.rows):
                continue
            classes = s.set_hashes()[0].view(np.int64)
            fresh = np.zeros(len(classes), bool)
            for i, c in enumerate(classes.tolist()):
                if c not in seen:
                    seen.add(c)
                    fresh[i] = True
            if fresh.any():
                yield make(s, classes, fresh)

    return _id_text(records).mapInArrow(run, schema)


def band_rows(records: DataFrame, width: int, least_words: int) -> DataFrame:
    """key, class and n: BANDS rows for each set."""

    def make(s: TripleSets, classes: np.ndarray, fresh: np.ndarray) -> pa.RecordBatch:
        keys = s.band_keys()[fresh]
        return pa.RecordBatch.from_arrays(
            [pa.array(keys.ravel()), pa.array(np.repeat(classes[fresh], BANDS)), pa.array(np.repeat(s.size[fresh].astype(np.int32), BANDS))], ["key", "class", "n"]
        )

    return _of_new_classes(records, width, least_words, "key long, class long, n int", make)


def class_map(classes: DataFrame) -> np.ndarray:
    """A map of MAP_BITS bits of the column `class`: combined on the map side, a fixed number of words on the driver."""
    at = F.pmod(F.col("class"), F.lit(MAP_BITS))
    words = classes.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(class, {MAP_BITS}) & 63 as int))").alias("bit"))
    t = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[t.column("word").to_numpy()] = t.column("bits").to_numpy()
    return out


def triple_sets(records: DataFrame, width: int, least_words: int, wanted: np.ndarray) -> DataFrame:
    """class and the packed triples, once a task, of every set whose class is in the map `wanted` (and of few others)."""
    shared = records.sparkSession.sparkContext.broadcast(wanted)

    def make(s: TripleSets, classes: np.ndarray, fresh: np.ndarray) -> pa.RecordBatch:
        at = classes % MAP_BITS
        fresh = fresh & ((shared.value[at >> 6] >> (at & 63)) & 1 == 1)
        packed = [s.triple[i : i + n].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for i, n in zip(s.first[fresh], s.size[fresh])]
        return pa.RecordBatch.from_arrays([pa.array(classes[fresh]), pa.array(packed, pa.binary())], ["class", "triples"])

    return _of_new_classes(records, width, least_words, "class long, triples binary", make)


def _distance_filter(threshold: float):
    @F.arrow_udf(T.BooleanType())
    def near(ca: pa.Array, cb: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
        if not len(ca):
            return pa.array([], pa.bool_())
        table = lambda c: np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, CLASSES // 2).astype(np.int16)
        x, y = table(ca), table(cb)
        far = np.abs((x >> 4) - (y >> 4)).sum(axis=1) + np.abs((x & 15) - (y & 15)).sum(axis=1)
        total = na.to_numpy(zero_copy_only=False).astype(np.float64) + nb.to_numpy(zero_copy_only=False)
        return pa.array(far <= (1 - threshold) / (1 + threshold) * total + 1e-6)

    return near


def _unpacked(sets: pa.Array) -> np.ndarray:
    """Position in the batch (upper 16 bits) and triple (lower 48) of every triple of the packed sets."""
    raw = sets.to_pylist()
    six = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 6)
    eight = np.zeros((len(six), 8), np.uint8)
    eight[:, :6] = six
    row = np.repeat(np.arange(len(raw), dtype=np.uint64), [len(x) // 6 for x in raw])
    return (row << _U(48)) | eight.view("<u8").ravel().astype(np.uint64)


def _share_check(tenths: int):
    """Verify pairs of whole triple sets: shared triples, union, and whether the share is reached."""
    kind = pa.struct([("shared", pa.int32()), ("either", pa.int32()), ("alike", pa.bool_())])

    @F.arrow_udf("shared int, either int, alike boolean")
    def check(a: pa.Array, b: pa.Array) -> pa.Array:
        shared_all, either_all = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(a), 2_048):
            x, y = a.slice(i, 2_048), b.slice(i, 2_048)
            both = np.sort(np.concatenate([_unpacked(x), _unpacked(y)]), kind="stable")
            twice = both[1:][both[1:] == both[:-1]]
            shared = np.bincount((twice >> _U(48)).astype(np.int64), minlength=len(x))
            either = np.bincount((both >> _U(48)).astype(np.int64), minlength=len(x)) - shared
            shared_all.append(shared)
            either_all.append(either)
        shared, either = np.concatenate(shared_all), np.concatenate(either_all)
        alike = (either > 0) & (10 * shared >= tenths * either)
        return pa.StructArray.from_arrays([pa.array(shared.astype(np.int32)), pa.array(either.astype(np.int32)), pa.array(alike)], fields=list(kind))

    return check


class NearDuplicates:
    """Near-duplicates among `records` (id, text): members, links and groups.

    Records of fewer than `least_words` words, null or empty texts and null ids take no part. Rows
    repeated under one id count once (if the texts of one id differ, the id stands for each of them).
    Texts of any length are read whole. An empty table gives empty results; other columns are not read.

    `members`: id and class, a class being all records with the same triple set.
    `links`: pairs of different classes (class_a < class_b) whose share is `tenths` tenths or more.

    Every step is a hash shuffle on class, band key or pair. Copies are made one class before anything
    is joined, however many there are; the join on band keys streams its two sides and leaves skewed
    keys to adaptive execution. Nothing is capped, and no candidate is dropped but by bounds that hold for
    every pair that is alike.
    """

    def __init__(self, records: DataFrame, width: int = 3, least_words: int = 40, tenths: int = 7):
        self.records, self.width, self.least_words, self.tenths = records, width, least_words, tenths
        self._prints = staged(fingerprints(records, width, least_words), "neardup-prints")
        one = self._prints.groupBy("class").agg(F.min("other").alias("low"), F.max("other").alias("high"), F.min(F.struct("n", "counts")).alias("p"))
        self.classes = staged(one.select("class", "p.n", "p.counts", (F.col("low") != F.col("high")).alias("mixed")), "neardup-classes")
        if self.classes.where("mixed").limit(1).count():
            raise ValueError("two different sets have the same 64-bit hash; the records must be split into two runs")
        self._links: DataFrame | None = None

    @property
    def members(self) -> DataFrame:
        return self._prints.select("id", "class").distinct()

    @property
    def candidates(self) -> DataFrame:
        """Pairs of classes that meet in a band, within the bounds on sizes and the pivot table."""
        rows = band_rows(self.records, self.width, self.least_words).repartition("key")
        side = lambda s: rows.select("key", F.col("class").alias(f"class_{s}"), F.col("n").alias(f"n_{s}"))
        sizes = F.expr(f"10 * least(n_a, n_b) >= {self.tenths} * greatest(n_a, n_b)")
        met = side("a").join(side("b").hint("merge"), "key").where(F.col("class_a") < F.col("class_b")).where(sizes)
        # already in the order of the next join: pairs move once
        pairs = met.select("class_a", "class_b").repartition("class_a").distinct()
        facts = self.classes.select("class", "n", "counts")
        side = lambda s: facts.select(*[F.col(c).alias(f"{c}_{s}") for c in facts.columns])
        both = pairs.join(side("a"), "class_a").join(side("b"), "class_b")
        near = _distance_filter(self.tenths / 10)
        return both.where(near("counts_a", "counts_b", "n_a", "n_b")).select("class_a", "class_b")

    @property
    def links(self) -> DataFrame:
        if self._links is None:
            cand = staged(self.candidates, "neardup-candidates")
            used = class_map(cand.select(F.explode(F.array("class_a", "class_b")).alias("class")))
            sets = triple_sets(self.records, self.width, self.least_words, used).repartition("class").dropDuplicates(["class"])
            side = lambda s: sets.select(F.col("class").alias(f"class_{s}"), F.col("triples").alias(f"triples_{s}"))
            both = cand.join(side("a"), "class_a").join(side("b"), "class_b")
            check = _share_check(self.tenths)
            done = both.select("class_a", "class_b", check("triples_a", "triples_b").alias("s")).where("s.alike")
            self._links = staged(done.select("class_a", "class_b", "s.shared", "s.either"), "neardup-links")
        return self._links

    def pairs(self) -> DataFrame:
        """id_a < id_b (by code point): every pair of records in one class or in two linked classes.

        The members of a large class are spread over several keys, and the other side is repeated for each.
        """
        linked = self.links.select(F.explode(F.array("class_a", "class_b")).alias("class")).distinct().withColumn("linked", F.lit(True))
        m = self.members
        wide = m.groupBy("class").agg(F.count("*").alias("size"))
        m = m.join(wide.join(linked, "class", "left").where("size > 1 OR linked"), "class")
        m = staged(m.select("id", "class", F.ceil(F.col("size") / SPREAD).cast("int").alias("keys")), "neardup-members")
        a = m.select(F.col("id").alias("x"), F.col("class").alias("class_a"), F.pmod(F.xxhash64("id"), F.col("keys")).cast("int").alias("salt"))
        every = lambda df, k: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col(k) - 1)))
        inside = a.join(every(m, "keys").select(F.col("id").alias("y"), F.col("class").alias("class_a"), "salt"), ["class_a", "salt"]).where("x < y").select("x", "y")
        links = self.links.select("class_a", "class_b").join(m.select(F.col("class").alias("class_a"), "keys").distinct(), "class_a")
        first = every(links, "keys").join(a, ["class_a", "salt"]).select("x", "class_b")
        across = first.join(m.select(F.col("id").alias("y"), F.col("class").alias("class_b")), "class_b").select("x", "y")
        both = inside.unionByName(across).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        return both.where("id_a < id_b").distinct()

    def groups(self) -> DataFrame:
        """id, group (smallest id of the group) and links (to other classes) of every record in a group of two or more.

        Connected components by min-label propagation with pointer jumping over the links alone: the
        labels are a table, never on the driver, and each round is written to the shared folder.
        """
        edges = self.links.select("class_a", "class_b")
        both = edges.unionByName(edges.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b")))
        labels = both.groupBy("class_a").agg(F.least(F.col("class_a"), F.min("class_b")).alias("label")).withColumnRenamed("class_a", "class")
        labels = staged(labels, "neardup-labels")
        while True:
            near = both.join(labels.withColumnRenamed("class", "class_b"), "class_b").groupBy(F.col("class_a").alias("class")).agg(F.min("label").alias("l2"))
            own = labels.join(near, "class").select("class", "label", F.least("label", "l2").alias("low"))
            jump = labels.select(F.col("class").alias("low"), F.col("label").alias("l3"))
            nxt = staged(own.join(jump, "low", "left").select("class", F.least("low", F.coalesce("l3", "low")).alias("label"), F.col("label").alias("was")), "neardup-labels")
            moved = nxt.where("label <> was").limit(1).count()
            labels = nxt.select("class", "label")
            if not moved:
                break
        degree = both.groupBy(F.col("class_a").alias("class")).agg(F.count("*").alias("n_links"))
        m = self.members.join(labels, "class", "left").join(degree, "class", "left")
        m = m.select("id", "class", F.coalesce("label", "class").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
        names = m.groupBy("label").agg(F.min("id").alias("group"), F.count("*").alias("n_members")).where("n_members > 1")
        return m.join(names, "label").select("id", "group", "n_members", "n_links")
