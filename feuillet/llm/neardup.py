"""Near-duplicate texts over a whole catalogue.

Similarity is that of Jaccard on the sets of word sequences. Two sets that reach the threshold t differ in at most
(1 - t) / (1 + t) of their joint size; that difference is the Hamming distance of their indicator fingerprints, a metric.
So the stages are: copies with one set become one class; classes that share a band of a min-hash signature are paired;
a table of Hamming distances to reference fingerprints discards pairs whose coordinates differ by more than the bound
(by the triangle inequality it can't lose one); a sketch of the fingerprints discards further; survivors are verified on
the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feuillet.llm.words import tokens
from feuillet.plans.shared import write_shared
from feuillet.plans.spread import spread

REFERENCES = 16  # the empty fingerprint and fifteen of topics
SAMPLE_ROWS = 2000  # bound of the sample that the topic references are drawn from
ROWS_PER_BAND = 4
SKETCH_LONGS = 4
BAND_GROUP = 4000  # members of a band that are paired in one step; a band with more is cut into groups


def bands_for(threshold: float, miss: float = 5e-4) -> int:
    """Bands of ROWS_PER_BAND values so that a pair at the threshold shares none with at most this chance."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**ROWS_PER_BAND))


def topic_references(sets: list[np.ndarray], count: int = REFERENCES - 1, features: int = 4096, rounds: int = 8) -> list[np.ndarray]:
    """Reference fingerprints: for each cluster of the sampled sets, the sequences typical of it."""
    sets = [s for s in sets if len(s)]
    if not sets:
        return [np.zeros(0, np.uint64)] * count
    values, number = np.unique(np.concatenate(sets), return_counts=True)
    frequent = np.sort(values[np.lexsort((values, -number))][:features])
    x = np.zeros((len(sets), len(frequent)), np.float32)
    for i, s in enumerate(sets):
        x[i, np.searchsorted(frequent, s[np.isin(s, frequent)])] = 1
    unit = x / np.maximum(1e-6, np.linalg.norm(x, axis=1, keepdims=True))
    centres = unit[np.linspace(0, len(unit) - 1, count).astype(int)]
    for _ in range(rounds):
        own = (unit @ centres.T).argmax(axis=1)
        centres = np.stack([unit[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(count)])
        centres /= np.maximum(1e-6, np.linalg.norm(centres, axis=1, keepdims=True))
    own = (unit @ centres.T).argmax(axis=1)
    overall = x.mean(axis=0)
    return [frequent[(x[own == c].mean(axis=0) >= 0.02) & (x[own == c].mean(axis=0) >= 3 * overall)] if (own == c).any() else np.zeros(0, np.uint64) for c in range(count)]


class Signer:
    """Set hash, bands, packed distances to the references and sketch, for many sets at once."""

    def __init__(self, references: list[np.ndarray], bands: int) -> None:
        self.bands = bands
        self.sizes = np.array([0, *map(len, references)], np.int64)
        self.union = np.unique(np.concatenate([*references, np.zeros(1, np.uint64)]))
        self.member = np.stack([np.isin(self.union, r) for r in [np.zeros(0, np.uint64), *references]], axis=1).astype(np.int64)
        rng = np.random.default_rng(7)
        self.a = rng.integers(0, 1 << 32, bands * ROWS_PER_BAND, np.uint64).astype(np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * ROWS_PER_BAND, np.uint64).astype(np.uint32)

    def __call__(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bands, distances packed four to a long, sketch) as int64 matrices; no set may be empty."""
        sizes = np.array([len(s) for s in sets])
        flat, start = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        short = (flat >> np.uint64(32)).astype(np.uint32)
        bands = np.zeros((len(sets), self.bands), np.uint64)
        sketch = np.zeros((len(sets), SKETCH_LONGS), np.uint64)
        per_long = -(-len(self.a) // SKETCH_LONGS)
        for k, (a, b) in enumerate(zip(self.a, self.b)):
            x = short * a + b
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            least = np.minimum.reduceat(x, start)
            bit = (least * np.uint32(0x85EBCA6B)) >> np.uint32(31)
            sketch[:, k // per_long] |= bit.astype(np.uint64) << np.uint64(k % per_long)
            band = bands[:, k // ROWS_PER_BAND]
            band ^= band >> np.uint64(29)
            band *= np.uint64(0x9E3779B97F4A7C15)
            band += least.astype(np.uint64) + np.uint64(k)
        bands ^= bands >> np.uint64(31)
        bands *= np.uint64(0xBF58476D1CE4E5B9)
        at = np.minimum(np.searchsorted(self.union, flat), len(self.union) - 1)
        hit = np.nonzero(self.union[at] == flat)[0]
        common = np.zeros((len(sets), len(self.sizes)), np.int64)
        np.add.at(common, np.repeat(np.arange(len(sets)), sizes)[hit], self.member[at[hit]])
        distance = np.minimum(sizes[:, None] + self.sizes - 2 * common, 0xFFFF).astype(np.uint64)
        packed = sum((distance[:, k::4] << np.uint64(16 * k) for k in range(4)), np.zeros((len(sets), REFERENCES // 4), np.uint64))
        return bands.view(np.int64), packed.view(np.int64), sketch.view(np.int64)


def _text(df: DataFrame, id_col: str, name_col: str | None, text_col: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(df[id_col].cast("long").alias("id"), (df[name_col] if name_col else none).alias("name"), df[text_col].alias("text")).where(F.col("id").isNotNull())


def _sets(names: list[str | None], texts: list[str | None], n: int) -> list[np.ndarray]:
    """The set of sequences of n words of each name with its text, in order."""
    found = tokens([f"{a or ''} {b or ''}" for a, b in zip(names, texts)])
    hashes, text, _ = found.ngrams(n)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    first = np.concatenate([[True], (np.diff(text) != 0) | (hashes[1:] != hashes[:-1])])[: len(hashes)]
    return np.split(hashes[first], np.cumsum(np.bincount(text[first], minlength=len(names)))[:-1]) if len(names) else []


def _fit_signer(rows: DataFrame, n: int, threshold: float) -> Signer:
    total = rows.count()
    share = min(1.0, 1.5 * SAMPLE_ROWS / max(total, 1))
    h = F.xxhash64("id")
    picked = rows.where(h <= F.lit(int(-(1 << 63) + share * ((1 << 64) - 1)))) if share < 1 else rows
    sample = picked.orderBy(h).limit(SAMPLE_ROWS).collect()
    sample = _sets([r[1] for r in sample], [r[2] for r in sample], n)
    return Signer(topic_references(sample), bands_for(threshold))


def _within(a: str, b: str, bound: Column) -> Column:
    """No coordinate of the two rows of the distance table differs by more than the bound."""
    tests = None
    for j in range(REFERENCES // 4):
        for k in range(4):
            part = lambda side, j=j, k=k: F.shiftrightunsigned(F.col(f"{side}v{j}"), 16 * k).bitwiseAND(F.lit(0xFFFF))
            test = F.abs(part(a) - part(b)) <= bound
            tests = test if tests is None else tests & test
    return tests


def group_of(one: Column, other: Column) -> Column:
    return F.least(one, other) * F.lit(1 << 20) + F.greatest(one, other)


def band_pairs(keyed: DataFrame, size: int | None = None, share: int = 16) -> DataFrame:
    """a < b: the ids (of `id`, `band`) that share a band, once for each such band.

    A band with more than some BAND_GROUP members, by a count over every `share`-th id, is cut into parts, and every two parts
    meet in a step of their own, so no task holds the band whole. Whichever bands are cut, every two members meet; so the
    count need not be exact.
    """
    size = size or BAND_GROUP
    meet = lambda df, on: df.select(*on, F.col("id").alias("a"), *(["home"] if "home" in df.columns else []))
    counted = keyed.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(share)) == 0).groupBy("band").agg((F.count("*") * share).alias("n"))
    # Written, so that its size is known before a join with it is planned.
    large = write_shared(counted.where(F.col("n") > size).select("band", F.ceil(F.col("n") / size).cast("int").alias("parts")), "bands")
    hot = not large.isEmpty()
    small = keyed.join(large.select("band"), "band", "left_anti") if hot else keyed
    pairs = meet(small, ["band"]).join(small.select("band", F.col("id").alias("b")), "band").where("a < b").select("a", "b")
    if hot:
        cut = keyed.join(large, "band").withColumn("home", F.pmod(F.xxhash64("id"), F.col("parts")).cast("long"))
        cut = cut.select("id", "band", "home", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o")).withColumn("group", group_of(F.col("home"), F.col("o")))
        # Members of one part meet in its own step only, those of two parts in the step of the two.
        inside = (F.col("home") != F.col("other")) | (F.col("group") == group_of(F.col("home"), F.col("home")))
        met = meet(cut, ["band", "group"]).join(cut.select("band", "group", F.col("home").alias("other"), F.col("id").alias("b")), ["band", "group"])
        pairs = pairs.unionByName(met.where((F.col("a") < F.col("b")) & inside).select("a", "b"))
    return pairs


def similar_classes(df: DataFrame, threshold: float = 0.8, shingle: int = 5, text_col: str = "extracted_text", id_col: str = "id", name_col: str | None = "file_name") -> tuple[DataFrame, DataFrame]:
    """(membership, pairs): id and class_id of every text, and class_a < class_b with their similarity, at least `threshold`.

    The words of the name and then of the text are taken, as stored. A class holds the texts with one and the same set of
    `shingle` consecutive words; its id is the smallest one. Texts without such a sequence (null, empty, too short) take no
    part. Repeated rows of an id count once, rows with a null id not at all. Other columns, whatever their names, play no
    part. The bands and the sketch are by chance: a pair at the threshold shares no band with a chance of at most 0.0005 and fails
    the sketch at five standard deviations, and far less above; the table and the check are exact. A band with very many
    members is paired group by group, so no task holds it whole.
    """
    spark = df.sparkSession
    rows = _text(df, id_col, name_col, text_col)
    signer = spark.sparkContext.broadcast(_fit_signer(rows, shingle, threshold))
    longs = [*(f"v{k}" for k in range(REFERENCES // 4)), *(f"f{k}" for k in range(SKETCH_LONGS))]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 2000):
                batch = whole.slice(low, 2000)
                sets = _sets(batch.column(1).to_pylist(), batch.column(2).to_pylist(), shingle)
                keep = [k for k, s in enumerate(sets) if len(s)]
                if not keep:
                    continue
                sets = [sets[k] for k in keep]
                bands, packed, sketch = signer.value(sets)
                columns = [
                    batch.column(0).take(pa.array(keep)), pa.array([len(s) for s in sets], pa.int32()), pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.FixedSizeListArray.from_arrays(pa.array(bands.reshape(-1)), bands.shape[1]).cast(pa.list_(pa.int64())),
                    *(pa.array(np.ascontiguousarray(packed[:, k])) for k in range(packed.shape[1])), *(pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(SKETCH_LONGS)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "same", "bands", *longs])

    signed = write_shared(spread(rows).mapInArrow(sign, "id long, n int, same binary, bands array<long>, " + ", ".join(f"{c} long" for c in longs)), "signatures")
    classes = signed.groupBy("same").agg(F.min("id").alias("class_id"), F.count("*").alias("members"))
    copied = classes.where("members > 1")
    copies = signed.select("id", "same").join(copied, "same").select("id", "class_id").distinct()
    others = copies.where("id <> class_id").select("id")
    # Each class stands in the search by one row. The few copies are taken out, not the many others joined in.
    single = signed.join(others, "id", "left_anti")
    pairs = band_pairs(single.select("id", F.explode("bands").alias("band"))).distinct()

    table = single.select("id", "n", *longs)
    side = lambda s: table.select(*(F.col(c).alias(f"{s}_{c}") for c in table.columns))
    pairs = pairs.join(side("a"), F.col("a") == F.col("a_id")).join(side("b"), F.col("b") == F.col("b_id"))
    most = F.floor((1 - threshold) / (1 + threshold) * (F.col("a_n") + F.col("b_n")) + 1e-9)
    values = bands_for(threshold) * ROWS_PER_BAND
    differ = sum(F.bit_count(F.col(f"a_f{k}").bitwiseXOR(F.col(f"b_f{k}"))) for k in range(SKETCH_LONGS))
    expected = values * (1 - threshold) / 2
    pairs = pairs.where(_within("a_", "b_", most)).where(differ <= math.ceil(expected + 5 * math.sqrt(expected * (1 + threshold) / 2)))
    survivors = write_shared(pairs.select("a", "b"), "survivors")

    wanted = survivors.select(F.col("a").alias("id")).union(survivors.select("b")).distinct()

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _sets(batch.column(1).to_pylist(), batch.column(2).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "grams"])

    # The sets are made once: every end of a pair gets its own, then the two ends of a pair come together.
    sets = rows.join(wanted, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(full, "id long, grams array<long>")
    ends = survivors.select("a", "b", F.explode(F.array("a", "b")).alias("id")).join(sets, "id")
    of = lambda end: F.first(F.when(F.col("id") == F.col(end), F.col("grams")), ignorenulls=True)
    joined = ends.groupBy("a", "b").agg(of("a").alias("x"), of("b").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    exact = joined.select("a", "b", (common / (F.size("x") + F.size("y") - common)).alias("similarity")).where(F.col("similarity") >= threshold)
    membership = signed.select("id", "same").distinct().join(classes.select("same", "class_id"), "same").select(F.col("id").alias(id_col), "class_id")
    return membership, exact.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), "similarity")


def similar_pairs(df: DataFrame, threshold: float = 0.8, shingle: int = 5, **columns: str | None) -> DataFrame:
    """Pairs of ids, id_a < id_b, copies written out."""
    membership, pairs = similar_classes(df, threshold, shingle, **columns)
    id_col = membership.columns[0]
    of = lambda name, key: membership.select(F.col("class_id").alias(key), F.col(id_col).alias(name))
    between = pairs.join(of("x", "class_a"), "class_a").join(of("y", "class_b"), "class_b").select("x", "y")
    alone = membership.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").select("class_id")
    multi = membership.join(alone, "class_id", "left_semi")
    inside = multi.select("class_id", F.col(id_col).alias("x")).join(multi.select("class_id", F.col(id_col).alias("y")), "class_id").where("x < y").select("x", "y")
    return between.unionByName(inside).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
