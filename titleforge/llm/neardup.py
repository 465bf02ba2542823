"""Problem 6: groups of titles that differ by small edits or by the order of their segments.

b-bit MinHash: each text's shingles give minima under many hash functions; bands of full minima
propose candidates; the low b bits of all minima, packed into longs, estimate the similarity by bit
counts, corrected for chance collisions; what stays is checked exactly.

Texts of equal letters and digits are one node, and nodes with the same segments in any order are
linked outright. Bands are sorted and scanned. A large band never gives all pairs: each member meets
the band's pivot and its neighbours in an order that differs from band to band.

Bands may miss a pair, so the groups they give are only the first. An exact prefix-filter join on rare
disjoint shingles (deletion variants for short texts) then links what is still apart: only entries of
different groups meet, and of a shingle that very many share, the entries of its largest group never
meet each other, so a large group costs no pairs within itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleforge.llm.arrow import PART, merged_array, over_batches
from titleforge.llm.codepoints import from_codepoints, keep, letters_and_digits, lower_case, row_of, to_codepoints
from titleforge.llm.components import components
from titleforge.llm.edits import EditSignatures, bucket_of, mixed
from titleforge.llm.overlap import ENTRY, crowded, entries, shingle_costs, table_size
from titleforge.session import cut_lineage

BREAK = 0x1F  # between segments


def segment_points(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters and digits in lower case, one break sign between runs."""
    inside = letters_and_digits()[points]
    row = row_of(offsets)
    first = np.ones(len(points), bool)
    first[1:] = ~inside[:-1] | (row[1:] != row[:-1])
    begins = inside & first
    # a break takes the place of the sign before a run, unless the run opens the row
    runs = np.concatenate([[0], np.cumsum(begins)])
    opens = begins & (runs[:-1] == runs[offsets[:-1]][row]) if len(points) else begins
    put = np.zeros(len(points), bool)
    put[np.flatnonzero(begins & ~opens) - 1] = True
    return keep(np.where(put, BREAK, lower_case()[points]), offsets, inside | put)


def shingles(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the pairs of neighbouring letters; a text of one letter has that letter."""
    row = row_of(offsets)
    if not len(points):
        return row, np.zeros(0, np.uint64)
    pair = np.append(row[:-1] == row[1:], False)
    use = pair | (np.diff(offsets) == 1)[row]
    return row[use], mixed(np.where(pair, points << 21 | np.append(points[1:], 0), points)[use], 5)


class MinHash:
    """`bands` bands of `width` minima each; `bits` low bits of every minimum are packed into longs."""

    def __init__(self, bands: int = 8, width: int = 4, bits: int = 2, seed: int = 20240229) -> None:
        self.bands, self.width, self.bits = bands, width, bits
        self.rows = bands * width
        assert self.rows % (64 // bits) == 0
        rng = np.random.default_rng(seed)
        self.factor = rng.integers(1, 1 << 63, self.rows, dtype=np.uint64) | np.uint64(1)
        self.shift = rng.integers(0, 1 << 63, self.rows, dtype=np.uint64)

    def minima(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(rows, self.rows) 32-bit minima of the hash runs that begin at `starts`."""
        out = np.empty((len(starts), self.rows), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.rows):
                out[:, k] = np.minimum.reduceat((hashes * self.factor[k] + self.shift[k]) >> np.uint64(32), starts)
        return out

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        """One 64-bit key per row and band."""
        with np.errstate(over="ignore"):
            key = np.broadcast_to(np.arange(self.bands, dtype=np.uint64)[None], (len(minima), self.bands)).copy()
            for k in range(self.width):
                key = mixed(key ^ minima[:, k :: self.width], 11)
        return key

    def packed(self, minima: np.ndarray) -> np.ndarray:
        """The low bits of all minima, (rows, self.rows * bits / 64) longs."""
        low = mixed(minima, 17) & np.uint64((1 << self.bits) - 1)
        per = 64 // self.bits
        low = low.reshape(len(minima), -1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(self.bits))
        return np.bitwise_or.reduce(low, axis=2).view(np.int64)

    def estimate(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The similarity of packed signatures, row by row: agreeing minima by bit counts, less the agreement by chance."""
        x = (a ^ b).view(np.uint64)
        y = x.copy()
        for s in range(1, self.bits):
            y |= x >> np.uint64(s)
        mask = np.uint64(sum(1 << k for k in range(0, 64, self.bits)))
        agree = 1.0 - np.bitwise_count(y & mask).sum(axis=1, dtype=np.int64) / self.rows
        chance = 2.0**-self.bits
        return (agree - chance) / (1 - chance)


SMALL = 8  # members of a band up to which they are held against each other at once
PAIR = "a long, b long"


def _meet(mh: MinHash, least: float):
    """Scans a partition sorted by band: pairs of one band whose estimated similarity is at least `least`.

    A band of up to SMALL members is compared whole; of a larger one each member meets the first (the
    pivot) and its SMALL - 1 predecessors. At no time more than a batch and SMALL rows are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = None, 0  # the open run's rows (its last ones if it is large), its members so far
        pivot = None

        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = [np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.stack([np.asarray(c) for c in batch.columns[2:]], axis=1)]
            old = 0 if held is None else len(held[0])
            band, node, sign = fresh if held is None else (np.concatenate([h, f]) for h, f in zip(held, fresh))
            starts = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
            sizes = np.diff(np.append(starts, len(band)))
            total = sizes.copy()
            first_node, first_sign = node[starts].copy(), sign[starts].copy()
            if pivot is not None:
                total[0] += seen - old
                first_node[0], first_sign[0] = pivot
            run_of = np.repeat(np.arange(len(starts)), sizes)
            is_new = np.arange(len(band)) >= old
            pairs: list[tuple[np.ndarray, np.ndarray]] = []

            def take(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
                good = (a != b) & (mh.estimate(x, y) >= least)
                pairs.append((np.minimum(a, b)[good], np.maximum(a, b)[good]))

            for d in range(1, SMALL):
                if sizes.max() <= d:
                    break
                hit = np.flatnonzero((run_of[d:] == run_of[:-d]) & is_new[d:])
                take(node[hit], node[hit + d], sign[hit], sign[hit + d])
            far = np.flatnonzero((total > SMALL)[run_of] & is_new)
            take(first_node[run_of[far]], node[far], first_sign[run_of[far]], sign[far])
            both = np.unique(np.stack([np.concatenate(x) for x in zip(*pairs)], axis=1), axis=0)
            if len(both):
                yield pa.RecordBatch.from_pydict({"a": np.ascontiguousarray(both[:, 0]), "b": np.ascontiguousarray(both[:, 1])})
            last = int(starts[-1])
            pivot, seen = (int(first_node[-1]), first_sign[-1].copy()), int(total[-1])
            since = max(last, len(band) - SMALL + 1)
            held = [band[since:], node[since:], sign[since:]]

    return run


def _verified(pairs: DataFrame, classes: DataFrame, edits: int) -> DataFrame:
    """The pairs within the allowed edits, with their other columns."""
    for side in "ab":
        pairs = pairs.join(classes.select(F.col("class_id").alias(side), F.col("key").alias(f"{side}_key")), side)
    return pairs.where(F.levenshtein("a_key", "b_key", edits) >= 0).drop("a_key", "b_key")


def _banded_pairs(classes: DataFrame, rows: int, mh: MinHash, least: float, hot: int) -> DataFrame:
    """(a, b): the candidates of all bands that pass the estimate, each once."""
    signs = [f"sign{k}" for k in range(mh.rows * mh.bits // 64)]
    schema = ", ".join(f"{c} long" for c in ("band", "class_id", *signs))

    def bands(batch: pa.RecordBatch) -> dict[str, object] | None:
        ids = np.asarray(batch.column(0))
        points, offsets, _ = to_codepoints(batch.column(1))
        row, h = shingles(points, offsets)
        if not len(row):
            return None
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        least = mh.minima(h, starts)
        words = np.repeat(mh.packed(least), mh.bands, axis=0)
        return {"band": mh.band_keys(least).ravel().view(np.int64), "class_id": np.repeat(ids[row[starts]], mh.bands), **{c: np.ascontiguousarray(words[:, k]) for k, c in enumerate(signs)}}

    banded, by = over_batches(classes, bands, schema), ["band"]
    if rows > hot:  # else no band can be hot
        # a hot band stands for at least a thousandth of all rows, so there are at most 1,000 times `bands` of them
        hot = max(hot, rows // 1_000)
        sample = over_batches(classes.where("pmod(xxhash64(class_id), 100) = 0"), bands, schema)
        crowds = cut_lineage(sample.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > hot // 100).select("band", (1 + F.floor(F.col("n") * 100 / hot)).cast("int").alias("parts")))
        salt = F.pmod(F.xxhash64("class_id", "band"), F.coalesce("parts", F.lit(1))).cast("int")
        banded, by = banded.join(F.broadcast(crowds), "band", "left").withColumn("salt", salt), ["band", "salt"]
    # neighbours in a band are by chance and differ from band to band
    placed = banded.repartition(*by).sortWithinPartitions(*by, F.xxhash64("class_id", "band")).select("band", "class_id", *signs)
    return placed.mapInArrow(_meet(mh, least), PAIR).distinct()


def _pairs_between(classes: DataFrame, sig: EditSignatures, rows: int, crowd: int) -> DataFrame:
    """(a, b, a_root, b_root): candidates for near pairs of classes (class_id, key, root) of different roots. Exact: none is missing."""
    costs = shingle_costs(classes, sig, rows)
    schema = ENTRY + ", root long"

    def indexed(batch: pa.RecordBatch) -> dict[str, object]:
        row, out = entries(batch, sig, costs)
        return {**out, "root": np.asarray(batch.column(2))[row]}

    index = cut_lineage(over_batches(classes, indexed, schema))
    size = table_size(4 * index.count(), most=1 << 23)
    short = lambda roots: (mixed(roots.view(np.uint64), 3) >> np.uint64(48)).astype(np.uint16)

    def mark(table: np.ndarray, batch: pa.RecordBatch) -> None:
        at, r = bucket_of(np.asarray(batch.column(0)).view(np.uint64), size), short(np.asarray(batch.column(1)))
        np.maximum.at(table, 2 * at, r)
        np.maximum.at(table, 2 * at + 1, ~r)

    # of each bucket the greatest and the least short hash of a root: a probe goes on only if another root may be there
    part = F.shiftrightunsigned("h", 64 - (size // (PART // 2)).bit_length() + 1)  # the part of the table that an entry falls into
    table = merged_array(index.select("h", "root").repartition(part), mark, 2 * size, np.maximum, np.uint16, apart=True)

    def asked(batch: pa.RecordBatch) -> dict[str, object]:
        row, out = entries(batch, sig, None)
        out = {**out, "root": np.asarray(batch.column(2))[row]}
        at, own = bucket_of(out["h"].view(np.uint64), size), short(out["root"])
        high, low = table[2 * at], table[2 * at + 1]
        other = ((high != own) | (~low != own)) & ((high > 0) | (low > 0))
        return {k: v[other] for k, v in out.items()}

    probe = cut_lineage(over_batches(classes, asked, schema))
    maybe = crowded(probe.select("h", "root"), crowd)

    def join(i: DataFrame, p: DataFrame) -> DataFrame:
        i, p = i.alias("i"), p.alias("p")
        left, right = F.col("p.place") - F.col("i.place"), (F.col("p.size") - F.col("p.place")) - (F.col("i.size") - F.col("i.place"))
        swap = F.col("p.class_id") > F.col("i.class_id")
        return (
            p.join(i, (F.col("p.h") == F.col("i.h")) & (F.col("p.salt") == F.col("i.salt")) & (F.col("p.root") != F.col("i.root")))
            .where((F.abs(left) + F.abs(right) <= sig.edits) & (F.bit_count(F.col("p.bag").bitwiseXOR(F.col("i.bag"))) <= 2 * sig.edits))
            .select(
                F.least("p.class_id", "i.class_id").alias("a"), F.greatest("p.class_id", "i.class_id").alias("b"),
                F.when(swap, F.col("i.root")).otherwise(F.col("p.root")).alias("a_root"), F.when(swap, F.col("p.root")).otherwise(F.col("i.root")).alias("b_root"),
            )
        )

    if maybe is None:
        return join(index.withColumn("salt", F.lit(0)), probe.withColumn("salt", F.lit(0))).distinct()
    per = maybe.groupBy("h", "root").agg(F.count("*").alias("n")).groupBy("h").agg(F.sum("n").alias("n"), F.max_by("root", F.struct("n", "root")).alias("most"))
    crowds = cut_lineage(per.where(F.col("n") > crowd).select("h", "most", (F.floor(F.col("n") / sig.salt_rows) + 1).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    probe = cut_lineage(probe.join(crowds, "h", "left").withColumn("salt", F.pmod(F.xxhash64("class_id"), parts).cast("int")))
    index = cut_lineage(index.join(crowds, "h", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))))
    main = F.coalesce(F.col("root") == F.col("most"), F.lit(False))
    return join(index.where(~main), probe).unionByName(join(index.where(main), probe.where(~main))).distinct()


def near_groups(
    titles: DataFrame, *, id_col: str = "row_id", text: str = "title", edits: int = 3, least_estimate: float = 0.25, minhash: MinHash | None = None, hot: int = 200_000, crowd: int = 1_000
) -> DataFrame:
    """(id, first_id): the group of every row that is not null; first_id is its smallest id.

    Two texts are near if their letters and digits, without case, differ by at most `edits` edits, or
    if they have the same segments in any order. Groups are closed under near, and exact: whatever the
    bands of MinHash or `least_estimate` leave apart, the join on rare shingles brings together.
    Redelivered ids count once; texts of no letters form one group; null texts and ids are left out;
    an empty table gives none.

    Bands that more than about `hot` texts share are salted; shingles that more than `crowd` texts of
    several groups share are joined without pairs inside the largest of these groups."""
    mh, sig = minhash or MinHash(), EditSignatures(edits)

    def form(batch: pa.RecordBatch) -> dict[str, object]:
        points, offsets, _ = to_codepoints(batch.column(1))
        points, offsets = segment_points(points, offsets)
        return {"id": batch.column(0), "key": from_codepoints(*keep(points, offsets, points != BREAK)), "segments": from_codepoints(points, offsets)}

    source = titles.where(F.col(text).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("segments"))
    turned = F.concat_ws(chr(BREAK), F.array_sort(F.split("segments", chr(BREAK)))).alias("turned")
    rows = cut_lineage(over_batches(source, form, "id long, key string, segments string").select("id", "key", turned))
    # one node per distinct text: exact copies never meet each other again
    firsts = rows.groupBy("key").agg(F.min("id").alias("class_id"))
    n = firsts.count()
    classes = cut_lineage(firsts.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // 20_000)), "class_id").select("class_id", "key"))
    members = cut_lineage(rows.join(classes, "key").select("id", "class_id", "turned"))
    orders = members.select("class_id", "turned").distinct()
    same = orders.groupBy("turned").agg(F.min("class_id").alias("b"), F.max("class_id").alias("y")).where("b <> y").drop("y")
    links = _verified(_banded_pairs(classes, n, mh, least_estimate, hot), classes, edits).unionByName(orders.join(same, "turned").select(F.col("class_id").alias("a"), "b"))
    first = components(links).withColumnRenamed("node", "class_id")
    placed = cut_lineage(classes.join(first, "class_id", "left").select("class_id", "key", F.coalesce("root", "class_id").alias("root")))
    more = _verified(_pairs_between(placed, sig, n, crowd), classes, edits).select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct()
    last = components(more).select(F.col("node").alias("root"), F.col("root").alias("top"))
    groups = placed.join(last, "root", "left").select("class_id", F.coalesce("top", "root").alias("first_id"))
    return members.select("id", "class_id").join(groups, "class_id").select("id", "first_id").distinct()


def near_pairs(titles: DataFrame, **options: object) -> DataFrame:
    """p6_found: (first_id, other_id), each other row of a group with the group's smallest id."""
    return near_groups(titles, **options).where("id <> first_id").select("first_id", F.col("id").alias("other_id"))
