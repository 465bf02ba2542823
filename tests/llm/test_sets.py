"""Overlaps, copies, near-duplicates, packing: against brute force."""

import itertools
import json
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex

from titleforge.llm import copies, neardup, overlap, packing
from titleforge.llm.components import components
from titleforge.llm.edits import EditSignatures

WORDS = ["枸杞", "茶山", "高血压", "村支书", "老中医", "讲堂", "说了", "走红", "偏方", "结果", "专家", "打脸", "CT", "No", "厨房", "温泉"]


def near(a: str, b: str, most: int = 3) -> bool:
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= most


def edited(rng: random.Random, text: str, edits: int) -> str:
    for _ in range(edits):
        at, c = rng.randrange(len(text) + 1), rng.choice("甲乙丙xy")
        text = rng.choice([text[:at] + c + text[at:], text[:at] + text[at + 1 :], text[:at] + c + text[at + 1 :]])
    return text


def titles(seed: int, count: int, shortest: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    out: list[str | None] = [None, "", "!?", "a", "ab", "A b", "x" * 3_000, "x" * 2_999 + "y"]
    while len(out) < count:
        base = ",".join("".join(rng.choices(WORDS, k=rng.randint(1, 3))) for _ in range(rng.randint(shortest, 4)))
        out += [base, *(edited(rng, base, rng.randint(0, 4)) for _ in range(rng.randint(0, 3)))]
        if rng.random() < 0.3:
            parts = base.split(",")
            rng.shuffle(parts)
            out.append("!".join(parts).lower())
    return out[:count]


def key(text: str) -> str:
    return regex.sub(r"[^\p{L}\p{N}]", "", text.lower())


@pytest.mark.parametrize("salt_rows", [50_000, 5])
def test_overlap_is_exact(spark, monkeypatch, salt_rows):
    made = EditSignatures
    monkeypatch.setattr(overlap, "EditSignatures", lambda edits: made(edits, salt_rows=salt_rows))
    rows = [(i, ["train", "dev", "test"][i % 3], t, f"s{i % 2}") for i, t in enumerate(titles(3, 240))]
    df = spark.createDataFrame([*rows, rows[20], (None, None, rows[20][2], None), (None, "dev", None, None)], "title_id long, split string, title string, source string").selectExpr("*", "1 AS key", "2 AS class_id")
    got = Counter((r.a_id, r.b_id) for r in overlap.overlap_pairs(df).collect())
    keys = [(i, s, key(t)) for i, s, t, _ in rows if t is not None]
    expect = {(a, b) for (a, s, x), (b, u, y) in itertools.combinations(keys, 2) if (s == "train") != (u == "train") and near(x, y)}
    assert got == Counter(expect)
    report = overlap.overlap_report(df).collect()
    assert sum(r.titles for r in report) == sum(s != "train" for _, s, _ in keys)
    assert sum(r.exact + r.near for r in report) == len({b if s == "train" else a for a, b in expect for _, s, _ in [next(k for k in keys if k[0] == a)]})
    assert overlap.overlap_pairs(df.limit(0)).count() == 0


def brute_groups(rows):
    root = {i: i for i, t in rows if t is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = [(i, key(t), sorted(regex.findall(r"[\p{L}\p{N}]+", t.lower()))) for i, t in rows if t is not None]
    for (a, x, p), (b, y, q) in itertools.combinations(known, 2):
        if p == q or near(x, y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {(find(i), i) for i in root if find(i) != i}


@pytest.mark.parametrize(("small", "hot", "crowd"), [(32, 200_000, 1_000), (2, 200_000, 3), (2, 100, 1_000)])
def test_near_groups(spark, monkeypatch, small, hot, crowd):
    monkeypatch.setattr(neardup, "SMALL", small)
    rows = list(enumerate(titles(5, 260, shortest=3)))
    rng = random.Random(9)
    rows += [(1000 + k, edited(rng, "村支书茶山温泉厨房老中医讲堂高血压专家打脸偏方走红", 1)) for k in range(60)]  # a crowd of near copies
    df = spark.createDataFrame([*rows, rows[30], (None, rows[30][1])], "row_id long, title string").selectExpr("*", "1 AS node", "2 AS band").repartition(3)
    got = Counter((r.first_id, r.other_id) for r in neardup.near_pairs(df, hot=hot, crowd=crowd).collect())
    assert got == Counter(brute_groups(rows))
    assert neardup.near_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize(("hot", "least"), [(200_000, 0.25), (100, 0.25), (200_000, 2.0)])  # the last: MinHash gives nothing at all
def test_near_groups_miss_no_link(spark, hot, least):
    rng = random.Random(17)
    letters = [chr(0x4E00 + k) for k in range(3000)]
    rows = []
    for k in range(60):  # three spread replacements of 11 to 30 letters, three spread insertions, in groups of two
        one = rng.sample(letters, 11 + k % 20)
        spots = [len(one) * p // 4 for p in (1, 2, 3)]
        two = [rng.choice(letters) if i in spots else c for i, c in enumerate(one)]
        rows += [(10 * k + 1, "".join(one)), (10 * k, "".join(two))]
        base = rng.sample(letters, 8)
        rows += [(10 * k + 2, "".join(base)), (10 * k + 3, "".join(c + (rng.choice(letters) if i in (1, 3, 5) else "") for i, c in enumerate(base)))]
    for k in range(20):  # equal letters, shifted separators; the same segments turned
        text = rng.sample(letters, 12)
        rows += [(1000 + 4 * k, "".join(text)), (1001 + 4 * k, " ".join(text)), (1002 + 4 * k, "".join(text[7:]) + "，" + "".join(text[:7])), (1003 + 4 * k, "".join(text[:7]) + "-" + "".join(text[7:]))]
    crowd = "村支书茶山温泉厨房老中医讲堂高血压专家打脸偏方走红"
    rows += [(5000 + k, edited(rng, crowd, 1)) for k in range(60)] + [(4000, crowd[:3] + "甲" + crowd[4:12] + "乙" + crowd[13:20] + "丙" + crowd[21:])]
    df = spark.createDataFrame(rows, "row_id long, title string").repartition(3)
    got = Counter((r.first_id, r.other_id) for r in neardup.near_pairs(df, hot=hot, least_estimate=least).collect())
    assert got == Counter(brute_groups(rows))


def test_estimate_follows_similarity():
    mh = neardup.MinHash(bands=64)
    rng = np.random.default_rng(2)
    pairs, truth = [], []
    for share in (0, 20, 50, 80, 100):
        both, a, b = (rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (share, 100 - share, 100 - share))
        pairs.append([mh.packed(mh.minima(np.concatenate([both, x]), np.array([0])))[0] for x in (a, b)])
        truth.append(share / (200 - share))
    got = mh.estimate(*(np.stack(x) for x in zip(*pairs)))
    assert np.allclose(got, truth, atol=0.15)


@pytest.mark.parametrize("whole", [1_000_000, 0, 20])
def test_components(spark, whole):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(40)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5), whole=whole).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_copies(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):  # a third of all rows are one record
        k = 0 if i % 3 == 0 else rng.randrange(60)
        fields = [("title", f"题 {k}!" if i % 2 else f"题{k}"), ("label", "Yes" if i % 4 else "YES "), ("account", f"acct_{k}"), ("source", None if k == 5 else "web")]
        rng.shuffle(fields)
        rows.append((i, json.dumps(dict(fields), ensure_ascii=bool(i % 5))))
    rows += [(900, None), (901, "no object"), (902, "NO, object"), (903, ""), (904, "x" * 100_000), (905, "{}")]
    df = spark.createDataFrame([*rows, (None, rows[0][1])], "record_id long, payload string").selectExpr("*", "1 AS key", "2 AS kept_id").repartition(5)

    def canon(p):
        try:
            d = json.loads(p)
        except ValueError:
            return "~" + key(p)
        return tuple(key(d.get(f) or "") for f in copies.FIELDS) if d else "~"

    groups: dict[object, list[int]] = {}
    for i, p in rows:
        if p is not None:
            groups.setdefault(canon(p), []).append(i)
    got = Counter((r.kept_id, r.copy_id) for r in copies.copy_pairs(df).collect())
    assert got == Counter((min(g), i) for g in groups.values() for i in g if i != min(g))
    assert {r.kept_id: r.copies for r in copies.collapsed(df).collect()} == {min(g): len(g) for g in groups.values()}
    assert copies.copy_pairs(df.limit(0)).count() == 0 and copies.collapsed(df.limit(0)).count() == 0


@pytest.mark.parametrize("capacity", [10, 37, 100])
def test_pack_small_sets_are_optimal(capacity):
    rng = random.Random(capacity)
    for _ in range(40):
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 10))]
        got = packing.pack(sizes, capacity, steps_per_item=None)
        assert sorted(x for b in got for x in b) == sorted(sizes) and all(sum(b) <= capacity for b in got)
        best = len(sizes)
        bins: list[int] = []

        def place(rest, used):
            nonlocal best
            if used >= best:
                return
            if not rest:
                best = used
                return
            for k in range(used + 1):
                if k == used:
                    bins.append(0)
                if bins[k] + rest[0] <= capacity:
                    bins[k] += rest[0]
                    place(rest[1:], max(used, k + 1))
                    bins[k] -= rest[0]
                if k == used:
                    bins.pop()

        place(sorted(sizes, reverse=True), 0)
        assert packing.lower_bound(np.array(sizes, dtype=int), capacity) <= best == len(got)


def test_pack_proves_optimality():
    assert len(packing.pack([37, 36, 59, 42, 11, 23, 2, 43, 75, 20, 57, 43], 150, steps_per_item=None)) == 3
    assert len(packing.pack([3] * 5_000, 8_192)) == 2  # thousands of pieces in one container
    assert packing.dominates([6, 4], [5, 4, 1]) and not packing.dominates([6, 4], [5, 5]) and packing.dominates([7], [3, 2, 2])


def test_packed(spark, data):
    documents = spark.read.parquet(f"{data}/documents.parquet").selectExpr("*", "1 AS container", "2 AS piece")
    bins = spark.read.parquet(f"{data}/pack_bins.parquet")
    from titleforge.llm.tokens import token_counts

    rows = packing.packed(documents, bins, block=40).toPandas()
    assert rows.container.map(lambda c: c >> 32).nunique() > 1
    sizes = token_counts(documents).toPandas().set_index("doc_id").n_tokens
    for _, one in rows.groupby("bin_set"):
        capacity = one.capacity.iloc[0]
        assert (one.groupby("container").n_tokens.sum() <= capacity).all()
        assert one.groupby("doc_id").n_tokens.sum().to_dict() == sizes.to_dict()
        pieces = one.groupby("doc_id").size()
        assert (pieces == np.maximum(1, -(-sizes.loc[pieces.index] // capacity))).all()
    assert packing.packed(documents.limit(0), bins).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, None), (5, None), (5, ""), (5, "x " * 3_000), (5, "x " * 3_000)], "doc_id long, text string")
    got = packing.packed(odd, bins).toPandas()
    small = got[got.bin_set == "small"]
    assert small[small.doc_id.isna()].n_tokens.tolist().count(0) == 1 and (small.groupby("container").n_tokens.sum() <= 512).all()
    assert small[small.doc_id == 5].n_tokens.sum() == 2 * token_counts(odd.where("text like 'x%'")).first().n_tokens
    with pytest.raises(ValueError):
        packing.packed(documents, spark.createDataFrame([("x", 0)], "bin_set string, capacity int"))
    report = packing.packing_report(packing.packed(documents, bins)).toPandas()
    assert (report.used_share > 0.8).all()


def test_bounded_sample(spark):
    from titleforge.llm.arrow import bounded_sample

    df = spark.range(5_000).selectExpr("id", "id % 7 AS x").repartition(9)
    got = {r.id for r in bounded_sample(df, "id", 40).collect()}
    least = {r.id for r in df.selectExpr("id", "xxhash64(id) AS h").orderBy("h").limit(40).collect()}
    assert got == least
    assert bounded_sample(df.limit(5), "id", 40).count() == 5 and bounded_sample(df.limit(0), "id", 40).count() == 0
