"""Problem 9: documents into containers of fixed capacity, measured in tokens.

Documents meet in blocks of bounded size; each block and container set is packed by a task of its
own. A document larger than a container fills containers of its own and leaves one rest; no other
is split. A block is packed by bin completion: the largest document left is completed by each
filling that no other dominates; fillings that waste more than the incumbent allows are cut;
best-fit decreasing gives the first incumbent and a lower bound proves the end. The search is
complete: only its budget of steps, `steps_per_item`, may end it before the proof, and None takes
that bound away."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titleforge.llm.tokens import token_counts
from titleforge.session import cut_lineage

BLOCK = 5_000  # documents
STEPS = 20  # of the search, per document of a block
WINDOW = 24  # fillings put in order at a time in the first round
OUT = "bin_set string, capacity int, container long, doc_id long, piece int, start int, n_tokens int"


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer containers: for every k, documents over capacity - k stand alone,
    those over half each need their own, and the rest of at least k fill what these leave."""
    a = np.sort(sizes)[::-1].astype(np.int64)
    if not len(a):
        return 0
    sums = np.concatenate([[0], np.cumsum(a)])
    half = int(np.searchsorted(-a, -capacity / 2, side="left"))
    ks = np.concatenate([[0], np.unique(a[2 * a <= capacity])])
    alone = np.searchsorted(-a, -(capacity - ks), side="left")
    upto = np.searchsorted(-a, -ks, side="right")
    room = (half - alone) * capacity - (sums[half] - sums[alone])
    return int((half + np.maximum(0, -(-(sums[np.maximum(upto, half)] - sums[half] - room) // capacity))).max())


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each document into the fullest container that takes it."""
    free: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for size in sorted(sizes, reverse=True):
        at = bisect_left(free, (size, -1))
        if at < len(free):
            room, k = free.pop(at)
        else:
            room, k = capacity, len(bins)
            bins.append([])
        bins[k].append(size)
        if room > size:
            insort(free, (room - size, k))
    return bins


def dominates(a: list[int], b: list[int], tries: int = 30) -> bool:
    """Whether the sizes of b (falling) can be placed in slots of the sizes of a (falling): then b is never the
    better filling. Beyond `tries` steps the answer is no, which only leaves b in the search."""
    if len(a) >= len(b) and all(x >= y for x, y in zip(a, b)):
        return True
    if sum(a) < sum(b) or a[:1] < b[:1]:
        return False
    free, placed, start = list(a), [], 0
    for _ in range(tries):
        if len(placed) == len(b):
            return True
        size = b[len(placed)]
        at = next((i for i in range(start, len(free)) if free[i] >= size), None)
        if at is not None:
            free[at] -= size
            placed.append(at)
            start = 0
        elif placed:
            at = placed.pop()
            free[at] += b[len(placed)]
            start = at + 1
        else:
            return False
    return False


class Completion:
    """Bin completion over a multiset of sizes, each from 1 to the capacity. `steps` bounds the search; None does not."""

    def __init__(self, sizes: list[int], capacity: int, steps: int | None) -> None:
        self.capacity, self.left, self.cut = capacity, float("inf") if steps is None else steps, False
        self.total = sum(sizes)
        self.distinct = sorted(set(sizes))
        self.count: dict[int, int] = {}
        for s in sizes:
            self.count[s] = self.count.get(s, 0) + 1

    def take(self, items: list[int]) -> None:
        for s in items:
            self.count[s] -= 1
            if not self.count[s]:
                self.distinct.pop(bisect_left(self.distinct, s))

    def give(self, items: list[int]) -> None:
        for s in items:
            if not self.count[s]:
                insort(self.distinct, s)
            self.count[s] += 1

    def maximal(self, room: int, slack: int, breadth: int) -> Iterator[tuple[int, list[int]]]:
        """(waste, sizes) of sets that fit the room, to which nothing can be added, and that waste at most
        `slack`; larger sizes first. The first sizes have at most 12 * breadth branches, later ones
        half as many as are left to the one before, at least breadth; `cut` says whether that left any out."""
        sizes, count, used = self.distinct, self.count, {}
        chosen: list[int] = []
        left = room
        frames = [[bisect_right(sizes, room) - 1, 12 * breadth, False]]  # next size to try, branches left, whether any was taken
        while frames and self.left > 0:
            self.left -= 1
            frame = frames[-1]
            at = frame[0]
            while at >= 0 and used.get(sizes[at], 0) >= count[sizes[at]]:
                at -= 1
            if at >= 0 and frame[1] > 0:
                frame[0], frame[1], frame[2] = at - 1, frame[1] - 1, True
                s = sizes[at]
                used[s] = used.get(s, 0) + 1
                chosen.append(s)
                left -= s
                frames.append([min(at, bisect_right(sizes, left) - 1), max(breadth, (frame[1] + 1) // 2), False])
                continue
            self.cut |= at >= 0
            if not frame[2] and left <= slack:
                least = next((s for s in sizes if s > left or used.get(s, 0) < count[s]), None)
                if least is None or least > left:
                    yield left, chosen[:]
            frames.pop()
            if chosen:
                s = chosen.pop()
                used[s] -= 1
                left += s

    def fillings(self, room: int, slack: int) -> Iterator[list[int]]:
        """Every undominated filling of the room, in rounds of growing breadth, of a round the fullest first;
        one without waste at once. The last round is the one that leaves nothing out."""
        tried: list[list[int]] = []
        seen: set[tuple[int, ...]] = set()

        def fresh(items: list[int]) -> bool:
            if (key := tuple(items)) in seen:
                return False
            seen.add(key)
            self.left -= 1
            if any(dominates(o, items) for o in tried[-8:]):
                return False
            tried.append(items)
            return True

        breadth, whole = 1, False
        while not whole and self.left > 0:
            found: list[tuple[int, list[int]]] = []
            self.cut = False
            every = self.maximal(room, slack, breadth)
            for waste, items in every:
                if not waste and tuple(items) not in seen:
                    cut = self.cut
                    if fresh(items):
                        yield items
                    self.cut = cut
                found.append((waste, items))
                if len(found) == WINDOW * breadth:
                    self.cut = True
                    break
            whole = not self.cut
            found.sort(key=lambda f: (f[0], len(f[1])))
            yield from (x for _, x in found if fresh(x))
            breadth *= 2

    def search(self, best: list[list[int]], bound: int) -> list[list[int]]:
        """Depth first from the largest document on, without recursion; `best` is the incumbent."""
        path: list[list[int]] = []
        waste = [0]

        def branch() -> tuple[int, Iterator[list[int]]]:
            big = self.distinct[-1]
            self.take([big])  # its fillings come from what is beside it
            room = self.capacity - big
            return big, self.fillings(room, (len(best) - 1) * self.capacity - self.total - waste[-1])

        stack = [branch()]
        while stack and len(best) > bound:
            big, choices = stack[-1]
            items = next(choices, None)
            if items is None:  # no filling is left, or no step
                stack.pop()
                self.give([big])
                if path:
                    items = path.pop()
                    self.give(items[1:])
                    waste.pop()
                if self.left <= 0:
                    break
                continue
            lost = waste[-1] + self.capacity - big - sum(items)
            if lost > (len(best) - 1) * self.capacity - self.total:
                continue
            self.take(items)
            if self.distinct:
                path.append([big, *items])
                waste.append(lost)
                stack.append(branch())
            else:
                best = [list(p) for p in path] + [[big, *items]]
                self.give(items)
        return best


def pack(sizes: list[int], capacity: int, steps_per_item: int | None = STEPS) -> list[list[int]]:
    """Containers, each a list of sizes between 1 and the capacity. With steps_per_item None the packing
    is optimal; else, when the search has taken that many steps per document, the best one so far stands."""
    if not sizes:
        return []
    bound, best = lower_bound(np.array(sizes), capacity), best_fit(sizes, capacity)
    if len(best) > bound:
        best = Completion(sizes, capacity, steps_per_item and steps_per_item * len(sizes)).search(best, bound)
    return best


def _pack_block(ids: list[int], tokens: list[int], capacity: int, steps_per_item: int | None = STEPS) -> list[tuple[int, int, int, int, int]]:
    """(container from 0, doc_id, piece from 0, start, tokens) of all pieces of a block."""
    out: list[tuple[int, int, int, int, int]] = []
    rests: dict[int, list[tuple[int, int, int]]] = {}
    nothing, used = [], 0
    for doc, n in zip(ids, tokens):
        whole, rest = divmod(n, capacity)
        for k in range(whole):
            out.append((used, doc, k, k * capacity, capacity))
            used += 1
        if rest:
            rests.setdefault(rest, []).append((doc, whole, whole * capacity))
        elif not whole:
            nothing.append(doc)
    for items in pack([s for s, docs in rests.items() for _ in docs], capacity, steps_per_item):
        for s in items:
            doc, piece, start = rests[s].pop()
            out.append((used, doc, piece, start, s))
        used += 1
    last = max(used - 1, 0)
    out += [(last, doc, 0, 0, 0) for doc in nothing]
    return out


def packed(
    documents: DataFrame, bins: DataFrame, *, id_col: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None, block: int = BLOCK, most_sets: int = 1_000, steps_per_item: int | None = STEPS
) -> DataFrame:
    """(bin_set, capacity, container, doc_id, piece, start, n_tokens): the container of every piece.

    start is the piece's first token in its document. Null and empty documents are pieces of no
    tokens in a container of their block. Repeated rows, and rows of a null id, are packed each for
    itself and spread over the blocks. `bins` is a fixed list of container sets (at most `most_sets`,
    else an error); sets without a positive capacity are an error. An empty table gives no rows.
    `steps_per_item` is the budget of the search in a block; None searches until the packing of each
    block is optimal, which may take long."""
    sets = [(r.bin_set, int(r.capacity)) for r in bins.select("bin_set", "capacity").limit(most_sets + 1).collect()]
    if len(sets) > most_sets or any(c <= 0 for _, c in sets):
        raise ValueError("container sets must be few and have positive capacities")
    # written once, so that a row's place, and with it its block, stays the same whatever executor is lost
    sized = cut_lineage(token_counts(documents.select(F.col(id_col).cast("long").alias("doc_id"), text), text=text, tokenizer=tokenizer, folder=folder))
    blocks = max(1, round(sized.count() / block))
    place = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    each = sized.withColumn("_block", place).withColumn("_set", F.explode(F.lit(list(range(len(sets)))).cast("array<int>"))).select("doc_id", "n_tokens", (F.col("_block") * len(sets) + F.col("_set")).alias("_task"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts).sort_values(["n_tokens", "doc_id"], ascending=False)
        number, k = divmod(int(rows["_task"].iloc[0]), len(sets))
        name, capacity = sets[k]
        ids = rows["doc_id"].astype("Int64").astype(object).where(rows["doc_id"].notna(), None).tolist()
        got = pd.DataFrame(_pack_block(ids, rows["n_tokens"].tolist(), capacity, steps_per_item), columns=["container", "doc_id", "piece", "start", "n_tokens"])
        got["container"] += number << 32
        got.insert(0, "capacity", capacity)
        got.insert(0, "bin_set", name)
        yield got.astype({"doc_id": "Int64"})

    # one partition per block and set, by number: a hash of the number would put several into one
    return each.repartitionById(blocks * max(len(sets), 1), "_task").mapInPandas(run, OUT)


def packing_report(packing: DataFrame) -> DataFrame:
    """(bin_set, capacity, containers, tokens, used_share): how full the containers are."""
    per = packing.groupBy("bin_set", "capacity", "container").agg(F.sum("n_tokens").alias("tokens"))
    total = per.groupBy("bin_set", "capacity").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    return total.withColumn("used_share", F.col("tokens") / (F.col("containers") * F.col("capacity")))
