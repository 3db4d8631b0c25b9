"""Operator 7: hierarchical packing of documents into windows of several lengths.

Lengths are tokens of the byte-level BPE of operator 9. A document goes to the shortest
tier whose windows hold it; one that is longer than the longest windows is cut into pieces of
that length and a rest, which goes to its own tier. Tiers are packed from the longest to the
shortest by best fit, longest pieces first; then the gaps of a tier's windows are filled with
pieces of the shorter tiers, again the longest first, each in the window that it fits best,
before these tiers are packed themselves. Windows of a tier are dealt by falling fill, back and
forth, to step groups of `step_tokens` capacity, so that the groups carry about the same load.

Best fit depends on the lengths alone, so it is planned on their histogram, which has no more
rows than the longest window has tokens, whatever the size of the corpus: windows of equal
contents are one entry with a multiplicity. A piece finds its place from its rank among the
pieces of its length, by arithmetic. Texts are read once, and only ids and lengths are shuffled.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.llm import bpe
from wordloom.llm._store import Workspace

TIERS = (512, 2048, 8192)
STEP_TOKENS = 65536
#: The ranks of one length are counted in so many parts, so that a frequent length is spread.
_PARTS = 32


@dataclass
class _Windows:
    """`times` windows of the same contents: (length, first rank, pieces in each window) of each entry, and the room left."""

    times: int
    room: int
    items: list[tuple[int, int, int]] = field(default_factory=list)

    def split(self, times: int) -> _Windows:
        """Take `times` windows away and return them."""
        taken = _Windows(times, self.room, list(self.items))
        self.items = [(n, rank + times * k, k) for n, rank, k in self.items]
        self.times -= times
        return taken


class _Open:
    """Windows by room left."""

    def __init__(self) -> None:
        self.by_room: dict[int, list[_Windows]] = {}
        self.rooms: list[int] = []

    def add(self, w: _Windows) -> None:
        if w.room not in self.by_room:
            self.by_room[w.room] = []
            bisect.insort(self.rooms, w.room)
        self.by_room[w.room].append(w)

    def best(self, n: int) -> _Windows | None:
        """Windows of the least room that holds n, taken out."""
        at = bisect.bisect_left(self.rooms, n)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        found = self.by_room[room].pop()
        if not self.by_room[room]:
            del self.by_room[room]
            self.rooms.pop(at)
        return found

    def all(self) -> list[_Windows]:
        return [w for r in self.rooms for w in self.by_room[r]]


def _place(open_: _Open, n: int, rank: int, count: int) -> int:
    """Put pieces of length n into open windows by best fit; the number that found no room."""
    while count:
        w = open_.best(n)
        if w is None:
            break
        each = w.room // n
        whole = min(w.times, count // each)
        if whole:
            full = w.split(whole) if whole < w.times else w
            full.items.append((n, rank, each))
            full.room -= each * n
            open_.add(full)
            rank, count = rank + whole * each, count - whole * each
            if full is w:
                continue
        if count:  # fewer than `each` are left for one more window
            part = w.split(1) if w.times > 1 else w
            part.items.append((n, rank, count))
            part.room -= count * n
            rank, count = rank + count, 0
            open_.add(part)
            if part is w:
                continue
        open_.add(w)
    return count


def plan(lengths: dict[int, int], tiers: tuple[int, ...] = TIERS) -> dict[int, list[_Windows]]:
    """Windows of each tier for so many pieces of each length, by falling fill."""
    left = {n: c for n, c in sorted(lengths.items(), reverse=True) if c}
    next_rank = dict.fromkeys(left, 0)
    out = {}
    for number in reversed(range(len(tiers))):
        capacity, below = tiers[number], tiers[number - 1] if number else 0
        open_ = _Open()
        for n in [n for n in left if n > below]:
            count = left.pop(n)
            rest = _place(open_, n, next_rank[n], count)
            rank = next_rank[n] + count - rest
            each = capacity // n
            for times, k in ((rest // each, each), (1, rest % each)):
                if times and k:
                    open_.add(_Windows(times, capacity - k * n, [(n, rank, k)]))
                    rank += times * k
        for n in list(left):
            rest = _place(open_, n, next_rank[n], left[n])
            next_rank[n] += left[n] - rest
            left[n] = rest
            if not rest:
                del left[n]
        out[capacity] = sorted(open_.all(), key=lambda w: w.room)
    return out


def slots(planned: dict[int, list[_Windows]]) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """(length, first rank, rank behind the last, pieces in each window, offset in the window, tier, number of the first window, windows of the tier)."""
    out = []
    for tier, windows in planned.items():
        total, first = sum(w.times for w in windows), 0
        for w in windows:
            offset = 0
            for n, rank, k in w.items:
                out.append((n, rank, rank + k * w.times, k, offset, tier, first, total))
                offset += n * k
            first += w.times
    return out


_SLOTS = "slot_tokens int, lo long, hi long, each int, start int, tier int, first_window long, windows long"


def pack(spark: SparkSession, docs: DataFrame, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """(doc_id, part, first_token, n_tokens, tier, window, offset, step_group): where each piece of each document goes.

    part counts the pieces of a document, first_token is the piece's first token in it, window
    counts the windows of its tier and step_group those windows' groups. Documents without tokens
    (null and empty texts) are not packed. Each row is a document, also one whose doc_id
    is null or repeated; rows alike in id and length are interchangeable.
    """
    if not tiers or list(tiers) != sorted(set(tiers)) or tiers[0] < 1 or step_tokens < tiers[-1]:
        raise ValueError("tiers must rise, and step_tokens hold the longest window")
    work, top = Workspace(spark), tiers[-1]
    counted = bpe.token_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), vocabulary)
    sized = work.save(counted.where("n_tokens > 0").select("doc_id", F.col("n_tokens").alias("tokens")), "lengths")
    pieces = sized.select(
        "doc_id", "tokens", F.explode(F.expr(f"sequence(0, cast((tokens - 1) DIV {top} AS int))")).alias("part")
    ).select(
        "doc_id",
        "part",
        F.expr(f"cast(part AS long) * {top}").alias("first_token"),
        F.expr(f"least({top}, tokens - cast(part AS long) * {top})").cast("int").alias("n_tokens"),
        F.pmod(F.xxhash64("doc_id", "part"), F.lit(_PARTS)).cast("int").alias("__wl_part"),
    )
    counts = work.save(pieces.groupBy("n_tokens", "__wl_part").agg(F.count("*").alias("n")), "counts")
    lengths = {r["n_tokens"]: r["n"] for r in counts.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}  # at most `top` rows
    table = spark.createDataFrame(slots(plan(lengths, tiers)), _SLOTS)
    before = Window.partitionBy("n_tokens").orderBy("__wl_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("n_tokens", "__wl_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("n_tokens", "__wl_part").orderBy("doc_id", "part")
    ranked = pieces.withColumn("at", F.row_number().over(within) - 1).join(base, ["n_tokens", "__wl_part"]).withColumn("rank", F.col("at") + F.col("base"))
    # the slots' number is bounded by the longest window, so this side stays small at any size
    placed = ranked.join(F.broadcast(table), (F.col("n_tokens") == F.col("slot_tokens")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    window = F.expr("first_window + (rank - lo) DIV each")
    groups = F.expr(f"cast(ceil(windows / ({step_tokens} DIV tier)) AS long)")
    turn = F.expr("window DIV groups % 2")
    return (
        placed.withColumn("window", window)
        .withColumn("offset", F.expr("cast(start + (rank - lo) % each * n_tokens AS int)"))
        .withColumn("groups", groups)
        .withColumn("step_group", F.when(turn == 0, F.expr("window % groups")).otherwise(F.expr("groups - 1 - window % groups")))
        .select("doc_id", "part", "first_token", "n_tokens", "tier", "window", "offset", "step_group")
    )


def windows(spark: SparkSession, docs: DataFrame, placed: DataFrame, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """(tier, window, step_group, doc_ids, starts, tokens): the windows themselves; document i's tokens begin at starts[i].

    placed is what pack gave for docs, whose doc_ids must be unique; rows with a null doc_id are
    left out. A window has at most its tier's tokens, so no group grows with the data.
    """
    tokens = bpe.encode_column(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), vocabulary).select("doc_id", "tokens")
    pieces = placed.join(tokens, "doc_id").select(
        "tier", "window", "step_group", F.struct("offset", "doc_id", F.expr("slice(tokens, cast(first_token AS int) + 1, n_tokens)").alias("tokens")).alias("p")
    )
    whole = pieces.groupBy("tier", "window", "step_group").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return whole.select("tier", "window", "step_group", F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts"), F.flatten("p.tokens").alias("tokens"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of every document goes."""
    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
