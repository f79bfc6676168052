"""Mixing overlapping sources to target shares by minimum-cost flow.

A text found under several sources may serve any of them. Texts are taken together by content,
and contents by their set of listed sources, the membership pattern. Tokens flow from patterns
to sources: pattern p may serve source s with at most max_repeats[s] copies of its tokens, the
k-th use of a pattern's tokens costs k - 1 (so repeats come last, and spread), and a source takes
its share of the total at most. The flow of greatest volume and least cost is found on the
driver, over patterns and sources only: their number is bounded by the sets of sources that
occur, refused beyond MAX_PATTERNS, and does not grow with the documents.

Whole documents are then drawn by a seeded hash: each pattern's hash range is laid out among its
sources one after another, and the end of a partial draw is set by the token weights of
BUCKETS hash ranges, so a source misses its flow by less than one range.

Null texts and texts without tokens are left out; unlisted sources and null sources take no part.
A listed source without documents gets nothing, and the report says so.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

MAX_PATTERNS = 5_000
BUCKETS = 4_096


class _Flow:
    """Successive cheapest paths; capacities are whole tokens."""

    def __init__(self):
        self.to, self.cap, self.cost, self.out = [], [], [], {}

    def arc(self, a, b, cap, cost):
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, s, t):
        while True:
            dist, via, queue, queued = {s: 0}, {}, deque([s]), {s}
            while queue:
                v = queue.popleft()
                queued.discard(v)
                for e in self.out.get(v, []):
                    if self.cap[e] > 0 and dist[v] + self.cost[e] < dist.get(self.to[e], 1 << 60):
                        dist[self.to[e]] = dist[v] + self.cost[e]
                        via[self.to[e]] = e
                        if self.to[e] not in queued:
                            queued.add(self.to[e])
                            queue.append(self.to[e])
            if t not in dist:
                return
            room, v = None, t
            while v != s:
                e = via[v]
                room = self.cap[e] if room is None else min(room, self.cap[e])
                v = self.to[e ^ 1]
            v = t
            while v != s:
                e = via[v]
                self.cap[e] -= room
                self.cap[e ^ 1] += room
                v = self.to[e ^ 1]


def route(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens from each pattern to each of its sources. `targets`: source -> (share, max repeats)."""
    flow, arcs = _Flow(), {}
    for p, tokens in patterns.items():
        uses = sum(targets[s][1] for s in p)
        for k in range(uses):
            flow.arc("from", ("p", p), tokens, k)
        for s in p:
            arcs[p, s] = flow.arc(("p", p), ("s", s), tokens * targets[s][1], 0)
    for s, (share, _) in targets.items():
        flow.arc(("s", s), "to", int(round(share * total)), 0)
    flow.run("from", "to")
    return {k: flow.cap[e ^ 1] for k, e in arcs.items() if flow.cap[e ^ 1] > 0}


def contents(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(content, tokens, pattern, of): one row a distinct text under listed sources; `of` has the least doc_id it has in each of them."""
    listed = docs.join(targets.select("source").filter("source IS NOT NULL").distinct(), "source")
    kept = listed.filter("tokens > 0 AND content IS NOT NULL AND doc_id IS NOT NULL")
    each = kept.groupBy("content", "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    # the lists hold at most the listed sources, however often a text repeats
    by = each.groupBy("content").agg(F.max("tokens").alias("tokens"), F.array_sort(F.collect_list(F.struct("source", "doc_id"))).alias("of"))
    return by.withColumn("pattern", F.expr("transform(of, x -> x.source)"))


def mix(docs: DataFrame, targets: DataFrame, seed: int = 7, total: int | None = None) -> DataFrame:
    """(source, doc_id, tokens, copies): the documents drawn for each source.

    `docs`: doc_id, source, content (a hash of the text), tokens. `targets`: source, target_share, max_repeats.
    `total` is the size of the mix in tokens, by default that of all distinct listed texts. Copies of a text within a source
    are one text; a drawn doc_id is one of that source, the least.
    """
    spark = docs.sparkSession
    rows = targets.filter("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").select("source", "target_share", "max_repeats").limit(MAX_PATTERNS + 1).collect()
    want = {r[0]: (float(r[1]), int(r[2])) for r in rows}
    texts = cut(contents(docs, targets.filter(F.col("source").isin(*want) if want else F.lit(False))))
    sums = texts.groupBy("pattern").agg(F.sum("tokens").alias("tokens")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS or len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    have = {tuple(r[0]): int(r[1]) for r in sums}
    flows = route(have, want, total if total is not None else sum(have.values()))
    plan, offset = [], {}
    for (p, s), tokens in sorted(flows.items()):
        whole, part = divmod(tokens, have[p])
        begin = offset.get(p, 0)  # tokens of the pattern's range already promised, going round
        plan.append((list(p), s, int(whole), int(begin), int(part), have[p]))
        offset[p] = (begin + part) % have[p]
    plan_df = spark.createDataFrame(plan, "pattern array<string>, source string, whole long, begin long, part long, have long")
    # position of each hash range in its pattern's tokens: at most MAX_PATTERNS x BUCKETS narrow rows, summed before the shuffle
    spread = texts.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "content"), F.lit(BUCKETS)))
    weights = spread.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("w"))
    from pyspark.sql import Window

    at = weights.withColumn("upto", F.sum("w").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    at = at.select("pattern", "bucket", (F.coalesce("upto", F.lit(0)) + F.col("w") / 2).alias("middle"))
    # the plan has a row a pattern and source, bounded as above
    drawn = spread.join(at, ["pattern", "bucket"]).join(F.broadcast(plan_df), "pattern")
    along = F.pmod(F.col("middle") - F.col("begin"), F.col("have"))
    copies = F.col("whole") + F.when(along < F.col("part"), 1).otherwise(0)
    return drawn.withColumn("copies", copies.cast("int")).filter("copies > 0").select("source", F.expr("filter(of, x -> x.source = source)[0].doc_id").alias("doc_id"), "tokens", "copies")


def report(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, tokens, documents, most_copies) for every listed source."""
    by = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    all_tokens = drawn.agg(F.sum(F.col("tokens") * F.col("copies")).alias("all_tokens"))
    full = targets.filter("source IS NOT NULL").join(by, "source", "left").crossJoin(F.broadcast(all_tokens))  # one row
    return full.select(
        "source", "target_share", F.bround(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("reached_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
