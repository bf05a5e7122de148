"""Problem 2: which memories of a batch repeat something accepted before.

Segment index for edit distance. Words may move, so the strings that are compared are the words of a memory in fixed
orders; S >= 0.8 for texts of n and m words holds exactly when such strings are at most floor((n + m) / 9) insertions
and deletions of a word apart. A string is cut into a fixed number of segments for its length class, at fixed ranks
(``words.segments``); the index stores each segment under class, position and content. A string of the batch is cut in
the same way for its own length class and the one other class that its bound of edits can reach: of all its substrings
these are the only ones that can equal a stored segment. Whoever shares one is a candidate, its MinHash bits and length
are compared, and the bounded edit distance decides. Segments of accepted memories are appended.

The number of segments leaves a pair at the very threshold one chance in a thousand to be missed (one in 250 at 400
words), and pairs closer than that less. Even cuts without fixed ranks would need a probe for every shift that edits
can cause, thousands for a text of 100 words.

The index is a folder of bucketed tables: segments by key, texts by handle. A batch is shuffled to the buckets, the
history is not. An append becomes visible by its marker in the folder, so that one that broke off leaves no trace.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemolith.llm import near_duplicates as N
from mnemolith.llm import words as W
from mnemolith.session import arrow_map, children, discard, materialize, new_path, remove, spread, table, touch

#: repeats_of_history adds whole batches in order: first as many at once as begin within so many rows, then each time
#: as many as the index holds already, so that all its probes together read the index about twice.
ROWS_AT_ONCE = 1_000_000

_SKETCH = "id string, content_hash string, arrived_at timestamp_ntz, batch_id long, n int, fp binary, seq binary, h long, bits array<long>, c int, own array<int>, other array<int>, text string"


def bounded_distance(a: bytes, b: bytes, bound: int) -> int | None:
    """Insertions and deletions between two strings of distinct tokens in one order, or None beyond the bound."""
    if abs(len(a) - len(b)) > 8 * bound:
        return None
    n, m, common = N.common_tokens(a, b)
    distance = n + m - 2 * common
    return distance if distance <= bound else None


def most_edits(n: int, m: int) -> int:
    """The bound of the distance that S >= 0.8 means for n and m words."""
    return (n + m) // 9


def _distance_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    keep = [bounded_distance(a, b, most_edits(len(a) // 8, len(b) // 8)) is not None for a, b in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist())]
    return batch.filter(pa.array(keep, pa.bool_())).select(["fa", "fb"])


def _sketch_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    n, seq, at, found = N.tokenised(batch.column("content").to_pylist())
    fp, h, _, bits = N.sketched_columns(found, at, len(n), keyed=False)
    size = np.array([len(t) for t in found], np.int64)
    own, none = W.length_class(size), np.empty(0, np.int32)
    cuts = [N.lists(N.placed(W.segments(found, c), at, len(n), none), pa.int32()) for c in (own, W.other_class(size))]
    # hash and sequence decide about short texts only
    short = pa.array([k is None for k in fp], pa.bool_())
    none_of = lambda col: pc.if_else(short, col, pa.nulls(len(n), col.type))
    cols = [batch.column("id"), none_of(batch.column("content_hash")), batch.column("arrived_at"), batch.column("batch_id"), pa.array(n, pa.int32()), pa.array(fp, pa.binary()), none_of(pa.array(seq, pa.binary())), pa.array(h, pa.int64()), bits]
    cols += [pa.array(N.placed(own.tolist(), at, len(n), None), pa.int32()), *cuts, batch.column("content")]
    return pa.RecordBatch.from_arrays(cols, schema=pa.schema([pa.field(name, col.type) for name, col in zip("id content_hash arrived_at batch_id n fp seq h bits c own other text".split(), cols)]))


def sketches(memories: DataFrame) -> DataFrame:
    """A row per row of memories: words, fingerprint of their multiset, bits, class, segments and text; hash and sequence of short ones."""
    cols = memories.where("id IS NOT NULL").select("id", "content", F.lower("source_hash").alias("content_hash"), F.col("arrived_at").cast("timestamp_ntz"), F.col("batch_id").cast("long"))
    return materialize(arrow_map(spread(cols), _sketch_batch, _SKETCH))


def first_arrivals(sketched: DataFrame) -> DataFrame:
    """(id, at, content_hash, n, fp, seq, h): one row per id, that of its first arrival; at orders them."""
    order = F.struct(F.expr(f"coalesce(arrived_at, {N.LAST_TIME})").alias("t"), "batch_id", F.coalesce("content_hash", F.lit("")).alias("content_hash"), "n", "fp", "seq", "h")
    rows = sketched.groupBy("id").agg(F.min(order).alias("m"))
    return rows.select("id", F.struct(F.coalesce("m.batch_id", F.lit(-(2**62))).alias("batch_id"), "id").alias("at"), "m.content_hash", "m.n", "m.fp", "m.seq", "m.h")


def _keyed(strings: DataFrame, cut: str, cls: str) -> DataFrame:
    """(key, h): the segments of strings, under class, position and content."""
    placed = strings.select(F.posexplode(cut).alias("position", "segment"), "h", F.expr(cls).alias("c")).where("segment <> 0")
    return placed.select(F.expr("shiftleft(CAST(c + 8 AS BIGINT), 52) | shiftleft(CAST(position AS BIGINT), 32) | (CAST(segment AS BIGINT) & 4294967295L)").alias("key"), "h")


def segments(strings: DataFrame) -> DataFrame:
    """(key, h): the index rows of strings (h, c, own)."""
    return _keyed(strings, "own", "c")


_SHORTER = f"n < 12 * power({W.RATIO!r}D, c + 0.5D)"


def others(strings: DataFrame) -> DataFrame:
    """(key, h): what strings (h, n, c, other) look up besides their own segments."""
    return _keyed(strings, "other", f"IF({_SHORTER}, c - 1, c + 1)")


def probe(index: DataFrame, looked_up: DataFrame, within: bool = False) -> DataFrame:
    """(ha, hb): the strings that look up a segment which another has stored, with bits that allow a pair."""
    old, new = index.alias("o"), looked_up.alias("b")
    on = (F.col("o.key") == F.col("b.key")) & N.first_bits("o.h", "b.h")
    found = new.hint("merge").join(old, on & (F.col("o.h") != F.col("b.h")) if within else on)
    if within:
        return found.select(F.least("o.h", "b.h").alias("ha"), F.greatest("o.h", "b.h").alias("hb"))
    return found.select(F.col("b.h").alias("ha"), F.col("o.h").alias("hb"))


def probed(old: DataFrame | None, strings: DataFrame) -> DataFrame:
    """(ha, hb): candidates of strings among themselves and among the index old."""
    # of two strings of one batch in different classes each could look up the other; the longer one does
    own, other = segments(strings), others(strings if old is not None else strings.where(_SHORTER))
    found = probe(own, own, within=True).unionByName(probe(own, other, within=True))
    if old is not None:
        found = found.unionByName(probe(old, own)).unionByName(probe(old, other))
    return found.distinct()


def greedy_cases(edges: DataFrame) -> DataFrame:
    """(v) of edges (u before v): the later nodes that an accepted earlier one repeats, every node taken in turn.

    A node without an edge from an undecided or accepted earlier node is accepted; its later neighbours are cases
    and drop out with their edges. Repeated until no edge is left, so the outcome is that of going through the nodes
    one by one; a round settles all nodes whose earlier neighbours are settled.
    """
    edges = materialize(edges.select("u", "v").distinct(), narrow=True)
    cases: DataFrame | None = None
    while True:
        later = edges.select(F.col("v").alias("u")).distinct()
        sure = edges.select("u").distinct().join(later.hint("merge"), "u", "left_anti")
        out = materialize(edges.join(sure.hint("merge"), "u").select("v").distinct(), narrow=True)
        cases = out if cases is None else cases.unionByName(out)
        left = edges.join(sure.hint("merge"), "u", "left_anti").join(out.select(F.col("v").alias("u")).hint("merge"), "u", "left_anti").join(out.hint("merge"), "v", "left_anti")
        before, edges = edges, materialize(left.select("u", "v"), narrow=True)
        discard(before)
        if edges.isEmpty():
            return cases


def _alike(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """(fa, fb) of the pairs (ha, hb) whose strings, by their token sets (h, fp, tok), are within the bound."""
    joined = pairs.join(tokens.toDF("ha", "fa", "ta").hint("merge"), "ha").join(tokens.toDF("hb", "fb", "tb").hint("merge"), "hb")
    return arrow_map(joined.select("fa", "fb", "ta", "tb").where("fa <> fb"), _distance_batch, "fa binary, fb binary")


def later_copies(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaders, later): (fp, at) of the first of each class, and (id) of members that are cases by their copies alone.

    The later copies of a text of at least MIN_WORDS words are cases whatever becomes of the first; shorter texts are
    cases by hash and sequence, which only the first of them can decide.
    """
    whole = members.where("fp IS NOT NULL")
    leaders = materialize(whole.groupBy("fp").agg(F.min("at").alias("at")), narrow=True)
    later = whole.select("id", "fp").join(leaders.hint("merge"), "fp").where("id <> at.id").select("id")
    brief = members.where("fp IS NULL AND content_hash <> ''")
    first_of = brief.groupBy("content_hash", "seq").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("size")).where("size > 1")
    short = brief.drop("at").join(first_of.hint("merge"), ["content_hash", "seq"]).where("id <> at.id").select("id")
    return leaders, materialize(later.unionByName(short), narrow=True)


_STRING = ["fp", "h", "n", "bits", "c", "own", "other", "text"]


class History:
    """A segment index in a folder: ``add`` reports the cases of a batch and appends its accepted memories.

    segments (key, h), strings (h, fp, n, bits, text), short texts (content_hash, seq) and the ids that arrived.
    """

    TABLES = {
        "segments": ("key BIGINT, h BIGINT", "key"),
        "strings": ("h BIGINT, fp BINARY, n INT, bits ARRAY<BIGINT>, text STRING", "h"),
        "short": ("content_hash STRING, seq BINARY", "seq"),
        "ids": ("id STRING", "id"),
    }

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.names = spark, path.rstrip("/"), {}
        # as many as shuffles have partitions, so that a batch is shuffled once for itself and for the history
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        for name, (columns, key) in self.TABLES.items():
            self.names[name] = f"mnemolith_{uuid.uuid4().hex}_{name}"
            spark.sql(f"CREATE TABLE {self.names[name]} ({columns}, epoch INT) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")

    def close(self) -> None:
        """Forgets the tables; the folder stays."""
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _epochs(self, kind: str) -> set[int]:
        return {int(x) for x in children(self.spark, f"{self.path}/{kind}")}

    @property
    def empty(self) -> bool:
        return not self._epochs("_ended")

    def old(self, name: str) -> DataFrame:
        """The rows of a table whose append ended."""
        torn = self._epochs("_begun") - self._epochs("_ended")
        rows = self.spark.table(self.names[name])
        return (rows.where(~F.col("epoch").isin(*torn)) if torn else rows).drop("epoch")

    def _append(self, name: str, rows: DataFrame, epoch: int) -> None:
        key = self.TABLES[name][1]
        rows.withColumn("epoch", F.lit(epoch)).repartition(self.buckets, key).write.insertInto(self.names[name])

    def append(self, **rows: DataFrame) -> None:
        """Appends rows to tables, all or nothing."""
        epoch = 1 + max(self._epochs("_begun"), default=0)
        touch(self.spark, f"{self.path}/_begun/{epoch}")
        for name, part in rows.items():
            self._append(name, part, epoch)
        touch(self.spark, f"{self.path}/_ended/{epoch}")

    def near(self, strings: DataFrame) -> DataFrame:
        """(fp) of the strings (_STRING, at), one of each class, that repeat an accepted one, before or among them."""
        old = None if self.empty else self.old("strings")
        now = strings.select("h", "n", "bits")
        known = now if old is None else now.unionByName(old.select("h", "n", "bits"))
        pairs = N.closer(probed(None if old is None else self.old("segments"), strings), known, known).unionByName(N.one_handle(known))
        pairs = materialize(pairs, narrow=True)
        named = pairs.select(F.col("ha").alias("h")).union(pairs.select("hb")).distinct()
        texts = strings.join(named.hint("merge"), "h", "left_semi").select("h", "fp", F.col("text").alias("t"))
        if old is not None:
            texts = texts.unionByName(old.join(named.hint("merge"), "h", "left_semi").select("h", "fp", F.col("text").alias("t")))
        tokens = materialize(N.tokens_of(texts))
        links = materialize(_alike(pairs, tokens), narrow=True)
        leaders = strings.select("fp", "at")
        out, free = [], links
        if old is not None:
            # whoever is not of this batch was accepted before it
            both = links.unionByName(links.select(F.col("fb").alias("fa"), F.col("fa").alias("fb")))
            of_batch = both.join(leaders.select(F.col("fp").alias("fa")).hint("merge"), "fa", "left_semi")
            blocked = of_batch.join(leaders.select(F.col("fp").alias("fb")).hint("merge"), "fb", "left_anti").select(F.col("fa").alias("fp")).distinct()
            out.append(blocked := materialize(blocked, narrow=True))
            # what history blocks cannot block others
            for end in ("fa", "fb"):
                free = free.join(blocked.select(F.col("fp").alias(end)).hint("merge"), end, "left_anti")
        edges = free.join(leaders.toDF("fa", "aa").hint("merge"), "fa").join(leaders.toDF("fb", "ab").hint("merge"), "fb")
        first, second = F.struct("aa.batch_id", "aa.id", F.col("fa").alias("fp")), F.struct("ab.batch_id", "ab.id", F.col("fb").alias("fp"))
        cases = greedy_cases(edges.select(F.least(first, second).alias("u"), F.greatest(first, second).alias("v")))
        out.append(cases.select("v.fp"))
        found = materialize(out[0] if len(out) == 1 else out[0].unionByName(out[1]), narrow=True)
        discard(pairs, tokens, links, *out[:-1])
        return found

    def add(self, batch: DataFrame) -> DataFrame:
        """(id) of the cases of this batch, which may hold several batch_id; its other memories are appended.

        A memory whose id arrived in an earlier batch is neither a case nor a new one. A null batch_id counts as the
        first batch; rows without an id are left out; an empty batch has no cases.
        """
        sketched = sketches(batch)
        arrived = first_arrivals(sketched)
        fresh = self.empty
        members = materialize(arrived if fresh else arrived.join(self.old("ids").hint("merge"), "id", "left_anti"), narrow=True)
        leaders, cases = later_copies(members)
        if not fresh:
            copies = members.join(self.old("strings").select("fp").hint("merge"), "fp", "left_semi").select("id")
            same = members.where("fp IS NULL AND content_hash <> ''").join(self.old("short").hint("merge"), ["content_hash", "seq"], "left_semi").select("id")
            cases = cases.unionByName(copies).unionByName(same).distinct()
        left = materialize(members.join(cases.hint("merge"), "id", "left_anti"), narrow=True)
        strings = materialize(sketched.select(*_STRING).join(left.select("fp", "at").hint("merge"), "fp").dropDuplicates(["fp"]))
        near = self.near(strings)
        cases = materialize(cases.unionByName(left.join(near.hint("merge"), "fp", "left_semi").select("id")), narrow=True)
        accepted = strings.join(near.hint("merge"), "fp", "left_anti")
        short = left.where("fp IS NULL AND content_hash <> ''").select("content_hash", "seq")
        self.append(segments=segments(accepted), strings=accepted.select("h", "fp", "n", "bits", "text"), short=short, ids=members.select("id"))
        discard(sketched, members, leaders, left, strings, near)
        return cases


def repeats_of_history(memories: DataFrame, rows_at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """(id) of every memory that repeats one accepted before it in the order (batch_id, id).

    The batches go through an index in their order, whole ones and several at once (ROWS_AT_ONCE). All memories are
    sketched once, and what is a case by a copy alone is settled before. Alike by N.near_duplicate_pairs'
    rule, or the same non-empty source_hash regardless of case and the same words in the same order. A null batch_id
    counts as the first batch; rows without an id are left out; repeated rows of an id count once, by their first
    arrival; an empty table gives no rows.
    """
    spark = memories.sparkSession
    sketched = sketches(memories)
    firsts = materialize(first_arrivals(sketched), narrow=True)
    # one row per batch
    sizes = firsts.groupBy(F.col("at.batch_id").alias("batch_id")).agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1))
    steps = sizes.select("batch_id", F.floor(F.log2(F.greatest(F.coalesce(before, F.lit(0)) / rows_at_once, F.lit(0.5)))).alias("step"))
    ends = [tuple(r) for r in steps.groupBy("step").agg(F.min("batch_id"), F.max("batch_id")).orderBy("step").toLocalIterator()]
    leaders, cases = later_copies(firsts)
    strings = materialize(sketched.select(*_STRING).join(leaders.hint("merge"), "fp").dropDuplicates(["fp"]))
    discard(sketched)
    folder = new_path(spark)
    history = History(spark, folder)
    found = cases
    try:
        for step, low, high in ends:
            now = strings if len(ends) == 1 else materialize(strings.where(F.col("at.batch_id").between(low, high)))
            near = history.near(now)
            found = found.unionByName(leaders.join(near.hint("merge"), "fp").select(F.col("at.id").alias("id")))
            # nothing comes after the last batch
            if step < ends[-1][0]:
                accepted = now.join(near.hint("merge"), "fp", "left_anti")
                history.append(segments=segments(accepted), strings=accepted.select("h", "fp", "n", "bits", "text"))
            if now is not strings:
                discard(now)
    finally:
        history.close()
        remove(spark, folder)
    discard(strings, firsts)
    return found


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_of_history(table(spark, sf_dir, "memories"))


def p2_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch_id, memories, repeats): for each batch its memories and how many of them repeat accepted ones."""
    memories = table(spark, sf_dir, "memories")
    order = F.struct(F.expr(f"coalesce(arrived_at, {N.LAST_TIME})").alias("t"), "batch_id")
    firsts = memories.where("id IS NOT NULL").groupBy("id").agg(F.min(order).alias("m")).select("id", "m.batch_id")
    found = repeats_of_history(memories).withColumn("case", F.lit(1))
    joined = firsts.join(found.hint("merge"), "id", "left")
    return joined.groupBy("batch_id").agg(F.count(F.lit(1)).alias("memories"), F.sum(F.coalesce("case", F.lit(0))).alias("repeats"))
