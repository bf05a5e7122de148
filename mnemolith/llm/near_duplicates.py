"""Problem 1: memories that are alike although words were changed, added, dropped or moved.

Bayesian candidate pruning. Exact copies (equal word multisets) are merged into classes first, so no key is hot
because of copies. Classes that share a key, a band of MinHash values (see ``words.sketches``), are candidates. Bits of
their MinHash values are compared in steps of 16, 40, 64 and 192; after each step a pair is dropped when, by Bayes' rule
with a uniform prior, the probability that its similarity reaches the threshold falls below ``TOLERANCE``. What remains
is verified on the words.

The key index is 50 times as long as the collection, which the planner cannot know, so its joins are merge joins; a key
that holds many unlike classes is split by the adaptive skew join.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolith.llm import words as W
from mnemolith.operators.components import connected_components
from mnemolith.session import arrow_map, discard, materialize, spread, table

THRESHOLD = 0.8
MIN_WORDS = 12
#: Posterior probability below which a pair is dropped; a pair at the threshold itself is so lost once in 2,000.
TOLERANCE = 1e-4
#: Groups of exact copies up to this size come out as all their pairs; in a larger one each copy is paired with the
#: smallest id of the group, and other pairs name that id (class representatives; near_duplicate_groups has the members).
#: None expands every group.
EXPAND: int | None = 50


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column of arrays."""
    ends = np.cumsum([0, *(len(p) for p in parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def tokenised(texts: list[str | None]) -> tuple[list[int], list[bytes | None], list[int], list[np.ndarray]]:
    """(number of words, digest of their sequence if fewer than MIN_WORDS) of each text, and (place, token set) of the others."""
    n, seq, at, found = [], [], [], []
    for k, text in enumerate(texts):
        words = W.words(text)
        n.append(len(words))
        # the sequence decides about short texts only
        seq.append(xxhash.xxh3_128_digest("\0".join(words).encode("utf-8", "surrogatepass")) if len(words) < MIN_WORDS else None)
        if len(words) >= MIN_WORDS:
            at.append(k)
            found.append(W.tokens(words))
    return n, seq, at, found


def placed(values: list, at: list[int], size: int, empty) -> list:
    """A list of size entries with values at the places at."""
    out = [empty] * size
    for k, v in zip(at, values):
        out[k] = v
    return out


def handles(fps: list[bytes], bits: np.ndarray) -> list[int]:
    """40 MinHash bits and 24 bits of the fingerprint in one number.

    Two classes with one handle (about one in 10 million pairs of alike texts) are candidates by that alone, and what a
    handle names is always verified on its own words.
    """
    return [(int(b[0]) & ~0xFFFFFF) | int.from_bytes(fp[:3], "big") for fp, b in zip(fps, bits)]


def sketched_columns(found: list[np.ndarray], at: list[int], size: int, keyed: bool = True) -> tuple[list, list, np.ndarray, pa.Array]:
    """(fingerprints, handles, keys if keyed, column of bits)."""
    keys, bits = W.sketches(found, keyed) if found else (np.empty((0, W.KEYS), np.int32), np.empty((0, sum(W.BITS) // 64), np.int64))
    fps = [xxhash.xxh3_128_digest(t.tobytes()) for t in found]
    none = np.empty(0, np.int64)
    return placed(fps, at, size, None), placed(handles(fps, bits), at, size, None), keys, lists(placed(list(bits), at, size, none), pa.int64())


def _sketch_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    n, _, at, found = tokenised(batch.column("content").to_pylist())
    fp, h, keys, bits = sketched_columns(found, at, len(n))
    keys = lists(placed(list(keys), at, len(n), np.empty(0, np.int32)), pa.int32())
    cols = [batch.column("id"), batch.column("arrived_at"), pa.array(n, pa.int32()), pa.array(fp, pa.binary()), pa.array(h, pa.int64()), bits, keys]
    return pa.RecordBatch.from_arrays(cols, names=["id", "arrived_at", "n", "fp", "h", "bits", "keys"])


_SKETCH = "id string, arrived_at timestamp_ntz, n int, fp binary, h long, bits array<long>, keys array<int>"
LAST_TIME = "CAST('9999-12-31' AS TIMESTAMP_NTZ)"


@lru_cache
def least_equal_bits(bits: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The smallest number of equal bits of so many at which P(similarity >= threshold) is at least tolerance."""
    s = (np.arange(20_000) + 0.5) / 20_000
    p = (1 + s) / 2
    for equal in range(bits + 1):
        log = equal * np.log(p) + (bits - equal) * np.log1p(-p)
        weight = np.exp(log - log.max())
        if weight[s >= threshold].sum() >= tolerance * weight.sum():
            return equal
    return bits


def first_bits(a: str, b: str) -> Column:
    """The bits in two handles, compared in two steps."""
    keep = F.lit(True)
    for n, shift in ((16, 48), (40, 24)):
        keep = keep & (F.expr(f"bit_count(shiftrightunsigned({a} ^ {b}, {shift}))") <= n - least_equal_bits(n))
    return keep


def all_bits(a: str, b: str) -> Column:
    """All bits of two sketches, the first 64 before the rest."""
    total, first = sum(W.BITS), W.BITS[0]
    some = F.expr(f"bit_count({a}[0] ^ {b}[0])") <= first - least_equal_bits(first)
    return some & (F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (m, v) -> m + v)") <= total - least_equal_bits(total))


def closer(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs (ha, hb) that sizes and all bits still allow; a and b are (h, n, bits)."""
    joined = pairs.join(a.select("h", "n", "bits").toDF("ha", "na", "xa").hint("merge"), "ha").join(b.select("h", "n", "bits").toDF("hb", "nb", "xb").hint("merge"), "hb")
    return joined.where((F.least("na", "nb") >= THRESHOLD * F.greatest("na", "nb")) & all_bits("xa", "xb")).select("ha", "hb").distinct()


def candidates(classes: DataFrame) -> DataFrame:
    """(ha, hb): pairs of classes (h, n, bits, keys) that share a key and may be alike by their bits."""
    rows = classes.select(F.posexplode("keys").alias("j", "k"), "h").select(F.expr("shiftleft(CAST(j AS BIGINT), 32) | (CAST(k AS BIGINT) & 4294967295L)").alias("key"), "h")
    left, right = rows.alias("l"), rows.hint("merge").alias("r")
    found = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.h") < F.col("r.h")) & first_bits("l.h", "r.h"))
    return closer(found.select(F.col("l.h").alias("ha"), F.col("r.h").alias("hb")).distinct(), classes, classes).unionByName(one_handle(classes))


def one_handle(classes: DataFrame) -> DataFrame:
    """(ha, hb), both the same: the handles that several classes have."""
    return classes.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("h").alias("ha"), F.col("h").alias("hb"))


def _tokens_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [W.tokens(W.words(t)).tobytes() for t in batch.column("t").to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column("h"), batch.column("fp"), pa.array(found, pa.binary())], names=["h", "fp", "tok"])


def tokens_of(texts: DataFrame) -> DataFrame:
    """(h, fp, tok) of (h, fp, t)."""
    return arrow_map(texts.select("h", "fp", "t"), _tokens_batch, "h long, fp binary, tok binary")


def common_tokens(a: bytes, b: bytes) -> tuple[int, int, int]:
    """(sizes of two token sets, size of what they share)."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = np.concatenate([x, y])
    both.sort()
    return len(x), len(y), int(np.count_nonzero(both[1:] == both[:-1]))


def _verify_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    keep = []
    for a, b in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist()):
        n, m, common = common_tokens(a, b)
        keep.append(common / (n + m - common) >= THRESHOLD - 1e-12 and a != b)
    return batch.filter(pa.array(keep, pa.bool_())).select(["fa", "fb"])


def alike_classes(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links): (id, fp) of every memory of at least MIN_WORDS words, and all pairs (fa, fb) of alike classes.

    Rows without an id are left out; a null text has no words; of the rows of an id its first arrival counts.
    """
    cols = memories.where("id IS NOT NULL").select("id", "content", F.col("arrived_at").cast("timestamp_ntz"))
    sketched = materialize(arrow_map(spread(cols), _sketch_batch, _SKETCH))
    order = F.struct(F.expr(f"coalesce(arrived_at, {LAST_TIME})").alias("t"), "n", "fp", "h")
    firsts = materialize(sketched.groupBy("id").agg(F.min(order).alias("m")).select("id", "m.fp", "m.h").where("fp IS NOT NULL"), narrow=True)
    classes = materialize(sketched.where("fp IS NOT NULL").select("fp", "h", "n", "bits", "keys").dropDuplicates(["fp"]).drop("fp"))
    discard(sketched)
    pairs = materialize(candidates(classes), narrow=True)
    discard(classes)
    wanted = pairs.select(F.col("ha").alias("h")).union(pairs.select("hb")).distinct()
    reps = firsts.groupBy("fp", "h").agg(F.min("id").alias("id")).join(wanted.hint("merge"), "h")
    texts = cols.join(reps.hint("merge"), "id").groupBy("h", "fp", "id").agg(F.min_by("content", F.expr(f"coalesce(arrived_at, {LAST_TIME})")).alias("t"))
    tokens = materialize(tokens_of(texts))
    joined = pairs.join(tokens.toDF("ha", "fa", "ta").hint("merge"), "ha").join(tokens.toDF("hb", "fb", "tb").hint("merge"), "hb")
    links = materialize(arrow_map(joined.select("fa", "fb", "ta", "tb"), _verify_batch, "fa binary, fb binary").select(F.least("fa", "fb").alias("fa"), F.greatest("fa", "fb").alias("fb")).distinct(), narrow=True)
    discard(pairs, tokens)
    return firsts.select("id", "fp"), links


def near_duplicate_pairs(memories: DataFrame, expand: int | None = -1) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of different memories of at least MIN_WORDS words with S >= THRESHOLD.

    Copies of one text beyond expand (EXPAND unless given; None for no limit) are paired with the smallest id of their
    group only. Null ids and texts, and texts of fewer words, have no pairs; rows repeated under one id count once; an
    empty table gives no rows.
    """
    most = EXPAND if expand == -1 else expand
    members, links = alike_classes(memories)
    sized = members.groupBy("fp").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("rep"))
    named = materialize(members.join(sized.hint("merge"), "fp"), narrow=True)
    small = F.lit(True) if most is None else F.col("size") <= most
    ends = named.where(small | (F.col("id") == F.col("rep"))).select("fp", "id")
    across = links.join(ends.toDF("fa", "ia").hint("merge"), "fa").join(ends.toDF("fb", "ib").hint("merge"), "fb").select("ia", "ib")
    many = named.where("size > 1")
    few = many.where(small).select("fp", "id")
    within = few.toDF("fp", "ia").join(few.toDF("fp", "ib").hint("merge"), "fp").where("ia < ib").select("ia", "ib")
    star = many.where(~small & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("ia"), F.col("id").alias("ib"))
    return across.unionByName(within).unionByName(star).select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))


def near_duplicate_groups(memories: DataFrame) -> DataFrame:
    """(id, group_id, rep_id, copies, links): a row per memory of at least MIN_WORDS words.

    group_id is the smallest id that is alike directly or through others, rep_id the smallest id of the same words,
    copies the number of memories of the same words, links the number of other classes alike to its own.
    """
    members, links = alike_classes(memories)
    sized = members.groupBy("fp").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("rep"))
    degree = links.select(F.col("fa").alias("fp")).unionAll(links.select("fb")).groupBy("fp").agg(F.count(F.lit(1)).alias("links"))
    reps = sized.select("fp", "rep")
    named = links.join(reps.toDF("fa", "ra").hint("merge"), "fa").join(reps.toDF("fb", "rb").hint("merge"), "fb")
    labels = connected_components(named, "ra", "rb")
    groups = sized.join(degree.hint("merge"), "fp", "left").join(labels.select(F.col("node").alias("rep"), "label").hint("merge"), "rep", "left")
    groups = groups.select("fp", F.coalesce("label", "rep").alias("group_id"), F.col("rep").alias("rep_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return members.join(groups.hint("merge"), "fp").select("id", "group_id", "rep_id", "copies", "links")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_pairs(table(spark, sf_dir, "memories"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "memories"))
