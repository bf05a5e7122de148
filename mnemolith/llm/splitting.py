"""Problem 3: sections over a size limit in pieces under it, cut where the text pauses, with an overlap.

Pointer doubling. For every boundary of a section the farthest legal successor is found at once (a sorted search over
all boundaries); the table of successors is squared again and again, so that the cuts which the greedy walk from the
start would make come out in a logarithmic number of whole-array steps.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolith.session import arrow_map, table

#: Limits in tokens of four UTF-8 bytes.
LIMIT, OVERLAP = 300, 30

_HEADING = re.compile(r"#{1,6} ")
_FENCE = ("```", "~~~")
#: Pauses from the strongest to the weakest; the end of a match is a boundary.
_PAUSES = (
    re.compile(r"\n\s*\n+"),
    re.compile(r"\n+"),
    re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？｡।॥]+[”’」』）]*"),
    re.compile(r"[,;:]\s+|[，、；：]"),
    re.compile(r"\s+"),
)


def sections(content: str) -> list[tuple[int, str | None, str]]:
    """(section_no, heading, text) of a content; text is stripped, heading is its first line without the marks."""
    out, lines, no, heading, fence = [], [], 0, None, None
    for line in content.split("\n"):
        if fence:
            if line.startswith(fence):
                fence = None
        elif line.startswith(_FENCE):
            fence = line[:3]
        elif _HEADING.match(line):
            out.append((no, heading, "\n".join(lines).strip()))
            lines, no, heading = [], no + 1, line.lstrip("#").strip()
        lines.append(line)
    out.append((no, heading, "\n".join(lines).strip()))
    return out


def tokens_of(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass")) // 4


def _offsets(text: str) -> np.ndarray:
    """Byte offset of every code point, and of the end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    return np.concatenate([[0], np.cumsum(width)]).astype(np.int64)


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, body, end) in code points: a piece is text[start:end], and text[start:body] is the end of the one before.

    The bodies follow each other without gap. A text within the limit is one piece. A piece ends at the strongest kind
    of pause that still fills more than half of the room, at the farthest of that kind; without any pause between two
    code points. The overlap begins at a word where there is one.
    """
    at = _offsets(text)
    size, room, back = int(at[-1]), 4 * limit, 4 * overlap
    if size // 4 <= limit:
        return [(0, 0, len(text))]
    n = len(text)
    starts = np.unique(np.concatenate([[0], [m.end() for m in _PAUSES[-1].finditer(text)], [m.end() for m in _PAUSES[2].finditer(text)]]).astype(np.int64))
    marks = np.arange(n + 1)
    # where the overlap of a piece whose body begins at each code point starts
    least = np.searchsorted(at, at - back, "left")
    word = starts[np.minimum(np.searchsorted(starts, least, "left"), len(starts) - 1)]
    start = np.where((word >= least) & (word < marks), word, least)
    start[0] = 0
    last = np.searchsorted(at, at[start] + room, "right") - 1
    last = np.maximum(last, np.minimum(marks + 1, n))
    half = np.searchsorted(at, (at[marks] + at[last]) // 2, "left")
    succ = np.where(last == n, n, -1)
    for kind in _PAUSES:
        ends = np.unique(np.array([m.end() for m in kind.finditer(text)], np.int64))
        if len(ends):
            far = ends[np.maximum(np.searchsorted(ends, last, "right") - 1, 0)]
            succ = np.where((succ < 0) & (far <= last) & (far > np.maximum(half, marks)), far, succ)
    succ = np.where(succ < 0, last, succ)
    succ[n] = n
    # doubling: reached holds the first 2^k cuts, jump leads 2^k cuts on
    reached, jump = np.array([0]), succ
    while reached[-1] < n:
        reached = np.concatenate([reached, jump[reached]])
        jump = jump[jump]
    cuts = np.unique(reached)
    return [(int(start[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:])]


_SCHEMA = "id string, section_no int, piece_no int, heading string, start int, body int, end int, n_tokens int, piece string"


def _split_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for id_, content in zip(batch.column("id").to_pylist(), batch.column("content").to_pylist()):
        for no, heading, text in sections(content):
            if tokens_of(text) > LIMIT:
                for k, (start, body, end) in enumerate(pieces(text)):
                    rows.append((id_, no, k, heading, start, body, end, tokens_of(text[start:end]), text[start:end]))
    names = ["id", "section_no", "piece_no", "heading", "start", "body", "end", "n_tokens", "piece"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 9, kinds)], names=names)


def split_sections(memories: DataFrame) -> DataFrame:
    """A row per piece of every section over LIMIT tokens, positions counted within the stripped section.

    Each memory counts once, by its first arrival. Null and short contents have no pieces; an empty table gives none.
    Texts that cannot hold such a section are left out by their length before anything is shuffled.
    """
    long = memories.where(F.col("id").isNotNull() & (F.octet_length("content") >= 4 * (LIMIT + 1)))
    # the content of the first arrival; a later row under the same id has the same one, and counts only if it is alone
    once = long.select("id", "content", "arrived_at").groupBy("id").agg(F.min_by("content", F.coalesce("arrived_at", F.lit("9999-12-31").cast("timestamp_ntz"))).alias("content"))
    return arrow_map(once, _split_batch, _SCHEMA)


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sections(table(spark, sf_dir, "memories"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections that were split."""
    return p3_pieces(spark, sf_dir).where("piece_no = 0").select("id", "section_no")
