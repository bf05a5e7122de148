"""Into and out of the store: Markdown files, conversations, idempotent writes, redaction, snapshots."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemolith import tables as T
from mnemolith.session import table

C = T.Catalogue()

# fixed values: signals that are counted where they occur, also inside words; one of them counts twice
POSITIVE = "great|awesome|perfect|thanks|thank you|love|loved|excellent|amazing|wonderful|fantastic|brilliant|superb|helpful|impressive|nice|good|best|better|happy|glad|pleased|satisfied|excited|thrilled|enjoyed|wow|cool|sweet|yes|yeah|yay|works great|solved|fixed|resolved|success|successful".split("|")
NEGATIVE = "frustrated|frustrating|annoying|annoyed|broken|hate|terrible|awful|horrible|worst|bad|failed|failure|error|bug|issue|problem|not working|doesn't work|cant stand|can't stand|disappointed|disappointing|upset|angry|mad|furious|annoyed|irritated|sucks|sucked|difficult|hard|struggle|struggling|confused|confusing".split("|")
ENGAGED = "because|since|however|but|also| moreover|therefore|explained|described|detailed|basically|essentially|actually|really|very|extremely|incredibly|question|wondering|curious|want to know|figured out|discovered|realized|found that|notice|observed".split("|")
PASSIVE = "ok|okay|sure|whatever|alright|fine|i see|noted|understood|acknowledged|received|k".split("|")


def _hits(words: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(low, '{w.replace(chr(39), chr(39) * 2)}') THEN 1 ELSE 0 END" for w in words) + ")"


_REACTION = f"greatest(-1.0, least(1.0, CAST({_hits(POSITIVE)} - {_hits(NEGATIVE)} AS DOUBLE) / greatest(n, 10) * 5 * (1 + {_hits(ENGAGED)} * CAST(0.1 AS DOUBLE)) * (1 - least({_hits(PASSIVE)} * CAST(0.2 AS DOUBLE), CAST(0.5 AS DOUBLE)))))"


@C.add(f"WITH {T.MEM}, l AS (SELECT id, lower(content) AS low, greatest(1, len(list_filter(regexp_split_to_array(content, '[ \\t\\n\\r]+'), lambda w: w <> ''))) AS n FROM mem) SELECT id, round({_REACTION}, 5) AS reaction FROM l")
def reaction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.memories(spark, sf_dir).selectExpr("id", "lower(content) AS low", "greatest(1, size(filter(split(content, '[ \\\\t\\\\n\\\\r]+'), w -> w <> ''))) AS n")
    sql = re.sub(r"contains\(low, '((?:[^']|'')*)'\)", lambda m: 'contains(low, "' + m.group(1).replace("''", "'") + '")', _REACTION)
    return rows.selectExpr("id", f"round(CAST({sql} AS DOUBLE), 5) AS reaction")


_PRIVATE = "(?is)<private>.*?(</private>|$)"


@C.add(f"WITH {T.MEM} SELECT id, md5(regexp_replace(content, '{_PRIVATE}', '[private]', 'g')) AS redacted_md5, contains(lower(content), '<private>') AS had_private FROM mem")
def redaction_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Private spans, not nested, replaced by a mark; an unclosed one hides the rest."""
    return T.memories(spark, sf_dir).select("id", F.md5(F.regexp_replace("content", _PRIVATE, "[private]")).alias("redacted_md5"), F.contains(F.lower("content"), F.lit("<private>")).alias("had_private"))


def redact(messages: list[str]) -> list[str]:
    """Nested private spans over the ordered messages of one session; what is left open hides what follows."""
    out, depth = [], 0
    for text in messages:
        kept, at = [], 0
        for m in re.finditer(r"<(/?)private>", text or "", re.I):
            if depth == 0:
                kept.append(text[at : m.start()])
            if not m.group(1):
                if depth == 0:
                    kept.append("[private]")
                depth += 1
            elif depth:
                depth -= 1
            at = m.end()
        if depth == 0:
            kept.append((text or "")[at:])
        out.append("".join(kept))
    return out


@C.add()
def redaction_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, content) redacted with the state carried over a session's records in the order they were captured.

    The state needs order, so a session is one group; sessions are bounded by their sender.
    """
    rows = table(spark, sf_dir, "source_records").where("session IS NOT NULL").select("session", "source_id", "content", "captured_at").dropDuplicates(["session", "source_id"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["captured_at", "source_id"])
        return pd.DataFrame({"source_id": group["source_id"], "content": redact(group["content"].tolist())})

    return rows.groupBy("session").applyInPandas(run, "source_id string, content string")


def chunk_markdown(text: str, by: str = "heading", limit: int = 2000) -> list[tuple[str | None, str]]:
    """(heading, body): a Markdown text by headings, by paragraphs or whole, bodies cut at limit tokens of four bytes."""
    parts: list[tuple[str | None, list[str]]] = [(None, [])]
    if by == "file":
        parts = [(None, text.split("\n"))]
    else:
        fence = None
        for line in text.split("\n"):
            if line.startswith(("```", "~~~")) and (fence is None or line.startswith(fence)):
                fence = None if fence else line[:3]
            m = None if fence else re.match(r"(#{1,6}) +(.*)", line)
            if m:
                parts.append((m.group(2).strip(), [line]))
            elif by == "paragraph" and not fence and not line.strip():
                parts.append((parts[-1][0], []))
            else:
                parts[-1][1].append(line)
    out = []
    for heading, lines in parts:
        body, size = [], 0
        for line in lines:
            cost = len(line.encode()) // 4 + 1
            if body and size + cost > limit:
                out.append((heading, "\n".join(body).strip()))
                body, size = [], 0
            body.append(line)
            size += cost
        out.append((heading, "\n".join(body).strip()))
    return [(h, b) for h, b in out if b]


def read_markdown(spark: SparkSession, path: str, by: str = "heading") -> DataFrame:
    """(source_file, source_hash, chunk_no, heading, content, status) of all Markdown files under a path.

    Files that are not UTF-8 give one row with the status 'invalid_utf8', files of blanks one with 'empty'; files of no bytes are not listed by Spark.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, digest, data in zip(batch["path"], batch["digest"], batch["content"]):
                try:
                    chunks = chunk_markdown(redact([bytes(data).decode("utf-8")])[0], by)
                except UnicodeDecodeError:
                    rows.append((name, digest, 0, None, None, "invalid_utf8"))
                    continue
                rows += [(name, digest, k, h, b, "ok") for k, (h, b) in enumerate(chunks)] or [(name, digest, 0, None, None, "empty")]
            yield pd.DataFrame(rows, columns=["source_file", "source_hash", "chunk_no", "heading", "content", "status"])

    return files.select("path", F.sha2("content", 256).alias("digest"), "content").mapInPandas(run, "source_file string, source_hash string, chunk_no int, heading string, content string, status string")


@C.add()
def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(T.memories(spark, sf_dir), "heading")


@C.add()
def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(T.memories(spark, sf_dir), "paragraph")


def _chunks(memories: DataFrame, by: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, h, b) for i, text in zip(batch["id"], batch["content"]) for k, (h, b) in enumerate(chunk_markdown(text, by))]
            yield pd.DataFrame(rows, columns=["id", "chunk_no", "heading", "content"])

    return memories.select("id", "content").mapInPandas(run, "id string, chunk_no int, heading string, content string")


@C.add("SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '\\n\\n+'), lambda p: trim(p) <> '')) AS paragraph FROM documents")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "explode(filter(split(text, '\\\\n\\\\n+'), p -> trim(p) <> '')) AS paragraph")


_FIRST = "first AS (SELECT session, source_id, content, speaker, origin, captured_at FROM (SELECT *, row_number() OVER (PARTITION BY session, source_id ORDER BY captured_at, arrived_at, content) AS n FROM source_records WHERE session IS NOT NULL) WHERE n = 1)"
_LAST50 = f"{_FIRST}, r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY captured_at DESC, source_id DESC) AS back FROM first)"


def _sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record of a session: the first that was captured."""
    rows = table(spark, sf_dir, "source_records").where("session IS NOT NULL")
    first = F.min(F.struct(F.col("captured_at").isNull().alias("z"), "captured_at", F.col("arrived_at").isNull().alias("y"), "arrived_at", F.col("content").isNull().alias("x"), "content", "speaker", "origin")).alias("m")
    return rows.groupBy("session", "source_id").agg(first).select("session", "source_id", "m.content", "m.speaker", "m.origin", "m.captured_at")


def _last50(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("captured_at"), F.desc("source_id")))
    return _sent(spark, sf_dir).withColumn("back", back).where("back <= 50")


@C.add(f"WITH {_LAST50} SELECT session, source_id, row_number() OVER (PARTITION BY session ORDER BY back DESC) - 1 AS pos FROM r WHERE back <= 50")
def session_last50(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _last50(spark, sf_dir)
    return rows.select("session", "source_id", (F.row_number().over(Window.partitionBy("session").orderBy(F.desc("back"))) - 1).alias("pos"))


@C.add(f"WITH {_LAST50} SELECT session, count(*) AS messages, md5(string_agg(concat(coalesce(lower(speaker), 'unknown'), ': ', coalesce(content, '')), chr(10) ORDER BY back DESC)) AS text_md5 FROM r WHERE back <= 50 GROUP BY ALL")
def session_summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fifty messages of a session in order, joined to one text, of which the digest is shown."""
    line = F.concat(F.coalesce(F.lower("speaker"), F.lit("unknown")), F.lit(": "), F.coalesce("content", F.lit("")))
    rows = _last50(spark, sf_dir).groupBy("session").agg(F.count(F.lit(1)).alias("messages"), F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("o"), line.alias("line")))).alias("l"))
    return rows.select("session", "messages", F.md5(F.array_join(F.transform("l", lambda x: x.line), "\n")).alias("text_md5"))


#: Turns of a conversation that make one memory.
TURNS = 100


@C.add(f"WITH {_FIRST}, n AS (SELECT *, (row_number() OVER (PARTITION BY session ORDER BY captured_at NULLS FIRST, source_id) - 1) // {TURNS} AS part FROM first WHERE origin = 'chat') SELECT session, part, count(*) AS turns, md5(string_agg(concat(coalesce(lower(speaker), 'unknown'), ': ', coalesce(content, '')), chr(10) ORDER BY captured_at NULLS FIRST, source_id)) AS text_md5 FROM n GROUP BY ALL")
def conversation_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as memories of at most TURNS turns, so that a session of any length is never one array."""
    order = [F.asc_nulls_first("captured_at"), F.col("source_id")]
    rows = _sent(spark, sf_dir).where("origin = 'chat'").withColumn("n", F.row_number().over(Window.partitionBy("session").orderBy(*order)) - 1)
    line = F.concat(F.coalesce(F.lower("speaker"), F.lit("unknown")), F.lit(": "), F.coalesce("content", F.lit("")))
    parts = rows.groupBy("session", F.expr(f"CAST(n div {TURNS} AS BIGINT)").alias("part")).agg(F.count(F.lit(1)).alias("turns"), F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("l"))
    return parts.select("session", "part", "turns", F.md5(F.array_join(F.transform("l", lambda x: x.line), "\n")).alias("text_md5"))


_KEY = "content_hash, coalesce(origin, '') AS origin, coalesce(visibility, '') AS visibility"


@C.add(f"SELECT {_KEY}, min(source_id) AS source_id, count(*) AS sent FROM (SELECT lower(content_hash) AS content_hash, origin, visibility, source_id FROM source_records WHERE content_hash <> '') GROUP BY ALL")
def store_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records sent again are stored once: by hash, origin and visibility."""
    rows = table(spark, sf_dir, "source_records").where("content_hash <> ''").selectExpr("lower(content_hash) AS content_hash", "coalesce(origin, '') AS origin", "coalesce(visibility, '') AS visibility", "source_id")
    return rows.groupBy("content_hash", "origin", "visibility").agg(F.min("source_id").alias("source_id"), F.count(F.lit(1)).alias("sent"))


@C.add(f"WITH {T.MEM}, f AS (SELECT coalesce(source_file, '') AS source_file, count(*) AS chunks, count(*) FILTER (WHERE content = '') AS empty, count(*) FILTER (WHERE source_hash = '') AS unhashed FROM mem GROUP BY ALL) SELECT *, CASE WHEN empty = chunks THEN 'failed' WHEN empty + unhashed > 0 THEN 'partial' ELSE 'ok' END AS status FROM f")
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.memories(spark, sf_dir).groupBy(F.coalesce("source_file", F.lit("")).alias("source_file")).agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("content") == "").alias("empty"), F.count_if(F.col("source_hash") == "").alias("unhashed"))
    return rows.withColumn("status", F.expr("CASE WHEN empty = chunks THEN 'failed' WHEN empty + unhashed > 0 THEN 'partial' ELSE 'ok' END"))


# fixed values: what must not reach a prompt
_UNSAFE = (("\\{\\{[^{}]{1,200}\\}\\}", "[REDACTED:template]"), ("\\$\\{[^{}]{1,200}\\}", "[REDACTED:template]"), ("```", "[code-fence]"), ("(?i)(javascript|vbscript)[ \\t]*:", "[REDACTED:url-scheme]:"), ("(?i)data[ \\t]*:[ \\t]*text/html", "[REDACTED:html-data]:"))


def _sanitised_sql() -> str:
    out = "text"
    for p, r in _UNSAFE:
        out = f"regexp_replace({out}, '{p}', '{r}', 'g')"
    return out


@C.add(f"SELECT doc_id, md5({_sanitised_sql()}) AS clean_md5, {_sanitised_sql()} <> text AS changed FROM documents WHERE text IS NOT NULL")
def prompt_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.col("text")
    for p, r in _UNSAFE:
        out = F.regexp_replace(out, F.lit(p), F.lit(r))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(out).alias("clean_md5"), (out != F.col("text")).alias("changed"))


_TYPES = "CASE WHEN regexp_matches(low, '(^|[^a-z])(decided|decision|agreed|chose)([^a-z]|$)') THEN 'decision' WHEN regexp_matches(low, '(^|[^a-z])(prefers?|preference|likes?)([^a-z]|$)') THEN 'preference' WHEN regexp_matches(low, '(^|[^a-z])(measured|fell to|needs|counts)([^a-z]|$)') THEN 'fact' ELSE 'event' END"


@C.add(f"WITH {T.MEM}, l AS (SELECT id, lower(content) AS low FROM mem) SELECT id, {_TYPES} AS suggested FROM l")
def memory_type_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.memories(spark, sf_dir).selectExpr("id", "lower(content) AS low")
    return rows.selectExpr("id", f"{_TYPES.replace('regexp_matches(', 'regexp_like(')} AS suggested")


def export_snapshot(spark: SparkSession, sf_dir: str, path: str, tables: tuple[str, ...] = ("memories", "memory_vectors", "relationships")) -> DataFrame:
    """Writes the tables as Parquet and gives the manifest (table, rows, digest), digests being free of row order."""
    parts = []
    for name in tables:
        df = table(spark, sf_dir, name)
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        parts.append(_manifest(df, name))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _manifest(df: DataFrame, name: str) -> DataFrame:
    h = F.xxhash64(*df.columns)
    return df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), F.hex(F.bit_xor(h)).alias("xor"), F.sum(F.pmod(h, F.lit(2**31 - 1))).alias("sum"))


def import_snapshot(spark: SparkSession, path: str, manifest: DataFrame) -> dict[str, DataFrame]:
    """The tables of a snapshot, after their manifests were found equal."""
    out = {}
    for row in manifest.collect():
        df = spark.read.parquet(f"{path}/{row['table']}")
        found = _manifest(df, row["table"]).collect()[0]
        if (found["rows"], found["xor"], found["sum"]) != (row["rows"], row["xor"], row["sum"]):
            raise ValueError(f"snapshot of {row['table']} differs from its manifest")
        out[row["table"]] = df
    return out


QUERIES, SQL = C.queries, C.sql
