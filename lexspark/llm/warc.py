"""WARC writing, and reading by boundary-chain verification.

Writing.  A record is a text whose last two line ends are the line separator of
Spark's text writer, so archives go through Spark's own committer to any store.
Of equal payloads (SHA-1 and length) the row with the largest key is the
``response``, the others are ``revisit`` records without payload.  A null
payload is empty; a null key is the smallest; repeated rows with the winning key
are all responses.

Reading.  Each task splits its byte range at the magic ``WARC/1.0`` and emits,
for every candidate, the offset of the record that would follow by its
Content-Length.  Payloads may hold the magic too: a candidate counts only if the
chain from offset 0 of its file reaches it.  Inside a byte range the chains are
walked by one task; between ranges, pointer jumping doubles the jumps, so a file
of n ranges takes log2(n) rounds.  No step gathers more than one byte range or
one record.  A broken chain ends at the last record that it reaches.  Sizes and
digests come from the payloads; a revisit takes those of the response that it
refers to, and what it says itself only where no response of that name has the
digest that it names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, shared_path, stored

MAGIC = b"WARC/1.0\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = "\r\n\r\n"
#: Bytes of a cell in the interval join of continued payloads.
CELL = 1 << 20
CANDIDATE = "file string, range long, rel long, next long, type string, id string, refers string, payload_bytes long, declared long, digest string, payload binary, whole boolean, span long"


def base32_sha1(value: Column) -> Column:
    """Upper-case base32 of SHA-1, 20 bits at a time."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(value), 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def roles(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """pages with payload digest and size, and the key of the response that holds the payload."""
    p = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("uri"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("body"))
    p = p.withColumns({"digest": base32_sha1(F.col("body")), "bytes": F.octet_length("body").cast("long")})
    groups = p.groupBy("digest", "bytes").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return p.join(stored(groups, "warc-copies"), ["digest", "bytes"], "left").withColumn("first", F.coalesce("first", "id"))


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", records_per_file: int = 20_000) -> None:
    """An archive for each partition, split again after records_per_file."""
    p = roles(pages, key, url, payload)
    fresh = F.col("id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    uri = F.replace(F.replace(F.coalesce("uri", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    length = F.when(fresh, F.col("bytes")).otherwise(0) + len(HTTP)
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(fresh, "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: "), name("id"),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("bytes").cast("string"),
        F.when(fresh, "").otherwise(F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name("first"))),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), length.cast("string"),
        F.lit(END + HTTP),
    )
    body = F.when(fresh, F.col("body").cast("string")).otherwise("")
    p.select(F.concat(head, body).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


def _head(raw: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields of a candidate and where its block begins; None if it has no whole header."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in raw[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return (fields, end + 4) if fields.get("content-length", "").isdigit() else None


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP header of a block; all of it if it has none."""
    return block[block.find(b"\r\n\r\n") + 4 :] if block.startswith(b"HTTP/") and b"\r\n\r\n" in block else block


def sha1_32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _candidates(with_payload: bool):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, pos = None, 0
        for part in parts:
            rows = []
            for file, start, raw in zip(part["file"], part["range"], part["raw"]):
                if at != (file, start):
                    at, pos = (file, start), 0
                raw = bytes(raw)
                span, found = len(raw) + len(MAGIC), _head(raw)
                row = [file, start, pos, None, None, None, None, None, None, None, None, False, span]
                if found:
                    fields, begin = found
                    n = int(fields["content-length"])
                    row[3] = pos + begin + n + 4
                    row[4:7] = [fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-refers-to")]
                    row[8] = int(x) if (x := fields.get("x-payload-length", "")).isdigit() else None
                    if begin + n <= len(raw):
                        body = payload_of(raw[begin : begin + n])
                        row[7], row[9], row[11] = len(body), sha1_32(body), True
                        row[10] = body if with_payload else None
                        if row[4] == "revisit":
                            row[9] = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                pos += span
                rows.append(row)
            if not rows:
                continue
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in CANDIDATE.split(", ")]).astype({k: "Int64" for k in ("next", "payload_bytes", "declared")})

    return run


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """What lies between magics, in order within a byte range of a file; bytes are kept as they are."""
    raw = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("value").cast("binary").alias("raw"))


def _walk(group: pd.DataFrame) -> pd.DataFrame:
    """exit: where the chain from each candidate leaves the byte range, null if it breaks off."""
    offsets, nexts, last = group["off"].tolist(), group["next"].tolist(), group["off"].max()
    exits: dict[int, int | None] = {}
    for off, to in sorted(zip(offsets, nexts), reverse=True):
        exits[off] = None if pd.isna(to) else exits.get(to) if to <= last else int(to)
    out = group[["file", "range", "off"]].copy()
    out["exit"] = pd.array([exits[x] for x in offsets], dtype="Int64")
    return out


def _reached(group: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a byte range on chains from its entries."""
    to = dict(zip(group["off"], group["next"]))
    good: set[int] = set()
    for off in group["off"][group["entry"]]:
        while off in to and off not in good:
            good.add(off)
            off = to[off] if not pd.isna(to[off]) else None
    return group.loc[group["off"].isin(good), ["file", "range", "off"]]


def candidates(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Every magic in the archives, with absolute offsets of it and of its successor."""
    found = stored(_lines(spark, path).mapInPandas(_candidates(with_payload), CANDIDATE), "warc-candidates")
    return _placed(found).withColumn("next", F.col("next") + F.col("start"))


def _placed(found: DataFrame) -> DataFrame:
    """Absolute offsets: a byte range begins where what earlier ranges of the file have read ends."""
    ranges = found.groupBy("file", "range").agg(F.sum("span").alias("span"))
    # A row for each byte range: a file has as many as its bytes by the size of a split.
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("file", "range", F.coalesce(F.sum("span").over(before), F.lit(0)).alias("start"))
    # What precedes the first magic of a file is no candidate.
    return found.join(starts, ["file", "range"]).withColumn("off", F.col("rel") + F.col("start") - len(MAGIC)).where("off >= 0")


def reachable(c: DataFrame) -> DataFrame:
    """(file, range, off) of the candidates that the chain from offset 0 of their file reaches."""
    edges = stored(c.select("file", "range", "off", "next"), "warc-edges")
    jumps = stored(edges.groupBy("file", "range").applyInPandas(_walk, "file string, range long, off long, exit long"), "warc-jumps")
    entries = jumps.where("exit is not null").select("file", F.col("exit").alias("off")).union(jumps.select("file", F.lit(0).cast("long"))).distinct()
    hop = stored(jumps.join(entries, ["file", "off"]).select("file", "off", "exit"), "warc-hops")
    seen = stored(hop.where("off = 0").select("file", "off"), "warc-seen")
    n = seen.count()
    while True:
        more = seen.join(hop, ["file", "off"]).where("exit is not null").select("file", F.col("exit").alias("off"))
        more = more.join(hop.select("file", "off"), ["file", "off"], "left_semi")
        seen = stored(seen.union(more).distinct(), "warc-seen")
        if n == (n := seen.count()):
            break
        then = hop.select("file", F.col("off").alias("exit"), F.col("exit").alias("then"))
        hop = stored(hop.join(then, ["file", "exit"], "left").select("file", "off", F.col("then").alias("exit")), "warc-hops")
    marked = edges.join(seen.withColumn("entry", F.lit(True)), ["file", "off"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    return marked.groupBy("file", "range").applyInPandas(_reached, "file string, range long, off long")


def _pieces(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    at, pos = None, 0
    for part in parts:
        rels, spans = [], []
        for file, start, raw in zip(part["file"], part["range"], part["raw"]):
            if at != (file, start):
                at, pos = (file, start), 0
            rels.append(pos)
            spans.append(len(raw) + len(MAGIC))
            pos += spans[-1]
        yield pd.DataFrame({"file": part["file"], "range": part["range"], "rel": rels, "span": spans, "raw": part["raw"]})


def _joined(group: pd.DataFrame) -> pd.DataFrame:
    """The payload of one record whose block holds the magic."""
    group = group.sort_values("off")
    raw = MAGIC.join(map(bytes, group["raw"]))
    fields, begin = _head(raw) or ({"content-length": "0"}, len(raw))
    body = payload_of(raw[begin : begin + int(fields["content-length"])])
    return pd.DataFrame({"file": group["file"].iloc[:1], "off": group["record"].iloc[:1], "got_bytes": [len(body)], "got_digest": [sha1_32(body)], "got": [body]})


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """type, id, refers, payload_bytes, payload_digest (and payload) of each record of the archives in path."""
    bounded_batches(spark)
    c = stored(candidates(spark, path, with_payload), "warc-placed")
    good = stored(c.join(reachable(c), ["file", "range", "off"], "left_semi"), "warc-good")
    out = good.where("whole").select("type", "id", "refers", "payload_bytes", "declared", F.col("digest").alias("payload_digest"), "payload")
    # A block that holds the magic lies in several pieces: they are read again and met by cells of the file.
    torn = good.where("not whole")
    if torn.limit(1).count():
        cells = torn.select("file", F.col("off").alias("record"), "next", F.explode(F.sequence(F.floor(F.col("off") / CELL), F.floor(F.col("next") / CELL))).alias("cell"))
        raw = _placed(_lines(spark, path).mapInPandas(_pieces, "file string, range long, rel long, span long, raw binary"))
        raw = raw.withColumn("cell", F.floor(F.col("off") / CELL))
        whole = raw.join(cells, ["file", "cell"]).where("off >= record and off < next").select("file", "record", "off", "raw")
        whole = whole.groupBy("file", "record").applyInPandas(_joined, "file string, off long, got_bytes long, got_digest string, got binary")
        fixed = torn.join(whole, ["file", "off"]).select("type", "id", "refers", F.col("got_bytes").alias("payload_bytes"), "declared", F.col("got_digest").alias("payload_digest"), F.col("got").alias("payload"))
        out = out.union(fixed if with_payload else fixed.withColumn("payload", F.lit(None).cast("binary")))
    again = F.col("type") == "revisit"
    first = out.where(~again | again.isNull()).groupBy(F.col("id").alias("f_id")).agg(F.max(F.struct("payload_bytes", "payload_digest")).alias("f"))
    revisits = out.where(again).join(stored(first, "warc-responses"), (F.col("refers") == F.col("f_id")) & (F.col("payload_digest") == F.col("f.payload_digest")), "left")
    revisits = revisits.withColumn("payload_bytes", F.coalesce("f.payload_bytes", "declared", "payload_bytes"))
    columns = ["type", "id", "refers", "payload_bytes", "payload_digest", *(["payload"] if with_payload else [])]
    return out.where(~again | again.isNull()).select(*columns).union(revisits.select(*columns))


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Archives of pages, written and read back: a row for each page."""
    spark = pages.sparkSession
    path = shared_path(spark, "archives")
    write(pages, path, key, url, payload)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'urn:x-page:(-?[0-9]+)', 1) as bigint)")
    return read(spark, path).select(number("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers").alias("refers_to"))
