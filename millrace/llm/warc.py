"""WARC archives: written and read by Spark's text source, record boundaries verified along successor chains.

Reading cuts files at every ``WARC/1.`` into fragments. Each fragment is a candidate: where its header parses, the
content length gives the offset of the record that follows it. The task of a split follows the offsets inside it, so each candidate
points to where its chain leaves the split; pointer jumping from the start of each file, twice as far in every round, finds where the
chain enters the other splits. What it reaches there is a record; other candidates lie inside payloads and are joined back to theirs.
A header that holds the magic itself, as in a url, goes on through the following fragments up to its blank line.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, hinted, staged

MAGIC = "WARC/1."
#: Fixed values of RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ID_PREFIX = "<urn:uuid:6d696c6c-7261-6365-"


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 digest."""
    return base32_of(F.sha1(data))


def base32_of(digest: Column) -> Column:
    """Base32 of a SHA-1 digest in hex."""
    five = F.get(F.transform(F.array(digest), lambda d: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.conv(F.substr(d, k * 5 + 1, F.lit(5)), 16, 10).cast("int"))), F.lit(0))
    letter = lambda v, shift: F.substr(F.lit(BASE32), F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.array_join(F.transform(five, lambda v: F.concat(*[letter(v, s) for s in (15, 10, 5, 0)])), "")


def record_id(page_id: Column) -> Column:
    digits = F.lower(F.lpad(F.hex(page_id), 16, "0"))
    return F.concat(F.lit(ID_PREFIX), F.substr(digits, F.lit(1), F.lit(4)), F.lit("-"), F.substr(digits, F.lit(5), F.lit(12)), F.lit(">"))


def page_of(record: Column) -> Column:
    """The page id in a record id that ``record_id`` made; null for other ids."""
    digits = F.regexp_extract(record, ID_PREFIX + "([0-9a-f]{4})-([0-9a-f]{12})>", 0)
    value = F.conv(F.concat(F.substr(digits, F.lit(30), F.lit(4)), F.substr(digits, F.lit(35), F.lit(12))), 16, -10)
    return F.when(digits != "", value.cast("bigint"))


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = 0, records_per_file: int = 4096) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html; other columns are ignored).

    Payloads equal to an earlier one (smaller page_id) of at least ``min_revisit_bytes`` bytes become revisit records without the
    payload. A null html is an empty payload; a null url leaves the header out; line ends in a url are percent-encoded.
    Rows that repeat both the least page_id and its payload are responses too, as a revisit can't refer to itself; a null page_id
    ranks after all others, and equal payloads of null page_ids alone are all responses. An empty table writes no record.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    digests = rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("hex"), F.octet_length("html").alias("size"))
    firsts = digests.where(F.col("size") >= min_revisit_bytes).groupBy("hex").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = staged(firsts.where("n > 1 and first is not null").select("hex", "first"), "warc-repeats")
    marked = rows.withColumn("hex", F.sha1(F.col("html").cast("binary"))).join(hinted(repeated), "hex", "left").withColumn("digest", base32_of(F.col("hex")))
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    size = F.octet_length("html").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    block_size = F.octet_length(http) + F.when(revisit, 0).otherwise(F.octet_length("html"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\n"),
        line("WARC-Record-ID", F.coalesce(record_id(F.col("page_id")), F.concat(F.lit("<urn:sha1:"), F.col("digest"), F.lit(">")))),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z\r\n"),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), record_id(F.col("first")), F.lit("\r\n"))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        block_size.cast("string"),
        F.lit("\r\n\r\n"),
        http,
        F.when(revisit, "").otherwise(F.col("html")),
    )
    marked.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).text(path)


def _outline(fragment: bytes) -> tuple[bool, int | None, int | None]:
    """Whether a fragment begins a header, where its first blank line is, and the first content length among its whole lines before that.

    What stands before the first line end belongs to the version or to a line that the magic cut, and so does what follows the last.
    """
    end = fragment.find(b"\r\n\r\n")
    for field in fragment[:end].split(b"\r\n")[1:] if end >= 0 else fragment.split(b"\r\n")[1:-1]:
        name, colon, value = field.partition(b":")
        if colon and name.strip().lower() == b"content-length" and value.strip().isdigit():
            break
    else:
        value = None
    return fragment[:3] in (b"0\r\n", b"1\r\n"), end if end >= 0 else None, int(value) if value is not None else None


def _header(fragment: bytes) -> tuple[int, int] | None:
    """(bytes up to the record's block, content length) of a fragment that begins after the magic, if it is a header."""
    if fragment[:3] not in (b"0\r\n", b"1\r\n"):
        return None
    end = fragment.find(b"\r\n\r\n")
    for field in fragment[3:end].split(b"\r\n") if end > 0 else ():
        name, colon, value = field.partition(b":")
        if colon and name.strip().lower() == b"content-length" and value.strip().isdigit():
            return end + 4, int(value)
    return None


FRAGMENT = "fid bigint, block bigint, frag bigint, at bigint, size bigint, opens boolean, blank bigint, length bigint, value binary"


def _fragments(spark: SparkSession, path: str, with_value: bool) -> DataFrame:
    """The pieces between magics: file, block (split), number and offset in the block, size, outline."""
    lines = spark.read.option("lineSep", MAGIC).text(path).select(
        F.xxhash64("_metadata.file_path").alias("fid"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")
    )

    def number(batches):
        now, k, at = None, 0, 0
        for batch in batches:
            rows = []
            for fid, block, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (fid, block):
                    now, k, at = (fid, block), 0, 0
                rows.append((fid, block, k, at, len(value), *((None, None, None) if with_value else _outline(value)), value if with_value else None))
                k, at = k + 1, at + len(value) + len(MAGIC)
            names = [x.split(" ", 1)[0] for x in FRAGMENT.split(", ")]
            types = [pa.int64()] * 5 + [pa.bool_()] + [pa.int64()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, types, strict=True)], names=names)

    return lines.mapInArrow(number, FRAGMENT)


def _needs(placed: DataFrame) -> DataFrame:
    """``placed`` with ``need``, the bytes from a header to the next record, instead of the outline.

    A header that the magic cut ends at the first blank line of a later fragment; its length stands in any fragment up to that one.
    """
    outline = ("opens", "blank", "length")
    need = F.col("blank") + F.col("length") + len(MAGIC) + 8
    cut = F.col("opens") & F.col("blank").isNull()
    if placed.where(cut).isEmpty():
        return placed.withColumn("need", F.when(F.col("opens"), need)).drop(*outline)
    back = Window.partitionBy("fid").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = placed.withColumn("end", F.last(F.when(F.col("blank").isNotNull(), F.struct("pos", "blank")), True).over(back))
    ahead = ahead.withColumn("told", F.last(F.when(F.col("length").isNotNull(), F.struct("pos", "length")), True).over(back))
    far = F.when(F.col("told.pos") <= F.col("end.pos"), F.col("end.pos") - F.col("pos") + F.col("end.blank") + F.col("told.length") + len(MAGIC) + 8)
    return ahead.withColumn("need", F.when(F.col("opens"), F.when(cut, far).otherwise(need))).drop(*outline, "end", "told")


def verify_chain(spark: SparkSession, path: str) -> DataFrame:
    """Each fragment with its offset, its bytes to the next record, and whether the chain from the file's start reaches it."""
    frags = staged(_fragments(spark, path, False).drop("value"), "warc-fragments")
    sizes = frags.groupBy("fid", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    base = sizes.withColumn("base", F.coalesce(F.sum("bytes").over(Window.partitionBy("fid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("bytes")
    placed = frags.join(base, ["fid", "block"]).withColumn("pos", F.col("base") + F.col("at") - len(MAGIC)).drop("base", "at")
    placed = staged(_needs(placed.where("pos >= 0")), "warc-offsets")
    exits = staged(placed.select("fid", "block", "pos", "need").groupBy("fid", "block").applyInArrow(_exits, EXIT), "warc-exits")
    # only the file's start and what some split's chain leads to can be where the chain enters a split
    led_to = exits.where("exit is not null").select("fid", F.col("exit").alias("pos")).distinct()
    entries = exits.where("pos > 0").join(led_to, ["fid", "pos"], "left_semi").unionByName(exits.where("pos = 0"))
    nodes = staged(entries.select("fid", "block", "pos", F.col("exit").alias("jump"), (F.col("pos") == 0).alias("reached")), "warc-jumps")
    reached = -1
    while (now := nodes.where("reached").count()) > reached:
        reached = now
        hit = nodes.where("reached and jump is not null").select("fid", F.col("jump").alias("pos"), F.lit(True).alias("hit")).distinct()
        far = nodes.select("fid", F.col("pos").alias("jump"), F.col("jump").alias("farther"))
        former, nodes = nodes, nodes.join(hit, ["fid", "pos"], "left").join(far, ["fid", "jump"], "left")
        nodes = staged(nodes.select("fid", "block", "pos", F.col("farther").alias("jump"), (F.col("reached") | F.coalesce("hit", F.lit(False))).alias("reached")), "warc-jumps")
        discard(former)
    entered = placed.join(nodes.where("reached").select("fid", "block", F.col("pos").alias("entry")), ["fid", "block"], "left")
    chain = entered.select("fid", "block", "pos", "need", "entry").groupBy("fid", "block").applyInArrow(_follow, "fid bigint, pos bigint")
    return placed.join(chain.withColumn("on", F.lit(True)), ["fid", "pos"], "left").withColumn("reached", F.coalesce("on", F.lit(False))).drop("on")


EXIT = "fid bigint, block bigint, pos bigint, exit bigint"


def _links(table: pa.Table) -> tuple[list[int], list[int | None], dict[int, int]]:
    """Offsets of a split's fragments in order, where each leads, and the place of each offset."""
    table = table.sort_by("pos")
    at = table.column("pos").to_pylist()
    leads = [None if n is None else p + n for p, n in zip(at, table.column("need").to_pylist(), strict=True)]
    return at, leads, {p: k for k, p in enumerate(at)}


def _exits(table: pa.Table) -> pa.Table:
    """For each fragment of a split the first offset outside the split's fragments that its chain leads to; null where the chain breaks."""
    at, out, place = _links(table)
    for k in range(len(at) - 1, -1, -1):
        if out[k] is not None and (ahead := place.get(out[k])) is not None and ahead > k:
            out[k] = out[ahead]
    same = [pa.array([table.column(c)[0].as_py()] * len(at), pa.int64()) for c in ("fid", "block")]
    return pa.table([*same, pa.array(at, pa.int64()), pa.array(out, pa.int64())], names=["fid", "block", "pos", "exit"])


def _follow(table: pa.Table) -> pa.Table:
    """The fragments of a split that the chain from its entry reaches."""
    at, leads, place = _links(table)
    found, now = [], table.column("entry")[0].as_py()
    while now is not None and (k := place.get(now)) is not None and (not found or now > found[-1]):
        found.append(now)
        now = leads[k]
    return pa.table([pa.array([table.column("fid")[0].as_py()] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["fid", "pos"])


RECORD = "file_id bigint, split bigint, number bigint, warc_type string, record_id string, target_uri string, headers map<string,string>, http_headers map<string,string>, payload binary"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records that the successor chain of each file reaches, with their headers and payloads.

    Bytes that look like a record inside a payload stay payload; bytes after a broken header are no records. No file, or files
    without records, give an empty table.
    """
    chain = staged(verify_chain(spark, path), "warc-chain")
    order = Window.partitionBy("fid").orderBy("pos")
    odd = chain.where((~F.col("reached")) | F.col("need").isNull() | (F.col("need") > F.col("size") + len(MAGIC)))
    starts = F.when(F.col("reached") & F.col("need").isNotNull(), F.struct("pos", (F.col("pos") + F.col("need")).alias("end")))
    owned = chain.withColumn("owner", F.last(starts, True).over(order))
    odd = staged(
        owned.join(odd.select("fid", "pos"), ["fid", "pos"], "left_semi").select(
            "fid", "block", "frag", "pos", F.when(F.col("pos") < F.col("owner.end"), F.col("owner.pos")).alias("owner")
        ),
        "warc-odd",
    )
    values = _fragments(spark, path, True).where("block > 0 or frag > 0").select("fid", "block", "frag", "value")
    if odd.isEmpty():
        return _parsed(values)
    joined = values.join(hinted(odd.withColumn("odd", F.lit(True))), ["fid", "block", "frag"], "left")
    parts = joined.where("owner is not null").groupBy("fid", "owner").agg(F.sort_array(F.collect_list(F.struct("pos", "value", "block", "frag"))).alias("parts"))
    glued = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["value"])), MAGIC.encode().hex()))
    first = F.get("parts", F.lit(0))
    parts = parts.select("fid", first["block"].alias("block"), first["frag"].alias("frag"), glued.alias("value"))
    return _parsed(joined.where("odd is null").select("fid", "block", "frag", "value").unionByName(parts))


def _fields(raw: bytes) -> list[tuple[str, str]]:
    found: dict[str, str] = {}
    for field in raw.split(b"\r\n"):
        name, colon, value = field.partition(b":")
        if colon:
            found.setdefault(name.strip().lower().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace"))
    return list(found.items())


def _parsed(raw: DataFrame) -> DataFrame:
    names = [x.split(" ", 1)[0] for x in RECORD.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), pa.string()), pa.binary()]

    def parse(batches):
        for batch in batches:
            rows = []
            for fid, block, frag, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (head := _header(value)) is None:
                    continue
                fields = _fields(value[3 : head[0] - 4])
                body = value[head[0] : head[0] + head[1]]
                by = dict(fields)
                http, payload = [], body
                if by.get("content-type", "").startswith("application/http"):
                    top, _, payload = body.partition(b"\r\n\r\n")
                    http = _fields(top)
                rows.append((fid, block, frag, by.get("warc-type"), by.get("warc-record-id"), by.get("warc-target-uri"), fields, http, payload))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return raw.select("fid", "block", "frag", "value").mapInArrow(parse, RECORD)
