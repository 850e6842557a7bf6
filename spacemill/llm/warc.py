"""WARC archives of pages: writing, reading back, and assembling each capture's records.

Archives are written and read by Spark's own writers and readers, so any store Spark reaches will do.
"""

from __future__ import annotations

import hashlib
import zlib
from base64 import b32encode
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spacemill.llm.common import lookup, salt_of, stage

CRLF = "\r\n"
#: Payloads with copies up to which their digests are sent to the pages by broadcast (some 100 MB); beyond, they are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Bytes of payloads that an archive holds, on the average over hashes; an archive is read back as one file.
ARCHIVE_BYTES = 64 << 20
#: Fixed values of the WARC 1.1 standard.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: four times 40 bits, from hex digits."""
    h = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(kind: str, *cols: str) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols]))
    dashed = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))


def capture_plan(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest and winner: of pages with equal payloads of at least min_bytes, the largest page_id.

    Payloads are equal when length and SHA-1 are. A page is a revisit unless it is the winner of its group. Groups are
    found on digests alone, and only those of several pages are joined to the pages: without a shuffle of these where the groups are few.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": base32_sha1(F.col("html").cast("binary"))})
    rows = rows.withColumns({"key": F.concat_ws(":", "payload_digest", "payload_bytes"), "salt": salt_of("page_id")})
    long_enough = rows.where(F.col("payload_bytes") >= min_bytes)
    # two levels: the salted maxima of a hot payload, then their maximum
    best = long_enough.groupBy("key", "salt").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).groupBy("key").agg(F.max("winner").alias("winner"), F.sum("n").alias("n"))
    shared = stage(best.where("n > 1").select("key", "winner"), "warc-shared")
    out = rows.join(F.broadcast(shared), "key", "left") if shared.count() <= broadcast_keys else lookup(rows, shared, "key", "salt")
    return out.withColumn("winner", F.coalesce("winner", "page_id")).drop("key", "salt")


def records_of(plan: DataFrame, date: str) -> DataFrame:
    """One row per capture: its request, response or revisit, and metadata records as the text of an archive, each but the last followed by two line ends."""
    p = plan.withColumns({
        "revisit": F.coalesce(F.col("page_id") != F.col("winner"), F.lit(False)),
        "rid": _urn("response", "page_id", "payload_digest"), "qid": _urn("request", "page_id", "payload_digest"), "mid": _urn("metadata", "page_id", "payload_digest"),
        "wid": _urn("response", "winner", "payload_digest"),
        "uri": F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "[\\x00-\\x20\\x7f]", "%20"),
    })

    def record(kind: Column | str, rid: str, content: str, block: Column, *more: Column) -> Column:
        line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.concat(
            F.lit(VERSION + CRLF), line("WARC-Type", kind), line("WARC-Record-ID", F.col(rid)), line("WARC-Date", F.lit(date)),
            F.when(F.col("uri") != "", line("WARC-Target-URI", F.col("uri"))).otherwise(""), *more,
            line("Content-Type", F.lit(content)), line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF), block,
        )

    def header(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    rest = F.regexp_extract("uri", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    ask = F.concat(F.lit("GET "), F.when(F.substring(rest, 1, 1) == "/", rest).otherwise(F.concat(F.lit("/"), rest)), F.lit(f" HTTP/1.1{CRLF}Host: "), F.regexp_extract("uri", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(CRLF * 2))
    about = F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    to = header("WARC-Concurrent-To", F.col("rid"))
    answer = record(
        F.when(F.col("revisit"), "revisit").otherwise("response"), "rid", "application/http; msgtype=response", F.when(F.col("revisit"), head).otherwise(F.concat(head, F.col("html"))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(F.col("revisit"), F.concat(header("WARC-Profile", F.lit(PROFILE)), header("WARC-Refers-To", F.col("wid")))).otherwise(""),
    )
    three = [record("request", "qid", "application/http; msgtype=request", ask, to), answer, record("metadata", "mid", "application/warc-fields", about, to)]
    return p.select(F.concat_ws(CRLF * 2, *three).alias("value"))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", rows_per_file: int = 5000, bytes_per_file: int = ARCHIVE_BYTES, **cols: str) -> None:
    """Writes gzip-compressed archives of at most rows_per_file captures, and of about bytes_per_file of payloads or one longer one, below path.

    A null html is an empty payload, a null url leaves the target out, a null page_id is written as none; pages
    that repeat an id and payload are written as often. Control characters and spaces in a url are escaped. Other columns are
    not looked at. An empty table makes no records.
    """
    plan = capture_plan(pages, min_bytes, **cols)
    total = pages.agg(F.sum(F.octet_length(cols.get("html_col", "html")).cast("long"))).first()[0] or 0
    # a task's pages are dealt by a hash into as many archives as its share of the bytes asks for
    parts = max(1, -(-total // (max(1, pages.rdd.getNumPartitions()) * bytes_per_file)))
    text = records_of(plan, date)
    if parts > 1:
        text = text.withColumn("archive", F.pmod(F.xxhash64("value"), F.lit(parts)).cast("int"))
    writer = text.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy("archive") if parts > 1 else writer).text(path)


RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, content_type string, header_digest string, http_head string, fields map<string,string>, payload binary, payload_bytes long, payload_digest string"


#: Bytes that are unpacked at once.
CHUNK = 1 << 20


def _unpacked(raw: bytes) -> Iterator[bytes]:
    """The bytes of an archive in parts, whatever its number of gzip members, or as they are."""
    if raw[:2] != b"\x1f\x8b":
        yield from (raw[a : a + CHUNK] for a in range(0, len(raw), CHUNK))
        return
    view = memoryview(raw)
    while len(view):
        d = zlib.decompressobj(31)
        part = d.decompress(view, CHUNK)
        while part or not d.eof:
            yield part
            if d.eof:
                break
            left = d.unconsumed_tail
            part = d.decompress(left, CHUNK)
            if not part and not left and not d.eof:
                raise ValueError("truncated archive")
        view = view[len(view) - len(d.unused_data) :]


def parse_archive(raw: bytes | Iterable[bytes]) -> Iterator[dict]:
    """The records of one archive, by their Content-Length; no more than a record and a part are held unpacked. A truncated or damaged archive raises ValueError."""
    parts = iter(_unpacked(raw) if isinstance(raw, bytes) else raw)
    data, at, place = bytearray(), 0, 0

    def more() -> bool:
        """Takes in a further part; what was read is let go."""
        nonlocal at
        part = next(parts, None)
        if part is None:
            return False
        del data[:at]
        at = 0
        data.extend(part)
        return True

    while True:
        while data[at : at + 2] == b"\r\n":
            at, place = at + 2, place + 2
        if len(data) - at < 2:
            if more():
                continue
            if len(data) > at:
                raise ValueError(f"no WARC record at byte {place}")
            return
        sought = 0
        while (split := data.find(b"\r\n\r\n", at + sought)) < 0 and (len(data) - at < 5 or data.startswith(b"WARC/", at)):
            sought = max(0, len(data) - at - 3)
            if not more():
                break
        if not data.startswith(b"WARC/", at) or split < 0:
            raise ValueError(f"no WARC record at byte {place}")
        h = {}
        for x in bytes(data[at:split]).decode("utf-8", "replace").split(CRLF)[1:]:
            k, _, v = x.partition(":")
            h[k.strip().lower()] = v.strip()
        head_size, size = split + 4 - at, int(h["content-length"])
        while len(data) - at < head_size + size:
            if not more():
                raise ValueError(f"truncated WARC record at byte {place}")
        yield _record(h, bytes(data[at + head_size : at + head_size + size]), place)
        at, place = at + head_size + size, place + head_size + size


def _record(h: dict[str, str], block: bytes, place: int) -> dict:
    kind, fields, head, payload, size, digest = h.get("warc-type"), None, None, None, None, None
    if h.get("content-type", "").startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        head = top.decode("utf-8", "replace")
    if kind == "response":
        payload = payload or b""
        size, digest = len(payload), b32encode(hashlib.sha1(payload).digest()).decode()
        if h.get("warc-payload-digest", f"sha1:{digest}") != f"sha1:{digest}":
            raise ValueError(f"payload digest differs in the WARC record at byte {place}")
    elif kind == "revisit":  # the payload is elsewhere; its length and digest are as recorded
        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
        size = next((int(x.split(":")[1]) for x in (head or "").split(CRLF) if x.lower().startswith("content-length:")), None)
        payload = None
    elif kind in ("metadata", "warcinfo"):
        fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split(CRLF)) if k}
    return dict(
        record_id=h.get("warc-record-id"), type=kind, concurrent_to=h.get("warc-concurrent-to"), refers_to=h.get("warc-refers-to"), target_uri=h.get("warc-target-uri"), date=h.get("warc-date"), content_type=h.get("content-type"),
        header_digest=h.get("warc-payload-digest"), http_head=head, fields=list(fields.items()) if fields is not None else None, payload=payload, payload_bytes=size, payload_digest=digest,
    )


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of all archives below path, a row each (columns RECORD). Without payload its bytes are measured and left out."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(RECORD))

    def parse(batches):
        for batch in batches:
            for raw in batch.column(0):
                rows, held = [], 0
                for r in parse_archive(raw.as_py()):
                    r = r if payload else r | {"payload": None}
                    held += len(r["payload"] or b"")
                    rows.append(r)
                    if len(rows) == 2000 or held > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kind)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response (with its payload), requests and metadata, joined through concurrent-to identifiers.

    A record belongs to the response or revisit that its concurrent-to names, or whose request it names.
    Records without such an answer form a capture with a null response; a record that names nothing stands alone. Records of a null
    id are captures of their own, with a null capture_id; records of a null or other type count as metadata. An empty table gives no rows.
    """
    kinds = F.coalesce(F.col("type"), F.lit(""))
    slim = [c for c in records.columns if c not in ("payload",)]
    direct = records.where(kinds == "request").select(F.col("record_id").alias("_q"), F.col("concurrent_to").alias("_via"))
    others = records.where(~kinds.isin("response", "revisit"))
    via = others.where(kinds != "request").join(direct, F.col("concurrent_to") == F.col("_q"), "left").withColumn("capture_id", F.coalesce("_via", "concurrent_to", "record_id")).drop("_q", "_via")
    asked = others.where(kinds == "request").withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))
    answers = records.where(kinds.isin("response", "revisit")).withColumn("capture_id", F.col("record_id"))
    rest = asked.select("capture_id", *slim).unionByName(via.select("capture_id", *slim))
    one = F.struct(*[F.col(c) for c in slim])
    grouped = rest.groupBy("capture_id").agg(
        F.collect_list(F.when(kinds == "request", one)).alias("requests"), F.collect_list(F.when(kinds != "request", one)).alias("metadata")
    )
    response = answers.select("capture_id", F.struct(*[F.col(c) for c in records.columns]).alias("response"))
    return response.join(grouped, "capture_id", "full_outer")


def revisits_resolved(captures: DataFrame) -> DataFrame:
    """Each answered capture's page_id, payload_bytes, payload_digest, record_type and refers_to (the page_id of the response that a revisit names)."""
    page = F.col("metadata")[0]["fields"]["page_id"]
    rows = captures.where("response is not null").select(
        F.when(page != "", page.cast("long")).alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.col("response.record_id").alias("record_id"), F.col("response.refers_to").alias("named"),
    )
    target = rows.where("record_type = 'response'").groupBy(F.col("record_id").alias("named")).agg(F.max("page_id").alias("refers_to"))
    salt = F.when(F.col("named").isNull(), F.xxhash64("record_id")).otherwise(salt_of("record_id"))  # responses name nothing: spread them all
    out = lookup(rows.withColumn("salt", salt), target, "named", "salt")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
