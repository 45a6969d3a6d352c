"""WARC archives with payloads stored once.

Payload bytes are kept once for each SHA-256 digest, deflated; the exact header bytes of every record are kept apart. A
record is put together again by a join on the digest, and parsed: its length and its SHA-1 digest are verified.

Defined cases: a null html is an empty payload; a null url is empty; of equal payloads of at least `least` bytes the record
with the smallest page_id is the response and the others revisit it; a null page_id sorts after all others; repeated rows
with the response's page_id are each a response; smaller payloads are all responses; a very long page is one payload, a row
at a time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import id_key, materialize

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Least bytes of a payload that another record may revisit.
LEAST = 0


def header(page_id: int | None, url: str, kind: str, refers_to: int | None, digest: str, length: int) -> bytes:
    """The exact head of a record; its block follows."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, block) of a record; the block has exactly the stated length."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("wrong length of a record")
    return fields, rest[:size]


def b32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write(pages: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(payloads: sha256, deflated; records: page_id, sha256, head), both in the shared folder."""

    @F.pandas_udf("sha1 string, deflated binary")
    def packed(payload: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for p in payload:
            yield pd.DataFrame({"sha1": p.map(b32_sha1), "deflated": p.map(lambda x: zlib.compress(x, 6))})

    @F.pandas_udf("binary")
    def head(page_id: pd.Series, url: pd.Series, kind: pd.Series, refers: pd.Series, digest: pd.Series, length: pd.Series) -> pd.Series:
        return pd.Series([header(None if pd.isna(a) else int(a), u, k, None if pd.isna(r) else int(r), d, int(n)) for a, u, k, r, d, n in zip(page_id, url, kind, refers, digest, length, strict=True)], dtype=object)

    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), id_key("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload")).withColumns({"sha256": F.unhex(F.sha2("payload", 256)), "n": F.octet_length("payload")})
    light = materialize(base.withColumn("p", packed("payload")).select("page_id", "k1", "url", "sha256", "n", "p.sha1", "p.deflated"), "warc-captures")
    same = light.groupBy("sha256", "k1").count().groupBy("sha256").agg(F.min("k1").alias("first"), F.min_by("count", "k1").alias("times"))
    same = materialize(same, "warc-firsts")
    own = light.select("sha256", "k1", "deflated").join(same.withColumnRenamed("first", "k1"), ["sha256", "k1"])
    once = own.filter("times = 1").select("sha256", "deflated")
    payloads = materialize(once.union(own.filter("times > 1").select("sha256", "deflated").dropDuplicates(["sha256"])), "warc-payloads")
    kind = F.when((F.col("k1") == F.col("first")) | (F.col("n") < least), "response").otherwise("revisit")
    length = F.when(F.col("kind") == "response", F.col("n") + len(HTTP)).otherwise(len(HTTP))
    rec = light.drop("deflated").join(same, "sha256").withColumn("kind", kind).withColumn("refers", F.when(F.col("kind") == "revisit", F.col("first")))
    records = materialize(rec.select("page_id", "sha256", head("page_id", "url", "kind", "refers", "sha1", length).alias("head")), "warc-records")
    return payloads, records


def read(payloads: DataFrame, records: DataFrame) -> DataFrame:
    """Every record again, verified: (page_id, url, payload, payload_digest, record_type, refers_to, record)."""

    @F.pandas_udf("url string, payload binary, payload_digest string, record_type string, refers_to long, record binary")
    def restored(sha256: pd.Series, deflated: pd.Series, head: pd.Series) -> pd.DataFrame:
        out = []
        for digest, z, h in zip(sha256, deflated, head, strict=True):
            payload = zlib.decompress(z)
            if hashlib.sha256(payload).digest() != bytes(digest):
                raise ValueError("a stored payload does not have its digest")
            revisit = b"\r\nWARC-Type: revisit\r\n" in h
            record = bytes(h) + HTTP + (b"" if revisit else payload) + b"\r\n\r\n"
            fields, block = parse(record)
            sha1 = b32_sha1(payload if revisit else block[len(HTTP) :])
            if fields["WARC-Payload-Digest"] != "sha1:" + sha1:
                raise ValueError("a record does not have its digest")
            refers = fields.get("WARC-Refers-To")
            out.append((fields["WARC-Target-URI"], payload, sha1, fields["WARC-Type"], int(refers[10:-1]) if refers else None, record))
        return pd.DataFrame(out, columns=["url", "payload", "payload_digest", "record_type", "refers_to", "record"]).astype({"refers_to": "Int64"})

    return records.join(payloads, "sha256").withColumn("r", restored("sha256", "deflated", "head")).select("page_id", "r.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(*write(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return r.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, strlen(t) AS n, array_to_string([['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', substr(h, i, 1))] FOR i IN range(1, 41)], '') AS x,
      min(page_id) OVER (PARTITION BY h) AS lo FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + 16 * substr(x, i * 5 + 1, 1)::INT + 8 * substr(x, i * 5 + 2, 1)::INT + 4 * substr(x, i * 5 + 3, 1)::INT + 2 * substr(x, i * 5 + 4, 1)::INT + substr(x, i * 5 + 5, 1)::INT)::INT, 1) FOR i IN range(0, 32)], '') AS payload_digest,
       CASE WHEN page_id = lo THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> lo THEN lo END AS refers_to FROM b
"""
