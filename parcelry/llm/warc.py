"""WARC archives written and read through Spark, and their index merged from locally sorted runs.

Records are lines of Spark's text source with a blank-line separator, so archives live wherever Spark writes.
They are gzipped, hence read from their start, record by record, and a payload that itself contains record
separators is put together again by its Content-Length. Each archive's entries form one capture run, sorted by URL key
and timestamp, and numbered in that order. The runs are cut at common keys; in each range the numbers restore the order of the
runs' shares, which are merged with a loser tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelry.sources.scratch import keep
from parcelry.llm.names import unused

_EOL = "\r\n"
_BREAK = _EOL * 2
_HEAD = "WARC/1.1" + _EOL
_HTTP = "HTTP/1.1 200 OK" + _EOL + "Content-Type: text/html; charset=utf-8" + _EOL + "Content-Length: "
_BROADCAST_ROWS, _SALTS = 50_000, 32
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_ENTRY = "page_id long, url string, captured string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_at long"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a string's UTF-8 bytes."""
    bits = F.sha1(payload)
    # 40 hex digits are 8 groups of 20 bits, and each group is 4 letters.
    groups = F.transform(F.sequence(F.lit(1), F.lit(36), F.lit(5)), lambda i: F.conv(F.substring(bits, i, F.lit(5)), 16, 10).cast("int"))
    letter = lambda n, shift: F.substring(F.lit(_BASE32), F.shiftright(n, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.array_join(F.transform(groups, lambda n: F.concat(*[letter(n, s) for s in (15, 10, 5, 0)])), "")


def url_key(url: Column) -> Column:
    """A sort key: host labels reversed and joined by commas, then path and query in lower case; scheme, user, default ports, a leading www and fragments go."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r"^.*@|:(80|443)?$", ""), r"^www\d*\.", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.lower(F.regexp_extract(rest, r"^[^/?]*(.*)$", 1)))


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str = "captured", min_revisit_bytes: int = 0) -> None:
    """Write one record per row: the page with the smallest id of equal payloads as a response, the others as revisits.

    Payloads of fewer than ``min_revisit_bytes`` are always responses. Defined cases: a null payload is empty; a row with a null id is a
    response if all rows with its payload have null ids, else a revisit; rows that repeat the smallest id are
    responses each; a null URL or time is an empty header; control characters and blanks in URLs are
    percent-encoded; an empty table writes an archive without records. Other columns are not written.
    """
    text = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("at"), text.alias("body"))
    rows = rows.withColumns({"digest": payload_digest(F.col("body")), "n": F.octet_length("body").cast("long")})
    # Only payloads that occur twice need a lookup; one row each, whatever the group.
    firsts = keep(rows.select("digest", "id", "n").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("rows")).filter("rows > 1").select("digest", "first"), "payloads")
    if firsts.count() <= _BROADCAST_ROWS:
        rows = rows.join(F.broadcast(firsts), "digest", "left")
    else:
        # A payload that very many pages share is dealt over several tasks.
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(_SALTS)).cast("int"))
        rows = rows.join(firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))), ["digest", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id")) & (F.col("n") >= min_revisit_bytes)
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "%", "%25")
    for code in (*range(33), 127):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    record = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(x.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit(_HTTP), F.col("n").cast("string"), F.lit(_BREAK))
    block = F.when(revisit, http).otherwise(F.concat(http, "body"))
    lines = [
        (F.lit("WARC-Type"), F.when(revisit, "revisit").otherwise("response")),
        (F.lit("WARC-Record-ID"), record(F.col("id"))),
        (F.lit("WARC-Date"), F.coalesce(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))),
        (F.lit("WARC-Target-URI"), url),
        (F.lit("WARC-Payload-Digest"), F.concat(F.lit("sha1:"), "digest")),
        (F.lit("WARC-Refers-To"), F.when(revisit, record(F.col("first")))),
        (F.lit("WARC-Profile"), F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        (F.lit("Content-Type"), F.lit("application/http;msgtype=response")),
        (F.lit("Content-Length"), F.octet_length(block).cast("string")),
    ]
    head = F.concat_ws(_EOL, *[F.when(value.isNotNull(), F.concat(name, F.lit(": "), value)) for name, value in lines])
    rows.select(F.concat(F.lit(_HEAD), head, F.lit(_BREAK), block).alias("value")).write.option("lineSep", _BREAK).option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """An index entry per record of the archives below ``path``, with its archive and offset in the unpacked stream.

    Payloads are hashed again; a response whose digest differs from its header stops the job. A revisit's size is the Content-Length
    of the HTTP header it keeps.
    """
    lines = spark.read.option("lineSep", _BREAK + _HEAD).text(path).select("value", F.col("_metadata.file_path").alias("archive"))
    return lines.mapInArrow(_entries, f"{_ENTRY}, archive string")


def merge_index(entries: DataFrame, *, key_cols: tuple[str, ...] = ("url_key", "captured", "page_id"), range_rows: int = 100_000) -> DataFrame:
    """Merge per-archive runs into one global order by the key columns, numbered by ``position`` from 0.

    Every archive's entries are sorted on their own, numbered and written down as a run. Ranges of about
    ``range_rows`` rows are cut at sampled keys; as keys end in the id, a URL with very many captures spans
    several ranges. Within a range the numbers bring each run's share back into the run's order, and a loser tree merges the shares.

    Defined cases: null keys come first; entries with equal keys, also repeated ones, come in the order of their runs; an empty table gives an
    empty result. Columns named like an added one are replaced, all others stay, whatever their names.
    """
    entries = entries.drop("position")
    run, nth, part, place, before = unused(entries, "run", "nth", "part", "place", "before")
    # A gzipped archive is read by one task. Of archives that several tasks share, each share is a run.
    runs = entries.withColumn(run, F.concat_ws("#", "archive", F.spark_partition_id().cast("string"))).sortWithinPartitions(run, *key_cols)
    runs = keep(runs.withColumn(nth, F.monotonically_increasing_id()), "runs")
    total = runs.count()
    ranged = runs.repartitionByRange(max(1, -(-total // range_rows)), *key_cols).sortWithinPartitions(nth).drop(nth)
    merged = ranged.withColumn(part, F.spark_partition_id())
    schema = T.StructType([*merged.schema.fields, T.StructField(place, T.LongType())])
    at = len(entries.columns)
    merged = keep(merged.mapInArrow(lambda batches: _merge(batches, key_cols, at, place), schema), "merged")
    # One row per range.
    sizes = {r[part]: r["count"] for r in merged.groupBy(part).count().collect()}
    starts, done = [], 0
    for p in sorted(sizes):
        starts.append((p, done))
        done += sizes[p]
    starts = merged.sparkSession.createDataFrame(starts, f"{part} int, {before} long")
    return merged.join(F.broadcast(starts), part).withColumn("position", F.col(before) + F.col(place)).drop(run, part, place, before)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parse records in file order; a fragment that is shorter than its record goes on in the next one."""
    archive, at, held = None, 0, b""
    rest, sep = _BREAK.encode(), (_BREAK + _HEAD).encode()
    for batch in batches:
        rows = []
        for value, name in zip(batch.column(0), batch.column(1).to_pylist()):
            value = value.as_buffer().to_pybytes()
            if name != archive:
                if held:
                    raise ValueError(f"{archive} ends inside a record")
                archive, at = name, 0
                value = value.removeprefix(_HEAD.encode())
            elif held:
                value = held + sep + value
            held = b""
            while value.strip():
                head, _, block = value.partition(rest)
                fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split(_EOL))
                size = int(fields["Content-Length"])
                if len(block) < size:
                    held = value
                    break
                rows.append((*_entry(fields, block[:size]), at, archive))
                at += len(_HEAD) + len(head) + len(rest) + size + len(rest)
                # A payload that ends like a separator leaves the next record in the same fragment.
                value = block[size:].removeprefix(sep) if block[size:].startswith(sep) else b""
        columns = list(zip(*rows)) if rows else [()] * 9
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = [c.split()[0] for c in _ENTRY.split(", ")] + ["archive"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
    if held:
        raise ValueError(f"{archive} ends inside a record")


def _entry(fields: dict[str, str], block: bytes) -> tuple:
    number = lambda uri: int(x) if (x := uri.removeprefix("<urn:page:").removesuffix(">")) else None
    http, _, payload = block.partition(_BREAK.encode())
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    size = int(http.decode().rpartition("Content-Length: ")[2])
    return number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Date"], size, digest, kind, number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None


class LoserTree:
    """Merges sorted runs of keys. Inner nodes keep the loser of their match and the winner moves up, so the next key takes one match per level."""

    def __init__(self, runs: list[list]):
        self.runs, self.at = runs, [0] * len(runs)
        self.size = max(1, len(runs))
        self.losers = [-1] * self.size
        for run in range(len(runs)):
            self._play(run, filling=True)

    def _key(self, run: int) -> tuple:
        run_keys = self.runs[run]
        i = self.at[run]
        return (1,) if i >= len(run_keys) else (0, run_keys[i], run)

    def _play(self, run: int, filling: bool = False) -> None:
        node, key = (run + self.size) // 2, self._key(run)
        while node:
            other = self.losers[node]
            if filling and other < 0:
                self.losers[node] = run
                return
            if (other_key := self._key(other)) < key:
                self.losers[node], run, key = run, other, other_key
            node //= 2
        self.losers[0] = run

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place in the run) in merged order; equal keys come in order of their runs."""
        while self.runs:
            run = self.losers[0]
            if self.at[run] >= len(self.runs[run]):
                return
            yield run, self.at[run]
            self.at[run] += 1
            self._play(run)


def _merge(batches: Iterator[pa.RecordBatch], key_cols: tuple[str, ...], run_at: int, place: str) -> Iterator[pa.RecordBatch]:
    """Merge the run pieces of one key range; nulls come first."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    keys = list(zip(*[[(x is not None, x) if x is not None else (False,) for x in t.column(c).to_pylist()] for c in key_cols]))
    run = t.column(run_at).combine_chunks().dictionary_encode().indices.to_numpy()
    cut = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(keys)]
    tree = LoserTree([keys[a:b] for a, b in zip(cut, cut[1:])])
    order = [cut[run] + i for run, i in tree]
    yield from t.take(pa.array(order, pa.int64())).append_column(place, pa.array(np.arange(len(order)))).to_batches()
