"""WARC salvage: after a failed check, search for the next valid member or version line, recover later records, log quarantined byte gaps.

A file may hold gzip members (of one record or of several) and plain records, also mixed. A record is valid if its version line is WARC/1.0 or WARC/1.1, its header consists of
fields (folded ones too) up to an empty line, its block is as long as Content-Length says and ends in two line ends, a sha1 WARC-Block-Digest, if any, is the block's, and, where it
is alone in its member, the member inflates with the right CRC and size. Headers may be of any length: one that is no header ends at its first line that is no field. Where a
check fails, the reader tries each later gzip magic and each version line at the
begin of a line, in file order, by all these checks; the bytes up to the first one that passes, or to the end of the file, are a gap
with the reason of the first failure. Files are read by position in pieces of CHUNK bytes; only one record is in memory at a time. A task
reads whole files, so the number of files is the parallelism; archives come in files of about a gigabyte.

Members of several records (an archive compressed as a whole) are inflated as a stream: their records have the member's offset and a null length. Where such a member is damaged, the
records before the damage are given, and the gap begins with the member, as no byte inside it can be named.

Defined results: an empty file has neither records nor gaps; a record inside a damaged plain record's block is recovered as a record; bytes between
records are a gap; a file that can't be opened is one gap of unknown (null) length; archiving turns a null html into a record marked as such, which reads back as null, an empty one into an empty
block, a null page_id or url into a missing header; repeated rows are records each; an empty table makes no file. A block that isn't UTF-8 reads as html with U+FFFD in place of what is
none (`read_warc` has its bytes); a URI with a stray % stays as it is; other columns of `pages` are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import _shared as S

CHUNK, ROLL = 1 << 20, 1 << 30
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
NEXT = re.compile(rb"\x1f\x8b\x08|(?:(?<=\n)|\A)WARC/1\.[01]\r\n")
VALUE = rb"[^\x00-\x08\x0a-\x1f]*"
LINE = re.compile(rb"(?:([!-9;-~]+)[ \t]*:|[ \t])(" + VALUE + rb")\r\n")
BEGUN = re.compile(rb"(?:[!-9;-~]+[ \t]*(?::" + VALUE + rb"\r?)?|[ \t]" + VALUE + rb"\r?|\r?)\Z")
SCHEMA = "kind string, file string, offset long, length long, reason string, warc_type string, record_id string, target_uri string, date string, headers map<string,string>, block binary"


class Bad(Exception):
    pass


class Source:
    """A file's bytes by position; keeps the piece read last."""

    def __init__(self, file) -> None:
        self.file, self.size, self.at, self.piece = file, file.size(), 0, b""

    def read(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if not (self.at <= at and at + n <= self.at + len(self.piece)):
            self.at, self.piece = at, self.file.read_at(max(n, min(CHUNK, self.size - at)), at)
        return self.piece[at - self.at : at - self.at + n]


def head(data: Callable[[], bytes], more: Callable[[], bool]) -> tuple[int, dict[str, str], int]:
    """Bytes of the header, its fields, the block's length. data: the bytes so far; more: gets further ones, False at the end."""
    while len(data()) < 10 and more():
        pass
    if not (m := VERSION.match(data())):
        raise Bad("no version line")
    fields: dict[str, str] = {}
    at, name = m.end(), None
    while not data().startswith(b"\r\n", at):
        m = LINE.match(data(), at)
        if m:
            value = m[2].strip(b" \t").decode("utf-8", "replace")
            if m[1]:
                name = m[1].decode("latin-1").lower()
                fields[name] = value
            elif name:
                fields[name] = f"{fields[name]} {value}".strip()
            at = m.end()
        elif not BEGUN.match(data(), at) or not more():
            raise Bad("header without end")
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Bad("no content length")
    return at + 2, fields, int(length)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def checked(fields: dict[str, str], block: bytes) -> bytes:
    want = fields.get("warc-block-digest", "")
    if want.lower().startswith("sha1:") and digest(block)[5:] != want[5:].strip().upper():
        raise Bad("wrong digest")
    return block


def plain(source: Source, at: int) -> tuple[int, dict[str, str], bytes]:
    begun = [source.read(at, 4096)]

    def more() -> bool:
        had = len(begun[0])
        begun[0] = source.read(at, 4 * had)
        return len(begun[0]) > had

    size, fields, length = head(lambda: begun[0], more)
    end = at + size + length
    if end + 4 > source.size:
        raise Bad("record beyond the end of the file")
    if source.read(end, 4) != b"\r\n\r\n":
        raise Bad("wrong content length")
    return end + 4, fields, checked(fields, source.read(at + size, length))


class Member:
    """A gzip member's bytes, inflated as they are asked for."""

    def __init__(self, source: Source, at: int) -> None:
        self.source, self.at, self.inflate, self.out = source, at, zlib.decompressobj(wbits=31), bytearray()

    def more(self) -> bool:
        if self.inflate.eof:
            return False
        piece = self.source.read(self.at, 1 << 16)
        if not piece:
            raise Bad("member without end")
        try:
            self.out += self.inflate.decompress(piece)
        except zlib.error:
            raise Bad("damaged member") from None
        self.at += len(piece)
        return True

    def has(self, n: int) -> bool:
        while len(self.out) < n:
            if not self.more():
                return False
        return True

    def take(self) -> tuple[dict[str, str], bytes]:
        size, fields, length = head(lambda: self.out, self.more)
        if not self.has(size + length + 4) or self.out[size + length : size + length + 4] != b"\r\n\r\n":
            raise Bad("wrong content length")
        block = checked(fields, bytes(self.out[size : size + length]))
        del self.out[: size + length + 4]
        return fields, block

    def end(self) -> int:
        return self.at - len(self.inflate.unused_data)


def parse(source: Source, at: int) -> Iterator[tuple[int | None, dict[str, str] | None, bytes]]:
    """(end, fields, block) of the record at `at`, or of each record of the member there: with end None if they are several, and (end, None, b"") at last."""
    if not source.read(at, 3).startswith(MAGIC):
        yield plain(source, at)
        return
    member = Member(source, at)
    first = member.take()
    if not member.has(1):  # inflated to its end, so CRC and size are right
        yield member.end(), *first
        return
    fields, block = member.take()  # the second one shows that they are several
    yield None, *first
    yield None, fields, block
    while member.has(1):
        yield None, *member.take()
    yield member.end(), None, b""


def candidates(source: Source, at: int) -> Iterator[int]:
    """Places from `at` on where a member or a record may begin, in file order."""
    while at < source.size:
        back = 1 if at else 0  # the byte before shows whether a line begins
        piece = source.read(at - back, CHUNK // 2)
        last = at - back + len(piece) >= source.size
        for m in NEXT.finditer(piece, 0):
            if m.start() >= back and (last or m.start() < len(piece) - 16):
                if m.start() == 0 and at:
                    continue
                yield at - back + m.start()
        if last:
            return
        at += len(piece) - back - 16


def salvage(source: Source) -> Iterator[tuple]:
    """("record", offset, length, fields, block) and ("gap", offset, length, reason), in file order."""
    at, reason = 0, None  # a reason: what is at `at` was tried
    while at < source.size:
        for place in chain([] if reason else [at], candidates(source, at + 1)):
            end = given = None
            try:
                for end, fields, block in parse(source, place):
                    if not given and place > at:
                        yield "gap", at, place - at, reason
                    if fields is not None:
                        yield "record", place, None if end is None else end - place, fields, block
                    given = True
            except Bad as e:
                if not given:
                    reason = reason or str(e)
                    continue
                at, reason = place, str(e)  # a member of several records, damaged behind some of them
            else:
                at, reason = end, None
            break
        else:
            yield "gap", at, source.size - at, reason
            return


def opened(uri: str):
    uri = uri.replace("s3a://", "s3://", 1)
    if "://" not in uri:
        uri = "file://" + str(Path(uri.removeprefix("file:")).resolve())
    where, path = fs.FileSystem.from_uri(uri)
    return where, path


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = ["kind", "file", "offset", "length", "reason", "warc_type", "record_id", "target_uri", "date", "headers", "block"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for uri in b.column(0).to_pylist():
            rows, weight = [], 0
            try:
                where, path = opened(uri)
                file = where.open_input_file(path)
            except OSError as e:
                yield _rows([("gap", uri, 0, None, f"can't be opened: {type(e).__name__}", *[None] * 6)])
                continue
            with file:
                for what, at, length, *more in salvage(Source(file)):
                    if what == "gap":
                        rows.append(("gap", uri, at, length, more[0], *[None] * 6))
                    else:
                        f, block = more
                        rows.append(("record", uri, at, length, None, f.get("warc-type"), f.get("warc-record-id"), f.get("warc-target-uri"), f.get("warc-date"), list(f.items()), block))
                        weight += len(block) + 500
                    if weight > 4_000_000 or len(rows) >= 5000:
                        yield _rows(rows)
                        rows, weight = [], 0
            if rows:
                yield _rows(rows)


def read_warc(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """Records and gaps of the files that the only column of `files` names (URIs)."""
    S.ship(files.sparkSession)
    one = files.select(F.col(f"`{files.columns[0]}`").cast("string").alias("file")).where("file is not null")
    return one.repartition(tasks or max(1, one.count())).mapInArrow(_read, SCHEMA)


def list_warcs(spark: SparkSession, folder: str) -> DataFrame:
    """The URIs of a folder's .warc and .warc.gz files; their contents aren't read for that."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{warc,warc.gz}").load(folder).select(F.col("path").alias("file"))


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    block = (html or "").encode()
    lines = ["WARC/1.1", "WARC-Type: resource", "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: text/html", f"WARC-Block-Digest: {digest(block)}", f"Content-Length: {len(block)}"]
    lines += [f"WARC-Record-ID: <urn:page:{page_id}>"] if page_id is not None else []
    lines += [f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f%]', lambda m: f'%{ord(m.group()):02X}', url)}"] if url is not None else []
    lines += ["WARC-Block-Missing: true"] if html is None else []
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


#: One page in DAMAGED is damaged in the archive that the query reads.
DAMAGED = 50


def harm(page_id: int | None) -> int:
    """What befalls a page's record, from its id alone: 0 nothing, 1 a byte changed, 2 cut short, 3 begin overwritten, 4 length too long, 5 stray bytes before it (the record itself stays whole)."""
    h = zlib.crc32(f"harm {page_id}".encode())
    return 0 if h % DAMAGED else 1 + h // DAMAGED % 5


def harmed(data: bytes, kind: int) -> bytes:
    if kind == 1:
        at = len(data) * 2 // 3
        return data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :]
    if kind == 2:
        return data[: len(data) * 3 // 4]
    if kind == 3:
        return b"\0" * 8 + data[8:]
    if kind == 4:
        if data.startswith(MAGIC):
            return data[:-4] + bytes([data[-4] ^ 1]) + data[-3:]
        return re.sub(rb"Content-Length: (\d+)", rb"Content-Length: 1\1", data, count=1)
    if kind == 5:
        return b"\x1f\x8b\x08 stray WARC/1.1 bytes\n" + data
    return data


def archive(pages: DataFrame, folder: str, damage: bool = False, roll: int = ROLL) -> DataFrame:
    """Write pages as WARC files (a task in four plain, the others gzip) and give their URIs. A file's name is new in each attempt of a task and
    only those of tasks that ended well are given, so a lost executor leaves at most files that nobody reads."""
    S.ship(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gz = TaskContext.get().partitionId() % 4 != 3
        where, path = opened(folder)
        where.create_dir(path, recursive=True)
        out, done, used = None, [], 0
        for b in batches:
            for page_id, url, html in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if out is None:
                    name, used = f"{uuid.uuid4().hex}.warc" + ".gz" * gz, 0
                    out = where.open_output_stream(f"{path}/{name}", compression=None)
                data = record(page_id, url, html)
                data = pack(data) if gz else data
                data = harmed(data, harm(page_id)) if damage else data
                used += out.write(data) or len(data)
                if used >= roll:
                    out.close()
                    done.append(name)
                    out = None
        if out is not None:
            out.close()
            done.append(name)
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n in done], pa.string())], names=["file"])

    return S.written(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(write, "file string"), "warc-files")


def salvaged_pages(files: DataFrame) -> DataFrame:
    """kind, file, offset, length, reason, page_id, url, html."""
    r = read_warc(files)
    missing = F.coalesce(F.col("headers")["warc-block-missing"] == "true", F.lit(False))
    url = F.coalesce(F.expr("replace(try_url_decode(replace(target_uri, '+', '%2B')), '\\u0000', '')"), F.col("target_uri"))
    return r.select(
        "kind",
        F.element_at(F.split("file", "/"), -1).alias("file"),
        "offset",
        "length",
        "reason",
        F.regexp_extract("record_id", r"^<urn:page:(-?\d+)>$", 1).try_cast("long").alias("page_id"),
        url.alias("url"),
        F.when((F.col("kind") == "record") & ~missing, F.make_valid_utf8(F.col("block").cast("string"))).alias("html"),
    )


def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = archive(S.table(spark, sf_dir, "pages"), S.fresh_path(spark, "warc"), damage=True)
    return salvaged_pages(files)
