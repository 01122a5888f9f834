"""Word packages as tables: read, splice redacted text in byte by byte, rebuild.

Packages are rows (path, content). A package is rewritten in one task, by
`mapInArrow`, since its parts lie in one binary value. The texts of its spans are redacted as an
ordinary column. The changes are gathered by path and broadcast to the packages while they are at most
`MAX_CHANGES` bytes, so that no package moves; more are joined by a shuffle, which moves packages too.

Only the text between the tags of `t` elements of the word-processing namespace
changes, whatever its prefix; every other byte of a part stays, and so do the names, the
order and the compression of all entries.
"""

from __future__ import annotations

import io
import os
import re
import uuid
import zipfile
from collections.abc import Callable
from xml.parsers import expat
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.ship import ship

# The namespace and the folder of images.
NAMESPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
MEDIA = "word/media/"
CONTENT_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
MAX_CHANGES = 32 << 20
_RETURN = {"\r": "&#xD;"}  # a bare one would be read as a line feed
_ESCAPES = {'"': "&#34;", "'": "&#39;", "\t": "&#x9;", "\n": "&#xA;", "\r": "&#xD;"}


def read(spark: SparkSession, path: str) -> DataFrame:
    """Packages (path, content) of a folder or glob, by the extension in either case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(F.lower("path").endswith(".docx")).select("path", "content")


def is_text_part(name: str) -> bool:
    base = name.removeprefix("word/")
    return name.startswith("word/") and "/" not in base and (base == "document.xml" or (base.startswith(("header", "footer")) and base.endswith(".xml")))


def encoding_of(part: bytes) -> str:
    """The declared encoding, lower-cased; by its first bytes where a part has a byte order mark."""
    for mark, name in ((b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"), (b"\xef\xbb\xbf", "utf-8")):
        if part.startswith(mark):
            return name
    told = re.match(rb"""<\?xml[^>]*?encoding\s*=\s*["']([A-Za-z0-9._-]+)""", part)
    return told[1].decode().lower() if told else "utf-8"


def find_spans(part: bytes) -> list[tuple[int, int, str]]:
    """(first byte, end byte, decoded text) of the content of each text element; a self-closing one is empty and has no width."""
    spans: list[tuple[int, int, str]] = []
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True
    state: dict = {"at": None, "text": []}

    def begin(name: str, _attributes: dict) -> None:
        if name == f"{NAMESPACE} t":
            at, quote = parser.CurrentByteIndex, 0
            while quote or part[at] != 0x3E:  # the end of the tag, outside quotes
                c = part[at]
                quote = 0 if c == quote else c if not quote and c in b"\"'" else quote
                at += 1
            state["at"], state["text"] = (None if part[at - 1] == 0x2F else at + 1), []
            if state["at"] is None:
                spans.append((at + 1, at + 1, ""))

    def end(name: str) -> None:
        if name == f"{NAMESPACE} t" and state["at"] is not None:
            spans.append((state["at"], parser.CurrentByteIndex, "".join(state["text"])))
            state["at"] = None

    def text(data: str) -> None:
        if state["at"] is not None:
            state["text"].append(data)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = begin, end, text
    parser.Parse(part, True)
    return spans


def splice(part: bytes, spans: list[tuple[int, int, str]], new: dict[int, str]) -> bytes:
    """`part` with the spans numbered in `new` replaced by escaped text."""
    out, at = [], 0
    for k in sorted(new):
        start, stop, _ = spans[k]
        out += [part[at:start], escape(new[k], _ESCAPES).encode()]
        at = stop
    return b"".join([*out, part[at:]])


def rebuild(content: bytes, changed: dict[str, bytes]) -> bytes:
    """The package with the named entries replaced; names, order and compression stay. Without changes it is the same bytes."""
    if not changed:
        return content
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w") as new:
        for entry in old.infolist():
            copy = zipfile.ZipInfo(entry.filename, entry.date_time)
            copy.compress_type, copy.external_attr, copy.create_system = entry.compress_type, entry.external_attr, entry.create_system
            new.writestr(copy, changed.get(entry.filename, old.read(entry)))
    return out.getvalue()


def parts(packages: DataFrame) -> DataFrame:
    """A row for each entry: path, name, ord, content; an unreadable package has one row with `error`."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows += [(path, e.filename, i, z.read(e), None) for i, e in enumerate(z.infolist())]
                except (zipfile.BadZipFile, TypeError) as error:
                    rows.append((path, None, None, None, str(error)))
            yield _batch(rows, [("path", pa.string()), ("name", pa.string()), ("ord", pa.int32()), ("content", pa.binary()), ("error", pa.string())])

    return ship(packages).select("path", "content").mapInArrow(run, "path string, name string, ord int, content binary, error string")


def _batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.record_batch([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def media(packages: DataFrame) -> DataFrame:
    """The images: path, name, format, data."""
    from veilspark.functions.text import media_format

    found = parts(packages).filter(F.col("name").startswith(MEDIA))
    return found.select("path", "name", media_format(F.col("name")).alias("format"), F.col("content").alias("data"))


def text_spans(packages: DataFrame) -> DataFrame:
    """A row for each text element of the text parts: path, part, span_id, start, stop, text. Unreadable packages and parts have no rows."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for name, spans in _text_parts(content):
                    rows += [(path, name, k, a, b, text) for k, (a, b, text) in enumerate(spans)]
            yield _batch(rows, [("path", pa.string()), ("part", pa.string()), ("span_id", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("text", pa.string())])

    return ship(packages).select("path", "content").mapInArrow(run, "path string, part string, span_id int, start long, stop long, text string")


#: Encodings whose text can be replaced by UTF-8 bytes; parts in others stay and are reported.
_ENCODINGS = ("utf-8", "utf8", "us-ascii", "ascii")


def _text_parts(content: bytes | None):
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            for entry in z.infolist():
                if is_text_part(entry.filename) and encoding_of(part := z.read(entry)) in _ENCODINGS:
                    yield entry.filename, find_spans(part)
    except (zipfile.BadZipFile, expat.ExpatError):
        return


def redact_packages(packages: DataFrame, redact: Callable[[DataFrame], DataFrame], images: DataFrame | None = None) -> DataFrame:
    """path, content, redactions, regions, error.

    `redact` gets the spans (path, part, span_id, text) and adds `n` and `redacted`; a null
    `redacted` leaves the span as it was. `images` (path, name, redacted, regions) replaces entries too. The
    changes of a package are gathered in one row beside it. A package that cannot be
    read keeps its bytes and says so in `error`; one without changes keeps its bytes. A text part that is
    not in UTF-8 stays and is named in `error`. Paths tell packages apart: rows that repeat
    a path must be the same package, and each gets its changes once.
    """
    spans = redact(text_spans(packages).filter("text <> ''")).filter("n > 0 AND redacted IS NOT NULL")
    change = F.struct("part", "span_id", "redacted", F.lit(None).cast("binary").alias("data"), F.col("n").cast("long").alias("n"), F.lit(0).cast("long").alias("regions"))
    changes = spans.select("path", change.alias("c"))
    if images is not None:
        image = F.struct(
            F.col("name").alias("part"), F.lit(None).cast("int").alias("span_id"), F.lit(None).cast("string").alias("redacted"), F.col("redacted").alias("data"),
            F.lit(0).cast("long").alias("n"), F.col("regions").cast("long").alias("regions"),
        )
        changes = changes.unionAll(images.filter("regions > 0").select("path", image.alias("c")))
    once = changes.select("path", "c.part", "c.span_id", "c").dropDuplicates(["path", "part", "span_id"])
    gathered = once.groupBy("path").agg(F.collect_list("c").alias("changes")).persist(StorageLevel.DISK_ONLY)
    size = gathered.select(F.sum(F.length("path") + F.aggregate("changes", F.lit(0).cast("long"), lambda n, c: n + 64 + F.coalesce(F.octet_length(c["redacted"]), F.lit(0)) + F.coalesce(F.octet_length(c["data"]), F.lit(0))))).first()[0] or 0
    gathered = F.broadcast(gathered) if size <= MAX_CHANGES else gathered

    def run(batches):
        for batch in batches:
            rows = []
            for path, content, changed in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "changes")), strict=True):
                try:
                    rows.append((path, *_changed(content, changed or []), _left_out(content)))
                except (zipfile.BadZipFile, expat.ExpatError, TypeError) as error:
                    rows.append((path, content, 0, 0, f"{type(error).__name__}: {error}"))
            yield _batch(rows, [("path", pa.string()), ("content", pa.binary()), ("redactions", pa.int64()), ("regions", pa.int64()), ("error", pa.string())])

    return ship(packages).select("path", "content").join(gathered, "path", "left").mapInArrow(run, "path string, content binary, redactions long, regions long, error string")


def _left_out(content: bytes) -> str | None:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        found = [(e.filename, encoding_of(z.read(e))) for e in z.infolist() if is_text_part(e.filename)]
    return "; ".join(f"{name}: not redacted, encoding {encoding}" for name, encoding in found if encoding not in _ENCODINGS) or None


def _changed(content: bytes, changes: list[dict]) -> tuple[bytes, int, int]:
    new: dict[str, bytes] = {}
    texts: dict[str, dict[int, str]] = {}
    for c in changes:
        if c["data"] is not None:
            new[c["part"]] = c["data"]
        else:
            texts.setdefault(c["part"], {})[c["span_id"]] = c["redacted"]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name, edits in texts.items():
            part = z.read(name)
            new[name] = splice(part, find_spans(part), edits)
    return rebuild(content, new), sum(c["n"] for c in changes), sum(c["regions"] for c in changes)


def package(paragraphs: list[str], extra: dict[str, bytes] | None = None) -> bytes:
    """A small package whose body has a run for each paragraph; `extra` adds or replaces entries."""
    runs = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(_legal(p), _RETURN)}</w:t></w:r></w:p>' for p in paragraphs)
    entries = {
        "[Content_Types].xml": (
            '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
            '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
            f'<Override PartName="/word/document.xml" ContentType="{CONTENT_TYPE}.main+xml"/></Types>'
        ).encode(),
        "_rels/.rels": (
            '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" '
            'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
        ).encode(),
        "word/document.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{NAMESPACE}"><w:body>{runs}</w:body></w:document>'.encode(),
    } | (extra or {})
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _legal(text: str) -> str:
    """Without the control characters that the format cannot hold."""
    return "".join(c for c in text if c in "\t\n\r" or (c >= " " and c not in "￾￿"))


def build(rows: DataFrame) -> DataFrame:
    """Packages (path, content) from (path, paragraphs array<string>)."""

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column("path"), pa.array([package(p or []) for p in batch.column("paragraphs").to_pylist()], pa.binary())], names=["path", "content"])

    return ship(rows).select("path", "paragraphs").mapInArrow(run, "path string, content binary")


def names_below(paths: DataFrame) -> Column:
    """A name for each path: what lies below the folder that all paths share."""
    first, last = paths.agg(F.min("path"), F.max("path")).first()
    shared = os.path.commonprefix([first or "", last or ""])  # of the least and the greatest, so of all
    return F.substring(F.col("path"), shared.rfind("/") + 2, 1 << 30)


def refuse_clashes(paths: DataFrame, name: Column) -> None:
    """A ValueError if two paths have one name."""
    twice = paths.groupBy(name.alias("name")).count().filter("count > 1").head(1)
    if twice:
        raise ValueError(f"{twice[0]['count']} packages have the name {twice[0]['name']}")


def saved(packages: DataFrame, folder: str, name: Column) -> DataFrame:
    """Writes each content to `folder` as its row is computed; the other columns, and `name`, are the result.

    Each file appears whole or not at all, and a task that is run again writes the same file.
    """
    rows = packages.withColumn("name", name)
    kept = [c for c in rows.columns if c != "content"]

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for target, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                target = f"{root}/{target}"
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                own = f"{target}.{uuid.uuid4().hex}.part"  # two attempts of a task don't share it
                with store.open_output_stream(own) as f:
                    f.write(content)
                store.move(own, target)
            yield batch.select(kept)

    return ship(rows).mapInArrow(run, rows.select(*kept).schema)


def write(packages: DataFrame, folder: str, name: Column | None = None) -> None:
    """Writes each content to `folder`, a path or URI that every executor reaches, under its path below the folder that all paths share, or under the name column given.

    Two packages of one name are an error, before anything is written.
    """
    name = names_below(packages) if name is None else name
    refuse_clashes(packages, name)
    saved(packages.select("path", "content"), folder, name).write.format("noop").mode("overwrite").save()


def redact_folder(spark: SparkSession, source: str, target: str, redact: Callable[[DataFrame], DataFrame], images: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Redacts every package below `source` into `target`: one row a package with path, redactions, regions, error and name.

    `redact` is as in `redact_packages`; `images` gets the media (path, name, format, data) and adds `redacted`
    and `regions`. Names are checked on the listing alone, before any package is opened. The report is a table in
    `target`/_report, written in the pass that writes the packages, and read back from there.
    """
    packages = read(spark, source)
    name = names_below(packages)
    refuse_clashes(packages, name)
    done = redact_packages(packages, redact, images(media(packages)) if images else None)
    report = f"{target.rstrip('/')}/_report"
    saved(done, target, name).write.mode("overwrite").parquet(report)
    return spark.read.parquet(report)
