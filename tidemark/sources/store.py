"""Content-addressed body stores (S8-S13): 'AA/BB/<digest>.zst' (zstd) and legacy 'A/<digest>.gz' (gzip).

A store has one small file per body, so the ``binaryFile`` source, which plans a task for every few files, makes more
tasks than work: folders are listed by tasks, and the files dealt out evenly, read and decoded by the task that holds
their path. Writing is an anti-join on stored digests plus a partitioned append.
"""

from __future__ import annotations

import fnmatch
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import digest_from_store_path, is_valid_digest, store_location, store_path_valid
from tidemark.session import cut_lineage

# Legacy layout '<first symbol>/<digest>.gz'; default zstd level of the store.
LEGACY_LETTERS = "234567ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ZSTD_LEVEL = 14
# Magic numbers of zstd frames (skippable ones with any low four bits) and gzip members.
ZSTD_MAGIC, ZSTD_SKIPPABLE, GZIP_MAGIC = 0xFD2FB528, 0x184D2A50, b"\x1f\x8b"
#: Files listed, and bytes of bodies held, between two batches that a reading task gives out.
LISTED_AT_ONCE, READ_AT_ONCE = 10_000, 8 << 20


def _hidden(name: str) -> bool:
    """Names that Spark's own listing leaves out."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _listed(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path relative to ``root``, length) of every file below it whose name fits, as Spark's listing has them (no
    hidden or empty ones): one task lists the root, the folders in it are dealt out and listed below. The rows are
    checkpointed at once, so they show the folder at this moment, and none of them passes through the driver: they come
    from a row of unknown size, as the planner takes what follows from a row of known size (the bodies read, too) to be
    as small, and broadcasts it."""
    import pyarrow.fs as pafs
    uri = _shared_uri(spark, root)
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

    def entries(fs, base, folder):
        prefix = f"{folder}/" if folder else ""
        for e in fs.get_file_info(pafs.FileSelector(f"{base}/{folder}" if folder else base)):
            if _hidden(e.base_name):
                continue
            if e.type == pafs.FileType.Directory:
                yield prefix + e.base_name, None
            elif e.size and fnmatch.fnmatchcase(e.base_name, glob):
                yield prefix + e.base_name, e.size

    def below(fs, base, folder):
        folders = [folder]
        while folders:
            for path, length in entries(fs, base, folders.pop()):
                if length is None:
                    folders.append(path)
                else:
                    yield path, length

    def batches(rows):
        held = []
        for r in rows:
            held.append(r)
            if len(held) == LISTED_AT_ONCE:
                yield pd.DataFrame(held, columns=["path", "length"]).astype({"length": "Int64"})
                held = []
        yield pd.DataFrame(held, columns=["path", "length"]).astype({"length": "Int64"})

    def opened():
        fs, base = pafs.FileSystem.from_uri(uri)
        return fs, base.rstrip("/")

    def top(pdfs):
        fs, base = opened()
        for pdf in pdfs:
            for _ in range(len(pdf)):
                yield from batches(entries(fs, base, ""))

    def expand(pdfs):
        fs, base = opened()
        for pdf in pdfs:
            yield from batches(r for path, length in zip(pdf["path"], pdf["length"])
                               for r in (below(fs, base, path) if pd.isna(length) else [(path, int(length))]))

    schema = "path string, length long"
    start = spark.createDataFrame(spark.sparkContext.parallelize([("",)], 1), "root string")
    found = start.mapInPandas(top, schema).repartition(n, "path").mapInPandas(expand, schema)
    return cut_lineage(found.repartition(n, "path"))


def _read(files: DataFrame, root: str, codec: str, wanted: Column) -> DataFrame:
    """``files`` (path relative to ``root``, ...) with body and error of the ``wanted`` ones (both null for others), read
    and decoded by the task that holds the path."""
    import pyarrow.fs as pafs
    uri, decode, columns = _shared_uri(files.sparkSession, root), DECODERS[codec], list(files.columns)

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(uri)

        def one(path, read):
            if not read:
                return None, None
            with fs.open_input_stream(f"{base.rstrip('/')}/{path}", compression=None) as f:
                return decode(f.read())

        for b in batches:
            held, size, start = [], 0, 0
            for at, (path, read) in enumerate(zip(b.column("path").to_pylist(), b.column("_read").to_pylist()), 1):
                held.append(one(path, read))
                size += len(held[-1][0] or b"")
                if size >= READ_AT_ONCE or at == b.num_rows:
                    own = b.slice(start, at - start)
                    yield pa.RecordBatch.from_arrays(
                        [*(own.column(c) for c in columns), pa.array([x for x, _ in held], pa.binary()),
                         pa.array([e for _, e in held], pa.string())], names=[*columns, "body", "error"])
                    held, size, start = [], 0, at

    schema = T.StructType([*files.schema, T.StructField("body", T.BinaryType()), T.StructField("error", T.StringType())])
    return files.withColumn("_read", F.coalesce(wanted, F.lit(False))).mapInArrow(run, schema)


def list_store(spark: SparkSession, root: str, suffix: str = "*.zst") -> DataFrame:
    """(path, length, digest, path_ok) for every stored file; bodies are not read."""
    f = _with_root(_listed(spark, root, suffix), spark, root)
    return f.select("path", "length", digest_from_store_path("path").alias("digest"),
                    store_path_valid("path").alias("path_ok"))


def _with_root(files: DataFrame, spark: SparkSession, root: str) -> DataFrame:
    return files.withColumn("path", F.concat(F.lit(_qualified(spark, root) + "/"), "path"))


def decode_zstd(data: bytes) -> tuple[bytes | None, str | None]:
    """(body, None) of a file of one or more zstd frames, or (None, error): a frame that ends early, bytes behind the
    last frame, an empty or corrupt file. Skippable frames hold no body."""
    import zstandard
    out, at = [], 0
    if not data:
        return None, "empty file"
    while at < len(data):
        magic = int.from_bytes(data[at:at + 4], "little")
        if magic & ~0xF == ZSTD_SKIPPABLE and len(data) >= at + 8:
            at += 8 + int.from_bytes(data[at + 4:at + 8], "little")
            if at > len(data):
                return None, "truncated frame"
            continue
        if magic != ZSTD_MAGIC:
            return None, "trailing bytes" if at else "not a zstd frame"
        d = zstandard.ZstdDecompressor().decompressobj()
        try:
            out.append(d.decompress(data[at:]))
        except zstandard.ZstdError:
            return None, "corrupt frame"
        if not d.eof:
            return None, "truncated frame"
        at = len(data) - len(d.unused_data)
    return b"".join(out), None


def decode_gzip(data: bytes) -> tuple[bytes | None, str | None]:
    """(body, None) of a file of one or more gzip members, or (None, error); check sums are verified."""
    import zlib
    out, rest = [], data
    if not data:
        return None, "empty file"
    while rest:
        d = zlib.decompressobj(wbits=31)
        try:
            out.append(d.decompress(rest))
        except zlib.error:
            return None, "trailing bytes" if out and not rest.startswith(GZIP_MAGIC) else "corrupt member"
        if not d.eof:
            return None, "trailing bytes" if out and not rest.startswith(GZIP_MAGIC) else "truncated member"
        rest = d.unused_data
    return b"".join(out), None


DECODERS = {"zstd": decode_zstd, "gzip": decode_gzip, "plain": lambda data: (data, None)}


@F.pandas_udf(T.BinaryType())
def zstd_decompress(b: pd.Series) -> pd.Series:
    """The body alone, NULL where ``decode_zstd`` finds an error."""
    return b.map(lambda x: None if x is None else decode_zstd(bytes(x))[0])


@F.pandas_udf(T.BinaryType())
def gzip_compress(b: pd.Series) -> pd.Series:
    import gzip
    return b.map(lambda x: None if x is None else gzip.compress(x, mtime=0))


@F.pandas_udf(T.BinaryType())
def zstd_compress(b: pd.Series) -> pd.Series:
    import zstandard
    c = zstandard.ZstdCompressor(level=ZSTD_LEVEL)
    return b.map(lambda x: None if x is None else c.compress(x))


def read_bodies(spark: SparkSession, root: str, suffix: str = "*.zst") -> DataFrame:
    """(path, digest, body binary, error, text). ``error`` says why a body can't be decoded (the body is then NULL);
    ``text`` is NULL when the body is not valid UTF-8. Both are rejects of the row, never a failed job."""
    f = _read(_listed(spark, root, suffix), root, "zstd" if suffix.endswith("zst") else "plain", F.lit(True))
    b = _with_root(f, spark, root).select("path", digest_from_store_path("path").alias("digest"), "body", "error")
    return b.withColumn("text", utf8_text("body"))


def utf8_text(body) -> Column:
    """The body as text, NULL when it is not valid UTF-8."""
    t = F.col(body).cast("string")
    return F.when(F.is_valid_utf8(t), t)


def prefix_glob(prefix: str) -> str:
    """Path pattern of the stored files of digests that begin with ``prefix``: only their folders are listed."""
    if len(prefix) > 32 or not set(prefix) <= set(LEGACY_LETTERS):
        raise ValueError(f"not a digest prefix: {prefix!r}")
    first, second = prefix[:2], prefix[2:4]
    return "/".join(["".join(p) + "?" * (2 - len(p)) for p in (first, second)] + [f"{prefix}*.zst"])


def list_files(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """(path relative to ``root``, length) of every file below it, whatever its name (but names that begin with '_' or
    '.', which Spark's listing leaves out). With ``prefix`` only files of a store under digests that begin with it: other
    folders are not even listed."""
    if not prefix:
        return _listed(spark, root)
    f = spark.read.format("binaryFile").load(f"{root}/{prefix_glob(prefix)}")
    rel = F.substring("path", len(_qualified(spark, root)) + 2, 1 << 20)
    return f.select(rel.alias("path"), "length")


def read_store_files(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """Q1 / Q3 input: (path, body, error) of every file below ``root``, or of the digests that begin with ``prefix``. Files whose path is not that of a stored body are
    kept, unread; an undecodable body is NULL with its error."""
    path = F.concat(F.lit("/"), F.col("path"))          # the path rule asks for folders below some root
    f = _read(list_files(spark, root, prefix).select("path"), root, "zstd", store_path_valid(path))
    return f.select(path.alias("path"), "body", "error")


def save_bodies(items: DataFrame, stored: DataFrame, root: str) -> DataFrame:
    """Insert-if-absent. Writes the bodies of ``items`` (digest, body) that ``stored`` (digest) lacks below
    ``root``; returns one row (digest, path, written_bytes) per digest, path and bytes null where it was skipped."""
    known = stored.select("digest").distinct()
    new = items.join(known, "digest", "left_anti").dropDuplicates(["digest"])
    skipped = items.select("digest").distinct().join(known, "digest", "left_semi")
    return write_store(new, root).unionByName(skipped, allowMissingColumns=True)


def _qualified(spark: SparkSession, root: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(p).toString()


def _shared_uri(spark: SparkSession, root: str) -> str:
    """``root`` with the file system that Spark would take for it, so tasks write where the readers look."""
    uri = _qualified(spark, root)
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _put(fs, path: str, data: bytes) -> None:
    """Write under a temporary name, then rename: a retried or speculative task leaves no half file. A file that is
    there already holds the same body, as its name is the body's digest."""
    from pyarrow.fs import FileType
    if fs.get_file_info(path).type == FileType.File:
        return
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part, compression=None) as f:
        f.write(data)
    fs.move(part, path)


def fetch(digests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """S13 batch form: bodies of a digest list (join, so the list may be as large as the store)."""
    return digests.select("digest").distinct().join(snapshots, "digest")


def write_store(bodies: DataFrame, root: str) -> DataFrame:
    """S10/S11 sink: each task writes its bodies as zstd files at root/AA/BB/<digest>.zst through pyarrow's
    file-system layer (local, HDFS or object stores). Returns (digest, path, written_bytes)."""
    import pyarrow.fs as pafs
    uri = _shared_uri(bodies.sparkSession, root)

    def run(batches):
        import zstandard
        fs, base = pafs.FileSystem.from_uri(uri)
        comp = zstandard.ZstdCompressor(level=ZSTD_LEVEL)
        for pdf in batches:
            out = []
            for d, body in zip(pdf["digest"], pdf["body"]):
                rel = f"{d[0:2]}/{d[2:4]}/{d}.zst"
                path = f"{base.rstrip('/')}/{rel}"
                data = comp.compress(body.encode() if isinstance(body, str) else bytes(body))
                _put(fs, path, data)
                out.append((d, path, len(data)))
            yield pd.DataFrame(out, columns=["digest", "path", "written_bytes"])

    valid = bodies.where(store_location("digest").isNotNull())
    return valid.mapInPandas(run, "digest string, path string, written_bytes long")


def write_legacy_store(bodies: DataFrame, root: str) -> DataFrame:
    """Legacy layout sink: gzip files root/<first symbol>/<digest>.gz written per task (pyarrow file systems).
    Returns (digest, path, written_bytes)."""
    import pyarrow.fs as pafs
    uri = _shared_uri(bodies.sparkSession, root)

    def run(batches):
        import gzip
        fs, base = pafs.FileSystem.from_uri(uri)
        for pdf in batches:
            out = []
            for d, body in zip(pdf["digest"], pdf["body"]):
                path = f"{base.rstrip('/')}/{d[0]}/{d}.gz"
                data = gzip.compress(body.encode() if isinstance(body, str) else bytes(body), mtime=0)
                _put(fs, path, data)
                out.append((d, path, len(data)))
            yield pd.DataFrame(out, columns=["digest", "path", "written_bytes"])

    return bodies.where(store_location("digest").isNotNull()).mapInPandas(
        run, "digest string, path string, written_bytes long")


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Writes (path relative to ``root``, content) rows as files, in tasks. Returns (path, written_bytes)."""
    import pyarrow.fs as pafs
    uri = _shared_uri(files.sparkSession, root)

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(uri)
        for pdf in batches:
            for rel, content in zip(pdf["path"], pdf["content"]):
                _put(fs, f"{base.rstrip('/')}/{rel}", bytes(content))
            yield pd.DataFrame({"path": pdf["path"], "written_bytes": [len(c) for c in pdf["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, written_bytes long")


def legacy_layout(path: Column) -> tuple[Column, Column]:
    """(stem, reject) of a path below a legacy store: ``<letter>/<stem>.gz`` with a stem that begins with the letter."""
    parts, name = F.split(path, "/"), F.substring_index(path, "/", -1)
    reject = (F.when((F.size(parts) != 2) | ~parts[0].rlike("^[2-7A-Z]$"), "folder")
              .when(~name.startswith(parts[0]), "letter").when(~name.endswith(".gz"), "suffix"))
    return F.regexp_replace(name, r"[.][^.]*$", ""), reject


#: Layouts of folders that bodies are imported from: the reason why a file is none of theirs (NULL: it is), its digest.
LAYOUTS = ("legacy", "gzip", "plain")


def scan_candidates(spark: SparkSession, root: str, layout: str) -> DataFrame:
    """One row per file below ``root``: (path, length, digest, reject). Nothing is read, nothing is left out.

    legacy: ``<letter>/<digest>.gz``, the stem beginning with its folder's letter; gzip: a flat folder of
    ``<digest>[...].gz``; plain: a flat folder of files named by their digest. ``reject`` is folder, letter, suffix or
    name for files that break the rule, whose digest is NULL."""
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}")
    f = list_files(spark, root)
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    if layout == "legacy":
        digest, reject = legacy_layout(F.col("path"))
    elif layout == "gzip":
        digest = F.substring(name, 1, 32)
        reject = F.when(F.size(parts) != 1, "folder").when(~name.endswith(".gz"), "suffix")
    else:
        digest, reject = name, F.when(F.size(parts) != 1, "folder")
    reject = F.coalesce(reject, F.when(~is_valid_digest(digest), "name"))
    return f.select("path", "length", F.when(reject.isNull(), digest).alias("digest"), reject.alias("reject"))


def read_legacy_bodies(spark: SparkSession, root: str, prefix: str | None = None) -> DataFrame:
    """(path, digest, reject, body, error, text) of every file of a legacy store, or, with ``prefix``, of the
    files of digests that begin with it and of the unexpected ones. Bodies are bytes; ``text`` is NULL where they are
    not UTF-8; files that break the layout are unread, with their reason in ``reject``."""
    if prefix:
        if not set(prefix) <= set(LEGACY_LETTERS) or len(prefix) > 32:
            raise ValueError(f"not a digest prefix: {prefix!r}")
        root = f"{root}/{prefix[0]}"
    f = list_files(spark, root)
    rel = F.concat(F.lit(f"{prefix[0]}/"), F.col("path")) if prefix else F.col("path")
    stem, reject = legacy_layout(rel)
    reject = F.coalesce(reject, F.when(~is_valid_digest(stem), "name"))
    f = f.select("path", rel.alias("rel"), F.when(reject.isNull(), stem).alias("digest"), reject.alias("reject"))
    if prefix:
        f = f.where(F.col("digest").startswith(prefix) | F.col("reject").isNotNull())
    f = _read(f, root, "gzip", F.col("reject").isNull())
    return f.select(F.col("rel").alias("path"), "digest", "reject", "body", "error").withColumn("text", utf8_text("body"))
