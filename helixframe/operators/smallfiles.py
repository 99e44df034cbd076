"""Far too many small files: byte-level concatenation with a manifest of lengths and checksums.

The bytes of small files (newline-delimited text, or complete zstandard frames) are joined to fewer well-sized files and
never parsed. Newline-delimited inputs get the line feed that their last line lacks, and a header line is kept once per
output file. Zstandard frames are joined as they are, since a sequence of frames is a valid stream; each is walked block
by block to its last one, so a truncated frame is refused. Every output is checked: its length must be the sum of the
parts' lengths, and every part, read again at its offset, must have the checksum taken before. The manifest has, for each
part, the output file, offset, length and SHA-256, so content delivered twice is recognised without comparing records.

``consolidate`` joins the parts where they are, task by task, and needs no shuffle; ``concatenate`` gives the joined files
as rows. ``frames_of_records`` rebuilds delivered files from a table of their records: a file is one frame or, beyond
``frame_rows`` records, several, each of sorted distinct lines, cut by a hash of the line. So equal sets of records give
equal frames, no task holds a large file, and repeats are dropped before the only shuffle. ``file_digests`` folds the
frames of a file into one row (mergeable sums, no list).

Defined cases: empty files have length 0, one part and the checksum of no bytes; null bytes count as empty; a null
file id takes no part in frames; repeated records of a file count once in a frame; an empty input gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

NULL_FIELD = "\\N"
BROADCAST_ROWS = 500_000  # large files (an id and a number each) that are sent to all tasks; more are joined with salts


def _frame_counts(lines: DataFrame, frame_rows: int) -> DataFrame | None:
    """``file_id``, ``n_frames`` of the files with more than ``frame_rows`` distinct lines; None if there are none."""
    many = checkpointed(lines.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > frame_rows).select("file_id"))
    if many.isEmpty():
        return None
    own = lines.join(many, "file_id", "left_semi").distinct()
    return checkpointed(own.groupBy("file_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(frame_rows)).cast("int").alias("n_frames")).where("n_frames > 1"))


def frames_of_records(df: DataFrame, file_id: str, columns: Sequence[str], frame_rows: int = 4096) -> DataFrame:
    """``file_id``, ``frame_no``, ``n_frames``, ``n_records``, ``content`` (tab-separated lines, each ended by a line feed).

    The number of frames follows from the distinct lines, for which only files with more than ``frame_rows`` rows are
    looked at twice.
    """
    fields = []
    for c in columns:
        text = F.col(c).cast("string")
        if dict(df.dtypes)[c] == "string":
            special = F.col(c).rlike(r"[\\\t\n\r]")
            safe = text
            for raw, out in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
                safe = F.replace(safe, F.lit(raw), F.lit(out))
            text = F.when(special, safe).otherwise(text)
        fields.append(F.coalesce(text, F.lit(NULL_FIELD)))
    lines = df.where(F.col(file_id).isNotNull()).select(F.col(file_id).alias("file_id"), F.concat_ws("\t", *fields).alias("line"))
    counts = _frame_counts(lines, frame_rows)
    if counts is None:
        lines = lines.withColumn("n_frames", F.lit(1))
    elif counts.count() <= BROADCAST_ROWS:
        lines = lines.join(F.broadcast(counts), "file_id", "left")
    else:
        salts = 32
        salted = counts.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        lines = lines.withColumn("_s", F.pmod(F.xxhash64("line"), F.lit(salts)).cast("int")).join(salted, ["file_id", "_s"], "left").drop("_s")
    n = F.coalesce("n_frames", F.lit(1))
    return (
        lines.groupBy("file_id", n.alias("n_frames"), F.when(n > 1, F.pmod(F.xxhash64("line"), n)).otherwise(0).cast("int").alias("frame_no"))
        .agg(F.array_sort(F.collect_set("line")).alias("l"))
        .select("file_id", "frame_no", "n_frames", F.size("l").alias("n_records"), F.encode(F.concat(F.array_join("l", "\n"), F.lit("\n")), "UTF-8").alias("content"))
    )


def manifest(parts: DataFrame, id_cols: Sequence[str], content: str = "content", target_bytes: int = 128 << 20) -> DataFrame:
    """Plan of the consolidation, one row per part: ``id_cols``, ``out_file``, ``offset``, ``length``, ``checksum``.

    ``out_file`` is a hash of the ids modulo the number of files that the total length asks for, so files come out near
    ``target_bytes`` and the offset, a running sum inside one output file, is bounded work.
    """
    sized = parts.select(*id_cols, F.coalesce(F.octet_length(content), F.lit(0)).cast("long").alias("length"), F.sha2(F.coalesce(F.col(content), F.lit(b"")), 256).alias("checksum"))
    total = sized.agg(F.greatest(F.ceil(F.sum("length") / F.lit(target_bytes)), F.lit(1)).cast("int").alias("n_out"))
    placed = sized.join(F.broadcast(total)).select(*id_cols, F.pmod(F.xxhash64(*id_cols), F.coalesce("n_out", F.lit(1))).cast("int").alias("out_file"), "length", "checksum")
    order = Window.partitionBy("out_file").orderBy(*id_cols).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))


def file_digests(parts: DataFrame) -> DataFrame:
    """One row per ``file_id`` from manifest rows (``file_id``, ``frame_no``, ``length``, ``checksum``).

    ``digest`` = number of frames, total length and two sums over the frames' SHA-256 (each with the frame's number), so
    it is merged before the shuffle.
    """
    tagged = F.sha2(F.concat_ws(":", "frame_no", "checksum"), 256)
    half = lambda at: F.conv(F.substring(tagged, at, 15), 16, 10).cast("decimal(38,0)")
    return (
        parts.groupBy("file_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"), F.sum(half(1)).alias("a"), F.sum(half(17)).alias("b"))
        .select("file_id", "length", F.concat_ws("-", "n", "length", "a", "b").alias("digest"))
    )


def equal_files(digests: DataFrame) -> DataFrame:
    """``digest``, ``class_id`` (least file id), ``n_files`` and ``n_links`` of every content delivered more than once."""
    n = F.count(F.lit(1))
    return digests.groupBy("digest").agg(F.min("file_id").alias("class_id"), n.alias("n_files"), (n * (n - 1) / 2).cast("long").alias("n_links")).where("n_files > 1")


def equal_pairs(digests: DataFrame, slice_files: int = 1000) -> DataFrame:
    """``file_id_a < file_id_b`` of every two files with the same digest.

    Contents with more than ``slice_files`` files are cut: a slice of the one side meets all files of the other, so the
    pairs of one content are spread over as many tasks as there are slices.
    """
    again = digests.join(equal_files(digests).select("digest", F.ceil(F.col("n_files") / F.lit(slice_files)).cast("int").alias("slices")), "digest")
    a = again.select("digest", F.pmod(F.xxhash64("file_id"), "slices").cast("int").alias("slice"), F.col("file_id").alias("file_id_a"))
    b = again.select("digest", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("file_id").alias("file_id_b"))
    return a.join(b, ["digest", "slice"]).where("file_id_a < file_id_b").select("file_id_a", "file_id_b")


def zstd_frames(data: bytes) -> int:
    """Number of complete zstandard frames in ``data`` (skippable ones too); raises ValueError if anything else is there.

    The layout is that of RFC 8878: magic number, header, blocks up to the one marked as the last, checksum.
    """
    at, n = 0, 0
    try:
        while at < len(data):
            magic = int.from_bytes(data[at : at + 4], "little")
            if 0x184D2A50 <= magic <= 0x184D2A5F:
                size = int.from_bytes(data[at + 4 : at + 8], "little")
                at += 8 + size
            elif magic == 0xFD2FB528:
                flags = data[at + 4]
                single = flags >> 5 & 1
                at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
                last = False
                while not last:
                    if at + 3 > len(data):
                        raise ValueError("truncated zstandard frame")
                    block = int.from_bytes(data[at : at + 3], "little")
                    last, kind, size = bool(block & 1), block >> 1 & 3, block >> 3
                    if kind == 3:
                        raise ValueError("not a zstandard frame")
                    at += 3 + (1 if kind == 1 else size)
                at += 4 * (flags >> 2 & 1)
            else:
                raise ValueError("not a zstandard frame")
            if at > len(data):
                raise ValueError("truncated zstandard frame")
            n += 1
    except IndexError:
        raise ValueError("truncated zstandard frame") from None
    return n


def join_bytes(parts: Sequence[bytes | None], kind: str = "lines", header: bytes | None = None) -> tuple[bytes, list[tuple[int, int, str]]]:
    """The joined bytes and (offset, length, SHA-256) of every part as written; raises ValueError if they do not check."""
    out, marks, at = [], [], 0
    if kind == "lines" and header:
        header = header if header.endswith(b"\n") else header + b"\n"
        out.append(header)
        at = len(header)
    for p in parts:
        p = bytes(p or b"")
        if kind == "lines":
            if p and not p.endswith(b"\n"):
                p += b"\n"
            if header and p.startswith(header):
                p = p[len(header) :]
        elif p:
            zstd_frames(p)
        out.append(p)
        marks.append((at, len(p), hashlib.sha256(p).hexdigest()))
        at += len(p)
    whole = b"".join(out)
    if len(whole) != at or any(hashlib.sha256(whole[o : o + n]).hexdigest() != h for o, n, h in marks):
        raise ValueError("lengths or checksums differ after joining")
    return whole, marks


def consolidate(parts: DataFrame, id_cols: Sequence[str], content: str = "content", kind: str = "lines", header: bytes | None = None, target_bytes: int = 128 << 20, folder: str | None = None, suffix: str = ".txt") -> DataFrame:
    """The manifest of the joined files, one row per part: ``id_cols``, ``out_file``, ``offset``, ``length``, ``checksum``.

    Every task joins its own parts and begins another file before ``target_bytes`` would be passed, so nothing is
    shuffled and a task holds one file at a time. With ``folder``, which all executors share, the files are written
    there (a temporary name, then a rename) and the parts are checked as read back from the disk.
    """
    ids = list(id_cols)
    kinds = dict(parts.dtypes)
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in ids) + ", out_file string, offset long, length long, checksum string"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task, held, size, n = TaskContext.get().partitionId(), [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"part-{task:06d}-{n:05d}{suffix}"
            whole, marks = join_bytes([x[-1] for x in held], kind, header)
            if folder is not None:
                _put(folder, name, whole, marks)
            columns = [pa.array([x[i] for x in held], schema.field(i).type) for i in range(len(ids))]
            out = [pa.array([name] * len(held)), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.array([m[2] for m in marks])]
            return pa.RecordBatch.from_arrays(columns + out, [*ids, "out_file", "offset", "length", "checksum"])

        schema = None
        for b in batches:
            schema = b.schema
            for row in zip(*[c.to_pylist() for c in b.columns]):
                add = len(row[-1] or b"") + 1
                if held and size + add > target_bytes:
                    yield close()
                    held, size, n = [], 0, n + 1
                held.append(row)
                size += add
        if held:
            yield close()

    return parts.select(*ids, F.col(content)).mapInArrow(run, ddl)


def _put(folder: str, name: str, whole: bytes, marks: Sequence[tuple[int, int, str]]) -> None:
    import os

    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    temp = f"{path}.{os.getpid()}.tmp"
    with open(temp, "wb") as f:
        f.write(whole)
    with open(temp, "rb") as f:
        back = f.read()
    if len(back) != len(whole) or any(hashlib.sha256(back[o : o + n]).hexdigest() != h for o, n, h in marks):
        raise ValueError(f"{name}: lengths or checksums differ after writing")
    os.replace(temp, path)


def concatenate(parts: DataFrame, id_cols: Sequence[str], content: str = "content", kind: str = "lines", header: bytes | None = None, target_bytes: int = 128 << 20) -> DataFrame:
    """``out_file``, ``n_parts``, ``n_bytes``, ``checksum``, ``content``: one row per output file, checked by ``join_bytes``."""
    import pandas as pd

    plan = manifest(parts, id_cols, content, target_bytes).select(*id_cols, "out_file")
    ids = list(id_cols)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ids)
        whole, marks = join_bytes(list(pdf[content]), kind, header)
        return pd.DataFrame({"out_file": [int(pdf.out_file.iloc[0])], "n_parts": [len(marks)], "n_bytes": [len(whole)], "checksum": [hashlib.sha256(whole).hexdigest()], "content": [whole]})

    return parts.select(*ids, content).join(plan, ids).groupBy("out_file").applyInPandas(one, "out_file int, n_parts long, n_bytes long, checksum string, content binary")


def write_concatenated(files: DataFrame, folder: str, suffix: str = ".txt") -> DataFrame:
    """Write the rows of ``concatenate`` as files of a shared folder (a temporary name, then a rename); gives name and bytes."""

    def write(batches: Iterator) -> Iterator:
        import os

        import pandas as pd

        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            names = []
            for n, data, want in zip(pdf.out_file, pdf.content, pdf.checksum):
                name = os.path.join(folder, f"part-{n:06d}{suffix}")
                temp = f"{name}.{os.getpid()}.tmp"
                with open(temp, "wb") as f:
                    f.write(data)
                with open(temp, "rb") as f:
                    if hashlib.sha256(f.read()).hexdigest() != want:
                        raise ValueError(f"{name}: checksum differs after writing")
                os.replace(temp, name)
                names.append(name)
            yield pd.DataFrame({"name": names, "n_bytes": pdf.n_bytes, "n_parts": pdf.n_parts})

    return files.mapInPandas(write, "name string, n_bytes long, n_parts long")
