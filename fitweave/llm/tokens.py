"""Token-ID output: texts to ids, ids to seekable zstandard files, and the way back.

Rows are range-partitioned and sorted by doc_id, then each task encodes its texts
and streams them to one file (see `seekable`), renamed when whole, so a task
that runs again replaces its own file. Equal words of a worker are encoded once:
this tokenizer ignores case and blanks and never joins letters with marks, so a
text's ids are those of its words and marks in order (a tokenizer of another kind
needs another `encoder`).

Defined results: null and empty texts are the end id alone; rows with a null
doc_id come first; repeated rows and ids are all written, rows of one id in an
order fixed by their text; no rows give no files; further columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fitweave.llm.bytesops import LOWER, pieces, raw, table
from fitweave.llm.seekable import Reader, Writer
from fitweave.llm.steps import fresh_path, stored

END_ID = 1
#: Distinct words whose ids a worker keeps, beyond which it starts afresh; words encoded in one call.
KEPT_WORDS, GROUP = 400_000, 64
PIECE = 1 << 21
#: Where a text may be cut without changing its ids: at blanks, and between an ASCII letter and a mark.
BLANK = table((0x20, 0x20), (0x0A, 0x0A))
LETTER = table((0x61, 0x7A))
MARK = table((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=1)
def encoder(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """texts -> (ids of all texts one after another, ids of each text), without end ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer, known = Tokenizer.from_file(path), {}
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def learn(words: list[bytes]) -> None:
        """Ids of new words; words of letters alone go in groups, told apart by their last ids."""
        letters, others = [], []
        for word in words:
            text = word.decode()
            (letters if text.isalpha() else others).append((word, text))
        groups = [letters[low : low + GROUP] for low in range(0, len(letters), GROUP)]
        for group, encoded in zip(groups, tokenizer.encode_batch_fast([" ".join(t for _, t in g) for g in groups], add_special_tokens=False)):
            ids = np.array(encoded.ids, dtype="<u4")
            ends = np.flatnonzero(ends_word[ids]) + 1
            if len(ends) != len(group) or ends[-1] != len(ids):
                others += group
                continue
            low = 0
            for (word, _), high in zip(group, ends.tolist()):
                known[word] = ids[low:high].tobytes()
                low = high
        for (word, _), encoded in zip(others, tokenizer.encode_batch_fast([t for _, t in others], add_special_tokens=False)):
            known[word] = np.array(encoded.ids, dtype="<u4").tobytes()

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = raw(texts)
        cut = np.ones(len(data), dtype=bool)
        blank = BLANK[data]
        cut[1:] = blank[1:] != blank[:-1]
        if b"<|" not in data.tobytes():  # else it may hold a special token, whose case and marks count
            data = LOWER[data]
            cut[1:] |= LETTER[data[:-1]] & MARK[data[1:]]
        cut[offsets[offsets < len(data)]] = True
        starts = np.flatnonzero(cut)
        bounds = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, bounds, pa.py_buffer(data)]).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        missing = [w for w in distinct if w not in known]
        if len(known) + len(missing) > KEPT_WORDS:
            known.clear()
            missing = distinct
        learn(missing)
        packed = [known[w] for w in distinct]
        flat = np.frombuffer(b"".join(packed), dtype="<u4")
        lengths = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
        firsts = np.cumsum(lengths) - lengths
        order = np.asarray(coded.indices)
        sizes = lengths[order]
        reach = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.repeat(firsts[order] - reach[:-1], sizes) + np.arange(reach[-1])]
        return ids, np.diff(reach[np.searchsorted(starts, offsets)])

    return encode


def write_tokens(documents: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write token files in ascending doc_id order; (part, file, n_docs, n_tokens) of each file."""
    path = tokenizer or default_tokenizer()
    spark = documents.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(target)
    uri = files.makeQualified(target).toString()
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer = TaskContext.get().partitionId(), None
        encode, end = encoder(path), np.array([end_id], dtype="<u4")
        file = f"{uri}/part-{part:06d}.tokens"
        for batch in batches:
            for piece in pieces(batch, limit=PIECE):
                writer = writer or Writer(file)
                ids, sizes = encode(piece.column("text"))
                high = np.cumsum(sizes)
                for doc_id, a, b in zip(piece.column("doc_id").to_pylist(), (high - sizes).tolist(), high.tolist()):
                    writer.add(doc_id, np.concatenate([ids[a:b], end]))
        if writer is not None:
            writer.close()
            yield pa.record_batch([pa.array([part]), pa.array([file]), pa.array([len(writer.ids)]), pa.array([sum(writer.sizes)])], names=["part", "file", "n_docs", "n_tokens"])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return stored(rows.mapInArrow(write, "part bigint, file string, n_docs bigint, n_tokens bigint"), "token-files")


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file) of every document, from the files themselves."""
    first = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = Reader(row["file"])
                for low in range(0, len(reader.doc_ids), 8192):
                    some, crcs = slice(low, low + 8192), []
                    for position in range(low, min(low + 8192, len(reader.doc_ids))):
                        crc = 0
                        for ids in reader.parts(position):
                            crc = zlib.crc32(ids, crc)
                        crcs.append(crc)
                    yield pa.record_batch(
                        [pa.array(reader.doc_ids[some], mask=~reader.valid[some]), pa.array(reader.before[some] + row["first"]), pa.array(reader.sizes[some]), pa.array(crcs, pa.int64()), pa.array([row["file"]] * len(crcs))],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "file"],
                    )

    placed = files.select("part", "file", F.coalesce(first, F.lit(0)).alias("first"))
    placed = placed.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part")
    return placed.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, file string")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as token files and return what the files hold."""
    files = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh_path(spark, "tokens"))
    return read_tokens(files)


QUERIES = {"op2_token_output": op2_token_output}
ORACLE: dict[str, str] = {}
