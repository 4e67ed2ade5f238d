"""Token counts as delta-maintained rollups.

A change batch holds signed images of documents: an insert is +1, a delete -1 with the old image, a
revision both.  A batch is counted once, reduced to additive deltas by source, language and tokenizer
version, written under a staging name and committed by a manifest that is written under a temporary name
and renamed without overwriting, which fails if the batch was committed before.  Totals are sums over the
committed deltas, so applying a batch again, or a retried job, changes nothing; a driver lost before the
rename leaves no manifest, and the batch can be applied again.  ``compact`` folds committed deltas into
one, under the same protocol.

Every function takes repeated rows and ties as they are: each row is an image of its own and counts once.
Nulls in source or language are keys like others, a null text counts zero tokens and bytes, and an empty table
makes an empty batch.  Columns other than those named are ignored, whatever they are called.

The folder must be on a file system whose rename does not overwrite (HDFS; on a local one two drivers that
commit the same batch in the same instant are not told apart).
"""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_bytes"]
DELTA_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_bytes long"


def load_tokenizer(path: str):
    """A function from texts to token counts, by the file's kind."""
    if path.endswith(".model"):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(own.encode(t)) if t else 0 for t in texts]
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [_count_ordinary(own, t) if t else 0 for t in texts]


#: White space of so many characters is encoded by itself: the library's pattern backtracks over it and overflows its stack.
LONG_BLANKS = regex.compile(r"\p{White_Space}{20000,}")


def _count_ordinary(own, text: str) -> int:
    """Tokens of a text.  The pattern makes one piece of white space, up to its last sign if others follow."""
    n, at = 0, 0
    for m in LONG_BLANKS.finditer(text):
        if m.start() > at:
            n += len(own.encode_ordinary(text[at : m.start()]))
        at = m.end() if m.end() == len(text) else m.end() - 1
        n += len(own._encode_single_piece(text[m.start() : at]))
    return n + (len(own.encode_ordinary(text[at:])) if at < len(text) else 0)


IMAGE = ["sign", "source", "lang", "tokenizer", "n_tokens", "n_bytes"]
IMAGE_SCHEMA = "sign long, source string, lang string, tokenizer string, n_tokens long, n_bytes long"


def count_tokens(changes: DataFrame, tokenizers: dict[str, str]) -> DataFrame:
    """sign, source, lang, tokenizer, n_tokens, n_bytes of each image; a null text counts zero."""

    def run(records):
        known = {k: load_tokenizer(p) for k, p in tokenizers.items()}
        for rec in records:
            texts = [t or "" for t in rec.column(3).to_pylist()]
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            for name, count in known.items():
                yield pa.RecordBatch.from_arrays([rec.column(0), rec.column(1), rec.column(2), pa.array([name] * len(texts), pa.string()), pa.array(count(texts), pa.int64()), size], names=IMAGE)

    changes.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(c.ARROW_BYTES))
    return changes.select("sign", "source", "lang", "text").mapInArrow(run, IMAGE_SCHEMA)


def inserts(docs: DataFrame, source_name: str = "source", lang_name: str = "lang", text_name: str = "text") -> DataFrame:
    """An image with sign 1 of every row, repeated ones too."""
    cells = {"source": source_name, "lang": lang_name, "text": text_name}
    return docs.select(F.lit(1).cast("long").alias("sign"), *(c.cell(v).cast("string").alias(k) for k, v in cells.items()))


def deletes(docs: DataFrame, **names) -> DataFrame:
    """An image with sign -1 of every row, which has to be as it was when it came in."""
    return inserts(docs, **names).withColumn("sign", F.lit(-1).cast("long"))


def revisions(old: DataFrame, new: DataFrame, **names) -> DataFrame:
    """Old images with sign -1 and new ones with sign 1."""
    return deletes(old, **names).unionByName(inserts(new, **names))


def reversed_images(counted: DataFrame) -> DataFrame:
    """Counted images with the other sign: a delete needs no second count where the counts are kept."""
    return counted.withColumn("sign", -F.col("sign"))


def deltas(counted: DataFrame) -> DataFrame:
    """Additive deltas of counted images; map-side sums leave one row a key and task for the shuffle."""
    n = F.col("sign")
    return counted.groupBy(*KEYS).agg(F.sum(n).alias("n_docs"), F.sum(n * F.col("n_tokens")).alias("n_tokens"), F.sum(n * F.col("n_bytes")).alias("n_bytes"))


class Rollup:
    """The committed deltas below one folder of a shared file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> dict[str, dict]:
        at = self._path(f"{self.path}/commits")
        if not self._fs.exists(at):
            return {}
        out = {}
        for f in self._fs.listStatus(at):
            stream = self._fs.open(f.getPath())
            try:
                out[f.getPath().getName()] = json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
        return out

    def committed(self) -> set[str]:
        found = self._manifests()
        return {b for m in found.values() for b in m["batches"]}

    def _commit(self, name: str, manifest: dict) -> bool:
        """Write the manifest under a temporary name and rename it; False if there is one already."""
        from py4j.protocol import Py4JJavaError

        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        self._fs.mkdirs(self._path(f"{self.path}/commits"))
        temp, to = self._path(f"{self.path}/staging/{uuid.uuid4().hex}"), self._path(f"{self.path}/commits/{name}")
        stream = self._fs.create(temp, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        kind = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
        options = sc._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), sc._jsc.hadoopConfiguration()).rename(temp, to, options)
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            self._fs.delete(temp, False)
            return False
        return True

    def _settle(self, name: str, manifest: dict) -> bool:
        done = self._commit(name, manifest)
        if not done:  # another attempt was first: its data count, these do not
            self._fs.delete(self._path(f"{self.path}/{manifest['data']}"), True)
        return done

    def apply(self, batch: str, changes: DataFrame, tokenizers: dict[str, str]) -> bool:
        """Count and commit a batch; False if it was committed before."""
        return False if self._known(batch) else self.apply_counted(batch, count_tokens(changes, tokenizers))

    def _known(self, batch: str) -> bool:
        if not batch or "/" in batch or batch.startswith("."):
            raise ValueError("a batch needs a plain name")
        return batch in self.committed()

    def apply_counted(self, batch: str, counted: DataFrame) -> bool:
        """Commit a batch of counted images (the columns of ``count_tokens``); False if it was committed before."""
        if self._known(batch):
            return False
        staged = f"data/{batch}-{uuid.uuid4().hex}"
        deltas(counted).write.parquet(f"{self.path}/{staged}")
        return self._settle(batch, {"batches": [batch], "data": staged})

    def _visible(self) -> list[str]:
        """Data folders that count: a compaction hides the single commits it covers."""
        found = self._manifests()
        best: list[dict] = []
        hidden: set[str] = set()
        for m in sorted(found.values(), key=lambda m: -len(m["batches"])):
            if not hidden & set(m["batches"]):
                best.append(m)
                hidden |= set(m["batches"])
        return [m["data"] for m in best]

    def totals(self) -> DataFrame:
        """Sums by source, language and tokenizer version; keys whose documents are all gone drop out."""
        paths = [f"{self.path}/{p}" for p in self._visible()]
        rows = self.spark.read.schema(DELTA_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA_SCHEMA)
        out = rows.groupBy(*KEYS).agg(*[F.sum(k).alias(k) for k in SUMS])
        return out.where(" or ".join(f"{k} <> 0" for k in SUMS))

    def compact(self) -> bool:
        """Fold all committed batches into one data folder.  Call from one maintenance job at a time."""
        found = self._manifests()
        batches = sorted({b for m in found.values() for b in m["batches"]})
        if len(found) < 2:
            return False
        staged = f"data/compact-{uuid.uuid4().hex}"
        self.totals().write.parquet(f"{self.path}/{staged}")
        return self._settle(f"compact-{len(batches)}-{uuid.uuid4().hex}", {"batches": batches, "data": staged})
