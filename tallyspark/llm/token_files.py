"""Token ids as Parquet files that can be read in part.

write() encodes whole texts and writes a row for each document: its id, its
number of ids, how many ids stand before it in its file, and the ids as a list
column. Rows lie in ascending doc_id order within a file and across files.

* Ids are dictionary encoded (a vocabulary's ids fill one dictionary page, and
  an id takes as many bits as the dictionary needs); the ordered columns beside
  them are delta encoded. Pages and row groups have a size of their own, and
  Parquet's page index tells which pages a range of doc_id or of places lies in.
* A reader of lengths never touches the id column; a reader of some documents or
  of a range of the whole stream of ids reads the pages that hold them.
* `shards` beside the files has a row for each file with the ids before it: a
  file's rows need not know what other files hold, so all are written at once.

Texts are range-partitioned before they are encoded, so each is encoded once.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import prepare, shared_path, table

END_ID = 1
#: Bytes of a row group, of a page, and rows of a page at most.
ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 64 << 10, 2000
#: Words, and pre-tokens, whose ids a worker remembers, and bytes of one at most.
KNOWN, KNOWN_BYTES = 400_000, 64
#: Bytes of text that are encoded together, if a text isn't longer.
GATHERED = 12 << 20
#: New words in a call of the library, where words aren't of plain signs.
TOGETHER = 256

COLUMNS = "doc_id long, shard int, shard_start long, n_tokens long, ids array<int>"


class WordEncoder:
    """Ids of whole texts by a file of the `tokenizers` library, word by word.

    Where the file's normalizer and pre-tokenizer drop white space and look at
    nothing across it, a text's ids are those of its words between ASCII white
    space, one after another, and a word that was met before costs a look-up. A
    new word of plain signs is cut into the file's pre-tokens here, which the
    library's model merges; the library encodes all others from end to end.
    Files of another kind encode whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.by_word = _drops_space(path)
        self.known: dict[bytes, bytes] = {}
        self.merges, self.pieces = self.model.model, {}

    def whole(self, text: bytes) -> np.ndarray:
        return np.array(self.model.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<i4")

    def _plain(self, word: str) -> bytes:
        """The ids of a word of PLAIN signs: its pre-tokens, each by the vocabulary's merges."""
        pieces, found = self.pieces, []
        lower = word.lower()
        for p in (lower,) if lower.isalpha() else _PIECES.findall(lower):
            ids = pieces.get(p)
            if ids is None:
                shown = p if p.isascii() else p.encode().decode("latin-1").translate(_SHOWN)
                ids = array("i", [t.id for t in self.merges.tokenize(shown)]).tobytes()
                if len(p) <= KNOWN_BYTES:
                    pieces[p] = ids
            found.append(ids)
        return b"".join(found)

    def _others(self, texts: list[str]) -> list[bytes]:
        """The ids of any words, encoded by the library as one text: a token belongs to the word that its offset lies in."""
        found = self.model.encode(" ".join(texts), add_special_tokens=False)
        ids, starts = np.array(found.ids, "<i4"), np.array([a for a, _ in found.offsets], np.int64)
        cuts = [0, *np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])).tolist()]
        return [ids[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """The ids of new words."""
        for memory in (self.known, self.pieces):
            if len(memory) > KNOWN:
                memory.clear()
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = [PLAIN.fullmatch(t) is not None and "<|" not in t for t in texts]
        others = [t for t, p in zip(texts, plain, strict=True) if not p]
        rest = iter([e for i in range(0, len(others), TOGETHER) for e in self._others(others[i : i + TOGETHER])])
        learned = [self._plain(t) if p else next(rest) for t, p in zip(texts, plain, strict=True)]
        self.known.update((w, e) for w, e in zip(words, learned, strict=True) if len(w) <= KNOWN_BYTES)
        return learned

    def _lists(self, words: list[bytes]) -> pa.ListArray:
        found = list(map(self.known.get, words))
        fresh = [i for i, e in enumerate(found) if e is None]
        for i, e in zip(fresh, self._learn([words[i] for i in fresh]) if fresh else (), strict=True):
            found[i] = e
        ends = np.cumsum([len(e) // 4 for e in found])
        return pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), pa.array(np.frombuffer(b"".join(found), "<i4")))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has. Null is empty."""
        texts = texts.fill_null("")
        if not self.by_word:
            rows = [self.whole(t) for t in texts.cast(pa.binary()).to_pylist()]
            return np.concatenate([np.empty(0, "<i4"), *rows]), np.array([len(r) for r in rows], np.int64)
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        taken = self._lists(words.dictionary.cast(pa.binary()).to_pylist()).take(words.indices)
        ends = taken.offsets.to_numpy()[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return taken.values.to_numpy(), np.diff(ends).astype(np.int64)


#: Fixed value: the pattern of word vocabularies, whose matches are encoded one by one.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _drops_space(path: str) -> bool:
    """White space only parts pre-tokens, and nothing else depends on it: the pre-tokenizer keeps matches of a pattern without white space, normalizers work on characters alone, and added tokens strip none."""
    import json
    from pathlib import Path

    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    norms, pres = norm.get("normalizers", [norm] if norm else []), pre.get("pretokenizers", [pre] if pre else [])
    plain = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in norms)
    kept = {"Regex": PIECES}
    split = len(pres) == 2 and pres[0]["type"] == "Split" and pres[0]["pattern"] == kept and pres[0]["invert"] and pres[0]["behavior"] == "Removed" and pres[1]["type"] == "ByteLevel" and not pres[1]["use_regex"] and not pres[1]["add_prefix_space"]
    added = all(not t[k] for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
    return plain and split and added and not any(c.isspace() for t in spec.get("added_tokens", []) for c in t["content"])


#: Signs whose normal form, lower case and class no Unicode version changes: ASCII and Latin letters with marks. (A capital I with a dot becomes two code points.)
PLAIN = re.compile("[\x21-\x7e\xa1-\u012f\u0131-\u017f]+")
#: PIECES over lower-case plain signs, by their letters and numbers.
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")
#: Bytes as byte-level vocabularies show them: printable ones as themselves, the others as 256 and on, in order.
_SHOWN = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}

_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _gathered(batches):
    """The rows in larger batches: more words of a batch are repeated ones."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= GATHERED:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _encoded(batches, path: str, end: int):
    """Rows of one file, in the order they come; the place within the file is counted on."""
    from pyspark import TaskContext

    shard, total = TaskContext.get().partitionId(), 0
    for b in _gathered(batches):
        values, counts = encoder(path).ids(b.column(1))
        counts = counts + 1
        ends = np.cumsum(counts)
        ids, inner = np.full(int(counts.sum()), end, "<i4"), np.ones(int(counts.sum()), bool)
        inner[ends - 1] = False
        ids[inner] = values
        lists = pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), pa.array(ids))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(b.num_rows, shard, np.int32)), pa.array(total + ends - counts), pa.array(counts), lists], names=["doc_id", "shard", "shard_start", "n_tokens", "ids"])
        total += len(ids)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, row_group: int = ROW_GROUP, page: int = PAGE, page_rows: int = PAGE_ROWS) -> None:
    """Writes docs (doc_id, text) as token files and shards into path, a new folder that driver and executors share.

    Every document ends with end_id, so null and empty texts have that one id.
    Rows without a doc_id come first. Rows that repeat a doc_id lie beside each
    other by a hash of their text; equal ones take any order. Many rows of one
    doc_id may fill several files. Extra columns are left out; an empty table
    has no files with rows.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.monotonically_increasing_id().alias("nth"))
    order = ["doc_id", "key", "nth"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    encoded = ordered.mapInArrow(partial(_encoded, path=tokenizer or default_tokenizer(), end=end_id), COLUMNS)
    options = {
        "parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true", "compression": "zstd",
        "parquet.block.size": row_group, "parquet.page.size": page, "parquet.page.row.count.limit": page_rows,
    }
    encoded.write.options(**options).parquet(f"{path}/tokens")
    each = metadata(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    # A row a file: no more than the tasks that wrote them.
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each.withColumn("start", before).coalesce(1).write.parquet(f"{path}/shards")


def tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows as they are."""
    return spark.read.schema(COLUMNS).parquet(f"{path}/tokens")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, shard, shard_start, n_tokens): the id column isn't read."""
    return tokens(spark, path).drop("ids")


def shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard, n_tokens, n_docs, first_doc, last_doc, start) per file that has rows."""
    return spark.read.schema("shard int, n_tokens long, n_docs long, first_doc long, last_doc long, start long").parquet(f"{path}/shards")


def documents(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids), all or those of a range of doc_id, both ends included: start counts the ids of all documents before it."""
    rows = tokens(spark, path)
    rows = rows.where(F.col("doc_id") >= first) if first is not None else rows
    rows = rows.where(F.col("doc_id") <= last) if last is not None else rows
    base = F.broadcast(shards(spark, path).select("shard", F.col("start").alias("base")))  # a row a file
    return rows.join(base, "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


def token_range(spark: SparkSession, path: str, begin: int, end: int) -> DataFrame:
    """(doc_id, start, ids) of the ids at places begin to end, end exclusive, of all files as one stream; documents at the ends are cut. Only files, row groups and pages that hold some of them are read."""
    held = shards(spark, path).where((F.col("start") < end) & (F.col("start") + F.col("n_tokens") > begin)).select("shard", "start").collect()  # the files that the range crosses
    if not held:
        return documents(spark, path).where("false").select("doc_id", "start", "ids")
    first, last = min(held, key=lambda r: r["start"]), max(held, key=lambda r: r["start"])
    rows = tokens(spark, path).where(F.col("shard").between(first["shard"], last["shard"]))
    rows = rows.where((F.col("shard") < last["shard"]) | (F.col("shard_start") < end - last["start"]))
    base = F.broadcast(spark.createDataFrame([tuple(r) for r in held], "shard int, base long"))
    placed = rows.join(base, "shard").withColumn("at", F.col("base") + F.col("shard_start")).where((F.col("at") < end) & (F.col("at") + F.col("n_tokens") > begin))
    low = F.greatest(F.lit(begin) - F.col("at"), F.lit(0))
    high = F.least(F.lit(end) - F.col("at"), F.col("n_tokens"))
    return placed.select("doc_id", (F.col("at") + low).alias("start"), F.slice("ids", (low + 1).cast("int"), (high - low).cast("int")).alias("ids"))


def _sums(batches):
    for b in batches:
        lists = b.column(3)
        at, values = lists.offsets.to_numpy(), np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
        crc = [zlib.crc32(values[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(docs: DataFrame) -> DataFrame:
    """documents() with ids_crc32 in place of the ids: the unsigned crc32 of them as unsigned little-endian 32-bit integers."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_sums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = shared_path(spark, "token-files")
    write(docs, path)
    return checksums(documents(spark, path))
